"""Containers: their streams are made and read once, whatever is checked of them."""

import random

from pyspark.sql import functions as F

from postmill.functions import codes
from postmill.operators import structure
from postmill.sources import mail


def test_words_and_their_bytes(spark):
    rng = random.Random(5)
    data = [b"", *(bytes(rng.randrange(256) for _ in range(n)) for n in range(1, 9) for _ in range(5)), b"\xff" * 8, b"\0" * 7 + b"\x80"]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, d binary").select("i", codes.word(F.col("d")).alias("w")).collect()
    assert {r.i: r.w for r in rows} == {i: int.from_bytes(d, "little", signed=len(d) == 8) if d else None for i, d in enumerate(data)}
    numbers = [(v, n) for n in (2, 4, 8) for v in (0, 1, 0x1234, rng.randrange(1 << (8 * n - 1)), (1 << (8 * n - 1)) - 1)]
    for v, n in numbers:
        assert spark.range(1).select(codes.little(F.lit(v), n)).first()[0] == v.to_bytes(n, "little").hex().upper()


def test_scopes(spark):
    paths = {
        "/x": "message", "/__recip_version1.0_#00000000/x": "recipient", "/__attach_version1.0_#1/__substg1.0_3701000D/x": "embedded_message", "/__substg1.0_3701000D2/x": "message", "/a__nameid_version1.0/x": "message",
        "/__nameid_version1.0/x": "named_properties", "/__nameid_version1.0": "message", "__nameid_version1.0/x": "named_properties", "/__attach_version1.0_#1/own\nstore/x": "attachment", "/__substg1.0_3701000D/__recip_version1.0_#2": "embedded_message",
    }
    rows = spark.createDataFrame([(p,) for p in (*paths, None)], "p string").select("p", codes.scope(F.col("p")).alias("s")).collect()
    assert {r.p: r.s for r in rows} == {**paths, None: None}


def test_streams_are_made_once(spark, sf_dir):
    """The plan of the checks read streams from the tables for each of its parts; now it reads what was stored."""
    plan = structure.checks(*mail.containers(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_quantity") <= 6  # of the storages alone


def test_only_8_bit_strings_meet_python(spark):
    name = "__substg1.0_6700"
    streams = spark.createDataFrame([(1, "", f"{name}001E", b"a\x81"), (1, "", f"{name}001F", "é".encode("utf-16-le")), (1, "", f"{name}0102", b"\1\2"), (2, "", f"{name}001E", b"abc"), (2, "", f"{name}001F", None)], "file long, parent string, name string, data binary")
    pages = spark.createDataFrame([(1, 1252), (2, 99999)], "file long, page int")
    seen = structure.texts_of(streams, pages)
    got = {(r.file, r.path[-4:]): (r.size, r.text, r.replaced, r.status) for r in seen.collect()}
    assert got == {(1, "001E"): (2, "a�", 1, "text"), (1, "001F"): (2, "é", None, None), (1, "0102"): (2, None, None, None), (2, "001E"): (3, "abc", 0, "ascii")}

"""Column functions against plain statements of what they do."""

import unicodedata
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postmill.functions import codes, markup, names, texts
from postmill.operators import census
from postmill.sources import scratch

NAMES = ["NUL", "con.txt", "a/b:c", "folder.json", "...", "  ", "é", "é", "z" * 200, "report.pdf", "COM1.x", "lpt¹", "a\x01b​c~d", " x . ", "", "\U0001f600" * 40]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def test_cleaned_names_are_legal_and_stay_as_they_are(spark):
    once = names.cleaned(column(spark, NAMES), "v", "(unnamed)").select("i", F.col("safe.name").alias("v"), names.is_legal(F.col("safe.name")).alias("legal"))
    twice = names.cleaned(once, "v", "(unnamed)")
    for r in twice.collect():
        assert r.legal, r.v
        assert r.safe.name == r.v and unicodedata.normalize("NFC", r.v) == r.v
    got = {r.i: r.v for r in once.collect()}
    assert got[0] == "NUL_" and got[1] == "con_.txt" and got[2] == "a-b_c" and got[4] == "(unnamed)" and got[6] == got[7] == "é" and got[12] == "abc_d"


def test_flags(spark):
    got = [r.safe.flags for r in names.cleaned(column(spark, ["a\x01b​c~d/", " x.", "aux"]), "v", "-").orderBy("i").collect()]
    assert got == [["reserved_char_replaced", "control_removed", "invisible_removed", "tilde_replaced"], ["trimmed"], ["device_name_mangled"]]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.integers(0, 40))
def test_shorten(text, most):
    out = names.shorten(text, most)
    units = len(out.encode("utf-16-le", "surrogatepass")) // 2
    assert units <= most or out == text
    assert out == text or out.endswith("…") or most == 0


def test_units_and_extensions(spark):
    rows = column(spark, ["a\U0001f600é", "x.pdf", ".bashrc", "a.b c", "a." + "x" * 17]).select("i", names.units(F.col("v")).alias("u"), names.extension(F.col("v")).alias("e")).orderBy("i").collect()
    assert rows[0].u == 4 and [r.e for r in rows] == ["", ".pdf", "", "", ""]


def test_filetimes(spark):
    ticks = [133000000000000000, 0, -1, 2650467743999999999, 2650467744000000000, None]
    got = [r[0] for r in column(spark, ticks, "bigint").orderBy("i").select(codes.filetime_text(F.col("v"))).collect()]
    assert got == ["2022-06-18T04:26:40Z", "1601-01-01T00:00:00Z", None, "9999-12-31T23:59:59Z", None, None]


@pytest.mark.parametrize("page,data,text,replaced", [(1252, b"caf\xe9 \x81", "café �", 1), (932, "日本".encode("cp932"), "日本", 0), (65001, b"a\xff\xfeb", "a��b", 2), (99999, b"plain", "plain", 0), (99999, b"\xff", None, 0)])
def test_decoded(spark, page, data, text, replaced):
    r = spark.createDataFrame([(data, page)], "d binary, p int").select(codes.decoded(F.col("d"), F.col("p")).alias("x")).first().x
    assert r.text == text and r.replaced == replaced


def test_utf16(spark):
    data = ["aé".encode("utf-16-le") + b"x", b"\x00\xd8", b"", None, "x\U0001f600y".encode("utf-16-le"), b"\x00\xdc\x41\x00", b"\x00\xd8\x00\xd8\x00\xdc", "\uffff\ue000\ud7ff".encode("utf-16-le"), "long ü".encode("utf-16-le") * 9000]
    want = ["aé", None, "", None, "x\U0001f600y", None, None, "\uffff\ue000\ud7ff", "long ü" * 9000]
    assert [r[0] for r in spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, d binary").orderBy("i").select(codes.utf16_text(F.col("d"))).collect()] == want


def test_fixed_values(spark):
    import math
    import struct

    cases = [(2, struct.pack("<h6x", v), v) for v in (0, 1, -1, -32768, 32767)] + [(3, struct.pack("<i4x", v), v) for v in (0, -5, 2**31 - 1, -(2**31))] + [(10, struct.pack("<I4x", v), v) for v in (0, 2**32 - 1)]
    cases += [(t, struct.pack("<q", v), v) for t in (6, 20, 64) for v in (0, -1, 2**63 - 1, -(2**63), 133000000000000000)] + [(11, bytes([v]) + b"\0" * 7, int(v > 0)) for v in (0, 1, 2)]
    reals = (0.0, 1.5, -2.25, 1e-310, 5e-324, 1.7976931348623157e308, -0.1, math.inf, -math.inf, math.nan, math.pi)
    cases += [(t, struct.pack("<d", v), v) for t in (5, 7) for v in reals] + [(4, struct.pack("<f4x", v), struct.unpack("<f", struct.pack("<f", v))[0]) for v in (0.0, 1.5, -2.25, 1e-40, 3.4e38, math.inf, math.nan, 0.1)]
    cases += [(31, b"\0" * 8, None), (3, b"abc", None), (3, None, None), (None, b"\0" * 8, None)]
    df = spark.createDataFrame([(i, k, t) for i, (k, t, _) in enumerate(cases)], "i int, k int, t binary")
    for r in df.select("i", codes.fixed_value(F.col("k"), F.col("t")).alias("v")).collect():
        kind, want, got = cases[r.i][0], cases[r.i][2], r.v.as_double if cases[r.i][0] in (4, 5, 7) else r.v.as_long
        assert got == want or isinstance(want, float) and math.isnan(want) and math.isnan(got), (kind, want, got)
        assert r.v.as_long is None or r.v.as_double is None


def test_strings_at_offsets(spark):
    one = lambda t: len(t.encode("utf-16-le")).to_bytes(4, "little") + t.encode("utf-16-le")
    data = one("aé") + one("\U0001f600") + b"\x03\0\0\0abc" + one("") + b"\x02\0\0\0\0\xd8" + b"\xff\xff\xff\xff" + b"\x08\0\0\0x\0"
    offsets = {0: "aé", 8: "\U0001f600", 16: None, 23: "", 27: None, 33: None, 37: None, 100: None, 40: None, 41: None, 2: None}
    rows = spark.createDataFrame([(data, k) for k in offsets] + [(None, 0)], "d binary, k long").select("k", "d", codes.string_at(F.col("d"), F.col("k")).alias("t")).collect()
    assert {r.k: r.t for r in rows if r.d is not None} == offsets and [r.t for r in rows if r.d is None] == [None]


def test_property_entries(spark):
    import struct

    entry = struct.pack("<HHIq", 64, 0x0E06, 6, 133000000000000000) + struct.pack("<HHIi4x", 3, 0x3705, 6, -5)
    df = spark.createDataFrame([(b"\0" * 32 + entry + b"rest",), (b"",)], "d binary")
    found = df.select(F.explode(codes.property_entries(F.col("d"), F.lit(32))).alias("e")).select("e.*", codes.fixed_value(F.col("e.property_type"), F.col("e.tail")).alias("v")).collect()
    assert [(r.property_type, r.property_id, r.flags, r.v.as_long) for r in found] == [(64, 0x0E06, 6, 133000000000000000), (3, 0x3705, 6, -5)]


def test_password_checksum():
    assert codes.password_checksum(b"") == 0
    assert codes.password_checksum(b"123456789") == (zlib.crc32(b"123456789", 0xFFFFFFFF) ^ 0xFFFFFFFF)


def test_links_and_content_ids(spark):
    df = column(spark, [" <Im%41ge@X> ", "a%zz", "%ff", None])
    assert [r[0] for r in df.orderBy("i").select(texts.content_id_key(F.col("v"))).collect()] == ["image@x", "a%zz", "%ff", None]
    assert spark.range(1).select(texts.link(F.lit("a b(é)~*")).alias("l")).first().l == "a%20b%28%C3%A9%29~%2A"


def test_fences(spark):
    rows = column(spark, ["no", "a `b` ```c```", "`", ""]).orderBy("i").select(texts.fence(F.col("v")).alias("f"), texts.code_span(F.col("v")).alias("s")).collect()
    assert [r.f for r in rows] == ["```", "````", "```", "```"] and rows[2].s == "`` ` ``"


def test_preprocessing(spark):
    html = "a<!-- <style> -->b<style>x</style >c<script>'<!--'</script>d<styled>e</styled><![if !x]>f<![endif]><o:p>g</o:p><title>t"
    got = column(spark, [html]).select(texts.preprocessed(F.col("v")).alias("p"), texts.applied(F.col("v")).alias("a")).first()
    assert got.p == "abcd<styled>e</styled>fg"
    assert got.a == list(texts.STEPS)


def test_padding(spark):
    runs = ["a" + "‌ " * 9 + "b", "­" * 8, "e‍" * 3, "x " + "﻿" * 7 + "y"]
    assert [r[0] for r in column(spark, runs).orderBy("i").select(texts.without_padding(F.col("v"))[0]).collect()] == ["a b", "", "e‍" * 3, "x " + "﻿" * 7 + "y"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
def test_alignment_accounts_for_all_words(a, b):
    matched, missing, extra = texts.align(a, b)
    assert matched + missing == len(a) and matched + extra == len(b)
    assert texts.align(a, a) == (len(a), 0, 0)


def test_alignment_goes_on_after_a_long_difference():
    same = [f"s{i}" for i in range(3000)]
    a, b = [f"a{i}" for i in range(100)] + same, [f"b{i}" for i in range(100)] + same
    assert texts.align(a, b) == (3000, 100, 100) and texts.compared(a, b) == (3000, 100, 100, 100)
    assert texts.compared(a, b[30:]) == (3000, 100, 70, 70)
    assert texts.compared(list("xyc"), list("pqc")) == (1, 2, 2, 2)  # each side's next word is nowhere on the other


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=30), st.lists(st.sampled_from("abcdefgh"), max_size=30), st.integers(1, 5))
def test_alignment_follows_the_rule_of_the_reference(a, b, reach):
    i = j = matched = missing = extra = unresynced = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j, matched = i + 1, j + 1, matched + 1
            continue
        h = next((k for k in range(1, reach + 1) if i + k < len(a) and a[i + k] == b[j]), None)
        m = next((k for k in range(1, reach + 1) if j + k < len(b) and b[j + k] == a[i]), None)
        if h is not None and (m is None or h <= m):
            i, missing = i + h, missing + h
        elif m is not None:
            j, extra = j + m, extra + m
        else:
            i, j, missing, extra, unresynced = i + 1, j + 1, missing + 1, extra + 1, unresynced + 1
    assert texts.compared(a, b, reach) == (matched, missing + len(a) - i, extra + len(b) - j, unresynced)


def test_rtf_kinds(spark):
    cases = {
        rb"{\rtf1\ansi\ansicpg1252\fromhtml1 \fbidis {\fonttbl}": "encapsulated_html", rb"{\rtf1\ansi\fromtext \deff0}": "encapsulated_text", rb"{\rtf1\ansi Hello}": "plain_rtf", b"Hello": "not_rtf", b"": "not_rtf", rb"{\rtf2\fromhtml1 }": "not_rtf",
        rb"{\rtf1\a\b\c\d\e\g\h\fromhtml1 }": "encapsulated_html", rb"{\rtf1\a\b\c\d\e\g\h\i\fromhtml1 }": "plain_rtf", rb"{\rtf1 Hello\fromhtml1 }": "plain_rtf", rb"{\rtf1\ansi{\fonttbl}\fromhtml1 }": "plain_rtf", rb"{\rtf1\fromhtml0 }": "plain_rtf",
    }
    got = spark.createDataFrame([(k, v) for k, v in cases.items()], "d binary, want string").select("want", codes.rtf_kind(F.col("d")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_entities(spark):
    cases = {
        "&lt;&#x41;&eacute;&nbsp;&unknown;": "<Aé\xa0", "&amp;lt; &a&amp;b & c;": "&lt; &a&b & c;", "&#0;&#128;&#x81;&#xD800;&#1114112;": "\uFFFD\u20ac\x81\uFFFD\uFFFD", "&#x1F600;&hearts;&Dagger;&dagger;": "\U0001F600\u2665\u2021\u2020",
        "&#99999999999;&#;&#xG;&;": "&#99999999999;&#;&#xG;&;", "plain": "plain", "": "", "&yuml;&Yuml;&#00065;": "\xff\u0178A",
    }
    got = {r.v: r.d for r in spark.createDataFrame([(k,) for k in cases], "v string").select("v", markup.visible_text(F.col("v")).alias("d")).collect()}
    assert got == cases
    assert len(texts.ENTITIES) == 96 + 47


def test_a_row_that_fails_is_labelled_and_the_others_go_on(spark):
    from pyspark.sql import types as T

    from postmill.functions.contained import contained

    run = contained(lambda n: (10 // n,), {"v": T.IntegerType()})
    rows = spark.createDataFrame([(n,) for n in (1, 2, 0, None, 5)], "n int").select("n", run("n").alias("r")).collect()
    assert {r.n: (r.r.v, r.r.failed) for r in rows} == {1: (10, None), 2: (5, None), 0: (None, "ZeroDivisionError"), None: (None, None), 5: (2, None)}
    r = spark.createDataFrame([(["a", "b"], ["a"], bytes([0x81, 0x41]), 1252)], "a array<string>, b array<string>, d binary, p int").select(texts.word_alignment("a", "b").alias("w"), codes.decoded(F.col("d"), F.col("p")).alias("d")).first()
    assert tuple(r.w) == (1, 1, 0, 0, None) and tuple(r.d) == ("\uFFFDA", 1, "text", None)


def padding_by_hand(text):
    invisible, pads = set("\u034f\xad\u200b\u200c\u200d\u2060\ufeff"), set(" \xa0")
    lines, runs, dropped = [], 0, False
    for line in text.split("\n"):
        out, removed, i = "", 0, 0
        while i < len(line):
            j = i
            while j < len(line) and line[j] in invisible | pads:
                j += 1
            if j > i and sum(c in invisible for c in line[i:j]) >= 8:
                removed += 1
                if out and not out[-1].isspace() and j < len(line) and not line[j].isspace():
                    out += " "
            else:
                j = max(j, i + 1)
                out += line[i:j]
            i = j
        runs += removed
        if removed and not out.strip():
            dropped = True
            continue
        if removed or line.strip():
            dropped = False
        elif dropped and (not lines or not lines[-1].strip()):
            continue
        lines.append(out)
    return "\n".join(lines), runs


def test_padding_over_lines(spark):
    import random

    rng = random.Random(9)
    parts = ["\n", "\n", "a", " ", "\u200b" * 8, "\u200b \xad" * 5, "\ufeff", "\t", "\xa0", "b c", "\n\n", "\u2060 " * 9]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 16))) for _ in range(800)] + ["", "\n", "x"]
    got = spark.createDataFrame(list(enumerate(cases)), "i int, m string").select("i", texts.without_padding(F.col("m"))[0].alias("t"), texts.without_padding(F.col("m"))[1].alias("n")).collect()
    for r in got:
        assert (r.t, r.n) == padding_by_hand(cases[r.i]), repr(cases[r.i])


def test_entries_at_one_place_stand_in_the_order_of_their_values(spark):
    from postmill import queries

    rows = [(1, 5, 3, i, v) for i in (0x3FFD, 0x0017) for v in (30, 10, 20)] + [(1, 5, 64, 0x0E06, v) for v in (7, 9, 8)]
    for order in (rows, rows[::-1]):
        got = queries.first_and_last(spark.createDataFrame(order, "file long, ord int, property_type int, property_id int, value long").coalesce(1)).first()
        assert (got.page_first, got.importance_last, got.delivery_last) == (10, 30, 9)


def test_checksum_of_numbers_whose_sum_is_no_64_bit_number(spark):
    from postmill.operators.structure import checksum

    for values in ([2**62, 2**62, 5], [2**63 - 1] * 3, [-(2**63)] * 3, [1, 2, -7], [-(2**63), -1]):
        want = (sum(values) + 2**63) % 2**64 - 2**63
        assert spark.createDataFrame([(v,) for v in values], "v long").agg(checksum(F.col("v"))).first()[0] == want


def test_texts_are_dealt_out_by_their_bytes(spark):
    """Few parts of many bytes become as many tasks as the bytes take, for functions that are expensive and for batches that go to Python."""
    rows = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    held = scratch.dealt(rows, F.col("text"), 100_000).groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("text"))).collect()
    assert len(held) == 41 and max(r[1] for r in held) <= 200_000 and sum(r[1] for r in held) == 4_000_000
    assert scratch.dealt(rows.limit(0), F.col("text")).count() == 0


def test_padded_texts_of_many_spaces_and_runs(spark):
    """Long runs of spaces, runs beside one another's lines and texts without any: as by hand."""
    pad = "\u200b" * 8
    cases = [" " * 20_000 + "a", ("a" + pad + "b\n") * 300, ("\n" + pad) * 300 + "\n\na\n\n", "\n \n" + pad + "\n\na\n" + pad + "\n\n\nb\n\n" + pad + "\n\n", "", " " + pad[:7] + " a"]
    got = column(spark, cases).orderBy("i").select(*texts.without_padding(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [padding_by_hand(c) for c in cases]


def test_recipients_are_ordered_in_parts_of_a_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(census, "parts", lambda df: 16)
    r = spark.range(4000).select((F.col("id") % 2000).alias("message_id"), (F.col("id") % 5).cast("int").alias("ord"), *(F.lit(1).cast("long").alias(c) for c in ("raw_type", "row_id")), *(F.lit("x").alias(c) for c in ("display_name", "address_type", "email_address", "smtp_address")), F.lit(True).alias("readable"))
    t = spark.range(2000).select(F.col("id").alias("message_id"), F.lit(True).alias("present"), F.array().cast("array<string>").alias("lacks"))
    assert census.as_read(r, t).select(F.spark_partition_id().alias("p")).distinct().count() == 16  # the session has 4
    assert census.row_order(r).collect()[0]["n"] == 2000


def test_extensions_and_legal_names_by_the_patterns_they_stand_for(spark, monkeypatch):
    odd = ["", ".", "..", "..a", ".a", "a.", "a.b", "a.b.c", "a.b c", "a. b", "a\n.b\n", "é.ü", "a.\U0001f600", *(f"a.{'x' * n}" for n in (15, 16, 17)), "a.\U0001f600" + "x" * 14, "a.\U0001f600" + "x" * 15]
    odd += [f"{a}{chr(c)}{b}" for c in range(1, 128) for a in ("", "a") for b in ("", "b")] + ["a" * 255, "a" * 256, "con", "Con .x", "a  b", "aux.txt", "com1", "com", "desktop.ini", " "]
    df = column(spark, odd)
    e = F.regexp_extract("v", r"(?s)^.+(\.[^. ]+)$", 1)
    assert df.where(names.extension(F.col("v")) != F.when(names.units(e) <= 17, e).otherwise("")).count() == 0
    quick = names.is_legal(F.col("v"))
    monkeypatch.setattr(names, "is_simple", lambda c: F.lit(False))
    assert df.where(quick != names.is_legal(F.col("v"))).count() == 0
    assert "CASE WHEN" in str(quick)  # simple names pass one pattern, not all

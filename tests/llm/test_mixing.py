import math

import pytest
from helpers import documents, odd_texts, words

from postmill.llm import mixing


def targets_by_hand(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Shares by weight; what is above a limit is shared again among the others until none is."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = dict.fromkeys(sizes, 0.0)
    left, open_ = share * sum(sizes.values()), set(sizes)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > most * sizes[s]}
        for s in full or open_:
            target[s] = most * sizes[s] if full else unit * weight[s]
        left -= sum(target[s] for s in full)
        if not full:
            break
        open_ -= full
    return target


def taken(spark, rows):
    return mixing.mix(spark.createDataFrame([(*r, None) for r in rows], "doc_id long, source string, size long, weight double, other string")).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 12])
def test_targets(spark, n):
    rows = [(i, None if i % n == n - 1 and n > 2 else f"s{i % n}", (i * 37) % 90 + (200 if i % n == 0 else 0), 1.0) for i in range(300)]
    sizes = {}
    for _, s, size, _ in rows:
        sizes[s] = sizes.get(s, 0) + size
    want = targets_by_hand(sizes)
    got = taken(spark, rows)
    by_id = {r[0]: r[1] for r in rows}
    total = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.target == pytest.approx(want[by_id[r.doc_id]]) and r.source_size == sizes[by_id[r.doc_id]]
        assert r.taken == r.copies * r.size <= 2 * r.size
        total[by_id[r.doc_id]] += r.taken
    for s in sizes:
        assert abs(total[s] - want[s]) <= 300


def test_selection_is_a_prefix_of_the_keys(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    rows = [(i, "a" if i < 400 else "b", i % 50, 2.0 if i % 3 else 0.5) for i in range(600)]
    got = {r.doc_id: r for r in taken(spark, rows)}
    import hashlib

    def key(i, w):
        u = (int(hashlib.md5(f"{i}:{mixing.SEED}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / w

    for source in "ab":
        mine = sorted((key(i, w), i, size) for i, s, size, w in rows if s == source)
        r = got[mine[0][1]]
        epochs = int(r.target // r.source_size)
        rest, before = r.target - epochs * r.source_size, 0
        for _, i, size in mine:
            extra = size > 0 and before + size / 2 <= rest
            assert got[i].copies == epochs + extra
            before += size


def test_many_equal_rows_are_taken_up_to_the_edge(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CLASS", 64)
    rows = [(None, "a", 10, 1.0)] * 1000 + [(7, "a", 3, 1.0)] * 500 + [(i, "b", 20, 1.0) for i in range(100, 200)]
    got = taken(spark, rows)
    assert len(got) == 1600
    for source, ids in (("a", {None, 7}), ("b", set(range(100, 200)))):
        mine = [r for r in got if r.doc_id in ids]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 10 and {r.copies for r in mine} <= {0, 1, 2}, source


def test_heavier_documents_come_more_often(spark):
    rows = [(i, f"s{i % 3}", 10, 2.0 if i % 2 else 0.5) for i in range(3000)]
    got = taken(spark, rows)
    assert sum(r.copies for r in got if r.doc_id % 2) > sum(r.copies for r in got if r.doc_id % 2 == 0)


def test_odd_tables_and_reruns(spark):
    df = documents(spark, [*odd_texts(), (7, "again and again")], {3: None})
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (8, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    one = mixing.mix(mixing.sized(df, labels))
    assert one.count() == df.count()
    assert sorted(map(str, one.collect())) == sorted(map(str, mixing.mix(mixing.sized(df.repartition(7), labels)).collect()))
    assert {r.doc_id: r.size for r in one.collect() if r.doc_id in (1, 2, 3, 6)} == {1: 0, 2: 0, 3: 0, 6: 60_000}
    assert mixing.mix(mixing.sized(df.limit(0), labels)).count() == 0


def test_query(spark, sf_dir):
    docs = {r.doc_id: (r.source, len(words(r.text))) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = mixing.op7_mixing(spark, sf_dir).collect()
    assert {r.doc_id: r.size for r in got} == {k: v[1] for k, v in docs.items()}

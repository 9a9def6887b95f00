import math
import re
from collections import Counter, defaultdict

import pytest
from helpers import documents, odd_texts

from postmill.llm import search

WORD = re.compile(search.TERM)


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=50):
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(words(t))
    out = []
    for item, ts in wanted.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in ts}
        found = []
        for doc, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * n_docs) // total
            score = sum(weight[t] * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in ts if t in b)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(found)[:top])]
    return sorted(out, key=lambda r: r[:2])


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, term string, rank int")


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


TEXTS = [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 5 + i % 9))) for i in range(300)]
MANY = TEXTS + [(1000 + i, "same words w1 w2 w2 same") for i in range(200)] + [(None, "w1 w2"), (None, "w1 w2"), (7, "w1 w2 W1, w1"), (8, None), (9, "-- !!")]
ITEMS = [(1, "w1 w2 same"), (2, "W3-w4 nothing"), (3, ""), (4, None), (5, "w1"), (5, "w6 w6"), (6, "words")]


@pytest.mark.parametrize(("block", "parts"), [(4, 3), (1000, 1), (1000, 5)])
def test_same_as_scoring_every_document(spark, block, parts):
    df = documents(spark, MANY).repartition(parts)
    assert found(search.search(df, items(spark, ITEMS), 50, block)) == brute(MANY, ITEMS)


def test_small_cells_and_small_top_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(search, "CELLS", 7)
    assert found(search.search(documents(spark, TEXTS[:60]), items(spark, ITEMS), 3)) == brute(TEXTS[:60], ITEMS, 3)


def test_odd_texts(spark):
    texts = odd_texts() + [(20, "ÀB àb x_y"), (21, "日本 日本")]
    its = [(1, "word3 x7 T5 one"), (2, "日本 É é ÀB à"), (3, "a" * 100_000), (4, "y X")]
    assert found(search.search(documents(spark, texts), items(spark, its))) == brute(texts, its)


def test_empty_tables(spark):
    docs, its = documents(spark, MANY), items(spark, ITEMS)
    assert search.search(docs.limit(0), its).count() == 0 and search.search(docs, its.limit(0)).count() == 0
    assert search.search(documents(spark, [(1, None), (2, "...")]), its).count() == 0


def test_weights_beyond_a_double_add_up_exactly():
    import numpy as np

    scorer = search.Scorer([[0, 1, 2]], np.array([2**40 + 1, 2**40 + 3, 2**40 + 7]))
    got = scorer.scores(np.zeros(3, dtype=np.int64), np.arange(3), np.full(3, 10**6), np.array([50]))
    gain = (10**9 * 10**6) // (1000 * 10**6 + 1000)
    assert int(got[0, 0]) == gain * (3 * 2**40 + 11)

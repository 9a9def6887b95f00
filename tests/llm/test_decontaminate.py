from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents, odd_texts, words

from postmill.llm import decontaminate as dc

SCHEMA = "item_id long, text string, doc_id long, similarity double"


def grams(w, n=5):
    n = min(n, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def by_hand(docs, items, threshold=0.8):
    """Best weighted similarity of any item-sized window, for pairs that reach the threshold."""
    index, out = defaultdict(set), {}
    for k, (_, t) in enumerate(items):
        w = words(t)
        for g in grams(w) if w else ():
            index[g].add(k)
    for d, text in docs:
        w = words(text)
        near = {k for n in range(1, 6) for i in range(len(w) - n + 1) for k in index.get(tuple(w[i : i + n]), ())}
        for k in near:
            item = words(items[k][1])
            size = min(len(item), len(w))
            n = min(5, len(item))
            best = 0
            for at in range(len(w) - size + 1):
                a, b = grams(w[at : at + size], n), grams(item, n)
                both = sum((a & b).values())
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= threshold:
                out[d, items[k][0]] = pytest.approx(best)
    return out


def hits(df, items, **how):
    return {(r.doc_id, r.item_id): r.similarity for r in dc.find_items(df, items, **how).collect()}


@pytest.mark.parametrize("block_words", [dc.BLOCK_WORDS, 40])  # in one scan, and by way of the filter
def test_windows_like_by_hand(spark, block_words):
    item = " ".join(f"i{k}" for k in range(40))
    other = " ".join(f"o{k % 9}" for k in range(30))
    docs = [*odd_texts(), (20, f"x y {item} z"), (21, item), (22, " ".join(item.split()[:-1])), (23, item.replace("i20 ", "") + " q"), (24, item.replace("i39", "zz")), (25, " ".join(item.split()[:12])), (26, f"{other} {other}"), (27, "yes no"), (28, "u yes no v"), (29, f"{item} {item.replace('i0 ', 'k ')}")]
    items = [(1, item), (2, other), (3, "yes no"), (4, ""), (5, None), (6, "one")]
    got = hits(documents(spark, docs), spark.createDataFrame([(i, t, 0, 0.0) for i, t in items], SCHEMA), block_words=block_words)
    assert got == by_hand(docs, items)


def test_empty_tables(spark):
    docs = documents(spark, odd_texts())
    items = spark.createDataFrame([(1, "a b c d e", 0, 0.0)], SCHEMA)
    assert hits(docs.limit(0), items) == {} and hits(docs, items.limit(0)) == {}


def test_index_finds_all_within_radius_and_little_else():
    rng = np.random.default_rng(1)
    w = [rng.integers(0, 2**63, 20).astype(np.uint64) for _ in range(300)]
    items = dc.Items(20, list(range(300)), w)
    prints = items.prints[np.arange(900) % 300].copy()
    for row in prints:
        for bit in rng.choice(dc.BITS, int(rng.integers(0, 48)), replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    got = set(zip(*(x.tolist() for x in items.within(prints)), strict=True))
    want = {(p, i, int(d)) for p in range(900) for i, d in enumerate(dc.distances(prints[p], items.prints)) if d <= dc.RADIUS}
    assert got == want
    looked_up = set()
    for block, (values, members) in zip(prints.view(np.uint16).reshape(-1, dc.BLOCKS).T, items.index, strict=True):
        key = (block[:, None] ^ dc.flips(dc.WINDOW_FLIPS)).ravel()
        for at in np.flatnonzero(np.isin(key, values)):
            looked_up |= {(at // len(dc.flips(dc.WINDOW_FLIPS)), i) for i in members[np.searchsorted(values, key[at], "left") : np.searchsorted(values, key[at], "right")]}
    assert len(looked_up) < 0.12 * 900 * 300  # about a tenth of the pairs of strangers


def test_windows_slide_like_summed_anew():
    rng = np.random.default_rng(2)
    words_ = rng.integers(0, 2**63, 9000).astype(np.uint64)
    for size in (1, 7, 6000):
        starts = np.unique(rng.integers(0, len(words_) - size + 1, 300))
        got = dc.window_fingerprints(words_, starts, size)
        assert all((got[k] == dc.fingerprints_of(dc.bit_votes(words_[s : s + size]).sum(axis=0)[None])[0]).all() for k, s in enumerate(starts))


def test_full_windows_like_counting():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, width = int(rng.integers(1, 60)), int(rng.integers(1, 20))
        place = np.flatnonzero(rng.random(n) < rng.random())
        windows, need = max(1, n - width + 1), int(rng.integers(1, width + 1))
        want = [s for s in range(windows) if ((place >= s) & (place < s + width)).sum() >= need]
        assert dc.full_windows(place, windows, width, need).tolist() == want


@pytest.mark.parametrize("size", [13, 22, 40, 67, 100, 300])
def test_recall_of_the_hardest_windows(size):
    """A ninth of the shingles lost at an end leaves similarity 0.8 and the least likeness of words."""
    rng = np.random.default_rng(size)
    near = []
    for _ in range(2000):
        w = rng.integers(0, 2**63, size).astype(np.uint64)
        other = w.copy()
        lost = (size - 4) // 9
        other[-lost:] = rng.integers(0, 2**63, lost)
        near.append(dc.distances(*(dc.fingerprints_of(dc.summed_votes(x)[None]) for x in (w, other)))[0] <= dc.RADIUS)
    assert np.mean(near) >= dc.RECALL


def test_passages_overwritten_at_an_end(spark):
    rng = np.random.default_rng(7)
    items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(15, 300))))) for k in range(150)]
    docs = []
    for k, text in items:
        w = text.split()
        n = max(1, len(w) // 10)
        docs += [(10 * k, " ".join([*(f"a{x}" for x in rng.integers(0, 5000, n)), *w[n:]])), (10 * k + 1, " ".join([*w[:-n], *(f"b{x}" for x in rng.integers(0, 5000, n))]))]
    table = spark.createDataFrame([(i, t, 0, 0.0) for i, t in items], SCHEMA)
    found, want = hits(documents(spark, docs), table), by_hand(docs, items)
    assert all(want[k] == s for k, s in found.items()) and len(found) >= dc.RECALL * len(want)
    assert hits(documents(spark, docs), table, block_words=5000) == found


def test_long_repetitive_texts_and_items(spark):
    item = " ".join(f"r{k % 50}" for k in range(3000))
    docs = [(1, " ".join(f"r{k % 50}" for k in range(60_000))), (2, "x " + item.replace("r7 ", "q ", 3) + " y"), (3, " ".join(f"s{k % 50}" for k in range(60_000)))]
    got = hits(documents(spark, docs), spark.createDataFrame([(1, item, 0, 0.0), (2, "r1 r2 r3", 0, 0.0)], SCHEMA))
    assert set(got) == {(1, 1), (2, 1), (1, 2), (2, 2)} and got[1, 1] == 1.0 and got[2, 1] > 0.97


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.op6_decontamination(spark, sf_dir).collect()}
    assert got == by_hand(docs, items)  # none of these lies beyond the radius

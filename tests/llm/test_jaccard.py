import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from helpers import documents, odd_texts, shingle_set

from postmill.llm import jaccard


def by_hand(texts, threshold=0.8):
    """(class_id, n_links) of every document by comparing all pairs of sets."""
    sets = {i: shingle_set(t) for i, t in texts if i is not None}
    parent, links = {i: i for i in sets}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] == frozenset() or sets[a] and sets[b] and both / (len(sets[a]) + len(sets[b]) - both) >= threshold - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (root(i), links[i]) for i in sets}


def edited(base, rng, n):
    w = base.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.random()}"
    return " ".join(w)


def corpus(seed):
    rng = random.Random(seed)
    texts = odd_texts()[:11]
    for g in range(6):
        base = " ".join(f"g{g}w{rng.randrange(400)}" for _ in range(rng.randrange(60, 300)))
        texts += [(100 * (g + 1) + k, edited(base, rng, k)) for k in range(8)]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_groups_are_those_of_all_pairs(spark, seed):
    texts = corpus(seed)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join_similar(documents(spark, texts)).collect()}
    assert got == by_hand(texts)


@pytest.mark.parametrize("most", [2, 5, 9])  # edits of a member: near the pivot, some far from it, many far
def test_large_groups_are_dealt_to_blocks(spark, most):
    rng = random.Random(5)
    base = " ".join(f"w{i}" for i in range(200))
    texts = [(i, edited(base, rng, i % most)) for i in range(60)] + [(i, base) for i in range(100, 140)] + [(i, edited(texts_of(base, i), rng, i % 3)) for i in range(200, 230)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join_similar(documents(spark, texts), block=8).collect()}
    assert got == by_hand(texts)


def texts_of(base, i):
    """A text that some links lead to from base, though it isn't like it."""
    w = base.split()
    return " ".join([*w[: 200 - (i - 200)], *(f"z{k}" for k in range(i - 200))])


def test_few_rows_travel_for_a_large_group_of_near_copies(spark):
    """Members of a cluster that lie near its smallest are compared with it and nothing else."""
    rng = random.Random(6)
    base = " ".join(f"w{i}" for i in range(400))
    df = documents(spark, [(i, edited(base, rng, 1 + i % 3)) for i in range(400)])
    keyed, reps = jaccard.classes(df.select("doc_id", "text"))
    signed = jaccard.sign(df, reps).cache()
    clusters = jaccard.components(jaccard.candidate_edges(signed, 0.8, 8))
    members = jaccard.differences(df, clusters, reps, 0.8, 8).cache()
    assert members.count() == 400 and members.where("far").count() == 0
    assert jaccard.far_and_all(members.select("root", "rep", "far"), "root", 8).count() == 0


def test_repeated_rows_and_empty_tables(spark):
    df = documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])
    assert sorted(map(tuple, jaccard.join_similar(df).collect())) == [(1, 1, 1), (2, 1, 1)]
    assert jaccard.join_similar(df.limit(0)).count() == 0


@pytest.mark.parametrize("other", ["", "quite other words that stand in a row of the same id"])
def test_repeated_rows_beside_a_near_copy(spark, other):
    base = " ".join(f"w{i}" for i in range(120))
    near, far = base.replace("w60 ", "x "), " ".join(f"v{i}" for i in range(50))
    df = documents(spark, [(1, base)] * 9 + [(2, near), (3, base), (4, far), (4, far)] + [(5, other), (5, other)])
    got = sorted(map(tuple, jaccard.join_similar(df).collect()))
    assert got == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 4, 0), (5, 5, 0)]


def test_rows_of_one_id_with_different_texts_count_by_one_of_them(spark):
    base = " ".join(f"w{i}" for i in range(120))
    near, far = base.replace("w60 ", "x "), " ".join(f"v{i}" for i in range(50))
    rows = documents(spark, [(1, base), (1, far), (2, near), (3, far.replace("v20 ", "y "))])
    chosen = {r.doc_id: r.text for r in jaccard.once(rows, jaccard.classes(rows)[0]).collect()}
    texts = sorted(chosen.items())
    assert len(texts) == 3 and chosen[1] in (base, far)
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join_similar(rows).collect()} == by_hand(texts)


def test_pruning_keeps_similar_pairs():
    """Posterior pruning: what is dropped at similarity 0.8 and above stays below the tolerance's order."""
    rng = np.random.default_rng(3)
    kept = 0
    for _ in range(2000):
        same = rng.random(jaccard.BANDS * jaccard.ROWS) < 0.82
        left = rng.integers(0, 256, (1, len(same)), dtype=np.uint8)
        right = np.where(same, left, rng.integers(0, 256, left.shape, dtype=np.uint8)).astype(np.uint8)
        kept += bool(jaccard.surviving(left, right, 0.8)[0, 0])
    assert kept >= 1998
    far = jaccard.surviving(rng.integers(0, 256, (50, 160), dtype=np.uint8), rng.integers(0, 256, (50, 160), dtype=np.uint8), 0.8)
    assert not far.any()


def test_query(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.op5_jaccard_join(spark, sf_dir).collect()}
    assert got == by_hand(texts)

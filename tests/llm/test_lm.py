import math
from collections import Counter

import pytest
from helpers import documents, odd_texts, words
from pyspark.sql import functions as F

from postmill.llm import lm
from postmill.llm.common import words as spark_words


def by_hand(texts, target, vocabulary, alpha=lm.ALPHA):
    def counts(text):
        w = words(text)
        h = ["\0", *w[:-1]] if w else []
        return Counter(h), Counter(zip(h, w, strict=True))

    models = [(Counter(), Counter()), (Counter(), Counter())]
    for i, t in texts:
        for m in models[: 1 + (i is not None and i in target)]:
            for total, own in zip(m, counts(t), strict=True):
                total.update(own)
    out = []
    for i, t in texts:
        n = len(words(t))
        one, two = counts(t)
        losses = []
        for (c1, c2), mine in zip(models, (1, i is not None and i in target), strict=True):
            losses.append((sum(k * math.log(c1[x] - k * mine + alpha * vocabulary) for x, k in one.items()) - sum(k * math.log(c2[x] - k * mine + alpha) for x, k in two.items())) / n if n else None)
        out.append((i, n, losses[1], losses[0]))
    return out


@pytest.mark.parametrize("chunk,bucket,heavy", [(10**9, 10**9, 1000), (400, 300, 1), (50_000, 900, 1000), (60_000, 40_000, 1)])
def test_losses_like_by_hand(spark, chunk, bucket, heavy):
    texts = [t for t in odd_texts() if t[0] != 6 or chunk > 50_000] + [(9, "one id of many rows")] * 5 + [(None, "and none")] * 4 + [(20 + i, " ".join(f"w{(i * j) % 17}" for j in range(1, 40))) for i in range(30)] + [(21, "again w1 w2")]
    df = documents(spark, texts)
    target = {7, 21, 22, 23, 24, 99}
    vocabulary = df.select(F.explode(spark_words(F.col("text"))).alias("w")).agg(F.count_distinct("w")).first()[0]
    got = lm.cross_entropy_difference(df, spark.createDataFrame([(i,) for i in target] + [(None,), (7,)], "doc_id long"), chunk_chars=chunk, bucket_chars=bucket, heavy=heavy).collect()
    key = lambda r: (str(r[0]), r[1], r[2] or 0)
    for r, (i, n, t, b) in zip(sorted(got, key=key), sorted(by_hand(texts, target, vocabulary), key=key), strict=True):
        assert (r.doc_id, r.n_words) == (i, n)
        assert (r.target_loss, r.background_loss) == ((None, None) if t is None else (pytest.approx(t), pytest.approx(b)))
        assert r.score == (None if t is None else pytest.approx(t - b, abs=1e-9))


def test_no_target_and_no_documents(spark):
    df = documents(spark, [(1, "a b c"), (2, "a b")])
    none = spark.createDataFrame([], "doc_id long")
    assert all(r.target_loss == pytest.approx(math.log(3)) for r in lm.cross_entropy_difference(df, none).collect())
    assert lm.cross_entropy_difference(df.limit(0), none).count() == 0


def test_documents_like_the_target_score_lower(spark):
    import random

    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice(("red blue green one two" if i % 2 else "cat dog cow three four").split()) for _ in range(60))) for i in range(120)]
    target = spark.createDataFrame([(i,) for i in range(1, 40, 2)], "doc_id long")
    got = {r.doc_id: r.score for r in lm.cross_entropy_difference(documents(spark, texts), target).collect()}
    assert max(got[i] for i in range(41, 120, 2)) < min(got[i] for i in range(40, 120, 2))

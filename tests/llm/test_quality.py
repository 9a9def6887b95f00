import random
import zlib

import numpy as np
from helpers import documents, odd_texts

from postmill.llm import quality


def labelled(n, seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [rng.choice(vocabulary) + ("$$$" if bad and rng.random() < 0.5 else "") for _ in range(rng.randrange(30, 200))]
        texts.append((i, " ".join(w)))
        labels.append((i, int(not bad)))
    return texts, labels


def test_scores_tell_labels_apart_on_rows_not_learnt_from(spark):
    texts, labels = labelled(900)
    df = documents(spark, texts)
    scored = {r.doc_id: r for r in quality.score(df, quality.fit(df, spark.createDataFrame(labels, "doc_id long, label int"))).collect()}
    held = [(scored[i].score, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    good, bad = np.array([s for s, y in held if y]), np.array([s for s, y in held if not y])
    assert (good[:, None] > bad).mean() > 0.98
    assert np.mean([(s - y) ** 2 for s, y in held]) < 0.05  # calibrated
    assert all(0 <= s <= 1 for s, _ in held) and "rank" in df.columns and scored[0].rank == 1


def test_held_out_labels_change_nothing(spark):
    texts, labels = labelled(300)
    df = documents(spark, texts)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (quality.fit(df, spark.createDataFrame(x, "doc_id long, label int")) for x in (labels, flipped))
    x = a[0].pooled([t for _, t in texts[:20]])
    assert np.array_equal(a[1].probability(x), b[1].probability(b[0].pooled([t for _, t in texts[:20]])))


def test_odd_tables(spark):
    df = documents(spark, odd_texts())
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in quality.score(df, quality.fit(df, none)).collect()} == {quality.PRIOR}
    texts, labels = labelled(200)
    model = quality.fit(documents(spark, texts), spark.createDataFrame([*labels, (None, 1), (1, None), (1, 1)], "doc_id long, label int"))
    scored = quality.score(df, model)
    assert scored.count() == df.count() and quality.score(df.limit(0), model).count() == 0
    rows = {r.doc_id: r.score for r in scored.collect()}
    assert rows[1] == rows[2] == rows[3]


def test_repeats_and_index_vectors():
    assert quality.repeats(["a", "b", "a", "c", "c", "d", "e", "f", "g", "a"]).tolist() == [False, False, True, False, True, False, False, False, False, False]
    v = quality.index_vectors(["x", "y", "x"], 64)
    assert np.array_equal(v[0], v[2]) and not np.array_equal(v[0], v[1]) and np.abs(v).sum(axis=1).max() <= quality.NONZERO


def test_query(spark, sf_dir):
    rows = quality.op9_quality(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)


def forward_by_hand(model, text):
    """The score of one text, token by token and neuron by neuron."""
    vectors, net = model
    words = quality.TOKEN.findall(text or "")
    rows = []
    for i, w in enumerate(words):
        known = quality.REPEAT if w in words[max(0, i - quality.NEAR) : i] else w if w in vectors.places else quality.shape(w)
        rows.append(vectors.rows[vectors.places[known]].astype(float))
    usual, n = vectors.usual.astype(float), len(words)

    def mean(part):
        return (sum(part, np.zeros_like(usual)) + quality.SMOOTH * usual) / (len(part) + quality.SMOOTH)

    thirds = [rows[n * k // 3 : n * (k + 1) // 3] for k in range(3)]
    x = np.concatenate([mean(rows), *map(mean, thirds)]) if n else np.tile(usual, 4)
    z = [(a - m) / s for a, m, s in zip(x, net.mean, net.scale, strict=True)]
    hidden = [np.tanh(sum(a * w for a, w in zip(z, net.w1[:, j], strict=True)) + net.b1[j]) for j in range(len(net.b1))]
    logit = sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2
    return 1 / (1 + np.exp(-logit / net.temperature))


def test_scores_of_the_given_table(spark):
    """Held-out labels are told apart well, and scores are those of a forward pass written out."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    label_table = quality.quality_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = quality.fit(docs, label_table)
    scored = {r.doc_id: r for r in quality.score(docs, model).collect()}
    for i in sorted(scored)[::40]:
        assert abs(forward_by_hand(model, scored[i].text) - scored[i].score) < 1e-4, i
    held = [(scored[r.doc_id].score, r.label) for r in label_table.collect() if r.doc_id in scored and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good, bad = np.array([s for s, y in held if y]), np.array([s for s, y in held if not y])
    assert len(good) > 20 and len(bad) > 5 and (good[:, None] > bad).mean() > 0.95


def test_a_very_long_text(spark):
    """Longer than a row that may be fitted on: it is scored whole, and fits nothing."""
    texts, labels = labelled(200)
    long = " ".join(t for _, t in texts) * 12
    df = documents(spark, [*texts, (1000, long), (1001, long + " tail")])
    model = quality.fit(df, spark.createDataFrame([*labels, (1000, 0), (1001, 0)], "doc_id long, label int"), chars=1_000_000)
    scores = {r.doc_id: r.score for r in quality.score(df.where("doc_id >= 1000"), model).collect()}
    assert len(long) > 1_000_000 and abs(scores[1000] - forward_by_hand(model, long)) < 1e-3 and abs(scores[1000] - scores[1001]) < 0.01

from collections import Counter

import pytest
from helpers import shingle_set

import corpus_pipeline
from postmill.llm import decontaminate, quality
from postmill.llm.common import table


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and result of each stage, written and read again in between."""
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_hand_on_documents(spark, stages, sf_dir):
    assert [s[0] for s in stages] == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]
    columns = table(spark, sf_dir, "documents").columns
    for _, before, after in stages[:-1]:
        assert sorted(after.columns) == sorted(columns)
        was = {r.doc_id: r for r in before.collect()}
        assert all(tuple(r[c] for c in columns) == tuple(was[r.doc_id][c] for c in columns) for r in after.collect())


def test_quality_keeps_what_scores_enough(spark, stages, sf_dir):
    _, before, after = stages[0]
    scored = quality.score(before, quality.fit(before, quality.quality_labels(table(spark, sf_dir, "labels")))).collect()
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scored if r.score >= 0.3}


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    sets = {r.doc_id: shingle_set(r.text) for r in before.collect()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in after.collect()) == sorted({root(i) for i in ids})


def test_contaminated_documents_go(spark, stages, sf_dir):
    _, before, after = stages[2]
    hit = {r.doc_id for r in decontaminate.find_items(before, table(spark, sf_dir, "benchmark")).collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - hit


def test_mixture_and_shards(stages):
    _, before, after = stages[3]
    assert set(Counter(r.doc_id for r in after.collect()).values()) <= {1, 2}
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    _, mixed, shards = stages[4]
    per = Counter(r.shard for r in shards.collect())
    assert sum(per.values()) == mixed.count() and max(per.values()) - min(per[s] for s in range(16)) <= 1


def test_stages_take_odd_tables(spark, sf_dir):
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (2, "", "en", "s", 0, "x"), (None, "no id", "en", None, 5, "x"), (3, "plain words of some length here", "en", "s", 31, "x")]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string"), spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        assert docs.count() >= 0


def test_run(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages[-1][2].count()

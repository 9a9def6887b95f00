"""From raw documents to shards: each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, whole.

1. quality: documents that the classifier scores below its threshold go.
2. near_duplicates: of each group of documents linked by similarity one stays, the one of the smallest doc_id.
3. decontaminate: documents with a passage of the benchmark go.
4. mix: documents are taken as often as the mixture asks for, so a document may come twice, or not at all.
5. shard: documents are placed in shards.

Defined results: rows without doc_id pass the second stage as they are, since no group could name them; of rows of one
doc_id one stays there, the smallest; in the mixture rows of one doc_id are taken equally often. Null and empty texts score
as the classifier scores no words, and are copies of one another. The columns of documents pass through unchanged, others
are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import decontaminate, jaccard, mixing, quality, sharding
from postmill.llm.common import stash, table

#: Most ids (a number each) that are broadcast.
BROADCAST_IDS = 1_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of documents at hand; without usable labels every document scores PRIOR and stays."""
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, quality.quality_labels(table(spark, sf_dir, "labels")))
    return quality.score(docs, model).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    kept = without(docs, jaccard.join_similar(docs).where("doc_id <> class_id").select("doc_id"))
    if repeats(docs):
        named = kept.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
        kept = named.union(kept.where("doc_id is null"))
    return kept


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for those of some ids (one row an id). Where these are BROADCAST_IDS at most, no text is shuffled for it."""
    gone = stash(gone, "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*COLUMNS)


def repeats(docs: DataFrame) -> bool:
    """Whether a doc_id occurs more than once."""
    return not docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty()


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs.select(*COLUMNS), decontaminate.find_items(docs, table(spark, sf_dir, "benchmark")).where("doc_id is not null").select("doc_id").distinct())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.mix(mixing.sized(docs, table(spark, sf_dir, "labels"))).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    many = docs.select(*COLUMNS).join(taken.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")))
    return many.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign(docs)


STAGES = [("quality", classify), ("near_duplicates", deduplicate), ("decontaminate", clean), ("mix", mix), ("shard", shard)]
#: A trained classifier and hashed candidates can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared scratch folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stash(docs, f"pipeline-{name}")
    return docs

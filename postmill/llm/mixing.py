"""Mixing sources to target weights: Efraimidis-Spirakis sampling within each source, DataFrame expressions only.

Targets: the sources in code point order (null last) have weights that repeat; they share a budget by weight, none above
`most` times its size. The shares are the level of a water filling: with the sources sorted by limit over weight, the
level after filling the first k is (budget - their limits) / (weights of the rest), and the first level that its source
can hold is the one that stands.

Sampling: whole epochs of a source come first. For the rest each document draws u from a hash of its doc_id (of its text, where it
has no id) and gets the key -ln(u) / weight; in order of keys, documents are taken until the budget in words is met, the
document at the edge if more than half of it fits. Rows that agree in source, key, id and size are one class, counted before
anything is ordered. Keys are dealt to buckets of about BUCKET documents, so that running sums need one task for a bucket only; a
source's buckets are summed apart. Rows of a class are alike, so what comes out is a class's
row as often as it stands there, with the copies that its places in the order give.

Defined results: a null text has size 0; documents of size 0 are never more than their epochs; a null source is a source of
its own; a missing or non-positive weight counts as 1; repeated rows are documents of their own with equal keys (which of
two equal rows comes first can't be told, and doesn't matter); columns beyond those named are ignored; empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.llm.common import WORD, table

#: Weights of the sources in turn. Fixed values of the query.
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BUCKET = 1024
#: Rows of a class that one row stands for at most when the class is written out.
CLASS = 10_000
SEED = "mix-1"
#: Weight of a document by its quality label, and without one.
LIKED, DISLIKED, UNKNOWN = 2.0, 0.5, 1.0


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, size) to (source, source_size, source_rows, target): one row per source; the windows see one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    ranked = per.withColumn("rank", rank).withColumn("w", weight).withColumn("limit", (F.col("source_size") * most).cast("double"))
    ranked = ranked.withColumn("ratio", F.col("limit") / F.col("w"))
    upto = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy("ratio", "rank").rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / F.sum("w").over(rest)
    levels = ranked.withColumn("level", level)
    stands = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"]
    return levels.select("source", "source_size", "source_rows", F.least("limit", stands * F.col("w")).alias("target"))


def uniform(doc_id: Column, other: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the MD5 of the id and the seed; rows without an id go by another text."""
    h = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), other, F.lit("")), F.lit(seed)).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)


def mix(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """(doc_id, source, size long, weight double, and other, a text that tells rows without doc_id apart) to (doc_id, size,
    source_size, target, copies, taken): how often each document is taken, and the words that makes."""
    goal = targets(docs, **how).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "of")
    key = -F.ln(uniform(F.col("doc_id"), F.col("other"), seed)) / F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    rows = docs.select("doc_id", "source", "size", key.alias("key"))
    classes = rows.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("n")).join(goal, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    buckets = F.ceil(F.col("source_rows") / BUCKET)
    classes = classes.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * buckets), buckets - 1)).withColumn("words", F.col("size") * F.col("n"))
    sums = classes.groupBy("source", "bucket").agg(F.sum("words").alias("in_bucket"))
    before = F.coalesce(F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col("source").alias("of"), F.col("bucket").alias("b"), before.alias("offset"))
    inside = F.sum("words").over(W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    classes = classes.withColumn("start", inside - F.col("words")).join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("b")))
    at = F.col("offset") + F.col("start")
    fits = lambda k: (at + k * F.col("size")) * 2 - F.col("size") <= F.col("rest") * 2  # noqa: E731  whether the k-th of a class is taken
    near = F.floor((F.col("rest") - at) / F.col("size") + 0.5).cast("long")  # rounding may be one off
    many = F.when(fits(near + 1), near + 1).when(fits(near), near).otherwise(near - 1)
    extra = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("n"), many))).otherwise(0)
    classes = classes.select("source", "key", "doc_id", "size", "source_size", "target", "epochs", "n", extra.cast("long").alias("extra"))
    large = classes.where(F.col("n") > CLASS).withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(CLASS).cast("long"))))
    parts = classes.where(F.col("n") <= CLASS).withColumn("from", F.lit(1).cast("long")).unionByName(large.repartition("source", "key", "doc_id", "size", "from"))
    each = parts.withColumn("nth", F.explode(F.sequence("from", F.least(F.col("n"), F.col("from") + (CLASS - 1)))))
    copies = (F.col("epochs") + (F.col("nth") <= F.col("extra")).cast("int")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def sized(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, size, weight, other) of documents, with weights by their quality labels (doc_id, quality)."""
    liked = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumnRenamed("doc_id", "labelled")
    other = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), other.alias("other"))
    weight = F.when(F.col("quality") == 1, LIKED).when(F.col("quality") == 0, DISLIKED).otherwise(UNKNOWN)
    return sizes.join(liked, F.col("doc_id") == F.col("labelled"), "left").select("doc_id", "source", "size", weight.alias("weight"), "other")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP7_SQL = r"""
WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, md5(coalesce(d.text, ''))) || ':mix-1'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
      / CASE WHEN quality = 1 THEN 2.0::DOUBLE WHEN quality = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, (source_size * 2)::DOUBLE AS cap FROM s),
v AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, w * (SELECT level FROM v WHERE level <= cap / w ORDER BY cap / w, rank LIMIT 1)) AS target FROM v),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
r AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size AS rest,
  (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, epochs + CASE WHEN size > 0 AND upto * 2 - size <= rest * 2 THEN 1 ELSE 0 END AS copies FROM r)
SELECT doc_id, size, source_size, target, copies::BIGINT AS copies, (size * copies)::BIGINT AS taken FROM c
"""

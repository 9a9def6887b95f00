r"""Document fingerprints from closed syncmers, with DataFrame expressions only.

A text is cut into tokens, each with a 64-bit hash: runs of non-space characters, those of more than RUN characters (Chinese,
Japanese, Thai, base64, minified text) into pieces by their content: a piece ends after a character whose hash together with the next
one's is lower than that of its neighbours. A window of K tokens is an anchor when the smallest of its token hashes (the inner
substrings, one token long) stands at its first or last place. Whether a window is an anchor depends on its own tokens alone,
where a piece ends on four characters, so an edit changes only the anchors it touches, at least one of any K - 1 windows in a row
is one, and equal passages have equal anchors wherever they stand, but for a piece at either end. A run of one character repeated
has no such places and is one token. What an edit makes a run longer or shorter than RUN is cut anew as a whole.
The fingerprint lists the anchors in order as position:hash (tokens, 8 hex digits), so that matches can be aligned.
Likeness is the share of common anchor hashes: twice the common ones over the distinct ones of both.

Defined results: a null text counts as empty and has an empty fingerprint; a text of fewer than K tokens has one anchor,
all of it; two empty fingerprints are alike (1), an empty and another are not (0); rows of equal doc_id are ordered by
text, rows without doc_id come last; columns other than doc_id and text are ignored; empty in, empty out.
"""

from __future__ import annotations

import json
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.llm.common import table

K = 5
#: Most characters of a run that is one token whatever its content.
RUN = 32
TOKEN = r"[^\x20\x09-\x0D]+"
#: Documents of a stretch of ids, which is ordered in one task, and most stretches (their bounds are a literal of the plan).
STRETCH, MOST_STRETCHES = 500, 10_000
LOW = 0xFFFFFFFF


def let(value: Column, then) -> Column:
    """then(value), value being worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def piece_hashes(run: Column) -> Column:
    """Hashes of the pieces of a run, cut where the hash of two characters is a local minimum."""

    def pieces(chars, pairs):
        inner = F.filter(F.sequence(F.lit(1), F.size(pairs) - 2), lambda i: (F.get(pairs, i) < F.get(pairs, i - 1)) & (F.get(pairs, i) < F.get(pairs, i + 1)))
        starts = F.concat(F.array(F.lit(0)), F.transform(inner, lambda i: i + 1))
        end = lambda s, k: F.coalesce(F.get(s, k + 1), F.size(chars))
        return let(starts, lambda s: F.transform(s, lambda at, k: F.xxhash64(F.slice(chars, at + 1, end(s, k) - at))))

    pair = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.xxhash64(F.get(c, i), F.get(c, i + 1)))
    return let(F.regexp_extract_all(run, F.lit("(?s)."), F.lit(0)), lambda c: let(pair(c), lambda p: pieces(c, p)))


def token_hashes(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    long_too = F.flatten(F.transform(runs, lambda t: F.when(F.char_length(t) <= RUN, F.array(F.xxhash64(t))).otherwise(piece_hashes(t))))
    return F.when(F.rlike(text, F.lit(rf"[^\x20\x09-\x0D]{{{RUN + 1}}}")), long_too).otherwise(F.transform(runs, lambda t: F.xxhash64(t)))


def anchors(hashes: Column, k: int = K) -> Column:
    """Array of anchors, position * 2^32 + 32 bits of hash, of an array of token hashes."""

    def is_anchor(i):
        first, last = F.get(hashes, i), F.get(hashes, i + (k - 1))
        inner = F.least(*(F.get(hashes, i + j) for j in range(1, k - 1)))
        return F.least(first, last) <= inner

    def code(i):
        return F.shiftleft(i.cast("long"), 32) + F.xxhash64(*(F.get(hashes, i + j) for j in range(k))).bitwiseAND(F.lit(LOW))

    many = F.transform(F.filter(F.sequence(F.lit(0), F.size(hashes) - k), is_anchor), code)
    few = F.array(F.xxhash64(hashes).bitwiseAND(F.lit(LOW)))
    return F.when(F.size(hashes) >= k, many).when(F.size(hashes) > 0, few).otherwise(F.array().cast("array<bigint>"))


def written(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.concat(F.shiftright(c, 32).cast("string"), F.lit(":"), F.lower(F.lpad(F.hex(c.bitwiseAND(F.lit(LOW))), 8, "0")))), " ")


def hash_set(codes: Column) -> Column:
    return F.array_distinct(F.transform(codes, lambda c: c.bitwiseAND(F.lit(LOW))))


def likeness(a: Column, b: Column) -> Column:
    """Of two sets of anchor hashes."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def fingerprints(df: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, text) to (doc_id, fingerprint)."""
    hashed = df.select("doc_id", token_hashes(F.coalesce(F.col("text"), F.lit(""))).alias("hashes"))
    return hashed.select("doc_id", written(anchors(F.col("hashes"), k)).alias("fingerprint"))


def stretches(docs: DataFrame) -> Column:
    """An expression that gives each doc_id the number of its stretch: a stretch holds about STRETCH rows, all of lower ids than
    the next. Its bounds are quantiles of the ids, MOST_STRETCHES at most; the lookup goes over their square root twice."""
    n = docs.count()
    many = min(MOST_STRETCHES, -(-n // STRETCH))
    if many < 2:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    bounds = docs.agg(F.percentile_approx("doc_id", [i / many for i in range(1, many)], 10 * MOST_STRETCHES)).first()[0] or []
    bounds = sorted(set(bounds))
    width = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    firsts = F.from_json(F.lit(json.dumps([r[0] for r in rows])), "array<bigint>")
    grid = F.from_json(F.lit(json.dumps(rows)), "array<array<bigint>>")
    row = F.size(F.filter(firsts, lambda b: b <= F.col("doc_id")))
    inside = F.size(F.filter(F.get(grid, row - 1), lambda b: b <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), -1).when(row == 0, 0).otherwise((row - 1) * width + inside)


def with_codes(docs: DataFrame) -> DataFrame:
    """Adds codes, the anchors of the text. The hashes are a column first, which the anchors look into again and again."""
    return docs.withColumn("hashes", token_hashes(F.col("text"))).withColumn("codes", anchors(F.col("hashes"))).drop("hashes")


def with_next(docs: DataFrame) -> DataFrame:
    """Each document (doc_id, text) with its codes, and text and codes of the next by descending doc_id, as next_*; after the last
    comes the first. Codes are made once for a text, before texts are put in order.

    Documents are dealt to stretches of ids, and each stretch gets a copy of the first document of the stretch that follows,
    so every stretch is complete by itself. The driver sees one id for each stretch."""
    spark = docs.sparkSession
    docs = docs.withColumn("stretch", stretches(docs))
    tops = sorted(((r.stretch, r.top) for r in docs.groupBy("stretch").agg(F.max("doc_id").alias("top")).collect()), reverse=True)
    follows = [{"at": a[0], "top": b[1]} for a, b in pairwise([*tops, *tops[:1]])]
    heads = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(follows)), "array<struct<at: int, top: bigint>>")).alias("h")).select("h.*")
    copies = docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("at").agg(F.min("text").alias("text"))
    rows = docs.select("stretch", F.lit(0).alias("copy"), "doc_id", "text").union(copies.select("at", F.lit(1), F.lit(None).cast("long"), "text"))
    rows = with_codes(rows.repartition("stretch"))
    order = W.partitionBy("stretch").orderBy("copy", F.col("doc_id").desc_nulls_last(), "text")
    after = (F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "codes"))
    return rows.select("copy", "doc_id", "text", "codes", *after).where("copy = 0").drop("copy")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_next(docs)
    n = F.char_length("text")
    kept = n - F.floor(n / 2).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), kept), F.substr(F.col("next_text"), F.lit(1), n - kept))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "codes", "next_codes", edited.alias("edited"))
    rows = rows.select("*", token_hashes(F.col("edited")).alias("edited_hashes"))
    rows = rows.select("doc_id", "n_chars", "edited", "codes", "next_codes", anchors(F.col("edited_hashes")).alias("edited_codes"))
    rows = rows.select("doc_id", "n_chars", "edited", "codes", "edited_codes", *(hash_set(F.col(f"{p}codes")).alias(f"{p}set") for p in ("", "edited_", "next_")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        written(F.col("codes")).alias("fingerprint"),
        written(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("set"), F.col("edited_set")).alias("near_edited"),
        likeness(F.col("set"), F.col("next_set")).alias("near_next"),
    )

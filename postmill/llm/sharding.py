"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has VNODES positions on a ring of 64-bit hashes. A key belongs to the first virtual node clockwise from its own
hash; when that shard is full, the key continues clockwise to the next virtual node whose shard has room. With `slack` 0
the bounds are the counts themselves (the floor or the ceiling of rows / shards), so loads differ by one row at most.

Only counts by arc (the stretch of ring before a virtual node: shards x VNODES numbers, however many rows there are) reach
the driver, which fills the shards arc by arc: rows of an arc that fit stay, then the rest of each arc continues clockwise. The
plan comes back as (arc, from rank, to rank, shard, first slot), again bounded, and a join by arc gives every row its shard and
slot. Texts are read once, for a narrow table of the rows' hashes in which equal rows are one class with a count.

A row's rank in its arc is its place by hash (then by doc_id, checksum, size), so it follows from the rows alone, however they are
read. It is counted in lanes, stretches of the range of hashes of LANE rows or so, whose sums are put in a row; a class of more
than LANE rows is expanded in pieces of as many.

Defined results: a null text counts as empty; rows are placed by a hash of doc_id, text checksum and size, so rows without
doc_id are spread as well; repeated rows get slots of their own; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.llm.common import mix, stash, table

SHARDS = 16
VNODES = 128
#: Rows of a lane: how much of an arc is ranked, and of a class expanded, in one task.
LANE = 50_000
PLAN = "arc int, low long, high long, shard int, first_slot long"


def ring(shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the virtual nodes in order, and their shards. A shard's positions don't depend on how many shards there are."""
    shard = np.repeat(np.arange(shards, dtype=np.uint64), vnodes)
    position = mix(mix(shard + np.uint64(1)) + np.tile(np.arange(vnodes, dtype=np.uint64), shards)).view(np.int64)
    order = np.argsort(position, kind="stable")
    return position[order], shard[order].astype(int)


def bounds(total: int, shards: int, slack: float) -> list[int]:
    """Most rows a shard may hold."""
    if slack == 0:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [int(np.ceil(total / shards * (1 + slack)))] * shards


def fill(counts: dict[int, int], shards: int, vnodes: int = VNODES, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """The plan (arc, low, high, shard, first slot) for rows counted by arc: ranks low (inclusive) to high go to the shard."""
    owners = ring(shards, vnodes)[1].tolist()
    room = bounds(sum(counts.values()), shards, slack)
    used = [0] * shards
    plan, over = [], []

    def put(arc: int, low: int, high: int, shard: int) -> int:
        n = min(high - low, room[shard] - used[shard])
        if n > 0:
            plan.append((arc, low, low + n, shard, used[shard]))
            used[shard] += n
        return low + max(n, 0)

    for arc in range(len(owners)):
        n = counts.get(arc, 0)
        low = put(arc, 0, n, owners[arc])
        if low < n:
            over.append((arc, low, n))
    for arc, low, high in over:
        at = arc
        while low < high:
            at = (at + 1) % len(owners)
            low = put(arc, low, high, owners[at])
    return plan


def assign(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0, lane: int = LANE) -> DataFrame:
    """(doc_id, text) to (doc_id, size, text_crc32, shard, slot)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    positions = ring(shards, vnodes)[0]

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(positions, h.to_numpy()) % len(positions)).astype(np.int32))

    row = ["h", "doc_id", "text_crc32", "size"]
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text_crc32", "size")).groupBy(row).agg(F.count("*").alias("n"))
    rows = stash(rows.withColumn("arc", arc_of("h")), "hashes")
    sums = rows.groupBy("arc").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()  # shards x vnodes rows at most
    counts = {r.arc: r.n for r in sums}
    bits = max(1, (sum(counts.values()) // lane).bit_length())  # lanes are ranges of hashes, 2 ** bits of them
    rows = rows.withColumn("lane", F.shiftright("h", 64 - bits))
    upto = lambda keys, order: F.sum("n").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    offsets = rows.groupBy("arc", "lane").agg(F.sum("n").alias("n")).select("arc", "lane", upto(["arc"], ["lane"]).alias("before"))
    plan = pd.DataFrame(fill(counts, shards, vnodes, slack), columns=["arc", "low", "high", "shard", "first_slot"])
    pieces = spark.createDataFrame(plan, PLAN) if len(plan) else spark.createDataFrame([], PLAN)
    ranked = rows.withColumn("inside", upto(["arc", "lane"], row)).join(offsets, ["arc", "lane"]).withColumn("first", F.col("before") + F.col("inside"))
    parts = ranked.withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {lane})")))
    if max((r.most for r in sums), default=0) > lane:
        parts = parts.repartition("h", "part")
    each = parts.withColumn("rank", F.explode(F.expr(f"sequence(first + part * {lane}, first + least(n, (part + 1) * {lane}) - 1)")))
    placed = each.join(F.broadcast(pieces), (each.arc == pieces.arc) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("rank") - F.col("low")).alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 shards with exact bounds: the counts are at most one apart, so the law is `rows` and no grown shard is given."""
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

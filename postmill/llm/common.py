"""Helpers shared by the training-data operators: tables, scratch tables, word hashes, grouped streams, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.sources.scratch import stash  # noqa: F401

#: Words are separated by these characters only, whatever the language.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Words a shingle has, and the Jaccard similarity from which texts are near duplicates.
SHINGLE = 5
SIMILAR = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    """Array of 64-bit hashes, one for each word in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a fixed bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column: pa.Array | pa.ChunkedArray, dtype=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets (one more than rows) of an Arrow list column; null lists count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.zeros(len(column) + 1, dtype=np.int64)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    np.cumsum(lengths, out=sizes[1:])
    return column.flatten().to_numpy(zero_copy_only=False).view(dtype), sizes


def shingles(values: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of each row, and row offsets. A row of fewer words has one shingle of them all; an empty row has none."""
    lengths = np.diff(offsets)
    counts = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    if not len(values):
        return np.zeros(0, dtype=np.uint64), out
    step = np.uint64(0x9E3779B97F4A7C15)
    padded = np.concatenate([values, np.zeros(size - 1, dtype=np.uint64)])
    rolled = np.zeros(len(values), dtype=np.uint64)
    for i in range(size):
        rolled = rolled * step + padded[i : i + len(values)]
    starts = np.repeat(offsets[:-1] - out[:-1], counts) + np.arange(out[-1])
    hashes = rolled[starts]
    for row in np.flatnonzero((lengths > 0) & (lengths < size)):
        whole = np.uint64(lengths[row])
        for v in values[offsets[row] : offsets[row + 1]]:
            with np.errstate(over="ignore"):
                whole = whole * step + v
        hashes[out[row]] = whole
    return mix(hashes), out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that each hold all rows of one key, from batches sorted by the keys within the partition. Memory: a batch and the largest group."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        columns = [t[k].combine_chunks() for k in keys]
        change = np.zeros(t.num_rows, dtype=bool)
        for c in columns:
            x = c.to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        first = tuple(c[0].as_py() for c in columns)
        starts = [0, *np.flatnonzero(change).tolist()]
        if held and first != last:
            yield pa.concat_tables(held)
            held = []
        for a, b in zip(starts, starts[1:], strict=False):
            yield pa.concat_tables([*held, t.slice(a, b - a)]) if held else t.slice(a, b - a)
            held = []
        held.append(t.slice(starts[-1]))
        last = tuple(c[-1].as_py() for c in columns)
    if held:
        yield pa.concat_tables(held)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a long, b long): (node, root), root being the smallest node of the component.

    Each round takes the smallest label among neighbours and then the label of the label, so that chains shorten by half;
    the labels are written to the shared folder each round and never reach the driver, which sees one sum.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(edges.select("b", "a")).where("src <> dst").distinct()
    both = stash(both, "edges")
    labels = stash(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near")).select("node", F.least("node", "near").alias("root")), "labels")
    total = None
    while True:
        near = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels.node == near.src).select("node", F.least("root", "near").alias("root"))
        roots = lower.select("root").distinct()  # so that a label of many nodes is looked up once; only those that go lower travel on
        up = labels.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("above")).join(roots, "root", "left_semi")
        labels = stash(lower.join(up, "root", "left").select("node", F.least("root", "above").alias("root")), "labels")
        now = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now

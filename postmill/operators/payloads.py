"""Payloads in chunks: no payload is one cell, none is held whole, whatever its size.

A payload is rows (key columns, chunk, data), chunk counting from 0. Its length and SHA-256 are folded over its chunks in order, in the
task that has them sorted, across the batches it gets: memory is a batch. One payload is one task's work, as its hash is a chain.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.sources.scratch import stash

#: Bytes of a chunk, and chunks that a batch hands to a task at a time.
CHUNK, BATCH = 256 * 1024, 64
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: What reading a payload may come to. Fixed values.
OUTCOMES = ("hashed", "data_stream_missing", "data_read_failed", "data_length_mismatch")


def chunks(rows: DataFrame, content: str, *keys: str, size: int = CHUNK) -> DataFrame:
    """(keys, chunk, data) of a binary or text column; null has no chunks, an empty one has one, empty."""
    data = F.col(content).cast("binary")
    many = F.greatest(F.lit(0), F.floor((F.octet_length(data) - 1) / size)).cast("int")
    each = rows.where(F.col(content).isNotNull()).select(*keys, data.alias("data"), F.explode(F.sequence(F.lit(0), many)).alias("chunk"))
    return each.select(*keys, F.col("chunk").cast("long").alias("chunk"), F.substring("data", F.col("chunk") * size + 1, F.lit(size)).alias("data"))


def whole(parts: DataFrame, *keys: str) -> DataFrame:
    """(keys, content) of payloads that are small enough to be one cell each."""
    rows = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk", F.hex("data").alias("data")))).alias("rows"))
    return rows.select(*keys, F.unhex(F.array_join(F.transform("rows", lambda r: r["data"]), "")).alias("content"))


def digests(parts: DataFrame, *keys: str, batch: int = BATCH) -> DataFrame:
    """(keys, size, sha256, read) of each payload that has chunks. read is false where a chunk is null, lacking before the last or there twice."""
    schema = T.StructType([*(parts.schema[k] for k in keys), T.StructField("size", T.LongType()), T.StructField("sha256", T.StringType()), T.StructField("read", T.BooleanType())])

    def fold(batches):
        last, size, sha, following, read = None, 0, None, 0, True  # of the payload whose chunks are going through
        kinds: list[pa.DataType] = []

        def rows_of(rows):
            arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate([*kinds, pa.int64(), pa.string(), pa.bool_()])]
            return pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

        for part in batches:
            kinds = [part.schema.field(k).type for k in keys]
            rows, of = [], list(zip(*(part[k].to_pylist() for k in keys), strict=True))
            for key, chunk, data in zip(of, part["chunk"].to_pylist(), part["data"], strict=True):
                if sha is None or key != last:
                    if sha is not None:
                        rows.append((*last, size, sha.hexdigest(), read))
                    last, size, sha, following, read = key, 0, hashlib.sha256(), 0, True
                if chunk != following or not data.is_valid:
                    read = False
                else:
                    sha.update(data.as_buffer())
                    size += data.as_buffer().size
                following += 1
            yield rows_of(rows)
        if sha is not None:
            yield rows_of([(*last, size, sha.hexdigest(), read)])

    conf = parts.sparkSession.conf
    before = conf.get(BATCH_ROWS)
    conf.set(BATCH_ROWS, str(batch))  # so that a batch is bounded by bytes, not by ten thousand chunks
    try:
        ordered = parts.select(*keys, F.col("chunk").cast("long").alias("chunk"), "data").repartition(*keys).sortWithinPartitions(*keys, "chunk")
        return stash(ordered.mapInArrow(fold, schema), "digests")
    finally:
        conf.set(BATCH_ROWS, before)


def checked(parts: DataFrame, declared: DataFrame, *keys: str) -> DataFrame:
    """declared (keys, length) with outcome, size and sha256 of each payload: hashed only where all of it was read and its length is
    the declared one, if one is known; no chunks at all are a missing stream. What isn't hashed has no size and no hash."""
    both = declared.join(digests(parts, *keys), list(keys), "left")
    outcome = F.when(F.col("read").isNull(), OUTCOMES[1]).when(~F.col("read"), OUTCOMES[2]).when(F.col("length") != F.col("size"), OUTCOMES[3]).otherwise(OUTCOMES[0])
    kept: Column = outcome == OUTCOMES[0]
    return both.select(*keys, outcome.alias("outcome"), F.when(kept, F.col("size")).alias("size"), F.when(kept, F.col("sha256")).alias("sha256"))

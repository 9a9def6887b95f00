"""A manifest that follows a folder: files that arrive are hashed once and appended, whatever number of runs it takes."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def follow(spark: SparkSession, root: str, out: str, checkpoint: str, pattern: str = "*") -> StreamingQuery:
    """Append (path, size, sha256) of files new since the last run to the Parquet table out, then stop."""
    arriving = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    rows = arriving.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

"""Tables in the shared scratch folder of the cluster, which cut lineage and outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that this driver has written, until they are released.
WRITTEN: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set a local one will do in one process, as in tests; on a cluster it wouldn't."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or tempfile.mkdtemp(prefix="postmill-")


def stash(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a table in the scratch folder, in folders of their own for the values of some columns, so that filters on these read no more."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of texts that a task has about, where texts are dealt out. A batch for Python is 10,000 rows, whatever these hold.
SHARE = 2_000_000


def dealt(df: DataFrame, text: Column, share: int = SHARE) -> DataFrame:
    """df over so many tasks that each has about `share` bytes of a text, however few parts it is read in. What a task, or a batch that
    goes to Python, holds doesn't grow with the table then; an expensive function of the texts runs on all cores."""
    size = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return df.repartition(size // share + 1)


#: Rows of a part that a task sorts.
ROWS = 1_000_000


def parts(df: DataFrame, most: int = ROWS) -> int:
    """How many parts a table is sorted in, so that one has about `most` rows and a task's sort doesn't grow with the table."""
    return df.count() // most + 1


def release(spark: SparkSession) -> int:
    """Remove the tables that this driver has written so far, once results that read them are written themselves. Returns how many."""
    n = 0
    while WRITTEN:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        n += bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))
    return n

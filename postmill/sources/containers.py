"""Message files on a file system: listing, classes, folders from paths, hashes. Spark lists and reads the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.names import lower_ascii

DEEPEST = 64


def input_kind(name: Column) -> Column:
    """msg, pst or unsupported, by extension in any case."""
    ext = lower_ascii(F.regexp_extract(name, r"\.([^./\\]*)$", 1))
    return F.when(ext == "msg", "msg").when(ext == "pst", "pst").otherwise("unsupported")


def files(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """Message files below root: path, rel, depth, length, modified; without their content, which only later steps read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][sS][gG]").option("recursiveFileLookup", str(recursive).lower()).load(root)
    base = root.rstrip("/").replace("file://", "")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^.*?{base.lstrip('/')}/+", "")
    return found.select("path", rel.alias("rel"), F.size(F.split(rel, "/")).alias("depth"), "length", F.col("modificationTime").alias("modified"))


def within_depth(listed: DataFrame, most: int = DEEPEST) -> tuple[DataFrame, DataFrame]:
    """Files to read, and one row with how many lie too deep: they are counted, not lost silently."""
    deep = F.col("depth") > most
    return listed.where(~deep), listed.agg(F.count_if(deep).alias("too_deep"))


def folders_of(listed: DataFrame) -> DataFrame:
    """The folders that the files' paths imply: path, parent, depth, direct files."""
    dirs = F.slice(F.split("rel", "/"), F.lit(1), F.size(F.split("rel", "/")) - 1)
    ups = F.transform(F.sequence(F.lit(0), F.size(dirs)), lambda i: F.array_join(F.slice(dirs, F.lit(1), i), "/"))
    rows = listed.select(F.explode(ups).alias("folder"), F.array_join(dirs, "/").alias("own"))
    per = rows.groupBy("folder").agg(F.count_if(F.col("folder") == F.col("own")).alias("files"))
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    return per.select("folder", F.when(depth > 0, F.regexp_extract("folder", r"^(.*?)/?[^/]*$", 1)).alias("parent"), depth.alias("depth"), "files")


def hashed(spark: SparkSession, root: str) -> DataFrame:
    """Manifest (rel, size, sha256) of all files below root, each read once."""
    base = root.rstrip("/").replace("file://", "")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^.*?{base.lstrip('/')}/+", "")
    return found.select(rel.alias("rel"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))

"""The files of an archive: the entries of a plan joined with what they hold, for the sink to write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER_FILE, DOCUMENT, RECORD = "folder.json", "message.md", "metadata.json"


def archive_files(entries: DataFrame, folders: DataFrame, documents: DataFrame, records: DataFrame | None = None, originals: DataFrame | None = None, payloads: DataFrame | None = None) -> DataFrame:
    """(rel, content binary): folder.json of each folder (folder_id, json), message.md (message_id, markdown), metadata.json
    (message_id, json) and original bodies (message_id, name, content) of each message, and attachments (message_id, position,
    content). Each is joined by the id of its entry; what no entry plans isn't written, nor an entry's file that isn't given."""
    at = entries.select("kind", "source_id", "parent", F.array_join("components", "/").alias("path"))

    def beside(rows: DataFrame, key: str, name: F.Column, content: str, *kinds: str) -> DataFrame:
        held = rows.select(F.col(key).alias("of"), name.alias("name"), F.col(content).cast("binary").alias("content"))
        return at.where(F.col("kind").isin(*kinds)).join(held, F.col("source_id") == F.col("of")).select(F.concat("path", F.lit("/"), "name").alias("rel"), "content")

    messages = ("message", "embedded_message")
    out = beside(folders, "folder_id", F.lit(FOLDER_FILE), "json", "folder").unionByName(beside(documents, "message_id", F.lit(DOCUMENT), "markdown", *messages))
    if records is not None:
        out = out.unionByName(beside(records, "message_id", F.lit(RECORD), "json", *messages))
    if originals is not None:
        out = out.unionByName(beside(originals, "message_id", F.col("name"), "content", *messages))
    if payloads is not None:
        held = payloads.select(F.col("message_id").alias("of"), F.col("position").alias("at"), F.col("content").cast("binary").alias("content"))
        out = out.unionByName(at.where("kind = 'attachment'").join(held, (F.col("parent") == F.col("of")) & (F.col("source_id") == F.col("at"))).select(F.col("path").alias("rel"), "content"))
    return out


def lacking(entries: DataFrame, folders: DataFrame, documents: DataFrame) -> DataFrame:
    """(folders, messages): how many planned folders have no record, and planned messages, embedded ones above the cap too, no document.
    An archive with any would lack what its plan promises."""
    whole = entries.where(~F.array_contains("flags", "depth_capped"))
    count = lambda rows, key, name, *kinds: whole.where(F.col("kind").isin(*kinds)).join(rows.select(F.col(key).alias("source_id")), "source_id", "left_anti").agg(F.count("*").alias(name))
    return count(folders, "folder_id", "folders", "folder").crossJoin(count(documents, "message_id", "messages", "message", "embedded_message"))  # one row each

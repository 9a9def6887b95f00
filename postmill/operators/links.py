"""Links of written messages to their attachments: located exactly, resolved by a join, put back in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions import markup, texts
from postmill.sources.scratch import stash

#: What a cid: link may come to. Fixed values.
OUTCOMES = ("rewritten", "no_attachment", "not_extracted", "ambiguous")


def resolved(refs: DataFrame, attachments: DataFrame) -> DataFrame:
    """refs (message_id, pos, cid) with outcome and file. attachments (message_id, content_id, status, file): a link is resolved by
    the one extracted attachment of its message that has its content id, ids compared by their key; an empty key has none."""
    key = texts.content_id_key
    named = attachments.where("content_id is not null").select("message_id", key(F.col("content_id")).alias("key"), F.when(F.col("status") == "extracted", F.col("file")).alias("file"), (F.col("status") == "extracted").alias("good"))
    files = named.where("key <> ''").groupBy("message_id", "key").agg(F.count_if("good").alias("good"), F.min("file").alias("file"))
    both = refs.withColumn("key", key(F.col("cid"))).join(files, ["message_id", "key"], "left")
    what = F.when(F.col("good").isNull(), "no_attachment").when(F.col("good") == 0, "not_extracted").when(F.col("good") > 1, "ambiguous").otherwise("rewritten")
    return both.select("message_id", "pos", "cid", what.alias("outcome"), F.when(what == "rewritten", F.col("file")).alias("file"))


def rewritten(documents: DataFrame, attachments: DataFrame) -> DataFrame:
    """documents (message_id, markdown, one row a message) with their cid: links pointing to attachments/<file>, how many links there
    are, how many different ones, and how many came to each outcome.

    Only places and ids of links go through the join with the attachments; the text meets the answers once, in order, and messages
    without links don't take part in it. What isn't resolved stays as written. A destination within a destination isn't one."""
    linked = F.coalesce(markup.has_content_link(F.col("markdown")), F.lit(False))
    md = F.col("markdown")
    found = stash(documents.where(linked).select("message_id", markup.content_links(md).alias("found"), markup.content_rest(md).alias("rest")), "found")  # read twice
    refs = found.select("message_id", F.explode("found").alias("l")).select("message_id", "l.pos", "l.cid")
    link = F.concat(F.lit("attachments/"), texts.link(F.col("file")))
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    answers = resolved(refs, attachments).withColumn("link", F.when(F.col("outcome") == "rewritten", link)).groupBy("message_id").agg(
        F.count("*").alias("links"), F.size(F.collect_set(F.lower("cid"))).cast("long").alias("distinct_ids"), *map(count, OUTCOMES),
        F.array_sort(F.collect_list(F.struct("pos", "link"))).alias("to"),  # one for each link, so that the two lists go side by side
    )
    piece = lambda l, answer: F.concat(l["before"], F.coalesce(answer["link"], l["written"]))
    text = F.concat(F.array_join(F.zip_with("found", "to", piece), ""), "rest")
    done = found.join(answers, "message_id").select("message_id", text.alias("markdown"), "links", "distinct_ids", *OUTCOMES)
    none = documents.where(~linked).select("message_id", "markdown", *(F.lit(0).cast("long").alias(c) for c in ("links", "distinct_ids", *OUTCOMES)))
    return done.unionByName(none)

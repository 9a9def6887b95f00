"""Inventories: content-free counts of messages, recipients, attachments, bodies and container entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.functions import codes, texts
from postmill.operators.report import counted, histogram, lines, triple
from postmill.sources.scratch import parts


def per_message(messages: DataFrame, children: DataFrame, name: str) -> DataFrame:
    """Number of children of every message, 0 for those without."""
    n = children.groupBy("message_id").agg(F.count("*").alias(name))
    return messages.select("message_id").join(n, "message_id", "left").select("message_id", F.coalesce(name, F.lit(0)).alias(name))


def attachment_census(attachments: DataFrame) -> DataFrame:
    """Attachments by method with their empty data, content ids and sizes (the least that isn't 0)."""
    label = codes.method_label(F.col("method"))
    return attachments.groupBy(label.alias("method_label")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("size") == 0).alias("empty"),
        F.count_if(F.col("size").isNull()).alias("unreadable_size"),
        F.count("content_id").alias("with_content_id"),
        F.sum("size").alias("bytes"),
        F.max("size").alias("largest"),
        F.min(F.nullif(F.col("size"), F.lit(0))).alias("least_nonzero"),
    )


def message_census(messages: DataFrame, recipients: DataFrame, attachments: DataFrame) -> DataFrame:
    """The inventory report: messages, classes, recipient types, attachment methods and the any/total/max of each."""
    m = counted(messages, messages=F.count("*"), class_missing=F.count_if(F.coalesce("message_class", F.lit("")) == ""), classes=F.count_distinct(F.nullif("message_class", F.lit(""))))
    bucket = codes.recipient_bucket(F.col("raw_type"))
    r = counted(recipients, **{f"recipients_{b}": F.count_if(bucket == b) for b in ("originator", "to", "cc", "bcc", "unrecognized", "missing")})
    label = codes.method_label(F.col("method"))
    zero = F.col("size") == 0
    a = counted(
        attachments,
        **{f"attachments_{x}": F.count_if(label == x) for x in (*codes.METHODS, "unrecognized", "unreadable")},
        zero_size_by_value=F.count_if(zero & (F.col("method") == 1)),
        zero_size_other=F.count_if(zero & (F.col("method") != 1)),
        content_ids=F.count("content_id"),
    )
    rs = counted(per_message(messages, recipients, "n"), **triple("recipients", "n"))
    as_ = counted(per_message(messages, attachments, "n"), **triple("attachments", "n"))
    return lines(m.crossJoin(r).crossJoin(a).crossJoin(rs).crossJoin(as_))  # five rows of one each


def class_histogram(messages: DataFrame) -> DataFrame:
    c = F.col("message_class")
    return histogram(messages, F.when(c.isNull(), "(unreadable)").when(c == "", "(missing)").otherwise(c), "message_class")


def recipient_histogram(recipients: DataFrame) -> DataFrame:
    """Types as the inventory counts them (flags and all) against kinds as the envelope reads them."""
    t = F.col("raw_type")
    kind = F.when(codes.is_originator(t), "originator").otherwise(F.coalesce(codes.recipient_kind(t), F.lit("unlisted")))
    return recipients.groupBy(codes.recipient_bucket(t).alias("inventory"), kind.alias("envelope")).agg(F.count("*").alias("n"), F.count_distinct("message_id").alias("messages"))


def internet_ids(messages: DataFrame) -> DataFrame:
    t = F.trim("internet_message_id")
    return counted(messages, missing=F.count_if(F.col("internet_message_id").isNull()), duplicates=F.count("internet_message_id") - F.count_distinct(t))


def body_flags(bodies: DataFrame, rtf: Column) -> DataFrame:
    """Which bodies messages have; HTML by way of RTF (rtf: whether there is some) counts only where there is no native HTML."""
    native = F.octet_length(F.coalesce("native_html", F.lit(""))) > 0
    plain = F.octet_length(F.coalesce("plain_text", F.lit(""))) > 0
    flags = bodies.select(native.alias("native"), plain.alias("plain"), (~native & rtf).alias("via_rtf"), F.octet_length("plain_text").alias("size"))
    return lines(counted(flags, native=F.count_if("native"), plain=F.count_if("plain"), via_rtf=F.count_if("via_rtf"), html=F.count_if(F.col("native") | F.col("via_rtf")), none=F.count_if(~F.col("native") & ~F.col("plain")), plain_bytes=F.sum("size"), largest=F.max("size")))


def cross_tab(attachments: DataFrame) -> DataFrame:
    """Method against the class of the size, in one pass with the totals of either."""
    size = F.col("size")
    kind = F.when(size.isNull(), "unreadable").when(size == 0, "empty").when(size < 10, "small").otherwise("large")
    keyed = attachments.select(codes.method_label(F.col("method")).alias("method_label"), kind.alias("size_class"), "size")
    return keyed.cube("method_label", "size_class").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.grouping_id().cast("int").alias("level"))


def duplicate_groups(messages: DataFrame) -> DataFrame:
    """Groups of equal names in a folder: how many, how large, how many names collide."""
    sizes = messages.groupBy("folder_id", F.lower("subject").alias("key")).agg(F.count("*").alias("size"))
    big = F.col("size") > 1
    return lines(counted(sizes, groups=F.count_if(big), colliding=F.sum(F.when(big, F.col("size"))), largest=F.max("size"), groups_of_100=F.count_if(F.col("size") >= 100), names=F.count("*"), suffix_width_max=F.max(F.when(big, F.greatest(F.lit(2), F.char_length(F.col("size").cast("string")))))))


def structure(entries: DataFrame) -> DataFrame:
    """Entries by scope and kind, by scope, by kind and over all, in one pass; gap: entries whose kind is none of those known."""
    kind = codes.entry_kind(F.col("name"))
    keyed = entries.select(codes.scope(F.col("path")).alias("scope"), kind.alias("kind"), codes.name_mismatch(kind, F.col("is_stream")).alias("mismatch"), "len")
    return keyed.groupingSets([["scope", "kind"], ["scope"], ["kind"], []], "scope", "kind").agg(F.count("*").alias("n"), F.count("mismatch").alias("mismatches"), F.sum("len").alias("bytes"), F.grouping_id().cast("int").alias("level"))


def property_structure(properties: DataFrame) -> DataFrame:
    t = F.col("property_type")
    return properties.groupBy("scope", codes.type_shape(t).alias("shape"), (t.bitwiseAND(F.lit(codes.MULTI)) != 0).alias("multi")).agg(
        F.count("*").alias("n"), F.count_distinct("property_id").alias("ids"), F.sum(F.col("flags").bitwiseAND(F.lit(2)) / 2).cast("long").alias("readable"), F.any_value(codes.header_length(F.col("scope"))).alias("header")
    )


def gates(entries: DataFrame, properties: DataFrame) -> DataFrame:
    """Counts that must be 0 in a sound archive: (ord, key, value) and whether the gate holds."""
    kind = codes.entry_kind(F.col("name"))
    e = counted(
        entries,
        unrecognized_names=F.count_if(kind == "unrecognized"),
        name_type_mismatch=F.count(codes.name_mismatch(kind, F.col("is_stream"))),
        malformed_stream_names=F.count_if((kind == "unrecognized") & (codes.name_shape(F.col("name")) == "malformed_property_stream_name")),
        empty_streams=F.count_if(F.col("is_stream") & (F.col("len") == 0)),
        entry_gap=F.count("*") - F.count_if(kind.isNotNull()),
    )
    t = F.col("property_type")
    p = counted(
        properties,
        headerless_entries=F.count_if(codes.header_length(F.col("scope")).isNull()),
        unknown_types=F.count_if(codes.type_shape(t).isNull()),
        flags_outside_range=F.count_if((F.col("flags") < 0) | (F.col("flags") > 7)),
        multi_value_fixed=F.count_if((t.bitwiseAND(F.lit(codes.MULTI)) != 0) & t.bitwiseAND(F.lit(~codes.MULTI)).isin(*codes.FIXED_TYPES)),
    )
    return lines(e.crossJoin(p)).withColumn("holds", F.col("value") == 0)


def source_census(messages: DataFrame, folders: DataFrame, attachments: DataFrame) -> DataFrame:
    t = F.coalesce("delivery_ft", "submit_ft")
    m = counted(messages, messages=F.count("*"), without_time=F.count_if(t.isNull()), from_submit=F.count_if(F.col("delivery_ft").isNull() & F.col("submit_ft").isNotNull()), without_id=F.count_if(F.col("internet_message_id").isNull()))
    f = counted(folders, folders=F.count("*"), deepest=F.max("depth"), roots=F.count_if(F.col("parent_id").isNull()))
    a = counted(attachments, attachments=F.count("*"), by_value=F.count_if(F.col("method") == 1), embedded=F.count_if(F.col("method") == 5), nameless=F.count_if(F.coalesce("long_name", "short_name").isNull()))
    return lines(m.crossJoin(f).crossJoin(a))


def row_order(recipients: DataFrame) -> DataFrame:
    """Whether each message's recipient rows come in the order of their row numbers (messages of two rows and more)."""
    return order_of(recipients.repartition(parts(recipients), "message_id"))


def order_of(recipients: DataFrame) -> DataFrame:
    """row_order of recipients that lie by message_id in parts that a task can sort."""
    before = F.lag("row_id").over(W.partitionBy("message_id").orderBy("ord", F.coalesce("row_id", F.lit(-1))))
    checked = recipients.select("message_id", "ord", "row_id").withColumn("falls", F.coalesce(before > F.col("row_id"), F.lit(False)))
    per = checked.groupBy("message_id").agg(F.count("*").alias("n"), F.bool_or(F.col("row_id").isNull()).alias("unknown"), F.bool_or("falls").alias("falls")).where("n >= 2")
    return histogram(per, F.when(F.col("unknown"), "unverifiable").when(F.col("falls"), "differs").otherwise("in_order"), "row_order")


def envelope_tally(recipients: DataFrame, messages: DataFrame) -> DataFrame:
    """Presence of the envelope's fields, and recipient rows that are listed, unlisted or unaccounted for."""
    kind = codes.recipient_kind(F.col("raw_type"))
    r = counted(
        recipients,
        recipient_rows=F.count("*"),
        listed=F.count(kind),
        unlisted=F.count("*") - F.count(kind),
        unlisted_originator=F.count_if(codes.is_originator(F.col("raw_type"))),
        unlisted_missing_type=F.count_if(F.col("raw_type").isNull()),
        with_display_name=F.count("display_name"),
        with_email=F.count("email_address"),
        with_smtp=F.count("smtp_address"),
        hidden_directory=F.count_if(codes.is_hidden_directory_address(F.col("address_type"), F.col("smtp_address"))),
        without_row_id=F.count_if(F.col("row_id").isNull()),
    )
    r = r.withColumn("unaccounted", F.abs(F.col("recipient_rows") - F.col("listed") - F.col("unlisted")))
    m = counted(messages, importance=F.count("importance"), sensitivity=F.count("sensitivity"), submit=F.count("submit_ft"), delivery=F.count("delivery_ft"), no_time=F.count_if(F.coalesce("submit_ft", "delivery_ft").isNull()))
    return lines(r.crossJoin(m))


#: Columns of a recipient table that a reader uses, by the fields they fill. Fixed values.
TABLE_COLUMNS = {"type": "raw_type", "display_name": "display_name", "address_type": "address_type", "email_address": "email_address", "smtp_address": "smtp_address", "row_id": "row_id"}
#: The lines of the envelope's report in order. Fixed values.
ENVELOPE_LINES = (
    "messages", "sender_present", "sender_missing", "sent_representing_present", "submit_time_present", "delivery_time_present", "importance_present", "sensitivity_present", "conversation_topic_present", "conversation_index_present",
    "transport_headers_present", "exchange_without_smtp", "recipient_tables_absent", *(f"recipient_tables_without_{c}_column" for c in TABLE_COLUMNS), "recipient_rows", "recipient_rows_unreadable", "recipients_listed", "recipients_to",
    "recipients_cc", "recipients_bcc", "recipients_unlisted", "recipients_unlisted_originator", "recipients_unlisted_other_type", "recipients_unlisted_type_unreadable", "recipient_order_in_row_id_order",
    "recipient_order_differs_from_row_id", "recipient_order_unverifiable", "recipient_rows_unaccounted",
)


def as_read(recipients: DataFrame, tables: DataFrame) -> DataFrame:
    """Recipients as a reader sees them: none of an absent table, no field whose column a table lacks, none at all of an unreadable row."""
    r = recipients.repartition(parts(recipients), "message_id").join(tables, "message_id").where("present")
    return r.withColumns({field: F.when(F.col("readable") & ~F.array_contains("lacks", column), F.col(field)) for column, field in TABLE_COLUMNS.items()})


def envelope_report(messages: DataFrame, senders: DataFrame, tables: DataFrame, recipients: DataFrame) -> DataFrame:
    """All lines of the envelope's report. messages with conversation_topic, conversation_index and transport_headers; tables (message_id,
    present, lacks): whether a message has a recipient table and which columns that lacks; recipients with readable."""
    n, has = F.count_if, lambda c: F.count(c)
    of_messages = counted(
        messages, messages=F.count("*"), submit_time_present=has("submit_ft"), delivery_time_present=has("delivery_ft"), importance_present=has("importance"), sensitivity_present=has("sensitivity"),
        conversation_topic_present=has("conversation_topic"), conversation_index_present=has("conversation_index"), transport_headers_present=has("transport_headers"),
    )
    four = lambda p: F.coalesce(*(F.col(p + c) for c in ("display_name", "address_type", "email_address", "smtp_address"))).isNotNull()
    hidden = lambda p: codes.is_hidden_directory_address(F.col(p + "address_type"), F.col(p + "smtp_address"))
    of_senders = counted(senders, sender_present=n(four("sender_")), sent_representing_present=n(four("represented_")), hidden_senders=n(hidden("sender_")))
    of_tables = counted(tables, recipient_tables_absent=n(~F.col("present")), **{f"recipient_tables_without_{c}_column": n(F.col("present") & F.array_contains("lacks", c)) for c in TABLE_COLUMNS})
    rows = as_read(recipients, tables)
    kind, raw = codes.recipient_kind(F.col("raw_type")), F.col("raw_type")
    of_rows = counted(
        rows, recipient_rows=F.count("*"), recipient_rows_unreadable=n(~F.col("readable")), recipients_to=n(kind == "to"), recipients_cc=n(kind == "cc"), recipients_bcc=n(kind == "bcc"), hidden_recipients=n(kind.isNotNull() & hidden("")),
        recipients_unlisted_originator=n(codes.is_originator(raw)), recipients_unlisted_other_type=n(kind.isNull() & raw.isNotNull() & ~codes.is_originator(raw)), recipients_unlisted_type_unreadable=n(raw.isNull()),
    )
    order = order_of(rows).groupBy().pivot("row_order", ["in_order", "differs", "unverifiable"]).agg(F.sum("n"))
    both = of_messages.crossJoin(of_senders).crossJoin(of_tables).crossJoin(of_rows).crossJoin(order)  # one row each
    listed = F.col("recipients_to") + F.col("recipients_cc") + F.col("recipients_bcc")
    unlisted = F.col("recipients_unlisted_originator") + F.col("recipients_unlisted_other_type") + F.col("recipients_unlisted_type_unreadable")
    derived = {
        "sender_missing": F.greatest(F.col("messages") - F.col("sender_present"), F.lit(0)), "exchange_without_smtp": F.col("hidden_senders") + F.col("hidden_recipients"), "recipients_listed": listed, "recipients_unlisted": unlisted,
        "recipient_order_in_row_id_order": F.col("in_order"), "recipient_order_differs_from_row_id": F.col("differs"), "recipient_order_unverifiable": F.col("unverifiable"), "recipient_rows_unaccounted": F.abs(F.col("recipient_rows") - listed - unlisted),
    }
    return lines(both.withColumns(derived).select(*(F.coalesce(c, F.lit(0)).alias(c) for c in ENVELOPE_LINES)))


def selected(bodies: DataFrame, failed: Column) -> DataFrame:
    """Which body of a message is shown: native HTML that isn't blank (unless its conversion failed), else plain text that isn't,
    else none; and what was lost."""
    blank_html, blank_text = texts.is_blank(F.col("native_html")), texts.is_blank(F.col("plain_text"))
    source = F.when(~blank_html, "native_html").when(~blank_text, "plain_text").otherwise("none")
    html = F.when(~blank_html, F.col("native_html"))
    rows = F.when(html.isNull(), 0).otherwise(F.regexp_count(html, F.lit(r"(?i)<tr[>/\s]")))
    replaced = F.when(html.isNull(), 0).otherwise(F.char_length(html) - F.char_length(F.replace(html, F.lit("�"), F.lit(""))))
    loss = F.array(
        F.struct(F.lit(texts.LOSSES[0]).alias("reason"), rows.cast("long").alias("count")),
        F.struct(F.lit(texts.LOSSES[2]).alias("reason"), replaced.cast("long").alias("count")),
        F.struct(F.lit(texts.LOSSES[4]).alias("reason"), F.when(html.isNotNull() & failed, 1).otherwise(0).cast("long").alias("count")),
    )
    fallback = F.when((source == "native_html") & failed, F.when(~blank_text, "plain_text").otherwise("none")).otherwise(source)
    return bodies.select("message_id", source.alias("source"), fallback.alias("shown"), F.filter(loss, lambda x: x["count"] > 0).alias("loss"))


def body_tallies(bodies: DataFrame, failed: Column) -> DataFrame:
    """Messages by the source of their body, and lossy messages and loss by reason."""
    s = selected(bodies, failed)
    by_source = s.groupBy(F.concat(F.lit("source="), "shown").alias("key")).agg(F.count("*").alias("messages"), F.count("*").alias("total"))
    by_loss = s.select(F.explode("loss").alias("l")).groupBy(F.concat(F.lit("loss="), F.col("l.reason")).alias("key")).agg(F.count("*").alias("messages"), F.sum("l.count").alias("total"))
    return by_source.unionByName(by_loss)


def word_counts(texts_df: DataFrame, column: str) -> DataFrame:
    """Alphanumeric words and how often they stand; counted within tasks before the shuffle."""
    return texts_df.select(F.explode(texts.alphanumeric_words(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def html_facts(pages: DataFrame) -> DataFrame:
    h = F.lower("html")
    count = lambda p: F.regexp_count(h, F.lit(p)).cast("long")
    return pages.select(
        "page_id", count(r"<a\s[^>]*href=").alias("links"), count(r"<img[\s/>]").alias("images"), count(r"<tr[>/\s]").alias("table_rows"), count(r"<h[1-6][>\s]").alias("headings"),
        count(r"<li[>\s]").alias("items"), count(r"<th[>\s]").alias("header_cells"), count(r"<[^>]*(display\s*:\s*none|mso-hide\s*:\s*all)").alias("hidden_tags"), F.char_length("html").cast("long").alias("chars"),
    )


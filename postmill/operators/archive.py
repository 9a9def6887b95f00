"""Rendering messages and folders of an archive, and what becomes of attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import codes, markup, texts
from postmill.functions.names import WHITE

#: Why an attachment's data isn't in the archive, by method. Fixed values.
REASONS = {0: "method_none", 2: "by_reference", 3: "by_reference", 4: "by_reference", 6: "ole_object"}


def staged(attachments: DataFrame, depth: Column | None = None, most: int = 3) -> DataFrame:
    """Status and reason of each attachment: extracted, not extracted (and why), failed."""
    m, size = F.col("method"), F.col("size")
    reason = F.when(m.isNull(), "method_unreadable")
    for k, why in REASONS.items():
        reason = reason.when(m == k, why)
    reason = (
        reason.when((m == 5) & ((depth if depth is not None else F.lit(0)) >= most), "embedded_depth_capped")
        .when((m == 5) & size.isNull(), "embedded_message_unreadable")
        .when((m == 1) & size.isNull(), "data_read_failed")
        .when((m == 1) & (size == 0), "data_stream_missing")
        .when(~m.isin(1, 5), "method_unrecognized")
    )
    failed = reason.isin("data_read_failed", "data_stream_missing")
    return attachments.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "extracted").when(failed, "failed").otherwise("not_extracted"))


def attachment_name(long_name: Column, short_name: Column, ord_: Column) -> Column:
    """The long name, else the short one, else one by position; blank names are none."""
    named = [F.when(~texts.is_blank(c), c) for c in (long_name, short_name)]
    return F.coalesce(*named, F.concat(F.lit("attachment-"), ord_.cast("string")))


#: Words for importance and sensitivity; the usual values have none. Fixed values.
IMPORTANCE, SENSITIVITY = {0: "low", 1: None, 2: "high"}, {0: None, 1: "personal", 2: "private", 3: "company confidential"}
FOUR = ("display_name", "address_type", "email_address", "smtp_address")


def with_address(rows: DataFrame, out: str, prefix: str = "") -> DataFrame:
    """rows with the text of an address as a code span, null where all its fields are. It is made in columns of its own, one after
    the other, so that no expression stands in another several times."""
    four = [F.col(prefix + c) for c in FOUR]
    steps = rows.withColumns({"_name": texts.one_line(four[0]), "_address": texts.shown_address(*four[1:])})
    steps = steps.withColumn("_text", F.coalesce(texts.named_address(F.col("_name"), F.col("_address")), F.when(F.coalesce(*four).isNotNull(), "(unknown)")))
    return steps.withColumn(out, texts.code_span(F.col("_text"))).drop("_name", "_address", "_text")


def header_lines(sender: Column, represented: Column, to: Column, cc: Column, bcc: Column, date: Column, importance: Column, sensitivity: Column) -> Column:
    """The list of a message's envelope fields as one text, a line for each that is there; null fields and empty ones have none."""

    def field(name: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"- **{name}:** "), value))

    def word(value: Column, words: dict) -> Column:
        out = F.when(value.isNull(), F.lit(None).cast("string"))
        for k, w in words.items():
            out = out.when(value == k, F.lit(w).cast("string"))
        return out.otherwise(F.concat(F.lit("unknown ("), value.cast("string"), F.lit(")")))

    rows = (("From", sender), ("On behalf of", represented), ("To", to), ("Cc", cc), ("Bcc", bcc), ("Date", date), ("Importance", word(importance, IMPORTANCE)), ("Sensitivity", word(sensitivity, SENSITIVITY)))
    return F.concat_ws("\n", *(field(*r) for r in rows))


def listed(recipients: DataFrame) -> DataFrame:
    """Recipients of a message as code spans, by kind, in the order of their rows: one row a message, as its head shows them all."""
    known = recipients.withColumn("kind", codes.recipient_kind(F.col("raw_type"))).where("kind is not null")
    rows = with_address(known, "text").select("message_id", "kind", F.struct("ord", F.coalesce("text", F.lit("`(unknown)`")).alias("text")).alias("r"))
    of = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("r")))), lambda x: x["text"]), ", ").alias(f"{k}_text")
    return rows.groupBy("message_id").agg(of("to"), of("cc"), of("bcc"), F.count("*").alias("n_listed"))


def message_markdown(messages: DataFrame, senders: DataFrame, recipients: DataFrame, bodies: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """message_id, markdown: a title, the list of envelope fields, the body. The date shown is that of submission, else of delivery.

    bodies (message_id, markdown, plain_text): Markdown stands as it is, without blank lines around it; plain text stands in a fence
    longer than any run of backticks in it. Without either a message is its head; how says whether those that bodies lacks stay."""
    people = with_address(with_address(senders, "sender", "sender_"), "represented", "represented_").select("message_id", "sender", "represented")
    both = messages.join(people, "message_id", "left").join(listed(recipients), "message_id", "left")
    # Each text is made in a column of its own, as one that stands in another several times is made as often.
    both = both.withColumns({"_date": codes.filetime_text(F.coalesce("submit_ft", "delivery_ft")), "_title": texts.title(F.col("subject"))})
    lines = header_lines(F.col("sender"), F.col("represented"), F.col("to_text"), F.col("cc_text"), F.col("bcc_text"), F.col("_date"), F.col("importance"), F.col("sensitivity"))
    both = both.select("message_id", "_title", lines.alias("_lines"))
    head = F.concat(F.lit("# "), "_title", F.lit("\n"), F.when(F.col("_lines") != "", F.concat(F.lit("\n"), "_lines", F.lit("\n"))).otherwise(""))
    if bodies is None:
        return both.select("message_id", head.alias("markdown"))
    plain = F.regexp_replace(texts.newlines(F.col("plain_text")), "\n+$", "")
    shown = bodies.select("message_id", F.regexp_replace(F.regexp_replace(texts.newlines(F.col("markdown")), "^\n+", ""), f"[{WHITE}]+$", "").alias("_md"), plain.alias("_plain"))
    shown = shown.withColumn("_fence", texts.fence(F.col("_plain")))
    body = F.when(F.col("_md").isNotNull(), F.when(F.col("_md") != "", F.concat(F.lit("\n"), "_md", F.lit("\n"))).otherwise("")).when(
        F.col("_plain").isNotNull(), F.concat(F.lit("\n"), "_fence", F.lit("text\n"), "_plain", F.lit("\n"), "_fence", F.lit("\n"))
    )
    return both.join(shown, "message_id", how).select("message_id", F.concat(head, F.coalesce(body, F.lit(""))).alias("markdown"))


def shown_bodies(bodies: DataFrame) -> DataFrame:
    """(message_id, markdown, plain_text) of the body that each message shows: the visible text of native HTML that isn't blank, else
    plain text that isn't, else neither."""
    html, text = ~texts.is_blank(F.col("native_html")), ~texts.is_blank(F.col("plain_text"))
    return bodies.select("message_id", F.when(html, markup.visible_text(F.col("native_html"))).alias("markdown"), F.when(~html & text, F.col("plain_text")).alias("plain_text"))


def envelope_record(messages: DataFrame, senders: DataFrame, recipients: DataFrame) -> DataFrame:
    """(message_id, envelope): sender, represented sender, recipients in order, how many aren't listed, times, importance, sensitivity."""
    four = lambda p: F.when(F.coalesce(*(p + c for c in FOUR)).isNotNull(), F.struct(*(F.col(p + c).alias(c) for c in FOUR)))
    kind = codes.recipient_kind(F.col("raw_type")).alias("kind")
    one = F.struct("ord", kind, *FOUR)
    rows = recipients.select("message_id", kind, one.alias("r"))
    per = rows.groupBy("message_id").agg(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.col("r")))).alias("rows"), F.count_if(F.col("kind").isNull()).alias("unlisted"))
    people = senders.select("message_id", four("sender_").alias("sender"), four("represented_").alias("sent_representing"))
    both = messages.join(people, "message_id", "left").join(per, "message_id", "left")
    people_of = F.transform(F.coalesce("rows", F.array().cast(per.schema["rows"].dataType)), lambda r: F.struct(r["kind"].alias("kind"), *(r[c].alias(c) for c in FOUR)))
    return both.select("message_id", F.struct(
        "sender", "sent_representing", people_of.alias("recipients"), F.coalesce("unlisted", F.lit(0)).alias("recipients_unlisted"), F.col("submit_ft").alias("submit_time_filetime"), F.col("delivery_ft").alias("delivery_time_filetime"),
        codes.filetime_text(F.coalesce("submit_ft", "delivery_ft")).alias("date_utc"), "importance", "sensitivity",
    ).alias("envelope"))


def body_record(bodies: DataFrame) -> DataFrame:
    """(message_id, body): which form is shown, what was done to it, the originals kept beside it with bytes and hash."""
    html, text = F.col("native_html"), F.col("plain_text")
    shown = F.when(~texts.is_blank(html), "native_html").when(~texts.is_blank(text), "plain_text").otherwise("none")
    one = lambda c, name, note: F.when(c.isNotNull() & (c != ""), F.struct(F.lit(name).alias("file"), F.octet_length(c).cast("long").alias("bytes"), F.sha2(c, 256).alias("sha256"), F.lit(note).cast("string").alias("note")))
    originals = F.array_compact(F.array(one(html, "body.html", "as_stored"), one(text, "body.txt", None)))
    steps = F.when(shown == "native_html", texts.applied(html)).otherwise(F.array().cast("array<string>"))
    return bodies.select("message_id", F.struct(shown.alias("source"), steps.alias("preprocessing"), originals.alias("originals")).alias("body"), (html.isNotNull() & (shown != "native_html")).alias("fell_back"))


def attachment_records(staged_attachments: DataFrame) -> DataFrame:
    """(message_id, records, lost): the attachments of each message in order, what became of each and why, and how many aren't there."""
    name = attachment_name(F.col("long_name"), F.col("short_name"), F.col("ord"))
    kept = lambda c: F.when(F.col("status") == "extracted", c)
    one = F.struct(
        F.col("ord").cast("long").alias("position"), name.alias("name"), codes.method_label(F.col("method")).alias("method"), F.col("method").cast("long").alias("method_code"), "content_id", "status", "reason",
        kept(name).alias("file"), kept(F.col("size")).alias("bytes"),
    )
    return staged_attachments.groupBy("message_id").agg(F.array_sort(F.collect_list(one)).alias("records"), F.count_if(F.col("status") != "extracted").alias("lost"))


def message_metadata(messages: DataFrame, senders: DataFrame, recipients: DataFrame, bodies: DataFrame, staged_attachments: DataFrame) -> DataFrame:
    """(message_id, json): the whole record of every message, those without a body too. Its status is always partial, with the reasons that hold."""
    none = F.struct(F.lit("none").alias("source"), F.array().cast("array<string>").alias("preprocessing"), F.array().cast("array<struct<file: string, bytes: bigint, sha256: string, note: string>>").alias("originals"))
    n = attachment_records(staged_attachments)
    both = messages.join(body_record(bodies), "message_id", "left").join(envelope_record(messages, senders, recipients), "message_id").join(n, "message_id", "left").na.fill(0, ["lost"]).na.fill(False, ["fell_back"])
    reasons = F.array_compact(F.array(F.lit("other_properties_not_preserved"), F.when(F.col("lost") > 0, "attachments_not_extracted"), F.when(F.col("fell_back"), "formatted_bodies_not_converted")))
    record = F.struct(
        F.lit(1).alias("schema_version"), F.lit("message").alias("kind"), "subject", "internet_message_id", F.coalesce("delivery_ft", "submit_ft").alias("time_filetime"), F.coalesce("body", none).alias("body"), "envelope",
        F.coalesce("records", F.array().cast(n.schema["records"].dataType)).alias("attachments"), F.col("lost").alias("attachments_not_extracted"), F.lit("partial").alias("status"), reasons.alias("status_reasons"),
    )
    return both.select("message_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


#: Embedded messages within embedded messages that are written whole; the next is only recorded, what lies in it is not.
NESTING = 3


def embedded(messages: DataFrame, attachments: DataFrame, most: int = NESTING) -> DataFrame:
    """(root_id, message_id, depth): the messages that are attachments (inner_id), in the messages that are not, from level to level
    down to the first one beyond `most`."""
    inner = attachments.where("inner_id is not null").select("message_id", "inner_id")
    inside = inner.select(F.col("inner_id").alias("message_id")).distinct()
    level = messages.select("message_id").join(inside, "message_id", "left_anti").select(F.col("message_id").alias("root_id"), "message_id")
    out = None
    for depth in range(1, most + 2):
        level = level.join(inner, "message_id").select("root_id", F.col("inner_id").alias("message_id"))
        rows = level.select("root_id", "message_id", F.lit(depth).alias("depth"))
        out = rows if out is None else out.unionByName(rows)
    return out


def embedded_files(messages: DataFrame, attachments: DataFrame, most: int = NESTING) -> DataFrame:
    """(root_id, message_id, depth, name, content): message.md and metadata.json of each embedded message; of one beyond the cap only
    a record of what is known of it. messages: (message_id, subject, delivery_ft, submit_ft)."""
    at = embedded(messages, attachments, most).join(messages, "message_id")
    head = F.concat(F.lit("# "), texts.title(F.col("subject")), F.lit("\n"))
    found = at.select("message_id", "depth").join(attachments, "message_id")
    records = attachment_records(staged(found.where(F.col("depth") <= most), F.col("depth"), most))
    count = found.where(F.col("depth") > most).groupBy("message_id").agg(F.count("*").alias("lost"))
    whole = at.where(F.col("depth") <= most).join(records, "message_id", "left").na.fill(0, ["lost"])
    reasons = F.array_compact(F.array(F.lit("other_properties_not_preserved"), F.when(F.col("lost") > 0, "attachments_not_extracted")))
    record = F.struct(
        F.lit(1).alias("schema_version"), F.lit("embedded_message").alias("kind"), "subject", F.coalesce("delivery_ft", "submit_ft").alias("time_filetime"),
        F.coalesce("records", F.array().cast(records.schema["records"].dataType)).alias("attachments"), F.col("lost").alias("attachments_not_extracted"), F.lit("partial").alias("status"), reasons.alias("status_reasons"),
    )
    capped = F.struct(F.lit(1).alias("schema_version"), F.lit("embedded_message").alias("kind"), "subject", F.col("lost").alias("attachments_not_extracted"), F.lit("partial").alias("status"), F.array(F.lit("embedded_depth_capped")).alias("status_reasons"))
    json = lambda r: F.to_json(r, {"ignoreNullFields": "false"})
    both = F.explode(F.array(F.struct(F.lit("message.md").alias("name"), head.alias("content")), F.struct(F.lit("metadata.json").alias("name"), json(record).alias("content")))).alias("f")
    only = at.where(F.col("depth") > most).join(count, "message_id", "left").na.fill(0, ["lost"])
    return whole.select("root_id", "message_id", "depth", both).select("root_id", "message_id", "depth", "f.*").unionByName(only.select("root_id", "message_id", "depth", F.lit("metadata.json").alias("name"), json(capped).alias("content")))


def folder_record(folders: DataFrame, messages: DataFrame) -> DataFrame:
    """JSON of each folder: its name, parent and what is in it."""
    inside = messages.groupBy("folder_id").agg(F.count("*").alias("messages"))
    subs = folders.where("parent_id is not null").groupBy(F.col("parent_id").alias("folder_id")).agg(F.count("*").alias("folders"))
    both = folders.join(inside, "folder_id", "left").join(subs, "folder_id", "left")
    record = F.struct("folder_id", "name", "depth", F.coalesce("folders", F.lit(0)).alias("folders"), F.coalesce("messages", F.lit(0)).alias("messages"), F.lit("partial").alias("status"))
    return both.select("folder_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


def message_record(messages: DataFrame, staged_attachments: DataFrame) -> DataFrame:
    """JSON of each message: subject, times, attachments by status; the status of a record is always partial, with its reasons."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    a = staged_attachments.groupBy("message_id").agg(n("extracted"), n("not_extracted"), n("failed"))
    both = messages.join(a, "message_id", "left").na.fill(0, ["extracted", "not_extracted", "failed"])
    lost = F.col("not_extracted") + F.col("failed") > 0
    reasons = F.when(lost, F.array(F.lit("other_properties_not_preserved"), F.lit("attachments_not_extracted"))).otherwise(F.array(F.lit("other_properties_not_preserved")))
    record = F.struct(
        "message_id", "subject", codes.filetime_text(F.col("submit_ft")).alias("submitted"), codes.filetime_text(F.col("delivery_ft")).alias("delivered"), "importance",
        F.struct("extracted", "not_extracted", "failed").alias("attachments"), F.lit("partial").alias("status"), reasons.alias("reasons"),
    )
    return both.select("message_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


def originals(bodies: DataFrame) -> DataFrame:
    """The original bodies that are kept beside a message: those that aren't empty, with name, bytes and hash."""
    forms = F.array(*(F.struct(F.lit(name).alias("name"), F.col(c).alias("body")) for name, c in (("body.html", "native_html"), ("body.txt", "plain_text"))))
    kept = F.filter(forms, lambda x: x["body"].isNotNull() & (x["body"] != ""))
    return bodies.select("message_id", F.explode(kept).alias("k")).select("message_id", "k.name", F.octet_length("k.body").cast("long").alias("size"), F.sha2("k.body", 256).alias("sha256"))


def address(display: Column, kind: Column, email: Column, smtp: Column) -> Column:
    """The four fields as one struct, null when all are absent."""
    return F.when(F.coalesce(display, kind, email, smtp).isNotNull(), F.struct(display.alias("display_name"), kind.alias("address_type"), email.alias("email_address"), smtp.alias("smtp_address")))

"""Containers checked from the bytes of their streams: property entries, the values they announce, named properties.

Streams are rows (file, parent, name, data); data is null where it couldn't be read. Everything is decoded by column functions in
place; values meet their entries by one join on (file, path), the streams of named properties by one on file.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import codes
from postmill.operators.report import counted
from postmill.sources.scratch import stash

PROPERTIES, NAMED = "__properties_version1.0", "/__nameid_version1.0"
#: Streams of named properties: GUIDs, entries, strings. Property and type of an attachment's object, and the size it must announce. Fixed values.
GUIDS, ENTRIES, STRINGS = "__substg1.0_00020102", "__substg1.0_00030102", "__substg1.0_00040102"
OBJECT, ATTACHED, SENTINEL = 0x000D, 0x3701, 0xFFFFFFFF
#: What must be 0 in a sound container. Fixed values.
GATES = (
    "properties_stream_too_short_for_header_total", "properties_stream_trailing_bytes_total", "properties_stream_unexpected_scope_total", "properties_stream_read_errors", "attach_data_object_size_sentinel_mismatches",
    "attach_data_object_reserved_vs_embedded_object_storage_gap", "attach_data_object_reserved_vs_custom_object_storage_gap", "fixed_boolean_invalid_encoding_total", "fixed_float_non_finite_total", "variable_value_stream_missing_total",
    "variable_value_size_mismatch_total", "variable_value_odd_utf16_length_total", "variable_unicode_decode_errors_total", "variable_string8_undefined_byte_total", "variable_string8_unsupported_codepage_total",
    "variable_clsid_wrong_length_total", "named_properties_guid_out_of_range_total", "named_properties_string_decode_errors_total", "named_properties_index_mismatch_total",
)


def property_streams(streams: DataFrame) -> DataFrame:
    """Streams of properties with their scope, the length of their header (null where none is expected) and what reading them came to."""
    s = streams.where(F.col("name") == PROPERTIES)
    s = s if "scope" in s.columns else s.withColumn("scope", codes.scope(F.concat("parent", F.lit("/"), "name")))
    s = s.withColumn("header", codes.header_length(F.col("scope")))
    outcome = F.when(F.col("scope") == "named_properties", "unexpected_scope").when(F.col("data").isNull(), "read_error").when(F.octet_length("data") < F.col("header"), "too_short").otherwise("read")
    return s.withColumn("outcome", outcome).withColumn("trailing", (F.col("outcome") == "read") & ((F.octet_length("data") - F.col("header")) % 16 != 0))


def property_rows(streams: DataFrame) -> DataFrame:
    """(file, parent, scope, property_type, property_id, flags, word) of all entries that could be read; word is the number of the 8 bytes
    after the head. An entry is a row before it is decoded, as functions over arrays aren't compiled."""
    s = property_streams(streams).where("outcome = 'read'").withColumn("count", F.floor((F.octet_length("data") - F.col("header")) / 16).cast("int"))
    e = s.where("count > 0").select("file", "parent", "scope", "data", "header", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("i"))
    at = F.col("header") + F.col("i") * 16 + 1
    e = e.select("file", "parent", "scope", codes.word(F.substr("data", at, F.lit(8))).alias("head"), codes.word(F.substr("data", at + 8, F.lit(8))).alias("word"))
    return e.select("file", "parent", "scope", codes.bits(F.col("head"), 0, 16).cast("int").alias("property_type"), codes.bits(F.col("head"), 16, 16).cast("int").alias("property_id"), codes.bits(F.col("head"), 32, 32).alias("flags"), "word")


def texts_of(streams: DataFrame, pages: DataFrame) -> DataFrame:
    """(file, path, size, data, text, replaced, status) of the streams that could be read: what their bytes say by the type that their
    name ends in. Only 8-bit strings meet their code page and Python."""
    held = streams.where(F.col("data").isNotNull()).select("file", F.concat("parent", F.lit("/"), "name").alias("path"), F.octet_length("data").alias("size"), "data")
    eight = F.endswith("path", F.lit("001E"))
    decoded = held.where(eight).join(pages, "file", "left").withColumn("eight", codes.decoded(F.col("data"), F.col("page"))).select(*held.columns, "eight.text", "eight.replaced", "eight.status")
    unicode = F.when(F.endswith("path", F.lit("001F")), codes.utf16_text(F.col("data")))
    return held.where(~eight).select(*held.columns, unicode.alias("text"), F.lit(None).cast("int").alias("replaced"), F.lit(None).cast("string").alias("status")).unionByName(decoded)


def values(rows: DataFrame, streams: DataFrame, pages: DataFrame) -> DataFrame:
    """Variable-length entries with the stream that holds their value (null where it lacks), its text where it is one, and what is wrong
    with it. pages: (file, page), the code page of 8-bit strings."""
    kind, size = F.col("property_type"), F.col("size")
    v = rows.withColumn("declared", codes.bits(F.col("word"), 0, 32)).where((codes.type_shape(kind) == "variable") & (kind != OBJECT) & (F.col("declared") != SENTINEL))
    v = v.select("file", codes.stream_path(F.col("parent"), F.col("property_id"), kind).alias("path"), "property_type", "declared")
    both = v.join(texts_of(streams, pages), ["file", "path"], "left")
    return both.select(
        "file", "path", "property_type", "data", "text", "replaced", "status",
        size.isNull().alias("missing"), (codes.declared_size(kind, size) != F.col("declared")).alias("size_differs"), ((kind == 0x1F) & (size % 2 == 1)).alias("odd"),
        ((kind == 0x1F) & (size % 2 == 0) & F.col("text").isNull() & size.isNotNull()).alias("no_text"), ((kind == 0x48) & (size != 16)).alias("no_clsid"),
    )


def named(rows: DataFrame, streams: DataFrame) -> DataFrame:
    """Entries of named properties with their set's kind, name or number, and what is wrong: (file, property_id, set_kind, is_string, text, index_differs)."""
    one = lambda name: F.max(F.when(F.col("name") == name, F.col("data")))
    maps = streams.where((F.col("parent") == NAMED) & F.col("name").isin(GUIDS, ENTRIES, STRINGS)).groupBy("file").agg(one(GUIDS).alias("guids"), one(ENTRIES).alias("table"), one(STRINGS).alias("strings"))
    n = rows.where(F.col("property_id") >= 0x8000).select("file", "property_id").join(maps, "file").withColumn("at", (F.col("property_id") - 0x8000) * 8)
    n = n.where(F.col("at") + 8 <= F.octet_length("table")).withColumn("word", codes.word(F.substr("table", F.col("at") + 1, F.lit(8))))
    n = n.withColumns({"id": codes.bits(F.col("word"), 0, 32), "raw": codes.bits(F.col("word"), 32, 32)})
    is_string, set_index, index = codes.named_entry(F.col("raw"))
    # What string_at does, step by step, as what stands in another several times is made as often.
    n = n.withColumn("size", F.when(is_string, codes.little_endian(F.col("strings"), (F.col("id") + 1).cast("int"), 4))).withColumn("piece", codes.piece_at(F.col("strings"), F.col("id"), F.col("size")))
    known = F.floor(F.coalesce(F.octet_length("guids"), F.lit(0)) / 16)
    which = F.when(set_index == 1, "PS_MAPI").when(set_index == 2, "PS_PUBLIC_STRINGS").when((set_index >= 3) & (set_index < 3 + known), "table").otherwise("out_of_range")
    return n.select("file", "property_id", which.alias("set_kind"), is_string.alias("is_string"), codes.utf16_text(F.col("piece")).alias("text"), (index != F.col("property_id") - 0x8000).alias("index_differs"))


def checksum(c: Column) -> Column:
    """Sum of 64-bit numbers modulo 2^64, signed: the sum itself as long as it fits, which that of many large values doesn't."""
    low = F.pmod(F.sum(c.cast("decimal(20,0)")), F.lit(Decimal(1 << 64)))
    return F.when(low >= F.lit(Decimal(1 << 63)), low - F.lit(Decimal(1 << 64))).otherwise(low).cast("long")


def checks(streams: DataFrame, pages: DataFrame, storages: DataFrame) -> DataFrame:
    """GATES and what was read beside them, one row. storages: (file, shape), the embedded objects' storages, message or custom."""
    # Streams are made once and lie apart by what they are for.
    use = F.when(F.col("name") == PROPERTIES, "properties").when(F.col("parent") == NAMED, "named").otherwise("value")
    scope = F.when(F.col("name") == PROPERTIES, codes.scope(F.concat("parent", F.lit("/"), "name")))
    kept = stash(streams.withColumns({"use": use, "scope": scope}), "streams", "use")
    of = lambda x: kept.where(F.col("use") == x).drop("use")
    rows = stash(property_rows(of("properties")).drop("flags"), "properties")
    n = lambda c: F.count_if(c)
    outcome, fixed = F.col("outcome"), codes.fixed_word(F.col("property_type"), F.col("word"))
    of_streams = counted(
        property_streams(of("properties")), properties_stream_too_short_for_header_total=n(outcome == "too_short"), properties_stream_trailing_bytes_total=n(F.col("trailing")),
        properties_stream_unexpected_scope_total=n(outcome == "unexpected_scope"), properties_stream_read_errors=n(outcome == "read_error"),
    )
    attached: Column = (F.col("scope") == "attachment") & (F.col("property_id") == ATTACHED) & (F.col("property_type") == OBJECT)
    size, reserved = codes.bits(F.col("word"), 0, 32), codes.bits(F.col("word"), 32, 32)
    odd = lambda c: c.isNotNull() & (F.isnan(c) | (F.abs(c) == float("inf")))
    of_rows = counted(
        rows.withColumn("v", fixed), attach_data_object_size_sentinel_mismatches=n(attached & (size != SENTINEL)), as_message=n(attached & (reserved == 1)), as_storage=n(attached & (reserved == 4)),
        fixed_boolean_invalid_encoding_total=n((F.col("property_type") == 11) & ~codes.valid_boolean(F.col("word"))), fixed_float_non_finite_total=n(odd(F.col("v.as_double"))), entries_read=F.count("*"),
        whole_numbers=checksum(F.when(F.col("property_type").isin(2, 3, 20, 64), F.col("v.as_long"))), halves=F.sum(F.when(~odd(F.col("v.as_double")), F.col("v.as_double") * 4)).cast("long"),
    )
    shapes = counted(storages, messages=n(F.col("shape") == "message"), customs=n(F.col("shape") == "custom"))
    of_values = counted(
        values(rows, of("value"), pages), variable_value_stream_missing_total=n(F.col("missing")), variable_value_size_mismatch_total=n(F.col("size_differs")), variable_value_odd_utf16_length_total=n(F.col("odd")),
        variable_unicode_decode_errors_total=n(F.col("no_text")), variable_string8_undefined_byte_total=F.sum("replaced"), variable_string8_unsupported_codepage_total=n(F.col("status") == "unsupported"),
        variable_string8_ascii_under_unsupported_codepage_total=n(F.col("status") == "ascii"), variable_clsid_wrong_length_total=n(F.col("no_clsid")), text_characters=F.sum(F.char_length("text")),
    )
    of_names = counted(
        named(rows, of("named")), named_properties_guid_out_of_range_total=n(F.col("set_kind") == "out_of_range"), named_properties_string_decode_errors_total=n(F.col("is_string") & F.col("text").isNull()),
        named_properties_index_mismatch_total=n(F.col("index_differs")), named_characters=F.sum(F.char_length("text")),
    )
    both = of_streams.crossJoin(of_rows).crossJoin(shapes).crossJoin(of_values).crossJoin(of_names)  # one row each
    both = both.withColumn(GATES[5], F.col("as_message") - F.col("messages")).withColumn(GATES[6], F.col("as_storage") - F.col("customs"))
    more = ("entries_read", "whole_numbers", "halves", "text_characters", "variable_string8_ascii_under_unsupported_codepage_total", "named_characters")
    return both.select(*(F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in (*GATES, *more)))

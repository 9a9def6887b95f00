"""Chat formatting: a compiled template renders conversations and marks the text that a model is to be trained on.

Rows of one conversation meet in one partition and are rendered in order as a stream: a conversation of any length is held
one turn at a time, and its output is cut into segments of about SEGMENT characters.

Defined results: null text or role counts as empty; rows with equal turn are ordered by role and text, repeated rows are
kept as turns of their own; rows without conv_id form one conversation with a null id; an empty table gives no rows;
columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import table
from postmill.llm.template import compile_template, text_of

#: Marks of common chat formats, none of which may come from a text. Fixed values.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
TEMPLATE = (
    "{% for m in messages %}" + BEGIN + "{{ m.role | line }}{{ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}" + END + "{% endfor %}"
)
SEGMENT = 1 << 20
SCHEMA = "conv_id long, segment int, text string, loss_spans array<struct<start: int, end: int>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

ESCAPE = re.compile("|".join(re.escape(c) for c in CONTROLS))
TURN = re.compile(re.escape(BEGIN) + r"((?:[^\\\n]|\\.)*)\n(.*)" + re.escape(END), re.S)


def escape(value) -> str:
    r"""Put a backslash after the first character of each control string, having doubled the text's own backslashes."""
    return ESCAPE.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text_of(value).replace("\\", "\\\\"))


def line(value) -> str:
    return escape(value).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def records(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            yield from batch.slice(i, 256).to_pylist()


def segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "segment", "text", "loss_spans"])


def format_conversations(df: DataFrame, template: str = TEMPLATE, segment: int = SEGMENT) -> DataFrame:
    """Rows (conv_id, turn, role, text) to (conv_id, segment, text, loss_spans): the rendered text in segments, which joined in
    order are the conversation, and in each the spans (code points, end exclusive) under the template's generation marker.
    The segments of a conversation follow each other within one partition."""

    def run(batches):
        render = compile_template(template, {"escape": escape, "line": line})
        out: list[tuple] = []
        held = 0
        for conv, rows in groupby(records(batches), key=lambda r: r["conv_id"]):
            parts: list[str] = []
            spans: list[dict] = []
            size = number = 0
            messages = ({"role": r["role"] or "", "text": r["text"] or ""} for r in rows)
            for text, mark in render({"messages": messages}):
                if mark and text:
                    if spans and spans[-1]["end"] == size:
                        spans[-1]["end"] += len(text)
                    else:
                        spans.append({"start": size, "end": size + len(text)})
                parts.append(text)
                size += len(text)
                if size >= segment:
                    yield segment_batch([*out, (conv, number, "".join(parts), spans)])
                    out, held = [], 0
                    parts, spans, size, number = [], [], 0, number + 1
            if parts or not number:
                out.append((conv, number, "".join(parts), spans))
                held += size
            if held >= segment:
                yield segment_batch(out)
                out, held = [], 0
        if out:
            yield segment_batch(out)

    ordered = df.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse the rendered segments again: the digests of each conversation's turns and of its text under the loss mask.
    Works in the partitions of format_conversations, one turn at a time."""

    def run(batches):
        out: list[tuple] = []
        for conv, segments in groupby(records(batches), key=lambda r: r["conv_id"]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = 0
            rest = masked = ""
            for s in segments:
                chars += len(s["text"])
                for span in s["loss_spans"]:
                    masked += s["text"][span["start"] : span["end"]]
                # A text cut by a segment's end may leave half an escape behind.
                keep = (len(masked) - len(masked.rstrip("\\"))) % 2
                plain, masked = unescape(masked[: len(masked) - keep]), masked[len(masked) - keep :]
                loss.update(plain.encode())
                loss_chars += len(plain)
                pieces = (rest + s["text"]).split(END)
                rest = pieces.pop()
                for piece in pieces:
                    role, text = TURN.fullmatch(piece + END).groups()
                    turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    n += 1
            if rest or masked:
                raise ValueError("a conversation ends within a turn")
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) == 1000:
                yield digests(out)
                out = []
        yield digests(out)

    return formatted.mapInArrow(run, DIGESTS)


def digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose turns consist of control strings."""
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(rows.unionByName(extra)))


#: SQL for the digests as the contract defines them from the table itself; formatted_chars counts what the template and the escapes add.
OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '(<\||<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)', '\1+', 'g')) AS text_len,
    length(regexp_replace(replace(role, '\', '\\'), '(<\||<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\n)', '\1+', 'g')) AS role_len FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(12 + role_len + 1 + text_len + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

"""Language-model scoring by cross-entropy difference of two matched bigram models.

The background model counts all documents, the target model the chosen ones; both share the vocabulary of all words and
one smoothing: p(w | h) = (c(h w) + ALPHA) / (c(h) + ALPHA V), h being the word before (or the start), V the number of
distinct words. A document's loss under a model is the mean of -log p over its words, with the document's own counts taken
out of both models, so that a document isn't scored by what the models learnt from it. score = target loss - background
loss: the lower, the more a document is like the target.

Everything goes through counts of hashed keys (one for each history, one for each pair), without a limit on their number. Counts
are exact by key; a key is a hash of 47 bits, so of N distinct keys a share of about N / 1.4e14 is counted together with another
(7e-6 of a thousand million). V is counted exactly, by 64-bit hashes.
1. Documents are dealt to chunks by doc_id; each chunk gives its distinct keys and counts, packed by bucket of key. A word
   in every document costs a chunk one entry, so frequent words make no task large. Rows of a doc_id that more than HEAVY rows
   have, or of those without one, are dealt on by their place in the input.
2. Each bucket adds up the counts of its keys over all chunks and answers each chunk in the order of its keys.
3. Each chunk turns the answers into losses of its documents.

Sizes: a chunk holds chunk_chars characters on average and at least a document, a bucket the keys of bucket_chars; the defaults
suit workers of some hundred MB. Packed rows are one for each chunk and bucket that a chunk has keys of, so never more than
distinct keys of chunks, which are fewer than words. A chunk of C characters has about C / 8 keys, so rows hold 64 keys and more,
and the packing pays, up to C / 512 buckets: 60 GB at the defaults. With N times the memory both sizes can be N times as large,
which carries that to N squared as much (a corpus of 100 TB wants 160 million characters a chunk and 320 million a bucket).

Defined results: null and blank texts have no words, losses null and score null; a missing target set makes the target
model empty (uniform over the vocabulary); repeated rows count as often as they occur and are scored each; rows without
doc_id are in the background only; a text of any length is one document of one chunk; columns other than doc_id and text are ignored; empty in, empty out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import flat, mix, stash, table, word_hashes, words

ALPHA = 0.1
CHUNK_CHARS, BUCKET_CHARS = 4_000_000, 8_000_000
#: Rows of one doc_id from which they are dealt to several chunks; most such ids that are broadcast.
HEAVY, BROADCAST_IDS = 1000, 1_000_000
KEY_BITS = 48
PACKED = "bucket int, chunk int, wide boolean, keys binary, background binary, target binary"
ANSWER = "chunk int, bucket int, n int, background binary, target binary"
SCORES = "doc_id long, n_words long, target_loss double, background_loss double, score double"
START = np.uint64(0x5851F42D4C957F2D)


def keys_of(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the key of its history and the key of the pair; histories are even, pairs odd."""
    history = np.empty_like(values)
    history[1:] = values[:-1]
    history[offsets[:-1][np.diff(offsets) > 0]] = START
    drop = np.uint64(64 - KEY_BITS)
    with np.errstate(over="ignore"):
        pair = mix(mix(history) + values)
    one = np.uint64(1)
    return (mix(history) >> drop) & ~one, (pair >> drop) | one


def distinct(keys: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place of each key among them, counts, and counts where target is set."""
    unique, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return unique, inverse, counts.astype(np.int32), np.bincount(inverse[target], minlength=len(unique)).astype(np.int32)


def bucket_bounds(unique: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys start and end among sorted keys: buckets are ranges of keys."""
    edges = np.array([(k << KEY_BITS) // buckets for k in range(buckets + 1)], dtype=np.uint64)
    return np.searchsorted(unique, edges)


def packed(keys: np.ndarray) -> tuple[bool, bytes]:
    """Sorted keys as differences, four bytes each where they fit."""
    steps = np.diff(keys, prepend=np.uint64(0))
    first, steps = steps[:1], steps[1:]
    wide = bool(len(steps) and steps.max() >= 1 << 32)
    return wide, first.tobytes() + steps.astype(np.uint64 if wide else np.uint32).tobytes()


def unpacked(wide: bool, data: bytes) -> np.ndarray:
    steps = np.frombuffer(data[8:], dtype=np.uint64 if wide else np.uint32)
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], dtype=np.uint64), steps.astype(np.uint64)]), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    """A byte for each count, and eight more for those of 255 and above."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype(np.int64).tobytes()


def unpacked_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, dtype=np.uint8, count=n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data[n:], dtype=np.int64)
    return counts


def chunk_keys(docs: pa.Table, marks: pa.Table):
    """What both passes over a chunk compute: rows, their words' keys, and which words are of target documents."""
    values, offsets = flat(docs["words"])
    wanted = set(marks["doc_id"].to_pylist()) if marks.num_rows else set()
    ids = docs["doc_id"].to_pylist()
    chosen = np.array([i is not None and i in wanted for i in ids], dtype=bool)
    history, pair = keys_of(values, offsets)
    row = np.repeat(np.arange(len(ids)), np.diff(offsets))
    return ids, offsets, row, history, pair, chosen


def cross_entropy_difference(docs: DataFrame, target: DataFrame, alpha: float = ALPHA, chunk_chars: int = CHUNK_CHARS, bucket_chars: int = BUCKET_CHARS, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, text) with the target documents (doc_id) to (doc_id, n_words, target_loss, background_loss, score)."""
    chars, = docs.agg(F.sum(F.char_length("text").cast("long"))).first()
    vocabulary, = docs.select(F.explode(words(F.col("text"))).alias("w")).agg(F.count_distinct(F.xxhash64("w"))).first()  # distinct within each task first
    chunks = max(1, -(-(chars or 0) // chunk_chars))
    buckets = max(1, -(-(chars or 0) // bucket_chars))
    prior = alpha * max(1, vocabulary)

    def chunk(key, part):
        return F.pmod(F.xxhash64(key, part), F.lit(chunks)).cast("int").alias("chunk")

    often = stash(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select(F.col("doc_id").alias("id"), F.ceil(F.col("n") / heavy).cast("int").alias("parts")), "heavy")
    wanted, some = target.select("doc_id").where("doc_id is not null").distinct(), not often.isEmpty()
    rows, marked = docs.select("doc_id", "text"), wanted
    if some:
        side = F.broadcast(often) if often.count() <= BROADCAST_IDS else often
        rows, marked = (df.join(side, F.col("doc_id").eqNullSafe(F.col("id")), "left") for df in (rows, wanted))
    of_row = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("parts")), F.lit(0)) if some else F.lit(0)
    every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)) if some else F.lit(0)
    texts = rows.select(chunk(F.coalesce("doc_id", F.xxhash64("text")), of_row.cast("int")), "doc_id", "text").repartition("chunk").select("chunk", "doc_id", word_hashes(F.col("text")).alias("words"))
    marks = marked.select("doc_id", every.alias("part")).select(chunk("doc_id", "part"), "doc_id").distinct()

    def pack(key, left: pa.Table, right: pa.Table) -> pa.Table:
        _, _, row, history, pair, chosen = chunk_keys(left, right)
        of_target = chosen[row]
        unique, _, background, in_target = distinct(np.concatenate([history, pair]), np.concatenate([of_target, of_target]))
        bounds = bucket_bounds(unique, buckets)
        rows = []
        for b in range(buckets):
            part = slice(bounds[b], bounds[b + 1])
            if part.stop > part.start:
                rows.append((b, key[0].as_py(), *packed(unique[part]), packed_counts(background[part]), packed_counts(in_target[part])))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "chunk", "wide", "keys", "background", "target"])

    def add_up(group: pa.Table) -> pa.Table:
        keys = [unpacked(w, k) for w, k in zip(group["wide"].to_pylist(), group["keys"].to_pylist(), strict=True)]
        unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(k) for k in keys])
        answers = []
        for name in ("background", "target"):
            own = np.concatenate([unpacked_counts(x, len(k)) for x, k in zip(group[name].to_pylist(), keys, strict=True)])
            total = np.bincount(inverse, weights=own, minlength=len(unique)).astype(np.int64)[inverse]
            answers.append(pa.array([packed_counts(x) for x in np.split(total, ends[:-1])], pa.binary()))
        sizes = pa.array([len(k) for k in keys], pa.int32())
        return pa.table([group["chunk"], group["bucket"], sizes, *answers], ["chunk", "bucket", "n", "background", "target"])

    def losses(key, left: pa.Table, right: pa.Table) -> pa.Table:
        marked = right.filter(pa.compute.is_valid(right["doc_id"]))
        answer = right.filter(pa.compute.is_null(right["doc_id"])).sort_by("bucket")
        ids, offsets, row, history, pair, chosen = chunk_keys(left, marked)
        lengths = np.diff(offsets)
        keys = np.concatenate([history, pair])
        unique, inverse = np.unique(keys, return_inverse=True)
        background, wanted = (np.concatenate([unpacked_counts(x, n) for x, n in zip(answer[c].to_pylist(), answer["n"].to_pylist(), strict=True)] or [np.zeros(0, dtype=np.int64)]) for c in ("background", "target"))
        if len(background) != len(unique):
            raise ValueError("a chunk changed between its two passes")
        both = np.concatenate([row, row]).astype(np.int64) * len(unique) + inverse
        _, place, own = np.unique(both, return_inverse=True, return_counts=True)
        own = own[place]
        of_target = np.concatenate([chosen[row], chosen[row]])
        is_pair = np.arange(len(keys)) >= len(history)
        smooth = np.where(is_pair, alpha, prior)
        sign = np.where(is_pair, -1.0, 1.0)
        where = np.concatenate([row, row])
        out = []
        for counts, less in ((wanted[inverse], np.where(of_target, own, 0)), (background[inverse], own)):
            loss = sign * np.log(counts - less + smooth)
            out.append(np.bincount(where, weights=loss, minlength=len(ids)) / np.maximum(lengths, 1))
        none = lengths == 0
        floats = [pa.array(x, pa.float64(), mask=none) for x in (*out, out[0] - out[1])]
        return pa.table([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), *floats], ["doc_id", "n_words", "target_loss", "background_loss", "score"])

    counts = texts.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(pack, PACKED)
    answers = counts.groupBy("bucket").applyInArrow(add_up, ANSWER)
    none = F.lit(None)
    side = answers.select("chunk", none.cast("long").alias("doc_id"), "bucket", "n", "background", "target").unionByName(
        marks.select("chunk", "doc_id", none.cast("int").alias("bucket"), none.cast("int").alias("n"), none.cast("binary").alias("background"), none.cast("binary").alias("target"))
    )
    return texts.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(losses, SCORES)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the target is those labelled as of good quality and not toxic. Losses have six digits, sums being in any order."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    out = cross_entropy_difference(table(spark, sf_dir, "documents").select("doc_id", "text"), good)
    return out.select("doc_id", "n_words", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0), FALSE) AS good FROM documents),
t AS (SELECT row, good, unnest(w) AS w, unnest(list_concat([''], w[:len(w) - 1])) AS h FROM d),
v AS (SELECT count(DISTINCT w) AS v FROM t),
o1 AS (SELECT row, good, h, count(*) AS n FROM t GROUP BY ALL), o2 AS (SELECT row, good, h, w, count(*) AS n FROM t GROUP BY ALL),
c1 AS (SELECT h, sum(n) AS b, coalesce(sum(n) FILTER (good), 0) AS g FROM o1 GROUP BY h), c2 AS (SELECT h, w, sum(n) AS b, coalesce(sum(n) FILTER (good), 0) AS g FROM o2 GROUP BY h, w),
l1 AS (SELECT row, sum(n * ln(b - n + {ALPHA} * v)) AS b, sum(n * ln(g - CASE WHEN good THEN n ELSE 0 END + {ALPHA} * v)) AS g FROM o1 JOIN c1 USING (h), v GROUP BY row),
l2 AS (SELECT row, sum(n * ln(b - n + {ALPHA})) AS b, sum(n * ln(g - CASE WHEN good THEN n ELSE 0 END + {ALPHA})) AS g FROM o2 JOIN c2 USING (h, w) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, round((l1.g - l2.g) / len(w), 6) AS target_loss, round((l1.b - l2.b) / len(w), 6) AS background_loss, round((l1.g - l2.g) / len(w) - (l1.b - l2.b) / len(w), 6) AS score
FROM d LEFT JOIN l1 USING (row) LEFT JOIN l2 USING (row)
"""

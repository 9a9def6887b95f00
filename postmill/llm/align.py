"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often ids meet in a corpus.

Both encode the whole text, a space before it, and their tokens' bytes must join to it. Work goes through Arrow columns, CHUNK_CHARS
of texts (one at least) at a time:
1. The ids of all texts are one flattened list column with the row each token belongs to (parent indices).
2. The tokens' byte lengths, summed up and less what lies before the row, are the tokens' ends in their text.
3. A hash join of both sides on the key (row, end), a full one, gives all ends. Ends of both sides close a group; between two ends
   lies exactly one piece of one token of each side, so each end is one link, of the next tokens that end there or later.
4. group_by gives each row's id pairs and counts, and the chunk's; the task adds up those of its chunks, Spark those of all tasks.
Rows with their pairs are written once; a second pass looks the corpus counts up, nothing is encoded twice.

The second pass broadcasts the most frequent id pairs, FREQUENT at most: all that occur 2^k times or more, for the least k that
keeps to the bound. Rarer pairs, should there be any, are joined by a shuffle; as each is rare, none of them is hot.

A's ids are those of the vocabulary file byte_bpe_50k.json; its ranks are read from there and merged by tiktoken, which gives the
ids of the tokenizers library four times as fast (a test compares them).

Defined results: texts that are null or empty, or that a tokenizer can't give back byte by byte, have no tokens: zeros and an empty
digest; strings of special tokens are plain text; repeated rows are rows each and count each; columns other than doc_id and text
are ignored; empty in, empty out. Memory follows the longest text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import flat, stash, table

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: How A splits texts before it merges: fixed values of this vocabulary.
A_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of texts that are aligned at a time, pairs that a task holds before it passes their counts on.
CHUNK_CHARS, HELD_PAIRS = 1_000_000, 1_000_000
#: Most id pairs that are broadcast with their counts.
FREQUENT = 2_000_000
ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>, pair long, n long"
RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@dataclass
class Side:
    """A tokenizer: texts to lists of ids, the bytes of each id, and each id in decimal before ',', '|' and ';'."""

    encode: Callable[[list[str]], list[list[int]]]
    pieces: pa.Array
    written: pa.Array

    @classmethod
    def of(cls, encode, pieces: list[bytes]) -> Side:
        return cls(encode, pa.array(pieces, pa.large_binary()), pa.array([f"{i}{c}".encode() for i in range(len(pieces)) for c in ",|;"], pa.large_binary()))


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 ones stand for themselves, the rest for the others in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


@lru_cache(2)
def sides(folder: str) -> tuple[Side, Side]:
    """Both tokenizers, loaded once in a process."""
    import sentencepiece
    import tiktoken

    model = json.loads(Path(folder, A_FILE).read_text(encoding="utf-8"))
    special = {t["content"] for t in model["added_tokens"]}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
    merges = tiktoken.Encoding("a", pat_str=A_PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces_a = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        pieces_a[i] = piece
    b = sentencepiece.SentencePieceProcessor(model_file=str(Path(folder, B_FILE)))
    named = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    pieces_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)]
    return Side.of(lambda texts: [merges.encode_ordinary(" " + t) for t in texts], pieces_a), Side.of(lambda texts: b.encode(texts, num_threads=1), pieces_b)


def joined(pieces: pa.Array, ids: pa.Array) -> tuple[np.ndarray, bytes]:
    """Offsets of each id's bytes and all bytes in a row."""
    taken = pieces.take(ids)
    offsets = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, dtype=np.int64)
    return offsets - offsets[0], taken.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if len(taken) else b""


def given_back(side: Side, ids: pa.ListArray, texts: list[str]) -> np.ndarray:
    """Whether the tokens of each text join to it, a space before it."""
    at, data = joined(side.pieces, ids.flatten())
    ends = at[ids.offsets.to_numpy() - ids.offsets[0].as_py()]
    return np.array([data[a:b] == b" " + t.encode() for a, b, t in zip(ends, ends[1:], texts, strict=False)], dtype=bool)


def keys(side: Side, ids: pa.ListArray, span: int) -> tuple[pa.Array, np.ndarray]:
    """Flattened ids, and for each of them its document-end key: row * span + end in the text."""
    values, parent = ids.flatten(), pc.list_parent_indices(ids).to_numpy()
    total = np.cumsum(pc.binary_length(side.pieces).take(values).to_numpy())
    before = np.concatenate([[0], total])[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
    return values, parent * span + (total - before[parent])


def align(texts: list[str], a: Side, b: Side) -> tuple[dict[str, np.ndarray | list], pa.Table]:
    """For each text its columns, and (text, pair, n) of the id pairs that its links join; pair is A's id times B's size plus B's id."""
    out = {k: np.zeros(len(texts), dtype=np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": [""] * len(texts)}
    none = pa.table({"text": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    ids_a, ids_b = (pa.array(side.encode(texts), pa.list_(pa.int32())) for side in (a, b))
    good = given_back(a, ids_a, texts) & given_back(b, ids_b, texts) & np.array([t != "" for t in texts], dtype=bool)
    where = np.flatnonzero(good)
    if not len(where):
        return out, none
    ids_a, ids_b = (x.take(pa.array(where)) for x in (ids_a, ids_b))
    span = 4 * max(map(len, texts)) + 2  # more than the bytes of any text
    flat_a, key_a = keys(a, ids_a, span)
    flat_b, key_b = keys(b, ids_b, span)

    left = pa.table({"key": key_a, "a": np.arange(len(key_a))})
    ends = left.join(pa.table({"key": key_b, "b": np.arange(len(key_b))}), keys="key", join_type="full outer", use_threads=False)
    ends = ends.take(pc.sort_indices(ends["key"]))
    both = pc.and_(pc.is_valid(ends["a"]), pc.is_valid(ends["b"])).to_numpy()
    next_a, next_b = (pc.fill_null_backward(ends[k].combine_chunks()) for k in ("a", "b"))
    close_a, close_b = next_a.to_numpy()[both], next_b.to_numpy()[both]

    row = ends["key"].to_numpy() // span
    out["n_a"][where], out["n_b"][where] = (pc.list_value_length(x).to_numpy() for x in (ids_a, ids_b))
    out["n_groups"][where] = np.bincount(row[both], minlength=len(where))
    out["n_links"][where] = np.bincount(row, minlength=len(where))

    # Each group's tokens of A, then those of B: a token comes after the tokens before it on its side and the other side's of groups closed.
    place_a, place_b = np.arange(len(key_a)), np.arange(len(key_b))
    group_a, group_b = np.searchsorted(close_a, place_a), np.searchsorted(close_b, place_b)
    order_a = place_a + np.concatenate([[0], close_b + 1])[group_a]
    order_b = place_b + close_a[group_b] + 1
    texts_a, texts_b = a.written.take(pa.array(3 * flat_a.to_numpy() + (place_a == close_a[group_a]))), b.written.take(pa.array(3 * flat_b.to_numpy() + 2 * (place_b == close_b[group_b])))
    order = np.empty(len(order_a) + len(order_b), dtype=np.int64)
    order[order_a], order[order_b] = place_a, len(order_a) + place_b
    at, data = joined(pa.concat_arrays([texts_a, texts_b]), pa.array(order))
    cuts = at[np.concatenate([[0], np.cumsum(out["n_a"][where] + out["n_b"][where])])]
    for i, start, end in zip(where.tolist(), cuts, cuts[1:], strict=False):
        out["groups_sha256"][i] = hashlib.sha256(data[start : end - 1]).hexdigest()

    pair = flat_a.to_numpy().astype(np.int64)[next_a.to_numpy()] * len(b.pieces) + flat_b.to_numpy()[next_b.to_numpy()]
    links = pa.table({"text": where[row], "pair": pair}).group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")])
    return out, links.rename_columns(["text", "pair", "n"]).select(["text", "pair", "n"])


def summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"]).select(["pair", "n"])


def chunks(batch: pa.RecordBatch, chars: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with so many characters of text, or one row."""
    total = np.cumsum(pc.fill_null(pc.utf8_length(batch["text"]), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + chars, side="right")))
        yield batch.slice(at, to - at)
        at = to


def row_batch(columns: dict, n: int) -> pa.RecordBatch:
    kinds = {"row": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int32()), "pair": pa.int64(), "n": pa.int64()}
    return pa.RecordBatch.from_arrays([columns[k] if isinstance(columns.get(k), pa.Array) else pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in kinds.items()], list(kinds))


def aligned(docs: DataFrame, folder: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """A row for each document, with its id pairs; and rows (pair, n) of partial corpus counts, which have no other columns."""

    def run(batches):
        a, b = sides(folder)
        held: list[pa.Table] = []
        for batch in batches:
            for part in chunks(batch, chunk_chars):
                found, links = align([t or "" for t in part["text"].to_pylist()], a, b)
                links = links.sort_by([("text", "ascending"), ("pair", "ascending")]).combine_chunks()
                offsets = pa.array(np.searchsorted(links["text"].to_numpy(), np.arange(part.num_rows + 1)), pa.int32())
                lists = {name: pa.ListArray.from_arrays(offsets, links[k].cast(kind).combine_chunks()) for name, k, kind in (("pairs", "pair", pa.int64()), ("times", "n", pa.int32()))}
                yield row_batch({"row": part["row"], "doc_id": part["doc_id"]} | found | lists, part.num_rows)
                held.append(links.select(["pair", "n"]))
                if sum(t.num_rows for t in held) > HELD_PAIRS:
                    held = [summed(held)]
                    if held[0].num_rows > HELD_PAIRS // 2:
                        yield row_batch({"pair": held[0]["pair"].combine_chunks(), "n": held[0]["n"].combine_chunks()}, held.pop().num_rows)
        if held:
            last = summed(held).combine_chunks()
            yield row_batch({"pair": last["pair"].combine_chunks(), "n": last["n"].combine_chunks()}, last.num_rows)

    return stash(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, ROWS), "aligned")


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): corpus counts of id pairs, and whether a pair's is the highest of its B id."""
    counts = stash(rows.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")), "pairs").withColumn("b", F.col("pair") % size_b)
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))  # B's vocabulary at most
    return counts.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def least_count(counts: DataFrame, most: int) -> int:
    """The least power of two from which on so many pairs at most occur."""
    sizes = {r.k: r.n for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}  # 64 at most
    k, seen = max(sizes, default=0) + 1, 0
    while k > 0 and seen + sizes.get(k - 1, 0) <= most:
        k -= 1
        seen += sizes.get(k, 0)
    return 2**k


def alignment(docs: DataFrame, folder: str = TOKENIZERS, frequent: int = FREQUENT, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, text) to RESULT."""
    spark = docs.sparkSession
    rows = aligned(docs, folder, chunk_chars)
    counts = stash(pair_counts(rows, len(sides(folder)[1].pieces)), "counts")
    least = least_count(counts, frequent)
    known = counts.where(F.col("n") >= least).toArrow().sort_by("pair").combine_chunks()
    held = spark.sparkContext.broadcast(tuple(known[k].to_numpy() for k in ("pair", "n", "best")))
    found = rows.where("pair is null").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")

    def looked_up(batch: pa.RecordBatch):
        pairs, offsets = flat(batch["pairs"], np.int64)
        times = flat(batch["times"], np.int32)[0].astype(np.int64)
        known, n, best = held.value
        at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
        hit = known[at] == pairs if len(known) else np.zeros(len(pairs), dtype=bool)
        return pairs, offsets, times, at, hit, n, best

    def run(batches):
        for batch in batches:
            _, offsets, times, at, hit, n, best = looked_up(batch)
            sums = [np.concatenate([[0], np.cumsum(times[hit] * x[at[hit]])]) for x in (best, n)]
            upto = np.concatenate([[0], np.cumsum(hit)])[offsets]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in batch.schema.names[:7]), *(pa.array(np.diff(s[upto])) for s in sums)], [*batch.schema.names[:7], "n_best", "count_sum"])

    def unknown(batches):
        for batch in batches:
            pairs, offsets, times, _, hit, _, _ = looked_up(batch)
            row = np.repeat(batch["row"].to_numpy(), np.diff(offsets))
            yield pa.RecordBatch.from_arrays([pa.array(x[~hit]) for x in (row, pairs, times)], ["row", "pair", "times"])

    out = found.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    if least > 1:
        rare = found.mapInArrow(unknown, "row long, pair long, times long").join(counts.where(F.col("n") < least), "pair")
        rare = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
        out = out.join(rare, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    return out.select(RESULT)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))

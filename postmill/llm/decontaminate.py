"""Benchmark decontamination: SimHash fingerprints of item-sized windows, a multi-index over blocks of bits, exact verification.

For an item of L words every window of L words of a document is a place where the item may stand. The SimHash of a window
sums +1 or -1 for each of BITS bits of each word's hashes; its signs are the fingerprint. Fingerprints are cut into BLOCKS
blocks of 16 bits. Two that differ in at most RADIUS bits differ in at most RADIUS // BLOCKS = 3 bits of one block at least. So
the index holds each block of each item's fingerprint with up to ITEM_FLIPS bits flipped, and a window looks up each of its
blocks with up to WINDOW_FLIPS bits flipped: together that finds all items within the radius, and about a tenth of the rest,
which their distance tells apart. What is within the radius is verified exactly: the weighted Jaccard similarity of the
five-word shingles of window and item (weights: how often a shingle stands there) must reach the threshold.

Windows that can't reach the threshold with any item of their size, because too few of their shingles occur in such items at
all, get no fingerprint. This loses nothing and is decided for all windows of a document at once.

The fingerprints' distance estimates the similarity. The hardest windows at 0.8 are those whose passage is cut off or overwritten
at an end, a ninth of the shingles differing in one run; of these RECALL and more are within the radius (measured in the tests:
of 13 to 300 words at most 2 in 1,000 lie beyond it; copies and passages with single words changed practically never do).

The items are the fixed side. Up to BLOCK_WORDS words of them are broadcast and held against all documents in one scan. Larger
benchmarks take two steps: one scan keeps the documents with a run of words that a filter of all items' shingles (FILTER_BITS,
whatever their number) knows, which loses nothing either; what is kept is written and held against the items, BLOCK_WORDS at a
time (a larger item by itself). Of a long document FEW windows at a time have votes in memory, whatever the items' length.

Defined results: null and blank texts match nothing, nor do null or blank items; an item longer than a document is held
against the whole document; items of fewer than five words match only word by word; repeated rows give repeated rows;
columns other than doc_id, text, item_id and text of the items are ignored; empty in, empty out.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import SHINGLE, SIMILAR, flat, mix, shingles, stash, table, word_hashes

BITS, BLOCKS, RADIUS, ITEM_FLIPS, WINDOW_FLIPS = 128, 8, 31, 1, 2
#: Least share of the hardest windows at similarity 0.8 that are within the radius.
RECALL = 0.995
BLOCK_WORDS, FEW, PROBES = 1_000_000, 4096, 256
LOOKUP_BITS, FILTER_BITS, FILTER_PIECE = 22, 27, 1 << 17
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, distance int, similarity double"


def bit_votes(words: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for the bits of each word's mixed hashes."""
    both = np.stack([mix(words), mix(words ^ np.uint64(0x9E3779B97F4A7C15))], axis=1)
    return np.unpackbits(both.view(np.uint8).reshape(len(words), BITS // 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def fingerprints_of(votes: np.ndarray) -> np.ndarray:
    """Fingerprints, two 64-bit numbers a row, from summed votes; a tie counts as a zero bit."""
    return np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64).reshape(-1, BITS // 64)


def summed_votes(words: np.ndarray) -> np.ndarray:
    return sum((bit_votes(words[at : at + FEW]).sum(axis=0) for at in range(0, len(words), FEW)), np.zeros(BITS, dtype=np.int64))


def window_fingerprints(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows at some starts (in order): the first of each FEW starts is summed up, the others take what comes
    in and give back what goes out."""
    out, at = [], 0
    while at < len(starts):
        low = int(starts[at])
        part = starts[at : int(np.searchsorted(starts, low + FEW))]
        high = int(part[-1])
        change = bit_votes(words[low + size : high + size]) - bit_votes(words[low:high])
        sums = summed_votes(words[low : low + size]) + np.concatenate([np.zeros((1, BITS), dtype=np.int64), np.cumsum(change, axis=0)])
        out.append(fingerprints_of(sums[part - low]))
        at += len(part)
    return np.concatenate(out) if out else np.zeros((0, BITS // 64), dtype=np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


@lru_cache(4)
def flips(most: int) -> np.ndarray:
    """16-bit masks of up to so many bits."""
    return np.array([sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(16), n)], dtype=np.uint16)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger multiplicities of two sorted arrays of shingles."""
    x, m = np.unique(a, return_counts=True)
    y, n = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(m[i], n[j]).sum())
    return both / max(1, len(a) + len(b) - both)


class Items:
    """Items of one size: shingles, fingerprints, and for each block of bits a sorted list of (value, item)."""

    def __init__(self, size: int, ids: list[int], words: list[np.ndarray]):
        self.size, self.ids = size, ids
        self.gram = min(size, SHINGLE)
        self.shingles = [shingles(w, np.array([0, size]), self.gram)[0] for w in words]
        self.prints = np.concatenate([fingerprints_of(summed_votes(w)[None, :]) for w in words])
        self.index = []
        for block in self.prints.view(np.uint16).reshape(len(ids), BLOCKS).T:
            values = (block[:, None] ^ flips(ITEM_FLIPS)).ravel()
            order = np.argsort(values, kind="stable")
            self.index.append((values[order], (order // len(flips(ITEM_FLIPS))).astype(np.int32)))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (window, item, distance) with at most RADIUS different bits."""
        found = [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(prints), PROBES):
            blocks = np.ascontiguousarray(prints[at : at + PROBES]).view(np.uint16).reshape(-1, BLOCKS)
            for block, (values, items) in zip(blocks.T, self.index, strict=True):
                key = (block[:, None] ^ flips(WINDOW_FLIPS)).ravel()
                a, b = np.searchsorted(values, key, "left"), np.searchsorted(values, key, "right")
                window = np.repeat(np.arange(len(key)) // len(flips(WINDOW_FLIPS)), b - a) + at
                place = np.arange(len(window)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
                pairs = np.unique(window * len(self.ids) + items[place])
                w, i = np.divmod(pairs, len(self.ids))
                found.append(pairs[distances(prints[w], self.prints[i]) <= RADIUS])
        w, i = np.divmod(np.unique(np.concatenate(found)), len(self.ids))
        return w, i, distances(prints[w], self.prints[i])

    def needed(self, width: int, threshold: float) -> int:
        """Fewest shingles that a window of `width` shingles has of an item of similarity at least the threshold."""
        return int(np.ceil(threshold * (width + self.size - self.gram + 1) / (1 + threshold) - 1e-6))


def full_windows(place: np.ndarray, windows: int, width: int, need: int) -> np.ndarray:
    """Starts of the windows, each of `width` places, that hold at least `need` of some places (in order)."""
    first, last = place[: max(0, len(place) - need + 1)], place[need - 1 :]
    close = last - first < width
    low, high = np.maximum(0, last[close] - width + 1), np.minimum(windows - 1, first[close])
    low, high = low[low <= high], high[low <= high]
    if not len(low):
        return low
    low = np.maximum(low, np.append(0, np.maximum.accumulate(high)[:-1] + 1))  # what earlier ranges hold
    counts = np.maximum(0, high - low + 1)
    return np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Benchmark:
    """Items by size, and which sizes of items have which shingles."""

    def __init__(self, ids: list[int], words: list[np.ndarray]):
        sizes: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            sizes.setdefault(len(w), []).append(k)
        self.sizes = [Items(n, [ids[k] for k in ks], [words[k] for k in ks]) for n, ks in sorted(sizes.items())]
        self.grams = {}
        for g in sorted({s.gram for s in self.sizes}):
            parts = [(np.unique(np.concatenate(s.shingles)), at) for at, s in enumerate(self.sizes) if s.gram == g]
            keys, owners = np.concatenate([p for p, _ in parts]), np.repeat([at for _, at in parts], [len(p) for p, _ in parts])
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << LOOKUP_BITS, dtype=bool)
            seen[keys >> np.uint64(64 - LOOKUP_BITS)] = True
            self.grams[g] = (seen, keys[order], owners[order])

    def search(self, doc_ids: list[int], values: np.ndarray, offsets: np.ndarray, threshold: float) -> list[tuple]:
        """Hits (doc_id, item_id, start, size, distance, similarity): the best window of each document and item."""
        hits = []
        for gram, (seen, keys, owners) in self.grams.items():
            hashes, bounds = shingles(values, offsets, gram)
            maybe = np.flatnonzero(seen[hashes >> np.uint64(64 - LOOKUP_BITS)])
            a, b = np.searchsorted(keys, hashes[maybe], "left"), np.searchsorted(keys, hashes[maybe], "right")
            place = np.repeat(maybe, b - a)
            owner = owners[np.arange(len(place)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]
            row = np.searchsorted(bounds, place, "right") - 1
            order = np.lexsort((place, owner, row))
            row, owner, place = row[order], owner[order], place[order]
            starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (owner[1:] != owner[:-1]))) if len(row) else []
            for i, j in zip(starts, [*starts[1:], len(row)], strict=True) if len(row) else ():
                r, items = row[i], self.sizes[owner[i]]
                words, own = values[offsets[r] : offsets[r + 1]], hashes[bounds[r] : bounds[r + 1]]
                hits += self.compare(items, doc_ids[r], words, own, place[i:j] - bounds[r], threshold)
        return hits

    @staticmethod
    def compare(items: Items, doc_id: int, words: np.ndarray, own: np.ndarray, place: np.ndarray, threshold: float) -> list[tuple]:
        size = min(items.size, len(words))
        width = max(1, size - items.gram + 1)
        starts = full_windows(place, len(words) - size + 1, width, items.needed(width, threshold))
        best: dict[int, tuple] = {}
        for part in range(0, len(starts), FEW):
            some = starts[part : part + FEW]
            w, i, d = items.within(window_fingerprints(words, some, size))
            for window, item, distance in zip(w.tolist(), i.tolist(), d.tolist(), strict=True):
                at = int(some[window])
                similarity = weighted_similarity(own[at : at + width], items.shingles[item])
                if similarity >= threshold and (item not in best or (-similarity, at) < best[item][0]):
                    best[item] = ((-similarity, at), (doc_id, items.ids[item], at, size, distance, similarity))
        return [hit for _, hit in best.values()]


def least_run(widths: list[int], threshold: float) -> int:
    """So many places in a row at least that a window's shingles share with an item that it reaches the threshold with: of `width`
    shingles those not shared cut the others into that many runs and one."""
    runs = []
    for width in widths:
        need = int(np.ceil(2 * threshold * width / (1 + threshold) - 1e-6))
        runs.append(-(-need // (width - need + 1)))
    return min(runs)


def shingle_filter(hashed: DataFrame, gram: int) -> np.ndarray:
    """Bits for the leading bits of all shingles of some items, put together in tasks; of fixed size, however many items there are."""

    def mark(batches):
        for batch in batches:
            values, _ = shingles(*flat(batch["words"]), gram)
            places = np.unique(values >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            piece, starts = np.unique(places // (FILTER_PIECE * 8), return_index=True)
            parts = []
            for p, some in zip(piece, np.split(places, starts[1:]), strict=True):
                bits = np.zeros(FILTER_PIECE * 8, dtype=bool)
                bits[some - p * FILTER_PIECE * 8] = True
                parts.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(parts, pa.binary())], ["piece", "bits"])

    def join(group: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in group["bits"].to_pylist()])
        return pa.table([group["piece"][:1], pa.array([bits.tobytes()], pa.binary())], ["piece", "bits"])

    out = np.zeros(1 << FILTER_BITS >> 3, dtype=np.uint8)
    kind = "piece long, bits binary"
    for r in hashed.select("words").mapInArrow(mark, kind).groupBy("piece").applyInArrow(join, kind).toLocalIterator():
        out[r.piece * FILTER_PIECE : (r.piece + 1) * FILTER_PIECE] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def maybe_contaminated(texts: DataFrame, hashed: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, words) of the documents that have a run of shingles that the items' filter knows, long enough for any item."""
    spark = texts.sparkSession
    sizes = [r.n for r in hashed.select(F.least(F.size("words"), F.lit(10_000)).alias("n")).distinct().collect()]  # 10,000 numbers at most
    filters = {g: (shingle_filter(hashed.where(F.size("words") >= SHINGLE if g == SHINGLE else F.size("words") == g), g), least_run([n - g + 1 for n in sizes if min(n, SHINGLE) == g], threshold)) for g in {min(n, SHINGLE) for n in sizes}}
    held = spark.sparkContext.broadcast(filters)

    def known(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        good = np.zeros(len(offsets) - 1, dtype=bool)
        for gram, (bits, run) in held.value.items():
            hashes, bounds = shingles(values, offsets, gram)
            at = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            sums = np.append(0, np.cumsum(hit))
            short = np.diff(bounds)
            for row in np.flatnonzero(~good & (short > 0)):
                a, b, r = bounds[row], bounds[row + 1], min(run, int(short[row]))
                good[row] = bool((sums[a + r : b + 1] - sums[a : b - r + 1] >= r).any())
        return good

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield part.filter(pa.array(known(*flat(part["words"]))))

    return texts.mapInArrow(run, texts.schema)


def find_items(docs: DataFrame, items: DataFrame, threshold: float = SIMILAR, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, text) against (item_id, text): a row for each document and item found in it, with the best window."""
    spark = docs.sparkSession
    hashed = items.select("item_id", word_hashes(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    total, longest = hashed.agg(F.sum(F.size("words").cast("long")), F.max(F.size("words"))).first()
    if not total:
        return spark.createDataFrame([], SCHEMA)
    texts = docs.select("doc_id", word_hashes(F.col("text")).alias("words"))
    blocks = 1
    if total > block_words:
        blocks = -(-2 * total // block_words)
        hashed = stash(hashed, "items")
        texts = stash(maybe_contaminated(texts, hashed, threshold), "maybe")
    found = []
    for block in range(blocks):
        rows = hashed.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == block).collect()  # block_words or so at most
        if not rows:
            continue
        rows.sort(key=lambda r: (r.item_id is None, r.item_id, r.words))
        held = spark.sparkContext.broadcast(([r.item_id for r in rows], [np.array(r.words, dtype=np.int64).view(np.uint64) for r in rows]))

        def run(batches, held=held):
            bench = Benchmark(*held.value)
            for batch in batches:
                hits = []
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    hits += bench.search(part["doc_id"].to_pylist(), *flat(part["words"]), threshold)
                columns = list(zip(*hits, strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"])

        part = texts.mapInArrow(run, SCHEMA)
        if blocks > 1:  # one block at a time: its result is written and its broadcast goes before the next
            part = stash(part, "found")
            held.destroy()
        found.append(part)
    return reduce(DataFrame.union, found)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

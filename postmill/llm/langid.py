"""Language identification by cross-parsing entropy: the language in whose text the fewest longest matches make up the document.

Each language has a training text and its suffix automaton, which accepts exactly the strings that occur in that text. A document is
cut into phrases from its start: each phrase is the longest match in the training text, and the next begins after it (a byte that
the text lacks is a phrase by itself). Of a text of n bytes in c phrases, c log2(N) / n estimates the bits a byte costs one who knows
the N bytes of training text; the language of the least wins, ties go to the first by name.

Texts are lower-cased, other ASCII than letters becomes one blank between words, and what is matched are UTF-8 bytes, so every script
has a small alphabet. All bytes of a text are read.

The automaton is completed: from each state each byte leads to the state of the longer match, or to the state of that byte alone
with a mark that a phrase has ended. So a text is followed by table lookups; a batch's texts and all languages are followed side by
side, and the last FEW of a batch, the longest, one by one.

Training: PIECES pieces of PIECE characters for each language, from the rows with the lowest hash of doc_id among those that may be
learnt from; PIECES is lowered where more than ALL_PIECES would be needed together. The pieces, bounded by that, reach the driver;
the automata are built there and broadcast.

Defined results: null texts and texts without a letter are `und`, score 0; so is every text where nothing was learnt from. score is
1 - (bits of the best / bits of the next best), 1 where one language is known. Repeated rows are rows each; rows without doc_id are
predicted, not held out and not learnt from; columns other than doc_id, text and lang are ignored; empty in, empty out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.llm.common import table

#: Pieces of a language's training text, pieces of all languages together, characters of a piece.
PIECES, ALL_PIECES, PIECE = 128, 1024, 256
#: Texts of a batch that are followed side by side, and how many may be left when the rest is followed one by one.
LANES, FEW = 4096, 8
NO_LANGUAGE = "und"
LETTER = regex.compile(r"\p{L}")
BLANKED = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Between pieces: occurs in no document, so no match goes on across it.
BREAK = 0


def folded(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(BLANKED).split())


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of each state by byte, state 0 first: paths from it spell exactly the substrings of the text."""
    steps: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for byte in text:
        new, at = len(steps), last
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        while at >= 0 and byte not in steps[at]:
            steps[at][byte] = new
            at = link[at]
        if at >= 0:
            to = steps[at][byte]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(steps)
                steps.append(dict(steps[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and steps[at].get(byte) == to:
                    steps[at][byte] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return steps


@dataclass
class Parser:
    """All languages' completed automata in one table. codes: the column of each byte, 0 for bytes in no training text.
    table[state * columns + code] is twice the place where the next state's row begins, plus 1 if a phrase ends before the byte."""

    names: list[str]
    sizes: list[int]
    codes: np.ndarray
    roots: np.ndarray
    table: np.ndarray

    @classmethod
    def of(cls, texts: dict[str, bytes]) -> Parser:
        names = sorted(texts)
        used = sorted({b for t in texts.values() for b in t} - {BREAK})
        codes = np.zeros(256, dtype=np.uint8)
        codes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        parts, roots, base = [], [], 0
        for name in names:
            steps = suffix_automaton(texts[name])
            part = np.full((len(steps), width), -1, dtype=np.int64)
            for state, to in enumerate(steps):
                for byte, target in to.items():
                    if byte != BREAK:
                        part[state, codes[byte]] = 2 * (base + target) * width
            alone = np.where(part[0] < 0, 2 * base * width, part[0]) + 1  # the phrase before has ended; this byte begins one
            missing = part < 0
            part[missing] = np.broadcast_to(alone, part.shape)[missing]
            part[0] = alone  # at the root no phrase is open: counting the one that begins is the same
            parts.append(part.ravel())
            roots.append(base * width)
            base += len(steps)
        table = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        return cls(names, [len(texts[n]) for n in names], codes, np.array(roots), table.astype(np.int32) if 2 * base * width < 2**31 else table)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): how many phrases each text is cut into."""
        out = np.zeros((len(texts), len(self.names)), dtype=np.int64)
        for at in range(0, len(texts), LANES):
            out[at : at + LANES] = self.side_by_side(texts[at : at + LANES])
        return out

    def side_by_side(self, texts: list[bytes]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = self.codes[np.frombuffer(b"".join(texts), dtype=np.uint8)]
        starts = (np.cumsum(lengths) - lengths)[order]
        ends = np.sort(lengths)  # how many texts are left at step t: those longer than t
        n, languages = len(texts), len(self.names)
        state = np.tile(self.roots[:, None], (1, n)).astype(self.table.dtype)
        count = np.zeros((languages, n), dtype=self.table.dtype)
        t = 0
        while (left := n - int(np.searchsorted(ends, t, side="right"))) > FEW:
            upto = int(ends[n - left])  # until the next text ends
            here, total = state[:, :left], count[:, :left]
            place = starts[:left] + t
            for _ in range(upto - t):
                here += flat[place]
                here[:] = self.table[here]
                total += here & 1
                here >>= 1
                place += 1
            t = upto
        for lane in range(left):
            rest = flat[starts[lane] + t : starts[lane] + lengths[order[lane]]].tobytes()
            for k in range(languages):
                count[k, lane] += self.one(rest, int(state[k, lane]))
        out = np.empty((n, languages), dtype=np.int64)
        out[order] = count.T
        return out

    def one(self, codes: bytes, state: int) -> int:
        step, n = memoryview(self.table), 0
        for c in codes:
            to = step[state + c]
            n += to & 1
            state = to >> 1
        return n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        known = [i for i, t in enumerate(texts) if self.names and t and LETTER.search(t)]
        names, score = [NO_LANGUAGE] * len(texts), np.zeros(len(texts))
        cut = [folded(texts[i]) for i in known]
        bits = self.phrases(cut) * np.log2(np.maximum(2, self.sizes)) / np.maximum(1, [len(c) for c in cut])[:, None]
        best = bits.argmin(axis=1) if self.names else []
        next_best = np.sort(bits, axis=1)[:, 1] if len(self.names) > 1 else None
        for row, i in enumerate(known):
            names[i] = self.names[best[row]]
            score[i] = 1.0 if next_best is None else 1 - bits[row, best[row]] / next_best[row] if next_best[row] else 0.0
        return names, score


def may_learn(doc_id: F.Column) -> F.Column:
    """Rows that may be learnt from: crc32 of doc_id as text, modulo 4, is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def training_pieces(docs: DataFrame, pieces: int, all_pieces: int, piece: int) -> DataFrame:
    """(lang, piece): of each language the pieces of the rows with the lowest hash. Of long texts a piece begins anywhere, by the hash."""
    rows = docs.where(may_learn(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "doc_id", "text")
    languages = max(1, rows.select("lang").distinct().count())
    h = F.xxhash64("doc_id", F.lit(1))
    start = F.pmod(h, F.greatest(F.lit(1), F.char_length("text") - piece + 1)).cast("int")
    cut = rows.select("lang", "doc_id", h.alias("h"), F.substring(F.col("text"), start + 1, F.lit(piece)).alias("piece"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id", "piece"))
    kept = cut.withColumn("place", place).where(F.col("place") <= max(1, min(pieces, all_pieces // languages)))
    return kept.orderBy("place", "lang").limit(all_pieces).select("lang", "piece")


def fit(docs: DataFrame, pieces: int = PIECES, all_pieces: int = ALL_PIECES, piece: int = PIECE) -> Parser:
    """docs: (doc_id, text, lang)."""
    found: dict[str, list[bytes]] = {}
    for r in sorted(training_pieces(docs, pieces, all_pieces, piece).collect(), key=lambda r: (r.lang, r.piece)):  # all_pieces at most
        found.setdefault(r.lang, []).append(folded(r.piece))
    texts = {lang: bytes([BREAK]).join(p for p in parts if p) for lang, parts in found.items()}
    return Parser.of({lang: t for lang, t in texts.items() if t})


def predict(docs: DataFrame, parser: Parser) -> DataFrame:
    """(doc_id, text) to (doc_id, held_out, lang_pred, score)."""
    held = docs.sparkSession.sparkContext.broadcast(parser)  # all_pieces bounds its size

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, LANES):
                part = batch.slice(at, LANES)
                names, score = held.value.predict(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(~may_learn(F.col("doc_id")), F.lit(False)).alias("held_out")
    return docs.select("doc_id", held_out, "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))

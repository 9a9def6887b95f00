"""Ranked lexical search: the best documents of each item by an integer BM25, scored once for each class of equal bags.

1. A document is restricted to the words of the items: its bag is the sorted ids of the terms that some item holds, with their
   counts. Terms that no item holds count for the document's length only. N, L and the terms' document counts cover all rows.
2. Documents of one length class m whose bags are equal score equally for every item. They meet by a 64-bit hash, and the whole
   bags are compared, so a collision of hashes joins nothing. TOP members of a class, those of the smallest doc_id, are all
   that a result can hold; tasks drop the others before the shuffle, so a class of a third of all rows is small.
3. Each task scores its classes once against all items, by postings from terms to items, and expands a class that is good
   enough into its members by ascending doc_id. It keeps the TOP best documents of each item; these are ranked at last.

Items are taken in blocks of BLOCK_TERMS (item, term) pairs at most, or one larger item: what a block broadcasts and what the
driver gets of it (terms, counts) is bounded by that; each block's result is written before the next block begins.

Defined results: null texts and texts without a term are no documents (not counted in N) and no results; items without a term
have no results; rows of one item_id are one item with the terms of all of them; rows of documents are documents each, also
those of one doc_id; a row without doc_id ranks after the others of its score; other columns are ignored; empty in, empty out.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.llm.common import flat, stash, table

TOP = 50
#: Most (item, term) pairs of a block of items.
BLOCK_TERMS = 200_000
#: Cells of a dense table of scores and products that a task holds at a time.
CELLS = 2_000_000
#: Terms are runs of ASCII letters, digits and whatever lies beyond ASCII; as bytes, A-Z lower-cased and all else blank.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
BAG = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "item_id long, doc_id long, score long"


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(FOLDED).split() if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): each distinct term of each item."""

    def run(batches):
        for batch in batches:
            found = [(i, t) for i, x in zip(batch["item_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True) for t in set(terms(x))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], ["item_id", "term"])

    return stash(items.select("item_id", "text").mapInArrow(run, "item_id long, term binary").distinct(), "item-terms")


def blocks(pairs: DataFrame, most: int) -> tuple[int, list[int]]:
    """Into how many blocks by hash of item_id the items go, so that none has more than `most` pairs, unless it has one item; and the blocks that have any."""
    sizes = pairs.groupBy("item_id").agg(F.count("*").alias("n"))
    n = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // most))
    while True:
        block = stash(sizes.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(n)).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("items")), "blocks")
        if block.where(f"n > {most} and items > 1").isEmpty():
            return n, sorted(r.b for r in block.select("b").collect())
        n *= 2


def bags(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document: its number of terms, and ids and counts of those in the vocabulary."""
    held = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches):
        get = held.value.get
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, found = [], []
                for text in part["text"].cast(pa.binary()).to_pylist():
                    all_terms = terms(text)
                    sizes.append(len(all_terms))
                    counts = Counter(map(get, all_terms))
                    counts.pop(None, None)
                    found.append(sorted(counts.items()))
                arrays = [pa.array([[x[k] for x in f] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(sizes, pa.int64()), *arrays], ["doc_id", "n", "terms", "tfs"])

    out = stash(docs.select("doc_id", "text").mapInArrow(run, BAG), "bags")
    held.destroy()
    return out


class Scorer:
    """Postings from the terms of a block to its items (term t: items[starts[t]:starts[t + 1]]), and the terms' weights."""

    def __init__(self, found: list[list[int]], weights: np.ndarray):
        pairs = np.array([(t, i) for i, ts in enumerate(found) for t in ts], dtype=np.int64).reshape(-1, 2)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        self.items, self.n = pairs[:, 1], len(found)
        self.starts = np.searchsorted(pairs[:, 0], np.arange(len(weights) + 1))
        self.weights = weights

    def scores(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """(rows, items) of scores. row, term and tf have an entry for each term of a bag, m one for each row."""
        gain = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
        count = self.starts[term + 1] - self.starts[term]
        out = np.zeros(len(m) * self.n, dtype=np.int64)
        upto = np.cumsum(count)
        cuts = [0, *np.searchsorted(upto, np.arange(CELLS, upto[-1] if len(upto) else 0, CELLS), side="right").tolist(), len(count)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                c = count[a:b]
                place = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(self.starts[term[a:b]], c)
                cell = np.repeat(row[a:b] * self.n, c) + self.items[place]
                # sums of doubles are exact below 2^53, so the gains go in two parts
                for part, shift in ((gain[a:b] & 0xFFFFFF, 0), (gain[a:b] >> 24, 24)):
                    out += np.bincount(cell, weights=np.repeat(part, c), minlength=len(out)).astype(np.int64) << shift
        return out.reshape(len(m), self.n)


class Best:
    """The TOP best (score, then doc_id ascending, null last) documents of each item so far."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, dtype=np.int64)
        self.held = [np.zeros(0, dtype=np.int64) for _ in range(4)]  # item, score, 1 without doc_id, doc_id
        self.more, self.size = [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.more.append(columns)
        self.size += len(columns[0])
        if self.size > 4 * self.top * len(self.least):
            self.prune()

    def prune(self) -> None:
        columns = [np.concatenate(x) for x in zip(self.held, *self.more, strict=True)]
        item, score, none, doc = columns
        order = np.lexsort((doc, none, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        self.held = [x[order[place < self.top]] for x in columns]
        self.least[item[place == self.top - 1]] = score[order[place == self.top - 1]]
        self.more, self.size = [], 0


def best_of_partition(batches, scorer: Scorer, top: int) -> list[np.ndarray]:
    """item, score, whether doc_id is missing, doc_id of the best documents, from rows in order of class and place within it."""
    best, rows = Best(scorer.n, top), max(1, CELLS // max(1, scorer.n))
    carried = np.zeros((1, scorer.n), dtype=np.int64)  # scores of the class that the last rows belong to
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            head = batch["place"].to_numpy() == 1
            heads = batch.filter(pa.array(head))
            term, offsets = flat(heads["terms"], np.int32)
            tf, _ = flat(heads["tfs"], np.int32)
            row = np.repeat(np.arange(heads.num_rows), np.diff(offsets))
            scored = scorer.scores(row, term.astype(np.int64), tf.astype(np.int64), heads["m"].to_numpy())
            scored = np.concatenate([carried, scored])  # row 0: the class begun before
            carried = scored[-1:]
            owner = np.cumsum(head)
            first, members = np.searchsorted(owner, np.arange(len(scored))), np.bincount(owner, minlength=len(scored))
            klass, item = np.nonzero(scored >= best.least)
            n = members[klass]
            member = np.repeat(first[klass], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ids = batch["doc_id"]
            best.add(np.repeat(item, n), np.repeat(scored[klass, item], n), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)[member], ids.fill_null(0).to_numpy()[member])
    best.prune()
    return best.held


def search_block(docs: DataFrame, pairs: DataFrame, top: int) -> DataFrame:
    """(item_id, doc_id, score) of the best documents of a block of items, those of each task and more than `top` an item."""
    spark = docs.sparkSession
    found = [(r.item_id, [bytes(t) for t in r.terms]) for r in pairs.groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()]  # a block
    found.sort(key=lambda x: (x[0] is None, x[0] or 0))
    vocabulary = sorted({t for _, ts in found for t in ts})
    places = {t: i for i, t in enumerate(vocabulary)}
    bag = bags(docs, vocabulary)
    n_docs, n_terms = bag.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in bag.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator():  # the vocabulary
        df[r.term] = r.df
    if not n_docs:
        return spark.createDataFrame([], FOUND)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    held = spark.sparkContext.broadcast(([i for i, _ in found], Scorer([[places[t] for t in ts] for _, ts in found], weights)))

    keyed = bag.where(F.size("terms") > 0).withColumn("m", F.expr(f"100 - 50 + ((50 * n * {n_docs}L) div {n_terms}L)")).withColumn("h", F.xxhash64("m", "terms", "tfs"))
    of_class = W.partitionBy("h", "m", "terms", "tfs").orderBy(F.asc_nulls_last("doc_id"))
    members = keyed.select("doc_id", "m", "h", "terms", "tfs", F.row_number().over(of_class).alias("place")).where(F.col("place") <= top)

    def run(batches):
        names, scorer = held.value
        item, score, none, doc = best_of_partition(batches, scorer, top)
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in item.tolist()], pa.int64()), pa.array(doc, pa.int64(), mask=none == 1), pa.array(score, pa.int64())], ["item_id", "doc_id", "score"])

    out = stash(members.select("doc_id", "m", "terms", "tfs", "place").mapInArrow(run, FOUND), "found")
    held.destroy()
    return out


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """docs (doc_id, text) and items (item_id, text) to (item_id, rank, doc_id, score): the `top` best documents of each item."""
    pairs = item_terms(items)
    n, numbers = blocks(pairs, block_terms)
    out = docs.sparkSession.createDataFrame([], FOUND)
    for b in numbers:
        out = out.union(search_block(docs, pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b), top))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
with terms as (
  select d.row, d.doc_id, unnest(regexp_extract_all(translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as row, doc_id, text from documents) d),
counted as (select row, doc_id, term, count(*) as tf from terms group by all),
sized as (select row, sum(tf)::bigint as n from counted group by row),
whole as (select count(*)::bigint as docs, sum(n)::bigint as total from sized),
weighed as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from counted, whole group by term, docs),
wanted as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
scored as (
  select item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))))::bigint as score
  from wanted join weighed using (term) join counted using (term) join sized using (row), whole group by all),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank, doc_id, score from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 50
"""

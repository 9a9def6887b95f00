"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy.

Tokens are runs of letters or digits and runs of other signs. Every token has a sparse index vector of +1 and -1 at places
drawn from its hash. The vector of a known token adds up the index vectors of its neighbours (WINDOW to each side, places
told apart by a rotation) over the fitting sample, scaled by how often the token occurs, plus its own index vector; tokens
that the sample lacks are known by their shape (letter case, digits, length), and a token that repeats one of the last
NEAR tokens is known as a repetition. A document is the mean of its tokens' vectors
(unit length, frequent tokens weighted down), the mean of each third of its tokens included, so that every word counts.
The network (tanh, then a logistic output) is fitted by Adam; a temperature, fitted on rows kept from the fitting, turns
its outputs into calibrated probabilities.

Fitting uses SAMPLE labelled rows of SAMPLE_CHARS characters at most, those with the lowest hash of doc_id among the rows that
may be learnt from. Tasks read them and send token counts, token vectors and pooled vectors, all bounded by the sample; no
text reaches the driver. Every token that occurs OFTEN times in the sample is known. Scoring reads every whole text.

Defined results: a null text counts as empty and pools to the usual vector; repeated rows give repeated rows; repeated label rows of a
document count as their largest label; rows without doc_id are scored and not held out; without usable labels every score
is PRIOR; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import mix, stash, table

#: Most labelled rows that the model is fitted on, and most characters of them together; a row of more than a share of these is not fitted on.
SAMPLE, SAMPLE_CHARS, LONGEST_SHARE = 5000, 32_000_000, 32
#: Tasks that share the fitting, tokens whose contexts are added up at a time, tokens of a text whose neighbours are added at a time.
FIT_TASKS, GROUP, SLICE = 12, 4096, 1 << 16
CONTEXTS = "token long, seen long, context binary"
OFTEN, DIM, NONZERO, WINDOW, NEAR, SMOOTH, HIDDEN, EPOCHS = 4, 64, 4, 2, 4, 8, 32, 60
THRESHOLD, PRIOR = 0.3, 0.5
SEED = 11
TOKEN = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")


def shape(token: str) -> str:
    """Class of an unknown token: a control character can't occur in a token, so shapes and tokens don't mix."""
    kind = "d" if token.isdigit() else "u" if token.isupper() else "l" if token.islower() else "t" if token.istitle() else "m" if token.isalnum() else "s"
    return f"\0{kind}{min(len(token).bit_length(), 5)}"


REPEAT = "\0r"
SHAPES = [REPEAT, *(f"\0{k}{n}" for k in "dultms" for n in range(6))]


def repeats(tokens: list[str]) -> np.ndarray:
    """Which tokens equal one of the NEAR before them."""
    h = np.fromiter(map(hash, tokens), dtype=np.int64, count=len(tokens))
    out = np.zeros(len(h), dtype=bool)
    for step in range(1, NEAR + 1):
        out[step:] |= h[step:] == h[:-step]
    return out


def index_vectors(tokens: list[str], dim: int) -> np.ndarray:
    """Rows of NONZERO entries of +1 or -1, drawn from the tokens' hashes."""
    h = mix(np.array([zlib.crc32(t.encode()) | zlib.adler32(t.encode()) << 32 for t in tokens], dtype=np.uint64))
    out = np.zeros((len(tokens), dim), dtype=np.float32)
    for i in range(NONZERO):
        h = mix(h + np.uint64(i + 1))
        out[np.arange(len(tokens)), (h % np.uint64(dim)).astype(int)] += np.where(h >> np.uint64(63), 1, -1)
    return out


@dataclass
class Vectors:
    """Token vectors: a row each for the known tokens and for the shapes."""

    places: dict[str, int]
    rows: np.ndarray
    usual: np.ndarray

    def ids(self, tokens: list[str]) -> np.ndarray:
        get = self.places.get
        ids = np.fromiter((get(t, -1) for t in tokens), dtype=np.int32, count=len(tokens))
        ids[repeats(tokens)] = get(REPEAT)
        for i in np.flatnonzero(ids < 0):
            ids[i] = get(shape(tokens[i]))
        return ids

    def pooled(self, texts: list[str]) -> np.ndarray:
        """Means of the token vectors of each text, over the whole text and over each third of it, drawn towards the usual vector by
        SMOOTH tokens, so that a few words prove little."""
        dim = self.rows.shape[1]
        out = np.tile(self.usual, (len(texts), 4))
        for i, text in enumerate(texts):
            ids = self.ids(tokens(text))
            if not len(ids):
                continue
            cuts = [len(ids) * k // 3 for k in range(4)]
            sums = np.zeros((3, dim), dtype=np.float32)
            for k in range(3):
                for at in range(cuts[k], cuts[k + 1], 1 << 16):
                    sums[k] += self.rows[ids[at : min(at + (1 << 16), cuts[k + 1])]].sum(axis=0)
                out[i, (k + 1) * dim : (k + 2) * dim] = (sums[k] + SMOOTH * self.usual) / (cuts[k + 1] - cuts[k] + SMOOTH)
            out[i, :dim] = (sums.sum(axis=0) + SMOOTH * self.usual) / (len(ids) + SMOOTH)
        return out


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text or "")


def contexts(texts: Iterable[str | None], vectors: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """What each known token gathers in some texts: the sum of its neighbours' index vectors, and how often it occurs. Both are
    whole numbers, so sums over any split of the texts agree to the last bit."""
    context, seen = np.zeros(vectors.rows.shape, dtype=np.int32), np.zeros(len(vectors.rows), dtype=np.int64)
    turned = {turn: np.roll(vectors.rows, turn, axis=1).astype(np.int8) for turn in range(-WINDOW, WINDOW + 1)}
    for text in texts:
        ids = vectors.ids(tokens(text))
        seen += np.bincount(ids, minlength=len(seen))
        for at in range(0, len(ids), SLICE):  # with the neighbours on either side, so a slice's end loses none
            here = ids[at : at + SLICE]
            for step in range(1, WINDOW + 1):
                after, before = ids[at + step : at + len(here) + step], ids[max(0, at - step) : max(0, at + len(here) - step)]
                add_rows(context, here[: len(after)], turned[step], after)
                add_rows(context, here[len(here) - len(before) :], turned[-step], before)
    return context, seen


def token_vectors(places: dict[str, int], index: np.ndarray, context: np.ndarray, seen: np.ndarray) -> Vectors:
    """Own index vector and unit context, frequent tokens weighted down. Works in the given arrays, to hold no more of them."""
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)
    index /= np.sqrt(NONZERO)
    index += context
    index /= np.maximum(np.linalg.norm(index, axis=1, keepdims=True), 1e-6)
    share = seen / max(1.0, seen.sum())
    index *= (1e-3 / (1e-3 + share))[:, None]
    return Vectors(places, index, (share @ index).astype(np.float32))


def random_indexing(sample: DataFrame) -> Vectors:
    """Token vectors from a table with texts. Tasks count tokens and add up contexts; the driver gets each token that
    occurs OFTEN and a vector for each of them, never a text."""
    spark = sample.sparkSession

    def count(batches):
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch["text"].to_pylist():
                counts.update(tokens(text))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    counted = sample.select("text").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    names = SHAPES + sorted(r.token for r in counted.select("token").collect())
    places, index = {t: i for i, t in enumerate(names)}, index_vectors(names, DIM)
    held = spark.sparkContext.broadcast(Vectors(places, index, np.zeros(DIM, dtype=np.float32)))

    def gather(batches):
        texts = (t for batch in batches for i in range(0, batch.num_rows, 64) for t in batch["text"].slice(i, 64).to_pylist())
        context, seen = contexts(texts, held.value)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some]), pa.array([x.tobytes() for x in context[some]], pa.binary())], ["token", "seen", "context"])

    def add_up(group: pa.Table) -> pa.Table:
        known, place = np.unique(group["token"].to_numpy(), return_inverse=True)
        context = np.zeros((len(known), DIM), dtype=np.int64)
        np.add.at(context, place, np.frombuffer(b"".join(group["context"].to_pylist()), dtype=np.int32).reshape(-1, DIM))
        seen = np.bincount(place, weights=group["seen"].to_numpy()).astype(np.int64)
        return pa.table([pa.array(known), pa.array(seen), pa.array([x.tobytes() for x in context], pa.binary())], ["token", "seen", "context"])

    parts = sample.select("text").mapInArrow(gather, CONTEXTS)
    context, seen = np.zeros((len(names), DIM), dtype=np.float32), np.zeros(len(names), dtype=np.float32)  # sums of ones, exact up to 2^24
    for r in parts.groupBy(F.expr(f"token div {GROUP}").alias("part")).applyInArrow(add_up, CONTEXTS).toLocalIterator():
        context[r.token], seen[r.token] = np.frombuffer(r.context, dtype=np.int64), r.seen
    held.destroy()
    return token_vectors(places, index, context, seen)


def add_rows(out: np.ndarray, to: np.ndarray, rows: np.ndarray, of: np.ndarray) -> None:
    """out[to] += rows[of], equal places adding up."""
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    to, of = to[order], of[order]
    starts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    out[to[starts]] += np.add.reduceat(rows[of], starts, axis=0, dtype=out.dtype)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fit on four fifths of the rows, choose the epoch and the temperature on the last fifth."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    kept = max(1, len(x) // 5)
    test, train = order[:kept], order[kept:] if len(x) > 4 else order
    net = Network(x[train].mean(axis=0), x[train].std(axis=0) + 1e-4, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    z = (x - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, best = 0, (np.inf, None)

    def loss_at(p, rows):
        o = np.tanh(z[rows] @ p[0] + p[1]) @ p[2] + p[3][0]
        return float(np.mean(np.logaddexp(0, o) - y[rows] * o))

    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            h = np.tanh(z[rows] @ params[0] + params[1])
            d = (1 / (1 + np.exp(-(h @ params[2] + params[3][0]))) - y[rows]) / len(rows)
            dh = d[:, None] * params[2] * (1 - h * h)
            grads = [z[rows].T @ dh + 1e-4 * params[0], dh.sum(axis=0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        now = loss_at(params, test)
        if now < best[0]:
            best = (now, [p.copy() for p in params])
    net.w1, net.b1, net.w2 = best[1][:3]
    net.b2 = float(best[1][3][0])
    o = net.logits(x[test])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    net.temperature = float(min(grid, key=lambda t: np.mean(np.logaddexp(0, o / t) - y[test] * o / t)))
    return net


def may_learn(doc_id: F.Column) -> F.Column:
    """Rows that labels may be learnt from: crc32 of doc_id as text, modulo 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def fitting_sample(docs: DataFrame, labels: DataFrame, sample: int, chars: int) -> DataFrame:
    """(doc_id, text, label) of the rows to fit on, written to the shared folder: chosen by a hash, so the same in every run."""
    marks = labels.where("label is not null").groupBy("doc_id").agg(F.max("label").alias("label")).where(may_learn(F.col("doc_id")))
    sizes = docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n")).join(marks, "doc_id").groupBy("doc_id", "label").agg(F.max("n").alias("n"))
    few = sizes.where(F.col("n") <= chars // LONGEST_SHARE).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    upto = F.sum("n").over(W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0))  # over the few
    ids = few.withColumn("upto", upto).where(F.col("upto") <= chars).select("doc_id", "label")
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return stash(texts.repartition(FIT_TASKS), "sample")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[Vectors, Network] | None:
    """labels: (doc_id, label 0 or 1)."""
    rows = fitting_sample(docs, labels, sample, chars)
    low, high, n = rows.agg(F.min("label"), F.max("label"), F.count("*")).first()
    if n < 2 or low == high:
        return None
    vectors = random_indexing(rows)
    held = rows.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                x = held.value.pooled([t or "" for t in part["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["label"].cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    pooled = sorted(rows.mapInArrow(pool, "doc_id long, label int, x binary").collect(), key=lambda r: r.doc_id)  # a vector for each row of the sample
    held.destroy()
    x = np.frombuffer(b"".join(r.x for r in pooled), dtype=np.float32).reshape(len(pooled), -1)
    return vectors, fit_network(x, np.array([r.label for r in pooled], dtype=float))


def score(docs: DataFrame, model: tuple[Vectors, Network] | None) -> DataFrame:
    """All columns of docs (text among them) with score, the probability of label 1; a column of that name is replaced.
    Scores are rounded, so that equal texts score equally in batches of any size."""
    docs = docs.drop("score")
    if model is None:
        return docs.withColumn("score", F.lit(PRIOR))
    held = docs.sparkSession.sparkContext.broadcast(model)  # the sample bounds its size
    names = docs.columns

    def run(batches):
        vectors, network = held.value
        for batch in batches:
            texts = batch["text"]
            scores = [network.probability(vectors.pooled([t or "" for t in texts.slice(at, 64).to_pylist()])) for at in range(0, batch.num_rows, 64)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(np.concatenate(scores), 9) if scores else [], pa.float64())], [*names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def quality_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.col("quality").alias("label"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, quality_labels(table(spark, sf_dir, "labels"))))
    return scored.select("doc_id", F.coalesce(~may_learn(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Self-join of texts by the Jaccard similarity of their word shingles, with Bayesian pruning of candidates.

1. Texts with the same words are one class, kept once; its members follow by a key, so copies are never paired.
2. Each class gets a MinHash signature of BANDS x ROWS values. Classes that agree on all values of a band meet in a bucket.
3. In a bucket the signatures are compared in steps of STEP values. After each step the posterior probability that the
   similarity reaches the threshold, given the matches so far and a uniform prior, is read from a table; pairs below
   TOLERANCE are dropped. What is left is reduced to a spanning forest, whose components are candidate clusters.
4. Within each cluster all pairs are verified exactly by the sizes of intersections of the full shingle sets.
5. Components of the verified links are the groups.

Large buckets and clusters are cut into blocks, each of which gets the smallest member, the pivot, as well:
- In a bucket members that outlive the comparison with the pivot are joined through it, whatever they are to each other.
- In a cluster each member is written as what it lacks of the pivot and what it has beyond it. Members whose difference is at
  most half of what the threshold allows are surely linked to each other, so their links are counted, not compared.
Only members far from the pivot are compared with all members, block by block, again pruned; a cluster of edited copies has few.
So the rows that travel are linear in the members, but for the far ones times the blocks; what leaves a task are link counts and
spanning edges.

At similarity 0.8 a pair shares no band with probability (1 - 0.8^5)^32 = 3e-6, and the tolerance drops fewer than 1e-4
of the true pairs; above 0.85 both are below 1e-7. Verified links are exact.

Defined results: null and blank texts have no words and are copies of one another (similarity 1), linked to nothing else;
texts of fewer than five words have one shingle, the whole text; n_links counts the other documents (copies included) whose
similarity is at least the threshold; rows are told apart by doc_id, repeated rows of one doc_id count as one document;
rows without doc_id are left out, as nothing could name them; columns other than doc_id and text are ignored; empty in, empty out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import SHINGLE, SIMILAR, components, flat, mix, shingles, stash, table, whole_groups, word_hashes

BANDS, ROWS = 32, 5
STEP = 16
TOLERANCE = 1e-5
#: Members of a block, and words of them: a task compares the pairs of two blocks at most.
BLOCK, BLOCK_WORDS = 192, 2_000_000
#: Most rows (two numbers each) that are broadcast.
BROADCAST_ROWS = 1_000_000
#: Columns of a dense product at a time.
COLUMNS = 8192
SEED = 20240229


@lru_cache(1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


@lru_cache(8)
def fewest_matches(threshold: float, tolerance: float = TOLERANCE) -> np.ndarray:
    """For each number of compared values the fewest matches at which P(similarity >= threshold | matches) >= tolerance.

    Values are compared by one byte, so unequal ones match with probability 1/256; the prior is uniform on [0, 1]."""
    s = (np.arange(2000) + 0.5) / 2000
    p = s + (1 - s) / 256
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        like = np.exp(log - log.max(axis=1, keepdims=True))
        out.append(int(np.argmax(like[:, s >= threshold].sum(axis=1) / like.sum(axis=1) >= tolerance)))
    return np.array(out)


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values, a row for each shingle set; every set must have a shingle."""
    a, b = permutations()
    h = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, len(a)), dtype=np.uint32)
    for i in range(len(out)):
        best = None
        for at in range(offsets[i], offsets[i + 1], 4096):
            x = h[at : min(at + 4096, offsets[i + 1])]
            low = (x[:, None] * a + b).min(axis=0)
            best = low if best is None else np.minimum(best, low)
        out[i] = best
    return out


def surviving(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows of two byte signatures outlive the incremental comparison: a boolean matrix."""
    alive = np.ones((len(left), len(right)), dtype=bool)
    matches = np.zeros(alive.shape, dtype=np.int16)
    for k, least in enumerate(fewest_matches(threshold)):
        i, j = np.nonzero(alive)
        if not len(i):
            break
        part = slice(k * STEP, (k + 1) * STEP)
        if len(i) * 4 > alive.size:
            for c in range(part.start, part.stop):
                matches += left[:, c, None] == right[None, :, c]
            alive &= matches >= least
        else:
            matches[i, j] += (left[i, part] == right[j, part]).sum(axis=1, dtype=np.int16)
            alive[i, j] = matches[i, j] >= least
    return alive


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Spanning edges (node, smallest node) of the components of some pairs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in list(parent) if root(x) != x]


def keys(docs: DataFrame) -> DataFrame:
    """docs with the key of their word sequences, two 64-bit hashes over all words: doc_id, text, k1, k2, n_words."""
    words = word_hashes(F.col("text"))
    return docs.select("doc_id", "text", F.xxhash64(words).alias("k1"), F.xxhash64(F.lit(1), words).alias("k2"), F.size(words).alias("n_words"))


def classes(docs: DataFrame, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Classes of equal word sequences: members (doc_id, key, rows of the doc_id) without null ids, and (rep, n, key).

    Of the rows of one doc_id the one of the smallest key counts."""
    keyed = keys(docs.where("doc_id is not null")).groupBy("doc_id").agg(F.min(F.struct("k1", "k2", "n_words")).alias("k"), F.count("*").alias("n_rows"))
    keyed = stash(keyed.select("doc_id", "k.*", "n_rows"), "keys")
    sizes = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.min("n_words").alias("n_words"))
    return keyed, stash(sizes, "classes")


def once(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """docs with one row for each doc_id, the one whose key classes() chose. Repeats go within each task before texts are shuffled,
    so a doc_id of many rows burdens no task; where none repeats, docs as they are."""
    if keyed.where("n_rows > 1").isEmpty():
        return docs
    first = keys(docs).groupBy("doc_id").agg(F.min(F.struct("k1", "k2", "n_words", "text")).alias("k"))
    return stash(first.select("doc_id", "k.text"), "once")


def sign(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, bytes of the signature, buckets) of the representatives with words."""
    keep = reps.where("n_words > 0").select(F.col("rep").alias("doc_id"))
    texts = docs.select("doc_id", word_hashes(F.col("text")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                values, offsets = shingles(*flat(part["words"]))
                full = np.flatnonzero(np.diff(offsets))
                if not len(full):
                    continue
                sig = signatures(values, np.append(offsets[full], offsets[-1]))
                bands = np.zeros((len(full), BANDS), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(ROWS):
                        bands = bands * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS][:, :BANDS] + np.uint64(r + 1)
                    bands = mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                ids = part["doc_id"].take(pa.array(full))
                low = np.ascontiguousarray((sig & np.uint32(255)).astype(np.uint8))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([row.tobytes() for row in low], pa.binary()), lists], ["rep", "sig", "buckets"])

    return texts.mapInArrow(run, "rep long, sig binary, buckets array<long>").join(keep, F.col("rep") == keep.doc_id, "left_semi")


def blocks_of(n, most: int = BLOCK):
    return F.ceil(n / most).cast("int")


def block_of(blocks, seed: int):
    """A block is told by the hash of the representative."""
    return F.pmod(F.xxhash64("rep", F.lit(seed)), blocks).cast("int")


def with_pivot(members: DataFrame, key: str, blocks: F.Column) -> DataFrame:
    """Rows (key, rep, pivot, ...) with the block of each; the pivot's row comes to all blocks."""
    every = F.when(F.col("rep") == F.col("pivot"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(block_of(blocks, 7)))
    return members.withColumn("block", F.explode(every))


def far_and_all(members: DataFrame, key: str, most: int) -> DataFrame:
    """Rows (key, rep, far) of keys that have far members to the pairs of blocks that compare these with all members: key, rep, i, j
    and side, 0 for the far ones and 1 for all."""
    counts = members.groupBy(key).agg(F.count("*").alias("n"), F.count_if("far").alias("n_far")).where("n_far > 0")
    both = members.join(counts, key).withColumn("few", blocks_of(F.col("n_far"), most)).withColumn("many", blocks_of(F.col("n"), most))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = both.where("far").select(key, "rep", "far", block_of(F.col("few"), 11).alias("i"), upto("many").alias("j"), F.lit(0).alias("side"))
    right = both.select(key, "rep", "far", upto("few").alias("i"), block_of(F.col("many"), 13).alias("j"), F.lit(1).alias("side"))
    return left.unionByName(right)


def partitions(df: DataFrame) -> int:
    """As many tasks as the session shuffles to: comparing takes time by pairs, so few bytes don't make a small task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def few_broadcast(df: DataFrame, name: str) -> DataFrame:
    """df, written, to be broadcast in joins where it has BROADCAST_ROWS at most; beyond that the session splits what is skewed."""
    df = stash(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def grouped(rows: DataFrame, *by: str) -> DataFrame:
    return rows.repartition(partitions(rows), *by).sortWithinPartitions(*by)


def bytes_of(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["sig"].to_pylist()), dtype=np.uint8).reshape(t.num_rows, -1)


def candidate_edges(signed: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Spanning edges (a, b) of the pairs that share a bucket and outlive the pruning."""
    rows = signed.select("rep", F.explode("buckets").alias("bucket"))
    crowded = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).where("n > 1")
    members = stash(rows.join(crowded, "bucket"), "buckets")
    signs = signed.select("rep", "sig")

    def star(batches):
        edges: list[tuple] = []
        for t in whole_groups(batches, ["bucket", "block"]):
            sig, reps, bucket, pivot = bytes_of(t), t["rep"].to_numpy(), t["bucket"][0].as_py(), t["pivot"][0].as_py()
            if t["n"][0].as_py() <= block:
                x, y = np.nonzero(np.triu(surviving(sig, sig, threshold), 1))
                edges += [(bucket, *e) for e in forest(reps[x], reps[y])]
            else:
                near = surviving(sig, sig[reps == pivot][:1], threshold)[:, 0] | (reps == pivot)
                edges += [(bucket, r, pivot if ok else None) for r, ok in zip(reps.tolist(), near.tolist(), strict=True) if r != pivot]
            if len(edges) > 50_000:
                yield table_of(edges, ["bucket", "a", "b"])
                edges = []
        yield table_of(edges, ["bucket", "a", "b"])

    def rest(batches):
        for t in whole_groups(batches, ["bucket", "i", "j"]):
            sig, reps, side = bytes_of(t), t["rep"].to_numpy(), t["side"].to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            x, y = np.nonzero(surviving(sig[left], sig[right], threshold))
            yield table_of(forest(reps[left[x]], reps[right[y]]), ["a", "b"])

    first = with_pivot(members, "bucket", blocks_of(F.col("n"), block)).join(signs, "rep")
    found = stash(grouped(first, "bucket", "block").mapInArrow(star, "bucket long, a long, b long"), "stars")
    far = found.where("b is null").select("bucket", F.col("a").alias("rep"), F.lit(True).alias("far"))
    edges = found.where("b is not null").select("a", "b")
    if not far.isEmpty():
        crowd = members.where(F.col("n") > block).select("bucket", "rep").join(far, ["bucket", "rep"], "left").select("bucket", "rep", F.coalesce("far", F.lit(False)).alias("far"))
        tasks = far_and_all(crowd, "bucket", block).join(signs, "rep")
        edges = edges.unionByName(grouped(tasks, "bucket", "i", "j").mapInArrow(rest, "a long, b long"))
    return edges.distinct()


def table_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Rows of whole numbers and nulls."""
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each left with each right set."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1  # a column of one set adds to no pair but the set with itself
    renamed = np.cumsum(count > 1) - 1
    column, owner = renamed[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        dense = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        dense[owner[a:b], column[a:b] - at] = 1
        total += dense[left] @ dense[right].T
    return total


def differences(docs: DataFrame, clusters: DataFrame, reps: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Members of the clusters (root, rep, n documents) against the pivot's shingle set, which is the root's: size of it, less and
    more (the shingles that a member lacks and has beyond it, as hashes that tell the two apart), far."""
    words = F.sum(F.col("n_words").cast("long"))
    members = clusters.select("root", F.col("node").alias("rep")).join(reps.select("rep", "n", "n_words"), "rep")
    blocks = F.greatest(blocks_of(F.count("*"), block), blocks_of(words, BLOCK_WORDS)).alias("blocks")
    large = few_broadcast(members.groupBy("root").agg(blocks).where("blocks > 1"), "large")  # the others' rows needn't meet to be counted
    dealt = with_pivot(members.join(large, "root", "left").withColumn("pivot", F.col("root")), "root", F.coalesce("blocks", F.lit(1)))
    texts = docs.join(clusters, docs.doc_id == clusters.node, "left_semi").select(F.col("doc_id").alias("rep"), word_hashes(F.col("text")).alias("words_"))
    rows = dealt.select("root", "block", "rep", "n", F.col("blocks").isNotNull().alias("large")).join(texts, "rep")
    other = np.uint64(0xA0761D6478BD642F)

    def run(batches):
        for t in whole_groups(batches, ["root", "block"]):
            root, reps = t["root"][0].as_py(), t["rep"].to_numpy()
            values, offsets = shingles(*flat(t["words_"]))
            own = lambda k: np.unique(values[offsets[k] : offsets[k + 1]])
            pivot = own(int(np.flatnonzero(reps == root)[0]))
            block_no, out = t["block"][0].as_py(), []
            for k, (rep, n) in enumerate(zip(reps.tolist(), t["n"].to_pylist(), strict=True)):
                if rep == root and block_no:
                    continue
                mine = own(k)
                less, more = np.setdiff1d(pivot, mine, assume_unique=True), np.setdiff1d(mine, pivot, assume_unique=True)
                far = len(less) + threshold * len(more) > (1 - threshold) * len(pivot) / 2 + 1e-9
                out.append((root, rep, n, len(pivot), len(less), far, t["large"][0].as_py(), np.concatenate([less ^ other, more]).view(np.int64)))
                if len(out) == 512:
                    yield member_batch(out)
                    out = []
            yield member_batch(out)

    return grouped(rows, "root", "block").mapInArrow(run, MEMBERS)


MEMBERS = "root long, rep long, n long, pivot_size long, less long, far boolean, large boolean, parts array<long>"


def member_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 8
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["root", "rep", "n", "pivot_size", "less", "far", "large", "parts"])


def verified(docs: DataFrame, signed: DataFrame, clusters: DataFrame, reps: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Exact links within the clusters: rows (a, b, links) where links is a part of the documents linked to a, and b is null but for
    spanning edges (links 0).

    With less and more for what two members lack of the pivot and have beyond it, the union is at most the pivot and both mores, the
    intersection at least the pivot without both lesses: near members, those of less + threshold * more at most half of
    (1 - threshold) * pivot, are linked whatever the rest. Other pairs are counted: the intersection is the pivot without both
    lesses, plus what the lesses share, plus what the mores share."""
    members = stash(differences(docs, clusters, reps, threshold, block), "members")
    near = members.where("not far")
    whole = near.groupBy("root", "large").agg(F.sum("n").alias("whole"))
    none = F.lit(None).cast("long")
    of_large = few_broadcast(whole.where("large").drop("large"), "whole")
    both = near.where("large").join(of_large, "root").unionByName(near.where("not large").join(whole.where("not large").drop("large"), "root"))
    sure = both.where(F.col("whole") > F.col("n")).select(F.col("rep").alias("a"), none.alias("b"), (F.col("whole") - F.col("n")).alias("links"))
    edges = near.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"), F.lit(0).cast("long").alias("links"))
    out = sure.unionByName(edges)
    if members.where("far").isEmpty():
        return out
    tasks = far_and_all(members.select("root", "rep", "far"), "root", block)
    full = tasks.join(members.drop("root", "far"), "rep").join(signed.select("rep", "sig"), "rep")

    def run(batches):
        for t in whole_groups(batches, ["root", "i", "j"]):
            side, sig, reps, weight = t["side"].to_numpy(), bytes_of(t), t["rep"].to_numpy(), t["n"].to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            alive = surviving(sig[left], sig[right], threshold) & (reps[left][:, None] != reps[right][None, :])
            if not alive.any():
                continue
            values, offsets = flat(t["parts"])
            sets = [values[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
            less, pivot = t["less"].to_numpy(), int(t["pivot_size"][0].as_py())
            lengths = np.diff(offsets) - 2 * less + pivot
            both = common_counts(sets, left, right) + pivot - less[left][:, None] - less[right][None, :]
            linked = alive & (both >= threshold * (lengths[left][:, None] + lengths[right][None, :] - both) - 1e-6)
            x, y = np.nonzero(linked)
            is_near = ~t["far"].to_numpy(zero_copy_only=False)[right]  # far ones are on the left of another task, or of this
            a = np.append(reps[left], reps[right[is_near]])
            links = np.append(linked @ weight[right], linked.T[is_near] @ weight[left]).astype(np.int64)
            some = links > 0
            rows = [(p, None, q) for p, q in zip(a[some].tolist(), links[some].tolist(), strict=True)]
            yield table_of([*rows, *((p, q, 0) for p, q in forest(reps[left[x]], reps[right[y]]))], ["a", "b", "links"])

    return out.unionByName(grouped(full, "root", "i", "j").mapInArrow(run, "a long, b long, links long"))


def join_similar(docs: DataFrame, threshold: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """(doc_id, text) to one row per document: doc_id, class_id (smallest doc_id of the group that its links connect) and
    n_links (other documents with similarity at least the threshold, copies included)."""
    if not math.isclose(threshold, SIMILAR) and threshold < SIMILAR:
        raise ValueError(f"the bands are laid out for thresholds of {SIMILAR} and more")
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    keyed, reps = classes(docs)
    docs = once(docs, keyed)
    signed = stash(sign(docs, reps), "signatures")
    clusters = components(stash(candidate_edges(signed, threshold, block), "candidates"))
    found = stash(verified(docs, signed, clusters, reps, threshold, block), "links")
    groups = components(found.where("b is not null").select("a", "b"))
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    whole = reps.join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    whole = whole.select("k1", "k2", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return keyed.join(whole, ["k1", "k2"]).select("doc_id", "class_id", "n_links")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, and who reaches whom by links: SQL for small tables, which has no candidates to prune.
OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c * 5 >= 4 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM n UNION SELECT r.node, e.y FROM r JOIN e ON r.reach = e.x)
SELECT node AS doc_id, min(reach) AS class_id, count(DISTINCT y)::BIGINT AS n_links FROM r LEFT JOIN e ON e.x = r.node GROUP BY node
"""

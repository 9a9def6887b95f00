import hashlib
import random
import re

import pytest
import xxhash
from helpers import documents, odd_texts

from postmill.llm import syncmers


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def chained_text(chars):
    seed = 42
    for c in chars:
        seed = xxhash.xxh64_intdigest(c.encode(), seed)
    return signed(seed)


def token_by_hand(run):
    """Hashes of a run's pieces: itself, or cut where two characters' hash is below both neighbours'."""
    if len(run) <= syncmers.RUN:
        return [chained_text([run])]
    pairs = [chained_text(run[i : i + 2]) for i in range(len(run) - 1)]
    starts = [0, *(i + 1 for i in range(1, len(pairs) - 1) if pairs[i] < pairs[i - 1] and pairs[i] < pairs[i + 1])]
    return [chained_text(run[a:b]) for a, b in zip(starts, [*starts[1:], len(run)], strict=True)]


def anchors_by_hand(text, k=syncmers.K):
    """(position, 32 bits of hash) of the windows whose smallest token hash is their first or last."""
    h = [x for t in re.findall(r"[^\x20\x09-\x0D]+", text or "") for x in token_by_hand(t)]

    def chained(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), seed)
        return seed & 0xFFFFFFFF

    if len(h) < k:
        return [(0, chained(h))] if h else []
    return [(i, chained(h[i : i + k])) for i in range(len(h) - k + 1) if min(h[i], h[i + k - 1]) <= min(h[i : i + k])]


def written(a):
    return " ".join(f"{p}:{h:08x}" for p, h in a)


def near(a, b):
    x, y = {h for _, h in a}, {h for _, h in b}
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def expected(texts):
    order = sorted(texts, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, e, b = (anchors_by_hand(x) for x in (t, edited, after))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), written(a), written(e), pytest.approx(near(a, e)), pytest.approx(near(a, b))))
    return out


@pytest.mark.parametrize("stretch", [1, 3, 500])
def test_rows_like_by_hand(spark, monkeypatch, tmp_path, stretch):
    monkeypatch.setattr(syncmers, "STRETCH", stretch)
    texts = [t for t in odd_texts() if t[0] is not None] + [(9, "same id"), (10**15, "far id with a few more words"), (-5, "negative id"), (None, "no id")]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in syncmers.op10_fingerprints(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected(texts), key=lambda r: str(tuple(float(x.expected) if hasattr(x, "expected") else x for x in r)))


def test_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert syncmers.op10_fingerprints(spark, str(tmp_path)).count() == 0


def test_anchors_keep_within_reach_of_an_edit(spark):
    text = [f"t{i}" for i in range(400)]
    other = text[:200] + ["NEW"] + text[200:]
    a, b = ({h for _, h in anchors_by_hand(" ".join(x))} for x in (text, other))
    assert len(a - b) <= syncmers.K and len(a) > 100
    places = [p for p, _ in anchors_by_hand(" ".join(text))]
    assert max(y - x for x, y in zip(places, places[1:], strict=False)) <= syncmers.K - 1


def test_passages_move_inside_a_run_without_spaces(spark, tmp_path):
    rng = random.Random(8)
    run = "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(900))
    texts = [(1, run), (2, "字" + run), (3, run[300:600] + run), (4, run[100:400]), (5, "".join(rng.choice("ab") for _ in range(5000)))]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    prints = {r.doc_id: {x.split(":")[1] for x in r.fingerprint.split()} for r in syncmers.op10_fingerprints(spark, str(tmp_path)).collect()}
    assert prints[1] == {f"{h:08x}" for _, h in anchors_by_hand(run)} and len(prints[1]) > 60
    assert len(prints[1] & prints[2]) >= len(prints[1]) - 2 and len(prints[1] - prints[3]) <= 2
    assert len(prints[4] - prints[1]) <= 4 and len(prints[4] & prints[1]) >= len(prints[4]) - 4


def test_query(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {r[0]: r for r in expected(texts)}
    got = syncmers.op10_fingerprints(spark, sf_dir).collect()
    assert len(got) == len(texts) and all(tuple(r) == want[r.doc_id] for r in got)

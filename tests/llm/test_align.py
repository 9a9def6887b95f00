import bisect
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from helpers import documents, odd_texts
from tokenizers import Tokenizer

from postmill.llm import align


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute(rows, encoders):
    """Rows by row place: n_a, n_b, n_groups, n_links, n_best, count_sum, digest, by walking through each text's bytes."""
    a, b = encoders
    letters = align.byte_letters()

    def ends(ids, piece):
        at = 0
        for i in ids:
            at += len(piece(i))
            yield at

    def piece_a(i):
        return bytes(letters[c] for c in a.id_to_token(i))

    def piece_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    out, counts = [], Counter()
    for text in rows:
        whole = (" " + (text or "")).encode()
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        if b"".join(map(piece_a, ids[0])) != whole or b"".join(map(piece_b, ids[1])) != whole:
            out.append((0, 0, 0, "", []))
            continue
        ea, eb = list(ends(ids[0], piece_a)), list(ends(ids[1], piece_b))
        links, i, j = [], 0, 0
        while i < len(ea) and j < len(eb):
            links.append((ids[0][i], ids[1][j]))
            end = min(ea[i], eb[j])
            i, j = i + (ea[i] == end), j + (eb[j] == end)
        counts.update(links)
        common = sorted(set(ea) & set(eb))
        groups, at = [], [0, 0]
        for end in common:
            upto = [bisect.bisect_right(e, end) for e in (ea, eb)]
            groups.append("|".join(",".join(map(str, x[p:q])) for x, p, q in zip(ids, at, upto, strict=True)))
            at = upto
        out.append((len(ea), len(eb), len(common), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(na, nb, g, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest) for na, nb, g, digest, links in out]


def found(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def odd():
    rng = random.Random(2)
    parts = ["the ", "Über", "▁", " ", "\n\n", "日本語", "<|endoftext|>", "</s>", "<0x41>", "\U0001f600", "é", "é", "don't", "12345", "\t", "ﬁ", " ", "\r\n", "naïve", "\x00"]
    return odd_texts() + [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))) for i in range(150)] + [(100, "the the the"), (None, "the")]


@pytest.mark.parametrize(("frequent", "chunk"), [(align.FREQUENT, align.CHUNK_CHARS), (40, 50), (0, 10**9)])
def test_same_as_walking_through_bytes(spark, encoders, frequent, chunk):
    texts = odd()
    want = Counter((i, *x) for (i, _), x in zip(texts, brute([t for _, t in texts], encoders), strict=True))
    assert found(align.alignment(documents(spark, texts).repartition(3), frequent=frequent, chunk_chars=chunk)) == want


def test_pairs_passed_on_early_count_the_same(spark, monkeypatch):
    df = documents(spark, odd())
    want = found(align.alignment(df))
    monkeypatch.setattr(align, "HELD_PAIRS", 10)
    assert found(align.alignment(df, chunk_chars=100)) == want


def test_special_tokens_are_plain_text_and_nothing_is_empty(spark):
    rows = {r.doc_id: r for r in align.alignment(documents(spark, [(1, "<|endoftext|></s>"), (2, None), (3, ""), (4, "▁")])).collect()}
    assert rows[1].n_a > 3 and rows[1].n_b > 3
    assert all(rows[i].n_a == rows[i].count_sum == 0 and rows[i].groups_sha256 == "" for i in (2, 3, 4))
    assert align.alignment(documents(spark, [])).count() == 0


def test_query(spark, sf_dir, encoders):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = Counter((i, *x) for (i, _), x in zip(docs, brute([t for _, t in docs], encoders), strict=True))
    assert found(align.op12_alignment(spark, sf_dir)) == want

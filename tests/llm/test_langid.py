import math
import random
import zlib

import pytest
from helpers import documents, odd_texts

from postmill.llm import langid


def longest_matches(text, training):
    """Cut by search in the training text: the longest prefix that occurs there, a byte at least."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in training:
            size += 1
        at += size
        n += 1
    return n


def test_automaton_accepts_the_substrings():
    rng = random.Random(3)
    for _ in range(30):
        text = bytes(rng.choice(b"ab c") for _ in range(rng.randrange(0, 40)))
        steps = langid.suffix_automaton(text)
        inside = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
        spelt, todo = set(), [(0, b"")]
        while todo:
            state, word = todo.pop()
            for byte, to in steps[state].items():
                spelt.add(word + bytes([byte]))
                todo.append((to, word + bytes([byte])))
        assert spelt == inside and len(steps) <= max(2, 2 * len(text))


@pytest.mark.parametrize("few", [0, 3, 10**6])
@pytest.mark.parametrize("lanes", [5, 4096])
def test_phrases_are_longest_matches(monkeypatch, few, lanes):
    monkeypatch.setattr(langid, "FEW", few)
    monkeypatch.setattr(langid, "LANES", lanes)
    rng = random.Random(5)
    training = {"x": b"abab cab\0bcca", "y": b"bb aa", "z": bytes(rng.choice(b"abc ") for _ in range(300))}
    texts = [bytes(rng.choice("abcdé ".encode()) for _ in range(rng.randrange(0, 60))) for _ in range(60)] + [b"", b"abab", b"d" * 500]
    got = langid.Parser.of(training).phrases(texts)
    assert got.tolist() == [[longest_matches(t, training[k]) for k in sorted(training)] for t in texts]


def docs_of(rows, spark):
    return spark.createDataFrame([(i, t, lang, 1.0, "x") for i, t, lang in rows], "doc_id long, text string, lang string, score double, piece string")


def labelled(n):
    rng = random.Random(1)
    stems = {"aa": ["bar", "dun", "kor", "ti"], "bb": ["éli", "ñu", "sab", "wo"], "cc": ["日本", "中文", "字"]}
    rows = []
    for i in range(n):
        lang = ("aa", "bb", "cc")[i % 3]
        rows.append((i, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))), lang))
    return rows


def test_held_out_languages_and_bits(spark):
    rows = labelled(400)
    df = docs_of(rows, spark)
    parser = langid.fit(df)
    got = {r.doc_id: r for r in langid.predict(df, parser).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    bits = sorted(longest_matches(langid.folded(rows[5][1]), t) * math.log2(len(t)) for t in training(df).values())
    assert got[5].score == pytest.approx(1 - bits[0] / bits[1])


def training(df):
    found = {}
    for r in sorted(langid.training_pieces(df, langid.PIECES, langid.ALL_PIECES, langid.PIECE).collect(), key=lambda r: (r.lang, r.piece)):
        found.setdefault(r.lang, []).append(langid.folded(r.piece))
    return {k: b"\0".join(v) for k, v in found.items()}


def test_only_rows_that_may_be_learnt_from(spark):
    rows = labelled(200)
    other = [(i, t if zlib.crc32(str(i).encode()) % 4 != 2 else "zzz", lang if zlib.crc32(str(i).encode()) % 4 != 2 else "never") for i, t, lang in rows]
    a, b = (langid.fit(docs_of(x, spark)) for x in (rows, other + [(None, "qqq", "never"), (300_001, "word", None)]))
    assert a.names == b.names and (a.table == b.table).all()


def test_piece_bound_holds_and_every_language_is_learnt(spark):
    rows = [(i, f"text of {i} here", f"l{i % 40}") for i in range(2000)]
    pieces = langid.training_pieces(docs_of(rows, spark), 128, 80, 256).groupBy("lang").count().collect()
    assert len(pieces) == 40 and {r["count"] for r in pieces} == {2}


def test_odd_tables(spark):
    parser = langid.fit(docs_of(labelled(120), spark))
    df = documents(spark, odd_texts() + [(30, "12 34 !? ² Ⅷ"), (31, "\0 bar\0dun")])
    got = {r.doc_id: r for r in langid.predict(df, parser).collect()}
    assert len(got) == 14 and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 30))
    assert got[4].lang_pred == got[5].lang_pred != "und" and got[31].lang_pred == "aa" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}
    one = langid.fit(docs_of([(i, "bar dun", "aa") for i in range(5)], spark))
    assert {(r.lang_pred, r.score) for r in langid.predict(documents(spark, [(1, "bar"), (2, "é")]), one).collect()} == {("aa", 1.0)}


def test_query_on_held_out_rows(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = langid.op13_langid(spark, sf_dir).collect()
    assert len(rows) == len(lang)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert held and sum(held) / len(held) >= 0.97

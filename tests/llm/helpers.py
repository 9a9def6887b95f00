"""Small inputs for the training-data operators."""

import re

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, key string, words string"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def shingle_set(text, size=5):
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def documents(spark, texts, sources=None):
    """Documents with the columns of the real table and some whose names operators use inside."""
    rows = [(i, t, "en", (sources or {}).get(i, f"src{(i or 0) % 3}"), len(t or ""), 0.5, 1, "k", "w") for i, t in texts]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def odd_texts():
    """Null, empty, blank, one word, very long, tied and repeated texts."""
    long_text = " ".join(f"word{i % 997} x{i}" for i in range(30_000))
    base = " ".join(f"t{i}" for i in range(120))
    return [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (6, long_text), (7, base), (8, base), (9, base + " tail"), (10, "é ü 日本 \U0001f600 ok now then"), (None, "no id here at all you see"), (11, "a" * 100_000)]

import hashlib
import re
import time

from helpers import documents, odd_texts
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from postmill.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def found(spark, texts):
    df = documents(spark, list(enumerate(texts)))
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_personal_data(df).collect()}


HARD = [
    None, "", "a@b.c_d@e.f.g, x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 123-4567 +12 +1.2.3.4.5.6.7.8.9", "é😀 a@b.co 😀 10.0.0.1", "1 " * 5000, "9" * 20_000, "a" * 50_000 + "@b.c",
    "a.b@" * 3000, "+" * 2000 + "1 234 567 890", "@@..@a.b", "12345678901234567890 4111111111111111",
]


def test_base_spans_of_hard_texts(spark):
    got = found(spark, HARD)
    for i, text in enumerate(HARD):
        assert [s for s in got[i] if s[0] in BASE] == base_spans(text or ""), text


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.sampled_from(list("01259.@+- ()ab%_é")), max_size=60), min_size=40, max_size=40))
def test_base_spans_of_any_text(spark, texts):
    got = found(spark, texts)
    for i, text in enumerate(texts):
        assert [s for s in got[i] if s[0] in BASE] == base_spans(text), text


def test_method_adds_confirmed_and_hinted_spans(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 here", "GB82WEST12345698765433", "my ssn is 123-45-6789", "part 123-45-6789"]
    got = found(spark, texts)
    assert [s[0] for s in got[0] if s[0] == "iban"] == ["iban"] and not [s for s in got[1] if s[0] == "iban"]
    assert [s[0] for s in got[2]] == ["ssn"] and got[3] == []


def test_context_after_a_span_and_accounts_followed_by_words(spark):
    account = "DE89370400440532013000"
    texts = ["123-45-6789 is my SSN", "123-45-6789 and 987-65-4321: each an ssn", f"IBAN {account} BIC COBADEFFXXX", f"{account} 2024", f"{account} GB82 WEST 1234 5698 7654 32 EUR", f"{account}BIC", "ssn " + "x " * 40 + "123-45-6789 " + "x " * 40 + "ssn"]
    got = [[s for s in spans if s[0] in ("iban", "ssn")] for _, spans in sorted(found(spark, texts).items())]
    assert got[0] == [("ssn", 0, 11)] and got[1] == [("ssn", 0, 11), ("ssn", 16, 27)]
    assert got[2] == [("iban", 5, 27)] and got[3] == [("iban", 0, 22)]
    assert got[4] == [("iban", 0, 22), ("iban", 23, 50)]
    assert got[5] == [] and got[6] == []


def test_odd_tables(spark):
    df = documents(spark, odd_texts())
    assert pii.find_personal_data(df).count() == df.count()
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in pii.op3_pii(spark, sf_dir).collect():
        spans = base_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[0] for x in spans) for k in BASE)


def test_time_follows_the_spans(spark):
    """A text of 100,000 spans, and one of 12,500: eight times the spans may not take much more than eight times as long."""

    def seconds(n):
        df = documents(spark, [(1, " ".join(f"u{i}@mail{i % 7}.org" for i in range(n)))])
        began = time.perf_counter()
        spans = pii.find_personal_data(df).first().spans
        assert len(spans) == n and (spans[-1].start, spans[-1].end) == (len(df.first().text) - len(f"u{n - 1}@mail{(n - 1) % 7}.org"), len(df.first().text))
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(100_000) < 24 * seconds(12_500) + 10

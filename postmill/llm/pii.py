r"""Personal data in texts, with DataFrame expressions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for account numbers) and words nearby
raise the score of a span, words before it may lower it. The base kinds are email, ip, card and phone; their confirmed spans always stay, the
score only ranks them. Two further kinds, iban and ssn, count from a score of KEEP: an account number with the right check
digits passes by itself, a social security number needs a word such as "ssn" within NEAR characters before or after it.
An account number may be written with blanks, so the run that looks like one may go on into the next words: where a word ends
at its country's length it ends there; else it is also tried up to each blank, and the longest with the right digits counts.

How positions are found: splitting a text by a pattern gives the pieces between the matches, so running sums over the
lengths of pieces and matches are the offsets (code points). The patterns use possessive quantifiers and start only where
a run of their characters starts, so very long runs cost linear time.

Defined results: a null text counts as empty and has no spans; repeated rows give repeated rows; columns other than
doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import table

KEEP = 0.5
NEAR, CHUNK = 40, 64
#: Kinds in the order that breaks ties between spans of one start. Fixed values.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: Countries by the length of their account numbers. Fixed values.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT",
}
USUAL = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in LENGTHS.items())
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{USUAL}|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}(?![A-Za-z0-9]))",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A cheap test that a text must pass to hold a span of the kind at all.
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")),
    "card": lambda t: F.rlike(t, F.lit(r"(?:[0-9][\x20-]?){11}[0-9]")),
    "phone": lambda t: F.rlike(t, F.lit(r"\+[0-9]")),
    "iban": lambda t: F.rlike(t, F.lit(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]")),
    "ssn": lambda t: F.rlike(t, F.lit(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")),
}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
RAISE, LOWER = 0.3, -0.2
#: Words near a span that speak for its kind, and words that speak against personal data at all. Fixed values.
CONTEXT = {
    "email": "(?i)e-?mail|contact|write to|correo|courriel",
    "ip": r"(?i)\bip\b|address|server|host|client",
    "card": r"(?i)card|visa|mastercard|credit|karte|carte|tarjeta",
    "phone": r"(?i)phone|call|tel\b|mobile|fax|telefon",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
    "ssn": r"(?i)\bssn\b|social security|tax id",
}
AGAINST = r"(?i)version|example|isbn|invoice no|order no"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def step(acc, c):
        d = c.cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.struct((acc["sum"] + F.when(acc["odd"], twice).otherwise(d)).alias("sum"), (~acc["odd"]).alias("odd"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd"))
    return F.aggregate(F.split(F.reverse(number), "(?<=.)(?=.)"), start, step, lambda acc: acc["sum"] % 10 == 0)


def mod97(account: Column) -> Column:
    """Whether an account number without blanks has the right check digits (remainder 1 modulo 97)."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def step(acc, c):
        code = F.ascii(c)
        return F.when(code < 58, acc * 10 + code - 48).otherwise(acc * 100 + code - 55) % 97

    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step) == 1


def account(m: Column) -> Column:
    """The part of a match, all of it or up to a blank, that is an account number; null if none is."""

    def bare(x):
        return F.replace(x, F.lit(" "), F.lit(""))

    words = F.split(m, " ")
    parts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
    good = F.filter(parts, lambda x: (F.char_length(bare(x)) >= 15) & mod97(bare(x)))
    return F.get(good, F.size(good) - 1)


def confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.rlike(m, F.lit(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"))
    if kind == "card":
        n = F.char_length(digits(m))
        return F.when((n >= 12) & (n <= 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        n = F.char_length(digits(m))
        return (n >= 9) & (n <= 15)
    if kind == "iban":
        return account(m).isNotNull()
    return F.lit(True)


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: what a lambda takes from outside would be computed for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def found(kind: str, text: Column) -> Column:
    """Array of (start, rank of kind, end, kind, score) for one kind.

    Pieces and matches run side by side, each match with the beginnings of the pieces after it. They are gone through CHUNK at a
    time, so that the spans found so far are copied for each chunk and not for each span."""
    none = F.array().cast("array<struct<start: int, rank: int, end: int, kind: string, score: double>>")
    state = lambda at, out, last: F.struct(at.alias("at"), out.alias("out"), last.alias("last"))

    def step(acc, x):
        start = acc["at"] + F.char_length(x["piece"])
        end = start + F.coalesce(F.char_length(x["match"]), F.lit(0))
        before = F.concat(F.right(acc["last"], F.lit(NEAR)), F.right(x["piece"], F.lit(NEAR)))
        after = F.concat(*(F.coalesce(x[c], F.lit("")) for c in ("next", "second")))
        score = (
            F.lit(PRIOR[kind])
            + F.when(F.rlike(before, F.lit(CONTEXT[kind])) | F.rlike(after, F.lit(CONTEXT[kind])), RAISE).otherwise(0.0)
            + F.when(F.rlike(before, F.lit(AGAINST)), LOWER).otherwise(0.0)
        )
        score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)
        stop = start + F.char_length(account(x["match"])) if kind == "iban" else end
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), stop.alias("end"), F.lit(kind).alias("kind"), score.alias("score"))
        good = x["match"].isNotNull() & confirmed(kind, x["match"])
        return state(end, F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]), F.right(x["piece"], F.lit(NEAR)))

    def chunk(acc, part):
        inside = F.aggregate(part, state(acc["at"], none, acc["last"]), step)
        return let(inside, lambda x: state(x["at"], F.concat(acc["out"], F.array(x["out"])), x["last"]))

    def beside(pieces):
        heads = lambda k: F.transform(F.slice(pieces, F.lit(k), F.size(pieces)), lambda x: F.left(x, F.lit(NEAR)))
        return F.arrays_zip(pieces.alias("piece"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("match"), heads(2).alias("next"), heads(3).alias("second"))

    def spans(rows):
        chunks = F.transform(F.sequence(F.lit(1), F.size(rows), F.lit(CHUNK)), lambda i: F.slice(rows, i, CHUNK))
        return F.flatten(F.aggregate(chunks, state(F.lit(0), F.array(none), F.lit("")), chunk)["out"])

    every = let(F.split(text, PATTERNS[kind], -1), lambda pieces: let(beside(pieces), spans))
    if kind in ("iban", "ssn"):
        every = F.filter(every, lambda s: s["score"] >= KEEP)
    return F.when(HINTS[kind](text), every).otherwise(none)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(df: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, spans): all spans of a text by start, then kind, as structs with start, end, kind and score."""
    texts = df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kinds = texts.select("doc_id", *(found(k, F.col("text")).alias(k) for k in KINDS))
    return kinds.select("doc_id", F.array_sort(F.concat(*KINDS)).alias("spans"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_personal_data(table(spark, sf_dir, "documents"))
    base = spans.select("doc_id", "spans", F.filter("spans", lambda s: s["rank"] < 4).alias("base"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return base.select(
        "doc_id",
        *(count(k) for k in KINDS[:4]),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )

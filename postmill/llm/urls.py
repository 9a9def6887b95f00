r"""URL filters: listed rules first, then association rules that FP-growth mines from labelled URLs.

The tokens of a URL are its scheme, each suffix of its host, its path segments (numbers as one token) and its query keys.
FP-growth runs over the labelled URLs, with counts of all and of those to be blocked; rules "tokens -> block" stay when their
support and confidence reach the parameters and the confidence lies MIN_Z standard errors above the label's own share, which any
share leaves room for. Of rules for the same label the longer goes unless it is more confident. The rules are held in an inverted
index, each under its rarest token; a URL fits a rule when it has all of the rule's tokens.

The patterns grow level by level, from the rarest token to the most frequent: a table holds the conditional pattern base of every
set that grows (the distinct beginnings of its URLs with their counts), and one grouping makes those of all sets of one token more.
So no tree lies in one task's memory, and all frequent tokens of a URL take part. No rule is lost by what doesn't grow:
- of tokens that stand in exactly the same labelled URLs one speaks for all, the longest;
- a set that as many URLs have as one of its parts says what the part says, and so do all sets that hold it (a longer suffix of a
  host implies the shorter ones, so no set has two; tokens that imply each other in a chain make no sets at all);
- a set whose URLs are all to be blocked can't be made more confident;
- a set that fewer URLs to be blocked have than a rule needs is in no set that makes a rule.
Spark's own FP-growth lists every frequent set, 2^20 for a chain of 20 tokens. What grows here is as many as there are different
choices of URLs that frequent tokens make, which is exponential too where many of them stand independently in the same URLs; that
costs time and disk.

Two sources teach rules, each by itself: the labels of the pages, and the list, whose verdicts on the pages it decides are labels as
well; so neither drowns the other, and the column taught says which one a page's rule comes from (labels first where both do).

Defined results: a null URL or one without "://" has an empty host and path, fits no listed rule and no tokens but those
it has; a host of more than HOST characters, which can't be one, is one token; repeated rows give repeated rows; without labels
no rules are mined and the default verdict stands; columns other than page_id and url are ignored.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.llm.common import stash, table

#: (verdict, host, path prefix). Fixed values of the query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, MIN_Z, HOST = 0.002, 20, 0.8, 4.0, 253
#: Most rows (some numbers each) of matched token sets, of rules, and of mined sets that are broadcast.
BROADCAST_ROWS = 200_000
RULE_COLUMNS = "rule long, names array<string>, items array<long>, rare long, confidence double, support double"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ://."""
    u = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return host, path


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """The longest listed rule (host and path together) that fits, as struct(rule, verdict); null if none does."""
    rule = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(rule)
    return rule


def suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(F.char_length(host) <= HOST, every).otherwise(F.array(host))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Tokens of a URL; one may stand there twice."""
    u = F.coalesce(url, F.lit(""))
    hosts = F.transform(suffixes(host), lambda x: F.concat(F.lit("host="), x))
    segments = F.transform(F.split(path, "/"), lambda s: F.concat(F.lit("path="), F.regexp_replace(s, "[0-9]+", "0")))
    keys = F.transform(F.regexp_extract_all(u, F.lit(r"[?&]([^=&#]*)"), F.lit(1)), lambda k: F.concat(F.lit("key="), k))
    scheme = F.array(F.concat(F.lit("scheme="), F.regexp_extract(u, r"(?s)^(.*?)://", 1)))
    return F.filter(F.concat(scheme, hosts, segments, keys), lambda t: ~F.rlike(t, F.lit("=$")))


def numbers(names: Column) -> Column:
    """Distinct 64-bit hashes of tokens."""
    return F.array_distinct(F.transform(names, lambda t: F.xxhash64(t)))


def frequent_tokens(labelled: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """(token, name, n, b, rank): tokens of `least` URLs to be blocked and more, one for those that stand in the same URLs; n URLs have
    it, b of them are to be blocked, the most frequent has rank 1. Sums of the URLs' hashes tell which tokens stand in the same ones."""
    each = rows.select(F.xxhash64("id").cast("decimal(20,0)").alias("row"), "block", F.explode("items").alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("block").alias("b"), F.sum("row").alias("same")).where(F.col("b") >= least)
    words = labelled.select(F.explode("tokens").alias("name")).distinct().select("name", F.xxhash64("name").alias("token"))
    named = counts.join(words, "token").groupBy("token", "n", "b", "same").agg(F.min("name").alias("name"))
    longest = F.max(F.struct(F.char_length("name").alias("size"), "name", "token")).alias("best")
    known = named.groupBy("n", "b", "same").agg(longest).select("best.token", "best.name", "n", "b")
    return known.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "name")))  # these are at most a URL's tokens, on average, over `support`


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def deeper(bases: DataFrame, grow: DataFrame, rows: int) -> DataFrame:
    """(set, prefix, n, b), the conditional pattern bases of sets, to those of the sets in `grow`, which have one token more. Of a
    prefix only tokens that the set can grow by itself are left, as all parts of a set that grows do."""
    more = grow.groupBy(F.slice("set", 1, F.size("set") - 1).alias("set")).agg(F.collect_list(F.element_at("set", -1)).alias("by"))
    kept = bases.join(small(more, rows), "set").select("set", F.sort_array(F.array_intersect("prefix", "by")).alias("kept"), "n", "b")
    each = kept.select("set", "kept", "n", "b", F.posexplode("kept").alias("at", "rank")).where("at > 0")
    return each.groupBy(F.concat("set", F.array("rank")).alias("set"), F.slice("kept", 1, F.col("at")).alias("prefix")).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))


def grown(bases: DataFrame, grow: DataFrame, rows: int, least: int, told: Column) -> DataFrame:
    """(set, n, b, top): the sets of one token more that `least` URLs to be blocked have, and fewer URLs than each of their parts has.
    top: the best confidence of a rule among the parts."""
    counts = bases.select("set", F.explode("prefix").alias("rank"), "n", "b").groupBy(F.concat("set", F.array("rank")).alias("set")).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    less = counts.where(F.col("b") >= least).select("set", "n", "b", F.explode("set").alias("rank")).select("set", "n", "b", F.array_remove("set", F.col("rank")).alias("part"))
    parts = grow.select(F.col("set").alias("part"), F.col("n").alias("of"), F.greatest("top", told).alias("top"))
    both = less.join(small(parts, rows), "part").where("of > n")
    return both.groupBy("set", "n", "b").agg(F.count("*").alias("parts"), F.max("top").alias("top")).where(F.col("parts") == F.size("set")).drop("parts")


def mine(labelled: DataFrame, support: float = MIN_SUPPORT, count: int = MIN_COUNT, confidence: float = MIN_CONFIDENCE, z: float = MIN_Z) -> DataFrame:
    """(tokens array<string>, block boolean) to the kept rules: names and hashes of their tokens, the rarest of these, confidence,
    support. Frequent means a share of `support` and at least `count` URLs."""
    spark = labelled.sparkSession
    rows = stash(labelled.select(F.monotonically_increasing_id().alias("id"), numbers(F.col("tokens")).alias("items"), "block"), "labelled")
    n, base = rows.agg(F.count("*"), F.avg(F.col("block").cast("int"))).first()
    if n < count or not base:
        return spark.createDataFrame([], RULE_COLUMNS)
    # with b URLs to be blocked no set lies further above the label's share than one that has no others: (1 - base)^2 >= z^2 base (1 - base) / b
    least = max(count, ceil(support * n), floor(z * z * base / (1 - base)) if base < 1 else 0)
    known = stash(frequent_tokens(labelled, rows, least), "tokens")
    ranks = rows.select("id", "block", F.explode("items").alias("token")).join(known.select("token", "rank"), "token")
    urls = ranks.groupBy("id", "block").agg(F.sort_array(F.collect_list("rank")).alias("prefix"))  # bounded by a URL's tokens
    nothing = F.array().cast("array<int>")
    bases = stash(urls.groupBy("prefix").agg(F.count("*").alias("n"), F.count_if("block").alias("b")).select(nothing.alias("set"), "prefix", "n", "b"), "bases")
    sets = known.select(F.array("rank").alias("set"), "n", "b", F.lit(0.0).alias("top"))
    sure = F.col("b") / F.col("n")
    good = (sure >= confidence) & (sure - base >= z * F.sqrt(F.lit(base * (1 - base)) / F.col("n")))
    told = F.when(good, sure)
    rules = sets.where(good)
    while many := (grow := sets.where((F.col("b") < F.col("n")) & (F.col("n") < n))).count():
        bases = stash(deeper(bases, grow, many), "bases")
        sets = stash(grown(bases, grow, many, least, told), "sets")
        rules = rules.unionByName(sets.where(good & (sure > F.col("top"))))
    named = rules.select("set", "n", "b", F.explode("set").alias("rank")).join(known.select("rank", "name", "token", F.col("n").alias("of")), "rank")
    names = F.array_sort(F.collect_list("name")).alias("names")
    named = named.groupBy("set", "n", "b").agg(names, F.min_by("token", F.struct("of", "token")).alias("rare"))
    items = F.transform("names", lambda t: F.xxhash64(t)).alias("items")
    return without_implied(stash(named.select(F.xxhash64("names").alias("rule"), "names", items, "rare", sure.alias("confidence"), (F.col("b") / n).alias("support")), "rules"))


def without_implied(rules: DataFrame) -> DataFrame:
    """Rules but for those that say no more than one of fewer tokens; a suffix of a host implies the shorter ones."""
    host = F.get(F.filter("names", lambda t: F.startswith(t, F.lit("host="))), 0)
    closed = F.array_union("names", F.when(host.isNotNull(), F.transform(suffixes(F.substr(host, F.lit(6))), lambda x: F.concat(F.lit("host="), x))).otherwise(F.array().cast("array<string>")))
    full = rules.select("rule", F.col("confidence").alias("sure"), numbers(closed).alias("all"))
    parts = rules.select(F.col("rule").alias("part"), "items", "confidence", F.col("rare").alias("token"))
    both = full.select("*", F.explode("all").alias("token")).join(parts, "token").where((F.col("part") != F.col("rule")) & (F.col("confidence") >= F.col("sure")) & (F.size(F.array_except("items", "all")) == 0))
    return rules.join(both.select("rule").distinct(), "rule", "left_anti")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, tokens) against rules (rule, items, rare, confidence, taught) by the inverted index: (key, confidence and taught of the
    best rule that fits). Rules are broadcast where they are few; else the join is shuffled, and the session splits it where a token
    is frequent."""
    index = rules.select(F.col("rare").alias("token"), "items", "confidence", "taught")
    if rules.count() <= BROADCAST_ROWS:
        index = F.broadcast(index)
    hits = urls.select("key", "tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("items", "tokens")) == 0)
    best = F.max(F.struct((F.col("taught") == "labels").alias("first"), "confidence", "taught")).alias("best")
    return hits.groupBy("key").agg(best).select("key", "best.confidence", "best.taught")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, **limits) -> DataFrame:
    """(page_id, url) to (page_id, host, path, rule, verdict, confidence, taught). labels: (page_id, block boolean).

    URLs with the same tokens are matched once: a hash of the token set is the key of the match."""
    host, path = parts(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    full = split.select("page_id", "host", "path", tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), listed(F.col("host"), F.col("path"), rules).alias("fits"))
    known = labels.groupBy("page_id").agg(F.max("block").alias("block")).where("block is not null")
    said = {"labels": full.join(known, "page_id").select("tokens", "block"), "list": full.where("fits is not null").select("tokens", (F.col("fits")["verdict"] == "block").alias("block"))}
    taught = [mine(rows, **limits).withColumn("taught", F.lit(source)) for source, rows in said.items()]
    mined = stash(taught[0].unionByName(taught[1]), "mined")
    full = full.withColumn("tokens", numbers(F.col("tokens"))).withColumn("key", F.xxhash64(F.array_sort("tokens")))
    sets = full.where("fits is null").groupBy("key").agg(F.any_value("tokens").alias("tokens"))
    best = stash(match(sets, mined), "hits")
    if best.count() <= BROADCAST_ROWS:  # else a shuffled join, which the session splits where a token set is frequent
        best = F.broadcast(best)
    out = full.select("page_id", "host", "path", "fits", "key").join(best, "key", "left")
    verdict = F.coalesce(F.col("fits")["verdict"], F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    by_rule = lambda c: F.when(F.col("fits").isNull(), F.col(c)).alias(c)
    return out.select("page_id", "host", "path", F.col("fits")["rule"].alias("rule"), verdict.alias("verdict"), by_rule("confidence"), by_rule("taught"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; a page is labelled as one to block when its label row says low quality or toxic."""
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), marks)

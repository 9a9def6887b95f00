"""Comparisons: manifests with a target, lists by position, multisets, words, addresses, texts; and joins by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import codes, texts
from postmill.operators.report import counted, lines


def preflight(planned: DataFrame, found: DataFrame) -> DataFrame:
    """Each planned or found file: create, identical, replace, blocked (something else stands there) or unknown. Sizes come before hashes."""
    p = planned.select("rel", F.col("size").alias("p_size"), F.col("sha256").alias("p_sha"))
    f = found.select("rel", F.col("size").alias("f_size"), F.col("sha256").alias("f_sha"), "is_file")
    both = p.join(f, "rel", "full_outer")
    what = (
        F.when(F.col("p_size").isNull(), "unknown")
        .when(F.col("f_size").isNull(), "create")
        .when(~F.col("is_file"), "blocked")
        .when(F.col("p_size") != F.col("f_size"), "replace")
        .when(F.col("p_sha") == F.col("f_sha"), "identical")
        .otherwise("replace")
    )
    return both.select("rel", what.alias("disposition"))


#: Why an export may not go on, by the state of its target. Fixed values.
REFUSALS = {"not_owned": "refused_target_not_owned", "other_source": "refused_target_source_mismatch"}


def decision(dispositions: DataFrame, consent: bool = False, state: str = "absent", over_budget: bool = False) -> DataFrame:
    """The preflight's counts and what follows from them and from the target's state: go, or the refusal's label."""
    n = lambda x: F.count_if(F.col("disposition") == x)
    row = counted(dispositions, create=n("create"), identical=n("identical"), replace=n("replace"), blocked=n("blocked"), unknown=n("unknown"))
    first = REFUSALS.get(state) or ("refused_plan_over_budget" if over_budget else None)
    label = F.coalesce(F.lit(first).cast("string"), F.when(F.col("blocked") > 0, "refused_target_blocked").when((F.col("replace") > 0) & F.lit(not consent), "refused_needs_consent").otherwise("go"))
    return row.withColumn("decision", label)


def not_planned(found: DataFrame, planned: DataFrame) -> DataFrame:
    """Entries at the target that no plan has; a directory that no planned file is in counts once, whatever is in it."""
    top = F.regexp_extract("rel", r"^[^/]*", 0)
    known = planned.select(top.alias("top")).distinct()
    rest = found.join(planned.select("rel"), "rel", "left_anti").withColumn("top", top)
    inside = rest.join(known, "top", "left_semi").select(F.col("rel").alias("entry"), F.lit(1).cast("long").alias("files"))
    outside = rest.join(known, "top", "left_anti").groupBy(F.col("top").alias("entry")).agg(F.count("*").alias("files"))
    return inside.unionByName(outside)


def tree_hash(manifest: DataFrame) -> DataFrame:
    """One hash over all paths and their hashes, independent of their order; another hash than one over a sorted list of all lines
    would be, which no single task could hold. Three levels by the leading digits of a path's MD5
    (6, 3, none), each a hash over its sorted parts, so that no list grows with a directory or the tree."""
    up = lambda rows: F.sha2(F.array_join(F.array_sort(F.collect_list(rows)), ""), 256).alias("sha")
    leaves = manifest.select(F.substring(F.md5(F.col("rel").cast("binary")), 1, 6).alias("p"), F.concat("rel", F.lit("\t"), "sha256", F.lit("\n")).alias("line"))
    low = leaves.groupBy("p").agg(up(F.col("line")), F.count("*").alias("n"))
    part = F.concat("p", F.lit("\t"), "sha", F.lit("\n"))
    middle = low.select(F.substring("p", 1, 3).alias("p"), part.alias("line"), "n").groupBy("p").agg(up(F.col("line")), F.sum("n").alias("n"))
    return middle.agg(up(part).alias("tree_sha256"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"))


def by_position(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Pairs of rows at the same (message_id, pos): how their values compare."""
    both = left.select("message_id", "pos", F.col(value).alias("a"), F.lit(True).alias("in_a")).join(right.select("message_id", "pos", F.col(value).alias("b"), F.lit(True).alias("in_b")), ["message_id", "pos"], "full_outer")
    return both.select("message_id", "pos", outcome(F.col("in_a"), F.col("in_b"), F.col("a"), F.col("b")).alias("outcome"))


def outcome(in_a: Column, in_b: Column, a: Column, b: Column) -> Column:
    return F.when(in_b.isNull(), "only_left").when(in_a.isNull(), "only_right").when(a.isNull() & b.isNull(), "both_absent").when(a.eqNullSafe(b), "equal").when(a.isNull() | b.isNull(), "one_absent").otherwise("different")


def same_multiset(left: DataFrame, right: DataFrame, key: str, *values: str) -> DataFrame:
    """For each key whether both sides have the same values equally often: counts are compared, no lists are built."""
    one = left.select(key, *values, F.lit(1).alias("d")).unionByName(right.select(key, *values, F.lit(-1).alias("d")))
    balance = one.groupBy(key, *values).agg(F.sum("d").alias("d"))
    return balance.groupBy(key).agg((F.max(F.abs("d")) == 0).alias("same"), F.sum(F.greatest(F.col("d"), F.lit(0))).alias("missing"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("extra"))


def word_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Words (key, word) that either side has more often: matched, missing on the right, extra on the right."""
    count = lambda df, n: df.groupBy(key, "word").agg(F.count("*").alias(n))
    a, b = (F.coalesce(c, F.lit(0)) for c in ("a", "b"))
    both = count(left, "a").join(count(right, "b"), [key, "word"], "full_outer")
    return both.groupBy(key).agg(F.sum(F.least(a, b)).alias("matched"), F.sum(F.greatest(a - b, F.lit(0))).alias("missing"), F.sum(F.greatest(b - a, F.lit(0))).alias("extra"))


def agreement(a: Column, b: Column) -> Column:
    """How closely two HTML texts agree: equal, but for newlines, for white space, for tags' case, in their visible text, or not."""
    squeezed = lambda c: F.regexp_replace(c, r"\s+", "")
    visible = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*(?:>|\z)", ""), r"\s", "")
    return (
        F.when(a == b, "identical")
        .when(texts.newlines(a) == texts.newlines(b), "newlines_differ")
        .when(squeezed(a) == squeezed(b), "white_space_differs")
        .when(F.lower(squeezed(a)) == F.lower(squeezed(b)), "case_differs")
        .when(visible(a) == visible(b), "visible_text_equal")
        .otherwise("different")
    )


def email_outcome(email_a: Column, smtp_a: Column, email_b: Column, smtp_b: Column) -> Column:
    same = lambda x, y: F.coalesce(x, F.lit("")) == F.coalesce(y, F.lit(""))
    e, s = same(email_a, email_b), same(smtp_a, smtp_b)
    return F.when(e & s, "both").when(e, "email").when(s, "smtp").otherwise("neither")


def expected_streams(properties: DataFrame, entries: DataFrame) -> DataFrame:
    """Variable-length properties against the streams that must hold them: found, missing, of another size than declared."""
    v = properties.where(codes.type_shape(F.col("property_type")) == "variable").select("file", "property_type", codes.stream_path(F.lit(""), F.col("property_id"), F.col("property_type")).alias("path"), F.col("value").alias("declared"))
    streams = entries.where("is_stream").groupBy("file", "path").agg(F.max("len").alias("len"))
    both = v.join(streams, ["file", "path"], "left")
    return lines(
        counted(
            both, expected=F.count("*"), found=F.count("len"), missing=F.count_if(F.col("len").isNull()),
            size_differs=F.count_if(codes.declared_size(F.col("property_type"), F.col("len")) != F.col("declared")), distinct_paths=F.count_distinct("path"),
        )
    )


def custom_roots(entries: DataFrame) -> DataFrame:
    """Entries under storages that hold no properties stream: for each the outermost such storage."""
    shaped = entries.where("name = '__properties_version1.0'").select("file", "parent").distinct()
    parts = F.split("parent", "/")
    ups = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    up = entries.where("parent <> ''").select("file", "ord", "path", F.explode(ups).alias("up"))
    loose = up.join(shaped.withColumnRenamed("parent", "up"), ["file", "up"], "left_anti")
    return loose.groupBy("file", "ord", "path").agg(F.min_by("up", F.char_length("up")).alias("custom_root"))

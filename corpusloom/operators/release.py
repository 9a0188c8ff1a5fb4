"""Three-valued funnels, profiles and consistency checks of a release."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import scalar as S
from corpusloom.operators.relational import exact_quantiles


def all_of(*cols: Column) -> Column:
    """Kleene and: false if any is false, else null if any is null."""
    return reduce(lambda a, b: a & b, cols)


def reached(gate: Column, previous: Column | None) -> Column:
    """A gate's value where the one before was passed, else null."""
    return gate if previous is None else F.when(previous, gate)


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """step, name, remaining, rejected: rows that pass every step so far, in one pass over the rows."""
    passed, sums = F.lit(True), [F.count("*").alias("s0")]
    for i, (_, ok) in enumerate(steps, 1):
        passed = passed & F.coalesce(ok, F.lit(False))
        sums.append(F.count_if(passed).alias(f"s{i}"))
    names = ["all", *(n for n, _ in steps)]
    rows = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(f"s{i}").alias("remaining"), (F.col(f"s{max(0, i - 1)}") - F.col(f"s{i}")).alias("rejected")) for i, n in enumerate(names)))
    return df.agg(*sums).select(F.inline(rows))


def funnel_reasons(df: DataFrame, steps: list[tuple[str, Column, dict[str, Column]]]) -> DataFrame:
    """step, name, remaining, reason, rejected: of the rows that reach a step and don't pass it, how many have each reason.

    A row may have several reasons; one without any counts as ``other``.
    """
    reached_, sums, rows = F.lit(True), [], []
    for i, (name, ok, reasons) in enumerate(steps, 1):
        passed = reached_ & F.coalesce(ok, F.lit(False))
        failed = reached_ & ~F.coalesce(ok, F.lit(False))
        every = {r: failed & F.coalesce(c, F.lit(False)) for r, c in reasons.items()}
        other = reduce(lambda a, b: a & ~F.coalesce(b, F.lit(False)), reasons.values(), failed)
        sums += [F.count_if(passed).alias(f"p{i}"), *(F.count_if(c).alias(f"r{i}_{k}") for k, c in enumerate((*every.values(), other)))]
        rows += [F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(f"p{i}").alias("remaining"), F.lit(r).alias("reason"), F.col(f"r{i}_{k}").alias("rejected")) for k, r in enumerate((*every, "other"))]
        reached_ = passed
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def profile(df: DataFrame, listed: int = 8) -> DataFrame:
    """column_name, dtype, n_null, n_distinct, min_value, max_value, median (numbers) and ``listing`` (``value:n`` of
    columns of at most ``listed`` values, in order of value) of every atomic column.

    Rows become counts of distinct values of a column before anything else, so all measures are exact and no task holds
    a whole column.
    """
    cols = [f for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType, T.NumericType, T.DateType, T.TimestampType))]
    number = lambda f: F.col(f"`{f.name}`").cast("double") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"`{f.name}`").cast("string").alias("v"), number(f).alias("x")) for i, f in enumerate(cols)))
    counts = df.select(F.inline(each)).groupBy("i", "v", "x").agg(F.count("*").alias("n"))
    known = counts.filter("v is not null")
    w = Window.partitionBy("i").orderBy(F.col("x").asc_nulls_last(), "v")
    first = known.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= listed).groupBy("i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat("v", F.lit(":"), F.col("n").cast("string")).alias("s")))), lambda r: r["s"]), "; ").alias("listing"))
    bounds = counts.groupBy("i").agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.count("v").alias("n_distinct"), F.min_by("v", F.col("x")).alias("lo_x"), F.max_by("v", F.col("x")).alias("hi_x"), F.min("v").alias("lo_v"), F.max("v").alias("hi_v"))
    middle = exact_quantiles(df.select(F.inline(each)).filter("x is not null"), "x", [0.5], "i").select("i", F.round("q0", 6).alias("median"))
    names = df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(cols)], "i int, column_name string, dtype string")
    out = names.join(bounds, "i", "left").join(first, "i", "left").join(middle, "i", "left")
    zero = F.lit(0).cast("long")
    return out.select("column_name", "dtype", F.coalesce("n_null", zero).alias("n_null"), F.coalesce("n_distinct", zero).alias("n_distinct"), F.coalesce("lo_x", "lo_v").alias("min_value"), F.coalesce("hi_x", "hi_v").alias("max_value"), "median", F.when(F.col("n_distinct") <= listed, F.col("listing")).alias("listing"))


def differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in one table only, as counts: both are 0 if the sets are equal."""
    left = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("only_left"))
    right = b.select(key).distinct().join(a.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("only_right"))
    return left.crossJoin(right)  # one row each


def failed_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, n_failed: rows for which a condition is not true."""
    sums = [F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(checks.values())]
    rows = F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(f"c{i}").alias("n_failed")) for i, n in enumerate(checks)))
    return df.agg(*sums).select(F.inline(rows))


def require(df: DataFrame, expected: dict[str, int]) -> None:
    """Raise if a named count of a (name, n) table is not what is expected; nothing is written then."""
    got = {r[0]: r[1] for r in df.filter(F.col(df.columns[0]).isin(*expected)).collect()}
    wrong = {k: (got.get(k), v) for k, v in expected.items() if got.get(k) != v}
    if wrong:
        raise ValueError(f"counts differ (found, expected): {wrong}")


def rendered(value, percent_of: int | None = None) -> str:
    """A value for a document: thousands separated, floats to four digits, booleans in lower case; with ``percent_of``
    a share in per cent to one decimal.
    """
    if percent_of is not None:
        return f"{round(100 * value / percent_of, 1)}%" if percent_of else "-"
    if value is None:
        return "-"
    if isinstance(value, bool):
        return str(value).lower()
    return f"{value:,}" if isinstance(value, int) else f"{value:.4g}" if isinstance(value, float) else str(value)


def corpus_facts(df: DataFrame, flags: list[str]) -> DataFrame:
    """One row of facts about a released corpus, in one pass but for hashes that several rows share.

    Wants ``uid``, ``url``, ``domain``, ``sha256``, ``phash``, ``has_text``, boolean ``flags`` (the first is the one whose
    share is stated), ``legend_is_classed``, ``confidence``, ``is_duplicate``, ``group_id``.
    """
    n_flags = sum((F.coalesce(F.col(f), F.lit(False)).cast("int") for f in flags), F.lit(0))
    main, legend = F.coalesce(F.col(flags[0]), F.lit(False)), F.col("legend_is_classed")
    only = main & (n_flags == 1)
    by = lambda c, values, name: [F.count_if(c == v).alias(f"{name}_{v}") for v in values]
    facts = df.agg(
        F.count("*").alias("rows"), F.count_if(F.startswith("url", F.lit("https"))).alias("https"), F.countDistinct("domain").alias("domains"), F.countDistinct("sha256").alias("sha256_distinct"), F.countDistinct("phash").alias("phash_distinct"),
        F.count_if(~F.col("has_text")).alias("has_text_false"), F.count_if(main).alias("main"), F.round(100 * F.count_if(main) / F.count("*"), 1).alias("main_pct"), *by(n_flags, range(1, len(flags) + 1), "flags"),
        F.count_if(legend.isNull()).alias("legend_null"), F.count_if(legend).alias("legend_true"), F.count_if(~legend).alias("legend_false"), *by(F.col("confidence"), ("high", "medium", "low"), "confidence"),
        F.count_if("is_duplicate").alias("duplicates"), F.count("group_id").alias("grouped_rows"), F.countDistinct("group_id").alias("groups"), F.count_if(only).alias("main_only"), F.count_if(only & legend.isNull()).alias("main_only_null"),
    )
    shared = df.groupBy("phash").agg(F.count("*").alias("n"), F.count_if(F.col("group_id").isNull()).alias("free")).filter("n > 1 and phash is not null")
    return facts.withColumn("columns", F.lit(len(df.columns))).crossJoin(shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("phash_shared_rows"), F.coalesce(F.sum("free"), F.lit(0)).alias("phash_shared_ungrouped")))  # one row each


def verify_package(main: DataFrame, flags: list[str], constants: dict[str, str], vectors: DataFrame | None = None, candidates: DataFrame | None = None, validation: DataFrame | None = None, size: int = 768) -> DataFrame:
    """check_name, n_failed (0: passed) of a release's main table and, where given, its vectors, candidates, validation.

    Per-row checks are one pass; uniqueness, keepers and equality of id sets are aggregations and anti-joins.
    """
    n_flags = sum((F.coalesce(F.col(f), F.lit(False)).cast("int") for f in flags), F.lit(0))
    rows = failed_checks(main, {
        "sha256 present": F.col("sha256").isNotNull(), "phash has 16 hex digits": F.rlike("phash", F.lit("^[0-9a-f]{16}$")), "at least one flag": F.col("methods_count") >= 1,
        "count is the number of flags": F.col("methods_count") == n_flags, "legend only with a flag": F.col("legend_is_classed").isNull() | (F.col("methods_count") >= 1),
        "duplicate only with a group": ~F.coalesce(F.col("is_duplicate"), F.lit(False)) | F.col("group_id").isNotNull(),
    })
    one = lambda df, name: df.select(F.lit(name).alias("check_name"), F.coalesce(F.col(df.columns[0]).cast("long"), F.lit(0).cast("long")).alias("n_failed"))
    repeats = lambda df, name: one(df.groupBy("uid").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("x")), name)
    both = lambda a, b, name: one(differences(a, b, "uid").select(F.col("only_left") + F.col("only_right")), name)
    groups = main.filter("group_id is not null").groupBy("group_id").agg(F.count_if(~F.coalesce("is_duplicate", F.lit(False))).alias("kept"), F.count("*").alias("n"), F.count_if("is_duplicate").alias("flagged"))
    out = [repeats(main, "uid is unique"), rows, one(groups.agg(F.count_if(F.col("kept") != 1)), "one keeper in each group"), one(groups.agg(F.abs(F.sum("n") - F.count("*") - F.sum("flagged"))), "grouped are keepers and flagged copies")]
    legend = main.schema["legend_is_classed"].dataType.simpleString() == "boolean"
    recorded = {"inclusion_criteria", "source_corpus"} <= set(constants)
    out.append(main.sparkSession.createDataFrame([("legend is boolean", int(not legend)), ("criteria are recorded", int(not recorded))], "check_name string, n_failed long"))
    if vectors is not None:
        out += [both(main, vectors, "vectors: same ids"), failed_checks(vectors, {f"vectors: {size} floats": F.size("embedding") == size})]
        out.append(main.sparkSession.createDataFrame([("vectors: float", int(vectors.schema["embedding"].dataType.simpleString() != "array<float>"))], "check_name string, n_failed long"))
    if candidates is not None:
        out += [repeats(candidates, "candidates: uid is unique"), both(main, candidates.filter("in_corpus"), "candidates: in_corpus marks the main table")]
        if validation is not None:
            out.append(one(differences(validation, candidates, "uid").select("only_left"), "validation: every uid is a candidate"))
    return reduce(DataFrame.unionByName, out)


def blinded(sample: DataFrame, shown: list[str], seed: int) -> DataFrame:
    """``position`` and the shown columns in a seeded order that doesn't follow the strata, which stay behind.

    A sample for people is small; the order is total, and one task ranks the ids.
    """
    order = [S.seeded(seed, F.col("uid")), F.col("uid")]
    return sample.withColumn("position", F.row_number().over(Window.orderBy(*order))).select("position", *shown)

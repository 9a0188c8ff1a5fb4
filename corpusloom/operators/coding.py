"""Codings by people and models: field analyses, independence, error patterns, repeated runs.

Codings are long tables: ``uid``, ``field``, ``source`` (a coder, the model, production, a run), ``value``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import scalar as S
from corpusloom.operators import statistics as T

MISSING = "cannot_assess"


def paired(codings: DataFrame, first: str, second: str) -> DataFrame:
    """uid, field, ``a``, ``b``: codings of both sources, one row for a uid and field; repeated ones: the greatest."""
    pick = lambda s: F.max(F.when(F.col("source") == s, F.col("value")))
    return codings.filter(F.col("source").isin(first, second)).groupBy("uid", "field").agg(pick(first).alias("a"), pick(second).alias("b")).filter("a is not null and b is not null")


def _kappa(n: Column, same: Column, chance: Column) -> Column:
    po, pe = S.ratio(same, n), S.ratio(chance, n * n)
    return F.when(F.abs(1 - pe) > 1e-12, (po - pe) / (1 - pe))


def pair_statistics(pairs: DataFrame, by: list[str]) -> DataFrame:
    """n, agreement and Cohen's kappa of columns ``a``, ``b`` for each ``by``; kappa is null where chance is certain."""
    cells = pairs.groupBy(*by, "a", "b").agg(F.count("*").alias("c"))
    total = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    left, right = cells.groupBy(*by, F.col("a").alias("v")).agg(F.sum("c").alias("x")), cells.groupBy(*by, F.col("b").alias("v")).agg(F.sum("c").alias("y"))
    chance = left.join(right, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    out = total.join(chance, by, "left").withColumn("xy", F.coalesce("xy", F.lit(0)))
    return out.select(*by, "n", F.round(S.ratio(F.col("same"), F.col("n")), 6).alias("agreement"), F.round(_kappa(F.col("n"), F.col("same"), F.col("xy")), 6).alias("kappa"))


def field_analysis(codings: DataFrame, first: str, second: str) -> DataFrame:
    """For each field: n, dropped (a coder could not assess), agreement, kappa, prevalence and bias index (of two
    categories only), disagreements with their share, and the confusion as ``left->right:count`` in order.
    """
    both = paired(codings, first, second)
    ok = both.filter((F.col("a") != MISSING) & (F.col("b") != MISSING))
    dropped = both.groupBy("field").agg(F.count_if((F.col("a") == MISSING) | (F.col("b") == MISSING)).alias("dropped"))
    cells = ok.groupBy("field", "a", "b").agg(F.count("*").alias("c"))
    seen = cells.groupBy("field").agg(F.array_sort(F.array_union(F.collect_set("a"), F.collect_set("b"))).alias("categories"))
    lo, hi = F.get("categories", F.lit(0)), F.get("categories", F.lit(1))
    count = lambda x, y: F.sum(F.when((F.col("a") == x) & (F.col("b") == y), F.col("c")).otherwise(0))
    joined = cells.join(seen, "field")
    n = F.sum("c")
    index = joined.groupBy("field", "categories").agg(F.abs(count(lo, lo) - count(hi, hi)).alias("p"), F.abs(count(lo, hi) - count(hi, lo)).alias("q"), n.alias("all"), F.sum(F.when(F.col("a") != F.col("b"), F.col("c")).otherwise(0)).alias("disagreements"), F.array_join(F.array_sort(F.collect_list(F.concat("a", F.lit("->"), "b", F.lit(":"), F.col("c").cast("string")))), ",").alias("confusion"))
    two = lambda c, name: F.round(F.when(F.size("categories") == 2, S.ratio(F.col(c), F.col("all"))), 6).alias(name)
    facts = index.select("field", two("p", "prevalence_index"), two("q", "bias_index"), "disagreements", F.round(S.ratio(F.col("disagreements"), F.col("all")), 6).alias("share_disagreements"), "confusion")
    stats = pair_statistics(ok.select("field", "a", "b"), ["field"])
    return dropped.join(stats, "field", "left").join(facts, "field", "left").select("field", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "dropped", "agreement", "kappa", "prevalence_index", "bias_index", "disagreements", "share_disagreements", "confusion")


def standard_summary(gold: DataFrame, field: str, model: str, positive: str, weight: str) -> DataFrame:
    """For each field and reference standard: n of gold codes, agreement and kappa with the model, precision of the
    model's positives with its bounds, and the field's spread: largest less smallest precision of the standards.

    A standard without positives has null precision and is left out of the spread; one without gold codes has no row.
    """
    by = [field, "variant"]
    same = pair_statistics(gold.select(*by, F.col(model).alias("a"), F.col("gold").alias("b")), by).withColumnRenamed("n", "n_gold")
    found = T.weighted_precision(gold.filter(F.col(model) == positive), by, F.col("gold") == positive, F.col(weight))
    spread = found.groupBy(field).agg(F.round(F.max("precision") - F.min("precision"), 6).alias("spread"))
    return same.join(found, by, "left").join(spread, field, "left").select(*by, "n_gold", "agreement", "kappa", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "precision", "n_eff", "low", "high", "spread")


def in_order(df: DataFrame, field: str, order: list[str]) -> DataFrame:
    """``df`` with ``position``: the place of its field in a codebook, unknown fields after all."""
    place = F.array_position(F.array(*(F.lit(f) for f in order)), F.col(field))
    return df.withColumn("position", F.when(place > 0, place.cast("int")).otherwise(len(order) + 1))


def model_value(flag: Column) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), "yes").otherwise("no")


def legend_value(flag: Column) -> Column:
    """classed, continuous, or other where the flag doesn't apply."""
    return F.when(flag.isNull(), "other").when(flag, "classed").otherwise("continuous")


def read_bool(text: Column) -> Column:
    """true and false in any case; anything else, blank too, is null."""
    low = F.lower(F.trim(text))
    return F.when(low == "true", True).when(low == "false", False)


def read_legend(text: Column) -> Column:
    """A legend's category as written, else from a boolean, else other."""
    return F.when(text.isin("classed", "continuous", "other"), text).otherwise(legend_value(read_bool(text)))


def coder_independence(codings: DataFrame, first: str, second: str, model: str) -> DataFrame:
    """Over cells that both coders assessed and the model has: how often each is with the model, and the exact two-sided
    McNemar p of the cells where only one is.
    """
    pick = lambda s: F.max(F.when(F.col("source") == s, F.col("value")))
    cells = codings.groupBy("uid", "field").agg(pick(first).alias("a"), pick(second).alias("b"), pick(model).alias("m")).filter(f"a is not null and b is not null and m is not null and a <> '{MISSING}' and b <> '{MISSING}'")
    yes = lambda c: F.col(c) == "yes"
    with_a, with_b = yes("a") == yes("m"), yes("b") == yes("m")
    counts = cells.agg(F.count("*").alias("n_cells"), F.count_if(with_a).alias("n_agree_first"), F.count_if(with_b).alias("n_agree_second"), F.count_if(with_a & ~with_b).alias("only_first"), F.count_if(~with_a & with_b).alias("only_second"))
    row = counts.first()
    p = T.mcnemar_p(row["only_first"], row["only_second"]) if row["only_first"] + row["only_second"] else None
    share = lambda c: F.round(S.ratio(F.col(c), F.col("n_cells")), 6)
    return counts.select("*", share("n_agree_first").alias("agreement_first"), share("n_agree_second").alias("agreement_second"), F.lit(None if p is None else round(p, 9)).cast("double").alias("mcnemar_p"))


def error_patterns(codings: DataFrame, first: str, second: str, model: str, fields: list[str], weak: list[str]) -> DataFrame:
    """For each weak field: the model's false positives (both coders say no), and of these units how many have other
    fields that both coders say yes to: ``field``, ``pattern`` (any:<field>, sole:<field> or none), ``n``.
    """
    gold = paired(codings.filter(F.col("field").isin(*fields)), first, second).filter("a = b").select("uid", "field", F.col("a").alias("gold"))
    claimed = codings.filter((F.col("source") == model) & (F.col("value") == "yes") & F.col("field").isin(*weak)).select("uid", "field").distinct()
    false = claimed.join(gold.filter("gold = 'no'").select("uid", "field"), ["uid", "field"])
    given = gold.filter("gold = 'yes'").groupBy("uid").agg(F.array_sort(F.collect_set("field")).alias("given"))
    each = false.join(given, "uid", "left").withColumn("given", F.coalesce("given", F.array().cast("array<string>")))
    any_ = F.transform("given", lambda f: F.concat(F.lit("any:"), f))
    sole = F.when(F.size("given") == 1, F.array(F.concat(F.lit("sole:"), F.get("given", F.lit(0))))).when(F.size("given") == 0, F.array(F.lit("none"))).otherwise(F.array().cast("array<string>"))
    patterns = each.select("field", F.explode(F.concat(F.array(F.lit("false positives")), any_, sole)).alias("pattern"))
    return patterns.groupBy("field", "pattern").agg(F.count("*").alias("n"))


RUNS = ("prod", "run1", "run2")


def complete_units(runs: DataFrame, fields: list[str], layers: DataFrame | None = None, needed: tuple[str, ...] = RUNS) -> DataFrame:
    """uid and ``layer`` of units that every needed run has all ``fields`` for; each counts in its own layer and in ``all``."""
    full = runs.filter(F.col("field").isin(*fields) & F.col("source").isin(*needed) & F.col("value").isNotNull()).groupBy("uid").agg(F.countDistinct("source", "field").alias("k")).filter(F.col("k") == len(fields) * len(needed)).select("uid")
    if layers is None:
        return full.select("uid", F.lit("all").alias("layer"))
    return full.join(layers.select("uid", "layer"), "uid").select("uid", F.explode(F.array(F.col("layer"), F.lit("all"))).alias("layer"))


def wide_runs(runs: DataFrame, needed: tuple[str, ...] = RUNS) -> DataFrame:
    """uid, field and one column for each run."""
    return runs.filter(F.col("source").isin(*needed)).groupBy("uid", "field").pivot("source", list(needed)).agg(F.max("value"))


def _interval(stable: Column, n: Column) -> list[Column]:
    share = S.ratio(stable, n)
    low, high = S.wilson(share, n)
    return [F.round(share, 6).alias("share"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high")]


def _same(needed: tuple[str, ...] = RUNS) -> Column:
    return F.size(F.array_distinct(F.array(*(F.col(r) for r in needed)))) == 1


def stability_by_field(wide: DataFrame, units: DataFrame, fields: list[str]) -> DataFrame:
    """layer, field, n, stable in all runs, share with its interval, Fleiss' kappa, agreement and kappa of each pair of runs."""
    rows = wide.filter(F.col("field").isin(*fields)).join(units, "uid")
    base = rows.groupBy("layer", "field").agg(F.count("*").alias("n"), F.count_if(_same()).alias("stable")).select("layer", "field", "n", "stable", *_interval(F.col("stable"), F.col("n")))
    cells = rows.select("layer", "field", "uid", F.explode(F.array(*(F.col(r) for r in RUNS))).alias("v")).groupBy("layer", "field", "uid", "v").agg(F.count("*").alias("k"))
    agree = cells.groupBy("layer", "field", "uid").agg(((F.sum(F.col("k") * F.col("k")) - 3) / 6).alias("p")).groupBy("layer", "field").agg(F.avg("p").alias("p"))
    chance = cells.groupBy("layer", "field", "v").agg(F.sum("k").alias("s")).groupBy("layer", "field").agg((F.sum(F.col("s") * F.col("s")) / (F.sum("s") * F.sum("s"))).alias("pe"))
    fleiss = agree.join(chance, ["layer", "field"]).select("layer", "field", F.round(F.when(F.abs(1 - F.col("pe")) > 1e-12, (F.col("p") - F.col("pe")) / (1 - F.col("pe"))), 6).alias("fleiss_kappa"))
    out = base.join(fleiss, ["layer", "field"])
    for x, y in (("prod", "run1"), ("prod", "run2"), ("run1", "run2")):
        pair = pair_statistics(rows.select("layer", "field", F.col(x).alias("a"), F.col(y).alias("b")), ["layer", "field"])
        out = out.join(pair.select("layer", "field", F.col("agreement").alias(f"agreement_{x}_{y}"), F.col("kappa").alias(f"kappa_{x}_{y}")), ["layer", "field"])
    return out


def set_stability(wide: DataFrame, units: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """layer, name, n, stable, share with its interval: units for which a whole set of fields is the same in all runs."""
    parts = []
    for name, fields in sets.items():
        per = wide.filter(F.col("field").isin(*fields)).groupBy("uid").agg(F.bool_and(_same()).alias("same"), F.count("*").alias("k")).filter(F.col("k") == len(fields))
        g = per.join(units, "uid").groupBy("layer").agg(F.count("*").alias("n"), F.count_if("same").alias("stable"))
        parts.append(g.select("layer", F.lit(name).alias("name"), "n", "stable", *_interval(F.col("stable"), F.col("n"))))
    return reduce(DataFrame.unionByName, parts)


def repeatability(wide: DataFrame, units: DataFrame, fields: list[str], positive: str = "yes") -> DataFrame:
    """layer, field, n positives of production, how many of them are the same in all runs, share with its interval."""
    rows = wide.filter(F.col("field").isin(*fields) & (F.col("prod") == positive)).join(units, "uid")
    g = rows.groupBy("layer", "field").agg(F.count("*").alias("n"), F.count_if(_same()).alias("stable"))
    return g.select("layer", "field", "n", "stable", *_interval(F.col("stable"), F.col("n")))


def gate_failures(runs: DataFrame, units: DataFrame, conditions: list[str], language: str, wanted: str = "en", needed: tuple[str, ...] = ("run1", "run2")) -> DataFrame:
    """layer, run, n, failed, and failures by condition and by language; run ``either``: failed in any of them.

    A condition fails unless it is yes, the language unless it is the wanted one in any case of letters.
    """
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    each = runs.filter(F.col("source").isin(*needed)).groupBy("uid", "source").agg(*(pick(f).alias(f) for f in conditions), F.lower(pick(language)).alias("_language"))
    bad = {f: ~F.coalesce(F.col(f) == "yes", F.lit(False)) for f in conditions} | {"language": ~F.coalesce(F.col("_language") == wanted, F.lit(False))}
    flagged = each.select("uid", "source", *(c.alias(f"_{f}") for f, c in bad.items())).withColumn("_any", reduce(lambda a, b: a | b, (F.col(f"_{f}") for f in bad)))
    either = flagged.groupBy("uid").agg(F.lit("either").alias("source"), *(F.bool_or(c).alias(c) for c in (*(f"_{f}" for f in bad), "_any")))
    g = flagged.unionByName(either).join(units, "uid").groupBy("layer", F.col("source").alias("run")).agg(F.count("*").alias("n"), F.count_if("_any").alias("failed"), *(F.count_if(f"_{f}").alias(f"failed_{f}") for f in bad))
    return g.select("layer", "run", "n", "failed", *(f"failed_{f}" for f in bad), *_interval(F.col("failed"), F.col("n")))


def textless(runs: DataFrame, units: DataFrame, text: str, language: str, wanted: str = "en", needed: tuple[str, ...] = ("run1", "run2")) -> DataFrame:
    """layer, run, n: units without text whose language is another than the wanted one; run ``any``: in at least one."""
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    each = runs.filter(F.col("source").isin(*needed)).groupBy("uid", "source").agg(pick(text).alias("t"), F.lower(pick(language)).alias("l"))
    hit = each.filter(~F.coalesce(F.col("t") == "yes", F.lit(False)) & ~F.coalesce(F.col("l") == wanted, F.lit(False))).select("uid", F.explode(F.array(F.col("source"), F.lit("any"))).alias("run")).distinct()
    return hit.join(units, "uid").groupBy("layer", "run").agg(F.count("*").alias("n"))


def stability_by_level(wide: DataFrame, units: DataFrame, levels: DataFrame, fields: list[str], least: int = 10) -> DataFrame:
    """layer, level, n, stable and, from ``least`` units on, the share with its interval."""
    per = wide.filter(F.col("field").isin(*fields)).groupBy("uid").agg(F.bool_and(_same()).alias("same"))
    g = per.join(units, "uid").join(levels.select("uid", "level"), "uid").groupBy("layer", "level").agg(F.count("*").alias("n"), F.count_if("same").alias("stable"))
    return g.select("layer", "level", "n", "stable", *(F.when(F.col("n") >= least, c).alias(name) for name, c in zip(("share", "low", "high"), _interval(F.col("stable"), F.col("n")))))


def instability_and_error(wide: DataFrame, codings: DataFrame, first: str, second: str, least: int = 10) -> DataFrame:
    """One row: units and fields by stable or not and right or wrong (both coders' common answer is right), the error
    shares, and from ``least`` unstable ones on the odds ratio (null if a wrong cell is empty) and Fisher's exact p.
    """
    gold = paired(codings, first, second).filter(f"a = b and a <> '{MISSING}'").select("uid", "field", F.col("a").alias("gold"))
    rows = wide.join(gold, ["uid", "field"]).select(_same().alias("s"), (F.col("prod") == F.col("gold")).alias("r"))
    counts = rows.agg(F.count_if(F.col("s") & F.col("r")).alias("stable_right"), F.count_if(F.col("s") & ~F.col("r")).alias("stable_wrong"), F.count_if(~F.col("s") & F.col("r")).alias("unstable_right"), F.count_if(~F.col("s") & ~F.col("r")).alias("unstable_wrong"))
    a, b, c, d = row = counts.first()
    counts = codings.sparkSession.createDataFrame([row], counts.schema)  # the tables are read once
    tested = c + d >= least
    odds = (d * a) / (c * b) if tested and c and b else None
    p = T.fisher_p(a, b, c, d) if tested else None
    lit = lambda x: F.lit(None if x is None else round(float(x), 9)).cast("double")
    return counts.select("*", F.round(S.ratio(F.col("stable_wrong"), F.col("stable_right") + F.col("stable_wrong")), 6).alias("error_stable"), F.round(S.ratio(F.col("unstable_wrong"), F.col("unstable_right") + F.col("unstable_wrong")), 6).alias("error_unstable"), lit(odds).alias("odds_ratio"), lit(p).alias("fisher_p"))


def tidy(sections: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """All results in one table: ``section`` and the columns, null where a section lacks one."""
    one = lambda name, df: df.select(F.lit(name).alias("section"), *(F.col(c) if c in df.columns else F.lit(None).cast("string" if c in ("layer", "field", "label") else "double").alias(c) for c in columns))
    return reduce(lambda a, b: a.unionByName(b), (one(name, df) for name, df in sections.items()))

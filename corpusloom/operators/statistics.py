"""Agreement, precision, metrics of classifiers."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import scalar as S
from corpusloom.operators.relational import running


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement, kappa (null if undefined) over pairs without nulls and without ``cannot_assess``."""
    ok = pairs.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).filter("a <> 'cannot_assess' and b <> 'cannot_assess'")
    cells = ok.groupBy("a", "b").count()
    total = cells.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("count")).otherwise(0)).alias("same"))
    left = cells.groupBy(F.col("a").alias("v")).agg(F.sum("count").alias("x"))
    right = cells.groupBy(F.col("b").alias("v")).agg(F.sum("count").alias("y"))
    chance = left.join(right, "v").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    both = total.crossJoin(chance)  # one row each
    po, pe = S.ratio(F.col("same"), F.col("n")), S.ratio(F.col("xy"), F.col("n") * F.col("n"))
    kappa = F.when(F.abs(1 - pe) > 1e-12, (po - pe) / (1 - pe))
    return both.select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(po, 6).alias("agreement"), F.round(kappa, 6).alias("kappa"))


def fleiss_kappa(ratings: DataFrame, subject: str, value: str, raters: int) -> DataFrame:
    """Over subjects with exactly ``raters`` ratings."""
    cells = ratings.groupBy(subject, value).count()
    per = cells.groupBy(subject).agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("sq")).filter(F.col("n") == raters)
    agree = per.agg(F.count("*").alias("subjects"), F.avg((F.col("sq") - raters) / (raters * (raters - 1))).alias("p"))
    shares = cells.join(per.select(subject), subject, "left_semi").groupBy(value).agg(F.sum("count").alias("c"))
    chance = shares.agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("sq")).select(S.ratio(F.col("sq"), F.col("all") * F.col("all")).alias("pe"))
    kappa = F.when(F.abs(1 - F.col("pe")) > 1e-12, (F.col("p") - F.col("pe")) / (1 - F.col("pe")))
    return agree.crossJoin(chance).select("subjects", F.round("p", 6).alias("agreement"), F.round(kappa, 6).alias("kappa"))


def prevalence_bias(pairs: DataFrame, a: str, b: str, positive) -> DataFrame:
    yes = lambda c: F.col(c) == positive
    n = F.count("*")
    both, none = F.count_if(yes(a) & yes(b)), F.count_if(~yes(a) & ~yes(b))
    left, right = F.count_if(yes(a) & ~yes(b)), F.count_if(~yes(a) & yes(b))
    return pairs.agg(n.alias("n"), F.round(S.ratio(F.abs(both - none), n), 6).alias("prevalence_index"), F.round(S.ratio(F.abs(left - right), n), 6).alias("bias_index"))


def weighted_precision(df: DataFrame, by: list[str], hit, weight) -> DataFrame:
    """Horvitz-Thompson precision, Kish's effective n and Wilson bounds of each group."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), S.ratio(F.sum(weight * hit.cast("double")), F.sum(weight)).alias("p"), S.kish(weight).alias("n_eff"))
    low, high = S.wilson(F.col("p"), F.col("n_eff"))
    return g.select(*by, "n", *(F.round(c, 6).alias(name) for c, name in ((F.col("p"), "precision"), (F.col("n_eff"), "n_eff"), (low, "low"), (high, "high"))))


def inclusion_probability(strata: DataFrame, key: str, drawn: str, population: str) -> DataFrame:
    """1 - product of (1 - k/N) over the strata that a unit is in."""
    return strata.groupBy(key).agg(F.round(1 - F.product(1 - F.col(drawn) / F.col(population)), 9).alias("inclusion_probability"))


def extrapolated(groups: DataFrame, by: list[str], n: str, hits: str, population: str) -> DataFrame:
    """Share with Wilson bounds, and all three times the population, rounded half to even; null where ``n`` is 0."""
    p = S.ratio(F.col(hits), F.col(n))
    low, high = S.wilson(p, F.col(n))
    whole = lambda c: F.bround(F.col(population) * c, 0).cast("long")
    return groups.select(*by, n, hits, population, F.round(p, 6).alias("share"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), whole(p).alias("estimate"), whole(low).alias("estimate_low"), whole(high).alias("estimate_high"))


def summed_bounds(estimates: DataFrame) -> DataFrame:
    """Sums of the estimates and of their bounds: not a joint interval.  Strata without an estimate add nothing."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c)
    return estimates.agg(F.count("estimate").alias("strata"), total("estimate"), total("estimate_low"), total("estimate_high"))


def confusion(df: DataFrame, label: str, predicted) -> DataFrame:
    """Counts and rates; a rate whose denominator is 0 is 0."""
    y = F.col(label) == 1
    c = df.agg(F.count_if(y & predicted).alias("tp"), F.count_if(~y & predicted).alias("fp"), F.count_if(~y & ~predicted).alias("tn"), F.count_if(y & ~predicted).alias("fn"))
    r = lambda a, b: F.coalesce(S.ratio(a, b), F.lit(0.0))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    rates = {"accuracy": r(tp + tn, tp + fp + tn + fn), "precision": r(tp, tp + fp), "recall": r(tp, tp + fn), "f1": r(2 * tp, 2 * tp + fp + fn), "specificity": r(tn, tn + fp)}
    return c.select("tp", "fp", "tn", "fn", *(F.round(v, 6).alias(k) for k, v in rates.items()))


def curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """tp and fp at and above each distinct score, with the positives and negatives at it."""
    at = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    return running(at, "score", {"tp": "pos", "fp": "neg"}, descending=True)


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact, ties counting half; 0 if there is one class only."""
    c = curve(df, label, score).agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return c.select(F.round(F.coalesce(S.ratio(F.col("u"), F.col("p") * F.col("n")), F.lit(0.0)), 6).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    c = curve(df, label, score).agg(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("s"), F.sum("pos").alias("p"))
    return c.select(F.round(F.coalesce(S.ratio(F.col("s"), F.col("p")), F.lit(0.0)), 6).alias("average_precision"))


def best_f1(df: DataFrame, label: str, score: str) -> DataFrame:
    """The lowest score at which F1 is largest; the point beyond all scores has F1 0, so it wins, as 0.5, only without rows."""
    total = F.lit(df.agg(F.count_if(F.col(label) == 1)).first()[0])
    f1 = F.round(F.coalesce(S.ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + total), F.lit(0.0)), 9)
    c = curve(df, label, score).select("score", f1.alias("f1"))
    best = c.agg(F.max(F.struct("f1", (-F.col("score")).alias("below"))).alias("best"))
    return best.select(F.round(F.coalesce(-F.col("best.below"), F.lit(0.5)), 6).alias("threshold"), F.round(F.coalesce("best.f1", F.lit(0.0)), 6).alias("f1"))


def _falling(ratio: Callable[[int], float]) -> list[float]:
    """1 and the weights after it, each the one before times ``ratio`` of its place, as far as floats hold them (2e-308)."""
    out, w = [], 1.0
    while w >= sys.float_info.min:
        out.append(w)
        w *= ratio(len(out) - 1)
    return out


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided binomial p of the discordant counts, to the precision of floats.

    Weights fall from the middle by their ratios, so about the square root of the counts is visited and no large number made.
    """
    n, k = b + c, min(b, c)
    top = n // 2
    weights = _falling(lambda j: (top - j) / (n - top + j + 1))  # of top, top - 1, ...
    total = 2 * math.fsum(weights) - (n % 2 == 0)
    return min(1.0, 2 * math.fsum(weights[top - k :]) / total)


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Exact two-sided p of a 2x2 table, to the precision of floats: all tables as improbable or more.

    Weights fall from the most probable table by their ratios; where rounding could decide, whole numbers are compared.
    """
    r, s, k = a + b, c + d, a + c
    top = (r + 1) * (k + 1) // (r + s + 2)
    up = _falling(lambda j: (r - top - j) * (k - top - j) / ((top + j + 1) * (s - k + top + j + 1)))
    down = _falling(lambda j: (top - j) * (s - k + top - j) / ((r - top + j + 1) * (k - top + j + 1)))
    weights = {top - j: w for j, w in enumerate(down)} | {top + j: w for j, w in enumerate(up)}
    own, error = weights.get(a, 0.0), 1e-15 * len(weights)

    def rare(x: int, w: float) -> bool:
        if abs(w - own) > error * own:
            return w < own
        low, high = min(x, a), max(x, a)
        m = high - low
        rise, fall = math.perm(r - low, m) * math.perm(k - low, m), math.perm(high, m) * math.perm(s - k + high, m)
        return rise <= fall if x == high else fall <= rise

    return math.fsum(w for x, w in weights.items() if rare(x, w)) / math.fsum(weights.values())


def bootstrap_kappa(pairs: DataFrame, a: str, b: str, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """Percentile bounds of kappa.  A resample of pairs is a multinomial draw of cell counts, so only cells are gathered."""
    import numpy as np

    cells = pairs.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).filter("a is not null and b is not null").groupBy("a", "b").count().orderBy("a", "b").collect()
    values = sorted({v for r in cells for v in (r["a"], r["b"])})
    counts = np.array([r["count"] for r in cells], float)
    n = counts.sum() if len(counts) else 0
    kappas = []
    if n:
        at = {v: i for i, v in enumerate(values)}
        ia, ib = np.array([at[r["a"]] for r in cells]), np.array([at[r["b"]] for r in cells])
        for draw in np.random.default_rng(seed).multinomial(int(n), counts / n, resamples):
            po = draw[ia == ib].sum() / n
            pe = (np.bincount(ia, draw, len(values)) * np.bincount(ib, draw, len(values))).sum() / n**2
            if abs(1 - pe) > 1e-12:
                kappas.append((po - pe) / (1 - pe))
    low, high = (float(x) for x in np.percentile(kappas, [2.5, 97.5])) if len(kappas) >= resamples / 10 else (None, None)
    return pairs.sparkSession.createDataFrame([(int(n), low, high)], "n long, low double, high double")


def stability(runs: DataFrame, subject: str, value: str, runs_needed: int) -> DataFrame:
    """Share of subjects whose value is the same in all runs, with Wilson bounds."""
    per = runs.groupBy(subject).agg(F.count("*").alias("n"), F.countDistinct(value).alias("k")).filter(F.col("n") == runs_needed)
    g = per.agg(F.count("*").alias("subjects"), F.count_if(F.col("k") == 1).alias("stable"))
    p = S.ratio(F.col("stable"), F.col("subjects"))
    low, high = S.wilson(p, F.col("subjects"))
    return g.select("subjects", "stable", F.round(p, 6).alias("share"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def trend(series: DataFrame, model: str, step: str, value: str) -> DataFrame:
    """First, last and change of each model's series, and each step's change from the one before."""
    w = Window.partitionBy(model).orderBy(step)
    return series.select(model, step, value, F.round(F.col(value) - F.lag(value).over(w), 6).alias("change"), F.round(100 * S.ratio(F.col(value) - F.first(value).over(w), F.first(value).over(w)), 6).alias("pct_of_first"))


def reference_standards(codings: DataFrame, key: list[str], left: str, right: str) -> DataFrame:
    """``key``, ``variant``, ``gold``: agreed codes under all of A, B and C; disputes settled by the left coder (A), the
    right one (B), or left open (C, no row).  Nulls and ``cannot_assess`` give no row.
    """
    ok = codings.filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != "cannot_assess") & (F.col(right) != "cannot_assess"))
    same = F.col(left) == F.col(right)
    each = F.array(F.struct(F.lit("A").alias("variant"), F.col(left).alias("gold")), F.struct(F.lit("B").alias("variant"), F.col(right).alias("gold")), F.struct(F.lit("C").alias("variant"), F.when(same, F.col(left)).alias("gold")))
    return ok.select(*key, F.inline(each)).filter("gold is not null")


def complete_sets(gold: DataFrame, subject: str, field: str, fields: int, model: str, weight: str) -> DataFrame:
    """Weighted share, by variant, of subjects whose fields are all resolved and all equal to the model's."""
    per = gold.groupBy("variant", subject).agg(F.countDistinct(field).alias("n_fields"), F.bool_and((F.col("gold") == "yes") == (F.col(model) == "yes")).alias("hit"), F.first(weight).alias("w"))
    return weighted_precision(per.filter(F.col("n_fields") == fields), ["variant"], F.col("hit"), F.col("w"))


def bootstrap_f1(df: DataFrame, label: str, predicted, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """metric, n, mean, deviation and percentile bounds of F1, precision and recall: resampled rows are multinomial draws
    of the four cells, so only these are gathered.  A rate whose denominator is 0 counts as 0; without rows all are null.
    """
    import numpy as np

    c = confusion(df, label, predicted).first()
    cells = np.array([c["tp"], c["fp"], c["tn"], c["fn"]], float)
    n = int(cells.sum())
    rows = [(m, n, None, None, None, None) for m in ("f1", "precision", "recall")]
    if n:
        tp, fp, _, fn = np.random.default_rng(seed).multinomial(n, cells / n, resamples).T
        each = {"f1": 2 * tp / np.maximum(2 * tp + fp + fn, 1), "precision": tp / np.maximum(tp + fp, 1), "recall": tp / np.maximum(tp + fn, 1)}
        rows = [(m, n, float(x.mean()), float(x.std()), *(float(v) for v in np.percentile(x, [2.5, 97.5]))) for m, x in each.items()]
    return df.sparkSession.createDataFrame(rows, "metric string, n long, mean double, sd double, low double, high double")

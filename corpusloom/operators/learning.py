"""Classifiers over array columns: training grid, scoring, oversampling, active selection."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import scalar as S


def vectors(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.transform(array_col, lambda x: x.cast("double"))))


def balanced(df: DataFrame, label: str) -> DataFrame:
    """``weight``: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).count().limit(10_000).collect()
    total, weight = sum(r["count"] for r in counts), F.lit(1.0)
    for r in counts:
        weight = F.when(F.col(label) == r[label], total / (len(counts) * r["count"])).otherwise(weight)
    return df.withColumn("weight", weight)


def estimators(seed: int = 42) -> dict:
    common = {"featuresCol": "scaled", "labelCol": "label", "weightCol": "weight"}
    return {
        "logistic": LogisticRegression(maxIter=100, **common),
        "logistic_l1": LogisticRegression(maxIter=100, elasticNetParam=1.0, regParam=0.01, **common),
        "forest": RandomForestClassifier(numTrees=200, maxDepth=20, minInstancesPerNode=2, seed=seed, **common),
        # Weights hold for all trees; a half of the rows for each tree stands in for weights of its own.
        "forest_subsample": RandomForestClassifier(numTrees=200, maxDepth=20, minInstancesPerNode=2, subsamplingRate=0.5, seed=seed, **common),
        "boosted": GBTClassifier(seed=seed, **common),
        "linear_svm": LinearSVC(**common),
    }


def train(df: DataFrame, array_col: str, name: str = "logistic", seed: int = 42, weighted: bool = True) -> PipelineModel:
    """Scaler and classifier on ``array_col`` and a 0/1 column ``label``, with balanced weights or none."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    rows = vectors(df, array_col)
    return Pipeline(stages=[scaler, estimators(seed)[name]]).fit(balanced(rows, "label") if weighted else rows.withColumn("weight", F.lit(1.0)))


def score(df: DataFrame, model: PipelineModel, array_col: str, platt: tuple[float, float] = (-1.0, 0.0)) -> DataFrame:
    """``df`` with ``pred_proba``; margins of a model without probabilities become some by Platt's sigmoid (see ``platt_fit``)."""
    out = model.transform(vectors(df, array_col))
    if "probability" in out.columns:
        p = vector_to_array("probability")[1]
    else:
        p = 1 / (1 + F.exp(F.lit(platt[0]) * vector_to_array("rawPrediction")[1] + F.lit(platt[1])))
    return out.withColumn("pred_proba", p).select(*df.columns, "pred_proba")


def svm_scores(df: DataFrame, key: str, array_col: str, support: np.ndarray, dual: np.ndarray, intercept: float, gamma: float, platt: tuple[float, float]) -> DataFrame:
    """Probabilities of a given RBF support vector machine, in Arrow batches: exact kernel sums and Platt's sigmoid."""
    given = df.sparkSession.sparkContext.broadcast((np.asarray(support, float), np.asarray(dual, float)))
    a, b = platt

    def run(batches):
        sv, alpha = given.value
        norms = (sv * sv).sum(1)
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"]).astype(float)
            d2 = np.maximum((x * x).sum(1)[:, None] + norms - 2 * x @ sv.T, 0)
            f = np.exp(-gamma * d2) @ alpha + intercept
            yield pd.DataFrame({key: pdf[key], "pred_proba": 1 / (1 + np.exp(a * f + b))})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(array_col).alias("x")).filter("x is not null").mapInPandas(run, f"`{key}` {kind}, pred_proba double")


def fourier_features(df: DataFrame, array_col: str, gamma: float, n: int = 256, seed: int = 0) -> DataFrame:
    """Random Fourier features of an RBF kernel in ``rff``: a linear model on them stands in for kernel training."""
    size = len(df.select(array_col).first()[0])
    rng = np.random.default_rng(seed)
    given = df.sparkSession.sparkContext.broadcast((rng.normal(0, math.sqrt(2 * gamma), (size, n)), rng.uniform(0, 2 * math.pi, n)))

    @F.pandas_udf("array<double>")
    def project(xs: pd.Series) -> pd.Series:
        w, b = given.value
        return pd.Series(list(math.sqrt(2 / n) * np.cos(np.stack(xs).astype(float) @ w + b)))

    return df.withColumn("rff", project(array_col))


def smote(df: DataFrame, key: str, array_col: str, label: str, ratio: float = 0.3, k: int = 3, seed: int = 42, block: int = 4096) -> DataFrame:
    """New minority rows between a row and one of its ``k`` nearest of its class, until minority : majority is ``ratio``.

    The minority is cut into blocks by a hash of the key, and every row meets every block: a task holds one block and the
    stream of rows, so the minority may have any size (the work is its square, as nearest neighbours of all rows need).
    A row's new ones number as many as the need asks of each, one more for the first in seeded order.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    few = df.filter(F.col(label) == 1).select(F.col(key).alias("k"), F.transform(array_col, lambda v: v.cast("double")).alias("x"))
    n, all_ = few.count(), df.filter(F.col(label) == 0).count()
    need = max(0, int(all_ * ratio) - n)
    if need == 0 or n < 2:
        return spark.createDataFrame([], f"base {kind}, {array_col} array<double>, {label} int")
    blocks = max(1, -(-n // block))
    pieces = few.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")).withColumn("side", F.lit(0))
    asked = few.select("k", "x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(1).alias("side"))

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        have, want = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(have) or not len(want):
            return pd.DataFrame({"k": [], "d": [], "near": []})
        xs, keys, rows = np.stack(have["x"]), have["k"].to_numpy(), []
        for at in range(0, len(want), 512):
            part = want.iloc[at : at + 512]
            q = np.stack(part["x"])
            d = np.maximum((q * q).sum(1)[:, None] + (xs * xs).sum(1) - 2 * q @ xs.T, 0)
            d[part["k"].to_numpy()[:, None] == keys[None, :]] = np.inf
            for i, order in enumerate(np.argsort(d, axis=1, kind="stable")[:, :k]):
                rows += [(part["k"].iloc[i], float(d[i, j]), xs[j].tolist()) for j in order if np.isfinite(d[i, j])]
        return pd.DataFrame(rows, columns=["k", "d", "near"])

    found = pieces.unionByName(asked).groupBy("b").applyInPandas(nearest, f"k {kind}, d double, near array<double>")
    best = found.groupBy("k").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "near"))), 1, k).alias("near")).join(few, "k")
    each, rest = divmod(need, n)
    lucky = few.select("k").orderBy(S.seeded(seed, F.col("k")), "k").limit(rest).withColumn("more", F.lit(1))
    times = best.join(lucky, "k", "left").withColumn("times", F.lit(each) + F.coalesce("more", F.lit(0)))
    draw = lambda what: F.pmod(F.xxhash64(F.lit(f"{seed}|{what}"), "k", "i"), F.lit(1 << 30)) / float(1 << 30)
    made = times.filter("times > 0").select("k", "x", "near", F.explode(F.sequence(F.lit(1), "times")).alias("i"))
    other = F.get("near", F.floor(draw("which") * F.size("near")).cast("int"))["near"]
    made = made.withColumn("other", other).withColumn("u", draw("where"))
    return made.select(F.col("k").alias("base"), F.zip_with("x", "other", lambda a, b: a + F.col("u") * (b - a)).alias(array_col), F.lit(1).alias(label))


def with_uncertainty(df: DataFrame, p: str = "pred_proba") -> DataFrame:
    return df.select("*", *(F.round(f(F.col(p)), 6).alias(n) for n, f in (("entropy", S.entropy), ("margin", S.margin), ("least_confident", S.least_confident))))


def top_uncertain(df: DataFrame, key: str, n: int, invalid_rate: float, by: str = "entropy") -> DataFrame:
    """The ``int(n / (1 - invalid_rate))`` most uncertain rows; ties by key."""
    return df.orderBy(F.desc(by), key).limit(int(n / (1 - invalid_rate)))


def top_by_side(df: DataFrame, key: str, n: int, positive_share: float, by: str = "entropy", p: str = "pred_proba") -> DataFrame:
    """Top rows of each predicted side; a shortage of positives is filled with further negatives.

    Each side is a top-k of its own, so tasks keep at most ``n`` rows.
    """
    sides = df.withColumn("predicted", (F.col(p) >= 0.5).cast("int"))
    got = min(int(n * positive_share), sides.filter("predicted = 1").count())
    top = lambda side, k: sides.filter(F.col("predicted") == side).orderBy(F.desc(by), key).limit(k)
    return top(1, got).unionByName(top(0, n - got))

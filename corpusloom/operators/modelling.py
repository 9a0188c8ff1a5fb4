"""Training as a workflow: a grid of classifiers, their metrics, selection, retraining, stored versions."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import scalar as S
from corpusloom.operators import learning as L
from corpusloom.operators import statistics as T
from corpusloom.sources import tables

#: Models of the grid: name, whether a run on oversampled rows is made as well.
GRID = (("logistic", True), ("logistic_l1", True), ("forest", True), ("forest_subsample", True), ("boosted", True), ("svm_rbf", False))


def population_scaled(df: DataFrame, array_col: str, out: str = "scaled_array") -> tuple[DataFrame, tuple[list[float], list[float]]]:
    """``array_col`` by mean and population deviation of each place (0 deviation: divided by 1), and the two lists."""
    size = len(df.select(array_col).first()[0])
    x = [F.get(array_col, F.lit(i)).cast("double") for i in range(size)]
    row = df.agg(*(F.avg(c) for c in x), *(F.stddev_pop(c) for c in x)).first()
    mean, sd = list(row[:size]), [s or 1.0 for s in row[size:]]
    return scaled_by(df, array_col, (mean, sd), out), (mean, sd)


def scaled_by(df: DataFrame, array_col: str, by: tuple[list[float], list[float]], out: str = "scaled_array") -> DataFrame:
    mean, sd = (F.array(*(F.lit(float(v)) for v in values)) for values in by)
    centred = F.zip_with(F.transform(array_col, lambda v: v.cast("double")), mean, lambda a, b: a - b)
    return df.withColumn(out, F.zip_with(centred, sd, lambda a, b: a / b))


def platt_fit(scored: DataFrame, margin: str, label: str, rounds: int = 20) -> tuple[float, float]:
    """(a, b) of Platt's sigmoid 1 / (1 + exp(a * margin + b)) by Newton steps; each step is one aggregation.

    Targets are smoothed by the class counts, as usual.
    """
    n1, n0 = scored.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) != 1)).first()
    a, b = 0.0, math.log((n0 + 1) / (n1 + 1))
    target = F.when(F.col(label) == 1, (n1 + 1) / (n1 + 2)).otherwise(1 / (n0 + 2))
    f = F.col(margin)
    for _ in range(rounds):
        p = 1 / (1 + F.exp(F.lit(a) * f + F.lit(b)))
        d, w = target - p, p * (1 - p)
        g1, g2, h11, h21, h22 = scored.agg(F.sum(f * d), F.sum(d), F.sum(f * f * w), F.sum(f * w), F.sum(w)).first()
        if g1 is None or (abs(g1) < 1e-5 and abs(g2) < 1e-5):
            break
        h11, h22 = h11 + 1e-12, h22 + 1e-12
        det = h11 * h22 - h21 * h21
        if det <= 0:
            break
        a, b = a - (h22 * g1 - h21 * g2) / det, b - (h11 * g2 - h21 * g1) / det
    return a, b


class Fitted:
    """A trained model with what scoring needs: the scaling, Platt's sigmoid for margins, the best threshold."""

    def __init__(self, name: str, model: PipelineModel, scaling, platt=(-1.0, 0.0), gamma: float | None = None, threshold: float = 0.5):
        self.name, self.model, self.scaling, self.platt, self.gamma, self.threshold = name, model, scaling, platt, gamma, threshold

    def score(self, df: DataFrame, array_col: str) -> DataFrame:
        """``df`` with ``pred_proba``."""
        ready = _features(scaled_by(df, array_col, self.scaling), self.gamma)
        return L.score(ready, self.model, "_input", self.platt).select(*df.columns, "pred_proba")


def _features(scaled: DataFrame, gamma: float | None) -> DataFrame:
    if gamma is None:
        return scaled.withColumn("_input", F.col("scaled_array"))
    return L.fourier_features(scaled, "scaled_array", gamma).withColumn("_input", F.col("rff"))


def fit(train: DataFrame, array_col: str, name: str, oversample: bool = False, seed: int = 42, key: str = "uid") -> Fitted:
    """One model on ``array_col`` and a 0/1 column ``label``.

    ``svm_rbf`` is a linear machine on random Fourier features of the kernel (gamma 1 / number of places), its margins made
    probabilities by Platt's sigmoid.  ``oversample``: with SMOTE rows up to 0.3 of the majority, and no class weights.
    """
    rows, scaling = population_scaled(train.select(key, array_col, "label"), array_col)
    gamma = 1.0 / len(scaling[0]) if name == "svm_rbf" else None
    ready = rows.select(key, F.col("scaled_array"), "label")
    if oversample:
        more = L.smote(ready, key, "scaled_array", "label", seed=seed)
        ready = ready.select("scaled_array", "label").unionByName(more.select("scaled_array", "label"))
    ready = _features(ready, gamma)
    kind = {"svm_rbf": "linear_svm"}.get(name, name)
    model = L.train(ready.select("_input", "label"), "_input", kind, seed, weighted=not oversample)
    fitted = Fitted(name, model, scaling, gamma=gamma)
    if name == "svm_rbf":
        margins = model.transform(L.vectors(ready, "_input")).select("label", F.element_at(L.vector_to_array("rawPrediction"), 2).alias("m"))
        fitted.platt = platt_fit(margins, "m", "label")
    return fitted


def metrics(scored: DataFrame, label: str = "label", p: str = "pred_proba", threshold: float = 0.5) -> dict:
    """Counts and rates at a threshold, areas under both curves, and the threshold of the best F1 with that F1."""
    out = T.confusion(scored, label, F.col(p) >= threshold).first().asDict()
    out |= T.roc_auc(scored, label, p).first().asDict() | T.average_precision(scored, label, p).first().asDict()
    best = T.best_f1(scored, label, p).first()
    return out | {"best_threshold": best["threshold"] if best else 0.5, "best_f1": best["f1"] if best else 0.0}


def train_grid(train: DataFrame, test: DataFrame, array_col: str, grid=GRID, seed: int = 42, key: str = "uid") -> tuple[dict[str, Fitted], DataFrame]:
    """All models of the grid, plain and on oversampled rows, each fitted anew, and one row of test metrics for each."""
    models, rows = {}, []
    for name, again in grid:
        for over in (False, True) if again else (False,):
            label = f"{name} + smote" if over else name
            fitted = fit(train, array_col, name, over, seed, key)
            scored = fitted.score(test.select(key, array_col, "label"), array_col)
            found = metrics(scored)
            fitted.threshold = found["best_threshold"]
            models[label] = fitted
            rows.append((label, over, *(float(found[m]) for m in METRICS)))
    spark = train.sparkSession
    return models, spark.createDataFrame(rows, "model string, oversampled boolean, " + ", ".join(f"{m} double" for m in METRICS))


METRICS = ("f1", "precision", "recall", "accuracy", "specificity", "roc_auc", "average_precision", "best_threshold", "best_f1", "tp", "fp", "tn", "fn")


def ranked(results: DataFrame) -> DataFrame:
    """Models by F1, the best first; ties by name.  A grid is a few rows."""
    from pyspark.sql import Window

    return results.withColumn("position", F.row_number().over(Window.orderBy(F.desc("f1"), "model")))


def select_best(models: dict[str, Fitted], results: DataFrame) -> Fitted:
    return models[ranked(results).filter("position = 1").first()["model"]]


def retrain(train: DataFrame, annotations: DataFrame, test: DataFrame, array_col: str, grid=GRID, seed: int = 42, key: str = "uid") -> tuple[dict[str, Fitted], DataFrame]:
    """The grid on ``train`` and newly annotated rows (column ``answer``: YES or NO, others are dropped).

    Rows that ``train`` or the fixed ``test`` set has already are not taken again.
    """
    known = train.select(key).unionByName(test.select(key)).distinct()
    fresh = annotations.withColumn("label", S.verdict_flag(F.col("answer"))).filter("label is not null").join(known, key, "left_anti").dropDuplicates([key])
    return train_grid(train.select(key, array_col, "label").unionByName(fresh.select(key, array_col, "label")), test, array_col, grid, seed, key)


def save_model(spark: SparkSession, root: str, fitted: Fitted, found: dict, version: str) -> str:
    """Write a version below ``root`` and, once it is there, let ``latest.json`` point to it."""
    path = f"{root}/{fitted.name}-{version}"
    fitted.model.write().overwrite().save(f"{path}/model")
    about = {"name": fitted.name, "scaling": [list(x) for x in fitted.scaling], "platt": list(fitted.platt), "gamma": fitted.gamma, "threshold": fitted.threshold, "metrics": found, "version": version}
    tables.write_text(spark, f"{path}/about.json", json.dumps(about))
    tables.write_text(spark, f"{root}/latest.json", json.dumps({"path": path}))
    return path


def load_model(spark: SparkSession, root: str, path: str | None = None) -> tuple[Fitted, dict]:
    """A version, or the latest one, with what was stored about it."""
    path = path or json.loads(tables.read_text(spark, f"{root}/latest.json"))["path"]
    about = json.loads(tables.read_text(spark, f"{path}/about.json"))
    model = PipelineModel.load(f"{path}/model")
    return Fitted(about["name"], model, tuple(about["scaling"]), tuple(about["platt"]), about["gamma"], about["threshold"]), about


def job_stats(scored: DataFrame, seconds: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """input_file, n, positives, rate, and rows a second where a file's seconds are known; one row ``(all)`` sums them."""
    spark = scored.sparkSession
    per = scored.groupBy("input_file").agg(F.count("*").alias("n"), F.count_if(F.col("pred_proba") >= threshold).alias("positives"))
    times = spark.createDataFrame(sorted(seconds.items()) or [("", 0.0)], "input_file string, seconds double")
    rows = per.join(times, "input_file", "left")
    total = rows.agg(F.lit("(all)").alias("input_file"), F.sum("n").alias("n"), F.sum("positives").alias("positives"), F.sum("seconds").alias("seconds"))
    return rows.unionByName(total).select("input_file", "n", "positives", F.round(S.ratio(F.col("positives"), F.col("n")), 6).alias("rate"), "seconds", F.round(S.ratio(F.col("n"), F.col("seconds")), 3).alias("rows_a_second"))


def perceptual_hash(df: DataFrame, gray: str, out: str = "phash", side: int = 32) -> DataFrame:
    """64-bit hash (16 hex digits) of gray values, row by row, of a ``side`` x ``side`` picture: signs of the 8 x 8 lowest
    cosine frequencies against their median.  Null where the array has another size.
    """

    k = np.arange(side)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * side)) * np.where(k == 0, np.sqrt(1 / side), np.sqrt(2 / side))[:, None]

    @F.pandas_udf("string")
    def hashed(rows: pd.Series) -> pd.Series:
        def one(values):
            if values is None or len(values) != side * side:
                return None
            low = (basis @ np.asarray(values, float).reshape(side, side) @ basis.T)[:8, :8]
            return np.packbits((low > np.median(low)).ravel()).tobytes().hex()

        return pd.Series([one(v) for v in rows])

    return df.withColumn(out, hashed(F.transform(gray, lambda v: v.cast("double"))))


"""Classifiers over signal vectors by MLlib, splits by series, and the search of their parameters."""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import signals as S
from tidemark.operators import detection as D
from tidemark.plans.search import Gene, search


def examples(series: DataFrame, windows: DataFrame, names: list[str], w: int = 30) -> DataFrame:
    """(series_id, seq, ts, value, signals, label) of rows at which all signals are there."""
    return D.label_points(S.with_signals(series, w, tuple(names)), windows).dropna(subset=names)


def window_examples(series: DataFrame, windows: DataFrame, w: int = 30) -> DataFrame:
    """(series_id, seq, ts, value, x, label) of rows with w values: x holds them with mean 0 and deviation 1."""
    rows = S.in_pieces(series, lambda r: r.withColumn("x", S.unit_window(w)), w).where("x IS NOT NULL")
    return D.label_points(rows, windows)


def nab_of_flags(scored: DataFrame, windows: DataFrame, threshold: float, profile: str = "standard") -> DataFrame:
    """(score): NAB score of the rows with a probability ``p`` of ``threshold`` or more, without probation."""
    return D.nab_normalized(D.nab_raw(scored, scored.where(F.col("p") >= threshold).select("series_id", "seq"), windows, profile))


def split_series(names: list[str], test: float = 0.3, seed: int = 0) -> tuple[list[str], list[str]]:
    """Training and test series; at least one of each."""
    order = sorted(set(names))
    if len(order) < 2:
        raise ValueError("two series at least are needed")
    random.Random(seed).shuffle(order)
    n = min(max(1, round(len(order) * test)), len(order) - 1)
    return order[n:], order[:n]


def fold_series(names: list[str], k: int, seed: int = 0) -> list[list[str]]:
    order = sorted(set(names))
    random.Random(seed).shuffle(order)
    return [order[i::k] for i in range(k)]


def fit_logistic(rows: DataFrame, names: list[str], c: float = 1.0) -> PipelineModel:
    """Balanced classes by weight; ``c`` is the inverse of the penalty on squared weights."""
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        raise ValueError("both labels are needed")
    total = sum(n.values())
    weighed = rows.withColumn("weight", F.when(F.col("label") == 1, total / (2 * n[1])).otherwise(total / (2 * n[0]))).withColumn("label", F.col("label").cast("double"))
    stages = [VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    return Pipeline(stages=[*stages, LogisticRegression(weightCol="weight", regParam=1 / (c * total), standardization=False, maxIter=200)]).fit(weighed)


def fit_encoder(rows: DataFrame, names: list[str], hidden: tuple[int, ...] = (16, 8), seed: int = 0) -> PipelineModel:
    stages = [VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    return Pipeline(stages=[*stages, MultilayerPerceptronClassifier(layers=[len(names), *hidden, 2], seed=seed, maxIter=60)]).fit(rows.withColumn("label", F.col("label").cast("double")))


def probabilities(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = model.transform(rows)
    return out.withColumn("p", vector_to_array("probability")[1]).select(*rows.columns, "p")


def point_report(scored: DataFrame, threshold: float) -> DataFrame:
    """(precision, recall, f1, alert_rate) by single rows, pooled over series."""
    n = lambda hit, y: F.sum(((F.col("p") >= threshold) == hit).cast("int") * (F.col("label") == y).cast("int"))
    c = scored.agg(n(True, 1).alias("tp"), n(True, 0).alias("fp"), n(False, 1).alias("fn"), F.count(F.lit(1)).alias("n"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = c.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn")), "alert_rate": share(F.col("tp") + F.col("fp"), F.col("n"))})
    return c.select("precision", "recall", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "alert_rate")


def tune_logistic(train: DataFrame, val: DataFrame, names: list[str], size: int = 12, generations: int = 8, seed: int = 0) -> tuple[dict[str, float], float, list[float]]:
    """Searches (log10 of c, threshold) for the best F1 by single rows; a model is fitted for each genome of a generation."""
    def score(pop):
        return [point_report(probabilities(fit_logistic(train, names, 10.0 ** g[0]), val), float(g[1])).first()["f1"] for g in pop]

    best, top, history = search([Gene("log_c", -3.0, 2.0), Gene("threshold", 0.1, 0.9)], score, size, generations, seed)
    return {"c": 10.0 ** best["log_c"], "threshold": best["threshold"]}, top, history

"""Fitted models: calibrators, regimes, drift between samples, event-study regressions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def isotonic(train: DataFrame, rows: DataFrame, y: str, p: str) -> DataFrame:
    """``rows`` with ``calibrated``: the monotone fit of y on p, constant beyond its ends, within [0, 1]."""
    model = IsotonicRegression(featuresCol=p, labelCol=y).fit(train.select(F.col(y).cast("double"), p))
    out = model.transform(rows).withColumnRenamed("prediction", "calibrated")
    return out.withColumn("calibrated", F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)))


def platt(train: DataFrame, rows: DataFrame, y: str, p: str, c: float = 1.0) -> DataFrame:
    """``rows`` with ``calibrated``: a logistic curve of the score with an L2 penalty of 1 / (n c)."""
    n = train.count()
    put = VectorAssembler(inputCols=[p], outputCol="_x")
    fit = LogisticRegression(featuresCol="_x", labelCol=y, regParam=1 / (max(n, 1) * c), standardization=False)
    model = fit.fit(put.transform(train.select(F.col(y).cast("double"), p)))
    out = model.transform(put.transform(rows))
    return out.withColumn("calibrated", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def mixture_regimes(rows: DataFrame, features: Sequence[str], k: int, by_time: str, seed: int = 7) -> DataFrame | None:
    """``rows`` with ``regime`` (R0, R1, ... by rising mean of the first feature); gaps take the last one.

    None if fewer than the larger of 10 k and 50 rows have all features.
    """
    known = rows.dropna(subset=list(features))
    if known.count() < max(10 * k, 50):
        return None
    put = VectorAssembler(inputCols=list(features), outputCol="_raw")
    scaler = StandardScaler(inputCol="_raw", outputCol="_z", withMean=True).fit(put.transform(known))
    z = scaler.transform(put.transform(known))
    model = GaussianMixture(k=k, featuresCol="_z", seed=seed, maxIter=100).fit(z)
    order = np.argsort([g.mean[0] for g in model.gaussians], kind="stable")
    names = F.array(*(F.lit(f"R{int(np.flatnonzero(order == j)[0])}") for j in range(k)))
    found = model.transform(z).select(by_time, F.element_at(names, F.col("prediction") + 1).alias("regime"))
    carried = F.last("regime", ignorenulls=True).over(Window.orderBy(by_time).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(found, by_time, "left").withColumn("regime", carried)


def adversarial_auc(a: DataFrame, b: DataFrame, features: Sequence[str], trees: int = 50, depth: int = 5, folds: int = 3, seed: int = 42) -> tuple[float, dict[str, float]]:
    """How well a forest tells two samples apart, out of fold, and which features it uses.

    Each fit and score reads the rows several times: they are made once and kept, in memory or on the executors' disks, until the end.
    """
    cols = list(features)
    both = a.select(*cols, F.lit(0.0).alias("_y")).unionByName(b.select(*cols, F.lit(1.0).alias("_y"))).persist(StorageLevel.MEMORY_AND_DISK)
    full = Imputer(strategy="median", inputCols=cols, outputCols=[f"_{c}" for c in cols]).fit(both).transform(both)
    data = VectorAssembler(inputCols=[f"_{c}" for c in cols], outputCol="_x").transform(full)
    data = data.withColumn("_fold", F.pmod(F.xxhash64(*cols), F.lit(folds)))
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed)
    area = BinaryClassificationEvaluator(labelCol="_y")
    scores = []
    for k in range(folds):
        model = forest.fit(data.where(F.col("_fold") != k))
        scores.append(area.evaluate(model.transform(data.where(F.col("_fold") == k))))
    weights = forest.fit(data).featureImportances.toArray()
    both.unpersist()
    return float(np.mean(scores)), dict(sorted(zip(cols, map(float, weights)), key=lambda x: -x[1]))


def drift_gate(a: DataFrame, b: DataFrame, features: Sequence[str], limit: float = 0.65) -> tuple[bool, float]:
    auc, _ = adversarial_auc(a, b, features)
    return auc < limit, auc


def boosted_probability(train: DataFrame, rows: DataFrame, features: Sequence[str], y: str, rounds: int = 20, seed: int = 7) -> DataFrame:
    """``rows`` with ``up``: the probability of y by boosted trees."""
    put = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep")
    model = GBTClassifier(featuresCol="_x", labelCol=y, maxIter=rounds, seed=seed).fit(put.transform(train.withColumn(y, F.col(y).cast("double"))))
    out = model.transform(put.transform(rows))
    return out.withColumn("up", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def best_pair(rows: DataFrame, first: Sequence[str], second: Sequence[str], y: str) -> DataFrame:
    """Leave-one-out error of least squares on each pair of features, best first.

    The table is an event study's (a row for each event); pairs are spread over the cluster.
    """
    spark = rows.sparkSession
    table = rows.select(*dict.fromkeys([*first, *second]), y).toPandas().astype(float)
    pairs = [(a, b) for a in first for b in second if a != b] if set(first) != set(second) else list(combinations(first, 2))
    target = table[y].to_numpy()

    def score(batches):
        for pdf in batches:
            out = []
            for a, b in pdf[["a", "b"]].itertuples(index=False):
                x = table[[a, b]].to_numpy()
                x = (x - np.nanmean(x, axis=0)) / np.maximum(np.nanstd(x, axis=0), 1e-12)
                x = np.c_[np.ones(len(x)), np.nan_to_num(x)]
                hat = x @ np.linalg.pinv(x.T @ x) @ x.T
                rest = (target - hat @ target) / np.maximum(1 - np.diag(hat), 1e-9)
                out.append((a, b, float((rest**2).mean()), float(np.mean((target - rest > 0) == (target > 0)))))
            yield pd.DataFrame(out, columns=["a", "b", "loo_mse", "loo_hit"])

    found = spark.createDataFrame(pairs, "a string, b string").mapInPandas(score, "a string, b string, loo_mse double, loo_hit double")
    return found.orderBy("loo_mse", "a", "b")

"""Market regimes out of sample: fitted on each fold's training days, labelled by an expression, named alike in all folds.

A fit is a mixture of Gaussians with full covariances over standardised features, its number of components
chosen by BIC.  Its parameters are a small table, a row for each component, so days are labelled where they are: the
component of the highest density, with the scaling of the training days.  Labels of later folds
are brought to the first fold's by the assignment of least total distance between means.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.regimes import matched

PARAMETERS = "fold int, k int, bic double, state int, weight double, mean array<double>, precision array<double>, logdet double, shift array<double>, scale array<double>"


def features(rows: DataFrame, by: Sequence[str], order: str, price: str, vol_window: int = 20, trend_window: int = 20) -> DataFrame:
    """Adds ``volatility`` and ``trend``: deviation and mean of the last changes, null until a window is full of them."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = rows.withColumn("_change", F.try_divide(F.col(price), F.lag(price).over(w)) - 1)

    def full(x: Column, n: int) -> Column:
        frame = w.rowsBetween(1 - n, 0)
        return F.when(F.count("_change").over(frame) == n, x.over(frame))

    return rows.withColumns({"volatility": full(F.stddev_samp("_change"), vol_window), "trend": full(F.avg("_change"), trend_window)}).drop("_change")


def mixture(z: np.ndarray, k: int, rounds: int = 150, tol: float = 1e-3) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood, weights, means and covariances by EM from k equal slices along the first feature."""
    n, d = z.shape
    part = np.empty(n, int)
    part[np.argsort(z[:, 0], kind="stable")] = np.arange(n) * k // n
    resp = np.eye(k)[part]
    before = -np.inf
    for _ in range(rounds):
        mass = resp.sum(axis=0) + 1e-10
        weight, mean = mass / n, resp.T @ z / mass[:, None]
        gap = z - mean[:, None]
        cov = (resp.T[:, None] * gap.transpose(0, 2, 1)) @ gap / mass[:, None, None] + 1e-6 * np.eye(d)
        log = log_densities(z, weight, mean, cov)
        top = log.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
        resp = np.exp(log - total[:, None])
        like = float(total.sum())
        if abs(like - before) < tol:
            break
        before = like
    return like, weight, mean, cov


def log_densities(z: np.ndarray, weight: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Logarithm of weight times density of each row and component."""
    gap = z - mean[:, None]
    quad = ((gap @ np.linalg.inv(cov)) * gap).sum(axis=2).T
    return np.log(weight) - 0.5 * (quad + np.linalg.slogdet(cov)[1] + z.shape[1] * np.log(2 * np.pi))


def best_mixture(x: np.ndarray, least: int, most: int) -> dict | None:
    """Parameters of the mixture with the lowest BIC; None if rows are fewer than ten times its components, or don't vary."""
    x = x[np.isfinite(x).all(axis=1)]
    shift, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (None, None)
    if len(x) < 10 * least or (scale < 1e-12).any():
        return None
    z, (n, d) = (x - shift) / scale, x.shape
    best = None
    for k in range(least, most + 1):
        if n < 10 * k:
            break
        like, weight, mean, cov = mixture(z, k)
        bic = -2 * like + np.log(n) * (k - 1 + k * d + k * d * (d + 1) // 2)
        if best is None or bic < best["bic"]:
            best = {"k": k, "bic": float(bic), "weight": weight, "mean": mean, "cov": cov, "shift": shift, "scale": scale}
    return best


def fit(rows: DataFrame, folds: Mapping[int, int], by: Sequence[str], names: Sequence[str], order: str = "pos", components: tuple[int, int] = (3, 6)) -> DataFrame:
    """Parameters (``by`` and ``PARAMETERS``) fitted on each group's rows up to each fold's last training position.

    ``folds``: number -> that position.  A group's rows of one fold are one series, fitted in a worker.
    """
    spark: SparkSession = rows.sparkSession
    ends = F.broadcast(spark.createDataFrame(list(folds.items()), "fold int, _end long"))  # folds are few
    known = rows.dropna(subset=list(names)).select(*by, order, *names)
    spread = known.withColumn("fold", F.explode(F.array(*map(F.lit, folds)))).join(ends, "fold").where(F.col(order) <= F.col("_end"))
    keys = [*by, "fold"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = best_mixture(pdf.sort_values(order)[list(names)].to_numpy(float), *components)
        out = []
        for s in range(m["k"] if m else 0):
            inverse = np.linalg.inv(m["cov"][s])
            out.append((*key, m["k"], m["bic"], s, float(m["weight"][s]), m["mean"][s].tolist(), inverse.ravel().tolist(), float(np.linalg.slogdet(m["cov"][s])[1]), m["shift"].tolist(), m["scale"].tolist()))
        return pd.DataFrame(out, columns=[*keys, "k", "bic", "state", "weight", "mean", "precision", "logdet", "shift", "scale"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))  # fits are long and rows few, so partitions aren't joined
    return spread.repartition(width, *keys).groupBy(*keys).applyInPandas(run, f"{kinds}, {PARAMETERS}")


def aligned(parameters: DataFrame, by: Sequence[str]) -> DataFrame:
    """Parameters with ``label``: each group's states brought to those of its first fold; null where that has none to match."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        means = {f: np.stack(g.sort_values("state")["mean"].to_list()) for f, g in pdf.groupby("fold")}
        anchor = means[min(means)]
        maps = {f: matched(anchor, m) for f, m in means.items()}
        return pdf.assign(label=[maps[f].get(s) for f, s in zip(pdf["fold"], pdf["state"])]).astype({"label": "Int32"})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parameters.schema)
    return parameters.groupBy(*by).applyInPandas(run, f"{kinds}, label int")


def assign(rows: DataFrame, parameters: DataFrame, by: Sequence[str], names: Sequence[str], order: str = "pos") -> DataFrame:
    """``rows`` with ``fold`` and ``regime`` under each fold's parameters; a day without features or label takes the last one.

    ``parameters`` come from ``aligned``; they are a row for each group, fold and component, so they are broadcast
    once gathered to one row for each group and fold.
    """
    part = F.struct("state", "label", "weight", "mean", "precision", "logdet", "shift", "scale")
    models = parameters.groupBy(*by, "fold").agg(F.collect_list(part).alias("_models"))
    d = len(names)
    x = F.array(*(F.col(c) for c in names))
    cells = F.array(*map(F.lit, range(d * d)))

    def density(m: Column) -> Column:
        gap = F.transform(x, lambda v, i: (v - F.get(m["shift"], i)) / F.get(m["scale"], i) - F.get(m["mean"], i))
        terms = F.transform(cells, lambda c: F.get(m["precision"], c) * F.get(gap, F.floor(c / d).cast("int")) * F.get(gap, (c % d).cast("int")))
        return F.log(m["weight"]) - 0.5 * (F.aggregate(terms, F.lit(0.0), lambda a, v: a + v) + m["logdet"])

    best = F.array_max(F.transform("_models", lambda m: F.struct(density(m).alias("p"), (-m["state"]).alias("s"), m["label"].alias("label"))))
    known = ~F.exists(x, lambda v: v.isNull())
    out = rows.join(F.broadcast(models), list(by)).withColumn("_own", F.when(known, best["label"]))
    carried = F.last("_own", ignorenulls=True).over(Window.partitionBy(*by, "fold").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("regime", carried).drop("_models", "_own")


def window_regimes(labels: DataFrame, spans: DataFrame, by: Sequence[str], order: str = "pos") -> DataFrame:
    """Of each group and fold: the commonest regime of its training and of its test days (ties to the smaller), and ``similarity``: 1 if they are one, else 0.5.

    ``spans``: fold, train_end, test_start, test_end; few rows.
    """
    rows = labels.join(F.broadcast(spans), "fold").where("regime is not null")
    side = F.when(F.col(order) <= F.col("train_end"), "train").when(F.col(order).between(F.col("test_start"), F.col("test_end")), "test")
    counts = rows.withColumn("_side", side).where("_side is not null").groupBy(*by, "fold", "_side", "regime").agg(F.count("*").alias("n"))
    top = counts.groupBy(*by, "fold").pivot("_side", ["train", "test"]).agg(F.max(F.struct("n", (-F.col("regime")).alias("r"))))
    out = top.select(*by, "fold", (-F.col("train.r")).alias("regime_train"), (-F.col("test.r")).alias("regime_test"))
    return out.withColumn("similarity", F.when(F.col("regime_train") == F.col("regime_test"), 1.0).otherwise(0.5))

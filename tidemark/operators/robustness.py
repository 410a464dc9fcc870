"""Stability of results: jackknife, ranks across folds, time-series folds, sensitivity, skill change."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ledger import block_indices


def jackknife_mean(rows: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Mean and deviation of the leave-one-out means, from sums alone."""
    w = Window.partitionBy(*by)
    n, total = F.count(x).over(w), F.sum(x).over(w)
    out = rows.where(F.col(x).isNotNull()).select(*by, ((total - F.col(x)) / F.when(n > 1, n - 1)).alias("_l"))
    return out.groupBy(*by).agg(F.avg("_l").alias("jack_mean"), F.stddev_samp("_l").alias("jack_std"), F.count("_l").alias("n"))


def rank_stability(ranks: DataFrame, key: str, fold: str, x: str) -> DataFrame:
    """Spearman correlation and share of order changes between each two folds.

    Order changes are counted among neighbours of the first fold's order, so the work is linear.
    """
    w = Window.partitionBy(fold).orderBy(F.desc(x), key)
    r = ranks.withColumn("_r", F.row_number().over(w).cast("double"))
    a = r.select(key, F.col(fold).alias("fold_a"), F.col("_r").alias("ra"))
    b = r.select(key, F.col(fold).alias("fold_b"), F.col("_r").alias("rb"))
    pairs = a.join(b, key).where("fold_a < fold_b")
    order = Window.partitionBy("fold_a", "fold_b").orderBy("ra")
    flips = pairs.withColumn("_flip", F.when(F.lead("rb").over(order).isNotNull(), (F.lead("rb").over(order) < F.col("rb")).cast("double")))
    return flips.groupBy("fold_a", "fold_b").agg(F.corr("ra", "rb").alias("spearman"), F.avg("_flip").alias("flip_rate"), F.count("*").alias("n"))


def sequential_folds(rows: DataFrame, by: Sequence[str], order: str, n: int, embargo: int = 0) -> DataFrame:
    """``rows`` with ``fold`` 1 to n in time order; the first ``embargo`` rows of each fold but the first go."""
    o = Window.partitionBy(*by).orderBy(order)
    out = rows.withColumn("fold", F.ntile(n).over(o))
    place = F.row_number().over(Window.partitionBy(*by, "fold").orderBy(order))
    return out.withColumn("_k", place).where((F.col("fold") == 1) | (F.col("_k") > embargo)).drop("_k")


def fold_variation(rows: DataFrame, by: Sequence[str], order: str, metric: Column, n: int = 5, embargo: int = 0) -> DataFrame:
    """Mean, deviation and coefficient of variation of a metric over sequential folds."""
    each = sequential_folds(rows, by, order, n, embargo).groupBy(*by, "fold").agg(metric.alias("_m"))
    mean, sd = F.avg("_m"), F.stddev_samp("_m")
    return each.groupBy(*by).agg(mean.alias("fold_mean"), sd.alias("fold_std"), F.when(F.abs(mean) > 1e-12, sd / F.abs(mean)).alias("fold_cv"))


def sensitivity(f: Callable[..., float], base: dict[str, float], share: float = 0.1) -> dict[str, tuple[float, float]]:
    """Change of ``f`` when each parameter falls and rises by a share of itself."""
    at = f(**base)
    return {k: tuple(f(**(base | {k: v * (1 + d)})) - at for d in (-share, share)) for k, v in base.items()}  # type: ignore[misc]


def block_test(x: np.ndarray, statistic: Callable[[np.ndarray], float], block: int = 5, draws: int = 500, seed: int = 123) -> dict[str, float]:
    """Bootstrap mean, deviation and 95 % interval of a statistic, and the share of draws on the other side of 0."""
    rng = np.random.default_rng(seed)
    got = np.array([statistic(x[block_indices(len(x), block, rng, False)]) for _ in range(draws)])
    low, high = np.quantile(got, [0.025, 0.975])
    return {"mean": float(got.mean()), "std": float(got.std(ddof=1)), "low": float(low), "high": float(high), "p": float((np.sign(got) != np.sign(statistic(x))).mean())}


def skill_delta(train: np.ndarray, test: np.ndarray, block: int = 5, draws: int = 500, seed: int = 0) -> dict[str, float]:
    """Test less train mean, with a block bootstrap interval and the share of draws without a loss."""
    rng = np.random.default_rng(seed)
    draw = lambda v: v[block_indices(len(v), block, rng, True)].mean()
    got = np.array([draw(test) - draw(train) for _ in range(draws)])
    low, high = np.quantile(got, [0.025, 0.975])
    return {"delta": float(test.mean() - train.mean()), "low": float(low), "high": float(high), "p": float((got >= 0).mean())}


def orthogonality(skills: DataFrame, by: Sequence[str], skill: str, least: float = 0.0) -> DataFrame:
    """0.6 of the share of holdouts that pass and 0.4 of 1 / (1 + variation)."""
    mean, sd = F.avg(skill), F.coalesce(F.stddev_samp(skill), F.lit(0.0))
    cv = F.when(F.abs(mean) > 1e-12, sd / F.abs(mean)).otherwise(0.0)
    return skills.groupBy(*by).agg((0.6 * F.avg((F.col(skill) >= least).cast("double")) + 0.4 / (1 + cv)).alias("orthogonality"))


def centre_and_spread(rows: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Median of each group, and the scaled median distance from it."""
    m = rows.where(F.col(x).isNotNull()).groupBy(*by).agg(F.median(x).alias("centre"))
    away = F.abs(F.col(x) - F.col("centre"))
    return rows.join(m, list(by)).groupBy(*by).agg(F.first("centre").alias("centre"), (1.4826 * F.median(away)).alias("mad"))


def expectancy(rows: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Mean result, its t statistic (null where nothing varies), wins and number of results."""
    sd = F.stddev_samp(x)
    return rows.groupBy(*by).agg(
        F.avg(x).alias("expectancy"), F.when(sd > 0, F.avg(x) / (sd / F.sqrt(F.count(x)))).alias("tstat"), F.sum((F.col(x) > 0).cast("double")).alias("wins"), F.count(x).alias("n")
    )

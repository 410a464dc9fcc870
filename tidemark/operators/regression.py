"""Least squares by sufficient statistics: moments are aggregated, the small system is solved for each group.

Moments combine, so rows are read once and never gathered.  Rows with a null in y or a
regressor don't count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from math import exp, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def student_cdf(t: float, df: float) -> float:
    """Distribution of Student's t by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = (b, a, 1 - x) if flip else (a, b, x)
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or 1e-300)
            c = (1 + step / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    beta = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) * h / a if 0 < x < 1 else float(x >= 1)
    tail = (1 - beta if flip else beta) / 2
    return 1 - tail if t > 0 else tail


@lru_cache(1 << 16)
def student_quantile(p: float, df: int) -> float:
    """Quantile of Student's t, by bisection."""
    low, high = -1.0, 1.0
    while student_cdf(low, df) > p:
        low *= 2
    while student_cdf(high, df) < p:
        high *= 2
    while high - low > 1e-12 * max(1.0, abs(low)):
        mid = (low + high) / 2
        low, high = (mid, high) if student_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def mean_prediction(rows: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], at: Sequence[float], alpha: float = 0.05) -> DataFrame:
    """Of each group: rows ``n``, the predicted mean ``y_hat`` at a point, its standard error ``se``, and Student's interval.

    Regressors that don't vary independently give no prediction; without a degree of freedom there is no error.
    """
    names = [*xs, y]
    known = rows.dropna(subset=names).select(*by, *(F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(names)))
    p = len(xs)
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    g = known.groupBy(*by).agg(
        F.count("*").alias("_n"), F.array(*(F.avg(f"_{k}") for k in range(p + 1))).alias("_mean"), F.array(*(F.covar_pop(f"_{i}", f"_{j}") for i, j in pairs)).alias("_cov")
    )
    point = np.array(at, float)

    def solved(n: int, mean: np.ndarray, cov: np.ndarray) -> tuple[float | None, ...]:
        s = np.zeros((p + 1, p + 1))
        for (i, j), v in zip(pairs, cov):
            s[i, j] = s[j, i] = v
        inner, outer = s[:p, :p], s[:p, p]
        scale = np.sqrt(np.diag(inner))
        if n < p + 1 or (scale < 1e-12).any() or np.linalg.cond(inner / np.outer(scale, scale)) > 1e10:
            return None, None, None, None
        slope = np.linalg.solve(inner, outer)
        gap = point - mean[:p]
        guess = float(mean[p] + slope @ gap)
        df = n - p - 1
        if df < 1:
            return guess, None, None, None
        noise = n * max(float(s[p, p] - slope @ outer), 0.0) / df
        se = sqrt(noise * (1 / n + float(gap @ np.linalg.solve(inner, gap)) / n))
        t = student_quantile(1 - alpha / 2, df)
        return guess, se, guess - t * se, guess + t * se

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(by)
            out = [solved(n, np.array(m), np.array(c)) for n, m, c in zip(*(batch.column(k + j).to_pylist() for j in range(3)))]
            cols = [pa.array([v[j] for v in out], pa.float64()) for j in range(4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(k + 1)), *cols], [*by, "n", "y_hat", "se", "lower", "upper"])

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)
    return g.mapInArrow(run, f"{kinds}n bigint, y_hat double, se double, lower double, upper double")

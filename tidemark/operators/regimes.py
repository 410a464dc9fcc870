"""Measures over regimes that have been assigned: breadth, overlap, the latest, weighted rates, the worst, likeness.

Labels are columns; ``matched`` brings the labels of two models together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def breadth(edges: DataFrame, by: Sequence[str], edge: str, median: Column, regimes: int) -> DataFrame:
    """Share of all regimes in which a group's edge reaches the cohort's median."""
    n = F.sum(F.coalesce(F.col(edge) >= median, F.lit(False)).cast("double"))
    return edges.groupBy(*by).agg((n / regimes if regimes > 0 else F.lit(0.0)).alias("breadth"))


def overlap(rows: DataFrame, by: Sequence[str], regime: str, favourable: Sequence) -> DataFrame:
    """Share of a group's rows that are in favourable regimes."""
    return rows.groupBy(*by).agg(F.avg(F.coalesce(F.col(regime).isin(list(favourable)), F.lit(False)).cast("double")).alias("overlap"))


def latest(rows: DataFrame, by: Sequence[str], regime: str, day: str, as_of: date | None = None) -> DataFrame:
    """The last known regime of each group at or before a day."""
    known = rows.where(F.col(regime).isNotNull())
    known = known if as_of is None else known.where(F.col(day) <= F.lit(as_of))
    return known.groupBy(*by).agg(F.max_by(regime, day).alias("regime_today"))


def weighted_rate(rates: DataFrame, occupancy: DataFrame, by: Sequence[str], regime: str, rate: str = "rate", weight: str = "occupancy") -> DataFrame:
    """Trigger rates of regimes weighted by the time spent in them; a regime without a rate counts 0."""
    joined = rates.join(occupancy, regime, "left")
    return joined.groupBy(*by).agg(F.coalesce(F.sum(F.col(rate) * F.col(weight)), F.lit(0.0)).alias("tau"))


def worst(rows: DataFrame, by: Sequence[str], regime: str, value: str) -> DataFrame:
    """The regime with the largest value, that value, and its lead over the next."""
    v = F.sort_array(F.collect_list(value), asc=False)
    least = F.struct(F.col(value).alias("v"), (-F.col(regime)).alias("k"))
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(
        (-F.max(least)["k"]).alias("worst_regime"), F.max(value).alias("worst_value"), (v[0] - F.coalesce(F.get(v, F.lit(1)), v[0])).alias("gap_to_next")
    )


def similarity(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Cosine of two vectors, between 0 and 1; 0 where one is zero."""
    dot = sum((x * y for x, y in zip(a, b)), F.lit(0.0))
    norm = F.sqrt(sum((x * x for x in a), F.lit(0.0))) * F.sqrt(sum((y * y for y in b), F.lit(0.0)))
    return F.coalesce(F.when(norm > 0, F.least(F.greatest(dot / norm, F.lit(0.0)), F.lit(1.0))), F.lit(0.0))


def matched(anchor: np.ndarray, other: np.ndarray) -> Mapping[int, int]:
    """Label of ``other`` -> label of ``anchor`` with the least total distance of the means.

    The shortest augmenting path for each anchor row in turn; labels are few.
    """
    cost = np.linalg.norm(anchor[:, None, :] - other[None, :, :], axis=2)
    n, m = cost.shape
    if n > m:
        return {v: k for k, v in matched(other, anchor).items()}
    u, v, of = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        least, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, at = row, -1
        while True:
            slack = cost[i] - u[i] - v
            better = ~done & (slack < least)
            least[better], back[better] = slack[better], at
            at = int(np.argmin(np.where(done, np.inf, least)))
            step = least[at]
            u[row] += step
            u[of[done]] += step
            v[done] -= step
            least[~done] -= step
            done[at] = True
            if of[at] < 0:
                break
            i = of[at]
        while at >= 0:
            of[at] = of[back[at]] if back[at] >= 0 else row
            at = back[at]
    return {int(j): int(of[j]) for j in range(m) if of[j] >= 0}

"""Predictive power of setups out of sample: the sign learnt in a fold's training years against the returns of its test year.

Folds may overlap in any way: the days between two bounds of any folds are a segment, outcomes are summed
once for each setup and segment, and a fold adds up the segments of its two windows.  So rows are read once, however
many folds hold them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.selection import top_k
from tidemark.operators.splits import plus_months


@dataclass(frozen=True)
class Split:
    """Windows of days, ends included."""

    train_start: date
    train_end: date
    test_start: date
    test_end: date


def year_splits(first: date, last: date, train_years: int = 3, test_years: int = 1, step_months: int = 6, embargo: int = 7, aligned: bool = True, days: int = 11) -> list[Split]:
    """Windows of years that move by months from a half-year's start; windows are cut at the calendar's ends.

    With ``aligned`` one more fold has its test end on the last day; ``days`` is the calendar's length, of which
    it takes more than ten.
    """
    one = timedelta(1)
    out, cursor = [], date(first.year, 1 if first.month <= 6 else 7, 1)
    while cursor < last:
        end = plus_months(cursor, 12 * train_years) - one
        start = end + timedelta(embargo + 1)
        if start > last:
            break
        split = Split(max(cursor, first), min(end, last), start, min(plus_months(start, 12 * test_years) - one, last))
        if split.train_start < split.train_end and split.test_start < split.test_end:
            out.append(split)
        cursor = plus_months(cursor, step_months)
    if aligned and days > 10:
        end = last - timedelta(embargo + 1)
        split = Split(plus_months(end, -12 * train_years) + one, end, plus_months(last, -12 * test_years) + one, last)
        if split.train_start < split.train_end and split.test_start < split.test_end and split not in out:
            out.append(split)
    return out


def segment_of(day: Column, bounds: Sequence[date]) -> Column:
    """How many bounds, first days of segments, are not after the day."""
    return sum((F.when(day >= F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0))


def predictive_power(
    rows: DataFrame, splits: Sequence[Split], by: Sequence[str], spark: SparkSession, y: str = "fwd", day: str = "date", least_in: int = 15, least_out: int = 10,
) -> DataFrame:
    """A row for each (by, fold) with enough outcomes in both windows and a mean that isn't 0: support, means, accuracy of the sign, t-statistic."""
    one = timedelta(1)
    bounds = sorted({d for s in splits for d in (s.train_start, s.train_end + one, s.test_start, s.test_end + one)})
    place = {b: k + 1 for k, b in enumerate(bounds)}
    spans = [
        (k, side, seg) for k, s in enumerate(splits, 1) for side, a, z in (("in", s.train_start, s.train_end), ("out", s.test_start, s.test_end)) for seg in range(place[a], place[z + one])
    ]
    v = F.col(y)
    sums = rows.where(v.isNotNull()).withColumn("_seg", segment_of(F.col(day), bounds)).groupBy(*by, "_seg").agg(
        F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"), F.count_if(v > 0).alias("up"), F.count_if(v < 0).alias("down")
    )
    of = F.broadcast(spark.createDataFrame(spans, "fold int, side string, _seg int"))  # segments of the folds
    side = lambda c, at: F.coalesce(F.sum(F.when(F.col("side") == at, F.col(c))), F.lit(0)).alias(f"{c}_{at}")
    g = sums.join(of, "_seg").groupBy(*by, "fold").agg(*(side(c, at) for c in ("n", "s", "ss", "up", "down") for at in ("in", "out")))
    g = g.where((F.col("n_in") >= least_in) & (F.col("n_out") >= least_out)).withColumn("mu_is", F.col("s_in") / F.col("n_in")).where(F.abs("mu_is") > 1e-12)
    n, s, ss = F.col("n_out"), F.col("s_out"), F.col("ss_out")
    var = (ss - s * s / n) / (n - 1)
    return g.select(
        *by, "fold", F.col("n_in").alias("support_is"), F.col("n_out").alias("support_oos"), "mu_is", (F.col("up_in") / F.col("n_in")).alias("p_long_is"),
        (s / n).alias("mu_oos"), (F.when(F.col("mu_is") > 0, F.col("up_out")).otherwise(F.col("down_out")) / n).alias("acc_oos"),
        F.when((n > 1) & (var > 1e-18), F.sqrt(n) * (s / n) / F.sqrt(var)).otherwise(0.0).alias("tstat_oos"),
    )


def directed(power: DataFrame) -> DataFrame:
    """Adds the ``direction`` learnt and ``expected_edge_pct``, the mean test return as a simple one (logarithms within 20)."""
    edge = F.exp(F.least(F.greatest("mu_oos", F.lit(-20.0)), F.lit(20.0))) - 1
    return power.withColumns({"direction": F.when(F.col("mu_is") > 0, "long").otherwise("short"), "expected_edge_pct": edge})


def best_signals(power: DataFrame, by: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Of each (by) the row of the highest accuracy, then t-statistic, then support; ties go by ``key``."""
    order = [F.round("acc_oos", 9).desc(), F.round("tstat_oos", 9).desc(), F.desc("support_oos"), *map(F.col, key)]
    return top_k(power, by, order, 1)

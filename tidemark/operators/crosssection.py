"""Cross-sectional operators: ranks and scores of a day's tickers, overall and within sectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def pct_rank(x: str, by: Sequence[str]) -> Column:
    """Rank as a share of the values present, ties averaged; null stays null."""
    w = Window.partitionBy(*by)
    ordered = Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())
    peers = F.count(x).over(Window.partitionBy(*by, x))
    return F.when(F.col(x).isNotNull(), (F.rank().over(ordered) + (peers - 1) / 2) / F.count(x).over(w))


def neutral_z(x: str, by: Sequence[str]) -> Column:
    w = Window.partitionBy(*by)
    return (F.col(x) - F.avg(x).over(w)) / (F.stddev_samp(x).over(w) + 1e-9)


def demeaned(x: str, by: Sequence[str]) -> Column:
    return F.col(x) - F.avg(x).over(Window.partitionBy(*by))

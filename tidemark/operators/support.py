"""Support of setups: where they fire often enough, on which rows they could fire, and how their fires cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def supported(fires: DataFrame, by: Sequence[str], least: int = 12, fired: str = "fired") -> DataFrame:
    """The rows that fire, of those groups that fire ``least`` times or more."""
    hit = fires.where(F.coalesce(fired, F.lit(False)))
    enough = hit.groupBy(*by).count().where(F.col("count") >= least)
    return hit.join(enough.select(*by), list(by), "left_semi")


def supported_returns(rows: DataFrame, by: Sequence[str], r: str, least: int = 12, fired: str = "fired") -> DataFrame:
    """All rows; ``r`` is null where the group doesn't fire, or doesn't fire often enough."""
    n = F.sum(F.coalesce(F.col(fired), F.lit(False)).cast("long")).over(Window.partitionBy(*by))
    kept = F.coalesce(F.col(fired), F.lit(False)) & (n >= least)
    return rows.withColumn(r, F.when(kept, F.col(r)))


def eligible(features: Sequence[str]) -> Column:
    """Whether all source features of a setup have a value; no feature, no row."""
    out = F.lit(bool(features))
    for c in features:
        out = out & F.col(c).isNotNull()
    return out


def support_stats(fires: DataFrame, by: Sequence[str], order: str, least: int = 12, fired: str = "fired") -> DataFrame:
    """Fires, those that count, their ratio, the longest streak, the mean place within a streak, and whether support is met."""
    on = F.coalesce(F.col(fired), F.lit(False))
    w = Window.partitionBy(*by).orderBy(order)
    rows = fires.withColumn("_run", F.sum((~on).cast("long")).over(w))
    place = F.sum(on.cast("long")).over(Window.partitionBy(*by, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    g = rows.withColumn("_place", place).groupBy(*by).agg(
        F.sum(on.cast("long")).alias("total_fires"), F.max("_place").alias("max_streak"), F.coalesce(F.avg(F.when(on, F.col("_place"))), F.lit(0.0)).alias("avg_streak")
    )
    met = F.col("total_fires") >= least
    return g.withColumns(
        {
            "valid_fires": F.when(met, F.col("total_fires")).otherwise(0),
            "support_ratio": F.when(met & (F.col("total_fires") > 0), 1.0).otherwise(0.0),
            "meets_min_support": met,
        }
    )

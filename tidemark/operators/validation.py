"""Forecasts out of fold, for all setups, horizons and folds at once.

A forecast is the histogram of a setup's outcomes that were complete when its fold's
training ended; it is scored on the outcomes that lie wholly inside the fold's test
window.  Folds are anchored at the first day, so a fold's training rows are those of the
one before and some more: outcomes are counted once by the segment between two folds'
ends in which they become complete, and running sums give every fold's histogram.  No
row is read again for a further fold.  Test rows meet their folds by equality on
the position of their day.

An outcome starts at calendar position ``pos`` and is complete ``horizon`` positions later; rows without
one (null ``fwd``) don't count.  Values beyond the edges count as support, not in a histogram.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import scoring


@dataclass(frozen=True)
class FoldSpan:
    """Calendar positions: training from the first to ``train_end``, test from ``test_start`` to ``test_end``."""

    number: int
    train_end: int
    test_start: int
    test_end: int

    def __post_init__(self) -> None:
        if not 0 <= self.train_end < self.test_start <= self.test_end:
            raise ValueError("positions of a fold are out of order")


def outcomes(prices: DataFrame, calendar: DataFrame, horizons: Sequence[int], by: str = "ticker", day: str = "date", price: str = "px_last") -> DataFrame:
    """(by, day, pos, horizon, fwd): return from each calendar day to the one ``horizon`` positions later; null where a price is.

    ``calendar``: distinct days; positions count from 0.  Days on which a ticker has no bar have no price.
    """
    at = calendar.select(F.col(day), (F.row_number().over(Window.orderBy(day)) - 1).alias("pos"))
    placed = prices.select(by, day, price).join(F.broadcast(at), day)  # a row for each calendar day
    ahead = placed.select(by, F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), (F.col("pos") - h).alias("pos")) for h in horizons))).alias("x"), F.col(price).alias("_to"))
    ahead = ahead.select(by, "x.horizon", "x.pos", "_to")
    start = placed.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    both = start.join(ahead, [by, "horizon", "pos"], "left")
    return both.select(by, day, "pos", "horizon", F.when(F.col(price) != 0, F.col("_to") / F.col(price) - 1).alias("fwd"))


def _band_counts(x: str, edges: Sequence[float]) -> list[Column]:
    band = scoring.band_of(F.col(x), edges)
    return [F.count(F.when(band == k, 1)).alias(f"b{k}") for k in range(len(edges) - 1)]


def _probabilities(counts: Sequence[str]) -> Column:
    """Shares of the bands with a little mass everywhere; equal shares without a count."""
    total = sum((F.col(c) for c in counts), F.lit(0.0))
    return scoring.smoothed(F.array(*(F.col(c) / (total + 1e-9) for c in counts)))


def forecasts(rows: DataFrame, folds: Sequence[FoldSpan], by: Sequence[str], edges: Sequence[float]) -> DataFrame:
    """(by, horizon, fold, n_train, probs) of every fold from the first with a training outcome on.

    ``rows``: by, pos, horizon, fwd.
    """
    ends = sorted({f.train_end for f in folds})
    rank = {e: k for k, e in enumerate(ends)}
    segment = sum((F.when(F.col("pos") + F.col("horizon") > e, 1).otherwise(0) for e in ends), F.lit(0))
    bands = [f"b{k}" for k in range(len(edges) - 1)]
    keys = [*by, "horizon"]
    counted = rows.where("fwd is not null").withColumn("segment", segment).where(F.col("segment") < len(ends))
    counted = counted.groupBy(*keys, "segment").agg(F.count("*").alias("n"), *_band_counts("fwd", edges))
    w = Window.partitionBy(*keys).orderBy("segment")
    until = F.coalesce(F.lead("segment").over(w), F.lit(len(ends))) - 1
    running = counted.withColumns({"_until": until} | {c: F.sum(c).over(w) for c in ("n", *bands)})
    running = running.withColumn("segment", F.explode(F.sequence("segment", "_until")))
    numbers = F.array(*(F.array(*(F.lit(f.number) for f in folds if rank[f.train_end] == k)) for k in range(len(ends))))
    spread = running.withColumn("fold", F.explode(F.element_at(numbers, F.col("segment") + 1)))
    return spread.select(*keys, "fold", F.col("n").alias("n_train"), _probabilities(bands).alias("probs"))


def tested(rows: DataFrame, folds: Sequence[FoldSpan], spark: SparkSession) -> DataFrame:
    """Outcomes with each ``fold`` whose test window holds all of theirs."""
    spans = spark.createDataFrame([(f.number, f.test_start, f.test_end) for f in folds], "fold int, _a int, _z int")
    spans = spans.select("fold", "_z", F.explode(F.sequence("_a", "_z")).alias("pos"))  # days of the test windows
    return rows.where("fwd is not null").join(F.broadcast(spans), "pos").where("pos + horizon <= _z").drop("_z")


def scored(
    triggered: DataFrame, market: DataFrame, folds: Sequence[FoldSpan], by: Sequence[str], edges: Sequence[float], spark: SparkSession,
    least_train: int = 10, least_test: int = 3, market_by: str = "ticker",
) -> DataFrame:
    """A row for each (by, horizon, fold) with enough outcomes: scores of the forecast, its skill, its probabilities.

    ``triggered``: by (``market_by`` among them), pos, horizon, fwd on a setup's trigger days; ``market``: market_by, pos, horizon, fwd on all days.
    Skill is by how much the CRPS is below that of equal probabilities, and of the histogram of all outcomes of the test window.
    """
    n = len(edges) - 1
    bands = [f"b{k}" for k in range(n)]
    keys = [*by, "horizon", "fold"]
    fits = forecasts(triggered, folds, by, edges).where(F.col("n_train") >= least_train)
    marginal = tested(market, folds, spark).groupBy(market_by, "horizon", "fold").agg(*_band_counts("fwd", edges))
    marginal = marginal.select(market_by, "horizon", "fold", _probabilities(bands).alias("_marginal"))
    rows = tested(triggered, folds, spark).join(fits, keys).join(marginal, [market_by, "horizon", "fold"])
    rows = rows.withColumn("_uniform", F.array(*[F.lit(1.0 / n)] * n))
    q = {f"_q{int(v * 100)}": scoring.quantile_from_bands("probs", edges, v) for v in (0.1, 0.9)}
    rows = rows.withColumns({f"_crps{c}": scoring.crps(c or "probs", "fwd", edges) for c in ("", "_uniform", "_marginal")} | q)
    y = F.col("fwd")
    g = rows.groupBy(*keys).agg(
        F.first("n_train").alias("n_train"), F.count("*").alias("n_test"), F.first("probs").alias("probs"), F.avg("_crps").alias("crps"),
        F.avg(scoring.pinball(y, F.col("_q10"), 0.1)).alias("pinball_q10"), F.avg(scoring.pinball(y, F.col("_q90"), 0.9)).alias("pinball_q90"),
        (F.avg("_crps_uniform") - F.avg("_crps")).alias("skill_vs_uniform"), (F.avg("_crps_marginal") - F.avg("_crps")).alias("skill_vs_marginal"),
        *_band_counts("fwd", edges),
    ).where(F.col("n_test") >= least_test)
    inside = sum((F.col(c) for c in bands), F.lit(0))
    seen = F.array(*(F.when(inside > 0, F.col(c) / inside) for c in bands))
    raised = F.array(*((F.col(c) + 1) / (inside + n) for c in bands))
    gain = scoring.array_sum(F.zip_with(raised, F.col("probs"), lambda e, p: e * (F.log(e) - F.log(F.greatest(p, F.lit(1e-12)))))) / F.log(F.lit(2.0))
    return g.select(
        *keys, "n_train", "n_test", "crps", "pinball_q10", "pinball_q90", "skill_vs_uniform", "skill_vs_marginal",
        F.when(inside > 0, scoring.calibration_mae(F.col("probs"), seen)).alias("calibration_mae"), F.when(inside > 0, gain).alias("info_gain"),
        F.when(inside > 0, scoring.wasserstein(F.col("probs"), seen, edges)).alias("w1_effect"), "probs",
    )

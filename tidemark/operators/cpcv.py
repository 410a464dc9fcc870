"""Combinatorially purged cross-validation of trading setups.

The calendar is cut into N blocks of nearly equal numbers of days.  Each of the C(N, k)
subsets of k blocks is held out once; what is learnt elsewhere is applied to it.  Every
block is held out by C(N - 1, k - 1) subsets, so the held-out results make as many
*paths* through the whole calendar: path j takes from each block the j-th subset that
holds it out.

A row's label spans from its trigger to its exit.  For a held-out block a row elsewhere
is purged if its span meets the block's: from the block's first day to the last day that
the setup's own rows in the block reach, and an embargo of further days.  Which blocks a
row can't be learnt beside is a bit mask, computed from the row and its setup's few
bounds; learning rows are counted once by (block, mask), and these sums serve all
subsets, so no row meets a subset.

What is learnt of a setup is its direction, the sign of the mean profit of its learning
rows (0 without any: it stands aside).  Rows without trigger, exit or profit have no
label and are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.gauntlet import judged, sharpe_of, with_quantile
from tidemark.operators.ledger import summed


@dataclass(frozen=True)
class Plan:
    """``blocks`` of the calendar, ``held`` out together, and the ``embargo`` in calendar days."""

    blocks: int = 6
    held: int = 2
    embargo: int = 10

    def __post_init__(self) -> None:
        if not 0 < self.held < self.blocks <= 40:
            raise ValueError("of at most 40 blocks, some but not all must be held out")

    @property
    def subsets(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.blocks), self.held))

    @property
    def paths(self) -> list[tuple[int, int, int]]:
        """(path, block, subset): the path's block is the one that this subset holds out."""
        out = []
        for block in range(self.blocks):
            holding = [k for k, s in enumerate(self.subsets) if block in s]
            out += [(j, block, k) for j, k in enumerate(holding)]
        return sorted(out)


@dataclass(frozen=True)
class Gates:
    """Limits of the third stage."""

    # The gate's limits.
    median_dsr: float = 0.35
    iqr_sharpe: float = 0.70
    cvar5: float = -0.12
    support_rate: float = 0.60
    path_support: int = 30
    pbo: float = 0.30
    spearman: float = 0.35
    regime_coverage: float = 0.15
    regime_support: int = 20
    fragility: float = 0.35
    one_regime: float = 0.80
    top: float = 0.20


def block_bounds(days: DataFrame, plan: Plan, day: str = "date") -> list[tuple[date, date]]:
    """First and last day of each block of a calendar of distinct days."""
    n = F.ntile(plan.blocks).over(Window.orderBy(day)) - 1
    found = days.select(n.alias("block"), F.col(day).alias("d")).groupBy("block").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    return [(r.a, r.b) for r in found.orderBy("block").collect()]


def block_of(day: Column, bounds: Sequence[tuple[date, date]]) -> Column:
    """Number of the block that a day lies in or after; null before the first."""
    out = F.lit(None).cast("int")
    for k, (first, _) in enumerate(bounds):
        out = F.when(day >= F.lit(first), F.lit(k)).otherwise(out)
    return out


def labelled(rows: DataFrame, bounds: Sequence[tuple[date, date]], plan: Plan, setup: str = "setup_id") -> DataFrame:
    """Rows with a label, their ``block`` and the mask ``near`` of the blocks beside which they are purged."""
    known = rows.where("trigger_date is not null and exit_date is not null and pnl_pct is not null")
    known = known.withColumn("block", block_of(F.col("trigger_date"), bounds)).where("block is not null")
    known = known.repartition(setup)  # what follows needs no other shuffle, even where ``near`` and its window aren't read
    own = F.greatest("trigger_date", "exit_date")
    w = Window.partitionBy(setup)
    reach = [F.greatest(F.lit(b), F.max(F.when(F.col("block") == k, own)).over(w)) for k, (_, b) in enumerate(bounds)]
    known = known.withColumn("_reach", F.array(*(F.date_add(x, plan.embargo) for x in reach)))
    near = F.lit(0).cast("long")
    for k, (first, _) in enumerate(bounds):
        meets = (F.col("trigger_date") <= F.col("_reach")[k]) & (own >= F.lit(first))
        near = near + F.when(meets, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return known.withColumn("near", near).drop("_reach")


def learnt(rows: DataFrame, spark: SparkSession, plan: Plan, setup: str = "setup_id") -> DataFrame:
    """Of each setup and ``subset``: rows and Sharpe ratios (of trades) inside and held out, and the ``direction`` learnt.

    ``rows`` come from ``labelled``.  Held-out trades are taken in the direction.
    """
    x = F.col("pnl_pct")
    sums = rows.groupBy(setup, "block", "near").agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("ss"))
    masks = F.broadcast(spark.createDataFrame([(k, sum(1 << b for b in s)) for k, s in enumerate(plan.subsets)], "subset int, mask long"))
    spread = sums.withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(len(plan.subsets) - 1)))).join(masks, "subset")
    side = F.when(F.expr("mask & shiftleft(1L, block)") != 0, "out").when(F.expr("mask & near") == 0, "in")
    total = lambda c, at: F.coalesce(F.sum(F.when(side == at, F.col(c))), F.lit(0))
    g = spread.groupBy(setup, "subset").agg(*(total(c, at).alias(f"{c}_{at}") for c in ("n", "s", "ss") for at in ("in", "out")))
    mean_in = F.when(F.col("n_in") > 0, F.col("s_in") / F.col("n_in"))
    direction = F.when(mean_in >= -1e-9, 1).when(mean_in < 0, -1).otherwise(0)  # a mean of 0 may come out as the noise of its sum

    def ratio(at: str) -> Column:
        n, s, ss = (F.col(f"{c}_{at}") for c in ("n", "s", "ss"))
        var = (ss - s * s / n) / (n - 1)
        return F.when((n > 1) & (var > 1e-12), s / n / F.sqrt(var))

    g = g.withColumns({"direction": direction, "sharpe_in": ratio("in"), "sharpe_out": ratio("out")})
    return g.select(setup, "subset", F.col("n_in").alias("n_train"), F.col("n_out").alias("n_test"), "direction", "sharpe_in", (F.col("sharpe_out") * F.col("direction")).alias("sharpe_out"))


def path_returns(rows: DataFrame, fits: DataFrame, spark: SparkSession, plan: Plan, base: float = 100_000.0, setup: str = "setup_id") -> DataFrame:
    """Of each setup, ``path`` and trigger day: the day's return over the base, in the direction learnt for its block, and its trades."""
    days = rows.groupBy(setup, "block", "trigger_date").agg((summed("pnl_dollars", rows.columns) / base).alias("r"), F.count("*").alias("trades"))
    at = F.broadcast(spark.createDataFrame(plan.paths, "path int, block int, subset int"))
    sides = fits.select(setup, "subset", "direction").join(at, "subset").where("direction <> 0")
    # both are dealt by setup, so they meet by it alone: a setup's sides as one short list
    sides = sides.groupBy(setup).agg(F.collect_list(F.struct("path", "block", "direction")).alias("_sides"))
    met = days.join(sides, setup).withColumn("_side", F.explode(F.expr("filter(_sides, x -> x.block = block)")))
    return met.select(setup, F.col("_side.path").alias("path"), "trigger_date", (F.col("r") * F.col("_side.direction")).alias("r"), "trades")


def path_metrics(days: DataFrame, setup: str = "setup_id") -> DataFrame:
    """Of each setup and path: days, trades, return, Sharpe and deflated Sharpe ratio, mean of the lowest twentieth."""
    by = [setup, "path"]
    g = with_quantile(days, by, "_q").groupBy(*by).agg(
        F.count("*").alias("n_obs"), F.sum("trades").alias("support"), F.sum("r").alias("total_r"), sharpe_of("r").alias("sharpe"),
        F.avg(F.when(F.col("r") <= F.col("_q"), F.col("r"))).alias("cvar5"),
    )
    dsr = F.when(F.col("n_obs") > 1, F.greatest(F.lit(0.0), F.col("sharpe") - 1 / F.sqrt(F.col("n_obs") - 1))).otherwise(F.lit(0.0))
    return g.withColumn("dsr", dsr)


def overfitting(fits: DataFrame, top: float = 0.20, setup: str = "setup_id") -> DataFrame:
    """Mean over the subsets of: ``pbo``, the share of the best setups inside that aren't among the best held out; ``spearman`` of both ranks.

    Ties (to nine digits) go to the smaller id; setups without a ratio come last.
    """
    rank = lambda c: F.row_number().over(Window.partitionBy("subset").orderBy(F.round(c, 9).desc_nulls_last(), setup))
    n = F.count("*").over(Window.partitionBy("subset"))
    ranked = fits.select("subset", rank("sharpe_in").alias("a"), rank("sharpe_out").alias("b"), F.greatest(F.lit(1.0), F.rint(n * top)).alias("q"))
    best = lambda c: F.col(c) <= F.col("q")
    each = ranked.groupBy("subset").agg(
        (F.sum((best("a") & ~best("b")).cast("double")) / F.sum(best("a").cast("double"))).alias("pbo"),
        F.corr(F.col("a").cast("double"), F.col("b").cast("double")).alias("spearman"),
    )
    return each.agg(F.avg("pbo").alias("pbo"), F.avg("spearman").alias("spearman"))


def robustness(paths: DataFrame, regimes: DataFrame, over: DataFrame, gates: Gates = Gates(), setup: str = "setup_id") -> DataFrame:
    """Third stage: path metrics, the setups' overfitting, coverage of regimes; the first failed gate's code, and all of them.

    ``regimes``: a row for each setup and regime, with coverage, support and sharpe.  ``over`` has one row.
    """
    q = lambda x: F.percentile("sharpe", F.lit(x))
    g = paths.groupBy(setup).agg(
        F.count("*").alias("paths"), F.median("dsr").alias("median_dsr"), (q(0.75) - q(0.25)).alias("iqr_sharpe"), F.median("cvar5").alias("cvar5"),
        F.avg((F.col("support") >= gates.path_support).cast("double")).alias("support_rate"),
    )
    enough = (F.col("coverage") >= gates.regime_coverage) & (F.col("support") >= gates.regime_support)
    r = regimes.groupBy(setup).agg(
        F.count_if(enough).alias("regimes"), F.max("coverage").alias("top_coverage"),
        F.coalesce(F.greatest(F.max("sharpe") - F.median("sharpe"), F.lit(0.0)), F.lit(0.0)).alias("fragility"),
    )
    both = g.join(r, setup).join(F.broadcast(over))  # one row
    c = F.col
    tests = [
        ("S3_MEDIAN_DSR_LOW", c("median_dsr") >= gates.median_dsr), ("S3_IQR_HIGH", c("iqr_sharpe") <= gates.iqr_sharpe),
        ("S3_CVAR_TAIL", c("cvar5") >= gates.cvar5), ("S3_SUPPORT_RATE_LOW", c("support_rate") >= gates.support_rate),
        ("S3_PBO_HIGH", c("pbo") <= gates.pbo), ("S3_SPEARMAN_LOW", c("spearman") >= gates.spearman),
        ("S3_REGIME_MONO", (c("regimes") >= 2) & (c("top_coverage") < gates.one_regime)), ("S3_FRAGILITY_HIGH", c("fragility") <= gates.fragility),
    ]
    return judged(both, 3, tests)

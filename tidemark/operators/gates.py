"""Gates over setups: each stage adds its measures, a pass flag and the first reason to reject.

All candidates go through a stage at once; a later stage only passes what an earlier one passed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    min_trades: int = 30
    recent_days: int = 365
    min_recent: int = 5
    min_win_rate: float = 0.4
    max_daily: int = 50
    max_null_share: float = 0.2
    min_median_sharpe: float = 0.0
    max_sharpe_iqr: float = 20.0
    max_cvar: float = 0.6
    min_support: int = 5
    max_corr: float = 0.6
    max_overlap: float = 0.8


def first_code(tests: Sequence[tuple[str, Column]]) -> Column:
    """Code of the first test that fails (is false or null); null if all hold."""
    out = F.lit(None).cast("string")
    for code, ok in reversed(tests):
        out = F.when(F.coalesce(ok, F.lit(False)), out).otherwise(F.lit(code))
    return out


def health(ledger: DataFrame, as_of: date, lim: Limits = Limits()) -> DataFrame:
    """Stage 1: support, recency, recent win rate, trades a day, missing exits."""
    recent = F.datediff(F.lit(as_of), "trigger_date").between(0, lim.recent_days)
    daily = ledger.groupBy("setup_id", "trigger_date").count().groupBy("setup_id").agg(F.max("count").alias("most_daily"))
    g = ledger.groupBy("setup_id").agg(
        F.count("*").alias("trades"),
        F.sum(recent.cast("int")).alias("recent"),
        F.avg(F.when(recent & F.col("exit_date").isNotNull(), (F.col("pnl_pct") > 0).cast("double"))).alias("recent_win_rate"),
        F.avg(F.col("exit_date").isNull().cast("double")).alias("open_share"),
        F.max("trigger_date").alias("last_trigger"),
    ).join(daily, "setup_id")
    code = first_code(
        [
            ("S1_SUPPORT", F.col("trades") >= lim.min_trades),
            ("S1_RECENCY", F.col("recent") >= lim.min_recent),
            ("S1_WIN_RATE", F.col("recent_win_rate") >= lim.min_win_rate),
            ("S1_DAILY_CAP", F.col("most_daily") <= lim.max_daily),
            ("S1_MISSING", F.col("open_share") <= lim.max_null_share),
        ]
    )
    return g.withColumn("reject_1", code).withColumn("pass_1", F.col("reject_1").isNull())


def fold_profit(ledger: DataFrame, lim: Limits = Limits()) -> DataFrame:
    """Stage 2: Sharpe, tail loss and support of each fold, then their median, spread and worst."""
    q = F.percentile("pnl_pct", F.lit(0.05)).over(Window.partitionBy("setup_id", "fold"))
    rows = ledger.where("exit_date is not null").withColumn("_q", q)
    x = F.col("pnl_pct")
    sd = F.stddev_samp(x)
    folds = rows.groupBy("setup_id", "fold").agg(
        F.when(sd > 1e-12, F.avg(x) / sd * F.sqrt(F.lit(252.0))).alias("sharpe"),
        F.avg(F.when(x <= F.col("_q"), x)).alias("cvar"),
        F.count("*").alias("support"),
    )
    g = folds.groupBy("setup_id").agg(
        F.percentile("sharpe", F.lit(0.5)).alias("median_sharpe"),
        (F.percentile("sharpe", F.lit(0.75)) - F.percentile("sharpe", F.lit(0.25))).alias("sharpe_iqr"),
        F.percentile("cvar", F.lit(0.5)).alias("median_cvar"),
        F.min("sharpe").alias("worst_sharpe"),
        F.avg((F.col("support") >= lim.min_support).cast("double")).alias("support_rate"),
        F.count("*").alias("folds"),
    )
    code = first_code(
        [
            ("S2_SHARPE", F.col("median_sharpe") >= lim.min_median_sharpe - 1e-9),
            ("S2_SPREAD", F.col("sharpe_iqr") <= lim.max_sharpe_iqr),
            ("S2_TAIL", F.abs("median_cvar") <= lim.max_cvar),
            ("S2_SUPPORT", F.col("support_rate") >= 0.8),
        ]
    )
    return g.withColumn("reject_2", code).withColumn("pass_2", F.col("reject_2").isNull())


def rank_overlap(scores: DataFrame, key: str, a: str, b: str, top: float = 0.25) -> DataFrame:
    """Stage 3: overfit share (best by ``a`` that aren't best by ``b``) and rank correlation."""
    n = F.count("*").over(Window.partitionBy())
    ranked = scores.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns(
        {"ra": F.row_number().over(Window.orderBy(F.desc(a), key)), "rb": F.row_number().over(Window.orderBy(F.desc(b), key)), "n": n}
    )
    best = lambda c: F.col(c) <= F.greatest(F.floor(F.col("n") * top), F.lit(1))
    return ranked.agg(
        (1 - F.sum((best("ra") & best("rb")).cast("double")) / F.sum(best("ra").cast("double"))).alias("pbo"),
        F.corr(F.col("ra").cast("double"), F.col("rb").cast("double")).alias("spearman"),
        F.count("*").alias("n"),
    )


def overlap(candidates: DataFrame, live: DataFrame, key: str = "setup_id", day: str = "trigger_date") -> DataFrame:
    """Stage 4: share of a candidate's active days on which the live book is active too."""
    days = candidates.select(key, day).distinct()
    busy = live.select(day).distinct().withColumn("_on", F.lit(1))
    hit = days.join(busy, day, "left").groupBy(key).agg(F.avg(F.coalesce("_on", F.lit(0)).cast("double")).alias("overlap"))
    return hit


def mean_abs_corr(candidates: DataFrame, live: DataFrame, key: str, live_key: str, day: str, r: str, least: int = 10) -> DataFrame:
    """Stage 4: mean absolute correlation of a candidate's daily returns with the live strategies'."""
    b = live.select(F.col(live_key).alias("_live"), F.col(day), F.col(r).alias("_r"))
    pairs = candidates.select(key, day, r).join(b, day)
    sx, sy = F.stddev_samp(r), F.stddev_samp("_r")
    each = pairs.groupBy(key, "_live").agg(F.count("*").alias("n"), F.when(sx * sy > 1e-15, F.covar_samp(r, "_r") / (sx * sy)).alias("c"))
    return each.where(F.col("n") >= least).groupBy(key).agg(F.avg(F.abs("c")).alias("mean_abs_corr"))


def promotion(stages: DataFrame) -> DataFrame:
    """Stage 5: the weighted score of four stage scores on 0 to 2, and the decision."""
    # Weights of the stages.
    weights = {"score_1": 0.10, "score_2": 0.25, "score_3": 0.45, "score_4": 0.20}
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + w * F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(2.0)) / 2
    return stages.withColumn("promotion", total)


def capacity_haircut(sharpe: Column, capacity: Column) -> Column:
    return sharpe * (0.5 + 0.5 * capacity)


def safe_deflated(sr: Column, n: Column, trials: int) -> Column:
    from math import log, sqrt

    return F.when(n > 1, F.greatest(F.lit(0.0), sr - sqrt(max(log(max(trials, 1)), 1.0)) / F.sqrt(n - 1)))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a share."""
    p = k / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, (mid - half) / (1 + z * z / n)), F.when(n > 0, (mid + half) / (1 + z * z / n))

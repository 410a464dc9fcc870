"""Selection: best horizon, portfolio building, daily selector, slates and reports."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows of each group; the order should end in a key, so that ties are settled."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def best_horizon(ledger: DataFrame, min_support: int) -> DataFrame:
    """Horizon of each ticker with the best (Sharpe, omega, support) among those with enough trades."""
    x = F.col("pnl_pct")
    sd, loss = F.stddev_samp(x), -F.sum(F.when(x < 0, x).otherwise(0.0))
    g = ledger.groupBy("ticker", "horizon").agg(
        F.count("*").alias("support"),
        F.when(sd > 1e-12, F.avg(x) / sd).alias("sharpe"),
        F.when(loss > 1e-12, F.sum(F.when(x > 0, x).otherwise(0.0)) / loss).alias("omega"),
    )
    order = [F.desc_nulls_last("sharpe"), F.desc_nulls_last("omega"), F.desc("support"), F.col("horizon")]
    return top_k(g.where(F.col("support") >= min_support), ["ticker"], order, 1)


def stepwise(candidates: DataFrame, returns: DataFrame, key: str, order: str, day: str, r: str) -> DataFrame:
    """Greedy forward selection: candidates in order join while the Sharpe ratio of the daily median rises.

    Sequential by nature; candidates are few, so one worker folds over their daily returns.
    """
    ranked = returns.join(F.broadcast(candidates.select(key, order)), key).withColumn("_all", F.lit(1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=day, columns=[order, key], values=r, aggfunc="median").sort_index(axis=1)
        chosen: list = []
        best = -np.inf
        for k in range(wide.shape[1]):
            x = np.nanmedian(wide.iloc[:, [*chosen, k]].dropna(how="all").to_numpy(), axis=1)
            s = x.mean() / x.std(ddof=1) if len(x) > 1 and x.std(ddof=1) > 1e-12 else -np.inf
            if s <= best:
                break
            best = s
            chosen.append(k)
        return pd.DataFrame({key: [wide.columns[c][1] for c in chosen], "step": range(1, len(chosen) + 1)})

    kind = candidates.schema[key].dataType.simpleString()
    return ranked.groupBy("_all").applyInPandas(run, f"`{key}` {kind}, step int")


def recency_weight(days: Column, half_life: float = 63.0, floor: float = 0.2) -> Column:
    """Halves every ``half_life`` days, between the floor and 1; unknown is the floor."""
    return F.coalesce(F.least(F.greatest(F.pow(F.lit(0.5), days / half_life), F.lit(floor)), F.lit(1.0)), F.lit(floor))


def trigger_map(signals: DataFrame, setups: DataFrame, days: DataFrame, last_rows: int) -> DataFrame:
    """Of each setup within the last rows of the calendar: whether any and all signals fired, hits, latest days.

    ``signals``: date, signal_id; ``setups``: setup_id, signal_id.
    """
    window = days.select("date").distinct().orderBy(F.desc("date")).limit(last_rows)
    hits = signals.join(F.broadcast(window), "date", "left_semi").join(setups, "signal_id")
    size = setups.groupBy("setup_id").agg(F.count_distinct("signal_id").alias("size"))
    per_day = hits.groupBy("setup_id", "date").agg(F.count_distinct("signal_id").alias("n"))
    full = per_day.join(size, "setup_id").groupBy("setup_id").agg(
        F.max((F.col("n") == F.col("size")).cast("int")).alias("all_day"),
        F.max(F.when(F.col("n") == F.col("size"), F.col("date"))).alias("latest_all"), F.max("date").alias("latest_any"),
    )
    total = hits.groupBy("setup_id").agg(F.count("*").alias("fired"), F.count_distinct("signal_id").alias("distinct_fired"))
    return size.join(total, "setup_id", "left").join(full, "setup_id", "left").select(
        "setup_id", F.col("fired").isNotNull().alias("fired_any"), F.coalesce(F.col("all_day") == 1, F.lit(False)).alias("fired_all"),
        F.coalesce("fired", F.lit(0)).alias("total_count"), (F.coalesce("distinct_fired", F.lit(0)) / F.col("size")).alias("strength"),
        "latest_any", "latest_all",
    )


def daily_selection(records: DataFrame, positions: int, cap: float = 1.0) -> DataFrame:
    """Score, keep the best of equal fingerprints, take the top, and size in proportion to the cap.

    ``records``: setup_id, fingerprint, prior, penalty, days_since, strength, fired_any.
    """
    raw = F.col("prior") / F.greatest("penalty", F.lit(1.0)) * recency_weight(F.col("days_since")) + 0.25 * F.coalesce("strength", F.lit(0.0))
    scored = records.withColumn("score", F.signum(raw) * F.log1p(F.abs(raw)))
    live = scored.where("fired_any and score > 0")
    unique = top_k(live, ["fingerprint"], [F.desc("score"), F.col("setup_id")], 1)
    best = unique.orderBy(F.desc("score"), "setup_id").limit(positions)
    share = F.col("score") / F.sum("score").over(Window.partitionBy())
    return best.withColumn("size", share * cap)


def option_structure(p_down: Column, p_flat: Column, p_up: Column, tail_down: Column, tail_up: Column) -> Column:
    """Structure whose linear score of the band masses is highest; the first of equals, to nine digits, as equal scores are different sums."""
    # Weights of (down, flat, up, lower tail, upper tail).
    table = {
        "long_call": (-1.0, -0.5, 1.0, -0.5, 1.0),
        "long_put": (1.0, -0.5, -1.0, 1.0, -0.5),
        "call_spread": (-1.0, 0.0, 1.2, -0.5, -0.5),
        "put_spread": (1.2, 0.0, -1.0, -0.5, -0.5),
        "straddle": (0.3, -1.5, 0.3, 1.0, 1.0),
        "iron_condor": (-0.5, 1.5, -0.5, -1.0, -1.0),
    }
    parts = (p_down, p_flat, p_up, tail_down, tail_up)
    scores = {n: sum((w * p for w, p in zip(ws, parts)), F.lit(0.0)) for n, ws in table.items()}
    scores = {n: F.round(s, 9) for n, s in scores.items()}
    top = F.greatest(*scores.values())
    out = F.lit(None).cast("string")
    for n, s in reversed(scores.items()):
        out = F.when(s == top, n).otherwise(out)
    return out


def breakdown(rows: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Mean, median, deviation, extremes and count of a metric, rounded to four digits."""
    g = rows.groupBy(*by).agg(
        F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_samp(x).alias("std"), F.min(x).alias("least"),
        F.max(x).alias("most"), F.count(x).alias("count"),
    )
    return g.select(*by, *(F.round(c, 4).alias(c) for c in ("mean", "median", "std", "least", "most")), "count")


def quantile_table(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """10, 50 and 90 % quantiles, one row for each metric."""
    q = [F.percentile(m, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias(m) for m in metrics]
    one = rows.agg(*q)
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("q")) for m in metrics)))
    return one.select(pairs.alias("p")).select("p.metric", F.col("p.q")[0].alias("p10"), F.col("p.q")[1].alias("p50"), F.col("p.q")[2].alias("p90"))


def coverage(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of values present in each column, one row for each."""
    one = rows.agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("present")) for c in columns)))
    return one.select(pairs.alias("p")).select("p.*")


def eligible(rows: DataFrame, min_skill: float, max_mae: float, drift: bool) -> DataFrame:
    test = (F.col("skill_vs_marginal") >= min_skill) & (F.col("calibration_mae") <= max_mae)
    return rows.where(test & F.col("drift_passed") if drift else test)


def aligned(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns first, null where missing, then the others."""
    named = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return rows.select(*named, *(c for c in rows.columns if c not in columns))

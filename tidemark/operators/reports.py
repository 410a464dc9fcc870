"""Reports over setups: priors, open positions, tradeable setups, coverage, eligibility summaries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import weekdays_between
from tidemark.operators.selection import recency_weight, top_k


def growth(r: Column) -> Column:
    """Compounded return of a group, each loss at most 95 %."""
    return F.expm1(F.sum(F.log1p(F.greatest(r, F.lit(-0.95)))))


def prior_records(ledger: DataFrame, as_of: date, half_life: float = 63.0) -> DataFrame:
    """Of each setup: trades in all, in twelve and in six months, growth, last trigger, recency weight."""
    back = lambda d: (F.col("trigger_date") > F.date_sub(F.lit(as_of), d)).cast("int")
    g = ledger.where(F.col("trigger_date") <= F.lit(as_of)).groupBy("setup_id").agg(
        F.count("*").alias("trades_total"), F.sum(back(365)).alias("trades_12m"), F.sum(back(182)).alias("trades_6m"),
        growth(F.col("pnl_pct") / 100).alias("growth"), F.max("trigger_date").alias("last_trigger"),
    )
    return g.withColumn("recency", recency_weight(F.datediff(F.lit(as_of), "last_trigger"), half_life))


def open_positions(ledger: DataFrame) -> DataFrame:
    """The last trade of each setup whose trigger is younger than its horizon, by the ledger's last day."""
    last = ledger.groupBy("setup_id").agg(F.max(F.struct("trigger_date", "trade_id", "ticker", "horizon", "capital")).alias("t"))
    end = ledger.agg(F.max("trigger_date").alias("end"))
    rows = last.select("setup_id", "t.*").join(F.broadcast(end))
    age = F.datediff("end", "trigger_date")
    return rows.where(age < F.col("horizon")).select("setup_id", "ticker", "trigger_date", "trade_id", "horizon", age.alias("age"))


def holding(ledger: DataFrame, by: Sequence[str]) -> DataFrame:
    """Median weekdays held, and closed trades for each weekday of the span."""
    days = weekdays_between(F.col("trigger_date"), F.col("exit_date"))
    closed = ledger.where(F.col("exit_date") >= F.col("trigger_date")).withColumn("_d", days)
    g = closed.groupBy(*by).agg(F.median("_d").alias("median_days"), F.count("*").alias("n"), F.min("trigger_date").alias("a"), F.max("trigger_date").alias("b"))
    return g.select(*by, F.col("median_days").cast("double").alias("median_days"), (F.col("n") / weekdays_between(F.col("a"), F.col("b"))).alias("per_weekday"))


def tradeable(rows: DataFrame, approved: DataFrame, as_of: date, most_days: Column) -> DataFrame:
    """Recent and approved setups, the latest and best of each ticker.

    ``rows``: ticker, setup_id, last_trigger, quality; ``approved``: setup_id.
    """
    recent = rows.where(F.datediff(F.lit(as_of), "last_trigger") <= most_days)
    live = recent.join(approved, "setup_id", "left_semi")
    return top_k(live, ["ticker"], [F.desc("last_trigger"), F.desc("quality"), F.col("setup_id")], 1)


def eligibility_summary(rows: DataFrame, levels: Sequence[str], x: str) -> DataFrame:
    """Count, mean and distinct setups overall and by each level, in one pass over grouping sets."""
    kinds = F.array(F.struct(F.lit("all").alias("level"), F.lit("").alias("value")), *(F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("value")) for c in levels))
    long = rows.select("setup_id", x, F.explode(kinds).alias("k"))
    return long.groupBy("k.level", "k.value").agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.count_distinct("setup_id").alias("setups"))


def blocker_counts(rows: DataFrame, reasons: str) -> DataFrame:
    """How often each reason occurs in an array column."""
    return rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def valid_setups(rows: DataFrame, text: str) -> DataFrame:
    """Serialised setups parsed: ticker, signals, and whether the text is one."""
    parsed = F.from_json(F.col(text), "ticker string, signals array<string>")
    ok = parsed["ticker"].isNotNull() & (F.coalesce(F.size(parsed["signals"]), F.lit(0)) > 0)
    return rows.select("*", parsed["ticker"].alias("ticker"), parsed["signals"].alias("signals"), ok.alias("valid"))


def drift_table(rows: DataFrame, auc: str = "drift_auc", passed: str = "drift_passed") -> DataFrame:
    """Of each ticker: mean separability of its samples, share that passed, validations."""
    return rows.groupBy("ticker").agg(F.avg(auc).alias("mean_drift_auc"), F.avg(F.col(passed).cast("double")).alias("drift_pass_rate"), F.count("*").alias("n_validations"))


def regime_table(rows: DataFrame, regime: str, skill: str, others: Sequence[str], passed: str = "drift_passed") -> DataFrame:
    """Of each regime: mean, spread and count of the skill, means of other measures, share that passed."""
    return rows.groupBy(regime).agg(
        F.avg(skill).alias("skill_mean"), F.stddev_samp(skill).alias("skill_std"), F.count(skill).alias("skill_count"), *(F.avg(c).alias(f"{c}_mean") for c in others),
        F.avg(F.col(passed).cast("double")).alias("pass_rate"),
    )


def validation_summary(rows: DataFrame, eligible: Column, skill: str) -> DataFrame:
    """One row: validations, eligible ones and their rate, tickers, horizons, mean and median skill of all and of the eligible."""
    ok = F.coalesce(eligible, F.lit(False))
    mine = F.when(ok, F.col(skill))
    return rows.agg(
        F.count("*").alias("total_validations"), F.count_if(ok).alias("eligible_setups"), F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("eligibility_rate"),
        F.count_distinct("ticker").alias("unique_tickers"), F.count_distinct("horizon").alias("unique_horizons"), F.avg(skill).alias("mean_skill"), F.median(skill).alias("median_skill"),
        F.coalesce(F.avg(mine), F.lit(0.0)).alias("eligible_mean_skill"), F.coalesce(F.median(mine), F.lit(0.0)).alias("eligible_median_skill"),
    )

"""Profit and loss: ledgers to daily returns, and the risk metrics of return series.

Ratios that would be infinite are null; ``*_raw`` columns say ``inf`` where that happened.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import is_weekday, weekdays_between

YEAR = 252.0


def guarded(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return F.when(F.abs(b) > eps, a / b)


def daily_by_trigger(ledger: DataFrame, by: Sequence[str], how: str = "median") -> DataFrame:
    """One return a trigger day: the median (or mean) of its trades."""
    agg = F.median("pnl_pct") if how == "median" else F.avg("pnl_pct")
    return ledger.groupBy(*by, "trigger_date").agg(agg.alias("r"))


def nav_returns(ledger: DataFrame, by: Sequence[str], base: float) -> DataFrame:
    """Realised P&L of each exit day over the base, zero on weekdays without exits."""
    day = ledger.where("exit_date is not null").groupBy(*by, "exit_date").agg(F.sum("pnl_dollars").alias("pnl"))
    span = day.groupBy(*by).agg(F.min("exit_date").alias("a"), F.max("exit_date").alias("b"))
    spine = span.select(*by, F.explode(F.sequence("a", "b")).alias("exit_date")).where(is_weekday(F.col("exit_date")))
    return spine.join(day, [*by, "exit_date"], "left").select(*by, "exit_date", (F.coalesce("pnl", F.lit(0.0)) / base).alias("r"))


def summed(x: str, columns: Sequence[str], row: str = "row") -> Column:
    """Sum of a group's doubles; in the order of ``row`` if there is one: the last digit hangs on the order, and a limit or a tie on that."""
    if row not in columns:
        return F.sum(x)
    terms = F.array_sort(F.collect_list(F.when(F.col(x).isNotNull(), F.struct(row, x))))
    return F.when(F.size(terms) > 0, F.aggregate(terms, F.lit(0.0), lambda total, term: total + term[x]))


def realised(ledger: DataFrame, by: Sequence[str], base: float) -> DataFrame:
    """The weekdays of ``nav_returns`` without the rows of idle days: ``r`` of ``n`` equal days, in the order of exit_date and ``step``.

    An exit day is a row (n is 0 on a weekend), the weekdays up to the next exit are one more with r 0.  ``trades`` counts
    known profits; those of open trades stand in a row without a date.  Rows are dealt by the first of ``by`` once, so
    what groups or orders them by that and others needs no further shuffle.
    """
    order = [c for c in ("row",) if c in ledger.columns]
    dealt = ledger.select(*by, "exit_date", "pnl_dollars", "pnl_pct", *order).repartition(by[0])
    day = dealt.groupBy(*by, "exit_date").agg(F.coalesce(summed("pnl_dollars", dealt.columns), F.lit(0.0)).alias("_pnl"), F.count("pnl_pct").alias("_trades"))
    following = F.lead("exit_date").over(Window.partitionBy(*by).orderBy(F.asc_nulls_last("exit_date")))
    day = day.withColumn("_next", following)
    idle = F.coalesce(weekdays_between(F.date_add("exit_date", 1), F.date_sub("_next", 1)), F.lit(0))
    worked = F.col("exit_date").isNotNull() & is_weekday(F.col("exit_date"))
    entry = lambda step, r, n, trades: F.struct(F.lit(step).alias("step"), r.alias("r"), n.cast("long").alias("n"), trades.alias("trades"))
    both = F.array(entry(0, F.when(worked, F.col("_pnl") / base), F.when(worked, 1).otherwise(0), F.col("_trades")), entry(1, F.lit(0.0), idle, F.lit(0).cast("long")))
    return day.select(*by, "exit_date", F.explode(both).alias("_x")).select(*by, "exit_date", "_x.*").where("step = 0 or n > 0")


def winsorized(returns: DataFrame, by: Sequence[str], r: str = "r", low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Returns clipped to their own quantiles."""
    w = Window.partitionBy(*by)
    q = F.percentile(r, F.array(F.lit(low), F.lit(high))).over(w)
    return returns.withColumn("_q", q).withColumn(r, F.least(F.greatest(r, F.col("_q")[0]), F.col("_q")[1])).drop("_q")


def nav_paths(returns: DataFrame, by: Sequence[str], order: Sequence[str], r: str = "r") -> DataFrame:
    """Compounded value and drawdown after each return."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    nav = F.exp(F.sum(F.log1p(F.col(r))).over(w))
    out = returns.withColumn("nav", nav)
    return out.withColumn("dd", F.col("nav") / F.max("nav").over(w) - 1)


def risk_metrics(returns: DataFrame, by: Sequence[str], order: Sequence[str], r: str = "r", alpha: float = 0.05) -> DataFrame:
    """Return, risk, drawdown and tail metrics of each group: one shuffle for the paths, one group."""
    paths = nav_paths(returns, by, order, r)
    w = Window.partitionBy(*by)
    x, dd = F.col(r), F.col("dd")
    paths = paths.withColumns(
        {
            "_mu": F.avg(r).over(w), "_sd": F.stddev_samp(r).over(w),
            "_q": F.percentile(r, F.lit(alpha)).over(w), "_dq": F.percentile("dd", F.lit(alpha)).over(w),
            "_k": F.row_number().over(w.orderBy("dd", *order)),
        }
    )
    z = guarded(x - F.col("_mu"), F.col("_sd"))
    first, last = F.min_by("nav", F.struct(*order)), F.max_by("nav", F.struct(*order))
    g = paths.groupBy(*by).agg(
        F.count(r).alias("n"), F.avg(r).alias("mu"), F.stddev_samp(r).alias("sd"),
        F.stddev_samp(F.when(x < 0, x)).alias("down"),
        F.sum(F.when(x > 0, x).otherwise(0.0)).alias("gains"), (-F.sum(F.when(x < 0, x).otherwise(0.0))).alias("losses"),
        F.avg(F.when(x > 0, x)).alias("avg_win"), (-F.avg(F.when(x < 0, x))).alias("avg_loss"),
        F.avg((x > 0).cast("double")).alias("hit_rate"),
        F.avg(z * z * z).alias("skew"), (F.avg(z * z * z * z) - 3).alias("kurt"),
        F.first("_q").alias("var"), F.avg(F.when(x <= F.col("_q"), x)).alias("cvar"),
        F.avg(F.when(dd <= F.col("_dq"), dd)).alias("cdar"),
        first.alias("nav0"), last.alias("nav1"), F.min("dd").alias("mdd"), F.avg("dd").alias("avg_dd"),
        F.sqrt(F.avg((100 * dd) * (100 * dd))).alias("ulcer"), F.avg(F.abs(dd)).alias("pain"),
        F.sqrt(F.avg(dd * dd)).alias("_burke"), (-F.avg(F.when(F.col("_k") <= 3, dd))).alias("_sterling"),
    )
    cagr = F.pow(F.col("nav1") / F.col("nav0"), YEAR / F.col("n")) - 1
    g = g.withColumn("cagr", cagr)
    return g.select(
        *by, "n", "hit_rate", "cagr", "mdd", "avg_dd", "ulcer", "pain", "var", "cvar", "cdar", "skew", "kurt",
        F.when(F.col("n") < 2, F.lit(0.0)).otherwise(guarded(F.col("mu") * YEAR, F.col("sd") * F.sqrt(F.lit(YEAR)))).alias("sharpe"),
        guarded(F.col("mu") * F.sqrt(F.lit(YEAR)), F.col("down")).alias("sortino"),
        guarded(F.col("gains"), F.col("losses")).alias("omega"),
        guarded(F.col("gains"), F.col("losses")).alias("profit_factor"),
        F.when((F.col("losses") < 1e-12) & (F.col("gains") > 0), "inf").alias("profit_factor_raw"),
        guarded(F.col("avg_win"), F.col("avg_loss")).alias("payoff"),
        guarded(F.col("cagr"), F.abs("mdd")).alias("calmar"),
        guarded(F.col("cagr"), F.col("ulcer")).alias("ulcer_ratio"),
        guarded(F.col("cagr"), F.col("pain")).alias("pain_ratio"),
        guarded(F.col("cagr"), F.col("_burke")).alias("burke"),
        guarded(F.col("cagr"), F.col("_sterling")).alias("sterling"),
    )


def streaks(rows: DataFrame, by: Sequence[str], order: Sequence[str], x: str) -> DataFrame:
    """Longest runs of wins and of losses; a zero ends a run."""
    w = Window.partitionBy(*by).orderBy(*order)
    sign = F.signum(F.col(x))
    turn = F.when(F.lag(sign).over(w) == sign, 0).otherwise(1)
    runs = rows.withColumns({"_s": sign, "_turn": turn}).withColumn("_run", F.sum("_turn").over(w))
    size = runs.groupBy(*by, "_run", "_s").agg(F.count("*").alias("k"))
    longest = lambda s: F.coalesce(F.max(F.when(F.col("_s") == s, F.col("k"))), F.lit(0))
    return size.groupBy(*by).agg(longest(1).alias("longest_win"), longest(-1).alias("longest_loss"))


def regression_on(rows: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """Beta, annual alpha, tracking error and information ratio against a benchmark."""
    w = Window.partitionBy(*by)
    paired = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    beta = guarded(F.covar_samp(y, x).over(w), F.var_samp(x).over(w))
    resid = paired.withColumn("_b", beta).withColumn("_e", F.col(y) - F.col("_b") * F.col(x)).withColumn("_d", F.col(y) - F.col(x))
    g = resid.groupBy(*by).agg(
        F.first("_b").alias("beta"), (F.avg("_e") * YEAR).alias("alpha"), F.avg("_d").alias("_m"), F.stddev_samp("_d").alias("_s")
    )
    return g.select(*by, "beta", "alpha", (F.col("_s") * F.sqrt(F.lit(YEAR))).alias("tracking_error"),
                    guarded(F.col("_m") * F.sqrt(F.lit(YEAR)), F.col("_s")).alias("information_ratio"))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution to about 1e-7: a rational approximation, as there is no erf."""
    # Coefficients of the approximation.
    p, b = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    a = F.abs(x)
    t = 1 / (1 + p * a)
    poly = F.lit(0.0)
    for c in reversed(b):
        poly = (poly + c) * t
    upper = F.exp(-a * a / 2) / F.sqrt(F.lit(2 * np.pi)) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def probabilistic_sharpe(sr: Column, n: Column, skew: Column, kurt: Column, against: Column | float = 0.0) -> Column:
    """Probability that the Sharpe ratio exceeds ``against``; kurt is excess kurtosis."""
    spread = 1 - skew * sr + (kurt + 2) / 4 * sr * sr
    against = F.lit(against) if isinstance(against, float) else against
    return F.when((spread > 0) & (n > 1), normal_cdf((sr - against) * F.sqrt(n - 1) / F.sqrt(spread)))


def deflated_sharpe(sr: Column, n: Column, skew: Column, kurt: Column, trials: int) -> Column:
    return probabilistic_sharpe(sr, n, skew, kurt, F.sqrt(2 * F.log(F.lit(float(max(trials, 2)))) / (n - 1)))


def block_indices(n: int, block: int, rng: np.random.Generator, stationary: bool) -> np.ndarray:
    """Resampled positions: blocks of geometric length around ``block``, or of that length."""
    if stationary:
        start = rng.random(n) < 1 / max(block, 1)
        start[0] = True
        begin = rng.integers(0, n, n)
        at = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        return (begin[at] + np.arange(n) - at) % n
    block = min(max(block, 1), n)
    heads = rng.integers(0, n - block + 1, -(-n // block))
    return (heads[:, None] + np.arange(block)).ravel()[:n]


STATISTICS = {
    "mean": lambda x: x.mean(axis=1),
    "sharpe": lambda x: x.mean(axis=1) / np.maximum(x.std(axis=1, ddof=1), 1e-12) * np.sqrt(YEAR),
    "profit_factor": lambda x: np.maximum(x, 0).sum(axis=1) / np.maximum(-np.minimum(x, 0).sum(axis=1), 1e-12),
    "total": lambda x: np.expm1(np.log1p(np.maximum(x, -0.95)).sum(axis=1)),
}


def bootstrap(
    returns: DataFrame, by: Sequence[str], order: Sequence[str], statistic: str, replicates: int = 250, block: int = 5,
    stationary: bool = True, seed: int = 0, smallest: int = 10, r: str = "r",
) -> DataFrame:
    """Point value, median, 5 % and 95 % of the resampled statistic of each group.

    Groups below ``smallest`` give the point value.  A group is one return series, drawn in a worker
    in batches of replicates; the seed depends on the group only.
    """
    names = list(by)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(list(order))[r].dropna().to_numpy()
        f = STATISTICS[statistic]
        point = float(f(x[None, :])[0]) if len(x) > 1 else np.nan
        low, mid, high = point, point, point
        if len(x) >= smallest:
            rng = np.random.default_rng([seed, crc32(repr(key).encode())])
            draws = np.concatenate(
                [f(np.stack([x[block_indices(len(x), block, rng, stationary)] for _ in range(min(50, replicates - k))])) for k in range(0, replicates, 50)]
            )
            low, mid, high = np.quantile(draws, [0.05, 0.5, 0.95])
        return pd.DataFrame([[*key, point, mid, low, high]], columns=[*names, "point", "median", "lower", "upper"])

    kinds = ", ".join(f"`{c}` {returns.schema[c].dataType.simpleString()}" for c in names)
    rows = returns.select(*names, *order, r)
    return rows.groupBy(*names).applyInPandas(run, f"{kinds}, point double, median double, lower double, upper double")


def exclusive(ledger: DataFrame, by: Sequence[str], cooldown: int, far: int = 3650) -> DataFrame:
    """Trades that start after the last kept exit and a cooldown; an open trade blocks ``far`` days.

    Greedy in the order of trigger, id and exit.  A group's sorted rows stream by: a worker holds a batch and the day
    up to which the group is blocked, and jumps from one kept trade to the next.  Trades without a trigger go.
    """
    end = F.coalesce("exit_date", F.date_add("trigger_date", far))
    rows = ledger.where("trigger_date is not null").select("*", F.to_json(F.struct(*by)).alias("_group"), F.unix_date("trigger_date").alias("_from"), F.unix_date(F.date_add(end, cooldown)).alias("_until"))
    columns = ledger.columns
    dealt = rows.repartition(*by).sortWithinPartitions(*by, "trigger_date", "trade_id", F.asc_nulls_last("exit_date"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, blocked = None, 0
        for batch in batches:
            names = batch.column("_group").to_pylist()
            begin, until = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_from", "_until"))
            heads = [k for k, name in enumerate(names) if not k or name != names[k - 1]]
            kept = []
            for a, b in zip(heads, [*heads[1:], len(names)]):
                if names[a] != group:
                    group, blocked = names[a], -(1 << 31)
                k = a
                while (k := max(k, a + int(np.searchsorted(begin[a:b], blocked, "right")))) < b:
                    kept.append(k)
                    blocked = int(until[k])  # may lie before the trigger
                    k += 1
            yield batch.select(columns).take(pa.array(kept, pa.int64()))

    return dealt.mapInArrow(run, ledger.schema)


def trade_key(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)

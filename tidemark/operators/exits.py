"""Exit rules of option trades, decided on each trade's ordered path of prices.

A path is an array of (day, price) from the entry on, folded inside one expression: no row
meets another after the path has been gathered, and a path is no longer than asked for.
Rules of a day in order: profit target; a profit while prices jump; a profit near
expiry; stop; a price that falls through the trail below the recent high; expiry.  If
none holds on any day, the trade ends with its horizon, or with the path.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import add_weekdays


@dataclass(frozen=True)
class Policy:
    """Thresholds of the rules; ``target`` None turns the profit target off, ``enabled`` False all rules."""

    # The defaults are those of the regime-aware mode.
    target: float | None = 1.5
    spike_profit: float = 0.8
    spike: float = 0.15
    expiry_profit: float = 0.4
    expiry_life: float = 0.1
    stop: float = -0.8
    trail_profit: float = 0.2
    trail_ranges: float = 2.0
    enabled: bool = True


REGIME_AWARE = Policy()
# The mode that lets winners run.
MOONSHOT = Policy(target=None, spike_profit=3.0, spike=0.20, expiry_profit=0.50, stop=-0.95, trail_profit=2.0, trail_ranges=4.0)
DISABLED = Policy(enabled=False)


def rule_of(path: Column, i: Column, entry: Column, expiry: Column, tenor: Column, policy: Policy) -> Column:
    """Name of the first rule that holds on day ``i`` of the path, else null; a day without a price only expires."""
    at = lambda k: F.get(path, i + k)["price"]
    change = lambda k: F.try_divide(at(k) - at(k - 1), at(k - 1))
    day, price = F.get(path, i)["day"], at(0)
    gain = F.when(entry > 0, (price - entry) / entry).when(price.isNotNull(), 0.0)
    jump = F.abs(change(0) - change(-1)) / 2  # deviation of two changes
    recent = F.transform(F.slice(path, i - 3, F.lit(5)), lambda x: x["price"])
    whole = ~F.exists(recent, lambda x: x.isNull())
    high, low = F.array_max(recent), F.array_min(recent)
    trail = high - (high - low) / 5 * policy.trail_ranges
    life = F.try_divide(F.datediff(expiry, day), tenor)
    out = F.when(gain >= policy.target, "pt_hit_legA") if policy.target is not None else F.when(F.lit(False), "")
    return (
        out.when((i >= 2) & (gain >= policy.spike_profit) & (jump > policy.spike), "volatility_spike_profit")
        .when((life <= policy.expiry_life) & (gain >= policy.expiry_profit), "time_decay_protection")
        .when(gain <= policy.stop, "stop_loss")
        # a slice must not start before the first day
        .when((i >= 5) & (gain >= policy.trail_profit) & F.when(i >= 5, whole & (price <= trail)), "atr_trail_hit")
        .when(day >= expiry, "option_expired")
    )


def exit_of(path: Column, entry: Column, horizon: Column, expiry: Column, tenor: Column, policy: Policy = REGIME_AWARE) -> Column:
    """(step, reason) of a path's exit; null if it stays open or has no day.  ``expiry`` and ``tenor`` may be null."""
    n = F.size(path)
    spent = F.struct((n - 1).alias("step"), F.lit("option_expired").alias("reason"))
    if not policy.enabled:
        return F.when((n > 0) & (F.get(path, n - 1)["day"] >= expiry), spent)
    days = F.sequence(F.lit(0), n - 1)
    hits = F.filter(F.transform(days, lambda i: F.struct(i.alias("step"), rule_of(path, i, entry, expiry, tenor, policy).alias("reason"))), lambda x: x["reason"].isNotNull())
    end = F.when(horizon > 0, F.least(n - 1, F.greatest(F.lit(0), horizon - 1))).otherwise(n - 1)
    return F.when(n > 0, F.coalesce(F.get(hits, F.lit(0)), F.struct(end.cast("int").alias("step"), F.lit("max_horizon_exit").alias("reason"))))


def closed(marks: DataFrame, by: Sequence[str], policies: Mapping[str, Policy] | None = None, tenor: str = "tenor", horizon: str = "horizon") -> DataFrame:
    """Ledger of the trades whose marks are (by, step, day, price), under each named policy: entry, exit step, reason, day, price and profit.

    ``tenor`` in weekdays and ``horizon`` in days are columns of the marks, the same on each of a trade's.  The entry
    is the first mark; a trade that stays open has no exit.  A path is gathered once for all policies.
    """
    named = policies or {"regime_aware": REGIME_AWARE}
    mark = F.struct("step", F.col("day"), F.col("price"))
    g = marks.groupBy(*by).agg(F.sort_array(F.collect_list(mark)).alias("path"), F.first(tenor).alias("_tenor"), F.first(horizon).alias("_horizon"))
    first = F.get("path", F.lit(0))
    g = g.withColumns({"trigger_date": first["day"], "entry_price": first["price"]})
    expiry = F.when(F.col("_tenor") > 0, add_weekdays(F.col("trigger_date"), F.col("_tenor")))
    g = g.withColumn("_expiry", expiry)
    args = [F.col(c) for c in ("path", "entry_price", "_horizon", "_expiry", "_tenor")]
    g = g.withColumn("_x", F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), exit_of(*args, p).alias("at")) for n, p in named.items()))))
    last = F.get("path", F.col("_x.at.step"))
    return g.select(
        "_x.policy", *by, "trigger_date", "entry_price", F.col("_x.at.step").alias("exit_step"), F.col("_x.at.reason").alias("exit_reason"), last["day"].alias("exit_date"),
        last["price"].alias("exit_price"), F.when(F.col("entry_price") > 0, last["price"] / F.col("entry_price") - 1).alias("pnl_pct"),
    )

"""Signal compiler: features to boolean signals by a table of rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: name, needed kind of feature, test over (value, share below, z); text in Spark SQL and DuckDB alike.
RULES = (
    ("pctl_above_90", "plain", "share > 0.9e0"),
    ("pctl_above_80", "plain", "share > 0.8e0"),
    ("pctl_below_20", "plain", "share < 0.2e0"),
    ("pctl_below_10", "plain", "share < 0.1e0"),
    ("reversion_high", "plain", "share > 0.95e0 AND z > 2e0"),
    ("reversion_low", "plain", "share < 0.05e0 AND z < -2e0"),
    ("z_above", "any", "z > 1.5e0"),
    ("z_below", "any", "z < -1.5e0"),
)


def clip01(c: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def z_to_prob_tanh(z: Column, scale: float = 2.0) -> Column:
    return clip01(0.5 * (1 + F.tanh(z / scale)))


def z_to_prob_sigmoid(z: Column, scale: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-z / max(scale, 1e-9)))


def rank_to_prob(c: str, by: Sequence[str]) -> Column:
    """A rank as a probability; percent where the group's largest exceeds 1.5."""
    top = F.max(f"`{c}`").over(Window.partitionBy(*by))
    x = F.col(f"`{c}`")
    return clip01(F.when(top > 1.5, x / 100).otherwise(x))


def is_z_like(name: str) -> bool:
    """Whether a feature's name says that it is a z-score."""
    low = name.lower()
    return low.endswith("_z") or any(mark in low for mark in ("_z/", ".z", "zscore"))


def is_rank(name: str) -> bool:
    return name.lower().startswith("cs.rank")


def soft_signal(columns: Sequence[str], prefix: str, by: Sequence[str], softness: float, threshold: float) -> Column:
    """Whether the smallest probability of the features of a family exceeds the threshold; false without a feature.

    Z-scores become probabilities by tanh, others by their rank.  Events use ``EV_``, 2 and 0.3; options ``opt.``, 1.5 and 0.4.
    """
    found = [c for c in columns if c.startswith(prefix) or prefix == "opt." and prefix in c.lower()]
    if not found:
        return F.lit(False)
    probs = [z_to_prob_tanh(F.col(f"`{c}`"), softness) if is_z_like(c) else rank_to_prob(c, by) for c in found]
    return F.coalesce(soft_and(*probs) > threshold, F.lit(False))


def soft_and(*probs: Column) -> Column:
    """Smallest probability; null if any is."""
    known = F.lit(True)
    for p in probs:
        known = known & p.isNotNull()
    return F.when(known, F.least(*probs) if len(probs) > 1 else probs[0])


def soft_or(*probs: Column) -> Column:
    known = F.lit(True)
    for p in probs:
        known = known & p.isNotNull()
    return F.when(known, F.greatest(*probs) if len(probs) > 1 else probs[0])


def compile_rules(features: DataFrame, gate: str | None = None) -> DataFrame:
    """(ticker, date, feature, rule) of the rows that fire.

    ``features``: ticker, date, feature, value, share, z.  One pass: each row lists the rules it
    passes, so nothing is joined.  ``gate`` is a boolean column; null is false.
    """
    rows = features if gate is None else features.where(F.coalesce(gate, F.lit(False)))
    fired = F.array_compact(F.array(*(F.when(F.expr(test), F.lit(name)) for name, _, test in RULES)))
    return rows.select("ticker", "date", "feature", F.explode(fired).alias("rule"))


def signal_ids(signals: DataFrame) -> DataFrame:
    """``SIG_00000`` ids in the order of feature and rule; the rule list is small."""
    keys = signals.select("feature", "rule").distinct()
    ids = keys.withColumn("k", F.row_number().over(Window.orderBy("feature", "rule")) - 1)
    return ids.select("feature", "rule", F.format_string("SIG_%05d", F.col("k")).alias("signal_id"))


def without_twins(signals: DataFrame) -> DataFrame:
    """(feature, rule) that stay: of rules of one feature that fire on the same rows the shortest named.

    Patterns are compared by order-free sums of two hashes and their count, so no pattern is gathered.
    """
    h = F.xxhash64("ticker", "date")
    marks = signals.groupBy("feature", "rule").agg(
        F.count("*").alias("n"),
        F.sum(h.cast("decimal(38,0)")).alias("a"),
        F.sum(F.xxhash64(F.lit(7), "ticker", "date").cast("decimal(38,0)")).alias("b"),
    )
    best = F.min(F.struct(F.length("rule").alias("l"), "rule")).alias("m")
    return marks.groupBy("feature", "n", "a", "b").agg(best).select("feature", "m.rule", "n")


def all_of(signals: DataFrame, setup: Sequence[str], by: Sequence[str] = ("ticker", "date"), name: str = "signal_id") -> DataFrame:
    """Rows on which every signal of the setup fires."""
    hits = signals.where(F.col(name).isin(list(setup))).select(*by, name).distinct()
    return hits.groupBy(*by).count().where(F.col("count") == len(set(setup))).select(*by)


def rising_edges(fired: DataFrame, by: Sequence[str], order: str, x: str, reset: int = 5) -> DataFrame:
    """Rows where x turns true, and again after each ``reset`` rows of one streak."""
    o = Window.partitionBy(*by).orderBy(order)
    on = F.coalesce(F.col(x), F.lit(False))
    turn = F.when(on & ~F.coalesce(F.lag(x).over(o), F.lit(False)), 1).otherwise(0)
    runs = fired.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(o))
    place = F.row_number().over(Window.partitionBy(*by, "_run").orderBy(order))
    return runs.withColumn("_k", place).where(on & ((F.col("_k") - 1) % reset == 0)).drop("_turn", "_run", "_k")


def fingerprint(ids: Column) -> Column:
    return F.concat_ws("&", F.array_sort(F.array_distinct(ids)))


def cooccurrence(flags: Sequence[Column], by: Sequence[str], order: str, n: int) -> Column:
    """Share of signals that fired within the last n rows."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - n, 0)
    total = F.lit(0)
    for f in flags:
        total = total + F.max(F.coalesce(f.cast("int"), F.lit(0))).over(w)
    return total / len(flags)

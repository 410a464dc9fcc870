"""Sets of days as bitmaps: how much signals tell about each other, without rows meeting rows.

A signal's days are 64-bit words, made in one aggregation with partial ones on the way.
Days that two signals share are counted by AND and bit counts, word by word; the
contingency table of a pair follows from these counts, each signal's own and the number
of days.  Pairs are those that setups hold, each counted once however many hold it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64


def bitmaps(fired: DataFrame, signal: Sequence[str], pos: str = "pos") -> DataFrame:
    """(signal, word, bits) of rows (signal, position of the day); repeated rows count once."""
    bit = F.expr(f"shiftleft(1L, cast(pmod({pos}, {BITS}) as int))")
    return fired.groupBy(*signal, F.expr(f"{pos} div {BITS}").alias("word")).agg(F.bit_or(bit).alias("bits"))


def setup_pairs(setups: DataFrame, signals: str = "signals") -> DataFrame:
    """(setup columns, a, b): the pairs of a setup's signals, in their order; none of a setup of one."""
    n = F.size(signals)
    firsts = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(F.slice(F.col(signals), i + 2, n), lambda b: F.struct(F.get(signals, i).alias("a"), b.alias("b"))))
    out = setups.where(n >= 2).withColumn("_p", F.explode(F.flatten(firsts)))
    return out.withColumns({"a": F.col("_p.a"), "b": F.col("_p.b")}).drop("_p", signals)


def shared_days(pairs: DataFrame, maps: DataFrame, signal: str = "signal") -> DataFrame:
    """(a, b, n_a, n_b, n_ab) of distinct pairs: days of each and of both."""
    own = maps.groupBy(signal).agg(F.sum(F.bit_count("bits")).alias("n"))
    side = lambda c, x: maps.select(F.col(signal).alias(c), "word", F.col("bits").alias(x))
    count = lambda c: own.select(F.col(signal).alias(c), F.col("n").alias(f"n_{c}"))
    both = pairs.join(side("a", "_x"), "a").join(side("b", "_y"), ["b", "word"]).groupBy("a", "b").agg(F.sum(F.bit_count(F.col("_x").bitwiseAND(F.col("_y")))).alias("n_ab"))
    out = pairs.join(both, ["a", "b"], "left").join(count("a"), "a", "left").join(count("b"), "b", "left")
    return out.select("a", "b", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_b", "n_ab")))


def mutual_information(n_a: Column, n_b: Column, n_ab: Column, days: Column) -> Column:
    """Mutual information (nats) of two signals of which n_a, n_b and both n_ab fire on that many days; null without days."""
    cells = [(n_ab, n_a, n_b), (n_a - n_ab, n_a, days - n_b), (n_b - n_ab, days - n_a, n_b), (days - n_a - n_b + n_ab, days - n_a, days - n_b)]
    terms = [F.when(n > 0, n / days * F.log(n * days / F.greatest(x * y, F.lit(1)))).otherwise(0.0) for n, x, y in cells]
    return F.when(days > 0, sum(terms, F.lit(0.0)))


def mean_information(setups: DataFrame, fired: DataFrame, days: int, by: Sequence[str], signal: str = "signal", signals: str = "signals", pos: str = "pos") -> DataFrame:
    """``by``, ``pairs`` and ``mean_mi``: the mean over the pairs of each setup's signals; setups of one signal have none.

    A signal that never fires is one too.  ``days`` is the calendar's length.
    """
    pairs = setup_pairs(setups.select(*by, signals), signals)
    counts = shared_days(pairs.select("a", "b").distinct(), bitmaps(fired, [signal], pos), signal)
    n = F.lit(days).cast("double")
    told = counts.select("a", "b", mutual_information(*(F.col(c).cast("double") for c in ("n_a", "n_b", "n_ab")), n).alias("mi"))
    return pairs.join(told, ["a", "b"]).groupBy(*by).agg(F.count("*").alias("pairs"), F.avg("mi").alias("mean_mi"))

"""Scores of banded probability forecasts, calibration of binary ones, and information measures.

A banded forecast has edges e_0 < ... < e_n and a probability for each band, spread evenly inside it.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_of(x: Column, edges: Sequence[float]) -> Column:
    """Band of a value, from 0; the last includes its right edge; outside null."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        inside = (x >= edges[k]) & ((x < edges[k + 1]) | ((k == len(edges) - 2) & (x == edges[k + 1])))
        out = F.when(inside, F.lit(k)).otherwise(out)
    return out


def histogram(rows: DataFrame, by: Sequence[str], x: str, edges: Sequence[float]) -> DataFrame:
    """Share of each band for each group, as an array; out-of-range values are left out."""
    banded = rows.withColumn("_b", band_of(F.col(x), edges)).where("_b is not null")
    counts = [F.sum((F.col("_b") == k).cast("double")).alias(f"c{k}") for k in range(len(edges) - 1)]
    g = banded.groupBy(*by).agg(*counts, F.count("*").alias("n"))
    return g.select(*by, "n", F.array(*(F.col(f"c{k}") / F.col("n") for k in range(len(edges) - 1))).alias("probs"))


def smoothed(probs: Column, eps: float = 1e-6) -> Column:
    raised = F.transform(probs, lambda p: p + eps)
    return F.transform(raised, lambda p: p / F.aggregate(raised, F.lit(0.0), lambda a, v: a + v))


def crps(probs: str, y: str, edges: Sequence[float]) -> Column:
    """Integral over the edges of (F - 1[y <= z])^2 for the piecewise linear F; y is clipped to the edges."""
    total, below = F.lit(0.0), F.lit(0.0)
    v = F.least(F.greatest(F.col(y), F.lit(float(edges[0]))), F.lit(float(edges[-1])))
    cube = lambda c: c * c * c
    for k in range(len(edges) - 1):
        low, width = edges[k], edges[k + 1] - edges[k]
        p = F.element_at(F.col(probs), k + 1)
        cut = F.least(F.greatest((v - low) / width, F.lit(0.0)), F.lit(1.0))
        mid, top = below + p * cut, below + p
        first = F.when(p > 1e-12, (cube(mid) - cube(below)) / (3 * p)).otherwise(below * below * cut)
        second = F.when(p > 1e-12, (cube(mid - 1) - cube(top - 1)) / (-3 * p)).otherwise((below - 1) * (below - 1) * (1 - cut))
        total, below = total + width * (first + second), top
    return total


def quantile_from_bands(probs: str, edges: Sequence[float], q: float) -> Column:
    """Inverse of the piecewise linear distribution; the middle of a band without mass."""
    out, below = F.lit(float(edges[-1])), F.lit(0.0)
    steps = []
    for k in range(len(edges) - 1):
        p = F.element_at(F.col(probs), k + 1)
        inside = F.when(p > 1e-12, edges[k] + (q - below) / p * (edges[k + 1] - edges[k])).otherwise((edges[k] + edges[k + 1]) / 2)
        steps.append((below + p >= q - 1e-12, inside))
        below = below + p
    for test, value in reversed(steps):
        out = F.when(test, value).otherwise(out)
    return out


def pinball(y: Column, q_value: Column, q: float, textbook: bool = False) -> Column:
    """Quantile loss; by default with the weights of both sides exchanged, as the scored system has them."""
    over, under = (q, 1 - q) if textbook else (1 - q, q)
    return F.when(y >= q_value, over * (y - q_value)).otherwise(under * (q_value - y))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def entropy(probs: Column, base: float | None = None, eps: float = 1e-12) -> Column:
    h = -array_sum(F.transform(probs, lambda p: F.greatest(p, F.lit(eps)) * F.log(F.greatest(p, F.lit(eps)))))
    return h / log(base) if base else h


def kl(p: Column, q: Column, eps: float = 1e-12) -> Column:
    terms = F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.log(a / F.greatest(b, F.lit(eps)))).otherwise(0.0))
    return array_sum(terms)


def calibration_mae(p: Column, observed: Column) -> Column:
    return array_sum(F.zip_with(p, observed, lambda a, b: F.abs(a - b))) / F.size(p)


def wasserstein(p: Column, observed: Column, edges: Sequence[float]) -> Column:
    """Sum over right edges of the distance of both distributions times the width."""
    total, gap = F.lit(0.0), F.lit(0.0)
    for k in range(len(edges) - 1):
        gap = gap + F.element_at(p, k + 1) - F.element_at(observed, k + 1)
        total = total + F.abs(gap) * (edges[k + 1] - edges[k])
    return total


# binary forecasts


def reliability(rows: DataFrame, y: str, p: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Of each bin of equal width: count, mean forecast, and the share of ones, smoothed by half a case on each side."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    g = rows.withColumn("bin", b).groupBy(*by, "bin").agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_pred"), F.avg(F.col(y).cast("double")).alias("observed"),
        ((F.sum(F.col(y).cast("double")) + 0.5) / (F.count("*") + 1)).alias("smoothed"),
    )
    return g


def calibration(rows: DataFrame, y: str, p: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Expected and largest calibration error, Brier score and log loss."""
    gap = F.abs(F.col("smoothed") - F.col("mean_pred"))
    errors = reliability(rows, y, p, bins, by).groupBy(*by).agg(
        (F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce")
    )
    t, c = F.col(y).cast("double"), F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1 - 1e-12))
    losses = rows.groupBy(*by).agg(
        F.avg((F.col(p) - t) * (F.col(p) - t)).alias("brier"), (-F.avg(t * F.log(c) + (1 - t) * F.log(1 - c))).alias("log_loss")
    )
    return errors.join(losses, list(by)) if by else errors.crossJoin(losses)


def ks_uniform(rows: DataFrame, x: str, by: Sequence[str]) -> DataFrame:
    """Kolmogorov-Smirnov distance of values in [0, 1] to the uniform distribution.

    Ranks are those within one of 1,024 equal steps and the count of the steps below, so no group is one task's.
    """
    w = Window.partitionBy(*by)
    stepped = rows.withColumn("_b", F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 1024))
    steps = stepped.groupBy(*by, "_b").agg(F.count("*").alias("_m"))
    below = F.coalesce(F.sum("_m").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = steps.select(*by, "_b", below.alias("_below"), F.sum("_m").over(w).alias("_n"))
    within = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(x))
    ranked = stepped.join(steps, [*by, "_b"]).withColumn("_k", F.col("_below") + within)
    away = F.greatest(F.col("_k") / F.col("_n") - F.col(x), F.col(x) - (F.col("_k") - 1) / F.col("_n"))
    return ranked.groupBy(*by).agg(F.max(away).alias("ks"), F.count("*").alias("n"))


# information between two columns


def mutual_information(rows: DataFrame, by: Sequence[str], x: str, y: str, bins: int = 16) -> DataFrame:
    """Mutual information (nats) of a bins x bins histogram with one case added to each cell."""
    w = Window.partitionBy(*by)

    def cell(c: str) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        at = F.when(high > low, F.floor((F.col(c) - low) / (high - low) * bins)).otherwise(0)
        return F.least(at, F.lit(bins - 1)).cast("int")

    seen = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"a": cell(x), "b": cell(y)})
    counts = seen.groupBy(*by, "a", "b").agg(F.count("*").alias("k"))
    grid = counts.select(*by).distinct().withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    grid = grid.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(counts, [*by, "a", "b"], "left").withColumn("k", F.coalesce("k", F.lit(0)) + 1)
    total = F.sum("k").over(w)
    pa, pb = F.sum("k").over(Window.partitionBy(*by, "a")) / total, F.sum("k").over(Window.partitionBy(*by, "b")) / total
    parts = full.withColumns({"p": F.col("k") / total, "pa": pa, "pb": pb})
    return parts.groupBy(*by).agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("pa") * F.col("pb")))).alias("mi"))


def transfer_entropy(rows: DataFrame, by: Sequence[str], order: str, x: str, y: str, bins: int = 4) -> DataFrame:
    """Transfer entropy (bits) from x to y at lag 1 over a bins^3 histogram with one case added to each cell."""
    w, o = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(order)

    def cell(c: str) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.least(F.when(high > low, F.floor((F.col(c) - low) / (high - low) * bins)).otherwise(0), F.lit(bins - 1)).cast("int")

    paired = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"xb": cell(x), "yb": cell(y)})
    seen = paired.withColumns({"now": F.col("yb"), "was": F.lag("yb").over(o), "src": F.lag("xb").over(o)}).where("was is not null")
    counts = seen.groupBy(*by, "now", "was", "src").agg(F.count("*").alias("k"))
    grid = counts.select(*by).distinct()
    for c in ("now", "was", "src"):
        grid = grid.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(counts, [*by, "now", "was", "src"], "left").withColumn("k", F.coalesce("k", F.lit(0)) + 1)
    over = lambda *c: F.sum("k").over(Window.partitionBy(*by, *c))
    parts = full.withColumns({"n": over(), "ws": over("was", "src"), "nw": over("now", "was"), "ww": over("was")})
    term = F.col("k") / F.col("n") * F.log2(F.col("k") * F.col("ww") / (F.col("ws") * F.col("nw")))
    return parts.groupBy(*by).agg(F.sum(term).alias("te"))


# readings of a banded forecast


def mass_between(probs: str, edges: Sequence[float], low: float, high: float) -> Column:
    """Probability of the bands that lie inside [low, high]."""
    total = F.lit(0.0)
    for k in range(len(edges) - 1):
        if edges[k] >= low - 1e-12 and edges[k + 1] <= high + 1e-12:
            total = total + F.element_at(F.col(probs), k + 1)
    return total


def trade_fields(probs: str, edges: Sequence[float]) -> dict[str, Column]:
    """Expected move (band middles) and probabilities of a rise and a fall; a band across 0 is split at 0."""
    move, up = F.lit(0.0), F.lit(0.0)
    for k in range(len(edges) - 1):
        low, high, p = edges[k], edges[k + 1], F.element_at(F.col(probs), k + 1)
        move = move + p * ((low + high) / 2)
        up = up + p * min(max(high / (high - low), 0.0), 1.0)
    return {"expected_move": move, "p_up": up, "p_down": array_sum(F.col(probs)) - up}


def conditional_entropy(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Entropy (nats) of y given x, both categorical."""
    w = Window.partitionBy(*by)
    cells = rows.groupBy(*by, x, y).agg(F.count("*").alias("k"))
    parts = cells.withColumns({"n": F.sum("k").over(w), "kx": F.sum("k").over(Window.partitionBy(*by, x))})
    return parts.groupBy(*by).agg((-F.sum(F.col("k") / F.col("n") * F.log(F.col("k") / F.col("kx")))).alias("conditional_entropy"))


def skill(score: Column, baseline: Column) -> Column:
    """How much lower a score is than the baseline's; positive is better."""
    return baseline - score

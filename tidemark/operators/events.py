"""Economic releases: surprises, per-event history, daily composites, forward calendar, decay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EASTERN = "America/New_York"


def parse_relevance(c: Column) -> Column:
    """A percentage, a number, or a word."""
    # Words for relevance.
    text = F.lower(F.trim(c.cast("string")))
    word = F.when(text == "high", 90.0).when(text.isin("medium", "med"), 60.0).when(text == "low", 30.0)
    return F.coalesce(word, F.regexp_replace(text, "%", "").try_cast("double"))


def eastern_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, EASTERN))


def category(name: Column, exact: dict[str, str], patterns: Sequence[tuple[str, str]], other: str = "other") -> Column:
    """Category by exact name, else by the first pattern found in it, ignoring case."""
    out = F.lit(other)
    for pattern, label in reversed(patterns):
        out = F.when(name.rlike(f"(?i){pattern}"), label).otherwise(out)
    if exact:
        table = F.create_map(*(F.lit(x) for pair in exact.items() for x in pair))
        out = F.coalesce(F.try_element_at(table, name), out)
    return out


def contains_any(name: Column, words: Sequence[str]) -> Column:
    low, out = F.lower(name), F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return out


def merged(tables: Sequence[DataFrame], key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union of release tables with one row for each key, the first by ``order``."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(*order)
    return out.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def surprises(releases: DataFrame, history: int = 12) -> DataFrame:
    """Weight, surprise, its z-score and percentile among the event's last releases, tail flag.

    The z-score uses the population deviation and three values at least.
    """
    w = Window.partitionBy("event").orderBy("release_ts", "event_id").rowsBetween(1 - history, 0)
    out = releases.withColumns(
        {
            "weight": F.sqrt(F.least(F.greatest(F.coalesce("relevance", F.lit(70.0)), F.lit(0.0)), F.lit(100.0))),
            "surprise": F.col("actual") - F.col("survey"),
        }
    )
    n, mu, sd = F.count("surprise").over(w), F.avg("surprise").over(w), F.stddev_pop("surprise").over(w)
    seen = F.collect_list("surprise").over(w)
    out = out.withColumns({"_n": n, "_mu": mu, "_sd": sd, "_seen": seen})
    x = F.col("surprise")
    z = F.when((F.col("_n") >= 3) & (F.col("_sd") > 1e-12), (x - F.col("_mu")) / F.col("_sd"))
    below = F.size(F.filter("_seen", lambda v: v < x)) + (F.size(F.filter("_seen", lambda v: v == x)) + 1) / 2
    pct = F.when((F.col("_n") >= 3) & x.isNotNull(), below / F.col("_n"))
    return out.withColumns({"z": z, "pct": pct, "tail": F.coalesce(F.abs(z) > 1.5, F.lit(False))}).drop("_n", "_mu", "_sd", "_seen")


def weighted_mean(x: Column, w: Column, where: Column | None = None) -> Column:
    """Mean of x by w over rows that have both and w > 0."""
    ok = x.isNotNull() & (w > 0) if where is None else x.isNotNull() & (w > 0) & where
    return F.sum(F.when(ok, x * w)) / F.sum(F.when(ok, w))


def daily(rows: DataFrame, buckets: Sequence[str]) -> DataFrame:
    """Composites of a release day in one aggregation: counts, weighted means, spread, tails, event buckets."""
    z, w = F.col("z"), F.col("weight")
    aggs = [
        F.count("*").alias("n"),
        F.sum("weight").alias("weight_sum"),
        weighted_mean(z, w).alias("z_mean"),
        weighted_mean(F.col("pct"), w).alias("pct_mean"),
        F.stddev_pop("z").alias("z_std"),
        F.avg(F.col("tail").cast("double")).alias("tail_share"),
        (F.max("weight") / F.sum("weight")).alias("top_weight"),
        F.abs(F.sum(F.signum("z"))).alias("agreement"),
        *(weighted_mean(z, w, F.col("event") == b).alias(f"bucket_{b}") for b in buckets),
    ]
    return rows.groupBy("release_date").agg(*aggs)


def divergence(a: Column, b: Column) -> Column:
    """1 where two buckets' means point the same way, -1 where they don't, 0 where one is missing or zero."""
    return F.signum(F.coalesce(F.signum(a), F.lit(0.0)) * F.coalesce(F.signum(b), F.lit(0.0)))


def bundle(rows: DataFrame, inflation: str, growth: str, tail: float = 2.0) -> DataFrame:
    """Event columns of every calendar day from the first release to the last: heat, known before the day, and composites.

    The composites (mean surprise, inflation and growth buckets, divergence, trailing tail share) are those of the
    day's own releases, moved one row on; days without releases have none, but for the trailing share.
    """
    z, w = F.col("z"), F.col("weight")
    own = rows.groupBy("release_date").agg(
        F.sum("weight").alias("weight_sum"), weighted_mean(z, w).alias("ev_z"), weighted_mean(z, w, F.col("event") == inflation).alias("ev_inflation"),
        weighted_mean(z, w, F.col("event") == growth).alias("ev_growth"), F.avg(F.coalesce(F.abs(z) >= tail, F.lit(False)).cast("double")).alias("_tail"),
    ).withColumn("ev_divergence", divergence(F.col("ev_inflation"), F.col("ev_growth")))
    o = Window.orderBy("release_date")
    last = o.rowsBetween(-20, 0)
    full = spine(own).join(own, "release_date", "left")
    full = full.withColumns(
        {
            "ev_heat_3": F.sum(F.coalesce("weight_sum", F.lit(0.0))).over(o.rowsBetween(-2, 0)),
            "ev_tail_21": F.when(F.count("_tail").over(last) >= 5, F.avg("_tail").over(last)),
        }
    )
    realised = ["ev_z", "ev_inflation", "ev_growth", "ev_divergence", "ev_tail_21"]
    return lagged(full.select("release_date", "ev_heat_3", *realised), realised)


def spine(days: DataFrame, day: str = "release_date") -> DataFrame:
    """Every calendar day from the first to the last."""
    span = days.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias(day))


def heat(day_rows: DataFrame, windows: Sequence[int] = (1, 3, 5, 10), quiet: float = 5.0) -> DataFrame:
    """Sums of the day's weight over trailing calendar days, and flags of little to come."""
    full = spine(day_rows).join(day_rows.select("release_date", "weight_sum"), "release_date", "left")
    x = F.coalesce("weight_sum", F.lit(0.0))
    o = Window.orderBy("release_date")
    sums = {f"heat_{n}": F.sum(x).over(o.rowsBetween(1 - n, 0)) for n in windows}
    flags = {f"vacuum_{n}": (F.sum(x).over(o.rowsBetween(1 - n, 0)) <= quiet).cast("int") for n in windows if n >= 5}
    return full.select("release_date", *(c.alias(n) for n, c in (sums | flags).items()))


def since_tail(day_rows: DataFrame, share: float = 0.3) -> DataFrame:
    """Rows since the last day whose tail share reached ``share``; null before the first."""
    o = Window.orderBy("release_date")
    hit = F.when(F.col("tail_share") >= share, F.col("_k"))
    rows = day_rows.withColumn("_k", F.row_number().over(o))
    return rows.select("release_date", (F.col("_k") - F.last(hit, ignorenulls=True).over(o)).alias("rows_since_tail"))


def lagged(day_rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named realised columns moved one row on, so that a day shows what was known before it."""
    o = Window.orderBy("release_date")
    return day_rows.select(*(F.lag(c).over(o).alias(c) if c in columns else F.col(c) for c in day_rows.columns))


def decayed(day_rows: DataFrame, columns: Sequence[str], halflives: Sequence[float] = (10.5, 21, 63), means: Sequence[int] = (3, 5, 10, 21)) -> DataFrame:
    """Exponential means and trailing means (two values at least) of each column."""
    from tidemark.functions.series import Series
    from tidemark.operators import rolling as R

    s = Series((), "release_date")
    out = {}
    for c in columns:
        for h in halflives:
            out[f"{c}_hl{str(h).replace('.', 'p')}"] = R.ewma_recursive(s, c, h)
        for n in means:
            out[f"{c}_ma{n}"] = R.mean(s, c, n, 2)
    return s.spark(day_rows, ["release_date"], out, None)


def pre_event_days(days: DataFrame, events: DataFrame, weekdays: Sequence[int], day: str = "date") -> DataFrame:
    """Days among the five before an event that fall on the given weekdays (0 is Monday)."""
    near = events.select(F.explode(F.sequence(F.date_sub(day, 5), F.date_sub(day, 1))).alias("_d")).distinct()
    hit = near.where(F.weekday("_d").isin(list(weekdays)))
    return days.join(hit, days[day] == hit["_d"], "left").select(*days.columns, F.col("_d").isNotNull().alias("pre_event"))


def weeks_with_both(a: DataFrame, b: DataFrame, day: str = "date") -> DataFrame:
    """Monday of each week in which ``a`` has a Thursday and ``b`` a Friday."""
    week = lambda t, wd: t.where(F.weekday(day) == wd).select(F.date_trunc("week", day).cast("date").alias("week")).distinct()
    return week(a, 3).join(week(b, 4), "week", "left_semi")

"""Joins over time: as-of in both directions, intervals, ranges, calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, value: str, keep_null: bool = False
) -> DataFrame:
    """``left`` with ``value`` as of its time: both sides' distinct keys and times are carried along in one order.

    A row of ``right`` at exactly the time decides, even if its value is null.  Where there is
    none, the last earlier row counts: the last with a value, or with ``keep_null`` the last at all.
    ``right`` has one row for each key and time.  However many rows of ``left`` share a key, a task
    orders only its distinct times; the rows take their values by equality.  A null key or time has none.
    """
    key = list(on)
    wanted = left.select(*key, F.col(left_time).alias("_t")).distinct()
    l = wanted.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})  # noqa: E741
    r = right.select(*key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    w = Window.partitionBy(*key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    row = F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))
    last_row = F.last(row, ignorenulls=True).over(w)
    last_value = F.last("_v", ignorenulls=True).over(w)
    exact = last_row["t"] == F.col("_t")
    picked = last_row["v"] if keep_null else F.when(exact, last_row["v"]).otherwise(last_value)
    found = l.unionByName(r).withColumn("_p", picked).where("_side = 1").select(*(F.col(c).alias(f"_{k}") for k, c in enumerate(key)), "_t", "_p")
    same = [left[c] == found[f"_{k}"] for k, c in enumerate(key)] + [left[left_time] == found["_t"]]
    return left.join(found, same, "left").select(*(left[c] for c in left.columns), F.col("_p").alias(value))


def snap_forward(left: DataFrame, calendar: DataFrame, time: str, day: str = "date") -> DataFrame:
    """``left`` with ``snapped``, the first calendar day on or after its time; rows beyond the end go.

    The one window without partitions runs over distinct days only, so it stays small.
    """
    days = calendar.select(F.col(day).alias("_day")).distinct()
    wanted = left.select(F.col(time).alias("_t")).distinct()
    both = wanted.select("_t", F.lit(None).cast("date").alias("_day")).unionByName(days.select(F.col("_day").alias("_t"), "_day"))
    w = Window.orderBy("_t", F.col("_day").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    snapped = both.withColumn("snapped", F.min("_day").over(w)).where("_day is null").select("_t", "snapped")
    return left.join(snapped, left[time] == snapped["_t"]).drop("_t").where("snapped is not null")


def positions(calendar: DataFrame, day: str = "date") -> DataFrame:
    """(date, pos) of the distinct days; a calendar is small, so one window over it is bounded."""
    return calendar.select(day).distinct().withColumn("pos", F.row_number().over(Window.orderBy(day)))


def label_pairs(triggers: DataFrame, calendar: DataFrame, horizon: int, time: str = "t0") -> DataFrame:
    """``triggers`` on calendar days with ``t1``, the day ``horizon`` positions on."""
    p = positions(calendar)
    start = triggers.join(p.withColumnRenamed("date", time), time)
    end = p.select(F.col("date").alias("t1"), (F.col("pos") - horizon).alias("pos"))
    return start.join(end, "pos").drop("pos")


def members(rows: DataFrame, folds: DataFrame, time: str, low: str, high: str) -> DataFrame:
    """Rows with each fold whose interval [low, high] of days holds theirs: folds are spread over their days, so the join is an equality."""
    spread = folds.where(F.col(low) <= F.col(high)).withColumn("_day", F.explode(F.sequence(low, high)))
    return rows.join(spread, F.to_date(time) == F.col("_day")).drop("_day")


def last_before(a: DataFrame, b: DataFrame, days: int, a_date: str, b_date: str, value: str) -> DataFrame:
    """For each day of ``b`` the last row of ``a`` in the ``days`` before it: (b_date, a_date, a value, b value).

    The range join is an equi-join on each day's bucket and the next, checked afterwards.
    """
    bucket = lambda c: F.floor(F.unix_date(c) / days)
    left = b.select(F.col(b_date).alias("b_date"), F.col(value).alias("b_value"))
    left = left.withColumn("k", F.explode(F.array(bucket(F.col("b_date")), bucket(F.col("b_date")) - 1)))
    right = a.select(F.col(a_date).alias("a_date"), F.col(value).alias("a_value")).withColumn("k", bucket(F.col("a_date")))
    near = left.join(right, "k").where((F.col("a_date") < F.col("b_date")) & (F.col("a_date") >= F.date_sub("b_date", days)))
    best = near.groupBy("b_date", "b_value").agg(F.max(F.struct("a_date", "a_value")).alias("m"))
    return best.select("b_date", "m.a_date", "m.a_value", "b_value")


def agreement(a: Column, b: Column) -> Column:
    """1 where both have one sign, -1 where signs differ, 0 if either is 0."""
    return (F.signum(a) * F.signum(b)).cast("int")


def days_to_next(rows: DataFrame, is_event: Column, day: str = "date") -> DataFrame:
    """``days_to`` the next day with an event, 0 on it, null after the last."""
    ahead = Window.orderBy(day).rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("days_to", F.datediff(F.min(F.when(is_event, F.col(day))).over(ahead), F.col(day)))


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def weekdays_between(a: Column, b: Column) -> Column:
    """Monday to Friday days from a to b, both included; 0 if b is before a."""
    since = lambda d: F.unix_date(d) + 3  # days since a Monday
    count = lambda d: F.floor(since(d) / 7) * 5 + F.least(F.pmod(since(d), F.lit(7)), F.lit(5))
    return F.when(b >= a, count(F.date_add(b, 1)) - count(a)).otherwise(0).cast("int")


def add_weekdays(day: Column, n: int) -> Column:
    """The n-th weekday after a day; from a weekend it counts from the Friday before."""
    wd = F.least(F.weekday(day), F.lit(4))
    friday = F.date_sub(day, F.weekday(day) - wd)
    total = wd + n
    return F.date_add(F.date_sub(friday, wd), (F.floor(total / 5) * 7 + total % 5).cast("int"))

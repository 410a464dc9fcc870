"""Walk-forward folds over a trading calendar, with purge and embargo.

Fold bounds are few; they are planned on the driver from the calendar's day list
and used as interval joins.  Positions count trading days from 0.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import members

MONTH = 21


@dataclass(frozen=True)
class Fold:
    number: int
    train_start: date
    train_end: date
    test_start: date
    test_end: date
    purge_days: int
    embargo_days: int
    is_tail: bool
    split_id: str

    def __post_init__(self) -> None:
        if not self.train_start <= self.train_end < self.test_start <= self.test_end:
            raise ValueError("fold bounds are out of order")


def split_id(test_start: date, horizon: int, lookback: int, purge: int, embargo: int, regime: str = "R0") -> str:
    return f"PAWF_v1|OUTER:{test_start:%Y%m}|H:{horizon}|E:{lookback}|P:{purge}|EMB:{embargo}|REG:{regime}"


def parse_split_id(text: str) -> dict[str, str]:
    return dict(p.split(":", 1) for p in text.split("|")[1:])


def anchored_folds(
    days: Sequence[date], horizon: int, lookback: int, min_train_months: int = 12, test_days: int = 63,
    step_months: int = 3, embargo_cap: int = 21, least_test: int = 5,
) -> list[Fold]:
    """Folds that all train from the first day; the horizon's rows before each test are purged.

    The last fold ends on the last day, with a shorter test if need be.
    """
    n, embargo = len(days), max(5, min(lookback, embargo_cap))
    at, out = MONTH * min_train_months + horizon, []
    while at + least_test <= n:
        end = min(at + test_days, n)
        tail = end == n
        out.append(
            Fold(len(out), days[0], days[at - horizon - 1], days[at], days[end - 1], horizon, embargo, tail,
                 split_id(days[at], horizon, lookback, horizon, embargo))
        )
        if tail:
            break
        at += MONTH * step_months
    return out


def plus_months(day: date, months: int) -> date:
    """The same day of a month that many months later, or that month's last day."""
    k = day.year * 12 + day.month - 1 + months
    first, after = date(k // 12, k % 12 + 1, 1), date((k + 1) // 12, (k + 1) % 12 + 1, 1)
    return min(first + timedelta(day.day - 1), after - timedelta(1))


@dataclass(frozen=True)
class OuterFold(Fold):
    """A fold with the positions of its bounds, and what became of its buffers (None: as asked for)."""

    train_last: int = 0
    test_first: int = 0
    test_last: int = 0
    embargo_from: int | None = None
    purge_from: int | None = None
    appended: bool = False


def outer_folds(
    days: Sequence[date], horizon: int, lookback: int, min_train_months: int = 36, test_days: int = 21, step_months: int = 1,
    embargo_cap: int = 21, least_test: int = 5, regime: str = "R1",
) -> list[OuterFold]:
    """Anchored folds whose tests start a calendar month step apart, up to the last day.

    The fold that ends on the last day gives up as much of its embargo, and of its purge if the horizon still fits, as
    leaves ``least_test`` test days beyond them; what was asked for is noted.  If no fold ends there, one more is appended.
    Too short a calendar raises ValueError.
    """
    days = sorted(set(days))
    if not days:
        raise ValueError("no trading days")
    n, least_train = len(days), min_train_months * MONTH
    at = bisect_left(days, plus_months(days[0], min_train_months))
    if at >= n:
        raise ValueError(f"Insufficient data: need at least {min_train_months} months")
    out: list[OuterFold] = []

    def add(first: int, last: int, appended: bool = False) -> bool:
        size = last - first + 1
        if size < least_test:
            return False
        purge = min(max(horizon, 0), first)
        embargo = max(5, min(lookback, embargo_cap))
        embargo = embargo if embargo < size else max(0, size - 1)
        tail, room = last == n - 1, max(0, size - least_test)
        embargo_from = embargo if tail and embargo > room else None
        purge_from = purge if tail and purge > room >= horizon else None
        embargo = room if embargo_from is not None else embargo
        purge = room if purge_from is not None else purge
        end = max(0, first - purge - 1)
        if end + 1 < least_train or end <= 0:
            return False
        out.append(
            OuterFold(len(out), days[0], days[end], days[first], days[last], purge, embargo, tail, split_id(days[first], horizon, lookback, purge, embargo, regime),
                      end, first, last, embargo_from, purge_from, appended)
        )
        return True

    while at < n:
        first, last = at, min(at + test_days - 1, n - 1)
        if last == n - 1 and last - first + 1 < least_test:
            first = max(0, n - least_test)
        add(first, last)
        if out and out[-1].is_tail:
            break
        at = max(bisect_left(days, plus_months(days[first], step_months)), at + 1)
    if not out:
        raise ValueError(f"No valid splits: {min_train_months} months of training don't fit")
    if not out[-1].is_tail and not add(max(0, n - max(test_days, least_test)), n - 1, True):
        raise ValueError("no tail split reaches the last day")
    return out


def nested_folds(days: Sequence[date], k: int, test_days: int = 21, least_train: int = 252, gap: int = 0, fewest: int = 2) -> list[tuple[date, date, date, date]]:
    """(train start, train end, test start, test end) by calendar days; k falls until ``fewest`` fit."""
    first, last = days[0], days[-1]
    for count in range(k, fewest - 1, -1):
        starts = [last - timedelta(test_days * (count - j) - 1) for j in range(count)]
        if (starts[0] - first).days >= least_train + gap:
            return [(first, s - timedelta(gap + 1), s, s + timedelta(test_days - 1)) for s in starts]
    return []


def rolling_folds(days: Sequence[date], train: int, test: int, step: int, embargo: int = 0) -> list[tuple[date, date, date, date]]:
    """Windows of fixed train and test rows that move by ``step`` rows."""
    out, at = [], 0
    while at + train + embargo + test <= len(days):
        t = at + train + embargo
        out.append((days[at], days[at + train - 1], days[t], days[t + test - 1]))
        at += step
    return out


def as_table(spark: SparkSession, folds: Sequence[Fold]) -> DataFrame:
    schema = (
        "number int, train_start date, train_end date, test_start date, test_end date, purge_days int, embargo_days int,"
        " is_tail boolean, split_id string"
    )
    return spark.createDataFrame([tuple(asdict(f).values()) for f in folds], schema)


def calendar_holdouts(days: DataFrame, day: str = "date") -> DataFrame:
    """(date, holdout): weekday groups, and the last three trading days of each month or not."""
    w = Window.partitionBy(F.year(day), F.month(day)).orderBy(F.desc(day))
    late = F.row_number().over(w) <= 3
    wd = F.weekday(day)
    kind = F.when(wd == 0, "monday").when(wd == 4, "friday").when(wd.between(1, 3), "midweek")
    rows = days.select(day, F.array(kind, F.when(late, "month_end").otherwise("non_month_end")).alias("h"))
    return rows.select(day, F.explode(F.array_compact("h")).alias("holdout"))


def horizon_holdouts(days: DataFrame, horizons: Sequence[int] = (1, 5, 21)) -> DataFrame:
    """Every day once for each horizon; the evaluation enforces the horizon."""
    return days.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))


def extended(folds: Sequence[tuple[date, date, date, date]], days: Sequence[date], as_of: date | None = None) -> list[tuple[date, date, date, date]]:
    """The folds with the last test window moved on to the last trading day up to ``as_of``; nothing is cut."""
    if not folds:
        return []
    *before, (a, b, c, d) = folds
    later = [x for x in days if d < x and (as_of is None or x <= as_of)]
    return [*before, (a, b, c, max(later, default=d))]


def fold_summary(spark: SparkSession, folds: Sequence[tuple[date, date, date, date]], days: DataFrame, day: str = "date") -> DataFrame:
    """Of each fold: first and last trading day of its windows, their numbers of days and spans."""
    table = spark.createDataFrame([(k, *f) for k, f in enumerate(folds)], "fold int, a date, b date, c date, d date")
    hits = members(days, table, day, "a", "d")
    out = []
    for name, low, high in (("train", "a", "b"), ("test", "c", "d")):
        x = F.when(F.col(day).between(F.col(low), F.col(high)), F.col(day))
        out += [F.min(x).alias(f"{name}_start"), F.max(x).alias(f"{name}_end"), F.count(x).alias(f"{name}_obs"), F.datediff(F.max(x), F.min(x)).alias(f"{name}_span_days")]
    return hits.groupBy("fold").agg(*out)

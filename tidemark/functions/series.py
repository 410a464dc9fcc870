"""Staged expressions over ordered series.

A rolling operator of a rolling operator needs two passes, as window functions
do not nest.  ``Series`` collects expressions as named stages: ``let`` gives an
expression a name, equal expressions get one, and each lands in the first stage
after those it refers to.  All stages share one partitioning and order, so Spark
plans one shuffle and one sort for any number of them.

Expressions are SQL text, as that is what windows are shortest in; the few
functions that differ between engines are methods, so the same definition also
prints as a chain of common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def num(x: float) -> str:
    """A double literal."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


#: Added before rounding, so that exact halves don't depend on a sum's last bit.
NUDGE = 3.1e-8


def rounding(sql: str, digits: int) -> str:
    """The value rounded, without negative zeros."""
    return f"round({sql} + {NUDGE!r}, {digits}) + 0e0"


class Series:
    """Stages over ``by``, ordered by ``order``."""

    def __init__(self, by: tuple[str, ...] = ("ticker",), order: str = "date", engine: str = "spark") -> None:
        self.by, self.order, self.engine = by, order, engine
        self.names: dict[str, str] = {}
        self.depth: dict[str, int] = {}
        self.stages: list[dict[str, str]] = []

    def let(self, sql: str) -> str:
        """Name of the stage column that holds ``sql``."""
        if re.fullmatch(r"\w+", sql):
            return sql
        if sql not in self.names:
            used = [self.depth[t] for t in re.findall(r"\b_t\d+\b", sql)]
            level = 1 + max(used, default=-1)
            name = f"_t{len(self.names)}"
            self.names[sql], self.depth[name] = name, level
            while len(self.stages) <= level:
                self.stages.append({})
            self.stages[level][name] = sql
        return self.names[sql]

    # windows

    def frame(self, low: int | None, high: int = 0) -> str:
        bound = lambda k: "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
        start = "UNBOUNDED PRECEDING" if low is None else bound(low)
        part = f"PARTITION BY {', '.join(self.by)} " if self.by else ""
        return f"OVER ({part}ORDER BY {self.order} ROWS BETWEEN {start} AND {bound(high)})"

    def row(self) -> str:
        part = f"PARTITION BY {', '.join(self.by)} " if self.by else ""
        return f"OVER ({part}ORDER BY {self.order})"

    def roll(self, agg: str, x: str, n: int, least: int | None = None) -> str:
        """``agg`` ({} is the value) over n rows, null below ``least`` values (all n by default)."""
        x = self.let(x)
        call = agg.format(x) if "{" in agg else f"{agg}({x})"
        w = self.frame(1 - n)
        return self.let(f"CASE WHEN count({x}) {w} >= {n if least is None else least} THEN {call} {w} END")

    def roll2(self, agg: str, y: str, x: str, n: int, least: int | None = None) -> str:
        """A two-variable aggregate over those of n rows that have both values."""
        y, x = self.let(y), self.let(x)
        w, need = self.frame(1 - n), n if least is None else least
        both = self.let(f"CASE WHEN {y} IS NOT NULL AND {x} IS NOT NULL THEN 1 END")
        return self.let(f"CASE WHEN count({both}) {w} >= {need} THEN {agg}({y}, {x}) {w} END")

    def lag(self, x: str, k: int = 1) -> str:
        name = "lag" if k >= 0 else "lead"
        return self.let(f"{name}({self.let(x)}, {abs(k)}) {self.row()}")

    def filled(self, x: str) -> str:
        """The last value so far that isn't null."""
        x = self.let(x)
        call = f"last({x}, true)" if self.engine == "spark" else f"last_value({x} IGNORE NULLS)"
        return self.let(f"{call} {self.frame(None)}")

    def quantile(self, x: str, q: float, n: int, least: int | None = None) -> str:
        name = "percentile" if self.engine == "spark" else "quantile_cont"
        return self.roll(f"{name}({{}}, {q})", x, n, least)

    def values(self, x: str, n: int) -> str:
        """The values of n rows as an array, without nulls."""
        x = self.let(x)
        if self.engine == "spark":
            return self.let(f"collect_list({x}) {self.frame(1 - n)}")
        return self.let(f"coalesce(list({x}) FILTER (WHERE {x} IS NOT NULL) {self.frame(1 - n)}, [])")

    def count_where(self, values: str, test: str) -> str:
        """How many array elements v pass ``test``."""
        if self.engine == "spark":
            return f"size(filter({values}, v -> {test}))"
        return f"len(list_filter({values}, lambda v: {test}))"

    def mean_where(self, values: str, test: str) -> str:
        if self.engine == "spark":
            some = f"filter({values}, v -> {test})"
            return f"CASE WHEN size({some}) > 0 THEN aggregate({some}, 0e0, (a, v) -> a + v) / size({some}) END"
        return f"list_avg(list_filter({values}, lambda v: {test}))"

    def skew(self, x: str, n: int) -> str:
        if self.engine != "spark":
            return self.roll("skewness", x, n)
        g = self.roll("skewness", x, n)
        return self.let(f"{g} * sqrt({n * (n - 1)}e0) / {n - 2}")

    def kurt(self, x: str, n: int) -> str:
        if self.engine != "spark":
            return self.roll("kurtosis", x, n)
        g = self.roll("kurtosis", x, n)
        return self.let(f"{n - 1}e0 / {(n - 2) * (n - 3)} * ({n + 1} * {g} + 6)")

    # results

    def spark(self, df: DataFrame, keep: Iterable[str], out: dict[str, str], digits: int | None = None) -> DataFrame:
        for stage in self.stages:
            df = df.withColumns({n: F.expr(sql) for n, sql in stage.items()})
        shown = {n: sql if digits is None else rounding(sql, digits) for n, sql in out.items()}
        return df.select(*keep, *(F.expr(sql).alias(n.replace(".", "_")) for n, sql in shown.items()))

    def text(self, base: str, keep: Iterable[str], out: dict[str, str], digits: int | None = None) -> str:
        parts = [f"s0 AS ({base})"]
        for k, stage in enumerate(self.stages):
            parts.append(f"s{k + 1} AS (SELECT *, {', '.join(f'{sql} AS {n}' for n, sql in stage.items())} FROM s{k})")
        shown = {n: sql if digits is None else rounding(sql, digits) for n, sql in out.items()}
        columns = [*keep, *(f"{sql} AS {n.replace('.', '_')}" for n, sql in shown.items())]
        return f"WITH {', '.join(parts)} SELECT {', '.join(columns)} FROM s{len(self.stages)}"

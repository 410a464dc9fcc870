"""What is shown of forecasts and books: slates with trade-ready fields, open positions at a day's end, a selection's summary."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from math import isclose

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.selection import top_k

# The edge that stands for an open end, and the move that an open band counts with.
OPEN, TAIL = 999.0, 0.12


def trade_ready(probs: str, edges: Sequence[float], tail: float = TAIL) -> dict[str, Column]:
    """Expected move and masses of a banded forecast; null where its length doesn't fit the edges.

    Open bands count with ``tail``.  A band across 0 is split at 0; one that only touches 0 is neither up nor down.
    """
    bands = list(zip(edges, edges[1:]))
    fits = F.size(probs) == len(bands)
    p = [F.get(probs, F.lit(k)) for k in range(len(bands))]

    def total(weights: Sequence[float]) -> Column:
        return F.when(fits, sum((w * x for w, x in zip(weights, p) if w), F.lit(0.0)))

    middle = [-tail if isclose(a, -OPEN) else tail if isclose(b, OPEN) else (a + b) / 2 for a, b in bands]
    mass = lambda test: total([float(test(a, b)) for a, b in bands])
    cross = next(((a, b) for a, b in bands if a < 0 < b), None)
    share = lambda a, b: cross[1] / (cross[1] - cross[0]) if (a, b) == cross else 0.0
    return {
        "expected_move": total(middle),
        "p_up": total([1.0 if a > 0 else share(a, b) for a, b in bands]),
        "p_down": total([1.0 if b < 0 else (1 - share(a, b) if (a, b) == cross else 0.0) for a, b in bands]),
        "p_3_to_5": mass(lambda a, b: isclose(a, 0.03) and isclose(b, 0.05)),
        "p_above_5": mass(lambda a, b: a >= 0.05),
        "p_minus_5_to_3": mass(lambda a, b: isclose(a, -0.05) and isclose(b, -0.03)),
        "p_below_5": mass(lambda a, b: b <= -0.05),
    }


def slate(rows: DataFrame, probs: str, edges: Sequence[float], rank: str, key: str, per_ticker: int, top: int, ticker: str = "ticker") -> DataFrame:
    """The ``top`` rows by ``rank`` of the ``per_ticker`` best of each ticker, with their trade-ready fields; ties go by ``key``.  No limit where one is 0.

    A forecast without probabilities has equal ones.
    """
    n = len(edges) - 1
    whole = rows.withColumn(probs, F.coalesce(probs, F.array(*[F.lit(1.0 / n)] * n)))
    order = [F.col(rank).desc_nulls_last(), F.col(key)]
    best = top_k(whole, [ticker], order, per_ticker) if per_ticker > 0 else whole
    best = best.orderBy(*order, ticker).limit(top) if top > 0 else best
    return best.withColumns(trade_ready(probs, edges))


def open_at_end(ledger: DataFrame, end: date, as_of: date, days: int = 30, mark: str | None = None) -> DataFrame:
    """The ledger with trades open at ``end`` marked: status, reason, days held and unrealised profit; their exits go.

    Open are those triggered within ``days`` before ``as_of`` that have no exit, or one after ``end``.  ``mark`` is the
    column of the last price; short positions gain as it falls.
    """
    is_open = F.coalesce((F.col("trigger_date") >= F.date_sub(F.lit(as_of), days)) & (F.col("exit_date").isNull() | (F.col("exit_date") > F.lit(end))), F.lit(False))
    side = F.when(F.upper(F.coalesce("direction", F.lit(""))).contains("SHORT"), -1.0).otherwise(1.0)
    gain = (F.col(mark) - F.col("entry_price")) * F.coalesce("contracts", F.lit(0)) * side if mark else F.lit(None).cast("double")
    gone = lambda c: F.when(~is_open, F.col(c))
    return ledger.withColumn("_open", is_open).withColumns(
        {
            "status": F.when(F.col("_open"), "OPEN"), "exit_reason": F.when(F.col("_open"), "EOD_OPEN").otherwise(F.col("exit_reason")),
            "unrealized_pnl": F.when(F.col("_open"), gain),
            "holding_days_open": F.when(F.col("_open"), F.greatest(F.datediff(F.lit(end), F.col("entry_date")), F.lit(0))),
            "exit_price": gone("exit_price"), "exit_date": gone("exit_date"),
        }
    ).drop("_open")


def selection_summary(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of a selection's records: checked, triggered, blocked, flagged, scored by bootstrap or point estimate, selected."""
    hits = lambda test, name: F.count_if(F.coalesce(test, F.lit(False))).alias(name)
    return records.groupBy(*by).agg(
        F.count("*").alias("n_checked"), hits(F.col("triggered_any"), "n_recent_trigger"), hits(F.col("status") == "fatal", "n_blocked_fatal"),
        hits(F.col("soft_flags_present"), "n_soft_flagged"), hits(F.col("used_bootstrap"), "n_scored_with_bootstrap"),
        hits(~F.coalesce("used_bootstrap", F.lit(False)), "n_scored_point_estimate"), hits(F.col("status") == "live", "n_final_selected"),
    )


def near_misses(records: DataFrame, by: Sequence[str], k: int = 5) -> DataFrame:
    """Where nothing is live, the ``k`` records of the highest score that aren't suppressed as duplicates; ties by setup."""
    live = records.where("status = 'live'").select(*by).distinct()
    rest = records.join(live, list(by), "left_anti").where(~F.coalesce("dup_suppressed", F.lit(False)))
    return top_k(rest, list(by), [F.col("candidate_score").desc_nulls_last(), F.col("setup_id")], k)

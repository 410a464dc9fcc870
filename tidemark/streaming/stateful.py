"""Sequential operators on streams: drift alarms, cooldowns, windowed event intensity.

State is a few numbers for each key, kept by Spark in its checkpointed store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_intensity(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, sum and extremes of each key and window; rows later than the watermark are dropped by Spark."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, width), key)
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))
        .select(F.col("window.start").alias("start"), key, "n", "total", "most")
    )


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each key: runs of events less than ``gap`` apart."""
    s = F.session_window(time, gap)
    g = events.withWatermark(time, late).groupBy(s, key).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def page_hinkley(events: DataFrame, time: str = "ts", key: str = "event_type", x: str = "value", delta: float = 0.005, limit: float = 50.0) -> DataFrame:
    """(key, time) of each alarm that a key's mean has risen; the statistic restarts after an alarm."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, total, low = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        alarms = []
        for pdf in batches:
            for t, v in pdf.sort_values(time)[[time, x]].itertuples(index=False):
                n += 1
                mean += (v - mean) / n
                total += v - mean - delta
                low = min(low, total)
                if total - low > limit:
                    alarms.append(t)
                    n, mean, total, low = 0, 0.0, 0.0, 0.0
        state.update((n, mean, total, low))
        yield pd.DataFrame({key: [k[0]] * len(alarms), time: alarms})

    kinds = f"`{key}` {events.schema[key].dataType.simpleString()}, `{time}` {events.schema[time].dataType.simpleString()}"
    rows = events.select(key, time, x)
    return rows.groupBy(key).applyInPandasWithState(
        run, kinds, "n bigint, mean double, total double, low double", "append", GroupStateTimeout.NoTimeout
    )


def cooled(signals: DataFrame, time: str = "ts", key: str = "ticker", seconds: int = 3600) -> DataFrame:
    """Signals that follow the key's last kept one by at least ``seconds``."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else float("-inf")
        kept = []
        for pdf in batches:
            for t in pdf[time].sort_values():
                if t.timestamp() >= free:
                    kept.append(t)
                    free = t.timestamp() + seconds
        if free > float("-inf"):
            state.update((free,))
        yield pd.DataFrame({key: [k[0]] * len(kept), time: kept})

    kinds = f"`{key}` {signals.schema[key].dataType.simpleString()}, `{time}` {signals.schema[time].dataType.simpleString()}"
    return signals.select(key, time).groupBy(key).applyInPandasWithState(run, kinds, "free double", "append", GroupStateTimeout.NoTimeout)

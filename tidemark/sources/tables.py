"""Readers and writers: market panels, release tables, artifacts.

Everything goes through Spark's own sources; paths may be any that it resolves.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.events import parse_relevance

# Header synonyms of release files.
SYNONYMS = {
    "release_datetime": ("date time", "datetime", "release date", "date", "release_datetime"),
    "event": ("event", "event name", "indicator", "name"),
    "country": ("country", "country/region", "region"),
    "survey": ("survey", "surv(m)", "consensus", "median survey", "expected"),
    "actual": ("actual", "act", "released"),
    "prior": ("prior", "previous", "prev"),
    "revised": ("revised", "revision"),
    "relevance": ("relevance", "rel", "importance"),
    "bb_ticker": ("ticker", "bb ticker", "security"),
}


def first_match(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """The first column whose name equals one of the names, ignoring case."""
    low = {c.strip().lower(): c for c in reversed(columns)}
    return next((low[n] for n in names if n in low), None)


def read_panel(spark: SparkSession, path: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Long panel of bars; the date range reaches the scan, and NaN becomes null."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end))
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns))


def panel_from_sheets(spark: SparkSession, paths: dict[str, str], **options: str) -> DataFrame:
    """Per-ticker CSV sheets to one long panel; columns that a sheet lacks are null, rows without a date go."""
    out: DataFrame | None = None
    for ticker, path in paths.items():
        raw = spark.read.options(header=True, **options).csv(path)
        day = first_match(raw.columns, ("dates", "date"))
        values = [F.col(f"`{c}`").try_cast("double").alias(c) for c in raw.columns if c != day]
        sheet = raw.select(F.lit(ticker).alias("ticker"), F.to_date(day).alias("date"), *values).where("date is not null")
        out = sheet if out is None else out.unionByName(sheet, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sheets")
    return out


def filled(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Forward fill over the union of all dates: every ticker has a row on each."""
    grid = panel.select("ticker").distinct().join(panel.select("date").distinct())
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(panel, ["ticker", "date"], "left")
    return full.select("ticker", "date", *(F.last(c, ignorenulls=True).over(w).alias(c) for c in columns))


def wide(panel: DataFrame, fields: Sequence[str], tickers: Sequence[str]) -> DataFrame:
    """One row a day, one column for each ticker and field; for export only."""
    return panel.groupBy("date").pivot("ticker", list(tickers)).agg(*(F.first(c).alias(c) for c in fields))


def read_releases(raw: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Release table with canonical columns; times in ``zone`` become UTC, rows without time or event go."""
    found = {name: first_match(raw.columns, names) for name, names in SYNONYMS.items()}
    pick = lambda n: F.col(f"`{found[n]}`") if found[n] else F.lit(None).cast("string")
    when = F.coalesce(*(F.try_to_timestamp(pick("release_datetime").cast("string"), F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm", "yyyy-MM-dd")))
    out = raw.select(
        F.to_utc_timestamp(when, zone).alias("release_ts"), F.trim(pick("event")).alias("event"), pick("country").alias("country"),
        *(pick(c).cast("string").try_cast("double").alias(c) for c in ("survey", "actual", "prior", "revised")),
        parse_relevance(pick("relevance")).alias("relevance"), pick("bb_ticker").alias("bb_ticker"),
    )
    return out.where("release_ts is not null and event is not null and event <> ''")


def write_csv(df: DataFrame, path: str, digits: int = 4, columns: Sequence[str] | None = None) -> None:
    """CSV with rounded doubles and the given columns first; nested columns as JSON."""
    from tidemark.operators.selection import aligned

    if columns is not None:
        df = aligned(df, columns)
    shown = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits)
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        shown.append(c.alias(f.name))
    df.select(*shown).write.mode("overwrite").option("header", True).csv(path)


def write_by_fold(df: DataFrame, path: str, fold: str = "fold") -> None:
    """Parquet with one folder for each fold, so that reading one fold scans one folder."""
    df.write.mode("overwrite").partitionBy(fold).parquet(path)


def read_fold(spark: SparkSession, path: str, number: int, fold: str = "fold") -> DataFrame:
    return spark.read.parquet(path).where(F.col(fold) == number)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV by schema; malformed fields are null, a missing path is an empty table."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def union_open_trades(tables: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """All open trades of several runs, best value first."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.select(*columns).orderBy(F.desc_nulls_last("final_nav"))


def run_header(seed: int, extra: dict | None = None) -> str:
    """Versions and settings of a run as JSON."""
    import platform

    import numpy
    import pandas
    import pyspark

    versions = {"python": platform.python_version(), "pyspark": pyspark.__version__, "numpy": numpy.__version__, "pandas": pandas.__version__}
    return json.dumps({"seed": seed, "versions": versions, **(extra or {})}, sort_keys=True)

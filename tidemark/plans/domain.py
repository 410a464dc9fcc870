"""Trades, releases, signals and forecasts derived from the supplied tables.

Each has a DataFrame form and the SQL that gives the same rows in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.panel import BARS, bars, read


def trades(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """Ledger: one trade for each line; setups are suppliers; a tenth is open (no exit).

    ``numbered`` adds ``row``, which rises in the order of the table's rows, for sums in that order.
    """
    lines = read(spark, sf_dir, "lineitem")
    lines = lines.withColumn("row", F.monotonically_increasing_id()) if numbered else lines
    t = lines.join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    pct = (F.col("l_discount") - 0.05) * 4 + (0.04 - F.col("l_tax")) * 2
    capital = F.col("l_quantity") * 10
    is_open = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 10 == 0
    return t.select(
        F.col("l_suppkey").alias("setup_id"),
        F.concat("l_returnflag", "l_linestatus").alias("ticker"),
        F.to_date("o_orderdate").alias("trigger_date"),
        F.when(~is_open, F.to_date("l_shipdate")).alias("exit_date"),
        (F.col("l_linenumber") + 1).alias("horizon"),
        F.year("o_orderdate").alias("fold"),
        F.round(pct, 6).alias("pnl_pct"),
        capital.alias("capital"),
        F.round(F.round(pct, 6) * capital, 4).alias("pnl_dollars"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("trade_id"),
        *(["row"] if numbered else []),
    )


TRADES = """SELECT l_suppkey AS setup_id, l_returnflag || l_linestatus AS ticker, CAST(o_orderdate AS DATE) AS trigger_date,
  CASE WHEN (l_orderkey * 7 + l_linenumber) % 10 <> 0 THEN CAST(l_shipdate AS DATE) END AS exit_date,
  l_linenumber + 1 AS horizon, year(o_orderdate) AS fold,
  round((l_discount - 0.05e0) * 4 + (0.04e0 - l_tax) * 2, 6) AS pnl_pct, l_quantity * 10 AS capital,
  round(round((l_discount - 0.05e0) * 4 + (0.04e0 - l_tax) * 2, 6) * (l_quantity * 10), 4) AS pnl_dollars,
  l_orderkey * 8 + l_linenumber AS trade_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Economic releases: one for each event of the stream; the survey is the mean of the five before."""
    e = read(spark, sf_dir, "events")
    past = Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(-5, -1)
    return e.select(
        F.col("event_id"),
        F.col("event_type").alias("event"),
        F.col("ts").alias("release_ts"),
        F.to_date("ts").alias("release_date"),
        F.col("value").alias("actual"),
        F.avg("value").over(past).alias("survey"),
        (F.get_json_object("props", "$.k").cast("double") % 100).alias("relevance"),
    )


RELEASES = """SELECT event_id, event_type AS event, ts AS release_ts, CAST(ts AS DATE) AS release_date, value AS actual,
  avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS survey,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) % 100 AS relevance FROM events"""


def forward_returns(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """(ticker, date, pos, px_last, fwd): return over the next k bars, null at the end."""
    w = Window.partitionBy("ticker").orderBy("date")
    b = bars(spark, sf_dir).select("ticker", "date", "px_last")
    ahead = F.lead("px_last", k).over(w)
    return b.withColumns({"pos": F.row_number().over(w), "fwd": ahead / F.col("px_last") - 1})


def forward_sql(k: int = 5) -> str:
    w = "OVER (PARTITION BY ticker ORDER BY date)"
    return f"SELECT ticker, date, px_last, row_number() {w} AS pos, lead(px_last, {k}) {w} / px_last - 1 AS fwd FROM ({BARS})"

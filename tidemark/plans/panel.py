"""The market panel derived from the supplied tables, as a DataFrame and as SQL text.

A ticker is a return flag and a line status, a bar one ship day.  Prices are unit
prices in the order of (order key, line number, price).  Option, flow and sentiment
columns are fixed functions of the day's lines, so that every registry entry has
an input.  ``b_*`` are the benchmark's columns, ``v_*`` those of the sector's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import events

BENCHMARK = "NO"

#: name -> (expression over the day's lines); identical text in both engines.
FIELDS = {
    "px_open": "min_by(price, place)",
    "px_high": "max(price)",
    "px_low": "min(price)",
    "px_last": "max_by(price, place)",
    "volume": "sum(l_quantity)",
    "turnover": "sum(l_extendedprice)",
    "call_oi": "sum(l_linenumber) * 1e0",
    "put_oi": "sum(8 - l_linenumber) * 1e0",
    "iv30c": "20 + 100 * avg(l_discount)",
    "iv30p": "21 + 100 * max(l_discount)",
    "iv3mc": "22 + 100 * avg(l_tax)",
    "iv3mp": "23 + 100 * max(l_tax)",
    "c10": "25 + 100 * min(l_tax)",
    "c25": "22 + 100 * avg(l_discount)",
    "c40": "20 + 100 * min(l_discount)",
    "p10": "28 + 100 * max(l_tax)",
    "p25": "24 + 100 * avg(l_tax)",
    "p40": "21 + 100 * min(l_tax)",
    "pcr": "avg(l_linenumber) / 4",
    "opt_vol": "sum(l_linenumber * l_quantity)",
    "tw_count": "count(*) * 1e0",
    "tw_sent": "avg(l_tax) - 0.04e0",
    "news_count": "sum(l_linenumber) * 1e0",
    "news_heat": "avg(l_quantity) / 25",
    "cn_sent": "avg(l_discount) - 0.05e0",
    "vol90": "20 + 10 * avg(l_discount)",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each ticker and day."""
    lines = read(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("ticker"),
        F.col("l_returnflag").alias("sector"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber") + F.col("l_extendedprice") / F.col("l_quantity") / 1e7).alias("place"),
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_linenumber",
    )
    return lines.groupBy("ticker", "sector", "date").agg(*(F.expr(sql).alias(n) for n, sql in FIELDS.items()))


BARS = f"""SELECT ticker, sector, date, {', '.join(f'{sql} AS {n}' for n, sql in FIELDS.items())} FROM (
  SELECT l_returnflag || l_linestatus AS ticker, l_returnflag AS sector, CAST(l_shipdate AS DATE) AS date,
         l_extendedprice / l_quantity AS price, l_orderkey * 8 + l_linenumber + l_extendedprice / l_quantity / 1e7 AS place, * FROM lineitem)
  GROUP BY ticker, sector, date"""

MATE = ("px_last", "volume")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the benchmark's and the sector's columns."""
    b = bars(spark, sf_dir)
    mate = lambda p: [F.col(c).alias(f"{p}_{c}") for c in MATE]
    bench = b.where(F.col("ticker") == BENCHMARK).select("date", *mate("b"))
    peer = b.where(F.col("ticker") == F.concat("sector", F.lit("F"))).select("date", "sector", *mate("v"))
    return b.join(bench, "date", "left").join(peer, ["date", "sector"], "left")


PANEL = f"""SELECT b.*, {', '.join(f'm.{c} AS b_{c}, v.{c} AS v_{c}' for c in MATE)} FROM ({BARS}) b
  LEFT JOIN ({BARS}) m ON m.date = b.date AND m.ticker = '{BENCHMARK}'
  LEFT JOIN ({BARS}) v ON v.date = b.date AND v.sector = b.sector AND v.ticker = b.sector || 'F'"""

def orders_as_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases over the panel's years: an order is one, its priority the event, its price against the five before the surprise."""
    o = read(spark, sf_dir, "orders")
    past = Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey").rowsBetween(-5, -1)
    price = F.col("o_totalprice") / 10000
    return o.select(
        F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("event"), F.col("o_orderdate").alias("release_ts"),
        F.to_date("o_orderdate").alias("release_date"), price.alias("actual"), F.avg(price).over(past).alias("survey"),
        (F.col("o_custkey") % 100).cast("double").alias("relevance"),
    )


INFLATION, GROWTH = "1-URGENT", "2-HIGH"


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with the event columns of each day, and the day's highest price as ``dxy``."""
    days = events.bundle(events.surprises(orders_as_releases(spark, sf_dir)), INFLATION, GROWTH).withColumnRenamed("release_date", "date")
    rows = panel(spark, sf_dir)
    top = rows.groupBy("date").agg(F.max("px_last").alias("dxy"))
    return rows.join(top, "date").join(days, "date", "left")


#: Stand-ins of the macro series among the tickers; dxy is the day's highest, so that it has every day.
MACRO = {"y10": "AF", "y2": "NF", "hg": "RF", "xau": "AO", "btc": "RO"}


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a day with the last prices of the macro series."""
    b = bars(spark, sf_dir)
    last = {n: F.max(F.when(F.col("ticker") == t, F.col("px_last"))).alias(n) for n, t in MACRO.items()}
    return b.groupBy("date").agg(*last.values(), F.max("px_last").alias("dxy")).withColumn("all_days", F.lit(1))


MACRO_SQL = (
    "SELECT date, 1 AS all_days, "
    + ", ".join(f"max(CASE WHEN ticker = '{t}' THEN px_last END) AS {n}" for n, t in MACRO.items())
    + ", max(px_last) AS dxy"
    + f" FROM ({BARS}) GROUP BY date"
)

_T, _P = "OVER (PARTITION BY ticker ORDER BY date)", "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"


def _beta(x: str) -> str:
    """Slope of the returns on ``x`` over 63 rows, 31 pairs at least."""
    pair = f"CASE WHEN ret IS NOT NULL AND {x} IS NOT NULL THEN {{}} END"
    y, x = pair.format("ret"), pair.format(x)
    return f"CASE WHEN count({x}) {_P} >= 31 THEN covar_samp({y}, {x}) {_P} / (var_samp({x}) {_P} + 1e-9) END"


_SPAN = 1 - 2 / 6
#: The event features written out by hand.
EVENT_FEATURES = f"""WITH o AS (SELECT o_orderkey, o_orderpriority AS event, o_orderdate AS ts, CAST(o_orderdate AS DATE) AS day, o_totalprice / 10000 AS actual, o_custkey % 100 AS rel,
    avg(o_totalprice / 10000) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS survey FROM orders),
  z AS (SELECT day, event, sqrt(rel) AS w, CASE WHEN count(actual - survey) OVER h >= 3 AND stddev_pop(actual - survey) OVER h > 1e-12
      THEN (actual - survey - avg(actual - survey) OVER h) / stddev_pop(actual - survey) OVER h END AS z
    FROM o WINDOW h AS (PARTITION BY event ORDER BY ts, o_orderkey ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
  d AS (SELECT day, sum(w) AS weight, {', '.join(f"sum(z * w) FILTER (z IS NOT NULL AND w > 0 {c}) / sum(w) FILTER (z IS NOT NULL AND w > 0 {c}) AS {n}" for n, c in (('mz', ''), ('mi', f"AND event = '{INFLATION}'"), ('mg', f"AND event = '{GROWTH}'")))},
      avg(CASE WHEN abs(z) >= 2 THEN 1e0 ELSE 0e0 END) AS tail FROM z GROUP BY day),
  s AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day),
  f AS (SELECT s.day, sum(coalesce(weight, 0)) OVER (ORDER BY s.day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS heat, mz, mi, mg, CASE WHEN d.day IS NOT NULL THEN coalesce(sign(mi), 0) * coalesce(sign(mg), 0) END AS div,
      CASE WHEN count(tail) OVER (ORDER BY s.day ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) >= 5 THEN avg(tail) OVER (ORDER BY s.day ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) END AS tails FROM s LEFT JOIN d ON d.day = s.day),
  e AS (SELECT day AS date, heat, {', '.join(f'lag({c}) OVER (ORDER BY day) AS {c}' for c in ('mz', 'mi', 'mg', 'div', 'tails'))} FROM f),
  p AS (SELECT b.*, e.*, max(px_last) OVER (PARTITION BY b.date) AS dxy FROM ({PANEL}) b LEFT JOIN e ON e.date = b.date),
  q AS (SELECT * EXCLUDE (b_px_last, v_px_last), last_value(b_px_last IGNORE NULLS) {_T} AS bp, last_value(v_px_last IGNORE NULLS) {_T} AS vp, row_number() {_T} AS k FROM p),
  r AS (SELECT *, px_last / lag(px_last) {_T} - 1 AS ret, px_last / lag(px_last, 21) {_T} - 1 AS m21, px_last / lag(px_last, 5) {_T} - 1 AS m5, dxy / lag(dxy) {_T} - 1 AS dr, bp / lag(bp) {_T} - 1 AS br,
      vp / lag(vp, 21) {_T} - 1 AS vm, bp / lag(bp, 21) {_T} - 1 AS bm, CASE WHEN count(heat) OVER w7 >= 7 THEN quantile_cont(heat, 0.5) OVER w7 END AS mid
    FROM q WINDOW w7 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
  t AS (SELECT ticker, date, m21 * CASE WHEN heat < mid THEN 1e0 ELSE 0e0 END AS ev_gated_mom21,
      CASE WHEN count(mz) {_T} >= 2 THEN sum(mz * power({_SPAN}, 1000 - k)) {_T} / sum(CASE WHEN mz IS NOT NULL THEN power({_SPAN}, 1000 - k) END) {_T} END AS ev_tail_carry,
      mi * {_beta('dr')} AS ev_infl_beta_gate, mg * (vm - bm) AS ev_growth_rotation, m21 * heat AS ev_intensity_gated_mom, div * {_beta('br')} AS ev_regime_sensitivity,
      m5 * CASE WHEN tails > 0.5 THEN 1e0 ELSE 0e0 END AS ev_vol_regime_gate FROM r)
  SELECT ticker, date, {', '.join(f'round(lag({c}) {_T} + 3.1e-8, 4) + 0e0 AS {c}' for c in ('ev_gated_mom21', 'ev_tail_carry', 'ev_infl_beta_gate', 'ev_growth_rotation', 'ev_intensity_gated_mom', 'ev_regime_sensitivity', 'ev_vol_regime_gate'))} FROM t"""

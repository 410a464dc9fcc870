"""Queries over trades, releases, signals, forecasts and bars, each with its own SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.series import NUDGE, Series, rounding
from tidemark.operators import crosssection, events, gates, joins, kernels, ledger, mixtures, models, options, reports, robustness, scoring, search, selection, signals, splits, subspaces
from tidemark.operators import rolling as R
from tidemark.plans.domain import RELEASES, TRADES, forward_returns, forward_sql, releases, trades
from tidemark.plans.panel import BARS, bars, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded, negative zeros made zeros."""
    shown = [(F.round(F.col(c) + NUDGE, own.get(c, digits)) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return df.select(*shown)


def r(x: str, digits: int = 6) -> str:
    return rounding(x, digits)


# the flagship: features to a ranked, lagged, latched signal


def _slice(engine: str) -> tuple[Series, Series, dict, dict]:
    a, b = Series(("ticker",), "date", engine), Series(("ticker",), "date", engine)
    first = {"mom": R.pct_change(a, "px_last", 21), "rv": R.realized_vol(a, "px_last", 21)}
    second = {"fired": R.hysteresis(b, b.lag("rank_mom"), 0.7, 0.4, 2, 2)}
    return a, b, first, second


def _slice_sql() -> str:
    a, b, first, second = _slice("duckdb")
    inner = a.text(BARS, ["ticker", "date"], first, None)
    ranked = f"""SELECT *, CASE WHEN mom IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY mom NULLS LAST)
      + (count(mom) OVER (PARTITION BY date, mom) - 1) / 2e0) / count(mom) OVER (PARTITION BY date) END AS rank_mom FROM ({inner})"""
    latched = b.text(ranked, ["ticker", "date", "mom", "rv"], second, None)
    return f"""SELECT ticker, count(*) AS days, sum(fired) AS fired_days, {r('avg(mom)', 5)} AS mean_mom, {r('avg(rv)', 4)} AS mean_rv
      FROM ({latched}) GROUP BY ticker"""


@query(_slice_sql())
def flagship_signal_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum and volatility, momentum's rank of the day, lagged and latched; days and signals of each ticker."""
    a, b, first, second = _slice("spark")
    base = a.spark(bars(spark, sf_dir), ["ticker", "date"], first, None)
    ranked = base.withColumn("rank_mom", crosssection.pct_rank("mom", ["date"]))
    latched = b.spark(ranked, ["ticker", "date", "mom", "rv"], second, None)
    return latched.groupBy("ticker").agg(
        F.count("*").alias("days"), F.sum("fired").alias("fired_days"),
        (F.round(F.avg("mom") + NUDGE, 5) + 0.0).alias("mean_mom"), (F.round(F.avg("rv") + NUDGE, 4) + 0.0).alias("mean_rv"),
    )


CS = f"""SELECT ticker, sector, date, volume, turnover / volume AS vwap FROM ({BARS})"""


@query(f"""SELECT ticker, date,
  {r("(rank() OVER (PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2e0) / count(*) OVER (PARTITION BY date)")} AS cs_rank,
  {r("(rank() OVER (PARTITION BY date, sector ORDER BY vwap) + (count(*) OVER (PARTITION BY date, sector, vwap) - 1) / 2e0) / count(*) OVER (PARTITION BY date, sector)")} AS sn_rank,
  {r("(vwap - avg(vwap) OVER (PARTITION BY date, sector)) / (stddev_samp(vwap) OVER (PARTITION BY date, sector) + 1e-9)", 4)} AS sn_z,
  {r("vwap - avg(vwap) OVER (PARTITION BY date)", 4)} AS cs_gap FROM ({CS})""")
def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks and scores of a day's tickers, overall and within sectors."""
    b = bars(spark, sf_dir).select("ticker", "sector", "date", "volume", (F.col("turnover") / F.col("volume")).alias("vwap"))
    out = b.select(
        "ticker", "date", crosssection.pct_rank("volume", ["date"]).alias("cs_rank"),
        crosssection.pct_rank("vwap", ["date", "sector"]).alias("sn_rank"),
        crosssection.neutral_z("vwap", ["date", "sector"]).alias("sn_z"), crosssection.demeaned("vwap", ["date"]).alias("cs_gap"),
    )
    return rounded(out, sn_z=4, cs_gap=4)


# as-of and calendar joins


QUOTES = f"SELECT ticker, date, CASE WHEN day(date) % 5 <> 0 THEN px_last END AS px FROM ({BARS}) WHERE day(date) % 3 <> 0"


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.day("date")
    return bars(spark, sf_dir).where(day % 3 != 0).select("ticker", "date", F.when(day % 5 != 0, F.col("px_last")).alias("px"))


def _asof_sql(keep_null: bool) -> str:
    tail = "" if keep_null else "AND (q.px IS NOT NULL OR q.date = t.trigger_date)"
    return f"""WITH t AS ({TRADES}), q AS ({QUOTES}), d AS (SELECT DISTINCT ticker, trigger_date FROM t), m AS (
      SELECT t.ticker, t.trigger_date, max(struct_pack(d := q.date, v := q.px)) AS b FROM d t JOIN q
        ON q.ticker = t.ticker AND q.date <= t.trigger_date {tail} GROUP BY t.ticker, t.trigger_date)
      SELECT t.trade_id, t.ticker, t.trigger_date, m.b.v AS px FROM t LEFT JOIN m ON m.ticker = t.ticker AND m.trigger_date = t.trigger_date"""


@query(_asof_sql(False))
def asof_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price as of each trade's trigger; an exact row decides, else the last one with a price."""
    t = trades(spark, sf_dir).select("trade_id", "ticker", "trigger_date")
    return joins.asof(t, quotes(spark, sf_dir), ["ticker"], "trigger_date", "date", "px")


@query(_asof_sql(True))
def asof_last_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price of the last row at or before each trigger, even if it has none."""
    t = trades(spark, sf_dir).select("trade_id", "ticker", "trigger_date")
    return joins.asof(t, quotes(spark, sf_dir), ["ticker"], "trigger_date", "date", "px", keep_null=True)


DAYS = "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE l_shipdate IS NOT NULL"


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").where("l_shipdate is not null")
    return line.select(F.to_date("l_shipdate").alias("date")).distinct()


def _order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("t0"))


@query(f"""WITH c AS ({DAYS}) SELECT o_orderkey, t0, (SELECT min(date) FROM c WHERE date >= t0) AS snapped
  FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS t0 FROM orders) WHERE (SELECT min(date) FROM c WHERE date >= t0) IS NOT NULL""")
def snap_to_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's first calendar day on or after it."""
    return joins.snap_forward(_order_days(spark, sf_dir), days(spark, sf_dir), "t0")


@query(f"""WITH c AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM ({DAYS}))
  SELECT o_orderkey, t0, e.date AS t1 FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS t0 FROM orders) o
  JOIN c s ON s.date = o.t0 JOIN c e ON e.pos = s.pos + 5""")
def label_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label interval of five calendar positions for each order."""
    return joins.label_pairs(_order_days(spark, sf_dir), days(spark, sf_dir), 5)


FOLD_ROWS = [(k, date(1995 + k, 1, 1), date(1995 + k, 9, 30)) for k in range(4)]


@query(f"""WITH f(fold_no, low, high) AS (VALUES {', '.join(f"({k}, DATE '{a}', DATE '{b}')" for k, a, b in FOLD_ROWS)})
  SELECT fold_no, count(*) AS n, {r('sum(pnl_pct)', 4)} AS total FROM ({TRADES}) t JOIN f ON t.trigger_date BETWEEN low AND high GROUP BY fold_no""")
def fold_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades in each fold's interval."""
    folds = spark.createDataFrame(FOLD_ROWS, "fold_no int, low date, high date")
    rows = joins.members(trades(spark, sf_dir), folds, "trigger_date", "low", "high")
    return rounded(rows.groupBy("fold_no").agg(F.count("*").alias("n"), F.sum("pnl_pct").alias("total")), 4)


@query(f"""SELECT o_orderkey, weekday_count, plus10 FROM (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS b,
   (SELECT CAST(count(*) AS INT) FROM range(0, CAST(o_orderkey % 40 AS INT) + 1) g(i) WHERE isodow(CAST(o_orderdate AS DATE) + CAST(i AS INT)) < 6) AS weekday_count,
   (SELECT x FROM (SELECT CAST(o_orderdate AS DATE) + CAST(i AS INT) AS x, row_number() OVER (ORDER BY i) AS k FROM range(1, 20) g(i)
      WHERE isodow(CAST(o_orderdate AS DATE) + CAST(i AS INT)) < 6) WHERE k = 10) AS plus10
  FROM orders)""")
def weekday_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays of an interval, and the tenth weekday after a day."""
    a = F.to_date("o_orderdate")
    b = F.date_add(a, (F.col("o_orderkey") % 40).cast("int"))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", joins.weekdays_between(a, b).alias("weekday_count"), joins.add_weekdays(a, 10).alias("plus10")
    )


@query(f"""WITH t AS ({TRADES}), live AS (SELECT DISTINCT ticker, horizon FROM t WHERE pnl_pct > 0.2)
  SELECT 'semi' AS kind, count(*) AS n FROM t WHERE (ticker, horizon) IN (SELECT (ticker, horizon) FROM live)
  UNION ALL SELECT 'anti', count(*) FROM t WHERE (ticker, horizon) NOT IN (SELECT (ticker, horizon) FROM live)""")
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows with and without an approved (ticker, horizon)."""
    t = trades(spark, sf_dir)
    live = t.where("pnl_pct > 0.2").select("ticker", "horizon").distinct()
    count = lambda how, kind: t.join(live, ["ticker", "horizon"], how).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count("left_semi", "semi").unionByName(count("left_anti", "anti"))


# releases


REL = f"""(WITH r AS ({RELEASES}), s AS (SELECT *, sqrt(least(greatest(coalesce(relevance, 70), 0), 100)) AS weight, actual - survey AS surprise FROM r),
  w AS (SELECT *, count(surprise) OVER w AS n, avg(surprise) OVER w AS mu, stddev_pop(surprise) OVER w AS sd,
    coalesce(list(surprise) FILTER (WHERE surprise IS NOT NULL) OVER w, []) AS seen
    FROM s WINDOW w AS (PARTITION BY event ORDER BY release_ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
  SELECT *, CASE WHEN n >= 3 AND sd > 1e-12 THEN (surprise - mu) / sd END AS z,
    CASE WHEN n >= 3 AND surprise IS NOT NULL THEN (len(list_filter(seen, lambda v: v < surprise)) + (len(list_filter(seen, lambda v: v = surprise)) + 1) / 2e0) / n END AS pct,
    coalesce(abs(CASE WHEN n >= 3 AND sd > 1e-12 THEN (surprise - mu) / sd END) > 1.5, false) AS tail FROM w)"""


@query(f"SELECT event_id, event, {r('weight', 5)} AS weight, {r('z', 5)} AS z, {r('pct')} AS pct, tail FROM {REL}")
def release_surprises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surprise of each release against its event's own history."""
    s = events.surprises(releases(spark, sf_dir))
    return rounded(s.select("event_id", "event", "weight", "z", "pct", "tail"), 6, weight=5, z=5)


KINDS = ("click", "view", "purchase")


def _kinds_sql() -> str:
    return ", ".join(
        f"{r(f'sum(z * weight) FILTER (z IS NOT NULL AND weight > 0 AND event = {chr(39)}{k}{chr(39)}) / sum(weight) FILTER (z IS NOT NULL AND weight > 0 AND event = {chr(39)}{k}{chr(39)})', 5)} AS bucket_{k}"
        for k in KINDS
    )


DAILY = f"""SELECT release_date, count(*) AS n, {r('sum(weight)', 4)} AS weight_sum,
  {r('sum(z * weight) FILTER (z IS NOT NULL AND weight > 0) / sum(weight) FILTER (z IS NOT NULL AND weight > 0)', 5)} AS z_mean,
  {r('sum(pct * weight) FILTER (pct IS NOT NULL AND weight > 0) / sum(weight) FILTER (pct IS NOT NULL AND weight > 0)', 5)} AS pct_mean,
  {r('stddev_pop(z)', 5)} AS z_std, {r('avg(CAST(tail AS DOUBLE))')} AS tail_share, {r('max(weight) / sum(weight)')} AS top_weight,
  abs(sum(sign(z))) * 1e0 AS agreement, {_kinds_sql()} FROM {REL} GROUP BY release_date"""


def daily_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.daily(events.surprises(releases(spark, sf_dir)), KINDS)


@query(DAILY)
def release_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composites of each release day."""
    return rounded(daily_rows(spark, sf_dir), 5, weight_sum=4, tail_share=6, top_weight=6)


@query(f"""WITH d AS ({DAILY}), s AS (SELECT CAST(unnest(generate_series((SELECT min(release_date) FROM d), (SELECT max(release_date) FROM d), INTERVAL 1 DAY)) AS DATE) AS release_date),
  x AS (SELECT s.release_date, coalesce(d.weight_sum, 0) AS w FROM s LEFT JOIN d USING (release_date))
  SELECT release_date, {', '.join(f"{r(f'sum(w) OVER (ORDER BY release_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)', 2)} AS heat_{n}" for n in (1, 3, 5, 10))},
  {', '.join(f"CASE WHEN sum(w) OVER (ORDER BY release_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) <= 5 THEN 1 ELSE 0 END AS vacuum_{n}" for n in (5, 10))} FROM x""")
def release_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing weight of releases on every calendar day."""
    return rounded(events.heat(rounded(daily_rows(spark, sf_dir), 5, weight_sum=4)), 2)


@query(f"""WITH d AS ({DAILY}), k AS (SELECT release_date, tail_share, row_number() OVER (ORDER BY release_date) AS k FROM d)
  SELECT release_date, k - last_value(CASE WHEN tail_share >= 0.12 THEN k END IGNORE NULLS) OVER (ORDER BY release_date) AS rows_since_tail FROM k""")
def rows_since_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.since_tail(rounded(daily_rows(spark, sf_dir), 6), 0.12)


def _decay_sql() -> str:
    s, out = Series((), "release_date", "duckdb"), {}
    for c in ("z_mean", "z_std"):
        for h in (10.5, 21, 63):
            out[f"{c}_hl{str(h).replace('.', 'p')}"] = R.ewma_recursive(s, c, h)
        for n in (3, 5, 10, 21):
            out[f"{c}_ma{n}"] = R.mean(s, c, n, 2)
    return s.text(f"SELECT release_date, lag(z_mean) OVER (ORDER BY release_date) AS z_mean, lag(z_std) OVER (ORDER BY release_date) AS z_std FROM ({DAILY})", ["release_date"], out, 5)


@query(_decay_sql())
def release_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lagged composites with exponential and plain means."""
    lagged = events.lagged(rounded(daily_rows(spark, sf_dir), 5), ["z_mean", "z_std"]).select("release_date", "z_mean", "z_std")
    return rounded(events.decayed(lagged, ["z_mean", "z_std"]), 5)


PAIR = f"SELECT release_date, event, {r('avg(z)', 5)} AS z FROM {REL} WHERE z IS NOT NULL GROUP BY release_date, event"


@query(f"""WITH d AS ({PAIR}), a AS (SELECT * FROM d WHERE event = 'view'), b AS (SELECT * FROM d WHERE event = 'purchase'),
  m AS (SELECT b.release_date AS b_date, b.z AS b_value, max(a.release_date) AS a_date FROM a JOIN b ON a.release_date < b.release_date AND a.release_date >= b.release_date - 3 GROUP BY 1, 2)
  SELECT m.b_date, m.a_date, a.z AS a_value, m.b_value, CAST(sign(a.z) * sign(m.b_value) AS INT) AS agree FROM m JOIN a ON a.release_date = m.a_date""")
def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last view surprise in the three days before each purchase surprise, and whether they agree."""
    s = events.surprises(releases(spark, sf_dir)).where("z is not null")
    d = s.groupBy("release_date", "event").agg((F.round(F.avg("z") + NUDGE, 5) + 0.0).alias("z"))
    pairs = joins.last_before(d.where("event = 'view'"), d.where("event = 'purchase'"), 3, "release_date", "release_date", "z")
    return pairs.withColumn("agree", joins.agreement(F.col("a_value"), F.col("b_value")))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), e AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderkey % 97 = 0)
  SELECT d.date, CAST((SELECT min(e.date) FROM e WHERE e.date >= d.date) - d.date AS INT) AS days_to,
    isodow(d.date) IN (1, 5) AND EXISTS (SELECT 1 FROM e WHERE d.date BETWEEN e.date - 5 AND e.date - 1) AS pre_event FROM d""")
def event_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days to the next event, and Mondays and Fridays in the five days before one."""
    o = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), (F.col("o_orderkey") % 97 == 0).alias("hit"))
    d = o.groupBy("date").agg(F.max("hit").alias("hit"))
    flagged = joins.days_to_next(d, F.col("hit"))
    return events.pre_event_days(flagged, d.where("hit").select("date"), [0, 4]).drop("hit")


@query("""SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS week FROM orders a WHERE isodow(o_orderdate) = 4 AND o_orderkey % 5 = 0
  AND EXISTS (SELECT 1 FROM orders b WHERE isodow(b.o_orderdate) = 5 AND b.o_orderkey % 7 = 0 AND date_trunc('week', b.o_orderdate) = date_trunc('week', a.o_orderdate))""")
def payroll_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return events.weeks_with_both(o.where("o_orderkey % 5 = 0"), o.where("o_orderkey % 7 = 0"))


# ledger


@query(f"""WITH d AS (SELECT ticker, exit_date, sum(pnl_dollars) AS pnl FROM ({TRADES}) WHERE exit_date IS NOT NULL GROUP BY 1, 2),
  s AS (SELECT ticker, CAST(unnest(generate_series(min(exit_date), max(exit_date), INTERVAL 1 DAY)) AS DATE) AS exit_date FROM d GROUP BY ticker)
  SELECT ticker, exit_date, {r('coalesce(pnl, 0) / 100000')} AS r FROM s LEFT JOIN d USING (ticker, exit_date) WHERE isodow(exit_date) < 6""")
def nav_daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realised P&L of each weekday over the base capital."""
    return rounded(ledger.nav_returns(trades(spark, sf_dir), ["ticker"], 100000.0))


DAY_R = f"SELECT ticker, trigger_date, median(pnl_pct) / 10 AS r FROM ({TRADES}) GROUP BY ticker, trigger_date"


@query(f"""WITH d AS ({DAY_R}),
  p AS (SELECT *, exp(sum(ln(1 + r)) OVER w) AS nav FROM d WINDOW w AS (PARTITION BY ticker ORDER BY trigger_date)),
  q AS (SELECT *, nav / max(nav) OVER (PARTITION BY ticker ORDER BY trigger_date) - 1 AS dd FROM p),
  g AS (SELECT ticker, avg(r) AS mu, stddev_samp(r) AS sd, quantile_cont(r, 0.05) AS vq, quantile_cont(dd, 0.05) AS dq FROM q GROUP BY ticker),
  k AS (SELECT q.*, mu, sd, vq, dq, row_number() OVER (PARTITION BY q.ticker ORDER BY dd, trigger_date) AS rk FROM q JOIN g USING (ticker)),
  a AS (SELECT ticker, count(*) AS n, any_value(mu) AS mu, any_value(sd) AS sd, stddev_samp(r) FILTER (r < 0) AS down, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) AS hit_rate,
    sum(greatest(r, 0)) AS gains, -sum(least(r, 0)) AS losses, avg(r) FILTER (r > 0) AS aw, -avg(r) FILTER (r < 0) AS al, min(dd) AS mdd, avg(dd) AS avg_dd,
    sqrt(avg(power(100 * dd, 2))) AS ulcer, avg(abs(dd)) AS pain, any_value(vq) AS var, avg(r) FILTER (r <= vq) AS cvar, avg(dd) FILTER (dd <= dq) AS cdar,
    avg(power((r - mu) / sd, 3)) AS skew, avg(power((r - mu) / sd, 4)) - 3 AS kurt, sqrt(avg(dd * dd)) AS burke_, -avg(dd) FILTER (rk <= 3) AS sterling_,
    power(arg_max(nav, trigger_date) / arg_min(nav, trigger_date), 252e0 / count(*)) - 1 AS cagr FROM k GROUP BY ticker)
  SELECT ticker, n, {', '.join(f'{r(c, 5)} AS {c}' for c in ('hit_rate', 'cagr', 'mdd', 'avg_dd', 'ulcer', 'pain', 'var', 'cvar', 'cdar', 'skew', 'kurt'))},
    {r('mu * 252 / (sd * sqrt(252))', 5)} AS sharpe, {r('mu * sqrt(252) / down', 5)} AS sortino, {r('gains / losses', 5)} AS omega, {r('gains / losses', 5)} AS profit_factor,
    CAST(NULL AS VARCHAR) AS profit_factor_raw, {r('aw / al', 5)} AS payoff, {r('cagr / abs(mdd)', 5)} AS calmar, {r('cagr / ulcer', 5)} AS ulcer_ratio, {r('cagr / pain', 5)} AS pain_ratio,
    {r('cagr / burke_', 5)} AS burke, {r('cagr / sterling_', 5)} AS sterling FROM a""")
def risk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics bundle of each ticker's daily median returns."""
    d = ledger.daily_by_trigger(trades(spark, sf_dir), ["ticker"]).withColumn("r", F.col("r") / 10)
    return rounded(ledger.risk_metrics(d, ["ticker"], ["trigger_date"]), 5)


@query(f"""WITH s AS (SELECT setup_id, trigger_date, trade_id, pnl_pct, sign(pnl_pct) AS g FROM ({TRADES})),
  t AS (SELECT *, CASE WHEN lag(g) OVER w = g THEN 0 ELSE 1 END AS turn FROM s WINDOW w AS (PARTITION BY setup_id ORDER BY trigger_date, trade_id, pnl_pct)),
  u AS (SELECT *, sum(turn) OVER (PARTITION BY setup_id ORDER BY trigger_date, trade_id, pnl_pct ROWS UNBOUNDED PRECEDING) AS run FROM t),
  v AS (SELECT setup_id, run, g, count(*) AS k FROM u GROUP BY 1, 2, 3)
  SELECT setup_id, coalesce(max(k) FILTER (g = 1), 0) AS longest_win, coalesce(max(k) FILTER (g = -1), 0) AS longest_loss FROM v GROUP BY setup_id""")
def win_loss_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.streaks(trades(spark, sf_dir), ["setup_id"], ["trigger_date", "trade_id", "pnl_pct"], "pnl_pct")


RET = f"SELECT ticker, date, px_last / lag(px_last) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM ({BARS})"


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date")
    return bars(spark, sf_dir).select("ticker", "date", (F.col("px_last") / F.lag("px_last").over(w) - 1).alias("ret"))


@query(f"""WITH x AS ({RET}), m AS (SELECT a.ticker, a.ret AS y, b.ret AS x FROM x a JOIN x b ON b.date = a.date AND b.ticker = 'NO' WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL),
  g AS (SELECT ticker, covar_samp(y, x) / var_samp(x) AS beta FROM m GROUP BY ticker)
  SELECT ticker, {r('any_value(beta)', 5)} AS beta, {r('avg(y - beta * x) * 252', 4)} AS alpha, {r('stddev_samp(y - x) * sqrt(252)', 4)} AS tracking_error,
    {r('CASE WHEN stddev_samp(y - x) > 1e-12 THEN avg(y - x) * sqrt(252) / stddev_samp(y - x) END', 5)} AS information_ratio FROM m JOIN g USING (ticker) GROUP BY ticker""")
def benchmark_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = returns(spark, sf_dir)
    b = x.where("ticker = 'NO'").select("date", F.col("ret").alias("bench"))
    return rounded(ledger.regression_on(x.join(b, "date"), ["ticker"], "ret", "bench"), 5, alpha=4, tracking_error=4)


@query(f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY setup_id ORDER BY trigger_date, trade_id, exit_date NULLS LAST) AS k FROM ({TRADES})),
  w AS (SELECT setup_id, k, trade_id, true AS kept, coalesce(exit_date, trigger_date + 3650) + 5 AS until FROM t WHERE k = 1
    UNION ALL SELECT t.setup_id, t.k, t.trade_id, t.trigger_date > w.until, CASE WHEN t.trigger_date > w.until THEN coalesce(t.exit_date, t.trigger_date + 3650) + 5 ELSE w.until END
    FROM w JOIN t ON t.setup_id = w.setup_id AND t.k = w.k + 1)
  SELECT setup_id, count(*) AS kept FROM w WHERE kept GROUP BY setup_id""")
def exclusive_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of each setup that don't overlap an earlier kept one and its cooldown."""
    return ledger.exclusive(trades(spark, sf_dir), ["setup_id"], 5).groupBy("setup_id").agg(F.count("*").alias("kept"))


@query(f"""WITH k AS (SELECT substr(sha256(concat_ws('|', CAST(setup_id AS VARCHAR), ticker, CAST(trigger_date AS VARCHAR), CAST(horizon AS VARCHAR))), 1, 16) AS key, pnl_dollars, capital FROM ({TRADES}))
  SELECT key, count(*) AS n, {r('sum(pnl_dollars)', 3)} AS pnl, {r('sum(capital)', 3)} AS capital FROM k GROUP BY key HAVING count(*) > 1""")
def merged_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of equal key merged by sums."""
    parts = [F.col(c).cast("string") for c in ("setup_id", "ticker", "trigger_date", "horizon")]
    k = trades(spark, sf_dir).withColumn("key", ledger.trade_key(*parts))
    g = k.groupBy("key").agg(F.count("*").alias("n"), F.sum("pnl_dollars").alias("pnl"), F.sum("capital").alias("capital"))
    return rounded(g.where("n > 1"), 3)


# forecasts


EDGES = (-2.0, -0.5, -0.2, -0.05, 0.05, 0.2, 0.5, 2.0)
N_BANDS = len(EDGES) - 1


def _band_sql(x: str) -> str:
    cases = " ".join(
        f"WHEN {x} >= {a} AND ({x} < {b}{f' OR {x} = {b}' if k == N_BANDS - 1 else ''}) THEN {k}" for k, (a, b) in enumerate(zip(EDGES, EDGES[1:]))
    )
    return f"CASE {cases} END"


def forecast_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed forward returns of even positions, with the forecast made from odd ones."""
    f = forward_returns(spark, sf_dir).where(F.col("fwd").isNotNull())
    fit = scoring.histogram(f.where("pos % 2 = 1"), ["ticker"], "fwd", EDGES).select("ticker", scoring.smoothed(F.col("probs")).alias("probs"))
    return f.where("pos % 2 = 0").join(fit, "ticker")


FIT = f"""(WITH f AS (SELECT *, {_band_sql('fwd')} AS band FROM ({forward_sql()}) WHERE fwd IS NOT NULL),
  c AS (SELECT ticker, pos % 2 AS odd, band, count(*) AS k FROM f WHERE band IS NOT NULL GROUP BY ALL),
  g AS (SELECT t.ticker, t.odd, b.band, coalesce(k, 0) AS k, sum(coalesce(k, 0)) OVER (PARTITION BY t.ticker, t.odd) AS n
    FROM (SELECT DISTINCT ticker, odd FROM c) t CROSS JOIN (SELECT unnest(range(0, {N_BANDS})) AS band) b LEFT JOIN c ON c.ticker = t.ticker AND c.odd = t.odd AND c.band = b.band)
  SELECT ticker, odd, band, k * 1e0 / n AS share, (k * 1e0 / n + 1e-6) / sum(k * 1e0 / n + 1e-6) OVER (PARTITION BY ticker, odd) AS p FROM g)"""
EDGE_SQL = f"(SELECT * FROM (VALUES {', '.join(f'({k}, {a}e0, {b}e0)' for k, (a, b) in enumerate(zip(EDGES, EDGES[1:])))}) e(band, low, high))"


@query(f"""WITH p AS (SELECT f.ticker, f.band, low, high, p, sum(p) OVER (PARTITION BY f.ticker ORDER BY f.band) AS top FROM {FIT} f JOIN {EDGE_SQL} e ON e.band = f.band WHERE odd = 1),
  y AS (SELECT ticker, pos, least(greatest(fwd, {EDGES[0]}), {EDGES[-1]}) AS y FROM ({forward_sql()}) WHERE fwd IS NOT NULL AND pos % 2 = 0),
  c AS (SELECT y.ticker, y.pos, sum((high - low) * (CASE WHEN p > 1e-12 THEN (power(top - p + p * u, 3) - power(top - p, 3)) / (3 * p) ELSE power(top - p, 2) * u END
     + CASE WHEN p > 1e-12 THEN (power(top - 1, 3) - power(top - p + p * u - 1, 3)) / (3 * p) ELSE power(top - p - 1, 2) * (1 - u) END)) AS s
    FROM (SELECT y.*, p.*, least(greatest((y.y - low) / (high - low), 0), 1) AS u FROM y JOIN p USING (ticker)) y GROUP BY 1, 2),
  q AS (SELECT ticker, arg_min(low + (0.1 - (top - p)) / p * (high - low), band) FILTER (top >= 0.1 - 1e-12) AS q10, arg_min(low + (0.9 - (top - p)) / p * (high - low), band) FILTER (top >= 0.9 - 1e-12) AS q90 FROM p GROUP BY ticker),
  l AS (SELECT f.ticker, avg(CASE WHEN fwd >= q10 THEN 0.9 * (fwd - q10) ELSE 0.1 * (q10 - fwd) END) AS pin10, avg(CASE WHEN fwd >= q90 THEN 0.1 * (fwd - q90) ELSE 0.9 * (q90 - fwd) END) AS pin90
    FROM ({forward_sql()}) f JOIN q USING (ticker) WHERE fwd IS NOT NULL AND pos % 2 = 0 GROUP BY 1)
  SELECT ticker, {r('avg(s)', 5)} AS crps, {r('any_value(pin10)', 5)} AS pin10, {r('any_value(pin90)', 5)} AS pin90, {r('any_value(q10)', 5)} AS q10, {r('any_value(q90)', 5)} AS q90
  FROM c JOIN l USING (ticker) JOIN q USING (ticker) GROUP BY ticker""")
def forecast_crps_pinball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRPS and quantile losses of each ticker's banded forecast on the other half of its days."""
    f = forecast_rows(spark, sf_dir)
    q = {n: scoring.quantile_from_bands("probs", EDGES, v) for n, v in (("q10", 0.1), ("q90", 0.9))}
    f = f.withColumns({"s": scoring.crps("probs", "fwd", EDGES), **q})
    out = f.groupBy("ticker").agg(
        F.avg("s").alias("crps"),
        F.avg(scoring.pinball(F.col("fwd"), F.col("q10"), 0.1)).alias("pin10"),
        F.avg(scoring.pinball(F.col("fwd"), F.col("q90"), 0.9)).alias("pin90"),
        F.first("q10").alias("q10"),
        F.first("q90").alias("q90"),
    )
    return rounded(out, 5)


@query(f"""WITH a AS (SELECT ticker, band, p FROM {FIT} WHERE odd = 1), b AS (SELECT ticker, band, share FROM {FIT} WHERE odd = 0),
  j AS (SELECT ticker, band, p, share, high - low AS width, sum(p - share) OVER (PARTITION BY ticker ORDER BY band) AS gap FROM a JOIN b USING (ticker, band) JOIN {EDGE_SQL} USING (band))
  SELECT ticker, {r('sum(abs(p - share)) / count(*)')} AS calibration_mae, {r('sum(abs(gap) * width)')} AS wasserstein,
    {r('-sum(greatest(p, 1e-12) * ln(greatest(p, 1e-12)))')} AS entropy, {r('sum(CASE WHEN share > 0 THEN share * ln(share / greatest(p, 1e-12)) ELSE 0 END)')} AS info_gain FROM j GROUP BY ticker""")
def forecast_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of each forecast to what was observed."""
    f = forward_returns(spark, sf_dir).where(F.col("fwd").isNotNull())
    fit = scoring.histogram(f.where("pos % 2 = 1"), ["ticker"], "fwd", EDGES).select("ticker", scoring.smoothed(F.col("probs")).alias("p"))
    seen = scoring.histogram(f.where("pos % 2 = 0"), ["ticker"], "fwd", EDGES).select("ticker", F.col("probs").alias("o"))
    p, o = F.col("p"), F.col("o")
    return rounded(
        fit.join(seen, "ticker").select(
            "ticker", scoring.calibration_mae(p, o).alias("calibration_mae"), scoring.wasserstein(p, o, EDGES).alias("wasserstein"),
            scoring.entropy(p).alias("entropy"), scoring.kl(o, p).alias("info_gain"),
        )
    )


PROB = "SELECT CAST(quality AS DOUBLE) AS y, (doc_id * 7919 % 1000) / 1000e0 AS p FROM labels"


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select(F.col("quality").alias("y"), ((F.col("doc_id") * 7919 % 1000) / 1000.0).alias("p"))


@query(f"""WITH x AS ({PROB}), b AS (SELECT least(CAST(floor(p * 10) AS INT), 9) AS bin, count(*) AS n, avg(p) AS m, avg(y) AS o, (sum(y) + 0.5) / (count(*) + 1) AS s FROM x GROUP BY 1)
  SELECT bin, n, {r('m')} AS mean_pred, {r('o')} AS observed, {r('s')} AS smoothed FROM b""")
def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.reliability(probs(spark, sf_dir), "y", "p"))


@query(f"""WITH x AS ({PROB}), b AS (SELECT count(*) AS n, abs((sum(y) + 0.5) / (count(*) + 1) - avg(p)) AS g FROM x GROUP BY least(CAST(floor(p * 10) AS INT), 9)),
  l AS (SELECT avg(power(p - y, 2)) AS brier, -avg(y * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1 - y) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12))) AS log_loss FROM x),
  k AS (SELECT max(greatest(row_number * 1e0 / n - p, p - (row_number - 1) * 1e0 / n)) AS ks FROM (SELECT p, row_number() OVER (ORDER BY p) AS row_number, count(*) OVER () AS n FROM x))
  SELECT {r('sum(g * n) / sum(n)')} AS ece, {r('max(g)')} AS mce, {r('any_value(brier)')} AS brier, {r('any_value(log_loss)')} AS log_loss, {r('any_value(ks)')} AS ks FROM b, l, k""")
def binary_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = probs(spark, sf_dir)
    ks = scoring.ks_uniform(x.withColumn("one", F.lit(1)), "p", ["one"]).select("ks")
    return rounded(scoring.calibration(x, "y", "p").crossJoin(ks))


def _cell(c: str, bins: int) -> str:
    low, high = f"min({c}) OVER (PARTITION BY ticker)", f"max({c}) OVER (PARTITION BY ticker)"
    return f"least(CAST(floor(({c} - {low}) / ({high} - {low}) * {bins}) AS INT), {bins - 1})"


TWO = f"SELECT b.ticker, b.date, b.volume AS x, x.ret AS y FROM ({BARS}) b JOIN ({RET}) x ON x.ticker = b.ticker AND x.date = b.date WHERE x.ret IS NOT NULL"


def two(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = bars(spark, sf_dir).select("ticker", "date", F.col("volume").alias("x"))
    return v.join(returns(spark, sf_dir).where("ret is not null").withColumnRenamed("ret", "y"), ["ticker", "date"])


@query(f"""WITH c AS (SELECT ticker, {_cell('x', 16)} AS a, {_cell('y', 16)} AS b FROM ({TWO})),
  k AS (SELECT t.ticker, i.a, j.b, count(c.a) + 1 AS k FROM (SELECT DISTINCT ticker FROM c) t CROSS JOIN (SELECT CAST(unnest(range(16)) AS INT) AS a) i CROSS JOIN (SELECT CAST(unnest(range(16)) AS INT) AS b) j
    LEFT JOIN c ON c.ticker = t.ticker AND c.a = i.a AND c.b = j.b GROUP BY 1, 2, 3),
  p AS (SELECT *, k * 1e0 / sum(k) OVER (PARTITION BY ticker) AS p, sum(k) OVER (PARTITION BY ticker, a) * 1e0 / sum(k) OVER (PARTITION BY ticker) AS pa, sum(k) OVER (PARTITION BY ticker, b) * 1e0 / sum(k) OVER (PARTITION BY ticker) AS pb FROM k)
  SELECT ticker, {r('sum(p * ln(p / (pa * pb)))')} AS mi FROM p GROUP BY ticker""")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.mutual_information(two(spark, sf_dir), ["ticker"], "x", "y"))


@query(f"""WITH c AS (SELECT ticker, date, {_cell('x', 4)} AS xb, {_cell('y', 4)} AS yb FROM ({TWO})),
  l AS (SELECT ticker, yb AS now, lag(yb) OVER w AS was, lag(xb) OVER w AS src FROM c WINDOW w AS (PARTITION BY ticker ORDER BY date)),
  g AS (SELECT CAST(unnest(range(4)) AS INT) AS v), t AS (SELECT DISTINCT ticker FROM c),
  k AS (SELECT t.ticker, a.v AS now, b.v AS was, s.v AS src, count(l.now) + 1 AS k FROM t CROSS JOIN g a CROSS JOIN g b CROSS JOIN g s
    LEFT JOIN l ON l.ticker = t.ticker AND l.now = a.v AND l.was = b.v AND l.src = s.v GROUP BY ALL),
  p AS (SELECT *, sum(k) OVER (PARTITION BY ticker) AS n, sum(k) OVER (PARTITION BY ticker, was, src) AS ws, sum(k) OVER (PARTITION BY ticker, now, was) AS nw, sum(k) OVER (PARTITION BY ticker, was) AS ww FROM k)
  SELECT ticker, {r('sum(k * 1e0 / n * log2(k * ww * 1e0 / (ws * nw)))')} AS te FROM p GROUP BY ticker""")
def transfer_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.transfer_entropy(two(spark, sf_dir), ["ticker"], "date", "x", "y"))


# signals


def _feat(engine: str) -> tuple[Series, dict]:
    s = Series(("ticker",), "date", engine)
    out = {}
    for c in ("px_last", "volume"):
        out |= {f"{c}_value": c, f"{c}_share": R.share_below(s, c, 60), f"{c}_z": R.zscore(s, c, 60)}
    return s, out


def _feat_sql() -> str:
    s, out = _feat("duckdb")
    text = s.text(BARS, ["ticker", "date"], out, 6)
    return " UNION ALL ".join(f"SELECT ticker, date, '{c}' AS feature, {c}_share AS share, {c}_z AS z FROM ({text})" for c in ("px_last", "volume"))


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, out = _feat("spark")
    df = s.spark(bars(spark, sf_dir), ["ticker", "date"], out, 6)
    long = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}_share").alias("share"), F.col(f"{c}_z").alias("z")) for c in ("px_last", "volume")))
    return df.select("ticker", "date", F.explode(long).alias("f")).select("ticker", "date", "f.*")


FIRED = " UNION ALL ".join(f"SELECT ticker, date, feature, '{n}' AS rule FROM feats WHERE {test}" for n, _, test in signals.RULES)


@query(f"WITH feats AS ({_feat_sql()}), fired AS ({FIRED}) SELECT feature, rule, count(*) AS n, count(DISTINCT ticker) AS tickers, min(date) AS first_day, max(date) AS last_day FROM fired GROUP BY 1, 2")
def compiled_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rule table compiles to."""
    f = signals.compile_rules(feature_rows(spark, sf_dir))
    return f.groupBy("feature", "rule").agg(
        F.count("*").alias("n"), F.count_distinct("ticker").alias("tickers"), F.min("date").alias("first_day"), F.max("date").alias("last_day")
    )


@query(f"""WITH feats AS ({_feat_sql()}), fired AS ({FIRED}), i AS (SELECT feature, rule, format('SIG_{{:05d}}', row_number() OVER (ORDER BY feature, rule) - 1) AS signal_id FROM (SELECT DISTINCT feature, rule FROM fired)),
  d AS (SELECT ticker, date FROM fired JOIN i USING (feature, rule) WHERE signal_id IN ('SIG_00000', 'SIG_00004') GROUP BY 1, 2 HAVING count(DISTINCT signal_id) = 2)
  SELECT ticker, count(*) AS days, min(date) AS first_day FROM d GROUP BY ticker""")
def setup_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which all signals of a setup fire."""
    f = signals.compile_rules(feature_rows(spark, sf_dir))
    named = f.join(F.broadcast(signals.signal_ids(f)), ["feature", "rule"])
    d = signals.all_of(named, ["SIG_00000", "SIG_00004"])
    return d.groupBy("ticker").agg(F.count("*").alias("days"), F.min("date").alias("first_day"))


@query(f"""WITH feats AS ({_feat_sql()}), x AS (SELECT ticker, date, coalesce(z > 0.5, false) AS f FROM feats WHERE feature = 'volume'),
  t AS (SELECT *, CASE WHEN f AND NOT coalesce(lag(f) OVER (PARTITION BY ticker ORDER BY date), false) THEN 1 ELSE 0 END AS turn FROM x),
  u AS (SELECT *, sum(turn) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM t),
  v AS (SELECT *, row_number() OVER (PARTITION BY ticker, run ORDER BY date) AS k FROM u) SELECT ticker, date FROM v WHERE f AND (k - 1) % 5 = 0""")
def rising_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = feature_rows(spark, sf_dir).where("feature = 'volume'").select("ticker", "date", (F.col("z") > 0.5).alias("f"))
    return signals.rising_edges(f, ["ticker"], "date", "f").select("ticker", "date")


# splits


@query(f"""SELECT date, unnest(list_filter([CASE isodow(date) WHEN 1 THEN 'monday' WHEN 5 THEN 'friday' WHEN 2 THEN 'midweek' WHEN 3 THEN 'midweek' WHEN 4 THEN 'midweek' END,
  CASE WHEN row_number() OVER (PARTITION BY year(date), month(date) ORDER BY date DESC) <= 3 THEN 'month_end' ELSE 'non_month_end' END], lambda h: h IS NOT NULL)) AS holdout FROM ({DAYS})""")
def calendar_holdouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.calendar_holdouts(days(spark, sf_dir))


@query(f"""WITH c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k, count(*) OVER () AS n FROM ({DAYS})), n AS (SELECT max(n) AS n FROM c),
  f AS (SELECT CAST(unnest(range(0, 1000)) AS INT) AS number, n FROM n), g AS (SELECT number, 257 + 63 * number AS a, least(257 + 63 * number + 63, n) AS e, n FROM f WHERE 257 + 63 * number + 5 <= n AND (number = 0 OR 257 + 63 * number < n)),
  h AS (SELECT number, (SELECT date FROM c WHERE k = 0) AS train_start, p.date AS train_end, s.date AS test_start, x.date AS test_end, 5 AS purge_days, 21 AS embargo_days, e = g.n AS is_tail
    FROM g JOIN c p ON p.k = a - 6 JOIN c s ON s.k = a JOIN c x ON x.k = e - 1),
  t AS (SELECT number, count(*) AS test_trades FROM h JOIN ({TRADES}) ON trigger_date BETWEEN test_start AND test_end GROUP BY number)
  SELECT h.*, 'PAWF_v1|OUTER:' || strftime(test_start, '%Y%m') || '|H:5|E:63|P:5|EMB:21|REG:R0' AS split_id, test_trades FROM h LEFT JOIN t USING (number)""")
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored folds of the calendar with the trades in each test window."""
    cal = [row.date for row in days(spark, sf_dir).orderBy("date").toLocalIterator()]
    folds = splits.as_table(spark, splits.anchored_folds(cal, 5, 63))
    t = trades(spark, sf_dir).select("trigger_date", "pnl_pct")
    counts = joins.members(t, folds.select("number", "test_start", "test_end"), "trigger_date", "test_start", "test_end")
    n = counts.groupBy("number").agg(F.count("*").alias("test_trades"))
    return folds.join(n, "number", "left")


# options


TIER = "CASE WHEN s < 25 THEN 0.5 WHEN s < 50 THEN 1e0 WHEN s < 200 THEN 2.5 WHEN s < 500 THEN 5e0 ELSE 10e0 END"
EXP = """CASE WHEN d <= 10 THEN CAST(floor((d + 3) / 7e0) * 7 AS INT) WHEN d <= 45 THEN CASE WHEN d < 32 THEN 21 WHEN d < 53 THEN 42 ELSE 63 END
  WHEN d <= 63 THEN 63 WHEN d <= 126 THEN 126 ELSE 189 END"""


@query(f"""SELECT p_partkey, {r('least(greatest(round_even(s / ' + TIER + ', 0) * ' + TIER + ', s * 0.5), s * 1.5)', 4)} AS strike, {EXP} AS expiry,
  {r('CASE WHEN iv > 0 THEN least(greatest(CASE WHEN iv > 2 THEN iv / 100 ELSE iv END, 2e-4), 5e0) END')} AS iv,
  {r('CASE WHEN a <= 0.10 THEN 0.3 WHEN a <= 0.25 THEN 0.3 + (0.25 - 0.3) * (a - 0.10) / 0.15 WHEN a <= 0.40 THEN 0.25 + (0.22 - 0.25) * (a - 0.25) / 0.15 ELSE 0.22 END')} AS smile
  FROM (SELECT p_partkey, p_retailprice AS s, p_size + greatest(5, CAST(floor(p_size / 4e0) AS INT)) AS d, p_size / 10e0 - 0.3 AS iv, p_size / 100e0 AS a FROM part)""")
def option_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strike, expiry and volatility conventions."""
    s, n = F.col("p_retailprice"), F.col("p_size")
    q = [F.lit(v) for v in (0.3, 0.25, 0.22)]
    out = read(spark, sf_dir, "part").select(
        "p_partkey", options.listed_strike(s, s).alias("strike"), options.expiry_days(n).cast("int").alias("expiry"),
        options.clean_iv(n / 10.0 - 0.3).alias("iv"), options.smile_iv(n / 100.0, *q).alias("smile"),
    )
    return rounded(out, 6, strike=4)


def normal_sql(x: str) -> str:
    """The normal distribution by the same published approximation."""
    a, t = f"abs({x})", f"(1 / (1 + 0.2316419 * abs({x})))"
    poly = f"({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    upper = f"exp(-{a} * {a} / 2) / sqrt(2 * pi()) * {poly}"
    return f"CASE WHEN {x} >= 0 THEN 1 - {upper} ELSE {upper} END"


def price_sql(s: str, k: str, t: str, v: str, rate: str = "0") -> str:
    """Call price: spot, strike, years, volatility, rate."""
    d1 = f"((ln({s} / {k}) + ({rate} + {v} * {v} / 2) * {t}) / ({v} * sqrt({t})))"
    return f"({s} * ({normal_sql(d1)}) - {k} * exp(-{rate} * {t}) * ({normal_sql(f'({d1} - {v} * sqrt({t}))')}))"


# 25 % quantile of the normal distribution
Q25 = -0.6744897501960817


@query(f"""WITH x AS (SELECT p_partkey, p_retailprice AS s, p_retailprice * 1.02 AS k, p_size / 252e0 AS t FROM part),
  y AS (SELECT *, {price_sql('s', 'k', 't', '0.25', '0.01')} AS call, (ln(s / k) + (0.01 + 0.25 * 0.25 / 2) * t) / (0.25 * sqrt(t)) AS d1 FROM x)
  SELECT p_partkey, {r('call', 4)} AS call, {r('call - s + k * exp(-0.01 * t)', 4)} AS put, {r(normal_sql('d1'), 4)} AS delta,
    {r(f'least(greatest(s * exp((0.01 + 0.25 * 0.25 / 2) * t - 0.25 * sqrt(t) * {Q25}), 0.2 * s), 5 * s)', 4)} AS strike_25 FROM y""")
def option_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, deltas and delta strikes over the parts."""
    p = read(spark, sf_dir, "part")
    s, k, t, v, zero = F.col("p_retailprice"), F.col("p_retailprice") * 1.02, F.col("p_size") / 252.0, F.lit(0.25), F.lit(0.01)
    strike = options.strike_for_delta(s, F.lit(0.25), t, zero, v, F.lit(True))
    out = p.select(
        "p_partkey", options.price(s, k, t, zero, v, F.lit(True)).alias("call"), options.price(s, k, t, zero, v, F.lit(False)).alias("put"),
        options.delta(s, k, t, zero, v, F.lit(True)).alias("delta"), strike.alias("strike_25"),
    )
    return rounded(out, 4)


STEP = "CASE WHEN s0 < 25 THEN 0.5 WHEN s0 < 50 THEN 1e0 WHEN s0 < 200 THEN 2.5 WHEN s0 < 500 THEN 5e0 ELSE 10e0 END"


@query(f"""WITH b AS (SELECT ticker, date, px_last, row_number() OVER (PARTITION BY ticker ORDER BY date) AS pos, CASE WHEN iv3mc > 0 THEN least(greatest(CASE WHEN iv3mc > 2 THEN iv3mc / 100 ELSE iv3mc END, 2e-4), 5e0) END AS v FROM ({BARS})),
  e AS (SELECT f.ticker, b.pos, f.date AS trigger_date, px_last AS s0, v FROM ({_feat_sql()}) f JOIN b ON b.ticker = f.ticker AND b.date = f.date WHERE feature = 'volume' AND z > 2),
  k AS (SELECT *, least(greatest(round_even(s0 / {STEP}, 0) * {STEP}, s0 * 0.5), s0 * 1.5) AS strike FROM e),
  m AS (SELECT k.ticker, k.pos, k.trigger_date, s0, strike, b.pos - k.pos AS step, b.px_last AS px, b.v AS iv, (63 - (b.pos - k.pos)) / 252e0 AS t FROM k JOIN b ON b.ticker = k.ticker AND b.pos BETWEEN k.pos AND k.pos + 10),
  p AS (SELECT *, {price_sql('px', 'strike', 't', 'iv')} AS mark FROM m), g AS (SELECT *, first(mark) OVER (PARTITION BY ticker, pos ORDER BY step) AS entry_price FROM p),
  h AS (SELECT *, mark / entry_price - 1 AS gain, CASE WHEN mark / entry_price - 1 >= 1.5 THEN 'profit_target' WHEN mark / entry_price - 1 <= -0.8 THEN 'stop_loss'
      WHEN 1 - step / 63e0 <= 0.1 AND mark / entry_price - 1 >= 0.4 THEN 'near_expiry' WHEN step = 10 THEN 'max_horizon' END AS rule FROM g),
  x AS (SELECT ticker, pos, arg_min(struct_pack(step := step, rule := rule, mark := mark, gain := gain), step) AS x FROM h WHERE step > 0 AND rule IS NOT NULL GROUP BY 1, 2)
  SELECT h.ticker, CAST(h.pos AS INT) AS pos, h.trigger_date, {r('h.s0', 4)} AS s0, {r('h.strike', 4)} AS strike, {r('h.entry_price', 4)} AS entry_price, CAST(x.x.step AS INT) AS exit_step, x.x.rule AS exit_reason,
    {r('x.x.mark', 4)} AS exit_price, {r('x.x.gain', 4)} AS pnl_pct, CAST(floor(1000 / greatest(h.entry_price, 1e-9)) AS BIGINT) AS contracts, {r('(x.x.mark - h.entry_price) * floor(1000 / greatest(h.entry_price, 1e-9))', 4)} AS pnl_dollars
  FROM h LEFT JOIN x ON x.ticker = h.ticker AND x.pos = h.pos WHERE h.step = 0""")
def option_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades simulated from volume breakouts."""
    w = Window.partitionBy("ticker").orderBy("date")
    b = bars(spark, sf_dir).select("ticker", "date", "px_last", F.col("iv3mc").alias("iv"), F.row_number().over(w).alias("pos"))
    f = feature_rows(spark, sf_dir).where("feature = 'volume' and z > 2").select("ticker", "date")
    return rounded(options.simulate(f.join(b.select("ticker", "date", "pos"), ["ticker", "date"]), b, 10), 4)


# search


OBJ = f"""SELECT setup_id, ticker, {r('avg(pnl_pct)')} AS a, {r('-stddev_samp(pnl_pct)')} AS b, count(*) * 1e0 AS c FROM ({TRADES}) GROUP BY setup_id, ticker"""


def objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trades(spark, sf_dir).groupBy("setup_id", "ticker").agg(
        F.avg("pnl_pct").alias("a"), (-F.stddev_samp("pnl_pct")).alias("b"), F.count("*").cast("double").alias("c")
    )
    return rounded(g)


@query(f"""WITH o AS ({OBJ}) SELECT * FROM o x WHERE NOT EXISTS (SELECT 1 FROM o y WHERE y.a >= x.a AND y.b >= x.b AND y.c >= x.c AND (y.a > x.a OR y.b > x.b OR y.c > x.c))""")
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Setups that none dominates."""
    return search.skyline(objectives(spark, sf_dir).where("b is not null"), ["a", "b", "c"])


@query(f"""WITH o AS (SELECT * FROM ({OBJ}) WHERE b IS NOT NULL),
  g AS (SELECT *, lead(a) OVER wa - lag(a) OVER wa AS ga, lead(b) OVER wb - lag(b) OVER wb AS gb, max(a) OVER p - min(a) OVER p AS ra, max(b) OVER p - min(b) OVER p AS rb
    FROM o WINDOW wa AS (PARTITION BY ticker ORDER BY a, setup_id), wb AS (PARTITION BY ticker ORDER BY b, setup_id), p AS (PARTITION BY ticker))
  SELECT setup_id, ticker, {r('CASE WHEN ra > 0 THEN ga / ra WHEN ga IS NOT NULL THEN 0 END + CASE WHEN rb > 0 THEN gb / rb WHEN gb IS NOT NULL THEN 0 END')} AS crowding FROM g""")
def crowding_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objectives(spark, sf_dir).where("b is not null")
    return rounded(search.crowding(o, "ticker", ["a", "b"], "setup_id").select("setup_id", "ticker", "crowding"))


@query()
def evolved_setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two islands of setups evolved on trade statistics; each generation is one aggregation."""
    f = signals.compile_rules(feature_rows(spark, sf_dir))
    fwd = forward_returns(spark, sf_dir).select("ticker", "date", "fwd").where("fwd is not null")
    fired = f.select("ticker", "date", F.concat_ws(":", "feature", "rule").alias("signal_id")).join(fwd, ["ticker", "date"])
    stats = fired.groupBy("ticker", "date").agg(F.collect_set("signal_id").alias("ids"), F.first("fwd").alias("fwd")).persist()
    names = sorted(x.signal_id for x in fired.select("signal_id").distinct().collect())
    tickers = sorted(x.ticker for x in fwd.select("ticker").distinct().collect())

    def evaluate(people: list[search.Individual]) -> dict[str, tuple[float, ...]]:
        table = spark.createDataFrame([(p.dna, p.ticker, list(p.signals)) for p in people], "dna string, ticker string, signals array<string>")
        hits = stats.join(F.broadcast(table), "ticker").where(F.size(F.array_except("signals", "ids")) == 0)
        got = hits.groupBy("dna").agg(F.avg("fwd").alias("m"), F.count("*").alias("n")).collect()
        found = {x.dna: (float(x.m), float(np.log1p(x.n))) for x in got}
        return {p.dna: found.get(p.dna, (-999.0, -999.0)) for p in people}

    best = search.Evolution(search.Space(tickers, names), evaluate, size=16, generations=3, islands=2).run()
    scores = evaluate(best)
    stats.unpersist()
    rows = [(p.dna, p.ticker, list(p.signals), p.horizon, *scores[p.dna]) for p in best]
    return spark.createDataFrame(rows, "dna string, ticker string, signals array<string>, horizon int, mean double, support double")


# gates


AS_OF = date(1998, 12, 31)


@query(f"""WITH t AS ({TRADES}), d AS (SELECT setup_id, max(c) AS most_daily FROM (SELECT setup_id, trigger_date, count(*) AS c FROM t GROUP BY 1, 2) GROUP BY 1),
  g AS (SELECT setup_id, count(*) AS trades, sum(CASE WHEN DATE '{AS_OF}' - trigger_date BETWEEN 0 AND 365 THEN 1 ELSE 0 END) AS recent,
    avg(CASE WHEN pnl_pct > 0 THEN 1e0 ELSE 0e0 END) FILTER (DATE '{AS_OF}' - trigger_date BETWEEN 0 AND 365 AND exit_date IS NOT NULL) AS recent_win_rate,
    avg(CASE WHEN exit_date IS NULL THEN 1e0 ELSE 0e0 END) AS open_share, max(trigger_date) AS last_trigger FROM t GROUP BY 1),
  h AS (SELECT g.*, most_daily, CASE WHEN NOT trades >= 30 THEN 'S1_SUPPORT' WHEN NOT coalesce(recent >= 5, false) THEN 'S1_RECENCY' WHEN NOT coalesce(recent_win_rate >= 0.4, false) THEN 'S1_WIN_RATE'
    WHEN NOT most_daily <= 50 THEN 'S1_DAILY_CAP' WHEN NOT open_share <= 0.2 THEN 'S1_MISSING' END AS reject_1 FROM g JOIN d USING (setup_id))
  SELECT setup_id, trades, CAST(recent AS BIGINT) AS recent, {r('recent_win_rate')} AS recent_win_rate, {r('open_share')} AS open_share, last_trigger, most_daily, reject_1, reject_1 IS NULL AS pass_1 FROM h""")
def gate_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gates.health(trades(spark, sf_dir), AS_OF))


@query(f"""WITH t AS (SELECT * FROM ({TRADES}) WHERE exit_date IS NOT NULL), q AS (SELECT setup_id, fold, quantile_cont(pnl_pct, 0.05) AS q FROM t GROUP BY 1, 2),
  f AS (SELECT setup_id, fold, CASE WHEN stddev_samp(pnl_pct) > 1e-12 THEN avg(pnl_pct) / stddev_samp(pnl_pct) * sqrt(252) END AS sharpe, avg(pnl_pct) FILTER (pnl_pct <= q) AS cvar, count(*) AS support FROM t JOIN q USING (setup_id, fold) GROUP BY 1, 2),
  g AS (SELECT setup_id, quantile_cont(sharpe, 0.5) AS median_sharpe, quantile_cont(sharpe, 0.75) - quantile_cont(sharpe, 0.25) AS sharpe_iqr, quantile_cont(cvar, 0.5) AS median_cvar, min(sharpe) AS worst_sharpe,
    avg(CASE WHEN support >= 5 THEN 1e0 ELSE 0e0 END) AS support_rate, count(*) AS folds FROM f GROUP BY 1),
  h AS (SELECT *, CASE WHEN NOT coalesce(median_sharpe >= -1e-9, false) THEN 'S2_SHARPE' WHEN NOT coalesce(sharpe_iqr <= 20, false) THEN 'S2_SPREAD' WHEN NOT coalesce(abs(median_cvar) <= 0.6, false) THEN 'S2_TAIL' WHEN NOT support_rate >= 0.8 THEN 'S2_SUPPORT' END AS reject_2 FROM g)
  SELECT setup_id, {', '.join(f'{r(c, 5)} AS {c}' for c in ('median_sharpe', 'sharpe_iqr', 'median_cvar', 'worst_sharpe', 'support_rate'))}, folds, reject_2, reject_2 IS NULL AS pass_2 FROM h""")
def gate_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gates.fold_profit(trades(spark, sf_dir)), 5)


HALVES = f"""SELECT setup_id, {r('avg(pnl_pct) FILTER (trade_id % 2 = 0)')} AS a, {r('avg(pnl_pct) FILTER (trade_id % 2 = 1)')} AS b FROM ({TRADES}) GROUP BY setup_id"""


@query(f"""WITH h AS (SELECT * FROM ({HALVES}) WHERE a IS NOT NULL AND b IS NOT NULL), k AS (SELECT *, row_number() OVER (ORDER BY a DESC, setup_id) AS ra, row_number() OVER (ORDER BY b DESC, setup_id) AS rb, greatest(floor(count(*) OVER () * 0.25), 1) AS t FROM h)
  SELECT {r('1 - sum(CASE WHEN ra <= t AND rb <= t THEN 1e0 ELSE 0e0 END) / sum(CASE WHEN ra <= t THEN 1e0 ELSE 0e0 END)')} AS pbo, {r('corr(CAST(ra AS DOUBLE), CAST(rb AS DOUBLE))')} AS spearman, count(*) AS n FROM k""")
def gate_overfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, even = F.col("pnl_pct"), F.col("trade_id") % 2 == 0
    h = trades(spark, sf_dir).groupBy("setup_id").agg(F.avg(F.when(even, x)).alias("a"), F.avg(F.when(~even, x)).alias("b"))
    return rounded(gates.rank_overlap(rounded(h), "setup_id", "a", "b"))


@query(f"""WITH t AS ({TRADES}), live AS (SELECT DISTINCT trigger_date FROM t WHERE setup_id = 1), d AS (SELECT DISTINCT setup_id, trigger_date FROM t WHERE setup_id <> 1)
  SELECT setup_id, {r('avg(CASE WHEN live.trigger_date IS NOT NULL THEN 1e0 ELSE 0e0 END)')} AS overlap FROM d LEFT JOIN live USING (trigger_date) GROUP BY setup_id""")
def gate_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    return rounded(gates.overlap(t.where("setup_id <> 1"), t.where("setup_id = 1")))


@query(f"""WITH d AS (SELECT setup_id, trigger_date, median(pnl_pct) AS r FROM ({TRADES}) GROUP BY 1, 2),
  p AS (SELECT c.setup_id, l.setup_id AS live, count(*) AS n, CASE WHEN stddev_samp(c.r) * stddev_samp(l.r) > 1e-15 THEN covar_samp(c.r, l.r) / (stddev_samp(c.r) * stddev_samp(l.r)) END AS k
    FROM d c JOIN d l ON l.trigger_date = c.trigger_date AND l.setup_id <= 3 WHERE c.setup_id > 3 GROUP BY 1, 2)
  SELECT setup_id, {r('avg(abs(k))')} AS mean_abs_corr FROM p WHERE n >= 10 GROUP BY setup_id""")
def gate_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ledger.daily_by_trigger(trades(spark, sf_dir), ["setup_id"])
    live = d.where("setup_id <= 3").withColumnRenamed("setup_id", "live_id")
    return rounded(gates.mean_abs_corr(d.where("setup_id > 3"), live, "setup_id", "live_id", "trigger_date", "r"))


# selection and reports


@query(f"""WITH g AS (SELECT ticker, horizon, count(*) AS support, CASE WHEN stddev_samp(pnl_pct) > 1e-12 THEN avg(pnl_pct) / stddev_samp(pnl_pct) END AS sharpe,
    CASE WHEN -sum(least(pnl_pct, 0)) > 1e-12 THEN sum(greatest(pnl_pct, 0)) / -sum(least(pnl_pct, 0)) END AS omega FROM ({TRADES}) GROUP BY 1, 2 HAVING count(*) >= 20)
  SELECT ticker, horizon, support, {r('sharpe')} AS sharpe, {r('omega')} AS omega FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY sharpe DESC NULLS LAST, omega DESC NULLS LAST, support DESC, horizon) AS k FROM g) WHERE k = 1""")
def best_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.best_horizon(trades(spark, sf_dir), 20))


@query(f"""SELECT ticker, setup_id, a, c FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY a DESC, setup_id) AS k FROM ({OBJ})) WHERE k <= 5""")
def forecast_slate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best setups of each ticker."""
    return selection.top_k(objectives(spark, sf_dir), ["ticker"], [F.desc("a"), F.col("setup_id")], 5).select("ticker", "setup_id", "a", "c")


@query(f"""SELECT ticker, horizon, {', '.join(f'{r(sql, 4)} AS {n}' for n, sql in (('mean', 'avg(pnl_pct)'), ('median', 'median(pnl_pct)'), ('std', 'stddev_samp(pnl_pct)'), ('least', 'min(pnl_pct)'), ('most', 'max(pnl_pct)')))}, count(pnl_pct) AS count
  FROM ({TRADES}) GROUP BY 1, 2""")
def skill_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.breakdown(trades(spark, sf_dir), ["ticker", "horizon"], "pnl_pct"), 4)


@query(
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {r(f'quantile_cont({m}, 0.1)', 4)} AS p10, {r(f'quantile_cont({m}, 0.5)', 4)} AS p50, {r(f'quantile_cont({m}, 0.9)', 4)} AS p90 FROM ({TRADES})"
        for m in ("pnl_pct", "pnl_dollars", "capital")
    )
)
def quantile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.quantile_table(trades(spark, sf_dir), ["pnl_pct", "pnl_dollars", "capital"]), 4)


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {r(f'avg(CASE WHEN {c} IS NOT NULL THEN 1e0 ELSE 0e0 END)')} AS present FROM ({TRADES})" for c in ("exit_date", "pnl_pct")))
def metric_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.coverage(trades(spark, sf_dir), ["exit_date", "pnl_pct"]))


@query(f"""WITH feats AS ({_feat_sql()}), fired AS (SELECT DISTINCT date, rule AS signal_id FROM ({FIRED})), s(setup_id, signal_id) AS (VALUES (1, 'z_above'), (1, 'pctl_above_90'), (2, 'reversion_low'), (2, 'z_below'), (3, 'none')),
  w AS (SELECT date FROM (SELECT DISTINCT date FROM feats) ORDER BY date DESC LIMIT 21), h AS (SELECT s.setup_id, date, signal_id FROM fired JOIN s USING (signal_id) WHERE date IN (SELECT date FROM w)),
  z AS (SELECT setup_id, count(DISTINCT signal_id) AS size FROM s GROUP BY 1), d AS (SELECT setup_id, date, count(DISTINCT signal_id) AS n FROM h GROUP BY 1, 2),
  f AS (SELECT setup_id, max(CASE WHEN n = size THEN 1 ELSE 0 END) AS a, max(date) FILTER (n = size) AS latest_all, max(date) AS latest_any FROM d JOIN z USING (setup_id) GROUP BY 1),
  t AS (SELECT setup_id, count(*) AS c, count(DISTINCT signal_id) AS k FROM h GROUP BY 1)
  SELECT z.setup_id, c IS NOT NULL AS fired_any, coalesce(a = 1, false) AS fired_all, coalesce(c, 0) AS total_count, {r('coalesce(k, 0) * 1e0 / size')} AS strength, latest_any, latest_all FROM z LEFT JOIN t USING (setup_id) LEFT JOIN f USING (setup_id)""")
def trigger_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feature_rows(spark, sf_dir)
    fired = signals.compile_rules(rows).select("date", F.col("rule").alias("signal_id")).distinct()
    setups = spark.createDataFrame([(1, "z_above"), (1, "pctl_above_90"), (2, "reversion_low"), (2, "z_below"), (3, "none")], "setup_id int, signal_id string")
    return rounded(selection.trigger_map(fired, setups, rows, 21))


RECORDS = f"""SELECT setup_id, CAST(setup_id % 17 AS VARCHAR) AS fingerprint, {r('avg(pnl_pct) * 10')} AS prior, 1 + (setup_id % 5) / 10e0 AS penalty,
  DATE '{AS_OF}' - max(trigger_date) AS days_since, (setup_id % 4) / 4e0 AS strength, setup_id % 6 <> 0 AS fired_any FROM ({TRADES}) GROUP BY setup_id"""
RAW = "prior / greatest(penalty, 1) * least(greatest(power(0.5, days_since / 63e0), 0.2), 1) + 0.25 * strength"


@query(f"""WITH s AS (SELECT *, sign({RAW}) * ln(1 + abs({RAW})) AS score FROM ({RECORDS})), u AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY score DESC, setup_id) AS k FROM s WHERE fired_any AND score > 0),
  b AS (SELECT * FROM u WHERE k = 1 ORDER BY score DESC, setup_id LIMIT 8) SELECT setup_id, fingerprint, {r('score', 5)} AS score, {r('score / sum(score) OVER ()', 5)} AS size FROM b""")
def daily_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trades(spark, sf_dir).groupBy("setup_id").agg(F.avg("pnl_pct").alias("m"), F.max("trigger_date").alias("last"))
    s = F.col("setup_id")
    records = g.select(
        "setup_id", (s % 17).cast("string").alias("fingerprint"), (F.round(F.col("m") * 10 + NUDGE, 6) + 0.0).alias("prior"), (1 + (s % 5) / 10.0).alias("penalty"),
        F.datediff(F.lit(AS_OF), "last").alias("days_since"), ((s % 4) / 4.0).alias("strength"), (s % 6 != 0).alias("fired_any"),
    )
    best = selection.daily_selection(records, 8).select("setup_id", "fingerprint", "score", "size")
    return rounded(best, 5)


# kernels and resampling; checked in the tests


@query()
def complexity_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity of each ticker's returns."""
    return kernels.grouped(returns(spark, sf_dir).where("ret is not null"), ["ticker"], "date", "ret")


@query()
def hidden_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden states of each ticker's days and their mean returns."""

    def run(key, pdf):
        import pandas as pd

        x = pdf.sort_values("date")["ret"].to_numpy()
        s = kernels.hidden_states(np.c_[x, pd.Series(x).rolling(20, 1).std().fillna(0).to_numpy()])
        return pd.DataFrame({"ticker": key[0], "state": range(3), "days": [int((s == j).sum()) for j in range(3)], "mean_ret": [float(x[s == j].mean()) if (s == j).any() else None for j in range(3)]})

    rows = returns(spark, sf_dir).where("ret is not null")
    return rows.groupBy("ticker").applyInPandas(run, "ticker string, state int, days int, mean_ret double")


@query()
def bootstrap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratio of each ticker's daily returns with bootstrap bounds."""
    d = ledger.daily_by_trigger(trades(spark, sf_dir), ["ticker"])
    return ledger.bootstrap(d, ["ticker"], ["trigger_date"], "sharpe")


@query()
def stepwise_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Setups that raise the portfolio's Sharpe ratio one after the other."""
    d = ledger.daily_by_trigger(trades(spark, sf_dir), ["setup_id"])
    best = objectives(spark, sf_dir).groupBy("setup_id").agg(F.avg("a").alias("score")).orderBy(F.desc("score"), "setup_id").limit(10)
    ranked = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "setup_id")))
    return selection.stepwise(ranked, d, "setup_id", "place", "trigger_date", "r")


# forecasts read as trades, stability, feature scores, event studies


@query(f"""WITH p AS (SELECT ticker, f.band, low, high, p FROM {FIT} f JOIN {EDGE_SQL} e ON e.band = f.band WHERE odd = 1)
  SELECT ticker, {r('sum(p * (low + high) / 2)')} AS expected_move, {r('sum(p * least(greatest(high / (high - low), 0), 1))')} AS p_up,
    {r('sum(p) - sum(p * least(greatest(high / (high - low), 0), 1))')} AS p_down, {r('sum(p) FILTER (low >= 0.05)')} AS p_beyond FROM p GROUP BY ticker""")
def forecast_trade_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected move and direction of each ticker's forecast."""
    f = forward_returns(spark, sf_dir).where(F.col("fwd").isNotNull())
    fit = scoring.histogram(f.where("pos % 2 = 1"), ["ticker"], "fwd", EDGES).select("ticker", scoring.smoothed(F.col("probs")).alias("probs"))
    fields = scoring.trade_fields("probs", EDGES) | {"p_beyond": scoring.mass_between("probs", EDGES, 0.05, 2.0)}
    return rounded(fit.select("ticker", *(c.alias(n) for n, c in fields.items())))


@query(f"""WITH c AS (SELECT ticker, horizon, pnl_pct > 0 AS win, count(*) AS k FROM ({TRADES}) GROUP BY 1, 2, 3),
  p AS (SELECT ticker, k * 1e0 / sum(k) OVER (PARTITION BY ticker) AS p, k * 1e0 / sum(k) OVER (PARTITION BY ticker, horizon) AS q FROM c)
  SELECT ticker, {r('-sum(p * ln(q))')} AS conditional_entropy FROM p GROUP BY ticker""")
def outcome_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of winning given the horizon."""
    t = trades(spark, sf_dir).withColumn("win", F.col("pnl_pct") > 0)
    return rounded(scoring.conditional_entropy(t, ["ticker"], "horizon", "win"))


@query(f"""WITH l AS (SELECT ticker, (sum(pnl_pct) OVER (PARTITION BY ticker) - pnl_pct) / (count(*) OVER (PARTITION BY ticker) - 1) AS l FROM ({TRADES}))
  SELECT ticker, {r('avg(l)')} AS jack_mean, {r('stddev_samp(l)')} AS jack_std, count(*) AS n FROM l GROUP BY ticker""")
def jackknife(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(robustness.jackknife_mean(trades(spark, sf_dir), ["ticker"], "pnl_pct"))


FOLD_MEANS = f"SELECT setup_id, fold, {r('avg(pnl_pct)')} AS m FROM ({TRADES}) GROUP BY 1, 2"


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY m DESC, setup_id) * 1e0 AS r FROM ({FOLD_MEANS})),
  p AS (SELECT a.fold AS fold_a, b.fold AS fold_b, a.r AS ra, b.r AS rb FROM r a JOIN r b ON b.setup_id = a.setup_id AND a.fold < b.fold),
  f AS (SELECT *, lead(rb) OVER (PARTITION BY fold_a, fold_b ORDER BY ra) AS nb FROM p)
  SELECT fold_a, fold_b, {r('corr(ra, rb)')} AS spearman, {r('avg(CASE WHEN nb < rb THEN 1e0 WHEN nb IS NOT NULL THEN 0e0 END)')} AS flip_rate, count(*) AS n FROM f GROUP BY 1, 2""")
def rank_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the setups' order between years."""
    m = rounded(trades(spark, sf_dir).groupBy("setup_id", "fold").agg(F.avg("pnl_pct").alias("m")))
    return rounded(robustness.rank_stability(m, "setup_id", "fold", "m"))


@query(f"""WITH f AS (SELECT ticker, date, ret, ntile(5) OVER (PARTITION BY ticker ORDER BY date) AS fold FROM ({RET}) WHERE ret IS NOT NULL),
  k AS (SELECT *, row_number() OVER (PARTITION BY ticker, fold ORDER BY date) AS k FROM f), m AS (SELECT ticker, fold, avg(ret) AS m FROM k WHERE fold = 1 OR k > 3 GROUP BY 1, 2)
  SELECT ticker, {r('avg(m)', 4)} AS fold_mean, {r('stddev_samp(m)', 4)} AS fold_std, {r('CASE WHEN abs(avg(m)) > 1e-12 THEN stddev_samp(m) / abs(avg(m)) END', 4)} AS fold_cv FROM m GROUP BY ticker""")
def fold_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = returns(spark, sf_dir).where("ret is not null")
    return rounded(robustness.fold_variation(x, ["ticker"], "date", F.avg("ret"), 5, 3), 4)


@query(f"""WITH f AS ({_feat_sql()}), t AS (SELECT feature, f.ticker, f.date, CASE WHEN fwd IS NOT NULL THEN z END AS x, CASE WHEN z IS NOT NULL THEN fwd END AS y FROM f JOIN ({forward_sql()}) w ON w.ticker = f.ticker AND w.date = f.date),
  c AS (SELECT feature, count(x) OVER w AS n, stddev_samp(x) OVER w * stddev_samp(y) OVER w AS s, covar_samp(x, y) OVER w AS c FROM t WINDOW w AS (PARTITION BY feature, ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
  SELECT feature, {r('avg(CASE WHEN n >= 126 AND s > 1e-15 THEN abs(c / s) END)', 5)} AS score FROM c GROUP BY feature""")
def feature_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How closely features follow the next five bars' return."""
    f = feature_rows(spark, sf_dir).select("feature", "ticker", "date", F.col("z").alias("value"))
    t = forward_returns(spark, sf_dir).select("ticker", "date", F.col("fwd").alias("target"))
    return rounded(subspaces.score_features(f.join(t, ["ticker", "date"])), 5)


@query(f"""WITH v AS (SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1), e AS (SELECT day FROM v WHERE v > (SELECT quantile_cont(v, 0.9) FROM v)),
  b AS (SELECT ticker, date, px_open, px_last, lead(px_last, 5) OVER (PARTITION BY ticker ORDER BY date) AS later FROM ({BARS})),
  s AS (SELECT ticker, day, min(date) AS date FROM e JOIN b ON b.date BETWEEN e.day AND e.day + 7 GROUP BY 1, 2)
  SELECT s.ticker, count(*) AS n, {r('avg(px_last / px_open - 1)', 4)} AS same_day, {r('avg(later / px_open - 1)', 4)} AS five_days, {r('avg(CASE WHEN px_last > px_open THEN 1e0 ELSE 0e0 END)')} AS win_rate
  FROM s JOIN b ON b.ticker = s.ticker AND b.date = s.date GROUP BY s.ticker""")
def event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open to close returns of the first bar within a week of each event: days of which the orders' value is above nine tenths of all days'."""
    w = Window.partitionBy("ticker").orderBy("date")
    b = bars(spark, sf_dir).select("ticker", "date", "px_open", "px_last", F.lead("px_last", 5).over(w).alias("later"))
    v = read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    e = v.where(F.col("v") > v.agg(F.percentile("v", F.lit(0.9))).first()[0]).select("day")
    near = e.select("day", F.explode(F.sequence("day", F.date_add("day", 7))).alias("date"))
    hit = near.join(b, "date").groupBy("ticker", "day").agg(F.min_by(F.struct("px_open", "px_last", "later"), "date").alias("x"))
    o, c = F.col("x.px_open"), F.col("x.px_last")
    out = hit.groupBy("ticker").agg(
        F.count("*").alias("n"), F.avg(c / o - 1).alias("same_day"), F.avg(F.col("x.later") / o - 1).alias("five_days"),
        F.avg((c > o).cast("double")).alias("win_rate"),
    )
    return rounded(out, 4, win_rate=6)


@query()
def calibrated_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier scores of raw, isotonic and logistic probabilities on the labels."""
    x = probs(spark, sf_dir).withColumn("y", F.col("y").cast("double"))
    iso, log = models.isotonic(x, x, "y", "p"), models.platt(x, x, "y", "p")
    score = lambda df, c, name: df.agg(F.lit(name).alias("method"), F.avg((F.col(c) - F.col("y")) * (F.col(c) - F.col("y"))).alias("brier"))
    return rounded(score(x, "p", "raw").unionByName(score(iso, "calibrated", "isotonic")).unionByName(score(log, "calibrated", "logistic")), 5)


@query()
def mixture_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and mean volume of each ticker's regimes, by a mixture fitted on all its days."""
    w = Window.partitionBy("ticker").orderBy("date")
    rows = bars(spark, sf_dir).select("ticker", "date", "px_last", "volume", F.row_number().over(w).alias("pos"))
    rows = mixtures.features(rows, ["ticker"], "pos", "px_last")
    names = ["volatility", "trend"]
    fits = mixtures.aligned(mixtures.fit(rows, {0: 1 << 31}, ["ticker"], names, components=(3, 3)), ["ticker"])
    found = mixtures.assign(rows, fits, ["ticker"], names).where("regime is not null")
    return rounded(found.groupBy("ticker", "regime").agg(F.count("*").alias("days"), F.avg("volume").alias("mean_volume")), 3)


@query()
def sample_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well early and late trades can be told apart."""
    t = trades(spark, sf_dir).select("fold", F.col("pnl_pct"), F.col("capital").cast("double"), F.col("horizon").cast("double"))
    auc, weights = models.adversarial_auc(t.where("fold <= 1996"), t.where("fold > 1996"), ["pnl_pct", "capital", "horizon"], 10, 3, 2)
    rows = [(k, float(v), float(auc)) for k, v in weights.items()]
    return spark.createDataFrame(rows, "feature string, importance double, auc double")


# reports


@query(f"""WITH g AS (SELECT setup_id, count(*) AS trades_total, CAST(sum(CASE WHEN trigger_date > DATE '{AS_OF}' - 365 THEN 1 ELSE 0 END) AS BIGINT) AS trades_12m, CAST(sum(CASE WHEN trigger_date > DATE '{AS_OF}' - 182 THEN 1 ELSE 0 END) AS BIGINT) AS trades_6m,
    exp(sum(ln(1 + greatest(pnl_pct / 100, -0.95)))) - 1 AS growth, max(trigger_date) AS last_trigger FROM ({TRADES}) WHERE trigger_date <= DATE '{AS_OF}' GROUP BY setup_id)
  SELECT setup_id, trades_total, trades_12m, trades_6m, {r('growth')} AS growth, last_trigger, {r(f"least(greatest(power(0.5, (DATE '{AS_OF}' - last_trigger) / 63e0), 0.2), 1)")} AS recency FROM g""")
def prior_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.prior_records(trades(spark, sf_dir), AS_OF))


@query(f"""WITH t AS ({TRADES}), l AS (SELECT setup_id, max(struct_pack(a := trigger_date, b := trade_id, c := ticker, d := horizon, e := capital)) AS t FROM t GROUP BY setup_id)
  SELECT setup_id, t.c AS ticker, t.a AS trigger_date, t.b AS trade_id, t.d AS horizon, CAST((SELECT max(trigger_date) FROM t) - t.a AS INT) AS age FROM l WHERE (SELECT max(trigger_date) FROM t) - t.a < t.d""")
def open_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Setups whose last trade is younger than its horizon."""
    return reports.open_positions(trades(spark, sf_dir))


WD = "((datediff('day', DATE '1970-01-01', {0}) + 3) // 7 * 5 + least((datediff('day', DATE '1970-01-01', {0}) + 3) % 7, 5))"
SPAN = f"({WD.format('b + 1')} - {WD.format('a')})"


@query(f"""WITH c AS (SELECT ticker, trigger_date AS a, exit_date AS b FROM ({TRADES}) WHERE exit_date >= trigger_date), d AS (SELECT ticker, a, {SPAN} AS d FROM c),
  g AS (SELECT ticker, median(d) AS m, count(*) AS n, min(a) AS a, max(a) AS b FROM d GROUP BY ticker) SELECT ticker, {r('m')} AS median_days, {r(f'n * 1e0 / {SPAN}')} AS per_weekday FROM g""")
def holding_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.holding(trades(spark, sf_dir), ["ticker"]))


QUALITY = f"""SELECT ticker, setup_id, max(trigger_date) AS last_trigger, {r('avg(pnl_pct)')} AS quality FROM ({TRADES}) GROUP BY 1, 2"""


@query(f"""SELECT ticker, setup_id, last_trigger, quality FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY last_trigger DESC, quality DESC, setup_id) AS k FROM ({QUALITY})
  WHERE DATE '{AS_OF}' - last_trigger <= 3000 AND setup_id % 3 <> 0) WHERE k = 1""")
def tradeable_setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest approved setup of each ticker."""
    q = rounded(trades(spark, sf_dir).groupBy("ticker", "setup_id").agg(F.max("trigger_date").alias("last_trigger"), F.avg("pnl_pct").alias("quality")))
    return reports.tradeable(q, q.where("setup_id % 3 <> 0").select("setup_id").distinct(), AS_OF, F.lit(3000))


@query(f"""WITH t AS ({TRADES}) SELECT 'all' AS level, '' AS value, count(*) AS n, {r('avg(pnl_pct)')} AS mean, count(DISTINCT setup_id) AS setups FROM t
  UNION ALL SELECT 'ticker', ticker, count(*), {r('avg(pnl_pct)')}, count(DISTINCT setup_id) FROM t GROUP BY ticker
  UNION ALL SELECT 'horizon', CAST(horizon AS VARCHAR), count(*), {r('avg(pnl_pct)')}, count(DISTINCT setup_id) FROM t GROUP BY horizon""")
def eligibility_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill overall, by ticker and by horizon."""
    return rounded(reports.eligibility_summary(trades(spark, sf_dir), ["ticker", "horizon"], "pnl_pct"))


@query()
def cross_asset_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common movement of all tickers over the last 120 days, at every day."""
    from functools import partial

    wide = returns(spark, sf_dir).groupBy("date").pivot("ticker", ["AF", "AO", "NF", "NO", "RF", "RO"]).agg(F.first("ret"))
    suite = {"stability": kernels.stability, "tail": kernels.tail_correlation, "var": partial(kernels.portfolio_var, weights=np.full(6, 1 / 6))}
    return kernels.windowed_matrix(wide.na.fill(0.0), "date", ["AF", "AO", "NF", "NO", "RF", "RO"], 120, suite).orderBy(F.desc("date"))

"""Queries over the gauntlet's stages, supports, regimes and signal probabilities, each with SQL written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.series import NUDGE
from tidemark.operators import gauntlet, ledger, options, regimes, reports, robustness, scoring, signals, splits, support
from tidemark.plans.domain import TRADES, forward_returns, forward_sql, trades
from tidemark.plans.panel import BARS, bars
from tidemark.plans.relational import DAYS, EDGE_SQL, EDGES, N_BANDS, _band_sql, days, normal_sql, price_sql, query, r, rounded

# the market's shares and the first stage

IV = ("iv30c", "iv30p", "iv3mc", "iv3mp")
KEY = ("px_last", "volume", "iv30c")


def thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars without volatilities on every 53rd day of a year and without a price on every 97th."""
    b = bars(spark, sf_dir)
    gone = F.dayofyear("date") % 53 == 0
    px = F.when(F.dayofyear("date") % 97 != 0, F.col("px_last"))
    return b.withColumns({c: F.when(~gone, F.col(c)) for c in IV} | {"px_last": px})


THINNED = f"""SELECT * REPLACE ({', '.join(f'CASE WHEN dayofyear(date) % 53 <> 0 THEN {c} END AS {c}' for c in IV)},
  CASE WHEN dayofyear(date) % 97 <> 0 THEN px_last END AS px_last) FROM ({BARS})"""

SHARES = f"""SELECT ticker, avg(CASE WHEN {' OR '.join(f'{c} IS NOT NULL' for c in IV)} THEN 1e0 ELSE 0e0 END) AS iv_availability,
  avg(({' + '.join(f'CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END' for c in KEY)}) / {len(KEY)}) AS missing_share,
  avg(CASE WHEN opt_vol >= 1000 THEN 1e0 ELSE 0e0 END) AS ok_volume, avg(CASE WHEN coalesce(call_oi, 0) + coalesce(put_oi, 0) >= 5000 THEN 1e0 ELSE 0e0 END) AS ok_interest,
  avg(CASE WHEN volume >= 100000 THEN 1e0 ELSE 0e0 END) AS ok_px_volume,
  avg(CASE WHEN px_low <= px_open AND px_open <= px_high AND px_low <= px_high THEN 1e0 ELSE 0e0 END) AS quote_sanity FROM ({THINNED}) GROUP BY ticker"""


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauntlet.market_shares(thinned(spark, sf_dir), ["ticker"], IV, KEY, "opt_vol", ("call_oi", "put_oi"), ("px_open", "px_high", "px_low"), "volume")


@query(f"""SELECT ticker, {', '.join(f'{r(c)} AS {c}' for c in ('iv_availability', 'missing_share', 'ok_volume', 'ok_interest', 'ok_px_volume', 'quote_sanity'))},
  {r('(ok_volume + ok_interest + ok_px_volume) / 3')} AS capacity, {r('1.5e0 * (0.5 + 0.5 * (ok_volume + ok_interest + ok_px_volume) / 3)')} AS haircut FROM ({SHARES})""")
def market_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of usable market rows of each ticker, the capacity score, and a Sharpe ratio of 1.5 after its haircut."""
    from tidemark.operators.gates import capacity_haircut

    return rounded(shares(spark, sf_dir).withColumn("capacity", gauntlet.capacity()).withColumn("haircut", capacity_haircut(F.lit(1.5), F.col("capacity"))))


def _judged(tests: list[tuple[str, str]], stage: int) -> str:
    failed = f"list_filter([{', '.join(f'CASE WHEN NOT coalesce({ok}, false) THEN {chr(39)}{code}{chr(39)} END' for code, ok in tests)}], lambda x: x IS NOT NULL)"
    return f"{failed}[1] AS reject_code, CASE WHEN len({failed}) = 0 THEN 'ok' ELSE array_to_string({failed}, ';') END AS reason, len({failed}) = 0 AS pass_stage{stage}"


HEALTH = [
    ("S1_RECENCY", "recent_trades >= 1"), ("S1_ACTIVITY", "total_trades >= 5"), ("S1_MOMENTUM", "recent_win_n < 3 OR recent_win_rate >= 0.4"),
    ("S1_IV_AVAIL", "iv_availability >= 0.98"), ("S1_STRIKE", "strike_success >= 0.97"), ("S1_MISSING", "missing_share <= 0.01"),
    ("S1_HOLDING", "coalesce(holding_ratio >= 0.4, true)"), ("S1_DAILY_CAP", "peak_daily <= 12"),
    ("S1_LIQ_PROXY", "ok_volume >= 0.95 AND ok_interest >= 0.95"), ("S1_QUOTES", "quote_sanity >= 0.99"),
]

STAGE1 = f"""WITH t AS (SELECT *, horizon * 20 AS tenor, CASE WHEN trade_id % 40 <> 0 THEN capital END AS strike FROM ({TRADES})),
  e AS (SELECT *, greatest(max(trigger_date) OVER w, max(exit_date) OVER w) AS last FROM t WINDOW w AS (PARTITION BY setup_id, ticker)),
  p AS (SELECT setup_id, ticker, max(n) AS peak_daily FROM (SELECT setup_id, ticker, trigger_date, count(*) AS n FROM t GROUP BY 1, 2, 3) GROUP BY 1, 2),
  g AS (SELECT setup_id, ticker, count(*) FILTER (last - trigger_date <= 7) AS recent_trades, count(*) AS total_trades, count(*) FILTER (last - trigger_date <= 30) AS near,
    count(pnl_pct) FILTER (last - trigger_date <= 30) AS valued, avg(CASE WHEN pnl_pct > 0 THEN 1e0 ELSE 0e0 END) FILTER (last - trigger_date <= 30 AND pnl_pct IS NOT NULL) AS wins,
    avg(CASE WHEN strike IS NOT NULL THEN 1e0 ELSE 0e0 END) AS strike_success, avg(exit_date - trigger_date) AS mean_holding, avg(tenor) AS mean_tenor FROM e GROUP BY 1, 2),
  h AS (SELECT * EXCLUDE (near, valued, wins), CASE WHEN near < 3 THEN 0 ELSE coalesce(wins, 0) END AS recent_win_rate, CASE WHEN near < 3 THEN near ELSE valued END AS recent_win_n,
    CASE WHEN mean_tenor > 0 THEN mean_holding / mean_tenor END AS holding_ratio FROM g JOIN p USING (setup_id, ticker) LEFT JOIN ({SHARES}) USING (ticker))
  SELECT setup_id, ticker, recent_trades, total_trades, peak_daily, recent_win_n, {', '.join(f'{r(c, 5)} AS {c}' for c in ('recent_win_rate', 'strike_success', 'mean_holding', 'mean_tenor', 'holding_ratio'))},
    {_judged(HEALTH, 1)} FROM h"""


def stage1(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).withColumns({"tenor": F.col("horizon") * 20, "strike": F.when(F.col("trade_id") % 40 != 0, F.col("capital"))})
    return gauntlet.health(t, shares(spark, sf_dir), tenor="tenor", strike="strike")


@query(STAGE1)
def gauntlet_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First stage for every setup and ticker."""
    return rounded(stage1(spark, sf_dir).drop("iv_availability", "missing_share", "ok_volume", "ok_interest", "ok_px_volume", "quote_sanity"), 5)


# profitability


def _nav(by: str, rows: str = TRADES) -> str:
    """Daily returns of a ledger: weekdays between the first and the last exit."""
    return f"""(WITH d AS (SELECT {by}, exit_date, sum(pnl_dollars) AS pnl FROM ({rows}) WHERE exit_date IS NOT NULL GROUP BY ALL),
      s AS (SELECT {by}, CAST(unnest(generate_series(min(exit_date), max(exit_date), INTERVAL 1 DAY)) AS DATE) AS exit_date FROM d GROUP BY {by})
      SELECT {by}, exit_date, coalesce(pnl, 0) / 100000 AS r FROM s LEFT JOIN d USING ({by}, exit_date) WHERE isodow(exit_date) < 6)"""


def _folds(by: str, rows: str = TRADES) -> str:
    return f"""(WITH n AS {_nav(by, rows)}, p AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY {by} ORDER BY exit_date)) AS nav FROM n),
      q AS (SELECT *, nav / max(nav) OVER (PARTITION BY {by} ORDER BY exit_date) - 1 AS dd FROM p), v AS (SELECT {by}, quantile_cont(r, 0.05) AS q FROM n GROUP BY {by}),
      g AS (SELECT {by}, count(*) AS n_obs, coalesce(CASE WHEN stddev_samp(r) > 1e-15 THEN avg(r) / stddev_samp(r) * sqrt(252) END, 0) AS sharpe, min(dd) AS maxdd,
        exp(sum(ln(1 + r))) - 1 AS fold_return, sum(r) AS total_r, avg(r) FILTER (r <= q) AS cvar5 FROM q JOIN v USING ({by}) GROUP BY {by}),
      s AS (SELECT {by}, count(pnl_pct) AS support FROM ({rows}) GROUP BY {by})
      SELECT *, CASE WHEN n_obs > 1 THEN greatest(0, sharpe - 1 / sqrt(n_obs - 1)) ELSE 0 END AS dsr FROM g JOIN s USING ({by}))"""


PROFIT = [
    ("S2_DSR", "wf_dsr >= 0.25"), ("S2_IQR", "wf_sharpe_iqr <= 0.8"), ("S2_CVAR", "wf_cvar_5 >= -0.15"), ("S2_SUPPORT", "wf_support >= 50"),
    ("S2_CATASTROPHE", "wf_fold_min_return >= -0.2"),
]

STAGE2 = f"""WITH f AS {_folds('setup_id, fold')}, n AS {_nav('setup_id, fold')}, v AS (SELECT setup_id, quantile_cont(r, 0.05) AS q FROM n GROUP BY 1),
  c AS (SELECT setup_id, avg(r) FILTER (r <= q) AS wf_cvar_5 FROM n JOIN v USING (setup_id) GROUP BY 1),
  g AS (SELECT setup_id, avg(sharpe) AS wf_sharpe, median(dsr) AS wf_dsr, quantile_cont(sharpe, 0.75) - quantile_cont(sharpe, 0.25) AS wf_sharpe_iqr, CAST(sum(support) AS BIGINT) AS wf_support,
    min(fold_return) AS wf_fold_min_return, exp(sum(ln(1 + fold_return))) - 1 AS wf_return FROM f GROUP BY 1)
  SELECT setup_id, wf_support, {', '.join(f'{r(c, 5)} AS {c}' for c in ('wf_sharpe', 'wf_dsr', 'wf_sharpe_iqr', 'wf_fold_min_return', 'wf_return', 'wf_cvar_5'))}, {_judged(PROFIT, 2)}
  FROM g JOIN c USING (setup_id)"""


@query(STAGE2)
def gauntlet_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second stage over each setup's years."""
    return rounded(gauntlet.walk_forward_profit(trades(spark, sf_dir, numbered=True)), 5)


SINGLE = [
    ("S2_NAV", "nav_return_pct >= 0"), ("S2_PNL", "total_pnl >= 0"), ("S2_WIN", "win_rate >= 0 OR payoff_ratio >= 0"), ("S2_DRAWDOWN", "max_drawdown <= 0.5"),
    ("S2_RECENT_NAV", "recent_nav_return >= 0"), ("S2_RECENT_TRADES", "recent_trades >= 1"),
]
NEAR = f"SELECT * FROM (SELECT *, max(trigger_date) OVER (PARTITION BY setup_id) AS last FROM ({TRADES})) WHERE last - trigger_date <= 30"


@query(f"""WITH f AS (SELECT setup_id, total_r * 100 AS nav_return_pct, sharpe AS sharpe_ratio, cvar5, maxdd AS max_drawdown FROM {_folds('setup_id')}),
  t AS (SELECT setup_id, sum(pnl_pct) AS total_pnl, avg(CASE WHEN pnl_pct > 0 THEN 1e0 ELSE 0e0 END) AS win_rate, coalesce(avg(pnl_pct) FILTER (pnl_pct > 0), 0) AS avg_win,
    coalesce(-avg(pnl_pct) FILTER (pnl_pct < 0), 0) AS avg_loss, avg(pnl_pct) FILTER (pnl_pct > 0) / -avg(pnl_pct) FILTER (pnl_pct < 0) AS payoff_ratio FROM ({TRADES}) GROUP BY 1),
  n AS (SELECT setup_id, sum(r) * 100 AS x FROM {_nav('setup_id', NEAR)} GROUP BY 1), k AS (SELECT setup_id, count(*) AS recent_trades, any_value(x) AS x FROM ({NEAR}) LEFT JOIN n USING (setup_id) GROUP BY 1),
  h AS (SELECT *, coalesce(x, 0) AS recent_nav_return FROM f JOIN t USING (setup_id) JOIN k USING (setup_id))
  SELECT setup_id, recent_trades, {', '.join(f'{r(c, 5)} AS {c}' for c in ('nav_return_pct', 'sharpe_ratio', 'cvar5', 'max_drawdown', 'total_pnl', 'win_rate', 'payoff_ratio', 'avg_win', 'avg_loss', 'recent_nav_return'))},
    {_judged(SINGLE, 2)} FROM h""")
def gauntlet_single_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second stage over each setup's whole ledger, with recent and trade metrics."""
    return rounded(gauntlet.single_fold_profit(trades(spark, sf_dir, numbered=True)), 5)


# robustness and the decision; the regime of a trade is its ticker

REGIME = f"""(SELECT setup_id, ticker, count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY setup_id) AS coverage,
    CASE WHEN stddev_samp(pnl_pct) > 1e-12 THEN avg(pnl_pct) / stddev_samp(pnl_pct) END AS sharpe,
    sum(greatest(pnl_pct, 0)) / sum(sum(greatest(pnl_pct, 0))) OVER (PARTITION BY setup_id) AS profit_share FROM ({TRADES}) GROUP BY 1, 2)"""


def regime_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, sd = F.col("pnl_pct"), F.stddev_samp("pnl_pct")
    g = trades(spark, sf_dir).groupBy("setup_id", "ticker").agg(
        F.count("*").alias("n"), F.when(sd > 1e-12, F.avg(x) / sd).alias("sharpe"), F.sum(F.greatest(x, F.lit(0.0))).alias("gain")
    )
    w = Window.partitionBy("setup_id")
    return g.select("setup_id", "ticker", (F.col("n") / F.sum("n").over(w)).alias("coverage"), "sharpe", (F.col("gain") / F.sum("gain").over(w)).alias("profit_share"))


def _hart(full: bool) -> str:
    s, i, c, f, m = (0.25, 0.5, 0.25, 0.5, 1.0) if full else (0.3, 0.4, 0.3, 0.2, 0.5)
    return f"""greatest(least(greatest(median_dsr, 0), 2) / 2 + {s} * least(greatest(support_rate, 0), 1) - {i} * least(iqr_sharpe, 1)
      - {c} * least(greatest((0.5 - cvar5) / 0.5, 0), 1) - {f} * least(fragility / 0.5, 1) - {m} * CASE WHEN mono_regime THEN 1 ELSE 0 END, 0)"""


ROBUST = f"""(WITH f AS {_folds('setup_id, fold')}, p AS (SELECT setup_id, median(dsr) AS median_dsr, quantile_cont(sharpe, 0.75) - quantile_cont(sharpe, 0.25) AS iqr_sharpe, median(cvar5) AS cvar5,
    avg(CASE WHEN support >= 60 THEN 1e0 ELSE 0e0 END) AS support_rate FROM f GROUP BY 1),
  g AS (SELECT setup_id, coalesce(greatest(max(sharpe) - median(sharpe), 0), 0) AS fragility, coalesce(max(coverage) >= 0.8 OR max(profit_share) >= 0.8, false) AS mono_regime FROM {REGIME} GROUP BY 1)
  SELECT *, {_hart(True)} AS full_score, {_hart(False)} AS lite_score FROM p JOIN g USING (setup_id))"""


def robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = gauntlet.fold_metrics(trades(spark, sf_dir, numbered=True), ["setup_id", "fold"])
    g = gauntlet.path_metrics(paths, "setup_id", 60).join(gauntlet.regime_fragility(regime_rows(spark, sf_dir), "setup_id"), "setup_id")
    return g.withColumns({"full_score": gauntlet.composite_score(), "lite_score": gauntlet.composite_score(False)})


@query(f"SELECT setup_id, mono_regime, {', '.join(f'{r(c, 5)} AS {c}' for c in ('median_dsr', 'iqr_sharpe', 'cvar5', 'support_rate', 'fragility', 'full_score', 'lite_score'))} FROM {ROBUST}")
def gauntlet_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third stage: path metrics, fragility over regimes and the composite scores."""
    return rounded(robust(spark, sf_dir), 5)


# support


FIRES = f"SELECT ticker, date, volume > 700 AS fired, CASE WHEN day(date) <> 7 THEN px_last END AS a, CASE WHEN day(date) <> 9 THEN volume END AS b FROM ({BARS})"


def fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return b.select(
        "ticker", "date", (F.col("volume") > 700).alias("fired"), F.when(F.day("date") != 7, F.col("px_last")).alias("a"), F.when(F.day("date") != 9, F.col("volume")).alias("b")
    )


@query(f"""WITH f AS ({FIRES}), u AS (SELECT *, sum(CASE WHEN fired THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY date) AS run FROM f),
  p AS (SELECT *, CASE WHEN fired THEN row_number() OVER (PARTITION BY ticker, run, fired ORDER BY date) ELSE 0 END AS place FROM u),
  g AS (SELECT ticker, count(*) FILTER (fired) AS total_fires, max(place) AS max_streak, coalesce(avg(place) FILTER (fired), 0) AS avg_streak, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS eligible_days FROM p GROUP BY 1)
  SELECT ticker, total_fires, max_streak, {r('avg_streak')} AS avg_streak, CASE WHEN total_fires >= 12 THEN total_fires ELSE 0 END AS valid_fires,
    CASE WHEN total_fires >= 12 THEN 1e0 ELSE 0e0 END AS support_ratio, total_fires >= 12 AS meets_min_support, eligible_days FROM g""")
def setup_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support of a volume signal on each ticker, and the days on which its features have values."""
    f = fires(spark, sf_dir)
    days = f.where(support.eligible(["a", "b"])).groupBy("ticker").agg(F.count("*").alias("eligible_days"))
    return rounded(support.support_stats(f, ["ticker"], "date").join(days, "ticker"))


@query(f"""WITH f AS ({FIRES}), n AS (SELECT ticker, count(*) AS k FROM f WHERE fired GROUP BY 1 HAVING count(*) >= 40)
  SELECT ticker, count(*) AS days, count(*) FILTER (fired AND k IS NOT NULL) AS valid_days, {r('avg(a) FILTER (fired AND k IS NOT NULL)', 4)} AS mean_a FROM f LEFT JOIN n USING (ticker) GROUP BY 1""")
def supported_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values on the supported days of each ticker."""
    f = fires(spark, sf_dir)
    valid = support.supported(f, ["ticker"], 40).groupBy("ticker").agg(F.count("*").alias("valid_days"))
    kept = support.supported_returns(f, ["ticker"], "a", 40).groupBy("ticker").agg(F.count("*").alias("days"), F.avg("a").alias("mean_a"))
    return rounded(kept.join(valid, "ticker", "left").na.fill({"valid_days": 0}), 4)


# regimes; the regime of a trade is its horizon modulo 4


RG = f"SELECT setup_id, ticker, trigger_date, horizon % 4 AS regime, pnl_pct FROM ({TRADES})"


@query(f"""WITH t AS ({RG}), e AS (SELECT setup_id, regime, {r('avg(pnl_pct)')} AS edge, count(*) AS n FROM t GROUP BY 1, 2), o AS (SELECT regime, count(*) * 1e0 / sum(count(*)) OVER () AS w FROM t GROUP BY 1),
  a AS (SELECT setup_id, count(*) FILTER (edge >= 0.03) / 4e0 AS breadth FROM e GROUP BY 1), b AS (SELECT setup_id, avg(CASE WHEN regime IN (1, 2) THEN 1e0 ELSE 0e0 END) AS overlap FROM t GROUP BY 1),
  c AS (SELECT setup_id, arg_max(regime, k) AS regime_today FROM (SELECT setup_id, trigger_date AS k, max(regime) AS regime FROM t WHERE trigger_date <= DATE '1997-06-30' GROUP BY 1, 2) GROUP BY 1),
  d AS (SELECT setup_id, sum(n / 1000e0 * w) AS tau FROM e JOIN o USING (regime) GROUP BY 1),
  k AS (SELECT *, row_number() OVER (PARTITION BY setup_id ORDER BY edge DESC, regime) AS k FROM e),
  f AS (SELECT setup_id, max(regime) FILTER (k = 1) AS worst_regime, max(edge) AS worst_value, max(edge) - coalesce(max(edge) FILTER (k = 2), max(edge)) AS gap_to_next FROM k GROUP BY 1)
  SELECT setup_id, {r('breadth')} AS breadth, {r('overlap')} AS overlap, regime_today, {r('tau')} AS tau, worst_regime, {r('worst_value')} AS worst_value, {r('gap_to_next')} AS gap_to_next
  FROM a JOIN b USING (setup_id) JOIN c USING (setup_id) JOIN d USING (setup_id) JOIN f USING (setup_id)""")
def regime_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth, overlap, the latest regime, weighted trigger rate and the largest edge of each setup."""
    from datetime import date

    t = trades(spark, sf_dir).select("setup_id", "ticker", "trigger_date", (F.col("horizon") % 4).alias("regime"), "pnl_pct")
    e = rounded(t.groupBy("setup_id", "regime").agg(F.avg("pnl_pct").alias("edge"), F.count("*").alias("n")))
    n = t.groupBy("regime").agg(F.count("*").alias("n"))
    occupancy = n.select("regime", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("occupancy"))
    day = t.groupBy("setup_id", "trigger_date").agg(F.max("regime").alias("regime"))
    out = regimes.breadth(e, ["setup_id"], "edge", F.lit(0.03), 4)
    for part in (
        regimes.overlap(t, ["setup_id"], "regime", [1, 2]), regimes.latest(day, ["setup_id"], "regime", "trigger_date", date(1997, 6, 30)),
        regimes.weighted_rate(e.select("setup_id", "regime", (F.col("n") / 1000).alias("rate")), occupancy, ["setup_id"], "regime"),
        regimes.worst(e, ["setup_id"], "regime", "edge"),
    ):
        out = out.join(part, "setup_id")
    return rounded(out)


@query(f"""WITH m AS (SELECT ticker, avg(iv30c) AS a, avg(px_last) / 50 AS b, avg(cn_sent) * 100 AS c FROM ({BARS}) GROUP BY 1)
  SELECT v.ticker, count(*) AS days, {r('avg(least(greatest((iv30c * a + px_last / 50 * b + cn_sent * 100 * c) / (sqrt(iv30c * iv30c + power(px_last / 50, 2) + power(cn_sent * 100, 2)) * sqrt(a * a + b * b + c * c)), 0), 1))', 5)} AS likeness
  FROM ({BARS}) v JOIN m USING (ticker) GROUP BY v.ticker""")
def regime_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of each ticker's days with its own centre."""
    x = [F.col("iv30c"), F.col("px_last") / 50, F.col("cn_sent") * 100]
    w = Window.partitionBy("ticker")
    likeness = regimes.similarity(x, [F.avg(c).over(w) for c in x])
    return rounded(bars(spark, sf_dir).withColumn("likeness", likeness).groupBy("ticker").agg(F.count("*").alias("days"), F.avg("likeness").alias("likeness")), 5)


# signal probabilities


PROBS = f"""SELECT ticker, date, (cn_sent / 0.01e0) AS z, (iv30c - 25) / 2 AS opt_z, volume / 1000 AS rank_a, iv3mc AS rank_b, volume > 700 AS f1, tw_count > 40 AS f2 FROM ({BARS})"""


@query(f"""WITH x AS ({PROBS}), k AS (SELECT ticker, max(rank_a) > 1.5 AS pa, max(rank_b) > 1.5 AS pb FROM x GROUP BY 1),
  p AS (SELECT x.*, least(greatest(0.5 * (1 + tanh(z / 2)), 0), 1) AS t, 1 / (1 + exp(-z)) AS s, least(greatest(0.5 * (1 + tanh(opt_z / 1.5)), 0), 1) AS o,
    least(greatest(CASE WHEN pa THEN rank_a / 100 ELSE rank_a END, 0), 1) AS ra, least(greatest(CASE WHEN pb THEN rank_b / 100 ELSE rank_b END, 0), 1) AS rb FROM x JOIN k USING (ticker)),
  c AS (SELECT *, (max(CASE WHEN f1 THEN 1 ELSE 0 END) OVER w + max(CASE WHEN f2 THEN 1 ELSE 0 END) OVER w) / 2e0 AS together FROM p WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
  SELECT ticker, {', '.join(f'{r(f"avg({e})", 5)} AS {n}' for n, e in (('tanh_prob', 't'), ('sigmoid_prob', 's'), ('rank_a', 'ra'), ('rank_b', 'rb'), ('both', 'least(t, ra)'), ('either', 'greatest(t, ra)'), ('together', 'together')))},
    count(*) FILTER (least(t, rb) > 0.3) AS event_days, count(*) FILTER (least(o, rb) > 0.22) AS option_days FROM c GROUP BY 1""")
def signal_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of scores and ranks, their soft conjunctions, and how often signals fire near each other."""
    x = bars(spark, sf_dir).select(
        "ticker", "date", (F.col("cn_sent") / 0.01).alias("EV_surp_z"), ((F.col("iv30c") - 25) / 2).alias("opt.iv_z"), (F.col("volume") / 1000).alias("rank_a"),
        F.col("iv3mc").alias("EV_heat"), F.col("iv3mc").alias("opt.level"), (F.col("volume") > 700).alias("f1"), (F.col("tw_count") > 40).alias("f2"),
    )
    t, s = signals.z_to_prob_tanh(F.col("EV_surp_z")), signals.z_to_prob_sigmoid(F.col("EV_surp_z"))
    ranks = {c: signals.rank_to_prob(c, ["ticker"]) for c in ("rank_a", "EV_heat")}
    p = x.withColumns(
        {
            "t": t, "s": s, "ra": ranks["rank_a"], "rb": ranks["EV_heat"], "together": signals.cooccurrence([F.col("f1"), F.col("f2")], ["ticker"], "date", 5),
            "event": signals.soft_signal(x.columns, "EV_", ["ticker"], 2.0, 0.3), "option": signals.soft_signal(x.columns, "opt.", ["ticker"], 1.5, 0.22),
        }
    )
    return rounded(
        p.groupBy("ticker").agg(
            F.avg("t").alias("tanh_prob"), F.avg("s").alias("sigmoid_prob"), F.avg("ra").alias("rank_a"), F.avg("rb").alias("rank_b"),
            F.avg(signals.soft_and(F.col("t"), F.col("ra"))).alias("both"), F.avg(signals.soft_or(F.col("t"), F.col("ra"))).alias("either"), F.avg("together").alias("together"),
            F.count_if("event").alias("event_days"), F.count_if("option").alias("option_days"),
        ), 5,
    )


# option conventions over the bars


NEEDED = ["iv30c", "iv30p", "c10", "c25", "c40", "p10", "p25", "p40"]
OPT = f"SELECT * REPLACE (CASE WHEN dayofyear(date) % 11 <> 0 THEN c10 END AS c10, CASE WHEN dayofyear(date) % 5 <> 0 THEN iv3mp END AS iv3mp), dayofyear(date) % 200 AS tenor, ticker < 'N' AS call FROM ({BARS})"


def option_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofyear("date")
    b = bars(spark, sf_dir).withColumns({"c10": F.when(day % 11 != 0, F.col("c10")), "iv3mp": F.when(day % 5 != 0, F.col("iv3mp"))})
    return b.withColumns({"tenor": day % 200, "call": F.col("ticker") < "N"})


def _clean(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN least(greatest(CASE WHEN {x} > 2 THEN {x} / 100 ELSE {x} END, 2e-4), 5e0) END"


def _tenor(x: str, days: str, rv: str, ref: str = "63") -> str:
    scaled = f"({x} * power({days} * 1e0 / {ref}, -0.15))"
    return f"least(greatest(CASE WHEN {rv} IS NOT NULL THEN 0.7 * {scaled} + 0.3 * {rv} ELSE {scaled} END, 2e-4), 5e0)"


BACK = f"({' OR '.join(f'{c} IS NULL' for c in NEEDED)})"
CONVENTIONS = f"""(WITH l AS (SELECT *, ln(px_last / lag(px_last) OVER w) AS change, row_number() OVER w AS k FROM ({OPT}) WINDOW w AS (PARTITION BY ticker ORDER BY date)),
  v AS (SELECT *, CASE WHEN k >= 22 AND stddev_samp(change) OVER w > 0 THEN stddev_samp(change) OVER w * sqrt(252) END AS rv FROM l WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
  a AS (SELECT *, {_clean('CASE WHEN call THEN iv3mc ELSE iv3mp END')} AS three, {BACK} AS fell_back,
    CASE WHEN {BACK} THEN {_clean('CASE WHEN call THEN iv3mc ELSE iv3mp END')} ELSE {_clean('CASE WHEN call THEN c40 ELSE p40 END')} END AS smile, CASE WHEN {BACK} THEN 63 ELSE 21 END AS ref,
    CASE WHEN {BACK} THEN {_clean('CASE WHEN call THEN iv3mc ELSE iv3mp END')} ELSE {_clean('CASE WHEN call THEN iv30c ELSE iv30p END')} END AS thirty FROM v)
  SELECT *, {_tenor('three', '63', 'rv')} AS sigma_63, {_tenor('smile', '42', 'rv', 'ref')} AS sigma_42, {_tenor('smile', '32', 'rv', 'ref')} AS sigma_32,
    lead(px_last, 10) OVER (PARTITION BY ticker ORDER BY date) AS s1, CASE WHEN tenor % 7 = 0 THEN NULL WHEN tenor % 3 = 0 THEN 4.5 ELSE 0.03 END AS yield_a FROM a)"""


def conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date")
    rows = options.market_vol(option_rows(spark, sf_dir), "px_last", "rv")
    call = F.col("call")
    three, _, _ = options.anchor("3M", call, ("iv3mc", "iv3mp"), ("iv30c", "iv30p"), ("c40", "p40"), NEEDED)
    smile, ref, back = options.anchor("1M", call, ("iv3mc", "iv3mp"), ("iv30c", "iv30p"), ("c40", "p40"), NEEDED)
    thirty, _, _ = options.anchor("30D", call, ("iv3mc", "iv3mp"), ("iv30c", "iv30p"), ("c40", "p40"), NEEDED)
    rows = rows.withColumns({"three": three, "smile": smile, "ref": ref, "fell_back": back, "thirty": thirty, "s1": F.lead("px_last", 10).over(w)})
    sigma = lambda x, days, by: options.tenor_sigma(F.col(x), F.lit(days), F.col("rv"), by)
    t = F.col("tenor")
    return rows.withColumns(
        {
            "sigma_63": sigma("three", 63, 63), "sigma_42": sigma("smile", 42, F.col("ref")), "sigma_32": sigma("smile", 32, F.col("ref")),
            "yield_a": F.when(t % 7 == 0, F.lit(None).cast("double")).when(t % 3 == 0, 4.5).otherwise(0.03),
        }
    )


@query(f"""SELECT ticker, date, fell_back, {', '.join(f'{r(c)} AS {c}' for c in ('rv', 'three', 'thirty', 'smile', 'sigma_63', 'sigma_42'))}, list_filter([{', '.join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in NEEDED)}], lambda x: x IS NOT NULL)[1] AS first_missing,
  {r('coalesce(CASE WHEN yield_a > 1 THEN yield_a / 100 ELSE yield_a END, CASE WHEN tenor % 2 = 0 THEN 0.01 END, 0.02)')} AS rate, CASE WHEN tenor <= 15 THEN 0.03e0 WHEN tenor <= 30 THEN 0.02e0 ELSE 0.01e0 END AS slippage,
  CASE WHEN tenor % 4 <> 0 THEN 'regime_aware_h' || CAST(tenor AS VARCHAR) ELSE 'disabled' END AS policy, CASE WHEN round(tenor * 1.25) <= 21 THEN 21 WHEN round(tenor * 1.25) <= 63 THEN 63 ELSE 126 END AS tenor_bd FROM {CONVENTIONS}""")
def option_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realised and anchor volatilities, their tenors, rates, slippage and policies of every bar."""
    t = F.col("tenor")
    out = conventions(spark, sf_dir).select(
        "ticker", "date", "fell_back", "rv", "three", "thirty", "smile", "sigma_63", "sigma_42", F.get(options.missing_quotes(NEEDED), F.lit(0)).alias("first_missing"),
        options.risk_free([F.col("yield_a"), F.when(t % 2 == 0, 0.01)], 0.02).alias("rate"), options.slippage(t, 0.03, 0.02, 0.01).alias("slippage"),
        options.policy_id(t % 4 != 0, "regime_aware", t).alias("policy"), options.tenor_of(t, (21, 63, 126)).alias("tenor_bd"),
    )
    return rounded(out)


def _leg(s: str, t: str, v: str) -> str:
    c = price_sql(s, "strike", t, v, "0.01e0")
    return f"greatest(CASE WHEN call THEN {c} ELSE {c} - {s} + strike * exp(-0.01e0 * {t}) END, 0)"


STEPS = "CASE WHEN px_last < 25 THEN 0.5 WHEN px_last < 50 THEN 1e0 WHEN px_last < 200 THEN 2.5 WHEN px_last < 500 THEN 5e0 ELSE 10e0 END"


@query(f"""WITH x AS (SELECT *, least(greatest(round_even(px_last / {STEPS}, 0) * {STEPS}, px_last * 0.5), px_last * 1.5) AS strike FROM {CONVENTIONS} WHERE s1 IS NOT NULL AND smile IS NOT NULL),
  y AS (SELECT *, {_leg('px_last', '(42 / 252e0)', 'sigma_42')} AS entry, {_leg('s1', '(32 / 252e0)', 'sigma_32')} AS leave FROM x)
  SELECT ticker, date, {r('strike', 4)} AS strike, {r('entry', 4)} AS entry_price, {r('leave', 4)} AS exit_price,
    'type=' || CASE WHEN call THEN 'call' ELSE 'put' END || ';tenor=' || CAST(tenor AS VARCHAR) || 'd;' || format('strike_rel={{:.4f}}', round(strike / px_last - 1 + 3.1e-8, 4) + 0e0) || ';delta=' || CASE WHEN tenor % 9 = 0 THEN 'NA' ELSE '0.400' END AS structure FROM y""")
def option_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One option at every bar by the smile's volatility, priced at entry and ten bars on, and the key of its structure."""
    call, px = F.col("call"), F.col("px_last")
    x = conventions(spark, sf_dir).where("s1 is not null and smile is not null").withColumn("strike", options.listed_strike(px, px))
    enter, leave = options.priced_leg(px, F.col("s1"), F.col("strike"), F.lit(42), F.lit(10), F.lit(0.01), call, F.col("sigma_42"), F.col("sigma_32"))
    relative = px * (1 + F.round(F.col("strike") / px - 1 + NUDGE, 4) + 0.0)
    key = options.structure_key(F.when(call, "Call").otherwise("Put"), F.col("tenor"), relative, px, F.when(F.col("tenor") % 9 != 0, 0.4))
    out = x.select("ticker", "date", "strike", enter.alias("entry_price"), leave.alias("exit_price"), key.alias("structure"))
    return rounded(out, 4)


# small statistics of trades


@query(f"""WITH t AS ({TRADES}), q AS (SELECT setup_id, median(pnl_pct) AS m, quantile_cont(pnl_pct, 0.05) AS lo, quantile_cont(pnl_pct, 0.95) AS hi FROM t GROUP BY 1)
  SELECT setup_id, {r('any_value(m)')} AS centre, {r('1.4826 * median(abs(pnl_pct - m))')} AS mad, {r('avg(pnl_pct)')} AS expectancy, {r('avg(pnl_pct) / (stddev_samp(pnl_pct) / sqrt(count(*)))', 4)} AS tstat,
    {r('avg(least(greatest(pnl_pct, lo), hi))')} AS clipped_mean, {r('max(abs((pnl_pct - m) / (1.4826 * 1 + 1e-9)))')} AS reach,
    {r('(avg(CASE WHEN pnl_pct > 0 THEN 1e0 ELSE 0e0 END) + 3.8416e0 / (2 * count(*)) - 1.96 * sqrt(avg(CASE WHEN pnl_pct > 0 THEN 1e0 ELSE 0e0 END) * (1 - avg(CASE WHEN pnl_pct > 0 THEN 1e0 ELSE 0e0 END)) / count(*) + 3.8416e0 / (4e0 * count(*) * count(*)))) / (1 + 3.8416e0 / count(*))')} AS win_low
  FROM t JOIN q USING (setup_id) GROUP BY setup_id""")
def trade_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre and spread, expectancy, t statistic, clipped mean and the lower bound of the win rate of each setup."""
    from tidemark.operators.gates import wilson

    t = trades(spark, sf_dir).select("setup_id", "pnl_pct")
    clipped = ledger.winsorized(t, ["setup_id"], "pnl_pct", 0.05, 0.95).groupBy("setup_id").agg(F.avg("pnl_pct").alias("clipped_mean"))
    g = robustness.centre_and_spread(t, ["setup_id"], "pnl_pct").join(robustness.expectancy(t, ["setup_id"], "pnl_pct"), "setup_id").join(clipped, "setup_id")
    reach = t.join(g.select("setup_id", "centre"), "setup_id").groupBy("setup_id").agg(F.max(F.abs((F.col("pnl_pct") - F.col("centre")) / (1.4826 + 1e-9))).alias("reach"))
    return rounded(g.withColumn("win_low", wilson(F.col("wins"), F.col("n"))[0]).drop("wins", "n").join(reach, "setup_id"), 6, tstat=4)


# validation reports and inner folds


VALID = f"""SELECT ticker, horizon, pnl_pct AS skill, abs(pnl_pct) AS crps, capital / 1000 AS calibration, 0.45 + (trade_id % 20) / 100e0 AS drift_auc,
  trade_id % 20 < 12 AS drift_passed, horizon % 3 AS regime FROM ({TRADES})"""


def validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("trade_id") % 20
    return trades(spark, sf_dir).select(
        "ticker", "horizon", F.col("pnl_pct").alias("skill"), F.abs("pnl_pct").alias("crps"), (F.col("capital") / 1000).alias("calibration"),
        (0.45 + k / 100.0).alias("drift_auc"), (k < 12).alias("drift_passed"), (F.col("horizon") % 3).alias("regime"),
    )


@query(f"SELECT ticker, {r('avg(drift_auc)')} AS mean_drift_auc, {r('avg(CASE WHEN drift_passed THEN 1e0 ELSE 0e0 END)')} AS drift_pass_rate, count(*) AS n_validations FROM ({VALID}) GROUP BY 1")
def drift_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.drift_table(validations(spark, sf_dir)))


@query(f"""SELECT regime, {r('avg(skill)')} AS skill_mean, {r('stddev_samp(skill)')} AS skill_std, count(skill) AS skill_count, {r('avg(crps)')} AS crps_mean, {r('avg(calibration)')} AS calibration_mean,
  {r('avg(CASE WHEN drift_passed THEN 1e0 ELSE 0e0 END)')} AS pass_rate FROM ({VALID}) GROUP BY 1""")
def regime_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.regime_table(validations(spark, sf_dir), "regime", "skill", ["crps", "calibration"]))


OK = "skill >= 0.01 AND calibration <= 0.3 AND drift_passed"


@query(f"""SELECT count(*) AS total_validations, count(*) FILTER ({OK}) AS eligible_setups, {r(f'avg(CASE WHEN {OK} THEN 1e0 ELSE 0e0 END)')} AS eligibility_rate, count(DISTINCT ticker) AS unique_tickers,
  count(DISTINCT horizon) AS unique_horizons, {r('avg(skill)')} AS mean_skill, {r('median(skill)')} AS median_skill, {r(f'avg(skill) FILTER ({OK})')} AS eligible_mean_skill,
  {r(f'median(skill) FILTER ({OK})')} AS eligible_median_skill FROM ({VALID})""")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and skill of all validations and of those that pass the filters."""
    ok = (F.col("skill") >= 0.01) & (F.col("calibration") <= 0.3) & F.col("drift_passed")
    return rounded(reports.validation_summary(validations(spark, sf_dir), ok, "skill"))


@query(f"""WITH c AS ({DAYS}), e AS (SELECT max(date) AS last, min(date) AS first FROM c WHERE date <= DATE '1997-06-30'), k AS (SELECT CAST(unnest(range(0, 4)) AS INT) AS fold),
  f AS (SELECT fold, first AS a, CAST(last - (21 * (4 - fold) - 1) AS DATE) AS c, last FROM e, k),
  w AS (SELECT fold, a, CAST(c - 1 AS DATE) AS b, c, CASE WHEN fold = 3 THEN (SELECT max(date) FROM c WHERE date <= DATE '1997-08-15') ELSE CAST(c + 20 AS DATE) END AS d FROM f)
  SELECT fold, {', '.join(f"min(date) FILTER ({t}) AS {n}_start, max(date) FILTER ({t}) AS {n}_end, count(*) FILTER ({t}) AS {n}_obs, CAST(max(date) FILTER ({t}) - min(date) FILTER ({t}) AS INT) AS {n}_span_days" for n, t in (('train', 'date BETWEEN a AND b'), ('test', 'date BETWEEN w.c AND d')))},
    (SELECT count(*) * 3 FROM c) AS horizon_days FROM w JOIN c ON date BETWEEN a AND d GROUP BY fold""")
def inner_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested folds of the calendar up to June 1997, the last test window moved on to August, and all days by horizon."""
    from datetime import date

    table = days(spark, sf_dir)
    cal = [x.date for x in table.orderBy("date").collect()]  # the calendar's days
    folds = splits.nested_folds([d for d in cal if d <= date(1997, 6, 30)], 4)
    folds = splits.extended(folds, cal, date(1997, 8, 15))
    n = splits.horizon_holdouts(table).agg(F.count("*").alias("horizon_days"))
    return splits.fold_summary(spark, folds, table).join(F.broadcast(n))


# skill of a forecast against the marginal and the uniform one


@query(f"""WITH f AS (SELECT *, {_band_sql('fwd')} AS band FROM ({forward_sql()}) WHERE fwd IS NOT NULL), c AS (SELECT ticker, band, count(*) AS k FROM f WHERE pos % 2 = 1 AND band IS NOT NULL GROUP BY 1, 2),
  g AS (SELECT t.ticker, b.band, coalesce(k, 0) AS k FROM (SELECT DISTINCT ticker FROM c) t CROSS JOIN (SELECT CAST(unnest(range(0, {N_BANDS})) AS INT) AS band) b LEFT JOIN c ON c.ticker = t.ticker AND c.band = b.band),
  s AS (SELECT ticker, band, k * 1e0 / sum(k) OVER (PARTITION BY ticker) AS own, sum(k) OVER (PARTITION BY band) * 1e0 / sum(k) OVER () AS marginal FROM g),
  p AS (SELECT ticker, kind, band, (share + 1e-6) / sum(share + 1e-6) OVER (PARTITION BY ticker, kind) AS p FROM (SELECT ticker, band, 'own' AS kind, own AS share FROM s UNION ALL SELECT ticker, band, 'marginal', marginal FROM s UNION ALL SELECT ticker, band, 'uniform', 1e0 / {N_BANDS} FROM s)),
  q AS (SELECT p.*, low, high, sum(p) OVER (PARTITION BY ticker, kind ORDER BY p.band) AS top FROM p JOIN {EDGE_SQL} e ON e.band = p.band),
  y AS (SELECT ticker, pos, least(greatest(fwd, {EDGES[0]}), {EDGES[-1]}) AS y FROM f WHERE pos % 2 = 0),
  z AS (SELECT q.ticker, kind, pos, sum((high - low) * ((power(top - p + p * u, 3) - power(top - p, 3)) / (3 * p) + (power(top - 1, 3) - power(top - p + p * u - 1, 3)) / (3 * p))) AS crps
    FROM (SELECT q.*, y.pos, least(greatest((y.y - low) / (high - low), 0), 1) AS u FROM q JOIN y ON y.ticker = q.ticker) q GROUP BY 1, 2, 3),
  m AS (SELECT ticker, {', '.join(f"avg(crps) FILTER (kind = '{k}') AS {k}" for k in ('own', 'marginal', 'uniform'))}, count(DISTINCT pos) AS n FROM z GROUP BY 1)
  SELECT ticker, n, {r('own', 5)} AS crps, {r('marginal - own', 5)} AS skill_vs_marginal, {r('uniform - own', 5)} AS skill_vs_uniform FROM m""")
def forecast_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much lower each ticker's forecast scores than that of all tickers and than equal bands, on the other half of its days."""
    f = forward_returns(spark, sf_dir).where(F.col("fwd").isNotNull())
    odd = f.where("pos % 2 = 1")
    own = scoring.histogram(odd, ["ticker"], "fwd", EDGES).select("ticker", scoring.smoothed(F.col("probs")).alias("own"))
    every = scoring.histogram(odd.withColumn("one", F.lit(1)), ["one"], "fwd", EDGES).select(scoring.smoothed(F.col("probs")).alias("marginal"))
    rows = f.where("pos % 2 = 0").join(own, "ticker").join(F.broadcast(every)).withColumn("uniform", F.array(*[F.lit(1.0 / N_BANDS)] * N_BANDS))
    crps = {k: F.avg(scoring.crps(k, "fwd", EDGES)) for k in ("own", "marginal", "uniform")}
    g = rows.groupBy("ticker").agg(F.count("*").alias("n"), *(c.alias(k) for k, c in crps.items()))
    return rounded(
        g.select("ticker", "n", F.col("own").alias("crps"), scoring.skill(F.col("own"), F.col("marginal")).alias("skill_vs_marginal"), scoring.skill(F.col("own"), F.col("uniform")).alias("skill_vs_uniform")), 5
    )


# scores of the search and of Sharpe ratios


DAILY_R = f"SELECT ticker, trigger_date, median(pnl_pct) / 10 AS r FROM ({TRADES}) GROUP BY 1, 2"
STRUCTURES = (("long_call", -1.0, -0.5, 1.0, -0.5, 1.0), ("long_put", 1.0, -0.5, -1.0, 1.0, -0.5), ("call_spread", -1.0, 0.0, 1.2, -0.5, -0.5),
              ("put_spread", 1.2, 0.0, -1.0, -0.5, -0.5), ("straddle", 0.3, -1.5, 0.3, 1.0, 1.0), ("iron_condor", -0.5, 1.5, -0.5, -1.0, -1.0))


@query(f"""WITH d AS ({DAILY_R}), m AS (SELECT *, avg(r) OVER w AS mu, stddev_samp(r) OVER w AS sd FROM d WINDOW w AS (PARTITION BY ticker)),
  g AS (SELECT ticker, count(*) AS n, any_value(mu / sd) AS sr, avg(power((r - mu) / sd, 3)) AS skew, avg(power((r - mu) / sd, 4)) - 3 AS kurt FROM m GROUP BY 1),
  h AS (SELECT *, 1 - skew * sr + (kurt + 2) / 4 * sr * sr AS v FROM g),
  x AS (SELECT *, sr * sqrt(n - 1) / sqrt(v) AS a, (sr - sqrt(2 * ln(50e0) / (n - 1))) * sqrt(n - 1) / sqrt(v) AS b FROM h)
  SELECT ticker, n, {r('sr', 5)} AS sr, {r(normal_sql('a'), 5)} AS probabilistic, {r(normal_sql('b'), 5)} AS deflated, {r('greatest(0, sr * 16 - sqrt(ln(50e0)) / sqrt(n - 1))', 4)} AS shrunk FROM x""")
def sharpe_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratio of each ticker's daily returns, the probability that it is above 0 and above the best of 50 trials, and its shrunken form."""
    from tidemark.operators.gates import safe_deflated

    d = ledger.daily_by_trigger(trades(spark, sf_dir), ["ticker"]).withColumn("r", F.col("r") / 10)
    w = Window.partitionBy("ticker")
    z = (F.col("r") - F.avg("r").over(w)) / F.stddev_samp("r").over(w)
    g = d.withColumn("z", z).groupBy("ticker").agg(
        F.count("*").alias("n"), (F.avg("r") / F.stddev_samp("r")).alias("sr"), F.avg(F.pow("z", F.lit(3))).alias("skew"), (F.avg(F.pow("z", F.lit(4))) - 3).alias("kurt")
    )
    sr, n, skew, kurt = (F.col(c) for c in ("sr", "n", "skew", "kurt"))
    out = g.select(
        "ticker", "n", "sr", ledger.probabilistic_sharpe(sr, n, skew, kurt).alias("probabilistic"), ledger.deflated_sharpe(sr, n, skew, kurt, 50).alias("deflated"),
        safe_deflated(sr * 16, n, 50).alias("shrunk"),
    )
    return rounded(out, 5, shrunk=4)


SCORED = f"""SELECT setup_id, avg(pnl_pct) * 100 AS a, CASE WHEN setup_id % 9 <> 0 THEN avg(pnl_pct) / stddev_samp(pnl_pct) * 100 END AS b, count(*) AS n, count(DISTINCT ticker) AS t,
  list_sort(list(DISTINCT ticker) FILTER (pnl_pct > 0.25)) AS up, list_sort(list(DISTINCT ticker) FILTER (pnl_pct < -0.2)) AS down,
  {', '.join(f"avg(CASE WHEN {t} THEN 1e0 ELSE 0e0 END) AS p{k}" for k, t in enumerate(('pnl_pct < -0.05', 'abs(pnl_pct) <= 0.05', 'pnl_pct > 0.05', 'pnl_pct < -0.15', 'pnl_pct > 0.2')))} FROM ({TRADES}) GROUP BY 1"""
SHORT = "0.6 * greatest(0, (700 - n) * 1e0 / 700) + 0.4 * greatest(0, (8 - t) * 1e0 / 8)"
BEST = "greatest(" + ", ".join("(" + " + ".join(f"{w} * p{k}" for k, w in enumerate(ws)) + ")" for _, *ws in STRUCTURES) + ")"
JAC = "CASE WHEN len(list_distinct(list_concat(coalesce(up, []), coalesce(down, [])))) > 0 THEN len(list_intersect(coalesce(up, []), coalesce(down, []))) * 1e0 / len(list_distinct(list_concat(coalesce(up, []), coalesce(down, [])))) END"


@query(f"""SELECT setup_id, {r('least(greatest(a, -10), 10)', 5)} AS plain, {r('CASE WHEN b IS NULL THEN -999 ELSE sign(b) * ln(1 + abs(b)) END', 5)} AS ratio, {r(f'1 + ({SHORT}) / (1 + {SHORT})', 5)} AS penalty,
  {r(f'0.5 * (1 - coalesce({JAC}, 1)) + 0.5 * CASE WHEN n % 3 <> t % 3 THEN 1 ELSE 0 END', 5)} AS distance, {r(f'coalesce({JAC}, 0)', 5)} AS overlap,
  CASE {' '.join("WHEN round(" + " + ".join(f"{w} * p{k}" for k, w in enumerate(ws)) + f", 9) = round({BEST}, 9) THEN '{name}'" for name, *ws in STRUCTURES)} END AS structure FROM ({SCORED})""")
def search_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clamped objectives, penalty, distance and overlap of two ticker sets, and the option structure that fits each setup's results."""
    from tidemark.operators import search, selection, subspaces

    x = F.col("pnl_pct")
    part = lambda test: F.avg(test.cast("double"))
    g = trades(spark, sf_dir).groupBy("setup_id").agg(
        (F.avg(x) * 100).alias("a"), (F.avg(x) / F.stddev_samp(x) * 100).alias("b"), F.count("*").alias("n"), F.count_distinct("ticker").alias("t"),
        F.collect_set(F.when(x > 0.25, F.col("ticker"))).alias("up"), F.collect_set(F.when(x < -0.2, F.col("ticker"))).alias("down"),
        part(x < -0.05).alias("p0"), part(F.abs(x) <= 0.05).alias("p1"), part(x > 0.05).alias("p2"), part(x < -0.15).alias("p3"), part(x > 0.2).alias("p4"),
    ).withColumn("b", F.when(F.col("setup_id") % 9 != 0, F.col("b")))
    n, t = F.col("n"), F.col("t")
    out = g.select(
        "setup_id", search.clamp_objective(F.col("a"), False).alias("plain"), search.clamp_objective(F.col("b"), True).alias("ratio"),
        search.penalty_scalar([(n, F.lit(700.0), 0.6), (t, F.lit(8.0), 0.4)]).alias("penalty"),
        search.setup_distance(F.col("up"), F.col("down"), n % 3, t % 3).alias("distance"), subspaces.overlap(F.col("up"), F.col("down")).alias("overlap"),
        selection.option_structure(*(F.col(f"p{k}") for k in range(5))).alias("structure"),
    )
    return rounded(out, 5)

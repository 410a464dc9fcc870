"""Queries over held-out evaluation: purged paths, forecasts out of fold, exits, regimes, shared signals; SQL by hand."""

from __future__ import annotations

from datetime import date

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import bitmaps, cpcv, exits, gates, gauntlet, islands, joins, kernels, ledger, mixtures, options, predictive, regression, signals, slates, splits, validation
from tidemark.operators import objectives as objectives_of
from tidemark.plans.domain import TRADES, trades
from tidemark.plans.panel import BARS, bars
from tidemark.plans.relational import EDGES, EXP, FIRED, N_BANDS, OBJ, STEP, _band_sql, _feat_sql, feature_rows, normal_sql, objectives, price_sql, query, r, returns, rounded
from tidemark.plans.stages import CONVENTIONS, SHARES, STAGE1, STAGE2, THINNED, conventions, shares, stage1, thinned

# combinatorially purged cross-validation of the ledger; the regime of a trade is its ticker

PLAN = cpcv.Plan()
_SUBSETS = ", ".join(f"({k}, {list(s)})" for k, s in enumerate(PLAN.subsets))
_PATHS = ", ".join(map(str, PLAN.paths))

PURGED = f"""t AS (SELECT *, row_number() OVER () AS id FROM ({TRADES}) WHERE exit_date IS NOT NULL AND trigger_date IS NOT NULL AND pnl_pct IS NOT NULL),
  cal AS (SELECT date, ntile({PLAN.blocks}) OVER (ORDER BY date) - 1 AS block FROM (SELECT DISTINCT trigger_date AS date FROM ({TRADES}) WHERE trigger_date IS NOT NULL)),
  blocks AS (SELECT block, min(date) AS a, max(date) AS b FROM cal GROUP BY 1),
  rows_ AS (SELECT t.*, block, greatest(trigger_date, exit_date) AS own FROM t JOIN cal ON date = trigger_date),
  reach AS (SELECT s.setup_id, k.block, any_value(a) AS a, greatest(any_value(b), coalesce(max(own), any_value(b))) + {PLAN.embargo} AS z
    FROM (SELECT DISTINCT setup_id FROM rows_) s CROSS JOIN blocks k LEFT JOIN rows_ x ON x.setup_id = s.setup_id AND x.block = k.block GROUP BY 1, 2),
  near AS (SELECT id, list(h.block) AS near FROM rows_ x JOIN reach h ON h.setup_id = x.setup_id AND trigger_date <= z AND own >= a GROUP BY 1),
  subsets(subset, held) AS (VALUES {_SUBSETS}),
  sides AS (SELECT x.setup_id, subset, pnl_pct, CASE WHEN list_contains(held, block) THEN 'out' WHEN NOT list_has_any(held, near) THEN 'in' END AS side FROM rows_ x JOIN near USING (id) CROSS JOIN subsets),
  sums AS (SELECT setup_id, subset, count(*) FILTER (side = 'in') AS n_train, count(*) FILTER (side = 'out') AS n_test, avg(pnl_pct) FILTER (side = 'in') AS m,
    avg(pnl_pct) FILTER (side = 'out') AS mo, stddev_samp(pnl_pct) FILTER (side = 'in') AS sd, stddev_samp(pnl_pct) FILTER (side = 'out') AS sdo FROM sides GROUP BY 1, 2),
  fits AS (SELECT *, CASE WHEN m IS NULL THEN 0 WHEN m >= -1e-9 THEN 1 ELSE -1 END AS direction, CASE WHEN sd * sd > 1e-12 THEN m / sd END AS sharpe_in,
    CASE WHEN sdo * sdo > 1e-12 THEN mo / sdo END * CASE WHEN m IS NULL THEN 0 WHEN m >= -1e-9 THEN 1 ELSE -1 END AS sharpe_out FROM sums),
  paths(path, block, subset) AS (VALUES {_PATHS}),
  day AS (SELECT setup_id, block, trigger_date, sum(pnl_dollars) / 100000 AS r, count(*) AS trades FROM rows_ GROUP BY 1, 2, 3),
  pathday AS (SELECT d.setup_id, path, trigger_date, d.r * direction AS r, trades FROM day d JOIN paths p ON p.block = d.block JOIN fits f ON f.setup_id = d.setup_id AND f.subset = p.subset WHERE direction <> 0),
  quant AS (SELECT setup_id, path, quantile_cont(r, 0.05) AS q FROM pathday GROUP BY 1, 2),
  metric AS (SELECT setup_id, path, count(*) AS n_obs, CAST(sum(trades) AS BIGINT) AS support, sum(r) AS total_r, coalesce(CASE WHEN stddev_samp(r) > 1e-15 THEN avg(r) / stddev_samp(r) * sqrt(252) END, 0) AS sharpe,
    avg(r) FILTER (r <= q) AS cvar5 FROM pathday JOIN quant USING (setup_id, path) GROUP BY 1, 2),
  path_metric AS (SELECT *, CASE WHEN n_obs > 1 THEN greatest(0, sharpe - 1 / sqrt(n_obs - 1)) ELSE 0 END AS dsr FROM metric)"""


def purged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled trades and what each subset of blocks learns."""
    t = trades(spark, sf_dir, numbered=True)
    days = t.where("trigger_date is not null").select(F.col("trigger_date").alias("date")).distinct()
    rows = cpcv.labelled(t, cpcv.block_bounds(days, PLAN), PLAN)
    return rows, cpcv.learnt(rows, spark, PLAN)


def purged_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Metrics of the paths, and the fits."""
    rows, fits = purged(spark, sf_dir)
    return cpcv.path_metrics(cpcv.path_returns(rows, fits, spark, PLAN)), fits


@query(f"WITH {PURGED} SELECT setup_id, subset, n_train, n_test, direction, {r('sharpe_in', 5)} AS sharpe_in, {r('sharpe_out', 5)} AS sharpe_out FROM fits")
def cpcv_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each setup learns beside each held-out subset of blocks, and how it does there."""
    return rounded(purged(spark, sf_dir)[1], 5)


@query(f"WITH {PURGED} SELECT setup_id, path, n_obs, support, {', '.join(f'{r(c, 5)} AS {c}' for c in ('total_r', 'sharpe', 'dsr', 'cvar5'))} FROM path_metric")
def cpcv_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every setup on every path of held-out blocks."""
    return rounded(purged_paths(spark, sf_dir)[0], 5)


_GATES = [
    ("S3_MEDIAN_DSR_LOW", "median_dsr >= 0.35"), ("S3_IQR_HIGH", "iqr_sharpe <= 0.7"), ("S3_CVAR_TAIL", "cvar5 >= -0.12"), ("S3_SUPPORT_RATE_LOW", "support_rate >= 0.6"),
    ("S3_PBO_HIGH", "pbo <= 0.3"), ("S3_SPEARMAN_LOW", "spearman >= 0.35"), ("S3_REGIME_MONO", "regimes >= 2 AND top_coverage < 0.8"), ("S3_FRAGILITY_HIGH", "fragility <= 0.35"),
]
_FAILED = f"list_filter([{', '.join(f'CASE WHEN NOT coalesce({ok}, false) THEN {chr(39)}{code}{chr(39)} END' for code, ok in _GATES)}], lambda x: x IS NOT NULL)"

ROBUST_CPCV = f"""{PURGED},
  ranks AS (SELECT subset, row_number() OVER (PARTITION BY subset ORDER BY round(sharpe_in, 9) DESC NULLS LAST, setup_id) AS ra,
    row_number() OVER (PARTITION BY subset ORDER BY round(sharpe_out, 9) DESC NULLS LAST, setup_id) AS rb, greatest(1, round_even(count(*) OVER (PARTITION BY subset) * 0.2e0, 0)) AS q FROM fits),
  over_ AS (SELECT avg(p) AS pbo, avg(s) AS spearman FROM (SELECT subset, count(*) FILTER (ra <= q AND rb > q) * 1e0 / count(*) FILTER (ra <= q) AS p, corr(ra, rb) AS s FROM ranks GROUP BY 1)),
  g AS (SELECT setup_id, count(*) AS paths, median(dsr) AS median_dsr, quantile_cont(sharpe, 0.75) - quantile_cont(sharpe, 0.25) AS iqr_sharpe, median(cvar5) AS cvar5,
    avg(CASE WHEN support >= 30 THEN 1e0 ELSE 0e0 END) AS support_rate FROM path_metric GROUP BY 1),
  reg AS (SELECT setup_id, ticker, count(*) AS support, count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY setup_id) AS coverage, CASE WHEN stddev_samp(pnl_pct) > 1e-12 THEN avg(pnl_pct) / stddev_samp(pnl_pct) END AS sharpe
    FROM rows_ GROUP BY 1, 2),
  rg AS (SELECT setup_id, count(*) FILTER (coverage >= 0.15 AND support >= 20) AS regimes, max(coverage) AS top_coverage, coalesce(greatest(max(sharpe) - median(sharpe), 0), 0) AS fragility FROM reg GROUP BY 1),
  stage3 AS (SELECT *, {_FAILED} AS failed FROM g JOIN rg USING (setup_id) CROSS JOIN over_)"""


def cpcv_stage3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = purged(spark, sf_dir)[0]
    # fits, paths and regimes read these columns of one copy, not the ledger thrice
    rows = rows.select("setup_id", "ticker", "trigger_date", "block", "near", "pnl_pct", "pnl_dollars", "row").persist(StorageLevel.MEMORY_AND_DISK)
    fits = cpcv.learnt(rows, spark, PLAN)
    paths = cpcv.path_metrics(cpcv.path_returns(rows, fits, spark, PLAN))
    sd = F.stddev_samp("pnl_pct")
    reg = rows.groupBy("setup_id", "ticker").agg(F.count("*").alias("support"), F.when(sd > 1e-12, F.avg("pnl_pct") / sd).alias("sharpe"))
    reg = reg.withColumn("coverage", F.col("support") / F.sum("support").over(Window.partitionBy("setup_id")))
    return cpcv.robustness(paths, reg, cpcv.overfitting(fits))


@query(f"""WITH {ROBUST_CPCV} SELECT setup_id, paths, regimes, {', '.join(f'{r(c, 5)} AS {c}' for c in ('median_dsr', 'iqr_sharpe', 'cvar5', 'support_rate', 'top_coverage', 'fragility', 'pbo', 'spearman'))},
  failed[1] AS reject_code, CASE WHEN len(failed) = 0 THEN 'ok' ELSE array_to_string(failed, ';') END AS reason, len(failed) = 0 AS pass_stage3 FROM stage3""")
def cpcv_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third stage of the gauntlet over the purged paths: the first failed gate, and all of them."""
    return rounded(cpcv_stage3(spark, sf_dir), 5)


# the portfolio stage and the decision: live are the setups 1 to 3, busy days those of setup 1


STAGE4 = f"""cap AS (SELECT setup_id, avg((ok_volume + ok_interest + ok_px_volume) / 3) AS capacity FROM ({TRADES}) JOIN ({SHARES}) USING (ticker) GROUP BY 1),
  live AS (SELECT DISTINCT trigger_date FROM ({TRADES}) WHERE setup_id = 1),
  busy AS (SELECT setup_id, avg(CASE WHEN live.trigger_date IS NOT NULL THEN 1e0 ELSE 0e0 END) AS overlap FROM (SELECT DISTINCT setup_id, trigger_date FROM ({TRADES})) LEFT JOIN live USING (trigger_date) GROUP BY 1),
  rday AS (SELECT setup_id, trigger_date, median(pnl_pct) AS r FROM ({TRADES}) GROUP BY 1, 2),
  pair AS (SELECT c.setup_id, l.setup_id AS live, count(*) AS n, CASE WHEN stddev_samp(c.r) * stddev_samp(l.r) > 1e-15 THEN covar_samp(c.r, l.r) / (stddev_samp(c.r) * stddev_samp(l.r)) END AS k
    FROM rday c JOIN rday l ON l.trigger_date = c.trigger_date AND l.setup_id <= 3 WHERE c.setup_id > 3 GROUP BY 1, 2),
  crowd AS (SELECT setup_id, avg(abs(k)) AS mean_abs_corr FROM pair WHERE n >= 10 GROUP BY 1),
  fit4 AS (SELECT g.setup_id, median_dsr AS dsr, capacity, mean_abs_corr, overlap, coalesce(median_dsr * (0.5 + 0.5 * capacity), median_dsr) AS dsr_after_capacity
    FROM stage3 g LEFT JOIN cap USING (setup_id) LEFT JOIN crowd USING (setup_id) LEFT JOIN busy USING (setup_id)),
  stage4 AS (SELECT *, 0.6 * dsr_after_capacity + 0.4 * (1 - mean_abs_corr) AS portfolio_score, list_filter([CASE WHEN dsr_after_capacity < 0.2 THEN 'S4_CAPACITY' END,
    CASE WHEN mean_abs_corr > 0.35 THEN 'S4_CORR' END, CASE WHEN overlap > 0.35 THEN 'S4_OVERLAP' END], lambda x: x IS NOT NULL) AS failed4 FROM fit4)"""


def stage4(spark: SparkSession, sf_dir: str, stage3: DataFrame) -> DataFrame:
    t = trades(spark, sf_dir).repartition("setup_id")  # medians of dealt rows: no lists of values are shuffled
    market = shares(spark, sf_dir).withColumn("capacity", gauntlet.capacity()).select("ticker", "capacity")
    d = ledger.daily_by_trigger(t, ["setup_id"])
    live = d.where("setup_id <= 3").withColumnRenamed("setup_id", "live_id")
    parts = (
        t.join(F.broadcast(market), "ticker").groupBy("setup_id").agg(F.avg("capacity").alias("capacity")),
        gates.mean_abs_corr(d.where("setup_id > 3"), live, "setup_id", "live_id", "trigger_date", "r"),
        gates.overlap(t, trades(spark, sf_dir).where("setup_id = 1")),
    )
    rows = stage3.select("setup_id", F.col("median_dsr").alias("dsr"))
    for part in parts:
        rows = rows.join(part, "setup_id", "left")
    return gauntlet.portfolio(rows)


@query(f"""WITH {ROBUST_CPCV}, {STAGE4} SELECT setup_id, {', '.join(f'{r(c, 5)} AS {c}' for c in ('dsr', 'capacity', 'mean_abs_corr', 'overlap', 'dsr_after_capacity', 'portfolio_score'))},
  failed4[1] AS reject_code, CASE WHEN len(failed4) = 0 THEN 'ok' ELSE array_to_string(failed4, ';') END AS reason, len(failed4) = 0 AS pass_stage4 FROM stage4""")
def gauntlet_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourth stage: capacity, crowding and overlap with the live book."""
    return rounded(stage4(spark, sf_dir, cpcv_stage3(spark, sf_dir)), 5)


_HART3 = """greatest(least(greatest(median_dsr, 0), 2) / 2 + 0.3 * least(greatest(support_rate, 0), 1) - 0.4 * least(iqr_sharpe, 1)
  - 0.3 * least(greatest((0.5 - cvar5) / 0.5, 0), 1) - 0.2 * least(fragility / 0.5, 1) - 0.5 * CASE WHEN top_coverage >= 0.8 THEN 1 ELSE 0 END, 0)"""


@query(f"""WITH {ROBUST_CPCV}, {STAGE4}, one AS (SELECT setup_id, bool_or(reason NOT LIKE '%S1_DAILY_CAP%') AS pass_stage1, avg(CASE WHEN reason = 'ok' THEN 1e0 ELSE 1 - len(string_split(reason, ';')) / 10e0 END) AS score_1 FROM ({STAGE1}) GROUP BY 1),
  two AS (SELECT setup_id, wf_fold_min_return >= -0.2 AS pass_stage2, wf_sharpe AS score_2 FROM ({STAGE2})),
  s AS (SELECT one.setup_id, pass_stage1, score_1, pass_stage2, score_2, len(failed) < 4 AS pass_stage3, {_HART3} AS score_3, len(failed4) < 2 AS pass_stage4, portfolio_score AS score_4
    FROM one JOIN two USING (setup_id) JOIN stage3 USING (setup_id) JOIN stage4 USING (setup_id)),
  f AS (SELECT *, list_filter([{', '.join(f"CASE WHEN NOT coalesce(pass_stage{k}, false) THEN 'S{k}' END" for k in range(1, 5))}], lambda x: x IS NOT NULL) AS failed,
    {' + '.join(f'{w} * least(greatest(coalesce(score_{k}, 0.5) / 2, 0), 1)' for k, w in ((1, 0.1), (2, 0.25), (3, 0.45), (4, 0.2)))} AS score FROM s)
  SELECT setup_id, {r('CASE WHEN len(failed) = 0 THEN score ELSE 0 END', 5)} AS promotion_score,
    CASE WHEN len(failed) > 0 THEN 'S5_UPSTREAM_FAIL_' || array_to_string(failed, '+') WHEN score < 0.3 THEN 'S5_LOW_SCORE' END AS reject_code,
    len(failed) = 0 AND score >= 0.3 AS pass_stage5 FROM f""")
def gauntlet_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifth stage over the four before it; here the third passes with three failed gates, the fourth with one, and the first without its daily cap."""
    third = cpcv_stage3(spark, sf_dir).withColumn("mono_regime", F.col("top_coverage") >= 0.8).persist()
    fourth = stage4(spark, sf_dir, third)
    n_failed = F.when(F.col("reason") == "ok", 0).otherwise(F.size(F.split("reason", ";")))
    a = stage1(spark, sf_dir).groupBy("setup_id").agg(F.max(~F.col("reason").contains("S1_DAILY_CAP")).alias("pass_stage1"), F.avg(1 - n_failed / 10).alias("score_1"))
    b = rounded(gauntlet.walk_forward_profit(trades(spark, sf_dir, numbered=True)), 5).select("setup_id", (F.col("wf_fold_min_return") >= -0.2).alias("pass_stage2"), F.col("wf_sharpe").alias("score_2"))
    c = third.select("setup_id", (n_failed < 4).alias("pass_stage3"), gauntlet.composite_score(False).alias("score_3"))
    d = fourth.select("setup_id", (n_failed < 2).alias("pass_stage4"), F.col("portfolio_score").alias("score_4"))
    s = a.join(b, "setup_id").join(c, "setup_id").join(d, "setup_id")
    return rounded(gauntlet.final(s, 0.3).select("setup_id", "promotion_score", "reject_code", "pass_stage5"), 5)


# forecasts out of fold: setups are pairs of a price rule and a volume rule on a ticker

HORIZONS = (1, 5, 21)
FIRST, EVERY, WINDOW_DAYS = 756, 63, 63


def spans(spark: SparkSession, sf_dir: str) -> list[validation.FoldSpan]:
    """Folds of the bars' calendar: three years of training at least, tests of a quarter, the longest horizon purged between them."""
    n = bars(spark, sf_dir).agg(F.count_distinct("date")).first()[0]
    starts = range(FIRST + max(HORIZONS), n - 4, EVERY)
    return [validation.FoldSpan(k, a - max(HORIZONS) - 1, a, min(a + WINDOW_DAYS, n) - 1) for k, a in enumerate(starts)]


SETUPS = f"""(SELECT a.ticker, a.date, a.rule || '+' || b.rule AS setup FROM (SELECT * FROM fired WHERE feature = 'px_last') a JOIN (SELECT * FROM fired WHERE feature = 'volume') b USING (ticker, date))"""

FOLD_SQL = f"""feats AS ({_feat_sql()}), fired AS ({FIRED}), cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM ({BARS}))),
  fold AS (SELECT CAST((a - {FIRST + max(HORIZONS)}) / {EVERY} AS INT) AS fold, a - {max(HORIZONS) + 1} AS train_end, a AS test_start, least(a + {WINDOW_DAYS}, n) - 1 AS test_end
    FROM (SELECT unnest(range({FIRST + max(HORIZONS)}, n - 4, {EVERY})) AS a, n FROM (SELECT DISTINCT n FROM cal))),
  px AS (SELECT ticker, date, pos, px_last FROM ({BARS}) JOIN cal USING (date)), h(horizon) AS (VALUES {', '.join(f'({h})' for h in HORIZONS)}),
  market AS (SELECT a.ticker, a.date, a.pos, horizon, CASE WHEN a.px_last <> 0 THEN z.px_last / a.px_last - 1 END AS fwd FROM px a CROSS JOIN h JOIN px z ON z.ticker = a.ticker AND z.pos = a.pos + horizon)"""


def _hist(rows: str, by: str) -> str:
    """Smoothed probabilities of the bands by group, as a list; and the number of rows."""
    share = [f"count(*) FILTER (({_band_sql('fwd')}) = {k})" for k in range(N_BANDS)]
    total = " + ".join(share)
    raw = [f"({c}) / (({total}) + 1e-9) + 1e-6" for c in share]
    return f"(SELECT {by}, count(*) AS n, [{', '.join(raw)}] AS p0 FROM ({rows}) GROUP BY {by})"


def _crps_of(p: str, y: str = "fwd") -> str:
    """CRPS of the bands' probabilities, written out band by band."""
    out = []
    for k, (a, b) in enumerate(zip(EDGES, EDGES[1:])):
        low = f"list_sum({p}[1:{k}])" if k else "0e0"
        u = f"least(greatest((least(greatest({y}, {EDGES[0]}), {EDGES[-1]}) - ({a})) / {b - a}, 0), 1)"
        w = f"{p}[{k + 1}]"
        out.append(f"{b - a} * ((power({low} + {w} * {u}, 3) - power({low}, 3)) / (3 * {w}) + (power({low} + {w} - 1, 3) - power({low} + {w} * {u} - 1, 3)) / (3 * {w}))")
    return " + ".join(out)


def _quantile_of(p: str, q: float) -> str:
    cases = "".join(
        f"WHEN list_sum({p}[1:{k + 1}]) >= {q} - 1e-12 THEN {a} + ({q} - {f'list_sum({p}[1:{k}])' if k else '0'}) / {p}[{k + 1}] * {b - a} " for k, (a, b) in enumerate(zip(EDGES, EDGES[1:]))
    )
    return f"CASE {cases} ELSE {EDGES[-1]} END"


WIDTHS = [b - a for a, b in zip(EDGES, EDGES[1:])]


def _validated_sql(least_train: int, least_test: int) -> str:
    return f"""{FOLD_SQL}, trig AS (SELECT m.*, setup FROM market m JOIN {SETUPS} USING (ticker, date) WHERE fwd IS NOT NULL),
  train AS (SELECT trig.*, fold FROM trig JOIN fold ON pos + horizon <= train_end), test AS (SELECT trig.*, fold FROM trig JOIN fold ON pos >= test_start AND pos + horizon <= test_end),
  mtest AS (SELECT market.*, fold FROM market JOIN fold ON pos >= test_start AND pos + horizon <= test_end WHERE fwd IS NOT NULL),
  fit AS (SELECT *, list_transform(p0, lambda x: x / list_sum(p0)) AS p FROM {_hist('SELECT * FROM train', 'ticker, setup, horizon, fold')} WHERE n >= {least_train}),
  marg AS (SELECT * EXCLUDE (n), list_transform(p0, lambda x: x / list_sum(p0)) AS mp FROM {_hist('SELECT * FROM mtest', 'ticker, horizon, fold')}),
  joined AS (SELECT t.*, f.n AS n_train, p, mp, {[1 / N_BANDS] * N_BANDS} AS up FROM test t JOIN fit f USING (ticker, setup, horizon, fold) JOIN marg USING (ticker, horizon, fold)),
  each AS (SELECT *, {_crps_of('p')} AS c, {_crps_of('up')} AS cu, {_crps_of('mp')} AS cm, {_quantile_of('p', 0.1)} AS q10, {_quantile_of('p', 0.9)} AS q90, {_band_sql('fwd')} AS band FROM joined),
  g AS (SELECT ticker, setup, horizon, fold, any_value(n_train) AS n_train, count(*) AS n_test, avg(c) AS crps, avg(CASE WHEN fwd >= q10 THEN 0.9 * (fwd - q10) ELSE 0.1 * (q10 - fwd) END) AS pinball_q10,
    avg(CASE WHEN fwd >= q90 THEN 0.1 * (fwd - q90) ELSE 0.9 * (q90 - fwd) END) AS pinball_q90, avg(cu) - avg(c) AS skill_vs_uniform, avg(cm) - avg(c) AS skill_vs_marginal,
    any_value(p) AS p, [{', '.join(f'count(*) FILTER (band = {k})' for k in range(N_BANDS))}] AS k, count(band) AS inside FROM each GROUP BY ALL HAVING count(*) >= {least_test}),
  validated AS (SELECT *, CASE WHEN inside > 0 THEN list_sum(list_transform(range(1, {N_BANDS + 1}), lambda i: abs(p[i] - k[i] * 1e0 / inside))) / {N_BANDS} END AS calibration_mae,
    CASE WHEN inside > 0 THEN list_sum(list_transform(range(1, {N_BANDS + 1}), lambda i: (k[i] + 1e0) / (inside + {N_BANDS}) * (ln((k[i] + 1e0) / (inside + {N_BANDS})) - ln(greatest(p[i], 1e-12))))) / ln(2e0) END AS info_gain,
    CASE WHEN inside > 0 THEN list_sum(list_transform(range(1, {N_BANDS + 1}), lambda i: abs(list_sum(p[1:i]) - list_sum(k[1:i]) * 1e0 / inside) * {WIDTHS}[i])) END AS w1_effect FROM g)"""

SCORES = ("crps", "pinball_q10", "pinball_q90", "skill_vs_uniform", "skill_vs_marginal", "calibration_mae", "info_gain", "w1_effect")


def triggered_outcomes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Outcomes of the days on which each setup fires, and of all days."""
    days = bars(spark, sf_dir).select("date").distinct()
    market = validation.outcomes(bars(spark, sf_dir), days, HORIZONS)
    f = signals.compile_rules(feature_rows(spark, sf_dir))
    side = lambda c, n: f.where(F.col("feature") == c).select("ticker", "date", F.col("rule").alias(n))
    setups = side("px_last", "a").join(side("volume", "b"), ["ticker", "date"]).select("ticker", "date", F.concat("a", F.lit("+"), "b").alias("setup"))
    return market.join(setups, ["ticker", "date"]), market


def validated(spark: SparkSession, sf_dir: str, least_train: int = 10, least_test: int = 3) -> DataFrame:
    """Scores of all setups, horizons and folds."""
    triggered, market = triggered_outcomes(spark, sf_dir)
    return validation.scored(triggered, market, spans(spark, sf_dir), ["ticker", "setup"], EDGES, spark, least_train, least_test)


@query(f"WITH {_validated_sql(10, 3)} SELECT ticker, setup, horizon, fold, n_train, n_test, {', '.join(f'{r(c, 5)} AS {c}' for c in SCORES)} FROM validated")
def forecast_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of every setup's banded forecast."""
    return rounded(validated(spark, sf_dir).drop("probs"), 5)


_LOWER = [m for m in SCORES if any(part in m for part in objectives_of.LOWER)]
_TRADE = " + ".join(f"probs[{k + 1}] * {(a + b) / 2}" for k, (a, b) in enumerate(zip(EDGES, EDGES[1:])))
_UP = " + ".join(f"probs[{k + 1}] * {min(max(b / (b - a), 0.0), 1.0)}" for k, (a, b) in enumerate(zip(EDGES, EDGES[1:])))


def _bands(p: str) -> str:
    mid = [f"median({p}[{k + 1}])" for k in range(N_BANDS)]
    return f"[{', '.join(f'{m} / ({" + ".join(mid)} + 1e-9)' for m in mid)}]"


def joint_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = objectives_of.over_folds(validated(spark, sf_dir, 3, 2), ["ticker", "setup"], SCORES, N_BANDS)
    return objectives_of.over_horizons(rows, ["ticker", "setup"], SCORES, EDGES)


OVER_HORIZONS = f"""{_validated_sql(3, 2)}, f AS (SELECT ticker, setup, horizon, count(crps) * 1e0 AS folds_used, {', '.join(f'median({m}) AS {m}' for m in SCORES)}, {_bands('p')} AS probs FROM validated GROUP BY 1, 2, 3),
  m AS (SELECT *, median(crps) OVER (PARTITION BY ticker, setup) AS mid FROM f),
  joint AS (SELECT ticker, setup, count(*) AS horizons, arg_min(horizon, struct_pack(c := crps, h := horizon)) AS best_horizon, quantile_cont(folds_used, 0.75) AS folds_used,
    {', '.join(f'quantile_cont({m}, {0.25 if m in _LOWER else 0.75}) AS {m}' for m in SCORES)}, {_bands('probs')} AS probs, median(abs(crps - mid)) AS horizon_stability_mad FROM m GROUP BY 1, 2)"""


@query(f"""WITH {OVER_HORIZONS}
  SELECT ticker, setup, horizons, best_horizon, {', '.join(f'{r(c, 5)} AS {c}' for c in ('folds_used', *SCORES, 'horizon_stability_mad'))}, {r(_TRADE, 5)} AS expected_move, {r(_UP, 5)} AS p_up,
    {r(f'list_sum(probs) - ({_UP})', 5)} AS p_down, {r('-crps', 5)} AS objective_crps, {r('info_gain', 5)} AS objective_info_gain, {r('skill_vs_marginal', 5)} AS objective_skill_vs_marginal FROM joint WHERE crps IS NOT NULL AND info_gain IS NOT NULL AND skill_vs_marginal IS NOT NULL""")
def setup_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over folds and horizons of each setup that has all, and what a balanced search would maximise."""
    wanted = objectives_of.recommended("balanced")
    return rounded(objectives_of.transformed(joint_scores(spark, sf_dir).dropna(subset=wanted), wanted).drop("probs"), 5)


# exits: each bar opens a call at the money, under three policies

TENOR, MARKED = 21, 45
POLICIES = {"regime_aware": exits.REGIME_AWARE, "moonshot": exits.MOONSHOT, "disabled": exits.DISABLED}
_STRIKE = "least(greatest(round_even(s0 / {0}, 0) * {0}, s0 * 0.5), s0 * 1.5)".format(STEP)


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices of the options opened on each bar; every seventh horizon is longer than the path."""
    w = Window.partitionBy("ticker").orderBy("date")
    b = bars(spark, sf_dir).select("ticker", "date", "px_last", F.col("iv3mc").alias("iv"), F.row_number().over(w).alias("pos"))
    entry = b.select("ticker", "pos", F.col("px_last").alias("s0"))
    path = options.paths(entry, b.withColumn("iv", options.clean_iv(F.col("iv"))).withColumn("px_last", F.struct("date", "px_last")), MARKED - 1)
    strike = options.listed_strike(F.col("s0"), F.col("s0"))
    left = F.greatest(F.lit(TENOR) - F.col("step"), F.lit(1)) / 252.0
    price = options.price(F.col("px.px_last"), strike, left, F.lit(0.0), F.col("iv"), F.lit(True))
    horizon = F.when(F.col("pos") % 7 == 0, 60).otherwise(3 + F.col("pos") % 30)
    return path.select("ticker", "pos", "step", F.col("px.date").alias("day"), F.round(price, 6).alias("price"), F.lit(TENOR).alias("tenor"), horizon.alias("horizon"))


def _rules_sql(p: exits.Policy) -> str:
    target = f"WHEN gain >= {p.target} THEN 'pt_hit_legA' " if p.target is not None else ""
    return f"""CASE {target}WHEN step >= 2 AND gain >= {p.spike_profit} AND abs(c0 - c1) / 2 > {p.spike} THEN 'volatility_spike_profit'
      WHEN (expiry - day) / {TENOR}e0 <= {p.expiry_life} AND gain >= {p.expiry_profit} THEN 'time_decay_protection' WHEN gain <= {p.stop} THEN 'stop_loss'
      WHEN step >= 5 AND gain >= {p.trail_profit} AND price <= high - (high - low) / 5 * {p.trail_ranges} THEN 'atr_trail_hit' WHEN day >= expiry THEN 'option_expired' END"""


EXITS = f"""WITH b AS (SELECT ticker, date, px_last, row_number() OVER (PARTITION BY ticker ORDER BY date) AS pos, CASE WHEN iv3mc > 0 THEN least(greatest(CASE WHEN iv3mc > 2 THEN iv3mc / 100 ELSE iv3mc END, 2e-4), 5e0) END AS v FROM ({BARS})),
  e AS (SELECT ticker, pos, date AS t0, px_last AS s0, {_STRIKE} AS strike, CASE WHEN pos % 7 = 0 THEN 60 ELSE 3 + pos % 30 END AS horizon,
    (SELECT max(x) FROM (SELECT x FROM (SELECT date + CAST(i AS INT) AS x FROM range(1, {TENOR * 2}) g(i)) WHERE isodow(x) < 6 ORDER BY x LIMIT {TENOR})) AS expiry FROM b),
  m AS (SELECT e.*, b.pos - e.pos AS step, b.date AS day, b.px_last AS px, b.v AS iv, greatest({TENOR} - (b.pos - e.pos), 1) / 252e0 AS t FROM e JOIN b ON b.ticker = e.ticker AND b.pos BETWEEN e.pos AND e.pos + {MARKED - 1}),
  p AS (SELECT *, round({price_sql('px', 'strike', 't', 'iv')}, 6) AS price FROM m),
  q AS (SELECT *, first(price) OVER w AS entry_price, lag(price) OVER w AS p1, lag(price, 2) OVER w AS p2, max(price) OVER f AS high, min(price) OVER f AS low, max(step) OVER (PARTITION BY ticker, pos) AS last
    FROM p WINDOW w AS (PARTITION BY ticker, pos ORDER BY step), f AS (PARTITION BY ticker, pos ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
  g AS (SELECT *, CASE WHEN entry_price > 0 THEN (price - entry_price) / entry_price ELSE 0 END AS gain, CASE WHEN p1 <> 0 THEN (price - p1) / p1 END AS c0, CASE WHEN p2 <> 0 THEN (p1 - p2) / p2 END AS c1 FROM q),
  z AS ({' UNION ALL '.join(f"SELECT *, '{n}' AS policy, {_rules_sql(p)} AS rule, CASE WHEN horizon > 0 THEN least(last, greatest(0, horizon - 1)) ELSE last END AS back FROM g" if p.enabled else f"SELECT *, '{n}' AS policy, CASE WHEN step = last AND day >= expiry THEN 'option_expired' END AS rule, NULL AS back FROM g" for n, p in POLICIES.items())}),
  x AS (SELECT policy, ticker, pos, coalesce(min(step) FILTER (rule IS NOT NULL), any_value(back)) AS at, coalesce(arg_min(rule, step) FILTER (rule IS NOT NULL), CASE WHEN any_value(back) IS NOT NULL THEN 'max_horizon_exit' END) AS reason FROM z GROUP BY 1, 2, 3)
  SELECT x.policy, x.ticker, CAST(x.pos AS INT) AS pos, s.t0 AS trigger_date, {r('s.entry_price', 4)} AS entry_price, CAST(x.at AS INT) AS exit_step, reason AS exit_reason, n.day AS exit_date, {r('n.price', 4)} AS exit_price,
    {r('CASE WHEN s.entry_price > 0 THEN n.price / s.entry_price - 1 END', 4)} AS pnl_pct
  FROM x JOIN g s ON s.ticker = x.ticker AND s.pos = x.pos AND s.step = 0 LEFT JOIN g n ON n.ticker = x.ticker AND n.pos = x.pos AND n.step = x.at"""


@query(EXITS)
def exit_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exits of a call opened on every bar, under each policy."""
    return rounded(exits.closed(marks(spark, sf_dir), ["ticker", "pos"], POLICIES), 4)


# regimes of each ticker's days, named alike in all folds


def regime_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[validation.FoldSpan]]:
    """Regime of each ticker's days under the model of every fourth fold's training days."""
    days = bars(spark, sf_dir).select("date").distinct()
    at = days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("pos"))
    rows = bars(spark, sf_dir).select("ticker", "date", "px_last").join(F.broadcast(at), "date")
    rows = mixtures.features(rows, ["ticker"], "pos", "px_last")
    folds = spans(spark, sf_dir)[::4]
    fits = mixtures.aligned(mixtures.fit(rows, {f.number: f.train_end for f in folds}, ["ticker"], ["volatility", "trend"]), ["ticker"])
    return mixtures.assign(rows, fits, ["ticker"], ["volatility", "trend"]), folds


@query()
def regime_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commonest regimes of the training and test days of each ticker and fold, and whether they are one."""
    labels, folds = regime_labels(spark, sf_dir)
    table = spark.createDataFrame([(f.number, f.train_end, f.test_start, f.test_end) for f in folds], "fold int, train_end long, test_start long, test_end long")
    return mixtures.window_regimes(labels, table, ["ticker"])


# what the signals of a setup tell about each other: every two or three signals of a ticker


@query(f"""WITH feats AS ({_feat_sql()}), fired AS ({FIRED}), s AS (SELECT DISTINCT ticker, date, feature || ':' || rule AS signal FROM fired), n AS (SELECT count(DISTINCT date) * 1e0 AS days FROM ({BARS})),
  one AS (SELECT ticker, signal, count(*) AS k FROM s GROUP BY 1, 2), two AS (SELECT a.ticker, a.signal AS a, b.signal AS b, a.k AS n_a, b.k AS n_b FROM one a JOIN one b ON b.ticker = a.ticker AND b.signal > a.signal),
  c AS (SELECT x.ticker, x.signal AS a, y.signal AS b, count(*) AS n_ab FROM s x JOIN s y ON y.ticker = x.ticker AND y.date = x.date AND y.signal > x.signal GROUP BY 1, 2, 3),
  p AS (SELECT two.*, days, coalesce(n_ab, 0) AS n_ab FROM two LEFT JOIN c USING (ticker, a, b), n),
  m AS (SELECT ticker, a, b, {' + '.join(f"CASE WHEN {x} > 0 THEN ({x}) / days * ln((({x}) / days) / (({y}) / days * (({z}) / days))) ELSE 0 END" for x, y, z in (('n_ab', 'n_a', 'n_b'), ('n_a - n_ab', 'n_a', 'days - n_b'), ('n_b - n_ab', 'days - n_a', 'n_b'), ('days - n_a - n_b + n_ab', 'days - n_a', 'days - n_b')))} AS mi FROM p),
  u AS (SELECT ticker, a || '+' || b AS setup, 1 AS pairs, mi AS mean_mi FROM m
    UNION ALL SELECT x.ticker, x.a || '+' || x.b || '+' || y.b, 3, (x.mi + y.mi + z.mi) / 3 FROM m x JOIN m y ON y.ticker = x.ticker AND y.a = x.b JOIN m z ON z.ticker = x.ticker AND z.a = x.a AND z.b = y.b)
  SELECT ticker, setup, pairs, {r('mean_mi')} AS mean_mi FROM u""")
def signal_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean mutual information of the pairs of signals of each setup."""
    f = signals.compile_rules(feature_rows(spark, sf_dir)).select("ticker", "date", F.concat("feature", F.lit(":"), "rule").alias("name"))
    days = bars(spark, sf_dir).select("date").distinct()
    at = days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("pos"))
    fired = f.join(F.broadcast(at), "date").select("ticker", F.concat("ticker", F.lit("/"), "name").alias("signal"), "name", "pos")
    names = fired.select("ticker", "name").distinct()  # the signals of a ticker are a few rules
    other = lambda c: names.select("ticker", F.col("name").alias(c))
    twos = names.join(other("b"), "ticker").where("b > name")
    threes = twos.join(other("c"), "ticker").where("c > b")
    setups = twos.select("ticker", F.array("name", "b").alias("of")).unionByName(threes.select("ticker", F.array("name", "b", "c").alias("of")))
    setups = setups.select("ticker", F.array_join("of", "+").alias("setup"), F.transform("of", lambda x: F.concat("ticker", F.lit("/"), x)).alias("signals"))
    return rounded(bitmaps.mean_information(setups, fired, days.count(), ["ticker", "setup"]))


# kernels over streamed windows, topology, regression


def _huber(x: str) -> str:
    return f"""SELECT ticker, date, k, {x}, CASE WHEN k >= 60 AND len(l) >= 3 AND {x} IS NOT NULL THEN CASE WHEN mad > 0 THEN ({x} - list_sum(list_transform(l, lambda v: v / greatest(1, abs(v - med) / (1.345 * mad + 1e-9))))
      / list_sum(list_transform(l, lambda v: 1 / greatest(1, abs(v - med) / (1.345 * mad + 1e-9))))) / (1.4826 * mad) WHEN sd > 0 THEN ({x} - med) / sd END END AS z
    FROM (SELECT *, list_aggregate(list_transform(l, lambda v: abs(v - med)), 'median') AS mad FROM (SELECT *, list_aggregate(l, 'median') AS med, list_aggregate(l, 'stddev_pop') AS sd
      FROM (SELECT ticker, date, {x}, row_number() OVER w AS k, coalesce(list({x}) FILTER ({x} IS NOT NULL) OVER w, []) AS l FROM ({THINNED}) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))))"""


@query(f"SELECT ticker, date, {r('p.z', 4)} AS px_huber_z, {r('v.z', 4)} AS volume_huber_z FROM ({_huber('px_last')}) p JOIN ({_huber('volume')}) v USING (ticker, date)")
def huber_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust scores of price and volume over the last 60 bars, some without a price."""
    b = thinned(spark, sf_dir).select("ticker", "date", "px_last", "volume")
    score = lambda c, n: kernels.streamed(b, ["ticker"], "date", c, 60, {n: kernels.huber_z})
    return rounded(score("px_last", "px_huber_z").join(score("volume", "volume_huber_z"), ["ticker", "date"]), 4)


@query()
def topology_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of each ticker's quarters to the one before, by the components of their pairs of successive returns."""
    import numpy as np
    import pandas as pd

    def diagram(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("date")["ret"].to_numpy()
        d = kernels.h0_diagram(kernels.embedded(x, 2)) if len(x) > 2 else np.zeros((0, 2))
        return pd.DataFrame({"ticker": [key[0]], "quarter": [key[1]], "deaths": [d[:, 1].tolist()]})

    def distances(batches):
        for pdf in batches:
            full = lambda v: np.c_[np.zeros(len(v)), v] if len(v) else np.zeros((0, 2))
            both = [(full(np.array(a, float)), full(np.array(b, float))) for a, b in zip(pdf["deaths"], pdf["before"])]
            pdf["points"] = [len(a) for a, _ in both]
            pdf["bottleneck"] = [kernels.bottleneck(a, b) for a, b in both]
            pdf["wasserstein"] = [kernels.h0_wasserstein(a[:, 1], b[:, 1]) for a, b in both]
            pdf["landscape_gap"] = [float(np.abs(kernels.h0_landscape(a) - kernels.h0_landscape(b)).max()) for a, b in both]
            yield pdf[["ticker", "quarter", "points", "bottleneck", "wasserstein", "landscape_gap"]]

    quarter = (F.year("date") * 4 + F.quarter("date")).alias("quarter")
    rows = returns(spark, sf_dir).where("ret is not null").select("ticker", "date", "ret", quarter)
    made = rows.groupBy("ticker", "quarter").applyInPandas(diagram, "ticker string, quarter int, deaths array<double>")
    before = made.select("ticker", (F.col("quarter") + 1).alias("quarter"), F.col("deaths").alias("before"))
    out = made.join(before, ["ticker", "quarter"]).mapInPandas(distances, "ticker string, quarter int, points long, bottleneck double, wasserstein double, landscape_gap double")
    return rounded(out, 5)


Z = 1.959963984540054
_T = f"""({Z} + {(Z**3 + Z) / 4} / df + {(5 * Z**5 + 16 * Z**3 + 3 * Z) / 96} / (df * df) + {(3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / 384} / power(df, 3)
  + {(79 * Z**9 + 776 * Z**7 + 1482 * Z**5 - 1920 * Z**3 - 945 * Z) / 92160} / power(df, 4))"""


@query(f"""WITH g AS (SELECT setup_id, count(*) AS n, avg(horizon) AS mx, avg(capital) AS mz, avg(pnl_pct) AS my, var_pop(horizon) AS xx, var_pop(capital) AS zz, var_pop(pnl_pct) AS yy,
    covar_pop(horizon, capital) AS xz, covar_pop(horizon, pnl_pct) AS xy, covar_pop(capital, pnl_pct) AS zy FROM ({TRADES}) GROUP BY 1),
  s AS (SELECT *, xx * zz - xz * xz AS det, 5 - mx AS gx, 250 - mz AS gz, (n - 3) * 1e0 AS df FROM g),
  b AS (SELECT *, (zz * xy - xz * zy) / det AS bx, (xx * zy - xz * xy) / det AS bz FROM s),
  e AS (SELECT *, my + bx * gx + bz * gz AS y_hat, sqrt(n * (yy - bx * xy - bz * zy) / df * (1e0 / n + (zz * gx * gx - 2 * xz * gx * gz + xx * gz * gz) / det / n)) AS se FROM b)
  SELECT setup_id, n, {r('y_hat', 5)} AS y_hat, {r('se', 5)} AS se, {r(f'y_hat - {_T} * se', 5)} AS lower, {r(f'y_hat + {_T} * se', 5)} AS upper FROM e""")
def mean_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted profit of a trade of five days and a capital of 250, by each setup's own regression."""
    return rounded(regression.mean_prediction(trades(spark, sf_dir), ["setup_id"], "pnl_pct", ["horizon", "capital"], [5.0, 250.0]), 5)


# islands: an individual is a setup on a ticker, its island the setup's number modulo four

ISLANDS, GENERATION, SEED = 4, 3, 7
_PEOPLE = f"SELECT setup_id % {ISLANDS} AS island, setup_id || '|' || ticker AS dna, a, b, round(a + b, 6) AS fitness FROM ({OBJ}) WHERE b IS NOT NULL"


@query(f"""WITH p AS ({_PEOPLE}), m AS (SELECT * FROM (SELECT island AS source, dna, fitness, row_number() OVER (PARTITION BY island ORDER BY fitness DESC, dna) AS place FROM p) WHERE place <= 5),
  pool AS (SELECT *, row_number() OVER (ORDER BY source, place) - 1 AS k, count(*) OVER () // {ISLANDS} AS share FROM m),
  s AS (SELECT 'ring' AS topology, source, (source + 1) % {ISLANDS} AS target, place, dna, fitness FROM m
    UNION ALL SELECT 'random', source, (source + 1 + (((source * 2654435761 + {GENERATION * 40503 + SEED * 69069 + 12345}) % 4294967296) // 65536) % {ISLANDS - 1}) % {ISLANDS}, place, dna, fitness FROM m
    UNION ALL SELECT 'all_to_all', source, k // share, k % share + 1, dna, fitness FROM pool WHERE share > 0 AND k < share * {ISLANDS}),
  f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY topology, target, place ORDER BY source, dna) = 1),
  w AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY fitness, dna) AS place FROM p)
  SELECT t.topology, w.island, coalesce(f.dna, w.dna) AS dna, {r('coalesce(f.fitness, w.fitness)')} AS fitness, f.source AS came_from
  FROM w CROSS JOIN (VALUES ('ring'), ('random'), ('all_to_all')) t(topology) LEFT JOIN f ON f.topology = t.topology AND f.target = w.island AND f.place = w.place""")
def island_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each island's population after its five fittest have migrated, by each topology."""
    p = people(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)  # a row for each setup and ticker, read by each topology
    moving = islands.migrants(p, 5)
    made = [islands.received(p, islands.sent(moving, ISLANDS, t, GENERATION, SEED)).withColumn("topology", F.lit(t)) for t in islands.TOPOLOGIES]
    return rounded(made[0].unionByName(made[1]).unionByName(made[2]))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objectives(spark, sf_dir).where("b is not null")
    return o.select((F.col("setup_id") % ISLANDS).alias("island"), F.concat("setup_id", F.lit("|"), "ticker").alias("dna"), "a", "b", F.round(F.col("a") + F.col("b"), 6).alias("fitness"))


@query(f"""WITH RECURSIVE p AS (SELECT DISTINCT dna, a, b FROM ({_PEOPLE})),
  chain AS (SELECT dna, a, b, 1 AS front FROM p UNION SELECT y.dna, y.a, y.b, x.front + 1 FROM chain x JOIN p y ON x.a >= y.a AND x.b >= y.b AND (x.a > y.a OR x.b > y.b) WHERE x.front < 60),
  f AS (SELECT dna, a, b, max(front) AS front FROM chain GROUP BY ALL),
  g AS (SELECT *, lead(a) OVER wa - lag(a) OVER wa AS ga, lead(b) OVER wb - lag(b) OVER wb AS gb, max(a) OVER q - min(a) OVER q AS ra, max(b) OVER q - min(b) OVER q AS rb
    FROM f WINDOW wa AS (PARTITION BY front ORDER BY a, dna), wb AS (PARTITION BY front ORDER BY b, dna), q AS (PARTITION BY front)),
  c AS (SELECT *, CASE WHEN ra > 0 THEN ga / ra WHEN ga IS NOT NULL THEN 0 END + CASE WHEN rb > 0 THEN gb / rb WHEN gb IS NOT NULL THEN 0 END AS crowding FROM g)
  SELECT dna, front, {r('crowding')} AS crowding FROM (SELECT *, row_number() OVER (ORDER BY front, crowding DESC NULLS FIRST, dna) AS k FROM c) WHERE k <= 40""")
def island_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 individuals that all islands together keep."""
    return rounded(islands.synchronized(people(spark, sf_dir), ["a", "b"], 40).select("dna", "front", "crowding"))


# slates and books


_BANDS = list(zip(EDGES, EDGES[1:]))
_DOWN = " + ".join(f"probs[{k + 1}] * {1.0 if b < 0 else -a / (b - a) if a < 0 < b else 0.0}" for k, (a, b) in enumerate(_BANDS))
_ABOVE, _BELOW = (" + ".join(f"probs[{k + 1}]" for k, (a, b) in enumerate(_BANDS) if test(a, b)) for test in (lambda a, b: a >= 0.05, lambda a, b: b <= -0.05))


@query(f"""WITH {OVER_HORIZONS}, k AS (SELECT *, {r('skill_vs_marginal', 5)} AS rank_score FROM joint), t AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY rank_score DESC NULLS LAST, setup) AS place FROM k)
  SELECT ticker, setup, rank_score, best_horizon, {r(_TRADE, 5)} AS expected_move, {r(_UP, 5)} AS p_up, {r(_DOWN, 5)} AS p_down, {r('0e0 * probs[1]', 5)} AS p_3_to_5, {r(_ABOVE, 5)} AS p_above_5,
    {r('0e0 * probs[1]', 5)} AS p_minus_5_to_3, {r(_BELOW, 5)} AS p_below_5 FROM (SELECT * FROM t WHERE place <= 5 ORDER BY rank_score DESC NULLS LAST, setup, ticker LIMIT 20)""")
def forecast_slate_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 forecasts of the highest skill, five of a ticker at most, with trade-ready fields."""
    rows = rounded(joint_scores(spark, sf_dir).select("ticker", "setup", F.col("skill_vs_marginal").alias("rank_score"), "best_horizon", "probs"), 5)
    return rounded(slates.slate(rows, "probs", EDGES, "rank_score", "setup", 5, 20).drop("probs"), 5)


END = date(1998, 6, 30)
_LIVE = f"(trigger_date >= DATE '{END}' - 30 AND (exit_date IS NULL OR exit_date > DATE '{END}'))"


@query(f"""WITH m AS (SELECT ticker, arg_max(px_last, date) AS mark FROM ({BARS}) WHERE date <= DATE '{END}' GROUP BY 1),
  t AS (SELECT t.*, capital / 10 AS contracts, 1000e0 AS entry_price, CASE WHEN setup_id % 2 = 0 THEN 'long' ELSE 'short' END AS direction, mark FROM ({TRADES}) t LEFT JOIN m USING (ticker) WHERE trigger_date <= DATE '{END}')
  SELECT trade_id, setup_id, ticker, CASE WHEN {_LIVE} THEN 'OPEN' END AS status, CASE WHEN {_LIVE} THEN 'EOD_OPEN' WHEN exit_date IS NOT NULL THEN 'closed' END AS exit_reason, CASE WHEN NOT {_LIVE} THEN exit_date END AS exit_date,
    {r(f"CASE WHEN {_LIVE} THEN (mark - entry_price) * contracts * CASE WHEN direction = 'short' THEN -1 ELSE 1 END END", 3)} AS unrealized_pnl,
    CASE WHEN {_LIVE} THEN CAST(greatest(DATE '{END}' - trigger_date, 0) AS INT) END AS holding_days_open FROM t""")
def open_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as of a day: trades of the last 30 days that were open then are marked at the last price."""
    t = trades(spark, sf_dir).where(F.col("trigger_date") <= F.lit(END))
    mark = bars(spark, sf_dir).where(F.col("date") <= F.lit(END)).groupBy("ticker").agg(F.max_by("px_last", "date").alias("mark"))
    t = t.join(mark, "ticker", "left").withColumns(
        {
            "contracts": F.col("capital") / 10, "entry_price": F.lit(1000.0), "direction": F.when(F.col("setup_id") % 2 == 0, "long").otherwise("short"),
            "entry_date": F.col("trigger_date"), "exit_price": F.lit(None).cast("double"), "exit_reason": F.when(F.col("exit_date").isNotNull(), "closed"),
        }
    )
    out = slates.open_at_end(t, END, END, 30, "mark")
    return rounded(out.select("trade_id", "setup_id", "ticker", "status", "exit_reason", "exit_date", "unrealized_pnl", "holding_days_open"), 3)


# the selector's records: a setup on a ticker; nothing is live on tickers whose name begins with N

_RECORDS = f"""SELECT setup_id, ticker, {r('avg(pnl_pct)')} AS candidate_score, max(trigger_date) >= DATE '{END}' - 7 AS triggered_any, count(*) < 40 AS soft_flags_present, setup_id % 3 = 0 AS used_bootstrap,
  setup_id % 4 = 0 AS dup_suppressed, CASE WHEN min(pnl_pct) < -0.27 THEN 'fatal' WHEN avg(pnl_pct) > 0.005 AND ticker NOT LIKE 'N%' THEN 'live' ELSE 'idle' END AS status
  FROM ({TRADES}) WHERE trigger_date <= DATE '{END}' GROUP BY 1, 2"""


def selector_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir, numbered=True).where(F.col("trigger_date") <= F.lit(END))
    s, mean = F.col("setup_id"), ledger.summed("pnl_pct", t.columns) / F.count("pnl_pct")
    g = t.groupBy("setup_id", "ticker").agg(
        mean.alias("candidate_score"), (F.max("trigger_date") >= F.date_sub(F.lit(END), 7)).alias("triggered_any"), (F.count("*") < 40).alias("soft_flags_present"),
        F.when(F.min("pnl_pct") < -0.27, "fatal").when((mean > 0.005) & ~F.first("ticker").startswith("N"), "live").otherwise("idle").alias("status"),
    )
    return rounded(g).withColumns({"used_bootstrap": s % 3 == 0, "dup_suppressed": s % 4 == 0})


@query(f"""SELECT ticker, count(*) AS n_checked, count(*) FILTER (triggered_any) AS n_recent_trigger, count(*) FILTER (status = 'fatal') AS n_blocked_fatal, count(*) FILTER (soft_flags_present) AS n_soft_flagged,
  count(*) FILTER (used_bootstrap) AS n_scored_with_bootstrap, count(*) FILTER (NOT used_bootstrap) AS n_scored_point_estimate, count(*) FILTER (status = 'live') AS n_final_selected FROM ({_RECORDS}) GROUP BY 1""")
def selection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the selector's records on each ticker."""
    return slates.selection_summary(selector_records(spark, sf_dir), ["ticker"])


@query(f"""WITH x AS ({_RECORDS}) SELECT ticker, setup_id, candidate_score FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY candidate_score DESC, setup_id) AS k FROM x
  WHERE NOT dup_suppressed AND ticker NOT IN (SELECT ticker FROM x WHERE status = 'live')) WHERE k <= 5""")
def selection_near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best records of each ticker on which nothing is live."""
    return slates.near_misses(selector_records(spark, sf_dir), ["ticker"]).select("ticker", "setup_id", "candidate_score")


# predictive power in moving years


POWER = f"""feats AS ({_feat_sql()}), fired AS ({FIRED}), cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM ({BARS}))),
  ends AS (SELECT min(date) AS a, max(date) AS z FROM cal), c AS (SELECT CAST(unnest(generate_series(make_date(year(a), CASE WHEN month(a) <= 6 THEN 1 ELSE 7 END, 1), z, INTERVAL 6 MONTH)) AS DATE) AS c, a, z FROM ends),
  w AS (SELECT c, CAST(c + INTERVAL 3 YEAR AS DATE) - 1 AS te, a, z FROM c WHERE c < z), x AS (SELECT greatest(c, a) AS train_start, least(te, z) AS train_end, te + 8 AS test_start, least(CAST((te + 8) + INTERVAL 1 YEAR AS DATE) - 1, z) AS test_end FROM w WHERE te + 8 <= z),
  split AS (SELECT *, row_number() OVER (ORDER BY last, train_start) AS fold FROM (SELECT *, 0 AS last FROM x WHERE train_start < train_end AND test_start < test_end
    UNION ALL SELECT CAST((z - 8) - INTERVAL 3 YEAR AS DATE) + 1, z - 8, CAST(z - INTERVAL 1 YEAR AS DATE) + 1, z, 1 FROM ends)),
  px AS (SELECT ticker, date, pos, px_last FROM ({BARS}) JOIN cal USING (date)), h(horizon) AS (VALUES {', '.join(f'({h})' for h in HORIZONS)}),
  y AS (SELECT a.ticker, a.date, horizon, ln(z.px_last / a.px_last) AS fwd FROM px a CROSS JOIN h JOIN px z ON z.ticker = a.ticker AND z.pos = a.pos + horizon),
  trig AS (SELECT y.*, setup FROM y JOIN {SETUPS} USING (ticker, date)),
  i AS (SELECT ticker, setup, horizon, fold, count(*) AS support_is, avg(fwd) AS mu_is, avg(CASE WHEN fwd > 0 THEN 1e0 ELSE 0e0 END) AS p_long_is FROM trig JOIN split ON date BETWEEN train_start AND train_end GROUP BY ALL),
  o AS (SELECT ticker, setup, horizon, fold, count(*) AS support_oos, avg(fwd) AS mu_oos, avg(CASE WHEN fwd > 0 THEN 1e0 ELSE 0e0 END) AS up, avg(CASE WHEN fwd < 0 THEN 1e0 ELSE 0e0 END) AS down, stddev_samp(fwd) AS sd
    FROM trig JOIN split ON date BETWEEN test_start AND test_end GROUP BY ALL),
  power AS (SELECT *, CASE WHEN mu_is > 0 THEN up ELSE down END AS acc_oos, CASE WHEN sd > 1e-9 THEN sqrt(support_oos) * mu_oos / sd ELSE 0 END AS tstat_oos, CASE WHEN mu_is > 0 THEN 'long' ELSE 'short' END AS direction,
    exp(least(greatest(mu_oos, -20), 20)) - 1 AS expected_edge_pct FROM i JOIN o USING (ticker, setup, horizon, fold) WHERE support_is >= 15 AND support_oos >= 10 AND abs(mu_is) > 1e-12)"""
_POWER = ", ".join(f"{r(c, 5)} AS {c}" for c in ("mu_is", "p_long_is", "mu_oos", "acc_oos", "tstat_oos", "expected_edge_pct"))


def power_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = bars(spark, sf_dir).select("date").distinct()
    ends = days.agg(F.min("date").alias("a"), F.max("date").alias("z"), F.count("*").alias("n")).first()
    rows = triggered_outcomes(spark, sf_dir)[0].where("fwd > -1").withColumn("fwd", F.log1p("fwd"))
    return predictive.directed(predictive.predictive_power(rows, predictive.year_splits(ends.a, ends.z, days=ends.n), ["ticker", "setup", "horizon"], spark))


@query(f"WITH {POWER} SELECT ticker, setup, horizon, CAST(fold AS INT) AS fold, direction, support_is, support_oos, {_POWER} FROM power")
def predictive_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and t-statistic of each setup's learnt direction in each test year."""
    return rounded(power_rows(spark, sf_dir), 5)


@query(f"""WITH {POWER} SELECT ticker, direction, horizon, setup, CAST(fold AS INT) AS fold, support_is, support_oos, {_POWER} FROM power
  QUALIFY row_number() OVER (PARTITION BY ticker, direction, horizon ORDER BY round(acc_oos, 9) DESC, round(tstat_oos, 9) DESC, support_oos DESC, setup, fold) = 1""")
def tradeable_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best setup of each ticker, direction and horizon over all folds."""
    return rounded(predictive.best_signals(power_rows(spark, sf_dir), ["ticker", "direction", "horizon"], ["setup", "fold"]), 5)


# outer folds by calendar months, with the trades of their test windows


@query(f"""WITH RECURSIVE cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM ({BARS}))),
  s AS (SELECT 0 AS number, min(k) AS k FROM cal WHERE date >= (SELECT CAST(min(date) + INTERVAL 36 MONTH AS DATE) FROM cal)
    UNION ALL SELECT number + 1, (SELECT min(x.k) FROM cal x WHERE x.k > s.k AND x.date >= CAST(c.date + INTERVAL 3 MONTH AS DATE)) FROM s JOIN cal c ON c.k = s.k WHERE s.k + 63 < c.n),
  t AS (SELECT number, CASE WHEN n - k < 5 THEN n - 5 ELSE k END AS a, least(k + 62, n - 1) AS z, n FROM s, (SELECT max(n) AS n FROM cal) WHERE k IS NOT NULL),
  b AS (SELECT *, z = n - 1 AS is_tail, z - a + 1 AS size, CASE WHEN z - a + 1 <= 21 THEN z - a ELSE 21 END AS e FROM t),
  f AS (SELECT *, CASE WHEN is_tail AND e > size - 5 THEN size - 5 ELSE e END AS embargo, CASE WHEN is_tail AND e > size - 5 THEN e END AS embargo_from, CASE WHEN is_tail AND 21 > size - 5 AND size - 5 >= 21 THEN size - 5 ELSE 21 END AS purge FROM b),
  g AS (SELECT f.*, p.date AS train_end, x.date AS test_start, y.date AS test_end FROM f JOIN cal p ON p.k = a - purge - 1 JOIN cal x ON x.k = a JOIN cal y ON y.k = z)
  SELECT CAST(number AS INT) AS number, train_end, test_start, test_end, CAST(purge AS INT) AS purge_days, CAST(embargo AS INT) AS embargo_days, CAST(embargo_from AS INT) AS embargo_from, is_tail,
    'PAWF_v1|OUTER:' || strftime(test_start, '%Y%m') || '|H:21|E:252|P:' || purge || '|EMB:' || embargo || '|REG:R1' AS split_id,
    (SELECT count(*) FROM ({TRADES}) q WHERE q.trigger_date BETWEEN test_start AND test_end) AS test_trades FROM g""")
def outer_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored folds of the bars' calendar whose tests start a quarter apart, the last with the buffers that it can have."""
    days = [row.date for row in bars(spark, sf_dir).select("date").distinct().toLocalIterator()]
    folds = splits.outer_folds(days, 21, 252, 36, 63, 3)
    rows = [(f.number, f.train_end, f.test_start, f.test_end, f.purge_days, f.embargo_days, f.embargo_from, f.is_tail, f.split_id) for f in folds]
    table = spark.createDataFrame(rows, "number int, train_end date, test_start date, test_end date, purge_days int, embargo_days int, embargo_from int, is_tail boolean, split_id string")
    hits = joins.members(trades(spark, sf_dir).select("trigger_date"), table.select("number", "test_start", "test_end"), "trigger_date", "test_start", "test_end")
    n = hits.groupBy("number").agg(F.count("*").alias("test_trades"))
    return table.join(n, "number", "left").na.fill({"test_trades": 0})


# options from anchor volatilities: on odd positions by delta, on even ones at the money

_D1 = "((ln(s0 / strike) + (0.01e0 + sigma_entry * sigma_entry / 2) * t0) / (sigma_entry * sqrt(t0)))"
_AT = 0.2533471031357997  # quantile of 0.6


def _sigma(anchor: str, days: str, rv: str) -> str:
    scaled = f"({anchor} * power({days} * 1e0 / ref, -0.15))"
    return f"least(greatest(CASE WHEN {rv} IS NOT NULL THEN 0.7 * {scaled} + 0.3 * {rv} ELSE {scaled} END, 2e-4), 5e0)"


def _either(spot: str, t: str, v: str) -> str:
    c = price_sql(spot, "strike", t, v, "0.01e0")
    return f"greatest(CASE WHEN call THEN {c} ELSE {c} - {spot} + strike * exp(-0.01e0 * {t}) END, 0)"


ENHANCED = f"""WITH c AS (SELECT ticker, date, px_last, call, thirty, rv, ref, fell_back, tenor, row_number() OVER (PARTITION BY ticker ORDER BY date) AS pos FROM {CONVENTIONS}),
  h AS (SELECT *, 3 + tenor % 30 AS held, 3 + tenor % 30 + greatest(5, (3 + tenor % 30) // 4) AS d FROM c), e AS (SELECT *, {EXP} AS days FROM h),
  x AS (SELECT e.*, e.px_last AS s0, z.px_last AS s1, e.thirty AS a0, coalesce(z.thirty, e.thirty) AS a1, z.rv AS rv1, e.days / 252e0 AS t0, greatest(e.days - e.held, 1) / 252e0 AS t1, greatest(e.days - e.held, 1) AS rest
    FROM e LEFT JOIN c z ON z.ticker = e.ticker AND z.pos = e.pos + e.held WHERE e.thirty IS NOT NULL),
  v AS (SELECT *, {_sigma('a0', 'days', 'rv')} AS sigma_entry, {_sigma('a1', 'rest', 'rv1')} AS sigma_exit FROM x),
  k AS (SELECT *, CASE WHEN pos % 2 = 1 THEN least(greatest(s0 * exp((0.01e0 + sigma_entry * sigma_entry / 2) * t0 - sigma_entry * sqrt(t0) * CASE WHEN call THEN -{_AT} ELSE {_AT} END), s0 * 0.2), s0 * 5) ELSE s0 END AS wanted FROM v),
  l AS (SELECT *, least(greatest(round_even(wanted / {STEP}, 0) * {STEP}, s0 * 0.5), s0 * 1.5) AS strike FROM k)
  SELECT ticker, date, CAST(days AS INT) AS days, fell_back, {r('strike', 4)} AS strike, {r('strike / s0', 5)} AS k_over_s, CASE WHEN pos % 2 = 1 THEN CASE WHEN call THEN 0.4e0 ELSE -0.4e0 END END AS delta_target,
    {r(f'({normal_sql(_D1)}) - CASE WHEN call THEN 0 ELSE 1 END', 5)} AS delta_achieved, {r('sigma_entry', 5)} AS sigma_entry, {r('sigma_exit', 5)} AS sigma_exit, {r('t1', 5)} AS t_exit,
    {r(_either('s0', 't0', 'sigma_entry'), 4)} AS entry_price, CASE WHEN s1 IS NOT NULL THEN {r(_either('s1', 't1', 'sigma_exit'), 4)} END AS exit_price FROM l"""


@query(ENHANCED)
def enhanced_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One option at every bar that has an anchor: strike, delta, volatilities and prices from entry to the horizon's end."""
    w = Window.partitionBy("ticker").orderBy("date")
    rows = conventions(spark, sf_dir).withColumn("pos", F.row_number().over(w))
    held = 3 + F.col("tenor") % 30
    rows = rows.select("ticker", "date", "pos", "px_last", "call", "thirty", "rv", "ref", "fell_back", held.alias("held"), options.expiry_days(held).alias("days"))
    at_exit = rows.select("ticker", (F.col("pos")).alias("_p"), F.col("px_last").alias("s1"), F.col("thirty").alias("a1"), F.col("rv").alias("rv1"))
    x = rows.where("thirty is not null").withColumn("_p", F.col("pos") + F.col("held")).join(at_exit, ["ticker", "_p"], "left")
    bucket = F.when(F.col("pos") % 2 == 1, "AUTO_BY_DIRECTION").otherwise("ATM")
    c = F.col
    legs = options.enhanced_leg(x, "px_last", "s1", c("days"), c("held"), F.lit(0.01), c("call"), c("thirty"), c("ref"), c("a1"), c("rv"), c("rv1"), bucket)
    fields = ("strike", "k_over_s", "delta_target", "delta_achieved", "sigma_entry", "sigma_exit", "t_exit", "entry_price", "exit_price")
    return rounded(legs.select("ticker", "date", "days", "fell_back", *fields), 5, strike=4, entry_price=4, exit_price=4)

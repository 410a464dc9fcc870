"""The feature registry: name -> definition over the stages of a panel.

Definitions are compositions of the rolling kernels.  ``compute`` lags every
feature by one row, so that a day only shows what was known the day before.
``register`` adds entries; families only group them into plans of bounded width.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from tidemark.functions.series import Series
from tidemark.operators import rolling as R

Feature = Callable[[Series], str]
REGISTRY: dict[str, dict[str, Feature]] = {}

C, O, H, L = "px_last", "px_open", "px_high", "px_low"  # noqa: E741


def register(family: str, name: str, define: Feature) -> None:
    REGISTRY.setdefault(family, {})[name] = define


def _add(family: str, **defs: Feature) -> None:
    for key, define in defs.items():
        register(family, key.replace("__", "."), define)


def dollars(s: Series) -> str:
    return R.dollar_volume(s, C, "volume", "turnover")


def bench(s: Series) -> str:
    return R.ret(s, "b_px_last")


_add(
    "px",
    px__mom_5=lambda s: R.pct_change(s, C, 5),
    px__mom_21=lambda s: R.pct_change(s, C, 21),
    px__mom_63=lambda s: R.pct_change(s, C, 63),
    px__mom_126=lambda s: R.pct_change(s, C, 126),
    px__trend_slope_63=lambda s: R.log_slope(s, C, 63),
    px__ma_gap_50_200_z=lambda s: R.zscore(s, R.ma_gap(s, C, 50, 200), 60),
    px__golden_cross=lambda s: R.crossover(s, C, 50, 200)[0],
    px__death_cross=lambda s: R.crossover(s, C, 50, 200)[1],
    px__breakout_high_126=lambda s: R.breakout(s, C, 126)[0],
    px__breakout_low_126=lambda s: R.breakout(s, C, 126)[1],
    px__trend_persist_21=lambda s: R.trend_persistence(s, R.ret(s), 21),
    px__rsi14_z=lambda s: R.zscore(s, R.rsi(s, C, 14), 60),
    px__stoch14_z=lambda s: R.zscore(s, R.stochastic_k(s, C, L, H, 14), 60),
    px__range_pos_63=lambda s: R.range_position(s, C, L, H, 63),
)
yz = lambda s: R.yang_zhang(s, O, H, L, C, 21)
_add(
    "vol",
    vol__rv_21=lambda s: R.realized_vol(s, C, 21),
    vol__rv_gk_21=lambda s: R.garman_klass(s, O, H, L, C, 21),
    vol__parkinson_21=lambda s: R.parkinson(s, H, L, 21),
    vol__rogers_satchell_21=lambda s: R.rogers_satchell(s, O, H, L, C, 21),
    vol__yang_zhang_21=yz,
    vol__regime_hi=lambda s: R.vol_flags(s, yz(s))[0],
    vol__regime_crush=lambda s: R.vol_flags(s, yz(s))[1],
    vol__vol_of_vol_21=lambda s: R.vol_of_vol(s, R.realized_vol(s, C, 21), 21),
    vol__semivar_dn_21=lambda s: R.semivariance(s, R.ret(s), 21),
    vol__updown_ratio_21=lambda s: R.up_down_ratio(s, R.ret(s), 21),
    vol__skew_63=lambda s: s.skew(R.ret(s), 63),
    vol__kurt_63=lambda s: s.kurt(R.ret(s), 63),
)
_add(
    "tail",
    vol__left_tail_pr_252=lambda s: R.tail_share(s, R.ret(s), 252, 0.05),
    vol__right_tail_pr_252=lambda s: R.tail_share(s, R.ret(s), 252, 0.05, left=False),
    vol__es_left_5pct=lambda s: R.expected_shortfall(s, R.ret(s), 252, 0.05),
    vol__es_right_5pct=lambda s: R.right_shortfall(s, R.ret(s), 252, 0.05),
    vol__es_left_1pct=lambda s: R.expected_shortfall(s, R.ret(s), 252, 0.01),
    vol__es_right_1pct=lambda s: R.right_shortfall(s, R.ret(s), 252, 0.01),
    **{f"vol__lpm_{k}": (lambda s, k=k: R.partial_moment(s, R.ret(s), 63, k)) for k in (1, 2, 3)},
    **{f"vol__hpm_{k}": (lambda s, k=k: R.partial_moment(s, R.ret(s), 63, k, low=False)) for k in (1, 2, 3)},
    risk__drawdown_63=lambda s: R.drawdown(s, C, 63),
    risk__time_in_dd_63=lambda s: R.time_in_drawdown(s, R.ret(s), 63),
    liq__amihud_21=lambda s: R.amihud(s, R.ret(s), dollars(s), 21),
    liq__cs_spread_21=lambda s: R.corwin_schultz(s, H, L, 21),
    liq__roll_proxy_21=lambda s: R.roll_spread(s, R.ret(s), 21),
    liq__turnover_z_63=lambda s: R.zscore(s, "turnover", 63),
)
carry = "(iv30c - iv3mc)"
_add(
    "opt",
    opt__iv30_z_60=lambda s: R.zscore(s, "iv30c", 60),
    opt__iv3m_z_60=lambda s: R.zscore(s, "iv3mc", 60),
    opt__term_30d_3m=lambda s: s.let(carry),
    opt__skew_30d=lambda s: s.let("iv30c - iv30p"),
    opt__rr25_1m_proxy=lambda s: s.let("c25 - p10"),
    opt__fly_1m_40v25=lambda s: s.let("0.5e0 * (c40 + p40) - c25"),
    opt__smile_slope=lambda s: s.let("c25 - p25"),
    opt__smile_curvature=lambda s: s.let("0.5e0 * (c10 + p10) - 0.5e0 * (c40 + p40)"),
    opt__iv_carry=lambda s: s.let(carry),
    opt__iv_carry_mom=lambda s: R.diff(s, carry, 5),
    opt__iv_carry_abs=lambda s: s.let(f"abs({carry})"),
    opt__iv_mom_5_z60=lambda s: R.zscore(s, R.diff(s, "iv3mc", 5), 60),
    opt__vrp_21=lambda s: s.let(f"iv3mc - 100 * {R.realized_vol(s, C, 21)}"),
    opt__rv_minus_iv_21=lambda s: s.let(f"100 * {R.realized_vol(s, C, 21)} - iv3mc"),
    opt__return_iv_corr=lambda s: R.correlation(s, R.ret(s), R.diff(s, "iv3mc"), 21),
    opt__skew_dynamics_21=lambda s: R.skew_dynamics(s, "iv30c", "iv30p", 21),
    opt__flow_pressure_5=lambda s: R.flow_pressure(s, "call_oi", "put_oi", 5),
    opt__congestion_dist_21=lambda s: R.congestion(s, C, "call_oi", 21),
    opt__iv_term_slope=lambda s: R.term_slope(s, "iv30c", "iv3mc"),
)
_add(
    "flow",
    flow__pcr_ema5_z30=lambda s: R.zscore(s, R.ewma(s, "pcr", span=5, least=2), 30),
    flow__opt_vol_z30=lambda s: R.zscore(s, "opt_vol", 30),
    pos__oi_call_put_ratio=lambda s: s.let(R.safe_div("call_oi", "put_oi")),
    pos__oi_skew_z60=lambda s: R.zscore(s, R.safe_div("call_oi - put_oi", "(call_oi + put_oi)"), 60),
    sent__tw_pub_z30=lambda s: R.zscore(s, "tw_count", 30),
    sent__tw_avg_z30=lambda s: R.zscore(s, "tw_sent", 30),
    sent__tw_mom_21=lambda s: R.diff(s, "tw_sent", 21),
    sent__news_pub_z30=lambda s: R.zscore(s, "news_count", 30),
    sent__news_heat_z21=lambda s: R.zscore(s, "news_heat", 21),
    sent__cn_avg_z60=lambda s: R.zscore(s, "cn_sent", 60),
    sent__consensus_z30=lambda s: R.zscore(s, R.consensus(s, ["tw_sent", "cn_sent", "news_heat"], [0.4, 0.3, 0.3]), 30),
    sent__burst_detect_21=lambda s: R.burst(s, "tw_sent", 21),
    sent__roc_5=lambda s: R.rate_of_change(s, "news_heat", 5),
    sent__regime_21=lambda s: R.sentiment_regime(s, "tw_sent", "tw_count", 21),
    sent__news_flow_5=lambda s: R.news_momentum(s, "news_count", "tw_sent", 5),
    sent__divergence_21=lambda s: R.divergence(s, ["tw_sent", "cn_sent", "news_heat"], 21),
    flow__imbalance_10=lambda s: R.order_flow(s, "call_oi", "put_oi", 10),
    flow__impact_21=lambda s: R.market_impact(s, R.ret(s), "volume", 21),
    flow__liq_premium_21=lambda s: R.liquidity_premium(s, R.corwin_schultz(s, H, L, 21), R.realized_vol(s, C, 21), 21),
    flow__pressure_21=lambda s: R.price_pressure(s, C, "volume", 21),
    flow__relevance_ewma_10=lambda s: R.weighted_ewma(s, "tw_sent", "news_count", 10),
)
_add(
    "cross",
    x__beta_spy_63=lambda s: R.beta(s, R.ret(s), bench(s), 63),
    x__bh_ret_spy_21=lambda s: s.roll("sum", R.hedged(s, R.ret(s), bench(s), 63), 21),
    x__spread_vs_sector_21=lambda s: s.let(f"{R.pct_change(s, C, 21)} - {R.pct_change(s, 'v_px_last', 21)}"),
    x__ewma_corr_21=lambda s: R.ewma_corr(s, R.ret(s), bench(s), 21),
    x__dcc_corr_21=lambda s: R.dcc(s, R.ret(s), bench(s), 21),
    reg__vol90d_z120=lambda s: R.zscore(s, "vol90", 120),
    macro__trend_filter_20_50=lambda s: R.trend_filter(s, C, 20, 50),
    macro__momentum_regime_21=lambda s: R.momentum_regime(s, R.ret(s), 21),
    macro__beta_conditioned_63=lambda s: R.hedged(s, R.ret(s), bench(s), 63),
    x__corr_fisher20_z60=lambda s: R.zscore(s, R.corr_fisher(s, R.ret(s), bench(s), 20), 60),
    x__corr_delta_20_60_z60=lambda s: R.zscore(
        s, f"{R.corr_fisher(s, R.ret(s), bench(s), 20)} - {R.corr_fisher(s, R.ret(s), bench(s), 60)}", 60
    ),
    x__beta_60_z120=lambda s: R.zscore(s, R.beta(s, R.ret(s), bench(s), 60), 120),
    x__corr_abs_21=lambda s: R.corr_of_abs(s, R.ret(s), bench(s), 21),
    x__partial_corr_21=lambda s: R.partial_corr(s, R.ret(s), bench(s), R.ret(s, "v_px_last"), 21),
    x__leadlag_best_5=lambda s: R.lead_lag(s, R.ret(s), bench(s), 21, 5)[0],
    x__leadlag_best_5_lag=lambda s: R.lead_lag(s, R.ret(s), bench(s), 21, 5)[1],
    x__coint_resid_z_252=lambda s: R.coint_z(s, R.ln(C), R.ln("b_px_last"), 252),
    gate__liquid_flag=lambda s: s.let(
        R.flag(f"{R.zscore(s, 'volume', 63)} > 0 AND {R.zscore(s, 'turnover', 63)} > 0")
    ),
    gate__opt_avail_flag=lambda s: s.let(R.flag("coalesce(iv30c, iv3mc, c25) IS NOT NULL")),
    k__mad_z_21=lambda s: R.mad_z(s, C, 21),
    k__momentum_trend=lambda s: R.momentum_trend(s, C, 10, 30),
    k__acceleration_5=lambda s: R.second_diff(s, C, 5),
    k__share_below_252=lambda s: R.share_below(s, C, 252),
    k__pct_rank_63=lambda s: R.pct_rank(s, C, 63),
    k__ewma_recursive_10=lambda s: R.ewma_recursive(s, C, 10),
    k__hysteresis=lambda s: R.hysteresis(s, R.zscore(s, C, 21), 1.0, 0.0, 2, 2),
    k__recent_breakout=lambda s: R.within(s, f"{R.breakout(s, C, 21)[0]} = 1"),
)
mom = lambda s, n: R.pct_change(s, C, n)
_add(
    "ev",
    ev__gated_mom21=lambda s: s.let(f"{mom(s, 21)} * {R.flag(f'ev_heat_3 < {s.quantile('ev_heat_3', 0.5, 7)}')}"),
    ev__tail_carry=lambda s: R.ewma(s, "ev_z", span=5, least=2),
    ev__infl_beta_gate=lambda s: s.let(f"ev_inflation * {R.beta(s, R.ret(s), R.pct_change(s, 'dxy', 1), 63)}"),
    ev__growth_rotation=lambda s: s.let(f"ev_growth * ({R.pct_change(s, 'v_px_last', 21)} - {R.pct_change(s, 'b_px_last', 21)})"),
    ev__intensity_gated_mom=lambda s: s.let(f"{mom(s, 21)} * ev_heat_3"),
    ev__regime_sensitivity=lambda s: s.let(f"ev_divergence * {R.beta(s, R.ret(s), bench(s), 63)}"),
    ev__vol_regime_gate=lambda s: s.let(f"{mom(s, 5)} * {R.flag('ev_tail_21 > 0.5e0')}"),
)
_add(
    "macro",
    macro__2s10s_slope=lambda s: s.let("y10 - y2"),
    macro__2s10s_steepen_21=lambda s: R.diff(s, "y10 - y2", 21),
    macro__dxy_pctile_252=lambda s: R.pct_rank(s, "dxy", 252),
    macro__hgxau_mom_63=lambda s: R.pct_change(s, R.safe_div("hg", "xau"), 63),
    macro__risk_on_score=lambda s: s.let(
        " ".join(
            f"{sign} {R.zscore(s, R.ret(s, x), 63)}"
            for sign, x in (("-", "dxy"), ("-", "y10"), ("+", "hg"), ("-", "xau"), ("+", "btc"))
        )
    ),
    macro__rty_over_spx=lambda s: s.let(R.safe_div("hg", "dxy")),
    macro__eem_over_mxwo=lambda s: s.let(R.safe_div("btc", "xau")),
    macro__vix_z60=lambda s: R.zscore(s, "y2", 60),
    macro__rate_duration_pivot=lambda s: R.zscore(s, f"{R.pct_change(s, 'y10', 21)} - {R.pct_change(s, 'dxy', 21)}", 60),
    macro__btc_beta_shock=lambda s: R.zscore(s, R.corr_fisher(s, R.ret(s, "btc"), R.ret(s, "dxy"), 20), 60),
    macro__btc_corr_delta=lambda s: R.diff(s, R.corr_fisher(s, R.ret(s, "btc"), R.ret(s, "dxy"), 20), 5),
    macro__dollar_momentum_21=lambda s: R.rate_of_change(s, "dxy", 21),
    macro__rates_trend_21=lambda s: R.diff(s, "y10", 21),
)


def stages(family: str, lagged: bool = True, engine: str = "spark", by: tuple[str, ...] = ("ticker",)) -> tuple[Series, dict[str, str]]:
    """The stages of a family and its output expressions."""
    s = Series(by, "date", engine)
    out = {name: define(s) for name, define in REGISTRY[family].items()}
    return s, {n: s.lag(x) if lagged else x for n, x in out.items()}


def compute(panel: DataFrame, family: str, lagged: bool = True, by: tuple[str, ...] = ("ticker",), keep: Iterable[str] = ("ticker", "date"), digits: int | None = None) -> DataFrame:
    """The family's features of every row of the panel; rounded only if ``digits`` is given."""
    s, out = stages(family, lagged, by=by)
    return s.spark(panel, keep, out, digits)


def text(base: str, family: str, lagged: bool = True, by: tuple[str, ...] = ("ticker",), keep: Iterable[str] = ("ticker", "date"), digits: int | None = None) -> str:
    """The same as DuckDB SQL."""
    s, out = stages(family, lagged, "duckdb", by)
    return s.text(base, keep, out, digits)


# registry catalogue


def names(pattern: str | None = None, family: str | None = None) -> list[str]:
    every = [n for f, d in REGISTRY.items() if family in (None, f) for n in d]
    return [n for n in every if pattern is None or re.search(pattern, n)]


def lookback(feature_names: Iterable[str]) -> int:
    """Largest window named in the features: numbers after ``_`` or ``.``, months count 21 rows; 20 at least, 60 if none."""
    found = [int(k) * (21 if unit == "m" else 1) for n in feature_names for k, unit in re.findall(r"[_.](\d+)([dm]?)", n)]
    return max([20, *found]) if found else 60


def categories() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for n in names():
        out.setdefault(n.split(".")[0], []).append(n)
    return out

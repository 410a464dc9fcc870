"""Operators against small independent computations, with nulls, ties, short and empty series."""

from __future__ import annotations

import math
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.series import Series
from tidemark.operators import events, gauntlet, joins, kernels, ledger, options, regimes, scoring, search, selection, signals, splits, support
from tidemark.operators import rolling as R
from tidemark.plans import features
from tidemark.sources import tables

N = 300


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(3)
    x = 100 + np.cumsum(rng.normal(0, 1, N))
    y = x * 0.5 + rng.normal(0, 1, N)
    x[[5, 60, 61, 200]] = np.nan
    x[10:13] = x[10]
    return pd.DataFrame({"ticker": "A", "date": [date(2020, 1, 1) + timedelta(k) for k in range(N)], "x": x, "y": y})


def run(spark, pdf, define):
    df = spark.createDataFrame(pdf)
    df = df.select("ticker", "date", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in pdf.columns if c not in ("ticker", "date")))
    s = Series()
    out = {"v": define(s)}
    got = s.spark(df, ["date"], out, None).orderBy("date").toPandas()
    return got["v"].astype(float).to_numpy()


def same(a, b, tol=1e-9):
    np.testing.assert_allclose(a, np.asarray(b, float), rtol=tol, atol=tol, equal_nan=True)


med = lambda v: v.rolling(21, 10).median()
ret = lambda v: v.ffill() / v.ffill().shift(1) - 1
gains = lambda v: v.diff().clip(lower=0).fillna(0.0)
up = lambda v: v.where(v > 0, 0.0)
crossed = lambda above: (above & ~above.shift(1, fill_value=False)).astype(float)


def below_peak(r):
    grown = (1 + r.fillna(0)).cumprod()
    return (grown < grown.cummax() * (1 - 1e-12)).astype(float)


def slope(y, n):
    out = np.full(len(y), np.nan)
    for i in range(n - 1, len(y)):
        v = y.to_numpy()[i - n + 1 : i + 1]
        ok = np.isfinite(v)
        out[i] = np.polyfit(np.arange(n)[ok], v[ok], 1)[0] if ok.sum() >= max(5, n // 2) else np.nan
    return out


def slope_on(a, b, n):
    both = a.notna() & b.notna()
    a, b = a.where(both), b.where(both)
    return a.rolling(n, n // 2).cov(b) / (b.rolling(n, n // 2).var() + 1e-9)


@pytest.mark.parametrize(
    "define, wanted",
    [
        (lambda s: R.mean(s, "x", 21), lambda d: d.x.rolling(21).mean()),
        (lambda s: R.zscore(s, "x", 21), lambda d: (d.x - d.x.rolling(21, 10).mean()) / (d.x.rolling(21, 10).std() + 1e-9)),
        (lambda s: R.pct_change(s, "x", 5), lambda d: d.x.ffill() / d.x.ffill().shift(5) - 1),
        (lambda s: s.skew("x", 21), lambda d: d.x.rolling(21).skew()),
        (lambda s: s.kurt("x", 21), lambda d: d.x.rolling(21).kurt()),
        (lambda s: R.pct_rank(s, "x", 21), lambda d: d.x.rolling(21).rank(pct=True)),
        (lambda s: s.quantile("x", 0.05, 21), lambda d: d.x.rolling(21).quantile(0.05)),
        (lambda s: R.ewma(s, "x", halflife=10), lambda d: d.x.ewm(halflife=10).mean()),
        (lambda s: R.ewma_recursive(s, "x", 10), lambda d: d.x.ewm(halflife=10, adjust=False, ignore_na=True).mean()),
        (lambda s: R.correlation(s, "x", "y", 30), lambda d: d.x.rolling(30, 15).corr(d.y.where(d.x.notna()))),
        (lambda s: R.drawdown(s, "y", 21), lambda d: d.y / (d.y.rolling(21).max() + 1e-9) - 1),
        (lambda s: R.mad_z(s, "x", 21), lambda d: (d.x - med(d.x)) / (1.4826 * med((d.x - med(d.x)).abs()) + 1e-9)),
        (lambda s: R.rsi(s, "y", 14), lambda d: 100 - 100 / (1 + gains(d.y).rolling(14).mean() / (gains(-d.y).rolling(14).mean() + 1e-9))),
        (lambda s: R.log_slope(s, "x", 63), lambda d: slope(np.log(d.x), 63)),
        (lambda s: R.up_down_ratio(s, R.ret(s, "x"), 21), lambda d: up(ret(d.x)).rolling(21).std() / (-up(-ret(d.x))).rolling(21).std()),
        (lambda s: R.expected_shortfall(s, R.ret(s, "x"), 252, 0.05), lambda d: ret(d.x).rolling(252).apply(lambda v: v[v <= np.quantile(v, 0.05)].mean(), raw=True)),
        (lambda s: R.right_shortfall(s, R.ret(s, "x"), 252, 0.05), lambda d: ret(d.x).rolling(252).apply(lambda v: v[-v <= np.quantile(-v, 0.05)].mean(), raw=True)),
        (lambda s: R.time_in_drawdown(s, R.ret(s, "x"), 63), lambda d: below_peak(ret(d.x)).rolling(63, 31).mean()),
        (lambda s: R.partial_moment(s, R.ret(s, "x"), 63, 2), lambda d: (-ret(d.x)).clip(lower=0).pow(2).rolling(63).mean()),
        (lambda s: R.tail_share(s, R.ret(s, "x"), 63, 0.05), lambda d: (ret(d.x) <= ret(d.x).rolling(63).quantile(0.05)).astype(float).rolling(63).mean()),
        (lambda s: R.semivariance(s, R.ret(s, "x"), 21), lambda d: ret(d.x).where(ret(d.x) < 0, 0.0).pow(2).rolling(21).mean()),
        (lambda s: R.realized_vol(s, "x", 21), lambda d: np.log(d.x).diff().rolling(21).std() * 252**0.5),
        (lambda s: R.vol_of_vol(s, "y", 21), lambda d: d.y.ffill().pct_change(fill_method=None).rolling(21, 10).std()),
        (lambda s: R.ma_gap(s, "y", 5, 20), lambda d: (d.y.rolling(5).mean() - d.y.rolling(20).mean()) / (d.y.rolling(20).mean() + 1e-9)),
        (lambda s: R.breakout(s, "y", 21)[0], lambda d: (d.y >= d.y.shift(1).rolling(21).max()).astype(float)),
        (lambda s: R.crossover(s, "y", 5, 20)[0], lambda d: crossed(d.y.rolling(5).mean() > d.y.rolling(20).mean())),
        (lambda s: R.trend_persistence(s, R.diff(s, "y"), 21), lambda d: (d.y.diff() > 0).astype(float).where(d.y.diff().notna()).rolling(21).mean()),
        (lambda s: R.momentum_regime(s, R.ret(s, "y"), 21), lambda d: (ret(d.y).rolling(21).mean() / (ret(d.y).rolling(21).std() + 1e-9)).rolling(21).mean()),
        (lambda s: R.beta(s, R.ret(s, "x"), R.ret(s, "y"), 30), lambda d: slope_on(ret(d.x), ret(d.y), 30)),
        (lambda s: R.second_diff(s, "y", 5), lambda d: d.y.diff().diff(5)),
        (lambda s: R.momentum_trend(s, "x", 10, 30), lambda d: d.x.rolling(10, 5).mean() - d.x.rolling(30, 15).mean()),
        (lambda s: R.ewma(s, "x", span=5, least=2), lambda d: d.x.ewm(span=5, min_periods=2).mean()),
        (lambda s: R.share_below(s, "y", 60), lambda d: d.y.rolling(60, 20).apply(lambda v: (v < v[-1]).mean(), raw=True)),
    ],
)
def test_rolling(spark, walk, define, wanted):
    same(run(spark, walk, define), wanted(walk), 1e-7)


# kernels of prices, volumes and pairs, against pandas


@pytest.fixture(scope="module")
def market():
    """A panel of one ticker with gaps, zeros, ties and nulls in every column."""
    rng = np.random.default_rng(8)
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, N)))
    spread = np.abs(rng.normal(0, 0.01, (3, N)))
    d = {
        "o": close * np.exp(rng.normal(0, 0.005, N)), "c": close, "h": close * (1 + spread[0]), "l": close * (1 - spread[1]), "b": 80 * np.exp(np.cumsum(rng.normal(0, 0.01, N))),
        "z": 20 * np.exp(np.cumsum(rng.normal(0, 0.015, N))), "vol": rng.integers(0, 900, N).astype(float), "turn": rng.integers(-1, 3, N) * 1000.0, "n": rng.integers(0, 30, N).astype(float),
        "call": rng.integers(0, 50, N).astype(float), "put": rng.integers(0, 50, N).astype(float), "iv": 20 + rng.normal(0, 2, N), "iv2": 22 + rng.normal(0, 2, N), "sent": rng.normal(0, 1, N),
    }
    d["h"] = np.maximum.reduce([d["h"], d["o"], d["c"]])
    d["l"] = np.minimum.reduce([d["l"], d["o"], d["c"]])
    for k, (name, v) in enumerate(d.items()):
        v[[70 + k, 150 + 2 * k, 151 + 2 * k]] = np.nan
    d["vol"][40:45] = -5.0
    return pd.DataFrame({"ticker": "A", "date": [date(2020, 1, 1) + timedelta(k) for k in range(N)], **d})


E = 1e-9
lnr = lambda a, b: np.log(a.clip(lower=1e-12) / b.clip(lower=1e-12))
rs_term = lambda d: lnr(d.h, d.c) * lnr(d.h, d.o) + lnr(d.l, d.c) * lnr(d.l, d.o)


def z_of(x, n, least=None):
    least = max(1, n // 2) if least is None else least
    return (x - x.rolling(n, least).mean()) / (x.rolling(n, least).std() + E)


def regime_of(s, v, n):
    a, b = z_of(s, n, n), z_of(v, n, n)
    out = pd.Series(0.0, s.index)
    out[(a > 1) & (b > 1)], out[(a < -1) & (b > 1)], out[(a > 1) & (b <= 1)], out[(a < -1) & (b <= 1)] = 2, -2, 1, -1
    return out


def spread_of(d, n):
    one = lnr(d.h, d.l)
    alpha = ((one**2).rolling(2).sum() - one * one.shift(1)).clip(lower=0) ** 0.5
    return (2 * (np.exp(alpha) - 1) / (1 + np.exp(alpha))).rolling(n).mean()


def ewm_corr(a, b, halflife):
    m = lambda x: x.ewm(halflife=halflife).mean()
    p, q = a - m(a), b - m(b)
    return m(p * q) / np.sqrt(m(p**2) * m(q**2) + E)


def dcc_of(a, b, halflife):
    m = lambda x: x.ewm(halflife=halflife).mean()
    p, q = ((x - x.rolling(63).mean()) / (x.rolling(63).std() + E) for x in (a, b))
    return m(p * q) / np.sqrt(m(p**2) * m(q**2) + E)


def coint_of(y, x, n):
    out = pd.Series(np.nan, y.index)
    for i in range(n - 1, len(y)):
        a, b = y.to_numpy()[i - n + 1 : i + 1], x.to_numpy()[i - n + 1 : i + 1]
        ok = np.isfinite(a) & np.isfinite(b)
        if ok.sum() < n // 2:
            continue
        w = np.linalg.lstsq(np.c_[np.ones(ok.sum()), b[ok]], a[ok], rcond=None)[0]
        e = a[ok] - w[0] - w[1] * b[ok]
        out.iloc[i] = (a[-1] - w[0] - w[1] * b[-1] - e.mean()) / (e.std() + E)
    return out


def lead_of(a, b, n, most, which):
    out = pd.Series(np.nan, a.index)
    for i in range(n + most, len(a)):
        found = []
        for k in range(-most, most + 1):
            x, y = a.to_numpy()[i - n + 1 : i + 1], b.shift(k).to_numpy()[i - n + 1 : i + 1]
            ok = np.isfinite(x) & np.isfinite(y)
            if ok.sum() > 1:
                found.append((np.corrcoef(x[ok], y[ok])[0, 1], k))
        top = max(abs(c) for c, _ in found)
        out.iloc[i] = next(f for f in found if abs(abs(f[0]) - top) < 1e-12)[which]
    return out


def corr_of(a, b, n, least=None):
    both = a.notna() & b.notna()
    return a.where(both).rolling(n, max(2, n // 2) if least is None else least).corr(b.where(both))


def residual(a, b, n):
    return a - slope_on(a, b, n) * b


KERNELS = {
    "stochastic": (lambda s: R.stochastic_k(s, "c", "l", "h", 14), lambda d: 100 * (d.c - d.l.rolling(14).min()) / (d.h.rolling(14).max() - d.l.rolling(14).min() + E)),
    "range": (lambda s: R.range_position(s, "c", "l", "h", 20), lambda d: (lambda lo, hi: (d.c - lo) / (hi - lo + E))(
        d.c.rolling(20).min().combine(d.l.rolling(20).min(), np.minimum), d.c.rolling(20).max().combine(d.h.rolling(20).max(), np.maximum))),
    "trend_filter": (lambda s: R.trend_filter(s, "c", 20, 50), lambda d: (d.c.rolling(20).mean() > d.c.rolling(50).mean()).astype(float)),
    "garman_klass": (lambda s: R.garman_klass(s, "o", "h", "l", "c", 21), lambda d: (0.5 * lnr(d.h, d.l) ** 2 - (2 * np.log(2) - 1) * lnr(d.c, d.o) ** 2).rolling(21).sum().clip(lower=0) ** 0.5 * 252**0.5),
    "parkinson": (lambda s: R.parkinson(s, "h", "l", 21), lambda d: (lnr(d.h, d.l) ** 2 / (4 * np.log(2))).rolling(21).mean() ** 0.5 * 252**0.5),
    "rogers_satchell": (lambda s: R.rogers_satchell(s, "o", "h", "l", "c", 21), lambda d: rs_term(d).rolling(21).mean().clip(lower=0) ** 0.5 * 252**0.5),
    "yang_zhang": (lambda s: R.yang_zhang(s, "o", "h", "l", "c", 21), lambda d: (lnr(d.o, d.c.shift(1)).rolling(21).var() + 0.34 * lnr(d.c, d.o).rolling(21).var() + 0.66 * rs_term(d).rolling(21).mean()).clip(lower=0) ** 0.5 * 252**0.5),
    "vol_high": (lambda s: R.vol_flags(s, "iv")[0], lambda d: (z_of(d.iv, 60) > 1.5).astype(float)),
    "vol_crush": (lambda s: R.vol_flags(s, "iv")[1], lambda d: (z_of(d.iv.diff(21), 60) < -1.5).astype(float)),
    "dollars": (lambda s: R.dollar_volume(s, "c", "vol", "turn"), lambda d: d.turn.where(d.turn > 0, d.c * d.vol)),
    "amihud": (lambda s: R.amihud(s, R.ret(s, "c"), R.dollar_volume(s, "c", "vol", "turn"), 21), lambda d: (ret(d.c).abs() / (d.turn.where(d.turn > 0, d.c * d.vol) + E)).rolling(21).mean()),
    "corwin_schultz": (lambda s: R.corwin_schultz(s, "h", "l", 21), lambda d: spread_of(d, 21)),
    "roll_spread": (lambda s: R.roll_spread(s, R.ret(s, "c"), 21), lambda d: ret(d.c).abs().rolling(21).mean()),
    "impact": (lambda s: R.market_impact(s, R.ret(s, "c"), "vol", 21), lambda d: (ret(d.c).abs() / d.vol.clip(lower=1) ** 0.5).rolling(21).mean()),
    "liquidity_premium": (lambda s: R.liquidity_premium(s, R.corwin_schultz(s, "h", "l", 21), R.realized_vol(s, "c", 21), 63), lambda d: z_of(spread_of(d, 21) / (np.log(d.c).diff().rolling(21).std() * 252**0.5 + E), 63)),
    "pressure": (lambda s: R.price_pressure(s, "c", "vol", 10), lambda d: ret(d.c).rolling(10).mean() * z_of(d.vol, 20).rolling(10).mean()),
    "skew": (lambda s: R.skew_dynamics(s, "iv", "iv2", 21), lambda d: (d.iv - d.iv2).rolling(21).mean()),
    "flow_pressure": (lambda s: R.flow_pressure(s, "call", "n + 1", 5), lambda d: (d.call / (d.n + 1 + E)).pct_change(5, fill_method=None).replace([np.inf, -np.inf], np.nan)),
    "congestion": (lambda s: R.congestion(s, "c", "call", 21), lambda d: z_of(d.c, 21, 21) * (1 - d.call.rolling(21).rank(pct=True))),
    "term_slope": (lambda s: R.term_slope(s, "iv", "iv2"), lambda d: (d.iv2 - d.iv) / (d.iv + E)),
    "burst": (lambda s: R.burst(s, "sent", 21), lambda d: (z_of(d.sent, 21, 21).abs() > 2).astype(float)),
    "roc": (lambda s: R.rate_of_change(s, "iv", 5), lambda d: d.iv.pct_change(5, fill_method=None)),
    "sentiment_regime": (lambda s: R.sentiment_regime(s, "sent", "n", 21), lambda d: regime_of(d.sent, d.n, 21)),
    "news_momentum": (lambda s: R.news_momentum(s, "n", "sent", 5), lambda d: d.sent.diff(5) * (d.n / (d.n.rolling(10).mean() + E))),
    "order_flow": (lambda s: R.order_flow(s, "call", "put", 10), lambda d: ((d.call - d.put) / (d.call + d.put + E)).ewm(span=10).mean()),
    "weighted_ewma": (lambda s: R.weighted_ewma(s, "sent", "vol", 10), lambda d: (d.sent * (d.vol.clip(lower=0) / (d.vol.clip(lower=0).rolling(5).max() + E))).ewm(halflife=10, min_periods=2).mean()),
    "corr_fisher": (lambda s: R.corr_fisher(s, R.ret(s, "c"), "sent", 20), lambda d: np.arctanh(corr_of(ret(d.c), d.sent, 20).clip(-0.9999, 0.9999))),
    "hedged": (lambda s: R.hedged(s, R.ret(s, "c"), R.ret(s, "b"), 63), lambda d: residual(ret(d.c), ret(d.b), 63)),
    "corr_of_abs": (lambda s: R.corr_of_abs(s, R.ret(s, "c"), "sent", 21), lambda d: corr_of(ret(d.c).abs(), d.sent.abs(), 21, 21)),
    "partial_corr": (lambda s: R.partial_corr(s, R.ret(s, "c"), R.ret(s, "b"), R.ret(s, "z"), 21), lambda d: corr_of(residual(ret(d.c), ret(d.z), 21), residual(ret(d.b), ret(d.z), 21), 21, 20)),
    "lead": (lambda s: R.lead_lag(s, R.ret(s, "c"), R.ret(s, "b"), 21, 5)[0], lambda d: lead_of(ret(d.c), ret(d.b), 21, 5, 0)),
    "lead_k": (lambda s: R.lead_lag(s, R.ret(s, "c"), R.ret(s, "b"), 21, 5)[1], lambda d: lead_of(ret(d.c), ret(d.b), 21, 5, 1)),
    "coint": (lambda s: R.coint_z(s, R.ln("c"), R.ln("b"), 100), lambda d: coint_of(np.log(d.c), np.log(d.b), 100)),
    "ewma_corr": (lambda s: R.ewma_corr(s, R.ret(s, "c"), "sent", 21), lambda d: ewm_corr(ret(d.c), d.sent, 21)),
    "dcc": (lambda s: R.dcc(s, R.ret(s, "c"), "sent", 21), lambda d: dcc_of(ret(d.c), d.sent, 21)),
    "within": (lambda s: R.within(s, "sent > 1.5", 5), lambda d: (d.sent > 1.5).astype(float).rolling(5, 1).max()),
}


def test_market_kernels(spark, market):
    """All at once: one chain of stages, each column against its own formula."""
    df = spark.createDataFrame(market)
    df = df.select("ticker", "date", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in market.columns if c not in ("ticker", "date")))
    s = Series()
    got = s.spark(df, ["date"], {n: define(s) for n, (define, _) in KERNELS.items()}, None).orderBy("date").toPandas()
    wrong = []
    for name, (_, wanted) in KERNELS.items():
        a, b = got[name].astype(float).to_numpy(), np.asarray(wanted(market), float)
        off = ~np.isclose(a, b, rtol=1e-6, atol=1e-7, equal_nan=True)
        if off.any():
            at = np.flatnonzero(off)
            wrong.append((name, len(at), [(int(k), a[k], b[k]) for k in at[:3]]))
    assert not wrong, wrong


def test_hysteresis(spark, walk):
    y = walk.y - walk.y.rolling(20, 1).mean()
    pdf = walk.assign(y=y)
    got = run(spark, pdf, lambda s: R.hysteresis(s, "y", 0.5, 0.2, 3, 3))
    state, states = 0, []
    for v in y:
        state = 0 if v < 0.2 else 1 if v > 0.5 else state
        states.append(state)
    kept, k = [0] * N, 0
    while k < N:
        end = k
        while end < N and states[end] == states[k]:
            end += 1
        if states[k] and end - k >= 3:
            kept[k:end] = [1] * (end - k)
        k = end
    ends = [i for i in range(N) if kept[i] and (i + 1 == N or not kept[i + 1])]
    quiet = {e + j for e in ends for j in range(1, 4)}
    assert got.tolist() == [float(v and i not in quiet) for i, v in enumerate(kept)]


def test_registry():
    assert {"px.mom_5", "vol.rv_21", "opt.vrp_21", "x.beta_spy_63", "macro.vix_z60"} <= set(features.names())
    assert features.lookback(["px.mom_126", "opt.fly_1m_40v25"]) == 126
    assert features.lookback([]) == 60
    assert "px" in features.categories()


def test_asof_null_rules(spark):
    q = spark.createDataFrame([("A", date(2020, 1, 1), 1.0), ("A", date(2020, 1, 3), None)], "k string, d date, v double")
    t = spark.createDataFrame([("A", date(2020, 1, d)) for d in (1, 2, 3, 4)] + [("B", date(2020, 1, 1))], "k string, t date")
    get = lambda keep: [r.v for r in joins.asof(t, q, ["k"], "t", "d", "v", keep).orderBy("k", "t").collect()]
    assert get(False) == [1.0, 1.0, None, 1.0, None]
    assert get(True) == [1.0, 1.0, None, None, None]


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "ticker string, trigger_date date, exit_date date, pnl_dollars double, pnl_pct double, setup_id long, trade_id long")
    assert ledger.nav_returns(e, ["ticker"], 1.0).count() == 0
    assert ledger.exclusive(e, ["setup_id"], 1).count() == 0
    assert ledger.streaks(e, ["setup_id"], ["trigger_date"], "pnl_pct").count() == 0


def test_option_prices(spark):
    def cdf(v):
        return 0.5 * (1 + math.erf(v / math.sqrt(2)))

    s, k, t, r, v = 100.0, 105.0, 0.5, 0.01, 0.3
    d1 = (math.log(s / k) + (r + v * v / 2) * t) / (v * math.sqrt(t))
    call = s * cdf(d1) - k * math.exp(-r * t) * cdf(d1 - v * math.sqrt(t))
    lit = [F.lit(a) for a in (s, k, t, r, v)]
    row = spark.range(1).select(
        options.price(*lit, F.lit(True)).alias("c"), options.price(*lit, F.lit(False)).alias("p"), options.delta(*lit, F.lit(True)).alias("d"),
        options.strike_for_delta(lit[0], F.lit(0.25), lit[2], lit[3], lit[4], F.lit(True)).alias("k25"), options.expiry_days(F.lit(4)).alias("e"),
        options.listed_strike(F.lit(101.3), F.lit(101.3)).alias("ls"),
    ).first()
    assert abs(row.c - call) < 1e-4 and abs(row.c - row.p - (s - k * math.exp(-r * t))) < 1e-9
    assert abs(row.d - cdf(d1)) < 1e-6
    d25 = (math.log(s / row.k25) + (r + v * v / 2) * t) / (v * math.sqrt(t))
    assert abs(cdf(d25) - 0.25) < 1e-4
    assert row.e == 7 and row.ls == 102.5 or row.ls == 100.0


def test_crps_by_integration(spark):
    edges, p, y = (-1.0, -0.2, 0.1, 1.0), [0.2, 0.5, 0.3], 0.37
    got = spark.createDataFrame([(p, y)], "probs array<double>, y double").select(scoring.crps("probs", "y", edges).alias("v")).first().v
    z = np.linspace(-1, 1, 400_001)
    cdf = np.interp(z, edges, np.r_[0, np.cumsum(p)])
    assert abs(got - float((((cdf - (z >= y)) ** 2)[:-1] * np.diff(z)).sum())) < 1e-4


def test_folds_do_not_leak():
    days = [date(2020, 1, 1) + timedelta(k) for k in range(1000)]
    folds = splits.anchored_folds(days, 5, 63)
    at = {d: k for k, d in enumerate(days)}
    assert folds[-1].test_end == days[-1] and sum(f.is_tail for f in folds) == 1
    for f in folds:
        assert f.train_start == days[0] and at[f.test_start] - at[f.train_end] > 5
    assert splits.anchored_folds(days, 5, 63) == folds and splits.anchored_folds(days[:50], 5, 63) == []
    assert splits.parse_split_id(folds[0].split_id)["H"] == "5"
    assert len(splits.nested_folds(days, 4)) == 4 and splits.rolling_folds(days, 500, 100, 100)[0][3] == days[599]


def test_fronts_and_evolution():
    x = np.array([[1, 1], [2, 0], [0, 2], [0, 0], [1, 1]], float)
    assert search.front_numbers(x).tolist() == [1, 1, 1, 2, 1]
    space = search.Space(["A", "B"], [f"s{k}" for k in range(9)])
    seen: list[int] = []

    def evaluate(people):
        seen.append(len(people))
        return {p.dna: (float(len(p.signals)), float(p.ticker == "B")) for p in people}

    make = lambda: search.Evolution(space, evaluate, size=12, generations=4, islands=2, seed=5).run()
    best = make()
    assert best[0].ticker == "B" and len(best[0].signals) == 2
    assert [p.dna for p in make()] == [p.dna for p in best]


def test_events(spark):
    row = spark.range(1).select(*(events.parse_relevance(F.lit(t)).alias(f"c{k}") for k, t in enumerate(("High", "med", "12.5%", "x")))).first()
    assert tuple(row) == (90.0, 60.0, 12.5, None)
    c = spark.createDataFrame([("CPI YoY",), ("Retail Sales",), (None,)], "n string")
    got = [r.c for r in c.select(events.category(F.col("n"), {"CPI YoY": "inflation"}, [("sales", "consumer")]).alias("c")).collect()]
    assert got == ["inflation", "consumer", "other"]


def test_signals(spark):
    f = spark.createDataFrame([("A", date(2020, 1, k + 1), "f", v, v, z) for k, (v, z) in enumerate([(0.95, 3.0), (0.5, 0.0), (None, None)])],
                              "ticker string, date date, feature string, value double, share double, z double")
    fired = signals.compile_rules(f)
    assert {r.rule for r in fired.collect()} == {"pctl_above_90", "pctl_above_80", "z_above"}
    kept = {r.rule for r in signals.without_twins(fired).collect()}
    assert kept == {"z_above"}


def test_bootstrap_is_seeded(spark):
    df = spark.createDataFrame([("a", k, math.sin(k)) for k in range(50)] + [("b", 1, 0.1)], "g string, t int, r double")
    get = lambda: sorted(map(tuple, ledger.bootstrap(df, ["g"], ["t"], "mean", 60).collect()))
    first = get()
    assert first[0] == get()[0] and first[0][3] <= first[0][2] <= first[0][4]


def test_kernels():
    t = np.arange(400)
    noise = np.random.default_rng(1).normal(size=400)
    assert kernels.permutation_entropy(t) == 0 and kernels.permutation_entropy(noise) > 0.95
    assert 0.35 < kernels.dfa(noise) < 0.65 and kernels.sample_entropy(np.sin(t / 3)) < kernels.sample_entropy(noise)
    assert kernels.mean_run(np.array([1, 1, -1, -1, -1, 1])) == 2
    assert kernels.page_hinkley(np.r_[np.zeros(50), np.ones(50) * 3]) >= 50
    assert kernels.h0_wasserstein(np.array([1.0, 2.0]), np.array([2.0])) == 1.0
    assert kernels.h0_lifetimes(np.array([0.0, 1.0, 3.0])).tolist() == [1.0, 2.0]
    states = kernels.hidden_states(np.r_[noise[:150] * 0.1, noise[150:300] * 5], 2)
    assert len(set(states.tolist())) <= 2
    assert all(np.isnan(kernels.SUITE[k](np.zeros(0))) for k in ("permutation_entropy", "hurst", "dfa", "huber"))
    lag, f = kernels.granger(np.r_[0, noise[:-1]] + 0.01 * noise[::-1], noise)
    assert lag >= 1 and f > 100
    assert kernels.recurrence(np.sin(t[:100] / 5))["determinism"] > kernels.recurrence(noise[:100])["determinism"]


def test_selection(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0), ("b", 3, None)], "g string, id int, x double")
    got = [tuple(r) for r in selection.top_k(df, ["g"], [F.desc_nulls_last("x"), F.col("id")], 1).orderBy("g").collect()]
    assert got == [("a", 1, 2.0), ("b", 3, None)]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "A", 0.123456, [1.0, 2.0])], "fold int, ticker string, x double, p array<double>")
    tables.write_by_fold(df, f"{tmp_path}/folds")
    assert tables.read_fold(spark, f"{tmp_path}/folds", 1).count() == 1
    tables.write_csv(df, f"{tmp_path}/csv", columns=["ticker", "missing"])
    back = tables.read_csv(spark, f"{tmp_path}/csv", "ticker string, missing string, fold int, x double, p string").first()
    assert (back.x, back.p, back.missing) == (0.1235, "[1.0,2.0]", None)
    assert tables.read_csv(spark, f"{tmp_path}/none", "a int").count() == 0
    raw = spark.createDataFrame([("2020-01-03 08:30:00", "CPI", "0.2", "x", "High"), (None, "NFP", "1", "2", "1")], "`Date Time` string, Event string, Survey string, Actual string, Relevance string")
    got = tables.read_releases(raw).collect()
    assert len(got) == 1 and got[0].survey == 0.2 and got[0].actual is None and got[0].relevance == 90.0 and got[0].release_ts.hour == 13


def test_streaming(spark, tmp_path):
    from tidemark.streaming import stateful

    rows = [(datetime(2024, 1, 1) + timedelta(minutes=k), "a", 0.0 if k < 50 else 30.0) for k in range(100)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in")
    for name, df in (("alarms", stateful.page_hinkley(src)), ("kept", stateful.cooled(src, key="event_type"))):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    assert spark.sql("SELECT * FROM alarms").count() >= 1
    assert spark.sql("SELECT * FROM kept").count() == 2
    q = stateful.windowed_intensity(src).writeStream.outputMode("complete").format("memory").queryName("heat")
    q = q.option("checkpointLocation", f"{tmp_path}/heat").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.n for r in spark.sql("SELECT * FROM heat").collect()) == 100


def test_exclusive_against_a_loop(spark):
    rng = np.random.default_rng(5)
    start = date(2020, 1, 1)
    trades = []
    for k in range(400):
        begin = start + timedelta(int(rng.integers(0, 300)))
        end = None if rng.random() < 0.02 else begin + timedelta(int(rng.integers(-3, 9)))  # an exit may lie before its trigger
        trades.append((int(rng.integers(0, 4)), int(rng.integers(0, 350)), begin, end, "x"))
    trades += [(9, 1, None, None, "no trigger"), (7, 1, start, None, "open"), (7, 2, start + timedelta(9), start, "blocked")]
    df = spark.createDataFrame(trades, "setup_id int, trade_id long, trigger_date date, exit_date date, note string")
    far = date(9999, 1, 1)
    wanted, until = [], {}
    for t in sorted((t for t in trades if t[2]), key=lambda t: (t[0], t[2], t[1], t[3] or far)):
        if t[0] not in until or t[2] > until[t[0]]:
            wanted.append(t)
            until[t[0]] = (t[3] or t[2] + timedelta(3650)) + timedelta(2)
    got = sorted((tuple(r) for r in ledger.exclusive(df, ["setup_id"], 2).collect()), key=repr)
    assert got == sorted(wanted, key=repr)
    assert ledger.exclusive(df.where("false"), ["setup_id"], 2).count() == 0


def test_matched_labels():
    import itertools

    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = map(int, rng.integers(1, 5, 2))
        a, b = rng.normal(size=(n, 2)), rng.normal(size=(m, 2))
        got, k = regimes.matched(a, b), min(n, m)
        cost = lambda pairs: sum(np.linalg.norm(a[i] - b[j]) for i, j in pairs)
        best = min(cost(zip(i, j)) for i in itertools.combinations(range(n), k) for j in itertools.permutations(range(m), k))
        assert len(set(got.values())) == len(got) == k and abs(cost((i, j) for j, i in got.items()) - best) < 1e-9


def test_support_of_nothing_and_of_streaks(spark):
    rows = [("a", d, d in (1, 2, 3, 6), 1.0) for d in range(1, 8)] + [("b", 1, None, 2.0), ("c", 1, True, None)]
    df = spark.createDataFrame(rows, "k string, d int, fired boolean, r double")
    got = {r.k: (r.total_fires, r.max_streak, r.avg_streak, r.meets_min_support) for r in support.support_stats(df, ["k"], "d", 2).collect()}
    assert got == {"a": (4, 3, 1.75, True), "b": (0, 0, 0.0, False), "c": (1, 1, 1.0, False)}
    assert support.supported(df, ["k"], 2).count() == 4 and support.supported(df.where("false"), ["k"]).count() == 0
    assert support.supported_returns(df, ["k"], "r", 2).where("r is not null").count() == 4
    assert df.where(support.eligible([])).count() == 0 and df.where(support.eligible(["r", "fired"])).count() == 7


def test_gauntlet_without_market_data(spark):
    t0 = date(2024, 1, 1)
    rows = [(1, "a", t0 + timedelta(k), t0 + timedelta(k + 3), 0.1, 10.0) for k in range(6)] + [(2, "a", t0, None, None, 1.0)]
    df = spark.createDataFrame(rows, "setup_id int, ticker string, trigger_date date, exit_date date, pnl_pct double, capital double")
    got = {r.setup_id: (r.reason, r.pass_stage1, r.recent_win_rate) for r in gauntlet.health(df, None).collect()}
    assert got == {1: ("ok", True, 1.0), 2: ("S1_ACTIVITY", False, 0.0)}
    stages = spark.createDataFrame([(1, True, True, True, True, 2.0), (2, True, False, None, True, 2.0)], "id int, pass_stage1 boolean, pass_stage2 boolean, pass_stage3 boolean, pass_stage4 boolean, score_3 double")
    stages = stages.withColumns({f"score_{k}": F.lit(None).cast("double") for k in (1, 2, 4)})
    out = {r.id: (round(r.promotion_score, 4), r.reject_code) for r in gauntlet.final(stages, 0.9).collect()}
    assert out == {1: (round(0.55 * 0.25 + 0.45, 4), "S5_LOW_SCORE"), 2: (0.0, "S5_UPSTREAM_FAIL_S2+S3")}


def test_quantile_and_structure(spark):
    p = [1e-6, 0.01, 0.3, 0.5, 0.8, 0.99, 1 - 1e-6, 0.0, 1.0]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    from statistics import NormalDist

    got = [r.q for r in df.select(options.normal_quantile(F.col("p")).alias("q")).collect()]
    assert got[-2:] == [None, None] and all(abs(a - NormalDist().inv_cdf(b)) < 1e-7 for a, b in zip(got[:-2], p))
    key = options.structure_key(F.lit("Call"), F.lit(5.0), F.lit(110.0), F.lit(100.0), F.lit(0.4), F.lit(2.5))
    assert df.select(key.alias("k")).first().k == "type=call;tenor=5d;strike_rel=0.1000;delta=0.400;width=2.500"
    assert signals.is_z_like("x.beta_z") and not signals.is_z_like("rank") and signals.is_rank("CS.rank_mom")

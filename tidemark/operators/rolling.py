"""Rolling operators of one series, or of two that share their rows.

Each takes the stages ``s`` and names or expressions of columns, and returns an
expression.  Unless said otherwise a window of n rows needs n values; comparisons
with a missing value are false where a flag is asked for.
"""

from __future__ import annotations

from math import log

from tidemark.functions.series import Series, num

EPS = "1e-9"
YEAR = "sqrt(252e0)"
#: Row at which exponential weights are 1.
CENTRE = 1000


def half(n: int) -> int:
    return max(1, n // 2)


# scalar kernels


def safe_div(a: str, b: str) -> str:
    return f"CASE WHEN abs({b}) > {EPS} THEN ({a}) / ({b}) END"


def flag(test: str) -> str:
    return f"CASE WHEN {test} THEN 1e0 ELSE 0e0 END"


def ln(x: str) -> str:
    return f"CASE WHEN ({x}) > 0 THEN ln({x}) END"


def root(x: str) -> str:
    """Square root, of negative numbers 0."""
    return f"CASE WHEN ({x}) >= 0 THEN sqrt({x}) WHEN ({x}) < 0 THEN 0e0 END"


def clip(x: str, low: str, high: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {low}), {high}) END"


# levels and changes


def pct_change(s: Series, x: str, n: int) -> str:
    """Change over n rows of the forward-filled series."""
    x = s.filled(x)
    return s.let(safe_div(x, s.lag(x, n)) + " - 1")


def ret(s: Series, x: str = "px_last") -> str:
    return pct_change(s, x, 1)


def diff(s: Series, x: str, n: int = 1) -> str:
    x = s.let(x)
    return s.let(f"{x} - {s.lag(x, n)}")


def second_diff(s: Series, x: str, k: int = 1) -> str:
    return diff(s, diff(s, x, 1), k)


def mean(s: Series, x: str, n: int, least: int | None = None) -> str:
    return s.roll("avg", x, n, least)


def std(s: Series, x: str, n: int, least: int | None = None) -> str:
    return s.roll("stddev_samp", x, n, least)


def momentum_trend(s: Series, x: str, short: int, long: int) -> str:
    return s.let(f"{mean(s, x, short, half(short))} - {mean(s, x, long, half(long))}")


def zscore(s: Series, x: str, n: int, least: int | None = None) -> str:
    x, least = s.let(x), half(n) if least is None else least
    return s.let(f"({x} - {mean(s, x, n, least)}) / ({std(s, x, n, least)} + {EPS})")


def mad_z(s: Series, x: str, n: int) -> str:
    x = s.let(x)
    away = s.let(f"abs({x} - {s.quantile(x, 0.5, n, half(n))})")
    return s.let(f"({x} - {s.quantile(x, 0.5, n, half(n))}) / (1.4826e0 * {s.quantile(away, 0.5, n, half(n))} + {EPS})")


def pct_rank(s: Series, x: str, n: int) -> str:
    """Rank of the last of n values among them, ties averaged, as a share."""
    x = s.let(x)
    v = s.values(x, n)
    below, equal = s.count_where(v, f"v < {x}"), s.count_where(v, f"v = {x}")
    size = f"{'size' if s.engine == 'spark' else 'len'}({v})"
    return s.let(f"CASE WHEN {x} IS NOT NULL AND {size} = {n} THEN ({below} + ({equal} + 1) / 2e0) / {n} END")


def share_below(s: Series, x: str, n: int = 252) -> str:
    """Share of the window strictly below its last value; a fifth of the window suffices."""
    x = s.let(x)
    v = s.values(x, n)
    size = f"{'size' if s.engine == 'spark' else 'len'}({v})"
    return s.let(f"CASE WHEN {x} IS NOT NULL AND {size} >= {max(20, n // 5)} THEN {s.count_where(v, f'v < {x}')} * 1e0 / {size} END")


# oscillators, trend, range


def rsi(s: Series, x: str, n: int = 14) -> str:
    """Relative strength of simple means; a missing change counts as none."""
    d = diff(s, x)
    up = s.let(f"CASE WHEN {d} > 0 THEN {d} ELSE 0e0 END")
    down = s.let(f"CASE WHEN {d} < 0 THEN -{d} ELSE 0e0 END")
    return s.let(f"100 - 100 / (1 + {mean(s, up, n)} / ({mean(s, down, n)} + {EPS}))")


def stochastic_k(s: Series, close: str, low: str, high: str, n: int) -> str:
    ll, hh = s.roll("min", low, n), s.roll("max", high, n)
    return s.let(f"100 * ({close} - {ll}) / ({hh} - {ll} + {EPS})")


def range_position(s: Series, close: str, low: str, high: str, n: int) -> str:
    a, b, c, d = s.roll("min", close, n), s.roll("min", low, n), s.roll("max", close, n), s.roll("max", high, n)
    ll, hh = (s.let(f"CASE WHEN {u} IS NOT NULL AND {v} IS NOT NULL THEN {f}({u}, {v}) END") for f, u, v in (("least", a, b), ("greatest", c, d)))
    return s.let(f"({close} - {ll}) / ({hh} - {ll} + {EPS})")


def log_slope(s: Series, x: str, n: int) -> str:
    """Slope of the logarithm on the row number from the n-th row on; needs the larger of 5 and half the values."""
    y, t = s.let(f"CASE WHEN {x} IS NOT NULL THEN ln(greatest({x}, 1e-12)) END"), s.let(f"row_number() {s.row()}")
    return s.let(f"CASE WHEN {t} >= {n} THEN {s.roll2('regr_slope', y, t, n, max(5, n // 2))} END")


def ma_gap(s: Series, x: str, short: int, long: int) -> str:
    a, b = mean(s, x, short), mean(s, x, long)
    return s.let(f"({a} - {b}) / ({b} + {EPS})")


def crossover(s: Series, x: str, short: int, long: int) -> tuple[str, str]:
    """Flags of the short mean crossing above the long one, and below it."""
    above = s.let(flag(f"{mean(s, x, short)} > {mean(s, x, long)}"))
    before = s.let(f"coalesce({s.lag(above)}, 0e0)")
    return s.let(flag(f"{above} = 1 AND {before} = 0")), s.let(flag(f"{above} = 0 AND {before} = 1"))


def breakout(s: Series, x: str, n: int) -> tuple[str, str]:
    """Flags of reaching the extremes of the n rows before."""
    x = s.let(x)
    w = s.frame(-n, -1)
    high = s.let(f"CASE WHEN count({x}) {w} >= {n} THEN max({x}) {w} END")
    low = s.let(f"CASE WHEN count({x}) {w} >= {n} THEN min({x}) {w} END")
    return s.let(flag(f"{x} >= {high}")), s.let(flag(f"{x} <= {low}"))


def trend_persistence(s: Series, r: str, n: int) -> str:
    r = s.let(r)
    return mean(s, f"CASE WHEN {r} IS NOT NULL THEN {flag(f'{r} > 0')} END", n)


def trend_filter(s: Series, x: str, short: int, long: int) -> str:
    return s.let(flag(f"{mean(s, x, short)} > {mean(s, x, long)}"))


def momentum_regime(s: Series, r: str, n: int) -> str:
    return mean(s, f"{mean(s, r, n)} / ({std(s, r, n)} + {EPS})", n)


def drawdown(s: Series, x: str, n: int) -> str:
    return s.let(f"{x} / ({s.roll('max', x, n)} + {EPS}) - 1")


def time_in_drawdown(s: Series, r: str, n: int) -> str:
    """Share of n rows, half of them at least, in which compounded returns stand below their running peak."""
    grown = s.let(f"sum(CASE WHEN {s.let(r)} > -1 THEN ln(1 + {s.let(r)}) ELSE 0e0 END) {s.frame(None)}")
    peak = s.let(f"max({grown}) {s.frame(None)}")
    return mean(s, flag(f"{grown} < {peak} - 1e-12"), n, max(2, n // 2))


# volatility


def realized_vol(s: Series, x: str, n: int) -> str:
    return s.let(f"{std(s, diff(s, ln(x)), n)} * {YEAR}")


def garman_klass(s: Series, o: str, h: str, l: str, c: str, n: int) -> str:  # noqa: E741
    term = f"0.5e0 * power({ln(f'{h} / {l}')}, 2) - {num(2 * log(2) - 1)} * power({ln(f'{c} / {o}')}, 2)"
    return s.let(f"{root(s.roll('sum', term, n))} * {YEAR}")


def parkinson(s: Series, h: str, l: str, n: int) -> str:  # noqa: E741
    return s.let(f"sqrt({mean(s, f'power({ln(f"{h} / {l}")}, 2)', n)} / {num(4 * log(2))}) * {YEAR}")


def _rs_term(o: str, h: str, l: str, c: str) -> str:  # noqa: E741
    return f"({ln(f'{h} / {c}')}) * ({ln(f'{h} / {o}')}) + ({ln(f'{l} / {c}')}) * ({ln(f'{l} / {o}')})"


def rogers_satchell(s: Series, o: str, h: str, l: str, c: str, n: int) -> str:  # noqa: E741
    return s.let(f"{root(mean(s, _rs_term(o, h, l, c), n))} * {YEAR}")


def yang_zhang(s: Series, o: str, h: str, l: str, c: str, n: int, k: float = 0.34) -> str:  # noqa: E741
    night = s.roll("var_samp", ln(f"{o} / {s.lag(c)}"), n)
    day = s.roll("var_samp", ln(f"{c} / {o}"), n)
    term = s.let(f"{night} + {num(k)} * {day} + {num(1 - k)} * {mean(s, _rs_term(o, h, l, c), n)}")
    return s.let(f"{root(term)} * {YEAR}")


def vol_flags(s: Series, vol: str, n: int = 21, z: int = 60) -> tuple[str, str]:
    """Flags of high volatility and of its collapse."""
    return s.let(flag(f"{zscore(s, vol, z)} > 1.5")), s.let(flag(f"{zscore(s, diff(s, vol, n), z)} < -1.5"))


def vol_of_vol(s: Series, vol: str, n: int) -> str:
    return std(s, pct_change(s, vol, 1), n, max(2, n // 2))


def semivariance(s: Series, r: str, n: int, down: bool = True) -> str:
    r = s.let(r)
    return mean(s, f"CASE WHEN {r} {'<' if down else '>'} 0 THEN {r} * {r} ELSE 0e0 END", n)


def up_down_ratio(s: Series, r: str, n: int) -> str:
    """Deviation of the gains by that of the losses; a missing return counts as none."""
    r = s.let(r)
    up, down = (std(s, f"CASE WHEN {r} {sign} 0 THEN {r} ELSE 0e0 END", n) for sign in (">", "<"))
    return s.let(safe_div(up, down))


def expected_shortfall(s: Series, r: str, n: int, alpha: float) -> str:
    """Mean of the values up to the alpha quantile of n rows."""
    r = s.let(r)
    q, v = s.quantile(r, alpha, n), s.values(r, n)
    return s.let(s.mean_where(v, f"v <= {q}"))


def right_shortfall(s: Series, r: str, n: int, alpha: float) -> str:
    return s.let(f"-({expected_shortfall(s, f'-({s.let(r)})', n, alpha)})")


def partial_moment(s: Series, r: str, n: int, order: int, low: bool = True, at: float = 0.0) -> str:
    r = s.let(r)
    away = f"{num(at)} - {r}" if low else f"{r} - {num(at)}"
    return mean(s, f"CASE WHEN {r} IS NOT NULL THEN power(greatest({away}, 0e0), {order}) END", n)


def tail_share(s: Series, r: str, n: int, alpha: float, left: bool = True) -> str:
    """Share of n rows beyond the quantile of their own window."""
    r = s.let(r)
    q = s.quantile(r, alpha if left else 1 - alpha, n)
    return mean(s, flag(f"{r} {'<=' if left else '>='} {q}"), n)


# liquidity, flow, sentiment


def dollar_volume(s: Series, close: str, volume: str, turnover: str) -> str:
    return s.let(f"CASE WHEN {turnover} > 0 THEN {turnover} ELSE {close} * {volume} END")


def amihud(s: Series, r: str, dollars: str, n: int) -> str:
    return mean(s, f"abs({s.let(r)}) / ({s.let(dollars)} + {EPS})", n)


def corwin_schultz(s: Series, h: str, l: str, n: int) -> str:  # noqa: E741
    one = s.let(ln(f"{h} / {l}"))
    before = s.lag(one)
    beta = s.let(f"power({one}, 2) + power({before}, 2)")
    alpha = s.let(f"CASE WHEN {beta} - {one} * {before} > 0 THEN sqrt({beta} - {one} * {before}) WHEN {beta} IS NOT NULL THEN 0e0 END")
    return mean(s, f"2 * (exp({alpha}) - 1) / (1 + exp({alpha}))", n)


def roll_spread(s: Series, r: str, n: int) -> str:
    return mean(s, f"abs({s.let(r)})", n)


def market_impact(s: Series, r: str, volume: str, n: int) -> str:
    return mean(s, f"CASE WHEN {volume} IS NOT NULL THEN abs({s.let(r)}) / sqrt(greatest({volume}, 1e0)) END", n)


def liquidity_premium(s: Series, spread: str, vol: str, n: int) -> str:
    return zscore(s, f"{s.let(spread)} / ({s.let(vol)} + {EPS})", n)


def price_pressure(s: Series, x: str, volume: str, n: int) -> str:
    return s.let(f"{mean(s, ret(s, x), n)} * {mean(s, zscore(s, volume, 2 * n), n)}")


def skew_dynamics(s: Series, call: str, put: str, n: int) -> str:
    return mean(s, f"{call} - {put}", n)


def flow_pressure(s: Series, call: str, put: str, n: int) -> str:
    return rate_of_change(s, f"{call} / ({put} + {EPS})", n)


def congestion(s: Series, x: str, peak: str, n: int) -> str:
    return s.let(f"{zscore(s, x, n, n)} * (1 - {pct_rank(s, peak, n)})")


def term_slope(s: Series, short: str, long: str) -> str:
    return s.let(f"({long} - {short}) / ({short} + {EPS})")


def consensus(s: Series, sources: list[str], weights: list[float]) -> str:
    """Weighted mean of those sources that have a value."""
    top = " + ".join(f"coalesce({num(w)} * {x}, 0e0)" for x, w in zip(sources, weights))
    bottom = " + ".join(f"CASE WHEN {x} IS NULL THEN 0e0 ELSE {num(w)} END" for x, w in zip(sources, weights))
    return s.let(safe_div(f"{top}", f"({bottom})"))


def burst(s: Series, x: str, n: int, limit: float = 2.0) -> str:
    return s.let(flag(f"abs({zscore(s, x, n, n)}) > {num(limit)}"))


def rate_of_change(s: Series, x: str, n: int) -> str:
    """Change over n rows without filling."""
    x = s.let(x)
    return s.let(safe_div(x, s.lag(x, n)) + " - 1")


def sentiment_regime(s: Series, x: str, volume: str, n: int) -> str:
    """-2 to 2: direction by the sentiment's z-score, doubled where volume is high as well."""
    a, b = zscore(s, x, n, n), zscore(s, volume, n, n)
    return s.let(
        f"CASE WHEN {a} > 1 AND {b} > 1 THEN 2e0 WHEN {a} < -1 AND {b} > 1 THEN -2e0"
        f" WHEN {a} > 1 AND {b} <= 1 THEN 1e0 WHEN {a} < -1 AND {b} <= 1 THEN -1e0 ELSE 0e0 END"
    )


def news_momentum(s: Series, count: str, x: str, n: int) -> str:
    return s.let(f"{diff(s, x, n)} * {count} / ({mean(s, count, 2 * n)} + {EPS})")


def divergence(s: Series, sources: list[str], n: int) -> str:
    """1 less the mean correlation of all pairs of sources."""
    pairs = [(a, b) for i, a in enumerate(sources) for b in sources[i + 1 :]]
    return s.let("1 - (" + " + ".join(correlation(s, a, b, n) for a, b in pairs) + f") / {len(pairs)}")


# two series


def correlation(s: Series, a: str, b: str, n: int, least: int | None = None) -> str:
    """Correlation of the paired values, null where one doesn't vary."""
    a, b, least = s.let(a), s.let(b), max(2, n // 2) if least is None else least
    x, y = (s.let(f"CASE WHEN {v} IS NOT NULL THEN {u} END") for u, v in ((a, b), (b, a)))
    spread = s.let(f"{std(s, x, n, least)} * {std(s, y, n, least)}")
    return s.let(f"CASE WHEN {spread} > 1e-15 THEN {s.roll2('covar_samp', x, y, n, least)} / {spread} END")


def fisher(s: Series, c: str) -> str:
    c = s.let(clip(c, "-0.9999e0", "0.9999e0"))
    return s.let(f"0.5e0 * ln((1 + {c}) / (1 - {c}))")


def corr_fisher(s: Series, a: str, b: str, n: int) -> str:
    return fisher(s, correlation(s, a, b, n))


def beta(s: Series, a: str, b: str, n: int) -> str:
    b = s.let(b)
    paired = s.let(f"CASE WHEN {s.let(a)} IS NOT NULL THEN {b} END")
    return s.let(f"{s.roll2('covar_samp', a, b, n, max(2, n // 2))} / ({s.roll('var_samp', paired, n, max(2, n // 2))} + {EPS})")


def hedged(s: Series, a: str, b: str, n: int) -> str:
    return s.let(f"{s.let(a)} - {beta(s, a, b, n)} * {s.let(b)}")


def corr_of_abs(s: Series, a: str, b: str, n: int) -> str:
    return correlation(s, f"abs({s.let(a)})", f"abs({s.let(b)})", n, n)


def partial_corr(s: Series, a: str, b: str, c: str, n: int, least: int = 20) -> str:
    """Correlation of a and b after removing their betas to c."""
    return correlation(s, hedged(s, a, c, n), hedged(s, b, c, n), n, least)


def lead_lag(s: Series, a: str, b: str, n: int, most: int) -> tuple[str, str]:
    """The correlation of a with b k rows before that is largest in size, and k; the first of equals.

    From the row on that has n + most rows before it.
    """
    by = {k: correlation(s, a, s.lag(b, k), n, 2) for k in range(-most, most + 1)}
    top = s.let(f"CASE WHEN {s.let(f'row_number() {s.row()}')} > {n + most} THEN greatest(" + ", ".join(f"abs({c})" for c in by.values()) + ") END")
    value = "CASE " + " ".join(f"WHEN abs({c}) = {top} THEN {c}" for c in by.values()) + " END"
    lag = "CASE " + " ".join(f"WHEN abs({c}) = {top} THEN {k}" for k, c in by.items()) + " END"
    return s.let(value), s.let(lag)


def coint_z(s: Series, a: str, b: str, n: int) -> str:
    """Residual of the rolling regression of a on b, in its own standard deviations, from the n-th row on; half the pairs suffice."""
    least = n // 2
    slope, const = s.roll2("regr_slope", a, b, n, least), s.roll2("regr_intercept", a, b, n, least)
    ssr = s.let(f"{s.roll2('regr_syy', a, b, n, least)} - power({slope}, 2) * {s.roll2('regr_sxx', a, b, n, least)}")
    sigma = root(f"{ssr} / {s.roll2('regr_count', a, b, n, least)}")
    return s.let(f"CASE WHEN {s.let(f'row_number() {s.row()}')} >= {n} THEN ({s.let(a)} - {const} - {slope} * {s.let(b)}) / ({s.let(sigma)} + {EPS}) END")


# exponential smoothing


def ewma(s: Series, x: str, halflife: float | None = None, span: float | None = None, least: int = 1) -> str:
    """Weighted mean with weights that halve every ``halflife`` rows, normalised by those present.

    Sums of scaled values.  Weights grow by 1/decay a row, so a series may hold about 2,000
    halflives; beyond that restart it in blocks.
    """
    x = s.let(x)
    decay = 2 ** (-1 / halflife) if halflife else 1 - 2 / (span + 1)
    weight = s.let(f"power({num(1 / decay)}, row_number() {s.row()} - {CENTRE})")
    w = s.frame(None)
    top, bottom = s.let(f"sum({x} * {weight}) {w}"), s.let(f"sum(CASE WHEN {x} IS NOT NULL THEN {weight} END) {w}")
    return s.let(f"CASE WHEN count({x}) {w} >= {least} THEN {top} / {bottom} END")


def ewma_recursive(s: Series, x: str, halflife: float, least: int = 1) -> str:
    """y = (1 - a) y + a x over the values present, from the first value."""
    x = s.let(x)
    decay = 2 ** (-1 / halflife)
    k = s.let(f"count({x}) {s.frame(None)}")
    term = s.let(f"CASE WHEN {k} <= 1 THEN 1e0 ELSE {num(1 - decay)} END * {x} * power({num(1 / decay)}, {k})")
    total = s.let(f"sum({term}) {s.frame(None)}")
    return s.let(f"CASE WHEN {k} >= {least} THEN power({num(decay)}, {k}) * {total} END")


def ewma_corr(s: Series, a: str, b: str, halflife: float) -> str:
    """Correlation of two series with exponential means."""
    a, b = s.let(a), s.let(b)
    ma, mb = ewma(s, a, halflife), ewma(s, b, halflife)
    da, db = s.let(f"{a} - {ma}"), s.let(f"{b} - {mb}")
    cov = ewma(s, f"{da} * {db}", halflife)
    va, vb = ewma(s, f"{da} * {da}", halflife), ewma(s, f"{db} * {db}", halflife)
    return s.let(f"{cov} / sqrt({va} * {vb} + {EPS})")


def dcc(s: Series, a: str, b: str, halflife: float, n: int = 63) -> str:
    """Exponential correlation of two standardised series."""
    x, y = zscore(s, a, n, n), zscore(s, b, n, n)
    q = ewma(s, f"{x} * {y}", halflife)
    return s.let(f"{q} / sqrt({ewma(s, f'{x} * {x}', halflife)} * {ewma(s, f'{y} * {y}', halflife)} + {EPS})")


def weighted_ewma(s: Series, x: str, weight: str, halflife: float) -> str:
    """Exponential mean, of two values or more, of values scaled by their weight's share of its largest in five rows; weights below 0 are 0."""
    w = s.let(f"CASE WHEN {weight} < 0 THEN 0e0 ELSE {weight} END")
    return ewma(s, f"{s.let(x)} * {w} / ({s.roll('max', w, 5)} + {EPS})", halflife, least=2)


def order_flow(s: Series, buy: str, sell: str, span: int) -> str:
    return ewma(s, f"({buy} - {sell}) / ({buy} + {sell} + {EPS})", span=span)


# boolean series


def within(s: Series, test: str, n: int = 5) -> str:
    return s.roll("max", flag(test), n, 1)


def hysteresis(s: Series, x: str, enter: float, leave: float, dwell: int, cooldown: int, upper: bool = True) -> str:
    """Latched flag: on beyond ``enter``, off back beyond ``leave``.

    Runs shorter than ``dwell`` go; the ``cooldown`` rows after each remaining run's end are off.
    """
    x = s.let(x)
    on, off = (">", "<") if upper else ("<", ">")
    mark = s.let(f"CASE WHEN {x} {off} {num(leave)} THEN 0 WHEN {x} {on} {num(enter)} THEN 1 END")
    state = s.let(f"coalesce({s.filled(mark)}, 0)")
    turn = s.let(f"CASE WHEN {state} = coalesce({s.lag(state)}, -1) THEN 0 ELSE 1 END")
    island = s.let(f"sum({turn}) {s.frame(None)}")
    part = ", ".join([*s.by, island])
    size = s.let(f"count(*) OVER (PARTITION BY {part})")
    kept = s.let(f"CASE WHEN {state} = 1 AND {size} >= {dwell} THEN 1 ELSE 0 END")
    end = s.let(f"CASE WHEN {kept} = 1 AND coalesce({s.lag(kept, -1)}, 0) = 0 THEN 1 ELSE 0 END")
    if cooldown:
        quiet = s.let(f"coalesce(max({end}) {s.frame(-cooldown, -1)}, 0)")
        return s.let(f"CASE WHEN {kept} = 1 AND {quiet} = 0 THEN 1 ELSE 0 END")
    return kept

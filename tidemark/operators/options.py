"""Option pricing and the trade simulator.

Prices are column expressions; the normal distribution is a rational
approximation, good to about 1e-7 of a price's spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ledger import normal_cdf

SHORTEST, FLATTEST = 1e-6, 1e-9


def _d1(s: Column, k: Column, t: Column, r: Column, v: Column) -> Column:
    return (F.log(s / k) + (r + v * v / 2) * t) / (v * F.sqrt(t))


def _sane(t: Column, v: Column) -> tuple[Column, Column]:
    return F.greatest(t, F.lit(SHORTEST)), F.greatest(v, F.lit(FLATTEST))


def price(s: Column, k: Column, t: Column, r: Column, v: Column, call: Column) -> Column:
    """Black-Scholes price of a call or put; t in years."""
    t, v = _sane(t, v)
    d1 = _d1(s, k, t, r, v)
    d2, paid = d1 - v * F.sqrt(t), k * F.exp(-r * t)
    c = s * normal_cdf(d1) - paid * normal_cdf(d2)
    return F.when(call, c).otherwise(c - s + paid)


def delta(s: Column, k: Column, t: Column, r: Column, v: Column, call: Column) -> Column:
    t, v = _sane(t, v)
    d = normal_cdf(_d1(s, k, t, r, v))
    return F.when(call, d).otherwise(d - 1)


# Coefficients of a rational approximation of the normal quantile, good to 1.2e-9 of its size.
QUANTILE_TAIL = 0.02425
QUANTILE_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
QUANTILE_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
QUANTILE_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
QUANTILE_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile; null outside of 0 to 1."""
    q = p - 0.5
    u = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    middle = q * _polynomial(q * q, QUANTILE_A) / _polynomial(q * q, QUANTILE_B)
    tail = _polynomial(u, QUANTILE_C) / _polynomial(u, QUANTILE_D)
    return F.when(
        (p > 0) & (p < 1), F.when(p < QUANTILE_TAIL, tail).when(p > 1 - QUANTILE_TAIL, -tail).otherwise(middle)
    )


def strike_for_delta(s: Column, target: Column, t: Column, r: Column, v: Column, call: Column) -> Column:
    """Strike whose delta is the target, between a fifth and five times the spot: the pricing formula solved for the strike."""
    t, v = _sane(t, v)
    d1 = normal_quantile(F.when(call, target).otherwise(target + 1))
    return F.least(F.greatest(s * F.exp((r + v * v / 2) * t - v * F.sqrt(t) * d1), s * 0.2), s * 5.0)


def clean_iv(iv: Column) -> Column:
    """Volatility as a decimal between 0.0002 and 5; values above 2 are percent, others than positive null."""
    unit = F.when(iv > 2, iv / 100).otherwise(iv)
    return F.when(iv > 0, F.least(F.greatest(unit, F.lit(2e-4)), F.lit(5.0)))


def tenor_sigma(sigma: Column, days: Column, realized: Column, reference: int | Column = 63) -> Column:
    """Volatility for a tenor: the anchor scaled by a power of time, with a share of the realised one."""
    anchored = sigma * F.pow(days / reference, F.lit(-0.15))
    mixed = F.when(realized.isNotNull(), 0.7 * anchored + 0.3 * realized).otherwise(anchored)
    return F.least(F.greatest(mixed, F.lit(2e-4)), F.lit(5.0))


def strike_step(s: Column) -> Column:
    """Distance of listed strikes by price."""
    return F.when(s < 25, 0.5).when(s < 50, 1.0).when(s < 200, 2.5).when(s < 500, 5.0).otherwise(10.0)


def listed_strike(k: Column, s: Column) -> Column:
    """Nearest listed strike, halves to even, within half of the spot on either side."""
    step = strike_step(s)
    return F.least(F.greatest(F.bround(k / step) * step, s * 0.5), s * 1.5)


def expiry_days(horizon: Column) -> Column:
    """Days to expiry: the horizon and a margin, on weekly, monthly or quarterly dates."""
    d = horizon + F.greatest(F.lit(5), F.floor(horizon / 4))
    weekly = F.floor((d + 3) / 7) * 7
    monthly = F.when(d < 32, 21).when(d < 53, 42).otherwise(63)
    return F.when(d <= 10, weekly).when(d <= 45, monthly).when(d <= 63, 63).when(d <= 126, 126).otherwise(189).cast("int")


def tenor_of(horizon: Column, grid: tuple[int, ...] = (63,)) -> Column:
    """First tenor of the grid at or beyond 1.25 horizons, else the last."""
    want, out = F.round(horizon * 1.25), F.lit(grid[-1])
    for g in reversed(grid):
        out = F.when(want <= g, g).otherwise(out)
    return out


def market_vol(bars: DataFrame, px: str, name: str, by: str = "ticker", order: str = "date", n: int = 20) -> DataFrame:
    """Adds ``name``: annual volatility of the last n logarithmic changes, from the (n + 2)-th price on; null if it is 0."""
    w = Window.partitionBy(by).orderBy(order)
    rows = bars.withColumn("_change", F.log(F.col(px) / F.lag(px).over(w)))
    sd = F.stddev_samp("_change").over(w.rowsBetween(1 - n, 0))
    return rows.withColumn(name, F.when((F.count(px).over(w) >= n + 2) & (sd > 0), sd * F.sqrt(F.lit(252.0)))).drop("_change")


def slippage(tenor: Column, days_15: float = 0.0, days_30: float = 0.0, days_any: float = 0.0) -> Column:
    """Slippage by the tenor's tier."""
    return F.when(tenor <= 15, days_15).when(tenor <= 30, days_30).otherwise(days_any)


def policy_id(enabled: Column, mode: str, horizon: Column) -> Column:
    name = "moonshot" if mode == "moonshot" else "regime_aware"
    return F.when(enabled, F.concat(F.lit(f"{name}_h"), horizon.cast("string"))).otherwise("disabled")


def risk_free(quotes: list[Column], constant: float = 0.0) -> Column:
    """The first known yield, a percentage if above 1, else the constant."""
    first = F.coalesce(*quotes) if quotes else F.lit(None).cast("double")
    return F.coalesce(F.when(first > 1, first / 100).otherwise(first), F.lit(constant))


def missing_quotes(columns: list[str]) -> Column:
    """Names of the volatility columns without a value."""
    return F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)))


def anchor(kind: str, call: Column, three_months: tuple[str, str], thirty_days: tuple[str, str], smile: tuple[str, str], needed: list[str]) -> tuple[Column, Column, Column]:
    """(volatility, its reference days, whether it fell back): ``3M``, ``30D`` or ``1M`` quotes, the first where one of ``needed`` is missing."""
    side = lambda pair: clean_iv(F.when(call, F.col(pair[0])).otherwise(F.col(pair[1])))
    if kind == "3M":
        return side(three_months), F.lit(63), F.lit(False)
    back = F.size(missing_quotes(needed)) > 0
    own = side(thirty_days if kind == "30D" else smile)
    return F.when(back, side(three_months)).otherwise(own), F.when(back, 63).otherwise(21), back


def priced_leg(s0: Column, s1: Column, strike: Column, days: Column, held: Column, r: Column, call: Column, entry_iv: Column, exit_iv: Column) -> tuple[Column, Column]:
    """Prices of one option at entry and after ``held`` business days, a day of life left at least."""
    year = 252.0
    left = F.greatest(days - held, F.lit(1))
    enter, leave = price(s0, strike, days / year, r, entry_iv, call), price(s1, strike, left / year, r, exit_iv, call)
    return F.greatest(enter, F.lit(0.0)), F.greatest(leave, F.lit(0.0))


# Deltas of the named buckets; by direction, a call's and a put's.
BUCKETS = {"CALL_40D": 0.40, "CALL_25D": 0.25, "CALL_10D": 0.10, "PUT_40D": -0.40, "PUT_25D": -0.25, "PUT_10D": -0.10}
BY_DIRECTION = 0.40


def delta_target(bucket: Column, call: Column) -> Column:
    """Delta that a bucket asks for; null for at the money, and for names that aren't known."""
    out = F.when(bucket == "AUTO_BY_DIRECTION", F.when(call, BY_DIRECTION).otherwise(-BY_DIRECTION))
    for name, value in BUCKETS.items():
        out = out.when(bucket == name, value)
    return out


def enhanced_leg(
    rows: DataFrame, s0: str, s1: str, days: Column, held: Column, r: Column, call: Column, entry_anchor: Column, reference: Column, exit_anchor: Column,
    entry_realized: Column, exit_realized: Column, bucket: Column, strike: Column | None = None,
) -> DataFrame:
    """Rows with the fields of one option from entry to exit, from anchor volatilities of both days.

    The strike is the listed one at the money, or next to that of the bucket's delta, unless one is given.  Both
    volatilities are brought to their tenors by the entry's reference days; without an anchor at the exit the entry's
    serves, without one at the entry all is null.  A day of life is left at least.  Fields are made in stages, so that
    what many need is computed once.
    """
    year, a, z = 252.0, F.col(s0), F.col(s1)
    left = F.greatest(days - held, F.lit(1))
    known = entry_anchor.isNotNull()
    rows = rows.withColumns(
        {
            "sigma_entry": F.when(known, tenor_sigma(entry_anchor, days, entry_realized, reference)),
            "sigma_exit": F.when(known, tenor_sigma(F.coalesce(exit_anchor, entry_anchor), left, exit_realized, reference)),
            "delta_target": delta_target(bucket, call) if strike is None else F.lit(None).cast("double"), "t_exit": F.when(known, left / year),
        }
    )
    v, u, t = F.col("sigma_entry"), F.col("sigma_exit"), days / year
    target = F.col("delta_target")
    wanted = F.when(target.isNotNull(), strike_for_delta(a, target, t, r, v, call)).otherwise(a) if strike is None else strike
    rows = rows.withColumn("_wanted", wanted)
    rows = rows.withColumn("strike", F.when(v.isNotNull(), listed_strike(F.col("_wanted"), a))).drop("_wanted")
    k = F.col("strike")
    return rows.withColumns(
        {
            "k_over_s": k / a, "delta_achieved": delta(a, k, t, r, v, call),
            "entry_price": F.when(v.isNotNull(), F.greatest(price(a, k, t, r, v, call), F.lit(0.0))),
            "exit_price": F.when(v.isNotNull() & z.isNotNull(), F.greatest(price(z, k, F.col("t_exit"), r, u, call), F.lit(0.0))),
        }
    )


def structure_key(option_type: Column, horizon: Column, strike: Column, underlying: Column, delta_: Column, width: Column | None = None) -> Column:
    """Text that names a trade's option structure: type, tenor, strike relative to the spot, delta, width."""
    relative = F.when(underlying != 0, strike / underlying - 1)
    parts = [
        F.concat(F.lit("type="), F.lower(F.coalesce(option_type, F.lit("unknown")))),
        F.coalesce(F.format_string("tenor=%dd", horizon.cast("int")), F.lit("tenor=NA")) if horizon is not None else F.lit("tenor=NA"),
        F.when(relative.isNotNull(), F.format_string("strike_rel=%.4f", relative)).otherwise(F.concat(F.lit("strike="), F.coalesce(strike.cast("string"), F.lit("None")))),
        F.when(delta_.isNotNull(), F.format_string("delta=%.3f", delta_)).otherwise("delta=NA"),
    ]
    return F.concat_ws(";", *parts, *([F.when(width.isNotNull(), F.format_string("width=%.3f", width))] if width is not None else []))


def smile_iv(target: Column, d10: Column, d25: Column, d40: Column) -> Column:
    """Volatility at an absolute delta, linear between the 10, 25 and 40 delta quotes, flat beyond."""
    a = F.abs(target)
    inner = d10 + (d25 - d10) * (a - 0.10) / 0.15
    outer = d25 + (d40 - d25) * (a - 0.25) / 0.15
    return F.when(a <= 0.10, d10).when(a <= 0.25, inner).when(a <= 0.40, outer).otherwise(d40)


def paths(triggers: DataFrame, bars: DataFrame, days: int) -> DataFrame:
    """Each trigger with the bars of the next ``days`` positions: (trigger columns, step, px, iv).

    A trigger is spread over its positions and joined by equality, so no range join is planned.
    ``triggers``: ticker, pos; ``bars``: ticker, pos, px_last, iv.
    """
    steps = triggers.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(days))))
    at = bars.select("ticker", F.col("pos").alias("_p"), F.col("px_last").alias("px"), "iv")
    return steps.withColumn("_p", F.col("pos") + F.col("step")).join(at, ["ticker", "_p"]).drop("_p")


def simulate(triggers: DataFrame, bars: DataFrame, horizon: int, tenor: int = 63, capital: float = 1000.0) -> DataFrame:
    """Ledger of one option trade for each trigger: at the money, marked daily, closed by the first rule met.

    Rules of a day in order: profit of 150 %; stop at -80 %; at most a tenth of life left and 40 %
    profit; the horizon's end.  Without any bar of the path after entry the trade is open.
    """
    call, zero = F.lit(True), F.lit(0.0)
    entry = triggers.select("ticker", "pos", F.col("date").alias("trigger_date"))
    spot = bars.select("ticker", "pos", F.col("px_last").alias("s0"), clean_iv(F.col("iv")).alias("v0"))
    entry = entry.join(spot, ["ticker", "pos"]).withColumn("strike", listed_strike(F.col("s0"), F.col("s0")))
    marks = paths(entry, bars, horizon)
    t = (F.lit(tenor) - F.col("step")) / 252.0
    marks = marks.withColumn("mark", price(F.col("px"), F.col("strike"), t, zero, clean_iv(F.col("iv")), call))
    key = ["ticker", "pos"]
    first = F.first("mark").over(Window.partitionBy(*key).orderBy("step"))
    marks = marks.withColumn("gain", F.col("mark") / first - 1).withColumn("entry_price", first)
    life = 1 - F.col("step") / tenor
    rule = (
        F.when(F.col("gain") >= 1.5, "profit_target")
        .when(F.col("gain") <= -0.8, "stop_loss")
        .when((life <= 0.1) & (F.col("gain") >= 0.4), "near_expiry")
        .when(F.col("step") == horizon, "max_horizon")
    )
    hits = marks.where("step > 0").withColumn("rule", rule)
    exits = hits.where("rule is not null").groupBy(*key).agg(F.min(F.struct("step", "rule", "mark", "gain")).alias("x"))
    opened = marks.where("step = 0").select(*key, "trigger_date", "s0", "strike", "entry_price")
    lots = F.floor(capital / F.greatest(F.col("entry_price"), F.lit(1e-9)))
    return opened.join(exits, key, "left").select(
        *key, "trigger_date", "s0", "strike", "entry_price", F.col("x.step").alias("exit_step"), F.col("x.rule").alias("exit_reason"),
        F.col("x.mark").alias("exit_price"), F.col("x.gain").alias("pnl_pct"), lots.alias("contracts"),
        ((F.col("x.mark") - F.col("entry_price")) * lots).alias("pnl_dollars"),
    )

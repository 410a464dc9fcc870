"""Purged paths, forecasts out of fold, exit rules, fold regimes and signal bitmaps against plain loops."""

from __future__ import annotations

import datetime as dt
import math
import random
from itertools import combinations

import numpy as np
import pytest
from conftest import rows as plain
from pyspark.sql import functions as F

from tidemark.operators import bitmaps, cpcv, exits, mixtures, objectives, regimes, validation

DAY0 = dt.date(2020, 1, 6)


def day(k):
    return DAY0 + dt.timedelta(days=k)


# purged paths


def ledger(seed=1, n=400, setups=3, span=300):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = rng.randrange(span)
        pnl = round(rng.uniform(-1, 1), 2)
        out.append((rng.randrange(setups), day(a), None if rng.random() < 0.1 else day(a + rng.choice([0, 3, 20, 60])), None if rng.random() < 0.05 else pnl, pnl * 100))
    return out


SCHEMA = "setup_id long, trigger_date date, exit_date date, pnl_pct double, pnl_dollars double"


@pytest.mark.parametrize("plan", [cpcv.Plan(), cpcv.Plan(5, 1, 0), cpcv.Plan(7, 3, 25)])
def test_purged_learning(spark, plan):
    made = ledger() + [(9, day(5), day(290), 0.5, 50.0), (None, day(5), day(6), 0.5, 50.0)]
    df = spark.createDataFrame(made, SCHEMA)
    bounds = cpcv.block_bounds(spark.createDataFrame([(day(k),) for k in range(300)], "date date"), plan)
    assert [(b - a).days for a, b in bounds].count(0) == 0 and bounds[0][0] == day(0) and bounds[-1][1] == day(299)
    rows = cpcv.labelled(df, bounds, plan)
    fits = {(r.setup_id, r.subset): r for r in cpcv.learnt(rows, spark, plan).collect()}
    known = [(s, a, max(a, z), p, next(k for k, (x, y) in enumerate(bounds) if x <= a <= y)) for s, a, z, p, _ in made if None not in (s, z, p)]
    lonely = 0
    for s in {k[0] for k in known}:
        reach = [max([b, *(z for t, _, z, _, at in known if t == s and at == k)]) + dt.timedelta(days=plan.embargo) for k, (_, b) in enumerate(bounds)]
        for number, held in enumerate(combinations(range(plan.blocks), plan.held)):
            test = [p for t, _, _, p, at in known if t == s and at in held]
            train = [p for t, a, z, p, at in known if t == s and at not in held and not any(a <= reach[h] and z >= bounds[h][0] for h in held)]
            got = fits[s, number]
            assert (got.n_train, got.n_test) == (len(train), len(test))
            mean = sum(train) / len(train) if train else None
            lonely += not train
            assert got.direction == (0 if mean is None else 1 if mean >= -1e-9 else -1)
            if len(train) > 1 and np.std(train) > 1e-6:
                assert got.sharpe_in == pytest.approx(mean / np.std(train, ddof=1))
    assert lonely  # a setup that can't be learnt beside its only trade stands aside
    overlaps = [r for r in rows.collect() for k, (a, b) in enumerate(bounds) if k != r.block and not r.near >> k & 1 and r.trigger_date <= b and r.exit_date >= a]
    assert not overlaps


def test_paths_cover_the_calendar(spark):
    plan = cpcv.Plan(6, 2, 5)
    per_path = {}
    for path, block, subset in plan.paths:
        assert block in plan.subsets[subset]
        per_path.setdefault(path, []).append(block)
    assert sorted(per_path) == list(range(math.comb(5, 1))) and all(sorted(b) == list(range(6)) for b in per_path.values())
    assert len({(b, s) for _, b, s in plan.paths}) == len(plan.paths) == 6 * 5
    df = spark.createDataFrame(ledger(3), SCHEMA)
    bounds = cpcv.block_bounds(df.select(F.col("trigger_date").alias("date")).distinct(), plan)
    rows = cpcv.labelled(df, bounds, plan)
    fits = cpcv.learnt(rows, spark, plan)
    sides = {(r.setup_id, r.subset): r.direction for r in fits.collect()}
    total = {}
    for r in rows.collect():
        for path, block, subset in plan.paths:
            if block == r.block and sides[r.setup_id, subset]:
                days = total.setdefault((r.setup_id, path), {})
                days[r.trigger_date] = days.get(r.trigger_date, 0) + sides[r.setup_id, subset] * r.pnl_dollars / 100_000
    got = {(r.setup_id, r.path): r for r in cpcv.path_metrics(cpcv.path_returns(rows, fits, spark, plan)).collect()}
    assert got.keys() == total.keys()
    for key, days in total.items():
        x = np.array(list(days.values()))
        sharpe = x.mean() / x.std(ddof=1) * math.sqrt(252)
        assert got[key].n_obs == len(x) and got[key].sharpe == pytest.approx(sharpe)
        assert got[key].dsr == pytest.approx(max(0, sharpe - 1 / math.sqrt(len(x) - 1)))
        assert got[key].cvar5 == pytest.approx(x[x <= np.quantile(x, 0.05)].mean())


def test_gates_of_the_third_stage(spark):
    path = "setup_id long, path int, n_obs long, support long, total_r double, sharpe double, dsr double, cvar5 double"
    good = [(1, k, 50, 40, 0.1, 1.0, 0.9, -0.01) for k in range(5)]
    bad = [(2, k, 50, 4, 0.1, float(k), 0.1, -0.5) for k in range(5)]
    regime = spark.createDataFrame([(1, "a", 0.5, 30, 0.2), (1, "b", 0.5, 30, 0.3), (2, "a", 0.9, 30, 0.2), (2, "b", 0.1, 3, 1.9)], "setup_id long, ticker string, coverage double, support long, sharpe double")
    one = spark.createDataFrame([(0.1, 0.9)], "pbo double, spearman double")
    got = {r.setup_id: r for r in cpcv.robustness(spark.createDataFrame(good + bad, path), regime, one).collect()}
    assert got[1].pass_stage3 and got[1].reason == "ok" and got[1].reject_code is None
    assert got[2].reject_code == "S3_MEDIAN_DSR_LOW" and not got[2].pass_stage3
    assert got[2].reason == "S3_MEDIAN_DSR_LOW;S3_IQR_HIGH;S3_CVAR_TAIL;S3_SUPPORT_RATE_LOW;S3_REGIME_MONO;S3_FRAGILITY_HIGH"
    blank = cpcv.robustness(spark.createDataFrame(good, path), regime, spark.createDataFrame([(None, None)], "pbo double, spearman double")).first()
    assert blank.reason == "S3_PBO_HIGH;S3_SPEARMAN_LOW"
    with pytest.raises(ValueError):
        cpcv.Plan(4, 4)


def test_overfitting_of_known_ranks(spark):
    fits = [(s, 0, float(s), float(s)) for s in range(10)] + [(s, 1, float(s), float(-s)) for s in range(10)]
    got = cpcv.overfitting(spark.createDataFrame(fits, "setup_id long, subset int, sharpe_in double, sharpe_out double")).first()
    assert (got.pbo, got.spearman) == (0.5, pytest.approx(0.0, abs=1e-12))


# forecasts out of fold


EDGES = (-0.5, -0.1, 0.0, 0.1, 0.5)


def test_forecasts_of_all_folds(spark):
    rng = random.Random(4)
    folds = [validation.FoldSpan(k, 20 + 10 * k, 24 + 10 * k, 40 + 10 * k) for k in range(6)] + [validation.FoldSpan(9, 20, 60, 70)]
    data = [(s, p, h, None if rng.random() < 0.1 else rng.uniform(-0.7, 0.7)) for s in "ab" for h in (1, 7) for p in range(95) if rng.random() < (0.8 if s == "a" else 0.1)]
    df = spark.createDataFrame(data, "setup string, pos long, horizon int, fwd double")
    fits = {(r.setup, r.horizon, r.fold): r for r in validation.forecasts(df, folds, ["setup"], EDGES).collect()}
    tested = validation.tested(df, folds, spark).collect()
    for s in "ab":
        for h in (1, 7):
            for f in folds:
                x = [v for t, p, k, v in data if (t, k) == (s, h) and v is not None and p + h <= f.train_end]
                if not x:
                    assert (s, h, f.number) not in fits
                    continue
                got = fits[s, h, f.number]
                counts = np.histogram(x, EDGES)[0]
                probs = counts / (counts.sum() + 1e-9) + 1e-6
                assert got.n_train == len(x) and np.allclose(got.probs, probs / probs.sum())
                want = sorted(p for t, p, k, v in data if (t, k) == (s, h) and v is not None and p >= f.test_start and p + h <= f.test_end)
                assert sorted(r.pos for r in tested if (r.setup, r.horizon, r.fold) == (s, h, f.number)) == want
    with pytest.raises(ValueError):
        validation.FoldSpan(0, 10, 10, 12)


def test_scores_of_one_fold(spark):
    rng = random.Random(5)
    fold = validation.FoldSpan(0, 60, 64, 99)
    data = [("a", "T", p, 2, rng.uniform(-0.45, 0.45)) for p in range(98)]
    df = spark.createDataFrame(data, "setup string, ticker string, pos long, horizon int, fwd double")
    market = df.drop("setup")
    got = validation.scored(df, market, [fold], ["setup", "ticker"], EDGES, spark).first()
    hist = lambda x: (lambda p: p / p.sum())(np.histogram(x, EDGES)[0] / (len(x) + 1e-9) + 1e-6)
    train, test = np.array([d[4] for d in data if d[2] + 2 <= 60]), np.array([d[4] for d in data if d[2] >= 64 and d[2] + 2 <= 99])
    grid = np.linspace(-0.5, 0.5, 200_001)

    def crps(p, y):
        cdf = np.interp(grid, EDGES, np.r_[0, np.cumsum(p)])
        return np.trapezoid((cdf - (grid >= y)) ** 2, grid)

    p = hist(train)
    own = np.mean([crps(p, y) for y in test])
    assert (got.n_train, got.n_test) == (len(train), len(test)) and got.crps == pytest.approx(own, abs=1e-4)
    assert got.skill_vs_uniform == pytest.approx(np.mean([crps(np.full(4, 0.25), y) for y in test]) - own, abs=1e-4)
    assert got.skill_vs_marginal == pytest.approx(np.mean([crps(hist(test), y) for y in test]) - own, abs=1e-4)
    seen = np.histogram(test, EDGES)[0]
    raised = (seen + 1) / (seen.sum() + 4)
    assert got.calibration_mae == pytest.approx(np.abs(p - seen / seen.sum()).mean())
    assert got.info_gain == pytest.approx((raised * np.log2(raised / p)).sum())
    assert validation.scored(df.limit(5), market, [fold], ["setup", "ticker"], EDGES, spark).count() == 0


def test_outcomes_by_calendar(spark):
    """A horizon counts calendar days, on which a ticker may lack a bar."""
    bars = spark.createDataFrame([("A", day(k), 10.0 + k) for k in (0, 1, 2, 4)] + [("B", day(k), 20.0 + k) for k in range(5)], "ticker string, date date, px_last double")
    got = {(r.ticker, r.pos): r.fwd for r in validation.outcomes(bars, bars.select("date").distinct(), [2]).collect()}
    assert got["A", 0] == pytest.approx(12 / 10 - 1) and got["A", 1] is None and got["A", 2] == pytest.approx(14 / 12 - 1) and got["A", 4] is None and ("A", 3) not in got
    assert got["B", 1] == pytest.approx(23 / 21 - 1)


# exits


def loop_exit(path, entry, horizon, expiry, tenor, p):
    n = len(path)
    if not p.enabled:
        return (n - 1, "option_expired") if path[-1][0] >= expiry else None
    x = [math.nan if v is None else v for _, v in path]
    for i, (d, _) in enumerate(path):
        gain = (x[i] - entry) / entry if entry > 0 else (0.0 if not math.isnan(x[i]) else math.nan)
        if p.target is not None and gain >= p.target:
            return i, "pt_hit_legA"
        if i >= 2:
            with np.errstate(all="ignore"):
                a = np.array(x[i - 2 : i + 1])
                jump = np.std(np.diff(a) / a[:-1])
            if gain >= p.spike_profit and jump > p.spike:
                return i, "volatility_spike_profit"
        if (expiry - d).days / tenor <= p.expiry_life and gain >= p.expiry_profit:
            return i, "time_decay_protection"
        if gain <= p.stop:
            return i, "stop_loss"
        if i >= 5 and gain >= p.trail_profit:
            a = np.array(x[i - 4 : i + 1])
            if x[i] <= a.max() - (a.max() - a.min()) / 5 * p.trail_ranges:
                return i, "atr_trail_hit"
        if d >= expiry:
            return i, "option_expired"
    return min(n - 1, max(0, horizon - 1)) if horizon > 0 else n - 1, "max_horizon_exit"


def test_exits_of_random_paths(spark):
    rng = random.Random(7)
    paths, rows = {}, []
    for k in range(1000):
        n, tenor, horizon = rng.randint(1, 40), rng.choice([5, 15, 60]), rng.choice([-1, 0, 1, 10, 30])
        price, path = rng.choice([0.0, 1.0, 5.0]), []
        for step in range(n):
            path.append((day(k % 7 + step), None if step and rng.random() < 0.05 else price))
            price = max(0.0, price * math.exp(rng.gauss(0.03, rng.choice([0.05, 0.4])))) if rng.random() > 0.01 else 0.0
        expiry, left = day(k % 7), tenor
        while left:
            expiry += dt.timedelta(days=1)
            left -= expiry.weekday() < 5
        paths[k] = (path, path[0][1], horizon, expiry, tenor)
        rows += [(k, step, d, v, tenor, horizon) for step, (d, v) in enumerate(path)]
    rng.shuffle(rows)
    marks = spark.createDataFrame(rows, "id long, step int, day date, price double, tenor int, horizon int")
    policies = {"a": exits.REGIME_AWARE, "b": exits.MOONSHOT, "c": exits.DISABLED}
    reasons = set()
    for r in exits.closed(marks, ["id"], policies).collect():
        want = loop_exit(*paths[r.id], policies[r.policy])
        assert (r.exit_step, r.exit_reason) == (want or (None, None)), (r.id, r.policy)
        reasons.add(r.exit_reason)
        if want:
            assert (r.exit_date, r.exit_price) == paths[r.id][0][want[0]]
    assert len(reasons) == 8


# regimes


def test_mixture_by_its_definition():
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal([0, 0], 0.3, (150, 2)), rng.normal([3, 1], 0.5, (150, 2)), rng.normal([6, -2], 0.4, (150, 2))]
    m = mixtures.best_mixture(x, 2, 5)
    assert m["k"] == 3 and m["weight"].sum() == pytest.approx(1)
    z = (x - m["shift"]) / m["scale"]
    one = [[np.log(w) - 0.5 * ((r - mu) @ np.linalg.inv(c) @ (r - mu)) - 0.5 * np.log(np.linalg.det(2 * np.pi * c)) for w, mu, c in zip(m["weight"], m["mean"], m["cov"])] for r in z[:20]]
    assert np.allclose(mixtures.log_densities(z[:20], m["weight"], m["mean"], m["cov"]), one)
    label = mixtures.log_densities(z, m["weight"], m["mean"], m["cov"]).argmax(axis=1)
    assert all(len(set(label[a : a + 150])) == 1 for a in (0, 150, 300))
    assert mixtures.best_mixture(x[:15], 2, 5) is None and mixtures.best_mixture(np.ones((99, 2)), 2, 5) is None


def test_labels_stay_where_components_change_places(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ([0, 0], [4, 1], [8, -2])])
    x = x[rng.permutation(len(x))]
    rows = spark.createDataFrame([("T", k, *map(float, v)) for k, v in enumerate(x)] + [("T", 180, None, 1.0)], "ticker string, pos long, a double, b double")
    fits = mixtures.fit(rows, {0: 89, 1: 134, 2: 179}, ["ticker"], ["a", "b"], components=(3, 3))
    turned = fits.withColumn("state", (F.col("state") + F.col("fold")) % 3)
    plainly, permuted = (mixtures.assign(rows, mixtures.aligned(f, ["ticker"]), ["ticker"], ["a", "b"]).collect() for f in (fits, turned))
    key = lambda r: (r.fold, r.pos)
    first = {key(r): r.regime for r in plainly}
    assert first == {key(r): r.regime for r in permuted}
    assert all(first[f, p] == first[0, p] for f in (1, 2) for p in range(180)) and set(first.values()) == {0, 1, 2}
    assert first[0, 180] == first[0, 179]  # a day without features takes the last label
    p = {r.state: r for r in fits.where("fold = 1").collect()}
    z = (x - np.array(p[0].shift)) / np.array(p[0].scale)
    log = np.stack([np.log(p[s].weight) - 0.5 * (np.einsum("ni,ij,nj->n", z - p[s]["mean"], np.array(p[s].precision).reshape(2, 2), z - p[s]["mean"]) + p[s].logdet) for s in range(3)])
    means = {f: np.stack([r["mean"] for r in fits.where(f"fold = {f}").orderBy("state").collect()]) for f in (0, 1)}
    names = regimes.matched(means[0], means[1])
    assert [names[s] for s in log.argmax(axis=0)] == [first[1, k] for k in range(180)]


def test_features_and_windows(spark):
    rng = np.random.default_rng(2)
    price = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 60)))
    rows = spark.createDataFrame([("T", k, float(v)) for k, v in enumerate(price)], "ticker string, pos long, px double")
    got = mixtures.features(rows, ["ticker"], "pos", "px", 20, 10).orderBy("pos").collect()
    change = price[1:] / price[:-1] - 1
    assert got[19].volatility is None and got[20].volatility == pytest.approx(change[:20].std(ddof=1))
    assert got[9].trend is None and got[10].trend == pytest.approx(change[:10].mean())
    labels = spark.createDataFrame([("T", 0, k, r) for k, r in enumerate([1, 1, 2, 2, 2, 0, 0, 1])], "ticker string, fold int, pos long, regime int")
    spans = spark.createDataFrame([(0, 3, 5, 7)], "fold int, train_end long, test_start long, test_end long")
    assert plain(mixtures.window_regimes(labels, spans, ["ticker"])) == [(0, 0, 1, 0.5, "T")]


# bitmaps


def test_information_of_setups(spark):
    rng = random.Random(9)
    days, fired = 150, {}
    for s in "abcd":
        fired[s] = {k for k in range(days) if rng.random() < 0.3}
    fired["b"] |= set(list(fired["a"])[:30])
    fired["all"], fired["none"] = set(range(days)), set()
    rows = [(s, k) for s, ks in fired.items() for k in ks for _ in range(1 + (k % 5 == 0))]
    setups = [(1, ["a", "b"]), (2, ["a", "b", "c", "d"]), (3, ["a"]), (4, []), (5, ["all", "none", "a"]), (6, ["a", "a"]), (7, None)]
    got = bitmaps.mean_information(spark.createDataFrame(setups, "id long, signals array<string>"), spark.createDataFrame(rows, "signal string, pos long"), days, ["id"])

    def mi(a, b):
        total = 0.0
        for x in (0, 1):
            for y in (0, 1):
                hits = [((k in fired[a]) == x, (k in fired[b]) == y) for k in range(days)]
                pxy, px, py = (sum(f(h) for h in hits) / days for f in (all, lambda h: h[0], lambda h: h[1]))
                total += pxy * math.log(pxy / (px * py)) if pxy else 0.0
        return total

    want = {i: [mi(a, b) for a, b in combinations(s or [], 2)] for i, s in setups}
    assert {r.id: (r.pairs, pytest.approx(r.mean_mi, abs=1e-12)) for r in got.collect()} == {i: (len(v), sum(v) / len(v)) for i, v in want.items() if v}


# objectives


def test_objective_registry():
    names = ["crps", "brier_score", "pinball_q10", "info_gain", "skill_vs_marginal"]
    got, labels = objectives.values({"crps": 0.1, "brier_score": 0.2, "pinball_q10": 0.05, "info_gain": 0.5, "skill_vs_marginal": 0.02}, names)
    assert got == [-0.1, -0.2, -0.05, 0.5, 0.02] and [labels[n] for n in names] == ["negate"] * 3 + ["identity"] * 2
    assert objectives.values({"coverage_80": 0.7}, ["coverage_80"])[0] == [pytest.approx(-0.1)] and "target" in objectives.label_of("coverage_95")
    for bad in (math.nan, math.inf):
        with pytest.raises(ValueError, match="non-finite"):
            objectives.values({"crps": bad}, ["crps"])
    with pytest.raises(KeyError, match="Unknown objective"):
        objectives.values({"crps": 0.1}, ["crps", "missing_metric"])
    assert "LEGACY" in objectives.values({"ig_sharpe": 2.0}, ["ig_sharpe"])[1]["ig_sharpe"]
    with pytest.raises(ValueError, match="Legacy P&L objective"):
        objectives.checked(["ig_sharpe"], allow_legacy=False)
    assert objectives.audit(["crps", "nothing"]) == (False, ["nothing"]) and objectives.audit(["crps", "info_gain"]) == (True, [])
    assert objectives.proper_only(["crps", "ig_sharpe", "calibration_mae"]) == ["crps"]
    assert all(n in objectives.PROPER for n in objectives.recommended("forecast")) and all(n in objectives.LEGACY for n in objectives.recommended("legacy"))
    with pytest.raises(ValueError, match="Unknown mode"):
        objectives.recommended("odd")
    assert all(objectives.label_of(n) == "negate" for n in objectives.PROPER)


def test_objectives_of_columns(spark):
    df = spark.createDataFrame([(1, 0.1, 0.85), (2, 0.3, 0.6)], "id int, crps double, coverage_80 double")
    assert plain(objectives.transformed(df, ["crps", "coverage_80"]).select("id", "objective_crps", "objective_coverage_80")) == [(1, -0.05, -0.1), (2, -0.2, -0.3)]
    for bad in (None, math.nan, math.inf):
        odd = df.unionByName(spark.createDataFrame([(3, bad, 0.8)], df.schema))
        with pytest.raises(Exception, match="non-finite"):
            objectives.transformed(odd, ["crps"]).collect()
    with pytest.raises(KeyError, match="Missing"):
        objectives.transformed(df, ["info_gain"])


@pytest.mark.parametrize("method", ["p75", "mean", "best"])
def test_folds_and_horizons(spark, method):
    rng = random.Random(6)
    edges = (-0.2, 0.0, 0.1, 0.4)
    rows = []
    for s in "abc":
        for h in ((1, 5, 21) if s != "c" else (5,)):
            for f in range(rng.randint(1, 4)):
                p = np.random.default_rng(rng.randint(0, 99)).dirichlet(np.ones(3))
                rows.append((s, h, f, rng.random(), rng.random(), p.tolist()))
    df = spark.createDataFrame(rows, "setup string, horizon int, fold int, crps double, info_gain double, probs array<double>")
    folds = objectives.over_folds(df, ["setup"], ["crps", "info_gain"], 3)
    got = {r.setup: r for r in objectives.over_horizons(folds, ["setup"], ["crps", "info_gain"], edges, objectives.Horizons(method)).collect()}
    for s in "abc":
        by = {}
        for t, h, _, c, g, p in rows:
            if t == s:
                by.setdefault(h, []).append((c, g, p))
        mid = {h: (np.median([x[0] for x in v]), np.median([x[1] for x in v]), (lambda m: m / (m.sum() + 1e-9))(np.median([x[2] for x in v], axis=0)), len(v)) for h, v in by.items()}
        best = min(mid, key=lambda h: (mid[h][0], h))
        crps, gain, used = ([m[k] for m in mid.values()] for k in (0, 1, 3))
        want = {
            "p75": (np.percentile(crps, 25), np.percentile(gain, 75), np.percentile(used, 75)), "mean": (np.mean(crps), np.mean(gain), np.mean(used)),
            "best": (mid[best][0], mid[best][1], mid[best][3]),
        }[method]
        probs = mid[best][2] if method == "best" else (lambda m: m / (m.sum() + 1e-9))(np.median([m[2] for m in mid.values()], axis=0))
        r = got[s]
        assert (r.horizons, r.best_horizon) == (len(mid), best) and (r.crps, r.info_gain, r.folds_used) == pytest.approx(want)
        assert r.probs == pytest.approx(probs.tolist()) and r.horizon_stability_mad == pytest.approx(np.median(np.abs(crps - np.median(crps))))
        assert r.expected_move == pytest.approx(float(probs @ [-0.1, 0.05, 0.25])) and r.p_up == pytest.approx(float(probs[1:].sum()))
    with pytest.raises(ValueError):
        objectives.Horizons("odd")

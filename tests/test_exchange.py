"""Streamed windows, diagram distances, regression by moments and islands against plain loops."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import gauntlet, islands, kernels, predictive, regression, slates, splits
from tidemark.operators.search import front_numbers

# streamed windows


def loop_huber(x, n, k=1.345):
    out = []
    for i in range(len(x)):
        w = np.array(x[max(0, i - n + 1) : i + 1], float)
        known = w[~np.isnan(w)]
        if i < n - 1 or len(known) < 3 or np.isnan(x[i]):
            out.append(None)
            continue
        mid = np.median(known)
        mad = np.median(np.abs(known - mid))
        if mad == 0:
            mean, sd = mid, np.std(known)
        else:
            u = np.abs(known - mid) / (k * mad + 1e-9)
            weight = np.where(u <= 1, 1.0, 1.0 / np.maximum(u, 1e-300))
            mean, sd = (weight * known).sum() / weight.sum(), 1.4826 * mad
        out.append((x[i] - mean) / sd if sd > 0 else None)
    return out


def test_streamed_huber_scores(spark):
    rng = random.Random(3)
    series = {}
    for g in range(12):
        n = [0, 1, 4, 5, 6, 30, 300][g % 7]
        kind = g % 3
        series[g if g else None] = [math.nan if rng.random() < 0.2 else 5.0 if kind == 1 and rng.random() < 0.9 else rng.gauss(0, 1) for _ in range(n)]
    series[50] = [2.0] * 20
    rows = [(g, k, None if math.isnan(v) else v) for g, xs in series.items() for k, v in enumerate(xs)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # windows reach over many batches
    try:
        got = kernels.streamed(spark.createDataFrame(rows, "g long, t long, x double"), ["g"], "t", "x", 5, {"z": kernels.huber_z}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(g, k): z for g, xs in series.items() for k, z in enumerate(loop_huber(xs, 5))}
    assert len(got) == len(want)
    for r in got:
        assert (r.z is None) == (want[r.g, r.t] is None) and (r.z is None or r.z == pytest.approx(want[r.g, r.t])), r


# diagrams


def brute_bottleneck(a, b):
    """Least largest cost over all matchings, points unmatched going to the diagonal."""
    best = math.inf
    for k in range(min(len(a), len(b)) + 1):
        for mine in itertools.combinations(range(len(a)), k):
            for theirs in itertools.permutations(range(len(b)), k):
                costs = [max(abs(a[i] - b[j])) for i, j in zip(mine, theirs)]
                costs += [(a[i][1] - a[i][0]) / 2 for i in range(len(a)) if i not in mine]
                costs += [(b[j][1] - b[j][0]) / 2 for j in range(len(b)) if j not in theirs]
                best = min(best, max(costs, default=0.0))
    return best


def test_bottleneck_against_all_matchings():
    rng = np.random.default_rng(4)
    for case in range(120):
        n, m = rng.integers(0, 6, 2)
        births = (lambda k: np.zeros(k)) if case % 2 else (lambda k: rng.integers(0, 3, k) / 2)
        a, b = (np.c_[x, x + rng.integers(0, 8, len(x)) / 2] for x in (births(n), births(m)))
        assert kernels.bottleneck(a, b) == pytest.approx(brute_bottleneck(a, b))
    assert kernels.bottleneck(np.zeros((0, 2)), np.zeros((0, 2))) == 0
    x = np.c_[np.zeros(300), rng.random(300)]
    assert kernels.bottleneck(x, x[rng.permutation(300)]) == 0
    assert kernels.bottleneck(x, x + [0, 0.01]) <= 0.01 + 1e-12


def test_diagrams_and_landscapes():
    d = kernels.h0_diagram(np.array([[0.0], [1.0], [3.0], [7.0]]))
    assert d.tolist() == [[0, 1], [0, 2], [0, 4], [0, 4]]
    assert kernels.h0_diagram(np.array([[5.0]])).tolist() == [[0, 0]] and kernels.h0_diagram(np.zeros((0, 1))).shape == (0, 2)
    v = kernels.h0_landscape(d, 4)
    assert v.tolist() == pytest.approx([0.25, 0.25, 0, 0.5])  # 1 and 2 fall just below the ends of their bins
    assert kernels.h0_landscape(np.zeros((0, 2)), 3).tolist() == [0, 0, 0]


# regression


def test_student_quantiles():
    known = {(0.975, 1): 12.7062047362, (0.975, 2): 4.3026527297, (0.95, 5): 2.0150483733, (0.975, 10): 2.2281388520, (0.995, 30): 2.7499956536, (0.025, 10): -2.2281388520, (0.5, 3): 0.0, (0.975, 10**6): 1.9599663977}
    for (p, df), t in known.items():
        assert regression.student_quantile(p, df) == pytest.approx(t, abs=1e-7)


def test_mean_predictions(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for g, n in enumerate([200, 40, 5, 4, 3, 2, 30]):
        x = rng.normal(100, 1, (n, 2)) if g != 6 else np.repeat(rng.normal(0, 1, (n, 1)), 2, axis=1)
        y = 3 + 2 * x[:, 0] - x[:, 1] + rng.normal(0, 0.5, n)
        rows += [(g, *map(float, r), float(v)) for r, v in zip(x, y)]
        if g < 5:
            full = np.c_[np.ones(n), x]
            w = np.linalg.lstsq(full, y, rcond=None)[0]
            at = np.array([1, 101.0, 99.0])
            df = n - 3
            se = math.sqrt(((y - full @ w) ** 2).sum() / df * at @ np.linalg.inv(full.T @ full) @ at) if df else None
            want[g] = (n, at @ w, se, df)
    rows += [(0, None, 1.0, 1.0), (0, 1.0, 1.0, None), (9, None, None, None)]
    got = {r.g: r for r in regression.mean_prediction(spark.createDataFrame(rows, "g int, a double, b double, y double").repartition(4), ["g"], "y", ["a", "b"], [101.0, 99.0]).collect()}
    for g, (n, guess, se, df) in want.items():
        assert got[g].n == n and got[g].y_hat == pytest.approx(guess, rel=1e-7)
        if se is None:
            assert got[g].se is None and got[g].lower is None
        else:
            t = regression.student_quantile(0.975, df)
            assert got[g].se == pytest.approx(se, rel=1e-5) and got[g].upper - got[g].lower == pytest.approx(2 * t * se, rel=1e-5)
    assert got[5].y_hat is None and got[6].y_hat is None and 9 not in got


# islands


def loop_exchange(people, size, n, topology, generation, seed):
    isles = {k: [p for p in people if p[0] == k] for k in range(n)}
    best = {k: sorted(v, key=lambda p: (-p[2], p[1]))[:size] for k, v in isles.items()}
    coming = {k: {} for k in range(n)}
    if topology == "all_to_all":
        pool = [(k, p) for k in range(n) for p in best[k]]
        share = len(pool) // n
        for k in range(n):
            for place, (source, p) in enumerate(pool[k * share : (k + 1) * share]):
                coming[k][place] = (source, p)
    else:
        for k in range(n):
            mixed = (k * 2654435761 + generation * 40503 + seed * 69069 + 12345) % (1 << 32)
            to = (k + 1) % n if topology == "ring" else (k + 1 + (mixed >> 16) % (n - 1)) % n
            for place, p in enumerate(best[k]):
                coming[to].setdefault(place, (k, p))
    out = []
    for k in range(n):
        for place, p in enumerate(sorted(isles[k], key=lambda p: (p[2], p[1]))):
            source, q = coming[k].get(place, (None, p))
            out.append((k, q[1], q[2], source))
    return sorted(out, key=repr)


@pytest.mark.parametrize("topology", islands.TOPOLOGIES)
@pytest.mark.parametrize("n, each", [(4, 12), (3, 2), (7, 5)])
def test_exchange(spark, topology, n, each):
    rng = random.Random(n)
    people = [(k, f"p{k}-{j}", float(rng.randint(0, 6))) for k in range(n) for j in range(each + (k == 1))]
    df = spark.createDataFrame(people, "island long, dna string, fitness double")
    targets = set()
    for generation in (0, 1, 5):
        made = islands.sent(islands.migrants(df, 3), n, topology, generation, 11)
        got = islands.received(df, made).select("island", "dna", "fitness", "came_from").collect()
        assert sorted(map(tuple, got), key=repr) == loop_exchange(people, 3, n, topology, generation, 11)
        moved = made.where("source = target").count()
        assert topology == "all_to_all" or not moved
        targets |= {tuple(sorted((r.source, r.target) for r in made.select("source", "target").distinct().collect()))}
    assert topology != "random" or n < 4 or len(targets) > 1


def test_odd_islands(spark):
    one = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0)], "island long, dna string, fitness double")
    for t in islands.TOPOLOGIES[:2]:
        assert islands.sent(islands.migrants(one, 1), 1, t).count() == 0
    with pytest.raises(ValueError):
        islands.sent(islands.migrants(one, 1), 2, "star")
    few = islands.sent(islands.migrants(one, 1), 4, "all_to_all")  # one migrant can't be shared among four
    assert few.count() == 0 and islands.received(one, few).count() == 2


def test_survivors(spark):
    rng = random.Random(2)
    people = [(f"d{k:03}", float(rng.randint(0, 12)), float(rng.randint(0, 12))) for k in range(90)]
    df = spark.createDataFrame(people + people[:10] + [("none", None, 1.0)], "dna string, a double, b double")
    got = islands.synchronized(df.withColumn("fitness", F.lit(1)), ["a", "b"], 25).collect()
    x = np.array([p[1:] for p in people])
    fronts = front_numbers(x)
    assert len(got) == len({r.dna for r in got}) == 25
    number = dict(zip((p[0] for p in people), fronts.tolist()))
    assert all(number[r.dna] == r.front for r in got)
    last = max(r.front for r in got)
    assert sum(f < last for f in fronts) == sum(r.front < last for r in got)
    assert islands.synchronized(df, ["a", "b"], 500).count() == 90
    assert islands.synchronized(df.where("false"), ["a", "b"], 5).count() == 0


# slates and books


def test_trade_ready_fields(spark):
    edges = (-999.0, -0.05, -0.03, 0.0, 0.02, 0.03, 0.05, 999.0)
    probs = [0.05, 0.1, 0.2, 0.25, 0.2, 0.15, 0.05]
    cross = (-0.02, 0.01, 0.04)
    df = spark.createDataFrame([(1, probs), (2, [0.5, 0.5]), (3, None)], "id int, probs array<double>")
    r, short, null = df.select("id", *(c.alias(n) for n, c in slates.trade_ready("probs", edges).items())).orderBy("id").collect()
    assert r.expected_move == pytest.approx(0.05 * -0.12 + 0.1 * -0.04 + 0.2 * -0.015 + 0.25 * 0.01 + 0.2 * 0.025 + 0.15 * 0.04 + 0.05 * 0.12)
    assert (r.p_up, r.p_down) == (pytest.approx(0.4), pytest.approx(0.15))  # bands that touch 0 are neither
    assert (r.p_3_to_5, r.p_above_5, r.p_minus_5_to_3, r.p_below_5) == pytest.approx((0.15, 0.05, 0.1, 0.05))
    assert short.p_up is None and null.expected_move is None
    split = df.where("id = 2").select(*(c.alias(n) for n, c in slates.trade_ready("probs", cross).items())).first()
    assert split.p_up == pytest.approx(0.5 / 3 + 0.5) and split.p_down == pytest.approx(0.5 * 2 / 3)


def test_slates(spark):
    rows = [("A", f"s{k}", float(k % 4), [0.5, 0.5]) for k in range(8)] + [("B", "x", None, None), ("C", "y", 9.0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "ticker string, setup string, score double, probs array<double>")
    got = [(r.ticker, r.setup) for r in slates.slate(df, "probs", (-1.0, 0.0, 1.0), "score", "setup", 3, 4).orderBy(F.col("score").desc_nulls_last(), "setup").collect()]
    assert got == [("C", "y"), ("A", "s3"), ("A", "s7"), ("A", "s2")]
    whole = slates.slate(df, "probs", (-1.0, 0.0, 1.0), "score", "setup", 0, 0)
    assert whole.count() == 10 and whole.where("ticker = 'B'").first().probs == [0.5, 0.5]


def test_open_book(spark):
    d = lambda k: dt.date(2024, 3, 1) + dt.timedelta(days=k)
    rows = [
        (1, d(0), d(0), None, "long", 10.0, 2.0, None, None), (2, d(0), d(1), d(40), "Short", 10.0, 3.0, 9.0, "target"), (3, d(0), d(1), d(5), "long", 10.0, 1.0, 12.0, "stop"),
        (4, d(-60), d(-60), None, "long", 10.0, 1.0, None, None), (5, None, None, None, None, None, None, None, None), (6, d(2), d(30), None, None, 10.0, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, trigger_date date, entry_date date, exit_date date, direction string, entry_price double, contracts double, exit_price double, exit_reason string").withColumn("mark", F.lit(13.0))
    got = {r.id: r for r in slates.open_at_end(df, d(20), d(25), 30, "mark").collect()}
    assert {k for k, r in got.items() if r.status == "OPEN"} == {1, 2, 6}
    assert (got[1].unrealized_pnl, got[2].unrealized_pnl, got[6].unrealized_pnl) == (6.0, -9.0, 0.0)
    assert (got[2].exit_date, got[2].exit_price, got[2].exit_reason, got[1].holding_days_open, got[6].holding_days_open) == (None, None, "EOD_OPEN", 20, 0)
    assert (got[3].exit_reason, got[3].exit_price, got[4].status, got[5].status) == ("stop", 12.0, None, None)
    assert slates.open_at_end(df, d(20), d(25)).where("unrealized_pnl is not null").count() == 0


def test_selection_reports(spark):
    rows = [("A", k, float(k), "idle", k == 5) for k in range(8)] + [("B", 1, 1.0, "live", False), ("B", 2, 5.0, "fatal", None)]
    df = spark.createDataFrame(rows, "ticker string, setup_id int, candidate_score double, status string, dup_suppressed boolean")
    df = df.withColumns({"triggered_any": F.col("setup_id") > 3, "soft_flags_present": F.lit(None).cast("boolean"), "used_bootstrap": F.col("setup_id") == 1})
    got = {r.ticker: r for r in slates.selection_summary(df, ["ticker"]).collect()}
    assert tuple(got["A"])[1:] == (8, 4, 0, 0, 1, 7, 0) and tuple(got["B"])[1:] == (2, 0, 1, 0, 1, 1, 1)
    assert slates.selection_summary(df.where("false")).first().n_checked == 0
    assert sorted((r.ticker, r.setup_id) for r in slates.near_misses(df, ["ticker"]).collect()) == [("A", k) for k in (2, 3, 4, 6, 7)]


def test_portfolio_stage(spark):
    rows = [(1, 0.5, 1.0, 0.1, 0.1), (2, 0.3, 0.0, 0.1, 0.1), (3, 0.5, None, 0.9, 0.9), (4, None, None, None, None)]
    got = {r.setup_id: r for r in gauntlet.portfolio(spark.createDataFrame(rows, "setup_id int, dsr double, capacity double, mean_abs_corr double, overlap double")).collect()}
    assert got[1].pass_stage4 and got[1].portfolio_score == pytest.approx(0.6 * 0.5 + 0.4 * 0.9)
    assert got[2].reject_code == "S4_CAPACITY" and got[2].dsr_after_capacity == pytest.approx(0.15)
    assert got[3].reason == "S4_CORR;S4_OVERLAP" and got[3].dsr_after_capacity == 0.5
    assert got[4].pass_stage4 and got[4].portfolio_score is None


def test_exclusive_groups_that_print_alike(spark):
    """("a, b", "c") and ("a", "b, c") are two groups."""
    from tidemark.operators import ledger

    d = dt.date(2024, 1, 1)
    rows = [("a, b", "c", d, d + dt.timedelta(days=9), 1), ("a", "b, c", d + dt.timedelta(days=1), d + dt.timedelta(days=2), 2)]
    df = spark.createDataFrame(rows, "x string, y string, trigger_date date, exit_date date, trade_id int").coalesce(1)
    assert ledger.exclusive(df, ["x", "y"], 0).count() == 2


# predictive power


def test_year_splits():
    d = dt.date
    got = predictive.year_splits(d(2015, 8, 10), d(2020, 3, 15))
    assert got[0] == predictive.Split(d(2015, 8, 10), d(2018, 6, 30), d(2018, 7, 8), d(2019, 7, 7))
    assert got[1].train_start == d(2016, 1, 1) and got[-1] == predictive.Split(d(2017, 3, 8), d(2020, 3, 7), d(2019, 3, 16), d(2020, 3, 15))
    assert all(s.train_end + dt.timedelta(8) == s.test_start for s in got[:-1]) and max(s.test_end for s in got) == d(2020, 3, 15)
    assert predictive.year_splits(d(2020, 1, 1), d(2020, 6, 1), aligned=False) == [] and splits.plus_months(d(2020, 1, 31), 13) == d(2021, 2, 28)


def test_predictive_power(spark):
    rng = random.Random(12)
    first = dt.date(2015, 1, 1)
    rows = [(s, first + dt.timedelta(days=k), None if rng.random() < 0.1 else rng.gauss(0.02, 1) if s != "flat" else 0.0) for s in ("a", "b", "flat") for k in range(0, 1900, 7 if s == "b" else 3)]
    rows += [("few", first + dt.timedelta(days=5), 1.0), ("a", None, 1.0)]
    splits = predictive.year_splits(first, first + dt.timedelta(days=1899))
    df = spark.createDataFrame(rows, "setup string, date date, fwd double")
    got = {(r.setup, r.fold): r for r in predictive.directed(predictive.predictive_power(df, splits, ["setup"], spark)).collect()}
    want = 0
    for name in ("a", "b", "flat", "few"):
        for fold, s in enumerate(splits, 1):
            mine = [(d, y) for t, d, y in rows if t == name and y is not None and d is not None]
            x = np.array([y for d, y in mine if s.train_start <= d <= s.train_end])
            z = np.array([y for d, y in mine if s.test_start <= d <= s.test_end])
            if len(x) < 15 or len(z) < 10 or x.mean() == 0:
                assert (name, fold) not in got
                continue
            want += 1
            r = got[name, fold]
            assert (r.support_is, r.support_oos, r.direction) == (len(x), len(z), "long" if x.mean() > 0 else "short")
            assert (r.mu_is, r.p_long_is, r.mu_oos) == pytest.approx((x.mean(), (x > 0).mean(), z.mean()))
            assert r.acc_oos == pytest.approx((np.sign(z) == np.sign(x.mean())).mean()) and r.tstat_oos == pytest.approx(math.sqrt(len(z)) * z.mean() / z.std(ddof=1))
            assert r.expected_edge_pct == pytest.approx(math.exp(z.mean()) - 1)
    assert len(got) == want > 5
    best = predictive.best_signals(predictive.directed(predictive.predictive_power(df, splits, ["setup"], spark)), ["direction"], ["setup", "fold"]).collect()
    for r in best:
        assert r.acc_oos == max(x.acc_oos for x in got.values() if x.direction == r.direction)


# outer folds


def business_days(first, n):
    out = []
    while len(out) < n:
        if first.weekday() < 5:
            out.append(first)
        first += dt.timedelta(days=1)
    return out


def test_tail_fold_gives_up_buffers():
    days = business_days(dt.date(2022, 1, 3), 420)
    folds = splits.outer_folds(days, 5, 252, 12, 252, 3)
    assert folds[-1].test_end == days[-1] and [f.is_tail for f in folds].count(True) == 1
    folds = splits.outer_folds(days, 5, 252, 12, 252, 3, embargo_cap=252)
    tail = folds[-1]
    assert tail.is_tail and tail.embargo_from > tail.embargo_days == tail.test_last - tail.test_first + 1 - 5


def test_outer_folds():
    days = business_days(dt.date(2018, 1, 1), 1500)
    folds = splits.outer_folds(days, 10, 63, 36, 21, 1)
    for f, after in zip(folds, folds[1:]):
        assert f.test_first - f.train_last - 1 == f.purge_days == 10 and f.embargo_days == (20 if f.test_last - f.test_first + 1 == 21 else f.embargo_days)
        assert after.test_start >= splits.plus_months(f.test_start, 1)
    assert folds[-1].test_end == days[-1] and all(f.train_start == days[0] for f in folds) and all(f.train_last + 1 >= 36 * 21 for f in folds)
    assert splits.parse_split_id(folds[0].split_id)["P"] == "10"
    for few, months in ((days[:200], 36), ([], 12)):
        with pytest.raises(ValueError):
            splits.outer_folds(few, 5, 63, months)
    with pytest.raises(ValueError, match="No valid splits"):
        splits.outer_folds(days[::15], 5, 63, 36)  # enough months, too few days

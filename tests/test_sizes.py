"""What a tie, a group of many rows or a wide table must not change or cost."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import gauntlet, joins, ledger, selection

D0 = date(2024, 1, 1)  # a Monday
LEDGER = "setup_id int, fold int, exit_date date, trigger_date date, pnl_dollars double, pnl_pct double"


def trades(spark, setups=3):
    rows = [(s, 1 + k % 2, None if k % 11 == 0 else D0 + timedelta(k * 5 % 97), D0 + timedelta(k), float((k * 37 + s) % 41 - 20) * 10, 0.01 * (k % 7 - 3)) for s in range(setups) for k in range(60)]
    return spark.createDataFrame(rows, LEDGER)


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_quantile_between_equal_but_for_noise(spark):
    """A quantile seven tenths of the way between values one digit apart: the sum is rounded once."""
    lo, hi = -0.00019200000000000003, -0.000192
    df = spark.createDataFrame([(lo, hi, 0.7000000000000028), (1.0, 2.0, 0.25)], "a double, b double, d double")
    assert [r.q for r in df.select(gauntlet.between(F.col("a"), F.col("b"), F.col("d")).alias("q")).collect()] == [lo, 1.25]
    rows = spark.createDataFrame([("a", float(x)) for x in (-3, -3, 0, 1, 2)] + [("b", 5.0)], "k string, r double")
    assert {r.k: r.t for r in gauntlet.tail_mean(rows, ["k"], "t", 0.25).collect()} == {"a": -3.0, "b": 5.0}


def test_equal_scores_take_the_first_structure(spark):
    """Scores that are one number, but not one double, are equal."""
    df = spark.createDataFrame([tuple(k / 100 for k in (22, 18, 60, 20, 14))], "a double, b double, c double, d double, e double")
    assert df.select(selection.option_structure(*(F.col(c) for c in "abcde")).alias("s")).first().s == "long_call"


def test_sum_in_the_order_of_rows(spark):
    rows = [("a", k, x) for k, x in enumerate((0.1, 0.2, 0.3, None, -0.6))] + [("b", 9, None)]
    df = spark.createDataFrame(rows[::-1], "k string, row long, x double").repartition(3)
    assert {r.k: r.s for r in df.groupBy("k").agg(ledger.summed("x", df.columns).alias("s")).collect()} == {"a": 0.1 + 0.2 + 0.3 - 0.6, "b": None}


def test_asof_orders_distinct_times_only(spark):
    """A key with very many rows: the window sees its times once."""
    left = spark.range(4000).select(F.lit("a").alias("k"), F.expr("date_add(date'2024-01-01', cast(id % 4 as int))").alias("t"), "id")
    left = left.unionByName(spark.createDataFrame([(None, D0, 9001), ("a", None, 9002)], "k string, t date, id long"))
    right = spark.createDataFrame([("a", D0 + timedelta(1), 1.5), ("a", D0 + timedelta(2), None)], "k string, d date, v double")
    got = joins.asof(left, right, ["k"], "t", "d", "v")
    found = {(r.k, r.t): (r.v, r.n) for r in got.groupBy("k", "t").agg(F.first("v").alias("v"), F.count("*").alias("n")).collect()}
    days = [("a", D0 + timedelta(k)) for k in range(4)]
    assert found == dict(zip(days, [(None, 1000), (1.5, 1000), (None, 1000), (1.5, 1000)])) | {(None, D0): (None, 1), ("a", None): (None, 1)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "Aggregate" in window


def test_folds_from_one_shuffle(spark):
    """Sharpe, drawdown and tail of the folds as over every weekday, from rows of exits, dealt once."""
    t = trades(spark)
    folds = gauntlet.fold_metrics(t, ["setup_id", "fold"])
    days = ledger.nav_returns(t, ["setup_id", "fold"], 100_000.0)
    paths = ledger.nav_paths(days, ["setup_id", "fold"], ["exit_date"])
    want = paths.groupBy("setup_id", "fold").agg(
        F.count("*").alias("n_obs"), gauntlet.sharpe_of("r").alias("sharpe"), F.min("dd").alias("maxdd"), F.expm1(F.sum(F.log1p("r"))).alias("fold_return"), F.sum("r").alias("total_r")
    ).join(gauntlet.tail_mean(days, ["setup_id", "fold"], "cvar5"), ["setup_id", "fold"])
    got = {(r.setup_id, r.fold): r for r in folds.collect()}
    for r in want.collect():
        for c in ("n_obs", "sharpe", "maxdd", "fold_return", "total_r", "cvar5"):
            assert got[r.setup_id, r.fold][c] == pytest.approx(r[c], abs=1e-12), c
    assert len(got) == want.count() == 6
    whole = {r.setup_id: r.x for r in gauntlet.tail_mean(days, ["setup_id"], "x").collect()}
    profit = gauntlet.walk_forward_profit(t)
    assert {r.setup_id: r.wf_cvar_5 for r in profit.collect()} == pytest.approx(whole)
    plan = profit._jdf.queryExecution().executedPlan().toString()
    assert plan[plan.find("Initial Plan") :].count("Exchange ") == 1


def test_setups_paths_from_one_shuffle_a_side(spark):
    """Purging and paths deal the rows by setup only: no join or group deals them again by path or block."""
    from tidemark.operators import cpcv

    plan = cpcv.Plan(6, 2, 5)
    t = trades(spark)
    rows = cpcv.labelled(t, cpcv.block_bounds(t.select(F.col("trigger_date").alias("date")).distinct(), plan), plan)
    df = cpcv.path_metrics(cpcv.path_returns(rows, cpcv.learnt(rows, spark, plan), spark, plan))
    text = df._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in text.splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and all("hashpartitioning(setup_id#" in x and "path#" not in x and "block#" not in x for x in dealt)


def test_drift_reads_its_samples_once(spark):
    from tidemark.operators import models

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(400).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("z"))
    models.adversarial_auc(df.mapInArrow(count, "a double, z double"), df.withColumn("a", F.col("a") + 3), ["a", "z"], 3, 2, 2)
    assert seen.value == 400

"""Every query that has SQL against that SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import DATA, rows

from tidemark.plans.catalog import ORACLES, QUERIES

HEAVY = {"evolved_setups", "hidden_regimes", "complexity_suite"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    wanted = duck.sql(ORACLES[name])
    names = sorted(wanted.columns)
    assert sorted(got.columns) == names
    clean = lambda v: round(v, 8) + 0.0 if isinstance(v, float) else v
    columns = ", ".join(f'"{c}"' for c in names)
    theirs = [tuple(clean(v) for v in r) for r in duck.sql(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall()]
    assert rows(got) == sorted(theirs, key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - HEAVY))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_the_training_data_part(tmp_path):
    """The rest works where the subpackage is gone, even if the pipeline's file stays."""
    import shutil
    import subprocess
    import sys

    from conftest import ROOT

    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), sum(k[:2] == 'op' and k[2].isdigit() or k == 'pipeline' for k in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLES)), "0"], done.stderr


def test_whole_series(spark, monkeypatch):
    """Kernels see every day, not only the last ones."""
    from pyspark.sql import functions as F

    from tidemark.operators import kernels
    from tidemark.plans import relational

    n = 600
    day = F.expr("date_add(date'2020-01-01', cast(id % 600 as int))").alias("date")
    ticker = F.element_at(F.array(*map(F.lit, ["AF", "AO", "NF", "NO", "RF", "RO"])), (F.col("id") / n).cast("int") + 1).alias("ticker")
    made = spark.range(6 * n).select(ticker, day, (F.sin(F.col("id") * 12.9) / 100).alias("ret"))
    monkeypatch.setattr(relational, "returns", lambda spark, sf_dir: made)
    days = {r.ticker: r.d for r in relational.hidden_regimes(spark, DATA).groupBy("ticker").agg(F.sum("days").alias("d")).collect()}
    assert days == dict.fromkeys(["AF", "AO", "NF", "NO", "RF", "RO"], n)
    assert relational.cross_asset_stability(spark, DATA).count() == n
    monkeypatch.setattr(kernels.grouped, "__defaults__", ({"n": len}, None))
    assert {r.n for r in relational.complexity_suite(spark, DATA).collect()} == {float(n)}

"""All queries of the engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import features, panel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


DIGITS = 4

#: A series measured against itself is degenerate (a correlation of 1 and the noise of its rounding), so the queries
#: leave the columns that refer to the benchmark null for the benchmark, and those of the sector's mate for the mates.
SELF = {
    ("NO",): (
        "x_beta_spy_63", "x_bh_ret_spy_21", "x_ewma_corr_21", "x_dcc_corr_21", "macro_beta_conditioned_63", "x_corr_fisher20_z60", "x_corr_delta_20_60_z60",
        "x_beta_60_z120", "x_corr_abs_21", "x_partial_corr_21", "x_leadlag_best_5", "x_leadlag_best_5_lag", "x_coint_resid_z_252",
    ),
    ("NF", "AF", "RF"): ("x_spread_vs_sector_21", "x_partial_corr_21"),
}
OTHERS = {c: sorted({t for ts, cs in SELF.items() if c in cs for t in ts}) for cs in SELF.values() for c in cs}


def _family(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    if family == "macro":
        return features.compute(panel.macro(spark, sf_dir), family, by=("all_days",), keep=("date",), digits=DIGITS)
    rows = features.compute((panel.event_panel if family == "ev" else panel.panel)(spark, sf_dir), family, digits=DIGITS)
    return rows.withColumns({c: F.when(~F.col("ticker").isin(ts), F.col(c)) for c, ts in OTHERS.items()}) if family == "cross" else rows


for _f in features.REGISTRY:
    if _f == "ev":
        add("features_ev", partial(_family, family="ev"), panel.EVENT_FEATURES)
        continue
    _sql = (
        features.text(panel.MACRO_SQL, _f, by=("all_days",), keep=("date",), digits=DIGITS)
        if _f == "macro"
        else features.text(panel.PANEL, _f, digits=DIGITS)
    )
    if _f == "cross":
        _null = ", ".join(f"CASE WHEN ticker NOT IN ({str(ts)[1:-1]}) THEN {c} END AS {c}" for c, ts in OTHERS.items())
        _sql = f"SELECT * REPLACE ({_null}) FROM ({_sql})"
    add(f"features_{_f}", partial(_family, family=_f), _sql)


from tidemark.plans import relational, stages, validation  # noqa: E402, F401

QUERIES |= relational.QUERIES
ORACLES |= relational.ORACLES

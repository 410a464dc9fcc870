"""From out-of-fold scores to what a search maximises: folds to horizons, horizons to a setup, metrics to objectives."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scoring

# The registry's names and what is done with them.
PROPER = ("crps", "brier_score", "log_loss", "pinball_q10", "pinball_q90")
LOSSES = (*PROPER, "calibration_mae", "calibration_ece", "sensitivity_delta_edge", "redundancy_mi", "complexity_index", "drift_auc")
SCORES = ("info_gain", "skill_vs_marginal", "skill_vs_uniform", "w1_effect", "regime_similarity", "support")
COVERAGE = {"coverage_80": 0.80, "coverage_90": 0.90, "coverage_95": 0.95}
LEGACY = ("ig_sharpe", "min_ig", "sharpe_ratio", "sortino_ratio", "sharpe_lb", "expectancy")
MODES = {"forecast": ("crps", "pinball_q10", "pinball_q90"), "legacy": ("ig_sharpe", "min_ig"), "balanced": ("crps", "info_gain", "skill_vs_marginal")}
#: Parts of the names of metrics that are better when lower.
LOWER = ("crps", "pinball", "calib", "sensitivity", "redundancy", "complexity")


def label_of(name: str) -> str:
    """What becomes of a metric: ``negate``, ``identity`` or ``target_<share>``, with ``LEGACY`` where it is a profit measure."""
    if name in LOSSES:
        return "negate"
    if name in SCORES:
        return "identity"
    if name in COVERAGE:
        return f"target_{COVERAGE[name]:.2f}"
    if name in LEGACY:
        return "identity (LEGACY)"
    raise KeyError(f"Unknown objective: {name}")


def checked(names: Sequence[str], allow_legacy: bool = True) -> dict[str, str]:
    """Label of each name; unknown ones raise KeyError, profit measures ValueError where they aren't allowed."""
    labels = {n: label_of(n) for n in names}
    if not allow_legacy and (bad := [n for n in names if n in LEGACY]):
        raise ValueError(f"Legacy P&L objective: {', '.join(bad)}")
    return labels


def audit(names: Sequence[str]) -> tuple[bool, list[str]]:
    """Whether all names are known, and those that aren't."""
    known = {*LOSSES, *SCORES, *COVERAGE, *LEGACY}
    missing = [n for n in names if n not in known]
    return not missing, missing


def recommended(mode: str) -> list[str]:
    if mode not in MODES:
        raise ValueError(f"Unknown mode: {mode}")
    return list(MODES[mode])


def proper_only(names: Sequence[str]) -> list[str]:
    return [n for n in names if n in PROPER]


def objective(name: str, value: Column) -> Column:
    """A metric as something to maximise."""
    label = label_of(name)
    return -value if label == "negate" else -F.abs(value - COVERAGE[name]) if name in COVERAGE else value


def transformed(metrics: DataFrame, names: Sequence[str], allow_legacy: bool = True, prefix: str = "objective_") -> DataFrame:
    """Adds a column to be maximised for each metric; a value that is null or not finite fails the query."""
    checked(names, allow_legacy)
    if absent := [n for n in names if n not in metrics.columns]:
        raise KeyError(f"Missing metric: {', '.join(absent)}")
    out = {}
    for n in names:
        x = F.col(n).cast("double")
        odd = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        out[f"{prefix}{n}"] = F.when(odd, F.raise_error(F.lit(f"objective {n} is non-finite")).cast("double")).otherwise(objective(n, x))
    return metrics.withColumns(out)


def values(metrics: Mapping[str, float], names: Sequence[str], allow_legacy: bool = True) -> tuple[list[float], dict[str, str]]:
    """``transformed`` for one row of metrics on the driver: objectives and labels."""
    labels = checked(names, allow_legacy)
    out = []
    for n in names:
        x = float(metrics[n])
        if not isfinite(x):
            raise ValueError(f"objective {n} is non-finite")
        out.append(-x if labels[n] == "negate" else -abs(x - COVERAGE[n]) if n in COVERAGE else x)
    return out, labels


@dataclass(frozen=True)
class Horizons:
    """How horizons become one value: ``p75`` takes the percentile on the better side, ``mean``, or ``best`` by CRPS."""

    method: str = "p75"
    low: float = 0.25
    high: float = 0.75

    def __post_init__(self) -> None:
        if self.method not in ("p75", "mean", "best"):
            raise ValueError(f"no method {self.method}")


def _median_bands(n: int) -> Column:
    """Medians of each band's probability, scaled to one."""
    mid = [F.median(F.get("probs", F.lit(k))) for k in range(n)]
    total = sum(mid, F.lit(1e-9))
    return F.array(*(m / total for m in mid))


def over_folds(scored: DataFrame, by: Sequence[str], metrics: Sequence[str], bands: int) -> DataFrame:
    """Of each (by, horizon): folds used, medians of the metrics and of the bands' probabilities."""
    return scored.groupBy(*by, "horizon").agg(F.count("crps").cast("double").alias("folds_used"), *(F.median(m).alias(m) for m in metrics), _median_bands(bands).alias("probs"))


def over_horizons(rows: DataFrame, by: Sequence[str], metrics: Sequence[str], edges: Sequence[float], how: Horizons = Horizons()) -> DataFrame:
    """Of each setup: the metrics over its horizons, the best horizon (by CRPS, the shorter of equals), the spread of CRPS over the horizons, and the fields of its final distribution.

    ``rows`` come from ``over_folds``.
    """
    n = len(edges) - 1
    best = F.struct("crps", "horizon")
    of_best = lambda c: F.min_by(c, best)

    def joint(m: str) -> Column:
        if how.method == "best":
            return of_best(m)
        lower = any(part in m for part in LOWER)
        return F.avg(m) if how.method == "mean" else F.percentile(m, F.lit(how.low if lower else how.high))

    probs = of_best("probs") if how.method == "best" else _median_bands(n)
    g = rows.groupBy(*by).agg(
        F.count("*").alias("horizons"), of_best("horizon").alias("best_horizon"), *(joint(m).alias(m) for m in ("folds_used", *metrics)), probs.alias("probs"),
        F.median("crps").alias("_mid"), F.collect_list("crps").alias("_crps"),
    )
    away = F.array_sort(F.transform("_crps", lambda x: F.abs(x - F.col("_mid"))))
    k = F.size(away)
    mad = (F.get(away, F.floor((k - 1) / 2).cast("int")) + F.get(away, F.floor(k / 2).cast("int"))) / 2
    return g.withColumn("horizon_stability_mad", mad).withColumns(scoring.trade_fields("probs", edges)).drop("_mid", "_crps")

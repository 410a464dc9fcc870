"""Feature scoring and feature subspaces."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_features(rows: DataFrame, value: str = "value", target: str = "target", n: int = 252, least: int = 126) -> DataFrame:
    """Mean absolute rolling correlation of each feature with the target.

    ``rows``: feature, ticker, date, value and target; one window for all features.
    """
    w = Window.partitionBy("feature", "ticker").orderBy("date").rowsBetween(1 - n, 0)
    x = F.when(F.col(target).isNotNull(), F.col(value))
    y = F.when(F.col(value).isNotNull(), F.col(target))
    paired = rows.select("feature", "ticker", "date", x.alias("_x"), y.alias("_y"))
    spread = F.stddev_samp("_x").over(w) * F.stddev_samp("_y").over(w)
    rolled = paired.withColumns({"_n": F.count("_x").over(w), "_s": spread, "_c": F.covar_samp("_x", "_y").over(w)})
    corr = F.when((F.col("_n") >= least) & (F.col("_s") > 1e-15), F.abs(F.col("_c") / F.col("_s")))
    return rolled.groupBy("feature").agg(F.avg(corr).alias("score"))


def select_features(scores: DataFrame, least: float = 0.1, most: int = 200) -> DataFrame:
    return scores.where(F.col("score") >= least).orderBy(F.desc("score"), "feature").limit(most)


@dataclass(frozen=True)
class Subspace:
    number: int
    features: tuple[str, ...]


def random_subspaces(features: Sequence[str], n: int, share: float, seed: int) -> list[Subspace]:
    rng = np.random.default_rng(seed)
    k = max(1, round(len(features) * share))
    return [Subspace(i, tuple(sorted(rng.choice(features, k, replace=False).tolist()))) for i in range(n)]


def stratified_subspaces(groups: dict[str, Sequence[str]], n: int, share: float, seed: int) -> list[Subspace]:
    """The same share of every category, one feature at least."""
    rng = np.random.default_rng(seed)
    pick = lambda fs: rng.choice(fs, max(1, round(len(fs) * share)), replace=False).tolist()
    return [Subspace(i, tuple(sorted(x for fs in groups.values() for x in pick(list(fs))))) for i in range(n)]


def complementary_subspaces(features: Sequence[str], n: int, share: float, seed: int) -> list[Subspace]:
    """Consecutive stretches of one shuffled circle, so that together they use features evenly."""
    order = np.random.default_rng(seed).permutation(list(features)).tolist()
    k = max(1, round(len(order) * share))
    return [Subspace(i, tuple(sorted(order[(i * k + j) % len(order)] for j in range(k)))) for i in range(n)]


def overlap(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)

"""Multi-objective search: dominance, fronts, crowding, diversity, and the evolution loop.

Populations are small; what grows is the evaluation, which takes a whole
generation as one DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from zlib import adler32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def skyline(rows: DataFrame, objectives: Sequence[str], fan: int = 8) -> DataFrame:
    """Rows that none dominates.

    A tournament: each task keeps the distinct vectors that none of its own dominates, ``fan`` tasks' winners
    meet in one of the next round, and the last round has one task, which holds little more than the result.
    """
    found = rows.select(*objectives).distinct()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, len(objectives)))
        for batch in batches:
            x = np.vstack([kept, np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(objectives))])])
            best: list[np.ndarray] = []
            for v in x[np.argsort(-x.sum(axis=1), kind="stable")]:
                b = np.array(best)
                if not len(b) or not ((b >= v).all(axis=1) & (b > v).any(axis=1)).any():
                    best.append(v)
            kept = np.array(best)
        if len(kept):
            yield pa.RecordBatch.from_arrays([pa.array(kept[:, k]) for k in range(len(objectives))], list(objectives))

    doubles = ", ".join(f"`{c}` double" for c in objectives)
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.mapInArrow(local, doubles)
    while width > 1:
        width = -(-width // fan)
        found = found.repartition(width).mapInArrow(local, doubles)
    return rows.join(found.distinct(), list(objectives), "left_semi")


def front_numbers(vectors: np.ndarray) -> np.ndarray:
    """Front of each row, from 1, by peeling (maximising)."""
    n = len(vectors)
    ge = (vectors[:, None, :] >= vectors[None, :, :]).all(axis=2)
    gt = (vectors[:, None, :] > vectors[None, :, :]).any(axis=2)
    dom = ge & gt
    front, left, k = np.zeros(n, int), np.ones(n, bool), 1
    while left.any():
        free = left & ~(dom & left[:, None]).any(axis=0)
        front[free] = k
        left &= ~free
        k += 1
    return front


def crowding(rows: DataFrame, front: str, objectives: Sequence[str], key: str) -> DataFrame:
    """``crowding`` of each row: the neighbours' gaps over each objective's range; null (infinite) at the ends."""
    out, total = rows, F.lit(0.0)
    for o in objectives:
        w = Window.partitionBy(front).orderBy(o, key)
        low, high = F.lag(o).over(w), F.lead(o).over(w)
        span = F.max(o).over(Window.partitionBy(front)) - F.min(o).over(Window.partitionBy(front))
        out = out.withColumns({f"_g_{o}": high - low, f"_r_{o}": span})
        gap = F.when(F.col(f"_g_{o}").isNull(), F.lit(None)).when(F.col(f"_r_{o}") > 0, F.col(f"_g_{o}") / F.col(f"_r_{o}")).otherwise(0.0)
        total = total + gap
    return out.withColumn("crowding", total).drop(*(f"_{p}_{o}" for o in objectives for p in "gr"))


def setup_distance(a: Column, b: Column, ha: Column, hb: Column) -> Column:
    """Half the Jaccard distance of two signal lists, half whether horizons differ."""
    union = F.size(F.array_union(a, b))
    jac = F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0)
    return 0.5 * (1 - jac) + 0.5 * (ha != hb).cast("double")


def clamp_objective(x: Column, ratio_like: bool, worst: float = -999.0) -> Column:
    """Signed logarithm for ratios without a bound, +-10 for the others; what isn't finite is the worst."""
    v = F.signum(x) * F.log1p(F.abs(x)) if ratio_like else F.least(F.greatest(x, F.lit(-10.0)), F.lit(10.0))
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), worst).otherwise(v)


def penalty_scalar(deficits: Sequence[tuple[Column, Column, float]]) -> Column:
    """1 to 2: weighted shortfalls (wanted - got, as a share of wanted), damped."""
    total = F.lit(0.0)
    for got, want, weight in deficits:
        total = total + weight * F.greatest(F.lit(0.0), (want - got) / F.greatest(F.abs(want), F.lit(1e-9)))
    return 1 + total / (1 + total)


@dataclass(frozen=True)
class Individual:
    ticker: str
    signals: tuple[str, ...]
    horizon: int = 5

    @property
    def dna(self) -> str:
        return f"{self.ticker}|{','.join(sorted(set(self.signals)))}|{self.horizon}"

    def seed(self, base: int) -> int:
        return adler32(self.dna.encode()) ^ base


@dataclass
class Space:
    tickers: Sequence[str]
    signals: Sequence[str]
    horizons: Sequence[int] = (5,)
    largest: int = 2

    def draw(self, rng: np.random.Generator) -> Individual:
        k = int(rng.integers(1, self.largest + 1))
        picked = rng.choice(len(self.signals), min(k, len(self.signals)), replace=False)
        return Individual(
            self.tickers[rng.integers(len(self.tickers))], tuple(sorted(self.signals[i] for i in picked)), int(rng.choice(self.horizons))
        )

    def cross(self, a: Individual, b: Individual, rng: np.random.Generator) -> Individual:
        pool = sorted({*a.signals, *b.signals})
        k = min(int(rng.integers(1, self.largest + 1)), len(pool))
        picked = rng.choice(len(pool), k, replace=False)
        u = rng.random()
        horizon = a.horizon if u < 0.4 else b.horizon if u < 0.8 else int(rng.choice(self.horizons))
        return Individual((a if rng.random() < 0.5 else b).ticker, tuple(sorted(pool[i] for i in picked)), horizon)

    def mutate(self, a: Individual, rng: np.random.Generator) -> Individual:
        u = rng.random()
        if u < 0.15:
            return Individual(self.tickers[rng.integers(len(self.tickers))], a.signals, a.horizon)
        if u < 0.85:
            kept = list(a.signals)
            kept[int(rng.integers(len(kept)))] = self.signals[rng.integers(len(self.signals))]
            return Individual(a.ticker, tuple(sorted(set(kept))), a.horizon)
        return Individual(a.ticker, a.signals, int(rng.choice(self.horizons)))


Evaluate = Callable[[list[Individual]], dict[str, tuple[float, ...]]]


@dataclass
class Evolution:
    """NSGA-II on one or several islands; ``evaluate`` takes all new individuals of a generation at once."""

    space: Space
    evaluate: Evaluate
    size: int = 40
    generations: int = 5
    islands: int = 1
    migrate_every: int = 2
    migrants: int = 2
    mutation: float = 0.3
    seed: int = 0
    known: dict[str, tuple[float, ...]] = field(default_factory=dict)

    def scored(self, people: list[Individual]) -> np.ndarray:
        new = list({p.dna: p for p in people if p.dna not in self.known}.values())
        if new:
            self.known |= self.evaluate(new)
        return np.array([self.known[p.dna] for p in people])

    def ranked(self, people: list[Individual]) -> list[Individual]:
        """Distinct individuals by front, then by crowding."""
        people = list({p.dna: p for p in people}.values())
        x = self.scored(people)
        front = front_numbers(x)
        room = np.zeros(len(people))
        for f in np.unique(front):
            at = np.flatnonzero(front == f)
            for o in range(x.shape[1]):
                order = at[np.argsort(x[at, o], kind="stable")]
                room[order[[0, -1]]] = np.inf
                span = x[order[-1], o] - x[order[0], o]
                if span > 0:
                    room[order[1:-1]] += (x[order[2:], o] - x[order[:-2], o]) / span
        return [people[i] for i in np.lexsort((np.arange(len(people)), -room, front))]

    def children(self, people: list[Individual], rng: np.random.Generator) -> list[Individual]:
        out = []
        for _ in range(self.size):
            a, b = (people[min(rng.integers(0, len(people), 3))] for _ in range(2))  # ranked: the best of three
            child = self.space.cross(a, b, rng)
            out.append(self.space.mutate(child, rng) if rng.random() < self.mutation else child)
        return out

    def run(self) -> list[Individual]:
        """The last generation of all islands together, best first."""
        rngs = [np.random.default_rng([self.seed, k]) for k in range(self.islands)]
        isles = [[self.space.draw(r) for _ in range(self.size)] for r in rngs]
        self.scored([p for isle in isles for p in isle])
        for g in range(self.generations):
            isles = [self.ranked(isle) for isle in isles]
            broods = [self.children(isle, r) for isle, r in zip(isles, rngs)]
            self.scored([p for brood in broods for p in brood])
            isles = [self.ranked(isle + brood)[: self.size] for isle, brood in zip(isles, broods)]
            if self.islands > 1 and (g + 1) % self.migrate_every == 0:
                guests = [isle[: self.migrants] for isle in isles]
                isles = [isle + guests[k - 1] for k, isle in enumerate(isles)]
        return self.ranked([p for isle in isles for p in isle])[: self.size]

"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and texts of unknown label (U) train a linear model in
numpy.  With class prior p and loss l, the risk is

    p R_P(+) + max(0, R_U(-) - p R_P(-)),

which corrects U for the toxic texts it holds; where the second term turns
negative, its gradient is reversed, as it only measures over-fitting.

Features are rates: for a word and its prefixes of 4 to 6 letters, the share of
the text's words that have it, relative to ``full_rate`` and at most 1.  Those
whose mean in P most exceeds that in U, against their spread, are kept.

P and U are bounded samples (``Params``), taken by the smallest hash of the id; an id
with many rows counts once, with the text of the smallest hash.  The
prior comes from the labelled rows.  Every whole text is scored by itself, so ids may
be null or repeat.  Null and empty texts have no features and get the model's bias;
without any confirmed toxic text every score is 0.  Of features with equal gaps the
lower bucket is kept.  Columns besides id, text and label are not read, whatever
their names.  No rows give no rows.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lowest_ids, map_batches

PREFIXES = (4, 5, 6)
BUCKETS = 1 << 20
CACHE = 200_000
_EDGES = string.punctuation + "«»“”„…¿¡"


@dataclass(frozen=True)
class Params:
    """Bounds of the samples and of the model."""

    positives: int = 1500
    unlabelled: int = 4500
    features: int = 512
    least_gap: float = 4.0
    full_rate: float = 0.01
    epochs: int = 400
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 7


@dataclass
class Model:
    chosen: dict[int, int]  # bucket -> feature
    weights: np.ndarray
    bias: float
    params: Params


def word_buckets(token: str) -> tuple[int, ...]:
    """Buckets of a token's word and prefixes; none if it is only punctuation."""
    word = token.strip(_EDGES)
    if not word:
        return ()
    parts = [f"={word}", *(f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return tuple({crc32(p.encode()) % BUCKETS for p in parts})


def rates(text: str, full_rate: float) -> dict[int, float]:
    """Bucket -> saturated rate in the text."""
    tokens = Counter(text.lower().split())
    n = max(sum(tokens.values()), 1)
    counts: Counter[int] = Counter()
    for token, k in tokens.items():
        for b in word_buckets(token):
            counts[b] += k
    return {b: min(1.0, k / (full_rate * n)) for b, k in counts.items()}


@dataclass
class Rates:
    """Rates of a sample of texts: entry j is text ``row[j]``, bucket ``bucket[j]``, rate ``value[j]``."""

    n: int
    row: np.ndarray
    bucket: np.ndarray
    value: np.ndarray


def sample_rates(docs: DataFrame, known: DataFrame, n: int, full_rate: float, id_col: str, text_col: str) -> Rates:
    """Rates of at most ``n`` whole texts, picked among the ids of ``known``; no other text is moved."""
    ids = lowest_ids(known, id_col, n)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [rates(t or "", full_rate) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([list(r) for r in found], pa.list_(pa.int32())),
             pa.array([list(r.values()) for r in found], pa.list_(pa.float32()))],
            ["h", "buckets", "rates"],
        )

    text = F.col(text_col).cast("string")
    picked = docs.join(F.broadcast(ids), id_col).select(F.col("_h").alias("h"), F.xxhash64(text).alias("th"), text.alias("t"))
    picked = picked.groupBy("h").agg(F.min_by("t", "th").alias("t"))
    got = map_batches(picked, run, "h bigint, buckets array<int>, rates array<float>").toArrow().sort_by("h")
    lists = got.column("buckets").combine_chunks()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    values = got.column("rates").combine_chunks().flatten().to_numpy()
    return Rates(len(lists), row, lists.flatten().to_numpy(), values.astype(float))


def dense(rates: Rates, chosen: dict[int, int]) -> np.ndarray:
    column = np.full(BUCKETS, -1)
    column[list(chosen)] = list(chosen.values())
    at = column[rates.bucket]
    out = np.zeros((rates.n, len(chosen)))
    out[rates.row[at >= 0], at[at >= 0]] = rates.value[at >= 0]
    return out


def screen(pos: Rates, unl: Rates, k: int, least: float) -> dict[int, int]:
    """The k buckets whose mean rate in P most exceeds that in U, by ``least`` pooled errors or more."""
    sums = [np.bincount(r.bucket, r.value, BUCKETS) for r in (pos, unl)]
    squares = sum(np.bincount(r.bucket, r.value**2, BUCKETS) for r in (pos, unl))
    n = pos.n + unl.n
    spread = np.maximum(squares / n - (sum(sums) / n) ** 2, 1e-9)
    gap = (sums[0] / pos.n - sums[1] / unl.n) / np.sqrt(spread * (1 / pos.n + 1 / unl.n))
    best = np.argsort(-gap, kind="stable")[:k]
    return {int(b): i for i, b in enumerate(best[gap[best] >= least])}


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, p: Params) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss (Adam, full batches)."""
    xp, xu = np.c_[pos, np.ones(len(pos))], np.c_[unl, np.ones(len(unl))]
    w = np.zeros(xp.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, p.epochs + 1):
        gp, gu = xp @ w, xu @ w
        neg_u, neg_p = np.logaddexp(0, gu).mean(), np.logaddexp(0, gp).mean()
        grad_pos = -prior * xp.T @ (1 / (1 + np.exp(np.clip(gp, -30, 30)))) / len(xp)
        grad_neg = xu.T @ (1 / (1 + np.exp(np.clip(-gu, -30, 30)))) / len(xu)
        grad_neg -= prior * xp.T @ (1 / (1 + np.exp(np.clip(-gp, -30, 30)))) / len(xp)
        grad = grad_pos + grad_neg if neg_u - prior * neg_p >= 0 else -grad_neg
        grad[:-1] += p.decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    allowed: Column | None = None,
    params: Params = Params(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model | None:
    """A model from the labels of rows that ``allowed`` admits; None without toxic rows.

    A document is confirmed if one of its labels is 1.
    """
    if allowed is not None:
        docs, labels = docs.where(allowed), labels.where(allowed)
    known = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(
        F.max(F.col(label_col).cast("int")).alias("_y")
    )
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("k")).first()
    if not counts.k:
        return None
    texts = docs.select(id_col, text_col)
    pos = sample_rates(texts, known.where("_y = 1"), params.positives, params.full_rate, id_col, text_col)
    unl = sample_rates(texts, texts, params.unlabelled, params.full_rate, id_col, text_col)
    if not pos.n or not unl.n:
        return None
    chosen = screen(pos, unl, params.features, params.least_gap)
    prior = min(max(counts.k / counts.n, 1e-3), 0.9)
    weights, bias = fit_nnpu(dense(pos, chosen), dense(unl, chosen), prior, params)
    return Model(chosen, weights, bias, params)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by Params.features

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m, known, out = shared.value, {}, []
        for value in batch.column(1):
            total = 0.0
            if m:
                tokens = Counter((value.as_py() or "").lower().split())
                n = max(sum(tokens.values()), 1)
                counts: dict[int, int] = {}
                for token, k in tokens.items():
                    hits = known.get(token)
                    if hits is None:
                        if len(known) >= CACHE:
                            known.clear()
                        hits = known[token] = tuple(m.chosen[b] for b in word_buckets(token) if b in m.chosen)
                    for f in hits:
                        counts[f] = counts.get(f, 0) + k
                total = m.bias + sum(m.weights[f] * min(1.0, k / (m.params.full_rate * n)) for f, k in counts.items())
                total = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            out.append(float(total))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], [id_col, "score"])

    src = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return map_batches(src, run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, score double")

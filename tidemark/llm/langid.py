"""Language identification with blended-spectrum string kernels.

Two texts are compared by which character n-grams of 1 to ``max_n`` they share:
K(x, z) = |G(x) & G(z)| / sqrt(|G(x)| |G(z)|), where G is the set of hashed
n-grams of the lower-cased text that occur in some landmark.  Landmarks are
labelled texts; the Nystroem map takes a text to K(x, landmarks) U L^(-1/2), with
U and L the eigenvectors and eigenvalues of the landmarks' own kernel.  One ridge
regression for each language is fitted on mapped texts with targets +1 and -1.
At scoring, both collapse into one matrix: a batch of presence vectors times the
landmarks' presence matrix, scaled, times that matrix.

Training takes a bounded sample: the ``per_lang`` ids of each language with the
smallest hash, among the first 2 ``per_lang`` rows by it.  Their whole texts become sets of n-gram buckets where
they are, 2^``BUCKET_BITS`` at most, and only these come to the driver.  Scoring
reads every whole text, in slices of bounded size.

Null texts and texts without a letter are ``und`` with score 0, as is everything
if no labelled text exists.  Each row is judged by itself, so ids may be null or
repeat; of repeated ids in one language one row, that of the smallest hash of its
text, may be in the sample.  Equal scores go to the first language by name.  Columns
besides id, text and language are only read if ``keep`` names them.

``recognised`` tells which texts are in a learned language.  Of a text in another
script or of noise the landmarks know few n-grams; of one in a foreign language with
the same letters they know most, but no language stands out.  Mixtures of learned
languages have a low score too, and short texts, but their n-grams are known.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop_saved, map_batches, saved

UNDETERMINED = "und"
BUCKET_BITS = 18
LARGEST_BROADCAST = 100_000
HISTOGRAM_BITS = 12
SLICE = 1 << 20
ROWS = 64
_LETTER = regex.compile(r"\p{L}")
#: Of 10,000 documents at sf0.1 and of samples of 7,700 at two other sizes none is below LEAST_KNOWN (least: 0.74),
#: and none below both of the others; Cyrillic, Greek, Arabic, Han and random letters have 0.01 to 0.55 of known n-grams.
LEAST_KNOWN, WELL_KNOWN, LEAST_SCORE = 0.6, 0.85, 0.55


@dataclass(frozen=True)
class Params:
    """``per_lang`` bounds the training texts of a language, ``landmarks`` those of all languages."""

    per_lang: int = 400
    landmarks: int = 256
    max_n: int = 3
    ridge: float = 1e-2
    temperature: float = 0.25


@dataclass
class Model:
    langs: list[str]
    lookup: np.ndarray  # bucket -> column of the presence matrix; the last column takes all others
    presence: np.ndarray  # (columns, landmarks), scaled by the landmarks' norms
    weights: np.ndarray  # (landmarks, languages)
    params: Params


def grams(text: str, max_n: int) -> Iterator[np.ndarray]:
    """Hash buckets of a text's n-grams, in arrays of bounded length."""
    for k in range(0, max(len(text), 1), SLICE):
        part = text[max(k - max_n + 1, 0) : k + SLICE].lower()
        points = np.frombuffer(part.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        code = points
        for n in range(1, max_n + 1):
            if n > 1:
                code = code[:-1] * np.uint64(0x100000001B3) + points[n - 1 :]
            mixed = (code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            yield (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def presence_rows(
    texts: list[str], lookup: np.ndarray, columns: int, max_n: int, shares: list[float] | None = None
) -> np.ndarray:
    """0/1 matrix of the texts over the known n-grams; appends to ``shares`` how much of each text is known."""
    out = np.zeros((len(texts), columns + 1), np.float32)
    for row, text in zip(out, texts):
        known = total = 0
        for g in grams(text, max_n):
            at = lookup[g]
            row[at] = 1
            if shares is not None:
                known, total = known + int(np.count_nonzero(at < columns)), total + len(at)
        if shares is not None:
            shares.append(known / max(total, 1))
    return out[:, :columns]


def sampled(rows: DataFrame, per_lang: int) -> DataFrame:
    """(lang, h, k) of the ``per_lang`` smallest hashes of ids in each language, as a saved table.

    A histogram over the hashes' first bits tells up to where they are, so that only about two times
    ``per_lang`` rows of a language, and those that share the last bucket, are ranked in one task.
    """
    ids = rows.select("lang", F.xxhash64("id").alias("h")).withColumn("bucket", F.shiftright("h", 64 - HISTOGRAM_BITS))
    before = Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = ids.groupBy("lang", "bucket").agg(F.count("*").alias("n"))
    past = F.coalesce(F.sum("n").over(before), F.lit(0))
    needed = counted.withColumn("past", past).where(F.col("past") < 2 * per_lang)
    upto = saved(needed.groupBy("lang").agg(F.max("bucket").alias("upto")), "upto")
    near = ids.join(broadcast_if_few(upto), "lang").where("bucket <= upto").select("lang", "h").distinct()
    first = Window.partitionBy("lang").orderBy("h")
    out = saved(near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_lang), "sample")
    drop_saved(upto)
    return out


def broadcast_if_few(table: DataFrame) -> DataFrame:
    """A row or ``per_lang`` rows for each language are few; but labels may be many."""
    return F.broadcast(table) if table.count() <= LARGEST_BROADCAST else table


def training_sets(
    docs: DataFrame, allowed: Column | None, p: Params, id_col: str, text_col: str, lang_col: str
) -> list[tuple[str, int, np.ndarray]]:
    """(lang, k, buckets) of the bounded sample: ids are picked first, then only their texts are read."""
    docs = docs if allowed is None else docs.where(allowed)
    rows = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    picked = sampled(rows.select("id", "lang"), p.per_lang)
    known = rows.withColumn("h", F.xxhash64("id")).join(broadcast_if_few(picked), ["lang", "h"]).where(F.col("text").rlike(r"\p{L}"))
    once = known.groupBy("lang", "k").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = []
        for value in batch.column(2):
            seen = np.zeros(1 << BUCKET_BITS, bool)
            for g in grams(value.as_py(), p.max_n):
                seen[g] = True
            sets.append(np.flatnonzero(seen).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int32()))], ["lang", "k", "buckets"])

    got = map_batches(once.select("lang", "k", "text"), run, "lang string, k int, buckets array<int>").toArrow()
    drop_saved(picked)
    lists = (x.values.to_numpy() for x in got.column("buckets"))
    return sorted(zip(got.column("lang").to_pylist(), got.column("k").to_pylist(), lists), key=lambda r: r[:2])


def fit(
    docs: DataFrame,
    allowed: Column | None = None,
    params: Params = Params(),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model | None:
    """A model from the labelled rows that ``allowed`` admits; None if there are none."""
    rows = training_sets(docs, allowed, params, id_col, text_col, lang_col)
    if not rows:
        return None
    langs = sorted({lang for lang, _, _ in rows})
    each = max(1, params.landmarks // len(langs))
    marks = [buckets for _, k, buckets in rows if k <= each]
    lookup = np.full(1 << BUCKET_BITS, -1, np.int32)
    for buckets in marks:
        lookup[buckets] = 1
    known = np.flatnonzero(lookup > 0)
    lookup[:] = len(known)
    lookup[known] = np.arange(len(known))

    def scaled(sets: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(sets), len(known) + 1), np.float32)
        for row, buckets in zip(x, sets):
            row[lookup[buckets]] = 1
        x = x[:, :-1]
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    landmarks = scaled(marks)
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    kernel = np.vstack(
        [scaled([b for _, _, b in rows[k : k + ROWS]]) @ landmarks.T for k in range(0, len(rows), ROWS)]
    ).astype(np.float64)
    mapped = np.c_[kernel @ root, np.ones(len(rows))]
    targets = np.array([[1.0 if lang == of else -1.0 for lang in langs] for of, _, _ in rows])
    share = np.array([[1 / sum(of == lang for of, _, _ in rows)] for lang, _, _ in rows]) * len(rows) / len(langs)
    gram = mapped.T @ (mapped * share) + params.ridge * len(rows) * np.eye(mapped.shape[1]) / 100
    solved = np.linalg.solve(gram, mapped.T @ (targets * share))
    weights = np.vstack([root @ solved[:-1], solved[-1:]])
    return Model(langs, lookup, np.ascontiguousarray(landmarks.T, np.float32), weights, params)


def score_texts(texts: list[str], model: Model, shares: list[float] | None = None) -> tuple[list[str], list[float]]:
    """Language and its softmax share for each text."""
    langs, scores = [], []
    for k in range(0, len(texts), ROWS):
        x = presence_rows(texts[k : k + ROWS], model.lookup, len(model.presence), model.params.max_n, shares)
        kernel = (x @ model.presence) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        margin = (kernel @ model.weights[:-1] + model.weights[-1]) / model.params.temperature
        share = np.exp(margin - margin.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        langs += [model.langs[b] for b in best]
        scores += share[np.arange(len(best)), best].tolist()
    return langs, scores


def predict(
    docs: DataFrame,
    model: Model | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    with_text: bool = False,
    with_known: bool = False,
) -> DataFrame:
    """``id_col``, the text if asked for, the columns ``keep``, ``lang_pred`` and ``score`` of every row.

    ``with_known`` adds ``known_share``, the share of the text's n-grams that occur in a landmark.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by Params and BUCKET_BITS

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = shared.value
        texts = batch.column(1).to_pylist()
        known = [i for i, t in enumerate(texts) if m and t and _LETTER.search(t)]
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        shares, found = [0.0] * len(texts), [] if with_known else None
        if known:
            for i, lang, score in zip(known, *score_texts([texts[i] for i in known], m, found)):
                langs[i], scores[i] = lang, score
            for i, share in zip(known, found or ()):
                shares[i] = share
        kept = [batch.column(c) for c in range(0 if with_text else 2, batch.num_columns)]
        kept = kept if with_text else [batch.column(0), *kept]
        extra = [pa.array(shares, pa.float64())] if with_known else []
        yield pa.RecordBatch.from_arrays([*kept, pa.array(langs), pa.array(scores, pa.float64()), *extra], names)

    src = docs.select(F.col(id_col), F.col(text_col).cast("string"), *keep)
    names = [id_col, *([text_col] if with_text else []), *keep, "lang_pred", "score", *(["known_share"] if with_known else [])]
    kinds = {f.name: f.dataType.simpleString() for f in src.schema} | {"lang_pred": "string", "score": "double", "known_share": "double"}
    return map_batches(src, run, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def recognised() -> Column:
    """Whether a row of ``predict`` with ``known_share`` is in a learned language."""
    known, score = F.col("known_share"), F.col("score")
    clear = (known >= WELL_KNOWN) | (score >= LEAST_SCORE)
    return (F.col("lang_pred") != UNDETERMINED) & (known >= LEAST_KNOWN) & clear

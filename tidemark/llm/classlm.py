"""Scores of a class-based bigram model, whose classes Brown's exchange clustering finds.

The probability of a word w after a word v is P(C(w) | C(v)) * P(w | C(w)).  Tokens are
the words of a text, A-Z lower-cased, and one end, which also stands before the first.

*Units.*  The ``frequent`` most frequent words are units of their own; all others,
words never seen among them, share a unit with those of the same last three bytes
(hashed to ``endings``).  The exchange assigns units, so every word has a class.
Counts are of all learning texts: each task counts its bigrams of units, Spark sums them
by key, and one row for each unit holds its neighbours.

*Exchange.*  In each round tasks get the classes and the matrix of class bigrams (both
of fixed size), and move a unit out of its class and to where the likelihood of the
class bigrams becomes highest.  A third of the units may move in a round.  From a start
by rank all moves of the first ``FREE`` rounds are made; later only those that gain most
if all together would lose.  The end keeps a class alone.

*Smoothing.*  Transitions are interpolated with the classes' own frequency, by the number
of different successors (Witten-Bell); within a class a word seen c times has
c / (N + V + 1), all unseen words together (V + 1) / (N + V + 1), N its tokens and V its
words.  So probabilities of all words and one unseen word of each class sum to one.

The ``known`` most frequent words are broadcast with their counts; other words of the
texts are joined with the table of counts.  A null or empty text is the end alone.  Every
row is a document, so ids may be null or repeat.  Ties in frequency go to the smaller
word.  Very long texts are read in windows.  Without a learning text no token is known,
and both scores are 0.  Other columns aren't read, whatever their names.  No rows give
no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_saved, saved, trimmed, windows

#: Bytes of a text as words see them: white space as a space, A-Z lower-cased.
WORD_BYTES = bytes(0x20 if 9 <= b <= 13 else b for b in bytes(range(256)).lower())
#: The end of a text among the words, which are never empty; its unit and class.
END, END_UNIT, END_CLASS = b"", 0, 0
#: Distinct words, or bigrams, that a task counts before it passes them on; words it remembers besides the broadcast ones.
COUNTED, PAIRS, MEMO = 1 << 19, 1 << 22, 1 << 18
ENDING = 3
#: Rounds whose moves are all made: two of each unit.
FREE = 6
#: Files of the units' neighbours, at most ``units`` squared pairs.
FILES = 8


@dataclass(frozen=True)
class Params:
    """Sizes of the model, and rounds of the exchange."""

    frequent: int = 3072
    endings: int = 1024
    classes: int = 64
    rounds: int = 18
    known: int = 1 << 18

    @property
    def units(self) -> int:
        return self.frequent + self.endings


@dataclass
class Model:
    vocabulary: DataFrame  # word, n
    words: list[bytes]  # the most frequent ones, the end first
    counts: np.ndarray  # of ``words``
    classes: np.ndarray  # of units
    pairs: np.ndarray  # class bigrams
    types: np.ndarray  # different words of each class
    tokens: int
    size: int
    params: Params


def unit_of(word: bytes, p: Params) -> int:
    """The unit of a word that isn't frequent."""
    return p.frequent + crc32(word[-ENDING:]) % p.endings


class Units(dict):
    """Number of a broadcast word, or ``size`` plus the unit of another; a bounded number of those is remembered."""

    def __init__(self, words: list[bytes], p: Params, size: int) -> None:
        super().__init__((w, k) for k, w in enumerate(words))
        self.p, self.size, self.most = p, size, len(words) + MEMO

    def __missing__(self, word: bytes) -> int:
        code = self.size + unit_of(word, self.p)
        if len(self) < self.most:
            self[word] = code
        return code


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    for part in windows(text.translate(WORD_BYTES)):
        yield part.split()


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` and ``n`` of all texts, the end as an empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for texts in batches:
            for value in texts.column(0):
                counts[END] += 1
                for words in word_lists(value.as_py() or b""):
                    counts.update(words)
                    if len(counts) > COUNTED:
                        yield batch()
        yield batch()
        trimmed()

    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def unit_pairs(texts: DataFrame, words: list[bytes], p: Params) -> DataFrame:
    """``a``, ``b`` and ``n`` of the bigrams of units of all texts."""
    shared = texts.sparkSession.sparkContext.broadcast(words)  # Params.frequent words

    def counted(keys: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(n)], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Units(shared.value, p, 0)
        held, size = [], 0
        for texts in batches:
            for value in texts.column(0):
                last = END_UNIT
                for words in (*word_lists(value.as_py() or b""), [END]):
                    units = np.fromiter(map(look.__getitem__, words), np.int64, len(words))
                    held.append(np.r_[last, units[:-1]] * p.units + units if len(units) else units)
                    last = units[-1] if len(units) else last
                    size += len(units)
                    if size >= PAIRS:
                        yield counted(held)
                        held, size = [], 0
        if size:
            yield counted(held)
        trimmed()

    got = texts.mapInArrow(run, "key int, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return got.select(F.expr(f"key div {p.units}").cast("int").alias("a"), (F.col("key") % p.units).alias("b"), "n")


def neighbours(pairs: DataFrame) -> DataFrame:
    """A row for each unit: units ``after`` it and ``before`` it, with counts.  A list is no longer than the number of units."""
    gather = lambda at, other, n: [F.collect_list(F.when(F.col("side") == at, F.col(c))).alias(f"{c}_{at}") for c in (other, n)]
    both = pairs.selectExpr("a as unit", "b as other", "n", "'after' as side").unionByName(pairs.selectExpr("b as unit", "a as other", "n", "'before' as side"))
    return both.groupBy("unit").agg(*gather("after", "other", "n"), *gather("before", "other", "n")).repartition(FILES)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(pairs: np.ndarray) -> float:
    """Log likelihood of the class bigrams, less what no exchange changes."""
    return float(xlogx(pairs).sum() - 2 * xlogx(pairs.sum(1)).sum())


def class_counts(batch: pa.RecordBatch, side: str, classes: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """Unit, its neighbours' counts by class without itself, and its count beside itself."""
    units, lists, n = batch.column("unit").to_numpy(), batch.column(f"other_{side}"), batch.column(f"n_{side}")
    edges, other, n = lists.offsets.to_numpy(), lists.flatten().to_numpy(), n.flatten().to_numpy()
    edges = edges - edges[0]
    for unit, a, b in zip(units.tolist(), edges[:-1], edges[1:]):
        near, count = other[a:b], n[a:b].astype(float)
        own = count[near == unit].sum()
        total = np.bincount(classes[near], count, k)
        total[classes[unit]] -= own
        yield unit, total, own


def best_class(pairs: np.ndarray, a: int, after: np.ndarray, before: np.ndarray, own: float) -> tuple[int, float]:
    """Where a unit of class ``a`` is best put, and the gain in likelihood over staying."""
    m = pairs.copy()
    m[a] -= after
    m[:, a] -= before
    m[a, a] -= own
    size, n = pairs.sum(1), after.sum() + own
    size[a] -= n
    x, y = np.flatnonzero(after), np.flatnonzero(before)
    d = np.arange(len(m))
    diag = m[d, d]
    gain = (xlogx(m[:, x] + after[x]) - xlogx(m[:, x])).sum(1) + (xlogx(m[y] + before[y, None]) - xlogx(m[y])).sum(0)
    gain += xlogx(diag) - xlogx(diag + after) - xlogx(diag + before) + xlogx(diag + after + before + own)
    gain -= 2 * (xlogx(size + n) - xlogx(size))
    gain[END_CLASS] = -np.inf
    b = int(np.argmax(gain))
    return b, float(gain[b] - gain[a])


def class_pairs(near: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """Bigram counts of the classes."""
    shared = near.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for unit, after, own in class_counts(batch, "after", shared.value, k):
                a = shared.value[unit]
                total[a] += after
                total[a, a] += own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], ["at", "n"])

    got = near.mapInArrow(run, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(k, k)


def proposals(near: DataFrame, classes: np.ndarray, pairs: np.ndarray, turn: int) -> list[tuple[float, int, int]]:
    """Gain, unit and new class of the units whose turn it is and that gain by a move; the units are bounded by the model's size."""
    shared = near.sparkSession.sparkContext.broadcast((classes, pairs))
    allowed = (F.col("unit") != END_UNIT) & (F.pmod(F.xxhash64("unit"), F.lit(3)) == turn % 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, pairs = shared.value
        for batch in batches:
            out = []
            for (unit, after, own), (_, before, _) in zip(*(class_counts(batch, s, classes, len(pairs)) for s in ("after", "before"))):
                b, gain = best_class(pairs, classes[unit], after, before, own)
                if gain > 1e-6:
                    out.append((gain, unit, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["gain", "unit", "class"])

    got = near.where(allowed).mapInArrow(run, "gain double, unit bigint, class bigint").toArrow()
    return sorted(zip(*(got.column(c).to_pylist() for c in ("gain", "unit", "class"))), key=lambda r: (-r[0], r[1]))


def exchange(near: DataFrame, frequencies: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the units and the class bigrams after all rounds."""
    k = p.classes
    order = np.lexsort((np.arange(p.units), -frequencies))
    order = order[order != END_UNIT]
    classes = np.zeros(p.units, np.int64)
    classes[order] = 1 + np.arange(p.units - 1) % (k - 1)
    pairs = class_pairs(near, classes, k)
    still = 0
    for turn in range(p.rounds):
        moves = proposals(near, classes, pairs, turn)
        moved = False
        while moves:
            new = classes.copy()
            new[[u for _, u, _ in moves]] = [c for *_, c in moves]
            after = class_pairs(near, new, k)
            if turn < FREE or likelihood(after) > likelihood(pairs):
                classes, pairs, moved = new, after, True
                break
            moves = moves[: len(moves) // 4]
        still = 0 if moved else still + 1
        if still == 3:
            break
    return classes, pairs


def fit(docs: DataFrame, allowed: Column | None = None, params: Params = Params(), text_col: str = "text") -> Model | None:
    """A model of the texts that ``allowed`` admits; None without any."""
    p = params
    texts = docs if allowed is None else docs.where(allowed)
    texts = texts.select(F.col(text_col).cast("string").cast("binary").alias("t"))
    vocabulary = saved(word_counts(texts).where("n > 0"), "vocabulary")
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    if not total.n:
        return None
    top = vocabulary.orderBy(F.expr("word = X''").desc(), F.col("n").desc(), "word").limit(p.known).toArrow()
    words, counts = top.column("word").to_pylist(), top.column("n").to_numpy()
    counted = saved(unit_pairs(texts, words[: p.frequent], p), "pairs")
    near = saved(neighbours(counted), "neighbours")
    drop_saved(counted)
    sizes = near.select("unit", F.aggregate("n_after", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).toArrow()
    frequencies = np.zeros(p.units, np.int64)
    frequencies[sizes.column("unit").to_numpy()] = sizes.column("n").to_numpy()
    classes, pairs = exchange(near, frequencies, p)
    drop_saved(near)
    frequent = top.slice(0, p.frequent).select(["word"])
    rest = vocabulary.join(F.broadcast(docs.sparkSession.createDataFrame(frequent)), "word", "left_anti")
    ending = F.crc32(F.expr(f"substring(word, greatest(1, octet_length(word) - {ENDING - 1}), {ENDING})")) % p.endings
    by = rest.groupBy((ending + p.frequent).alias("unit")).agg(F.count("*").alias("v")).toArrow()
    types = np.bincount(classes[np.arange(len(frequent))], minlength=p.classes)
    types += np.bincount(classes[by.column("unit").to_numpy()], by.column("v").to_numpy(), p.classes).astype(np.int64)
    return Model(vocabulary, words, counts, classes, pairs, types, total.n, total.v, p)


def transitions(pairs: np.ndarray) -> np.ndarray:
    """P(class | class before), rows summing to one."""
    own = (pairs.sum(1) + 1) / (pairs.sum() + len(pairs))
    kinds = np.maximum((pairs > 0).sum(1), 1)[:, None]
    return (pairs + kinds * own) / (pairs.sum(1)[:, None] + kinds)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``perplexity`` of every row."""
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"), F.col(text_col).cast("string").cast("binary").alias("t"))
    m = model
    held = None
    if m:
        p, at = m.params, np.arange(len(m.words))
        units = np.array([k if k < p.frequent else unit_of(w, p) for k, w in enumerate(m.words)], np.int64)
        of_code = np.concatenate([m.classes[units], m.classes])  # by number of a broadcast word, then by unit
        within = np.log10(m.pairs.sum(1) + m.types + 1)
        fixed = np.log10(transitions(m.pairs)) - within
        own, base = np.zeros((2, len(of_code)))
        own[at], base[at] = np.log10(m.counts), np.log10(m.counts + 1)
        held = (m.words, p, of_code, fixed, own, base)
    shared = docs.sparkSession.sparkContext.broadcast(held)  # Params.known words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, look = shared.value, None
        if model:
            words, p, of_code, fixed, own, base = model
            look = Units(words, p, len(words))
        for batch in batches:
            done, rest = [], []
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                n = known = 0
                local = plain = 0.0
                last = END_CLASS
                for part in (*word_lists(text.as_py() or b""), [END]):
                    n += len(part)
                    if not look or not part:
                        continue
                    codes = np.fromiter(map(look.__getitem__, part), np.int64, len(part))
                    classes = of_code[codes]
                    local += fixed[np.r_[last, classes[:-1]], classes].sum() + own[codes].sum()
                    plain += base[codes].sum()
                    last = classes[-1]
                    other = np.flatnonzero(codes >= len(words))
                    known += len(part) - len(other)
                    rest += [(row, w, k, int(of_code[look[w]])) for w, k in Counter(part[j] for j in other).items()]
                    if len(rest) >= COUNTED:
                        yield rows([], rest, batch.schema.field(1).type)
                        rest = []
                done.append((row, doc, n, known, plain, local))
            yield rows(done, rest, batch.schema.field(1).type)
        trimmed()

    def rows(done: list[tuple], rest: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        a, b = len(done), len(rest)
        done, rest = list(zip(*done)) or [()] * 6, list(zip(*rest)) or [()] * 4
        cols = [
            pa.array([*done[0], *rest[0]], pa.int64()),
            pa.array([*done[1], *[None] * b], kind),
            *(pa.array([*done[k], *[None] * b], t) for k, t in zip(range(2, 6), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))),
            *(pa.array([*[None] * a, *rest[k]], t) for k, t in zip(range(1, 4), (pa.binary(), pa.int64(), pa.int32()))),
        ]
        return pa.RecordBatch.from_arrays(cols, ["row", "doc", "tokens", "known", "plain", "local", "word", "k", "class"])

    schema = f"row bigint, doc {kind}, tokens bigint, known bigint, plain double, local double, word binary, k bigint, class int"
    parts = saved(source.mapInArrow(run, schema), "scored")
    texts = parts.where("word is null")
    if m:
        unseen = F.element_at(F.array(*[F.lit(float(x)) for x in np.log10(m.types + 1)]), F.col("class") + 1)
        rest = parts.where("word is not null").select("row", "word", "k", "class").join(m.vocabulary, "word", "left")
        rest = rest.groupBy("row").agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("k"))).alias("more_known"),
            F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("more_plain"),
            F.sum(F.col("k") * F.coalesce(F.log10("n"), unseen)).alias("more_local"),
        )
        texts = texts.select("row", "doc", "tokens", "known", "plain", "local").join(rest, "row", "left")
    else:
        texts = texts.withColumns({c: F.lit(0) for c in ("more_known", "more_plain", "more_local")})
    each = float(np.log10(m.tokens + m.size + 1)) if m else 0.0
    zero = F.lit(0)
    return texts.select(
        F.col("doc").alias(id_col),
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(m.tokens if m else 0).cast("long").alias("train_tokens"),
        (F.col("plain") + F.coalesce("more_plain", zero) - F.col("tokens") * each).alias("base_score"),
        (F.col("local") + F.coalesce("more_local", zero)).alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))

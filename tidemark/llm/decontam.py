"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are compared as lower-cased words joined by single spaces.  An
item of m characters leaks if some region of a text aligns with it within
k = edit_rate * m edits.  Such a region shares at least m + 1 - q (k + 1) q-grams
with the item, all on k + 1 neighbouring diagonals (text position less item
position).  Shared q-grams are counted in bands of 2 (k + 1) diagonals that
overlap by half, so one band holds them all; bands that reach the bound are
aligned within the band, with free ends in the text.

The filter loses nothing, so the result equals a full search.  Items form blocks
of ``BLOCK`` characters; each block is indexed on the driver, sent to the tasks
and searched in one pass over the texts, so a benchmark of many blocks takes as many.
Grams that many items share meet many places of a text: such pairs are counted
``HITS`` at a time, and only counts of bands are kept.  Where the bound is below 1 with ``q``, the
item has an index of the longest grams whose bound is 2 (8 for 17 to 19 characters).
Items shorter than ``q`` characters leak by an exact copy as whole words; next to a
character of a script without spaces, a word may begin and end anywhere.
Null texts and items, and those without a word, have no characters and don't leak.
Every row and item is searched by itself: ids may be null or repeat, and repeated rows
have repeated results.  Of equal regions of an item the first is reported.  Texts of
any length are searched whole.  Other columns are not read, whatever their names.
No texts or no items give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import groups_of, map_batches

BLOCK = 1_000_000
FILTER_BITS = 22
ALIGNED_AT_ONCE = 512
HITS = 1 << 20
_GAPS = re.compile(r"[\W_]+")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]")


@dataclass(frozen=True)
class Params:
    q: int = 10
    edit_rate: float = 0.06


@dataclass
class Index:
    """The q-grams of a block of items, sorted by hash, and a bit table in front of them."""

    items: list[np.ndarray]
    item_ids: list
    hashes: np.ndarray
    of: np.ndarray
    at: np.ndarray
    present: np.ndarray
    bits: int
    edits: np.ndarray
    bound: np.ndarray
    q: int
    whole: bool


def normal(text: str) -> str:
    return _GAPS.sub(" ", text.lower()).strip()


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def qgram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """64-bit hash of every q-gram, from hashes of doubling lengths."""
    base = 0x9E3779B97F4A7C15
    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    single = codes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    piece, out, done, size = single, None, 0, 1
    while size <= q:
        if q & size:
            if out is None:
                out, done = piece, size
            else:
                n = len(codes) - done - size + 1
                out = out[:n] * power(size) + piece[done : done + n]
                done += size
        if 2 * size <= q:
            n = max(len(codes) - 2 * size + 1, 0)
            piece = piece[:n] * power(size) + piece[size : size + n]
        size *= 2
    out = out[: max(len(codes) - q + 1, 0)]
    out = out ^ (out >> np.uint64(31))
    return out * np.uint64(0xBF58476D1CE4E5B9)


def gram_size(m: int, k: int, p: Params) -> int:
    """``q`` where the bound is 1 at least, else the longest grams with a bound of 2."""
    return p.q if m + 1 - p.q * (k + 1) >= 1 else max((m - 1) // (k + 1), 1)


def build_index(items: list[tuple[object, str]], p: Params) -> list[Index]:
    """An index for each size of grams that the items need, and for each length of those found as whole words."""
    sized: dict[tuple[int, bool], list[tuple[object, np.ndarray]]] = {}
    for item_id, text in items:
        codes = points(normal(text or ""))
        m, k = len(codes), int(p.edit_rate * len(codes))
        if m:
            whole = m < p.q and not k
            sized.setdefault((m if whole else gram_size(m, k, p), whole), []).append((item_id, codes))
    return [index_of(of, q, whole, p) for (q, whole), of in sorted(sized.items())]


def index_of(items: list[tuple[object, np.ndarray]], q: int, whole: bool, p: Params) -> Index:
    ids, kept = [i for i, _ in items], [c for _, c in items]
    edits = np.array([int(p.edit_rate * len(c)) for c in kept], np.int64)
    bound = np.array([len(c) for c in kept]) + 1 - q * (edits + 1)
    hashes = [qgram_hashes(c, q) for c in kept]
    of = np.repeat(np.arange(len(kept)), [len(h) for h in hashes])
    at = np.concatenate([np.arange(len(h)) for h in hashes])
    flat = np.concatenate(hashes)
    order = np.argsort(flat, kind="stable")
    bits = min(FILTER_BITS, (64 * len(flat)).bit_length())
    present = np.zeros(1 << bits, bool)
    present[flat >> np.uint64(64 - bits)] = True
    return Index(kept, ids, flat[order], of[order], at[order], present, bits, edits, bound, q, whole)


def whole_words(codes: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
    """Whether the ``q`` characters at each place begin and end between words; ``codes`` are padded by zeros."""

    def parted(right: np.ndarray) -> np.ndarray:
        left, here = codes[np.maximum(right - 1, 0)], codes[np.minimum(right, len(codes) - 1)]
        out = (right == 0) | (left == ord(" ")) | (here == ord(" ")) | (left == 0) | (here == 0)
        for k in np.flatnonzero(~out & ((left >= 0xE00) | (here >= 0xE00))):
            out[k] = bool(_UNSPACED.search(chr(left[k]) + chr(here[k])))
        return out

    return parted(at) & parted(at + q)


def banded_edits(pairs: list[tuple[np.ndarray, np.ndarray, int]]) -> list[tuple[int, int, int]]:
    """(edits, begin, end) of each item in its region, with free ends in the region.

    A pair is (item, region, width): diagonals 0 to width - 1 of the region are searched.
    """
    n, width = max(len(i) for i, _, _ in pairs), max(w for _, _, w in pairs)
    item = np.zeros((len(pairs), n), np.uint32)
    text = np.zeros((len(pairs), n + width), np.uint32)
    sizes = np.array([len(i) for i, _, _ in pairs])
    for row, (i, t, _) in enumerate(pairs):
        item[row, : len(i)] = i
        text[row, : len(t)] = t[: n + width]
    lane = np.arange(width)
    beyond = lane[None, :] >= np.array([w for _, _, w in pairs])[:, None]
    far = 1 << 20
    cost = np.where(beyond, far, 0).astype(np.int64)
    start = np.broadcast_to(lane, cost.shape).copy()
    best = [(far, 0, 0)] * len(pairs)
    for row in range(1, n + 1):
        same = text[:, row - 1 : row - 1 + width] == item[:, row - 1 : row]
        new, origin = cost + ~same, start
        skip = np.c_[cost[:, 1:] + 1, np.full(len(pairs), far)]  # an item character without counterpart
        origin = np.where(skip < new, np.c_[start[:, 1:], start[:, -1:]], origin)
        new = np.minimum(new, skip)
        level = (new - lane) * width + (width - 1 - lane)  # extra text characters: the running minimum
        run = np.minimum.accumulate(level, axis=1)
        source = width - 1 - run % width
        new = run // width + lane
        start = np.take_along_axis(origin, source, axis=1)
        cost = np.where(beyond, far, new)
        for c in np.flatnonzero(sizes == row):
            o = int(np.argmin(cost[c]))
            best[c] = int(cost[c, o]), int(start[c, o]), row + o
    return best


def spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places lo, lo + 1, ... of the index, ``n`` for each."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def exact_copies(
    codes: np.ndarray, starts: np.ndarray, pieces: list[tuple[np.ndarray, ...]], index: Index
) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(text, item) -> (0, begin, end) of the first place where the item stands as whole words."""
    firsts: dict[tuple[int, int], tuple[int, int, int]] = {}
    for at, lo, n in pieces:
        item, at = index.of[spread(lo, n)], np.repeat(at, n)
        same = whole_words(codes, at, index.q)
        for j in range(index.q):
            same &= codes[at + j] == np.array([i[j] for i in index.items], np.uint32)[item]
        text = np.searchsorted(starts, at, "right") - 1
        for t, i, begin in zip(text[same].tolist(), item[same].tolist(), (at - starts[text])[same].tolist()):
            firsts.setdefault((t, i), (0, begin, begin + index.q))
    return firsts


def find_in(parts: list[np.ndarray], index: Index) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(text, item) -> (edits, begin, end) of the best region, for the pairs that leak."""
    pad = np.zeros(int(index.edits.max()) + 2, np.uint32)
    codes = np.concatenate([x for part in parts for x in (part, pad)])
    starts = np.cumsum([0] + [len(p) + len(pad) for p in parts])
    hashes = qgram_hashes(codes, index.q)
    at = np.flatnonzero(index.present[hashes >> np.uint64(64 - index.bits)])
    lo, hi = np.searchsorted(index.hashes, hashes[at], "left"), np.searchsorted(index.hashes, hashes[at], "right")
    hit = hi > lo
    at, lo, n = at[hit], lo[hit], (hi - lo)[hit]
    if not len(at):
        return {}
    cuts = np.searchsorted(np.cumsum(n), np.arange(HITS, n.sum() + HITS, HITS), "left")
    cuts = np.unique(np.minimum(cuts, len(n) - 1))
    pieces = [slice(a, b + 1) for a, b in zip(np.r_[0, cuts[:-1] + 1], cuts)]
    if index.whole:
        return exact_copies(codes, starts, [(at[p], lo[p], n[p]) for p in pieces], index)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for p in pieces:
        which = spread(lo[p], n[p])
        item = index.of[which]
        step = index.edits[item] + 1
        band = (np.repeat(at[p], n[p]) - index.at[which]) // step + 1  # from 0: an item may begin before the text
        key = np.concatenate([item << 40 | band, item << 40 | (band - 1)])
        key, count = np.unique(key[key & ((1 << 40) - 1) >= 0], return_counts=True)
        keys, where = np.unique(np.concatenate([keys, key]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([counts, count]), len(keys)).astype(np.int64)
    item, band, count = keys >> 40, keys & ((1 << 40) - 1), counts
    reached = count >= index.bound[item]
    item, band = item[reached], band[reached]
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for k in range(0, len(item), ALIGNED_AT_ONCE):
        pairs, origins = [], []
        for i, b in zip(item[k : k + ALIGNED_AT_ONCE].tolist(), band[k : k + ALIGNED_AT_ONCE].tolist()):
            step = int(index.edits[i]) + 1
            first, size = (b - 1) * step, len(index.items[i])
            region = codes[max(first, 0) : first + 2 * step + size]
            if first < 0:
                region = np.concatenate([np.zeros(-first, np.uint32), region])
            pairs.append((index.items[i], region, 2 * step))
            origins.append((i, first))
        for (i, first), (edits, begin, end) in zip(origins, banded_edits(pairs)):
            if edits <= index.edits[i]:
                text = int(np.searchsorted(starts, first + end - 1, "right")) - 1
                new = (edits, first + begin - int(starts[text]), first + end - int(starts[text]))
                found[text, i] = min(new, found.get((text, i), new))
    return found


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The items in lists of about ``BLOCK`` characters."""
    held, size = [], 0
    for row in items.select(id_col, text_col).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaks(
    docs: DataFrame,
    items: DataFrame,
    params: Params = Params(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row for each text and item that leaks into it: ids, edits, and the best region's begin and end.

    Positions count characters of the normalised text.
    """
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    id_kind, item_kind = src.schema[0].dataType.simpleString(), items.schema[item_id_col].dataType
    schema = f"`{id_col}` {id_kind}, `{item_id_col}` {item_kind.simpleString()}, edits int, begin bigint, `end` bigint"
    item_type = pa.int64() if item_kind.simpleString() == "bigint" else None
    passes = []
    for block in blocks(items, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(build_index(block, params))

        def run(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            rows, first = [], 0
            for texts in groups_of(batch.column(1)):
                parts = [points(normal(t)) for t in texts]
                for index in shared.value:
                    for (t, i), found in sorted(find_in(parts, index).items()):
                        rows.append((first + t, index.item_ids[i], *found))
                first += len(texts)
            if rows:
                at, item, edits, begin, end = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(item, item_type), pa.array(edits, pa.int32()),
                     pa.array(begin, pa.int64()), pa.array(end, pa.int64())],
                    [id_col, item_id_col, "edits", "begin", "end"],
                )

        passes.append(map_batches(src, run, schema))
    if not passes:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, passes)

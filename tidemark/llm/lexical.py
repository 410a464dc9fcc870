"""Ranked lexical search by sort-based accumulation.

One pass over the texts leaves, for every document, its number of terms and the terms
that queries may ask for, as 64-bit hashes with their counts.  The filter for these is
a bitmap of fixed size, so the pass is one whatever the number of queries.  Scoring
reads that table once for each block of queries: the arrays of matched (item, document,
impact) are concatenated, their packed keys radix sorted, and equal keys summed by
``reduceat``.  The document axis is partitioned by ranges: a task owns a run of rows of
the table, so sums are complete where they are made, and only the best ``k`` of each
item and task, selected on a heap, are shuffled.

Scores are integers: a term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))), and an
occurrence count tf in a document of n terms adds w * (10^9 tf div (1000 tf + 12 m)),
m = 75 + 25 n N div L.  Repeated terms of an item count as often as they occur.

A null or empty text has no terms: such a document counts nowhere and such an item finds
nothing.  Every row of the documents is one, so repeated ids are ranked side by side; of
equal scores the smaller id comes first, a null id last.  Equal rows of items (id and
text) are one item; rows of one id with other texts are ranked each on its own.  Very
long texts are read in windows.  Other columns aren't read, whatever their names.  No
items or no documents give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, saved, trimmed, windows

#: Bits of the filter of asked terms, matches accumulated at a time, and pairs of item and term in a block of queries.
FILTER_BITS = 23
MATCHES = 1 << 21
BLOCK = 1 << 19
#: A byte's lower-case self where terms have it, else a space: ASCII digits, letters, and all bytes of other characters.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def term_counts(text: bytes) -> Counter[bytes]:
    counts: Counter[bytes] = Counter()
    for part in windows(text.translate(TERM_BYTES)):
        counts.update(part.split())
    return counts


def terms_of(text: Column) -> Column:
    """The terms of a text as an array, by the session's own functions."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1))


def term_filter(keys: DataFrame) -> np.ndarray:
    """Bitmap of the low bits of ``key``; its size doesn't depend on the number of keys."""
    low = keys.select(F.col("key").bitwiseAND((1 << FILTER_BITS) - 1).alias("k")).distinct()
    words = low.groupBy(F.shiftright("k", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k & 63 as int))")).alias("bits"))
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    got = words.toArrow()
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return out


def forward_index(docs: DataFrame, asked: np.ndarray) -> DataFrame:
    """``doc``, ``n`` and the asked terms' ``keys`` with ``tfs`` of every row of (doc, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bits, low = shared.value, (1 << FILTER_BITS) - 1
        ns, keys, tfs, sizes = [], [], [], [0]
        for value in batch.column(1):
            counts = term_counts(value.as_py() or b"")
            ns.append(counts.total())
            hashes = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in counts), np.uint64, len(counts)).view(np.int64)
            hit = bits[(hashes & low) >> 6] >> (hashes & 63) & 1 == 1
            keys.append(hashes[hit])
            tfs.append(np.fromiter(counts.values(), np.int64, len(counts))[hit])
            sizes.append(sizes[-1] + len(keys[-1]))
        lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), np.concatenate(x)) for x in (keys, tfs)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), *lists], ["doc", "n", "keys", "tfs"])

    kind = docs.schema[0].dataType.simpleString()
    return map_batches(docs, run, f"doc {kind}, n bigint, keys array<bigint>, tfs array<bigint>")


@dataclass
class Queries:
    """A block of items by term: term ``keys[t]`` adds ``weight[j]`` times an occurrence's gain to ``item[j]``, j in starts[t] to starts[t + 1]."""

    keys: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    uids: np.ndarray


def block_of(rows: pa.Table, n_docs: int) -> Queries:
    """Rows of uid, key, q and df, weighted and grouped by key."""
    weights = {df: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in pc.unique(rows.column("df")).to_pylist()}
    rows = rows.sort_by([("key", "ascending"), ("uid", "ascending")])
    col = lambda c: rows.column(c).to_numpy()
    keys, starts = np.unique(col("key"), return_index=True)
    uids, item = np.unique(col("uid"), return_inverse=True)
    weight = col("q") * np.array([weights[d] for d in rows.column("df").to_pylist()], np.int64)
    return Queries(keys, np.append(starts, len(item)), item, weight, uids)


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """Order of non-negative keys below 2^bits: stable passes over 16-bit digits, which numpy sorts by radix."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        digit = (keys[order] >> shift & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
    return order


def accumulate(q: Queries, doc: np.ndarray, term: np.ndarray, gain: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums by (item, document), in that order, of the matches of postings (document, term of ``q``, gain)."""
    fan = q.starts[term + 1] - q.starts[term]
    at = np.repeat(q.starts[term] - np.r_[0, np.cumsum(fan)[:-1]], fan) + np.arange(fan.sum())
    width = max(n_docs - 1, 1).bit_length()
    packed = q.item[at] << width | np.repeat(doc, fan)
    order = radix_order(packed, width + max(len(q.uids) - 1, 1).bit_length())
    packed = packed[order]
    first = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]])
    sums = np.add.reduceat((q.weight[at] * np.repeat(gain, fan))[order], first)
    return packed[first] >> width, packed[first] & (1 << width) - 1, sums


def chunks(fan: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of documents whose matches come to about ``size``, one document at least."""
    total = np.cumsum(fan)
    at = 0
    while at < len(fan):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
        yield at, end
        at = end


def best_of(index: DataFrame, q: Queries, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``uid``, ``doc`` and ``score`` of the ``k`` best of each item and task."""
    shared = index.sparkSession.sparkContext.broadcast(q)  # about BLOCK pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best: dict[int, list[tuple]] = {}
        kind = None
        for batch in batches:
            ids, keys, tfs = batch.column(0), batch.column(2), batch.column(3)
            kind = ids.type
            order = pc.sort_indices(pa.table({"d": ids}), sort_keys=[("d", "ascending")], null_placement="at_end").to_numpy()
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            m = np.array([75 + 25 * n * n_docs // n_terms for n in batch.column(1).to_pylist()], np.int64)
            doc = np.repeat(np.arange(len(ids)), np.diff(keys.offsets.to_numpy()))
            flat, tf = keys.flatten().to_numpy(), tfs.flatten().to_numpy()
            term = np.minimum(np.searchsorted(q.keys, flat), len(q.keys) - 1)
            hit = q.keys[term] == flat
            doc, term, tf = doc[hit], term[hit], tf[hit]
            gain = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
            fan = np.bincount(doc, q.starts[term + 1] - q.starts[term], len(ids)).astype(np.int64)
            for a, b in chunks(fan, MATCHES):
                lo, hi = np.searchsorted(doc, (a, b))
                if lo == hi:
                    continue
                items, docs, sums = accumulate(q, doc[lo:hi] - a, term[lo:hi], gain[lo:hi], b - a)
                edges = np.flatnonzero(np.r_[True, items[1:] != items[:-1], True])
                for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    held = best.get(int(items[x]), [])
                    floor = -held[-1][0] if len(held) == k else 1
                    some = x + np.flatnonzero(sums[x:y] >= floor)
                    if len(some) > k:
                        some = some[np.lexsort((rank[docs[some] + a], -sums[some]))[:k]]
                    if len(some):
                        new = [(-int(sums[j]), 1, 0) if (d := ids[int(docs[j]) + a].as_py()) is None else (-int(sums[j]), 0, d) for j in some]
                        best[int(items[x])] = heapq.nsmallest(k, held + new)
        if best:
            found = [(int(q.uids[i]), None if null else d, -s) for i, held in best.items() for s, null, d in held]
            uid, d, score = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(d, kind), pa.array(score, pa.int64())], ["uid", "doc", "score"])
        trimmed()

    return index.mapInArrow(run, f"uid bigint, doc {index.schema['doc'].dataType.simpleString()}, score bigint")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``item_col``, ``rank``, ``id_col`` and ``score`` of each item's ``k`` highest-scoring documents."""
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("t")).distinct()
    asked = asked.withColumn("uid", F.monotonically_increasing_id())
    asked = asked.select("uid", "item", F.explode(terms_of(F.col("t"))).alias("term"))
    asked = saved(asked.groupBy("uid", "item", F.xxhash64("term").alias("key")).agg(F.count("*").alias("q")), "asked")
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").cast("binary").alias("t"))
    index = saved(forward_index(source, term_filter(asked)), "postings")
    of = index.where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = index.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("df"))
    asked = saved(asked.join(df, "key"), "weighted")
    blocks = -(-asked.count() // BLOCK)
    kind = index.schema["doc"].dataType.simpleString()
    best = docs.sparkSession.createDataFrame([], f"uid bigint, doc {kind}, score bigint")
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b).select("uid", "key", "q", "df").toArrow()
        if rows.num_rows:
            best = best.unionByName(best_of(index, block_of(rows, of.docs), of.docs, of.terms, k))
    rank = F.expr("row_number() over (partition by uid order by score desc, doc asc nulls last)")
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    names = asked.select("uid", F.col("item").alias("_item")).distinct()
    return best.join(names, "uid").select(F.col("_item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def oracle(k: int = 20) -> str:
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS terms FROM documents
), sized AS (SELECT doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
t AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sized),
tf AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL
), df AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, t GROUP BY term, big_n),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM benchmark
  ) GROUP BY ALL
), scored AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * big_n) // big_l)))))::BIGINT AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term), t GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0
) SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""

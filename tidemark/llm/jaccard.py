"""N-gram Jaccard join: components of documents whose shingle sets are similar enough.

Size-aware heavy-light join.  Equal sets are one node, so copies cost one row each.
Let two sets of n and m shingles link if their overlap is at least
o(n, m) = percent (n + m) / (100 + percent), rounded up.

* Light sets, up to a boundary size: for each size m that a light partner can have,
  all subsets of o(n, m) shingles are enumerated; linked sets share such a subset.
* Heavy sets: shingles are ordered by how many documents have them, rarest first.
  The first n - o(n, n..) + ``common`` shingles of a set go to inverted lists, and
  linked sets share at least ``common`` of them.  Light sets that a heavy one can
  reach are in the lists as well.

The boundary is the largest size at which enumerating a set's subsets costs no
more than scanning its lists, by the mean list length that the counts predict.
That mean is too high where few shingles are very common, so the boundary is 24 at
most: a set then has 2,600 subsets or so.  Larger sets take the other way, which is
exact for all sizes.
Counts are kept in a fixed number of buckets by hash; they cover every document,
and any order gives the same result.

Lists are scanned in two rounds, and pairs are verified on whole texts:

1. Each set against the pivot it shares most lists with: the set in which the
   list's shingle comes earliest, so one with few shingles of its own.  This joins
   a group of n copies by n - 1 links.
2. Then only pairs of different components matter.  In each list, sets outside the
   list's main component meet all others.  Of the shingles before a shared one,
   those that no other set has in its lists can't be shared; so each row knows how
   much overlap its set can still reach, and rows meet only if both reach enough.
   Pairs with enough lists in common, and room for the overlap, are verified too.

So no link between two components is lost, and a group's pairs aren't enumerated.
Hot lists are cut into salted parts whose pivots meet in a list of their own.

Shingles are compared by 64-bit hashes.  Sets have 64-bit names; a second hash finds
different sets of one name, and these go by that hash.  A set stands for all texts
that have it and takes one of them, by its own hash, to be verified; so rows may
repeat, and an id may be null or have several texts: each row gets the component of
its own text, named by the smallest id in it that isn't null.  Null and wordless
texts have the empty set and link with nothing, not even each other.  Other columns
are not read, whatever their names.  No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop_saved, groups_of, join_counted, map_batches, saved, shuffle_width, trimmed
from tidemark.llm.components import connected_components

SKETCH_BITS = 18
BITMAP_BITS = 23
SALT_ROWS = 1 << 20
LARGEST_LIGHT = 24
PART, HELD = 4096, 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_SALTS = (0xA5A5A5A5A5A5A5A5, 0x3C6EF372FE94F82B)


@dataclass(frozen=True)
class Params:
    """Shingles of ``words`` words; sets link at ``percent`` of their union."""

    words: int = 4
    percent: int = 85
    common: int = 3

    def least_overlap(self, n: int, m: int) -> int:
        return -(-self.percent * (n + m) // (100 + self.percent))

    def prefix(self, n: int) -> int:
        """Shingles of a set of n that go to the lists."""
        return min(n, n - -(-self.percent * n // 100) + self.common)

    def partners(self, n: int) -> range:
        """Sizes that a set of n can link with."""
        return range(-(-self.percent * n // 100), 100 * n // self.percent + 1)

    def subsets(self, n: int, light: int) -> list[tuple[int, int]]:
        """(partner size, subset size) to enumerate; equal sets need none."""
        sizes = ((m, self.least_overlap(n, m)) for m in self.partners(n) if 0 < m <= light)
        return [(m, o) for m, o in sizes if o <= min(n, m) and not o == n == m]


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        """Idle workers hold none."""
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_BASE, -k, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()
_BYTES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted.

    A shingle's hash is a polynomial of its bytes, words joined by single spaces.
    """
    cut = [t.encode().lower().split() for t in texts]
    joined = b" ".join(b" ".join(ws) for ws in cut) + b" "
    data = np.frombuffer(joined, np.uint8)
    up, down = _POWERS.to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:-1], out=total[1:])
    sizes = np.fromiter((len(w) for ws in cut for w in ws), np.int64, sum(map(len, cut)))
    out, at, first = [], 0, 0
    gaps = np.fromiter((max(len(ws), 1) for ws in cut), np.int64, len(cut))
    lengths = np.fromiter((sum(map(len, ws)) for ws in cut), np.int64, len(cut)) + gaps
    for ws, length in zip(cut, lengths.tolist()):
        n = len(ws)
        if not n:
            out.append(np.zeros(0, np.uint64))
        else:
            ends = at + np.cumsum(sizes[first : first + n] + 1) - 1
            starts = ends - sizes[first : first + n]
            k = min(words, n)
            s, e = starts[: n - k + 1], ends[k - 1 :]
            h = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
            out.append(np.unique(mixed(h)))
        first += n
        at += length
    return out


def set_ids(hashes: np.ndarray) -> tuple[int, int]:
    """Two independent signed 64-bit names of a set."""
    sums = (int(mixed(hashes ^ np.uint64(salt)).sum(dtype=np.uint64)) + len(hashes) * _BASE for salt in _SALTS)
    one, two = (int(np.uint64(h & _MASK).astype(np.int64)) for h in sums)
    return one, two


def set_id(hashes: np.ndarray, clashing: frozenset[int] = frozenset()) -> int:
    """The first name, or the second where different sets share the first."""
    one, two = set_ids(hashes)
    return two if one in clashing else one


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def described(docs: DataFrame, p: Params, id_col: str, text_col: str) -> DataFrame:
    """(id, th, n, sid, alt) of each row, and rows (bucket, count) with the shingle counts of each task.

    ``th`` is the hash of the text, ``sid`` and ``alt`` are the names of its set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        kind = None
        for batch in batches:
            kind, n, names = batch.column(0).type, [], []
            for texts in groups_of(batch.column(2)):
                sets = shingle_sets(texts, p.words)
                n += map(len, sets)
                names += map(set_ids, sets)
                counts += np.bincount(bucket_of(np.concatenate(sets)), minlength=len(counts))
            none = pa.nulls(len(n), pa.int64())
            sid, alt = (pa.array([x[k] for x in names], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), sid, alt, none, none], NAMES)
        at = np.flatnonzero(counts)
        if len(at):
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), kind), *[none] * 4, pa.array(at), pa.array(counts[at])], NAMES)
        _POWERS.forget()
        trimmed()

    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text)
    id_kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"id {id_kind}, " + ", ".join(f"{c} bigint" for c in NAMES[1:]))


NAMES = ["id", "th", "n", "sid", "alt", "bucket", "count"]


def light_boundary(counts: np.ndarray, p: Params) -> int:
    """Largest size whose sets are cheaper to enumerate than to look up."""
    total = max(float(counts.sum()), 1.0)
    mean_list = max(float((counts.astype(float) ** 2).sum()) / total - total / len(counts), 1.0)
    n = 1
    while n < LARGEST_LIGHT:
        subsets = sum(comb(n + 1, o) for _, o in p.subsets(n + 1, n + 1))
        if subsets > p.prefix(n + 1) * (1 + mean_list):
            break
        n += 1
    return n


def keys_of(hashes: np.ndarray, counts: np.ndarray, light: int, p: Params) -> tuple[list[int], list[int]]:
    """(keys, positions) of a set; a subset's position is -1."""
    n = len(hashes)
    keys: list[int] = []
    at: list[int] = []
    if n <= light:
        parts = mixed(hashes ^ np.uint64(0x5DEECE66D)).tolist()
        whole = sum(parts)
        for m, o in p.subsets(n, light):
            tag = (min(n, m) << 20 | max(n, m) << 8 | o) * _BASE
            keys += [(whole - sum(gone) + tag) & _MASK for gone in combinations(parts, n - o)]
        at = [-1] * len(keys)
    if n and p.partners(n)[-1] > light:
        order = np.lexsort((hashes, counts[bucket_of(hashes)]))[: p.prefix(n)]
        keys += hashes[order].tolist()
        at += range(len(order))
    return keys, at


def list_rows(docs: DataFrame, counts: np.ndarray, light: int, p: Params, text_col: str, clashing: frozenset[int]) -> DataFrame:
    """(key, salt, sid, n, pos): every set in each of its lists."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # 2^SKETCH_BITS numbers

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for texts in groups_of(batch.column(0)):
            key, pos, sid, n = [], [], [], []
            for hashes in shingle_sets(texts, p.words):
                keys, at = keys_of(hashes, counts, light, p)
                if keys:
                    key.append(np.array(keys, np.uint64))
                    pos.append(np.array(at, np.int32))
                    sid.append(np.full(len(keys), set_id(hashes, clashing)))
                    n.append(np.full(len(keys), len(hashes), np.int32))
            if key:
                key, pos, sid, n = (np.concatenate(x) for x in (key, pos, sid, n))
                salts = counts[bucket_of(key)] // SALT_ROWS + 1
                salt = (sid % salts).astype(np.int32)
                salt[salts == 1] = -1
                arrays = (key.view(np.int64), salt, sid, n, pos)
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["key", "salt", "sid", "n", "pos"])

    return map_batches(docs.select(F.col(text_col).cast("string")), run, "key bigint, salt int, sid bigint, n int, pos int", _POWERS.forget)


def with_pivots(rows: DataFrame) -> DataFrame:
    """Rows of lists with two sets or more, each with the set that has the list's key earliest; repeated rows go.

    Partitions are sorted, so a list streams by and only its pivot is held.  Of salted lists
    (salt >= 0) single rows stay, for their pivots meet later.
    """
    names = ["key", "salt", "sid", "n", "pos", "pivot", "pivot_n", "pivot_pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, with its pivot and whether it went out
        for batch in batches:
            key, salt, sid, n, pos = (batch.column(c).to_numpy() for c in range(5))
            if held is not None:
                key, salt, sid, n, pos = (np.r_[h, a] for h, a in zip(held[0], (key, salt, sid, n, pos)))
            if not len(key):
                continue
            new = np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]
            fresh = new | np.r_[True, sid[1:] != sid[:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            pivot, pivot_n, pivot_pos = sid[first], n[first], pos[first]
            more = fresh & ~new  # a further set of its list
            several = np.zeros(len(key), bool)
            several[first[more]] = True
            out = (fresh & several[first]) | (new & (salt >= 0))
            if held is not None:
                same = first == 0
                pivot[same], pivot_n[same], pivot_pos[same] = held[1]
                out |= fresh & same & held[2]
                out[0] = not held[2] and (several[0] or salt[0] >= 0)
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[at]) for a in (key, salt, sid, n, pos, pivot, pivot_n, pivot_pos)], names
            )
            last = len(key) - 1
            gone = bool(out[last]) or (held is not None and first[last] == 0 and bool(held[2])) or bool(several[first[last]])
            held = (key[-1:], salt[-1:], sid[-1:], n[-1:], pos[-1:]), (pivot[last], pivot_n[last], pivot_pos[last]), gone

    dealt = rows.repartition(shuffle_width(rows.sparkSession), "key", "salt").sortWithinPartitions("key", "salt", "pos", "sid")
    return dealt.mapInArrow(run, "key bigint, salt int, sid bigint, n int, pos int, pivot bigint, pivot_n int, pivot_pos int")


def with_reach(lists: DataFrame, p: Params) -> DataFrame:
    """Adds ``rank``, how many of a set's earlier shingles other sets have in their lists.

    The others can't be shared; rows whose set can't reach enough overlap with any partner go.
    """
    before = Window.partitionBy("sid").orderBy("pos", "key").rowsBetween(Window.unboundedPreceding, -1)
    shared = F.coalesce(F.sum(F.when(F.col("pos") >= 0, 1).otherwise(0)).over(before), F.lit(0))
    alone = F.when(F.col("pos") >= 0, F.col("pos") - shared).otherwise(0)
    rows = lists.withColumns({"rank": shared.cast("int"), "reach": F.col("n") - alone})
    return rows.where(f"100 * reach >= {p.percent} * n or salt >= 0").drop("reach")


def overlap_needed(n: str, m: str, p: Params) -> Column:
    return F.ceil(p.percent * (F.col(n) + F.col(m)) / F.lit(100.0 + p.percent) - 1e-9)


def promising(p: Params) -> Column:
    """Whether shared keys (k of them; the last at a and b; ``exact`` if one is a subset) admit a link."""
    room = F.col("k") + F.least(F.col("n") - F.col("a") - 1, F.col("m") - F.col("b") - 1)
    return F.col("exact") | ((F.col("k") >= p.common) & (room >= overlap_needed("n", "m", p)))


def paired(rows: DataFrame, p: Params) -> DataFrame:
    """(x, y) of those pairs (x, y, n, m, i, j: one row for each shared key) that may link."""
    sized = rows.where(
        f"100 * least(n, m) >= {p.percent} * greatest(n, m)"
    )
    found = sized.groupBy("x", "y").agg(
        F.count("*").alias("k"),
        F.max("n").alias("n"),
        F.max("m").alias("m"),
        F.max("i").alias("a"),
        F.max("j").alias("b"),
        (F.min("i") < 0).alias("exact"),
    )
    return found.where(promising(p)).select("x", "y", "k")


def power_of_two(x: Column) -> Column:
    """The least power of two that isn't below ``x``, 1 at least."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(x, F.lit(1.0))))).cast("long")


def scanned(split: DataFrame, p: Params) -> DataFrame:
    """(x, y) of different components that may link: the set of the smaller component scans its lists.

    ``split``: key, sid, n, pos, rank, c and its size, main (size and id of the list's largest component), members
    (the list's rows).  A list comes in parts of about ``PART`` sets, by the low bits of their names.  An asking set's
    meetings are counted a slot at a time: its slots are as many as its longest list has parts, or more if its lists have
    over ``HELD`` rows a slot, and go by the same bits, so all keys that two sets share meet in one slot, however the
    lists differ in length.  What is shuffled is, for each set outside its list's largest component, the list: sets inside
    it only ever stand in lists.
    """
    split = split.withColumn("parts", power_of_two(F.col("members") / PART))
    member = F.struct(F.col("sid").alias("s"), "c", "size", "n", "pos", "rank")
    listed = split.groupBy("key", F.col("sid").bitwiseAND(F.col("parts") - 1).alias("part")).agg(F.collect_list(member).alias("sets"))
    asked = split.where(F.struct("size", "c") < F.col("main"))
    wide = asked.groupBy("sid").agg(F.greatest(F.max("parts"), power_of_two(F.sum("members") / HELD)).alias("slots"))
    asked = asked.join(wide, "sid").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = asked.join(listed, ["key", "part"]).select("sid", F.col("part").alias("slot"), "n", "c", "size", "pos", "rank", "sets", "parts", "slots")
    met = met.where("parts = slots").drop("parts", "slots").unionByName(slotted(met.where("parts < slots")))
    dealt = met.repartition(shuffle_width(split.sparkSession), "sid", "slot").sortWithinPartitions("sid", "slot")

    def pairs(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        sid, _, n, c, size = rows[0][:5]
        other, oc, osize, m, j, r, i, q = (np.concatenate(x) for x in zip(*map(_spread, rows)))
        ok = (osize > size) | ((osize == size) & (oc > c))
        ok &= 100 * np.minimum(m, n) >= p.percent * np.maximum(m, n)
        order = np.flatnonzero(ok)
        order = order[np.argsort(other[order], kind="stable")]
        if not len(order):
            return
        other, m, j, r, i, q = (x[order] for x in (other, m, j, r, i, q))
        at = np.flatnonzero(np.r_[True, other[1:] != other[:-1]])
        k = np.diff(np.r_[at, len(other)])
        need = -(-p.percent * (n + m[at]) // (100 + p.percent))
        early = np.minimum.reduceat(np.minimum(q, r) + 1 + np.minimum(n - i - 1, m - j - 1), at)
        late = k + np.minimum(n - np.maximum.reduceat(i, at) - 1, m[at] - np.maximum.reduceat(j, at) - 1)
        link = (np.minimum.reduceat(j, at) < 0) | ((k >= p.common) & (early >= need) & (late >= need))
        for x in other[at][link].tolist():
            yield (x, sid) if x < sid else (sid, x)

    def table(found: list[tuple[int, int]]) -> pa.RecordBatch:
        x, y = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(7)))):
                if held and held[0][:2] != row[:2]:
                    out += pairs(held)
                    held = []
                held.append((*row, batch.column(7)[k].values))
            yield table(out)
        yield table(list(pairs(held)) if held else [])

    return dealt.mapInArrow(run, "x bigint, y bigint").distinct()


def slotted(met: DataFrame) -> DataFrame:
    """Parts of lists, cut by the slots of the set that asks."""
    schema = met.drop("parts", "slots").schema

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kinds = batch.schema.field("sets").type.value_type
        for k, slots in enumerate(batch.column("slots").to_pylist()):
            sets = batch.column("sets")[k].values
            slot = sets.field(0).to_numpy() & (slots - 1)
            order = np.argsort(slot, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(slot[order]) != 0])
            offsets = pa.array(np.r_[first, len(order)], pa.int32())
            own = [batch.column(c).take(pa.array([k] * len(first))) for c in ("sid", "n", "c", "size", "pos", "rank")]
            cut = pa.ListArray.from_arrays(offsets, sets.take(pa.array(order)).cast(kinds))
            yield pa.RecordBatch.from_arrays([own[0], pa.array(slot[order][first]), *own[1:], cut], schema.names)

    return map_batches(met, run, schema)


def _spread(row: tuple) -> tuple[np.ndarray, ...]:
    """A list part's columns (set, component, its size, n, position, rank), and the asking set's position and rank."""
    columns = [row[7].field(k).to_numpy().astype(np.int64) for k in range(6)]
    return *columns, np.full(len(columns[0]), row[5]), np.full(len(columns[0]), row[6])


def verified(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """The pairs (x, y) that link, by their whole texts; ``texts``: (sid, text)."""
    y = pairs.select("x", "y").join(texts.select(F.col("sid").alias("y"), F.col("text").alias("yt")), "y")
    both = y.join(texts.select(F.col("sid").alias("x"), F.col("text").alias("xt")), "x").select("x", "y", "xt", "yt")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        links, known_x, known = [], None, None
        for k, (x, xt, yt) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3))):
            if x != known_x:
                known_x, known = x, shingle_sets([xt.as_py()], p.words)[0]
            other = shingle_sets([yt.as_py()], p.words)[0]
            shared = len(np.intersect1d(known, other, assume_unique=True))
            if 100 * shared >= p.percent * (len(known) + len(other) - shared):
                links.append(k)
        at = pa.array(links, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["x", "y"])

    return map_batches(both, run, "x bigint, y bigint", _POWERS.forget)


def texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sid, text) of the ``wanted`` (id, th, sid).

    A bitmap of fixed size keeps most other texts out of the shuffle; the join decides.
    """
    slot = F.pmod(F.xxhash64("id", "th"), F.lit(1 << BITMAP_BITS)).alias("slot")
    words = wanted.select(slot).selectExpr("shiftright(slot, 6) AS w", "shiftleft(1L, int(slot % 64)) AS bit")
    bitmap = words.groupBy("w").agg(F.bit_or("bit").alias("bits"))  # 2^(BITMAP_BITS - 6) rows at most
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    src = src.select("*", slot).withColumn("w", F.shiftright("slot", 6))
    near = src.join(F.broadcast(bitmap), "w").where("getbit(bits, int(slot % 64)) = 1")
    same = (near["th"] == wanted["th"]) & near["id"].eqNullSafe(wanted["id"])
    return near.join(wanted, same).select("sid", "text")


def components(
    docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, n_shingles and component_id (the smallest id reachable by links) of every row."""
    p = params
    seen = saved(described(docs, p, id_col, text_col), "sets")
    sketch = seen.where("bucket is not null").groupBy("bucket").agg(F.sum("count").alias("c")).toArrow()
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    counts[sketch.column("bucket").to_numpy()] = sketch.column("c").to_numpy()
    rows = seen.where("bucket is null").select("id", "th", "n", "sid", "alt")
    clashes = rows.where("n > 0").groupBy("sid").agg(F.min("alt").alias("a"), F.max("alt").alias("b")).where("a <> b")
    clashing = frozenset(r.sid for r in clashes.select("sid").collect())  # about (sets)^2 / 2^65
    if clashing:
        rows = rows.withColumn("sid", F.when(F.col("sid").isin(list(clashing)), F.col("alt")).otherwise(F.col("sid")))
    sets = rows.where("n > 0").groupBy("sid").agg(F.min("id").alias("rep"), F.min(F.struct("id", "th")).alias("of"))

    light = light_boundary(counts, p)
    lists = saved(with_reach(with_pivots(list_rows(docs, counts, light, p, text_col, clashing)), p), "lists")
    pivots = lists.where("salt >= 0").select(
        "key", F.lit(-1).alias("salt"), F.col("pivot").alias("sid"), F.col("pivot_n").alias("n"), F.col("pivot_pos").alias("pos")
    )
    stars = lists.drop("rank").unionByName(with_pivots(pivots.distinct()))
    sharing = lists.select("sid").distinct().join(sets, "sid").select("of.id", "of.th", "sid")
    texts = saved(texts_of(docs, sharing, id_col, text_col).dropDuplicates(["sid"]), "texts")

    star = paired(
        stars.where("sid <> pivot").select(
            F.col("pivot").alias("x"), F.col("sid").alias("y"), F.col("pivot_n").alias("n"), F.col("n").alias("m"),
            F.col("pivot_pos").alias("i"), F.col("pos").alias("j"),
        ), p,
    )
    best = star.groupBy("y").agg(F.max(F.struct("k", "x")).alias("b")).select("b.x", "y")
    first = saved(verified(best, texts, p), "links")

    near = connected_components(first, "x", "y").withColumnRenamed("node", "sid")
    near = near.join(near.groupBy("component").agg(F.count("*").alias("size")), "component")
    own = lists.select("key", "sid", "n", "pos", "rank").join(near, "sid", "left").withColumns(
        {"c": F.coalesce("component", "sid"), "size": F.coalesce("size", F.lit(1))}
    )
    own = saved(own.drop("component"), "own")
    group = F.struct("size", "c")
    main = own.groupBy("key").agg(F.max(group).alias("main"), F.min(group).alias("least"), F.count("*").alias("members"))
    main = saved(main.where("least < main").drop("least"), "main")
    split = saved(join_counted(own, main, ["key"], own.count(), "members"), "split")
    second = verified(scanned(split, p), texts, p)
    linked = connected_components(first.unionByName(second), "x", "y")

    roots = sets.join(linked.withColumnRenamed("node", "sid"), "sid", "left").withColumn("c", F.coalesce("component", "sid"))
    least = roots.groupBy("c").agg(F.min("rep").alias("least"))
    named = saved(roots.join(least, "c").select("sid", "least"), "components")
    for done in (lists, texts, first, own, main, split):
        drop_saved(done)
    out = rows.join(named, "sid", "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))

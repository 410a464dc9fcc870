"""Sharding by vector bin packing of bytes, tokens and rows.

The unit is a group of equal texts.  Items are placed largest first, each on the
shard for which the dot product of the item's load and the shard's residual
capacity is highest, among those it fits in.

What the driver packs is bounded: groups that reach 1/``grain`` of a shard in some
dimension are items of their own (at most 3 * grain * shards), all others join
one of grain * shards bundles by the hash of their text.  Only a group that no
shard can hold, because it exceeds a shard's share of some dimension, is split into
as few pieces as fit, by the hash of the id, for one text may hold a third of all rows.

The law that holds is ``bytes``: sizes near equal.  Slots count the rows of a
shard from 0, through the counts of small cells.  Null texts are one group with
no bytes besides the row's overhead, as are empty texts another; with no rows the
result is empty.  Ids may be null or repeat: every row has a slot of its own, and
which of equal rows has which doesn't show.  Of shards with equal room the first
is taken.  A row is never split, so a text beyond a shard's share makes that shard
larger.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import saved, utf8_size

OVERHEAD = 16
CELL_ROWS = 20_000
LOADS = ("bytes", "tokens", "rows")


def pack(loads: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item; loads are shares of one shard's capacity, in several dimensions.

    An item goes to a shard that has room for it in every dimension.  Where none has, the law's dimension, the first,
    decides alone, and where it fits nowhere, it goes to the shard with most room in that.
    """
    residual = np.ones((shards, loads.shape[1]))
    out = np.zeros(len(loads), np.int64)
    for i in np.lexsort((np.arange(len(loads)), -loads.max(axis=1, initial=0))):
        fit = residual @ loads[i]
        inside = (residual >= loads[i]).all(axis=1)
        inside = inside if inside.any() else residual[:, 0] >= loads[i, 0]
        out[i] = np.argmax(np.where(inside, fit, -np.inf)) if inside.any() else np.argmax(residual[:, 0])
        residual[out[i]] -= loads[i]
    return out


def shard(
    docs: DataFrame, shards: int, grain: int = 256, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, size, text_crc32, shard and slot of every row."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = saved(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("key"),
            (utf8_size(text) + OVERHEAD).alias("bytes"),
            (utf8_size(text) - utf8_size(F.replace(text, F.lit(" "))) + 1).alias("tokens"),
            F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"),
            F.lit(1).cast("long").alias("rows"),
        ),
        "rows",
    )
    totals = rows.agg(*(F.sum(c).alias(c) for c in LOADS)).first()
    if not totals.rows:
        return rows.select(
            F.col("id").alias(id_col), F.col("bytes").alias("size"), "text_crc32",
            F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"),
        )
    room = {c: totals[c] / shards for c in LOADS}
    fill = F.greatest(*(F.col(c) / room[c] for c in LOADS))
    groups = rows.groupBy("key").agg(*(F.sum(c).alias(c) for c in LOADS)).withColumn("fill", fill)
    large = groups.where(F.col("fill") * grain >= 1).select("key", F.ceil("fill").alias("pieces"))
    bundle = F.concat(F.lit("bundle-"), F.pmod(F.xxhash64("key"), F.lit(grain * shards)).cast("string"))
    piece = F.concat_ws("-", "key", F.pmod(F.xxhash64("id", F.lit("piece")), "pieces").cast("string"))
    named = rows.join(F.broadcast(large), "key", "left").withColumn(
        "item", F.when(F.col("pieces").isNull(), bundle).otherwise(piece)
    )
    items = named.groupBy("item").agg(*(F.sum(c).alias(c) for c in LOADS)).orderBy("item").collect()
    at = pack(np.array([[r[c] / room[c] for c in LOADS] for r in items]), shards)
    places = spark.createDataFrame([(r.item, int(s)) for r, s in zip(items, at)], "item string, shard int")
    cells = max(1, -(-int(totals.rows) // (CELL_ROWS * shards)))
    placed = named.join(F.broadcast(places), "item").withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(cells)))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "cell").count().withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "key")) - 1
    return (
        placed.withColumn("within", within)
        .join(offsets.select("shard", "cell", "first"), ["shard", "cell"])
        .select(
            F.col("id").alias(id_col), F.col("bytes").alias("size"), "text_crc32", "shard",
            (F.col("first") + F.col("within")).cast("long").alias("slot"),
        )
    )

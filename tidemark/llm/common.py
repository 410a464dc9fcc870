"""Shared parts of the llm operators: tables, scratch storage, Arrow helpers.

Everything that must outlive a stage is written as Parquet below the shared
folder that ``spark.checkpoint.dir`` names, so that the loss of an executor only
costs the tasks it was running.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The C library's call for it, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Keys with this part of all rows or more are joined by broadcast, so there are as many at most.
HOT_KEYS = 4096

#: Characters that separate words in the contracts: space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Spark's reader resolves the path, whatever the store."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one where none is set and all runs on this machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        root = f"file://{tempfile.gettempdir()}/tidemark-scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and return it as a fresh scan: lineage ends here."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tidemark/{uuid.uuid4().hex}-{name}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete a table that ``saved`` wrote and that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_counted(rows: DataFrame, groups: DataFrame, on: list[str], total: int, count: str = "n") -> DataFrame:
    """Inner join of ``rows`` with their ``groups``, of which ``count`` tells how many of the ``total`` rows each key has.

    Rows of hot keys meet the broadcast groups where they are, so no key comes to one task; the others are shuffled,
    whatever the size of ``groups``.  It has no null key and is read three times, so it should be a table or cheap.
    """
    n = F.col(count) * HOT_KEYS
    hot = F.broadcast(groups.where(n >= total))  # HOT_KEYS rows at most
    cold = rows.join(hot, on, "left_anti").join(groups.where(n < total).hint("merge"), on)
    return rows.join(hot, on).unionByName(cold)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trimmed() -> None:
    """Gives freed memory of this Python worker back, so that idle workers of earlier stages stay small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def map_batches(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]],
    schema: T.StructType | str,
    after: Callable[[], None] | None = None,
) -> DataFrame:
    """``fn`` over every Arrow batch, then ``after``; memory is bounded by one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)
        if after:
            after()
        trimmed()

    return df.mapInArrow(run, schema)


def groups_of(column: pa.Array, size: int = 1 << 18) -> Iterator[list[str]]:
    """The texts of a column, null as empty, in lists of about ``size`` characters."""
    held, n = [], 0
    for value in column:
        held.append(value.as_py() or "")
        n += len(held[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def windows(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Parts of about ``size`` bytes of a text whose words are separated by spaces; no word is cut."""
    at = 0
    while len(text) - at > size:
        cut = text.rfind(b" ", at, at + size) + 1 or text.find(b" ", at + size) + 1 or len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def lowest_ids(docs: DataFrame, id_col: str, n: int) -> DataFrame:
    """The ``n`` ids with the smallest hash: a bounded sample that does not depend on the order of rows."""
    return docs.select(F.col(id_col), F.xxhash64(id_col).alias("_h")).distinct().orderBy("_h", id_col).limit(n)


def utf8_size(text: Column) -> Column:
    """Bytes of the text in UTF-8, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")

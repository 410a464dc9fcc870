"""Corpus pipeline: language, repeated lines, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
``run`` writes every stage's rows as Parquet in the shared folder and reads them
again for the next.  All stages but the last return the columns of ``documents``.

* language: texts without a letter, or null, go, and those in no language that the
  kernel model has learnt (``langid.recognised``); without a model all with a letter stay.
* lines: later copies of repeated runs of 8 words or more are deleted, and of shorter
  lines that 10 documents or more have; a document goes if all its lines with a word
  were such copies.
* near_copies: documents that share 80 % of their 5-word shingles are linked; of each
  component one row with the smallest id stays.
* benchmark: documents that hold a benchmark item go.
* tokens: ids of the texts, counted and digested, and decoded again.

A null text has no letter and goes in the first stage; the later ones would keep it.  An id may
be null or repeat: stages judge rows by themselves, but for near_copies, in which equal rows
(id and text) are one document, and benchmark, in which all rows of an id go with one of them.
Of equally good rows the smallest (id, hash of the text) stays.  Texts of any length are read
whole.  No rows give no rows.  Columns besides id, text and language pass through, whatever
their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, jaccard, langid, linededup
from tidemark.llm.common import saved, table
from tidemark.llm.queries import VOCABULARY

NEAR = jaccard.Params(words=5, percent=80)
OFTEN = 10


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ..., which no operator uses, and the new name of each."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    d, at = renamed(docs)
    keep = tuple(n for c, n in at.items() if c not in ("doc_id", "text"))
    judged = langid.predict(d, model, at["doc_id"], at["text"], keep=keep, with_text=True, with_known=True)
    return judged.where(langid.recognised()).select(*at.values()).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    d, at = renamed(docs)
    done = linededup.dedup(d, id_col=at["doc_id"], text_col=at["text"], often=OFTEN)
    emptied = (F.col("n_removed") > 0) & ~F.col(at["text"]).rlike(r"[^\x20\x09-\x0D]")
    return done.where(~F.coalesce(emptied, F.lit(False))).select(*at.values()).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    d, at = renamed(docs)
    row = F.struct(F.col(at["doc_id"]), F.xxhash64(at["text"]).alias("th"))  # rows of one id and other texts are other documents
    groups = jaccard.components(d.select(row.alias("row"), at["text"]), NEAR, id_col="row", text_col=at["text"])
    stay = groups.where("row = component_id").groupBy("row").agg(F.count("*").alias("copies"))
    kept = d.withColumn("_row", row).join(stay, F.col("_row") == F.col("row"))
    repeated = kept.where("copies > 1").dropDuplicates(["_row"])
    return kept.where("copies = 1").unionByName(repeated).select(*at.values()).toDF(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    d, at = renamed(docs)
    key = at["doc_id"]
    found = decontam.leaks(d, table(spark, sf_dir, "benchmark"), id_col=key, text_col=at["text"]).select(F.col(key).alias("leaks")).distinct()
    return d.join(found, d[key].eqNullSafe(found["leaks"]), "left_anti").toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

#: The kernels of the language stage, the components and the tokens are beyond SQL; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs

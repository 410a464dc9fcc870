"""The operators of this subpackage over the driver's tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, classlm, conversations, decontam, jaccard, langid, lexical, licenses, linededup, repetition, sharding, toxicity, urlfilter
from tidemark.llm.common import table

VOCABULARY = "byte_bpe_50k.json"


def id_fold(folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id, which is in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds, F.lit(-1))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that leaks into it."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice of every document, with its wording's differences from the template."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later copies of repeated line runs."""
    return linededup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


# The rules of the url query.
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page, with decisions shared among aliases."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their 4-word shingles."""
    return jaccard.components(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every text and the verdict of the repetition limits."""
    return repetition.judge(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learnt from the four folds that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, id_fold(5) != 0)
    held_out = (id_fold(5) == 0).alias("held_out")
    return langid.predict(docs, model).select("doc_id", held_out, "lang_pred", "score")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, with near equal bytes in 40 shards."""
    return sharding.shard(table(spark, sf_dir, "documents"), 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, and the text they decode to, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learnt from the two folds that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), id_fold(3) != 1)
    return toxicity.score(docs, model).select(
        "doc_id",
        (id_fold(3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest-scoring documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and the cost, edits and digest of its cheapest repair."""
    return conversations.report(table(spark, sf_dir, "conversations"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text by a class model of the six folds that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = classlm.fit(docs, id_fold(7) != 2)
    scored = classlm.score(docs, model)
    return scored.select("doc_id", (id_fold(7) == 2).alias("held_out"), *scored.columns[1:])


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_license_scan": op2_license_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_sharding": op8_sharding,
    "op9_bpe_roundtrip": op9_bpe_roundtrip,
    "op10_toxicity": op10_toxicity,
    "op11_lexical_search": op11_lexical_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_lm_scoring": op13_lm_scoring,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": linededup.oracle(),
    "op4_url_filter": urlfilter.oracle(URL_RULES),
    "op11_lexical_search": lexical.oracle(),
    "op12_conversation_repair": conversations.oracle(),
}

"""The pipeline's rows against its stages' brute-force counterparts on the smallest tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_llm import brute_components, brute_lines
from tokenizers import Tokenizer

pipeline = pytest.importorskip("corpus_pipeline")

import public_tokenizers  # noqa: E402

from tidemark.llm import decontam, langid  # noqa: E402
from tidemark.llm.common import saved, table  # noqa: E402
from tidemark.llm.queries import VOCABULARY  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def leaks(item, text):
    """Whether the text holds the item with 6 % edits at most: the edit distance to any part, row by row."""
    most = int(decontam.Params().edit_rate * len(item))
    row = np.zeros(len(text) + 1, int)  # a part may start anywhere
    letters = np.array([ord(c) for c in text])
    for k, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[:-1] + (letters != ord(c)), row[1:] + 1)
        at = np.arange(len(new))
        row = np.minimum.accumulate(new - at) + at
    return row.min() <= most


def often_lines(docs, least, many):
    """Later copies of lines of fewer than ``least`` words that ``many`` documents have."""
    lines = [(d, i, x) for d, t in docs for i, x in enumerate(t.split("\n")) if 0 < len(WORD.findall(x)) < least]
    holders, first = defaultdict(set), {}
    for d, i, x in sorted(lines):
        holders[x].add(d)
        first.setdefault(x, (d, i))
    return {(d, i) for d, i, x in lines if len(holders[x]) >= many and first[x] != (d, i)}


def without(docs, gone):
    """Texts without the lines that are gone; documents that lose all their words go."""
    out = []
    for d, t in docs:
        new = "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)
        if new == t or WORD.search(new):
            out.append((d, new))
    return out


def test_pipeline(spark):
    """Stage by stage with the stages' own parameters: texts, then tokens by the library."""
    docs = sorted((r.doc_id, r.text) for r in table(spark, DATA, "documents").collect())
    kept = [(d, t) for d, t in docs if t and langid._LETTER.search(t)]
    lines = without(kept, brute_lines(kept, 8) | often_lines(kept, 8, pipeline.OFTEN))
    near = pipeline.NEAR
    firsts = [(d, t) for (c, d, _), (_, t) in zip(sorted(brute_components(lines, near.percent, near.words), key=lambda x: x[1]), lines) if c == d]
    items = table(spark, DATA, "benchmark").collect()
    assert all(len(decontam.normal(r.text)) >= 20 for r in items)
    clean = [(d, t) for d, t in firsts if not any(leaks(decontam.normal(r.text), decontam.normal(t)) for r in items)]
    rows = table(spark, DATA, "documents")
    for name, stage, wanted in zip(("language", "lines", "near_copies", "benchmark"), (f for _, f in pipeline.STAGES), (kept, lines, firsts, clean)):
        rows = saved(stage(spark, rows, DATA), name)
        assert sorted((r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()) == wanted, name
    library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    tokens = []
    for d, t in clean:
        ids = library.encode(t, add_special_tokens=False).ids
        tokens.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = pipeline.run(spark, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == tokens


def test_stages_keep_columns(spark):
    docs = table(spark, DATA, "documents")
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns, name


def test_language_decides(spark):
    docs = table(spark, DATA.replace("0.001", "0.01"), "documents")
    odd = ["Это русский текст, которого нет в выборке и который надо отвергнуть.", "これは日本語の文章です。学習された言語ではありません。",
           "To jest polski tekst, którego nikt się nie nauczył w tej próbce.", "qrclv tqmtp xjvgm gfzlw zgmfd ntwfp " * 8]
    rows = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(odd)], "doc_id long, text string, lang string")
    both = docs.unionByName(rows, allowMissingColumns=True)
    kept = {r.doc_id for r in pipeline.language(spark, both, DATA).select("doc_id").collect()}
    letters = {r.doc_id for r in docs.where(r"text rlike '\\p{L}'").select("doc_id").collect()}
    assert kept == letters
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in pipeline.language(spark, blank, DATA).select("doc_id").collect()} == letters


def test_near_copies_by_five_words(spark):
    base = [f"w{k}" for k in range(1000)]
    spread = [f"x{k}" if k % 45 == 20 else w for k, w in enumerate(base)]
    short = [f"s{k}" for k in range(50)]
    middle = [*short[:25], "other", *short[26:]]
    far = [f"y{k}" if k % 20 == 10 else w for k, w in enumerate(base)]
    texts = [(1, base), (2, spread), (3, short), (4, middle), (5, far), (6, ["once"] * 9), (6, ["once"] * 9), (7, ["a", "b"]), (7, ["c", "d"]), (7, ["c", "d"])]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in [*texts, (None, ["e"]), (None, ["f"])]], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in pipeline.near_copies(spark, docs, DATA).collect())
    assert got == sorted((d or 0, " ".join(w)) for d, w in [texts[0], texts[2], *texts[4:6], *texts[7:9], (0, ["e"]), (0, ["f"])])


def test_short_lines_of_many_documents(spark):
    texts = [f"own words of {k}\nshare this now\nand more of {k}" for k in range(12)] + ["share this now", "rare line\nx1", "rare line\nx2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pipeline.lines(spark, docs, DATA).collect()}
    wanted = {k: t if k in (0, 13, 14) else t.replace("\nshare this now", "") for k, t in enumerate(texts) if k != 12}
    assert got == wanted


def test_stages_of_odd_rows(spark):
    words = [r.text for r in table(spark, DATA, "documents").where("length(text) > 400").orderBy("doc_id").limit(3).collect()]
    long = " ".join(f"{w}{k % 977}" for k, w in enumerate((words[0] * 400).split()[:60_000]))
    texts = [(None, words[0]), (1, words[1]), (1, words[1]), (1, words[2]), (2, long), (3, ""), (4, None), (5, "12 34")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("lang", F.lit("en"))
    docs = docs.withColumns({c: F.lit(c) for c in ("score", "lang_pred", "row", "_row", "copies", "n_lines", "n_removed", "th", "item_id", "c0", "c3", "id")})
    nothing = docs.where("false")
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert {r.score for r in rows} == {"score"} and stage(spark, nothing, DATA).count() == 0, name
        kept = sorted((r.doc_id or 0, len(r.text or "")) for r in rows)
        if name == "language":
            assert not {3, 4, 5} & {k for k, _ in kept} and (0, len(words[0])) in kept
        if name == "near_copies":
            assert kept.count((1, len(words[1]))) == 1 and (2, len(long)) in kept and (4, 0) in kept
        if name == "benchmark":
            assert (2, len(long)) in kept and kept.count((1, len(words[1]))) == 2
    done = pipeline.tokens(spark, docs, DATA)
    assert done.count() == len(texts) and pipeline.tokens(spark, nothing, DATA).count() == 0

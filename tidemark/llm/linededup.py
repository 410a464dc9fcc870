"""Line deduplication on a suffix array over line-ID sequences, in DataFrame operations only.

The corpus is a sequence of lines (those with a word), document after document in
the order of (id, text hash); a run is a sequence of neighbouring lines of one
document.  A run of ``min_words`` words or more that also starts earlier in the
corpus is a later copy, and its lines are deleted.  So every line keeps its first
copy, and short lines only go as part of a longer run.  With ``often``, a shorter line
that occurs in so many documents is a repeated run by itself, wherever it stands.

1. Lines get IDs in the order of their 128-bit hash.  Lines that occur once end
   every repeated run and leave the sequence here.
2. Prefix doubling: the rank of a suffix by its first 2h lines follows from the
   ranks by h lines of itself and of the suffix h lines on.  A rank counts the
   suffixes that sort before; it is a prefix sum over the distinct pairs, taken in
   two levels (chunks of pairs, then pairs in a chunk), as one line may precede a
   third of all others.  The suffix h lines on lies in the same document, so it is
   reached by a window over the document.  Doubling ends when the prefix covers
   the shortest run that can qualify; deeper order changes no decision.
3. Longest-common-prefix intervals: the suffixes that share their first l lines
   are the interval of the array with prefixes of l or more, and two ranks of
   2^k <= l lines (of the first and of the last such block) name it.  Taken for
   the shortest qualifying run from each line on, and up to each line, they cover
   exactly the maximal repeated runs: a longer run is the union of such shorter
   ones.
4. In each interval all members but the first are later copies.

Joins on lines, ranks and intervals broadcast the few keys that hold a large part of
all rows, so a line that a third of the corpus has doesn't come to one task.

Null texts stay null, texts without a repeated run stay as they are; a null id is an
id like another.  Rows that agree in id and text are one document and are edited
alike; of equal places the order of (id, text hash) decides.  Texts of any length are
cut whole.  No rows give no rows.  Columns of ``docs`` stay, but ``n_lines`` and
``n_removed``, if there, give way to those of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_PATTERN, drop_saved, join_counted, saved

CHUNKS = 4096
LARGEST_BROADCAST = 100_000
DOC = ["id", "th"]


def numbered_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Document, place (``seq`` among lines with a word, ``line`` among all), words and hash of each line."""
    text = F.col(text_col).cast("string")
    rows = docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.split(text, "\n").alias("all"))
    worded = F.filter(
        F.transform("all", lambda x, i: F.struct(F.regexp_count(x, F.lit(WORD_PATTERN)).alias("words"), i.alias("line"), x.alias("x"))),
        lambda s: s.words > 0,
    )
    lines = rows.select(*DOC, F.posexplode(worded).alias("seq", "s"))
    return lines.select(
        *DOC, "seq", "s.line", "s.words", F.xxhash64("s.x").alias("h1"), F.xxhash64(F.lit(1), "s.x").alias("h2")
    ).dropDuplicates([*DOC, "seq"])


def with_rank(groups: DataFrame, first: Column, order: list[str], chunk: Column) -> DataFrame:
    """``rank`` of each group: ``first`` plus the members (``n``) of the groups of equal ``a`` that sort before.

    ``chunk`` is monotone in ``order``; sums run over the chunks of an ``a``, then inside each chunk.
    """
    g = groups.withColumn("c", chunk)
    past = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    skip = F.coalesce(F.sum("n").over(past("a").orderBy("c")), F.lit(0))
    chunks = g.groupBy("a", "c").agg(F.sum("n").alias("n")).withColumn("skip", skip).select("a", "c", "skip")
    inner = F.coalesce(F.sum("n").over(past("a", "c").orderBy(*order)), F.lit(0))
    return g.withColumn("inner", inner).join(chunks, ["a", "c"]).withColumn("rank", first + F.col("skip") + F.col("inner"))


def suffix_ranks(lines: DataFrame, depth: int) -> DataFrame:
    """Repeated lines with r0, r1, ...: the ranks of their suffixes by 1, 2, 4, ... lines, up to ``depth``."""
    ids = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").withColumn("a", F.lit(0))
    shift = 64 - CHUNKS.bit_length() + 1
    ids = with_rank(ids, F.lit(1), ["h1", "h2"], F.shiftright("h1", shift))
    ids = saved(ids.select("h1", "h2", "n", F.col("rank").alias("r0")), "ids")
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    now = saved(join_counted(lines, ids, ["h1", "h2"], total).drop("h1", "h2", "n"), "ranks")
    drop_saved(ids)
    wide = max(1, total // CHUNKS)
    place = Window.partitionBy(*DOC).orderBy("seq")
    k = 0
    while 2 << k <= depth:
        h = 1 << k
        follows = F.lead("seq", h).over(place) == F.col("seq") + h
        paired = now.withColumn("b", F.when(follows, F.lead(f"r{k}", h).over(place)).otherwise(0))
        pairs = paired.groupBy(F.col(f"r{k}").alias("a"), "b").agg(F.count("*").alias("n"))
        ranked = with_rank(pairs, F.col("a"), ["b"], F.floor(F.col("b") / wide))
        ranked = saved(ranked.select(F.col("a").alias(f"r{k}"), "b", "n", F.col("rank").alias(f"r{k + 1}")), "pairs")
        before, now = now, saved(join_counted(paired, ranked, [f"r{k}", "b"], total).drop("b", "n"), "ranks")
        drop_saved(before)
        drop_saved(ranked)
        k += 1
    return now


def shortest_runs(ranks: DataFrame, min_words: int) -> DataFrame:
    """The shortest runs of ``min_words`` words from each line on and up to each line: place, interval, lines.

    Every line has a word, so such a run has at most ``min_words`` lines.
    """
    levels = [c for c in ranks.columns if c[0] == "r" and c[1:].isdigit()]
    place = Window.partitionBy(*DOC).orderBy("seq")
    line = F.struct("seq", "line", "words", *levels)
    seen = ranks.select(
        *DOC,
        "seq",
        F.collect_list(line).over(place.rowsBetween(0, min_words - 1)).alias("on"),
        F.reverse(F.collect_list(line).over(place.rowsBetween(1 - min_words, 0))).alias("back"),
    )

    def length(run: str, sign: int) -> Column:
        """Lines until the words suffice; null if the document's repeated lines end before."""
        zero = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("n"))

        def step(acc: Column, x: Column) -> Column:
            more = (acc.words < min_words) & (x.seq == F.col("seq") + sign * acc.n)
            return F.when(more, F.struct((acc.words + x.words).alias("words"), (acc.n + 1).alias("n"))).otherwise(acc)

        total = F.aggregate(run, zero, step)
        return F.when(total.words >= min_words, total.n)

    def block(run: Column, at: Column, k: int) -> Column:
        return F.element_at(run, at.cast("int"))[f"r{k}"]

    def interval(run: Column, n: Column, backward: bool) -> list[Column]:
        """Ranks of the first and last block of 2^k lines, for the largest 2^k that fits."""
        first, last = F.lit(None).cast("long"), F.lit(None).cast("long")
        for k in range(len(levels)):
            size = 1 << k
            fits = n >= size
            first = F.when(fits, block(run, n if backward else F.lit(1), k)).otherwise(first)
            last = F.when(fits, block(run, F.lit(size) if backward else n - size + 1, k)).otherwise(last)
        return [first.alias("first"), last.alias("last")]

    out = []
    for name, sign in (("on", 1), ("back", -1)):
        run, n = F.col(name), F.col("n")
        found = seen.withColumn("n", length(name, sign)).where("n is not null")
        start = F.col("seq") if sign > 0 else F.col("seq") - n + 1
        lines = F.transform(F.slice(run, F.lit(1), n), lambda x: x.line)
        out.append(found.select(*DOC, start.alias("start"), n.alias("size"), *interval(run, n, sign < 0), lines.alias("lines")))
    return out[0].unionByName(out[1])


def frequent_copies(lines: DataFrame, min_words: int, often: int) -> DataFrame:
    """(id, th, line) of the later copies of lines below ``min_words`` words that ``often`` documents or more have."""
    line = ["h1", "h2"]
    short = lines.where(F.col("words") < min_words)
    counted = short.groupBy(*line).agg(F.count("*").alias("n"), F.min(F.struct(*DOC, "seq")).alias("earliest"))
    likely = saved(counted.where(F.col("n") >= often).drop("n"), "frequent")
    few = likely.count() <= LARGEST_BROADCAST

    def among(found: DataFrame) -> DataFrame:
        return short.join(F.broadcast(found) if few else found, line)

    within = among(likely).select(*line, *DOC).distinct().groupBy(*line).agg(F.count("*").alias("n"))
    frequent = likely.join(within.where(F.col("n") >= often).drop("n"), line)
    return among(frequent).where(F.struct(*DOC, "seq") > F.col("earliest")).select(*DOC, "line")


def later_copies(
    docs: DataFrame, min_words: int, id_col: str = "doc_id", text_col: str = "text", often: int | None = None
) -> DataFrame:
    """(id, th, gone): the numbers of the lines to delete, for documents that lose some."""
    lines = saved(numbered_lines(docs, id_col, text_col), "lines")
    short = saved(frequent_copies(lines, min_words, often), "short") if often else None
    ranks = suffix_ranks(lines, min_words)
    runs = saved(shortest_runs(ranks, min_words), "runs")
    drop_saved(lines)
    drop_saved(ranks)
    interval = ["size", "first", "last"]
    earliest = runs.groupBy(*interval).agg(F.min(F.struct(*DOC, "start")).alias("earliest"), F.count("*").alias("n"))
    earliest = saved(earliest.where("n > 1"), "intervals")
    total = earliest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    later = join_counted(runs, earliest, interval, total).where(F.struct(*DOC, "start") > F.col("earliest"))
    gone = later.select(*DOC, F.explode("lines").alias("line"))
    gone = gone if short is None else gone.unionByName(short)
    out = saved(gone.groupBy(*DOC).agg(F.collect_set("line").alias("gone")), "gone")
    for done in (runs, earliest, *([short] if short else [])):
        drop_saved(done)
    return out


def dedup(
    docs: DataFrame, min_words: int = 8, id_col: str = "doc_id", text_col: str = "text", often: int | None = None
) -> DataFrame:
    """All rows and columns of ``docs``, the text without later copies, and ``n_lines`` and ``n_removed``."""
    gone = later_copies(docs, min_words, id_col, text_col, often)
    text = F.col(f"d.{text_col}").cast("string")
    key = next(name for k in range(len(docs.columns) + 1) if (name := f"_th{k}") not in docs.columns)
    rows = docs.alias("d").withColumn(key, F.xxhash64(text_col))
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("g.id")) & (F.col(key) == F.col("g.th"))
    joined = rows.join(gone.alias("g").hint("merge"), same, "left")  # a table that grows with the documents
    split = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(1), F.size(split)), F.transform("g.gone", lambda i: i + 1))
    clean = F.when(F.col("g.gone").isNull(), text).otherwise(
        F.array_join(F.transform(F.array_sort(kept), lambda i: F.element_at(split, i)), "\n")
    )
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    columns = [clean.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in kept_columns]
    counts = [
        F.when(text.isNull(), 0).otherwise(F.size(split)).alias("n_lines"),
        F.when(F.col("g.gone").isNull(), 0).otherwise(F.size("g.gone")).alias("n_removed"),
    ]
    return joined.select(*columns, *counts)


def oracle(min_words: int = 8) -> str:
    """DuckDB SQL for ``dedup`` over ``documents``: doc_id, text, n_lines, n_removed.

    It compares the lines of runs themselves, without ranks.
    """
    word = WORD_PATTERN
    place = "PARTITION BY doc_id, md5(text) ORDER BY no"
    return f"""
    WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
    a AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS no FROM d),
    l AS (SELECT *, len(regexp_extract_all(line, '{word}')) AS words FROM a WHERE regexp_matches(line, '{word}')),
    w AS (SELECT doc_id, text, no,
            list(line) OVER f AS fl, list(words) OVER f AS fw, list(no) OVER f AS fn,
            list(line) OVER b AS bl, list(words) OVER b AS bw, list(no) OVER b AS bn
          FROM l WINDOW f AS ({place} ROWS BETWEEN CURRENT ROW AND {min_words - 1} FOLLOWING),
                        b AS ({place} ROWS BETWEEN {min_words - 1} PRECEDING AND CURRENT ROW)),
    n AS (SELECT *,
            list_min(list_filter(range(1, len(fw) + 1), lambda k: list_sum(fw[1:k]) >= {min_words})) AS fk,
            list_max(list_filter(range(1, len(bw) + 1), lambda k: list_sum(bw[k:]) >= {min_words})) AS bk FROM w),
    r AS (SELECT doc_id, text, fn[1:fk] AS nos, fl[1:fk] AS run FROM n WHERE fk IS NOT NULL
          UNION ALL SELECT doc_id, text, bn[bk:], bl[bk:] FROM n WHERE bk IS NOT NULL),
    e AS (SELECT run, min(struct_pack(doc_id := doc_id, no := nos[1])) AS earliest FROM r GROUP BY run),
    g AS (SELECT DISTINCT r.doc_id, r.text, unnest(r.nos) AS no FROM r JOIN e USING (run)
          WHERE struct_pack(doc_id := r.doc_id, no := r.nos[1]) > e.earliest),
    c AS (SELECT a.doc_id, a.text, string_agg(a.line, chr(10) ORDER BY a.no) FILTER (g.no IS NULL) AS clean,
                 count(g.no) AS n_removed FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.text = a.text AND g.no = a.no
          GROUP BY a.doc_id, a.text)
    SELECT s.doc_id, CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(c.clean, '') END AS text,
           CASE WHEN s.text IS NULL THEN 0 ELSE len(string_split(s.text, chr(10))) END AS n_lines,
           coalesce(c.n_removed, 0) AS n_removed
    FROM documents s LEFT JOIN c ON c.doc_id = s.doc_id AND c.text = s.text
    """

"""Operators of the training-data subpackage against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, components, decontam, jaccard, langid, licenses, linededup, queries, repetition, sharding, toxicity, urlfilter
from tidemark.llm.common import table

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [None, "", " \n\t", "a", "É", "x " * 5000, "<|endoftext|>", "it's 12 o'clock\n\nok", "漢字 abc", "same", "same"]


def docs_of(spark, texts, extra=False):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.withColumn("n", F.lit(1)).withColumn("score", F.lit("clash")).withColumn("id", F.lit(2)) if extra else df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def brute_components(pairs, percent=85, k=4):
    sets = {}
    for d, t in pairs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        for h in s:
            where[h].append(d)
    shared = defaultdict(int)
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                shared[b, a] += 1
    for (a, b), c in shared.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return sorted((find(d), d, len(sets[d])) for d in sets)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    theirs = duck.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLES[name]})").fetchall()
    assert rows(got) == sorted(theirs, key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_every_query_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


# BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_bpe_like_the_library(spark, library):
    path, lib = library
    texts = [*TEXTS, *[r.text for r in table(spark, DATA, "documents").limit(60).collect()], "é" * 9000, " " + "ab" * 20000 + "  z", "\n" * 9000 + "x"]
    got = {r.doc_id: r for r in bpe.digests(docs_of(spark, texts, True), path).collect()}
    for k, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        back = lib.decode(ids, skip_special_tokens=False).encode()
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), sha, hashlib.sha256(back).hexdigest())
    tokens = bpe.encode(docs_of(spark, texts), path)
    assert {r.doc_id: r.text for r in bpe.decode(tokens, path).collect()} == {k: t or "" for k, t in enumerate(texts)}
    assert bpe.digests(empty(spark), path).count() == 0


def test_bpe_streams(library, monkeypatch):
    path, lib = library
    e = bpe.Encoder(bpe.Vocabulary(path))
    monkeypatch.setattr(bpe, "LONG_WORD", 8)
    rng = random.Random(4)
    words = [w for b in list(e.vocab.ids)[:20000] if (w := b.decode("utf-8", "ignore")).isalpha()]
    for kind in range(60):
        alphabet = words if kind % 2 else list("aàbthe  \n\t'srnLQ12.,!#é漢")
        text = "".join(rng.choice(alphabet) for _ in range(400))
        out, k = [], 0
        while k < len(text):
            step = rng.randint(1, 40)
            out += [i for part in e.feed(text[k : k + step]) for ids, _, _ in e.look(part) for i in ids]
            k += step
        out += [i for part in e.finish() for ids, _, _ in e.look(part) for i in ids]
        assert out == lib.encode(text, add_special_tokens=False).ids
        assert len(e.word) < 8 + 2 * e.vocab.lookahead + 64


def test_bpe_on_documents(spark, library):
    path, lib = library
    docs = table(spark, DATA.replace("0.001", "0.01"), "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.digests(docs, path).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False).encode()
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(back).hexdigest()


def test_bpe_memory(library, monkeypatch):
    path, lib = library
    monkeypatch.setattr(bpe, "MEMO", 500)
    monkeypatch.setattr(bpe, "WINDOW", 50)
    e, rng = bpe.Encoder(bpe.Vocabulary(path)), random.Random(7)
    texts = [" ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9))) for _ in range(80)) for _ in range(60)]
    out = [[] for _ in texts]
    for k, part in e.encode([*texts, ""]):
        if part:
            out[k] += [i for ids, _, _ in part for i in ids]
        assert sum(map(len, [*e.young, *e.old])) < 2 * (500 + 130 * 10)
    assert out == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_decoder_replaces_malformed_bytes(library):
    v = bpe.Vocabulary(library[0])
    d = bpe.Decoder(v)
    half = v.ids["é".encode()[:1]]
    assert d.feed([half]) == "" and d.feed([v.ids[b"a"]]) == "�a" and d.finish() == ""


# near copies


def test_components_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(n)] for n in (6, 7, 8, 9, 10, 11, 12, 14, 18, 25, 40, 80) for _ in range(3)]
    texts = []
    for _ in range(400):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            r, q = rng.random(), rng.randrange(len(b))
            b = b[:q] + [rng.choice(words)] + b[q + 1 :] if r < 0.4 else b[1:] if r < 0.55 else b[:-1] if r < 0.7 else [*b, rng.choice(words)]
            b = b or ["x"]
        texts.append(" ".join(b))
    texts += [None, "", " \n", "A b", "a B", "a  b"]
    got = rows(jaccard.components(docs_of(spark, texts, True)))
    assert got == sorted(brute_components(enumerate(texts)), key=repr)


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"v{i}" for i in range(120)]
    texts = []
    for k in range(250):
        b = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            b[rng.randrange(120)] = f"n{k}-{rng.random()}"
        texts.append(" ".join(b))
    assert rows(jaccard.components(docs_of(spark, texts))) == sorted(brute_components(enumerate(texts)), key=repr)


def test_salted_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SALT_ROWS", 16)
    monkeypatch.setattr(jaccard, "PART", 8)
    rng = random.Random(1)
    base = [f"v{i}" for i in range(60)]
    texts = [" ".join([*base[:58], f"n{k}", f"m{rng.randrange(3)}"]) for k in range(80)]
    assert rows(jaccard.components(docs_of(spark, texts))) == sorted(brute_components(enumerate(texts)), key=repr)


def chain(n, k):
    """Texts of which only neighbours link, and a family of near copies that shares its start with them."""
    words = [f"c{i}" for i in range(40 + 2 * n)]
    texts = [" ".join(["common start of all these", *words[2 * j : 2 * j + 40]]) for j in range(n)]
    return texts + [" ".join(["common start of all these", *(f"f{i}" for i in range(45)), f"own{j % k}"]) for j in range(3 * n)]


@pytest.mark.parametrize("part, held", [(3, 1 << 18), (3, 40), (64, 16)])
def test_lists_of_unequal_length(spark, monkeypatch, part, held):
    """However lists are cut, keys that two sets share meet."""
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "HELD", held)
    texts = chain(30, 30)
    assert rows(jaccard.components(docs_of(spark, texts))) == sorted(brute_components(enumerate(texts)), key=repr)


def test_scanning_lists_of_unequal_length(spark):
    """200 partners in three lists of 5,000, 100 or 200 and 9,000 sets are all found."""
    rng = random.Random(6)
    names = [rng.getrandbits(62) for _ in range(14_000)]
    for sizes in ((5000, 5000, 5000), (5000, 200, 9000)):
        row = lambda key, sid, size: (key, sid, 100, key, key, sid, size)
        made = [row(k, 7, 1) for k in range(3)]
        rest = 200
        for k, size in enumerate(sizes):
            made += [row(k, s, 2) for s in names[:200]] + [row(k, s, 2) for s in names[rest : rest + size - 200]]
            rest += size - 200
        df = spark.createDataFrame(made, "key long, sid long, n int, pos int, rank int, c long, size long")
        counts = df.groupBy("key").agg(F.max(F.struct("size", "c")).alias("main"), F.count("*").alias("members"))
        got = jaccard.scanned(df.join(counts, "key"), jaccard.Params()).where("x = 7 or y = 7").collect()
        assert {r.x + r.y - 7 for r in got} == set(names[:200])


def test_components_of_nothing(spark):
    assert jaccard.components(empty(spark)).count() == 0


def test_components_of_repeated_and_null_ids(spark):
    base = [f"b{k}" for k in range(100)]
    near, other = [*base[:50], "new", *base[51:]], [f"o{k}" for k in range(30)]
    far = [*other[:14], "else", *other[15:]]
    pairs = [(1, other), (1, base), (2, near), (None, base), (3, far), (3, far), (None, ["alone"] * 9), (4, None), (None, None)]
    df = spark.createDataFrame([(d, w and " ".join(w)) for d, w in pairs], "doc_id long, text string")
    got = rows(jaccard.components(df, jaccard.Params(percent=70)).withColumn("same", F.lit(1)))
    wanted = [(1, d, max(len(w) - 3, 1) if w else 0, 1) for d, w in pairs[:6]] + [(None, None, 1, 1), (4, 4, 0, 1), (None, None, 0, 1)]
    wanted[6] = (None, None, 1, 1)
    assert got == sorted(wanted, key=repr)


def test_sets_of_one_name():
    a, b = jaccard.shingle_sets(["a b c d e f", "g h i j k l"], 4)
    assert jaccard.set_id(a) == jaccard.set_ids(a)[0] != jaccard.set_id(b)
    assert jaccard.set_id(a, frozenset({jaccard.set_id(a)})) == jaccard.set_ids(a)[1]


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    wanted = sorted(((find(n), n) for n in root if any(n in e and e[0] != e[1] for e in edges)), key=repr)
    df = spark.createDataFrame([*edges, (None, 1), (5, 5)], "src long, dst long")
    assert rows(components.connected_components(df)) == wanted
    assert components.connected_components(df.where("false")).count() == 0


# lines


def brute_lines(docs, least):
    lines = [(d, i, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for d, t in docs if t is not None for i, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[3]]
    gone = set()
    for s in range(len(lines)):
        for q in range(s):
            k = words = 0
            while s + k < len(lines) and lines[s + k][0] == lines[s][0] and lines[q + k][0] == lines[q][0] and lines[s + k][2] == lines[q + k][2]:
                words += lines[s + k][3]
                k += 1
            if words >= least:
                gone |= {lines[s + j][:2] for j in range(k)}
    return gone


def test_lines_against_brute_force(spark):
    rng = random.Random(5)
    pool = ["a b c", "x", "the end of it all now", "\t", "", "q w e r t y u i o p", "z z", "l l l l"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(25)] + [None, "", "x\n" * 12]
    gone = brute_lines(list(enumerate(texts)), 8)
    wanted = [t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in enumerate(texts)]
    got = linededup.dedup(docs_of(spark, texts, True)).orderBy("doc_id").collect()
    assert [r.text for r in got] == wanted and got[0].score == "clash"
    assert linededup.dedup(empty(spark)).count() == 0


def test_lines_of_odd_rows(spark):
    long = "\n".join(f"line number {k} of a long text that goes on" for k in range(30_000))
    rows_ = [(None, "a b c d e f g h"), (1, "a b c d e f g h\nown"), (2, long), (3, long), (3, long), (4, None)]
    df = spark.createDataFrame(rows_, "doc_id long, text string").withColumns({"n_lines": F.lit("mine"), "_th0": F.lit(0), "th": F.lit(1), "line": F.lit(2)})
    out = linededup.dedup(df)
    assert out.columns == ["doc_id", "text", "_th0", "th", "line", "n_lines", "n_removed"]
    got = sorted(((r.doc_id or 0, -1 if r.text is None else len(r.text), r.n_lines, r.n_removed) for r in out.collect()))
    empty_ = (3, 0, 30_000, 30_000)
    assert got == [(0, 15, 1, 0), (1, 3, 2, 1), (2, len(long), 30_000, 0), empty_, empty_, (4, -1, 0, 0)]


def test_hot_keys_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    df = spark.range(100).select(F.expr("CASE WHEN id < 60 THEN 0 ELSE id % 13 END").alias("k"), "id")
    groups = df.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = rows(common.join_counted(df, groups, ["k"], 100))
    assert got == rows(df.join(groups, "k")) and len(got) == 100


# decontamination, licenses, urls, shards


def sellers(a, b):
    prev = [0] * (len(b) + 1)
    for i in range(1, len(a) + 1):
        cur = [i]
        for j in range(1, len(b) + 1):
            cur.append(min(prev[j - 1] + (a[i - 1] != b[j - 1]), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return min(prev)


def test_leaks_against_full_search(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, prose(rng.randint(8, 40))) for k in range(12)] + [(90, None), (91, ""), (92, "short")]
    texts = [None, "", *[prose(60) for _ in range(6)]]
    for _ in range(30):
        s = list(items[rng.randrange(12)][1])
        for _ in range(rng.randint(0, int(0.08 * len(s)) + 1)):
            p = rng.randrange(len(s))
            s[p : p + 1] = rng.choice([[], ["x"], [s[p], "y"]])
        texts.append(prose(rng.randint(0, 20)) + " " + "".join(s).upper() + ".\n" + prose(rng.randint(0, 20)))
    got = {(r.doc_id, r.item_id): r.edits for r in decontam.leaks(docs_of(spark, texts, True), spark.createDataFrame(items, "item_id long, text string")).collect()}
    p, wanted = decontam.Params(), {}
    for d, t in enumerate(texts):
        for i, x in items:
            n = decontam.normal(x or "")
            k = int(p.edit_rate * len(n))
            if len(n) >= p.q and len(n) + 1 - p.q * (k + 1) >= 1 and t:
                e = sellers(n, decontam.normal(t))
                if e <= k:
                    wanted[d, i] = e
    assert got == wanted and len(got) > 10
    assert decontam.leaks(docs_of(spark, texts), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_short_items_leak(spark):
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("bcdfghjk") for _ in range(n))
    items = [(m, letters(m)) for m in range(1, 26)] + [(90, "東京タワー"), (91, "!?"), (92, None), (93, "Yes, no")]
    whole, inside, near = (lambda x: f"qq {x.upper()}. qq"), (lambda x: f"qq m{x}m qq"), (lambda x: f"qq {x[:6]}z{x[7:]} qq")
    texts = [f(x) for f in (whole, inside, near) for _, x in items[:25]] + ["高い東京タワーです。", "yes -- no!", "东京タワー", "yes nono", ""]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.edits, r.begin, r.end) for r in decontam.leaks(docs_of(spark, texts), df).collect()}
    for m, x in items[:25]:
        assert got.get((m - 1, m)) == (0, 3, 3 + m), m
        assert ((24 + m, m) in got) == (m >= 10), m
        assert ((49 + m, m) in got) == (m >= 17), m
    assert got[75, 90] == (0, 2, 7) and got[76, 93] == (0, 0, 6) and not {(77, 90), (78, 93)} & set(got)
    assert not {91, 92} & {i for _, i in got}


def test_shared_grams_in_pieces(monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(6)) for _ in range(12)]
    items = [(k, " ".join(rng.choice(words) for _ in range(9))) for k in range(20)] + [(50 + k, w) for k, w in enumerate(words)]
    parts = [decontam.points(" ".join([*(rng.choice(words) for _ in range(20)), items[k][1]])) for k in range(20)]
    found = [decontam.find_in(parts, index) for index in decontam.build_index(items, decontam.Params())]
    monkeypatch.setattr(decontam, "HITS", 7)
    assert found == [decontam.find_in(parts, index) for index in decontam.build_index(items, decontam.Params())]
    assert sum(map(len, found)) >= 20


def test_leaks_of_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away"
    docs = spark.createDataFrame([(None, item), (1, item), (1, item), (2, "pad " * 250_000 + item), (3, item * 2)], "doc_id long, text string")
    docs = docs.withColumns({"item_id": F.lit("x"), "edits": F.lit(9), "_text": F.lit(0)})
    items = spark.createDataFrame([(7, item), (7, item), (None, item)], "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = sorted((r.doc_id or 0, r.item_id or 0, r.edits, r.begin) for r in decontam.leaks(docs, items).collect())
    wanted = [(d, i, 0, 1_000_000 if d == 2 else 0) for d in (0, 1, 1, 2, 3) for i in (0, 7, 7)]
    assert got == sorted(wanted)


def test_licenses_of_odd_rows(spark):
    mit = "Released under the MIT License."
    df = spark.createDataFrame([(None, mit), (1, mit), (1, mit), (2, "pad " * 250_000 + mit)], "doc_id long, text string")
    df = df.withColumns({"license": F.lit("clash"), "t": F.lit(1), "begin": F.lit(2)})
    got = sorted((r.doc_id or 0, r.license, r.begin) for r in licenses.scan(df).collect())
    assert got == [(0, "MIT", 0), (1, "MIT", 0), (1, "MIT", 0), (2, "MIT", 1_000_000)]


def test_licenses(spark):
    texts = [None, "", "no terms here", "Foo\nReleased under the MIT License.\nbar", "Licensed under CC BY-NC 4.0. x", "Licensed under CC BY 4.0.",
             "licensed under the GNU General Public License, version 9.", "pad " * 5000 + "Licensed under the Apache License, Version 2.0."]
    got = {(r.doc_id, r.license) for r in licenses.scan(docs_of(spark, texts, True)).collect()}
    assert got == {(3, "MIT"), (4, "CC-BY-NC-4.0"), (5, "CC-BY-4.0"), (7, "Apache-2.0")}
    real = table(spark, DATA, "documents").where("text rlike 'Released under the MIT License'")
    assert {r.doc_id for r in real.collect()} <= {r.doc_id for r in licenses.scan(real).where("license = 'MIT'").collect()}
    assert licenses.scan(empty(spark)).count() == 0


def test_licenses_whole_notice_texts():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.Params())
    names = lambda text: [f[0] for f in scanner.find(text)]
    assert names("NOTICE\n" + "\n".join(t for _, t, _ in licenses.TEMPLATES)) == [n for n, _, _ in licenses.TEMPLATES]
    mit = "Released under the MIT License."
    assert [f[:3] for f in scanner.find(f"{mit} And {mit}")] == [("MIT", 0, 30), ("MIT", 36, 66)]
    gpl = "Our work is licensed under the GNU General Public License, version 3."
    ((name, begin, end, cost, diffs),) = scanner.find(f"Read this before all that comes then. {gpl}")
    assert (name, begin, end, cost, diffs) == ("GPL-3.0", 42, 106, 1, ["-this +"])
    assert names(gpl.replace("3", "9")) == [] and names(gpl.replace("General ", "")) == []
    assert names("pad " * 900 + gpl + " pad" * 30 + gpl) == ["GPL-3.0"] * 2


def test_url_aliases(spark):
    pages = [
        (1, "https://a.example.org/x?y#z", '<link href="/c" rel="canonical">'), (2, "http://A.example.org/c", None),
        (3, "http://b.example.net/es/1", "<META HTTP-EQUIV=refresh content='0; url=http://a.example.org/c'>"), (4, None, "x"),
        (5, "nohost", ""), (6, "http://z.org", '<link rel="canonical" href="//t.com/">'), (7, "http://q.org?x", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, queries.URL_RULES).collect()}
    assert got[1] == ("a.example.org", "/x", None, "block") and got[2][3] == "block" and got[3][2:] == ("net/es/", "block")
    assert got[4] == ("", "", None, "allow") and got[5][:2] == ("", "") and got[6][3] == "allow" and got[7][1] == ""
    allowed = spark.createDataFrame([("http://a.example.org/c", "http://ok.com/")], "src string, dst string")
    assert {r.page_id: r.verdict for r in urlfilter.judge(df, queries.URL_RULES, allowed).collect()}[1] == "allow"
    assert urlfilter.judge(df.where("false"), queries.URL_RULES).count() == 0


def test_url_aliases_by_sql(spark, tmp_path):
    """The components against the SQL, on pages that have links; the driver's have none."""
    import duckdb

    links = [
        '<link rel="alternate canonical" href="/c">', "<link rel=canonical href=/c><LINK href='/d' REL='Canonical'>", '<!-- <link rel="canonical" href="/z"> -->',
        "<meta content='3;url=//B.example.net/es/9' http-equiv=\"refresh\">", "<link rel='canonical-not' href='/q'>", '<link rel="canonical" href="http://www.example.com/en/x?k#f">', None, "",
    ]
    hosts = ["http://a.example.org", "http://b.example.net", "http://www.example.com/en", "http://example.com/en", "nohost", None]
    rng = random.Random(2)
    pages = [(k, (h and f"{h}/{p}"), rng.choice(links)) for k, (h, p) in enumerate((rng.choice(hosts), rng.choice(["c", "d", "z", "es/9", "q", "x?k", "es/1"])) for _ in range(150))]
    df = spark.createDataFrame([*pages, (3, *pages[3][1:]), (None, *pages[4][1:])], "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    df.drop("rule").coalesce(1).write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    got = urlfilter.judge(df, queries.URL_RULES)
    names = sorted(got.columns)
    wanted = con.sql(f"SELECT {', '.join(names)} FROM ({urlfilter.oracle(queries.URL_RULES)})").fetchall()
    assert rows(got) == sorted(wanted, key=repr) and any(r.alias_of for r in got.collect())
    verdicts = {(r.rule, r.verdict) for r in got.where("alias_of is not null").collect()}
    assert (None, "block") in verdicts or (None, "allow") in verdicts


def test_shards(spark):
    texts = [*TEXTS, *["hot text " * 20] * 300, *[f"text {k} " * (k % 40) for k in range(600)]]
    got = sharding.shard(docs_of(spark, texts, True), 5).toPandas()
    assert len(got) == len(texts) and set(got.shard) == set(range(5))
    load = got.groupby("shard")["size"].sum()
    assert load.max() / load.min() < 1.05
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert got.sort_values("doc_id")["size"].tolist() == [len((t or "").encode()) + 16 for t in texts]
    once = got[got.doc_id.isin([9, 10])]
    assert once.shard.nunique() == 1
    assert sharding.shard(empty(spark), 5).count() == 0


def test_groups_of_equal_texts_stay_together(spark):
    texts = ["g" * 500] * 16 + ["h" * 300] * 30 + ["t" * 100] * 400 + [f"{k} " * 40 for k in range(300)]
    docs = docs_of(spark, texts).withColumns({"key": F.lit(1), "shard": F.lit(2), "rows": F.lit(3)})
    docs = docs.unionByName(docs.where("doc_id < 2").withColumn("doc_id", F.lit(None).cast("long")))
    got = sharding.shard(docs, 10).toPandas()
    room = {"bytes": got["size"].sum() / 10, "rows": len(got) / 10}
    for first, of in (("g", got[got.doc_id < 16]), ("h", got[(got.doc_id >= 16) & (got.doc_id < 46)])):
        assert of.shard.nunique() == 1, first
    many = got[(got.doc_id >= 46) & (got.doc_id < 446)]
    assert many.shard.nunique() <= -(-max(many["size"].sum() / room["bytes"], len(many) / room["rows"]) // 1)
    load = got.groupby("shard")["size"].sum()
    assert len(got) == len(texts) + 2 and load.max() / load.min() < 1.1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_packing_against_brute_force():
    rng = np.random.default_rng(1)
    loads = rng.random((60, 3)) / 9
    left, wanted = np.ones((6, 3)), [0] * 60
    for i in sorted(range(60), key=lambda i: (-max(loads[i]), i)):
        fits = [s for s in range(6) if all(left[s] >= loads[i])] or [s for s in range(6) if left[s][0] >= loads[i][0]]
        dot = lambda s: sum(left[s][d] * loads[i][d] for d in range(3))
        wanted[i] = max(fits, key=lambda s: (dot(s), -s)) if fits else max(range(6), key=lambda s: (left[s][0], -s))
        left[wanted[i]] -= loads[i]
    assert sharding.pack(loads, 6).tolist() == wanted


# per-text models


def test_repetition_against_brute_force():
    rng = random.Random(8)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 40))] for _ in range(60)] + [[], [b"x"], [b"y"] * 30]
    windows, runs, longest = repetition.repeat_stats(texts, 4)
    for k, w in enumerate(texts):
        n, best, cover = len(w), [0] * len(w), {3: set(), 4: set()}
        for i in range(n):
            for j in range(n):
                m = 0
                while i != j and max(i, j) + m < n and w[i + m] == w[j + m]:
                    m += 1
                best[i] = max(best[i], m)
            for least in (3, 4):
                if best[i] >= least:
                    cover[least] |= set(range(i, i + best[i]))
        assert (windows[k], runs[k], longest[k]) == (len(cover[3]), len(cover[4]), max(best, default=0))


def brute_quality(text):
    """All columns of the quality query, from counts of word windows."""
    text = text or ""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), text.split("\n")

    def again(m):
        seen = defaultdict(list)
        for i in range(len(words) - m + 1):
            seen[tuple(words[i : i + m])].append(i)
        return {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(m)}

    low, high = 0, len(words)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if again(mid) else (low, mid - 1)
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    n, repeated, runs = len(words), len(again(3)), len(again(8))
    failed = n < 50 or 100 * repeated > 50 * n
    long = 100 * runs > 40 * n or low > 60 and 100 * low > 25 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, repeated, failed, not failed and not long


def test_quality_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in table(spark, DATA, "documents").collect()}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in queries.op6_quality_rules(spark, DATA).collect()}
    assert got == {d: brute_quality(t) for d, t in docs.items()}


def test_quality_rows(spark):
    texts = [*TEXTS, "\n".join(["one two three"] * 30), " ".join(f"w{i}" for i in range(60)), "a # b\na # b\n\n\n"]
    got = {r.doc_id: r for r in repetition.judge(docs_of(spark, texts, True)).collect()}
    assert got[0].n_words == 0 and got[0].base_failed and not got[0].kept
    assert got[11].n_repeat_words == 90 and got[11].n_dup_lines == 29 and not got[11].kept
    assert got[12].kept and got[13].n_symbols == 2 and got[13].n_dup_lines == 1 and got[13].word_chars == 6
    assert repetition.judge(empty(spark)).count() == 0


def test_language_held_out(spark):
    docs = table(spark, DATA.replace("0.001", "0.01"), "documents")
    out = langid.predict(docs, langid.fit(docs, queries.id_fold(5) != 0), keep=("lang",)).where(queries.id_fold(5) == 0)
    share = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert share > 0.97
    model = langid.fit(docs)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs_of(spark, TEXTS, True), model).collect()}
    assert odd[0] == odd[1] == odd[2] == ("und", 0.0) and odd[3][0] != "und" and 0 <= odd[3][1] <= 1
    assert langid.fit(empty(spark)) is None
    again = docs.withColumn("doc_id", F.expr("CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 3 = 1 THEN NULL ELSE doc_id END"))
    model = langid.fit(again.withColumns({"h": F.lit(0), "k": F.lit(0), "bucket": F.lit("x")}))
    out = langid.predict(again, model, keep=("lang",))
    assert out.count() == docs.count() and out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    assert langid.predict(docs_of(spark, TEXTS), None).where("lang_pred <> 'und'").count() == 0


def test_toxicity_held_out(spark):
    at = DATA.replace("0.001", "0.01")
    docs, labels = table(spark, at, "documents"), table(spark, at, "labels")
    model = toxicity.fit(docs, labels, queries.id_fold(3) != 1)
    out = toxicity.score(docs, model).join(labels, "doc_id").where(queries.id_fold(3) == 1).toPandas()
    hit = out.score >= 0.7
    assert hit[out.toxic == 1].mean() > 0.6 and hit[out.toxic == 0].mean() < 0.05
    odd = toxicity.score(docs_of(spark, TEXTS, True), model).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.fit(docs, labels.where("false")) is None


def test_scores_against_brute_force(spark):
    """The scores of ``score`` and ``predict`` from the models' own arrays, text by text."""
    at = DATA.replace("0.001", "0.01")
    docs, labels = table(spark, at, "documents"), table(spark, at, "labels")
    model = toxicity.fit(docs, labels)
    again = docs.withColumn("doc_id", F.expr("CASE WHEN doc_id % 2 = 0 THEN NULL ELSE doc_id - doc_id % 4 END"))
    assert toxicity.score(again, model).count() == docs.count() and toxicity.fit(again, labels.withColumn("doc_id", F.expr("doc_id - doc_id % 4"))) is not None
    got = {r.doc_id: r.score for r in toxicity.score(docs.limit(200), model).collect()}
    langs = langid.fit(docs)
    spoken = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs.limit(200), langs).collect()}
    for r in docs.limit(200).collect():
        have = toxicity.rates(r.text or "", model.params.full_rate)
        total = model.bias + sum(model.weights[f] * have.get(b, 0) for b, f in model.chosen.items())
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-np.clip(total, -30, 30))), abs=1e-6)
        if not r.text or not langid._LETTER.search(r.text):
            assert spoken[r.doc_id] == ("und", 0.0)
            continue
        known = sorted(set(langs.lookup[np.concatenate(list(langid.grams(r.text, 3)))].tolist()) - {len(langs.presence)})
        kernel = [sum(float(langs.presence[c][m]) for c in known) / max(len(known), 1) ** 0.5 for m in range(langs.presence.shape[1])]
        margin = (np.array(kernel) @ langs.weights[:-1] + langs.weights[-1]) / langs.params.temperature
        share = np.exp(margin - margin.max()) / np.exp(margin - margin.max()).sum()
        assert spoken[r.doc_id][0] == langs.langs[int(share.argmax())] and spoken[r.doc_id][1] == pytest.approx(share.max(), abs=1e-3)


def test_non_negative_risk():
    rng = np.random.default_rng(0)
    pos, unl = rng.normal(2, 1, (200, 2)), np.r_[rng.normal(2, 1, (100, 2)), rng.normal(-2, 1, (300, 2))]
    w, b = toxicity.fit_nnpu(pos, unl, 0.25, toxicity.Params())
    p = 1 / (1 + np.exp(-(unl @ w + b)))
    assert (p[:100] > 0.5).mean() > 0.9 and (p[100:] < 0.5).mean() > 0.9

"""Lexical search, conversation repair and the class language model against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tidemark.llm import classlm, common, conversations, lexical, queries
from tidemark.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# Lexical search


def brute_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    sets = [(d, Counter(terms(t))) for d, t in docs]
    sets = [(d, c) for d, c in sets if c]
    n_docs, total = len(sets), sum(c.total() for _, c in sets)
    df = Counter(t for _, c in sets for t in c)
    out = []
    for item, text in set(items):
        found = []
        for d, c in sets:
            m = 75 + 25 * c.total() * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t in terms(text) if t in c
            )
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def test_search_of_odd_rows(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["É", "漢字", "X1", "it's", "a_b", "ÀB"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(150)]
    docs = [*enumerate(texts), (None, texts[3]), (7, texts[3]), (7, texts[3]), (200, None), (201, ""), (202, "?!"), (203, "same same X1"), (204, "same same X1"), (205, "w1 " * 70_000)]
    items = [(k, " ".join(rng.choices(words, k=8))) for k in range(12)] + [(3, "w1 w1 w1 É"), (50, None), (51, "zzz"), (None, "same x1"), (None, "same x1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("doc", "n", "score", "rank", "uid", "item", "key")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("uid", "q", "doc_id", "rank")})
    got = lexical.search(d.repartition(5), i, k=7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(docs, items, 7)
    none = d.where("false")
    assert lexical.search(none, i).count() == 0 and lexical.search(d, i.where("false")).count() == 0
    assert lexical.search(d.withColumn("text", F.lit(None).cast("string")), i).count() == 0


def test_search_with_ids_of_text(spark):
    docs = [("b", "one two"), ("a", "one two"), (None, "one two"), ("é", "three")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([(1, "two one"), (2, "three")], "item_id long, text string"))
    assert sorted((r.item_id, r["rank"], r.doc_id) for r in got.collect()) == [(1, 1, "a"), (1, 2, "b"), (1, 3, None), (2, 1, "é")]


def test_blocks_of_queries(spark, monkeypatch):
    """Many blocks of queries find what one does."""
    docs, items = table(spark, DATA, "documents"), table(spark, DATA, "benchmark")
    whole = sorted(map(tuple, lexical.search(docs, items).collect()))
    monkeypatch.setattr(lexical, "BLOCK", 300)
    assert sorted(map(tuple, lexical.search(docs, items).collect())) == whole


def test_accumulation():
    rng = np.random.default_rng(5)
    for n_items, n_docs, bits in ((1, 1, 1), (40, 300, 15), (70_000, 90_000, 34)):
        starts = np.r_[0, np.cumsum(rng.integers(0, 9, 50))]
        q = lexical.Queries(np.arange(50), starts, rng.integers(0, n_items, starts[-1]), rng.integers(1, 9, starts[-1]), np.arange(n_items))
        doc, term, gain = rng.integers(0, n_docs, 400), rng.integers(0, 50, 400), rng.integers(1, 99, 400)
        wanted = Counter()
        for d, t, g in zip(doc.tolist(), term.tolist(), gain.tolist()):
            for j in range(starts[t], starts[t + 1]):
                wanted[int(q.item[j]), d] += int(q.weight[j]) * g
        got = lexical.accumulate(q, doc, term, gain, n_docs)
        assert list(zip(*(x.tolist() for x in got))) == [(i, d, s) for (i, d), s in sorted(wanted.items())]
        keys = rng.integers(0, 1 << bits, 5000)
        assert (keys[lexical.radix_order(keys, bits)] == np.sort(keys)).all()
    fan = rng.integers(0, 50, 200)
    runs = list(lexical.chunks(fan, 120))
    assert [a for a, _ in runs[1:]] == [b for _, b in runs[:-1]] and runs[-1][1] == 200
    assert all(fan[a:b].sum() <= 120 or b == a + 1 for a, b in runs)


def test_windows_cut_no_word():
    text = b" ".join(b"x" * k for k in (1, 900, 3, 50, 7, 2000, 1)) + b"  "
    for size in (1, 10, 64, 5000):
        parts = list(common.windows(text, size))
        assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split()


# Conversation repair


def brute_repair(codes):
    """Least (cost, audit) over all edits, with up to two insertions in each gap."""
    legal = re.compile("(s?(ua)+)?")
    best = None
    options = []
    for c in codes:
        own = " sua"[c & 3]
        cut = 3 if c & conversations.CUT else 0
        options.append([("D", "", 4)] + ([] if c & conversations.GONE else [("K", own, cut), ("R", "u", 3 + cut), ("R", "a", 3 + cut)]))
    gaps = [("I" * n, r, 3 * n) for n in range(3) for r in map("".join, itertools.product("ua", repeat=n))]
    plans = [("", "", 0)]
    for o in [*options, None]:
        plans = [(a + g, r + x, c + y) for a, r, c in plans for g, x, y in gaps]
        if o:
            plans = [(a + g, r + x, c + y) for a, r, c in plans for g, x, y in o]
        # plans with the same roles and more cost can't win
        kept = {}
        for a, r, c in plans:
            if r not in kept or (c, a) < kept[r]:
                kept[r] = (c, a)
        plans = [(a, r, c) for r, (c, a) in kept.items()]
    for a, r, c in plans:
        if legal.fullmatch(r) and (best is None or (c, a) < best):
            best = (c, a)
    return best


def test_search_against_all_edits(monkeypatch):
    rng = random.Random(11)
    cases = [bytes(x) for n in range(3) for x in itertools.product([0, 1, 2, 3, 5, 6, 7, 10], repeat=n)]
    cases += [bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11]) for _ in range(n)) for n in (3, 4) for _ in range(40)]
    for window in (256, 1, 2):
        monkeypatch.setattr(conversations, "WINDOW", window)
        for codes in cases:
            lattice = conversations.Lattice()
            lattice.feed(codes)
            audit = lattice.audit()
            assert (lattice.cost, audit) == brute_repair(codes), (codes, window)
            assert sum(e[3] for e in conversations.edits(codes, audit)) == lattice.cost


def test_windows_of_long_conversations(monkeypatch):
    rng = random.Random(2)
    for kinds in ([0], [1, 8], [6, 5, 7], [0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11]):
        codes = bytes(rng.choice(kinds) for _ in range(900))
        found = set()
        for window, step in ((256, 900), (1000, 900), (17, 40), (3, 1)):
            monkeypatch.setattr(conversations, "WINDOW", window)
            lattice = conversations.Lattice()
            for at in range(0, len(codes), step):
                lattice.feed(codes[at : at + step])
            found.add((lattice.audit(), lattice.cost))
        assert len(found) == 1


def brute_report(rows):
    """The report of rows (conv_id, turn, role, text) by plain loops and ``brute_repair``."""
    out, convs = [], {}
    blank = lambda v: " " if v is None else v
    for conv, turn, role, text in rows:
        held = convs.setdefault(conv, [])
        hit = crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", blank(text)) if hit == 2 else blank(text)
        held += [(turn, "user" if hit == 4 else blank(role), text)] * (2 if hit == 3 else 1)
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in held:
            last = WORD.findall(text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1][-1] in ".!?" else "truncated")
            seen.add((role, text))
        first = lambda r: r[:1] or "-"
        codes = bytes(
            (" sua".find(first(role)) if first(role) in "sua" else 0) + {"blank": 8, "duplicate": 8, "truncated": 4, "": 0}[f]
            for (_, role, _), f in zip(held, faults)
        )
        lattice = conversations.Lattice()
        lattice.feed(codes)
        audit = lattice.audit()
        said = []
        for at, letter, new, _ in conversations.edits(codes, audit):
            if letter != "D":
                said.append((new or held[at - 1][1]) + ":" + (held[at - 1][2] if at else ""))
        turns = [t for t, *_ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        roles = [r[:1] for _, r, _ in held]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, lattice.cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_report_of_odd_rows(spark):
    rng = random.Random(8)
    texts = ["Yes.", "No", " ", "", None, "Same!", "Odd .", "Tail. \n", "?", "é"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "unit"]
    rows = [(c, rng.choice([None, *range(8)]), rng.choice(roles[:3] if c % 3 else roles), rng.choice(texts)) for c in range(120) for _ in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho.")] + [(500, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(700)] + [(501, 3, "user", "Same.")] * 40
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("conv", "pos", "fault", "cost", "k", "hit")})
    got = conversations.report(df.repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_report(rows)
    assert conversations.report(df.where("false")).count() == 0


def test_repaired_rows(spark):
    """The operator's own output: edits in order, with texts."""
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hello?"), (1, 3, "assistant", "Ho.")]
    df = common.saved(conversations.judged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "rows")
    got = conversations.repair(df).orderBy("k").collect()
    assert [(r.k, r.edit, r.role, r.text) for r in got] == [
        (1, "K", "system", "Be kind."), (2, "K", "user", "Hi."), (3, "I", "assistant", ""), (4, "K", "user", "Hello?"), (5, "K", "assistant", "Ho."),
    ]


# Class language model

SMALL = classlm.Params(frequent=120, endings=30, classes=9, rounds=12, known=300)


@pytest.fixture(scope="module")
def small(spark):
    docs = table(spark, DATA, "documents")
    return docs, classlm.fit(docs, queries.id_fold(7) != 2, SMALL)


def tokens_of(text):
    return [w.encode() for w in WORD.findall(lower(text))] + [b""]


def test_scores_by_brute_force(spark, small):
    docs, model = small
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    learnt = [tokens_of(t) for d, t in rows if crc32(str(d).encode()) % 7 != 2]
    counts = Counter(w for ts in learnt for w in ts)
    total, size = counts.total(), len(counts)
    assert (model.tokens, model.size) == (total, size)
    top = sorted(counts, key=lambda w: (w != b"", -counts[w], w))
    number = {w: k for k, w in enumerate(top[: SMALL.frequent])}
    unit = lambda w: number.get(w, SMALL.frequent + crc32(w[-3:]) % SMALL.endings)
    cls = lambda w: int(model.classes[unit(w)])
    k = SMALL.classes
    pairs, types = np.zeros((k, k)), np.zeros(k)
    for ts in learnt:
        for a, b in zip([b"", *ts], ts):
            pairs[cls(a), cls(b)] += 1
    for w in counts:
        types[cls(w)] += 1
    assert (pairs == model.pairs).all() and (types == model.types).all()
    assert (pairs.sum(0) == pairs.sum(1)).all()
    n = pairs.sum(1)
    move = classlm.transitions(pairs)
    assert np.allclose(move.sum(1), 1)
    emit = lambda w: (counts[w] or types[cls(w)] + 1) / (n[cls(w)] + types[cls(w)] + 1)
    assert np.allclose((np.bincount([cls(w) for w in counts], list(counts.values()), k) + types + 1) / (n + types + 1), 1)
    extra = [(-1, None), (-1, ""), (None, "Unseen wörds THE the"), (-5, " ".join(rows[0][1].split() * 3))]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    d = d.withColumns({c: F.lit("x") for c in ("row", "doc", "score", "word", "n", "class", "known")})
    got = sorted(map(tuple, classlm.score(d, model).collect()), key=repr)
    wanted = []
    for doc, text in [*rows, *extra]:
        ts = tokens_of(text)
        base = sum(math.log10((counts[w] + 1) / (total + size + 1)) for w in ts)
        score = sum(math.log10(move[cls(a), cls(b)]) + math.log10(emit(b)) for a, b in zip([b"", *ts], ts))
        wanted.append((doc, len(ts), sum(counts[w] > 0 for w in ts), total, base, score, 10 ** (-score / len(ts))))
    wanted.sort(key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in wanted]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in wanted])


def test_exchange_moves():
    """The gain of a move is the difference of the likelihoods."""
    rng = np.random.default_rng(1)
    units, k = 40, 6
    n = rng.integers(0, 5, (units, units))
    n[:, 3] = n[3]  # any unit's rows and columns needn't be alike, but their sums
    n = n + n.T
    classes = np.r_[0, rng.integers(1, k, units - 1)]
    hot = np.eye(k, dtype=int)
    pairs = lambda c: (hot[c].T @ n @ hot[c]).astype(float)
    for u in range(1, units):
        after, before, own = np.bincount(classes, n[u], k), np.bincount(classes, n[:, u], k), n[u, u]
        after[classes[u]] -= own
        before[classes[u]] -= own
        b, gain = classlm.best_class(pairs(classes), classes[u], after, before, own)
        all_moves = [classlm.likelihood(pairs(np.r_[classes[:u], c, classes[u + 1 :]])) for c in range(1, k)]
        assert b == 1 + int(np.argmax(all_moves)) or np.isclose(max(all_moves), all_moves[b - 1])
        assert np.isclose(gain, max(all_moves) - classlm.likelihood(pairs(classes)))


def test_exchange_finds_classes(spark):
    """Two kinds of words that alternate end in classes of their own."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(("ka", "lo")) + "x" * rng.randint(0, 9) if k % 2 else "o" * rng.randint(1, 9) for k in range(60)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    p = classlm.Params(frequent=60, endings=4, classes=3, rounds=30, known=100)
    m = classlm.fit(docs, None, p)
    of = {w: int(m.classes[k]) for k, w in enumerate(m.words[: p.frequent])}
    assert len({c for w, c in of.items() if w[:1] == b"o"}) == 1 and len({c for w, c in of.items() if w[:1] in b"kl" and w}) == 1
    assert len(set(of.values())) == 3


def test_held_out_texts_are_likelier_than_by_counts(spark):
    got = queries.op13_lm_scoring(spark, DATA.replace("0.001", "0.01")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > 0.95 * got.b


def test_no_learning_text(spark):
    docs = table(spark, DATA, "documents")
    m = classlm.fit(docs, F.lit(False), SMALL)
    assert m is None
    got = classlm.score(docs, m).agg(F.count("*").alias("n"), F.sum("n_known").alias("k"), F.sum(F.abs("score") + F.abs("base_score")).alias("s")).first()
    assert (got.n, got.k, got.s) == (docs.count(), 0, 0.0)
    assert classlm.score(docs.where("false"), m).count() == 0
    blank = classlm.fit(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), None, SMALL)
    assert (blank.tokens, blank.size) == (2, 1) and classlm.score(docs, blank).where("n_known = 1").count() == docs.count()

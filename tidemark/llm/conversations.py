"""Repair of conversations by Dijkstra's search on an edit lattice.

A node of the lattice is (rows read, grammar state); edges are the edits of the next
row and insertions.  The role initials of a repaired conversation are
``(s?(ua)+)?``.  Keeping a row costs 0, giving it the role user or assistant 3,
deleting it 4, inserting a turn without text 3; blank and duplicate rows must be
deleted, and a truncated row that stays costs 3 more.  The search takes nodes in the
order of (cost, audit), the audit being the initials of the edits so far, and stops at
the first accepting node behind the last row, so ties go to the ASCII-least audit.

Rows come to the search sorted, a byte each, and are read ``WINDOW`` at a time: a
window's search starts at the up to four states that the one before reached and ends
when all states are reached, or, in the last one, at the first accepting node.  That is
exact: two audits of equal cost at one node can't be prefixes of each other, since both
have one letter for each row and an insertion costs something, so their order doesn't
change by what follows.  Held are the letters of at most four paths; texts aren't
read by the search but joined to the edits by row, so they are spread over all tasks
however long one conversation is.

Rows are ordered by turn (nulls first), then role, then text.  A row's first fault
counts: blank (no character but white space), duplicate (role and text were seen
earlier), truncated (the last character besides white space isn't one of ``.!?``).
Null roles and texts count as one space, so such a text is blank.  A null conversation
id is a conversation like others.  Repeated rows are duplicates.  Other columns aren't
read, whatever their names.  No rows give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import saved, trimmed

#: Rows that are searched at a time, and edits that are emitted at a time.
WINDOW = 256
EMITTED = 1 << 16
SPACE = " \t\n\x0b\x0c\r"

# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: Grammar states are 0 at the start, and the last initial's number in "sua" afterwards.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEPS = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: The state that a row of the needed role, user or assistant, leads to.
TURN = (USER, USER, ASSISTANT, USER)
ACCEPTING = (START, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: A row's byte: the initial's number, 0 for others, and one of these.
CUT, GONE = 4, 8

#: A path: its cost, the rank of the part before the window, its letters in the window, its state.
Path = tuple[int, int, str, int]


@lru_cache(1 << 14)
def search(codes: bytes, sources: tuple[Path, ...], last: bool) -> tuple[tuple[Path, int], ...]:
    """The best path to each state behind the rows, or to the first accepting one, each with the number of its source."""
    heap = [(cost, rank, audit, 0, state, k) for k, (cost, rank, audit, state) in enumerate(sources)]
    heapq.heapify(heap)
    seen: set[tuple[int, int]] = set()
    ends = []
    while heap:
        cost, rank, audit, at, state, k = heapq.heappop(heap)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(codes):
            if not last or state in ACCEPTING:
                ends.append(((cost, rank, audit, state), k))
            if len(ends) == (1 if last else 4):
                break
        else:
            code = codes[at]
            heapq.heappush(heap, (cost + DELETE, rank, audit + "D", at + 1, state, k))
            if not code & GONE:
                more = cost + (TRUNCATED if code & CUT else 0)
                if (state, code & 3) in KEEPS:
                    heapq.heappush(heap, (more, rank, audit + "K", at + 1, code & 3, k))
                heapq.heappush(heap, (more + REROLE, rank, audit + "R", at + 1, TURN[state], k))
        heapq.heappush(heap, (cost + INSERT, rank, audit + "I", at, TURN[state], k))
    return tuple(ends)


class Lattice:
    """The search over a conversation whose rows come in parts."""

    def __init__(self) -> None:
        self.codes = bytearray()
        self.read = self.cost = 0
        self.paths: tuple[Path, ...] = ((0, 0, "", START),)
        self.letters: list = [None]  # of each path: (letters before, letters of a window)

    def feed(self, codes: bytes) -> None:
        self.codes += codes
        while len(self.codes) - self.read > WINDOW:
            self.advance(False)

    def advance(self, last: bool) -> None:
        codes = bytes(self.codes[self.read : self.read + WINDOW])
        self.read += len(codes)
        ends = sorted(search(codes, self.paths, last), key=lambda e: e[0][1:3])
        self.letters = [(self.letters[k], audit[len(self.paths[k][2]) :]) for (_, _, audit, _), k in ends]
        least = min(cost for (cost, *_), _ in ends)
        self.cost += least
        paths, base, rank = [], None, -1
        for (cost, old, audit, state), _ in ends:
            if base is None or old != base[0] or not audit.startswith(base[1]):
                base, rank = (old, audit), rank + 1
            paths.append((cost - least, rank, audit[len(base[1]) :], state))
        self.paths = tuple(paths)

    def audit(self) -> str:
        """The letters of the cheapest repair; ``cost`` is its cost then."""
        self.advance(True)
        parts, node = [], self.letters[0]
        while node:
            node, part = node
            parts.append(part)
        return "".join(reversed(parts))


def edits(codes: bytes, audit: str) -> Iterator[tuple[int | None, str, str | None, int]]:
    """Number of the row (from 1, none of an insertion), letter, new role and cost of each edit."""
    at, state = 0, START
    for letter in audit:
        if letter == "I":
            state = TURN[state]
            yield None, letter, NAMES[state], INSERT
            continue
        code = codes[at]
        at += 1
        more = TRUNCATED if code & CUT else 0
        if letter == "D":
            yield at, letter, None, DELETE
        elif letter == "K":
            state = code & 3
            yield at, letter, None, more
        else:
            state = TURN[state]
            yield at, letter, NAMES[state], REROLE + more


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Rows of equal first columns, and whether they are another group than those before; a group may come in parts."""
    held: pa.Array | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
        edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = batch.column(0).slice(a, 1)
            yield not (a == 0 and held is not None and key.equals(held)), batch.slice(a, b - a)
        held = key


def judged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by conversation ``conv`` and number ``pos`` (from 1), with their ``fault``, whether the roles before and here are ``illegal``, and whether the turn is ``new``."""
    space = F.lit(" ")
    src = rows.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), space).alias("text"),
    )
    by = "over (partition by conv order by turn asc nulls first, role, text)"
    body = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(body == "", "blank")
        .when(F.expr("row_number() over (partition by conv, role, text order by pos)") > 1, "duplicate")
        .when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    initial = F.left("role", F.lit(1))
    pair = F.concat(F.lag("initial").over(Window.partitionBy("conv").orderBy("pos")), "initial")
    return (
        src.withColumn("pos", F.expr(f"row_number() {by}"))
        .withColumn("fault", fault)
        .withColumn("initial", initial)
        .withColumn("illegal", F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)))
        .withColumn("new", F.expr("turn is not null and not (lag(turn) over (partition by conv order by pos) <=> turn)"))
    )


def searched(rows: DataFrame) -> DataFrame:
    """Edits ``k`` (from 1) of each conversation of ``judged`` rows: ``pos``, ``edit``, ``new_role`` and ``cost``."""
    number = F.expr("cast(position(initial in 'sua') * int(initial <> '') as int)")
    gone = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", CUT).otherwise(0)
    light = rows.select("conv", "pos", (number + gone).alias("code")).repartition("conv").sortWithinPartitions("conv", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key = lattice = None

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            kinds = (key.type, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["conv", "k", "pos", "edit", "new_role", "cost"])

        def ended() -> Iterator[pa.RecordBatch]:
            conv = key[0].as_py()
            for k, edit in enumerate(edits(lattice.codes, lattice.audit()), 1):
                out.append((conv, k, *edit))
                if len(out) >= EMITTED:
                    yield batch()

        for other, part in runs(batches):
            if other:
                if lattice:
                    yield from ended()
                key, lattice = part.column(0).slice(0, 1), Lattice()
            lattice.feed(part.column(2).to_numpy().astype(np.uint8).tobytes())
        if lattice:
            yield from ended()
        if out:
            yield batch()
        trimmed()

    kind = rows.schema["conv"].dataType.simpleString()
    return light.mapInArrow(run, f"conv {kind}, k bigint, pos int, edit string, new_role string, cost int")


def repair(rows: DataFrame) -> DataFrame:
    """All edits of ``judged`` rows in order ``k``, with the turn, fault, role and text of their rows; those that aren't deleted are the repaired conversation.

    ``rows`` is read twice, so it should be a table.
    """
    made = saved(searched(rows), "edits")
    at = rows.select(F.col("conv").alias("c"), F.col("pos").alias("p"), "turn", "fault", F.col("role").alias("old"), "text")
    own = made.where("edit <> 'I'").join(at, F.col("conv").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p")))
    own = own.select("conv", "k", "edit", "cost", "turn", "fault", F.coalesce("new_role", "old").alias("role"), "text")
    turn = rows.schema["turn"].dataType.simpleString()
    new = made.where("edit = 'I'").selectExpr("conv", "k", "edit", "cost", f"cast(null as {turn}) as turn", "cast(null as string) as fault", "new_role as role", "'' as text")
    return own.unionByName(new)


def digests(repaired: DataFrame) -> DataFrame:
    """``conv``, ``cost``, ``audit`` and ``repaired_sha256`` of each conversation; rows are streamed in order."""
    src = repaired.select("conv", "k", "edit", "cost", F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text")).cast("binary").alias("said"))
    src = src.repartition("conv").sortWithinPartitions("conv", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key = None

        def batch() -> pa.RecordBatch:
            cols = list(zip(*done))
            done.clear()
            kinds = (key.type, pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["conv", "cost", "audit", "repaired_sha256"])

        for other, part in runs(batches):
            if other:
                if key is not None:
                    done.append((key[0].as_py(), cost, "".join(letters), sha.hexdigest()))
                    if len(done) >= EMITTED:
                        yield batch()
                key, cost, letters, sha, first = part.column(0).slice(0, 1), 0, [], hashlib.sha256(), True
            letters.append("".join(part.column(2).to_pylist()))
            cost += sum(part.column(3).to_pylist())
            for said in part.column(4):
                if said.is_valid:
                    sha.update(said.as_py() if first else b"\n" + said.as_py())
                    first = False
        if key is not None:
            done.append((key[0].as_py(), cost, "".join(letters), sha.hexdigest()))
            yield batch()
        trimmed()

    return src.mapInArrow(run, f"conv {repaired.schema['conv'].dataType.simpleString()}, cost bigint, audit string, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, by the crc32 of ``conv_id:turn`` modulo 20; nulls count as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    src = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), hit.alias("hit")).where("hit <> 0")
    new_text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    new_role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    copies = F.expr("explode(array_repeat(0, if(hit = 3, 2, 1)))")
    return src.select("conv_id", "turn", new_role.alias("role"), new_text.alias("text"), copies.alias("copy")).drop("copy")


def report(conversations: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of every conversation of ``conversations`` after its damage."""
    rows = saved(judged(damage(conversations)), "rows")
    fault = lambda f: F.count(F.when(F.col("fault") == f, 1)).alias(f)
    ids = conversations.select(F.col("conv_id").alias("conv")).distinct()
    facts = rows.select("conv", "turn", "fault", "illegal", "new").unionByName(ids, allowMissingColumns=True)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count(F.when(F.col("new"), 1)), F.lit(0)).cast("long")
    facts = facts.groupBy("conv").agg(gaps.alias("gaps"), *map(fault, ("blank", "duplicate", "truncated")), F.count(F.when(F.col("illegal"), 1)).alias("illegal"))
    done = digests(repair(rows)).withColumnRenamed("conv", "c")
    return facts.join(done, F.col("conv").eqNullSafe(F.col("c")), "left").select(
        F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal",
        F.coalesce("cost", F.lit(0)).alias("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def oracle() -> str:
    """The report in SQL: the lattice's rows in turn, the best path of each state after each."""
    step = lambda s: f"CASE {s} WHEN 2 THEN 3 ELSE 2 END"
    name = lambda s: f"CASE {s} WHEN 2 THEN 'user:' ELSE 'assistant:' END"
    white = r"[\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE bits AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))
), src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS b
  FROM conversations
), hits AS (
  SELECT s.*, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS hit FROM src s, bits
), damaged AS (
  SELECT conv_id AS conv, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hits, range(CASE WHEN hit = 3 THEN 2 ELSE 1 END) WHERE hit <> 0
), numbered AS (
  SELECT *, left(role, 1) AS ini, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM damaged
), faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?]{white}*$') THEN 'truncated' ELSE 'none' END AS fault,
    lag(ini) OVER (PARTITION BY conv ORDER BY pos) AS before
  FROM numbered
), path AS (
  SELECT DISTINCT conv_id AS conv, 0::BIGINT AS done, 0 AS st, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM conversations
  UNION ALL
  SELECT conv, done + 1, st3, cost, audit, said FROM (
    SELECT q.conv, done, cost + 3 * n + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost,
      audit || repeat('I', n) || e AS audit,
      list_concat(list_concat(said, new), CASE e WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [{name(step('st2'))} || text] END) AS said,
      CASE e WHEN 'D' THEN st2 WHEN 'R' THEN {step('st2')} ELSE CASE ini WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS st3
    FROM (
      SELECT p.*, n, CASE n WHEN 0 THEN st WHEN 1 THEN {step('st')} ELSE {step('(' + step('st') + ')')} END AS st2,
        CASE n WHEN 0 THEN [] WHEN 1 THEN [{name(step('st'))}] ELSE [{name(step('st'))}, {name(step('(' + step('st') + ')'))}] END AS new
      FROM path p, (VALUES (0), (1), (2)) i(n)
    ) q JOIN faults f ON f.conv IS NOT DISTINCT FROM q.conv AND f.pos = q.done + 1, (VALUES ('K'), ('R'), ('D')) o(e)
    WHERE e = 'D' OR fault NOT IN ('blank', 'duplicate') AND (e = 'R' OR (st2 = 0 AND ini IN ('s', 'u')) OR (st2 IN (1, 3) AND ini = 'u') OR (st2 = 2 AND ini = 'a'))
  ) QUALIFY row_number() OVER (PARTITION BY conv, st3 ORDER BY cost, audit) = 1
), counted AS (
  SELECT DISTINCT c.conv_id AS conv, (SELECT count(*) FROM faults f WHERE f.conv IS NOT DISTINCT FROM c.conv_id) AS n FROM conversations c
), ends AS (
  SELECT p.conv, cost + 3 * k AS cost, audit || repeat('I', k) AS audit,
    list_concat(said, CASE k WHEN 0 THEN [] WHEN 1 THEN [{name(step('st'))}] ELSE [{name(step('st'))}, {name(step('(' + step('st') + ')'))}] END) AS said
  FROM path p JOIN counted c ON c.conv IS NOT DISTINCT FROM p.conv AND p.done = c.n, (VALUES (0), (1), (2)) i(k)
  WHERE (CASE k WHEN 0 THEN st WHEN 1 THEN {step('st')} ELSE {step('(' + step('st') + ')')} END) IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY p.conv ORDER BY cost + 3 * k, audit || repeat('I', k)) = 1
), facts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv
) SELECT e.conv AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN facts f ON f.conv IS NOT DISTINCT FROM e.conv"""

"""Quality rules on repetition: maximal repeated word runs of each text, from its suffix array.

Texts of a batch are laid end to end in one array of word ids, each word tagged
with its text, so no run joins two texts.  Prefix doubling ranks all suffixes;
only suffixes whose rank is still shared are sorted again.  The ranks of all
rounds give the longest common prefix of neighbours in the suffix array: each
round in turn, from the longest, tells whether both go on equally.  The larger
value of a suffix's two neighbours is the length of the longest run that starts
there and occurs elsewhere, and the union of these spans is what repeats.

Memory is bounded by a batch of about ``BATCH`` characters, or one longer text.
A null text has no words, as an empty one; both fail ``min_words``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import groups_of, map_batches

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 3

BATCH = 1 << 20


@dataclass(frozen=True)
class Limits:
    """Base rules, then the limits on repeated runs of ``run_words`` words or more."""

    min_words: int = 50
    repeat_percent: int = 50
    run_words: int = 8
    covered_percent: int = 40
    longest_words: int = 60
    longest_percent: int = 25


def suffix_ranks(first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, until all differ.

    ``first``: a number for each symbol; ``end``: where the text of each position ends.
    A rank counts the suffixes that sort before its group.
    """
    n = len(first)
    _, at, sizes = np.unique(first, return_inverse=True, return_counts=True)
    starts = np.cumsum(sizes) - sizes
    rank = starts[at]
    rounds, shared, step = [rank], np.flatnonzero(sizes[at] > 1), 1
    while len(shared):
        beyond = shared + step
        inside = beyond < end[shared]
        follow = np.where(inside, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = rank[shared] * (n + 1) + follow
        order = np.argsort(key)
        key, shared = key[order], shared[order]
        new = np.r_[True, key[1:] != key[:-1]]
        old = key // (n + 1)
        head = np.r_[True, old[1:] != old[:-1]]
        index = np.arange(len(key))
        group = np.maximum.accumulate(np.where(new, index, 0))
        whole = np.maximum.accumulate(np.where(head, index, 0))
        rank = rank.copy()
        rank[shared] = old + group - whole
        rounds.append(rank)
        size = np.bincount(group, minlength=len(key))[group]
        shared = shared[size > 1]
        step *= 2
    return rounds


def longest_repeats(rounds: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """For each position the longest run that starts there and also starts elsewhere."""
    n = len(end)
    array = np.empty(n, np.int64)
    array[rounds[-1]] = np.arange(n)
    left, right = array[:-1], array[1:]
    common = np.zeros(max(n - 1, 0), np.int64)
    going = np.flatnonzero(rounds[0][left] == rounds[0][right])
    for k in range(len(rounds) - 1, -1, -1):
        i, j = left[going] + common[going], right[going] + common[going]
        inside = (i < end[left[going]]) & (j < end[right[going]])
        i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
        common[going] += np.where(inside & (rounds[k][i] == rounds[k][j]), 1 << k, 0)
    out = np.zeros(n, np.int64)
    np.maximum.at(out, left, common)
    np.maximum.at(out, right, common)
    return out


def covered(runs: np.ndarray, least: int) -> np.ndarray:
    """True for positions inside the union of the runs of ``least`` or more."""
    at = np.flatnonzero(runs >= least)
    edges = np.zeros(len(runs) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + runs[at], -1)
    return np.cumsum(edges[:-1]) > 0


def repeat_stats(word_lists: list[list[bytes]], run_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each list of words: those in repeated ``WINDOW``s, those in long repeated runs, the longest run."""
    sizes = np.fromiter(map(len, word_lists), np.int64, len(word_lists))
    n, k = int(sizes.sum()), len(word_lists)
    if not n:
        return (np.zeros(k, np.int64),) * 3
    flat = [w for words in word_lists for w in words]
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter(map(number.__getitem__, flat), np.int64, n)
    of = np.repeat(np.arange(k), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    runs = longest_repeats(suffix_ranks(of * len(number) + ids, end), end)
    longest = np.zeros(k, np.int64)
    np.maximum.at(longest, of, runs)
    count = lambda mask: np.bincount(of[mask], minlength=k)
    return count(covered(runs, WINDOW)), count(covered(runs, run_words)), longest


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(SPACES):
            seen.add(line)
    return again


def judge(
    docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Counts and verdict of every whole text: ``kept`` is false if the base rules or the limits fail.

    Besides the counts, ``n_run_words`` words lie in repeated runs of ``run_words`` or more and
    ``longest_run`` is the longest repeated run.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[list[int]] = [[] for _ in range(7)]
        for texts in groups_of(batch.column(1), BATCH):
            words = [t.encode().split() for t in texts]
            windows, runs, longest = repeat_stats(words, limits.run_words)
            rows[0] += map(len, words)
            rows[1] += [len(t) - sum(map(t.count, SPACES)) for t in texts]
            rows[2] += [sum(map(t.count, SYMBOLS)) for t in texts]
            rows[3] += map(duplicate_lines, texts)
            rows[4] += windows.tolist()
            rows[5] += runs.tolist()
            rows[6] += longest.tolist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(r, pa.int64()) for r in rows)], [id_col, *COUNTS]
        )

    src = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = src.schema[0].dataType.simpleString()
    out = map_batches(src, run, f"`{id_col}` {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))
    n = F.col("n_words")
    base_failed = (n < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * n)
    repetitive = (100 * F.col("n_run_words") > limits.covered_percent * n) | (
        (F.col("longest_run") > limits.longest_words) & (100 * F.col("longest_run") > limits.longest_percent * n)
    )
    return out.withColumns({"base_failed": base_failed, "kept": ~base_failed & ~repetitive})


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_run_words", "longest_run")

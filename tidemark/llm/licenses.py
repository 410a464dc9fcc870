"""License scan by conditional compression.

Candidate blocks are stretches of text around cue words.  Each is compressed on
its own and with every template as a raw dictionary; the template that saves the
largest share of the block is the likeliest, as only its wording is new to the
compressor.  That only ranks them: every template is confirmed by exact wording, at
every place.  It is found where its words occur in the block in sequence with at
most ``differing`` of them replaced, missing or added, and none of those differences
touches a decisive word (a version, a clause or the name of the license).  One of
the first words, as many as may differ and one more, is in place, so a notice begins
at such a word.  Of overlapping notices the one with most words in place stays, then
the better ranked.

Null texts have no blocks.  Blocks are independent, so a text of any length is
scanned whole, block by block.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches

# Cue words, and wordings of license notices with the words that tell them apart.
CUES = r"(?i)licen[cs]e|copyright|spdx|permission is|warrant|public domain|creative commons|\bCC[ -]?(?:BY|0)"
TEMPLATES = (
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", "This project is licensed under the terms of the MIT license.", "mit"),
    ("MIT", "SPDX-License-Identifier: MIT", "mit"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software",
        "",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2 0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0", "apache 2 0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at",
        "apache 2 0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only", "gpl 3"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
        "gnu general 3",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero 3"),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met:",
        "",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2 0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
     " hereby granted", "fee"),
    ("CC0-1.0", "This work is released under CC0 1.0 Universal.", "cc0 1 0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4 0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by sa 4 0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4 0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "cc by nd 4 0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", "cc by nc sa 4 0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
)

_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Params:
    """``reach`` characters around a cue form a block."""

    reach: int = 400
    differing: float = 0.1


def blocks(text: str, cue: re.Pattern, reach: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of the stretches around cues; overlapping ones are one, but none exceeds 8 reaches."""
    begin = end = -1
    for m in cue.finditer(text):
        low, high = max(m.start() - reach, 0), min(m.end() + reach, len(text))
        if begin >= 0 and low <= end and high - begin <= 8 * reach:
            end = high
            continue
        if begin >= 0:
            yield begin, end
        begin, end = low, high
    if begin >= 0:
        yield begin, end


def aligned(
    template: list[str], words: list[str], most: int, missed: int, decisive: set[str]
) -> tuple[int, list[tuple[int, int]]] | None:
    """(differing words, places in both of the words in place) of the best alignment that begins with both first words.

    ``missed`` words of the template went before.  The count is the larger one of the missing and the added words,
    ``most`` at best; a decisive word is neither.
    """
    n, none = len(template), -1
    if template == words[:n]:
        return missed, [(k, k) for k in range(n)]
    if not most:
        return None
    # in place of template[: a + 1] and words[: b + 1]; at most ``most`` are missing and at most ``most`` added
    common = [[none] * len(words) for _ in range(n)]
    move = [[""] * len(words) for _ in range(n)]
    for a in range(n):
        for b in range(max(a - most, 0), min(a + most + 1, len(words))):
            best, how = none, ""
            if template[a] == words[b] and (not a and not b or a and b and common[a - 1][b - 1] >= 0):
                best, how = (common[a - 1][b - 1] if a else 0) + 1, "="
            if a and template[a] not in decisive and common[a - 1][b] > best:
                best, how = common[a - 1][b], "-"
            if b and words[b] not in decisive and common[a][b - 1] > best:
                best, how = common[a][b - 1], "+"
            common[a][b], move[a][b] = best, how
    ends = [
        (max(missed + n - common[-1][b], b + 1 - common[-1][b]), b) for b in range(len(words)) if common[-1][b] >= 0
    ]
    if not ends or min(ends)[0] > most:
        return None
    cost, b = min(ends)
    a, pairs = n - 1, []
    while a >= 0 and b >= 0:
        how = move[a][b]
        if how == "=":
            pairs.append((a, b))
        a, b = a - (how != "+"), b - (how != "-")
    return cost, pairs[::-1]


class Scanner:
    """The templates as dictionaries and as words."""

    def __init__(self, templates: Sequence[tuple[str, str, str]], params: Params) -> None:
        self.params, self.cue = params, re.compile(CUES)
        self.names = [name for name, _, _ in templates]
        self.words = [_WORD.findall(wording.lower()) for _, wording, _ in templates]
        self.decisive = [set(d.split()) for _, _, d in templates]
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self.plain = zstandard.ZstdCompressor(level=3)
        self.given = [
            zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=raw))
            for _, t, _ in templates
        ]

    def ranked(self, block: str) -> list[int]:
        """Templates by the share of their own size that they save, best first; equal ones in their order."""
        data = block.lower().encode()
        alone = len(self.plain.compress(data))
        saves = [(alone - len(c.compress(data))) / max(len(w), 1) for c, w in zip(self.given, self.words)]
        return sorted(range(len(saves)), key=lambda k: (-saves[k], k))

    def places(self, k: int, words: list[str]) -> Iterator[tuple[int, list[str], int, int]]:
        """(differing words, what differs, first and last word) of template ``k`` from every word that can be its first in place."""
        template, decisive = self.words[k], self.decisive[k]
        most = int(self.params.differing * len(template))
        known = set(words)
        if sum(w not in known for w in template) > most:
            return
        heads: dict[str, list[int]] = {}
        for j, w in enumerate(template[: most + 1]):
            heads.setdefault(w, []).append(j)
            if w in decisive:
                break
        for i, w in enumerate(words):
            best = None
            for j in heads.get(w, ()):
                got = aligned(template[j:], words[i : i + len(template) - j + most], most, j, decisive)
                if got and (best is None or got[0] < best[0]):
                    best = *got, j
            if best:
                cost, pairs, j = best
                part, diffs, a, b = words[i:], [], 0, 0
                for ta, tb in [*((x + j, y) for x, y in pairs), (len(template), pairs[-1][1] + 1)]:
                    if ta > a or tb > b:
                        diffs.append("-" + " ".join(template[a:ta]) + " +" + " ".join(part[b:tb]))
                    a, b = ta + 1, tb + 1
                yield cost, diffs, i, i + pairs[-1][1]

    def find(self, text: str) -> list[tuple[str, int, int, int, list[str]]]:
        """(license, begin, end, differing words, differences) of what a text declares, in order."""
        hits = []
        for low, high in blocks(text, self.cue, self.params.reach):
            block = text[low:high]
            spans = [(m.start(), m.end()) for m in _WORD.finditer(block)]
            words = [block[a:b].lower() for a, b in spans]
            for rank, k in enumerate(self.ranked(block) if words else ()):
                for cost, diffs, i, j in self.places(k, words):
                    hits.append((cost - len(self.words[k]), cost, rank, low + spans[i][0], low + spans[j][1], k, diffs))
        found: list[tuple[str, int, int, int, list[str]]] = []
        begins: list[int] = []
        for _, cost, _, begin, end, k, diffs in sorted(hits):
            at = bisect(begins, begin)
            if (at and found[at - 1][2] > begin) or (at < len(found) and found[at][1] < end):
                continue
            begins.insert(at, begin)
            found.insert(at, (self.names[k], begin, end, cost, diffs))
        return found


def scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str, str]] = TEMPLATES,
    params: Params = Params(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each license notice: id, license, begin, end, n_differing, differences.

    Texts without a cue word never reach Python.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scanner, rows = Scanner(templates, params), []
        for k, value in enumerate(batch.column(1)):
            rows += [(k, *hit) for hit in scanner.find(value.as_py())]
        if rows:
            at, name, begin, end, cost, diffs = map(list, zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(name), pa.array(begin, pa.int64()), pa.array(end, pa.int64()),
                 pa.array(cost, pa.int32()), pa.array(diffs, pa.list_(pa.string()))],
                [id_col, "license", "begin", "end", "n_differing", "differences"],
            )

    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("t")).where(F.col("t").rlike(CUES))
    kind = src.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, license string, begin bigint, `end` bigint, n_differing int, differences array<string>"
    return map_batches(src, run, schema)

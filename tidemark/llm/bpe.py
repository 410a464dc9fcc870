"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

The encoder reads text in chunks and emits a token as soon as no later input can
change it.  Two facts bound what it must hold back:

* A pre-token ends where the split pattern ends, so only the last match of a
  buffer can still grow.
* Inside a pre-token, unknown input to the right can only change tokens by a
  chain of merges.  Let ``d`` be the right-most boundary up to which all
  continuations agree.  Merges are applied in rank order; a merge (u, v) moves
  ``d`` left only if u is the token that ends at ``d`` and v starts there, and
  then by len(u).  The next such merge (u', v') has a higher rank, and its v'
  starts with u, because u is what now begins at ``d`` in every continuation.
  The longest such chain, summed over len(u), is the *sufficient lookahead*; a
  token that ends at least that many bytes before the end of the buffer is final.

Tokens that are final are emitted, and encoding resumes at their end: no merge
crosses a token boundary of the final result, so the rest encodes on its own.
Every text takes this way, in chunks of ``CHUNK`` characters.  Pre-tokens that are
complete are merged a window at a time, equal ones once; what they became is kept
for words of the last ``MEMO`` to 2 ``MEMO`` characters of new words, which changes
no token.  So memory is constant, whatever the length of a text, of a word, or the
number of words seen.

Decoding maps each id to its bytes and feeds them to an incremental UTF-8
machine, which keeps at most three bytes between tokens; malformed bytes become
U+FFFD.

Nulls count as empty texts: no tokens, and the digests of the empty string.
Every row has a result of its own, so repeated ids and rows stay; columns besides
the id and the text are not read, whatever their names.  No rows give no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches

# The split pattern of byte-level BPE vocabularies, and the
# classes of its unbounded runs.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUNS = (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")

#: Characters read at a time, and the longest word that is kept whole.
CHUNK = 1 << 16
LONG_WORD = 1 << 12
#: Characters of new words after which the older half of those remembered goes, and words that are merged together.
MEMO, WINDOW = 1 << 19, 1 << 14
#: Fewer new words than this are merged one by one.
FEW = 48
#: Rank of a pair that no merge joins.
NEVER = 1 << 60

#: Ids of a pre-token or a part of one, their decimal names with a comma before each, and their bytes.
Entry = tuple[tuple[int, ...], bytes, bytes]
#: What the transducer emits: complete pre-tokens, or entries of a long one.
Part = list[str] | list[Entry]


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of every byte: printable Latin-1 stands for itself, the rest follows U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Merge list, ids and special tokens of a ``tokenizers`` JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        merges = [(raw(a), raw(b)) for a, b in pairs]
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        self.rank = {(self.ids[a], self.ids[b]): r for r, (a, b) in enumerate(merges)}
        self.merged = [self.ids[a + b] for a, b in merges]
        self.byte_ids, self.merged_ids = np.array(self.byte_id), np.array(self.merged)
        keys = np.array([a << 32 | b for a, b in self.rank])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()

    @cached_property
    def lookahead(self) -> int:
        """See ``sufficient_lookahead``; only long words need it."""
        return sufficient_lookahead([(self.bytes_of[a], self.bytes_of[b]) for a, b in self.rank])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, ``NEVER`` where no merge joins them."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NEVER)


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after which a token is final: the longest chain of merges, see the module's text."""
    reach: dict[bytes, int] = {}  # by what begins at the boundary: the longest chain of later merges
    longest = 0
    for u, v in reversed(merges):
        chain = len(u) + reach.get(u, 0)
        longest = max(longest, chain)
        for k in range(1, len(v) + 1):
            if chain > reach.get(v[:k], 0):
                reach[v[:k]] = chain
    return longest + max((len(u) + len(v) for u, v in merges), default=1)


def merge_word(word: bytes, vocab: Vocabulary) -> list[int]:
    """Ids of one pre-token: the lowest-ranked pair first, left-most among equals."""
    ids = list(map(vocab.byte_id.__getitem__, word))
    rank = vocab.rank
    if len(ids) <= 256:
        get, merged = rank.get, vocab.merged
        ranks = [get(p, NEVER) for p in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) != NEVER:
            k = ranks.index(r)
            ids[k] = merged[r]
            del ids[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), NEVER)
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), NEVER)
        return ids
    right, left, n = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), len(ids)
    heap = [(rank[p], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in rank]
    heapq.heapify(heap)
    while heap:
        r, k, a, b = heapq.heappop(heap)
        j = right[k]
        if ids[k] != a or j >= n or ids[j] != b:
            continue
        ids[k], ids[j] = vocab.merged[r], -1
        right[k] = right[j]
        if right[j] < n:
            left[right[j]] = k
        for at in (left[k], k):
            if at >= 0 and right[at] < n and (p := (ids[at], ids[right[at]])) in rank:
                heapq.heappush(heap, (rank[p], at, *p))
    return [i for i in ids if i >= 0]


def merge_words(words: list[bytes], vocab: Vocabulary) -> list[list[int]]:
    """``merge_word`` of many words at once: each round joins the lowest-ranked pair of every word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ids = vocab.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    of = np.repeat(np.arange(len(words)), sizes)
    out: list[list[int]] = [[]] * len(words)
    ranks = vocab.ranks(ids[:-1], ids[1:])
    ranks[of[:-1] != of[1:]] = NEVER
    ranks = np.append(ranks, NEVER)
    while len(ids):
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        least = np.minimum.reduceat(ranks, starts)
        counts = np.diff(np.r_[starts, len(ids)])
        done = least == NEVER
        if done.any():
            flat = ids.tolist()
            for w, k, n in zip(of[starts[done]].tolist(), starts[done].tolist(), counts[done].tolist()):
                out[w] = flat[k : k + n]
            left = np.repeat(~done, counts)
            ids, of, ranks = ids[left], of[left], ranks[left]
            continue
        at = np.flatnonzero(ranks == np.repeat(least, counts))
        at = at[np.r_[True, of[at[1:]] != of[at[:-1]]]]  # the left-most of each word
        ids[at] = vocab.merged_ids[least]
        left = np.ones(len(ids), bool)
        left[at + 1] = False
        ids, of, ranks = ids[left], of[left], ranks[left]
        at -= np.arange(len(at))
        for k in (at, at[at > 0] - 1):
            inside = (k + 1 < len(ids)) & (of[k] == of[np.minimum(k + 1, len(ids) - 1)])
            ranks[k] = NEVER
            k = k[inside]
            ranks[k] = vocab.ranks(ids[k], ids[k + 1])
    return out


class Encoder:
    """Streaming transducer from text to ids; ``feed`` chunks, then ``finish``."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.split = regex.compile(SPLIT)
        self.runs = [regex.compile(p) for p in RUNS]
        self.special = regex.compile("|".join(regex.escape(s) for s in vocab.special)) if vocab.special else None
        self.hold = max(map(len, vocab.special), default=1) - 1
        self.young: dict[str, Entry] = {}
        self.old: dict[str, Entry] = {}
        self.held = 0  # characters of the words in ``young``
        self.reset()

    def reset(self) -> None:
        self.text = ""  # not yet split
        self.run: regex.Pattern | None = None  # class of the long word that is being read
        self.word = b""  # its bytes that aren't final

    def entry(self, ids: Iterable[int]) -> Entry:
        ids = tuple(ids)
        return ids, b"".join([b",%d" % i for i in ids]), b"".join(map(self.vocab.bytes_of.__getitem__, ids))

    def learn(self, words: set[str]) -> None:
        """Makes sure that ``words`` are remembered."""
        if self.held >= MEMO:
            self.young, self.old, self.held = {}, self.young, 0
        new = []
        for word in words.difference(self.young):
            self.held += len(word)
            if found := self.old.get(word):
                self.young[word] = found
            else:
                new.append(word)
        raw = [w.encode() for w in new]
        merged = merge_words(raw, self.vocab) if len(raw) >= FEW else [merge_word(w, self.vocab) for w in raw]
        self.young.update(zip(new, map(self.entry, merged)))

    def look(self, part: Part) -> list[Entry]:
        """Entries of one part."""
        if not part or not isinstance(part[0], str):
            return part
        self.learn(set(part))
        return list(map(self.young.__getitem__, part))

    @staticmethod
    def settled(text: str) -> tuple[str, str]:
        """The text up to its last single space between words, where the split pattern always cuts, and the rest."""
        end = len(text) - 1
        while (p := text.rfind(" ", 1, max(end, 1))) > 0:
            if not text[p - 1].isspace() and not text[p + 1].isspace():
                return text[:p], text[p:]
            end = p
        return "", text

    def _grow(self, part: str, last: bool) -> Iterator[Part]:
        """More of a long word; what can't change any more goes out."""
        self.word += part.encode()
        if last:
            yield [self.entry(merge_word(self.word, self.vocab))]
            self.word = b""
        elif len(self.word) > LONG_WORD + 2 * self.vocab.lookahead:
            final, end, stable = [], 0, len(self.word) - self.vocab.lookahead
            for i in merge_word(self.word, self.vocab):
                if end + len(self.vocab.bytes_of[i]) > stable:
                    break
                end += len(self.vocab.bytes_of[i])
                final.append(i)
            self.word = self.word[end:]
            yield [self.entry(final)]

    def _plain(self, last: bool) -> Iterator[Part]:
        """Splits the buffer; keeps what may still change, unless it is the last."""
        while self.text or (last and self.run):
            if self.run:
                end = m.end() if (m := self.run.match(self.text)) else 0
                ended = end < len(self.text)
                if self.run is self.runs[3] and end and (ended or not last):
                    end -= 1  # the last space may belong to the next word
                yield from self._grow(self.text[:end], ended or last)
                self.text = self.text[end:]
                if not (ended or last):
                    return
                self.run = None
                continue
            head, self.text = (self.text, "") if last else self.settled(self.text)
            if head:
                yield self.split.findall(head)
            if len(self.text) <= LONG_WORD:
                return
            words = self.split.findall(self.text)
            yield words[:-1]
            self.text = words[-1]
            if len(self.text) <= LONG_WORD:
                return
            self.run = next(p for p in self.runs if p.match(self.text[-1]))
            lead = 1 if self.text[0] == " " and self.run is not self.runs[3] else 0
            yield from self._grow(self.text[:lead], False)
            self.text = self.text[lead:]

    def feed(self, chunk: str) -> Iterator[Part]:
        """Parts that ``chunk`` completes."""
        self.text += chunk
        yield from self._specials(False)

    def finish(self) -> Iterator[Part]:
        yield from self._specials(True)
        self.reset()

    def _specials(self, last: bool) -> Iterator[Part]:
        while self.special and (m := self.special.search(self.text)):
            rest, self.text = self.text[m.end() :], self.text[: m.start()]
            yield from self._plain(True)
            yield [self.entry([self.vocab.special[m[0]]])]
            self.text = rest
        if last or not self.special:
            yield from self._plain(last)
        elif len(self.text) > self.hold:  # the end may begin a special token
            tail, self.text = self.text[-self.hold :], self.text[: -self.hold]
            yield from self._plain(False)
            self.text += tail

    def parts(self, text: str) -> Iterator[Part]:
        """Parts of a whole text, in order."""
        for k in range(0, len(text) - CHUNK, CHUNK):
            yield from self.feed(text[k : k + CHUNK])
        self.text += text[(len(text) - 1) // CHUNK * CHUNK :] if text else ""
        yield from self.finish()

    def encode(self, texts: Iterable[str]) -> Iterator[tuple[int, list[Entry]]]:
        """(place of the text, entries), in order; the words of a window are looked up together."""
        held: list[tuple[int, Part]] = []
        size = 0
        for k, text in enumerate(texts):
            for part in self.parts(text):
                held.append((k, part))
                size += len(part)
                if size >= WINDOW:
                    yield from self._looked(held)
                    held, size = [], 0
        yield from self._looked(held)

    def _looked(self, held: list[tuple[int, Part]]) -> Iterator[tuple[int, list[Entry]]]:
        whole = [bool(part) and isinstance(part[0], str) for _, part in held]
        self.learn(set().union(*(part for (_, part), w in zip(held, whole) if w)))
        for (k, part), w in zip(held, whole):
            yield k, list(map(self.young.__getitem__, part)) if w else part


class Decoder:
    """Incremental byte-to-text machine over ids."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.bytes_of = vocab.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.feed_bytes(b"".join(map(self.bytes_of.__getitem__, ids)))

    def feed_bytes(self, raw: bytes) -> str:
        """Text that the bytes of further ids complete."""
        return self.state.decode(raw)

    def finish(self) -> str:
        return self.state.decode(b"", True)


class Digest:
    """Count and hash of a text's ids, and hash of the text that they decode to."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.n, self.ids, self.text, self.decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(vocab)

    def add(self, part: list[Entry]) -> None:
        if part:
            ids, names, raw = zip(*part)
            self.ids.update(b"".join(names)[0 if self.n else 1 :])
            self.text.update(self.decoder.feed_bytes(b"".join(raw)).encode())
            self.n += sum(map(len, ids))

    def text_digest(self) -> str:
        self.text.update(self.decoder.finish().encode())
        return self.text.hexdigest()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary(path))
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array of int): every whole text as tokens."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        out: list[list[int]] = [[] for _ in range(batch.num_rows)]
        for k, part in e.encode(t.as_py() or "" for t in batch.column(1)):
            out[k] += [i for ids, _, _ in part for i in ids]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], [id_col, "ids"])

    src = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return map_batches(src, run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``text``: the text of every row of ids; null ids give the empty text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vocab, out = encoder(path).vocab, []
        for ids in batch.column(1).to_pylist():
            d = Decoder(vocab)
            out.append(d.feed(ids or ()) + d.finish())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [id_col, "text"])

    src = tokens.select(F.col(id_col), F.col(ids_col))
    return map_batches(src, run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count and digest of each text's ids, and the digest of what they decode to.

    Ids stream from the encoder into the hash and the decoder; no text's ids are held.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        counts, ids_sha, text_sha = [], [], []
        now = Digest(e.vocab)

        def ended(upto: int) -> None:
            """The texts before ``upto`` are over."""
            nonlocal now
            while len(counts) < upto:
                counts.append(now.n)
                ids_sha.append(now.ids.hexdigest())
                text_sha.append(now.text_digest())
                now = Digest(e.vocab)

        for k, part in e.encode(t.as_py() or "" for t in batch.column(1)):
            ended(k)
            now.add(part)
        ended(batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
            [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    src = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = src.schema[0].dataType.simpleString()
    return map_batches(src, run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

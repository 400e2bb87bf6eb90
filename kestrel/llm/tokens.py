"""Encoding of the whole corpus with a public byte-level tokenizer (problem 8).

The merges are compiled to a deterministic tokenization automaton. Its states are the tokens (the last one emitted)
and its arcs are labelled with tokens. It starts with all arcs; each merge, in order of priority, adds one gadget
that reroutes what would spell the merged pair to the merged token, i.e. takes away the arcs from tokens that end
in the left part to tokens that begin with the right part, as both stood when the merge came.

Ordered as a forest by their right parts, the tokens that end in a given part at a given time are one interval; ordered by
their left parts, those that begin with it are another. So a gadget takes away a rectangle of arcs, and the automaton is
a table: for every state the sorted intervals of labels that do not lead on. Exactly one accepted path spells every
prefix of a word, so encoding is one pass of table look-ups without a way back, and decoding emits the labels.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before the merges of the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose paths a worker remembers.
WORDS_KEPT = 300_000


def tokenizer_dir() -> str:
    return os.environ.get("KESTREL_TOKENIZERS", "/opt/tokenizers")


class Automaton:
    """Tokenization automaton of a rank file: lines of base64 token and id, ids of merged tokens in merge order."""

    def __init__(self, path: str):
        self.label: dict[int, bytes] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.label[int(rank)] = base64.b64decode(token)
        self.state = {v: k for k, v in self.label.items()}
        self.gadgets: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.words: dict[bytes, list[int]] = {}
        for rank in sorted(self.label):
            if pair := self._pair(rank):
                self.parts[rank] = pair
                self.gadgets[pair] = rank
        self._compile()
        starts: dict[bytes, set[int]] = {}
        for b in self.state:
            starts.setdefault(b[:2], set()).add(len(b))
        self.lengths = {k: sorted(v) for k, v in starts.items()}

    def _pair(self, rank: int) -> tuple[int, int] | None:
        """What a merge joins: the two earlier tokens that spell it and between which its predecessors left the arc."""
        b = self.label[rank]
        for i in range(1, len(b)):
            x, y = self.state.get(b[:i], rank), self.state.get(b[i:], rank)
            if x < rank and y < rank and self._open(x, y, rank):
                return x, y
        return None

    def _open(self, x: int, y: int, until: int) -> bool:
        """Whether the gadgets of rank under ``until`` leave the arc from x to y: going back in time, whichever of the two
        was made last is opened (of equals the right one, for merges run from left to right)."""
        while True:
            if self.gadgets.get((x, y), until) < until:
                return False
            rx, ry = (x if x in self.parts else -1), (y if y in self.parts else -1)
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                until, x = rx, self.parts[x][1]
            else:
                until, y = ry + 1, self.parts[y][0]

    def _forest(self, side: int) -> tuple[dict[int, list[int]], dict[int, int], dict[int, int]]:
        """Tokens in the order of a forest in which a token hangs below its part of one side: the children of each by rank,
        the place of each (after all below it) and the first place below it."""
        below: dict[int, list[int]] = {}
        for t in sorted(self.parts):
            below.setdefault(self.parts[t][side], []).append(t)
        place, first, n = {}, {}, 0
        for root in sorted(t for t in self.label if t not in self.parts):
            first[root], stack = n, [(root, 0)]
            while stack:
                t, i = stack.pop()
                own = below.get(t, ())
                if i < len(own):
                    stack += [(t, i + 1), (own[i], 0)]
                    first[own[i]] = n
                else:
                    place[t] = n
                    n += 1
        return below, place, first

    def _compile(self) -> None:
        """One gadget after another: its rectangle, as an interval of labels for each of its states; then one sorted list of
        disjoint intervals a state."""
        right, row, row_first = self._forest(1)
        left, col, col_first = self._forest(0)
        boxes = []
        for (x, y), rank in self.gadgets.items():
            later, i = right.get(x, ()), bisect_right(right.get(x, ()), rank)  # still x when the merge came: made into more later
            same, j = left.get(y, ()), bisect_left(left.get(y, ()), rank)
            boxes.append((row_first[later[i]] if i < len(later) else row[x], row[x] + 1, col_first[same[j]] if j < len(same) else col[y], col[y] + 1))
        b = np.array(boxes, np.int64).reshape(-1, 4)
        size = b[:, 1] - b[:, 0]
        at = np.repeat(b[:, 0], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        lo, hi = np.repeat(b[:, 2], size), np.repeat(b[:, 3], size)
        order = np.lexsort((hi, lo, at))
        at, lo, hi = at[order], lo[order], hi[order]
        n = len(self.label)
        reach = np.maximum.accumulate(hi + at * (n + 1)) - at * (n + 1)  # the furthest end so far in the row
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1]) | (lo[1:] > reach[:-1])
        last = np.append(np.nonzero(fresh)[0][1:], len(at)) - 1
        self.cut_from, self.cut_to = lo[fresh].tolist(), reach[last].tolist() if len(at) else []
        bounds = np.searchsorted(at[fresh], np.arange(n + 1)).tolist()
        self.row = {t: (bounds[p], bounds[p + 1]) for t, p in row.items()}
        self.col = col

    def arc(self, a: int, b: int) -> bool:
        """Whether token b may follow token a."""
        first, end = self.row[a]
        c = self.col[b]
        i = bisect_right(self.cut_from, c, first, end) - 1
        return i < first or self.cut_to[i] <= c

    def _path(self, word: bytes) -> list[int]:
        """The accepted path that spells ``word``: at every place where a prefix ends, the one token it ends in."""
        state, lengths, row, col, cut_from, cut_to = self.state, self.lengths, self.row, self.col, self.cut_from, self.cut_to
        n = len(word)
        ends: list[int] = [-1] * (n + 1)
        for at in range(n):
            if at:
                if ends[at] < 0:
                    continue
                first, end = row[ends[at]]
            for length in lengths.get(word[at:at + 2], ()) if at + 1 < n else ():
                t = state.get(word[at:at + length])
                if t is not None and at + length <= n:
                    if at:
                        c = col[t]
                        i = bisect_right(cut_from, c, first, end) - 1
                        if i >= first and cut_to[i] > c:
                            continue
                    ends[at + length] = t
            t = state[word[at:at + 1]]
            if not at or self.arc(ends[at], t):
                ends[at + 1] = t
        path = []
        while n:
            path.append(ends[n])
            n -= len(self.label[ends[n]])
        return path[::-1]

    def encode_word(self, word: bytes) -> list[int]:
        got = self.words.get(word)
        if got is None:
            if len(self.words) > WORDS_KEPT:
                self.words.clear()
            t = self.state.get(word)
            got = self.words[word] = [t] if t is not None and (t in self.parts or len(word) == 1) else self._path(word)
        return got

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for w in regex.findall(SPLIT, text):
            out.extend(self.encode_word(w.encode("utf-8", "replace")))
        return out

    def decode(self, ids) -> str:
        return b"".join(self.label[i] for i in ids).decode("utf-8", "replace")


_BUILT: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    if path not in _BUILT:
        _BUILT[path] = Automaton(path)
    return _BUILT[path]


def encode_corpus(docs: DataFrame, vocabulary: str = "byte_bpe_50k", directory: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` of every row: token ids without special tokens; an empty list for empty and NULL texts.

    Strings that spell a special token are ordinary text. Unpaired surrogates cannot occur in Spark strings.
    Texts of any length are encoded whole. Repeated rows give repeated rows; no rows give none. The vocabulary is a
    file under ``directory`` (KESTREL_TOKENIZERS, else /opt/tokenizers) on every executor; nothing is shuffled.
    """
    path = f"{directory or tokenizer_dir()}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for batch in batches:
            ids = pa.array([a.encode(t) if t else [] for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_corpus(encoded: DataFrame, vocabulary: str = "byte_bpe_50k", directory: str | None = None) -> DataFrame:
    """``(doc_id, text)``: the texts that ``encode_corpus`` was given; NULL ids give an empty text."""
    path = f"{directory or tokenizer_dir()}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

"""Evaluation texts leaking into training text (problem 9).

The test items are held in a BM25 inverted index with block maxima. Every passage of every document (20 words, a new
one each 10, so each run of 10 words lies whole in one) is a query, answered by block-max WAND. The threshold of
an item is the least BM25 weight that any 10 consecutive words of it carry, so retrieval loses no true case; what it
returns is then verified word by word.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.lookalike import fold
from kestrel.session import cut

#: Consecutive words that make a leak; BM25 constants; postings of a block; characters of items indexed at once (about
#: thirty times as many bytes of index in a worker).
RUN, K1, B, BLOCK, ITEM_CHARS = 10, 1.2, 0.75, 16, 8_000_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Words without case, punctuation, white space and differences that only exist in code."""
    return _WORD.findall(fold(text).lower())


class ItemIndex:
    """Inverted index of the items, one posting list per term in item order, cut into blocks with maxima."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN):
        self.run = run
        texts = [(i, words(t)) for i, t in sorted(items)]
        texts = [(i, w) for i, w in texts if len(w) >= run]
        self.ids = [i for i, _ in texts]
        self.term: dict[str, int] = {}
        rows = [[self.term.setdefault(x, len(self.term)) for x in w] for _, w in texts]
        n, mean = max(1, len(rows)), sum(map(len, rows)) / max(1, len(rows))
        df = np.zeros(len(self.term), int)
        for r in rows:
            df[list(set(r))] += 1
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5)) if len(df) else np.zeros(0)
        self.items: list[list[int]] = [[] for _ in self.term]
        self.weights: list[list[float]] = [[] for _ in self.term]
        self.least, self.runs = [], []
        for k, r in enumerate(rows):
            tf: dict[int, int] = {}
            for t in r:
                tf[t] = tf.get(t, 0) + 1
            w = {t: float(idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(r) / mean))) for t, c in tf.items()}
            for t, x in w.items():
                self.items[t].append(k)
                self.weights[t].append(x)
            starts = range(len(r) - run + 1)
            self.least.append(min(sum(w[t] for t in set(r[s:s + run])) for s in starts) - 1e-9)
            self.runs.append({tuple(r[s:s + run]) for s in starts})
        self.floor = min(self.least, default=math.inf)
        self.top = np.array([max(w) for w in self.weights] + [0.0])  # the last one is for words of no item
        self.last = [[i[min(len(i), s + BLOCK) - 1] for s in range(0, len(i), BLOCK)] for i in self.items]
        self.block = [[max(w[s:s + BLOCK]) for s in range(0, len(w), BLOCK)] for w in self.weights]

    def retrieve(self, terms: list[int]) -> list[int]:
        """Items whose BM25 score for the query reaches their threshold."""
        hits, at, end = [], {t: 0 for t in terms}, len(self.ids)
        live = sorted(terms, key=lambda t: self.items[t][0])
        while live:
            bound, pivot = 0.0, -1
            for k, t in enumerate(live):
                bound += self.top[t]
                if bound >= self.floor:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = self.items[live[pivot]][at[live[pivot]]]
            while pivot + 1 < len(live) and self.items[live[pivot + 1]][at[live[pivot + 1]]] == item:
                pivot += 1
            front = live[: pivot + 1]
            # Block maxima: the block of each list that would hold the pivot item, found by the last items of the blocks.
            bound, upto = 0.0, end if pivot + 1 == len(live) else self.items[live[pivot + 1]][at[live[pivot + 1]]]
            for t in front:
                b = bisect_left(self.last[t], item, at[t] // BLOCK)
                if b < len(self.last[t]):
                    bound += self.block[t][b]
                    upto = min(upto, self.last[t][b] + 1)
            if bound < self.floor:
                target = max(upto, item + 1)
            elif self.items[live[0]][at[live[0]]] == item:
                if sum(self.weights[t][at[t]] for t in front) >= self.least[item]:
                    hits.append(item)
                target = item + 1
            else:
                target = item
            for t in front:  # whole blocks are jumped, then one is searched
                b = bisect_left(self.last[t], target, at[t] // BLOCK)
                at[t] = bisect_left(self.items[t], target, max(at[t], b * BLOCK), min(len(self.items[t]), (b + 1) * BLOCK))
            live = sorted((t for t in live if at[t] < len(self.items[t])), key=lambda t: self.items[t][at[t]])
        return hits

    def leaks(self, text: str) -> list[int]:
        """Ids of the items of which the text holds ``run`` consecutive words."""
        none = len(self.term)
        seq = [self.term.get(w, none) for w in words(text)]
        n, run = len(seq), self.run
        if n < run or not self.ids:
            return []
        # A leaked run has only words of items, and their greatest weights reach the least threshold.
        ids = np.array(seq)
        total = np.concatenate([[0.0], np.cumsum(self.top[ids])])
        other = np.concatenate([[0], np.cumsum(ids == none)])
        able = (total[run:] - total[:-run] >= self.floor) & (other[run:] == other[:-run])
        found: set[int] = set()
        for s in range(0, n - run + 1, run):
            at = np.nonzero(able[s:s + run])[0]
            if not len(at):
                continue
            window = seq[s + at[0]:s + at[-1] + run]
            for k in self.retrieve([t for t in dict.fromkeys(window) if t != none]):
                if k not in found and any(tuple(window[j:j + run]) in self.runs[k] for j in range(len(window) - run + 1)):
                    found.add(k)
        return [self.ids[k] for k in found]


def leaked(docs: DataFrame, items: DataFrame, run: int = RUN, item_chars: int = ITEM_CHARS) -> DataFrame:
    """``(doc_id, item_id)``: documents that hold ``run`` or more consecutive words of an item.

    Case, punctuation, white space, line breaks and characters that only look different in code do not matter.
    NULL and empty texts hold nothing; items of fewer words than ``run`` are never held; repeated rows and items
    count once; empty tables give no rows. Items are taken in blocks of at most ``item_chars`` characters, each indexed
    once and broadcast; the driver holds one block at a time, and if there are several the documents are read once for
    each. Documents are not shuffled and are read whole, passage by passage.
    """
    spark = docs.sparkSession
    d = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = items.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id").toLocalIterator()

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(ItemIndex(block, run))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value  # read once a worker
            for batch in batches:
                ids, got = [], []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for k in index.leaks(t):
                        ids.append(i)
                        got.append(k)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(got, pa.int64())], ["doc_id", "item_id"])

        return d.mapInArrow(look, "doc_id long, item_id long")

    block: list[tuple[int, str]] = []
    out, size = None, 0
    for r in rows:
        if size and size + len(r["text"]) > item_chars:
            part = cut(scan(block))
            out = part if out is None else out.unionByName(part)
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    part = scan(block)
    return (part if out is None else out.unionByName(part)).distinct()

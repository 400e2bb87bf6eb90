"""Exact comparison of vectors in pairs of blocks: nearest ones, and what is connected.

Vectors travel as binary float32, as they are, and are brought to unit length in float64 where they are compared. Each pair of blocks is one task of bounded size, takes each vector once
and gives a few rows a vector, never its pairs. The work is the square of the rows: meant for up to some million vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(batch: pa.RecordBatch, width: int, at: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Places in the batch, and float32 vectors as they are, of the rows whose vector has its width and only finite numbers, not all 0."""
    col = batch.column(at)
    off = col.offsets.to_numpy()
    ok = np.asarray(col.is_valid()) & (np.diff(off) == width)
    values = col.values.to_numpy(zero_copy_only=False)
    x = values[off[:-1][ok][:, None] + np.arange(width)].astype(np.float32) if ok.any() else np.empty((0, width), np.float32)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return np.nonzero(ok)[0][good], x[good]


def binary(x: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(x)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(data.dtype.itemsize * data.shape[1]), len(data), [None, pa.py_buffer(data)]).cast(pa.binary())


def matrix(t: pa.Table | pa.RecordBatch, name: str, width: int, kind=np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), kind).reshape(-1, width)


def units(t: pa.Table | pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """Packed vectors as float64 rows of length one."""
    x = matrix(t, name, width).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def pack(df: DataFrame, width: int, *keep: str) -> DataFrame:
    """``df(id, embedding)`` as ``(id, keep..., v)`` without unusable vectors; rows of one id are one record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = usable(batch, width)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), *[rows.column(2 + k) for k in range(len(keep))], binary(x)], ["id", *keep, "v"])

    d = df.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), "embedding", *keep)
    types = dict(d.dtypes)
    return d.mapInArrow(run, "id long, " + "".join(f"{k} {types[k]}, " for k in keep) + "v binary").dropDuplicates(["id"])


def _cut(df: DataFrame, parts, *by: str) -> DataFrame:
    """Rows sent to every pair of blocks that theirs is in."""
    own, other = F.pmod(F.xxhash64("id"), parts), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    d = df.withColumn("own", own).withColumn("other", other)
    return d.select(*by, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "v")


def _top(q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of every row of ``s`` that reach ``least``, of equal ones the smaller id; columns are in order of id."""
    good = s >= least
    full = np.nonzero(good.sum(1) > max(64, 2 * k))[0]  # rows with many: what lies under their k-th best goes first
    if len(full):
        good[full] &= s[full] >= np.partition(s[full], -k, axis=1)[:, -k:].min(1, keepdims=True)
    r, c = np.nonzero(good)
    order = np.lexsort((c, -s[r, c], r))
    r, c = r[order], c[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    r, c = r[keep], c[keep]
    return q[r], ids[c], s[r, c]


def self_nearest(df: DataFrame, width: int, k: int, least: float, block: int = 16_384) -> DataFrame:
    """``(q, id, score)``: of ``df(id, v)`` the ``k`` nearest of every vector, itself left out, cosine ``least`` or more."""
    n = max(1, -(-df.count() // block))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, own, x = t.column("id").to_numpy(), t.column("own").to_numpy(), units(t, "v", width)
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        out = []
        for a, b in {(i, j), (j, i)}:
            left, right = np.nonzero(own == a)[0], np.nonzero(own == b)[0]
            for s in range(0, len(left), 1024):
                rows = left[s:s + 1024]
                sim = x[rows] @ x[right].T
                sim[ids[rows][:, None] == ids[right]] = -2
                out.append(_top(ids[rows], ids[right], sim, k, least))
        q, m, c = (np.concatenate(z) for z in zip(*out)) if out else ([], [], [])
        return pa.table({"q": pa.array(q, pa.int64()), "id": pa.array(m, pa.int64()), "score": pa.array(c, pa.float64())})

    got = _cut(df, F.lit(n)).groupBy("i", "j").applyInArrow(run, "q long, id long, score double")
    return best_of(got, k)


def nearest_of(queries: DataFrame, members: DataFrame, width: int, k: int, least: float = -1.0, block: int = 16_384) -> DataFrame:
    """``(q, id, score)``: of ``members(id, v)`` the ``k`` nearest to every one of ``queries(id, v)``."""
    nq, nm = (max(1, -(-d.count() // block)) for d in (queries, members))
    spread = lambda d, own, other, asks: d.select(F.pmod(F.xxhash64("id"), F.lit(own[1])).alias(own[0]), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other[1] - 1).cast("long"))).alias(other[0]), F.lit(asks).alias("asks"), "id", "v")
    rows = spread(queries, ("i", nq), ("j", nm), True).unionByName(spread(members, ("j", nm), ("i", nq), False))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, asks, x = t.column("id").to_numpy(), t.column("asks").to_numpy(zero_copy_only=False).astype(bool), units(t, "v", width)
        left, right, out = np.nonzero(asks)[0], np.nonzero(~asks)[0], []
        for s in range(0, len(left) if len(right) else 0, 1024):
            rows = left[s:s + 1024]
            out.append(_top(ids[rows], ids[right], x[rows] @ x[right].T, k, least))
        q, m, c = (np.concatenate(z) for z in zip(*out)) if out else ([], [], [])
        return pa.table({"q": pa.array(q, pa.int64()), "id": pa.array(m, pa.int64()), "score": pa.array(c, pa.float64())})

    return best_of(rows.groupBy("i", "j").applyInArrow(run, "q long, id long, score double"), k)


def best_of(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of every query of ``(q, id, score)``; of equal scores the smaller id."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k)  # k rows for each block at most
    return hits.groupBy("q").agg(best.alias("b")).select("q", F.explode("b").alias("b")).select("q", "b.id", (-F.col("b.s")).alias("score"))


def tie(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row of each connected part, after rows ``a`` and ``b`` are tied; ``top`` is that of before."""
    while True:
        p, q = top[a], top[b]
        apart = p != q
        if not apart.any():
            return top
        np.minimum.at(top, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while not np.array_equal(top, up := top[top]):
            top = up


def ties(df: DataFrame, width: int, least: float, part: str | None = None, block: int = 8192) -> DataFrame:
    """``(a, b)``: edges that connect whatever of ``df(id, v)`` is alike (cosine about ``least`` or more), directly or through
    others, within each value of ``part``: a forest for every pair of blocks, whose edges are fewer than its rows."""
    by = [part] if part else []
    sizes = df.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("long").alias("parts"))
    rows = df.join(F.broadcast(sizes), part) if part else df.crossJoin(F.broadcast(sizes))

    def run(t: pa.Table) -> pa.Table:
        ids, own, x = t.column("id").to_numpy(), t.column("own").to_numpy(), units(t, "v", width).astype(np.float32)
        a, b = np.nonzero(own == t.column("i")[0].as_py())[0], np.nonzero(own == t.column("j")[0].as_py())[0]
        top = np.arange(len(ids))
        for s in range(0, len(a), 512):
            r, c = np.nonzero(x[a[s:s + 512]] @ x[b].T >= least - 1e-4)  # more ties than needed are harmless
            top = tie(top, a[s + r], b[c])
        tied = np.nonzero(top != np.arange(len(ids)))[0]
        return pa.table({"a": ids[tied], "b": ids[top[tied]]})

    return _cut(rows, F.greatest(F.col("parts"), F.lit(1)), *by).groupBy(*by, "i", "j").applyInArrow(run, "a long, b long")


def means(members: DataFrame, width: int) -> DataFrame:
    """``(group, n, v)`` of ``members(group, v)``: size and mean as a unit vector. Each batch sends one sum a group."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, at, n = np.unique(b.column("group").to_numpy(), return_inverse=True, return_counts=True)
            t = np.zeros((len(g), width))
            np.add.at(t, at, units(b, "v", width))
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n), binary(t)], ["group", "n", "s"])

    def add(t: pa.Table) -> pa.Table:
        g, at = np.unique(t.column("group").to_numpy(), return_inverse=True)
        total, n = np.zeros((len(g), width)), np.zeros(len(g), np.int64)
        np.add.at(total, at, matrix(t, "s", width, np.float64))
        np.add.at(n, at, t.column("n").to_numpy())
        x = (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-30)).astype(np.float32)
        return pa.table({"group": g, "n": n, "v": binary(x)})

    s = members.select("group", "v").mapInArrow(sums, "group long, n long, s binary")
    return s.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(64))).groupBy("bucket").applyInArrow(add, "group long, n long, v binary")

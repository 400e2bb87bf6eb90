"""Usable vectors and their shards, and the two operators on them: nearest neighbours and similarity clusters.

Shards: pivots are taken from the vectors themselves; a vector belongs to the shards of its few nearest pivots, so
two similar vectors meet in at least one shard. A shard that a bounded sample shows to be heavy is cut into parts. A
vector that very many records share is hot: its first records stand for the others, which take part by their id only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.functions.clean import label
from kestrel.llm.hnsw import Graph
from kestrel.session import cut, partitions

#: Vectors sampled to shape shards, four for each pivot if that is more; most pivots; pivots compared one by one, more of
#: them by way of TOPS; rows of a shard that is one part; ids that are sent to all executors at most (16 MB); records that
#: make a vector hot; bytes of vectors of a task.
SAMPLE, PIVOTS, FLAT, TOPS, PART, SENT, HOT, TASK_BYTES = 16_384, 65_536, 4096, 256, 32_000, 2_000_000, 1000, 48_000_000


def usable(batch: pa.RecordBatch, width: int, where: bool = False) -> tuple[np.ndarray, ...]:
    """Ids and unit float32 vectors of the rows whose vector has its full width, only finite numbers, not all zero; with
    ``where`` also their places in the batch."""
    ids, col = batch.column(0), batch.column(1)
    ok = np.asarray(col.is_valid()) & np.asarray(ids.is_valid())
    off = col.offsets.to_numpy()
    ok &= np.diff(off) == width
    values = col.values.to_numpy(zero_copy_only=False)
    at = off[:-1][ok]
    x = values[at[:, None] + np.arange(width)].astype(np.float64) if len(at) else np.empty((0, width))
    keep = np.isfinite(x).all(1) & (x != 0).any(1)
    x = x[keep]
    big = np.abs(x).max(1, keepdims=True) if len(x) else 1.0
    x = x / big
    out = ids.to_numpy(zero_copy_only=False)[ok][keep].astype(np.int64), (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return (*out, np.nonzero(ok)[0][keep]) if where else out


def _key(x: np.ndarray) -> np.ndarray:
    """64-bit keys of float32 rows; equal rows have equal keys."""
    mult = np.random.default_rng(11).integers(1, 1 << 63, x.shape[1], np.uint64) | np.uint64(1)
    return (np.ascontiguousarray(x + np.float32(0)).view(np.uint32).astype(np.uint64) * mult).sum(1)


class Shards:
    """Pivots, how many parts each shard has, how many shards a vector belongs to, and the hot vectors."""

    def __init__(self, df: DataFrame, width: int, per_shard: int, spread: int, part: int = PART, keep: int = 1, hot: int = HOT, flat: int = FLAT):
        n = df.where(F.size("embedding") == width).count()
        want = int(min(PIVOTS, max(1, n // per_shard)))
        seen = df.where((F.size("embedding") == width) & F.col("id").isNotNull()).select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE, 4 * want)).toArrow()
        xs = [usable(b, width)[1] for b in seen.to_batches()]
        x = np.concatenate(xs) if xs else np.empty((0, width), np.float32)
        self.width, self.rows, self.keep, scale = width, n, keep, n / max(1, len(x))
        _, first, at, count = np.unique(_key(x), return_index=True, return_inverse=True, return_counts=True) if len(x) else (None, *[np.empty(0, np.int64)] * 3)
        self.pivots = x[np.sort(first)[:want]]
        self.spread = min(spread, max(1, len(self.pivots)))
        much = (count >= 4) & (count * scale >= hot)
        self.hot_keys = np.sort(_key(x[first[much]])) if much.any() else np.empty(0, np.uint64)
        self.kept = self._first_of_hot(df) if len(self.hot_keys) else []
        self._tops(flat)
        load = np.bincount(self.of(x[~much[at]] if len(x) else x).ravel(), minlength=max(1, len(self.pivots))) * scale
        self.parts = np.maximum(1, np.ceil(load / part)).astype(np.int64)
        self.sent = float((load * self.parts).sum())  # rows that go to the tasks of shards

    def _tops(self, flat: int) -> None:
        self.tops: np.ndarray | None = None
        if len(self.pivots) > flat:
            self.tops = self.pivots[: min(TOPS, len(self.pivots) // 8)]
            home = (self.pivots @ self.tops.T).argmax(1)
            self.below = [np.nonzero(home == g)[0] for g in range(len(self.tops))]

    def of(self, x: np.ndarray) -> np.ndarray:
        if len(self.pivots) <= 1:
            return np.zeros((len(x), 1), np.int64)
        if self.tops is None:
            return np.argpartition(-(x @ self.pivots.T), self.spread - 1, axis=1)[:, : self.spread].astype(np.int64)
        near = x @ self.tops.T
        asked = np.argpartition(-near, min(15, near.shape[1] - 1), axis=1)[:, :16]
        best, which = np.full((len(x), self.spread), -2.0, np.float32), np.zeros((len(x), self.spread), np.int64)
        for g, pivots in enumerate(self.below):
            rows = np.nonzero((asked == g).any(1))[0]
            if not len(rows) or not len(pivots):
                continue
            sim = np.concatenate([best[rows], x[rows] @ self.pivots[pivots].T], 1)
            to = np.concatenate([which[rows], np.broadcast_to(pivots, (len(rows), len(pivots)))], 1)
            top = np.argpartition(-sim, self.spread - 1, axis=1)[:, : self.spread]
            best[rows], which[rows] = np.take_along_axis(sim, top, 1), np.take_along_axis(to, top, 1)
        return which

    def part_of(self, ids: np.ndarray, shard: np.ndarray) -> np.ndarray:
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return (mixed % self.parts[shard].astype(np.uint64)).astype(np.int64)

    def tasks(self, df: DataFrame, row_bytes: int) -> int:
        return max(partitions(df.sparkSession), int(np.ceil(self.sent * row_bytes / TASK_BYTES)))

    # Hot vectors: the first records of each (``kept``) are placed; the rest, its twins, are not.

    def _hot(self, x: np.ndarray) -> np.ndarray:
        """Index of the hot vector that each row equals, -1 for others."""
        k = _key(x)
        at = np.minimum(np.searchsorted(self.hot_keys, k), len(self.hot_keys) - 1)
        return np.where(self.hot_keys[at] == k, at, -1)

    def _first_of_hot(self, df: DataFrame) -> list[np.ndarray]:
        width, keep = self.width, self.keep

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, x = usable(batch, width)
                h = self._hot(x)
                rows = np.unique(np.stack([h[h >= 0], ids[h >= 0]], 1), axis=0)
                rows = rows[np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0]) < keep]
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["h", "id"])

        w = Window.partitionBy("h").orderBy("id")
        few = df.select("id", "embedding").mapInArrow(run, "h long, id long").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep)
        kept: list[list[int]] = [[] for _ in self.hot_keys]
        for r in few.collect():  # at most ``keep`` for each hot vector of the sample
            kept[r["h"]].append(r["id"])
        return [np.array(sorted(k), np.int64) for k in kept]

    def placed(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Which rows are no twins."""
        if not len(self.hot_keys):
            return np.ones(len(ids), bool)
        return (self._hot(x) < 0) | np.isin(ids, np.concatenate(self.kept))

    def twins(self, df: DataFrame) -> DataFrame | None:
        """``(id, first)``: the records of hot vectors that are not placed, with each that stands for them."""
        if not len(self.hot_keys):
            return None
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, x = usable(batch, width)
                out = ~self.placed(ids, x)
                h, ids = self._hot(x[out]), ids[out]
                first = np.concatenate([self.kept[k] for k in h]) if len(h) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(self.kept[k]) for k in h]).astype(np.int64)), pa.array(first)], ["id", "first"])

        return df.select("id", "embedding").mapInArrow(run, "id long, first long")


def _binary(x: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(x)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(data.dtype.itemsize * data.shape[1]), len(data), [None, pa.py_buffer(data)]).cast(pa.binary())


def _matrix(col: pa.ChunkedArray, kind, width: int) -> np.ndarray:
    fixed = pa.binary(width * np.dtype(kind).itemsize)
    parts = [c.cast(fixed) for c in col.chunks if len(c)]
    views = [np.frombuffer(c.buffers()[1], kind).reshape(-1, width)[c.offset:c.offset + len(c)] for c in parts]
    return np.concatenate(views) if views else np.empty((0, width), kind)


def _fixed(x: np.ndarray) -> np.ndarray:
    """Numbers of -1 to 1 as 24-bit fixed point (1e-7 exact), three bytes each."""
    wide = np.round(x.astype(np.float64) * 8_388_607).astype("<i4").view(np.uint8).reshape(*x.shape, 4)
    return np.ascontiguousarray(wide[:, :, :3]).reshape(len(x), 3 * x.shape[1])


def _unfixed(b: np.ndarray, width: int) -> np.ndarray:
    """Unit vectors as float32 of what ``_fixed`` made."""
    wide = np.zeros((len(b), width, 4), np.uint8)
    wide[:, :, 1:] = b.reshape(len(b), width, 3)
    x = (wide.view("<i4").reshape(len(b), width) >> 8).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _order(ids: np.ndarray) -> np.ndarray:
    """The random but fixed order of pivots: a hash of the id."""
    h = ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)


# --- Nearest neighbours (problem 1) ----------------------------------------------------------------------------


def _neighbours_in_part(width: int, k: int, floor: float):
    """Graph over the part's own vectors; all queries of the shard search it. Rows (q, id, far)."""

    def run(t: pa.Table) -> pa.Table:
        ids, own = t.column("id").to_numpy(), t.column("own").to_numpy(zero_copy_only=False).astype(bool)
        x = _unfixed(_matrix(t.column("v"), np.uint8, 3 * width), width)
        ids, first = np.unique(ids, return_index=True)  # repeated rows are one record
        x, own = x[first], own[first]
        # Equal vectors are one node of the graph: thousands of copies would fill all links with each other.
        _, rep, cls = np.unique(np.ascontiguousarray(x[own]).view(np.dtype((np.void, 4 * width))).ravel(), return_index=True, return_inverse=True)
        members_of = np.argsort(cls, kind="stable")  # by class, then by id
        starts = np.searchsorted(cls[members_of], np.arange(len(rep) + 1))
        own_ids, nodes = ids[own], np.ascontiguousarray(x[own][rep])
        graph = Graph(nodes)
        q_ids, near = [], []
        if len(nodes):
            found = graph.neighbours(k, floor=floor - 0.25)
            q_ids.append(own_ids)
            near.append(np.concatenate([cls[:, None], found[cls]], 1))
            if not own.all():
                q_ids.append(ids[~own])
                near.append(graph.search(x[~own], k + 1, floor=floor - 0.25))
        out_q, out_i, out_f = [], [], []
        pos = {True: np.nonzero(own)[0], False: np.nonzero(~own)[0]}
        for mine, q, nn in zip((True, False), q_ids, near):
            size = np.where(nn >= 0, np.minimum(starts[np.maximum(nn, 0) + 1] - starts[np.maximum(nn, 0)], k + 1), 0)
            row = np.repeat(np.arange(len(q)), size.sum(1))
            flat, flat_size = nn.ravel(), size.ravel()
            begin = np.repeat(starts[np.maximum(flat, 0)], flat_size)
            step = np.arange(len(begin)) - np.repeat(np.cumsum(flat_size) - flat_size, flat_size)
            other = members_of[begin + step]
            keep = own_ids[other] != q[row]
            row, other = row[keep], other[keep]
            a, b = x[pos[mine]][row].astype(np.float64), x[own][other].astype(np.float64)
            cos = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
            good = cos >= floor
            row, other, cos = row[good], other[good], np.round(cos[good], 9)
            best = np.lexsort((own_ids[other], -cos, row))
            row, other, cos = row[best], other[best], cos[best]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            top = place < k
            out_q.append(q[row[top]])
            out_i.append(own_ids[other[top]])
            out_f.append(-cos[top])
        cat = (lambda z, d: np.concatenate(z).astype(d) if z else np.empty(0, d))
        return pa.table({"q": cat(out_q, np.int64), "id": cat(out_i, np.int64), "far": cat(out_f, np.float64)})

    return run


def nearest(df: DataFrame, width: int, k: int = 5, floor: float = 0.75, per_shard: int = 3000, spread: int = 4, part: int = PART, hot: int = HOT) -> DataFrame:
    """``(q, id, cos)``: of ``df(id, embedding)`` the ``k`` vectors most similar to every vector, cosine ``floor`` or more.

    Vectors of another width, with NULL, NaN or infinite numbers or all zero are unusable: neither queries nor
    results. Length means nothing. Equal cosines go to the smaller id. Rows repeated exactly are one record; equal
    vectors of different records are compared once and given out by id. Approximate: a pair is missed when no shard
    holds both or the graph does not lead there. No usable vectors: no rows.
    """
    s = Shards(df, width, per_shard, spread, part, k + 1, hot)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = usable(batch, width)
            own = s.placed(ids, x)
            ids, x = ids[own], x[own]
            shard = s.of(x)
            row, shard = np.repeat(np.arange(len(ids)), shard.shape[1]), shard.ravel()
            parts = s.parts[shard]
            home = s.part_of(ids[row], shard)
            rep = np.repeat(np.arange(len(row)), parts)
            to = np.arange(len(rep)) - np.repeat(np.cumsum(parts) - parts, parts)
            v = _fixed(x)
            for b in range(0, len(rep), 8192):
                r, p = rep[b:b + 8192], to[b:b + 8192]
                yield pa.RecordBatch.from_arrays([pa.array(shard[r], pa.int32()), pa.array(p, pa.int32()), pa.array(ids[row[r]]), pa.array(home[r] == p), _binary(v[row[r]])], ["shard", "part", "id", "own", "v"])

    rows = df.select("id", "embedding").mapInArrow(place, "shard int, part int, id long, own boolean, v binary").repartition(s.tasks(df, 3 * width + 24), "shard", "part")
    got = rows.groupBy("shard", "part").applyInArrow(_neighbours_in_part(width, k, floor), "q long, id long, far double")
    twins = s.twins(df)
    if twins is not None:  # their nearest are the first of their own vector
        got = got.unionByName(twins.where("id <> first").select(F.col("id").alias("q"), F.col("first").alias("id"), F.lit(-1.0).alias("far")))
    merged = got.groupBy("q").agg(F.slice(F.array_sort(F.collect_set(F.struct("far", "id"))), 1, k).alias("best"))  # at most k a part
    return merged.select("q", F.explode("best").alias("b")).select("q", "b.id", (-F.col("b.far")).alias("cos"))


def near_pairs(df: DataFrame, width: int, **options) -> DataFrame:
    """``(id_a, id_b)``, a < b, once: pairs of which one is among the nearest of the other; see ``nearest``."""
    n = nearest(df, width, **options)
    return n.select(F.least("q", "id").alias("id_a"), F.greatest("q", "id").alias("id_b")).distinct()


# --- Similarity clusters (problem 2) ----------------------------------------------------------------------------


def _pivots_in_shard(width: int, floor: float):
    """Pivot clustering of what one task sees, and the stars of its connected parts.

    Rows (f, to, sim): ``sim`` >= 0 for every local pivot near f (a pivot is near itself; one alone says so only in
    the task marked as its first), -1 for the smallest vector of f's connected part, if that is another. No pairs within
    a group are listed: pivots near one vector are a few, stars one a vector.
    """

    def run(t: pa.Table) -> pa.Table:
        ids, first = np.unique(t.column("id").to_numpy(), return_index=True)
        x = _matrix(t.column("v"), np.int16, width)[first].astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        speaks = t.column("first").to_numpy(zero_copy_only=False).astype(bool)[first]
        order = np.argsort(_order(ids), kind="stable")
        n, step = len(ids), 512
        cluster = np.full(n, -1)
        out_f, out_p, out_s = [], [], []
        at = 0
        while at < n:
            todo = []
            while at < n and len(todo) < step:
                take = order[at:at + step - len(todo)]
                todo.extend(take[cluster[take] < 0].tolist())
                at += len(take)
            if not todo:
                break
            rows = np.array(todo)
            sim = x[rows] @ x.T
            r, c = np.nonzero(sim >= floor)
            cuts = np.searchsorted(r, np.arange(len(rows) + 1))
            for j, me in enumerate(todo):
                if cluster[me] >= 0:
                    continue
                near = c[cuts[j]:cuts[j + 1]]
                free = near[cluster[near] < 0]
                cluster[free] = me
                cluster[me] = me
                both = near if len(near) else np.array([me])
                if len(both) == 1 and not speaks[me]:
                    continue
                out_f.append(both)
                out_p.append(np.full(len(both), me))
                out_s.append(sim[j, both])
        # Connected parts: edges between different clusters only, as pairs of clusters.
        cross = []
        for s in range(0, n, 512):
            sim = x[s:s + 512] @ x[s:].T
            r, c = np.nonzero(sim >= floor)
            a, b = cluster[r + s], cluster[c + s]
            other = a != b
            if other.any():
                cross.append(np.unique(np.minimum(a, b)[other] * n + np.maximum(a, b)[other]))
        top = np.arange(n)
        if cross:
            e = np.unique(np.concatenate(cross))
            a, b = e // n, e % n
            while True:
                new = top.copy()
                np.minimum.at(new, top[a], top[b])
                np.minimum.at(new, top[b], top[a])
                new = new[new]
                if np.array_equal(new, top):
                    break
                top = new
        part = top[cluster]
        low = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(low, part, ids)
        tied = np.nonzero(low[part] != ids)[0]
        f = np.concatenate([*out_f, tied]).astype(np.int64)
        to = np.concatenate([ids[np.concatenate(out_p)] if out_p else np.empty(0, np.int64), low[part][tied]])
        sim = np.concatenate([*out_s, np.full(len(tied), -1.0)])
        return pa.table({"f": ids[f], "to": to, "sim": sim.astype(np.float32)})

    return run


def _blocked(df: DataFrame, width: int, s: Shards) -> DataFrame:
    """Vectors as int16 (1e-5 exact) in the block pairs of their shards: a shard of one part is one task."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = usable(batch, width)
            own = s.placed(ids, x)
            ids, x = ids[own], x[own]
            shard = s.of(x)
            row, shard = np.repeat(np.arange(len(ids)), shard.shape[1]), shard.ravel()
            parts, home = s.parts[shard], s.part_of(ids[row], shard)
            rep = np.repeat(np.arange(len(row)), parts)
            other = np.arange(len(rep)) - np.repeat(np.cumsum(parts) - parts, parts)
            i, j = np.minimum(home[rep], other), np.maximum(home[rep], other)
            v = np.round(x * 32767).astype(np.int16)
            first = np.concatenate([[True], row[rep][1:] != row[rep][:-1]]) if len(rep) else np.empty(0, bool)
            for b in range(0, len(rep), 16384):
                e, r = slice(b, b + 16384), rep[b:b + 16384]
                yield pa.RecordBatch.from_arrays([pa.array(shard[r], pa.int32()), pa.array(i[e], pa.int32()), pa.array(j[e], pa.int32()), pa.array(ids[row[r]]), pa.array(first[e]), _binary(v[row[r]])], ["shard", "i", "j", "id", "first", "v"])

    rows = df.select("id", "embedding").mapInArrow(place, "shard int, i int, j int, id long, first boolean, v binary")
    return rows.repartition(s.tasks(df, 2 * width + 24), "shard", "i", "j")


def _only(df: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Rows of ``df`` whose id is among the ``n`` of ``ids``: their vectors stay in place while that many ids can be sent
    to every executor, else both sides are shuffled."""
    return df.join(F.broadcast(ids) if n <= SENT else ids, "id", "left_semi")


def packed(df: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = usable(batch, width)
            yield pa.RecordBatch.from_arrays([pa.array(ids), _binary(np.round(x * 32767).astype(np.int16))], ["id", "v"])

    return df.select("id", "embedding").mapInArrow(run, "id long, v binary")


def _cosine(width: int):
    @F.pandas_udf("double")
    def cos(a, b):
        x = np.frombuffer(b"".join(a), np.int16).reshape(-1, width).astype(np.float64)
        y = np.frombuffer(b"".join(b), np.int16).reshape(-1, width).astype(np.float64)
        import pandas as pd

        return pd.Series(np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)))

    return cos


def pivot_clusters(df: DataFrame, width: int, floor: float = 0.75, per_shard: int = 2000, spread: int = 5, part: int = 24_000, hot: int = HOT, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Parallel pivot correlation clustering of ``df(id, embedding)``: ``(id, pivot, sim)``, and ``(pivot)`` of the clusters
    that touch another one.

    In every round the undecided vectors are placed in shards; each shard lets its vectors be absorbed by pivots in
    hash order, and a vector is a pivot at large if it is one in all its shards. Vectors follow the closest of the pivots at
    large that are near them; one whose own pivot was absorbed elsewhere is compared with that pivot's pivot. Who is left
    goes to the next round, in which at least the first in hash order is decided. Then medoids are computed and members
    that are near several pivots move to the cluster whose medoid is closest, ``rounds`` times. ``sim`` is the similarity
    to the pivot.

    Two clusters touch if a vector of one is near a vector of the other. Each task of the first round ties what it finds
    connected to the smallest id of its connected part; tied vectors of two clusters mean that both are touched. Vectors are
    compared as 16-bit numbers, so similarities within 2e-5 of ``floor`` may fall on either side.
    """
    left, done, ties, heads_near, twins = df.select("id", "embedding").where(F.size("embedding") == width), None, None, None, None
    while True:
        s = Shards(left, width, per_shard, spread, part, 1, hot)
        if not s.rows:
            break
        said = cut(_blocked(left, width, s).groupBy("shard", "i", "j").applyInArrow(_pivots_in_shard(width, floor), "f long, to long, sim float"))
        first = ties is None
        if first:
            ties, twins = said.where("sim < 0").select("f", "to").distinct(), s.twins(left)
        near = said.where("sim >= 0")
        h = _hash_udf()
        best = cut(near.groupBy("f").agg(F.min_by("to", F.struct(h("to").alias("h"), F.col("to"))).alias("to")))
        heads = best.where("f = to").select(F.col("f").alias("to"))
        to_heads = near.join(heads, "to").groupBy("f", "to").agg(F.max("sim").alias("sim")) if first else near.join(heads, "to")
        if first:
            to_heads = heads_near = cut(to_heads)
        direct = cut(to_heads.groupBy("f").agg(F.max_by("to", F.struct("sim", -F.col("to"))).alias("pivot"), F.max("sim").cast("double").alias("sim")))
        lost = cut(best.join(direct.select("f"), "f", "left_anti"))
        n = lost.count()
        if not n:
            done = _more(done, direct)
            break
        via = lost.join(direct.select(F.col("f").alias("to"), "pivot"), "to").select("f", "pivot")
        v = packed(_only(left, lost.select(F.col("f").alias("id")), n), width).dropDuplicates(["id"])
        pv = packed(_only(left, via.select(F.col("pivot").alias("id")).distinct(), n), width).dropDuplicates(["id"])
        far = via.join(v.select(F.col("id").alias("f"), F.col("v").alias("x")), "f").join(pv.select(F.col("id").alias("pivot"), F.col("v").alias("y")), "pivot")
        second = cut(far.select("f", "pivot", _cosine(width)("x", "y").alias("sim")).where(F.col("sim") >= floor))
        done = _more(_more(done, direct), second)
        rest = cut(lost.join(second.select("f"), "f", "left_anti").select(F.col("f").alias("id")))
        n = rest.count()
        if not n:
            break
        left = _only(df.select("id", "embedding").where(F.size("embedding") == width), rest, n)
    spark = df.sparkSession
    if done is None:
        return spark.createDataFrame([], "id long, pivot long, sim double"), spark.createDataFrame([], "pivot long")
    done = settle(df.select("id", "embedding").where(F.size("embedding") == width), done, heads_near, width, rounds)
    who = done.select(F.col("f").alias("id"), "pivot")
    two = ties.join(who.select(F.col("id").alias("f"), F.col("pivot").alias("p")), "f").join(who.select(F.col("id").alias("to"), F.col("pivot").alias("q")), "to").where("p <> q")
    touched = two.select(F.explode(F.array("p", "q")).alias("pivot")).distinct()
    if twins is not None:
        done = done.unionByName(twins.join(done.withColumnRenamed("f", "first"), "first").select(F.col("id").alias("f"), "pivot", "sim"))
    return done.withColumnRenamed("f", "id"), touched


def settle(df: DataFrame, done: DataFrame, near: DataFrame, width: int, rounds: int = 2) -> DataFrame:
    """Members near several pivots move to the cluster of the closest medoid; medoids are then taken anew."""
    several = near.groupBy("f").agg(F.count("*").alias("k")).where("k > 1").select("f")
    choice = cut(near.join(several, "f", "left_semi"))
    n = choice.count()
    done = cut(done)
    if not n:
        return done
    who = choice.select(F.col("f").alias("id")).distinct()
    x = cut(packed(_only(df, who, n), width).dropDuplicates(["id"])).select(F.col("id").alias("f"), F.col("v").alias("x"))
    heads = cut(choice.select(F.col("to").alias("pivot")).distinct())
    for _ in range(rounds):
        members = cut(done.join(heads, "pivot", "left_semi").select(F.col("f").alias("id"), F.col("pivot").alias("cluster_id")))
        medoid = cut(ranked(members, df, width, 1).select(F.col("cluster_id").alias("to"), "id"))
        y = packed(_only(df, medoid.select("id").distinct(), n), width).dropDuplicates(["id"]).join(medoid, "id").select("to", F.col("v").alias("y"))
        c = choice.join(x, "f").join(y, "to").select("f", "to", F.col("sim").cast("double").alias("sim"), F.round(_cosine(width)("x", "y"), 5).alias("c"))
        moved = c.groupBy("f").agg(F.max_by(F.struct("to", "sim"), F.struct("c", "sim", -F.col("to"))).alias("b")).select("f", F.col("b.to").alias("new"), F.col("b.sim").alias("s"))
        # A pivot stays with its own cluster, which keeps its name.
        done = cut(done.join(moved, "f", "left").select("f", F.when(F.col("f") == F.col("pivot"), F.col("pivot")).otherwise(F.coalesce("new", "pivot")).alias("pivot"), F.when(F.col("f") == F.col("pivot"), F.col("sim")).otherwise(F.coalesce("s", "sim")).alias("sim")))
    return done


def _more(done: DataFrame | None, df: DataFrame) -> DataFrame:
    return df if done is None else done.unionByName(df)


def _hash_udf():
    @F.pandas_udf("long")
    def h(ids):
        import pandas as pd

        return pd.Series(_order(ids.to_numpy()))

    return h


def considered(faces: DataFrame) -> DataFrame:
    """Faces that may form persons: ``not_person`` 0 (NULL is not) and a tier other than LOW_QUALITY in any spelling."""
    tier = label("quality_tier")
    return faces.where((F.col("not_person") == 0) & (tier.isNull() | (tier != "LOW_QUALITY")))


def tight_clusters(df: DataFrame, width: int, floor: float = 0.75, least: int = 3, block: int = 4096, **options) -> DataFrame:
    """``(id, cluster_id)``: clusters of ``least`` or more, each two at ``floor`` or more, no other one near to any.

    They are the pivot clusters that touch no other. That each two members are similar is then checked with the vectors
    as 24-bit numbers (1e-7), in block pairs so that no task holds a large cluster. ``cluster_id`` is the smallest id.
    Unusable vectors, repeated rows, NULL ids and empty tables are harmless.
    """
    done, touched = pivot_clusters(df, width, floor, **options)
    free = done.join(touched, "pivot", "left_anti")
    ok = free.groupBy("pivot").agg(F.count("*").alias("n"), F.min("id").alias("cluster_id")).where(F.col("n") >= least)
    whole = cut(free.join(ok, "pivot").select("id", "cluster_id", "n"))
    parts = F.ceil(F.col("n") / block).cast("long")
    v = _members(df.where(F.size("embedding") == width), whole, whole.count(), width, ("cluster_id", "n"))
    v = v.withColumn("own", F.pmod(F.xxhash64("id"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    # Small clusters share a group (``bucket``), so that there are few groups; a large one has a group for each block pair.
    bucket = F.when(F.col("n") <= block, F.pmod(F.xxhash64("cluster_id"), F.lit(max(1, int(whole.count() // block))))).otherwise(-1)
    v = v.select(bucket.alias("bucket"), F.when(F.col("n") <= block, F.lit(0)).otherwise(F.col("cluster_id")).alias("large"), "cluster_id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "v")

    def check(t: pa.Table) -> pa.Table:
        x = _unfixed(_matrix(t.column("v"), np.uint8, 3 * width), width)
        own, cluster = t.column("own").to_numpy(), t.column("cluster_id").to_numpy()
        order = np.argsort(cluster, kind="stable")
        cuts = np.concatenate([[0], np.nonzero(np.diff(cluster[order]))[0] + 1, [len(order)]])
        i, j, loose = t.column("i")[0].as_py(), t.column("j")[0].as_py(), []
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows = order[a:b]
            left, right = x[rows[own[rows] == i]], x[rows[own[rows] == j]]
            if not all(bool((left[s:s + 1024] @ right.T >= floor - 2e-7).all()) for s in range(0, len(left), 1024)):
                loose.append(cluster[rows[0]])
        return pa.table({"cluster_id": pa.array(loose, pa.int64())})

    loose = v.groupBy("bucket", "large", "i", "j").applyInArrow(check, "cluster_id long").distinct()
    return whole.select("id", "cluster_id").join(loose, "cluster_id", "left_anti").select("id", "cluster_id")


def _members(df: DataFrame, members: DataFrame, n: int, width: int, keep: tuple[str, ...]) -> DataFrame:
    """The vectors of ``members`` as 24-bit numbers with their columns ``keep``; the members are sent to the vectors while
    there are few enough."""
    j = df.select("id", "embedding").join(F.broadcast(members) if n <= SENT else members, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, at = usable(batch, width, where=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), *[batch.column(2 + k).take(pa.array(at)) for k in range(len(keep))], _binary(_fixed(x))], ["id", *keep, "v"])

    return j.select("id", "embedding", *keep).mapInArrow(run, "id long, " + ", ".join(f"{k} long" for k in keep) + ", v binary")


def ranked(members: DataFrame, df: DataFrame, width: int, typical: int, block: int = 20_000) -> DataFrame:
    """``(cluster_id, r, id)`` of ``members(id, cluster_id)``: its ``typical`` most typical members, the first being the medoid.

    Typical are those closest to the cluster's mean direction; equal ones (to 6 decimals) by id. Clusters of up to ``block``
    members are ranked whole, many in one group; the means of larger ones are summed in parts and sent to all executors
    (a vector for each ``block`` members at most), and each batch passes on its best.
    """
    m = members.join(members.groupBy("cluster_id").agg(F.count("*").alias("n")), "cluster_id")
    total = members.count()
    v = _members(df, m, total, width, ("cluster_id", "n"))
    groups = max(1, int(total // block) * 2)

    def best(ids: np.ndarray, cluster: np.ndarray, cos: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((ids, -np.round(cos, 6), cluster))
        place = np.arange(len(order)) - np.searchsorted(cluster[order], cluster[order])
        top = order[place < typical]
        return pa.RecordBatch.from_arrays([pa.array(cluster[top]), pa.array(np.round(cos[top], 6)), pa.array(ids[top])], ["cluster_id", "c", "id"])

    def unit(t, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, at = np.unique(t.column(first).to_numpy(), return_index=True)  # repeated rows are one record
        x = _unfixed(_matrix(pa.chunked_array(t.column(first + 2).chunks if isinstance(t, pa.Table) else [t.column(first + 2)]), np.uint8, 3 * width), width)[at].astype(np.float64)
        return ids, t.column(first + 1).to_numpy()[at], x / np.linalg.norm(x, axis=1, keepdims=True)

    def whole(t: pa.Table) -> pa.Table:
        ids, cluster, x = unit(t, 1)
        c, at = np.unique(cluster, return_inverse=True)
        mean = np.zeros((len(c), width))
        np.add.at(mean, at, x)
        mean /= np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-30)
        return pa.Table.from_batches([best(ids, cluster, np.einsum("ij,ij->i", x, mean[at]))])

    small = v.where(F.col("n") <= block).select(F.pmod(F.xxhash64("cluster_id"), F.lit(groups)).alias("g"), "id", "cluster_id", "v").groupBy("g").applyInArrow(whole, "cluster_id long, c double, id long")
    large = v.where(F.col("n") > block).select("id", "cluster_id", "v")
    if m.where(F.col("n") > block).isEmpty():
        top = small
    else:

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, cluster, x = unit(b, 0)
                c, at = np.unique(cluster, return_inverse=True)
                t = np.zeros((len(c), width))
                np.add.at(t, at, x)
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(list(t), pa.list_(pa.float64()))], ["cluster_id", "s"])

        add = large.mapInArrow(sums, "cluster_id long, s array<double>").select("cluster_id", F.posexplode("s")).groupBy("cluster_id", "pos").agg(F.sum("col").alias("s"))
        means = {r["cluster_id"]: np.array(r["m"]) for r in add.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("m")).collect()}

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, cluster, x = unit(b, 0)
                if len(ids):
                    mean = np.stack([means[c] for c in cluster.tolist()])
                    yield best(ids, cluster, np.einsum("ij,ij->i", x, mean) / np.linalg.norm(mean, axis=1))

        top = small.unionByName(large.mapInArrow(near, "cluster_id long, c double, id long"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("c"), "id")
    return top.distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= typical).select("cluster_id", "r", "id")


def describe(members: DataFrame, df: DataFrame, width: int, typical: int = 3) -> DataFrame:
    """``(cluster_id, members, medoid, typical)`` of ``members(id, cluster_id)``: size and most typical members (``ranked``)."""
    members = cut(members)
    top = ranked(members, df, width, typical).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("t"))
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("members"))
    return sizes.join(top, "cluster_id").select("cluster_id", "members", F.col("t.id")[0].alias("medoid"), F.col("t.id").alias("typical"))

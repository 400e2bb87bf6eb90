"""Points near other points, or in regions (problem 5).

A quadtree is grown from a bounded sample, so that its leaves hold about equally many points. Every point goes to
its own leaf, and as a replica to the leaves that its search box touches. A leaf is probed through a bulk-loaded
R-tree; a pair is reported only where the point of the smaller id is at home, so that no later de-duplication is
needed. Leaves that stay heavy (one spot may hold a third of all points) are split into block pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.session import partitions

EARTH_M = 6_371_000.0
#: Points in the sample the quadtree is grown from, points of the sample in a leaf, rows of a block of a heavy leaf.
SAMPLE, LEAF_SAMPLE, BLOCK = 50_000, 64, 20_000


def haversine(lat1, lon1, lat2, lon2):
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def quadtree(lat: np.ndarray, lon: np.ndarray, cap: int, least: float) -> np.ndarray:
    """Leaves (south, west, north, east) of a quadtree over the sample, none narrower than ``least`` degrees."""
    leaves, todo = [], [((-90.0, -180.0, 90.0, 180.0), np.arange(len(lat)))]
    while todo:
        (s, w, n, e), at = todo.pop()
        if len(at) <= cap or n - s < 2 * least or e - w < 2 * least:
            leaves.append((s, w, n, e))
            continue
        ms, mw = (s + n) / 2, (w + e) / 2
        up, right = lat[at] >= ms, lon[at] >= mw
        for box, m in (((s, w, ms, mw), ~up & ~right), ((s, mw, ms, e), ~up & right), ((ms, w, n, mw), up & ~right), ((ms, mw, n, e), up & right)):
            todo.append((box, at[m]))
    return np.array(sorted(leaves))


def search_boxes(lat: np.ndarray, lon: np.ndarray, radius_m: float) -> tuple[np.ndarray, np.ndarray]:
    """Half height and half width in degrees of boxes that hold the circle around each point."""
    r = radius_m / EARTH_M
    dlat = np.degrees(r) * 1.000001 + 1e-9
    c = np.cos(np.radians(lat))
    near_pole = np.abs(lat) + dlat >= 90
    ratio = np.where(near_pole, 0.0, np.sin(r) / np.maximum(c, 1e-12))
    dlon = np.where(near_pole | (ratio >= 1), 360.0, np.degrees(np.arcsin(np.clip(ratio, 0, 1))) * 1.000001 + 1e-9)
    return np.full(len(lat), dlat), dlon


class Tree:
    """Sort-tile-recursive R-tree over points, probed level by level for all boxes at once."""

    FAN = 16

    def __init__(self, lat: np.ndarray, lon: np.ndarray):
        n = len(lat)
        strips = max(1, int(np.ceil(np.sqrt(n / self.FAN))))
        by_lon = np.argsort(lon, kind="stable")
        strip = np.empty(n, int)
        strip[by_lon] = np.arange(n) * strips // max(n, 1)
        self.order = np.lexsort((lat, strip))
        self.levels = [np.stack([lat[self.order], lon[self.order], lat[self.order], lon[self.order]], 1)]
        while len(self.levels[-1]) > self.FAN:
            b, cuts = self.levels[-1], np.arange(0, len(self.levels[-1]), self.FAN)
            self.levels.append(np.concatenate([np.minimum.reduceat(b[:, :2], cuts), np.maximum.reduceat(b[:, 2:], cuts)], 1))

    def probe(self, south, west, north, east) -> tuple[np.ndarray, np.ndarray]:
        """(probe, point) index pairs of points inside boxes."""
        top = len(self.levels[-1])
        q, node = np.repeat(np.arange(len(south)), top), np.tile(np.arange(top), len(south))
        for depth in range(len(self.levels) - 1, -1, -1):
            b = self.levels[depth][node]
            hit = (b[:, 0] <= north[q]) & (b[:, 2] >= south[q]) & (b[:, 1] <= east[q]) & (b[:, 3] >= west[q])
            q, node = q[hit], node[hit]
            if depth:
                below = len(self.levels[depth - 1])
                q, node = np.repeat(q, self.FAN), (node[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                q, node = q[node < below], node[node < below]
        return q, self.order[node]


def _assign(leaves: np.ndarray, radius_m: float, blocks: dict[int, int] | None):
    """Rows (leaf, i, j, id, lat, lon, home) of each point: its leaf and those its box touches; j >= i are block pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lat, lon = (batch.column(k).to_numpy() for k in range(3))
            if not len(ids):
                continue
            dlat, dlon = search_boxes(lat, lon, radius_m)
            at, leaf = _touch(leaves, lat - dlat, lon - dlon, lat + dlat, lon + dlon)
            b = leaves[leaf]
            home = (lat[at] >= b[:, 0]) & ((lat[at] < b[:, 2]) | (b[:, 2] == 90)) & (lon[at] >= b[:, 1]) & (lon[at] < b[:, 3])
            if blocks is None:
                k = np.bincount(leaf, minlength=len(leaves))
                used = np.nonzero(k)[0]
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(k[used])], ["leaf", "n"])
                continue
            parts = np.array([blocks.get(x, 1) for x in range(len(leaves))])[leaf]
            own = (ids[at] * 2_654_435_761 >> 8) % parts
            rep = np.repeat(np.arange(len(at)), parts)
            other = np.arange(len(rep)) - np.repeat(np.cumsum(parts) - parts, parts)
            i, j = np.minimum(own[rep], other), np.maximum(own[rep], other)
            a = at[rep]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (leaf[rep], i, j, ids[a], lat[a], lon[a], home[rep], own[rep])], ["leaf", "i", "j", "id", "lat", "lon", "home", "own"])

    return run


def _touch(leaves, south, west, north, east) -> tuple[np.ndarray, np.ndarray]:
    """(box, leaf) pairs that touch; boxes are turned by 360 degrees as needed."""
    tree = Tree((leaves[:, 0] + leaves[:, 2]) / 2, (leaves[:, 1] + leaves[:, 3]) / 2)
    hh, hw = ((leaves[:, 2] - leaves[:, 0]) / 2).max(), ((leaves[:, 3] - leaves[:, 1]) / 2).max()
    found = []
    for turn in (0.0, 360.0, -360.0):
        some = np.nonzero((west + turn <= 180) & (east + turn >= -180))[0]
        w, e = west[some] + turn, east[some] + turn
        q, leaf = tree.probe(south[some] - hh, w - hw, north[some] + hh, e + hw)
        b = leaves[leaf]
        hit = (b[:, 0] <= north[some][q]) & (b[:, 2] >= south[some][q]) & (b[:, 1] <= e[q]) & (b[:, 3] >= w[q])
        found.append(np.stack([some[q[hit]], leaf[hit]], 1))
    both = np.unique(np.concatenate(found), axis=0)
    return both[:, 0], both[:, 1]


def near_pairs(points: DataFrame, radius_m: float, sample: int = SAMPLE, leaf_sample: int = LEAF_SAMPLE, block: int = BLOCK) -> DataFrame:
    """``(a, b)``, a < b: every two of ``points(id, lat, lon)`` at most ``radius_m`` apart on the sphere.

    Points with a NULL or not finite coordinate, a latitude beyond 90 or a longitude beyond 360 degrees are left
    out; turns of 360 degrees are the same meridian; both poles and the 180th meridian need no care. Repeated rows
    are one point (of unequal rows with one id the smallest counts). No points give no rows. The sample only shapes the quadtree; every point is indexed.
    """
    ok = "id IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -360 AND 360 AND NOT isnan(lat) AND NOT isnan(lon)"
    p = points.where(ok).select(F.col("id").cast("long").alias("id"), F.col("lat").cast("double").alias("lat"), F.expr("pmod(cast(lon as double) + 180, 360) - 180").alias("lon"))
    p = p.groupBy("id").agg(F.min(F.struct("lat", "lon")).alias("p")).select("id", "p.lat", "p.lon")
    n = p.count()
    schema = "a long, b long"
    spark = points.sparkSession
    if n < 2:
        return spark.createDataFrame([], schema)
    seen = p.select("lat", "lon").where(F.xxhash64("id").bitwiseAND((1 << 30) - 1) < int(min(1.0, sample / n) * (1 << 30)))
    got = seen.toPandas()
    least = float(np.degrees(radius_m / EARTH_M)) * 4
    leaves = quadtree(got["lat"].to_numpy(), got["lon"].to_numpy(), leaf_sample, least)
    counts = p.mapInArrow(_assign(leaves, radius_m, None), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    blocks = {r["leaf"]: -(-r["n"] // block) for r in counts.where(F.col("n") > block).collect()}  # at most one row a leaf
    rows = p.mapInArrow(_assign(leaves, radius_m, blocks), "leaf long, i long, j long, id long, lat double, lon double, home boolean, own long")

    def pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key[1], key[2]
        lat, lon, ids, home, own = (pdf[c].to_numpy() for c in ("lat", "lon", "id", "home", "own"))
        left, right = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
        box = leaves[key[0]]
        mid = (box[1] + box[3]) / 2
        x = np.where(lon - mid > 180, lon - 360, np.where(lon - mid < -180, lon + 360, lon))
        tree = Tree(lat[right], x[right])
        west, east = (x[right].min(), x[right].max()) if len(right) else (0.0, 0.0)
        out = []
        for s in range(0, len(left), 4096):
            q = left[s:s + 4096]
            dlat, dlon = search_boxes(lat[q], lon[q], radius_m)
            found = []
            for turn in (0.0, 360.0, -360.0):  # the leaf may reach round the earth
                some = np.nonzero((x[q] - dlon + turn <= east) & (x[q] + dlon + turn >= west) & ((turn == 0) | (dlon < 360)))[0]
                k, m = tree.probe(lat[q][some] - dlat[some], x[q][some] - dlon[some] + turn, lat[q][some] + dlat[some], x[q][some] + dlon[some] + turn)
                found.append(some[k] * len(right) + m)
            both = found[0] if not len(found[1]) + len(found[2]) else np.unique(np.concatenate(found))
            k, m = both // max(1, len(right)), both % max(1, len(right))
            a, b = q[k], right[m]
            keep = ids[a] < ids[b] if i == j else ids[a] != ids[b]
            a, b = a[keep], b[keep]
            swap = ids[a] > ids[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            near = home[a] & (haversine(lat[a], lon[a], lat[b], lon[b]) <= radius_m)
            out.append(np.stack([ids[a[near]], ids[b[near]]], 1))
        r = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return pd.DataFrame({"a": r[:, 0], "b": r[:, 1]})

    tasks = max(partitions(spark), -(-n // block))  # named, so that few bytes of many points stay spread
    return rows.repartition(tasks, "leaf", "i", "j").groupBy("leaf", "i", "j").applyInPandas(pairs, schema)


def near_places(places: DataFrame, radius_m: float = 300.0) -> DataFrame:
    """``(place_a, place_b)``: places with members, in any root, at most ``radius_m`` apart; see ``near_pairs``.

    Left out: ``member_count`` NULL or not above 0, and coordinates exactly at 0, 0 (a placeholder).
    """
    p = places.where("member_count > 0 AND NOT (lat = 0 AND lon = 0)").select("id", "lat", "lon")
    return near_pairs(p, radius_m).select(F.col("a").alias("place_a"), F.col("b").alias("place_b"))


def containing_region(points: DataFrame, regions: DataFrame, sample: int = SAMPLE, leaf_sample: int = LEAF_SAMPLE, block: int = BLOCK) -> DataFrame:
    """``(id, region_id)`` for every point and each region that holds it.

    ``regions(region_id, ring)``: ``ring`` is an array of (lat, lon) structs, closed or not, spanning under 180
    degrees. Points on a south or west edge are inside. Regions with fewer than three corners and rows with NULLs
    give nothing. Regions are replicated to the quadtree leaves (grown from a bounded sample of the points) that
    their boxes touch, points go to their one leaf, so no pair is found twice. In a leaf the regions' boxes probe the
    R-tree of its points, and what they hit is tested against all edges of the ring at once; heavy leaves are split.
    """
    p = points.where("id IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -360 AND 360 AND NOT isnan(lat) AND NOT isnan(lon)").select("id", F.col("lat").cast("double").alias("lat"), F.expr("pmod(cast(lon as double) + 180, 360) - 180").alias("lon")).distinct()
    n = max(1, p.count())
    got = p.select("lat", "lon").where(F.xxhash64("id").bitwiseAND((1 << 30) - 1) < int(min(1.0, sample / n) * (1 << 30))).toPandas()
    leaves = quadtree(got["lat"].to_numpy(dtype=float), got["lon"].to_numpy(dtype=float), leaf_sample, 1e-3)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, leaf = _touch(leaves, pdf.lat.to_numpy(), pdf.lon.to_numpy(), pdf.lat.to_numpy(), pdf.lon.to_numpy())
            b, x, y = leaves[leaf], pdf.lon.to_numpy()[at], pdf.lat.to_numpy()[at]
            home = (y >= b[:, 0]) & ((y < b[:, 2]) | (b[:, 2] == 90)) & (x >= b[:, 1]) & (x < b[:, 3])
            yield pd.DataFrame({"leaf": leaf[home], "id": pdf.id.to_numpy()[at[home]], "lat": y[home], "lon": x[home]})

    pts = p.mapInPandas(place, "leaf long, id long, lat double, lon double")
    heavy = {r["leaf"]: -(-r["n"] // block) for r in pts.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > block).collect()}  # at most one row a leaf

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, ring in zip(pdf.region_id, pdf.ring):
                c = np.array([(v["lat"], v["lon"]) for v in ring], float)
                if len(c) >= 3 and np.isfinite(c).all():
                    (s, w), (north, e) = c.min(0), c.max(0)
                    _, leaf = _touch(leaves, *(np.array([v]) for v in (s, w, north, e)))
                    leaf = np.repeat(leaf, [heavy.get(x, 1) for x in leaf.tolist()])
                    part = np.concatenate([np.arange(heavy.get(x, 1)) for x in dict.fromkeys(leaf.tolist())]) if len(leaf) else leaf
                    yield pd.DataFrame({"leaf": leaf, "part": part, "region_id": k, "ys": [c[:, 0].tolist()] * len(leaf), "xs": [c[:, 1].tolist()] * len(leaf)})

    parts = F.create_map(*[F.lit(x) for kv in heavy.items() for x in kv])[F.col("leaf")] if heavy else F.lit(None).cast("long")
    pts = pts.withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce(parts, F.lit(1))))
    regs = regions.where("region_id IS NOT NULL AND ring IS NOT NULL").select("region_id", "ring").mapInPandas(spread, "leaf long, part long, region_id long, ys array<double>, xs array<double>")

    def inside(p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(r):
            return pd.DataFrame({"id": np.empty(0, np.int64), "region_id": np.empty(0, np.int64)})
        lat, lon, ids, out = p.lat.to_numpy(), p.lon.to_numpy(), p.id.to_numpy(), []
        mid = (lon.min() + lon.max()) / 2
        rings = [(np.asarray(y), np.asarray(x) - np.round((np.mean(x) - mid) / 360) * 360) for y, x in zip(r["ys"], r["xs"])]
        tree = Tree(lat, lon)
        for turn in (0.0, 360.0, -360.0):  # the leaf may reach round the earth
            k, m = tree.probe(*(np.array([f(v) + (turn if c else 0.0) for v in (ring[c] for ring in rings)]) for c, f in ((0, np.min), (1, np.min), (0, np.max), (1, np.max))))
            order = np.argsort(k, kind="stable")
            k, m = k[order], m[order]
            for g in np.unique(k):
                at = m[np.searchsorted(k, g):np.searchsorted(k, g, "right")]
                y, x = rings[g][0], rings[g][1] + turn
                ny, nx = np.roll(y, -1), np.roll(x, -1)
                flat = np.where(ny == y, 1.0, ny - y)
                for s in range(0, len(at), 4096):
                    a = at[s:s + 4096]
                    cross = (y > lat[a][:, None]) != (ny > lat[a][:, None])
                    left = lon[a][:, None] < (nx - x) * (lat[a][:, None] - y) / flat + x
                    hit = ids[a[(cross & left).sum(1) % 2 == 1]]
                    out.append(np.stack([hit, np.full(len(hit), r.region_id.iloc[g])], 1))
        got = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
        return pd.DataFrame({"id": got[:, 0], "region_id": got[:, 1]})

    return pts.groupBy("leaf", "part").cogroup(regs.groupBy("leaf", "part")).applyInPandas(inside, "id long, region_id long")

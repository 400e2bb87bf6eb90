"""Consolidating pairwise matches into groups (problem 6).

Union-find runs inside edge partitions and keeps only a spanning forest of each; forests are merged level by level
in partitions of bounded size. Where the forests of a level no longer fit the bound (billions of nodes), rounds of
star contraction, themselves preceded by union-find in each partition, finish the job without one large task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.clean import label
from kestrel.operators.graph import contract
from kestrel.session import cut

#: Most edges that one task merges; 16 bytes each, about five times that while it runs.
EDGES_PER_TASK = 4_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the edges ``a - b`` as stars: (node, smallest node of its component), roots left out.

    Union by smallest root with path halving, over all edges at once: every pass hooks the larger root of each
    edge to the smallest root that any edge offers it, then shortens paths until all are of length one.
    """
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    parent = np.arange(len(nodes))
    while len(x):
        rx, ry = parent[x], parent[y]
        open_ = rx != ry
        x, y, rx, ry = x[open_], y[open_], rx[open_], ry[open_]
        if not len(x):
            break
        np.minimum.at(parent, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = b = np.empty(0, np.int64)
    held: list[pa.RecordBatch] = []
    size = 0

    def fold(a, b, held):
        return forest(np.concatenate([a, *(x.column(0).to_numpy() for x in held)]), np.concatenate([b, *(x.column(1).to_numpy() for x in held)]))

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > max(1_000_000, 2 * len(a)):  # memory follows the forest, not the edges
            a, b = fold(a, b, held)
            held, size = [], 0
    a, b = fold(a, b, held)
    for s in range(0, len(a), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[s:s + 200_000]), pa.array(b[s:s + 200_000])], ["a", "b"])


def components(edges: DataFrame, per_task: int = EDGES_PER_TASK) -> DataFrame:
    """``(node, group_id)`` for every node of ``edges(a, b)``; ``group_id`` is the component's smallest node.

    Edges are undirected; repeats and loops do not matter (a node with nothing but a loop is its own group),
    rows with a NULL end are ignored, no edges give no rows. Only long ends are accepted.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    loops = e.where("a = b").select(F.col("a").alias("node")).distinct()
    stars = cut(e.where("a <> b").mapInArrow(_forests, "a long, b long"))
    n = stars.count()
    while True:
        parts = stars.rdd.getNumPartitions()
        if parts <= 1:
            return _with_loops(stars, loops)
        if n <= per_task:
            stars = cut(stars.coalesce(1).mapInArrow(_forests, "a long, b long"))
            return _with_loops(stars, loops)
        # Four partitions to one while that stays within the bound; forests shrink as they meet.
        fewer = max(1, -(-n // per_task), parts // 4)
        merged = cut(stars.coalesce(fewer).mapInArrow(_forests, "a long, b long"))
        m = merged.count()
        if fewer >= parts or m > 0.9 * n:
            return _with_loops(contract(merged), loops)
        stars, n = merged, m


def _with_loops(stars: DataFrame, loops: DataFrame) -> DataFrame:
    named = stars.select(F.col("a").alias("node"), F.col("b").alias("group_id"))
    named = named.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("group_id")).distinct())
    return named.unionByName(loops.join(named, "node", "left_anti").select("node", F.col("node").alias("group_id")))


def linked_faces(links: DataFrame, faces: DataFrame) -> DataFrame:
    """``(face_id, group_id)``: faces tied by answers whose latest word is "same".

    The latest ``created_at`` about two faces, in either order, decides; at the very same instant "different" goes
    before "same" before anything else, and an answer without instant is the earliest. ``kind`` is read without
    case and outer blanks. Ends must exist in ``faces`` and differ. Rows with NULL ends, repeats, empty tables
    and extra columns are harmless; a face without a link gives no row.
    """
    kind = label("kind")
    weight = F.when(kind == "DIFFERENT", 2).when(kind == "SAME", 1).otherwise(0)
    pairs = links.select(F.least("face_a", "face_b").alias("a"), F.greatest("face_a", "face_b").alias("b"), F.struct("created_at", weight.alias("w")).alias("said")).where("a <> b")
    same = pairs.groupBy("a", "b").agg(F.max("said").alias("said")).where("said.w = 1").select("a", "b")
    # Existence is decided on distinct ends, so a face with very many links is one row of that join.
    ends = same.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    gone = ends.join(faces.select("id"), "id", "left_anti")
    valid = same.join(gone.select(F.col("id").alias("a")), "a", "left_anti").join(gone.select(F.col("id").alias("b")), "b", "left_anti")
    return components(valid).select(F.col("node").alias("face_id"), "group_id")

"""Clusters of animals, and rules inside one picture or video."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.numbers import iou, overlap_fraction
from kestrel.operators.blocks import pack, ties
from kestrel.operators.graph import components
from kestrel.session import cut


def complete_link(x: np.ndarray, least: float = 0.75) -> np.ndarray:
    """Group of every unit row (G11). Rows come in order; one joins the group of the best mean similarity among those all of whose
    members are alike, the later of equal ones, or begins a group.

    Kept for every group and every row to come: the least similarity to its members and their sum, both updated by one
    product when a member joins.
    """
    n = len(x)
    group, heads = np.full(n, -1), 0
    low, total, size = np.full((16, n), np.inf), np.zeros((16, n)), np.zeros(16)
    for i in range(n):
        fits = np.nonzero(low[:heads, i] >= least)[0]
        mean = np.round(total[fits, i] / size[fits], 12)
        g = int(fits[len(fits) - 1 - np.argmax(mean[::-1])]) if len(fits) else heads
        if g == heads:
            heads += 1
            if heads > len(size):
                low, total, size = np.concatenate([low, np.full_like(low, np.inf)]), np.concatenate([total, np.zeros_like(total)]), np.concatenate([size, np.zeros_like(size)])
        sim = x[i + 1:] @ x[i]
        low[g, i + 1:] = np.minimum(low[g, i + 1:], sim)
        total[g, i + 1:] += sim
        size[g] += 1
        group[i] = g
    return group


def pets(detections: DataFrame, width: int, least: float = 0.75, members: int = 2, block: int = 8192) -> DataFrame:
    """``(id, pet_id)``: animals alike within a species, two or more, toys left out (G12); ``pet_id`` is the smallest id.

    Exact. Every two detections of a species are compared, in pairs of blocks of about ``block`` rows, which only say what
    is connected. A group never leaves its connected part, so each part takes its detections in order of id on its own;
    ``block`` is the size of a task and no row of the result depends on it. One part is one task, however large.
    """
    v = cut(pack(detections.where("species IS NOT NULL AND species <> 'teddy bear'"), width, "species"))
    part = components(cut(ties(v, width, least, "species", block))).withColumnRenamed("node", "id")
    rows = v.join(part, "id", "inner" if members > 1 else "left").withColumn("group_id", F.coalesce("group_id", "id"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["group_id", "id"])
        ids, part = pdf.id.to_numpy(), pdf.group_id.to_numpy()
        x = np.frombuffer(b"".join(pdf.v), np.float32).reshape(-1, width).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        cuts, out = [0, *(np.nonzero(part[1:] != part[:-1])[0] + 1), len(ids)], []
        for a, b in zip(cuts, cuts[1:]) if len(ids) else ():
            _, first, at, n = np.unique(complete_link(x[a:b], least), return_index=True, return_inverse=True, return_counts=True)
            keep = n[at] >= members
            out.append(np.stack([ids[a:b][keep], ids[a + first[at]][keep]], 1))
        r = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return pd.DataFrame({"id": r[:, 0], "pet_id": r[:, 1]})

    side = F.pmod(F.xxhash64("group_id"), F.lit(256)).alias("side")
    return rows.groupBy(side).applyInPandas(run, "id long, pet_id long")


def suppress(boxes: np.ndarray, scores: np.ndarray, most: float = 0.5) -> list[int]:
    """Non-maximum suppression of (x, y, w, h) boxes: kept rows, best first (V9)."""
    keep: list[int] = []
    for i in np.argsort(-scores, kind="stable"):
        if all(box_iou(boxes[i], boxes[k]) <= most for k in keep):
            keep.append(int(i))
    return keep


def box_iou(a, b) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    shared = max(w, 0) * max(h, 0)
    joint = a[2] * a[3] + b[2] * b[3] - shared
    return shared / joint if joint > 0 else 0.0


def suppressed(detections: DataFrame, most: float = 0.5) -> DataFrame:
    """Ids of the boxes that stay in each picture and class (V9)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        keep = suppress(pdf[["box_x", "box_y", "box_w", "box_h"]].to_numpy(float), pdf["det_score"].fillna(-1).to_numpy(float), most)
        return pdf.iloc[keep][["id"]]

    return detections.dropDuplicates(["id"]).na.drop(subset=["box_x", "box_y", "box_w", "box_h"]).groupBy("file_id", "species").applyInPandas(run, "id long")


def carry_best(overlap: DataFrame) -> DataFrame:
    """``(cluster, name)``: each cluster's name of most shared members, the older entity of equal ones."""
    return overlap.groupBy("cluster").agg(F.max_by("name", F.struct("shared", (-F.col("old_id")).alias("o"))).alias("name"))


def collapse(detections: DataFrame, width: int, least: float = 0.75) -> DataFrame:
    """Ids of a video's detections that stay: in order of quality (then id), those unlike every better one that stayed.

    ``detections(id, file_id, quality, embedding)``; NULL qualities come last, detections without a usable vector stay. A group is
    one video, whose sampled frames bound it.
    """
    v = pack(detections, width, "file_id", "quality")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["quality", "id"], ascending=[False, True], na_position="last")
        x = np.frombuffer(b"".join(pdf.v), np.float32).reshape(-1, width).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        alike, open_, keep = x @ x.T >= least, np.ones(len(x), bool), []
        for i in range(len(x)):
            if open_[i]:
                keep.append(i)
                open_ &= ~alike[i]
        return pdf.iloc[keep][["id"]]

    stay = v.groupBy("file_id").applyInPandas(run, "id long")
    ids = detections.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id")).distinct()
    return stay.unionByName(ids.join(v.select("id"), "id", "left_anti"))


def rotation(faces: DataFrame, persons: DataFrame, quorum: int = 3, lead: float = 1.2) -> DataFrame:
    """``(file_id, turns)``: quarter turns that a picture needs (V10): those at which most faces stand upright if they are
    ``quorum`` or more, else those at which the largest person is clearly (``lead`` times) larger than unturned, else none.

    ``faces(file_id, turns, n)``, ``persons(file_id, turns, area)``; of equal counts the fewest turns.
    """
    best = faces.groupBy("file_id").agg(F.max(F.struct("n", (-F.col("turns")).alias("t"))).alias("f"))
    tall = persons.groupBy("file_id").agg(F.max(F.struct("area", (-F.col("turns")).alias("t"))).alias("p"), F.coalesce(F.max(F.when(F.col("turns") == 0, F.col("area"))), F.lit(0)).alias("flat"))
    j = best.join(tall, "file_id", "full")
    return j.select("file_id", F.when(F.col("f.n") >= quorum, -F.col("f.t")).when(F.col("p.area") > lead * F.col("flat"), -F.col("p.t")).otherwise(0).alias("turns"))


_SIDES = "xywh"


def _boxes(t: str) -> dict:
    return {k: F.col(f"{t}.box_{k}") for k in _SIDES}


def vetoed_faces(faces: DataFrame, animals: DataFrame, persons: DataFrame, least: float = 0.60) -> DataFrame:
    """``(id, animal_id)``: faces that lie in an animal's box, ``least`` of them or more, and in no person's (J16); the animal of the
    smallest id. All have ``(id, file_id, box_x, box_y, box_w, box_h)``."""
    inside = lambda other, name: faces.alias("f").join(other.alias("o"), F.expr("f.file_id = o.file_id")).where(overlap_fraction(_boxes("f"), _boxes("o")) >= least).select(F.col("f.id").alias("id"), F.col("o.id").alias(name))
    hit = inside(animals, "animal_id").groupBy("id").agg(F.min("animal_id").alias("animal_id"))
    return hit.join(inside(persons, "person"), "id", "left_anti")


def human_animals(animals: DataFrame, persons: DataFrame, least: float = 0.80, outscored: bool = False) -> DataFrame:
    """Ids of animal boxes that are a person's: an overlap of ``least`` or more, with ``outscored`` only where the person's score is
    higher (J17)."""
    j = animals.alias("a").join(persons.alias("p"), F.expr("a.file_id = p.file_id")).where(iou(_boxes("a"), _boxes("p")) >= least)
    return (j.where("p.det_score > a.det_score") if outscored else j).select(F.col("a.id").alias("id")).distinct()


def eligible(species, score, known: dict[str, float], floor: float = 0.5):
    """Whether a detection counts before suppression: its species' own floor, or the general one (F20); NULL counts as no."""
    own = F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[species], F.lit(floor))
    return F.coalesce(score >= own, F.lit(False))


def absorb_places(points: list[tuple[int, float, float]], places: list[dict], radius_m: float = 300.0) -> tuple[list[tuple[int, int]], list[dict]]:
    """Points in order of id to the nearest place, whose centre drifts unless pinned; far ones found a new place (T4).

    Returns ``(point, place)`` and the places. Of equally near places the last wins. Distances to all places are one product;
    the order of points is part of the meaning.
    """
    from kestrel.operators.spatial import haversine

    n = len(places)
    room = n + len(points)
    col = lambda k, fill: np.array([p[k] for p in places] + [fill] * len(points), dtype=float)
    ids, lat, lon, count, pinned = (col(k, 0) for k in ("id", "lat", "lon", "member_count", "pinned"))
    fresh, out = int(ids[:n].max(initial=0)) + 1, []
    for i, y, x in sorted(points):
        d = haversine(y, x, lat[:n], lon[:n]) if n else np.empty(0)
        k = n - 1 - int(np.argmin(d[::-1])) if n else -1
        if k >= 0 and d[k] <= radius_m:
            if not pinned[k]:
                lat[k], lon[k] = (lat[k] * count[k] + y) / (count[k] + 1), (lon[k] * count[k] + x) / (count[k] + 1)
        else:
            k, n = n, n + 1
            ids[k], lat[k], lon[k], fresh = fresh, y, x, fresh + 1
        count[k] += 1
        out.append((i, int(ids[k])))
    assert n <= room
    return out, [{"id": int(ids[k]), "lat": float(lat[k]), "lon": float(lon[k]), "member_count": int(count[k]), "pinned": int(pinned[k])} for k in range(n)]

"""Persons rebuilt from faces: fragments, cores, borders, answers, pins and names as one pipeline."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.clean import label
from kestrel.operators.blocks import means, nearest_of, pack, self_nearest, ties
from kestrel.operators.graph import components
from kestrel.operators.matching import matched
from kestrel.session import cut


def average_link(x: np.ndarray, least: float) -> np.ndarray:
    """UPGMA labels of unit rows: the closest two clusters merge while their mean distance is under 1 - ``least``."""
    n = len(x)
    d = 1 - x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(d, np.inf)
    size, label_ = np.ones(n), np.arange(n)
    while n > 1:
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        if not d[i, j] < 1 - least:
            break
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        row[[i, j]] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label_[label_ == j] = i
    return label_


def merged(groups: DataFrame, vectors: DataFrame, width: int, least: float) -> DataFrame:
    """``(id, group)`` with groups merged by average linkage of their centres.

    Two clusters can only merge if some of their centres are that near, so merges stay inside the connected parts of the
    centres, each of which is linked on its own, in one task. ``groups(id, group)``, ``vectors(id, v)``.
    """
    centre = cut(means(groups.join(vectors, "id"), width).select(F.col("group").alias("id"), "v"))
    tied = components(cut(ties(centre, width, least))).withColumnRenamed("node", "id")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["group_id", "id"])
        ids, part, x = pdf.id.to_numpy(), pdf.group_id.to_numpy(), np.frombuffer(b"".join(pdf.v), np.float32).reshape(-1, width)
        cuts = [0, *(np.nonzero(part[1:] != part[:-1])[0] + 1), len(ids)]
        new = np.concatenate([ids[a + average_link(x[a:b], least)] for a, b in zip(cuts, cuts[1:])])
        return pd.DataFrame({"group": ids, "new": new})

    near = centre.join(tied, "id").withColumn("bucket", F.pmod(F.xxhash64("group_id"), F.lit(256)))
    to = near.groupBy("bucket").applyInPandas(link, "group long, new long").where("group <> new")
    return groups.join(to, "group", "left").select("id", F.coalesce("new", "group").alias("group"))


def fragments(vectors: DataFrame, width: int, k: int = 5, least: float = 0.75) -> DataFrame:
    """``(id, group)``: what mutual neighbours connect, two or more."""
    n = cut(self_nearest(vectors, width, k, least).select(F.col("q").alias("a"), F.col("id").alias("b")))
    both = n.join(n.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi").where("a < b")
    return components(both).select(F.col("node").alias("id"), F.col("group_id").alias("group"))


def cores(vectors: DataFrame, width: int, first: float = 0.40, second: float = 0.55) -> DataFrame:
    """``(id, group)``: fragments merged by their centres, twice."""
    g = cut(fragments(vectors, width))
    for least in (first, second):
        g = cut(merged(g, vectors, width, least))
    return g


def attached(border: DataFrame, core: DataFrame, vectors: DataFrame, width: int, cannot: DataFrame | None = None, votes: int = 3, least: float = 0.55) -> DataFrame:
    """``(id, group)`` of the border members that join a core.

    Of a member's nearest ``max(5 votes, 20)`` core members, a core's best ``votes`` speak for it by their mean; the best core
    of ``least`` or more wins, of equal ones the later. A core of which a member must not be joined (``cannot(a, b)``) is
    passed over. ``border(id, v)``, ``core(id, group)``.
    """
    hits = nearest_of(border, vectors.join(core, "id", "left_semi"), width, max(5 * votes, 20))
    said = hits.join(core, "id").groupBy("q", "group").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, votes).alias("s"))  # 20 at most
    said = said.select("q", "group", F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s"), 12).alias("score")).where(F.col("score") >= least)
    if cannot is not None:
        both = cannot.select("a", "b").unionByName(cannot.select(F.col("b").alias("a"), F.col("a").alias("b")))
        bad = both.join(core.select(F.col("id").alias("b"), "group"), "b").select(F.col("a").alias("q"), "group").distinct()
        said = said.join(bad, ["q", "group"], "left_anti")
    return said.groupBy(F.col("q").alias("id")).agg(F.max_by("group", F.struct("score", "group")).alias("group"))


def latest_answers(links: DataFrame) -> DataFrame:
    """``(a, b, kind, at)``: the latest answer about every two faces, the smaller id first; "different" before "same" at one instant."""
    kind = F.lower(F.trim("kind"))
    said = F.struct(F.col("created_at").alias("at"), F.when(kind == "different", 2).when(kind == "same", 1).otherwise(0).alias("w"), kind.alias("kind"))
    p = links.select(F.least("face_a", "face_b").alias("a"), F.greatest("face_a", "face_b").alias("b"), said.alias("s")).where("a <> b")
    return p.groupBy("a", "b").agg(F.max("s").alias("s")).select("a", "b", "s.kind", "s.at")


def folded(groups: DataFrame, answers: DataFrame) -> DataFrame:
    """``(id, group)`` with groups joined by "same" answers, unless that joins what a "different" answer keeps apart.

    "Same" answers are taken in order (``at``, ``a``, ``b``); a join never splits a group, ends without a group are ignored.
    Only groups that "same" answers connect can affect each other, so each such part is taken on its own.
    """
    g = groups.select("id", "group")
    e = answers.where("kind IN ('same', 'different')").join(g.select(F.col("id").alias("a"), F.col("group").alias("x")), "a").join(g.select(F.col("id").alias("b"), F.col("group").alias("y")), "b").where("x <> y")
    e = cut(e.select("x", "y", "kind", "at", "a", "b"))
    part = components(e.where("kind = 'same'").select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("x"), F.col("group_id").alias("px"))
    inside = e.join(part, "x").join(part.select(F.col("x").alias("y"), F.col("px").alias("py")), "y").where("px = py")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, set[int]] = {}  # groups that are one by now, under each of their names
        foes: dict[int, set[int]] = {}
        for x, y, kind in zip(pdf.x, pdf.y, pdf.kind):
            for v in (x, y):
                held.setdefault(v, {v})
                foes.setdefault(v, set())
            if kind == "different":
                foes[x].add(y)
                foes[y].add(x)
        bad = {id(s): set(foes[v]) for v, s in held.items()}
        for x, y in pdf[pdf.kind == "same"].sort_values(["at", "a", "b"], na_position="first")[["x", "y"]].itertuples(index=False):
            s, t = held[x], held[y]
            if s is t or not bad[id(s)].isdisjoint(t):
                continue
            if len(s) < len(t):
                s, t = t, s
            s |= t
            bad[id(s)] |= bad[id(t)]
            for v in t:
                held[v] = s
        return pd.DataFrame({"group": list(held), "new": [min(s) for s in held.values()]})

    to = inside.groupBy("px").applyInPandas(run, "group long, new long").where("group <> new")
    return groups.join(to, "group", "left").select("id", F.coalesce("new", "group").alias("group"))


def carried_names(groups: DataFrame, known: DataFrame, least: int = 3) -> DataFrame:
    """``(group, name)``: names of before to groups of now, one to one, most shared members first, then the later name and
    group (W7, U4). ``known(id, name)``."""
    shared = groups.join(known.where("trim(name) <> ''"), "id").groupBy("group", "name").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    return matched(shared, "group", "name", F.struct("shared", "name", "group")).select("group", "name")


def persons(faces: DataFrame, links: DataFrame, width: int = 128, least_seeds: int = 3) -> DataFrame:
    """``(face_id, person_id, name)``: persons rebuilt from nothing.

    Good faces (usable vector, ``not_person`` 0, tier not LOW_QUALITY) of tier HIGH make the cores; if those are fewer than
    ``least_seeds``, all do. The other good faces join a core or stay alone, and alone they are no person. Answers then join
    persons, names of before (``manual_person``) are carried over, and faces named by hand go to the person of that name
    (G13). ``person_id`` is the smallest face of the person. Repeated rows are one face; an empty table gives no rows.
    """
    good = faces.where((F.coalesce("not_person", F.lit(0)) == 0) & (F.coalesce(label("quality_tier"), F.lit("BORDERLINE")) != "LOW_QUALITY"))
    v = cut(pack(good.withColumn("tier", F.coalesce(label("quality_tier"), F.lit("BORDERLINE"))), width, "tier"))
    seeds = v.where("tier = 'HIGH'").drop("tier")
    rest = v.where("tier <> 'HIGH'").drop("tier")
    if seeds.count() < least_seeds:
        seeds, rest = v.drop("tier"), v.drop("tier").where("false")
    core = cores(seeds, width)
    answers = cut(latest_answers(links))
    alone = seeds.join(core, "id", "left_anti").unionByName(rest)
    side = attached(alone, core, seeds, width, answers.where("kind = 'different'").select("a", "b"))
    g = cut(folded(cut(core.unionByName(side)), answers))
    known = faces.where("trim(manual_person) <> ''").groupBy("id").agg(F.min(F.trim("manual_person")).alias("name"))
    names = carried_names(g, known)
    both = g.join(names, "group", "left").select("id", "group", "name").join(known.withColumnRenamed("name", "pin"), "id", "full")
    # A face named by hand belongs to the person of that name, whether or not its group took it.
    p = both.select("id", F.coalesce("pin", "name").alias("name"), "group").withColumn("person", F.when(F.col("name").isNotNull(), F.concat(F.lit("n"), "name")).otherwise(F.concat(F.lit("g"), F.col("group").cast("string"))))
    p = cut(p)
    return p.join(p.groupBy("person").agg(F.min("id").alias("person_id")), "person").select(F.col("id").alias("face_id"), "person_id", "name")

"""Edits of entities as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.functions.numbers import haversine
from kestrel.operators.entities import merged_centre

#: What a "person" may be instead.
HIDE_KINDS = {"statue", "drawing", "doll", "screen", "animal", "other"}


def rename(table: DataFrame, entity: int, name: str, key: str = "id") -> DataFrame:
    """The entity's name, trimmed; blanks take it away (M1)."""
    new = F.nullif(F.lit(name.strip()), F.lit(""))
    return table.withColumn("name", F.when(F.col(key) == entity, new).otherwise(F.col("name")))


def reassign(faces: DataFrame, face: int, person: int, name: str) -> DataFrame:
    """A face given to another person and pinned there by name (M2)."""
    mine = F.col("id") == face
    return faces.withColumn("person_id", F.when(mine, F.lit(person).cast("long")).otherwise(F.col("person_id"))).withColumn("manual_person", F.when(mine, name).otherwise(F.col("manual_person")))


def link(links: DataFrame, a: int, b: int, kind: str, at: str) -> DataFrame:
    """An answer about two records appended, the smaller id first."""
    row = links.sparkSession.createDataFrame([(min(a, b), max(a, b), kind, at)], "face_a long, face_b long, kind string, created_at string")
    return links.unionByName(row.withColumn("created_at", F.col("created_at").cast("timestamp")))


def detach(faces: DataFrame, links: DataFrame, person: int, file_id: int, rep: int, at: str) -> tuple[DataFrame, DataFrame]:
    """A file's faces taken from a person, each kept apart from its representative (M3)."""
    hit = (F.col("person_id") == person) & (F.col("file_id") == file_id)
    gone = faces.where(hit).select("id")
    apart = gone.where(F.col("id") != rep).select(F.least("id", F.lit(rep)).alias("face_a"), F.greatest("id", F.lit(rep)).alias("face_b"), F.lit("different").alias("kind"), F.lit(at).cast("timestamp").alias("created_at"))
    left = faces.withColumn("person_id", F.when(hit, F.lit(None).cast("long")).otherwise(F.col("person_id")))
    return left, links.unionByName(apart)


def tag(tags: DataFrame, entity: int, name: str, file_id: int) -> DataFrame:
    """A manual tag ``(entity_id, name, file_id)``, once (M4)."""
    row = tags.sparkSession.createDataFrame([(entity, name, file_id)], "entity_id long, name string, file_id long")
    return tags.unionByName(row.join(tags, ["entity_id", "file_id"], "left_anti").select("entity_id", "name", "file_id"))


def untag(tags: DataFrame, entity: int, file_id: int) -> DataFrame:
    return tags.where((F.col("entity_id") != entity) | (F.col("file_id") != file_id))


def hide_person(faces: DataFrame, person: int, kind: str) -> DataFrame:
    """All faces of a "person" that is none, with what it is instead (M5)."""
    if kind not in HIDE_KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    mine = F.col("person_id") == person
    f = faces.withColumn("not_person", F.when(mine, 1).otherwise(F.col("not_person")).cast("long")).withColumn("nonhuman_kind", F.when(mine, kind).otherwise(F.col("nonhuman_kind")))
    return f.withColumn("person_id", F.when(mine, F.lit(None).cast("long")).otherwise(F.col("person_id")))


def survivor(table: DataFrame, a: int, b: int, order: list[str]) -> tuple[int, int]:
    """(survivor, loser) of two entities: named first, then ``order`` columns falling, then the lower id (M6-M8)."""
    t = table.where(F.col("id").isin(a, b)).withColumn("named", (F.coalesce(F.trim("name"), F.lit("")) != "").cast("int"))
    rows = t.orderBy(F.desc("named"), *[F.desc(c) for c in order], "id").select("id").limit(2).collect()
    if len(rows) != 2:
        raise ValueError("both entities must exist and differ")
    return rows[0]["id"], rows[1]["id"]


def merge(entities: DataFrame, children: DataFrame, key: str, a: int, b: int, order: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """One entity of two: children follow the survivor, the loser is gone (M6, M7)."""
    win, lose = survivor(entities, a, b, order)
    kids = children.withColumn(key, F.when(F.col(key) == lose, F.lit(win).cast("long")).otherwise(F.col(key)))
    return entities.where(F.col("id") != lose), kids, win


def merge_places(places: DataFrame, members: DataFrame, a: int, b: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two places of one root in one, at their weighted centre, with an undo record.

    ``members(place_id, file_id, source)``; a file in both is a member once.
    """
    pair = places.where(F.col("id").isin(a, b))
    if pair.select("root_id").distinct().count() != 1:
        raise ValueError("places of different roots stay apart")
    win, lose = survivor(places, a, b, ["pinned", "member_count"])
    x, y = places.where(F.col("id") == win).alias("x"), places.where(F.col("id") == lose).alias("y")
    side = lambda t: {c: F.col(f"{t}.{c}") for c in ("lat", "lon", "member_count", "pinned")}
    moved = members.withColumn("place_id", F.when(F.col("place_id") == lose, F.lit(win).cast("long")).otherwise(F.col("place_id"))).dropDuplicates(["place_id", "file_id"])
    centre = x.crossJoin(y).select(F.col("x.id").alias("id"), merged_centre(side("x"), side("y")).alias("c"))
    count = moved.where(F.col("place_id") == win).agg(F.count("*").alias("n"))
    out = places.where(F.col("id") != lose).join(F.broadcast(centre.crossJoin(count)), "id", "left")
    out = out.withColumn("lat", F.coalesce("c.lat", "lat")).withColumn("lon", F.coalesce("c.lon", "lon")).withColumn("member_count", F.coalesce("n", "member_count")).select(*places.columns)
    undo = pair.select("id", "name", "lat", "lon", "member_count", "pinned", F.lit(win).alias("survivor_id"))
    return out, moved, undo


def unmerge_place(places: DataFrame, members: DataFrame, undo: DataFrame, lost: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A merge taken back: both places as they were, a name only where it has not changed since.

    ``lost(file_id)``: the members that came from the loser.
    """
    u = undo.select("id", F.col("name").alias("_n"), F.col("lat").alias("_y"), F.col("lon").alias("_x"), F.col("member_count").alias("_m"), F.col("pinned").alias("_p"), "survivor_id")
    win = u.where(F.col("id") == F.col("survivor_id"))
    p = places.join(F.broadcast(win), "id", "left")
    back = p.select(*[F.coalesce(F.col({"lat": "_y", "lon": "_x", "member_count": "_m", "pinned": "_p"}[c]), F.col(c)).alias(c) if c in ("lat", "lon", "member_count", "pinned") else F.col(c) for c in places.columns])
    loser = u.where(F.col("id") != F.col("survivor_id")).join(win.select("survivor_id"), "survivor_id")
    root = places.join(win.select("id"), "id", "left_semi").select("root_id")
    again = loser.crossJoin(root).select("id", "root_id", F.col("_n").alias("name"), F.col("_y").alias("lat"), F.col("_x").alias("lon"), F.col("_m").alias("member_count"), F.col("_p").alias("pinned"))
    move = lost.select("file_id", F.lit(True).alias("_moved")).crossJoin(F.broadcast(loser.select(F.col("id").alias("_l"), F.col("survivor_id").alias("_w"))))
    m = members.join(move, (members["file_id"] == move["file_id"]) & (members["place_id"] == move["_w"]), "left").select(F.coalesce("_l", "place_id").alias("place_id"), members["file_id"], "source")
    return back.unionByName(again, allowMissingColumns=True), m


def unmerge_linked(links: DataFrame, log: DataFrame, merge_id: int, at: str) -> tuple[DataFrame, DataFrame]:
    """A merge of persons or pets taken back (M9): the answer that joined them goes, "different" takes its place, the log entry is
    spent. Children move when the clusters are next rebuilt. An unknown merge changes nothing.

    ``log(id, link_a, link_b, ...)``.
    """
    m = log.where(F.col("id") == merge_id).select(F.least("link_a", "link_b").alias("a"), F.greatest("link_a", "link_b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").limit(1)
    kept = links.join(F.broadcast(m), (F.least("face_a", "face_b") == F.col("a")) & (F.greatest("face_a", "face_b") == F.col("b")), "left_anti")
    apart = m.select(F.col("a").alias("face_a"), F.col("b").alias("face_b"), F.lit("different").alias("kind"), F.lit(at).cast("timestamp").alias("created_at"))
    return kept.unionByName(apart, allowMissingColumns=True), log.where(F.col("id") != merge_id)


def restore_faces(faces: DataFrame, detections: DataFrame, verdicts: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Reviewed candidates (M14): "human" ones become faces of nobody and are marked with the new face; "confirmed" ones are marked.
    Candidates without a vector, or already restored, stay as they are. New ids follow the largest, in order of the candidates.

    ``detections(id, file_id, box..., det_score, embedding, review_status, restored_face_id)``, ``verdicts(id, verdict)``.
    """
    v = verdicts.where("verdict IN ('human', 'confirmed')").groupBy("id").agg(F.max("verdict").alias("verdict"))
    d = detections.join(v, "id", "left")
    back = d.where("verdict = 'human' AND embedding IS NOT NULL AND restored_face_id IS NULL")
    top = faces.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rank = back.select(F.col("id").alias("i")).withColumn("k", F.row_number().over(Window.orderBy("i")))  # a page of reviews
    new = rank.crossJoin(F.broadcast(top)).select(F.col("i").alias("id"), (F.col("top") + F.col("k")).alias("face"))
    added = back.join(new, "id").select(F.col("face").alias("id"), *[c for c in faces.columns if c != "id" and c in back.columns], F.lit(at).cast("timestamp").alias("_at"))
    added = added.withColumn("created_at", F.col("_at")).drop("_at") if "created_at" in faces.columns else added.drop("_at")
    marked = d.join(new, "id", "left").select(*[
        F.when(F.col("face").isNotNull(), F.lit("human")).when(F.col("verdict") == "confirmed", F.lit("confirmed")).otherwise(F.col(c)).alias(c) if c == "review_status"
        else F.coalesce("face", c).alias(c) if c == "restored_face_id" else F.col(c) for c in detections.columns
    ])
    return faces.unionByName(added, allowMissingColumns=True), marked


def refresh_pets(pets: DataFrame, detections: DataFrame) -> DataFrame:
    """``pets`` with the species, cover and number that their detections give now (R11): the majority species (of equal ones that
    of the best score), the best scored detection, the count. Pets without detections have none. ``detections(id, pet_id,
    species, det_score)``."""
    score = F.coalesce("det_score", F.lit(-1.0))
    g = detections.where("pet_id IS NOT NULL").groupBy("pet_id", "species").agg(F.count("*").alias("n"), F.max(F.struct(score.alias("s"), (-F.col("id")).alias("i"))).alias("b"))
    one = g.groupBy(F.col("pet_id").alias("id")).agg(F.max_by("species", F.struct("n", "b")).alias("_species"), (-F.max("b")["i"]).alias("_cover"), F.sum("n").alias("_n"))
    j = pets.join(one, "id", "left")
    return j.select(*[F.col({"species": "_species", "cover_detection_id": "_cover"}[c]).alias(c) if c in ("species", "cover_detection_id") else F.coalesce("_n", F.lit(0)).alias(c) if c == "detection_count" else F.col(c) for c in pets.columns])


def register(roots: DataFrame, path: str, zone: str | None, at: str) -> DataFrame:
    """An archive added to the registry, or, if its path is there, configured anew (M15). Ids follow the largest. Folders inside
    one another are told by ``nested``."""
    one = roots.sparkSession.createDataFrame([(path.rstrip("/") or "/", zone)], "path string, zone_name string")
    top = roots.agg(F.coalesce(F.max("root_id"), F.lit(0)).alias("top"))
    known = roots.join(F.broadcast(one.select("path", F.col("zone_name").alias("_z"), F.lit(True).alias("_hit"))), "path", "left")
    kept = known.select(*[F.when(F.col("_hit"), F.col("_z")).otherwise(F.col(c)).alias(c) if c == "zone_name" else F.col(c) for c in roots.columns])
    new = one.join(roots.select("path"), "path", "left_anti").crossJoin(top).select((F.col("top") + 1).alias("root_id"), "path", "zone_name", F.lit(at).cast("timestamp").alias("added_at"))
    return kept.unionByName(new, allowMissingColumns=True)


def unregister(roots: DataFrame, files: DataFrame, root: int) -> tuple[DataFrame, DataFrame]:
    """The registry and the catalogue without one archive."""
    return roots.where(F.col("root_id") != root), files.where(F.col("root_id") != root)


def nested(roots: DataFrame) -> DataFrame:
    """``(outer, inner)``: archives of which one lies in the other's folder, which a check reports (M15). The registry is small."""
    a, b = roots.alias("a"), F.broadcast(roots).alias("b")
    return a.join(b, F.expr("a.root_id <> b.root_id AND startswith(b.path, concat(a.path, '/'))")).select(F.col("a.root_id").alias("outer"), F.col("b.root_id").alias("inner"))


def reconcile_roots(files: DataFrame, held: DataFrame, registry: DataFrame) -> DataFrame:
    """``files`` with the root ids of the registry (M16): an archive that a catalogue ``held(root_id, path)`` under another id than
    ``registry(root_id, path)`` gives its path gets that id; paths that the registry lacks keep theirs."""
    to = held.select(F.col("root_id").alias("_old"), "path").join(registry.select(F.col("root_id").alias("_new"), "path"), "path").where("_old <> _new").groupBy("_old").agg(F.min("_new").alias("_new"))
    j = files.join(F.broadcast(to), F.col("root_id") == F.col("_old"), "left")
    return j.select(*[F.coalesce("_new", "root_id").alias(c) if c == "root_id" else F.col(c) for c in files.columns])


def merge_preview(members: DataFrame, centre: tuple[float, float], most_m: float = 20_000.0) -> DataFrame:
    """``(span_m, wide)``: the farthest member from the merged centre, and whether that is too far."""
    d = haversine(F.col("lat"), F.col("lon"), F.lit(centre[0]), F.lit(centre[1]))
    return members.agg(F.max(d).alias("span_m")).withColumn("wide", F.col("span_m") > most_m)


def set_place(members: DataFrame, files: DataFrame, file_id: int, place_id: int) -> DataFrame:
    """A picture or video put in one place by hand; others are refused."""
    ok = files.where((F.col("id") == file_id) & F.col("media_type").isin("image", "video")).select(F.col("id").alias("file_id"))
    new = ok.select(F.lit(place_id).cast("long").alias("place_id"), "file_id", F.lit("manual").alias("source"))
    return members.join(ok, "file_id", "left_anti").select("place_id", "file_id", "source").unionByName(new)


def recount(entities: DataFrame, members: DataFrame, key: str, count: str) -> DataFrame:
    """Entities with the number of members they have now."""
    n = members.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("_n"))
    return entities.join(n, "id", "left").withColumn(count, F.coalesce("_n", F.lit(0))).drop("_n")


def repair_tags(tags: DataFrame, entities: DataFrame) -> DataFrame:
    """Manual tags pointed to the entity that bears their name now; those without one stay."""
    named = entities.where("trim(name) <> ''").groupBy("name").agg(F.min("id").alias("now"))
    return tags.join(named, "name", "left").select(F.coalesce("now", "entity_id").alias("entity_id"), "name", "file_id").dropDuplicates(["entity_id", "file_id"])


def representative(children: DataFrame, key: str) -> DataFrame:
    """``(key, rep)``: the best scored child of each entity, the smallest id of equal ones."""
    return children.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("id", F.struct(F.coalesce("det_score", F.lit(-1.0)).alias("s"), (-F.col("id")).alias("i"))).alias("rep"))


def merges_for(log: DataFrame, entity: int, name: str | None) -> DataFrame:
    """Merges to undo of an entity, by id or by its name, newest first."""
    hit = F.col("survivor_id") == entity
    if name and name.strip():
        hit = hit | (F.col("survivor_name") == name)
    return log.where(hit).orderBy(F.desc("created_at"), F.desc("id"))

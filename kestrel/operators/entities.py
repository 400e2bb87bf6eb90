"""Faces, animals, places and their figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.functions.clean import label
from kestrel.functions.numbers import cell, haversine, quality_score, tier
from kestrel.operators.browse import named_first
from kestrel.operators.graph import components


def good_face(faces: DataFrame) -> DataFrame:
    """Faces of persons whose tier does not rule them out; a missing tier reads BORDERLINE."""
    return faces.where((F.coalesce("not_person", F.lit(0)) == 0) & (F.coalesce(label("quality_tier"), F.lit("BORDERLINE")) != "LOW_QUALITY"))


def face_summary(faces: DataFrame) -> DataFrame:
    """Faces, good ones, files and persons."""
    f = faces.select("id", "file_id", "person_id", ((F.coalesce("not_person", F.lit(0)) == 0) & (F.coalesce(label("quality_tier"), F.lit("BORDERLINE")) != "LOW_QUALITY")).alias("good"))
    return f.agg(F.countDistinct("id").alias("faces"), F.countDistinct(F.when(F.col("good"), F.col("id"))).alias("good_faces"), F.countDistinct("file_id").alias("files"), F.countDistinct("person_id").alias("persons"))


def tier_histogram(faces: DataFrame) -> DataFrame:
    """Faces by tier, UNTIERED where there is none, with their mean score."""
    return faces.groupBy(F.coalesce(label("quality_tier"), F.lit("UNTIERED")).alias("tier")).agg(F.count("*").alias("faces"), F.round(F.avg("det_score"), 6).alias("mean_score"))


def calibration(values: DataFrame, value: str, first: int | None = None) -> DataFrame:
    """Mean and population deviation of the first values by id."""
    v = values.where(F.col(value).isNotNull() & ~F.isnan(value))
    return (v.orderBy("id").limit(first) if first else v).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"))


def retier(values: DataFrame, value: str, calibrated: DataFrame) -> DataFrame:
    """``(id, score, tier)`` under a calibration, a table of one row."""
    s = quality_score(F.col(value), F.col("mean"), F.col("std"))
    return values.crossJoin(calibrated.select("mean", "std")).select("id", F.round(s, 6).alias("score"), tier(s).alias("tier"))


def best_per(df: DataFrame, by: str, k: int = 1, score: str = "det_score", key: str = "id") -> DataFrame:
    """The ``k`` best rows of each group: score falling, then id."""
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last(score), F.asc(key))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def majority_species(detections: DataFrame, by: str) -> DataFrame:
    """Most frequent species of a group; of equal ones that of the best score, then by name."""
    g = detections.where("species IS NOT NULL").groupBy(by, "species").agg(F.count("*").alias("n"), F.max("det_score").alias("top"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), F.desc("top"), "species")
    return g.withColumn("r", F.row_number().over(w)).where("r = 1").select(by, "species", "n")


def gallery(detections: DataFrame) -> DataFrame:
    """Detections to look through, without toys."""
    return detections.where("species IS NULL OR species <> 'teddy bear'").orderBy(F.desc("det_score"), "id")


def entity_listing(entities: DataFrame, children: DataFrame, files: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """``(id, name, photos, children)``: entities that visible children have, named ones first, then the most children, then id
    (A15, A16, O4). ``photos`` counts the files of the children and, once each, visible files that are only tagged by hand.

    ``entities(id, name)``, ``children(key, file_id)``, ``tags(entity_id, file_id)``.
    """
    shown = files.where("present = 1 AND hidden = 0").select(F.col("id").alias("file_id"))
    c = children.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), "file_id")
    found = c.join(shown, "file_id").groupBy("id", "file_id").agg(F.count("*").alias("n")).groupBy("id").agg(F.count("*").alias("photos"), F.sum("n").alias("children"))
    hand = tags.select(F.col("entity_id").alias("id"), "file_id").distinct().join(shown, "file_id", "left_semi").join(c.distinct(), ["id", "file_id"], "left_anti").groupBy("id").agg(F.count("*").alias("tagged"))
    out = entities.join(found, "id").join(hand, "id", "left").select("id", "name", (F.col("photos") + F.coalesce("tagged", F.lit(0))).alias("photos"), "children")
    return out.orderBy(named_first(F.col("name")), F.desc("children"), "id")


def pet_summary(files: DataFrame, scans: DataFrame, detections: DataFrame, nonhuman: DataFrame, model: str, videos: bool = False) -> DataFrame:
    """One row: images, scanned and unscanned ones, detections but toys, pets, faces that are none (A16). ``scans(file_id,
    source_sha256, model_source)`` count at the present bytes and model only."""
    f = files.where("present = 1 AND hidden = 0")
    ids = f.select(F.col("id").alias("file_id"))
    total = f.where(F.col("media_type").isin(["image", "video"] if videos else ["image"])).agg(F.count("*").alias("images"))
    s = scans.where(F.col("model_source").eqNullSafe(F.lit(model))).alias("s").join(f.select("id", "sha256").alias("f"), F.expr("s.file_id = f.id AND s.source_sha256 <=> f.sha256")).agg(F.count("*").alias("scanned"))
    d = detections.join(ids, "file_id").agg(F.count_if(F.col("species") != "teddy bear").alias("detections"), F.countDistinct("pet_id").alias("pets"))
    n = nonhuman.join(ids, "file_id").agg(F.count("*").alias("nonhuman"))
    one = total.crossJoin(s).crossJoin(d).crossJoin(n)  # one row each
    return one.select("images", "scanned", F.greatest(F.lit(0), F.col("images") - F.col("scanned")).alias("unscanned"), "detections", "pets", "nonhuman")


def merged_photos(groups: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """``(merge_id, photos)``: different files of the children that each merge names in ``groups(merge_id, ids)``."""
    c = groups.select("merge_id", F.explode("ids").alias("id")).join(children.select("id", "file_id"), "id")
    return groups.select("merge_id").join(c.groupBy("merge_id").agg(F.countDistinct("file_id").alias("photos")), "merge_id", "left").withColumn("photos", F.coalesce("photos", F.lit(0)))


def linked_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """``(group_a, group_b, kind, answers)``: answers about faces as answers about their groups, by join (J20); ends without a
    group are left out. ``members(id, group_id)``."""
    m = members.select("id", "group_id")
    j = links.join(m.select(F.col("id").alias("face_a"), F.col("group_id").alias("x")), "face_a").join(m.select(F.col("id").alias("face_b"), F.col("group_id").alias("y")), "face_b")
    return j.groupBy(F.least("x", "y").alias("group_a"), F.greatest("x", "y").alias("group_b"), F.lower(F.trim("kind")).alias("kind")).agg(F.count("*").alias("answers"))


def link_ends(links: DataFrame) -> DataFrame:
    """Every record that an answer speaks of, once."""
    return links.select(F.col("face_a").alias("id")).union(links.select("face_b")).where("id IS NOT NULL").distinct()


def map_buckets(places: DataFrame, scale: float, bucket: float = 54.0) -> DataFrame:
    """``(bx, by, places, members, lat, lon)``: markers of one map view, places of one screen bucket together (N23). ``scale`` is
    pixels per degree; halves round up, as on a screen."""
    at = lambda c: F.floor(F.col(c) * scale / bucket + 0.5).cast("long")
    return places.groupBy(at("lon").alias("bx"), at("lat").alias("by")).agg(F.count("*").alias("places"), F.sum("member_count").alias("members"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def visible_places(places: DataFrame, least: int = 3) -> DataFrame:
    """Places with enough members, a name or a pin (F13), named ones first, then by members."""
    p = places.where((F.col("member_count") >= least) | (F.trim("name") != "") | (F.col("pinned") == 1))
    return p.withColumn("unnamed", named_first(F.col("name")))


def below_threshold(places: DataFrame, least: int = 3) -> DataFrame:
    """How many places are not shown, and their members."""
    shown = F.coalesce((F.col("member_count") >= least) | (F.trim("name") != "") | (F.col("pinned") == 1), F.lit(False))
    return places.where(~shown).agg(F.count("*").alias("places"), F.coalesce(F.sum("member_count"), F.lit(0)).alias("members"))


def place_cells(points: DataFrame, radius_m: float = 300.0) -> DataFrame:
    """``(id, lat, lon, group_id)``: points in one grid cell of the radius belong together, and so do two neighbouring cells
    of which two points are within the radius (J11, G3). ``group_id`` is the smallest id; points alone are their own group.

    Work is by cells: equal points are compared once, and what comes out of the comparison of two cells is one row, by
    partial aggregation, however many points they hold. Repeated rows are one point; NULL coordinates are left out.
    """
    p = points.where("id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").dropDuplicates(["id"]).select("id", "lat", "lon", cell(F.col("lat"), F.col("lon"), radius_m).alias("c"))
    first = p.groupBy("c").agg(F.min("id").alias("first"))
    spot = p.select("lat", "lon", "c").distinct()
    steps = F.array(*[F.struct(F.lit(dy).cast("long").alias("y"), F.lit(dx).cast("long").alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) > (0, 0)])
    a = spot.select("lat", "lon", "c", F.explode(steps).alias("s")).select("lat", "lon", F.col("c").alias("a"), F.struct((F.col("c.y") + F.col("s.y")).alias("y"), (F.col("c.x") + F.col("s.x")).alias("x")).alias("b"))
    near = a.join(spot.select(F.col("lat").alias("qlat"), F.col("lon").alias("qlon"), F.col("c").alias("b")), "b").where(haversine(F.col("lat"), F.col("lon"), F.col("qlat"), F.col("qlon")) <= radius_m)
    edges = near.select("a", "b").distinct()
    named = edges.join(first.select(F.col("c").alias("a"), F.col("first").alias("i")), "a").join(first.select(F.col("c").alias("b"), F.col("first").alias("j")), "b").select(F.col("i").alias("a"), F.col("j").alias("b"))
    tied = components(named).withColumnRenamed("node", "first")
    return p.join(first.join(tied, "first", "left").select("c", F.coalesce("group_id", "first").alias("group_id")), "c").select("id", "lat", "lon", "group_id")


def place_groups(points: DataFrame, radius_m: float = 300.0) -> DataFrame:
    """``(group_id, lat, lon, points)``: centre and size of each group of ``place_cells``."""
    return place_cells(points, radius_m).groupBy("group_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("points"))


def nearest_place(points: DataFrame, places: DataFrame, radius_m: float = 300.0, others: bool = False) -> DataFrame:
    """``(id, place_id, metres)``: the nearest place within a distance; of equal ones the later.

    With ``others`` the points are places themselves, and none is its own nearest.

    Candidates come from a grid of cells half again as wide as the radius: a point looks in its own and the cells
    around, so no side is broadcast. Columns: ``points(id, lat, lon)``, ``places(place_id, lat, lon)``.
    """
    step = radius_m / 111_320.0 * 1.5
    row = lambda c: F.floor(c / step).cast("long")
    width = lambda r: F.greatest(F.lit(1).cast("long"), F.floor(F.cos(F.radians(F.least(F.lit(89.9), F.abs(r * step) + step * 2))) * 360 / step).cast("long"))
    col = lambda lon, r: F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * width(r)).cast("long")
    p = points.withColumn("r", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: row(F.col("lat")) + d)))
    p = p.withColumn("c", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(col(F.col("lon"), F.col("r")) + d, width(F.col("r")))))))
    q = places.select("place_id", F.col("lat").alias("plat"), F.col("lon").alias("plon"), row(F.col("lat")).alias("r")).withColumn("c", col(F.col("plon"), F.col("r")))
    near = p.join(q, ["r", "c"])
    if others:
        near = near.where("id <> place_id")
    j = near.withColumn("metres", haversine(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))).where(F.col("metres") <= radius_m)
    return j.groupBy("id").agg(F.max_by("place_id", F.struct((-F.col("metres")).alias("m"), F.col("place_id"))).alias("place_id"), F.min("metres").alias("metres"))


def merged_centre(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Centre of two places in one: a pinned one decides, else by members, else the first."""
    n = a["member_count"] + b["member_count"]
    mean = lambda k: (a[k] * a["member_count"] + b[k] * b["member_count"]) / n
    of = lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))
    return F.when(a["pinned"] == 1, of(a)).when(b["pinned"] == 1, of(b)).when(n <= 0, of(a)).otherwise(F.struct(mean("lat").alias("lat"), mean("lon").alias("lon")))


def rejection(det: Column, size: Column, clipped: Column, focus: Column, exposure: Column, least: dict[str, float]) -> Column:
    """The first quality gate that a face fails, 'accepted' if none."""
    return (
        F.when(det < least["score"], "score").when(size < least["size"], "size").when(clipped > least["clipped"], "clipped")
        .when(focus < least["focus"], "focus").when(exposure < least["exposure"], "exposure").otherwise("accepted")
    )

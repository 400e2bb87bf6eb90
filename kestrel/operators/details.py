"""Single records, cards and diagnostics (A22, A30, A31, J18, J19, J22, O2, O3, O7, P23, R1-R3, R6-R9, R13, R17-R20, S32's keys, U1, U2, V3, W4, X7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.functions.paths import basename, dirname
from kestrel.operators.browse import records
from kestrel.operators.entities import best_per, visible_places


def coverage_flags(files: DataFrame, **tables: DataFrame) -> DataFrame:
    """``(id, <table>...)``: for each file and table of ``file_id`` whether it was looked at (A31). Absence is information, so
    a file that was looked at without a finding needs a row in that table."""
    out = files.select("id")
    for name, t in tables.items():
        has = t.select(F.col("file_id").alias("id")).where("id IS NOT NULL").distinct().withColumn(name, F.lit(True))
        out = out.join(has, "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def archive_cards(files: DataFrame, covers: int = 5) -> DataFrame:
    """One row per root: files, bytes, last sight, and its newest pictures as covers."""
    f = files.where("present = 1")
    g = f.groupBy("root_id").agg(F.count("*").alias("files"), F.coalesce(F.sum(F.greatest(F.col("size"), F.lit(0))), F.lit(0)).alias("bytes"), F.max("last_seen").alias("last_seen"))
    w = Window.partitionBy("root_id").orderBy(F.desc_nulls_last("first_seen"), F.desc("id"))
    top = f.where("hidden = 0 AND media_type = 'image'").select("root_id", "id", "first_seen").withColumn("r", F.row_number().over(w)).where(F.col("r") <= covers)
    c = top.groupBy("root_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("covers"))
    return g.join(c, "root_id", "left")


def of_person(faces: DataFrame, tags: DataFrame, person: int) -> DataFrame:
    """``(file_id, face_id)``: the best face in each of a person's files, then files only tagged by hand."""
    found = best_per(faces.where(F.col("person_id") == person), "file_id").select("file_id", F.col("id").alias("face_id"))
    by_hand = tags.where(F.col("entity_id") == person).select("file_id").distinct().join(found.select("file_id"), "file_id", "left_anti")
    return found.unionByName(by_hand.withColumn("face_id", F.lit(None).cast("long")))


def place_members(members: DataFrame, dates: DataFrame, place: int, limit: int = 120, offset: int = 0) -> DataFrame:
    """A page of a place's files, the oldest first and undated ones last."""
    d = dates.groupBy("file_id").agg(F.min("best_datetime").alias("dt"))
    return members.where(F.col("place_id") == place).join(d, "file_id", "left").orderBy(F.asc_nulls_last("dt"), "file_id").offset(offset).limit(limit)


def place_points(files: DataFrame, geo: DataFrame, members: DataFrame) -> DataFrame:
    """``(id, lat, lon, place_id)`` of visible files with a position; one in two places has two rows."""
    f = files.where("present = 1 AND hidden = 0").select("id")
    g = geo.select(F.col("file_id").alias("id"), F.bround("lat", 5).alias("lat"), F.bround("lon", 5).alias("lon"))
    return f.join(g, "id").join(members.select(F.col("file_id").alias("id"), "place_id"), "id", "left")


def first_members(members: DataFrame, k: int = 4) -> DataFrame:
    """The first ``k`` files of each place."""
    w = Window.partitionBy("place_id").orderBy("file_id")
    return members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def media_source(files: DataFrame, orientation: DataFrame) -> DataFrame:
    """Where a file's bytes are and how far to turn them."""
    o = orientation.groupBy(F.col("file_id").alias("id")).agg(F.max("rotate_deg").alias("rotate_deg"))
    return files.select("id", "root_id", "rel_path", "sha256").join(o, "id", "left").withColumn("rotate_deg", F.coalesce("rotate_deg", F.lit(0)))


def crops(detections: DataFrame, source: DataFrame) -> DataFrame:
    """Boxes with the file to cut them from (R2)."""
    s = source.select(F.col("id").alias("file_id"), "rel_path", "sha256", "rotate_deg")
    return detections.select("id", "file_id", "box_x", "box_y", "box_w", "box_h").join(s, "file_id")


def item(files: DataFrame, dates: DataFrame, faces: DataFrame, animals: DataFrame, groups: DataFrame) -> DataFrame:
    """One nested row per file: its record, date, detections and duplicate group (X7, R7, R8). Detections are bounded by a picture."""
    d = records(dates, "file_id").select(F.col("file_id").alias("id"), F.struct("best_datetime", "date_source", "date_confidence").alias("date"))
    box = F.struct("id", "box_x", "box_y", "box_w", "box_h", "det_score")
    seen = lambda t, n: t.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list(box)).alias(n))
    out = files.join(d, "id", "left").join(seen(faces, "faces"), "id", "left").join(seen(animals, "animals"), "id", "left").join(groups.select("id", "group_id", "canonical_id"), "id", "left")
    return out.withColumn("faces", F.coalesce("faces", F.array())).withColumn("animals", F.coalesce("animals", F.array()))


def item_record(files: DataFrame, dates: DataFrame, faces: DataFrame, animals: DataFrame, groups: DataFrame, tags: DataFrame, places: DataFrame, texts: DataFrame) -> DataFrame:
    """``item`` with the names tagged by hand, the place and the reading of each file (X7): ``tags(file_id, name)`` as from
    ``item_tags``, ``places(file_id, place_id, name)`` as from ``item_places``, ``texts(file_id, status, extractor, n_chunks)``."""
    t = tags.groupBy(F.col("file_id").alias("id")).agg(F.sort_array(F.collect_set("name")).alias("tags"))
    p = places.select(F.col("file_id").alias("id"), F.struct("place_id", "name").alias("place"))
    x = texts.select(F.col("file_id").alias("id"), F.struct("status", "extractor", "n_chunks").alias("text"))
    out = item(files, dates, faces, animals, groups).join(t, "id", "left").join(p, "id", "left").join(x, "id", "left")
    return out.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def thumbnail_key(sha: Column, kind: str, side: int) -> Column:
    """Where a cache keeps a picture of some content: by the content and what was made of it, in 256 folders (S32); NULL without
    content."""
    return F.when(sha.isNotNull(), F.concat(F.substring(sha, 1, 2), F.lit("/"), sha, F.lit(f"_{kind}_{side}.jpg")))


def progress(everything: DataFrame, owed: DataFrame, key: str = "id") -> DataFrame:
    """``(total, done)`` as the complement of what is owed."""
    n = everything.agg(F.countDistinct(key).alias("total"))
    m = owed.agg(F.countDistinct(key).alias("owed"))
    return n.crossJoin(m).select("total", (F.col("total") - F.col("owed")).alias("done"))  # one row each


def percentiles(scores: DataFrame, value: str, at: tuple[float, ...] = (1, 5, 25, 50, 75, 95, 99, 99.9)) -> DataFrame:
    """``(percent, value)`` exactly."""
    p = F.percentile(value, F.array(*[F.lit(a / 100) for a in at])).alias("v")
    return scores.agg(p).select(F.posexplode("v").alias("k", "value")).select(F.element_at(F.array(*[F.lit(float(a)) for a in at]), F.col("k") + 1).alias("percent"), "value")


def sweep(scored: DataFrame, floors: list[float], ratios: list[float]) -> DataFrame:
    """``(floor, ratio, kept)``: median number of results per query under each pair of cuts (R17). ``scored(query, score)``."""
    grid = F.explode(F.array(*[F.struct(F.lit(f).alias("floor"), F.lit(r).alias("ratio")) for f in floors for r in ratios]))
    best = scored.groupBy("query").agg(F.max("score").alias("best")).withColumn("g", grid)
    s = best.join(scored, "query").where((F.col("score") >= F.col("g.floor")) & ((F.col("best") <= 0) | (F.col("score") >= F.col("g.ratio") * F.col("best"))))
    n = best.select("query", "g").join(s.groupBy("query", "g").agg(F.count("*").alias("n")), ["query", "g"], "left")
    return n.groupBy(F.col("g.floor").alias("floor"), F.col("g.ratio").alias("ratio")).agg(F.median(F.coalesce("n", F.lit(0))).alias("kept"))


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The same ``n`` rows every time, however the table is cut up."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def montage(persons: DataFrame, faces: DataFrame, k: int = 8) -> DataFrame:
    """Representatives of each person, the largest person first."""
    f = best_per(faces.where("person_id IS NOT NULL"), "person_id", k).select("person_id", F.col("id").alias("face_id"), "rank")
    return persons.select(F.col("id").alias("person_id"), "face_count").join(f, "person_id").orderBy(F.desc("face_count"), "person_id", "rank")


def centre(vectors: DataFrame, most: int = 4096) -> list[float]:
    """Mean of the unit vectors of a bounded, fixed sample."""
    from kestrel.functions.numbers import norm

    v = sample(vectors, "vec_id", most).select(F.posexplode(F.transform("embedding", lambda x: x.cast("double") / norm(F.col("embedding")))))
    return [r["m"] for r in v.groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()]


def item_places(members: DataFrame, places: DataFrame, least: int = 3) -> DataFrame:
    """``(file_id, place_id, name)``: the place of each file; places that are not shown give none."""
    shown = visible_places(places, least).select(F.col("id").alias("place_id"), "name")
    return members.select("file_id", "place_id").join(shown, "place_id").groupBy("file_id").agg(F.min(F.struct("place_id", "name")).alias("p")).select("file_id", "p.place_id", "p.name")


def nonhuman_review(detections: DataFrame, files: DataFrame, limit: int = 120, offset: int = 0) -> DataFrame:
    """A page of faces that may be none, the surest first, with their file."""
    f = files.where("present = 1 AND hidden = 0").select(F.col("id").alias("file_id"), "rel_path")
    return detections.join(f, "file_id").orderBy(F.desc_nulls_last("confidence"), "id").offset(offset).limit(limit)


def item_tags(tags: DataFrame, entities: DataFrame) -> DataFrame:
    """``(file_id, entity_id, name)`` of manual tags; the stored name stands in where the entity has gone."""
    e = entities.select(F.col("id").alias("entity_id"), F.col("name").alias("now"))
    return tags.select("file_id", "entity_id", "name").distinct().join(e, "entity_id", "left").select("file_id", "entity_id", F.coalesce("now", "name").alias("name"))


def item_duplicates(members: DataFrame, files: DataFrame, file_id: int) -> DataFrame:
    """The duplicate group of one file: its members with names and how each matches the canonical, which comes first.
    ``members`` as from ``dups.membership``."""
    group = members.where(F.col("id") == file_id).select("group_id")
    m = members.join(F.broadcast(group), "group_id", "left_semi").join(files.select("id", "rel_path", "media_type"), "id")
    return m.select("id", "group_id", "match_type", "media_type", basename(F.col("rel_path")).alias("name"), dirname(F.col("rel_path")).alias("folder")).orderBy(F.col("match_type") != "canonical", "id")


def semantic_page(scored: DataFrame, media: DataFrame, least: float, relative: float, sort: str = "relevance", limit: int = 120, offset: int = 0) -> DataFrame:
    """A page of a description search end to end (V3, O3, O8): of ``media(id, best_datetime, ...)`` already filtered, what clears
    both cuts of ``scored(vec_id, score)``, by relevance, newest or oldest (undated last), with the ``total`` of all pages.

    The cuts are taken after the filters; ties of relevance go by id.
    """
    from kestrel.operators.search import cut_relevance

    kept = cut_relevance(scored.join(media.select(F.col("id").alias("vec_id")), "vec_id", "left_semi"), least, relative)
    order = {
        "relevance": (F.desc("score"), F.asc("id")), "newest": (F.desc_nulls_last("best_datetime"), F.asc("id")), "oldest": (F.asc_nulls_last("best_datetime"), F.asc("id")),
    }[sort]
    rows = media.join(kept.withColumnRenamed("vec_id", "id"), "id")
    total = kept.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(min(limit, 500)).crossJoin(F.broadcast(total)).withColumn("score", F.round("score", 4))


def ranked_hits(hits: DataFrame, files: DataFrame, dates: DataFrame, sort: str = "relevance") -> DataFrame:
    """Word hits of visible files with their dates, by relevance, newest or oldest."""
    d = dates.groupBy("file_id").agg(F.min("best_datetime").alias("dt"))
    j = hits.join(files.where("present = 1 AND hidden = 0").select(F.col("id").alias("file_id"), "rel_path"), "file_id").join(d, "file_id", "left")
    order = {"relevance": (F.asc("score"), F.asc("file_id")), "newest": (F.desc_nulls_last("dt"), F.desc("file_id")), "oldest": (F.asc_nulls_last("dt"), F.asc("file_id"))}
    return j.orderBy(*order[sort])

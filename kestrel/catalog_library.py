"""Queries over people, pets, places, edits and the incremental side. Tables that the catalogue's test data lacks (persons, manual
tags, places of files, scans) are made from whole tables, on both sides alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.catalog import _D, _F, _HASH, _NEAR, _POINTS, _U, _candidates, _dates, _files, _points, _query_vector, _rec, query
from kestrel.operators import browse, clusters, details, dups, entities, matching, search
from kestrel.operators.spatial import containing_region
from kestrel.plans import edits, snapshots
from kestrel.session import table

# Made tables: a person of every good face by its id, a name for a third of them, tags by hand, a pet of every animal.
_MADE = f"""{_F}, {_D}, fa AS (SELECT DISTINCT id, file_id, det_score, not_person, box_x, box_y, box_w, box_h, CASE WHEN not_person = 0 THEN id % 97 END AS person_id FROM faces),
per AS (SELECT i AS id, CASE WHEN i % 3 = 0 THEN 'Person ' || i WHEN i % 3 = 1 THEN ' ' END AS name FROM range(97) t(i)),
tg AS (SELECT DISTINCT id % 97 AS entity_id, 'Person ' || (id % 97) AS name, id AS file_id FROM f WHERE id % 5 = 0),
an AS (SELECT DISTINCT id, file_id, species, det_score, box_x, box_y, box_w, box_h, id % 41 AS pet_id FROM animal_detections),
shown AS (SELECT id FROM f WHERE present = 1 AND hidden = 0)"""


def _faces(spark, d, *more):
    return _rec(spark, d, "faces", "id", "file_id", "det_score", "not_person", *more).withColumn("person_id", F.when(F.col("not_person") == 0, F.col("id") % 97))


def _persons(spark, k=97):
    i = F.col("id")
    return spark.range(k).select("id", F.when(i % 3 == 0, F.concat(F.lit("Person "), i)).when(i % 3 == 1, F.lit(" ")).alias("name"))


def _tags(spark, d):
    f = _files(spark, d, "id").where("id % 5 = 0")
    return f.select((F.col("id") % 97).alias("entity_id"), F.concat(F.lit("Person "), F.col("id") % 97).alias("name"), F.col("id").alias("file_id"))


def _animals(spark, d, *more):
    return _rec(spark, d, "animal_detections", "id", "file_id", "species", "det_score", *more).withColumn("pet_id", F.col("id") % 41)


# --- People and pets (A15, A16, F4, A11, A33, J5, J16, J17, J20, U3, R6, R7, R10, R11, R20, W8) --------------------


@query(f"""WITH {_MADE}, c AS (SELECT person_id AS id, count(DISTINCT file_id) AS photos, count(*) AS children FROM fa JOIN shown ON shown.id = file_id WHERE person_id IS NOT NULL GROUP BY 1),
h AS (SELECT entity_id AS id, count(*) AS n FROM tg JOIN shown ON shown.id = tg.file_id WHERE NOT EXISTS (SELECT 1 FROM fa WHERE fa.person_id = tg.entity_id AND fa.file_id = tg.file_id) GROUP BY 1)
SELECT per.id, name, photos + coalesce(n, 0) AS photos, children FROM per JOIN c USING (id) LEFT JOIN h USING (id)""")
def people_listing(spark, d):
    return entities.entity_listing(_persons(spark), _faces(spark, d), _files(spark, d, "id", "present", "hidden"), _tags(spark, d), "person_id")


@query(f"""WITH {_MADE}, c AS (SELECT pet_id AS id, count(DISTINCT file_id) AS photos, count(*) AS children FROM an JOIN shown ON shown.id = file_id GROUP BY 1),
h AS (SELECT entity_id AS id, count(*) AS n FROM tg JOIN shown ON shown.id = tg.file_id WHERE NOT EXISTS (SELECT 1 FROM an WHERE an.pet_id = tg.entity_id AND an.file_id = tg.file_id) GROUP BY 1)
SELECT per.id, name, photos + coalesce(n, 0) AS photos, children FROM per JOIN c USING (id) LEFT JOIN h USING (id) WHERE per.id < 41""")
def pet_listing(spark, d):
    return entities.entity_listing(_persons(spark, 41), _animals(spark, d), _files(spark, d, "id", "present", "hidden"), _tags(spark, d), "pet_id")


@query(f"""WITH {_MADE}, v AS (SELECT * FROM f WHERE present = 1 AND hidden = 0), i AS (SELECT count(*) AS images FROM v WHERE media_type = 'image'), s AS (SELECT count(*) AS scanned FROM v WHERE id % 3 = 0 AND id % 4 <> 0)
SELECT images, scanned, greatest(0, images - scanned)::bigint AS unscanned, (SELECT count_if(species <> 'teddy bear') FROM an JOIN shown ON shown.id = file_id) AS detections,
(SELECT count(DISTINCT pet_id) FROM an JOIN shown ON shown.id = file_id) AS pets, (SELECT count(*) FROM fa JOIN shown ON shown.id = file_id WHERE not_person = 1) AS nonhuman FROM i, s""")
def pet_figures(spark, d):
    f = _files(spark, d, "id", "media_type", "sha256", "present", "hidden")
    scans = f.where("id % 3 = 0").select(F.col("id").alias("file_id"), F.col("sha256").alias("source_sha256"), F.when(F.col("id") % 4 == 0, "old").otherwise("m2").alias("model_source"))
    return entities.pet_summary(f, scans, _animals(spark, d), _faces(spark, d).where("not_person = 1"), "m2")


@query(f"""WITH {_MADE}, b AS (SELECT file_id, person_id FROM fa UNION SELECT file_id, entity_id FROM tg) SELECT id FROM f WHERE present = 1 AND hidden = 0
AND id IN (SELECT file_id FROM b WHERE person_id % 5 = 0) AND id IN (SELECT file_id FROM b WHERE person_id = 10) OR (present = 1 AND hidden = 0 AND id IN (SELECT file_id FROM b WHERE person_id = 15 ) AND id IN (SELECT file_id FROM b WHERE person_id = 10))""")
def browse_all_people(spark, d):
    """Files of person 10 that also show one of those whose number ends in 0 or 5: the AND over people."""
    f, t = _faces(spark, d).select("file_id", "person_id"), _tags(spark, d)
    m = browse.not_hidden(_files(spark, d, "id", "present", "hidden"))
    few = lambda c: F.when(c % 5 == 0, F.when(c == 10, 10).otherwise(5)).cast("long")
    # Person 10 counts as one of both: it stands under its own number and under 5.
    faces = f.select("file_id", few(F.col("person_id")).alias("person_id")).unionByName(f.where("person_id = 10").withColumn("person_id", F.lit(5).cast("long")))
    tags = t.select(few(F.col("entity_id")).alias("entity_id"), "file_id").unionByName(t.where("entity_id = 10").select(F.lit(5).cast("long").alias("entity_id"), "file_id"))
    return browse.with_people(m, faces, tags, [5, 10]).select("id")


@query(f"""WITH {_MADE} SELECT 'person' AS option, id, name AS value FROM per WHERE trim(name) <> '' AND id IN (SELECT person_id FROM fa JOIN shown ON shown.id = file_id)
UNION ALL SELECT 'any_people', NULL, (SELECT count(*) > 0 FROM fa JOIN shown ON shown.id = file_id)::varchar UNION ALL SELECT 'any_animals', NULL, (SELECT count(*) > 0 FROM an JOIN shown ON shown.id = file_id)::varchar""")
def people_options(spark, d):
    return browse.people_options(_persons(spark), _faces(spark, d), _animals(spark, d), _files(spark, d, "id", "present", "hidden"))


@query(f"""WITH {_MADE}, m AS (SELECT person_id AS merge_id, list(id) AS ids FROM fa WHERE person_id IS NOT NULL GROUP BY 1), u AS (SELECT merge_id, unnest(ids) AS id FROM m)
SELECT merge_id, count(DISTINCT file_id) AS photos FROM u JOIN fa USING (id) GROUP BY 1""")
def merge_photos(spark, d):
    f = _faces(spark, d)
    m = f.where("person_id IS NOT NULL").groupBy(F.col("person_id").alias("merge_id")).agg(F.collect_list("id").alias("ids"))
    return entities.merged_photos(m, f, "person_id")


@query(f"""WITH {_MADE}, l AS (SELECT DISTINCT * FROM face_links) SELECT least(a.person_id, b.person_id) AS group_a, greatest(a.person_id, b.person_id) AS group_b, lower(trim(kind)) AS kind, count(*) AS answers
FROM l JOIN fa a ON a.id = face_a JOIN fa b ON b.id = face_b WHERE a.person_id IS NOT NULL AND b.person_id IS NOT NULL GROUP BY ALL""")
def link_groups(spark, d):
    m = _faces(spark, d).where("person_id IS NOT NULL").select("id", F.col("person_id").alias("group_id"))
    return entities.linked_groups(table(spark, d, "face_links").distinct(), m)


@query("SELECT face_a AS id FROM face_links UNION SELECT face_b FROM face_links")
def link_ends(spark, d):
    return entities.link_ends(table(spark, d, "face_links"))


_OVER = "greatest(least(x.box_x + x.box_w, y.box_x + y.box_w) - greatest(x.box_x, y.box_x), 0) * greatest(least(x.box_y + x.box_h, y.box_y + y.box_h) - greatest(x.box_y, y.box_y), 0)"


_WIDE = "ax AS (SELECT id, file_id, det_score, box_x - 1500 AS box_x, box_y - 1500 AS box_y, box_w + 3000 AS box_w, box_h + 3000 AS box_h FROM an)"


def _wide(a):
    """Boxes grown on all sides, so that some meet."""
    return a.withColumns({"box_x": F.col("box_x") - 1500, "box_y": F.col("box_y") - 1500, "box_w": F.col("box_w") + 3000, "box_h": F.col("box_h") + 3000})


@query(f"""WITH {_MADE}, {_WIDE}, h AS (SELECT x.id, min(y.id) AS animal_id FROM fa x JOIN ax y USING (file_id) WHERE {_OVER} / greatest(1, x.box_w * x.box_h)::double >= 0.6 GROUP BY 1)
SELECT h.* FROM h WHERE NOT EXISTS (SELECT 1 FROM fa x JOIN fa y ON x.file_id = y.file_id WHERE x.id = h.id AND y.not_person = 1 AND {_OVER} / greatest(1, x.box_w * x.box_h)::double >= 0.6)""")
def faces_vetoed(spark, d):
    """Faces in animals and not in persons (J16); faces ruled out by hand stand in for the person boxes."""
    box = [f"box_{k}" for k in "xywh"]
    f = _faces(spark, d, *box)
    return clusters.vetoed_faces(f, _wide(_animals(spark, d, *box)), f.where("not_person = 1"), 0.6)


@query(f"""WITH {_MADE}, {_WIDE} SELECT DISTINCT x.id FROM ax x JOIN fa y USING (file_id) WHERE {_OVER} / greatest(1, x.box_w * x.box_h + y.box_w * y.box_h - {_OVER})::double >= 0.002 AND y.det_score > x.det_score""")
def animals_that_are_people(spark, d):
    box = [f"box_{k}" for k in "xywh"]
    return clusters.human_animals(_wide(_animals(spark, d, *box)), _faces(spark, d, *box), 0.002, outscored=True)


@query()
def boxes_found_again(spark, d):
    """Faces matched to shifted boxes of a new model."""
    f = _faces(spark, d, *[f"box_{k}" for k in "xywh"]).withColumn("frame_offset", F.lit(None).cast("double"))
    new = f.withColumn("box_x", F.col("box_x") + F.col("id") % 3).withColumn("id", F.col("id") + 10_000_000)
    return matching.found_again(f, new)


@query("""WITH RECURSIVE a AS (SELECT DISTINCT ON (id) id, file_id, CASE WHEN NOT isnan(det_score) THEN det_score END AS q, embedding::double[] AS e FROM faces),
x AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY q DESC NULLS LAST, id) AS r FROM a WHERE len(e) = 128 AND len(list_filter(e, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(e, lambda v: v <> 0)) > 0),
o AS (SELECT m.id, list(n.id) AS near FROM x m JOIN x n ON m.file_id IS NOT DISTINCT FROM n.file_id AND m.id <> n.id AND list_cosine_similarity(m.e, n.e) >= 0.75 GROUP BY 1),
s AS (SELECT file_id, 1 AS k, [id] AS kept FROM x WHERE r = 1 UNION ALL
      SELECT s.file_id, k + 1, CASE WHEN list_has_any(kept, coalesce(o.near, [])) THEN kept ELSE list_append(kept, x.id) END FROM s JOIN x ON x.file_id IS NOT DISTINCT FROM s.file_id AND x.r = s.k + 1 LEFT JOIN o ON o.id = x.id)
SELECT unnest(kept) AS id FROM (SELECT kept FROM s QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY k DESC) = 1) UNION ALL SELECT id FROM a WHERE id NOT IN (SELECT id FROM x)""")
def collapsed_views(spark, d):
    """Faces of each file that are no other view of a better one."""
    return clusters.collapse(_rec(spark, d, "faces", "id", "file_id", "det_score", "embedding").withColumnRenamed("det_score", "quality"), 128)


@query(f"""WITH {_MADE}, t AS (SELECT file_id, id % 4 AS turns, count(*) AS n FROM fa WHERE file_id IS NOT NULL GROUP BY ALL), p AS (SELECT file_id, id % 4 AS turns, max(box_w * box_h)::double AS area FROM an WHERE file_id IS NOT NULL AND box_w IS NOT NULL AND box_h IS NOT NULL GROUP BY ALL),
b AS (SELECT file_id, arg_max(turns, n * 10 - turns) AS t, max(n) AS n FROM t GROUP BY 1), q AS (SELECT file_id, (array_agg(turns ORDER BY area DESC, turns))[1] AS t, max(area) AS area, coalesce(max(CASE WHEN turns = 0 THEN area END), 0) AS flat FROM p GROUP BY 1)
SELECT file_id, CASE WHEN b.n >= 2 THEN b.t WHEN q.area > 1.2 * flat THEN q.t ELSE 0 END::bigint AS turns FROM b FULL JOIN q USING (file_id)""")
def rotations(spark, d):
    """Turns by most faces or by the largest box (V10); faces and animals stand at a turn that their id tells."""
    f = _faces(spark, d).where("file_id IS NOT NULL").groupBy("file_id", (F.col("id") % 4).alias("turns")).agg(F.count("*").alias("n"))
    a = _animals(spark, d, "box_w", "box_h").where("file_id IS NOT NULL AND box_w IS NOT NULL AND box_h IS NOT NULL").groupBy("file_id", (F.col("id") % 4).alias("turns")).agg(F.max(F.col("box_w") * F.col("box_h")).cast("double").alias("area"))
    return clusters.rotation(f, a, quorum=2).select("file_id", F.col("turns").cast("long").alias("turns"))


@query(f"WITH {_MADE} SELECT n.id, n.file_id, rel_path FROM fa n JOIN f ON f.id = n.file_id WHERE not_person = 1 AND f.present = 1 AND f.hidden = 0 ORDER BY n.det_score DESC NULLS LAST, n.id LIMIT 120")
def review_page(spark, d):
    n = _faces(spark, d).where("not_person = 1").withColumn("confidence", F.col("det_score"))
    return details.nonhuman_review(n, _files(spark, d, "id", "rel_path", "present", "hidden")).select("id", "file_id", "rel_path")


@query(f"WITH {_MADE} SELECT tg.file_id, entity_id, coalesce(per.name, tg.name) AS name FROM tg LEFT JOIN per ON per.id = entity_id AND per.id % 2 = 0")
def item_tags(spark, d):
    return details.item_tags(_tags(spark, d), _persons(spark).where("id % 2 = 0"))


@query(f"WITH {_MADE} SELECT person_id, (array_agg(id ORDER BY coalesce(det_score, -1) DESC, id))[1] AS rep FROM fa WHERE person_id IS NOT NULL GROUP BY 1")
def representatives(spark, d):
    return edits.representative(_faces(spark, d), "person_id")


@query(f"""WITH {_MADE}, g AS (SELECT pet_id AS id, species, count(*) AS n, max(coalesce(det_score, -1)) AS s FROM an GROUP BY ALL)
SELECT i AS id, (SELECT (array_agg(species ORDER BY n DESC, s DESC))[1] FROM g WHERE g.id = i) AS species, (SELECT (array_agg(an.id ORDER BY coalesce(det_score, -1) DESC, an.id))[1] FROM an WHERE pet_id = i) AS cover_detection_id,
(SELECT count(*) FROM an WHERE pet_id = i) AS detection_count FROM range(45) t(i)""")
def pets_refreshed(spark, d):
    p = spark.range(45).select("id", F.lit("?").alias("species"), F.lit(None).cast("long").alias("cover_detection_id"), F.lit(9).cast("long").alias("detection_count"))
    return edits.refresh_pets(p, _animals(spark, d))


@query(f"""WITH {_MADE}, c AS (SELECT person_id AS id, count(*) AS face_count FROM fa WHERE person_id IS NOT NULL GROUP BY 1), r AS (SELECT person_id, id AS face_id, row_number() OVER (PARTITION BY person_id ORDER BY det_score DESC NULLS LAST, id) AS rank FROM fa WHERE person_id IS NOT NULL)
SELECT person_id, face_count, face_id, rank FROM c JOIN r ON r.person_id = c.id WHERE rank <= 8""")
def montage(spark, d):
    f = _faces(spark, d)
    p = f.where("person_id IS NOT NULL").groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("face_count"))
    return details.montage(p, f).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_MADE}, o AS (SELECT id % 7 AS cluster, person_id AS old_id, count(*) AS shared FROM fa WHERE person_id IS NOT NULL GROUP BY ALL) SELECT cluster, 'Person ' || (array_agg(old_id ORDER BY shared DESC, old_id))[1] AS name FROM o GROUP BY 1""")
def names_carried(spark, d):
    o = _faces(spark, d).where("person_id IS NOT NULL").groupBy((F.col("id") % 7).alias("cluster"), F.col("person_id").alias("old_id")).agg(F.count("*").alias("shared"))
    return clusters.carry_best(o.withColumn("name", F.concat(F.lit("Person "), "old_id")))


@query(f"""WITH {_MADE}, b AS (SELECT file_id, (array_agg(id ORDER BY det_score DESC NULLS LAST, id))[1] AS face_id FROM fa WHERE person_id = 10 AND file_id IS NOT NULL GROUP BY 1)
SELECT * FROM b UNION ALL SELECT DISTINCT file_id, NULL::bigint FROM tg WHERE entity_id = 10 AND file_id NOT IN (SELECT file_id FROM b)""")
def person_files(spark, d):
    return details.of_person(_faces(spark, d).where("file_id IS NOT NULL"), _tags(spark, d), 10)


# --- Places (J19, P23, W4, R3, R9, N23, A27-A29, O7, M8, M12) -------------------------------------------------------

_PL = "pl AS (SELECT DISTINCT * FROM place_clusters), k AS (SELECT count(*) AS n FROM pl), o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM pl), mem AS (SELECT o.id AS place_id, f.id AS file_id FROM f, k JOIN o ON true WHERE o.r = f.id % k.n)"


def _members(spark, d):
    """A place for every file, by its id."""
    from pyspark.sql.window import Window

    p = _rec(spark, d, "place_clusters", "id")
    r = p.withColumn("r", F.row_number().over(Window.orderBy("id")) - 1)  # ids of the small table of places
    k = p.count()
    return _files(spark, d, "id").select(F.col("id").alias("file_id"), (F.col("id") % k).alias("r")).join(r.select("r", F.col("id").alias("place_id")), "r").select("place_id", "file_id")


@query(f"WITH {_F}, {_PL} SELECT file_id, place_id, name FROM mem JOIN pl ON pl.id = place_id WHERE member_count >= 3 OR trim(name) <> '' OR pinned = 1")
def item_places(spark, d):
    return details.item_places(_members(spark, d), _rec(spark, d, "place_clusters"))


@query(f"WITH {_F}, {_PL}, g AS (SELECT f.id, pl.lat, pl.lon FROM f JOIN pl ON pl.id = f.id WHERE present = 1 AND hidden = 0 AND NOT isnan(pl.lat) AND NOT isnan(pl.lon) AND pl.lat BETWEEN -90 AND 90 AND pl.lon BETWEEN -360 AND 360) SELECT g.id, floor(round(lat, 5) * 100 + 1e-4)::bigint AS lat, floor(round(lon, 5) * 100 + 1e-4)::bigint AS lon, place_id FROM g LEFT JOIN mem ON mem.file_id = g.id")
def file_points(spark, d):
    geo = _rec(spark, d, "place_clusters", "id", "lat", "lon").where("NOT isnan(lat) AND NOT isnan(lon) AND lat BETWEEN -90 AND 90 AND lon BETWEEN -360 AND 360").withColumnRenamed("id", "file_id")
    p = details.place_points(_files(spark, d, "id", "present", "hidden"), geo, _members(spark, d))
    part = lambda c: F.floor(F.col(c) * 100 + 1e-4).cast("long")  # noqa: E731  (five places, compared to two)
    return p.withColumn("lat", part("lat")).withColumn("lon", part("lon"))


@query(f"WITH {_F}, {_PL} SELECT place_id, file_id FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY file_id) AS r FROM mem) WHERE r <= 4")
def place_first_files(spark, d):
    return details.first_members(_members(spark, d)).select("place_id", "file_id")


@query(f"""WITH {_F}, {_D}, {_PL}, m AS (SELECT place_id, file_id, (SELECT min(best_datetime) FROM d WHERE d.file_id = mem.file_id) AS dt FROM mem WHERE place_id = (SELECT min(id) FROM pl)) SELECT * FROM m ORDER BY dt NULLS LAST, file_id LIMIT 120""")
def place_page(spark, d):
    first = _rec(spark, d, "place_clusters", "id").agg(F.min("id")).first()[0]
    return details.place_members(_members(spark, d), _dates(spark, d), first).select("place_id", "file_id", "dt")


@query(f"WITH {_POINTS} SELECT floor(lon * 100 / 54 + 0.5)::bigint AS bx, floor(lat * 100 / 54 + 0.5)::bigint AS by, count(*) AS places, round(avg(lat), 4) AS lat, round(avg(lon), 4) AS lon FROM p GROUP BY 1, 2")
def map_buckets(spark, d):
    b = entities.map_buckets(_points(spark, d).withColumn("member_count", F.lit(1)), 100.0)
    return b.select("bx", "by", "places", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


@query(f"WITH {_F}, {_PL} SELECT pl.id, (SELECT count(*) FROM mem WHERE place_id = pl.id) AS member_count FROM pl")
def places_recounted(spark, d):
    return edits.recount(_rec(spark, d, "place_clusters", "id"), _members(spark, d), "place_id", "member_count")


@query(f"WITH {_POINTS}, x AS (SELECT id, lat, lon FROM p), y AS (SELECT 40.0::double AS lat, -3.0::double AS lon), m AS (SELECT max({_NEAR}) AS s FROM x, y) SELECT round(s, 2) AS span_m, s > 20000 AS wide FROM m")
def merge_span(spark, d):
    return edits.merge_preview(_points(spark, d), (40.0, -3.0)).withColumn("span_m", F.round("span_m", 2))


@query(f"""WITH {_POINTS}, r AS (SELECT i AS region_id, (i // 36) * 10 - 90 AS s, (i % 36) * 10 - 180 AS w FROM range(648) t(i))
SELECT id, region_id FROM p JOIN r ON CASE WHEN region_id % 2 = 1 THEN lat >= s AND lat < s + 10 AND lon >= w AND lon < w + 10 ELSE abs(lat - s - 5) + abs(lon - w - 5) < 5 END""")
def regions_of_places(spark, d):
    """Which of 648 squares and diamonds each place lies in (problem 5's second form)."""
    r = spark.range(648).withColumn("s", F.floor(F.col("id") / 36) * 10 - 90.0).withColumn("w", F.col("id") % 36 * 10 - 180.0)
    at = lambda y, x: F.struct((F.col("s") + y).cast("double").alias("lat"), (F.col("w") + x).cast("double").alias("lon"))
    ring = F.when(F.col("id") % 2 == 1, F.array(at(0, 0), at(0, 10), at(10, 10), at(10, 0))).otherwise(F.array(at(0, 5), at(5, 10), at(10, 5), at(5, 0)))
    return containing_region(_points(spark, d), r.select(F.col("id").alias("region_id"), ring.alias("ring")))


# --- Edits (M1-M7, M9, M13, M14, J21, R4, R12) -------------------------------------------------------------------------


@query(f"WITH {_MADE} SELECT id, CASE WHEN id = 7 THEN 'Ann' WHEN id = 9 THEN NULL ELSE name END AS name FROM per")
def person_renamed(spark, d):
    return edits.rename(edits.rename(_persons(spark), 7, " Ann "), 9, "  ")


@query(f"WITH {_MADE}, m AS (SELECT min(id) AS i FROM fa) SELECT id, CASE WHEN id = i THEN 12 ELSE person_id END::bigint AS person_id, CASE WHEN id = i THEN 'Bo' END AS manual_person FROM fa, m")
def face_reassigned(spark, d):
    f = _faces(spark, d).withColumn("manual_person", F.lit(None).cast("string"))
    return edits.reassign(f, f.agg(F.min("id")).first()[0], 12, "Bo").select("id", "person_id", "manual_person")


@query(f"""WITH {_MADE}, h AS (SELECT person_id AS p, file_id AS g FROM fa WHERE person_id IS NOT NULL AND file_id IS NOT NULL ORDER BY person_id, file_id LIMIT 1)
SELECT 'faces' AS what, count_if(person_id = p) AS n FROM fa, h GROUP BY p, g UNION ALL SELECT 'left', count_if(person_id = p AND (file_id IS NULL OR file_id <> g)) FROM fa, h UNION ALL SELECT 'apart', count_if(person_id = p AND file_id = g AND id <> 0) FROM fa, h""")
def file_detached(spark, d):
    f = _faces(spark, d)
    p, g = f.where("person_id IS NOT NULL AND file_id IS NOT NULL").orderBy("person_id", "file_id").select("person_id", "file_id").first()
    none = table(spark, d, "face_links").select("face_a", "face_b", "kind", "created_at").where("false")
    left, apart = edits.detach(f, none, p, g, 0, "2024-01-01 00:00:00")
    one = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return one(f.where(F.col("person_id") == p), "faces").unionByName(one(left.where(F.col("person_id") == p), "left")).unionByName(one(apart, "apart"))


@query(f"WITH {_MADE}, t AS (SELECT entity_id, file_id FROM tg UNION SELECT 3, 7) SELECT * FROM t WHERE NOT (entity_id = 10 AND file_id = 10)")
def tags_edited(spark, d):
    return edits.untag(edits.tag(edits.tag(_tags(spark, d), 3, "Person 3", 7), 3, "Person 3", 7), 10, 10).select("entity_id", "file_id")


@query(f"WITH {_MADE} SELECT id, CASE WHEN person_id = 20 THEN NULL ELSE person_id END::bigint AS person_id, CASE WHEN person_id = 20 THEN 1 ELSE not_person END::bigint AS not_person, CASE WHEN person_id = 20 THEN 'statue' END AS nonhuman_kind FROM fa")
def person_hidden(spark, d):
    f = _faces(spark, d).withColumn("nonhuman_kind", F.lit(None).cast("string"))
    return edits.hide_person(f, 20, "statue").select("id", "person_id", "not_person", "nonhuman_kind")


@query(f"""WITH {_MADE}, c AS (SELECT person_id, count(*) AS n FROM fa GROUP BY 1), s AS (SELECT per.id FROM per LEFT JOIN c ON c.person_id = per.id WHERE per.id IN (5, 8) ORDER BY coalesce(n, 0) DESC, per.id LIMIT 1)
SELECT person_id, count(*) AS faces FROM (SELECT CASE WHEN person_id IN (5, 8) THEN (SELECT id FROM s) ELSE person_id END AS person_id FROM fa) GROUP BY 1""")
def persons_merged(spark, d):
    """Persons 5 and 8, neither named, in one: the one with more faces stays (M6, M7)."""
    f = _faces(spark, d)
    p = edits.recount(_persons(spark), f.where("person_id IS NOT NULL"), "person_id", "face_count")
    return edits.merge(p, f, "person_id", 5, 8, ["face_count"])[1].groupBy("person_id").agg(F.count("*").alias("faces"))


@query("""WITH l AS (SELECT DISTINCT face_a, face_b, kind, created_at FROM face_links), m AS (SELECT least(face_a, face_b) AS a, greatest(face_a, face_b) AS b FROM l WHERE face_a <> face_b ORDER BY created_at, face_a, face_b LIMIT 1)
SELECT count(*) AS answers, count_if(least(face_a, face_b) = a AND greatest(face_a, face_b) = b) AS about, (SELECT 1)::bigint AS apart FROM (SELECT l.* FROM l, m WHERE NOT (least(face_a, face_b) = a AND greatest(face_a, face_b) = b) UNION ALL SELECT a, b, 'different', TIMESTAMP '2024-01-01' FROM m), m""")
def merge_taken_back(spark, d):
    """A merge of persons undone: "same" between its two faces gives way to "different" (M9, M13)."""
    l = table(spark, d, "face_links").select("face_a", "face_b", "kind", "created_at").distinct()
    log = l.where("face_a <> face_b").orderBy("created_at", "face_a", "face_b").limit(1).select(F.lit(1).cast("long").alias("id"), F.col("face_a").alias("link_a"), F.col("face_b").alias("link_b"))
    left, _ = edits.unmerge_linked(l, log, 1, "2024-01-01 00:00:00")
    about = F.broadcast(log.select(F.least("link_a", "link_b").alias("a"), F.greatest("link_a", "link_b").alias("b")))
    it = (F.least("face_a", "face_b") == F.col("a")) & (F.greatest("face_a", "face_b") == F.col("b"))
    return left.crossJoin(about).agg(F.count("*").alias("answers"), F.count_if(it).alias("about"), F.count_if(it & (F.col("kind") == "different")).alias("apart"))


@query(f"""WITH {_MADE}, r AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM fa WHERE not_person = 1 AND id % 3 = 0) SELECT (SELECT count(*) FROM fa WHERE not_person = 0) + (SELECT count(*) FROM r) AS faces,
(SELECT max(id) FROM fa WHERE not_person = 0) + (SELECT count(*) FROM r) AS last_face, (SELECT count(*) FROM r) AS human, (SELECT count(*) FROM fa WHERE not_person = 1 AND id % 3 = 1) AS confirmed""")
def reviews_applied(spark, d):
    """Candidates that a reviewer takes for faces become faces again."""
    f = _faces(spark, d).select("id", "file_id", "det_score", F.lit("v").alias("embedding"), "not_person")
    n = f.where("not_person = 1").select("id", "file_id", "det_score", "embedding", F.lit(None).cast("string").alias("review_status"), F.lit(None).cast("long").alias("restored_face_id"))
    v = n.select("id", F.when(F.col("id") % 3 == 0, "human").when(F.col("id") % 3 == 1, "confirmed").otherwise("perhaps").alias("verdict"))
    faces, marked = edits.restore_faces(f.where("not_person = 0").drop("not_person"), n, v, "2024-01-01 00:00:00")
    a = faces.agg(F.count("*").alias("faces"), F.max("id").alias("last_face"))
    return a.crossJoin(marked.agg(F.count_if(F.col("review_status") == "human").alias("human"), F.count_if(F.col("review_status") == "confirmed").alias("confirmed")))


@query(f"""WITH {_MADE}, e AS (SELECT name, min(id) + 1000 AS now FROM per WHERE trim(name) <> '' AND id % 2 = 0 GROUP BY 1) SELECT DISTINCT coalesce(now, entity_id) AS entity_id, file_id FROM tg LEFT JOIN e USING (name)""")
def tags_repaired(spark, d):
    e = _persons(spark).where("id % 2 = 0").select((F.col("id") + 1000).alias("id"), "name")
    return edits.repair_tags(_tags(spark, d), e).select("entity_id", "file_id")


# --- The incremental side (S5-S9, S31, F9, F10, T3, T6, T8-T10, T12, A12, A26, F14) ----------------------------------------

_WALK = f"{_F}, w AS (SELECT root_id, rel_path, CASE WHEN id % 7 = 0 THEN coalesce(size, 0) + 1 ELSE size END AS size, CASE WHEN id % 11 = 0 THEN 5e9 ELSE mtime END AS mtime, id FROM f WHERE id % 13 <> 0)"


def _walk(f):
    i = F.col("id")
    return f.where(i % 13 != 0).select("root_id", "rel_path", F.when(i % 7 == 0, F.coalesce("size", F.lit(0)) + 1).otherwise(F.col("size")).alias("size"), F.when(i % 11 == 0, 5e9).otherwise(F.col("mtime")).alias("mtime"))


@query(f"""WITH {_WALK}, j AS (SELECT w.*, coalesce(w.size = f.size AND abs(w.mtime - f.mtime) < 1e-6 AND f.fast_hash IS NOT NULL, false) AS same FROM w LEFT JOIN f USING (root_id, rel_path))
SELECT coalesce(abs(5e9 + 0.5 - mtime) < 1.0, false) AS arriving, count(*) AS files FROM j WHERE NOT same AND mtime IS NOT NULL AND NOT isnan(mtime) GROUP BY 1""")
def files_to_read(spark, d):
    f = _files(spark, d, "id", "root_id", "rel_path", "size", "mtime", "fast_hash")
    now, late = snapshots.to_read(_walk(f).where("mtime IS NOT NULL AND NOT isnan(mtime)"), f, 5e9 + 0.5)
    one = lambda t, a: t.agg(F.count("*").alias("files")).select(F.lit(a).alias("arriving"), "files")
    return one(now, False).unionByName(one(late, True)).where("files > 0")


@query(f"""WITH {_WALK}, a AS (SELECT count(*) AS n FROM range(500)) SELECT count(*) + 500 AS files, count_if(id % 13 <> 0) + 500 AS present, max(id) + 500 AS last_id, sum(CASE WHEN id % 13 <> 0 AND id % 7 = 0 THEN coalesce(size, 0) + 1 ELSE size END)::bigint + 500 AS bytes FROM f""")
def catalogue_rescanned(spark, d):
    """A whole walk over the catalogue: seen files updated, missing ones marked, 500 new ones numbered."""
    f = _files(spark, d, "id", "root_id", "rel_path", "size", "mtime", "fast_hash", "first_seen", "last_seen", "present", "hidden")
    new = spark.range(500).select(F.lit(1).cast("long").alias("root_id"), F.concat(F.lit("new/"), "id").alias("rel_path"), F.lit(1).cast("long").alias("size"), F.lit(1.0).alias("mtime"))
    w = _walk(f).unionByName(new).withColumn("fast_hash", F.lit("h"))
    r = snapshots.rescan(f, w, "2024-01-01")
    return r.agg(F.countDistinct("id").alias("files"), F.sum("present").alias("present"), F.max("id").alias("last_id"), F.sum("size").alias("bytes"))


@query(f"""WITH {_F}, u AS (SELECT id, 'new' AS ext FROM f WHERE id % 9 = 0 UNION ALL SELECT id + 100000000, 'added' FROM f WHERE id % 50 = 0) SELECT coalesce(ext, '?') AS ext, count(*) AS files FROM (SELECT id, ext FROM f WHERE id NOT IN (SELECT id FROM u) UNION ALL SELECT * FROM u) GROUP BY 1""")
def rows_upserted(spark, d):
    """Rows in place of older ones, of several the latest version."""
    f = _files(spark, d, "id", "ext")
    new = f.where("id % 9 = 0").select("id", F.lit("new").alias("ext"), F.lit(2).alias("v")).unionByName(f.where("id % 9 = 0").select("id", F.lit("older").alias("ext"), F.lit(1).alias("v"))).unionByName(f.where("id % 50 = 0").select((F.col("id") + 100_000_000).alias("id"), F.lit("added").alias("ext"), F.lit(1).alias("v")))
    return snapshots.upsert(f, new, "id", "v").groupBy(F.coalesce("ext", F.lit("?")).alias("ext")).agg(F.count("*").alias("files"))


_VEC = "e AS (SELECT id AS file_id, CASE WHEN id % 5 = 0 THEN 'x' ELSE sha256 END AS source_sha256, CASE WHEN id % 7 = 0 THEN NULL ELSE 'v3' END AS indexer_version, CASE WHEN id % 11 = 0 THEN 'error' WHEN id % 3 = 0 THEN 'skipped' ELSE 'indexed' END AS status FROM f WHERE id % 4 <> 0)"


def _index(f):
    i = F.col("id")
    return f.where(i % 4 != 0).select(i.alias("file_id"), F.when(i % 5 == 0, "x").otherwise(F.col("sha256")).alias("source_sha256"), F.when(i % 7 != 0, "v3").alias("indexer_version"), F.when(i % 11 == 0, "error").when(i % 3 == 0, "skipped").otherwise("indexed").alias("status"))


_OWED = "(e.file_id IS NULL OR e.source_sha256 IS DISTINCT FROM f.sha256 OR coalesce(indexer_version, '') <> 'v3')"


@query(f"""WITH {_F}, {_VEC} SELECT 'listed' AS population, count(*) AS files FROM f LEFT JOIN e ON e.file_id = f.id WHERE present = 1 AND hidden = 0 AND media_type IN ('image', 'video', 'audio', 'document') AND {_OWED}
UNION ALL SELECT 'counted', count(*) FROM f LEFT JOIN e ON e.file_id = f.id WHERE present = 1 AND hidden = 0 AND (media_type = 'image' OR ext IN ('mp4', 'mov', 'mp3', 'wav', 'pdf')) AND {_OWED}""")
def semantic_backlog(spark, d):
    """The two populations of the vector backlog."""
    f = _files(spark, d, "id", "ext", "media_type", "sha256", "present", "hidden")
    return snapshots.backlog_counts(listed=snapshots.unembedded(f, _index(f), "v3"), counted=snapshots.unembedded(f, _index(f), "v3", counted=True)).select(F.col("stage").alias("population"), F.col("pending").alias("files"))


@query(f"""WITH {_F}, {_VEC}, n AS (SELECT f.media_type, status FROM f JOIN e ON e.file_id = f.id WHERE present = 1 AND hidden = 0 AND source_sha256 = sha256 AND indexer_version = 'v3'), t AS (SELECT count(*) AS total FROM f WHERE present = 1 AND hidden = 0 AND media_type IN ('image', 'video', 'audio', 'document'))
SELECT total, (SELECT count_if(status = 'indexed') FROM n) AS indexed, (SELECT count_if(status = 'skipped') FROM n) AS skipped, (SELECT count_if(status = 'error') FROM n) AS errors, greatest(0, total - (SELECT count(*) FROM n))::bigint AS pending FROM t""")
def semantic_status(spark, d):
    f = _files(spark, d, "id", "media_type", "sha256", "present", "hidden")
    return snapshots.semantic_summary(f, _index(f), "v3")[0]


@query(f"WITH {_F}, {_VEC} SELECT f.media_type, count(*) AS files FROM f JOIN e ON e.file_id = f.id WHERE present = 1 AND hidden = 0 AND source_sha256 = sha256 AND indexer_version = 'v3' AND status = 'indexed' GROUP BY 1")
def semantic_types(spark, d):
    f = _files(spark, d, "id", "media_type", "sha256", "present", "hidden")
    return snapshots.semantic_summary(f, _index(f), "v3")[1]


@query(f"""WITH {_F}, {_D}, {_VEC} SELECT 'enrich' AS stage, count(*) AS pending FROM f WHERE present = 1 AND id NOT IN (SELECT file_id FROM d)
UNION ALL SELECT 'detect', count(*) FROM f WHERE present = 1 AND hidden = 0 AND media_type IN ('image', 'video') AND NOT EXISTS (SELECT 1 FROM e WHERE e.file_id = f.id AND e.source_sha256 IS NOT DISTINCT FROM f.sha256)
UNION ALL SELECT 'semantic', count(*) FROM f LEFT JOIN e ON e.file_id = f.id WHERE present = 1 AND hidden = 0 AND (media_type = 'image' OR ext IN ('mp4', 'mov', 'mp3', 'wav', 'pdf')) AND {_OWED}""")
def stage_backlogs(spark, d):
    """What each stage owes."""
    f = _files(spark, d, "id", "ext", "media_type", "sha256", "present", "hidden")
    return snapshots.backlog_counts(enrich=snapshots.undated(f, _dates(spark, d)), detect=snapshots.undetected(f, _index(f)), semantic=snapshots.unembedded(f, _index(f), "v3", counted=True))


@query(f"""WITH {_F}, {_VEC} SELECT (SELECT count(*) FROM f WHERE present = 1) AS covered, (SELECT max(id) FROM f WHERE present = 1) AS top, (SELECT count(*) FROM e JOIN f ON f.id = e.file_id AND f.sha256 = e.source_sha256 WHERE present = 1 AND hidden = 0) AS guarded, (SELECT count(*) FROM e WHERE file_id NOT IN (SELECT id FROM f WHERE hidden = 1)) AS kept""")
def dedup_marks(spark, d):
    """What a deduplication covered (A26, T6), outcomes that may be written (T9), vectors that stay."""
    f = _files(spark, d, "id", "sha256", "present", "hidden")
    e = _index(f)
    c = snapshots.coverage(f).select(F.col("files").alias("covered"), "top")
    return c.crossJoin(snapshots.guarded(e, f).agg(F.count("*").alias("guarded"))).crossJoin(snapshots.purge_hidden(e, f).agg(F.count("*").alias("kept")))  # one row each


@query(f"""WITH {_MADE}, b AS (SELECT id, file_id, box_x, box_y, box_w, box_h FROM fa WHERE file_id IS NOT NULL AND box_x IS NOT NULL AND box_y IS NOT NULL AND box_w IS NOT NULL AND box_h IS NOT NULL)
SELECT id, CASE WHEN file_id % 2 = 1 THEN 'seen' WHEN id % 3 = 0 THEN NULL ELSE 'seen' END AS review FROM b""")
def detections_rewritten(spark, d):
    """Detections of half of the files found anew; a review stays with a box that is where it was."""
    box = [f"box_{k}" for k in "xywh"]
    old = _faces(spark, d, *box).select("id", "file_id", *box).na.drop().withColumn("review", F.lit("seen"))
    again = F.when(F.col("id") % 3 == 0, F.col("box_x") + 100_000 + F.col("id")).otherwise(F.col("box_x"))
    new = old.where("file_id % 2 = 0").withColumn("box_x", again).withColumn("review", F.lit(None).cast("string"))
    return snapshots.rewrite(old, new, ["review"]).select("id", "review")


@query(rf"WITH {_F}, s AS (SELECT id, root_id, regexp_replace(rel_path, '/?[^/]*$', '') AS folder FROM f WHERE present = 1 AND hidden = 0) SELECT id, folder, count(*) OVER (PARTITION BY root_id, folder) - 1 AS folder_count FROM s")
def folder_neighbours(spark, d):
    return browse.neighbours(_files(spark, d, "id", "root_id", "rel_path", "present", "hidden"))


@query(rf"WITH {_F}, c AS (SELECT min(regexp_replace(rel_path, '/?[^/]*$', '')) AS folder FROM f WHERE root_id = 1 AND regexp_matches(rel_path, '/')) SELECT id FROM f, c WHERE present = 1 AND hidden = 0 AND root_id = 1 AND regexp_replace(rel_path, '/?[^/]*$', '') = folder")
def folder_page(spark, d):
    f = _files(spark, d, "id", "root_id", "rel_path", "present", "hidden")
    folder = f.where("root_id = 1 AND rel_path LIKE '%/%'").agg(F.min(F.regexp_replace("rel_path", "/?[^/]*$", ""))).first()[0]
    return browse.folder_page(f, 1, folder or "").select("id")


@query(f"""WITH {_F}, {_VEC}, {_PL}, g AS (SELECT id FROM pl WHERE lat IS NOT NULL) SELECT f.id, f.id IN (SELECT id FROM g) AS has_gps FROM f WHERE present = 1 AND hidden = 0 AND EXISTS (SELECT 1 FROM e WHERE e.file_id = f.id AND e.source_sha256 = f.sha256 AND status = 'indexed')""")
def browse_indexed(spark, d):
    """Visible files with a vector, and whether they have a position."""
    f = _files(spark, d, "id", "sha256", "present", "hidden")
    geo = _rec(spark, d, "place_clusters", "id", "lat").withColumnRenamed("id", "file_id")
    return browse.only(browse.flagged(browse.not_hidden(f), geo, _index(f)), indexed=True).select("id", "has_gps")


@query(f"WITH {_F}, {_PL} SELECT media_type, count(*) AS files, count_if(id IN (SELECT id FROM pl WHERE lat IS NOT NULL)) AS located FROM f WHERE present = 1 GROUP BY 1")
def located_files(spark, d):
    return browse.located(_files(spark, d, "id", "media_type", "present"), _rec(spark, d, "place_clusters", "id", "lat").withColumnRenamed("id", "file_id"))


@query(f"""WITH {_F}, {_VEC}, r AS (SELECT root_id, max(id) - 50 AS m FROM f WHERE root_id % 2 = 0 GROUP BY 1)
SELECT f.id, f.id IN (SELECT file_id FROM faces WHERE file_id IS NOT NULL) AS people, f.id IN (SELECT file_id FROM animal_detections WHERE file_id IS NOT NULL) AS pets, f.id IN (SELECT file_id FROM doc_text WHERE file_id IS NOT NULL) AS text,
f.id IN (SELECT file_id FROM e) AS semantic, coalesce(sha256 IS NOT NULL AND f.id <= m, false) AS duplicates FROM f LEFT JOIN r USING (root_id)""")
def stages_seen(spark, d):
    """Which of the five stages have looked at each file."""
    f = _files(spark, d, "id", "root_id", "sha256")
    runs = f.where("root_id % 2 = 0").groupBy("root_id").agg((F.max("id") - 50).alias("covered_max_file_id"))
    t = lambda n: table(spark, d, n, "file_id")
    return details.coverage_flags(f, people=t("faces"), pets=t("animal_detections"), text=t("doc_text"), semantic=_index(f).select("file_id"), duplicates=snapshots.compared(f, runs))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'R' THEN greatest(120.0, least(300.0, 10.0 * pow(1.5, l_linenumber * 2))) ELSE least(300.0, 10.0 * pow(1.5, l_linenumber * 2)) END, 6)::double AS wait,
5 * l_linenumber - (l_quantity::int % 7) >= 1.5 AND 5 * l_linenumber - (l_quantity::int % 3) >= 12 AND (l_quantity::int % 7) > (l_quantity::int % 3) AS due FROM lineitem""")
def scheduler_rules(spark, d):
    """How long to wait for work (T14) and when to act on a hint."""
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").select(
        "l_orderkey", "l_linenumber", F.round(snapshots.next_wait(n * 2, F.col("l_returnflag") == "R"), 6).alias("wait"), snapshots.hint_due(q % 7, q % 3, n * 5).alias("due"),
    )


@query("""WITH r AS (SELECT DISTINCT root_id, path, zone_name FROM root_zones), m AS (SELECT max(root_id) AS m FROM r), f AS (SELECT min(path) AS p FROM r)
SELECT root_id, path, CASE WHEN path = p THEN 'Asia/Tokyo' ELSE zone_name END AS zone_name FROM r, f UNION ALL SELECT m + 1, p || '/inner', 'UTC' FROM m, f""")
def archives_registered(spark, d):
    """One archive configured anew and one added."""
    r = table(spark, d, "root_zones").dropDuplicates(["root_id"])
    first = r.agg(F.min("path")).first()[0]
    return edits.register(edits.register(r, first, "Asia/Tokyo", "2024-01-01"), first + "/inner/", "UTC", "2024-01-01").select("root_id", "path", "zone_name")


@query(f"""WITH {_F}, r AS (SELECT DISTINCT root_id, path FROM root_zones) SELECT CASE WHEN root_id IN (SELECT root_id FROM r) AND root_id % 2 = 0 THEN root_id + 1000 ELSE root_id END AS root_id, count(*) AS files FROM f GROUP BY 1""")
def roots_reconciled(spark, d):
    """Files of archives that the registry knows under other ids."""
    r = table(spark, d, "root_zones", "root_id", "path").distinct()
    registry = r.select(F.when(F.col("root_id") % 2 == 0, F.col("root_id") + 1000).otherwise(F.col("root_id")).alias("root_id"), "path")
    return edits.reconcile_roots(_files(spark, d, "id", "root_id"), r, registry).groupBy("root_id").agg(F.count("*").alias("files"))


@query(f"""WITH {_MADE}, {_PL}, t AS (SELECT file_id, count(DISTINCT name) AS n FROM tg GROUP BY 1), x AS (SELECT DISTINCT ON (file_id) * FROM doc_text ORDER BY file_id, extracted_at DESC)
SELECT f.id, d.best_datetime, (SELECT count(*) FROM fa WHERE fa.file_id = f.id) AS faces, coalesce(t.n, 0)::bigint AS tags, CASE WHEN member_count >= 3 OR trim(pl.name) <> '' OR pinned = 1 THEN place_id END AS place_id, x.status
FROM f LEFT JOIN d ON d.file_id = f.id LEFT JOIN t ON t.file_id = f.id LEFT JOIN mem ON mem.file_id = f.id LEFT JOIN pl ON pl.id = mem.place_id LEFT JOIN x ON x.file_id = f.id""")
def item_records(spark, d):
    """Everything about each file in one nested row."""
    from kestrel.catalog import _current

    box = [f"box_{k}" for k in "xywh"]
    c = _candidates(spark, d)
    tags = details.item_tags(_tags(spark, d), _persons(spark).where("false"))
    places = details.item_places(_members(spark, d), _rec(spark, d, "place_clusters"))
    r = details.item_record(_files(spark, d, "id"), _dates(spark, d), _faces(spark, d, *box), _animals(spark, d, *box), dups.membership(c, dups.groups(c)), tags, places, _current(spark, d))
    return r.select("id", "date.best_datetime", F.size("faces").cast("long").alias("faces"), F.size("tags").cast("long").alias("tags"), "place.place_id", "text.status")


@query(rf"WITH {_F} SELECT id, substr(c, 1, 2) || '/' || c || '_grid_320.jpg' AS key FROM (SELECT id, {_HASH} AS c FROM f) WHERE regexp_matches(c, '^[0-9a-f]{{64}}$')")
def thumbnail_keys(spark, d):
    from kestrel.functions.clean import content_hash

    return _files(spark, d, "id", "sha256").select("id", details.thumbnail_key(content_hash("sha256"), "grid", 320).alias("key")).where("key IS NOT NULL")


@query("""SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: least(255.0, greatest(0.0, round(x * 100 + 128))))), 4) AS brightness FROM embeddings""")
def picture_measures(spark, d):
    """Brightness and hash of small pictures made of all stored vectors (N4, N13); rows of 8."""
    from kestrel.functions.images import face_quality, phash

    grey = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round(x * 100 + 128))))
    t = table(spark, d, "embeddings", "vec_id", "embedding").withColumn("grey", grey)
    q = t.withColumn("q", face_quality("grey", F.lit(8), F.lit(80.0))).withColumn("p", phash(F.flatten(F.array_repeat("grey", 1))))
    return q.where("q.quality BETWEEN 0 AND 1").select("vec_id", F.round("q.brightness", 4).alias("brightness"))


# --- Searches end to end (V3, V5, O3, X2, X4, X5, J14, R1, R2, R8, J22) --------------------------------------------------------


@query(f"""WITH {_F}, {_D}, {_U}, q AS (SELECT e AS q FROM u WHERE vec_id = 7), s AS (SELECT vec_id AS id, list_cosine_similarity(e, q) AS score FROM u, q), m AS (SELECT s.id, score, best_datetime FROM s JOIN f ON f.id = s.id LEFT JOIN d ON d.file_id = f.id WHERE present = 1 AND hidden = 0 AND score >= 0.02),
k AS (SELECT *, max(score) OVER () AS best FROM m), r AS (SELECT * FROM k WHERE best <= 0 OR score >= 0.15 * best) SELECT id, best_datetime, round(score, 4) AS score, (SELECT count(*) FROM r) AS total FROM r ORDER BY best_datetime DESC NULLS LAST, id LIMIT 120""")
def semantic_newest(spark, d):
    """A description search with filters, both cuts, a sort by date and a page (V3, O3); a vector's number is its file's."""
    m = browse.media(_files(spark, d, "id", "present", "hidden"), _dates(spark, d)).select("id", "best_datetime")
    s = search.score(table(spark, d, "embeddings", "vec_id", "embedding"), [(_query_vector(spark, d), 0.0)])
    return details.semantic_page(s, m, 0.02, 0.15, "newest").select("id", "best_datetime", "score", "total")


@query(f"""WITH {_U}, s AS (SELECT x.vec_id AS q, y.vec_id AS id, list_cosine_similarity(x.e, y.e) AS score FROM u x JOIN u y ON x.vec_id % 20 = 0 AND y.vec_id % 20 <> 0)
SELECT q, id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS r FROM s) WHERE r <= 20""")
def nearest_members(spark, d):
    """Of some vectors the nearest among the others."""
    v = table(spark, d, "embeddings", "vec_id", "embedding").withColumnRenamed("vec_id", "id")
    width = len(_query_vector(spark, d))
    return search.nearest_members(v.where("id % 20 = 0"), v.where("id % 20 <> 0"), width, 20).withColumn("score", F.round("score", 5))


@query(r"""WITH c AS (SELECT DISTINCT id, text FROM doc_chunk_fts), w AS (SELECT id, unnest(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+')) AS term FROM c) SELECT term, id, count(*) AS tf FROM w WHERE regexp_matches(term, '^[a-z0-9]+$') GROUP BY ALL""")
def word_postings(spark, d):
    return search.postings(_rec(spark, d, "doc_chunk_fts", "id", "file_id", "ordinal", "text"))[0].where(F.col("term").rlike("^[a-z0-9]+$"))


@query(r"""WITH c AS (SELECT DISTINCT id, file_id, ordinal, text FROM doc_chunk_fts), f AS (SELECT DISTINCT id, present, hidden FROM files),
w AS (SELECT id, file_id, ordinal, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+') AS t FROM c),
n AS (SELECT id, file_id, ordinal, len(t) AS l, len(list_filter(t, lambda x: x = 'verano')) AS f0 FROM w), s AS (SELECT count(*) AS n, avg(l) AS m, count_if(f0 > 0) AS d0 FROM n),
r AS (SELECT id, file_id, ordinal, -(greatest(1e-6, ln((s.n - d0 + 0.5) / (d0 + 0.5))) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * l / m))) AS score FROM n, s WHERE f0 > 0),
b AS (SELECT file_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score, ordinal) AS k FROM r) WHERE k = 1 AND file_id IN (SELECT id FROM f WHERE present = 1 AND hidden = 0))
SELECT file_id, id, round(score, 6) AS score, (SELECT count(*) FROM b) AS total, true AS marked FROM b ORDER BY score, file_id LIMIT 120""")
def text_search_page(spark, d):
    """A text search with snippets, totals and pages."""
    c = _rec(spark, d, "doc_chunk_fts", "id", "file_id", "ordinal", "text")
    p = search.text_page(c, _files(spark, d, "id", "rel_path", "present", "hidden"), _dates(spark, d), "verano")
    return p.select("file_id", "id", F.round("score", 6).alias("score"), "total", F.lower("snippet").rlike("\x02verano\x03").alias("marked"))


@query(r"""WITH c AS (SELECT DISTINCT id, file_id, ordinal, text FROM doc_chunk_fts),
w AS (SELECT id, file_id, ordinal, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+') AS t FROM c),
n AS (SELECT id, len(t) AS l, len(list_filter(t, lambda x: x = 'verano')) AS f0, len(list_filter(t, lambda x: starts_with(x, 'fotog'))) AS f1 FROM w), s AS (SELECT count(*) AS n, avg(l) AS m, count_if(f0 > 0) AS d0, count_if(f1 > 0) AS d1 FROM n)
SELECT id, round(-(greatest(1e-6, ln((s.n - d0 + 0.5) / (d0 + 0.5))) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * l / m)) + greatest(1e-6, ln((s.n - d1 + 0.5) / (d1 + 0.5))) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / m))), 6) AS score FROM n, s WHERE f0 > 0 AND f1 > 0""")
def indexed_search(spark, d):
    """The same ranking from kept postings."""
    index, lengths = search.postings(_rec(spark, d, "doc_chunk_fts", "id", "file_id", "ordinal", "text"))
    return search.bm25_index(index, lengths, "verano fotog*").select("id", F.round("score", 6).alias("score"))


@query(rf"""WITH {_F}, h AS (SELECT *, {_HASH} AS c FROM f WHERE present = 1), g AS (SELECT c, min(id) AS group_id, count(*) AS n FROM h WHERE regexp_matches(c, '^[0-9a-f]{{64}}$') GROUP BY 1 HAVING count(*) > 1), one AS (SELECT min(group_id) AS i FROM g)
SELECT h.id, group_id, regexp_extract(rel_path, '[^/\\]*$') AS name FROM h JOIN g USING (c), one WHERE group_id = i""")
def item_duplicates(spark, d):
    """The duplicate group of one file."""
    c = _candidates(spark, d)
    g = dups.groups(c)
    first = g.agg(F.min("group_id")).first()[0]
    return details.item_duplicates(dups.membership(c, g), _files(spark, d, "id", "rel_path", "media_type"), first).select("id", "group_id", "name")


@query(f"""WITH {_MADE}, o AS (SELECT id AS file_id, (id % 4) * 90 AS rotate_deg FROM f WHERE id % 3 = 0) SELECT fa.id, fa.file_id, rel_path, coalesce(rotate_deg, 0)::bigint AS rotate_deg FROM fa JOIN f ON f.id = fa.file_id LEFT JOIN o ON o.file_id = f.id""")
def face_crops(spark, d):
    """Where to cut each face from, and how far to turn it."""
    f = _files(spark, d, "id", "root_id", "rel_path", "sha256")
    turn = f.where("id % 3 = 0").select(F.col("id").alias("file_id"), (F.col("id") % 4 * 90).alias("rotate_deg"))
    return details.crops(_faces(spark, d, *[f"box_{k}" for k in "xywh"]), details.media_source(f, turn)).select("id", "file_id", "rel_path", "rotate_deg")

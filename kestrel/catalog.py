"""All core queries by name, each over whole tables, and the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.functions.clean import epoch_micros
from kestrel.functions.numbers import cell, iou
from kestrel.functions.paths import basename, extension, filename_date, media_type
from kestrel.operators import browse, clusters, details, dups, entities, matching, people, search
from kestrel.operators.spatial import near_places
from kestrel.operators.timestamps import utc_instants
from kestrel.plans import snapshots
from kestrel.session import table
from kestrel.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _files(spark, d, *columns) -> DataFrame:
    return browse.records(table(spark, d, "files", *columns))


def _dates(spark, d) -> DataFrame:
    return table(spark, d, "dates")


def _rec(spark, d, name, *columns) -> DataFrame:
    return browse.records(table(spark, d, name, *columns))


#: Exact repeats of a row are one record, on the SQL side too.
_F = "f AS (SELECT DISTINCT * FROM files)"
_D = "d AS (SELECT DISTINCT * FROM dates)"
_HASH = r"regexp_replace(lower(regexp_replace(sha256, '\s+', '', 'g')), '^(sha-?256[:=]|0x)', '')"
_TIER = "upper(regexp_replace(trim(quality_tier), '[\\s_-]+', '_', 'g'))"


# --- Training-data problems of the core ---------------------------------------------------------------------


@query()
def p3_found(spark, d):
    return utc_instants(_dates(spark, d), table(spark, d, "files", "id", "root_id", "mtime"), table(spark, d, "root_zones"))


@query("""
WITH p AS (SELECT DISTINCT id, lat, lon FROM place_clusters WHERE member_count > 0 AND lat BETWEEN -90 AND 90 AND lon BETWEEN -360 AND 360 AND NOT (lat = 0 AND lon = 0))
SELECT a.id AS place_a, b.id AS place_b FROM p a JOIN p b ON a.id < b.id
WHERE 2 * 6371000 * asin(sqrt(least(1, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2))) <= 300""")
def p5_found(spark, d):
    return near_places(table(spark, d, "place_clusters"))


# --- Overview and browse ------------------------------------------------------------------------------------


@query(f"""WITH {_F}, {_D} SELECT count(*) AS files, coalesce(sum(size), 0)::bigint AS bytes, count(d.file_id) AS enriched, min(best_datetime) AS date_min, max(best_datetime) AS date_max
FROM f LEFT JOIN d ON d.file_id = f.id WHERE present = 1""")
def overview_summary(spark, d):
    return browse.summary(_files(spark, d, "id", "size", "present"), _dates(spark, d))


@query(f"WITH {_F} SELECT media_type, count(*) AS files, coalesce(sum(size), 0)::bigint AS bytes FROM f WHERE present = 1 GROUP BY 1")
def overview_types(spark, d):
    return browse.by_type(_files(spark, d, "id", "media_type", "size", "present"))


@query(f"""WITH {_F}, {_D} SELECT CASE WHEN d.file_id IS NULL THEN 'undated' ELSE coalesce(lower(trim(date_source)), 'unknown') END AS source, count(*) AS files
FROM f LEFT JOIN d ON d.file_id = f.id WHERE present = 1 GROUP BY 1""")
def date_sources(spark, d):
    return browse.date_sources(_files(spark, d, "id", "present"), _dates(spark, d))


@query(f"""WITH {_F}, {_D} SELECT substr(best_datetime, 1, 7) AS period, count_if(media_type = 'image') AS image, count_if(media_type = 'video') AS video, count_if(media_type = 'audio') AS audio,
count_if(media_type = 'document') AS document, count_if(media_type = 'archive') AS archive, count_if(media_type = 'other') AS other, count_if(media_type IN ('image', 'video', 'audio', 'document', 'archive', 'other')) AS total
FROM f JOIN d ON d.file_id = f.id WHERE present = 1 AND hidden = 0 AND best_datetime IS NOT NULL GROUP BY 1""")
def timeline_month(spark, d):
    return browse.timeline(browse.with_dates(browse.not_hidden(_files(spark, d, "id", "media_type", "present", "hidden")), _dates(spark, d)))


@query("""WITH c AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, o_orderpriority AS kind, count(*) AS n FROM orders GROUP BY ALL)
SELECT *, sum(n) OVER (PARTITION BY kind ORDER BY period)::bigint AS running FROM c""")
def timeline_cumulative(spark, d):
    c = table(spark, d, "orders", "o_orderdate", "o_orderpriority").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"))
    return browse.cumulative(c, "kind")


@query(f"WITH {_F}, {_D} SELECT substr(best_datetime, 1, 4) AS year, count(*) AS files FROM f JOIN d ON d.file_id = f.id WHERE best_datetime IS NOT NULL AND present = 1 GROUP BY 1")
def files_per_year(spark, d):
    m = browse.with_dates(browse.visible(_files(spark, d, "id", "present")), _dates(spark, d))
    return m.where("best_datetime IS NOT NULL").groupBy(F.substring("best_datetime", 1, 4).alias("year")).agg(F.count("*").alias("files"))


@query(f"WITH {_F} SELECT count(*) AS files, count_if(present = 1) AS present, count_if(present = 0) AS missing, count(sha256) AS hashed FROM f")
def catalogue_status(spark, d):
    return browse.status(_files(spark, d, "id", "present", "sha256"))


@query(f"""WITH {_F}, {_D}, m AS (SELECT f.id, best_datetime, media_type, rel_path, row_number() OVER (ORDER BY best_datetime DESC NULLS LAST, f.id) AS place
FROM f LEFT JOIN d ON d.file_id = f.id WHERE present = 1 AND hidden = 0) SELECT * FROM m WHERE place <= 120""")
def browse_newest(spark, d):
    m = browse.media(_files(spark, d, "id", "rel_path", "media_type", "present", "hidden"), _dates(spark, d))
    return browse.page(m.select("id", "best_datetime", "media_type", "rel_path")).withColumn("place", F.col("at").cast("long")).drop("at")


@query(f"WITH {_F} SELECT id, rel_path FROM f WHERE present = 1 AND hidden = 0 AND contains(lower(regexp_extract(rel_path, '[^/\\\\]*$')), 'img') AND contains(lower(regexp_extract(rel_path, '[^/\\\\]*$')), '07')")
def browse_name(spark, d):
    return browse.media(_files(spark, d, "id", "rel_path", "present", "hidden"), _dates(spark, d), name="IMG 07 img").select("id", "rel_path")


@query(f"""WITH {_F} SELECT id FROM f WHERE present = 1 AND hidden = 0 AND id IN (SELECT file_id FROM faces WHERE not_person = 0) AND id NOT IN (SELECT file_id FROM animal_detections WHERE file_id IS NOT NULL)""")
def browse_people_no_animals(spark, d):
    faces = table(spark, d, "faces", "file_id", "not_person").where("not_person = 0")
    return browse.media(_files(spark, d, "id", "present", "hidden"), _dates(spark, d), holding=[faces], lacking=[table(spark, d, "animal_detections", "file_id")]).select("id")


@query(f"WITH {_F} SELECT regexp_replace(rel_path, '/?[^/]*$', '') AS folder, count(*) AS files FROM f WHERE present = 1 AND hidden = 0 GROUP BY 1")
def folder_counts(spark, d):
    return browse.folders(_files(spark, d, "id", "rel_path", "present", "hidden"))


@query(f"""WITH {_F}, {_D}, m AS (SELECT * FROM f LEFT JOIN d ON d.file_id = f.id WHERE present = 1 AND hidden = 0)
SELECT 'year' AS option, substr(best_datetime, 1, 4) AS value FROM m WHERE best_datetime IS NOT NULL UNION SELECT 'type', media_type FROM m WHERE media_type IS NOT NULL""")
def filter_options(spark, d):
    return browse.filter_options(_files(spark, d, "id", "media_type", "present", "hidden"), _dates(spark, d))


@query(f"""WITH {_F} SELECT id, lower(regexp_extract(regexp_extract(rel_path, '[^/\\\\]*$'), '^.+\\.([^.]*)$', 1)) AS ext,
CASE WHEN lower(regexp_extract(rel_path, '\\.([^./\\\\]*)$', 1)) IN ('jpg', 'png', 'heic', 'tif') THEN 'image' WHEN lower(regexp_extract(rel_path, '\\.([^./\\\\]*)$', 1)) IN ('mp4', 'mov') THEN 'video'
WHEN lower(regexp_extract(rel_path, '\\.([^./\\\\]*)$', 1)) IN ('mp3', 'wav') THEN 'audio' WHEN lower(regexp_extract(rel_path, '\\.([^./\\\\]*)$', 1)) IN ('pdf', 'docx', 'odt', 'txt') THEN 'document'
WHEN lower(regexp_extract(rel_path, '\\.([^./\\\\]*)$', 1)) = 'zip' THEN 'archive' ELSE 'other' END AS kind FROM f""")
def derived_types(spark, d):
    e = extension(basename(F.col("rel_path")))
    return _files(spark, d, "id", "rel_path").select("id", e.alias("ext"), media_type(e).alias("kind"))


@query("""WITH o AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y%m%d') AS ymd, o_orderdate::date AS day, o_orderkey % 5 AS s FROM orders)
SELECT id, CASE WHEN s IN (0, 1) THEN strftime(day, '%Y-%m-%d') || ' 09:05:07' ELSE strftime(day, '%Y-%m-%d') || ' 00:00:00' END AS moment, CASE s WHEN 0 THEN 0.9 WHEN 1 THEN 0.9 WHEN 2 THEN 0.6 WHEN 3 THEN 0.55 ELSE 0.4 END::double AS confidence
FROM o WHERE year(day) BETWEEN 1990 AND 2035""")
def filename_dates(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    ymd, s = F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderkey") % 5
    name = (
        F.when(s == 0, F.concat(F.lit("IMG_"), ymd, F.lit("_090507.jpg"))).when(s == 1, F.concat(F.lit("Foto "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" at 09.05.07.jpeg")))
        .when(s == 2, F.concat(F.lit("VID-"), ymd, F.lit("-WA0012.mp4"))).when(s == 3, F.concat(F.date_format("o_orderdate", "yyyy_MM_dd"), F.lit(" trip.png"))).otherwise(F.concat(F.lit("scan"), ymd, F.lit(".tif")))
    )
    f = filename_date(name)
    return o.select(F.col("o_orderkey").alias("id"), F.date_format(f["at"], "yyyy-MM-dd HH:mm:ss").alias("moment"), f["confidence"].alias("confidence")).where("moment IS NOT NULL")


# --- Duplicates ---------------------------------------------------------------------------------------------

_RANKED = f"""{_F}, {_D}, dt AS (SELECT file_id, min(best_datetime) AS dt FROM d GROUP BY 1),
h AS (SELECT *, {_HASH} AS c FROM f), g AS (SELECT c, min(id) AS group_id FROM h WHERE present = 1 AND regexp_matches(c, '^[0-9a-f]{{64}}$') GROUP BY c HAVING count(*) > 1),
r AS (SELECT h.id, g.group_id, h.size, h.media_type, row_number() OVER w AS rank, first(h.id) OVER w AS canonical_id FROM h JOIN g USING (c) LEFT JOIN dt ON dt.file_id = h.id WHERE present = 1
      WINDOW w AS (PARTITION BY g.group_id ORDER BY coalesce(h.size, 0) DESC, (dt.file_id IS NOT NULL) DESC, dt NULLS LAST, rel_path, h.id)),
gr AS (SELECT group_id, canonical_id, count(*) AS members, coalesce(sum(CASE WHEN rank > 1 THEN greatest(size, 0) END), 0)::bigint AS redundant_bytes, 'exact' AS method FROM r GROUP BY ALL)"""


def _candidates(spark, d) -> DataFrame:
    f = _files(spark, d, "id", "rel_path", "size", "media_type", "sha256", "present")
    return dups.candidates(f, _dates(spark, d))


def _groups(spark, d) -> DataFrame:
    return dups.groups(_candidates(spark, d)).select("group_id", "canonical_id", "members", "redundant_bytes", "method")


@query(f"WITH {_RANKED} SELECT * FROM gr")
def dup_groups(spark, d):
    return _groups(spark, d)


@query(f"WITH {_RANKED} SELECT count(*) AS groups, coalesce(sum(members - 1), 0)::bigint AS copies, coalesce(sum(redundant_bytes), 0)::bigint AS bytes, (SELECT count(*) FROM f WHERE present = 1) - coalesce(sum(members - 1), 0)::bigint AS unique_files FROM gr")
def dup_summary(spark, d):
    return dups.summary(_groups(spark, d), _files(spark, d, "id", "present"))


@query(f"""WITH {_RANKED} SELECT CASE WHEN grouping(m) = 1 THEN NULL ELSE m END AS match, CASE WHEN grouping(t) = 1 THEN NULL ELSE t END AS media_type, count(*) AS copies, sum(s)::bigint AS bytes
FROM (SELECT 'identical' AS m, coalesce(media_type, 'other') AS t, greatest(coalesce(size, 0), 0) AS s FROM r WHERE rank > 1) GROUP BY CUBE (m, t)""")
def dup_breakdown(spark, d):
    return dups.breakdown(_candidates(spark, d))


@query(f"WITH {_RANKED} SELECT f.id, CASE WHEN r.rank > 1 THEN 1 ELSE 0 END AS hidden FROM f LEFT JOIN r ON r.id = f.id WHERE f.present = 1")
def dup_hidden_flags(spark, d):
    c = _candidates(spark, d)
    return dups.hidden_flags(_files(spark, d, "id", "present"), dups.membership(c, dups.groups(c)))


@query(f"WITH {_RANKED} SELECT id, group_id, canonical_id, CASE WHEN rank = 1 THEN 'canonical' ELSE 'identical' END AS match_type FROM r")
def dup_members(spark, d):
    c = _candidates(spark, d)
    return dups.membership(c, dups.groups(c))


@query(f"WITH {_RANKED} SELECT * FROM gr ORDER BY redundant_bytes DESC, group_id LIMIT 50")
def dup_listing(spark, d):
    return dups.listing(_groups(spark, d))


@query(f"WITH {_RANKED} SELECT group_id, members - 1 AS identical, 0::bigint AS visual FROM gr ORDER BY members DESC, group_id LIMIT 500")
def dup_listing_identical(spark, d):
    return dups.listing(dups.groups(_candidates(spark, d)), "most", 500, match="identical").select("group_id", "identical", "visual")


@query(f"""WITH {_F}, r AS (SELECT root_id, count_if(present = 1 AND id % 3 <> 0) AS n FROM f GROUP BY 1) SELECT greatest(0, (SELECT count(*) FROM f WHERE present = 1) - (SELECT sum(n) FROM r))::bigint AS pending""")
def dup_pending(spark, d):
    f = _files(spark, d, "id", "root_id", "present")
    runs = f.groupBy("root_id").agg(F.count_if((F.col("present") == 1) & (F.col("id") % 3 != 0)).alias("covered_files"))
    return dups.pending(f, runs)


@query(f"""WITH {_F}, {_D}, h AS (SELECT *, {_HASH} AS c, CASE WHEN id % 4 = 0 THEN 0 ELSE (id % 5) * (id % 7) END AS pixels, id % 3 = 0 AS side FROM f),
r AS (SELECT c, h.id, row_number() OVER (PARTITION BY c ORDER BY pixels DESC, coalesce(h.size, 0) DESC, side DESC, (d.file_id IS NOT NULL) DESC, best_datetime NULLS LAST, rel_path, h.id) AS rank, count(*) OVER (PARTITION BY c) AS n
      FROM h LEFT JOIN d ON d.file_id = h.id WHERE present = 1 AND regexp_matches(c, '^[0-9a-f]{{64}}$'))
SELECT c AS content, id AS canonical_id FROM r WHERE rank = 1 AND n > 1""")
def dup_canonical(spark, d):
    """All eight parts of the key, with a made-up table of pixels and one of sidecars."""
    f = _files(spark, d, "id", "rel_path", "size", "media_type", "sha256", "present")
    i = F.col("id")
    media = f.where(i % 4 != 0).select(i.alias("file_id"), (i % 5).alias("width"), (i % 7).alias("height"))
    c = dups.candidates(f, _dates(spark, d), sidecars=f.where(i % 3 == 0).select(i.alias("file_id")), media=media)
    return dups.groups(c).select(F.col("group").alias("content"), "canonical_id")


@query("""
WITH h AS (SELECT DISTINCT xor(('0x' || substr(md5((user_id % 97)::varchar), 1, 15))::bigint, 1::bigint << (event_id % 60)::int) AS hash FROM events)
SELECT x.hash AS a, y.hash AS b, bit_count(xor(x.hash, y.hash))::int AS distance FROM h x JOIN h y ON x.hash < y.hash AND bit_count(xor(x.hash, y.hash)) <= 6""")
def near_hashes(spark, d):
    e = table(spark, d, "events", "event_id", "user_id")
    base = F.conv(F.substring(F.md5((F.col("user_id") % 97).cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    return dups.near_hashes(e.select(base.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("event_id") % 60).cast("int"))).alias("hash")))


@query("""WITH RECURSIVE w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
m AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::bigint AS hi, ('0x' || substr(md5(w), 9, 8))::bigint AS lo FROM w),
v AS (SELECT doc_id, k, sum(CASE WHEN ((CASE WHEN k < 32 THEN lo ELSE hi END) >> (k % 32)::int) & 1 = 1 THEN 1 ELSE -1 END) AS n FROM m, range(64) r(k) GROUP BY ALL),
s AS (SELECT doc_id, sum(CASE WHEN n <= 0 THEN 0 WHEN k = 63 THEN -9223372036854775808::hugeint ELSE (1::bigint << k::int)::hugeint END)::bigint AS hash FROM v GROUP BY 1),
h AS (SELECT hash, min(doc_id) AS first FROM s GROUP BY 1),
e AS (SELECT x.hash AS a, y.hash AS b FROM h x JOIN h y ON x.hash <> y.hash AND bit_count(xor(x.hash, y.hash)) <= 6),
r(n, m) AS (SELECT hash, hash FROM h UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a), c AS (SELECT n AS hash, min(h.first) AS class_id FROM r JOIN h ON h.hash = r.m GROUP BY 1)
SELECT doc_id AS id, class_id, (SELECT count(*) FROM e WHERE e.a = s.hash) AS links FROM s JOIN c USING (hash)""")
def near_texts(spark, d):
    texts = table(spark, d, "documents", "doc_id", "text").distinct().withColumnRenamed("doc_id", "id")
    return dups.hash_classes(dups.text_hashes(texts))


# --- Faces, animals, places ---------------------------------------------------------------------------------

_FACES = "x AS (SELECT DISTINCT * EXCLUDE (embedding) FROM faces)"
_ANIMALS = "x AS (SELECT DISTINCT * EXCLUDE (embedding) FROM animal_detections)"
_PLACES = "x AS (SELECT DISTINCT * FROM place_clusters)"


@query(f"WITH {_FACES} SELECT count(*) AS faces, count_if(coalesce(not_person, 0) = 0 AND coalesce({_TIER}, 'BORDERLINE') <> 'LOW_QUALITY') AS good_faces, count(DISTINCT file_id) AS files, count(DISTINCT person_id) AS persons FROM x")
def face_summary(spark, d):
    return entities.face_summary(_rec(spark, d, "faces", "id", "file_id", "person_id", "not_person", "quality_tier"))


@query(f"WITH {_FACES} SELECT coalesce({_TIER}, 'UNTIERED') AS tier, count(*) AS faces, round(avg(det_score), 6) AS mean_score FROM x GROUP BY 1")
def face_tiers(spark, d):
    return entities.tier_histogram(_rec(spark, d, "faces", "id", "quality_tier", "det_score"))


@query(f"""WITH {_FACES}, v AS (SELECT id, det_score FROM x WHERE det_score IS NOT NULL AND NOT isnan(det_score)), c AS (SELECT avg(det_score) AS m, stddev_pop(det_score) AS s FROM v),
z AS (SELECT id, (greatest(-1.0, least(1.0, (det_score - m) / (s * 2.0))) + 1) / 2 AS q FROM v, c)
SELECT id, round(q, 6) AS score, CASE WHEN q >= 0.55 THEN 'HIGH' WHEN q < 0.18 THEN 'LOW_QUALITY' ELSE 'BORDERLINE' END AS tier FROM z""")
def face_retier(spark, d):
    v = _rec(spark, d, "faces", "id", "det_score").where("det_score IS NOT NULL AND NOT isnan(det_score)")
    return entities.retier(v, "det_score", entities.calibration(v, "det_score"))


@query(f"WITH {_FACES} SELECT file_id, id, rank FROM (SELECT file_id, id, row_number() OVER (PARTITION BY file_id ORDER BY det_score DESC NULLS LAST, id) AS rank FROM x) WHERE rank <= 4")
def face_previews(spark, d):
    return entities.best_per(_rec(spark, d, "faces", "id", "file_id", "det_score"), "file_id", 4).select("file_id", "id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_ANIMALS}, g AS (SELECT file_id, species, count(*) AS n, max(det_score) AS top FROM x WHERE species IS NOT NULL GROUP BY ALL)
SELECT file_id, species, n FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, top DESC, species) AS r FROM g) WHERE r = 1""")
def majority_species(spark, d):
    return entities.majority_species(_rec(spark, d, "animal_detections", "id", "file_id", "species", "det_score"), "file_id")


@query(f"WITH {_ANIMALS} SELECT id, species, det_score FROM x WHERE species IS NULL OR species <> 'teddy bear'")
def animal_gallery(spark, d):
    return entities.gallery(_rec(spark, d, "animal_detections", "id", "species", "det_score"))


_BOX_IOU = """(greatest(least(x.box_x + x.box_w, y.box_x + y.box_w) - greatest(x.box_x, y.box_x), 0) * greatest(least(x.box_y + x.box_h, y.box_y + y.box_h) - greatest(x.box_y, y.box_y), 0))::double"""


@query(f"""WITH a AS (SELECT DISTINCT id, file_id, box_x, box_y, box_w, box_h FROM animal_detections), p AS (SELECT DISTINCT id, file_id, box_x, box_y, box_w, box_h FROM faces),
j AS (SELECT x.id AS animal_id, y.id AS face_id, {_BOX_IOU} AS shared, x.box_w * x.box_h + y.box_w * y.box_h AS both_ FROM a x JOIN p y USING (file_id))
SELECT animal_id, face_id, round(shared / greatest(1, both_ - shared), 6) AS iou FROM j WHERE shared > 0""")
def faces_in_animals(spark, d):
    a, p = (_rec(spark, d, t, "id", "file_id", "box_x", "box_y", "box_w", "box_h").alias(n) for t, n in (("animal_detections", "a"), ("faces", "p")))
    box = lambda t: {k: F.col(f"{t}.box_{k}") for k in "xywh"}
    return a.join(p, F.expr("a.file_id = p.file_id")).select(F.col("a.id").alias("animal_id"), F.col("p.id").alias("face_id"), F.round(iou(box("a"), box("p")), 6).alias("iou")).where("iou > 0")


@query("""WITH RECURSIVE x AS (SELECT *, row_number() OVER (PARTITION BY file_id, species ORDER BY coalesce(det_score, -1) DESC, id) AS r FROM (SELECT DISTINCT ON (id) id, file_id, species, box_x, box_y, box_w, box_h, det_score FROM animal_detections
  WHERE box_x IS NOT NULL AND box_y IS NOT NULL AND box_w IS NOT NULL AND box_h IS NOT NULL)),
o AS (SELECT a.id, list(b.id) AS near FROM x a JOIN x b ON a.file_id IS NOT DISTINCT FROM b.file_id AND a.species IS NOT DISTINCT FROM b.species AND a.id <> b.id,
      LATERAL (SELECT (greatest(least(a.box_x + a.box_w, b.box_x + b.box_w) - greatest(a.box_x, b.box_x), 0) * greatest(least(a.box_y + a.box_h, b.box_y + b.box_h) - greatest(a.box_y, b.box_y), 0))::double AS shared)
      WHERE a.box_w * a.box_h + b.box_w * b.box_h - shared > 0 AND shared / (a.box_w * a.box_h + b.box_w * b.box_h - shared) > 0.5 GROUP BY 1),
s AS (SELECT file_id, species, 1 AS k, [id] AS kept FROM x WHERE r = 1 UNION ALL
      SELECT s.file_id, s.species, k + 1, CASE WHEN list_has_any(kept, coalesce(o.near, [])) THEN kept ELSE list_append(kept, x.id) END FROM s JOIN x ON x.file_id IS NOT DISTINCT FROM s.file_id AND x.species IS NOT DISTINCT FROM s.species AND x.r = s.k + 1 LEFT JOIN o ON o.id = x.id)
SELECT unnest(kept) AS id FROM (SELECT kept FROM s QUALIFY row_number() OVER (PARTITION BY file_id, species ORDER BY k DESC) = 1)""")
def nms(spark, d):
    return clusters.suppressed(table(spark, d, "animal_detections", "id", "file_id", "species", "box_x", "box_y", "box_w", "box_h", "det_score"))


@query("""WITH RECURSIVE x AS (SELECT id, species, e, row_number() OVER (PARTITION BY species ORDER BY id) AS r FROM (SELECT DISTINCT ON (id) id, species, embedding::double[] AS e FROM animal_detections WHERE species IS NOT NULL AND species <> 'teddy bear'
  AND len(embedding) = 96 AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0)),
s AS (SELECT b.species, b.r, list(list_cosine_similarity(a.e, b.e) ORDER BY a.r) AS sims FROM x a JOIN x b ON a.species = b.species AND a.r < b.r GROUP BY ALL),
w AS (SELECT species, 1 AS k, [1] AS g, 1 AS m FROM x WHERE r = 1 UNION ALL
  SELECT species, k + 1, list_append(g, coalesce(p.q, m + 1)::int), greatest(m, coalesce(p.q, m + 1))::int FROM (
    SELECT w.species, k, g, m, list_sort(list_filter(list_transform(range(1, m + 1), lambda q: {'ok': list_min(list_filter(list_transform(range(1, k + 1), lambda i: CASE WHEN g[i] = q THEN sims[i] END), lambda v: v IS NOT NULL)) >= 0.75,
      'mean': round(list_avg(list_filter(list_transform(range(1, k + 1), lambda i: CASE WHEN g[i] = q THEN sims[i] END), lambda v: v IS NOT NULL)), 12), 'q': q}), lambda z: z.ok))[-1] AS p FROM w JOIN s ON s.species = w.species AND s.r = w.k + 1)),
f AS (SELECT species, unnest(g) AS grp, generate_subscripts(g, 1) AS r FROM (SELECT species, g FROM w QUALIFY row_number() OVER (PARTITION BY species ORDER BY k DESC) = 1)),
o AS (SELECT id, min(id) OVER (PARTITION BY f.species, grp) AS pet_id, count(*) OVER (PARTITION BY f.species, grp) AS n FROM f JOIN x USING (species, r))
SELECT id, pet_id FROM o WHERE n >= 2""")
def pets(spark, d):
    return clusters.pets(table(spark, d, "animal_detections", "id", "species", "embedding"), 96)


@query()
def person_rebuild(spark, d):
    return people.persons(table(spark, d, "faces", "id", "embedding", "quality_tier", "not_person", "manual_person"), table(spark, d, "face_links"))


@query(f"""WITH {_PLACES} SELECT id, member_count, CASE WHEN nullif(trim(name), '') IS NULL THEN 1 ELSE 0 END AS unnamed FROM x WHERE member_count >= 3 OR trim(name) <> '' OR pinned = 1""")
def places_visible(spark, d):
    return entities.visible_places(_rec(spark, d, "place_clusters")).select("id", "member_count", "unnamed")


@query(f"WITH {_PLACES} SELECT count(*) AS places, coalesce(sum(member_count), 0)::bigint AS members FROM x WHERE NOT coalesce(member_count >= 3 OR trim(name) <> '' OR pinned = 1, false)")
def places_below(spark, d):
    return entities.below_threshold(_rec(spark, d, "place_clusters"))


_POINTS = "p AS (SELECT DISTINCT id, lat, lon FROM place_clusters WHERE NOT isnan(lat) AND NOT isnan(lon) AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0))"
_NEAR = "2 * 6371000 * asin(sqrt(least(1, sin(radians(y.lat - x.lat) / 2) ** 2 + cos(radians(x.lat)) * cos(radians(y.lat)) * sin(radians(y.lon - x.lon) / 2) ** 2)))"


_CELL = "round_even({0}.lat / (5000 / 111320.0), 0) AS {0}y, round_even({0}.lon / (5000 / (111320.0 * greatest(cos(radians({0}.lat)), 1e-6))), 0) AS {0}x"


@query(f"""WITH RECURSIVE {_POINTS}, t AS (SELECT x.id AS a, y.id AS b, {_NEAR} AS m, {_CELL.format('x')}, {_CELL.format('y')} FROM p x, p y),
e AS (SELECT a, b FROM t WHERE (xy = yy AND xx = yx) OR (abs(xy - yy) <= 1 AND abs(xx - yx) <= 1 AND m <= 5000)),
r(n, m) AS (SELECT a, b FROM e UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a), g AS (SELECT n, min(m) AS group_id FROM r GROUP BY n)
SELECT group_id, round(avg(lat), 4) AS lat, round(avg(lon), 4) AS lon, count(*) AS points FROM p JOIN g ON g.n = p.id GROUP BY 1""")
def place_groups(spark, d):
    p = _points(spark, d)
    return entities.place_groups(p, 5000.0).select("group_id", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "points")


def _points(spark, d) -> DataFrame:
    return _rec(spark, d, "place_clusters", "id", "lat", "lon").where("lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT isnan(lat) AND NOT isnan(lon) AND NOT (lat = 0 AND lon = 0)")


@query(f"""WITH {_POINTS}, q AS (SELECT x.id, y.id AS place_id, {_NEAR} AS m FROM p x JOIN p y ON x.id % 2 = 0 AND y.id % 2 = 1 WHERE {_NEAR} <= 20000)
SELECT id, (array_agg(place_id ORDER BY m, place_id DESC))[1] AS place_id, round(min(m), 3) AS metres FROM q GROUP BY id""")
def nearest_place(spark, d):
    p = _points(spark, d)
    q = p.where("id % 2 = 1").select(F.col("id").alias("place_id"), "lat", "lon")
    return entities.nearest_place(p.where("id % 2 = 0"), q, 20_000.0).withColumn("metres", F.round("metres", 3))


@query(f"""WITH {_POINTS}, q AS (SELECT x.id, y.id AS place_id, {_NEAR} AS m FROM p x JOIN p y ON x.id <> y.id WHERE {_NEAR} <= 20000)
SELECT id, (array_agg(place_id ORDER BY m, place_id DESC))[1] AS place_id, round(min(m), 3) AS metres FROM q GROUP BY id""")
def nearest_other_place(spark, d):
    p = _points(spark, d)
    return entities.nearest_place(p, p.withColumnRenamed("id", "place_id"), 20_000.0, others=True).withColumn("metres", F.round("metres", 3))


@query(f"WITH {_POINTS} SELECT try_cast(round_even(lat / (300 / 111320.0), 0) AS bigint) AS y, try_cast(round_even(lon / (300 / (111320.0 * greatest(cos(radians(lat)), 1e-6))), 0) AS bigint) AS x, count(*) AS n FROM p GROUP BY ALL")
def place_cells(spark, d):
    return _points(spark, d).select(cell(F.col("lat"), F.col("lon"), 300.0).alias("c")).groupBy(F.col("c.y").alias("y"), F.col("c.x").alias("x")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT DISTINCT * FROM face_links), f AS (SELECT DISTINCT id FROM faces)
SELECT lower(trim(kind)) AS kind, count(*) AS answers, count_if(a.id IS NULL OR b.id IS NULL) AS dangling FROM l LEFT JOIN f a ON a.id = l.face_a LEFT JOIN f b ON b.id = l.face_b GROUP BY 1""")
def link_answers(spark, d):
    ids = _rec(spark, d, "faces", "id")
    l = table(spark, d, "face_links").distinct()
    j = l.join(ids.select(F.col("id").alias("face_a"), F.lit(1).alias("a")), "face_a", "left").join(ids.select(F.col("id").alias("face_b"), F.lit(1).alias("b")), "face_b", "left")
    return j.groupBy(F.lower(F.trim("kind")).alias("kind")).agg(F.count("*").alias("answers"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("dangling"))


# --- Text ---------------------------------------------------------------------------------------------------

_NOW = "t AS (SELECT DISTINCT ON (file_id) * FROM doc_text ORDER BY file_id, extracted_at DESC)"


def _current(spark, d) -> DataFrame:
    w = Window.partitionBy("file_id").orderBy(F.desc("extracted_at"))
    return table(spark, d, "doc_text").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


@query(f"""WITH {_F}, {_NOW} SELECT status, media_type, CASE WHEN extractor IN ('ocr', 'pdf-ocr') THEN 'ocr' ELSE 'documents' END AS reader, count(*) AS files, coalesce(sum(n_chunks), 0)::bigint AS passages
FROM t JOIN f ON f.id = t.file_id GROUP BY ALL""")
def text_status(spark, d):
    reader = browse.reader_of(F.col("extractor"))
    j = _current(spark, d).join(_files(spark, d, "id", "media_type").withColumnRenamed("id", "file_id"), "file_id")
    return j.groupBy("status", "media_type", reader.alias("reader")).agg(F.count("*").alias("files"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("passages"))


@query(f"""WITH {_F}, {_NOW}, j AS (SELECT f.id, CASE WHEN t.file_id IS NULL THEN 'missing' WHEN t.source_sha256 IS DISTINCT FROM f.sha256 THEN 'bytes' WHEN t.text_version IS DISTINCT FROM 't3' THEN 'version'
WHEN t.wanted IS DISTINCT FROM 'documents+ocr' THEN 'wanted' END AS reason FROM f LEFT JOIN t ON t.file_id = f.id WHERE present = 1 AND hidden = 0 AND media_type IN ('document', 'image')) SELECT * FROM j WHERE reason IS NOT NULL""")
def text_backlog(spark, d):
    return snapshots.text_backlog(_files(spark, d, "id", "sha256", "media_type", "present", "hidden"), table(spark, d, "doc_text"), "t3", "documents+ocr")


@query(f"WITH {_F}, {_D} SELECT id FROM f WHERE present = 1 AND id NOT IN (SELECT file_id FROM d)")
def enrich_backlog(spark, d):
    return snapshots.undated(_files(spark, d, "id", "present"), _dates(spark, d)).select("id")


@query(r"""WITH c AS (SELECT DISTINCT id, file_id, ordinal, text FROM doc_chunk_fts),
w AS (SELECT id, file_id, ordinal, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+') AS t FROM c),
n AS (SELECT id, file_id, ordinal, len(t) AS l, len(list_filter(t, lambda x: x = 'verano')) AS f0, len(list_filter(t, lambda x: starts_with(x, 'fotog'))) AS f1 FROM w),
s AS (SELECT count(*) AS n, avg(l) AS m, count_if(f0 > 0) AS d0, count_if(f1 > 0) AS d1 FROM n),
r AS (SELECT id, file_id, ordinal, -(greatest(1e-6, ln((s.n - d0 + 0.5) / (d0 + 0.5))) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * l / m)) + greatest(1e-6, ln((s.n - d1 + 0.5) / (d1 + 0.5))) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / m))) AS score
      FROM n, s WHERE f0 > 0 AND f1 > 0)
SELECT file_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score, ordinal) AS k FROM r) WHERE k = 1""")
def text_search(spark, d):
    hits = search.bm25(_rec(spark, d, "doc_chunk_fts", "id", "file_id", "ordinal", "text"), "verano fotog*")
    return search.best_passages(hits).select("file_id", "id", F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT DISTINCT id, file_id, ordinal, text FROM doc_chunk_fts WHERE text IS NOT NULL)
SELECT file_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY ordinal, id)) AS digest FROM c GROUP BY file_id""")
def transcripts(spark, d):
    return search.transcript(table(spark, d, "doc_chunk_fts", "id", "file_id", "ordinal", "text")).select("file_id", F.md5(F.col("transcript").cast("binary")).alias("digest"))


@query()
def document_passages(spark, d):
    return search.chunk(table(spark, d, "documents", "doc_id", "text"))


@query("""SELECT lower(split_part(lang, '-', 1)) AS lang, count(*) AS docs, sum(n_chars)::bigint AS chars, count(DISTINCT source) AS sources FROM documents GROUP BY 1""")
def corpus_languages(spark, d):
    return table(spark, d, "documents", "lang", "n_chars", "source").groupBy(F.lower(F.split_part("lang", F.lit("-"), F.lit(1))).alias("lang")).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.countDistinct("source").alias("sources"))


# --- Vectors ------------------------------------------------------------------------------------------------

_U = "u AS (SELECT vec_id, label, embedding::double[] AS e FROM embeddings)"


def _query_vector(spark, d) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 7").first()["embedding"]]


@query(f"""WITH {_U}, q AS (SELECT e AS q FROM u WHERE vec_id = 7), s AS (SELECT vec_id, list_cosine_similarity(e, q) AS score FROM u, q), k AS (SELECT * FROM s WHERE score >= 0.05), b AS (SELECT max(score) AS best FROM k)
SELECT vec_id, round(score, 6) AS score FROM k, b WHERE best <= 0 OR score >= 0.15 * best""")
def semantic_search(spark, d):
    s = search.score(table(spark, d, "embeddings", "vec_id", "embedding"), [(_query_vector(spark, d), 0.0)])
    return search.cut_relevance(s, 0.05, 0.15).select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {_U}, q AS (SELECT e AS q FROM u WHERE vec_id = 7) SELECT vec_id, round(list_cosine_similarity(e, q), 6) AS score FROM u, q WHERE vec_id <> 7 ORDER BY list_cosine_similarity(e, q) DESC, vec_id LIMIT 8")
def similar_media(spark, d):
    return search.similar(table(spark, d, "embeddings", "vec_id", "embedding"), 7, _query_vector(spark, d)).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_U}, x AS (SELECT label, generate_subscripts(e, 1) AS pos, unnest(e) / sqrt(list_dot_product(e, e)) AS v FROM u), m AS (SELECT label, pos, avg(v) AS v FROM x GROUP BY ALL),
c AS (SELECT label, list(v ORDER BY pos) AS c FROM m GROUP BY label)
SELECT x.label::bigint AS a, y.label::bigint AS b, round(list_cosine_similarity(x.c, y.c), 5) AS score FROM c x JOIN c y ON x.label < y.label WHERE list_cosine_similarity(x.c, y.c) >= 0.05""")
def centroid_suggestions(spark, d):
    c = search.centroids(table(spark, d, "embeddings"), "label").withColumn("label", F.col("label").cast("long"))
    return search.centroid_pairs(c, "label", least=0.05).select("a", "b", F.round("score", 5).alias("score"))


_KNN = f"""{_U}, s AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.e, y.e) AS score FROM u x JOIN u y ON x.vec_id <> y.vec_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s WHERE score >= 0.2) WHERE r <= 5)"""


@query(f"WITH {_KNN} SELECT a, b, round(score, 5) AS score FROM k")
def knn(spark, d):
    return search.exact_neighbours(table(spark, d, "embeddings", "vec_id", "embedding"), 5, 0.2).withColumn("score", F.round("score", 5))


@query(f"WITH {_KNN} SELECT k.a, k.b FROM k JOIN k y ON k.a = y.b AND k.b = y.a WHERE k.a < k.b")
def mutual_knn(spark, d):
    return search.mutual(search.exact_neighbours(table(spark, d, "embeddings", "vec_id", "embedding"), 5, 0.2))


# --- Relational forms on the star schema, and event windows ---------------------------------------------------


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def customers_without_orders(spark, d):
    return table(spark, d, "customer", "c_custkey").join(table(spark, d, "orders", "o_custkey").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left_anti")


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def revenue_by_nation(spark, d):
    l = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    per = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    j = per.join(table(spark, d, "orders", "o_orderkey", "o_custkey"), "o_orderkey").join(table(spark, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    l = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_shipdate").where("l_shipdate <= DATE '1998-09-02'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, r FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3""")
def top_lines_per_supplier(spark, d):
    l = table(spark, d, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return l.withColumn("r", F.row_number().over(w).cast("long")).where("r <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", "r")


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def nations_union(spark, d):
    return table(spark, d, "customer", F.col("c_nationkey").alias("nation")).union(table(spark, d, "supplier", F.col("s_nationkey").alias("nation"))).distinct()


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def nations_intersect(spark, d):
    return table(spark, d, "customer", F.col("c_nationkey").alias("nation")).intersect(table(spark, d, "supplier", F.col("s_nationkey").alias("nation")))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def events_hourly(spark, d):
    return ev.tumbling(table(spark, d, "events", "ts", "event_type", "value")).withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    return ev.sessions(table(spark, d, "events", "ts", "user_id"))


@query("""WITH e AS (SELECT DISTINCT ON (id) id, mtime FROM files), m AS (SELECT id, CASE WHEN mtime > 0 AND NOT isnan(mtime) THEN CASE WHEN mtime < 1e11 THEN round(mtime * 1e6) WHEN mtime < 1e14 THEN round(mtime * 1e3) WHEN mtime < 1e17 THEN mtime END END AS us FROM e)
SELECT count(us) AS usable, count(*) - count(us) AS unusable, min(us)::bigint AS first_us, max(us)::bigint AS last_us FROM m""")
def mtime_range(spark, d):
    m = _files(spark, d, "id", "mtime").select(epoch_micros("mtime").alias("us"))
    return m.agg(F.count("us").alias("usable"), (F.count("*") - F.count("us")).alias("unusable"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query(r"""WITH f AS (SELECT DISTINCT * FROM files)
SELECT regexp_replace(regexp_replace(regexp_extract(rel_path, '[^/\\]*$'), '[A-Za-z]', 'x', 'g'), '[0-9]', 'D', 'g') AS shape, count(*) AS files, min(rel_path) AS example FROM f GROUP BY 1""")
def filename_shapes(spark, d):
    shape = F.regexp_replace(F.regexp_replace(basename(F.col("rel_path")), "[A-Za-z]", "x"), "[0-9]", "D")
    return _files(spark, d, "id", "rel_path").groupBy(shape.alias("shape")).agg(F.count("*").alias("files"), F.min("rel_path").alias("example"))


# --- Records, cards and diagnostics ---------------------------------------------------------------------------


@query(f"""WITH {_F}, g AS (SELECT root_id, count(*) AS files, coalesce(sum(greatest(size, 0)), 0)::bigint AS bytes, max(last_seen) AS last_seen FROM f WHERE present = 1 GROUP BY 1),
c AS (SELECT root_id, list(id ORDER BY r) AS covers FROM (SELECT root_id, id, row_number() OVER (PARTITION BY root_id ORDER BY first_seen DESC NULLS LAST, id DESC) AS r FROM f WHERE present = 1 AND hidden = 0 AND media_type = 'image') WHERE r <= 5 GROUP BY 1)
SELECT * FROM g LEFT JOIN c USING (root_id)""")
def archive_cards(spark, d):
    return details.archive_cards(_files(spark, d, "id", "root_id", "size", "last_seen", "first_seen", "present", "hidden", "media_type"))


@query(f"""WITH {_F} SELECT id, id IN (SELECT file_id FROM dates WHERE file_id IS NOT NULL) AS dated, id IN (SELECT file_id FROM faces WHERE file_id IS NOT NULL) AS faces,
id IN (SELECT file_id FROM animal_detections WHERE file_id IS NOT NULL) AS animals, id IN (SELECT file_id FROM doc_text WHERE file_id IS NOT NULL) AS read FROM f""")
def coverage_flags(spark, d):
    t = lambda n: table(spark, d, n, "file_id")
    return details.coverage_flags(_files(spark, d, "id"), dated=t("dates"), faces=t("faces"), animals=t("animal_detections"), read=t("doc_text"))


@query(f"""WITH {_RANKED}, a AS (SELECT file_id, count(DISTINCT id) AS n FROM faces GROUP BY 1), b AS (SELECT file_id, count(DISTINCT id) AS n FROM animal_detections GROUP BY 1)
SELECT f.id, d.best_datetime, coalesce(a.n, 0)::bigint AS faces, coalesce(b.n, 0)::bigint AS animals, r.group_id, r.canonical_id
FROM f LEFT JOIN d ON d.file_id = f.id LEFT JOIN a ON a.file_id = f.id LEFT JOIN b ON b.file_id = f.id LEFT JOIN r ON r.id = f.id""")
def item_details(spark, d):
    box = ["id", "file_id", "box_x", "box_y", "box_w", "box_h", "det_score"]
    c = _candidates(spark, d)
    i = details.item(_files(spark, d, "id"), _dates(spark, d), _rec(spark, d, "faces", *box), _rec(spark, d, "animal_detections", *box), dups.membership(c, dups.groups(c)))
    return i.select("id", "date.best_datetime", F.size("faces").cast("long").alias("faces"), F.size("animals").cast("long").alias("animals"), "group_id", "canonical_id")


@query("""WITH p AS (SELECT unnest([1, 5, 25, 50, 75, 95, 99, 99.9]::double[]) AS percent), v AS (SELECT list(l_extendedprice ORDER BY l_extendedprice) AS l FROM lineitem)
SELECT percent, round(l[floor(percent / 100 * (len(l) - 1))::bigint + 1] + (percent / 100 * (len(l) - 1) - floor(percent / 100 * (len(l) - 1))) * (l[least(len(l), floor(percent / 100 * (len(l) - 1))::bigint + 2)] - l[floor(percent / 100 * (len(l) - 1))::bigint + 1]), 4) AS value FROM p, v""")
def price_percentiles(spark, d):
    return details.percentiles(table(spark, d, "lineitem", "l_extendedprice"), "l_extendedprice").withColumn("value", F.round("value", 4))


@query("""WITH s AS (SELECT o_orderpriority AS query, o_totalprice / 1000 AS score FROM orders), b AS (SELECT query, max(score) AS best FROM s GROUP BY 1),
g AS (SELECT * FROM (VALUES (0.0, 0.5), (0.0, 0.9), (200.0, 0.5), (200.0, 0.9)) t(floor, ratio)),
n AS (SELECT floor, ratio, b.query, count_if(score >= floor AND score >= ratio * best) AS n FROM b CROSS JOIN g JOIN s ON s.query = b.query GROUP BY ALL)
SELECT floor::double AS floor, ratio::double AS ratio, median(n)::double AS kept FROM n GROUP BY ALL""")
def relevance_sweep(spark, d):
    s = table(spark, d, "orders", "o_orderpriority", "o_totalprice").select(F.col("o_orderpriority").alias("query"), (F.col("o_totalprice") / 1000).alias("score"))
    return details.sweep(s, [0.0, 200.0], [0.5, 0.9])


@query(f"WITH {_F}, {_D} SELECT (SELECT count(*) FROM f WHERE present = 1) AS total, (SELECT count(*) FROM f WHERE present = 1 AND id IN (SELECT file_id FROM d)) AS done")
def enrich_progress(spark, d):
    f = browse.visible(_files(spark, d, "id", "present"))
    return details.progress(f, snapshots.undated(f, _dates(spark, d)))


from kestrel import catalog_library, catalog_rules  # noqa: E402, F401  (add their queries)

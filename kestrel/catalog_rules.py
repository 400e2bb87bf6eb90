"""Queries over rules of single values: names, dates, numbers, boxes, quality, readers. Where no table holds such values they are
made from whole tables, on both sides alike."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from kestrel.catalog import _F, _files, _rec, query
from kestrel.functions import numbers as n
from kestrel.functions import queries as q
from kestrel.functions.paths import basename, corrected_type, detected_type, filename_date, ignored, sidecar_base, type_mismatch
from kestrel.operators.entities import rejection
from kestrel.plans import snapshots
from kestrel.session import table
from kestrel.sources import readers


def _case(key, *values):
    """The value of the remainder that ``key`` leaves."""
    out = F.lit(None)
    for k, v in enumerate(values):
        out = F.when(key % len(values) == k, v if not isinstance(v, (str, int, float, type(None))) else F.lit(v)).otherwise(out)
    return out


_BASE = r"regexp_extract(rel_path, '[^/\\]*$')"


# --- Names (S2-S4, P2, P3, P22, N22, J9, F18, D1-D14) ---------------------------------------------------------


@query(rf"""WITH {_F}, m AS (SELECT id, CASE id % 6 WHEN 0 THEN {_BASE} WHEN 1 THEN 'Thumbs.DB' WHEN 2 THEN {_BASE} || '.json' WHEN 3 THEN '.nomedia' WHEN 4 THEN 'my_ThumbData_' || id || '.jpg' ELSE 'IMG_' || id || '.PART' END AS name FROM f)
SELECT id, id % 6 IN (1, 2, 3, 4, 5) OR lower(regexp_extract(name, '^.+\.([^.]*)$', 1)) IN ('json', 'db', 'thm', 'ini', 'nomedia', 'part', 'tmp') OR regexp_matches(lower(name), 'thumbindex|thumbdata|database_uuid|nomedia|\.com\.google\.chrome\.') AS ignored FROM m""")
def ignored_names(spark, d):
    base, i = basename(F.col("rel_path")), F.col("id")
    name = _case(i, base, "Thumbs.DB", F.concat(base, F.lit(".json")), ".nomedia", F.concat(F.lit("my_ThumbData_"), i, F.lit(".jpg")), F.concat(F.lit("IMG_"), i, F.lit(".PART")))
    return _files(spark, d, "id", "rel_path").select("id", ignored(name).alias("ignored"))


@query(f"""WITH {_F}, m AS (SELECT id, media_type, CASE id % 8 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'VIDEO/mp4' WHEN 2 THEN 'audio/ogg' WHEN 3 THEN 'application/pdf' WHEN 4 THEN 'application/zip' WHEN 5 THEN 'text/plain' WHEN 6 THEN NULL ELSE 'application/octet-stream' END AS mime, ext FROM f),
t AS (SELECT *, CASE id % 8 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' WHEN 3 THEN 'document' WHEN 4 THEN 'archive' WHEN 5 THEN 'document' END AS det FROM m)
SELECT id, det AS detected, CASE WHEN media_type = 'other' AND det IS NOT NULL THEN det ELSE media_type END AS corrected, coalesce(det <> '' AND ext <> '' AND det <> ext, false) AS mismatch FROM t""")
def sniffed_types(spark, d):
    det = detected_type(_case(F.col("id"), "image/jpeg", "VIDEO/mp4", "audio/ogg", "application/pdf", "application/zip", "text/plain", None, "application/octet-stream").cast("string"))
    f = _files(spark, d, "id", "media_type", "ext")
    return f.select("id", det.alias("detected"), corrected_type(F.col("media_type"), det).alias("corrected"), type_mismatch(det, F.col("ext")).alias("mismatch"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderdate::date AS day, o_orderkey % 18 AS s FROM orders), p AS (SELECT *, day(day) AS dd, month(day) AS mm FROM o)
SELECT id, CASE WHEN s IN (0, 1, 2, 3, 4, 5, 17) THEN strftime(day, '%Y-%m-%d') || ' 09:05:07' WHEN s = 6 THEN strftime(day, '%Y-%m-%d') || ' 18:55:00' WHEN s = 7 THEN strftime(day, '%Y-%m-%d') || ' 18:55:00'
WHEN s IN (9, 12) THEN strftime(day, '%Y-%m-%d') || ' 00:00:01' ELSE strftime(day, '%Y-%m-%d') || ' 00:00:00' END AS moment,
CASE WHEN s IN (0, 1, 2, 3) THEN 0.9 WHEN s IN (4, 5, 17) THEN 0.75 WHEN s = 6 THEN 0.65 WHEN s = 7 THEN CASE WHEN dd <= 12 THEN 0.55 ELSE 0.65 END WHEN s = 8 THEN 0.6 WHEN s = 9 THEN 0.6 WHEN s IN (10, 14) THEN 0.55
WHEN s IN (11, 15) THEN CASE WHEN dd <= 12 THEN 0.45 ELSE 0.55 END WHEN s = 12 THEN 0.4 ELSE 0.4 END::double AS confidence
FROM p WHERE s <> 16 AND NOT (s IN (14, 17) AND dd <= 12) AND NOT (s IN (9, 12) AND epoch_ms(day::timestamp) < 1000000000000)""")
def filename_shapes_read(spark, d):
    """Every shape of a date in a file name (D1-D14), with exchanged and ambiguous days (P12, P13) and milliseconds (P14). What only a
    year before 2001 could tell, and names without a date, give no row."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    day = F.col("o_orderdate").cast("date")
    f = lambda p: F.date_format(day, p)
    ms = (F.unix_timestamp(day.cast("timestamp")) * 1000 + 1500).cast("string")
    name = _case(
        F.col("o_orderkey"),
        F.concat(F.lit("Foto "), f("yyyy-MM-dd"), F.lit(" at 09.05.07.jpeg")), F.concat(F.lit("WP_"), f("yyyyMMdd"), F.lit("_09_05_07_Pro.jpg")), F.concat(F.lit("IMG_"), f("yyyyMMdd"), F.lit("_090507.jpg")),
        F.concat(F.lit("shot "), f("yyyy:MM:dd"), F.lit(" 09:05:07.png")), F.concat(F.lit("BURST"), f("yyyyMMdd"), F.lit("090507123.jpg")), F.concat(F.lit("x"), f("yyyy-MM-dd"), F.lit("-09-05-07.jpg")),
        F.concat(F.lit("IMG00243-"), f("yyyyMMdd"), F.lit("-1855.jpg")), F.concat(F.lit("VID "), f("dd-MM-yyyy"), F.lit("_18-55.mp4")), F.concat(F.lit("IMG-"), f("yyyyMMdd"), F.lit("-WA0001.jpg")),
        F.concat(F.lit("FB_IMG_"), ms, F.lit(".jpg")), F.concat(f("yyyy_MM_dd"), F.lit(" trip.png")), F.concat(F.lit("a "), f("dd.MM.yyyy"), F.lit(".pdf")),
        F.concat(F.lit("x"), ms, F.lit(".jpg")), F.concat(F.lit("scan"), f("yyyyMMdd"), F.lit(".tif")), F.concat(f("yyyy-dd-MM"), F.lit(".jpg")),
        F.concat(F.lit("b_"), f("d-M-yyyy"), F.lit(".doc")), "holiday.jpg", F.concat(f("yyyy-dd-MM"), F.lit("-09-05-07.jpg")),
    )
    s, dd = F.col("o_orderkey") % 18, F.dayofmonth(day)
    got = filename_date(name)
    out = o.where(~(s.isin(14, 17) & (dd <= 12)) & ~(s.isin(9, 12) & (F.unix_timestamp(day.cast("timestamp")) < 1_000_000_000)))
    return out.select(F.col("o_orderkey").alias("id"), F.date_format(got["at"], "yyyy-MM-dd HH:mm:ss").alias("moment"), got["confidence"].alias("confidence")).where("moment IS NOT NULL")


@query()
def path_dates(spark, d):
    """What the names of all files tell of their dates."""
    got = filename_date(basename(F.col("rel_path")))
    return _files(spark, d, "id", "rel_path").select("id", F.date_format(got["at"], "yyyy-MM-dd HH:mm:ss").alias("moment"), got["confidence"].alias("confidence")).where("moment IS NOT NULL")


_SIDE = rf"{_F}, m AS (SELECT id, root_id || '/' || regexp_replace(rel_path, '/?[^/]*$', '') AS dir, 'p' || id || '_' || {_BASE} AS name FROM f)"


@query(rf"""WITH {_SIDE} SELECT id, CASE id % 5 WHEN 0 THEN name || '.json' WHEN 1 THEN name || '.supplemental-metadata.json' WHEN 2 THEN name || '.supplemental-meta.json' ELSE substr(name, 1, greatest(20, length(name) - 2)) || '.json' END AS json,
CASE id % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'supplemental' ELSE 'prefix' END AS method FROM m WHERE id % 5 < 4 AND length(name) >= 22 AND NOT regexp_matches(substr(name, 1, greatest(20, length(name) - 2)), '\.$')""")
def sidecars_matched(spark, d):
    """Sidecars by the rules of names, and by a beginning of 20 characters and more."""
    base = F.concat(F.lit("p"), "id", F.lit("_"), basename(F.col("rel_path")))
    m = _files(spark, d, "id", "root_id", "rel_path").select("id", F.concat("root_id", F.lit("/"), F.regexp_replace("rel_path", r"/?[^/]*$", "")).alias("dir"), base.alias("name"))
    short = F.expr("substring(name, 1, greatest(20, length(name) - 2))")
    m = m.where((F.length("name") >= 22) & ~short.rlike(r"\.$"))
    s = m.where(F.col("id") % 5 < 4).select("dir", _case(F.col("id"), F.concat("name", F.lit(".json")), F.concat("name", F.lit(".supplemental-metadata.json")), F.concat("name", F.lit(".supplemental-meta.json")), F.concat(short, F.lit(".json")), None).alias("json"))
    return readers.match_sidecars(m, s).select("id", "json", "method")


@query(rf"""WITH {_SIDE} SELECT id, name AS base FROM m WHERE NOT regexp_matches(name, '\(\d+\)$')""")
def sidecar_bases(spark, d):
    base = F.concat(F.lit("p"), "id", F.lit("_"), basename(F.col("rel_path")))
    json_ = F.concat(base, _case(F.col("id"), ".json", ".supplemental-metadata.json", ".supplemental-met.JSON", "(2).json"))
    return _files(spark, d, "id", "rel_path").where(~base.rlike(r"\(\d+\)$")).select("id", sidecar_base(json_).alias("base"))


# --- Dates and places of metadata (P4-P10, P15, S13) ----------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') || 'T10:11:12' AS t, o_orderkey % 5 AS s FROM orders)
SELECT id, t AS moment, CASE WHEN s IN (0, 1) THEN 0.9 ELSE 0.8 END::double AS confidence FROM o WHERE s <> 4""")
def exif_dates(spark, d):
    day = F.date_format("o_orderdate", "yyyy:MM:dd")
    original = _case(F.col("o_orderkey"), F.concat(day, F.lit(" 10:11:12")), F.concat(F.lit(" "), day, F.lit(" 10:11:12+02:00")), "0000:00:00 00:00:00", "   ", None)
    created = _case(F.col("o_orderkey"), F.concat(day, F.lit(" 20:00:00")), None, F.concat(day, F.lit(" 10:11:12")), F.concat(day, F.lit(" 10:11:12")), "1904:01:01 00:00:00")
    got = n.exif_datetime(original.cast("string"), created.cast("string"))
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").select(F.col("o_orderkey").alias("id"), F.date_format(got["at"], "yyyy-MM-dd'T'HH:mm:ss").alias("moment"), got["confidence"].alias("confidence")).where("moment IS NOT NULL")


@query("""WITH p AS (SELECT DISTINCT id, round(lat, 4) AS lat, round(lon, 4) AS lon FROM place_clusters WHERE lat BETWEEN -80 AND 80 AND lon BETWEEN -170 AND 170 AND NOT (round(lat, 4) = 0 AND round(lon, 4) = 0) AND NOT isnan(lat) AND NOT isnan(lon))
SELECT id, CASE WHEN id % 3 = 0 THEN lat + 1 ELSE CASE WHEN id % 7 = 1 THEN NULL ELSE lat END END AS lat, CASE WHEN id % 3 = 0 THEN lon - 1 ELSE CASE WHEN id % 7 = 1 THEN NULL ELSE lon END END AS lon,
CASE WHEN id % 3 = 0 THEN 'sidecar' WHEN id % 7 = 1 THEN NULL ELSE 'exif' END AS source FROM p""")
def gps_sources(spark, d):
    p = _rec(spark, d, "place_clusters", "id", "lat", "lon").select("id", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))
    p = p.where("lat BETWEEN -80 AND 80 AND lon BETWEEN -170 AND 170 AND NOT (lat = 0 AND lon = 0) AND NOT isnan(lat) AND NOT isnan(lon)")
    none = F.col("id") % 7 == 1
    text = lambda c: F.when(none & (F.lit(c) == "lat"), "north by sea").otherwise(F.abs(c).cast("string"))
    exif = n.gps_from_exif(text("lat"), F.when(F.col("lat") < 0, " South").otherwise("N"), text("lon"), F.when(F.col("lon") < 0, "W").otherwise("East"), F.lit("12.5 m"))
    side = F.when(F.col("id") % 3 == 0, F.struct((F.col("lat") + 1).alias("lat"), (F.col("lon") - 1).alias("lon")))
    g = n.gps(side, exif)
    return p.select("id", g["lat"].alias("lat"), g["lon"].alias("lon"), g["source"].alias("source"))


@query("""WITH o AS (SELECT o_orderkey AS id, epoch(o_orderdate::timestamp)::bigint + o_orderkey AS e FROM orders)
SELECT id, strftime(make_timestamp(e * 1000000), '%Y-%m-%dT%H:%M:%S') AS utc, strftime(to_timestamp(e) AT TIME ZONE 'Europe/Madrid', '%Y-%m-%dT%H:%M:%S') AS madrid FROM o""")
def wall_clocks(spark, d):
    e = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").select(F.col("o_orderkey").alias("id"), n.wall_clock(e, None).alias("utc"), n.wall_clock(e, "Europe/Madrid").alias("madrid"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderdate::timestamp AS t, o_orderkey % 4 AS s, (o_orderkey % 11) / 10.0 AS m FROM orders)
SELECT id, CASE s WHEN 0 THEN strftime(t + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(t, '%Y-%m-%dT10:11:12') WHEN 2 THEN strftime(t, '%Y-%m-%dT09:05:07') ELSE strftime(t + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') END AS moment,
CASE s WHEN 0 THEN 'takeout_json' WHEN 1 THEN 'exif' WHEN 2 THEN 'filename' ELSE 'mtime' END AS source, round(CASE s WHEN 0 THEN least(0.97, 0.6 + m * 0.37) WHEN 1 THEN 0.9 WHEN 2 THEN 0.9 ELSE 0.2 END, 6)::double AS confidence FROM o""")
def dates_resolved(spark, d):
    """All candidates of a file's date and the first of the priority that has a value."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate").withColumn("s", F.col("o_orderkey") % 4)
    e, ymd = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")), F.date_format("o_orderdate", "yyyyMMdd")
    exif = n.exif_datetime(F.when(F.col("s") <= 1, F.concat(F.date_format("o_orderdate", "yyyy:MM:dd"), F.lit(" 10:11:12"))), F.lit(None).cast("string"))
    name = filename_date(F.when(F.col("s") <= 2, F.concat(F.lit("IMG_"), ymd, F.lit("_090507.jpg"))))
    c = n.date_candidates(F.when(F.col("s") == 0, e + 3600).otherwise(0), (F.col("o_orderkey") % 11) / 10.0, exif, name, e + 7200)
    got = n.resolve_date(c, ["takeout_json", "exif", "filename", "mtime"])
    return o.select(F.col("o_orderkey").alias("id"), got["at"].alias("moment"), got["source"].alias("source"), F.round(got["confidence"], 6).alias("confidence"))


@query("""WITH o AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y-02-31') WHEN 4 THEN strftime(o_orderdate, '%Y-13') ELSE strftime(o_orderdate, '%d.%m.%Y') END AS t FROM orders)
SELECT id, CASE WHEN id % 6 IN (0, 1, 2, 3) THEN t END AS kept FROM o""")
def manual_dates(spark, d):
    f = lambda p: F.date_format("o_orderdate", p)
    t = _case(F.col("o_orderkey"), f("yyyy"), f("yyyy-MM"), f("yyyy-MM-dd"), F.concat(f("yyyy"), F.lit("-02-31")), F.concat(f("yyyy"), F.lit("-13")), f("dd.MM.yyyy"))
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").select(F.col("o_orderkey").alias("id"), n.manual_date(t).alias("kept"))


@query(f"""WITH {_F} SELECT id, (1000000000 + id)::bigint AS taken_time, CASE WHEN id % 3 = 0 THEN id % 90 + 0.5 WHEN id % 3 = 1 THEN id % 80 + 0.25 END::double AS lat, CASE WHEN id % 3 = 0 THEN -(id % 180) - 0.5 WHEN id % 3 = 1 THEN id % 170 + 0.25 END::double AS lon FROM f WHERE id % 4 <> 3
UNION ALL SELECT id, NULL, NULL, NULL FROM f WHERE id % 4 = 3""")
def sidecar_values(spark, d):
    i = F.col("id")
    place = lambda lat, lon: F.format_string('{"latitude": %s, "longitude": %s}', lat.cast("string"), lon.cast("string"))
    zero = F.lit('{"latitude": 0.0, "longitude": 0.0}')
    first = F.when(i % 3 == 0, place(i % 90 + 0.5, -(i % 180) - 0.5)).otherwise(zero)
    second = F.when(i % 3 == 1, place(i % 80 + 0.25, i % 170 + 0.25)).otherwise(zero)
    text = F.when(i % 4 == 3, F.lit("{broken")).otherwise(F.format_string('{"photoTakenTime": {"timestamp": "%s"}, "geoData": %s, "geoDataExif": %s}', (i + 1_000_000_000).cast("string"), first, second))
    s = readers.sidecar(text)
    return _files(spark, d, "id").select("id", s["taken_time"].alias("taken_time"), s["lat"].alias("lat"), s["lon"].alias("lon"))


# --- Numbers, boxes and quality (P24-P26, N6-N12, N21, N24, F19, F20, R14) --------------------------------------


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN l_quantity::bigint::varchar || '.0' WHEN 1 THEN (l_quantity + 0.25)::double::varchar WHEN 2 THEN 'n/a' WHEN 3 THEN NULL ELSE ' ' || l_quantity::bigint::varchar || ' ' END AS t, l_quantity AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 IN (0, 4) THEN v::bigint END AS whole, CASE WHEN l_linenumber % 5 = 1 THEN (v + 0.25)::double END AS part,
CASE WHEN l_linenumber > 0 THEN least(100, floor(100 * v / (l_linenumber * 10))) ELSE 0 END::bigint AS percent FROM l""")
def tag_numbers(spark, d):
    v = F.col("l_quantity")
    t = _case(F.col("l_linenumber"), F.concat(v.cast("long"), F.lit(".0")), (v + 0.25).cast("double").cast("string"), "n/a", None, F.concat(F.lit(" "), v.cast("long"), F.lit(" ")))
    got = n.number(t.cast("string"))
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", got["whole"].alias("whole"), got["part"].alias("part"), n.percent(v, F.col("l_linenumber") * 10).cast("long").alias("percent"))


@query("""WITH l AS (SELECT o_orderkey, floor(o_totalprice / 10)::bigint AS s FROM orders), x AS (SELECT o_orderkey, s, unnest([0.15, 0.5, 0.85]) AS f FROM l WHERE o_orderkey % 7 <> 2),
o AS (SELECT o_orderkey, f, floor(greatest(0.0, least(s * f, s - 0.05)) * 1000 + 1e-6)::bigint AS ms FROM x)
SELECT o_orderkey, string_agg(printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000), ' ' ORDER BY f) AS offsets FROM o GROUP BY ALL
UNION ALL SELECT o_orderkey, '00:00:01' FROM l WHERE o_orderkey % 7 = 2""")
def frame_offsets(spark, d):
    s = F.when(F.col("o_orderkey") % 7 != 2, F.floor(F.col("o_totalprice") / 10).cast("double"))
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", F.array_join(n.video_offsets(s, 3), " ").alias("offsets"))


_BOXES = "x AS (SELECT DISTINCT id, box_x AS x, box_y AS y, box_w AS w, box_h AS h FROM animal_detections WHERE box_x IS NOT NULL AND box_y IS NOT NULL AND box_w IS NOT NULL AND box_h IS NOT NULL)"


@query(f"""WITH {_BOXES}, s AS (SELECT *, greatest(least(x + w, x + 10 + w) - greatest(x, x + 10), 0) * greatest(least(y + h, y + 4 + h) - greatest(y, y + 4), 0) AS shared, 2 * w * h AS both_ FROM x)
SELECT id, round(CASE WHEN w > 0 AND h > 0 AND both_ - shared > 0 THEN shared / (both_ - shared)::double ELSE 0 END, 6) AS iou, round(shared / greatest(1, w * h)::double, 6) AS fraction,
round(1 - greatest(least(x + w, 400) - greatest(x, 0), 0) * greatest(least(y + h, 300) - greatest(y, 0), 0) / greatest(1, w * h)::double, 6) AS clipped,
y AS x1, 300 - x - w AS y1, h AS w1, 400 - y - h AS x3, x AS y3 FROM s""")
def box_rules(spark, d):
    """Overlaps with a shifted box (N6, N7), what lies outside the frame (N9), boxes of turned frames."""
    a = {k: F.col(f"box_{k}") for k in "xywh"}
    b = {"x": a["x"] + 10, "y": a["y"] + 4, "w": a["w"], "h": a["h"]}
    one, three = (n.rotate_back(a, t, F.lit(400), F.lit(300)) for t in (1, 3))
    t = _rec(spark, d, "animal_detections", "id", *[f"box_{k}" for k in "xywh"]).na.drop()
    return t.select(
        "id", F.round(n.iou_or_zero(a, b), 6).alias("iou"), F.round(n.overlap_fraction(a, b), 6).alias("fraction"), F.round(n.clipped_fraction(a, F.lit(400), F.lit(300)), 6).alias("clipped"),
        one["x"].alias("x1"), one["y"].alias("y1"), one["w"].alias("w1"), three["x"].alias("x3"), three["y"].alias("y3"),
    )


@query("""WITH x AS (SELECT DISTINCT id, det_score AS s, box_w AS w, box_h AS h FROM faces WHERE det_score IS NOT NULL AND NOT isnan(det_score) AND box_w IS NOT NULL AND box_h IS NOT NULL),
g AS (SELECT id, CASE WHEN s < 0.6 THEN 'score' WHEN least(w, h) < 30 THEN 'size' WHEN (id % 10) / 20.0 > 0.4 THEN 'clipped' WHEN (id % 7) * 10 < 20 THEN 'focus' WHEN (id % 9) / 10.0 < 0.2 THEN 'exposure' ELSE 'accepted' END AS gate FROM x)
SELECT gate, count(*) AS faces FROM g GROUP BY 1""")
def quality_gates(spark, d):
    """The first gate that each face fails."""
    i = F.col("id")
    t = _rec(spark, d, "faces", "id", "det_score", "box_w", "box_h").na.drop().where("NOT isnan(det_score)")
    gate = rejection(F.col("det_score"), F.least("box_w", "box_h"), (i % 10) / 20.0, (i % 7) * 10, (i % 9) / 10.0, {"score": 0.6, "size": 30, "clipped": 0.4, "focus": 20, "exposure": 0.2})
    return t.groupBy(gate.alias("gate")).agg(F.count("*").alias("faces"))


@query("""WITH x AS (SELECT DISTINCT id, det_score AS s FROM faces WHERE det_score IS NOT NULL AND NOT isnan(det_score)), c AS (SELECT id, greatest(0.0, least(1.0, (0.40 * s + 0.35 * (id % 11) / 10.0 + 0.25 * (id % 5) / 4.0) * (1 - (id % 3) / 4.0))) AS c FROM x)
SELECT id, round(c, 6) AS score, CASE WHEN c >= 0.55 THEN 'HIGH' WHEN c < 0.18 THEN 'LOW_QUALITY' ELSE 'BORDERLINE' END AS tier FROM c""")
def composite_scores(spark, d):
    i = F.col("id")
    s = n.composite_score(F.col("det_score"), (i % 11) / 10.0, (i % 5) / 4.0, (i % 3) / 4.0)
    return _rec(spark, d, "faces", "id", "det_score").na.drop().where("NOT isnan(det_score)").select("id", F.round(s, 6).alias("score"), n.tier(s).alias("tier"))


@query("""WITH x AS (SELECT DISTINCT id, lower(trim(species)) AS sp, det_score AS s FROM animal_detections)
SELECT id, coalesce(s >= CASE sp WHEN 'cat' THEN 0.4 WHEN 'dog' THEN 0.7 ELSE 0.5 END, false) AS eligible FROM x""")
def eligible_animals(spark, d):
    from kestrel.operators.clusters import eligible

    return _rec(spark, d, "animal_detections", "id", "species", "det_score").select("id", eligible(F.coalesce(F.lower(F.trim("species")), F.lit("")), F.col("det_score"), {"cat": 0.4, "dog": 0.7}).alias("eligible"))


@query("""WITH u AS (SELECT vec_id, embedding::double[] AS e FROM embeddings) SELECT vec_id, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first, round(e[len(e)] / sqrt(list_dot_product(e, e)), 6) AS last, 1.0::double AS length FROM u""")
def unit_vectors(spark, d):
    u = n.unit(F.col("embedding"))
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.round(F.element_at(u, 1), 6).alias("first"), F.round(F.element_at(u, -1), 6).alias("last"), F.round(n.norm(u), 6).alias("length"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'documents+ocr' WHEN 1 THEN 'ocr' ELSE '' END AS wanted FROM customer""")
def wanted_keys(spark, d):
    parts = _case(F.col("c_custkey"), F.array(F.lit("ocr"), F.lit("documents"), F.lit("ocr")), F.array(F.lit("ocr")), F.array().cast("array<string>"))
    return table(spark, d, "customer", "c_custkey").select("c_custkey", n.wanted_key(parts).alias("wanted"))


@query("""WITH t AS (SELECT file_id, error FROM (SELECT DISTINCT * FROM doc_text)), m AS (SELECT CASE file_id % 5 WHEN 0 THEN 'unsupported legacy format .doc' WHEN 1 THEN 'media exceeds the size limit' WHEN 2 THEN 'no text layer' WHEN 3 THEN 'unreadable: BadZipFile' ELSE error END AS e FROM t)
SELECT coalesce(regexp_matches(e, '^(unsupported|media exceeds|no text layer)'), false) AS clean, count(*) AS n FROM m GROUP BY 1""")
def clean_skips(spark, d):
    e = _case(F.col("file_id"), "unsupported legacy format .doc", "media exceeds the size limit", "no text layer", "unreadable: BadZipFile", F.col("error"))
    t = table(spark, d, "doc_text").distinct()
    return t.groupBy(F.coalesce(snapshots.clean_skip(e.cast("string")), F.lit(False)).alias("clean")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, p_size < 10 AND (p_partkey % 10) / 10.0 >= 0.5 AS scanned, lower(CASE p_partkey % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'docx' WHEN 2 THEN 'jpg' ELSE 'exe' END) IN ('pdf', 'docx') AS documents, p_partkey % 4 IN (0, 1, 2) AS any_reader FROM part""")
def reading_rules(spark, d):
    """Which pages are pictures of text (F21) and which files a reader takes."""
    ext = _case(F.col("p_partkey"), "PDF", "docx", "jpg", "exe")
    return table(spark, d, "part", "p_partkey", "p_size").select(
        "p_partkey", readers.looks_scanned(F.col("p_size") + 30, (F.col("p_partkey") % 10) / 10.0).alias("scanned"),
        readers.eligible(ext).alias("documents"), readers.eligible(ext, {"documents", "ocr"}).alias("any_reader"),
    )


# --- Words of queries (N15-N17, N20) -----------------------------------------------------------------------------


@query(r"""WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '^[\x20-\x7e\náéíóúüñÁÉÍÓÚÜÑ¿¡«»]*$'))
SELECT doc_id, array_to_string(regexp_extract_all(regexp_replace(strip_accents(lower(text)), '''', '', 'g'), '[a-z0-9]+'), ' ') AS words,
len(list_filter(regexp_extract_all(regexp_replace(strip_accents(lower(text)), '''', '', 'g'), '[a-z0-9]+'), lambda x: x IN ('the', 'this', 'that', 'these', 'those', 'is', 'are', 'was', 'were', 'with', 'without', 'beside', 'besides', 'near', 'by', 'at', 'of', 'and', 'or', 'from', 'to', 'in', 'on', 'under', 'over', 'between', 'inside', 'outside', 'during'))) > 0 AS english FROM d""")
def plain_texts(spark, d):
    @F.pandas_udf("words string, english boolean")
    def words(text: pd.Series) -> pd.DataFrame:
        w = text.map(q.plain_words)
        return pd.DataFrame({"words": w, "english": text.map(q.clearly_english).astype(bool)})

    t = table(spark, d, "documents", "doc_id", "text").distinct().where(F.col("text").rlike(r"^[\x20-\x7e\náéíóúüñÁÉÍÓÚÜÑ¿¡«»]*$"))
    return t.withColumn("w", words("text")).select("doc_id", "w.words", "w.english")


@query("""WITH p AS (SELECT a.n_name AS a, b.n_name AS b, lower(a.n_name) AS x, lower(b.n_name) AS y FROM nation a, nation b)
SELECT a, b, levenshtein(x, y)::int AS distance, CASE WHEN x = y THEN 2 WHEN length(x) >= 4 AND starts_with(y, x) THEN 1 WHEN length(x) >= 5 AND abs(length(x) - length(y)) <= 1 AND levenshtein(x, y) <= 1 THEN 1 ELSE 0 END::int AS grade FROM p""")
def names_met(spark, d):
    """How each nation's name, as typed, meets each other's (N16, N17); 25 by 25 rows."""
    @F.pandas_udf("distance int, grade int")
    def meet(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"distance": [q.edit_distance(x, y) for x, y in zip(a, b)], "grade": [q.meets(x, y) for x, y in zip(a, b)]})

    t = table(spark, d, "nation", "n_name")
    p = t.select(F.col("n_name").alias("a")).crossJoin(F.broadcast(t.select(F.col("n_name").alias("b"))))
    return p.withColumn("m", meet(F.lower("a"), F.lower("b"))).select("a", "b", "m.distance", "m.grade")


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 5 AS s FROM orders)
SELECT o_orderkey, CASE s WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 3 END::bigint AS person, CASE s WHEN 0 THEN 10 WHEN 1 THEN 5 WHEN 2 THEN 0 WHEN 3 THEN 5 END::int AS start, s <> 2 AS exact, CASE s WHEN 0 THEN 'photos of by the sea' WHEN 1 THEN 'show ''s bike' WHEN 2 THEN 'at home' WHEN 3 THEN '' END AS rest FROM t WHERE s <> 4""")
def people_mentioned(spark, d):
    """People named in typed queries: whole names, possessives, beginnings, marks; names that two share are left alone."""
    people = F.create_map(F.lit(1).cast("long"), F.lit("Beatriz Solana"), F.lit(2).cast("long"), F.lit("Óscar"), F.lit(3).cast("long"), F.lit("Ana Ruiz"), F.lit(4).cast("long"), F.lit("Ana Vega"))
    text = _case(F.col("o_orderkey"), "photos of Beatriz Solana by the sea", "show oscar's bike", "beat sola at home", "with ana ruiz", "ana on a hill")
    spark.udtf.register("find_mentions", q.MentionFinder)
    table(spark, d, "orders", "o_orderkey").select("o_orderkey", text.alias("text"), people.alias("people")).createOrReplaceTempView("typed_queries")
    got = spark.sql("SELECT o_orderkey, text, m.person, m.start, m.end, m.exact FROM typed_queries, LATERAL find_mentions(text, people) m")

    @F.pandas_udf("string")
    def rest(text: pd.Series, person: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([q.without_mentions(t, [q.Mention(p, a, b, True)]) for t, p, a, b in zip(text, person, start, end)])

    return got.select("o_orderkey", "person", "start", "exact", rest("text", "person", "start", "end").alias("rest"))


# --- Readers (S10, S11, S15-S21, S26) ------------------------------------------------------------------------------


@query("""WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND strlen(text) <= 65536)
SELECT doc_id, sha256(strlen(text)::varchar || text) AS fast, sha256(text) AS whole FROM d""")
def content_hashes(spark, d):
    t = table(spark, d, "documents", "doc_id", "text").distinct().where("text IS NOT NULL AND octet_length(text) <= 65536").select("doc_id", F.encode("text", "utf-8").alias("content"))
    return t.select("doc_id", readers.fast_hash(F.col("content"), F.octet_length("content")).alias("fast"), readers.full_hash(F.col("content")).alias("whole"))


def _written(kind: str, a: str, b: str) -> bytes:
    """A small file of a kind that says ``a`` and ``b``."""
    zipped = {
        "docx": {"word/document.xml": "<d><p><t>{a}</t></p></d>", "word/footer1.xml": "<d><p><t>{b}</t></p></d>"},
        "pptx": {"ppt/slides/slide10.xml": "<d><p><t>{b}</t></p></d>", "ppt/slides/slide2.xml": "<d><p><t>{a}</t></p></d>"},
        "xlsx": {"xl/sharedStrings.xml": "<s><si><t>{a}</t></si></s>", "xl/worksheets/sheet1.xml": '<s><row><c t="s"><v>0</v></c></row><row><c t="inlineStr"><is><t>{b}</t></is></c></row></s>'},
        "odt": {"content.xml": "<d><p><span>{a}</span></p><p><span>{b}</span></p></d>"},
    }
    if kind in zipped:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, xml in zipped[kind].items():
                z.writestr(name, xml.format(a=a, b=b))
        return out.getvalue()
    if kind == "html":
        return f"<html><head><title>no</title></head><body><p>{a}</p><script>no</script><p>{b}</p></body></html>".encode("utf-16")
    if kind == "ipynb":
        return json.dumps({"cells": [{"source": [a, ""], "outputs": ["no"]}, {"source": b}]}).encode()
    return f"{a}\n{b}".encode("cp1252")


@query("""SELECT p_partkey, CASE p_partkey % 9 WHEN 7 THEN 'unsupported legacy format .doc' WHEN 8 THEN 'unsupported format .exe' END AS error,
CASE WHEN p_partkey % 9 IN (7, 8) THEN '' WHEN p_partkey % 9 IN (0, 1) THEN p_name || '|' || p_brand WHEN p_partkey % 9 = 5 THEN p_name || chr(10) || chr(10) || p_brand ELSE p_name || chr(10) || p_brand END AS text FROM part""")
def documents_read(spark, d):
    """One file of every kind of document, written and read (S15-S22, S26); blocks are joined by a bar."""
    kinds = ["docx", "pptx", "xlsx", "odt", "html", "ipynb", "txt", "doc", "exe"]

    @F.pandas_udf("binary")
    def write(kind: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_written(*v) for v in zip(kind, a, b)])

    t = table(spark, d, "part", "p_partkey", "p_name", "p_brand").withColumn("ext", _case(F.col("p_partkey"), *kinds))
    t = t.withColumn("path", F.col("p_partkey").cast("string")).withColumn("content", write("ext", "p_name", "p_brand"))
    return readers.extract(t).select(F.col("path").cast("long").alias("p_partkey"), "error", F.array_join(F.transform("blocks", lambda b: b["text"]), "|").alias("text"))

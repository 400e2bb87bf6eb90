"""Numeric expressions: sphere, boxes, vectors, quality, dates of metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def cell(lat: Column, lon: Column, radius_m: float) -> Column:
    """Grid cell of a point; longitude steps follow the point's own latitude, rounding is half to even."""
    dlat = radius_m / METRES_PER_DEGREE
    dlon = radius_m / (METRES_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), F.lit(1e-6)))
    return F.struct(F.rint(lat / dlat).cast("long").alias("y"), F.rint(lon / dlon).cast("long").alias("x"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Shared area of two boxes given as x, y, w, h columns."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Shared area over joint area; the joint area counts as one at least."""
    shared = overlap(a, b)
    return shared / F.greatest(F.lit(1), a["w"] * a["h"] + b["w"] * b["h"] - shared)


def overlap_fraction(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return overlap(a, b) / F.greatest(F.lit(1), a["w"] * a["h"])


def clipped_fraction(box: dict[str, Column], width: Column, height: Column) -> Column:
    """Part of a box beyond the frame."""
    w = F.least(box["x"] + box["w"], width) - F.greatest(box["x"], F.lit(0))
    h = F.least(box["y"] + box["h"], height) - F.greatest(box["y"], F.lit(0))
    return 1 - F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0)) / F.greatest(F.lit(1), box["w"] * box["h"])


def rotate_back(box: dict[str, Column], turns: int, width: Column, height: Column) -> dict[str, Column]:
    """A box found in a frame turned by 90 degree ``turns`` in coordinates of the frame itself."""
    x, y, w, h = box["x"], box["y"], box["w"], box["h"]
    return [box, {"x": y, "y": height - x - w, "w": h, "h": w}, {"x": width - x - w, "y": height - y - h, "w": w, "h": h}, {"x": width - y - h, "y": x, "w": h, "h": w}][turns % 4]


def quality_score(value: Column, mean: Column, std: Column, spread: float = 2.0, high: float = 0.55, low: float = 0.18) -> Column:
    """A norm squashed to 0..1 around its calibration; without spread the middle of the two cuts."""
    z = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (value - mean) / (std * spread)))
    return F.when(std > 0, (z + 1) / 2).otherwise((high + low) / 2)


def composite_score(det: Column, quality: Column, size: Column, clipped: Column) -> Column:
    """Weighted detection, quality and size, less what is clipped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (0.40 * det + 0.35 * quality + 0.25 * size) * (1 - clipped)))


def tier(score: Column, high: float = 0.55, low: float = 0.18) -> Column:
    return F.when(score >= high, "HIGH").when(score < low, "LOW_QUALITY").otherwise("BORDERLINE")


def gps_from_exif(lat: Column, lat_ref: Column, lon: Column, lon_ref: Column, alt: Column) -> Column:
    """``struct<lat, lon, alt>`` of text tags: south and west are negative, 0/0 and unreadable ones NULL."""
    y, x = lat.try_cast("double"), lon.try_cast("double")
    y = F.when(F.upper(F.trim(lat_ref)).startswith("S"), -F.abs(y)).otherwise(y)
    x = F.when(F.upper(F.trim(lon_ref)).startswith("W"), -F.abs(x)).otherwise(x)
    ok = y.isNotNull() & x.isNotNull() & ~((y == 0) & (x == 0)) & y.between(-90, 90) & x.between(-180, 180)
    return F.when(ok, F.struct(y.alias("lat"), x.alias("lon"), alt.try_cast("double").alias("alt")))


def exif_datetime(original: Column, created: Column) -> Column:
    """``struct<at, confidence>``: the original date (0.9) before that of creation (0.8), years 1990 to 2035."""

    def one(raw: Column, conf: float) -> Column:
        t = F.call_function("try_to_timestamp", F.substring(F.trim(raw), 1, 19), F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")
        return F.when(F.year(t).between(1990, 2035), F.struct(t.alias("at"), F.lit(conf).alias("confidence")))

    return F.coalesce(one(original, 0.9), one(created, 0.8))


def wall_clock(epoch: Column, zone: str | None) -> Column:
    """Clock time of an epoch in a zone, ISO text."""
    t = F.timestamp_seconds(epoch)
    return F.date_format(F.from_utc_timestamp(t, zone or "UTC"), "yyyy-MM-dd'T'HH:mm:ss")


def resolve_date(candidates: dict[str, Column], priority: list[str]) -> Column:
    """The first source in the order of priority that has a value; confidences aren't compared."""
    return F.coalesce(*[F.when(candidates[s].isNotNull(), F.struct(candidates[s]["at"].alias("at"), F.lit(s).alias("source"), candidates[s]["confidence"].alias("confidence"))) for s in priority if s in candidates])


def date_candidates(takeout: Column, match: Column, exif: Column, filename: Column, mtime: Column, zone: str | None = None) -> dict[str, Column]:
    """What each source says of a file's date, ``struct<at, confidence>`` or NULL (P10): the sidecar's epoch, surer the better the
    sidecar was matched; the metadata's and the file name's own; the time of the file."""
    clock = lambda e, c: F.when(e.isNotNull(), F.struct(wall_clock(e, zone).alias("at"), c.alias("confidence")))
    said = lambda c: F.when(c.isNotNull(), F.struct(F.date_format(c["at"], "yyyy-MM-dd'T'HH:mm:ss").alias("at"), c["confidence"].alias("confidence")))
    sure = F.least(F.lit(0.97), 0.6 + match * 0.37)
    return {"takeout_json": clock(F.when(takeout != 0, takeout), sure), "exif": said(exif), "filename": said(filename), "mtime": clock(mtime, F.lit(0.2))}


def gps(sidecar: Column, exif: Column) -> Column:
    """``struct<lat, lon, alt, source>``: a place that the sidecar gives goes before that of the metadata (P5)."""
    one = lambda c, alt, source: F.when(c.isNotNull() & c["lat"].isNotNull(), F.struct(c["lat"].alias("lat"), c["lon"].alias("lon"), alt.alias("alt"), F.lit(source).alias("source")))
    return F.coalesce(one(sidecar, F.lit(None).cast("double"), "sidecar"), one(exif, exif["alt"], "exif"))


def number(text: Column) -> Column:
    """``struct<whole bigint, part double>`` of what a tag says: ``whole`` if it is integral, else ``part``; both NULL if it is no
    finite number (P25)."""
    v = text.try_cast("double")
    v = F.when(~F.isnan(v) & (F.abs(v) < 9e18), v)
    return F.struct(F.when(v == F.floor(v), v.cast("long")).alias("whole"), F.when(v != F.floor(v), v).alias("part"))


def percent(done: Column, total: Column) -> Column:
    """Whole percent of a job, 0 without a total."""
    return F.when(total > 0, F.least(F.lit(100), F.floor(100 * done / total))).otherwise(0)


def wanted_key(parts: Column) -> Column:
    """A set of readers as one text, sorted."""
    return F.array_join(F.sort_array(F.array_distinct(parts)), "+")


def iou_or_zero(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Shared area over joint area; boxes without an area share nothing."""
    shared = overlap(a, b)
    joint = a["w"] * a["h"] + b["w"] * b["h"] - shared
    return F.when((a["w"] > 0) & (a["h"] > 0) & (b["w"] > 0) & (b["h"] > 0) & (joint > 0), shared / joint).otherwise(0.0)


def manual_date(text: Column) -> Column:
    """A date given by hand: YYYY, YYYY-MM or YYYY-MM-DD as it stands, else NULL; days go to 31 in any month."""
    month, day = F.substring(text, 6, 2).try_cast("int"), F.substring(text, 9, 2).try_cast("int")
    ok = text.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$") & (F.coalesce(month, F.lit(1)).between(1, 12)) & (F.coalesce(day, F.lit(1)).between(1, 31))
    return F.when(ok, text)


def video_offsets(duration: Column, n: int) -> Column:
    """Where to sample ``n`` frames: between 0.15 and 0.85 of the duration, as HH:MM:SS.mmm, each once."""
    at = [0.5] if n == 1 else [0.15 + 0.7 * k / (n - 1) for k in range(n)]

    def text(f: float) -> Column:
        ms = F.floor(F.greatest(F.lit(0.0), F.least(duration * f, duration - 0.05)) * 1000 + 1e-6).cast("long")
        pad = lambda c, w: F.lpad(c.cast("string"), w, "0")
        return F.concat(pad(F.expr("0") + F.floor(ms / 3_600_000), 2), F.lit(":"), pad(F.floor(ms / 60_000) % 60, 2), F.lit(":"), pad(F.floor(ms / 1000) % 60, 2), F.lit("."), pad(ms % 1000, 3))

    return F.when(duration > 0, F.array_distinct(F.array(*[text(f) for f in at]))).otherwise(F.array(F.lit("00:00:01")))

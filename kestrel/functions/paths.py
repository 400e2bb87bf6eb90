"""Names, extensions and dates of files as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of each media type, and what a walk ignores.
MEDIA = {
    "image": ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tif", "tiff", "heic", "heif", "jfif", "raw", "cr2", "nef", "arw", "dng"],
    "video": ["mp4", "mov", "avi", "wmv", "mkv", "3gp", "3g2", "m4v", "mpg", "mpeg", "flv", "webm", "mts", "m2ts", "swf"],
    "audio": ["opus", "mp3", "m4a", "aac", "wav", "flac", "ogg", "amr", "wma"],
    "document": ["pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "txt", "csv", "html", "rtf", "ipynb", "md", "mhtml"],
    "archive": ["zip", "rar", "7z", "tar", "gz", "apk"],
}
IGNORED_EXTENSIONS = ["json", "db", "thm", "ini", "nomedia", "part", "tmp"]
IGNORED_NAMES = ["thumbs.db", "desktop.ini", ".nomedia", ".picasa.ini", "picasa.ini", ".ds_store"]
IGNORED_PARTS = ["thumbindex", "thumbdata", "database_uuid", "nomedia", ".com.google.chrome."]
#: Suffixes of edited copies.
EDITED = ["-edited", "-editado", "-ha editado", "-bearbeitet", "-modifié", "-modifiée", "-bewerkt", "-editat"]


def basename(path: Column | str) -> Column:
    """Last part of a path with either separator."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def dirname(path: Column | str) -> Column:
    """All before the last slash, '' at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(name: Column | str) -> Column:
    """Lower case, after the last dot; a name that only begins with a dot has none (S3)."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def media_type(ext: Column) -> Column:
    """image, video, audio, document, archive or other (P1); NULL counts as other."""
    e, out = F.lower(ext), F.lit("other")
    for kind, exts in MEDIA.items():
        out = F.when(e.isin(exts), kind).otherwise(out)
    return out


def detected_type(mime: Column) -> Column:
    """Media type of a MIME type, NULL when it says nothing."""
    top = F.lower(F.split_part(mime, F.lit("/"), F.lit(1)))
    return F.when(top.isin("image", "video", "audio"), top).when(F.lower(mime).rlike("pdf|msword|officedocument|opendocument|^text/"), "document").when(F.lower(mime).rlike("zip|rar|7z|x-tar"), "archive")


def corrected_type(kind: Column, detected: Column) -> Column:
    """The media type, where it is only ``other`` the one that the bytes show."""
    return F.when((kind == "other") & detected.isNotNull(), detected).otherwise(kind)


def type_mismatch(detected: Column, ext: Column) -> Column:
    """Whether a file's detected class is another text than its extension (P22). The two are of different kinds, so it is true of
    nearly every file whose class is known; kept as it is."""
    return F.coalesce((detected != "") & (ext != "") & (detected != ext), F.lit(False))


def ignored(name: Column) -> Column:
    """Index and housekeeping leftovers."""
    low = F.lower(name)
    return low.isin(IGNORED_NAMES) | extension(name).isin(IGNORED_EXTENSIONS) | reduce(lambda a, b: a | b, [low.contains(p) for p in IGNORED_PARTS])


def name_tokens(query: str, most: int = 8) -> list[str]:
    """Different lower-case tokens of a file name query, at most eight."""
    return list(dict.fromkeys(query.lower().split()))[:most]


def matches_name(path: Column, query: str) -> Column:
    low = F.lower(basename(path))
    return reduce(lambda a, b: a & b, [low.contains(t) for t in name_tokens(query)], F.lit(True))


#: Shapes of dates in file names (lower case), from the most to the least certain: what is read, confidence, shape.
#: ymd: year, month, day and clock in order; ydm: the same, else with month and day exchanged; two: two numbers, then the
#: year; ms: milliseconds since 1970.
SHAPES = [
    ("ymd", 0.9, r"(?<![0-9])(20[0-9]{2}|19[0-9]{2})[-.]([0-9]{2})[-.]([0-9]{2})\s+at\s+([0-9]{2})[.:]([0-9]{2})[.:]([0-9]{2})"),
    ("ymd", 0.9, r"(?<![0-9])(20[0-9]{2}|19[0-9]{2})([0-9]{2})([0-9]{2})_([0-9]{2})_([0-9]{2})_([0-9]{2})"),
    ("ymd", 0.9, r"(?<![0-9])(20[0-9]{2}|19[0-9]{2})([0-9]{2})([0-9]{2})[_\-\.t]([0-9]{2})([0-9]{2})([0-9]{2})"),
    ("ymd", 0.9, r"(?<![0-9])(20[0-9]{2}|19[0-9]{2})[\-:\.]([0-9]{2})[\-:\.]([0-9]{2})[ _t]([0-9]{2})[\-:\.]([0-9]{2})[\-:\.]([0-9]{2})"),
    ("ymd", 0.75, r"(?<![0-9])(20[0-9]{2}|19[0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})[0-9]{0,3}(?![0-9])"),
    ("ydm", 0.75, r"(?<![0-9])(20[0-9]{2}|19[0-9]{2})-([0-9]{2})-([0-9]{2})-([0-9]{2})-([0-9]{2})-([0-9]{2})(?![0-9])"),
    ("ymd", 0.65, r"(?<![0-9])(20[0-9]{2}|19[0-9]{2})([0-9]{2})([0-9]{2})[-_]([0-9]{2})([0-9]{2})(?![0-9])"),
    ("two", 0.65, r"(?<![0-9])([0-9]{1,2})[-_.]([0-9]{1,2})[-_.](20[0-9]{2}|19[0-9]{2})[_\-]([0-9]{2})[-_.:]([0-9]{2})(?![0-9])"),
    ("ymd", 0.6, r"(?<![0-9])(20[0-9]{2}|19[0-9]{2})([0-9]{2})([0-9]{2})-wa[0-9]+"),
    ("ms", 0.6, r"(?:fb_img|faceapp|picture|signal|pano|img|vid)[ _\-]?(1[0-9]{12})(?![0-9])"),
    ("ydm", 0.55, r"(?<![0-9])(20[0-9]{2}|19[0-9]{2})[\-_\.]([0-9]{2})[\-_\.]([0-9]{2})(?![0-9])"),
    ("two", 0.55, r"(?<![0-9])([0-9]{1,2})[-_.]([0-9]{1,2})[-_.](20[0-9]{2}|19[0-9]{2})(?![0-9])"),
    ("ms", 0.4, r"(?<![0-9])(1[0-9]{12})(?![0-9])"),
    ("ymd", 0.4, r"(?<![0-9])(20[0-9]{2}|19[0-9]{2})([0-9]{2})([0-9]{2})(?![0-9])"),
]


def _moment(y, mo, d, h=None, mi=None, s=None) -> Column:
    """A calendar moment, NULL where there is no such."""
    part = lambda c: F.lit(0) if c is None else c.try_cast("int")
    return F.call_function("try_make_timestamp_ntz", part(y), part(mo), part(d), part(h), part(mi), part(s).cast("decimal(16,6)"))


def _millis(n: Column) -> Column:
    """A Unix count of milliseconds from 1e12 up to 1.999999999999e12 in UTC, whole seconds."""
    ms = n.try_cast("long")
    t = F.to_utc_timestamp(F.timestamp_seconds(F.floor(ms / 1000)), "UTC").cast("timestamp_ntz")
    return F.when(ms.between(1_000_000_000_000, 1_999_999_999_999), t)


def filename_date(name: Column, day_first: bool = True) -> Column:
    """``struct<at timestamp_ntz, confidence double>`` read from a file name, NULL when it tells none.

    Shapes are tried from the most to the least certain; one that matches but is no real date gives way to the next.
    Two leading numbers are day and month as far as one of them exceeds 12; else ``day_first`` decides and the
    confidence falls by 0.1.
    """
    low, tries = F.lower(name), []

    def take(at: Column, confidence: Column) -> None:
        tries.append(F.struct(at.alias("at"), confidence.cast("double").alias("confidence")))

    for kind, sure, shape in SHAPES:
        g = [F.nullif(F.regexp_extract(low, shape, k + 1), F.lit("")) for k in range(re.compile(shape).groups)]
        if kind == "ms":
            take(_millis(g[0]), F.lit(sure))
        elif kind == "two":
            x, z = g[0].try_cast("int"), g[1].try_cast("int")
            swap = F.when(x > 12, False).when(z > 12, True).otherwise(not day_first)  # whether the month leads
            take(_moment(g[2], F.when(swap, g[0]).otherwise(g[1]), F.when(swap, g[1]).otherwise(g[0]), *g[3:]), F.when((x <= 12) & (z <= 12), sure - 0.1).otherwise(sure))
        else:
            take(_moment(*g), F.lit(sure))
            if kind == "ydm":
                take(_moment(g[0], g[2], g[1], *g[3:]), F.lit(sure))
    # An array keeps the generated code small; its first real moment of the years 1990 to 2035 is the answer.
    real = F.filter(F.array(*tries), lambda x: F.year(x["at"]).between(1990, 2035))
    return F.get(real, F.lit(0))


def sidecar_names(name: Column) -> Column:
    """Names a sidecar of ``name`` may have: ``array<struct<json, method, confidence, rank>>``."""
    counter = F.regexp_extract(name, r"^(.*)\((\d+)\)(\.[^.]*)?$", 2)
    stem, ext = F.regexp_extract(name, r"^(.*)\((\d+)\)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*)\((\d+)\)(\.[^.]*)?$", 3)
    rx = r"(?i)^(.*?)(" + "|".join(EDITED) + r")(\.[^.]*)?$"
    plain = F.concat(F.regexp_extract(name, rx, 1), F.regexp_extract(name, rx, 3))
    is_edited = name.rlike(rx)

    def c(json: Column, method: str, conf: float, rank: int, when: Column = F.lit(True)) -> Column:
        return F.when(when, F.struct(json.alias("json"), F.lit(method).alias("method"), F.lit(conf).alias("confidence"), F.lit(rank).alias("rank")))

    return F.filter(F.array(
        c(F.concat(name, F.lit(".json")), "exact", 1.0, 0),
        c(F.concat(name, F.lit(".supplemental-metadata.json")), "supplemental", 1.0, 1),
        c(F.concat(stem, ext, F.lit("("), counter, F.lit(").json")), "counter", 0.95, 2, counter != ""),
        c(F.concat(stem, ext, F.lit(".supplemental-metadata("), counter, F.lit(").json")), "counter-suppl", 0.95, 3, counter != ""),
        c(F.concat(plain, F.lit(".json")), "edited", 0.8, 4, is_edited),
        c(F.concat(plain, F.lit(".supplemental-metadata.json")), "edited-suppl", 0.8, 5, is_edited),
    ), lambda x: x.isNotNull())


def sidecar_base(json: Column) -> Column:
    """Media name that a sidecar's own name begins with."""
    bare = F.regexp_replace(json, r"(?i)\.json$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?i)\.supplemental-met[^.]*$", ""), r"\(\d+\)$", "")

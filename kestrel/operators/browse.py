"""Populations, filters, pages and overview figures of a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.functions.paths import dirname, matches_name


def records(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows delivered more than once are one record."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])


def visible(files: DataFrame) -> DataFrame:
    return files.where("present = 1")


def not_hidden(files: DataFrame) -> DataFrame:
    return files.where("present = 1 AND hidden = 0")


def with_dates(files: DataFrame, dates: DataFrame) -> DataFrame:
    """Files with their date record; a file without one is kept."""
    d = records(dates, "file_id").select(F.col("file_id").alias("id"), "best_datetime", "date_source", "date_confidence", F.lit(True).alias("enriched"))
    return files.join(d, "id", "left").withColumn("enriched", F.coalesce("enriched", F.lit(False)))


def media(
    files: DataFrame, dates: DataFrame, *, root: int | None = None, kind: str | None = None, period: str | None = None, name: str = "",
    holding: list[DataFrame] = (), lacking: list[DataFrame] = (),
) -> DataFrame:
    """The browse population under its filters (F2-F6). ``holding``/``lacking``: tables with a ``file_id`` that a file must or must not have."""
    m = with_dates(not_hidden(files), dates)
    if root is not None:
        m = m.where(F.col("root_id") == root)
    if kind:
        m = m.where(F.col("media_type") == kind)
    if period:
        m = m.where(F.col("best_datetime").startswith(period))
    if name.strip():
        m = m.where(matches_name(F.col("rel_path"), name))
    for t in holding:
        m = m.join(t.select(F.col("file_id").alias("id")), "id", "left_semi")
    for t in lacking:
        m = m.join(t.select(F.col("file_id").alias("id")), "id", "left_anti")
    return m


def with_people(files: DataFrame, faces: DataFrame, tags: DataFrame, persons: list[int], key: str = "id") -> DataFrame:
    """Files that show every one of ``persons``, by a good face or tagged by hand (F4): ``faces(file_id, person_id)``,
    ``tags(entity_id, file_id)``. No persons: all files."""
    if not persons:
        return files
    both = faces.select(F.col("file_id").alias(key), "person_id").unionByName(tags.select(F.col("file_id").alias(key), F.col("entity_id").alias("person_id")))
    seen = both.where(F.col("person_id").isin(persons)).groupBy(key).agg(F.countDistinct("person_id").alias("n")).where(F.col("n") == len(set(persons)))
    return files.join(seen.select(key), key, "left_semi")


def neighbours(files: DataFrame) -> DataFrame:
    """``(id, folder, folder_count)``: how many other visible files stand directly in each file's folder."""
    f = not_hidden(files).select("id", "root_id", dirname(F.col("rel_path")).alias("folder"))
    n = f.groupBy("root_id", "folder").agg(F.count("*").alias("n"))
    return f.join(n, ["root_id", "folder"]).select("id", "folder", (F.col("n") - 1).alias("folder_count"))


def flagged(files: DataFrame, geo: DataFrame, vectors: DataFrame) -> DataFrame:
    """``files`` with ``has_gps`` and ``indexed``: whether a position is known, and whether a vector of the present bytes is.
    ``geo(file_id, lat)``, ``vectors(file_id, source_sha256, status)``."""
    g = geo.where("lat IS NOT NULL").select(F.col("file_id").alias("id"), F.lit(True).alias("has_gps")).distinct()
    v = vectors.where("status = 'indexed'").select(F.col("file_id").alias("id"), F.col("source_sha256").alias("sha256"), F.lit(True).alias("indexed")).distinct()
    out = files.join(g, "id", "left").join(v, ["id", "sha256"], "left")
    return out.withColumn("has_gps", F.coalesce("has_gps", F.lit(False))).withColumn("indexed", F.coalesce("indexed", F.lit(False)))


def only(flags: DataFrame, located: bool | None = None, indexed: bool | None = None) -> DataFrame:
    """Files by two flags, each wanted, unwanted or not asked."""
    for name, want in (("has_gps", located), ("indexed", indexed)):
        if want is not None:
            flags = flags.where(F.col(name) == want)
    return flags


def reader_of(extractor: Column) -> Column:
    """Which reader a text came from (P20)."""
    return F.when(extractor.isin("ocr", "pdf-ocr"), "ocr").otherwise("documents")


def located(files: DataFrame, geo: DataFrame) -> DataFrame:
    """``(media_type, files, located)``: visible files and those with a position."""
    g = geo.where("lat IS NOT NULL").select(F.col("file_id").alias("id"), F.lit(1).alias("g")).distinct()
    return visible(files).join(g, "id", "left").groupBy("media_type").agg(F.count("*").alias("files"), F.count("g").alias("located"))


def folder_page(files: DataFrame, root: int, folder: str) -> DataFrame:
    """The visible files directly in one folder (F14), as a range of paths, which the scan's statistics can prune."""
    f = not_hidden(files).where(F.col("root_id") == root)
    if folder:
        prefix = folder + "/"
        f = f.where((F.col("rel_path") >= prefix) & (F.col("rel_path") < prefix[:-1] + "0"))
    return f.where(F.instr(F.substring("rel_path", len(folder) + 2 if folder else 1, 1 << 20), "/") == 0)


def people_options(persons: DataFrame, faces: DataFrame, animals: DataFrame, files: DataFrame) -> DataFrame:
    """``(option, id, value)``: named people with a visible face, by name without case, and whether there are any people or
    animals to filter by (A11, J5, O6)."""
    shown = not_hidden(files).select(F.col("id").alias("file_id"))
    seen = faces.join(shown, "file_id", "left_semi")
    named = persons.where("trim(name) <> ''").join(seen.select(F.col("person_id").alias("id")), "id", "left_semi").select(F.lit("person").alias("option"), "id", F.col("name").alias("value"))
    any_ = lambda t, what: t.join(shown, "file_id", "left_semi").agg((F.count("*") > 0).cast("string").alias("value")).select(F.lit(what).alias("option"), F.lit(None).cast("long").alias("id"), "value")
    return named.unionByName(any_(faces, "any_people")).unionByName(any_(animals, "any_animals")).orderBy("option", F.lower("value"), "id")


SORTS = {
    "newest": lambda: (F.desc_nulls_last("best_datetime"), F.asc("id")),
    "oldest": lambda: (F.asc_nulls_last("best_datetime"), F.asc("id")),
    "name": lambda: (F.lower("rel_path"), F.asc("id")),
    "largest": lambda: (F.desc_nulls_last("size"), F.asc("id")),
}


def page(df: DataFrame, sort: str = "newest", limit: int = 120, offset: int = 0) -> DataFrame:
    """One page in a total order, with its place ``at`` in it (O1, O8); limits go to 500."""
    order = SORTS[sort]()
    top = df.orderBy(*order).limit(min(limit, 500) + offset)
    w = Window.orderBy(*order)  # over the page only
    return top.withColumn("at", F.row_number().over(w)).where(F.col("at") > offset)


def summary(files: DataFrame, dates: DataFrame) -> DataFrame:
    """One row of totals: files, bytes, dated files and the range of dates (A1)."""
    m = with_dates(visible(files), dates)
    return m.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if("enriched").alias("enriched"),
        F.min("best_datetime").alias("date_min"), F.max("best_datetime").alias("date_max"),
    )


def by_type(files: DataFrame) -> DataFrame:
    return visible(files).groupBy("media_type").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def date_sources(files: DataFrame, dates: DataFrame) -> DataFrame:
    """Visible files by where their date comes from; 'unknown' has no source, 'undated' no record (A2)."""
    source = F.when(~F.col("enriched"), "undated").otherwise(F.coalesce(F.lower(F.trim("date_source")), F.lit("unknown")))
    return with_dates(visible(files), dates).groupBy(source.alias("source")).agg(F.count("*").alias("files"))


def timeline(dated: DataFrame, chars: int = 7, moment: str = "best_datetime", kind: str = "media_type", kinds: list[str] | None = None) -> DataFrame:
    """Counts per period (a prefix of the date text) in one column per kind, with the total."""
    g = dated.where(F.col(moment).isNotNull()).groupBy(F.substring(moment, 1, chars).alias("period"))
    p = g.pivot(kind, kinds or ["image", "video", "audio", "document", "archive", "other"]).count()
    cols = p.columns[1:]
    p = p.select("period", *[F.coalesce(c, F.lit(0)).alias(c) for c in cols])
    return p.withColumn("total", sum((F.col(c) for c in cols[1:]), F.col(cols[0])))


def cumulative(counts: DataFrame, by: str, period: str = "period", value: str = "n") -> DataFrame:
    """Running sum of each kind over periods (W3, A4); the window runs over periods, whose number is small."""
    w = Window.partitionBy(by).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("running", F.sum(value).over(w))


def folders(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Files in each folder, the fullest first, then by lower-case path (A10)."""
    g = not_hidden(files).groupBy(dirname(F.col("rel_path")).alias("folder")).agg(F.count("*").alias("files"))
    return g.orderBy(F.desc("files"), F.lower("folder"), "folder").limit(limit) if limit else g


def status(files: DataFrame) -> DataFrame:
    """Catalogue counts."""
    return files.agg(F.count("*").alias("files"), F.count_if(F.col("present") == 1).alias("present"), F.count_if(F.col("present") == 0).alias("missing"), F.count("sha256").alias("hashed"))


def filter_options(files: DataFrame, dates: DataFrame) -> DataFrame:
    """``(option, value)``: the years and media types there are to filter by."""
    m = with_dates(not_hidden(files), dates)
    years = m.where("best_datetime IS NOT NULL").select(F.lit("year").alias("option"), F.substring("best_datetime", 1, 4).alias("value"))
    return years.unionByName(m.where("media_type IS NOT NULL").select(F.lit("type").alias("option"), F.col("media_type").alias("value"))).distinct()


def named_first(name: Column) -> Column:
    """Sort key that puts entities with a name first."""
    return F.when(F.nullif(F.trim(name), F.lit("")).isNull(), 1).otherwise(0)


def stale(stored: Column, current: Column) -> Column:
    """NULL-safe "is another one" (F7)."""
    return ~stored.eqNullSafe(current)

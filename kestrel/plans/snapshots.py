"""Snapshots, upserts and what is owed: the incremental side as pure functions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.session import cut

#: Stages and what each waits for; text versions and indexers of stored results make them stale when they change.
STAGES = {"scan": [], "enrich": ["scan"], "dedup": ["scan", "enrich"], "places": ["dedup"], "detect": ["dedup"], "semantic": ["dedup"], "text": ["dedup"]}
#: Tables whose rows describe a file's bytes and are dropped when those change.
DERIVED = ["media_meta", "dates", "geo", "perceptual_hashes", "semantic_embeddings", "faces", "face_scan", "animal_detections", "pet_scan", "nonhuman_detections", "takeout_sidecar"]


def upsert(old: DataFrame, new: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of its own; of several new rows of a key the latest ``version``."""
    if version:
        w = Window.partitionBy(key).orderBy(F.desc(version))
        new = new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def unchanged(size: Column, mtime: Column, old_size: Column, old_mtime: Column, old_hash: Column) -> Column:
    """Whether a walked file need not be read again."""
    return F.coalesce((size == old_size) & (F.abs(mtime - old_mtime) < 1e-6) & old_hash.isNotNull(), F.lit(False))


def arriving(mtime: Column, now: float, settle: float = 1.0) -> Column:
    """Whether a file may still be written to."""
    return F.abs(F.lit(now) - mtime) < settle


def to_read(walk: DataFrame, files: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """(files to hash, files still arriving) of a walk ``(root_id, rel_path, size, mtime)``."""
    old = files.select("root_id", "rel_path", F.col("size").alias("os"), F.col("mtime").alias("om"), F.col("fast_hash").alias("oh"))
    j = walk.join(old, ["root_id", "rel_path"], "left")
    todo = j.where(~unchanged(F.col("size"), F.col("mtime"), F.col("os"), F.col("om"), F.col("oh"))).drop("os", "om", "oh")
    late = arriving(F.col("mtime"), now)
    return todo.where(~late), todo.where(late)


def rescan(files: DataFrame, walk: DataFrame, started: str) -> DataFrame:
    """Catalogue after a complete walk: seen files updated or added, the others no longer present.

    ``walk(root_id, rel_path, size, mtime, fast_hash)`` holds every file seen. Ids of new files follow the largest one
    in order of path; they are numbered per partition with exact offsets, not in one task.
    """
    w = walk.select("root_id", "rel_path", F.col("size").alias("ns"), F.col("mtime").alias("nm"), F.col("fast_hash").alias("nh"), F.lit(True).alias("seen"))
    j = files.join(w, ["root_id", "rel_path"], "left")
    pick = lambda n, o: F.when(F.col("seen") & F.col(n).isNotNull(), F.col(n)).otherwise(F.col(o)).alias(o)
    kept = j.select(*[
        pick({"size": "ns", "mtime": "nm", "fast_hash": "nh"}[c], c) if c in ("size", "mtime", "fast_hash")
        else F.when(F.col("seen"), F.lit(started)).otherwise(F.col(c)).alias(c) if c == "last_seen"
        else F.when(F.col("seen"), 1).otherwise(0).cast("long").alias(c) if c == "present" else F.col(c) for c in files.columns
    ])
    new = cut(w.join(files.select("root_id", "rel_path"), ["root_id", "rel_path"], "left_anti").orderBy("root_id", "rel_path"))  # fixed, since its partitions are numbered twice
    top = files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    ranked = new.withColumn("part", F.spark_partition_id()).withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("root_id", "rel_path")))
    sizes = ranked.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row per partition
    added = ranked.join(F.broadcast(before), "part").crossJoin(F.broadcast(top)).select((F.col("top") + F.col("before") + F.col("k")).alias("id"), "root_id", "rel_path", F.col("ns").alias("size"), F.col("nm").alias("mtime"), F.col("nh").alias("fast_hash"), F.lit(started).alias("first_seen"), F.lit(started).alias("last_seen"), F.lit(1).cast("long").alias("present"), F.lit(0).cast("long").alias("hidden"))
    return kept.unionByName(added, allowMissingColumns=True)


def drop_derived(tables: dict[str, DataFrame], changed: DataFrame) -> dict[str, DataFrame]:
    """Tables without what they knew of files whose bytes changed; ``changed(file_id)`` (S8). Others stay as they are."""
    return {n: t.join(changed.select("file_id"), "file_id", "left_anti") if n in DERIVED else t for n, t in tables.items()}


def text_backlog(files: DataFrame, texts: DataFrame, version: str, wanted: str) -> DataFrame:
    """Readable files without text, or with one of other bytes, another version or other wanted readers (F8).

    ``texts`` may hold several readings of a file; the latest counts.
    """
    w = Window.partitionBy("file_id").orderBy(F.desc("extracted_at"))
    t = texts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(F.col("file_id").alias("id"), "source_sha256", "text_version", F.col("wanted").alias("had"), F.lit(True).alias("read"))
    j = files.where("present = 1 AND hidden = 0 AND media_type IN ('document', 'image')").join(t, "id", "left")
    reason = (
        F.when(F.col("read").isNull(), "missing").when(~F.col("source_sha256").eqNullSafe(F.col("sha256")), "bytes")
        .when(~F.col("text_version").eqNullSafe(F.lit(version)), "version").when(~F.col("had").eqNullSafe(F.lit(wanted)), "wanted")
    )
    return j.withColumn("reason", reason).where("reason IS NOT NULL").select("id", "reason")


def undated(files: DataFrame, dates: DataFrame) -> DataFrame:
    """Present files without a date record."""
    return files.where("present = 1").join(dates.select(F.col("file_id").alias("id")), "id", "left_anti")


def undetected(files: DataFrame, scanned: DataFrame) -> DataFrame:
    """Pictures and videos that a detector has not seen at their present bytes; ``scanned(file_id, source_sha256)``."""
    s = scanned.select(F.col("file_id").alias("id"), F.col("source_sha256").alias("sha256"))
    f = files.where("present = 1 AND hidden = 0 AND media_type IN ('image', 'video')")
    return f.join(s, (f["id"] == s["id"]) & f["sha256"].eqNullSafe(s["sha256"]), "left_anti")


#: Media types whose vectors are owed, and what the count of them takes.
SEMANTIC_TYPES, SEMANTIC_EXTENSIONS = ["image", "video", "audio", "document"], ["mp4", "mov", "mp3", "wav", "pdf"]


def unembedded(files: DataFrame, vectors: DataFrame, version: str, counted: bool = False) -> DataFrame:
    """Visible files without a vector of their present bytes and this version (F9). The work list takes four media types; what is
    ``counted`` takes pictures and five extensions instead. ``vectors(file_id, source_sha256, indexer_version)``."""
    f = files.where("present = 1 AND hidden = 0").where((F.col("media_type") == "image") | F.col("ext").isin(SEMANTIC_EXTENSIONS) if counted else F.col("media_type").isin(SEMANTIC_TYPES))
    e = vectors.select(F.col("file_id").alias("id"), F.col("source_sha256").alias("_s"), F.coalesce("indexer_version", F.lit("")).alias("_v"), F.lit(True).alias("_had"))
    j = f.join(e, "id", "left")
    return j.where(F.col("_had").isNull() | ~F.col("_s").eqNullSafe(F.col("sha256")) | (F.col("_v") != version)).drop("_s", "_v", "_had")


def semantic_summary(files: DataFrame, vectors: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(one row of total, indexed, skipped, errors, pending; indexed files by media type) of the vector index."""
    f = files.where("present = 1 AND hidden = 0")
    now = vectors.where(F.coalesce("indexer_version", F.lit("")) == version).select(F.col("file_id").alias("id"), F.col("source_sha256").alias("sha256"), "status")
    e = f.join(now, ["id", "sha256"])
    n = lambda s: F.count_if(F.col("status") == s)
    c = e.agg(n("indexed").alias("indexed"), n("skipped").alias("skipped"), n("error").alias("errors"), F.count("status").alias("completed"))
    total = f.where(F.col("media_type").isin(SEMANTIC_TYPES)).agg(F.count("*").alias("total"))
    one = total.crossJoin(c).select("total", "indexed", "skipped", "errors", F.greatest(F.lit(0), F.col("total") - F.col("completed")).alias("pending"))  # one row each
    return one, e.where("status = 'indexed'").groupBy("media_type").agg(F.count("*").alias("files"))


def backlog_counts(**owed: DataFrame) -> DataFrame:
    """``(stage, pending)``: how many rows each stage owes (T3); give each stage its backlog."""
    parts = [d.agg(F.lit(stage).alias("stage"), F.count("*").alias("pending")) for stage, d in owed.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def next_wait(idle: Column, failed: Column, first: float = 10.0, most: float = 300.0, growth: float = 1.5, cooldown: float = 120.0) -> Column:
    """Seconds until the next look for work: ``first`` after a round with work, longer by ``growth`` with each ``idle`` one up to
    ``most``, and ``cooldown`` at least after a failure (T14)."""
    wait = F.least(F.lit(most), F.lit(first) * F.pow(F.lit(growth), F.greatest(idle, F.lit(0))))
    return F.when(failed, F.greatest(wait, F.lit(cooldown))).otherwise(wait)


def hint_due(hinted: Column, acted: Column, now: Column, quiet: float = 1.5, floor: float = 12.0) -> Column:
    """Whether a hint of changed files is acted on: ``quiet`` seconds after the last hint, ``floor`` after the last action."""
    return F.coalesce((now - hinted >= quiet) & (acted.isNull() | (now - acted >= floor)) & (acted.isNull() | (hinted > acted)), F.lit(False))


def compared(files: DataFrame, runs: DataFrame) -> DataFrame:
    """``(file_id)`` of the files that the last deduplication of their archive covered: hashed, and not newer than its mark.
    ``runs(root_id, covered_max_file_id)``."""
    return files.where("sha256 IS NOT NULL").join(runs.select("root_id", "covered_max_file_id"), "root_id").where("id <= covered_max_file_id").select(F.col("id").alias("file_id"))


def clean_skip(error: Column) -> Column:
    """Whether an error says that there was nothing to do."""
    return error.rlike("^(unsupported|media exceeds|no text layer)")


def coverage(files: DataFrame) -> DataFrame:
    """What a deduplication has covered: count and largest id of present files."""
    return files.where("present = 1").agg(F.count("*").alias("files"), F.max("id").alias("top"))


def dedup_owed(now: DataFrame, stored: DataFrame) -> bool:
    """Whether the stored coverage is another than the present one."""
    a, b = now.first(), stored.first()
    return b is None or tuple(a) != tuple(b)


def guarded(outcome: DataFrame, files: DataFrame) -> DataFrame:
    """Outcomes of files that are still visible with the bytes they were computed from."""
    f = files.where("present = 1 AND hidden = 0").select(F.col("id").alias("file_id"), F.col("sha256").alias("source_sha256"))
    return outcome.join(f, ["file_id", "source_sha256"], "left_semi")


def purge_hidden(vectors: DataFrame, files: DataFrame) -> DataFrame:
    """Vectors of files that are not hidden."""
    return vectors.join(files.where("hidden = 1").select(F.col("id").alias("file_id")), "file_id", "left_anti")


def rewrite(old: DataFrame, new: DataFrame, reviews: list[str]) -> DataFrame:
    """Detections with those of the files in ``new`` replaced; reviews stay with a box that is found again."""
    box = ["file_id", "box_x", "box_y", "box_w", "box_h"]
    kept = old.select(*box, *[F.col(r).alias(f"_{r}") for r in reviews]).dropDuplicates(box)
    n = new.join(kept, box, "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in reviews else F.col(c) for c in new.columns])
    return old.join(new.select("file_id").distinct(), "file_id", "left_anti").unionByName(n, allowMissingColumns=True)


def stage_states(pending: dict[str, int], *, running: frozenset[str] = frozenset(), failed: frozenset[str] = frozenset(), available: frozenset[str] = frozenset(STAGES)) -> dict[str, str]:
    """State of each stage from its backlog: unavailable, running, blocked, error, queued or up_to_date."""
    out: dict[str, str] = {}
    for stage, needs in STAGES.items():
        busy = any(out.get(n) in ("running", "queued", "blocked", "error") for n in needs)
        if stage not in available:
            out[stage] = "unavailable"
        elif stage in running:
            out[stage] = "running"
        elif pending.get(stage, 0) and busy:
            out[stage] = "blocked"
        elif pending.get(stage, 0):
            out[stage] = "error" if stage in failed else "queued"
        else:
            out[stage] = "up_to_date"
    return out

"""Structured Streaming forms: event windows with late data, drained backlogs, places that drift (T4, T5, T7, R21; windows as native extras)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums per window and type; ``late`` sets the watermark of a stream."""
    e = events.withWatermark("ts", late) if late else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of each user: events no more than ``gap`` apart."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1, settled: str | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; files modified after ``settled`` (a timestamp) wait for a later run (T5)."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (r.option("modifiedBefore", settled) if settled else r).parquet(path)


def drain(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that is owed now, in micro-batches, then stop (T7, R21). ``checkpoint`` must be in the shared folder."""
    q = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def place_updates(points: DataFrame, radius_m: float = 300.0) -> DataFrame:
    """``(root_id, id, place_id)``: points of each root put to places whose centres drift as they come (T4).

    State is each root's places; within a micro-batch points go in order of id, so that batches split in that order
    give what one batch gives. Columns: ``points(root_id, id, lat, lon)``.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        from kestrel.operators.clusters import absorb_places

        held = [dict(zip(("id", "lat", "lon", "member_count", "pinned"), p)) for p in zip(*state.get)] if state.exists else []
        pts = [(int(i), float(y), float(x)) for pdf in batches for i, y, x in zip(pdf.id, pdf.lat, pdf.lon)]
        out, places = absorb_places(pts, held, radius_m)
        state.update(tuple([p[k] for p in places] for k in ("id", "lat", "lon", "member_count", "pinned")))
        yield pd.DataFrame({"root_id": [key[0]] * len(out), "id": [i for i, _ in out], "place_id": [p for _, p in out]})

    return points.groupBy("root_id").applyInPandasWithState(
        step, "root_id long, id long, place_id long", "id array<long>, lat array<double>, lon array<double>, member_count array<long>, pinned array<long>", "append", GroupStateTimeout.NoTimeout,
    )

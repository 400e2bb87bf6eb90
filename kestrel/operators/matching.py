"""One-to-one matching and what rests on it: boxes found again, names and reviews carried over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.numbers import iou
from kestrel.session import cut


def matched(pairs: DataFrame, a: str, b: str, order: Column) -> DataFrame:
    """Pairs taken best first, each side once; ``order`` must tell all pairs apart.

    In rounds: a pair that is the best of both its sides is taken, its sides leave. That gives what taking all pairs in one
    order gives, and the rounds are as many as the longest chain of pairs that wait for each other.
    """
    left, done = cut(pairs.withColumn("_o", order)), None
    while not left.isEmpty():
        best = left.join(left.groupBy(a).agg(F.max("_o").alias("_a")), a).join(left.groupBy(b).agg(F.max("_o").alias("_b")), b).where("_o = _a AND _o = _b")
        best = cut(best.select(*left.columns))
        done = best if done is None else done.unionByName(best)
        left = cut(left.join(best.select(a), a, "left_anti").join(best.select(b), b, "left_anti"))
    return (left if done is None else done).drop("_o")


def found_again(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """``(old_id, new_id, iou)``: detections of before found again in the same file and frame, best overlaps first.

    Both have ``(id, file_id, frame_offset, box_x, box_y, box_w, box_h)``; a NULL frame only meets a NULL one. Boxes with a NULL
    side or without an area meet nothing.
    """
    box = lambda t: {k: F.col(f"{t}.box_{k}") for k in "xywh"}
    whole = "box_x IS NOT NULL AND box_y IS NOT NULL AND box_w > 0 AND box_h > 0"
    j = old.where(whole).alias("o").join(new.where(whole).alias("n"), F.expr("o.file_id = n.file_id AND o.frame_offset <=> n.frame_offset"))
    j = j.select(F.col("o.id").alias("old_id"), F.col("n.id").alias("new_id"), iou(box("o"), box("n")).alias("iou")).where(F.col("iou") >= least)
    return matched(j, "old_id", "new_id", F.struct("iou", (-F.col("old_id")).alias("p"), (-F.col("new_id")).alias("q")))


def migrate(old: DataFrame, new: DataFrame, carry: list[str], least: float = 0.5) -> DataFrame:
    """Detections of a new model with what was known of the same boxes before: columns ``carry`` of ``old`` replace those of ``new``
    where the box is found again (T13)."""
    m = found_again(old, new, least).select(F.col("new_id").alias("id"), "old_id")
    kept = old.select(F.col("id").alias("old_id"), *[F.col(c).alias(f"_{c}") for c in carry])
    j = new.join(m, "id", "left").join(kept, "old_id", "left")
    return j.select(*[F.when(F.col("old_id").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in carry else F.col(c) for c in new.columns])

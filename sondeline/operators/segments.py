"""Feed gaps, contiguous segments, runs and spans: gaps and islands over ticks of a rig."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import tick_start


def _order(*keys: str):
    return Window.partitionBy("rig_id", *keys).orderBy("tick")


def feed_gaps(minutes: DataFrame, step: int = 1) -> DataFrame:
    """(rig_id, t_from, t_to, missing): neighbouring observed buckets that are more than one apart."""
    ticks = minutes.select("rig_id", "tick").distinct()
    with_next = ticks.withColumn("before", F.lag("tick").over(_order()))
    gaps = with_next.where(F.col("tick") - F.col("before") > 1)
    return gaps.select("rig_id", tick_start("before", step).alias("t_from"), tick_start("tick", step).alias("t_to"), (F.col("tick") - F.col("before") - 1).alias("missing"))


def with_segments(minutes: DataFrame) -> DataFrame:
    """Add seg_start (true on the first bucket after a gap) and seg (number of the contiguous segment of the rig)."""
    away = F.col("tick") - F.lag("tick").over(_order())
    out = minutes.withColumn("seg_start", F.coalesce(away != 1, F.lit(True)))
    return out.withColumn("seg", F.sum(F.col("seg_start").cast("long")).over(_order()))


def runs(flagged: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add run: the same for flagged buckets that follow each other one by one."""
    return flagged.withColumn("run", F.col("tick") - F.row_number().over(_order(*keys)))


def long_runs(flagged: DataFrame, least: int, aggregates: list, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per run of at least `least` buckets: first and last tick, minutes, ordinal (by time) and the aggregates."""
    grouped = runs(flagged, keys).groupBy("rig_id", *keys, "run")
    found = grouped.agg(F.min("tick").alias("tick_from"), F.max("tick").alias("tick_to"), F.count("*").alias("minutes"), *aggregates).where(F.col("minutes") >= least)
    return found.drop("run").withColumn("ordinal", F.row_number().over(Window.partitionBy("rig_id", *keys).orderBy("tick_from")))


def state_spans(minutes: DataFrame, step: int = 1) -> DataFrame:
    """Maximal runs of one state without a gap: (rig_id, state, t_from, t_to, minutes, depth_from, depth_to, footage); t_to is exclusive."""
    order = _order()
    new = F.coalesce((F.lag("state").over(order) != F.col("state")) | (F.col("tick") - F.lag("tick").over(order) != 1), F.lit(True))
    marked = minutes.withColumn("new", new.cast("long")).withColumn("span", F.sum("new").over(order))
    grouped = marked.groupBy("rig_id", "span").agg(
        F.first("state").alias("state"),
        F.min("tick").alias("a"),
        F.max("tick").alias("b"),
        F.count("*").alias("minutes"),
        F.min_by("hole_depth", "tick").alias("depth_from"),
        F.max_by("hole_depth", "tick").alias("depth_to"),
        F.sum("d_hole").alias("footage"),
    )
    return grouped.select(
        "rig_id", "state", tick_start("a", step).alias("t_from"), tick_start(F.col("b") + 1, step).alias("t_to"), "minutes", "depth_from", "depth_to", F.round("footage", 1).alias("footage")
    )

"""Operational state of each bucket: context windows, decision list, majority vote and absorption of short runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import StateThresholds
from .segments import with_segments


def contexts(minutes: DataFrame, cfg: StateThresholds = StateThresholds()) -> DataFrame:
    """Add seg_start, seg, hole_advance and bit_travel. Windows end at the segment's ends.

    hole_advance sums the depth gained from the window's second row on, so the first row of a window only gives the level to start from.
    """
    return with_segments(minutes).withColumns(context_columns(Window.partitionBy("rig_id", "seg").orderBy("tick"), cfg))


def context_columns(segment: WindowSpec, cfg: StateThresholds) -> dict[str, Column]:
    gained = F.when(F.col("seg_start"), 0.0).otherwise(F.col("d_hole"))
    near = segment.rowsBetween(-cfg.hole_rows + 1, cfg.hole_rows)
    far = segment.rowsBetween(-cfg.trip_rows, cfg.trip_rows)
    return {
        "hole_advance": F.coalesce(F.sum(gained).over(near), F.lit(0.0)),
        "bit_travel": F.coalesce(F.last("bit_depth").over(far) - F.first("bit_depth").over(far), F.lit(0.0)),
    }


def classify(minutes: DataFrame, cfg: StateThresholds = StateThresholds()) -> DataFrame:
    """Add raw_state by the ordered decision list; minutes must have their contexts."""
    zero = F.lit(0.0)
    rotating = F.coalesce("RPM.mean", zero) >= cfg.rotating_rpm
    pumping = F.coalesce("MFIA.mean", zero) >= cfg.pumping_gpm
    swing = F.coalesce(F.col("BPOS.max") - F.col("BPOS.min"), zero) >= cfg.connection_bpos_ft
    making = F.col("hole_advance") >= cfg.making_hole_ft
    off = F.col("off_bottom")
    on_bottom = off.isNotNull() & (off <= cfg.on_bottom_ft)
    lifted = off.isNotNull() & (off > cfg.on_bottom_ft) & (off < cfg.connection_off_bottom_ft)
    travel = F.col("bit_travel")
    return minutes.withColumn(
        "raw_state",
        F.when(making & on_bottom, F.when(rotating, "DRILLING").otherwise("SLIDING"))
        .when(~making & (F.abs(travel) >= cfg.tripping_ft), F.when(travel > 0, "TRIPPING_IN").otherwise("TRIPPING_OUT"))
        .when(~making & lifted & swing, "CONNECTION")
        .when(pumping & rotating, F.when(F.abs("d_bit") > cfg.reaming_ft, "REAMING").otherwise("CIRCULATING"))
        .when(pumping, "CIRCULATING")
        .otherwise("STATIC"),
    )


def smooth(minutes: DataFrame, cfg: StateThresholds = StateThresholds()) -> DataFrame:
    """Add voted and state from raw_state; rows are neighbours over gaps too.

    A row takes the commonest state of its window, its own in a tie, else the one that comes first in the window. A run of voted
    states shorter than min_run takes the state before it, unless it is the first run.
    """
    order = Window.partitionBy("rig_id").orderBy("tick")
    out = majority(minutes, order, cfg)
    new = F.coalesce(F.lag("voted").over(order) != F.col("voted"), F.lit(True)).cast("long")
    out = out.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    length = F.count("*").over(Window.partitionBy("rig_id", "run"))
    out = out.withColumn("run_length", length)
    stays = (F.col("run_length") >= cfg.min_run) | (F.col("run") == 1)
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("state", F.last(F.when(stays, F.col("voted")), ignorenulls=True).over(before)).drop("new", "run", "run_length")


def majority(minutes: DataFrame, order: WindowSpec, cfg: StateThresholds) -> DataFrame:
    """Add voted."""
    out = minutes.withColumn("win", F.collect_list("raw_state").over(order.rowsBetween(-cfg.vote_rows, cfg.vote_rows)))
    ranked = F.transform(
        F.array_distinct("win"),
        lambda v: F.struct(
            (-F.size(F.filter("win", lambda x: x == v))).alias("votes"), (v != F.col("raw_state")).alias("other"), F.array_position("win", v).alias("place"), v.alias("state")
        ),
    )
    return out.withColumn("voted", F.array_min(ranked)["state"]).drop("win")


def apply_states(minutes: DataFrame, cfg: StateThresholds = StateThresholds()) -> DataFrame:
    """contexts, classify and smooth in turn; the rig's rows are shuffled once."""
    return smooth(classify(contexts(minutes, cfg), cfg), cfg)

"""Samples to per-minute statistics. `step` is the length of a bucket in minutes; one is the feed's own precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHANNELS
from ..functions.scalars import array_quantile, held, tick, tick_start


def held_frames(cells: DataFrame, columns: list[str], entity: str = "rig_id", seq: str = "seq", part_rows: int = 1 << 17) -> DataFrame:
    """Add dup_of_prev: the row's cells all equal those of the row before it.

    A rig's rows are parted by ranges of seq, so that no task sorts a whole feed; the first row of a range looks up the last row of the
    rig's range before, in a table of one row a range.
    """
    row = F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns))
    parted = cells.withColumns({"_part": F.floor(F.col(seq) / part_rows).cast("long"), "_row": row})
    ends = parted.groupBy(F.col(entity).alias("_entity"), F.col("_part").alias("_after")).agg(F.max_by("_row", seq).alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy("_entity").orderBy("_after"))).where("_end is not null")
    before = F.lag("_row").over(Window.partitionBy(entity, "_part").orderBy(seq))
    first = F.row_number().over(Window.partitionBy(entity, "_part").orderBy(seq)) == 1
    found = parted.withColumns({"_before": before, "_first": first}).join(ends, (F.col(entity) == F.col("_entity")) & (F.col("_part") == F.col("_after")), "left")
    before = F.when(F.col("_first"), F.col("_end")).otherwise(F.col("_before"))
    return found.select(*cells.columns, F.coalesce(before == F.col("_row"), F.lit(False)).alias("dup_of_prev"))


def stats(channel: str) -> Column:
    """struct(n, mean, min, max, sd, p10, p50, p90) of a channel as an aggregate; null where it has no reading."""
    c = F.col(channel)
    q = F.percentile(c, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    made = F.struct(
        F.count(c).alias("n"),
        F.avg(c).alias("mean"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        F.stddev_pop(c).alias("sd"),
        *(F.get(q, F.lit(k)).alias(p) for k, p in enumerate(("p10", "p50", "p90"))),
    )
    return F.when(F.count(c) > 0, made)


def collapse_held(values: Column) -> Column:
    """Keep the first of each run of equal neighbours of an array."""
    return F.filter(values, lambda x, i: (i == 0) | (x != F.get(values, i - 1)))


def normalised_mad(values: Column) -> Column:
    """1.4826 times the median absolute deviation over the median; null for fewer than four values or a median of zero or less. No value is null."""

    def of(ascending: Column, median: Column) -> Column:
        away = F.sort_array(F.transform(ascending, lambda x: F.abs(x - median)))
        return F.when((F.size(ascending) >= 4) & (median > 0), held(away, lambda a: array_quantile(a, 0.5)) * 1.4826 / median)

    return held(F.sort_array(values), lambda ascending: held(array_quantile(ascending, 0.5), lambda median: of(ascending, median)))


def rollup(samples: DataFrame, step: int = 1, channels: tuple[str, ...] = CHANNELS, rotating_rpm: float = 20.0, depths: bool = True) -> DataFrame:
    """One row per rig and observed bucket.

    samples: rig_id, ts, seq, dup_of_prev and a nullable double for each channel. A bucket's torque readings are cleaned
    in their order: zeros and less go while the string turns (mean RPM above rotating_rpm), then repeats of the reading before. One
    shuffle by (rig_id, tick) aggregates; depth changes against the last known depth take one by rig_id, unless they are left out.
    """
    grouped = samples.groupBy("rig_id", tick("ts", step).alias("tick")).agg(
        F.count("*").alias("n"),
        F.sum(F.col("dup_of_prev").cast("long")).alias("dup_rows"),
        *(stats(c).alias(c) for c in channels),
        F.sort_array(F.collect_list(F.when(F.col("TORQUE").isNotNull(), F.struct("seq", "TORQUE")))).alias("raw"),
    )
    turning = F.coalesce(F.col("RPM.mean"), F.lit(0.0)) > rotating_rpm
    raw = F.col("raw.TORQUE")
    out = grouped.withColumn("positive", F.when(turning, F.filter(raw, lambda x: x > 0)).otherwise(raw))
    out = out.withColumn("kept", collapse_held(F.col("positive")))
    enough = F.size("kept") >= 4
    median = F.when(enough, held(F.sort_array("kept"), lambda a: array_quantile(a, 0.5)))
    out = out.withColumns(
        {
            "t": tick_start("tick", step),
            "hole_depth": F.col("DMEA.max"),
            "bit_depth": F.col("DBTM.mean"),
            "torque_valid": F.size("kept").cast("long"),
            "torque_zero_fill": F.when(turning, F.size("raw") - F.size("positive")).otherwise(0).cast("long"),
            "torque_median": median,
            "torque_nmad": F.when(turning, normalised_mad(F.col("kept"))),
            "torque_ptp": F.when(median > 0, (F.array_max("kept") - F.array_min("kept")) / median),
        }
    ).drop("raw", "positive", "kept")
    out = out.withColumn("off_bottom", F.col("hole_depth") - F.col("bit_depth"))
    return depth_changes(out) if depths else out


def last_known(c: str) -> Column:
    """The nearest earlier non-null value of the rig, over gaps too."""
    before = Window.partitionBy("rig_id").orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    return F.last(c, ignorenulls=True).over(before)


def depth_changes(minutes: DataFrame) -> DataFrame:
    """Add d_hole (never negative), d_bit and rop_calc, against the last known depths; 0 where either is missing."""
    hole = F.col("hole_depth") - last_known("hole_depth")
    bit = F.col("bit_depth") - last_known("bit_depth")
    out = minutes.withColumns({"d_hole": F.coalesce(F.greatest(hole, F.lit(0.0)), F.lit(0.0)), "d_bit": F.coalesce(bit, F.lit(0.0))})
    return out.withColumn("d_hole", F.when(F.col("hole_depth").isNull(), 0.0).otherwise(F.col("d_hole"))).withColumn("rop_calc", F.col("d_hole") * 60)


def feed_meta(minutes: DataFrame) -> DataFrame:
    """One row per rig: covered buckets, rows, and least, upper-median, greatest and mean rows a bucket."""
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n DESC)").cast("long")
    return minutes.groupBy("rig_id").agg(
        F.count("*").alias("covered"),
        F.sum("n").alias("rows"),
        F.min("n").alias("n_min"),
        upper.alias("n_p50"),
        F.max("n").alias("n_max"),
        F.round(F.avg("n"), 1).alias("n_mean"),
        F.min("t").alias("t_from"),
        F.max("t").alias("t_to"),
    )

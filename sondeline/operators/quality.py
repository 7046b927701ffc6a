"""Data-quality findings of a feed, with counted numbers in place of prose ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHANNELS


def counters(raw: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """One row of conditional counts over raw rows, whose cells are strings named as the channels, with numbers beside them as num_<channel>."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    sums = [F.sum((filled(c) & F.col(f"num_{c}").isNull()).cast("long")) for c in channels]
    counted = raw.agg(
        F.count("*").alias("rows"),
        reduce(Column.__add__, sums).alias("non_numeric"),
        F.sum(F.coalesce(F.col("num_DBTM") == 0, F.lit(False)).cast("long")).alias("dbtm_zero"),
        F.sum(F.coalesce(F.col("num_WOB") < 0, F.lit(False)).cast("long")).alias("wob_negative"),
        F.sum(F.col("dup_of_prev").cast("long")).alias("held"),
    )
    return counted.join(F.broadcast(bad_cells(raw, channels)))  # each is one row


def bad_cells(raw: DataFrame, channels: tuple[str, ...] = CHANNELS, most: int = 4) -> DataFrame:
    """One row: examples, the first `most` different cells of all channels that aren't numbers, as channel="text".

    Only rows with such a cell are shuffled; first is by seq, then rig, then the order of channels.
    """
    bad = [
        F.when((F.trim(c) != "") & F.col(f"num_{c}").isNull(), F.struct(F.lit(k).alias("place"), F.concat(F.lit(f'{c}="'), F.trim(c), F.lit('"')).alias("cell")))
        for k, c in enumerate(channels)
    ]
    seen = raw.select("seq", "rig_id", F.explode(F.array_compact(F.array(*bad))).alias("x"))
    first = seen.groupBy(F.col("x.cell").alias("cell")).agg(F.min(F.struct("seq", "rig_id", "x.place")).alias("at")).orderBy("at").limit(most)
    return first.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cell"))), lambda v: v["cell"]).alias("examples"))


def findings(counted: DataFrame, minutes: DataFrame, gaps: DataFrame) -> DataFrame:
    """(id, severity, title, detail, affected_rows, affected_pct, action): ten rows, from one-row aggregates of the feed."""
    mean = lambda c: F.col(f"{c}.mean")
    turning = mean("RPM") > 20
    per_minute = minutes.agg(
        F.count("*").alias("stamps"),
        F.sum("torque_zero_fill").alias("zero_fill"),
        F.min("ROP.min").alias("rop_min"),
        F.count_if(turning).alias("turning"),
        F.count_if(turning & (F.col("torque_zero_fill") > 0)).alias("turning_zero"),
        F.max("TORQUE.max").alias("torque_max"),
        F.max("MFOP.max").alias("mfop_max"),
        F.percentile(F.when(mean("MFIA") > 300, mean("MFOP")), F.lit(0.5)).alias("mfop_median"),
    )
    gap = gaps.agg(F.count("*").alias("gaps"), F.coalesce(F.sum("missing"), F.lit(0).cast("long")).alias("missing"), F.coalesce(F.max("missing"), F.lit(0).cast("long")).alias("longest"))
    one = counted.join(F.broadcast(per_minute)).join(F.broadcast(gap))  # each is one row
    rows = F.col("rows")
    say = lambda text, *c: F.format_string(text, *(F.coalesce(F.col(x).cast("string"), F.lit("none")) for x in c))
    table = [
        ("minute-precision", "critical", "Stamps have minute precision only", say("%s rows share %s stamps", "rows", "stamps"), rows, "The minute is the unit; statistics are of raw samples inside it"),
        ("torque-zero-fill", "critical", "Torque reads 0 while the string turns", say("%s of %s turning minutes", "turning_zero", "turning"), F.col("zero_fill"), "Left out of torque statistics while RPM is above 20"),
        ("rop-never-zero", "critical", "The rate channel never reaches zero", say("least reading %s", "rop_min"), rows, "State comes from depth and movement, not from this channel"),
        ("dbtm-zero", "warn", "Bit depth reads 0", say("%s rows", "dbtm_zero"), F.col("dbtm_zero"), "Taken as missing"),
        ("non-numeric", "warn", "Cells that aren't numbers", say("%s cells", "non_numeric"), F.col("non_numeric"), "Left missing, not made 0"),
        ("held-frames", "warn", "Repeated frames", say("%s rows equal the row before", "held"), F.col("held"), "Collapsed before torque dispersion"),
        ("feed-gaps", "warn", "Feed gaps", say("%s gaps, %s minutes missing, the longest %s", "gaps", "missing", "longest"), F.lit(0).cast("long"), "Never interpolated"),
        ("wob-negative", "critical", "Weight on bit below zero", say("%s rows", "wob_negative"), F.col("wob_negative"), "Its level isn't trusted, its spread is"),
        ("torque-units", "warn", "The torque unit disagrees with the values", say("greatest reading %s", "torque_max"), rows, "Taken as ft-lb"),
        ("mfop-scale", "warn", "Return flow isn't a percentage", say("median %s and maximum %s with pumps on", "mfop_median", "mfop_max"), rows, "Scored by drift only"),
    ]
    made = [
        F.struct(
            F.lit(i).alias("id"), F.lit(s).alias("severity"), F.lit(t).alias("title"), d.alias("detail"), a.cast("long").alias("affected_rows"),
            F.coalesce(F.round(F.try_divide(F.lit(100.0) * a, rows), 2), F.lit(0.0)).alias("affected_pct"), F.lit(act).alias("action"),
        )
        for i, s, t, d, a, act in table
    ]
    return one.select(F.explode(F.array(*made)).alias("f")).select("f.*")

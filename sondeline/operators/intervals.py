"""Interval aggregates, summary, series and filters over classified minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MAKING_HOLE
from ..functions.scalars import epoch_seconds, from_epoch_seconds, tick_start
from ..sources.staging import written

RANGE = 2048  #: ticks of a range of greedy buckets


def _kpis(step: int) -> list[Column]:
    made = F.col("state").isin(*MAKING_HOLE)
    known = F.when(F.col("hole_depth").isNotNull(), F.col("tick"))
    return [
        F.count("*").alias("measured"),
        F.min_by("hole_depth", known).alias("depth_start"),
        F.max_by("hole_depth", known).alias("depth_end"),
        F.sum("d_hole").alias("footage"),
        F.sum(made.cast("long")).alias("on_bottom"),
        F.avg("ROP.mean").alias("rop_channel"),
    ]


def _rates(step: int) -> dict[str, Column]:
    rate = lambda n: F.round(F.when(F.col(n) > 0, F.col("footage") / (F.col(n) * step) * 60), 1)
    return {"rop_on_bottom": rate("on_bottom"), "rop_overall": rate("measured")}


def state_minutes(minutes: DataFrame, *keys: str) -> DataFrame:
    """(keys, state_minutes): a map from state to buckets."""
    counted = minutes.groupBy(*keys, "state").agg(F.count("*").alias("c"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "c"))))
    return counted.groupBy(*keys).agg(entries.alias("state_minutes"))


def intervals(minutes: DataFrame, length: int, step: int = 1) -> DataFrame:
    """Tumbling intervals of `length` buckets from the rig's first to its last, empty ones included, aligned on the epoch."""
    marked = minutes.withColumn("slot", F.floor(F.col("tick") / length).cast("long"))
    ends = marked.groupBy("rig_id").agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    spine = ends.select("rig_id", F.explode(F.sequence("a", "b")).alias("slot"))
    found = marked.groupBy("rig_id", "slot").agg(*_kpis(step))
    out = spine.join(found, ["rig_id", "slot"], "left").join(state_minutes(marked, "rig_id", "slot"), ["rig_id", "slot"], "left")
    zero = F.lit(0).cast("long")
    out = out.withColumns({"measured": F.coalesce("measured", zero), "on_bottom": F.coalesce("on_bottom", zero), "footage": F.coalesce("footage", F.lit(0.0))}).withColumns(_rates(step))
    return out.select(
        "rig_id",
        tick_start(F.col("slot") * length, step).alias("t_from"),
        tick_start((F.col("slot") + 1) * length, step).alias("t_to"),
        "measured",
        F.greatest(F.lit(length) - F.col("measured"), zero).alias("missing"),
        "depth_start",
        "depth_end",
        F.round("footage", 1).alias("footage"),
        "on_bottom",
        "rop_on_bottom",
        "rop_overall",
        F.round("rop_channel", 2).alias("rop_channel"),
        F.coalesce("state_minutes", F.create_map().cast("map<string,bigint>")).alias("state_minutes"),
    )


def summary(minutes: DataFrame, reports: DataFrame, step: int = 1) -> DataFrame:
    """One row per rig over the whole feed, with hours booked in reports that overlap it strictly."""
    whole = minutes.groupBy("rig_id").agg(*_kpis(step), F.min("tick").alias("a"), F.max("tick").alias("b")).withColumns(_rates(step))
    window = whole.select("rig_id", tick_start("a", step).alias("f"), tick_start(F.col("b") + 1, step).alias("u"))
    booked = reports.join(window, "rig_id").where((F.col("end") > F.col("f")) & (F.col("start") < F.col("u")))
    booked = booked.groupBy("rig_id").agg(F.sum("npt_hrs").alias("npt"), F.sum("duration_hrs").alias("hrs"))
    hours = lambda n: F.round(n * step / 60.0, 2)
    return whole.join(booked, "rig_id", "left").select(
        "rig_id",
        tick_start("a", step).alias("t_from"),
        tick_start(F.col("b") + 1, step).alias("t_to"),
        hours(F.col("measured")).alias("measured_hours"),
        hours(F.col("b") + 1 - F.col("a") - F.col("measured")).alias("missing_hours"),
        "depth_start",
        "depth_end",
        F.round("footage", 1).alias("footage"),
        hours(F.col("on_bottom")).alias("on_bottom_hours"),
        "rop_on_bottom",
        "rop_overall",
        F.round("rop_channel", 2).alias("rop_channel"),
        F.round(F.coalesce("npt", F.lit(0.0)), 2).alias("npt_hours"),
        F.round(F.coalesce("hrs", F.lit(0.0)), 2).alias("report_hours"),
    )


def _point(mean: Column, low: Column, high: Column, sd: Column) -> list[Column]:
    return [
        F.round(F.avg(mean), 3).alias("mean"),
        F.round(F.min(low), 3).alias("min"),
        F.round(F.max(high), 3).alias("max"),
        F.round(F.sqrt(F.avg(sd * sd)), 3).alias("sd"),
        F.count(mean).alias("n"),
    ]


#: Series that aren't channels: plain values without a spread of their own.
VIRTUAL = {"torqueDispersion": "torque_nmad", "ropCalc": "rop_calc"}


def channel_parts(channel: str) -> tuple[Column, Column, Column, Column]:
    """mean, min, max and sd of a channel or of a virtual series of a minute."""
    if channel in VIRTUAL:
        v = F.col(VIRTUAL[channel])
        return v, v, v, F.when(v.isNotNull(), 0.0)
    return tuple(F.col(f"{channel}.{p}") for p in ("mean", "min", "max", "sd"))


def resample(minutes: DataFrame, channel: str, length: int, step: int = 1) -> DataFrame:
    """Points of epoch-aligned buckets of `length` ticks, spread as the root mean square of the parts' spreads.

    Buckets without a value give no point. A feed gap inside a bucket gives a point of nulls one millisecond before its end.
    """
    slot = F.floor(F.col("tick") / length).cast("long")
    before = F.lag("tick").over(Window.partitionBy("rig_id", "slot").orderBy("tick"))
    marked = minutes.withColumn("slot", slot).withColumn("gap", F.col("tick") - before > 1)
    points = marked.groupBy("rig_id", "slot").agg(*_point(*channel_parts(channel)), F.max("gap").alias("gap"))
    start = epoch_seconds(tick_start(F.col("slot") * length, step))
    real = points.where("n > 0").select("rig_id", from_epoch_seconds(start).alias("t"), "mean", "min", "max", "sd", "n")
    end = F.timestamp_millis((start + length * step * 60) * 1000 - 1).cast("timestamp_ntz")
    none = [F.lit(None).cast("double").alias(c) for c in ("mean", "min", "max", "sd")]
    breaks = points.where("gap").select("rig_id", end.alias("t"), *none, F.lit(0).cast("long").alias("n"))
    return real.unionByName(breaks)


def _jumps(ranges: DataFrame, length: int) -> DataFrame:
    """Add jumps: where the next bucket may begin after the range, for each of the `length` places in it from which one may begin."""
    after = lambda e: F.aggregate("ticks", F.col("begin") + e, lambda at, x: F.when(x >= at, x + length).otherwise(at))
    return ranges.withColumn("jumps", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long")), after))


def _entries(ranges: DataFrame, length: int) -> DataFrame:
    """(rig_id, place, at): where a bucket may begin at the earliest in each range, by composing the jumps of all ranges before.

    Ranges are composed by doubling: after each step a range's jumps are those of twice as many ranges up to it. A step is a join of tables of
    one row a range, and there are as many as the number of a rig's ranges has binary digits.
    """
    now = written(_jumps(ranges, length).select("rig_id", "place", "begin", "jumps"), "jumps")
    most, reach = now.agg(F.max("place")).first()[0] or 0, 1
    while reach <= most:
        before = now.select("rig_id", (F.col("place") + reach).alias("place"), F.col("begin").alias("_begin"), F.col("jumps").alias("_jumps"))
        # Jumps go by places in the first of the ranges that they span, which begins at `begin`.
        composed = F.transform("_jumps", lambda s: F.get("jumps", F.greatest(s - F.col("begin"), F.lit(0)).cast("int")))
        both = now.join(before, ["rig_id", "place"], "left").withColumn("both", F.when(F.col("_jumps").isNull(), F.col("jumps")).otherwise(composed))
        now = written(both.select("rig_id", "place", F.coalesce("_begin", "begin").alias("begin"), F.col("both").alias("jumps")), "jumps")
        reach *= 2
    return now.select("rig_id", (F.col("place") + 1).alias("place"), F.get("jumps", F.lit(0)).alias("at"))


def greedy_buckets(minutes: DataFrame, length: int, ticks: int = RANGE) -> DataFrame:
    """Add anchor: buckets of `length` ticks, each of which begins at the first observed tick after the one before.

    Where one begins depends on all before it. Within a range of ticks that is a fold, once for each place at which the range may be entered; these
    tables of jumps are composed over the rig's ranges, and then each range knows where it is entered.
    """
    part = F.floor(F.col("tick") / ticks).cast("long")
    ranges = minutes.select("rig_id", "tick", part.alias("part")).groupBy("rig_id", "part").agg(F.array_sort(F.collect_list("tick")).alias("ticks"))
    place = F.row_number().over(Window.partitionBy("rig_id").orderBy("part")) - 1
    ranges = written(ranges.select("rig_id", "ticks", (F.col("part") * ticks).alias("begin"), place.alias("place")), "ranges")
    entered = ranges.join(_entries(ranges, length), ["rig_id", "place"], "left").withColumn("at", F.coalesce("at", "begin"))
    start = F.struct(F.col("at").alias("at"), F.array().cast("array<bigint>").alias("anchors"))
    step = lambda s, x: F.struct(
        F.when(x >= s["at"], x + length).otherwise(s["at"]).alias("at"), F.concat(s["anchors"], F.array(F.when(x >= s["at"], x).otherwise(s["at"] - length))).alias("anchors")
    )
    walked = entered.select("rig_id", "ticks", F.aggregate("ticks", start, step)["anchors"].alias("anchors"))
    anchors = walked.select("rig_id", F.inline(F.arrays_zip(F.col("ticks").alias("tick"), F.col("anchors").alias("anchor"))))
    return minutes.join(anchors, ["rig_id", "tick"])


def greedy_series(minutes: DataFrame, mean: Column, low: Column, high: Column, sd: Column, length: int, step: int = 1) -> DataFrame:
    """Points of greedy buckets; a bucket without a value gives a point of nulls."""
    grouped = greedy_buckets(minutes, length).groupBy("rig_id", "anchor").agg(*_point(mean, low, high, sd))
    return grouped.select("rig_id", tick_start("anchor", step).alias("t"), "mean", "min", "max", "sd", "n")


def standard_series(minutes: DataFrame, length: int = 5, step: int = 1) -> DataFrame:
    """The eleven named series: channels, with cleaned torque as the torque's mean and a missing rate as 0."""
    named = {c.lower(): channel_parts(c) for c in ("WOB", "RPM", "SPP", "HKLA", "MFIA", "MFOP")}
    torque = channel_parts("TORQUE")
    named["torque"] = (F.when(F.col("TORQUE").isNotNull(), F.coalesce("torque_median", "TORQUE.mean")), *torque[1:])
    rate = F.coalesce("rop_calc", F.lit(0.0))
    named["rop"] = (rate, rate, rate, F.lit(0.0))
    named["ropChannel"] = channel_parts("ROP")
    for name, c in (("holeDepth", "hole_depth"), ("bitDepth", "bit_depth")):
        v = F.col(c)
        named[name] = (v, v, v, F.when(v.isNotNull(), 0.0))
    anchored = greedy_buckets(minutes, length)
    rows = F.array(*(F.struct(F.lit(n).alias("series"), *(x.cast("double").alias(a) for x, a in zip(p, ("mean", "low", "high", "spread"), strict=True))) for n, p in named.items()))
    flat = anchored.select("rig_id", "anchor", F.explode(rows).alias("x")).select("rig_id", "anchor", "x.*")
    grouped = flat.groupBy("rig_id", "series", "anchor").agg(*_point(F.col("mean"), F.col("low"), F.col("high"), F.col("spread")))
    return grouped.select("rig_id", "series", tick_start("anchor", step).alias("t"), "mean", "min", "max", "sd", "n")


def state_totals(spans: DataFrame) -> DataFrame:
    return spans.groupBy("rig_id", "state").agg(F.sum("minutes").alias("minutes"))


def overlapping_spans(spans: DataFrame, begin=None, end=None) -> DataFrame:
    """Spans that overlap the open interval strictly; bounds are optional."""
    out = spans if begin is None else spans.where(F.col("t_to") > begin)
    return out if end is None else out.where(F.col("t_from") < end)


def clipped_totals(spans: DataFrame, begin, end) -> DataFrame:
    """Minutes of each rig and state inside the window, spans cut at its ends; none without a minute."""
    seconds = epoch_seconds(F.least("t_to", end)) - epoch_seconds(F.greatest("t_from", begin))
    total = spans.groupBy("rig_id", "state").agg(F.sum(F.greatest(seconds, F.lit(0)) / 60.0).alias("minutes"))
    return total.where("minutes > 0")


def point_lookup(spans: DataFrame, minutes: DataFrame, at: Column, step: int = 1) -> DataFrame:
    """The span and the bucket of each rig that hold a point in time; a rig that has neither is left out."""
    span = spans.where((F.col("t_from") <= at) & (at < F.col("t_to"))).select("rig_id", F.struct("state", "t_from", "t_to", "minutes").alias("span"))
    inside = (F.col("t") <= at) & (epoch_seconds(at) < epoch_seconds("t") + 60 * step)
    bucket = minutes.where(inside).select("rig_id", F.struct("t", "state", "hole_depth", "bit_depth").alias("minute"))
    return span.join(bucket, "rig_id", "full")


def masked(series: DataFrame, minutes: DataFrame, days: list[str] | None = None, states: list[str] | None = None, begin=None, end=None) -> DataFrame:
    """Crop a series to the window and null its values outside the days and states; rows stay. The state is that of the point's own minute."""
    out = series if begin is None else series.where(F.col("t") >= begin)
    out = out if end is None else out.where(F.col("t") <= end)
    out = out.join(minutes.select("rig_id", "t", "state"), ["rig_id", "t"], "left")
    keep = F.lit(True)
    if days is not None:
        keep = keep & F.date_format("t", "yyyy-MM-dd").isin(days)
    if states is not None:
        keep = keep & F.coalesce(F.col("state").isin(states), F.lit(False))
    return out.withColumns({c: F.when(keep, F.col(c)) for c in ("mean", "min", "max", "sd")})


def scatter(minutes: DataFrame) -> DataFrame:
    """Rate against weight on bit while making hole."""
    made = minutes.where(F.col("state").isin(*MAKING_HOLE) & F.col("WOB").isNotNull() & F.col("rop_calc").isNotNull())
    return made.select("rig_id", "t", F.round("WOB.mean", 2).alias("wob"), F.round("rop_calc", 1).alias("rop"), F.round("hole_depth", 1).alias("depth"), "state")


def every_nth(rows: DataFrame, order: list[str], bucket: Column, most: int = 2500) -> DataFrame:
    """Each Nth row in order, N being the least stride that leaves no more than `most` rows.

    bucket never falls along the order (a day, or a rig and a day) and parts the rows for numbering: only its counts, one row a bucket,
    are summed in one task.
    """
    parted = rows.withColumn("_b", bucket)
    sizes = parted.groupBy("_b").agg(F.count("*").alias("_n"))
    starts = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    numbered = parted.withColumn("_in", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    stride = F.greatest(F.lit(1), F.ceil(F.col("_all") / most))
    return numbered.join(starts, "_b").where((F.col("_start") + F.col("_in") - 1) % stride == 0).select(*rows.columns)


def dominant(minutes: DataFrame, c: str = "hole_size") -> DataFrame:
    """Each rig's commonest value, the one seen first in a tie."""
    counted = minutes.where(F.col(c).isNotNull()).groupBy("rig_id", c).agg(F.count("*").alias("minutes"), F.min("tick").alias("first"))
    top = counted.groupBy("rig_id").agg(F.max_by(F.struct(c, "minutes"), F.struct("minutes", -F.col("first"), c)).alias("top"))
    return top.select("rig_id", f"top.{c}", "top.minutes")

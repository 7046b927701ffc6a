"""Windows over one long feed: ranges of a rig's rows with halos, and what ranges hand on to each other.

A window over a rig sorts the whole rig in one task. Here rows are numbered by ranges of ticks (only one row a range is summed
up over the rig), a block is so many neighbouring rows, and rows near a border are in both blocks, so that windows of a fixed number of rows are
taken within blocks. What depends on everything before (last known values, segment and span numbers, the state that short runs take, trips so far) is worked
out within blocks, and a table of one row a block hands it on. Results are those of the windows over whole rigs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DetectorConfig, StateThresholds
from ..functions.scalars import tick_start
from ..sources.staging import written
from . import detect
from .state import classify, context_columns, majority

ROWS = 8192  #: rows of a block
TICKS = 1 << 14  #: ticks of a range, in which rows are numbered

_ALL_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def _along(*keys: str, order: str = "block"):
    return Window.partitionBy(*keys).orderBy(order)


def numbered(rows: DataFrame, keys: tuple[str, ...] = ("rig_id",), order: str = "tick", ticks: int = TICKS, out: str = "i") -> DataFrame:
    """Add the row's number, from 0, among the rows of its keys in order; `order` is a whole number without ties there."""
    parted = rows.withColumn("_range", F.floor(F.col(order) / ticks).cast("long"))
    sizes = parted.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    starts = sizes.select(*keys, "_range", F.coalesce(F.sum("_size").over(_along(*keys, order="_range").rowsBetween(*_ALL_BEFORE)), F.lit(0)).alias("_start"))
    inside = F.row_number().over(_along(*keys, "_range", order=order)) - 1
    return parted.withColumn("_inside", inside).join(starts, [*keys, "_range"]).withColumn(out, F.col("_start") + F.col("_inside")).drop("_range", "_start", "_inside")


def with_halo(rows: DataFrame, back: int, ahead: int, size: int = ROWS) -> DataFrame:
    """Rows (numbered by i) once for each block that they are in or within `back` rows before or `ahead` rows behind; adds block and own."""
    first, last = F.floor((F.col("i") - ahead) / size), F.floor((F.col("i") + back) / size)
    return rows.withColumn("block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last))).withColumn("own", F.floor(F.col("i") / size) == F.col("block"))


def known_before(rows: DataFrame, columns: dict[str, str], ticks: int = TICKS) -> DataFrame:
    """Add, under the names of `columns`, the nearest earlier non-null value of the rig's column."""
    parted = rows.withColumn("_range", F.floor(F.col("tick") / ticks).cast("long"))
    ends = parted.groupBy("rig_id", "_range").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("tick"))).alias(f"_{n}") for n, c in columns.items()))
    handed = ends.select("rig_id", "_range", *(F.last(f"_{n}", ignorenulls=True).over(_along("rig_id", order="_range").rowsBetween(*_ALL_BEFORE)).alias(f"_{n}") for n in columns))
    inside = _along("rig_id", "_range", order="tick").rowsBetween(*_ALL_BEFORE)
    found = parted.withColumns({n: F.last(c, ignorenulls=True).over(inside) for n, c in columns.items()}).join(handed, ["rig_id", "_range"])
    return found.withColumns({n: F.coalesce(n, f"_{n}") for n in columns}).drop("_range", *(f"_{n}" for n in columns))


def depth_changes(minutes: DataFrame, ticks: int = TICKS) -> DataFrame:
    """rollup.depth_changes() by ranges."""
    out = known_before(minutes, {"_hole": "hole_depth", "_bit": "bit_depth"}, ticks)
    gained = F.coalesce(F.greatest(F.col("hole_depth") - F.col("_hole"), F.lit(0.0)), F.lit(0.0))
    gained = F.when(F.col("hole_depth").isNull() | F.col("_hole").isNull(), 0.0).otherwise(gained)
    out = out.withColumns({"d_hole": gained, "d_bit": F.coalesce(F.col("bit_depth") - F.col("_bit"), F.lit(0.0))})
    return out.withColumn("rop_calc", F.col("d_hole") * 60).drop("_hole", "_bit")


def asof(rows: DataFrame, facts: DataFrame, value: str, ticks: int = TICKS, at: str = "tick", since: str = "tick", tie: str = "idx") -> DataFrame:
    """joins.last_known() by ranges of whole numbers at and since: only key, time and value go through the sort; the rows' columns are joined to it by their time.

    `at` is unique within a rig.
    """
    left = rows.select("rig_id", F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_tie"), F.lit(None).cast(facts.schema[value].dataType).alias("_value"))
    right = facts.where(F.col(value).isNotNull()).select("rig_id", F.col(since).alias("_at"), F.lit(0).alias("_kind"), F.col(tie).cast("long").alias("_tie"), F.col(value).alias("_value"))
    both = left.union(right).withColumn("_range", F.floor(F.col("_at") / ticks).cast("long"))
    ends = both.groupBy("rig_id", "_range").agg(F.max_by("_value", F.when(F.col("_kind") == 0, F.struct("_at", "_tie"))).alias("_end"))
    handed = ends.select("rig_id", "_range", F.last("_end", ignorenulls=True).over(_along("rig_id", order="_range").rowsBetween(*_ALL_BEFORE)).alias("_end"))
    inside = Window.partitionBy("rig_id", "_range").orderBy("_at", "_kind", "_tie").rowsBetween(*_SO_FAR)
    found = both.withColumn("_value", F.last("_value", ignorenulls=True).over(inside)).where("_kind = 1").join(handed, ["rig_id", "_range"])
    found = found.select("rig_id", F.col("_at").alias(at), F.coalesce("_value", "_end").alias(value))
    return rows.join(found, ["rig_id", at], "left")


def _equal_run(values, own):
    """How many of an array's first values equal `own`."""
    place = F.array_position(F.transform(values, lambda x: x != own), True)
    return F.when(place == 0, F.size(values)).otherwise(place - 1)


def apply_states(minutes: DataFrame, cfg: StateThresholds = StateThresholds(), size: int = ROWS, ticks: int = TICKS) -> DataFrame:
    """state.apply_states() by blocks; adds i and block too, and opens (whether a span of the state begins). What blocks work out is written once."""
    reach = cfg.trip_rows + cfg.vote_rows + cfg.min_run + 1
    near = with_halo(numbered(minutes, ticks=ticks), reach, reach, size)
    order = _along("rig_id", "block", order="i")
    out = near.withColumn("seg_start", F.coalesce(F.col("tick") - F.lag("tick").over(order) != 1, F.lit(True)))
    out = out.withColumn("_seg", F.sum(F.col("seg_start").cast("long")).over(order))
    out = classify(out.withColumns(context_columns(_along("rig_id", "block", "_seg", order="i"), cfg)), cfg)
    out = majority(out, order, cfg)
    most = cfg.min_run - 1
    before = F.reverse(F.collect_list("voted").over(order.rowsBetween(-most, -1)))
    after = F.collect_list("voted").over(order.rowsBetween(1, most))
    out = out.withColumns({"_before": before, "_after": after}) if most else out.withColumns({"_before": F.array().cast("array<string>"), "_after": F.array().cast("array<string>")})
    out = out.withColumn("_long", _equal_run(F.col("_before"), F.col("voted")) + _equal_run(F.col("_after"), F.col("voted")) + 1 >= cfg.min_run)
    judged = written(out.where("own").drop("own", "_seg", "_before", "_after"), "judged")

    ends = judged.groupBy("rig_id", "block").agg(
        F.sum(F.col("seg_start").cast("long")).alias("starts"), F.max_by("voted", F.when(F.col("_long"), F.col("i"))).alias("last"), F.min_by("voted", "i").alias("first"), F.max("tick").alias("end")
    )
    along = _along("rig_id")
    first = F.first("first").over(along.rowsBetween(*_SO_FAR))  # a short first run keeps its state, and rows before any long run take it
    handed = ends.select(
        "rig_id", "block",
        F.coalesce(F.sum("starts").over(along.rowsBetween(*_ALL_BEFORE)), F.lit(0)).alias("_seg"),
        F.coalesce(F.last("last", ignorenulls=True).over(along.rowsBetween(*_ALL_BEFORE)), first).alias("_state"),
        F.lag("end").over(along).alias("_tick"),
    )
    out = judged.join(handed, ["rig_id", "block"])
    out = out.withColumn("seg", F.col("_seg") + F.sum(F.col("seg_start").cast("long")).over(order))
    out = out.withColumn("state", F.coalesce(F.last(F.when(F.col("_long"), F.col("voted")), ignorenulls=True).over(order.rowsBetween(*_SO_FAR)), "_state"))
    changed = F.coalesce(F.lag("state").over(order), F.when(F.col("block") > 0, F.col("_state"))) != F.col("state")
    apart = F.col("tick") - F.coalesce(F.lag("tick").over(order), "_tick") != 1
    return out.withColumn("opens", F.coalesce(changed | apart, F.lit(True))).drop("_seg", "_state", "_tick", "_long")


def state_spans(minutes: DataFrame, step: int = 1) -> DataFrame:
    """segments.state_spans() of what apply_states() gives: spans are made within blocks, and those that go on over a border are joined."""
    order = _along("rig_id", "block", order="i")
    marked = minutes.withColumn("_span", F.sum(F.col("opens").cast("long")).over(order))
    pieces = marked.groupBy("rig_id", "block", "_span").agg(
        F.min_by("state", "tick").alias("state"), F.min("tick").alias("a"), F.max("tick").alias("b"), F.count("*").alias("minutes"),
        F.min_by("hole_depth", "tick").alias("depth_from"), F.max_by("hole_depth", "tick").alias("depth_to"), F.sum("d_hole").alias("footage"), F.max("opens").alias("opens"),
    )
    pieces = written(pieces, "span-pieces")
    opened = pieces.groupBy("rig_id", "block").agg(F.sum(F.col("opens").cast("long")).alias("n"))
    handed = opened.select("rig_id", "block", F.coalesce(F.sum("n").over(_along("rig_id").rowsBetween(*_ALL_BEFORE)), F.lit(0)).alias("_spans"))
    spans = pieces.join(handed, ["rig_id", "block"]).groupBy("rig_id", (F.col("_spans") + F.col("_span")).alias("span"))
    found = spans.agg(
        F.min_by("state", "a").alias("state"), F.min("a").alias("a"), F.max("b").alias("b"), F.sum("minutes").alias("minutes"),
        F.min_by("depth_from", "a").alias("depth_from"), F.max_by("depth_to", "b").alias("depth_to"), F.round(F.sum("footage"), 1).alias("footage"),
    )
    return found.select("rig_id", "state", tick_start("a", step).alias("t_from"), tick_start(F.col("b") + 1, step).alias("t_to"), "minutes", "depth_from", "depth_to", "footage")


def trip_baseline(minutes: DataFrame, cfg: DetectorConfig = DetectorConfig(), size: int = ROWS) -> DataFrame:
    """detect.trip_baseline() of rows with i, block, seg and seg_start: peaks are numbered by what blocks hand on, and windowed in blocks of peaks."""
    order = _along("rig_id", "block", order="i")
    tripping = (F.col("state") == "TRIPPING_OUT") & F.col("HKLA").isNotNull()
    out = minutes.withColumn("_trip", tripping.cast("long")).withColumn("_here", F.coalesce(F.sum("_trip").over(order.rowsBetween(*_ALL_BEFORE)), F.lit(0)))
    ends = out.groupBy("rig_id", "block").agg(F.sum("_trip").alias("n"), F.max_by("_here", F.when(F.col("seg_start"), F.col("i"))).alias("at_start"))
    ends = ends.withColumn("_trips", F.coalesce(F.sum("n").over(_along("rig_id").rowsBetween(*_ALL_BEFORE)), F.lit(0)))
    handed = ends.select("rig_id", "block", "_trips", F.last(F.col("_trips") + F.col("at_start"), ignorenulls=True).over(_along("rig_id").rowsBetween(*_ALL_BEFORE)).alias("_at_start"))
    out = out.join(handed, ["rig_id", "block"]).withColumn("_all", F.col("_trips") + F.col("_here"))
    at_start = F.coalesce(F.last(F.when(F.col("seg_start"), F.col("_all")), ignorenulls=True).over(order.rowsBetween(*_SO_FAR)), "_at_start")
    out = written(out.withColumn("trips_before", F.col("_all") - at_start).drop("_here", "_trips", "_at_start"), "trips")
    peaks = with_halo(out.where("_trip = 1").select("rig_id", "seg", (F.col("trips_before") + 1).alias("trips"), F.col("_all").alias("i"), F.col("HKLA.max").alias("peak")), cfg.overpull_baseline - 1, 0, size)
    last = _along("rig_id", "block", "seg", order="i").rowsBetween(-cfg.overpull_baseline + 1, 0)
    peaks = peaks.withColumn("base", F.percentile("peak", F.lit(cfg.overpull_quantile)).over(last)).where(F.col("own") & (F.col("trips") >= cfg.overpull_least))
    peaks = peaks.select("rig_id", "seg", F.col("trips").alias("trips_before"), "base")
    return out.drop("_trip", "_all").join(peaks, ["rig_id", "seg", "trips_before"], "left")


def bases(minutes: DataFrame, cfg: DetectorConfig = DetectorConfig(), size: int = ROWS) -> DataFrame:
    """Rows of apply_states() with all that the detectors compare them with, from one window pass over blocks with halos and one over trips."""
    near = with_halo(minutes.drop("block"), max(cfg.washout_baseline, cfg.flow_baseline, cfg.overpull_context), cfg.overpull_context, size)
    order = _along("rig_id", "block", order="i")
    out = detect.flow_bases(detect.washout_bases(detect.episode(near, rows=cfg.overpull_context, order=order), cfg, order), cfg, order)
    return trip_baseline(out.where("own").drop("own"), cfg, size)


def detect_all(minutes: DataFrame, offsets: DataFrame, cfg: DetectorConfig = DetectorConfig(), step: int = 1, size: int = ROWS, ticks: int = TICKS) -> DataFrame:
    """detect.detect_all() of what apply_states() gives, with hole sizes; no rig is sorted as a whole. Runs are numbered as rows are."""
    known = written(bases(minutes.select(*detect.BUCKET, "i", "block", "seg_start"), cfg, size), "bases")

    def runs(flagged, least, aggregates, keys=()):
        found = numbered(flagged, ("rig_id", *keys), ticks=ticks, out="_n").groupBy("rig_id", *keys, (F.col("tick") - F.col("_n")).alias("run"))
        found = found.agg(F.min("tick").alias("tick_from"), F.max("tick").alias("tick_to"), F.count("*").alias("minutes"), *aggregates).where(F.col("minutes") >= least).drop("run")
        return numbered(written(found, "runs"), ("rig_id", *keys), "tick_from", ticks, "_n").withColumn("ordinal", (F.col("_n") + 1).cast("int")).drop("_n")

    flags = (detect.stick_slip_flags(known, cfg), detect.washout_where(known, cfg), detect.overpull_where(known, cfg), detect.flow_where(known, cfg), detect.envelope_flags(known, offsets))
    return detect.in_order([f(x, cfg, step, runs) for f, x in zip(detect.EVENTS_OF, flags, strict=True)])

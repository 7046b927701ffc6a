"""Joins in time: as-of, overlap, range, nearest, and the reference-envelope joins.

Broadcast hints are given to one-row sides and to constant tables only; other sides are left to the planner, which knows
their sizes at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ACTIVITY_STATES
from ..functions.scalars import against_limit, epoch_seconds


def last_known(rows: DataFrame, facts: DataFrame, value: str, keys: list[str], at: str = "t", since: str = "start", tie: str = "idx") -> DataFrame:
    """Backward as-of join: add to every row the newest fact's `value` with since <= at; null before the first.

    Facts without a value are left out; of facts with an equal start the last by `tie` holds. A union and a window over the keys, so
    neither side is gathered; rows keep all their columns.
    """
    payload = F.struct(*rows.columns)
    left = rows.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_tie"), F.lit(None).cast(facts.schema[value].dataType).alias("_value"), payload.alias("_row"))
    right = facts.where(F.col(value).isNotNull()).select(*keys, F.col(since).alias("_at"), F.lit(0).alias("_kind"), F.col(tie).cast("long").alias("_tie"), F.col(value).alias("_value"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("_at", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn(value, F.last("_value", ignorenulls=True).over(order)).where("_kind = 1")
    return found.select("_row.*", value)


def hole_sizes(minutes: DataFrame, reports: DataFrame) -> DataFrame:
    """Add hole_size: the last one reported for the rig before or at each bucket. It never expires."""
    return last_known(minutes, reports.select("rig_id", "start", "idx", "hole_size"), "hole_size", ["rig_id"])


def busiest_overlap(window: DataFrame, reports: DataFrame, name: str = "well") -> DataFrame:
    """The value of `name` with most report rows of the rig that overlap its window (rig_id, t_from, t_to) strictly; the earliest report breaks ties.

    Without any overlap the value is UNKNOWN.
    """
    inside = reports.join(window, "rig_id").where((F.col("end") > F.col("t_from")) & (F.col("start") < F.col("t_to")))
    counted = inside.groupBy("rig_id", name).agg(F.count("*").alias("reports"), F.min(F.struct("start", "idx")).alias("first"))
    place = F.row_number().over(Window.partitionBy("rig_id").orderBy(F.desc("reports"), "first"))
    top = counted.withColumn("place", place).where("place = 1").select("rig_id", name, "reports")
    return window.select("rig_id").join(top, "rig_id", "left").select("rig_id", F.coalesce(name, F.lit("UNKNOWN")).alias(name), F.coalesce("reports", F.lit(0).cast("long")).alias("reports"))


BITS, LEVELS = 4, 14  #: a piece of level n is 2**(BITS * n) whole numbers long, and begins at a multiple of that


def pieces(intervals: DataFrame, first: str = "first", until: str = "until") -> DataFrame:
    """Cut every interval [first, until) of whole numbers into aligned pieces, and add level and piece, its number on that level.

    There are at most 30 pieces of each level below an interval's longest piece, so their number grows with the logarithm of the interval's length.
    An interval that is empty, reversed or without a bound has none. Bounds lie within 2**55 of 0.
    """
    length = F.col(until) - F.col(first)
    top = F.least(F.lit(LEVELS - 1), F.floor(F.log2(length) / BITS).cast("int"))
    cut = intervals.where(length > 0).withColumn("level", F.explode(F.sequence(F.lit(0), top)))
    begin = lambda level: f"shiftright({first} + shiftleft(1L, {BITS} * {level}) - 1, {BITS} * {level})"
    end = lambda level: f"shiftright({until}, {BITS} * {level})"
    cut = cut.withColumns({"_a": F.expr(begin("level")), "_b": F.expr(end("level"))}).where("_a < _b")
    # What the next level takes, from _c to before _d; the rest of [_a, _b) is this level's own.
    cut = cut.withColumn("_c", F.expr(f"least(shiftleft({begin('(level + 1)')}, {BITS}), _b)"))
    cut = cut.withColumn("_d", F.expr(f"greatest(shiftleft({end('(level + 1)')}, {BITS}), _c)"))
    own = [F.expr(f"if({x} < {y}, sequence({x}, {y} - 1), cast(array() as array<bigint>))") for x, y in (("_a", "_c"), ("_d", "_b"))]
    return cut.withColumn("piece", F.explode(F.concat(*own))).drop("_a", "_b", "_c", "_d")


def within(points: DataFrame, intervals: DataFrame, keys: list[str], at: str = "at", first: str = "first", until: str = "until") -> DataFrame:
    """Range join: every point with each interval of equal keys that has first <= at < until; repeated rows on either side count each.

    Intervals are cut into aligned pieces and a point asks once on each level that has pieces, so equality joins them whatever their length. Columns
    are the keys, then those of the intervals but for first and until, then those of the points; names of both sides must differ.
    Null keys, points and bounds meet nothing.
    """
    cut = pieces(intervals, first, until).drop(first, until)
    levels = cut.agg(F.collect_set("level").alias("_levels"))  # one row of LEVELS numbers at most
    asked = points.crossJoin(F.broadcast(levels)).withColumn("level", F.explode("_levels")).drop("_levels")
    asked = asked.withColumn("piece", F.expr(f"shiftright(cast({at} as bigint), {BITS} * level)"))
    return cut.join(asked, [*keys, "level", "piece"]).drop("level", "piece")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], first: str = "first", until: str = "until") -> DataFrame:
    """(keys, l, r): every pair of intervals of equal keys that share a whole number, as structs of the two rows; no pair comes twice.

    Of two such intervals the later one begins within the other: either the right one at or after the left one's beginning, or the left one
    after the right one's. Empty intervals overlap nothing.
    """
    whole = {name: df.where(F.col(first) < F.col(until)) for name, df in (("l", left), ("r", right))}
    flat = {name: [F.col(c).alias(f"_{name}{k}") for k, c in enumerate(df.columns)] for name, df in whole.items()}
    rows = [F.struct(*(F.col(f"_{name}{k}").alias(c) for k, c in enumerate(df.columns))).alias(name) for name, df in whole.items()]
    found = []
    for outer, inner, later in (("l", "r", 0), ("r", "l", 1)):
        spans = whole[outer].select(*keys, (F.col(first) + later).alias("_first"), F.col(until).alias("_until"), *flat[outer])
        starts = whole[inner].select(*keys, F.col(first).alias("_at"), *flat[inner])
        found.append(within(starts, spans, keys, "_at", "_first", "_until").select(*keys, *rows))
    return found[0].unionByName(found[1])


def covered_buckets(minutes: DataFrame, reports: DataFrame, step: int = 1, columns: tuple[str, ...] = ()) -> DataFrame:
    """Range join: the observed buckets that begin in [start, end) of a report, counted from its start by whole steps.

    Reports may be of any length; a bucket under two reports comes twice.
    """
    seconds = F.lit(60 * step)
    first, last = epoch_seconds("start"), epoch_seconds("end")
    whole = reports.where((first < last) & (first % seconds == 0))
    ticks = ((first / seconds).cast("long").alias("_first"), (F.floor((last - 1) / seconds).cast("long") + 1).alias("_until"))
    return within(minutes, whole.select("rig_id", *columns, *ticks), ["rig_id"], "tick", "_first", "_until")


def agreement(minutes: DataFrame, reports: DataFrame, step: int = 1) -> DataFrame:
    """Per rig and reported activity with expected states: minutes, matched, percent, and the three commonest detected states."""
    rows = [(a, list(states)) for a, states in ACTIVITY_STATES.items()]
    expects = minutes.sparkSession.createDataFrame(rows, "activity string, expects array<string>")
    known = reports.join(F.broadcast(expects), "activity")
    pairs = covered_buckets(minutes.select("rig_id", "tick", "state"), known, step, ("activity", "expects"))
    counted = pairs.groupBy("rig_id", "activity", "state").agg(F.count("*").alias("minutes"), F.sum(F.array_contains("expects", F.col("state")).cast("long")).alias("matched"))
    place = F.row_number().over(Window.partitionBy("rig_id", "activity").orderBy(F.desc("minutes"), "state"))
    top = F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "state", "minutes")))
    out = counted.withColumn("place", place).groupBy("rig_id", "activity").agg(F.sum("minutes").alias("ddr_minutes"), F.sum("matched").alias("matched_minutes"), F.array_sort(top).alias("top"))
    percent = F.round(F.lit(100.0) * F.col("matched_minutes") / F.col("ddr_minutes"), 1)
    shown = F.transform("top", lambda x: F.struct(x["state"].alias("state"), x["minutes"].alias("minutes")))
    return out.select("rig_id", "activity", "ddr_minutes", "matched_minutes", percent.alias("agreement"), shown.alias("top_detected"))


def overall_agreement(rows: DataFrame) -> DataFrame:
    """One row over all rigs."""
    total = F.sum("ddr_minutes")
    return rows.agg(F.coalesce(F.round(F.try_divide(F.lit(100.0) * F.sum("matched_minutes"), total), 1), F.lit(0.0)).alias("overall"), F.coalesce(total, F.lit(0).cast("long")).alias("scored_minutes"))


def nearest(points: DataFrame, rows: DataFrame, keys: list[str], value: str, at: str = "t", when: str = "t") -> DataFrame:
    """Add the value of the row nearest in time to each point, the earlier one in a tie.

    The last row before and the first row after are found by one union and two windows, without a theta join.
    """
    left = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_row"))
    right = rows.select(*keys, F.col(when).alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col(when).alias("w"), F.col(value).alias("v")).alias("_fact"))
    both = left.unionByName(right, allowMissingColumns=True)
    back = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_at"), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # backwards, for frames that grow at their start take quadratic time
    both = both.withColumns({"_l": F.last("_fact", ignorenulls=True).over(back), "_r": F.last("_fact", ignorenulls=True).over(ahead)}).where("_kind = 1")
    before = epoch_seconds("_at") - epoch_seconds("_l.w")
    after = epoch_seconds("_r.w") - epoch_seconds("_at")
    chosen = F.when(F.col("_r").isNull() | (before <= after), F.col("_l.v")).otherwise(F.col("_r.v"))
    return both.select("_row.*", chosen.alias(value))


def last_envelopes(offsets: DataFrame) -> DataFrame:
    """One ceiling row per hole size, the last of the table (column idx)."""
    sized = offsets.where(F.col("hole_size").isNotNull())
    columns = [c for c in offsets.columns if c != "hole_size"]
    return sized.groupBy("hole_size").agg(F.max_by(F.struct(*columns), "idx").alias("o")).select("hole_size", "o.*")


def live_maxima(minutes: DataFrame) -> DataFrame:
    """Per hole size, on-bottom minutes and the greatest rate and p90s while making hole, 0 at least."""
    made = minutes.where(F.col("state").isin("DRILLING", "SLIDING") & F.col("hole_size").isNotNull())
    top = lambda c: F.greatest(F.coalesce(F.max(c), F.lit(0.0)), F.lit(0.0))
    return made.groupBy("hole_size").agg(
        F.count("*").alias("minutes"),
        top(F.col("rop_calc")).alias("rop"),
        *(top(F.col(f"{c}.p90")).alias(n) for c, n in (("MFIA", "flow"), ("WOB", "wob"), ("SPP", "spp"), ("HKLA", "hookload"), ("TORQUE", "torque"))),
    )


def envelope(offsets: DataFrame, minutes: DataFrame, unmatched: bool = True) -> DataFrame:
    """Every offset row against the live maxima of its hole size; without `unmatched`, only those that have minutes."""
    joined = offsets.join(live_maxima(minutes), "hole_size", "left" if unmatched else "inner")
    pairs = (("rop", "max_rop"), ("flow", "max_flow_rate"), ("wob", "max_wob"), ("spp", "max_spp"), ("hookload", "max_pu_weight"), ("torque", "max_torque"))
    compared = [F.when(F.col("minutes").isNotNull(), against_limit(live, limit)).alias(f"vs_{live}") for live, limit in pairs]
    return joined.select("hole_size", "section", F.coalesce("minutes", F.lit(0).cast("long")).alias("minutes"), *compared)


def members(rows: DataFrame, chosen: DataFrame, key: Column | str) -> DataFrame:
    """Semi join."""
    return rows.join(chosen, key, "left_semi")


def others(rows: DataFrame, chosen: DataFrame, key: Column | str) -> DataFrame:
    """Anti join."""
    return rows.join(chosen, key, "left_anti")

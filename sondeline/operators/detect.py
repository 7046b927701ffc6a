"""Five rule-based detectors over classified minutes, and their union.

All are windows of one rig, then a filter, then runs of flagged buckets: filters stand above the windows, for baselines need
every row. Each detector returns EVENT columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import ENVELOPE_LIMITS, MAKING_HOLE, PUMPS_ON, DetectorConfig
from ..functions.scalars import half_up, severity, tick_start
from .joins import last_envelopes
from ..sources.staging import written
from .segments import long_runs, with_segments

EVENT = ("rig_id", "id", "type", "severity", "confidence", "t_from", "t_to", "minutes", "depth_from", "depth_to", "headline", "evidence", "caveat")

CAVEATS = {
    "STICK_SLIP": "Torque is sampled too slowly for the period of stick-slip: a relative ranking, not a calibrated percentage.",
    "WASHOUT": "Pressure alone doesn't tell a washout from a lost nozzle or a pump problem: confirm by strokes and a pressure test.",
    "OVERPULL": None,
    "FLOW_IMBALANCE": "The return-flow channel isn't a calibrated percentage: only its drift means something.",
    "ENVELOPE_EXCEEDANCE": "The ceiling is one well's greatest value, not an operating limit: a prompt to check the plan.",
}


#: What the detectors read of a bucket.
BUCKET = ("rig_id", "tick", "seg", "state", "hole_size", "hole_depth", "bit_depth", "off_bottom", "torque_median", "torque_nmad", "torque_valid", "torque_zero_fill", "RPM", "WOB", "SPP", "MFIA", "MFOP", "HKLA", "TORQUE")


def _order():
    return Window.partitionBy("rig_id").orderBy("tick")


def _median(c: Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def _ends(c: str) -> list[Column]:
    return [F.min_by(c, "tick").alias("depth_from"), F.max_by(c, "tick").alias("depth_to")]


def _events(found: DataFrame, kind: str, prefix: Column | str, level: Column, confidence: str, headline: Column, evidence: dict[str, Column], step: int) -> DataFrame:
    name = F.concat(prefix if isinstance(prefix, Column) else F.lit(prefix), F.lit("-"), F.col("ordinal").cast("string"))
    pairs = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))]
    return found.select(
        "rig_id",
        name.alias("id"),
        F.lit(kind).alias("type"),
        level.alias("severity"),
        F.lit(confidence).alias("confidence"),
        tick_start("tick_from", step).alias("t_from"),
        tick_start(F.col("tick_to") + 1, step).alias("t_to"),
        "minutes",
        "depth_from",
        "depth_to",
        headline.alias("headline"),
        F.create_map(*pairs).alias("evidence"),
        F.lit(CAVEATS[kind]).cast("string").alias("caveat"),
    )


def _number(c: Column | str, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f", F.coalesce(F.round(F.col(c) if isinstance(c, str) else c, digits), F.lit(0.0)))


def trailing_median(minutes: DataFrame, value: Column, rows: int, out: str, order: WindowSpec | None = None) -> DataFrame:
    """Add the median of the positive values of the `rows` rows before; null unless these are contiguous with the row."""
    order = order or _order()
    window = order.rowsBetween(-rows, -1)
    whole = F.col("tick") - F.lag("tick", rows).over(order) == rows
    return minutes.withColumn(out, F.when(whole, F.percentile(F.when(value > 0, value), F.lit(0.5)).over(window)))


def stick_slip_flags(minutes: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    rpm = F.col("RPM.mean")
    return minutes.where(
        (rpm >= cfg.stick_min_rpm)
        & (F.col("off_bottom") <= cfg.on_bottom_ft)
        & (F.col("WOB.sd") <= cfg.stick_max_wob_sd)
        & (F.try_divide(F.col("RPM.sd"), rpm) <= cfg.stick_max_rpm_cov)
        & (F.col("torque_median") >= cfg.stick_min_torque)
        & (F.col("torque_valid") >= cfg.stick_min_valid)
        & (F.col("torque_nmad") >= cfg.stick_watch)
    )


def stick_slip(minutes: DataFrame, cfg: DetectorConfig = DetectorConfig(), step: int = 1) -> DataFrame:
    """Torque dispersion high on bottom while WOB and RPM are steady. No state is asked for."""
    return stick_slip_events(stick_slip_flags(minutes, cfg), cfg, step)


def stick_slip_events(flagged: DataFrame, cfg: DetectorConfig, step: int, find=long_runs) -> DataFrame:
    aggregates = [
        *_ends("hole_depth"),
        F.max("torque_nmad").alias("peak"),
        _median(F.col("torque_median")).alias("torque"),
        _median(F.col("RPM.mean")).alias("rpm"),
        _median(F.col("RPM.sd") / F.col("RPM.mean")).alias("cov"),
        _median(F.col("WOB.mean")).alias("wob"),
        _median(F.col("WOB.sd")).alias("wob_sd"),
        _median(F.col("torque_valid").cast("double")).alias("valid"),
        _median(F.col("torque_zero_fill").cast("double")).alias("zeros"),
    ]
    found = find(flagged, cfg.stick_min_minutes, aggregates)
    level = severity(F.col("peak"), cfg.stick_watch, cfg.stick_warn, cfg.stick_alarm)
    crossed = F.when(level == "ALARM", cfg.stick_alarm).when(level == "WARN", cfg.stick_warn).otherwise(cfg.stick_watch)
    headline = F.format_string("Torque swings for %d min at %s ft: median %s ft-lb, WOB near %s klb, RPM at %s.", "minutes", _number("depth_from", 0), _number("torque", 0), _number("wob"), _number("rpm", 0))
    evidence = {
        "torqueDispersionIndex": F.round("peak", 2),
        "thresholdCrossed": crossed,
        "medianTorqueFtLb": F.round("torque", 0),
        "medianRpm": F.round("rpm", 0),
        "rpmSteadiness": F.round("cov", 3),
        "medianWobKlb": F.round("wob", 1),
        "wobSteadinessKlb": F.round("wob_sd", 2),
        "samplesUsedPerMin": half_up(F.col("valid")),
        "zeroFillDropped": half_up(F.col("zeros")),
    }
    return _events(found, "STICK_SLIP", "ss", level, "MEDIUM", headline, evidence, step)


def washout_bases(minutes: DataFrame, cfg: DetectorConfig, order: WindowSpec | None = None) -> DataFrame:
    """Add pressure, flow, base_spp and base_flow."""
    spp, flow = F.coalesce("SPP.mean", F.lit(0.0)), F.coalesce("MFIA.mean", F.lit(0.0))
    out = trailing_median(minutes.withColumns({"pressure": spp, "flow": flow}), F.col("pressure"), cfg.washout_baseline, "base_spp", order)
    return trailing_median(out, F.col("flow"), cfg.washout_baseline, "base_flow", order)


def washout_where(based: DataFrame, cfg: DetectorConfig) -> DataFrame:
    out = based.where(F.col("state").isin(*PUMPS_ON) & (F.col("pressure") >= cfg.washout_min_spp) & (F.col("flow") >= cfg.min_flow))
    out = out.where((F.col("base_spp") >= cfg.washout_min_spp) & (F.col("base_flow") >= cfg.min_flow))
    out = out.withColumn("drop_pct", (F.col("base_spp") - F.col("pressure")) / F.col("base_spp") * 100)
    flow_pct = F.abs(F.col("flow") - F.col("base_flow")) / F.col("base_flow") * 100
    return out.where((F.col("drop_pct") >= cfg.washout_drop_pct) & (flow_pct <= cfg.washout_flow_pct))


def washout(minutes: DataFrame, cfg: DetectorConfig = DetectorConfig(), step: int = 1) -> DataFrame:
    """Standpipe pressure below its trailing median while flow in holds."""
    return washout_events(washout_where(washout_bases(minutes, cfg), cfg), cfg, step)


def washout_events(flagged: DataFrame, cfg: DetectorConfig, step: int, find=long_runs) -> DataFrame:
    aggregates = [
        *_ends("hole_depth"),
        F.max("drop_pct").alias("peak"),
        F.min_by("base_spp", "tick").alias("base"),
        F.min("pressure").alias("lowest"),
        F.min_by("flow", "tick").alias("flow_first"),
        F.max_by("flow", "tick").alias("flow_last"),
    ]
    found = find(flagged, cfg.washout_min_minutes, aggregates)
    level = severity(F.col("peak"), float("-inf"), cfg.washout_warn_pct, cfg.washout_alarm_pct)
    headline = F.format_string("Standpipe pressure down %s%% for %d min at %s ft, flow in at %s gpm: possible washout.", _number("peak"), "minutes", _number("depth_from", 0), _number("flow_first", 0))
    evidence = {
        "sppDropPct": F.round("peak", 1),
        "baselineSppPsi": F.round("base", 0),
        "lowestSppPsi": F.round("lowest", 0),
        "flowInGpm": F.round("flow_first", 0),
        "flowChangePct": F.round(F.abs(F.col("flow_last") - F.col("flow_first")) / F.col("flow_first") * 100, 2),
        "sustainedMinutes": F.col("minutes"),
    }
    return _events(found, "WASHOUT", "wo", level, "MEDIUM", headline, evidence, step)


def episode(minutes: DataFrame, state: str = "TRIPPING_OUT", rows: int = 10, out: str = "in_trip", order: WindowSpec | None = None) -> DataFrame:
    """Add whether the state occurs within so many rows to either side, over gaps too."""
    return minutes.withColumn(out, F.max(F.col("state") == state).over((order or _order()).rowsBetween(-rows, rows)))


def trip_baseline(minutes: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Add base: the upper quantile of the last peaks while tripping out in the row's segment, the row left out; null for too few.

    Peaks of tripping rows are numbered within the segment, their sliding quantile is taken there, and each row
    looks up the quantile by the number of tripping rows before it.
    """
    out = minutes if "seg" in minutes.columns else with_segments(minutes)
    tripping = (F.col("state") == "TRIPPING_OUT") & F.col("HKLA").isNotNull()
    before = Window.partitionBy("rig_id", "seg").orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("trips_before", F.coalesce(F.sum(tripping.cast("long")).over(before), F.lit(0).cast("long")))
    last = Window.partitionBy("rig_id", "seg").orderBy("tick").rowsBetween(-cfg.overpull_baseline + 1, 0)
    peaks = out.where(tripping).select(
        F.col("rig_id").alias("b_rig"), F.col("seg").alias("b_seg"), (F.col("trips_before") + 1).alias("b_trips"), F.percentile(F.col("HKLA.max"), F.lit(cfg.overpull_quantile)).over(last).alias("base")
    )
    same = (F.col("rig_id") == F.col("b_rig")) & (F.col("seg") == F.col("b_seg")) & (F.col("trips_before") == F.col("b_trips"))
    joined = out.join(peaks.where(F.col("b_trips") >= cfg.overpull_least), same, "left")
    return joined.drop("b_rig", "b_seg", "b_trips")


def overpull_where(based: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """Rows of what episode() and trip_baseline() give, with over."""
    out = based.withColumn("over", F.col("HKLA.max") - F.col("base"))
    return out.where(F.col("in_trip") & (F.col("off_bottom") > cfg.on_bottom_ft) & (F.col("base") >= cfg.overpull_min_base) & (F.col("over") >= cfg.overpull_klb))


def overpull(minutes: DataFrame, cfg: DetectorConfig = DetectorConfig(), step: int = 1) -> DataFrame:
    """Hookload peaks above the normal pick-up weight near a trip out, the string's stalls included."""
    return overpull_events(overpull_where(trip_baseline(episode(minutes, rows=cfg.overpull_context), cfg), cfg), cfg, step)


def overpull_events(flagged: DataFrame, cfg: DetectorConfig, step: int, find=long_runs) -> DataFrame:
    worst = F.max_by(F.struct(F.col("bit_depth").alias("depth"), F.col("HKLA.max").alias("peak"), "base"), F.struct("over", -F.col("tick")))
    aggregates = [worst.alias("worst"), F.max("over").alias("over"), F.max_by("bit_depth", "tick").alias("depth_to")]
    found = find(flagged, cfg.overpull_min_minutes, aggregates).withColumn("depth_from", F.col("worst.depth"))
    level = severity(F.col("over"), float("-inf"), cfg.overpull_warn_klb, cfg.overpull_alarm_klb)
    headline = F.format_string("Overpull of %s klb while tripping out at %s ft: hookload %s klb, normal %s klb.", _number("over"), _number("depth_from", 0), _number("worst.peak"), _number("worst.base"))
    evidence = {
        "overpullKlb": F.round("over", 1),
        "peakHookloadKlb": F.round("worst.peak", 1),
        "normalPickupKlb": F.round("worst.base", 1),
        "bitDepthFt": F.round(F.coalesce("depth_from", F.lit(0.0)), 0),
        "sustainedMinutes": F.col("minutes"),
    }
    return _events(found, "OVERPULL", "op", level, "HIGH", headline, evidence, step)


def flow_bases(minutes: DataFrame, cfg: DetectorConfig, order: WindowSpec | None = None) -> DataFrame:
    """Add back, flow, base_back and base_inflow."""
    back, flow = F.coalesce("MFOP.mean", F.lit(0.0)), F.coalesce("MFIA.mean", F.lit(0.0))
    out = trailing_median(minutes.withColumns({"back": back, "flow": flow}), F.col("back"), cfg.flow_baseline, "base_back", order)
    return trailing_median(out, F.col("flow"), cfg.flow_baseline, "base_inflow", order)


def flow_where(based: DataFrame, cfg: DetectorConfig) -> DataFrame:
    out = based.where(F.col("state").isin(*PUMPS_ON) & (F.col("flow") >= cfg.min_flow) & (F.col("back") > 0))
    out = out.where((F.col("base_back") > 0) & (F.col("base_inflow") >= cfg.min_flow))
    out = out.where(F.abs(F.col("flow") - F.col("base_inflow")) / F.col("base_inflow") * 100 <= cfg.flow_steady_pct)
    return out.withColumn("drift", (F.col("back") - F.col("base_back")) / F.col("base_back") * 100).where(F.abs("drift") >= cfg.flow_drift_pct)


def flow_imbalance(minutes: DataFrame, cfg: DetectorConfig = DetectorConfig(), step: int = 1) -> DataFrame:
    """Return flow away from its trailing median while flow in is steady."""
    return flow_events(flow_where(flow_bases(minutes, cfg), cfg), cfg, step)


def flow_events(flagged: DataFrame, cfg: DetectorConfig, step: int, find=long_runs) -> DataFrame:
    worst = F.max_by(F.struct("drift", F.col("hole_depth").alias("depth"), "back", "base_back", "flow"), F.struct(F.abs("drift"), -F.col("tick")))
    found = find(flagged, cfg.flow_min_minutes, [*_ends("hole_depth"), worst.alias("worst")])
    size = F.abs("worst.drift")
    level = F.when(size >= cfg.flow_warn_pct, "WARN").otherwise("WATCH")
    losing = F.col("worst.drift") < 0
    headline = F.format_string(
        "Return flow %s %s%% against its baseline for %d min at %s ft, flow in steady: possible %s.",
        F.when(losing, "down").otherwise("up"), _number(size), "minutes", _number("worst.depth", 0), F.when(losing, "losses").otherwise("gain"),
    )
    evidence = {
        "driftPct": F.round("worst.drift", 1),
        "baselineMfop": F.round("worst.base_back", 1),
        "observedMfop": F.round("worst.back", 1),
        "flowInGpm": F.round("worst.flow", 0),
        "sustainedMinutes": F.col("minutes"),
    }
    return _events(found, "FLOW_IMBALANCE", "fi", level, "LOW", headline, evidence, step)


def envelope_flags(minutes: DataFrame, offsets: DataFrame) -> DataFrame:
    """(.., channel, value, ceiling, section): a row for each channel whose p90 is above its hole size's ceiling while making hole."""
    made = minutes.where(F.col("state").isin(*MAKING_HOLE) & F.col("hole_size").isNotNull())
    joined = made.join(last_envelopes(offsets), "hole_size")
    checks = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(c).alias("channel"), F.col(f"{c}.p90").alias("value"), F.col(limit).cast("double").alias("ceiling")) for k, (c, limit) in enumerate(ENVELOPE_LIMITS.items())))
    rows = joined.withColumn("x", F.explode(checks)).select("rig_id", "tick", "hole_depth", "section", "x.*")
    return rows.where((F.col("ceiling") != 0) & (F.col("value") > F.col("ceiling")))


def envelope_exceedance(minutes: DataFrame, offsets: DataFrame, cfg: DetectorConfig = DetectorConfig(), step: int = 1) -> DataFrame:
    """Runs of a channel above the reference well's ceiling of the same hole size."""
    return envelope_events(envelope_flags(minutes, offsets), cfg, step)


def envelope_events(flagged: DataFrame, cfg: DetectorConfig, step: int, find=long_runs) -> DataFrame:
    worst = F.max_by(F.struct("value", "ceiling", "section"), F.struct("value", -F.col("tick")))
    found = find(flagged, cfg.envelope_min_minutes, [*_ends("hole_depth"), worst.alias("worst")], ("place", "channel"))
    over = (F.col("worst.value") - F.col("worst.ceiling")) / F.col("worst.ceiling") * 100
    level = F.when(over >= cfg.envelope_warn_pct, "WARN").otherwise("WATCH")
    headline = F.format_string("%s ran %s%% above the reference well for %d min: %s against %s.", "channel", _number(over), "minutes", _number("worst.value", 0), _number("worst.ceiling", 0))
    evidence = {
        "channel": F.col("channel"),
        "peakValue": F.round("worst.value", 1),
        "offsetCeiling": F.col("worst.ceiling"),
        "overByPct": F.round(over, 1),
        "holeSection": F.col("worst.section"),
        "sustainedMinutes": F.col("minutes"),
    }
    return _events(found, "ENVELOPE_EXCEEDANCE", F.concat(F.lit("env-"), F.lower("channel")), level, "HIGH", headline, evidence, step)


def detect_all(minutes: DataFrame, offsets: DataFrame, cfg: DetectorConfig = DetectorConfig(), step: int = 1) -> DataFrame:
    """All events in order of time; equal times keep the order of the detectors, then of the ids' numbers.

    The classified buckets, some 1,440 a rig and day, are written once, and the five detectors read the columns that they need.
    """
    minutes = written(minutes.select(*BUCKET), "minutes")
    return in_order([stick_slip(minutes, cfg, step), washout(minutes, cfg, step), overpull(minutes, cfg, step), flow_imbalance(minutes, cfg, step), envelope_exceedance(minutes, offsets, cfg, step)])


#: Events of flagged rows, in the detectors' order.
EVENTS_OF = (stick_slip_events, washout_events, overpull_events, flow_events, envelope_events)


def in_order(parts: list[DataFrame]) -> DataFrame:
    marked = [p.withColumn("detector", F.lit(k)) for k, p in enumerate(parts)]
    both = reduce(DataFrame.unionByName, marked)
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    place = F.array_position(F.array(*(F.lit(c) for c in ENVELOPE_LIMITS)), F.coalesce(F.col("evidence")["channel"], F.lit("")))
    return both.orderBy("t_from", "detector", place, number, "rig_id").select(*EVENT)

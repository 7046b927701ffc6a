"""One query per operator over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ACTIVITY_STATES, CHANNELS, Retrieval
from ..functions import scalars
from ..sources.feeds import read_json, write_table
from ..sources.staging import new_path, written
from ..operators import detect, index, intervals, joins, quality, ranges, rollup, search, segments
from . import driver_feed as feed
from .driver_feed import FINE, STEP, with_feed
from .engine import Engine, alarm_at, distinct_values, filtered_events, observed_days, ordered, report_page

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles to so many places: sums in another order differ in their last bits."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r(*columns: str, digits: int = 8) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rollup

_LONG = " UNION ALL ".join(
    f"SELECT rig_id, t, n, dup_rows, '{c}' AS channel, {c}_n AS readings, round({c}_mean, 8) AS mean, round({c}_min, 8) AS min, round({c}_max, 8) AS max, "
    f"round({c}_sd, 8) AS sd, round({c}_p10, 8) AS p10, round({c}_p50, 8) AS p50, round({c}_p90, 8) AS p90 FROM minute WHERE {c}_n > 0"
    for c in CHANNELS
)


@query(with_feed(_LONG, "minute"))
def minute_rollup(spark, sf_dir):
    rows = F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("s")) for c in CHANNELS))
    long = feed.minutes(spark, sf_dir).select("rig_id", "t", "n", "dup_rows", F.explode(rows).alias("x")).where("x.s is not null")
    return rounded(long.select("rig_id", "t", "n", "dup_rows", "x.channel", F.col("x.s.n").alias("readings"), *(F.col(f"x.s.{p}").alias(p) for p in ("mean", "min", "max", "sd", "p10", "p50", "p90"))))


@query(with_feed(f"SELECT rig_id, t, torque_valid, torque_zero_fill, {r('torque_median', 'torque_nmad', 'torque_ptp')} FROM minute", "minute"))
def torque_cleaning(spark, sf_dir):
    return rounded(feed.minutes(spark, sf_dir).select("rig_id", "t", "torque_valid", "torque_zero_fill", "torque_median", "torque_nmad", "torque_ptp"))


@query(with_feed(f"SELECT rig_id, t, {r('hole_depth', 'bit_depth', 'off_bottom', 'd_hole', 'd_bit', 'rop_calc')} FROM starts", "starts"))
def depth_delta(spark, sf_dir):
    return rounded(feed.minutes(spark, sf_dir).select("rig_id", "t", "hole_depth", "bit_depth", "off_bottom", "d_hole", "d_bit", "rop_calc"))


@query("SELECT event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type, false) AS dup_of_prev FROM events")
def held_frames(spark, sf_dir):
    return rollup.held_frames(feed.events(spark, sf_dir), ["event_type"], "user_id", "event_id").select("event_id", "dup_of_prev")


@query(with_feed("SELECT rig_id, count(*) AS covered, CAST(sum(n) AS BIGINT) AS rows, min(n) AS n_min, list_sort(list(n))[count(*) // 2 + 1] AS n_p50, max(n) AS n_max, round(avg(n), 1) AS n_mean, min(t) AS t_from, max(t) AS t_to FROM minute GROUP BY rig_id", "minute", FINE))
def feed_meta(spark, sf_dir):
    return rollup.feed_meta(feed.minutes(spark, sf_dir, FINE))


@query(with_feed("SELECT rig_id, make_timestamp(b * 60000000) AS t_from, make_timestamp(tick * 60000000) AS t_to, tick - b - 1 AS missing FROM (SELECT rig_id, tick, lag(tick) OVER (PARTITION BY rig_id ORDER BY tick) AS b FROM grouped) WHERE tick - b > 1", "grouped", FINE))
def feed_gaps(spark, sf_dir):
    return segments.feed_gaps(feed.minutes(spark, sf_dir, FINE), FINE)


# State


@query(with_feed(f"SELECT rig_id, t, seg, {r('hole_advance', 'bit_travel')} FROM contexts", "contexts"))
def state_contexts(spark, sf_dir):
    return rounded(feed.states(spark, sf_dir).select("rig_id", "t", "seg", "hole_advance", "bit_travel"))


@query(with_feed("SELECT rig_id, t, raw_state FROM raws", "raws"))
def classify_state(spark, sf_dir):
    return feed.states(spark, sf_dir).select("rig_id", "t", "raw_state")


@query(with_feed("SELECT rig_id, t, voted, state FROM states", "states"))
def smooth_state(spark, sf_dir):
    return feed.states(spark, sf_dir).select("rig_id", "t", "voted", "state")


_SPANS = (
    ("marked", "SELECT *, sum(c) OVER (PARTITION BY rig_id ORDER BY tick) AS span FROM (SELECT *, coalesce(lag(state) OVER w <> state OR tick - lag(tick) OVER w <> 1, true)::INT AS c FROM sized WINDOW w AS (PARTITION BY rig_id ORDER BY tick))"),
    ("spans", "SELECT rig_id, min(state) AS state, make_timestamp(min(tick) * 300000000) AS t_from, make_timestamp((max(tick) + 1) * 300000000) AS t_to, count(*) AS minutes, arg_min(hole_depth, tick) AS depth_from, arg_max(hole_depth, tick) AS depth_to, round(sum(d_hole), 1) AS footage FROM marked GROUP BY rig_id, span"),
)


@query(with_feed(f"SELECT rig_id, state, t_from, t_to, minutes, {r('depth_from', 'depth_to', 'footage', digits=4)} FROM spans", "sized", more=_SPANS))
def state_spans(spark, sf_dir):
    return rounded(segments.state_spans(feed.states(spark, sf_dir), STEP), 4)


@query(with_feed("SELECT rig_id, state, CAST(sum(minutes) AS BIGINT) AS minutes FROM spans GROUP BY rig_id, state", "sized", more=_SPANS))
def state_totals(spark, sf_dir):
    return intervals.state_totals(segments.state_spans(feed.states(spark, sf_dir), STEP))


_FROM, _TO = datetime(2024, 1, 1, 15, 10), datetime(2024, 1, 2, 3, 35)
_ALARM = datetime(2024, 1, 1, 16, 45)  # a rig has an alarm then
_WINDOW = f"TIMESTAMP '{_FROM}'", f"TIMESTAMP '{_TO}'"


@query(with_feed(f"SELECT rig_id, state, t_from, minutes FROM spans WHERE t_to > {_WINDOW[0]} AND t_from < {_WINDOW[1]}", "sized", more=_SPANS))
def span_overlap(spark, sf_dir):
    return intervals.overlapping_spans(segments.state_spans(feed.states(spark, sf_dir), STEP), _FROM, _TO).select("rig_id", "state", "t_from", "minutes")


@query(with_feed(f"SELECT rig_id, state, CAST(sum(greatest(0, epoch(least(t_to, {_WINDOW[1]})) - epoch(greatest(t_from, {_WINDOW[0]})))) / 60e0 AS DOUBLE) AS minutes FROM spans GROUP BY rig_id, state HAVING minutes > 0", "sized", more=_SPANS))
def clipped_state_minutes(spark, sf_dir):
    return intervals.clipped_totals(segments.state_spans(feed.states(spark, sf_dir), STEP), F.lit(_FROM).cast("timestamp_ntz"), F.lit(_TO).cast("timestamp_ntz"))


@query(with_feed("SELECT rig_id, s.state AS span_state, round(m.hole_depth, 6) AS hole_depth FROM (SELECT * FROM spans WHERE t_from <= TIMESTAMP '2024-01-01 22:33' AND TIMESTAMP '2024-01-01 22:33' < t_to) s FULL JOIN (SELECT * FROM sized WHERE t = TIMESTAMP '2024-01-01 22:30') m USING (rig_id)", "sized", more=_SPANS))
def point_lookup(spark, sf_dir):
    minutes = feed.states(spark, sf_dir)
    at = F.lit(datetime(2024, 1, 1, 22, 33)).cast("timestamp_ntz")
    found = intervals.point_lookup(segments.state_spans(minutes, STEP), minutes, at, STEP)
    return found.select("rig_id", F.col("span.state").alias("span_state"), F.round("minute.hole_depth", 6).alias("hole_depth"))


@query(with_feed("SELECT rig_id, make_timestamp(min(tick) * 300000000) AS t_from, count(*) AS minutes, CAST(row_number() OVER (PARTITION BY rig_id ORDER BY min(tick)) AS INT) AS ordinal FROM (SELECT rig_id, tick, tick - row_number() OVER (PARTITION BY rig_id ORDER BY tick) AS run FROM minute WHERE WOB_sd >= 1.15e0) GROUP BY rig_id, run HAVING count(*) >= 3", "minute"))
def flag_runs(spark, sf_dir):
    flagged = feed.minutes(spark, sf_dir).where(F.col("WOB.sd") >= 1.15)
    return segments.long_runs(flagged, 3, []).select("rig_id", scalars.tick_start("tick_from", STEP).alias("t_from"), "minutes", "ordinal")


# Detectors


def _runs_sql(flags: str, least: int, columns: str, keys: str = "") -> tuple:
    """Runs of the rows of `flags` (an expression's name), at least so long, with aggregates, numbered by time."""
    part, comma = (f"PARTITION BY rig_id, {keys}", f"rig_id, {keys}, ") if keys else ("PARTITION BY rig_id", "rig_id, ")
    return (
        ("run_rows", f"SELECT *, tick - row_number() OVER ({part} ORDER BY tick) AS run FROM {flags}"),
        ("found", f"SELECT {comma}min(tick) AS a, max(tick) AS b, count(*) AS minutes, {columns} FROM run_rows GROUP BY {comma}run HAVING count(*) >= {least}"),
        ("events_of", f"SELECT *, row_number() OVER ({part} ORDER BY a) AS k, make_timestamp(a * 300000000) AS t_from, make_timestamp((b + 1) * 300000000) AS t_to FROM found"),
    )


_STICK = (
    ("stick", "SELECT * FROM sized WHERE RPM_mean >= 40e0 AND off_bottom <= 3e0 AND WOB_sd <= 3.0e0 AND RPM_sd / RPM_mean <= 0.15e0 AND torque_median >= 300e0 AND torque_valid >= 10 AND torque_nmad >= 0.95e0"),
    *_runs_sql("stick", 3, "max(torque_nmad) AS peak, quantile_cont(torque_median, 0.5) AS torque, arg_min(hole_depth, tick) AS depth_from"),
)
_STICK_SQL = "SELECT rig_id, concat('ss-', k) AS id, CASE WHEN peak >= 1.21e0 THEN 'ALARM' WHEN peak >= 1.1e0 THEN 'WARN' ELSE 'WATCH' END AS severity, t_from, t_to, minutes, round(depth_from, 4) AS depth_from"


def _shown(events: DataFrame, *evidence: str) -> DataFrame:
    kept = events.select("rig_id", "id", "severity", "t_from", "t_to", "minutes", F.round("depth_from", 4).alias("depth_from"), *(F.round(F.col("evidence")[e].cast("double"), 3).alias(e) for e in evidence))
    return kept


@query(with_feed(f"{_STICK_SQL}, round(peak, 2) AS \"torqueDispersionIndex\" FROM events_of", "sized", more=_STICK))
def stick_slip(spark, sf_dir):
    return _shown(detect.stick_slip(feed.sized(spark, sf_dir), step=STEP), "torqueDispersionIndex")


def _trailing_sql(n: int, value: str, out: str) -> str:
    return f"CASE WHEN tick - lag(tick, {n}) OVER (PARTITION BY rig_id ORDER BY tick) = {n} THEN quantile_cont(CASE WHEN {value} > 0 THEN {value} END, 0.5) OVER (PARTITION BY rig_id ORDER BY tick ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END AS {out}"


_WASH = (
    ("based", f"SELECT *, coalesce(SPP_mean, 0e0) AS spp, coalesce(MFIA_mean, 0e0) AS flow, {_trailing_sql(20, 'SPP_mean', 'base_spp')}, {_trailing_sql(20, 'MFIA_mean', 'base_flow')} FROM sized"),
    ("wash", "SELECT *, (base_spp - spp) / base_spp * 100 AS drop_pct FROM based WHERE state IN ('DRILLING', 'SLIDING', 'CIRCULATING') AND spp >= 400 AND flow >= 300 AND base_spp >= 400 AND base_flow >= 300 AND (base_spp - spp) / base_spp * 100 >= 8 AND abs(flow - base_flow) / base_flow * 100 <= 3"),
    *_runs_sql("wash", 5, "max(drop_pct) AS peak, min(spp) AS lowest, arg_min(hole_depth, tick) AS depth_from"),
)


@query(with_feed(f"SELECT rig_id, t, {r('base_spp', 'base_flow')} FROM based", "sized", more=_WASH))
def trailing_median(spark, sf_dir):
    minutes = feed.sized(spark, sf_dir).withColumns({"spp": F.coalesce("SPP.mean", F.lit(0.0)), "flow": F.coalesce("MFIA.mean", F.lit(0.0))})
    out = detect.trailing_median(detect.trailing_median(minutes, F.col("spp"), 20, "base_spp"), F.col("flow"), 20, "base_flow")
    return rounded(out.select("rig_id", "t", "base_spp", "base_flow"))


@query(with_feed("SELECT rig_id, concat('wo-', k) AS id, CASE WHEN peak >= 20 THEN 'ALARM' WHEN peak >= 13 THEN 'WARN' ELSE 'WATCH' END AS severity, t_from, t_to, minutes, round(depth_from, 4) AS depth_from, round(peak, 1) AS \"sppDropPct\", round(lowest, 0) AS \"lowestSppPsi\" FROM events_of", "sized", more=_WASH))
def washout(spark, sf_dir):
    return _shown(detect.washout(feed.sized(spark, sf_dir), step=STEP), "sppDropPct", "lowestSppPsi")


_PULL = (
    ("near", "SELECT *, max((state = 'TRIPPING_OUT')::INT) OVER (PARTITION BY rig_id ORDER BY tick ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) = 1 AS in_trip, coalesce(sum((state = 'TRIPPING_OUT' AND HKLA_n > 0)::INT) OVER (PARTITION BY rig_id, seg ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS trips FROM sized"),
    ("peaks", "SELECT rig_id AS prig, seg AS pseg, trips + 1 AS ptrips, quantile_cont(HKLA_max, 0.75) OVER (PARTITION BY rig_id, seg ORDER BY tick ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS base FROM near WHERE state = 'TRIPPING_OUT' AND HKLA_n > 0"),
    ("lookup", "SELECT near.*, base, HKLA_max - base AS over FROM near LEFT JOIN peaks ON rig_id = prig AND seg = pseg AND trips = ptrips AND ptrips >= 10"),
    ("pull", "SELECT * FROM lookup WHERE in_trip AND off_bottom > 3 AND base >= 50 AND over >= 10"),
    *_runs_sql("pull", 1, "max(over) AS peak, arg_min({'d': bit_depth, 'h': HKLA_max, 'b': base}, {'o': -over, 't': tick}) AS worst"),
)


@query(with_feed("SELECT rig_id, t, in_trip FROM near", "sized", more=_PULL))
def episode_context(spark, sf_dir):
    return detect.episode(feed.sized(spark, sf_dir)).select("rig_id", "t", "in_trip")


@query(with_feed("SELECT rig_id, t, round(base, 8) AS base FROM lookup", "sized", more=_PULL))
def conditional_trailing_quantile(spark, sf_dir):
    return rounded(detect.trip_baseline(feed.sized(spark, sf_dir)).select("rig_id", "t", "base"))


@query(with_feed("SELECT rig_id, concat('op-', k) AS id, CASE WHEN peak >= 25 THEN 'ALARM' WHEN peak >= 15 THEN 'WARN' ELSE 'WATCH' END AS severity, t_from, t_to, minutes, round(worst.d, 4) AS depth_from, round(peak, 1) AS \"overpullKlb\", round(worst.h, 1) AS \"peakHookloadKlb\", round(worst.b, 1) AS \"normalPickupKlb\" FROM events_of", "sized", more=_PULL))
def overpull(spark, sf_dir):
    return _shown(detect.overpull(feed.sized(spark, sf_dir), step=STEP), "overpullKlb", "peakHookloadKlb", "normalPickupKlb")


_FLOW = (
    ("based", f"SELECT *, coalesce(MFOP_mean, 0e0) AS back, coalesce(MFIA_mean, 0e0) AS flow, {_trailing_sql(30, 'MFOP_mean', 'base_back')}, {_trailing_sql(30, 'MFIA_mean', 'base_flow')} FROM sized"),
    ("drifts", "SELECT *, (back - base_back) / base_back * 100 AS drift FROM based WHERE state IN ('DRILLING', 'SLIDING', 'CIRCULATING') AND flow >= 300 AND back > 0 AND base_back > 0 AND base_flow >= 300 AND abs(flow - base_flow) / base_flow * 100 <= 5"),
    ("drifted", "SELECT * FROM drifts WHERE abs(drift) >= 25"),
    *_runs_sql("drifted", 10, "arg_min({'d': drift, 'b': base_back}, {'o': -abs(drift), 't': tick}) AS worst, arg_min(hole_depth, tick) AS depth_from"),
)


@query(with_feed("SELECT rig_id, concat('fi-', k) AS id, CASE WHEN abs(worst.d) >= 50 THEN 'WARN' ELSE 'WATCH' END AS severity, t_from, t_to, minutes, round(depth_from, 4) AS depth_from, round(worst.d, 1) AS \"driftPct\", round(worst.b, 1) AS \"baselineMfop\" FROM events_of", "sized", more=_FLOW))
def flow_imbalance(spark, sf_dir):
    return _shown(detect.flow_imbalance(feed.sized(spark, sf_dir), step=STEP), "driftPct", "baselineMfop")


_ENVELOPE = (
    ("last_offsets", "SELECT hole_size, arg_max(section, idx) AS section, arg_max(max_spp, idx) AS SPP, arg_max(max_flow_rate, idx) AS MFIA, arg_max(max_torque, idx) AS TORQUE, arg_max(max_wob, idx) AS WOB FROM offsets GROUP BY hole_size"),
    ("above", " UNION ALL ".join(f"SELECT s.rig_id, s.tick, s.hole_depth, '{c}' AS channel, s.{c}_p90 AS value, o.{c} AS ceiling, o.section FROM sized s JOIN last_offsets o USING (hole_size) WHERE state IN ('DRILLING', 'SLIDING') AND o.{c} <> 0 AND s.{c}_p90 > o.{c}" for c in ("SPP", "MFIA", "TORQUE", "WOB"))),
    *_runs_sql("above", 5, "arg_min({'v': value, 'c': ceiling}, {'o': -value, 't': tick}) AS worst, arg_min(hole_depth, tick) AS depth_from", "channel"),
)


@query(with_feed("SELECT rig_id, concat('env-', lower(channel), '-', k) AS id, CASE WHEN (worst.v - worst.c) / worst.c * 100 >= 25 THEN 'WARN' ELSE 'WATCH' END AS severity, t_from, t_to, minutes, round(depth_from, 4) AS depth_from, round(worst.v, 1) AS \"peakValue\", round((worst.v - worst.c) / worst.c * 100, 1) AS \"overByPct\" FROM events_of", "offsets", more=_ENVELOPE))
def envelope_exceedance(spark, sf_dir):
    return _shown(detect.envelope_exceedance(feed.sized(spark, sf_dir), feed.offsets(spark), step=STEP), "peakValue", "overByPct")


def _prefixed(prefix: str, more: tuple) -> tuple:
    """The same expressions under names of their own, so that several detectors fit into one query."""
    import re

    names = [n for n, _ in more]
    return tuple((f"{prefix}_{n}", re.sub(rf"\b({'|'.join(names)})\b(?!\()", lambda m: f"{prefix}_{m[1]}", s)) for n, s in more)


_ALL = tuple(x for p, m in (("x1", _STICK), ("x2", _WASH), ("x3", _PULL), ("x4", _FLOW), ("x5", _ENVELOPE)) for x in _prefixed(p, m))
_UNION = " UNION ALL ".join(
    [
        "SELECT rig_id, concat('ss-', k) AS id, 'STICK_SLIP' AS type, CASE WHEN peak >= 1.21e0 THEN 'ALARM' WHEN peak >= 1.1e0 THEN 'WARN' ELSE 'WATCH' END AS severity, t_from, t_to, minutes FROM x1_events_of",
        "SELECT rig_id, concat('wo-', k), 'WASHOUT', CASE WHEN peak >= 20 THEN 'ALARM' WHEN peak >= 13 THEN 'WARN' ELSE 'WATCH' END, t_from, t_to, minutes FROM x2_events_of",
        "SELECT rig_id, concat('op-', k), 'OVERPULL', CASE WHEN peak >= 25 THEN 'ALARM' WHEN peak >= 15 THEN 'WARN' ELSE 'WATCH' END, t_from, t_to, minutes FROM x3_events_of",
        "SELECT rig_id, concat('fi-', k), 'FLOW_IMBALANCE', CASE WHEN abs(worst.d) >= 50 THEN 'WARN' ELSE 'WATCH' END, t_from, t_to, minutes FROM x4_events_of",
        "SELECT rig_id, concat('env-', lower(channel), '-', k), 'ENVELOPE_EXCEEDANCE', CASE WHEN (worst.v - worst.c) / worst.c * 100 >= 25 THEN 'WARN' ELSE 'WATCH' END, t_from, t_to, minutes FROM x5_events_of",
    ]
)


@query(with_feed(_UNION, "offsets", more=_ALL))
def detector_union(spark, sf_dir):
    return detect.detect_all(feed.sized(spark, sf_dir), feed.offsets(spark), step=STEP).select("rig_id", "id", "type", "severity", "t_from", "t_to", "minutes")


@query(with_feed(f"SELECT rig_id, id, type, severity FROM ({_UNION}) WHERE severity IN ('WARN', 'ALARM') AND t_to >= {_WINDOW[0]} AND t_from <= {_WINDOW[1]}", "offsets", more=_ALL))
def severity_filter(spark, sf_dir):
    events = detect.detect_all(feed.sized(spark, sf_dir), feed.offsets(spark), step=STEP)
    return filtered_events(events, None, "WARN", _FROM, _TO).select("rig_id", "id", "type", "severity")


@query(with_feed(f"SELECT type, count(*) AS events FROM ({_UNION}) GROUP BY type", "offsets", more=_ALL))
def anomaly_counts(spark, sf_dir):
    return detect.detect_all(feed.sized(spark, sf_dir), feed.offsets(spark), step=STEP).groupBy("type").agg(F.count("*").alias("events"))


_RANKED = "CASE severity WHEN 'ALARM' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END"


@query(with_feed(f"SELECT rig_id, id, type, severity, t_from FROM ({_UNION}) ORDER BY {_RANKED} DESC, t_from, rig_id, id LIMIT 25", "offsets", more=_ALL))
def events_by_severity(spark, sf_dir):
    events = detect.detect_all(feed.sized(spark, sf_dir), feed.offsets(spark), step=STEP)
    return ordered(events, "severity", True, ("t_from", "rig_id", "id")).select("rig_id", "id", "type", "severity", "t_from").limit(25)


@query(
    with_feed(
        f"SELECT rig_id, id, t_from, t_to FROM ({_UNION}) WHERE type = 'STICK_SLIP' AND severity = 'ALARM' AND t_from <= TIMESTAMP '{_ALARM}' AND t_to >= TIMESTAMP '{_ALARM}' QUALIFY row_number() OVER (PARTITION BY rig_id ORDER BY t_from, id) = 1",
        "offsets",
        more=_ALL,
    )
)
def alarm_lookup(spark, sf_dir):
    events = detect.detect_all(feed.sized(spark, sf_dir), feed.offsets(spark), step=STEP)
    return alarm_at(events, _ALARM).select("rig_id", "id", "t_from", "t_to")


# Evidence and headlines


def _detail(prefix: str, least: int, columns: str, keys: str = "") -> tuple[str, str]:
    """Events of a detector's runs with all that is told of them."""
    part = f"rig_id, {keys}" if keys else "rig_id"
    inner = f"SELECT {part}, min(tick) AS a, count(*) AS minutes, arg_min(hole_depth, tick) AS d1, {columns} FROM {prefix}_run_rows GROUP BY {part}, run HAVING count(*) >= {least}"
    return f"{prefix}_told", f"SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY a) AS k FROM ({inner})"


_TOLD = (
    _detail("x1", 3, "max(torque_nmad) AS peak, " + ", ".join(f"quantile_cont({x}, 0.5) AS {n}" for n, x in {"torque": "torque_median", "rpm": "RPM_mean", "cov": "RPM_sd / RPM_mean", "wob": "WOB_mean", "wob_sd": "WOB_sd", "valid": "torque_valid::DOUBLE", "zeros": "torque_zero_fill::DOUBLE"}.items())),
    _detail("x2", 5, "max(drop_pct) AS peak, arg_min(base_spp, tick) AS base, min(spp) AS lowest, arg_min(flow, tick) AS f1, arg_max(flow, tick) AS f2"),
    _detail("x3", 1, "max(over) AS peak, arg_min({'d': bit_depth, 'h': HKLA_max, 'b': base}, {'o': -over, 't': tick}) AS w"),
    _detail("x4", 10, "arg_min({'d': drift, 'h': hole_depth, 'v': back, 'b': base_back, 'f': flow}, {'o': -abs(drift), 't': tick}) AS w"),
    _detail("x5", 5, "arg_min({'v': value, 'c': ceiling, 's': section}, {'o': -value, 't': tick}) AS w", "channel"),
)
_IDS = {"x1": "concat('ss-', k)", "x2": "concat('wo-', k)", "x3": "concat('op-', k)", "x4": "concat('fi-', k)", "x5": "concat('env-', lower(channel), '-', k)"}
_OVER = "(w.v - w.c) / w.c * 100"
_KEYS = {
    "x1": {"torqueDispersionIndex": "round(peak, 2)", "thresholdCrossed": "CASE WHEN peak >= 1.21e0 THEN 1.21e0 WHEN peak >= 1.1e0 THEN 1.1e0 ELSE 0.95e0 END", "medianTorqueFtLb": "round(torque, 0)", "medianRpm": "round(rpm, 0)", "rpmSteadiness": "round(cov, 3)", "medianWobKlb": "round(wob, 1)", "wobSteadinessKlb": "round(wob_sd, 2)", "samplesUsedPerMin": "floor(valid + 0.5e0)", "zeroFillDropped": "floor(zeros + 0.5e0)"},
    "x2": {"sppDropPct": "round(peak, 1)", "baselineSppPsi": "round(base, 0)", "lowestSppPsi": "round(lowest, 0)", "flowInGpm": "round(f1, 0)", "flowChangePct": "round(abs(f2 - f1) / f1 * 100, 2)", "sustainedMinutes": "minutes::DOUBLE"},
    "x3": {"overpullKlb": "round(peak, 1)", "peakHookloadKlb": "round(w.h, 1)", "normalPickupKlb": "round(w.b, 1)", "bitDepthFt": "round(coalesce(w.d, 0e0), 0)", "sustainedMinutes": "minutes::DOUBLE"},
    "x4": {"driftPct": "round(w.d, 1)", "baselineMfop": "round(w.b, 1)", "observedMfop": "round(w.v, 1)", "flowInGpm": "round(w.f, 0)", "sustainedMinutes": "minutes::DOUBLE"},
    "x5": {"channel": "NULL", "peakValue": "round(w.v, 1)", "offsetCeiling": "w.c", "overByPct": f"round({_OVER}, 1)", "holeSection": "NULL", "sustainedMinutes": "minutes::DOUBLE"},
}
_EVIDENCE = " UNION ALL ".join(
    f"SELECT rig_id, {_IDS[x]} AS id, unnest([{', '.join(repr(k) for k in keys)}]) AS key, unnest([{', '.join(keys.values())}]::DOUBLE[]) AS value, unnest([{', '.join({'channel': 'channel', 'holeSection': 'w.s'}.get(k, 'NULL') for k in keys)}]::VARCHAR[]) AS text FROM {x}_told"
    for x, keys in _KEYS.items()
)


def _n(x: str, digits: int = 1) -> str:
    return f"printf('%.{digits}f', coalesce(round({x}, {digits}), 0e0))"


_LINES = {
    "x1": f"concat('Torque swings for ', minutes, ' min at ', {_n('d1', 0)}, ' ft: median ', {_n('torque', 0)}, ' ft-lb, WOB near ', {_n('wob')}, ' klb, RPM at ', {_n('rpm', 0)}, '.')",
    "x2": f"concat('Standpipe pressure down ', {_n('peak')}, '% for ', minutes, ' min at ', {_n('d1', 0)}, ' ft, flow in at ', {_n('f1', 0)}, ' gpm: possible washout.')",
    "x3": f"concat('Overpull of ', {_n('peak')}, ' klb while tripping out at ', {_n('w.d', 0)}, ' ft: hookload ', {_n('w.h')}, ' klb, normal ', {_n('w.b')}, ' klb.')",
    "x4": f"concat('Return flow ', CASE WHEN w.d < 0 THEN 'down ' ELSE 'up ' END, {_n('abs(w.d)')}, '% against its baseline for ', minutes, ' min at ', {_n('w.h', 0)}, ' ft, flow in steady: possible ', CASE WHEN w.d < 0 THEN 'losses.' ELSE 'gain.' END)",
    "x5": f"concat(channel, ' ran ', {_n(_OVER)}, '% above the reference well for ', minutes, ' min: ', {_n('w.v', 0)}, ' against ', {_n('w.c', 0)}, '.')",
}


@query(with_feed(_EVIDENCE, "offsets", more=(*_ALL, *_TOLD)))
def event_evidence(spark, sf_dir):
    """Every key of every event's evidence."""
    events = detect.detect_all(feed.sized(spark, sf_dir), feed.offsets(spark), step=STEP)
    rows = events.select("rig_id", "id", F.explode("evidence").alias("key", "said"))
    text = F.col("key").isin("channel", "holeSection")
    return rows.select("rig_id", "id", "key", F.when(~text, F.col("said").try_cast("double")).alias("value"), F.when(text, F.col("said")).alias("text"))


@query(with_feed(" UNION ALL ".join(f"SELECT rig_id, {_IDS[x]} AS id, {line} AS headline, {x != 'x3'} AS has_caveat FROM {x}_told" for x, line in _LINES.items()), "offsets", more=(*_ALL, *_TOLD)))
def event_headlines(spark, sf_dir):
    events = detect.detect_all(feed.sized(spark, sf_dir), feed.offsets(spark), step=STEP)
    return events.select("rig_id", "id", "headline", F.col("caveat").isNotNull().alias("has_caveat"))


# One long feed, by ranges


@query(with_feed(f"SELECT rig_id, t, seg, {r('d_hole', 'hole_advance', 'bit_travel')}, raw_state, voted, state FROM states", "states", kind=feed.LONG))
def long_feed_states(spark, sf_dir):
    return rounded(feed.long_states(spark, sf_dir).select("rig_id", "t", "seg", "d_hole", "hole_advance", "bit_travel", "raw_state", "voted", "state"))


@query(with_feed(f"SELECT rig_id, state, t_from, t_to, minutes, {r('depth_from', 'depth_to', 'footage', digits=4)} FROM spans", "sized", more=_SPANS, kind=feed.LONG))
def long_feed_spans(spark, sf_dir):
    return rounded(ranges.state_spans(feed.long_states(spark, sf_dir), STEP), 4)


@query(with_feed("SELECT rig_id, t, hole_size FROM sized", "sized", kind=feed.LONG))
def long_feed_hole_sizes(spark, sf_dir):
    return feed.long_sized(spark, sf_dir).select("rig_id", "t", "hole_size")


@query(with_feed("SELECT b.rig_id, b.t, round(b.base_spp, 8) AS base_spp, round(b.base_flow, 8) AS base_flow, in_trip, round(base, 8) AS base FROM x2_based b JOIN x3_lookup l ON b.rig_id = l.rig_id AND b.tick = l.tick", "sized", more=tuple(x for p, m in (("x2", _WASH), ("x3", _PULL)) for x in _prefixed(p, m)), kind=feed.LONG))
def long_feed_baselines(spark, sf_dir):
    found = ranges.bases(feed.long_sized(spark, sf_dir), size=feed.LONG_ROWS)
    return rounded(found.select("rig_id", "t", "base_spp", "base_flow", "in_trip", "base"))


@query(with_feed(_UNION, "offsets", more=_ALL, kind=feed.LONG))
def long_feed_detectors(spark, sf_dir):
    found = ranges.detect_all(feed.long_sized(spark, sf_dir), feed.offsets(spark), step=STEP, size=feed.LONG_ROWS, ticks=feed.LONG_TICKS)
    return found.select("rig_id", "id", "type", "severity", "t_from", "t_to", "minutes")


# Intervals and series

_COCKPIT = {"wob": ("WOB_mean", 1), "rpm": ("RPM_mean", 1), "spp": ("SPP_mean", 1), "hookload": ("HKLA_mean", 1), "flow": ("MFIA_mean", 1), "back": ("MFOP_mean", 1), "torque": ("coalesce(torque_median, TORQUE_mean)", 0), "rop": ("d_hole * 60", 1), "hole": ("hole_depth * 1.00012345678e0", 1), "bit": ("bit_depth * 1.00012345678e0", 1)}


@query(with_feed("SELECT rig_id, t, " + ", ".join(f"round(coalesce({x}, 0e0), {d}) AS {n}" for n, (x, d) in _COCKPIT.items()) + ", state, hole_size FROM sized", "sized"))
def cockpit_rows(spark, sf_dir):
    minutes = feed.sized(spark, sf_dir).withColumns({c: F.col(c) * 1.00012345678 for c in ("hole_depth", "bit_depth")})  # no rounding ties
    return Engine(minutes, feed.reports(spark, sf_dir), feed.offsets(spark), STEP).cockpit()


@query(
    with_feed(
        " UNION ALL ".join(
            f"SELECT '{name}' AS channel, rig_id, make_timestamp(slot * 1800000000) AS t, round(avg({mean}), 3) AS mean, count({mean}) AS n FROM slots GROUP BY rig_id, slot HAVING count({mean}) > 0"
            for name, mean in (("WOB", "WOB_mean"), ("torqueDispersion", "torque_nmad"))
        ),
        "minute",
        more=(("slots", f"SELECT *, CAST(floor(tick / 6) AS BIGINT) AS slot FROM minute WHERE t >= {_WINDOW[0]} AND t <= {_WINDOW[1]}"),),
    )
)
def timeseries_route(spark, sf_dir):
    """The route with its window and two channels, one of them virtual; breaks are left out."""
    engine = Engine(feed.minutes(spark, sf_dir), None, None, STEP)
    return engine.timeseries(["WOB", "torqueDispersion"], _FROM.isoformat(), _TO.isoformat(), 30).where("n > 0").select("channel", "rig_id", "t", "mean", "n")


@query("SELECT event_id, CAST(floor(value * 2 + 0.5e0) AS BIGINT) AS nearest, CAST(floor(-floor(value) / 2 + 0.5e0) AS BIGINT) AS halves FROM events")
def half_up_rounding(spark, sf_dir):
    return feed.events(spark, sf_dir).select("event_id", scalars.half_up(F.col("value") * 2).cast("long").alias("nearest"), scalars.half_up(-F.floor("value") / 2).cast("long").alias("halves"))


def _interval_sql(step: int, length: int) -> str:
    us = step * 60_000_000
    more = (
        ("slots", f"SELECT *, CAST(floor(tick / {length}) AS BIGINT) AS slot, state IN ('DRILLING', 'SLIDING') AS made FROM states"),
        ("line", "SELECT rig_id, unnest(generate_series(min(slot), max(slot))) AS slot FROM slots GROUP BY rig_id"),
        ("kpi", "SELECT rig_id, slot, count(*) AS measured, arg_min(hole_depth, tick) FILTER (hole_depth IS NOT NULL) AS d1, arg_max(hole_depth, tick) FILTER (hole_depth IS NOT NULL) AS d2, sum(d_hole) AS f, CAST(sum(made::INT) AS BIGINT) AS ob, avg(ROP_mean) AS rc, count(*) FILTER (state = 'DRILLING') AS drilling FROM slots GROUP BY rig_id, slot"),
    )
    select = f"""SELECT rig_id, make_timestamp(slot * {length * us}) AS t_from, coalesce(measured, 0) AS measured, greatest({length} - coalesce(measured, 0), 0) AS missing, round(d1, 4) AS depth_start, round(d2, 4) AS depth_end,
    round(coalesce(f, 0e0), 1) AS footage, coalesce(ob, 0) AS on_bottom, round(CASE WHEN ob > 0 THEN f / (ob * {step}) * 60 END, 1) AS rop_on_bottom, round(CASE WHEN measured > 0 THEN f / (measured * {step}) * 60 END, 1) AS rop_overall,
    round(rc, 2) AS rop_channel, CASE WHEN drilling > 0 THEN drilling END AS drilling FROM line LEFT JOIN kpi USING (rig_id, slot)"""
    return with_feed(select, "states", step, more)


def _intervals(spark, sf_dir, step: int, length: int) -> DataFrame:
    from ..operators.state import apply_states

    found = intervals.intervals(apply_states(feed.minutes(spark, sf_dir, step)), length, step)
    return rounded(found.drop("t_to").withColumn("drilling", F.col("state_minutes")["DRILLING"]).drop("state_minutes"), 4)


@query(_interval_sql(FINE, 1))
def interval_with_empty(spark, sf_dir):
    return _intervals(spark, sf_dir, FINE, 1)


@query(_interval_sql(STEP, 240 // STEP))
def interval_4h(spark, sf_dir):
    return _intervals(spark, sf_dir, STEP, 240 // STEP)


@query(_interval_sql(STEP, 1440 // STEP))
def interval_1d(spark, sf_dir):
    return _intervals(spark, sf_dir, STEP, 1440 // STEP)


@query(
    with_feed(
        f"""SELECT rig_id, make_timestamp(a * 300000000) AS t_from, make_timestamp((b + 1) * 300000000) AS t_to, round(m * {STEP} / 60e0, 2) AS measured_hours, round((b + 1 - a - m) * {STEP} / 60e0, 2) AS missing_hours, round(d1, 4) AS depth_start, round(d2, 4) AS depth_end, round(f, 1) AS footage,
    round(ob * {STEP} / 60e0, 2) AS on_bottom_hours, round(f / (ob * {STEP}) * 60, 1) AS rop_on_bottom, round(f / (m * {STEP}) * 60, 1) AS rop_overall, round(rc, 2) AS rop_channel,
    round((SELECT sum(npt_hrs) FROM reports r WHERE r.rig_id = one.rig_id AND "end" > make_timestamp(a * 300000000) AND start < make_timestamp((b + 1) * 300000000)), 2) AS npt_hours,
    round((SELECT sum(duration_hrs) FROM reports r WHERE r.rig_id = one.rig_id AND "end" > make_timestamp(a * 300000000) AND start < make_timestamp((b + 1) * 300000000)), 2) AS report_hours FROM one""",
        "sized",
        more=(("one", "SELECT rig_id, count(*) AS m, min(tick) AS a, max(tick) AS b, arg_min(hole_depth, tick) AS d1, arg_max(hole_depth, tick) AS d2, sum(d_hole) AS f, count(*) FILTER (state IN ('DRILLING', 'SLIDING')) AS ob, avg(ROP_mean) AS rc FROM sized GROUP BY rig_id"),),
    )
)
def summary(spark, sf_dir):
    return rounded(intervals.summary(feed.states(spark, sf_dir), feed.reports(spark, sf_dir), STEP), 4)


_RESAMPLE = (
    ("slots", "SELECT *, CAST(floor(tick / 6) AS BIGINT) AS slot FROM minute"),
    ("lags", "SELECT *, tick - lag(tick) OVER (PARTITION BY rig_id, slot ORDER BY tick) > 1 AS gap FROM slots"),
    ("points", "SELECT rig_id, slot, round(avg(WOB_mean), 3) AS mean, round(min(WOB_min), 3) AS min, round(max(WOB_max), 3) AS max, round(sqrt(avg(WOB_sd * WOB_sd)), 3) AS sd, count(WOB_mean) AS n, bool_or(gap) AS gap FROM lags GROUP BY rig_id, slot"),
)


@query(with_feed("SELECT rig_id, make_timestamp(slot * 360000000) AS t, mean, min, max, sd, n FROM points WHERE n > 0 UNION ALL SELECT rig_id, make_timestamp((slot + 1) * 360000000 - 1000), NULL, NULL, NULL, NULL, 0 FROM points WHERE gap", "minute", FINE, _RESAMPLE))
def resample_gap_nulls(spark, sf_dir):
    return intervals.resample(feed.minutes(spark, sf_dir, FINE), "WOB", 6, FINE)


_GREEDY = (
    ("anchors(rig_id, a)", "SELECT rig_id, min(tick) FROM minute GROUP BY rig_id UNION ALL SELECT x.rig_id, (SELECT min(tick) FROM minute m WHERE m.rig_id = x.rig_id AND m.tick >= x.a + 5) FROM anchors x WHERE a IS NOT NULL"),
    ("placed", "SELECT m.*, a FROM minute m ASOF JOIN (SELECT rig_id, a FROM anchors WHERE a IS NOT NULL) x ON m.rig_id = x.rig_id AND m.tick >= x.a"),
)


@query(with_feed("SELECT rig_id, make_timestamp(a * 60000000) AS t, round(avg(SPP_mean), 3) AS mean, round(min(SPP_min), 3) AS min, round(max(SPP_max), 3) AS max, round(sqrt(avg(SPP_sd * SPP_sd)), 3) AS sd, count(SPP_mean) AS n FROM placed GROUP BY rig_id, a", "minute", FINE, _GREEDY))
def greedy_series(spark, sf_dir):
    return intervals.greedy_series(feed.minutes(spark, sf_dir, FINE), *intervals.channel_parts("SPP"), 5, FINE)


_STRETCH = "1.00012345678e0"  # depths of the feed have four decimals: ties when they are rounded


def _named_sql() -> str:
    """The eleven series, each a row of SQL: name, mean, least, greatest, spread."""
    plain = lambda name, v: (name, v, v, v, f"CASE WHEN {v} IS NOT NULL THEN 0e0 END")
    named = [(c.lower(), *(f"{c}_{p}" for p in ("mean", "min", "max", "sd"))) for c in ("WOB", "RPM", "SPP", "HKLA", "MFIA", "MFOP")]
    named += [("torque", "CASE WHEN TORQUE_n > 0 THEN coalesce(torque_median, TORQUE_mean) END", "TORQUE_min", "TORQUE_max", "TORQUE_sd"), ("ropChannel", *(f"ROP_{p}" for p in ("mean", "min", "max", "sd")))]
    named += [("rop", *["coalesce(rop_calc, 0e0)"] * 3, "0e0"), plain("holeDepth", "hole_depth"), plain("bitDepth", "bit_depth")]
    one = "SELECT rig_id, '{0}' AS series, make_timestamp(a * 60000000) AS t, round(avg({1}), 3) AS mean, round(min({2}), 3) AS min, round(max({3}), 3) AS max, round(sqrt(avg(({4}) * ({4}))), 3) AS sd, count({1}) AS n FROM placed GROUP BY rig_id, a"
    return " UNION ALL ".join(one.format(*x) for x in named)


@query(with_feed(_named_sql(), "depths", FINE, tuple((n, x.replace("FROM minute", "FROM timed")) for n, x in (("timed", f"SELECT * REPLACE (hole_depth * {_STRETCH} AS hole_depth, bit_depth * {_STRETCH} AS bit_depth), d_hole * 60 AS rop_calc FROM depths"), *_GREEDY))))
def named_series(spark, sf_dir):
    minutes = feed.minutes(spark, sf_dir, FINE)
    return intervals.standard_series(minutes.withColumns({c: F.col(c) * float(_STRETCH) for c in ("hole_depth", "bit_depth")}), 5, FINE)


@query(with_feed("SELECT rig_id, make_timestamp(a * 60000000) AS t, round(avg(SPP_mean), 3) AS mean, count(SPP_mean) AS n FROM placed GROUP BY rig_id, a", "minute", FINE, _GREEDY, feed.LONG))
def long_feed_greedy(spark, sf_dir):
    """The long feed by minutes, some 5,000 of 7,200, in ranges of 100 ticks."""
    anchored = intervals.greedy_buckets(written(feed.long_minutes(spark, sf_dir, FINE), "minutes"), 5, feed.LONG_TICKS)
    return anchored.groupBy("rig_id", scalars.tick_start("anchor", FINE).alias("t")).agg(F.round(F.avg("SPP.mean"), 3).alias("mean"), F.count("SPP.mean").alias("n"))


@query(with_feed("SELECT rig_id, t, round(WOB_mean, 2) AS wob, round(rop_calc, 1) AS rop, round(hole_depth, 1) AS depth, state FROM states WHERE state IN ('DRILLING', 'SLIDING') AND WOB_n > 0", "states"))
def scatter_filter(spark, sf_dir):
    return intervals.scatter(feed.states(spark, sf_dir))


@query("SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events) WHERE i % greatest(1, CAST(ceil(n / 2500) AS BIGINT)) = 0")
def stride_sample(spark, sf_dir):
    return intervals.every_nth(feed.events(spark, sf_dir), ["ts", "event_id"], F.to_date("ts"), 2500).select("event_id", "value")


@query(
    with_feed(
        "SELECT s.rig_id, s.t, CASE WHEN ok THEN s.m END AS mean, s.n FROM (SELECT rig_id, t, round(RPM_mean, 3) AS m, RPM_n > 0 AS has, 1 AS n, strftime(t, '%Y-%m-%d') IN ('2024-01-02', '2024-01-04') AND state IN ('DRILLING') AS ok FROM states "
        f"WHERE t >= TIMESTAMP '2024-01-01 14:00' AND t <= {_WINDOW[1]}) s WHERE has",
        "states",
    )
)
def masked_series(spark, sf_dir):
    minutes = feed.states(spark, sf_dir)
    series = intervals.resample(minutes, "RPM", 1, STEP)
    found = intervals.masked(series, minutes, ["2024-01-02", "2024-01-04"], ["DRILLING"], datetime(2024, 1, 1, 14), _TO)
    return found.select("rig_id", "t", "mean", F.col("n").cast("int").alias("n"))


@query(with_feed("SELECT rig_id, hole_size, count(*) AS minutes FROM sized WHERE hole_size IS NOT NULL GROUP BY rig_id, hole_size QUALIFY row_number() OVER (PARTITION BY rig_id ORDER BY count(*) DESC, min(tick)) = 1", "sized"))
def dominant_hole_size(spark, sf_dir):
    return intervals.dominant(feed.sized(spark, sf_dir))


@query(with_feed("SELECT CAST(unnest(generate_series((SELECT min(t) FROM minute)::DATE, (SELECT max(t) FROM minute)::DATE, INTERVAL 1 DAY)) AS DATE) AS day", "minute"))
def day_spine(spark, sf_dir):
    return observed_days(feed.minutes(spark, sf_dir))


# Joins


@query(with_feed("SELECT rig_id, t, hole_size FROM sized", "sized"))
def asof_hole_size(spark, sf_dir):
    return feed.sized(spark, sf_dir).select("rig_id", "t", "hole_size")


@query(with_feed("SELECT rig_id, well, count(*) AS reports FROM reports JOIN (SELECT rig_id, min(t) AS f, max(t) AS u FROM minute GROUP BY rig_id) USING (rig_id) WHERE \"end\" > f AND start < u GROUP BY rig_id, well QUALIFY row_number() OVER (PARTITION BY rig_id ORDER BY count(*) DESC, min(struct_pack(s := start, i := idx))) = 1", "reports"))
def overlap_top1(spark, sf_dir):
    window = feed.minutes(spark, sf_dir).groupBy("rig_id").agg(F.min("t").alias("t_from"), F.max("t").alias("t_to"))
    return joins.busiest_overlap(window, feed.reports(spark, sf_dir))


_EXPECTS = ", ".join(f"('{a}', {list(s)})" for a, s in ACTIVITY_STATES.items())
_AGREE = (
    ("expects(activity, expected)", f"VALUES {_EXPECTS}"),
    ("pairs", 'SELECT rig_id, activity, state, list_contains(expected, state) AS ok FROM reports JOIN expects USING (activity) JOIN states USING (rig_id) WHERE t >= start AND t < "end"'),
    ("counts", "SELECT rig_id, activity, state, count(*) AS m, row_number() OVER (PARTITION BY rig_id, activity ORDER BY count(*) DESC, state) AS place FROM pairs GROUP BY rig_id, activity, state"),
    ("tops", "SELECT rig_id, activity, string_agg(concat(state, ':', m), ',' ORDER BY place) AS top FROM counts WHERE place <= 3 GROUP BY rig_id, activity"),
    ("agreed", "SELECT rig_id, activity, count(*) AS ddr_minutes, count(*) FILTER (ok) AS matched_minutes FROM pairs GROUP BY rig_id, activity"),
)


@query(with_feed("SELECT rig_id, activity, ddr_minutes, matched_minutes, round(1e2 * matched_minutes / ddr_minutes, 1) AS agreement, top FROM agreed JOIN tops USING (rig_id, activity)", "reports", more=_AGREE))
def range_join_agreement(spark, sf_dir):
    found = joins.agreement(feed.states(spark, sf_dir), feed.reports(spark, sf_dir), STEP)
    top = F.array_join(F.transform("top_detected", lambda x: F.concat(x["state"], F.lit(":"), x["minutes"].cast("string"))), ",")
    return found.withColumn("top", top).drop("top_detected")


@query(with_feed("SELECT round(1e2 * sum(matched_minutes) / sum(ddr_minutes), 1) AS overall, CAST(sum(ddr_minutes) AS BIGINT) AS scored_minutes FROM agreed", "reports", more=_AGREE))
def overall_agreement(spark, sf_dir):
    return joins.overall_agreement(joins.agreement(feed.states(spark, sf_dir), feed.reports(spark, sf_dir), STEP))


@query(with_feed("SELECT rig_id, activity, state, count(*) AS buckets FROM states JOIN (SELECT rig_id, activity, min(start) AS f, max(\"end\") AS u FROM reports GROUP BY ALL) USING (rig_id) WHERE t >= f AND t < u GROUP BY ALL", "reports"))
def campaign_states(spark, sf_dir):
    """Buckets by state from an activity's first report on a rig to its last: intervals as long as the feed."""
    spans = feed.reports(spark, sf_dir).groupBy("rig_id", "activity").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    found = joins.covered_buckets(feed.states(spark, sf_dir).select("rig_id", "tick", "state"), spans, STEP, ("activity",))
    return found.groupBy("rig_id", "activity", "state").agg(F.count("*").alias("buckets"))


@query(with_feed("SELECT rig_id, idx, state, CAST(sum(epoch(least(t_to, \"end\")) - epoch(greatest(t_from, start))) AS BIGINT) AS seconds FROM reports JOIN spans USING (rig_id) WHERE t_from < \"end\" AND start < t_to GROUP BY ALL", "sized", more=_SPANS))
def report_states(spark, sf_dir):
    """Seconds of each state under each report: spans and reports that overlap, whatever their length."""
    whole = lambda a, b: (scalars.epoch_seconds(a).cast("long").alias("first"), scalars.epoch_seconds(b).cast("long").alias("until"))
    spans = segments.state_spans(feed.states(spark, sf_dir), STEP).select("rig_id", "state", *whole("t_from", "t_to"))
    pairs = joins.overlapping(spans, feed.reports(spark, sf_dir).select("rig_id", "idx", *whole("start", "end")), ["rig_id"])
    shared = F.least("l.until", "r.until") - F.greatest("l.first", "r.first")
    return pairs.groupBy("rig_id", F.col("r.idx").alias("idx"), F.col("l.state").alias("state")).agg(F.sum(shared).alias("seconds"))


@query(
    """WITH p AS (SELECT event_id, user_id // 5 AS g, date_trunc('second', ts) AS t FROM events WHERE event_type = 'purchase'),
s AS (SELECT user_id // 5 AS g, date_trunc('second', ts) AS t, max(value) AS v FROM events WHERE event_type = 'signup' GROUP BY ALL),
d AS (SELECT event_id, v, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch(p.t) - epoch(s.t)), s.t) AS k FROM p JOIN s USING (g))
SELECT event_id, round(v, 8) AS v FROM d WHERE k = 1"""
)
def nearest_lookup(spark, sf_dir):
    events = feed.events(spark, sf_dir).select("event_id", "event_type", "value", F.expr("user_id div 5").alias("g"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("t"))
    facts = events.where("event_type = 'signup'").groupBy("g", "t").agg(F.max("value").alias("v"))
    return rounded(joins.nearest(events.where("event_type = 'purchase'").select("event_id", "g", "t"), facts, ["g"], "v").select("event_id", "v"))


_LIVE = (("live", "SELECT hole_size, count(*) AS minutes, greatest(0e0, max(rop_calc)) AS rop, greatest(0e0, max(MFIA_p90)) AS flow, greatest(0e0, max(HKLA_p90)) AS hookload, greatest(0e0, max(TORQUE_p90)) AS torque FROM sized WHERE state IN ('DRILLING', 'SLIDING') AND hole_size IS NOT NULL GROUP BY hole_size"),)


def _versus(live: str, limit: str) -> str:
    has = f"minutes IS NOT NULL AND {limit} <> 0"
    return f"CASE WHEN {has} THEN round({live}, 6) END AS {live}, CASE WHEN {has} THEN round(({live} - {limit}) / {limit} * 100, 1) END AS {live}_pct, CASE WHEN {has} THEN {live} > {limit} END AS {live}_over"


_PAIRS = (("rop", "max_rop"), ("flow", "max_flow_rate"), ("hookload", "max_pu_weight"), ("torque", "max_torque"))


def _envelope(spark, sf_dir, unmatched: bool) -> DataFrame:
    found = joins.envelope(feed.offsets(spark), feed.sized(spark, sf_dir), unmatched)
    parts = [c for n, _ in _PAIRS for c in (F.round(F.col(f"vs_{n}.actual"), 6).alias(n), F.col(f"vs_{n}.over_pct").alias(f"{n}_pct"), F.col(f"vs_{n}.exceeded").alias(f"{n}_over"))]
    return found.select("section", "hole_size", "minutes", *parts)


@query(with_feed(f"SELECT section, hole_size, coalesce(minutes, 0) AS minutes, {', '.join(_versus(*p) for p in _PAIRS)} FROM offsets LEFT JOIN live USING (hole_size)", "offsets", more=_LIVE))
def envelope_left(spark, sf_dir):
    return _envelope(spark, sf_dir, True)


@query(with_feed(f"SELECT section, hole_size, coalesce(minutes, 0) AS minutes, {', '.join(_versus(*p) for p in _PAIRS)} FROM offsets JOIN live USING (hole_size)", "offsets", more=_LIVE))
def envelope_matched(spark, sf_dir):
    return _envelope(spark, sf_dir, False)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_join(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.members(table(spark, sf_dir, "orders"), returned, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def anti_join(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.others(table(spark, sf_dir, "orders"), returned, "o_orderkey").select("o_orderkey", "o_totalprice")


# Scalars and reports

_SIZES = "CASE p_partkey % 5 WHEN 0 THEN concat(p_size, '-', p_partkey % 7 + 1, '/8\"') WHEN 1 THEN concat('Drill ', p_size, ' ', p_partkey % 7 + 1, '/8 section') WHEN 2 THEN concat(p_size, '.', p_partkey % 100, '0') WHEN 3 THEN 'none' ELSE concat(p_size, '') END"


@query(
    f"""WITH s AS (SELECT p_partkey, replace({_SIZES}, '"', '') AS x FROM part),
g AS (SELECT p_partkey, try_cast(nullif(regexp_extract(x, '(\\d+)\\s*[-\\s]\\s*(\\d+)\\s*/\\s*(\\d+)', 1), '') AS DOUBLE) AS a, try_cast(nullif(regexp_extract(x, '(\\d+)\\s*[-\\s]\\s*(\\d+)\\s*/\\s*(\\d+)', 2), '') AS DOUBLE) AS b,
  try_cast(nullif(regexp_extract(x, '(\\d+)\\s*[-\\s]\\s*(\\d+)\\s*/\\s*(\\d+)', 3), '') AS DOUBLE) AS c, try_cast(nullif(regexp_extract(x, '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS d FROM s)
SELECT p_partkey, regexp_replace(regexp_replace(CAST(CAST(round(coalesce(CASE WHEN c <> 0 THEN a + b / c END, d), 3) AS DECIMAL(12, 3)) AS VARCHAR), '0+$', ''), '\\.$', '') AS hole_size FROM g"""
)
def hole_size_normalise(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.hole_size(F.expr(_SIZES)).alias("hole_size"))


_CELLS = "CASE event_id % 8 WHEN 0 THEN '5.0E' WHEN 1 THEN ' 7 ' WHEN 2 THEN '' WHEN 3 THEN 'NaN' WHEN 4 THEN '5d' WHEN 5 THEN 'Infinity' ELSE concat('-', event_id, '.5') END"


@query(f"SELECT event_id, CASE WHEN regexp_full_match(trim({_CELLS}), '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?') THEN try_cast(trim({_CELLS}) AS DOUBLE) END AS number FROM events")
def number_parse(spark, sf_dir):
    return feed.events(spark, sf_dir).select("event_id", scalars.parse_number(F.expr(_CELLS)).alias("number"))


_STAMPS = "CASE event_id % 4 WHEN 0 THEN concat(event_id % 12 + 1, '/', event_id % 28 + 1, '/2024 ', event_id % 24, ':', lpad(cast(event_id % 60 as {s}), 2, '0')) WHEN 1 THEN concat(event_id % 12 + 1, '/', event_id % 28 + 1, '/2023') WHEN 2 THEN 'bad' ELSE '' END"


@query(f"SELECT event_id, coalesce(try_strptime(x, '%-m/%-d/%Y %-H:%M'), try_strptime(x, '%-m/%-d/%Y')) AS t FROM (SELECT event_id, {_STAMPS.format(s='VARCHAR')} AS x FROM events)")
def feed_time_parse(spark, sf_dir):
    return feed.events(spark, sf_dir).select("event_id", scalars.parse_feed_time(F.expr(_STAMPS.format(s="string"))).alias("t"))


@query("SELECT event_id, ts, hour(ts) >= 18 OR hour(ts) < 6 AS night, strftime(ts, '%Y-%m-%d %H:%M') AS stamp, strftime(ts, '%m/%d %H:%M') AS short_stamp FROM events")
def shift_and_stamps(spark, sf_dir):
    return feed.events(spark, sf_dir).select("event_id", "ts", scalars.night("ts").alias("night"), scalars.stamp("ts").alias("stamp"), scalars.short_stamp("ts").alias("short_stamp"))


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN concat(text[1:400], '...') ELSE text END AS short, concat_ws(' / ', nullif(trim(lang), ''), nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE source END), '')) AS phase FROM documents")
def truncate_and_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", scalars.truncated("text").alias("short"), scalars.phase_label("lang", F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("source"))).alias("phase"))


_LOG = {
    "idx": "o_orderkey",
    "start": "o_orderdate",
    "well": "concat('W', o_custkey % 4)",
    "activity": "o_orderstatus",
    "npt_hrs": "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 9 / 4e0 ELSE 0e0 END",
    "duration_hrs": "o_orderkey % 24 / 2e0",
}
_LOG_SQL = ", ".join(f"{x} AS {c}" for c, x in _LOG.items())


def _log(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*(f"{x} AS {c}" for c, x in _LOG.items()))


@query(f"SELECT idx, start, npt_hrs FROM (SELECT {_LOG_SQL} FROM orders) WHERE well = 'W1' AND activity = 'F' AND npt_hrs > 0 ORDER BY start, idx LIMIT 50 OFFSET 20")
def report_page_rows(spark, sf_dir):
    return report_page(_log(spark, sf_dir), "W1", "f", True, 50, 20)[0].select("idx", "start", "npt_hrs")


@query(f"SELECT count(*) AS total, round(coalesce(sum(npt_hrs), 0e0), 2) AS npt_hours, round(coalesce(sum(duration_hrs), 0e0), 2) AS hours FROM (SELECT {_LOG_SQL} FROM orders) WHERE well = 'W1' AND activity = 'F' AND npt_hrs > 0")
def report_page_totals(spark, sf_dir):
    return report_page(_log(spark, sf_dir), "W1", "f", True, 50, 20)[1]


@query(f"SELECT kind, value, min(idx) AS first FROM (SELECT unnest(['well', 'activity']) AS kind, unnest([well, activity]) AS value, idx FROM (SELECT {_LOG_SQL} FROM orders)) GROUP BY kind, value")
def report_dimensions(spark, sf_dir):
    return distinct_values(_log(spark, sf_dir), ("well", "activity"))


@query(f"SELECT idx, well, npt_hrs, start FROM (SELECT {_LOG_SQL} FROM orders) ORDER BY npt_hrs DESC, start, idx LIMIT 40")
def reports_by_chosen_key(spark, sf_dir):
    return ordered(_log(spark, sf_dir), "npt_hrs", True, ("start", "idx")).select("idx", "well", "npt_hrs", "start").limit(40)


# Retrieval

_DOCS = {
    "idx": "doc_id",
    "body": "text",
    "comment": "text",
    "well": "source",
    "activity": "lang",
    "npt_hrs": "CASE WHEN doc_id % 7 = 0 THEN 1.5e0 ELSE 0e0 END",
}
_CFG = Retrieval()
_STOP = ", ".join(f"'{w}'" for w in sorted(_CFG.stop))
_TOKENS = f"""tokens AS (SELECT doc_id AS idx, list_filter(list_transform(string_split_regex(regexp_replace(lower(text), '[^a-z0-9./''-]+', ' ', 'g'), '\\s+'), lambda w: regexp_replace(w, '^[.''-]+|[.''-]+$', '', 'g')),
  lambda w: length(w) BETWEEN 2 AND 24 AND NOT list_contains([{_STOP}], w)) AS terms FROM documents),
postings AS (SELECT idx, len(terms) AS len, term, count(*) AS tf FROM (SELECT idx, terms, unnest(terms) AS term FROM tokens) GROUP BY idx, terms, term)"""


def log_of_documents(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr(*(f"{x} AS {c}" for c, x in _DOCS.items()))
    start = F.timestamp_seconds(F.col("idx") * 3600 + 1704067200).cast("timestamp_ntz")
    empty = {c: F.lit("") for c in ("rig", "phase1", "phase2", "hole_size")}
    return docs.withColumns({"start": start, "end": start, "depth_ft": F.lit(None).cast("double"), **empty})


@query(f"WITH {_TOKENS} SELECT idx, term, tf, len FROM postings")
def bm25_postings(spark, sf_dir):
    return search.postings(search.dealt(log_of_documents(spark, sf_dir))).select("idx", "term", "tf", "len")


@query(f"WITH {_TOKENS} SELECT term, count(*) AS df FROM postings GROUP BY term")
def bm25_df(spark, sf_dir):
    return search.frequencies_of(log_of_documents(spark, sf_dir))


_ASK = "repair of thtion hean and ouea at the night unseenword"
#: The question"s terms and their synonyms, written out.
_TERMS = ["repair", "thtion", "hean", "ouea", "night", "unseenword", "midnight"]


def _bm25(where: str, boost: str, terms: list[str], limit: int) -> str:
    asked = ", ".join(f"('{t}')" for t in terms)
    return f"""WITH {_TOKENS},
total AS (SELECT count(*) AS n, avg(len(terms)) AS avg_len FROM tokens),
asked(term) AS (VALUES {asked}),
known AS (SELECT asked.term, count(idx) AS df FROM asked LEFT JOIN postings USING (term) GROUP BY asked.term),
used AS (SELECT term, df, greatest(0e0, ln(1 + (n - df + 0.5e0) / (df + 0.5e0))) AS idf, avg_len, count(*) OVER () AS asked FROM known, total
  WHERE df <= 0.35e0 * n OR (SELECT count(*) FROM known, total WHERE df <= 0.35e0 * n) = 0),
scored AS (SELECT idx, sum(idf * (tf * 1.8e0) / (tf + 0.8e0 * (1 - 0.85e0 + 0.85e0 * len / avg_len))) AS raw, count(*) AS m, min(asked) AS asked FROM postings JOIN used USING (term) GROUP BY idx)
SELECT idx, round(raw * sqrt(m / asked) * {boost}, 3) AS score, m AS matched FROM scored JOIN documents ON idx = doc_id WHERE raw > 0 AND {where} ORDER BY score DESC, idx LIMIT {limit}"""


_NIGHT = "((idx % 24) >= 18 OR (idx % 24) < 6)"


@query(_bm25(_NIGHT, "(CASE WHEN doc_id % 7 = 0 THEN 1.6e0 ELSE 1e0 END)", _TERMS, 25))
def bm25_topk(spark, sf_dir):
    return search.search(log_of_documents(spark, sf_dir), _ASK, limit=25).select("idx", "score", F.size("matched").cast("long").alias("matched"))


@query(_bm25("source = 'src1' AND lang = 'en'", "1e0", ["thtion", "hean", "ouea"], 8))
def bm25_filtered(spark, sf_dir):
    given = search.Filters(well="src1", activity="en")
    return search.search(log_of_documents(spark, sf_dir), "thtion hean ouea of them", given, 8).select("idx", "score", F.size("matched").cast("long").alias("matched"))


@query(_bm25(_NIGHT, "(CASE WHEN doc_id % 7 = 0 THEN 1.6e0 ELSE 1e0 END)", _TERMS, 25))
def bm25_indexed_topk(spark, sf_dir):
    docs = log_of_documents(spark, sf_dir)
    found = index.search(index.build(docs), docs, _ASK, limit=25)
    return found.select("idx", "score", F.size("matched").cast("long").alias("matched"))


@query(_bm25("source = 'src1' AND lang = 'en'", "1e0", ["thtion", "hean", "ouea"], 8))
def bm25_indexed_filtered(spark, sf_dir):
    docs = log_of_documents(spark, sf_dir)
    found = index.search(index.build(docs), docs, "thtion hean ouea of them", search.Filters(well="src1", activity="en"), 8)
    return found.select("idx", "score", F.size("matched").cast("long").alias("matched"))


_HITS = _bm25(_NIGHT, "(CASE WHEN doc_id % 7 = 0 THEN 1.6e0 ELSE 1e0 END)", _TERMS, 25).replace("count(*) AS m,", "count(*) AS m, list(term) AS ts,").replace("m AS matched FROM", "ts, text, source, lang, doc_id, make_timestamp((doc_id * 3600 + 1704067200) * 1000000) AS stamp, CASE WHEN doc_id % 7 = 0 THEN 1.5e0 ELSE 0e0 END AS npt FROM")


@query(
    f"""WITH hits AS ({_HITS}), clean AS (SELECT *, trim(regexp_replace(regexp_replace(text, '\\s*\\n\\s*', ' / ', 'g'), '\\s{{2,}}', ' ', 'g')) AS c FROM hits),
placed AS (SELECT *, list_min(list_transform(range(0, greatest(length(c) - 41, 0) + 1, 20), lambda s: {{'miss': -len(list_filter(ts, lambda t: contains(lower(c[s + 1 : s + 240]), t))), 'begin': s}})).begin AS p FROM clean)
SELECT idx, score, CASE WHEN length(c) <= 240 THEN c ELSE concat(CASE WHEN p > 0 THEN '...' ELSE '' END, trim(c[p + 1 : p + 240]), CASE WHEN p + 240 < length(c) THEN '...' ELSE '' END) END AS snippet FROM placed"""
)
def hit_snippets(spark, sf_dir):
    return search.search(log_of_documents(spark, sf_dir), _ASK, limit=25).select("idx", "score", "snippet")


@query(
    f"""WITH hits AS ({_HITS}), facts AS (SELECT count(*) AS n, array_to_string(list_sort(list(DISTINCT source)), ' and ') AS wells, array_to_string(list_sort(list(DISTINCT lang)), ', ') AS acts, min(stamp) AS a, max(stamp) AS b,
  count(*) FILTER (npt > 0) AS k, coalesce(sum(npt) FILTER (npt > 0), 0e0) AS hours, arg_min({{'h': npt, 's': stamp, 'a': lang}}, {{'s': -score, 't': stamp, 'i': idx}}) FILTER (npt > 0) AS top FROM hits)
SELECT concat('I found ', n, ' report lines on ', wells, ', from ', strftime(a, '%Y-%m-%d %H:%M'), ' to ', strftime(b, '%Y-%m-%d %H:%M'), ' (rig time), under ', acts, '.',
  CASE WHEN k > 0 THEN concat(' ', k, ' of those book non-productive time, ', printf('%.2f', hours), ' hours in all; the first booked ', printf('%.2f', top.h), ' on ', strftime(top.s, '%Y-%m-%d %H:%M'), ', under ', top.a, '.') ELSE '' END) AS answer FROM facts"""
)
def composed_answer(spark, sf_dir):
    return search.answer(search.search(log_of_documents(spark, sf_dir), _ASK, limit=25))


# Quality

_BAD = {"WOB": "CASE WHEN event_id % 311 = 7 THEN '5.0E' WHEN event_id % 501 = 9 THEN ' x1 ' ELSE '3' END", "DBTM": "CASE WHEN event_id % 401 = 3 THEN '5.0E' WHEN event_id % 701 = 11 THEN 'n/a' WHEN event_id % 801 = 20 THEN '--' ELSE '' END"}


@query(
    f"""SELECT list(cell ORDER BY met) AS examples FROM (SELECT cell, min([event_id, place]) AS met FROM (
  SELECT event_id, 0 AS place, concat('WOB="', trim({_BAD["WOB"]}), '"') AS cell FROM events WHERE {_BAD["WOB"]} <> '3' UNION ALL
  SELECT event_id, 1, concat('DBTM="', {_BAD["DBTM"]}, '"') FROM events WHERE {_BAD["DBTM"]} <> '') GROUP BY cell ORDER BY met LIMIT 4)"""
)
def bad_cell_examples(spark, sf_dir):
    cells = feed.events(spark, sf_dir).selectExpr("user_id AS rig_id", "event_id AS seq", *(f"{x} AS {c}" for c, x in _BAD.items()))
    return quality.bad_cells(cells.withColumns({f"num_{c}": scalars.parse_number(c) for c in _BAD}), tuple(_BAD))


@query(
    "SELECT event_id, try_cast(json_extract_string(made, '$.a.v') AS DOUBLE) AS v, json_extract_string(made, '$.a.k') AS k, CAST(json_array_length(made, '$.l') AS INT) AS n FROM (SELECT event_id, to_json({'a': {'k': event_type, 'v': floor(value)}, 'l': [user_id, event_id]}) AS made FROM events)"
)
def json_round_trip(spark, sf_dir):
    """A nested table written as JSON lines by the library, and read again."""
    made = table(spark, sf_dir, "events").selectExpr("event_id", "struct(event_type AS k, cast(floor(value) AS double) AS v) AS a", "array(user_id, event_id) AS l")
    path = new_path(spark, "json")
    write_table(made, path, as_json=True)
    back = read_json(spark, path, "event_id long, a struct<k: string, v: double>, l array<bigint>")
    return back.select("event_id", F.col("a.v").alias("v"), F.col("a.k").alias("k"), F.size("l").alias("n"))


_RAW = {"WOB": "CASE WHEN event_id % 311 = 0 THEN '5.0E' WHEN event_id % 31 = 0 THEN '-2' ELSE cast(cast(floor(value) as bigint) as {s}) END", "DBTM": "CASE WHEN event_id % 50 = 0 THEN '0' ELSE '100' END"}


@query(
    f"""SELECT count(*) AS rows, CAST(sum((WOB = '5.0E')::INT) AS BIGINT) AS non_numeric, ['WOB="5.0E"'] AS examples, CAST(sum((DBTM = '0')::INT) AS BIGINT) AS dbtm_zero, CAST(sum((WOB = '-2')::INT) AS BIGINT) AS wob_negative, CAST(sum(dup::INT) AS BIGINT) AS held
FROM (SELECT {", ".join(f"{x.format(s='VARCHAR')} AS {c}" for c, x in _RAW.items())}, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type, false) AS dup FROM events)"""
)
def quality_counters(spark, sf_dir):
    cells = feed.events(spark, sf_dir).selectExpr("user_id AS rig_id", "event_id AS seq", "event_type", *(f"{x.format(s='string')} AS {c}" for c, x in _RAW.items()))
    flagged = rollup.held_frames(cells, ["event_type"]).withColumns({f"num_{c}": scalars.parse_number(c) for c in _RAW})
    return quality.counters(flagged, tuple(_RAW))


@query(
    with_feed(
        """SELECT id, affected_rows, round(1e2 * affected_rows / total, 2) AS affected_pct FROM (
  SELECT unnest(['minute-precision', 'torque-zero-fill', 'rop-never-zero', 'dbtm-zero', 'non-numeric', 'held-frames', 'feed-gaps', 'wob-negative', 'torque-units', 'mfop-scale']) AS id,
    unnest([total, zf, total, z, x, h, 0, w, total, total]) AS affected_rows, total FROM (
  SELECT (SELECT count(*) FROM feed) AS total, (SELECT CAST(sum(torque_zero_fill) AS BIGINT) FROM minute) AS zf, (SELECT count(*) FROM feed WHERE seq % 61 = 5) AS z, (SELECT count(*) FROM feed WHERE seq % 83 = 7) AS x, (SELECT count(*) FROM feed WHERE dup) AS h, (SELECT count(*) FROM feed WHERE WOB < 0) AS w))""",
        "minute",
    )
)
def quality_report(spark, sf_dir):
    made = feed.samples(spark, sf_dir)
    # Some cells of the feed read 0 or aren't numbers.
    bad = {"DBTM": F.when(F.col("seq") % 61 == 5, "0"), "SPP": F.when(F.col("seq") % 83 == 7, "5.0E")}
    cells = made.withColumns({c: F.coalesce(bad.get(c, F.lit(None)), F.col(c).cast("string")) for c in CHANNELS})
    cells = cells.withColumns({f"num_{c}": scalars.parse_number(c) for c in CHANNELS})
    minutes = rollup.rollup(made, STEP)
    return quality.findings(quality.counters(cells), minutes, segments.feed_gaps(minutes, STEP)).select("id", "affected_rows", "affected_pct")

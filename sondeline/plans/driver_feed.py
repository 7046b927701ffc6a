"""A telemetry feed, reports and offsets made of the driver's `events` table, in DataFrame form and as SQL.

A rig is FLEET users, so rigs grow in number with the table, and event_id is the row order. The table's 30 days are
told in 20 hours, so that a rig has some three rows a minute. A cycle of 1,000 minutes drills, slides, trips out and trips in, each rig a quarter of a
cycle after the one before. All numbers are plain arithmetic of times, numbers and value, so both engines get the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHANNELS
from ..operators import joins, ranges, rollup, state
from ..sources.staging import written

STEP, FINE, FLEET = 5, 1, 50
#: Users of a rig, and the table's time over the feed's: the long feed is one rig that tells the 30 days in five.
FLEETS, LONG = (FLEET, 36), (1 << 40, 6)

Q = "(k % 2800)"  # place in the cycle
V = "(value * 0.9871357123457e0)"  # long decimals: no rounding ties
_DEPTH = f"(1000e0 + 71.82e0 * floor(k / 2800) + 0.0513e0 * least({Q}, 1400))"
_OFF = f"(CASE WHEN {Q} < 1400 THEN {V} * 0.00249713e0 WHEN {Q} < 2100 THEN ({Q} - 1400) * 0.8e0 + 4e0 ELSE (2800 - {Q}) * 0.8e0 + 4e0 END)"

_RIG = "concat('rig', lpad(cast(g as {s}), 4, '0'))"
#: Number of the rig, microseconds of the feed, and number of the part of a cycle, in Spark's and in the oracle's SQL.
CLOCK = {
    "spark": ("user_id div {fleet}", "(unix_micros(cast(ts as timestamp)) - 1704067200000000) div {pace}", "u div 21428571 + 700 * g", _RIG.format(s="string")),
    "sql": ("user_id // {fleet}", "(epoch_us(ts) - 1704067200000000) // {pace}", "u // 21428571 + 700 * g", _RIG.format(s="VARCHAR")),
}


def clock(dialect: str, kind: tuple[int, int] = FLEETS) -> list[str]:
    return [x.format(fleet=kind[0], pace=kind[1]) for x in CLOCK[dialect]]


START = 1704110400  # 2024-01-01 12:00

#: Channel expressions in the common part of both SQL dialects.
EXPRESSIONS = {
    "DBTM": f"CASE WHEN event_id % 97 = 0 THEN NULL ELSE {_DEPTH} - {_OFF} END",
    "DMEA": _DEPTH,
    "BPOS": f"{V} % 45e0",
    "ROP": f"2e0 + {V} % 3e0",
    "HKLA": f"100e0 + {V} % 20e0 + CASE WHEN event_id % 53 = 0 AND {Q} >= 1400 THEN 60e0 ELSE 0e0 END",
    "WOB": f"CASE WHEN event_id % 310 = 0 THEN -2e0 ELSE 10e0 + {V} % 4e0 END",
    "TORQUE": f"CASE WHEN event_id % 9 = 0 THEN 0e0 WHEN {Q} % 1400 < 500 THEN 400e0 + {V} * 2e0 ELSE 60e0 * pow(1.09e0, ({V} * 7.31e0) % 50e0) END",
    "RPM": f"CASE WHEN {Q} < 900 THEN 80e0 + {V} % 5e0 WHEN {Q} < 1400 THEN 5e0 ELSE {V} % 3e0 END",
    "SPP": f"CASE WHEN {Q} < 1400 THEN 1500e0 + {V} * 0.2e0 - CASE WHEN {Q} % 700 > 500 THEN 260e0 ELSE 0e0 END ELSE {V} % 90e0 END",
    "MFOP": f"20e0 + {V} % 3e0 + CASE WHEN {Q} % 1400 > 900 AND {Q} % 1400 < 1200 THEN 9e0 ELSE 0e0 END",
    "MFIA": f"CASE WHEN {Q} < 1400 THEN 520e0 + {V} % 10e0 ELSE {V} % 50e0 END",
}

REPORTS = {
    "idx": "event_id",
    "well": "concat('W', user_id % 3)",
    "rig": "concat('R', user_id % 2)",
    "activity": "CASE event_id % 6 WHEN 0 THEN 'TIH' WHEN 1 THEN 'TOH' WHEN 2 THEN 'DRLDD' WHEN 3 THEN 'CC' WHEN 4 THEN 'EQRPR' ELSE 'MISC' END",
    "hole_size": "CASE event_id % 4 WHEN 1 THEN '12.25' WHEN 2 THEN '8.5' WHEN 3 THEN '6.125' END",
    "duration_hrs": "floor(value / 40e0) / 4e0 + 0.25e0",
    "npt_hrs": "CASE WHEN event_id % 5 = 0 THEN floor(value / 20e0) / 4e0 ELSE 0e0 END",
}

#: idx, section, hole size and six ceilings; 8.5 comes twice, and one ceiling is 0.
OFFSETS = [
    (0, "Drill 12-1/4", "12.25", 36.0, 528.0, 12.0, 1540.0, 118.0, 900.0),
    (1, "Drill 8-1/2", "8.5", 40.0, 650.0, 11.0, 1500.0, 150.0, 700.0),
    (2, "Drill 8-1/2 again", "8.5", 45.0, 527.0, 11.5, 1530.0, 119.0, 1000.0),
    (3, "Drill 6-1/8", "6.125", 52.0, 528.5, 12.5, 1560.0, 0.0, 5000.0),
    (4, "Drill 17-1/2", "17.5", 10.0, 300.0, 5.0, 900.0, 90.0, 500.0),
]
CEILINGS = ("max_rop", "max_flow_rate", "max_wob", "max_spp", "max_pu_weight", "max_torque")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def clocked(spark: SparkSession, sf_dir: str, kind: tuple[int, int] = FLEETS) -> DataFrame:
    """events with g, u and k of CLOCK, rig_id, and the feed's time in place of ts."""
    rig, micros, part, name = clock("spark", kind)
    found = events(spark, sf_dir).selectExpr("*", f"{rig} AS g", f"{micros} AS u").selectExpr("*", f"{part} AS k", f"{name} AS rig_id")
    return found.withColumn("ts", F.timestamp_micros(F.col("u") + START * 1_000_000).cast("timestamp_ntz"))


def samples(spark: SparkSession, sf_dir: str, kind: tuple[int, int] = FLEETS) -> DataFrame:
    made = clocked(spark, sf_dir, kind).selectExpr("rig_id", "ts", "event_id AS seq", "event_type", *(f"{x} AS {c}" for c, x in EXPRESSIONS.items()))
    return rollup.held_frames(made, ["event_type"]).select("rig_id", "ts", "seq", "dup_of_prev", *CHANNELS)


def minutes(spark: SparkSession, sf_dir: str, step: int = STEP) -> DataFrame:
    return rollup.rollup(samples(spark, sf_dir), step)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.apply_states(minutes(spark, sf_dir))


def reports(spark: SparkSession, sf_dir: str, kind: tuple[int, int] = FLEETS) -> DataFrame:
    start = f"cast(timestamp_seconds({START} + u div {STEP * 60_000_000} * {STEP * 60}) as timestamp_ntz) AS start"
    found = clocked(spark, sf_dir, kind).where("event_type = 'error'").selectExpr("rig_id", start, *(f"{x} AS {c}" for c, x in REPORTS.items()))
    end = (F.col("start").cast("timestamp") + F.make_dt_interval(secs=F.col("duration_hrs") * 3600)).cast("timestamp_ntz")
    return found.withColumn("end", end)


def offsets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OFFSETS, "idx long, section string, hole_size string, " + ", ".join(f"{c} double" for c in CEILINGS))


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.hole_sizes(states(spark, sf_dir), reports(spark, sf_dir))


#: Rows of a block and ticks of a range of the long feed's queries, which have some 1,440 rows: so few that borders matter.
LONG_ROWS, LONG_TICKS = 128, 100


def long_minutes(spark: SparkSession, sf_dir: str, step: int = STEP) -> DataFrame:
    """Buckets of the long feed, written once."""
    return ranges.depth_changes(written(rollup.rollup(samples(spark, sf_dir, LONG), step, depths=False), "buckets"), LONG_TICKS)


def long_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.apply_states(long_minutes(spark, sf_dir), size=LONG_ROWS, ticks=LONG_TICKS)


def long_sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified buckets with hole sizes; a report's tick is that of the first bucket that begins with it or later."""
    facts = reports(spark, sf_dir, LONG).withColumn("tick", F.ceil(F.unix_seconds(F.col("start").cast("timestamp")) / (60 * STEP)).cast("long"))
    newest = facts.groupBy("rig_id", "tick").agg(F.max_by("hole_size", F.when(F.col("hole_size").isNotNull(), F.struct("start", "idx"))).alias("hole_size")).withColumn("idx", F.lit(0))
    return ranges.asof(long_states(spark, sf_dir), newest, "hole_size", LONG_TICKS)


def _stats(c: str) -> str:
    quantiles = ", ".join(f"quantile_cont({c}, {q}) AS {c}_{p}" for p, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)))
    return f"count({c}) AS {c}_n, avg({c}) AS {c}_mean, min({c}) AS {c}_min, max({c}) AS {c}_max, stddev_pop({c}) AS {c}_sd, {quantiles}"


def feed_sql(step: int = STEP, kind: tuple[int, int] = FLEETS) -> list[tuple[str, str]]:
    """Common table expressions from feed to sized, in order."""
    seconds = 60 * step
    rig, micros, part, name = clock("sql", kind)
    channel = ", ".join(f"{x} AS {c}" for c, x in EXPRESSIONS.items())
    values = ", ".join(f"({i}, '{s}', '{h}', {', '.join(f'{x}e0' for x in rest)})" for i, s, h, *rest in OFFSETS)
    return [
        ("clocked", f"SELECT *, {part} AS k, {name} AS rig_id, make_timestamp(u + {START}000000) AS feed_ts FROM (SELECT *, {rig} AS g, {micros} AS u FROM events)"),
        ("feed", f"SELECT rig_id, feed_ts AS ts, event_id AS seq, CAST(floor(epoch(feed_ts) / {seconds}) AS BIGINT) AS tick, coalesce(lag(event_type) OVER (PARTITION BY rig_id ORDER BY event_id) = event_type, false) AS dup, {channel} FROM clocked"),
        ("grouped", f"SELECT rig_id, tick, count(*) AS n, CAST(sum(dup::INT) AS BIGINT) AS dup_rows, {', '.join(_stats(c) for c in CHANNELS)}, list(TORQUE ORDER BY seq) AS raw FROM feed GROUP BY rig_id, tick"),
        ("positive", "SELECT *, coalesce(RPM_mean, 0) > 20 AS turning, CASE WHEN coalesce(RPM_mean, 0) > 20 THEN list_filter(raw, lambda x: x > 0) ELSE raw END AS pos FROM grouped"),
        ("kept", "SELECT *, list_filter(pos, lambda x, i: i = 1 OR x <> pos[i - 1]) AS kept FROM positive"),
        ("median", "SELECT *, list_aggregate(kept, 'median') AS med FROM kept"),
        (
            "minute",
            f"""SELECT * EXCLUDE (raw, pos, kept, med, turning), make_timestamp(tick * {seconds} * 1000000) AS t, DMEA_max AS hole_depth, DBTM_mean AS bit_depth, DMEA_max - DBTM_mean AS off_bottom,
    CAST(len(kept) AS BIGINT) AS torque_valid, CAST(CASE WHEN turning THEN len(raw) - len(pos) ELSE 0 END AS BIGINT) AS torque_zero_fill,
    CASE WHEN len(kept) >= 4 THEN med END AS torque_median,
    CASE WHEN turning AND len(kept) >= 4 AND med > 0 THEN list_aggregate(list_transform(kept, lambda x: abs(x - med)), 'median') * 1.4826e0 / med END AS torque_nmad,
    CASE WHEN len(kept) >= 4 AND med > 0 THEN (list_max(kept) - list_min(kept)) / med END AS torque_ptp FROM median""",
        ),
        ("known", "SELECT *, last_value(hole_depth IGNORE NULLS) OVER w AS hole_before, last_value(bit_depth IGNORE NULLS) OVER w AS bit_before FROM minute WINDOW w AS (PARTITION BY rig_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
        ("depths", "SELECT * EXCLUDE (hole_before, bit_before), coalesce(greatest(0e0, hole_depth - hole_before), 0e0) * CASE WHEN hole_depth IS NULL OR hole_before IS NULL THEN 0e0 ELSE 1e0 END AS d_hole, coalesce(bit_depth - bit_before, 0e0) AS d_bit FROM known"),
        ("starts", "SELECT *, d_hole * 60 AS rop_calc, coalesce(tick - lag(tick) OVER (PARTITION BY rig_id ORDER BY tick) <> 1, true) AS seg_start FROM depths"),
        ("segs", "SELECT *, CAST(sum(seg_start::INT) OVER (PARTITION BY rig_id ORDER BY tick) AS BIGINT) AS seg FROM starts"),
        (
            "contexts",
            """SELECT *, coalesce(sum(CASE WHEN seg_start THEN 0e0 ELSE d_hole END) OVER (PARTITION BY rig_id, seg ORDER BY tick ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING), 0e0) AS hole_advance,
    coalesce(last_value(bit_depth) OVER w - first_value(bit_depth) OVER w, 0e0) AS bit_travel FROM segs WINDOW w AS (PARTITION BY rig_id, seg ORDER BY tick ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)""",
        ),
        (
            "raws",
            """SELECT *, CASE
    WHEN hole_advance >= 1e0 AND off_bottom <= 3e0 THEN CASE WHEN coalesce(RPM_mean, 0) >= 20 THEN 'DRILLING' ELSE 'SLIDING' END
    WHEN hole_advance < 1e0 AND abs(bit_travel) >= 30e0 THEN CASE WHEN bit_travel > 0 THEN 'TRIPPING_IN' ELSE 'TRIPPING_OUT' END
    WHEN hole_advance < 1e0 AND off_bottom > 3e0 AND off_bottom < 120e0 AND coalesce(BPOS_max - BPOS_min, 0) >= 10e0 THEN 'CONNECTION'
    WHEN coalesce(MFIA_mean, 0) >= 200 AND coalesce(RPM_mean, 0) >= 20 THEN CASE WHEN abs(d_bit) > 0.5e0 THEN 'REAMING' ELSE 'CIRCULATING' END
    WHEN coalesce(MFIA_mean, 0) >= 200 THEN 'CIRCULATING' ELSE 'STATIC' END AS raw_state FROM contexts""",
        ),
        ("windows", "SELECT *, list(raw_state) OVER (PARTITION BY rig_id ORDER BY tick ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS win FROM raws"),
        (
            "votes",
            """SELECT * EXCLUDE (win), (list_sort(list_transform(list_distinct(win), lambda v: {'a': -len(list_filter(win, lambda x: x = v)), 'b': v <> raw_state, 'c': list_position(win, v), 'd': v}))[1]).d AS voted FROM windows""",
        ),
        ("changes", "SELECT *, sum(c) OVER (PARTITION BY rig_id ORDER BY tick) AS vrun FROM (SELECT *, coalesce(lag(voted) OVER (PARTITION BY rig_id ORDER BY tick) <> voted, true)::INT AS c FROM votes)"),
        ("lengths", "SELECT *, count(*) OVER (PARTITION BY rig_id, vrun) AS vlen FROM changes"),
        ("states", "SELECT * EXCLUDE (c, vrun, vlen), last_value(CASE WHEN vlen >= 3 OR vrun = 1 THEN voted END IGNORE NULLS) OVER (PARTITION BY rig_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM lengths"),
        ("reports", f"SELECT *, start + to_seconds(duration_hrs * 3600) AS \"end\" FROM (SELECT rig_id, make_timestamp(({START} + u // {STEP * 60_000_000} * {STEP * 60}) * 1000000) AS start, {', '.join(f'{x} AS {c}' for c, x in REPORTS.items())} FROM clocked WHERE event_type = 'error')"),
        ("facts", "SELECT rig_id, start, last(hole_size ORDER BY idx) AS hole_size FROM reports WHERE hole_size IS NOT NULL GROUP BY rig_id, start"),
        ("sized", "SELECT s.*, f.hole_size FROM states s ASOF LEFT JOIN facts f ON s.rig_id = f.rig_id AND s.t >= f.start"),
        (f"offsets(idx, section, hole_size, {', '.join(CEILINGS)})", f"VALUES {values}"),
    ]


def with_feed(select: str, last: str, step: int = STEP, more: tuple[tuple[str, str], ...] = (), kind: tuple[int, int] = FLEETS) -> str:
    """A query over the expressions up to `last`, and `more` of its own."""
    found = []
    for name, sql in feed_sql(step, kind):
        found.append((name, sql))
        if name.split("(")[0] == last:
            break
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({s})" for n, s in [*found, *more]) + "\n" + select

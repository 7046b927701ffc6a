"""Windowed operators against small sequential models, on random feeds with gaps, nulls and ties."""

import random
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from sondeline.config import CHANNELS, DetectorConfig, StateThresholds
from sondeline.operators import detect, intervals, joins, rollup, search, segments, state
from sondeline.plans.engine import Engine
from sondeline.sources.feeds import BadQuery

T0 = datetime(2024, 3, 1)


def feed(spark, rows):
    """rows: (minute, {channel: value}) in order."""
    data = [("r", T0 + timedelta(minutes=m), k, False, *(v.get(c) for c in CHANNELS)) for k, (m, v) in enumerate(rows)]
    return spark.createDataFrame(data, "rig_id string, ts timestamp_ntz, seq long, dup_of_prev boolean, " + ", ".join(f"{c} double" for c in CHANNELS))


def minute_rows(spark, rows, extra=""):
    """rows: dicts with tick and whatever columns a test needs."""
    columns = list(rows[0])
    kinds = {"tick": "long", "state": "string", "raw_state": "string", "seg_start": "boolean", "hole_size": "string", "t": "timestamp_ntz"}
    schema = "rig_id string, " + ", ".join(f"{c} {kinds.get(c, 'double')}" for c in columns)
    return spark.createDataFrame([("r", *(row[c] for c in columns)) for row in rows], schema)


def gappy_ticks(rng, n):
    out, at = [], 1000
    for _ in range(n):
        at += 1 if rng.random() > 0.08 else rng.randrange(2, 30)
        out.append(at)
    return out


def test_rollup_cleans_torque_and_tracks_depth(spark):
    rows = [(0, {"TORQUE": t, "RPM": 30.0, "DMEA": 100.0, "DBTM": 99.0}) for t in (0.0, 5.0, 5.0, -1.0, 7.0, 9.0, 9.0, 11.0)]
    rows += [(1, {"TORQUE": t, "RPM": 20.0}) for t in (0.0, 0.0, 4.0, 4.0)]
    rows += [(5, {"DMEA": 90.0, "DBTM": 80.0}), (6, {"DMEA": 97.0})]
    got = rollup.rollup(feed(spark, rows)).orderBy("tick").collect()
    first, second, third, last = got
    assert (first.n, first.torque_valid, first.torque_zero_fill, first.torque_median) == (8, 4, 2, 8.0)
    assert abs(first.torque_nmad - 1.4826 * 2 / 8) < 1e-12 and abs(first.torque_ptp - 6 / 8) < 1e-12
    assert (second.torque_valid, second.torque_zero_fill, second.torque_median, second.torque_nmad) == (2, 0, None, None)
    assert second.hole_depth is None and second.d_hole == 0 and second.DMEA is None
    assert (third.d_hole, third.d_bit, third.off_bottom) == (0.0, -19.0, 10.0)  # depth may go back; the clamp is against the value before
    assert (last.d_hole, last.rop_calc, last.bit_depth, last.d_bit) == (7.0, 420.0, None, 0.0)
    assert first.TORQUE.sd > 0 and third.DMEA.sd == 0.0 and first.RPM.p50 == 30.0


def test_held_frames(spark):
    d = spark.createDataFrame([("r", 1, "a", None), ("r", 2, "a", None), ("r", 3, "a", "x"), ("q", 4, "a", "x")], "rig_id string, seq long, c string, d string")
    assert {r.seq: r.dup_of_prev for r in rollup.held_frames(d, ["c", "d"]).collect()} == {1: False, 2: True, 3: False, 4: False}


def test_held_frames_over_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.choice("rq"), k * 3, rng.choice("ab")) for k in range(200)]
    d = spark.createDataFrame(rows, "rig_id string, seq long, c string")
    want, last = {}, {}
    for rig, seq, c in rows:
        want[seq], last[rig] = last.get(rig) == c, c
    for part in (1, 7, 1 << 17):
        assert {r.seq: r.dup_of_prev for r in rollup.held_frames(d, ["c"], part_rows=part).collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_contexts_match_a_sequential_model(spark, seed):
    rng = random.Random(seed)
    ticks = gappy_ticks(rng, 150)
    rows = [{"tick": t, "d_hole": rng.choice([0.0, 0.5, 1.5]), "bit_depth": None if rng.random() < 0.1 else rng.uniform(0, 99)} for t in ticks]
    got = {r.tick: (r.hole_advance, r.bit_travel) for r in state.contexts(minute_rows(spark, rows)).collect()}
    for i, row in enumerate(rows):

        def edge(step, reach):
            j = i
            while abs(j - i) < reach and 0 <= j + step < len(rows) and abs(ticks[j + step] - ticks[j]) == 1:
                j += step
            return j

        low, high = edge(-1, 3), edge(1, 3)
        advance = sum(rows[j]["d_hole"] for j in range(low + 1, high + 1))
        a, b = rows[edge(-1, 7)]["bit_depth"], rows[edge(1, 7)]["bit_depth"]
        travel = 0.0 if a is None or b is None else b - a
        assert abs(got[row["tick"]][0] - advance) < 1e-9 and abs(got[row["tick"]][1] - travel) < 1e-9


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_smoothing_matches_a_sequential_model(spark, seed):
    rng = random.Random(seed)
    raw = [rng.choice("ABC") for _ in range(30)]
    raw += [s for s in (rng.choice("ABC") for _ in range(30)) for _ in range(rng.randrange(1, 5))]
    got = [r.state for r in state.smooth(minute_rows(spark, [{"tick": k * 2, "raw_state": s} for k, s in enumerate(raw)])).orderBy("tick").collect()]
    voted = []
    for i, own in enumerate(raw):
        window = raw[max(0, i - 3) : i + 4]
        most = max(map(window.count, window))
        tied = [s for s in dict.fromkeys(window) if window.count(s) == most]
        voted.append(own if own in tied else tied[0])
    want, i = [], 0
    while i < len(voted):
        j = i
        while j < len(voted) and voted[j] == voted[i]:
            j += 1
        want += [want[-1] if j - i < 3 and want else voted[i]] * (j - i)
        i = j
    assert got == want


def test_classification_order(spark):
    th = StateThresholds()
    base = {"hole_advance": 0.0, "bit_travel": 0.0, "off_bottom": None, "d_bit": 0.0, "rpm": 0.0, "flow": 0.0, "low": 0.0, "high": 0.0}
    cases = [
        ({"hole_advance": 1.0, "off_bottom": 3.0, "rpm": 20.0}, "DRILLING"),
        ({"hole_advance": 1.0, "off_bottom": -5.0}, "SLIDING"),
        ({"hole_advance": 1.0, "off_bottom": 50.0, "bit_travel": 99.0}, "STATIC"),
        ({"bit_travel": 30.0, "flow": 300.0, "rpm": 50.0}, "TRIPPING_IN"),
        ({"bit_travel": -30.0}, "TRIPPING_OUT"),
        ({"off_bottom": 119.0, "high": 10.0, "flow": 500.0}, "CONNECTION"),
        ({"off_bottom": 120.0, "high": 10.0, "flow": 500.0}, "CIRCULATING"),
        ({"flow": 200.0, "rpm": 20.0, "d_bit": -0.6}, "REAMING"),
        ({"flow": 200.0, "rpm": 20.0, "d_bit": 0.5}, "CIRCULATING"),
        ({"flow": 199.0, "rpm": 90.0}, "STATIC"),
    ]
    rows = minute_rows(spark, [{"tick": k, **base, **c} for k, (c, _) in enumerate(cases)])
    rows = rows.withColumns({"RPM": F.struct(F.col("rpm").alias("mean")), "MFIA": F.struct(F.col("flow").alias("mean")), "BPOS": F.struct(F.col("low").alias("min"), F.col("high").alias("max"))})
    assert [r.raw_state for r in state.classify(rows, th).orderBy("tick").collect()] == [s for _, s in cases]


def test_gaps_runs_and_spans(spark):
    ticks = [1, 2, 3, 6, 7, 16, 41, 42]
    rows = [{"tick": t, "state": "A" if t < 7 else "B", "hole_depth": float(t), "d_hole": 1.0} for t in ticks]
    d = minute_rows(spark, rows)
    assert [(r.missing) for r in segments.feed_gaps(d).orderBy("t_from").collect()] == [2, 8, 24]
    spans = segments.state_spans(d).orderBy("t_from").collect()
    assert [(r.state, r.minutes, r.depth_from, r.depth_to, r.footage) for r in spans] == [("A", 3, 1.0, 3.0, 3.0), ("A", 1, 6.0, 6.0, 1.0), ("B", 1, 7.0, 7.0, 1.0), ("B", 1, 16.0, 16.0, 1.0), ("B", 2, 41.0, 42.0, 2.0)]
    runs = segments.long_runs(d, 2, []).orderBy("tick_from").collect()
    assert [(r.tick_from, r.tick_to, r.minutes, r.ordinal) for r in runs] == [(1, 3, 3, 1), (6, 7, 2, 2), (41, 42, 2, 3)]


def test_trailing_median_needs_a_whole_window(spark):
    values = [1.0, -5.0, 3.0, 4.0, 9.0, 2.0, 8.0]
    ticks = [1, 2, 3, 4, 5, 9, 10]
    got = detect.trailing_median(minute_rows(spark, [{"tick": t, "x": v} for t, v in zip(ticks, values, strict=True)]), F.col("x"), 3, "m").orderBy("tick").collect()
    assert [r.m for r in got] == [None, None, None, median([1.0, 3.0]), median([3.0, 4.0]), None, None]


@pytest.mark.parametrize("seed", [6, 7])
def test_trip_baseline_matches_a_sequential_model(spark, seed):
    rng, cfg = random.Random(seed), DetectorConfig()
    ticks = gappy_ticks(rng, 160)
    rows = [{"tick": t, "state": rng.choice(["TRIPPING_OUT", "TRIPPING_OUT", "STATIC"]), "peak": None if rng.random() < 0.1 else rng.uniform(50, 90)} for t in ticks]
    d = minute_rows(spark, rows).withColumn("HKLA", F.when(F.col("peak").isNotNull(), F.struct(F.col("peak").alias("max"))))
    got = {r.tick: r.base for r in detect.trip_baseline(d, cfg).collect()}
    for i, row in enumerate(rows):
        window, j = [], i - 1
        while j >= 0 and len(window) < 30 and ticks[j + 1] - ticks[j] == 1:
            if rows[j]["state"] == "TRIPPING_OUT" and rows[j]["peak"] is not None:
                window.append(rows[j]["peak"])
            j -= 1
        want = None
        if len(window) >= 10:
            window.sort()
            at = (len(window) - 1) * 0.75
            low = int(at)
            want = window[low] + (window[min(low + 1, len(window) - 1)] - window[low]) * (at - low)
        assert (got[row["tick"]] is None) == (want is None) and (want is None or abs(got[row["tick"]] - want) < 1e-9)


def test_greedy_buckets_and_intervals(spark):
    ticks = [0, 1, 4, 5, 6, 11, 12, 30]
    rows = [{"tick": t, "state": "DRILLING" if t < 6 else "STATIC", "hole_depth": None if t == 0 else float(t), "d_hole": 0.5, "rop": 1.0} for t in ticks]
    d = minute_rows(spark, rows).withColumn("ROP", F.struct(F.col("rop").alias("mean")))
    assert {r.tick: r.anchor for r in intervals.greedy_buckets(d, 5).collect()} == {0: 0, 1: 0, 4: 0, 5: 5, 6: 5, 11: 11, 12: 11, 30: 30}
    got = intervals.intervals(d, 10).orderBy("t_from").collect()
    assert [(r.measured, r.missing, r.footage, r.on_bottom) for r in got] == [(5, 5, 2.5, 4), (2, 8, 1.0, 0), (0, 10, 0.0, 0), (1, 9, 0.5, 0)]
    assert (got[0].depth_start, got[0].depth_end, got[0].state_minutes) == (1.0, 6.0, {"DRILLING": 4, "STATIC": 1})
    assert got[2].rop_overall is None and got[2].state_minutes == {} and got[0].rop_on_bottom == 37.5


def test_resampling_marks_inner_gaps(spark):
    d = minute_rows(spark, [{"tick": t, "v": float(t)} for t in (0, 1, 4, 5, 6, 20)])
    d = d.withColumn("RPM", F.struct(*(F.col("v").alias(a) for a in ("mean", "min", "max")), F.lit(2.0).alias("sd")))
    got = [(r.t.minute, r.t.microsecond, r.mean, r.sd, r.n) for r in intervals.resample(d, "RPM", 5).orderBy("t").collect()]
    assert got == [(0, 0, round(5 / 3, 3), 2.0, 3), (4, 999000, None, None, 0), (5, 0, 5.5, 2.0, 2), (20, 0, 20.0, 2.0, 1)]


def test_time_joins(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    reports = spark.createDataFrame([("r", 0, at(5), "8.5"), ("r", 1, at(5), "6.125"), ("r", 2, at(7), None), ("r", 3, at(9), "12.25")], "rig_id string, idx long, start timestamp_ntz, hole_size string")
    minutes = spark.createDataFrame([("r", k, at(k)) for k in range(3, 11)], "rig_id string, tick long, t timestamp_ntz")
    assert [r.hole_size for r in joins.hole_sizes(minutes, reports).orderBy("t").collect()] == [None, None, "6.125", "6.125", "6.125", "6.125", "12.25", "12.25"]
    facts = spark.createDataFrame([(1, at(2), "a"), (1, at(6), "b")], "g int, t timestamp_ntz, v string")
    points = spark.createDataFrame([(1, at(k)) for k in (0, 4, 5, 9)], "g int, t timestamp_ntz")
    assert [r.v for r in joins.nearest(points, facts, ["g"], "v").orderBy("t").collect()] == ["a", "a", "b", "b"]
    window = spark.createDataFrame([("r", at(10), at(20)), ("q", at(0), at(1))], "rig_id string, t_from timestamp_ntz, t_to timestamp_ntz")
    log = spark.createDataFrame([("W2", 1, at(0), at(10)), ("W1", 2, at(11), at(12)), ("W2", 3, at(13), at(14)), ("W3", 4, at(20), at(30))], "well string, idx long, start timestamp_ntz, end timestamp_ntz")
    log = log.withColumn("rig_id", F.lit("r"))
    assert {tuple(r) for r in joins.busiest_overlap(window, log).collect()} == {("r", "W1", 1), ("q", "UNKNOWN", 0)}
    assert {tuple(r) for r in joins.busiest_overlap(window, log.where("idx = 1")).collect()} == {("r", "UNKNOWN", 0), ("q", "UNKNOWN", 0)}


def test_agreement_counts_duplicate_cover(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    first = int((T0 - datetime(1970, 1, 1)).total_seconds()) // 60
    minutes = minute_rows(spark, [{"tick": first + k, "state": "STATIC" if k < 4 else "DRILLING"} for k in (0, 1, 2, 4, 5)])
    log = spark.createDataFrame([("r", "WOC", at(0), at(5)), ("r", "WOC", at(1), at(3)), ("r", "OTHER", at(0), at(9)), ("r", "TIH", at(100), at(109))], "rig_id string, activity string, start timestamp_ntz, end timestamp_ntz")
    rows = joins.agreement(minutes, log)
    assert [(r.activity, r.ddr_minutes, r.matched_minutes, r.agreement) for r in rows.collect()] == [("WOC", 6, 5, 83.3)]
    assert tuple(joins.overall_agreement(rows).first()) == (83.3, 6) and tuple(joins.overall_agreement(rows.limit(0)).first()) == (0.0, 0)


def test_search(spark):
    assert search.expanded("What about stuck pipe") == ["stuck", "pipe", "drag", "overpull", "tight", "backream", "packoff", "bridge"]
    assert search.shift_of("the NIGHT shift") == "night" and search.shift_of("on day shift") == "day" and search.shift_of("nightly") is None
    assert search.inferred("npt on sebl-2").well == "SEBL_002" and search.inferred("sebl_9").well is None
    assert search.inferred("rig phr 5", search.Filters(well="X")).rig == "PHR-05"
    rows = [(0, "tight spot", 0.0, 8), (1, "tight spot", 2.0, 9), (2, "pipe pipe pipe", 0.0, 10), (3, "calm", 0.0, 22), (4, "calm", 0.0, 23), (5, "calm", 0.0, 1)]
    docs = spark.createDataFrame([(i, T0 + timedelta(hours=h), c, c, n) for i, c, n, h in rows], "idx long, start timestamp_ntz, body string, comment string, npt_hrs double")
    docs = docs.withColumns({"end": F.col("start"), "depth_ft": F.lit(None).cast("double"), **{c: F.lit("w") for c in ("well", "rig", "activity", "phase1", "phase2", "hole_size")}})
    hits = search.search(docs, "tight spot trouble", limit=2).collect()
    assert [(h.idx, h.matched) for h in hits] == [(1, ["tight", "spot"]), (0, ["tight", "spot"])]
    assert abs(hits[0].score / hits[1].score - 1.6) < 0.01
    assert [h.idx for h in search.search(docs, "calm").collect()] == [5, 3, 4]  # every term is common, so all stay
    assert search.search(docs, "tight spot overnight").count() == 0 and search.search(docs, "calm tight").first().matched == ["tight"]
    assert search.answer(search.search(docs, "unheard")).first().answer.startswith("Nothing in the reports")
    assert "2 report lines" in search.answer(search.search(docs, "tight trouble")).first().answer


def test_engine_and_its_refusals(spark):
    rows = [(m, {"DMEA": 100 + m * 0.5, "DBTM": 100 + m * 0.5, "RPM": 60.0 + k, "MFIA": 500.0, "WOB": 5.0 + k, "SPP": 900.0, "TORQUE": 500.0 + k, "ROP": 3.0, "BPOS": 5.0, "HKLA": 99.0, "MFOP": 20.0}) for m in range(60) for k in range(4)]
    reports = spark.createDataFrame([("r", 0, "W", "R", "DRLROT", T0, T0 + timedelta(hours=1), 1.0, 0.5, "8.5", "c")], "rig_id string, idx long, well string, rig string, activity string, start timestamp_ntz, end timestamp_ntz, duration_hrs double, npt_hrs double, hole_size string, comment string")
    offsets = spark.createDataFrame([(0, "s", "8.5", 100.0, 400.0, 50.0, 2000.0, 200.0, 9000.0)], "idx long, section string, hole_size string, max_rop double, max_flow_rate double, max_wob double, max_spp double, max_pu_weight double, max_torque double")
    e = Engine.build(feed(spark, rows), reports, offsets)
    assert e.wells().first().well == "W" and e.wells().first().covered == 60
    assert [r.state for r in e.state()[1].collect()] == ["DRILLING"]
    assert e.state_at(str(int((T0 - datetime(1970, 1, 1)).total_seconds() * 1000 + 90_000))).first().span.state == "DRILLING"
    events = e.anomalies("ENVELOPE_EXCEEDANCE").collect()
    assert [(v.id, v.severity, v.minutes) for v in events] == [("env-mfia-1", "WARN", 60)]
    assert e.timeseries(["RPM", "ropCalc"], resolution=30).count() == 4 and e.aggregates("4h").first().measured == 60
    assert e.agreement().first().agreement == 100.0 and e.health().first().minutes == 60
    assert e.offset_envelope()[0].first().vs_flow.exceeded and {k for k in e.payload()} >= {"cockpit", "series", "gaps"}
    assert all(df.count() >= 0 for df in e.payload().values())
    for bad in (lambda: e.timeseries(["X"]), lambda: e.timeseries(["RPM"], resolution=241), lambda: e.aggregates("2h"), lambda: e.anomalies(min_severity="BAD"), lambda: e.ddr(limit=-1), lambda: e.ddr_query("")):
        with pytest.raises(BadQuery):
            bad()


def test_every_nth_row(spark):
    d = spark.range(0, 1000, 1, 7).withColumn("k", F.pmod(F.col("id") * 37, F.lit(1000)))
    assert sorted(r.k for r in intervals.every_nth(d, ["k"], F.floor(F.col("k") / 130), 300).collect()) == list(range(0, 1000, 4))


def test_torque_of_a_full_bucket_sorts_once(spark):
    """The deviation's median is worked out once a bucket, not once a reading: 20,000 readings take seconds."""
    made = spark.range(20_000).selectExpr("'a' AS rig_id", "timestamp_ntz'2024-01-01 00:00:01' AS ts", "id AS seq", "false AS dup_of_prev", *(f"{'100 + (id * 7919) % 20011' if c == 'TORQUE' else '50'} * 1e0 AS {c}" for c in CHANNELS))
    minutes = rollup.rollup(made)
    plan = minutes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") + plan.count("array_sort") <= 8  # they were 136
    values = sorted(100.0 + (k * 7919) % 20011 for k in range(20_000))
    middle = median(values)
    row = minutes.select("torque_median", "torque_nmad").first()
    assert row[0] == middle and abs(row[1] - median(abs(x - middle) for x in values) * 1.4826 / middle) < 1e-12

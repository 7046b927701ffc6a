"""Windows and greedy buckets by ranges against those over whole rigs, on random feeds with gaps, and their plans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sondeline.config import CHANNELS
from sondeline.operators import detect, intervals, joins, ranges, rollup, segments, state
from sondeline.plans import driver_feed
from sondeline.sources.staging import written


def feed(spark, seed, rows=420, gaps=0.04):
    """Buckets of three rigs with gaps, states of some length and missing depths."""
    rng = random.Random(seed)
    out = []
    for rig in ("a", "b", None if seed == 99 else "c"):
        tick, depth, off, mode = rng.randrange(50), 1000.0, 0.0, 0
        for _ in range(rows if rig != "c" else 7):
            tick += 1 if rng.random() >= gaps else rng.randrange(1, 40)
            mode = rng.randrange(5) if rng.random() < 0.08 else mode
            depth += rng.random() * 2 if mode == 0 else 0
            off = max(0.0, off + {0: -9, 1: 9, 2: -6, 3: 0, 4: 0.3}[mode] * rng.random())
            bit = None if rng.random() < 0.05 else depth - off
            level = 1500 + rng.random() * 60 - (300 if rng.random() < 0.2 else 0)
            values = {"RPM": 80 if mode == 0 else rng.choice([0, 25, 60]), "MFIA": 500 + rng.random() * 8 if mode in (0, 3) else 0, "SPP": level, "MFOP": rng.choice([20, 21, 33]), "HKLA": 100 + rng.random() * 60, "WOB": 10, "TORQUE": 500, "BPOS": 5}
            values = {c: float(x) for c, x in values.items()}
            out.append((rig, tick, None if rng.random() < 0.03 else depth, bit, values, rng.random() * 1.4))
    d = spark.createDataFrame(out, "rig_id string, tick long, hole_depth double, bit_depth double, v map<string,double>, torque_nmad double")
    stats = {c: F.when(F.col("v")[c].isNotNull(), F.struct(F.lit(9).cast("long").alias("n"), F.col("v")[c].alias("mean"), (F.col("v")[c] - 6).alias("min"), (F.col("v")[c] + 6).alias("max"), F.lit(1.0).alias("sd"), *(F.col("v")[c].alias(p) for p in ("p10", "p50", "p90")))) for c in CHANNELS}
    more = {"t": F.timestamp_seconds(F.col("tick") * 60).cast("timestamp_ntz"), "off_bottom": F.col("hole_depth") - F.col("bit_depth"), "torque_median": F.lit(500.0), "torque_valid": F.lit(12).cast("long"), "torque_zero_fill": F.lit(0).cast("long")}
    return written(d.withColumns(stats).drop("v").withColumns(more), "feed")


def same(a, b):
    show = lambda d: sorted(str([round(x, 7) if isinstance(x, float) else x for x in r]) for r in d.collect())
    return show(a) == show(b.select(*a.columns))


@pytest.mark.parametrize("seed,size,ticks", [(1, 41, 30), (2, 8, 7), (3, 5000, 5000)])
def test_ranges_equal_whole_rigs(spark, seed, size, ticks):
    base = feed(spark, seed)
    minutes = written(rollup.depth_changes(base), "m")
    assert same(minutes.select("rig_id", "tick", "d_hole", "d_bit", "rop_calc"), ranges.depth_changes(base, ticks))
    whole = written(state.apply_states(minutes), "w")
    parts = written(ranges.apply_states(minutes, size=size, ticks=ticks), "p")
    assert same(whole.select("rig_id", "tick", "seg", "hole_advance", "bit_travel", "raw_state", "voted", "state"), parts)
    assert same(segments.state_spans(whole), ranges.state_spans(parts))
    facts = spark.createDataFrame([("a", 30, 1, "12.25"), ("a", 30, 2, "8.5"), ("a", 200, 3, None), ("b", 99, 4, "6.125"), ("b", 4, 5, "17.5")], "rig_id string, tick long, idx long, hole_size string")
    sized = ranges.asof(parts, facts, "hole_size", ticks)
    assert same(joins.last_known(whole.select("rig_id", "tick"), facts.withColumnRenamed("tick", "start"), "hole_size", ["rig_id"], at="tick"), sized)
    offsets = driver_feed.offsets(spark)
    want = written(detect.detect_all(joins.last_known(whole, facts.withColumnRenamed("tick", "start"), "hole_size", ["rig_id"], at="tick"), offsets), "e")
    assert want.count() > 0
    assert same(want, ranges.detect_all(sized, offsets, size=size, ticks=ticks))


@pytest.mark.parametrize("length,ticks", [(5, 16), (7, 3), (1, 10), (30, 64), (5, 2048)])
def test_greedy_buckets_equal_a_walk(spark, length, ticks):
    rng = random.Random(length)
    rows = [(rig, t) for rig, n in (("a", 900), ("b", 40), ("c", 1)) for t in sorted(rng.sample(range(-50, 3 * n + 9), n))]
    got = {(r.rig_id, r.tick): r.anchor for r in intervals.greedy_buckets(spark.createDataFrame(rows, "rig_id string, tick long"), length, ticks).collect()}
    want, at = {}, {}
    for rig, t in rows:
        if rig not in at or t >= at[rig] + length:
            at[rig] = t
        want[rig, t] = at[rig]
    assert got == want


def test_no_plan_sorts_a_rig(spark):
    """Every window over rows is parted by blocks or ranges too; windows by rig alone see one row a block."""
    base = feed(spark, 4)
    parts = ranges.apply_states(rollup.depth_changes(base), size=50, ticks=50)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    for d in (ranges.depth_changes(base, 50), parts, ranges.state_spans(parts), ranges.bases(parts.withColumn("hole_size", F.lit("8.5")), size=50)):
        windows = re.findall(r"Window \[.*\], \[(.*?)\], \[(.*?)\]", plan(d))
        assert windows
        for keys, order in windows:
            assert "block" in keys or "_range" in keys or "block" in order or "_range" in order, (keys, order)
    assert "Pandas" not in plan(intervals.greedy_buckets(base, 5))

"""Events of a stream of buckets, cut and shuffled in any way, against those of the whole feed."""

import random

import pytest
from pyspark.sql import functions as F

from sondeline.config import DetectorConfig
from sondeline.operators import detect, state
from sondeline.plans import driver_feed
from sondeline.sources.staging import written
from sondeline.streaming import detect as m
from test_ranges import feed

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture()
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(STORE)


@pytest.fixture(scope="module")
def whole(spark):
    from sondeline.operators import rollup

    minutes = state.apply_states(rollup.depth_changes(feed(spark, 5, 260, 0.008)))
    # pressure and return flow of their own, so that all detectors have events
    low, odd = (F.col("tick") % 60).between(40, 47), (F.col("tick") % 90).between(60, 74)
    minutes = minutes.withColumns({"torque_nmad": F.when(F.col("tick") % 20 < 9, 1.15).otherwise(0.5), "SPP": F.col("SPP").withField("mean", F.when(low, 1200.0).otherwise(1500.0) + F.col("tick") % 3).withField("p90", F.when(F.col("tick") % 50 < 30, 1600.0).otherwise(1500.0)), "MFOP": F.col("MFOP").withField("mean", F.when(odd, 33.0).otherwise(20.0)), "MFIA": F.col("MFIA").withField("mean", 500.0 + F.col("tick") % 2)})
    minutes = minutes.withColumns({"state": F.when(low | odd, "CIRCULATING").when((F.col("tick") % 60).between(5, 25), "DRILLING").otherwise(F.col("state")), "hole_size": F.when(F.col("tick") > 60, "12.25")})
    return written(minutes.select(*detect.BUCKET, "t"), "whole")


def shown(events):
    return sorted(str(r.asDict(True)) for r in events.select("id", "rig_id", "type", "severity", "t_from", "t_to", "minutes", "depth_from", "depth_to", "headline", F.to_json("evidence").alias("e")).collect())


def test_cuts_do_not_show():
    """Runs that leave one feed's state are the same for any cut, any order within the lateness, and any number of stops between batches."""
    rng = random.Random(7)
    cfg, rows, tick = DetectorConfig(), [], 0
    for _ in range(900):
        tick += 1 if rng.random() < 0.99 else rng.randrange(2, 30)
        b = dict.fromkeys(m.FIELDS) | {"tick": tick, "state": rng.choice(["TRIPPING_OUT", "DRILLING"]) if tick % 200 > 120 else "CIRCULATING", "section": "s"}
        b |= {"off_bottom": rng.choice([2.0, 9.0]), "torque_nmad": 1.15 if tick % 20 < 9 else 0.2, "torque_median": 500.0, "torque_valid": 12.0, "torque_zero_fill": 0.0, "rpm": 80.0, "rpm_sd": 1.0, "wob_sd": 1.0}
        b |= {"spp": (1200.0 if tick % 60 > 50 else 1500.0) + rng.random(), "flow": 500.0 + rng.random(), "back": (33.0 if tick % 90 > 70 else 20.0) + rng.random(), "hookload": rng.choice([None, 100 + 60 * rng.random()])}
        b |= {"p90_SPP": rng.choice([1600.0, None]) if tick % 70 > 60 else 1600.0, "ceiling_SPP": 1540.0, "p90_WOB": 13.0, "ceiling_WOB": 0.0}
        rows.append(b)

    def runs(batches):
        said, out = None, []
        for final, batch in batches:
            f = m.Feed(cfg, said)
            f.waiting += batch
            out += f.advance(final, final is None) if final is not None else f.advance(0, True)
            said = f.said()
        return sorted(map(str, out))

    want = runs([(None, rows)])
    assert len({x[2:4] for x in want}) >= 5
    for _ in range(20):
        order = sorted(rows, key=lambda b: b["tick"] + rng.uniform(0, 25))
        cuts = [0, *sorted(rng.sample(range(1, 900), rng.randrange(1, 40))), 900]
        batches = []
        for a, z in zip(cuts, cuts[1:]):
            batches.append((max((b["tick"] for b in order[:a]), default=0) - 25, order[a:z]))
        assert runs([*batches, (None, [])]) == want


def test_stream_equals_batch(rocks, whole, tmp_path):
    spark, rng, batches, restart = rocks, random.Random(2), 4, True
    offsets = driver_feed.offsets(spark)
    want = written(detect.detect_all(whole, offsets), "want")
    assert {r.type for r in want.select("type").collect()} == set(detect.CAVEATS)
    rows = whole.orderBy("tick").collect()
    # Rows come up to 25 minutes late; the watermark waits for 30.
    order = sorted(rows, key=lambda r: r.tick + rng.uniform(0, 25))
    cuts = sorted(rng.sample(range(1, len(order)), batches - 1))
    parts = [order[a:b] for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True)]
    far = rows[0].asDict() | {"rig_id": "far", "tick": rows[-1].tick + 100_000}
    parts += [[far], [far | {"tick": far["tick"] + 1}]]
    late = rows[5].asDict() | {"tick": rows[5].tick}
    parts.append([late])  # long after the watermark: dropped

    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    start = lambda: m.write_events(m.flagged(stream, offsets), f"{tmp_path}/out", f"{tmp_path}/check").start()
    q = start()
    for k, part in enumerate(parts):
        spark.createDataFrame(part, whole.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q.processAllAvailable()
        if restart and k == batches // 2:
            q.stop()
            q = start()
    q.stop()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert shown(got) == shown(want)
    assert got.select("key").distinct().count() == got.count()

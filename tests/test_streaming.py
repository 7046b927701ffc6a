from datetime import datetime, timedelta

from sondeline.config import CHANNELS
from sondeline.streaming import rollup as m

T0 = datetime(2024, 3, 1)


def source(spark, tmp_path, rows):
    schema = "rig_id string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in CHANNELS)
    data = [(rig, T0 + timedelta(seconds=s), *(v if c == "DMEA" else 1.0 for c in CHANNELS)) for rig, s, v in rows]
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).parquet(f"{tmp_path}/in")


def test_minutes_become_final_behind_the_watermark(spark, tmp_path):
    stream = source(spark, tmp_path, [("r", 1, 10.0), ("r", 30, 12.0), ("r", 70, 13.0), ("r", 3600, 14.0)])
    q = m.write_minutes(m.minute_rollup(stream), f"{tmp_path}/out", f"{tmp_path}/check").start()
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("t").collect()
    assert [(r.t.minute, r.n, r.DMEA.max) for r in got] == [(0, 2, 12.0), (1, 1, 13.0)]


def test_depth_is_kept_between_batches(spark, tmp_path):
    q = m.last_known_depth(source(spark, tmp_path, [("r", 1, 10.0), ("r", 2, 12.0), ("r", 3, 11.0)])).writeStream.format("memory").queryName("depths").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    source(spark, tmp_path, [("r", 9, 15.0)])
    q.processAllAvailable()
    q.stop()
    assert [(r.depth, r.gained) for r in spark.table("depths").orderBy("ts").collect()] == [(10.0, 0.0), (12.0, 2.0), (11.0, 0.0), (15.0, 4.0)]


def test_sessions(spark, tmp_path):
    stream = source(spark, tmp_path, [("r", 0, 1.0), ("r", 60, 1.0), ("r", 400, 1.0), ("r", 9000, 1.0)])
    q = m.feed_sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert [r.n for r in spark.table("sessions").orderBy("t_from").collect()] == [2, 1]

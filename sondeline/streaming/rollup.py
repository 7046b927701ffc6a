"""Structured Streaming forms: per-minute rollup with a watermark, idempotent sink, and state kept over micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHANNELS
from ..operators.rollup import stats


def minute_rollup(samples: DataFrame, late: str = "10 minutes", width: str = "1 minute", channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Statistics of each rig and minute; a minute is final once the watermark has passed it, later samples are dropped."""
    stamped = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = stamped.groupBy("rig_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), *(stats(c).alias(c) for c in channels))
    return grouped.withColumn("t", F.col("w.start").cast("timestamp_ntz")).drop("w")


def write_minutes(minutes: DataFrame, path: str, checkpoint: str, partition: str = "day"):
    """Append final minutes to a day-partitioned Parquet table; a batch that is run again replaces its own files."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn(partition, F.to_date("t")).write.mode("overwrite").partitionBy(partition).parquet(f"{path}/batch={number:012d}")

    return minutes.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put)


def last_known_depth(samples: DataFrame, column: str = "DMEA", expiry: str = "NoTimeout") -> DataFrame:
    """(rig_id, ts, depth, gained): each reading against the rig's last known one, which is kept between batches.

    Within a batch readings are taken in order of ts; gained is never negative, and 0 for a rig's first reading.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        depth = rows["depth"]
        before = depth.shift().fillna(last) if last is not None else depth.shift().fillna(depth)
        state.update((float(depth.iloc[-1]),))
        yield pd.DataFrame({"rig_id": key[0], "ts": rows["ts"], "depth": depth, "gained": (depth - before).clip(lower=0)})

    readings = samples.where(F.col(column).isNotNull()).select("rig_id", F.col("ts").cast("timestamp").alias("ts"), F.col(column).cast("double").alias("depth"))
    return readings.groupBy("rig_id").applyInPandasWithState(step, "rig_id string, ts timestamp, depth double, gained double", "last double", "append", expiry)


def feed_sessions(samples: DataFrame, gap: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """Contiguous stretches of a feed as session windows: (rig_id, t_from, t_to, n)."""
    stamped = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = stamped.groupBy("rig_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return grouped.select("rig_id", F.col("s.start").cast("timestamp_ntz").alias("t_from"), F.col("s.end").cast("timestamp_ntz").alias("t_to"), "n")

"""Tables that one query writes and reads again, so that several branches share the work behind them."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str, str | None]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sondeline-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written_tables() -> int:
    return len(_written)


def release(since: int = 0, keep: tuple[DataFrame, ...] = ()) -> int:
    """Delete what was written after the first `since` tables, but for those that `keep` reads; the number of tables then left.

    Only for callers that know that nothing else reads these tables any more.
    """
    files = [f for df in keep for f in df.inputFiles()]
    stay = _written[:since]
    for spark, path, table in _written[since:]:
        if any(f"/{path.rsplit('/', 1)[1]}/" in f for f in files):
            stay.append((spark, path, table))
            continue
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete(spark, path)
    _written[:] = stay
    return len(_written)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the written tables that these read, and the shuffles that nothing refers to any more.

    Only for tables of the caller's own that no later step reads.
    """
    files = [f for df in tables for f in df.inputFiles()]
    for entry in [x for x in _written if any(f"/{x[1].rsplit('/', 1)[1]}/" in f for f in files)]:
        if entry[2]:
            spark.sql(f"DROP TABLE IF EXISTS {entry[2]}")
        delete(spark, entry[1])
        _written.remove(entry)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # Spark deletes shuffles only after a collection


@atexit.register
def _drop_written() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001  the session has gone, and with it whoever could read the tables
        return


def new_path(spark: SparkSession, tag: str, table: str | None = None) -> str:
    """A path that is deleted at the end of the process, with the catalog's table of that name."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path, table))
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back. Runs a job; survives lost executors; goes at the end of the process."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

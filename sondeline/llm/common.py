"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import discard, new_path, release, written, written_tables  # noqa: F401

#: Lower-cases A-Z, keeps digits, a-z and every byte of a non-ASCII character, and turns the rest into spaces.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4000

#: Write to the shared folder and read back: cuts the lineage, survives lost executors, gives the planner real sizes.
materialize = written


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes as well, so that very long texts don't add up in a Python worker. Smaller settings of the session stay."""
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        found = spark.conf.get(f"spark.sql.execution.arrow.{name}", None) or ""
        if not found.isdigit() or not 0 < int(found) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def give_back() -> None:
    """Return freed memory to the system at a task's end: Python workers live on, and all of an executor's share its memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from every column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod modulus = remainder; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def texts_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string or binary column."""
    return column.cast(pa.large_binary()).to_pylist()


def append_columns(df: DataFrame, source: str, fields: list[T.StructField], make, drop: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> DataFrame:
    """Append columns computed from one text column, Arrow batch by Arrow batch.

    make() is called once a task and returns a function from the column, and those of `more` (pa.Array), to one Arrow array per field.
    Other columns pass through as they are, without a shuffle; an existing column of a new name is replaced.
    """
    small_batches(df.sparkSession)
    new = {f.name for f in fields}
    keep = [n for n in df.columns if n not in new and n not in drop]
    schema = T.StructType([*(df.schema[n] for n in keep), *fields])
    names = [*keep, *(f.name for f in fields)]

    def run(batches):
        work = make()
        for batch in batches:
            made = work(batch.column(source), *(batch.column(c) for c in more)) if batch.num_rows else None
            if made is not None:
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *made], names=names)
        work = batch = made = None
        give_back()

    return df.mapInArrow(run, schema)

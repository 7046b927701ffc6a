"""Readers of the telemetry, report and offset CSV files, and the writers and catalog of derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CHANNELS
from ..functions.scalars import hole_size, parse_feed_time, parse_number
from ..operators.rollup import held_frames


class BadQuery(ValueError):
    """A request that can't be answered: what is wrong, and which values would do."""

    def __init__(self, message: str, detail: str = ""):
        super().__init__(f"{message} ({detail})" if detail else message)
        self.message, self.detail = message, detail


def csv_rows(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """(file, line, cells, width): every record as an array of raw strings, in file order by line; quotes as in RFC 4180, no header.

    width is the number of cells that the record has itself; with multiline, cells are as many as the first record's.

    A one-line-per-record file is split and read in parallel; line is then the number that its position in the file gives, dense or not.
    With multiline a file is one task, as quoted line breaks can only be told from its beginning.
    """
    options = {"header": False, "quote": '"', "escape": '"', "multiLine": multiline, "mode": "PERMISSIVE", "maxColumns": 20480}
    if multiline:
        head = spark.read.options(**options).csv(path)
        names = head.columns
        # A record of another width than the schema's is kept whole in _raw.
        schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, "_raw")])
        found = spark.read.options(**options, enforceSchema=True, columnNameOfCorruptRecord="_raw").schema(schema).csv(path)
        cells = F.array(*(F.col(n) for n in names))
        width = F.when(F.col("_raw").isNull(), len(names)).otherwise(F.size(_split("_raw")))
        return found.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), cells.alias("cells"), width.alias("width"))
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", "^﻿|\r$", "").alias("value"))
    return lines.where("value <> ''").select("file", "line", _split("value").alias("cells")).withColumn("width", F.size("cells"))


def _split(c: str) -> Column:
    """Cells of one CSV line: commas outside quotes part them; enclosing quotes go and doubled ones become single."""
    parts = F.split(F.col(c), ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(parts, lambda x: F.when(x.startswith('"') & x.endswith('"') & (F.length(x) > 1), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def _header(rows: DataFrame, number: int) -> list[str]:
    """The cells of the row with this number, counted from 0; a few rows at the top of the file are looked at."""
    top = rows.orderBy("line").limit(number + 1).collect()
    if len(top) <= number:
        raise BadQuery("the file has no header row")
    return [(x or "").strip().lstrip("﻿") for x in top[number]["cells"]]


def telemetry(spark: SparkSession, path: str, rig_id: str = "rig", time_code: str = "dtsrv", channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Well-formed samples: rig_id, ts, seq, dup_of_prev, raw cells named by channel and numbers as num_<channel>.

    The file has three header rows, of which the second has the codes. Rows of another width or without a stamp are left out
    before repeats are flagged.
    """
    rows = csv_rows(spark, path)
    names = _header(rows, 1)
    missing = [c for c in (time_code, *channels) if c not in names]
    if missing:
        raise BadQuery("the feed lacks columns", ", ".join(missing))
    third = rows.orderBy("line").limit(3).agg(F.max("line")).first()[0]
    at = lambda n: F.get("cells", F.lit(names.index(n)))
    body = rows.where((F.col("line") > third) & (F.size("cells") == len(names)))
    body = body.select(F.lit(rig_id).alias("rig_id"), parse_feed_time(at(time_code)).alias("ts"), F.col("line").alias("seq"), "cells", *(at(c).alias(c) for c in channels))
    whole = held_frames(body.where("ts is not null"), ["cells"]).drop("cells")
    return whole.withColumns({f"num_{c}": parse_number(c) for c in channels})


def samples(cells: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """The rollup's input: numbers in place of cells, and a bit depth of exactly 0 taken as missing."""
    numbers = [(F.nullif(F.col("num_DBTM"), F.lit(0.0)) if c == "DBTM" else F.col(f"num_{c}")).alias(c) for c in channels]
    return cells.select("rig_id", "ts", "seq", "dup_of_prev", *numbers)


def reports(spark: SparkSession, path: str, rig_id: str = "rig") -> DataFrame:
    """The report log; rows shorter than the header, and those without a start, are left out. idx is the place in the file."""
    rows = csv_rows(spark, path, multiline=True)
    names = _header(rows, 0)
    first = rows.agg(F.min("line")).first()[0]
    at = lambda n: F.get("cells", F.lit(names.index(n))) if n in names else F.lit(None).cast("string")
    text = lambda n: F.trim(F.coalesce(at(n), F.lit("")))
    full = rows.where(F.col("line") > first).where(F.col("width") >= len(names))
    hours = F.coalesce(parse_number(at("DURATION")), F.lit(0.0))
    start = F.coalesce(parse_feed_time(at("DTTMSTARTCALC")), parse_feed_time(at("DTTMSTART")))
    out = full.select(
        F.lit(rig_id).alias("rig_id"),
        (F.col("line") - first - 1).alias("idx"),
        *(text(n).alias(a) for n, a in (("FIELDNAME", "field"), ("WELLIDE", "well"), ("RIGNO", "rig"))),
        start.alias("start"),
        hours.alias("duration_hrs"),
        parse_feed_time(at("DTTMSPUD")).alias("spud"),
        *(text(n).alias(a) for n, a in (("WELLPHASE", "well_phase"), ("PHASE1", "phase1"), ("PHASE2", "phase2"), ("ACTIVITY", "activity"))),
        F.coalesce(parse_number(at("UNSCHEDULE_EVENT_HRS")), F.lit(0.0)).alias("npt_hrs"),
        hole_size(at("WBORESZACT")).alias("hole_size"),
        parse_number(at("DEPTHACT")).alias("depth_ft"),
        F.coalesce(at("COM"), F.lit("")).alias("comment"),
    ).where("start is not null")
    end = (F.col("start").cast("timestamp") + F.make_dt_interval(secs=F.round(F.col("duration_hrs") * 3600, 3))).cast("timestamp_ntz")
    coded = F.concat_ws(" ", "comment", "activity", "phase1", "phase2", "well_phase", "well", "rig", "hole_size")
    return out.withColumn("end", end).withColumn("body", coded)


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """The reference wells' ceilings by hole section; missing numbers are 0."""
    rows = csv_rows(spark, path)
    names = _header(rows, 0)
    first = rows.agg(F.min("line")).first()[0]
    at = lambda n: F.get("cells", F.lit(names.index(n)))
    # The table's column titles.
    tops = {"max_rop": "Max of ROP", "max_flow_rate": "Max of FLOW_RATE", "max_wob": "Max of WOB", "max_spp": "Max of SPPDRILL", "max_pu_weight": "Max of PU_WEIGHT", "max_torque": "Max of DRL_TORQUE"}
    out = rows.where(F.col("line") > first).where(F.trim(at("well_name")) != "")
    numbers = [F.coalesce(parse_number(at(title)), F.lit(0.0)).alias(n) for n, title in tops.items()]
    return out.select(F.col("line").alias("idx"), F.trim(at("well_name")).alias("well"), at("Row Labels").alias("section"), hole_size(at("Row Labels")).alias("hole_size"), *numbers)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), as_json: bool = False) -> None:
    """Overwrite a derived table, as Parquet or as JSON lines."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path) if as_json else writer.parquet(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A derived table that was written as JSON lines, nested columns included; the schema is given, so that no pass infers it."""
    return spark.read.schema(schema).json(path)


def catalog(spark: SparkSession, tables: dict[str, DataFrame | str], prefix: str = "") -> dict[str, DataFrame]:
    """Register DataFrames, or Parquet paths, as temporary views for spark.sql."""
    found = {name: spark.read.parquet(t) if isinstance(t, str) else t for name, t in tables.items()}
    for name, df in found.items():
        df.createOrReplaceTempView(prefix + name)
    return found

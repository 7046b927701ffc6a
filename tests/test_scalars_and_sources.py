"""Scalar functions and readers against the awkward cells that feeds have."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sondeline.config import CHANNELS
from sondeline.functions import scalars
from sondeline.plans.engine import parse_time
from sondeline.sources import feeds


def values(spark, function, cells):
    rows = spark.createDataFrame(list(enumerate(cells)), "k int, c string")
    return [r.v for r in rows.select("k", function(F.col("c")).alias("v")).orderBy("k").collect()]


def test_numbers(spark):
    cells = ["5.0E", " 7 ", "", None, "NaN", "Infinity", "5d", "-2.5", "1e3", ".5", "1e999"]
    assert values(spark, scalars.parse_number, cells) == [None, 7.0, None, None, None, None, None, -2.5, 1000.0, 0.5, None]


def test_times(spark):
    cells = ["9/9/2026 3:05", "9/9/2026", "bad", "", None, "12/31/2025 23:59", "13/40/2025"]
    d = datetime
    assert values(spark, scalars.parse_feed_time, cells) == [d(2026, 9, 9, 3, 5), d(2026, 9, 9), None, None, None, d(2025, 12, 31, 23, 59), None]


def test_hole_sizes(spark):
    cells = ['Drill 12-1/4" Hole', "6 1/8", "8.5", "12.25", "none", "17 - 1 / 2", "10", None, "100"]
    assert values(spark, scalars.hole_size, cells) == ["12.25", "6.125", "8.5", "12.25", None, "17.5", "10", None, "100"]


def test_tokens_and_truncation(spark):
    cells = ["The PUMP's ./mw-1. at 4761' x", "", "..", "a" * 25]
    assert values(spark, scalars.tokens, cells) == [["pump's", "/mw-1", "4761"], [], [], []]
    assert values(spark, lambda c: scalars.truncated(c, 3), ["abc", "abcd", None]) == ["abc", "abc...", None]


def test_snippet(spark):
    text = "x" * 300 + " tight spot " + "y" * 300
    d = spark.createDataFrame([(text, ["tight"]), ("short\n text", ["q"]), (text, [])], "t string, m array<string>")
    got = [r.s for r in d.select(scalars.snippet("t", F.col("m")).alias("s")).collect()]
    assert "tight" in got[0] and got[0].startswith("...") and got[0].endswith("...")
    assert got[1] == "short / text" and got[2] == text[:240] + "..."


def test_limits_and_ladder(spark):
    d = spark.createDataFrame([(5.0, 4.0), (3.0, 4.0), (1.0, 0.0), (1.0, None)], "a double, b double")
    got = [r.x for r in d.select(scalars.against_limit("a", "b").alias("x")).collect()]
    assert tuple(got[0]) == (5.0, 4.0, 25.0, True) and tuple(got[1]) == (3.0, 4.0, -25.0, False) and got[2:] == [None, None]
    ladder = [r.s for r in d.select(scalars.severity(F.col("a"), 1, 3, 5).alias("s")).collect()]
    assert ladder == ["ALARM", "WARN", "WATCH", "WATCH"]


def test_times_of_requests():
    assert parse_time(None) is None and parse_time("") is None
    assert parse_time("0") == datetime(1970, 1, 1) and parse_time("2024-01-01T02:00:00+02:00") == datetime(2024, 1, 1)
    with pytest.raises(feeds.BadQuery):
        parse_time("soon")


def test_telemetry_file(spark, tmp_path):
    path = tmp_path / "feed.csv"
    head = ["Time", *(f"label {c}" for c in CHANNELS)]
    row = lambda stamp, *cells: ",".join([stamp, *cells, *["1"] * (len(CHANNELS) - len(cells))])
    lines = ["﻿" + ",".join(head), ",".join(["dtsrv", *CHANNELS]), ",".join(["", *["ft"] * len(CHANNELS)])]
    lines += [row("9/9/2026 3:05", "0", "10"), row("9/9/2026 3:05", "0", "10"), row("bad", "5"), "9/9/2026 3:06,1", row("9/9/2026 3:06", "5.0E", "11"), row("9/9/2026 3:05", "0", "10"), ""]
    path.write_text("\r\n".join(lines))
    cells = feeds.telemetry(spark, str(path), "r1")
    got = cells.orderBy("seq").select("ts", "dup_of_prev", "DBTM", "num_DBTM", "num_DMEA").collect()
    assert [(r.ts.minute, r.dup_of_prev, r.DBTM, r.num_DBTM, r.num_DMEA) for r in got] == [
        (5, False, "0", 0.0, 10.0), (5, True, "0", 0.0, 10.0), (6, False, "5.0E", None, 11.0), (5, False, "0", 0.0, 10.0),
    ]
    assert [r.DBTM for r in feeds.samples(cells).collect()] == [None] * 4
    (tmp_path / "bad.csv").write_text("a\nb,c\nd\n")
    with pytest.raises(feeds.BadQuery):
        feeds.telemetry(spark, str(tmp_path / "bad.csv"))


def test_report_file(spark, tmp_path):
    path = tmp_path / "log.csv"
    names = ["FIELDNAME", "WELLIDE", "RIGNO", "DTTMSTARTCALC", "DTTMSTART", "DURATION", "ACTIVITY", "UNSCHEDULE_EVENT_HRS", "WBORESZACT", "DEPTHACT", "COM"]
    path.write_text(
        "﻿" + ",".join(names) + "\n"
        'F, W1 ,R1,bad,9/9/2026 2:00,1.5,TIH,,"8 1/2",100,"two\nlines, ""quoted"""\n'
        "F,W1,R1,9/9/2026 1:00,,x,TOH,0.5,,,\n"
        "F,W1,R1,,,1,TOH,0.5,,,none\n"
    )
    got = feeds.reports(spark, str(path)).orderBy("start", "idx").collect()
    assert [(r.idx, r.well, r.start.hour, r.end.hour, r.end.minute, r.npt_hrs, r.hole_size, r.depth_ft) for r in got] == [
        (1, "W1", 1, 1, 0, 0.5, None, None), (0, "W1", 2, 3, 30, 0.0, "8.5", 100.0),
    ]
    assert got[1].comment == 'two\nlines, "quoted"' and got[0].comment == ""


def test_offset_file(spark, tmp_path):
    path = tmp_path / "offsets.csv"
    path.write_text(
        "well_name,Row Labels,Max of ROP,Max of FLOW_RATE,Max of WOB,Max of SPPDRILL,Max of PU_WEIGHT,Max of DRL_TORQUE\n"
        'A-1,"Drill 12-1/4"" Hole Section",360,800,5,1901,60,1000\n'
        ",ignored,1,1,1,1,1,1\n"
        'A-1,"Drill 6-1/8"" Lateral Section",52.7,,10,2752,110,6700\n'
    )
    got = [r.asDict() for r in feeds.offsets(spark, str(path)).orderBy("idx").collect()]
    assert [g["hole_size"] for g in got] == ["12.25", "6.125"] and got[0]["section"] == 'Drill 12-1/4" Hole Section'
    assert got[1]["max_flow_rate"] == 0.0 and got[1]["max_rop"] == 52.7


def test_tables_are_written_and_registered(spark, tmp_path):
    feeds.write_table(spark.range(3), f"{tmp_path}/t")
    feeds.write_table(spark.range(3), f"{tmp_path}/j", as_json=True)
    assert sorted(json.loads(x)["id"] for f in (tmp_path / "j").glob("*.json") for x in f.read_text().split()) == [0, 1, 2]
    feeds.catalog(spark, {"numbers": f"{tmp_path}/t"}, "my_")
    assert spark.sql("SELECT sum(id) FROM my_numbers").first()[0] == 3


def test_report_rows_shorter_than_the_header_are_left_out(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text('WELLIDE,DTTMSTART,COM\nW1,9/9/2026 3:05,"one, ""two""\nthree"\nW2,9/9/2026 4:05\n\nW3,9/9/2026 5:05,\nW4,9/9/2026 6:05,four,more\nW5,9/9/2026 7:05,,more\n')
    got = feeds.reports(spark, str(path)).orderBy("start").collect()
    assert [(x["well"], x["comment"]) for x in got] == [("W1", 'one, "two"\nthree'), ("W3", ""), ("W4", "four"), ("W5", "")]


def test_the_first_four_bad_cells_of_all_channels(spark):
    from sondeline.operators import quality

    rows = [("r", 1, "x", None), ("r", 2, "x", "5.0E"), ("r", 3, "1", " y "), ("r", 4, "z", ""), ("r", 5, "w", "v")]
    cells = spark.createDataFrame(rows, "rig_id string, seq long, WOB string, DBTM string")
    cells = cells.withColumns({f"num_{c}": scalars.parse_number(c) for c in ("WOB", "DBTM")})
    assert quality.bad_cells(cells, ("WOB", "DBTM")).first()[0] == ['WOB="x"', 'DBTM="5.0E"', 'DBTM="y"', 'WOB="z"']
    assert quality.bad_cells(cells.where("false"), ("WOB", "DBTM")).first()[0] == []


def test_order_by_a_chosen_key(spark):
    from sondeline.plans.engine import ordered

    events = spark.createDataFrame([(1, "WARN"), (2, "ALARM"), (3, "WATCH"), (4, "ALARM")], "id int, severity string")
    assert [x["id"] for x in ordered(events, "severity", True, ("id",)).collect()] == [2, 4, 1, 3]
    assert [x["id"] for x in ordered(events, "id", False).collect()] == [1, 2, 3, 4]
    with pytest.raises(feeds.BadQuery):
        ordered(events, "colour")

"""The stored index against the scan of the whole log."""

import random
import re
from datetime import datetime, timedelta

import pytest

from sondeline.operators import index as m
from sondeline.operators import search
from sondeline.plans import queries

WORDS = "stuck pipe pressure washout torque night repair pump tight spot circulate bottom hole clean trip".split()


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(4)
    rows = []
    for k in range(900):
        text = " ".join(rng.choices(WORDS, weights=[1 + (j * j) % 17 for j in range(len(WORDS))], k=rng.randrange(0, 30))) if k % 50 else None
        start = datetime(2024, 1, 1) + timedelta(hours=rng.randrange(400))
        rows.append((k * 3, start, start + timedelta(hours=1), text, text, f"W{k % 3}", "R", rng.choice("AB"), "", "", "", float(k % 5 == 0), None))
    schema = "idx long, start timestamp_ntz, end timestamp_ntz, body string, comment string, well string, rig string, activity string, phase1 string, phase2 string, hole_size string, npt_hrs double, depth_ft double"
    return spark.createDataFrame(rows, schema)


def told(d):
    return [(r.idx, r.score, sorted(r.matched), r.snippet) for r in d.collect()]


@pytest.mark.parametrize("ask,given,limit", [
    ("stuck pipe", search.Filters(), 5), ("what about the pump pressure at night", search.Filters(), 8), ("torque", search.Filters(well="W1", activity="A"), 25),
    ("unseen words only", search.Filters(), 4), ("problem with a tight spot", search.Filters(npt_only=True), 3),
])
def test_index_equals_scan(spark, log, ask, given, limit):
    made = m.build(log, block=40)
    want = told(search.search(log, ask, given, limit))
    for first in (1, 8, 1000):
        assert told(m.search(made, log, ask, given, limit, first=first)) == want


def test_blocks_are_left_out_and_texts_read_late(spark, log, tmp_path):
    log.write.parquet(f"{tmp_path}/log")
    stored = spark.read.parquet(f"{tmp_path}/log")
    made = m.build(stored, f"{tmp_path}/index", block=40)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    hits = m.search(made, stored, "stuck pipe", limit=3)
    assert re.search(r"PushedFilters: \[[^\]]*In\(idx", plan(hits)) and "hashpartitioning" not in plan(hits).split("Scan")[0].split("Join")[0]
    assert told(hits) == told(search.search(stored, "stuck pipe", limit=3))
    scan = plan(search.search(stored, "stuck pipe", limit=3))
    wide = [x for x in re.findall(r"Exchange hashpartitioning.*", scan) if "body" in x or "comment" in x]
    assert not wide  # texts go through no shuffle
    assert m.build(log.limit(0), block=40).table("postings").count() == 0 and told(m.search(m.build(log.limit(0)), log.limit(0), "stuck", limit=3)) == []


def test_segments_grow_in_number_and_no_posting_is_shuffled(spark, log, monkeypatch):
    plan = search.postings(search.segmented(log))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning(idx" in plan
    want = sorted(map(tuple, search.postings(log).collect()))
    monkeypatch.setattr(search.segmented, "__defaults__", ("body", "idx", 200))
    made = m.build(log, block=40)
    stored = made.table("postings")
    assert len(stored.inputFiles()) > 50
    assert sorted((r.idx, r.term, r.tf, r.len) for r in stored.collect()) == want
    assert told(m.search(made, log, "stuck pipe", limit=5)) == told(search.search(log, "stuck pipe", limit=5))


def test_postings_of_dealt_texts_are_not_shuffled(spark, log):
    twice = log.union(log.limit(3))  # rows of one number are counted together, wherever they lie
    made = search.postings(search.dealt(twice, size=200))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)", made._jdf.queryExecution().executedPlan().toString())
    assert len(exchanges) == 1 and exchanges[0].startswith("idx") and "term" not in exchanges[0]
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, search.postings(twice).collect()))
    plan = queries.bm25_postings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\([^)]*term", plan)

"""The driver's functions, with and without the training-data operators, and every query on the smallest tables."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_it_imports_without_the_training_data_operators(tmp_path):
    import shutil

    shutil.copytree(f"{REPO}/sondeline", f"{tmp_path}/sondeline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 40 and not any(x.startswith('op') and x[2].isdigit() for x in n); print(len(n), len(e.oracle_sql()))"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""})


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import glob

    from sondeline.plans.queries import QUERIES, SQL

    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    wrong = []
    for name in ("held_frames", "feed_gaps", "state_spans", "flag_runs", "interval_4h", "resample_gap_nulls", "greedy_series", "asof_hole_size", "range_join_agreement", "nearest_lookup", "envelope_left", "bm25_topk", "quality_report"):
        got, want = QUERIES[name](spark, SMALL).toArrow(), con.execute(SQL[name]).to_arrow_table()
        columns = sorted(got.column_names)
        rows = [sorted(map(str, zip(*(t.column(c).to_pylist() for c in columns), strict=True))) for t in (got, want)]
        if columns != sorted(want.column_names) or rows[0] != rows[1]:
            wrong.append(name)
    assert not wrong

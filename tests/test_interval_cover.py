"""Intervals of any length joined by equality on aligned pieces, against plain loops."""

import random

from sondeline.operators import joins


def rows_of(rng, n, reach):
    out = []
    for k in range(n):
        a = rng.randrange(-reach, reach)
        out.append((rng.choice("pq"), a, a + rng.choice([-3, 0, 1, 2, 15, 16, 17, 255, 4096, rng.randrange(reach)]), k))
    return out


def test_pieces_cover_every_interval_once(spark):
    rng = random.Random(3)
    rows = rows_of(rng, 150, 5_000) + [("p", None, 4, 900), ("p", 4, None, 901)]
    cut = joins.pieces(spark.createDataFrame(rows, "k string, first long, until long, id long")).collect()
    got = {}
    for r in cut:
        size = 16**r.level
        got.setdefault(r.id, []).extend(range(r.piece * size, r.piece * size + size))
    assert {k: sorted(v) for k, v in got.items()} == {i: list(range(a, b)) for _, a, b, i in rows if a is not None and b is not None and a < b}


def test_a_long_interval_has_few_pieces(spark):
    year = 366 * 24 * 60
    d = spark.createDataFrame([(7, 7 + year), (-5, 10**15)], "first long, until long")
    by = {r["first"]: r["count"] for r in joins.pieces(d).groupBy("first").count().collect()}
    assert by[7] <= 30 * 5 and by[-5] <= 30 * 13
    points = spark.createDataFrame([("r", t) for t in (-6, -5, 0, 10**15 - 1, 10**15)], "k string, at long")
    inside = joins.within(points, spark.createDataFrame([("r", -5, 10**15)], "k string, first long, until long"), ["k"])
    assert sorted(r.at for r in inside.collect()) == [-5, 0, 10**15 - 1]


def test_joins_equal_plain_loops(spark):
    rng = random.Random(4)
    rows, others = rows_of(rng, 90, 600), rows_of(rng, 70, 600)
    rows += [rows[0], (None, 0, 50, 500), ("p", None, 9, 501), ("p", 5, None, 502)]  # a repeated row, and nulls
    points = [(rng.choice("pqr"), rng.randrange(-700, 1300), k) for k in range(120)] + [("p", None, 800), (None, 3, 801)]
    points.append(points[0])
    schema = "k string, first long, until long, id long"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(others, schema)
    p = spark.createDataFrame(points, "k string, at long, n long")
    full = [r for r in rows if None not in r and r[1] < r[2]]
    got = sorted((r.id, r.n) for r in joins.within(p, a, ["k"]).collect())
    assert got == sorted((i, n) for k, x, y, i in full for key, t, n in points if key == k and t is not None and x <= t < y)
    got = sorted((r.l.id, r.r.id) for r in joins.overlapping(a, b, ["k"]).collect())
    assert got == sorted((i, j) for k, x, y, i in full for m, u, v, j in others if k == m and u < v and x < v and u < y)
    for none in (a.limit(0), a.where("until <= first")):
        assert joins.within(p, none, ["k"]).count() == joins.overlapping(none, b, ["k"]).count() == joins.overlapping(b, none, ["k"]).count() == 0


def test_no_theta_join(spark):
    d = spark.createDataFrame(rows_of(random.Random(5), 20, 50), "k string, first long, until long, id long")
    plan = joins.overlapping(d, d, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") <= 2 * plan.count("collect_set(level")  # one-row sides only

"""Points in intervals against comparing all."""

import datetime
import random

import duckdb

from quaver.operators.intervals import containing, first_and_count, first_containing
from quaver.plans import mastering  # noqa: F401  # registers its queries
from quaver.plans.queries import ORACLES, QUERIES


def test_against_all_pairs(spark):
    r = random.Random(8)
    intervals = []
    for k in ("a", "b", None):
        for n in range(150):
            start = r.choice([r.uniform(-1000, 1000), r.randrange(-64, 64)])
            intervals.append((k, float(start), float(start) + r.choice([0, -3, 1, 2, 64, 0.001, r.uniform(0, 5), 5000, 1e-9]), f"{k}{n % 120}"))
    intervals += [("a", None, 5.0, "null"), ("a", 1.0, None, "null"), ("a", 0.0, 64.0, "twice"), ("a", 0.0, 64.0, "twice")]
    points = [(k, float(x), n) for n, (k, x) in enumerate((r.choice(["a", "b", "c", None]), r.choice([r.uniform(-1100, 1100), r.randrange(-70, 70)])) for _ in range(400))]
    points += [("a", None, 1000), ("a", 64.0, 1001), ("a", 0.0, 1002)]
    p = spark.createDataFrame(points, "k string, at double, id int")
    i = spark.createDataFrame(intervals, "k string, start double, end double, name string")
    holds = [(x, y) for x in points for y in intervals if x[0] is not None and x[0] == y[0] and None not in (x[1], y[1], y[2]) and y[1] <= x[1] < y[2]]
    got = containing(p, i, ["k"])
    assert sorted((r["id"], r["name"], r["start"], r["end"]) for r in got.collect()) == sorted((x[2], y[3], y[1], y[2]) for x, y in holds)
    first = {}
    for x, y in holds:
        first[x] = min(first.get(x, (9e9, "")), (y[1], y[3]))
    assert {(r["k"], r["at"], r["id"]): r["name"] for r in first_containing(p, i, ["k"], "name").collect()} == {x: v[1] for x, v in first.items()}
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_no_points_and_no_intervals(spark):
    p = spark.createDataFrame([("a", 1.0)], "k string, at double")
    i = spark.createDataFrame([("a", 0.0, 2.0, "x")], "k string, start double, end double, name string")
    assert containing(p, i.limit(0), ["k"]).count() == 0 and containing(p.limit(0), i, ["k"]).count() == 0 and containing(p, i, ["k"]).count() == 1


def test_no_side_goes_through_the_driver(spark):
    p = spark.createDataFrame([("a", float(n % 7), n) for n in range(50)], "k string, at double, id int")
    i = spark.createDataFrame([("a", 0.5 * n, 0.5 * n + 3, n) for n in range(20)], "k string, start double, end double, name int")
    for got in (containing(p, i, ["k"]), first_and_count(p, i, ["k"], "name")):
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: (r["first"]["name"], r["n"]) for r in first_and_count(p, i, ["k"], "name").collect()}
    held = {n: [m for m in range(20) if 0.5 * m <= n % 7 < 0.5 * m + 3] for n in range(50)}
    assert got == {n: (min(m), len(m)) for n, m in held.items()}


def test_sections_of_repeated_and_nameless_orders(spark, tmp_path):
    r, day = random.Random(3), lambda n: datetime.datetime(2000, 1, 1) + datetime.timedelta(days=n)
    lines = [(n, r.randrange(4), n % 8, float(r.randrange(1, 50)), day(r.randrange(300))) for n in range(200)]
    orders = [(r.choice([None, None, *range(40)]), r.randrange(5) + 100 * r.randrange(3), day(r.randrange(300))) for _ in range(150)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["sections_from_tables"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(ORACLES["sections_from_tables"]).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and any(x[0] is None for x in want)

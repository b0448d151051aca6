"""Stored pyramids: which level a view reads, and what it shows."""

import numpy as np
from pyspark.sql import functions as F

from quaver.operators.views import store_pyramid, views


def test_a_view_reads_one_level(spark, tmp_path):
    n = 5000
    x = np.sin(np.arange(n) * 0.01) * np.linspace(0, 1, n)
    s = spark.createDataFrame([("t", i, float(v), float(v)) for i, v in enumerate(x)] + [("short", i, 0.5, 0.5) for i in range(30)], "track string, idx long, l double, r double")
    path = f"file://{tmp_path}/p"
    store_pyramid(s, path, 4, 8, 10)
    ask = lambda *rows: spark.createDataFrame(rows, "view int, track string, start double, length double")
    cases = [(1, "t", 0.0, 5000.0, 2), (2, "t", 1000.0, 400.0, 1), (3, "t", 7.0, 40.0, 0), (4, "t", 10.0, 5.0, 0), (5, "short", 0.0, 300.0, 0), (6, "t", 4900.0, 400.0, 1), (7, "none", 0.0, 10.0, 0), (8, "t", 0.0, 0.0, 0)]
    got = {}
    for r in views(spark, path, ask(*[c[:4] for c in cases]), 10, 4, 8).collect():
        got.setdefault(r["view"], {})[r["x"]] = r
    assert set(got) == {1, 2, 3, 4, 5, 6}
    for view, track, start, length, level in cases[:6]:
        size, per = 4 * 8**level, length / 10
        for px, r in got[view].items():
            a = int(max(0, np.floor(start / size + px * per / size)))
            b = max(a + 1, int(np.ceil(start / size + (px + 1) * per / size)))
            whole = (x if track == "t" else np.full(30, 0.5))[a * size : b * size]
            assert r["level"] == level and r["mn"] == min(0, whole.min()) and r["mx"] == max(0, whole.max())
    assert set(got[6]) == set(range(4)) and set(got[1]) == set(range(10))  # pixels past the end are left out
    plan = views(spark, path, ask((1, "t", 0.0, 5000.0)), 10, 4, 8)._jdf.queryExecution().executedPlan().toString()
    assert any("level#" in p.split("PushedFilters")[0] for p in plan.split("PartitionFilters")[1:]), plan
    assert spark.read.parquet(path).where(F.col("level") == 2).count() == 20


def test_no_samples_and_no_views(spark, tmp_path):
    s = spark.createDataFrame([], "track string, idx long, l double, r double")
    store_pyramid(s, f"file://{tmp_path}/p")
    ask = spark.createDataFrame([(1, "t", 0.0, 10.0)], "view int, track string, start double, length double")
    assert views(spark, f"file://{tmp_path}/p", ask, 10).count() == 0
    one = spark.createDataFrame([("t", 0, 0.5, 0.5)], s.schema)
    store_pyramid(one, f"file://{tmp_path}/q")
    assert views(spark, f"file://{tmp_path}/q", ask.limit(0), 10).count() == 0 and views(spark, f"file://{tmp_path}/q", ask, 10).count() == 10

"""Invariants of the signal operators, and oracles on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from quaver.functions import highpass, k_weighting, peaking, shelf
from quaver.operators import measure as m
import quaver.plans.dynamics  # registers its queries
import quaver.plans.chain
import quaver.plans.files
import quaver.plans.mastering
import quaver.plans.project
import quaver.plans.tempo
from quaver.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def tone(spark, level, n=2000, track="t"):
    return spark.createDataFrame([(track, i, level * float(np.sin(0.3 * i)), level * float(np.cos(0.3 * i))) for i in range(n)], "track string, idx long, l double, r double")


def test_filter_without_gain_is_identity():
    x = np.random.default_rng(1).normal(size=200)
    for c in (peaking(48000, 1000, 0.0, 1.0), shelf(48000, 700, 0.0, 0.6), shelf(48000, 700, 0.0, 0.6, high=False)):
        assert np.allclose(m.biquad(x, c), x)


def test_k_weighting_matches_known_coefficients():
    first, second = k_weighting()
    assert np.allclose(first, (1.5293010862644656, -2.636085658361422, 1.1584504013570063, -1.6537543530358536, 0.7054201822959032))
    assert np.allclose(second, (0.9950299263000475, -1.990059852600095, 0.9950299263000475, -1.99004745483398, 0.9900722503662099))
    assert abs(m.biquad(np.ones(20000), highpass(48000, 38, 0.5))[-1]) < 1e-6


def test_gain_moves_loudness_by_as_much(spark):
    a, b = (m.integrated_loudness(m.weighted_hops(tone(spark, g))).first()["lufs"] for g in (0.1, 0.2))
    assert b - a == pytest.approx(20 * np.log10(2), abs=1e-6)


def test_short_and_silent_signals_have_sentinels(spark):
    assert m.integrated_loudness(m.weighted_hops(tone(spark, 0.1, n=30))).first()["lufs"] == -70.0
    assert m.integrated_loudness(m.weighted_hops(tone(spark, 0.0))).first()["lufs"] == -70.0
    assert m.loudness_range(m.weighted_hops(tone(spark, 0.1, n=300))).first()["lra"] == 0.0
    assert m.balance_offset(tone(spark, 0.0)).first()["bal_db"] == 0.0


def test_pyramid_level_is_the_aggregate_of_the_one_below(spark):
    rows = m.pyramid(tone(spark, 0.5, n=1000)).collect()
    for k in (1, 2):
        for r in [x for x in rows if x["level"] == k]:
            below = [x for x in rows if x["level"] == k - 1 and x["bucket"] // 8 == r["bucket"]]
            assert r["mn"] == min(x["mn"] for x in below) and r["mx"] == max(x["mx"] for x in below)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, name):
    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    number = lambda v: isinstance(v, float | np.floating) and not np.isnan(v)
    plain = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else v if number(v) else str(int(v)) if isinstance(v, np.integer) else str(v)
    by = lambda row: [(v is None, f"{v:.2f}" if number(v) else str(v)) for v in sorted(row, key=number)]
    a = sorted(([plain(r[c]) for c in cols] for r in got.collect()), key=by)
    b = sorted(([plain(v) for v in r] for r in want[cols].itertuples(index=False)), key=by)
    assert len(a) == len(b)
    # both sides round to four places, so that a value between two of them may differ by one step of the last
    same = lambda x, y: abs(x - y) <= 1.01e-4 + 1e-9 * abs(y) if number(x) and number(y) else x == y
    assert [(x, y) for x, y in zip(a, b, strict=True) if not all(map(same, x, y))] == []


def test_streamed_frames_are_served_from_files(spark):
    got = QUERIES["meter_frames_streamed"](spark, "/root/testdata/sf0.001")
    assert got.inputFiles()  # a memory sink has none: its rows are the driver's
    want = QUERIES["meter_frames_batch"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_streamed_frames_over_several_batches(spark):
    from quaver.streaming.meters import meter_frames, stream_frames

    rows = [(t, i, float((i * 37) % 101 - 50), None if i % 5 == 0 else 1.0) for t in ("a", "b") for i in range(300)]
    signal = spark.createDataFrame(rows, "track string, i long, l double, r double")
    got = stream_frames(signal.repartition(4, "i"), files_per_batch=1)
    want = meter_frames(signal.withColumnRenamed("i", "idx"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert stream_frames(signal.limit(0)).count() == 0


def test_filters_carry_their_state_between_batches(spark):
    rows = [(t, i, float((i * 37) % 101 - 50), float((i * i) % 17)) for t in ("a", "b", None, "c") for i in range(200)]
    stages, key = list(k_weighting()), "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        made = m.filtered(spark.createDataFrame(rows[::-1], "track string, idx long, l double, r double"), stages)
        assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()  # which holds a whole track
        got = {(r["track"], r["idx"]): (r["l"], r["r"]) for r in made.collect()}
    finally:
        spark.conf.set(key, was)
    for t in ("a", "b", None, "c"):
        for k in (2, 3):
            want = np.array([r[k] for r in rows if r[0] == t])
            for s in stages:
                want = m.biquad(want, s)
            assert [got[t, i][k - 2] for i in range(200)] == want.tolist()

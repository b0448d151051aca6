"""Invariants of stems, width, the loudness solve, sections and curve matching."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaver.functions import k_weighting
from quaver.operators import mastering as ma
from quaver.operators import measure as m


def tone(spark, level, n=3000):
    return spark.createDataFrame([("t", i, level * math.sin(0.3 * i), level * math.cos(0.21 * i)) for i in range(n)], "track string, idx long, l double, r double")


def test_unit_width_is_identity_and_mono_bass_removes_low_sides(spark):
    s = tone(spark, 0.3)
    same = ma.widen(s, 1.0, 48000).orderBy("idx").toPandas()
    assert np.allclose(same[["l", "r"]], s.orderBy("idx").toPandas()[["l", "r"]], atol=1e-12)
    low = spark.createDataFrame([("t", i, math.sin(0.001 * i), -math.sin(0.001 * i)) for i in range(6000)], s.schema)
    side = ma.widen(low, 1.0, 48000, bass_mono=True).agg(F.sum(F.pow((F.col("l") - F.col("r")) / 2, 2))).first()[0]
    assert side < 0.05 * 3000


def test_saturated_silence_is_silent_and_small_signals_pass(spark):
    r = spark.createDataFrame([(0.0,), (1e-4,)], "x double").select("x", ma.saturate(F.col("x"), 0.01).alias("y")).orderBy("x").collect()
    assert r[0]["y"] == pytest.approx(0, abs=1e-15) and r[1]["y"] == pytest.approx(1e-4, rel=0.01)


def test_solve_reaches_the_target(spark):
    s = tone(spark, 0.05)
    got = ma.solve_gain(s, -20.0, 0.3).first()
    assert abs(got["final_err"]) <= 0.15 and 1 < got["passes"] <= 4
    loud = s.select("track", "idx", *[ma.saturate(F.col(c) * 10 ** (got["gain_db"] / 20), 0.3).alias(c) for c in "lr"])
    assert m.integrated_loudness(m.weighted_hops(loud)).first()["lufs"] == pytest.approx(-20.0 - got["final_err"], abs=1e-6)
    assert ma.solve_gain(tone(spark, 0.0), -20.0, 0.3).first()["passes"] == 4
    assert ma.solve_gain(tone(spark, 0.1, n=5), -20.0, 0.3).first()["final_err"] == 50.0


def test_expanding_loudness_ends_at_the_integrated_one(spark):
    rng = np.random.default_rng(5)
    hops = spark.createDataFrame([("t", h, float(e)) for h, e in enumerate(rng.lognormal(-4, 3, 400))], "track string, hop long, e double")
    got = {r["hop"]: r["lufs"] for r in ma.expanding_loudness(hops).collect()}
    for at in (4, 99, 399):
        assert got[at] == pytest.approx(m.integrated_loudness(hops.where(F.col("hop") <= at)).first()["lufs"], abs=1e-9)
    silent = hops.withColumn("e", F.lit(0.0))
    assert {r["lufs"] for r in ma.expanding_loudness(silent).collect()} == {-70.0}


def test_peaks_are_greedy_and_higher_ones_replace(spark):
    v = [0, 5, 0, 6, 0, 0, 0, 0, 0, 0, 0, 0, 0, 4, 0, 3, 0, 0]
    curve = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "label string, col long, v double")
    assert [(r["col"], r["v"]) for r in ma.pick_peaks(curve, 0.5, 8).orderBy("col").collect()] == [(3, 6.0), (13, 4.0)]
    assert ma.pick_peaks(curve.where("false"), 0.5, 8).count() == 0
    assert ma.bar_offset(spark.createDataFrame([("a", 9), ("a", 25)], "label string, col long"), 1, 4).first()[1:] == (2, 0)


def test_sections_by_terciles(spark):
    rows = [("t", i, x) for i, x in enumerate([1.0, 5.0, 3.0, 9.0, 8.0, 2.0])]
    got = ma.label_sections(spark.createDataFrame(rows, "track string, seg long, mean double")).orderBy("seg").collect()
    assert [r["label"] for r in got] == ["INTRO", "MID", "LOW", "PEAK", "PEAK", "OUTRO"]


def test_equal_curves_need_no_gain(spark):
    pairs = spark.createDataFrame([("x", b, float(b), float(b) + 3) for b in range(7)], "k string, band int, a double, b double")
    gains = ma.at_centres(ma.shape_difference(pairs, ["k"]), ["k"], 7).collect()
    assert len(gains) == len(ma.MATCH_CENTRES) and all(abs(g["level"]) < 1e-12 for g in gains)


def test_k_weighting_is_stable():
    assert all(abs(a2) < 1 and abs(a1) < 1 + a2 + 1e-9 for *_, a1, a2 in k_weighting())


def test_lanes_without_gain_are_identity(spark):
    s = tone(spark, 0.3, n=500)
    want = s.orderBy("idx").toPandas()[["l", "r"]]
    for lane in ma.LANES:
        assert np.allclose(ma.lane_gain(s, lane, 0.0, 48000).orderBy("idx").toPandas()[["l", "r"]], want)


def test_frames_and_powers_are_those_of_a_windowed_transform(spark):
    x = np.random.default_rng(2).normal(size=250)
    s = spark.createDataFrame([("t", i, float(v), float(v)) for i, v in enumerate(x)], "track string, i long, l double, r double")
    got = {(r["col"], r["k"]): r["power"] for r in ma.powers(ma.framed(s, 64, 32), ["track", "col"], 64).collect()}
    assert {c for c, _ in got} == set(range((250 - 64) // 32 + 1))
    for c in {c for c, _ in got}:
        want = np.abs(np.fft.rfft(x[c * 32 : c * 32 + 64] * np.hanning(64))) ** 2
        assert np.allclose([got[c, k] for k in range(33)], want)
    assert ma.framed(s.where("i < 50"), 64, 32).count() == 0

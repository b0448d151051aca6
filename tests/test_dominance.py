"""Sums over the past above a bar, and autocorrelation by transforms, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaver.operators.dominance import sums_above
from quaver.operators.mastering import expanding_loudness
from quaver.operators.spectra import autocorrelation


@pytest.mark.parametrize("span", [4, 16, 1024])
def test_sums_above_are_those_of_all_pairs(spark, span):
    rng = np.random.default_rng(span)
    tracks = {"long": rng.normal(0, 1, 150), "ties": rng.integers(0, 4, 90).astype(float), "flat": np.full(70, 0.5), None: rng.normal(0, 1, 33), "one": np.array([2.0])}
    values = [(t, i, None if t == "long" and i % 11 == 5 else float(x)) for t, v in tracks.items() for i, x in enumerate(v)]
    asks = [(t, i, None if i == 6 else float(x)) for t, v in tracks.items() for i, x in enumerate(np.roll(v, 3)) if i % 3 == 0]
    got = sums_above(spark.createDataFrame(values, "track string, at long, v double"), spark.createDataFrame(asks, "track string, at long, bar double"), span).collect()
    want = {}
    for t, at, bar in asks:
        past = [v for u, i, v in values if u == t and i <= at and v is not None and bar is not None and v > bar]
        want[t, at] = (len(past), sum(past))
    assert len(got) == len(want)
    for r in got:
        n, total = want[r["track"], r["at"]]
        assert r["n"] == n and r["total"] == pytest.approx(total, abs=1e-9)


def test_nothing_to_ask_and_nothing_to_sum(spark):
    values = spark.createDataFrame([("a", 5000, 1.0)], "track string, at long, v double")
    asks = spark.createDataFrame([("a", 5001, 0.5), ("b", 9000, 0.5)], "track string, at long, bar double")
    assert sums_above(values, asks.limit(0)).count() == 0
    assert {(r["track"], r["n"]) for r in sums_above(values, asks).collect()} == {("a", 1), ("b", 0)}
    assert {r["n"] for r in sums_above(values.limit(0), asks).collect()} == {0}


def test_expanding_loudness_is_the_same_in_any_spans(spark):
    rng = np.random.default_rng(8)
    e = np.concatenate([rng.lognormal(-5, 2, 300), np.zeros(50), np.full(120, 0.01)])
    hops = spark.createDataFrame([("t", h, float(x)) for h, x in enumerate(e)], "track string, hop long, e double")
    block = np.array([e[i - 3 : i + 1].mean() if i >= 3 else 0.0 for i in range(len(e))])
    for span in (8, 64):
        got = {r["hop"]: r["lufs"] for r in expanding_loudness(hops, 5, span).collect()}
        assert set(got) == set(range(4, len(e), 5))
        for at in (4, 9, 64, 299, 344, 469):
            past = block[: at + 1][block[: at + 1] > 10 ** ((-70 + 0.691) / 10)]
            assert got[at] == pytest.approx(-0.691 + 10 * np.log10(past[past > past.mean() / 10].mean()), abs=1e-9)


def test_autocorrelation_is_that_of_sums_of_products(spark):
    rng = np.random.default_rng(2)
    tracks = {"a": rng.normal(0, 1, 3000), "b": rng.normal(1, 1, 7), None: rng.normal(0, 1, 1030)}
    rows = [(t, i, float(x)) for t, v in tracks.items() for i, x in enumerate(v)]
    series = spark.createDataFrame(rows, "track string, col long, v double").repartition(3)
    got = {(r["track"], r["lag"]): r for r in autocorrelation(series, "v", 2, 40).collect()}
    assert len(got) == 3 * 39
    for (t, lag), r in got.items():
        x = tracks[t]
        assert r["n"] == len(x) and r["p"] == pytest.approx(float(x[lag:] @ x[:-lag]) if lag < len(x) else 0.0, abs=1e-8)
    assert autocorrelation(series.where(F.lit(False)), "v", 1, 4).count() == 0

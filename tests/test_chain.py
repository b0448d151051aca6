"""The chain against plain loops over samples, and what a render returns against its own measures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaver.functions import k_weighting, peaking, highpass
from quaver.operators import blocks, chain as ch
from quaver.operators import measure as m

FS = 48000


def noise(spark, n=3000, tracks=("a", "b"), level=0.2):
    r = np.random.default_rng(7)
    rows = [(t, i, float(level * x), float(level * y)) for t in tracks for i, (x, y) in enumerate(r.normal(size=(n, 2)) * (1 + 3 * (np.arange(n) % 700 < 40))[:, None])]
    return spark.createDataFrame(rows, "track string, idx long, l double, r double")


def arrays(df):
    got = df.where("track = 'a'").orderBy("idx").toPandas()
    return got["l"].to_numpy(), got["r"].to_numpy()


def test_parallel_blocks_equal_the_recursion(spark):
    s, stages = noise(spark, 2500), [*k_weighting(), peaking(FS, 300, 4, 0.7)]
    want = arrays(s)
    for c in stages:
        want = tuple(blocks.biquad(x, c) for x in want)
    for size in (64, 100, 4096):
        assert np.allclose(arrays(blocks.filtered(s, stages, size)), want, atol=1e-10)
    hops = {(r["track"], r["hop"]): r["e"] for r in blocks.filtered_energy(s, stages, 70, 500).collect()}
    e = want[0] ** 2 + want[1] ** 2
    assert len(hops) == 2 * (2500 // 70) and all(hops["a", h] == pytest.approx(e[h * 70 : h * 70 + 70].mean()) for h in range(35))


def test_positions_of_uneven_and_null_rows(spark):
    rows = [("a", i * i, 0.0, 0.0) for i in range(500)] + [("b", 249001 - i, 0.0, 0.0) for i in range(9)] + [(None, 5, 0.0, 0.0), (None, 1, 0.0, 0.0), ("c", None, 0.0, 0.0), ("c", 3, 0.0, 0.0)]
    from quaver.sources import positions

    got = {(r["track"], r["idx"]): r["i"] for r in positions(spark.createDataFrame(rows, "track string, idx long, l double, r double")).collect()}
    for t in ("a", "b", "c", None):
        order = sorted((x for k, x, *_ in rows if k == t), key=lambda x: (x is None, x or 0))
        assert [got[t, x] for x in order] == list(range(len(order)))


def test_windows_over_blocks_look_back_into_the_block_before(spark):
    s = noise(spark, 700, ("a",))
    whole = ch.dyn.gains_needed(s, 0.3, 1000).orderBy("idx").collect()
    was, blocks.haloed.__defaults__ = blocks.haloed.__defaults__, (50,)
    try:
        assert ch.dyn.gains_needed(s, 0.3, 1000).orderBy("idx").collect() == whole
        assert len(whole) == 700 and min(r["gain"] for r in whole) < 1
    finally:
        blocks.haloed.__defaults__ = was


def plain_cut(left, right, amount, block=128):
    """De-harsh: sample by sample."""
    keep = lambda t: 1 - math.exp(-1 / (FS * t))
    b0, b1, b2, a1, a2 = highpass(FS, 4500, 0.707)
    z1 = z2 = high = wide = gr = 0.0
    applied, cut, zs, out = -1.0, None, [[0.0, 0.0], [0.0, 0.0]], [[], []]
    for at in range(0, len(left), block):
        n = min(block, len(left) - at)
        for i in range(at, at + n):
            x = (left[i] + right[i]) / 2
            y = b0 * x + z1
            z1, z2 = b1 * x - a1 * y + z2, b2 * x - a2 * y
            high += keep(0.003 if abs(y) > high else 0.08) * (abs(y) - high)
            wide += keep(0.003 if abs(x) > wide else 0.08) * (abs(x) - wide)
        goal = amount * min(6, max(0, 20 * math.log10((high + 1e-9) / (wide + 1e-9)) + 8))
        gr = max(0, gr + min(1, keep(0.004 if goal > gr else 0.12) * n) * (goal - gr))
        if abs(gr - applied) > 0.05:
            applied, cut = gr, peaking(FS, 6500, -gr, 1.1)
        for k, ch_ in enumerate((left, right)):
            for i in range(at, at + n):
                y = cut[0] * ch_[i] + zs[k][0]
                zs[k] = [cut[1] * ch_[i] - cut[3] * y + zs[k][1], cut[2] * ch_[i] - cut[4] * y]
                out[k].append(y)
    return np.array(out)


def test_deharsh_cut_against_plain_loops(spark):
    s, key = noise(spark, 1500), "spark.sql.execution.arrow.maxRecordsPerBatch"
    want, was = plain_cut(*arrays(s), 0.8), spark.conf.get(key)
    spark.conf.set(key, "37")
    try:
        got = arrays(ch.ordered(s, lambda: ch.DeHarsher(0.8, FS, 128)))
    finally:
        spark.conf.set(key, was)
    assert np.allclose(got, want, atol=1e-12)


def test_pieces_do_not_change_the_chain():
    r, s = np.random.default_rng(3), ch.Settings(smooth=0.6, character=0.5, density=0.5, impact=0.4, width=1.4, lanes_db={"vocal": 2.0, "drums": -1.0})
    x, y = r.normal(size=(2, 2000)) * 0.3
    outs = []
    for cuts in ([], [1, 2, 130, 700, 701, 1900]):
        part, got = ch.Chained([make() for make in ch.dynamics(s, FS)]), []
        for a, b in zip([0, *cuts], [*cuts, 2000], strict=True):
            got.append(part.push(x[a:b], y[a:b]))
        got.append(part.finish()[:2])
        outs.append(np.concatenate([np.stack(g) for g in got], 1))
    assert outs[0].shape == (2, 2000) and np.allclose(outs[0], outs[1], atol=1e-9)


def test_render_reaches_the_target_below_the_ceiling(spark):
    s = noise(spark, 6000, level=0.05)
    out, state = ch.render(s, ch.Settings(density=0.3, ceiling_db=-1.0), -18.0, FS, 480)
    lufs = {r["track"]: r["lufs"] for r in m.integrated_loudness(m.weighted_hops(out.drop("gain"), 480)).collect()}
    for r in state.collect():
        assert abs(r["err"]) <= 0.15 and r["passes"] <= 4 and r["lufs"] == pytest.approx(lufs[r["track"]], abs=1e-9) and r["lufs"] == pytest.approx(-18, abs=0.15)
    assert out.agg(F.max(F.greatest(F.abs("l"), F.abs("r")))).first()[0] <= 10 ** (-1 / 20) + 1e-12
    assert ch.dyn.true_peaks(out).agg(20 * F.log10(F.max("peak"))).first()[0] < -1 + 0.3


def test_calibration_is_what_the_chain_adds(spark):
    s = noise(spark, 6000, tracks=("a",), level=0.05)
    got = ch.calibrate(s, ch.Settings(tone=0.4, density=0.5), -20.0, FS, 480).first()["delta_db"]
    one = ch.core(s, ch.Settings(tone=0.4, density=0.5, staging_db=2.0), FS)
    loud = lambda x: m.integrated_loudness(m.weighted_hops(x, 480)).first()["lufs"]
    assert got == pytest.approx(loud(one) - loud(s) - 2.0, abs=0.05)  # the limiter at 24 dB only delays
    assert abs(ch.calibrate(s, ch.Settings(), -20.0, FS, 480).first()["delta_db"]) < 0.2


def test_preview_has_buckets_of_512(spark):
    pyramid, lane, state = ch.preview(noise(spark, 6000, tracks=("a",), level=0.05), ch.Settings(), -20.0, -15.0, FS, 480)
    assert pyramid.count() == 12 and lane.count() == 2 and abs(state.first()["err"]) < 0.25 and state.first()["passes"] <= 3


def test_peaks_are_looked_for_once_however_many_passes(spark, monkeypatch):
    calls, made = [], ch.dyn.peaks_ahead
    monkeypatch.setattr(ch.dyn, "peaks_ahead", lambda *a: calls.append(a) or made(*a), raising=False)
    r = np.random.default_rng(6)
    rows = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(r.normal(size=(1200, 2)) * 0.2)]
    signal = spark.createDataFrame(rows, "track string, idx long, l double, r double")
    s = ch.Settings(density=0.3, ceiling_db=-12.0)
    out, state = ch.render(signal, s, -11.0, 4800, 10)
    state = state.collect()[0]
    assert state["passes"] > 1 and len(calls) == 1
    want = ch.limited(ch.gained(ch.core(signal, s, 4800), state["gain_db"]), s.ceiling_db, 4800).orderBy("idx").collect()
    got = out.orderBy("idx").collect()
    assert len(got) == len(want) == 1200
    assert max(abs(a[c] - b[c]) for a, b in zip(got, want, strict=True) for c in ("l", "r", "gain")) < 1e-9

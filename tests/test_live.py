"""Event-time streams: samples out of order, restarts, resets, silence, late rows."""

import datetime
import time
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from quaver.functions import k_weighting
from quaver.operators.blocks import Cascade
from quaver.streaming import live
from quaver.streaming.loudness import FRAME, PLAY, SEEK, _lufs

FS, SCHEMA = 4800, "track string, ts timestamp, seq long, kind string, l double, r double"
T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def samples(n=2600, tracks=("a", "b")):
    r = np.random.default_rng(4)
    return [(t, at(i), i, PLAY, float(x), float(y)) for t in tracks for i, (x, y) in enumerate(r.normal(size=(n, 2)) * 0.2)]


def run(spark, batches, frame=256, delay="300 seconds", idle_ms=None, restart=True):
    frames = [spark.createDataFrame(b, SCHEMA).repartition(2) for b in batches]
    ends = live.with_end(spark.createDataFrame([r for b in batches for r in b], SCHEMA))
    got = live.replayed(spark, [*frames, ends], lambda s: live.live_frames(s, FS, frame, 0.02, delay, idle_ms), FRAME, restart=restart).collect()
    return {t: sorted((r for r in got if r["track"] == t), key=lambda r: r["frame"]) for t in {r["track"] for r in got}}


def plain(rows, frame=256, resets=()):
    meter, cascade, out = live.ExactMeter(FS, frame, 0.02), Cascade(list(k_weighting(FS)), 1024), []
    meter.begin([])
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        if r[3] == SEEK:
            meter.reset()
            meter.begin([])
        else:
            out += meter.push(np.array([r[4]]), np.array([r[5]]), cascade, False)
    return [*out, meter.end()]


def assert_same(got, want):
    assert [(r["frame"], r["playhead"], r["idle"], r["ended"]) for r in got] == [w[:4] for w in want]
    for r, w in zip(got, want, strict=True):
        assert [r[c] for c in ("momentary", "short_term", "integrated", "true_peak_db", "correlation", "hold_db")] == pytest.approx(w[4:], abs=1e-9)


def test_samples_out_of_order_over_restarts(spark):
    rows = samples()
    batch = lambda r: min(2, (r[2] // 900) + (r[2] % 900 > 700 and r[2] % 3 == 0))  # noqa: E731  # some come a batch later, within the delay
    got = run(spark, [[r for r in rows if batch(r) == k] for k in range(3)])
    for t in "ab":
        assert_same(got[t], plain([r for r in rows if r[0] == t]))


def test_exact_readings_at_each_frame_in_little_time():
    r, hop = np.random.default_rng(5), 10
    x = r.normal(size=(120_000, 2)) * np.repeat(r.choice([1e-5, 0.01, 0.3], 120), 1000)[:, None]  # its gates move up and down
    meter, stages = live.ExactMeter(48_000, 128, hop / 48_000), list(k_weighting(48_000))
    meter.begin([])
    began, got = time.process_time(), []
    for a in range(0, len(x), 40_000):
        got += meter.push(x[a : a + 40_000, 0], x[a : a + 40_000, 1], Cascade(stages, 1024), False)
    took = time.process_time() - began
    y = [Cascade(stages, 1024).run(x[:, k], np.zeros(4))[0] for k in (0, 1)]
    e = (y[0] ** 2 + y[1] ** 2).reshape(-1, hop).mean(1)
    blocks = np.convolve(e, np.ones(4) / 4, "valid")
    assert [f[1] for f in got] == list(range(128, len(x) + 1, 128))
    for f in got[::29]:
        hops = f[1] // hop
        b = blocks[: hops // 5 * 5 - 3]
        b = b[[_lufs(v) > -70 for v in b]]
        want = (_lufs(e[hops - 4 : hops].mean()), _lufs(e[max(0, hops - 30) : hops].mean()), _lufs(b[b > b.mean() / 10].mean()) if len(b) else -70.0)
        assert f[4:7] == pytest.approx(want, abs=1e-6)
    assert took < 2  # a loop over hops that goes through all blocks at each fifth takes several seconds


class Held:
    """A state that counts the bytes that are read from it."""

    def __init__(self):
        self.items, self.moved = {}, 0

    exists = lambda self: bool(self.items)
    containsKey = lambda self, k: k in self.items
    keys = lambda self: iter(list(self.items))
    removeKey = lambda self, k: self.items.pop(k)
    clear = lambda self: self.items.clear()

    def getValue(self, k):
        self.moved += len(self.items[k][0])
        return self.items[k]

    def updateValue(self, k, v):
        self.items[k] = v

    def get(self):
        return self.items["value"] if "value" in self.items else iter(list(self.items.values()))

    def update(self, v):
        self.items["value"] = v

    def appendValue(self, v):
        self.items[len(self.items)] = v


def test_rows_that_are_not_due_are_not_touched():
    states, rows, out = {}, samples(4000, ("a",)), []
    take = lambda name, *_: states.setdefault(name, Held())
    handle = SimpleNamespace(getValueState=take, getListState=take, getMapState=take, registerTimer=lambda at: None)
    meter, now = live.LiveMeter(FS, 256, 0.02, None, 100_000_000), int(T0.timestamp() * 1000)
    meter.init(handle)
    for k in range(80):  # of 50 samples each, 2000 seconds ahead of what is due
        b = pd.DataFrame(rows[50 * k : 50 * k + 50], columns=["track", "ts", "seq", "kind", "l", "r"])
        timers = SimpleNamespace(getCurrentWatermarkInMs=lambda late=(50 * k - 2000) * 1000: now + late)
        meter.handleInputRows(("a",), iter([b.assign(ts=b["ts"].dt.tz_localize(None))]), timers)
        out += [f for frames in meter.handleExpiredTimer(("a",), timers, None) for f in frames.to_dict("records")]
    timers = SimpleNamespace(getCurrentWatermarkInMs=lambda: now + 10_000_000)
    out += [f for frames in meter.handleExpiredTimer(("a",), timers, None) for f in frames.to_dict("records")]
    assert_same(out, plain(rows)[:-1])
    assert not states["waiting"].items and states["waiting"].moved < 3 * len(rows) * live.ROW.itemsize


def test_seek_resets_the_readings(spark):
    rows = samples(1500, ("a",)) + [("a", at(799.5), 0, SEEK, 0.0, 0.0)]
    got = run(spark, [rows], restart=False)["a"]
    assert_same(got, plain(rows))
    assert got[3]["momentary"] != got[2]["momentary"] and got[-1]["playhead"] == 1500


def test_silence_gives_one_idle_frame_for_each_gap(spark):
    rows = [r for r in samples(1200) if not (r[0] == "a" and 400 <= r[2] < 700) and not (r[0] == "b" and r[2] >= 500)]
    for cut in (300, 450, 900):  # wherever the batches end
        got = run(spark, [[r for r in rows if r[2] < cut], [r for r in rows if r[2] >= cut]], frame=10_000, delay="10 seconds", idle_ms=60_000)
        assert [(r["idle"], r["ended"], r["playhead"]) for r in got["a"]] == [(True, False, 400), (False, True, 900)]
        assert [(r["idle"], r["ended"], r["playhead"]) for r in got["b"]] == [(True, False, 500), (False, True, 500)]


def test_rows_later_than_the_delay_are_dropped(spark):
    rows = samples(1500, ("a",))
    late = [r for r in rows if 100 <= r[2] < 110]
    kept = [r for r in rows if r not in late]
    got = run(spark, [[r for r in kept if r[2] < 1000], [r for r in kept if 1000 <= r[2] < 1200], late + [r for r in kept if r[2] >= 1200]])
    assert_same(got["a"], plain(kept))


def test_bursts_settle_once(spark):
    kinds, e = "user_id long, event_type string, event_id long, ts timestamp", []
    for i, s in enumerate([0, 5, 9, 30, 31, 60, 100, 105, 200]):
        e.append((1, "x", i, at(s)))
    e += [(2, "x", 50, at(8)), (None, "y", 60, at(7))]
    late = [(1, "x", 99, at(20))]
    flush = [(9, "end", -1, at(100_000))]
    batches = [[x for x in e if x[2] % 2 == 0 and x[3] < at(70)], [x for x in e if x[2] % 2 == 1 and x[3] < at(70)], [x for x in e if x[3] >= at(70)], late, flush]
    frames = [spark.createDataFrame(b, kinds) for b in batches]
    out = "user_id long, event_type string, n long, last long"
    got = live.replayed(spark, frames, lambda s: live.settled(s, ["user_id", "event_type"], "10 seconds", "70 seconds"), out, restart=True).where("last >= 0").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "x", 3, 2), (1, "x", 2, 4), (1, "x", 1, 5), (1, "x", 2, 7), (1, "x", 1, 8), (2, "x", 1, 50), (None, "y", 1, 60)], key=repr)

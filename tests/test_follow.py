"""Passes in spans against one pass over the whole track."""

import numpy as np
import pytest

from quaver.operators import chain as ch
from quaver.operators import dynamics as dyn
from quaver.operators import follow
from quaver.operators import mastering as ma

FS = 400  # short time constants, so that small tracks have many spans


def signal(spark, n=3000, tracks=("a", None), gap=()):
    r = np.random.default_rng(11)
    rows = []
    for t in tracks:
        x = r.normal(size=(n, 2)) * (0.05 + (np.arange(n) % 900 < 60))[:, None]
        for a, b in gap:
            x[a:b] = 0
        rows += [(t, 2 * i, float(a), float(b)) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "track string, idx long, l double, r double")


def columns(df, track, names):
    rows = sorted((r for r in df.collect() if r["track"] == track), key=lambda r: r["idx"])
    assert [r["i"] for r in rows] == list(range(len(rows)))
    return [np.array([r[c] for r in rows]) for c in names]


def whole(make, x):
    part = make()
    parts = [part.push(*x), part.finish()]
    return [np.concatenate([p[k] for p in parts if k < len(p)]) for k in range(len(parts[0]))]


MAKERS = {
    "compressor": (lambda: ch.Compressor(0.6, FS), ("l", "r")),
    "transients": (lambda: ch.Transients(-0.7, FS), ("l", "r")),
    "limiter": (lambda: dyn.LimiterGain(FS), ("l", "r")),
    "drums": (lambda: ma.DrumWeight(FS), ("w",)),
    "saturator": (lambda: ch.Saturator(0.4, FS), ("l", "r")),
    "width": (lambda: ma.Widener(1.4, 48000), ("l", "r")),
    "lanes": (lambda: ma.StemLanes({"bass": 2.0, "vocal": -1.5, "air": 3.0, "drums": -2.0}, 48000), ("l", "r")),
    "cut": (lambda: ma.DeHarsher(0.8, FS * 40, 64), ("l", "r", "gr")),
    "chain": (lambda: ch.Chained([ma.DeHarsher(0.8, FS * 40, 64), ch.Compressor(0.5, FS), ch.Saturator(0.3, FS)]), ("l", "r")),
}


@pytest.mark.parametrize("name", [n for n in MAKERS if n != "lanes"])
def test_spans_equal_one_pass(spark, name, monkeypatch):
    make, names = MAKERS[name]
    s, key = signal(spark), "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, verified = spark.conf.get(key), []
    monkeypatch.setattr(follow, "_states", lambda t, inner=follow._states: verified.append(inner(t)) or verified[-1])
    spark.conf.set(key, "171")
    try:
        got = follow.followed(s, make, outputs=names, span=512)
        for track in ("a", None):
            want = whole(make, [np.array([r[c] for r in sorted((r for r in s.collect() if r["track"] == track), key=lambda r: r["idx"])]) for c in "lr"])
            for a, b in zip(columns(got, track, names), want, strict=False):
                assert len(a) == len(b) == 3000 and np.abs(a - b).max() < 1e-9
        assert verified[0].groupBy("track").count().agg({"count": "min"}).first()[0] >= 3 or make().memory > 70  # several spans a track
    finally:
        spark.conf.set(key, was)


@pytest.mark.parametrize("name", ["limiter", "chain"])
def test_wrong_guesses_run_again(spark, name, monkeypatch):
    """With a warm-up that is far too short every guess is wrong; the result is the same."""
    make, names = MAKERS[name]

    def hasty():
        part = make()
        part.memory = 3.0
        return part

    rounds = []
    monkeypatch.setattr(follow, "_states", lambda t, inner=follow._states: rounds.append(1) or inner(t))
    s = signal(spark, 1200, ("a",))
    got = follow.followed(s, hasty, outputs=names, span=256)
    want = whole(make, [np.array([r[c] for r in s.orderBy("idx").collect()]) for c in "lr"])
    assert len(rounds) > 1
    for a, b in zip(columns(got, "a", names), want, strict=False):
        assert len(a) == len(b) and np.abs(a - b).max() < 1e-9


def test_silence_keeps_what_was_before(spark):
    """A long silence forgets nothing in relation, so the spans in it are settled by their neighbours."""
    make, names = MAKERS["transients"]
    s = signal(spark, 5000, ("a",), gap=((1500, 4500),))
    want = whole(make, [np.array([r[c] for r in s.orderBy("idx").collect()]) for c in "lr"])
    for a, b in zip(columns(follow.followed(s, make, outputs=names, span=512), "a", names), want, strict=True):
        assert np.abs(a - b).max() < 1e-9


def test_no_samples_and_one(spark):
    none = signal(spark, 0)
    assert follow.followed(none, MAKERS["chain"][0]).count() == 0
    one = follow.followed(signal(spark, 1), MAKERS["chain"][0])
    assert sorted(r["i"] for r in one.collect()) == [0, 0] and one.columns == ["track", "idx", "i", "l", "r"]

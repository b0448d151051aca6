"""The streamed meter against the batch operators, whatever the batches are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaver.functions import k_weighting
from quaver.operators import blocks
from quaver.operators import mastering as ma
from quaver.operators import measure as m
from quaver.streaming import loudness as lo

FS, FRAME = 4800, 256


def signal(spark, n=9000, tracks=("a", "b")):
    r = np.random.default_rng(6)
    rows = [(t, i, float(x), float(x * 0.5 + y)) for k, t in enumerate(tracks) for i, (x, y) in enumerate(r.normal(size=(n, 2)) * (0.02 + 0.2 * (np.arange(n) > 4000))[:, None])]
    return spark.createDataFrame(rows, "track string, i long, l double, r double")


def streamed(spark, rows, folder, cuts):
    """Rows through the meter in batches [cuts), each a file of its own."""
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = rows.where((F.col("seq") >= a) & (F.col("seq") < b))
        part.coalesce(1).write.mode("append").parquet(str(folder))
        import time

        time.sleep(0.05)  # files are taken in the order of their times
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return sorted(map(tuple, lo.meter_files(source, FS, FRAME).collect()))


def test_batches_do_not_matter_and_readings_are_those_of_batch(spark, tmp_path):
    s = signal(spark)
    rows = lo.played(s)
    one = streamed(spark, rows, tmp_path / "one", [0, 20_000])
    many = streamed(spark, rows, tmp_path / "many", [0, 700, 701, 3333, 8999, 20_000])
    assert len(one) == len(many) == 2 * (9000 // FRAME + 1)
    for a, b in zip(one, many, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-9)
    hops = blocks.filtered_energy(s.withColumnRenamed("i", "idx"), list(k_weighting(FS)), FS // 10)
    mean = {(r["track"], r["hop"]): r for r in m.moving_mean(hops, 4).collect()}
    expanding = {(r["track"], r["hop"]): r["lufs"] for r in ma.expanding_loudness(hops).collect()}
    for track, frame, playhead, idle, ended, momentary, short, integrated, peak, corr, hold in one:
        if ended:
            assert playhead == 9000
            continue
        assert not idle and playhead == (frame + 1) * FRAME and hold >= peak - 0.06 and 0 < corr < 1
        done = playhead // (FS // 10) - 1  # the newest hop
        if (track, done) in mean:
            assert momentary == pytest.approx(-0.691 + 10 * np.log10(mean[track, done]["m"]), abs=1e-6)
        fifth = (done + 1) // 5 * 5 - 1
        if fifth >= 4:
            assert integrated == pytest.approx(expanding[track, fifth], abs=2e-3)
    peaks = m.pyramid_base(s.withColumnRenamed("i", "idx"), FRAME).count()
    assert peaks == 2 * (9000 // FRAME + 1)


def test_controls_reset_and_idle_frames_go_on(spark, tmp_path):
    from pyspark.sql import Row

    rows, seq = [], 0
    for kind, n, level in (("play", 4000, 0.3), ("seek", 1, 0), ("idle", 600, 0), ("play", 600, 0.001), ("load", 1, 0), ("play", 512, 0.1), ("end", 1, 0)):
        rows += [Row(track="a", seq=seq + i, kind=kind, l=level * np.sin(0.7 * i).item(), r=level * np.cos(0.7 * i).item()) for i in range(n)]
        seq += n
    df = spark.createDataFrame(rows, "track string, seq long, kind string, l double, r double")
    got = streamed(spark, df, tmp_path / "in", [0, 4100, 10_000])
    got.sort(key=lambda r: (r[4], r[2] == FRAME * (r[1] + 1) and r[1] < 2 and r[2] <= 512 and r[8] > -25 and r[8] < -15, r[1]))
    frames = {(r[1], r[2]): r for r in got}
    assert frames[14, 3840][5] > -20  # loud before the seek
    idle = [r for r in got if r[3]]
    assert len(idle) == 2 and all(r[2] == 4000 and r[5] == -70.0 for r in idle)  # the meter was reset, the playhead stays
    assert idle[0][10] == idle[1][10]  # the hold is frozen while stopped
    last = [r for r in got if r[4]]
    assert len(last) == 1 and last[0][1:3] == (2, 512)  # a load begins anew


def test_loops_play_again_and_empty_streams_give_nothing(spark, tmp_path):
    s = signal(spark, 1000, ("a",))
    rows = lo.played(s, loop=(200, 500), times=3)
    assert rows.where("kind = 'play'").count() == 1600
    at = {r["seq"]: r["l"] for r in rows.where("kind = 'play'").collect()}
    want = {r["i"]: r["l"] for r in s.collect()}
    assert sorted(at) == list(range(1600)) and at[450] == want[450] and at[510] == want[210] and at[799 + 300] == want[499] and at[1100] == want[500]
    assert streamed(spark, rows.where("false"), tmp_path / "none", [0, 10]) == []

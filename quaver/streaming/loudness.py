"""A loudness meter over a stream of samples: filters, hops and frames are state that goes from batch to batch."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quaver.functions import k_weighting
from quaver.operators.blocks import Cascade
from quaver.operators.dynamics import kernel
from quaver.sources import shared_dir

FRAME = "track string, frame long, playhead long, idle boolean, ended boolean, momentary double, short_term double, integrated double, true_peak_db double, correlation double, hold_db double"
#: Samples whose sums are smoothed together.
BLOCK = 128
#: What a row of the stream is: samples to play, silence while stopped, or a control. A seek resets the meter, a load the frames as well.
PLAY, IDLE, SEEK, LOAD, END = "play", "idle", "seek", "load", "end"


def _lufs(energy: float) -> float:
    return -0.691 + 10 * math.log10(max(energy, 1e-12))


@dataclass
class Meter:
    """The meter of one track. Hops that passed the first gate are kept by level, finely enough for a thousandth of a dB, so that the state
    stays bounded however long a track plays."""

    fs: float
    frame: int = 1024
    hop_seconds: float = 0.1
    z: list[np.ndarray] = field(default_factory=list)
    hop_sum: float = 0.0
    hop_count: int = 0
    hops: int = 0
    recent: list[float] = field(default_factory=list)
    levels: dict[int, tuple[int, float]] = field(default_factory=dict)
    momentary: float = -70.0
    short: float = -70.0
    integrated: float = -70.0
    sums: list[float] = field(default_factory=lambda: [0.0, 1e-12, 1e-12])
    block: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])  # sums of the block so far
    block_count: int = 0
    last: list[list[float]] = field(default_factory=lambda: [[0.0] * 7, [0.0] * 7])
    waiting: int = 0
    peak: float = 0.0
    number: int = 0
    hold: float = -70.0
    playhead: int = 0

    def reset(self) -> None:
        """As a seek does: the meter begins anew; frames, peak hold and correlation go on."""
        self.z, self.hop_sum, self.hop_count, self.hops, self.recent, self.levels = [], 0.0, 0, 0, [], {}
        self.momentary = self.short = self.integrated = -70.0

    def _hop(self, energy: float) -> None:
        self.hops += 1
        self.recent = [*self.recent, energy][-30:]
        n = len(self.recent)
        if n >= 4:
            block = sum(self.recent[-4:]) / 4
            self.momentary, self.short = _lufs(block), _lufs(sum(self.recent) / n)
            if _lufs(block) > -70:
                at = math.floor(_lufs(block) * 1000)
                count, total = self.levels.get(at, (0, 0.0))
                self.levels[at] = (count + 1, total + block)
        if self.hops >= 4 and self.hops % 5 == 0 and self.levels:
            gate = _lufs(sum(t for _, t in self.levels.values()) / sum(c for c, _ in self.levels.values())) - 10
            above = [(c, t) for at, (c, t) in self.levels.items() if at / 1000 > gate]
            self.integrated = _lufs(sum(t for _, t in above) / sum(c for c, _ in above)) if above else -70.0

    def push(self, left: np.ndarray, right: np.ndarray, cascade: Cascade, idle: bool) -> list[tuple]:
        """Frames that are complete after these samples."""
        out, hop, share = [], round(self.fs * self.hop_seconds), 1 - math.exp(-BLOCK / (self.fs * 0.3))
        self.z = self.z or [cascade.rest(), cascade.rest()]
        at = 0
        while at < len(left):
            n = min(len(left) - at, self.frame - self.waiting)
            if not idle:
                n = min(n, hop - self.hop_count, BLOCK - self.block_count)
            x, y = left[at : at + n], right[at : at + n]
            at += n
            self.waiting += n
            if not idle:
                self.playhead += n
                a, self.z[0] = cascade.run(x, self.z[0])
                b, self.z[1] = cascade.run(y, self.z[1])
                self.hop_sum += float(a @ a + b @ b)
                self.hop_count += n
                if self.hop_count == hop:
                    self._hop(self.hop_sum / hop)
                    self.hop_sum, self.hop_count = 0.0, 0
                for k, c in enumerate((x, y)):
                    whole = np.concatenate([self.last[k], c])
                    points = [np.abs(c), *[np.abs(np.convolve(whole, kernel(q / 4), "valid")) for q in (1, 2, 3)]]
                    self.peak = max(self.peak, *(float(p.max()) for p in points))
                    self.last[k] = whole[-7:].tolist()
                self.block = [s + float(v) for s, v in zip(self.block, (x @ y, x @ x, y @ y), strict=True)]
                self.block_count += n
                if self.block_count == BLOCK:
                    self.sums = [s + share * (v - s) for s, v in zip(self.sums, self.block, strict=True)]
                    self.block, self.block_count = [0.0, 0.0, 0.0], 0
            if self.waiting == self.frame:
                out.append(self._frame(idle, False))
        return out

    def _frame(self, idle: bool, ended: bool) -> tuple:
        db = 20 * math.log10(max(self.peak, 1e-10))
        self.hold = db if db > self.hold else self.hold if idle else max(-70.0, self.hold - 0.06)
        lr, ll, rr = self.sums
        norm = math.sqrt(ll * rr)
        row = (self.number, self.playhead, idle, ended, self.momentary, self.short, self.integrated, db, lr / norm if norm > 1e-9 else 1.0, self.hold)
        self.number, self.waiting, self.peak = self.number + 1, 0, 0.0
        return row

    def end(self) -> tuple:
        """The notice that a track has ended, with the readings so far."""
        return self._frame(False, True)

    def packed(self) -> tuple:
        """The state as plain arrays."""
        at = sorted(self.levels)
        z = np.concatenate(self.z).tolist() if self.z else []
        numbers = [self.hop_sum, self.momentary, self.short, self.integrated, *self.sums, *self.block, self.peak, self.hold, *self.last[0], *self.last[1]]
        return (z, numbers, [self.hop_count, self.hops, self.waiting, self.number, self.playhead, self.block_count], self.recent, at, [self.levels[k][0] for k in at], [self.levels[k][1] for k in at])

    def unpack(self, state: tuple) -> Meter:
        z, numbers, counts, self.recent, at, seen, totals = (list(s) for s in state)
        self.z = [np.array(z[: len(z) // 2]), np.array(z[len(z) // 2 :])] if z else []
        self.hop_sum, self.momentary, self.short, self.integrated, *rest = numbers
        self.sums, self.block, self.peak, self.hold, self.last = rest[:3], rest[3:6], rest[6], rest[7], [rest[8:15], rest[15:22]]
        self.hop_count, self.hops, self.waiting, self.number, self.playhead, self.block_count = counts
        self.levels = {k: (c, t) for k, c, t in zip(at, seen, totals, strict=True)}
        return self


STATE = "z array<double>, numbers array<double>, counts array<long>, recent array<double>, levels array<long>, seen array<long>, totals array<double>"


def metered(stream: DataFrame, fs: float, frame: int = 1024, hop_seconds: float = 0.1) -> DataFrame:
    """Meter frames of a stream of (track, seq, kind, l, r): one row per sample, or per control (see PLAY and the others), in the order of seq.

    Rows of a batch are put in order; batches have to come in order, as from files of growing names. A frame is due each ``frame`` samples,
    also of silence while stopped; the row END gives a last one.
    """
    stages = list(k_weighting(fs))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cascade, meter = Cascade(stages, 1024), Meter(fs, frame, hop_seconds)
        if state.exists:
            meter.unpack(state.get)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        kinds, left, right = rows["kind"].to_numpy(object), rows["l"].to_numpy(np.float64), rows["r"].to_numpy(np.float64)
        cuts = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(kinds)]
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            kind = kinds[a] if b > a else None
            if kind in (PLAY, IDLE):
                out += meter.push(left[a:b], right[a:b], cascade, kind == IDLE)
            elif kind == SEEK:
                meter.reset()
            elif kind == LOAD:
                meter = Meter(fs, frame, hop_seconds)
            elif kind == END:
                out.append(meter.end())
        state.update(meter.packed())
        names = [c.split()[0] for c in FRAME.split(", ")]
        yield pd.DataFrame([(key[0], *r) for r in out], columns=names)

    return stream.groupBy("track").applyInPandasWithState(run, FRAME, STATE, "append", GroupStateTimeout.NoTimeout)


def meter_files(stream: DataFrame, fs: float, frame: int = 1024, hop_seconds: float = 0.1) -> DataFrame:
    """All that is there of ``stream`` through the meter, by way of files in the shared folder: the frames."""
    spark = stream.sparkSession
    own = f"{shared_dir(spark)}/quaver/meter_{uuid.uuid4().hex}"
    spark.createDataFrame([], FRAME).write.parquet(f"{own}/frames/none")
    put = lambda batch, k: batch.write.mode("overwrite").parquet(f"{own}/frames/{k}")  # noqa: E731  # a batch that runs again replaces its own
    metered(stream, fs, frame, hop_seconds).writeStream.foreachBatch(put).option("checkpointLocation", f"{own}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(FRAME).parquet(f"{own}/frames/*")


def played(signal: DataFrame, loop: tuple[int, int] | None = None, times: int = 1) -> DataFrame:
    """A signal (track, i, l, r) as rows of the stream, with a loop over samples [start, end) played ``times`` times, and the end."""
    s = signal.select("track", "i", F.col("l").cast("double").alias("l"), F.col("r").cast("double").alias("r"))
    if loop:
        start, end = loop
        span, extra = end - start, (times - 1) * (end - start)
        inside = (F.col("i") >= start) & (F.col("i") < end)
        at = F.when(inside, F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda k: F.col("i") + k * span)).otherwise(F.array(F.when(F.col("i") >= end, F.col("i") + extra).otherwise(F.col("i"))))
        s = s.withColumn("i", F.explode(at))
    last = s.groupBy("track").agg((F.max("i") + 1).alias("seq")).select("track", "seq", F.lit(END).alias("kind"), F.lit(0.0).alias("l"), F.lit(0.0).alias("r"))
    return s.select("track", F.col("i").alias("seq"), F.lit(PLAY).alias("kind"), "l", "r").unionByName(last)

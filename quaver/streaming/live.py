"""Event-time streams with state of their own: a loudness meter that puts late samples in order, and settled bursts of requests."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quaver.functions import k_weighting
from quaver.operators.blocks import Cascade
from quaver.operators.dynamics import kernel
from quaver.sources import shared_dir
from quaver.streaming.loudness import BLOCK, END, FRAME, PLAY, SEEK, Meter, _lufs

#: A row that only moves the watermark.
FLUSH = "flush"
#: The state stores that keep values, lists, maps and timers apart.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NUMBERS = "z array<double>, numbers array<double>, counts array<long>, recent array<double>, at long, idle boolean"
#: What waits, in the order in which rows of one time and seq are played, and a waiting row.
KINDS = (END, PLAY, SEEK)
ROW = np.dtype([("at", "<i8"), ("seq", "<i8"), ("kind", "<i8"), ("l", "<f8"), ("r", "<f8")])
#: Slots of time that the waiting rows of one delay lie in, rows that are gathered before they are put there, and readings that share their bars' bounds.
SLOTS, GATHERED, TOGETHER = 32, 1 << 20, 256


def gated(blocks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Loudness of the first ``counts`` (from 1) of the blocks each, of those above a tenth of their mean.

    Of neighbouring counts the bars are near each other: blocks above all of them are summed up once, and only those between are compared with each.
    """
    bars, out = np.cumsum(blocks)[counts - 1] / counts / 10, []
    for at in range(0, len(counts), TOGETHER):
        n, bar = counts[at : at + TOGETHER], bars[at : at + TOGETHER]
        some = blocks[: n.max()]
        sure = some > bar.max()
        number, total = np.cumsum(sure)[n - 1], np.cumsum(np.where(sure, some, 0.0))[n - 1]
        between = np.flatnonzero((some > bar.min()) & ~sure)
        values, until = some[between], np.searchsorted(between, n)
        for k, b, count, energy in zip(until.tolist(), bar.tolist(), number.tolist(), total.tolist(), strict=True):
            v = values[:k][values[:k] > b]
            out.append(_lufs((energy + float(v.sum())) / (count + len(v))) if count + len(v) else -70.0)
    return np.array(out)


def _pieces(values: np.ndarray, ends: np.ndarray, begun: float, join: np.ufunc = np.add) -> tuple[np.ndarray, float]:
    """``values`` (0 or more) joined up to each of ``ends``, and what is left; the first piece goes on from ``begun``."""
    parts = join.reduceat(values, np.concatenate([[0], ends[ends < len(values)]]))
    if len(ends) and ends[-1] == len(values):
        parts = np.append(parts, 0.0)
    parts[0] = join(parts[0], begun)
    return parts[:-1], float(parts[-1])


class ExactMeter(Meter):
    """The meter with the energies of all gated blocks, so that its integrated loudness is exact. What is pushed together is measured together:
    hops, blocks and frames are sums of pieces, and integrated loudness is worked out where a frame shows it."""

    def begin(self, kept: list[float] | np.ndarray) -> None:
        self.kept, self.fresh = np.array(kept, np.float64), []

    def push(self, left: np.ndarray, right: np.ndarray, cascade: Cascade, idle: bool) -> list[tuple]:
        n, hop = len(left), round(self.fs * self.hop_seconds)
        if idle or not n:
            return super().push(left, right, cascade, idle)
        ends = lambda every, begun: np.arange(every - begun, n + 1, every)
        self.z, energy, level = self.z or [cascade.rest(), cascade.rest()], 0.0, np.zeros(n)
        for k, c in enumerate((left, right)):
            y, self.z[k] = cascade.run(c, self.z[k])
            energy = energy + y * y
            whole = np.concatenate([self.last[k], c])
            for points in (c, *(np.convolve(whole, kernel(q / 4), "valid") for q in (1, 2, 3))):
                np.maximum(level, np.abs(points), out=level)
            self.last[k] = whole[-7:].tolist()
        at = ends(self.frame, self.waiting)  # where frames end
        peaks, self.peak = _pieces(level, at, self.peak, np.maximum)
        readings = self._measured(energy, hop, ends(hop, self.hop_count), (self.hop_count + at) // hop)
        smooth = self._smoothed(left, right, ends(BLOCK, self.block_count), (self.block_count + at) // BLOCK)
        out, first, waiting = [], self.playhead, self.waiting
        for end, peak, sums, read in zip(at.tolist(), peaks.tolist(), smooth, readings, strict=True):
            (self.momentary, self.short, self.integrated), rest, now = read, self.peak, (self.momentary, self.short, self.integrated)
            self.playhead, self.peak, self.sums, last = first + end, peak, sums, self.sums
            out.append(self._frame(False, False))
            (self.momentary, self.short, self.integrated), self.peak, self.sums = now, rest, last
        self.playhead, self.waiting = first + n, (waiting + n) % self.frame
        self.hop_count, self.block_count = (self.hop_count + n) % hop, (self.block_count + n) % BLOCK
        return out

    def _measured(self, energy: np.ndarray, hop: int, ends: np.ndarray, frames: np.ndarray) -> list[tuple[float, float, float]]:
        """Momentary, short-term and integrated loudness after as many new hops as ``frames`` says each; the meter has those after all."""
        sums, self.hop_sum = _pieces(energy, ends, self.hop_sum)
        all_, begun, before = np.concatenate([self.recent, sums / hop]), len(self.recent), self.hops
        seen = np.arange(1, len(all_) + 1)
        blocks, short = np.zeros(len(all_)), np.cumsum(all_[:30]) / seen[:30]
        if len(all_) >= 4:
            blocks[3:] = np.lib.stride_tricks.sliding_window_view(all_, 4).sum(1) / 4
        if len(all_) > 30:
            short = np.concatenate([short, np.lib.stride_tricks.sliding_window_view(all_, 30).sum(1)[1:] / 30])
        blocks, short, known = blocks[begun:], short[begun:], seen[begun:] >= 4
        momentary = -0.691 + 10 * np.log10(np.maximum(blocks, 1e-12))
        passed = np.flatnonzero(known & (momentary > -70))
        old = len(self.kept)
        if len(passed):
            self.fresh.append(blocks[passed])
            self.kept = np.concatenate([self.kept, blocks[passed]])
        after = np.append(frames, len(blocks))  # each frame, and the meter itself
        points = (before + after) // 5 * 5 - before  # the new hop that integrated loudness was last worked out at
        counts = old + np.searchsorted(passed, points)
        integrated, worked = np.full(len(after), self.integrated), (points > 0) & (counts > 0)
        if worked.any():
            each, where = np.unique(counts[worked], return_inverse=True)
            integrated[worked] = gated(self.kept, each)[where]
        last = lambda values, now: np.append(now, np.where(known, values, now))[after]
        out = list(zip(last(momentary, self.momentary).tolist(), last(-0.691 + 10 * np.log10(np.maximum(short, 1e-12)), self.short).tolist(), integrated.tolist(), strict=True))
        self.hops, self.recent = before + len(blocks), all_[-30:].tolist()
        self.momentary, self.short, self.integrated = out.pop()
        return out

    def _smoothed(self, x: np.ndarray, y: np.ndarray, ends: np.ndarray, frames: np.ndarray) -> list[list[float]]:
        """The smoothed sums after as many new blocks as ``frames`` says each; the meter has those after all."""
        share, each = 1 - math.exp(-BLOCK / (self.fs * 0.3)), []
        for k, products in enumerate((x * y, x * x, y * y)):
            sums, self.block[k] = _pieces(products, ends, self.block[k])
            each.append(sums.tolist())
        states = [self.sums]
        for values in zip(*each, strict=True):
            states.append([s + share * (v - s) for s, v in zip(states[-1], values, strict=True)])
        self.sums = states[-1]
        return [states[k] for k in frames.tolist()]


class LiveMeter(StatefulProcessor):
    """A track's meter. Samples wait until the watermark has passed them, so they are played in order of time however they came.

    State: numbers as a value, gated blocks as a list that only grows by what is new, waiting rows by slots of ``width`` microseconds, so that those
    which aren't due are not touched. A timer is due at the first waiting sample (or its slot); and where a track has been silent for ``idle_ms``,
    so that it gives one idle frame for each such gap.
    """

    def __init__(self, fs: float, frame: int, hop_seconds: float, idle_ms: int | None, width: int) -> None:
        self.setup, self.idle_ms, self.width = (fs, frame, hop_seconds), idle_ms, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState("numbers", NUMBERS)
        self.blocks = handle.getListState("blocks", "energies binary")
        self.waiting = handle.getMapState("waiting", "slot long", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, held = None, []
        for b in rows:
            b = b[b["kind"].isin(KINDS)]
            if b.empty:
                continue
            new = np.empty(len(b), ROW)
            new["at"] = b["ts"].astype("datetime64[us]").astype("int64")
            new["kind"] = np.searchsorted(KINDS, b["kind"].to_numpy(str))
            for c in ("seq", "l", "r"):
                new[c] = b[c]
            first = int(new["at"].min()) if first is None else min(first, int(new["at"].min()))
            held.append(new)
            if sum(map(len, held)) >= GATHERED:
                self._wait(np.concatenate(held))
                held = []
        if held:
            self._wait(np.concatenate(held))
        if first is not None:
            self.handle.registerTimer(max(first // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def _wait(self, rows: np.ndarray) -> None:
        slots, at = np.unique(rows["at"] // self.width, return_inverse=True)
        order, cuts = np.argsort(at, kind="stable"), np.cumsum(np.bincount(at, minlength=len(slots)))
        for slot, own in zip(slots.tolist(), np.split(rows[order], cuts[:-1]), strict=True):
            there = self.waiting.getValue((slot,)) if self.waiting.containsKey((slot,)) else (b"",)
            self.waiting.updateValue((slot,), (bytes(there[0]) + own.tobytes(),))

    def _due(self, now: int) -> tuple[np.ndarray, int | None]:
        """The waiting rows up to ``now`` in order, which don't wait any more, and a time that those after it don't come before."""
        due, later = [np.empty(0, ROW)], None
        for slot in sorted(k[0] for k in self.waiting.keys()):
            if slot * self.width > now:
                later = slot * self.width if later is None else later
                break
            rows = np.frombuffer(bytes(self.waiting.getValue((slot,))[0]), ROW)
            ready = rows["at"] <= now
            due.append(rows[ready])
            if ready.all():
                self.waiting.removeKey((slot,))
                continue
            later = int(rows["at"][~ready].min())
            if ready.any():
                self.waiting.updateValue((slot,), (rows[~ready].tobytes(),))
        rows = np.concatenate(due)
        return rows[np.lexsort([rows[c] for c in reversed(ROW.names)])], later

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = self._due(now)
        meter, last, idle = self._load(len(due) > 0)
        cascade, out, times = Cascade(list(k_weighting(meter.fs)), 1024), [], due["at"]
        alone = due["kind"] != KINDS.index(PLAY)
        cut = alone[1:] | alone[:-1]
        if self.idle_ms is not None:
            cut |= np.diff(times) > self.idle_ms * 1000
        starts = [0, *(np.flatnonzero(cut) + 1).tolist(), len(due)] if len(due) else []
        for a, b in zip(starts, starts[1:], strict=False):  # runs of samples without silence, and single controls
            kind, time = KINDS[due["kind"][a]], int(times[a])
            if kind in (PLAY, END) and not idle and self._silent(last, time):
                out.append(meter._frame(True, False))
            if kind == PLAY:
                out += meter.push(due["l"][a:b], due["r"][a:b], cascade, False)
                last, idle = int(times[b - 1]), False
            elif kind == SEEK:
                meter.reset()
                meter.begin([])
                self.blocks.clear()
            elif kind == END:
                out.append(meter.end())
                last, idle = None, True
        if later is None and not idle and self._silent(last, now):  # nothing before the watermark can come any more
            out.append(meter._frame(True, False))
            idle = True
        self._store(meter, last, idle)
        ahead = [later] if later is not None else [last + self.idle_ms * 1000] if self.idle_ms and not idle and last is not None else []
        for time in ahead:
            self.handle.registerTimer(max(time // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        names = [c.split()[0] for c in FRAME.split(", ")]
        yield pd.DataFrame([(key[0], *r) for r in out], columns=names)

    def _silent(self, before: int | None, after: int) -> bool:
        return self.idle_ms is not None and before is not None and after - before > self.idle_ms * 1000

    def _load(self, blocks: bool) -> tuple[ExactMeter, int | None, bool]:
        """The meter, with its gated blocks if it will get samples; the time of the last sample; whether it is idle."""
        meter, last, idle = ExactMeter(*self.setup), None, False
        if self.numbers.exists():
            z, numbers, counts, recent, last, idle = self.numbers.get()
            meter.unpack((z, numbers, counts, recent, [], [], []))
        meter.begin(np.concatenate([np.empty(0), *(np.frombuffer(bytes(r[0]), "<f8") for r in self.blocks.get())]) if blocks else [])
        return meter, last, idle

    def _store(self, meter: ExactMeter, last: int | None, idle: bool) -> None:
        z, numbers, counts, recent, *_ = meter.packed()
        self.numbers.update((z, [float(x) for x in numbers], [int(x) for x in counts], recent, last, idle))
        if meter.fresh:
            self.blocks.appendValue((np.concatenate(meter.fresh).astype("<f8").tobytes(),))

    def close(self) -> None:
        pass


def live_frames(stream: DataFrame, fs: float, frame: int = 1024, hop_seconds: float = 0.1, delay: str = "10 seconds", idle_ms: int | None = None) -> DataFrame:
    """Meter frames of a stream of (track, ts, seq, kind, l, r): one row per sample, or per control (SEEK resets the meter, END gives a last frame).

    Samples are in order of ts, then seq; those that come later than ``delay`` behind the latest are dropped. Places of samples are
    counted in the state of each track; with ``idle_ms`` a track that gives no sample for longer gets an idle frame, whether or not more samples come.
    """
    processor = LiveMeter(fs, frame, hop_seconds, idle_ms, max(1, int(pd.Timedelta(delay).total_seconds() * 1e6) // SLOTS))
    return stream.withWatermark("ts", delay).groupBy("track").transformWithStateInPandas(processor, FRAME, "Append", "EventTime")


def settled(stream: DataFrame, keys: list[str], gap: str, delay: str) -> DataFrame:
    """Of requests (ts, event_id and ``keys``) that follow each other within ``gap`` only the last acts: keys, n (requests), last (its event_id).

    A burst is out once the watermark has passed its end by ``gap``, so its requests may come in any order; those that come later than
    ``delay`` behind the latest of all are dropped, and don't wake a burst that is out.
    """
    last = F.max_by("event_id", F.struct("ts", "event_id")).alias("last")
    bursts = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), *keys)
    return bursts.agg(F.count(F.lit(1)).alias("n"), last).select(*keys, "n", "last")


def replayed(spark: SparkSession, batches: list[DataFrame], through, schema: str, files_per_batch: int | None = None, restart: bool = False) -> DataFrame:
    """What the stream ``through`` gives for ``batches``, which are written to the shared folder one after the other and read as a stream;
    with ``restart`` the stream ends after each of them and goes on from its checkpoint.

    The stream runs in a session of its own, whose state store keeps lists and timers; its rows are files of the shared folder, a folder for each
    batch, which a batch that runs again overwrites.
    """
    own = f"{shared_dir(spark)}/quaver/live_{uuid.uuid4().hex}"
    session = spark.newSession()
    for k, v in (("spark.sql.streaming.stateStore.providerClass", STORE), ("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")), ("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))):
        session.conf.set(k, v)
    source = session.readStream.schema(batches[0].schema)
    source = source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source
    session.createDataFrame([], schema).write.parquet(f"{own}/out/none")
    put = lambda batch, k: batch.write.mode("overwrite").parquet(f"{own}/out/{k}")
    for k, b in enumerate(batches):
        b.write.mode("append").parquet(f"{own}/rows")
        if restart or k == len(batches) - 1:
            frames = through(source.parquet(f"{own}/rows"))
            frames.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", f"{own}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{own}/out/*")


def with_end(samples: DataFrame) -> DataFrame:
    """What ends ``samples`` (track, ts, seq, kind, l, r): an END of each track just after the last sample of all, and a row without track
    that moves the watermark past everything."""
    latest = samples.agg(F.max("ts").alias("ts"))  # one row
    row = lambda df, track, ts, kind: df.select(track.alias("track"), ts.alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit(kind).alias("kind"), F.lit(0.0).alias("l"), F.lit(0.0).alias("r"))
    ends = samples.select("track").distinct().join(F.broadcast(latest))
    flush = row(latest.where("ts IS NOT NULL"), F.lit(None).cast(samples.schema["track"].dataType), F.col("ts") + F.expr("INTERVAL 1000 DAYS"), FLUSH)
    return row(ends, F.col("track"), F.col("ts") + F.expr("INTERVAL 1 MILLISECOND"), END).unionByName(flush)

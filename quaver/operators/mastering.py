"""Stems, width, saturation, de-harshing, the loudness solve, sections and curve matching.

Signals are (track, idx, l, r). What depends on all samples before runs in spans of a track; the rest is column work.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.functions import highpass, k_weighting, lowpass, peaking
from quaver.operators.blocks import BLOCK, Cascade, Filtering, Follower, biquad_from, blocks, hop_energies, transformed
from quaver.operators.dominance import SPAN, sums_above
from quaver.operators.dynamics import keeps
from quaver.operators.follow import followed
from quaver.operators.measure import integrated_loudness
from quaver.sources import positions, written

#: Time constants in seconds, corner frequencies in Hz, filter qualities, limits in dB.
DRUMS = {"fast": (0.0003, 0.035), "slow": (0.02, 0.3)}
WIDTH_BANDS, WIDTH_Q = (140.0, 2000.0), (0.54, 1.31)
DEHARSH = {"corner": 4500.0, "q": 0.707, "env": (0.003, 0.08), "gain": (0.004, 0.12), "grace": 8.0, "most": 6.0, "centre": 6500.0, "width": 1.1, "moved": 0.05}
MATCH_CENTRES = (31.5, 63.0, 125.0, 250.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0, 16000.0)


def width_stages(fs: float) -> list[tuple[float, ...]]:
    """Two high-passes at each corner: above the first two lies mid and high, above all four only high."""
    return [highpass(fs, f, q) for f in WIDTH_BANDS for q in WIDTH_Q]


def width_gains(width: float, bass_mono: bool = False) -> tuple[float, float, float]:
    """Gains of the side below, between and above the corners; narrowing is even, widening grows with frequency."""
    low = 0.0 if bass_mono else min(width, 1.0)
    extra = max(width - 1, 0.0)
    return (low, min(width, 1) + 0.7 * extra, min(width, 1) + 1.15 * extra)


def widen(signal: DataFrame, width: float, fs: float, bass_mono: bool = False) -> DataFrame:
    """The signal with its side scaled by band."""
    return followed(signal, lambda: Widener(width, fs, bass_mono)).drop("i")


class Widener(Filtering):
    def __init__(self, width: float, fs: float, bass_mono: bool = False) -> None:
        self.gains, stages = width_gains(width, bass_mono), width_stages(fs)
        self.splits = [Cascade(stages[:2], 1024), Cascade(stages[2:], 1024)]
        self.z = {k: c.rest() for k, c in enumerate(self.splits)}
        self.memory = sum(c.memory for c in self.splits)

    def push(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mid, side = (left + right) / 2, (left - right) / 2
        above, self.z[0] = self.splits[0].run(side, self.z[0])
        high, self.z[1] = self.splits[1].run(above, self.z[1])
        low_gain, mid_gain, high_gain = self.gains
        wide = low_gain * (side - above) + mid_gain * (above - high) + high_gain * high
        return mid + wide, mid - wide


def drum_weight(signal: DataFrame, fs: float) -> DataFrame:
    """Mean share of the signal that counts as drum hits, where the fast envelope leads the slow one: track, mean_weight."""
    return followed(signal, lambda: DrumWeight(fs), outputs=("weight",)).groupBy("track").agg(F.avg("weight").alias("mean_weight"))


class DrumWeight(Follower):
    """How much each sample counts as a drum hit."""

    names = ("fast", "slow")

    def __init__(self, fs: float) -> None:
        self.takes = [[1 - keeps(fs, t) for t in DRUMS[k]] for k in self.names]
        self.fast = self.slow = 0.0
        self.memory = fs * max(max(DRUMS[k]) for k in self.names)

    def push(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray]:
        (fa, fr), (sa, sr) = self.takes
        fast, slow, out = self.fast, self.slow, []
        for x in np.maximum(np.abs(left), np.abs(right)).tolist():
            fast += (fa if x > fast else fr) * (x - fast)
            slow += (sa if x > slow else sr) * (x - slow)
            out.append(((fast / slow if slow > 1e-6 else 1.0) - 1.1) / 1.2)
        self.fast, self.slow = fast, slow
        return (np.clip(np.array(out), 0.0, 1.0),)


def saturate(x: Column, drive: float) -> Column:
    """Biased soft clipping by a hyperbolic tangent; silence stays silent."""
    g, bias = 10 ** (drive / 2), 0.12 * drive
    return (F.tanh((x + bias) * g) - math.tanh(g * bias)) / g


def deharsh_reduction(signal: DataFrame, amount: float, fs: float, block: int = 64, corner: float = DEHARSH["corner"]) -> DataFrame:
    """Reduction in dB of the band above ``corner`` Hz, set once per block: track, gr_last, gr_max."""
    blocks = followed(signal, lambda: DeHarsher(amount, fs, block, corner), outputs=("a", "b", "gr"))
    # a last block that isn't full counts too
    return blocks.groupBy("track").agg(F.max_by("gr", "i").alias("gr_last"), F.max("gr").alias("gr_max"))


class DeHarsher(Follower):
    """Cuts around 6.5 kHz while the band above ``corner`` is loud against the whole; the cut is set anew once per block.

    Returns both channels and the reduction. A push that doesn't end with a block ends a track, or is followed by more of the same block: the state
    stays that of the last full block, with the samples since then.
    """

    names = ("z1", "z2", "high", "full", "now", "applied", "l1", "l2", "r1", "r2")

    def __init__(self, amount: float, fs: float, block: int = 64, corner: float = DEHARSH["corner"]) -> None:
        self.amount, self.fs, self.block, self.grain = amount, fs, block, block
        (self.ea, self.er), (self.ga, self.gr) = ([1 - keeps(fs, t) for t in DEHARSH[k]] for k in ("env", "gain"))
        self.split = highpass(fs, corner, DEHARSH["q"])
        self.z1 = self.z2 = self.high = self.full = self.now = self.l1 = self.l2 = self.r1 = self.r2 = 0.0
        self.applied = -1.0
        self.held = (np.zeros(0), np.zeros(0))
        self.memory = fs * (max(DEHARSH["env"]) + max(DEHARSH["gain"]))

    def _reduction(self, left: np.ndarray, right: np.ndarray) -> tuple:
        """State after a block: of the split, both envelopes, reduction."""
        mono = (left + right) / 2
        band, state = biquad_from(mono, self.split, (self.z1, self.z2))
        high, full = self.high, self.full
        for b, w in zip(np.abs(band).tolist(), np.abs(mono).tolist(), strict=True):
            high += (self.ea if b > high else self.er) * (b - high)
            full += (self.ea if w > full else self.er) * (w - full)
        over = 20 * math.log10((high + 1e-9) / (full + 1e-9)) + DEHARSH["grace"]
        goal = self.amount * min(DEHARSH["most"], max(0.0, over))
        now = max(0.0, self.now + min(1.0, (self.ga if goal > self.now else self.gr) * len(left)) * (goal - self.now))
        return *state, high, full, now

    def _one(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.z1, self.z2, self.high, self.full, self.now = self._reduction(left, right)
        if abs(self.now - self.applied) > DEHARSH["moved"]:
            self.applied = self.now
        cut = peaking(self.fs, DEHARSH["centre"], -self.applied, DEHARSH["width"])
        a, (self.l1, self.l2) = biquad_from(left, cut, (self.l1, self.l2))
        b, (self.r1, self.r2) = biquad_from(right, cut, (self.r1, self.r2))
        return a, b, np.full(len(left), self.now)

    def push(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left, right = np.concatenate([self.held[0], left]), np.concatenate([self.held[1], right])
        full = len(left) // self.block * self.block
        self.held = left[full:], right[full:]
        made = [self._one(left[i : i + self.block], right[i : i + self.block]) for i in range(0, full, self.block)]
        return tuple(np.concatenate([m[k] for m in made]) if made else np.zeros(0) for k in (0, 1, 2))

    def finish(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rest, self.held = self.held, (np.zeros(0), np.zeros(0))
        return self._one(*rest) if len(rest[0]) else (*rest, np.zeros(0))


def solve_gain(signal: DataFrame, target: float, drive: float, hop: int = 10, passes: int = 4, tolerance: float = 0.15) -> DataFrame:
    """Gain into the saturator that brings each track's output to ``target``: track, gain_db, passes, final_err.

    Blocks are stored once; each pass drives them with every track's own gain, measures them in parallel and moves the gain by 0.95 of the error, until it is
    within ``tolerance``; tracks that are done keep theirs. What goes from pass to pass is one row per track.
    """
    cascade = Cascade(list(k_weighting()), max(1, BLOCK // hop) * hop)
    stored = written(blocks(signal, cascade.size).select("track", "block", "l", "r"))
    state = stored.select("track").distinct().select("track", F.lit(0.0).alias("gain_db"), F.lit(0).cast("long").alias("passes"), F.lit(None).cast("double").alias("final_err"))
    g0, bias = 10 ** (drive / 2), 0.12 * drive
    shape = lambda x, g: (np.tanh((x * g + bias) * g0) - math.tanh(g0 * bias)) / g0  # noqa: E731  # as saturate does, for arrays
    for _ in range(passes):
        open_ = F.coalesce(F.abs("final_err") > tolerance, F.lit(True))
        moved = state.withColumn("gain_db", F.when(F.col("passes") == 0, 0.0).when(open_, F.col("gain_db") + 0.95 * F.col("final_err")).otherwise(F.col("gain_db")))
        gains = moved.select(F.col("track").alias("g_track"), F.pow(F.lit(10.0), F.col("gain_db") / 20).alias("g"))
        driven = stored.join(gains, F.col("track").eqNullSafe(F.col("g_track")))
        loud = integrated_loudness(hop_energies(driven, cascade, hop, shape)).select(F.col("track").alias("l_track"), "lufs")
        err = F.lit(target) - F.coalesce("lufs", F.lit(-70.0))
        after = moved.join(loud, F.col("track").eqNullSafe(F.col("l_track")), "left").select(
            "track", "gain_db", F.when(open_, F.col("passes") + 1).otherwise(F.col("passes")).alias("passes"), F.when(open_, err).otherwise(F.col("final_err")).alias("final_err")
        )
        state = written(after)
        if state.where(F.abs("final_err") > tolerance).isEmpty():
            break
    return state


def expanding_loudness(hops: DataFrame, stride: int = 5, span: int = SPAN) -> DataFrame:
    """Integrated loudness of all hops up to each ``stride``-th: track, hop, lufs; -70 where nothing passes the gates.

    The relative gate moves with the mean, so each step needs the sum of blocks above a bar of its own (``sums_above``). Blocks of 4
    hops in a row and running means come from spans of a track and the totals of the spans before, so no track meets in one task.
    """
    place = F.floor(F.col("hop") / span)
    later = F.when(F.col("hop") - place * span >= span - 3, place + 1)
    spread = hops.select("track", "hop", "e", F.explode(F.array_compact(F.array(place, later))).alias("span"))
    last = W.partitionBy("track", "span").orderBy("hop").rangeBetween(-3, 0)
    mean = F.when(F.count("e").over(last) == 4, F.avg("e").over(last))
    blocks = spread.withColumn("v", mean).withColumn("v", F.when(F.col("v") > 10 ** ((-70 + 0.691) / 10), F.col("v"))).where(F.col("span") == place).select("track", "span", "hop", "v")
    so_far = W.partitionBy("track", "span").orderBy("hop").rowsBetween(W.unboundedPreceding, W.currentRow)
    blocks = written(blocks.withColumns({"n": F.count("v").over(so_far), "s": F.coalesce(F.sum("v").over(so_far), F.lit(0.0))}))
    spans = blocks.groupBy("track", "span").agg(F.max("n").alias("n"), F.max("s").alias("s"))  # both grow within a span
    earlier = W.partitionBy("track").orderBy("span").rowsBetween(W.unboundedPreceding, -1)  # one row for each span
    before = spans.select("track", "span", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in "ns"])
    steps = blocks.where((F.col("hop") + 1) % stride == 0).alias("a")
    at = steps.join(before.alias("b"), F.col("a.track").eqNullSafe(F.col("b.track")) & (F.col("a.span") == F.col("b.span")))
    asks = at.select("a.track", F.col("hop").alias("at"), (F.try_divide(F.col("a.s") + F.col("b.s"), F.col("a.n") + F.col("b.n")) / 10).alias("bar"))
    got = sums_above(blocks.select("track", F.col("hop").alias("at"), "v"), asks, span)
    loud = -0.691 + 10 * F.log10(F.greatest(F.try_divide("total", "n"), F.lit(1e-12)))
    return got.select("track", F.col("at").alias("hop"), F.when(F.col("n") > 0, loud).otherwise(F.lit(-70.0)).alias("lufs"))


def novelty(bands: DataFrame, width: int) -> DataFrame:
    """How far the mean band levels of the next ``width`` columns lie from those before: label, col, v.

    ``bands``: label, col, band, level. Only columns with ``width`` on both sides.
    """
    w = W.partitionBy("label", "band").orderBy("col")
    before, after = w.rowsBetween(-width, -1), w.rowsBetween(0, width - 1)
    step = bands.withColumns({"d": F.avg("level").over(after) - F.avg("level").over(before), "n": F.count("level").over(after) + F.count("level").over(before)})
    return step.where(F.col("n") == 2 * width).groupBy("label", "col").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("v"))


def pick_peaks(curve: DataFrame, sigmas: float, gap: float) -> DataFrame:
    """Local maxima above mean + ``sigmas`` deviations: label, col, v.

    A peak nearer than ``gap`` to the last one kept takes its place if it is higher; this is greedy from the left.
    """
    w = W.partitionBy("label")
    o = w.orderBy("col")
    high = F.avg("v").over(w) + sigmas * F.stddev_pop("v").over(w)
    tops = curve.withColumns({"high": high, "a": F.lag("v").over(o), "b": F.lead("v").over(o)}).where("v > high AND v >= a AND v >= b")
    kept = F.array().cast("array<struct<col: bigint, v: double>>")

    def step(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        far = last.isNull() | (p["col"] - last["col"] >= gap)
        swap = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(p))
        return F.when(far, F.concat(acc, F.array(p))).when(p["v"] > last["v"], swap).otherwise(acc)

    # only candidates are gathered, in order, by label
    listed = tops.groupBy("label").agg(F.array_sort(F.collect_list(F.struct(F.col("col").cast("long").alias("col"), "v"))).alias("p"))
    return listed.select("label", F.inline(F.aggregate("p", kept, step)))


def bar_offset(bounds: DataFrame, first: int, beat: int, beats: int = 4) -> DataFrame:
    """The beat of the bar whose bar lines lie nearest to the boundaries (label, col): label, k, dist; ties to the first."""
    bar = beat * beats
    far = lambda k: F.pmod(F.col("col") - (first + k * beat), F.lit(bar))
    sums = bounds.groupBy("label").agg(*[F.sum(F.least(far(k), bar - far(k))).alias(f"d{k}") for k in range(beats)])
    best = F.array_min(F.array(*[F.struct(F.col(f"d{k}").alias("dist"), F.lit(k).cast("long").alias("k")) for k in range(beats)]))
    return sums.select("label", best["k"].alias("k"), best["dist"].cast("long").alias("dist"))


def bar_offset_seconds(bounds: DataFrame, beats: int = 4) -> DataFrame:
    """The same in seconds, from boundaries with their track's grid (track, sec, first_beat, beat): track, k, dist."""
    bar = F.col("beat") * beats
    far = lambda k: F.pmod(F.col("sec") - (F.col("first_beat") + k * F.col("beat")), bar)
    sums = bounds.groupBy("track").agg(*[F.sum(F.least(far(k), bar - far(k))).alias(f"d{k}") for k in range(beats)])
    best = F.array_min(F.array(*[F.struct(F.col(f"d{k}").alias("dist"), F.lit(k).cast("long").alias("k")) for k in range(beats)]))
    return sums.select("track", best["k"].alias("k"), best["dist"].alias("dist"))


def label_sections(sections: DataFrame) -> DataFrame:
    """Adds label to (track, seg, mean): by terciles of the mean LOW, MID or PEAK; a first or last one that is no PEAK is INTRO or OUTRO."""
    w = W.partitionBy("track")
    ranks = sections.withColumns({"rn": F.row_number().over(w.orderBy("mean")) - 1, "n": F.count(F.lit(1)).over(w), "first": F.min("seg").over(w), "last": F.max("seg").over(w)})
    at = lambda share: F.max(F.when(F.col("rn") == F.floor(F.col("n") * share / 3), F.col("mean"))).over(w)
    level = F.when(F.col("mean") <= F.col("t1"), "LOW").when(F.col("mean") >= F.col("t2"), "PEAK").otherwise("MID")
    named = F.when(level == "PEAK", level).when(F.col("seg") == F.col("first"), "INTRO").when(F.col("seg") == F.col("last"), "OUTRO").otherwise(level)
    return ranks.withColumns({"t1": at(1), "t2": at(2)}).select("track", "seg", "mean", named.alias("label"))


def at_centres(curve: DataFrame, keys: list[str], bands: int, centres=MATCH_CENTRES) -> DataFrame:
    """Linear interpolation in log frequency of (keys, band, level): keys, centre, level; ends are held."""
    where = [(f, *_neighbours(f, bands)) for f in centres]
    points = F.explode(F.array(*[F.struct(F.lit(f).alias("centre"), F.lit(a).alias("i0"), F.lit(b).alias("i1"), F.lit(t).alias("t")) for f, a, b, t in where])).alias("p")
    levels = curve.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("band").cast("int"), "level"))).alias("m"))  # ``bands`` entries
    level = F.element_at("m", F.col("p.i0")) * (1 - F.col("p.t")) + F.element_at("m", F.col("p.i1")) * F.col("p.t")
    return levels.select(*keys, "m", points).select(*keys, F.col("p.centre").alias("centre"), level.alias("level"))


def _neighbours(f: float, bands: int) -> tuple[int, int, float]:
    pos = math.log(f / 20) / math.log(1000) * bands - 0.5
    low = min(bands - 1, max(0, math.floor(pos)))
    return low, min(bands - 1, low + 1), min(1.0, max(0.0, pos - low))


def shape_difference(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, band, a, b) to (keys, band, level): b - a without its mean, smoothed over neighbours by 1, 2, 1; ends repeat."""
    w = W.partitionBy(*keys)
    o = w.orderBy("band")
    flat = pairs.withColumn("d", F.col("b") - F.col("a")).withColumn("d", F.col("d") - F.avg("d").over(w))
    near = lambda f: F.coalesce(f("d").over(o), F.col("d"))
    return flat.select(*keys, "band", ((near(F.lag) + 2 * F.col("d") + near(F.lead)) / 4).alias("level"))


#: A lane's filters as (kind, corner in Hz, quality).
LANES = {
    "bass": (("low", 120.0, 0.54), ("low", 120.0, 1.31)),
    "vocal": (("high", 250.0, 0.54), ("high", 250.0, 1.31), ("low", 3500.0, 0.54), ("low", 3500.0, 1.31)),
    "air": (("low", 8000.0, 0.54), ("low", 8000.0, 1.31)),
}


def lane_stages(lane: str, fs: float) -> list[tuple[float, ...]]:
    return [(lowpass if kind == "low" else highpass)(fs, f, q) for kind, f, q in LANES[lane]]


class StemLanes(Filtering):
    """Bass, vocal, air and drums raised or lowered one after the other: bass below its corner, vocal within a band of mid, air what its
    low-pass leaves out, drums where the fast envelope leads."""

    def __init__(self, gains_db: dict[str, float], fs: float) -> None:
        self.extra = {lane: 10 ** (db / 20) - 1 for lane, db in gains_db.items()}
        self.filters = {lane: Cascade(lane_stages(lane, fs), 1024) for lane in LANES if self.extra.get(lane, 0.0) != 0}
        self.z = {(lane, k): c.rest() for lane, c in self.filters.items() for k in (0, 1)}
        self.weights = DrumWeight(fs)
        self.inner = (self.weights,)
        self.memory = sum(c.memory for c in self.filters.values()) + (self.weights.memory if self.extra.get("drums", 0.0) != 0 else 0.0)

    def _through(self, lane: str, k: int, x: np.ndarray) -> np.ndarray:
        y, self.z[lane, k] = self.filters[lane].run(x, self.z[lane, k])
        return x - y if lane == "air" else y

    def push(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for lane in self.filters:
            if lane == "vocal":
                more = (self._through(lane, 0, (left + right) / 2),) * 2
            else:
                more = self._through(lane, 0, left), self._through(lane, 1, right)
            left, right = left + self.extra[lane] * more[0], right + self.extra[lane] * more[1]
        if self.extra.get("drums", 0.0) != 0:
            g = 1 + self.extra["drums"] * self.weights.push(left, right)[0]
            left, right = left * g, right * g
        return left, right


def lane_gain(signal: DataFrame, lane: str, gain_db: float, fs: float) -> DataFrame:
    """The signal with one stem lane raised."""
    return followed(signal, lambda: StemLanes({lane: gain_db}, fs)).drop("i")


def framed(placed: DataFrame, size: int, hop: int) -> DataFrame:
    """Overlapping frames of mono with a symmetric Hann window: track, col, x (array of ``size``). A last frame that isn't full is dropped.

    ``placed``: track, i, l, r. Each sample names the at most size / hop frames it lies in, so frames are built by one
    grouping with rows of a bounded length, and a long track is spread over many tasks.
    """
    first = F.greatest(F.floor((F.col("i") - size) / hop) + 1, F.lit(0))
    cols = F.explode(F.sequence(first.cast("long"), F.floor(F.col("i") / hop).cast("long"))).alias("col")
    at = (F.col("i") - F.col("col") * hop).cast("int")
    hann = 0.5 - 0.5 * F.cos(at * F.lit(2 * math.pi / (size - 1)))
    parts = placed.select("track", "i", ((F.col("l") + F.col("r")) / 2).alias("mono"), cols).select("track", "col", F.struct(at.alias("at"), (F.col("mono") * hann).alias("x")).alias("s"))
    rows = parts.groupBy("track", "col").agg(F.array_sort(F.collect_list("s")).alias("s")).where(F.size("s") == size)
    return rows.select("track", "col", F.transform("s", lambda s: s["x"]).alias("x"))


def powers(frames: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Power of each bin from 0 to size / 2 of the frames x: keys, k, power."""
    both = transformed(frames.where(F.size("x") == size), keys)
    return both.select(*keys, "k", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))

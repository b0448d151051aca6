"""The mastering chain with samples: equaliser stages in parallel blocks, dynamics in one pass over spans, gains as columns, limiter last.

Signals are (track, idx, l, r). Each stage is an operator of its own; ``master`` puts the active ones in order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.functions import energy_to_lufs, fade_gain, highpass, peaking, shelf
from quaver.operators import dynamics as dyn
from quaver.operators.blocks import Cascade, Chained, Filtering, Pieces, filtered, ordered
from quaver.operators.follow import followed
from quaver.operators.mastering import DeHarsher, StemLanes, Widener
from quaver.operators.measure import integrated_loudness, pyramid_base, short_term, weighted_hops
from quaver.sources import positions, written

#: Nominal level in LUFS, and the centres of the matching equaliser in Hz.
NOMINAL = -18.0
CENTRES = (31.5, 63.0, 125.0, 250.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0, 16000.0)
#: Up to these a stage counts as off (lane gains as factors, equaliser gains in dB).
OFF, LANE_OFF, GAIN_OFF = 0.001, 0.003, 0.05


@dataclass
class Settings:
    """What the chain is set to; the defaults leave a signal as it is but for the first high-pass and the limiter."""

    tone: float = 0.0
    shape: float = 0.0
    air: float = 0.0
    smooth: float = 0.0
    character: float = 0.0
    density: float = 0.0
    impact: float = 0.0
    width: float = 1.0
    balance_db: float = 0.0
    bass_mono: bool = False
    match: tuple[float, ...] = ()
    advanced: tuple[tuple[bool, str, float, float, float], ...] = ()  # on, type, Hz, dB, quality
    lanes_db: dict[str, float] = field(default_factory=dict)
    staging_db: float = 0.0
    output_db: float = 0.0
    reference_db: float = 0.0
    ceiling_db: float = -1.0
    fade_in: float = 0.0
    fade_out: float = 0.0
    fade_in_curve: str = "scurve"
    fade_out_curve: str = "scurve"
    bypass: bool = False
    delta: bool = False


def equaliser(s: Settings, fs: float) -> list[tuple[float, ...]]:
    """Filters of the static part: rumble, tilt around 700 Hz, contour at 450 Hz and 3 kHz, air, matching and advanced bands."""
    out = [highpass(fs, 18.0, 0.707)]
    out += [shelf(fs, 700.0, -4.5 * s.tone, 0.6, high=False), shelf(fs, 700.0, 4.5 * s.tone, 0.6)] if s.tone else []
    out += [peaking(fs, 3000.0, 4 * s.shape, 0.9), peaking(fs, 450.0, -2.5 * s.shape, 0.9)] if s.shape else []
    out += [shelf(fs, 13000.0, 6 * s.air, 0.75)] if s.air else []
    for k, (f, gain) in enumerate(zip(CENTRES, s.match, strict=False)):
        if abs(gain) >= GAIN_OFF:
            ends = {0: shelf(fs, f * 1.4, gain, 0.8, high=False), len(CENTRES) - 1: shelf(fs, f * 0.8, gain, 0.8)}
            out.append(ends.get(k) or peaking(fs, f, gain, 1.1))
    for on, kind, f, gain, q in s.advanced:
        if on and abs(gain) >= GAIN_OFF:
            out.append(peaking(fs, f, gain, q) if kind == "peak" else shelf(fs, f, gain, 0.9, high=kind == "highshelf"))
    return out


def active(s: Settings) -> dict[str, bool]:
    """Which stages do anything."""
    lanes = any(abs(10 ** (db / 20) - 1) > LANE_OFF for db in s.lanes_db.values())
    return {
        "lanes": lanes, "smooth": s.smooth > OFF, "character": s.character > OFF, "density": s.density > OFF, "impact": abs(s.impact) > OFF,
        "width": abs(s.width - 1) > OFF or s.bass_mono, "balance": abs(s.balance_db) > OFF,
    }


def switches(smooth: Column, impact: Column, width: Column, bass_mono: Column, balance_db: Column, lane_db: Column) -> dict[str, Column]:
    """``active`` for settings that are columns: whether each stage does anything."""
    return {
        "impact": F.abs(impact) > OFF, "smooth": smooth > OFF, "width": (F.abs(width - 1) > OFF) | bass_mono, "balance": F.abs(balance_db) > OFF,
        "lanes": F.abs(F.pow(F.lit(10.0), lane_db / 20) - 1) > LANE_OFF,
    }


def half_band(taps: int = 31) -> np.ndarray:
    """Even taps of a half-band low-pass with a Blackman window; they sum to one half."""
    n = np.arange(0, taps, 2)
    m = n - (taps - 1) / 2
    h = np.sin(0.5 * np.pi * m) / (np.pi * m) * (0.42 - 0.5 * np.cos(2 * np.pi * n / (taps - 1)) + 0.08 * np.cos(4 * np.pi * n / (taps - 1)))
    return h * 0.5 / h.sum()


class _Fir:
    """A short filter over pieces: keeps the last inputs."""

    def __init__(self, taps: np.ndarray) -> None:
        self.taps, self.last = taps, np.zeros(len(taps) - 1)

    def push(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return x
        x = np.concatenate([self.last, x])
        self.last = x[len(x) - len(self.last) :]
        return np.convolve(x, self.taps, "valid")


class _Double:
    """Twice the rate by the half-band filter's two phases."""

    def __init__(self) -> None:
        taps = half_band()
        self.even, self.odd = _Fir(2 * taps), _Fir(np.eye(len(taps))[7])

    def push(self, x: np.ndarray) -> np.ndarray:
        return np.stack([self.even.push(x), self.odd.push(x)], 1).ravel()


class _Halve:
    def __init__(self) -> None:
        taps = half_band()
        self.even, self.odd = _Fir(taps), _Fir(0.5 * np.eye(len(taps))[7])

    def push(self, x: np.ndarray) -> np.ndarray:
        return self.even.push(x[::2]) + self.odd.push(x[1::2])


class Saturator(Filtering):
    """Biased soft clipping at four times the rate, then a blocker of direct current at 5 Hz."""

    def __init__(self, drive: float, fs: float) -> None:
        self.g, self.bias = 10 ** (drive / 2), 0.12 * drive
        self.rates = [[_Double(), _Double(), _Halve(), _Halve()] for _ in "lr"]
        keep = math.exp(-2 * math.pi * 5 / fs)
        self.blocker = Cascade([(keep, -keep, 0.0, -keep, 0.0)], 1024)
        self.z = {k: self.blocker.rest() for k in (0, 1)}
        self.memory = self.blocker.memory + 64  # the rate changers look back at fewer than 64 samples

    @property
    def state(self) -> np.ndarray:
        return np.concatenate([super().state, *[f.last for f in self._firs()]])

    @state.setter
    def state(self, values: np.ndarray) -> None:
        n = sum(map(len, self.z.values()))
        Filtering.state.fset(self, values[:n])
        for f in self._firs():
            f.last, n = values[n : n + len(f.last)].copy(), n + len(f.last)

    def _firs(self) -> list[_Fir]:
        return [f for rates in self.rates for r in rates for f in (r.even, r.odd)]

    def push(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for k, x in enumerate((left, right)):
            up1, up2, down2, down1 = self.rates[k]
            y = up2.push(up1.push(x))
            y = (np.tanh(self.g * (y + self.bias)) - math.tanh(self.g * self.bias)) / self.g
            y, self.z[k] = self.blocker.run(down1.push(down2.push(y)), self.z[k])
            out.append(y)
        return out[0], out[1]


class Compressor(Filtering):
    """The soft-knee compressor with 0.7 of its expected reduction made up."""

    def __init__(self, density: float, fs: float) -> None:
        self.reductions, self.z = dyn.CompressorReduction(density, fs), {}
        self.inner, self.memory = (self.reductions,), self.reductions.memory
        over = max(0.0, -12 - (-16 - 8 * density))
        self.makeup = 10 ** (over * (1 - 1 / (1.2 + 0.8 * density)) * 0.7 / 20)

    def push(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = 10 ** (-self.reductions.push(left, right)[0] / 20) * self.makeup
        return left * g, right * g


class Transients(Filtering):
    def __init__(self, amount: float, fs: float) -> None:
        self.gains, self.z = dyn.TransientGain(amount, fs), {}
        self.inner, self.memory = (self.gains,), self.gains.memory

    def push(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = 10 ** (self.gains.push(left, right)[0] / 20)
        return left * g, right * g


def limited(signal: DataFrame, ceiling_db: float, fs: float, delta: bool = False) -> DataFrame:
    """The limiter's output and gain: track, idx, l, r, gain. With ``delta`` what it takes from the delayed input instead.

    True peaks, the largest of them within the look-ahead and the delay are windows over blocks; the gain itself runs in spans.
    """
    return limited_ahead(dyn.peaks_ahead(signal, fs), ceiling_db, fs, delta)


def limited_ahead(ready: DataFrame, ceiling_db: float, fs: float, delta: bool = False) -> DataFrame:
    """The same of what ``peaks_ahead`` gives."""
    ceiling = 10 ** (ceiling_db / 20)
    both = followed(dyn.needed(ready, ceiling), lambda: dyn.LimiterGain(fs), ("gain", "l", "r"), ("gain", "l", "r"))
    clipped = lambda c: F.greatest(F.lit(-ceiling), F.least(F.lit(ceiling), F.col(c) * F.col("gain")))
    return both.select("track", "idx", "i", *[(clipped(c) - F.col(c) if delta else clipped(c)).alias(c) for c in "lr"], "gain")


def dynamics(s: Settings, fs: float, block: int = 128) -> list:
    """Makers of the active stages between equaliser and gains, in order."""
    on = active(s)
    stages = {
        "lanes": lambda: StemLanes(s.lanes_db, fs), "smooth": lambda: DeHarsher(s.smooth, fs, block), "character": lambda: Saturator(s.character, fs),
        "density": lambda: Compressor(s.density, fs), "impact": lambda: Transients(s.impact, fs), "width": lambda: Widener(s.width, fs, s.bass_mono),
    }
    return [make for name, make in stages.items() if on[name]]


def gained(signal: DataFrame, db: float | Column) -> DataFrame:
    g = F.pow(F.lit(10.0), (F.lit(db) if isinstance(db, int | float) else db) / 20)
    return signal.select(*_place(signal), (F.col("l") * g).alias("l"), (F.col("r") * g).alias("r"))


def _place(signal: DataFrame) -> list[str]:
    """What says where a sample is: positions too where they are known."""
    return ["track", "idx", *(["i"] if "i" in signal.columns else [])]


def faded(signal: DataFrame, s: Settings, fs: float) -> DataFrame:
    """Fades at both ends of each track, in seconds."""
    if s.fade_in <= 0 and s.fade_out <= 0:
        return signal
    p = signal if "i" in signal.columns else positions(signal)
    counts = p.groupBy("track").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("track", "n_track")  # one row for each track
    p = p.join(counts, F.col("track").eqNullSafe(F.col("n_track"))).withColumn("left", F.col("n") - F.col("i"))
    g = F.lit(1.0)
    if s.fade_in > 0:
        g = g * F.when(F.col("i") / fs < s.fade_in, fade_gain(F.col("i") / fs / s.fade_in, s.fade_in_curve)).otherwise(1.0)
    if s.fade_out > 0:
        g = g * F.when(F.col("left") / fs < s.fade_out, fade_gain(F.col("left") / fs / s.fade_out, s.fade_out_curve)).otherwise(1.0)
    return p.select("track", "idx", "i", (F.col("l") * g).alias("l"), (F.col("r") * g).alias("r"))


def core(signal: DataFrame, s: Settings, fs: float) -> DataFrame:
    """Everything before the last gain and the limiter."""
    if s.bypass:
        return faded(gained(signal, s.staging_db + s.reference_db), s, fs)
    out = filtered(gained(signal, s.staging_db), equaliser(s, fs))
    makers = dynamics(s, fs)
    if makers:
        out = followed(out, lambda: Chained([make() for make in makers]))
    if active(s)["balance"]:
        out = out.select(*_place(out), (F.col("l") * 10 ** (-s.balance_db / 40)).alias("l"), (F.col("r") * 10 ** (s.balance_db / 40)).alias("r"))
    return faded(out, s, fs)


def master(signal: DataFrame, s: Settings, fs: float) -> DataFrame:
    """The whole chain: track, idx, l, r, gain (of the limiter)."""
    out = core(signal, s, fs)
    return limited(out if s.bypass else gained(out, s.output_db), s.ceiling_db, fs, s.delta and not s.bypass)


def render(signal: DataFrame, s: Settings, target: float, fs: float, hop: int, passes: int = 4, tolerance: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Rendered samples, and per track: gain_db, passes, lufs, err, max_gr.

    The core runs once, and so do the windows of its true peaks, as a gain multiplies them. Each pass limits it at every track's own gain and moves the gain by 0.95 of the error in
    loudness until that is within ``tolerance``; tracks that are done keep their gain. One row per track goes from pass to pass. The
    reduction is that of the last pass.
    """
    base = core(signal, s, fs)
    if s.bypass or not dynamics(s, fs):  # else its spans are written already
        base = written(base)
    ready = written(dyn.peaks_ahead(base, fs))
    track = F.col("track").eqNullSafe(F.col("s_track"))
    first = integrated_loudness(weighted_hops(base, hop)).select("track", (F.lit(target) - F.col("lufs")).alias("gain_db"))
    tracks = ready.select("track").distinct()
    state = written(
        tracks.join(first.withColumnRenamed("track", "s_track"), track, "left").select(
            "track", F.coalesce("gain_db", F.lit(target + 70)).alias("gain_db"), F.lit(0).cast("long").alias("passes"), F.lit(None).cast("double").alias("lufs"), F.lit(None).cast("double").alias("err"), F.lit(0.0).alias("max_gr")
        )
    )
    out = base
    for k in range(passes):
        open_ = F.coalesce(F.abs("err") >= tolerance, F.lit(True))
        moved = state.withColumn("gain_db", F.when(F.col("passes") == 0, F.col("gain_db")).when(open_, F.col("gain_db") + 0.95 * F.col("err")).otherwise(F.col("gain_db")))
        gains = moved.select(F.col("track").alias("s_track"), F.pow(F.lit(10.0), F.col("gain_db") / 20).alias("g"))
        driven = ready.join(gains, track).select("track", "idx", "i", *[(F.col(c) * F.col("g")).alias(c) for c in ("high", "l", "r")])
        out = limited_ahead(driven, s.ceiling_db, fs)  # its spans are written
        loud = integrated_loudness(weighted_hops(out.drop("gain"), hop)).withColumnsRenamed({"track": "s_track", "lufs": "now"})
        most = out.groupBy("track").agg((-20 * F.log10(F.greatest(F.min("gain"), F.lit(1e-6)))).alias("gr")).withColumnRenamed("track", "m_track")
        after = moved.join(loud, track, "left").join(most, F.col("track").eqNullSafe(F.col("m_track")), "left")
        now = F.coalesce("now", F.lit(-70.0))
        state = written(
            after.select("track", "gain_db", F.when(open_, F.col("passes") + 1).otherwise(F.col("passes")).alias("passes"), now.alias("lufs"), (F.lit(target) - now).alias("err"), F.coalesce("gr", F.lit(0.0)).alias("max_gr"))
        )
        if state.where(F.abs("err") >= tolerance).isEmpty():
            break
    return out, state


def calibrate(signal: DataFrame, s: Settings, source_lufs: float, fs: float, hop: int, most: float = 8.0) -> DataFrame:
    """How much loudness the chain itself adds to each track beyond the staging gain: track, delta_db, within ``most`` either way."""
    staged = Settings(**{**s.__dict__, "staging_db": NOMINAL - source_lufs, "output_db": 0.0, "fade_in": 0.0, "fade_out": 0.0, "ceiling_db": 24.0, "delta": False})
    before = integrated_loudness(weighted_hops(signal, hop)).withColumnRenamed("lufs", "raw")
    after = integrated_loudness(weighted_hops(master(signal, staged, fs).drop("gain"), hop)).withColumnsRenamed({"track": "s_track"})
    both = before.join(after, F.col("track").eqNullSafe(F.col("s_track")))
    delta = F.col("lufs") - (F.col("raw") + staged.staging_db)
    return both.select("track", F.greatest(F.lit(-most), F.least(F.lit(most), delta)).alias("delta_db"))


def preview(signal: DataFrame, s: Settings, source_lufs: float, target: float, fs: float, hop: int, per: int = 512) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A rendered preview: pyramid of ``per`` samples, short-term loudness, and the figures of the solve (3 passes, within 0.25)."""
    staged = Settings(**{**s.__dict__, "staging_db": NOMINAL - source_lufs, "output_db": 0.0, "delta": False})
    out, state = render(signal, staged, target, fs, hop, passes=3, tolerance=0.25)
    return pyramid_base(out.drop("gain"), per), short_term(weighted_hops(out.drop("gain"), hop)), state


def energies(signal: DataFrame) -> DataFrame:
    """Energy of each channel and the mean level: track, e_l, e_r, level."""
    e = signal.groupBy("track").agg(F.sum(F.col("l") * F.col("l")).alias("e_l"), F.sum(F.col("r") * F.col("r")).alias("e_r"), F.count(F.lit(1)).alias("n"))
    return e.select("track", "e_l", "e_r", energy_to_lufs((F.col("e_l") + F.col("e_r")) / F.col("n")).alias("level"))


def slewed(values: DataFrame, fs: float, block: int = 128, seconds: float = 0.015) -> DataFrame:
    """A parameter that follows its targets block by block: (track, idx, l = target) to track, idx, value; it starts at the first target and
    snaps to a target within 1e-5."""
    share = 1 - math.exp(-block / (fs * seconds))

    class Slew(Pieces):
        now: float | None = None

        def push(self, target: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            out = []
            for t in target.tolist():
                self.now = t if self.now is None or abs(t - self.now) < 1e-5 else self.now + share * (t - self.now)
                out.append(self.now)
            return np.array(out), other

    return ordered(values.select("track", "idx", "l", F.lit(0.0).alias("r")), Slew).select("track", "idx", F.col("l").alias("value"))

"""True peak, limiting, compression and transients of signals (track, idx, l, r)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from quaver.functions import highpass, lowpass
from quaver.operators.blocks import Follower, filtered, haloed
from quaver.operators.follow import followed

#: Time constants in seconds, thresholds and ranges in dB.
LOOKAHEAD, LIMIT_RELEASE = 0.0025, 0.09
TRANSIENT = {"fast": (0.0002, 0.03), "slow": (0.015, 0.3), "gain": (0.0005, 0.03)}
COMPRESSOR = {"level": 0.005, "envelope": (0.03, 0.25), "gain": (0.01, 0.15), "knee": 8.0}


def keeps(fs: float, seconds: float) -> float:
    """What a one-pole smoother keeps of its state from one sample to the next."""
    return math.exp(-1 / (fs * seconds))


def kernel(fraction: float, taps: int = 8) -> list[float]:
    """Windowed sinc that reads a signal ``fraction`` of a sample between its two middle taps; sums to 1."""
    at = np.arange(taps) - (taps / 2 - 1 + fraction)
    h = np.sinc(at) * np.maximum(0.54 + 0.46 * np.cos(np.pi * at / (taps / 2)), 0)
    return (h / h.sum()).tolist()


#: Samples that a true peak looks back at.
TAPS = 8


def true_peaks(signal: DataFrame) -> DataFrame:
    """Adds peak: the largest of both channels at a sample and at the three quarter points near it."""
    rows, w = haloed(signal, TAPS - 1)
    return rows.withColumn("peak", _peak(w)).where("NOT halo").drop("halo", "block", "i")


def _peak(w: WindowSpec) -> Column:
    between = lambda c, h: sum((F.lag(c, n, 0.0).over(w) * h[n] for n in range(1, len(h))), F.col(c) * h[0])
    points: list[Column] = [F.abs(c) for c in ("l", "r")]
    points += [F.abs(between(c, kernel(q / 4, TAPS))) for c in ("l", "r") for q in (1, 2, 3)]
    return F.greatest(*points)


def peaks_ahead(signal: DataFrame, fs: float) -> DataFrame:
    """What a limiter looks at, whatever gain comes before it: track, idx, i, the largest true peak within the look-ahead (high), and the delayed channels (l, r).

    A gain multiplies all three.
    """
    n = max(16, round(fs * LOOKAHEAD))
    rows, w = haloed(signal.select("track", "idx", *(c for c in ("i", "l", "r") if c in signal.columns)), n + TAPS)
    seen = rows.withColumn("peak", F.nanvl(_peak(w), F.lit(0.0))).withColumn("high", F.max("peak").over(w.rowsBetween(1 - n, 0)))
    late = seen.withColumns({c: F.lag(c, n, 0.0).over(w) for c in "lr"})
    return late.where("NOT halo").select("track", "idx", "i", "high", "l", "r")


def needed(ready: DataFrame, ceiling: float) -> DataFrame:
    """``peaks_ahead`` with the lowest gain that its peaks need (gain) in place of the peak."""
    need = F.when(F.col("high") > ceiling, ceiling / F.col("high")).otherwise(1.0)
    return ready.select("track", "idx", "i", need.alias("gain"), "l", "r")


def gains_needed(signal: DataFrame, ceiling: float, fs: float) -> DataFrame:
    """What a limiter looks at: track, idx, i, the lowest gain that the true peaks within the look-ahead need (gain), and the delayed channels (l, r)."""
    return needed(peaks_ahead(signal, fs), ceiling)


def limiter_stats(signal: DataFrame, ceiling_db: float, fs: float) -> DataFrame:
    """Largest gain reduction in dB and samples that still had to be clipped: track, max_gr, n_clipped.

    The gain that each true peak needs, its minimum over the lookahead and the delay are window functions; the
    smoothing of the gain runs in spans.
    """
    ceiling = 10 ** (ceiling_db / 20)
    ready = gains_needed(signal, ceiling, fs).select("track", "idx", "i", "gain", F.greatest(F.abs("l"), F.abs("r")).alias("late"))
    gains = followed(ready, lambda: LimiterGain(fs), ("gain", "late"), ("gain", "late"))
    reduction = -20 * F.log10(F.greatest(F.min("gain"), F.lit(1e-6)))
    return gains.groupBy("track").agg(reduction.alias("max_gr"), F.count_if(F.col("late") * F.col("gain") > ceiling).alias("n_clipped"))


class LimiterGain(Follower):
    """The limiter's gain: falls fast to the lowest gain needed, comes back slowly. Other columns pass."""

    names = ("gain",)

    def __init__(self, fs: float) -> None:
        self.attack, self.release, self.gain, self.memory = keeps(fs, LOOKAHEAD / 4), keeps(fs, LIMIT_RELEASE), 1.0, fs * LIMIT_RELEASE

    def push(self, lowest: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
        gain, attack, release, out = self.gain, self.attack, self.release, []
        for low in lowest.tolist():
            gain = low + (attack if low < gain else release) * (gain - low)
            out.append(gain)
        self.gain = gain
        return np.array(out), *others


def transient_gain(signal: DataFrame, amount: float, fs: float) -> DataFrame:
    """Gain in dB that follows attacks, where a fast envelope is above a slow one: track, g_last, g_max."""
    gains = followed(signal, lambda: TransientGain(amount, fs), outputs=("gain",))
    return gains.groupBy("track").agg(F.max_by("gain", "i").alias("g_last"), F.greatest(F.max("gain"), F.lit(0.0)).alias("g_max"))


class TransientGain(Follower):
    """The gain in dB at each sample."""

    names = ("fast", "slow", "gain")

    def __init__(self, amount: float, fs: float) -> None:
        self.amount, self.takes = amount, [[1 - keeps(fs, t) for t in TRANSIENT[k]] for k in self.names]
        self.fast = self.slow = self.gain = 0.0
        self.memory = fs * sum(max(TRANSIENT[k]) for k in self.names)

    def push(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray]:
        (fa, fr), (sa, sr), (ga, gr) = self.takes
        fast, slow, gain, amount, out = self.fast, self.slow, self.gain, self.amount, []
        for x in np.maximum(np.abs(left), np.abs(right)).tolist():
            fast += (fa if x > fast else fr) * (x - fast)
            slow += (sa if x > slow else sr) * (x - slow)
            goal = amount * 0.6 * min(10.0, max(0.0, 20 * math.log10((fast + 1e-9) / (slow + 1e-9))))
            gain += (ga if abs(goal) > abs(gain) else gr) * (goal - gain)
            out.append(gain)
        self.fast, self.slow, self.gain = fast, slow, gain
        return (np.array(out),)


def compressor_reduction(signal: DataFrame, density: float, fs: float) -> DataFrame:
    """Smoothed gain reduction in dB of a soft-knee compressor: track, gr_last, gr_max."""
    reductions = followed(signal, lambda: CompressorReduction(density, fs), outputs=("gr",))
    return reductions.groupBy("track").agg(F.max_by("gr", "i").alias("gr_last"), F.greatest(F.max("gr"), F.lit(0.0)).alias("gr_max"))


class CompressorReduction(Follower):
    """The smoothed reduction in dB at each sample."""

    names = ("level", "env", "reduction")

    def __init__(self, density: float, fs: float) -> None:
        self.threshold, self.slope = -16 - 8 * density, 1 - 1 / (1.2 + 0.8 * density)
        self.take, self.envelope, self.gain = 1 - keeps(fs, COMPRESSOR["level"]), [keeps(fs, t) for t in COMPRESSOR["envelope"]], [keeps(fs, t) for t in COMPRESSOR["gain"]]
        self.level, self.env, self.reduction = 0.0, -80.0, 0.0
        self.memory = fs * (COMPRESSOR["level"] + max(COMPRESSOR["envelope"]) + max(COMPRESSOR["gain"]))

    def push(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray]:
        (ea, er), (ga, gr), take, slope, knee = self.envelope, self.gain, self.take, self.slope, COMPRESSOR["knee"]
        level, env, reduction, out = self.level, self.env, self.reduction, []
        for power in (0.5 * (left * left + right * right)).tolist():
            level += take * (power - level)
            db = 10 * math.log10(level + 1e-12)
            env = db + (ea if db > env else er) * (env - db)
            over = env - self.threshold
            above = min(max(over + knee / 2, 0.0), knee)  # the part inside of the knee
            goal = slope * (above * above / (2 * knee) + max(0.0, over - knee / 2))
            reduction = goal + (ga if goal > reduction else gr) * (reduction - goal)
            out.append(reduction)
        self.level, self.env, self.reduction = level, env, reduction
        return (np.array(out),)


def bass_and_treble(signal: DataFrame, fs: float, bass: float = 140.0, treble: float = 4500.0) -> DataFrame:
    """Side against mid below ``bass`` and the share of mid above ``treble``: track, side_bass_db, harsh_db; -60 without mid."""
    ms = signal.select("track", "idx", ((F.col("l") + F.col("r")) / 2).alias("l"), ((F.col("l") - F.col("r")) / 2).alias("r"))
    energy = lambda df, a, b: df.groupBy("track").agg(F.sum(F.col("l") * F.col("l")).alias(a), F.sum(F.col("r") * F.col("r")).alias(b))
    ratio = lambda a, b: F.when(F.col(b) > 0, 10 * F.log10((F.col(a) + 1e-12) / (F.col(b) + 1e-12))).otherwise(-60.0)
    low = energy(filtered(ms, [lowpass(fs, bass, 0.707)]), "low_mid", "low_side")
    high = energy(filtered(ms, [highpass(fs, treble, 0.707)]), "high_mid", "high_side")
    both = low.join(high, "track").join(energy(ms, "mid", "side"), "track")
    return both.select("track", ratio("low_side", "low_mid").alias("side_bass_db"), ratio("high_mid", "mid").alias("harsh_db"))

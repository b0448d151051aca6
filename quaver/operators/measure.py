"""Loudness, peaks, balance, correlation and pyramids of signals (track, idx, l, r)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.functions import energy_to_lufs, k_weighting, linear_to_db
from quaver.operators.blocks import Pieces, biquad, biquad_from, filtered_energy, ordered, stretches  # noqa: F401
from quaver.sources import positions


def filtered(signal: DataFrame, stages: list[tuple[float, ...]]) -> DataFrame:
    """Both channels through a cascade of filters, track by track and equal to the recursion to the last bit: sorted rows in batches, with
    only the filters' state between them. ``blocks.filtered`` is parallel within a track, and equal but for rounding."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = (), {}
        for pdf in batches:
            out = {c: pdf[c].to_numpy(np.float64, copy=True) for c in ("l", "r")}
            for track, a, b in stretches(pdf):
                if at != (track,):
                    at, state = (track,), {(c, k): (0.0, 0.0) for c in out for k in range(len(stages))}
                for c, x in out.items():
                    for k, s in enumerate(stages):
                        x[a:b], state[c, k] = biquad_from(x[a:b], s, state[c, k])
            yield pdf.assign(**out)

    rows = signal.select("track", "idx", "l", "r")
    return rows.repartition("track").sortWithinPartitions("track", F.col("idx").asc_nulls_last()).mapInPandas(run, rows.schema)


def hop_energy(signal: DataFrame, hop: int = 10) -> DataFrame:
    """Mean energy per hop: track, hop, e. A last hop that isn't full is dropped."""
    h = positions(signal).withColumn("hop", F.floor(F.col("i") / hop))
    return h.groupBy("track", "hop").agg((F.sum(F.col("l") * F.col("l") + F.col("r") * F.col("r")) / hop).alias("e"), F.count(F.lit(1)).alias("n")).where(F.col("n") == hop).drop("n")


def weighted_hops(signal: DataFrame, hop: int = 10) -> DataFrame:
    return filtered_energy(signal, list(k_weighting()), hop)


def moving_mean(hops: DataFrame, n: int, partial: bool = False) -> DataFrame:
    """Mean of the last n hops: track, hop, m; with fewer only if ``partial``."""
    w = W.partitionBy("track").orderBy("hop").rowsBetween(1 - n, 0)
    out = hops.withColumns({"m": F.avg("e").over(w), "seen": F.count("e").over(w)})
    return (out if partial else out.where(F.col("seen") == n)).select("track", "hop", "m")


def integrated_loudness(hops: DataFrame) -> DataFrame:
    """Two-stage gated mean of 4-hop blocks: track, lufs; -70 where nothing passes. Gates are windows over the same blocks, so hops are read once."""
    w = W.partitionBy("track")
    m = F.when(F.count("e").over(w.orderBy("hop").rowsBetween(-3, 0)) == 4, F.avg("e").over(w.orderBy("hop").rowsBetween(-3, 0)))
    blocks = hops.withColumn("m", m).withColumn("m", F.when(energy_to_lufs(F.col("m")) > -70, F.col("m")))
    gated = blocks.withColumn("gate", energy_to_lufs(F.avg("m").over(w)) - 10)
    loud = F.avg(F.when(energy_to_lufs(F.col("m")) > F.col("gate"), F.col("m")))
    return gated.groupBy("track").agg(F.coalesce(F.when(loud.isNotNull(), energy_to_lufs(loud)), F.lit(-70.0)).alias("lufs"))


def short_term(hops: DataFrame, stride: int = 5) -> DataFrame:
    """30-hop loudness each ``stride`` hops: track, p, st."""
    return moving_mean(hops, 30, partial=True).where((F.col("hop") + 1) % stride == 0).select("track", F.floor(F.col("hop") / stride).alias("p"), energy_to_lufs(F.col("m")).alias("st"))


def nearest_rank(values: DataFrame, share: float, name: str) -> DataFrame:
    """The value at 0-based rank floor(n * share) of each track's v."""
    w = W.partitionBy("track")
    ranked = values.withColumns({"rn": F.row_number().over(w.orderBy("v")) - 1, "n": F.count("v").over(w)})
    return ranked.where(F.col("rn") == F.least(F.floor(F.col("n") * share), F.col("n") - 1)).select("track", F.col("v").alias(name))


def loudness_range(hops: DataFrame) -> DataFrame:
    """p95 - p10 of gated short-term values: track, lra; 0 with fewer than two. Gate and ranks are windows over one pass of the hops."""
    w = W.partitionBy("track")
    last = w.orderBy("hop").rowsBetween(-29, 0)
    v = hops.withColumn("m", F.when(F.count("e").over(last) == 30, F.avg("e").over(last))).withColumn("m", F.when(energy_to_lufs(F.col("m")) > -70, F.col("m")))
    gate = energy_to_lufs(F.avg("m").over(w)) - 20
    kept = v.withColumn("gate", gate).withColumn("v", F.when(energy_to_lufs(F.col("m")) > F.col("gate"), energy_to_lufs(F.col("m"))))
    ranked = kept.withColumns({"rn": F.row_number().over(w.orderBy(F.col("v").asc_nulls_last())) - 1, "n": F.count("v").over(w)})
    at = lambda share: F.max(F.when(F.col("rn") == F.least(F.floor(F.col("n") * share), F.col("n") - 1), F.col("v")))
    range_ = F.when(F.max("n") >= 2, at(0.95) - at(0.10))
    return ranked.groupBy("track").agg(F.coalesce(range_, F.lit(0.0)).alias("lra"))


def sample_peak(signal: DataFrame) -> DataFrame:
    return signal.groupBy("track").agg(linear_to_db(F.max(F.greatest(F.abs("l"), F.abs("r")))).alias("peak_db"))


def balance_offset(signal: DataFrame) -> DataFrame:
    """10 log10 of the energy of r over l; 0 if either is silent."""
    e = signal.groupBy("track").agg(F.sum(F.col("l") * F.col("l")).alias("a"), F.sum(F.col("r") * F.col("r")).alias("b"))
    return e.select("track", F.when((F.col("a") > 0) & (F.col("b") > 0), 10 * F.log10(F.col("b") / F.col("a"))).otherwise(F.lit(0.0)).alias("bal_db"))


def side_mid_ratio(signal: DataFrame) -> DataFrame:
    m, s = (F.col("l") + F.col("r")) / 2, (F.col("l") - F.col("r")) / 2
    e = signal.groupBy("track").agg(F.sum(m * m).alias("m"), F.sum(s * s).alias("s"))
    return e.select("track", F.when(F.col("m") > 0, 10 * F.log10((F.col("s") + 1e-12) / (F.col("m") + 1e-12))).otherwise(F.lit(-40.0)).alias("ratio_db"))


def window_correlation(signal: DataFrame, window: int = 50, least_energy: float = 1e-6) -> DataFrame:
    """Uncentred correlation per full window: track, w, corr, energy."""
    g = positions(signal).groupBy("track", F.floor(F.col("i") / window).alias("w")).agg(
        F.sum(F.col("l") * F.col("r")).alias("lr"), F.sum(F.col("l") * F.col("l")).alias("ll"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.count(F.lit(1)).alias("n")
    )
    g = g.where((F.col("n") == window) & (F.col("ll") + F.col("rr") > least_energy))
    return g.select("track", "w", F.try_divide("lr", F.sqrt(F.col("ll") * F.col("rr"))).alias("corr"), (F.col("ll") + F.col("rr")).alias("energy"))


def correlation_summary(windows: DataFrame) -> DataFrame:
    """Energy-weighted mean and 5th percentile."""
    mean = windows.groupBy("track").agg((F.sum(F.col("corr") * F.col("energy")) / F.sum("energy")).alias("corr_mean"))
    return mean.join(nearest_rank(windows.select("track", F.col("corr").alias("v")), 0.05, "corr_worst"), "track")


def pyramid_base(signal: DataFrame, per: int = 8) -> DataFrame:
    """Per bucket of the mono signal: least (at most 0), greatest (at least 0), rms. The last part bucket stays."""
    mono = (F.col("l") + F.col("r")) / 2
    placed = signal if "i" in signal.columns else positions(signal)
    return placed.groupBy("track", F.floor(F.col("i") / per).alias("bucket")).agg(
        F.least(F.lit(0.0), F.min(mono)).alias("mn"), F.greatest(F.lit(0.0), F.max(mono)).alias("mx"), F.sqrt(F.avg(mono * mono)).alias("rms")
    )


def pyramid(signal: DataFrame, per: int = 8, factor: int = 8, levels: int = 3) -> DataFrame:
    """Levels 0 to levels - 1, each from the one below: track, level, bucket, mn, mx, rms."""
    level = pyramid_base(signal, per)
    out = level.select("track", F.lit(0).alias("level"), "bucket", "mn", "mx", "rms")
    for k in range(1, levels):
        level = level.groupBy("track", F.floor(F.col("bucket") / factor).alias("bucket")).agg(F.min("mn").alias("mn"), F.max("mx").alias("mx"), F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("rms"))
        out = out.unionByName(level.select("track", F.lit(k).alias("level"), "bucket", "mn", "mx", "rms"))
    return out


def pyramid_until(signal: DataFrame, per: int = 128, factor: int = 8, most: int = 2048) -> DataFrame:
    """A pyramid whose levels go on, ``factor`` to one, for each track until it has at most ``most`` buckets: track, level, bucket, mn, mx, rms.

    The number of levels follows from the longest track, whose length is the only thing that the driver gets.
    """
    level = pyramid_base(signal, per).withColumn("level", F.lit(0))
    out, longest = level, (level.agg(F.max("bucket")).first()[0] or 0) + 1
    while longest > most:
        tall = level.withColumn("last", F.max("bucket").over(W.partitionBy("track"))).where(F.col("last") >= most)
        k = F.col("level") + 1
        level = tall.groupBy("track", k.alias("level"), F.floor(F.col("bucket") / factor).alias("bucket")).agg(F.min("mn").alias("mn"), F.max("mx").alias("mx"), F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("rms"))
        out, longest = out.unionByName(level), -(-longest // factor)
    return out


def smoothed_correlation(signal: DataFrame, block: int = 128, fs: float = 48_000, seconds: float = 0.3) -> DataFrame:
    """Correlation from sums over blocks, each smoothed exponentially: track, block, corr; 1 while there is no signal."""
    share = 1 - math.exp(-block / (fs * seconds))
    sums = positions(signal).groupBy("track", F.floor(F.col("i") / block).alias("idx")).agg(*[F.sum(F.col(a) * F.col(b)).alias(n) for a, b, n in (("l", "r", "lr"), ("l", "l", "ll"), ("r", "r", "rr"))])

    class Smooth(Pieces):
        def __init__(self) -> None:
            self.now = [0.0, 1e-12, 1e-12]

        def push(self, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
            out = [np.empty(len(s)) for s in sums]
            for k, s in enumerate(sums):
                now = self.now[k]
                for i, x in enumerate(s.tolist()):
                    now += share * (x - now)
                    out[k][i] = now
                self.now[k] = now
            return tuple(out)

    s = ordered(sums, Smooth, ("lr", "ll", "rr"))
    norm = F.sqrt(F.col("ll") * F.col("rr"))
    return s.select("track", F.col("idx").alias("block"), F.when(norm > 1e-9, F.col("lr") / norm).otherwise(1.0).alias("corr"))


def held_peaks(frames: DataFrame, fall: float = 0.06, least: float = -70.0) -> DataFrame:
    """Peak hold over frames (track, idx, db, playing): a higher peak takes its place at once, else it falls by ``fall`` while playing: track, idx, hold."""

    class Hold(Pieces):
        now = least

        def push(self, db: np.ndarray, playing: np.ndarray) -> tuple[np.ndarray, ...]:
            out = []
            for x, on in zip(db.tolist(), playing.tolist(), strict=True):
                self.now = x if x > self.now else max(least, self.now - fall) if on else self.now
                out.append(self.now)
            return np.array(out), playing

    return ordered(frames, Hold, ("db", "playing")).select("track", "idx", F.col("db").alias("hold"))


def display_bands(spectra: DataFrame, bands: int = 56, fs: float = 48_000, attack: float = 0.5, decay: float = 0.12) -> DataFrame:
    """Peak of each logarithmic band of spectra (label, vec_id, embedding), smoothed from one to the next: label, band, col, v."""

    def peak(b: int) -> Column:
        lo = F.floor(20 * 1000 ** (b / bands) / (fs / 2) * F.size("embedding"))
        hi = F.least(F.size("embedding"), F.greatest(lo + 1, F.ceil(20 * 1000 ** ((b + 1) / bands) / (fs / 2) * F.size("embedding"))))
        part = F.slice("embedding", (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
        return F.struct(F.lit(b).cast("long").alias("band"), F.greatest(F.lit(0.0), F.coalesce(F.array_max(part).cast("double"), F.lit(0.0))).alias("peak"))

    p = spectra.select("label", "vec_id", F.inline(F.array(*[peak(b) for b in range(bands)])))

    class Ballistics(Pieces):
        now = 0.0

        def push(self, peaks: np.ndarray) -> tuple[np.ndarray, ...]:
            out = []
            for x in peaks.tolist():
                self.now += (x - self.now) * (attack if x > self.now else decay)
                out.append(self.now)
            return (np.array(out),)

    s = ordered(p.select(F.concat_ws("-", "label", "band").alias("track"), F.col("vec_id").alias("idx"), F.col("peak").alias("v")), Ballistics, ("v",))
    at = F.split("track", "-(?=[0-9]+$)")
    col = F.row_number().over(W.partitionBy("track").orderBy("idx")).cast("long") - 1
    return s.select(at[0].cast(spectra.schema["label"].dataType).alias("label"), at[1].cast("long").alias("band"), col.alias("col"), "v")

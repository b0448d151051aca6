"""Scalar expressions of the engine (column functions) and filter design."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def r4(c: Column) -> Column:
    """Four decimals without a negative zero."""
    return F.round(c, 4) + F.lit(0.0)


def gain_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def linear_to_db(x: Column) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(1e-10)))


def energy_to_lufs(e: Column) -> Column:
    return -0.691 + 10 * F.log10(F.greatest(e, F.lit(1e-12)))


def fade_gain(t: Column, curve: str) -> Column:
    """Gain at 0 <= t <= 1 of a fade: linear, scurve, exponential or equal power."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return {"linear": t, "scurve": t * t * (3 - 2 * t), "exp": t * t * t, "power": F.sqrt(t)}[curve]


def half_up(x: Column) -> Column:
    """Round half towards plus infinity."""
    return F.floor(x + 0.5)


def highpass(fs: float, f0: float, q: float) -> tuple[float, ...]:
    """Cookbook second-order high-pass: b0, b1, b2, a1, a2."""
    w = 2 * math.pi * f0 / fs
    alpha, c = math.sin(w) / (2 * q), math.cos(w)
    a0 = 1 + alpha
    return ((1 + c) / 2 / a0, -(1 + c) / a0, (1 + c) / 2 / a0, -2 * c / a0, (1 - alpha) / a0)


def lowpass(fs: float, f0: float, q: float) -> tuple[float, ...]:
    w = 2 * math.pi * f0 / fs
    alpha, c = math.sin(w) / (2 * q), math.cos(w)
    a0 = 1 + alpha
    return ((1 - c) / 2 / a0, (1 - c) / a0, (1 - c) / 2 / a0, -2 * c / a0, (1 - alpha) / a0)


def peaking(fs: float, f0: float, gain_db: float, q: float) -> tuple[float, ...]:
    a, w = 10 ** (gain_db / 40), 2 * math.pi * f0 / fs
    alpha, c = math.sin(w) / (2 * q), math.cos(w)
    a0 = 1 + alpha / a
    return ((1 + alpha * a) / a0, -2 * c / a0, (1 - alpha * a) / a0, -2 * c / a0, (1 - alpha / a) / a0)


def shelf(fs: float, f0: float, gain_db: float, slope: float = 0.9, high: bool = True) -> tuple[float, ...]:
    a, w = 10 ** (gain_db / 40), 2 * math.pi * f0 / fs
    c, sign = math.cos(w), 1 if high else -1
    root = 2 * math.sqrt(a) * math.sin(w) / 2 * math.sqrt((a + 1 / a) * (1 / slope - 1) + 2)
    up, down = (a + 1), (a - 1)
    a0 = up - sign * down * c + root
    return (
        a * (up + sign * down * c + root) / a0, -sign * 2 * a * (down + sign * up * c) / a0, a * (up + sign * down * c - root) / a0,
        sign * 2 * (down - sign * up * c) / a0, (up - sign * down * c - root) / a0,
    )


def k_weighting(fs: float = 48_000) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The loudness pre-filter: a high shelf, then a high-pass."""
    return shelf(fs, 1681.974450955533, 3.999843853973347, 1.0), highpass(fs, 38.13547087602444, 0.5003270373238773)

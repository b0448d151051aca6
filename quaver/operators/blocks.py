"""Signals in blocks: linear filters in parallel over blocks, and ordered passes that keep only their state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.sources import positions

#: Samples of a block: one row of the block table. A track is spread over as many tasks as it has blocks.
BLOCK = 4096


def biquad(x: np.ndarray, coefficients: tuple[float, ...]) -> np.ndarray:
    """Second-order filter in transposed direct form II; sequential by nature."""
    return biquad_from(x, coefficients, (0.0, 0.0))[0]


def biquad_from(x: np.ndarray, coefficients: tuple[float, ...], state: tuple[float, float]) -> tuple[np.ndarray, tuple[float, float]]:
    """The same from the state that the samples before have left; also the state after."""
    b0, b1, b2, a1, a2 = coefficients
    z1, z2 = state
    out = np.empty(len(x))
    for i, v in enumerate(x.tolist()):
        y = b0 * v + z1
        z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
        out[i] = y
    return out, (z1, z2)


class Cascade:
    """Second-order filters one after the other, as one linear system.

    A block's output is what it gives from rest (a convolution with the impulse response) plus what the state at its start
    still gives; the state at its end is likewise a sum of both. So blocks can be filtered apart, and their states joined later.
    """

    def __init__(self, stages: list[tuple[float, ...]], size: int = BLOCK) -> None:
        self.size, n = size, 2 * len(stages)
        a, b, c, d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0  # state' = a state + b x, y = c state + d x
        for k, (b0, b1, b2, a1, a2) in enumerate(stages):
            i = 2 * k  # the stage's input is y so far: c state + d x
            out_c, out_d = b0 * c, b0 * d
            out_c[i] += 1
            a[i] = b1 * c - a1 * out_c
            a[i, i + 1] += 1
            a[i + 1] = b2 * c - a2 * out_c
            b[i], b[i + 1] = b1 * d - a1 * out_d, b2 * d - a2 * out_d
            c, d = out_c, out_d
        self.turn = np.linalg.matrix_power(a, size)
        self.left = np.empty((size, n))  # what a state at the start adds to each output
        self.kept = np.empty((size, n))  # what each input leaves in the state at the end, the last one first
        row, col = c.copy(), b.copy()
        for k in range(size):
            self.left[k], self.kept[k] = row, col
            row, col = row @ a, a @ col
        self.response = np.concatenate([[d], self.left[:-1] @ b])
        self.step, self.n = a, n
        #: Samples in which the slowest state forgets all but a share 1/e.
        self.memory = float(-1 / np.log(min(max(np.abs(np.linalg.eigvals(a)).max(initial=0.0), 1e-300), 1 - 1e-9)))

    def rest(self) -> np.ndarray:
        return np.zeros(self.n)

    def end_from_rest(self, x: np.ndarray) -> np.ndarray:
        """The state after the inputs ``x`` (at most a block of them), from rest."""
        return self.kept[: len(x)][::-1].T @ x

    def end(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        turn = self.turn if len(x) == self.size else np.linalg.matrix_power(self.step, len(x))
        return self.end_from_rest(x) + turn @ state

    def output(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        n = len(x)
        if n <= 64:
            y = np.convolve(x, self.response[:n])[:n]
        else:
            m = 1 << (2 * n - 1).bit_length()
            y = np.fft.irfft(np.fft.rfft(x, m) * np.fft.rfft(self.response[:n], m), m)[:n]
        return y + self.left[:n] @ state

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and end state for inputs of any number."""
        parts = []
        for at in range(0, len(x), self.size):
            part = x[at : at + self.size]
            parts.append(self.output(part, state))
            state = self.end(part, state)
        return np.concatenate(parts) if parts else np.zeros(0), state


def blocks(signal: DataFrame, size: int = BLOCK) -> DataFrame:
    """The samples of each block in order: track, block, idx, l, r (arrays). Positions i that the signal has already are taken as they are."""
    placed = signal if "i" in signal.columns else positions(signal)
    at = F.struct("i", "idx", F.col("l").cast("double").alias("l"), F.col("r").cast("double").alias("r"))
    rows = placed.groupBy("track", F.floor(F.col("i") / size).alias("block")).agg(F.array_sort(F.collect_list(at)).alias("s"))  # at most ``size``
    return rows.select("track", "block", *[F.col(f"s.{c}").alias(c) for c in ("idx", "l", "r")])


def haloed(signal: DataFrame, reach: int, size: int = BLOCK) -> tuple[DataFrame, WindowSpec]:
    """A signal for windows that look back at most ``reach`` samples, and their order: blocks with the last samples of the block before.

    Adds block and halo; rows of the halo are there for others to look back at and have to be dropped afterwards. So a track is not
    sorted in one task. Positions i that the signal has already are taken as they are.
    """
    placed = signal if "i" in signal.columns else positions(signal)
    size = max(size, reach)
    own = F.floor(F.col("i") / size)
    later = F.when(F.col("i") - own * size >= size - reach, own + 1)
    rows = placed.withColumn("block", F.explode(F.array_compact(F.array(own, later)))).withColumn("halo", F.col("block") > F.floor(F.col("i") / size))
    return rows, W.partitionBy("track", "block").orderBy("i")


def with_states(rows: DataFrame, cascade: Cascade) -> DataFrame:
    """Adds zl and zr, the filter's state at the start of each block: the block ends from rest, put together along each track.

    Only those ends meet by track: some ten numbers for each block.
    """
    kept = rows.schema["track"].dataType.simpleString()

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"track": b["track"], "block": b["block"], "el": [cascade.end_from_rest(x) for x in b["l"]], "er": [cascade.end_from_rest(x) for x in b["r"]]})

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, z = (), []
        for b in batches:
            out: tuple[list, list] = ([], [])
            for track, lo, hi in stretches(b):
                if at != (track,):
                    at, z = (track,), [cascade.rest(), cascade.rest()]
                for k, col in enumerate(("el", "er")):
                    for e in b[col].iloc[lo:hi]:
                        out[k].append(z[k])
                        z[k] = e + cascade.turn @ z[k]
            yield pd.DataFrame({"track": b["track"], "block": b["block"], "zl": out[0], "zr": out[1]})

    from_rest = rows.select("track", "block", "l", "r").mapInPandas(ends, f"track {kept}, block long, el array<double>, er array<double>")
    in_order = from_rest.repartition("track").sortWithinPartitions("track", "block")
    states = in_order.mapInPandas(chained, f"track {kept}, block long, zl array<double>, zr array<double>")
    named = states.withColumnsRenamed({"track": "s_track", "block": "s_block"})
    return rows.join(named, F.col("track").eqNullSafe(F.col("s_track")) & (F.col("block") == F.col("s_block"))).drop("s_track", "s_block")


def filtered(signal: DataFrame, stages: list[tuple[float, ...]], size: int = BLOCK) -> DataFrame:
    """Both channels through a cascade of filters: track, idx, i (position), l, r. Blocks are filtered in parallel."""
    cascade = Cascade(stages, size)
    rows = with_states(blocks(signal, size), cascade)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in ("l", "r"):
                b[c] = [cascade.output(x, z) for x, z in zip(b[c], b[f"z{c}"], strict=True)]
            yield b[["track", "block", "idx", "l", "r"]]

    kinds = rows.schema
    made = rows.mapInPandas(run, f"track {kinds['track'].dataType.simpleString()}, block long, idx {kinds['idx'].dataType.simpleString()}, l array<double>, r array<double>")
    each = made.select("track", "block", F.posexplode(F.arrays_zip("idx", "l", "r")).alias("k", "s"))
    return each.select("track", "s.idx", (F.col("block") * size + F.col("k")).alias("i"), "s.l", "s.r")


def filtered_energy(signal: DataFrame, stages: list[tuple[float, ...]], hop: int, size: int = BLOCK) -> DataFrame:
    """Mean energy of both filtered channels per hop: track, hop, e. A last hop that isn't full is dropped."""
    cascade = Cascade(stages, max(1, size // hop) * hop)
    return hop_energies(blocks(signal, cascade.size), cascade, hop)


def hop_energies(rows: DataFrame, cascade: Cascade, hop: int, shape: Callable[[np.ndarray, float], np.ndarray] | None = None) -> DataFrame:
    """The same of blocks (track, block, l, r) that are there already, of ``cascade.size`` samples, a multiple of ``hop``.

    ``shape(samples, g)`` changes the samples before, with the block's column g. Samples are read once: the energy of a hop whose block
    starts in a state z is a + 2 b z + z c z, where a and b come from the block's output from rest and c from the filter alone. So a second pass has
    a few numbers for each hop, puts the states together along each track, and gives the energies.
    """
    per, n, kind = cascade.size // hop, cascade.n, rows.schema["track"].dataType.simpleString()
    left = cascade.left[: per * hop].reshape(per, hop, n)
    gram = np.einsum("jhn,jhm->jnm", left, left)

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {"el": [], "er": [], "a": [], "b": []}
            for k in range(len(batch)):
                x = [np.asarray(batch[c].iloc[k], np.float64) for c in ("l", "r")]
                if shape is not None:
                    x = [shape(v, batch["g"].iloc[k]) for v in x]
                full = len(x[0]) // hop
                y = [cascade.output(v, cascade.rest())[: full * hop].reshape(full, hop) for v in x]
                out["el"].append(cascade.end_from_rest(x[0]))
                out["er"].append(cascade.end_from_rest(x[1]))
                out["a"].append(sum((v * v).sum(1) for v in y))
                out["b"].append(np.concatenate([np.einsum("jh,jhn->jn", v, left[:full]) for v in y], 1).ravel())
            yield pd.DataFrame({"track": batch["track"], "block": batch["block"], **out})

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, z = (), []
        for batch in batches:
            tracks, hops, energies = [], [], []
            for track, lo, hi in stretches(batch):
                if at != (track,):
                    at, z = (track,), [cascade.rest(), cascade.rest()]
                for block, el, er, a, b in batch[["block", "el", "er", "a", "b"]].iloc[lo:hi].itertuples(index=False, name=None):
                    full, b = len(a), np.asarray(b).reshape(len(a), 2 * n)
                    e = np.asarray(a) + 2 * b @ np.concatenate(z) + sum(np.einsum("jnm,n,m->j", gram[:full], v, v) for v in z)
                    tracks += [track] * full
                    hops.append(block * per + np.arange(full))
                    energies.append(np.maximum(e, 0.0) / hop)
                    z = [end + cascade.turn @ v for end, v in zip((el, er), z, strict=True)]
            if tracks:
                yield pd.DataFrame({"track": np.array([*tracks, None], object)[:-1], "hop": np.concatenate(hops), "e": np.concatenate(energies)})

    parts = rows.select("track", "block", "l", "r", *(["g"] if shape is not None else [])).mapInPandas(rest, f"track {kind}, block long, el array<double>, er array<double>, a array<double>, b array<double>")
    return parts.repartition("track").sortWithinPartitions("track", "block").mapInPandas(chained, f"track {kind}, hop long, e double")


def stretches(batch: pd.DataFrame) -> Iterator[tuple[object, int, int]]:
    """(track, start, end) of the runs of equal tracks in a batch of sorted rows; null tracks are one, as None."""
    codes = pd.factorize(batch["track"])[0]
    cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield (None if codes[a] < 0 else batch["track"].iloc[a]), a, b


class Pieces:
    """The processor of one track's columns (two channels, mostly): gets its samples in order, in pieces of any length, and keeps its own state.

    ``push`` returns what is ready, which may lag behind; ``finish`` the rest. All outputs together are as many as the inputs.
    ``state`` is what it remembers between blocks of ``grain`` samples, ``memory`` the number of samples in which it forgets all but a share 1/e of it.
    """

    memory, grain = 0.0, 1

    @property
    def state(self) -> np.ndarray:
        raise TypeError("a processor that is run in spans defines state")

    def push(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
        raise TypeError("a processor defines push")

    def finish(self) -> tuple[np.ndarray, ...]:
        return (np.zeros(0),) * 3


class Follower(Pieces):
    """A processor whose state is a few named numbers."""

    names: tuple[str, ...] = ()

    @property
    def state(self) -> np.ndarray:
        return np.array([getattr(self, n) for n in self.names])

    @state.setter
    def state(self, values: np.ndarray) -> None:
        for n, v in zip(self.names, values.tolist(), strict=True):
            setattr(self, n, v)


class Filtering(Pieces):
    """A processor whose state is that of its filters, listed by name in ``z``, and of ``inner`` processors."""

    z: dict
    inner: tuple[Pieces, ...] = ()

    @property
    def state(self) -> np.ndarray:
        return np.concatenate([*self.z.values(), *[p.state for p in self.inner], np.zeros(0)])

    @state.setter
    def state(self, values: np.ndarray) -> None:
        for k, old in self.z.items():
            self.z[k], values = values[: len(old)].copy(), values[len(old) :]
        for p in self.inner:
            n = len(p.state)
            p.state, values = values[:n], values[n:]


class Chained(Pieces):
    """One processor after the other."""

    def __init__(self, parts: list[Pieces]) -> None:
        self.parts, self.memory, self.grain = parts, sum(p.memory for p in parts), max((p.grain for p in parts), default=1)

    @property
    def state(self) -> np.ndarray:
        return np.concatenate([p.state for p in self.parts])

    @state.setter
    def state(self, values: np.ndarray) -> None:
        for p in self.parts:
            n = len(p.state)
            p.state, values = values[:n], values[n:]

    def push(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for p in self.parts:
            left, right, *_ = p.push(left, right)
        return left, right

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.zeros(0), np.zeros(0)
        for p in self.parts:
            a, b, *_ = p.push(left, right) if len(left) else (left, right)
            c, d, *_ = p.finish()
            left, right = np.concatenate([a, c]), np.concatenate([b, d])
        return left, right


def ordered(signal: DataFrame, make: Callable[[], Pieces], columns: tuple[str, ...] = ("l", "r")) -> DataFrame:
    """An ordered pass over each track that can't be split: track, idx and ``columns`` as the processor of ``make`` returns them.

    A task holds a batch and the processor's state, never a track. Tracks run in parallel.
    """
    kinds = signal.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, part, waiting = (), None, []  # waiting: idx of the samples that the processor still holds

        def table(parts: list[tuple[object, tuple[np.ndarray, ...]]]) -> pd.DataFrame:
            tracks = np.repeat(np.array([t for t, _ in parts] + [None], object)[:-1], [len(m[0]) for _, m in parts])
            made = {c: np.concatenate([m[k] for _, m in parts]) if parts else np.zeros(0) for k, c in enumerate(columns)}
            ready, waiting[:] = waiting[: len(tracks)], waiting[len(tracks) :]
            return pd.DataFrame({"track": tracks, "idx": ready, **made})

        for pdf in batches:
            parts = []
            for track, a, b in stretches(pdf):
                if at != (track,):
                    if at:
                        parts.append((at[0], part.finish()))
                    at, part = (track,), make()
                waiting += pdf["idx"].iloc[a:b].tolist()
                parts.append((track, part.push(*[pdf[c].to_numpy(np.float64)[a:b] for c in columns])))
            yield table(parts)
        if at:
            yield table([(at[0], part.finish())])

    schema = ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in ("track", "idx")) + "".join(f", {c} double" for c in columns)
    sorted_rows = signal.select("track", "idx", *columns).repartition("track").sortWithinPartitions("track", F.col("idx").asc_nulls_last())
    return sorted_rows.mapInPandas(run, schema)


def folded(signal: DataFrame, make: Callable[[], Callable[[np.ndarray, np.ndarray], tuple[float, ...]]], names: tuple[str, ...]) -> DataFrame:
    """One row per track from an ordered pass: the processor of ``make`` gets the samples in pieces and returns its figures so far."""
    kind = signal.schema["track"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, push, values = (), None, ()
        for pdf in batches:
            done = []
            for track, a, b in stretches(pdf):
                if at != (track,):
                    if at:
                        done.append((*at, *values))
                    at, push = (track,), make()
                values = push(pdf["l"].to_numpy(np.float64)[a:b], pdf["r"].to_numpy(np.float64)[a:b])
            if done:
                yield pd.DataFrame(done, columns=["track", *names])
        if at:
            yield pd.DataFrame([(*at, *values)], columns=["track", *names])

    rows = signal.select("track", "idx", "l", "r").repartition("track").sortWithinPartitions("track", F.col("idx").asc_nulls_last())
    return rows.mapInPandas(run, f"track {kind}, " + ", ".join(f"{n} double" for n in names))


def transformed(frames: DataFrame, keys: list[str], window: np.ndarray | None = None) -> DataFrame:
    """Fourier transform of frames x of one size, with a window if given: keys, k, re, im for each bin from 0 to half the size."""
    kinds = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack([np.asarray(v, np.float64) for v in b["x"]])
                y = np.fft.rfft(x if window is None else x * window, axis=1)
                yield b[keys].assign(re=list(y.real), im=list(y.imag))

    made = frames.select(*keys, "x").mapInPandas(run, f"{kinds}, re array<double>, im array<double>")
    return made.select(*keys, F.posexplode(F.arrays_zip("re", "im")).alias("k", "z")).select(*keys, F.col("k").cast("long").alias("k"), "z.re", "z.im")

"""Passes that depend on all samples before, in parallel: spans start from a guess, and only those whose guess was wrong run again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.operators.blocks import Pieces
from quaver.sources import positions, written

#: Samples of a span: what one task processes in order, in batches. A track is spread over as many tasks as it has spans.
SPAN = 1 << 18
#: How far a guessed state may be from the true one: a share of it, or so much at all.
SHARE, LEAST = 1e-12, 1e-19


def _runs(batch: pd.DataFrame) -> Iterator[tuple[tuple, int, int]]:
    """((track, span), start, end) of the runs of equal keys in sorted rows; null tracks are one, as None."""
    codes, spans = pd.factorize(batch["track"])[0], batch["span"].to_numpy()
    cuts = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(spans) != 0)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield (None if codes[a] < 0 else batch["track"].iloc[a], int(spans[a])), a, b


def _followed(make: Callable[[], Pieces], inputs: tuple[str, ...], outputs: tuple[str, ...]):
    """Sorted rows of whole spans. A span's first rows may be a warm-up, or carry the state to start from (given).

    The first own row gets the state before it (start), the last of each batch the state after it (end).
    """

    keep = ["track", "span", "idx", "i", *(c for c in inputs if c not in outputs)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, part, fresh, waiting = (), None, True, []  # waiting: rows whose results the processor still holds

        def ready(results: tuple[np.ndarray, ...], before: np.ndarray | None, after: np.ndarray) -> pd.DataFrame:
            rows, n = pd.concat(waiting) if len(waiting) > 1 else waiting[0], len(results[0])
            waiting[:] = [rows.iloc[n:]]
            starts, ends = [None] * n, [None] * n
            if n:
                ends[-1] = after.tolist()
                starts[0] = None if before is None else before.tolist()
            return rows.iloc[:n].assign(**dict(zip(outputs, results, strict=False)), start=starts, end=ends)

        for pdf in batches:
            made = []
            for key, a, b in _runs(pdf):
                rows = pdf.iloc[a:b]
                if key != at:
                    if waiting and len(waiting[0]):
                        made.append(ready(part.finish(), before if fresh else None, part.state))
                    at, part, fresh, before, waiting = key, make(), True, None, []
                    if rows["given"].iloc[0] is not None:
                        part.state = np.array(rows["given"].iloc[0], np.float64)
                columns = [rows[c].to_numpy(np.float64) for c in inputs]
                warm = int(rows["halo"].sum())  # they come first, as whole blocks
                if warm:
                    part.push(*[c[:warm] for c in columns])
                if warm < len(rows):
                    before = part.state if before is None else before
                    waiting.append(rows.iloc[warm:][keep])
                    made.append(ready(part.push(*[c[warm:] for c in columns]), before if fresh else None, part.state))
                    fresh = fresh and not len(made[-1])
            if made:
                yield pd.concat(made)
        if waiting and len(waiting[0]):
            yield ready(part.finish(), before if fresh else None, part.state)

    return run


def _states(table: DataFrame) -> DataFrame:
    return table.where("start IS NOT NULL OR end IS NOT NULL").groupBy("track", "span").agg(F.first("start", True).alias("start"), F.max_by("end", F.when(F.col("end").isNotNull(), F.col("i"))).alias("end"))


def _differs(a: Column, b: Column) -> Column:
    return F.exists(F.zip_with(a, b, lambda x, y: F.abs(x - y) > F.greatest(F.abs(y) * SHARE, F.lit(LEAST))), lambda wrong: wrong)


def followed(signal: DataFrame, make: Callable[[], Pieces], inputs: tuple[str, ...] = ("l", "r"), outputs: tuple[str, ...] = ("l", "r"), span: int | None = None) -> DataFrame:
    """What the processor of ``make`` returns for each sample: track, idx, i, the inputs that aren't outputs, and the outputs.

    The processor returns as many samples as it gets (some later), and has ``state`` (numbers that can be read and set), ``memory`` (samples in which
    the slowest of its states forgets all but a share 1/e) and ``grain`` (its block length). Each span starts with a warm-up
    over the samples before it, long enough to forget what isn't known. Then each span's start is compared with the end of the one
    before; spans that started elsewhere run again from there, until all agree. So the result is that of one pass over the whole track (to about
    a share of 1e-12 in the states), whether or not the warm-up sufficed; each round settles at least one more span.

    Positions i that the signal has already are taken as they are. Results are written to the shared folder, where reruns find them.
    """
    one, kinds = make(), signal.schema
    warm = -(-int(np.ceil(-np.log(SHARE) * one.memory)) // one.grain) * one.grain
    size = -(-max(span or SPAN, warm) // one.grain) * one.grain
    placed = signal if "i" in signal.columns else positions(signal)
    own = F.floor(F.col("i") / size)
    later = F.when(F.col("i") - own * size >= size - warm, own + 1)
    rows = placed.select("track", "idx", "i", *[F.col(c).cast("double").alias(c) for c in inputs], F.lit(None).cast("array<double>").alias("given"), F.explode(F.array_compact(F.array(own, later))).alias("span"))
    rows = rows.withColumn("halo", F.floor(F.col("i") / size) < F.col("span"))
    kept = [c for c in inputs if c not in outputs]
    kind = {c: kinds[c].dataType.simpleString() for c in ("track", "idx")}
    schema = f"track {kind['track']}, span long, idx {kind['idx']}, i long, " + "".join(f"{c} double, " for c in [*kept, *outputs]) + "start array<double>, end array<double>"
    run = _followed(make, inputs, outputs)
    through = lambda df: df.repartition("track", "span").sortWithinPartitions("track", "span", "i").mapInPandas(run, schema)
    first = written(through(rows))
    same = lambda a, b: F.col(f"{a}.track").eqNullSafe(F.col(f"{b}.track")) & (F.col(f"{a}.span") == F.col(f"{b}.span"))
    states, patch = written(_states(first)), None
    while True:
        true = F.lag("end").over(W.partitionBy("track").orderBy("span"))  # one row for each span
        wrong = states.withColumn("given", true).where(F.col("given").isNotNull() & _differs(F.col("start"), F.col("given"))).select("track", "span", "given")
        if wrong.isEmpty():
            break
        wrong = written(wrong)
        again = rows.where("NOT halo").drop("given").alias("a").join(wrong.alias("b"), same("a", "b")).select("a.*", "b.given")
        redone = written(through(again))
        changed = _states(redone)
        states = written(states.alias("a").join(wrong.alias("b"), same("a", "b"), "left_anti").unionByName(changed))
        patch = redone if patch is None else written(patch.alias("a").join(wrong.alias("b"), same("a", "b"), "left_anti").unionByName(redone))
    if patch is not None:
        spans = patch.select("track", "span").distinct()
        first = first.alias("a").join(spans.alias("b"), same("a", "b"), "left_anti").unionByName(patch)
    return first.select("track", "idx", "i", *kept, *outputs)

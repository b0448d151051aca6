"""Sums over the past above a bar: two-sided dominance (earlier and greater) without a track in one task and without pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Places of a track that are compared directly, in one group.
SPAN = 1024
#: Ranges of values that a node is sorted in, each apart.
RANGES = 64


def sums_above(values: DataFrame, asks: DataFrame, span: int = SPAN) -> DataFrame:
    """For each ask (track, at, bar) the values (track, at, v) with at <= the ask's and v > bar: track, at, n, total.

    Places (``at``, from 0) are cut into spans. What lies in an ask's own span is compared directly. The spans before it are a union
    of nodes, one for each bit that is set in its number: level k has nodes of 2**k spans. Each value is in at most one node of a
    level, each ask looks into at most one, so n values are n log n rows. A node is sorted in ranges of values, and asks read running
    sums. Equal values of a span are one row, as are equal bars, so silence or a constant level makes no range heavy.

    A null bar or one that nothing passes gives n 0; null values count nowhere. Asks of one track need distinct ``at``; an empty
    table of asks gives an empty result.
    """
    schema = asks.schema["track"].dataType.simpleString()
    at = lambda d, x, ask: d.select("track", F.col("at").cast("long").alias("at"), F.col(x).cast("double").alias("x"), F.lit(ask).alias("ask"))
    rows = at(values.where("v IS NOT NULL"), "v", False).unionByName(at(asks, "bar", True)).withColumn("span", F.floor(F.col("at") / span))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        a, v = pdf[pdf["ask"]], pdf[~pdf["ask"]]
        passing = (v["at"].to_numpy()[None, :] <= a["at"].to_numpy()[:, None]) & (v["x"].to_numpy()[None, :] > a["x"].to_numpy(np.float64)[:, None])
        return pd.DataFrame({"track": a["track"], "at": a["at"], "n": passing.sum(1), "total": passing @ v["x"].to_numpy(np.float64)})

    own = rows.groupBy("track", "span").applyInPandas(within, f"track {schema}, at long, n long, total double")
    shares = [k / RANGES for k in range(1, RANGES)]
    bounds, top = rows.agg(F.percentile_approx("x", shares, 10 * RANGES), F.max("span")).first()  # one row
    if not top or not bounds:
        return own

    # equal values, and equal bars, of a span: one row; a span holds at most ``span`` asks
    held = rows.where("x IS NOT NULL").groupBy("track", "span", "ask", "x").agg(
        F.count_if(~F.col("ask")).alias("n"), F.sum(F.when(F.col("ask"), 0.0).otherwise(F.col("x"))).alias("total"), F.collect_list(F.when(F.col("ask"), F.col("at"))).alias("ats")
    )
    levels = f"sequence(0, {int(top).bit_length() - 1})"
    # values: nodes of even number whose neighbour exists; asks: the node before each odd one
    gives = f"filter({levels}, k -> shiftright(span, k) % 2 = 0 AND shiftleft(shiftright(span, k) + 1, k) <= {top})"
    takes = f"filter({levels}, k -> shiftright(span, k) % 2 = 1)"
    part = ["track", "level", "node", "range"]
    nodes = (
        held.withColumn("level", F.explode(F.when(F.col("ask"), F.expr(takes)).otherwise(F.expr(gives))))
        .withColumn("node", F.expr("shiftright(span, level) - IF(ask, 1, 0)"))
        .withColumn("range", F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("x"))))
        .drop("span")
    )
    falling = W.partitionBy(*part).orderBy(F.desc("x"), F.desc("ask")).rowsBetween(W.unboundedPreceding, W.currentRow)  # at a tie the ask comes first
    running = nodes.withColumns({c: F.sum(c).over(falling) for c in ("n", "total")}).where("ask").select(*part, "ats", "n", "total")
    ranges = nodes.where("NOT ask").groupBy(*part).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    asked = nodes.where("ask").select(*part).distinct().withColumns({"n": F.lit(0).cast("long"), "total": F.lit(0.0)})
    higher = W.partitionBy("track", "level", "node").orderBy(F.desc("range"))  # at most RANGES rows and as many of asks
    sums = ranges.unionByName(asked).groupBy(*part).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    before = sums.withColumns({c: F.coalesce(F.sum(c).over(higher.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) for c in ("n", "total")})
    on = None
    for c in part:
        same = F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}"))
        on = same if on is None else on & same
    far = running.alias("r").join(before.alias("b"), on).select(
        "r.track", F.explode("r.ats").alias("at"), (F.col("r.n") + F.col("b.n")).alias("n"), (F.col("r.total") + F.col("b.total")).alias("total")
    )
    return own.unionByName(far).groupBy("track", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

"""Points in intervals, as joins on equal cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def containing(points: DataFrame, intervals: DataFrame, keys: list[str], at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """Each point with every interval [start, end) of its keys that holds it: all columns of both.

    An interval goes to a grid whose cells are as wide as itself, rounded up to a power of two, so it lies in at most two of them
    however long it is. A point looks into its cell of each grid that any interval is in: as many as lengths differ in powers of two.
    So nothing is compared but points and intervals of one neighbourhood, and a few long intervals among many short ones cost no more rows.
    Both sides are dealt by cell: their files' sizes say too little about their rows for a side to be sent through the driver to all tasks.

    Empty intervals, and those with a null bound, hold nothing; null keys and points are in none; points on an end are outside. Repeated points and
    intervals count each. Columns of both sides other than the keys have to differ in name.
    """
    long = F.col(end).cast("double") - F.col(start).cast("double")
    width = F.pow(F.lit(2.0), F.col("grid"))
    cell = lambda c: F.floor(F.col(c) / width)
    laid = intervals.where(long > 0).withColumn("grid", F.ceil(F.log2(long)).cast("int"))
    grids = [r["grid"] for r in laid.select("grid").distinct().collect()]  # at most one for each exponent of a double
    laid = laid.withColumn("cell", F.explode(F.array_distinct(F.array(cell(start), cell(end)))))
    put = points.where(F.col(at).isNotNull()).withColumn("grid", F.explode(F.array(*map(F.lit, sorted(grids))).cast("array<int>"))).withColumn("cell", cell(at))
    return put.hint("merge").join(laid, [*keys, "grid", "cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("grid", "cell")


def first_containing(points: DataFrame, intervals: DataFrame, keys: list[str], label: str, at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """Each different point (all its columns) that some interval of its keys holds, with the label of the one that starts first, of equals the smallest.

    The least is kept before rows are dealt by point, so a point in very many intervals is no burden. Points outside of all are left out.
    """
    both = containing(points, intervals.select(*keys, start, end, label), keys, at, start, end)
    return both.groupBy(*points.columns).agg(F.min(F.struct(start, label)).alias("first")).select(*points.columns, F.col(f"first.{label}").alias(label))


def first_and_count(points: DataFrame, intervals: DataFrame, keys: list[str], label: str, at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """Each point (all its columns, repeated points too) that some interval of its keys holds, with ``first`` (start and label of the one that starts
    first, of equals the smallest) and ``n``, how many hold it.

    Intervals are looked up once for each different place (keys and ``at``), so many points at one place cost no more than one.
    """
    places = points.select(*keys, at).distinct()
    both = containing(places, intervals.select(*keys, start, end, label), keys, at, start, end)
    found = both.groupBy(*keys, at).agg(F.min(F.struct(start, label)).alias("first"), F.count(F.lit(1)).alias("n"))
    return points.hint("merge").join(found, [*keys, at])

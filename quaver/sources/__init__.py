"""Signals from tables: rows (track, idx, l, r)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode (tests) one of our own where it is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        own = tempfile.mkdtemp(prefix="quaver-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own_dir.append("file://" + own)
    return _own_dir[0]


def write_out(df: DataFrame) -> str:
    """Writes ``df`` to a table in the shared folder and returns its path."""
    path = f"{shared_dir(df.sparkSession)}/quaver/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` from a table in the shared folder: cuts lineage, is computed once, survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(write_out(df))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_signal(spark: SparkSession, sf_dir: str, track: str = "event_type", more: Sequence[Column] = ()) -> DataFrame:
    """Events as a two-channel signal, ordered by event_id, with columns ``more`` of the table."""
    k = F.get_json_object("props", "$.k").cast("double")
    return read(spark, sf_dir, "events").select(
        F.col(track).alias("track"), F.col("event_id").alias("idx"), ((F.col("value") - 50) / 1024).alias("l"), ((k - 50) / 128).alias("r"), *more
    )


def line_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines by return flag; only for measures that don't depend on order."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("track"), (F.col("l_quantity") / 64).alias("l"), F.col("l_discount").alias("r"))


#: Ranges of idx that positions are counted in, each apart.
RANGES = 64


def positions(signal: DataFrame) -> DataFrame:
    """Adds i, the position from 0 within the track; rows without idx come last.

    Rows are numbered within ranges of idx that hold about the same number of rows, and start from what the ranges before hold: a
    track of any length is sorted in as many parts as there are ranges.
    """
    from pyspark.sql import Window as W

    shares = F.percentile_approx("idx", [k / RANGES for k in range(1, RANGES)], 10 * RANGES)
    bounds = signal.agg(F.coalesce(shares, F.array(F.lit(0).cast(signal.schema["idx"].dataType))).alias("bounds"))  # one row
    last = F.when(F.col("idx").isNull(), F.lit(RANGES)).otherwise(F.size(F.filter("bounds", lambda b: b <= F.col("idx"))))
    placed = signal.crossJoin(F.broadcast(bounds)).withColumn("range", last).drop("bounds")
    counts = placed.groupBy("track", "range").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy("track").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("track").alias("s_track"), F.col("range").alias("s_range"), before.alias("before"))
    inside = F.row_number().over(W.partitionBy("track", "range").orderBy(F.col("idx").asc_nulls_last())) - 1
    joined = placed.withColumn("i", inside).join(starts, F.col("track").eqNullSafe(F.col("s_track")) & (F.col("range") == F.col("s_range")))
    return joined.withColumn("i", F.col("i") + F.col("before")).drop("s_track", "s_range", "before", "range")

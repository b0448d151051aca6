"""Stored pyramids, and views of them that read one level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.operators.measure import pyramid_until


def store_pyramid(signal: DataFrame, path: str, per: int = 128, factor: int = 8, most: int = 2048) -> None:
    """Writes the levels of each track's pyramid, a folder for each level, rows of a track together and in order of buckets."""
    levels = pyramid_until(signal, per, factor, most)
    levels.repartition("level", "track").sortWithinPartitions("level", "track", "bucket").write.partitionBy("level").mode("overwrite").parquet(path)


def views(spark: SparkSession, path: str, requests: DataFrame, width: int, per: int = 128, factor: int = 8) -> DataFrame:
    """Pixels of each request (view, track, start, length in samples): view, x, level, mn, mx, rms; pixels past the end are left out.

    A view reads the coarsest level whose buckets are no longer than a pixel, or the finest; a track that has fewer levels gives
    its last one. Each pixel names the buckets it covers, a few at any zoom, so the join is on equal track, level and bucket, and only folders of
    levels that some view needs are read. Lengths of 0 or less have no pixels.
    """
    kind = requests.schema["track"].dataType.simpleString()
    stored = spark.read.schema(f"track {kind}, bucket long, mn double, mx double, rms double, level int").parquet(path)  # an empty table has no files to tell
    # a row for each track and level, from the folders' names and the least bucket of each
    have = stored.where("bucket = 0").select("track", "level").groupBy("track").agg(F.max("level").alias("top"))
    tops = have.agg(F.max("top")).first()[0]
    if tops is None:
        return requests.limit(0).select("view", F.lit(0).alias("x"), F.lit(0).alias("level"), *[F.lit(0.0).alias(c) for c in ("mn", "mx", "rms")])
    spp = F.col("length") / width
    fits = sum((F.when(per * factor**k <= spp * 1.0001, 1).otherwise(0) for k in range(1, tops + 1)), F.lit(0))
    asked = requests.where("length > 0").join(have, "track").withColumn("level", F.least(fits, F.col("top")).cast("int"))
    size = F.lit(float(per)) * F.pow(F.lit(float(factor)), F.col("level"))
    x, first, step = F.col("x"), F.col("start") / size, F.col("length") / width / size
    b0 = F.greatest(F.lit(0), F.floor(first + x * step))
    b1 = F.greatest(b0 + 1, F.ceil(first + (x + 1) * step))
    pixels = asked.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).select("view", "track", "level", "x", F.explode(F.sequence(b0, b1 - 1)).alias("bucket"))
    needed = [r["level"] for r in asked.select("level").distinct().collect()]  # at most one for each level
    read = stored.where(F.col("level").isin(needed)) if needed else stored.limit(0)
    hit = pixels.join(read, ["track", "level", "bucket"])
    return hit.groupBy("view", "x", "level").agg(F.least(F.lit(1.0), F.min("mn")).alias("mn"), F.greatest(F.lit(-1.0), F.max("mx")).alias("mx"), F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("rms"))

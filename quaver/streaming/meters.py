"""Meter frames in batch, and the same by Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.functions import r4
from quaver.sources import event_signal, positions, shared_dir


def meter_frames(signal: DataFrame, size: int = 64) -> DataFrame:
    """Peak and number of samples of each tumbling frame: track, frame, peak, n."""
    return _frames(positions(signal), size)


def _frames(placed: DataFrame, size: int) -> DataFrame:
    peak = F.max(F.greatest(F.abs("l"), F.abs("r")))
    return placed.groupBy("track", F.floor(F.col("i") / size).alias("frame")).agg(r4(peak).alias("peak"), F.count(F.lit(1)).alias("n"))


def meter_frames_stream(spark: SparkSession, sf_dir: str, size: int = 64) -> DataFrame:
    """The same frames from a stream of samples that carry their position, all that is there at the time."""
    return stream_frames(positions(event_signal(spark, sf_dir)), size)


def stream_frames(placed: DataFrame, size: int = 64, files_per_batch: int | None = None) -> DataFrame:
    """Frames of samples (track, i, l, r), by a stream over them in the shared folder, ``files_per_batch`` files at a time.

    Executors write each batch's frames to a folder of its own there, which a batch that is run again overwrites: no frame
    passes through the driver, and none is kept as state. A frame whose samples came in several batches is put together when read.
    """
    spark = placed.sparkSession
    own = f"{shared_dir(spark)}/meters_{uuid.uuid4().hex}"
    placed.write.parquet(f"{own}/samples")
    schema = _frames(placed, size).schema
    source = spark.readStream.schema(placed.schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    spark.createDataFrame([], schema).write.parquet(f"{own}/frames/none")  # an empty table makes no batch
    put = lambda batch, k: _frames(batch, size).write.mode("overwrite").parquet(f"{own}/frames/{k}")
    samples = source.parquet(f"{own}/samples")
    samples.writeStream.foreachBatch(put).option("checkpointLocation", f"{own}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(schema).parquet(f"{own}/frames/*")
    return found.groupBy("track", "frame").agg(F.max("peak").alias("peak"), F.sum("n").alias("n"))

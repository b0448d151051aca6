"""Balanced contiguous shards from global byte-size prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.llm.common import materialize, partitions


def prefix_sums(df: DataFrame, order: list[str], values: list[str], n: int | None = None) -> DataFrame:
    """Exclusive running totals ``before_<v>`` of each ``values`` column and ``row`` (from 0) over the whole of ``df``.

    Rows are range partitioned by ``order`` (a total order up to identical rows), so no key can fill one task. Each
    partition sums its own rows; only its totals, one row for each of ``n`` partitions, meet in one task.
    """
    n = n or partitions(df.sparkSession)
    parts = materialize(df.repartitionByRange(n, *[F.col(c).asc_nulls_last() for c in order]).withColumn("part", F.spark_partition_id()))
    inside = W.partitionBy("part").orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(W.unboundedPreceding, -1)
    below = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = parts.groupBy("part").agg(F.count(F.lit(1)).alias("row"), *[F.sum(v).alias(v) for v in values])
    offsets = totals.select("part", *[F.coalesce(F.sum(v).over(below), F.lit(0)).alias(f"offset_{v}") for v in ["row", *values]])
    rows = parts.withColumns(
        {"in_row": F.count(F.lit(1)).over(inside)} | {f"in_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}
    )
    # one row of offsets for each of the n partitions: the bound of what is broadcast
    return rows.join(F.broadcast(offsets), "part").select(
        *df.columns, (F.col("in_row") + F.col("offset_row")).alias("row"), *[(F.col(f"in_{v}") + F.col(f"offset_{v}")).alias(f"before_{v}") for v in values]
    )


def shard_by_bytes(docs: DataFrame, shards: int = 40, row_overhead: int = 16) -> DataFrame:
    """Contiguous shards, by ascending doc_id, of near equal bytes.

    Returns doc_id, size, text_crc32, shard, slot. The stream of all documents is cut at the multiples of total/shards; a
    document belongs to the shard that holds its middle byte, so shards differ from the target by at most one document.
    Null texts count as empty, null ids come last, ties in doc_id are ordered by size and checksum, identical rows keep
    one slot each. Documents larger than a shard's target leave later shards empty. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = materialize(
        docs.select("doc_id", (F.octet_length(text).cast("long") + F.lit(row_overhead)).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    )
    placed = prefix_sums(slim, ["doc_id", "size", "text_crc32"], ["size"])
    total = slim.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("decimal(38,0)").alias("total"))  # one row
    middle = (F.col("before_size") + F.floor(F.col("size") / 2)).cast("decimal(38,0)")
    cut = placed.join(F.broadcast(total)).withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.col("total"))).cast("int"))
    firsts = cut.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row for each shard
    return cut.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))

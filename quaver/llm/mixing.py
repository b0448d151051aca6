"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.llm.common import WORD, materialize

#: The golden-ratio (Kronecker) sequence in 52 bits: an odd multiplier, so 2**52 points differ; products are made of halves of 26 bits.
HALF = 26
GOLDEN = round((5**0.5 - 1) / 2 * 2 ** (2 * HALF)) | 1


def golden(i: Column) -> Column:
    """The ``i``-th point of the sequence in [0, 1); exact for i from 0 to 2**36."""
    i, low, high, half = i.cast("long"), GOLDEN % (1 << HALF), GOLDEN >> HALF, 1 << HALF
    return ((i * high % half) * half + i * low) % (half * half) / F.lit(float(half * half))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of each source from (source, source_size): weights repeat over the sources by code point, null last.

    All targets share ``share`` times all sizes by weight; none exceeds ``most`` times its source's size. Resharing the
    excess until none is above ends at one water level: with the sources by rising cap per weight, the level is that of
    the first source which stays below its cap.
    """
    all_rows = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # windows over sources, not documents
    ranked = sizes.withColumn("src", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).withColumns(
        {"weight": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int")), "cap": F.col("source_size") * F.lit(float(most))}
    )
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "src")
    filled = ranked.withColumns(
        {
            "before": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "open_weight": F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)),
            "total": F.sum("source_size").over(all_rows) * F.lit(float(share)),
        }
    ).withColumn("level", (F.col("total") - F.col("before")) / F.col("open_weight"))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(all_rows)
    # levels fall from the first uncapped source on, as each later one takes more sources to be capped
    return filled.withColumn("level", level).select("source", "src", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42, block_words: int = 4096) -> DataFrame:
    """How often and where the mix takes each document: doc_id, row_key, size, source, source_size, target, taken, first_pass, second_pass, first_slot, second_slot, start.

    Each source's documents are laid end to end in the order of a hash and cut into blocks of ``block_words`` words. Which
    documents are taken depends on that hash (``seed``), on the targets and, for the interleaving of sources, on ``block_words``. Slots follow the golden-ratio sequence mapped through the
    cumulative targets; the k-th slot of a source takes its block k modulo its number of blocks, until the source's
    target is met, the last block in part. ``taken`` counts a document's words in all taken blocks; repeats count. The mix is in the
    order of its slots, and within a slot in that of ``start`` (the document's first word in its source): ``first_slot`` and
    ``second_slot`` are where each pass takes the document first, null where it doesn't. ``most`` is 2 or less, so two passes are all.

    Null texts and texts without words have size 0 and are taken 0 times. Null sources form one source, the last. Repeated
    rows and ids are separate documents; row_key tells documents apart by id and content. An empty table gives an empty result. Extra columns are ignored.
    Documents are dealt by (source, range of the hash), so a source with a third of all rows is spread over all tasks. Only tables of
    sources (offsets, targets, shares) meet in one task, not documents. Very long texts are counted as a whole, and span many blocks.
    """
    if most > 2:
        raise ValueError("a document is taken twice at most")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = materialize(
        docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", text).alias("h"))
    )
    buckets, block = max(256, base.count() // 5000), block_words

    # per (source, bucket) totals, then offsets of buckets within their source
    # buckets are ranges of the hash, so the order of documents is that of the hash, whatever the number of buckets
    base = base.withColumn("bucket", F.shiftright((F.shiftright("h", 32) + (1 << 31)) * buckets, 32))
    per_bucket = base.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sizes = per_bucket.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share, most))
    order = W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    t = targets.withColumnRenamed("source", "t_source")
    offsets = (
        per_bucket.join(t, F.col("source").eqNullSafe(F.col("t_source")))
        .select("source", "bucket", "src", "source_size", "target", "words")
        .withColumn("offset", F.coalesce(F.sum("words").over(order), F.lit(0)))
        .drop("words")
    )
    inside = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = base.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("copy", F.row_number().over(W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size")))
    o = offsets.withColumnsRenamed({"source": "o_source", "bucket": "o_bucket"})
    stream = materialize(
        placed.join(o, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket"))).select(
            "doc_id", "source", "size", "h", "copy", "bucket", "src", "source_size", "target", (F.col("start") + F.col("offset")).alias("start")
        )
    )

    taken_blocks = schedule(targets, block).groupBy("src", "block").agg(
        *[F.max(F.when(F.col("pass") == k, F.col(c))).alias(f"{c[0]}{k}") for c in ("words", "slot") for k in (0, 1)]
    )
    pieces = stream.where("size > 0").select(
        "doc_id", "h", "copy", "bucket", "src", "start", "size",
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"),
    )
    b = taken_blocks.withColumnRenamed("src", "b_src").withColumnRenamed("block", "b_block")
    lo = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    hi = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    part = lambda w: F.greatest(F.lit(0), F.least(hi, F.coalesce(F.col(w), F.lit(0))) - lo)
    counts = (
        pieces.join(b, (F.col("src") == F.col("b_src")) & (F.col("block") == F.col("b_block")))
        .groupBy("src", "bucket", "h", "copy")
        .agg(
            F.sum(part("w0")).alias("first_pass"), F.sum(part("w1")).alias("second_pass"),
            F.min(F.when(part("w0") > 0, F.col("s0"))).alias("first_slot"), F.min(F.when(part("w1") > 0, F.col("s1"))).alias("second_slot"),
        )
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return stream.join(counts, ["src", "bucket", "h", "copy"], "left").select(
        "doc_id", F.col("h").alias("row_key"), "size", "source", "source_size", "target", (zero("first_pass") + zero("second_pass")).alias("taken"),
        zero("first_pass").alias("first_pass"), zero("second_pass").alias("second_pass"), "first_slot", "second_slot", "start",
    )


def schedule(targets: DataFrame, block: int, chunk: int = 4096) -> DataFrame:
    """The slots of the mix in order: slot (from 0, gapless), src, rank, pass, block, words.

    A source has as many slots as its target has blocks. As many golden-ratio points as there are slots in all fall into the sources'
    intervals of [0, 1), whose lengths are their shares of the slots, by an equi-join on a grid. The points of an interval differ
    from its share by a few at any time; at the end what a source has too many is left out, and what it lacks is put evenly between
    the others, so each prefix of the mix is near its weights, however small a source is. Ranks and slots come from counts per chunk
    of points, so no source's slots meet in one task. Sources with a target below 1 have none.
    """
    spark = targets.sparkSession
    t = targets.where("target >= 1").withColumn("need", F.floor("target").cast("long"))
    # passes over a source end with a part block, so two passes take one slot more than words / block
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("needed", F.expr("need DIV source_size") * F.col("blocks") + F.ceil(F.col("need") % F.col("source_size") / block))
    upto = W.orderBy("src").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = materialize(t.withColumn("upto", F.sum("needed").over(upto)))
    n, sources = t.agg(F.coalesce(F.sum("needed"), F.lit(0)), F.count(F.lit(1))).first()
    cells = max(1024, 4 * sources)
    t = t.withColumns({"lo": (F.col("upto") - F.col("needed")) / F.lit(n or 1), "hi": F.col("upto") / F.lit(n or 1)})  # n / n is 1
    points = spark.range(n).select(F.col("id").alias("point"), golden(F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") * cells))
    grid = t.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.lit(cells - 1), F.floor(F.col("hi") * cells)))))
    fields = ["src", "need", "needed", "blocks", "source_size"]
    drawn = points.join(grid, "cell").where("u >= lo AND u < hi").select("point", F.lit(-1).cast("long").alias("k"), *fields)
    short = t.join(drawn.groupBy("src").agg(F.count(F.lit(1)).alias("got")), "src", "left").withColumn("lacks", F.col("needed") - F.coalesce("got", F.lit(0))).where("lacks > 0")
    added = short.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lacks") - 1)))
    added = added.withColumn("point", F.floor((F.col("k") + golden(F.col("src") + 1)) * n / F.col("lacks")).cast("long"))  # after that point
    slots = drawn.unionByName(added.select("point", "k", *fields)).withColumn("chunk", F.floor(F.col("point") / chunk))

    per_chunk = slots.groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("n"))
    ranks = per_chunk.select("src", "chunk", F.coalesce(F.sum("n").over(W.partitionBy("src").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ranks_before"))
    inside = F.row_number().over(W.partitionBy("src", "chunk").orderBy("point", "k")) - 1
    ranked = slots.withColumn("in_chunk", inside).join(ranks, ["src", "chunk"]).withColumn("rank", F.col("in_chunk") + F.col("ranks_before")).where("rank < needed")
    ranked = materialize(ranked.select("point", "k", "chunk", *fields, "rank"))
    firsts = ranked.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).select("chunk", F.coalesce(F.sum("n").over(W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("slots_before"))
    slot = F.row_number().over(W.partitionBy("chunk").orderBy("point", "k", "src")) - 1
    placed = ranked.withColumn("in_chunk", slot).join(firsts, "chunk").withColumns(
        {"slot": F.col("in_chunk") + F.col("slots_before"), "pass": F.floor(F.col("rank") / F.col("blocks")), "block": F.col("rank") % F.col("blocks")}
    )
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    left = F.col("need") - F.col("pass") * F.col("source_size") - F.col("block") * block
    return placed.select("slot", "src", "rank", "pass", "block", F.least(length, left).alias("words"))

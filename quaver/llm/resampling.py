"""Importance resampling towards a target corpus: hashed n-grams as postings by bucket, gains per bucket, weights per document."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import materialize, small_batches
from quaver.llm.sharding import prefix_sums

#: Byte by byte: A-Z in lower case, other ASCII that is in no word becomes a space; digits, a-z and all bytes of other code points stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of one text that are split into words at once, and features that are sorted at once: what bounds a task's memory.
TEXT_BYTES, FEATURES = 1 << 20, 1 << 22
#: Documents of one block; a place in a block is its number's low bits in a sorted code.
BLOCK_DOCS = 1 << 14
#: Groups of buckets that are dealt out, and blocks of one cell: a cell (a group of buckets in some blocks) is what a task has in memory.
BUCKET_GROUPS, CELL_BLOCKS = 64, 64


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; a word is never cut."""
    at = 0
    while at < len(text):
        end = at + TEXT_BYTES
        if end < len(text):  # up to the end of the word that reaches over it
            while end < len(text) and _FOLD[text[end]] != 32:
                end += 1
        yield text[at:end].translate(_FOLD).split()
        at = end


def features_of(text: bytes, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of the runs of one to three words that end in them), some words at a time.

    A run's checksum goes on from that of the run without its last word, so each run costs one word more.
    """
    crc, held = zlib.crc32, []
    for new in words_of(text):
        words = held + new
        spaced = [b" " + w for w in words]
        ones = list(map(crc, words))
        twos = list(map(crc, spaced[1:], ones))
        threes = list(map(crc, spaced[2:], twos))
        n = len(held)  # up to two words before the new ones: only runs that end in a new word count
        yield len(new), (np.array(ones[n:] + twos[max(n - 1, 0) :] + threes, np.int64) % buckets).astype(np.int32)
        held = words[-2:]


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 as bytes, and where each one ends; 255 says that a number goes on in the next byte."""
    more = values // 255
    ends = np.cumsum(more + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = values % 255
    return out, ends


def unpack(packed: bytes) -> np.ndarray:
    b = np.frombuffer(packed, np.uint8)
    sums = np.cumsum(b, dtype=np.int64)[b != 255]
    return np.diff(sums, prepend=0)


class _Block:
    """Features of up to BLOCK_DOCS documents, as codes bucket * BLOCK_DOCS + place with their counts."""

    def __init__(self, number: int) -> None:
        self.number, self.docs, self.raw, self.n_raw, self.codes, self.counts = number, [], [], 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, bucket: np.ndarray) -> None:
        self.raw.append(bucket.astype(np.int64) * BLOCK_DOCS + len(self.docs))
        self.n_raw += len(bucket)
        if self.n_raw >= FEATURES:
            self.merge()

    def merge(self) -> None:
        """Count what was added; a document leaves at most as many codes as there are buckets, however long it is."""
        if self.raw:
            codes, counts = np.unique(np.concatenate(self.raw), return_counts=True)
            both, place = np.unique(np.concatenate([self.codes, codes]), return_inverse=True)
            self.codes, self.counts = both, np.bincount(place, np.concatenate([self.counts, counts]), len(both)).astype(np.int64)
            self.raw, self.n_raw = [], 0

    def full(self) -> bool:
        return len(self.docs) == BLOCK_DOCS or len(self.codes) + self.n_raw >= FEATURES

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        bucket, first = np.unique(self.codes // BLOCK_DOCS, return_index=True)
        places = self.codes % BLOCK_DOCS
        steps = np.diff(places, prepend=0)
        steps[first] = places[first]  # each bucket's places start anew
        n = len(bucket)
        columns = {"block": [self.number] * n, "bucket": bucket, "n": np.add.reduceat(self.counts, first) if n else []}
        for name, values in (("places", steps), ("times", self.counts - 1)):
            out, ends = pack(values)
            cuts = [0, *ends[np.append(first[1:], len(ends)) - 1].tolist()] if n else [0]
            columns[name] = [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        yield _batch(columns)
        ids, features, words = zip(*self.docs, strict=True)
        yield _batch({"block": [self.number], "bucket": [-1], "n": [0], "ids": [ids], "features": [features], "words": [words]})


_SCHEMA = "block long, bucket int, n long, places binary, times binary, ids array<long>, features array<long>, words array<long>"
_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("places", pa.binary()), ("times", pa.binary())] + [(x, pa.list_(pa.int64())) for x in ("ids", "features", "words")])


def _batch(columns: dict) -> pa.RecordBatch:
    n = len(columns["block"])
    return pa.RecordBatch.from_pydict({f.name: columns.get(f.name, [None] * n) for f in _ARROW}, schema=_ARROW)


def _indexed(buckets: int):
    """Postings by block and bucket; a row of bucket -1 names the block's documents in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                n_words = n_features = 0
                for n, bucket in features_of((text or "").encode(), buckets):
                    block.add(bucket)
                    n_words, n_features = n_words + n, n_features + len(bucket)
                block.docs.append((doc_id, n_features, n_words))
                if block.full():
                    yield from block.rows()
                    number += 1
                    block = _Block(number)
        if block.docs:
            yield from block.rows()

    return run


def postings(docs: DataFrame, buckets: int = 10_000) -> DataFrame:
    """Inverted postings of all runs of one to three words, written to the shared folder: a row for each bucket of each block.

    ``n`` is the number of features of the bucket in the block; ``places`` and ``times`` pack which documents of the block have it and how
    often. Rows of bucket -1 hold the ids and the numbers of features and words of the block's documents. Null texts have no words.
    """
    small_batches(docs.sparkSession)
    return materialize(docs.select("doc_id", "text").mapInArrow(_indexed(buckets), _SCHEMA))


def _gain(s: int, t: int, all_s: int, all_t: int, buckets: int) -> int:
    return math.floor(1000 * math.log(float(t + 1) * float(all_s + buckets) / (float(s + 1) * float(all_t + buckets))))


def _contributions(buckets: int):
    """Rows sorted by cell and bucket, totals of both corpora before postings: the sums of gains of each block of a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gain, sums = None, None, {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["block", "gains"])

        for batch in batches:
            for cell, bucket, block, places, times, s, t, all_s, all_t in zip(*(batch[c].to_pylist() for c in ("cell", "bucket", "block", "places", "times", "s", "t", "all_s", "all_t")), strict=True):
                if cell != at:
                    if sums:
                        yield out()
                    at, gain, sums = cell, {}, {}
                if places is None:
                    gain = {bucket: _gain(s, t, all_s, all_t, buckets)}
                    continue
                some = np.cumsum(unpack(places))
                have = sums.get(block)
                if have is None or len(have) <= some[-1]:
                    grown = np.zeros(int(some[-1]) + 1, np.int64)
                    grown[: 0 if have is None else len(have)] = 0 if have is None else have
                    have = sums[block] = grown
                have[some] += gain[bucket] * (unpack(times) + 1)
        if sums:
            yield out()

    return run


def weights(docs: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_features, n_words, weight of each row of ``docs``: the sum of the gains of its features towards ``target``.

    Postings are dealt by bucket to cells: BUCKET_GROUPS groups of buckets, times as many parts as keep a cell to about CELL_BLOCKS
    blocks, so a bucket that all documents have is spread over the parts. A bucket's gain is computed in its cell from the totals of both
    corpora, which travel there as rows of their own; what leaves a cell is one sum for each of its documents, added up by document.
    """
    source = postings(docs, buckets)
    other = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    aim = postings(other, buckets)
    none = F.lit(0).cast("long")
    both = source.where("bucket >= 0").select("bucket", F.col("n").alias("s"), none.alias("t")).unionByName(aim.where("bucket >= 0").select("bucket", none.alias("s"), F.col("n").alias("t")))
    totals = materialize(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))  # a row for each bucket
    everything = totals.agg(F.coalesce(F.sum("s"), none).alias("all_s"), F.coalesce(F.sum("t"), none).alias("all_t"))  # one row
    parts = max(1, -(-source.where("bucket = -1").count() // CELL_BLOCKS))
    cell = lambda part: (part * BUCKET_GROUPS + F.pmod("bucket", F.lit(BUCKET_GROUPS))).cast("int").alias("cell")
    null = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    lists = source.where("bucket >= 0").select(cell(F.pmod(F.xxhash64("block"), F.lit(parts))), "bucket", "block", "places", "times", *null("long", "s", "t", "all_s", "all_t"))
    rows = totals.where("s > 0").join(F.broadcast(everything)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = rows.select(cell(F.col("part")), "bucket", *null("long", "block"), *null("binary", "places", "times"), "s", "t", "all_s", "all_t")
    order = [F.col("cell"), F.col("bucket"), F.col("places").isNotNull(), F.col("block")]
    dealt = lists.unionByName(rows).repartition(parts * BUCKET_GROUPS, "cell").sortWithinPartitions(*order)
    gains = dealt.mapInArrow(_contributions(buckets), "block long, gains array<long>")
    named = source.where("bucket = -1").select("block", F.posexplode(F.arrays_zip("ids", "features", "words")).alias("place", "doc"))
    own = named.select("block", "place", "doc.ids", "doc.features", "doc.words", none.alias("gain"))
    given = gains.select("block", F.posexplode("gains").alias("place", "gain")).where("gain <> 0").select("block", "place", *null("long", "ids", "features", "words"), "gain")
    return (
        own.unionByName(given).groupBy("block", "place").agg(F.max("ids").alias("doc_id"), F.max("features").alias("n_features"), F.max("words").alias("n_words"), F.sum("gain").alias("weight")).drop("block", "place")
    )


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """doc_id, n_features, n_words, weight, score, rank: ``percent`` % of the documents, drawn without replacement by their weights.

    Words are runs of ASCII letters and digits and of other code points, A-Z in lower case; features are all runs of one to three words,
    hashed to ``buckets``. Adding Gumbel noise to each weight (from SHA-256 of seed and id, so reruns agree) and taking the highest scores
    draws documents in proportion to their weights; only documents of at least ``min_words`` words are drawn, the others and those not drawn have no rank.

    Null and empty texts have no features and weight 0. Rows without id are drawn like others, with the noise of an empty id, and lose ties.
    Each repeated row counts and is ranked apart; equal scores go by id, then by weight and number of features (rows alike in all are
    interchangeable). With an empty target every gain is that of an unseen bucket; no documents give no rows; other columns are ignored.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0).cast("long")
    scored = materialize(weights(docs, target, buckets).withColumn("score", F.col("weight") + noise))
    fit = scored.where(F.col("n_words") >= min_words)
    drawn = fit.count() * percent // 100
    order = ["below", "doc_id", "weight", "n_features"]
    ranked = prefix_sums(fit.withColumn("below", -F.col("score")), order, []).withColumn("rank", F.when(F.col("row") < drawn, F.col("row") + 1))
    columns = ["doc_id", "n_features", "n_words", "weight", "score"]
    return ranked.select(*columns, "rank").unionByName(scored.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("long").alias("rank")))

"""Audit of quality filters in every order: what each removes, what others would have removed, and what it loses."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.llm.common import WORD, materialize

#: The filters by letter; the n-th letter is bit n of a document's mask of failures.
FILTERS = "ABCDE"
#: A text that holds at least a thousandth of all rows is hot; so there are at most a thousand of them, whatever the input.
HOT_SHARE = 1000
KEY = ["doc_id", "text_hash", "n_chars", "part"]


def _by_text(docs: DataFrame) -> DataFrame:
    """One row for each id, part and text, with the number of rows it stands for, dealt by that key.

    Repeated rows meet before the shuffle, so no number of them fills a task. Texts are told apart by a 64-bit hash and their length
    among the rows of one id and part.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    keyed = rows.withColumns({"text_hash": F.xxhash64("text"), "n_chars": F.length("text")})
    return keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))


def word_counts(texts: DataFrame, key: list[str]) -> DataFrame:
    """Words and distinct words of each ``text``: explode, aggregate (key, word), then key. Texts without words have no row."""
    words = texts.select(*key, F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
    return words.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("times")).groupBy(*key).agg(F.sum("times").alias("words"), F.count(F.lit(1)).alias("distinct_words"))


def _copies_of_smaller_ids(flagged: DataFrame) -> DataFrame:
    """``flagged`` with ``e``: whether a smaller id has the same text (by SHA-256).

    Minima by text are combined before the shuffle. Rows of hot texts meet their minimum by a broadcast of at most HOT_SHARE rows, the
    others by a join in which no text has more than a thousandth of the rows.
    """
    firsts = materialize(flagged.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    total = flagged.count()
    hot = F.col("rows") * HOT_SHARE >= total
    marked = flagged.join(F.broadcast(firsts.where(hot).select("digest", F.col("first_id").alias("hot_id"), F.lit(True).alias("hot"))), "digest", "left")
    cold = marked.where("hot IS NULL").join(firsts.where(~hot).select("digest", "first_id"), "digest", "left")
    rest = marked.where("hot").withColumn("first_id", F.col("hot_id"))
    both = cold.unionByName(rest)
    return both.withColumn("e", F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False)))


def failures(docs: DataFrame, min_words: int = 200, min_distinct_pct: int = 50, max_upper_pct: int = 3) -> DataFrame:
    """doc_id, part, mask, n: how many rows of an id and part fail exactly the filters in ``mask`` (bit 0 for A to bit 4 for E).

    A: fewer than ``min_words`` words; B: under ``min_distinct_pct`` % of the words are distinct; C: over ``max_upper_pct`` % of the
    code points are A-Z; D: one of ``#$%&*|``; E: a smaller id has the same text. Null texts are empty texts, null langs the part ''.
    Empty texts fail A alone, and E. An id that is null is neither smaller nor greater than others, so such rows never fail E, nor make
    others fail it. Repeated rows count each. An empty table gives no rows; other columns are ignored.
    """
    one = _by_text(docs)
    counts = word_counts(one.select(*KEY, "text"), KEY)
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    other = one.select(*KEY, "n", F.unhex(F.sha2("text", 256)).alias("digest"), (upper * 100 > F.col("n_chars") * max_upper_pct).alias("c"), F.col("text").rlike("[#$%&*|]").alias("d"))
    same = [other[k].eqNullSafe(counts[k]) for k in KEY]
    words, distinct = (F.coalesce(counts[c], F.lit(0)) for c in ("words", "distinct_words"))
    met = other.join(counts, same[0] & same[1] & same[2] & same[3], "left")
    flagged = materialize(met.select(other["doc_id"], other["part"], "n", "digest", (words < min_words).alias("a"), (distinct * 100 < words * min_distinct_pct).alias("b"), "c", "d"))
    mask = sum((F.when(F.col(x), 1 << i).otherwise(0) for i, x in enumerate("abcde")), F.lit(0))
    return _copies_of_smaller_ids(flagged).withColumn("mask", mask).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def _total(counts: Column, when) -> Column:
    """Sum of ``counts[mask]`` over the masks for which ``when(mask)`` holds."""
    picked = F.transform(counts, lambda n, mask: F.when(when(mask), n).otherwise(F.lit(0).cast("long")))
    return F.aggregate(picked, F.lit(0).cast("long"), lambda a, x: a + x)


def audit(docs: DataFrame, labels: DataFrame, **thresholds: int) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, order and step.

    The filters see each document's own failures (see ``failures``), which don't depend on the order, so 32 conditional counts for each
    part say all: every order and step is a sum of some of them. An id that any of its rows in ``labels`` calls good (quality 1) or toxic
    is so; labels without id or document change nothing. No document, no rows.
    """
    masks = range(1 << len(FILTERS))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    marked = failures(docs, **thresholds).join(marks, "doc_id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    counts = marked.groupBy("part", "good", "toxic").agg(*[F.sum(F.when(F.col("mask") == m, F.col("n")).otherwise(0)).alias(f"m{m}") for m in masks])
    # at most four rows for each part from here on
    steps = (
        counts.select("part", "good", "toxic", F.array(*[f"m{m}" for m in masks]).alias("counts"), F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])).alias("filter_order"))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("filter", F.col("filter_order").substr(F.col("step"), F.lit(1)))
    )
    place = {x: F.instr("filter_order", x) for x in FILTERS}
    own = sum((F.when(F.col("filter") == x, 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    before = sum((F.when(place[x] < F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumns({"own": own, "before": before})
    fails, gone = lambda m: m.bitwiseAND(F.col("own")) != 0, lambda m: m.bitwiseAND(F.col("before")) != 0
    c = F.col("counts")
    each = steps.withColumns({
        "kept": _total(c, lambda m: ~fails(m) & ~gone(m)),
        "removed": _total(c, lambda m: fails(m) & ~gone(m)),
        "redundant": _total(c, lambda m: fails(m) & gone(m)),
        "unique_fails": _total(c, lambda m: m == F.col("own")),
    })
    whole = each.groupBy("part", "filter_order", "step", "filter").agg(
        *[F.sum(x).alias(x) for x in ("kept", "removed", "redundant", "unique_fails")],
        F.coalesce(F.sum(F.when(F.col("good"), F.col("removed"))), F.lit(0).cast("long")).alias("good_lost"),
        F.coalesce(F.sum(F.when(F.col("toxic"), F.col("removed"))), F.lit(0).cast("long")).alias("toxic_lost"),
    )
    return whole.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "filter")))

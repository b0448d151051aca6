"""A training corpus from documents: toxic ones out, near-duplicates out, secrets masked, sources mixed, texts encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.llm import bpe, mixing, secrets, simhash, toxicity
from quaver.llm.common import WORD, materialize, partitions, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labelled ones that aren't held out.

    Null and empty texts score as texts without evidence and stay. Repeated rows are judged alike; null ids are kept; an empty
    table stays empty; extra columns go.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), limit=20_000)
    return toxicity.score_toxicity(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row stays: that of the smallest id, then of the smallest text hash.

    Rows are told apart by id and text, so two unrelated texts of one id both stay. Of rows that agree in both one stays, with the
    smallest lang, source and n_chars. Rows without id stay only where their component has no other. Null and empty texts have the
    fingerprint zero and link like any other. An empty table stays empty; extra columns go.
    """
    found = simhash.near_duplicates(docs)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_key")).alias("best")
    keep = found.groupBy("root").agg(best).select("best.*")
    keyed = docs.select(*COLUMNS, F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), simhash.text_key(F.col("text")).alias("text_key"))
    key = ["no_id", "id", "text_key"]
    one = keyed.join(keep, key, "left_semi").groupBy(*key).agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"), F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    return one.select("doc_id", "text", "rest.*").select(*COLUMNS)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by <REDACTED>, and n_chars is the new length; no row goes.

    Null texts stay null, with a null length; empty texts stay empty. Rows are independent, so repeated rows and null ids change
    nothing; an empty table stays empty; extra columns go.
    """
    found = secrets.find_secrets(docs, keep=("doc_id", "lang", "source"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the mix; where a source's target ends inside of one, its words up to there.

    Partitions hold ranges of slots of about equal words, and their rows are in order, as are the files written from them.
    Repeated rows are taken as often as the mix takes each of them; they are alike but for lang, source and n_chars, of which the
    smallest are returned. Texts without words (null, empty, white space) are never taken. Null sources are one source; null ids
    change nothing; an empty table stays empty; very long texts are taken whole, at the slot that they begin in; extra columns go.
    """
    seed = 42
    key = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row_key"]
    names = ["no_id", "id", "row_key"]
    passes = F.array(F.struct(F.col("first_pass").alias("words"), F.col("first_slot").alias("slot")), F.struct(F.col("second_pass").alias("words"), F.col("second_slot").alias("slot")))
    taken = materialize(mixing.mix(docs, seed=seed).where("first_pass > 0").select(*key, "size", "start", F.inline(F.filter(passes, lambda p: p["words"] > 0))))
    slots, parts = (taken.agg(F.max("slot")).first()[0] or 0) + 1, partitions(spark)
    keyed = docs.select(*COLUMNS).withColumn("row_key", F.xxhash64(F.lit(seed), "doc_id", F.coalesce(F.col("text"), F.lit("")))).select(*COLUMNS, *key)
    one = keyed.groupBy(*names).agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"), F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    cut = one.join(taken, names).withColumn("text", F.when(F.col("words") < F.col("size"), part).otherwise(F.col("text")))
    ordered = cut.repartitionById(parts, F.floor(F.col("slot") * parts / slots).cast("int")).sortWithinPartitions("slot", "start")
    return ordered.select("doc_id", "text", "rest.lang", "rest.source", F.length("text").cast("long").alias("n_chars")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of what they decode to.

    Null and empty texts have no ids. Rows are independent: repeated rows and null ids change nothing; an empty table gives an empty
    result; extra columns go.
    """
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), out=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", toxic_out),
    ("simhash near-dedup", near_copies_out),
    ("secret scans", secrets_masked),
    ("mixing to target weights", mixed),
    ("bpe encoding", encoded),
]

#: Fitted models and fingerprints are beyond SQL; tests/llm compares the stages with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

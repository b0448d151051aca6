"""The operators as queries over the supplied tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.llm import bpe, filter_audit, fingerprints, mixing, quality, resampling, secrets, sharding, simhash, substrings, topk, toxicity, vptree
from quaver.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), limit=20_000, threshold=0.3)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), out=("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "second_slot")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), limit=20_000)
    return toxicity.score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 40)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.approximate_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


#: Every window of 50 words by its own text; words that a window covers whose text also starts in an earlier document go.
_OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
s AS (SELECT doc_id, p AS pos, md5(array_to_string(words[p:p + 49], ' ')) AS passage FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS p FROM d WHERE len(words) >= 50)),
r AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY passage) < doc_id AS seen FROM s),
c AS (SELECT w.doc_id, w.pos, word, coalesce(bool_or(seen) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM w LEFT JOIN r USING (doc_id, pos)),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY 1)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

_OP7 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
q AS (SELECT *, row_number() OVER (PARTITION BY vec_id) AS copy FROM v WHERE vec_id % 100 = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.copy, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, copy ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""

#: The checksum byte by byte with the table of the reflected polynomial, itself made here by a rule.
_OP10 = """
WITH t AS (SELECT list(c ORDER BY n) AS crcs FROM (SELECT n, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n) AS c FROM (SELECT unnest(range(256)) AS n))),
b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
s AS (SELECT doc_id, CAST(size AS BIGINT) AS size, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, crcs[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM b, t),
p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size // 2 AS middle, sum(size) OVER () AS total FROM s),
c AS (SELECT *, CAST(least(39, middle * 40 // total) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM c"""

#: Flags of each document, then every order applied step by step.
_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT doc_id, part, [CASE WHEN len(ws) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
    CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' END] AS bad FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
g AS (SELECT part, list_filter(bad, lambda x: x IS NOT NULL) AS bad, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, string_split(substr(filter_order, 1, step - 1), '') AS before FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
r AS (SELECT part, filter_order, step, own, sum(n) FILTER (WHERE NOT list_contains(bad, own) AND NOT list_has_any(bad, before)) AS kept, sum(n) FILTER (WHERE list_contains(bad, own) AND NOT list_has_any(bad, before)) AS removed,
    sum(n) FILTER (WHERE list_contains(bad, own) AND list_has_any(bad, before)) AS redundant, sum(n) FILTER (WHERE bad = [own]) AS unique_fails,
    sum(n) FILTER (WHERE good = 1 AND list_contains(bad, own) AND NOT list_has_any(bad, before)) AS good_lost, sum(n) FILTER (WHERE toxic = 1 AND list_contains(bad, own) AND NOT list_has_any(bad, before)) AS toxic_lost
  FROM g, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM r"""

#: The checksum of each distinct feature byte by byte, with the table of the reflected polynomial made by its rule.
_OP13 = r"""
WITH tab AS (SELECT list(c ORDER BY n) AS crcs FROM (SELECT n, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n) AS c FROM (SELECT unnest(range(256)) AS n))),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
df AS (SELECT r, f, count(*) AS n FROM (SELECT r, unnest(list_concat(ws, list_concat(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])))) AS f FROM d) GROUP BY ALL),
bf AS (SELECT f, count(*) AS n FROM (SELECT unnest(list_concat(ws, list_concat(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])))) AS f FROM b) GROUP BY ALL),
h AS (SELECT f, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda a, x: xor(a >> 8, crcs[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), tab),
p AS (SELECT r, bucket, sum(n) AS n FROM df JOIN h USING (f) GROUP BY ALL),
s AS (SELECT bucket, sum(n) AS s FROM p GROUP BY ALL),
t AS (SELECT bucket, sum(n) AS t FROM bf JOIN h USING (f) GROUP BY ALL),
z AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS all_s, (SELECT coalesce(sum(t), 0) FROM t) AS all_t),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), z),
w AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM p JOIN g USING (bucket) GROUP BY ALL),
q AS (SELECT r, doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (r)),
v AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM q),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, weight, n_features) AS place, count(*) OVER () * 5 // 100 AS drawn FROM v WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM v LEFT JOIN k USING (r)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_secrets, op3_simhash, op4_substrings, op5_fingerprints, op6_bpe, op7_topk, op8_mixing, op9_toxicity, op10_sharding, op11_filter_audit, op12_neighbours, op13_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op4_substrings": _OP4, "op7_topk": _OP7, "op10_sharding": _OP10, "op11_filter_audit": _OP11, "op13_resampling": _OP13}

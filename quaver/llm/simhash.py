"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import materialize, small_batches
from quaver.llm.components import components

BITS = 64
#: A bucket of more fingerprints than this is verified by midpoints instead of pairs.
WIDE_BUCKET = 64
#: Differing bits up to which fingerprints link. Wide buckets are verified by midpoints, which is for 2.
RADIUS = 2


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the lower-cased (A-Z) text: a bit is 1 if set in over half of the XXH64 of the word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = len(words) - shingle + 1 if len(words) >= shingle else 1
    counts = np.zeros(BITS, np.int64)
    for at in range(0, grams, 1 << 16):  # long texts in parts of bounded memory
        some = range(at, min(grams, at + (1 << 16)))
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), seed) for i in some), ">u8", len(some))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int("".join("1" if 2 * c > grams else "0" for c in counts), 2)


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        f = np.fromiter((fingerprint(t) for t in b["text"]), np.uint64, len(b))
        yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": f.view(np.int64), "text_key": b["text_key"]})


def _bits(fp: np.ndarray) -> np.ndarray:
    """Rows of 64 zeros and ones; column i is the bit of value 2**i."""
    return np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often each pair of bits is set together (diagonal: each bit), over all of them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = _bits(b["fp"].to_numpy()).astype(np.float64)
            both, n = both + x.T @ x, n + len(x)
        i, j = np.triu_indices(BITS)
        yield pd.DataFrame({"i": np.append(i, BITS), "j": np.append(j, BITS), "n": np.append(both[i, j], n).astype(np.int64)})

    rows = nodes.select("fp").mapInPandas(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 2,081 rows
    both, total = np.zeros((BITS, BITS)), 0
    for i, j, n in rows:
        if i == BITS:
            total = n
        else:
            both[i, j] = both[j, i] = n
    return total, both


def partition_bits(total: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Split the bits into ``parts`` groups, each grown by the bit that correlates most with the group's."""
    p = np.diag(both) / max(total, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(total, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, groups = set(range(BITS)), []
    for g in range(parts):
        width = BITS // parts + (g < BITS % parts)
        mine = [min(left, key=lambda b: (-corr[b, sorted(left)].sum(), b))]
        left.discard(mine[0])
        while len(mine) < width:
            best = min(left, key=lambda b: (-corr[b, mine].sum(), b))
            mine.append(best)
            left.discard(best)
        groups.append(sorted(mine))
    return groups


def allocate(counts: np.ndarray, ratios: list[np.ndarray], radius: int) -> np.ndarray:
    """Thresholds (-1 to radius) of each part for each query, by dynamic programming on estimated candidate counts.

    counts: rows x parts, the fingerprints that share the query's value. ratios: for each part rows x bits, how much commoner
    the value with that bit flipped is, taken bits as independent. Thresholds sum to radius - parts + 1, the least sum at
    which the pigeonhole principle finds every fingerprint within the radius.
    """
    rows, parts = counts.shape
    steps = radius + 2
    cost = np.zeros((rows, parts, steps))  # thresholds -1, 0, ..., radius
    for i, r in enumerate(ratios):
        e = [np.ones(rows), r.sum(1)]
        e.append((e[1] ** 2 - (r**2).sum(1)) / 2)
        width, ball, seen = r.shape[1], np.zeros(rows), 0.0
        for t in range(radius + 1):
            ball = ball + (e[t] if t < 3 else e[1] ** t)
            seen += np.prod([(width - k) / (k + 1) for k in range(t)])
            cost[:, i, t + 1] = counts[:, i] * ball + seen  # candidates and probes
    best = np.full((rows, parts + 1, radius + 2), np.inf)
    best[:, 0, 0] = 0
    take = np.zeros((rows, parts + 1, radius + 2), np.int8)
    for i in range(parts):
        for s in range(radius + 2):
            for t in range(s + 1):
                c = best[:, i, s - t] + cost[:, i, t]
                better = c < best[:, i + 1, s]
                best[better, i + 1, s], take[better, i + 1, s] = c[better], t
    out, s = np.zeros((rows, parts), np.int8), np.full(rows, radius + 1)
    for i in range(parts, 0, -1):
        out[:, i - 1] = take[np.arange(rows), i, s]
        s = s - out[:, i - 1]
    return out - 1


def near_links(nodes: DataFrame, parts: int | None = None) -> DataFrame:
    """Links (a, b) that join all fingerprints (fp, distinct) within RADIUS of each other, directly or by others within it."""
    radius = RADIUS
    total, both = bit_statistics(nodes)
    # fewer, wider parts as fingerprints grow more: a part should have more values than there are fingerprints
    parts = parts or (3 if total < 1 << 22 else 2)
    groups = partition_bits(total, both, parts)
    p1 = (np.diag(both) + 0.5) / (total + 1)

    def values(fp: np.ndarray) -> list[np.ndarray]:
        x = _bits(fp).astype(np.int64)
        return [x[:, g] @ (1 << np.arange(len(g))) for g in groups]

    def index_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy()
            for i, v in enumerate(values(fp)):
                yield pd.DataFrame({"part": np.int32(i), "value": v, "fp": fp})

    def probe_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp, counts = b["fp"].to_numpy(), np.array(b["counts"].tolist(), np.float64).reshape(len(b), parts)
            x = _bits(fp)
            odds = np.where(x == 1, (1 - p1) / p1, p1 / (1 - p1))
            chosen = allocate(counts, [odds[:, g] for g in groups], radius)
            for i, v in enumerate(values(fp)):
                for t in range(radius + 1):
                    rows = chosen[:, i] >= t
                    if not rows.any():
                        continue
                    for flips in combinations(range(len(groups[i])), t):
                        yield pd.DataFrame({"part": np.int32(i), "value": v[rows] ^ sum(1 << k for k in flips), "fp": fp[rows]})

    index = materialize(nodes.select("fp").mapInPandas(index_rows, "part int, value long, fp long"))
    filled = index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    shared = filled.where("n > 1")
    # the size of each fingerprint's own bucket in each part; alone: 1
    own = index.join(shared, ["part", "value"], "left").groupBy("fp").agg(
        F.array(*[F.max(F.when(F.col("part") == i, F.coalesce("n", F.lit(1)))) for i in range(parts)]).alias("counts")
    )
    probes = own.mapInPandas(probe_rows, "part int, value long, fp long")
    wide = filled.where(F.col("n") > WIDE_BUCKET).select("part", "value", F.lit(True).alias("wide"))
    probes = materialize(probes.join(wide, ["part", "value"], "left"))
    held = index.join(wide, ["part", "value"], "left")

    a, b = probes.where("wide IS NULL"), held.where("wide IS NULL").withColumnRenamed("fp", "other")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius
    pairs = a.join(b, ["part", "value"]).where((F.col("fp") != F.col("other")) & close).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    # Members and visitors of wide buckets: within 2 of each other if, and only if, they share a fingerprint within 1 of both.
    # At most 65 are within 1 of any fingerprint, so no group is large, and links go to the least of each group.
    dense = probes.where("wide").select("fp").unionByName(held.where("wide").select("fp")).distinct()
    return pairs.unionByName(_midpoint_links(dense))


def _midpoint_links(dense: DataFrame) -> DataFrame:
    middles = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    near = dense.select("fp", F.explode(middles).alias("middle")).groupBy("middle").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return near.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")


def text_key(text: Column) -> Column:
    """What tells texts apart: a hash of the whole text, null as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """SimHash fingerprints and near-duplicate components: doc_id, text_key, fp (signed), root, component_id.

    ``root`` is the smallest fingerprint of the component, ``component_id`` its smallest doc_id. Documents of equal fingerprints
    are one node; nodes within RADIUS bits are linked. Bits that vary together form a part; each fingerprint gets its own
    thresholds per part by estimated candidate counts, its neighbours' values are probed and candidates verified.
    Groups of copies never become pairs: copies are one node, wide buckets link by midpoints.

    Null and empty texts have fingerprint 0 and link like any other. Null ids are kept; they are never a component's id
    (null if it has no other). Repeated rows stay. An empty table gives an empty result; extra columns are ignored.
    Very long texts: shingles are counted in parts, so memory beyond the words themselves is bounded.
    """
    small_batches(docs.sparkSession)
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key(F.col("text")).alias("text_key"))
    marked = materialize(given.mapInPandas(_fingerprints, "doc_id long, fp long, text_key long"))
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(nodes))
    linked = materialize(nodes.join(roots, F.col("fp") == F.col("node")).select("fp", "least", "root"))
    least = linked.groupBy("root").agg(F.min("least").alias("of_root"))
    # a fingerprint linked to no other has its own least document
    ids = nodes.join(linked.join(least, "root").select("fp", "root", "of_root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("of_root", "least").alias("component_id"))
    return marked.join(ids, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def hex_digits(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

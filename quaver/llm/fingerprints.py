"""Homomorphic multiset hashes of documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import partitions, search, small_batches

#: Lanes that decide equality (sums modulo 2**64) and lanes that also tell likeness (sums modulo 2**32).
WIDE, NEAR = 8, 128
SHINGLE = 3
_TURN, _HALF = 1 << 32, 1 << 31


def _near_lanes(paragraph: bytes) -> np.ndarray:
    """+1 or -1 in each of 128 lanes for each shingle of words, summed; fewer words: the whole sequence."""
    words = paragraph.split()
    if not words:
        return np.zeros(NEAR, np.int64)
    grams = [b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
    raw = b"".join(map(xxhash.xxh3_128_digest, grams))
    lanes = np.zeros(NEAR, np.int64)
    for at in range(0, len(raw), 1 << 18):  # 16,384 shingles at a time: memory stays small for any length
        bits = np.unpackbits(np.frombuffer(raw[at : at + (1 << 18)], np.uint8).reshape(-1, 16), axis=1)
        lanes += 2 * bits.sum(0, dtype=np.int64) - len(bits)
    return lanes


class Fingerprint:
    """A sum over a multiset of paragraphs: ``add`` and ``remove`` in any order give the same fingerprint."""

    __slots__ = ("wide", "near")

    def __init__(self) -> None:
        self.wide, self.near = np.zeros(WIDE, np.uint64), np.zeros(NEAR, np.int64)

    @classmethod
    def of(cls, text: str) -> Fingerprint:
        out = cls()
        for p in text.split("\n"):
            out.add(p)
        return out

    def copy(self) -> Fingerprint:
        out = Fingerprint()
        out.wide, out.near = self.wide.copy(), self.near.copy()
        return out

    def add(self, paragraph: str) -> None:
        data = paragraph.encode("utf-8", "surrogatepass")
        self.wide += np.frombuffer(hashlib.blake2b(data, digest_size=8 * WIDE).digest(), "<u8")
        self.near = (self.near + _near_lanes(data)) % _TURN

    def remove(self, paragraph: str) -> None:
        data = paragraph.encode("utf-8", "surrogatepass")
        self.wide -= np.frombuffer(hashlib.blake2b(data, digest_size=8 * WIDE).digest(), "<u8")
        self.near = (self.near - _near_lanes(data)) % _TURN

    def hex(self) -> str:
        return self.wide.astype("<u8").tobytes().hex() + self.near.astype("<u4").tobytes().hex()

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints, else the cosine of the centred likeness lanes, cut off at 0."""
        if (self.wide == other.wide).all() and (self.near == other.near).all():
            return 1.0
        a, b = (((x.near + _HALF) % _TURN - _HALF).astype(np.float64) for x in (self, other))
        norm = float(np.sqrt((a @ a) * (b @ b)))
        return min(1.0, max(0.0, float(a @ b) / norm)) if norm else 0.0


def replaced_tail(text: str, fingerprint: Fingerprint, following: str) -> tuple[str, Fingerprint]:
    """The text with its last floor(n/4) code points replaced by the first as many of ``following``, and its fingerprint.

    Only the paragraphs that the edit touches are hashed: the old ones are removed from the sum and the new ones added.
    """
    cut = len(text) - len(text) // 4
    fresh = following[: len(text) // 4]
    edited = text[:cut] + fresh
    start = text.rfind("\n", 0, cut) + 1  # the paragraph that holds the cut
    out = fingerprint.copy()
    for p in text[start:].split("\n"):
        out.remove(p)
    for p in edited[start:].split("\n"):
        out.add(p)
    return edited, out


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint each document and its edit with the next document by ascending doc_id (the last: the first).

    A fingerprint is the sum over the text's paragraphs (split at line feeds) of wide vectors: 8 lanes of 64 bits of BLAKE2b
    modulo 2**64 for equality, and 128 lanes modulo 2**32 of +-1 per 3-word shingle, whose cosine is the likeness. It does not
    depend on the order of paragraphs, and edits add and subtract only the paragraphs they touch.

    Null texts count as empty (near 1 to other empty texts, 0 to others); null ids come last; ties in doc_id are ordered by text;
    a single document is its own next; an empty table gives an empty result; extra columns are ignored.
    Rows that share an id, or have none, are in one range. Very long texts: 16,384 shingles at a time. Likeness is right for texts of
    fewer than 2**31 shingles. The texts are shuffled once, in ranges of doc_id; the first document of each range goes to the range before as well.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    ids = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000), F.min("doc_id"), F.count(F.lit(1)), F.count("doc_id"))
    cuts, first, rows, known = ids.first()
    bounds = sorted(set(cuts or [])) if n > 1 else []
    bounds = [b for b in bounds if first is not None and b > first]
    last = len(bounds)  # the number of the last range; null ids fall into it, and any row there may be the last one
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = F.array(F.struct(search(F.col("doc_id"), bounds).alias("range"), F.lit(0).alias("ahead")))
    at = F.when(F.col("doc_id").isin(bounds), F.array(F.struct((search(F.col("doc_id"), bounds) - 1).alias("range"), F.lit(1).alias("ahead")))) if bounds else F.lit(None)
    wrap = F.col("doc_id").eqNullSafe(F.lit(first))
    again = F.when(wrap, F.array(F.struct(F.lit(last).alias("range"), F.lit(2).alias("ahead"))))
    empty = own.getItem(0)
    extra = lambda c: F.coalesce(c, F.filter(F.array(empty), lambda _: F.lit(False))) if bounds or c is again else F.filter(F.array(empty), lambda _: F.lit(False))
    dealt = base.withColumn("to", F.explode(F.concat(own, extra(at), extra(again)))).select("to.range", "to.ahead", "doc_id", "text")
    placed = dealt.repartitionById(last + 1, F.col("range")).sortWithinPartitions("range", "ahead", F.col("doc_id").asc_nulls_last(), "text")
    return placed.mapInPandas(_stream, OUT)


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of whole ranges in order: the following row is the next document. Only the row before is held."""
    held = None
    out: list[tuple] = []
    closed = None
    for batch in batches:
        for where, ahead, doc_id, text in batch.itertuples(index=False, name=None):
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            mark = Fingerprint.of(text) if held is not None or not ahead else None
            if held is not None and held[0] == where:
                _, d, t, f = held
                edited, changed = replaced_tail(t, f, text)
                digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((d, len(t), digest, f.hex(), changed.hex(), f.likeness(changed), f.likeness(mark)))
            held = None if ahead else (where, doc_id, text, mark)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"doc_id": "Int64"})
        out = []

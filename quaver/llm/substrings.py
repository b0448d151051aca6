"""Removal of repeated passages with sharded Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import materialize, partitions, small_batches

WINDOW = 50
#: The key of a window is the least hash of its runs of GRAM words. Equal windows have equal keys, whatever is around them.
GRAM = 20
#: Words of a phrase in an automaton. Any window of a passage holds a whole one of the phrases that start each BLOCK words.
BLOCK = 25
#: Bytes of text that one automaton is for (some ten times that in memory, at most), and rows handled at once by it.
SHARD_BYTES, ROWS = 1 << 22, 1000
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, size: int, odd: np.uint64 = _ODD[0]) -> np.ndarray:
    """A hash of each ``size`` consecutive words."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for j in range(size):
            out = out * odd + hashes[j : j + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def _slide(x: np.ndarray, size: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each ``size`` consecutive values, in a logarithmic number of passes."""
    pick, out, have = (np.minimum if least else np.maximum), x, 1
    while have < size:
        step = min(have, size - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def window_keys(hashes: np.ndarray) -> np.ndarray:
    """The key of each window of a text."""
    return _slide(run_hashes(hashes, GRAM), WINDOW - GRAM + 1, True) if len(hashes) >= WINDOW else np.zeros(0, np.uint64)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for text in b["text"]:
            words = split_words(text)
            found = np.unique(window_keys(word_hashes(words))) if len(words) >= WINDOW else np.zeros(0, np.uint64)
            rows.append((len(words), _digest(words), found.view(np.int64)))
        made = pd.DataFrame(rows, columns=["n_words", "kept_sha256", "seeds"])
        yield made.assign(doc_id=b["doc_id"].astype("Int64").array, a=b["a"].array, b=b["b"].array)[["doc_id", "a", "b", "n_words", "kept_sha256", "seeds"]]


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What neighbouring windows of one recurring key cover: some 65 words, or all of a text that repeats itself."""
    names = ["doc_id", "a", "b", "start", "seed", "c", "d", "text"]
    for batch in batches:
        rows = []
        for doc_id, x, y, text, wanted in batch[["doc_id", "a", "b", "text", "wanted"]].itertuples(index=False, name=None):
            words = split_words(text)
            keys = window_keys(word_hashes(words))
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            some = np.isin(keys[edges[:-1]].view(np.int64), np.asarray(wanted, np.int64))
            for lo, hi in zip(edges[:-1][some].tolist(), edges[1:][some].tolist(), strict=True):
                part = b" ".join(words[lo : hi + WINDOW - 1])
                c, d = np.frombuffer(xxhash.xxh3_128_digest(part), "<i8").tolist()
                rows.append((int(doc_id), int(x), int(y), lo, int(keys[lo].view(np.int64)), c, d, part.decode("utf-8", "surrogatepass")))
                if len(rows) >= 5000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        yield pd.DataFrame(rows, columns=names)


class _Texts:
    """Several texts end to end: hashes of all words, and hashes of all windows with the text and place they start at."""

    def __init__(self, texts: list[str]) -> None:
        split = [split_words(t) for t in texts]
        self.sizes = np.array([len(w) for w in split], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.hashes = word_hashes([w for words in split for w in words])
        row = np.repeat(np.arange(len(split)), self.sizes)
        at = np.arange(len(row)) - self.starts[row]
        self.whole = np.flatnonzero(at + WINDOW <= self.sizes[row])  # where windows start
        self.row, self.at = row[self.whole], at[self.whole]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(run_hashes(self.hashes, WINDOW, odd)[self.whole].view(np.int64) for odd in _ODD)

    def letters(self, separated: bool) -> list[int]:
        """Words as letters of the automata, 31-bit numbers from 1; 0 stands between texts."""
        out = (self.hashes % np.uint64((1 << 31) - 1)).astype(np.int64) + 1
        return (np.insert(out, self.starts, 0) if separated else out).tolist()


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct windows of each stretch."""
    for b in batches:
        t = _Texts(b["text"].tolist())
        w1, w2 = t.windows()
        made = pd.DataFrame({"w1": w1, "w2": w2, "first": b["first"].to_numpy()[t.row], "last": b["last"].to_numpy()[t.row], "c": b["c"].to_numpy()[t.row], "d": b["d"].to_numpy()[t.row], "at": t.at})
        yield made.drop_duplicates(["w1", "w2", "c", "d"])


def _passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The runs of recurring windows of the stretches that have them first."""
    for b in batches:
        rows = []
        for seed, first, text, starts in b[["seed", "first", "text", "starts"]].itertuples(index=False, name=None):
            words = split_words(text)
            starts = np.unique(np.asarray(starts, np.int64))
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                rows.append((int(seed), int(first), b" ".join(words[int(run[0]) : int(run[-1]) + WINDOW]).decode("utf-8", "surrogatepass")))
        yield pd.DataFrame(rows, columns=["seed", "first", "text"])


class PhraseAutomaton:
    """An Aho-Corasick automaton over the phrases of passages, and the first document of each of their windows."""

    def __init__(self, passages: list[tuple[int, str]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        self.first: dict[tuple[int, int], int] = {}
        for at in range(0, len(passages), ROWS):
            some = passages[at : at + ROWS]
            t = _Texts([text for _, text in some])
            letters = t.letters(separated=False)
            for lo, n in zip(t.starts.tolist(), t.sizes.tolist(), strict=True):
                for i in range(lo, lo + n - BLOCK + 1, BLOCK):
                    self.automaton.add_word(tuple(letters[i : i + BLOCK]))
            owners = np.array([doc for doc, _ in some], np.int64)[t.row].tolist()
            for key, doc in zip(zip(*map(np.ndarray.tolist, t.windows()), strict=True), owners, strict=True):
                if doc < self.first.get(key, doc + 1):
                    self.first[key] = doc
        if self.first:
            self.automaton.make_automaton()

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(lo, hi, first) for each text: its words from lo to hi are covered by windows that start first in document ``first``.

        The automaton finds the phrases; the windows that hold one are looked up. Time grows with the texts' length alone.
        """
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        t = _Texts(texts)
        if not self.first or not len(t.whole):
            return out
        ends = np.array([end for end, _ in self.automaton.iter(tuple(t.letters(separated=True)))], np.int64)
        if not len(ends):
            return out
        ends -= np.searchsorted(t.starts + np.arange(1, len(texts) + 1), ends, "right")  # without the separators
        edge = np.zeros(len(t.hashes) + 1, np.int64)
        np.add.at(edge, np.maximum(0, ends + 1 - WINDOW), 1)  # the windows that hold the phrase, crossing ones included
        np.add.at(edge, ends - BLOCK + 2, -1)
        near = np.flatnonzero(np.cumsum(edge)[t.whole] > 0)
        w1, w2 = t.windows()
        get = self.first.get
        owner = [get(k, -1) for k in zip(w1[near].tolist(), w2[near].tolist(), strict=True)]
        row, at, has = t.row[near], t.at[near], np.array([o != -1 for o in owner], bool)
        previous = None
        for i in np.flatnonzero(has).tolist():
            r, a, o = int(row[i]), int(at[i]), owner[i]
            if previous == (r, a - 1, o):
                lo, _, _ = out[r][-1]
                out[r][-1] = (lo, a + WINDOW, o)
            else:
                out[r].append((a, a + WINDOW, o))
            previous = (r, a, o)
        return out


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of whole shards: first the passages, then the stretches that may hold them."""
    at, passages, automaton = None, [], None
    for b in batches:
        for (shard, salt), part in b.groupby(["shard", "salt"], sort=False):
            if (shard, salt) != at:
                at, passages, automaton = (shard, salt), [], None
            known = part["kind"].to_numpy() == 0
            passages += zip(part["c"].to_numpy()[known].tolist(), part["text"].to_numpy()[known].tolist(), strict=True)
            if known.all():
                continue
            if automaton is None:
                automaton, passages = PhraseAutomaton(passages), []
            streamed = part[~known]
            found = automaton.spans(streamed["text"].tolist())
            rows = [(c, d, [{"lo": lo, "hi": hi, "first": o} for lo, hi, o in f]) for c, d, f in zip(streamed["c"], streamed["d"], found, strict=True) if f]
            yield pd.DataFrame(rows, columns=["c", "d", "found"])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for x, y, text, spans in b[["a", "b", "text", "spans"]].itertuples(index=False, name=None):
            words = split_words(text)
            edge = np.zeros(len(words) + 1, np.int64)
            for s in spans:
                edge[s["lo"]] += 1
                edge[s["hi"]] -= 1
            kept = [w for w, gone in zip(words, np.cumsum(edge[:-1]) > 0, strict=True) if not gone]
            rows.append((int(x), int(y), len(words) - len(kept), _digest(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
        yield pd.DataFrame(rows, columns=["a", "b", "n_removed", "cut_sha256", "cut_text"])


KEY = "a long, b long"


def remove_repeated_passages(docs: DataFrame) -> DataFrame:
    """Remove words covered by a window of 50 words that also starts in a document of smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and kept_text (null where nothing
    was removed). A window's key depends on its words alone, so only windows whose key recurs in another text can recur. What
    neighbouring windows of one key cover is a stretch; equal stretches are handled once. Windows found in two documents are
    confirmed by their hashes and merged into passages, which are compiled into automata, sharded by key. Every stretch is streamed
    through the automaton of its key, hot shards in several copies. Texts equal as a whole are handled once.

    Null and empty texts have no words. Documents without doc_id are neither changed nor compared. Rows that share a doc_id don't
    remove each other's words. Repeated rows get equal results; an empty table an empty one. Extra columns are ignored.
    Time and memory grow with a text's length, also where it repeats one word.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))
    scanned = materialize(keyed.mapInPandas(_scan, f"doc_id long, {KEY}, n_words long, kept_sha256 string, seeds array<long>"))
    known = scanned.where("doc_id IS NOT NULL")
    firsts = known.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"))

    # keys of different texts, and the texts that hold them
    distinct = materialize(known.where(F.size("seeds") > 0).groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"), F.first("seeds").alias("seeds")))
    held = distinct.select("a", "b", "doc_id", F.explode("seeds").alias("seed"))
    recurring = held.groupBy("seed").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo < hi").select("seed")
    wanted = held.join(recurring, "seed").groupBy("a", "b", "doc_id").agg(F.collect_list("seed").alias("wanted"))  # a text's own keys
    some = materialize(keyed.join(wanted, ["a", "b", "doc_id"]))
    row = f"doc_id long, {KEY}, start long, seed long, c long, d long, text string"
    stretches = materialize(some.mapInPandas(_stretches, row))
    each = materialize(stretches.groupBy("c", "d").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.first("seed").alias("seed"), F.first("text").alias("text")))

    windows = each.mapInPandas(_windows, "w1 long, w2 long, first long, last long, c long, d long, at long")
    place = F.min(F.struct("first", "c", "d", "at")).alias("place")
    recurs = windows.groupBy("w1", "w2").agg(place, F.max("last").alias("last")).where("place.first < last")
    starts = recurs.groupBy("place.c", "place.d").agg(F.collect_list("place.at").alias("starts"))  # within one stretch
    passages = materialize(each.join(starts, ["c", "d"]).mapInPandas(_passages, "seed long, first long, text string"))

    size = each.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64("seed"), F.lit(max(1, -(-size // SHARD_BYTES)))).alias("shard")
    copies = each.groupBy(shard).agg(F.ceil(F.sum(F.octet_length("text")) / (2 * SHARD_BYTES)).alias("copies"))
    streams = each.withColumn("shard", shard).join(copies, "shard").select("shard", F.pmod(F.xxhash64("c", "d"), "copies").alias("salt"), F.lit(1).alias("kind"), "c", "d", "text")
    phrases = passages.withColumn("shard", shard).join(copies, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("first").alias("c"), F.lit(0).cast("long").alias("d"), "text"
    )
    dealt = phrases.unionByName(streams).repartition(partitions(spark), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    found = dealt.mapInPandas(_stream, "c long, d long, found array<struct<lo: long, hi: long, first: long>>")
    earlier = F.filter("found", lambda s: s["first"] < F.col("doc_id"))
    placed = stretches.select("doc_id", "a", "b", "start", "c", "d").join(found, ["c", "d"]).withColumn("spans", F.transform(earlier, lambda s: F.struct((s["lo"] + F.col("start")).alias("lo"), (s["hi"] + F.col("start")).alias("hi"))))
    spans = placed.where(F.size("spans") > 0).groupBy("a", "b").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    once = some.select("a", "b", "text").dropDuplicates(["a", "b"])
    cut = spans.join(once, ["a", "b"]).mapInPandas(_cut, f"{KEY}, n_removed long, cut_sha256 string, cut_text string")

    texts = firsts.withColumnRenamed("doc_id", "first_doc").join(cut, ["a", "b"], "left")
    both = scanned.drop("seeds").join(texts, ["a", "b"], "left")
    copied = (F.col("doc_id") > F.col("first_doc")) & (F.col("n_words") >= WINDOW)
    changed = F.col("n_removed").isNotNull() & F.col("doc_id").isNotNull()
    return both.select(
        "doc_id", "n_words",
        F.when(copied, F.col("n_words")).when(changed, F.col("n_removed")).otherwise(F.lit(0)).alias("n_removed"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).when(changed, F.col("cut_sha256")).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copied, F.lit("")).when(changed, F.col("cut_text")).alias("kept_text"),
    )

"""Document quality by a sparse ensemble of rules over text statistics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import held_out, materialize, small_batches, training_rows

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "long_word", "distinct_words", "log_distinct", "top_word", "same_neighbours", "distinct_pairs",
    "lower", "upper", "digits", "stops", "symbols", "high_bytes", "spaces", "lines", "distinct_lines", "top_line", "words_in_line", "ended_words",
)


def _byte_classes() -> np.ndarray:
    """0 lower case, 1 upper case, 2 digit, 3 sentence punctuation, 4 other ASCII, 5 white space, 6 beyond ASCII."""
    out = np.full(256, 4, np.uint8)
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = 0, 1, 2
    out[[ord(c) for c in ".,;:?'\"()-"]] = 3
    out[[9, 10, 11, 12, 13, 32]], out[128:] = 5, 6
    return out


_CLASS = _byte_classes()


def statistics(text: str) -> tuple[float, ...]:
    """STATISTICS of a whole text; all 0 but for shares of nothing, which are 1, in an empty one."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=7) / max(n, 1)
    words = data.split()
    w = len(words)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x]
    line_counts = Counter(lines)
    neighbours = list(zip(words, words[1:], strict=False))
    return (
        math.log1p(n), math.log1p(w), (n - kinds[5] * n) / max(w, 1), float(max(map(len, counts), default=0)), len(counts) / w if w else 1.0, math.log1p(len(counts)),
        max(counts.values(), default=0) / max(w, 1), sum(a == b for a, b in neighbours) / max(w - 1, 1), len(set(neighbours)) / len(neighbours) if neighbours else 1.0,
        *(float(k) for k in (kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[6], kinds[5])),
        math.log1p(len(lines)), len(line_counts) / len(lines) if lines else 1.0, max(line_counts.values(), default=0) / max(len(lines), 1), w / max(len(lines), 1),
        sum(c for x, c in counts.items() if x[-1:] in b".,;:!?") / max(w, 1),
    )


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the STATISTICS of each whole text; null counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = pd.DataFrame([statistics(t) for t in b["text"]], columns=list(STATISTICS), dtype=np.float64)
            made.insert(0, "doc_id", b["doc_id"].astype("Int64").array)
            yield made

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass
class Rule:
    """A conjunction of (statistic, at most the threshold or above it, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, low, t in self.terms:
            out &= (x[:, k] <= t) if low else (x[:, k] > t)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, low, t in self.terms:
            out = out & ((F.col(STATISTICS[k]) <= F.lit(t)) if low else (F.col(STATISTICS[k]) > F.lit(t)))
        return out


@dataclass
class RuleEnsemble:
    rules: list[Rule] = field(default_factory=list)
    offset: float = 0.0

    def column(self) -> Column:
        """The ensemble as one Spark expression over the statistics: probability of label 1."""
        margin = F.lit(self.offset)
        for r in self.rules:
            margin = margin + F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def _tree_rules(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, least: int) -> list[Rule]:
    """All paths from the root of one regression tree, inner nodes as well."""
    out: list[Rule] = []

    def grow(rows: np.ndarray, terms: tuple) -> None:
        if terms:
            out.append(Rule(tuple(terms)))
        if len(terms) >= depth or len(rows) < 2 * least:
            return
        best = (1e-12, None)
        for k in rng.permutation(x.shape[1])[: max(3, x.shape[1] // 2)]:
            v = x[rows, k]
            cuts = np.unique(np.quantile(v, np.linspace(0.02, 0.98, 25)))
            place = np.searchsorted(cuts, v, side="left")  # v <= cuts[j] for j >= place
            n = np.cumsum(np.bincount(place, minlength=len(cuts) + 1))[:-1]
            s = np.cumsum(np.bincount(place, y[rows], minlength=len(cuts) + 1))[:-1]
            ok = (n >= least) & (len(rows) - n >= least)
            if not ok.any():
                continue
            total = y[rows].sum()
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(len(rows) - n, 1) - total**2 / len(rows), -1)
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (float(gain[j]), (int(k), float(cuts[j])))
        if best[1] is None:
            return
        k, t = best[1]
        below = x[rows, k] <= t
        grow(rows[below], (*terms, (k, True, t)))
        grow(rows[~below], (*terms, (k, False, t)))

    grow(np.arange(len(x)), ())
    return out


def _lasso(features: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1 logistic weights by accelerated proximal gradients; the offset is free."""
    n, m = features.shape
    scale = np.maximum(features.std(0), 1e-3)
    centre = features.mean(0)
    z = (features - centre) / scale
    bound = 0.25 * (np.linalg.norm(z, 2) ** 2 / n + 1)
    w, b = np.zeros(m), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    u, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-np.clip(z @ u + c, -30, 30))) - y
        w2 = u - (z.T @ g / n) / bound
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - penalty / bound, 0)
        b2 = c - g.mean() / bound
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        u, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    w = w / scale
    return w, float(b - centre @ w)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, penalty: float = 0.002, seed: int = 42) -> RuleEnsemble:
    """Rules from boosted trees on subsamples, then sparse weights. One class, no rows, or too few to split: a constant."""
    if not len(y) or y.min() == y.max():
        return RuleEnsemble([], 0.0 if not len(y) else (4.0 if y[0] else -4.0))
    rng = np.random.default_rng(seed)
    margin, found = np.full(len(y), math.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        rows = rng.choice(len(y), max(2, min(len(y), max(len(y) // 2, 200))), replace=False)
        residual = y - 1 / (1 + np.exp(-margin))
        paths = _tree_rules(x[rows], residual[rows], depth, rng, least=max(5, len(rows) // 400))
        inner = {r.terms[:-1] for r in paths}
        for r in paths:
            found.setdefault(frozenset(r.terms), r)
            if r.terms not in inner:  # a leaf: one boosting step
                hit = r.holds(x)
                p = 1 / (1 + np.exp(-margin[hit]))
                if hit.any():
                    margin[hit] += 0.3 * np.clip((y[hit] - p).sum() / ((p * (1 - p)).sum() + 1.0), -4, 4)
    rules = list(found.values())
    if not rules:  # too few rows to split
        return RuleEnsemble([], math.log(y.mean() / (1 - y.mean())))
    features = np.stack([r.holds(x) for r in rules], 1).astype(np.float64)
    weights, offset = _lasso(features, y, penalty)
    kept = [Rule(r.terms, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6]
    return RuleEnsemble(kept, offset)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """Learn from at most ``limit`` labelled documents that aren't held out, and score all: doc_id, held_out, score, predicted.

    Only the sample's statistics reach the driver. The rules become one expression over the statistics of each whole text.
    Null texts count as empty ones; both get a score. Repeated rows are scored alike; null ids are not held out; an empty
    table gives an empty result; without labels of both kinds the score is a constant. Extra columns are ignored. Very long texts:
    a text's words and pairs of words are counted in memory, in proportion to its length.
    """
    stats = materialize(text_statistics(docs))
    rows = training_rows(labels, label, limit)
    # of repeated ids one row is learned from, so that the sample stays within its bound
    one = F.min(F.struct(*STATISTICS, "label")).alias("one")
    sample = stats.join(F.broadcast(rows), "doc_id").groupBy("doc_id").agg(one).select("doc_id", "one.*").orderBy("doc_id").toPandas()
    model = fit_rules(sample[list(STATISTICS)].to_numpy(np.float64), sample["label"].to_numpy(np.float64))
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

"""Toxic passages by maximum-scoring segments of token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import held_out, materialize, small_batches, training_rows

_TOKEN = re.compile(r"[^\W\d_]+")
#: Lengths of stems; a word scores by the likeliest of itself and its stems.
STEMS = (8, 7, 6, 5, 4, 3)
#: Tokens whose scores a worker remembers before it starts afresh.
REMEMBERED = 200_000
#: Parts of the sample; each is scored for the calibration with the tokens of the others.
FOLDS = 5
#: A token's log-odds are bounded on both sides, so that no single word decides.
LOWEST, HIGHEST = -2.0, 8.0


def tokens_of(text: str) -> list[str]:
    """Runs of letters in lower case: the tokens of the fit and of the scores."""
    return _TOKEN.findall(text.lower())


def units(token: str) -> list[str]:
    """A token and its stems."""
    return [token, *("^" + token[:n] for n in STEMS if len(token) > n)]


@dataclass
class ToxicityModel:
    """Token scores, the drift of all tokens, and the calibration."""

    weights: dict[str, float]
    drift: float = 0.2
    rate: float = 1.0
    size: float = 1.0
    slope: float = 1.0
    offset: float = -3.0

    def token_scores(self, tokens: list[str], known: _Scores | None = None) -> list[float]:
        """Log-odds less the drift; the k-th occurrence of a positive token in a text counts 1/k of it."""
        known = _Scores(self) if known is None else known
        if len(known) > REMEMBERED:
            known.clear()
        out = list(map(known.__getitem__, tokens))
        times: dict[str, int] = {}
        for i in [i for i, x in enumerate(out) if x > 0]:
            times[tokens[i]] = k = times.get(tokens[i], 0) + 1
            out[i] /= k
        return out

    def surprise(self, segment_score: float, n: int) -> float:
        """-ln of the chance that a clean text of n tokens has a segment of this score (Gumbel tail)."""
        log_e = math.log(self.size * max(n, 1)) - self.rate * segment_score
        return -log_e if log_e < -30 else -math.log(-math.expm1(-math.exp(min(log_e, 30))) or 1e-300)

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Joint surprise of all segments of a text, on a log scale."""
        return math.log1p(sum(max(0.0, self.surprise(s, n)) for _, _, s in segments))

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, self.slope * evidence + self.offset))))


class _Scores(dict):
    """Scores of the tokens met so far."""

    def __init__(self, model: ToxicityModel) -> None:
        super().__init__()
        self.weights, self.drift = model.weights, model.drift

    def __missing__(self, token: str) -> float:
        known = [w for u in units(token) if (w := self.weights.get(u)) is not None]
        self[token] = out = (max(LOWEST, min(HIGHEST, max(known))) if known else 0.0) - self.drift
        return out


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) in linear time (Ruzzo and Tompa 1999)."""
    segments: list[list[float]] = []  # start, end, sum before, sum after
    sums = list(accumulate(scores, initial=0.0))
    for i in [i for i, x in enumerate(scores) if x > 0]:
        new = [i, i + 1, sums[i], sums[i + 1]]
        while True:
            j = len(segments) - 1
            while j >= 0 and segments[j][2] >= new[2]:
                j -= 1
            if j < 0 or segments[j][3] >= new[3]:
                segments.append(new)
                break
            new = [segments[j][0], new[1], segments[j][2], new[3]]
            del segments[j:]
    return [(int(a), int(b), hi - lo) for a, b, lo, hi in segments]


def token_counts(sample: DataFrame) -> DataFrame:
    """How many distinct words of the texts of each (label, fold) are or begin with each unit: unit, label, fold, n."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: dict[tuple[int, int], Counter] = {}
            for text, label, fold in zip(b["text"], b["label"], b["fold"], strict=True):
                own = found.setdefault((int(label), int(fold)), Counter())
                for word in set(tokens_of(text)):
                    own.update(units(word))
                own[""] += len(set(tokens_of(text)))  # all distinct words
            for (label, fold), own in found.items():
                yield pd.DataFrame({"unit": list(own), "label": label, "fold": fold, "n": list(own.values())})

    return sample.select("text", "label", "fold").mapInPandas(count, "unit string, label int, fold int, n long")


def token_weights(sample: DataFrame, prior: float = 3000.0, least_z: float = 2.5, lowered: float = 1.0) -> list[dict[str, float]]:
    """Log-odds of words and stems with a Dirichlet prior, from sample rows (text, label, fold): of all, then without each fold.

    The prior is ``prior`` words spread as in the whole sample, so a rare token is drawn to even odds. Tokens of either sign whose
    z-score reaches ``least_z`` are kept, nearer to even odds by ``lowered`` standard errors; those of the toxic side must be in
    the words of at least two texts. What reaches the driver is bounded by the words of the labelled sample.
    """
    case = lambda label, fold: F.coalesce(F.sum(F.when((F.col("label") == label) & (F.col("fold") == fold), F.col("n"))), F.lit(0)).alias(f"n{label}{fold}")
    counts = materialize(token_counts(sample).groupBy("unit").agg(*[case(y, f) for y in (0, 1) for f in range(FOLDS)]))
    whole = counts.where("unit = ''").first()
    if whole is None:
        return [{}] * (FOLDS + 1)
    names = {"all": range(FOLDS)} | {f"not{f}": [g for g in range(FOLDS) if g != f] for f in range(FOLDS)}
    scored = counts.where("unit <> ''")
    for name, folds in names.items():
        total = [max(1.0, float(sum(whole[f"n{y}{f}"] for f in folds))) for y in (0, 1)]
        n = [sum((F.col(f"n{y}{f}") for f in folds), F.lit(0.0)) for y in (0, 1)]
        share = (n[0] + n[1]) / F.lit(sum(total))
        a = [n[y] + share * prior for y in (0, 1)]
        odds = [F.log(a[y] / (F.lit(total[y] + prior) - a[y])) for y in (0, 1)]
        delta, error = odds[1] - odds[0], F.sqrt(1 / a[0] + 1 / a[1])
        weight = F.when(delta / error >= least_z, F.when(n[1] >= 2, delta - lowered * error)).when(delta / error <= -least_z, delta + lowered * error)
        scored = scored.withColumn(f"w_{name}", F.when(n[0] + n[1] > 0, weight))
    rows = scored.select("unit", *[f"w_{k}" for k in names]).where(F.coalesce(*[f"w_{k}" for k in names]).isNotNull()).collect()
    return [{r["unit"]: float(r[f"w_{k}"]) for r in rows if r[f"w_{k}"] is not None} for k in names]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = 20_000) -> ToxicityModel:
    """Learn from at most ``limit`` labelled documents that aren't held out.

    Token scores come from all of them. For the calibration each of FOLDS parts is scored with the tokens of the others: the rate and
    size of the Gumbel law from the best segments of the clean texts and their lengths, then a logistic curve from the evidence
    of all segments to the probability, in which the rarer class counts more (see _logistic).
    Of rows that share a labelled id the one with the least text is learned from, so the bound holds for any table. Without labels of both kinds the score is a constant.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = materialize(training_rows(labels, label, limit).withColumn("fold", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(FOLDS)).cast("int")))
    labelled = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")  # rows are bounded by the sample
    sample = materialize(labelled.groupBy("doc_id", "label", "fold").agg(F.min("text").alias("text")))
    every, *others = token_weights(sample)
    model = ToxicityModel(every)
    sides = [ToxicityModel(w) for w in others]

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [_Scores(side) for side in sides]
        for b in batches:
            out = []
            for text, y, fold in zip(b["text"], b["label"], b["fold"], strict=True):
                tokens = tokens_of(text)
                found = [x for _, _, x in maximal_segments(sides[fold].token_scores(tokens, known[fold]))]
                out.append((int(y), len(tokens), max(found, default=0.0), found))
            yield pd.DataFrame(out, columns=["y", "n", "best", "found"])

    seen = materialize(sample.select("text", "label", "fold").mapInPandas(segments, "y int, n long, best double, found array<double>"))
    clean = seen.where("y = 0").select("best", "n").toPandas()  # at most ``limit`` rows of two numbers
    model.rate, model.size = gumbel(clean["best"].to_numpy(np.float64), clean["n"].to_numpy(np.float64))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "x": [model.evidence([(0, 0, s) for s in found], n) for found, n in zip(b["found"], b["n"], strict=True)]})

    points = seen.mapInPandas(weigh, "y int, x double").toPandas()
    x, y = points["x"].to_numpy(np.float64), points["y"].to_numpy(np.float64)
    if 0 < y.sum() < len(y):
        a, c = _logistic(x, y)
        model.slope, model.offset = float(max(a, 1e-3)), float(c)
    elif len(y):
        model.slope, model.offset = 0.0, 3.0 if y[0] else -3.0
    return model


def gumbel(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Rate and size of the law P(best <= s) = exp(-size * n * exp(-rate * s)) by maximum likelihood.

    A text without segments (best 0) only says that its best is not above 0.
    """
    hits = best > 0
    if hits.sum() < 3 or np.ptp(best[hits]) < 1e-9:
        return 1.0, max(1e-9, float(hits.sum()) / max(1.0, float(n.sum())))

    def slope(rate: float) -> float:
        e = n * np.exp(-rate * best)
        return 1 / rate - best[hits].mean() + float((e * best).sum() / e.sum())

    low, high = 1e-3, 20.0
    for _ in range(100):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    return low, max(1e-12, float(hits.sum() / (n * np.exp(-low * best)).sum()))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset by Newton's method with halved steps. A class weighs as the square root of its number: halfway between
    rows that all weigh alike, where a cut at 0.5 would spare the rare class, and classes that do."""
    design, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    w = np.sqrt(np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())))

    def loss(b: np.ndarray) -> float:
        m = design @ b
        return float((w * (np.logaddexp(0, m) - y * m)).sum() + ridge * b @ b / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -50, 50)))
        g = design.T @ (w * (p - y)) + ridge * beta
        step = np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), g)
        size = 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Score whole texts: ``keep`` columns, held_out, score, predicted, passages (start and end token, score).

    Null and empty texts have no passages and the score of no evidence. Rows are independent: repeated rows, null ids (not held out) and
    extra columns change nothing; an empty table gives an empty result. Very long texts: time and memory grow with the length.
    """
    small_batches(docs.sparkSession)
    held = F.struct(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Scores(model)
        for b in batches:
            scores, passages = [], []
            for text in b.column("text").to_pylist():
                tokens = tokens_of(text)
                found = maximal_segments(model.token_scores(tokens, known))
                scores.append(model.probability(model.evidence(found, len(tokens))))
                passages.append([{"start": a, "end": z, "score": s} for a, z, s in found if model.surprise(s, len(tokens)) > 3.0])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("kept"), pa.array(scores, pa.float64()), pa.array(passages, kind)], ["kept", "score", "passages"])

    kept = docs.select(held.alias("kept")).schema["kept"].dataType.simpleString()
    scored = docs.select(held.alias("kept"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, f"kept {kept}, score double, passages array<struct<start: bigint, end: bigint, score: double>>"
    )
    return scored.select("kept.*", held_out(F.col("kept.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")

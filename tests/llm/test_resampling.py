"""Importance resampling against plain Python, and edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quaver.llm import resampling

DOCS = "doc_id long, text string, bucket int, block long, weight string, rank int, n int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1))


def brute(docs, target, percent=5):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in s}
    rows = []
    for i, x in docs:
        words, counts = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain[b] for b, n in counts.items())
        rows.append([i, sum(counts.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    drawn = len(fit) * percent // 100
    place = {id(r): p + 1 for p, r in enumerate(fit[:drawn])}
    return sorted(((r[0], *r[1:4], place.get(id(r))) for r in rows), key=repr)


def run(spark, docs, target, **more):
    df = spark.createDataFrame([(i, t, 1, 1, "x", 1, 1) for i, t in docs], DOCS)
    aim = spark.createDataFrame([(0, t) for t in target], "item_id int, text string")
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in resampling.resample(df, aim, **more).collect()), key=repr)


TEXTS = [None, "", "one", "Two words", "x-y_z 9", "Ünï Éa 中文 word", "a\x00b\x7fc", *[" ".join(f"w{(i * k) % 37}" for i in range(k)) for k in (19, 20, 21, 40, 200, 999)], "the " * 300]


def test_against_python(spark):
    docs = [(i, TEXTS[i % len(TEXTS)]) for i in range(150)] + [(7, TEXTS[9]), (7, TEXTS[9]), (7, TEXTS[10]), (None, TEXTS[10]), (None, TEXTS[11])]
    target = ["w1 w2 w3 w4", "the the w5", None, "Two words"]
    assert run(spark, docs, target, percent=30) == brute(docs, target, 30)


def test_small_blocks_and_pieces_give_the_same(spark, monkeypatch):
    """Long texts cut into pieces, blocks closed early and several parts of cells change nothing."""
    docs = [(i, TEXTS[i % len(TEXTS)]) for i in range(40)] + [(100, " ".join(f"q{i % 501}" for i in range(4000)))]
    want = brute(docs, ["q1 q2", "w3"], 30)
    for name, value in (("TEXT_BYTES", 50), ("FEATURES", 100), ("CELL_BLOCKS", 2), ("BLOCK_DOCS", 16)):
        monkeypatch.setattr(resampling, name, value)
    batches = [resampling.pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs]})]
    monkeypatch.setattr(resampling, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
    rows = [r for b in resampling._indexed(10_000)(iter(batches)) for r in b.to_pylist()]
    named = {(r["block"], place): doc for r in rows if r["bucket"] < 0 for place, doc in enumerate(zip(r["ids"], r["features"], r["words"], strict=True))}
    got = {k: Counter() for k in named}
    for r in rows:
        if r["bucket"] >= 0:
            places, times = np.cumsum(resampling.unpack(r["places"])), resampling.unpack(r["times"]) + 1
            assert r["n"] == times.sum()
            for p, n in zip(places.tolist(), times.tolist(), strict=True):
                got[r["block"], p][r["bucket"]] += n
    assert len({b for b, _ in named}) > 5
    assert sorted((named[k][0], n) for k, c in got.items() for n in [tuple(sorted(c.items()))]) == sorted((i, tuple(sorted(features(t)[1].items()))) for i, t in docs)
    assert sorted((n[0], n[1], n[2]) for n in named.values()) == sorted((i, sum(features(t)[1].values()), len(features(t)[0])) for i, t in docs)
    monkeypatch.undo()
    assert run(spark, docs, ["q1 q2", "w3"], percent=30) == want


@pytest.mark.parametrize("values", [[], [0], [254, 255, 256, 0, 0, 509, 510, 511, 70_000]])
def test_pack(values):
    out, ends = resampling.pack(np.array(values, np.int64))
    assert resampling.unpack(out.tobytes()).tolist() == values and len(ends) == len(values)


def test_very_long_texts(spark):
    docs = [(1, "z" * 3_000_000), (2, "ab " * 600_000), (3, "é" * 800_000 + " end")]
    assert run(spark, docs, ["ab ab"]) == brute(docs, ["ab ab"])


def test_empty_tables(spark):
    assert run(spark, [], ["a"]) == []
    docs = [(i, TEXTS[i % len(TEXTS)]) for i in range(30)]
    assert run(spark, docs, [], percent=50) == brute(docs, [], 50)
    assert run(spark, [(1, None), (2, "")], []) == brute([(1, None), (2, "")], [])

"""Exact and approximate search of vectors against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaver.llm import topk, vptree

EXTRA = "vec_id long, embedding array<double>, label int, v string, region int, floor int, score string, shard string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", 1, 1, "x", "x") for i, v in rows], EXTRA)


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def best(rows, queries, k, score):
    out = {}
    for i, q in queries:
        scored = sorted(((-score(q, v), j) for j, v in rows if j != i and len(v) == len(q)))[:k]
        out.setdefault(i, []).append([(j, -s) for s, j in scored])
    return {i: sorted(lists) for i, lists in out.items()}


def listed(df):
    rows = df.collect()
    out = {}
    for r in rows:
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def dot(q, v):
    return sum(int(np.floor(1024 * a)) * int(np.floor(1024 * b)) for a, b in zip(q, v, strict=True))


def cosine(q, v):
    q, v = np.array(q, float), np.array(v, float)
    return float((v * q).sum() / (np.sqrt((v * v).sum()) * np.sqrt((q * q).sum())))


def test_topk_beyond_two_to_the_53rd(spark):
    """Scores near 2**61 that differ in the last digits, over many shards: floors must be integers."""
    r = random.Random(1)
    rows = [(i, [2**19 - r.randrange(4) / 1024 for _ in range(8)]) for i in range(400)]
    got = listed(topk.top_k(frame(spark, rows), F.col("vec_id") % 100 == 0, 10, shard_rows=16))
    want = best(rows, [x for x in rows if x[0] % 100 == 0], 10, dot)
    assert want[0][0][0][1] > 2**58
    assert {i: [sorted((j, s) for _, j, s in v)] for i, v in got.items()} == {i: [sorted(x) for x in v] for i, v in want.items()}


def test_topk_scores_a_long_cannot_hold(spark):
    rows = [(i, [1e300 if i % 2 else -1e300, float(i)]) for i in range(12)]
    got = listed(topk.top_k(frame(spark, rows), F.col("vec_id") == 0, 3))
    assert [(j, s) for _, j, s in sorted(got[0])] == [(2, 2**63 - 1), (4, 2**63 - 1), (6, 2**63 - 1)]


def clustered(seed, n, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim)) * 4
    return [(i, (centres[rng.integers(8)] + rng.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("shard_rows", [8192, 100])
def test_neighbours_are_exact_at_factor_one(spark, shard_rows):
    rows = clustered(2, 1200)
    rows += [(5000 + i, rows[i % 3][1]) for i in range(60)]  # ties
    got = listed(vptree.approximate_neighbours(frame(spark, rows), F.col("vec_id") % 50 == 0, 5, relax=1, shard_rows=shard_rows))
    want = best(rows, [x for x in rows if x[0] % 50 == 0], 5, cosine)
    assert set(got) == set(want)
    for i, v in got.items():
        assert [r for r, _, _ in sorted(v)] == [1, 2, 3, 4, 5]
        assert [j for _, j, _ in sorted(v)] == [j for j, _ in want[i][0]]
        assert [s for _, _, s in sorted(v)] == pytest.approx([s for _, s in want[i][0]], abs=1e-14)


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_recall_of_the_registered_query(spark, table):
    """Against brute force over the whole given table; the scores of what is found are exact."""
    df = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect() if good(r["embedding"]) and any(r["embedding"])]
    got = listed(vptree.approximate_neighbours(df, F.col("vec_id") % 50 == 0, 5, shard_rows=300))
    want = best(rows, [x for x in rows if x[0] % 50 == 0], 5, cosine)
    vectors = dict(rows)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert all(s == pytest.approx(cosine(vectors[i], vectors[j]), abs=1e-14) for i, v in got.items() for _, j, s in v)
    found = sum(len({j for _, j, _ in v} & {j for j, _ in want[i][0]}) for i, v in got.items())
    assert found >= 0.95 * 5 * len(got)


def test_a_larger_factor_skips_branches():
    """The factor does prune: with it fewer rows are looked at, and recall stays high where rows are clustered."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 3
    rows = centres[rng.integers(40, size=4000)] + rng.normal(size=(4000, 16))
    seen = {}
    for relax in (1.0, 2.0, 4.0):
        tree, looked = vptree.VantageTree(np.arange(4000), rows, relax), []
        inner = tree.cosines
        tree.cosines = lambda some, q, norm, inner=inner, looked=looked: looked.append(some.stop - some.start) or inner(some, q, norm)
        hits = [{j for _, j in tree.search(i, rows[i], 5, None)} for i in range(0, 4000, 50)]
        seen[relax] = (sum(looked), hits)
    assert seen[1.0][0] > seen[2.0][0] > seen[4.0][0]
    assert sum(len(a & b) for a, b in zip(seen[1.0][1], seen[2.0][1], strict=True)) >= 0.9 * 5 * 80


@pytest.mark.parametrize("shard_rows", [8192, 4])
def test_edge_cases(spark, shard_rows):
    """Nulls, zeros, odd lengths, repeated rows and ids, empty vectors, no candidate at all, clashing columns."""
    rows = [(0, [1, 0]), (0, [1, 0]), (0, [0, 1]), (1, [1, 1]), (1, [1, 1]), (2, [2, 2]), (3, None), (4, []), (5, [None, 1]), (6, [float("nan"), 1]), (7, [float("inf"), 1]), (8, [0, 0]), (None, [1, 1]), (9, [-1, 0]), (50, [1, 2, 3]), (100, [1e200, 1e200]), (10, [2.0**-1000, 0])]
    plain = [x for x in rows if x[0] is not None and good(x[1]) and any(x[1])]
    scale = lambda v: [x / max(map(abs, v)) for x in v]
    got = listed(vptree.approximate_neighbours(frame(spark, rows), F.col("vec_id") % 50 == 0, 5, relax=1, shard_rows=shard_rows))
    want = best(plain, [x for x in plain if x[0] % 50 == 0], 5, lambda q, v: cosine(scale(q), scale(v)))
    assert sorted(got) == [0, 100]  # 50 has no row of its length
    for i, lists in want.items():
        if i in got:
            assert sorted(r for r, _, _ in got[i]) == sorted(r for x in lists for r in range(1, len(x) + 1))
            assert sorted(round(s, 12) for _, _, s in got[i]) == sorted(round(s, 12) for x in lists for _, s in x)
            assert sorted(j for _, j, _ in got[i]) == sorted(j for x in lists for j, _ in x)
    exact = [x for x in rows if x[0] is not None and good(x[1]) and max(map(abs, x[1]), default=0) < 1e9]
    tops = listed(topk.top_k(frame(spark, [x for x in rows if x[0] != 100]), F.col("vec_id") % 50 == 0, 10, shard_rows=shard_rows))
    want = best(exact, [x for x in exact if x[0] % 50 == 0], 10, dot)
    assert {i: sorted((j, s) for _, j, s in v) for i, v in tops.items()} == {i: sorted(p for x in lists for p in x) for i, lists in want.items() if any(lists)}


def test_one_vector_in_most_rows(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(900)] + clustered(4, 100, 3)[50:]
    got = listed(vptree.approximate_neighbours(frame(spark, rows), F.col("vec_id") % 50 == 0, 5, relax=1, shard_rows=64))
    assert [j for _, j, _ in sorted(got[0])] == [1, 2, 3, 4, 5] and [j for _, j, _ in sorted(got[850])] == [0, 1, 2, 3, 4]


def test_empty_tables(spark):
    assert vptree.approximate_neighbours(frame(spark, []), F.lit(True)).count() == 0
    assert topk.top_k(frame(spark, []), F.lit(True)).count() == 0

"""The audit of filters: each order applied step by step in plain Python, and edge cases."""

import re
from collections import Counter
from itertools import permutations

import pytest

from quaver.llm import filter_audit

DOCS = "doc_id long, text string, lang string, source string, n int, mask int, e string, digest string, words long, good int"
LABELS = "doc_id long, quality int, toxic int, part string, n int"


def brute(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    bad = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t)) + "D" * bool(set(t) & set("#$%&*|"))
        fails += "E" * (i is not None and t in first and first[t] < i)
        bad.append((part or "", fails, any(j == i and q == 1 for j, q, _ in labels if j is not None), any(j == i and x == 1 for j, _, x in labels if j is not None)))
    out = {}
    for part in {b[0] for b in bad}:
        mine = [b[1:] for b in bad if b[0] == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, x in enumerate(order, 1):
                gone = [b for b in left if x in b[0]]
                total[x] += len(gone)
                before = [b for b in mine if set(b[0]) & set(order[: step - 1])]
                left = [b for b in left if x not in b[0]]
                out[part, order, step] = [len(left), len(gone), sum(x in b[0] for b in before), sum(b[0] == x for b in mine), sum(b[1] for b in gone), sum(b[2] for b in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def run(spark, docs, labels):
    df = spark.createDataFrame([(i, t, lang, "x", 7, 7, "x", "x", 7, 7) for i, t, lang in docs], DOCS)
    marks = spark.createDataFrame([(*x, "x", 7) for x in labels], LABELS)
    rows = filter_audit.audit(df, marks).collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in rows}) == len(rows)
    assert all(r["filter"] == r["filter_order"][r["step"] - 1] for r in rows)
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}


WORDS = [f"w{i}" for i in range(400)]
TEXTS = [None, "", "one", " \n\t ", "A B C", "50% off", " ".join(WORDS), " ".join(WORDS[:150] * 3), " ".join(["dull"] * 500), " ".join(WORDS[:100] * 2), "é" * 300 + " Ü", "ABC " + " ".join(WORDS), " ".join(WORDS[:199]), " ".join(WORDS) + " #", "word " * 30_000]


def test_against_every_order(spark):
    docs = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(TEXTS * 2)]
    docs += [(3, TEXTS[6], "en"), (3, TEXTS[6], "en"), (3, TEXTS[6], "de"), (3, TEXTS[7], "en"), (None, TEXTS[6], "en"), (None, "only here", "fr"), (None, "only here", "fr")]
    labels = [(i, (1, 0, None)[i % 3], (0, None, 1)[i % 3]) for i in range(20)] + [(4, 1, 1), (4, 0, 0), (999, 1, 1), (None, 1, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_every_step_accounts_for_all_documents(spark):
    docs = [(i, t, "en") for i, t in enumerate(TEXTS * 3)]
    got = run(spark, docs, [])
    for order in map("".join, permutations("ABCDE")):
        steps = [got["en", order, s] for s in range(1, 6)]
        assert [s[0] + sum(x[1] for x in steps[: i + 1]) for i, s in enumerate(steps)] == [len(docs)] * 5
    assert len({s[0] for (p, o, n), s in got.items() if n == 5}) == 1  # what is kept at last depends on no order


def test_a_hot_text_in_most_rows(spark):
    docs = [(i, "the same text", "en") for i in range(3000)] + [(5000 + i, f"text {i}", "en") for i in range(500)]
    got = run(spark, docs, [(2, 1, 1)])
    assert got["en", "EABCD", 1] == (501, 2999, 0, 0, 1, 1, got["en", "EABCD", 1][6])
    assert got["en", "ABCDE", 5][1] == 0 and got["en", "ABCDE", 5][2] == 2999


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)]])
def test_no_documents(spark, labels):
    assert run(spark, [], labels) == {}

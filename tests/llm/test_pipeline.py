"""Each stage of the corpus pipeline on what the stage before kept, against plain Python."""

import hashlib
import re

import pytest
import xxhash

import corpus_pipeline as cp
from quaver.llm import secrets, toxicity
from quaver.llm.common import materialize, table

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """(rows given, rows returned) of each stage."""
    docs, out = table(spark, SF, "documents"), []
    for _, stage in cp.STAGES:
        given = docs.collect()
        docs = materialize(stage(spark, docs, SF))
        out.append((given, docs.collect()))
    return out


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_stages_return_documents_until_the_last(stages):
    assert all(tuple(returned[0].__fields__) == cp.COLUMNS for _, returned in stages[:-1])
    assert all(len(given) and len(returned) for given, returned in stages)


def test_toxic_documents_go_and_others_stay(spark, stages):
    given, kept = stages[0]
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"), limit=20_000)

    def rejected(text):
        tokens = re.findall(r"[^\W\d_]+", (text or "").lower())
        return model.probability(model.evidence(toxicity.maximal_segments(model.token_scores(tokens)), len(tokens))) >= 0.5

    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in given if not rejected(r["text"]))
    toxic = {r["doc_id"] for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in table(spark, SF, "labels").where("toxic = 0").collect()}
    left = {r["doc_id"] for r in kept}
    assert len(toxic - left) >= 0.9 * len(toxic) and len(clean & left) >= 0.97 * len(clean)


def test_one_document_of_each_near_group_stays(stages):
    given, kept = stages[1]
    fps = {r["doc_id"]: plain_fingerprint(r["text"] or "") for r in given}
    root = {d: d for d in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in kept) == sorted(d for d in ids if find(d) == d)
    assert len(kept) < len(given)


def test_secrets_are_masked_and_the_rest_stays(stages):
    given, masked = stages[2]
    scorer = secrets.FormatScorer(secrets.labelled_credentials())
    found = {r["doc_id"]: r for r in masked}
    assert len(found) == len(given) == len(masked)
    changed = 0
    for r in given:
        text, hidden = r["text"] or "", [False] * len(r["text"] or "")
        for _, a, b in secrets.scan(text, scorer, 0.25)[1]:
            hidden[a:b] = [True] * (b - a)
        shown = "".join(c for c, h in zip(text, hidden, strict=True) if not h)
        out = found[r["doc_id"]]["text"]
        assert (out or "").replace("<REDACTED>", "") == shown.replace("<REDACTED>", "")
        changed += any(hidden)
        assert not any(hidden) or "<REDACTED>" in out
    assert changed


def test_the_mix_meets_its_targets(stages):
    given, mixed = stages[3]
    words = {r["doc_id"]: WORD.findall(r["text"] or "") for r in given}
    source, sizes = {r["doc_id"]: r["source"] for r in given}, {}
    for d, w in words.items():
        sizes[source[d]] = sizes.get(source[d], 0) + len(w)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    targets, open_ = {}, set(sizes)
    while True:
        left = 1.5 * sum(sizes.values()) - sum(targets.values())
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        targets |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
        if not full:
            targets |= {s: weight[s] * level for s in open_}
            break
    taken, times = {}, {}
    for r in mixed:
        w = WORD.findall(r["text"] or "")
        assert w == words[r["doc_id"]][: len(w)] and r["source"] == source[r["doc_id"]]
        taken[r["source"]] = taken.get(r["source"], 0) + len(w)
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 2
    assert all(abs(taken.get(s, 0) - t) <= 1 for s, t in targets.items())


def test_the_last_stage_encodes_as_the_library(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in stages[4][0]:
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], ids, hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((r["doc_id"], list(r["ids"]), r["decoded_sha256"]) for r in stages[4][1]) == sorted(want)


EDGE = [
    (1, "same words " * 40, "en", "a", 0), (1, "quite another text " * 30, "en", "a", 0), (2, "same words " * 40, "de", "b", 0), (2, "same words " * 40, "en", "b", 0),
    (None, "same words " * 40, "en", None, 0), (None, "without an id " * 30, None, "a", None), (None, "without an id " * 30, None, "a", None),
    (3, None, "en", "a", None), (4, "", "en", "b", 0), (5, "see password=abcdefgh and more " * 3000, "en", "a", 0), (6, " \n ", "en", "a", 0), (7, "last one here now", "en", "c", 0),
]


@pytest.fixture(scope="module")
def edge_rows(spark):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in EDGE], "doc_id long, text string, lang string, source string, n_chars long, row_key string, words int, id string, rest string")


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_empty_tables(spark, edge_rows, stage):
    assert cp.STAGES[stage][1](spark, edge_rows.limit(0), SF).count() == 0


def test_edge_rows_of_the_toxicity_stage(spark, edge_rows):
    out = cp.toxic_out(spark, edge_rows, SF)
    assert tuple(out.columns) == cp.COLUMNS and sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, EDGE))


def test_edge_rows_of_the_near_copies_stage(spark, edge_rows):
    kept = sorted(((r["doc_id"], r["text"], r["lang"]) for r in cp.near_copies_out(spark, edge_rows, SF).collect()), key=repr)
    # null, empty and white texts are one group; repeated rows and rows without id give way to the smallest id
    want = [(1, EDGE[0][1], "en"), (1, EDGE[1][1], "en"), (None, EDGE[5][1], None), (3, None, "en"), (5, EDGE[9][1], "en"), (7, EDGE[11][1], "en")]
    assert kept == sorted(want, key=repr)


def test_edge_rows_of_the_secrets_stage(spark, edge_rows):
    out = cp.secrets_masked(spark, edge_rows, SF).collect()
    want = [(d, t and t.replace("password=abcdefgh", "<REDACTED>"), x, s) for d, t, x, s, _ in EDGE]
    assert sorted(repr(tuple(r)[:4]) for r in out) == sorted(map(repr, want))
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out)


def test_edge_rows_of_the_mixing_stage(spark, edge_rows):
    out = cp.mixed(spark, edge_rows, SF).collect()
    words = {}
    for d, t, _, s, _ in EDGE:
        words[s] = words.get(s, 0) + len(WORD.findall(t or ""))
    taken = {}
    for r in out:
        taken[r["source"]] = taken.get(r["source"], 0) + len(WORD.findall(r["text"]))
        assert any(r["doc_id"] == d and WORD.findall(t or "")[: len(WORD.findall(r["text"]))] == WORD.findall(r["text"]) for d, t, *_ in EDGE)
    weight, targets, open_ = dict(zip(sorted(words, key=lambda s: (s is None, s or "")), (5, 2, 1, 5), strict=True)), {}, set(words)
    while open_:
        level = (1.5 * sum(words.values()) - sum(targets.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * words[s]}
        targets |= {s: 2.0 * words[s] for s in full} if full else {s: weight[s] * level for s in open_}
        open_ = open_ - full if full else set()
    assert all(abs(taken.get(s, 0) - t) <= 1 for s, t in targets.items())


def test_edge_rows_of_the_encoding_stage(spark, edge_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = cp.encoded(spark, edge_rows, SF).collect()
    assert sorted((repr(r["doc_id"]), list(r["ids"])) for r in out) == sorted((repr(d), whole.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in EDGE)

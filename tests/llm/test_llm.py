"""Each operator on small tables: edge cases, and brute force where SQL can't express it."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaver.llm import bpe, fingerprints, mixing, quality, secrets, sharding, simhash, substrings, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, a string, shard string, target string, score string"
WORDS = [f"w{i}" for i in range(300)]


def rows_of(texts, sources=None):
    return [(i, t, "en", (sources or ["s"])[(i or 0) % len(sources or ["s"])], 0, 1, "x", "x", "x", "x") for i, t in texts]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, copies, repeated rows and ids, and columns with names that operators use."""
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    shared = say(70)
    texts = [(1, None), (2, ""), (3, "one"), (4, say(120)), (5, say(60) + " " + shared + "\n" + say(30)), (6, shared + " " + say(10)), (7, say(5000))]
    texts += [(8, texts[3][1]), (9, texts[3][1]), (9, texts[3][1]), (None, "null id"), (None, None), (10, shared[:-3] + "zzz"), (11, "Orre " * 200), (12, "Orre " * 100)]
    return spark.createDataFrame(rows_of(texts, ["b", None, "a"]), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2, "x") for i in range(1, 13)], "doc_id long, quality int, toxic int, text string")


def operators(labels):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return {
        "quality": lambda d: quality.score_quality(d, labels),
        "secrets": secrets.find_secrets,
        "simhash": simhash.near_duplicates,
        "substrings": substrings.remove_repeated_passages,
        "fingerprints": fingerprints.fingerprint_edits,
        "bpe": lambda d: bpe.encode(d, path),
        "mixing": mixing.mix,
        "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.fit(d, labels)),
        "sharding": sharding.shard_by_bytes,
    }


@pytest.mark.parametrize("name", ["quality", "secrets", "simhash", "substrings", "fingerprints", "bpe", "mixing", "toxicity", "sharding"])
def test_edge_cases_keep_every_row(edge, empty, labels, name):
    run = operators(labels)[name]
    assert run(edge).count() == edge.count()
    assert run(empty).count() == 0


@pytest.mark.parametrize("name", ["quality", "secrets", "simhash", "substrings", "fingerprints", "bpe", "mixing", "toxicity", "sharding"])
def test_very_long_texts(spark, labels, name):
    """One run of letters and digits without white space, and two texts of 120,000 words."""
    r = random.Random(3)
    solid = "".join(r.choice("abcdef0123456789XYZ./=") for _ in range(200_000))
    many = " ".join(r.choice(WORDS) for _ in range(120_000))
    df = spark.createDataFrame(rows_of([(1, solid), (2, many), (3, many + " end")]), DOCS)
    assert operators(labels)[name](df).count() == 3


def test_sharding_against_python(edge):
    got = sorted(sharding.shard_by_bytes(edge, 4).collect(), key=lambda r: (r["shard"], r["slot"]))
    rows = sorted(((r["doc_id"] is None, r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in edge.collect()), key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
    total, before, slots = sum(x[2] for x in rows), 0, {}
    for r, (_, doc_id, size, crc) in zip(got, rows, strict=True):
        shard = min(3, (before + size // 2) * 4 // total)
        assert (r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) == (doc_id, size, crc, shard, slots.get(shard, 0))
        slots[shard], before = slots.get(shard, 0) + 1, before + size


def test_mix_meets_targets(edge):
    rows = mixing.mix(edge, block_words=16).collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    weight = {s: w for s, w in zip(sorted(sizes, key=lambda s: (s is None, s or "")), (5, 2, 1), strict=True)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:  # reshare the excess until none is above
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    for s, size in sizes.items():
        mine = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == size and r["target"] == pytest.approx(target[s]) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 1


def test_mix_takes_a_tiny_source_among_large_ones(spark):
    large = spark.range(30).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 200_000).alias("text"), F.lit("a").alias("source"))
    tiny = spark.createDataFrame([(100, "one", "b"), (101, "some more", "c")], large.schema)
    got = mixing.mix(large.unionByName(tiny), block_words=4096).groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert {r["source"] for r in got} == {"a", "b", "c"}
    assert all(abs(r["taken"] - r["target"]) <= 1 for r in got)


def test_schedule_has_every_slot(spark):
    targets = [(0, 600_000_000, 999_000_000.0), (1, 100, 200.0), (2, 479, 700.0), (3, 5000, 9999.5)]
    df = spark.createDataFrame(targets, "src int, source_size long, target double")
    for chunk in (1, 4096):
        small = mixing.schedule(df, 4096, chunk).where("src > 0").collect()
        for src, size, target in targets[1:]:
            blocks = [(p, b) for p in range(2) for b in range(-(-size // 4096))]
            want = [(k, p, b, min(4096, size - b * 4096, int(target) - p * size - b * 4096)) for k, (p, b) in enumerate(blocks)]
            assert sorted((r["rank"], r["pass"], r["block"], r["words"]) for r in small if r["src"] == src) == [w for w in want if w[3] > 0]
        assert len({r["slot"] for r in small}) == len(small)


def test_toxicity_learns_from_one_row_of_an_id(spark):
    texts = [(i, f"plain words of day {i % 7} and {'idiot scum ' * (i % 3) if i % 4 == 0 else 'nothing else '}here") for i in range(160)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int")
    more = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" zeal")))).unionByName(docs)  # later texts and copies
    one, many = toxicity.fit(docs, labels), toxicity.fit(more, labels)
    assert one.weights and one.weights == pytest.approx(many.weights)
    assert (many.rate, many.size, many.slope, many.offset) == pytest.approx((one.rate, one.size, one.slope, one.offset))


def slots_by_hand(targets: list[tuple[int, int, float]], block: int) -> list[tuple]:
    """(src, rank, pass, block, words) in the order of the mix, from its definition."""
    half, g = 1 << 26, mixing.GOLDEN
    golden = lambda i: i * g % (half * half) / (half * half)
    needed = {s: int(t) // size * -(-size // block) + -(-(int(t) % size) // block) for s, size, t in targets if t >= 1}
    n, edges, at = sum(needed.values()), [], 0
    for s in sorted(needed):
        edges.append((s, at / n, (at + needed[s]) / n))
        at += needed[s]
    points = [(i, -1, next(s for s, lo, hi in edges if lo <= golden(i) < hi)) for i in range(n)]
    got = {s: sum(p[2] == s for p in points) for s in needed}
    for s in needed:
        lacks = needed[s] - got[s]
        points += [(int((k + golden(s + 1)) * n / lacks), k, s) for k in range(lacks)]
    seen, out = dict.fromkeys(needed, 0), []
    of = {s: (size, int(t)) for s, size, t in targets}
    for _, _, s in sorted(points):
        rank, (size, need) = seen[s], of[s]
        seen[s] += 1
        if rank < needed[s]:
            passes, b = divmod(rank, -(-size // block))
            out.append((s, rank, passes, b, min(block, size - b * block, need - passes * size - b * block)))
    return out


def test_schedule_is_the_one_by_hand_and_near_its_weights_at_any_time(spark):
    targets = [(0, 90_000, 150_000.0), (1, 10, 20.0), (2, 479, 700.0), (3, 5000, 9999.5), (4, 30_000, 41_000.25), (5, 3, 0.5), (6, 1, 1.0)]
    df = spark.createDataFrame(targets, "src int, source_size long, target double")
    want = slots_by_hand(targets, 64)
    for chunk in (7, 4096):
        got = sorted(tuple(r) for r in mixing.schedule(df, 64, chunk).collect())
        assert [r[0] for r in got] == list(range(len(want)))
        assert [r[1:] for r in got] == want
    total = {s: sum(w[0] == s for w in want) for s in range(7)}
    at = dict.fromkeys(total, 0)
    for i, w in enumerate(want, 1):
        at[w[0]] += 1
        assert all(abs(at[s] - i * total[s] / len(want)) < 5 for s in total)
    tiny = [i for i, w in enumerate(want) if w[0] == 1]
    assert len(tiny) == 2 and tiny[1] - tiny[0] > len(want) / 8  # both passes, not at one end


def test_the_mix_by_hand(spark, edge):
    rows = mixing.mix(edge, block_words=16).collect()
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    targets = [(i, by_source[s][0]["source_size"], by_source[s][0]["target"]) for i, s in enumerate(names)]
    words = {(i, k): [] for i in range(len(names)) for k in (0, 1)}  # of each pass: slot by word
    for slot, (s, _, k, b, n) in enumerate(slots_by_hand(targets, 16)):
        words[s, k] += [(b * 16 + j, slot) for j in range(n)]
    for i, s in enumerate(names):
        at = 0
        passes = [dict(words[i, k]) for k in (0, 1)]
        for r in sorted(by_source[s], key=lambda r: r["start"]):
            assert r["size"] == 0 or r["start"] == at
            mine = [[p[w] for w in range(r["start"], r["start"] + r["size"]) if w in p] for p in passes]
            assert [r["first_pass"], r["second_pass"]] == [len(m) for m in mine] and r["taken"] == sum(map(len, mine))
            assert [r["first_slot"], r["second_slot"]] == [min(m, default=None) for m in mine]
            at += r["size"]


def test_bpe_is_the_library(edge):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, ours = Tokenizer.from_file(path), bpe.encoder(path)
    r = random.Random(1)
    bits = ["a", "The", " ", "\n", "'s", "!", "é", "\xa0", "\x1c", "  ", "\t", "<|endoftext|>", "12", "ſ", "日本", "\r\n", "\x85", "ñue", "🙂"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 16)))
        want = whole.encode(text, add_special_tokens=False).ids
        ids, said = ours.encode(text)
        assert ids == want and said == ",".join(map(str, want)) and ours.decode(ids) == whole.decode(want, skip_special_tokens=False)
    letters = "abcXYZqj019!?'-_/=.,;:é日🙂ñกü\u0301"
    for text in ["".join(r.choice(letters) for _ in range(60_000)), "a" * 200_000, "\n" * 50_000, "don't'll 'sx !'s 'S\n don\n.x  y"]:
        ids = ours.encode(text)[0]
        assert ids == whole.encode(text, add_special_tokens=False).ids and b"".join(ours.pieces(text)).decode() == text
        assert all(pair in ours.joined for p in ours.pieces(text) for pair in zip(p, p[1:], strict=False))
    assert ours.known.size < 2 * bpe.REMEMBERED
    ours.merged, fast = ours._library, ours.merged  # pieces merged by the library give the same
    try:
        ours._forget()
        assert ours.encode("Übung don't stop\nnow; 日本 x")[0] == whole.encode("Übung don't stop\nnow; 日本 x", add_special_tokens=False).ids
    finally:
        ours.merged = fast
    for row in bpe.encode(edge.where("doc_id = 7"), path).collect():
        assert row["ids"] == whole.encode(edge.where("doc_id = 7").first()["text"], add_special_tokens=False).ids


def test_fingerprints_are_homomorphic(edge):
    a, b = fingerprints.Fingerprint.of("x y z w\np q\nr"), fingerprints.Fingerprint.of("r\nx y z w\np q")
    assert a.hex() == b.hex()
    a.remove("p q")
    a.add("new words here")
    assert a.hex() == fingerprints.Fingerprint.of("new words here\nr\nx y z w").hex()
    rows = edge.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
    order = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["t"]) for r in rows))
    got = sorted(fingerprints.fingerprint_edits(edge).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"]))
    want = []
    for i, (gone, d, t) in enumerate(order):
        n = len(t) // 4
        e = t[: len(t) - n] + order[(i + 1) % len(order)][2][:n]
        want.append((None if gone else d, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.Fingerprint.of(t).hex(), fingerprints.Fingerprint.of(e).hex()))
    want.sort(key=lambda w: (w[0] is None, w[0] or 0, w[1]))
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in got] == want


def test_likeness_against_its_definition(edge):
    """The cosine of the centred +-1 counts of all 3-word shingles of all paragraphs, by XXH3 bits one by one."""
    import xxhash

    def lanes(text):
        out = np.zeros(128)
        for p in text.split("\n"):
            w = p.split()
            for i in range(max(1, len(w) - 2) if w else 0):
                h = int.from_bytes(xxhash.xxh3_128_digest(" ".join(w[i : i + 3]).encode()), "big")
                out += [1 if h >> (127 - b) & 1 else -1 for b in range(128)]
        return out

    def likeness(x, y):
        if sorted(x.split("\n")) == sorted(y.split("\n")):
            return 1.0
        a, b = lanes(x), lanes(y)
        norm = float(np.sqrt((a @ a) * (b @ b)))
        return min(1.0, max(0.0, float(a @ b) / norm)) if norm else 0.0

    short = edge.where("length(text) < 3000 OR text IS NULL")
    order = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in short.collect())
    want = []
    for i, (gone, d, t) in enumerate(order):
        n, following = len(t) // 4, order[(i + 1) % len(order)][2]
        want.append((None if gone else d, len(t), likeness(t, t[: len(t) - n] + following[:n]), likeness(t, following)))
    got = [(r["doc_id"], r["n_chars"], r["near_edited"], r["near_next"]) for r in fingerprints.fingerprint_edits(short).collect()]
    by = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    for g, w in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], abs=1e-9)


def test_likeness_of_a_long_text_of_one_word():
    text = "word " * 42_000
    whole = fingerprints.Fingerprint.of(text)
    assert whole.likeness(fingerprints.replaced_tail(text, whole, "other things here " * 9000)[1]) > 0.7


def test_simhash_links_are_complete(spark, monkeypatch):
    r = np.random.default_rng(3)
    seeds = r.integers(-(1 << 62), 1 << 62, 40)
    fps = {int(s) for s in seeds}
    for s in seeds[:20]:
        for _ in range(12):
            x = int(s)
            for b in r.choice(64, r.integers(1, 4), replace=False):
                x ^= (1 << int(b)) if b < 63 else -(1 << 63)
            fps.add(x)
    fps = sorted(fps)
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if bin((x ^ y) & (2**64 - 1)).count("1") <= 2:
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    for parts, wide in ((3, 64), (2, 64), (4, 3)):
        monkeypatch.setattr(simhash, "WIDE_BUCKET", wide)
        found = {row["node"]: row["root"] for row in simhash.components(simhash.near_links(nodes, parts)).collect()}
        assert {x: found.get(x, x) for x in fps} == {x: find(x) for x in fps}


def test_passages_against_brute_force(edge):
    rows = [(r["doc_id"], (r["text"] or "").split()) for r in edge.collect()]
    first = {}
    for d, w in rows:
        for i in range(len(w) - 49 if d is not None else 0):
            key = tuple(w[i : i + 50])
            first[key] = min(d, first.get(key, d))
    want = []
    for d, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - 49 if d is not None else 0):
            if first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want.append((d or -1, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    got = [(r["doc_id"] or -1, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeated_passages(edge).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 200


def removed_by_definition(rows):
    """(doc_id, words, words removed, digest of the kept) by all windows of all documents."""
    first = {}
    for d, w in rows:
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(d, first.get(key, d))
    for d, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        yield d, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_passages_of_repeated_words_and_many_variants(spark):
    r = random.Random(9)
    say = lambda n: [r.choice(WORDS[:40]) for _ in range(n)]
    common, lines = say(22), [say(60) for _ in range(4)]
    rows = [(0, ["x"] * 180), (1, ["x"] * 120 + say(9)), (2, say(3) + ["x", "y"] * 90), (3, ["x", "y"] * 60 + ["x"] * 70)]
    rows += [(4 + i, say(r.randint(0, 40)) + common + say(r.randint(0, 40)) + r.choice(lines)[: r.randint(45, 60)] + common) for i in range(60)]
    rows += [(70 + i, r.choice(rows)[1][r.randint(0, 20) :] + r.choice(rows)[1]) for i in range(60)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    for size in (1 << 22, 2000):  # one automaton, and many in several copies
        substrings.SHARD_BYTES, was = size, substrings.SHARD_BYTES
        try:
            got = [tuple(x) for x in substrings.remove_repeated_passages(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
        finally:
            substrings.SHARD_BYTES = was
        assert sorted(got) == sorted(removed_by_definition(rows))


def test_long_texts_of_one_word_take_linear_time(spark):
    import time

    long = spark.range(3).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 100_000 + F.col("id").cast("int")).alias("text"))
    begun = time.monotonic()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.remove_repeated_passages(long).collect()}
    assert got == {0: (100_000, 0), 1: (100_001, 100_001), 2: (100_002, 100_002)} and time.monotonic() - begun < 60


def test_top_k_against_brute_force(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(900)] + [(900 + i, [1.0] * 8) for i in range(300)]
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, [1.0] * 8), (2004, [1e17] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if i is not None and i < 2000} | {2004: [int(np.floor(1024 * 1e17))] * 8}
    keep = df.where("vec_id < 2000 OR vec_id > 2000 AND vec_id <> 2004 OR vec_id IS NULL OR vec_id = 2000")
    ints.pop(2004)
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in topk.top_k(keep, F.col("vec_id") % 100 == 0, shard_rows=300).collect()}
    for q in range(0, 1200, 100):
        best = sorted(((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q))[:10]
        assert [got[q, k + 1] for k in range(10)] == [(i, -s) for s, i in best]
    assert topk.top_k(keep.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_of_repeated_and_odd_rows(spark):
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in r.normal(size=4) + 5 * (i % 3)]) for i in range(700)]
    rows += [rows[100], (200, [9.0, 1.0, 0.0, -3.0]), rows[7], (800, [1.0, 2.0, 3.0]), (900, [2.0] * 5), (901, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, "x", "x", 1, 2, 3.0, 4) for i, v in rows], "vec_id long, embedding array<double>, v string, shard string, home int, region int, score double, floor int")
    got = sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 100 == 0, shard_rows=60).collect())
    ints, want = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows], []
    for q, v in ints:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ints if i != q and len(w) == len(v))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want) and sum(q == 900 for q, *_ in got) == 1 and not any(q == 800 for q, *_ in got)


def test_secret_spans():
    text = "é token: pass: abcdef API_KEY='xyz-123' AKIA" + "A1" * 8 + " " + "0af" * 9 + " ſecret=abcdefgh ghp_" + "aB3" * 12
    base, spans = secrets.scan(text, secrets.FormatScorer(secrets.labelled_credentials()), 0.25)
    assert [text[a:b] for k, a, b in base if k == "assign"] == ["API_KEY='xyz-123"]
    assert [k for k, _, _ in base] == ["assign", "access", "hex"]
    assert [text[a:b] for k, a, b in spans if k == "format"] == ["ghp_" + "aB3" * 12]
    assert "AKIA" not in secrets.redact(text, spans) and secrets.redact("plain", []) == "plain"


def test_glued_credentials_are_found():
    scorer = secrets.FormatScorer(secrets.labelled_credentials())
    fresh, seen = secrets.labelled_credentials(each=40, seed=11), []
    before = ["GH_PAT=", "https://maps.example.com/v1/geocode?key=", "/etc/deploy/keys/", "cfg.prod.value=", "AKIA" + "Q7" * 8 + "/", "0af" * 9 + "="]
    for kind in ("forge", "pay", "maps", "chat", "web"):
        for i, made in enumerate(fresh[kind]):
            text = f"set {before[i % len(before)]}{made}{('', '/', '.', '=x', '/notes.txt')[i % 5]} done"
            spans = secrets.scan(text, scorer, 0.25)[1]
            at = text.index(made)
            # a hex or access match within the credential is masked as such
            seen.append(all(any(a <= p < b for _, a, b in spans) for p in range(at, at + len(made))) and "set" in secrets.redact(text, spans))
    assert np.mean(seen) > 0.95


def test_credentials_that_hold_base_matches_are_masked_whole():
    scorer = secrets.FormatScorer(secrets.labelled_credentials())
    made = [
        "xoxb-123456789012-123456789012-0123456789abcdef01234567",
        "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9." + "0123456789abcdef" * 2 + "." + "aB3_" * 10 + "xyz",
        "ghp_" + "aB3" * 12 + "/" + "0af" * 9,
    ]
    for m in made:
        base, spans = secrets.scan(f"see {m} there", scorer, 0.25)
        assert base and set(base) <= set(spans) and secrets.redact(f"see {m} there", spans).strip() == "see <REDACTED> there"


def test_base_digests_against_a_scan_by_hand(spark, edge):
    """The base rules anew, without regular expressions."""
    letters, word = set("abcdefghijklmnopqrstuvwxyz"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    names = ("password", "passwd", "secret", "token", "api_key", "apikey")
    plain = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)

    def run(t, i, some):
        j = i
        while j < len(t) and t[j] in some:
            j += 1
        return j

    def assigned(t, i):
        for name in names:
            if plain(t[i : i + len(name)]) == name:
                j = i + len(name)
                j += j < len(t) and t[j] in "\"'"
                j = run(t, j, " ")
                if j >= len(t) or t[j] not in ":=":
                    continue
                j = run(t, j + 1, " ")
                j += j < len(t) and t[j] in "\"'"
                end = run(t, j, word)
                if end > j:
                    return j, end
        return None

    def spans(t):
        out, i = [], 0
        while i < len(t):
            if got := assigned(t, i):
                out += [(i, 0, "assign", got[1])] if got[1] - got[0] >= 6 else []
                i = got[1]
            else:
                i += 1
        i = 0
        while i < len(t):
            end = run(t, i + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")) if t.startswith("AKIA", i) else i
            if end > i + 4:
                out += [(i, 1, "access", end)] if end - i >= 20 else []
            i = end if end > i + 4 else i + 1
        i = 0
        while i < len(t):
            end = run(t, i, set("0123456789abcdef"))
            out += [(i, 2, "hex", end)] if end - i >= 24 else []
            i = max(end, i + 1)
        return sorted(out)

    assert letters < word
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    given += [(9000 + i, t) for i, t in enumerate([None, "", "token: é secret='abcdef' api-key=zzzzzzzz APIKEY := x", "password==abcdef token = \"abc\" secret:abcdefg=token=abcdefg", "AKIA" * 6 + " " + "f0" * 12 + "g" + "e" * 24])]
    found = {r["doc_id"]: r for r in secrets.find_secrets(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    for d, t in given:
        want = spans(t or "")
        said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        got = found[d]
        assert got["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [got["n_assign"], got["n_access"], got["n_hex"]] == [sum(x[2] == k for x in want) for k in ("assign", "access", "hex")]
    assert sum(r["n_assign"] + r["n_hex"] + r["n_access"] for r in found.values()) > 5


def test_secret_scan_of_long_runs_is_linear():
    import time

    scorer = secrets.FormatScorer(secrets.labelled_credentials())
    took = []
    for n in (2000, 16_000):
        begun = time.process_time()
        secrets.scan("/".join("0af" * 9 + "XYZ" for _ in range(n)) + " secret=abcdefgh" * n, scorer, 0.25)
        took.append(time.process_time() - begun)
    assert took[1] < 20 * took[0]


def test_tokens_with_dots_stay_whole():
    scorer = secrets.FormatScorer(secrets.labelled_credentials())
    fresh = secrets.labelled_credentials(each=200, seed=7)["web"]
    assert np.mean([("format", 0, len(t)) in secrets.scan(t, scorer, 0.25)[1] for t in fresh]) > 0.95


def test_parts_are_the_best_of_all():
    scorer, r = secrets.FormatScorer(secrets.labelled_credentials()), random.Random(8)
    made = [t for v in secrets.labelled_credentials(each=4, seed=9).values() for t in v if len(t) < 60]
    for _ in range(60):
        run = "".join(r.choice(["=", "/", ".", "a", "ab/c"]) + r.choice([*made, "x/y"]) for _ in range(r.randint(1, 3)))
        starts = [i for i in range(len(run)) if i == 0 or (run[i - 1] in "=/." and run[i] not in "=/.")]
        ends = [i for i in range(1, len(run) + 1) if i == len(run) or run[i] in "=/."]
        parts = [(a, b, (scorer.score(run[a:b]) - 0.25) * (b - a)) for a in starts for b in ends if b - a >= 20]
        best = [0.0] * (len(run) + 1)
        for e in range(1, len(run) + 1):
            best[e] = max([best[e - 1]] + [best[a] + w for a, b, w in parts if b == e and w >= 0])
        got = secrets.best_parts(run, scorer, 0.25)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False)) and all(scorer.score(run[a:b]) >= 0.25 - 1e-9 for a, b in got)
        assert sum((scorer.score(run[a:b]) - 0.25) * (b - a) for a, b in got) == pytest.approx(best[-1])


def test_automaton_prefers_its_own_format():
    made, fresh = secrets.labelled_credentials(), secrets.labelled_credentials(seed=7)
    scorer = secrets.FormatScorer(made)
    right = [scorer.score(t) >= 0.25 for k, v in fresh.items() if k != "other" for t in v]
    wrong = [scorer.score(t) >= 0.25 for t in fresh["other"]]
    assert np.mean(right) > 0.95 and np.mean(wrong) < 0.02


def definition_of_segments(x, lo=0):
    """All maximal segments: the best one (the shortest of those), then the same left and right of it."""
    best, at = 0.0, None
    for i in range(len(x)):
        total = 0.0
        for j in range(i, len(x)):
            total += x[j]
            if total > best or (total == best and at and j + 1 - i < at[1] - at[0]):
                best, at = total, (i, j + 1)
    if at is None:
        return []
    a, b = at
    return [*definition_of_segments(x[:a], lo), (lo + a, lo + b, best), *definition_of_segments(x[b:], lo + b)]


def test_maximal_segments_against_definition():
    r = random.Random(4)
    for _ in range(300):
        x = [r.choice([-2.0, -1.1, 1.0, 3.0]) + r.random() / 1000 for _ in range(r.randint(0, 16))]
        got, want = toxicity.maximal_segments(x), definition_of_segments(x)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for _, _, s in got] == pytest.approx([s for _, _, s in want])


def test_toxicity_scores_against_plain_python(spark, edge):
    """Counts, log-odds, calibration and scores anew, without Spark and with other code."""
    import math
    import re

    texts = [(i, f"plain words of day {i % 7} and {'idiot scum ' * (i % 3) if i % 4 == 0 else 'nothing else '}here {WORDS[i]}") for i in range(160)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    learnt = [(t, int(i % 4 == 0)) for i, t in texts if zlib.crc32(str(i).encode()) % 5]
    counts, totals = ({}, {}), [0, 0]
    for t, y in learnt:
        words = set(re.findall(r"[^\W\d_]+", t.lower()))
        totals[y] += len(words)
        for w in words:
            for u in {w} | {"^" + w[:n] for n in range(3, 9) if len(w) > n}:
                counts[y][u] = counts[y].get(u, 0) + 1
    want = {}
    for u in counts[0].keys() | counts[1].keys():
        n = [counts[y].get(u, 0) for y in (0, 1)]
        a = [n[y] + 3000 * sum(n) / sum(totals) for y in (0, 1)]
        delta = math.log(a[1] / (totals[1] + 3000 - a[1])) - math.log(a[0] / (totals[0] + 3000 - a[0]))
        error = math.sqrt(1 / a[0] + 1 / a[1])
        if abs(delta / error) >= 2.5 and (delta < 0 or n[1] >= 2):
            want[u] = delta - math.copysign(error, delta)
    assert want and model.weights == pytest.approx(want)
    got = toxicity.score_toxicity(docs.unionByName(edge.select("doc_id", "text")), model).collect()
    told = {}
    for _, t in [*texts, *((0, r["text"]) for r in edge.collect())]:
        x, seen = [], {}
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        for w in words:
            known = [want[u] for u in [w, *("^" + w[:n] for n in range(3, 9) if len(w) > n)] if u in want]
            s = (min(8.0, max(-2.0, *known, -9.0)) if known else 0.0) - 0.2
            seen[w] = seen.get(w, 0) + 1
            x.append(s / seen[w] if s > 0 else s)
        chance = [1 - math.exp(-math.exp(-s * model.rate) * model.size * max(1, len(words))) for _, _, s in toxicity.maximal_segments(x)]
        told[t] = 1 / (1 + math.exp(-(model.slope * math.log1p(sum(-math.log(max(c, 1e-300)) for c in chance)) + model.offset)))
    assert sorted(r["score"] for r in got) == pytest.approx(sorted([told[t] for _, t in texts] + [told[r["text"]] for r in edge.collect()]), abs=1e-6)


def test_gumbel_finds_the_rate():
    r = np.random.default_rng(1)
    n = r.integers(20, 3000, 4000)
    best = np.maximum(0, (np.log(0.01 * n) - np.log(-np.log(r.random(4000)))) / 0.7)
    rate, size = toxicity.gumbel(best, n.astype(float))
    assert rate == pytest.approx(0.7, rel=0.1) and size == pytest.approx(0.01, rel=0.2)


def test_quality_statistics_and_rules_by_definition(spark):
    """Statistics counted word by word, and the compiled expression against the rules applied one by one."""
    import math

    texts = ["", "one", "A b b. a\n\nb b, 12 é\tß!\nA b b. a", "x " * 300, "Señor-2 says: no;\nno\nyes"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stats = {r["doc_id"]: r for r in quality.text_statistics(df).collect()}
    for d, t in enumerate(texts):
        b, w, lines = t.encode(), t.split(), [x for x in t.split("\n") if x]
        share = lambda test: sum(map(test, b)) / max(len(b), 1)  # noqa: B023, E731
        want = {
            "log_bytes": math.log1p(len(b)), "log_words": math.log1p(len(w)), "long_word": max((len(x.encode()) for x in w), default=0), "distinct_words": len(set(w)) / len(w) if w else 1.0,
            "word_bytes": sum(x not in b" \n\t" for x in b) / max(len(w), 1), "log_distinct": math.log1p(len(set(w))), "top_word": max(map(w.count, w), default=0) / max(len(w), 1),
            "same_neighbours": sum(w[i] == w[i + 1] for i in range(len(w) - 1)) / max(len(w) - 1, 1), "distinct_pairs": len(set(zip(w, w[1:]))) / (len(w) - 1) if len(w) > 1 else 1.0,
            "lower": share(lambda x: 97 <= x <= 122), "upper": share(lambda x: 65 <= x <= 90), "digits": share(lambda x: 48 <= x <= 57), "high_bytes": share(lambda x: x > 127),
            "spaces": share(lambda x: x in b" \n\t"), "stops": share(lambda x: x in b".,;:?'\"()-"), "lines": math.log1p(len(lines)), "distinct_lines": len(set(lines)) / len(lines) if lines else 1.0,
            "top_line": max(map(lines.count, lines), default=0) / max(len(lines), 1), "words_in_line": len(w) / max(len(lines), 1), "ended_words": sum(x[-1] in ".,;:!?" for x in w) / max(len(w), 1),
        }
        want["symbols"] = 1 - sum(want[k] for k in ("lower", "upper", "digits", "stops", "spaces", "high_bytes")) if b else 0.0
        assert set(want) == set(quality.STATISTICS)
        assert {k: stats[d][k] for k in want} == pytest.approx(want)
    r = np.random.default_rng(0)
    x = r.random((400, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] <= 0.7)).astype(float)
    model = quality.fit_rules(x, y)
    rows = spark.createDataFrame(x.tolist(), list(quality.STATISTICS)).select(model.column().alias("p")).collect()
    by_hand = []
    for row in x:
        m = model.offset + sum(rule.weight for rule in model.rules if all((row[k] <= t) if low else (row[k] > t) for k, low, t in rule.terms))
        by_hand.append(1 / (1 + math.exp(-m)))
    assert [p["p"] for p in rows] == pytest.approx(by_hand) and np.mean((np.array(by_hand) > 0.5) == (y > 0)) > 0.97
    # most rules get no weight, and the weights solve the lasso: gradients of the kept ones balance the penalty
    assert 0 < len(model.rules) < 200


@pytest.mark.parametrize("name, label, hits, spared", [("op1_quality", "quality", 0.95, 0.9), ("op9_toxicity", "toxic", 0.9, 0.97)])
def test_held_out_recall_of_both_classes(spark, name, label, hits, spared):
    from quaver.llm.queries import queries

    sf = "/root/testdata/sf0.1"
    rows = queries()[name](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r["predicted"] == 1 for r in rows if r[label] == 1]) >= hits
    assert np.mean([r["predicted"] == 0 for r in rows if r[label] == 0]) >= spared


@pytest.mark.parametrize("name", ["op4_substrings", "op7_topk", "op10_sharding", "op11_filter_audit", "op13_resampling"])
def test_query_matches_its_sql(spark, name):
    import duckdb

    from quaver.llm import queries

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = queries.queries()[name](spark, sf)
    cols = ", ".join(sorted(got.columns))
    want = con.execute(f"SELECT {cols} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(repr, map(tuple, got.select(*sorted(got.columns)).collect()))) == sorted(map(repr, want))

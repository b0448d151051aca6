"""Files written and read back: no sample may differ."""

import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quaver.plans import files
from quaver.plans.queries import ORACLES
from quaver.sinks import audio, lossless
from quaver.sinks.bits import BODY_CRC, HEADER_CRC, Bits, coded_number, crc, syncsafe
from quaver.sources import wav


def tracks(spark, n=9000):
    r = np.random.default_rng(2)
    t = np.arange(n)
    made = {
        "tone": (0.5 * np.sin(0.05 * t), 0.4 * np.sin(0.05 * t + 0.3)),
        "noise": (r.normal(size=n) * 0.2, r.normal(size=n) * 0.2),
        "still": (np.zeros(n), np.full(n, 0.25)),
        "loud": (np.sign(np.sin(0.5 * t)) * 1.2, np.clip(np.cumsum(r.normal(size=n)) * 0.01, -1, 1)),
        "short": (np.array([0.1, -0.2, 0.3]), np.array([0.0, 0.9, -1.0])),
    }
    rows = [(k, i, float(x), float(y)) for k, (a, b) in made.items() for i, (x, y) in enumerate(zip(a, b, strict=True))]
    return spark.createDataFrame(rows, "track string, idx long, l double, r double")


def ints(df):
    out = {}
    for r in df.orderBy("track", "idx").collect():
        out.setdefault(r["track"], []).append((r["l"], r["r"]))
    return {k: np.array(v) for k, v in out.items()}


@pytest.mark.parametrize("depth", [16, 24])
def test_wav_files_read_back(spark, tmp_path, depth):
    q = audio.quantized(tracks(spark), depth, dither=False)
    tags = {"title": "A name", "artist": "", "comment": "odd"}
    for r in audio.wav_files(q, 48_000, depth, tags).collect():
        (tmp_path / f"{r['track']}.wav").write_bytes(r["content"])
        assert b"INAM" in r["content"] and b"IART" not in r["content"] and struct.unpack("<I", r["content"][4:8])[0] == len(r["content"]) - 8
    found = wav.files(spark, str(tmp_path))
    want = ints(q)
    heads = {r["path"].rsplit("/", 1)[-1][:-4]: r for r in wav.properties(found).collect()}
    assert all((h["channels"], h["rate"], h["bits"], h["n"]) == (2, 48_000, depth, len(want[k])) for k, h in heads.items()) and len(heads) == 5
    back = ints(wav.samples(found).select("track", "idx", *[(F.col(c) * (1 << (depth - 1))).cast("long").alias(c) for c in "lr"]))
    assert all((back[k] == want[k]).all() for k in want)


def test_header_sniffing_of_odd_chunks_and_other_data():
    head = wav.header(b"RIFF\0\0\0\0WAVEjunk\x03\0\0\0abc\0fmt \x10\0\0\0" + struct.pack("<HHIIHH", 1, 1, 8000, 16000, 2, 16) + b"data\x04\0\0\0\1\0\2\0")
    assert head == (1, 8000, 16, 2)
    assert wav.header(b"") is None and wav.header(b"fLaC" + bytes(60)) is None and wav.header(b"RIFF\0\0\0\0WAVE") is None


class Reader:
    def __init__(self, data):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n, signed=False):
        v = 0
        for b in self.bits[self.at : self.at + n].tolist():
            v = v << 1 | b
        self.at += n
        return v - (1 << n) if signed and n and v >> (n - 1) else v

    def unary(self):
        n = int(np.argmax(self.bits[self.at : self.at + 100_000]))
        self.at += n + 1
        return n


def decoded(data):
    """A decoder from the format's description, for what the frames here can hold."""
    assert data[:4] == b"fLaC"
    at, last = 4, 0
    while not last:
        last, size = data[at] >> 7, int.from_bytes(data[at + 1 : at + 4], "big")
        at += 4 + size
    kinds, out = set(), []
    while at < len(data):
        r = Reader(data[at : at + 60_000])
        assert r.take(14) == 0b11111111111110 and r.take(2) == 0
        r.take(8)
        pair, depth = r.take(4), {4: 16, 6: 24}[r.take(3)]
        r.take(1)
        lead = r.take(8)
        for _ in range({0: 0, 6: 1, 14: 2}[lead >> 5 if lead < 0xE0 else 14] if lead >= 0x80 else 0):
            r.take(8)
        n = r.take(16) + 1
        start = r.at // 8
        assert r.take(8) == crc(data[at : at + start], *HEADER_CRC)
        both = []
        for k in (0, 1):
            d = depth + ((pair == 8 and k == 1) or (pair == 9 and k == 0) or (pair == 10 and k == 1))
            r.take(1)
            kind = r.take(6)
            r.take(1)
            kinds.add("constant" if kind == 0 else "verbatim" if kind == 1 else "linear" if kind >= 32 else "fixed")
            if kind == 0:
                x = [r.take(d, True)] * n
            elif kind == 1:
                x = [r.take(d, True) for _ in range(n)]
            else:
                order = kind - 31 if kind >= 32 else kind - 8
                x = [r.take(d, True) for _ in range(order)]
                shift, taps = 0, {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}.get(order, [])
                if kind >= 32:
                    width, shift = r.take(4) + 1, r.take(5)
                    taps = [r.take(width, True) for _ in range(order)]
                wide, parts = (5, 4)[r.take(2) == 0], r.take(4)
                for p in range(1 << parts):
                    k_ = r.take(wide)
                    for _ in range((n >> parts) - (order if p == 0 else 0)):
                        u = r.unary() << k_ | r.take(k_)
                        x.append((u >> 1 if u % 2 == 0 else -(u >> 1) - 1) + (sum(c * x[-1 - j] for j, c in enumerate(taps)) >> shift))
            both.append(np.array(x))
        end = -(-r.at // 8)
        assert int.from_bytes(data[at + end : at + end + 2], "big") == crc(data[at : at + end], *BODY_CRC)
        a, b = both
        if pair == 8:
            a, b = a, a - b
        elif pair == 9:
            a, b = a + b, b
        elif pair == 10:
            m = a * 2 + b % 2
            a, b = (m + b) >> 1, (m - b) >> 1
        out.append(np.stack([a, b], 1))
        at += end + 2
    return np.concatenate(out), kinds


@pytest.mark.parametrize("depth", [16, 24])
def test_lossless_files_decode_without_errors(spark, depth):
    q = audio.quantized(tracks(spark, 5000), depth, dither=depth == 24)
    want, kinds = ints(q), set()
    sizes = {}
    for r in audio.lossless_files(q, 44_100, depth, {"title": "x", "album": ""}).collect():
        got, used = decoded(r["content"])
        kinds |= used
        assert (got == want[r["track"]]).all()
        sizes[r["track"]] = len(r["content"])
        assert b"TITLE=x" in r["content"] and b"ALBUM" not in r["content"]
    assert {"fixed", "linear"} <= kinds and ("constant" in kinds or depth == 24) and sizes["tone"] < 0.6 * 5000 * depth / 4


def test_rice_plans_are_the_best_of_all():
    r = np.random.default_rng(8)
    for n, order in ((256, 2), (192, 0), (37, 1)):
        x = np.round(r.laplace(size=n - order) * np.repeat([3, 400], [(n - order) // 2, n - order - (n - order) // 2])).astype(np.int64)
        bits, (p, ks) = lossless.rice_plan(x, order, n)
        u, best = np.where(x >= 0, 2 * x, -2 * x - 1), None
        for q in range(9):
            if n % (1 << q) or n >> q <= order and q:
                break
            cuts = [max(0, k * (n >> q) - order) for k in range((1 << q) + 1)]
            cost = [min((int(((u[a:b] >> k) + k + 1).sum()), k) for k in range(31)) for a, b in zip(cuts, cuts[1:], strict=False)]
            total = 6 + (5 if max(k for _, k in cost) > 14 else 4) * len(cost) + sum(c for c, _ in cost)
            best = total if best is None else min(best, total)
        assert bits == best and len(ks) == 1 << p
        out = Bits()
        at = 0
        for i, k in enumerate(ks):
            m = (n >> p) - (order if i == 0 else 0)
            out.put_rice(x[at : at + m], k)
            at += m
        assert sum(map(len, out.parts)) + 6 + (5 if max(ks) > 14 else 4) * len(ks) == bits


def test_small_fields():
    assert coded_number(0x7F) == b"\x7f" and all(coded_number(n) == chr(n).encode("utf-8") for n in (0x80, 0x7FF, 0x800, 0xFFFF, 0x10000, 0x10FFFF))
    assert coded_number(0x200000) == bytes([0xF8, 0x88, 0x80, 0x80, 0x80]) and syncsafe(0x0FFFFFFF) == b"\x7f" * 4
    assert crc(b"123456789", 8, 0x07) == 0xF4 and crc(b"123456789", 16, 0x8005) == 0xFEE8 and crc(b"123456789", 32, 0x04C11DB7) == 0x89A1897F
    tag = audio.text_tags({"title": "Ü", "artist": ""})
    assert tag[:6] == b"ID3\x03\0\0" and tag[10:14] == b"TIT2" and tag[-2:] == "Ü".encode("utf-16-le") and audio.text_tags({}) == b""


def test_no_digit_of_large_numbers_is_cut(spark, tmp_path):
    keys = [0, 3, 4, 55, 56, 1771, 1772, 56679, 56680, 113359, 113360, 150000, 900000, 9000000, 1 << 40]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = con.execute(ORACLES["coded_numbers"]).fetchall()
    assert sorted(map(tuple, files.coded_numbers(spark, str(tmp_path)).collect())) == sorted(want)


def test_ogg_pages(spark):
    rows = [("a", i, i * 960, bytes([i % 256]) * (i * 37 % 600)) for i in range(120)]
    pages = audio.ogg_pages(spark.createDataFrame(rows, "track string, seq long, granule long, data binary")).orderBy("page").collect()
    data = b""
    for k, p in enumerate(pages):
        c = p["content"]
        assert c[:4] == b"OggS" and c[5] == (2 if k == 0 else 4 if k == len(pages) - 1 else 0)
        assert int.from_bytes(c[22:26], "little") == crc(c[:22] + bytes(4) + c[26:], 32, 0x04C11DB7)
        lacing = c[27 : 27 + c[26]]
        assert sum(lacing) == len(c) - 27 - len(lacing) and sum(x < 255 for x in lacing) <= 50
        data += c[27 + len(lacing) :]
    assert data == b"".join(r[3] for r in rows) and len(pages) == 2 + 3


def test_ogg_pages_close_when_their_lacing_is_full(spark):
    sizes = [10, 20] + [1275, 1275, 3000, 0, 255, 64_769] * 20
    rows = [("a", i, i * 960, bytes([i % 256]) * n) for i, n in enumerate(sizes)]
    pages = audio.ogg_pages(spark.createDataFrame(rows, "track string, seq long, granule long, data binary")).orderBy("page").collect()
    assert [p["page"] for p in pages] == list(range(len(pages))) and len(pages) > 20
    data = b""
    for k, p in enumerate(pages):
        c = p["content"]
        lacing = c[27 : 27 + c[26]]
        assert sum(lacing) == len(c) - 27 - len(lacing) and c[5] == (2 if k == 0 else 4 if k == len(pages) - 1 else 0)
        assert int.from_bytes(c[22:26], "little") == crc(c[:22] + bytes(4) + c[26:], 32, 0x04C11DB7) and int.from_bytes(c[18:22], "little") == k
        data += c[27 + len(lacing) :]
    assert data == b"".join(r[3] for r in rows)


def listed(folder):
    return sorted(p.relative_to(folder).as_posix() for p in folder.rglob("*") if p.is_file())


@pytest.mark.parametrize("form,depth", [("wav", 16), ("wav", 24), ("flac", 16)])
def test_saved_files_are_the_files(spark, tmp_path, form, depth):
    s, tags = tracks(spark, 3000), {"title": "A name"}
    audio.save(s, f"file://{tmp_path}/out", form, 48_000, depth, tags, dither=False)
    makers = {"wav": audio.wav_files, "flac": audio.lossless_files}
    want = {f"{r['track']}.{form}": r["content"] for r in makers[form](audio.quantized(s, depth, dither=False), 48_000, depth, tags).collect()}
    assert listed(tmp_path / "out") == sorted(want) and all((tmp_path / "out" / k).read_bytes() == v for k, v in want.items())


def test_a_file_is_many_partitions_and_only_what_is_asked_for(spark, tmp_path):
    s = tracks(spark, 5000)
    audio.save(s, f"file://{tmp_path}", "wav", 44_100, 24, dither=False)
    (tmp_path / "other.wav").write_bytes(b"no file of that kind")
    (tmp_path / "_hidden.wav").write_bytes((tmp_path / "tone.wav").read_bytes())
    want = ints(audio.quantized(s, 24, dither=False))
    got = wav.read_wav(spark, f"file://{tmp_path}", range_bytes=6 * 700)
    assert got.rdd.getNumPartitions() == 4 * 8 + 1
    back = ints(got.select("track", "idx", *[(F.col(c) * (1 << 23)).cast("long").alias(c) for c in "lr"]))
    assert back.keys() == want.keys() and all((back[k] == want[k]).all() for k in want)
    assert {r["rate"] for r in got.select("rate").distinct().collect()} == {44_100}
    some = wav.read_wav(spark, f"file://{tmp_path}/tone.wav", "idx long, r double", 6 * 700).orderBy("idx").collect()
    assert [r["idx"] for r in some] == list(range(5000)) and [round(r["r"] * (1 << 23)) for r in some] == want["tone"][:, 1].tolist()
    with pytest.raises(Exception, match="no such columns"):
        wav.read_wav(spark, f"file://{tmp_path}", "loudness double").count()


def test_conditions_choose_files_and_ranges(spark, tmp_path):
    audio.save(tracks(spark, 5000), f"file://{tmp_path}", "wav", 48_000, 16, dither=False)
    reader = wav.PushingReader(wav.StructType.fromDDL("track string, idx long"), {"path": f"file://{tmp_path}", "rangeBytes": "4000"})
    left = [wav.LessThan(("l",), 0.5)]
    assert list(reader.pushFilters([wav.EqualTo(("track",), "tone"), wav.GreaterThan(("idx",), 1999), wav.LessThanOrEqual(("idx",), 3499), *left])) == left
    assert [(p.path.rsplit("/")[-1], p.first, p.last) for p in reader.partitions()] == [("tone.wav", 2000, 3000), ("tone.wav", 3000, 3500)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert sorted(r["idx"] for r in wav.read_wav(spark, f"file://{tmp_path}", range_bytes=4000).where("track = 'tone' AND idx >= 4990 AND idx < 4995").collect()) == list(range(4990, 4995))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_files_above_four_gigabytes(tmp_path):
    """A sparse file with 64-bit sizes: only headers and the asked ranges are read."""
    n = 1_200_000_000
    with open(tmp_path / "long.wav", "wb") as f:
        head = audio.wav_header(n, 48_000, 16)
        f.write(head)
        f.seek(len(head) + 4 * (n - 1))
        f.write(struct.pack("<hh", 16384, -16384))
    reader = wav.WavReader(wav.StructType.fromDDL("idx long, l double, r double"), {"path": f"file://{tmp_path}"})
    parts = reader.partitions()
    assert len(parts) == -(-4 * n // wav.RANGE) and parts[-1].last == n and all(p.first < p.last for p in parts)
    last = list(reader.read(parts[-1]))[-1].to_pylist()[-1]
    assert last == {"idx": n - 1, "l": 0.5, "r": -0.5}


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    from quaver.sinks.files import save_parts

    kept = spark.createDataFrame([("a", 0, b"one"), ("a", 1, b"two"), ("b", 0, b""), ("c", 0, None)], "name string, part long, content binary")
    uri = f"file://{tmp_path}/f"
    save_parts(kept, uri, ".bin")
    assert listed(tmp_path / "f") == ["a.bin", "b.bin", "c.bin"] and (tmp_path / "f" / "a.bin").read_bytes() == b"onetwo"
    bad = spark.createDataFrame([("x", 0, b"new"), ("a", 0, b"new"), ("../up", 0, b"out")], "name string, part long, content binary")
    with pytest.raises(Exception, match="not a file name"):
        save_parts(bad, uri, ".bin")
    assert listed(tmp_path / "f") == ["a.bin", "b.bin", "c.bin"] and (tmp_path / "f" / "a.bin").read_bytes() == b"onetwo" and not (tmp_path / "up.bin").exists()
    save_parts(kept.where("name = 'a' AND part = 1"), uri, ".bin", overwrite=False)
    assert listed(tmp_path / "f") == ["a.bin", "b.bin", "c.bin"] and (tmp_path / "f" / "a.bin").read_bytes() == b"two"
    save_parts(kept.where("name = 'b'"), uri, ".bin")  # overwriting removes what the new write doesn't have
    assert listed(tmp_path / "f") == ["b.bin"] and [p.name for p in (tmp_path / "f").iterdir()] == ["b.bin"]
    with pytest.raises(Exception, match="several places"):  # parts of one name dealt to several tasks
        one = lambda part: kept.where(f"name = 'a' AND part = {part}").select("name", "content")
        one(0).union(one(1)).write.format("quaver-parts").mode("append").save(uri)
    assert listed(tmp_path / "f") == ["b.bin"]


def test_disc_image(spark):
    q = audio.quantized(tracks(spark, 2000), dither=False)
    order = spark.createDataFrame([("tone", 7, 1), ("short", 7, 2), ("noise", 8, 1)], "track string, album int, pos long")
    parts, where = audio.disc_image(q, order, gap_frames=150)
    image = b"".join(r["content"] for r in parts.where("album = 7").orderBy("pos", "part").collect())
    assert [(r["pos"], r["start"], r["frames"]) for r in where.where("album = 7").orderBy("pos").collect()] == [(1, 0, 4), (2, 154, 1)]
    assert len(image) == 44 + 155 * 588 * 4 and wav.header(image) == (2, 44_100, 16, 155 * 588)
    samples = np.frombuffer(image, "<i2", offset=44).reshape(-1, 2)
    want = ints(q)
    assert (samples[:2000] == want["tone"]).all() and (samples[154 * 588 :][:3] == want["short"]).all() and not samples[2000 : 154 * 588].any()


def test_dither_is_triangular_and_repeats(spark):
    s = spark.range(20_000).select(F.lit("t").alias("track"), F.col("id").alias("idx"), F.lit(0.3 / 32767).alias("l"), F.lit(-2.0).alias("r"))
    a, b = (audio.quantized(s, 16).orderBy("idx").collect() for _ in range(2))
    assert a == b and {r["l"] for r in a} <= {-1, 0, 1} and np.mean([r["l"] for r in a]) == pytest.approx(0.3, abs=0.02) and {r["r"] for r in a} == {-32768}


@pytest.mark.parametrize("fs,to,freq", [(48_000, 44_100, 9000.0), (44_100, 48_000, 12_000.0), (48_000, 24_000, 3000.0)])
def test_resampled_sines_are_sines(spark, fs, to, freq):
    """What isn't the sine itself, images included, lies 80 dB below; places are exact; blocks don't matter."""
    n = 9600
    s = spark.range(n).select(F.lit("t").alias("track"), F.col("id").alias("idx"), F.sin(F.col("id") * (2 * np.pi * freq / fs)).alias("l"), F.lit(0.5).alias("r"))
    got = wav.resampled(s, fs, to).orderBy("idx").toPandas()
    assert (got["idx"] == np.arange(-(-n * to // fs))).all()
    inner = slice(120, len(got) - 120)
    assert np.abs(got["l"] - np.sin(got["idx"] * (2 * np.pi * freq / to)))[inner].max() < 1e-4 and np.abs(got["r"] - 0.5)[inner].max() < 1e-9
    small = wav.resampled(s, fs, to, size=100).orderBy("idx").toPandas()
    assert np.abs(small["l"] - got["l"]).max() < 1e-12 and (small["idx"] == got["idx"]).all()


def test_resampling_stops_what_would_fold(spark):
    """A tone above half of the new rate is gone; a step of silence between two tracks stays in its track."""
    s = spark.range(9600).select(F.when(F.col("id") < 9500, F.lit("t")).otherwise(F.lit(None)).alias("track"), F.col("id").alias("idx"), F.sin(F.col("id") * (2 * np.pi * 0.48)).alias("l"), F.lit(0.0).alias("r"))
    got = wav.resampled(s, 48_000, 44_100).toPandas()
    inner = got[(got["track"] == "t") & got["idx"].between(100, 8600)]
    assert inner["l"].abs().max() < 1e-4 and got["track"].isna().sum() == -(-100 * 147 // 160) and not got["r"].any()
    assert wav.resampled(s.limit(0), 48_000, 44_100).count() == 0

"""Queries on coding and binary formats, and their DuckDB oracles; importing this registers them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.functions import half_up
from quaver.operators.spectra import synthesized
from quaver.plans.queries import EV, ev, query
from quaver.sinks import audio
from quaver.sinks.bits import BODY_CRC, HEADER_CRC, PAGE_CRC, crc_table
from quaver.sources import positions, read, shared_dir, wav, written


@query(f"""WITH {EV} SELECT track, CAST(sum(CAST(greatest(-8388608, least(8388607, floor(l * 8388607 + 0.5))) AS BIGINT)) AS BIGINT) AS sum_l, max(CAST(greatest(-32768, least(32767, floor(r * 4 * 32767 + 0.5))) AS BIGINT)) AS max_r FROM ev GROUP BY 1""")
def quantized_depths(spark, d):
    """Samples at 24 bits, and at 16 bits beyond full scale, without dither."""
    a = audio.quantized(ev(spark, d), 24, dither=False).groupBy("track").agg(F.sum("l").alias("sum_l"))
    loud = ev(spark, d).select("track", "idx", "l", (F.col("r") * 4).alias("r"))
    return a.join(audio.quantized(loud, 16, dither=False).groupBy("track").agg(F.max("r").alias("max_r")), "track")


def checksum(data: Column, width: int, poly: int) -> Column:
    """A most-significant-bit-first checksum of a binary column, byte by byte through a table made by rule."""
    table = F.array(*[F.lit(int(v)) for v in crc_table(width, poly)])
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
    mask = F.lit((1 << width) - 1)
    step = lambda c, b: (F.shiftleft(c, 8).bitwiseAND(mask)).bitwiseXOR(F.element_at(table, (F.shiftright(c, width - 8).bitwiseXOR(b) + 1).cast("int")))
    return F.when(F.octet_length(data) > 0, F.aggregate(codes, F.lit(0).cast("long"), step)).otherwise(F.lit(0).cast("long"))


def _table_sql(name: str, width: int, poly: int) -> str:
    top, mask = 1 << (width - 1), (1 << width) - 1
    return f"{name} AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda a, k: CASE WHEN a & {top} <> 0 THEN xor(a << 1, {poly}) & {mask} ELSE (a << 1) & {mask} END, n << {width - 8}) AS c FROM (SELECT unnest(range(256)) AS n)))"


def _crc_sql(name: str, width: int) -> str:
    return f"list_reduce(bytes, lambda a, x: xor((a << 8) & {(1 << width) - 1}, {name}.t[xor(a >> {width - 8}, x) + 1]), 0::BIGINT)"


@query(f"""WITH {_table_sql('h', 8, 7)}, {_table_sql('b', 16, 32773)}, {_table_sql('o', 32, 79764919)}, d AS (SELECT c_custkey, list_transform(regexp_extract_all(hex(encode(c_name)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM customer)
SELECT c_custkey, {_crc_sql('h', 8)} AS header, {_crc_sql('b', 16)} AS body, {_crc_sql('o', 32)} AS page FROM d, h, b, o""")
def checksums(spark, d):
    """The three checksums of the binary formats, of customers' names."""
    name = F.col("c_name").cast("binary")
    return read(spark, d, "customer").select("c_custkey", checksum(name, *HEADER_CRC).alias("header"), checksum(name, *BODY_CRC).alias("body"), checksum(name, *PAGE_CRC).alias("page"))


@query("""WITH n AS (SELECT o_orderkey, o_orderkey * 37 AS v FROM orders) SELECT o_orderkey, CASE WHEN v < 128 THEN printf('%02X', v) WHEN v < 2048 THEN printf('%02X%02X', 192 + (v >> 6), 128 + v % 64) WHEN v < 65536 THEN printf('%02X%02X%02X', 224 + (v >> 12), 128 + (v >> 6) % 64, 128 + v % 64)
ELSE printf('%02X%02X%02X%02X', 240 + (v >> 18), 128 + (v >> 12) % 64, 128 + (v >> 6) % 64, 128 + v % 64) END AS coded, printf('%02X%02X%02X%02X', (v >> 21) % 128, (v >> 14) % 128, (v >> 7) % 128, v % 128) AS safe, printf('%02X%02X%02X%02X', v % 256, (v >> 8) % 256, (v >> 16) % 256, (v >> 24) % 256) AS little FROM n""")
def coded_numbers(spark, d):
    """Numbers as the formats hold them: in the manner of UTF-8, in bytes of seven bits, and with the least byte first."""
    v = F.col("o_orderkey") * 37
    part = lambda shift, most: F.shiftright(v, shift) % most
    two = lambda x: F.lpad(F.hex(x), F.greatest(F.lit(2), F.length(F.hex(x))), F.lit("0"))  # noqa: E731  # two digits at least, none cut off
    tail = lambda k: [two(128 + part(6 * j, 64)) for j in range(k - 1, -1, -1)]
    coded = F.when(v < 128, two(v)).when(v < 2048, F.concat(two(192 + F.shiftright(v, 6)), *tail(1))).when(v < 65536, F.concat(two(224 + F.shiftright(v, 12)), *tail(2))).otherwise(F.concat(two(240 + F.shiftright(v, 18)), *tail(3)))
    return read(spark, d, "orders").select("o_orderkey", coded.alias("coded"), F.concat(*[two(part(s, 128)) for s in (21, 14, 7, 0)]).alias("safe"), F.concat(*[two(part(s, 256)) for s in (0, 8, 16, 24)]).alias("little"))


_RICE = """q AS (SELECT event_type AS track, CAST(floor(value * 100 + 0.5) AS BIGINT) AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events),
u AS (SELECT track, i // 256 AS block, i % 256 AS j, x - lag(x) OVER (PARTITION BY track, i // 256 ORDER BY i) AS r, count(*) OVER (PARTITION BY track, i // 256) AS n FROM q),
z AS (SELECT track, block, j, CASE WHEN r >= 0 THEN 2 * r ELSE -2 * r - 1 END AS u FROM u WHERE n = 256 AND j > 0),
c AS (SELECT track, block, p, j * pow(2, p)::BIGINT // 256 AS part, k, sum(k + 1 + (u >> k)) AS bits FROM z, (SELECT unnest(range(8)) AS p), (SELECT unnest(range(31)) AS k) GROUP BY 1, 2, 3, 4, 5),
m AS (SELECT track, block, p, part, min(bits) AS bits, min_by(k, bits * 100 + k) AS k FROM c GROUP BY 1, 2, 3, 4),
t AS (SELECT track, block, p, CAST(6 + sum(bits) + CASE WHEN max(k) > 14 THEN 5 ELSE 4 END * count(*) AS BIGINT) AS bits FROM m GROUP BY 1, 2, 3)"""


@query(f"WITH {_RICE} SELECT track, block, CAST(p AS BIGINT) AS parts, bits FROM t QUALIFY row_number() OVER (PARTITION BY track, block ORDER BY bits, p DESC) = 1")
def rice_merged(spark, d):
    """The best number of partitions of each block of 256 by exact bits: sums of the finest parts are added up at all levels at once."""
    q = read(spark, d, "events").select(F.col("event_type").alias("track"), F.col("event_id").alias("idx"), half_up(F.col("value") * 100).cast("long").alias("x"))
    q = positions(q).withColumns({"block": F.floor(F.col("i") / 256), "j": (F.col("i") % 256).cast("int")})
    o = W.partitionBy("track", "block")
    r = q.withColumns({"r": F.col("x") - F.lag("x").over(o.orderBy("i")), "n": F.count(F.lit(1)).over(o)}).where("n = 256 AND j > 0")
    u = F.when(F.col("r") >= 0, 2 * F.col("r")).otherwise(-2 * F.col("r") - 1)
    ks = range(31)
    level = r.withColumn("u", u).groupBy("track", "block", F.floor(F.col("j") / 2).alias("part")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.shiftright("u", k)).alias(f"s{k}") for k in ks])
    # each finest part adds to the one that holds it at every level
    at = F.explode(F.sequence(F.lit(0), F.lit(7)))
    level = level.withColumn("parts", at).withColumn("part", F.floor(F.col("part") / F.pow(F.lit(2.0), 7 - F.col("parts")))).groupBy("track", "block", "parts", "part")
    cost = F.array_min(F.array(*[F.struct((F.col("n") * (k + 1) + F.col(f"s{k}")).alias("bits"), F.lit(k).alias("k")) for k in ks]))
    merged = level.agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in ks]).withColumn("c", cost)
    out = merged.groupBy("track", "block", F.col("parts").cast("long").alias("parts")).agg((6 + F.sum("c.bits") + F.when(F.max("c.k") > 14, 5).otherwise(4) * F.count(F.lit(1))).cast("long").alias("bits"))
    best = F.min_by(F.struct("parts", "bits"), F.struct("bits", -F.col("parts")))
    return out.groupBy("track", "block").agg(best.alias("b")).select("track", "block", "b.parts", "b.bits")


def _digest(files):
    return files.select("track", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


@query(f"""WITH {EV}, q AS (SELECT track, i, CAST(greatest(-32768, least(32767, floor(l * 32767 + 0.5))) AS INTEGER) AS l, CAST(greatest(-32768, least(32767, floor(r * 32767 + 0.5))) AS INTEGER) AS r FROM sp),
b AS (SELECT track, count(*) AS n, string_agg(printf('%02X%02X%02X%02X', l & 255, (l >> 8) & 255, r & 255, (r >> 8) & 255), '' ORDER BY i) AS body FROM q GROUP BY 1),
h AS (SELECT track, n, '52494646' || printf('%02X%02X%02X%02X', (36 + 4 * n) % 256, ((36 + 4 * n) >> 8) % 256, ((36 + 4 * n) >> 16) % 256, 0) || '57415645666D7420100000000100020080BB000000EE02000400100064617461' || printf('%02X%02X%02X%02X', (4 * n) % 256, ((4 * n) >> 8) % 256, ((4 * n) >> 16) % 256, 0) || body AS content FROM b)
SELECT track, length(content) // 2 AS size, sha256(unhex(content)) AS sha256 FROM h""")
def wav_export(spark, d):
    """The bytes of each track's WAV file at 16 bits, without dither."""
    return _digest(audio.encoded(ev(spark, d), "wav", 48_000, 16, dither=False))


@query()  # tests decode it without errors
def lossless_export(spark, d):
    return _digest(audio.encoded(ev(spark, d), "flac", 48_000, 16, {"title": "events"}, dither=False))


@query(f"""WITH {EV}, n AS (SELECT sp.track, i * 40 AS start, 20 + idx % 60 AS n, 200 + 4 * value AS freq, 0.1::DOUBLE AS level, greatest(-1, least(1, r)) AS pan, (idx % 5)::DOUBLE AS fall FROM sp JOIN events ON event_id = idx),
s AS (SELECT track, start + k AS idx, level * sin(2 * pi() * freq * k / 8000) * exp(-fall * k / n) AS x, pan FROM (SELECT *, unnest(range(n)) AS k FROM n)), m AS (SELECT track, idx, sum(x * (1 - pan) / 2) AS l, sum(x * (1 + pan) / 2) AS r FROM s GROUP BY 1, 2)
SELECT track, count(*) AS n, round(sum(l * l), 4) + 0.0 AS e_l, round(sum(r * r), 4) + 0.0 AS e_r FROM m GROUP BY 1""")
def song_made(spark, d):
    """Events as a score: each is a note, pitched by its value."""
    e = read(spark, d, "events").select(F.col("event_id").alias("idx"), "value")
    pan = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r")))
    notes = positions(ev(spark, d)).join(e, "idx").select("track", (F.col("i") * 40).alias("start"), (20 + F.col("idx") % 60).alias("n"), (200 + 4 * F.col("value")).alias("freq"), F.lit(0.1).alias("level"), pan.alias("pan"), (F.col("idx") % 5).cast("double").alias("fall"))
    s = synthesized(notes, 8000)
    return s.groupBy("track").agg(F.count(F.lit(1)).alias("n"), *[(F.round(F.sum(F.col(c) * F.col(c)), 4) + F.lit(0.0)).alias(f"e_{c}") for c in "lr"])


_WINDOW = " + ".join(["0.35875::DOUBLE", *(f"{a} * cos({k} * pi() * u / 48)" for k, a in ((1, 0.48829), (2, 0.14128), (3, 0.01168)))])
_CUT = "(0.5 * 44100 / 48000::DOUBLE - 1 / 48::DOUBLE)"


@query(f"""WITH {EV}, n AS (SELECT track, count(*) AS n FROM sp GROUP BY 1), m AS (SELECT track, unnest(range(CAST(ceil(n * 147 / 160::DOUBLE) AS BIGINT))) AS idx FROM n),
o AS (SELECT track, idx, idx * 160 // 147 + j AS i, (idx * 160 % 147) / 147::DOUBLE - j AS u FROM m, (SELECT unnest(range(-47, 49)) AS j)),
h AS (SELECT *, CASE WHEN u = 0 THEN 2 * {_CUT} ELSE sin(2 * pi() * {_CUT} * u) / (pi() * u) END * ({_WINDOW}) AS h FROM o),
y AS (SELECT h.track, h.idx, sum(h * coalesce(l, 0)) / sum(h) AS l, sum(h * coalesce(r, 0)) / sum(h) AS r FROM h LEFT JOIN sp ON sp.track = h.track AND sp.i = h.i GROUP BY 1, 2)
SELECT track, idx, round(l, 4) + 0.0 AS l, round(r, 4) + 0.0 AS r FROM y""")
def resampled_44100(spark, d):
    """Signals at 48,000 samples a second brought to 44,100."""
    return wav.resampled(ev(spark, d), 48_000, 44_100).select("track", "idx", *[(F.round(F.col(c), 4) + F.lit(0.0)).alias(c) for c in "lr"])


_INTS = f"""WITH {EV}, q AS (SELECT track, i, CAST(greatest(-32768, least(32767, floor(l * 32767 + 0.5))) AS BIGINT) AS l, CAST(greatest(-32768, least(32767, floor(r * 32767 + 0.5))) AS BIGINT) AS r FROM sp)"""


def _folder(spark):
    return f"{shared_dir(spark)}/quaver/{uuid.uuid4().hex}"


@query(f"{_INTS} SELECT track, CAST(48000 AS INTEGER) AS rate, count(*) AS n, CAST(sum(i * l) AS BIGINT) AS places_l, CAST(sum(i * r) AS BIGINT) AS places_r FROM q GROUP BY 1")
def wav_saved(spark, d):
    """Every track written as a file with a commit, and all files read back in byte ranges: each sample at its place."""
    folder = _folder(spark)
    audio.save(ev(spark, d), folder, "wav", 48_000, 16, {"title": "events"}, dither=False)
    whole = lambda c: F.sum(F.col("idx") * (F.col(c) * 32768).cast("long"))
    return wav.read_wav(spark, folder, range_bytes=1 << 14).groupBy("track", "rate").agg(F.count(F.lit(1)).alias("n"), whole("l").alias("places_l"), whole("r").alias("places_r"))


@query(f"{_INTS}, t AS (SELECT track, count(*) AS n FROM q GROUP BY 1) SELECT track, n, n * 4 + 44 AS bytes FROM t WHERE track >= 'd'")
def wav_headers(spark, d):
    """Files by their headers alone: no sample is read, and those of other tracks aren't opened for it."""
    folder = _folder(spark)
    audio.save(ev(spark, d), folder, "wav", 48_000, 16, dither=False)
    found = wav.read_wav(spark, folder, "track string, idx long").groupBy("track").agg((F.max("idx") + 1).alias("n"))
    return found.where("track >= 'd'").select("track", "n", (F.col("n") * 4 + 44).alias("bytes"))


@query(f"""{_INTS}, o AS (SELECT track, count(*) AS n, CAST(length(track) % 2 AS BIGINT) AS album, sum(i * l) AS places_l FROM q GROUP BY 1), p AS (SELECT *, row_number() OVER (PARTITION BY album ORDER BY track) AS pos, ceil(n / 588::DOUBLE)::BIGINT AS frames FROM o)
SELECT album, pos, track, frames, CAST(coalesce(sum(frames + 150) OVER (PARTITION BY album ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(places_l AS BIGINT) AS places_l FROM p""")
def disc_saved(spark, d):
    """Disc images written as files, and each track's samples found where the table of contents says."""
    folder = _folder(spark)
    q = written(audio.quantized(ev(spark, d), 16, dither=False))
    pos = F.row_number().over(W.partitionBy("album").orderBy("track")).cast("long")  # tracks of one disc
    order = q.select("track").distinct().withColumn("album", (F.length("track") % 2).cast("long")).withColumn("pos", pos)
    contents = written(audio.save_disc(q, order, folder))
    image = wav.read_wav(spark, folder, "track string, idx long, l double", 1 << 14).select(F.col("track").cast("long").alias("album"), "idx", (F.col("l") * 32768).cast("long").alias("l"))
    # each sample's track by the frame it is in: a row of contents names its frames, so the join is on equal frames
    frames = contents.select("album", "pos", "track", "frames", "start", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("frames") - 1)).alias("frame"))
    at = image.withColumn("frame", F.floor(F.col("idx") / audio.DISC_FRAME)).join(frames, ["album", "frame"])
    return at.groupBy("album", "pos", "track", "frames", "start").agg(F.sum((F.col("idx") - F.col("start") * audio.DISC_FRAME) * F.col("l")).alias("places_l"))

"""Registered queries of the signal engine and their DuckDB oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.functions import energy_to_lufs, fade_gain, half_up, lowpass, r4
from quaver.operators import measure as m
from quaver.operators.blocks import Follower, filtered, haloed, transformed
from quaver.operators.follow import followed
from quaver.operators.spectra import autocorrelation
from quaver.plans.dims import PLATFORMS, PRESETS
from quaver.plans.sql import coefficients, recursion
from quaver.sources import event_signal, line_signal, positions, read, write_out
from quaver.streaming.loudness import meter_files, played
from quaver.streaming.meters import meter_frames, meter_frames_stream

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def ev(spark, d):
    return event_signal(spark, d)


EV = """ev AS (SELECT event_type AS track, event_id AS idx, (value - 50) / 1024::DOUBLE AS l,
  (CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) - 50) / 128::DOUBLE AS r FROM events),
sp AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY idx) - 1 AS i FROM ev)"""


HOPS = f"""WITH RECURSIVE {recursion([coefficients('highshelf', 1681.974450955533, 3.999843853973347, 1.0), coefficients('high', 38.13547087602444, q=0.5003270373238773)], 'lr', EV)},
hops AS (SELECT track, CAST(floor(i / 10) AS BIGINT) AS hop, sum(fl * fl + fr * fr) / 10 AS e FROM fs GROUP BY 1, 2 HAVING count(*) = 10)"""
LUFS = "(-0.691 + 10 * log10(greatest({}, 1e-12)))"
BLOCKS = "blocks AS (SELECT track, hop, avg(e) OVER w AS m, count(*) OVER w AS n FROM hops WINDOW w AS (PARTITION BY track ORDER BY hop ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"
ST = "st AS (SELECT track, hop, avg(e) OVER w AS m, count(*) OVER w AS n FROM hops WINDOW w AS (PARTITION BY track ORDER BY hop ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"
INTEGRATED = f"""{BLOCKS}, g AS (SELECT track, avg(m) AS a FROM blocks WHERE n = 4 AND {LUFS.format('m')} > -70 GROUP BY 1),
loud AS (SELECT b.track, {LUFS.format('avg(m)')} AS lufs FROM blocks b JOIN g USING (track) WHERE n = 4 AND {LUFS.format('m')} > -70 AND {LUFS.format('m')} > {LUFS.format('g.a')} - 10 GROUP BY 1)"""


@query(f"WITH RECURSIVE {recursion([coefficients('low', 8000.0, q=0.7071)], 'lr', EV)} SELECT track, round(sum(fl * fl + fr * fr), 4) + 0.0 AS energy FROM fs GROUP BY 1")
def biquad_energy(spark, d):
    return filtered(ev(spark, d), [lowpass(48000, 8000, 0.7071)]).groupBy("track").agg(r4(F.sum(F.col("l") * F.col("l") + F.col("r") * F.col("r"))).alias("energy"))


@query(f"{HOPS} SELECT track, hop, round(e, 4) + 0.0 AS e FROM hops")
def kweight_hops(spark, d):
    return m.weighted_hops(ev(spark, d)).select("track", "hop", r4(F.col("e")).alias("e"))


@query(f"{HOPS}, {INTEGRATED} SELECT t.track, round(coalesce(lufs, -70.0::DOUBLE), 4) + 0.0 AS lufs FROM (SELECT DISTINCT track FROM hops) t LEFT JOIN loud USING (track)")
def integrated_loudness(spark, d):
    return m.integrated_loudness(m.weighted_hops(ev(spark, d))).select("track", r4(F.col("lufs")).alias("lufs"))


@query(f"{HOPS}, {BLOCKS} SELECT track, hop, round({LUFS.format('m')}, 4) + 0.0 AS m FROM blocks WHERE n = 4")
def momentary(spark, d):
    return m.moving_mean(m.weighted_hops(ev(spark, d)), 4).select("track", "hop", r4(energy_to_lufs(F.col("m"))).alias("m"))


@query(f"{HOPS}, {ST} SELECT track, CAST(floor(hop / 5) AS BIGINT) AS p, round({LUFS.format('m')}, 4) + 0.0 AS st FROM st WHERE (hop + 1) % 5 = 0")
def short_term_series(spark, d):
    return m.short_term(m.weighted_hops(ev(spark, d))).select("track", "p", r4(F.col("st")).alias("st"))


@query(
    f"""{HOPS}, {ST}, v AS (SELECT track, m, {LUFS.format('m')} AS v FROM st WHERE n = 30 AND {LUFS.format('m')} > -70),
g AS (SELECT track, {LUFS.format('avg(m)')} - 20 AS gate FROM v GROUP BY 1), k AS (SELECT track, list_sort(list(v)) AS vs FROM v JOIN g USING (track) WHERE v > gate GROUP BY 1)
SELECT t.track, round(coalesce(CASE WHEN len(vs) >= 2 THEN vs[least(CAST(floor(len(vs) * 0.95::DOUBLE) AS BIGINT), len(vs) - 1) + 1] - vs[CAST(floor(len(vs) * 0.10::DOUBLE) AS BIGINT) + 1] END, 0.0::DOUBLE), 4) + 0.0 AS lra
FROM (SELECT DISTINCT track FROM hops) t LEFT JOIN k USING (track)"""
)
def loudness_range(spark, d):
    return m.loudness_range(m.weighted_hops(ev(spark, d))).select("track", r4(F.col("lra")).alias("lra"))


LI = "li AS (SELECT l_returnflag AS track, l_quantity / 64::DOUBLE AS l, l_discount AS r FROM lineitem)"


@query(f"WITH {LI} SELECT track, round(20 * log10(greatest(max(greatest(abs(l), abs(r))), 1e-10)), 4) + 0.0 AS peak_db FROM li GROUP BY 1")
def sample_peak(spark, d):
    return m.sample_peak(line_signal(spark, d)).select("track", r4(F.col("peak_db")).alias("peak_db"))


@query(f"WITH {LI} SELECT track, round(10 * log10(sum(r * r) / sum(l * l)), 4) + 0.0 AS bal_db FROM li GROUP BY 1")
def balance_offset(spark, d):
    return m.balance_offset(line_signal(spark, d)).select("track", r4(F.col("bal_db")).alias("bal_db"))


@query(f"WITH {LI} SELECT track, round(10 * log10((sum((l-r)*(l-r)/4) + 1e-12) / (sum((l+r)*(l+r)/4) + 1e-12)), 4) + 0.0 AS ratio_db FROM li GROUP BY 1")
def side_mid_ratio(spark, d):
    return m.side_mid_ratio(line_signal(spark, d)).select("track", r4(F.col("ratio_db")).alias("ratio_db"))


CORR = f"""WITH {EV}, c AS (SELECT track, CAST(floor(i / 50) AS BIGINT) AS w, sum(l * r) / sqrt(sum(l * l) * sum(r * r)) AS corr, sum(l * l) + sum(r * r) AS energy
FROM sp GROUP BY 1, 2 HAVING count(*) = 50 AND sum(l * l) + sum(r * r) > 1e-6)"""


@query(f"{CORR} SELECT track, w, round(corr, 4) + 0.0 AS corr, round(energy, 4) + 0.0 AS energy FROM c")
def window_correlation(spark, d):
    return m.window_correlation(ev(spark, d)).select("track", "w", r4(F.col("corr")).alias("corr"), r4(F.col("energy")).alias("energy"))


@query(f"""{CORR} SELECT track, round(sum(corr * energy) / sum(energy), 4) + 0.0 AS corr_mean,
round(list_sort(list(corr))[CAST(floor(0.05::DOUBLE * count(*)) AS BIGINT) + 1], 4) + 0.0 AS corr_worst FROM c GROUP BY 1""")
def corr_weighted_mean(spark, d):
    return m.correlation_summary(m.window_correlation(ev(spark, d))).select("track", r4(F.col("corr_mean")).alias("corr_mean"), r4(F.col("corr_worst")).alias("corr_worst"))


EU = EV.replace("event_type AS track", "user_id AS track")
PYR = f"""WITH {EU}, p0 AS (SELECT track, CAST(floor(i / 8) AS BIGINT) AS bucket, least(0.0::DOUBLE, min((l + r) / 2)) AS mn, greatest(0.0::DOUBLE, max((l + r) / 2)) AS mx,
sqrt(avg(((l + r) / 2) * ((l + r) / 2))) AS rms FROM sp GROUP BY 1, 2)"""
SHOW = "round(mn, 4) + 0.0 AS mn, round(mx, 4) + 0.0 AS mx, round(rms, 4) + 0.0 AS rms"
UP = "SELECT track, CAST(floor(bucket / 8) AS BIGINT) AS bucket, min(mn) AS mn, max(mx) AS mx, sqrt(avg(rms * rms)) AS rms FROM {} GROUP BY 1, 2"


def _shown(df, *keys):
    return df.select(*keys, *[r4(F.col(c)).alias(c) for c in ("mn", "mx", "rms")])


@query(f"{PYR} SELECT track, bucket, {SHOW} FROM p0")
def pyramid_base(spark, d):
    return _shown(m.pyramid_base(event_signal(spark, d, "user_id")), "track", "bucket")


@query(f"""{PYR}, p1 AS ({UP.format('p0')}), p2 AS ({UP.format('p1')})
SELECT track, 0 AS level, bucket, {SHOW} FROM p0 UNION ALL SELECT track, 1, bucket, {SHOW} FROM p1 UNION ALL SELECT track, 2, bucket, {SHOW} FROM p2""")
def pyramid_rollup(spark, d):
    return _shown(m.pyramid(event_signal(spark, d, "user_id")), "track", "level", "bucket")


@query(f"WITH {EV}, n AS (SELECT *, max(i) OVER (PARTITION BY track) + 1 AS n FROM sp) SELECT track, idx, round(least(1, i / 100::DOUBLE) * sqrt(least(1, (n - 1 - i) / 100::DOUBLE)), 4) + 0.0 AS g FROM n")
def fade_gains(spark, d):
    p = positions(ev(spark, d)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("track")))
    return p.select("track", "idx", r4(fade_gain(F.col("i") / 100, "linear") * fade_gain((F.col("n") - 1 - F.col("i")) / 100, "power")).alias("g"))


@query(f"WITH {EV} SELECT track, round(sum(l * l) * pow(10, -1 / 20::DOUBLE), 4) + 0.0 AS sum_l2, round(sum(r * r) * pow(10, 1 / 20::DOUBLE), 4) + 0.0 AS sum_r2 FROM ev GROUP BY 1")
def balance_trim(spark, d):
    g = 10 ** (1 / 20)
    return ev(spark, d).groupBy("track").agg(r4(F.sum(F.col("l") * F.col("l")) / g).alias("sum_l2"), r4(F.sum(F.col("r") * F.col("r")) * g).alias("sum_r2"))


@query(f"WITH {EV} SELECT track, idx, round(min(least(1, 0.05 / greatest(abs(l), abs(r), 1e-9))) OVER (PARTITION BY track ORDER BY idx ROWS BETWEEN 15 PRECEDING AND CURRENT ROW), 4) + 0.0 AS wmin FROM ev")
def sliding_min_gain(spark, d):
    need = F.least(F.lit(1.0), 0.05 / F.greatest(F.abs("l"), F.abs("r"), F.lit(1e-9)))
    rows, w = haloed(ev(spark, d), 15)
    return rows.withColumn("wmin", F.min(need).over(w.rowsBetween(-15, 0))).where("NOT halo").select("track", "idx", r4(F.col("wmin")).alias("wmin"))


@query(f"WITH {EV} SELECT track, idx, round(lag(l, 12, 0.0::DOUBLE) OVER (PARTITION BY track ORDER BY idx), 4) + 0.0 AS x_d FROM ev")
def lookahead_delay(spark, d):
    rows, w = haloed(ev(spark, d), 12)
    return rows.withColumn("x_d", F.lag("l", 12, 0.0).over(w)).where("NOT halo").select("track", "idx", r4(F.col("x_d")).alias("x_d"))


@query(f"""WITH RECURSIVE {EV}, e AS (SELECT track, i, 0.3::DOUBLE * abs(l) AS env FROM sp WHERE i = 0 UNION ALL
SELECT s.track, s.i, e.env + CASE WHEN abs(s.l) > e.env THEN 0.3::DOUBLE ELSE 0.02::DOUBLE END * (abs(s.l) - e.env) FROM e JOIN sp s ON s.track = e.track AND s.i = e.i + 1)
SELECT track, round(max_by(env, i), 4) + 0.0 AS env_last, round(max(env), 4) + 0.0 AS env_max FROM e GROUP BY 1""")
def envelope_follower(spark, d):
    class Envelope(Follower):
        names, env, memory = ("env",), 0.0, 50.0

        def push(self, left, right):
            out = []
            for x in np.abs(left).tolist():
                self.env += (0.3 if x > self.env else 0.02) * (x - self.env)
                out.append(self.env)
            return (np.array(out),)

    env = followed(ev(spark, d), Envelope, outputs=("env",), span=4096)
    return env.groupBy("track").agg(r4(F.max_by("env", "i")).alias("env_last"), r4(F.max("env")).alias("env_max"))


EM = f"""e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
w AS (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * i / 63)) AS xw FROM e),
dft AS (SELECT vec_id, label, k, sum(xw * cos(2 * pi() * k * i / 64)) AS re, -sum(xw * sin(2 * pi() * k * i / 64)) AS im FROM w, (SELECT unnest(range(33)) AS k) ks GROUP BY 1, 2, 3)"""


def dft(spark, d):
    """Windowed Fourier transform of each embedding as a frame: vec_id, label, k, re, im; all frames of a batch at once."""
    frames = read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return transformed(frames, ["vec_id", "label"], np.hanning(64))


@query(f"WITH {EM} SELECT vec_id, k, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM dft")
def hann_dft(spark, d):
    return dft(spark, d).select("vec_id", F.col("k").cast("long").alias("k"), r4(F.col("re")).alias("re"), r4(F.col("im")).alias("im"))


@query(f"""WITH {EM}, b AS (SELECT b, CAST(b * 4 + 1 AS BIGINT) AS lo, CAST(b * 4 + 6 AS BIGINT) AS hi FROM (SELECT unnest(range(7)) AS b) t),
p AS (SELECT label, b, vec_id, sum(re * re + im * im) / max(hi - lo) AS e FROM dft JOIN b ON k >= lo AND k < hi GROUP BY 1, 2, 3)
SELECT label, b AS band, round(10 * log10(avg(e) + 1e-14), 4) + 0.0 AS db FROM p GROUP BY 1, 2""")
def band_profile(spark, d):
    bands = F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda b: F.struct(b.alias("band"), (b * 4 + 1).alias("lo"), (b * 4 + 6).alias("hi"))), lambda s: (F.col("k") >= s["lo"]) & (F.col("k") < s["hi"])))
    e = dft(spark, d).withColumn("b", bands).groupBy("label", "b.band", "vec_id").agg((F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / 5).alias("e"))
    return e.groupBy("label", "band").agg(r4(10 * F.log10(F.avg("e") + 1e-14)).alias("db")).select("label", F.col("band").cast("long").alias("band"), "db")


RAW_FLUX = f"""WITH {EM}, g AS (SELECT *, ln(1 + 20 * sqrt(re * re + im * im)) AS mag, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS col FROM dft WHERE k >= 1 AND k < 32),
x AS (SELECT label, col, greatest(0, mag - lag(mag, 1, 0.0::DOUBLE) OVER (PARTITION BY label, k ORDER BY col)) AS f FROM g) SELECT label, col, sum(f) AS flux FROM x GROUP BY 1, 2"""


@query(f"SELECT label, col, round(flux, 4) + 0.0 AS flux FROM ({RAW_FLUX})")
def spectral_flux(spark, d):
    return raw_flux(spark, d).select("label", "col", r4(F.col("flux")).alias("flux"))


def raw_flux(spark, d):
    """Rise of the magnitudes from one vector to the next, summed over the bins without the lowest and the highest."""
    mag = F.log1p(20 * F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))
    g = dft(spark, d).where("k >= 1 AND k < 32").withColumns({"mag": mag, "col": F.dense_rank().over(W.partitionBy("label").orderBy("vec_id")).cast("long") - 1})
    rise = F.greatest(F.lit(0.0), F.col("mag") - F.lag("mag", 1, 0.0).over(W.partitionBy("label", "k").orderBy("col")))
    return g.withColumn("f", rise).groupBy("label", "col").agg(F.sum("f").alias("flux"))


@query(f"""{HOPS} SELECT a.track, CAST(lag AS BIGINT) AS lag, round(sum(a.e * b.e) / count(*) * 1000, 4) + 0.0 AS ac
FROM hops a, (SELECT unnest(range(1, 13)) AS lag) l JOIN hops b ON b.track = a.track AND b.hop = a.hop + lag GROUP BY 1, 2""".replace("FROM hops a, (SELECT", "FROM hops a CROSS JOIN (SELECT"))
def autocorr_lags(spark, d):
    sums = autocorrelation(m.weighted_hops(ev(spark, d)).withColumnRenamed("hop", "col"), "e", 1, 12).where("n > lag")
    return sums.select("track", "lag", r4(F.col("p") / (F.col("n") - F.col("lag")) * 1000).alias("ac"))


def _values(rows, names):
    return f"(VALUES {', '.join('(' + ', '.join(repr(v) + '::DOUBLE' if isinstance(v, float) else repr(v) for v in r) + ')' for r in rows)}) AS {names}"


@query(f"{HOPS}, {INTEGRATED} SELECT track, id AS platform, round(lufs - target, 4) + 0.0 AS delta, CASE WHEN lufs - target > 0.2 THEN 'turned down' WHEN lufs - target < -0.2 THEN 'under' ELSE 'as is' END AS verdict FROM loud CROSS JOIN {_values(PLATFORMS, 'p(id, target, ceiling)')}")
def platform_delivery(spark, d):
    platforms = spark.createDataFrame(PLATFORMS, "platform string, target double, ceiling double")  # a fixed dimension of a few rows
    loud = m.integrated_loudness(m.weighted_hops(ev(spark, d))).crossJoin(F.broadcast(platforms)).withColumn("x", F.col("lufs") - F.col("target"))
    return loud.select("track", "platform", r4(F.col("x")).alias("delta"), F.when(F.col("x") > 0.2, "turned down").when(F.col("x") < -0.2, "under").otherwise("as is").alias("verdict"))


@query(f"SELECT p_partkey, coalesce(target, -14.0::DOUBLE) AS target, coalesce(ceiling, -1.0::DOUBLE) AS ceiling FROM part LEFT JOIN {_values(PRESETS, 'p(id, target, ceiling)')} ON p.id = 'preset' || (p_partkey % 7)")
def preset_override(spark, d):
    presets = spark.createDataFrame(PRESETS, "id string, target double, ceiling double")
    p = read(spark, d, "part").withColumn("id", F.concat(F.lit("preset"), (F.col("p_partkey") % 7).cast("string")))
    return p.join(F.broadcast(presets), "id", "left").select("p_partkey", F.coalesce("target", F.lit(-14.0)).alias("target"), F.coalesce("ceiling", F.lit(-1.0)).alias("ceiling"))


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def queue_semi(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)")
def recents_anti(spark, d):
    """Customers without a large order."""
    large = read(spark, d, "orders").where("o_totalprice > 450000")
    return read(spark, d, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT user_id, rn, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS rn FROM (SELECT user_id, event_type, max(event_id) AS last FROM events GROUP BY 1, 2) t) u WHERE rn <= 6")
def dedupe_recents(spark, d):
    last = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"))
    return last.withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("last"))).cast("long")).where("rn <= 6").select("user_id", "rn", "event_type")


@query("SELECT c_name AS name, 'customer' AS src FROM customer UNION ALL SELECT s_name, 'supplier' FROM supplier")
def queue_union(spark, d):
    a = read(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("src"))
    return a.unionByName(read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("src")))


@query(f"WITH {EV} SELECT track, idx, CAST(greatest(-32768, least(32767, floor(l * 32767 + 0.5))) AS BIGINT) AS q FROM ev")
def quantize_int(spark, d):
    return ev(spark, d).select("track", "idx", F.greatest(F.lit(-32768), F.least(F.lit(32767), half_up(F.col("l") * 32767))).cast("long").alias("q"))


INTS = "q AS (SELECT event_type AS track, event_id AS idx, CAST(floor(value * 100 + 0.5) AS BIGINT) AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events)"


@query(f"""WITH {INTS}, w AS (SELECT track, CAST(floor(i / 64) AS BIGINT) AS block, i % 64 AS j, x, lag(x) OVER o AS x1, lag(x, 2) OVER o AS x2, lag(x, 3) OVER o AS x3, lag(x, 4) OVER o AS x4 FROM q WINDOW o AS (PARTITION BY track, floor(i / 64) ORDER BY i)),
s AS (SELECT track, block, [sum(abs(x)), sum(abs(x - x1)), sum(abs(x - 2 * x1 + x2)), sum(abs(x - 3 * x1 + 3 * x2 - x3)), sum(abs(x - 4 * x1 + 6 * x2 - 4 * x3 + x4))] AS c FROM w WHERE j >= 4 GROUP BY 1, 2)
SELECT track, block, CAST(list_position(c, list_min(c)) - 1 AS BIGINT) AS "order" FROM s""")
def fixed_order(spark, d):
    """Best fixed predictor of each block: the least sum of absolute differences, the lowest order first."""
    q = read(spark, d, "events").select(F.col("event_type").alias("track"), F.col("event_id").alias("idx"), half_up(F.col("value") * 100).cast("long").alias("x"))
    q = positions(q).withColumn("block", F.floor(F.col("i") / 64))
    o = W.partitionBy("track", "block").orderBy("i")
    q = q.withColumns({f"x{k}": F.lag("x", k).over(o) for k in range(1, 5)})
    x, x1, x2, x3, x4 = map(F.col, ("x", "x1", "x2", "x3", "x4"))
    costs = [x, x - x1, x - 2 * x1 + x2, x - 3 * x1 + 3 * x2 - x3, x - 4 * x1 + 6 * x2 - 4 * x3 + x4]
    s = q.where("i % 64 >= 4").groupBy("track", "block").agg(F.array(*[F.sum(F.abs(c)) for c in costs]).alias("c"))
    return s.select("track", "block", (F.array_position("c", F.array_min("c")) - 1).alias("order"))


@query(f"""WITH {INTS}, u AS (SELECT track, CAST(floor(i / 64) AS BIGINT) AS part, CASE WHEN x - p >= 0 THEN 2 * (x - p) ELSE -2 * (x - p) - 1 END AS z FROM (SELECT *, lag(x, 1, 0) OVER (PARTITION BY track ORDER BY i) AS p FROM q) t),
b AS (SELECT track, part, k, CAST(sum((z >> k) + 1 + k) AS BIGINT) AS bits FROM u, (SELECT unnest(range(15)) AS k) ks GROUP BY 1, 2, 3) SELECT track, part, CAST(min_by(k, bits * 100 + k) AS BIGINT) AS k, min(bits) AS bits FROM b GROUP BY 1, 2""")
def rice_partition(spark, d):
    """Best Rice parameter of each part: the fewest bits, the lowest parameter first."""
    q = positions(read(spark, d, "events").select(F.col("event_type").alias("track"), F.col("event_id").alias("idx"), half_up(F.col("value") * 100).cast("long").alias("x")))
    r = F.col("x") - F.lag("x", 1, 0).over(W.partitionBy("track").orderBy("i"))
    u = q.withColumn("r", r).select("track", F.floor(F.col("i") / 64).alias("part"), F.when(F.col("r") >= 0, 2 * F.col("r")).otherwise(-2 * F.col("r") - 1).alias("z"))
    costs = u.groupBy("track", "part").agg(*[F.sum(F.shiftright("z", k) + (1 + k)).alias(f"k{k}") for k in range(15)])
    best = F.array_min(F.array(*[F.struct(F.col(f"k{k}").alias("bits"), F.lit(k).cast("long").alias("k")) for k in range(15)]))
    return costs.select("track", "part", best["k"].alias("k"), best["bits"].alias("bits"))


@query("SELECT o_orderkey, frame, lpad(CAST(frame // 4500 AS VARCHAR), 2, '0') || ':' || lpad(CAST(frame // 75 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(frame % 75 AS VARCHAR), 2, '0') AS mmssff FROM (SELECT o_orderkey, CAST(coalesce(sum(ceil(floor(o_totalprice) / 588) + 150) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS frame FROM orders) t")
def cue_offsets(spark, d):
    """Start of each track of an album (a customer's orders) in frames of 588 samples, with gaps of two seconds."""
    before = W.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(W.unboundedPreceding, -1)
    f = read(spark, d, "orders").select("o_orderkey", F.coalesce(F.sum(F.ceil(F.floor("o_totalprice") / 588) + 150).over(before), F.lit(0)).cast("long").alias("frame"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    sec = F.floor(F.col("frame") / 75)
    return f.select("o_orderkey", "frame", F.concat_ws(":", two(F.floor(F.col("frame") / 4500)), two(sec % 60), two(F.col("frame") % 75)).alias("mmssff"))


@query("SELECT c_custkey, substr(regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g'), 1, 12) AS s FROM customer")
def isrc_clean(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.substring(F.regexp_replace(F.upper("c_name"), "[^A-Z0-9]", ""), 1, 12).alias("s"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_type), 'steel')")
def preset_filter(spark, d):
    return read(spark, d, "part").where(F.contains(F.lower("p_name"), F.lit("a")) | F.contains(F.lower("p_type"), F.lit("steel"))).select("p_partkey")


@query("""SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events""")
def json_props(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""WITH g AS (SELECT *, CASE WHEN lag(event_type) OVER o = event_type AND epoch_us(ts) - epoch_us(lag(ts) OVER o) < 86400000000 THEN 0 ELSE 1 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
h AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS grp FROM g)
SELECT user_id, CAST(grp AS BIGINT) AS grp, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM h GROUP BY 1, 2""")
def gesture_collapse(spark, d):
    o = W.partitionBy("user_id").orderBy("event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(o)
    new = F.when((F.lag("event_type").over(o) == F.col("event_type")) & (gap < 86_400_000_000), 0).otherwise(1)
    g = read(spark, d, "events").withColumn("new", new).withColumn("grp", F.sum("new").over(o.rowsBetween(W.unboundedPreceding, 0)))
    return g.groupBy("user_id", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


FRAMES = f"WITH {EV} SELECT track, CAST(floor(i / 64) AS BIGINT) AS frame, round(max(greatest(abs(l), abs(r))), 4) + 0.0 AS peak, count(*) AS n FROM sp GROUP BY 1, 2"


@query(FRAMES)
def meter_frames_batch(spark, d):
    return meter_frames(ev(spark, d))


@query(FRAMES)
def meter_frames_streamed(spark, d):
    return meter_frames_stream(spark, d)


@query(f"""WITH {EV}, b AS (SELECT track, i // 128 AS b, max(greatest(abs(l), abs(r))) AS peak, count(*) AS n FROM sp GROUP BY 1, 2 UNION ALL SELECT track, -1, NULL, count(*) FROM sp GROUP BY 1)
SELECT track, CAST(b AS BIGINT) AS frame, b = -1 AS ended, CASE WHEN b = -1 THEN n ELSE (b + 1) * 128 END AS playhead FROM b WHERE b = -1 OR n = 128""")
def loudness_streamed(spark, d):
    """Which frames the streamed meter gives for each track, and the playhead at each; its readings are tested against the batch operators."""
    samples = played(positions(ev(spark, d)))
    stream = spark.readStream.schema(samples.schema).parquet(write_out(samples))
    frames = meter_files(stream, 4800, 128)
    return frames.select("track", F.when(F.col("ended"), F.lit(-1)).otherwise(F.col("frame")).cast("long").alias("frame"), "ended", "playhead")


@query(f"WITH {EV} SELECT track, i, CASE WHEN i < 100 THEN i ELSE 20 + (i - 20) % 80 END AS src_idx FROM sp")
def loop_remap(spark, d):
    """Play positions with a loop over [20, 100)."""
    return positions(ev(spark, d)).select("track", F.col("i").cast("long").alias("i"), F.when(F.col("i") < 100, F.col("i")).otherwise(20 + F.pmod(F.col("i") - 20, F.lit(80))).cast("long").alias("src_idx"))


@query("SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem")
def track_numbering(spark, d):
    w = W.partitionBy("l_orderkey")
    return read(spark, d, "lineitem").select("l_orderkey", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long").alias("rn"), F.count(F.lit(1)).over(w).alias("total"))

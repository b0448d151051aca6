"""Queries on dynamics, tempo and novelty, and their DuckDB oracles; importing this registers them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.functions import peaking, r4, shelf
from quaver.operators import dynamics as dyn
from quaver.operators import measure as m
from quaver.plans.queries import EV, HOPS, ORACLES, PYR, QUERIES, RAW_FLUX, ev, query, raw_flux
from quaver.plans.sql import between, coefficients, decay, follow, recursion
from quaver.sources import event_signal, positions

FS, CEILING_DB, AMOUNT, DENSITY = 4800, -12.0, 1.0, 0.5


TP = f"""tp AS MATERIALIZED (SELECT track, i, l, r, greatest(abs(l), abs(r), {', '.join(between(c, q) for c in 'lr' for q in (0.25, 0.5, 0.75))}) AS peak
FROM sp WINDOW w AS (PARTITION BY track ORDER BY i))"""
_CEIL = "pow(10::DOUBLE, -12 / 20::DOUBLE)"


@query(f"WITH {EV}, {TP} SELECT track, round(20 * log10(greatest(max(peak), 1e-10)), 4) + 0.0 AS tp_db FROM tp GROUP BY 1")
def true_peak(spark, d):
    return dyn.true_peaks(ev(spark, d)).groupBy("track").agg(r4(20 * F.log10(F.greatest(F.max("peak"), F.lit(1e-10)))).alias("tp_db"))


@query(f"""WITH RECURSIVE {EV}, {TP},
req AS MATERIALIZED (SELECT track, i, min(CASE WHEN peak > {_CEIL} THEN {_CEIL} / peak ELSE 1 END) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS low,
  greatest(abs(lag(l, 16, 0.0::DOUBLE) OVER (PARTITION BY track ORDER BY i)), abs(lag(r, 16, 0.0::DOUBLE) OVER (PARTITION BY track ORDER BY i))) AS late FROM tp),
g AS (SELECT DISTINCT track, -1::BIGINT AS i, 1.0::DOUBLE AS gain, 0.0::DOUBLE AS late FROM req UNION ALL
SELECT q.track, q.i, q.low + CASE WHEN q.low < g.gain THEN {decay(0.0025 / 4)} ELSE {decay(0.09)} END * (g.gain - q.low), q.late
FROM g JOIN req q ON q.track = g.track AND q.i = g.i + 1)
SELECT track, round(-20 * log10(greatest(min(gain), 1e-6)), 4) + 0.0 AS max_gr, count(*) FILTER (WHERE late * gain > {_CEIL}) AS n_clipped FROM g GROUP BY 1""")
def limiter_stats(spark, d):
    return dyn.limiter_stats(ev(spark, d), CEILING_DB, FS).select("track", r4(F.col("max_gr")).alias("max_gr"), "n_clipped")


@query(f"""WITH RECURSIVE {EV}, g AS (SELECT DISTINCT track, -1::BIGINT AS i, 0.0::DOUBLE AS fast, 0.0::DOUBLE AS slow, 0.0::DOUBLE AS gain FROM sp UNION ALL
SELECT track, i, fast, slow, gain + CASE WHEN abs(goal) > abs(gain) THEN 1 - {decay(0.0005)} ELSE 1 - {decay(0.03)} END * (goal - gain) FROM (
  SELECT *, 1.0::DOUBLE * 0.6::DOUBLE * least(10, greatest(0, 20 * log10((fast + 1e-9) / (slow + 1e-9)))) AS goal FROM (
    SELECT track, i, gain, {follow('fast', 'x', 0.0002, 0.03)} AS fast, {follow('slow', 'x', 0.015, 0.3)} AS slow
    FROM (SELECT s.track, s.i, g.fast, g.slow, g.gain, greatest(abs(s.l), abs(s.r)) AS x FROM g JOIN sp s ON s.track = g.track AND s.i = g.i + 1))))
SELECT track, round(max_by(gain, i), 4) + 0.0 AS g_last, round(max(gain), 4) + 0.0 AS g_max FROM g GROUP BY 1""")
def transient_gain(spark, d):
    return dyn.transient_gain(ev(spark, d), AMOUNT, FS).select("track", r4(F.col("g_last")).alias("g_last"), r4(F.col("g_max")).alias("g_max"))


@query(f"""WITH RECURSIVE {EV}, g AS (SELECT DISTINCT track, -1::BIGINT AS i, 0.0::DOUBLE AS level, -80.0::DOUBLE AS env, 0.0::DOUBLE AS gr FROM sp UNION ALL
SELECT track, i, level, env, goal + CASE WHEN goal > gr THEN {decay(0.01)} ELSE {decay(0.15)} END * (gr - goal) FROM (
  SELECT *, CASE WHEN env + 20 >= 4 THEN (env + 20) * (1 - 1 / 1.6::DOUBLE) WHEN env + 20 > -4 THEN (1 - 1 / 1.6::DOUBLE) * pow(env + 24, 2) / 16 ELSE 0 END AS goal FROM (
    SELECT track, i, level, gr, db + CASE WHEN db > env THEN {decay(0.03)} ELSE {decay(0.25)} END * (env - db) AS env FROM (
      SELECT *, 10 * log10(level + 1e-12) AS db FROM (
        SELECT s.track, s.i, g.env, g.gr, g.level + (1 - {decay(0.005)}) * ((s.l * s.l + s.r * s.r) / 2 - g.level) AS level FROM g JOIN sp s ON s.track = g.track AND s.i = g.i + 1)))))
SELECT track, round(max_by(gr, i), 4) + 0.0 AS gr_last, round(max(gr), 4) + 0.0 AS gr_max FROM g GROUP BY 1""")
def compressor_gr(spark, d):
    return dyn.compressor_reduction(ev(spark, d), DENSITY, FS).select("track", r4(F.col("gr_last")).alias("gr_last"), r4(F.col("gr_max")).alias("gr_max"))


MS = EV.replace("sp AS (SELECT *,", "sp AS (SELECT track, idx, (l + r) / 2 AS l, (l - r) / 2 AS r,")
_BAND = "(WITH RECURSIVE {chain} SELECT track, sum(fl * fl) AS mid, sum(fr * fr) AS side FROM fs GROUP BY 1)"


@query(f"""SELECT track, round(CASE WHEN lo.mid > 0 THEN 10 * log10((lo.side + 1e-12) / (lo.mid + 1e-12)) ELSE -60.0::DOUBLE END, 4) + 0.0 AS side_bass_db,
round(CASE WHEN a.mid > 0 THEN 10 * log10((hi.mid + 1e-12) / (a.mid + 1e-12)) ELSE -60.0::DOUBLE END, 4) + 0.0 AS harsh_db
FROM {_BAND.format(chain=recursion([coefficients('low', 140.0)], 'lr', MS))} lo JOIN {_BAND.format(chain=recursion([coefficients('high', 4500.0)], 'lr', MS))} hi USING (track)
JOIN (WITH {MS} SELECT track, sum(l * l) AS mid FROM sp GROUP BY 1) a USING (track)""")
def bass_hf_ratios(spark, d):
    return dyn.bass_and_treble(ev(spark, d), 48000).select("track", r4(F.col("side_bass_db")).alias("side_bass_db"), r4(F.col("harsh_db")).alias("harsh_db"))


FLUX = f"WITH fx AS ({RAW_FLUX})"


@query(f"{FLUX} SELECT label, col, round(greatest(0, flux - avg(flux) OVER (PARTITION BY label ORDER BY col ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)), 4) + 0.0 AS d FROM fx")
def detrend_flux(spark, d):
    mean = F.avg("flux").over(W.partitionBy("label").orderBy("col").rowsBetween(-7, 0))
    return raw_flux(spark, d).select("label", "col", r4(F.greatest(F.lit(0.0), F.col("flux") - mean)).alias("d"))


@query(f"{FLUX} SELECT label, round(avg(flux), 4) + 0.0 AS mean, round(stddev_pop(flux), 4) + 0.0 AS sd, round(avg(flux) + 1.2 * stddev_pop(flux), 4) + 0.0 AS threshold FROM fx GROUP BY 1")
def novelty_threshold(spark, d):
    mean, sd = F.avg("flux"), F.stddev_pop("flux")
    return raw_flux(spark, d).groupBy("label").agg(r4(mean).alias("mean"), r4(sd).alias("sd"), r4(mean + 1.2 * sd).alias("threshold"))


@query(f"WITH ac AS ({ORACLES['autocorr_lags']}) SELECT track, lag, ac AS score FROM ac QUALIFY row_number() OVER (PARTITION BY track ORDER BY ac DESC, lag) = 1")
def best_lag(spark, d):
    best = F.max_by(F.struct("lag", "ac"), F.struct("ac", -F.col("lag")))  # ties: the smaller lag
    return QUERIES["autocorr_lags"](spark, d).groupBy("track").agg(best.alias("b")).select("track", "b.lag", F.col("b.ac").alias("score"))


@query(f"""{PYR}, s AS (SELECT track, bucket, round(sum(rms * rms) OVER w, 4) + 0.0 AS total, count(*) OVER w AS n FROM p0 WINDOW w AS (PARTITION BY track ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT track, bucket - 2 AS start, total FROM s WHERE n = 3 QUALIFY row_number() OVER (PARTITION BY track ORDER BY total DESC, bucket) = 1""")
def excerpt_loudest(spark, d):
    w = W.partitionBy("track").orderBy("bucket").rowsBetween(-2, 0)
    s = m.pyramid_base(event_signal(spark, d, "user_id")).withColumns({"total": r4(F.sum(F.col("rms") * F.col("rms")).over(w)), "n": F.count(F.lit(1)).over(w)}).where("n = 3")
    best = s.groupBy("track").agg(F.max_by(F.struct("bucket", "total"), F.struct("total", -F.col("bucket"))).alias("b"))
    return best.select("track", (F.col("b.bucket") - 2).alias("start"), "b.total")


@query(f"WITH {EV} SELECT track, CAST(floor((i - 7) / 25) AS BIGINT) AS beat, count(*) AS n, round(sum(l * l), 4) + 0.0 AS energy FROM sp WHERE i >= 7 GROUP BY 1, 2")
def beat_grid_join(spark, d):
    beat = F.floor((F.col("i") - 7) / 25)  # beats are even, so the range join is a computed key
    return positions(ev(spark, d)).where("i >= 7").groupBy("track", beat.alias("beat")).agg(F.count(F.lit(1)).alias("n"), r4(F.sum(F.col("l") * F.col("l"))).alias("energy"))


BANDS = [shelf(48000, 120, 3.0, high=False), peaking(48000, 450, -2.5, 0.9), peaking(48000, 3000, 4.0, 0.9), shelf(48000, 9000, 2.0)]


@query(f"""WITH b AS (SELECT * FROM (VALUES {', '.join(f"({k}, {', '.join(c)})" for k, c in enumerate([coefficients('lowshelf', 120.0, 3.0, 0.9), coefficients('peak', 450.0, -2.5, 0.9), coefficients('peak', 3000.0, 4.0, 0.9), coefficients('highshelf', 9000.0, 2.0, 0.9)]))}) v(band, b0, b1, b2, a1, a2)),
f AS (SELECT i AS freq_i, 2 * pi() * 20 * pow(1000, i / 179::DOUBLE) / 48000 AS w FROM (SELECT unnest(range(180)) AS i))
SELECT CAST(band AS BIGINT) AS band, CAST(freq_i AS BIGINT) AS freq_i, round(10 * log10((pow(b0 + b1 * cos(w) + b2 * cos(2 * w), 2) + pow(b1 * sin(w) + b2 * sin(2 * w), 2)) /
(pow(1 + a1 * cos(w) + a2 * cos(2 * w), 2) + pow(a1 * sin(w) + a2 * sin(2 * w), 2))), 4) + 0.0 AS db FROM b CROSS JOIN f""")
def eq_response(spark, d):
    w = F.lit(2 * 3.141592653589793 * 20 / 48000) * F.pow(F.lit(1000.0), F.col("id") / 179)
    rows = spark.range(180).withColumn("w", w).withColumn("c", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("band"), *[F.lit(v).alias(n) for n, v in zip(("b0", "b1", "b2", "a1", "a2"), c, strict=True)]) for k, c in enumerate(BANDS)])))
    power = lambda x, y, z: F.pow(x + y * F.cos("w") + z * F.cos(2 * F.col("w")), 2) + F.pow(y * F.sin("w") + z * F.sin(2 * F.col("w")), 2)
    gain = power(F.col("c.b0"), F.col("c.b1"), F.col("c.b2")) / power(F.lit(1.0), F.col("c.a1"), F.col("c.a2"))
    return rows.select("c.band", F.col("id").alias("freq_i"), r4(10 * F.log10(gain)).alias("db"))

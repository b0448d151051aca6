"""Queries on frames, bands and tempo, and their DuckDB oracles; importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.functions import r4
from quaver.operators import mastering as ma
from quaver.operators import spectra as sp
from quaver.plans.queries import EV, ev, query

T = sp.TempoSettings(fs=3000, size=64, hop=32, section=0.1, stride=0.02, gap=0.1, edges=(0.05, 0.1))

#: Power spectra of frames of 64 samples each 32, by sums of sines and cosines.
_DFT = f"""{EV}, m AS MATERIALIZED (SELECT track, i, (l + r) / 2 AS x FROM sp), n AS (SELECT track, max(i) + 1 AS n FROM m GROUP BY 1),
c AS (SELECT track, CAST(col AS BIGINT) AS col FROM n CROSS JOIN (SELECT unnest(range(1000)) AS col) WHERE col * 32 + 64 <= n),
fr AS MATERIALIZED (SELECT c.track, c.col, m.i - c.col * 32 AS j, x * (0.5 - 0.5 * cos(2 * pi() * (m.i - c.col * 32) / 63)) AS x FROM c JOIN m ON m.track = c.track AND m.i >= c.col * 32 AND m.i < c.col * 32 + 64),
dft AS MATERIALIZED (SELECT track, col, k, pow(sum(x * cos(2 * pi() * k * j / 64)), 2) + pow(sum(x * sin(2 * pi() * k * j / 64)), 2) AS power FROM fr, (SELECT unnest(range(33)) AS k) GROUP BY 1, 2, 3)"""
_LOG = "b AS (SELECT b, CAST(greatest(1, floor(20 * pow(1000::DOUBLE, b / 12::DOUBLE) / 750)) AS BIGINT) AS lo, CAST(ceil(20 * pow(1000::DOUBLE, (b + 1) / 12::DOUBLE) / 750) AS BIGINT) AS hi0 FROM (SELECT unnest(range(12)) AS b)), bb AS (SELECT b, lo, least(32, greatest(lo + 1, hi0)) AS hi FROM b)"


@query(f"""WITH {_DFT}, {_LOG}, e AS (SELECT track, col, b, sum(power) / any_value(hi - lo) AS e FROM dft JOIN bb ON k >= lo AND k < hi GROUP BY 1, 2, 3)
SELECT track, CAST(b AS BIGINT) AS band, round(10 * log10(avg(e) + 1e-14), 4) + 0.0 AS db FROM e GROUP BY 1, 2""")
def log_profile(spark, d):
    """Mean spectrum of each track in 12 logarithmic bands."""
    return sp.profile(ev(spark, d), 48_000, 64, 32, 12).select("track", F.col("band").cast("long").alias("band"), r4(F.col("db")).alias("db"))


@query(f"""WITH {_DFT}, {_LOG}, e AS (SELECT track, col, b, max(power) AS p FROM dft JOIN bb ON k >= lo AND k < hi GROUP BY 1, 2, 3)
SELECT track, col, CAST(b AS BIGINT) AS band, CAST(floor(greatest(0, least(255, (10 * log10(p / 256 + 1e-12) + 76) / 70 * 255))) AS BIGINT) AS v FROM e""")
def log_spectrogram(spark, d):
    """Loudest bin of 12 logarithmic bands on 256 steps; bytes made rows."""
    g = sp.spectrogram(ev(spark, d), 48_000, 64, 32, 12)
    byte = F.conv(F.substring(F.hex("v"), F.col("band").cast("int") * 2 + 1, 2), 16, 10).cast("long")
    return g.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(11)).cast("array<bigint>"))).select("track", "col", "band", byte.alias("v"))


_ON = f"""{_DFT}, mag AS MATERIALIZED (SELECT track, col, k, ln(1 + 20 * sqrt(power)) AS m FROM dft WHERE k >= 1 AND k < 32),
rise AS (SELECT track, col, k, greatest(0, m - lag(m, 1, 0.0::DOUBLE) OVER (PARTITION BY track, k ORDER BY col)) AS d FROM mag),
fx AS MATERIALIZED (SELECT track, col, sum(d) AS flux, sum(CASE WHEN k <= 5 THEN d ELSE 0 END) AS low FROM rise GROUP BY 1, 2),
ed AS (SELECT b, CAST(greatest(1, least(32, floor(60 * pow(200::DOUBLE, b / 8::DOUBLE) / 46.875 + 0.5))) AS BIGINT) AS a, CAST(greatest(1, least(32, floor(60 * pow(200::DOUBLE, (b + 1) / 8::DOUBLE) / 46.875 + 0.5))) AS BIGINT) AS z FROM (SELECT unnest(range(8)) AS b)),
bf AS MATERIALIZED (SELECT c.track, c.col, ed.b, log10(coalesce(sum(power) FILTER (WHERE k >= a AND k < z), 0) + 1e-10) AS e FROM c CROSS JOIN ed JOIN dft USING (track, col) GROUP BY 1, 2, 3)"""


@query(f"WITH {_ON} SELECT track, col, round(flux, 4) + 0.0 AS flux, round(low, 4) + 0.0 AS low, round(avg(e), 4) + 0.0 AS level FROM fx JOIN bf USING (track, col) GROUP BY track, col, flux, low")
def onset_features(spark, d):
    """Flux of all and of low bins without the lowest and the highest one, and the mean level of 8 bands."""
    on = sp.onsets(ev(spark, d), T)
    return on.select("track", "col", r4(F.col("flux")).alias("flux"), r4(F.col("low")).alias("low"), r4(F.aggregate("bands", F.lit(0.0), lambda a, b: a + b) / 8).alias("level"))


_ENV = f"""{_ON}, env AS MATERIALIZED (SELECT *, greatest(0, flux - avg(flux) OVER (PARTITION BY track ORDER BY col ROWS BETWEEN 93 PRECEDING AND CURRENT ROW)) AS d, count(*) OVER (PARTITION BY track) AS cols FROM fx),
lg AS (SELECT track, lag, cols, least(cols - 2, 94) AS last FROM (SELECT DISTINCT track, cols FROM env) CROSS JOIN (SELECT unnest(range(28, 95)) AS lag) WHERE lag <= least(cols - 2, 94)),
ac AS MATERIALIZED (SELECT lg.track, lg.lag, any_value(lg.last) AS last, coalesce(sum(a.d * b.d), 0) / any_value(lg.cols - lg.lag) AS ac FROM lg LEFT JOIN env a ON a.track = lg.track LEFT JOIN env b ON b.track = a.track AND b.col = a.col - lg.lag WHERE b.col IS NOT NULL GROUP BY 1, 2),
sc AS (SELECT ac.*, (ac.ac + 0.4 * coalesce(h.ac, 0)) * exp(-0.5 * pow(log2(60 / (ac.lag * 32 / 3000::DOUBLE) / 120) / 0.9, 2)) AS score FROM ac LEFT JOIN ac h ON h.track = ac.track AND h.lag = 2 * ac.lag)"""


@query(f"WITH {_ENV} SELECT track, CAST(lag AS BIGINT) AS lag, round(ac, 4) + 0.0 AS ac, round(score, 4) + 0.0 AS score FROM sc")
def beat_lag_scores(spark, d):
    """Autocorrelation at the lags from 60 to 200 beats a minute, and its score with the harmonic and the weight around 120."""
    env = sp.detrended(sp.onsets(ev(spark, d), T), T)
    return sp.beat_lags(env, T).select("track", "lag", r4(F.col("ac")).alias("ac"), r4(F.col("score")).alias("score"))


_BEST = f"""{_ENV}, nb AS (SELECT *, lag(ac) OVER w AS a, lead(ac) OVER w AS b, avg(ac) OVER (PARTITION BY track) AS mean FROM sc WINDOW w AS (PARTITION BY track ORDER BY lag)),
best AS MATERIALIZED (SELECT track, lag, mean, ac, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND abs(a - 2 * ac + b) > 1e-12 THEN lag + 0.5 * (a - b) / (a - 2 * ac + b) ELSE lag END AS refined FROM nb QUALIFY row_number() OVER (PARTITION BY track ORDER BY score DESC, lag) = 1)"""


@query(f"WITH {_BEST} SELECT track, CAST(lag AS BIGINT) AS lag, round(60 / (refined * 32 / 3000::DOUBLE), 3) AS bpm, round(CASE WHEN mean > 0 THEN greatest(0, least(1, (ac / mean - 1) / 4)) ELSE 0 END, 4) + 0.0 AS confidence FROM best")
def tempo_estimate(spark, d):
    env = sp.detrended(sp.onsets(ev(spark, d), T), T)
    best = sp.best_lags(sp.beat_lags(env, T), T)
    return best.select("track", "lag", F.round("bpm", 3).alias("bpm"), r4(F.col("confidence")).alias("confidence"))


_NOVEL = f"""{_ON}, lv AS (SELECT track, col, b, avg(e) OVER (w ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) - avg(e) OVER (w ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS d, count(*) OVER (PARTITION BY track, b) AS cols FROM bf WINDOW w AS (PARTITION BY track, b ORDER BY col)),
nv AS MATERIALIZED (SELECT track, col, sqrt(sum(d * d)) AS v FROM lv WHERE col >= 9 AND col < cols - 9 AND (col - 9) % 2 = 0 GROUP BY 1, 2),
t AS (SELECT *, avg(v) OVER (PARTITION BY track) + 1.2 * stddev_pop(v) OVER (PARTITION BY track) AS high, lag(v) OVER o AS a, lead(v) OVER o AS b FROM nv WINDOW o AS (PARTITION BY track ORDER BY col)),
cand AS MATERIALIZED (SELECT track, col, v, row_number() OVER (PARTITION BY track ORDER BY col) AS rn FROM t WHERE v > high AND v >= a AND v >= b),
walk AS (SELECT track, rn, col, v, 1 AS slot FROM cand WHERE rn = 1 UNION ALL
  SELECT c.track, c.rn, CASE WHEN c.col - w.col >= 0.1 * 3000 / 32 OR c.v > w.v THEN c.col ELSE w.col END, CASE WHEN c.col - w.col >= 0.1 * 3000 / 32 OR c.v > w.v THEN c.v ELSE w.v END, w.slot + CASE WHEN c.col - w.col >= 0.1 * 3000 / 32 THEN 1 ELSE 0 END
  FROM walk w JOIN cand c ON c.track = w.track AND c.rn = w.rn + 1),
bd AS (SELECT track, max_by(col, rn) * 32 / 3000::DOUBLE AS sec FROM walk GROUP BY track, slot)"""


@query(f"WITH RECURSIVE {_NOVEL} SELECT track, round(sec, 4) AS sec FROM bd")
def section_boundaries(spark, d):
    return sp.section_bounds(sp.onsets(ev(spark, d), T), T).select("track", F.round("sec", 4).alias("sec"))


@query(f"""WITH RECURSIVE {_NOVEL}, g AS (SELECT track, sec, past, sec - past AS down FROM (SELECT *, ((sec - 0.013) % 0.08 + 0.08) % 0.08 AS past FROM bd)),
s AS (SELECT track, greatest(0, CASE WHEN past < 0.04 THEN down ELSE down + 0.08 END) AS sec FROM g), dur AS (SELECT track, count(*) / 3000::DOUBLE AS dur FROM sp GROUP BY 1),
st AS (SELECT track, 0.0::DOUBLE AS sec FROM dur UNION ALL SELECT track, sec FROM s JOIN dur USING (track) WHERE sec > 0.05 AND sec < dur - 0.1),
p AS (SELECT track, row_number() OVER w - 1 AS seg, sec AS s0, coalesce(lead(sec) OVER w, dur) AS s1 FROM st JOIN dur USING (track) WINDOW w AS (PARTITION BY track ORDER BY sec)),
mn AS (SELECT p.track, p.seg, any_value(s0) AS s0, any_value(s1) AS s1, coalesce(sum(e) / count(DISTINCT col), -10) AS mean FROM p LEFT JOIN bf ON bf.track = p.track AND bf.col >= floor(s0 * 3000 / 32) AND bf.col < floor(s1 * 3000 / 32) GROUP BY 1, 2),
lt AS (SELECT track, list_sort(list(mean)) AS ms FROM mn GROUP BY 1),
lv2 AS (SELECT mn.*, CASE WHEN mean <= ms[CAST(floor(len(ms) / 3) AS INT) + 1] THEN 'LOW' WHEN mean >= ms[CAST(floor(len(ms) * 2 / 3) AS INT) + 1] THEN 'PEAK' ELSE 'MID' END AS level, len(ms) AS n FROM mn JOIN lt USING (track))
SELECT track, seg, round(s0, 4) AS "from", round(s1, 4) AS "to", CASE WHEN level = 'PEAK' THEN level WHEN seg = 0 THEN 'INTRO' WHEN seg = n - 1 THEN 'OUTRO' ELSE level END AS label FROM lv2""")
def sections_found(spark, d):
    """Sections between boundaries that were moved to bar lines of a fixed grid, by the level of their bands."""
    on = sp.onsets(ev(spark, d), T)
    lengths = ev(spark, d).groupBy("track").agg((F.count(F.lit(1)) / T.fs).alias("dur"))
    bars = lengths.select("track", F.lit(0.013).alias("first_bar"), F.lit(0.08).alias("bar"))
    got = sp.sections(on, sp.snapped(sp.section_bounds(on, T), bars), lengths, T)
    return got.select("track", "seg", F.round("start", 4).alias("from"), F.round("end", 4).alias("to"), "label")


@query()  # its steps have oracles; a test sets it on a song of 100 beats a minute
def tempo_of_tracks(spark, d):
    found, _ = sp.tempo(ev(spark, d), T)
    return found.select("track", F.round("bpm", 3).alias("bpm"), *[r4(F.col(c)).alias(c) for c in ("first_beat", "first_bar", "confidence")])


@query(f"""WITH RECURSIVE {_NOVEL}, g AS (SELECT track, k, ((sec - (0.004 + k * 0.02)) % 0.08 + 0.08) % 0.08 AS x FROM bd CROSS JOIN (SELECT unnest(range(4)) AS k)), s AS (SELECT track, CAST(k AS BIGINT) AS k, sum(least(x, 0.08 - x)) AS dist FROM g GROUP BY 1, 2)
SELECT track, k, round(dist, 4) + 0.0 AS dist FROM s QUALIFY row_number() OVER (PARTITION BY track ORDER BY round(dist, 9), k) = 1""")
def bar_anchor_seconds(spark, d):
    """The beat that puts bar lines of a fixed grid nearest to the boundaries found."""
    b = sp.section_bounds(sp.onsets(ev(spark, d), T), T).withColumns({"first_beat": F.lit(0.004), "beat": F.lit(0.02)})
    return ma.bar_offset_seconds(b).select("track", "k", r4(F.col("dist")).alias("dist"))


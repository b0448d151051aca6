"""Queries on stems, width, sections, diagnosis, presets and curve matching, and their DuckDB oracles; importing this registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.functions import half_up, r4
from quaver.operators import dynamics as dyn
from quaver.operators import mastering as ma
from quaver.operators import measure as m
from quaver.operators.intervals import first_and_count
from quaver.plans import dynamics  # noqa: F401  # registers queries that some of these build on
from quaver.plans.dims import PRESETS
from quaver.plans.queries import BLOCKS, EM, EU, EV, HOPS, LUFS, ORACLES, QUERIES, _values, dft, ev, query
from quaver.plans.sql import coefficients, decay, follow, recursion
from quaver.sources import event_signal, positions, read, written

FS, BLOCK, AMOUNT, DRIVE, WIDTH = 4800, 64, 0.8, 0.4, 1.3
LIT = "({!r}::DOUBLE)".format
BANDS = 7


@query(f"""WITH RECURSIVE {EV}, g AS (SELECT DISTINCT track, -1::BIGINT AS i, 0.0::DOUBLE AS fast, 0.0::DOUBLE AS slow FROM sp UNION ALL
SELECT track, i, {follow('fast', 'x', 0.0003, 0.035)}, {follow('slow', 'x', 0.02, 0.3)}
FROM (SELECT s.track, s.i, g.fast, g.slow, greatest(abs(s.l), abs(s.r)) AS x FROM g JOIN sp s ON s.track = g.track AND s.i = g.i + 1))
SELECT track, round(avg(least(1, greatest(0, (CASE WHEN slow > 1e-6 THEN fast / slow ELSE 1 END - 1.1::DOUBLE) / 1.2::DOUBLE))), 4) + 0.0 AS mean_weight FROM g WHERE i >= 0 GROUP BY 1""")
def stem_drums_gain(spark, d):
    return ma.drum_weight(ev(spark, d), FS).select("track", r4(F.col("mean_weight")).alias("mean_weight"))


_SIDE = EV.replace("sp AS (SELECT *,", "sp AS (SELECT *, (l - r) / 2 AS s,")


@query(f"""WITH RECURSIVE {recursion([coefficients('high', f, q=q, fs=4800) for f in (140.0, 2000.0) for q in (0.54, 1.31)], 's', _SIDE)}
SELECT track, round(sum(pow((l + r) / 2, 2)), 4) + 0.0 AS mid_e, round(sum(pow(1 * (s - sy1) + (1 + 0.3::DOUBLE * 0.7) * (sy1 - sy3) + (1 + 0.3::DOUBLE * 1.15) * sy3, 2)), 4) + 0.0 AS side_e
FROM f JOIN sp USING (track, i) GROUP BY 1""")
def width_ms(spark, d):
    mid, side = (F.col("l") + F.col("r")) / 2, (F.col("l") - F.col("r")) / 2
    return ma.widen(ev(spark, d), WIDTH, FS).groupBy("track").agg(r4(F.sum(mid * mid)).alias("mid_e"), r4(F.sum(side * side)).alias("side_e"))


_SAT = "((tanh(pow(10::DOUBLE, 0.2) * ({x} + 0.048)) - tanh(pow(10::DOUBLE, 0.2) * 0.048)) / pow(10::DOUBLE, 0.2))"


@query(f"WITH {EV} SELECT track, round(sum(pow({_SAT.format(x='l')}, 2) + pow({_SAT.format(x='r')}, 2)), 4) + 0.0 AS energy FROM ev GROUP BY 1")
def saturate_energy(spark, d):
    a, b = ma.saturate(F.col("l"), DRIVE), ma.saturate(F.col("r"), DRIVE)
    return ev(spark, d).groupBy("track").agg(r4(F.sum(a * a + b * b)).alias("energy"))


_D = ma.DEHARSH
_B0, _B1, _B2, _A1, _A2 = coefficients("high", 450.0, fs=4800)


@query(f"""WITH RECURSIVE {EV}, p AS MATERIALIZED (SELECT track, i, (l + r) / 2 AS x, i % {BLOCK} + 1 AS len, i % {BLOCK} = {BLOCK - 1} OR i = max(i) OVER (PARTITION BY track) AS done FROM sp),
g AS (SELECT DISTINCT track, -1::BIGINT AS i, 0.0::DOUBLE AS z1, 0.0::DOUBLE AS z2, 0.0::DOUBLE AS high, 0.0::DOUBLE AS wide, 0.0::DOUBLE AS gr FROM p UNION ALL
SELECT track, i, z1, z2, high, wide, CASE WHEN done THEN greatest(0, gr + least(1, CASE WHEN goal > gr THEN 1 - {decay(0.004)} ELSE 1 - {decay(0.12)} END * len) * (goal - gr)) ELSE gr END FROM (
  SELECT *, 0.8::DOUBLE * least(6, greatest(0, 20 * log10((high + 1e-9) / (wide + 1e-9)) + 8)) AS goal FROM (
    SELECT track, i, len, done, gr, {_B1} * x - {_A1} * y + z2 AS z1, {_B2} * x - {_A2} * y AS z2, {follow('high', 'abs(y)', 0.003, 0.08)} AS high, {follow('wide', 'abs(x)', 0.003, 0.08)} AS wide
    FROM (SELECT p.*, g.z1, g.z2, g.high, g.wide, g.gr, {_B0} * p.x + g.z1 AS y FROM g JOIN p ON p.track = g.track AND p.i = g.i + 1))))
SELECT track, round(max_by(gr, i), 4) + 0.0 AS gr_last, round(max(gr), 4) + 0.0 AS gr_max FROM g GROUP BY 1""")
def deharsh_gr(spark, d):
    got = ma.deharsh_reduction(ev(spark, d), AMOUNT, FS, BLOCK, corner=_D["corner"] / 10)
    return got.select("track", r4(F.col("gr_last")).alias("gr_last"), r4(F.col("gr_max")).alias("gr_max"))


@query(f"""{HOPS}, {BLOCKS}, b AS MATERIALIZED (SELECT track, hop, m FROM blocks WHERE n = 4 AND {LUFS.format('m')} > -70),
pts AS (SELECT track, hop FROM hops WHERE (hop + 1) % 5 = 0), x AS (SELECT pts.track, pts.hop, avg(m) AS a FROM pts JOIN b ON b.track = pts.track AND b.hop <= pts.hop GROUP BY 1, 2),
y AS (SELECT x.track, x.hop, {LUFS.format('avg(m)')} AS lufs FROM x JOIN b ON b.track = x.track AND b.hop <= x.hop AND m > x.a / 10 GROUP BY 1, 2)
SELECT pts.track, pts.hop, round(coalesce(lufs, -70.0::DOUBLE), 4) + 0.0 AS lufs FROM pts LEFT JOIN y USING (track, hop)""")
def loudness_expanding(spark, d):
    return ma.expanding_loudness(m.weighted_hops(ev(spark, d))).select("track", "hop", r4(F.col("lufs")).alias("lufs"))


@query()  # a fixed-point loop; tests compare it with plain numpy
def render_solve(spark, d):
    got = ma.solve_gain(ev(spark, d), -18.0, DRIVE)
    return got.select("track", r4(F.col("gain_db")).alias("gain_db"), "passes", r4(F.col("final_err")).alias("final_err"))


# --- spectra, tempo and sections

_SPEC = f"""{EM}, bands AS (SELECT CAST(b AS BIGINT) AS band, b * 4 + 1 AS lo, b * 4 + 6 AS hi FROM (SELECT unnest(range({BANDS})) AS b) t)"""


def banded(spectra: DataFrame) -> DataFrame:
    """Adds band; a bin can lie in two bands, which are known beforehand, so there is no join."""
    inside = [F.when((F.col("k") >= b * 4 + 1) & (F.col("k") < b * 4 + 6), F.lit(b).cast("long")) for b in range(BANDS)]
    return spectra.withColumn("band", F.explode(F.array_compact(F.array(*inside))))


def _power():
    return F.col("re") * F.col("re") + F.col("im") * F.col("im")


@query(f"""WITH {_SPEC} SELECT vec_id, band, CAST(floor(least(255, greatest(0, (10 * log10(max(re * re + im * im) / 256 + 1e-12) + 76) / 70 * 255))) AS BIGINT) AS v
FROM dft JOIN bands ON k >= lo AND k < hi GROUP BY 1, 2""")
def spectrogram_bytes(spark, d):
    """Loudest bin of each band on 256 steps from -76 to -6 dB."""
    db = 10 * F.log10(F.max(_power()) / 256 + 1e-12)
    return banded(dft(spark, d)).groupBy("vec_id", "band").agg(F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (db + 76) / 70 * 255))).alias("v"))


@query(f"WITH ac AS ({ORACLES['autocorr_lags']}) SELECT track, round(CASE WHEN avg(ac) > 0 THEN least(1, greatest(0, (max(ac) / avg(ac) - 1) / 4)) ELSE 0 END, 4) + 0.0 AS confidence FROM ac GROUP BY 1")
def tempo_confidence(spark, d):
    over = F.try_divide(F.max("ac"), F.avg("ac"))
    share = F.when(F.avg("ac") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (over - 1) / 4))).otherwise(0.0)
    return QUERIES["autocorr_lags"](spark, d).groupBy("track").agg(r4(share).alias("confidence"))


PERIOD, STEPS = 5.5, 22


@query(f"""WITH fx AS ({ORACLES['spectral_flux']}), n AS (SELECT label, max(col) AS last FROM fx GROUP BY 1), o AS (SELECT unnest(range({STEPS})) * {LIT(PERIOD / STEPS)} AS "offset"),
g AS (SELECT label, "offset", CAST(floor("offset" + j * {LIT(PERIOD)} + 0.5) AS BIGINT) AS col FROM n CROSS JOIN o CROSS JOIN (SELECT unnest(range((SELECT max(col) + 1 FROM fx))) AS j) WHERE "offset" + j * {LIT(PERIOD)} <= last),
s AS (SELECT label, "offset", sum(flux * flux) AS s FROM g JOIN fx USING (label, col) GROUP BY 1, 2)
SELECT label, "offset", round(s, 2) + 0.0 AS s FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, "offset") = 1""")
def beat_phase(spark, d):
    """Offset of the beat grid with the greatest squared flux: each column finds the grids it lies on by itself."""
    k = lambda offset: F.ceil((F.col("col") - 0.5 - offset) / PERIOD)  # noqa: E731  # first beat that rounds to this column or a later one
    hits = [F.when((half_up(k(o) * PERIOD + o) == F.col("col")) & (k(o) >= 0) & (k(o) * PERIOD + o <= F.col("last")), F.lit(o)) for o in (n * PERIOD / STEPS for n in range(STEPS))]
    flux = QUERIES["spectral_flux"](spark, d).withColumn("last", F.max("col").over(W.partitionBy("label")))
    s = flux.select("label", "flux", F.explode(F.array_compact(F.array(*hits))).alias("offset")).groupBy("label", "offset").agg(F.sum(F.col("flux") * F.col("flux")).alias("s"))
    best = F.max_by(F.struct("offset", "s"), F.struct("s", -F.col("offset")))
    return s.groupBy("label").agg(best.alias("b")).select("label", "b.offset", (F.round("b.s", 2) + F.lit(0.0)).alias("s"))


_NOV = f"""WITH {_SPEC}, c AS (SELECT *, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS col FROM dft),
lv AS (SELECT label, col, band, log10(sum(re * re + im * im) + 1e-10) AS level FROM c JOIN bands ON k >= lo AND k < hi GROUP BY 1, 2, 3),
d AS (SELECT label, col, avg(level) OVER a - avg(level) OVER b AS d, count(*) OVER a + count(*) OVER b AS n FROM lv
  WINDOW a AS (PARTITION BY label, band ORDER BY col ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), b AS (PARTITION BY label, band ORDER BY col ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
nov AS (SELECT label, col, round(sqrt(sum(d * d)), 4) + 0.0 AS v FROM d WHERE n = 8 GROUP BY 1, 2)"""


@query(f"{_NOV} SELECT label, col, v FROM nov")
def novelty(spark, d):
    col = F.dense_rank().over(W.partitionBy("label").orderBy("vec_id")).cast("long") - 1
    levels = banded(dft(spark, d).withColumn("col", col)).groupBy("label", "col", "band").agg(F.log10(F.sum(_power()) + 1e-10).alias("level"))
    return ma.novelty(levels, 4).select("label", "col", r4(F.col("v")).alias("v"))


SIGMAS, GAP = 1.2, 8
_PEAKS = f"""{_NOV.replace('WITH ', 'WITH RECURSIVE ', 1)}, t AS (SELECT *, avg(v) OVER w + {SIGMAS} * stddev_pop(v) OVER w AS high, lag(v) OVER o AS a, lead(v) OVER o AS b FROM nov WINDOW w AS (PARTITION BY label), o AS (PARTITION BY label ORDER BY col)),
cand AS MATERIALIZED (SELECT label, col, v, row_number() OVER (PARTITION BY label ORDER BY col) AS rn FROM t WHERE v > high AND v >= a AND v >= b),
walk AS (SELECT label, rn, col, v, 1 AS slot FROM cand WHERE rn = 1 UNION ALL
  SELECT c.label, c.rn, CASE WHEN c.col - w.col >= {GAP} OR c.v > w.v THEN c.col ELSE w.col END, CASE WHEN c.col - w.col >= {GAP} OR c.v > w.v THEN c.v ELSE w.v END, w.slot + CASE WHEN c.col - w.col >= {GAP} THEN 1 ELSE 0 END
  FROM walk w JOIN cand c ON c.label = w.label AND c.rn = w.rn + 1),
peaks AS (SELECT label, max_by(col, rn) AS col, max_by(v, rn) AS v FROM walk GROUP BY label, slot)"""


@query(f"{_PEAKS} SELECT label, col, v FROM peaks")
def peak_pick(spark, d):
    return ma.pick_peaks(novelty(spark, d), SIGMAS, GAP)


@query(f"""{_PEAKS}, m AS (SELECT label, k, ((col - (1 + 4 * k)) % 16 + 16) % 16 AS x FROM peaks CROSS JOIN (SELECT unnest(range(4)) AS k)),
s AS (SELECT label, CAST(k AS BIGINT) AS k, CAST(sum(least(x, 16 - x)) AS BIGINT) AS dist FROM m GROUP BY 1, 2)
SELECT label, k, dist FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY dist, k) = 1""")
def bar_anchor(spark, d):
    return ma.bar_offset(peak_pick(spark, d), first=1, beat=4)


@query(f"""WITH {EV}, s AS (SELECT track, CAST(floor(i * 6 / n) AS BIGINT) AS seg, round(avg(l * l), 8) AS mean FROM (SELECT *, count(*) OVER (PARTITION BY track) AS n FROM sp) GROUP BY 1, 2),
t AS (SELECT track, list_sort(list(mean)) AS ms FROM s GROUP BY 1),
c AS (SELECT track, seg, mean, CASE WHEN mean <= ms[CAST(floor(len(ms) / 3) AS INT) + 1] THEN 'LOW' WHEN mean >= ms[CAST(floor(len(ms) * 2 / 3) AS INT) + 1] THEN 'PEAK' ELSE 'MID' END AS level FROM s JOIN t USING (track))
SELECT track, seg, round(mean, 6) AS mean, CASE WHEN level = 'PEAK' THEN level WHEN seg = 0 THEN 'INTRO' WHEN seg = max(seg) OVER (PARTITION BY track) THEN 'OUTRO' ELSE level END AS label FROM c""")
def section_label(spark, d):
    six = F.floor(F.col("i") * 6 / F.count(F.lit(1)).over(W.partitionBy("track")))
    parts = positions(ev(spark, d)).withColumn("seg", six).groupBy("track", "seg").agg(F.round(F.avg(F.col("l") * F.col("l")), 8).alias("mean"))
    return ma.label_sections(parts).select("track", "seg", F.round("mean", 6).alias("mean"), "label")


#: Sections of a layout: start, end, name. They overlap; the first that holds a position wins.
SECTIONS = [(0, 60, "intro"), (50, 140, "verse"), (140, 400, "chorus"), (350, 900, "drop")]


@query(f"""WITH {EV} SELECT track, idx, min_by(name, a) AS label FROM sp JOIN (VALUES {', '.join(map(repr, SECTIONS))}) s(a, b, name) ON i >= a AND i < b GROUP BY 1, 2""")
def section_lookup(spark, d):
    where = F.coalesce(*[F.when((F.col("i") >= a) & (F.col("i") < b), F.lit(name)) for a, b, name in SECTIONS])  # a few fixed ranges: no join
    return positions(ev(spark, d)).select("track", "idx", where.alias("label")).where("label IS NOT NULL")


@query(f"""WITH {EV}, lane AS (SELECT * FROM ({ORACLES['short_term_series']})), n AS (SELECT track, max(p) AS last FROM lane GROUP BY 1)
SELECT sp.track, sp.idx, lane.st FROM sp JOIN n USING (track) JOIN lane ON lane.track = sp.track AND lane.p = least(n.last, CAST(floor(sp.i / 50 + 0.5) AS BIGINT))""")
def lane_nearest(spark, d):
    """The loudness lane at each sample: the nearest point is a computed key, held at the end."""
    lane = QUERIES["short_term_series"](spark, d)
    last = lane.groupBy("track").agg(F.max("p").alias("last"))  # one row per track
    s = positions(ev(spark, d)).join(last, "track").withColumn("p", F.least("last", half_up(F.col("i") / 50)))
    return s.join(lane, ["track", "p"]).select("track", "idx", "st")


# --- rules on facts

_FACTS = f"""facts AS (SELECT * FROM ({ORACLES['bass_hf_ratios']}) JOIN ({ORACLES['corr_weighted_mean']}) USING (track)
JOIN (WITH {EV} SELECT track, round(CASE WHEN sum(l * l) > 0 AND sum(r * r) > 0 THEN 10 * log10(sum(r * r) / sum(l * l)) ELSE 0 END, 4) + 0.0 AS bal_db FROM ev GROUP BY 1) USING (track))"""


def facts(spark, d) -> DataFrame:
    balance = m.balance_offset(ev(spark, d)).select("track", r4(F.col("bal_db")).alias("bal_db"))
    return QUERIES["bass_hf_ratios"](spark, d).join(QUERIES["corr_weighted_mean"](spark, d), "track").join(balance, "track")


#: Fixed rules: check, what fails it, issue, what the fix sets.
RULES = [
    ("bass placement", "side_bass_db > -12", "bassmono", "1.0"),
    ("width stability", "corr_worst < 0.15 OR corr_mean < 0.5", "width", "CASE WHEN corr_worst < 0 OR corr_mean < 0.35 THEN 0.85 ELSE 0.92 END"),
    ("image balance", "abs(bal_db) >= 0.3", "balance", "-bal_db"),
    ("hf texture", "harsh_db > -10", "smooth", "CASE WHEN harsh_db > -7 THEN 0.5 ELSE 0.3 END"),
]


def _ruled(spark, d) -> DataFrame:
    each = [F.struct(F.lit(c).alias("check"), F.expr(bad).alias("bad"), F.lit(i).alias("issue"), F.expr(v).cast("double").alias("value")) for c, bad, i, v in RULES]
    return facts(spark, d).select("track", F.inline(F.array(*each)))


@query(f"""WITH {_FACTS} SELECT track, unnest(['bass placement', 'width stability', 'image balance', 'hf texture']) AS "check", unnest([side_bass_db <= -12, corr_worst >= 0.15 AND corr_mean >= 0.5, abs(bal_db) < 0.3, harsh_db <= -10]) AS pass FROM facts""")
def diagnosis_checks(spark, d):
    return _ruled(spark, d).select("track", "check", (~F.col("bad")).alias("pass"))


@query(f"""WITH {_FACTS} SELECT track, 'bassmono' AS issue, 1.0::DOUBLE AS value FROM facts WHERE side_bass_db > -12 UNION ALL SELECT track, 'balance', 0.0 - bal_db FROM facts WHERE bal_db >= 0.3 OR bal_db <= -0.3
UNION ALL SELECT track, 'width', if(corr_worst < 0 OR corr_mean < 0.35, 0.85::DOUBLE, 0.92::DOUBLE) FROM facts WHERE least(corr_worst - 0.15, corr_mean - 0.5) < 0 UNION ALL SELECT track, 'smooth', if(harsh_db > -7, 0.5::DOUBLE, 0.3::DOUBLE) FROM facts WHERE harsh_db > -10""")
def diagnosis_issues(spark, d):
    return _ruled(spark, d).where("bad").select("track", "issue", (F.col("value") + F.lit(0.0)).alias("value"))


_DYN = f"""SELECT track, round(tp_db - lufs, 4) + 0.0 AS plr, lra, CASE WHEN tp_db - lufs < 8 THEN 'crushed' WHEN tp_db - lufs > 14 THEN 'dynamic' ELSE '' END AS class,
CASE WHEN lra < 4 THEN 'flat' WHEN lra > 12 THEN 'wide' ELSE '' END AS range_class
FROM ({{tp}}) JOIN ({ORACLES['integrated_loudness']}) USING (track) JOIN ({ORACLES['loudness_range']}) USING (track)"""


@query(_DYN.format(tp=ORACLES["true_peak"]))
def dynamics_report(spark, d):
    """Peak to loudness and loudness range, with words for what is unusual."""
    all_ = QUERIES["true_peak"](spark, d).join(QUERIES["integrated_loudness"](spark, d), "track").join(QUERIES["loudness_range"](spark, d), "track")
    plr = F.col("tp_db") - F.col("lufs")
    words = lambda x, lo, hi, a, b: F.when(x < lo, a).when(x > hi, b).otherwise("")
    return all_.select("track", r4(plr).alias("plr"), "lra", words(plr, 8, 14, "crushed", "dynamic").alias("class"), words(F.col("lra"), 4, 12, "flat", "wide").alias("range_class"))


@query(f"""WITH {_FACTS}, pk AS (WITH {EV} SELECT track, round(20 * log10(greatest(max(greatest(abs(l), abs(r))), 1e-10)), 4) + 0.0 AS peak_db FROM ev GROUP BY 1)
SELECT track, lufs, lra, tp_db, peak_db, bal_db, side_bass_db, harsh_db, corr_mean, corr_worst FROM facts JOIN pk USING (track) JOIN ({ORACLES['integrated_loudness']}) USING (track) JOIN ({ORACLES['loudness_range']}) USING (track) JOIN ({ORACLES['true_peak']}) USING (track)""")
def analysis(spark, d):
    """All figures of a track in one row; the weighted hops are made once."""
    s = ev(spark, d)
    hops = written(m.weighted_hops(s))
    parts = [m.integrated_loudness(hops), m.loudness_range(hops), dyn.true_peaks(s).groupBy("track").agg((20 * F.log10(F.greatest(F.max("peak"), F.lit(1e-10)))).alias("tp_db"))]
    parts += [m.sample_peak(s), m.balance_offset(s), dyn.bass_and_treble(s, 48000), m.correlation_summary(m.window_correlation(s))]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "track")
    return out.select("track", *[r4(F.col(c)).alias(c) for c in ("lufs", "lra", "tp_db", "peak_db", "bal_db", "side_bass_db", "harsh_db", "corr_mean", "corr_worst")])


#: Fixed rules in order: preset, condition on tempo and band levels against the mean.
STYLES = [
    ("dnb", "bpm >= 155 AND sub > 2"),
    ("house", "bpm BETWEEN 118 AND 138 AND sub > 1.5"),
    ("electronic", "bpm >= 95 AND bpm < 118 AND sub > 1.5"),
    ("hiphop", "bpm BETWEEN 80 AND 108 AND sub > 3.5"),
    ("rnb", "bpm > 0 AND bpm < 92 AND bright < -5"),
    ("pop", "bright > 1.5 AND bpm BETWEEN 100 AND 145"),
    ("rock", "mid > 1"),
]
@query("""WITH s AS (SELECT l_suppkey, epoch(l_shipdate) / 86400 AS a, epoch(l_shipdate) / 86400 + l_quantity * CASE WHEN l_linenumber = 7 THEN 40 ELSE 1 END AS b, l_orderkey * 10 + l_linenumber AS section FROM lineitem),
p AS (SELECT o_orderkey, o_custkey % 100 AS l_suppkey, epoch(o_orderdate) / 86400 + 0.5 AS day FROM orders)
SELECT o_orderkey, min_by(section, struct_pack(a := a, s := section)) AS section, count(*) AS n FROM p JOIN s ON s.l_suppkey = p.l_suppkey AND day >= a AND day < b GROUP BY 1""")
def sections_from_tables(spark, d):
    """For each order the section of its supplier's layout that holds its day and begins first; sections are days of delivery, of any number and overlap."""
    day = lambda c: F.unix_timestamp(F.col(c).cast("timestamp")) / 86400
    end = F.col("start") + F.col("l_quantity") * F.when(F.col("l_linenumber") == 7, 40).otherwise(1)
    sections = read(spark, d, "lineitem").select("l_suppkey", day("l_shipdate").alias("start"), "l_quantity", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("section")).withColumn("end", end).drop("l_quantity", "l_linenumber")
    points = read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("l_suppkey"), (day("o_orderdate") + 0.5).alias("at"))
    suppliers = points.select("l_suppkey").distinct()  # fewer than 200 by the remainder
    near = sections.join(F.broadcast(suppliers), "l_suppkey", "left_semi")
    found = first_and_count(points, near, ["l_suppkey"], "section")
    return found.groupBy("o_orderkey").agg(F.min("first")["section"].alias("section"), F.sum("n").alias("n"))


SHARES = {"sub": (20, 90), "mid": (250, 2000), "bright": (6000, 16000)}
_STYLE = f"CASE {' '.join(f"WHEN {c} THEN '{name}'" for name, c in STYLES)} ELSE 'pop' END"
_MIDDLES = [20 * 1000 ** ((b + 0.5) / BANDS) for b in range(BANDS)]
_IN = {k: [b for b, f in enumerate(_MIDDLES) if lo <= f < hi] for k, (lo, hi) in SHARES.items()}


@query(f"""WITH p AS ({ORACLES['band_profile']}), s AS (SELECT label, 70.0::DOUBLE + 12 * label AS bpm, {', '.join(f"round(avg(db) FILTER (WHERE 20 * pow(1000::DOUBLE, (band + 0.5) / 7) >= {lo} AND 20 * pow(1000::DOUBLE, (band + 0.5) / 7) < {hi}) - avg(db), 4) AS {k}" for k, lo, hi in (('sub', 20, 90), ('mid', 250, 2000), ('bright', 6000, 16000)))} FROM p GROUP BY 1)
SELECT label, CASE WHEN bpm >= 155 AND sub > 2 THEN 'dnb' WHEN bpm >= 118 AND bpm <= 138 AND sub > 1.5 THEN 'house' WHEN bpm >= 95 AND bpm < 118 AND sub > 1.5 THEN 'electronic' WHEN bpm >= 80 AND bpm <= 108 AND sub > 3.5 THEN 'hiphop'
WHEN bpm > 0 AND bpm < 92 AND bright < -5 THEN 'rnb' WHEN bright > 1.5 AND bpm >= 100 AND bpm <= 145 THEN 'pop' WHEN mid > 1 THEN 'rock' ELSE 'pop' END AS preset FROM s""")
def auto_preset(spark, d):
    share = lambda k: F.round(F.avg(F.when(F.col("band").isin(_IN[k]), F.col("db"))) - F.avg("db"), 4).alias(k)
    s = QUERIES["band_profile"](spark, d).groupBy("label").agg(*map(share, SHARES)).withColumn("bpm", 70.0 + 12 * F.col("label"))
    return s.select("label", F.expr(_STYLE).alias("preset"))


@query(f"SELECT p_partkey, id AS preset, target FROM part JOIN {_values(PRESETS, 'p(id, target, ceiling)')} ON p.id = 'preset' || (p_partkey % 7)")
def preset_mandatory(spark, d):
    presets = spark.createDataFrame(PRESETS, "preset string, target double, ceiling double")  # a fixed dimension of a few rows
    p = read(spark, d, "part").withColumn("preset", F.concat(F.lit("preset"), (F.col("p_partkey") % 7).cast("string")))
    return p.join(F.broadcast(presets), "preset").select("p_partkey", "preset", "target")


@query(f"""WITH {EU}, t AS (SELECT track, count(*) AS n, max(greatest(abs(l), abs(r))) AS peak FROM sp GROUP BY 1)
SELECT track, CASE WHEN n < 10 THEN 'failed' WHEN peak >= 0.38 THEN 'hot' ELSE 'done' END AS status FROM t""")
def batch_status(spark, d):
    """What becomes of each track of a batch; one that is too short fails by itself."""
    t = event_signal(spark, d, "user_id").groupBy("track").agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.abs("l"), F.abs("r"))).alias("peak"))
    return t.select("track", F.when(F.col("n") < 10, "failed").when(F.col("peak") >= 0.38, "hot").otherwise("done").alias("status"))


# --- matching curves

_AT = """(SELECT centre, CAST(i0 AS INTEGER) AS i0, CAST(least(6, i0 + 1) AS INTEGER) AS i1, greatest(0, least(1, pos - i0)) AS t FROM (SELECT *, greatest(0, least(6, floor(pos))) AS i0 FROM (SELECT centre, ln(centre / 20) / ln(1000) * 7 - 0.5 AS pos
FROM (VALUES (31.5::DOUBLE), (63.0::DOUBLE), (125.0::DOUBLE), (250.0::DOUBLE), (500.0::DOUBLE), (1000.0::DOUBLE), (2000.0::DOUBLE), (4000.0::DOUBLE), (8000.0::DOUBLE), (16000.0::DOUBLE)) v(centre)))) AS c"""


@query(f"WITH p AS ({ORACLES['band_profile']}) SELECT a.label, centre, round(a.db * (1 - t) + b.db * t, 6) + 0.0 AS gain FROM {_AT} JOIN p a ON a.band = i0 JOIN p b ON b.band = i1 AND b.label = a.label")
def interp_bands(spark, d):
    curve = QUERIES["band_profile"](spark, d).withColumnRenamed("db", "level")
    return ma.at_centres(curve, ["label"], BANDS).select("label", "centre", (F.round("level", 6) + F.lit(0.0)).alias("gain"))


@query(f"""WITH p AS ({ORACLES['band_profile']}), r AS (SELECT a.label AS src, b.label AS ref, a.band, b.db - a.db AS d FROM p a JOIN p b ON b.label = a.label + 1 AND b.band = a.band),
z AS (SELECT src, ref, band, d - avg(d) OVER (PARTITION BY src, ref) AS d FROM r),
s AS (SELECT src, ref, band, (coalesce(lag(d) OVER w, d) + 2 * d + coalesce(lead(d) OVER w, d)) / 4 AS v FROM z WINDOW w AS (PARTITION BY src, ref ORDER BY band))
SELECT a.src, a.ref, centre, round(greatest(-6, least(6, a.v * (1 - t) + b.v * t)), 6) + 0.0 AS gain FROM {_AT} JOIN s a ON a.band = i0 JOIN s b ON b.band = i1 AND b.src = a.src AND b.ref = a.ref""")
def match_curve(spark, d):
    """Gains that bring the spectrum of one label to the shape of the next."""
    p = QUERIES["band_profile"](spark, d)
    pairs = p.select(F.col("label").alias("src"), "band", F.col("db").alias("a")).join(p.select(F.col("label").alias("ref"), (F.col("label") - 1).alias("src"), "band", F.col("db").alias("b")), ["src", "band"])
    gains = ma.at_centres(ma.shape_difference(pairs, ["src", "ref"]), ["src", "ref"], BANDS)
    return gains.select("src", "ref", "centre", (F.round(F.greatest(F.lit(-6.0), F.least(F.lit(6.0), F.col("level"))), 6) + F.lit(0.0)).alias("gain"))


# --- lossless coding and names

@query("""WITH q AS (SELECT event_type AS track, event_id AS idx, CAST(floor(value * 100 + 0.5) AS BIGINT) AS l, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) * 100 AS r FROM events),
c AS (SELECT *, l - r AS s, (l + r) >> 1 AS m FROM q), x AS (SELECT track, l - lag(l) OVER w AS l, r - lag(r) OVER w AS r, m - lag(m) OVER w AS m, s - lag(s) OVER w AS s FROM c WINDOW w AS (PARTITION BY track ORDER BY idx)),
t AS (SELECT track, sum(abs(l)) AS l, sum(abs(r)) AS r, sum(abs(m)) AS m, sum(abs(s)) AS s FROM x GROUP BY 1)
SELECT track, CAST(list_position([l + r, l + s, s + r, m + s], least(l + r, l + s, s + r, m + s)) - 1 AS BIGINT) AS assign, CAST(least(l + r, l + s, s + r, m + s) AS BIGINT) AS cost FROM t""")
def stereo_cost(spark, d):
    """Cheapest channel pair of each track by first differences: left and right, left and side, side and right, mid and side; first of ties."""
    k = F.get_json_object("props", "$.k").cast("long") * 100
    q = read(spark, d, "events").select(F.col("event_type").alias("track"), F.col("event_id").alias("idx"), half_up(F.col("value") * 100).cast("long").alias("l"), k.alias("r"))
    c = q.withColumns({"s": F.col("l") - F.col("r"), "m": F.shiftright(F.col("l") + F.col("r"), 1)})
    o = W.partitionBy("track").orderBy("idx")
    t = c.select("track", *[F.abs(F.col(x) - F.lag(x).over(o)).alias(x) for x in "lrms"]).groupBy("track").agg(*[F.sum(x).alias(x) for x in "lrms"])
    costs = F.array(*[F.col(a) + F.col(b) for a, b in ("lr", "ls", "sr", "ms")])
    return t.select("track", (F.array_position(costs, F.array_min(costs)) - 1).alias("assign"), F.array_min(costs).alias("cost"))


@query(r"""SELECT c_custkey, lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || ' - ' || regexp_replace(c_name, '[<>:"/\\|?*#\x00-\x1f]', '_', 'g') || ' (' || lower(c_mktsegment) || ').wav' AS s FROM customer""")
def filename_template(spark, d):
    name = F.regexp_replace("c_name", r'[<>:"/\\|?*#\x00-\x1f]', "_")
    return read(spark, d, "customer").select("c_custkey", F.concat(F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit(" - "), name, F.lit(" ("), F.lower("c_mktsegment"), F.lit(").wav")).alias("s"))


# --- stem lanes, and frames of long signals

LANE_FS, LANE_DB = 48000, 3.0
_EXTRA = "(pow(10::DOUBLE, 3 / 20::DOUBLE) - 1)"
#: The oracle's lanes: kind, corner, qualities.
_LANE_FILTERS = {"bass": [("low", 120.0, q) for q in (0.54, 1.31)], "vocal": [(k, f, q) for k, f in (("high", 250.0), ("low", 3500.0)) for q in (0.54, 1.31)], "air": [("low", 8000.0, q) for q in (0.54, 1.31)]}
_MONO = EV.replace("sp AS (SELECT *,", "sp AS (SELECT *, (l + r) / 2 AS m,")


def _lane_sql(lane: str) -> str:
    by = ("m",) if lane == "vocal" else ("l", "r")
    fl, fr = ("fs.fm", "fs.fm") if lane == "vocal" else ("fs.fl", "fs.fr") if lane == "bass" else ("(l - fs.fl)", "(r - fs.fr)")
    return f"""SELECT * FROM (WITH RECURSIVE {recursion([coefficients(k, f, q=q) for k, f, q in _LANE_FILTERS[lane]], by, _MONO)}
SELECT track, '{lane}' AS lane, round(sum(pow(l + {_EXTRA} * {fl}, 2) + pow(r + {_EXTRA} * {fr}, 2)), 4) + 0.0 AS energy FROM sp JOIN fs USING (track, i) GROUP BY 1)"""


@query(" UNION ALL ".join(map(_lane_sql, ma.LANES)))
def stem_lanes(spark, d):
    energy = r4(F.sum(F.col("l") * F.col("l") + F.col("r") * F.col("r"))).alias("energy")
    each = [ma.lane_gain(ev(spark, d), lane, LANE_DB, LANE_FS).groupBy("track").agg(energy).withColumn("lane", F.lit(lane)) for lane in ma.LANES]
    return each[0].unionByName(each[1]).unionByName(each[2]).select("track", "lane", "energy")


@query(f"""WITH {EV}, g AS (SELECT track, col, i - col * 32 AS j, (l + r) / 2 AS x FROM sp CROSS JOIN (SELECT unnest([0, 1]) AS back) JOIN (SELECT unnest(range((SELECT max(i) // 32 + 1 FROM sp))) AS col) ON col = i // 32 - back),
f AS (SELECT *, count(*) OVER (PARTITION BY track, col) AS n FROM g),
p AS (SELECT track, col, k, pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * j / 63)) * cos(2 * pi() * k * j / 64)), 2) + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * j / 63)) * sin(2 * pi() * k * j / 64)), 2) AS power
FROM f, (SELECT unnest(range(33)) AS k) WHERE n = 64 GROUP BY 1, 2, 3)
SELECT track, CAST(col AS BIGINT) AS col, CAST(k AS BIGINT) AS k, round(power, 4) + 0.0 AS power FROM p""")
def framed_spectrum(spark, d):
    frames = ma.framed(positions(ev(spark, d)), 64, 32)
    return ma.powers(frames, ["track", "col"], 64).select("track", "col", "k", r4(F.col("power")).alias("power"))

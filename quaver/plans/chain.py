"""Queries on the chain with samples, and their DuckDB oracles with constants of their own; importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.functions import r4
from quaver.operators import chain as ch
from quaver.operators import measure as m
from quaver.plans.queries import EV, ev, query
from quaver.plans.sql import between, coefficients, decay, follow, recursion
from quaver.sources import positions, read

FS = 48000

# Oracles spell out their constants where they are used.

_ENERGY = "round(sum(fl * fl), 4) + 0.0 AS e_l, round(sum(fr * fr), 4) + 0.0 AS e_r"


def _shown(signal):
    e = ch.energies(signal)
    return e.select("track", r4(F.col("e_l")).alias("e_l"), r4(F.col("e_r")).alias("e_r"))


RUMBLE = coefficients("high", 18.0)


@query(f"WITH RECURSIVE {recursion([RUMBLE, coefficients('lowshelf', 700.0, -2.7, 0.6), coefficients('highshelf', 700.0, 2.7, 0.6)], "lr", EV)} SELECT track, {_ENERGY} FROM fs GROUP BY 1")
def tilt_eq(spark, d):
    return _shown(ch.filtered(ev(spark, d), ch.equaliser(ch.Settings(tone=0.6), FS)))


@query(f"WITH RECURSIVE {recursion([RUMBLE, coefficients('peak', 3000.0, 2.0, 0.9), coefficients('peak', 450.0, -1.25, 0.9), coefficients('highshelf', 13000.0, 4.2, 0.75)], "lr", EV)} SELECT track, {_ENERGY} FROM fs GROUP BY 1")
def shape_and_air_eq(spark, d):
    return _shown(ch.filtered(ev(spark, d), ch.equaliser(ch.Settings(shape=0.5, air=0.7), FS)))


MATCH = (3.0, 0.01, -2.0, 0.0, 0.0, 1.5, 0.0, 0.0, 0.0, 4.0)  # the second and the zeros are too small to count


@query(f"""WITH RECURSIVE {recursion([RUMBLE, coefficients('lowshelf', 31.5 * 1.4, 3.0, 0.8), coefficients('peak', 125.0, -2.0, 1.1), coefficients('peak', 1000.0, 1.5, 1.1), coefficients('highshelf', 16000 * 0.8, 4.0, 0.8)], "lr", EV)}
SELECT track, {_ENERGY} FROM fs GROUP BY 1""")
def match_eq(spark, d):
    return _shown(ch.filtered(ev(spark, d), ch.equaliser(ch.Settings(match=MATCH), FS)))


ADVANCED = ((True, "lowshelf", 100.0, 2.0, 0.7), (True, "peak", 250.0, -3.0, 1.4), (False, "peak", 800.0, 5.0, 1.0), (True, "peak", 2500.0, 0.04, 1.0), (True, "highshelf", 12000.0, -2.0, 0.8))


@query(f"WITH RECURSIVE {recursion([RUMBLE, coefficients('lowshelf', 100.0, 2.0, 0.9), coefficients('peak', 250.0, -3.0, 1.4), coefficients('highshelf', 12000.0, -2.0, 0.9)], "lr", EV)} SELECT track, {_ENERGY} FROM fs GROUP BY 1")
def advanced_eq(spark, d):
    return _shown(ch.filtered(ev(spark, d), ch.equaliser(ch.Settings(advanced=ADVANCED), FS)))


_LOW = 4800  # the dynamics at a tenth of the rate, so that short tracks meet them


_COMP = f"""g AS (SELECT DISTINCT track, -1::BIGINT AS i, 0.0::DOUBLE AS l, 0.0::DOUBLE AS r, 0.0::DOUBLE AS level, -80.0::DOUBLE AS env, 0.0::DOUBLE AS gr FROM sp UNION ALL
SELECT track, i, l, r, level, env, goal + CASE WHEN goal > gr THEN {decay(0.01)} ELSE {decay(0.15)} END * (gr - goal) FROM (
  SELECT *, CASE WHEN env + 20.8 >= 4 THEN (env + 20.8) * (1 - 1 / 1.68::DOUBLE) WHEN env + 20.8 > -4 THEN (1 - 1 / 1.68::DOUBLE) * pow(env + 24.8, 2) / 16 ELSE 0 END AS goal FROM (
    SELECT track, i, l, r, level, gr, db + CASE WHEN db > env THEN {decay(0.03)} ELSE {decay(0.25)} END * (env - db) AS env FROM (
      SELECT *, 10 * log10(level + 1e-12) AS db FROM (
        SELECT s.track, s.i, s.l, s.r, g.env, g.gr, g.level + (1 - {decay(0.005)}) * ((s.l * s.l + s.r * s.r) / 2 - g.level) AS level FROM g JOIN sp s ON s.track = g.track AND s.i = g.i + 1)))))"""


@query(f"""WITH RECURSIVE {EV}, {_COMP}, y AS (SELECT track, pow(10, (-gr + 8.8 * (1 - 1 / 1.68::DOUBLE) * 0.7) / 20::DOUBLE) AS k, l, r FROM g WHERE i >= 0)
SELECT track, round(sum(k * k * l * l), 4) + 0.0 AS e_l, round(sum(k * k * r * r), 4) + 0.0 AS e_r FROM y GROUP BY 1""")
def compressed(spark, d):
    """Energies after the compressor at density 0.6, with its makeup."""
    return _shown(ch.followed(ev(spark, d), lambda: ch.Compressor(0.6, _LOW)))


_TRANS = f"""g AS (SELECT DISTINCT track, -1::BIGINT AS i, 0.0::DOUBLE AS l, 0.0::DOUBLE AS r, 0.0::DOUBLE AS fast, 0.0::DOUBLE AS slow, 0.0::DOUBLE AS gain FROM sp UNION ALL
SELECT track, i, l, r, fast, slow, gain + CASE WHEN abs(goal) > abs(gain) THEN 1 - {decay(0.0005)} ELSE 1 - {decay(0.03)} END * (goal - gain) FROM (
  SELECT *, -0.7::DOUBLE * 0.6::DOUBLE * least(10, greatest(0, 20 * log10((fast + 1e-9) / (slow + 1e-9)))) AS goal FROM (
    SELECT track, i, l, r, gain, {follow('fast', 'x', 0.0002, 0.03)} AS fast, {follow('slow', 'x', 0.015, 0.3)} AS slow
    FROM (SELECT s.track, s.i, s.l, s.r, g.fast, g.slow, g.gain, greatest(abs(s.l), abs(s.r)) AS x FROM g JOIN sp s ON s.track = g.track AND s.i = g.i + 1))))"""


@query(f"WITH RECURSIVE {EV}, {_TRANS} SELECT track, round(sum(pow(10, gain / 10) * l * l), 4) + 0.0 AS e_l, round(sum(pow(10, gain / 10) * r * r), 4) + 0.0 AS e_r FROM g WHERE i >= 0 GROUP BY 1")
def transients_shaped(spark, d):
    """Energies after softening attacks by 0.7."""
    return _shown(ch.followed(ev(spark, d), lambda: ch.Transients(-0.7, _LOW)))


_CEIL = "pow(10::DOUBLE, -12 / 20::DOUBLE)"
_LIM = f"""tp AS MATERIALIZED (SELECT track, i, l, r, greatest(abs(l), abs(r), {', '.join(between(c, q) for c in 'lr' for q in (0.25, 0.5, 0.75))}) AS peak FROM sp WINDOW w AS (PARTITION BY track ORDER BY i)),
req AS MATERIALIZED (SELECT track, i, min(CASE WHEN peak > {_CEIL} THEN {_CEIL} / peak ELSE 1 END) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS low,
  lag(l, 16, 0.0::DOUBLE) OVER o AS l, lag(r, 16, 0.0::DOUBLE) OVER o AS r FROM tp WINDOW o AS (PARTITION BY track ORDER BY i)),
g AS (SELECT DISTINCT track, -1::BIGINT AS i, 1.0::DOUBLE AS gain, 0.0::DOUBLE AS l, 0.0::DOUBLE AS r FROM req UNION ALL
SELECT q.track, q.i, q.low + CASE WHEN q.low < g.gain THEN {decay(0.0025 / 4)} ELSE {decay(0.09)} END * (g.gain - q.low), q.l, q.r FROM g JOIN req q ON q.track = g.track AND q.i = g.i + 1),
y AS (SELECT track, i, l, r, greatest(-{_CEIL}, least({_CEIL}, l * gain)) AS yl, greatest(-{_CEIL}, least({_CEIL}, r * gain)) AS yr FROM g WHERE i >= 0)"""


@query(f"WITH RECURSIVE {EV}, {_LIM} SELECT track, round(sum(yl * yl), 4) + 0.0 AS e_l, round(sum(yr * yr), 4) + 0.0 AS e_r FROM y GROUP BY 1")
def limiter_output(spark, d):
    return _shown(ch.limited(ev(spark, d), -12.0, _LOW))


@query(f"WITH RECURSIVE {EV}, {_LIM} SELECT track, round(sum(pow(yl - l, 2)), 4) + 0.0 AS e_l, round(sum(pow(yr - r, 2)), 4) + 0.0 AS e_r FROM y GROUP BY 1")
def limiter_delta(spark, d):
    """What the limiter takes away."""
    return _shown(ch.limited(ev(spark, d), -12.0, _LOW, delta=True))


_PH = "(-0.5 * cos(2 * pi() * n / 30) + 0.42 + 0.08 * cos(4 * pi() * n / 30)) * sin(0.5 * pi() * (n - 15)) / (pi() * (n - 15))"
_OS = f"""h AS MATERIALIZED (SELECT n // 2 AS k, h * 0.5 / sum(h) OVER () AS h FROM (SELECT n, {_PH} AS h FROM (SELECT unnest(range(0, 31, 2)) AS n))),
x0 AS MATERIALIZED (SELECT track || '/' || ch AS track, i, CASE ch WHEN 'l' THEN l ELSE r END AS x, max(i) OVER (PARTITION BY track) AS last FROM sp, (SELECT unnest(['l', 'r']) AS ch)),
x1 AS MATERIALIZED (SELECT track, 2 * a.i AS i, 2 * sum(h * coalesce(b.x, 0)) AS x FROM x0 a CROSS JOIN h LEFT JOIN x0 b USING (track) WHERE b.i = a.i - k GROUP BY 1, 2 UNION ALL SELECT track, 2 * (i + 7) + 1, x FROM x0 WHERE i + 7 <= last),
x1z AS MATERIALIZED (SELECT track, i, x FROM x1 UNION ALL SELECT track, 2 * i + 1, 0 FROM x0 WHERE i < 7),
x2 AS MATERIALIZED (SELECT track, 2 * a.i AS i, 2 * sum(h * b.x) AS x FROM x1z a CROSS JOIN h JOIN x1z b USING (track) WHERE b.i = a.i - k GROUP BY 1, 2 UNION ALL SELECT a.track, 2 * (a.i + 7) + 1, a.x FROM x1z a JOIN (SELECT track, max(i) AS top FROM x1z GROUP BY 1) t USING (track) WHERE a.i + 7 <= top UNION ALL SELECT track, 2 * i + 1, 0 FROM x1z WHERE i < 7),
y2 AS MATERIALIZED (SELECT track, i, (tanh(pow(10::DOUBLE, 0.2) * (x + 0.048)) - tanh(pow(10::DOUBLE, 0.2) * 0.048)) / pow(10::DOUBLE, 0.2) AS y FROM x2),
y1 AS MATERIALIZED (SELECT track, i, sum(y) AS y FROM (SELECT a.track, a.i // 2 + k AS i, h * a.y AS y FROM y2 a CROSS JOIN h WHERE a.i % 2 = 0 UNION ALL SELECT track, i // 2 + 7, 0.5 * y FROM y2 WHERE i % 2 = 1) GROUP BY 1, 2),
y0 AS MATERIALIZED (SELECT track, i, sum(y) AS y FROM (SELECT a.track, a.i // 2 + k AS i, h * a.y AS y FROM y1 a CROSS JOIN h WHERE a.i % 2 = 0 UNION ALL SELECT track, i // 2 + 7, 0.5 * y FROM y1 WHERE i % 2 = 1) GROUP BY 1, 2),
dc AS (SELECT track, -1::BIGINT AS i, 0.0::DOUBLE AS d, 0.0::DOUBLE AS z FROM (SELECT DISTINCT track FROM x0) UNION ALL
  SELECT y0.track, y0.i, dc.d + (1 - exp(-2 * pi() * 5 / 48000)) * (y0.y - dc.d), y0.y - (dc.d + (1 - exp(-2 * pi() * 5 / 48000)) * (y0.y - dc.d)) FROM dc JOIN y0 ON y0.track = dc.track AND y0.i = dc.i + 1 JOIN x0 ON x0.track = y0.track AND x0.i = y0.i)"""


@query(f"WITH RECURSIVE {EV}, {_OS} SELECT left(track, -2) AS track, round(sum(z * z) FILTER (right(track, 1) = 'l'), 4) + 0.0 AS e_l, round(sum(z * z) FILTER (right(track, 1) = 'r'), 4) + 0.0 AS e_r FROM dc WHERE i >= 0 GROUP BY 1")
def saturated_oversampled(spark, d):
    """Energy after the saturator at four times the rate and the blocker of direct current."""
    return _shown(ch.followed(ev(spark, d), lambda: ch.Saturator(0.4, FS)))


_LANES = f"""{EV}, b AS MATERIALIZED (SELECT * FROM (WITH RECURSIVE {recursion([coefficients('low', 120.0, q=0.54), coefficients('low', 120.0, q=1.31)], "lr", EV)} SELECT track, i, sp.l + (pow(10::DOUBLE, 2 / 20::DOUBLE) - 1) * fl AS l, sp.r + (pow(10::DOUBLE, 2 / 20::DOUBLE) - 1) * fr AS r FROM fs JOIN sp USING (track, i))),
v AS MATERIALIZED (SELECT * FROM (WITH RECURSIVE {recursion([coefficients('high', 250.0, q=0.54), coefficients('high', 250.0, q=1.31), coefficients('low', 3500.0, q=0.54), coefficients('low', 3500.0, q=1.31)], 'm', 'sp AS MATERIALIZED (SELECT track, i, l, r, (l + r) / 2 AS m FROM b)')}
  SELECT track, i, sp.l + (pow(10::DOUBLE, -1.5 / 20::DOUBLE) - 1) * fm AS l, sp.r + (pow(10::DOUBLE, -1.5 / 20::DOUBLE) - 1) * fm AS r FROM fs JOIN sp USING (track, i))),
a AS MATERIALIZED (SELECT * FROM (WITH RECURSIVE {recursion([coefficients('low', 8000.0, q=0.54), coefficients('low', 8000.0, q=1.31)], 'lr', 'sp AS MATERIALIZED (SELECT track, i, l, r FROM v)')}
  SELECT track, i, sp.l + (pow(10::DOUBLE, 3 / 20::DOUBLE) - 1) * (sp.l - fl) AS l, sp.r + (pow(10::DOUBLE, 3 / 20::DOUBLE) - 1) * (sp.r - fr) AS r FROM fs JOIN sp USING (track, i))),
w AS (SELECT DISTINCT track, -1::BIGINT AS i, 0.0::DOUBLE AS l, 0.0::DOUBLE AS r, 0.0::DOUBLE AS fast, 0.0::DOUBLE AS slow FROM a UNION ALL
SELECT track, i, l, r, fast + CASE WHEN x > fast THEN 1 - {decay(0.0003, FS)} ELSE 1 - {decay(0.035, FS)} END * (x - fast), slow + CASE WHEN x > slow THEN 1 - {decay(0.02, FS)} ELSE 1 - {decay(0.3, FS)} END * (x - slow)
FROM (SELECT s.track, s.i, s.l, s.r, w.fast, w.slow, greatest(abs(s.l), abs(s.r)) AS x FROM w JOIN a s ON s.track = w.track AND s.i = w.i + 1)),
y AS (SELECT track, l, r, 1 + (pow(10::DOUBLE, -2 / 20::DOUBLE) - 1) * least(1, greatest(0, (CASE WHEN slow > 1e-6 THEN fast / slow ELSE 1 END - 1.1::DOUBLE) / 1.2::DOUBLE)) AS k FROM w WHERE i >= 0)"""


@query(f"WITH RECURSIVE {_LANES} SELECT track, round(sum(k * k * l * l), 4) + 0.0 AS e_l, round(sum(k * k * r * r), 4) + 0.0 AS e_r FROM y GROUP BY 1")
def lanes_in_order(spark, d):
    """All four stem lanes, each on what the one before has made."""
    return _shown(ch.followed(ev(spark, d), lambda: ch.StemLanes({"bass": 2.0, "vocal": -1.5, "air": 3.0, "drums": -2.0}, FS)))


@query(f"""WITH {EV}, b AS (SELECT track, CASE WHEN sum(l * l) > 0 AND sum(r * r) > 0 THEN 10 * log10(sum(r * r) / sum(l * l)) ELSE 0 END AS off FROM sp GROUP BY 1),
t AS (SELECT track, greatest(-3, least(3, -off)) AS b FROM b)
SELECT track, round(any_value(t.b), 4) + 0.0 AS trim_db, round(sum(pow(l * CASE WHEN abs(t.b) > 0.001 THEN pow(10, -t.b / 40) ELSE 1 END, 2)), 4) + 0.0 AS e_l, round(sum(pow(r * CASE WHEN abs(t.b) > 0.001 THEN pow(10, t.b / 40) ELSE 1 END, 2)), 4) + 0.0 AS e_r
FROM sp JOIN t USING (track) GROUP BY 1""")
def balance_corrected(spark, d):
    """Each track's measured offset trimmed away, within 3 dB."""
    s = ev(spark, d)
    trim = m.balance_offset(s).select("track", F.greatest(F.lit(-3.0), F.least(F.lit(3.0), -F.col("bal_db"))).alias("b"))
    by = lambda sign: F.when(F.abs("b") > 0.001, F.pow(F.lit(10.0), sign * F.col("b") / 40)).otherwise(1.0)
    j = s.join(trim, "track").select("track", "b", (F.col("l") * by(-1)).alias("l"), (F.col("r") * by(1)).alias("r"))
    return j.groupBy("track").agg(r4(F.first("b")).alias("trim_db"), r4(F.sum(F.col("l") * F.col("l"))).alias("e_l"), r4(F.sum(F.col("r") * F.col("r"))).alias("e_r"))


_CURVES = {"linear": "t", "scurve": "t * t * (3 - 2 * t)", "exp": "t * t * t", "power": "sqrt(t)"}


@query(f"""WITH {EV}, n AS (SELECT *, count(*) OVER (PARTITION BY track) - i AS rest FROM sp), f AS (SELECT track, greatest(0, least(1, i / 100::DOUBLE)) AS a, greatest(0, least(1, rest / 150::DOUBLE)) AS b, l FROM n)
{' UNION ALL '.join(f"SELECT track, '{k}' AS curve, round(sum(pow(l * ({e.replace('t', 'a') if k != 'power' else 'sqrt(a)'}) * ({e.replace('t', 'b') if k != 'power' else 'sqrt(b)'}), 2)), 4) + 0.0 AS e_l FROM f GROUP BY 1" for k, e in _CURVES.items())}""")
def fade_curves(spark, d):
    """Energy after fades of 100 samples in and 150 out, by each of the four curves."""
    parts = []
    for curve in _CURVES:
        s = ch.Settings(fade_in=100 / 1000, fade_out=150 / 1000, fade_in_curve=curve, fade_out_curve=curve)
        parts.append(_shown(ch.faded(ev(spark, d), s, 1000)).select("track", F.lit(curve).alias("curve"), "e_l"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH RECURSIVE {EV.replace('(value - 50) / 1024::DOUBLE AS l', '(value - 50) / 1024::DOUBLE * pow(10, 3 / 20::DOUBLE) AS l').replace('- 50) / 128::DOUBLE AS r', '- 50) / 128::DOUBLE * pow(10, 3 / 20::DOUBLE) AS r')}, {_LIM} SELECT track, round(sum(yl * yl), 4) + 0.0 AS e_l, round(sum(yr * yr), 4) + 0.0 AS e_r FROM y GROUP BY 1")
def bypassed(spark, d):
    """Bypass: gain and limiter alone, whatever the other settings are."""
    s = ch.Settings(bypass=True, tone=1.0, density=1.0, staging_db=5.0, reference_db=-2.0, output_db=9.0, ceiling_db=-12.0)
    return _shown(ch.master(ev(spark, d), s, _LOW).drop("gain"))


@query()  # each stage has its own oracle; tests put the whole chain against plain numpy
def chain_master(spark, d):
    s = ch.Settings(tone=0.3, shape=0.2, air=0.4, smooth=0.5, character=0.3, density=0.4, impact=0.3, width=1.2, balance_db=0.5, lanes_db={"bass": 1.0, "drums": 1.0}, output_db=3.0, ceiling_db=-6.0, fade_in=0.001)
    return _shown(ch.master(ev(spark, d), s, FS).drop("gain"))


@query()  # a fixed-point loop; tests measure what it returns
def render_master(spark, d):
    _, state = ch.render(ev(spark, d), ch.Settings(density=0.4, ceiling_db=-6.0), -14.0, FS, 10)
    return state.select("track", "passes", *[r4(F.col(c)).alias(c) for c in ("gain_db", "lufs", "err", "max_gr")])


@query()  # tests compare it with the chain's own loudness
def calibration(spark, d):
    return ch.calibrate(ev(spark, d), ch.Settings(tone=0.4, density=0.5), -20.0, FS, 10).select("track", r4(F.col("delta_db")).alias("delta_db"))


@query(f"""WITH RECURSIVE {EV}, t AS (SELECT track, i // 64 AS b, min(CASE WHEN l > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS x FROM sp WHERE i % 64 = 0 GROUP BY 1, 2),
v AS (SELECT track, b, x AS value FROM t WHERE b = 0 UNION ALL SELECT t.track, t.b, CASE WHEN abs(t.x - v.value) < 1e-5 THEN t.x ELSE v.value + (1 - exp(-128 / (48000 * 0.015::DOUBLE))) * (t.x - v.value) END FROM v JOIN t ON t.track = v.track AND t.b = v.b + 1)
SELECT track, CAST(b AS BIGINT) AS block, round(value, 4) + 0.0 AS value FROM v""")
def parameter_slew(spark, d):
    """A switch that each 64th sample sets, smoothed from block to block."""
    p = positions(ev(spark, d)).where("i % 64 = 0").select("track", F.floor(F.col("i") / 64).alias("idx"), F.when(F.col("l") > 0, 1.0).otherwise(0.0).alias("l"))
    return ch.slewed(p, FS).select("track", F.col("idx").alias("block"), r4(F.col("value")).alias("value"))


@query("""WITH c AS (SELECT c_custkey, c_acctbal / 1000000 AS v FROM customer)
SELECT c_custkey, abs(v) > 0.001 AS impact, v > 0.001 AS smooth, abs(1 + v / 5 - 1) > 0.001 OR c_custkey % 7 = 0 AS width, abs(v / 4) > 0.001 AS balance, abs(pow(10, v / 0.5 / 20) - 1) > 0.003 AS lanes FROM c""")
def stage_switches(spark, d):
    """Which stages of the chain the settings of each project turn on."""
    v = F.col("v")
    on = ch.switches(smooth=v, impact=v, width=1 + v / 5, bass_mono=F.col("c_custkey") % 7 == 0, balance_db=v / 4, lane_db=v / 0.5)
    return read(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1_000_000).alias("v")).select("c_custkey", *[c.alias(k) for k, c in on.items()])

"""Queries on projects, queues, albums, views and grids, and their DuckDB oracles; importing this registers them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.functions import half_up, r4
from quaver.operators import measure as m
from quaver.operators.views import store_pyramid, views
from quaver.plans import mastering  # noqa: F401  # registers queries that some of these build on
from quaver.plans.queries import EU, EV, ORACLES, QUERIES, _values, ev, query
from quaver.sources import event_signal, positions, read, shared_dir

#: Public loudness targets and ceilings of delivery platforms; the first four are those of the delivery table.
ALL_PLATFORMS = [
    ("spotify", -14.0, -1.0), ("apple", -16.0, -1.0), ("youtube", -14.0, -1.0), ("tidal", -14.0, -1.0), ("amazon", -14.0, -2.0), ("deezer", -15.0, -1.0), ("soundcloud", -14.0, -1.0), ("club", -9.0, -0.3), ("cd", -9.0, -0.3),
]


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.greatest(lit(low), F.least(lit(high), x))


def tenths(x: Column) -> Column:
    """One decimal, halves up."""
    return half_up(x * 10) / 10


@query("""WITH x AS (SELECT o_orderkey, o_totalprice / 10000 - 30 AS a, o_totalprice / 50000 - 5 AS b, 60 + o_orderkey % 300 AS dur, o_totalprice / 1000 AS sec FROM orders)
SELECT o_orderkey, greatest(-24, least(-6, floor(a * 10 + 0.5) / 10)) + 0.0 AS target, greatest(-3, least(-0.1::DOUBLE, floor(b * 10 + 0.5) / 10)) + 0.0 AS ceiling, greatest(-3, least(3, floor(b * 10 + 0.5) / 10)) + 0.0 AS balance,
round(greatest(0, least(dur / 2, sec)), 6) + 0.0 AS fade, greatest(-3, least(3, b)) + 0.0 AS stem, greatest(0, least(5, floor(b * 10 + 0.5) / 10)) + 0.0 AS gap FROM x""")
def inputs_clamped(spark, d):
    """What a user may set, within its limits and on its grid."""
    p = F.col("o_totalprice")
    a, b, dur = p / 10000 - 30, p / 50000 - 5, (60 + F.col("o_orderkey") % 300).cast("double")
    put = {"target": clamp(tenths(a), -24, -6), "ceiling": clamp(tenths(b), -3, -0.1), "balance": clamp(tenths(b), -3, 3), "fade": F.round(clamp(p / 1000, 0, dur / 2), 6), "stem": clamp(b, -3, 3), "gap": clamp(tenths(b), 0, 5)}
    return read(spark, d, "orders").select("o_orderkey", *[(c + F.lit(0.0)).alias(n) for n, c in put.items()])


@query(f"SELECT track, round(-18 - lufs, 4) + 0.0 AS staging_db, round(-14 + 18 - greatest(-8, least(8, (lufs + 20) / 2)), 4) + 0.0 AS output_db FROM ({ORACLES['integrated_loudness']})")
def gain_staging(spark, d):
    """Gain to the nominal level, and from there to the target less what the chain adds (here half the distance to -20, within 8 dB)."""
    delta = clamp((F.col("lufs") + 20) / 2, -8, 8)
    return QUERIES["integrated_loudness"](spark, d).select("track", (r4(-18 - F.col("lufs"))).alias("staging_db"), r4(F.lit(-14.0 + 18) - delta).alias("output_db"))


@query("""WITH q AS (SELECT o_orderkey, o_orderstatus = 'O' AS pending, o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' AS scanned FROM orders),
s AS (SELECT q.*, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber <= 3) AS source FROM q)
SELECT count(*) FILTER (WHERE pending AND NOT scanned AND source) AS to_scan, count(*) FILTER (WHERE (pending OR scanned) AND source) AS to_master, count(*) FILTER (WHERE NOT source) AS without_source FROM s""")
def queue_filters(spark, d):
    """Items to scan (pending and unscanned), items to master (not done), both with a source, and those without one."""
    q = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "O").alias("pending"), (F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2")).alias("scanned"))
    have = read(spark, d, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("source", F.lit(True))
    s = q.join(have, "o_orderkey", "left").withColumn("source", F.coalesce("source", F.lit(False)))
    count = lambda c, n: F.count_if(F.expr(c)).alias(n)
    return s.agg(count("pending AND NOT scanned AND source", "to_scan"), count("(pending OR scanned) AND source", "to_master"), count("NOT source", "without_source"))


@query("SELECT o_orderkey, id AS platform, target, ceiling FROM orders JOIN (VALUES ('spotify', -14.0::DOUBLE, -1.0::DOUBLE), ('apple', -16.0::DOUBLE, -1.0::DOUBLE), ('youtube', -14.0::DOUBLE, -1.0::DOUBLE), ('tidal', -14.0::DOUBLE, -1.0::DOUBLE)) p(id, target, ceiling) ON (o_custkey % 4 = 0 AND id IN ('spotify', 'apple')) OR (o_custkey % 4 = 1 AND id IN ('tidal', 'youtube', 'apple')) OR o_custkey % 4 = 2")
def platform_subset(spark, d):
    """The platforms that each order is delivered to: those of the table that its customer's list names, all four, or none."""
    names = ("spotify", "apple", "youtube", "tidal")
    lists = F.when(F.col("o_custkey") % 4 == 0, F.array(*map(F.lit, names[:2]))).when(F.col("o_custkey") % 4 == 1, F.array(*map(F.lit, names[1:]))).when(F.col("o_custkey") % 4 == 2, F.array(*map(F.lit, names)))
    table = spark.createDataFrame(ALL_PLATFORMS, "platform string, target double, ceiling double")  # a fixed dimension of a few rows
    wanted = read(spark, d, "orders").select("o_orderkey", F.explode(lists).alias("platform"))
    return wanted.join(F.broadcast(table), "platform").select("o_orderkey", "platform", "target", "ceiling")


@query("""SELECT p_partkey, array_to_string(list_transform(list_filter([{'k': 'TITLE', 'v': p_name}, {'k': 'GENRE', 'v': CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END}, {'k': 'ALBUM', 'v': CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END}],
lambda e: e.v IS NOT NULL AND len(e.v) > 0), lambda e: e.k || '=' || e.v), ' · ') AS tags FROM part""")
def tags_kept(spark, d):
    """Tags without the empty ones, as KEY=value."""
    p = read(spark, d, "part")
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    tags = F.array(entry("TITLE", F.col("p_name")), entry("GENRE", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type"))), entry("ALBUM", F.when(F.col("p_size") % 5 != 0, F.col("p_brand"))))
    return p.select("p_partkey", F.array_join(F.transform(F.filter(tags, lambda e: e["v"].isNotNull() & (F.length(e["v"]) > 0)), lambda e: F.concat(e["k"], F.lit("="), e["v"])), " · ").alias("tags"))


#: Console settings before fixes, made from a track's own name so that they differ.
_WIDTH, _SMOOTH = "0.8 + (len(track) % 4) * 0.1", "(len(track) % 3) * 0.2"
_ISSUES = f"i AS (SELECT track, max(CASE WHEN issue = 'bassmono' THEN 1 ELSE 0 END) AS mono, max(CASE WHEN issue = 'width' THEN value END) AS w, max(CASE WHEN issue = 'smooth' THEN value END) AS s, max(CASE WHEN issue = 'balance' THEN value END) AS b FROM ({ORACLES['diagnosis_issues']}) GROUP BY 1)"


def _issues(spark, d):
    pick = lambda k: F.max(F.when(F.col("issue") == k, F.col("value")))
    i = QUERIES["diagnosis_issues"](spark, d).groupBy("track").agg(F.max(F.when(F.col("issue") == "bassmono", 1).otherwise(0)).alias("mono"), pick("width").alias("w"), pick("smooth").alias("s"), pick("balance").alias("b"))
    n = F.length("track")
    return i.withColumns({"width": (0.8 + (n % 4) * 0.1).cast("double"), "was": ((n % 3) * 0.2).cast("double")})


@query(f"""WITH {_ISSUES}, c AS (SELECT *, CAST({_WIDTH} AS DOUBLE) AS width, CAST({_SMOOTH} AS DOUBLE) AS was FROM i)
SELECT track, mono = 1 AS bass_mono, round(coalesce(w, width), 4) AS width, round(greatest(was, coalesce(s, was)), 4) AS smooth, greatest(-3, least(3, floor(coalesce(b, 0) * 10 + 0.5) / 10)) + 0.0 AS balance FROM c""")
def fixes_on_console(spark, d):
    """Fixes on the console set the width, and raise smoothing."""
    i = _issues(spark, d)
    return i.select("track", (F.col("mono") == 1).alias("bass_mono"), F.round(F.coalesce("w", "width"), 4).alias("width"), F.round(F.greatest("was", F.coalesce("s", "was")), 4).alias("smooth"), (clamp(tenths(F.coalesce("b", F.lit(0.0))), -3, 3) + F.lit(0.0)).alias("balance"))


@query(f"""WITH {_ISSUES}, c AS (SELECT *, CAST({_WIDTH} AS DOUBLE) AS width, CAST({_SMOOTH} AS DOUBLE) AS was FROM i)
SELECT track, mono = 1 AS bass_mono, round(least(width, coalesce(w, width)), 4) AS width, round(greatest(was, coalesce(s, was)), 4) AS smooth, round(greatest(-3, least(3, coalesce(b, 0))), 4) + 0.0 AS balance FROM c""")
def fixes_in_batch(spark, d):
    """Fixes in a batch only narrow, and balance is not rounded."""
    i = _issues(spark, d)
    return i.select("track", (F.col("mono") == 1).alias("bass_mono"), F.round(F.least("width", F.coalesce("w", "width")), 4).alias("width"), F.round(F.greatest("was", F.coalesce("s", "was")), 4).alias("smooth"), r4(clamp(F.coalesce("b", F.lit(0.0)), -3, 3)).alias("balance"))


@query(f"""WITH f AS ({ORACLES['diagnosis_issues']}), c AS (SELECT *, CAST({_WIDTH} AS DOUBLE) AS width, CAST({_SMOOTH} AS DOUBLE) AS smooth, len(track) % 2 = 0 AS mono, 0.1::DOUBLE AS balance FROM f)
SELECT track, issue, CASE issue WHEN 'bassmono' THEN mono WHEN 'width' THEN width <= value + 0.005 WHEN 'smooth' THEN smooth >= value - 0.005 ELSE abs(balance - greatest(-3, least(3, floor(value * 10 + 0.5) / 10))) <= 0.05 END AS applied FROM c""")
def fixes_applied(spark, d):
    """Whether the console's state covers an issue already."""
    n = F.length("track")
    c = QUERIES["diagnosis_issues"](spark, d).withColumns({"width": (0.8 + (n % 4) * 0.1).cast("double"), "smooth": ((n % 3) * 0.2).cast("double")})
    kept = F.when(F.col("issue") == "bassmono", n % 2 == 0).when(F.col("issue") == "width", F.col("width") <= F.col("value") + 0.005).when(F.col("issue") == "smooth", F.col("smooth") >= F.col("value") - 0.005)
    return c.select("track", "issue", kept.otherwise(F.abs(0.1 - clamp(tenths(F.col("value")), -3, 3)) <= 0.05).alias("applied"))


@query(f"""WITH {EV}, s AS (SELECT track, round(10 * log10((sum((l-r)*(l-r)/4) + 1e-12) / (sum((l+r)*(l+r)/4) + 1e-12)), 4) + 0.0 AS ratio_db FROM ev GROUP BY 1), p AS (SELECT a.track AS src, b.track AS ref, a.ratio_db AS x, b.ratio_db AS y FROM s a JOIN s b ON a.track <> b.track)
SELECT src, ref, floor(greatest(0.7::DOUBLE, least(1.6::DOUBLE, pow(10, (y - x) / 40))) * 100 + 0.5) / 100 AS width, greatest(-24, least(-6, floor(lufs * 10 + 0.5) / 10)) + 0.0 AS target FROM p JOIN ({ORACLES['integrated_loudness']}) i ON i.track = ref""")
def reference_width(spark, d):
    """Width and target that bring one track to another's: side energy grows with the square of the width, the target is the other's loudness."""
    s = m.side_mid_ratio(ev(spark, d)).select("track", r4(F.col("ratio_db")).alias("ratio_db"))
    loud = QUERIES["integrated_loudness"](spark, d)
    a, b = s.select(F.col("track").alias("src"), F.col("ratio_db").alias("x")), s.join(loud, "track").select(F.col("track").alias("ref"), F.col("ratio_db").alias("y"), "lufs")
    p = a.join(b, F.col("src") != F.col("ref"))  # each track against each other is the result; Spark broadcasts a side only below its threshold
    width = half_up(clamp(F.pow(F.lit(10.0), (F.col("y") - F.col("x")) / 40), 0.7, 1.6) * 100) / 100
    return p.select("src", "ref", width.alias("width"), (clamp(tenths(F.col("lufs")), -24, -6) + F.lit(0.0)).alias("target"))


_OVER = [("preset0", 1.1, -14.0, -1.0), ("preset1", 1.3, -11.5, -1.0), ("preset2", 0.9, -9.0, -0.8)]


@query(f"""WITH {EU}, t AS (SELECT track, count(*) AS n, round(10 * log10(avg(l * l + r * r)), 4) AS level FROM sp GROUP BY 1)
SELECT track, CASE WHEN n < 10 THEN 'failed' ELSE 'done' END AS status, CASE WHEN n < 10 THEN 'too short' END AS error, coalesce(p.width, 1.0::DOUBLE) AS width, coalesce(p.target, -14.0::DOUBLE) AS target, CASE WHEN n >= 10 THEN round(coalesce(p.target, -14.0::DOUBLE) - level, 4) + 0.0 END AS gain_db
FROM t LEFT JOIN {_values(_OVER, 'p(id, width, target, ceiling)')} ON p.id = 'preset' || (track % 5)""")
def batch_master(spark, d):
    """A batch: each track's preset over the common settings, and its own outcome; a track that fails leaves the others alone."""
    t = event_signal(spark, d, "user_id").groupBy("track").agg(F.count(F.lit(1)).alias("n"), F.round(10 * F.log10(F.avg(F.col("l") * F.col("l") + F.col("r") * F.col("r"))), 4).alias("level"))
    p = spark.createDataFrame(_OVER, "id string, width double, target double, ceiling double")
    j = t.withColumn("id", F.concat(F.lit("preset"), (F.col("track") % 5).cast("string"))).join(F.broadcast(p), "id", "left")
    target, ok = F.coalesce("target", F.lit(-14.0)), F.col("n") >= 10
    return j.select("track", F.when(ok, "done").otherwise("failed").alias("status"), F.when(~ok, "too short").alias("error"), F.coalesce("width", F.lit(1.0)).alias("width"), target.alias("target"), F.when(ok, r4(target - F.col("level"))).alias("gain_db"))


@query("""WITH t AS (SELECT o_custkey AS album, o_orderkey, row_number() OVER w AS n, CAST(coalesce(sum(ceil(floor(o_totalprice) / 588) + 150) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS frame FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT album, 'TITLE "Album ' || album || '"' || chr(10) || string_agg('  TRACK ' || lpad(CAST(n AS VARCHAR), 2, '0') || ' AUDIO' || chr(10) || '    TITLE "Order ' || o_orderkey || '"' || chr(10) || '    INDEX 01 ' || lpad(CAST(frame // 4500 AS VARCHAR), 2, '0') || ':' || lpad(CAST(frame // 75 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(frame % 75 AS VARCHAR), 2, '0'), chr(10) ORDER BY n) AS cue FROM t GROUP BY 1""")
def cue_sheet(spark, d):
    """The text of a cue sheet for each album: tracks in order with their places on the disc."""
    o = W.partitionBy("o_custkey").orderBy("o_orderkey")
    frame = F.coalesce(F.sum(F.ceil(F.floor("o_totalprice") / 588) + 150).over(o.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    t = read(spark, d, "orders").select(F.col("o_custkey").alias("album"), "o_orderkey", F.row_number().over(o).alias("n"), frame.alias("frame"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    at = F.concat_ws(":", two(F.floor(F.col("frame") / 4500)), two(F.floor(F.col("frame") / 75) % 60), two(F.col("frame") % 75))
    line = F.concat(F.lit("  TRACK "), two(F.col("n")), F.lit(' AUDIO\n    TITLE "Order '), F.col("o_orderkey").cast("string"), F.lit('"\n    INDEX 01 '), at)
    lines = F.array_sort(F.collect_list(F.struct("n", line.alias("line"))))  # the tracks of one disc
    return t.groupBy("album").agg(lines.alias("s")).select("album", F.concat(F.lit('TITLE "Album '), F.col("album").cast("string"), F.lit('"\n'), F.array_join(F.col("s.line"), "\n")).alias("cue"))


@query(f"""WITH {EU}, p0 AS (SELECT track, i // 8 AS bucket, min((l + r) / 2) AS mn, max((l + r) / 2) AS mx, avg(pow((l + r) / 2, 2)) AS e FROM sp GROUP BY 1, 2), n AS (SELECT track, max(i) + 1 AS n FROM sp GROUP BY 1),
px AS (SELECT track, x, CAST(greatest(0, floor(x * (n / 10::DOUBLE) / 8)) AS BIGINT) AS b0, ceil((x + 1) * (n / 10::DOUBLE) / 8) AS b1 FROM n CROSS JOIN (SELECT unnest(range(10)) AS x))
SELECT px.track, x, round(least(1, min(least(mn, 0))), 4) + 0.0 AS mn, round(greatest(-1, max(greatest(mx, 0))), 4) + 0.0 AS mx, round(sqrt(avg(e)), 4) + 0.0 AS rms FROM px JOIN p0 ON p0.track = px.track AND bucket >= b0 AND bucket < greatest(b0 + 1, b1) GROUP BY 1, 2""")
def view_pixels(spark, d):
    """Ten pixels for each track from the pyramid level of eight samples: each bucket names the pixels that it lies in, so the range join is an explode."""
    p = positions(event_signal(spark, d, "user_id"))
    n = p.groupBy("track").agg((F.max("i") + 1).alias("n"))
    b = m.pyramid_base(event_signal(spark, d, "user_id")).join(n, "track").withColumn("per", F.col("n") / 10.0 / 8)
    first = F.greatest(F.lit(0), F.floor(F.col("bucket") / F.col("per")) - 1).cast("long")
    last = F.least(F.lit(9), F.floor((F.col("bucket") + 1) / F.col("per")) + 1).cast("long")
    x = F.col("x")
    b0 = F.floor(x * F.col("per"))
    inside = (F.col("bucket") >= b0) & (F.col("bucket") < F.greatest(b0 + 1, F.ceil((x + 1) * F.col("per"))))
    hit = b.withColumn("x", F.explode(F.sequence(first, last))).where(inside)
    return hit.groupBy("track", "x").agg(r4(F.least(F.lit(1.0), F.min("mn"))).alias("mn"), r4(F.greatest(F.lit(-1.0), F.max("mx"))).alias("mx"), r4(F.sqrt(F.avg(F.col("rms") * F.col("rms")))).alias("rms"))


@query("""WITH v AS (SELECT c_custkey, 60 + c_custkey % 90 AS bpm, (c_custkey % 7) / 10::DOUBLE AS anchor, (c_custkey % 11)::DOUBLE AS lo, (c_custkey % 11) + 20::DOUBLE AS hi FROM customer),
k AS (SELECT *, greatest(0, floor((lo - anchor) / (240 / bpm::DOUBLE))) AS k0 FROM v), b AS (SELECT *, k0 + j AS bar FROM k CROSS JOIN (SELECT unnest(range(60)) AS j))
SELECT c_custkey, CAST(bar AS BIGINT) + 1 AS bar, round(anchor + bar * (240 / bpm::DOUBLE), 4) AS sec FROM b WHERE anchor + bar * (240 / bpm::DOUBLE) <= hi""")
def grid_lines(spark, d):
    """Bar lines of a view from the first bar that can be seen."""
    k = F.col("c_custkey")
    v = read(spark, d, "customer").select("c_custkey", (240.0 / (60 + k % 90)).alias("bar_sec"), ((k % 7) / 10.0).alias("anchor"), (k % 11).cast("double").alias("lo")).withColumn("hi", F.col("lo") + 20)
    first = F.greatest(F.lit(0), F.floor((F.col("lo") - F.col("anchor")) / F.col("bar_sec")))
    last = F.floor((F.col("hi") - F.col("anchor")) / F.col("bar_sec"))
    return v.withColumn("bar", F.explode(F.sequence(first, last))).select("c_custkey", (F.col("bar") + 1).alias("bar"), F.round(F.col("anchor") + F.col("bar") * F.col("bar_sec"), 4).alias("sec"))


_STEPS = (0.5, 1, 2, 5, 10, 15, 30, 60, 120, 300)


@query("""WITH v AS (SELECT o_orderkey, (o_orderkey % 13)::DOUBLE AS lo, (o_orderkey % 13) + floor(o_totalprice) / 500 + 1 AS hi FROM orders),
s AS (SELECT *, coalesce(list_min(list_filter([0.5, 1, 2, 5, 10, 15, 30, 60, 120, 300]::DOUBLE[], lambda x: (hi - lo) / x <= 12)), 600) AS step FROM v)
SELECT o_orderkey, step, CAST(floor(hi / step) - ceil(lo / step) + 1 AS BIGINT) AS ticks, CAST(floor(ceil(lo / step) * step / 60) AS BIGINT) || ':' || lpad(CASE WHEN step < 1 THEN printf('%.1f', ceil(lo / step) * step % 60) ELSE printf('%.0f', ceil(lo / step) * step % 60) END, 2, '0') AS first FROM s""")
def ruler_ticks(spark, d):
    """The finest step that gives at most twelve ticks, their number, and the first one's name."""
    k = F.col("o_orderkey")
    v = read(spark, d, "orders").select("o_orderkey", (k % 13).cast("double").alias("lo"), ((k % 13) + F.floor("o_totalprice") / 500 + 1).alias("hi"))
    step = F.coalesce(*[F.when((F.col("hi") - F.col("lo")) / x <= 12, F.lit(float(x))) for x in _STEPS], F.lit(600.0))
    v = v.withColumn("step", step).withColumn("at", F.ceil(F.col("lo") / F.col("step")) * F.col("step"))
    name = F.concat(F.floor(F.col("at") / 60).cast("string"), F.lit(":"), F.lpad(F.when(F.col("step") < 1, F.format_string("%.1f", F.col("at") % 60)).otherwise(F.format_string("%.0f", F.col("at") % 60)), 2, "0"))
    return v.select("o_orderkey", "step", (F.floor(F.col("hi") / F.col("step")) - F.ceil(F.col("lo") / F.col("step")) + 1).alias("ticks"), name.alias("first"))


@query("SELECT user_id, rn, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY max(event_id) DESC) AS rn FROM events WHERE event_type <> (SELECT min(event_type) FROM events) GROUP BY 1, 2) t WHERE rn <= 6")
def recents_except(spark, d):
    """Recent kinds of each user without one kind."""
    e = read(spark, d, "events")
    this = e.agg(F.min("event_type").alias("event_type"))  # one row
    last = e.join(F.broadcast(this), "event_type", "left_anti").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"))
    return last.withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("last"))).cast("long")).where("rn <= 6").select("user_id", "rn", "event_type")


@query("""WITH q AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), m AS (SELECT *, o_custkey % 3 AS f, o_custkey % 3 + CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE -1 END AS t FROM q)
SELECT o_custkey, o_orderkey, CAST(CASE WHEN f >= n OR t < 0 OR t >= n THEN pos WHEN pos = f THEN t WHEN f < t AND pos > f AND pos <= t THEN pos - 1 WHEN t < f AND pos >= t AND pos < f THEN pos + 1 ELSE pos END AS BIGINT) AS pos FROM m""")
def queue_moved(spark, d):
    """Queues after one item was moved: those between its old and new place step aside; moves out of bounds do nothing."""
    o = W.partitionBy("o_custkey")
    q = read(spark, d, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(o.orderBy("o_orderkey")) - 1).cast("long").alias("pos"), F.count(F.lit(1)).over(o).alias("n"))
    k, pos, n = F.col("o_custkey"), F.col("pos"), F.col("n")
    f, t = k % 3, k % 3 + F.when(k % 2 == 0, 2).otherwise(-1)
    new = F.when((f >= n) | (t < 0) | (t >= n), pos).when(pos == f, t).when((f < t) & (pos > f) & (pos <= t), pos - 1).when((t < f) & (pos >= t) & (pos < f), pos + 1).otherwise(pos)
    return q.select("o_custkey", "o_orderkey", new.cast("long").alias("pos"))


@query("SELECT user_id, n, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) t WHERE n <= 20")
def history_newest(spark, d):
    """The newest twenty entries of each history."""
    return read(spark, d, "events").select("user_id", "event_id", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id"))).cast("long").alias("n")).where("n <= 20").select("user_id", "n", "event_id")


@query(r"""WITH p AS (SELECT p_partkey, 'C:\music/' || p_name || '.take.wav' AS path, p_type FROM part)
SELECT p_partkey, regexp_replace(regexp_extract(path, '[^\\/]*$'), '\.[^.]+$', '') AS base, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, left(regexp_replace(path || p_partkey || '12345678901234', '[^0-9]', '', 'g'), 13) AS upc FROM p""")
def names_cleaned(spark, d):
    """File names without folder and extension, titles with capitals after spaces and hyphens, and at most thirteen digits."""
    p = read(spark, d, "part").select("p_partkey", "p_type", F.concat(F.lit("C:\\music/"), F.col("p_name"), F.lit(".take.wav")).alias("path"))
    base = F.regexp_replace(F.regexp_extract("path", r"[^\\/]*$", 0), r"\.[^.]+$", "")
    title = F.array_join(F.transform(F.split(F.lower("p_type"), r"(?<=[\s-])"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), "")
    digits = F.substring(F.regexp_replace(F.concat("path", F.col("p_partkey").cast("string"), F.lit("12345678901234")), "[^0-9]", ""), 1, 13)
    return p.select("p_partkey", base.alias("base"), title.alias("title"), digits.alias("upc"))


@query("""SELECT event_id, CASE WHEN floor((value - 50) * 10 + 0.5) / 10 >= 0 THEN '+' ELSE '' END || printf('%.1f', floor((value - 50) * 10 + 0.5) / 10 + 0.0) AS db,
CAST(floor(event_id * 0.37 / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(event_id * 37 // 100) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(event_id * 37 % 100 * 10 AS VARCHAR), 3, '0') AS at FROM events""")
def numbers_shown(spark, d):
    """Signed decibels with one decimal, and times as minutes, seconds and milliseconds."""
    x, k = tenths(F.col("value") - 50) + F.lit(0.0), F.col("event_id") * 37
    sec = F.floor(k / 100)
    at = F.concat(F.floor(sec / 60).cast("string"), F.lit(":"), F.lpad((sec % 60).cast("string"), 2, "0"), F.lit("."), F.lpad((k % 100 * 10).cast("string"), 3, "0"))
    return read(spark, d, "events").select("event_id", F.concat(F.when(x >= 0, "+").otherwise(""), F.format_string("%.1f", x)).alias("db"), at.alias("at"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.format'), 'wav') AS format, coalesce(CAST(json_extract(props, '$.depth') AS BIGINT), 24) AS depth, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k FROM events")
def project_loaded(spark, d):
    """Settings of a saved project, with defaults for what it lacks; text that isn't JSON gives the defaults."""
    j = F.from_json("props", "format string, depth long, k long")
    return read(spark, d, "events").select("event_id", F.coalesce(j["format"], F.lit("wav")).alias("format"), F.coalesce(j["depth"], F.lit(24)).cast("long").alias("depth"), F.coalesce(j["k"], F.lit(0)).cast("long").alias("k"))


@query("""SELECT user_id, '{"version":1,"items":[' || string_agg('{"name":"' || event_type || '","id":' || event_id || '}', ',' ORDER BY event_id) || ']}' AS json FROM events GROUP BY 1""")
def project_saved(spark, d):
    """Each user's project as JSON, items in order."""
    items = F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("name"))))  # one project's items
    p = read(spark, d, "events").groupBy("user_id").agg(items.alias("s"))
    return p.select("user_id", F.to_json(F.struct(F.lit(1).alias("version"), F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["id"].alias("id"))).alias("items"))).alias("json"))


@query(f"""WITH {EV}, o AS (SELECT track, map_from_entries([('width', 1.0::DOUBLE), ('tone', 0.0::DOUBLE)]) AS base, count(*) AS n FROM ev GROUP BY 1)
SELECT track, CASE WHEN n % 2 = 0 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END AS width, 0.0::DOUBLE AS tone, CASE WHEN n % 2 = 0 THEN 0.5::DOUBLE ELSE -1.0::DOUBLE END AS air FROM o""")
def settings_merged(spark, d):
    """Settings of a preset over common ones: the right side wins; what neither has gets a default."""
    n = ev(spark, d).groupBy("track").agg(F.count(F.lit(1)).alias("n"))
    maps = lambda x: F.create_map(*[y for k, v in x.items() for y in (F.lit(k), F.lit(v))])
    right = F.when(F.col("n") % 2 == 0, maps({"width": 1.25, "air": 0.5})).otherwise(F.create_map().cast("map<string,double>"))
    common = maps({"width": 1.0, "tone": 0.0})
    both = F.map_concat(F.map_filter(common, lambda k, v: ~F.map_contains_key(right, k)), right)
    return n.withColumn("m", both).select("track", *[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(-1.0)).alias(k) for k in ("width", "tone", "air")])


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) AS items FROM orders")
def batch_counts(spark, d):
    """What a batch reports at its end."""
    return read(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "O").alias("pending"), F.count(F.lit(1)).alias("items"))


_UP = "SELECT track, {k} AS level, bucket // 8 AS bucket, min(mn) AS mn, max(mx) AS mx, sqrt(avg(rms * rms)) AS rms FROM {p} JOIN (SELECT track AS t FROM {p} GROUP BY 1 HAVING max(bucket) + 1 > 16) ON t = track GROUP BY 1, 2, 3"


@query(f"""WITH {EV}, p0 AS (SELECT track, 0 AS level, i // 4 AS bucket, least(0, min((l + r) / 2)) AS mn, greatest(0, max((l + r) / 2)) AS mx, sqrt(avg(pow((l + r) / 2, 2))) AS rms FROM sp GROUP BY 1, 2, 3),
p1 AS ({_UP.format(k=1, p='p0')}), p2 AS ({_UP.format(k=2, p='p1')}), p3 AS ({_UP.format(k=3, p='p2')}), p4 AS ({_UP.format(k=4, p='p3')}), p5 AS ({_UP.format(k=5, p='p4')}), p6 AS ({_UP.format(k=6, p='p5')}),
a AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4 UNION ALL SELECT * FROM p5 UNION ALL SELECT * FROM p6)
SELECT track, CAST(level AS BIGINT) AS level, count(*) AS buckets, round(min(mn), 4) + 0.0 AS mn, round(max(mx), 4) + 0.0 AS mx, round(sum(rms), 3) + 0.0 AS rms FROM a GROUP BY 1, 2""")
def pyramid_to_the_top(spark, d):
    """Levels of a pyramid, eight to one, until a track has at most sixteen buckets."""
    p = m.pyramid_until(ev(spark, d), 4, 8, 16)
    return p.groupBy("track", "level").agg(F.count(F.lit(1)).alias("buckets"), r4(F.min("mn")).alias("mn"), r4(F.max("mx")).alias("mx"), (F.round(F.sum("rms"), 3) + F.lit(0.0)).alias("rms")).select("track", F.col("level").cast("long").alias("level"), "buckets", "mn", "mx", "rms")


@query(f"WITH {EV} SELECT track, i // 512 AS bucket, round(least(0, min((l + r) / 2)), 4) + 0.0 AS mn, round(greatest(0, max((l + r) / 2)), 4) + 0.0 AS mx, round(sqrt(avg(pow((l + r) / 2, 2))), 4) + 0.0 AS rms FROM sp GROUP BY 1, 2")
def preview_pyramid(spark, d):
    """One level of 512 samples."""
    return m.pyramid_base(ev(spark, d), 512).select("track", "bucket", *[r4(F.col(c)).alias(c) for c in ("mn", "mx", "rms")])


@query(f"""WITH {EV}, b AS (SELECT *, CASE WHEN i >= 7 THEN CAST(floor((i - 7) / 25.5::DOUBLE) AS BIGINT) END AS k FROM sp), c AS (SELECT *, i - CAST(ceil(7 + k * 25.5::DOUBLE) AS BIGINT) AS j FROM b)
SELECT track, round(sum(pow(l + CASE WHEN j >= 0 AND j < 20 THEN sin(2 * pi() * CASE WHEN k % 4 = 0 THEN 156.8::DOUBLE ELSE 104.7::DOUBLE END * j / 1000) * exp(-j / (20 * 0.28::DOUBLE)) * 0.24 ELSE 0 END, 2)), 4) + 0.0 AS energy FROM c GROUP BY 1""")
def metronome_clicks(spark, d):
    """Energy of the left channel with a click mixed in on each beat of the grid, an accent on each fourth: a sample knows its beat from its own position."""
    p = positions(ev(spark, d)).withColumn("k", F.when(F.col("i") >= 7, F.floor((F.col("i") - 7) / 25.5))).withColumn("j", F.col("i") - F.ceil(7 + F.col("k") * 25.5))
    tone = F.sin(2 * 3.141592653589793 * F.when(F.col("k") % 4 == 0, 156.8).otherwise(104.7) * F.col("j") / 1000) * F.exp(-F.col("j") / (20 * 0.28)) * 0.24
    mixed = F.col("l") + F.when((F.col("j") >= 0) & (F.col("j") < 20), tone).otherwise(0.0)
    return p.groupBy("track").agg(r4(F.sum(mixed * mixed)).alias("energy"))


# --- what meters and controls do over time

_FRAMES = f"{EV}, fr AS (SELECT track, i // 64 AS frame, 20 * log10(greatest(max(greatest(abs(l), abs(r))), 1e-10)) AS db FROM sp GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE {_FRAMES}, h AS (SELECT DISTINCT track, -1::BIGINT AS frame, -70.0::DOUBLE AS hold FROM fr UNION ALL
SELECT f.track, f.frame, CASE WHEN f.db > h.hold THEN f.db WHEN f.frame % 3 <> 0 THEN greatest(-70, h.hold - 0.06) ELSE h.hold END FROM h JOIN fr f ON f.track = h.track AND f.frame = h.frame + 1)
SELECT track, frame, round(hold, 4) + 0.0 AS hold FROM h WHERE frame >= 0""")
def peak_hold(spark, d):
    """The held peak of each frame; it falls by 0.06 dB a frame while playing (here two frames of three)."""
    f = positions(ev(spark, d)).groupBy("track", F.floor(F.col("i") / 64).alias("idx")).agg((20 * F.log10(F.greatest(F.max(F.greatest(F.abs("l"), F.abs("r"))), F.lit(1e-10)))).alias("db"))
    return m.held_peaks(f.withColumn("playing", (F.col("idx") % 3 != 0).cast("double"))).select("track", F.col("idx").alias("frame"), r4(F.col("hold")).alias("hold"))


@query(f"""WITH RECURSIVE {EV}, b AS (SELECT track, i // 16 AS b, sum(l * r) AS lr, sum(l * l) AS ll, sum(r * r) AS rr FROM sp GROUP BY 1, 2),
c AS (SELECT DISTINCT track, -1::BIGINT AS b, 0.0::DOUBLE AS lr, 1e-12::DOUBLE AS ll, 1e-12::DOUBLE AS rr FROM b UNION ALL
SELECT x.track, x.b, c.lr + (1 - exp(-16 / (4800 * 0.3::DOUBLE))) * (x.lr - c.lr), c.ll + (1 - exp(-16 / (4800 * 0.3::DOUBLE))) * (x.ll - c.ll), c.rr + (1 - exp(-16 / (4800 * 0.3::DOUBLE))) * (x.rr - c.rr) FROM c JOIN b x ON x.track = c.track AND x.b = c.b + 1)
SELECT track, b AS block, round(CASE WHEN sqrt(ll * rr) > 1e-9 THEN lr / sqrt(ll * rr) ELSE 1 END, 4) + 0.0 AS corr FROM c WHERE b >= 0""")
def correlation_smoothed(spark, d):
    """Correlation whose three sums are smoothed over 300 ms, block by block."""
    return m.smoothed_correlation(ev(spark, d), 16, 4800).select("track", "block", r4(F.col("corr")).alias("corr"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, epoch_ms(ts) AS ms, lead(epoch_ms(ts)) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS later FROM events)
SELECT user_id, event_id, event_type FROM e WHERE later IS NULL OR later - ms >= 36000000""")
def debounced(spark, d):
    """Of changes to one field that follow each other closely only the last acts."""
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    after = F.lead("at").over(W.partitionBy("user_id", "event_type").orderBy("event_id"))
    return e.withColumn("next", after).where(F.col("next").isNull() | (F.col("next") - F.col("at") >= 36_000_000)).select("user_id", "event_id", "event_type")


@query("""WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) + CAST(floor(value * 864000) AS BIGINT) * 1000 AS done, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS newer FROM events)
SELECT user_id, event_id, value, newer IS NULL OR done < newer AS shown FROM e""")
def newest_results(spark, d):
    """Which results are shown: a request takes a time that grows with its value (up to a day), and what comes after its user's next request is stale."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    newer = F.lead(us).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    done = us + F.floor(F.col("value") * 864_000) * 1000
    return read(spark, d, "events").select("user_id", "event_id", "value", F.coalesce(done < newer, F.lit(True)).alias("shown"))


@query("""WITH RECURSIVE e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), c AS (SELECT *, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS col FROM e),
b AS (SELECT b, CAST(greatest(0, floor(20 * pow(1000::DOUBLE, b / 14) / 24000 * 64)) AS BIGINT) AS lo, ceil(20 * pow(1000::DOUBLE, (b + 1) / 14) / 24000 * 64) AS hi FROM (SELECT unnest(range(14))::DOUBLE AS b)),
p AS (SELECT label, col, b, greatest(0, max(x)) AS peak FROM c JOIN b ON i >= lo AND i < least(64, greatest(lo + 1, hi)) GROUP BY 1, 2, 3),
s AS (SELECT DISTINCT label, b, -1::BIGINT AS col, 0.0::DOUBLE AS v FROM p UNION ALL SELECT p.label, p.b, p.col, s.v + (p.peak - s.v) * CASE WHEN p.peak > s.v THEN 0.5::DOUBLE ELSE 0.12::DOUBLE END FROM s JOIN p ON p.label = s.label AND p.b = s.b AND p.col = s.col + 1)
SELECT label, CAST(b AS BIGINT) AS band, col, round(v, 4) + 0.0 AS v FROM s WHERE col >= 0""")
def display_bands(spark, d):
    """Peaks of 14 logarithmic bands of each vector as a spectrum, quick to rise and slow to fall from one to the next."""
    return m.display_bands(read(spark, d, "embeddings"), 14).select("label", "band", "col", r4(F.col("v")).alias("v"))


@query(f"""WITH {EV}, t AS (SELECT track, row_number() OVER (ORDER BY track) - 1 AS k, n FROM (SELECT track, count(*) AS n FROM sp GROUP BY 1)),
p0 AS (SELECT track, i // 4 AS bucket, least(0, min((l + r) / 2)) AS mn, greatest(0, max((l + r) / 2)) AS mx, sqrt(avg(pow((l + r) / 2, 2))) AS rms FROM sp GROUP BY 1, 2),
p1 AS (SELECT track, bucket // 8 AS bucket, min(mn) AS mn, max(mx) AS mx, sqrt(avg(rms * rms)) AS rms FROM p0 GROUP BY 1, 2), p2 AS (SELECT track, bucket // 8 AS bucket, min(mn) AS mn, max(mx) AS mx, sqrt(avg(rms * rms)) AS rms FROM p1 GROUP BY 1, 2),
p AS (SELECT 0 AS level, * FROM p0 UNION ALL SELECT 1, * FROM p1 WHERE track IN (SELECT track FROM p0 WHERE bucket >= 16) UNION ALL SELECT 2, * FROM p2 WHERE track IN (SELECT track FROM p1 WHERE bucket >= 16)),
tops AS (SELECT track, max(level) AS top FROM p GROUP BY 1),
q AS (SELECT c_custkey, track, c_custkey * 37 % n AS start, least(CASE WHEN 32 <= spp * 1.0001 THEN 1 ELSE 0 END + CASE WHEN 256 <= spp * 1.0001 THEN 1 ELSE 0 END, top) AS level, spp FROM (SELECT *, 0.5::DOUBLE + c_custkey % 300 AS spp FROM customer) c JOIN t ON k = c_custkey % (SELECT count(*) FROM t) JOIN tops USING (track)),
x AS (SELECT c_custkey, track, level, x, greatest(0, floor(start / (4 * pow(8::DOUBLE, level)) + x * (spp / (4 * pow(8::DOUBLE, level))))) AS b0, ceil(start / (4 * pow(8::DOUBLE, level)) + (x + 1) * (spp / (4 * pow(8::DOUBLE, level)))) AS b1 FROM q, (SELECT unnest(range(10)) AS x))
SELECT c_custkey, CAST(x AS BIGINT) AS x, CAST(x.level AS BIGINT) AS level, round(min(mn), 4) + 0.0 AS mn, round(max(mx), 4) + 0.0 AS mx, round(sqrt(avg(rms * rms)), 4) + 0.0 AS rms
FROM x JOIN p ON p.track = x.track AND p.level = x.level AND bucket >= b0 AND bucket < greatest(b0 + 1, b1) GROUP BY 1, 2, 3""")
def views_by_level(spark, d):
    """A view of ten pixels for each customer, from a half to three hundred samples a pixel, out of a stored pyramid."""
    s = positions(ev(spark, d))
    folder = f"{shared_dir(spark)}/quaver/{uuid.uuid4().hex}"
    store_pyramid(s, folder, 4, 8, 16)
    n = s.groupBy("track").agg(F.count(F.lit(1)).alias("n"))
    names = n.agg(F.array_sort(F.collect_list(F.struct("track", "n"))).alias("tracks"))  # one row: the kinds of events
    c = read(spark, d, "customer").join(F.broadcast(names)).withColumn("t", F.element_at("tracks", (F.col("c_custkey") % F.size("tracks") + 1).cast("int")))
    requests = c.select(F.col("c_custkey").alias("view"), "t.track", (F.col("c_custkey") * 37 % F.col("t.n")).alias("start"), ((0.5 + F.col("c_custkey") % 300) * 10).alias("length"))
    shown = views(spark, folder, requests, 10, 4, 8)
    return shown.select(F.col("view").alias("c_custkey"), F.col("x").cast("long").alias("x"), F.col("level").cast("long").alias("level"), *[r4(F.col(k)).alias(k) for k in ("mn", "mx", "rms")])

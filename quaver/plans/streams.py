"""Queries by event-time streams, and their DuckDB oracles; importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.functions import r4
from quaver.plans.queries import BLOCKS, EV, HOPS, LUFS, ST, query
from quaver.sources import event_signal, read
from quaver.streaming import live
from quaver.streaming.loudness import FRAME, PLAY

IDLE_MS = 7_200_000


def _samples(spark, d):
    s = event_signal(spark, d, more=[F.col("ts").cast("timestamp").alias("ts")])
    return s.select("track", "ts", F.col("idx").alias("seq"), F.lit(PLAY).alias("kind"), "l", "r")


def _arrivals(spark, d):
    """Samples in four batches of about a week, those of each in no order, some of them a batch later than their time; then the ends."""
    s = _samples(spark, d)
    first = s.agg(F.min("ts").alias("t0"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 4 + 1).alias("step"))
    quarter = F.floor((F.unix_micros("ts") - F.unix_micros("t0")) / F.col("step"))
    late = F.when(F.col("seq") % 97 == 0, 1).otherwise(0)  # within the delay
    s = s.join(F.broadcast(first)).withColumn("batch", F.least(F.lit(3), quarter + late)).drop("t0", "step")
    return [s.where(F.col("batch") == k).drop("batch") for k in range(4)] + [live.with_end(_samples(spark, d))]


@query(f"""WITH {EV}, g AS (SELECT track, i, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY track ORDER BY idx)) AS gap FROM sp JOIN (SELECT event_id AS idx, ts FROM events) USING (idx))
SELECT track, CAST(i AS BIGINT) AS playhead FROM g WHERE gap > {IDLE_MS}000 UNION ALL
SELECT event_type, count(*) FROM events GROUP BY 1 HAVING (SELECT epoch_us(max(ts)) FROM events) + 1000 - epoch_us(max(ts)) > {IDLE_MS}000""")
def idle_frames(spark, d):
    """Where each track had been silent for two hours, by timers of the stream; and the samples played until then."""
    frames = live.replayed(spark, _arrivals(spark, d), lambda s: live.live_frames(s, 48_000, 1 << 30, 10 / 48_000, "10 days", IDLE_MS), FRAME, 8)
    return frames.where("idle").select("track", "playhead")


@query(f"""{HOPS}, {BLOCKS}, {ST}, b AS MATERIALIZED (SELECT track, hop, m FROM blocks WHERE n = 4 AND {LUFS.format('m')} > -70),
pts AS (SELECT track, hop FROM hops WHERE (hop + 1) % 5 = 0), x AS (SELECT pts.track, pts.hop, avg(m) AS a FROM pts JOIN b ON b.track = pts.track AND b.hop <= pts.hop GROUP BY 1, 2),
y AS (SELECT x.track, x.hop, {LUFS.format('avg(m)')} AS lufs FROM x JOIN b ON b.track = x.track AND b.hop <= x.hop AND m > x.a / 10 GROUP BY 1, 2),
frame_ends AS (SELECT track, i // 128 AS frame, (i // 128 + 1) * 128 AS playhead FROM sp GROUP BY ALL HAVING count(*) = 128),
at_frames AS (SELECT *, playhead // 10 - 1 AS hop, playhead // 50 * 5 - 1 AS point FROM frame_ends)
SELECT at_frames.track, CAST(frame AS BIGINT) AS frame, CAST(playhead AS BIGINT) AS playhead, round({LUFS.format('blocks.m')}, 4) + 0.0 AS momentary, round({LUFS.format('st.m')}, 4) + 0.0 AS short_term, round(coalesce(y.lufs, -70.0::DOUBLE), 4) + 0.0 AS integrated
FROM at_frames JOIN blocks USING (track, hop) JOIN st USING (track, hop) LEFT JOIN y ON y.track = at_frames.track AND y.hop = at_frames.point""")
def meter_readings_streamed(spark, d):
    """Momentary, short-term and integrated loudness at each frame of 128 samples, from samples that come out of order."""
    frames = live.replayed(spark, _arrivals(spark, d), lambda s: live.live_frames(s, 48_000, 128, 10 / 48_000, "10 days"), FRAME, 8)
    return frames.where("NOT ended").select("track", "frame", "playhead", *[r4(F.col(c)).alias(c) for c in ("momentary", "short_term", "integrated")])


@query("""WITH q AS (SELECT *, least(3, floor((epoch_us(ts) - min(epoch_us(ts)) OVER ()) / ((max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER ()) / 4::DOUBLE + 1))) AS part FROM events),
e AS (SELECT user_id, event_type, event_id, ts FROM q WHERE NOT (event_id % 101 = 0 AND part < 2)),
g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER o) < 36000000000 THEN 0 ELSE 1 END AS new FROM e WINDOW o AS (PARTITION BY user_id, event_type ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS burst FROM g)
SELECT user_id, event_type, count(*) AS n, max_by(event_id, ts) AS last FROM s GROUP BY user_id, event_type, burst""")
def debounced_streamed(spark, d):
    """Bursts of changes of one kind by one user, settled after ten quiet hours, from a stream that ends and goes on after each quarter.

    Some changes come two quarters later than they should: they are dropped. Those of a quarter's last day come a quarter later, but within
    the delay of two days: they count.
    """
    e = read(spark, d, "events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    us = F.unix_micros("ts")
    span = e.agg(F.min(us).alias("t0"), ((F.max(us) - F.min(us)) / 4 + 1).alias("step"))  # one row
    e = e.join(F.broadcast(span)).withColumn("part", F.least(F.lit(3), F.floor((us - F.col("t0")) / F.col("step"))))
    near = us > F.col("t0") + (F.col("part") + 1) * F.col("step") - 86_400_000_000
    late = F.when((F.col("event_id") % 101 == 0) & (F.col("part") < 2), 2).when(near & (F.col("event_id") % 7 == 0), 1).otherwise(0)
    e = e.withColumn("batch", F.least(F.lit(3), F.col("part") + late))
    batches = [e.where(F.col("batch") == k).select("user_id", "event_type", "event_id", "ts") for k in range(4)]
    flush = e.agg((F.max("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts")).select(F.lit(None).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(-1).cast("long").alias("event_id"), "ts")
    kinds = "user_id long, event_type string, n long, last long"
    bursts = live.replayed(spark, [*batches, flush], lambda s: live.settled(s, ["user_id", "event_type"], "10 hours", "2 days"), kinds, restart=True)
    return bursts.where("last >= 0")

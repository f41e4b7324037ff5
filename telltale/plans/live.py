"""Streaming queries over the events table, equal to their batch twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from telltale.functions.quantiles import grouped_median
from telltale.operators import reference, status
from telltale.operators.clean import inject_offsets
from telltale.plans.fleet import FULL
from telltale.session import materialize
from telltale.sources import tables
from telltale.streaming import live

S = tables.SENSORS


def telemetry_stream(spark, sf_dir):
    e = live.read_events(spark, sf_dir)
    rows = e.select(
        F.col("event_id").alias("ord"), "ts", F.concat(F.lit("U"), (F.col("user_id") % 20).cast("string")).alias("train_id"),
        F.col("event_type").alias("component"), F.col("value").alias("s1"),
        F.get_json_object("props", "$.k").cast("double").alias("s2"))
    return inject_offsets(rows, "s1", tables.OFFSETS, tables.OFFSET_START)


def live_facts(spark, sf_dir):
    """Statistics are fitted once on the stored table, then the replayed stream is watched."""
    stored = tables.telemetry(spark, sf_dir)
    cut = materialize(reference.reference_cut(stored))
    stats = reference.reference_statistics(reference.with_reference(stored, cut), S)
    gaps = status.intervals(stored).where("dt is not null")
    every = materialize(grouped_median(gaps, status.GROUP, "dt", "m").select(
        *status.GROUP, F.when(F.col("n") >= 3, F.col("m").cast("long")).alias("every_us")))
    rows = reference.with_reference(telemetry_stream(spark, sf_dir), cut)
    scored = reference.score_robust(rows, stats, S).join(every, status.GROUP, "left")
    return live.latest_facts(live.run_available(live.live_component_facts(scored), "update"))


def live_component_status(spark, sf_dir):
    facts = live_facts(spark, sf_dir)
    name, risk = status.status_ladder(F.col("recent_valid"), F.col("persistence"), F.col("strength"))
    blind = (F.col("recent_valid") == 0) | (F.col("last_assessed") == 0)
    return facts.withColumn("status", F.when(blind, "unknown").otherwise(name)).withColumn(
        "risk", F.when(F.col("status") != "unknown", risk)).select("train_id", "component", "status", "risk")


def live_stale_components(spark, sf_dir):
    return live_facts(spark, sf_dir).where("stale = 1").select("train_id", "component")


def live_stream_segments(spark, sf_dir):
    e = live.read_events(spark, sf_dir).select(F.col("user_id").alias("stream_id"), "ts")
    out = live.run_available(live.live_segments(e, 21600))
    return out.select("stream_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n_rows")


QUERIES = {
    "live_stream_segments": (live_stream_segments, """
WITH d AS (SELECT user_id AS stream_id, ts, event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS dt FROM events),
s AS (SELECT *, sum(CASE WHEN dt > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM d)
SELECT stream_id, min(ts) AS start, max(ts) AS "end", count(*) AS n_rows FROM s GROUP BY stream_id, k
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""),
    "live_component_status": (live_component_status, f"""{FULL},
l AS (SELECT train_id, component, CASE WHEN coalesce(recent_valid, 0) < 4 OR NOT last_assessed THEN 'unknown' WHEN persistence >= 0.5 AND strength >= 6 THEN 'critical'
  WHEN (persistence >= 0.25 AND strength >= 2.5) OR persistence >= 0.65 THEN 'warning' ELSE 'healthy' END AS status,
  CAST(least(99, greatest(0, round_even(8 + 34 * persistence + 6 * greatest(0, strength - 1.5), 0))) AS INT) AS ind FROM rec)
SELECT train_id, component, status, CASE status WHEN 'critical' THEN greatest(75, ind) WHEN 'warning' THEN least(74, greatest(40, ind))
  WHEN 'healthy' THEN least(39, ind) END AS risk FROM l"""),
    "live_stale_components": (live_stale_components, f"""{FULL}
SELECT train_id, component FROM grp JOIN cad USING (train_id, component) WHERE gaps >= 3
  AND (epoch_us(last_seen) + 3 * CAST(cadence AS BIGINT)) // 1000 < (SELECT epoch_us(max(ts) - INTERVAL 10 MINUTE) FROM scored) // 1000"""),
}

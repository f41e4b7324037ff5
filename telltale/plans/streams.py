"""Action-stream, interval and trace queries with their SQL twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from telltale.functions.columns import micros, seconds_between
from telltale.functions.ordered import time_chunk
from telltale.operators import segments as seg
from telltale.operators import trace as tr
from telltale.session import materialize
from telltale.sources import tables

HOUR = 3600.0
CHANNELS = ["current", "voltage", "back_emf", "position"]
STATES = ["opening", "closing"]
LONG_CHUNK = 90 * 86_400
THRESHOLD = 55.0


def event_segments(spark, sf_dir, hours):
    return seg.segment_stream(tables.event_stream(spark, sf_dir), hours * HOUR)


def labelled(spark, sf_dir, hours):
    """Actions with a class by rule: a mean reading above the threshold is abnormal."""
    cut = event_segments(spark, sf_dir, hours)
    return cut.groupBy("stream_id", "segment").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n_rows"),
        F.max(F.abs("reading")).alias("peak"),
        F.when(F.avg("reading") > THRESHOLD, seg.ABNORMAL).otherwise(seg.NORMAL).alias("label"))


def stream_segments(spark, sf_dir):
    return seg.segment_bounds(event_segments(spark, sf_dir, 6))


def learned_segments(spark, sf_dir):
    stream = tables.event_stream(spark, sf_dir)
    gaps = seg.cadence(stream).select("stream_id", seg.segmentation_gap(F.col("median_dt")).alias("gap"))
    cut = seg.segment_stream(stream.join(materialize(gaps), "stream_id"), F.col("gap"))
    return seg.segment_bounds(cut)


def stream_cadence(spark, sf_dir):
    out = seg.cadence(tables.event_stream(spark, sf_dir))
    return out.select("stream_id", F.round("median_dt", 6).alias("median_dt"), F.round("modal_dt", 6).alias("modal_dt"),
                      "intervals", "gaps")


def shipment_segments(spark, sf_dir):
    return seg.segment_stream(tables.shipment_stream(spark, sf_dir), 4 * 24 * HOUR, chunk_seconds=LONG_CHUNK)


def action_statistics(spark, sf_dir):
    out = seg.action_features(shipment_segments(spark, sf_dir), CHANNELS, LONG_CHUNK)
    stats = ["mean", "std", "min", "max", "rms", "change", "variation", "q10", "q50", "q90"]
    return out.select("stream_id", "segment", "channel", *[F.round(c, 6).alias(c) for c in stats])


def action_states(spark, sf_dir):
    out = seg.state_fractions(shipment_segments(spark, sf_dir), STATES)
    return out.select("stream_id", "segment", "duration_seconds", *[F.round(f"{s}_fraction", 6).alias(f"{s}_fraction") for s in STATES])


def blocked_folds(spark, sf_dir):
    return seg.blocked_folds(stream_segments(spark, sf_dir)).select("stream_id", "segment", "fold")


def annotation_check(spark, sf_dir):
    labels = stream_segments(spark, sf_dir).withColumn(
        "n_rows", F.col("n_rows") + (F.col("segment") % 5 == 0).cast("long")).withColumn(
        "end", F.when(F.col("segment") % 7 == 1, F.col("end") + F.expr("interval 1 second")).otherwise(F.col("end")))
    out = seg.check_annotations(tables.event_stream(spark, sf_dir), labels)
    return out.select("stream_id", "start", "end", "n_rows", "found", F.col("bounds_match").cast("int").alias("bounds_match"),
                      F.col("rows_match").cast("int").alias("rows_match"))


def truth_and_found(spark, sf_dir):
    truth = labelled(spark, sf_dir, 12).withColumn("id", F.col("segment"))
    found = labelled(spark, sf_dir, 9).withColumn("id", F.col("segment"))
    return truth, found


def interval_overlaps(spark, sf_dir):
    out = seg.interval_overlaps(*truth_and_found(spark, sf_dir))
    return out.select("stream_id", "label", "t_id", "p_id", F.round("overlap", 6).alias("overlap"), F.round("iou", 6).alias("iou"))


def iou_weighted_f1(spark, sf_dir):
    out = seg.iou_weighted_f1(*truth_and_found(spark, sf_dir))
    return out.select("truth", "found", "matches", F.round("credit", 6).alias("credit"), F.round("f1", 6).alias("f1"))


def flagged_actions(spark, sf_dir):
    out = seg.flagged_action_evidence(labelled(spark, sf_dir, 6))
    return out.select("stream_id", "segment", F.round(seconds_between("start", "end"), 6).alias("duration"), "peak")


def trace_rows(spark, sf_dir):
    """Readings of a user over time; error events count as missing readings."""
    return tables.event_stream(spark, sf_dir).withColumn("y", F.when(F.col("event_type") != "error", F.col("reading")))


def trace_sample(spark, sf_dir):
    rows = seg.stream_intervals(trace_rows(spark, sf_dir))
    out = tr.sampled_points(rows, ["stream_id"], ["ts", "ord"], time_chunk("ts"), micros("ts") / 1e6, F.col("y"),
                            F.coalesce(F.col("dt") > 12 * HOUR, F.lit(False)), max_points=20)
    return out.select("stream_id", "i", "part", F.round("x", 3).alias("x"), "y")


def trace_envelope(spark, sf_dir):
    rows = tables.event_stream(spark, sf_dir)
    return tr.envelope(rows, ["stream_id"], ["ts", "ord"], time_chunk("ts"), "reading", 8)


def trace_buckets(spark, sf_dir):
    return tr.bucket_sample(trace_rows(spark, sf_dir), ["stream_id"], ["ts", "ord"], time_chunk("ts"), "y", 26).select(
        "stream_id", "i", "ord", "y")


def trace_runs(spark, sf_dir):
    out = tr.measured_runs(trace_rows(spark, sf_dir), ["stream_id"], ["ts", "ord"], time_chunk("ts"), "y")
    return out.select("stream_id", "run", "readings", "start", "end", "start_value", "end_value", "next_start", "next_value")


def trace_statistics(spark, sf_dir):
    out = tr.trace_statistics(trace_rows(spark, sf_dir), ["stream_id"], "y")
    return out.select("stream_id", "min", "max", F.round("mean", 6).alias("mean"), "readings", "missing")


def nearest_reading(spark, sf_dir):
    stream = tables.event_stream(spark, sf_dir)
    out = tr.nearest_reading(stream.where("event_type = 'error'"), stream.where("event_type = 'purchase'"), ["stream_id"])
    return out.select("stream_id", "ord", "nearest", F.round("distance", 6).alias("distance"))


SEG = """
ev AS (SELECT user_id AS stream_id, ts, event_id AS ord, value AS reading, event_type FROM events),
dts AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY stream_id ORDER BY ts, ord)) / CAST(1000000 AS DOUBLE) AS dt FROM ev)"""


def cut(name: str, gap: str, source: str = "dts") -> str:
    return f"""{name} AS (SELECT *, CAST(sum(CASE WHEN dt > {gap} THEN 1 ELSE 0 END)
  OVER (PARTITION BY stream_id ORDER BY ts, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM {source})"""


def bounds(name: str, source: str) -> str:
    return f"""{name} AS (SELECT stream_id, segment, min(ts) AS start, max(ts) AS "end", count(*) AS n_rows,
  max(abs(reading)) AS peak, CASE WHEN avg(reading) > 55 THEN 'Abnormal resistance' ELSE 'Normal' END AS label
  FROM {source} GROUP BY ALL)"""


SHIP = f"""
li AS (SELECT l_suppkey AS stream_id, l_shipdate AS ts, l_orderkey * 8 + l_linenumber AS ord, l_quantity AS current,
  l_extendedprice AS voltage, l_discount AS back_emf, l_tax AS position,
  CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS opening, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS closing
  FROM lineitem),
ldt AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY stream_id ORDER BY ts, ord)) / 1e6 AS dt FROM li),
{cut('lseg', '345600', 'ldt')}"""

CAD = """
cad AS (SELECT stream_id, median(dt) AS median_dt FROM dts WHERE dt > 0 GROUP BY 1),
modal AS (SELECT stream_id, dt AS modal_dt FROM (SELECT stream_id, dt, row_number() OVER (PARTITION BY stream_id ORDER BY count(*) DESC, dt) AS rn
  FROM dts WHERE dt > 0 GROUP BY stream_id, dt) WHERE rn = 1)"""

NUMBERED = """
tv AS (SELECT *, CASE WHEN event_type <> 'error' THEN reading END AS y FROM dts),
num AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY stream_id) AS n,
  sum(CASE WHEN y IS NULL THEN 1 ELSE 0 END) OVER w AS miss, sum(CASE WHEN dt > 43200 THEN 1 ELSE 0 END) OVER w AS gaps
  FROM tv WINDOW w AS (PARTITION BY stream_id ORDER BY ts, ord ROWS UNBOUNDED PRECEDING))"""

PAIRS = f"""WITH {SEG}, {cut('s12', '43200')}, {cut('s9', '32400')}, {bounds('truth', 's12')}, {bounds('found', 's9')},
pairs AS (SELECT t.stream_id, t.label, t.segment AS t_id, p.segment AS p_id,
  least(epoch_us(t."end"), epoch_us(p."end")) - greatest(epoch_us(t.start), epoch_us(p.start)) AS ov,
  epoch_us(t."end") - epoch_us(t.start) + epoch_us(p."end") - epoch_us(p.start) - ov AS un
  FROM truth t JOIN found p ON t.stream_id = p.stream_id AND t.label = p.label)"""

QUERIES = {
    "stream_segments": (stream_segments, f"""WITH {SEG}, {cut('s', '21600')}
SELECT stream_id, segment, min(ts) AS start, max(ts) AS "end", count(*) AS n_rows FROM s GROUP BY ALL"""),
    "learned_segments": (learned_segments, f"""WITH {SEG}, {CAD},
g AS (SELECT dts.*, greatest(0.2, 8 * median_dt) AS gap FROM dts JOIN cad USING (stream_id)), {cut('s', 'gap', 'g')}
SELECT stream_id, segment, min(ts) AS start, max(ts) AS "end", count(*) AS n_rows FROM s GROUP BY ALL"""),
    "stream_cadence": (stream_cadence, f"""WITH {SEG}, {CAD}
SELECT stream_id, round(median_dt, 6) AS median_dt, round(modal_dt, 6) AS modal_dt, count(dt) AS intervals,
  count(*) FILTER (dt > 3 * median_dt) AS gaps
FROM dts JOIN cad USING (stream_id) JOIN modal USING (stream_id) GROUP BY stream_id, cad.median_dt, modal.modal_dt"""),
    "action_statistics": (action_statistics, f"""WITH {SHIP},
cells AS (UNPIVOT (SELECT stream_id, segment, ts, ord, current, voltage, back_emf, position FROM lseg)
  ON current, voltage, back_emf, position INTO NAME channel VALUE v),
steps AS (SELECT *, v - lag(v) OVER (PARTITION BY stream_id, segment, channel ORDER BY ts, ord) AS d FROM cells)
SELECT stream_id, segment, channel, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max,
  round(sqrt(avg(v * v)), 6) AS rms, round(arg_max(v, (ts, ord)) - arg_min(v, (ts, ord)), 6) AS change,
  round(coalesce(avg(abs(d)), 0), 6) AS variation, round(quantile_cont(v, 0.1), 6) AS q10,
  round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.9), 6) AS q90
FROM steps GROUP BY stream_id, segment, channel"""),
    "action_states": (action_states, f"""WITH {SHIP}
SELECT stream_id, segment, (epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(1000000 AS DOUBLE) AS duration_seconds,
  round(avg(opening), 6) AS opening_fraction, round(avg(closing), 6) AS closing_fraction FROM lseg GROUP BY stream_id, segment"""),
    "blocked_folds": (blocked_folds, f"""WITH {SEG}, {cut('s', '21600')}, {bounds('b', 's')}
SELECT stream_id, segment, ntile(5) OVER (PARTITION BY stream_id ORDER BY start) - 1 AS fold FROM b"""),
    "annotation_check": (annotation_check, f"""WITH {SEG}, {cut('s', '21600')}, {bounds('b', 's')},
lab AS (SELECT stream_id, start, CASE WHEN segment % 7 = 1 THEN "end" + INTERVAL 1 SECOND ELSE "end" END AS fin,
  n_rows + CASE WHEN segment % 5 = 0 THEN 1 ELSE 0 END AS n_rows FROM b)
SELECT lab.stream_id, lab.start, lab.fin AS "end", lab.n_rows, count(ev.ts) AS found,
  CAST(coalesce(min(ev.ts) = lab.start AND max(ev.ts) = lab.fin, false) AS INT) AS bounds_match,
  CAST(count(ev.ts) = lab.n_rows AS INT) AS rows_match
FROM lab LEFT JOIN ev ON ev.stream_id = lab.stream_id AND ev.ts BETWEEN lab.start AND lab.fin
GROUP BY lab.stream_id, lab.start, lab.fin, lab.n_rows"""),
    "interval_overlaps": (interval_overlaps, f"""{PAIRS}
SELECT stream_id, label, t_id, p_id, round(ov / CAST(1000000 AS DOUBLE), 6) AS overlap, round(ov / CAST(un AS DOUBLE), 6) AS iou
FROM pairs WHERE ov > 0"""),
    "iou_weighted_f1": (iou_weighted_f1, None),
    "flagged_actions": (flagged_actions, f"""WITH {SEG}, {cut('s', '21600')}, {bounds('b', 's')}
SELECT stream_id, segment, round((epoch_us("end") - epoch_us(start)) / CAST(1000000 AS DOUBLE), 6) AS duration, peak
FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY segment) AS rn FROM b WHERE label = 'Abnormal resistance') WHERE rn <= 5"""),
    "trace_sample": (trace_sample, f"""WITH {SEG}, {NUMBERED},
kept AS (SELECT DISTINCT num.* FROM num, range(20) AS r(j)
  WHERE j < least(20, n) AND i = CASE WHEN j = least(20, n) - 1 AND least(20, n) > 1 THEN n - 1
    ELSE CAST(floor(j * (CAST(n - 1 AS DOUBLE) / greatest(least(20, n) - 1, 1))) AS BIGINT) END),
lagged AS (SELECT *, lag(y) OVER w AS py, lag(miss) OVER w AS pm, lag(gaps) OVER w AS pg FROM kept WINDOW w AS (PARTITION BY stream_id ORDER BY i))
SELECT stream_id, i, 1 AS part, round(epoch_us(ts) / CAST(1000000 AS DOUBLE), 3) AS x, y FROM kept
UNION ALL
SELECT stream_id, i, 0 AS part, round(epoch_us(ts) / CAST(1000000 AS DOUBLE), 3) AS x, NULL AS y FROM lagged
WHERE py IS NOT NULL AND y IS NOT NULL AND (miss > pm OR gaps > pg)"""),
    "trace_envelope": (trace_envelope, f"""WITH {SEG}, {NUMBERED},
b AS (SELECT *, ntile(8) OVER (PARTITION BY stream_id ORDER BY i) - 1 AS block FROM num),
e AS (SELECT stream_id, block, arg_min(i, (reading, i)) AS lo, arg_max(i, (reading, -i)) AS hi FROM b GROUP BY ALL)
SELECT DISTINCT b.stream_id, b.block, b.i, b.reading AS y FROM b JOIN e ON b.stream_id = e.stream_id AND b.block = e.block AND b.i IN (e.lo, e.hi)"""),
    "trace_buckets": (trace_buckets, f"""WITH {SEG}, {NUMBERED},
v AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY i) - 1 AS vp, count(*) OVER (PARTITION BY stream_id) AS nv FROM num WHERE y IS NOT NULL),
b AS (SELECT v.*, j FROM v, range(6) AS r(j) WHERE nv > 26 AND vp >= j * nv // 6 AND vp < (j + 1) * nv // 6),
k AS (SELECT stream_id, min(i) AS a, max(i) AS z, arg_min(i, (y, i)) AS lo, arg_max(i, (y, -i)) AS hi FROM b GROUP BY stream_id, j)
SELECT stream_id, i, ord, y FROM v WHERE nv <= 26
UNION
SELECT v.stream_id, v.i, v.ord, v.y FROM v JOIN k ON v.stream_id = k.stream_id AND v.i IN (k.a, k.z, k.lo, k.hi)"""),
    "trace_runs": (trace_runs, f"""WITH {SEG}, {NUMBERED},
r AS (SELECT stream_id, miss, count(*) AS readings, min(ts) AS start, max(ts) AS "end", arg_min(y, (ts, ord)) AS start_value,
  arg_max(y, (ts, ord)) AS end_value FROM num WHERE y IS NOT NULL GROUP BY stream_id, miss)
SELECT stream_id, row_number() OVER w AS run, readings, start, "end", start_value, end_value, lead(start) OVER w AS next_start,
  lead(start_value) OVER w AS next_value FROM r WINDOW w AS (PARTITION BY stream_id ORDER BY miss)"""),
    "trace_statistics": (trace_statistics, f"""WITH {SEG}, {NUMBERED}
SELECT stream_id, min(y) AS min, max(y) AS max, round(avg(y), 6) AS mean, count(y) AS readings, count(*) - count(y) AS missing
FROM num GROUP BY stream_id"""),
    "nearest_reading": (nearest_reading, f"""WITH {SEG},
l AS (SELECT * FROM ev WHERE event_type = 'error'), r AS (SELECT * FROM ev WHERE event_type = 'purchase'),
c AS (SELECT l.stream_id, l.ord, r.ord AS nearest, abs(epoch_us(l.ts) - epoch_us(r.ts)) AS d,
  row_number() OVER (PARTITION BY l.stream_id, l.ord ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts, r.ord DESC) AS rn
  FROM l JOIN r USING (stream_id))
SELECT l.stream_id, l.ord, c.nearest, round(c.d / CAST(1000000 AS DOUBLE), 6) AS distance
FROM l LEFT JOIN c ON c.stream_id = l.stream_id AND c.ord = l.ord AND c.rn = 1"""),
}

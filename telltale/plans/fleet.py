"""Fleet telemetry queries and their SQL twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from telltale.operators import clean, fleet, reference, status
from telltale.sources import tables

S = tables.SENSORS


def scored_telemetry(spark, sf_dir):
    rows, stats = reference.fit_robust(tables.telemetry(spark, sf_dir), S)
    return reference.score_robust(rows, stats, S)


def reference_cut(spark, sf_dir):
    cut = reference.reference_cut(tables.telemetry(spark, sf_dir))
    return cut.select("component", F.timestamp_micros("cutoff_us").cast("timestamp_ntz").alias("cutoff"))


def reference_statistics(spark, sf_dir):
    _, stats = reference.fit_robust(tables.telemetry(spark, sf_dir), S)
    return stats.select(
        "component", "sensor", "n", *[F.round(c, 6).alias(c) for c in ("median", "mad", "std", "scale")], "fit_rows")


def robust_scores(spark, sf_dir):
    return scored_telemetry(spark, sf_dir).select(
        "ord", "train_id", "component", F.col("is_ref").cast("int").alias("is_ref"),
        F.round("max_z", 6).alias("max_z"), F.round("risk", 6).alias("risk"))


def component_status(spark, sf_dir):
    out = status.component_status(scored_telemetry(spark, sf_dir))
    return out.select(
        "train_id", "component", "status", "risk", "health", "anomaly_count", "observations", "onset",
        "latest_anomaly", "last_seen", "recent_valid", "recent_flags", F.round("strength", 6).alias("strength"),
        "evidence_ts", "evidence_ord", F.round("evidence_z", 6).alias("evidence_z"))


def attention_queue(spark, sf_dir):
    queue = fleet.attention_queue(status.component_status(scored_telemetry(spark, sf_dir)))
    return queue.select(
        "train_id", "component", "status", "risk", "anomaly_count", "onset", "last_seen", "evidence_ts",
        F.round("evidence_z", 6).alias("evidence_z"))


def fleet_status(spark, sf_dir):
    return fleet.fleet_status(status.component_status(scored_telemetry(spark, sf_dir)))


def fleet_totals(spark, sf_dir):
    scored = scored_telemetry(spark, sf_dir)
    return fleet.fleet_totals(fleet.fleet_status(status.component_status(scored)), scored)


def stale_components(spark, sf_dir):
    return status.stale_groups(tables.telemetry(spark, sf_dir)).where("stale").select(
        "train_id", "component", F.timestamp_micros("last_us").cast("timestamp_ntz").alias("last_seen"))


def status_trend(spark, sf_dir):
    trend = status.status_trend(scored_telemetry(spark, sf_dir))
    return trend.select(
        F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), *status.STATUS_RANK)


def risk_sparkline(spark, sf_dir):
    return status.sparkline(scored_telemetry(spark, sf_dir))


def masked_gaps(spark, sf_dir):
    masked = clean.mask_gaps(tables.telemetry(spark, sf_dir), S)
    return masked.select("ord", "train_id", "component", F.round("s1", 6).alias("s1"), "s2")


def data_quality(spark, sf_dir):
    masked = clean.mask_gaps(tables.telemetry(spark, sf_dir), S)
    rows, stats = reference.fit_robust(masked, S)
    return fleet.data_quality(reference.score_robust(rows, stats, S), S)


def injected_rows(spark, sf_dir):
    return tables.telemetry(spark, sf_dir).groupBy("train_id", "component").agg(
        F.sum("injected").cast("bigint").alias("injected"), F.round(F.sum("s1"), 4).alias("sum_s1"))


TELEMETRY = """
tel AS (
  SELECT event_id AS ord, ts, 'U' || (user_id % 20) AS train_id, event_type AS component,
    CASE WHEN ts < TIMESTAMP '2024-01-19' THEN 0.0
         WHEN user_id % 20 = 3 AND event_type = 'error' THEN 400.0
         WHEN user_id % 20 = 7 AND event_type = 'purchase' THEN 400.0
         WHEN user_id % 20 = 11 AND event_type = 'view' THEN 130.0 ELSE 0.0 END::DOUBLE AS shift,
    value + shift AS s1, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS s2
  FROM events)"""


def scored_sql(source: str = "tel") -> str:
    return f"""
times AS (SELECT component, ts, row_number() OVER (PARTITION BY component ORDER BY ts) AS rn,
            count(*) OVER (PARTITION BY component) AS n
          FROM (SELECT DISTINCT component, ts FROM {source})),
cut AS (SELECT component, ts AS cutoff FROM times
        WHERE rn = greatest(1, CAST(floor(n * CAST(0.4 AS DOUBLE)) AS BIGINT))),
base AS (SELECT t.*, t.ts <= c.cutoff AS is_ref FROM {source} t JOIN cut c USING (component)),
fit AS (SELECT component, count(*) AS fit_rows FROM base
        WHERE is_ref AND (s1 IS NOT NULL OR s2 IS NOT NULL) GROUP BY component),
cells AS (SELECT component, 's1' AS sensor, s1 AS v FROM base WHERE is_ref AND s1 IS NOT NULL
          UNION ALL SELECT component, 's2', s2 FROM base WHERE is_ref AND s2 IS NOT NULL),
mid AS (SELECT component, sensor, count(*) AS n, median(v) AS median, stddev_pop(v) AS std
        FROM cells GROUP BY ALL),
dev AS (SELECT component, sensor, median(abs(v - median)) * CAST(1.4826 AS DOUBLE) AS mad
        FROM cells JOIN mid USING (component, sensor) GROUP BY ALL),
stats AS (SELECT component, sensor, n, median, mad, std,
            CASE WHEN mad > 1e-10 THEN mad WHEN std > 1e-10 THEN std
                 ELSE greatest(abs(median) * 0.01, 0.001) END AS scale, fit_rows
          FROM mid JOIN dev USING (component, sensor) JOIN fit USING (component)),
wide AS (SELECT component, max(median) FILTER (sensor = 's1') AS m1, max(scale) FILTER (sensor = 's1') AS c1,
           max(median) FILTER (sensor = 's2') AS m2, max(scale) FILTER (sensor = 's2') AS c2
         FROM stats WHERE fit_rows >= 12 GROUP BY component),
scored AS (SELECT b.*, greatest(abs(s1 - m1) / c1, abs(s2 - m2) / c2) AS max_z, max_z - 3 AS score,
             CASE WHEN max_z IS NOT NULL THEN least(99.0, greatest(0.0, 5 + max_z * 8)) END AS risk
           FROM base b LEFT JOIN wide USING (component))"""


LADDER = """
  CASE WHEN coalesce({valid}, 0) < 4 THEN 'unknown'
       WHEN persistence >= 0.5 AND strength >= 6 THEN 'critical'
       WHEN (persistence >= 0.25 AND strength >= 2.5) OR persistence >= 0.65 THEN 'warning'
       ELSE 'healthy' END"""

STATUS = """
win AS (SELECT *, row_number() OVER (PARTITION BY train_id, component ORDER BY ts DESC, ord DESC) AS rn
        FROM scored WHERE NOT is_ref),
rec AS (SELECT train_id, component, count(score) AS recent_valid, count(*) FILTER (score > 0) AS recent_flags,
          avg(CASE WHEN score IS NULL THEN NULL WHEN score > 0 THEN 1.0 ELSE 0.0 END) AS persistence,
          median(CASE WHEN score IS NOT NULL THEN max_z END) AS strength,
          bool_or(rn = 1 AND score IS NOT NULL) AS last_assessed
        FROM win WHERE rn <= 24 GROUP BY ALL),
peak AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY train_id, component ORDER BY score DESC, ts, ord) AS pk
           FROM win WHERE rn <= 24 AND score > 0) WHERE pk = 1),
lastv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY train_id, component ORDER BY ts DESC, ord DESC) AS lv
            FROM scored WHERE score IS NOT NULL) WHERE lv = 1),
gaps AS (SELECT train_id, component, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY train_id, component ORDER BY ts) AS dt
         FROM (SELECT DISTINCT train_id, component, ts FROM scored)),
cad AS (SELECT train_id, component, count(dt) AS gaps, median(dt) AS cadence FROM gaps GROUP BY ALL),
grp AS (SELECT train_id, component, count(*) AS observations,
          count(*) FILTER (NOT is_ref AND score > 0) AS anomaly_count,
          min(ts) FILTER (NOT is_ref AND score > 0) AS onset, max(ts) FILTER (NOT is_ref AND score > 0) AS latest_anomaly,
          max(ts) AS last_seen FROM scored GROUP BY ALL),
fresh AS (SELECT train_id, component, gaps >= 3 AND
            ((SELECT max(epoch_us(ts)) FROM scored) - epoch_us(last_seen)) > 3 * cadence AS stale
          FROM grp JOIN cad USING (train_id, component)),
st0 AS (SELECT g.*, r.recent_valid, r.recent_flags, r.persistence, r.strength, f.stale,
          CASE WHEN coalesce(r.recent_valid, 0) = 0 OR NOT coalesce(r.last_assessed, false) OR coalesce(f.stale, false)
               THEN 'unknown' ELSE """ + LADDER.format(valid="recent_valid") + """ END AS status,
          CAST(least(99, greatest(0, round_even(8 + 34 * persistence + 6 * greatest(0, strength - 1.5), 0))) AS INT) AS ind
        FROM grp g LEFT JOIN rec r USING (train_id, component) LEFT JOIN fresh f USING (train_id, component)),
st AS (SELECT *, CASE status WHEN 'critical' THEN greatest(75, ind) WHEN 'warning' THEN least(74, greatest(40, ind))
                 WHEN 'healthy' THEN least(39, ind) END AS risk FROM st0),
comp AS (SELECT s.train_id, s.component, s.status, s.risk, 100 - s.risk AS health, s.anomaly_count, s.observations, s.onset,
           s.latest_anomaly, s.last_seen, coalesce(s.recent_valid, 0) AS recent_valid, coalesce(s.recent_flags, 0) AS recent_flags,
           s.strength, s.persistence,
           CASE WHEN s.status IN ('warning', 'critical') AND p.ord IS NOT NULL THEN p.ts ELSE l.ts END AS evidence_ts,
           CASE WHEN s.status IN ('warning', 'critical') AND p.ord IS NOT NULL THEN p.ord ELSE l.ord END AS evidence_ord,
           CASE WHEN s.status IN ('warning', 'critical') AND p.ord IS NOT NULL THEN p.max_z ELSE l.max_z END AS evidence_z
         FROM st s LEFT JOIN peak p USING (train_id, component) LEFT JOIN lastv l USING (train_id, component)),
fleet AS (SELECT train_id, max(CASE status WHEN 'healthy' THEN 0 WHEN 'unknown' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END) AS rk,
            max(risk) AS mr, count(*) AS component_count, CAST(sum(anomaly_count) AS BIGINT) AS anomaly_count,
            max(last_seen) AS last_seen
          FROM comp GROUP BY train_id),
train AS (SELECT train_id, CASE rk WHEN 0 THEN 'healthy' WHEN 1 THEN 'unknown' WHEN 2 THEN 'warning' ELSE 'critical' END AS status,
            CASE WHEN rk <> 1 THEN mr END AS risk, CASE WHEN rk <> 1 THEN 100 - mr END AS health,
            component_count, anomaly_count, last_seen FROM fleet)"""

MASKED = """
draws AS (SELECT *, CAST('0x' || substr(md5(ord || ':s1:42'), 1, 13) AS BIGINT) AS d1,
                    CAST('0x' || substr(md5(ord || ':s2:42'), 1, 13) AS BIGINT) AS d2 FROM tel),
ranks AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY d1) AS r1,
            row_number() OVER (PARTITION BY component ORDER BY d2) AS r2,
            greatest(1, count(*) OVER (PARTITION BY component) // 30) AS cut FROM draws),
masked AS (SELECT ord, ts, train_id, component, CASE WHEN r1 > cut THEN s1 END AS s1,
             CASE WHEN r2 > cut THEN s2 END AS s2 FROM ranks)"""

SCORED = f"WITH {TELEMETRY}, {scored_sql()}"
FULL = f"{SCORED}, {STATUS}"

TREND = f"""{SCORED},
ut AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM scored)),
pick AS (SELECT DISTINCT CASE WHEN j = k - 1 AND k > 1 THEN n - 1
           ELSE CAST(floor(j * (CAST(n - 1 AS DOUBLE) / greatest(k - 1, 1))) AS BIGINT) END AS i
         FROM (SELECT max(n) AS n, least(24, max(n)) AS k FROM ut), range(24) AS r(j) WHERE j < k),
moments AS (SELECT ut.ts AS t FROM ut JOIN pick USING (i)),
grps AS (SELECT DISTINCT train_id, component FROM scored),
win AS (SELECT t, s.*, row_number() OVER (PARTITION BY t, train_id, component ORDER BY s.ts DESC, s.ord DESC) AS rn
        FROM moments JOIN scored s ON s.ts <= t AND NOT s.is_ref),
rec AS (SELECT t, train_id, component, count(score) AS valid,
          avg(CASE WHEN score IS NULL THEN NULL WHEN score > 0 THEN 1.0 ELSE 0.0 END) AS persistence,
          median(CASE WHEN score IS NOT NULL THEN max_z END) AS strength,
          bool_or(rn = 1 AND score IS NOT NULL) AS last_assessed FROM win WHERE rn <= 24 GROUP BY ALL),
gaps AS (SELECT train_id, component, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY train_id, component ORDER BY ts) AS dt
         FROM (SELECT DISTINCT train_id, component, ts FROM scored)),
cad AS (SELECT t, train_id, component, count(dt) >= 3 AND epoch_us(t) - max(epoch_us(ts)) > 3 * median(dt) AS stale
        FROM moments JOIN gaps ON gaps.ts <= t GROUP BY t, train_id, component),
each AS (SELECT a.t, g.train_id, CASE WHEN NOT coalesce(last_assessed, false) OR coalesce(stale, false) THEN 1
           WHEN coalesce(valid, 0) < 4 THEN 1 WHEN persistence >= 0.5 AND strength >= 6 THEN 3
           WHEN (persistence >= 0.25 AND strength >= 2.5) OR persistence >= 0.65 THEN 2 ELSE 0 END AS rk
         FROM moments a CROSS JOIN grps g LEFT JOIN rec r ON r.t = a.t AND r.train_id = g.train_id AND r.component = g.component
         LEFT JOIN cad c ON c.t = a.t AND c.train_id = g.train_id AND c.component = g.component),
trains AS (SELECT t, train_id, max(rk) AS rk FROM each GROUP BY ALL)
SELECT t AS ts, count(*) FILTER (rk = 0) AS healthy, count(*) FILTER (rk = 1) AS unknown,
  count(*) FILTER (rk = 2) AS warning, count(*) FILTER (rk = 3) AS critical FROM trains GROUP BY t"""

QUERIES = {
    "attention_queue": (attention_queue, f"""{FULL}
SELECT train_id, component, status, risk, anomaly_count, onset, last_seen, evidence_ts, round(evidence_z, 6) AS evidence_z
FROM comp WHERE status IN ('warning', 'critical')"""),
    "reference_cut": (reference_cut, f"{SCORED} SELECT component, cutoff FROM cut"),
    "reference_statistics": (reference_statistics, f"""{SCORED}
SELECT component, sensor, n, round(median, 6) AS median, round(mad, 6) AS mad, round(std, 6) AS std,
  round(scale, 6) AS scale, fit_rows FROM stats"""),
    "robust_scores": (robust_scores, f"""{SCORED}
SELECT ord, train_id, component, CAST(is_ref AS INT) AS is_ref, round(max_z, 6) AS max_z, round(risk, 6) AS risk FROM scored"""),
    "component_status": (component_status, f"""{FULL}
SELECT train_id, component, status, risk, health, anomaly_count, observations, onset, latest_anomaly, last_seen,
  recent_valid, recent_flags, round(strength, 6) AS strength, evidence_ts, evidence_ord, round(evidence_z, 6) AS evidence_z
FROM comp"""),
    "fleet_status": (fleet_status, f"{FULL} SELECT train_id, status, risk, health, component_count, anomaly_count, last_seen FROM train"),
    "fleet_totals": (fleet_totals, f"""{FULL}
SELECT count(*) FILTER (status = 'healthy') AS healthy, count(*) FILTER (status = 'unknown') AS unknown,
  count(*) FILTER (status = 'warning') AS warning, count(*) FILTER (status = 'critical') AS critical,
  (SELECT count(*) FROM scored) AS observations, (SELECT count(*) FROM scored WHERE NOT is_ref AND score > 0) AS anomalies,
  (SELECT round(100.0 * count(score) / count(*), 2) FROM scored) AS coverage FROM train"""),
    "stale_components": (stale_components, f"""{FULL}
SELECT train_id, component, last_seen FROM grp JOIN fresh USING (train_id, component) WHERE stale"""),
    "status_trend": (status_trend, TREND),
    "risk_sparkline": (risk_sparkline, f"""{SCORED}
SELECT train_id, component, ts, ord, round(risk, 2) AS risk FROM (SELECT *,
  row_number() OVER (PARTITION BY train_id, component ORDER BY ts DESC, ord DESC) AS rn FROM scored)
WHERE rn <= 48 AND risk IS NOT NULL"""),
    "masked_gaps": (masked_gaps, f"WITH {TELEMETRY}, {MASKED} SELECT ord, train_id, component, round(s1, 6) AS s1, s2 FROM masked"),
    "data_quality": (data_quality, f"""WITH {TELEMETRY}, {MASKED}, {scored_sql('masked')}
SELECT count(*) AS rows, 2 * count(*) AS applicable, 2 * count(*) - count(s1) - count(s2) AS missing,
  round(100.0 * (2 * count(*) - count(s1) - count(s2)) / (2 * count(*)), 2) AS missing_pct,
  count(*) FILTER (score IS NULL) AS unscored_rows,
  (SELECT count(*) FROM (SELECT 1 FROM scored GROUP BY train_id, component, ts HAVING count(*) > 1)) AS duplicate_keys
FROM scored"""),
    "injected_rows": (injected_rows, f"""WITH {TELEMETRY}
SELECT train_id, component, count(*) FILTER (shift <> 0) AS injected, round(sum(s1), 4) AS sum_s1 FROM tel GROUP BY ALL"""),
}

"""Eight-car case queries with their SQL twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from telltale.operators import metrics, peers
from telltale.sources import tables

MODES = ("A", "N")
CARS = [f"{i:02d}" for i in range(1, 9)]


def case_grid(spark, sf_dir):
    return peers.cooling_mask(peers.full_grid(tables.case_readings(spark, sf_dir), CARS), MODES)


def cooling_readings(spark, sf_dir):
    return case_grid(spark, sf_dir).select(
        "file_id", "ts", "car", F.col("mask").cast("int").alias("mask"), F.round("residual", 6).alias("residual"))


def case_clock(spark, sf_dir):
    return peers.case_clock(tables.case_readings(spark, sf_dir)).select("file_id", "ts", "dt", "weight", "cadence")


def peer_gap(spark, sf_dir):
    out = peers.peer_gap(case_grid(spark, sf_dir))
    return out.select("file_id", "ts", "car", F.col("same_mode").cast("int").alias("same_mode"), F.round("gap", 6).alias("gap"))


def features(spark, sf_dir):
    return peers.car_features(tables.case_readings(spark, sf_dir), CARS, MODES)


def car_features(spark, sf_dir):
    return features(spark, sf_dir).select(
        "file_id", "car", "usable_rows", "peer_rows", "same_mode_rows", F.col("available").cast("int").alias("available"),
        *[F.round(c, 6).alias(c) for c in (*peers.RANKED, *peers.FRACTIONS)])


def car_ranks(spark, sf_dir):
    out = peers.ranked_features(features(spark, sf_dir))
    return out.select("file_id", "car", *[F.round(f"{c}_rank", 6).alias(f"{c}_rank") for c in peers.RANKED])


def ranking(spark, sf_dir):
    scored = peers.baseline_score(peers.ranked_features(features(spark, sf_dir)))
    return peers.ranked_cars(scored.withColumn("score", F.round("score", 9)))


def faulty_cars(spark, sf_dir):
    """The labelled car of a case: the one with the largest mean cabin reading."""
    mean = tables.case_readings(spark, sf_dir).groupBy("file_id", "car").agg(F.round(F.avg("cabin"), 9).alias("m"))
    return mean.groupBy("file_id").agg(F.max_by("car", F.struct("m", "car")).alias("faulty_car"))


def ranking_metrics(spark, sf_dir):
    out = metrics.ranking_metrics(metrics.rank_decay(ranking(spark, sf_dir).join(faulty_cars(spark, sf_dir), "file_id")))
    return out.select("cases", "top1", "top2", F.round("mean_rank", 6).alias("mean_rank"), F.round("score", 6).alias("score"))


def mode_inventory(spark, sf_dir):
    return peers.mode_inventory(tables.case_readings(spark, sf_dir))


BASE = """
rd AS (SELECT CAST(n_regionkey AS BIGINT) AS file_id, l_shipdate AS ts, format('{:02d}', s_suppkey % 8 + 1) AS car,
  avg(l_quantity) AS cabin, max(l_returnflag) AS mode, 25.0::DOUBLE AS target
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3),
clk AS (SELECT DISTINCT file_id, ts FROM rd),
cars AS (SELECT format('{:02d}', i) AS car FROM range(1, 9) AS r(i)),
gr AS (SELECT c.file_id, c.ts, k.car, r.cabin, r.mode, r.target FROM clk c CROSS JOIN cars k LEFT JOIN rd r
  ON r.file_id = c.file_id AND r.ts = c.ts AND r.car = k.car),
mk AS (SELECT *, coalesce(mode IN ('A', 'N') AND cabin IS NOT NULL AND target IS NOT NULL, false) AS mask,
  CASE WHEN mask THEN cabin - target END AS residual FROM gr),
st AS (SELECT file_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / CAST(1000000 AS DOUBLE) AS dt,
  (lead(epoch_us(ts)) OVER w - epoch_us(ts)) / CAST(1000000 AS DOUBLE) AS nx FROM clk WINDOW w AS (PARTITION BY file_id ORDER BY ts)),
md AS (SELECT file_id, dt AS cadence FROM (SELECT file_id, dt, row_number() OVER (PARTITION BY file_id ORDER BY count(*) DESC, dt) AS rn
  FROM st WHERE dt IS NOT NULL GROUP BY file_id, dt) WHERE rn = 1),
ck AS (SELECT file_id, ts, dt, cadence, CASE WHEN nx > 0 AND nx <= 3 * cadence THEN nx ELSE cadence END AS weight FROM st JOIN md USING (file_id)),
us AS (SELECT * FROM mk WHERE mask),
sm AS (SELECT a.file_id, a.ts, a.car, CASE WHEN count(*) >= 2 THEN median(b.residual) END AS m FROM us a JOIN us b
  ON a.file_id = b.file_id AND a.ts = b.ts AND a.car <> b.car AND a.mode = b.mode GROUP BY ALL),
al AS (SELECT a.file_id, a.ts, a.car, CASE WHEN count(*) >= 2 THEN median(b.residual) END AS m FROM us a JOIN us b
  ON a.file_id = b.file_id AND a.ts = b.ts AND a.car <> b.car GROUP BY ALL),
gp AS (SELECT u.file_id, u.ts, u.car, sm.m IS NOT NULL AS same_mode, u.residual - coalesce(sm.m, al.m) AS gap
  FROM us u LEFT JOIN sm USING (file_id, ts, car) LEFT JOIN al USING (file_id, ts, car))"""

FEATURES = BASE + """,
lg AS (SELECT mk.*, ck.dt, ck.cadence, ck.weight, lag(cabin) OVER w AS pc, lag(mask) OVER w AS pm, lag(mode) OVER w AS pmode,
  lag(target) OVER w AS pt FROM mk JOIN ck USING (file_id, ts) WINDOW w AS (PARTITION BY file_id, car ORDER BY mk.ts)),
ms AS (SELECT file_id, car, 'own' AS measure, residual AS v, weight FROM us JOIN ck USING (file_id, ts)
  UNION ALL SELECT file_id, car, 'gap', gap, weight FROM gp JOIN ck USING (file_id, ts) WHERE gap IS NOT NULL
  UNION ALL SELECT file_id, car, 'rate', (cabin - pc) / (dt / 60), weight FROM lg
    WHERE mask AND pm AND mode = pmode AND target = pt AND dt <= 3 * cadence AND cabin - pc IS NOT NULL),
cw AS (SELECT *, sum(weight) OVER (PARTITION BY file_id, car, measure ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum,
  sum(weight) OVER (PARTITION BY file_id, car, measure) AS total FROM ms),
qs AS (SELECT file_id, car, measure, min(v) FILTER (cum >= 0.1::DOUBLE * total) AS q10, min(v) FILTER (cum >= 0.5::DOUBLE * total) AS q50,
  min(v) FILTER (cum >= 0.9::DOUBLE * total) AS q90, sum(CASE WHEN v > 0 THEN weight ELSE 0 END) / sum(weight) AS above FROM cw GROUP BY ALL),
ft AS (SELECT d.file_id, d.car, d.usable_rows, coalesce(p.peer_rows, 0) AS peer_rows, coalesce(p.same_mode_rows, 0) AS same_mode_rows,
  d.usable_rows >= 3 AS available, g.q50 AS peer_median, g.q90 AS peer_q90, o.q50 AS residual_median, o.q90 AS residual_q90,
  o.q90 - o.q10 AS residual_spread, g.above AS above_peer_fraction, o.above AS above_target_fraction, r.above AS warming_fraction
  FROM (SELECT file_id, car, count(*) FILTER (mask) AS usable_rows FROM mk GROUP BY ALL) d
  LEFT JOIN (SELECT file_id, car, count(gap) AS peer_rows, count(*) FILTER (same_mode) AS same_mode_rows FROM gp GROUP BY ALL) p USING (file_id, car)
  LEFT JOIN (SELECT * FROM qs WHERE measure = 'gap') g USING (file_id, car)
  LEFT JOIN (SELECT * FROM qs WHERE measure = 'own') o USING (file_id, car)
  LEFT JOIN (SELECT * FROM qs WHERE measure = 'rate') r USING (file_id, car))"""


def rank_sql(c: str) -> str:
    return (f"CASE WHEN available AND {c} IS NOT NULL THEN "
            f"((SELECT count(*) FROM ft b WHERE b.file_id = a.file_id AND b.available AND b.{c} < a.{c}) + 1 + "
            f"((SELECT count(*) FROM ft b WHERE b.file_id = a.file_id AND b.available AND b.{c} = a.{c}) - 1) / 2.0::DOUBLE) / "
            f"(SELECT count(b.{c}) FROM ft b WHERE b.file_id = a.file_id AND b.available) END AS {c}_rank")


RANKS = FEATURES + ", rk AS (SELECT file_id, car, available, " + ", ".join(rank_sql(c) for c in (
    "peer_median", "peer_q90", "residual_median", "residual_q90", "residual_spread")) + " FROM ft a)"
ORDERED = RANKS + """,
sc AS (SELECT *, CASE WHEN available THEN round(0.60::DOUBLE * coalesce(peer_median_rank, residual_median_rank)
  + 0.25::DOUBLE * coalesce(peer_q90_rank, residual_q90_rank) + 0.15::DOUBLE * residual_median_rank, 9) END AS score FROM rk),
od AS (SELECT file_id, string_agg(car, '|' ORDER BY (score IS NULL), score DESC, car) AS ranked_cars, count(score) AS scored_cars
  FROM sc GROUP BY file_id)"""

QUERIES = {
    "cooling_readings": (cooling_readings, f"WITH {BASE} SELECT file_id, ts, car, CAST(mask AS INT) AS mask, round(residual, 6) AS residual FROM mk"),
    "case_clock": (case_clock, f"WITH {BASE} SELECT file_id, ts, dt, weight, cadence FROM ck"),
    "peer_gap": (peer_gap, f"WITH {BASE} SELECT file_id, ts, car, CAST(same_mode AS INT) AS same_mode, round(gap, 6) AS gap FROM gp"),
    "car_features": (car_features, f"""WITH {FEATURES}
SELECT file_id, car, usable_rows, peer_rows, same_mode_rows, CAST(available AS INT) AS available, """ + ", ".join(
        f"round({c}, 6) AS {c}" for c in (*peers.RANKED, *peers.FRACTIONS)) + " FROM ft"),
    "car_ranks": (car_ranks, f"WITH {RANKS} SELECT file_id, car, " + ", ".join(
        f"round({c}_rank, 6) AS {c}_rank" for c in peers.RANKED) + " FROM rk"),
    "ranked_cars": (ranking, f"WITH {ORDERED} SELECT file_id, ranked_cars, scored_cars FROM od"),
    "ranking_metrics": (ranking_metrics, f"""WITH {ORDERED},
fc AS (SELECT file_id, arg_max(car, (m, car)) AS faulty_car FROM (SELECT file_id, car, round(avg(cabin), 9) AS m FROM rd GROUP BY ALL) GROUP BY file_id),
ps AS (SELECT list_position(string_split(ranked_cars, '|'), faulty_car) AS p FROM od JOIN fc USING (file_id))
SELECT count(*) AS cases, count(*) FILTER (p = 1) AS top1, count(*) FILTER (p <= 2) AS top2, round(avg(p), 6) AS mean_rank,
  round(avg((9 - p) / 8.0), 6) AS score FROM ps"""),
    "mode_inventory": (mode_inventory, f"""WITH {BASE}
SELECT file_id, car, mode, count(*) AS readings FROM rd GROUP BY GROUPING SETS ((file_id, mode, car), (file_id, mode))"""),
}

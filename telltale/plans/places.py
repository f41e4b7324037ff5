"""Work-order and geography queries with their SQL twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from telltale.operators import geo, orders, status
from telltale.plans import fleet
from telltale.sources import tables


def work_orders(spark, sf_dir):
    """Orders for actionable components that have no active order yet."""
    new = orders.derive_orders(status.component_status(fleet.scored_telemetry(spark, sf_dir)), "fleet")
    existing = tables.plain_telemetry(spark, sf_dir).where("component = 'error'").groupBy("train_id", "component").agg(
        F.when(F.max("s1") > 95, "open").otherwise("completed").alias("status")).withColumn("dataset", F.lit("fleet"))
    return orders.without_active(new, existing).select(
        "dataset", "train_id", "component", "issue", "priority", F.md5("action").alias("action_md5"), "status")


def component_advice(spark, sf_dir):
    out = orders.advise(status.component_status(fleet.scored_telemetry(spark, sf_dir)))
    return out.select("train_id", "component", "status", "title", "priority", "timeframe", "possible_cause",
                      F.size("actions").alias("actions"))


def order_log(spark, sf_dir):
    """Events of a user as requests on one order: sign-up opens, click starts, purchase completes."""
    e = tables.table(spark, sf_dir, "events")
    asked = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "click", "in_progress").when(
        (F.col("event_type") == "purchase") & (F.col("value") > 80), "completed")
    return e.select(F.col("user_id").alias("order_id"), "ts", F.col("event_id").alias("ord"), asked.alias("status")).where("status is not null")


def order_events(spark, sf_dir):
    return orders.order_events(order_log(spark, sf_dir)).select("order_id", "ord", "status", "outcome")


def order_state(spark, sf_dir):
    return orders.order_state(order_log(spark, sf_dir))


def stations(spark, sf_dir):
    return tables.table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("id"), F.col("n_nationkey").alias("ordinal"), (1.20 + F.col("n_nationkey") / 100).alias("lat"),
        (103.60 + F.col("n_regionkey") / 10).alias("lng"), F.array(F.col("n_regionkey").cast("string")).alias("lines"))


def fixes(spark, sf_dir):
    """A fix per event; views carry none and some lie outside the map."""
    e = tables.table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("train_id"), F.date_trunc("day", "ts").alias("ts"),
        F.when(F.col("event_type") != "view", F.round(1.19 + (F.col("user_id") % 30) / 100, 4)).alias("lat"),
        F.when(F.col("event_type") != "view", F.round(
            103.59 + (F.col("user_id") % 5) / 10 + F.when(F.col("value") > 70, 0.001).otherwise(0.0), 4)).alias("lng"),
        F.when(F.col("event_type") == "error", (F.col("user_id") % 5).cast("string")).alias("line"))


def latest_positions(spark, sf_dir):
    return geo.latest_positions(fixes(spark, sf_dir))


def nearest_stations(spark, sf_dir):
    out = geo.nearest_station(latest_positions(spark, sf_dir), stations(spark, sf_dir), ["train_id"])
    return out.select("train_id", "lat", "lng", "line", "station_id", F.round("distance_m", 3).alias("distance_m"))


def line_lookup(spark, sf_dir):
    lines = tables.table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("ordinal"))
    asked = tables.table(spark, sf_dir, "customer").select("c_custkey", F.element_at(
        F.array(F.lit("Asia "), F.lit("EUROPE"), F.lit("middle-east"), F.lit("3"), F.lit("nowhere")), (F.col("c_custkey") % 5 + 1).cast("int")).alias("line"))
    return geo.with_line(asked, lines).select("c_custkey", "line_id")


def path_positions(spark, sf_dir):
    """Customers placed on their region's line at a stable fraction."""
    n = tables.table(spark, sf_dir, "nation")
    vertices = n.select(F.col("n_regionkey").alias("line"), F.col("n_nationkey").alias("seq"),
                        (1.20 + F.col("n_nationkey") / 100).alias("lat"), (103.60 + (F.col("n_nationkey") * 7 % 10) / 10).alias("lng"))
    who = tables.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("key"), F.col("n_regionkey").alias("line"), geo.stable_fraction("c_name").alias("fraction"))
    out = geo.path_points(vertices, who)
    return out.select("key", "line", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


def footprints(spark, sf_dir):
    """Order lines as polygon vertices: one ring per order and return flag. Lines that tie in the order are the same vertex."""
    li = tables.table(spark, sf_dir, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    return li.select("l_orderkey", "l_returnflag", order.alias("seq"), F.col("l_quantity").alias("x"),
                     F.round(F.col("l_discount") * 100).alias("y"))


def ring_centroids(spark, sf_dir):
    out = geo.ring_centroids(footprints(spark, sf_dir), ["l_orderkey", "l_returnflag"])
    return out.select("l_orderkey", "l_returnflag", *[F.round(c, 6).alias(c) for c in ("x", "y", "area")])


def station_centres(spark, sf_dir):
    out = geo.weighted_centre(geo.ring_centroids(footprints(spark, sf_dir), ["l_orderkey", "l_returnflag"]), ["l_orderkey"])
    return out.select("l_orderkey", *[F.round(c, 4).alias(c) for c in ("x", "y", "area")])


def largest_footprints(spark, sf_dir):
    """Of each order's rings the one with the largest area."""
    rings = geo.ring_centroids(footprints(spark, sf_dir), ["l_orderkey", "l_returnflag"])
    rings = rings.withColumns({c: F.round(c, 6) for c in ("x", "y", "area")})
    return geo.largest_part(rings, ["l_orderkey"])


def case_sql(column: str, rules: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in rules.items()) + " END"


RULE = {i: case_sql("status", {s: r[i] for s, r in orders.STATUS_RULES.items()}) for i in range(3)}
OTHER = orders.OTHER_RULE[0]
LOG = """
lg AS (SELECT user_id AS order_id, ts, event_id AS ord, CASE event_type WHEN 'signup' THEN 'open' WHEN 'click' THEN 'in_progress'
  WHEN 'purchase' THEN CASE WHEN value > 80 THEN 'completed' END END AS status FROM events),
rk AS (SELECT *, CASE status WHEN 'open' THEN 0 WHEN 'in_progress' THEN 1 ELSE 2 END AS r FROM lg WHERE status IS NOT NULL),
bf AS (SELECT *, coalesce(max(r) OVER (PARTITION BY order_id ORDER BY ts, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM rk)"""
FIX = """
fx AS (SELECT 'T' || user_id AS train_id, date_trunc('day', ts) AS ts, CASE WHEN event_type <> 'view' THEN round(1.19::DOUBLE + (user_id % 30) / 100, 4) END AS lat,
  CASE WHEN event_type <> 'view' THEN round(103.59::DOUBLE + (user_id % 5) / 10 + CASE WHEN value > 70 THEN 0.001::DOUBLE ELSE 0 END, 4) END AS lng,
  CASE WHEN event_type = 'error' THEN CAST(user_id % 5 AS VARCHAR) END AS line FROM events),
la AS (SELECT * FROM (SELECT *, max(ts) OVER (PARTITION BY train_id) AS mx FROM fx) WHERE ts = mx),
po AS (SELECT train_id, any_value(ts) AS ts, min(lat) FILTER (ok) AS lat, min(lng) FILTER (ok) AS lng,
  CASE WHEN count(DISTINCT line) = 1 THEN min(line) END AS line
  FROM (SELECT *, coalesce(lat BETWEEN 1.14 AND 1.50 AND lng BETWEEN 103.53 AND 104.51, false) AS ok FROM la) GROUP BY train_id
  HAVING count(DISTINCT CASE WHEN ok THEN lat || ',' || lng END) = 1)"""
RING = """
v AS (SELECT l_orderkey, l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS seq, l_quantity AS x, round(l_discount * 100) AS y FROM lineitem),
o AS (SELECT *, x - first_value(x) OVER w AS a, y - first_value(y) OVER w AS b, first_value(x) OVER w AS ox, first_value(y) OVER w AS oy
  FROM v WINDOW w AS (PARTITION BY l_orderkey, l_returnflag ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
n AS (SELECT *, coalesce(lead(a) OVER w, 0) AS an, coalesce(lead(b) OVER w, 0) AS bn FROM o WINDOW w AS (PARTITION BY l_orderkey, l_returnflag ORDER BY seq)),
s AS (SELECT l_orderkey, l_returnflag, any_value(ox) AS ox, any_value(oy) AS oy, sum(a * bn - an * b) AS c, sum((a + an) * (a * bn - an * b)) AS sx,
  sum((b + bn) * (a * bn - an * b)) AS sy, avg(a) AS ma, avg(b) AS mb FROM n GROUP BY ALL),
ring AS (SELECT l_orderkey, l_returnflag, CASE WHEN abs(c) < 1e-15 THEN ma ELSE sx / (3 * c) END + ox AS x,
  CASE WHEN abs(c) < 1e-15 THEN mb ELSE sy / (3 * c) END + oy AS y, CASE WHEN abs(c) < 1e-15 THEN 0 ELSE abs(c) / 2 END AS area FROM s)"""

QUERIES = {
    "work_orders": (work_orders, f"""{fleet.FULL},
ex AS (SELECT 'U' || (user_id % 20) AS train_id, event_type AS component FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING max(value) > 95)
SELECT 'fleet' AS dataset, train_id, component, '{OTHER}' AS issue, CASE status WHEN 'critical' THEN 'P1' ELSE 'P2' END AS priority,
  md5('{' '.join(orders.OTHER_RULE[1])} Evidence timestamp: ' || strftime(evidence_ts, '%Y-%m-%dT%H:%M:%S') || '. ' || {RULE[2]}) AS action_md5, 'open' AS status
FROM comp WHERE status IN ('warning', 'critical') AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.train_id = comp.train_id AND ex.component = comp.component)"""),
    "component_advice": (component_advice, f"""{fleet.FULL}
SELECT train_id, component, status, {RULE[0]} AS title, {RULE[1]} AS priority, {RULE[2]} AS timeframe,
  CASE status WHEN 'unknown' THEN '{orders.CALM_RULES['unknown'][0]}' WHEN 'healthy' THEN '{orders.CALM_RULES['healthy'][0]}' ELSE '{OTHER}' END AS possible_cause,
  CAST(CASE WHEN status IN ('unknown', 'healthy') THEN 1 ELSE 3 END AS INT) AS actions FROM comp"""),
    "order_events": (order_events, f"""WITH {LOG}
SELECT order_id, ord, status, CASE WHEN r < b THEN 'rejected' WHEN r = b THEN 'unchanged' ELSE 'applied' END AS outcome FROM bf"""),
    "order_state": (order_state, f"""WITH {LOG}
SELECT order_id, CASE max(r) WHEN 0 THEN 'open' WHEN 1 THEN 'in_progress' ELSE 'completed' END AS status, count(*) AS events,
  arg_min(ts, (-r, ts, ord)) AS updated_at FROM rk GROUP BY order_id"""),
    "latest_positions": (latest_positions, f"WITH {FIX} SELECT train_id, ts, lat, lng, line FROM po"),
    "nearest_stations": (nearest_stations, f"""WITH {FIX},
st AS (SELECT n_name AS id, n_nationkey AS ord, 1.20::DOUBLE + n_nationkey / 100 AS lat, 103.60::DOUBLE + n_regionkey / 10 AS lng, CAST(n_regionkey AS VARCHAR) AS l FROM nation),
c AS (SELECT po.train_id, st.id, sqrt(((po.lat - st.lat) * 110574) ** 2 + ((po.lng - st.lng) * 111280) ** 2) AS d, st.ord FROM po JOIN st ON po.line IS NULL OR po.line = st.l),
b AS (SELECT train_id, arg_min(id, (d, ord)) AS station_id, min(d) AS d FROM c WHERE d <= 1500 GROUP BY train_id)
SELECT po.train_id, lat, lng, line, station_id, round(d, 3) AS distance_m FROM po LEFT JOIN b USING (train_id)"""),
    "line_lookup": (line_lookup, """WITH a AS (SELECT c_custkey, (['Asia ', 'EUROPE', 'middle-east', '3', 'nowhere'])[c_custkey % 5 + 1] AS line FROM customer)
SELECT c_custkey, CAST(r_regionkey AS VARCHAR) AS line_id FROM a LEFT JOIN region ON regexp_replace(lower(line), '[^a-z0-9]', '', 'g')
  IN (CAST(r_regionkey AS VARCHAR), regexp_replace(lower(r_name), '[^a-z0-9]', '', 'g'))"""),
    "path_positions": (path_positions, """WITH v AS (SELECT n_regionkey AS line, n_nationkey AS seq, 1.20::DOUBLE + n_nationkey / 100 AS lat, 103.60::DOUBLE + (n_nationkey * 7 % 10) / 10 AS lng FROM nation),
g AS (SELECT *, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2 FROM v WINDOW w AS (PARTITION BY line ORDER BY seq)),
l AS (SELECT *, sqrt(((lat - lat2) * 110574) ** 2 + ((lng - lng2) * 111280) ** 2) AS len FROM g WHERE lat2 IS NOT NULL),
u AS (SELECT *, sum(len) OVER (PARTITION BY line ORDER BY seq ROWS UNBOUNDED PRECEDING) AS upto, sum(len) OVER (PARTITION BY line) AS total FROM l),
c AS (SELECT c_custkey AS key, n_regionkey AS line, 0.08::DOUBLE + CAST('0x' || substr(sha256(c_name), 1, 8) AS BIGINT) / 4294967295 * 0.84 AS f FROM customer JOIN nation ON c_nationkey = n_nationkey),
h AS (SELECT c.key, c.line, u.*, f * total AS goal, row_number() OVER (PARTITION BY c.key ORDER BY seq) AS rn FROM c JOIN u ON c.line = u.line WHERE upto >= f * total)
SELECT key, line, round(lat + (1 - (upto - goal) / len) * (lat2 - lat), 6) AS lat, round(lng + (1 - (upto - goal) / len) * (lng2 - lng), 6) AS lng FROM h WHERE rn = 1"""),
    "ring_centroids": (ring_centroids, f"WITH {RING} SELECT l_orderkey, l_returnflag, round(x, 6) AS x, round(y, 6) AS y, round(area, 6) AS area FROM ring"),
    "station_centres": (station_centres, f"""WITH {RING} SELECT l_orderkey, round(CASE WHEN sum(area) > 0 THEN sum(x * area) / sum(area) ELSE avg(x) END, 4) AS x,
  round(CASE WHEN sum(area) > 0 THEN sum(y * area) / sum(area) ELSE avg(y) END, 4) AS y, round(sum(area), 4) AS area FROM ring GROUP BY l_orderkey"""),
    "largest_footprints": (largest_footprints, f"""WITH {RING}, q AS (SELECT l_orderkey, round(x, 6) AS x, round(y, 6) AS y, round(area, 6) AS area FROM ring)
SELECT l_orderkey, x, y, area FROM q QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY area DESC, x DESC, y DESC) = 1"""),
}

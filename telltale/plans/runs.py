"""Saved-run, comparison, export and report queries with their SQL twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from telltale.functions.columns import seconds_between
from telltale.operators import catalog, clean, reports, status
from telltale.operators import fleet as fleet_ops
from telltale.operators import orders as work
from telltale.plans import fleet, streams
from telltale.sources import tables


def run_id(subsystem, part):
    return F.md5(F.concat_ws(":", F.lit(subsystem), part.cast("string")))


COLUMNS = ["run_id", "subsystem", "file_id", "row_no", "start", "end", "prediction", "ranked_cars", "damage"]


def predictions(spark, sf_dir):
    """Predictions of the four tasks on the given tables, split into runs."""
    none = lambda t: F.lit(None).cast(t)
    acts = streams.labelled(spark, sf_dir, 6)
    door = acts.select(
        run_id("door", F.col("stream_id") % 7).alias("run_id"), F.lit("door").alias("subsystem"),
        F.concat(F.lit("door_"), F.col("stream_id").cast("string"), F.lit(".csv")).alias("file_id"), F.col("segment").alias("row_no"), "start", "end",
        F.col("label").alias("prediction"), none("string").alias("ranked_cars"), none("double").alias("damage"))
    e = tables.table(spark, sf_dir, "embeddings")
    kind = F.when(F.col("label") % 3 == 0, "Normal").when(F.col("label") % 3 == 1, "Side I").otherwise("Side II")
    rail = e.select(
        run_id("rail", F.col("vec_id") % 5).alias("run_id"), F.lit("rail").alias("subsystem"),
        F.concat(F.lit("Rail "), F.col("vec_id").cast("string"), F.lit(".csv")).alias("file_id"), F.lit(0).cast("long").alias("row_no"),
        none("timestamp_ntz").alias("start"), none("timestamp_ntz").alias("end"), kind.alias("prediction"),
        none("string").alias("ranked_cars"), none("double").alias("damage"))
    o = tables.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice") / 1e6, 6).alias("damage"))
    shm = o.select(
        run_id("shm", F.col("o_custkey") % 11).alias("run_id"), F.lit("shm").alias("subsystem"),
        F.concat(F.lit("shm_"), F.col("o_custkey").cast("string"), F.lit(".csv")).alias("file_id"), F.lit(0).cast("long").alias("row_no"),
        none("timestamp_ntz").alias("start"), none("timestamp_ntz").alias("end"), none("string").alias("prediction"),
        none("string").alias("ranked_cars"), F.when(F.col("damage") < 3.5, F.col("damage")).alias("damage"))
    n = tables.table(spark, sf_dir, "supplier")
    order = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lpad(
        ((i + F.col("s_suppkey").cast("int")) % 8 + 1).cast("string"), 2, "0"))
    acv = n.select(
        run_id("acv", F.col("s_suppkey") % 3).alias("run_id"), F.lit("acv").alias("subsystem"),
        F.concat(F.lit("case_"), F.col("s_suppkey").cast("string"), F.lit(".xlsx")).alias("file_id"), F.lit(0).cast("long").alias("row_no"),
        none("timestamp_ntz").alias("start"), none("timestamp_ntz").alias("end"), none("string").alias("prediction"),
        F.array_join(order, "|").alias("ranked_cars"), none("double").alias("damage"))
    return door.unionByName(rail).unionByName(shm).unionByName(acv)


def warnings(spark, sf_dir):
    """A warning for each file with a large or missing result."""
    p = predictions(spark, sf_dir)
    warn = F.when((F.col("subsystem") == "shm") & (F.coalesce("damage", F.lit(9.0)) > 3), "The estimate lies outside the training range.").when(
        (F.col("subsystem") == "door") & (F.col("start") == F.col("end")), "An inferred segment has too few readings.")
    return p.select("run_id", "file_id", warn.alias("warning")).where("warning is not null").distinct()


def files(spark, sf_dir):
    return catalog.file_summary(predictions(spark, sf_dir), warnings(spark, sf_dir))


def file_summaries(spark, sf_dir):
    return files(spark, sf_dir).select(
        "run_id", "subsystem", "file_id", "prediction_rows", "warnings_count", "abnormal_actions", "first_car",
        "predicted_class", "damage")


def run_aggregates(spark, sf_dir):
    out = catalog.run_aggregates(files(spark, sf_dir))
    return out.withColumn("damage_mean", F.round("damage_mean", 6))


def first_rank_counts(spark, sf_dir):
    return catalog.first_rank_counts(files(spark, sf_dir))


def run_sentences(spark, sf_dir):
    return catalog.run_sentence(catalog.run_aggregates(files(spark, sf_dir)))


def prediction_problems(spark, sf_dir):
    return catalog.prediction_problems(predictions(spark, sf_dir))


def comparison_page(spark, sf_dir):
    """A searched page of all stress recordings by damage, largest first."""
    shown = files(spark, sf_dir).where("subsystem = 'shm'")
    return catalog.comparison_page(shown, "shm_1", "value-desc", 10, 30).select("file_id", "damage", "warnings_count")


def natural_page(spark, sf_dir):
    shown = files(spark, sf_dir).where("subsystem = 'rail'")
    return catalog.comparison_page(shown, None, "filename", 5, 30).select("file_id", "predicted_class")


def page_facts(spark, sf_dir):
    out = catalog.page_facts(files(spark, sf_dir).where("subsystem = 'shm'"), "shm_1", 10, 30)
    return out.select("matching", F.col("included").cast("bigint").alias("included"), F.col("next_offset").cast("bigint").alias("next_offset"))


def runs(spark, sf_dir):
    """Orders as saved runs; the fifth priority stands for an unknown task and is invalid."""
    o = tables.table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    names = F.create_map(*[F.lit(x) for pair in (("1-URGENT", "door"), ("2-HIGH", "acv"), ("3-MEDIUM", "rail"), ("4-NOT SPECIFIED", "shm")) for x in pair])
    return o.select(
        F.md5(F.col("o_orderkey").cast("string")).alias("run_id"), F.coalesce(names[F.col("o_orderpriority")], F.lit("other")).alias("subsystem"),
        state.alias("status"), F.col("o_orderdate").alias("created_at"), F.lit("uploaded").alias("source"),
        F.when(F.col("o_orderstatus") == "F", F.lit(3)).otherwise(1).alias("completed"), F.lit(3).alias("total"))


def valid_runs(spark, sf_dir):
    return catalog.valid_runs(runs(spark, sf_dir))


def newest_runs(spark, sf_dir):
    return catalog.newest_runs(valid_runs(spark, sf_dir), 40).select("run_id", "subsystem", "status", "created_at")


def latest_completed(spark, sf_dir):
    return catalog.latest_completed(valid_runs(spark, sf_dir)).select("subsystem", "run_id", "created_at")


def active_runs(spark, sf_dir):
    return catalog.active_runs(valid_runs(spark, sf_dir)).groupBy("subsystem").agg(F.count(F.lit(1)).alias("active"))


def catalog_counts(spark, sf_dir):
    return catalog.catalog_counts(valid_runs(spark, sf_dir))


def merged_history(spark, sf_dir):
    o = runs(spark, sf_dir).withColumn("place", F.lit(0))
    library = o.where("status = 'completed'")
    recent = o.where("status != 'failed'").withColumn("created_at", F.col("created_at") + F.expr("interval 1 day"))
    return catalog.merged_history(library, recent).select("run_id", "subsystem", "created_at", "source")


def selection(spark, sf_dir):
    """Files offered for export: every stress and cooling file, all door streams, and some stale names."""
    p = predictions(spark, sf_dir).select("run_id", "file_id", "subsystem").distinct()
    stale = F.when((F.col("subsystem") == "rail") & F.endswith(F.col("file_id"), F.lit("7.csv")), F.concat(F.lit("old "), F.col("file_id"))).otherwise(F.col("file_id"))
    return p.select("run_id", stale.alias("file_id"))


def known_runs(spark, sf_dir):
    p = predictions(spark, sf_dir).select("run_id", "subsystem").distinct()
    return p.withColumn("status", F.when(F.col("subsystem") == "acv", "running").otherwise("completed"))


def export_problems(spark, sf_dir):
    return catalog.export_problems(known_runs(spark, sf_dir), predictions(spark, sf_dir), selection(spark, sf_dir))


def export_plan(spark, sf_dir):
    return catalog.export_plan(predictions(spark, sf_dir), selection(spark, sf_dir))


def scoped_predictions(spark, sf_dir):
    p = predictions(spark, sf_dir)
    chosen = p.where("subsystem = 'shm' and damage is null").select("run_id", "file_id").distinct()
    return catalog.scoped(p, chosen).select("run_id", "file_id", "damage")


def manifest_check(spark, sf_dir):
    """Pages by URL against the content hash of a later copy in which some changed or vanished."""
    from telltale.operators.validate import compare_manifest
    pages = tables.table(spark, sf_dir, "pages")
    html = F.when(F.length("html") % 3 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html"))
    expected = pages.where(F.length("url") % 5 != 0).select(F.col("page_id").alias("file"), F.sha2("html", 256).alias("sha256"))
    actual = pages.where(F.length("url") % 7 != 0).select(F.col("page_id").alias("file"), F.sha2(html, 256).alias("sha256"))
    return compare_manifest(expected, actual)


def stress_evidence(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.sqrt(F.avg(F.col("o_totalprice") * F.col("o_totalprice"))).alias("rms"),
        (F.max("o_totalprice") - F.min("o_totalprice")).alias("range"), F.count(F.lit(1)).alias("samples"))
    measured = o.select(run_id("shm", F.col("o_custkey") % 11).alias("run_id"),
                        F.concat(F.lit("shm_"), F.col("o_custkey").cast("string"), F.lit(".csv")).alias("file_id"), "rms", "range", "samples")
    return reports.evidence_rows(measured, ["run_id", "file_id"])


def report_evidence(spark, sf_dir):
    return stress_evidence(spark, sf_dir).select("run_id", "file_id", "id", "label", F.round("value", 4).alias("value"), "unit")


def fact_ranges(spark, sf_dir):
    m = catalog.measurement(stress_evidence(spark, sf_dir), "shm-rms", "raw stress units", True)
    return catalog.run_range(m).select("run_id", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "files")


def action_evidence(spark, sf_dir):
    acts = streams.labelled(spark, sf_dir, 6).withColumn("duration", seconds_between("start", "end"))
    return reports.action_evidence(acts, ["stream_id"]).select("stream_id", "id", "label", F.round("value", 6).alias("value"), "unit")


def recording_page(spark, sf_dir):
    """Rows 3 to 7 of every door file with what is left out."""
    p = predictions(spark, sf_dir).where("subsystem = 'door'")
    keys = ["run_id", "file_id"]
    rows = reports.bounded_page(p, keys, ["row_no"], 5, 2)
    return rows.join(reports.page_counts(p, keys, 5, 2), keys).select(
        "file_id", "row_no", "prediction", "total", F.col("omitted").cast("bigint").alias("omitted"), F.col("next_offset").cast("bigint").alias("next_offset"))


def side_targets(spark, sf_dir):
    p = predictions(spark, sf_dir).where("subsystem = 'rail'")
    return reports.rail_targets(p)


def sensor_targets(spark, sf_dir):
    sides = side_targets(spark, sf_dir)
    return reports.sensor_targets(sides).groupBy("file_id", "target").agg(F.count(F.lit(1)).alias("sensors"))


def component_explanations(spark, sf_dir):
    comp = work.advise(status.component_status(fleet.scored_telemetry(spark, sf_dir)))
    out = reports.explanation(comp)
    return out.select("train_id", "component", "summary", F.size("evidence").alias("lines"))


def file_sentences(spark, sf_dir):
    return catalog.file_sentence(files(spark, sf_dir))


def file_measurements(spark, sf_dir):
    """Measured sentence per stress recording, with the number left to the six-digit form."""
    out = catalog.measured_sentence(stress_evidence(spark, sf_dir))
    return out.select("file_id", F.regexp_extract("text", r"^(.*about )", 1).alias("lead"),
                      F.round(F.regexp_extract("text", r"about ([0-9.e+]+)", 1).cast("double"), 4).alias("value"))


def task_evidence(spark, sf_dir):
    """Evidence of all four tasks: run_id, file_id, id, value, unit."""
    cols = ["run_id", "file_id", "id", "value", "unit"]
    acts = streams.labelled(spark, sf_dir, 6).withColumn("duration", seconds_between("start", "end"))
    name = lambda head, c, tail: F.concat(F.lit(head), F.col(c).cast("string"), F.lit(tail))
    door = reports.action_evidence(acts, ["stream_id"]).withColumns({
        "run_id": run_id("door", F.col("stream_id") % 7), "file_id": name("door_", "stream_id", ".csv")})
    pace = tables.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("value")).select(
        run_id("door", F.col("user_id") % 7).alias("run_id"), name("door_", "user_id", ".csv").alias("file_id"),
        F.lit("door-cadence").alias("id"), "value", F.lit("seconds").alias("unit"))
    rail = tables.table(spark, sf_dir, "embeddings").select(
        run_id("rail", F.col("vec_id") % 5).alias("run_id"), name("Rail ", "vec_id", ".csv").alias("file_id"),
        F.posexplode(F.slice("embedding", 1, 2)).alias("side", "value")).select(
        "run_id", "file_id", F.concat(F.lit("rail-side-"), (F.col("side") + 1).cast("string"), F.lit("-vibration")).alias("id"),
        F.col("value").cast("double").alias("value"), F.lit("m/s²").alias("unit"))
    cars = tables.table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("car")).select(
        run_id("acv", F.col("s_suppkey") % 3).alias("run_id"), name("case_", "s_suppkey", ".xlsx").alias("file_id"),
        F.when(F.col("car") == 0, "acv-coverage").otherwise(F.concat(F.lit("acv-car-"), F.lpad(F.col("car").cast("string"), 2, "0"))).alias("id"),
        F.when(F.col("car") == 0, F.col("s_suppkey") % 9).otherwise(F.col("s_acctbal").cast("double") + F.col("car")).cast("double").alias("value"),
        F.when(F.col("car") == 0, "cars").otherwise("raw temperature units").alias("unit"))
    out = stress_evidence(spark, sf_dir).select(*cols)
    for part in (door, pace, rail, cars):
        out = out.unionByName(part.select(*cols))
    return out


def measured_facts(spark, sf_dir):
    """Facts of every file with a measurement, and its sentence with the numbers taken out."""
    flagged = predictions(spark, sf_dir).where("subsystem = 'door' and prediction = 'Abnormal resistance'").select(
        "run_id", "file_id", (F.col("row_no") + 1).cast("long").alias("action"))
    out = catalog.measured_facts(files(spark, sf_dir), task_evidence(spark, sf_dir), flagged)
    return out.select("run_id", "file_id", "subsystem", "flagged_action", *[F.round(c, 4).alias(c) for c in (
        "peak_current_ma", "duration_s", "sample_interval_s", "first_car_difference", "side_1_rms", "side_2_rms", "stress_rms")],
        F.regexp_replace("text", r"about -?[0-9.e+-]*[0-9]", "about #").alias("wording"))


def cautions(spark, sf_dir):
    """Short cautions of files that carry one of the limiting warnings."""
    p = files(spark, sf_dir)
    texts = F.array(F.when(F.col("prediction_rows") == 1, "No gaps were detected. Its true action count is unknown."),
                    F.when(F.coalesce("damage", F.lit(9.0)) > 3, "The estimate lies outside the observed training-target range and requires additional validation."))
    return p.select("file_id", catalog.caution("subsystem", F.array_compact(texts)).alias("caution")).where("caution is not null")


def default_basket(spark, sf_dir):
    """Newest completed run per task among runs dated by their id."""
    known = known_runs(spark, sf_dir).withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    return catalog.default_basket(known, predictions(spark, sf_dir)).groupBy("subsystem", "run_id").agg(F.count(F.lit(1)).alias("files"))


def action_targets(spark, sf_dir):
    t = reports.action_targets(predictions(spark, sf_dir).where("subsystem = 'door'"))
    return reports.attention_target(t)


def car_targets(spark, sf_dir):
    """Cars of each case; cars whose number equals the last digit of the case have no evidence."""
    p = predictions(spark, sf_dir).where("subsystem = 'acv'")
    e = p.select("file_id", F.explode(F.split("ranked_cars", r"\|")).alias("id")).withColumn(
        "status", F.when(F.contains(F.col("file_id"), F.concat(F.substring("id", 2, 1), F.lit(".xlsx"))), "unavailable").otherwise("ranked"))
    return reports.car_targets(p, e).select("file_id", "target", "rank", "tone")


def healthy_share(spark, sf_dir):
    return fleet_ops.healthy_share(status.status_trend(fleet.scored_telemetry(spark, sf_dir))).select(
        F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), F.round("healthy_pct", 4).alias("healthy_pct"))


def searched_trains(spark, sf_dir):
    """Trains in need of attention whose id holds a text."""
    trains = fleet_ops.fleet_status(status.component_status(fleet.scored_telemetry(spark, sf_dir)))
    return clean.search_filter(trains, ["train_id", "status"], "U1", "unknown").select("train_id", "status", "risk")


PRED = """
ev AS (SELECT user_id AS stream_id, ts, event_id AS ord, value AS reading, event_type FROM events),
dts AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY stream_id ORDER BY ts, ord)) / CAST(1000000 AS DOUBLE) AS dt FROM ev),
sg AS (SELECT *, CAST(sum(CASE WHEN dt > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY ts, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM dts),
ac AS (SELECT stream_id, segment, min(ts) AS start, max(ts) AS fin, max(abs(reading)) AS peak,
  CASE WHEN avg(reading) > 55 THEN 'Abnormal resistance' ELSE 'Normal' END AS label FROM sg GROUP BY ALL),
pr AS (SELECT md5('door:' || (stream_id % 7)) AS run_id, 'door' AS subsystem, 'door_' || stream_id || '.csv' AS file_id, segment AS row_no, start, fin,
    label AS prediction, NULL AS ranked_cars, NULL::DOUBLE AS damage FROM ac
  UNION ALL SELECT md5('rail:' || (vec_id % 5)), 'rail', 'Rail ' || vec_id || '.csv', 0, NULL, NULL,
    CASE label % 3 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Side I' ELSE 'Side II' END, NULL, NULL FROM embeddings
  UNION ALL SELECT md5('shm:' || (o_custkey % 11)), 'shm', 'shm_' || o_custkey || '.csv', 0, NULL, NULL, NULL, NULL,
    CASE WHEN round(sum(o_totalprice) / 1e6, 6) < 3.5 THEN round(sum(o_totalprice) / 1e6, 6) END FROM orders GROUP BY o_custkey
  UNION ALL SELECT md5('acv:' || (s_suppkey % 3)), 'acv', 'case_' || s_suppkey || '.xlsx', 0, NULL, NULL, NULL,
    array_to_string(list_transform(range(0, 8), lambda i: lpad(CAST((i + s_suppkey) % 8 + 1 AS VARCHAR), 2, '0')), '|'), NULL FROM supplier),
wn AS (SELECT DISTINCT run_id, file_id, CASE WHEN subsystem = 'shm' AND coalesce(damage, 9) > 3 THEN 'a' WHEN subsystem = 'door' AND start = fin THEN 'b' END AS w
  FROM pr WHERE w IS NOT NULL),
fl AS (SELECT run_id, subsystem, file_id, count(*) AS prediction_rows,
  (SELECT count(*) FROM wn WHERE wn.run_id = pr.run_id AND wn.file_id = pr.file_id) AS warnings_count,
  CASE WHEN subsystem = 'door' THEN count(*) END AS total_actions,
  CASE WHEN subsystem = 'door' THEN count(*) FILTER (prediction = 'Abnormal resistance') END AS abnormal_actions,
  max(string_split(ranked_cars, '|')[1]) AS first_car, CASE WHEN subsystem = 'rail' THEN max(prediction) END AS predicted_class, max(damage) AS damage
  FROM pr GROUP BY run_id, subsystem, file_id)"""
AGG = """,
ag AS (SELECT run_id, subsystem, count(*) AS files, count(*) FILTER (warnings_count > 0) AS files_with_warnings,
  CAST(sum(prediction_rows) AS BIGINT) AS prediction_rows, CAST(sum(total_actions) AS BIGINT) AS total_actions,
  CAST(sum(abnormal_actions) AS BIGINT) AS abnormal_actions, count(*) FILTER (predicted_class = 'Normal') AS class_normal,
  count(*) FILTER (predicted_class = 'Side I') AS class_side_i, count(*) FILTER (predicted_class = 'Side II') AS class_side_ii,
  count(damage) AS damage_count, min(damage) AS damage_min, max(damage) AS damage_max, round(avg(damage), 6) AS damage_mean,
  count(*) FILTER ((subsystem = 'acv' AND first_car IS NULL) OR (subsystem = 'rail' AND predicted_class IS NULL) OR (subsystem = 'shm' AND damage IS NULL)) AS missing_predictions
  FROM fl GROUP BY run_id, subsystem)"""
RUNS = """
ru AS (SELECT md5(CAST(o_orderkey AS VARCHAR)) AS run_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'door' WHEN '2-HIGH' THEN 'acv' WHEN '3-MEDIUM' THEN 'rail'
  WHEN '4-NOT SPECIFIED' THEN 'shm' ELSE 'other' END AS subsystem, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  o_orderdate AS created_at FROM orders),
va AS (SELECT * FROM ru WHERE subsystem <> 'other')"""
EVID = """
e AS (SELECT md5('shm:' || (o_custkey % 11)) AS run_id, 'shm_' || o_custkey || '.csv' AS file_id, sqrt(avg(o_totalprice * o_totalprice)) AS rms,
  max(o_totalprice) - min(o_totalprice) AS rg, count(*) AS n FROM orders GROUP BY o_custkey)"""

QUERIES = {
    "file_summaries": (file_summaries, f"WITH {PRED} SELECT run_id, subsystem, file_id, prediction_rows, warnings_count, abnormal_actions, first_car, predicted_class, damage FROM fl"),
    "run_aggregates": (run_aggregates, f"WITH {PRED}{AGG} SELECT * FROM ag"),
    "first_rank_counts": (first_rank_counts, f"WITH {PRED} SELECT run_id, first_car, count(*) AS files FROM fl WHERE first_car IS NOT NULL GROUP BY ALL"),
    "run_sentences": (run_sentences, f"""WITH {PRED}{AGG},
f AS (SELECT *, files || CASE WHEN files = 1 THEN ' file' ELSE ' files' END AS t FROM ag)
SELECT run_id, subsystem, CASE subsystem WHEN 'door' THEN t || ': ' || abnormal_actions || ' of ' || total_actions ||
    CASE WHEN total_actions = 1 THEN ' detected door movement was' ELSE ' detected door movements were' END || ' flagged for abnormal resistance.'
  WHEN 'rail' THEN t || ': ' || class_normal || ' classified Normal, ' || class_side_i || ' Side I corrugation, and ' || class_side_ii || ' Side II corrugation.'
  WHEN 'shm' THEN t || ': estimated fatigue damage spans approximately ' || CASE WHEN damage_min = damage_max THEN printf('%.6g', damage_min)
    ELSE printf('%.6g', damage_min) || '–' || printf('%.6g', damage_max) END || '; these are separate recording estimates, not percentages or remaining lifetimes.'
  ELSE t || ': ' || (files - missing_predictions) || CASE WHEN files - missing_predictions = 1 THEN ' cooling ranking.' ELSE ' cooling rankings.' END END AS sentence
FROM f"""),
    "prediction_problems": (prediction_problems, f"""WITH {PRED},
v AS (SELECT *, coalesce(CASE subsystem WHEN 'door' THEN prediction IN ('Normal', 'Abnormal resistance') AND fin > start
  WHEN 'acv' THEN len(string_split(ranked_cars, '|')) = 8 AND len(list_distinct(string_split(ranked_cars, '|'))) = 8
  WHEN 'rail' THEN prediction IN ('Normal', 'Side I', 'Side II') ELSE damage >= 0 END, false) AS ok FROM pr)
SELECT run_id, subsystem, file_id, count(*) AS rows, count(*) FILTER (NOT ok) AS invalid_rows FROM v GROUP BY ALL
HAVING count(*) FILTER (NOT ok) > 0 OR (subsystem <> 'door' AND count(*) <> 1)"""),
    "comparison_page": (comparison_page, f"""WITH {PRED} SELECT file_id, damage, warnings_count FROM fl WHERE subsystem = 'shm' AND contains(lower(file_id || ' shm'), 'shm_1')
ORDER BY damage DESC NULLS LAST, CAST(regexp_extract(file_id, '[0-9]+') AS BIGINT) LIMIT 30 OFFSET 10"""),
    "natural_page": (natural_page, f"""WITH {PRED} SELECT file_id, predicted_class FROM fl WHERE subsystem = 'rail'
ORDER BY CAST(regexp_extract(file_id, '[0-9]+') AS BIGINT) LIMIT 30 OFFSET 5"""),
    "page_facts": (page_facts, f"""WITH {PRED}, c AS (SELECT count(*) AS matching FROM fl WHERE subsystem = 'shm' AND contains(file_id, 'shm_1'))
SELECT matching, least(30, greatest(0, matching - 10)) AS included, CASE WHEN least(30, greatest(0, matching - 10)) + 10 < matching
  THEN least(30, greatest(0, matching - 10)) + 10 END AS next_offset FROM c"""),
    "newest_runs": (newest_runs, f"WITH {RUNS} SELECT run_id, subsystem, status, created_at FROM va ORDER BY created_at DESC, run_id DESC LIMIT 40"),
    "latest_completed": (latest_completed, f"""WITH {RUNS} SELECT subsystem, run_id, created_at FROM (SELECT *, row_number() OVER
  (PARTITION BY subsystem ORDER BY created_at DESC, run_id DESC) AS rn FROM va WHERE status = 'completed') WHERE rn = 1"""),
    "active_runs": (active_runs, f"WITH {RUNS} SELECT subsystem, count(*) AS active FROM va WHERE status IN ('queued', 'running') GROUP BY subsystem"),
    "catalog_counts": (catalog_counts, f"""WITH {RUNS}, w AS (SELECT * FROM va ORDER BY created_at DESC, run_id DESC LIMIT 100)
SELECT (SELECT count(*) FROM va) AS total, count(*) AS scanned, count(*) FILTER (status = 'completed') AS completed,
  greatest(0, count(*) FILTER (status = 'completed') - 30) AS omitted, (SELECT count(*) FROM va) - count(*) AS not_scanned FROM w"""),
    "merged_history": (merged_history, f"""WITH {RUNS} SELECT run_id, subsystem, CASE WHEN status = 'completed' THEN created_at ELSE created_at + INTERVAL 1 DAY END AS created_at,
  CASE WHEN status = 'completed' THEN 0 ELSE 1 END AS source FROM ru WHERE status <> 'failed'"""),
    "export_problems": (export_problems, f"""WITH {PRED},
k AS (SELECT DISTINCT run_id, subsystem, file_id, CASE WHEN subsystem = 'rail' AND suffix(file_id, '7.csv') THEN 'old ' || file_id ELSE file_id END AS sel FROM pr),
v AS (SELECT run_id, file_id, bool_and(coalesce(CASE subsystem WHEN 'door' THEN fin > start WHEN 'shm' THEN damage >= 0 ELSE true END, false)) AS ok FROM pr GROUP BY ALL)
SELECT subsystem, problem, n FROM (
  SELECT subsystem, 'run not completed' AS problem, count(*) AS n FROM k WHERE subsystem = 'acv' GROUP BY 1
  UNION ALL SELECT subsystem, 'file not in run', count(*) FROM k WHERE sel <> file_id GROUP BY 1
  UNION ALL SELECT subsystem, 'invalid predictions', count(*) FROM k JOIN v USING (run_id, file_id) WHERE sel = file_id AND NOT ok GROUP BY 1
  UNION ALL SELECT 'door', 'more than one door stream', 1) WHERE n > 0"""),
    "export_plan": (export_plan, f"""WITH {PRED} SELECT subsystem, count(DISTINCT file_id) AS files, count(*) AS rows FROM pr
WHERE NOT (subsystem = 'rail' AND suffix(file_id, '7.csv')) GROUP BY subsystem"""),
    "scoped_predictions": (scoped_predictions, f"WITH {PRED} SELECT run_id, file_id, damage FROM pr WHERE subsystem = 'shm' AND damage IS NULL"),
    "manifest_check": (manifest_check, """WITH e AS (SELECT page_id AS file, html AS h FROM pages WHERE length(url) % 5 <> 0),
a AS (SELECT page_id AS file, CASE WHEN length(html) % 3 = 0 THEN html || ' ' ELSE html END AS h FROM pages WHERE length(url) % 7 <> 0)
SELECT file, CASE WHEN a.h IS NULL THEN 'missing' WHEN e.h IS NULL THEN 'unexpected' WHEN e.h = a.h THEN 'equal' ELSE 'changed' END AS state
FROM e FULL OUTER JOIN a USING (file)"""),
    "report_evidence": (report_evidence, f"""WITH {EVID}
SELECT run_id, file_id, 'shm-rms' AS id, 'Stress signal RMS' AS label, round(rms, 4) AS value, 'raw stress units' AS unit FROM e
UNION ALL SELECT run_id, file_id, 'shm-range', 'Stress signal range', round(rg, 4), 'raw stress units' FROM e
UNION ALL SELECT run_id, file_id, 'shm-samples', 'Measured samples', CAST(n AS DOUBLE), 'samples' FROM e"""),
    "fact_ranges": (fact_ranges, f"WITH {EVID} SELECT run_id, round(min(rms), 4) AS low, round(max(rms), 4) AS high, count(*) AS files FROM e GROUP BY run_id"),
    "action_evidence": (action_evidence, f"""WITH {PRED}, f AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY segment) AS rn FROM ac WHERE label = 'Abnormal resistance')
SELECT stream_id, 'door-action-' || (segment + 1) || '-current' AS id, 'Action ' || (segment + 1) || ' peak absolute motor current' AS label, peak AS value, 'mA' AS unit FROM f WHERE rn <= 5
UNION ALL SELECT stream_id, 'door-action-' || (segment + 1) || '-duration', 'Action ' || (segment + 1) || ' measured duration',
  round((epoch_us(fin) - epoch_us(start)) / CAST(1000000 AS DOUBLE), 6), 'seconds' FROM f WHERE rn <= 5"""),
    "recording_page": (recording_page, f"""WITH {PRED}, n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_no) AS rn, count(*) OVER (PARTITION BY file_id) AS total FROM pr WHERE subsystem = 'door')
SELECT file_id, row_no, prediction, total, total - least(5, greatest(0, total - 2)) AS omitted, CASE WHEN least(5, greatest(0, total - 2)) + 2 < total
  THEN least(5, greatest(0, total - 2)) + 2 END AS next_offset FROM n WHERE rn > 2 AND rn <= 7"""),
    "side_targets": (side_targets, f"""WITH {PRED} SELECT file_id, t.target, t.label, CASE WHEN prediction = t.label THEN 'flagged' ELSE 'context' END AS tone
FROM pr, (VALUES ('side-1', 'Side I'), ('side-2', 'Side II')) AS t(target, label) WHERE subsystem = 'rail'"""),
    "sensor_targets": (sensor_targets, f"WITH {PRED} SELECT file_id, t.target, CAST(32 AS BIGINT) AS sensors FROM pr, (VALUES ('side-1'), ('side-2')) AS t(target) WHERE subsystem = 'rail'"),
    "component_explanations": (component_explanations, f"""{fleet.FULL}, f AS (SELECT train_id, component, stale FROM fresh)
SELECT train_id, component, train_id || ' / ' || component || ': ' || recent_flags || ' of ' || recent_valid || ' recent scored monitoring observations were flagged. ' ||
  CASE status WHEN 'healthy' THEN '{work.STATUS_RULES['healthy'][0]}' WHEN 'warning' THEN '{work.STATUS_RULES['warning'][0]}'
  WHEN 'critical' THEN '{work.STATUS_RULES['critical'][0]}' ELSE '{work.STATUS_RULES['unknown'][0]}' END || '.' AS summary,
  CAST(1 + (evidence_ts IS NOT NULL)::INT + (recent_valid < 4)::INT + coalesce(stale, false)::INT AS INT) AS lines FROM comp JOIN f USING (train_id, component)"""),
    "file_sentences": (file_sentences, f"""WITH {PRED}
SELECT run_id, subsystem, file_id, CASE subsystem WHEN 'door' THEN abnormal_actions || ' of ' || total_actions ||
    CASE WHEN total_actions = 1 THEN ' detected door movement was' ELSE ' detected door movements were' END || ' flagged for abnormal resistance.'
  WHEN 'rail' THEN CASE WHEN predicted_class = 'Normal' THEN 'The recording is classified as Normal; no rail corrugation is predicted.'
    ELSE 'The recording is classified as ' || predicted_class || ' rail corrugation.' END
  WHEN 'shm' THEN coalesce('The estimated cumulative fatigue damage is approximately ' || printf('%.6g', damage * (1 + 1e-12::DOUBLE))
    || '; it is not a percentage or remaining lifetime.', 'No complete prediction is available for this recording.')
  ELSE 'Car ' || first_car || ' appears first in the recorded ranking; cooling-reading availability is not recorded.' END AS sentence
FROM fl"""),
    "file_measurements": (file_measurements, f"""WITH {EVID}, d AS (SELECT file_id, rms, pow(10, floor(log10(rms)) - 5) AS u FROM e)
SELECT file_id, 'Stress level (RMS): about ' AS lead, round(round(rms / u) * u, 4) AS value FROM d"""),
    "measured_facts": (measured_facts, f"""WITH {PRED}, {EVID.strip()},
a1 AS (SELECT 'door_' || stream_id || '.csv' AS file_id, min(segment) AS seg FROM ac WHERE label = 'Abnormal resistance' GROUP BY stream_id),
d AS (SELECT 'door_' || stream_id || '.csv' AS file_id, segment + 1 AS action, peak, (epoch_us(fin) - epoch_us(start)) / CAST(1000000 AS DOUBLE) AS dur
  FROM ac JOIN a1 ON a1.file_id = 'door_' || stream_id || '.csv' AND seg = segment),
st AS (SELECT 'door_' || user_id || '.csv' AS file_id, max(value) AS step FROM events GROUP BY user_id),
ra AS (SELECT 'Rail ' || vec_id || '.csv' AS file_id, CASE WHEN embedding[1] >= 0 THEN CAST(embedding[1] AS DOUBLE) END AS one,
  CASE WHEN embedding[2] >= 0 THEN CAST(embedding[2] AS DOUBLE) END AS two FROM embeddings),
ca AS (SELECT 'case_' || s_suppkey || '.xlsx' AS file_id, s_acctbal + CAST(s_suppkey % 8 + 1 AS DOUBLE) AS diff FROM supplier WHERE s_suppkey % 9 <> 0),
al AS (SELECT fl.run_id, fl.file_id, fl.subsystem, action AS flagged_action, peak AS peak_current_ma, dur AS duration_s,
  CASE WHEN subsystem = 'door' AND action IS NULL AND step > 0 THEN step END AS sample_interval_s, diff AS first_car_difference,
  one AS side_1_rms, two AS side_2_rms, rms AS stress_rms,
  CASE WHEN subsystem = 'door' AND action IS NOT NULL THEN 'Flagged movement ' || action || ': peak motor current about # mA over about # s.'
    WHEN subsystem = 'door' AND step > 0 THEN 'Median sampling interval: about # s.'
    WHEN subsystem = 'acv' AND diff IS NOT NULL THEN 'Median cabin temperature minus target: about # raw temperature units.'
    WHEN subsystem = 'rail' AND ((one IS NOT NULL AND predicted_class <> 'Side II') OR (two IS NOT NULL AND predicted_class <> 'Side I'))
      THEN 'Typical vibration (median RMS): ' || concat_ws(', ', CASE WHEN one IS NOT NULL AND predicted_class <> 'Side II' THEN 'Side I about #' END,
        CASE WHEN two IS NOT NULL AND predicted_class <> 'Side I' THEN 'Side II about #' END) || ' m/s².'
    WHEN subsystem = 'shm' AND rms IS NOT NULL THEN 'Stress level (RMS): about # raw stress units.' END AS wording
  FROM fl LEFT JOIN d USING (file_id) LEFT JOIN st USING (file_id) LEFT JOIN ra USING (file_id) LEFT JOIN ca USING (file_id)
  LEFT JOIN (SELECT file_id, rms FROM e) AS sh USING (file_id))
SELECT run_id, file_id, subsystem, flagged_action, round(peak_current_ma, 4) AS peak_current_ma, round(duration_s, 4) AS duration_s,
  round(sample_interval_s, 4) AS sample_interval_s, round(first_car_difference, 4) AS first_car_difference, round(side_1_rms, 4) AS side_1_rms,
  round(side_2_rms, 4) AS side_2_rms, round(stress_rms, 4) AS stress_rms, wording FROM al WHERE wording IS NOT NULL"""),
    "cautions": (cautions, f"""WITH {PRED}
SELECT file_id, 'Check input limits: ' || CASE subsystem WHEN 'door' THEN 'the true movement count is unknown' ELSE 'the estimate is outside the training range' END
  || '. Review the analysis notes before using this result.' AS caution
FROM fl WHERE (subsystem = 'door' AND prediction_rows = 1) OR (subsystem = 'shm' AND coalesce(damage, 9) > 3)"""),
    "default_basket": (default_basket, f"""WITH {PRED}, r AS (SELECT subsystem, max(run_id) AS run_id FROM pr WHERE subsystem <> 'acv' GROUP BY subsystem)
SELECT subsystem, run_id, count(DISTINCT file_id) AS files FROM pr JOIN r USING (subsystem, run_id) GROUP BY ALL"""),
    "action_targets": (action_targets, f"""WITH {PRED}
SELECT file_id, 'action-' || (coalesce(min(row_no) FILTER (prediction = 'Abnormal resistance'), 0) + 1) AS target,
  count(*) FILTER (prediction = 'Abnormal resistance') AS flagged FROM pr WHERE subsystem = 'door' GROUP BY file_id"""),
    "car_targets": (car_targets, f"""WITH {PRED}, c AS (SELECT file_id, unnest(string_split(ranked_cars, '|')) AS id, generate_subscripts(string_split(ranked_cars, '|'), 1) AS p
  FROM pr WHERE subsystem = 'acv'), u AS (SELECT *, contains(file_id, substr(id, 2, 1) || '.xlsx') AS gone FROM c)
SELECT file_id, 'car-' || id AS target, CAST(CASE WHEN NOT gone THEN p END AS INT) AS rank,
  CASE WHEN gone THEN 'unknown' WHEN p = 1 THEN 'priority' ELSE 'ranked' END AS tone FROM u"""),
    "healthy_share": (healthy_share, f"""WITH h AS ({fleet.TREND}) SELECT ts, round(100.0 * healthy / (healthy + unknown + warning + critical), 4) AS healthy_pct
FROM h WHERE unknown < healthy + unknown + warning + critical"""),
    "searched_trains": (searched_trains, f"{fleet.FULL} SELECT train_id, status, risk FROM train WHERE contains(lower(train_id || ' ' || status), 'u1') AND status = 'unknown'"),
}

"""Waveform, duplicate, stress-series and metric queries with their SQL twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from telltale.operators import cycles, dedupe, metrics, validate
from telltale.operators import waveform as wf
from telltale.sources import tables

COPIES = (1.0, 1.0009, 1.0018)


def channels(spark, sf_dir):
    return wf.channel_statistics(tables.waveforms(spark, sf_dir))


def channel_statistics(spark, sf_dir):
    return channels(spark, sf_dir).select("vec_id", "position", "side", *[F.round(c, 6).alias(c) for c in wf.STATISTICS])


def channel_spectrum(spark, sf_dir):
    out = wf.spectrum(tables.waveforms(spark, sf_dir))
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in wf.SPECTRAL])


def side_summary(spark, sf_dir):
    out = wf.side_summary(channels(spark, sf_dir))
    return out.select("file_id", "side", "kind", "metric", F.round("median", 6).alias("median"), F.round("max", 6).alias("max"))


def side_contrast(spark, sf_dir):
    out = wf.side_contrast(wf.side_summary(channels(spark, sf_dir)))
    return out.select("file_id", "kind", "metric", F.round("contrast", 6).alias("contrast"))


def largest_channel(spark, sf_dir):
    return wf.largest_channel(channels(spark, sf_dir)).select("file_id", "side", "kind", "position", F.round("rms", 6).alias("rms"))


def pulse_speed(spark, sf_dir):
    rows = tables.waveforms(spark, sf_dir).withColumn(
        "pulse", F.transform("samples", lambda x: F.when(x > 0, 1.0).otherwise(0.0)))
    return wf.pulse_speed(rows).select(
        "vec_id", "rising_edges", F.round("speed_m_s", 6).alias("speed_m_s"), F.round("pulse_duty", 6).alias("pulse_duty"))


def near_copies(spark, sf_dir):
    """Every waveform with two near copies and one exact one."""
    base = tables.waveforms(spark, sf_dir).select("vec_id", "samples", "label")
    factors = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(i).alias("c")) for i, f in enumerate((*COPIES, 1.0))])
    rows = base.withColumn("_k", F.explode(factors)).select(
        F.format_string("%06d_%d", F.col("vec_id"), F.col("_k.c")).alias("filename"), "label",
        F.transform("samples", lambda x: (x * F.col("_k.f")).cast("float").cast("double")).alias("samples"))
    return wf.sketch_columns(rows)


def near_duplicate_groups(spark, sf_dir):
    return dedupe.duplicate_groups(near_copies(spark, sf_dir))


def stress_statistics(spark, sf_dir):
    out = cycles.series_statistics(tables.stress_series(spark, sf_dir))
    cols = [c for c in out.columns if c not in ("file_id", "samples", "kurtosis")]
    return out.select("file_id", "samples", *[F.round(c, 6).alias(c) for c in cols],
                      F.when(F.col("samples") > 1, F.round("kurtosis", 4)).alias("kurtosis"))


def turning_points(spark, sf_dir):
    return cycles.turning_points(tables.stress_series(spark, sf_dir)).select("file_id", "ord", "value")


def rainflow_cycles(spark, sf_dir):
    out = cycles.rainflow_cycles(tables.stress_series(spark, sf_dir))
    return out.groupBy("file_id").agg(F.round(F.sum("count"), 1).alias("cycles"), F.round(F.max("range"), 6).alias("max_range"),
                                      F.round(F.sum(F.col("count") * F.col("range")), 3).alias("weighted_range"))


def stress_features(spark, sf_dir):
    return cycles.stress_features(tables.stress_series(spark, sf_dir))


def rated_documents(spark, sf_dir):
    """Labels joined exactly to documents, with a rule's class for each."""
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = tables.table(spark, sf_dir, "labels")
    return labels.join(docs, "doc_id").withColumn("found", (F.col("n_chars") > 800).cast("int"))


def label_metrics(spark, sf_dir):
    rows = rated_documents(spark, sf_dir)
    parts = metrics.binary_metrics(rows, "quality", F.col("found") == 1, ["lang"])
    auc = metrics.roc_auc(rows, "quality", "n_chars", ["lang"])
    return parts.join(auc, "lang").select(
        "lang", "n", "positives", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "auc")], "false_positives")


def overall_auc(spark, sf_dir):
    rows = rated_documents(spark, sf_dir)
    return metrics.roc_auc(rows, "quality", "n_chars").select(F.round("auc", 6).alias("auc"))


def grades(spark, sf_dir):
    """Three size classes of line items against a rule on their price."""
    li = tables.table(spark, sf_dir, "lineitem")
    grade = lambda c, a, b: F.when(c < a, "Normal").when(c < b, "Side I").otherwise("Side II")
    return li.select(
        grade(F.col("l_quantity"), 17, 34).alias("truth_class"), grade(F.col("l_extendedprice"), 20000, 60000).alias("found_class"),
        F.col("l_returnflag").alias("part"))


def confusion_matrix(spark, sf_dir):
    return metrics.confusion(grades(spark, sf_dir), "truth_class", "found_class", list(wf.CLASSES), ["part"])


def class_report(spark, sf_dir):
    report = metrics.class_report(metrics.confusion(grades(spark, sf_dir), "truth_class", "found_class", list(wf.CLASSES)))
    macro = metrics.macro_summary(report)
    return report.crossJoin(F.broadcast(macro)).select(
        "label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "macro_f1", "accuracy")])


def estimates(spark, sf_dir):
    """Line price against quantity times the part's list price."""
    li = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    part = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return li.join(part, "l_partkey").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("part"),
        F.col("l_extendedprice").alias("truth"), (F.col("l_quantity") * F.col("p_retailprice")).alias("estimate"))


def regression_metrics(spark, sf_dir):
    out = metrics.regression_metrics(estimates(spark, sf_dir), "truth", "estimate", ["part"])
    return out.select("part", "n", *[F.round(c, 4).alias(c) for c in ("mape", "mae", "rmse", "median_ape", "score")])


def worst_estimates(spark, sf_dir):
    out = metrics.worst_rows(estimates(spark, sf_dir), "truth", "estimate", "id")
    return out.select("id", F.round("relative_error", 6).alias("relative_error"))


def reproduction_audit(spark, sf_dir):
    """Line price stored against recomputed from the same columns, per supplier."""
    li = tables.table(spark, sf_dir, "lineitem")
    stored = li.groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("v"))
    again = li.groupBy("l_suppkey").agg((F.avg("l_extendedprice") * F.count(F.lit(1))
                                         + F.when(F.col("l_suppkey") % 10 == 3, 1.0).otherwise(0.0)).alias("v"))
    return metrics.reproduction_audit(stored, again, ["l_suppkey"], "v").select("l_suppkey", "state")


def group_folds(spark, sf_dir):
    docs = rated_documents(spark, sf_dir)
    return validate.group_folds(docs, "doc_id", 4, "quality").select("doc_id", "quality", F.col("fold").cast("int").alias("fold"))


def fold_leakage(spark, sf_dir):
    """Users whose events fall both before and after the middle of the recording."""
    e = tables.table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    mid = F.lit("2024-01-16").cast("timestamp_ntz")
    return validate.leaked_groups(e.where(F.col("ts") < mid), e.where(F.col("ts") >= mid), "user_id")


def label_coverage(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    return validate.coverage_gaps(docs, tables.table(spark, sf_dir, "labels"), "doc_id")


def unmatched_labels(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    return validate.unmatched_labels(docs, tables.table(spark, sf_dir, "labels"), "doc_id")


def conflicting_labels(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content")).join(
        tables.table(spark, sf_dir, "labels"), "doc_id")
    return dedupe.conflicting_labels(rows, "content", "quality")


def case_insensitive_names(spark, sf_dir):
    names = tables.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    return validate.duplicate_names(names, "name")


WAVE = """
w AS (SELECT vec_id // 8 AS file_id, vec_id, CAST(vec_id % 8 + 1 AS INT) AS position,
  CASE WHEN vec_id % 2 = 0 THEN 'side_i' ELSE 'side_ii' END AS side, 'vibration' AS kind, embedding, label FROM embeddings),
p AS (SELECT w.* EXCLUDE embedding, i, CAST(embedding[i] AS DOUBLE) AS x, CAST(embedding[i - 1] AS DOUBLE) AS px, len(embedding) AS n
  FROM w, range(1, 65) AS r(i) WHERE i <= len(embedding)),
m AS (SELECT vec_id, avg(x) AS mu, sqrt(avg(x * x)) AS rms, max(abs(x)) AS pk, stddev_pop(x) AS sd, quantile_cont(abs(x), 0.95) AS p95 FROM p GROUP BY vec_id),
c AS (SELECT p.file_id, p.vec_id, p.position, p.side, p.kind, any_value(rms) AS rms, ln(1 + any_value(rms)) AS log_rms,
  ln(1 + any_value(sd)) AS log_std, ln(1 + any_value(p95)) AS log_abs_p95, ln(1 + any_value(pk)) AS log_peak,
  any_value(pk / greatest(rms, 1e-12)) AS crest, avg(((x - mu) / greatest(sd, 1e-12)) ** 4) AS kurtosis,
  sqrt(avg((x - px) ** 2) FILTER (i > 1)) / any_value(greatest(sd, 1e-12)) AS diff_ratio
  FROM p JOIN m USING (vec_id) GROUP BY ALL)"""
LONG = """,
l AS (UNPIVOT (SELECT file_id, side, kind, log_rms, log_std, log_abs_p95, log_peak, crest, kurtosis, diff_ratio FROM c)
  ON log_rms, log_std, log_abs_p95, log_peak, crest, kurtosis, diff_ratio INTO NAME metric VALUE v),
s AS (SELECT file_id, side, kind, metric, median(v) AS median, max(v) AS max FROM l GROUP BY file_id, side, kind, metric)"""
SPECTRUM = f"""WITH {WAVE},
d AS (SELECT p.vec_id, i - 1 AS t, (x - mu) * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 64)) AS x FROM p JOIN m USING (vec_id)),
f AS (SELECT vec_id, k, sum(x * cos(2 * pi() * k * t / 64)) ** 2 + sum(x * sin(2 * pi() * k * t / 64)) ** 2 AS q
  FROM d, range(0, 33) AS r(k) GROUP BY vec_id, k),
g AS (SELECT vec_id, k * 10000.0::DOUBLE / 64 AS hz, CASE WHEN k IN (0, 32) THEN q ELSE 2 * q END AS q FROM f),
t AS (SELECT *, q / sum(q) OVER (PARTITION BY vec_id) AS s FROM g)
SELECT vec_id, round(sum(hz * s), 6) AS spectral_centroid_hz, round(-sum(s * ln(greatest(s, 1e-30))) / ln(33), 6) AS spectral_entropy, """ + ", ".join(
    f"round(coalesce(sum(s) FILTER (hz >= {a} AND hz < {b}), 0), 6) AS band_{a}_{min(b, 5000)}_fraction" for a, b in wf.BANDS) + " FROM t GROUP BY vec_id"

COPY = """WITH RECURSIVE f AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE), (1, 1.0009::DOUBLE), (2, 1.0018::DOUBLE), (3, 1.0::DOUBLE)) AS t(c, f)),
r AS (SELECT format('{:06d}_{:d}', vec_id, c) AS filename, list_transform(embedding, lambda x: CAST(CAST(CAST(x AS DOUBLE) * f AS FLOAT) AS DOUBLE)) AS s
  FROM embeddings, f),
q AS (SELECT filename, s, sqrt(list_dot_product(s, s)) AS nn, list_avg(s) AS g1, sqrt(list_dot_product(s, s) / len(s)) AS g2 FROM r),
e AS (SELECT a.filename AS a, b.filename AS b FROM q a JOIN q b ON a.filename <> b.filename
  AND list_distance(a.s, b.s) <= 0.001 * greatest(a.nn, b.nn, 1e-12)
  AND sqrt((a.g1 - b.g1) ** 2 + (a.g2 - b.g2) ** 2) <= 0.001 * greatest(sqrt(a.g1 ** 2 + a.g2 ** 2), sqrt(b.g1 ** 2 + b.g2 ** 2), 1e-12)),
walk AS (SELECT filename AS root, filename AS node FROM q UNION SELECT walk.root, e.b FROM walk JOIN e ON e.a = walk.node)
SELECT node AS filename, min(root) AS "group" FROM walk GROUP BY node"""

SERIES = """
sr AS (SELECT o_custkey AS file_id, o_orderdate AS ts, o_orderkey AS ord, o_totalprice AS value FROM orders),
sd AS (SELECT *, lag(value) OVER (PARTITION BY file_id ORDER BY ts, ord) AS b FROM sr)"""
RATED = """
rt AS (SELECT l.*, d.lang, d.n_chars, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS found FROM labels l JOIN documents d USING (doc_id))"""
AUC = """CASE WHEN count(*) FILTER (quality = 1) > 0 AND count(*) FILTER (quality = 0) > 0 THEN
  (sum(rk) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0::DOUBLE)
  / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)) END"""


def ranked(by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    tie = f"PARTITION BY {by}, n_chars" if by else "PARTITION BY n_chars"
    return f"SELECT *, rank() OVER ({part}ORDER BY n_chars) + (count(*) OVER ({tie}) - 1) / 2.0::DOUBLE AS rk FROM rt"


GRADES = """
gd AS (SELECT CASE WHEN l_quantity < 17 THEN 'Normal' WHEN l_quantity < 34 THEN 'Side I' ELSE 'Side II' END AS truth,
  CASE WHEN l_extendedprice < 20000 THEN 'Normal' WHEN l_extendedprice < 60000 THEN 'Side I' ELSE 'Side II' END AS found,
  l_returnflag AS part FROM lineitem),
nm AS (SELECT * FROM (VALUES ('Normal'), ('Side I'), ('Side II')) AS t(label))"""
EST = """
es AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_returnflag AS part, l_extendedprice AS truth, l_quantity * p_retailprice AS estimate
  FROM lineitem JOIN part ON l_partkey = p_partkey),
er AS (SELECT *, abs(estimate - truth) / abs(truth) AS r FROM es)"""

QUERIES = {
    "channel_statistics": (channel_statistics, f"WITH {WAVE} SELECT vec_id, position, side, " + ", ".join(
        f"round({c}, 6) AS {c}" for c in wf.STATISTICS) + " FROM c"),
    "channel_spectrum": (channel_spectrum, SPECTRUM),
    "side_summary": (side_summary, f"WITH {WAVE}{LONG} SELECT file_id, side, kind, metric, round(median, 6) AS median, round(max, 6) AS max FROM s"),
    "side_contrast": (side_contrast, f"""WITH {WAVE}{LONG}
SELECT file_id, kind, metric, round(max(median) FILTER (side = 'side_i') - max(median) FILTER (side = 'side_ii'), 6) AS contrast
FROM s WHERE metric IN ('log_rms', 'log_peak', 'kurtosis') GROUP BY ALL"""),
    "largest_channel": (largest_channel, f"""WITH {WAVE}
SELECT file_id, side, kind, arg_max(position, (rms, -position)) AS position, round(max(rms), 6) AS rms FROM c GROUP BY ALL"""),
    "pulse_speed": (pulse_speed, f"""WITH {WAVE}
SELECT vec_id, CAST(count(*) FILTER (i > 1 AND x > 0 AND px <= 0) AS INT) AS rising_edges,
  round(count(*) FILTER (i > 1 AND x > 0 AND px <= 0) / (max(n) / 10000.0::DOUBLE) / 90 * pi() * 0.85, 6) AS speed_m_s,
  round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS pulse_duty FROM p GROUP BY vec_id"""),
    "near_duplicate_groups": (near_duplicate_groups, COPY),
    "stress_statistics": (stress_statistics, f"""WITH {SERIES}
SELECT file_id, count(*) AS samples, round(sqrt(avg(value * value)), 6) AS rms, round(max(value) - min(value), 6) AS range,
  round(ln(count(*)), 6) AS log_sample_count, round(avg(value), 6) AS mean_stress, round(ln(1 + avg(abs(value))), 6) AS log_abs_mean,
  round(ln(1 + sqrt(avg(value * value))), 6) AS log_rms, round(ln(1 + stddev_pop(value)), 6) AS log_std,
  round(ln(1 + max(value) - min(value)), 6) AS log_peak_to_peak, round(ln(1 + quantile_cont(abs(value), 0.5)), 6) AS log_abs_p50,
  round(ln(1 + quantile_cont(abs(value), 0.9)), 6) AS log_abs_p90, round(ln(1 + quantile_cont(abs(value), 0.99)), 6) AS log_abs_p99,
  round(ln(1 + max(abs(value))), 6) AS log_abs_peak, round(ln(1 + coalesce(sum(abs(value - b)), 0)), 6) AS log_total_variation,
  CASE WHEN count(*) > 1 THEN round((SELECT avg(((z.value - k.mu) / greatest(k.s, 1e-12)) ** 4) FROM sr z,
    (SELECT avg(value) AS mu, stddev_pop(value) AS s FROM sr y WHERE y.file_id = sd.file_id) k WHERE z.file_id = sd.file_id), 4) END AS kurtosis
FROM sd GROUP BY file_id"""),
    "turning_points": (turning_points, f"""WITH {SERIES}, ch AS (SELECT * FROM sd WHERE b IS NULL OR b <> value),
nb AS (SELECT file_id, ord, value, lag(value) OVER w AS b, lead(value) OVER w AS a FROM ch WINDOW w AS (PARTITION BY file_id ORDER BY ts, ord))
SELECT file_id, ord, value FROM nb WHERE b IS NULL OR a IS NULL OR (value - b) * (a - value) < 0"""),
    "rainflow_cycles": (rainflow_cycles, None),
    "stress_features": (stress_features, None),
    "label_metrics": (label_metrics, f"""WITH {RATED}, k AS ({ranked('lang')})
SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS positives,
  round(CASE WHEN sum(found) > 0 THEN count(*) FILTER (quality = 1 AND found = 1) / sum(found) END, 6) AS "precision",
  round(CASE WHEN sum(quality) > 0 THEN count(*) FILTER (quality = 1 AND found = 1) / sum(quality) END, 6) AS recall,
  round(CASE WHEN sum(quality) > 0 THEN 2 * count(*) FILTER (quality = 1 AND found = 1) / (sum(found) + sum(quality)) END, 6) AS f1,
  round({AUC}, 6) AS auc, count(*) FILTER (quality = 0 AND found = 1) AS false_positives FROM k GROUP BY lang"""),
    "overall_auc": (overall_auc, f"WITH {RATED}, k AS ({ranked('')}) SELECT round({AUC}, 6) AS auc FROM k"),
    "confusion_matrix": (confusion_matrix, f"""WITH {GRADES}
SELECT p.part, a.label AS truth, b.label AS found, (SELECT count(*) FROM gd WHERE gd.part = p.part AND gd.truth = a.label AND gd.found = b.label) AS n
FROM (SELECT DISTINCT part FROM gd) p, nm a, nm b"""),
    "class_report": (class_report, f"""WITH {GRADES},
r AS (SELECT label, (SELECT count(*) FROM gd WHERE truth = label) AS support, (SELECT count(*) FROM gd WHERE found = label) AS pred,
  (SELECT count(*) FROM gd WHERE truth = label AND found = label) AS tp FROM nm),
q AS (SELECT *, CASE WHEN pred > 0 THEN tp / pred ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rc,
  CASE WHEN pred + support > 0 THEN 2 * tp / (pred + support) ELSE 0 END AS f FROM r)
SELECT label, support, round(pr, 6) AS "precision", round(rc, 6) AS recall, round(f, 6) AS f1,
  round((SELECT avg(f) FROM q), 6) AS macro_f1, round((SELECT sum(tp) / sum(support) FROM q), 6) AS accuracy FROM q"""),
    "regression_metrics": (regression_metrics, f"""WITH {EST}
SELECT part, count(*) AS n, round(avg(r), 4) AS mape, round(avg(abs(estimate - truth)), 4) AS mae,
  round(sqrt(avg((estimate - truth) ** 2)), 4) AS rmse, round(median(r), 4) AS median_ape, round(greatest(0, 1 - avg(r)), 4) AS score
FROM er GROUP BY part"""),
    "worst_estimates": (worst_estimates, f"WITH {EST} SELECT id, round(r, 6) AS relative_error FROM er ORDER BY r DESC, id LIMIT 5"),
    "reproduction_audit": (reproduction_audit, """
SELECT l_suppkey, CASE WHEN l_suppkey % 10 = 3 THEN 'different' ELSE 'equal' END AS state FROM lineitem GROUP BY l_suppkey"""),
    "group_folds": (group_folds, f"""WITH {RATED}
SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality
  ORDER BY CAST('0x' || substr(md5(doc_id || ':42'), 1, 13) AS BIGINT), doc_id) - 1) % 4 AS INT) AS fold FROM rt"""),
    "fold_leakage": (fold_leakage, """
SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-16'
INTERSECT SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-16'"""),
    "label_coverage": (label_coverage, """
SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'surplus' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""),
    "unmatched_labels": (unmatched_labels, """
WITH d AS (SELECT doc_id FROM documents)
SELECT doc_id, 'unlabelled' AS problem FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'no recording' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM d)"""),
    "conflicting_labels": (conflicting_labels, """
SELECT sha256(text) AS content, count(*) AS members FROM documents JOIN labels USING (doc_id)
GROUP BY 1 HAVING min(quality) <> max(quality)"""),
    "case_insensitive_names": (case_insensitive_names, """
SELECT lower(p_name) AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1"""),
}

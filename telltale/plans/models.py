"""Learned operators on the given tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from telltale.operators import cycles, forest, learn, metrics, peers, reference, status
from telltale.operators import waveform as wf
from telltale.operators.segments import action_matrix
from telltale.plans import cases, streams
from telltale.plans.fleet import SCORED
from telltale.session import materialize
from telltale.sources import tables

S = tables.SENSORS


def forest_scored(spark, sf_dir):
    rows, stats = reference.fit_robust(tables.telemetry(spark, sf_dir), S)
    trees, offset, _ = forest.fit_component_forests(rows, stats, S)
    # Scoring runs in Python: let all cores share a small single-file table.
    robust = tables.spread(reference.score_robust(rows, stats, S))
    return forest.score_forest(robust, stats, S, trees, offset), stats, trees


def forest_status(spark, sf_dir):
    # The scores cost a Python pass and feed several aggregates, so they are kept as a table.
    scored = materialize(forest_scored(spark, sf_dir)[0])
    return status.component_status(scored).select(
        "train_id", "component", "status", "risk", "anomaly_count", "recent_flags", F.round("strength", 6).alias("strength"))


def forest_sensitivity(spark, sf_dir):
    scored, stats, trees = forest_scored(spark, sf_dir)
    scored = materialize(scored)
    comp = status.component_status(scored).select("train_id", "component", F.col("evidence_ord").alias("ord"))
    evidence = comp.join(scored.select("train_id", "component", "ord", *S), ["train_id", "component", "ord"])
    return forest.sensitivity(evidence, stats, S, trees)


def detector_evaluation(spark, sf_dir):
    """Forest and robust baseline against the marked offsets of the monitoring period."""
    scored = materialize(forest_scored(spark, sf_dir)[0].where("not is_ref and score is not null"))
    parts = []
    for name, column, cut in (("Isolation Forest", "score", 0.0), ("Robust deviation baseline", "max_z", 3.0)):
        m = metrics.binary_metrics(scored, "injected", F.col(column) > cut).crossJoin(
            F.broadcast(metrics.roc_auc(scored, "injected", column)))
        parts.append(m.withColumn("name", F.lit(name)))
    return parts[0].unionByName(parts[1]).select(
        "name", "n", "positives", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "auc")], "false_positives")


def baseline_evaluation(spark, sf_dir):
    """The robust baseline alone, which SQL can follow."""
    rows, stats = reference.fit_robust(tables.telemetry(spark, sf_dir), S)
    scored = reference.score_robust(rows, stats, S).where("not is_ref and score is not null")
    m = metrics.binary_metrics(scored, "injected", F.col("max_z") > 3).crossJoin(
        F.broadcast(metrics.roc_auc(scored, "injected", "max_z")))
    return m.select("n", "positives", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "auc")], "false_positives")


def side_anomaly_classes(spark, sf_dir):
    """Sides of a recording against forests grown on the recordings labelled normal."""
    ch = wf.channel_statistics(tables.waveforms(spark, sf_dir)).withColumn("component", F.col("side"))
    feats = ["log_rms", "log_peak", "crest", "kurtosis", "diff_ratio"]
    sides = materialize(ch.groupBy("file_id", "component").agg(
        F.min("vec_id").alias("ord"), F.min("label").alias("label"), *[F.percentile(f, 0.5).alias(f) for f in feats]))
    normal = sides.where("label % 3 = 0")
    trees = forest.fit_forest(normal, feats, trees=128)
    offset = forest.offsets(forest.raw_scores(normal, trees, feats), 0.05)
    scored = forest.raw_scores(sides, trees, feats).join(F.broadcast(offset), "component").withColumn(
        "score", F.col("raw") - F.col("offset"))
    return forest.side_classes(scored)


def damage_table(spark, sf_dir):
    """Stress features with a damage target that follows the fifth amplitude moment."""
    feats = materialize(cycles.stress_features(tables.stress_series(spark, sf_dir)).where("cycles > 0"))
    wobble = 1 + F.pmod(F.col("file_id"), F.lit(7)) / 1000.0
    return feats.withColumn("damage", F.exp(F.col("log_rainflow_amplitude_moment_5") - 60) * wobble)


def moment_surrogate(spark, sf_dir):
    return learn.fit_moment_surrogate(damage_table(spark, sf_dir), "damage").select(
        "power", F.round("log_scale", 6).alias("log_scale"), F.round("error", 6).alias("error"))


def ridge_damage(spark, sf_dir):
    rows = damage_table(spark, sf_dir)
    feats = ["log_rms", "log_peak_to_peak", "log_rainflow_count", "log_range_max", "log_range_weighted_mean"]
    model = learn.fit_ridge(rows, feats, "damage")
    out = learn.frozen_damage(rows, model)
    return metrics.regression_metrics(out, "damage", "prediction").select(
        "n", *[F.round(c, 4).alias(c) for c in ("mape", "median_ape", "score")])


def action_classifier(spark, sf_dir):
    """Logistic classes of supplier actions against a rule on their mean price."""
    rows = materialize(action_matrix(streams.shipment_segments(spark, sf_dir), streams.CHANNELS, streams.STATES).withColumn(
        "label", (F.col("voltage_mean") > 40000).cast("int")))
    feats = ["duration_seconds", "current_mean", "voltage_rms", "voltage_max", "position_mean", "opening_fraction"]
    model = learn.fit_logistic(rows, feats, "label")
    scored = learn.frozen_score(rows, model)
    return metrics.binary_metrics(scored, "label", F.col("score") > 0).select(
        "n", "positives", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "false_positives")


def pairwise_ranking(spark, sf_dir):
    """Cars ranked by a model of differences to the labelled car.

    Where no case gives a pair to learn from, no car has a score: all are unknown and stand in the order of their ids.
    """
    ranked = materialize(peers.ranked_features(cases.features(spark, sf_dir)).join(cases.faulty_cars(spark, sf_dir), "file_id"))
    feats = ["above_peer_fraction", "above_target_fraction"]
    train = ranked.where("available").withColumn("faulty", (F.col("car") == F.col("faulty_car")).cast("int"))
    try:
        scored = learn.frozen_score(ranked, learn.fit_pairwise(train, feats))
    except learn.NoPairs:
        scored = ranked.withColumn("score", F.lit(None).cast("double"))
    scored = scored.withColumn("score", F.when(F.col("available"), F.round("score", 9)))
    placed = peers.ranked_cars(scored).join(cases.faulty_cars(spark, sf_dir), "file_id")
    return metrics.rank_decay(placed).select("file_id", "ranked_cars", "faulty_car", "true_car_rank", F.round("decay", 6).alias("decay"))


QUERIES = {
    "forest_status": (forest_status, None),
    "forest_sensitivity": (forest_sensitivity, None),
    "detector_evaluation": (detector_evaluation, None),
    "baseline_evaluation": (baseline_evaluation, f"""{SCORED},
m AS (SELECT max_z, CASE WHEN shift <> 0 THEN 1 ELSE 0 END AS y FROM scored WHERE NOT is_ref AND score IS NOT NULL),
r AS (SELECT *, rank() OVER (ORDER BY max_z) + (count(*) OVER (PARTITION BY max_z) - 1) / 2.0::DOUBLE AS rk FROM m),
s AS (SELECT count(*) AS n, count(*) FILTER (y = 1) AS p, count(*) FILTER (max_z > 3) AS f, count(*) FILTER (max_z > 3 AND y = 1) AS tp,
  sum(rk) FILTER (y = 1) AS rs FROM r)
SELECT n, p AS positives, round(CASE WHEN f > 0 THEN tp / f END, 6) AS "precision", round(CASE WHEN p > 0 THEN tp / p END, 6) AS recall,
  round(CASE WHEN p > 0 THEN 2 * tp / (f + p) END, 6) AS f1, round((rs - p * (p + 1) / 2.0::DOUBLE) / (p * (n - p)), 6) AS auc,
  f - tp AS false_positives FROM s"""),
    "side_anomaly_classes": (side_anomaly_classes, None),
    "moment_surrogate": (moment_surrogate, None),
    "ridge_damage": (ridge_damage, None),
    "action_classifier": (action_classifier, None),
    "pairwise_ranking": (pairwise_ranking, None),
}

"""Train and fleet rollups, queue order, data quality."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from telltale.operators.reference import applicable_sensors
from telltale.operators.status import GROUP, STATUS_RANK, status_name, status_rank


def fleet_status(components: DataFrame) -> DataFrame:
    """Worst component decides; the risk is withheld when that is unknown."""
    rolled = components.groupBy("train_id").agg(
        F.max(status_rank("status")).alias("_rank"), F.max("risk").alias("_risk"),
        F.count(F.lit(1)).alias("component_count"), F.sum("anomaly_count").alias("anomaly_count"),
        F.max("last_seen").alias("last_seen"))
    return rolled.select(
        "train_id", status_name(F.col("_rank")).alias("status"),
        F.when(F.col("_rank") != STATUS_RANK["unknown"], F.col("_risk")).alias("risk"),
        F.when(F.col("_rank") != STATUS_RANK["unknown"], 100 - F.col("_risk")).alias("health"),
        "component_count", "anomaly_count", "last_seen")


def train_names(df: DataFrame) -> DataFrame:
    """First name and line given for each train, in time order; defaults where none is."""
    order = F.struct("ts", "ord")
    first = {c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("train_name", "line") if c in df.columns}
    named = df.groupBy("train_id").agg(*(first.values() or [F.lit(1).alias("_")]))
    name = F.coalesce("train_name", "train_id") if "train_name" in first else F.col("train_id")
    line = F.coalesce("line", F.lit("Uploaded fleet")) if "line" in first else F.lit("Uploaded fleet")
    return named.select("train_id", name.alias("name"), line.alias("line"))


def fleet_totals(trains: DataFrame, scored: DataFrame) -> DataFrame:
    """Trains per status with zeros, readings, anomalies outside the reference, coverage."""
    counts = trains.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUS_RANK])
    facts = scored.agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(~F.col("is_ref") & (F.col("score") > 0)).alias("anomalies"),
        F.round(100 * F.count("score") / F.count(F.lit(1)), 2).alias("coverage"))
    return counts.crossJoin(F.broadcast(facts))


def data_quality(scored: DataFrame, sensors: list[str]) -> DataFrame:
    """Missing share of applicable cells, unassessed rows, repeated (train, component, time) keys."""
    cells = applicable_sensors(scored, sensors).agg(
        F.sum("rows").alias("applicable"), F.sum(F.col("rows") - F.col("present")).alias("missing"))
    rows = scored.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("score").isNull()).alias("unscored_rows"))
    repeats = scored.groupBy(*GROUP, "ts").count().agg(F.count_if(F.col("count") > 1).alias("duplicate_keys"))
    return cells.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(repeats)).select(
        "rows", "applicable", "missing",
        F.round(100 * F.col("missing") / F.greatest(F.lit(1), F.col("applicable")), 2).alias("missing_pct"),
        "unscored_rows", "duplicate_keys")


def attention_queue(components: DataFrame) -> DataFrame:
    """Warnings and criticals only, with their place: critical first, then by risk."""
    return components.where(F.col("status").isin("warning", "critical")).orderBy(
        F.when(F.col("status") == "critical", 0).otherwise(1), F.col("risk").desc_nulls_last(), *GROUP)


def healthy_share(trend: DataFrame, trains: int | None = None) -> DataFrame:
    """Share of healthy trains over time; times with no assessed train are left out."""
    total = sum((F.col(s) for s in STATUS_RANK), F.lit(0))
    return trend.where(F.col("unknown") < total).select(
        "us", (100 * F.col("healthy") / F.greatest(F.lit(1), total)).alias("healthy_pct"))


def page(df: DataFrame, order: list, number: int, size: int = 8) -> DataFrame:
    """One page of an ordered list; the number is clamped by the caller's count."""
    return df.orderBy(*order).offset(number * size).limit(size)

"""The given tables seen as the library's inputs (telemetry, streams, cases, waveforms, series)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from telltale.operators.clean import inject_offsets

# Labelled deviations laid over the plain event values, so that detectors have something to find.
OFFSETS = [("U3", "error", 400.0), ("U7", "purchase", 400.0), ("U11", "view", 130.0)]
OFFSET_START = "2024-01-19 00:00:00"
SENSORS = ["s1", "s2"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of a table of fewer files than there are cores before costly work per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def plain_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as telemetry: 20 trains, the event type as component, two sensors."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"), "ts",
        F.concat(F.lit("U"), (F.col("user_id") % 20).cast("string")).alias("train_id"),
        F.col("event_type").alias("component"),
        F.col("value").alias("s1"),
        F.get_json_object("props", "$.k").cast("double").alias("s2"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject_offsets(plain_telemetry(spark, sf_dir), "s1", OFFSETS, OFFSET_START)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user as one stream each."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"), "ts", F.col("event_id").alias("ord"),
        F.col("value").alias("reading"), "event_type")


def shipment_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items per supplier as an action stream with four channels and two state signals."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("stream_id"), F.col("l_shipdate").alias("ts"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("ord"),
        F.col("l_quantity").alias("current"), F.col("l_extendedprice").alias("voltage"),
        F.col("l_discount").alias("back_emf"), F.col("l_tax").alias("position"),
        (F.col("l_returnflag") == "R").cast("double").alias("opening"),
        (F.col("l_linestatus") == "O").cast("double").alias("closing"))


def case_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as eight-car cases: one reading per (case, day, car)."""
    li = table(spark, sf_dir, "lineitem")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    joined = (li.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
              .join(nat, F.col("s_nationkey") == F.col("n_nationkey")))
    return joined.groupBy(
        F.col("n_regionkey").cast("long").alias("file_id"), F.col("l_shipdate").alias("ts"),
        F.lpad((F.col("s_suppkey") % 8 + 1).cast("string"), 2, "0").alias("car")).agg(
        F.avg("l_quantity").alias("cabin"), F.char(F.max(F.ascii("l_returnflag"))).alias("mode")).withColumn(
        "target", F.lit(25.0))


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 64-sample channels: eight positions per recording, odd ones on Side I."""
    e = spread(table(spark, sf_dir, "embeddings"))
    position = (F.col("vec_id") % 8 + 1).cast("int")
    return e.select(
        F.floor(F.col("vec_id") / 8).cast("long").alias("file_id"), "vec_id",
        position.alias("position"),
        F.when(position % 2 == 1, "side_i").otherwise("side_ii").alias("side"),
        F.lit("vibration").alias("kind"),
        F.col("embedding").cast("array<double>").alias("samples"), "label")


def stress_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order values per customer as ordered stress series."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("file_id"), F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("value"))

"""Structured Streaming forms of segmentation, component status and staleness.

Each equals its batch twin on the same complete input, as far as the watermark has passed.
State per key is bounded: the last 24 readings, or one open session.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from telltale.operators.status import RECENT
from telltale.session import checkpoint_root

STATE = "us array<long>, ord array<long>, assessed array<int>, flag array<int>, z array<double>, last_us long, every_us long"
STATUS = "train_id string, component string, recent_valid int, persistence double, strength double, last_assessed int, last_us long, stale int"


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet", per_trigger: int | None = None) -> DataFrame:
    """A folder of parquet files as a stream; the schema is taken from what is already there."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything available into a table in the shared folder and return that table."""
    spark = stream.sparkSession
    base = f"{checkpoint_root(spark).rstrip('/')}/telltale/stream-{uuid.uuid4().hex}"
    out, log = f"{base}/out", f"{base}/log"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        def keep(batch: DataFrame, number: int) -> None:
            # Overwriting its own folder makes a repeated batch harmless.
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")
        query = writer.foreachBatch(keep).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{out}/part=*")


def live_segments(stream: DataFrame, gap_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """Actions of each stream, given out once the watermark has passed their gap.

    Readings later than the watermark are dropped. An interval equal to the gap keeps the
    action together, as in the batch form.
    """
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    cut = timed.groupBy("stream_id", F.session_window("ts", f"{gap_seconds} seconds").alias("w")).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n_rows"))
    return cut.select("stream_id", "start", "end", "n_rows")


def _merge(kept: list[tuple], rows: list[tuple]) -> list[tuple]:
    return sorted(set(kept) | set(rows))[-RECENT:]


def _watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep the last readings of one component and report its facts; on time-out report it stale."""
    old = state.get if state.exists else ([], [], [], [], [], 0, 0)
    kept = list(zip(*[list(c) for c in old[:5]])) if len(old[0]) else []
    last, every = old[5], old[6]
    stale = 0
    if state.hasTimedOut:
        stale = 1
    else:
        for pdf in batches:
            if not len(pdf):
                continue
            last = max(last, int(pdf["us"].max()))
            every = int(pdf["every_us"].iloc[0]) if pdf["every_us"].notna().any() else every
            watched = pdf[pdf["is_ref"] == 0]
            rows = [(int(u), int(o), int(a), int(f), float(z)) for u, o, a, f, z in zip(
                watched["us"], watched["ord"], watched["assessed"], watched["flag"], watched["z"].fillna(0.0))]
            kept = _merge(kept, rows)
    valid = [r for r in kept if r[2]]
    columns = [list(c) for c in zip(*kept)] if kept else [[], [], [], [], []]
    state.update((*columns, last, every))
    if every > 0 and not stale:
        state.setTimeoutTimestamp(max((last + 3 * every) // 1000, state.getCurrentWatermarkMs() + 1))
    z = pd.Series([r[4] for r in valid], dtype=float)
    yield pd.DataFrame([{
        "train_id": key[0], "component": key[1], "recent_valid": len(valid),
        "persistence": float(sum(r[3] for r in valid) / len(valid)) if valid else None,
        "strength": float(z.median()) if valid else None,
        "last_assessed": int(kept[-1][2]) if kept else 0, "last_us": last, "stale": stale}])


def live_component_facts(scored: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Facts behind a component's status after every micro-batch (update mode).

    scored: a stream with ts, ord, is_ref, score, max_z and every_us, the component's
    usual interval from training (null when it is not watched for staleness).
    """
    rows = scored.select(
        F.col("ts").cast("timestamp").alias("ts"), "train_id", "component", "ord",
        F.col("is_ref").cast("int").alias("is_ref"), F.col("score").isNotNull().cast("int").alias("assessed"),
        F.coalesce((F.col("score") > 0).cast("int"), F.lit(0)).alias("flag"), F.col("max_z").alias("z"), "every_us").withColumn(
        "us", F.unix_micros("ts")).withWatermark("ts", delay)
    return rows.groupBy("train_id", "component").applyInPandasWithState(
        _watch, STATUS, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def latest_facts(table: DataFrame) -> DataFrame:
    """The last report of every component."""
    cols = [c for c in table.columns if c not in ("train_id", "component", "batch")]
    return table.groupBy("train_id", "component").agg(F.max_by(F.struct(*cols), "batch").alias("_f")).select(
        "train_id", "component", "_f.*")

"""What rows contain and where they stand: digests of ordered groups, global places.

A long group is never one string. Its rows are cut into blocks of `fan` places, each block's digests are joined in
order and hashed again, and so on until one digest is left, so a task holds `fan` digests at most. The digest of a
group depends on its rows, their order and `fan` alone, not on partitions.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from telltale.functions.columns import micros
from telltale.functions.ordered import DAY, position_chunk, scan, time_chunk
from telltale.session import materialize

FAN = 4096
RESOLUTION = 1e-6  # two readings that round to the same multiple count as equal


def fixed_text(value: str | Column, resolution: float = RESOLUTION) -> Column:
    """A number as the nearest whole multiple of the resolution; empty if null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.round(value * F.lit(1 / resolution)).cast("long").cast("string"), F.lit(""))


def content_digest(rows: DataFrame, keys: list[str], order: list[str], text: Column, chunk: Column, fan: int = FAN) -> DataFrame:
    """Keys, n_rows, digest: one sha256 over each group's texts in the given total order.

    `chunk` cuts a group into spans of its order, as in `scan`. A block of one digest passes up unchanged; the number of
    rows is part of the last hash. A null text counts as empty. Null keys are a group; an empty table gives no row.
    """
    own = rows.select(*keys, *order, F.sha2(F.coalesce(text, F.lit("")), 256).alias("_d"), chunk.alias("_span"))
    placed = scan(own, keys, order, F.col("_span"), position="_at")
    nodes, size = placed.select(*keys, (F.col("_at") - 1).alias("_at"), "_d", F.lit(1).cast("long").alias("_n")), None
    while size is None or size > 1:
        inside = F.array_sort(F.collect_list(F.struct("_at", "_d")))
        nodes = materialize(nodes.groupBy(*keys, position_chunk("_at", fan).alias("_block")).agg(
            inside.alias("_in"), F.sum("_n").alias("_n")).select(
            *keys, F.col("_block").alias("_at"), "_n",
            F.when(F.size("_in") == 1, F.col("_in")[0]["_d"]).otherwise(
                F.sha2(F.array_join(F.transform("_in", lambda x: x["_d"]), ""), 256)).alias("_d")))
        size = (nodes.agg(F.max("_at")).first()[0] or 0) + 1
    return nodes.select(*keys, F.col("_n").alias("n_rows"),
                        F.sha2(F.concat(F.col("_n").cast("string"), F.lit(":"), F.col("_d")), 256).alias("digest"))


def segment_digests(segmented: DataFrame, channels: list[str], resolution: float = RESOLUTION, chunk_seconds: int = DAY,
                    fan: int = FAN) -> DataFrame:
    """One digest per action over its readings alone: neither times nor names take part, so equal waveforms agree."""
    text = F.concat_ws("|", *[fixed_text(c, resolution) for c in channels])
    return content_digest(segmented, ["stream_id", "segment"], ["ts", "ord"], text, time_chunk("ts", chunk_seconds), fan)


def case_digests(readings: DataFrame, numbers: list[str], names: list[str], resolution: float = RESOLUTION,
                 chunk_seconds: int = 30 * DAY, fan: int = FAN) -> DataFrame:
    """One digest per case over times, cars and the chosen columns, whatever the order, case and place of its columns."""
    cells = {c: fixed_text(c, resolution) for c in numbers} | {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names}
    cells |= {"car": F.coalesce(F.col("car").cast("string"), F.lit("")), "ts": F.coalesce(micros("ts").cast("string"), F.lit(""))}
    text = F.concat_ws("|", *[F.concat(F.lit(f"{c.casefold()}="), cells[c]) for c in sorted(cells, key=str.casefold)])
    return content_digest(readings, ["file_id"], ["ts", "car"], text, time_chunk("ts", chunk_seconds), fan)


def repeated_content(digests: DataFrame, identity: Column) -> DataFrame:
    """Digests that several groups have: digest, n_rows, members and the smallest identity among them."""
    return digests.groupBy("digest", "n_rows").agg(F.count(F.lit(1)).alias("members"), F.min(identity).alias("first")).where("members > 1")


def global_places(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Add each row's place, from 1, in one order over the whole table.

    Rows are dealt to ranges of the order and sorted inside them; only the number of rows of each range is summed
    across. Name enough columns to make the order total, which also lets a crowded time be split. Nulls come first;
    rows that agree in every named column take consecutive places. An empty table gives no row.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(sorted_rows.withColumns({"_range": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")).select(
        "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return placed.join(starts, "_range").select(*df.columns, (F.col("_id") + F.col("_shift")).alias(name))

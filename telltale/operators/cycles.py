"""Rainflow cycles and stress features of ordered series of any length."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from telltale.functions.ordered import DAY, position_chunk, scan, time_chunk
from telltale.functions.quantiles import grouped_quantiles, select_by_weight
from telltale.session import materialize

FILE = ["file_id"]
# Exponents of the amplitude moments.
MOMENT_POWERS = (2, 3, 4, 5, 6, 7, 8)
CHUNK_POINTS = 500_000
WHOLE_POINTS = 100_000  # series up to this length are read in one window each
WHOLE = "whole"


def _chunk(series: DataFrame, chunk: Column | str | None) -> Column | str:
    """The chunk given; without one `WHOLE` if no series has more than `WHOLE_POINTS` points, spans of 90 days otherwise."""
    if chunk is not None:
        return chunk
    longest = series.groupBy(*FILE).count().agg(F.max("count")).first()[0] or 0
    return WHOLE if longest <= WHOLE_POINTS else time_chunk("ts", 90 * DAY)


def _scan(df: DataFrame, chunk: Column | str, **columns) -> DataFrame:
    return scan(df, FILE, ["ts", "ord"], None if chunk is WHOLE else chunk, **columns)


def turning_points(series: DataFrame, chunk: Column | str | None = None) -> DataFrame:
    """First, last and every point where the direction turns; repeats of a value are skipped."""
    chunk = _chunk(series, chunk)
    step = _scan(series, chunk, lag={"_before": F.col("value")})
    changed = step.where(F.col("_before").isNull() | (F.col("_before") != F.col("value"))).drop("_before")
    ends = _scan(changed, chunk, lag={"_b": F.col("value")}, lead={"_a": F.col("value")})
    turn = (F.col("value") - F.col("_b")) * (F.col("_a") - F.col("value")) < 0
    return ends.where(F.col("_b").isNull() | F.col("_a").isNull() | turn).select(*FILE, "ts", "ord", "value")


def _reduce(points: list[float], closed: list[tuple[float, float, float]]) -> list[float]:
    """Take out every small swing that lies inside its two neighbours; return what is left."""
    stack: list[float] = []
    for point in points:
        stack.append(point)
        while len(stack) >= 4:
            outer, inner, last = (abs(stack[-k] - stack[-k - 1]) for k in (3, 2, 1))
            if not (inner < outer and inner <= last):
                break
            closed.append((inner, (stack[-2] + stack[-3]) / 2, 1.0))
            del stack[-3:-1]
    return stack


def _halves(points: list[float], out: list[tuple[float, float, float]]) -> None:
    """Count the rest from its start: a swing not smaller than the one before closes it by half."""
    start, end = 0, 0
    rest: list[float] = []
    for point in points:
        rest.append(point)
        end += 1
        while end - start >= 3:
            earlier, latest = abs(rest[-2] - rest[-3]), abs(rest[-1] - rest[-2])
            if latest < earlier:
                break
            swing = (earlier, (rest[-2] + rest[-3]) / 2)
            if end - start == 3:
                out.append((*swing, 0.5))
                start += 1
            else:
                out.append((*swing, 1.0))
                del rest[-3:-1]
                end -= 2
    for a, b in zip(rest[start:], rest[start + 1:]):
        out.append((abs(b - a), (a + b) / 2, 0.5))


PART = "closed array<struct<range: double, mean: double, count: double>>, rest array<double>"
CYCLES = "array<struct<range: double, mean: double, count: double>>"


def _close_inner(points: pd.Series) -> pd.DataFrame:
    out = []
    for values in points:
        closed: list[tuple[float, float, float]] = []
        rest = _reduce(values.tolist(), closed)
        out.append(([dict(zip(("range", "mean", "count"), c)) for c in closed], rest))
    return pd.DataFrame(out, columns=["closed", "rest"])


def _count_rest(points: pd.Series) -> pd.Series:
    out = []
    for values in points:
        counted: list[tuple[float, float, float]] = []
        _halves(values.tolist(), counted)
        out.append([dict(zip(("range", "mean", "count"), c)) for c in counted])
    return pd.Series(out)


def _gathered(rest: DataFrame, *keys: str) -> DataFrame:
    """Points of a group in order, as one array of at most a chunk's length.

    The number of partitions is given, as the Python step after it costs more than its bytes show.
    """
    width = rest.sparkSession.sparkContext.defaultParallelism
    return rest.repartition(max(width, int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys).groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda p: p["value"]).alias("points"))


def rainflow_cycles(series: DataFrame, chunk: Column | str | None = None, chunk_points: int = CHUNK_POINTS) -> DataFrame:
    """file_id, range, mean, count (1 or ½) of every counted cycle; positive ranges only.

    Swings that lie inside their neighbours are closed chunk by chunk, in any order, with
    the same result as one pass. What remains of each chunk is short; it is put together
    in order and counted once per file.
    """
    chunk = _chunk(series, chunk)
    points = _scan(turning_points(series, chunk), chunk, position="_pos")
    points = materialize(points.select(
        F.col("file_id").cast("long").alias("file_id"), position_chunk(F.col("_pos") - 1, chunk_points).alias("chunk"),
        F.col("_pos").alias("seq"), "value"))
    longest = points.agg(F.max("seq")).first()[0] or 0
    closed = None
    rest = points
    close_inner, count_rest = F.pandas_udf(_close_inner, PART), F.pandas_udf(_count_rest, CYCLES)
    while True:
        part = materialize(_gathered(rest, "file_id", "chunk").select(
            "file_id", "chunk", close_inner("points").alias("_p")).select("file_id", "chunk", "_p.*"))
        done = part.select("file_id", F.explode("closed").alias("_c")).select("file_id", "_c.*")
        closed = done if closed is None else closed.unionByName(done)
        before = longest
        sizes = part.groupBy("file_id").agg(F.sum(F.size("rest")).alias("k"))
        longest = sizes.agg(F.max("k")).first()[0] or 0
        # Sixteen neighbours go together next; stop when nothing shrinks any more.
        left = part.select("file_id", "chunk", F.posexplode("rest").alias("_i", "value"))
        rest = left.select(
            "file_id", F.floor(F.col("chunk") / 16).cast("long").alias("chunk"),
            (F.col("chunk") % 16 * F.lit(10**9) + F.col("_i")).alias("seq"), "value")
        if longest <= chunk_points or longest >= before:
            break
    ordered = rest.withColumn("seq", F.struct("chunk", "seq"))
    counted = _gathered(ordered, "file_id").select("file_id", F.explode(count_rest("points")).alias("_c")).select(
        "file_id", "_c.*")
    cycles = counted if closed is None else counted.unionByName(closed)
    return cycles.where("range > 0")


def series_statistics(series: DataFrame, chunk: Column | str | None = None) -> DataFrame:
    """Eleven amplitude features and the total variation of every series."""
    chunk = _chunk(series, chunk)
    v = F.col("value")
    step = _scan(series, chunk, lag={"_before": v})
    basic = step.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("samples"), F.avg(v).alias("mean_stress"), F.avg(F.abs(v)).alias("_am"),
        F.sqrt(F.avg(v * v)).alias("rms"), F.stddev_pop(v).alias("_sd"), (F.max(v) - F.min(v)).alias("range"),
        F.max(F.abs(v)).alias("_peak"), F.kurtosis(v).alias("_k"),
        F.sum(F.abs(v - F.col("_before"))).alias("_tv"))
    spread = grouped_quantiles(series, FILE, F.abs(v), {"_p50": 0.5, "_p90": 0.9, "_p99": 0.99}).drop("n")
    return basic.join(spread, FILE).select(
        *FILE, "samples", "rms", "range", F.log(F.col("samples").cast("double")).alias("log_sample_count"), "mean_stress",
        F.log1p("_am").alias("log_abs_mean"), F.log1p("rms").alias("log_rms"), F.log1p("_sd").alias("log_std"),
        F.log1p("range").alias("log_peak_to_peak"), F.log1p("_p50").alias("log_abs_p50"),
        F.log1p("_p90").alias("log_abs_p90"), F.log1p("_p99").alias("log_abs_p99"), F.log1p("_peak").alias("log_abs_peak"),
        F.when(F.col("_sd") > 1e-12, F.col("_k") + 3).otherwise(F.lit(0.0)).alias("kurtosis"),
        F.log1p(F.coalesce("_tv", F.lit(0.0))).alias("log_total_variation"))


def cycle_features(cycles: DataFrame) -> DataFrame:
    """Counts, weighted means, log amplitude moments and count-weighted range quantiles.

    Amplitudes are scaled by the file's largest before the powers, so no moment overflows.
    """
    peak = cycles.groupBy(*FILE).agg(F.max("range").alias("_max"))
    rows = cycles.join(peak, FILE).withColumn("_rel", F.col("range") / F.col("_max"))
    c = F.col("count")
    sums = rows.groupBy(*FILE, "_max").agg(
        F.sum(c).alias("cycles"), (F.sum(c * F.col("range")) / F.sum(c)).alias("_wr"),
        (F.sum(c * F.abs("mean")) / F.sum(c)).alias("_wm"),
        *[F.sum(c * F.pow("_rel", F.lit(p))).alias(f"_m{p}") for p in MOMENT_POWERS])
    quant = select_by_weight(cycles, FILE, "range", {
        "_q50": F.col("total") * 0.5, "_q90": F.col("total") * 0.9, "_q99": F.col("total") * 0.99}, "count").drop("n", "total")
    return sums.join(quant, FILE).select(
        *FILE, "cycles", F.col("_max").alias("maximum_cycle_range"), F.log1p("cycles").alias("log_rainflow_count"),
        F.log1p("_wr").alias("log_range_weighted_mean"), F.log1p("_max").alias("log_range_max"),
        F.log1p("_wm").alias("log_cycle_abs_mean_stress"),
        *[(F.log(F.col(f"_m{p}")) + p * F.log(F.col("_max") / 2)).alias(f"log_rainflow_amplitude_moment_{p}")
          for p in MOMENT_POWERS],
        *[F.log1p(f"_q{q}").alias(f"log_range_q{q}") for q in (50, 90, 99)])


def stress_features(series: DataFrame, chunk: Column | str | None = None) -> DataFrame:
    """All stress features per series; a series without cycles has counts and ranges of 0."""
    chunk = _chunk(series, chunk)
    cycles = materialize(rainflow_cycles(series, chunk))
    joined = series_statistics(series, chunk).join(cycle_features(cycles), FILE, "left")
    moments = [f"log_rainflow_amplitude_moment_{p}" for p in MOMENT_POWERS]
    zero = ["cycles", "maximum_cycle_range", "log_rainflow_count", "log_range_weighted_mean", "log_range_max",
            "log_cycle_abs_mean_stress", "log_range_q50", "log_range_q90", "log_range_q99"]
    filled = joined.fillna(0.0, zero).withColumns({m: F.coalesce(m, F.log(F.lit(1e-30))) for m in moments})
    return filled.withColumn("rainflow_cycles_per_sample", F.col("cycles") / F.col("samples"))

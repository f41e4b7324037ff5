"""Bounded previews of long traces, runs of measured readings, nearest readings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from telltale.functions.columns import linspace_index, micros
from telltale.functions.ordered import DAY, block_of, islands, position_chunk, scan, time_chunk

POSITION_CHUNK = 1_000_000


def numbered(df: DataFrame, keys: list[str], order: list[str], chunk: Column, *, gap: Column | None = None,
             valid: Column | None = None) -> DataFrame:
    """0-based position, stream length and running counts of missing readings and gaps."""
    total = {"_missing": (~valid).cast("long") if valid is not None else F.lit(0).cast("long"),
             "_gaps": gap.cast("long") if gap is not None else F.lit(0).cast("long")}
    rows = scan(df, keys, order, chunk, total=total, position="_row")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(n, keys).withColumn("i", F.col("_row") - 1).drop("_row")


def sampled_points(df: DataFrame, keys: list[str], order: list[str], chunk: Column, x: Column, y: Column,
                   gap: Column, max_points: int = 400) -> DataFrame:
    """Evenly spaced readings, with a null marker where the line must break.

    A marker sits at the x of the next kept reading when a missing reading or a gap lies
    between two kept ones. Only the kept rows (at most max_points per stream) are
    compared with each other.
    """
    valid = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    rows = numbered(df.withColumns({"x": x, "y": y, "_good": valid, "_break": gap}), keys, order, chunk,
                    gap=F.coalesce("_break", F.lit(False)), valid=F.col("_good"))
    k = F.least(F.lit(min(max_points, 400)).cast("long"), F.col("n"))
    # Position i is kept when it is the target of some j; j near i·(k−1)/(n−1) suffices.
    guess = F.floor(F.col("i") * (k - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    hits = [linspace_index(j, F.col("n"), k) == F.col("i") for j in (guess - 1, guess, guess + 1)]
    inside = [(j >= 0) & (j < k) for j in (guess - 1, guess, guess + 1)]
    keep = (hits[0] & inside[0]) | (hits[1] & inside[1]) | (hits[2] & inside[2])
    kept = rows.where(keep & F.col("x").isNotNull())
    w = Window.partitionBy(*keys).orderBy("i")
    joined = kept.withColumns({
        "_pg": F.lag("_good").over(w), "_pm": F.lag("_missing").over(w), "_pb": F.lag("_gaps").over(w)})
    broken = F.col("_pg") & F.col("_good") & ((F.col("_missing") > F.col("_pm")) | (F.col("_gaps") > F.col("_pb")))
    point = F.struct(F.lit(1).alias("part"), F.when(F.col("_good"), F.col("y")).alias("y"))
    marker = F.struct(F.lit(0).alias("part"), F.lit(None).cast("double").alias("y"))
    return joined.withColumn("_p", F.explode(F.when(F.coalesce(broken, F.lit(False)), F.array(marker, point)).otherwise(
        F.array(point)))).select(*keys, "i", F.col("_p.part").alias("part"), "x", F.col("_p.y").alias("y"))


def envelope(df: DataFrame, keys: list[str], order: list[str], chunk: Column, y: str, blocks: int = 200) -> DataFrame:
    """First lowest and first highest reading of every near-equal block."""
    rows = numbered(df, keys, order, chunk)
    rows = rows.withColumn("block", block_of(F.col("i"), F.col("n"), F.least(F.lit(blocks).cast("long"), F.col("n"))))
    low = F.min(F.struct(F.col(y).alias("y"), F.col("i"))).alias("_low")
    high = F.max(F.struct(F.col(y).alias("y"), (-F.col("i")).alias("i"))).alias("_high")
    ends = rows.groupBy(*keys, "block").agg(low, high)
    return ends.withColumn("_p", F.explode(F.array_distinct(F.array(
        F.struct(F.col("_low.i").alias("i"), F.col("_low.y").alias("y")),
        F.struct((-F.col("_high.i")).alias("i"), F.col("_high.y").alias("y")))))).select(
        *keys, "block", F.col("_p.i").alias("i"), F.col("_p.y").alias("y"))


def bucket_sample(df: DataFrame, keys: list[str], order: list[str], chunk: Column, y: str, limit: int) -> DataFrame:
    """First, last, lowest and highest measured reading of every bucket; all when few enough."""
    rows = numbered(df, keys, order, chunk).drop("n")
    valid = rows.where(F.col(y).isNotNull())
    placed = scan(valid, keys, ["i"], position_chunk("i", POSITION_CHUNK), position="_vp")
    n = valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nv"))
    placed = placed.join(n, keys).withColumn("_v", F.col("_vp") - 1)
    count = max(1, (limit - 2) // 4)
    # Bucket b covers floor(b·n/B) .. floor((b+1)·n/B) - 1.
    guess = F.floor(F.col("_v") * count / F.col("_nv"))
    bucket = F.when(F.floor((guess + 1) * F.col("_nv") / count) <= F.col("_v"), guess + 1).otherwise(guess)
    few = F.col("_nv") <= limit
    placed = placed.withColumn("_b", F.when(few, F.col("_v")).otherwise(bucket))
    ends = placed.groupBy(*keys, "_b").agg(
        F.min("i").alias("a"), F.max("i").alias("b"),
        F.min(F.struct(F.col(y).alias("y"), F.col("i")))["i"].alias("c"),
        (-F.max(F.struct(F.col(y).alias("y"), (-F.col("i")).alias("i")))["i"]).alias("d"))
    picks = ends.select(*keys, F.explode(F.array_distinct(F.array("a", "b", "c", "d"))).alias("i"))
    return rows.join(picks, [*keys, "i"]).select(*keys, "i", *order, y)


def measured_runs(df: DataFrame, keys: list[str], order: list[str], chunk: Column, y: str) -> DataFrame:
    """Maximal runs of measured readings with their end points and the bridge to the next run."""
    marked = islands(df, keys, order, chunk, {"ok": F.col(y).isNotNull()},
                     lambda before, now: before["ok"] != now["ok"], "_island")
    runs = marked.where(F.col(y).isNotNull()).groupBy(*keys, "_island").agg(
        F.count(F.lit(1)).alias("readings"), F.min("ts").alias("start"), F.max("ts").alias("end"),
        F.max_by(y, F.struct(*order)).alias("end_value"), F.min_by(y, F.struct(*order)).alias("start_value"))
    linked = scan(runs, keys, ["_island"], position_chunk("_island", POSITION_CHUNK),
                  lead={"next_start": F.col("start"), "next_value": F.col("start_value")}, position="run")
    return linked.drop("_island")


def trace_statistics(df: DataFrame, keys: list[str], y: str) -> DataFrame:
    """Minimum, maximum, mean and missing count. The mean divides first, so it cannot overflow."""
    n = df.groupBy(*keys).agg(F.count(y).alias("_n"))
    return df.join(n, keys).groupBy(*keys).agg(
        F.min(y).alias("min"), F.max(y).alias("max"), F.sum(F.col(y) / F.col("_n")).alias("mean"),
        F.count(y).alias("readings"), F.count_if(F.col(y).isNull()).alias("missing"))


def nearest_reading(lookups: DataFrame, readings: DataFrame, keys: list[str], chunk_seconds: int = DAY) -> DataFrame:
    """The reading nearest in time to each lookup; a tie goes to the earlier one.

    Both sides are merged into one ordered stream and the neighbours are carried forward
    and backward: an as-of join without pairs.
    """
    left = lookups.select(*keys, "ts", "ord", F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_r"))
    right = readings.select(*keys, "ts", "ord", F.lit(0).alias("_side"), F.col("ord").alias("_r"))
    here = F.when(F.col("_side") == 0, F.struct(micros("ts").alias("us"), F.col("_r")))
    order = ["ts", "_side", "ord"]
    merged = scan(left.unionByName(right), keys, order, time_chunk("ts", chunk_seconds),
                  fill={"_back": here}, fill_next={"_ahead": here})
    us = micros("ts")
    early, late = us - F.col("_back.us"), F.col("_ahead.us") - us
    use_back = F.col("_ahead").isNull() | (F.col("_back").isNotNull() & (early <= late))
    return merged.where("_side = 1").select(
        *keys, "ts", "ord", F.when(use_back, F.col("_back._r")).otherwise(F.col("_ahead._r")).alias("nearest"),
        (F.when(use_back, early).otherwise(late) / 1e6).alias("distance"))

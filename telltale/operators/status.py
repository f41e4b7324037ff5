"""Condition of a component from its most recent readings, freshness and evidence."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from telltale.functions.columns import linspace_index, micros, order_key
from telltale.functions.ordered import scan, time_chunk
from telltale.functions.quantiles import select_by_weight
from telltale.session import materialize

GROUP = ["train_id", "component"]
RECENT = 24
STATUS_RANK = {"healthy": 0, "unknown": 1, "warning": 2, "critical": 3}


def status_rank(status: str | Column) -> Column:
    status = F.col(status) if isinstance(status, str) else status
    return F.coalesce(*[F.when(status == name, F.lit(rank)) for name, rank in STATUS_RANK.items()])


def status_name(rank: Column) -> Column:
    return F.coalesce(*[F.when(rank == value, F.lit(name)) for name, value in STATUS_RANK.items()])


def status_ladder(valid: Column, persistence: Column, strength: Column) -> tuple[Column, Column]:
    """(status, risk) from the count of assessed readings, their flag share and median deviation."""
    indicator = F.least(F.lit(99), F.greatest(F.lit(0), F.bround(
        8 + 34 * persistence + 6 * F.greatest(F.lit(0.0), strength - 1.5)).cast("int")))
    critical = (persistence >= 0.5) & (strength >= 6)
    warning = ((persistence >= 0.25) & (strength >= 2.5)) | (persistence >= 0.65)
    status = F.when(F.coalesce(valid, F.lit(0)) < 4, "unknown").when(critical, "critical").when(
        warning, "warning").otherwise("healthy")
    risk = (F.when(status == "critical", F.greatest(F.lit(75), indicator))
            .when(status == "warning", F.least(F.lit(74), F.greatest(F.lit(40), indicator)))
            .when(status == "healthy", F.least(F.lit(39), indicator)))
    return status, risk


def last_rows(df: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The latest rows per group. The limit is applied in every map task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col("ts").desc(), F.col("ord").desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= count)


def recent_evidence(scored: DataFrame, recent: int = RECENT) -> DataFrame:
    """Facts of the last monitoring rows, unscored ones included in the count of rows."""
    window = last_rows(scored.where(~F.col("is_ref")), GROUP, recent)
    assessed = F.col("score").isNotNull()
    flagged = assessed & (F.col("score") > 0)
    payload = F.struct("ts", "ord", "score", "max_z", "risk")
    rank = F.struct(F.col("score"), -micros("ts"), -F.col("ord"))
    return window.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("recent_rows"),
        F.count_if(assessed).alias("recent_valid"),
        F.count_if(flagged).alias("recent_flags"),
        F.avg(F.when(assessed, flagged.cast("double"))).alias("persistence"),
        F.percentile(F.when(assessed, F.col("max_z")), 0.5).alias("strength"),
        F.max_by(assessed, F.struct("ts", "ord")).alias("last_assessed"),
        F.max_by(payload, F.when(flagged, rank)).alias("peak"))


def intervals(df: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Gaps between the distinct observation times of each group: keys, us, dt (microseconds)."""
    times = df.select(*keys, "ts").distinct()
    return scan(times, keys, ["ts"], time_chunk("ts"), lag={"_prev": micros("ts")}).select(
        *keys, micros("ts").alias("us"), (micros("ts") - F.col("_prev")).alias("dt"))


def _median_below(count: Column, under: Column, low: Column, high: Column, age: Column) -> Column:
    """Is three times the median gap below the age? Decided from counts, without the median.

    `under` gaps are shorter than a third of the age, `low` is the longest of them and
    `high` the shortest of the others.
    """
    half = F.floor(count / 2)
    odd = count % 2 == 1
    split = ~odd & (under == half) & (count > 0)
    return F.when(split, 3 * (low + high) < 2 * age).otherwise(under >= F.when(odd, half + 1).otherwise(half + 1))


def stale_groups(df: DataFrame) -> DataFrame:
    """Groups whose last reading is older than three of their own median intervals.

    Needs at least four distinct times. Only conditional counts are aggregated, so the
    length of a group does not matter.
    """
    gaps = intervals(df)
    last = df.groupBy(*GROUP).agg(F.max(micros("ts")).alias("last_us"))
    end = df.agg(F.max(micros("ts")).alias("end_us"))
    age = F.col("end_us") - F.col("last_us")
    ages = last.crossJoin(F.broadcast(end)).select(*GROUP, "last_us", age.alias("age"))
    short = 3 * F.col("dt") < F.col("age")
    facts = gaps.where(F.col("dt").isNotNull()).join(ages, GROUP).groupBy(*GROUP, "age").agg(
        F.count(F.lit(1)).alias("gaps"), F.count_if(short).alias("under"),
        F.max(F.when(short, F.col("dt"))).alias("low"), F.min(F.when(~short, F.col("dt"))).alias("high"))
    stale = (F.col("gaps") >= 3) & _median_below(
        F.col("gaps"), F.col("under"), F.col("low"), F.col("high"), F.col("age"))
    return ages.join(facts.select(*GROUP, stale.alias("stale")), GROUP, "left").select(
        *GROUP, "last_us", F.coalesce("stale", F.lit(False)).alias("stale"))


def component_status(scored: DataFrame) -> DataFrame:
    """One row per (train, component): status, risk, health, anomalies, onset, evidence reading."""
    monitored = ~F.col("is_ref")
    flagged = monitored & (F.col("score") > 0)
    at = F.when(F.col("score").isNotNull(), order_key("ts", "ord"))
    groups = scored.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(flagged).alias("anomaly_count"),
        F.min(F.when(flagged, F.col("ts"))).alias("onset"),
        F.max(F.when(flagged, F.col("ts"))).alias("latest_anomaly"),
        F.max("ts").alias("last_seen"),
        *[F.max_by(c, at).alias(f"_v_{c}") for c in ("ts", "ord", "max_z")])
    facts = groups.join(recent_evidence(scored), GROUP, "left").join(
        stale_groups(scored).drop("last_us"), GROUP, "left")
    status, risk = status_ladder(F.col("recent_valid"), F.col("persistence"), F.col("strength"))
    blind = (F.coalesce("recent_valid", F.lit(0)) == 0) | ~F.coalesce("last_assessed", F.lit(False)) | F.col("stale")
    shown = facts.withColumn("status", F.when(blind, "unknown").otherwise(status)).withColumn(
        "risk", F.when(F.col("status") != "unknown", risk))
    actionable = F.col("status").isin("warning", "critical")
    last_valid = F.struct(*[F.col(f"_v_{c}").alias(c) for c in ("ts", "ord", "max_z")])
    peak = F.struct(*[F.col(f"peak.{c}").alias(c) for c in ("ts", "ord", "max_z")])
    evidence = F.when(actionable & F.col("peak").isNotNull(), peak).otherwise(last_valid)
    return shown.select(
        *GROUP, "status", "risk", (100 - F.col("risk")).alias("health"), "anomaly_count", "observations", "onset",
        "latest_anomaly", "last_seen", F.coalesce("recent_valid", F.lit(0)).alias("recent_valid"),
        F.coalesce("recent_flags", F.lit(0)).alias("recent_flags"), "persistence", "strength", "stale",
        evidence["ts"].alias("evidence_ts"), evidence["ord"].alias("evidence_ord"),
        evidence["max_z"].alias("evidence_z"))


def sparkline(scored: DataFrame, count: int = 48) -> DataFrame:
    """The last point risks of each group, oldest first, unassessed readings left out."""
    return last_rows(scored, GROUP, count).where(F.col("risk").isNotNull()).select(
        *GROUP, "ts", "ord", F.round("risk", 2).alias("risk"))


def observed_times(df: DataFrame, count: int = 24) -> DataFrame:
    """At most `count` evenly spaced distinct times of the whole table: slot, us."""
    times = df.select(micros("ts").alias("us")).distinct()
    size = F.least(F.lit(count).cast("long"), F.col("n"))
    targets = {f"t{i}": F.when(F.lit(i) < size, linspace_index(F.lit(i).cast("long"), F.col("n"), size) + 1)
               for i in range(count)}
    wide = select_by_weight(times, [], "us", {k: F.coalesce(v, F.lit(-1)) for k, v in targets.items()})
    picked = wide.select(F.explode(F.array_distinct(F.array_compact(F.array(*[
        F.when(F.lit(i) < size, F.col(f"t{i}").cast("long")) for i in range(count)])))).alias("us"))
    return materialize(picked.select(
        (F.row_number().over(Window.orderBy("us")) - 1).alias("slot"), "us"))  # at most 24 rows


def status_trend(scored: DataFrame, count: int = 24, recent: int = RECENT) -> DataFrame:
    """Trains per status at evenly spaced observed times, by the same trailing rule.

    Rows fall into the slot of the first selected time not before them. The last rows of
    every (group, slot) are enough to rebuild the trailing window at any later time, so
    at most count × recent rows per group survive the first limit.
    """
    times = observed_times(scored, count)
    edges = [r["us"] for r in times.orderBy("slot").collect()]  # at most 24 numbers
    slot = F.coalesce(*[F.when(micros("ts") <= F.lit(us), F.lit(i)) for i, us in enumerate(edges)])
    rows = scored.withColumn("slot", slot).where(F.col("slot").isNotNull())
    kept = last_rows(rows.where(~F.col("is_ref")), [*GROUP, "slot"], recent).drop("_rn")
    at = kept.withColumn("at", F.explode(F.sequence(F.col("slot"), F.lit(len(edges) - 1))))
    window = last_rows(at, [*GROUP, "at"], recent)
    assessed = F.col("score").isNotNull()
    facts = window.groupBy(*GROUP, "at").agg(
        F.count_if(assessed).alias("valid"),
        F.avg(F.when(assessed, (F.col("score") > 0).cast("double"))).alias("persistence"),
        F.percentile(F.when(assessed, F.col("max_z")), 0.5).alias("strength"),
        F.max_by(assessed, F.struct("ts", "ord")).alias("last_assessed"))
    # Freshness at each selected time: the latest reading so far and the gaps up to then.
    edge = F.element_at(F.array(*[F.lit(us) for us in edges]), F.col("at") + 1)
    slots = rows.groupBy(*GROUP, "slot").agg(F.max(micros("ts")).alias("us"))
    seen = slots.withColumn("at", F.explode(F.sequence(F.col("slot"), F.lit(len(edges) - 1)))).groupBy(
        *GROUP, "at").agg(F.max("us").alias("last_us")).withColumn("age", edge - F.col("last_us"))
    gaps = intervals(rows).where(F.col("dt").isNotNull()).withColumn("slot", F.coalesce(
        *[F.when(F.col("us") <= F.lit(us), F.lit(i)) for i, us in enumerate(edges)]))
    # Counts under a condition for every selected time at once: a gap stays one row.
    ages = seen.groupBy(*GROUP).agg(F.array(*[F.max(F.when(F.col("at") == i, F.col("age"))) for i in range(len(edges))]).alias("ages"))

    def at_time(i: int) -> Column:
        upto, age, dt = F.col("slot") <= i, F.get("ages", F.lit(i)), F.col("dt")
        short = 3 * dt < age
        return F.struct(
            F.lit(i).alias("at"), F.max(age).alias("age"), F.count_if(upto).alias("gaps"), F.count_if(upto & short).alias("under"),
            F.max(F.when(upto & short, dt)).alias("low"), F.min(F.when(upto & ~short, dt)).alias("high"))

    fresh = gaps.join(ages, [*GROUP]).groupBy(*GROUP).agg(F.array(*[at_time(i) for i in range(len(edges))]).alias("_t")).select(
        *GROUP, F.inline("_t"))
    stale = (F.col("gaps") >= 3) & _median_below(
        F.col("gaps"), F.col("under"), F.col("low"), F.col("high"), F.col("age"))
    groups = scored.select(*GROUP).distinct().crossJoin(F.broadcast(times.withColumnRenamed("slot", "at")))
    status, _ = status_ladder(F.col("valid"), F.col("persistence"), F.col("strength"))
    blind = ~F.coalesce("last_assessed", F.lit(False)) | F.coalesce("stale", F.lit(False))
    each = (groups.join(facts, [*GROUP, "at"], "left")
            .join(fresh.select(*GROUP, "at", stale.alias("stale")), [*GROUP, "at"], "left")
            .withColumn("status", F.when(blind, "unknown").otherwise(status)))
    trains = each.groupBy("train_id", "us").agg(F.max(status_rank("status")).alias("rank"))
    return trains.groupBy("us").agg(
        *[F.count_if(F.col("rank") == rank).alias(name) for name, rank in STATUS_RANK.items()])

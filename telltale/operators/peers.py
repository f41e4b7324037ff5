"""Eight-car cases: cooling evidence, peer comparison, weighted car features, ranking."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from telltale.functions.columns import array_median, micros
from telltale.functions.ordered import DAY, scan, time_chunk
from telltale.functions.quantiles import select_by_weight
from telltale.session import materialize

CAR = ["file_id", "car"]
# Running modes that count as cooling.
COOLING_MODES = ("automatic cooling", "full cooling", "half cooling")
# Control states that make a reading unusable.
INVALID_CONTROL = ("invalid", "none", "nan", "")
# Fixed value: reading of a channel that stands for "no measurement".
SENTINEL = -50
CARS_PER_CASE = 8


def cooling_mask(df: DataFrame, modes: tuple[str, ...] = COOLING_MODES) -> DataFrame:
    """Add `valid`, `mask` (usable cooling reading), `residual` and `signal`."""
    def said(name: str) -> Column:
        return F.lower(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))))

    valid = F.lit(True)
    if "information" in df.columns:
        valid = valid & (said("information") == "valid")
    if "control" in df.columns:
        valid = valid & ~said("control").isin(*INVALID_CONTROL)
    mode = said("mode")
    present = F.col("cabin").isNotNull() & F.col("target").isNotNull()
    mask = valid & mode.isin(*[m.lower() for m in modes]) & present
    return df.withColumns({
        "mode": mode, "valid": valid, "mask": mask,
        "residual": F.when(mask, F.col("cabin") - F.col("target")),
        "signal": F.when(valid, F.col("cabin"))})


def mode_warnings(df: DataFrame, modes: tuple[str, ...] = COOLING_MODES) -> DataFrame:
    """Counts per car that become warnings: unrecognised cooling text and sentinel readings."""
    mode = F.lower(F.trim("mode"))
    sentinel = F.count_if(F.col("observation") == SENTINEL) if "observation" in df.columns else F.lit(0)
    return df.groupBy(*CAR).agg(
        F.count_if(F.contains(mode, F.lit("cooling")) & ~mode.isin(*modes)).alias("unrecognised_cooling"),
        sentinel.cast("long").alias("sentinels"))


def mode_inventory(df: DataFrame) -> DataFrame:
    """Readings per running mode, per car and for the whole case (car null)."""
    return df.groupBy("file_id", "mode", "car").agg(F.count(F.lit(1)).alias("readings")).rollup(
        "file_id", "mode", "car").agg(F.sum("readings").alias("readings")).where(F.col("mode").isNotNull())


def case_clock(df: DataFrame, chunk_seconds: int = 30 * DAY) -> DataFrame:
    """Per case time: interval before, weight until the next time, modal cadence (seconds).

    The weight is the next interval unless that is longer than three cadences.
    """
    times = df.select("file_id", "ts").distinct()
    steps = scan(times, ["file_id"], ["ts"], time_chunk("ts", chunk_seconds),
                 lag={"_before": micros("ts")}, lead={"_after": micros("ts")})
    steps = steps.select("file_id", "ts", ((micros("ts") - F.col("_before")) / 1e6).alias("dt"),
                         ((F.col("_after") - micros("ts")) / 1e6).alias("next_dt"))
    counts = steps.where("dt is not null").groupBy("file_id", "dt").agg(F.count(F.lit(1)).alias("_c"))
    mode = counts.groupBy("file_id").agg(F.min_by("dt", F.struct(-F.col("_c"), F.col("dt"))).alias("cadence"))
    near = (F.col("next_dt") > 0) & (F.col("next_dt") <= 3 * F.col("cadence"))
    return steps.join(mode, "file_id").select(
        "file_id", "ts", "dt", "cadence", F.when(near, F.col("next_dt")).otherwise(F.col("cadence")).alias("weight"))


def full_grid(df: DataFrame, cars: list[str]) -> DataFrame:
    """One row per case time and car; a car without a reading has nulls."""
    clock = df.select("file_id", "ts").distinct()
    grid = clock.withColumn("car", F.explode(F.array(*[F.lit(c) for c in cars])))
    return grid.join(df, ["file_id", "ts", "car"], "left")


def peer_gap(masked: DataFrame) -> DataFrame:
    """Each usable reading against the other cars at the same time.

    The median of the peers in the same mode when there are at least two, else of any two
    or more peers. A case time holds at most eight cars, so its readings travel as one
    small array and no pairs are emitted.
    """
    usable = masked.where("mask")
    board = usable.groupBy("file_id", "ts").agg(
        F.collect_list(F.struct("car", "mode", "residual")).alias("_board"))
    row = board.select("file_id", "ts", "_board", F.explode("_board").alias("_me"))
    others = F.filter("_board", lambda x: x["car"] != F.col("_me.car"))
    alike = F.filter(others, lambda x: x["mode"] == F.col("_me.mode"))
    same = F.when(F.size(alike) >= 2, array_median(F.transform(alike, lambda x: x["residual"])))
    every = F.when(F.size(others) >= 2, array_median(F.transform(others, lambda x: x["residual"])))
    return row.select(
        "file_id", "ts", F.col("_me.car").alias("car"), same.isNotNull().alias("same_mode"),
        (F.col("_me.residual") - F.coalesce(same, every)).alias("gap"))


def warming_rate(masked: DataFrame, clock: DataFrame, chunk_seconds: int = 30 * DAY) -> DataFrame:
    """Change per minute between adjacent readings of an unchanged cooling regime."""
    rows = masked.join(clock, ["file_id", "ts"])
    kept = scan(rows, CAR, ["ts"], time_chunk("ts", chunk_seconds), lag={
        "_signal": F.col("signal"), "_mask": F.col("mask"), "_mode": F.col("mode"), "_target": F.col("target")})
    stable = (F.col("mask") & F.col("_mask") & (F.col("mode") == F.col("_mode"))
              & (F.col("target") == F.col("_target")) & (F.col("dt") <= 3 * F.col("cadence")))
    return kept.where(stable).select(
        *CAR, "ts", "weight", ((F.col("signal") - F.col("_signal")) / (F.col("dt") / 60)).alias("rate"))


def car_features(df: DataFrame, cars: list[str], modes: tuple[str, ...] = COOLING_MODES) -> DataFrame:
    """Weighted summaries per car, for all eight cars of every case."""
    grid = full_grid(df, cars)
    masked = materialize(cooling_mask(grid, modes))
    clock = materialize(case_clock(df))
    gaps = peer_gap(masked)
    weighted = clock.select("file_id", "ts", "weight")
    measures = (masked.where("mask").join(weighted, ["file_id", "ts"]).select(
        *CAR, F.lit("own").alias("measure"), F.col("residual").alias("v"), "weight")
        .unionByName(gaps.join(weighted, ["file_id", "ts"]).select(
            *CAR, F.lit("gap").alias("measure"), F.col("gap").alias("v"), "weight"))
        .unionByName(warming_rate(masked, clock).select(
            *CAR, F.lit("rate").alias("measure"), F.col("rate").alias("v"), "weight")))
    measures = measures.where(F.col("v").isNotNull())
    quant = select_by_weight(
        measures.where("measure != 'rate'"), [*CAR, "measure"], "v",
        {f"q{int(q * 100)}": F.col("total") * q for q in (0.1, 0.5, 0.9)}, "weight")
    above = measures.groupBy(*CAR, "measure").agg(
        (F.sum(F.when(F.col("v") > 0, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("above"))

    def of(measure: str, column: str) -> Column:
        return F.max(F.when(F.col("measure") == measure, F.col(column)))

    q = quant.groupBy(*CAR).agg(
        of("gap", "q50").alias("peer_median"), of("gap", "q90").alias("peer_q90"),
        of("own", "q50").alias("residual_median"), of("own", "q90").alias("residual_q90"),
        (of("own", "q90") - of("own", "q10")).alias("residual_spread"))
    f = above.groupBy(*CAR).agg(
        of("gap", "above").alias("above_peer_fraction"), of("own", "above").alias("above_target_fraction"),
        of("rate", "above").alias("warming_fraction"))
    details = masked.groupBy(*CAR).agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if("mask").alias("usable_rows"))
    peers = gaps.groupBy(*CAR).agg(
        F.count("gap").alias("peer_rows"), F.count_if("same_mode").alias("same_mode_rows"))
    return (details.join(peers, CAR, "left").join(q, CAR, "left").join(f, CAR, "left")
            .withColumn("available", F.col("usable_rows") >= 3)
            .fillna(0, ["peer_rows", "same_mode_rows"]))


RANKED = ("peer_median", "peer_q90", "residual_median", "residual_q90", "residual_spread")
FRACTIONS = ("above_peer_fraction", "above_target_fraction", "warming_fraction")


def percentile_rank(value: str, group: list[str], among: Column) -> Column:
    """Average rank over count, among the given rows only. A group is a case: eight rows."""
    shown = F.when(among, F.col(value))
    w = Window.partitionBy(*group)
    below = F.rank().over(w.orderBy(shown.asc_nulls_last()))
    ties = F.count(shown).over(Window.partitionBy(*group, shown))
    return F.when(shown.isNotNull(), (below + (ties - 1) / 2) / F.count(shown).over(w))


def ranked_features(features: DataFrame) -> DataFrame:
    """Case-relative ranks and the plain fractions; all null for cars without evidence."""
    ok = F.col("available")
    return features.select(
        *CAR, "available", "usable_rows",
        *[percentile_rank(c, ["file_id"], ok).alias(f"{c}_rank") for c in RANKED],
        *[F.when(ok, F.col(c)).alias(c) for c in FRACTIONS])


def baseline_score(ranked: DataFrame) -> DataFrame:
    """Weighted peer deviation with the own residual where peers are missing."""
    score = (0.60 * F.coalesce("peer_median_rank", "residual_median_rank")
             + 0.25 * F.coalesce("peer_q90_rank", "residual_q90_rank") + 0.15 * F.col("residual_median_rank"))
    return ranked.withColumn("score", F.when(F.col("available"), score))


def ranked_cars(scored: DataFrame) -> DataFrame:
    """One pipe-joined order per case: by score, then id; cars without a score last."""
    w = Window.partitionBy("file_id").orderBy(F.col("score").isNull(), F.col("score").desc(), "car")
    placed = scored.withColumn("place", F.row_number().over(w))
    return placed.groupBy("file_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "car"))), lambda x: x["car"]), "|")
        .alias("ranked_cars"),
        F.count("score").alias("scored_cars"))

"""Reference period, reference statistics and robust deviation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from telltale.functions.columns import micros
from telltale.functions.quantiles import grouped_median, select_by_weight
from telltale.session import materialize

REFERENCE_FRACTION = 0.40
MIN_REFERENCE_ROWS = 12
MAD_TO_SIGMA = 1.4826


def reference_cut(df: DataFrame, fraction: float = REFERENCE_FRACTION) -> DataFrame:
    """Last reference time per component: a rank among its distinct times, found by selection."""
    times = df.select("component", micros("ts").alias("_us")).distinct()
    rank = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(fraction)))
    return select_by_weight(times, ["component"], "_us", {"_cut": rank}).select(
        "component", F.col("_cut").cast("long").alias("cutoff_us"))


def with_reference(df: DataFrame, cut: DataFrame) -> DataFrame:
    """Flag reference rows. The cut table has one row per component."""
    return df.join(cut, "component").withColumn("is_ref", micros("ts") <= F.col("cutoff_us")).drop("cutoff_us")


def long_sensors(df: DataFrame, ids: list[str], sensors: list[str]) -> DataFrame:
    return df.select(*ids, *sensors).unpivot(ids, sensors, "sensor", "v").where(F.col("v").isNotNull())


def reference_statistics(rows: DataFrame, sensors: list[str]) -> DataFrame:
    """Median, spread and usable scale per (component, sensor), from reference rows alone.

    The scale is the scaled median absolute deviation, else the population deviation,
    else one percent of the median's magnitude (at least 0.001).
    """
    keys = ["component", "sensor"]
    observed = F.greatest(*[F.col(s).isNotNull() for s in sensors])
    # Four passes follow; the narrow reference rows are read and parsed once.
    ref = materialize(rows.where("is_ref").where(observed).select("component", *sensors))
    fit = ref.groupBy("component").agg(F.count(F.lit(1)).alias("fit_rows"))
    cells = long_sensors(ref, ["component"], sensors)
    middle = materialize(grouped_median(cells, keys, "v"))
    away = cells.join(middle.select(*keys, "median"), keys).withColumn("_d", F.abs(F.col("v") - F.col("median")))
    spread = grouped_median(away, keys, "_d", "mad").select(*keys, (F.col("mad") * MAD_TO_SIGMA).alias("mad"))
    std = cells.groupBy(*keys).agg(F.stddev_pop("v").alias("std"))
    floor = F.greatest(F.abs(F.col("median")) * 0.01, F.lit(0.001))
    scale = F.when(F.col("mad") > 1e-10, F.col("mad")).when(F.col("std") > 1e-10, F.col("std")).otherwise(floor)
    return materialize(
        middle.join(spread, keys).join(std, keys).join(fit, "component")
        .select(*keys, "n", "median", "mad", "std", scale.alias("scale"), "fit_rows"))


def wide_statistics(stats: DataFrame, sensors: list[str], min_rows: int = MIN_REFERENCE_ROWS) -> DataFrame:
    """One row per component that has enough reference rows."""
    usable = stats.where(F.col("fit_rows") >= min_rows)
    pick = [F.max(F.when(F.col("sensor") == s, F.col(c))).alias(f"_{c}_{s}")
            for s in sensors for c in ("median", "scale")]
    return usable.groupBy("component").agg(*pick)


def robust_z(sensor: str) -> Column:
    return F.abs(F.col(sensor) - F.col(f"_median_{sensor}")) / F.col(f"_scale_{sensor}")


def point_risk(max_z: Column, score: Column | None = None) -> Column:
    raised = F.lit(0.0) if score is None else F.greatest(F.lit(0.0), score) * 140
    return F.when(max_z.isNotNull(), F.least(F.lit(99.0), F.greatest(F.lit(0.0), 5 + max_z * 8 + raised)))


def score_robust(rows: DataFrame, stats: DataFrame, sensors: list[str], threshold: float = 3.0,
                 keep_statistics: bool = False) -> DataFrame:
    """max_z, score and risk per reading; all null where a reading cannot be assessed.

    The score is the distance above the threshold, so `score > 0` flags a reading. A
    forest replaces the score column only (see forest.score_forest).
    """
    wide = wide_statistics(stats, sensors)
    joined = rows.join(wide, "component", "left")
    z = [robust_z(s) for s in sensors]
    worst = F.greatest(*z) if len(z) > 1 else z[0]
    scored = (joined.withColumn("max_z", worst)
              .withColumn("score", F.col("max_z") - threshold)
              .withColumn("risk", point_risk(F.col("max_z"))))
    return scored if keep_statistics else scored.drop(*[c for c in wide.columns if c != "component"])


def impute_reference(rows: DataFrame, stats: DataFrame, sensors: list[str]) -> DataFrame:
    """Model inputs `x_<sensor>`: the reading, or the reference median; readings stay as they are."""
    wide = wide_statistics(stats, sensors)
    filled = rows.join(wide, "component", "left").withColumns(
        {f"x_{s}": F.coalesce(F.col(s), F.col(f"_median_{s}")) for s in sensors})
    return filled.drop(*[c for c in wide.columns if c != "component"])


def fit_robust(df: DataFrame, sensors: list[str]) -> tuple[DataFrame, DataFrame]:
    """Reference flag on every row and the fitted statistics table."""
    rows = with_reference(df, materialize(reference_cut(df)))
    return rows, reference_statistics(rows, sensors)


def applicable_sensors(rows: DataFrame, sensors: list[str], known: dict[str, str] | None = None) -> DataFrame:
    """Sensors with any value in the component, or known to belong to it."""
    known = known or {}
    seen = rows.groupBy("component").agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(s).alias(s) for s in sensors])
    stacked = seen.unpivot(["component", "rows"], sensors, "sensor", "present")
    belongs = F.lit(False)
    for sensor, component in known.items():
        belongs = belongs | ((F.col("sensor") == sensor) & (F.col("component") == component))
    return stacked.where((F.col("present") > 0) | belongs)

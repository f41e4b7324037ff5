"""Exact order statistics of groups of any size.

The built-in exact `percentile` merges every distinct value of a group in one task. Here the distinct values of each group are counted
once, with map-side combine, and written as one narrow table. A value's bin follows from its sign and logarithm alone, so one grouped
sum over that table tells in which bin of a group a wanted rank lies, and only the values of that bin are ordered. A bin that
holds more than `ROWS` distinct values is cut between its own extremes first, as often as that takes. All groups take the same
way, and a group with a third of all rows costs no more than its share of the scan.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from telltale.session import materialize

BINS = 4096       # parts of a bin that is cut again
OCTAVE = 32       # bins to each doubling of a value
LOWEST = 1100     # no double has a smaller logarithm than the negative of this
ROWS = 100_000    # distinct values that one task orders


def _base(df: DataFrame, keys: list[str], value: str | Column, weight: str | Column | None) -> DataFrame:
    value = F.col(value) if isinstance(value, str) else value
    weight = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    return (df.select(*keys, value.cast("double").alias("_v"), weight.cast("double").alias("_w"))
            .where(F.col("_v").isNotNull() & (F.col("_w") > 0)))


def _bin(value: Column) -> Column:
    """A whole number in the order of the values: NaN last, infinities at the ends."""
    end = F.lit(4 * LOWEST * OCTAVE)
    size = F.floor(F.log2(F.abs(value)) * OCTAVE) + LOWEST * OCTAVE
    return (F.when(F.isnan(value), end + 1).when(value == float("inf"), end).when(value == float("-inf"), -end)
            .when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size)).cast("int")


def _cut(low: Column, high: Column) -> Column:
    return F.when(high > low, F.floor((F.col("_v") - low) / (high - low) * (BINS - 1))).otherwise(F.lit(0)).cast("int")


def _sums(rows: DataFrame, parts: list[str]) -> DataFrame:
    """Weight, rows, distinct values and extremes of each part."""
    return rows.groupBy(*parts).agg(F.sum("_w").alias("_w"), F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_d"),
                                    F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))


def _hits(sums: DataFrame, group: list[str], part: str, start: Column, carried: list[Column], wanted: Column) -> DataFrame:
    """The parts in which a target lies, with the targets there and the weight before the part.

    `start` is the weight before the first part of `group`.
    """
    upto = Window.partitionBy(*group).orderBy(part)
    reach = sums.select(
        *group, part, "_d", "_lo", "_hi", *carried, wanted.alias("_goals"),
        (start + F.sum("_w").over(upto.rowsBetween(Window.unboundedPreceding, 0))).alias("_upto"),
        (start + F.coalesce(F.sum("_w").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).alias("_before"),
        F.lead(part).over(upto).isNull().alias("_last"), F.lag(part).over(upto).isNull().alias("_first"))
    inside = F.filter("_goals", lambda t: ((F.col("_before") < t["target"]) | F.col("_first")) & ((F.col("_upto") >= t["target"]) | F.col("_last")))
    return reach.withColumn("_goals", inside).where(F.size("_goals") > 0).drop("_upto", "_last", "_first")


def _select(base: DataFrame, keys: list[str], targets: dict[str, Column]) -> DataFrame:
    if not keys:  # one group, and one row even without values
        found = _select(base.withColumn("_all", F.lit(0)), ["_all"], targets)
        return found.groupBy().agg(*[F.first(c).alias(c) for c in found.columns if c != "_all"])
    rows = materialize(base.groupBy(*keys, "_v").agg(F.sum("_w").alias("_w"), F.count(F.lit(1)).alias("_n")))
    rows, parts = rows.withColumn("_part0", _bin(F.col("_v"))), [*keys, "_part0"]
    whole = Window.partitionBy(*keys)
    sums = _sums(rows, parts).withColumns({"n": F.sum("_n").over(whole), "total": F.sum("_w").over(whole)})
    goals = F.array(*[F.struct(F.lit(name).alias("name"), target.cast("double").alias("target")) for name, target in targets.items()])
    found = materialize(_hits(sums, keys, "_part0", F.lit(0.0), [F.col("n"), F.col("total")], goals))
    while (found.agg(F.max("_d")).first()[0] or 0) > ROWS:  # each cut divides the span of a part by `BINS`
        name = f"_part{len(parts) - len(keys)}"
        rows = rows.join(found.select(*parts, "_lo", "_hi"), parts).withColumn(name, _cut(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
        held = found.select(*parts, "n", "total", F.col("_goals").alias("_old"), F.col("_before").alias("_start"))
        inner = _sums(rows, [*parts, name]).join(held, parts)
        found = materialize(_hits(inner, parts, name, F.col("_start"), [F.col("n"), F.col("total")], F.col("_old")))
        parts = [*parts, name]
    order = Window.partitionBy(*parts).orderBy("_v")
    ordered = rows.join(found.select(*parts, "n", "total", "_goals", "_before"), parts).select(
        *keys, "n", "total", "_v", "_goals", (F.col("_before") + F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("_cum"),
        F.lead("_v").over(order).isNull().alias("_end"))
    reached = ordered.select(*keys, "n", "total", "_v", F.explode(F.filter("_goals", lambda t: (F.col("_cum") >= t["target"]) | F.col("_end"))).alias("_t"))
    return reached.groupBy(*keys).agg(F.first("n").alias("n"), F.first("total").alias("total"), *[
        F.min(F.when(F.col("_t.name") == name, F.col("_v"))).alias(name) for name in targets])


def select_by_weight(df: DataFrame, keys: list[str], value: str | Column, targets: dict[str, Column],
                     weight: str | Column | None = None) -> DataFrame:
    """Per group and target: the smallest value whose cumulative weight reaches the target.

    A target is an expression over `n` (rows) and `total` (weight) of the group. Rows
    with a null value or a weight that is null or not positive do not count. Returns one
    row per group: keys, n, total and a double column per target.
    """
    return _select(_base(df, keys, value, weight), keys, targets)


def grouped_quantiles(df: DataFrame, keys: list[str], value: str | Column, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles: keys, n and one column per probability."""
    targets = {}
    for name, p in probs.items():
        targets[f"_{name}_lo"] = F.floor((F.col("n") - 1) * F.lit(p)) + 1
        targets[f"_{name}_hi"] = F.ceil((F.col("n") - 1) * F.lit(p)) + 1
    found = _select(_base(df, keys, value, None), keys, targets)
    columns = []
    for name, p in probs.items():
        part = (F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        columns.append((lo + (hi - lo) * part).alias(name))
    return found.select(*keys, "n", *columns)


def grouped_median(df: DataFrame, keys: list[str], value: str | Column, name: str = "median") -> DataFrame:
    return grouped_quantiles(df, keys, value, {name: 0.5})

"""Ordered computations over streams of any length.

A plain window puts a whole stream into one task, so one long stream stalls the job.
Here each stream is cut into chunks of its order (a span of time, or a run of dense
positions). A window works inside a chunk, a small table of chunk summaries carries
the state across chunks, and a join on (stream, chunk) brings the carry back. The
result is the same as the plain window; no task holds more than one chunk.

Stream and chunk are one struct, `_part`. Its equality takes nulls as equal, so the
join needs no other keys than the window and the rows are dealt out once for both.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from telltale.functions.columns import micros

DAY = 86_400


def time_chunk(ts: str | Column, seconds: int = DAY) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def position_chunk(position: str | Column, length: int) -> Column:
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / F.lit(length)).cast("long")


def suggest_chunk_seconds(df: DataFrame, keys: list[str], ts: str, rows_per_chunk: int = 5_000_000) -> int:
    """Widest power-of-two span that keeps every (stream, span) under the row target.

    One aggregation to hourly counts; only its maxima reach the driver.
    """
    hourly = df.groupBy(*keys, time_chunk(ts, 3600).alias("_hour")).count()
    spans = [2**k for k in range(0, 15)]
    for span in reversed(spans):
        worst = (hourly.groupBy(*keys, F.floor(F.col("_hour") / span).alias("_span"))
                 .agg(F.sum("count").alias("n")).agg(F.max("n")).first()[0])
        if worst is None or worst <= rows_per_chunk:
            return span * 3600
    return 3600


def _parted(df: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    return df.withColumn("_part", F.struct(*keys, chunk.alias("_chunk")))


def _across(keys: list[str]) -> WindowSpec:
    """The chunks of each stream in order."""
    return Window.partitionBy(*[F.col("_part").getField(k) for k in keys]).orderBy(F.col("_part").getField("_chunk"))


def scan(df: DataFrame, keys: list[str], order: list[str], chunk: Column | None, *,
         lag: dict[str, Column] | None = None, lead: dict[str, Column] | None = None,
         total: dict[str, Column] | None = None, peak: dict[str, Column] | None = None,
         fill: dict[str, Column] | None = None, fill_next: dict[str, Column] | None = None,
         seen: dict[str, Column] | None = None, position: str | None = None) -> DataFrame:
    """Add running columns per stream, in the order given (which must be total).

    lag / lead: the value on the row before / after; total: inclusive running sum;
    peak: running maximum over the rows before this one; fill / fill_next: last
    non-null value up to and including / first from this row on; seen: last non-null
    value before this row; position: 1-based. Without a chunk each stream is one window, for streams
    that are known to be short: nothing is carried, and scans in the same order share one shuffle.
    """
    lag, lead, total, peak = lag or {}, lead or {}, total or {}, peak or {}
    fill, fill_next, seen = fill or {}, fill_next or {}, seen or {}
    if position:
        total = {**total, position: F.lit(1).cast("long")}
    rows = df if chunk is None else _parted(df, keys, chunk)
    inside = Window.partitionBy(*(keys if chunk is None else ["_part"])).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    across = _across(keys)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    later = across.rowsBetween(1, Window.unboundedFollowing)
    at = F.struct(*order)

    summary, carried, local, final = [], {}, {}, {}

    def neighbour(kind: str, wanted: dict[str, Column]) -> None:
        record = F.struct(*[c.alias(n) for n, c in wanted.items()])
        pick = F.max_by if kind == "lag" else F.min_by
        summary.append(pick(record, at).alias(f"_s_{kind}"))
        step = F.lag if kind == "lag" else F.lead
        carried[f"_c_{kind}"] = step(f"_s_{kind}").over(across)
        local[f"_l_{kind}"] = step(record).over(inside)
        for n in wanted:
            final[n] = F.coalesce(F.col(f"_l_{kind}"), F.col(f"_c_{kind}"))[n]

    if lag:
        neighbour("lag", lag)
    if lead:
        neighbour("lead", lead)
    for n, c in total.items():
        summary.append(F.sum(c).alias(f"_s_{n}"))
        carried[f"_c_{n}"] = F.sum(f"_s_{n}").over(earlier)
        local[f"_l_{n}"] = F.sum(c).over(upto)
        zero = F.lit(0)
        final[n] = F.coalesce(F.col(f"_l_{n}"), zero) + F.coalesce(F.col(f"_c_{n}"), zero)
    for n, c in peak.items():
        summary.append(F.max(c).alias(f"_s_{n}"))
        carried[f"_c_{n}"] = F.max(f"_s_{n}").over(earlier)
        local[f"_l_{n}"] = F.max(c).over(before)
        final[n] = F.greatest(F.col(f"_l_{n}"), F.col(f"_c_{n}"))
    for n, c in fill.items():
        summary.append(F.max_by(c, F.when(c.isNotNull(), at)).alias(f"_s_{n}"))
        carried[f"_c_{n}"] = F.last(f"_s_{n}", ignorenulls=True).over(earlier)
        local[f"_l_{n}"] = F.last(c, ignorenulls=True).over(upto)
        final[n] = F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}"))
    for n, c in seen.items():
        summary.append(F.max_by(c, F.when(c.isNotNull(), at)).alias(f"_s_{n}"))
        carried[f"_c_{n}"] = F.last(f"_s_{n}", ignorenulls=True).over(earlier)
        local[f"_l_{n}"] = F.last(c, ignorenulls=True).over(before)
        final[n] = F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}"))
    for n, c in fill_next.items():
        summary.append(F.min_by(c, F.when(c.isNotNull(), at)).alias(f"_s_{n}"))
        carried[f"_c_{n}"] = F.first(f"_s_{n}", ignorenulls=True).over(later)
        local[f"_l_{n}"] = F.first(c, ignorenulls=True).over(onward)
        final[n] = F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}"))

    if chunk is None:
        found = rows.withColumns(local).withColumns({n: F.lit(None) for n in carried})
        return found.withColumns(final).drop(*local, *carried)
    carry = rows.groupBy("_part").agg(*summary)
    carry = carry.select(F.col("_part").alias("_of"), *[c.alias(n) for n, c in carried.items()])
    found = rows.withColumns(local).join(carry, F.col("_part") == F.col("_of"), "left")
    return found.withColumns(final).drop("_part", "_of", *local, *carried)


def islands(df: DataFrame, keys: list[str], order: list[str], chunk: Column, facts: dict[str, Column],
            is_break, name: str = "island") -> DataFrame:
    """Number the islands of each stream from 0; `is_break(previous, current)` starts a new one.

    Both arguments are structs of the named facts.
    """
    inside = Window.partitionBy("_part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cur = F.struct(*[c.alias(n) for n, c in facts.items()])

    def flag(before: Column, now: Column) -> Column:
        return F.when(before.isNotNull(), F.coalesce(is_break(before, now), F.lit(False)).cast("long")).otherwise(F.lit(0))

    rows = _parted(df, keys, chunk).withColumn("_cur", cur)
    inner = rows.withColumn("_in", F.lag("_cur").over(inside))
    inner = inner.withColumn("_break", flag(F.col("_in"), F.col("_cur")))
    across = _across(keys)
    summary = inner.groupBy("_part").agg(
        F.min_by("_cur", F.struct(*order)).alias("_first"), F.max_by("_cur", F.struct(*order)).alias("_last"),
        F.sum("_break").alias("_inner"))
    summary = summary.withColumn("_tail", F.lag("_last").over(across))
    summary = summary.withColumn("_head", flag(F.col("_tail"), F.col("_first")))
    summary = summary.select(
        F.col("_part").alias("_of"),
        (F.coalesce(F.sum("_inner").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
         + F.sum("_head").over(across.rowsBetween(Window.unboundedPreceding, 0))).alias("_offset"))
    out = inner.withColumn("_local", F.sum("_break").over(upto)).join(summary, F.col("_part") == F.col("_of"), "left").withColumn(
        name, F.col("_local") + F.col("_offset"))
    return out.drop("_part", "_of", "_cur", "_in", "_break", "_local", "_offset")


def block_of(position: Column, n: Column, blocks: Column) -> Column:
    """Block (from 0) of a 0-based position when n rows split into near-equal consecutive blocks.

    The first n mod blocks blocks are one row longer.
    """
    size, longer = F.floor(n / blocks), n % blocks
    edge = longer * (size + 1)
    return F.when(position < edge, F.floor(position / (size + 1))).otherwise(
        longer + F.floor((position - edge) / F.greatest(size, F.lit(1)))).cast("long")

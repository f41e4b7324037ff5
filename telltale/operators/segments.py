"""Streams cut into actions at recording gaps, action features, interval matching."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from telltale.functions.columns import micros, seconds_between
from telltale.functions.ordered import DAY, block_of, islands, scan, time_chunk
from telltale.functions.quantiles import grouped_median, grouped_quantiles
from telltale.session import materialize

STREAM = ["stream_id"]
ORDER = ["ts", "ord"]
# Class names of an action.
NORMAL, ABNORMAL = "Normal", "Abnormal resistance"
# Readings of a stream whose actions may each meet in one row.
GATHERED_ROWS = 100_000


def stream_intervals(df: DataFrame, chunk_seconds: int = DAY) -> DataFrame:
    """Seconds since the previous reading of the stream."""
    return scan(df, STREAM, ORDER, time_chunk("ts", chunk_seconds), lag={"_prev": micros("ts")}).withColumn(
        "dt", (micros("ts") - F.col("_prev")) / 1e6).drop("_prev")


def cadence(df: DataFrame, keys: list[str] = STREAM, chunk_seconds: int = DAY) -> DataFrame:
    """Median and modal positive interval, readings, and gaps beyond three median intervals.

    The mode's ties go to the shorter interval.
    """
    dts = stream_intervals(df, chunk_seconds).where(F.col("dt").isNotNull()).select(*keys, "dt")
    middle = materialize(grouped_median(dts.where("dt > 0"), keys, "dt", "median_dt").select(*keys, "median_dt"))
    counts = dts.where("dt > 0").groupBy(*keys, "dt").agg(F.count(F.lit(1)).alias("_c"))
    mode = counts.groupBy(*keys).agg(F.min_by("dt", F.struct(-F.col("_c"), F.col("dt"))).alias("modal_dt"))
    gaps = dts.join(middle, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("intervals"), F.count_if(F.col("dt") > 3 * F.col("median_dt")).alias("gaps"))
    return middle.join(mode, keys).join(gaps, keys)


def segmentation_gap(median_dt: Column) -> Column:
    """The gap that ends an action: eight intervals, at least a fifth of a second."""
    return F.greatest(F.lit(0.2), median_dt * 8)


def segment_stream(df: DataFrame, gap: Column | float, keys: list[str] = STREAM, order: list[str] = ORDER,
                   chunk_seconds: int = DAY) -> DataFrame:
    """Add `segment`: a new one starts when the interval is strictly longer than the gap."""
    gap = F.lit(float(gap)) if isinstance(gap, (int, float)) else gap
    return islands(
        df, keys, order, time_chunk("ts", chunk_seconds), {"us": micros("ts"), "gap": gap},
        lambda before, now: (now["us"] - before["us"]) / 1e6 > now["gap"], "segment")


def segment_bounds(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy(*STREAM, "segment").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n_rows"))


STATISTICS = ("mean", "std", "min", "max", "rms", "q10", "q50", "q90", "change", "variation")
QUANTILES = {"q10": 0.1, "q50": 0.5, "q90": 0.9}


def _quantile(ordered: Column, p: float) -> Column:
    """Linear-interpolated quantile of a sorted array, as in `grouped_quantiles`; null for none."""
    at = (F.size(ordered).cast("long") - 1) * F.lit(p)
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def _statistics(c: str) -> Column:
    """The statistics of a channel whose last reading before a row is `_b_<channel>`."""
    v, at = F.col(c), F.when(F.col(c).isNotNull(), F.struct(*ORDER))
    step = F.avg(F.abs(v - F.col(f"_b_{c}")))
    plain = [F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
             F.sqrt(F.avg(v * v)).alias("rms"), (F.max_by(v, at) - F.min_by(v, at)).alias("change"),
             F.when(F.count(v) > 0, F.coalesce(step, F.lit(0.0))).alias("variation")]
    return F.struct(*plain)


def _gathered(rows: DataFrame, channels: list[str], facts: list[Column]) -> DataFrame:
    """One shuffle for all statistics; the readings of an action meet in one row."""
    keys = [*STREAM, "segment"]
    before = Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    steps = rows.withColumns({f"_b_{c}": F.last(c, ignorenulls=True).over(before) for c in channels})
    wide = steps.groupBy(*keys).agg(*facts, *[_statistics(c).alias(f"_s_{c}") for c in channels],
                                    *[F.sort_array(F.collect_list(F.col(c).cast("double"))).alias(f"_v_{c}") for c in channels])
    return wide.withColumns({f"_s_{c}": F.struct(f"_s_{c}.*", *[_quantile(F.col(f"_v_{c}"), p).alias(q) for q, p in QUANTILES.items()])
                             for c in channels}).drop(*[f"_v_{c}" for c in channels])


def _chunked(rows: DataFrame, channels: list[str], chunk_seconds: int, facts: list[Column]) -> DataFrame:
    """The same for actions of any length: chunked scans and selected quantiles."""
    keys = [*STREAM, "segment"]
    steps = scan(rows, keys, ORDER, time_chunk("ts", chunk_seconds), seen={f"_b_{c}": F.col(c) for c in channels})
    wide = steps.groupBy(*keys).agg(*facts, *[_statistics(c).alias(f"_s_{c}") for c in channels])
    cells = rows.unpivot([*keys, *ORDER], channels, "channel", "v")
    spread = grouped_quantiles(cells, [*keys, "channel"], "v", QUANTILES).groupBy(*keys).agg(*[
        F.max(F.when(F.col("channel") == c, F.struct(*QUANTILES))).alias(f"_q_{c}") for c in channels])
    return wide.join(spread, keys, "left").withColumns({
        f"_s_{c}": F.struct(f"_s_{c}.*", *[F.col(f"_q_{c}")[q].alias(q) for q in QUANTILES]) for c in channels}).drop(
        *[f"_q_{c}" for c in channels])


def _action_table(segmented: DataFrame, channels: list[str], states: list[str], chunk_seconds: int, facts: list[Column]) -> DataFrame:
    """A row per action: `facts`, and one struct of statistics per channel (`_s_<channel>`; null where the stream has no name).

    An action is no longer than its stream. Streams of at most `GATHERED_ROWS` readings are gathered action by action,
    the others go through chunks.
    """
    # Cutting a stream costs a shuffle; the steps below read the cut rows instead of repeating it.
    rows = materialize(segmented.select(*STREAM, "segment", *ORDER, *channels, *states))
    busy = materialize(rows.groupBy(*STREAM).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GATHERED_ROWS).select(
        F.struct(*STREAM).alias("_busy")))
    if busy.isEmpty():
        wide = _gathered(rows, channels, facts)
    else:  # one row for each `GATHERED_ROWS` readings at most
        named, own = F.broadcast(busy), F.struct(*STREAM) == F.col("_busy")
        wide = _gathered(rows.join(named, own, "left_anti"), channels, facts).unionByName(
            _chunked(rows.join(named, own, "left_semi"), channels, chunk_seconds, facts))
    return wide.withColumns({f"_s_{c}": F.when(F.col("stream_id").isNotNull(), F.col(f"_s_{c}")) for c in channels})


def action_features(segmented: DataFrame, channels: list[str], chunk_seconds: int = DAY) -> DataFrame:
    """Ten statistics per action and channel, missing readings left out.

    One row per (stream, segment, channel): mean, std, min, max, rms, q10, q50, q90, the
    change from first to last reading and the mean absolute step.
    """
    keys = [*STREAM, "segment"]
    wide = _action_table(segmented, channels, [], chunk_seconds, [])
    long = wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), f"_s_{c}.*") for c in channels])).alias("_s"))
    return long.select(*keys, "_s.*").where(F.col("mean").isNotNull()).select(*keys, "channel", *STATISTICS)


def _state_facts(states: list[str]) -> list[Column]:
    return [seconds_between(F.min("ts"), F.max("ts")).alias("duration_seconds"), *[F.avg(s).alias(f"{s}_fraction") for s in states]]


def state_fractions(segmented: DataFrame, states: list[str]) -> DataFrame:
    return segmented.groupBy(*STREAM, "segment").agg(*_state_facts(states))


def action_matrix(segmented: DataFrame, channels: list[str], states: list[str], chunk_seconds: int = DAY) -> DataFrame:
    """Wide feature row per action for the learned operators."""
    wide = _action_table(segmented, channels, states, chunk_seconds, _state_facts(states))
    return wide.select(*STREAM, "segment", "duration_seconds", *[f"{s}_fraction" for s in states],
                       *[F.col(f"_s_{c}")[s].alias(f"{c}_{s}") for c in channels for s in STATISTICS])


def blocked_folds(actions: DataFrame, folds: int = 5) -> DataFrame:
    """Consecutive near-equal blocks of a stream's actions, in time order, as `fold`."""
    placed = scan(actions.withColumn("ts", F.col("start")).withColumn("ord", F.col("segment")), STREAM, ORDER,
                  time_chunk("ts", 30 * DAY), position="_pos")
    n = actions.groupBy(*STREAM).agg(F.count(F.lit(1)).alias("_n"))
    return placed.join(n, STREAM).withColumn(
        "fold", block_of(F.col("_pos") - 1, F.col("_n"), F.least(F.lit(folds).cast("long"), F.col("_n")))).drop(
        "_pos", "_n", "ts", "ord")


def contained_readings(readings: DataFrame, intervals: DataFrame, chunk_seconds: int = DAY) -> DataFrame:
    """Readings inside [start, end] of an interval of the same stream; intervals do not overlap.

    The starts are merged into the stream and carried forward, so a reading meets the one
    interval that can hold it, however many the stream has.
    """
    held = F.struct("start", "end")
    starts = intervals.select(*STREAM, F.col("start").alias("ts"), F.lit(None).cast(
        readings.schema["ord"].dataType).alias("ord"), F.lit(0).alias("_side"), held.alias("_held"))
    rows = readings.withColumns({"_side": F.lit(1), "_held": F.lit(None).cast(starts.schema["_held"].dataType)})
    merged = scan(rows.unionByName(starts, allowMissingColumns=True), STREAM, ["ts", "_side", "ord"],
                  time_chunk("ts", chunk_seconds), fill={"_in": F.col("_held")})
    inside = merged.where("_side = 1").where(F.col("ts") <= F.col("_in.end"))
    return inside.withColumns({"start": F.col("_in.start"), "end": F.col("_in.end")}).drop("_in", "_held", "_side")


def check_annotations(readings: DataFrame, labels: DataFrame, chunk_seconds: int = DAY) -> DataFrame:
    """Per label: do its boundaries and row count match the stream's readings?"""
    keys = [*STREAM, "start", "end"]
    found = contained_readings(readings, labels.select(*keys), chunk_seconds).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("found"), F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    bounds = F.coalesce((F.col("_first") == F.col("start")) & (F.col("_last") == F.col("end")), F.lit(False))
    return labels.join(found, keys, "left").select(
        *keys, "n_rows", F.coalesce("found", F.lit(0)).alias("found"), bounds.alias("bounds_match"),
        (F.coalesce("found", F.lit(0)) == F.col("n_rows")).alias("rows_match"))


def interval_overlaps(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of the same stream and label that overlap, with IoU.

    Intervals are keyed by cells as wide as their own length (the next power of two
    microseconds), which each covers in at most two places. The shorter partner looks up
    the cells of every longer width in use, at most one per power of two, so neither
    side is compared with the whole of its label.
    """
    def prepared(df: DataFrame, tag: str) -> DataFrame:
        length = F.greatest(micros("end") - micros("start"), F.lit(1))
        return df.select(
            *STREAM, "label", F.col("id").alias(f"{tag}_id"), micros("start").alias(f"{tag}_a"),
            micros("end").alias(f"{tag}_b"), F.ceil(F.log2(length.cast("double"))).cast("int").alias(f"{tag}_level"))

    t, p = materialize(prepared(truth, "t")), materialize(prepared(found, "p"))
    both = t.select("t_level").union(p.select("p_level")).distinct().agg(F.collect_set("t_level")).first()[0]
    levels = F.array(*[F.lit(v) for v in sorted(both)]) if both else F.array(F.lit(0))

    def cells(a: Column, b: Column, level: Column) -> Column:
        width = F.pow(F.lit(2.0), level.cast("double"))
        return F.sequence(F.floor(a / width), F.floor(b / width))

    def meet(long: DataFrame, lt: str, short: DataFrame, st: str, strict: bool) -> DataFrame:
        own = long.withColumn("_cell", F.explode(cells(F.col(f"{lt}_a"), F.col(f"{lt}_b"), F.col(f"{lt}_level")))).withColumn(
            "_level", F.col(f"{lt}_level"))
        floor = F.col(f"{st}_level")
        wider = F.filter(levels, (lambda v: v > floor) if strict else (lambda v: v >= floor))
        look = short.withColumn("_level", F.explode(wider))
        look = look.withColumn("_cell", F.explode(cells(F.col(f"{st}_a"), F.col(f"{st}_b"), F.col("_level"))))
        width = F.pow(F.lit(2.0), F.col("_level").cast("double"))
        once = F.col("_cell") == F.floor(F.greatest(F.col("t_a"), F.col("p_a")) / width)
        return own.join(look, [*STREAM, "label", "_level", "_cell"]).where(once)

    pairs = meet(t, "t", p, "p", False).unionByName(meet(p, "p", t, "t", True))
    overlap = F.least("t_b", "p_b") - F.greatest("t_a", "p_a")
    union = (F.col("t_b") - F.col("t_a")) + (F.col("p_b") - F.col("p_a")) - overlap
    return pairs.where(overlap > 0).select(
        *STREAM, "label", "t_id", "p_id", (overlap / 1e6).alias("overlap"), (overlap / union).alias("iou"))


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """One-to-one matches by IoU, then truth, then prediction id.

    A pair that is the best of both its partners is always in the greedy result, so each
    round takes all such pairs at once and drops their partners' other pairs. The rounds
    are joins and grouped maxima; no group of pairs is ever gathered in one task.
    """
    left = materialize(pairs.select(*STREAM, "t_id", "p_id", "iou"))
    taken = None
    while True:
        rank = F.struct(F.col("iou"), -F.col("t_id"), -F.col("p_id"))
        best_t = left.groupBy(*STREAM, "t_id").agg(F.max(rank).alias("_bt"))
        best_p = left.groupBy(*STREAM, "p_id").agg(F.max(rank).alias("_bp"))
        now = materialize(left.join(best_t, [*STREAM, "t_id"]).join(best_p, [*STREAM, "p_id"]).where(
            (rank == F.col("_bt")) & (rank == F.col("_bp"))).select(*STREAM, "t_id", "p_id", "iou"))
        taken = now if taken is None else taken.unionByName(now)
        left = materialize(left.join(now.select(*STREAM, "t_id"), [*STREAM, "t_id"], "left_anti").join(
            now.select(*STREAM, "p_id"), [*STREAM, "p_id"], "left_anti"))
        if left.isEmpty():
            return taken


def iou_weighted_f1(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Twice the matched IoU over all intervals of both sides; 0 when both are empty."""
    truth, found = materialize(truth), materialize(found)
    matched = greedy_matches(interval_overlaps(truth, found))
    credit = matched.agg(F.coalesce(F.sum("iou"), F.lit(0.0)).alias("credit"), F.count(F.lit(1)).alias("matches"))
    sizes = truth.agg(F.count(F.lit(1)).alias("truth")).crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("found"))))
    total = F.col("truth") + F.col("found")
    return sizes.crossJoin(F.broadcast(credit)).withColumn(
        "f1", F.when(total > 0, 2 * F.col("credit") / total).otherwise(F.lit(0.0)))


def flagged_action_evidence(actions: DataFrame, count: int = 5) -> DataFrame:
    """Duration and peak of the first flagged actions of each stream."""
    w = Window.partitionBy(*STREAM).orderBy("segment")
    return actions.where(F.col("label") == ABNORMAL).withColumn("_rn", F.row_number().over(w)).where(
        F.col("_rn") <= count).drop("_rn")

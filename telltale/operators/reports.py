"""Report tables per file, bounded pages, recording targets and explanation text."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from telltale.functions.columns import finite, natural_key, number_text
from telltale.operators.segments import ABNORMAL, NORMAL

# Evidence ids with label and unit, by measured column.
EVIDENCE = {
    "rms": ("shm-rms", "Stress signal RMS", "raw stress units"),
    "range": ("shm-range", "Stress signal range", "raw stress units"),
    "samples": ("shm-samples", "Measured samples", "samples"),
    "cycles": ("shm-cycles", "Rainflow cycle count", "cycles including half cycles"),
    "maximum_cycle_range": ("shm-cycle-range", "Maximum rainflow stress range", "raw stress units"),
    "speed_m_s": ("rail-speed", "Estimated running speed", "m/s"),
    "median_dt": ("door-cadence", "Median observed interval", "seconds"),
    "n_actions": ("door-actions", "Detected candidate actions", None),
    "n_abnormal": ("door-abnormal", "Abnormal-resistance classifications", None),
    "usable_cars": ("acv-coverage", "Cars with usable cooling evidence", None),
    "cadence": ("acv-cadence", "Observed modal sampling interval", "seconds"),
}
# How much of a report one page shows.
LIMITS = {"evidence": 40, "entities": 20, "warnings": 16}
RECORD_CHARACTERS = 64_000


def evidence_rows(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Measured columns as evidence rows (id, label, value, unit); non-finite becomes null."""
    names = [c for c in measured.columns if c in EVIDENCE]
    rows = measured.select(*keys, *[F.col(c).cast("double") for c in names]).unpivot(keys, names, "_c", "_v")
    spark = measured.sparkSession
    labels = spark.createDataFrame([(c, *EVIDENCE[c]) for c in names], "_c string, id string, label string, unit string")
    return rows.join(F.broadcast(labels), "_c").select(*keys, "id", "label", finite("_v").alias("value"), "unit")


def action_evidence(actions: DataFrame, keys: list[str], count: int = 5) -> DataFrame:
    """Peak and duration of the first flagged actions as evidence rows. Needs segment, peak, duration."""
    w = Window.partitionBy(*keys).orderBy("segment")
    first = actions.where(F.col("label") == ABNORMAL).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= count)
    n = (F.col("segment") + 1).cast("string")
    items = F.array(
        F.struct(F.concat(F.lit("door-action-"), n, F.lit("-current")).alias("id"),
                 F.concat(F.lit("Action "), n, F.lit(" peak absolute motor current")).alias("label"),
                 F.col("peak").cast("double").alias("value"), F.lit("mA").alias("unit")),
        F.struct(F.concat(F.lit("door-action-"), n, F.lit("-duration")).alias("id"),
                 F.concat(F.lit("Action "), n, F.lit(" measured duration")).alias("label"),
                 F.col("duration").cast("double").alias("value"), F.lit("seconds").alias("unit")))
    return first.select(*keys, F.explode(items).alias("_e")).select(*keys, "_e.*")


def car_entities(ranked: DataFrame) -> DataFrame:
    """Cars of each case with place and availability. Needs ranked_cars and available (array of ids)."""
    return ranked.select("file_id", F.posexplode(F.split("ranked_cars", r"\|")).alias("_p", "id"), "available").select(
        "file_id", "id", F.concat(F.lit("Car "), F.col("id")).alias("label"), (F.col("_p") + 1).alias("place"),
        F.when(F.array_contains("available", F.col("id")), "ranked").otherwise("unavailable").alias("status"))


def bounded_page(rows: DataFrame, keys: list[str], order: list, limit: int, offset: int = 0) -> DataFrame:
    """The shown rows of a child table. The limit is applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= offset + limit).where(
        F.col("_rn") > offset).drop("_rn")


def page_counts(rows: DataFrame, keys: list[str], limit: int, offset: int = 0) -> DataFrame:
    """total, included and omitted rows, and the next offset."""
    n = F.col("total")
    shown = F.least(F.lit(limit), F.greatest(F.lit(0), n - offset))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")).select(
        *keys, "total", shown.alias("included"), (n - shown).alias("omitted"),
        F.when(shown + offset < n, shown + offset).alias("next_offset"))


def within_budget(record: str | Column, limit: int = RECORD_CHARACTERS) -> Column:
    """A record over the budget is withheld whole (null), never cut."""
    r = F.col(record) if isinstance(record, str) else record
    return F.when(F.length(r) <= limit, r)


def rail_targets(predictions: DataFrame) -> DataFrame:
    """Two side targets per recording and the tone its class gives them."""
    sides = F.array(*[F.struct(F.lit(f"side-{i}").alias("target"), F.lit(name).alias("label"))
                      for i, name in ((1, "Side I"), (2, "Side II"))])
    known = F.col("prediction").isin("Normal", "Side I", "Side II")
    row = predictions.select("file_id", "prediction", F.explode(sides).alias("_t")).select("file_id", "prediction", "_t.*")
    flagged = F.col("prediction") == F.col("label")
    return row.select(
        "file_id", "target", "label",
        F.when(~F.coalesce(known, F.lit(False)), "unknown").when(flagged, "flagged").otherwise("context").alias("tone"))


def car_targets(predictions: DataFrame, entities: DataFrame) -> DataFrame:
    """Eight car targets per case with rank and tone; a car without evidence is unknown.

    predictions: file_id, ranked_cars; entities: file_id, id, status.
    """
    placed = predictions.select("file_id", F.posexplode(F.split("ranked_cars", r"\|")).alias("_p", "id"))
    known = placed.join(entities.select("file_id", "id", "status"), ["file_id", "id"], "left")
    available = F.coalesce(F.col("status") == "ranked", F.lit(False))
    return known.select(
        "file_id", F.concat(F.lit("car-"), F.col("id")).alias("target"), F.concat(F.lit("Car "), F.col("id")).alias("label"),
        F.when(available, F.col("_p") + 1).alias("rank"),
        F.when(~available, "unknown").when(F.col("_p") == 0, "priority").otherwise("ranked").alias("tone"))


def action_targets(predictions: DataFrame) -> DataFrame:
    """A target per door action and the tone its class gives it."""
    tone = F.when(F.col("prediction") == NORMAL, "normal").when(F.col("prediction") == ABNORMAL, "flagged").otherwise("unknown")
    n = (F.col("row_no") + 1).cast("string")
    return predictions.select("file_id", F.concat(F.lit("action-"), n).alias("target"), F.concat(F.lit("Action "), n).alias("label"), tone.alias("tone"))


def damage_targets(predictions: DataFrame) -> DataFrame:
    """The whole recording as the one target of a damage estimate."""
    known = finite("damage").isNotNull() & (F.col("damage") >= 0)
    return predictions.select("file_id", F.lit("recording").alias("target"), F.when(known, "estimated").otherwise("unknown").alias("tone"))


def attention_target(targets: DataFrame) -> DataFrame:
    """Default target per file: the first priority or flagged one, else the first."""
    urgent = F.col("tone").isin("priority", "flagged")
    return targets.groupBy("file_id").agg(F.min_by("target", F.struct(~urgent, natural_key("target"))).alias("target"),
                                          F.count_if(urgent).alias("flagged"))


def sensor_targets(sides: DataFrame) -> DataFrame:
    """The 64 sensor places (car, position) of a recording, each tied to its side's target."""
    places = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda c: F.transform(
        F.sequence(F.lit(1), F.lit(8)), lambda p: F.struct(c.alias("car"), p.alias("position")))))
    side = F.when(F.col("target") == "side-1", 1).otherwise(0)
    return sides.select("file_id", "target", F.explode(places).alias("_p")).select(
        "file_id", "target", "_p.*").where(F.col("position") % 2 == side)


def evidence_of(targets: DataFrame, evidence: DataFrame, prefix: Column) -> DataFrame:
    """Evidence whose id starts with the target's prefix, per file."""
    t = targets.withColumn("_prefix", prefix).select("file_id", "target", "_prefix")
    return t.join(evidence, "file_id").where(F.startswith(F.col("id"), F.col("_prefix"))).drop("_prefix")


def explanation(components: DataFrame, trained: str = "training_rows") -> DataFrame:
    """Summary and evidence lines of a component from its measured facts."""
    flags, valid = F.col("recent_flags").cast("string"), F.col("recent_valid").cast("string")
    summary = F.concat(
        F.col("train_id"), F.lit(" / "), F.col("component"), F.lit(": "), flags, F.lit(" of "), valid,
        F.lit(" recent scored monitoring observations were flagged. "), F.col("title"), F.lit("."))
    lines = F.array_compact(F.array(
        F.concat(F.lit("Recent detections: "), flags, F.lit("/"), valid, F.lit(" scored observations.")),
        F.when(F.col("evidence_ts").isNotNull(), F.concat(
            F.lit("Sensor evidence is from "), F.date_format("evidence_ts", "yyyy-MM-dd'T'HH:mm:ss"),
            F.lit("; robust deviation "), number_text("evidence_z"), F.lit("."))),
        F.when(F.col("recent_valid") < 4, F.lit("Fewer than four recent scored observations are available.")),
        F.when(F.col("stale"), F.lit("The latest observation is older than three of this group's median intervals."))))
    return components.withColumns({"summary": summary, "evidence": lines})


def model_digest(candidates: DataFrame, keys: list[str], limit: int = 12) -> DataFrame:
    """Best candidates of a validation with the number left out, as one row per model."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "name")
    shown = candidates.withColumn("_rn", F.row_number().over(w))
    return shown.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("_rn") <= limit, F.struct("_rn", "name", "score")))).alias("candidates"),
        F.greatest(F.lit(0), F.count(F.lit(1)) - limit).alias("omitted"))

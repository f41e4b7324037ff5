"""Advice text, work orders from component status, order state from an event log."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from telltale.functions.ordered import DAY, scan, time_chunk

# Title, priority and timeframe by status.
STATUS_RULES = {
    "healthy": ("Within recent monitoring envelope", "P3", "Routine monitoring"),
    "warning": ("Sustained deviation needs inspection", "P2", "Inspect at the next planned maintenance opportunity"),
    "critical": ("Strong sustained anomaly needs prompt review", "P1",
                 "Prompt qualified review before the next dispatch decision"),
    "unknown": ("Condition unavailable: insufficient current evidence", "Review",
                "Restore data coverage before making a condition decision"),
}
# Possible cause and actions by component family (with the sensor words that imply it).
FAMILY_RULES = (
    ("bogies", ("bearing", "vibration"),
     "The detected pattern may reflect bearing or running-gear deterioration, or an operating-condition change; inspection is needed to distinguish them.",
     ("Review bearing-temperature and vibration measurements at the cited times.",
      "Arrange a bearing and running-gear inspection under the operator's maintenance procedure.",
      "Check sensor calibration and operating conditions before confirming a mechanical fault.")),
    ("doors", ("door",),
     "Door actuator load or cycle changes may indicate friction, obstruction or an actuator/sensor issue.",
     ("Check the door guide, seals and actuator for obstruction or excess friction.",
      "Compare cycle time and motor current during a controlled inspection.",
      "Record the inspection result before confirming a fault or replacing a part.")),
    ("brakes", ("brake",),
     "Brake pressure or temperature changes may indicate a pneumatic, friction or sensor issue.",
     ("Request qualified brake-system inspection under the applicable maintenance procedure.",
      "Review pressure release, temperature and sensor calibration together.",
      "Verify the suspected cause with inspection evidence before deciding a repair.")),
    ("motors", ("motor",),
     "Traction load or temperature changes may indicate a motor, cooling or operating-condition issue.",
     ("Review motor current and temperature alongside speed and ambient conditions.",
      "Inspect cooling and electrical connections using the operator's procedure.",
      "Confirm the cause with qualified electrical diagnostics before repair.")),
)
# Advice texts, priorities and timeframes.
OTHER_RULE = (
    "Sustained sensor deviations may reflect equipment degradation, an operating change or a sensor issue.",
    ("Review the cited sensor observations against the reference period.",
     "Arrange an appropriate component and sensor inspection.",
     "Record verified findings before confirming a fault or selecting replacement parts."))
# Advice texts, priorities and timeframes.
CALM_RULES = {
    "unknown": ("Insufficient measured evidence to assess component condition.",
                ("Check sensor connectivity, timestamps and the reference-data coverage before drawing a condition conclusion.",)),
    "healthy": ("No sustained anomaly meets the current advisory rules in the recent monitoring window.",
                ("Continue routine monitoring and compare future observations with the reference period.",)),
}
# Order of work-order states; an order only moves up.
ORDER_STATES = ("open", "in_progress", "completed")


def advise(components: DataFrame, sensor: str | None = None) -> DataFrame:
    """Add title, priority, timeframe, possible cause and actions."""
    status, component = F.col("status"), F.col("component")
    top = F.coalesce(F.col(sensor), F.lit("")) if sensor else F.lit("")

    def by_status(i: int) -> Column:
        return F.coalesce(*[F.when(status == s, F.lit(rule[i])) for s, rule in STATUS_RULES.items()])

    def chosen(pick) -> Column:
        out = None
        for s, rule in CALM_RULES.items():
            out = F.when(status == s, pick(rule)) if out is None else out.when(status == s, pick(rule))
        for family, words, *rule in FAMILY_RULES:
            match = component == family
            for word in words:
                match = match | F.contains(top, F.lit(word))
            out = out.when(match, pick(tuple(rule)))
        return out.otherwise(pick(OTHER_RULE))

    return components.withColumns({
        "title": by_status(0), "priority": by_status(1), "timeframe": by_status(2),
        "possible_cause": chosen(lambda r: F.lit(r[0])),
        "actions": chosen(lambda r: F.array(*[F.lit(a) for a in r[1]]))})


def derive_orders(components: DataFrame, dataset: str) -> DataFrame:
    """A work order for every warning or critical component."""
    wanted = advise(components.where(F.col("status").isin("warning", "critical")))
    evidence = F.coalesce(F.date_format("evidence_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("None"))
    return wanted.select(
        F.lit(dataset).alias("dataset"), "train_id", "component", F.col("possible_cause").alias("issue"), "priority",
        F.concat(F.array_join("actions", " "), F.lit(" Evidence timestamp: "), evidence, F.lit(". "), F.col("timeframe"))
        .alias("action"), F.lit("open").alias("status"))


def without_active(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Drop orders for components that already have one not completed."""
    keys = ["dataset", "train_id", "component"]
    return new.join(existing.where("status != 'completed'").select(*keys), keys, "left_anti")


def state_rank(status: str | Column) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return F.coalesce(*[F.when(s == name, F.lit(i)) for i, name in enumerate(ORDER_STATES)])


def order_events(log: DataFrame, chunk_seconds: int = 30 * DAY) -> DataFrame:
    """Each event with the state before it and whether it is legal.

    Orders start open and only move up, so the state is the highest rank so far: a
    running maximum. An event at that rank changes nothing; one below it is rejected.
    """
    ranked = log.withColumn("_rank", state_rank("status"))
    seen = scan(ranked, ["order_id"], ["ts", "ord"], time_chunk("ts", chunk_seconds), peak={"_before": F.col("_rank")})
    before = F.coalesce("_before", F.lit(0))
    outcome = (F.when(F.col("_rank").isNull(), "invalid").when(F.col("_rank") < before, "rejected")
               .when(F.col("_rank") == before, "unchanged").otherwise("applied"))
    return seen.withColumns({"outcome": outcome}).drop("_rank", "_before")


def order_state(log: DataFrame) -> DataFrame:
    """Current state per order: the highest state any event asked for, when it was reached, and counts."""
    ranked = log.withColumn("_rank", state_rank("status")).where("_rank is not null")
    top = ranked.groupBy("order_id").agg(
        F.max("_rank").alias("_top"), F.count(F.lit(1)).alias("events"),
        F.min_by("ts", F.struct(-F.col("_rank"), F.col("ts"), F.col("ord"))).alias("updated_at"))
    name = F.coalesce(*[F.when(F.col("_top") == i, F.lit(s)) for i, s in enumerate(ORDER_STATES)])
    return top.select("order_id", name.alias("status"), "events", "updated_at")

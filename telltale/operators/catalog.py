"""Saved runs: validity, catalogue views, comparisons, facts and export plans.

Tables: runs (run_id, subsystem, status, created_at, ...), predictions (run_id, subsystem,
file_id, row_no, start, end, prediction, ranked_cars, damage), warnings (run_id, file_id,
warning) and evidence (run_id, file_id, id, value, unit).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from telltale.functions.columns import counted, finite, natural_key, number_text, range_text
from telltale.operators.segments import ABNORMAL, NORMAL
from telltale.operators.waveform import CLASSES

FILE = ["run_id", "subsystem", "file_id"]
# Tasks in display order, states of a run, output columns per task.
SUBSYSTEMS = ("door", "acv", "rail", "shm")
RUN_STATES = ("queued", "running", "completed", "failed")
RUN_SOURCES = ("uploaded", "organiser_test")
COLUMNS = {"door": ["start_time", "end_time", "prediction"], "acv": ["file_id", "ranked_cars"],
           "rail": ["file_id", "prediction"], "shm": ["file_id", "prediction"]}
# Fixed pattern: identifier of a run.
RUN_ID = "^[a-f0-9]{32}$"


def valid_prediction(p: DataFrame) -> Column:
    """Row rule per task: interval and label, eight distinct cars, class, finite damage not below 0."""
    cars = F.split("ranked_cars", r"\|")
    door = F.col("prediction").isin(NORMAL, ABNORMAL) & (F.col("end") > F.col("start"))
    acv = (F.size(cars) == 8) & (F.size(F.array_distinct(cars)) == 8) & F.forall(cars, lambda c: c.rlike("^[0-9]{2}$"))
    shm = finite("damage").isNotNull() & (F.col("damage") >= 0)
    s = F.col("subsystem")
    return F.coalesce(F.when(s == "door", door).when(s == "acv", acv).when(
        s == "rail", F.col("prediction").isin(*CLASSES)).when(s == "shm", shm), F.lit(False))


def prediction_problems(p: DataFrame) -> DataFrame:
    """Files that may not be written: an invalid row, or more than one row outside the door task."""
    return p.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~valid_prediction(p)).alias("invalid_rows")).where(
        (F.col("invalid_rows") > 0) | ((F.col("subsystem") != "door") & (F.col("rows") != 1)))


def require_valid(p: DataFrame) -> DataFrame:
    """All or nothing: raise before anything is written."""
    bad = prediction_problems(p).agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} files have invalid predictions; nothing is written.")
    return p


def file_summary(p: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row per file: counts, first car, class, damage and the value comparisons sort by."""
    w = warnings.groupBy("run_id", "file_id").agg(F.count(F.lit(1)).alias("warnings_count"))
    first = F.min_by("ranked_cars", "row_no")
    rows = p.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("prediction_rows"),
        F.count_if(F.col("prediction") == NORMAL).alias("_normal"),
        F.count_if(F.col("prediction") == ABNORMAL).alias("_abnormal"),
        first.alias("_rank"), F.min_by("prediction", "row_no").alias("_class"),
        F.min_by(finite("damage"), "row_no").alias("_damage"))
    s = F.col("subsystem")
    door = s == "door"
    rows = rows.join(w, ["run_id", "file_id"], "left").fillna(0, ["warnings_count"])
    car = F.when(s == "acv", F.nullif(F.element_at(F.split("_rank", r"\|"), 1), F.lit("")))
    damage = F.when((s == "shm") & (F.col("_damage") >= 0), F.col("_damage"))
    kind = F.when((s == "rail") & F.col("_class").isin(*CLASSES), F.col("_class"))
    out = rows.select(
        *FILE, "prediction_rows", "warnings_count",
        F.when(door, F.col("prediction_rows")).alias("total_actions"),
        F.when(door, F.col("_normal")).alias("normal_actions"),
        F.when(door, F.col("_abnormal")).alias("abnormal_actions"),
        F.when(door, F.col("prediction_rows") - F.col("_normal") - F.col("_abnormal")).alias("other_actions"),
        car.alias("first_car"), kind.alias("predicted_class"), damage.alias("damage"))
    result = F.coalesce(F.col("predicted_class"), F.col("first_car"), F.lit(""))
    value = F.when(door, F.col("abnormal_actions").cast("double")).when(s == "shm", F.col("damage"))
    return out.withColumns({"result": result, "sort_value": value})


def run_aggregates(files: DataFrame) -> DataFrame:
    """One row per run. The mean divides first, so large damages cannot overflow."""
    n = files.groupBy("run_id").agg(F.count("damage").alias("_nd"))
    shown = files.join(n, "run_id")
    s = F.col("subsystem")
    missing = ((s == "acv") & F.col("first_car").isNull()) | ((s == "rail") & F.col("predicted_class").isNull()) | (
        (s == "shm") & F.col("damage").isNull())
    return shown.groupBy("run_id", "subsystem").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("warnings_count") > 0).alias("files_with_warnings"),
        F.sum("prediction_rows").alias("prediction_rows"), F.sum("total_actions").alias("total_actions"),
        F.sum("abnormal_actions").alias("abnormal_actions"),
        *[F.count_if(F.col("predicted_class") == c).alias("class_" + c.lower().replace(" ", "_")) for c in CLASSES],
        F.count("damage").alias("damage_count"), F.min("damage").alias("damage_min"), F.max("damage").alias("damage_max"),
        F.sum(F.col("damage") / F.col("_nd")).alias("damage_mean"), F.count_if(missing).alias("missing_predictions"))


def first_rank_counts(files: DataFrame) -> DataFrame:
    return files.where("first_car is not null").groupBy("run_id", "first_car").agg(F.count(F.lit(1)).alias("files"))


def comparison_page(files: DataFrame, query: str | None = None, sort: str = "filename", offset: int = 0,
                    limit: int = 30) -> DataFrame:
    """A sorted, searched page of a run's files. Aggregates come from the unfiltered frame instead."""
    shown = files
    if query and query.strip():
        shown = shown.where(F.contains(F.lower(F.concat_ws(" ", "file_id", "result", "subsystem")), F.lit(query.strip().lower())))
    name = [natural_key("file_id"), F.col("file_id")]
    orders = {
        "filename": [],
        "result": [F.col("result").asc(),
                   F.coalesce("abnormal_actions", F.lit(0)).desc(), F.col("damage").desc_nulls_last()],
        "value-desc": [F.col("sort_value").desc_nulls_last()],
        "value-asc": [F.col("sort_value").asc_nulls_last()],
        "warnings-desc": [F.col("warnings_count").desc()],
    }
    return shown.orderBy(*orders[sort], *name).offset(offset).limit(limit)


def page_facts(files: DataFrame, query: str | None, offset: int, limit: int) -> DataFrame:
    """Matching files, files included and the next offset (null on the last page)."""
    shown = files
    if query and query.strip():
        shown = shown.where(F.contains(F.lower(F.concat_ws(" ", "file_id", "result", "subsystem")), F.lit(query.strip().lower())))
    n = F.col("matching")
    taken = F.least(F.lit(limit), F.greatest(F.lit(0), n - offset))
    return shown.agg(F.count(F.lit(1)).alias("matching")).select(
        "matching", taken.alias("included"), F.when(taken + offset < n, taken + offset).alias("next_offset"))


def valid_runs(runs: DataFrame) -> DataFrame:
    """Records that may appear in the catalogue; a damaged one never hides the others."""
    ok = (F.col("run_id").rlike(RUN_ID) & F.col("subsystem").isin(*SUBSYSTEMS) & F.col("status").isin(*RUN_STATES)
          & F.col("created_at").isNotNull() & (F.col("completed") >= 0) & (F.col("completed") <= F.col("total"))
          & (F.col("total") > 0) & ((F.col("status") != "completed") | (F.col("completed") == F.col("total"))))
    if "source" in runs.columns:
        ok = ok & F.col("source").isin(*RUN_SOURCES)
    return runs.where(F.coalesce(ok, F.lit(False)))


def newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("run_id").desc()]


def newest_runs(runs: DataFrame, limit: int = 40, subsystem: str | None = None) -> DataFrame:
    shown = runs if subsystem is None else runs.where(F.col("subsystem") == subsystem)
    return shown.orderBy(*newest_first()).limit(limit)


def latest_completed(runs: DataFrame) -> DataFrame:
    """The newest completed run of each subsystem, as a grouped maximum."""
    cols = [c for c in runs.columns if c != "subsystem"]
    top = runs.where("status = 'completed'").groupBy("subsystem").agg(
        F.max_by(F.struct(*cols), F.struct("created_at", "run_id")).alias("_r"))
    return top.select("subsystem", "_r.*")


def active_runs(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status").isin("queued", "running"))


def catalog_counts(runs: DataFrame, scanned: int = 100, shown: int = 30) -> DataFrame:
    """Totals and what a bounded newest-first view leaves out."""
    window = newest_runs(runs, scanned).agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("status") == "completed").alias("completed"))
    total = runs.agg(F.count(F.lit(1)).alias("total"))
    return total.crossJoin(F.broadcast(window)).select(
        "total", "scanned", "completed", F.greatest(F.lit(0), F.col("completed") - shown).alias("omitted"),
        (F.col("total") - F.col("scanned")).alias("not_scanned"))


def merged_history(library: DataFrame, recent: DataFrame) -> DataFrame:
    """Server rows win over saved links; newest first, earlier places first among equals."""
    rows = library.select("run_id", "subsystem", "created_at", "place", F.lit(0).alias("_p")).unionByName(
        recent.select("run_id", "subsystem", "created_at", "place", F.lit(1).alias("_p")))
    kept = rows.groupBy("run_id").agg(F.min_by(
        F.struct("subsystem", "created_at", F.col("_p").alias("source"), "place"), F.struct("_p", "place")).alias("_r"))
    return kept.select("run_id", "_r.*")


def scoped(p: DataFrame, selection: DataFrame) -> DataFrame:
    """Exactly the selected (run, file) pairs; a miss or an ambiguous name is an error, never 'all'."""
    keys = ["run_id", "file_id"]
    files = p.select(*keys).distinct()
    missing = selection.join(files, keys, "left_anti")
    twins = files.groupBy("run_id", F.lower("file_id").alias("_l")).count().where("count > 1")
    unclear = selection.withColumn("_l", F.lower("file_id")).join(twins, ["run_id", "_l"], "left_semi")
    counts = missing.agg(F.count(F.lit(1)).alias("m")).crossJoin(unclear.agg(F.count(F.lit(1)).alias("u"))).first()
    if counts["m"] or counts["u"]:
        raise ValueError(f"{counts['m']} selected files are not in their run; {counts['u']} are ambiguous.")
    return p.join(selection, keys, "left_semi")


def export_problems(runs: DataFrame, p: DataFrame, selection: DataFrame) -> DataFrame:
    """Every reason an export selection cannot be written: subsystem, problem, n."""
    keys = ["run_id", "file_id"]
    chosen = selection.join(runs.select("run_id", "subsystem", "status"), "run_id", "left")
    files = p.groupBy(*keys).agg(F.count_if(valid_prediction(p)).alias("valid"), F.count(F.lit(1)).alias("rows"))
    facts = chosen.join(files, keys, "left")
    each = facts.select("subsystem", F.explode(F.filter(F.array(
        F.when(F.col("subsystem").isNull(), "unknown run"),
        F.when(F.col("status") != "completed", "run not completed"),
        F.when(F.col("rows").isNull(), "file not in run"),
        F.when(F.col("valid") < F.col("rows"), "invalid predictions")), lambda x: x.isNotNull())).alias("problem"))
    repeated = facts.groupBy("subsystem", F.lower("file_id").alias("f")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "subsystem", F.lit("file selected twice").alias("problem"))
    streams = facts.where("subsystem = 'door'").groupBy("subsystem").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "subsystem", F.lit("more than one door stream").alias("problem"))
    return each.unionByName(repeated).unionByName(streams).groupBy("subsystem", "problem").agg(F.count(F.lit(1)).alias("n"))


def export_plan(p: DataFrame, selection: DataFrame) -> DataFrame:
    """Files and rows each output will hold."""
    rows = p.join(selection, ["run_id", "file_id"], "left_semi")
    per_file = rows.groupBy("subsystem", "run_id", "file_id").agg(F.count(F.lit(1)).alias("rows"))
    return per_file.groupBy("subsystem").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"))


def measurement(evidence: DataFrame, identifier: str, unit: str, nonnegative: bool = False) -> DataFrame:
    """The one finite value with this id and unit per file; several matches count as none."""
    named = evidence.where(F.col("id") == identifier)
    ok = (F.col("unit") == unit) & finite("value").isNotNull()
    if nonnegative:
        ok = ok & (F.col("value") >= 0)
    return named.groupBy("run_id", "file_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.when(ok, F.col("value"))).alias("value")).where(
        (F.col("_n") == 1) & F.col("value").isNotNull()).drop("_n")


def run_range(measured: DataFrame) -> DataFrame:
    """Range of a measurement over a run's files, as numbers and as text."""
    return measured.groupBy("run_id").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("files")).withColumn(
        "text", range_text("low", "high"))


# The texts of the sentences below are fixed values.
def run_sentence(aggregates: DataFrame) -> DataFrame:
    """One sentence per run with its counts."""
    s, files = F.col("subsystem"), counted("files", "file")
    verb = F.when(F.col("total_actions") == 1, "detected door movement was").otherwise("detected door movements were")
    door = F.concat(files, F.lit(": "), F.col("abnormal_actions").cast("string"), F.lit(" of "),
                    F.col("total_actions").cast("string"), F.lit(" "), verb, F.lit(" flagged for abnormal resistance."))
    rail = F.concat(files, F.lit(": "), F.col("class_normal").cast("string"), F.lit(" classified Normal, "),
                    F.col("class_side_i").cast("string"), F.lit(" Side I corrugation, and "),
                    F.col("class_side_ii").cast("string"), F.lit(" Side II corrugation."))
    shm = F.concat(files, F.lit(": estimated fatigue damage spans approximately "), range_text("damage_min", "damage_max"),
                   F.lit("; these are separate recording estimates, not percentages or remaining lifetimes."))
    acv = F.concat(files, F.lit(": "), counted(F.col("files") - F.col("missing_predictions"), "cooling ranking"), F.lit("."))
    return aggregates.select("run_id", "subsystem", F.when(s == "door", door).when(s == "rail", rail).when(
        s == "shm", shm).otherwise(acv).alias("sentence"))


# Warning text that limits how a result may be read, with its short form.
CAUTIONS = {
    "door": (("Observed cadence differs substantially from training", "sampling differs from training"),
             ("Its true action count is unknown", "the true movement count is unknown"),
             ("inferred segments contain fewer than three readings", "some actions have too few readings")),
    "shm": (("outside the observed training-target range", "the estimate is outside the training range"),
            ("outside the validated equal-length setting", "recording length differs from training"),
            ("No alternating stress cycles were counted", "no alternating stress cycles were found")),
}


def caution(subsystem: str | Column, warnings: str | Column) -> Column:
    """Short caution from a file's warnings; null when none of them limits the result."""
    s = F.col(subsystem) if isinstance(subsystem, str) else subsystem
    text = F.array_join(F.col(warnings) if isinstance(warnings, str) else warnings, " ")
    flags = F.array_compact(F.array(*[
        F.when((s == task) & F.contains(text, F.lit(long)), short) for task, pairs in CAUTIONS.items() for long, short in pairs]))
    return F.when(F.size(flags) > 0, F.concat(
        F.lit("Check input limits: "), F.array_join(flags, "; "), F.lit(". Review the analysis notes before using this result.")))


def file_sentence(files: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """One sentence per file with its counts, first car, class or damage, and a key measurement.

    measured: run_id, file_id, text (from measured_sentence), joined when given.
    """
    s = F.col("subsystem")
    verb = F.when(F.col("total_actions") == 1, "detected door movement was").otherwise("detected door movements were")
    door = F.concat(F.col("abnormal_actions").cast("string"), F.lit(" of "), F.col("total_actions").cast("string"), F.lit(" "), verb,
                    F.lit(" flagged for abnormal resistance."))
    rail = F.when(F.col("predicted_class") == "Normal", "The recording is classified as Normal; no rail corrugation is predicted.").otherwise(
        F.concat(F.lit("The recording is classified as "), F.col("predicted_class"), F.lit(" rail corrugation.")))
    shm = F.concat(F.lit("The estimated cumulative fatigue damage is approximately "), number_text("damage"),
                   F.lit("; it is not a percentage or remaining lifetime."))
    acv = F.concat(F.lit("Car "), F.col("first_car"), F.lit(" appears first in the recorded ranking; cooling-reading availability is not recorded."))
    text = F.when(s == "door", door).when(s == "rail", rail).when(s == "shm", shm).otherwise(acv)
    out = files.withColumn("_s", F.coalesce(text, F.lit("No complete prediction is available for this recording.")))
    if measured is not None:
        out = out.join(measured.select("run_id", "file_id", F.col("text").alias("_m")), ["run_id", "file_id"], "left")
        out = out.withColumn("_s", F.concat_ws(" ", "_s", "_m"))
    return out.select(*FILE, F.col("_s").alias("sentence"))


def measured_sentence(evidence: DataFrame) -> DataFrame:
    """Stress level and cycle count of a recording as text."""
    rms = measurement(evidence, "shm-rms", "raw stress units", True).withColumnRenamed("value", "_rms")
    cycles = measurement(evidence, "shm-cycles", "cycles including half cycles", True).withColumnRenamed("value", "_cycles")
    both = rms.join(cycles, ["run_id", "file_id"], "full_outer")
    a = F.concat(F.lit("Stress level (RMS): about "), number_text("_rms"), F.lit(" raw stress units"))
    b = F.concat(F.lit("rainflow count: about "), number_text("_cycles"), F.lit(" cycles"))
    return both.select("run_id", "file_id", F.concat(F.array_join(F.array_compact(F.array(a, b)), "; "), F.lit(".")).alias("text"))


# Identifiers of the measurements a summary may name, with the unit each must have; those of cabin
# temperatures alone may be negative.
ACTION_MEASURE = r"^door-action-([0-9]+)-(current|duration)$"
MEASURE_UNITS = {"current": "mA", "duration": "seconds", "door-cadence": "seconds", "rail-side-1-vibration": "m/s²",
                 "rail-side-2-vibration": "m/s²", "acv-coverage": "cars", "shm-rms": "raw stress units",
                 "shm-cycles": "cycles including half cycles"}
CAR_UNIT = "raw temperature units"


def measured_facts(files: DataFrame, evidence: DataFrame, flagged: DataFrame) -> DataFrame:
    """Measured facts and their sentence of every file that has some, all tasks in one pass.

    files: run_id, file_id, subsystem, first_car, predicted_class; evidence: run_id, file_id, id,
    value, unit; flagged: run_id, file_id, action, the numbers of the door actions flagged. A
    measurement counts only if its id occurs once in the file, with its unit and a usable value. Door
    files name the first flagged action with a current, others the sampling interval; cooling files
    the first car, unless no car is usable; rail files the side of their class, or both.
    """
    key = ["run_id", "file_id"]
    part = [F.regexp_extract("id", ACTION_MEASURE, i) for i in (1, 2)]
    name = F.when(part[1] != "", part[1]).otherwise(F.col("id"))
    unit = F.when(F.startswith("_name", F.lit("acv-car-")), CAR_UNIT).otherwise(
        F.create_map(*[F.lit(x) for pair in MEASURE_UNITS.items() for x in pair])[F.col("_name")])
    rows = evidence.select(*key, "id", "value", "unit", part[0].try_cast("long").alias("action"), name.alias("_name"))
    usable = (F.col("unit") == unit) & finite("value").isNotNull() & (F.startswith("_name", F.lit("acv-car-")) | (F.col("value") >= 0))
    one = rows.groupBy(*key, "_name", "action", "id").agg(
        F.count(F.lit(1)).alias("_k"), F.max(F.when(usable, F.col("value"))).alias("value")).where("_k = 1 and value is not null")
    # Only flagged actions speak; the current and duration of one meet in a group of two rows.
    acts = one.where("action is not null").join(flagged.select(*key, "action").distinct(), [*key, "action"], "left_semi")
    acts = acts.groupBy(*key, "action").agg(*[F.max(F.when(F.col("_name") == n, F.col("value"))).alias(n) for n in ("current", "duration")])
    first = acts.where("current is not null").groupBy(*key).agg(F.min(F.struct("action", "current", "duration")).alias("_first"))
    info = files.select(*key, "subsystem", "first_car", "predicted_class")

    def value_of(name: str | Column) -> Column:
        return F.max(F.when(F.col("_name") == name, F.col("value")))

    known = one.where("action is null").join(info.select(*key, "first_car"), key)
    rest = known.groupBy(*key).agg(
        value_of("door-cadence").alias("_step"), value_of("rail-side-1-vibration").alias("_one"), value_of("rail-side-2-vibration").alias("_two"),
        value_of("acv-coverage").alias("_usable"), value_of(F.concat(F.lit("acv-car-"), F.col("first_car"))).alias("_car"),
        value_of("shm-rms").alias("_rms"), value_of("shm-cycles").alias("_cycles"))
    r = info.join(rest, key, "left").join(first, key, "left")
    s, text = F.col("subsystem"), number_text
    a = F.col("_first")
    over = F.coalesce(F.concat(F.lit(" over about "), text(a["duration"]), F.lit(" s.")), F.lit("."))
    door = F.when(a.isNotNull(), F.concat(F.lit("Flagged movement "), a["action"].cast("string"), F.lit(": peak motor current about "),
                                          text(a["current"]), F.lit(" mA"), over)).when(
        F.col("_step") > 0, F.concat(F.lit("Median sampling interval: about "), text("_step"), F.lit(" s.")))
    acv = F.when(F.coalesce("_usable", F.lit(1.0)) != 0, F.concat(
        F.lit("Median cabin temperature minus target: about "), text("_car"), F.lit(" raw temperature units.")))
    label = F.col("predicted_class")
    sides = F.array_compact(F.array(
        F.when(label.isin("Normal", "Side I"), F.concat(F.lit("Side I about "), text("_one"))),
        F.when(label.isin("Normal", "Side II"), F.concat(F.lit("Side II about "), text("_two")))))
    rail = F.when(F.size(sides) > 0, F.concat(F.lit("Typical vibration (median RMS): "), F.array_join(sides, ", "), F.lit(" m/s².")))
    parts = F.array_compact(F.array(
        F.concat(F.lit("Stress level (RMS): about "), text("_rms"), F.lit(" raw stress units")),
        F.concat(F.lit("rainflow count: about "), text("_cycles"), F.lit(" cycles"))))
    shm = F.when(F.size(parts) > 0, F.concat(F.array_join(parts, "; "), F.lit(".")))
    is_door, is_rail, is_acv = s == "door", s == "rail", (s == "acv") & (F.coalesce("_usable", F.lit(1.0)) != 0)
    out = r.select(
        *key, "subsystem", F.when(is_door, a["action"]).alias("flagged_action"), F.when(is_door, a["current"]).alias("peak_current_ma"),
        F.when(is_door, a["duration"]).alias("duration_s"),
        F.when(is_door & a.isNull() & (F.col("_step") > 0), F.col("_step")).alias("sample_interval_s"),
        F.when(is_acv, F.col("_car")).alias("first_car_difference"), F.when(is_rail, F.col("_one")).alias("side_1_rms"),
        F.when(is_rail, F.col("_two")).alias("side_2_rms"), F.when(s == "shm", F.col("_rms")).alias("stress_rms"),
        F.when(s == "shm", F.col("_cycles")).alias("rainflow_cycles"),
        F.when(is_door, door).when(is_rail, rail).when(s == "acv", acv).when(s == "shm", shm).alias("text"))
    return out.where("text is not null")


def default_basket(runs: DataFrame, p: DataFrame) -> DataFrame:
    """Files of the newest completed run of each subsystem: the initial export choice."""
    chosen = latest_completed(runs).select("run_id")
    return p.join(chosen, "run_id", "left_semi").select("subsystem", "run_id", "file_id").distinct()

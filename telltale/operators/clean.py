"""Header rules, parsing, range guards and labelled edits of telemetry."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from telltale.functions.columns import col, hash_rank, micros, to_numeric
from telltale.functions.quantiles import select_by_weight
from telltale.session import materialize

# Sensors known by name with label, unit and component.
SENSOR_INFO = {
    "vibration_mm_s": ("Vibration RMS", "mm/s", "bogies"),
    "bearing_temp_c": ("Bearing temperature", "°C", "bogies"),
    "door_current_a": ("Door motor current", "A", "doors"),
    "door_cycle_s": ("Door cycle duration", "s", "doors"),
    "brake_pressure_bar": ("Brake pressure", "bar", "brakes"),
    "brake_temp_c": ("Brake temperature", "°C", "brakes"),
    "motor_current_a": ("Traction motor current", "A", "motors"),
    "motor_temp_c": ("Motor temperature", "°C", "motors"),
}
# Operating context, used as model input but not as a sensor.
CONTEXT_COLUMNS = ("speed_kmh", "ambient_temp_c")
# Names that describe or label a row and therefore never become sensors.
METADATA_COLUMNS = (
    "timestamp", "time", "datetime", "date", "recorded_at", "train_id", "train", "train_name", "line", "component",
    "component_id", "id", "index", "row", "row_id", "scenario", "source", "split", "status", "health", "risk",
    "anomaly_score", "label", "labels", "target", "class", "y", "fault", "failure", "anomaly", "is_anomaly",
    "is_fault", "fault_code", "fault_type", "injected_anomaly", "train_no", "train_number", "train_set", "car",
    "car_no", "car_number", "bogie", "bogie_number", "axle", "axle_number", "component_no", "component_number",
    "sequence", "seq", "sample_number", "faulty", "is_faulty", "ground_truth", "groundtruth", "lat", "latitude",
    "gps_lat", "gps_latitude", "latitude_deg", "latitude_degrees", "lon", "lng", "long", "longitude", "gps_lon",
    "gps_lng", "gps_longitude", "longitude_deg", "longitude_degrees", "route", "route_id", "route_position",
    "station", "station_id", "direction", "heading", "gps_accuracy",
)
# Order in which a time column is looked for.
TIME_COLUMNS = ("timestamp", "datetime", "recorded_at", "time", "date")
# Outcome words, as prefixes, suffixes or whole words of a name.
OUTCOME_PREFIXES = ("fault", "failure", "anomaly", "injected", "target", "groundtruth")
OUTCOME_SUFFIXES = ("label", "labels")
OUTCOME_WORDS = ("label", "target", "fault", "failure", "injected", "anomaly")

RANGE_LIMIT = 1e12


def squash(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch.isascii() and ch.isalnum())


RESERVED = {squash(name) for name in (*METADATA_COLUMNS, *CONTEXT_COLUMNS)}


def excluded_column(name: str) -> bool:
    """True for identifiers, context, coordinates and anything that names an outcome."""
    words = [w for w in re.split(r"[\s_-]+", name.strip().lower())]
    bare = squash(name)
    return (
        bare in RESERVED
        or (len(words) > 1 and words[-1] == "id")
        or bare.startswith(OUTCOME_PREFIXES)
        or bare.endswith(OUTCOME_SUFFIXES)
        or any(word in OUTCOME_WORDS for word in words)
        or name.strip().lower().startswith("unnamed:")
    )


def normalize_columns(df: DataFrame, style: str = "lower") -> DataFrame:
    """Trim and lower-case (telemetry) or compact (streams) every header; clashes are an error."""
    names = [squash(c) if style == "compact" else c.strip().lower() for c in df.columns]
    if len(set(names)) != len(names) or not all(names):
        raise ValueError("Column names must be present and unique after normalisation.")
    return df.toDF(*names)


def discover_sensors(df: DataFrame) -> tuple[list[str], list[str]]:
    """Sensor columns and warnings, from one aggregation over all candidate columns."""
    candidates = [c for c in df.columns if not c.startswith("_") and not excluded_column(c)]
    if not candidates:
        raise ValueError("No usable numeric sensor measurements were found.")
    facts = df.agg(*[F.count(to_numeric(c)).alias(f"n{i}") for i, c in enumerate(candidates)],
                   *[F.count(F.col(c)).alias(f"p{i}") for i, c in enumerate(candidates)]).first()
    sensors, warnings = [], []
    for i, name in enumerate(candidates):
        numeric, provided = facts[f"n{i}"], facts[f"p{i}"]
        if name in SENSOR_INFO or numeric:
            sensors.append(name)
            if name not in SENSOR_INFO and numeric < 0.5 * max(1, provided):
                warnings.append(f"{name}: retained {numeric} numeric measurements despite mostly non-numeric cells")
    if not any(facts[f"n{i}"] for i in range(len(candidates))):
        raise ValueError("No usable numeric sensor measurements were found.")
    return sensors, warnings


def range_guard(df: DataFrame, columns: list[str], limit: float = RANGE_LIMIT) -> DataFrame:
    """Raise when any value exceeds the supported magnitude; one counting job."""
    beyond = df.agg(*[F.count_if(F.abs(F.col(c)) > limit).alias(c) for c in columns]).first().asDict()
    bad = [c for c, n in beyond.items() if n]
    if bad:
        raise ValueError(f"Values exceed the supported numeric range in: {', '.join(bad)}")
    return df


def parse_telemetry_time(text: str | Column) -> Column:
    """Explicit dates only: a bare number is ambiguous and stays null. Zone-less text is UTC."""
    t = F.trim(col(text))
    known = F.coalesce(
        F.try_to_timestamp(t),
        *[F.try_to_timestamp(t, F.lit(f)) for f in (
            "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "dd MMM yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy")])
    return F.when(~t.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), known)


def has_zone(text: str | Column) -> Column:
    t = col(text)
    return t.rlike(r"[T\s][0-9]{1,2}:[0-9]{2}") & t.rlike(r"(?i)(Z|UTC|GMT|[+-][0-9]{2}(:?[0-9]{2})?)\s*$")


def parse_native_time(text: str | Column) -> Column:
    """`Y-M-D-h-m-s-ms` with a whole millisecond field, else ISO text without a zone."""
    t = F.trim(col(text))
    p = F.split(t, "-")
    n = [F.get(p, F.lit(i)).try_cast("int") for i in range(7)]
    native = (n[6] >= 0) & (n[6] <= 999)
    joined = F.concat(
        F.format_string("%04d-%02d-%02d %02d:%02d:%02d", *n[:6]), F.format_string(".%03d", n[6]))
    zone = t.rlike(r"(Z|[+-][0-9]{2}(:?[0-9]{2})?)$") & t.rlike(r"[T ][0-9]{1,2}:[0-9]{2}")
    return (F.when(t.rlike(r"^[0-9]{4}(-[0-9]+){6}$"), F.when(native, joined.try_cast("timestamp_ntz")))
            .when(~zone, t.try_cast("timestamp_ntz")))


def format_native_time(ts: str | Column) -> Column:
    t = col(ts)
    millis = F.floor(micros(t) / 1000) % 1000
    return F.concat_ws("-", *[c.cast("string") for c in (
        F.year(t), F.month(t), F.day(t), F.hour(t), F.minute(t), F.second(t), millis)])


def default_identity(df: DataFrame) -> DataFrame:
    """A missing identifier column gets one constant; a blank cell becomes an explicit unknown."""
    for name, constant in (("train_id", "Uploaded train"), ("component", "general")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(constant))
        else:
            shown = F.nullif(F.trim(F.col(name)), F.lit(""))
            df = df.withColumn(name, F.coalesce(shown, F.lit(f"Unknown {name.replace('_', ' ')}")))
    return df


def coordinate(text: str | Column) -> Column:
    """Trace x value: numeric text, else ISO date-time as epoch milliseconds, else null."""
    t = F.trim(col(text))
    stamp = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]"), F.unix_micros(F.try_to_timestamp(t)) / 1000.0)
    return F.when(t == "", None).otherwise(F.coalesce(to_numeric(t), stamp))


def search_filter(df: DataFrame, columns: list[str], query: str, status: str = "all") -> DataFrame:
    """Case-insensitive contains over the joined text, plus a status group."""
    kept = df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.strip().lower())))
    if status == "attention":
        return kept.where(F.col("status").isin("critical", "warning"))
    return kept if status == "all" else kept.where(F.col("status") == status)


def inject_offsets(df: DataFrame, sensor: str, offsets: list[tuple[str, str, float]], start: str) -> DataFrame:
    """Add a fixed offset per (train, component) from a time on, and mark the rows touched."""
    late = F.col("ts") >= F.lit(start).cast("timestamp_ntz")
    amount = F.coalesce(*[
        F.when(late & (F.col("train_id") == t) & (F.col("component") == c), F.lit(float(m)))
        for t, c, m in offsets], F.lit(0.0))
    return df.withColumn(sensor, F.col(sensor) + amount).withColumn("injected", (amount != 0).cast("int"))


def inject_ramps(df: DataFrame, schedule: list[dict]) -> DataFrame:
    """Ramped edits: from a fraction of each group's own rows on, drift or a sustained shift.

    A schedule entry has train_id, component, kind (drift or sustained), start_fraction and
    offsets {sensor: magnitude}. The position within the group comes from a running count.
    """
    from telltale.functions.ordered import scan, time_chunk

    groups = F.lit(False)
    for item in schedule:
        groups = groups | ((F.col("train_id") == item["train_id"]) & (F.col("component") == item["component"]))
    touched, rest = df.where(groups), df.where(~groups)
    keys = ["train_id", "component"]
    counts = touched.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = scan(touched, keys, ["ts", "ord"], time_chunk("ts"), position="_pos").join(F.broadcast(counts), keys)
    marked = F.lit(0)
    edits: dict[str, Column] = {}
    for item in schedule:
        mine = (F.col("train_id") == item["train_id"]) & (F.col("component") == item["component"])
        start = F.least(F.col("_n") - 1, F.ceil(F.col("_n") * item["start_fraction"]))
        i = F.col("_pos") - 1 - start
        length = F.col("_n") - start
        drift = F.when(length > 1, 0.05 + i * (0.95 / (length - 1))).otherwise(F.lit(0.05))
        steady = F.least(F.lit(1.0), 0.65 + i / F.greatest(F.lit(1.0), F.col("_n") * 0.06))
        ramp = drift if item["kind"] == "drift" else steady
        marked = F.when(mine & (i >= 0), 1).otherwise(marked)
        for sensor, magnitude in item["offsets"].items():
            now = edits.get(sensor, F.col(sensor))
            edits[sensor] = F.when(mine & (i >= 0), F.round(F.col(sensor) + magnitude * ramp, 4)).otherwise(now)
    changed = rows.withColumns({**edits, "injected": marked}).drop("_pos", "_n")
    return changed.unionByName(rest.withColumn("injected", F.lit(0)))


def mask_gaps(df: DataFrame, sensors: list[str], share: int = 30, seed: int = 42) -> DataFrame:
    """Blank one in `share` cells of every sensor per component, chosen by a stable draw.

    The draw's n-th smallest value is the cut, so no component is ordered in one task.
    """
    for sensor in sensors:
        draw = hash_rank(F.concat_ws(":", F.col("ord").cast("string"), F.lit(sensor), F.lit(str(seed))))
        rows = df.withColumn("_draw", draw)
        cut = materialize(select_by_weight(rows, ["component"], "_draw", {
            "_cut": F.greatest(F.lit(1), F.floor(F.col("n") / share))}).select("component", "_cut"))
        df = (rows.join(cut, "component", "left")
              .withColumn(sensor, F.when(F.col("_draw") <= F.col("_cut"), None).otherwise(F.col(sensor)))
              .drop("_draw", "_cut"))
    return df

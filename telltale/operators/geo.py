"""Latest positions, stations, lines and polygon centres."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from telltale.functions.columns import compact, hash_fraction

# Header names of coordinates, compacted.
LATITUDE = ("lat", "latitude", "gpslat", "gpslatitude", "latitudedeg", "latitudedegrees")
LONGITUDE = ("lon", "lng", "long", "longitude", "gpslon", "gpslng", "gpslongitude", "longitudedeg", "longitudedegrees")
# Map extent, metres per degree, reach of a station.
EXTENT = (1.14, 1.50, 103.53, 104.51)
METRES_LAT, METRES_LNG = 110_574, 111_280
STATION_REACH_M = 1500
# Largest station table (rows) that is sent to every task; beyond it stations are joined by map cell.


def coordinate_columns(columns: list[str]) -> tuple[str, str] | None:
    """The one latitude and one longitude column, or None when either is missing or ambiguous."""
    from telltale.operators.clean import squash

    lat = [c for c in columns if squash(c) in LATITUDE]
    lng = [c for c in columns if squash(c) in LONGITUDE]
    return (lat[0], lng[0]) if len(lat) == 1 and len(lng) == 1 else None


def in_extent(lat: str | Column, lng: str | Column) -> Column:
    a, b, c, d = EXTENT
    lat = F.col(lat) if isinstance(lat, str) else lat
    lng = F.col(lng) if isinstance(lng, str) else lng
    return F.coalesce(lat.between(a, b) & lng.between(c, d), F.lit(False))


def metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return F.hypot((lat1 - lat2) * METRES_LAT, (lng1 - lng2) * METRES_LNG)


def latest_positions(fixes: DataFrame) -> DataFrame:
    """Each train's fix at its latest time; conflicting valid pairs leave it out.

    The line is kept when exactly one is named at that time. Grouped maxima are joined
    back instead of a window, so a busy train is no bottleneck.
    """
    last = fixes.groupBy("train_id").agg(F.max("ts").alias("ts"))
    rows = fixes.join(last, ["train_id", "ts"])
    pair = F.when(in_extent("lat", "lng"), F.struct("lat", "lng"))
    facts = rows.groupBy("train_id", "ts").agg(
        F.min(pair).alias("_lo"), F.max(pair).alias("_hi"), F.min("line").alias("_l0"), F.max("line").alias("_l1"))
    ok = F.col("_lo").isNotNull() & (F.col("_lo") == F.col("_hi"))
    return facts.where(ok).select(
        "train_id", "ts", F.col("_lo.lat").alias("lat"), F.col("_lo.lng").alias("lng"),
        F.when(F.col("_l0") == F.col("_l1"), F.col("_l0")).alias("line"))


def with_line(df: DataFrame, lines: DataFrame, name: str = "line") -> DataFrame:
    """Line id by compacted id or name; the first line listed wins."""
    keys = lines.select("id", "ordinal", F.explode(F.array_distinct(F.array(compact("id"), compact("name")))).alias("_key"))
    first = keys.groupBy("_key").agg(F.min_by("id", "ordinal").alias("line_id"))
    return df.withColumn("_key", compact(name)).join(first, "_key", "left").drop("_key")


def nearest_station(points: DataFrame, stations: DataFrame, key: list[str]) -> DataFrame:
    """Nearest station within reach, on the point's line when that is known.

    Candidates come from the map cells within reach of the point, so a point meets only
    the stations around it; the planner picks how the two meet.
    """
    cell_lat, cell_lng = STATION_REACH_M / METRES_LAT, STATION_REACH_M / METRES_LNG
    placed = stations.select(
        F.col("id").alias("station_id"), F.col("ordinal"), F.col("lat").alias("_slat"), F.col("lng").alias("_slng"), "lines",
        F.floor(F.col("lat") / cell_lat).alias("_a"), F.floor(F.col("lng") / cell_lng).alias("_b"))
    around = points.withColumn("_a", F.explode(F.sequence(
        F.floor(F.col("lat") / cell_lat) - 1, F.floor(F.col("lat") / cell_lat) + 1))).withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("lng") / cell_lng) - 1, F.floor(F.col("lng") / cell_lng) + 1)))
    d = metres(F.col("lat"), F.col("lng"), F.col("_slat"), F.col("_slng"))
    served = F.col("line").isNull() | F.array_contains("lines", F.col("line"))
    near = around.join(placed, ["_a", "_b"]).where(served).withColumn("_d", d).where(F.col("_d") <= STATION_REACH_M)
    best = near.groupBy(*key).agg(
        F.min_by("station_id", F.struct("_d", "ordinal")).alias("station_id"), F.min("_d").alias("distance_m"))
    return points.join(best, key, "left")


def path_points(vertices: DataFrame, fractions: DataFrame) -> DataFrame:
    """Position at a fraction of each line's length. A line is a drawn path of bounded length.

    vertices: line, seq, lat, lng; fractions: key, line, fraction.
    """
    w = Window.partitionBy("line").orderBy("seq")
    seg = vertices.select(
        "line", "seq", "lat", "lng", F.lead("lat").over(w).alias("lat2"), F.lead("lng").over(w).alias("lng2"))
    seg = seg.withColumn("len", metres(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"))).where("lat2 is not null")
    upto = F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0))
    seg = seg.withColumn("_upto", upto)
    total = seg.groupBy("line").agg(F.sum("len").alias("_total"), F.max_by("lat2", "seq").alias("_elat"), F.max_by("lng2", "seq").alias("_elng"))
    goal = fractions.join(total, "line").withColumn("_goal", F.col("fraction") * F.col("_total"))
    hit = goal.join(seg, "line").where((F.col("len") > 0) & (F.col("_upto") >= F.col("_goal")))
    first = hit.groupBy("key", "line", "fraction").agg(F.min_by(
        F.struct("lat", "lng", "lat2", "lng2", "len", "_upto", "_goal"), "seq").alias("_s"))
    ratio = F.greatest(F.lit(0.0), 1 - (F.col("_s._upto") - F.col("_s._goal")) / F.col("_s.len"))
    return goal.join(first, ["key", "line", "fraction"], "left").select(
        "key", "line", "fraction",
        F.coalesce(F.col("_s.lat") + ratio * (F.col("_s.lat2") - F.col("_s.lat")), F.col("_elat")).alias("lat"),
        F.coalesce(F.col("_s.lng") + ratio * (F.col("_s.lng2") - F.col("_s.lng")), F.col("_elng")).alias("lng"))


def stable_fraction(key: str | Column) -> Column:
    """A stable place on a path, clear of both ends."""
    return 0.08 + hash_fraction(key) * 0.84


def ring_centroids(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Area centroid and area per ring (keys, seq, x, y); a flat ring gives its mean and area 0.

    Coordinates are taken relative to the ring's first vertex before multiplying.
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    origin = vertices.groupBy(*keys).agg(F.min_by(F.struct("x", "y"), "seq").alias("_o"))
    v = vertices.join(origin, keys).withColumns({"_x": F.col("x") - F.col("_o.x"), "_y": F.col("y") - F.col("_o.y")})
    v = v.withColumns({"_xn": F.coalesce(F.lead("_x").over(w), F.lit(0.0)), "_yn": F.coalesce(F.lead("_y").over(w), F.lit(0.0))})
    cross = F.col("_x") * F.col("_yn") - F.col("_xn") * F.col("_y")
    sums = v.withColumn("_c", cross).groupBy(*keys, "_o").agg(
        F.sum("_c").alias("_a"), F.sum((F.col("_x") + F.col("_xn")) * F.col("_c")).alias("_sx"),
        F.sum((F.col("_y") + F.col("_yn")) * F.col("_c")).alias("_sy"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
    flat = F.abs("_a") < 1e-15
    return sums.select(
        *keys, (F.when(flat, F.col("_mx")).otherwise(F.col("_sx") / (3 * F.col("_a"))) + F.col("_o.x")).alias("x"),
        (F.when(flat, F.col("_my")).otherwise(F.col("_sy") / (3 * F.col("_a"))) + F.col("_o.y")).alias("y"),
        F.when(flat, F.lit(0.0)).otherwise(F.abs("_a") / 2).alias("area"))


def largest_part(centroids: DataFrame, keys: list[str]) -> DataFrame:
    """The part with the largest area; ties go to the larger x, then y."""
    return centroids.groupBy(*keys).agg(F.max_by(F.struct("x", "y", "area"), F.struct("area", "x", "y")).alias("_p")).select(
        *keys, "_p.*")


def weighted_centre(centroids: DataFrame, keys: list[str]) -> DataFrame:
    """Area-weighted centre of a station's footprints; the plain mean when none has an area."""
    a = F.sum("area")
    return centroids.groupBy(*keys).agg(
        F.when(a > 0, F.sum(F.col("x") * F.col("area")) / a).otherwise(F.avg("x")).alias("x"),
        F.when(a > 0, F.sum(F.col("y") * F.col("area")) / a).otherwise(F.avg("y")).alias("y"), a.alias("area"))

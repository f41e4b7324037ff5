"""Groups of identical and near-identical recordings.

Two recordings belong together when their samples are equal, or when they have the same
length and both the sketch and the moments differ by at most one thousandth. A group is
what chains of such pairs connect.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from telltale.session import materialize

TOLERANCE = 1e-3
SLACK = 1.01
CELL = 8  # cell width in tolerances: most recordings look up one cell per axis


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def _apart(a: Column, b: Column) -> Column:
    """Relative distance of two arrays; different lengths are never near."""
    diff = _norm(F.zip_with(a, b, lambda x, y: x - y))
    scale = F.greatest(_norm(a), _norm(b), F.lit(1e-12))
    return F.when(F.size(a) == F.size(b), diff / scale).otherwise(F.lit(float("inf")))


def _axes(df: DataFrame) -> DataFrame:
    """Log length and three projections of the direction; near recordings are near on each."""
    size = F.greatest(_norm(F.col("sketch")), F.lit(1e-12))
    n = F.sqrt(F.size("sketch").cast("double"))

    def along(stride: int) -> Column:
        signed = F.transform(F.col("sketch"), lambda x, i: F.when((i / stride).cast("int") % 2 == 0, x).otherwise(-x))
        return F.aggregate(signed, F.lit(0.0), lambda a, x: a + x) / n / size

    return df.withColumns({"_x0": F.log(size), "_x1": along(1), "_x2": along(2), "_x3": along(4)})


AXES = ("_x0", "_x1", "_x2", "_x3")


def exact_links(records: DataFrame) -> DataFrame:
    """Every copy linked to the first file of its content: one row per copy, never pairs."""
    first = records.groupBy("numeric_sha256").agg(F.min("filename").alias("root"))
    return records.select("filename", "numeric_sha256").join(first, "numeric_sha256").select("filename", "root")


def _candidate_pairs(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """Pairs (a < b) of the same length whose cells on all axes are within reach."""
    width = CELL * TOLERANCE
    own = [F.floor(F.col(x) / width).alias(f"_c{i}") for i, x in enumerate(AXES)]
    a = left.select("n_samples", F.col("filename").alias("a"), F.col("sketch").alias("sa"),
                    F.col("signature").alias("ga"), *own)
    b = right.select("n_samples", F.col("filename").alias("b"), F.col("sketch").alias("sb"),
                     F.col("signature").alias("gb"), *AXES)
    for i, x in enumerate(AXES):
        b = b.withColumn(f"_c{i}", F.explode(F.sequence(
            F.floor((F.col(x) - reach) / width), F.floor((F.col(x) + reach) / width))))
    return a.join(b.drop(*AXES), ["n_samples", *[f"_c{i}" for i in range(len(AXES))]]).where(F.col("a") < F.col("b"))


def _distances(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"ds": _apart(F.col("sa"), F.col("sb")), "dg": _apart(F.col("ga"), F.col("gb"))})


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest member as the label of each connected set: filename, label.

    Minimum labels travel along the links and are then followed to their own label
    (pointer jumping), so long chains shorten quickly. Every round is written to the
    shared folder; grouped minima combine map-side and the skew join splits a hot node.
    """
    both = materialize(links.select("filename", "root").union(links.select("root", "filename")).where(
        F.col("filename") != F.col("root")).distinct())
    labels = materialize(nodes.select("filename", F.col("filename").alias("label")))
    while True:
        offered = both.join(labels.withColumnRenamed("filename", "root"), "root").groupBy("filename").agg(
            F.min("label").alias("_offer"))
        lower = labels.join(offered, "filename", "left").select(
            "filename", F.col("label").alias("_old"), F.least("label", "_offer").alias("_new"))
        lower = materialize(lower)
        jump = lower.select(F.col("filename").alias("_new"), F.col("_new").alias("_jump"))
        now = materialize(lower.join(jump, "_new", "left").select(
            "filename", F.least("_new", F.coalesce("_jump", "_new")).alias("label"),
            (F.least("_new", F.coalesce("_jump", "_new")) != F.col("_old")).alias("_moved")))
        labels = now.select("filename", "label")
        if now.where("_moved").isEmpty():
            return labels


def duplicate_groups(records: DataFrame) -> DataFrame:
    """filename and group (its smallest member's name) for every recording.

    Copies collapse to one representative. In each cell a pivot takes over for all
    recordings within half the tolerance, which are then near each other as well, so a
    crowd of near-copies adds one link per member. Pivots and the remaining recordings
    are compared with their neighbour cells. Only where two pivots are more than one and
    at most two tolerances apart, and not yet connected, are their members looked at.
    """
    columns = ["filename", "n_samples", "sketch", "signature", "numeric_sha256"]
    records = materialize(records.select(*columns))
    copies = exact_links(records)
    first = _axes(records.join(copies.where("filename = root").select("filename"), "filename", "left_semi"))
    cells = [F.floor(F.col(x) / (CELL * TOLERANCE)).alias(f"_c{i}") for i, x in enumerate(AXES)]
    keyed = first.select("*", *cells)
    keys = ["n_samples", *[f"_c{i}" for i in range(len(AXES))]]
    pivots = keyed.groupBy(*keys).agg(F.min(F.struct("filename", "sketch", "signature")).alias("_p"))
    placed = keyed.join(pivots, keys)
    half = TOLERANCE / 2

    def within(a: str, b: str) -> Column:
        gap = _norm(F.zip_with(F.col(a), F.col(b), lambda x, y: x - y))
        return gap <= half * F.greatest(_norm(F.col(a)), F.lit(1e-12))

    core = within("sketch", "_p.sketch") & within("signature", "_p.signature") & (
        F.size("sketch") == F.size("_p.sketch"))
    placed = materialize(placed.select(
        *columns, *AXES, F.when(core, F.col("_p.filename")).otherwise(F.col("filename")).alias("pivot")))
    core_links = placed.where("filename != pivot").select("filename", F.col("pivot").alias("root"))
    heads = placed.where("filename = pivot")
    reach = 2 * TOLERANCE * SLACK * SLACK
    near = materialize(_distances(_candidate_pairs(heads, heads, reach)).where(
        (F.col("ds") <= 2 * TOLERANCE * SLACK) & (F.col("dg") <= 2 * TOLERANCE * SLACK)).select("a", "b", "ds", "dg"))
    close = (F.col("ds") <= TOLERANCE) & (F.col("dg") <= TOLERANCE)
    links = reduce(DataFrame.unionByName, [
        copies, core_links, near.where(close).select(F.col("b").alias("filename"), F.col("a").alias("root"))])
    labels = connected_components(records, links)
    # Pairs of heads that only their members could connect.
    la = labels.select(F.col("filename").alias("a"), F.col("label").alias("_la"))
    lb = labels.select(F.col("filename").alias("b"), F.col("label").alias("_lb"))
    open_pairs = near.where(~close).join(la, "a").join(lb, "b").where("_la != _lb").select("a", "b")
    members = placed.select("pivot", F.col("filename").alias("m"), "sketch", "signature")
    # A pair of heads that both stand alone was already decided by its own distance.
    crowded = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("k"))
    open_pairs = materialize(
        open_pairs.join(crowded.select(F.col("pivot").alias("a"), F.col("k").alias("_ka")), "a")
        .join(crowded.select(F.col("pivot").alias("b"), F.col("k").alias("_kb")), "b")
        .where("_ka + _kb > 2").select("a", "b"))
    if open_pairs.isEmpty():
        return labels.select("filename", F.col("label").alias("group"))
    edge = 1.5 * TOLERANCE * SLACK
    head = heads.select(F.col("filename").alias("_h"), F.col("sketch").alias("_hs"), F.col("signature").alias("_hg"))

    def facing(own: str, other: str) -> DataFrame:
        """Members of one head that are near enough to the other head to matter."""
        rows = open_pairs.join(members.withColumnRenamed("pivot", own), own).join(
            head.withColumnRenamed("_h", other), other)
        return rows.where((_apart(F.col("sketch"), F.col("_hs")) <= edge) & (_apart(F.col("signature"), F.col("_hg")) <= edge))

    left = facing("a", "b").select("a", "b", F.col("sketch").alias("sa"), F.col("signature").alias("ga"))
    right = facing("b", "a").select("a", "b", F.col("sketch").alias("sb"), F.col("signature").alias("gb"))
    bridges = _distances(left.join(right, ["a", "b"])).where(close).groupBy("a", "b").agg(F.lit(1)).select(
        F.col("b").alias("filename"), F.col("a").alias("root"))
    labels = connected_components(records, links.unionByName(bridges))
    return labels.select("filename", F.col("label").alias("group"))


def conflicting_labels(df: DataFrame, group: str, label: str) -> DataFrame:
    """Groups whose members carry more than one label."""
    return df.groupBy(group).agg(
        F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.count(F.lit(1)).alias("members")).where(
        "_lo != _hi").select(group, "members")

"""Isolation forest per component: grown in small groups, scored by column.

Trees see at most `sample` rows each, drawn by a stable hash, so growing never depends on
the size of a component. The public method is Liu, Ting and Zhou (2008).
"""
from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from telltale.functions.quantiles import grouped_quantiles
from telltale.operators.reference import MIN_REFERENCE_ROWS, impute_reference, point_risk
from telltale.session import materialize

TREES, SAMPLE, CONTAMINATION, SEED = 160, 256, 0.03, 42
ROWS_PER_GROUP = 100_000
BLOCK_ROWS = 4096
TREE_SCHEMA = ("component string, tree int, psi int, feature array<int>, threshold array<double>, "
               "below array<int>, above array<int>, depth array<double>")


def path_norm(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def _grow(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    x = np.stack(pdf["x"].to_numpy()).astype(float)
    component, tree = pdf["component"].iloc[0], int(pdf["tree"].iloc[0])
    rng = np.random.default_rng([seed, tree, zlib.crc32(str(component).encode())])
    limit = int(np.ceil(np.log2(max(2, len(x)))))
    nodes: list[list] = []

    def leaf(rows, level):
        nodes.append([-1, 0.0, -1, -1, level + path_norm(len(rows))])
        return len(nodes) - 1

    def split(rows, level):
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if level >= limit or len(rows) <= 1 or not len(usable):
            return leaf(rows, level)
        k = int(rng.choice(usable))
        at = float(rng.uniform(low[k], high[k]))
        here = len(nodes)
        nodes.append([k, at, -1, -1, 0.0])
        side = x[rows, k] <= at
        nodes[here][2] = split(rows[side], level + 1)
        nodes[here][3] = split(rows[~side], level + 1)
        return here

    split(np.arange(len(x)), 0)
    f, t, a, b, d = (list(c) for c in zip(*nodes))
    return pd.DataFrame([{"component": component, "tree": tree, "psi": len(x), "feature": f, "threshold": t,
                          "below": a, "above": b, "depth": d}])


def fit_forest(rows: DataFrame, features: list[str], *, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED,
               min_rows: int = MIN_REFERENCE_ROWS) -> DataFrame:
    """One row per (component, tree) from training rows (component, ord, features without nulls)."""
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    known = rows.join(sizes, "component").select("component", "ord", "_n", F.array(*features).alias("x"))
    # Every tree draws from all rows: a hash of row and tree under a threshold leaves about twice the sample.
    draw = lambda tree: F.pmod(F.xxhash64("ord", tree, F.lit(seed + 1)), F.lit(2**52)).cast("double") / float(2**52)
    offered = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < (2 * sample + 64) / F.col("_n"))
    dealt = known.withColumn("tree", F.explode(offered)).withColumn("_draw", draw(F.col("tree")))
    w = Window.partitionBy("component", "tree").orderBy("_draw", "ord")
    picked = dealt.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= sample)
    # At most trees × sample rows per component: few bytes, but each tree is worth a place of its own.
    width = rows.sparkSession.sparkContext.defaultParallelism
    spread = picked.select("component", "tree", "x").repartition(4 * width, "component", "tree")
    grown = spread.groupBy("component", "tree").applyInPandas(
        lambda pdf: _grow(pdf, seed), TREE_SCHEMA)
    return materialize(grown)


def _arrays(forest: pd.DataFrame) -> tuple[list, float]:
    """The trees of one component in order, and the norm of their depths.

    A leaf leads to itself and takes every value; `nexts` has a node's lower and upper child side by side.
    """
    trees = []
    for _, r in forest.sort_values("tree").iterrows():
        feature, threshold, below, above, depth = (np.asarray(r[c]) for c in ("feature", "threshold", "below", "above", "depth"))
        leaf, own = feature < 0, np.arange(len(feature))
        nexts = np.stack([np.where(leaf, own, below), np.where(leaf, own, above)], axis=1).ravel()
        level, at = 0, np.zeros(1, dtype=np.intp)
        while not leaf[at].all():
            at, level = np.unique(nexts.reshape(-1, 2)[at]), level + 1
        trees.append((np.where(leaf, 0, feature).astype(np.intp), np.where(leaf, np.inf, threshold), nexts.astype(np.intp), depth.astype(float), level))
    return trees, path_norm(float(forest["psi"].max()))


def _raw(trees: list, norm: float, x: np.ndarray) -> np.ndarray:
    """Blocks of rows small enough to stay in a core's cache go down tree after tree."""
    total = np.zeros(len(x))
    for first in range(0, len(x), BLOCK_ROWS):
        some = x[first:first + BLOCK_ROWS]
        n = len(some)
        columns, line = np.ascontiguousarray(some.T).ravel(), np.arange(n)
        for feature, threshold, nexts, depth, levels in trees:
            node = np.zeros(n, dtype=np.intp)
            for _ in range(levels):
                upper = ~(columns.take(feature.take(node) * n + line) <= threshold.take(node))
                node = nexts.take(2 * node + upper)
            total[first:first + n] += depth.take(node)
    return 2.0 ** (-total / len(trees) / max(norm, 1e-12))


def raw_scores(rows: DataFrame, forest: DataFrame, features: list[str]) -> DataFrame:
    """Add `raw` in (0, 1]; null where the component has no forest or an input is missing."""
    ready = F.lit(True)
    for f in features:
        ready = ready & F.col(f).isNotNull()
    inputs = F.when(ready, F.array(*features))
    sizes = rows.groupBy("component").agg((F.floor(F.count(F.lit(1)) / ROWS_PER_GROUP) + 1).cast("int").alias("_salts"))
    salted = rows.join(sizes, "component").select(
        "component", "ord", inputs.alias("x"), F.pmod(F.xxhash64("ord"), F.col("_salts")).cast("int").alias("salt"))
    copies = forest.join(sizes, "component").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[["component", "ord"]].assign(raw=np.nan)
        ok = left["x"].notna().to_numpy()
        if len(right) and ok.any():
            out.loc[ok, "raw"] = _raw(*_arrays(right), np.stack(left.loc[ok, "x"].to_numpy()).astype(float))
        return out

    scored = salted.groupBy("component", "salt").cogroup(copies.groupBy("component", "salt")).applyInPandas(
        both, "component string, ord long, raw double")
    return rows.join(scored, ["component", "ord"], "left").withColumn("raw", F.nanvl("raw", F.lit(None).cast("double")))


def offsets(trained: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """Per component: the raw score that the given share of training rows exceeds."""
    # Scores come from a Python pass; keep the two columns instead of scoring once per step.
    trained = materialize(trained.select("component", "raw"))
    return materialize(grouped_quantiles(trained, ["component"], "raw", {"offset": 1 - contamination}).select("component", "offset"))


def fit_component_forests(rows: DataFrame, stats: DataFrame, sensors: list[str], trees: int = TREES) -> tuple[DataFrame, DataFrame, list[str]]:
    """(forest, offsets, inputs) from the reference rows, gaps filled with reference medians."""
    inputs = [f"x_{s}" for s in sensors]
    observed = F.greatest(*[F.col(s).isNotNull() for s in sensors])
    training = impute_reference(rows.where("is_ref").where(observed), stats, sensors).select("component", "ord", *inputs)
    usable = training.dropna(subset=inputs)
    forest = fit_forest(usable, inputs, trees=trees)
    return forest, offsets(raw_scores(usable, forest, inputs)), inputs


def score_forest(robust: DataFrame, stats: DataFrame, sensors: list[str], forest: DataFrame, offset: DataFrame) -> DataFrame:
    """Replace the score of robust-scored rows by the forest's, and the risk with it."""
    inputs = [f"x_{s}" for s in sensors]
    filled = impute_reference(robust, stats, sensors)
    raw = raw_scores(filled, forest, inputs).drop(*inputs).join(F.broadcast(offset), "component", "left")
    seen = F.col("max_z").isNotNull()
    return raw.withColumn("score", F.when(seen, F.col("raw") - F.col("offset"))).withColumn(
        "risk", F.when(F.col("score").isNotNull(), point_risk(F.col("max_z"), F.col("score")))).withColumn(
        "max_z", F.when(F.col("score").isNotNull(), F.col("max_z"))).drop("raw", "offset")


def sensitivity(evidence: DataFrame, stats: DataFrame, sensors: list[str], forest: DataFrame) -> DataFrame:
    """Share of the score that each measured sensor explains when put back to its median.

    evidence: one row per (train_id, component) with the sensors. Shares add to 100 or are 0.
    """
    inputs = [f"x_{s}" for s in sensors]
    keys = ["train_id", "component"]
    base = impute_reference(evidence, stats, sensors)
    medians = stats.groupBy("component").agg(*[
        F.max(F.when(F.col("sensor") == s, F.col("median"))).alias(f"_m_{s}") for s in sensors])
    joined = base.join(medians, "component")
    trials = [F.struct(F.lit("").alias("sensor"), *[F.col(i) for i in inputs])]
    trials += [F.struct(F.lit(s).alias("sensor"), *[(F.col(f"_m_{s}") if i == f"x_{s}" else F.col(i)).alias(i) for i in inputs]) for s in sensors]
    measured = F.array(*[F.lit(True), *[F.col(s).isNotNull() for s in sensors]])
    tried = joined.select(*keys, "ord", *[F.col(s) for s in sensors], F.explode(F.filter(
        F.arrays_zip(F.array(*trials).alias("t"), measured.alias("m")), lambda z: z["m"])).alias("_z"))
    tried = tried.select(*keys, "ord", "_z.t.*")
    scored = raw_scores(tried.withColumnRenamed("ord", "_o").withColumn("ord", F.xxhash64("_o", "sensor")), forest, inputs)
    original = scored.where("sensor = ''").select(*keys, F.col("raw").alias("_full"))
    drop = scored.where("sensor != ''").join(original, keys).withColumn("_drop", F.greatest(F.lit(0.0), F.col("_full") - F.col("raw")))
    total = drop.groupBy(*keys).agg(F.sum("_drop").alias("_total"))
    return drop.join(total, keys).select(*keys, "sensor", F.when(
        F.col("_total") > 1e-12, F.bround(100 * F.col("_drop") / F.col("_total"), 2)).otherwise(0.0).alias("contribution"))


def ordered_features(contribution: DataFrame, deviation: DataFrame) -> DataFrame:
    """Sensors by contribution, then absolute deviation; place 1 is the top sensor."""
    keys = ["train_id", "component"]
    w = Window.partitionBy(*keys).orderBy(F.col("contribution").desc(), F.abs(F.coalesce("deviation", F.lit(0.0))).desc(), "sensor")
    return contribution.join(deviation, [*keys, "sensor"], "left").withColumn("place", F.row_number().over(w))


def side_classes(raw_sides: DataFrame) -> DataFrame:
    """Normal unless a side's anomaly score is positive; then the side with the larger one. Null if no side has a score.

    raw_sides: file_id, component (side_i or side_ii), score.
    """
    side = lambda name: F.max(F.when(F.col("component") == name, F.col("score")))
    both = raw_sides.groupBy("file_id").agg(side("side_i").alias("_a"), side("side_ii").alias("_b"))
    return both.select("file_id", F.when(F.greatest("_a", "_b") <= 0, "Normal").when(
        F.col("_b").isNull() | (F.col("_a") >= F.col("_b")), F.when(F.col("_a").isNotNull(), "Side I")).otherwise(
        "Side II").alias("prediction"))

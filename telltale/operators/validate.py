"""Folds, leakage and coverage checks, training preconditions."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from telltale.functions.columns import hash_rank
from telltale.functions.ordered import scan

SEED = 42


def group_folds(df: DataFrame, group: str, folds: int, label: str | None = None, seed: int = SEED) -> DataFrame:
    """One fold per group, dealt in the order of a stable draw, class by class when stratified.

    The number of groups may be large: the deal is a running count over slices of the draw.
    Returns group, (label,) fold.
    """
    keys = [label] if label else []
    groups = df.select(group, *keys).distinct() if not label else df.groupBy(group).agg(F.min(label).alias(label))
    drawn = groups.withColumn("_d", hash_rank(F.concat_ws(":", F.col(group).cast("string"), F.lit(str(seed)))))
    drawn = drawn.withColumn("_key", F.lit(0)) if not keys else drawn
    slices = F.floor(F.col("_d") / F.lit(float(2**52 / 256))).cast("long")
    placed = scan(drawn, keys or ["_key"], ["_d", group], slices, position="_pos")
    return placed.select(group, *keys, ((F.col("_pos") - 1) % folds).alias("fold"))


def leave_one_group_out(df: DataFrame, group: str, key: str) -> DataFrame:
    """Held-out group and rows it may be trained on. Groups are whole files, few per case set."""
    held = df.select(F.col(group).alias("heldout")).distinct()
    # Each row belongs to the training set of every other group: that is the result's size.
    return df.select(key, group).join(held, F.col(group) != F.col("heldout")).select("heldout", key)


def training_rows(folds: DataFrame, key: str, group: str | None = None) -> DataFrame:
    """(heldout fold, key) of permitted training rows; rows sharing a held-out group are dropped."""
    names = folds.select(F.col("fold").alias("heldout")).distinct()
    rows = folds.select(key, "fold", *([group] if group else [])).join(
        F.broadcast(names), F.col("fold") != F.col("heldout"))
    if group:
        held = folds.select(F.col("fold").alias("heldout"), group).distinct()
        rows = rows.join(held, ["heldout", group], "left_anti")
    return rows.select("heldout", key)


def leaked_groups(training: DataFrame, heldout: DataFrame, group: str) -> DataFrame:
    return training.select(group).intersect(heldout.select(group))


def coverage_gaps(universe: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Ids that are missing from, or surplus in, the held-out predictions (duplicates count)."""
    have, want = predicted.select(key), universe.select(key)
    missing = want.exceptAll(have).withColumn("problem", F.lit("missing"))
    return missing.unionByName(have.exceptAll(want).withColumn("problem", F.lit("surplus")))


def unmatched_labels(recordings: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Both sides of an exact join: recordings without label and labels without recording."""
    a = recordings.select(key).join(labels.select(key), key, "left_anti").withColumn("problem", F.lit("unlabelled"))
    b = labels.select(key).join(recordings.select(key), key, "left_anti").withColumn("problem", F.lit("no recording"))
    return a.unionByName(b)


def duplicate_names(df: DataFrame, name: str) -> DataFrame:
    """Names that clash when case is ignored."""
    return df.groupBy(F.lower(name).alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def class_groups(df: DataFrame, label: str, group: str) -> DataFrame:
    return df.groupBy(label).agg(F.countDistinct(group).alias("groups"))


def require_training(df: DataFrame, label: str, group: str, classes: list[str], minimum: int = 2) -> None:
    """Every class needs enough independent groups, else training stops here."""
    counts = {r[label]: r["groups"] for r in class_groups(df, label, group).collect()}  # one row per class
    short = [c for c in classes if counts.get(c, 0) < minimum]
    if short:
        raise ValueError(f"At least {minimum} independent groups per class are needed; short: {', '.join(short)}")


def require_positive(df: DataFrame, target: str) -> None:
    bad = df.agg(F.count_if(F.col(target).isNull() | F.isnan(target) | (F.col(target) <= 0)).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} targets are not finite and positive.")


def compare_manifest(expected: DataFrame, actual: DataFrame, key: str = "file", digest: str = "sha256") -> DataFrame:
    """Missing, unexpected and changed files of two manifests."""
    e = expected.select(key, F.col(digest).alias("_e"))
    a = actual.select(key, F.col(digest).alias("_a"))
    state = (F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected")
             .when(F.col("_e") == F.col("_a"), "equal").otherwise("changed"))
    return e.join(a, key, "full_outer").select(key, state.alias("state"))

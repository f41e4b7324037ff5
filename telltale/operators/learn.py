"""Linear, tree and surrogate models as DataFrame jobs, candidate choice and frozen scoring.

A linear model is a small table (feature, median, mean, std, coefficient): scoring it is a
column expression, saving it is a table write. Tree ensembles are MLlib's random forest and
gradient boosting, which stand in for the extra-trees and boosting candidates.
"""
from __future__ import annotations

from typing import Callable

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from telltale.functions.columns import finite
from telltale.functions.quantiles import grouped_median, select_by_weight
from telltale.operators.cycles import MOMENT_POWERS
from telltale.session import materialize

MODEL_SCHEMA = "feature string, median double, mean double, std double, coefficient double"
INTERCEPT = "(intercept)"


def fit_scaling(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float, float]]:
    """Median, and mean and population deviation after filling gaps with it. One row per feature."""
    cells = df.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], features, "feature", "v")
    medians = {r["feature"]: r["median"] for r in grouped_median(cells, ["feature"], "v").collect()}
    filled = [F.coalesce(F.col(f).cast("double"), F.lit(medians.get(f) or 0.0)) for f in features]
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(filled)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(filled)]).first()
    return {f: (medians.get(f) or 0.0, row[f"m{i}"], row[f"s{i}"] or 1.0) for i, f in enumerate(features)}


def scaled(feature: str, scaling: tuple[float, float, float]) -> Column:
    median, mean, std = scaling
    return (F.coalesce(F.col(feature).cast("double"), F.lit(median)) - mean) / (std or 1.0)


def vectorised(df: DataFrame, features: list[str], scaling: dict, keep: list[str]) -> DataFrame:
    rows = df.select(*keep, *[scaled(f, scaling[f]).alias(f) for f in features])
    return VectorAssembler(inputCols=features, outputCol="features").transform(rows).select(*keep, "features")


def model_table(spark: SparkSession, features: list[str], scaling: dict, coefficients, intercept: float) -> DataFrame:
    rows = [(f, *map(float, scaling[f]), float(c)) for f, c in zip(features, coefficients)]
    return spark.createDataFrame([*rows, (INTERCEPT, 0.0, 0.0, 1.0, float(intercept))], MODEL_SCHEMA)


def fit_logistic(df: DataFrame, features: list[str], label: str, strength: float = 0.5) -> DataFrame:
    """Balanced, standardised logistic regression; `strength` is the inverse penalty C."""
    scaling = fit_scaling(df, features)
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # one row per class
    n = sum(counts.values())
    weight = F.coalesce(*[F.when(F.col(label) == k, F.lit(n / (len(counts) * c))) for k, c in counts.items()])
    rows = vectorised(df.withColumns({"_w": weight, "_y": F.col(label).cast("double")}), features, scaling, ["_y", "_w"])
    fitted = LogisticRegression(labelCol="_y", weightCol="_w", standardization=False, maxIter=200,
                                regParam=1.0 / (strength * n)).fit(rows)
    return model_table(df.sparkSession, features, scaling, fitted.coefficients, fitted.intercept)


class NoPairs(ValueError):
    """No case has evidence of both its labelled car and a peer, so there is nothing to fit."""


def fit_pairwise(cars: DataFrame, features: list[str], strength: float = 0.3) -> DataFrame:
    """Ranker from differences between each case's labelled car and its peers, both ways round.

    cars: file_id, car, faulty (0/1), features. A case has at most eight cars. Without a pair there is no model (`NoPairs`).
    """
    scaling = fit_scaling(cars, features)
    z = cars.select("file_id", "car", "faulty", *[scaled(f, scaling[f]).alias(f) for f in features])
    bad = z.where("faulty = 1").select("file_id", *[F.col(f).alias(f"_b_{f}") for f in features])
    diff = z.where("faulty = 0").join(bad, "file_id").select(
        F.array(*[F.col(f"_b_{f}") - F.col(f) for f in features]).alias("d"))
    signed = diff.select(F.explode(F.array(
        F.struct(F.lit(1.0).alias("y"), F.col("d")),
        F.struct(F.lit(0.0).alias("y"), F.transform("d", lambda v: -v).alias("d")))).alias("_r")).select(
        F.col("_r.y").alias("y"), *[F.col("_r.d")[i].alias(f) for i, f in enumerate(features)])
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(signed).select("y", "features")
    n = rows.count()
    if not n:
        raise NoPairs("No case has a usable labelled car and a peer.")
    fitted = LogisticRegression(labelCol="y", fitIntercept=False, standardization=False, maxIter=200,
                                regParam=1.0 / (strength * n)).fit(rows)
    return model_table(cars.sparkSession, features, scaling, fitted.coefficients, 0.0)


def fit_ridge(df: DataFrame, features: list[str], target: str, alpha: float = 10.0) -> DataFrame:
    """Ridge on the log target: the sums of the normal equations in one aggregate, the k × k system on the driver.

    The penalty is alpha times the sum of squared coefficients of the scaled features; the intercept is free.
    """
    scaling = fit_scaling(df, features)
    k = len(features)
    rows = df.select(F.log(target).alias("_y"), *[scaled(f, scaling[f]).alias(f"_x{i}") for i, f in enumerate(features)])
    rows = rows.where(F.col("_y").isNotNull())
    means = rows.agg(F.avg("_y").alias("_y"), *[F.avg(f"_x{i}").alias(f"_x{i}") for i in range(k)]).first()
    if means["_y"] is None:
        raise ValueError("No row has a positive target.")
    y = F.col("_y") - means["_y"]
    x = [F.col(f"_x{i}") - means[f"_x{i}"] for i in range(k)]
    sums = rows.agg(*[F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i + 1)],
                    *[F.sum(x[i] * y).alias(f"b{i}") for i in range(k)]).first()
    gram = np.array([[sums[f"g{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)]) + alpha * np.eye(k)
    weights = np.linalg.solve(gram, np.array([sums[f"b{i}"] for i in range(k)]))
    intercept = means["_y"] - float(weights @ np.array([means[f"_x{i}"] for i in range(k)]))
    return model_table(df.sparkSession, features, scaling, weights, intercept)


def linear_score(model: DataFrame) -> tuple[list[str], Column]:
    """(features, score expression) of a model table; a few hundred rows at most."""
    rows = model.collect()
    features = [r["feature"] for r in rows if r["feature"] != INTERCEPT]
    base = sum(r["coefficient"] for r in rows if r["feature"] == INTERCEPT)
    score = F.lit(base)
    for r in rows:
        if r["feature"] != INTERCEPT:
            score = score + scaled(r["feature"], (r["median"], r["mean"], r["std"])) * r["coefficient"]
    return features, score


def frozen_score(df: DataFrame, model: DataFrame, name: str = "score") -> DataFrame:
    """Apply a saved linear model. Never fits; a missing feature column is an error."""
    features, score = linear_score(model)
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"The saved model expects other features; missing: {', '.join(missing)}")
    return df.withColumn(name, score)


def frozen_damage(df: DataFrame, model: DataFrame, name: str = "prediction") -> DataFrame:
    return frozen_score(df, model, "_log").withColumn(name, F.greatest(F.lit(0.0), F.exp("_log"))).drop("_log")


def require_finite(df: DataFrame, column: str) -> DataFrame:
    bad = df.agg(F.count_if(finite(column).isNull()).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} predictions are not finite; nothing is made up for them.")
    return df


def fit_moment_surrogate(df: DataFrame, target: str) -> DataFrame:
    """Power, log scale and training error of the best rainflow moment (one row).

    For each power the scale is a weighted median of log target minus log moment, which
    minimises the mean relative error at that power; ties go to the lower power.
    """
    moments = [f"log_rainflow_amplitude_moment_{p}" for p in MOMENT_POWERS]
    rows = df.select(F.col(target).cast("double").alias("_y"), *[F.col(m).alias(str(p)) for m, p in zip(moments, MOMENT_POWERS)])
    cells = rows.unpivot(["_y"], [str(p) for p in MOMENT_POWERS], "power", "_m").select(
        F.col("power").cast("int").alias("power"), "_y", "_m", (F.log("_y") - F.col("_m")).alias("_r"))
    top = cells.groupBy("power").agg(F.min("_r").alias("_min"))
    weighted = cells.join(F.broadcast(top), "power").withColumn("_w", F.exp(F.col("_min") - F.col("_r")))
    scale = materialize(select_by_weight(weighted, ["power"], "_r", {"log_scale": F.col("total") / 2}, "_w").select("power", "log_scale"))
    fitted = F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("_m") + F.col("log_scale"))))
    errors = cells.join(F.broadcast(scale), "power").groupBy("power", "log_scale").agg(
        F.avg(F.abs(F.col("_y") - fitted) / F.col("_y")).alias("error"))
    return errors.orderBy("error", "power").limit(1)


def predict_moment_surrogate(df: DataFrame, model: DataFrame, name: str = "prediction") -> DataFrame:
    row = model.first()
    log = F.col(f"log_rainflow_amplitude_moment_{row['power']}") + row["log_scale"]
    return df.withColumn(name, F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), log))))


def tree_classifier(df: DataFrame, features: list[str], label: str, kind: str = "forest", seed: int = 42):
    """MLlib ensembles: 'forest', 'boosting' (two classes) or 'boosting_many' (one against the rest)."""
    rows = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(
        df.withColumn("_y", F.col(label).cast("double"))).select("_y", "features")
    boosted = GBTClassifier(labelCol="_y", maxIter=40, maxDepth=3, stepSize=0.1, seed=seed)
    choice = {
        "forest": RandomForestClassifier(labelCol="_y", numTrees=160, maxDepth=5, minInstancesPerNode=3, seed=seed),
        "boosting": boosted, "boosting_many": OneVsRest(classifier=boosted, labelCol="_y")}
    return choice[kind].fit(rows)


def tree_regressor(df: DataFrame, features: list[str], target: str, kind: str = "forest", seed: int = 42):
    rows = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(
        df.withColumn("_y", F.log(target))).select("_y", "features")
    choice = {"forest": RandomForestRegressor(labelCol="_y", numTrees=160, minInstancesPerNode=3, seed=seed),
              "boosting": GBTRegressor(labelCol="_y", maxIter=80, maxDepth=2, stepSize=0.05, seed=seed)}
    return choice[kind].fit(rows)


def select_candidate(candidates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The best score; the declared order (column `place`) breaks ties."""
    best = F.max_by(F.struct("name", "score"), F.struct(F.col("score"), -F.col("place")))
    return candidates.groupBy(*(by or [])).agg(best.alias("_b")).select(*(by or []), "_b.*")


Candidate = Callable[[DataFrame, DataFrame], DataFrame]


def out_of_fold(df: DataFrame, folds: list, candidates: dict[str, Candidate]) -> DataFrame:
    """Held-out predictions of every candidate: each fold is predicted by a fit on the others.

    A candidate is `(training, heldout) -> heldout with prediction`; df carries `fold`.
    """
    parts = None
    for place, (name, fit) in enumerate(candidates.items()):
        for fold in folds:
            rows = fit(df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)).withColumns(
                {"name": F.lit(name), "place": F.lit(place)})
            parts = rows if parts is None else parts.unionByName(rows)
    return materialize(parts)


def nested_selection(df: DataFrame, group: str, candidates: dict[str, Candidate],
                     score: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """Leave one group out twice: the inner loop chooses, the outer one never sees its group.

    `score(predictions, by)` gives one score per candidate. Each distinct pair of left-out
    groups is fitted once and serves both of its outer folds. Returns the outer predictions
    with the chosen candidate's name.
    """
    groups = sorted(r[0] for r in df.select(group).distinct().collect())  # whole recordings, few
    if len(groups) < 3:
        raise ValueError("Nested selection needs at least three distinct groups.")
    cache: dict[tuple, DataFrame] = {}

    def predicted(name: str, left_out: tuple, held) -> DataFrame:
        key = (name, left_out, held)
        if key not in cache:
            training = df.where(~F.col(group).isin(*left_out))
            cache[key] = materialize(candidates[name](training, df.where(F.col(group) == held)))
        return cache[key]

    result = None
    for outer in groups:
        inner = None
        for place, name in enumerate(candidates):
            for held in groups:
                if held != outer:
                    rows = predicted(name, tuple(sorted((outer, held))), held).withColumns(
                        {"name": F.lit(name), "place": F.lit(place)})
                    inner = rows if inner is None else inner.unionByName(rows)
        best = select_candidate(score(inner, ["name", "place"])).first()["name"]
        row = predicted(best, (outer,), outer).withColumn("selected", F.lit(best))
        result = row if result is None else result.unionByName(row)
    return result


def new_content(files: DataFrame, known: DataFrame, digest: str = "sha256") -> DataFrame:
    """Files whose content has no features yet; only these need computing."""
    return files.join(known.select(digest), digest, "left_anti")


def range_cautions(df: DataFrame, lengths: list[int], target_range: tuple[float, float], cadence_ratio: str | None = None) -> DataFrame:
    """Warnings about inputs outside the training conditions, as an array per row."""
    low, high = target_range
    flags = [F.when(~F.col("samples").isin(*lengths), "recording length differs from training"),
             F.when((F.col("prediction") < low) | (F.col("prediction") > high), "the estimate is outside the training range"),
             F.when(F.col("cycles") == 0, "no alternating stress cycles were found")]
    if cadence_ratio:
        flags.append(F.when(~F.col(cadence_ratio).between(0.5, 2), "sampling differs from training"))
    return df.withColumn("cautions", F.array_compact(F.array(*flags)))

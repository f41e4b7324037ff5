"""Task metrics as aggregations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from telltale.functions.ordered import scan
from telltale.functions.quantiles import grouped_median
from telltale.session import materialize


def binary_metrics(df: DataFrame, label: str, flag: Column, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and false positives; null where undefined."""
    hit, truth = flag, F.col(label) == 1
    sums = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(truth).alias("positives"), F.count_if(hit).alias("flagged"),
        F.count_if(hit & truth).alias("tp"), F.count_if(hit & ~truth).alias("false_positives"))
    precision = F.when(F.col("flagged") > 0, F.col("tp") / F.col("flagged"))
    recall = F.when(F.col("positives") > 0, F.col("tp") / F.col("positives"))
    f1 = F.when(F.col("positives") > 0, 2 * F.col("tp") / (F.col("flagged") + F.col("positives")))
    return sums.select(*(by or []), "n", "positives", precision.alias("precision"), recall.alias("recall"),
                       f1.alias("f1"), "false_positives")


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None, slices: int = 1024) -> DataFrame:
    """Area under the ROC curve with average ranks for ties; null with a single class.

    Scores are first counted per distinct value; the running counts are taken slice by
    slice of the score range, so the ranking is never one task's work.
    """
    by = by or []
    values = materialize(df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n")))
    edges = values.agg(F.percentile_approx("_s", [i / slices for i in range(1, slices)], 10 * slices).alias("e")).first()["e"] or []
    cuts = sorted(set(edges))  # at most `slices` numbers
    chunk = F.lit(0).cast("long")
    if len(cuts) > 1:
        low, high = cuts[len(cuts) // 100], cuts[-1 - len(cuts) // 100]
        chunk = F.floor((F.col("_s") - F.lit(low)) / F.lit((high - low) or 1.0) * slices).cast("long")
    placed = scan(values, by, ["_s"], F.greatest(F.lit(-1), F.least(F.lit(slices), chunk)), total={"_below": F.col("_n")})
    # Negatives below plus half of the tied ones, for every positive.
    wins = F.sum(F.col("_p") * (F.col("_below") - F.col("_n") + F.col("_n") / 2))
    sums = placed.groupBy(*by).agg(wins.alias("_w"), F.sum("_p").alias("_np"), F.sum("_n").alias("_nn"))
    both = (F.col("_np") > 0) & (F.col("_nn") > 0)
    return sums.select(*by, F.when(both, F.col("_w") / (F.col("_np") * F.col("_nn"))).alias("auc"))


def confusion(df: DataFrame, truth: str, found: str, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """Counts for every (truth, prediction) of the label list, zeros included."""
    by = by or []
    counts = df.groupBy(*by, F.col(truth).alias("truth"), F.col(found).alias("found")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    names = spark.createDataFrame([(a, b) for a in labels for b in labels], "truth string, found string")
    frame = df.select(*by).distinct().crossJoin(F.broadcast(names)) if by else names
    return frame.join(counts, [*by, "truth", "found"], "left").fillna(0, ["n"])


def class_report(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class from a confusion table (0 when undefined)."""
    by = by or []
    row = matrix.groupBy(*by, F.col("truth").alias("label")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("found"), F.col("n")).otherwise(0)).alias("tp"))
    col = matrix.groupBy(*by, F.col("found").alias("label")).agg(F.sum("n").alias("predicted"))
    joined = row.join(col, [*by, "label"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return joined.select(
        *by, "label", "support", ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "tp")


def macro_summary(report: DataFrame, by: list[str] | None = None) -> DataFrame:
    return report.groupBy(*(by or [])).agg(
        F.avg("f1").alias("macro_f1"), (F.sum("tp") / F.sum("support")).alias("accuracy"))


def regression_metrics(df: DataFrame, truth: str, found: str, by: list[str] | None = None) -> DataFrame:
    """MAPE, 1 − MAPE floored at 0, MAE, RMSE and the median relative error."""
    by = by or []
    error = F.col(found) - F.col(truth)
    rows = df.withColumn("_e", error).withColumn("_r", F.abs(error) / F.abs(F.col(truth)))
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_r").alias("mape"), F.avg(F.abs("_e")).alias("mae"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"))
    middle = grouped_median(rows, by, "_r", "median_ape").drop("n")
    joined = base.join(middle, by) if by else base.crossJoin(F.broadcast(middle))
    return joined.withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("mape")))


def worst_rows(df: DataFrame, truth: str, found: str, key: str, count: int = 5) -> DataFrame:
    relative = F.abs(F.col(found) - F.col(truth)) / F.abs(F.col(truth))
    return df.withColumn("relative_error", relative).orderBy(F.col("relative_error").desc(), key).limit(count)


def rank_decay(df: DataFrame) -> DataFrame:
    """Place of the labelled car in the pipe-joined ranking, and its linear credit."""
    cars = F.split("ranked_cars", r"\|")
    place = F.array_position(cars, F.col("faulty_car"))
    n = F.size(cars)
    return df.withColumn("true_car_rank", F.when(place > 0, place)).withColumn(
        "decay", F.when(place > 0, F.greatest(F.lit(0.0), (n - place + 1) / n)).otherwise(F.lit(0.0)))


def ranking_metrics(ranked: DataFrame, by: list[str] | None = None) -> DataFrame:
    p = F.col("true_car_rank")
    return ranked.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(p == 1).alias("top1"), F.count_if(p <= 2).alias("top2"),
        F.avg(p).alias("mean_rank"), F.avg("decay").alias("score"))


def reproduction_audit(stored: DataFrame, recomputed: DataFrame, keys: list[str], value: str,
                       tolerance: float = 1e-10) -> DataFrame:
    """Stored against recomputed values: missing on either side, or beyond the relative tolerance."""
    a = stored.select(*keys, F.col(value).alias("stored"))
    b = recomputed.select(*keys, F.col(value).alias("recomputed"))
    joined = a.join(b, keys, "full_outer")
    size = F.greatest(F.abs("stored"), F.abs("recomputed"))
    within = F.abs(F.col("stored") - F.col("recomputed")) <= tolerance * size
    state = (F.when(F.col("stored").isNull(), "unexpected").when(F.col("recomputed").isNull(), "missing")
             .when(within, "equal").otherwise("different"))
    return joined.withColumn("state", state)

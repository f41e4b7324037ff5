"""Writers of predictions, export selections, report tables and validation records."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from telltale.functions.columns import finite
from telltale.operators.catalog import COLUMNS, export_problems, require_valid, scoped
from telltale.operators.clean import format_native_time
from telltale.session import materialize


def output_columns(p: DataFrame, subsystem: str) -> DataFrame:
    """The task's columns in their exact order."""
    rows = p.where(F.col("subsystem") == subsystem)
    if subsystem == "door":
        return rows.select(format_native_time("start").alias("start_time"), format_native_time("end").alias("end_time"), "prediction")
    if subsystem == "shm":
        return rows.select("file_id", F.col("damage").alias("prediction"))
    return rows.select(*COLUMNS[subsystem])


def write_predictions(p: DataFrame, subsystem: str, path: str) -> None:
    """Validated predictions of one task as CSV with a header; nothing is written when a row is invalid."""
    rows = require_valid(p.where(F.col("subsystem") == subsystem))
    output_columns(rows, subsystem).write.mode("errorifexists").csv(path, header=True)


def export_selection(runs: DataFrame, p: DataFrame, selection: DataFrame, path: str) -> list[str]:
    """Write exactly the selected files, one directory per task; any problem stops the export."""
    problems = export_problems(runs, p, selection).limit(20).collect()
    if problems:
        raise ValueError("; ".join(f"{r['subsystem']}: {r['problem']} ({r['n']})" for r in problems))
    rows = scoped(p, selection)
    tasks = [r[0] for r in rows.select("subsystem").distinct().collect()]  # at most four
    for task in sorted(tasks):
        write_predictions(rows, task, f"{path}/{task}_predictions")
    return sorted(tasks)


def write_report_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Append predictions, evidence, warnings, trace points and entities; non-finite becomes null."""
    for name, df in tables.items():
        doubles = {c: finite(c) for c, t in df.dtypes if t in ("double", "float")}
        (df.withColumns(doubles) if doubles else df).write.mode("append").parquet(f"{path}/{name}")


def write_validation(metadata: DataFrame, candidates: DataFrame, folds: DataFrame, oof: DataFrame, path: str) -> None:
    """Metric and limits, candidate scores, folds and out-of-fold predictions of a training."""
    write_report_tables({"run_metadata": metadata, "validation_candidates": candidates,
                         "validation_folds": folds, "oof_predictions": oof}, path)


def append_features(new: DataFrame, path: str, key: str = "file_id", content: str = "sha256", buckets: int = 64) -> int:
    """Put the features of new or changed files into the feature table; returns how many files were written.

    A file whose content hash is already there under its name adds nothing, so a repeated run is
    harmless; a changed one replaces its rows. Files lie in `buckets` partitions by a hash of their
    name, and only the partitions touched are written again: their new state is first written whole to
    the shared folder, then put in place partition by partition. Within one call, rows of a file that
    disagree on the hash stop it. One writer at a time.
    """
    spark = new.sparkSession
    rows = materialize(new.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    unclear = rows.groupBy(key).agg(F.countDistinct(content).alias("n"), F.count_if(F.col(content).isNull()).alias("bad")).where(
        "n <> 1 or bad > 0").select(key).limit(5).collect()
    if unclear:
        raise ValueError(f"A file needs exactly one content hash: {', '.join(str(r[0]) for r in unclear)}")
    if not _written(spark, path):
        rows.write.partitionBy("bucket").parquet(path)
        return rows.select(key).distinct().count()
    table = spark.read.parquet(path)
    fresh = materialize(rows.join(table.select(key, content).distinct(), [key, content], "left_anti"))
    touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most `buckets`
    if not touched:
        return 0
    kept = table.where(F.col("bucket").isin(touched)).join(fresh.select(key).distinct(), key, "left_anti")
    state = materialize(kept.unionByName(fresh, allowMissingColumns=True))
    state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return fresh.select(key).distinct().count()


def cached_features(files: DataFrame, path: str, key: str = "file_id", content: str = "sha256") -> tuple[DataFrame | None, DataFrame]:
    """(features of the files whose content the table knows, files that still need theirs)."""
    if not _written(files.sparkSession, path):
        return None, files
    table = files.sparkSession.read.parquet(path).drop("bucket")
    names = files.select(key, content).distinct()
    return table.join(names, [key, content], "left_semi"), files.join(table.select(key, content).distinct(), [key, content], "left_anti")


def _written(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)

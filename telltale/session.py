"""Session defaults and reliable materialisation."""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this library relies on; cluster sizing stays with spark-submit.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the bench; on a cluster spark-submit brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("telltale")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names.

    Only a local session, where driver and executors share one disk, may go without it: it gets a
    private folder. On a cluster a missing name is an error, since tables written to each executor's
    own disk could not be read back whole.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    root = tempfile.mkdtemp(prefix="telltale-checkpoint-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(root)
    return root


def tables_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie; `release` removes them."""
    return f"{checkpoint_root(spark).rstrip('/')}/telltale/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete the application's intermediate tables, once the results built on them are written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(tables_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts lineage on reliable storage, so a lost executor costs a re-read only, and gives
    the planner the true size, so later joins broadcast only what is really small. Used
    for fitted tables (group facts, reference statistics, labels of a graph round) and
    for a derived input that several later steps would otherwise compute again.
    """
    spark = df.sparkSession
    path = f"{tables_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

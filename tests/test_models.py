"""Ensembles, fold tables and the records a training leaves."""
import datetime as dt

from pyspark.sql import functions as F

from telltale.operators import learn, validate
from telltale.plans import models
from telltale.sources import sinks


def test_ensembles_fit_a_step(spark):
    df = spark.range(80).select(F.col("id").cast("double").alias("x"), (F.col("id") > 40).cast("int").alias("y"),
                                (F.when(F.col("id") > 40, 9.0).otherwise(1.0)).alias("d"))
    for kind in ("forest", "boosting"):
        learn_rows = learn.VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
        hits = learn.tree_classifier(df, ["x"], "y", kind).transform(learn_rows).where(F.col("prediction") == F.col("y")).count()
        assert hits >= 78
        worst = learn.tree_regressor(df, ["x"], "d", kind).transform(learn_rows).agg(
            F.percentile(F.abs(F.exp("prediction") - F.col("d")), 0.9)).first()[0]
        assert worst < 1.0


def test_left_out_groups_never_train(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("b", 3, 1), ("c", 4, 1)], "g string, id int, fold int")
    rows = {(r["heldout"], r["id"]) for r in validate.leave_one_group_out(df, "g", "id").collect()}
    assert rows == {("a", 3), ("a", 4), ("b", 1), ("b", 2), ("b", 4), ("c", 1), ("c", 2), ("c", 3)}
    shared = df.withColumn("g", F.when(F.col("id") == 4, "a").otherwise(F.col("g")))
    kept = {(r["heldout"], r["id"]) for r in validate.training_rows(shared, "id", "g").collect()}
    assert kept == {(0, 3)}


def test_training_records_and_new_content(spark, tmp_path):
    one = spark.createDataFrame([("m", float("inf"))], "name string, score double")
    sinks.write_validation(one, one, one, one, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v" / "validation_candidates")).first()["score"] is None
    files = spark.createDataFrame([("a", "h1"), ("b", "h2")], "file_id string, sha256 string")
    sinks.append_features(files.where("sha256 = 'h1'"), str(tmp_path / "f"))
    known = spark.read.parquet(str(tmp_path / "f"))
    assert [r["sha256"] for r in learn.new_content(files, known).collect()] == ["h2"]
    pick = spark.createDataFrame([("a", 0.5, 0), ("b", 0.7, 1), ("c", 0.7, 2)], "name string, score double, place int")
    assert learn.select_candidate(pick).first()["name"] == "b"


def test_cars_without_any_cooling_reading_stand_in_id_order(spark, tmp_path):
    day = dt.datetime(1996, 1, 1)
    lines = [(s, day + dt.timedelta(days=d), 10.0 + s, "R") for s in range(1, 9) for d in range(5)]
    for name, rows, schema in (("lineitem", lines, "l_suppkey long, l_shipdate timestamp, l_quantity double, l_returnflag string"),
                               ("supplier", [(s, 0) for s in range(1, 9)], "s_suppkey long, s_nationkey int"),
                               ("nation", [(0, 3)], "n_nationkey int, n_regionkey int")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = models.pairwise_ranking(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(3, "01|02|03|04|05|06|07|08", "01", 1, 1.0)]

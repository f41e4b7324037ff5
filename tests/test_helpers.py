"""Worked examples of header, name, coordinate, held-out and caution rules."""
import pytest
from pyspark.sql import functions as F

from telltale.operators import clean, learn, text


def one_column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def results(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_safe_names(spark):
    names = ["run 1.csv", "Run-2 (b).CSV", "con.csv", "LPT1.csv", ".csv", "../run.csv", "a‮b.csv", "a\tb.csv", "run.csv\n", "run.txt",
             "a" * 146 + ".csv", "a" * 147 + ".csv", "", None]
    assert results(one_column(spark, names), text.safe_name("v", ".csv")) == [True, True] + [False] * 8 + [True] + [False] * 3


def test_headers_are_normalised_and_clashes_refused(spark):
    df = spark.createDataFrame([(1, 2)], "` Time ` int, `S1` int")
    assert clean.normalize_columns(df).columns == ["time", "s1"]
    for names in (["a", " A"], ["a", " "]):
        with pytest.raises(ValueError):
            clean.normalize_columns(spark.createDataFrame([(1, 2)], "x int, y int").toDF(*names))


def test_coordinates(spark):
    found = results(one_column(spark, ["1.5", " -2 ", "2024-01-01T00:00:01", "2024-01-01 00:00:00.5", "soon", "", None]), clean.coordinate("v"))
    assert found == [1.5, -2.0, 1704067201000.0, 1704067200500.0, None, None, None]


def test_lists_and_maps_are_bounded(spark):
    found = results(one_column(spark, [[1, 2, 3], [1], []], "array<int>"), text.bounded_list("v", 2))
    assert [(r["items"], r["omitted"]) for r in found] == [([1, 2], 1), ([1], 0), ([], 0)]
    maps = one_column(spark, [{"speed": "1", "api_key": "x", "mode": "a"}], "map<string,string>")
    assert results(maps, text.bounded_map("v")) == [{"speed": "1", "mode": "a"}]
    assert results(maps, text.bounded_map("v", ["mode", "api_key"])) == [{"mode": "a"}]


def test_cautions(spark):
    df = spark.createDataFrame([(10, 5.0, 3), (11, 50.0, 0), (10, 1.0, 1)], "samples int, prediction double, cycles int")
    found = [len(r.cautions) for r in learn.range_cautions(df, [10], (1.0, 9.0)).orderBy("prediction").collect()]
    assert found == [0, 0, 3]


def test_predictions_must_be_finite(spark):
    good = one_column(spark, [1.0, 2.0], "double")
    assert learn.require_finite(good, "v").count() == 2
    for bad in (float("nan"), float("inf"), None):
        with pytest.raises(ValueError):
            learn.require_finite(one_column(spark, [1.0, bad], "double"), "v")


def test_out_of_fold_predictions_come_from_the_other_folds(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 10.0), (2, 100.0)], "fold int, y double")

    def mean(train, held):
        return held.crossJoin(train.agg(F.avg("y").alias("prediction")))

    def largest(train, held):
        return held.crossJoin(train.agg(F.max("y").alias("prediction")))

    found = learn.out_of_fold(df, [0, 1, 2], {"mean": mean, "largest": largest}).collect()
    assert sorted((r.name, r.place, r.fold, r.y, round(r.prediction, 6)) for r in found) == sorted(
        [("mean", 0, 0, 1.0, 55.0), ("mean", 0, 0, 3.0, 55.0), ("mean", 0, 1, 10.0, round(104 / 3, 6)), ("mean", 0, 2, 100.0, round(14 / 3, 6)),
         ("largest", 1, 0, 1.0, 100.0), ("largest", 1, 0, 3.0, 100.0), ("largest", 1, 1, 10.0, 100.0), ("largest", 1, 2, 100.0, 10.0)])

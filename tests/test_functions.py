"""Ordered scans, exact quantiles and column helpers against plain Python."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from telltale.functions import columns, ordered, quantiles


@pytest.fixture(scope="module")
def stream(spark):
    """One stream with most of the rows, two short ones, ties in time and value."""
    rng = random.Random(5)
    rows = []
    for key, n in (("hot", 400), ("b", 7), ("c", 1)):
        t = 0
        for i in range(n):
            t += rng.choice([0, 1, 40, 4000, 90_000])
            v = None if rng.random() < 0.2 else float(rng.choice([0, 0, 1, 2.5, rng.gauss(0, 9)]))
            rows.append((key, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), i, v))
    return spark.createDataFrame(rows, "k string, ts timestamp, ord long, v double")


def both(frame, keys):
    return sorted(tuple("none" if x is None else str(x) for x in r) for r in frame.collect())


def test_chunked_scan_equals_plain_window(stream):
    args = dict(lag={"a": F.col("v")}, lead={"b": F.col("v")}, total={"s": F.when(F.col("v") > 0, 1).otherwise(0)},
                peak={"p": F.col("v")}, fill={"f": F.col("v")}, fill_next={"g": F.col("v")}, seen={"h": F.col("v")}, position="i")
    plain = ordered.scan(stream, ["k"], ["ts", "ord"], F.lit(0), **args)  # one chunk is a plain window
    for seconds in (60, 86_400):
        cut = ordered.scan(stream, ["k"], ["ts", "ord"], ordered.time_chunk("ts", seconds), **args)
        assert both(cut.select(plain.columns), ["k"]) == both(plain, ["k"])


def test_chunked_islands_equal_plain_window(stream):
    rule = lambda a, b: (b["us"] - a["us"]) > 3_000_000_000
    facts = {"us": columns.micros("ts")}
    plain = ordered.islands(stream, ["k"], ["ts", "ord"], F.lit(0), facts, rule)
    cut = ordered.islands(stream, ["k"], ["ts", "ord"], ordered.time_chunk("ts", 3600), facts, rule)
    assert both(cut.select(plain.columns), ["k"]) == both(plain, ["k"])
    assert plain.agg(F.max("island")).first()[0] > 3


def test_suggested_chunk_keeps_the_row_target(stream):
    seconds = ordered.suggest_chunk_seconds(stream, ["k"], "ts", 40)
    worst = stream.groupBy("k", ordered.time_chunk("ts", seconds)).count().agg(F.max("count")).first()[0]
    assert worst <= 40 or seconds == 3600


def test_quantiles_are_exact(stream):
    probs = {"q05": 0.05, "q50": 0.5, "q99": 0.99}
    got = {r["k"]: r for r in quantiles.grouped_quantiles(stream, ["k"], "v", probs).collect()}
    values = stream.where("v is not null").toPandas().groupby("k")["v"]
    for key, v in values:
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.percentile(v, p * 100), abs=1e-9)


def test_quantiles_of_values_crowded_in_a_narrow_range(spark):
    values = [1e9, -1e9, 5e8, -3e7] + [i * 1e-6 for i in range(3000)] + [0.5] * 500
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double")
    row = quantiles.grouped_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.999}).first()
    assert [row[c] for c in "abc"] == pytest.approx([np.percentile(values, p) for p in (10, 50, 99.9)])


def test_weighted_selection_takes_the_first_value_at_the_target(stream):
    w = F.when(F.col("ord") % 3 == 0, 5.0).otherwise(1.0)
    got = {r["k"]: r for r in quantiles.select_by_weight(
        stream, ["k"], "v", {"m": F.col("total") * 0.5, "top": F.col("total")}, w).collect()}
    pdf = stream.withColumn("w", w).where("v is not null").toPandas()
    for key, part in pdf.groupby("k"):
        part = part.sort_values("v")
        at = min(int(np.searchsorted(part["w"].cumsum(), part["w"].sum() / 2)), len(part) - 1)
        assert got[key]["m"] == part["v"].iloc[at]
        assert got[key]["top"] == part["v"].max()


def test_numbers_are_plain_and_finite(spark):
    texts = ["1", " 2.5 ", "-3e2", "5d", "NaN", "inf", "", "1,2", ".5", "7."]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(columns.to_numeric("t").alias("v"))
    assert [r["v"] for r in df.collect()] == [1.0, 2.5, -300.0, None, None, None, None, None, 0.5, 7.0]


def test_number_text_matches_six_digit_format(spark):
    values = [0.0, 1.0, -2.5, 123456.0, 1234567.0, 0.00012345678, 0.000012, 3.14159265, 100.0, 99999.93, 1e-20]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["t"] for r in df.orderBy("i").select(columns.number_text("v").alias("t")).collect()]
    assert got == [f"{v:.6g}" for v in values]


def test_natural_order_and_linspace(spark):
    names = ["a10.csv", "a2.csv", "A1.csv", "b1"]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(columns.natural_key("n"))
    assert [r["n"] for r in df.collect()] == ["A1.csv", "a2.csv", "a10.csv", "b1"]
    grid = spark.range(20).select(columns.linspace_index(F.col("id"), F.lit(333).cast("long"), F.lit(20).cast("long")).alias("i"))
    assert [r["i"] for r in grid.collect()] == list(np.linspace(0, 332, 20, dtype=int))


def test_blocks_are_near_equal(spark):
    for n, k in ((10, 3), (7, 7), (200, 16)):
        df = spark.range(n).select(ordered.block_of(F.col("id"), F.lit(n), F.lit(k)).alias("b"))
        sizes = [len(a) for a in np.array_split(np.arange(n), k)]
        got = df.groupBy("b").count().orderBy("b").collect()
        assert [r["count"] for r in got] == sizes


def test_natural_key_of_long_numbers(spark):
    names = ["f" + "1" * 25 + "9", "f" + "1" * 25 + "2", "f2", "f10", "f002"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", columns.natural_key("n").alias("k"))
    keys = {r["n"]: r["k"] for r in df.collect()}
    assert keys[names[1]] < keys[names[0]] and keys["f2"] == keys["f002"] < keys["f10"] < keys[names[1]]

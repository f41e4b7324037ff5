"""Digests of ordered groups and global places against plain Python."""
import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from telltale.functions.ordered import time_chunk
from telltale.operators import identity

START = datetime(2024, 1, 1)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_digest(texts: list[str], fan: int) -> str:
    nodes = [sha(t) for t in texts]
    while True:
        blocks = [nodes[i:i + fan] for i in range(0, len(nodes), fan)]
        nodes = [b[0] if len(b) == 1 else sha("".join(b)) for b in blocks]
        if len(nodes) == 1:
            return sha(f"{len(texts)}:{nodes[0]}")


def stream(spark, groups: dict):
    rows = [(k, 0, START + timedelta(minutes=37 * i), i, v) for k, values in groups.items() for i, v in enumerate(values)]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, "stream_id long, segment long, ts timestamp, ord long, reading double").repartition(5)


def test_digests_equal_a_plain_fold(spark):
    draw = random.Random(1)
    groups = {k: [draw.choice([None, draw.randrange(1000) / 4]) for _ in range(n)] for k, n in
              {1: 1, 2: 2, 3: 3, 4: 4, 5: 9, 6: 10, 7: 27, 8: 28, 9: 200, None: 30}.items()}
    found = identity.segment_digests(stream(spark, groups), ["reading"], fan=3)
    want = {k: (len(v), plain_digest(["" if x is None else str(int(x * 1e6)) for x in v], 3)) for k, v in groups.items()}
    assert {r.stream_id: (r.n_rows, r.digest) for r in found.collect()} == want


def test_equal_waveforms_agree_and_their_order_counts(spark):
    found = identity.segment_digests(stream(spark, {1: [1.0, 2.0, 2.0], 2: [1.0, 2.0, 2.0], 3: [2.0, 1.0, 2.0], 4: [1.0, 2.0],
                                                    5: [1.0000001, 2.0, 2.0]}), ["reading"])
    again = identity.repeated_content(found, F.col("stream_id")).collect()
    assert [(r.n_rows, r.members, r.first) for r in again] == [(3, 3, 1)]


def test_a_case_does_not_depend_on_its_columns_order_or_case(spark):
    rows = [(1, START + timedelta(hours=i), f"{car:02d}", float(i * car), "A" if i % 2 else None) for i in range(20) for car in range(1, 4)]
    one = spark.createDataFrame(rows, "file_id long, ts timestamp, car string, cabin double, mode string")
    other = one.repartition(3).select(F.lit(2).cast("long").alias("file_id"), F.col("mode").alias("Mode"), "cabin", "car", "ts", F.lit("x").alias("_note"))
    changed = one.withColumns({"file_id": F.lit(3).cast("long"), "cabin": F.when((F.col("car") == "02") & (F.hour("ts") == 7), -1.0).otherwise(F.col("cabin"))})
    a, = identity.case_digests(one, ["cabin"], ["mode"], fan=4).collect()
    b, = identity.case_digests(other, ["cabin"], ["Mode"], fan=4).collect()
    c, = identity.case_digests(changed, ["cabin"], ["mode"], fan=4).collect()
    assert a.digest == b.digest != c.digest and a.n_rows == 60


def test_empty_tables(spark):
    empty = stream(spark, {1: [1.0]}).where("false")
    assert identity.segment_digests(empty, ["reading"]).collect() == []
    assert identity.global_places(empty, ["ts", "ord"]).collect() == []


@pytest.mark.parametrize("partitions", [1, 7])
def test_places_are_the_sorted_order(spark, partitions):
    draw = random.Random(3)
    rows = [(START if draw.random() < 0.4 else draw.choice([None, START + timedelta(hours=draw.randrange(500))]), draw.choice("abc"), i)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "ts timestamp, component string, ord long").repartition(partitions)
    found = {r.place: (r.ts, r.component, r.ord) for r in identity.global_places(df, ["ts", "component", "ord"]).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or START, r[1], r[2]))
    assert [found[i + 1] for i in range(len(rows))] == want and len(found) == len(rows)


def test_repeated_rows_take_consecutive_places(spark):
    df = spark.createDataFrame([(1,), (1,), (0,), (1,)], "ord long")
    assert sorted((r.place, r.ord) for r in identity.global_places(df, ["ord"]).collect()) == [(1, 0), (2, 1), (3, 1), (4, 1)]

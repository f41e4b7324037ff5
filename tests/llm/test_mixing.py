"""Targets, samples and copies of the mix."""
from collections import defaultdict

from pyspark.sql import functions as F

from oracle import compare, duck
from telltale.llm import mixing
from telltale.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def slow_targets(sizes, cycle=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    left, out, todo = float(sum(sizes.values())), {}, set(names)
    while todo:
        level = left / sum(weights[s] for s in todo)
        over = {s for s in todo if level * weights[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * weights[s] for s in todo}
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        todo -= over
    return out


def test_targets_equal_repeated_resharing(spark):
    for sizes in ({"a": 100, "b": 5, "c": 70, "d": 3, None: 40}, {"a": 1}, {"x": 10, "y": 0, "z": 1000, "w": 2, "v": 7}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = slow_targets(sizes)
        assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_query_equals_sql(spark):
    text, ok = compare(spark, duck(SF), SF, *QUERIES["op8_mixing"])
    assert ok, text


def test_taken_words_meet_the_targets(real_docs):
    rows = mixing.mix(real_docs).collect()
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.taken <= 3 * r.size and r.taken == r.epochs * r.size
        assert r.epochs >= int(r.target / r.source_size + 1e-9)  # whole epochs come first
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for r in rows:
        assert abs(taken[r.source] - r.target) <= largest[r.source]


def test_reruns_and_row_order_agree(real_docs):
    a = sorted(map(str, mixing.mix(real_docs).collect()))
    b = sorted(map(str, mixing.mix(real_docs.repartition(7)).collect()))
    assert a == b
    assert a != sorted(map(str, mixing.mix(real_docs, seed=1).collect()))


def test_heavier_documents_are_taken_more_often(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"),
                                  F.when(F.col("id") < 400, "s").otherwise("t").alias("source"))
    got = mixing.mix(df, weight=F.when(F.col("doc_id") % 2 == 0, F.lit(4.0)).otherwise(F.lit(1.0)))
    share = got.where("source = 't'").groupBy(F.col("doc_id") % 2).agg(F.avg(F.col("epochs") % 2)).collect()
    by = {r[0]: r[1] for r in share}
    assert by[0] > by[1]


def test_bins_are_even_for_every_weight(spark):
    for w in (0.05, 0.2, 1.0, 7.0):
        rows = spark.range(40000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text")).select(
            mixing._bin(mixing._size_and_key(F.lit(w), 0)[1]).alias("bin"))
        assert max(r["count"] for r in rows.groupBy("bin").count().collect()) < 60


def test_light_weights_equal_one_ordering(spark):
    """Texts of digits (weight 0.05), with sizes from 0 to 6, against the order of all keys."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('123 ', CAST(id % 7 AS INT))").alias("text"),
                                  F.when(F.col("id") % 3 == 0, "s").otherwise("t").alias("source"))
    size, key = mixing._size_and_key(None, 0)
    keys = {r.doc_id: (r.key, r.size) for r in df.select("doc_id", key.alias("key"), size.alias("size")).collect()}
    rows = mixing.mix(df).collect()
    for source in "st":
        own = sorted((r for r in rows if r.source == source), key=lambda r: (keys[r.doc_id][0], r.doc_id))
        whole = int(own[0].target // own[0].source_size)
        rest, before = own[0].target - whole * own[0].source_size, 0
        for r in own:
            assert r.epochs == whole + (rest > 0 and before + r.size / 2 <= rest)
            before += r.size


def test_repeated_and_null_ids_take_their_share(spark):
    clash = "_source _bin _copies _copy _words _id _size _edge _whole key bin row copies whole more n place edge".split()
    df = spark.range(3000).select(F.when(F.col("id") < 800, F.col("id") % 40).alias("doc_id"), F.lit("one two three four").alias("text"),
                                  F.concat(F.lit("s"), F.col("id") % 2).alias("source"), *[F.lit(c).alias(c) for c in clash])
    rows = mixing.mix(df)
    target = {r.source: (r.target, r.taken) for r in rows.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    out = mixing.epochs(df)
    assert out.columns == df.columns and out.where("_bin <> '_bin' OR row <> 'row'").isEmpty()
    for r in out.groupBy("source").agg((F.count(F.lit(1)) * 4).alias("taken")).collect():
        assert r.taken == target[r.source][1] and abs(r.taken - target[r.source][0]) <= 4


def test_odd_rows(odd_docs, no_docs):
    assert mixing.mix(odd_docs).count() == odd_docs.count() and mixing.mix(no_docs).count() == 0
    out = mixing.epochs(odd_docs)
    assert out.columns == odd_docs.columns
    assert mixing.epochs(no_docs).count() == 0
    words = {r.doc_id: r.size for r in mixing.mix(odd_docs).collect()}
    assert words[3] == 0 and words[4] == 0 and words[9] == 30000

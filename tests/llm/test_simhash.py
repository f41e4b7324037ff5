"""Fingerprints, covering and groups against brute force."""
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from telltale.llm import simhash


def slow_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows, threshold):
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    names = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        if doc is not None:
            names[r] = min(names.get(r, doc), doc)
    return sorted(((doc, fps[i], names.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def found_groups(df, **options):
    rows = simhash.groups(df, **options).collect()
    return sorted(((r.doc_id, r.fp & (2 ** 64 - 1), r.component_id) for r in rows), key=str)


def test_groups_equal_brute_force(spark, real_docs, odd_docs, no_docs):
    for df in (real_docs, odd_docs):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert found_groups(df) == slow_groups(rows, 3)
    assert simhash.groups(no_docs).count() == 0


def test_spark_hashes_shingles_alike(spark):
    row = spark.sql("SELECT xxhash64('the quick brown') AS h").first()
    assert row.h & (2 ** 64 - 1) == xxhash.xxh64_intdigest(b"the quick brown", 42)


def test_covering_finds_every_near_pair(spark):
    draw = random.Random(3)
    fps = {draw.getrandbits(64) for _ in range(120)}
    for f in list(fps):
        for _ in range(3):
            fps.add(f ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(1, 9))))
    fps = sorted(np.array(sorted(fps), dtype=np.uint64).view(np.int64).tolist())
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for threshold in (1, 3, 5, 7):
        want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= threshold}
        got = [(r.a, r.b) for r in simhash.links(df, threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_own_anchor_is_visited_within_two_bits():
    for m in (3, 4, 5):
        own, moves = simhash._moves(m)
        assert len(moves) == 2 ** m and all(len(x) == 2 ** (m - 1) for x in moves[1:]) and own[0] == 0


def test_one_row_of_each_group_stays(spark, odd_docs, no_docs):
    kept = simhash.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    want = {r.component_id for r in simhash.groups(odd_docs).select("component_id").distinct().collect()}
    assert sorted(map(str, ids)) == sorted(map(str, want))
    assert simhash.representatives(no_docs).count() == 0


def test_long_chain_is_one_group(spark):
    nodes = spark.range(300).select(F.col("id").alias("node"), (1000 - F.col("id")).alias("rank"))
    pairs = spark.range(299).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in simhash.components(nodes, pairs).collect()} == {701}

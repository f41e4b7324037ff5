"""Near copies of the pipeline against the Jaccard similarity of all pairs."""
import random

import numpy as np

from telltale.llm import nearcopies

import corpus_pipeline


def sets(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def slow_kept(rows, similarity=0.8):
    """The smallest id of each component; ids are distinct and not null."""
    found = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(found):
        for j in range(i):
            y = found[j]
            if x == y or len(x & y) >= similarity * len(x | y) - 1e-9:
                root[find(i)] = find(j)
    best = {}
    for i, (doc, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), doc), doc)
    return sorted(best.values())


def corpus(draw, bases, copies):
    vocabulary = [f"w{i}" for i in range(500)]
    out = []
    for _ in range(bases):
        words = [draw.choice(vocabulary) for _ in range(draw.randrange(60, 300))]
        out.append(" ".join(words))
        for _ in range(copies):
            new = list(words)
            for _ in range(draw.randrange(0, max(2, len(words) // 25))):
                new[draw.randrange(len(new))] = draw.choice(vocabulary)
            out.append(" ".join(new))
    draw.shuffle(out)
    return list(enumerate(out))


def test_stage_equals_all_pairs(spark):
    for seed, bases, copies in ((1, 40, 4), (2, 2, 60)):  # many small groups; crowds whose members are apart from each other
        rows = corpus(random.Random(seed), bases, copies)
        kept = corpus_pipeline.copies_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
        assert sorted(r.doc_id for r in kept.collect()) == slow_kept(rows)


def test_stage_on_real_texts(spark, real_docs):
    rows = [(r.doc_id, r.text) for r in real_docs.collect()]
    assert sorted(r.doc_id for r in nearcopies.representatives(real_docs).collect()) == slow_kept(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    kept = nearcopies.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    # 2 is 1 again, 4 and 5 have no words like 3, 8 differs from 7 in case only, 9 and the null id repeat.
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [1, -5, 3, 6, 7, 9, 10, 11, 12, None]))
    assert nearcopies.representatives(no_docs).count() == 0


def test_fingerprints_within_three_bits_are_candidates(spark):
    rows = [(1, 10, 0), (2, 11, 0), (3, 12, 0b111), (4, 13, 0b1111 << 40), (5, 14, 0b11 << 40)]
    found = nearcopies._by_fingerprint(spark.createDataFrame(rows, "node long, size int, fp long")).collect()
    fps = {n: fp for n, _, fp in rows}
    assert {frozenset((r.a, r.b)) for r in found} == {frozenset(p) for p in ((1, 2), (1, 3), (1, 5), (4, 5))}
    assert all((fps[r.a] ^ fps[r.b]).bit_count() <= 3 and r.a_size == r.a + 9 and r.b_size == r.b + 9 for r in found)


def test_parities_differ_in_no_more_bits_than_the_sets_in_shingles():
    draw = np.random.default_rng(3)
    for size in (0, 1, 40, 400, 5000):
        x = np.unique(draw.integers(0, 2 ** 63, size, dtype=np.uint64))
        y = np.unique(np.concatenate([x[size // 5:], draw.integers(0, 2 ** 63, size // 7, dtype=np.uint64)]))
        bits = int(np.bitwise_count((nearcopies.parities(x) ^ nearcopies.parities(y)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(x, y)) and (bits > 0) == (size > 1)


def test_a_crowd_of_texts_that_are_no_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    draw = random.Random(11)
    base = [f"w{draw.randrange(500)}" for _ in range(200)]
    rows = [(i, " ".join(base + [f"v{draw.randrange(5000)}" for _ in range(60)])) for i in range(80)]
    compared, plain = [], nearcopies._alike
    monkeypatch.setattr(nearcopies, "_alike", lambda pairs, *rest: compared.append(pairs.count()) or plain(pairs, *rest))
    out = nearcopies.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in out.collect()) == slow_kept(rows) == list(range(80))
    assert sum(compared) <= 80  # 3,160 pairs, nearly all of them with a key in common

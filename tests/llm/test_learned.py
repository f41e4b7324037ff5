"""Learned operators: gradients, held-out accuracy, brute-force priors, exact round trips and recall."""
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from telltale.llm import crf, langid, learn, neighbours, pieces, pii, quality, toxicity
from telltale.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PII_DATA = "/root/testdata/sf0.1"


# Personal data

def slow_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def test_fixed_patterns_equal_the_contract():
    draw = random.Random(4)
    for _ in range(4000):
        text = "".join(draw.choice("a1.@+- (5é") for _ in range(draw.randrange(40)))
        assert sorted(pii.base_spans(text)) == sorted(slow_base(text)), text
    for text in ("a@b.c.@d.e", "4111 1111 1111 1111 1.2.3.4.5.6.7.8", "+1 (569) 555-6633 4795326016703902", "x@y.z@w.v"):
        assert sorted(pii.base_spans(text)) == sorted(slow_base(text))


def test_windows_cover_every_anchor():
    text = "9" * 500 + " " * 300 + "a@b" + "x" * 90 + "1"
    got = pii.windows(text)
    assert all(any(a <= i < b for a, b, _, _ in got) for i, c in enumerate(text) if c in "9@1")
    assert all(b - a <= pii.WIDTH for a, b, _, _ in got)


def test_gradient_of_the_tagger():
    tagger = crf.Tagger(3, np.ones((3, 3), bool), np.ones(3, bool), seed=2)
    codes, lengths = crf.encode(["ab1", "c22 d"], 6)
    labels = np.array([[0, 1, 2, 0, 0, 0], [2, 2, 1, 0, 1, 0]])

    def loss(t):
        mask = (np.arange(6)[None, :] < lengths[:, None]).astype(np.float32)
        emit, _, _ = t.emissions(codes, mask)
        total = 0.0
        for i, n in enumerate(lengths):
            a = emit[0, i].astype(float)
            for s in range(1, n):
                a = np.logaddexp.reduce(a[:, None] + t.w["move"], axis=0) + emit[s, i]
            gold = sum(emit[s, i, labels[i, s]] for s in range(n)) + sum(t.w["move"][labels[i, s - 1], labels[i, s]] for s in range(1, n))
            total += np.logaddexp.reduce(a) - gold
        return total / len(lengths)

    for name in ("embed", "in_f", "own_b", "bias_f", "out", "move"):
        at = tuple(0 if name != "embed" else int(codes[0, 0]) if d == 0 else 1 for d in range(tagger.w[name].ndim))
        numeric = []
        for e in (1e-2, -1e-2):
            tagger.w[name][at] += e
            numeric.append(loss(tagger))
            tagger.w[name][at] -= e
        slope = (numeric[0] - numeric[1]) / 2e-2
        probe = crf.Tagger(3, np.ones((3, 3), bool), np.ones(3, bool), seed=2)
        value = probe.step(codes, lengths, labels, 0.0)
        assert abs(value - loss(tagger)) < 1e-3
        assert abs(probe.m[name][at] / 0.1 - slope) < 2e-2 * max(1, abs(slope)), name


def test_tagger_finds_values_side_by_side():
    draw = random.Random(8)
    words = "the of and here there some other words again in on at".split()

    def value(kind):
        n = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
        if kind == 2:
            head = "4" + n(14)
            return next(head + d for d in "0123456789" if pii.luhn(head + d))
        return {0: f"bob.{n(2)}@mail{n(1)}.example.com", 1: ".".join(str(draw.randrange(256)) for _ in range(4)),
                3: f"+1 ({n(3)}) 555-{n(4)}"}[kind]

    def row(kinds):
        text = " ".join(draw.choice(words) for _ in range(4)) + " "
        spans = []
        for k in kinds:
            v = value(k)
            spans.append((k, len(text), len(text) + len(v)))
            text += v + " "
        return (text + " ".join(draw.choice(words) for _ in range(3)), spans)

    rows = [row([draw.randrange(4)]) for _ in range(400)] + [row([]) for _ in range(200)]
    tagger = pii.train(rows, rounds=160)
    tests = [row([3, 2]) for _ in range(40)]
    base = [pii.base_spans(t) for t, _ in tests]
    got = pii.added_spans([t for t, _ in tests], base, tagger)
    want = sum(s not in b for (_, spans), b in zip(tests, base) for s in spans)
    hits = sum(s in g for (_, spans), b, g in zip(tests, base, got) for s in spans if s not in b)
    extra = sum(s not in spans for (_, spans), g in zip(tests, got) for s in g)
    assert want >= 60 and hits >= 0.8 * want and extra <= 0.1 * want


def planted(text, draw):
    """The text with a value that the patterns miss at a random place between words, and its spans."""
    n = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    head = "4" + n(14)
    card = next(head + d for d in "0123456789" if pii.luhn(head + d))
    phone = f"({n(3)}) {n(3)}-{n(4)}"
    values = draw.choice([[(3, "+1 " + phone), (2, card)], [(3, phone)], [(3, "1 " + phone)], [(2, card), (2, card[:4] + "4" + card[5:])]])
    gaps = [i for i, c in enumerate(text) if c == " "]
    at = draw.choice(gaps) if gaps else 0
    out, spans = text[:at] + " ", []
    for kind, value in values:
        if pii.valid(kind, value):
            spans.append((kind, len(out), len(out) + len(value)))
        out += value + " "
    return out + text[at:].lstrip(" "), spans


def test_tagger_finds_in_documents_what_the_patterns_miss(spark):
    """Fitted on documents with even ids; values planted in the others. Nothing is planted for the precision's texts."""
    docs = spark.read.parquet(f"{PII_DATA}/documents.parquet").select("doc_id", "text")
    tagger = pii.fit(docs.where("doc_id % 2 = 0"))
    draw = random.Random(9)
    texts = [r["text"] for r in docs.where("doc_id % 2 = 1 and length(text) > 0").orderBy("doc_id").limit(1500).collect()]
    cases = [planted(t, draw) for t in texts]
    base = [pii.base_spans(t) for t, _ in cases]
    got = pii.added_spans([t for t, _ in cases], base, tagger)
    hits = missed = extra = 0
    for (_, spans), b, g in zip(cases, base, got):
        left = {s for s in spans if s not in b and not any(x < s[2] and y > s[1] for _, x, y in b)}
        hits, missed = hits + len(left & set(g)), missed + len(left - set(g))
    clean = pii.added_spans(texts, [pii.base_spans(t) for t in texts], tagger)
    for t, g in zip(texts, clean):
        # Cards and phones that stand side by side in a text as it is are real finds.
        extra += sum(not (k == 2 or t[a] == "+") for k, a, b in g)
    assert hits >= 0.8 * (hits + missed) and hits >= 0.9 * (hits + extra)


def test_the_decoder_finds_the_best_labels():
    """Viterbi against every sequence of labels."""
    import itertools
    tagger = crf.Tagger(3, np.array([[1, 1, 0], [1, 1, 1], [1, 1, 1]], bool), np.array([1, 1, 0], bool), seed=5)
    codes, lengths = crf.encode(["a1b2", "@", "77 x9"], 6)
    mask = (np.arange(6)[None, :] < lengths[:, None]).astype(np.float32)
    emit, _, _ = tagger.emissions(codes, mask)
    labels, _ = tagger.decode(codes, lengths)
    for i, n in enumerate(lengths):
        def total(seq):
            legal = seq[0] != 2 and all((a, b) != (0, 2) for a, b in zip(seq, seq[1:]))
            if not legal:
                return -np.inf
            return sum(emit[s, i, l] for s, l in enumerate(seq)) + sum(tagger.w["move"][a, b] for a, b in zip(seq, seq[1:]))
        best = max(itertools.product(range(3), repeat=int(n)), key=total)
        assert abs(total(best) - total(tuple(int(x) for x in labels[i][:n]))) < 1e-4


def test_reconcile_takes_the_best_set():
    found = {(0, 0, 5): 2.0, (1, 4, 9): 3.0, (2, 9, 12): 1.0, (3, 5, 9): 1.5}
    assert pii.reconcile(found, []) == [(2, 9, 12), (1, 4, 9)] or set(pii.reconcile(found, [])) == {(0, 0, 5), (3, 5, 9), (2, 9, 12)}
    assert set(pii.reconcile(found, [(0, 3, 6)])) == {(2, 9, 12)}


def test_personal_data_of_odd_rows(odd_docs, no_docs):
    rows = {r.doc_id: r for r in pii.detect(odd_docs, None).collect()}
    assert rows[11].n_email == 1 and rows[11].n_ip == 1 and rows[3].spans == "" and rows[4].n_added == 0
    assert pii.detect(no_docs, pii.fit(no_docs)).count() == 0
    assert pii.redact("x a@b.cc y", "email:2:8") == "x [email] y"


# Toxicity

def test_toxicity_learns_words(spark):
    draw = random.Random(5)
    words = "alpha beta gamma delta words other things here there".split()
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        text = [draw.choice(words) for _ in range(30)] + (["moronic" + draw.choice("abc")] if bad else [])
        draw.shuffle(text)
        rows.append((i, " ".join(text), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), keep=~toxicity.held_out())
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    out = [i for i, _, _ in rows if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert learn.auc([got[i] for i in out], [rows[i][2] for i in out]) > 0.98
    assert {r.doc_id for r in docs.where(toxicity.held_out()).collect()} == set(out)


def test_toxicity_of_odd_rows(odd_docs, no_docs, no_labels):
    model = toxicity.fit(odd_docs, no_labels)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == 16 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(no_docs, model).count() == 0


# Quality

def test_priors_equal_a_plain_computation(spark):
    draw = random.Random(6)
    rows = [(f"h{draw.randrange(5)}" if draw.random() < 0.9 else None, f"p{draw.randrange(3)}", round(draw.random(), 3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "_host string, _path string, _p double")
    sites, level = quality._sites(df)
    n, mean = len(rows), sum(p for _, _, p in rows) / len(rows)
    hosts, paths = {}, {}
    for h, w, p in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, w), []).append(p)
    var = sum(len(v) * (np.mean(v) - mean) ** 2 for v in hosts.values()) / n - len(hosts) * mean * (1 - mean) / n
    k1 = min(max(mean * (1 - mean) / max(var, 1e-6) - 1, 1), 1e6)
    assert abs(level.mean - mean) < 1e-9 and abs(level.host_strength / k1 - 1) < 1e-6
    share = 0.7
    got = sorted(r.s for r in df.join(sites, quality._same_site()).select(quality.posterior(level, share).alias("s")).collect())
    want = []
    for h, w, p in rows:
        host = (sum(hosts[h]) - p + level.host_strength * mean) / (len(hosts[h]) - 1 + level.host_strength)
        path = (sum(paths[h, w]) - p + level.path_strength * host) / (len(paths[h, w]) - 1 + level.path_strength)
        lo = lambda q: np.log(min(max(q, 1e-4), 1 - 1e-4) / (1 - min(max(q, 1e-4), 1 - 1e-4)))
        want.append(1 / (1 + np.exp(-(lo(p) - np.log(share / (1 - share)) + lo(path)))))
    assert np.allclose(got, sorted(want))


def test_quality_separates_the_labels(spark, real_docs, real_labels):
    model = quality.fit(real_docs, real_labels)
    got = quality.scores(real_docs, model, F.col("source"), F.col("lang")).join(real_labels, "doc_id").collect()
    assert learn.auc([r.score for r in got], [r.quality for r in got]) > 0.95


def test_quality_of_odd_rows(odd_docs, no_docs, no_labels):
    model = quality.fit(odd_docs, no_labels)
    assert quality.scores(odd_docs, model, F.col("source"), F.col("lang")).count() == 16
    kept = quality.accepted(odd_docs, model, F.col("source"), F.col("lang"))
    assert kept.columns == odd_docs.columns
    assert quality.accepted(no_docs, model, F.col("source"), F.col("lang")).count() == 0


# Pieces

@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary()


def test_every_text_comes_back(vocab):
    draw = random.Random(9)
    rows = ["".join(draw.choice("ab the ▁漢é😀\n\t\x00\x1c  ") for _ in range(draw.randrange(60))).encode() for _ in range(500)]
    rows += [b"", b" ", b"x" * 3000, ("é" * 700).encode()]
    keys = np.arange(len(rows)).astype(np.uint64)
    flat, counts = pieces.encode_batch(rows, keys, vocab)
    ends = np.cumsum(counts)
    assert [pieces.decode(flat[e - n:e], vocab) for e, n in zip(ends, counts)] == rows


def test_draws_do_not_depend_on_the_batch(vocab):
    rows = [f"some words of row {i} and more of them".encode() for i in range(50)]
    keys = np.arange(50).astype(np.uint64)
    whole = pieces.encode_batch(rows, keys, vocab)[0].tolist()
    assert whole == [p for i in range(50) for p in pieces.encode_batch(rows[i:i + 1], keys[i:i + 1], vocab)[0].tolist()]
    assert whole == pieces.encode_batch(rows, keys, vocab, group=7)[0].tolist()


def test_long_texts_and_copies_are_cut_in_groups(spark, vocab, monkeypatch):
    draw = random.Random(3)
    rows = ["".join(draw.choice(["the ", "x", "  ", "é", "\n"]) for _ in range(draw.randrange(300))).encode() for _ in range(40)]
    keys = np.arange(40).astype(np.uint64)
    whole, counts = pieces.encode_batch(rows, keys, vocab)
    for group in (1, 50, 1000):
        parts = list(pieces._parts(rows, group))
        assert b"".join(p for _, _, p in parts) == b"".join(rows) and all(rows[r][at:at + len(p)] == p for r, at, p in parts)
        some, n = pieces.encode_batch(rows, keys, vocab, group)
        assert some.tolist() == whole.tolist() and n.tolist() == counts.tolist()
    long = [(1, "some text of words " * 200_000, "k"), (1, "some text of words " * 200_000, "k"), (2, None, "k"), (2, None, "k"), (2, "", "k"), (3, "some text", "k")]
    df = spark.createDataFrame(long, "doc_id long, text string, _key string").withColumn("lossless", F.lit("old"))
    got = pieces.encoded(df, verify=True).collect()
    assert [(r.doc_id, r.text, r._key) for r in got] == long and all(r.lossless for r in got)
    assert got[0].pieces == got[1].pieces and [r.pieces for r in got[2:5]] == [None, None, []]


def test_sampled_shares_equal_all_segmentations(vocab):
    ids = {n: i for i, n in enumerate(vocab.names) if n and i >= 259}

    def ways(text):
        if not text:
            yield (), 0.0
        for j in range(1, len(text) + 1):
            if text[:j] in ids:
                for rest, w in ways(text[j:]):
                    yield (ids[text[:j]], *rest), w + vocab.log_weight[ids[text[:j]]]

    chunk, n = b" there", 20000
    every = dict(ways(chunk))
    total = sum(np.exp(w) for w in every.values())
    flat, counts = pieces.encode_batch([chunk] * n, np.random.default_rng(0).integers(0, 2 ** 63, n).astype(np.uint64), vocab)
    seen, at = {}, 0
    for c in counts:
        got = tuple(flat[at:at + c].tolist())
        seen[got] = seen.get(got, 0) + 1
        at += c
    assert set(seen) <= set(every)
    for way, w in every.items():
        assert abs(seen.get(way, 0) / n - np.exp(w) / total) < 0.01


def test_pieces_of_odd_rows(odd_docs, no_docs):
    rows = pieces.decoded(pieces.encoded(odd_docs)).collect()
    assert len(rows) == 16 and all(r.decoded == r.text for r in rows)
    assert [r.pieces for r in rows if r.doc_id == 3] == [None] and [r.pieces for r in rows if r.doc_id == 4] == [[]]
    assert pieces.encoded(no_docs).count() == 0


# Neighbours

def test_neighbours_of_a_small_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    odd = spark.createDataFrame([(9000, None, 0), (9020, [0.0] * 64, 0), (9040, [float("nan")] * 64, 0), (9060, [1.0], 0), (None, [1.0] * 64, 0)],
                                "vec_id long, embedding array<float>, label int")
    rows = neighbours.usable(df.unionByName(odd))
    x = {r.vec_id: np.array(r.x) for r in rows.collect()}
    assert not {9000, 9020, 9040, 9060, None} & set(x)
    got = neighbours.search(rows, F.col("vec_id") % 20 == 0, neighbours.fit(rows), 20).collect()
    hits = total = 0
    for q in (i for i in x if i % 20 == 0):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        best = sorted(((-float(x[q] @ v), i) for i, v in x.items() if i != q))[:20]
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and q not in {m[1] for m in mine}
        assert all(abs(m[2] - float(x[q] @ x[m[1]])) < 1e-12 for m in mine)
        hits += len({m[1] for m in mine} & {i for _, i in best})
        total += len(best)
    assert hits >= 0.9 * total


def test_many_equal_vectors_are_split_and_tie_by_id(spark):
    df = spark.range(1, 2001).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 < 2, F.array(F.lit(1.0), F.lit(2.0))).otherwise(
        F.array(F.sin("id"), F.cos("id"))).alias("embedding"))
    rows = neighbours.usable(df)
    got = neighbours.search(rows, F.col("vec_id") == 60, neighbours.fit(rows), 5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 3, 4, 6, 7] and all(r.score == 5.0 for r in got)
    few = rows.where("vec_id in (20, 21, 22)")
    assert neighbours.search(few, F.col("vec_id") == 20, neighbours.fit(few), 20).count() == 2
    assert neighbours.fit(rows.where("false")) is None


# Languages

def test_languages_of_pages(spark, real_docs):
    model = langid.fit(real_docs)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = langid.identify(pages, model).collect()
    assert len(rows) == pages.count()
    assert sum(r.lang == r.declared for r in rows) > 0.97 * len(rows)


def test_fusion_equals_a_plain_computation(spark, real_docs):
    model = langid.fit(real_docs)
    pages = spark.createDataFrame([(1, "http://a.x.org/en/1", "<html lang=en>the of and</html>"), (2, "http://a.x.org/2", "<html>the and</html>"),
                                   (3, None, None), (4, "http://b.x.org/de/", "<html lang=de>der und die</html>"), (5, "", "")],
                                  "page_id long, url string, html string")
    found = langid.evidence(pages, model).collect()
    k = len(model.languages)
    total = sum(np.array(r.soft) for r in found) + langid.SMOOTH
    got = {r.page_id: r for r in langid.identify(pages, model).collect()}
    for r in found:
        z = np.array(r.logs)
        own = np.array(r.soft)
        same = lambda c: sum(np.array(o.soft) for o in found if o[c] == r[c])
        dom = (same("domain") - own + langid.DOMAIN_STRENGTH * total / total.sum()) / (sum(same("domain")) - 1 + langid.DOMAIN_STRENGTH)
        host = (same("host") - own + langid.HOST_STRENGTH * dom) / (sum(same("host")) - 1 + langid.HOST_STRENGTH)
        z = z + np.log(total / total.sum() if r.host is None else np.maximum(host, 1e-9))
        for c in ("declared", "suffix"):
            if r[c] not in ("", "/"):
                kinds = len({o[c] for o in found})
                z = z + np.log(np.maximum((same(c) - own + langid.SMOOTH) / (total - own + langid.SMOOTH * kinds), 1e-9))
        assert got[r.page_id].lang == model.languages[int(z.argmax())]
        assert abs(got[r.page_id].probability - 1 / np.exp(z - z.max()).sum()) < 1e-9 and k == 4


def test_hostile_pages_take_linear_time(spark, real_docs):
    model = langid.fit(real_docs)
    for unit in ("<", "<html ", "<script ", "<!-- ", "</script  ", "lang ", "<html lang  ", "<p>le la "):
        start = time.perf_counter()
        page = unit * (5_000_000 // len(unit))
        langid.declared(page)
        langid.text_logs(langid.visible(page), model)
        assert time.perf_counter() - start < 8, unit
    assert langid.declared("<p lang=de><HTML data-x lang = 'FR'>") == "fr" and langid.declared("<html><html lang=de>") == ""
    assert langid.visible("a<script >x<y</script ><!-- <p> --><b>c</b>") == "a   c "


def test_slices_count_every_gram(monkeypatch):
    text = "Der Hund, und  die Katze -- ça va"
    want = langid.counted(text)
    assert want.sum() == sum(len(" ".join("der hund und die katze ça va".split())) - n for n in range(3))
    for size in (1, 2, 5):
        monkeypatch.setattr(langid, "SLICE", size)
        assert (langid.counted(text) == want).all()


def test_repeated_pages_and_clashing_names(spark, real_docs):
    page = ("http://a.org/fr/", "<html lang=fr>le chat et la souris</html>")
    df = spark.createDataFrame([(1, *page)] * 3 + [(None, None, None)], "page_id long, url string, html string").selectExpr(
        "*", *[f"'x' AS {c}" for c in ("declared", "host", "domain", "suffix", "logs", "soft", "lang", "_z", "_k_host")])
    rows = langid.identify(df, langid.fit(real_docs)).collect()
    assert len(rows) == 4 and len({(r.lang, r.probability) for r in rows if r.page_id == 1}) == 1


def test_empty_pages(spark, no_docs):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert langid.identify(pages, langid.fit(no_docs)).count() == 0


def test_pipeline_keeps_columns_and_clean_documents(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.STAGES[0][1](spark, docs, SF).columns == docs.columns
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "source", "n_pieces", "pieces"] and out.count() > 100


def test_queries_are_registered():
    assert [n for n in QUERIES] and all(any(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14))


def test_a_sparse_fit_holds_few_entries_at_a_time(monkeypatch):
    import tracemalloc

    from telltale.llm import learn
    draw = np.random.default_rng(3)
    lengths = draw.integers(0, 60, 400)
    starts, places = np.concatenate([[0], np.cumsum(lengths)]), draw.integers(0, 50, lengths.sum()).astype(np.int32)
    scale, y = draw.normal(size=50), draw.integers(0, 2, 400)
    whole = learn.logistic_sparse(starts, places, scale, y, np.ones(400), 1e-3)
    monkeypatch.setattr(learn, "ENTRIES", 100)
    parts = learn.logistic_sparse(starts, places, scale, y, np.ones(400), 1e-3)
    assert np.allclose(whole[0], parts[0]) and np.isclose(whole[1], parts[1])
    monkeypatch.setattr(learn, "ENTRIES", 10_000)
    starts, places = np.arange(0, 4_000_001, 1000), np.zeros(4_000_000, np.int32)
    tracemalloc.start()
    learn.logistic_sparse(starts, places, np.ones(1), np.arange(4000) % 2, np.ones(4000), 1e-3, rounds=2)
    assert tracemalloc.get_traced_memory()[1] < 8_000_000  # two bytes an entry
    tracemalloc.stop()

"""Phrase counts, cuts, containment and paths against a plain computation over all grams."""
import random
import re
from collections import Counter

from oracle import compare, duck

from telltale.llm import collocations as co
from telltale.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SMALL = {"least": 3, "top": 40, "bits": 16}


def slow_pieces(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
        yield re.findall(r"[^\x20\x09]+", piece)


def slow_counts(rows):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in slow_pieces(text):
            totals[lang] += len(words)
            for k in range(1, 5):
                counts.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    return counts, totals


def slow_mined(rows, least, top, covered=80):
    counts, totals = slow_counts(rows)
    found = {g: a for g, a in counts.items() if len(g[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in found.items():
        cuts = [(2000000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        longer = [b for (other, w), b in found.items() if other == lang and len(w) > len(words)
                  and any(w[i:i + len(words)] == words for i in range(len(w) - len(words) + 1))]
        if not any(100 * b >= covered * a for b in longer):
            row = (" ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], totals[lang], score)
            out.setdefault(lang, []).append(row)
    return {(lang, i + 1, *r) for lang, rs in out.items()
            for i, r in enumerate(sorted(rs, key=lambda r: (-r[5], -r[1], r[0].encode()))[:top])}


def mined(df, **options):
    rows = co.mined(df, **(SMALL | options)).collect()
    assert len({(r["lang"], r["phrase"]) for r in rows}) == len(rows)
    return {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows}


def corpus(seed, docs=60):
    draw = random.Random(seed)
    words = ["a", "b", "c", "d", "É", "😀", "Of", "the", "x\x1c"]
    passage = " ".join(f"p{i}" for i in range(9))
    out = []
    for _ in range(docs):
        parts = ["".join(draw.choice(words) + draw.choice([" ", "  ", "\t", ". ", "\n", ", "]) for _ in range(draw.randrange(14)))]
        if draw.random() < 0.4:
            parts.insert(0, passage + draw.choice([" ", "; "]))
        out.append(("".join(parts), draw.choice(["en", "en", "fr", None])))
    return out


def test_phrases_equal_a_plain_computation(spark):
    for seed in range(3):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "text string, lang string")
        assert mined(df) == slow_mined(rows, 3, 40)
        assert mined(df, bits=3) == slow_mined(rows, 3, 40), "colliding pairs only let more through"
        assert mined(df, least=1, top=7) == slow_mined(rows, 1, 7)


def test_flow_counts_every_frequent_phrase(spark):
    rows = corpus(9)
    df = spark.createDataFrame(rows, "text string, lang string")
    got = {(r["lang"], tuple(r["gram"].split(" ")) if r["gram"] else ()): r["times"]
           for r in co.flow(co.edges(df, co.pair_filter(df, 2, 16), 16), 2).collect()}
    counts, totals = slow_counts(rows)
    want = {g: c for g, c in counts.items() if c >= 2} | {(lang, ()): n for lang, n in totals.items() if n}
    assert got == want


def test_slices_end_with_a_piece(spark, monkeypatch):
    rows = corpus(4)
    want = slow_mined(rows, 3, 40)
    for size in (1, 17, 60):
        monkeypatch.setattr(co, "SLICE", size)
        data = "\n".join(t for t, _ in rows).encode().translate(co._LETTERS)
        assert b"\n".join(co._slices(data)) == data
        parts = [(t.decode(), lang) for text, lang in rows for t in co._slices(text.encode().translate(co._LETTERS))]
        assert slow_mined(parts, 3, 40) == want


def test_paths_are_the_repeated_passages(spark):
    rows = [("k l m n o p q r s t", "en")] * 5 + [("z y k l m n w", "en")] * 3 + [("a a a a a a", "en")] * 3 + [("u v w x", "fr")] * 2
    df = spark.createDataFrame(rows, "text string, lang string")
    phrases, between, chains = co.graph(df, 3, 16)
    got = {(r["passage"], r["words"], r["times"]) for r in co.passages(phrases, chains).collect()}
    # "k l m" and "l m n" are entered in two ways or left in two; the rest of the passage is one path.
    assert got == {("k l m n", 4, 8), ("l m n o p q r s t", 9, 5), ("l m n w", 4, 3), ("z y k l m", 5, 3), ("y k l m", 4, 3), ("a a a a", 4, 9)} - {("y k l m", 4, 3)}
    inside = {r["node"] for r in between.collect()}
    assert inside == {"m n o", "n o p", "o p q", "p q r", "q r s", "y k l"}


def test_long_path_needs_few_rounds(spark):
    text = " ".join(f"w{i}" for i in range(700))
    phrases, between, chains = co.graph(spark.createDataFrame([(text, "en")] * 3, "text string, lang string"), 3, 20)
    rows = co.passages(phrases, chains).collect()
    assert [(r["passage"], r["words"], r["times"]) for r in rows] == [(text, 700, 3)]


def test_exact_beyond_64_bits(spark):
    big = 6_000_000_000_000_000_000
    rows = [("en", "a b", 2, big), ("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "", 0, big)]
    got = co.scored(spark.createDataFrame(rows, "lang string, gram string, words int, times long")).collect()
    assert [(r["gram"], r["score"]) for r in got] == [("a b", 2000000 * big // (2 * big + 1))]


def test_query_equals_sql(spark):
    text, ok = compare(spark, duck(SF), SF, *QUERIES["op11_collocations"])
    assert ok, text


def test_odd_rows(spark, odd_docs, no_docs):
    assert mined(odd_docs, least=2) == slow_mined([(r["text"], r["lang"]) for r in odd_docs.collect()], 2, 40)
    assert mined(no_docs) == set()
    assert mined(spark.createDataFrame([(None, None), ("", "en"), (" ;\t.", "en")], "text string, lang string")) == set()

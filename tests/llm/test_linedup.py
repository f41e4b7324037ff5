"""The edit join against all pairs, and the verdicts against a plain scan."""
import random
import re

from pyspark.sql import functions as F

from telltale.llm import linedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(draw, text, edits):
    out = list(text)
    for _ in range(edits):
        what, at = draw.randrange(3), draw.randrange(len(out) + 1)
        if what == 0:
            out.insert(at, draw.choice("abé "))
        elif out:
            at = min(at, len(out) - 1)
            if what == 1:
                out.pop(at)
            else:
                out[at] = draw.choice("abé ")
    return "".join(out)


def corpus(draw, docs=40, base=12):
    lines = ["".join(draw.choice("abcdé fghi") for _ in range(draw.randrange(10, 60))) for _ in range(base)]
    return [(i, "\n".join(changed(draw, draw.choice(lines), draw.choice([0, 0, 1, 2, 3])) for _ in range(draw.randrange(1, 5))))
            for i in range(docs)]


def slow_removals(rows, threshold, min_chars, near_chars):
    places = [((doc, i), line) for doc, text in rows for i, line in enumerate((text or "").split("\n")) if len(line) >= min_chars]
    first = {}
    for place, line in places:
        first[line] = min(first.get(line, place), place)
    exact, near = set(), set()
    for place, line in places:
        if place > first[line]:
            exact.add(place)
        elif len(line) >= near_chars and any(
                o != line and len(o) >= near_chars and abs(len(o) - len(line)) <= threshold and p < place
                and distance(o, line) <= threshold for o, p in first.items()):
            near.add(place)
    return exact, near


def test_bit_parallel_distance(spark):
    draw = random.Random(1)
    words = ["".join(draw.choice("abé ") for _ in range(draw.randrange(0, 30))) for _ in range(400)]
    df = spark.createDataFrame([(w, changed(draw, w, draw.randrange(0, 6))) for w in words] + [("", ""), ("a", ""), ("", "abc")], "a string, b string")
    for t in (1, 2, 3):
        assert df.where(linedup.within_edits(F.col("a"), F.col("b"), t) != (F.levenshtein("a", "b") <= t)).count() == 0


def test_removals_equal_brute_force(spark):
    for seed, threshold in ((1, 2), (2, 2), (3, 1), (4, 3)):
        rows = corpus(random.Random(seed))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = linedup.removals(df, threshold, 10, 12).collect()
        exact, near = slow_removals(rows, threshold, 10, 12)
        assert {(r.doc_id, r.pos) for r in got if r.exact} == exact
        assert {(r.doc_id, r.pos) for r in got if r.near} == near and exact


def test_short_lines_by_default_equal_brute_force(spark):
    draw = random.Random(5)
    base = ["".join(draw.choice("abcdé fghi") for _ in range(draw.randrange(16, 40))) for _ in range(15)]
    rows = [(i, "\n".join(changed(draw, draw.choice(base), draw.choice([0, 1, 2, 3])) for _ in range(3))) for i in range(40)]
    rows.append((99, "2024-03-01 Log entry\n2024-03-02 Log entry"))
    got = linedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    exact, near = slow_removals(rows, 2, 16, 16)
    assert {(r.doc_id, r.pos) for r in got if r.exact} == exact
    assert {(r.doc_id, r.pos) for r in got if r.near} == near and (99, 1) in near


def test_links_are_counted_both_ways(spark):
    df = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz 0123456789 abcdefghij"), (2, "abcdefghijklmnopqrstuvwxyz 0123456789 abcdefghiJ"),
                                (3, "abcdefghijklmnopqrstuvwxyz 0123456789 abcdefgXiJ")], "doc_id long, text string")
    got = {r.doc_id: (r.n_exact, r.n_near, r.n_links) for r in linedup.report(df).collect()}
    assert got == {1: (0, 0, 2), 2: (0, 1, 2), 3: (0, 1, 2)}


def test_odd_rows(odd_docs, no_docs):
    out = linedup.dedup(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[2] == "" and texts[1] and texts[3] is None and texts[4] == ""
    assert texts[8] == "" and texts[7].count("\n") == 1
    assert [r.text for r in out.where("doc_id = 9").collect()] == ["word " * 30000] * 2  # ties at the first place stay
    assert linedup.dedup(no_docs).count() == 0 and linedup.report(no_docs).count() == 0
    assert linedup.report(odd_docs).count() == odd_docs.count()


def test_segments_cover_the_line(spark):
    for length in range(4, 30):
        for t in (1, 2, 3):
            row = spark.range(1).select(*[c for s in linedup.segments(F.lit(length), t) for c in s]).first()
            assert row[0] == 1 and all(row[2 * i] + row[2 * i + 1] == row[2 * i + 2] for i in range(t)) and row[-2] + row[-1] - 1 == length
        if length > 6:
            break


def test_letters_are_counted_once_each(spark):
    rows = ["", "e", "eeannntt" * 9, "tantalised hedonist", "Ünïcödé lines: häßlich, nördlich", "line\x00of\u4e2d\u6587 odd"]
    found = linedup._with_letters(spark.createDataFrame([(r,) for r in rows], "line string"), "line").collect()
    assert {r["line"]: r["letters"] for r in found} == {r: sum((r.count(ch) % 32) << (5 * j) for j, ch in enumerate(linedup.COUNTED)) for r in rows}
    assert all(set(r.asDict()) == {"line", "letters"} for r in found)


def test_code_of_the_facts_is_small_enough_to_be_compiled(spark, real_docs, capsys):
    """The JVM leaves methods of more than 8,000 bytes to its interpreter."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        linedup.facts(linedup.lines(real_docs)).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000


def test_keys_are_those_of_the_segments(spark):
    texts = ["abcdefghijklmnop", "abcdefghijklmnopq", "abcdé 漢字 😀 ghijklm", "x" * 40 + "yz" * 13, "twelve chars"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = linedup.lines(df, 10)
    for threshold in (1, 2, 3):
        plain = {}
        for d, i, s in linedup.shifts(threshold):
            start, size = linedup.segments(F.col("size") - d, threshold)[i]
            plain[f"k{d}_{i}_{s}"] = F.xxhash64(F.lit(i), F.col("size") - d, F.substring("line", start + s, size))
        want = found.select("h1", *[k.alias(n) for n, k in plain.items()])
        known = linedup.facts(found, threshold, 14)
        assert sorted(known.select(want.columns).collect()) == sorted(want.collect())
        assert known.where("letters IS NULL").count() == 1

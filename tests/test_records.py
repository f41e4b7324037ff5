"""Nested records against a plain recursive walk of the parsed value."""
import json
import math
import random

import pytest

from telltale.operators import records

WORDS = ["a", "note", "Side II [E1]", "token = abc123456", 'quo"te \\ back', "line\nbreak", "{[,:]}", "", "ü 漢", "sk-" + "a" * 20]
KEYS = ["x", "value", "secret", "OPENAI_API_KEY", "path", "source_id", "k:1", 'q"k', "n\\", "long" * 40]


def made(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice([None, True, False, 0, -3, 2.5, math.nan, math.inf, rng.choice(WORDS)])
    if kind < 0.65:
        return [made(rng, depth - 1) for _ in range(rng.choice([0, 1, 2, 3, 7]))]
    return {k: made(rng, depth - 1) for k in rng.sample(KEYS, rng.choice([0, 1, 2, 4]))}


@pytest.fixture(scope="module")
def clean(spark):
    """The text redaction of every string that the records hold, by the tested column function."""
    from telltale.operators.text import redact_text
    df = spark.createDataFrame([(w,) for w in WORDS + KEYS], "w string")
    return {r["w"]: r["s"] for r in df.select("w", redact_text("w").alias("s")).collect()}


def scalar(v, clean):
    if isinstance(v, str):
        return clean.get(v, v)
    return None if isinstance(v, float) and not math.isfinite(v) else v


def redacted(value, clean, max_depth, max_nodes):
    seen = [0]

    def sensitive(key):
        return key in ("secret", "OPENAI_API_KEY")

    def walk(v, depth):
        seen[0] += 1
        if depth > max_depth:
            return records.DEEP_TEXT
        if isinstance(v, dict):
            out = {}
            for k, child in v.items():
                if seen[0] >= max_nodes:
                    out["_omitted"] = "Remaining fields exceeded the context budget."
                    break
                out[clean.get(k, k)] = "[REDACTED]" if sensitive(k) else walk(child, depth + 1)
            return out
        if isinstance(v, list):
            out = []
            for child in v:
                if seen[0] >= max_nodes:
                    out.append("[Remaining items omitted: context budget exceeded]")
                    break
                out.append(walk(child, depth + 1))
            return out
        return scalar(v, clean)

    return walk(value, 0)


def bounded(v, clean, max_depth, items, fields, depth=0):
    if depth > max_depth:
        return records.NESTED_TEXT
    if isinstance(v, dict):
        shown = list(v.items())[:fields]
        return {k[:100]: bounded(c, clean, max_depth, items, fields, depth + 1) for k, c in shown
                if k not in ("secret", "OPENAI_API_KEY", "path", "source_id")}
    if isinstance(v, list):
        out = [bounded(c, clean, max_depth, items, fields, depth + 1) for c in v[:items]]
        return out + ([{"omitted_items": len(v) - items}] if len(v) > items else [])
    return scalar(v, clean)


def test_records_equal_a_recursive_walk(spark, clean):
    rng = random.Random(5)
    values = [made(rng, 6) for _ in range(120)]
    rows = [(i, json.dumps(v, ensure_ascii=i % 2 == 0, indent=None if i % 3 else 1)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "tok long, record string").repartition(3)
    for depth, nodes in ((16, 12_000), (3, 9)):
        got = {r["tok"]: r["safe"] for r in records.redact_records(df, "record", ["tok"], max_depth=depth, max_nodes=nodes).collect()}
        for i, v in enumerate(values):
            want = redacted(v, clean, depth, nodes)
            assert json.loads(got[i]) == want and list(json.loads(got[i])) == list(want) if isinstance(want, (dict, list)) else json.loads(got[i]) == want, (depth, nodes, i, rows[i], got[i], want)
    for depth, items, fields in ((3, 2, 3),):
        got = {r["tok"]: r["summary"] for r in records.bounded_records(df, "record", ["tok"], max_depth=depth, items=items, fields=fields).collect()}
        for i, v in enumerate(values):
            assert json.loads(got[i]) == bounded(v, clean, depth, items, fields), (depth, items, fields, i, rows[i], got[i])


def test_records_without_a_value_and_repeated_rows(spark):
    rows = [(None, None), (1, ""), (2, "{"), (3, '{"a":1,"a":2}'), (4, "{} {}"), (5, '{"a":1e999}'), (5, '{"a":1e999}'), (6, '"' + "x\\n" * 20_000 + '"')]
    df = spark.createDataFrame(rows, "id long, t string")
    got = sorted(((r["id"] or 0, r["safe"]) for r in records.redact_records(df, "t", ["id"]).collect()), key=lambda r: (r[0], r[1] or ""))
    assert got[:5] == [(0, None), (1, None), (2, None), (3, None), (4, None)]
    assert got[5:7] == [(5, '{"a":null}')] * 2 and len(json.loads(got[7][1])) == 40_000
    assert records.redact_records(df.limit(0), "t", ["id"]).count() == 0
    cut = records.bounded_records(df, "t", ["id"]).where("id = 6").first()["summary"]
    assert json.loads(cut) == ("x\n" * 500) + "… [text truncated]"


def test_a_task_gets_a_bounded_share_of_the_text(spark, monkeypatch):
    from telltale.operators import records
    df = spark.createDataFrame([(i, '{"a": "' + "x" * 100 + '"}') for i in range(90)], "id int, text string").coalesce(1)
    monkeypatch.setattr(records, "TASK_BYTES", 200)
    tokens = records._tokens(df, "text", ["id"])
    assert tokens.rdd.getNumPartitions() == 50 and tokens.count() == 90 * 5

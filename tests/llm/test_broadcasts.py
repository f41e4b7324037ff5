"""What is broadcast at the planner's default limit, counted as it runs: no rows that an explode has multiplied."""
import random

import pytest

from telltale.llm import linedup, nearcopies, simhash

import corpus_pipeline
from telltale.session import materialize


@pytest.fixture
def static(spark):
    """Plans as the planner first makes them, with its default limit of 10 MB."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "10485760"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def broadcasts(df):
    """The number of rows of each broadcast of a plan with an explode."""
    plan = df._jdf.queryExecution().executedPlan()
    if "Generate" not in plan.toString():
        return []
    df.collect()
    found, open_nodes = [], [plan]
    while open_nodes:
        node = open_nodes.pop()
        if node.nodeName().startswith("BroadcastExchange"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        open_nodes += [children.apply(i) for i in range(children.size())]
    return found


def texts(draw, n):
    """Distinct texts of which every third is a near copy of the one before."""
    out = []
    for i in range(n):
        words = out[-1].split() if i % 3 == 2 else [f"w{draw.randrange(3000)}" for _ in range(80)]
        words[draw.randrange(len(words))] = f"n{i}"
        out.append(" ".join(words))
    return list(enumerate(out))


def test_visits_of_fingerprints_are_not_broadcast(static):
    draw = random.Random(1)
    fps = materialize(static.createDataFrame([(draw.getrandbits(63),) for _ in range(300)], "fp long"))
    assert broadcasts(simhash.links(fps)) == []


def test_op2_broadcasts_no_more_rows_than_documents(static, monkeypatch):
    sent, plain = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df: sent.extend(broadcasts(df)) or plain(df))
    df = static.createDataFrame(texts(random.Random(2), 150), "doc_id long, text string")
    sent += broadcasts(simhash.groups(df))
    assert all(n <= 150 for n in sent)  # the visits are 32 a fingerprint


def test_near_copies_broadcast_no_more_rows_than_shared_keys(static, monkeypatch):
    sent = []
    for module in (simhash, nearcopies):
        plain = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, plain=plain: sent.extend(broadcasts(df)) or plain(df))
    monkeypatch.setattr(nearcopies, "BROADCAST_KEYS", 100, raising=False)
    df = static.createDataFrame(texts(random.Random(3), 90), "doc_id long, text string")
    kept = corpus_pipeline.copies_stage(static, df, "")
    assert kept.count() == 60
    assert sent and max(sent) <= 15 * 90  # two texts for each shared key at least; the visits are 32 a text


def test_probes_of_lines_are_not_broadcast(static):
    draw = random.Random(4)
    rows = [(i, "\n".join("".join(draw.choice("abcdefgh ") for _ in range(30)) for _ in range(4))) for i in range(50)]
    known = materialize(linedup.facts(linedup.lines(static.createDataFrame(rows, "doc_id long, text string"))))
    assert broadcasts(linedup.candidates(known)) == []

"""Worked examples and laws of the operators."""
import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from telltale.functions import ordered
from telltale.operators import (catalog, clean, cycles, dedupe, forest, geo, learn, metrics, orders, peers, reference,
                                reports, segments, status, text, trace, validate, waveform)

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def intervals(spark, rows):
    return spark.createDataFrame(
        [("s", i, at(a), at(b), label) for i, (a, b, label) in enumerate(rows)],
        "stream_id string, id long, start timestamp, end timestamp, label string")


@pytest.mark.parametrize("truth, found, expected", [
    ([(0, 10, "Normal")], [(0, 10, "Normal")], 1.0),
    ([(0, 10, "Normal")], [(0, 5, "Normal")], 0.5),
    ([(0, 10, "Normal")], [(0, 10, "Abnormal resistance")], 0.0),
    ([(0, 10, "Normal"), (20, 30, "Normal")], [(0, 10, "Normal")], 2 / 3),
])
def test_iou_weighted_f1_examples(spark, truth, found, expected):
    row = segments.iou_weighted_f1(intervals(spark, truth), intervals(spark, found)).first()
    assert row["f1"] == pytest.approx(expected)


def test_greedy_matching_and_overlaps_equal_brute_force(spark):
    rng = random.Random(3)
    def draw(n):
        out = []
        for _ in range(n):
            a = rng.randrange(0, 4000)
            out.append((a, a + rng.choice([1, 3, 50, 700, 2500]), rng.choice(["Normal", "Abnormal resistance"])))
        return out
    t, p = draw(25), draw(30)
    pairs = {}
    for i, (a, b, l) in enumerate(t):
        for j, (c, d, m) in enumerate(p):
            o = min(b, d) - max(a, c)
            if l == m and o > 0:
                pairs[i, j] = o / ((b - a) + (d - c) - o)
    found = segments.interval_overlaps(intervals(spark, t), intervals(spark, p))
    got = {(r["t_id"], r["p_id"]): r["iou"] for r in found.collect()}
    assert got.keys() == pairs.keys() and found.count() == len(pairs)
    assert all(got[k] == pytest.approx(v) for k, v in pairs.items())
    want, ut, up = set(), set(), set()
    for (i, j), _ in sorted(pairs.items(), key=lambda x: (-round(x[1], 12), x[0])):
        if i not in ut and j not in up:
            want.add((i, j)); ut.add(i); up.add(j)
    assert {(r["t_id"], r["p_id"]) for r in segments.greedy_matches(found).collect()} == want


def test_gap_is_strict_and_native_time_uses_whole_milliseconds(spark):
    rows = [("s", at(t), i, 1.0) for i, t in enumerate((0, 1, 2, 12, 22.5, 23))]
    df = spark.createDataFrame(rows, "stream_id string, ts timestamp, ord long, v double")
    got = segments.segment_stream(df, 10.0).orderBy("ord").collect()
    assert [r["segment"] for r in got] == [0, 0, 0, 0, 1, 1]
    texts = spark.createDataFrame([("2025-1-2-3-4-5-20",), ("2025-1-2-3-4-5-1000",), ("2025-01-02 03:04:05",), ("2025-01-02T03:04:05Z",)], "t string")
    out = texts.select(clean.parse_native_time("t").alias("t"), clean.format_native_time(clean.parse_native_time("t")).alias("b")).collect()
    assert out[0]["t"] == dt.datetime(2025, 1, 2, 3, 4, 5, 20_000) and out[0]["b"] == "2025-1-2-3-4-5-20"
    assert out[1]["t"] is None and out[2]["t"] == dt.datetime(2025, 1, 2, 3, 4, 5) and out[3]["t"] is None


def test_action_features_skip_missing_readings(spark):
    rows = [("s", at(i), i, v, None) for i, v in enumerate((1.0, None, 4.0, 2.0))]
    df = spark.createDataFrame(rows, "stream_id string, ts timestamp, ord long, current double, voltage double")
    cut = segments.segment_stream(df, 10.0)
    got = segments.action_features(cut, ["current", "voltage"]).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["mean"], r["change"], r["variation"], r["q50"]) == pytest.approx((7 / 3, 1.0, 2.5, 2.0))


def brute_cycles(values):
    points = [values[0]]
    for i in range(1, len(values)):
        if values[i] != points[-1]:
            if len(points) >= 2 and (points[-1] - points[-2]) * (values[i] - points[-1]) > 0:
                points[-1] = values[i]
            else:
                points.append(values[i])
    out, stack = [], []
    for p in points:
        stack.append(p)
        while len(stack) >= 3:
            x, y = abs(stack[-1] - stack[-2]), abs(stack[-2] - stack[-3])
            if x < y:
                break
            mean = (stack[-2] + stack[-3]) / 2
            if len(stack) == 3:
                out.append((y, mean, 0.5)); stack.pop(0)
            else:
                out.append((y, mean, 1.0)); del stack[-3:-1]
    out += [(abs(b - a), (a + b) / 2, 0.5) for a, b in zip(stack, stack[1:])]
    return sorted((round(a, 9), round(b, 9), c) for a, b, c in out if a > 0)


@pytest.mark.parametrize("chunk", [10, 500_000])
def test_rainflow_in_chunks_equals_one_pass(spark, chunk):
    rng = random.Random(11)
    series = {1: [float(rng.randrange(-9, 9)) for _ in range(400)], 2: [rng.gauss(0, 5) for _ in range(150)],
              3: [0.0, 4.0], 4: [2.0] * 5, 5: [-2.0, 1.0, -3.0, 5.0, -1.0, 3.0, -4.0, 4.0, -2.0]}
    rows = [(k, at(i * 3600), i, v) for k, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "file_id long, ts timestamp, ord long, value double")
    got = {}
    for r in cycles.rainflow_cycles(df, chunk_points=chunk).collect():
        got.setdefault(r["file_id"], []).append((round(r["range"], 9), round(r["mean"], 9), r["count"]))
    for k, vs in series.items():
        assert sorted(got.get(k, [])) == brute_cycles(vs)


def test_doubling_a_stress_series_shifts_the_moments(spark):
    rng = random.Random(2)
    base = [rng.gauss(0, 3) for _ in range(200)]
    rows = [(k, at(i), i, v * k) for k in (1, 2) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "file_id long, ts timestamp, ord long, value double")
    f = {r["file_id"]: r for r in cycles.stress_features(df).collect()}
    for p in cycles.MOMENT_POWERS:
        name = f"log_rainflow_amplitude_moment_{p}"
        assert f[2][name] - f[1][name] == pytest.approx(p * math.log(2))
    assert f[1]["cycles"] == f[2]["cycles"]


def brute_groups(records):
    names = [r[0] for r in records]
    parent = {n: n for n in names}
    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n
    def rel(a, b):
        a, b = np.array(a), np.array(b)
        return np.linalg.norm(a - b) / max(np.linalg.norm(a), np.linalg.norm(b), 1e-12)
    for i, a in enumerate(records):
        for b in records[:i]:
            near = a[1] == b[1] and rel(a[2], b[2]) <= 1e-3 and rel(a[3], b[3]) <= 1e-3
            if near or a[4] == b[4]:
                x, y = sorted((find(a[0]), find(b[0])))
                parent[y] = x
    return {n: find(n) for n in names}


def test_duplicate_groups_equal_brute_force_with_a_crowd(spark):
    """A third of the recordings crowd around one waveform, with bridges between half-tolerance cores."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    records = []
    def add(v, n=16):
        v = np.asarray(v, dtype=float)
        i = len(records)
        records.append((f"f{i:03d}", n, [float(x) for x in v], [float(v.mean()), float(np.sqrt((v**2).mean()))],
                        str(hash(tuple(np.round(v, 15)))) + str(n)))
    axis = rng.normal(size=16); axis -= axis.mean(); axis /= np.linalg.norm(axis)
    size = np.linalg.norm(base)
    for step in rng.uniform(0, 4, 30):
        add(base + axis * size * 1e-3 * step)
    for step in (6.2, 7.1, 9.5):
        add(base + axis * size * 1e-3 * step)
    for _ in range(40):
        add(rng.normal(size=16))
    add(base); add(base); add(base, 17); add(np.zeros(16)); add(np.zeros(16))
    df = spark.createDataFrame(records, "filename string, n_samples long, sketch array<double>, signature array<double>, numeric_sha256 string")
    got = {r["filename"]: r["group"] for r in dedupe.duplicate_groups(df).collect()}
    assert got == brute_groups(records)


def test_components_follow_long_chains(spark):
    n = 60
    nodes = spark.range(n).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("filename"))
    links = spark.range(n - 1).select(F.lpad((F.col("id") + 1).cast("string"), 3, "0").alias("filename"), F.lpad(F.col("id").cast("string"), 3, "0").alias("root"))
    assert {r["label"] for r in dedupe.connected_components(nodes, links).collect()} == {"000"}


def telemetry(spark, n=200, shift=0.0, gap=None):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        v = 20 + rng.gauss(0, 0.4) + (shift if i >= n * 0.7 else 0)
        rows.append((i, at(300 * i), "T1", "general", None if gap and i >= n - gap else v, 1.0))
    return spark.createDataFrame(rows, "ord long, ts timestamp, train_id string, component string, s1 double, s2 double")


def scored(df):
    rows, stats = reference.fit_robust(df, ["s1", "s2"])
    return reference.score_robust(rows, stats, ["s1", "s2"])


def test_shift_is_critical_and_missing_readings_are_unknown(spark):
    assert status.component_status(scored(telemetry(spark))).first()["status"] == "healthy"
    hit = status.component_status(scored(telemetry(spark, shift=9.0))).first()
    assert hit["status"] == "critical" and hit["risk"] >= 75 and hit["onset"] <= at(300 * 140)
    blind = telemetry(spark, gap=30).withColumn("s2", F.when(F.col("s1").isNotNull(), F.col("s2")))
    lost = status.component_status(scored(blind)).first()
    assert lost["status"] == "unknown" and lost["risk"] is None


def test_monitoring_values_never_reach_the_reference(spark):
    a = reference.fit_robust(telemetry(spark), ["s1", "s2"])[1].orderBy("sensor").collect()
    b = reference.fit_robust(telemetry(spark, shift=50.0), ["s1", "s2"])[1].orderBy("sensor").collect()
    assert len(a) == len(b)
    for x, y in zip(a, b):  # partial sums may be added in another order
        assert all(math.isclose(v, w, rel_tol=1e-9) if isinstance(v, float) and isinstance(w, float) else v == w for v, w in zip(x, y))
    assert [r["scale"] for r in a if r["sensor"] == "s2"] == [0.01]


def test_stale_group_is_unknown(spark):
    rows = [(i, at(300 * i), "A", "general", 20.0 + i % 3, 1.0) for i in range(100)]
    rows += [(1000 + i, at(300 * i), "B", "general", 20.0 + i % 3, 1.0) for i in range(60)]
    rows += [(2000 + i, at(4000 * i), "C", "general", 20.0 + i % 3, 1.0) for i in range(7)]
    df = spark.createDataFrame(rows, "ord long, ts timestamp, train_id string, component string, s1 double, s2 double")
    assert [r["train_id"] for r in status.stale_groups(df).where("stale").collect()] == ["B"]


def test_forest_flags_a_shift(spark):
    df = telemetry(spark, 300, shift=9.0)
    rows, stats = reference.fit_robust(df, ["s1", "s2"])
    trees, offset, inputs = forest.fit_component_forests(rows, stats, ["s1", "s2"], trees=30)
    assert trees.count() == 30
    out = forest.score_forest(reference.score_robust(rows, stats, ["s1", "s2"]), stats, ["s1", "s2"], trees, offset)
    late = out.where(F.col("ord") >= 210).agg(F.avg((F.col("score") > 0).cast("double")).alias("a")).first()["a"]
    early = out.where("is_ref").agg(F.avg((F.col("score") > 0).cast("double")).alias("a")).first()["a"]
    assert late > 0.9 and early <= 0.05


def test_sensitivity_names_the_shifted_sensor(spark):
    df = telemetry(spark, 300, shift=9.0).withColumn("s2", F.sin("ord"))
    rows, stats = reference.fit_robust(df, ["s1", "s2"])
    trees, _, _ = forest.fit_component_forests(rows, stats, ["s1", "s2"], trees=40)
    got = {r["sensor"]: r["contribution"] for r in forest.sensitivity(df.where("ord = 250"), stats, ["s1", "s2"], trees).collect()}
    assert got["s1"] > 80 and sum(got.values()) == pytest.approx(100, abs=0.1)


def test_trace_sample_breaks_only_over_missing_readings(spark):
    ys = [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0]
    df = spark.createDataFrame([("a", float(i), i, at(i), y) for i, y in enumerate(ys)], "k string, x double, ord long, ts timestamp, y double")
    out = trace.sampled_points(df, ["k"], ["ord"], F.lit(0), F.col("x"), F.col("y"), F.lit(False), 4)
    got = [(r["x"], r["y"]) for r in out.orderBy("i", "part").collect()]
    assert got == [(0.0, 1.0), (2.0, None), (4.0, 5.0), (6.0, 7.0)]
    out = trace.sampled_points(df, ["k"], ["ord"], F.lit(0), F.col("x"), F.col("y"), F.lit(False), 3)
    got = [(r["x"], r["y"]) for r in out.orderBy("i", "part").collect()]
    assert got == [(0.0, 1.0), (3.0, None), (3.0, 4.0), (6.0, 7.0)]


def test_peer_gap_prefers_the_same_mode(spark):
    rows = [("c", at(0), f"{i:02d}", 20.0 + i, 20.0, "full cooling" if i <= 3 else "half cooling") for i in range(1, 6)]
    df = spark.createDataFrame(rows, "file_id string, ts timestamp, car string, cabin double, target double, mode string")
    got = {r["car"]: (r["same_mode"], r["gap"]) for r in peers.peer_gap(peers.cooling_mask(df)).collect()}
    assert got["01"] == (True, 1 - 2.5) and got["04"] == (False, 4 - 2.5)


def test_ranking_puts_cars_without_evidence_last(spark):
    df = spark.createDataFrame([("c", "03", None), ("c", "01", None), ("c", "02", 0.2), ("c", "04", 0.9)], "file_id string, car string, score double")
    assert peers.ranked_cars(df).first()["ranked_cars"] == "04|02|01|03"


def test_auc_and_confusion(spark):
    rows = [(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1), (1, 0.4)]
    df = spark.createDataFrame(rows, "y int, s double")
    wins = sum(1.0 if a > b else 0.5 if a == b else 0 for y, a in rows if y for z, b in rows if not z)
    assert metrics.roc_auc(df, "y", "s").first()["auc"] == pytest.approx(wins / 6)
    assert metrics.roc_auc(df.where("y = 1"), "y", "s").first()["auc"] is None
    m = metrics.confusion(spark.createDataFrame([("a", "b")], "t string, p string"), "t", "p", ["a", "b"])
    assert m.count() == 4 and m.agg(F.sum("n")).first()[0] == 1


def test_spectrum_finds_a_tone(spark):
    t = np.arange(10_000) / 10_000
    rows = [("f", [float(v) for v in np.sin(2 * np.pi * 800 * t)])]
    r = waveform.spectrum(spark.createDataFrame(rows, "file_id string, samples array<double>")).first()
    assert abs(r["spectral_centroid_hz"] - 800) < 5 and r["band_600_1200_fraction"] > 0.99


SECRETS = [
    ("api_key = abcd1234", "api_key = [REDACTED]"), ("Authorization: Bearer abcdef123456", None),
    ("https://user:pass@host/x", "https://[REDACTED]@host/x"), ("RMS 3.25 mm/s at token count", "RMS 3.25 mm/s at token count"),
    ("sk-" + "a" * 20, "[REDACTED]"), ("-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----", "[REDACTED]"),
    ("token=[REDACTED]", "token=[REDACTED]"),
]


def test_redaction_hides_credentials_once(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SECRETS)], "i int, t string")
    rows = df.select("i", text.redact_text("t").alias("a"), text.redact_text(text.redact_text("t")).alias("b")).orderBy("i").collect()
    for r, (_, want) in zip(rows, SECRETS):
        assert r["a"] == r["b"] and (want is None or r["a"] == want)
    assert "abcdef123456" not in rows[1]["a"]


def test_unsafe_text_respects_negation(spark):
    texts = ["Please send the api key now", "Never send the api key", "Do not ever share or paste the password.", "All fine"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r["u"] for r in df.orderBy("i").select(text.unsafe_text("t").alias("u")).collect()] == [True, False, False, False]


def test_search_drops_overlaps_and_prefers_headings(spark):
    doc = "\n".join(["# Rainflow cycles", *["rainflow text"] * 9, "# Other", *["rainflow note"] * 60])
    chunks = text.sections(spark.createDataFrame([("guide.md", doc), ("b.md", "nothing here")], "name string, text string"))
    got = text.search(chunks, "rainflow", 8).collect()
    starts = sorted(r["start_line"] for r in got)
    assert got[0]["heading"] == "Rainflow cycles" and all(b - a >= 22 for a, b in zip(starts, starts[1:]))
    assert 1 in starts


def test_wording_rules(spark):
    cases = [("Review the recorded action boundaries and compare the signals.", None), ("Review it.", "word count"),
             ("The recorded action boundaries and the signals are fine here", "not one review sentence"),
             ("Review the recorded action because the motor is broken today", "unsupported claim"),
             ("Review the weather and compare the clouds with each other", "unrelated")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r["p"] for r in df.orderBy("i").select(text.wording_problem("t", "door").alias("p")).collect()] == [c for _, c in cases]


def test_order_state_never_moves_down(spark):
    log = [("o", at(1), 1, "open"), ("o", at(2), 2, "completed"), ("o", at(3), 3, "in_progress"), ("o", at(4), 4, "completed")]
    df = spark.createDataFrame(log, "order_id string, ts timestamp, ord long, status string")
    assert [r["outcome"] for r in orders.order_events(df).orderBy("ord").collect()] == ["unchanged", "applied", "rejected", "unchanged"]
    assert orders.order_state(df).first()["status"] == "completed"


def test_conflicting_fixes_leave_a_train_out(spark):
    rows = [("A", at(0), 1.2, 103.7, "x"), ("A", at(9), 1.3, 103.8, "x"), ("A", at(9), None, None, None),
            ("B", at(9), 1.3, 103.8, "x"), ("B", at(9), 1.31, 103.8, "x"), ("C", at(9), 9.0, 103.8, None)]
    df = spark.createDataFrame(rows, "train_id string, ts timestamp, lat double, lng double, line string")
    got = geo.latest_positions(df).collect()
    assert [(r["train_id"], r["lat"], r["line"]) for r in got] == [("A", 1.3, "x")]


def test_square_centroid(spark):
    df = spark.createDataFrame([("q", i, x, y) for i, (x, y) in enumerate([(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)])], "k string, seq int, x double, y double")
    r = geo.ring_centroids(df, ["k"]).first()
    assert (r["x"], r["y"], r["area"]) == pytest.approx((2.0, 2.0, 4.0))


def test_scope_misses_are_errors(spark):
    p = spark.createDataFrame([("r", "a.csv"), ("r", "b.csv"), ("r", "B.csv")], "run_id string, file_id string")
    pick = lambda n: spark.createDataFrame([("r", n)], "run_id string, file_id string")
    assert catalog.scoped(p, pick("a.csv")).count() == 1
    for name in ("missing.csv", "b.csv"):
        with pytest.raises(ValueError):
            catalog.scoped(p, pick(name))


def test_page_and_query_leave_aggregates_alone(spark):
    rows = [("r", "shm", f"f{i}.csv", 1, 0, None, None, None, None, None, None, float(i) if i else None, "", float(i) if i else None) for i in range(12)]
    cols = ("run_id string, subsystem string, file_id string, prediction_rows long, warnings_count long, total_actions long, normal_actions long, "
            "abnormal_actions long, other_actions long, first_car string, predicted_class string, damage double, result string, sort_value double")
    files = spark.createDataFrame(rows, cols)
    page = [r["file_id"] for r in catalog.comparison_page(files, None, "value-asc", 9, 3).collect()]
    assert page == ["f10.csv", "f11.csv", "f0.csv"]
    assert [r["file_id"] for r in catalog.comparison_page(files, "F1", "filename").collect()] == ["f1.csv", "f10.csv", "f11.csv"]
    agg = catalog.run_aggregates(files).first()
    assert (agg["files"], round(agg["damage_mean"], 9), agg["missing_predictions"]) == (12, 6.0, 1)


def test_logistic_and_pairwise_separate(spark):
    rows = [(float(i), None if i == 7 else float(i % 5), int(i > 30)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    out = learn.frozen_score(df, learn.fit_logistic(df, ["a", "b"], "y"))
    assert out.where((F.col("score") > 0) != (F.col("y") == 1)).count() <= 3
    with pytest.raises(ValueError):
        learn.frozen_score(df.drop("b"), learn.fit_logistic(df, ["a", "b"], "y"))
    cars = spark.createDataFrame([(f, f"{c:02d}", int(c == f + 1), float(c == f + 1) + 0.1 * c) for f in range(4) for c in range(1, 9)],
                                 "file_id int, car string, faulty int, x double")
    ranked = learn.frozen_score(cars, learn.fit_pairwise(cars, ["x"]))
    best = ranked.groupBy("file_id").agg(F.max_by("faulty", "score").alias("hit"))
    assert best.where("hit = 1").count() == 4


def test_moment_surrogate_recovers_the_power(spark):
    rng = random.Random(8)
    rows = [tuple(rng.uniform(1, 9) * p / 2 for p in cycles.MOMENT_POWERS) for _ in range(20)]
    rows = [(*r, math.exp(r[2] + 0.7)) for r in rows]
    names = [f"log_rainflow_amplitude_moment_{p} double" for p in cycles.MOMENT_POWERS]
    df = spark.createDataFrame(rows, ", ".join([*names, "y double"]))
    model = learn.fit_moment_surrogate(df, "y")
    r = model.first()
    assert r["power"] == 4 and r["log_scale"] == pytest.approx(0.7) and r["error"] == pytest.approx(0, abs=1e-9)


def test_nested_selection_never_fits_on_the_held_out_group(spark):
    df = spark.createDataFrame([(g, i, float(i)) for g in "abcd" for i in range(3)], "g string, i int, x double")
    seen = []
    def candidate(sign):
        def fit(training, heldout):
            inside = {r["g"] for r in training.select("g").distinct().collect()}
            held = {r["g"] for r in heldout.select("g").distinct().collect()}
            seen.append((inside, held))
            return heldout.withColumn("prediction", F.col("x") * sign)
        return fit
    score = lambda p, by: p.groupBy(*by).agg((-F.avg(F.abs(F.col("x") - F.col("prediction")))).alias("score"))
    out = learn.nested_selection(df, "g", {"wrong": candidate(-1), "right": candidate(1)}, score)
    assert {r["selected"] for r in out.collect()} == {"right"} and out.count() == 12
    assert all(not inside & held for inside, held in seen)


def test_folds_keep_groups_together_and_preconditions_raise(spark):
    df = spark.createDataFrame([(f"g{i // 2}", "a" if i < 20 else "b", i) for i in range(32)], "g string, y string, i int")
    folds = validate.group_folds(df, "g", 4, "y")
    assert folds.groupBy("g").count().where("count > 1").count() == 0
    assert folds.groupBy("y", "fold").count().count() == 8
    validate.require_training(df, "y", "g", ["a", "b"])
    with pytest.raises(ValueError):
        validate.require_training(df, "y", "g", ["a", "b", "c"])


def test_excluded_names():
    for name in ("Train_ID", "groundTruth", "Fault Code", "speed_kmh", "gpsLatitude", "my label", "injected_anomaly", "is_anomaly_flag", "axleNumber"):
        assert clean.excluded_column(name), name
    for name in ("vibration_mm_s", "custom_pressure", "oil temp"):
        assert not clean.excluded_column(name), name


def test_ramps_start_at_their_fraction(spark):
    out = clean.inject_ramps(telemetry(spark, 100), [dict(train_id="T1", component="general", kind="drift", start_fraction=0.7, offsets={"s2": 10.0})])
    rows = out.orderBy("ord").collect()
    assert [r["injected"] for r in rows].index(1) == 70 and rows[70]["s2"] == pytest.approx(1.5) and rows[99]["s2"] == pytest.approx(11.0)


def test_report_pages_count_what_they_leave_out(spark):
    df = spark.createDataFrame([("f", i) for i in range(9)], "f string, i int")
    assert [r["i"] for r in reports.bounded_page(df, ["f"], ["i"], 4, 6).orderBy("i").collect()] == [6, 7, 8]
    r = reports.page_counts(df, ["f"], 4, 2).first()
    assert (r["total"], r["included"], r["omitted"], r["next_offset"]) == (9, 4, 5, 6)


def test_ridge_equals_its_closed_form(spark):
    import numpy as np
    draw = np.random.default_rng(4)
    x = draw.standard_normal((60, 2)) * [3.0, 0.5] + [1.0, -2.0]
    y = np.exp(0.9 * x[:, 0] - 2 * x[:, 1] + draw.standard_normal(60) * 0.3)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "p double, q double, t double")
    got = {r["feature"]: r["coefficient"] for r in learn.fit_ridge(df, ["p", "q"], "t", alpha=10.0).collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want = np.linalg.solve(z.T @ z + 10 * np.eye(2), z.T @ (np.log(y) - np.log(y).mean()))
    assert math.isclose(got["p"], want[0], rel_tol=1e-9) and math.isclose(got["q"], want[1], rel_tol=1e-9)
    assert math.isclose(got[learn.INTERCEPT], np.log(y).mean(), rel_tol=1e-9)


def test_a_recording_without_scores_has_no_class(spark):
    rows = [("a", "side_i", None), ("a", "side_ii", None), ("b", "side_i", 0.2), ("b", "side_ii", None), ("c", "side_i", -1.0), ("c", "side_ii", 0.4),
            ("d", "side_i", -1.0), ("d", "side_ii", -2.0)]
    got = dict(forest.side_classes(spark.createDataFrame(rows, "file_id string, component string, score double")).collect())
    assert got == {"a": None, "b": "Side I", "c": "Side II", "d": "Normal"}


def test_rows_of_a_scan_are_dealt_out_once(spark):
    df = spark.range(50).selectExpr("IF(id % 5 = 0, NULL, id % 5) AS stream_id", "timestamp_seconds(id * 40000) AS ts", "id AS ord", "id AS v")
    plans = [ordered.scan(df, ["stream_id"], ["ts", "ord"], ordered.time_chunk("ts"), lag={"b": F.col("v")}), segments.segment_stream(df, 90_000)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in plans:
            assert "SortMergeJoin [_part" in out._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = {r["ord"]: r["b"] for r in plans[0].collect()}
    assert len(found) == 50 and all(found[i] == (i - 5 if i >= 5 else None) for i in range(50))


def test_actions_gathered_whole_equal_those_in_chunks(spark, monkeypatch):
    rng = random.Random(4)
    at = dt.datetime(2024, 1, 1)
    rows = [(None if i % 9 == 0 else f"s{i % 4}", at + dt.timedelta(hours=i // 4 + (300 if i > 200 else 0)), i, rng.choice([None, 1.5, rng.gauss(0, 3)]),
             None if i % 4 == 1 else float(i % 11), float(i % 2)) for i in range(400)]
    cut = segments.segment_stream(spark.createDataFrame(rows, "stream_id string, ts timestamp, ord long, a double, b double, on double"), 90_000.0)

    def run():
        long = segments.action_features(cut, ["a", "b"]).collect()
        wide = segments.action_matrix(cut, ["a", "b"], ["on"]).collect()
        return [sorted(tuple(str(round(v, 9) if isinstance(v, float) else v) for v in r) for r in rows) for rows in (long, wide)]

    plain = run()
    assert len(plain[0]) == 14 and len(plain[1]) == 10 and all(r[0] != "None" for r in plain[0])
    for limit in (0, 80):  # all streams through chunks, some
        monkeypatch.setattr(segments, "GATHERED_ROWS", limit)
        assert run() == plain


def test_few_readings_write_no_table_of_distinct_values(spark, monkeypatch):
    rows = [("s", dt.datetime(2024, 1, 1, 0, i), i, float(i)) for i in range(9)]
    cut = segments.segment_stream(spark.createDataFrame(rows, "stream_id string, ts timestamp, ord long, a double"), 90.0)
    monkeypatch.setattr(segments, "grouped_quantiles", None)
    assert [(r["q10"], r["q50"], r["q90"]) for r in segments.action_features(cut, ["a"]).collect()] == [(0.8, 4.0, 7.2)]


def test_rows_in_blocks_go_down_every_tree(monkeypatch):
    monkeypatch.setattr(forest, "BLOCK_ROWS", 7)
    draw = np.random.default_rng(2)
    grown = forest.pd.concat([forest._grow(forest.pd.DataFrame({"component": "a", "tree": t, "x": list(draw.normal(size=(40, 3)))}), 1) for t in range(6)])
    x = np.concatenate([draw.normal(size=(30, 3)), [[np.inf, -np.inf, 0.0]]])

    def depth(r, v):
        node = 0
        while r["feature"][node] >= 0:
            node = r["below"][node] if v[r["feature"][node]] <= r["threshold"][node] else r["above"][node]
        return r["depth"][node]

    want = [2.0 ** (-sum(depth(r, v) for _, r in grown.iterrows()) / 6 / forest.path_norm(40)) for v in x]
    assert np.allclose(forest._raw(*forest._arrays(grown), x), want)


def test_short_series_are_read_in_one_window_and_long_ones_in_chunks(spark):
    from telltale.functions.ordered import DAY, time_chunk
    rows = [(k, i // 2, i, float((i * i * 7 + (k or 0) * 3) % 11 - (i % 4))) for k in (1, 2, None) for i in range(60)]
    df = spark.createDataFrame(rows, "file_id long, day int, ord long, value double").selectExpr(
        "file_id", "timestamp '2024-01-01' + make_dt_interval(day) AS ts", "ord", "value")
    whole = cycles.turning_points(df)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Join") == 0
    chunked = cycles.turning_points(df, time_chunk("ts", 7 * DAY))
    assert sorted(map(str, whole.collect())) == sorted(map(str, chunked.collect()))
    near = [[round(v, 9) if isinstance(v, float) else v for v in r] for r in cycles.stress_features(df).orderBy("file_id").collect()]
    assert near == [[round(v, 9) if isinstance(v, float) else v for v in r]
                    for r in cycles.stress_features(df, time_chunk("ts", 7 * DAY)).orderBy("file_id").collect()]

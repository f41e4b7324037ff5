"""Readers, writers and the streaming forms on small files."""
import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from telltale.sources import files, sinks
from telltale.streaming import live


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_telemetry_keeps_missing_readings_and_counts_problems(spark, tmp_path):
    path = write(tmp_path / "t.csv", "﻿ Timestamp ,train_id,Pressure,fault_code,note\n"
                 "2024-01-01T00:00:00Z,A,1.5,7,x\n2024-01-01 00:05:00,,inf,7,y\n1234,A,2,7,z\n2024-01-01T00:10:00Z,A,abc,7\n")
    rows, facts = files.read_telemetry(spark, path)
    assert facts["sensors"] == ["pressure"]
    assert (facts["rows"], facts["excluded_rows"], facts["short_rows"], facts["zoneless_rows"]) == (4, 1, 1, 1)
    got = rows.orderBy("ts").select("train_id", "component", "pressure").collect()
    assert [tuple(r) for r in got] == [("A", "general", 1.5), ("Unknown train id", "general", None), ("A", "general", None)]


@pytest.mark.parametrize("body", [
    "timestamp,a\n", "time_of_day,a\n1,2\n", "timestamp,A, a\n2024-01-01,1,2\n", "timestamp,a\n2024-01-01,1,2\n",
    "timestamp,fault\n2024-01-01,1\n", "timestamp,a\nyesterday,1\n"])
def test_malformed_telemetry_raises(spark, tmp_path, body):
    with pytest.raises(ValueError):
        files.read_telemetry(spark, write(tmp_path / "bad.csv", body))


DOOR = "Datetime,Motor current(mA),Motor voltage(10mV),Motor electrodynamic force,Door leaf position\n"


def test_door_stream_and_clock_rule(spark, tmp_path):
    good = DOOR + "".join(f"2025-1-1-0-0-0-{20 * i},{i},2,3,4\n" for i in range(5))
    rows = files.read_door_stream(spark, write(tmp_path / "d.csv", good)).orderBy("ts").collect()
    assert len(rows) == 5 and rows[1]["ts"] == dt.datetime(2025, 1, 1, 0, 0, 0, 20_000) and rows[4]["current"] == 4.0
    for body in (DOOR + "2025-1-1-0-0-0-20,1,2,3,4\n2025-1-1-0-0-0-20,1,2,3,4\n", DOOR + "2025-1-1-0-0-0-0,1,2,3,4\n2025-1-1-0-0-1-0,1,2,3\n",
                 DOOR.replace(",Door leaf position", "") + "2025-1-1-0-0-0-0,1,2,3\n2025-1-1-0-0-1-0,1,2,3\n",
                 DOOR + "2025-1-1-0-0-0-0,1e13,2,3,4\n2025-1-1-0-0-1-0,1,2,3,4\n"):
        with pytest.raises(ValueError):
            files.read_door_stream(spark, write(tmp_path / "bad.csv", body))


def test_case_table_has_one_row_per_car(spark, tmp_path):
    cars = [f"{i:02d}" for i in range(1, 9)]
    head = ["Time"] + [f"Car {c} - {p}" for c in cars for p in ("Indoor Average Temperature", "Target Temperature Value", "ACV Running Mode")]
    lines = [",".join(head)]
    for i in range(4):
        lines.append(",".join([f"2025-01-01 00:00:{10 * i:02d}"] + [v for c in cars for v in ("=A1" if c == "03" else "25.5", "24", "Full Cooling")]))
    rows = files.read_case_table(spark, write(tmp_path / "case.csv", "\n".join(lines) + "\n"))
    assert rows.count() == 32 and rows.where("cabin is null").select("car").distinct().collect()[0]["car"] == "03"
    with pytest.raises(ValueError):
        files.read_case_table(spark, write(tmp_path / "seven.csv", "\n".join(",".join(l.split(",")[:-3]) for l in lines) + "\n"))


def rail_csv(order, samples, rng, damaged=False):
    names = ["Rotating speed"] + [f"{k} of bearing in position {p} of car {c}" for c in range(1, 9) for p in range(1, 9) for k in ("Vibration", "Shock")]
    values = rng.normal(size=(samples, 129)).round(4)
    values[:, 0] = rng.integers(0, 2, samples)
    rows = [[str(v) for v in line] for line in values]
    if damaged:
        rows[1][5] = ""
    return "\n".join([",".join(names[i] for i in order)] + [",".join(r[i] for i in order) for r in rows]) + "\n"


def test_waveforms_do_not_depend_on_column_order(spark, tmp_path):
    write(tmp_path / "a" / "x.csv", rail_csv(range(129), 20, np.random.default_rng(1)))
    write(tmp_path / "b" / "x.csv", rail_csv(list(range(129))[::-1], 20, np.random.default_rng(1)))
    key = ["file_id", "car", "position", "kind"]
    a, b = (files.read_waveforms(spark, str(tmp_path / d), 20).orderBy(*key).collect() for d in "ab")
    assert a == b and len(a) == 129 and {r["side"] for r in a} == {None, "side_i", "side_ii"}
    write(tmp_path / "c" / "x.csv", rail_csv(range(129), 20, np.random.default_rng(1), damaged=True))
    with pytest.raises(ValueError, match="missing"):
        files.read_waveforms(spark, str(tmp_path / "c"), 20).count()


def test_series_keeps_its_first_line(spark, tmp_path):
    write(tmp_path / "s" / "one.csv", "\n".join(str(float(i)) for i in range(130)) + "\n")
    rows = files.read_series(spark, str(tmp_path / "s")).orderBy("idx").collect()
    assert len(rows) == 130 and rows[0]["value"] == 0.0
    write(tmp_path / "t" / "two.csv", "\n".join(["head"] + ["1"] * 130) + "\n")
    with pytest.raises(ValueError):
        files.read_series(spark, str(tmp_path / "t"))


def test_files_cut_into_byte_ranges_keep_their_order(spark, tmp_path):
    rng = np.random.default_rng(3)
    values = {f"{n}.csv": rng.normal(size=n) for n in (128, 1_000, 7_777)}
    for name, v in values.items():
        write(tmp_path / "s" / name, ("\ufeff" if name == "128.csv" else "") + "\r\n".join(map(repr, v.tolist())) + ("\n" if name != "1000.csv" else ""))
    write(tmp_path / "w" / "x.csv", rail_csv(range(129), 50, rng))
    write(tmp_path / "w" / "y.csv", rail_csv(list(range(129))[::-1], 50, rng))
    whole = {(r["file_id"], r["car"], r["position"], r["kind"]): r for r in files.read_waveforms(spark, str(tmp_path / "w"), 50).collect()}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        lines = files.numbered_lines(spark, str(tmp_path / "s"))
        assert spark.read.text(str(tmp_path / "s")).rdd.getNumPartitions() > 20
        assert lines.groupBy("file_path", "idx").count().where("count > 1").count() == 0
        got = files.read_series(spark, str(tmp_path / "s")).orderBy("file_id", "idx").collect()
        for name, v in values.items():
            assert [r["value"] for r in got if r["file_id"] == name] == v.tolist()
        rows = files.read_waveform_rows(spark, str(tmp_path / "w"), 50)
        arrays = rows.groupBy("file_id", "car", "position", "kind", "side").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("s")).collect()
        assert len(arrays) == len(whole) == 258
        for r in arrays:
            twin = whole[r["file_id"], r["car"], r["position"], r["kind"]]
            assert [p["value"] for p in r["s"]] == twin["samples"] and r["side"] == twin["side"] and [p["idx"] for p in r["s"]] == list(range(50))
        write(tmp_path / "d" / "x.csv", rail_csv(range(129), 20, rng, damaged=True))
        for samples, message in ((20, "missing"), (21, "number of samples")):
            with pytest.raises(ValueError, match=message):
                files.read_waveform_rows(spark, str(tmp_path / "d"), samples)
        with pytest.raises(ValueError, match="longer"):
            files.numbered_lines(spark, str(tmp_path / "w"), line_bytes=100)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_labels_are_exact(spark, tmp_path):
    assert files.read_labels(spark, write(tmp_path / "l.csv", "filename,label\na.csv,Normal\nb.csv,Side I\n"), "label").count() == 2
    for body in ("filename,label\na.csv,Normal\na.csv,Normal\n", "filename,label\n../a.csv,Normal\n", "filename,label\na.csv,Odd\n", "filename,tag\na,b\n"):
        with pytest.raises(ValueError):
            files.read_labels(spark, write(tmp_path / "bad.csv", body), "label")


def test_damaged_run_records_do_not_hide_the_others(spark, tmp_path):
    base = dict(subsystem="rail", status="completed", source="uploaded", created_at="2025-01-01T00:00:00Z", progress={"completed": 1, "total": 1},
                reports=[{"file_id": "a.csv", "prediction_rows": [{"file_id": "a.csv", "prediction": "Normal"}]}])
    for i, change in enumerate(({}, {"created_at": "2025-01-01T00:00:00"}, {"reports": []}, {"subsystem": "other"}, {"created_at": "2025-01-02T00:00:00+08:00"})):
        write(tmp_path / f"{i}.json", json.dumps({**base, "id": f"{i:032x}", **change}))
    write(tmp_path / "x.json", "{broken")
    got = files.read_run_catalog(spark, str(tmp_path)).collect()
    assert sorted(r["run_id"][-1] for r in got) == ["0", "4"] and {r["first_file"] for r in got} == {"a.csv"}


def test_network_documents_and_listing(spark, tmp_path):
    net = {"stations": [{"id": "S1", "lat": 1.3, "lng": 103.8, "lines": ["L"]}], "lines": [{"id": "L", "name": "Line", "path": [[1.3, 103.8], [1.4, 103.9]]}]}
    stations, vertices = files.read_network(spark, write(tmp_path / "n" / "net.json", json.dumps(net)))
    assert stations.first()["id"] == "S1" and [r["lat"] for r in vertices.orderBy("seq").collect()] == [1.3, 1.4]
    for name in ("d10.md", "d2.md"):
        write(tmp_path / "docs" / name, "text " * (100 if name == "d2.md" else 1))
    docs, left = files.read_reference_documents(spark, str(tmp_path / "docs"), 100)
    assert docs.count() == 1 and left == 1
    assert [r["file_id"] for r in files.list_recordings(spark, str(tmp_path / "docs"), ".md").collect()] == ["d2.md", "d10.md"]


@pytest.fixture
def saved(spark):
    rows = [("r1", "rail", "a.csv", 0, None, None, "Normal", None, None), ("r1", "rail", "b.csv", 0, None, None, "Side I", None, None),
            ("r2", "shm", "s.csv", 0, None, None, None, None, 0.5), ("r3", "shm", "bad.csv", 0, None, None, None, None, float("nan"))]
    p = spark.createDataFrame(rows, "run_id string, subsystem string, file_id string, row_no long, start timestamp, end timestamp, prediction string, ranked_cars string, damage double")
    return p, p.select("run_id", "subsystem").distinct().withColumn("status", F.lit("completed"))


def test_export_writes_exactly_the_selection(spark, saved, tmp_path):
    p, runs = saved
    pick = spark.createDataFrame([("r1", "b.csv"), ("r2", "s.csv")], "run_id string, file_id string")
    assert sinks.export_selection(runs, p, pick, str(tmp_path / "out")) == ["rail", "shm"]
    rail = spark.read.csv(str(tmp_path / "out" / "rail_predictions"), header=True)
    assert rail.columns == ["file_id", "prediction"] and [tuple(r) for r in rail.collect()] == [("b.csv", "Side I")]
    with pytest.raises(ValueError):
        sinks.export_selection(runs, p, spark.createDataFrame([("r3", "bad.csv")], "run_id string, file_id string"), str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()


def test_report_tables_null_what_is_not_finite(spark, saved, tmp_path):
    sinks.write_report_tables({"predictions": saved[0]}, str(tmp_path / "rep"))
    back = spark.read.parquet(str(tmp_path / "rep" / "predictions"))
    assert back.count() == 4 and back.where("isnan(damage)").count() == 0 and back.where("file_id = 'bad.csv'").first()["damage"] is None


def test_feature_table_takes_each_content_once(spark, tmp_path):
    path = str(tmp_path / "features")
    schema = "file_id string, sha256 string, side string, rms double"
    def batch(names, version=1):
        return spark.createDataFrame([(n, f"{n}-{version}", side, float(version)) for n in names for side in ("a", "b")], schema)
    names = [f"f{i}" for i in range(20)]
    assert sinks.cached_features(batch(names), path)[0] is None
    assert sinks.append_features(batch(names), path, buckets=4) == 20
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "features").rglob("part-*")}
    assert sinks.append_features(batch(names), path, buckets=4) == 0
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "features").rglob("part-*")}
    assert sinks.append_features(batch(["f3"], 2).unionByName(batch(["f4", "new"])), path, buckets=4) == 2
    rows = spark.read.parquet(path).orderBy("file_id", "side").collect()
    assert len(rows) == 42 and {r["sha256"] for r in rows if r["file_id"] == "f3"} == {"f3-2"}
    untouched = {p.parent.name for p in before} - {p.parent.name for p in (tmp_path / "features").rglob("part-*") if p not in before}
    assert untouched  # partitions without a new file keep their files
    known, missing = sinks.cached_features(batch(["f3", "f5"]), path)
    assert {r["file_id"] for r in known.collect()} == {"f5"} and {r["file_id"] for r in missing.collect()} == {"f3"}
    assert sinks.append_features(batch([]), path, buckets=4) == 0
    with pytest.raises(ValueError):
        sinks.append_features(batch(["f9"]).unionByName(batch(["f9"], 2)), path, buckets=4)


def test_stream_in_batches_equals_one_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i % 3, start + dt.timedelta(minutes=7 * i + (120 if i > 40 else 0))) for i in range(80)] + [(9, start + dt.timedelta(days=3))]
    for part in range(4):
        spark.createDataFrame(rows[part * 20:(part + 1) * 20 + (1 if part == 3 else 0)], "stream_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"p{part}"))
    for part in range(4):
        source = next((tmp_path / f"p{part}").glob("part-*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{part}.parquet").write_bytes(source.read_bytes())
    def run(per):
        e = live.read_events(spark, str(tmp_path / "in"), "*.parquet", per)
        out = live.run_available(live.live_segments(e, 3600))
        return sorted((r["stream_id"], r["start"], r["n_rows"]) for r in out.collect())
    assert run(1) == run(None) and len(run(None)) == 6

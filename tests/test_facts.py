"""Worked examples of measured facts: what counts as a measurement, and the sentence of each task."""
from telltale.operators import catalog

FILES = [("r", "d1", "door", None, None), ("r", "d2", "door", None, None), ("r", "d3", "door", None, None), ("r", "a1", "acv", "03", None),
         ("r", "a2", "acv", "03", None), ("r", "r1", "rail", None, "Normal"), ("r", "r2", "rail", None, "Side II"), ("r", "s1", "shm", None, None),
         ("r", "none", "shm", None, None)]
EVIDENCE = [
    # The first flagged action has two currents, which count as none; action 5 is not flagged.
    ("r", "d1", "door-action-2-current", 900.0, "mA"), ("r", "d1", "door-action-2-current", 800.0, "mA"),
    ("r", "d1", "door-action-7-current", 1234567.0, "mA"), ("r", "d1", "door-action-7-duration", 2.5, "seconds"),
    ("r", "d1", "door-action-5-current", 1.0, "mA"), ("r", "d1", "door-cadence", 0.5, "seconds"),
    # A wrong unit and a negative value are no measurements.
    ("r", "d2", "door-action-1-current", 5.0, "A"), ("r", "d2", "door-action-3-current", -5.0, "mA"), ("r", "d2", "door-cadence", 0.25, "seconds"),
    ("r", "d3", "door-cadence", 0.0, "seconds"),
    ("r", "a1", "acv-car-03", -1.5, "raw temperature units"), ("r", "a1", "acv-car-04", 9.0, "raw temperature units"),
    ("r", "a2", "acv-car-03", 1.5, "raw temperature units"), ("r", "a2", "acv-coverage", 0.0, "cars"),
    ("r", "r1", "rail-side-1-vibration", 0.00001, "m/s²"), ("r", "r1", "rail-side-2-vibration", float("nan"), "m/s²"),
    ("r", "r2", "rail-side-1-vibration", 1.0, "m/s²"), ("r", "r2", "rail-side-2-vibration", 2.0, "m/s²"),
    ("r", "s1", "shm-cycles", 12.5, "cycles including half cycles"), ("r", "none", "unknown-id", 1.0, "mA"), ("r", "none", None, 1.0, None)]


def test_measured_facts(spark):
    files = spark.createDataFrame(FILES, "run_id string, file_id string, subsystem string, first_car string, predicted_class string")
    evidence = spark.createDataFrame(EVIDENCE, "run_id string, file_id string, id string, value double, unit string")
    flagged = spark.createDataFrame([("r", "d1", 2), ("r", "d1", 7), ("r", "d2", 1), ("r", "d2", 3)], "run_id string, file_id string, action long")
    rows = {r["file_id"]: r for r in catalog.measured_facts(files, evidence, flagged).collect()}
    assert {k: r["text"] for k, r in rows.items()} == {
        "d1": "Flagged movement 7: peak motor current about 1.23457e+06 mA over about 2.5 s.",
        "d2": "Median sampling interval: about 0.25 s.",
        "a1": "Median cabin temperature minus target: about -1.5 raw temperature units.",
        "r1": "Typical vibration (median RMS): Side I about 1e-05 m/s².",
        "r2": "Typical vibration (median RMS): Side II about 2 m/s².",
        "s1": "rainflow count: about 12.5 cycles."}
    assert rows["r2"]["side_1_rms"] == 1.0 and rows["d1"]["flagged_action"] == 7 and rows["d1"]["sample_interval_s"] is None
    assert catalog.measured_facts(files.limit(0), evidence, flagged).count() == 0
    assert catalog.measured_facts(files, evidence.limit(0), flagged).count() == 0

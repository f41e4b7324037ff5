"""Registered queries against their SQL twins on the smallest tables."""
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle import DATA, compare, duck

SF = f"{DATA}/sf0.001"
PLAIN = ["attention_queue", "fleet_totals", "stale_components", "masked_gaps", "stream_segments", "annotation_check",
         "interval_overlaps", "trace_sample", "nearest_reading", "car_features", "channel_spectrum", "side_contrast",
         "class_report", "group_folds", "lexical_search", "redacted_documents", "order_events", "nearest_stations",
         "run_aggregates", "export_problems", "live_stream_segments", "segment_digests", "repeated_segments", "case_digests",
         "telemetry_order"]
CHUNKED = ["reference_statistics", "stream_cadence", "action_statistics", "trace_buckets", "car_features", "turning_points"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", PLAIN + [n for n in CHUNKED if n not in PLAIN])
def test_query_equals_sql(spark, con, name):
    text, ok = compare(spark, con, SF, queries()[name], oracle_sql()[name])
    assert ok, text


def test_entry_has_a_stable_schema(spark):
    assert entry(spark).columns[:4] == ["train_id", "component", "status", "risk"]


def test_every_query_has_a_builder():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 100

"""Bursts are counted over the 300 s before a trigger, not by bins."""

from datetime import datetime, timedelta

from fusewright import catalogue


def test_burst_across_a_bin_edge(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    # Bins end at 300 and 600: seconds across an edge, then three types within 301 s only.
    rows = [(1, at(298), 1, "click", 1.0), (2, at(299), 1, "error", 1.0), (3, at(301), 1, "view", 1.0), (4, at(5000), 2, "click", 1.0), (5, at(5150), 2, "error", 1.0), (6, at(5301), 2, "view", 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = [(r.event_id, r.region, r.clicks, r.errors, r.views) for r in catalogue.queries()["country_burst_triggers"](spark, str(tmp_path)).collect()]
    assert got == [(3, "r1", 1, 1, 1)]
    assert catalogue.queries()["country_burst_counts"](spark, str(tmp_path)).count() == 0

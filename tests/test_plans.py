"""Plans: bounds on time reach the scan, range joins go by cells, and no key's window takes a whole source."""

import pytest

from fusewright import catalogue

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["anomaly_zscore", "replay_scan", "position_trail", "events_filtered", "timeseries_tier", "digest", "fallback_grouping", "source_health_24h"])
def test_time_bounds_are_pushed_down(spark, name):
    assert "GreaterThanOrEqual(ts," in plan(catalogue.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["near_pairs_bbox", "near_pairs_haversine", "conflict_thermal_like", "evidence_near"])
def test_range_joins_are_by_cells(spark, name):
    text = plan(catalogue.queries()[name](spark, SF))
    assert "band" in text and "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("name", ["velocity_5m_30m", "tempo", "decayed_peak_rate"])
def test_windows_are_by_cells(spark, name):
    assert all("cell" in line for line in plan(catalogue.queries()[name](spark, SF)).splitlines() if "Window [" in line)

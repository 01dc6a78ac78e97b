"""Connectors on hand-made raw rows."""

from fusewright.sources.connectors import CANONICAL, CONNECTORS, normalise


def test_every_connector_takes_empty_and_null_rows(spark):
    for name, c in CONNECTORS.items():
        empty = spark.createDataFrame([], c.raw)
        nulls = spark.createDataFrame([tuple(None for _ in empty.columns)], empty.schema)
        assert {*CANONICAL} <= {*normalise(empty, name).columns}
        assert normalise(empty, name).collect() == []
        assert len(normalise(nulls, name).collect()) <= 1, name


def test_firms_keeps_the_first_of_equal_detections(spark):
    rows = [(-12.345, 71.234, 120.0, "h", "N", "2025-08-17", "1408", 1), (-12.345, 71.234, 60.0, "n", "N", "2025-08-17", "1408", 2), (1.0, 1.0, 10.0, "l", None, "2025-08-17", "1408", 3), (1.0, 1.0, 60.0, "n", None, "2025-08-17", "0005", 4)]
    got = sorted(normalise(spark.createDataFrame(rows, CONNECTORS["firms"].raw), "firms").collect(), key=lambda r: r.latitude)
    assert [(r.source_id, str(r.event_time), r.severity, r.confidence, r.tags) for r in got] == [
        ("firms:N:2025-08-17:1408:-123450:712340", "2025-08-17 14:08:00", "high", 0.9, ["fire", "NOAA-20"]),
        ("firms:unknown:2025-08-17:0005:10000:10000", "2025-08-17 00:05:00", "medium", 0.6, ["fire", "unknown"]),
    ]


def test_flights_and_ships(spark):
    rows = [("ae01ce", " rch1 ", "C17", 1.0, 2.0, "ground", None, 0, None), ("7380FF", "XY1", "A320", 1.0, 2.0, "3500", None, 1, False), ("zz", None, None, 1.0, None, "1", None, 1, None)]
    got = sorted(normalise(spark.createDataFrame(rows, CONNECTORS["adsb"].raw), "adsb").collect(), key=lambda r: r.altitude)
    assert [(r.severity, r.altitude, r.affiliation, r.high_value, r.tags) for r in got] == [("medium", 0.0, "US", True, ["military", "high_value", "affiliation:US", "type:C17"]), ("low", 3500.0, "IL", False, ["affiliation:IL", "type:A320"])]
    ship = normalise(spark.createDataFrame([(338004711, "", None, None, 511, 1.0)], CONNECTORS["ais"].raw), "ais").first()
    assert (ship.severity, ship.latitude, ship.heading, ship.entity_name, ship.affiliation, ship.tags) == ("medium", 0.0, None, None, "US", ["military", "naval", "affiliation:US"])

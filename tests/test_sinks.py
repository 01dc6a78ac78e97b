"""Sinks on small tables with null keys, repeated rows and late updates."""

import json
from datetime import datetime

from fusewright.sources import sinks

T = [datetime(2024, 1, d) for d in range(1, 5)]
SCHEMA = "source_type string, source_id string, event_time timestamp, ingested_at timestamp, region_code string, longitude double, latitude double"


def test_first_writer_wins(spark, tmp_path):
    new = [("a", "1", T[0], T[2], "late", 1.0, 2.0), ("a", "1", T[0], T[1], "early", 1.0, 2.0), ("a", None, T[0], T[1], "x", None, 2.0), ("a", None, T[0], T[1], "x", None, 2.0), ("b", "2", T[1], T[1], "y", 0.0, 0.0)]
    e = spark.createDataFrame(new, SCHEMA)
    path = f"{tmp_path}/events"
    sinks.append_events(e, path)
    have = spark.read.parquet(path)
    assert have.count() == 4 and [r.region_code for r in have.where("source_id = '1'").collect()] == ["early"]
    assert sinks.new_events(e, have).count() == 2  # those without an id
    assert sinks.new_events(e.limit(0), have).count() == 0


def test_upsert(spark):
    now = spark.createDataFrame([("k", "name", 1, 1), (None, "none", 1, 1), ("old", "o", 1, 1)], "id string, name string, v int, at int")
    new = spark.createDataFrame([("k", None, 2, 2), ("k", None, 3, 3), (None, "set", 4, 2), ("n", "new", 5, 2)], "id string, name string, v int, at int")
    got = {r.id: (r.name, r.v) for r in sinks.upsert(now, new, ["id"], "at", keep=("name",)).collect()}
    assert got == {"k": ("name", 3), None: ("set", 4), "old": ("o", 1), "n": ("new", 5)}
    assert sinks.upsert(now, new.limit(0), ["id"], "at").count() == 3


def test_geojson(spark):
    e = spark.createDataFrame([("a", "1", T[0], T[0], "r", 1.5, 2.5), ("a", "2", T[0], T[0], "r", None, 2.5)], SCHEMA)
    got = [json.loads(r.value) for r in sinks.geojson(e, ["source_id", "region_code"]).collect()]
    by = {f["properties"]["source_id"]: f for f in got}
    assert by["1"]["geometry"] == {"type": "Point", "coordinates": [1.5, 2.5]} and by["2"]["geometry"] is None

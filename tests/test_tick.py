"""Ticks over a few situations: what goes, merges and changes, and that nothing else does."""

from pyspark.sql import functions as F

from fusewright.operators.worked_situations import NOW, state
from fusewright.situations.tick import tick


def test_ticks(spark):
    rows = {
        "war1": dict(title="Iran Missile Launch", event_count=30, topics=["missile-launch", "war"], regions=["middle-east"], sources=["acled", "usgs", "gdelt"], phase="developing", last_updated=NOW),
        "war2": dict(title="Iran Missile Launch Again", event_count=20, topics=["missile-launch", "war"], regions=["middle-east"], sources=["gdelt"], phase="developing", last_updated=NOW),
        "stale": dict(title="Old Story Told", last_updated=NOW - 7 * 3600),
        "child": dict(title="Iran Depot Hit", parent_id="war2", event_count=4, entities=["iran"], last_updated=NOW),
        "apart": dict(title="Quito Quake Relief", event_count=9, topics=["quake"], last_updated=NOW),
    }
    idf = spark.createDataFrame([], "kind string, term string, idf double")
    odd = {r.sid: r for r in tick(state(spark, rows), idf, NOW, 1).collect()}
    assert {*odd} == {"war1", "war2", "child", "apart"} and odd["war2"].parent_id is None
    even = {r.sid: r for r in tick(state(spark, rows), idf, NOW, 2).collect()}
    assert {*even} == {*odd}
    # The larger takes the smaller and its child; its events are both.
    assert (even["war2"].parent_id, even["child"].parent_id, even["apart"].parent_id) == ("war1", "war1", None)
    assert even["war1"].event_count == 50 and {*even["war1"].sources} == {"acled", "usgs", "gdelt"}
    # Thirty events of three sources about war while it develops: high.
    assert even["war1"].severity_rank == 3 and even["apart"].severity_rank == 1
    fourth = tick(state(spark, rows), idf, NOW, 4)
    # The sweep lets go of the child that shares neither an entity nor enough words with its parent.
    assert fourth.where(F.col("sid") == "war2").first().parent_id == "war1"

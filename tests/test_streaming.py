"""The streaming operators against their batch results."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fusewright.streaming import events as S


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for k, (a, b) in enumerate([(0, 0.3), (0.3, 0.7), (0.7, 1.0)]):  # files in order of time
        n = F.percent_rank().over(W.orderBy("ts", "event_id"))
        part = e.withColumn("r", n).where((F.col("r") >= a) & ((F.col("r") < b) | (F.lit(b) == 1.0))).drop("r")
        part.coalesce(1).write.mode("append").parquet(d)
    return d


def run(df, name, tmp, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp}/{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_rollup(spark, folder, tmp_path):
    got = run(S.rollup(S.read_events(spark, folder), "1 hour", "365 days"), "rolled", tmp_path, "update")
    total = got.groupBy("bucket", "event_type").agg(F.max("n_events").alias("n")).agg(F.sum("n")).first()[0]
    assert total == spark.read.parquet(folder).count()


def test_first_wins(spark, folder, tmp_path):
    doubled = S.read_events(spark, folder).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("source_id", F.when(F.col("event_id") % 10 != 0, F.col("event_id")))
    got = run(S.first_wins(doubled, ["source_id", "event_type"], "365 days"), "firsts", tmp_path)
    n = spark.read.parquet(folder).where("event_id % 10 = 0").count()
    assert got.count() == spark.read.parquet(folder).count() + n


def test_source_health(spark, folder, tmp_path):
    reports = S.read_events(spark, folder, 1).selectExpr("event_type as source_type", "ts", "value < 50 as ok")
    got = {r.source_type: r for r in run(S.source_health(reports), "health", tmp_path, "update").groupBy("source_type").agg(F.max_by("failures", F.greatest("last_success", "last_failure")).alias("failures")).collect()}
    rows = spark.read.parquet(folder).selectExpr("event_type as s", "ts", "value < 50 as ok").orderBy("ts").collect()
    for s, r in got.items():
        n = 0
        for x in rows:
            n = n if x.s != s else 0 if x.ok else n + 1
        assert r.failures == n


def test_refresh_buckets(spark, folder, tmp_path):
    for _ in range(2):  # a second start from the same checkpoint adds nothing
        q = S.read_events(spark, folder, 1).writeStream.foreachBatch(S.refresh_buckets(f"{tmp_path}/out", 3600)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert S.read_buckets(spark, f"{tmp_path}/out").agg(F.sum("n_events")).first()[0] == spark.read.parquet(folder).count()


def files(spark, folder, *parts):
    for rows, ddl in parts:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_are_dropped_and_in_time_rows_kept(spark, tmp_path):
    ddl, d = "event_id long, ts timestamp_ntz, event_type string, value double", str(tmp_path / "in")
    from datetime import datetime as D

    row = lambda i, h, m=0: (i, D(2024, 1, 1, h, m), "a", 1.0)
    q = None
    for part in ([row(1, 10)], [row(2, 12)], [row(3, 11, 30)], [row(4, 10, 30)], [row(5, 15)]):
        # Each file is a start of its own, from the same checkpoint: the stream goes on where it stopped.
        files(spark, d, (part, ddl))
        out = S.rollup(S.read_events(spark, d, 1), "1 hour", "1 hour")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = {r.bucket.hour: r.n_events for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # 11:30 is within the hour after 12:00 and counts; 10:30 is later than that and doesn't. 15:00 is still open.
    assert got == {10: 1, 11: 1, 12: 1}


def test_correlated_streams_equal_the_batch(spark, folder, tmp_path):
    e = S.read_events(spark, folder, 1)
    out = S.correlated(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), "user_id", "2 days", "30 days")
    got = {(r.l_id, r.r_id) for r in run(out, "correlated", tmp_path).collect()}
    b = spark.read.parquet(folder)
    x, y = b.where("event_type = 'error'").alias("x"), b.where("event_type = 'purchase'").alias("y")
    want = x.join(y, F.expr("x.user_id = y.user_id AND y.ts <= x.ts AND y.ts >= x.ts - INTERVAL 2 days")).select("x.event_id", "y.event_id").collect()
    assert got == {tuple(r) for r in want} and got


def test_paced_alerts_equal_the_batch(spark, tmp_path):
    from fusewright.rules.incidents import fatigue

    rows = [(i % 3, i, 137 * i + (i * i) % 50) for i in range(300)]
    ddl, d = "rule_id long, event_id long, t long", str(tmp_path / "in")
    files(spark, d, (rows[:100], ddl), (rows[100:220], ddl), (rows[220:], ddl))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(d)
    got = {tuple(r) for r in run(S.paced_alerts(stream, 10, 4), "paced", tmp_path).collect()}
    assert got == {tuple(r) for r in fatigue(spark.createDataFrame(rows, ddl), 10, 4).collect()} and len(got) > 20


def test_replay_clock_and_resume(spark):
    d = spark.createDataFrame([(1, 1000), (2, 1029), (3, 1030), (4, 1899), (5, 1900)], "event_id long, t long")
    assert [(r.event_id, r.tick_no, r.snapshot_no) for r in S.replay_clock(d).orderBy("event_id").collect()] == [(1, 0, 0), (2, 0, 0), (3, 1, 0), (4, 29, 0), (5, 30, 1)]
    s = spark.createDataFrame([("a", 60, 990), ("b", 60, 900), ("c", 60, None), ("d", 60, 2000)], "source_id string, interval_s long, last_success long")
    assert {r.source_id: r.delay for r in S.resume_delays(s, 1000).collect()} == {"a": 50, "b": 0, "c": 0, "d": 60}

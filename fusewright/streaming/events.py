"""Structured Streaming over the event relation: rollups, duplicates, sources' health. Each has a batch twin in the queries.

State is bounded by the watermark (rollups, duplicates) or by the number of sources (health).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The failures in a row from which a source counts as down.
DOWN_AFTER = 3
_HEALTH = "source_type string, status string, failures long, last_success timestamp, last_failure timestamp"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Events as Parquet files that arrive in a folder; ts as a timestamp, which a watermark needs."""
    schema = spark.read.parquet(folder).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def rollup(events: DataFrame, width: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by bucket and type. A bucket is final once the watermark has passed it; later rows of it are late and dropped."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return by.agg(F.count("*").alias("n_events"), F.sum("value").alias("value")).select(F.col("w.start").alias("bucket"), "event_type", "n_events", "value")


def first_wins(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first of the rows with equal keys that come within the watermark of each other; rows with a null key all pass."""
    marked = events.withWatermark("ts", late)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    one = F.when(known, F.lit("")).otherwise(F.uuid())
    return marked.withColumn("_one", one).dropDuplicatesWithinWatermark([*keys, "_one"]).drop("_one")


def _health(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    failures, success, failure = state.get if state.exists else (0, None, None)
    rows = pd.concat(batches).sort_values("ts", kind="stable")
    for ts, ok in zip(rows["ts"], rows["ok"], strict=True):
        at = int(ts.value // 1000)
        failures, success, failure = (0, at, failure) if ok else (failures + 1, success, at)
    state.update((failures, success, failure))
    when = lambda x: pd.NaT if x is None else pd.Timestamp(x, unit="us")
    status = "healthy" if not failures else "down" if failures >= DOWN_AFTER else "degraded"
    yield pd.DataFrame({"source_type": [key[0]], "status": [status], "failures": [failures], "last_success": [when(success)], "last_failure": [when(failure)]})


def source_health(reports: DataFrame) -> DataFrame:
    """Health of each source after each batch of its reports (source_type, ts, ok): failures since the last success, and when both were."""
    return reports.groupBy("source_type").applyInPandasWithState(_health, _HEALTH, "failures long, success long, failure long", "update", GroupStateTimeout.NoTimeout)


def refresh_buckets(target: str, width_seconds: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes each batch's partial sums under its own folder, so that a batch that runs again replaces itself.

    A reader adds the partial sums up: no bucket is rewritten, however late its rows are.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        bucket = (F.floor(F.unix_timestamp("ts") / width_seconds) * width_seconds).alias("bucket")
        part = batch.groupBy(bucket, "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("value"))
        part.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def read_buckets(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).groupBy("bucket", "event_type").agg(F.sum("n_events").alias("n_events"), F.sum("value").alias("value"))


def correlated(left: DataFrame, right: DataFrame, key: str, before: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(l_id, r_id): rows of two streams (event_id, ts, key) with one key, the right one no later than the left and within `before`.

    Both sides' state goes once the watermark has passed what the range can reach.
    """
    a = left.select(F.col("event_id").alias("l_id"), F.col("ts").alias("l_ts"), F.col(key).alias("l_key")).withWatermark("l_ts", late)
    b = right.select(F.col("event_id").alias("r_id"), F.col("ts").alias("r_ts"), F.col(key).alias("r_key")).withWatermark("r_ts", late)
    return a.join(b, F.expr(f"l_key = r_key AND r_ts <= l_ts AND r_ts >= l_ts - INTERVAL {before}")).select("l_id", "r_id")


def paced_alerts(fired: DataFrame, cooldown_minutes: int = 15, per_hour: int = 10) -> DataFrame:
    """Alerts that go out, of a stream (rule_id, event_id, t): none within whole `cooldown_minutes` of the rule's last, `per_hour` at most.

    A rule's state is three numbers. Rows come by batches; within one they are taken in order of t.
    """

    def pace(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, hour, n = state.get if state.exists else (None, None, 0)
        rows, kept = pd.concat(batches).sort_values(["t", "event_id"]), []
        for i, t in enumerate(rows["t"].tolist()):
            full = hour is not None and t - hour < 3600 and n >= per_hour
            if full or last is not None and (t - last) // 60 < cooldown_minutes:
                continue
            kept.append(i)
            last = t
            hour, n = (t, 1) if hour is None or t - hour >= 3600 else (hour, n + 1)
        state.update((last, hour, n))
        yield rows.iloc[kept][["rule_id", "event_id", "t"]]

    return fired.groupBy("rule_id").applyInPandasWithState(pace, "rule_id long, event_id long, t long", "last long, hour long, n long", "append", GroupStateTimeout.NoTimeout)


def replay_clock(events: DataFrame, tick: int = 30, snapshot: int = 900) -> DataFrame:
    """Events (t in seconds) in the order of a replay: (order_no is by t and event_id), the tick and the snapshot that each comes before.

    The clock is the events' own, from the first: a tick is due once `tick` seconds have passed since the last one,
    so the numbers are the same on every run.
    """
    first = events.agg(F.min("t").alias("first"))
    x = events.crossJoin(F.broadcast(first))
    since = F.col("t") - F.col("first")
    return x.select(*events.columns, F.floor(since / tick).alias("tick_no"), F.floor(since / snapshot).alias("snapshot_no"))


def resume_delays(sources: DataFrame, now: int) -> DataFrame:
    """(source_id, delay): seconds until each source's next poll: what is left of its interval since its last success, at once without one."""
    left = F.col("interval_s") - (F.lit(now) - F.col("last_success"))
    return sources.select("source_id", F.when(F.col("last_success").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(left, F.col("interval_s")))).cast("long").alias("delay"))

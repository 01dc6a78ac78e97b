"""Sinks: partitioned appends where the first writer wins, upserts by key, GeoJSON lines.

Tables are Parquet in shared storage. An upsert writes a new version of the table and returns it;
the caller swaps paths, so that a reader never sees half of a table and a lost job can run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVENT_KEY = ("source_type", "source_id", "event_time")


def first_of(df: DataFrame, keys: tuple[str, ...], order: list[Column]) -> DataFrame:
    """The first row of each key; rows with a null in their key all stay."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    ranked = df.where(whole).withColumn("rank__", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("rank__ = 1").drop("rank__")
    return ranked.unionByName(df.where(~whole))


def new_events(events: DataFrame, existing: DataFrame | None, keys: tuple[str, ...] = EVENT_KEY) -> DataFrame:
    """What an insert adds: the earliest ingested row of each key that isn't there yet. Rows without source_id always count as new."""
    fresh = first_of(events, keys, [F.col("ingested_at")])
    return fresh if existing is None else fresh.join(existing.select(*keys), list(keys), "left_anti").select(*events.columns)


def append_events(events: DataFrame, path: str, existing: DataFrame | None = None) -> None:
    """Appends new events by day, near others of their source and region, so that scans prune files and row groups."""
    dated = new_events(events, existing).withColumn("event_date", F.to_date("event_time"))
    dated.repartition("event_date", "source_type").sortWithinPartitions("event_date", "source_type", "region_code", "event_time").write.mode("append").partitionBy("event_date").parquet(path)


def upsert(current: DataFrame, updates: DataFrame, keys: list[str], order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """current with the last update of each key; columns in keep hold their old value where the new one is null.

    Repeated updates of a key: the one with the greatest `order` stands. Null keys match each other.
    """
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in updates.columns if c not in keys)), order).alias("new__")).withColumns({f"key{i}__": F.col(k) for i, k in enumerate(keys)}).drop(*keys)
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & current[k].eqNullSafe(last[f"key{i}__"])
    both = current.withColumn("old__", F.lit(True)).join(last, on, "full_outer")

    def value(c: str) -> Column:
        if c in keys:
            return F.when(F.col("old__"), F.col(c)).otherwise(F.col(f"key{keys.index(c)}__")).alias(c)
        new = F.col(f"new__.{c}")
        return F.when(F.col("new__").isNull(), F.col(c)).otherwise(F.coalesce(new, F.col(c)) if c in keep else new).alias(c)

    return both.select(*(value(c) for c in current.columns))


def geojson(events: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON Feature a row, as a line; rows without a place have a null geometry."""
    point = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    place = F.when(F.col("longitude").isNotNull() & F.col("latitude").isNotNull(), point).alias("geometry")
    feature = F.struct(F.lit("Feature").alias("type"), place, F.struct(*properties).alias("properties"))
    return events.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))

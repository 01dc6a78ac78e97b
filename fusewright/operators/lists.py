"""Lists as a server gives them: a situation's events, what it missed, reports, alerts, trails, evidence, scores of a run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fusewright.functions import titles as T

c = F.col
#: Event types that are never listed with a situation.
POSITIONS = ("flight_position", "vessel_position", "cert_issued", "shodan_banner", "bgp_anomaly")


def _like_any(text: Column, patterns: list[str]) -> Column:
    """ILIKE any of the patterns, null for null."""
    out = F.lit(False)
    for p in patterns:
        out = out | text.ilike(p)
    return out


def situation_events(events: DataFrame, since: int, until: int, source_ids: list[str], names: list[str], limit: int = 50) -> DataFrame:
    """Events from since to until, both included, that are a situation's by id, entity or a title that has its entity's name; the latest first, 200 at most."""
    own = F.coalesce(c("source_id").isin(source_ids), F.lit(False)) | F.coalesce(c("entity_name").isin(names), F.lit(False))
    own = own | F.coalesce(_like_any(c("title"), [f"%{n}%" for n in names]), F.lit(False))
    rows = events.where(c("t").between(since, until) & ~c("event_type").isin(*POSITIONS) & own)
    return rows.orderBy(c("t").desc(), "event_id").limit(min(limit, 200))


def retro_events(events: DataFrame, since: int, until: int, names: list[str], exclude: list[str], limit: int = 30) -> DataFrame:
    """Events that a situation may have missed: by entity or title, the earliest first, without the ids it has; rows without an id stay."""
    own = F.coalesce(c("entity_name").isin(names), F.lit(False)) | F.coalesce(_like_any(c("title"), [f"%{n}%" for n in names]), F.lit(False))
    rows = events.where(c("t").between(since, until) & ~c("event_type").isin(*POSITIONS) & own & (c("source_id").isNull() | ~c("source_id").isin(exclude)))
    return rows.orderBy("t", "event_id").limit(limit)


def reports(rows: DataFrame, since: int, report_type: str | None = None, situation_id: str | None = None, entity_id: str | None = None, limit: int = 20) -> DataFrame:
    """The latest reports since a time, of one type, else of one situation, else of one entity; 100 at most."""
    for column, value in (("report_type", report_type), ("situation_id", situation_id), ("entity_id", entity_id)):
        if value is not None:
            rows = rows.where(c(column) == value)
            break
    return rows.where(c("t") >= since).orderBy(c("t").desc(), "id").limit(min(limit, 100))


def recent(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(c("t").desc(), c("event_id").desc()).limit(n)


def top_evidence(pairs: DataFrame, events: DataFrame, most: int = 3) -> DataFrame:
    """(trigger_id, evidence): ids of each trigger's evidence of the highest severity, of equals the first to arrive, at most so many."""
    x = pairs.join(events.select("event_id", "severity_rank", "t"), "event_id")
    rank = F.row_number().over(W.partitionBy("trigger_id").orderBy(c("severity_rank").desc(), "t", "event_id"))
    kept = x.withColumn("k", rank).where(c("k") <= most)
    return kept.groupBy("trigger_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "event_id"))), lambda s: s["event_id"]).alias("evidence"))


def with_aircraft(events: DataFrame, aircraft: DataFrame) -> DataFrame:
    """Events with the type and owner of their aircraft, by address without case and blanks; aircraft: (hex, type, owner), of one address the first by type."""
    one = aircraft.select(F.lower(F.trim("hex")).alias("hex_"), c("type").alias("aircraft_type"), c("owner").alias("aircraft_owner"))
    one = one.groupBy("hex_").agg(F.min(F.struct("aircraft_type", "aircraft_owner")).alias("x")).select("hex_", "x.*")
    return events.withColumn("hex_", F.lower(F.trim("entity_id"))).join(one, "hex_", "left").drop("hex_")


def simplified_trails(points: DataFrame, least: float = 0.001, cap: int = 500) -> DataFrame:
    """(entity_id, n, lat, lon): of each trail the first point, each at least so many degrees from the last one kept, and the final one; the latest `cap`.

    points: (entity_id, t, lat, lon). A trail is one entity's and is walked in order, so it is one group; its length is bounded by what is kept of positions.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        kept, last = [], None
        xy = rows[["lat", "lon"]].to_numpy()
        for i, (y, x) in enumerate(xy):
            if last is None or (y - last[0]) ** 2 + (x - last[1]) ** 2 >= least**2 or i + 1 == len(xy):
                kept.append(i)
                last = (y, x)
        out = rows.iloc[kept[-cap:]][["entity_id", "lat", "lon"]].reset_index(drop=True)
        return out.assign(n=range(1, len(out) + 1))[["entity_id", "n", "lat", "lon"]]

    return points.groupBy("entity_id").applyInPandas(walk, "entity_id string, n long, lat double, lon double")


def merged_features(server: DataFrame, live: DataFrame, now: int, seconds: int = 60, cap: int = 1000) -> DataFrame:
    """What a map shows: live rows younger than `seconds` that the server hasn't, the latest first, before the server's; `cap` in all."""
    fresh = live.where(F.lit(now) - c("t") < seconds).join(server.select("id"), "id", "left_anti")
    both = fresh.select(F.lit(0).alias("part"), "id", "t").unionByName(server.select(F.lit(1).alias("part"), "id", "t"))
    return both.orderBy("part", c("t").desc(), "id").limit(cap)


def repaired_hierarchy(rows: DataFrame) -> DataFrame:
    """(id, parent_id, child_ids): links that either side states, of rows (id, parent_id, child_ids); what names itself or is unknown is left out.

    Of several parents the least by name stays.
    """
    known = rows.select(c("id").alias("x"))
    up = rows.where("parent_id is not null").select(c("id").alias("child"), c("parent_id").alias("parent"))
    down = rows.select(c("id").alias("parent"), F.explode("child_ids").alias("child"))
    links = up.unionByName(down).where("child <> parent").join(known.withColumnRenamed("x", "child"), "child").join(known.withColumnRenamed("x", "parent"), "parent")
    one = links.groupBy("child").agg(F.min("parent").alias("parent"))
    kids = one.groupBy(c("parent").alias("id")).agg(F.array_sort(F.collect_list("child")).alias("child_ids"))
    x = rows.select("id").join(one.select(c("child").alias("id"), c("parent").alias("parent_id")), "id", "left").join(kids, "id", "left")
    return x.select("id", "parent_id", F.coalesce("child_ids", F.array().cast("array<string>")).alias("child_ids"))


def needing_titles(situations: DataFrame, now: int) -> DataFrame:
    """(sid, why): situations due for a title: new with three events (children: two), a worthless one, or twenty new signals after half an hour."""
    first = ~c("titled") & (c("event_count") >= F.when(c("parent_id").isNotNull(), 2).otherwise(3))
    again = c("titled") & (c("signal_events") - c("signals_then") >= 20) & (F.floor((F.lit(now) - c("titled_at")) / 60) >= 30)
    why = F.when(first, "first").when(c("titled") & T.is_garbage_title(c("title")), "garbage").when(again, "grown")
    return situations.select("sid", why.alias("why")).where("why is not null")


def score_card(situations: DataFrame, expected: DataFrame, unwanted: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(kind, name, passed, weight): a run's top situations against expected and unwanted titles and limits.

    expected: (pattern, weight, min_rank, min_sources; null for any), judged by the matching situation with most events.
    unwanted: (pattern, weight). limits: max_top_level, min_avg_certainty, min_multi_source_ratio, max_info_ratio.
    Patterns are few, so they are broadcast; the score is the passed weight over all.
    """
    top = situations.where("parent_id is null")
    hit = lambda ps: top.join(F.broadcast(ps), F.expr("title rlike concat('(?i)', pattern)"))
    best = hit(expected).groupBy("pattern").agg(F.min(F.struct((-c("event_count")).alias("minus"), "sid", "severity_rank", "source_count")).alias("b"))
    x = expected.join(best, "pattern", "left")
    enough = (c("b.severity_rank") >= F.coalesce("min_rank", F.lit(0))) & (c("b.source_count") >= F.coalesce("min_sources", F.lit(0)))
    out = x.select(F.lit("expected").alias("kind"), c("pattern").alias("name"), F.coalesce(enough, F.lit(False)).alias("passed"), "weight")
    bad = hit(unwanted).select("pattern").distinct().withColumn("hit", F.lit(True))
    out = out.unionByName(unwanted.join(bad, "pattern", "left").select(F.lit("unwanted").alias("kind"), c("pattern").alias("name"), c("hit").isNull().alias("passed"), "weight"))
    share = lambda when: F.coalesce(F.avg(when.cast("double")), F.lit(0.0))
    found = top.agg(F.count("*").cast("double").alias("max_top_level"), F.coalesce(F.avg("certainty"), F.lit(0.0)).alias("min_avg_certainty"), share(c("source_count") >= 2).alias("min_multi_source_ratio"), share(c("severity_rank") == 0).alias("max_info_ratio"))
    each = [F.struct(F.lit("limit").alias("kind"), F.lit(n).alias("name"), (c(n) <= v if n.startswith("max") else c(n) >= v).alias("passed"), F.lit(1.0).alias("weight")) for n, v in limits.items()]
    return out.unionByName(found.select(F.explode(F.array(*each)).alias("x")).select("x.*")) if each else out


def replay_metrics(snapshots: DataFrame) -> DataFrame:
    """(snapshot_no, situations, top_level, events, avg_certainty, high, multi_source) of (snapshot_no, sid, parent_id, event_count, certainty, severity_rank, source_count)."""
    return snapshots.groupBy("snapshot_no").agg(
        F.count("*").alias("situations"),
        F.count_if(c("parent_id").isNull()).alias("top_level"),
        F.sum("event_count").alias("events"),
        F.avg("certainty").alias("avg_certainty"),
        F.count_if(c("severity_rank") >= 3).alias("high"),
        F.count_if(c("source_count") >= 2).alias("multi_source"),
    )


def compared_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(title, change): titles of two runs' top situations, without case: lost, new or common."""
    of = lambda x, n: x.where("parent_id is null").select(F.lower("title").alias("title")).distinct().withColumn(n, F.lit(True))
    both = of(before, "a").join(of(after, "b"), "title", "full")
    return both.select("title", F.when(c("b").isNull(), "lost").when(c("a").isNull(), "new").otherwise("common").alias("change"))


def score_of(card: DataFrame) -> DataFrame:
    """One row (score, passed, total)."""
    kept = F.sum(F.when(c("passed"), c("weight")).otherwise(0.0))
    return card.agg(F.when(F.coalesce(F.sum("weight"), F.lit(0.0)) > 0, kept / F.sum("weight")).otherwise(1.0).alias("score"), F.count_if("passed").alias("passed"), F.count("*").alias("total"))


def batches_of(rows: DataFrame, most: int = 8) -> DataFrame:
    """Rows as a model gets them: (first_id, ids), at most so many at a time, in order of id within a partition."""

    def gather(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            ids = p["id"].tolist()
            groups = [ids[i : i + most] for i in range(0, len(ids), most)]
            yield pd.DataFrame({"first_id": [g[0] for g in groups], "ids": groups})

    return rows.select("id").sortWithinPartitions("id").mapInPandas(gather, "first_id long, ids array<long>")

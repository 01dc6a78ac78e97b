"""Situations over time: phases and severities, what is pruned and swept, what is split, and which are shown.

Each operator takes the table of situations and gives it back changed, so a tick is one after the other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fusewright.functions import lifecycle as L
from fusewright.functions import names as N
from fusewright.functions import titles as T
from fusewright.plans.staging import written
from fusewright.situations.scoring import TELEMETRY

#: Tags that say where an event is from or how it was graded, not what it is about.
SOURCE_TAGS = ("gdacs", "firms", "copernicus", "usgs", "acled", "gdelt", "green", "orange", "red", "closed")


def percentile_least(counts: DataFrame, cold: int = 50, window: int = 2880) -> DataFrame:
    """One row (medium, high, critical): nearest-rank percentiles 75, 90 and 99 of situations' event counts in the latest `window` snapshots, null while there are fewer than `cold` of them.

    counts: (snapshot, event_count).
    """
    latest = counts.select("snapshot").distinct().orderBy(F.col("snapshot").desc()).limit(window)
    rows = counts.join(F.broadcast(latest), "snapshot")
    out = rows.agg(F.countDistinct("snapshot").alias("n"), *(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY event_count)").cast("long").alias(k) for k, p in (("medium", 0.75), ("high", 0.9), ("critical", 0.99))))
    return out.select(*(F.when(F.col("n") >= cold, F.greatest(F.col(k), F.lit(1))).alias(k) for k in ("medium", "high", "critical")))


def evaluate(situations: DataFrame, now: int, least: tuple = (5, 25, 40)) -> DataFrame:
    """One tick: phases, peaks, severities from scratch, and parents raised by a third of their larger children.

    Beside the situations' columns: phase_changed_at, peak, peak_at, velocity (events of the last 5 minutes) and recent
    (whether one of the last 4 hours). Adds from_phase (null where it stays) and was_rank.
    """
    c, hours = F.col, lambda t: F.floor(F.greatest(F.lit(now) - t, F.lit(0)) / 60) / 60.0
    rank, diversity = c("severity_rank"), N.source_diversity(c("sources"))
    idle, minutes = hours(c("last_updated")), F.floor((F.lit(now) - c("peak_at")) / 60)
    rate = c("velocity").cast("double")
    peak = L.peak_rate(rate, c("peak"), minutes)
    events = F.greatest("total_events", "event_count")
    tolerance = L.gap_tolerance(rank, diversity, c("peak"), minutes)
    news_only = F.forall("sources", lambda s: s.isin(*N.NEWS)) & (F.floor((F.lit(now) - c("first_seen")) / 3600) > 72) & (rank <= 2) & ~c("phase").isin("declining", "resolved", "historical")
    lingering = (c("phase") == "declining") & (hours(c("phase_changed_at")) > 48)
    wanted = L.next_phase(c("phase"), c("velocity"), peak, rate, diversity, rank, idle, events, tolerance)
    dwell, ending = hours(c("phase_changed_at")), wanted.isin("declining", "resolved", "historical")
    held = (c("phase") == "active") & ending & (((rank == 4) & (dwell < 24)) | ((rank == 3) & (dwell < 12)) | ((wanted == "declining") & ((dwell < 6) | c("recent"))))
    forced = news_only | lingering
    to = F.when(news_only, "declining").when(lingering, "resolved").when(~F.coalesce(held, F.lit(False)), wanted)
    effective = F.when(c("parent_id").isNotNull() & (F.size("direct_sources") > 0), c("direct_sources")).otherwise(c("sources"))
    counted = F.when(c("parent_id").isNotNull() & (c("direct_events") > 0), c("direct_events")).otherwise(events)
    fresh = L.recomputed_rank(
        F.coalesce(c("to_"), c("phase")),
        F.exists(effective, lambda s: s.isin(*N.CONFLICT_SOURCES)),
        F.exists("topics", N.is_conflict_topic),
        F.exists(effective, lambda s: s.isin(*N.CYBER_SOURCES)),
        F.exists("topics", N.is_disaster_topic),
        counted,
        N.source_diversity(effective),
        c("parent_id").isNotNull(),
        (F.lit(now) - c("last_updated")) / 3600.0,
        least,
    )
    x = situations.withColumns({"to_": to, "forced_": forced, "peak_": peak, "faded_": L.decayed_peak(F.lit(1.0), minutes)})
    x = x.withColumn("rank_", F.when(c("forced_"), rank).otherwise(fresh))
    kids = x.where("parent_id is not null and event_count >= 15").groupBy(F.col("parent_id").alias("sid")).agg(F.count("*").alias("n_"), *(F.sum((c("rank_") >= r).cast("long")).alias(f"n{r}_") for r in (1, 2, 3, 4)))
    x = x.join(kids, "sid", "left")
    share = lambda r: c(f"n{r}_") / c("n_") >= 0.34
    agreed = F.when(c("parent_id").isNotNull() | c("n_").isNull(), 0).when(share(4), 4).when(share(3), 3).when(share(2), 2).when(share(1), 1).otherwise(0)
    moved = c("to_").isNotNull()
    set_ = {
        "phase": F.coalesce("to_", "phase"),
        "phase_changed_at": F.when(moved, F.lit(now).cast("long")).otherwise(c("phase_changed_at")),
        "peak": F.when(c("forced_"), c("peak")).otherwise(c("peak_")),
        "peak_at": F.when(~c("forced_") & (rate >= c("peak_") * c("faded_")), F.lit(now).cast("long")).otherwise(c("peak_at")),
        "severity_rank": F.greatest("rank_", agreed),
    }
    return x.select(*(set_[n].alias(n) if n in set_ else c(n) for n in situations.columns), F.when(moved, c("phase")).alias("from_phase"), rank.alias("was_rank"))


def pruned(situations: DataFrame, now: int, hours: float = 6.0) -> DataFrame:
    """Without stale situations; children of what went are parents' no more."""
    live = situations.where("parent_id is not null and phase not in ('resolved', 'historical')").select(F.col("parent_id").alias("sid")).distinct().withColumn("live_", F.lit(True))
    x = situations.join(live, "sid", "left")
    x = x.withColumn("stale_", L.stale(F.col("phase"), F.coalesce("live_", F.lit(False)), F.col("signal_events"), F.col("event_count"), (F.lit(now) - F.col("last_updated")) / 3600.0, hours))
    gone = x.where("stale_").select(F.col("sid").alias("parent_id")).withColumn("gone_", F.lit(True))
    kept = x.where("not stale_").join(gone, "parent_id", "left")
    return kept.select(*(F.when(F.coalesce("gone_", F.lit(False)), F.lit(None)).otherwise(F.col(n)).alias(n) if n == "parent_id" else F.col(n) for n in situations.columns))


def most_telling(situations: DataFrame, idf: DataFrame, kind: str, most: int) -> DataFrame:
    """(sid, kept): of each situation's entities (e) or topics (t) the `most` with the highest idf, of equals the first by name, sorted."""
    column = {"e": "entities", "t": "topics"}[kind]
    each = situations.select("sid", F.explode(column).alias("term")).join(idf.where(F.col("kind") == kind).select("term", "idf"), "term", "left")
    rank = F.row_number().over(W.partitionBy("sid").orderBy(F.coalesce("idf", F.lit(0.0)).desc(), "term"))
    return each.withColumn("rank", rank).where(F.col("rank") <= most).groupBy("sid").agg(F.array_sort(F.collect_list("term")).alias("kept"))


def swept(situations: DataFrame, idf: DataFrame, now: int, max_children: int = 50) -> DataFrame:
    """After a sweep: the most telling 25 entities and 15 topics; at most 150 events of more than 200; no children of one
    event that are over an hour old; at most `max_children` to a parent, those with the most events; and only children
    that share an entity or a title's words with their parent."""
    x = situations
    for kind, column, most in (("t", "topics", 15), ("e", "entities", 25)):
        kept = most_telling(situations.where(F.size(column) > most), idf, kind, most).withColumnRenamed("kept", f"kept_{kind}")
        x = x.join(kept, "sid", "left").withColumn(column, F.coalesce(f"kept_{kind}", column)).drop(f"kept_{kind}")
    x = x.withColumn("event_count", F.when(F.col("event_count") > 200, F.lit(150).cast("long")).otherwise(F.col("event_count"))).withColumn("direct_events", F.least("direct_events", "total_events"))
    x = x.where(~(F.col("parent_id").isNotNull() & (F.col("event_count") < 2) & (F.lit(now) - F.col("first_seen") > 3600)))
    rank = F.row_number().over(W.partitionBy("parent_id").orderBy(F.col("event_count").desc(), "sid"))
    ranked = x.where("parent_id is not null").withColumn("rank_", rank)
    parents = x.select(F.col("sid").alias("parent_id"), F.col("title").alias("title_"), F.col("entities").alias("entities_"))
    children = ranked.join(parents, "parent_id", "left")
    apart = F.col("title_").isNull() | ((F.size(F.array_intersect("entities", "entities_")) == 0) & (T.title_jaccard_filtered(F.col("title_"), F.col("title")) < 0.15))
    children = children.withColumn("parent_id", F.when((F.col("rank_") <= max_children) & ~apart, F.col("parent_id")))
    return x.where("parent_id is null").select(*situations.columns).unionByName(children.select(*situations.columns))


def divergent(situations: DataFrame, least_events: int = 30, least_entities: int = 4, most_overlap: float = 0.7) -> DataFrame:
    """(sid, part, entities, events): the parts of large top situations whose entities don't stand together in titles.

    Taken in order of name, each entity gathers those that share a title with it; a situation is split where there are
    two parts and the largest has less than `most_overlap` of the entities. A part's events are its share of entities, rounded up.
    """

    def split(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples():
                names, titles = sorted(set(r.entities)), [t.lower() for t in r.event_titles]
                with_: dict[str, set] = {n: set() for n in names}
                for t in titles:
                    there = [n for n in names if n in t]
                    for n in there:
                        with_[n].update(there)
                left, parts = set(names), []
                for n in names:
                    if n in left:
                        part = {n} | (with_[n] & left)
                        left -= part
                        parts.append(sorted(part))
                if len(parts) >= 2 and max(map(len, parts)) / len(names) < most_overlap:
                    out += [(r.sid, i, p, max(1, -(-r.event_count * len(p) // len(names)))) for i, p in enumerate(parts)]
            yield pd.DataFrame(out, columns=["sid", "part", "entities", "events"])

    large = situations.where((F.col("event_count") >= least_events) & F.col("parent_id").isNull() & (F.size(F.array_distinct("entities")) >= least_entities))
    return large.select("sid", "entities", "event_titles", "event_count").mapInPandas(split, "sid string, part int, entities array<string>, events long")


def two_means(vectors: np.ndarray, rounds: int = 10) -> np.ndarray | None:
    """Group 0 or 1 of each vector: by cosine, from the two least alike; None where one group takes all."""
    if len(vectors) < 2:
        return None
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    like = unit @ unit.T
    like[np.tril_indices(len(like))] = np.inf
    a, b = np.unravel_index(like.argmin(), like.shape)
    ca, cb, group = vectors[a], vectors[b], np.zeros(len(vectors), int)
    for _ in range(rounds):
        before = group
        near = [unit @ (c / max(np.linalg.norm(c), 1e-12)) for c in (ca, cb)]
        group = (near[0] < near[1]).astype(int)
        if (group == before).all():
            break
        if group.min() == group.max():
            return None
        ca, cb = vectors[group == 0].mean(0), vectors[group == 1].mean(0)
    return group if group.min() != group.max() else None


def coherence_splits(events: DataFrame, sample: int = 20, least: int = 6, smaller: int = 3) -> DataFrame:
    """(sid, event_id): the events that leave a situation, the smaller of two groups of its latest `sample` with vectors.

    events: (sid, event_id, event_time, vector). Nothing leaves with fewer than `least` vectors or `smaller` events to leave.
    """
    rank = F.row_number().over(W.partitionBy("sid").orderBy(F.col("event_time").desc(), F.col("event_id").desc()))
    latest = events.withColumn("rank", rank).where(F.col("rank") <= sample)

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        none = rows.iloc[:0][["sid", "event_id"]]
        if len(rows) < least:
            return none
        group = two_means(np.stack([np.asarray(v, float) for v in rows["vector"]]))
        if group is None:
            return none
        out = rows[group == (1 if (group == 1).sum() <= (group == 0).sum() else 0)]
        return out[["sid", "event_id"]] if len(out) >= smaller else none

    return latest.select("sid", "event_id", "vector", "rank").groupBy("sid").applyInPandas(split, "sid string, event_id long")


def roots(situations: DataFrame, hops: int = 10) -> DataFrame:
    """(sid, root): the topmost situation over each that has a parent in the table, up to so many hops."""
    up = situations.select(F.col("sid").alias("root"), F.col("parent_id").alias("next"))
    up = up.join(situations.select(F.col("sid").alias("next")), "next", "left_semi")
    out = situations.where("parent_id is not null").select("sid", F.col("parent_id").alias("root"))
    out = out.join(situations.select(F.col("sid").alias("root")), "root", "left_semi").select("sid", "root")
    step, reach = up.select("root", "next"), 1
    while reach < hops + 1:  # pointer doubling
        out = out.join(step, "root", "left").select("sid", F.coalesce("next", "root").alias("root"))
        step = step.alias("s").join(step.select(F.col("root").alias("next"), F.col("next").alias("after")), "next", "left").select("root", F.coalesce("after", "next").alias("next"))
        reach *= 2
    return out


def _alone(events: Column, sources: Column) -> Column:
    return (events >= 15) & (sources >= 2)


def active(situations: DataFrame) -> DataFrame:
    """What is shown: (sid, parent_id, title, severity_rank, certainty, source_count, event_count, last_updated).

    First the gate: parents with a proper title, children of three events, others of fifteen (medium severity: 23) with a
    proper title, two independent sources, not of telemetry alone and not without entities over four regions. Then children
    whose parent isn't shown stand alone or go; a parent's only child of its title goes; children go to the topmost parent;
    disasters and routine are capped by last change; what lost its parent stands alone or goes; of near equal titles the one
    with more events stays.
    """
    c = F.col
    kids = situations.where("parent_id is not null").groupBy(F.col("parent_id").alias("sid")).agg(F.count("*").alias("kids_"))
    x = situations.join(kids, "sid", "left").withColumn("kids_", F.coalesce("kids_", F.lit(0)))
    garbage = T.is_garbage_title(c("title"))
    diversity = N.source_diversity(c("sources"))
    standalone = (
        (c("event_count") >= F.when(c("severity_rank") == 2, 23).otherwise(15))
        & ~F.forall("sources", lambda s: s.isin(*TELEMETRY))
        & ~garbage
        & (diversity >= 2)
        & ~((F.size("entities") == 0) & (F.size("regions") >= 4))
    )
    gate = F.when(c("kids_") > 0, ~garbage).when(c("parent_id").isNotNull(), c("event_count") >= 3).otherwise(standalone)
    effective = F.when(c("parent_id").isNotNull() & (F.size("direct_sources") > 0), c("direct_sources")).otherwise(c("sources"))
    soup, wide = F.size("topics") >= 12, F.size("regions") >= 4
    x = x.where(gate).select(
        "sid",
        "parent_id",
        "title",
        F.when(soup, F.least("severity_rank", F.lit(3))).otherwise(c("severity_rank")).alias("severity_rank"),
        (c("certainty") * F.when(soup, 0.6).otherwise(1.0) * F.when(wide, 0.7).otherwise(1.0)).alias("certainty"),
        N.source_diversity(effective).alias("source_count"),
        "event_count",
        "last_updated",
        "topics",
    )
    # Each pass looks at the table from several sides, so what comes of one is written before the next.
    x = written(_without_orphans(written(x.withColumn("garbage_", garbage), "gated")), "active")
    # A parent's only child of the same title.
    only = x.where("parent_id is not null").groupBy(c("parent_id").alias("sid")).agg(F.count("*").alias("n"), F.min("sid").alias("child"), F.min(F.lower("title")).alias("of"))
    twins = x.where("parent_id is null").join(kids, "sid").where("kids_ = 1").join(only.where("n = 1"), "sid").where(F.lower("title") == c("of")).select(c("child").alias("sid"))
    x = x.join(twins, "sid", "left_anti")
    x = written(x.join(roots(x), "sid", "left").withColumn("parent_id", F.coalesce("root", "parent_id")).drop("root"), "active")
    x = written(_without_orphans(x), "active")
    x = written(_capped(x, F.exists("topics", N.is_disaster_topic) | T.is_disaster_title(c("title")), 2, 3), "active")
    x = written(_capped(x, ~F.exists("topics", N.is_conflict_topic) & (F.exists("topics", N.is_routine_topic) | T.is_routine_title(c("title"))), 2, 1), "active")
    x = written(_without_twins(written(_without_orphans(x), "active")), "active")
    return x.where("parent_id is not null or not garbage_").drop("topics", "garbage_")


def _without_orphans(x: DataFrame) -> DataFrame:
    """What has a parent that isn't there stands alone where it may, else it goes."""
    there = x.select(F.col("sid").alias("parent_id")).withColumn("there_", F.lit(True))
    x = x.join(there, "parent_id", "left").withColumn("orphan_", F.col("parent_id").isNotNull() & F.col("there_").isNull())
    x = x.where(~F.col("orphan_") | _alone(F.col("event_count"), F.col("source_count")))
    return x.withColumn("parent_id", F.when(~F.col("orphan_"), F.col("parent_id"))).drop("there_", "orphan_")


def _capped(x: DataFrame, kind: Column, alone: int, parents: int) -> DataFrame:
    """Of the top situations of a kind the latest: so many alone, so many with children."""
    kids = x.where("parent_id is not null").select(F.col("parent_id").alias("sid")).distinct().withColumn("has_", F.lit(True))
    x = x.join(kids, "sid", "left").withColumn("has_", F.coalesce("has_", F.lit(False))).withColumn("kind_", F.col("parent_id").isNull() & kind)
    top = x.where("kind_").withColumn("rank_", F.row_number().over(W.partitionBy("has_").orderBy(F.col("last_updated").desc(), "sid")))
    over = top.where(F.col("rank_") > F.when(F.col("has_"), parents).otherwise(alone)).select("sid")
    return x.join(over, "sid", "left_anti").drop("has_", "kind_")


def _without_twins(x: DataFrame) -> DataFrame:
    """Of top situations with near equal titles the one with more events; the other's children become its."""
    top = x.where("parent_id is null")
    words = F.filter(F.split(F.lower("title"), r"\s+"), lambda w: (F.octet_length(w) > 2) & ~w.isin(*T.GENERIC_WORDS))
    each = top.select("sid", "title", "event_count", F.explode(F.array_distinct(words)).alias("word"))
    a = each.select(F.col("sid").alias("a"), F.col("title").alias("a_title"), F.col("event_count").alias("a_n"), "word")
    b = each.select(F.col("sid").alias("b"), F.col("title").alias("b_title"), F.col("event_count").alias("b_n"), "word")
    # The winner of a pair: more events, then the lesser name. A loser goes to its best winner; what only loses to losers stays.
    pairs = a.join(b, "word").where("a_n > b_n or (a_n = b_n and a < b)").drop("word").distinct().where(T.title_jaccard_filtered(F.col("a_title"), F.col("b_title")) >= 0.75)
    pairs = pairs.join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    lost = pairs.groupBy(F.col("b").alias("loser")).agg(F.min(F.struct((-F.col("a_n")).alias("minus"), "a")).alias("w")).select("loser", F.col("w.a").alias("winner"))
    x = x.join(lost.select(F.col("loser").alias("sid")), "sid", "left_anti").join(lost.select(F.col("loser").alias("parent_id"), "winner"), "parent_id", "left")
    return x.withColumn("parent_id", F.coalesce("winner", "parent_id")).drop("winner")

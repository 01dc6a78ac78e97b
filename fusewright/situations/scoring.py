"""Which situation an event belongs to: candidates by shared entities and topics, their scores, and what follows.

A batch of events meets the situations as they stand; nothing is compared but what shares an entity or a topic.
Situations are rows (sid, parent_id, title, entities, topics, regions, sources, severity_rank, event_count, ...),
events rows (event_id, event_type, source_type, region, lat, lon, title, severity_rank, entities, topics, ...);
times are seconds. Columns that an operator doesn't name are left alone.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusewright.functions import lifecycle as L
from fusewright.functions import names as N
from fusewright.functions import regions as R
from fusewright.functions import titles as T

#: Sources whose events are natural disasters; with these alone a situation takes no flights.
NATURAL = ("usgs", "firms", "gdacs", "copernicus")
TELEMETRY = ("firms", "opensky", "airplaneslive", "adsb-fi", "adsb-lol")
#: Event types that found a situation whatever their severity.
IMPORTANT = (
    "conflict_event", "geo_event", "gps_interference", "internet_outage", "censorship_event", "bgp_leak", "seismic_event", "nuclear_event", "news_article", "geo_news",
    "telegram_message", "notam_event", "threat_intel", "fishing_event", "bluesky_post", "maritime_security",
)
#: Event types that count as signals.
SIGNALS = ("conflict_event", "news_article", "geo_news", "geo_event", "nuclear_event", "seismic_event", "censorship_event", "telegram_message", "bluesky_post", "threat_intel")
#: Least scores: of an event whose source the situation hasn't, and has.
CROSS, CROSS_ELSE = {"gdelt": 4}, 3
SAME, SAME_ELSE = {"gdelt": 5, "geoconfirmed": 5, "firms": 4}, 4
#: Kilometres from its middle beyond which a measured event doesn't belong to a situation.
COHERENCE_KM = 2000


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def terms_of(df: DataFrame, key: str) -> DataFrame:
    """(key, kind, term): entities (e) and topics (t), each once."""
    both = F.concat(
        F.transform(F.array_distinct("entities"), lambda x: F.struct(F.lit("e").alias("kind"), x.alias("term"))),
        F.transform(F.array_distinct("topics"), lambda x: F.struct(F.lit("t").alias("kind"), x.alias("term"))),
    )
    return df.select(key, F.explode(both).alias("x")).select(key, "x.kind", "x.term")


def streaming_idf(terms: DataFrame, order: str, decay: float = 0.9999, least: float = 100.0) -> DataFrame:
    """(kind, term, idf) of term rows in the order of an integer column of events 1, 2, ...: each event fades what came before by `decay`; the total counts terms."""
    last = terms.groupBy("kind").agg(F.max(order).alias("last"))
    weight = F.pow(F.lit(decay), F.col("last") - F.col(order))
    freq = terms.join(F.broadcast(last), "kind").groupBy("kind", "term").agg(F.sum(weight).alias("freq"))
    total = freq.groupBy("kind").agg(F.greatest(F.sum("freq"), F.lit(least)).alias("total"))
    return freq.join(F.broadcast(total), "kind").select("kind", "term", F.log(F.col("total") / (1 + F.col("freq"))).alias("idf"))


def score_candidates(events: DataFrame, situations: DataFrame, idf: DataFrame, now: int, similar: DataFrame | None = None) -> DataFrame:
    """(event_id, sid, score): pairs that share an entity or topic, but those that must not meet.

    idf: (kind, term, idf, anomaly); terms that it hasn't count least. similar: (event_id, sid, similarity), where vectors are at hand.
    """
    w = F.coalesce("idf", F.lit(0.0))
    part = F.when(F.col("kind") == "e", L.half_round(F.greatest(F.lit(1.0), F.least(F.lit(5.0), w)))).otherwise(
        L.half_round(F.greatest(F.lit(1.0), F.least(F.lit(7.0), w))) + L.half_round(F.coalesce("anomaly", F.lit(0.0)) * 2)
    )
    shared = terms_of(events, "event_id").join(terms_of(situations, "sid"), ["kind", "term"]).join(idf, ["kind", "term"], "left").withColumn("part", part)
    by = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("part"))), F.lit(0))
    pairs = shared.groupBy("event_id", "sid").agg(F.least(by("e"), F.lit(5)).alias("of_entities"), F.least(by("t"), F.lit(4)).alias("of_topics"))
    parents = situations.where("parent_id is not null").select(F.col("parent_id").alias("sid")).distinct().withColumn("is_parent", F.lit(True))
    s = situations.join(parents, "sid", "left").select("sid", "parent_id", "sources", "event_count", "regions", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), "event_titles", "last_updated", F.coalesce("is_parent", F.lit(False)).alias("is_parent"))
    e = events.select("event_id", "event_type", "source_type", "region", "lat", "lon", F.col("title").alias("e_title"))
    x = pairs.join(s, "sid").join(e, "event_id")
    if similar is not None:
        x = x.join(similar, ["event_id", "sid"], "left")
    else:
        x = x.withColumn("similarity", F.lit(None).cast("double"))
    c, sources = F.col, F.col("sources")
    leaf = c("parent_id").isNull() & ~c("is_parent")
    blocked = leaf & (((F.size(sources) == 1) & (c("event_count") >= 50)) | (c("event_count") >= 500))
    blocked = blocked | ((c("event_type") == "flight_position") & (F.size(sources) > 0) & F.forall(sources, lambda t: t.isin(*NATURAL)))
    blocked = blocked | (c("event_type").isin("seismic_event", "thermal_anomaly") & (F.size(sources) > 0) & F.forall(sources, lambda t: t.isin(*N.FLIGHTS)))
    own = R.normalize_region(c("region"))
    in_region = F.coalesce(F.exists("regions", lambda r: R.normalize_region(r) == own), F.lit(False))
    km, radius = distance_km(c("lat"), c("lon"), c("s_lat"), c("s_lon")), L.geo_radius_km(c("event_type"))
    near = F.when(km.isNull(), 0).when(km <= radius * 0.5, 2).when(km <= radius, 1).when((km > COHERENCE_KM) & c("event_type").isin(*R.RELIABLE), -15).otherwise(0)
    alone = (N.source_diversity(sources) == 1) & (F.array_contains(sources, c("source_type")) | (c("source_type").isin(*N.FLIGHTS) & F.exists(sources, lambda t: t.isin(*N.FLIGHTS))))
    sim = c("similarity")
    vector = F.when(sim.isNull(), 0).when(sim < 0.40, -L.half_round((0.40 - sim) * 10)).when(sim >= 0.75, 3).when(sim >= 0.65, 2).when(sim >= 0.55, 1).otherwise(0)
    best = F.coalesce(F.array_max(F.transform("event_titles", lambda t: T.title_jaccard(c("e_title"), t))), F.lit(0.0))
    title = F.when(best >= 0.6, 3).when(best >= 0.4, 2).when(best >= 0.25, 1).otherwise(0)
    score = L.size_penalty(c("event_count")) + c("of_entities") + c("of_topics") + F.when(in_region, 1).otherwise(0) + near - F.when(alone, 1).otherwise(0) + vector + title
    hours = F.floor(F.greatest(F.lit(now) - c("last_updated"), F.lit(0)) / 60) / 60.0
    return x.where(~blocked).select("event_id", "sid", "sources", "source_type", L.faded(score, c("event_type"), hours).alias("score"))


def assign(events: DataFrame, scored: DataFrame) -> DataFrame:
    """(event_id, action, sid): what becomes of each event with an entity or topic.

    merge into the best situation (of equal scores the least sid) where the score is positive and enough;
    else nothing for flights, quakes below 6.5, hotspots and news of little relevance; create for high severity
    or an important type; buffer the rest.
    """
    best = scored.groupBy("event_id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "sid", "sources")).alias("x"))
    best = best.select("event_id", (-F.col("x.minus")).alias("score"), "x.sid", "x.sources")
    c, source = F.col, F.col("source_type")
    cross = F.when(source.isin(*N.FLIGHTS), F.exists("sources", lambda s: ~s.isin(*N.FLIGHTS))).otherwise(~F.array_contains("sources", source))
    enough = F.when(cross, L.by_type(source, CROSS, CROSS_ELSE)).otherwise(L.by_type(source, SAME, SAME_ELSE))
    x = events.where((F.size("entities") > 0) | (F.size("topics") > 0)).join(best, "event_id", "left")
    relevance = F.coalesce(F.get_json_object("payload", "$.enrichment.relevance_score").cast("double"), F.lit(0.5))
    dull = (c("event_type") == "news_article") & (relevance < 0.30) & F.get_json_object("payload", "$.enrichment").isNotNull()
    magnitude = F.coalesce(F.get_json_object("payload", "$.mag"), F.get_json_object("payload", "$.magnitude")).cast("double")
    none = (c("event_type") == "flight_position") | ((c("event_type") == "seismic_event") & (F.coalesce(magnitude, F.lit(0.0)) < 6.5)) | (c("event_type") == "thermal_anomaly")
    merge = F.coalesce((c("score") > 0) & (c("score") >= enough), F.lit(False))
    action = F.when(dull, "skip").when(merge, "merge").when(none, "suppress").when((c("severity_rank") >= 3) | c("event_type").isin(*IMPORTANT), "create").otherwise("buffer")
    return x.select("event_id", action.alias("action"), F.when(action == "merge", c("sid")).alias("sid"))


def merge_events(situations: DataFrame, events: DataFrame, assigned: DataFrame, now: int) -> DataFrame:
    """Situations after the events assigned to them by `merge`, as a batch: counts, sources, regions (4 at most, the first by name), severity, times, terms and titles.

    Terms are added in order of name up to 50 entities and 30 topics; raw tags with a colon are no topics. Of
    events' titles the first 30 stay, in order of time.
    """
    x = assigned.where("action = 'merge'").select("event_id", "sid").join(events, "event_id")
    fatal = (F.col("event_type") == "conflict_event") & (F.coalesce(F.get_json_object("payload", "$.fatalities").cast("double"), F.lit(0.0)) > 0)
    rank = F.greatest("severity_rank", F.when(fatal, 3).otherwise(0))
    titles = F.transform(F.array_sort(F.collect_list(F.when(F.trim("title") != "", F.struct("event_time", "event_id", F.trim("title").alias("title"))))), lambda t: t["title"])
    new = x.groupBy("sid").agg(
        F.count("*").alias("n"),
        F.sum(F.col("event_type").isin(*SIGNALS).cast("long")).alias("n_signals"),
        F.collect_set("source_type").alias("new_sources"),
        F.collect_set(R.normalize_region(F.col("region"))).alias("new_regions"),
        F.max(rank).alias("new_rank"),
        F.min("event_time").alias("first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("entities")))).alias("new_entities"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter("topics", lambda t: ~t.contains(":")))))).alias("new_topics"),
        titles.alias("new_titles"),
    )
    had = F.col("n").isNotNull()
    grown = lambda old, more, most: F.when(had, F.concat(old, F.slice(F.array_sort(F.array_except(more, old)), F.lit(1), F.greatest(F.lit(most) - F.size(old), F.lit(0))))).otherwise(F.col(old))
    set_ = {
        "event_count": F.col("event_count") + F.coalesce("n", F.lit(0)),
        "total_events": F.col("total_events") + F.coalesce("n", F.lit(0)),
        "direct_events": F.col("direct_events") + F.coalesce("n", F.lit(0)),
        "signal_events": F.col("signal_events") + F.coalesce("n_signals", F.lit(0)),
        "sources": F.when(had, F.array_sort(F.array_union("sources", "new_sources"))).otherwise(F.col("sources")),
        "direct_sources": F.when(had, F.array_sort(F.array_union("direct_sources", "new_sources"))).otherwise(F.col("direct_sources")),
        "regions": grown("regions", "new_regions", 4),
        "entities": grown("entities", "new_entities", 50),
        "topics": grown("topics", "new_topics", 30),
        "event_titles": F.when(had, F.slice(F.concat("event_titles", "new_titles"), 1, 30)).otherwise(F.col("event_titles")),
        "severity_rank": F.greatest("severity_rank", F.coalesce("new_rank", F.lit(0))),
        "first_seen": F.least("first_seen", F.coalesce("first", F.col("first_seen"))),
        "last_updated": F.when(had, F.lit(now).cast("long")).otherwise(F.col("last_updated")),
    }
    joined = situations.join(new, "sid", "left")
    return joined.select(*(set_[c].alias(c) if c in set_ else F.col(c) for c in situations.columns))


def founded(events: DataFrame, assigned: DataFrame, now: int) -> DataFrame:
    """New situations of the events with the action `create`, each its own: its terms, title and severity; topics by type and source where it has none."""
    x = assigned.where("action = 'create'").select("event_id").join(events, "event_id")
    c = F.col
    relevant = F.coalesce(F.get_json_object("payload", "$.enrichment.relevance_score").cast("double"), F.lit(0.0)) >= 0.85
    threat = c("event_type").isin("conflict_event", "thermal_anomaly", "nuclear_event", "gps_interference", "seismic_event", "notam_event", "geo_event")
    fatal = (c("event_type") == "conflict_event") & (F.coalesce(F.get_json_object("payload", "$.fatalities").cast("double"), F.lit(0.0)) > 0)
    rank = F.greatest(c("severity_rank"), F.when((relevant & threat) | fatal, 3).otherwise(0))
    of_type = L.by_type(c("event_type"), TYPE_TOPICS, F.lit(None))
    of_source = L.by_type(c("source_type"), SOURCE_TOPICS, F.lit(None))
    bare = F.forall("topics", lambda t: t.contains(":"))
    topics = F.when(bare, F.array_sort(F.array_distinct(F.array_compact(F.concat("topics", F.array(of_type, of_source)))))).otherwise(c("topics"))
    region = R.normalize_region(c("region"))
    regions = F.array_compact(F.array(region))
    usable = F.coalesce(~R.is_null_island(c("lat"), c("lon")) & ~R.is_region_center(c("lat"), c("lon")) & ~R.is_placeholder(c("lat"), c("lon")) & (c("event_type") != "notam_event"), F.lit(False))
    sources = F.array("source_type")
    return x.withColumn("topics_", topics).select(
        F.concat(F.lit("e"), c("event_id").cast("string")).alias("sid"),
        F.lit(None).cast("string").alias("parent_id"),
        T.generate_title(c("entities"), c("topics"), region).alias("title"),
        "entities",
        F.filter("topics_", lambda t: ~t.contains(":")).alias("topics"),
        regions.alias("regions"),
        sources.alias("sources"),
        sources.alias("direct_sources"),
        rank.alias("severity_rank"),
        F.lit(1).cast("long").alias("event_count"),
        F.lit(1).cast("long").alias("total_events"),
        F.lit(1).cast("long").alias("direct_events"),
        c("event_type").isin(*SIGNALS).cast("long").alias("signal_events"),
        c("event_time").alias("first_seen"),
        F.lit(now).cast("long").alias("last_updated"),
        F.when(usable, c("lat")).alias("lat"),
        F.when(usable, c("lon")).alias("lon"),
        F.filter(F.array(F.trim("title")), lambda t: t != "").alias("event_titles"),
        F.lit("emerging").alias("phase"),
    )


#: Topics of events that bring none, by their type and source.
TYPE_TOPICS = {
    "thermal_anomaly": "thermal-anomaly",
    "seismic_event": "seismic",
    "nuclear_event": "nuclear",
    "conflict_event": "conflict",
    "geo_event": "conflict",
    "gps_interference": "gps-interference",
    "notam_event": "airspace",
    "fishing_event": "maritime",
    "vessel_position": "maritime",
    "maritime_security": "maritime",
    "news_article": "news",
    "geo_news": "news",
    "telegram_message": "osint",
    "bluesky_post": "osint",
    "internet_outage": "cyber",
    "censorship_event": "cyber",
    "bgp_leak": "cyber",
    "bgp_anomaly": "cyber",
    "threat_intel": "cyber",
    "cert_issued": "cyber",
}
SOURCE_TOPICS = {
    "firms": "thermal-anomaly",
    "usgs": "seismic",
    "nuclear": "nuclear",
    "gdelt": "conflict",
    "gdelt-geo": "conflict",
    "geoconfirmed": "conflict",
    "acled": "conflict",
    "gpsjam": "gps-interference",
    "cloudflare": "cyber",
    "cloudflare-bgp": "cyber",
    "ioda": "cyber",
    "bgp": "cyber",
    "otx": "cyber",
    "certstream": "cyber",
    "ooni": "cyber",
    "gdacs": "disaster",
    "copernicus": "disaster",
    "ukmto": "maritime",
    "ukmto-warnings": "maritime",
    "ais": "maritime",
    "gfw": "maritime",
    "imb-piracy": "maritime",
}


def pending_groups(pending: DataFrame, now: int, seconds: int = 300, most: int = 200) -> DataFrame:
    """(event_id, group_id): buffered events, the latest `most` not older than `seconds`, that share two entities or topics with another, and the least event_id of their group.

    The buffer is bounded by `most`, so its pairs and components are.
    """
    latest = pending.where(F.col("received_at") >= now - seconds).orderBy(F.col("received_at").desc(), F.col("event_id").desc()).limit(most)

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(rows["event_id"])
        terms = {r.event_id: {*(("e", x) for x in r.entities), *(("t", x) for x in r.topics)} for r in rows.itertuples()}
        least = {i: i for i in ids}

        def root(i):
            while least[i] != i:
                i = least[i]
            return i

        for n, i in enumerate(ids):
            for j in ids[n + 1 :]:
                if len(terms[i] & terms[j]) >= 2:
                    a, b = sorted((root(i), root(j)))
                    least[b] = a
        found = pd.DataFrame({"event_id": ids, "group_id": [root(i) for i in ids]}, dtype="int64")
        return found[found.groupby("group_id")["event_id"].transform("size") > 1]

    return latest.select(F.lit(0).alias("all"), "event_id", "entities", "topics").groupBy("all").applyInPandas(group, "event_id long, group_id long")

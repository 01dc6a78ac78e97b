"""What is missing about a situation, what to ask for, and when to write about it again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Regions too broad to ask for.
BROAD = ["africa", "europe", "asia", "middle-east", "me", "americas", "south-america", "north-america", "oceania", "global"]
NEWS, CONFLICT, SENSORS = ("gdelt", "gdelt-geo", "rss"), ("acled", "geoconfirmed"), ("firms", "usgs", "opensky", "airplaneslive-mil", "ais")
#: Minutes for which a gap isn't searched again.
COOLDOWN = {"news_coverage": 20, "ground_verification": 30, "entity_background": 120, "stale_context": 15, "corroboration": 45, "regional_context": 60}


def relevant_entities(entities: Column, titles: Column, topics: Column, regions: Column) -> Column:
    """Of more than five entities the eight that titles, topics and regions mention most, of equals by name; of none the first five."""
    low = lambda xs: F.transform(xs, F.lower)
    said, topic, region = low(titles), F.array_join(low(topics), " "), F.array_join(low(regions), " ")
    corpus = F.array_join(said, " ")

    def points(e: Column) -> Column:
        x = F.lower(e)
        parts = F.filter(F.split(x, r"\s+"), lambda p: p != "")
        score = 2 * F.size(F.filter(said, lambda t: t.contains(x))) + topic.contains(x).cast("int") + region.contains(x).cast("int")
        score = score + ((F.size(parts) >= 2) & (F.size(F.filter(parts, lambda p: (F.octet_length(p) >= 3) & corpus.contains(p))) >= 2)).cast("int")
        return score + F.when((F.size(parts) == 1) & F.array_contains(low(regions), x), 2).otherwise(0)

    ranked = F.array_sort(F.filter(F.transform(entities, lambda e: F.struct((-points(e)).alias("minus"), e.alias("name"))), lambda s: s["minus"] < 0))
    best = F.transform(F.slice(ranked, 1, 8), lambda s: s["name"])
    return F.when(F.size(entities) <= 5, entities).when(F.size(best) == 0, F.slice(entities, 1, 5)).otherwise(best)


def search_query(title: Column, entities: Column, topics: Column, regions: Column) -> Column:
    """Three entities, those of most words first, two regions and two topics, each once; too broad ones only where nothing else is said.

    Empty where there is only the broad to say, the title where there is nothing, and the title's first words behind a short query.
    """
    words = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    place = F.transform(entities, lambda e, i: F.struct((-words(e)).alias("minus"), i.alias("i"), F.trim(e).alias("x")))
    first = F.filter(F.transform(F.slice(F.array_sort(place), 1, 3), lambda s: s["x"]), lambda x: x != "")
    has = lambda xs, x: F.exists(xs, lambda y: F.lower(y) == F.lower(x))

    def with_region(acc: Column, r: Column) -> Column:
        skip = (r == "") | has(acc, r) | ((F.size(acc) >= 2) & F.lower(r).isin(*BROAD))
        return F.when(skip, acc).otherwise(F.concat(acc, F.array(r)))

    parts = F.aggregate(F.transform(F.slice(regions, 1, 2), F.trim), first, with_region)
    parts = F.aggregate(F.transform(F.slice(topics, 1, 2), lambda t: F.replace(F.trim(t), F.lit("-"), F.lit(" "))), parts, lambda acc, t: F.when((t == "") | has(acc, t), acc).otherwise(F.concat(acc, F.array(t))))
    query = F.array_join(parts, " ")
    lead = F.array_join(F.slice(F.filter(F.split(title, r"\s+"), lambda w: w != ""), 1, 5), " ")
    broad = F.forall(parts, lambda p: F.lower(p).isin(*BROAD) | (F.octet_length(p) < 4)) & (F.size(entities) == 0)
    return F.when(F.size(parts) == 0, title).when(broad, F.lit("")).when((F.octet_length(query) < 10) & (lead != ""), F.concat(query, F.lit(" "), lead)).otherwise(query)


def gaps(sources: Column, severity_rank: Column, events: Column, entities: Column, enriched: Column, placed: Column, regions: Column, context_age: Column, searched: Column) -> Column:
    """What is missing, as (type, weight) by weight: news, ground truth, other sources, fresh context, background, regional context.

    context_age: seconds since the supplement was fetched, null without one. searched: map of gap type to minutes since it was last searched.
    """
    of = lambda kinds: F.exists(sources, lambda s: s.rlike("^(" + "|".join(kinds) + ")"))
    news, ground = of(NEWS), of(CONFLICT) | of(SENSORS)
    due = lambda g: F.coalesce(F.element_at(searched, F.lit(g)) >= COOLDOWN[g], F.lit(True))
    stale = context_age >= F.when(severity_rank == 4, 1800).when(severity_rank == 3, 3600).otherwise(10800)
    found = {
        "news_coverage": (ground & ~news, F.lit(0.9)),
        "ground_verification": (news & ~ground, F.lit(0.6)),
        "corroboration": ((F.size(sources) == 1) & (events >= 3), F.lit(0.65)),
        "stale_context": (F.coalesce(stale, F.lit(False)), F.when(severity_rank == 4, 0.85).when(severity_rank == 3, 0.8).otherwise(0.7)),
        "entity_background": ((F.size(entities) > 0) & ~enriched, F.when(F.size(entities) >= 3, 0.5).otherwise(0.35)),
        "regional_context": (placed & (F.size(regions) > 0) & context_age.isNull(), F.lit(0.4)),
    }
    each = [F.when(when & due(g), F.struct((-weight).alias("minus"), F.lit(g).alias("type"))) for g, (when, weight) in found.items()]
    return F.transform(F.array_sort(F.array_compact(F.array(*each))), lambda s: F.struct(s["type"].alias("type"), (-s["minus"]).alias("weight")))


def search_priority(severity_rank: Column, sources: Column, n_gaps: Column, events: Column, age_minutes: Column, last_minutes: Column, searches: Column, empty: Column) -> Column:
    """0 to 100: how soon a situation with gaps should be searched."""
    score = F.when(severity_rank == 4, 40.0).when(severity_rank == 3, 30.0).when(severity_rank == 2, 15.0).when(severity_rank == 1, 5.0).otherwise(0.0)
    score = score + F.least(F.size(sources), F.lit(5)) * 4 + F.least(n_gaps, F.lit(4)) * 5 + F.least(events / (F.greatest(age_minutes, F.lit(1)) / 60.0), F.lit(10.0))
    score = score - F.when(last_minutes < 15, 20).when(last_minutes < 30, 10).otherwise(0)
    share = empty / F.greatest(searches, F.lit(1))
    score = score - F.when((searches > 2) & (share > 0.7), 15).when((searches > 2) & (share > 0.5), 8).otherwise(0)
    return F.when(n_gaps == 0, 0).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))).cast("int")


def narrative_due(version: Column, state_change: Column, escalated: Column, events_since: Column, minutes: Column) -> Column:
    return (version == 0) | state_change | escalated | (events_since >= 30) | F.coalesce((minutes >= 120) & (events_since >= 10), F.lit(False))


def summary_due(events: Column, events_then: Column, hours: Column) -> Column:
    """hours: since the last summary, null without one."""
    return (events >= 10) & (hours.isNull() | (F.greatest(events - events_then, F.lit(0)) >= 50) | (hours >= 6))

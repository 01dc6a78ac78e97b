"""Names of entities and topics: normal forms, and which of them say something."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of companies' names, taken off one after the other.
SUFFIXES = [" ltd", " llc", " co.", " inc", " pjs", " pjsc", " corp", " gmbh", " s.a.", " sa", " ag", " plc", " pty", " bv", " nv", " srl", " spa", " ab", " oy", " as"]
#: Short names and what they stand for.
ALIASES = {
    "drc": "democratic republic of the congo",
    "dr congo": "democratic republic of the congo",
    "uae": "united arab emirates",
    "us": "united states",
    "usa": "united states",
    "u.s.": "united states",
    "u.s.a.": "united states",
    "united states of america": "united states",
    "uk": "united kingdom",
    "u.k.": "united kingdom",
    "great britain": "united kingdom",
    "dprk": "democratic people's republic of korea",
    "north korea": "democratic people's republic of korea",
    "rok": "republic of korea",
    "south korea": "republic of korea",
    "prc": "china",
    "people's republic of china": "china",
    "ksa": "saudi arabia",
    "idf": "israel defense forces",
    "irgc": "islamic revolutionary guard corps",
    "nato": "north atlantic treaty organization",
    "eu": "european union",
    "hamas movement": "hamas",
    "hizbollah": "hezbollah",
    "hizballah": "hezbollah",
}
#: Words of carriers' names, names of news houses, and of channels.
CARRIERS = ["telecom", "broadband", "hosting", "datacenter", "data center", "colocation", "communications", "isp", "wireless", "mobile"]
NEWS_HOUSES = ["deutsche welle", "reuters", "associated press", "bbc", "al jazeera", "cnn", "fox news", "new york times", "washington post", "guardian", "france 24", "dw news", "sky news", "bloomberg", "afp"]
CHANNELS = [
    "war monitor", "noelreports", "intel slava z", "sitrep", "clash report", "deepstate english", "rybar english", "conflict intelligence team",
    "geoconfirmed", "intelsky", "ukraine military intel", "abu ali express", "cumta red alerts", "houthi military media",
]
#: Topics that connect nearly everything, and beginnings of such.
GENERIC_TOPICS = [
    "diplomatic-rhetoric", "tariff-dispute", "defense-spending", "eu-politics", "trade-policy", "armed-conflict", "military-activity", "geopolitical-tensions",
    "international-relations", "security-concerns", "diplomatic-relations", "diplomatic-negotiations", "activism", "cultural-event",
    "baseball", "football", "soccer", "basketball", "sports", "entertainment", "celebrity", "music", "film",
]
GENERIC_BEGINNINGS = ["regional-", "geopolitical-", "international-", "strategic-", "military-", "global-", "middle-east-", "political-"]
#: Names of languages, which feeds give as tags.
LANGUAGES = (
    "albanian arabic armenian azerbaijani bengali bulgarian burmese chinese croatian czech danish dutch english estonian finnish french german greek hebrew hindi "
    "hungarian indonesian italian japanese korean kurdish latvian lithuanian malay malayalam norwegian pashto persian polish portuguese romanian russian serbian "
    "sinhalese slovak slovenian somali spanish swahili swedish tamil telugu thai turkish ukrainian urdu uzbek vietnamese"
).split()
#: Parts of topics that name fighting, disasters, and routine.
CONFLICT = [
    "war", "conflict", "strike", "attack", "bombing", "shelling", "missile", "airstrike", "frontline", "casualties", "killed", "combat", "offensive", "invasion",
    "battle", "siege", "armed-conflict", "military-strike", "drone-strike", "cross-border", "artillery", "rocket", "military",
]
DISASTER_WORDS = ["fire", "fires", "blaze"]
DISASTER = [
    "wildfire", "forest-fire", "bushfire", "drought", "flood", "cyclone", "hurricane", "typhoon", "tornado", "earthquake", "tsunami", "volcanic", "eruption",
    "thermal-anomaly", "fire-activity", "natural-disaster",
]
ROUTINE = [
    "summit", "session", "commission", "conference", "assembly", "committee", "delegation", "negotiation", "diplomatic", "diplomacy", "treaty", "accord", "resolution",
    "bilateral", "multilateral", "ministerial", "plenary", "caucus", "election", "ballot", "referendum", "inauguration", "legislation", "parliamentary", "legislative",
    "judicial", "regulatory", "governance", "constituency", "campaign", "trade-deal", "trade-agreement", "economic-forum", "fiscal-policy", "monetary-policy",
    "interest-rate", "stock-market", "gdp", "earnings", "quarterly-report", "central-bank", "imf", "world-bank", "economic-outlook", "market-rally", "tournament",
    "championship", "olympics", "world-cup", "ceremony", "festival", "award",
]
FLIGHTS = ("airplaneslive", "adsb-fi", "adsb-lol", "opensky")
NEWS = ("gdelt", "gdelt-geo", "rss-news")
CATALOGS = ("gdacs", "copernicus")
CONFLICT_SOURCES = ("acled", "geoconfirmed", "gdelt", "gdelt-geo")
CYBER_SOURCES = ("cloudflare", "cloudflare-bgp", "ioda", "bgp", "otx", "certstream", "ooni", "shodan")


def contains_any(text: Column, parts: list[str]) -> Column:
    """Whether the text has any of the parts: one pattern, so that long lists stay one expression."""
    return text.rlike("|".join(rf"\Q{p}\E" for p in parts))


def normalize_entity(name: Column) -> Column:
    """Lower case, without a company's endings, separators as blanks, no marks at the end, short names written out."""
    s = F.lower(F.trim(name))
    for suffix in SUFFIXES:  # a pattern names the text once, so the expression stays small
        s = F.regexp_replace(s, rf"\Q{suffix}\E\z", "")
    s = F.trim(F.regexp_replace(F.translate(s, "_-", "  "), r"[.,;:!?]+\z", ""))
    alias = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.get(F.transform(F.array(s), lambda x: F.coalesce(F.element_at(alias, x), x)), F.lit(0))


def is_entity_worthy(name: Column, source_type: Column, tags: Column, org: Column) -> Column:
    """Whether a name says something: no scanned host's owner, call sign, carrier (but for outages), news house or channel."""
    low = F.lower(name)
    owner = (source_type == "shodan") & F.coalesce(F.lower(org) == low, F.lit(False))
    callsign = source_type.isin(*FLIGHTS) & name.rlike("^[A-Z]{4}.*[0-9]") & (F.octet_length(name) <= 8)
    disruption = F.exists(tags, lambda t: t.contains("disruption") | t.contains("outage") | t.contains("censorship"))
    return (F.octet_length(low) >= 3) & ~owner & ~callsign & ~(contains_any(low, CARRIERS) & ~disruption) & ~low.isin(*NEWS_HOUSES) & ~low.isin(*CHANNELS)


def _texts(payload: Column, path: str, kind: str) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(payload, path), kind), F.from_json(F.lit("[]"), kind))


def extract_entities(event_type: Column, source_type: Column, entity_name: Column, tags: Column, payload: Column, most: int = 5) -> Column:
    """Normal names of an event's entities, sorted: its own, those of actor tags, a confirmed place's conflict, the first of its enrichment. Positions have none."""
    actors = F.transform(F.filter(tags, lambda t: t.startswith("actor:")), lambda t: F.substring(t, F.lit(7), F.length(t)))
    conflict = F.when(event_type == "geo_event", F.get_json_object(payload, "$.conflict"))
    enriched = F.transform(F.slice(_texts(payload, "$.enrichment.entities", "array<struct<name:string>>"), 1, most), lambda e: e["name"])
    raw = F.transform(F.concat(F.array(entity_name), actors, F.array(conflict), enriched), F.trim)
    raw = F.filter(raw, lambda n: n.isNotNull() & (n != ""))
    org = F.get_json_object(payload, "$.org")
    names = F.filter(F.transform(F.filter(raw, lambda n: is_entity_worthy(n, source_type, tags, org)), normalize_entity), lambda n: n != "")
    return F.when(event_type.isin("flight_position", "vessel_position"), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(names)))


def extract_topics(event_type: Column, tags: Column, payload: Column, most: int = 3) -> Column:
    """An event's topics, sorted: the first of its enrichment, those of topic tags, and plain tags. Positions have none."""
    enriched = F.transform(F.slice(_texts(payload, "$.enrichment.topics", "array<string>"), 1, most), F.trim)
    enriched = F.filter(enriched, lambda t: (t != "") & ~t.rlike("^(" + "|".join(GENERIC_BEGINNINGS) + ")"))
    named = F.transform(F.filter(tags, lambda t: t.startswith("topic:")), lambda t: F.trim(F.substring(t, F.lit(7), F.length(t))))
    plain = F.transform(F.filter(tags, lambda t: ~t.rlike("^(topic|actor|source|query):")), lambda t: F.lower(F.trim(t)))
    plain = F.filter(plain, lambda t: (F.octet_length(t) >= 3) & ~t.isin(*LANGUAGES))
    every = F.concat(enriched, F.filter(named, lambda t: t != ""), plain)
    return F.when(event_type.isin("flight_position", "vessel_position"), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.filter(every, lambda t: ~t.isin(*GENERIC_TOPICS)))))


def is_conflict_topic(topic: Column) -> Column:
    return contains_any(F.lower(topic), CONFLICT)


def is_disaster_topic(topic: Column) -> Column:
    return F.lower(topic).isin(*DISASTER_WORDS) | contains_any(F.lower(topic), DISASTER)


def is_routine_topic(topic: Column) -> Column:
    return contains_any(F.lower(topic), ROUTINE)


def source_family(source_type: Column) -> Column:
    """Sources that tell the same, by one name."""
    return F.when(source_type.isin(*FLIGHTS), "flight").when(source_type.isin(*NEWS), "news").when(source_type.isin(*CATALOGS), "disaster").otherwise(source_type)


def source_diversity(source_types: Column) -> Column:
    """Number of independent sources of an array of them."""
    return F.size(F.array_distinct(F.transform(source_types, source_family)))

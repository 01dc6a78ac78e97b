"""Titles of situations: how alike two are, which are worth nothing, and when a new one may replace the old."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fusewright.functions.names import contains_any

#: Words that name a kind of situation, not one.
GENERIC_WORDS = (
    "wildfires wildfire fires fire earthquake earthquakes conflict crisis activity sequence swarm surge operations military regional multi-region impact flood floods flooding "
    "cyclone hurricane typhoon tornado tsunami volcanic eruption drought forest bushfire"
).split()
#: Words without weight, and points of the compass.
STOP_WORDS = (
    "the and for with from that this into over has are was were been have will not but its says new after amid near against "
    "middle east west north south southeast asia africa europe america americas pacific atlantic eastern western southern northern central region global"
).split()
DISASTERS = ["wildfire", "wildfires", "forest fire", "bushfire", "earthquake", "tsunami", "volcanic", "eruption", "cyclone", "hurricane", "typhoon", "tornado", "flood"]
ROUTINE = [
    "commission", "session", "summit", "conference", "assembly", "committee", "forum", "symposium", "convention", "congress", "inauguration", "election", "referendum",
    "bilateral talks", "trade deal", "trade agreement", "quarterly report", "annual meeting", "general debate", "plenary",
]
#: What a model says when it has no title.
REFUSALS = ["no relevant", "no location", "no information", "not identified", "no core situation", "no context provided", "unspecified"]
VAGUE = [
    "economic security concerns", "regional security concerns", "security tensions", "security concerns", "unspecified challenges", "face unspecified", "i cannot generate",
    "cannot generate a meaningful", "no logical connection",
]
REPEATED = ["earthquake", "wildfire", "conflict", "attack"]
OUTLETS = [
    "wall street journal", "new york times", "washington post", "reuters", "associated press", "al jazeera", "bbc", "cnn", "fox news", "msnbc", "bloomberg",
    "financial times", "the guardian", "sky news", "npr",
]
REGION_WORDS = (
    "africa asia europe americas oceania pacific arctic antarctic mediterranean balkans caucasus sahel caribbean southeast southern central latin middle east west north south "
    "eastern western northern"
).split()
ACTION_WORDS = (
    "reports report reveals says confirms warns strikes attack attacks war conflict crisis bombing explosion protests sanctions ceasefire invasion offensive siege disaster "
    "earthquake outbreak hack breach election"
).split()


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def _jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def _long_words(title: Column, without: list[str] | None = None) -> Column:
    words = F.filter(_words(F.lower(title)), lambda w: F.octet_length(w) > 2)
    if without:
        words = F.filter(words, lambda w: ~w.isin(*without))
    return F.array_distinct(words)


def title_jaccard(a: Column, b: Column) -> Column:
    """Of the different words of more than two bytes."""
    return _jaccard(_long_words(a), _long_words(b))


def title_jaccard_filtered(a: Column, b: Column) -> Column:
    """Without words that name a kind of situation."""
    return _jaccard(_long_words(a, GENERIC_WORDS), _long_words(b, GENERIC_WORDS))


def stems(title: Column) -> Column:
    """The first four letters of words that carry weight."""
    words = F.split(F.lower(title), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.octet_length(w) >= 3) & ~w.isin(*STOP_WORDS)), lambda w: F.substring(w, 1, 4)))


def title_jaccard_stemmed(a: Column, b: Column) -> Column:
    return _jaccard(stems(a), stems(b))


def is_disaster_title(title: Column) -> Column:
    return contains_any(F.lower(title), DISASTERS)


def is_routine_title(title: Column) -> Column:
    return contains_any(F.lower(title), ROUTINE)


def title_case(text: Column) -> Column:
    """The first letter of each word in upper case, the rest as it is."""
    return F.array_join(F.transform(_words(text), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def generate_title(entities: Column, topics: Column, region_name: Column) -> Column:
    """Two entities and a topic, or what there is of them and the region; region_name: null for unknown."""
    own = F.array_sort(entities)
    low = F.transform(entities, F.lower)
    topic = title_case(F.get(F.array_sort(F.filter(topics, lambda t: ~F.array_contains(low, F.lower(t)))), F.lit(0)))
    region = F.coalesce(region_name, F.lit("Unknown Region"))
    names = F.array_join(F.transform(F.slice(own, 1, 2), title_case), ", ")
    return F.when(F.size(own) > 0, F.concat(names, F.lit(" — "), F.coalesce(topic, region))).when(topic.isNotNull(), F.concat(topic, F.lit(" in "), region)).otherwise(F.concat(F.lit("Activity in "), region))


def _regions_only(words: Column) -> tuple[Column, Column]:
    return F.size(F.filter(words, lambda w: w.isin(*REGION_WORDS))), F.exists(words, lambda w: w.isin(*ACTION_WORDS))


def is_garbage_title(title: Column) -> Column:
    """Whether a title is none: a refusal, a list, a slug, a template's, an outlet with regions, regions alone, or vague."""
    low, words = F.lower(title), _words(title)
    bad = (F.trim(title) == "") | title.startswith("Country:") | title.startswith("country:") | contains_any(low, REFUSALS)
    bad = bad | (low.contains(" and ") & (F.size(words) >= 6))
    for k in REPEATED:
        bad = bad | (F.size(F.split(low, k)) > 3)
    bad = bad | (F.octet_length(title) > 60)
    prefix = F.split(title, ":")[0]
    bad = bad | (title.contains(":") & prefix.contains("-") & (F.octet_length(prefix) > 15))
    bad = bad | ((F.size(words) <= 3) & (F.length(title) - F.length(F.replace(title, F.lit("-"), F.lit(""))) >= 2))
    bad = bad | title.contains(" — ")
    parts = F.split(title, ", ")
    first, second = (F.slice(_words(F.get(parts, F.lit(i))), 1, 2) for i in (0, 1))
    bad = bad | ((F.size(parts) >= 2) & (F.size(first) == 2) & (first == second))
    before = F.trim(F.split(title, " in ", 2)[0])
    bad = bad | (low.contains(" in ") & title.contains(" in ") & ~before.contains(" ") & (F.octet_length(before) <= 20))
    for outlet in OUTLETS:
        rest = F.filter(_words(F.replace(low, F.lit(outlet), F.lit(" "))), lambda w: F.octet_length(w) >= 2)
        n, acts = _regions_only(rest)
        bad = bad | (low.contains(outlet) & (n >= 3) & ~acts)
    rest = F.filter(_words(low), lambda w: F.octet_length(w) >= 2)
    n, acts = _regions_only(rest)
    bad = bad | ((F.size(rest) >= 2) & (n / F.greatest(F.size(rest), F.lit(1)) > 0.6) & ~acts)
    return bad | contains_any(low, VAGUE)


def should_accept_title(old: Column, new: Column, children: Column, events: Column, phase: Column, severity_rank: Column) -> Column:
    """Whether a new title may replace the old: always one worth nothing; else not of settled or large situations, and of middling parents only with three tenths of the old words."""
    words, fresh = (F.array_distinct(_words(F.lower(t))) for t in (old, new))
    kept = F.size(F.array_intersect(words, fresh)) / F.greatest(F.size(words), F.lit(1))
    locked = ((phase == "active") & (severity_rank >= 3)) | phase.isin("declining", "resolved", "historical") | (children > 10) | (events > 50)
    return is_garbage_title(old) | (~locked & ~((children >= 5) & (kept < 0.3)))

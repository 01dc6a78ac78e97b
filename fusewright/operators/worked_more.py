"""Filters, searches, graphs, airspace and series on worked examples, reckoned by hand."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusewright.functions import filters, search, situation_view
from fusewright.functions.names import FLIGHTS
from fusewright.operators import graphs
from fusewright.operators.worked import expected_sql
from fusewright.rules import airspace
from fusewright.situations import tracking
from fusewright.sources import wire

c = F.col
CASES: dict[str, tuple[Callable[[SparkSession], DataFrame], str, list]] = {}


def case(name: str, columns: str, expected: list):
    def keep(f):
        CASES[name] = (f, columns, expected)
        return f

    return keep


@case("zoom_filters", "id int, least_rank int, most int", [(1, 3, 100), (2, 2, 300), (3, 2, 300), (4, 0, 500), (5, 0, 500), (6, 3, 100), (7, 0, 500)])
def _(spark):
    d = spark.createDataFrame([(1, 3.9), (2, 4.0), (3, 6.99), (4, 7.0), (5, None), (6, -5.0), (7, 99.0)], "id int, zoom double")
    rank, most = filters.zoom_filter(c("zoom"))
    return d.select("id", rank.alias("least_rank"), most.alias("most"))


@case("padded_boxes", "id int, west double, south double, east double, north double", [(1, -2.0, -4.0, 12.0, 24.0), (2, -180.0, -90.0, 180.0, 90.0), (3, 92.0, -90.0, 148.0, -48.0)])
def _(spark):
    d = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 20.0), (2, -170.0, -80.0, 170.0, 80.0), (3, 100.0, -100.0, 140.0, -55.0)], "id int, w double, s double, e double, n double")
    return d.select("id", filters.padded_box(c("w"), c("s"), c("e"), c("n")).alias("b")).select("id", "b.*")


@case("interesting_vessels", "id int, interesting boolean", [(1, True), (2, False), (3, True), (4, True), (5, False), (6, True), (7, False), (8, True)])
def _(spark):
    rows = [
        (1, "opensky", "{}", None),
        (2, "ais", "{}", 15.0),
        (3, "ais", "{}", 15.1),
        (4, "ais", '{"ship_type": "35"}', None),
        (5, "ais", '{"ship_type": 60}', None),
        (6, "ais", '{"ship_type": 89}', None),
        (7, "ais", '{"ship_type": "tanker"}', 0.0),
        (8, "ais", '{"is_military": true}', None),
    ]
    d = spark.createDataFrame(rows, "id int, source_type string, payload string, speed double")
    return d.select("id", filters.is_interesting_vessel(c("source_type"), c("payload"), c("speed")).alias("interesting"))


_KINDS = [
    (1, "conflict_event", 1, [], '{"fatalities": 1}'),
    (2, "conflict_event", 1, [], '{"fatalities": 0}'),
    (3, "seismic_event", 0, [], '{"magnitude": 4.0}'),
    (4, "flight_position", 3, [], "{}"),
    (5, "flight_position", 1, ["military"], "{}"),
    (6, "flight_position", 1, [], '{"emergency": "7700"}'),
    (7, "flight_position", 1, [], '{"emergency": "none"}'),
    (8, "vessel_position", 1, ["dark_ship"], "{}"),
    (9, "vessel_position", 1, ["x"], "{}"),
    (10, "thermal_anomaly", 2, [], "{}"),
    (11, "cert_issued", 4, [], "{}"),
    (12, "news_article", 0, [], "{}"),
]


@case(
    "event_importance",
    "id int, important boolean, routine boolean, summary_seconds int",
    [
        (1, True, False, None),
        (2, False, False, None),
        (3, True, False, None),
        (4, True, False, 30),
        (5, False, False, 30),
        (6, False, False, 30),
        (7, False, True, 30),
        (8, False, False, 30),
        (9, False, True, 30),
        (10, True, True, 60),
        (11, True, True, 60),
        (12, True, False, None),
    ],
)
def _(spark):
    d = spark.createDataFrame(_KINDS, "id int, event_type string, severity_rank int, tags array<string>, payload string")
    kind, rank = c("event_type"), c("severity_rank")
    return d.select("id", filters.is_important(kind, rank, c("payload")).alias("important"), filters.is_routine(kind, rank, c("tags"), c("payload")).alias("routine"), filters.summary_seconds(kind).alias("summary_seconds"))


@case("json_numbers", "id int, x double", [(1, 4.5), (2, 4.5), (3, None), (4, None), (5, -1000.0)])
def _(spark):
    d = spark.createDataFrame([(1, '{"m": 4.5}'), (2, '{"m": "4.5"}'), (3, '{"m": "strong"}'), (4, "{}"), (5, '{"m": "-1e3"}')], "id int, payload string")
    return d.select("id", filters.json_number(c("payload"), "$.m").alias("x"))


@case("position_tiers", "id int, tier int", [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 4)])
def _(spark):
    rows = [(1, "ais", '{"high_value": true}'), (2, "opensky", '{"military": true, "affiliation": "US"}'), (3, "ais", '{"military": true}'), (4, "ais", "{}"), (5, "opensky", '{"military": false}'), (6, "my-flight-feed", "{}")]
    d = spark.createDataFrame(rows, "id int, source_type string, payload string")
    return d.select("id", filters.position_tier(c("source_type"), c("payload"), FLIGHTS).alias("tier"))


@case("relevant_entities", "id int, kept string", [(1, "a|b|c|d|e"), (2, "Iran|Oslo|Ali Khan"), (3, "a1|a2|a3|a4|a5"), (4, "e0|e1|e2|e3|e4|e5|e6|e7")])
def _(spark):
    rows = [
        (1, ["a", "b", "c", "d", "e"], [], [], []),
        # Iran: two titles and the topic, 5; Ali Khan: both parts in titles, 1; Oslo: a region by itself, 3 - but Iran's is more.
        (2, ["Oslo", "Ali Khan", "Iran", "Lima", "Rome", "Kiel"], ["Iran talks", "Iran says Ali met Khan"], ["iran-deal"], ["oslo"]),
        (3, ["a1", "a2", "a3", "a4", "a5", "a6"], [], [], []),
        (4, [f"e{i}" for i in range(9, -1, -1)], [" ".join(f"e{i}" for i in range(10))], [], []),
    ]
    d = spark.createDataFrame(rows, "id int, entities array<string>, titles array<string>, topics array<string>, regions array<string>")
    return d.select("id", F.array_join(search.relevant_entities(c("entities"), c("titles"), c("topics"), c("regions")), "|").alias("kept"))



@case("search_queries", "id int, query string", [(1, "wagner group mali bamako drone strike"), (2, "Some AI Title"), (3, ""), (4, "mali Some AI Title"), (5, "a b mali talks"), (6, "a b mali talks")])
def _(spark):
    rows = [
        (1, ["mali", "wagner group"], ["drone-strike"], ["Mali", "bamako"]),
        (2, [], [], []),
        (3, [], [], ["africa"]),
        (4, ["mali"], [], []),
        (5, ["a b"], ["talks"], ["mali", "europe"]),
        (6, ["mali", "a b"], ["talks"], ["mali", "europe"]),
    ]
    d = spark.createDataFrame(rows, "id int, entities array<string>, topics array<string>, regions array<string>")
    return d.select("id", search.search_query(F.lit("Some AI Title"), c("entities"), c("topics"), c("regions")).alias("query"))



@case(
    "information_gaps",
    "id int, gaps string, priority int",
    [
        (1, "news_coverage:0.9 corroboration:0.65 entity_background:0.35", 69),
        (2, "ground_verification:0.6 regional_context:0.4", 34),
        (3, "", 0),
        (4, "stale_context:0.85", 43),
        (5, "stale_context:0.7 entity_background:0.5", 8),
    ],
)
def _(spark):
    kind = "id int, sources array<string>, severity_rank int, events int, entities array<string>, enriched boolean, placed boolean, regions array<string>, age int, searched map<string,int>, minutes int, last int, searches int, empty int"
    rows = [
        # 40 + 4 + 15 + 10 events an hour, no search yet.
        (1, ["acled"], 4, 10, ["x"], False, False, [], None, {}, 60, None, 0, 0),
        # 15 + 8 + 10 + 1: two sources of news.
        (2, ["gdelt", "rss-news"], 2, 2, [], False, True, ["ME"], None, {"corroboration": 1}, 120, None, 0, 0),
        (3, ["acled", "gdelt"], 4, 99, ["x"], True, True, ["ME"], 100, {}, 60, None, 0, 0),
        # 40 + 8 + 5 + 10 less 20 for a search of 10 minutes ago, and 10 events an hour at most.
        (4, ["acled", "gdelt"], 4, 99, ["x"], True, True, ["ME"], 1800, {"news_coverage": 10}, 60, 10, 2, 2),
        # 0 + 12 + 10 + 1 less 15: most searches found nothing.
        (5, ["acled", "gdelt", "ais"], 0, 1, ["x", "y", "z"], False, True, ["ME"], 10800, {"stale_context": 15, "entity_background": 120}, 60, 40, 4, 3),
    ]
    x = spark.createDataFrame(rows, kind)
    x = x.withColumn("g", search.gaps(*(c(n) for n in ("sources", "severity_rank", "events", "entities", "enriched", "placed", "regions", "age", "searched"))))
    priority = search.search_priority(c("severity_rank"), c("sources"), F.size("g"), c("events"), c("minutes"), c("last"), c("searches"), c("empty"))
    return x.select("id", F.array_join(F.transform("g", lambda y: F.concat_ws(":", y["type"], y["weight"].cast("string"))), " ").alias("gaps"), priority.alias("priority"))



@case("texts_due", "id int, narrative boolean, summary boolean", [(1, True, False), (2, True, True), (3, False, False), (4, True, True), (5, False, True), (6, True, True)])
def _(spark):
    rows = [
        (1, 0, False, False, 0, None, 9, 0, None),
        (2, 1, True, False, 0, 1, 10, 0, None),
        (3, 1, False, False, 29, 119, 59, 10, 5.9),
        (4, 1, False, False, 10, 120, 60, 10, 0.1),
        (5, 1, False, False, 9, 500, 20, 15, 6.0),
        (6, 1, False, False, 30, 1, 99, 0, 0.0),
    ]
    d = spark.createDataFrame(rows, "id int, version int, changed boolean, escalated boolean, since int, minutes int, events int, events_then int, hours double")
    return d.select("id", search.narrative_due(c("version"), c("changed"), c("escalated"), c("since"), c("minutes")).alias("narrative"), search.summary_due(c("events"), c("events_then"), c("hours")).alias("summary"))


@case("situation_ranks", "id int, score long", [(1, 40000 + 8000 + 1500 + 100 + 500 + 500 + 450), (2, 10000 + 2000 + 800 + 0 + 100 + 0 + 0), (3, 20000 + 4000 + 0 + 60 - 200 + 50 + 250), (4, 4000 + 300)])
def _(spark):
    rows = [(1, 4, 7, 0.5, 10, "active", 12, 0.9), (2, 1, 1, 1.0, 0, None, 0, None), (3, 2, 2, 6.0, 4, "declining", 1, 0.5), (4, 0, 2, 5.9, 1, "resolved", 0, 0.0)]
    d = spark.createDataFrame(rows, "id int, severity_rank int, sources int, hours double, events int, phase string, children int, certainty double")
    return d.select("id", situation_view.situation_score(*(c(n) for n in ("severity_rank", "sources", "hours", "events", "phase", "children", "certainty"))).alias("score"))


@case("primary_regions", "id int, region string", [(1, "global"), (2, "middle-east"), (3, "middle-east"), (4, "sub-saharan-africa"), (5, "global"), (6, "africa"), (7, "UA")])
def _(spark):
    rows = [
        (1, [], "Iran War"),
        (2, ["IR", "middle-east"], "China visit"),
        (3, ["middle-east", "east-asia"], "Iran and China talk"),
        (4, ["middle-east", "east-asia"], "Sahel coup"),
        (5, ["a-b", "c-d", "e-f", "g-h"], "Quiet"),
        (6, ["africa", "asia"], None),
        (7, ["UA", "RU"], "Quiet"),
    ]
    d = spark.createDataFrame(rows, "id int, codes array<string>, title string")
    return d.select("id", situation_view.primary_region(c("codes"), c("title")).alias("region"))


_EDGES = [("a", "b", "leads"), ("c", "a", "owns"), ("b", "d", "allied"), ("d", "a", "near"), ("d", "e", "near"), ("e", "f", "near"), ("a", "a", "self")]


def _edges(spark):
    return spark.createDataFrame(_EDGES, "source string, target string, relationship string")


@case("graph_neighbours", "id string, relationship string, direction string", [("b", "leads", "outgoing"), ("a", "self", "outgoing"), ("a", "self", "incoming"), ("c", "owns", "incoming"), ("d", "near", "incoming")])
def _(spark):
    return graphs.neighbours(_edges(spark), "a")


@case("graph_reach", "id string, hops int, path string", [("b", 1, "leads"), ("c", 1, "owns"), ("d", 1, "near"), ("e", 2, "near>near")])
def _(spark):
    return graphs.reach(_edges(spark), "a", 2).select("id", "hops", F.array_join("path", ">").alias("path"))


def _impact(spark):
    kinds = [("a", "A", "person"), ("b", "Plant", "facility"), ("c", "Ann", "person"), ("d", "Port", "location"), ("e", "Fleet", "military_unit"), ("f", "Far", "location")]
    return graphs.impact(_edges(spark), spark.createDataFrame(kinds, "id string, name string, type string"), "a", 2)


@case("graph_impact", "id string, name string, hops int, impact double", [("b", "Plant", 1, 0.5), ("d", "Port", 1, 0.5), ("e", "Fleet", 2, 0.25)])
def _(spark):
    return _impact(spark).select("id", "name", "hops", "impact")


@case("graph_impact_summary", "summary string", [("Directly affects: Plant (facility), Port (location). Secondary impact: Fleet (military_unit).",)])
def _(spark):
    return graphs.impact_summary(_impact(spark))


@case("graph_drawn", "a string, b string, relationship string", [("a", "b", "leads"), ("a", "c", "owns"), ("a", "d", "near"), ("b", "d", "allied"), ("d", "e", "near"), ("e", "f", "near")])
def _(spark):
    return graphs.drawn_edges(_edges(spark).union(spark.createDataFrame([("b", "a", "leads")], "source string, target string, relationship string")))


@case("tree_descendants", "id string, depth int", [("b", 1), ("c", 1), ("d", 2), ("e", 3)])
def _(spark):
    tree = [("a", None), ("b", "a"), ("c", "a"), ("d", "b"), ("e", "d"), ("x", "y"), ("y", "x"), ("a", "e")]
    return graphs.descendants(spark.createDataFrame(tree, "id string, parent_id string"), "a")


@case("entity_state_changes", "id string, change string, certainty string, previous string", [("e1", "killed", "confirmed", "alive"), ("e1", "arrested", "alleged", None)])
def _(spark):
    mentions = [("Ann", "alive", "Killed", "Confirmed"), ("Ann", None, "arrested", None), ("Ann", None, "promoted", None), ("Bob", None, "killed", None)]
    return graphs.state_changes(spark.createDataFrame(mentions, "entity string, from string, to string, certainty string"), spark.createDataFrame([("e1", "Ann")], "id string, name string"), {"killed": "killed", "dead": "killed", "arrested": "arrested"})


@case("latest_narratives", "sid string, version int, text string", [("s1", 3, "new"), ("s2", None, None)])
def _(spark):
    n = spark.createDataFrame([("s1", 1, "old"), ("s1", 3, "new"), ("s1", 2, "mid"), ("s9", 1, "other")], "sid string, version int, text string")
    return graphs.with_latest_narrative(spark.createDataFrame([("s1",), ("s2",)], "sid string"), n).select("sid", "version", "text")


@case("source_states", "source_id string, enabled boolean, status string, failures int", [("a", False, "healthy", 0), ("b", True, "error", 4), ("c", True, "unknown", 0)])
def _(spark):
    of = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    config, health = of([("a", False), ("gone", True)], "source_id string, enabled boolean"), of([("a", "healthy", 0), ("b", "error", 4)], "source_id string, status string, failures int")
    return graphs.source_states(config, health, of([("a", "A"), ("b", "B"), ("c", "C")], "source_id string, name string")).drop("name")


def _sky(spark):
    p = lambda *xy: [{"lat": float(a), "lon": float(b)} for a, b in xy]
    zones = [
        ("square", "prohibited", [p((0, 0), (0, 3), (3, 3), (3, 0)), p((1, 1), (1, 2), (2, 2), (2, 1))]),
        ("triangle", "restricted", [p((0.5, 0), (0.5, 6), (5, 3))]),
        ("line", "danger", [p((0, 0), (9, 9))]),
    ]
    flights = [(1, 100, 0.2, 0.2, 1, ["x"]), (2, 100, 1.5, 1.5, 1, []), (3, 100, 1.0, 3.5, 1, []), (4, 100, 0.9, 2.5, 4, []), (5, 100, 40.0, 40.0, 1, []), (6, 100, None, None, 1, [])]
    notices = [("near", 40.0, 40.1, 10.0, 0, 200), ("past", 40.0, 40.0, 10.0, 0, 99), ("open", 40.0, 40.0, 10.0, -86_300, None), ("over", 40.0, 40.0, 10.0, -86_301, None), ("far", 40.0, 40.3, 10.0, 0, 200)]
    return (
        spark.createDataFrame(flights, "event_id long, t long, lat double, lon double, severity_rank int, tags array<string>"),
        spark.createDataFrame(zones, "zone_id string, kind string, rings array<array<struct<lat:double,lon:double>>>"),
        spark.createDataFrame(notices, "notice_id string, lat double, lon double, radius_nm double, start long, end long"),
    )


@case("flights_in_zones", "event_id long, zone_id string", [(1, "square"), (2, "triangle"), (3, "triangle"), (4, "square"), (4, "triangle")])
def _(spark):
    flights, zones, _ = _sky(spark)
    return airspace.in_zones(flights, zones).select("event_id", "zone_id")


@case("flights_under_notices", "event_id long, notice_id string", [(5, "near"), (5, "open")])
def _(spark):
    flights, _, notices = _sky(spark)
    return airspace.in_notices(flights, notices)


@case("flights_annotated", "event_id long, severity_rank int, tags string", [(1, 3, "airspace-prohibited|x"), (2, 2, "airspace-restricted"), (3, 2, "airspace-restricted"), (4, 4, "airspace-prohibited"), (5, 1, "notam-active"), (6, 1, "")])
def _(spark):
    return airspace.annotated(*_sky(spark)).select("event_id", "severity_rank", F.array_join(F.array_sort("tags"), "|").alias("tags"))


@case("airspace_zones", "zone_id string, kind string, country string, rings int, first_lat double", [("P1", "prohibited", "XX", 2, 2.0), ("R1", "restricted", "IR", 2, 5.0)])
def _(spark):
    ring = lambda x, y: [[x, y], [x + 1, y], [x, y + 1], [x, y]]
    zone = lambda name, kind, country, shape, xy: {"type": "Feature", "properties": {"designator": name, "name": name, "type": kind, "country": country}, "geometry": {"type": shape, "coordinates": xy}}
    features = [
        zone("P1", "PROHIBITED", "XX", "Polygon", [ring(1, 2), ring(1.1, 2.1)]),
        zone("R1", "restricted", "IR", "MultiPolygon", [[ring(4, 5)], [ring(8, 9)]]),
        zone("R2", "restricted", "BR", "Polygon", [ring(0, 0)]),
        zone("W1", "warning", "IR", "Polygon", [ring(0, 0)]),
        zone("D1", "danger", "IR", "Point", [0, 0]),
    ]
    out = airspace.zones_of(_bodies(spark, json.dumps({"type": "FeatureCollection", "features": features}), "not json"))
    return out.select("zone_id", "kind", "country", F.size("rings").alias("rings"), F.expr("rings[0][0].lat").alias("first_lat"))


@case("news_filters", "id int, middle_east boolean, ukraine boolean, cyber boolean, every boolean", [(1, True, False, True, True), (2, False, True, False, True), (3, False, False, False, True), (4, False, False, False, False), (5, True, False, False, True)])
def _(spark):
    rows = [
        (1, "news_article", '{"title": "Zero-day in use", "region": "Middle East"}'),
        (2, "news_article", '{"title": "Gaza", "enrichment": {"translated_title": "Talks", "topics": ["kursk"]}}'),
        (3, "news_article", "{}"),
        (4, "geo_news", '{"title": "Gaza"}'),
        (5, "news_article", '{"url": "https://n/iran/1"}'),
    ]
    d = spark.createDataFrame(rows, "id int, event_type string, payload string")
    of = lambda n: situation_view.in_news_filter(c("event_type"), c("payload"), n)
    return d.select("id", of("middle_east").alias("middle_east"), of("ukraine").alias("ukraine"), of("cyber").alias("cyber"), of("all").alias("every"))


@case("wire_bases", "name string, type string, country string, region string, lat double", [("North", "airfield", "XX", "a", 1.00001), ("", "base", "", "a", 2.0), ("Fort", "barracks", "YY", "b", 3.0)])
def _(spark):
    element = lambda kind, lat, tags, **more: {"type": kind, "lat": lat, "lon": 5.0, "tags": tags, **more}
    one = [element("node", 1.000011, {"name:en": "North", "military": "yes", "aeroway": "aerodrome", "country": "XX"}), element("node", 2.0, {}), element("way", 9.0, {"name": "No centre"})]
    two = [element("node", 1.000009, {"name": "Again"}), element("way", None, {"name": "Fort", "military": "barracks", "addr:country": "YY"}, center={"lat": 3.0, "lon": 5.0})]
    rows = [(json.dumps({"elements": one}), "a"), (json.dumps({"elements": two}), "b")]
    return wire.bases(spark.createDataFrame(rows, "body string, region string")).select("name", "type", "country", "region", "lat")


@case("burst_scores", "topic string, ratio double, anomaly double", [("again", 52.1907, 1.0), ("first", 1.0, 0.0)])
def _(spark):
    # The second event adds half to the short rate and a hundredth to the long one; what was seen once, at the start, is next to nothing.
    rows = [(1, 0.0, "first"), (1, 0.0, "again"), (2, 300.0, "again")]
    return tracking.burst_scores(spark.createDataFrame(rows, "n long, t double, topic string")).select("topic", F.round("ratio", 4).alias("ratio"), "anomaly")


@case("ewma_centroids", "sid string, vector string", [("a", "0.81 0.1 0.09"), ("b", "1.0 2.0 3.0")])
def _(spark):
    rows = [("a", 1, [1.0, 0.0, 0.0]), ("a", 3, [0.0, 1.0, 0.0]), ("a", 2, [0.0, 0.0, 1.0]), ("b", 7, [1.0, 2.0, 3.0])]
    out = tracking.ewma_centroids(spark.createDataFrame(rows, "sid string, n long, vector array<double>"))
    return out.select("sid", F.array_join(F.transform("vector", lambda x: F.round(x, 9).cast("string")), " ").alias("vector"))


@case("live_rejections", "a string, b string", [("p", "q"), ("r", "s")])
def _(spark):
    rows = [("q", "p", 6_400), ("p", "q", 100), ("s", "r", 10_000), ("t", "u", 6_399)]
    return tracking.live_rejections(spark.createDataFrame(rows, "a string, b string, t long"), 10_000)


@case("nearest_vectors", "id long, similarity double", [(1, 1.0), (4, 1.0), (2, 0.8)])
def _(spark):
    rows = [(1, [2.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0]), (4, [1.0, 0.0]), (5, [0.0, 0.0])]
    return tracking.nearest(spark.createDataFrame(rows, "id long, vector array<double>"), [3.0, 0.0], 5, 0.5).select("id", F.round("similarity", 9).alias("similarity"))


def _bodies(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "body string")


@case(
    "wire_opensky",
    "source_id string, entity_name string, severity string, region_code string, latitude double, tags string",
    [("ae01", "RCH12", "medium", "western-europe", 50.0, "military"), ("3c6f", None, "low", "oceania", -30.5, "")],
)
def _(spark):
    states = [
        ["ae01", "RCH12  ", "United States", 1, 2, 10.0, 50.0, 900.0, False, 200.5, 90, 0, None, 950.0, "7700"],
        ["3c6f", "", "Germany", 1, 2, "150", "-30.5", None, True, None, None, None, None, None, None],
        ["none", "X", "Y", 1, 2, None, 50.0, 900.0, False, 200.5, 90, 0, None, 950.0, "7700"],
        ["short", "X", "Y", 1, 2, 10.0, 50.0],
    ]
    out = wire.opensky(_bodies(spark, json.dumps({"time": 1, "states": states}), '{"states": null}', "not json"))
    return out.select("source_id", "entity_name", "severity", "region_code", "latitude", F.array_join("tags", "|").alias("tags"))


@case(
    "wire_bgp",
    "entity_id string, title string, region_code string, time_s long",
    [
        ("AS12880", "BGP withdrawal: AS12880 prefix 10.0.0.0/8", "middle-east", 1000),
        ("AS12880", "BGP withdrawal: AS12880 prefix 10.0.0.0/8", "middle-east", 1300),
        ("AS12880", "BGP withdrawal: AS12880 prefix 11.0.0.0/8", "middle-east", 1000),
        ("AS12389", "BGP withdrawal: AS12389 prefix 12.0.0.0/8", "eastern-europe", 1000),
    ],
)
def _(spark):
    def message(at, peer, path, prefixes, kind="ris_message"):
            return json.dumps({"type": kind, "data": {"timestamp": at, "peer": "p", "peer_asn": peer, "host": "h", "path": path, "withdrawals": prefixes}})

    rows = [
        message(1000, "12880", [12389], ["10.0.0.0/8", "11.0.0.0/8"]),
        message(1100, "12880", [], ["10.0.0.0/8"]),  # again within the window
        message(1300, "12880", [], ["10.0.0.0/8"]),
        message(1000, "7", [1, 12389, 12880], ["12.0.0.0/8"]),
        message(1000, "7", [1, 2], ["13.0.0.0/8"]),  # not monitored
        message(1000, "12880", [], ["14.0.0.0/8"], "ris_error"),
    ]
    out = wire.bgp_withdrawals(_bodies(spark, *rows), spark.createDataFrame([(12880, "IR"), (12389, "RU")], "asn long, country string"))
    return out.select("entity_id", "title", "region_code", F.unix_seconds("event_time").alias("time_s"))


@case(
    "wire_rss",
    "source_id string, title string, time_s long, latitude double, tags string",
    [("https://n/1", "Missile & drone attack", 1704110400, 27.0, "source:Paper|fr"), ("https://n/4", "Border talks", 1704110400, 27.0, "source:Paper|fr")],
)
def _(spark):
    feed = """<rss><channel><title>Paper</title>
<item><title><![CDATA[Missile &amp; drone attack]]></title><link>https://n/1</link><pubDate>Mon, 01 Jan 2024 07:00:00 EST</pubDate></item>
<item><title>Football coup</title><link>https://n/2</link></item>
<item><title>Quiet day</title><link>https://n/3</link></item>
<item><title>BBC: Iran, Iraq and Syria war </title><link>https://n/5</link></item>
<entry xml:lang="en"><title>Border talks</title><link rel="alternate" href="https://n/4"/><updated>2024-01-01T12:00:00Z</updated></entry></channel></rss>"""
    rows = spark.createDataFrame([(feed, "Paper", "fr", "ME")], "body string, source_name string, language string, region string")
    return wire.rss(rows).select("source_id", "title", F.unix_seconds("event_time").alias("time_s"), "latitude", F.array_join("tags", "|").alias("tags"))


@case("parsed_times", "id int, time_s long", [(1, 1704110400), (2, 1704110400), (3, 1704110400), (4, 1704110400), (5, None), (6, 1704106800)])
def _(spark):
    texts = ["Mon, 01 Jan 2024 12:00:00 GMT", "1 Jan 2024 07:00:00 -0500", "Mon, 1 Jan 2024 04:00 PST", "2024-01-01T12:00:00Z", "yesterday", "2024-01-01T12:00:00+01:00"]
    d = spark.createDataFrame([*enumerate(texts, 1)], "id int, text string")
    return d.select("id", F.unix_seconds(wire.parse_time(c("text"))).alias("time_s"))


@case("wire_usgs", "source_id string, title string, severity string, region_code string, time_s long, depth string", [("us1", "M6.1 - 10 km S of Oslo", "critical", "western-europe", 1704110400, "9.5"), ("us2", "M2.0 - Unknown", "low", "global", 1704110400, None)])
def _(spark):
    quake = lambda i, mag, place, xyz: {"id": i, "properties": {"mag": mag, "place": place, "time": 1704110400000, "type": "earthquake"}, "geometry": {"coordinates": xyz}}
    body = {"features": [quake("us1", 6.1, "10 km S of Oslo", [10.0, 59.0, 9.5]), quake("us2", 2.0, None, [-30.0, 0.0]), quake("us2", 2.0, None, [-30.0, 0.0]), quake("us3", None, "x", [1.0, 2.0, 3.0])]}
    out = wire.usgs(_bodies(spark, json.dumps(body)))
    return out.select("source_id", "title", "severity", "region_code", F.unix_seconds("event_time").alias("time_s"), F.get_json_object("payload", "$.depth").alias("depth"))


@case("replayed_lines", "event_id long, title string, tags string", [(1, "a", "x|y"), (2, None, "")])
def _(spark):
    d = spark.createDataFrame([(1, "a", ["x", "y"]), (2, None, [])], "event_id long, title string, tags array<string>")
    lines = wire.exported(d).union(spark.createDataFrame([(None,)], "line string"))
    return wire.imported(lines, d.schema).select("event_id", "title", F.array_join("tags", "|").alias("tags"))


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return CASES[name][0](spark)


def frames() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: partial(run, name=n) for n in CASES}


def oracle() -> dict[str, str]:
    return {n: expected_sql(columns, rows) for n, (_, columns, rows) in CASES.items()}

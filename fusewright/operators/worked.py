"""Operators on worked examples: small rows, the operator applied to them, and what must come out, reckoned by hand.

The operators themselves are in functions/ and situations/ and take any table; the rows here are those that show
each of their rules. The SQL check gets the expected rows as they stand.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusewright.functions import lifecycle as L
from fusewright.functions import names as N
from fusewright.functions import regions as R
from fusewright.functions import titles as T

c = F.col
#: name: (DDL of the rows, rows, what becomes of them, columns expected, expected rows).
CASES: dict[str, tuple[str, list, Callable[[DataFrame], DataFrame], str, list]] = {}


def case(name: str, ddl: str, rows: list, columns: str, expected: list):
    def keep(f):
        CASES[name] = (ddl, rows, f, columns, expected)
        return f

    return keep


@case(
    "region_functions",
    "id int, lat double, lon double, code string, name string, given string",
    [
        (1, 33.0, 44.0, "iq", "Iraq", "ME"),
        (2, 50.0, 30.0, "ru", "Russia", "UA"),
        (3, 50.0, 22.0, "FR", "France", "WE"),
        (4, 20.0, 105.0, "VN", "Vietnam", "east_asia"),
        (5, 10.0, 20.0, "SD", "Sudan", "AF"),
        (6, 12.0, 20.0, "XX", "Nowhere", "narnia"),
        (7, 70.0, 100.0, "", "", "SA"),
        (8, 10.0, -80.0, "BR", "Brazil", "LA"),
        (9, 10.0, -90.0, "GT", "Guatemala", "central_america"),
        (10, -30.0, 150.0, "AU", "Australia", "AU"),
        (11, 50.0, 60.0, "KZ", "Kazakhstan", "KZ"),
        (12, None, None, "ua", "ukraine", None),
        (13, 20.0, 0.0, "ly", "Libya", "north_africa"),
        (14, 60.0, -100.0, "US", "Japan", "US"),
        (15, 10.0, 80.0, "jp", "Qatar", "IN"),
        (16, -5.0, 120.0, "ph", "Taiwan", "TH"),
    ],
    "id int, by_coords string, by_code string, by_name string, canonical string, center_lat double",
    [
        (1, "middle-east", "middle-east", "middle-east", "middle-east", 27.0),
        (2, "eastern-europe", "eastern-europe", "eastern-europe", "eastern-europe", 48.5),
        (3, "eastern-europe", None, None, "western-europe", 48.0),
        (4, "east-asia", "southeast-asia", "southeast-asia", "east-asia", 35.0),
        (5, "africa", "africa", "africa", "africa", 8.0),
        (6, "global", None, None, "narnia", None),
        (7, "arctic", None, None, "south-asia", 25.0),
        (8, "south-america", None, None, "south-america", -15.0),
        (9, "central-america", None, None, "central-america", 15.0),
        (10, "oceania", None, None, "oceania", -25.0),
        (11, "central-asia", None, None, "central-asia", 42.0),
        (12, None, "eastern-europe", None, None, None),
        (13, "north-africa", "africa", "africa", "north-africa", 28.0),
        (14, "north-america", None, "east-asia", "north-america", 40.0),
        (15, "south-asia", "east-asia", "middle-east", "south-asia", 25.0),
        (16, "southeast-asia", "southeast-asia", "east-asia", "southeast-asia", 15.0),
    ],
)
def _(d):
    canonical = R.normalize_region(c("given"))
    return d.select("id", R.region_from_coords(c("lat"), c("lon")).alias("by_coords"), R.region_for_country(c("code")).alias("by_code"), R.region_for_country_name(c("name")).alias("by_name"), canonical.alias("canonical"), R.region_center(canonical)[0].alias("center_lat"))


@case(
    "coordinate_reliability",
    "id int, event_type string, lat double, lon double",
    [
        (1, "conflict_event", 27.005, 44.0),
        (2, "conflict_event", 27.03, 44.0),
        (3, "conflict_event", 33.40, 44.40),
        (4, "conflict_event", 33.50, 44.40),
        (5, "seismic_event", 0.005, -0.005),
        (6, "news_article", 10.0, 10.0),
        (7, "thermal_anomaly", 10.0, 10.0),
        (8, "conflict_event", None, None),
    ],
    "id int, center boolean, near_center boolean, placeholder boolean, null_island boolean, usable boolean",
    [
        (1, True, True, False, False, False),
        (2, False, True, False, False, True),
        (3, False, False, True, False, False),
        (4, False, False, False, False, True),
        (5, False, False, False, True, False),
        (6, False, False, False, False, False),
        (7, False, False, False, False, True),
        (8, None, None, None, None, False),
    ],
)
def _(d):
    lat, lon = c("lat"), c("lon")
    return d.select("id", R.is_region_center(lat, lon).alias("center"), R.is_region_center(lat, lon, 0.05).alias("near_center"), R.is_placeholder(lat, lon).alias("placeholder"), R.is_null_island(lat, lon).alias("null_island"), R.usable_coordinates(c("event_type"), lat, lon).alias("usable"))


@case(
    "place_names",
    "id int, name string",
    [(1, "Babil Governorate"), (2, " Kherson Oblast"), (3, "Gaza Strip"), (4, "Hasakah Province District"), (5, "Quito"), (6, "City City")],
    "id int, place string",
    # The words come off in one order: district is taken before province can be at the end again.
    [(1, "babil"), (2, "kherson"), (3, "gaza"), (4, "hasakah province"), (5, "quito"), (6, "city")],
)
def _(d):
    return d.select("id", R.place_name(c("name")).alias("place"))


@case(
    "normalized_entities",
    "id int, name string",
    [(1, " Acme Corp "), (2, "US"), (3, "U.S."), (4, "Al-Shabaab_Movement"), (5, "Siemens AG"), (6, "Foo Holdings Ltd Inc"), (7, "Hizballah"), (8, "Total S.A."), (9, "Texas"), (10, "North-Korea"), (11, "Hamas Movement!"), (12, "DRC;")],
    "id int, entity string",
    [
        (1, "acme"),
        (2, "united states"),
        (3, "u.s"),
        (4, "al shabaab movement"),
        (5, "siemens"),
        (6, "foo holdings ltd"),
        (7, "hezbollah"),
        (8, "total"),
        (9, "texas"),
        (10, "democratic people's republic of korea"),
        (11, "hamas"),
        (12, "democratic republic of the congo"),
    ],
)
def _(d):
    return d.select("id", N.normalize_entity(c("name")).alias("entity"))


_EVENT = "id int, event_type string, source_type string, entity_name string, tags array<string>, payload string"
_EVENTS = [
    (1, "conflict_event", "acled", "Wagner Group", ["actor: Ukraine ", "topic:shelling", "Russian", "query:x", "ab"], '{"enrichment": {"entities": [{"name": "NATO"}, {"name": "  "}], "topics": ["regional-war", "frontline", "drones", "fourth"]}}'),
    (2, "flight_position", "adsb-fi", "RCHA123", ["military"], "{}"),
    (3, "geo_event", "geoconfirmed", None, ["Sudan-War", "topic: el fasher"], '{"conflict": " Sudan "}'),
    (4, "shodan_banner", "shodan", "Big Host", ["ics"], '{"org": "big host"}'),
    (5, "internet_outage", "ioda", "Zain Telecom", ["outage", "country:IQ"], "{}"),
    (6, "news_article", "rss-news", "Zain Telecom", ["music", "source:x"], "{}"),
    (7, "news_article", "rss-news", "Reuters", ["actor:BBC", "actor:EU"], None),
    (8, "news_article", "gdelt", "Yemen", [], '{"enrichment": {"entities": [{"name": "a1b"}, {"name": "a2b"}, {"name": "a3b"}, {"name": "a4b"}, {"name": "a5b"}, {"name": "a6b"}]}}'),
]


@case(
    "extracted_entities",
    _EVENT,
    _EVENTS,
    "id int, entities string",
    [(1, "north atlantic treaty organization|ukraine|wagner group"), (2, ""), (3, "sudan"), (4, ""), (5, "zain telecom"), (6, ""), (7, ""), (8, "a1b|a2b|a3b|a4b|a5b|yemen")],
)
def _(d):
    return d.select("id", F.array_join(N.extract_entities(c("event_type"), c("source_type"), c("entity_name"), c("tags"), c("payload")), "|").alias("entities"))


@case(
    "extracted_topics",
    _EVENT,
    _EVENTS,
    "id int, topics string",
    [(1, "drones|frontline|shelling"), (2, ""), (3, "el fasher|sudan-war"), (4, "ics"), (5, "country:iq|outage"), (6, ""), (7, ""), (8, "")],
)
def _(d):
    return d.select("id", F.array_join(N.extract_topics(c("event_type"), c("tags"), c("payload")), "|").alias("topics"))


@case(
    "topic_kinds",
    "id int, topic string",
    [(1, "Drone-Strike"), (2, "Fires"), (3, "campfire"), (4, "wildfire-smoke"), (5, "peace-summit"), (6, "award-winning"), (7, "culture")],
    "id int, conflict boolean, disaster boolean, routine boolean",
    [(1, True, False, False), (2, False, True, False), (3, False, False, False), (4, False, True, False), (5, False, False, True), (6, True, False, True), (7, False, False, False)],
)
def _(d):
    t = c("topic")
    return d.select("id", N.is_conflict_topic(t).alias("conflict"), N.is_disaster_topic(t).alias("disaster"), N.is_routine_topic(t).alias("routine"))


@case(
    "source_diversity",
    "id int, sources array<string>",
    [(1, ["gdelt", "rss-news", "gdelt-geo"]), (2, ["adsb-fi", "opensky", "gdelt"]), (3, ["gdacs", "copernicus", "usgs"]), (4, []), (5, ["acled", "ais", "otx"])],
    "id int, diversity int",
    [(1, 1), (2, 2), (3, 2), (4, 0), (5, 3)],
)
def _(d):
    return d.select("id", N.source_diversity(c("sources")).alias("diversity"))


@case(
    "title_likeness",
    "id int, a string, b string",
    [
        (1, "Central Israel Rocket Alerts", "Israel Central Rocket Alerts"),
        (2, "Thailand Wildfires", "Central Africa Wildfires"),
        (3, "Iran War", "Iranian Spy Ring"),
        (4, "", "Anything At All"),
        (5, "Red Sea Shipping Attacks", "Red Sea shipping attacks resume"),
    ],
    "id int, plain double, filtered double, stemmed double",
    [(1, 1.0, 1.0, 1.0), (2, 0.25, 0.0, 0.5), (3, 0.0, 0.0, 0.25), (4, 0.0, 0.0, 0.0), (5, 0.8, 0.8, 0.8)],
)
def _(d):
    return d.select("id", *(f(c("a"), c("b")).alias(n) for n, f in (("plain", T.title_jaccard), ("filtered", T.title_jaccard_filtered), ("stemmed", T.title_jaccard_stemmed))))


@case(
    "garbage_titles",
    "id int, title string",
    [
        (1, "  "),
        (2, "Country:afghanistan: unrest"),
        (3, "No relevant situation found"),
        (4, "Israel and Lebanon Border Conflict"),
        (5, "Floods and Storms Hit the Coast Again"),
        (6, "Earthquake: Earthquake In Chile, Earthquake In Peru"),
        (7, "A" * 61),
        (8, "afghanistan-cultural-expression: more"),
        (9, "Eu-terror-designations"),
        (10, "Cross-border Raid"),
        (11, "Idf — Gaza"),
        (12, "Quake In Chile, Quake In Peru"),
        (13, "Protests in Georgia"),
        (14, "Mass Protests in Georgia"),
        (15, "Wall Street Journal Africa Middle East Europe"),
        (16, "Reuters reports Africa Asia Europe"),
        (17, "Southeast Asia Europe"),
        (18, "Middle East War"),
        (19, "Growing security concerns"),
        (20, "Red Sea Shipping Attacks"),
    ],
    "id int, garbage boolean",
    [(i, i not in (4, 10, 14, 16, 18, 20)) for i in range(1, 21)],
)
def _(d):
    return d.select("id", T.is_garbage_title(c("title")).alias("garbage"))


@case(
    "title_changes",
    "id int, old string, new string, children int, events int, phase string, severity_rank int",
    [
        (1, "Protests in Georgia", "Tbilisi Street Protests", 99, 999, "active", 4),
        (2, "Tbilisi Street Protests", "Georgian Unrest", 0, 5, "active", 3),
        (3, "Tbilisi Street Protests", "Georgian Unrest", 0, 5, "active", 2),
        (4, "Tbilisi Street Protests", "Georgian Unrest", 0, 5, "declining", 0),
        (5, "Tbilisi Street Protests", "Georgian Unrest", 0, 51, "emerging", 0),
        (6, "Tbilisi Street Protests", "Georgian Unrest", 11, 5, "emerging", 0),
        (7, "Tbilisi Street Protests", "Georgian Unrest", 5, 5, "developing", 0),
        (8, "Tbilisi Street Protests", "Georgian Protests", 5, 5, "developing", 0),
        (9, "Tbilisi Street Protests", "Georgian Unrest", 4, 50, "developing", 4),
    ],
    "id int, accepted boolean",
    [(1, True), (2, False), (3, True), (4, False), (5, False), (6, False), (7, False), (8, True), (9, True)],
)
def _(d):
    return d.select("id", T.should_accept_title(*(c(n) for n in ("old", "new", "children", "events", "phase", "severity_rank"))).alias("accepted"))


@case(
    "generated_titles",
    "id int, entities array<string>, topics array<string>, region string",
    [(1, ["wagner group", "mali"], ["mali", "coup attempt"], "Mali"), (2, ["mali"], ["Mali"], "Mali"), (3, [], ["coup", "arrests"], None), (4, [], [], "Chad"), (5, ["z", "b", "a"], [], None)],
    "id int, title string",
    [(1, "Mali, Wagner Group — Coup Attempt"), (2, "Mali — Mali"), (3, "Arrests in Unknown Region"), (4, "Activity in Chad"), (5, "A, B — Unknown Region")],
)
def _(d):
    return d.select("id", T.generate_title(c("entities"), c("topics"), c("region")).alias("title"))


@case(
    "gap_tolerances",
    "id int, severity_rank int, diversity int, peak double, minutes double",
    [(1, 3, 4, 10.0, 30.0), (2, 4, 2, 0.0, 0.0), (3, 4, 1, 50.0, 0.0), (4, 1, 1, 0.0, 0.0), (5, 4, 8, 100.0, 0.0), (6, 2, 3, 2.5, 0.9), (7, 0, 2, 20.0, 60.0)],
    "id int, hours double",
    [(1, 15.6), (2, 12.0), (3, 6.0), (4, 2.0), (5, 24.0), (6, 5.75), (7, 3.0)],
)
def _(d):
    return d.select("id", F.round(L.gap_tolerance(c("severity_rank"), c("diversity"), c("peak"), c("minutes")), 9).alias("hours"))


_METRICS = "id int, phase string, velocity int, peak double, rate double, diversity int, severity_rank int, idle double, events int, tolerance double"


@case(
    "phase_transitions",
    _METRICS,
    [
        (1, "emerging", 0, 0.0, 0.0, 2, 1, 0.0, 3, 4.0),
        (2, "emerging", 0, 0.0, 0.0, 1, 3, 0.0, 1, 4.0),
        (3, "emerging", 0, 0.0, 0.0, 1, 1, 6.1, 9, 4.0),
        (4, "emerging", 0, 0.0, 0.0, 1, 1, 6.0, 9, 4.0),
        (5, "developing", 5, 5.0, 5.0, 1, 1, 0.0, 4, 4.0),
        (6, "developing", 0, 0.0, 0.0, 3, 3, 0.0, 10, 4.0),
        (7, "developing", 0, 0.0, 0.0, 2, 1, 4.1, 49, 4.0),
        (8, "developing", 0, 0.0, 0.0, 2, 1, 3.9, 49, 4.0),
        (9, "active", 2, 10.0, 2.0, 3, 2, 0.0, 60, 4.0),
        (10, "active", 4, 10.0, 4.0, 3, 2, 2.1, 60, 4.0),
        (11, "active", 4, 10.0, 4.0, 3, 2, 2.0, 60, 4.0),
        (12, "declining", 8, 10.0, 8.0, 3, 2, 0.0, 60, 4.0),
        (13, "declining", 7, 10.0, 7.0, 3, 2, 6.1, 60, 4.0),
        (14, "declining", 0, 0.0, 0.0, 3, 2, 5.9, 60, 4.0),
        (15, "resolved", 1, 1.0, 1.0, 3, 2, 12.1, 60, 4.0),
        (16, "resolved", 1, 1.0, 1.0, 3, 2, 0.1, 60, 4.0),
        (17, "resolved", 0, 0.0, 0.0, 3, 2, 11.0, 60, 4.0),
        (18, "historical", 9, 9.0, 9.0, 3, 4, 0.0, 60, 4.0),
    ],
    "id int, next_phase string",
    [
        (1, "developing"),
        (2, "developing"),
        (3, "resolved"),
        (4, None),
        (5, "active"),
        (6, "active"),
        (7, "declining"),
        (8, None),
        (9, "declining"),
        (10, "declining"),
        (11, None),
        (12, "active"),
        (13, "resolved"),
        (14, None),
        (15, "historical"),
        (16, "developing"),
        (17, None),
        (18, None),
    ],
)
def _(d):
    return d.select("id", L.next_phase(*(c(n) for n in ("phase", "velocity", "peak", "rate", "diversity", "severity_rank", "idle", "events", "tolerance"))).alias("next_phase"))


@case(
    "situation_severities",
    "id int, phase string, conflict_source boolean, conflict_topic boolean, cyber_source boolean, disaster_topic boolean, events int, diversity int, child boolean, idle double",
    [
        (1, "active", True, True, False, False, 40, 4, False, 0.0),
        (2, "active", True, True, False, False, 40, 4, True, 0.0),
        (3, "active", True, True, False, False, 40, 4, False, 49.0),
        (4, "active", True, True, False, False, 40, 4, False, 48.9),
        (5, "developing", True, True, False, False, 25, 3, False, 0.0),
        (6, "developing", True, True, False, False, 24, 3, False, 0.0),
        (7, "developing", False, False, True, False, 25, 2, False, 0.0),
        (8, "active", False, False, False, True, 25, 2, False, 0.0),
        (9, "active", False, False, False, False, 40, 4, False, 0.0),
        (10, "emerging", False, False, False, False, 40, 4, False, 0.0),
        (11, "emerging", False, False, False, False, 4, 4, False, 0.0),
        (12, "emerging", False, True, False, False, 1, 2, False, 0.0),
        (13, "active", True, True, False, False, 100, 1, False, 0.0),
    ],
    "id int, severity_rank int",
    [(1, 4), (2, 3), (3, 2), (4, 4), (5, 3), (6, 2), (7, 3), (8, 3), (9, 3), (10, 2), (11, 1), (12, 2), (13, 1)],
)
def _(d):
    return d.select("id", L.recomputed_rank(*(c(n) for n in ("phase", "conflict_source", "conflict_topic", "cyber_source", "disaster_topic", "events", "diversity", "child", "idle"))).alias("severity_rank"))


@case(
    "faded_scores",
    "id int, event_type string, score int, hours double",
    [(1, "conflict_event", 10, 5.0), (2, "conflict_event", 10, 1.0), (3, "news_article", 8, 54.0), (4, "other", 6, 15.0), (5, "seismic_event", -4, 10.0), (6, "nuclear_event", 7, 60.0)],
    "id int, score int",
    # exp(-0.693) is 0.50007: a half-life takes half, and halves go away from zero.
    [(1, 5), (2, 10), (3, 2), (4, 3), (5, -2), (6, 4)],
)
def _(d):
    return d.select("id", L.faded(c("score"), c("event_type"), c("hours")).alias("score"))


@case(
    "peak_rates",
    "id int, rate double, peak double, minutes double",
    [(1, 2.0, 16.0, 60.0), (2, 5.0, 16.0, 60.0), (3, 0.0, 16.0, 90.5), (4, 0.0, 8.0, -5.0), (5, 1.0, 1e9, 900000.0)],
    "id int, kept double",
    [(1, 4.0), (2, 5.0), (3, 2.0), (4, 8.0), (5, 1.0)],
)
def _(d):
    return d.select("id", L.peak_rate(c("rate"), c("peak"), c("minutes")).alias("kept"))


@case(
    "severity_ranks",
    "id int, severity string",
    [(1, "critical"), (2, "HIGH"), (3, "medium"), (4, "Low"), (5, "info"), (6, "unheard-of"), (7, None)],
    "id int, severity_rank int, label string",
    [(1, 4, "critical"), (2, 3, "high"), (3, 2, "medium"), (4, 1, "low"), (5, 0, "info"), (6, 0, "info"), (7, 0, "info")],
)
def _(d):
    rank = L.severity_rank(c("severity"))
    return d.select("id", rank.alias("severity_rank"), L.severity_label(rank).alias("label"))


@case(
    "stale_situations",
    "id int, phase string, live_children boolean, signals int, events int, idle double",
    [(1, "active", False, 1, 50, 6.1), (2, "active", False, 1, 50, 6.0), (3, "declining", False, 1, 50, 99.0), (4, "resolved", True, 1, 50, 99.0), (5, "active", False, 0, 20, 1.6), (6, "active", False, 0, 19, 1.6)],
    "id int, stale boolean",
    [(1, True), (2, False), (3, False), (4, False), (5, True), (6, False)],
)
def _(d):
    return d.select("id", L.stale(*(c(n) for n in ("phase", "live_children", "signals", "events", "idle"))).alias("stale"))


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ddl, rows, f, _, _ = CASES[name]
    return f(spark.createDataFrame(rows, ddl))


def _literal(value, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    text = str(value).replace("'", "''")
    return f"CAST('{text}' AS {kind})"


def expected_sql(columns: str, rows: list) -> str:
    """A SELECT of the expected rows."""
    names, kinds = zip(*(x.split(" ") for x in columns.split(", ")), strict=True)
    sql = {"int": "INTEGER", "long": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    values = ",\n".join("(" + ", ".join(_literal(v, sql[k]) for v, k in zip(r, kinds, strict=True)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {values}) AS expected({', '.join(names)})"


def frames() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: partial(run, name=n) for n in CASES}


def oracle() -> dict[str, str]:
    return {n: expected_sql(columns, rows) for n, (_, _, _, columns, rows) in CASES.items()}

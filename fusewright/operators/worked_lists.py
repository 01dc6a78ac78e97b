"""Lists, trails, hierarchies and score cards on worked examples, reckoned by hand."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusewright.functions import backoff, countries, notices
from fusewright.operators import graphs, lists
from fusewright.operators.worked import expected_sql
from fusewright.sources import wire

c = F.col
CASES: dict[str, tuple[Callable[[SparkSession], DataFrame], str, list]] = {}


def case(name: str, columns: str, expected: list):
    def keep(f):
        CASES[name] = (f, columns, expected)
        return f

    return keep


@case("country_lookups", "id int, name string, lat double, lon double", [(1, "Iran", 32.4, 53.7), (2, "UK", 54.0, -2.0), (3, "UK", 54.0, -2.0), (4, "XX", None, None), (5, "Montenegro", None, None), (6, None, None, None)])
def _(spark):
    d = spark.createDataFrame([(1, "ir"), (2, "GB"), (3, "uk"), (4, "xx"), (5, "ME"), (6, None)], "id int, code string")
    lat, lon = countries.country_center(c("code"))
    return d.select("id", countries.country_name(c("code")).alias("name"), lat.alias("lat"), lon.alias("lon"))


_EVENTS = [
    (1, 100, "news_article", "s1", None, "Iran talks"),
    (2, 200, "news_article", None, "Wagner", None),
    (3, 300, "news_article", "s3", None, "WAGNER again"),
    (4, 300, "flight_position", "s1", "Wagner", None),
    (5, 301, "news_article", "s1", None, None),
    (6, 99, "news_article", "s1", None, None),
    (7, 150, "news_article", "s7", "Other", "Quiet"),
]


def _events(spark):
    return spark.createDataFrame(_EVENTS, "event_id long, t long, event_type string, source_id string, entity_name string, title string")


@case("situation_event_list", "event_id long, t long", [(3, 300), (2, 200), (1, 100)])
def _(spark):
    return lists.situation_events(_events(spark), 100, 300, ["s1"], ["Wagner"]).select("event_id", "t")


@case("retro_event_list", "event_id long", [(2,)])
def _(spark):
    return lists.retro_events(_events(spark), 100, 300, ["Wagner"], ["s3"]).select("event_id")


@case("report_list", "chosen_by string, id string", [("type", "r3"), ("type", "r1"), ("situation", "r2"), ("situation", "r1"), ("all", "r3"), ("all", "r2"), ("all", "r1")])
def _(spark):
    rows = spark.createDataFrame([("r1", "daily", "s1", None, 10), ("r2", "flash", "s1", "e1", 20), ("r3", "daily", "s2", "e1", 30), ("r0", "daily", "s1", "e1", 9)], "id string, report_type string, situation_id string, entity_id string, t long")
    of = lambda by, **kw: lists.reports(rows, 10, **kw).select(F.lit(by).alias("chosen_by"), "id")
    return of("type", report_type="daily", situation_id="s2").union(of("situation", situation_id="s1", entity_id="e1")).union(of("all"))


@case("recent_events", "event_id long", [(5,), (4,), (3,)])
def _(spark):
    return lists.recent(_events(spark), 3).select("event_id")


@case("top_evidence", "trigger_id long, evidence string", [(1, "12|11|13"), (2, "14")])
def _(spark):
    pairs = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (1, 13), (2, 14)], "trigger_id long, event_id long")
    e = spark.createDataFrame([(10, 1, 5), (11, 2, 9), (12, 3, 9), (13, 2, 9), (14, 0, 1)], "event_id long, severity_rank int, t long")
    return lists.top_evidence(pairs, e).select("trigger_id", F.array_join("evidence", "|").alias("evidence"))


@case("aircraft_lookup", "event_id long, aircraft_type string, aircraft_owner string", [(1, "C17", "USAF"), (2, None, None), (3, None, None)])
def _(spark):
    e = spark.createDataFrame([(1, " AE01ce "), (2, "x"), (3, None)], "event_id long, entity_id string")
    return lists.with_aircraft(e, spark.createDataFrame([("ae01CE", "C17", "USAF"), ("AE01CE", "KC135", "ANG")], "hex string, type string, owner string")).drop("entity_id")


@case("simplified_trails", "entity_id string, n long, lat double", [("a", 1, 0.0), ("a", 2, 0.0012), ("a", 3, 0.0022), ("a", 4, 0.0023), ("b", 1, 5.0)])
def _(spark):
    rows = [("a", 1, 0.0, 0.0), ("a", 2, 0.0009, 0.0), ("a", 3, 0.0012, 0.0), ("a", 4, 0.0020, 0.0), ("a", 5, 0.0022, 0.0), ("a", 6, 0.0023, 0.0), ("b", 1, 5.0, 5.0)]
    return lists.simplified_trails(spark.createDataFrame(rows, "entity_id string, t long, lat double, lon double")).select("entity_id", "n", F.round("lat", 6).alias("lat"))


@case("merged_features", "part int, id string", [(0, "n"), (0, "m"), (1, "a")])
def _(spark):
    of = lambda rows: spark.createDataFrame(rows, "id string, t long")
    return lists.merged_features(of([("a", 90), ("b", 80)]), of([("a", 99), ("m", 50), ("n", 70), ("old", 40)]), 100, cap=3).select("part", "id")


@case("repaired_hierarchy", "id string, parent_id string, child_ids string", [("a", None, "b|c"), ("b", "a", ""), ("c", "a", ""), ("d", None, ""), ("e", None, "")])
def _(spark):
    rows = [("a", None, ["c", "gone"]), ("b", "a", []), ("c", None, []), ("d", "nowhere", []), ("e", "e", ["e"])]
    out = lists.repaired_hierarchy(spark.createDataFrame(rows, "id string, parent_id string, child_ids array<string>"))
    return out.select("id", "parent_id", F.array_join("child_ids", "|").alias("child_ids"))


@case("titles_needed", "sid string, why string", [("child", "first"), ("new", "first"), ("vague", "garbage"), ("grown", "grown")])
def _(spark):
    rows = [
        ("new", None, "X Y", False, 3, 0, 0, 0),
        ("small", None, "X Y", False, 2, 0, 0, 0),
        ("child", "new", "X Y", False, 2, 0, 0, 0),
        ("vague", None, "Growing security concerns", True, 1, 0, 0, 0),
        ("grown", None, "Red Sea Attacks", True, 99, 25, 5, 8_200),
        ("fresh", None, "Red Sea Attacks", True, 99, 25, 5, 8_201),
        ("same", None, "Red Sea Attacks", True, 99, 24, 5, 0),
    ]
    return lists.needing_titles(spark.createDataFrame(rows, "sid string, parent_id string, title string, titled boolean, event_count long, signal_events long, signals_then long, titled_at long"), 10_000)


def _card(spark):
    rows = [("a", None, "Red Sea Attacks", 3, 2, 9, 0.8), ("b", None, "Red Sea Patrols", 1, 3, 5, 0.4), ("c", "a", "Celebrity News", 0, 1, 1, 0.1), ("d", None, "Quiet Day", 0, 1, 1, 0.0)]
    s = spark.createDataFrame(rows, "sid string, parent_id string, title string, severity_rank int, source_count int, event_count long, certainty double")
    e = spark.createDataFrame([("red sea", 2.0, 3, None), ("^quiet", 1.0, None, 2), ("ukraine", 1.0, None, None)], "pattern string, weight double, min_rank int, min_sources int")
    u = spark.createDataFrame([("celebrity", 1.0), ("day$", 3.0)], "pattern string, weight double")
    return lists.score_card(s, e, u, {"max_top_level": 3, "min_avg_certainty": 0.5, "min_multi_source_ratio": 0.6, "max_info_ratio": 0.3})


@case(
    "golden_card",
    "kind string, name string, passed boolean, weight double",
    [
        ("expected", "red sea", True, 2.0),
        ("expected", "^quiet", False, 1.0),
        ("expected", "ukraine", False, 1.0),
        ("unwanted", "celebrity", True, 1.0),
        ("unwanted", "day$", False, 3.0),
        ("limit", "max_top_level", True, 1.0),
        ("limit", "min_avg_certainty", False, 1.0),
        ("limit", "min_multi_source_ratio", True, 1.0),
        ("limit", "max_info_ratio", False, 1.0),
    ],
)
def _(spark):
    return _card(spark)


@case("golden_score", "score double, passed long, total long", [(0.416667, 4, 9)])
def _(spark):
    return lists.score_of(_card(spark)).select(F.round("score", 6).alias("score"), "passed", "total")


@case("without_nul", "id int, text string", [(1, "ab"), (2, ""), (3, None)])
def _(spark):
    d = spark.createDataFrame([(1, "a\u0000b\u0000"), (2, "\u0000"), (3, None)], "id int, text string")
    return d.select("id", wire.without_nul(c("text")).alias("text"))


@case("model_batches", "first_id long, n int", [(0, 8), (8, 8), (16, 4)])
def _(spark):
    return lists.batches_of(spark.range(20).coalesce(1)).select("first_id", F.size("ids").alias("n"))


@case(
    "notice_lines",
    "id int, fir string, kind string, topic string, region_topic string, gravity string, conflict boolean, lat double",
    [
        (1, "OIIX", "Restricted Area", "airspace-restriction", "tehran-fir", "critical", True, 35.7),
        (2, "EGTT", "Warning", "airspace-warning", "london-fir", "warning", True, 51.4775),
        (3, "ORBB", "Facility", "aerodrome-facility", "baghdad-fir", "warning", True, 33.3),
        (4, "XXXX", "Other", "obstacle", "fir-xxxx", "warning", False, None),
        (5, "EGPX", "Other", "notam", "scottish-fir", "warning", False, 56.5),
    ],
)
def _(spark):
    rows = [
        (1, "oiix /qrtca/IV/NBO/AE/000/999/3548N05132E005", None, None),
        (2, "EGTT/QWELW/IV", "EGLL", "GNSS testing near"),
        (3, "ORBB/QFAHC", None, "quiet"),
        (4, "XXXX/QOBCE", None, "crane"),
        (5, "EGPX", None, "no code"),
    ]
    d = spark.createDataFrame(rows, "id int, line string, airport string, text string")
    code, fir = notices.qcode(c("line")), notices.fir(c("line"))
    return d.select(
        "id", fir.alias("fir"), notices.kind(code).alias("kind"), notices.topic(code).alias("topic"), notices.fir_topic(fir).alias("region_topic"), notices.gravity(code, fir).alias("gravity"),
        notices.is_about_conflict(code, c("text")).alias("conflict"), notices.place(fir, c("airport"))[0].alias("lat"),
    )


@case("notices_written_out", "id int, text string", [(1, "Runway 09 Closed Above Flight Level 100"), (2, "Non-Scheduled Traffic, VHF Omnidirectional Range Unserviceable"), (3, "ADX FLX MONDAY")])
def _(spark):
    d = spark.createDataFrame([(1, "RWY 09 CLSD ABV FL100"), (2, "NON-SKED TFC, VOR U/S"), (3, "ADX FLX MONDAY")], "id int, text string")
    return d.select("id", notices.written_out(c("text")).alias("text"))


@case("wire_shodan", "entity_id string, severity string, region_code string, latitude double, entity_name string", [("1.2.3.4:502", "medium", "middle-east", 35.5, "Org"), ("1.2.3.5:443", "info", None, None, None), ("unknown:80", "medium", None, None, None), ("1.2.3.6:80", "medium", None, None, None)])
def _(spark):
    bodies = [
        '{"ip_str": "1.2.3.4", "port": 502, "org": "Org", "location": {"country_code": "IR", "latitude": 35.5, "longitude": 51.1}}',
        '{"ip_str": "1.2.3.5", "port": 443, "tags": ["cloud"], "location": {"country_code": "FR"}}',
        '{"port": 80, "tags": ["ics"]}',
        '{"ip_str": "1.2.3.6", "port": 80, "vulns": {"CVE-2020-0001": {}}}',
        "not json",
    ]
    return wire.shodan(spark.createDataFrame([(b,) for b in bodies], "body string")).select("entity_id", "severity", "region_code", "latitude", "entity_name")


@case(
    "post_filters",
    "id int, reason string, severity string",
    [
        (1, "repost", "medium"),
        (2, "negative_keyword", "low"),
        (3, None, "low"),
        (4, "image_meme", "low"),
        (5, "media_consumption", "low"),
        (6, "meta_commentary", "low"),
        (7, "personal_content", "low"),
        (8, None, "low"),
        (9, "url_only_low_text", "low"),
        (10, None, "medium"),
        (11, "short_text", "low"),
        (12, None, "low"),
    ],
)
def _(spark):
    long = " It goes on for a while, without a word of any interest to those who read such things."
    rows = [
        (1, "Missile launched", True, False, False),
        (2, "A SALE today" + long, False, False, False),
        (3, "Wholesale trade figures" + long, False, False, False),  # no word of its own
        (4, "Look at this", False, False, True),
        (5, "I watched a film" + long, False, False, False),
        (6, "Hot take: it rains" + long, False, False, False),
        (7, "My dog is asleep" + long, False, False, False),
        (8, "My radar is asleep" + long, False, False, False),
        (9, "See this https://example.org/a-long-path-of-a-page", False, True, False),
        (10, "Drone shot down https://example.org/x", False, True, False),
        (11, "Nothing much here", False, False, False),
        (12, "Warship in port", False, False, False),
    ]
    d = spark.createDataFrame(rows, "id int, text string, repost boolean, link boolean, images boolean")
    return d.select("id", wire.post_rejection(c("text"), c("repost"), c("link"), c("images")).alias("reason"), wire.post_severity(c("text")).alias("severity"))


@case("source_waits", "id int, seconds double", [(1, 10.0), (2, 2000.0), (3, 30.0), (4, 337.5), (5, 150.0), (6, 600.0), (7, 2250.0)])
def _(spark):
    rows = [(1, "stream", 0, None, 0.0), (2, "stream", 99, None, 4 / 9), (3, "poll", 0, None, 0.0), (4, "poll", 9, None, 0.5), (5, "limited", 3, 60, 0.9), (6, "limited", 30, 60, 0.9), (7, "stream", 8, None, 1.0)]
    d = spark.createDataFrame(rows, "id int, kind string, failures int, retry long, dice double")
    return d.select("id", F.round(backoff.wait_seconds(c("kind"), c("failures"), c("retry"), c("dice")), 6).alias("seconds"))


@case("retry_headers", "id int, seconds long", [(1, 120), (2, 90), (3, 1), (4, 60), (5, 60), (6, 30), (7, 1)])
def _(spark):
    rows = [(1, " 120 ", "1"), (2, "Mon, 01 Jan 2024 12:01:30 GMT", None), (3, "Mon, 01 Jan 2024 11:00:00 GMT", None), (4, "soon", None), (5, None, "soon"), (6, None, "1704110430"), (7, "soon", "1704110000")]
    d = spark.createDataFrame(rows, "id int, header string, reset string")
    return d.select("id", backoff.retry_after(c("header"), c("reset"), F.lit(1704110400)).alias("seconds"))


@case("trees_removed", "id string", [("x",), ("y",)])
def _(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", None), ("y", "x"), ("p", None), ("q", "p")]
    return graphs.without_trees(spark.createDataFrame(rows, "id string, parent_id string"), ["a", "p"]).select("id")


_SNAPSHOTS = [(0, "a", None, 5, 0.5, 3, 2, "One"), (0, "b", "a", 2, 0.3, 1, 1, "Two"), (1, "a", None, 9, 0.6, 4, 3, "ONE"), (1, "c", None, 1, 0.2, 0, 1, "Three")]


def _snapshots(spark):
    return spark.createDataFrame(_SNAPSHOTS, "snapshot_no int, sid string, parent_id string, event_count long, certainty double, severity_rank int, source_count int, title string")


@case("replay_metrics", "snapshot_no int, situations long, top_level long, events long, avg_certainty double, high long, multi_source long", [(0, 2, 1, 7, 0.4, 1, 1), (1, 2, 2, 10, 0.4, 1, 1)])
def _(spark):
    return lists.replay_metrics(_snapshots(spark)).withColumn("avg_certainty", F.round("avg_certainty", 9))


@case("compared_runs", "title string, change string", [("one", "common"), ("three", "new")])
def _(spark):
    x = _snapshots(spark)
    return lists.compared_runs(x.where("snapshot_no = 0"), x.where("snapshot_no = 1"))


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return CASES[name][0](spark)


def frames() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: partial(run, name=n) for n in CASES}


def oracle() -> dict[str, str]:
    return {n: expected_sql(columns, rows) for n, (_, columns, rows) in CASES.items()}

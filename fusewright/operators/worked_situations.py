"""Situations on worked examples: a few situations and events that show each rule, and what must come out, reckoned by hand."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusewright.operators.worked import expected_sql
from fusewright.situations import living, merging, scoring

NOW = 1_000_000
STATE = (
    "sid string, parent_id string, title string, entities array<string>, topics array<string>, regions array<string>, sources array<string>, direct_sources array<string>, severity_rank int, "
    "first_seen long, last_updated long, lat double, lon double, event_count long, total_events long, direct_events long, signal_events long, event_titles array<string>, phase string, "
    "certainty double, phase_changed_at long, peak double, peak_at long, velocity int, recent boolean"
)
EVENT = (
    "event_id long, event_type string, source_type string, region string, lat double, lon double, title string, severity_rank int, event_time long, entities array<string>, "
    "topics array<string>, payload string"
)
CASES: dict[str, tuple[Callable[[SparkSession], DataFrame], str, list]] = {}


def state(spark: SparkSession, rows: dict[str, dict]) -> DataFrame:
    """Situations by sid; what isn't given is that of a plain one."""
    plain = dict(
        parent_id=None, title="Some Plain Title", entities=[], topics=[], regions=[], sources=["acled"], direct_sources=[], severity_rank=1, first_seen=NOW - 1000, last_updated=NOW, lat=None,
        lon=None, event_count=1, direct_events=0, signal_events=0, event_titles=[], phase="active", certainty=0.5, phase_changed_at=NOW, peak=0.0, peak_at=NOW, velocity=0, recent=False,
    )
    names = [x.split(" ")[0] for x in STATE.split(", ")]
    full = [{"sid": k, **plain, "total_events": v.get("event_count", 1), **v} for k, v in rows.items()]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], STATE)


def events(spark: SparkSession, rows: dict[int, dict]) -> DataFrame:
    plain = dict(event_type="vessel_position", source_type="ais", region=None, lat=None, lon=None, title=None, severity_rank=1, event_time=NOW - 60, entities=[], topics=[], payload="{}")
    names = [x.split(" ")[0] for x in EVENT.split(", ")]
    return spark.createDataFrame([tuple({"event_id": k, **plain, **v}[n] for n in names) for k, v in rows.items()], EVENT)


def case(name: str, columns: str, expected: list):
    def keep(f):
        CASES[name] = (f, columns, expected)
        return f

    return keep


def _joined(*names: str):
    return [F.array_join(F.array_sort(n), "|").alias(n) for n in names]


_SITUATIONS = {
    "A": dict(entities=["x", "y"], topics=["t1"], regions=["middle-east"], sources=["acled", "gdelt"], event_count=50, lat=10.0, lon=10.0, event_titles=["Border clash in north"]),
    "B": dict(topics=["t1"], sources=["firms"], event_count=50),
    "C": dict(topics=["t1"], sources=["usgs", "firms"], event_count=5),
    "D": dict(topics=["t1"], sources=["adsb-fi", "opensky"], event_count=5),
}
_EVENTS = {
    1: dict(event_type="conflict_event", source_type="acled", region="ME", lat=10.0, lon=10.0, title="Border clash reported north", severity_rank=2, entities=["x", "y"], topics=["t1"], payload='{"fatalities": 3}'),
    2: dict(event_type="flight_position", source_type="opensky", topics=["t1"]),
    3: dict(event_type="thermal_anomaly", source_type="firms", lat=-40.0, lon=100.0, topics=["t1"]),
    4: dict(event_type="news_article", source_type="gdelt", region="FR", topics=["zz"]),
    5: dict(event_type="seismic_event", source_type="usgs", entities=["chile"], payload='{"mag": 6.4}'),
    6: dict(event_type="seismic_event", source_type="usgs", entities=["chile"], payload='{"magnitude": 6.5, "enrichment": {"relevance_score": 0.9}}'),
    7: dict(topics=["country:x"]),
    8: dict(topics=["country:x"], severity_rank=3),
    9: dict(event_type="news_article", source_type="gdelt", topics=["t1"], severity_rank=4, payload='{"enrichment": {"relevance_score": 0.2}}'),
    10: dict(event_type="news_article", source_type="gdelt"),
    11: dict(event_type="thermal_anomaly", source_type="firms", topics=["zz"], severity_rank=4),
}


def _scored(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    idf = spark.createDataFrame([("e", "x", 3.4, None), ("e", "y", 9.0, None), ("t", "t1", 2.6, 0.75)], "kind string, term string, idf double, anomaly double")
    s, e = state(spark, _SITUATIONS), events(spark, _EVENTS)
    return s, e, scoring.score_candidates(e, s, idf, NOW)


@case(
    "situation_scores",
    "event_id long, sid string, score int",
    # Event 1 and A: size -1, entities 3 + 5 of at most 5, topics 3 + 2 of at most 4, region 1, place 2, title 3.
    [(1, "A", 14), (1, "C", 4), (1, "D", 4), (2, "A", 3), (2, "D", 3), (3, "A", -12), (3, "C", 4), (9, "A", 3), (9, "C", 4), (9, "D", 4)],
)
def _(spark):
    return _scored(spark)[2].select("event_id", "sid", "score")


@case(
    "situation_assignments",
    "event_id long, action string, sid string",
    [
        (1, "merge", "A"),
        (2, "merge", "A"),
        (3, "merge", "C"),
        (4, "create", None),
        (5, "suppress", None),
        (6, "create", None),
        (7, "buffer", None),
        (8, "create", None),
        (9, "skip", None),
        (11, "suppress", None),
    ],
)
def _(spark):
    _, e, scored = _scored(spark)
    return scoring.assign(e, scored)


@case(
    "situations_grown",
    "sid string, event_count long, signal_events long, severity_rank int, first_seen long, sources string, regions string, entities string, event_titles string",
    [
        ("A", 52, 1, 3, NOW - 1000, "acled|gdelt|opensky", "middle-east", "x|y", "Border clash in north|Border clash reported north"),
        ("B", 50, 0, 1, NOW - 1000, "firms", "", "", ""),
        ("C", 6, 0, 1, NOW - 1000, "firms|usgs", "", "", ""),
        ("D", 5, 0, 1, NOW - 1000, "adsb-fi|opensky", "", "", ""),
    ],
)
def _(spark):
    s, e, scored = _scored(spark)
    return scoring.merge_events(s, e, scoring.assign(e, scored), NOW).select("sid", "event_count", "signal_events", "severity_rank", "first_seen", *_joined("sources", "regions", "entities", "event_titles"))


@case(
    "situations_founded",
    "sid string, title string, topics string, regions string, severity_rank int, signal_events long",
    [("e4", "Zz in western-europe", "zz", "western-europe", 1, 1), ("e6", "Chile — Unknown Region", "seismic", "", 3, 1), ("e8", "Country:x in Unknown Region", "maritime", "", 3, 0)],
)
def _(spark):
    _, e, scored = _scored(spark)
    return scoring.founded(e, scoring.assign(e, scored), NOW).select("sid", "title", *_joined("topics", "regions"), "severity_rank", "signal_events")


@case("pending_groups", "event_id long, group_id long", [(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)])
def _(spark):
    rows = [
        (1, ["a", "b"], [], NOW),
        (2, ["a", "b"], ["c", "d"], NOW - 300),
        (3, [], ["c", "d"], NOW - 10),
        (4, ["a"], ["z"], NOW),
        (5, ["a", "b"], [], NOW - 301),
        (6, ["q"], ["r"], NOW),
        (7, ["q"], ["r"], NOW),
        (8, ["r"], ["q"], NOW),
    ]
    return scoring.pending_groups(spark.createDataFrame(rows, "event_id long, entities array<string>, topics array<string>, received_at long"), NOW)


@case("streaming_idf", "kind string, term string, idf double", [("e", "p", 3.912), ("t", "q", 3.507), ("t", "r", 3.912)])
def _(spark):
    # At three events: q of the first and last weighs 0.9999 ** 2 + 1, r of the last 1; a total of 100 is the least.
    rows = [(1, "t", "q"), (2, "e", "p"), (3, "t", "q"), (3, "t", "r")]
    got = scoring.streaming_idf(spark.createDataFrame(rows, "n long, kind string, term string"), "n")
    return got.select("kind", "term", F.round("idf", 3).alias("idf"))


_PAIRS = {
    "P1": dict(title="Red Sea Shipping Attacks", event_count=60, regions=["ME"], entities=["houthis"], topics=["shipping"]),
    "P2": dict(title="Red Sea Shipping Attacks Resume", event_count=10, regions=["africa"], entities=["houthis"], topics=["shipping"]),
    "P3": dict(title="Gulf Tanker Seizure Crisis", event_count=20, regions=["ME"], entities=["houthis", "iran"], topics=["tankers"], sources=["gdelt"]),
    "P4": dict(title="Quito Earthquake Relief Effort", event_count=5),
    "P5": dict(title="Alpha Bravo Charlie Story", event_count=8, regions=["africa"], entities=["a", "b"], topics=["k", "l"]),
    "P6": dict(title="Delta Echo Foxtrot Story", event_count=9, regions=["africa"], entities=["a", "b"], topics=["k", "l"]),
    "P7": dict(title="Sahel Coup Plot Foiled", event_count=3, regions=["africa"]),
    "P8": dict(title="Sahel Coup Plot Trial", event_count=4, regions=["africa"]),
    "P9": dict(title="Sahel Coup Plot Trial", event_count=2, regions=["africa"], parent_id="P4"),
}


@case("overlapping_situations", "parent string, child string, skip_audit boolean", [("P1", "P2", True), ("P1", "P3", True), ("P6", "P5", False), ("P8", "P7", True)])
def _(spark):
    return merging.overlapping(state(spark, _PAIRS), similar=spark.createDataFrame([("P5", "P6", 0.5)], "a string, b string, similarity double"))


@case("rejected_merges", "parent string, child string, skip_audit boolean", [("P1", "P3", True), ("P6", "P5", True), ("P8", "P7", True)])
def _(spark):
    # Without vectors two entities in one region are enough; a rejected pair stays apart.
    return merging.overlapping(state(spark, _PAIRS), rejected=spark.createDataFrame([("P1", "P2")], "a string, b string"))


@case("merges_by_topic", "parent string, child string", [("T2", "T1"), ("T6", "T7")])
def _(spark):
    return merging.by_topic(
        state(
            spark,
            {
                "T1": dict(topics=["alpha", "beta"], title="One Quiet Thing", event_count=5),
                "T2": dict(topics=["alpha", "beta", "gamma"], title="Another Loud Matter", event_count=9),
                "T3": dict(topics=["gamma"], entities=["wagner"], title="Desert Convoy", event_count=4),
                "T4": dict(entities=["wagner"], title="Fuel Depot", event_count=2),
                "T5": dict(title="Iran War", event_count=7),
                "T6": dict(title="Iranian Spy Ring", event_count=3),
                "T7": dict(title="Iran Spy Case", event_count=1),
            },
        )
    )


@case("merges_by_country", "parent string, child string", [("c2", "c1"), ("c2", "c3"), ("c2", "c4")])
def _(spark):
    titles = [("c1", "Iran Missile Launch", 10), ("c2", "Israel Strikes Depot", 20), ("c3", "Gaza Crisis Deepens", 5), ("c4", "Yemen Port Attack", 20), ("c5", "Lebanon Election Results", 50), ("c6", "Japan Trade Fair", 9)]
    return merging.by_country(state(spark, {i: dict(title=t, event_count=n) for i, t, n in titles}))


_FAMILY = {
    "A": dict(event_count=30, sources=["acled"], severity_rank=1, first_seen=500, event_titles=["a"]),
    "B": dict(event_count=20, sources=["gdelt"], severity_rank=3, first_seen=400, event_titles=["b1", "b2"]),
    "C": dict(event_count=10, sources=["usgs"], severity_rank=4, first_seen=300, event_titles=["c"]),
    "D": dict(event_count=5, parent_id="B"),
}


@case("chosen_merges", "parent string, child string", [("A", "B")])
def _(spark):
    # C waits, as its parent becomes a child.
    return merging.chosen(state(spark, _FAMILY), spark.createDataFrame([("A", "B"), ("B", "C")], "parent string, child string"))


@case(
    "merged_families",
    "sid string, parent_id string, event_count long, severity_rank int, first_seen long, sources string, event_titles string",
    # C is too small to raise A's severity; D goes to its parent's parent.
    [("A", None, 60, 3, 300, "acled|gdelt|usgs", "a|b1|b2|c"), ("B", "A", 20, 3, 400, "gdelt", "b1|b2"), ("C", "A", 10, 4, 300, "usgs", "c"), ("D", "A", 5, 1, NOW - 1000, "acled", "")],
)
def _(spark):
    out = merging.apply_merges(state(spark, _FAMILY), spark.createDataFrame([("A", "B"), ("A", "C")], "parent string, child string"))
    return out.select("sid", "parent_id", "event_count", "severity_rank", "first_seen", *_joined("sources", "event_titles"))


def _hours(n: float) -> int:
    return NOW - int(3600 * n)


@case(
    "phase_ticks",
    "sid string, phase string, from_phase string, severity_rank int, peak double",
    [
        ("busy", "active", "developing", 1, 6.0),
        ("dwells", "active", None, 2, 0.0),
        ("guarded", "active", None, 2, 0.0),
        ("kid1", "developing", None, 3, 0.0),
        ("kid2", "resolved", None, 1, 0.0),
        ("lingers", "resolved", "declining", 2, 0.0),
        ("news", "declining", "emerging", 1, 0.0),
        ("parent", "resolved", None, 3, 0.0),
        ("quiet", "declining", "active", 2, 0.0),
        ("reopens", "developing", "resolved", 1, 1.0),
    ],
)
def _(spark):
    settled = dict(phase="resolved", last_updated=_hours(1))
    old = dict(phase="active", severity_rank=2, last_updated=_hours(3), sources=["acled", "usgs"], topics=["flood"], event_count=10)
    rows = {
        "busy": dict(phase="developing", velocity=6, event_count=6),
        # Two hours without an event, half of what it bears (4 hours, two sources): it may decline after 6 hours, and with nothing in 4.
        "quiet": old | dict(phase_changed_at=_hours(7)),
        "dwells": old | dict(phase_changed_at=_hours(5)),
        "guarded": old | dict(phase_changed_at=_hours(7), recent=True),
        "lingers": dict(phase="declining", severity_rank=2, phase_changed_at=_hours(48.1), last_updated=_hours(1)),
        "news": dict(phase="emerging", sources=["gdelt", "rss-news"], first_seen=_hours(74), last_updated=_hours(1)),
        "reopens": dict(phase="resolved", velocity=1, last_updated=NOW),
        "parent": settled,
        # Half of the children of fifteen events are high: a third is enough.
        "kid1": dict(phase="developing", last_updated=_hours(1), parent_id="parent", event_count=25, sources=["acled", "usgs", "ais"], topics=["war"]),
        "kid2": settled | dict(parent_id="parent", event_count=15),
    }
    return living.evaluate(state(spark, rows), NOW).select("sid", "phase", "from_phase", "severity_rank", F.round("peak", 6).alias("peak"))


@case("pruned_situations", "sid string, parent_id string", [("declines", None), ("fresh", None), ("kept_child", "old_parent"), ("orphan", None), ("old_parent", None)])
def _(spark):
    rows = {
        "fresh": dict(last_updated=_hours(5)),
        "old": dict(last_updated=_hours(7)),
        "declines": dict(last_updated=_hours(70), phase="declining"),
        "old_parent": dict(last_updated=_hours(7)),
        "kept_child": dict(parent_id="old_parent"),
        "gone_parent": dict(last_updated=_hours(7)),
        "orphan": dict(parent_id="gone_parent", phase="resolved"),
        "telemetry": dict(last_updated=_hours(1.6), event_count=20),
    }
    return living.pruned(state(spark, rows), NOW).select("sid", "parent_id")


@case(
    "swept_situations",
    "sid string, parent_id string, n_entities int, n_topics int, event_count long, least_topic string",
    [("big", None, 25, 15, 150, "t05"), ("far", None, 0, 0, 9, None), ("kin", "big", 1, 0, 9, None), ("named", "big", 0, 0, 9, None), ("over", None, 1, 0, 5, None)],
)
def _(spark):
    rows = {
        "big": dict(title="Sahel Coup Plot", entities=[f"e{i:02d}" for i in range(30)], topics=[f"t{i:02d}" for i in range(20)], event_count=201),
        "kin": dict(title="Fuel Depot", parent_id="big", entities=["e29"], event_count=9),
        "named": dict(title="Sahel Coup Trial", parent_id="big", event_count=9),
        "far": dict(title="Thailand Wildfires", parent_id="big", event_count=9),
        "over": dict(title="Sahel Coup Aftermath", parent_id="big", entities=["e29"], event_count=5),
        "single": dict(title="Sahel Coup", parent_id="big", event_count=1, first_seen=_hours(2)),
    }
    # Later entities and topics tell more.
    idf = spark.createDataFrame([("t", f"t{i:02d}", float(i)) for i in range(20)] + [("e", f"e{i:02d}", float(i)) for i in range(30)], "kind string, term string, idf double")
    out = living.swept(state(spark, rows), idf, NOW, max_children=3)
    return out.select("sid", "parent_id", F.size("entities").alias("n_entities"), F.size("topics").alias("n_topics"), "event_count", F.array_min("topics").alias("least_topic"))


@case("divergent_parts", "sid string, part int, entities string, events long", [("apart", 0, "iran|israel", 16), ("apart", 1, "peru", 8), ("apart", 2, "quito", 8)])
def _(spark):
    titles = ["Iran strikes Israel", "Peru votes", "Quito quake"]
    rows = {
        "apart": dict(entities=["iran", "israel", "peru", "quito"], event_titles=titles, event_count=32),
        "one": dict(entities=["iran", "israel", "peru", "quito"], event_titles=["Iran Israel Peru Quito"], event_count=32),
        "most": dict(entities=["iran", "israel", "peru", "quito"], event_titles=["Iran Israel Peru"], event_count=32),
        "small": dict(entities=["iran", "israel", "peru", "quito"], event_titles=titles, event_count=29),
        "few": dict(entities=["iran", "peru", "quito"], event_titles=titles, event_count=40),
        "child": dict(entities=["iran", "israel", "peru", "quito"], event_titles=titles, event_count=32, parent_id="apart"),
    }
    return living.divergent(state(spark, rows)).select("sid", "part", F.array_join("entities", "|").alias("entities"), "events")


@case("coherence_splits", "sid string, event_id long", [("two", 1), ("two", 3), ("two", 5)])
def _(spark):
    near, far = [1.0, 0.1], [0.1, 1.0]
    rows = [("two", i, far if i in (1, 3, 5) else near, i) for i in range(1, 9)]
    rows += [("lone", i, far if i in (1, 2) else near, i) for i in range(1, 9)]  # too few to leave
    rows += [("few", i, far if i < 3 else near, i) for i in range(5)]  # fewer than six
    rows += [("same", i, near, i) for i in range(8)]
    rows += [("past", i, far if i < 4 else near, i) for i in range(24)]  # the odd ones are no longer among the latest twenty
    return living.coherence_splits(spark.createDataFrame(rows, "sid string, event_id long, vector array<double>, event_time long"))


@case("situation_roots", "sid string, root string", [("b", "a"), ("c", "a"), ("d", "a"), *((f"k{i}", "k1") for i in range(2, 13))])
def _(spark):
    parents = {"a": None, "b": "a", "c": "b", "d": "c", "lost": "nowhere", **{f"k{i}": f"k{i - 1}" if i > 1 else None for i in range(1, 13)}}
    return living.roots(state(spark, {k: dict(parent_id=p) for k, p in parents.items()}))


@case(
    "active_situations",
    "sid string, parent_id string, severity_rank int, certainty double, source_count int",
    [
        ("alone", None, 1, 0.5, 2),
        ("deep", "top", 1, 0.5, 1),
        ("fire1", None, 1, 0.5, 2),
        ("fire2", None, 1, 0.5, 2),
        ("kid", "top", 1, 0.5, 1),
        ("promoted", None, 1, 0.5, 2),
        ("single", None, 1, 0.5, 1),
        ("soup", None, 3, 0.21, 2),
        ("summit1", None, 1, 0.5, 2),
        ("summit2", None, 1, 0.5, 2),
        ("top", None, 1, 0.5, 1),
        ("twin", None, 1, 0.5, 2),
    ],
)
def _(spark):
    good = dict(event_count=15, sources=["acled", "usgs"], entities=["x"])
    rows = {
        "top": dict(title="Sahel Coup Plot"),
        "kid": dict(title="Fuel Depot Raid", parent_id="top", event_count=3),
        "deep": dict(title="Fuel Depot Blaze Aftermath", parent_id="kid", event_count=3),
        "tiny": dict(title="Fuel Depot Raid", parent_id="top", event_count=2),
        "bad": dict(title="Protests in Georgia"),
        "promoted": good | dict(title="Tbilisi Street Protests", parent_id="bad"),
        "dropped": dict(title="Tbilisi Sit-in", parent_id="bad", event_count=14),
        "single": dict(title="Quiet Border Incident"),
        "echo": dict(title="quiet border incident", parent_id="single", event_count=3),
        "alone": good | dict(title="Red Sea Shipping Attacks"),
        "medium": good | dict(title="Harbour Blockade Looms", severity_rank=2, event_count=22),
        "sensors": good | dict(title="Hotspots Over Taiga", sources=["firms", "opensky"]),
        "family": good | dict(title="Papers Tell Much", sources=["gdelt", "rss-news"]),
        "magnet": good | dict(title="Everything Everywhere Happens", entities=[], regions=["a", "b", "c", "d"]),
        "soup": good | dict(title="Broad Unrest Spreads Fast", severity_rank=4, topics=[f"t{i}" for i in range(12)], regions=["a", "b", "c", "d"]),
        "twin": good | dict(title="Northern Valley Grid Failure", event_count=40),
        "twin_less": good | dict(title="Valley Northern Grid Failure", event_count=30),
        "summit1": good | dict(title="Alpine Summit Opens", last_updated=NOW - 1),
        "summit2": good | dict(title="Harbour Congress Meets", last_updated=NOW - 2),
        "summit3": good | dict(title="Island Conference Ends", last_updated=NOW - 3),
        "fire1": good | dict(title="Canyon Wildfire Grows", last_updated=NOW - 1),
        "fire2": good | dict(title="Prairie Blaze Season", topics=["blaze"], last_updated=NOW - 2),
        "fire3": good | dict(title="Delta Flood Rising", last_updated=NOW - 3),
    }
    return living.active(state(spark, rows)).select("sid", "parent_id", "severity_rank", F.round("certainty", 6).alias("certainty"), "source_count")


@case("percentile_thresholds_dynamic", "kind string, medium long, high long, critical long", [("cold", None, None, None), ("warm", 75, 90, 99)])
def _(spark):
    rows = [("warm", i // 2, i + 1) for i in range(100)] + [("cold", i // 4, i + 1) for i in range(100)]
    both = spark.createDataFrame(rows, "kind string, snapshot long, event_count long")
    out = [living.percentile_least(both.where(F.col("kind") == k)).select(F.lit(k).alias("kind"), "medium", "high", "critical") for k in ("warm", "cold")]
    return out[0].unionByName(out[1])


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return CASES[name][0](spark)


def frames() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: partial(run, name=n) for n in CASES}


def oracle() -> dict[str, str]:
    return {n: expected_sql(columns, rows) for n, (_, columns, rows) in CASES.items()}

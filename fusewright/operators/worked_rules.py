"""Correlation rules on worked examples, and against all pairs over the driver's events."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusewright.operators.worked import expected_sql
from fusewright.plans import dialect
from fusewright.rules import evidence, incidents

EVENT = "event_id long, t long, event_type string, source_type string, entity_id string, entity_name string, region string, lat double, lon double, severity_rank int, tags array<string>, title string, description string, payload string"
CASES: dict[str, tuple[Callable[[SparkSession], DataFrame], str, list]] = {}
RAISED = "trigger_id long, title string, severity_rank int, n1 long, n2 long, n3 long"


def events(spark: SparkSession, rows: list[dict]) -> DataFrame:
    plain = dict(t=10_000, source_type="x", entity_id=None, entity_name=None, region=None, lat=None, lon=None, severity_rank=1, tags=[], title=None, description=None, payload="{}")
    names = [x.split(" ")[0] for x in EVENT.split(", ")]
    return spark.createDataFrame([tuple({"event_id": i, **plain, **r}[n] for n in names) for i, r in enumerate(rows, 1)], EVENT)


def case(name: str, columns: str, expected: list):
    def keep(f):
        CASES[name] = (f, columns, expected)
        return f

    return keep


def _raised(df: DataFrame) -> DataFrame:
    return df.select(*(x.split(" ")[0] for x in RAISED.split(", ")))


def at(kind: str, lat: float = 10.0, lon: float = 10.0, **more) -> dict:
    return dict(event_type=kind, lat=lat, lon=lon, **more)


@case("rule_infra_attack", RAISED, [(75, "Infrastructure attack detected in IR", 3, 20, 50, 5), (76, "Infrastructure attack detected in IR", 3, 20, 50, 6)])
def _(spark):
    def many(n, kind, **more):
        return [dict(event_type=kind, t=10_000 + i, payload='{"country": "IR"}', **more) for i in range(n)]

    rows = many(20, "shodan_banner") + many(50, "bgp_anomaly") + many(4, "internet_outage")
    rows += [
        dict(event_type="internet_outage", t=10_200, title="Censorship anomaly in IR"),
        dict(event_type="internet_outage", t=10_300, payload='{"country": "Iran", "country_code": "IR"}'),
        dict(event_type="internet_outage", t=10_301, payload='{"country": "IQ"}'),
        # The first of each are over 300 seconds away.
        dict(event_type="internet_outage", t=10_301, payload='{"country": "IR"}'),
    ]
    return _raised(incidents.infra_attack(events(spark, rows)))


@case("rule_coordinated_shutdown", RAISED, [(65, "Coordinated internet shutdown in MM", 3, 50, 5, 10)])
def _(spark):
    rows = [dict(event_type=k, payload='{"country": "MM"}') for k, n in (("bgp_anomaly", 50), ("internet_outage", 5), ("censorship_event", 9)) for _ in range(n)]
    return _raised(incidents.coordinated_shutdown(events(spark, [*rows, dict(event_type="censorship_event", t=10_300, title="Blocked in MM")])))


@case(
    "rule_military_strike",
    RAISED,
    [(3, "Possible military strike near 10.0, 10.0", 4, 1, 1, 1), (8, "Possible military strike near 50.0, 50.0", 4, 1, 1, 1)],
)
def _(spark):
    rows = [
        at("flight_position", lat=10.5, source_type="opensky"),
        at("notam_event", lon=10.5, t=10_100),
        at("seismic_event", t=10_600, payload='{"mag": 3.9, "depth": 80}'),
        at("seismic_event", t=10_601, payload='{"mag": 3.0}'),  # the flight is past
        # A strong deep quake is natural; so there is no evidence.
        at("flight_position", 30.0, 30.0, tags=["military"]),
        at("notam_event", 30.0, 30.0),
        at("seismic_event", 30.0, 30.0, payload='{"magnitude": 4.0, "depth": 10}'),
        # The notice has no place; its region is the trigger's.
        at("seismic_event", 50.0, 50.0, region="EE", payload='{"mag": 5, "depth": 9.9}'),
        at("flight_position", 50.0, 50.0, t=9_990, entity_name="Mil 7"),
        dict(event_type="notam_event", region="EE", t=9_900),
        at("flight_position", 50.0, 51.6, t=9_990, entity_name="MIL 8"),  # 178 km of longitude at the equator, 114 here: outside
        at("flight_position", 50.0, 50.0, t=9_990, source_type="vatsim"),  # not military
    ]
    return _raised(incidents.military_strike(events(spark, rows)))


@case(
    "rule_confirmed_strike",
    RAISED,
    [(2, "Confirmed strike near unknown location", 3, 1, 1, None), (3, "Confirmed strike near Kherson", 3, 2, 1, None)],
)
def _(spark):
    rows = [at("conflict_event"), at("thermal_anomaly", lat=10.45, t=11_800), at("conflict_event", lat=10.4, t=11_801, payload='{"location": "Kherson"}'), at("thermal_anomaly", lat=10.46, t=9_999), at("thermal_anomaly", 20.0, 20.0)]
    rows[3] = at("thermal_anomaly", lat=11.0, t=9_999)
    # At 11,801 the first conflict is past 1,800 seconds, but the second hotspot isn't.
    rows[0]["t"] = 10_001
    return _raised(incidents.confirmed_strike(events(spark, rows)))


@case("rule_conflict_thermal", RAISED, [(4, "Sustained bombardment cluster near ME", 3, 3, 1, None)])
def _(spark):
    rows = [at("thermal_anomaly", t=1_000), at("thermal_anomaly", t=9_000), at("conflict_event", t=9_500), at("thermal_anomaly", t=22_600, region="ME"), at("thermal_anomaly", t=22_601, lat=-10.0)]
    return _raised(incidents.conflict_thermal_cluster(events(spark, rows)))


@case("rule_maritime_enforcement", RAISED, [(2, "Maritime enforcement activity near 10.0, 10.0", 2, 1, 1, None)])
def _(spark):
    return _raised(incidents.maritime_enforcement(events(spark, [at("vessel_position", lon=10.27), at("fishing_event", t=11_800), at("fishing_event", lon=10.8)])))


@case("rule_apt_staging", RAISED, [(2, "APT staging infrastructure: evil.example", 3, 1, 1, None), (4, "APT staging infrastructure: bad.example", 3, 1, 1, None)])
def _(spark):
    rows = [
        dict(event_type="cert_issued", payload='{"domain": "evil.example"}'),
        dict(event_type="threat_intel", t=13_600, payload='{"pulse_name": "Actor uses evil.example again"}'),
        dict(event_type="threat_intel", payload='{"indicators": ["http://bad.example/x", {"indicator": "1.2.3.4"}], "domain": "other.example"}'),
        dict(event_type="cert_issued", t=10_100, payload='{"common_name": "bad.example"}'),
        dict(event_type="cert_issued", t=13_601, payload='{"common_name": "lone.example"}'),
        dict(event_type="threat_intel", entity_id="quiet"),
    ]
    return _raised(incidents.apt_staging(events(spark, rows)))


@case(
    "rule_gps_military",
    "trigger_id long, title string, tag string, n1 long, n2 long, n3 long",
    [(3, "GPS jamming with military activity near ME", None, 1, 1, 1), (6, "GPS jamming with military activity near EE", "region:EE", 1, 1, 1)],
)
def _(spark):
    rows = [at("gps_interference", lat=11.3), at("flight_position", lat=9.0), at("notam_event", t=11_800, region="ME")]
    rows += [dict(event_type="gps_interference", region="EE"), dict(event_type="flight_position", region="EE"), dict(event_type="notam_event", region="EE", t=10_001)]
    return incidents.gps_military(events(spark, rows)).select("trigger_id", "title", "tag", "n1", "n2", "n3")


@case(
    "rule_osint_strike",
    "trigger_id long, title string, severity_rank int, confidence double, n1 long, n2 long, n3 long",
    [(2, "OSINT-confirmed strike near Odesa", 3, 0.75, 1, 1, 0), (5, "OSINT-confirmed strike near ME", 4, 0.9, 1, 1, 1)],
)
def _(spark):
    rows = [
        at("telegram_message", severity_rank=2, title="Missile hits port"),
        at("news_article", lat=10.9, t=31_600, payload='{"country": "Odesa"}'),
        at("news_article", 30.0, 30.0),
        at("thermal_anomaly", 30.4, 30.0, t=9_000),
        at("bluesky_post", 30.0, 30.0, t=10_500, severity_rank=3, region="ME", payload='{"enrichment": {"state_changes": [{"to": "killed"}]}}'),
        at("telegram_message", 30.0, 30.0, t=10_500, severity_rank=1, title="Missile"),  # of too little severity
        at("telegram_message", 30.0, 30.0, t=10_500, severity_rank=4, title="Parade"),  # about no strike
    ]
    return incidents.osint_strike(events(spark, rows)).select("trigger_id", "title", "severity_rank", "confidence", "n1", "n2", "n3")


@case(
    "rule_military_surge",
    "trigger_id long, title string, severity_rank int, confidence double, tag string, n1 long",
    # Without any deviation the surge is of medium severity.
    [(17, "Military aircraft surge near 11.0, 11.0", 2, 0.4, "cell:5:5", 5), (18, "Military aircraft surge near 11.0, 11.0", 2, 0.4, "cell:5:5", 5)],
)
def _(spark):
    plane = lambda i, t, **more: at("flight_position", 10.1, 11.9, entity_id=f"hex{i}", t=t, tags=["military"], **more)
    # Twelve hours with one aircraft, then four more in the thirteenth: snapshots 1 and, at its first sighting, 1.
    rows = [plane(0, 3_600 * h) for h in range(13)] + [plane(i, 3_600 * 12 + 60 * i) for i in range(1, 5)]
    rows.append(plane(3, 3_600 * 12 + 600))  # the same five
    return incidents.military_surge(events(spark, rows)).select("trigger_id", "title", "severity_rank", "confidence", "tag", "n1")


@case("incidents_suppressed", "rule_id string, trigger_id long", [("confirmed_strike", 1), ("confirmed_strike", 3), ("confirmed_strike", 5), ("infra_attack", 6), ("infra_attack", 8)])
def _(spark):
    rows = [
        ("confirmed_strike", 1, 0, 10.0, 10.0, None),
        ("confirmed_strike", 2, 60, 10.4, 10.4, None),
        ("confirmed_strike", 3, 120, 10.5, 10.0, None),  # half a degree is not less
        ("confirmed_strike", 4, 21_600, 10.0, 10.0, None),
        ("confirmed_strike", 5, 21_601, 10.0, 9.9, None),
        ("infra_attack", 6, 0, None, None, "country:IR"),
        ("infra_attack", 7, 60, None, None, "country:IR"),
        ("infra_attack", 8, 60, None, None, "country:IQ"),
    ]
    full = [(r, i, t, "", 3, 0.5, None, lat, lon, tag, 1, 1, None) for r, i, t, lat, lon, tag in rows]
    ddl = "rule_id string, trigger_id long, t long, title string, severity_rank int, confidence double, region string, lat double, lon double, tag string, n1 long, n2 long, n3 long"
    return incidents.suppressed(spark.createDataFrame(full, ddl)).select("rule_id", "trigger_id")


@case("user_alerts", "rule_id int, event_id long", [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 2), (4, 1)])
def _(spark):
    rows = [
        dict(event_type="news_article", severity_rank=3, title="Port STRIKE", region="ME"),
        dict(event_type="geo_event", severity_rank=4, description="a strike again"),
        dict(event_type="news_article", severity_rank=0, region="EE"),
    ]
    rules = [(1, 3, ["strike"], None, None), (2, None, None, None, None), (3, 0, None, None, ["geo_event"]), (4, 0, None, ["ME"], None), (5, 0, [], None, None)]
    return incidents.alerts(events(spark, rows), spark.createDataFrame(rules, "rule_id int, min_rank int, keywords array<string>, regions array<string>, types array<string>"))


@case("alert_fatigue", "rule_id int, event_id long", [(1, 1), (1, 3), (1, 6), (2, 7)])
def _(spark):
    rows = [(1, 1, 0), (1, 2, 899), (1, 3, 900), (1, 4, 1_800), (1, 5, 3_599), (1, 6, 3_600), (2, 7, 10)]
    return incidents.fatigue(spark.createDataFrame(rows, "rule_id int, event_id long, t long"), cooldown_minutes=15, per_hour=2).select("rule_id", "event_id")


@case("escalated_severities", "event_id long, severity_rank int", [(1, 3), (2, 2), (3, 1), (4, 4), (5, 1), (6, 1)])
def _(spark):
    said = lambda score, *changes: '{"enrichment": {"relevance_score": %s, "state_changes": [%s]}}' % (score, ", ".join('{"to": "%s", "certainty": "%s"}' % x for x in changes))
    rows = [
        dict(event_type="x", payload=said(0.7, ("killed", "confirmed"))),
        dict(event_type="x", payload=said(0.9, ("promoted", "alleged"), ("killed", "rumored"))),
        dict(event_type="x", payload=said(0.69, ("killed", "confirmed"))),
        dict(event_type="x", severity_rank=4, payload=said(0.9, ("captured", "confirmed"))),
        dict(event_type="x", payload=said(0.9, ("killed", "denied"))),
        dict(event_type="x", payload=said(0.9)),
    ]
    return events(spark, rows).select("event_id", incidents.escalated_rank(F.col("payload"), F.col("severity_rank")).alias("severity_rank"))


#: The driver's events in a few places close together, so that boxes of 50 km hold some.
_PLACED = "SELECT event_id, t, source_type, entity_id, 40 + (event_id * 37 % 100) / CAST(20 AS DOUBLE) AS lat, 10 + (event_id * 91 % 100) / CAST(20 AS DOUBLE) AS lon FROM ev"


def near_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events lie within 50 km and 6 hours before each error, by cells."""
    rows = dialect.run(spark, sf_dir, f"WITH EV {_PLACED}")
    return evidence.counted(evidence.near(rows.where("source_type = 'error'"), rows, 50, 21_600), "n")


def running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and purchases of each user in the ten days up to each event, by overlapping cells of time."""
    rows = dialect.run(spark, sf_dir, f"WITH EV {_PLACED}")
    out = evidence.running_counts(rows, "entity_id", {"errors": F.col("source_type") == "error", "purchases": F.col("source_type") == "purchase"}, 864_000)
    return out.select("event_id", "errors", "purchases")


_NEAR_SQL = f"""WITH EV, p AS ({_PLACED})
SELECT a.event_id AS trigger_id, CAST(count(*) AS BIGINT) AS n FROM p a JOIN p b ON b.t <= a.t AND b.t >= a.t - 21600 AND b.lat >= a.lat - 50 / 111e0 AND b.lat <= a.lat + 50 / 111e0
AND b.lon >= a.lon - 50 / (111e0 * greatest(abs(cos(radians(a.lat))), 0.01)) AND b.lon <= a.lon + 50 / (111e0 * greatest(abs(cos(radians(a.lat))), 0.01)) WHERE a.source_type = 'error' GROUP BY a.event_id"""
_RUNNING_SQL = f"""WITH EV, p AS ({_PLACED})
SELECT a.event_id, CAST(count(CASE WHEN b.source_type = 'error' THEN 1 END) AS BIGINT) AS errors, CAST(count(CASE WHEN b.source_type = 'purchase' THEN 1 END) AS BIGINT) AS purchases
FROM p a JOIN p b ON a.entity_id = b.entity_id AND b.t <= a.t AND b.t >= a.t - 864000 GROUP BY a.event_id"""


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return CASES[name][0](spark)


def frames() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: partial(run, name=n) for n in CASES} | {"evidence_near": near_counts, "evidence_running": running_counts}


def oracle() -> dict[str, str]:
    return {n: expected_sql(columns, rows) for n, (_, columns, rows) in CASES.items()} | {"evidence_near": dialect.render(_NEAR_SQL), "evidence_running": dialect.render(_RUNNING_SQL)}

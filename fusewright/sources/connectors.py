"""Connectors: raw records to canonical events, declared as expressions that Spark and the SQL check both run.

normalise() applies one to any frame with its raw columns: a projection and a filter, so that column pruning
and pushed filters reach the reader; a connector with a key keeps the first of the rows that share it, which
Spark cuts to one row a key before the shuffle. Missing values give null, an empty frame an empty one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from fusewright.functions import lookups as L

CANONICAL = ["event_time", "source_type", "source_id", "latitude", "longitude", "entity_id", "entity_name", "event_type", "severity", "confidence", "tags", "title"]

# The connectors' word lists.
CRITICAL_WORDS = ["strike", "missile", "nuclear", "irgc", "idf", "drone", "explosion", "attack", "natanz", "fordow", "isfahan", "hormuz", "bandar abbas", "breaking", "urgent"]
HIGH_WORDS = ["military", "airstrike", "bombing", "casualties", "intercept", "mobilization", "escalation", "retaliation", "sanctions", "radar", "submarine", "warship", "convoy", "airspace"]
MILITARY_SIGNS = ["REACH", "RCH", "JAKE", "ETHYL", "NCHO", "FORTE", "HOMER", "SENTRY", "GORDO", "IAF", "EVAC", "NATO", "TOPPS", "LAGR", "VIPER", "DUKE"]
MILITARY_SHIPS = ["338", "369", "422"]
PIRACY_CRITICAL = ["hijack", "kidnap", "missile", "torpedo", "explosion"]
PIRACY_CONFLICT = ["hijack", "kidnap", "fired", "missile"]
PIRACY_HIGH = ["fired", "rpg", "shot", "gun", "ak-47", "ak 47", "automatic weapon"]
PIRACY_MEDIUM = ["knife", "knives", "machete"]


class Connector(NamedTuple):
    """fields: canonical (or further) column to expression; keep: rows that become events; keyed: first row of a source_id stays, by seq."""

    raw: str
    fields: dict[str, str]
    keep: str = "true"
    keyed: bool = False


def above(value: str, *steps: tuple[float, str], otherwise: str) -> str:
    """Severity by the first step that the value is above."""
    return "CASE " + " ".join(f"WHEN {value} > {at} THEN '{s}'" for at, s in steps) + f" ELSE '{otherwise}' END"


def _time(day: str, clock: str = "'0000'") -> str:
    """A day 'yyyy-MM-dd' and a clock time 'HHmm' (zeros may be missing) as a time without zone."""
    c = f"lpad({clock}, 4, '0')"
    return f"CAST({day} || ' ' || substr({c}, 1, 2) || ':' || substr({c}, 3, 2) || ':00' AS TIMESTAMP_NTZ)"


_MILITARY_FLIGHT = f"coalesce(known_military, coalesce(db_flags, 0) % 2 = 1 OR {L.starts_with_any('flight', MILITARY_SIGNS)})"
_HIGH_VALUE = "coalesce(upper(trim(type_code)) IN (" + ", ".join(f"'{t}'" for t in L.HIGH_VALUE_TYPES) + "), false)"
_FLIGHT_COUNTRY = f"coalesce({L.callsign_country('flight')}, {L.hex_country('hex')})"
_MILITARY_SHIP = L.starts_with_any("CAST(mmsi AS STRING)", MILITARY_SHIPS)
_SHIP_TAGS = f"concat_ws(',', CASE WHEN {_MILITARY_SHIP} THEN 'military,naval' END, 'affiliation:' || {L.ship_country('mmsi')})"
_SATELLITE = "CASE satellite WHEN 'N' THEN 'NOAA-20' WHEN '1' THEN 'NOAA-21' WHEN 'SN' THEN 'Suomi NPP' ELSE coalesce(satellite, 'unknown') END"
_EXPLOSION = "(lower(coalesce(kind, '')) IN ('explosion', 'mining explosion') OR coalesce(depth = 0, false) OR (coalesce(depth < 5 AND magnitude < 4, false) AND lower(coalesce(kind, '')) <> 'earthquake'))"
_TONE = "CASE WHEN tone < -5 THEN 'high' WHEN tone < -2 THEN 'medium' ELSE 'low' END"
_CATEGORY_RANK = "CASE WHEN category IN ('4', '5') THEN 3 WHEN category = '3' THEN 2 ELSE 1 END"
_PIRACY_RANK = f"CASE WHEN {L.any_of('sitrep', PIRACY_CRITICAL)} THEN 4 WHEN {L.any_of('sitrep', PIRACY_HIGH)} THEN greatest(3, {_CATEGORY_RANK}) WHEN {L.any_of('sitrep', PIRACY_MEDIUM)} THEN greatest(2, {_CATEGORY_RANK}) ELSE {_CATEGORY_RANK} END"
_POINT = "'POINT *[(] *(-?[0-9.]+) +(-?[0-9.]+) *[)]'"
_WKT = {"latitude": f"CAST(nullif(regexp_extract(wkt, {_POINT}, 2), '') AS DOUBLE)", "longitude": f"CAST(nullif(regexp_extract(wkt, {_POINT}, 1), '') AS DOUBLE)"}
_PLACE = {"latitude": "lat", "longitude": "lon"}

CONNECTORS = {
    "acled": Connector(
        "day string, notes string, fatalities long, actor1 string, actor2 string, lat double, lon double",
        {"event_time": _time("day"), "source_id": "'acled'", "event_type": "'conflict_event'", "severity": above("fatalities", (10, "critical"), (0, "high"), otherwise="medium"), "tags": "concat_ws(',', 'actor:' || nullif(actor1, ''), 'actor:' || nullif(actor2, ''))", "title": "notes", **_PLACE},
    ),
    "adsb": Connector(
        "hex string, flight string, type_code string, lat double, lon double, alt_baro string, alt_geom double, db_flags long, known_military boolean",
        {
            "event_type": "'flight_position'", "entity_id": "hex", "entity_name": "nullif(trim(flight), '')", "severity": f"CASE WHEN {_MILITARY_FLIGHT} THEN 'medium' ELSE 'low' END", "tags": f"concat_ws(',', CASE WHEN {_MILITARY_FLIGHT} THEN 'military' END, CASE WHEN {_HIGH_VALUE} THEN 'high_value' END, 'affiliation:' || {_FLIGHT_COUNTRY}, 'type:' || nullif(trim(type_code), ''))",
            "altitude": "coalesce(alt_geom, CASE WHEN alt_baro = 'ground' THEN CAST(0 AS DOUBLE) ELSE CAST(alt_baro AS DOUBLE) END)",
            "affiliation": _FLIGHT_COUNTRY, "high_value": _HIGH_VALUE, **_PLACE,
        },
        keep="lat IS NOT NULL AND lon IS NOT NULL",
    ),
    "ais": Connector(
        "mmsi long, ship_name string, lat double, lon double, heading long, speed double",
        {
            "event_type": "'vessel_position'", "entity_id": "CAST(mmsi AS STRING)", "entity_name": "nullif(trim(ship_name), '')", "severity": f"CASE WHEN {_MILITARY_SHIP} THEN 'medium' ELSE 'low' END",
            "latitude": "coalesce(lat, CAST(0 AS DOUBLE))", "longitude": "coalesce(lon, CAST(0 AS DOUBLE))", "heading": "nullif(heading, 511)", "affiliation": L.ship_country("mmsi"), "tags": _SHIP_TAGS,
        },
        keep="mmsi IS NOT NULL",
    ),
    "ais_static": Connector(
        "mmsi long, ship_name string, ship_type long, destination string, bow long, stern long, port long, starboard long, lat double, lon double",
        {
            "source_type": "'ais'", "event_type": "'vessel_position'", "entity_id": "CAST(mmsi AS STRING)", "entity_name": "nullif(trim(ship_name), '')", "severity": f"CASE WHEN {_MILITARY_SHIP} THEN 'medium' ELSE 'low' END",
            "latitude": "coalesce(lat, CAST(0 AS DOUBLE))", "longitude": "coalesce(lon, CAST(0 AS DOUBLE))", "affiliation": L.ship_country("mmsi"), "tags": _SHIP_TAGS, "ship_type": "CAST(coalesce(ship_type, 0) AS BIGINT)", "destination": "trim(coalesce(destination, ''))",
            "ship_length": "CAST(coalesce(bow, 0) + coalesce(stern, 0) AS BIGINT)", "ship_width": "CAST(coalesce(port, 0) + coalesce(starboard, 0) AS BIGINT)",
        },
        keep="mmsi IS NOT NULL",
    ),
    "firms": Connector(
        "lat double, lon double, frp double, confidence_code string, satellite string, acq_date string, acq_time string, seq long",
        {
            "event_time": _time("acq_date", "acq_time"),
            "source_id": "'firms:' || coalesce(satellite, 'unknown') || ':' || coalesce(acq_date, '') || ':' || coalesce(acq_time, '') || ':' || CAST(CAST(round(lat * 10000) AS BIGINT) AS STRING) || ':' || CAST(CAST(round(lon * 10000) AS BIGINT) AS STRING)",
            "event_type": "'thermal_anomaly'", "severity": above("frp", (100, "high"), (50, "medium"), otherwise="low"), "confidence": "CASE confidence_code WHEN 'h' THEN 0.9e0 ELSE 0.6e0 END", "tags": f"'fire,' || {_SATELLITE}", **_PLACE,
        },
        keep="confidence_code IN ('h', 'n') AND lat IS NOT NULL AND lon IS NOT NULL",
        keyed=True,
    ),
    "usgs": Connector(
        "id string, magnitude double, depth double, kind string, place string, lat double, lon double, seq long",
        {"source_id": "id", "entity_id": "id", "event_type": "'seismic_event'", "severity": "CASE WHEN " + _EXPLOSION + " THEN 'critical' ELSE " + above("magnitude", (5, "high"), (3, "medium"), otherwise="low") + " END", "tags": f"concat_ws(',', CASE WHEN {_EXPLOSION} THEN 'potential_explosion' END, CASE WHEN depth < 5 THEN 'shallow' END)", "title": "place", **_PLACE},
        keep="id IS NOT NULL",
        keyed=True,
    ),
    "gdacs": Connector(
        "code string, eventid long, alert string, name string, lat double, lon double, seq long",
        {
            "source_id": "'gdacs:' || coalesce(code, 'UN') || ':' || CAST(eventid AS STRING)", "entity_id": "'gdacs-' || lower(coalesce(code, 'UN')) || '-' || CAST(eventid AS STRING)", "entity_name": "name",
            "event_type": "CASE upper(code) WHEN 'EQ' THEN 'seismic_event' WHEN 'WF' THEN 'thermal_anomaly' ELSE 'geo_event' END", "severity": "CASE lower(alert) WHEN 'red' THEN 'critical' WHEN 'orange' THEN 'high' WHEN 'green' THEN 'medium' ELSE 'low' END", **_PLACE,
        },
        keep="eventid IS NOT NULL",
        keyed=True,
    ),
    "geoconfirmed": Connector(
        "id string, icon string, lat double, lon double",
        {"source_id": "'geoconfirmed:' || id", "entity_id": "id", "event_type": "'geo_event'", "severity": "CASE WHEN icon LIKE '%/True/%' THEN 'high' ELSE 'medium' END", **_PLACE},
    ),
    "gdelt": Connector(
        "url string, headline string, tone double, seen string",
        {"event_time": _time("substr(seen, 1, 4) || '-' || substr(seen, 5, 2) || '-' || substr(seen, 7, 2)", "substr(seen, 10, 4)"), "source_id": "nullif(url, '')", "event_type": "'news_article'", "severity": _TONE, "title": "nullif(headline, '')"},
    ),
    "gdelt_geo": Connector("name string, tone double, lat double, lon double", {"event_type": "'geo_news'", "severity": _TONE, "title": "name", **_PLACE}),
    "gpsjam": Connector(
        "h3 string, percentage double, lat double, lon double",
        {"source_id": "h3", "entity_id": "h3", "event_type": "'gps_interference'", "severity": above("percentage", (50, "critical"), (30, "high"), (15, "medium"), otherwise="low"), "confidence": "percentage / 100e0", **_PLACE},
        keep="percentage >= 10",
    ),
    "cloudflare": Connector(
        "country string, kind string, started string, is_anomaly boolean",
        {
            "source_id": "CASE WHEN is_anomaly THEN 'cf-anomaly:' ELSE 'cf-outage:' END || country || ':' || kind || ':' || started", "event_type": "'internet_outage'", "severity": "CASE WHEN is_anomaly THEN 'medium' ELSE 'high' END",
            "title": "'Internet outage: ' || country || ' (' || CASE WHEN is_anomaly THEN 'traffic_anomaly' ELSE kind END || ')'",
        },
    ),
    "cloudflare_bgp": Connector("leak_id string, leak_asn long", {"source_id": "leak_id", "entity_id": "CAST(leak_asn AS STRING)", "entity_name": "'AS' || CAST(leak_asn AS STRING)", "event_type": "'bgp_leak'", "severity": "'high'"}),
    "ioda": Connector(
        "entity_code string, signal string, observed long, level string, value double, history_value double, seq long",
        {"source_id": "'ioda:' || entity_code || ':' || signal || ':' || CAST(observed AS STRING)", "entity_id": "entity_code", "event_type": "'internet_outage'", "severity": "CASE WHEN level = 'critical' THEN 'high' ELSE 'medium' END", "ratio": "value / history_value"},
        keep="level <> 'normal' AND history_value > 0 AND entity_code IS NOT NULL AND signal IS NOT NULL AND observed IS NOT NULL",
        keyed=True,
    ),
    "otx": Connector("id string, name string, adversary string", {"source_id": "nullif(id, '')", "event_type": "'threat_intel'", "severity": "CASE WHEN coalesce(adversary, '') <> '' THEN 'high' ELSE 'medium' END", "title": "nullif(name, '')"}),
    "certstream": Connector("domain string, issuer string, pattern string", {"entity_id": "domain", "entity_name": "issuer", "event_type": "'cert_issued'", "severity": "'low'", "title": "'Certificate issued: ' || domain"}, keep="domain LIKE '%' || pattern || '%'"),
    "ooni": Connector(
        "uid string, input string, country string, is_anomaly boolean, is_confirmed boolean",
        {"source_id": "nullif(uid, '')", "event_type": "'censorship_event'", "severity": "CASE WHEN is_confirmed THEN 'high' ELSE 'medium' END", "title": "'Censorship ' || CASE WHEN is_confirmed THEN 'confirmed' ELSE 'anomaly' END || ': ' || coalesce(input, '') || ' in ' || country"},
        keep="is_anomaly OR is_confirmed",
    ),
    "nuclear": Connector(
        "id long, cpm double, place string, lat double, lon double",
        {"source_id": "'nuclear'", "entity_id": "CAST(id AS STRING)", "entity_name": "place", "event_type": "'nuclear_event'", "severity": above("cpm", (100, "critical"), (50, "high"), otherwise="low"), **_PLACE},
    ),
    "gfw": Connector(
        "id string, kind string, vessel_id string, vessel_name string, lat double, lon double",
        {"source_id": "id", "entity_id": "vessel_id", "entity_name": "vessel_name", "event_type": "'fishing_event'", "severity": "'low'", "title": "kind || ': ' || coalesce(vessel_name, 'unknown')", **_PLACE},
        keep="lat IS NOT NULL AND lon IS NOT NULL",
    ),
    "telegram": Connector(
        "channel string, message_id long, body string",
        {"source_id": "'tg:' || channel || ':' || CAST(message_id AS STRING)", "event_type": "'telegram_message'", "severity": f"CASE WHEN {L.any_of('body', CRITICAL_WORDS)} THEN 'critical' WHEN {L.any_of('body', HIGH_WORDS)} THEN 'high' ELSE 'medium' END", "title": "channel || ': ' || substr(body, 1, 100)"},
    ),
    "imb_piracy": Connector(
        "incident string, category string, sitrep string, lat double, lon double",
        {"source_id": "incident", "entity_id": "incident", "event_type": f"CASE WHEN {L.any_of('sitrep', PIRACY_CONFLICT)} THEN 'conflict_event' ELSE 'maritime_security' END", "severity": f"CASE {_PIRACY_RANK} WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END", **_PLACE},
    ),
    "copernicus": Connector(
        "code string, name string, category string, is_closed boolean, aois long, products long, wkt string, seq long",
        {
            "source_id": "'copernicus:' || code", "entity_id": "'copernicus:' || code", "entity_name": "name", "title": "name",
            "event_type": "CASE WHEN lower(category) IN ('wildfire', 'fire') THEN 'thermal_anomaly' WHEN lower(category) IN ('earthquake', 'tsunami') THEN 'seismic_event' ELSE 'geo_event' END",
            "severity": "CASE WHEN is_closed THEN 'medium' WHEN lower(category) IN ('earthquake', 'volcano', 'tsunami') OR aois >= 5 OR products >= 10 THEN 'high' WHEN aois >= 2 OR products >= 3 THEN 'medium' ELSE 'low' END", **_WKT,
        },
        keep="code IS NOT NULL",
        keyed=True,
    ),
}

_TYPES = {"event_time": "TIMESTAMP_NTZ", "latitude": "DOUBLE", "longitude": "DOUBLE", "confidence": "DOUBLE"}


def select(name: str, raw: str) -> str:
    """The connector as one query over the relation `raw`; tags stay joined by commas."""
    c = CONNECTORS[name]
    fields = {"source_type": f"'{name}'", **c.fields}
    columns = [n for n in CANONICAL if n != "tags"] + [n for n in fields if n not in CANONICAL]
    made = [f"{fields[n] if n in fields else f'CAST(NULL AS {_TYPES.get(n, "STRING")})'} AS {n}" for n in columns] + [f"{fields.get('tags', "''")} AS tags"]
    names = ", ".join([*columns, "tags"])
    if not c.keyed:
        return f"SELECT {', '.join(made)} FROM {raw} WHERE {c.keep}"
    turn = "row_number() OVER (PARTITION BY source_id ORDER BY seq) AS turn_"
    return f"SELECT {names} FROM (SELECT *, {turn} FROM (SELECT {', '.join(made)}, seq FROM {raw} WHERE {c.keep}) AS made) AS told WHERE turn_ = 1"


def normalise(raw: DataFrame, name: str) -> DataFrame:
    """Canonical events of a frame with the connector's raw columns (others are ignored); tags become an array."""
    from pyspark.sql import functions as F

    made = raw.sparkSession.sql(select(name, "{raw}"), raw=raw)
    return made.withColumn("tags", F.when(F.col("tags") == "", F.array().cast("array<string>")).otherwise(F.split("tags", ",")))

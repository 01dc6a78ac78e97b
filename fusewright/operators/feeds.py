"""Each connector over raw records made from the driver's tables: one text for both engines."""

from fusewright.sources.connectors import CONNECTORS, select

_E = "SELECT event_id AS n, value AS v, user_id AS u, event_type AS kind, event_id AS seq, CASE WHEN event_id % 13 = 0 THEN NULL ELSE ((event_id * 37) % 1800) / 10e0 - 90 END AS lat, ((event_id * 91) % 3600) / 10e0 - 180 AS lon FROM {events}"
_DAY = "'2024-01-' || lpad(CAST(n % 28 + 1 AS STRING), 2, '0')"
_WORDS = "CASE n % 7 WHEN 0 THEN 'Missile over the bay' WHEN 1 THEN 'Warship and convoy seen' WHEN 2 THEN 'two men with a KNIFE' WHEN 3 THEN 'Crew was fired upon' WHEN 4 THEN 'hijack reported' WHEN 5 THEN NULL ELSE 'quiet day' END"

#: Raw columns of each connector, made of the rows above.
RAW = {
    "acled": f"{_DAY} AS day, 'note ' || kind AS notes, n % 15 AS fatalities, CASE WHEN n % 3 = 0 THEN '' ELSE 'a' || CAST(u AS STRING) END AS actor1, CASE WHEN n % 2 = 0 THEN kind END AS actor2, lat, lon",
    "adsb": "CASE n % 5 WHEN 0 THEN 'AE01CE' WHEN 1 THEN '43c0d1' WHEN 2 THEN '7380ff' WHEN 3 THEN 'zz' ELSE '10001' END AS hex, CASE n % 6 WHEN 0 THEN 'rch401 ' WHEN 1 THEN 'BAW12' WHEN 2 THEN 'Ascot1' WHEN 3 THEN NULL WHEN 4 THEN '' ELSE 'NATO07' END AS flight, CASE n % 4 WHEN 0 THEN 'k35r ' WHEN 1 THEN 'A320' WHEN 2 THEN NULL ELSE 'E3' END AS type_code, lat, lon, CASE n % 3 WHEN 0 THEN 'ground' WHEN 1 THEN '3500' END AS alt_baro, CASE WHEN n % 4 = 1 THEN v END AS alt_geom, n % 3 AS db_flags, CASE WHEN n % 11 = 0 THEN false WHEN n % 12 = 0 THEN true END AS known_military",
    "ais": "CASE n % 5 WHEN 0 THEN 338000000 WHEN 1 THEN 273000000 WHEN 2 THEN 422000000 WHEN 3 THEN 100000000 ELSE 235000000 END + n AS mmsi, CASE WHEN n % 3 = 0 THEN ' ' ELSE kind END AS ship_name, lat, lon, CASE WHEN n % 2 = 0 THEN 511 ELSE n % 360 END AS heading, v AS speed",
    "ais_static": "CASE n % 3 WHEN 0 THEN 338000000 WHEN 1 THEN 273000000 ELSE 100000000 END + n AS mmsi, kind AS ship_name, n % 90 AS ship_type, CASE WHEN n % 4 > 0 THEN ' ' || kind END AS destination, CASE WHEN n % 5 > 0 THEN n % 200 END AS bow, n % 40 AS stern, n % 20 AS port, CASE WHEN n % 7 > 0 THEN n % 15 END AS starboard, lat, lon",
    "firms": f"round(lat) AS lat, round(lon) AS lon, v * 2 AS frp, CASE n % 3 WHEN 0 THEN 'l' WHEN 1 THEN 'n' ELSE 'h' END AS confidence_code, CASE n % 4 WHEN 0 THEN 'N' WHEN 1 THEN '1' WHEN 2 THEN 'SN' END AS satellite, {_DAY} AS acq_date, CAST(n % 10 * 100 + n % 60 AS STRING) AS acq_time, seq",
    "usgs": "'us' || CAST(n % 400 AS STRING) AS id, v / 15 AS magnitude, CASE WHEN n % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE v END AS depth, CASE n % 9 WHEN 0 THEN 'Explosion' WHEN 1 THEN NULL WHEN 2 THEN 'quarry blast' ELSE 'earthquake' END AS kind, 'p' || CAST(u AS STRING) AS place, lat, lon, seq",
    "gdacs": "CASE n % 6 WHEN 0 THEN 'EQ' WHEN 1 THEN 'WF' WHEN 2 THEN 'tc' WHEN 3 THEN NULL ELSE 'FL' END AS code, n % 300 AS eventid, CASE n % 5 WHEN 0 THEN 'Red' WHEN 1 THEN 'orange' WHEN 2 THEN 'Green' WHEN 3 THEN NULL ELSE 'x' END AS alert, kind AS name, lat, lon, seq",
    "geoconfirmed": "CAST(n AS STRING) AS id, CASE WHEN n % 3 = 0 THEN '/icons/True/12.png' ELSE '/icons/False/12.png' END AS icon, lat, lon",
    "gdelt": "CASE WHEN n % 5 = 0 THEN '' ELSE 'https://n/' || CAST(n AS STRING) END AS url, CASE WHEN n % 4 = 0 THEN '' ELSE kind END AS headline, 4 - v / 5 AS tone, '202401' || lpad(CAST(n % 28 + 1 AS STRING), 2, '0') || 'T' || lpad(CAST(n % 24 AS STRING), 2, '0') || '1500Z' AS seen",
    "gdelt_geo": "kind AS name, 4 - v / 5 AS tone, lat, lon",
    "gpsjam": "'h' || CAST(n AS STRING) AS h3, v AS percentage, lat, lon",
    "cloudflare": f"'C' || CAST(u % 9 AS STRING) AS country, kind, {_DAY} AS started, n % 2 = 0 AS is_anomaly",
    "cloudflare_bgp": "CAST(n AS STRING) AS leak_id, CASE WHEN n % 4 > 0 THEN u END AS leak_asn",
    "ioda": "'C' || CAST(u % 9 AS STRING) AS entity_code, kind AS signal, n % 50 AS observed, CASE n % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'critical' ELSE 'warning' END AS level, v AS value, CAST(n % 5 AS DOUBLE) AS history_value, seq",
    "otx": "CASE WHEN n % 5 = 0 THEN '' ELSE CAST(n AS STRING) END AS id, kind AS name, CASE n % 3 WHEN 0 THEN 'group' WHEN 1 THEN '' END AS adversary",
    "certstream": "kind || '.example' AS domain, 'ca' AS issuer, CASE WHEN n % 2 = 0 THEN 'err' ELSE '.example' END AS pattern",
    "ooni": "CASE WHEN n % 5 = 0 THEN '' ELSE CAST(n AS STRING) END AS uid, CASE WHEN n % 4 > 0 THEN kind END AS input, 'SY' AS country, n % 2 = 0 AS is_anomaly, n % 3 = 0 AS is_confirmed",
    "nuclear": "n AS id, v * 1.5e0 AS cpm, kind AS place, lat, lon",
    "gfw": "CAST(n AS STRING) AS id, kind, CAST(u AS STRING) AS vessel_id, CASE WHEN n % 3 > 0 THEN 'v' || CAST(u AS STRING) END AS vessel_name, lat, lon",
    "telegram": f"kind AS channel, n AS message_id, {_WORDS} AS body",
    "imb_piracy": f"CAST(n AS STRING) AS incident, CAST(n % 6 AS STRING) AS category, {_WORDS} AS sitrep, lat, lon",
    "copernicus": "'E' || CAST(n % 200 AS STRING) AS code, kind AS name, CASE n % 5 WHEN 0 THEN 'Flood' WHEN 1 THEN 'Wildfire' WHEN 2 THEN 'Tsunami' WHEN 3 THEN NULL ELSE 'Volcano' END AS category, n % 4 = 0 AS is_closed, n % 7 AS aois, n % 12 AS products, CASE WHEN n % 3 = 0 THEN 'no place' ELSE 'POINT (' || CAST(u AS STRING) || '.5 -12.25)' END AS wkt, seq",
}


def _query(name: str) -> str:
    further = [f for f in CONNECTORS[name].fields if f in ("altitude", "affiliation", "high_value", "heading", "ratio", "ship_type", "destination", "ship_length", "ship_width")]
    shown = ["CAST(event_time AS STRING) AS event_time", "source_id", "latitude", "longitude", "entity_id", "entity_name", "event_type", "severity", "confidence", "tags", "title", *further]
    return f"WITH e AS ({_E}), raw AS (SELECT {RAW[name]} FROM e) SELECT {', '.join(shown)} FROM ({select(name, 'raw')}) AS made"


QUERIES = {f"feed_{name}": _query(name) for name in CONNECTORS}

"""What of a stream is shown, kept or skipped: by zoom, place, importance and routine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Event types by what is made of them: shown one by one, or summed up every so many seconds.
HIGH_VOLUME = {"flight_position": 30, "vessel_position": 30, "thermal_anomaly": 60, "bgp_anomaly": 60, "cert_issued": 60, "shodan_banner": 60, "shodan_count": 60, "source_health": 60}
#: Event types that pass the filter of importance whatever their severity.
PASSING = (
    "nuclear_event", "gps_interference", "news_article", "geo_news", "geo_event", "thermal_anomaly", "censorship_event", "notam_event", "telegram_message", "bluesky_post",
    "threat_intel", "internet_outage", "fishing_event", "bgp_leak", "source_health",
)
#: Ranges of the parameters that a request may give.
CLAMPS = {"zoom": (0.0, 22.0), "lat": (-90.0, 90.0), "lon": (-180.0, 180.0), "hours": (0.0, 8760.0), "radius_km": (0.0, 40075.0)}


def clamped(x: Column, name: str) -> Column:
    low, high = CLAMPS[name]
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def zoom_filter(zoom: Column) -> tuple[Column, Column]:
    """Least severity rank and number of events at a zoom; null: as when close."""
    z = clamped(zoom, "zoom")
    return F.when(z < 4, 3).when(z < 7, 2).otherwise(0), F.when(z < 4, 100).when(z < 7, 300).otherwise(500)


def padded_box(west: Column, south: Column, east: Column, north: Column) -> Column:
    """A viewport widened by a fifth on each side, within the world."""
    w, e, s, n = clamped(west, "lon"), clamped(east, "lon"), clamped(south, "lat"), clamped(north, "lat")
    x, y = (e - w) * 0.2, (n - s) * 0.2
    return F.struct(F.greatest(w - x, F.lit(-180.0)).alias("west"), F.greatest(s - y, F.lit(-90.0)).alias("south"), F.least(e + x, F.lit(180.0)).alias("east"), F.least(n + y, F.lit(90.0)).alias("north"))


def json_number(payload: Column, path: str) -> Column:
    """A number, or text that is one; else null."""
    return F.get_json_object(payload, path).try_cast("double")


def is_interesting_vessel(source_type: Column, payload: Column, speed: Column) -> Column:
    """Whether a position is worth showing: any but ships', and ships that are military, of a kind that matters, or fast."""
    kind = F.get_json_object(payload, "$.ship_type").try_cast("int")
    military = F.coalesce(F.get_json_object(payload, "$.is_military") == "true", F.lit(False))
    of_kind = F.coalesce((kind == 35) | kind.between(50, 59) | kind.between(70, 89), F.lit(False))
    return (source_type != "ais") | military | of_kind | (F.coalesce(speed, F.lit(0.0)) > 15)


def is_important(event_type: Column, severity_rank: Column, payload: Column) -> Column:
    fatal = F.coalesce(json_number(payload, "$.fatalities") > 0, F.lit(False))
    strong = F.coalesce(json_number(payload, "$.magnitude") >= 4.0, F.lit(False))
    return (severity_rank >= 3) | F.when(event_type == "conflict_event", fatal).when(event_type == "seismic_event", strong).otherwise(event_type.isin(*PASSING))


def is_routine(event_type: Column, severity_rank: Column, tags: Column, payload: Column) -> Column:
    """Whether an event of a high-volume type is too common to make situations of."""
    emergency = F.coalesce(~F.get_json_object(payload, "$.emergency").isin("none", ""), F.lit(False))
    flight = F.exists(tags, lambda t: t.isin("military", "high_value")) | emergency | (severity_rank >= 3)
    vessel = F.exists(tags, lambda t: t.contains("dark") | t.contains("violation") | t.contains("enforcement")) | (severity_rank >= 3)
    return F.when(event_type == "flight_position", ~flight).when(event_type == "vessel_position", ~vessel).when(event_type == "thermal_anomaly", severity_rank < 3).otherwise(event_type.isin("cert_issued", "shodan_banner"))


def summary_seconds(event_type: Column) -> Column:
    """Seconds between summaries of a high-volume type, null for others."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in HIGH_VOLUME.items() for x in pair)), event_type)


def position_tier(source_type: Column, payload: Column, flights: tuple) -> Column:
    """0 to 4: of high value, military of a known side, military, ships, others."""
    flag = lambda n: F.coalesce(F.get_json_object(payload, f"$.{n}") == "true", F.lit(False))
    side = F.coalesce(F.get_json_object(payload, "$.affiliation") != "", F.lit(False))
    flight = source_type.isin(*flights) | source_type.contains("flight")
    return F.when(flag("high_value"), 0).when(flag("military") & side, 1).when(flag("military"), 2).when(~flight, 3).otherwise(4)

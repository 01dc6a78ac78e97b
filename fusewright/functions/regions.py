"""Regions of the world: from coordinates, codes and names, and the places that stand for a whole region."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Boxes (south, north, west, east, region), the first that holds a point names its region.
BOXES = [
    (12.0, 42.0, 25.0, 63.0, "middle-east"),
    (44.0, 60.0, 22.0, 50.0, "eastern-europe"),
    (35.0, 72.0, -12.0, 22.0, "western-europe"),
    (18.0, 55.0, 100.0, 150.0, "east-asia"),
    (-12.0, 25.0, 90.0, 140.0, "southeast-asia"),
    (5.0, 38.0, 60.0, 100.0, "south-asia"),
    (-35.0, 12.0, -18.0, 52.0, "africa"),  # its northern edge is outside
    (15.0, 37.0, -18.0, 25.0, "north-africa"),
    (15.0, 85.0, -170.0, -52.0, "north-america"),
    (-56.0, 15.0, -82.0, -34.0, "south-america"),
    (7.0, 23.0, -92.0, -59.0, "central-america"),
    (-50.0, 0.0, 110.0, 180.0, "oceania"),
    (35.0, 55.0, 50.0, 90.0, "central-asia"),
]
#: Countries (codes, then names) whose region is known.
COUNTRIES = {
    "eastern-europe": "UA RU",
    "middle-east": "IL PS SY IR LB IQ YE BH QA KW AE JO SA OM TR CY",
    "africa": "SD SO ET ER DJ LY EG",
    "southeast-asia": "MM TH VN LA KH PH MY SG ID",
    "east-asia": "TW CN KR KP JP",
}
COUNTRY_NAMES = {
    "eastern-europe": ["Ukraine", "Russia"],
    "middle-east": ["Iran", "Israel", "Syria", "Lebanon", "Yemen", "Iraq", "Jordan", "Palestine", "Saudi Arabia", "Bahrain", "Qatar", "Kuwait", "United Arab Emirates", "Oman", "Turkey", "Cyprus"],
    "africa": ["Sudan", "Somalia", "Ethiopia", "Eritrea", "Djibouti", "Libya", "Egypt"],
    "southeast-asia": ["Myanmar", "Thailand", "Vietnam", "Philippines"],
    "east-asia": ["Taiwan", "China", "South Korea", "North Korea", "Japan"],
}
#: Abbreviations and codes of regions and countries, by the region they are made into.
CANONICAL = {
    "middle-east": "ME IR IQ SY JO LB IL PS YE OM AE QA BH KW TR middle_east",
    "eastern-europe": "EE RU UA BY MD PL RO BG HU CZ SK eastern_europe",
    "western-europe": "WE DE FR GB IT ES NL BE AT CH SE NO DK FI IE PT western_europe",
    "africa": "AF",
    "southeast-asia": "SEA TH VN PH MM KH MY SG ID southeast_asia",
    "east-asia": "EA AS JP KR CN TW MN east_asia",
    "south-asia": "SA IN PK BD LK NP south_asia",
    "north-america": "NA US CA MX north_america",
    "south-america": "LA BR AR CO VE CL PE EC BO UY PY south_america",
    "central-asia": "KZ UZ TM KG TJ central_asia",
    "oceania": "AU NZ FJ PG",
    "north-africa": "north_africa",
    "central-america": "central_america",
}
#: The point that stands for a region.
CENTERS = {
    "middle-east": (27.0, 44.0),
    "eastern-europe": (48.5, 31.0),
    "western-europe": (48.0, 2.0),
    "africa": (8.0, 25.0),
    "sub-saharan-africa": (8.0, 25.0),
    "north-africa": (28.0, 15.0),
    "southeast-asia": (15.0, 105.0),
    "east-asia": (35.0, 120.0),
    "south-asia": (25.0, 78.0),
    "central-asia": (42.0, 65.0),
    "north-america": (40.0, -100.0),
    "south-america": (-15.0, -55.0),
    "central-america": (15.0, -80.0),
    "caribbean": (15.0, -80.0),
    "oceania": (-25.0, 135.0),
    "arctic": (75.0, 0.0),
}
#: Places that feeds give where they know none.
PLACEHOLDERS = [
    (33.3128, 44.3615), (33.5138, 36.2765), (35.6892, 51.3890), (31.9454, 35.9284), (33.8886, 35.4955), (38.7223, -9.1393), (51.5074, -0.1278),
    (48.8566, 2.3522), (40.4168, -3.7038), (38.9072, -77.0369), (39.9042, 116.4074), (55.7558, 37.6173), (28.6139, 77.2090), (0.3476, 32.5825),
    (9.0579, 7.4951), (-1.2921, 36.8219), (30.0444, 31.2357), (15.3694, 44.1910), (24.7136, 46.6753), (25.2048, 55.2708),
]
#: Event types whose coordinates are measured.
RELIABLE = ("thermal_anomaly", "seismic_event", "nuclear_event", "geo_event", "conflict_event", "gps_interference", "fishing_event")
#: Words after a place's name that are no part of it, taken off in this order.
DIVISIONS = ("governorate", "province", "oblast", "region", "district", "city", "strip")


def _lookup(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def region_from_coords(lat: Column, lon: Column) -> Column:
    """The first box that holds the point; else arctic from 65 degrees north on, else global. Null without coordinates."""
    out = F.when(lat.isNull() | lon.isNull(), F.lit(None))
    for south, north, west, east, name in BOXES:
        upper = lat < north if name == "africa" else lat <= north
        out = out.when((lat >= south) & upper & (lon >= west) & (lon <= east), name)
    return out.when(lat >= 65, "arctic").otherwise("global")


def region_for_country(code: Column) -> Column:
    return _lookup(F.upper(code), {c: r for r, codes in COUNTRIES.items() for c in codes.split()})


def region_for_country_name(name: Column) -> Column:
    return _lookup(name, {n: r for r, names in COUNTRY_NAMES.items() for n in names})


def normalize_region(code: Column) -> Column:
    """The region's long name; what is none of the known codes stays."""
    return F.coalesce(_lookup(code, {c: r for r, codes in CANONICAL.items() for c in codes.split()}), code)


def regions_overlap(a: Column, b: Column) -> Column:
    return F.arrays_overlap(F.transform(a, normalize_region), F.transform(b, normalize_region))


def region_center(region: Column) -> tuple[Column, Column]:
    """Latitude and longitude, null for others."""
    return tuple(_lookup(F.lower(region), {r: c[i] for r, c in CENTERS.items()}) for i in (0, 1))


def _near(lat: Column, lon: Column, places, degrees: float) -> Column:
    out = F.lit(False)
    for y, x in places:
        out = out | ((F.abs(lat - y) < degrees) & (F.abs(lon - x) < degrees))
    return out


def is_region_center(lat: Column, lon: Column, degrees: float = 0.01) -> Column:
    """Whether a point is one that stands for a region: within 0.01 degrees for situations, 0.05 for feeds."""
    return _near(lat, lon, sorted(set(CENTERS.values())), degrees)


def is_null_island(lat: Column, lon: Column) -> Column:
    return (F.abs(lat) < 0.01) & (F.abs(lon) < 0.01)


def is_placeholder(lat: Column, lon: Column) -> Column:
    return _near(lat, lon, PLACEHOLDERS, 0.15)


def usable_coordinates(event_type: Column, lat: Column, lon: Column) -> Column:
    """Whether an event's point may enter a situation's place: measured, and none of those that stand for something else."""
    return F.coalesce(event_type.isin(*RELIABLE) & ~is_null_island(lat, lon) & ~is_region_center(lat, lon) & ~is_placeholder(lat, lon), F.lit(False))


def place_name(name: Column) -> Column:
    """A place's name as gazetteers have it: lower case, without the word for its kind."""
    out = F.trim(F.lower(name))
    for word in DIVISIONS:
        out = F.regexp_replace(out, f"( {word})+$", "")
    return F.trim(out)

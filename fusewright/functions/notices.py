"""Notices to airmen: what their Q-lines say, how grave they are, where they hold, and their text written out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Regions in which restrictions are critical; codes that tell of conflict; phrases about jamming.
CRITICAL_FIRS = ("OIIX", "ORBB", "OBBB")
CONFLICT_CODES = ("QRALC", "QRTCA", "QFAHC", "QFALC")
JAMMING = ("GPS JAMMING", "GPS JAM", "GNSS INTERFERENCE", "GNSS TESTING", "GNSS JAMMING", "GPS UNRELIABLE", "GNSS UNRELIABLE", "NAVIGATION SIGNAL", "GPS INTF")
#: Kinds by the code's beginning, topics by the code and by its beginning.
KINDS = {"QR": "Restricted Area", "QW": "Warning", "QA": "Airfield", "QN": "Navigation", "QF": "Facility"}
TOPICS = {
    "QRTCA": "airspace-restriction", "QRALC": "airspace-restriction", "QRDCA": "danger-area", "QWELW": "airspace-warning", "QWHLW": "airspace-warning", "QWPLW": "airspace-warning",
    "QFALC": "aerodrome-closed", "QFAAH": "aerodrome-closed", "QFAHC": "aerodrome-facility", "QNMAS": "navigation-aid", "QNMCT": "navigation-aid",
}
BEGINNINGS = {"QR": "airspace-restriction", "QW": "airspace-warning", "QA": "airfield", "QN": "navigation", "QF": "facility", "QO": "obstacle"}
#: Flight information regions: label, slug, and a point; and airports' points.
LABELS = {
    "OIIX": "Tehran FIR (Iran)", "ORBB": "Baghdad FIR (Iraq)", "OBBB": "Bahrain FIR (Persian Gulf)", "OMAE": "Emirates FIR (UAE)", "OOMM": "Muscat FIR (Oman)",
    "OEJD": "Jeddah FIR (Saudi Arabia)", "LTBB": "Ankara FIR (Turkey)", "LCCC": "Nicosia FIR (Cyprus)", "OSTT": "Damascus FIR (Syria)", "OJAC": "Amman FIR (Jordan)",
    "LLLL": "Tel Aviv FIR (Israel)", "EGTT": "London FIR (UK)", "EGPX": "Scottish FIR (UK)",
}
SLUGS = {
    "EGTT": "london-fir", "EGPX": "scottish-fir", "OIIX": "tehran-fir", "ORBB": "baghdad-fir", "OBBB": "bahrain-fir", "OSTT": "damascus-fir", "LLLL": "tel-aviv-fir",
    "UKBV": "ukraine-fir", "UKDV": "ukraine-fir", "UKLV": "ukraine-fir", "UKFV": "ukraine-fir", "UKOV": "ukraine-fir", "UMMV": "minsk-fir", "UUWV": "moscow-fir",
}
CENTERS = {
    "EGTT": (51.5, -0.1), "EGPX": (56.5, -4.0), "OIIX": (35.7, 51.4), "LLLL": (32.0, 34.9), "OSTT": (33.5, 36.3), "UKBV": (50.4, 30.5), "UUWV": (55.8, 37.6), "LFFF": (48.9, 2.3),
    "EDGG": (50.0, 8.5), "ORBB": (33.3, 44.4), "OBBB": (26.1, 50.5), "OMAE": (24.5, 54.7), "OOMM": (23.6, 58.5), "OEJD": (21.5, 39.2), "LTBB": (39.9, 32.9), "LCCC": (35.2, 33.4),
    "OJAC": (31.9, 35.9),
}
AIRPORTS = {
    "EGLL": (51.4775, -0.4614), "EGKK": (51.1481, -0.1903), "EGSS": (51.8850, 0.2350), "EGGW": (51.8747, -0.3684), "EGCC": (53.3537, -2.2750), "EGBB": (52.4539, -1.7480),
    "EGPH": (55.9500, -3.3725), "EGPF": (55.8719, -4.4331), "EGNT": (55.0375, -1.6917), "EGNM": (53.8659, -1.6606), "EGGD": (51.3827, -2.7191), "EGHI": (50.9503, -1.3568),
    "EGNX": (52.8311, -1.3281), "EGAA": (54.6575, -6.2158), "EGJJ": (49.2078, -2.1956), "EGJB": (49.4350, -2.6020), "EGNC": (54.9375, -2.8092), "EGNO": (53.7450, -2.8831),
    "EGDR": (50.0861, -5.2556), "EGSU": (52.0906, 0.1317), "EGTC": (51.7722, -1.0928), "EGXC": (53.0931, -0.4828), "EGUL": (52.4093, 0.5614), "EGYM": (52.3617, 0.7728),
    "EGVA": (51.6822, -1.7903), "EGVN": (51.7500, -1.5839), "EGDM": (51.1522, -1.7478), "EGQS": (57.7053, -3.3211), "EGXE": (54.2925, -1.5353), "EGOV": (53.2481, -4.5353),
    "EGDY": (51.0094, -2.6386), "OIIE": (35.4161, 51.1522), "OIII": (35.6894, 51.3133), "OLBA": (33.8209, 35.4884), "ORBI": (33.2625, 44.2346), "LLBG": (32.0094, 34.8867),
    "OSDI": (33.4114, 36.5156),
}
#: Abbreviations in the order in which they are written out.
WORDS = {
    "AD": "Aerodrome", "CLSD": "Closed", "ATS": "Air Traffic Services", "RWY": "Runway", "TWY": "Taxiway", "APCH": "Approach", "DEP": "Departure", "TFC": "Traffic",
    "OPS": "Operations", "SVC": "Service", "HR": "Hours", "HRS": "Hours", "AVBL": "Available", "BTN": "Between", "ABV": "Above", "BLW": "Below", "SFC": "Surface",
    "UNL": "Unlimited", "ACT": "Active", "TEMPO": "Temporary", "PERM": "Permanent", "TRA": "Temporary Reserved Area", "FIR": "Flight Information Region", "CTR": "Control Zone",
    "CTA": "Control Area", "UIR": "Upper Information Region", "NON-SKED": "Non-Scheduled", "SKED": "Scheduled", "MON": "Monday", "TUE": "Tuesday", "WED": "Wednesday",
    "THU": "Thursday", "FRI": "Friday", "SAT": "Saturday", "SUN": "Sunday", "H24": "24 Hours", "HJ": "Sunrise to Sunset", "HN": "Sunset to Sunrise", "NOTAMN": "New NOTAM",
    "NOTAMR": "Replacement NOTAM", "NOTAMC": "Cancellation NOTAM", "VOR": "VHF Omnidirectional Range", "DME": "Distance Measuring Equipment", "NDB": "Non-Directional Beacon",
    "ILS": "Instrument Landing System", "ATIS": "Automatic Terminal Information Service", "PSN": "Position", "OBST": "Obstacle", "LGT": "Light/Lighting", "LGTD": "Lighted",
    "UNLGTD": "Unlighted", "INOP": "Inoperative", "U/S": "Unserviceable", "WI": "Within", "NM": "Nautical Miles", "AGL": "Above Ground Level", "AMSL": "Above Mean Sea Level",
    "EXC": "Except", "EMERG": "Emergency", "MIL": "Military", "CIV": "Civil", "VMC": "Visual Met Conditions", "IMC": "Instrument Met Conditions", "VFR": "Visual Flight Rules",
    "IFR": "Instrument Flight Rules", "TFR": "Temporary Flight Restriction", "RQRD": "Required", "AUTH": "Authorization", "PPR": "Prior Permission Required", "ARR": "Arrival",
    "MAINT": "Maintenance", "EXER": "Exercise", "GND": "Ground", "INTL": "International", "NAV": "Navigation", "GNSS": "Global Navigation Satellite System",
    "RNAV": "Area Navigation", "RNP": "Required Navigation Performance",
}


def _lookup(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def qcode(line: Column) -> Column:
    """The second of the Q-line's fields; empty without one."""
    return F.upper(F.trim(F.coalesce(F.get(F.split(line, "/"), F.lit(1)), F.lit(""))))


def fir(line: Column) -> Column:
    return F.upper(F.trim(F.split(line, "/")[0]))


def kind(code: Column) -> Column:
    return F.coalesce(_lookup(F.substring(code, 1, 2), KINDS), F.lit("Other"))


def topic(code: Column) -> Column:
    return F.coalesce(_lookup(code, TOPICS), _lookup(F.substring(code, 1, 2), BEGINNINGS), F.lit("notam"))


def fir_label(code: Column) -> Column:
    return F.coalesce(_lookup(code, LABELS), F.lit("Unknown FIR"))


def fir_topic(code: Column) -> Column:
    return F.coalesce(_lookup(code, SLUGS), F.concat(F.lit("fir-"), F.lower(code)))


def gravity(code: Column, region: Column) -> Column:
    """critical for restrictions and warnings in a critical region, else warning."""
    return F.when(region.isin(*CRITICAL_FIRS) & F.substring(code, 1, 2).isin("QR", "QW"), "critical").otherwise("warning")


def is_about_conflict(code: Column, text: Column) -> Column:
    """Whether a code tells of conflict or the text of jamming."""
    up = F.upper(F.coalesce(text, F.lit("")))
    return F.upper(code).rlike("|".join(CONFLICT_CODES)) | up.rlike("|".join(JAMMING))


def place(region: Column, airport: Column) -> tuple[Column, Column]:
    """An airport's point, else its region's."""
    return tuple(F.coalesce(_lookup(airport, {k: v[i] for k, v in AIRPORTS.items()}), _lookup(region, {k: v[i] for k, v in CENTERS.items()})) for i in (0, 1))


def written_out(text: Column) -> Column:
    """A notice's text with flight levels and whole-word abbreviations written out."""
    out = F.regexp_replace(text, r"\bFL(\d+)\b", "Flight Level $1")
    for short, long in WORDS.items():
        out = F.regexp_replace(out, rf"\b\Q{short}\E\b", long)
    return out

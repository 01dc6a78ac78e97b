"""Identity tables and the SQL expressions that read them, the same for both engines."""

# Call sign prefixes by country, longest prefix first.
CALLSIGNS = [
    ("SENTRY", "US"),
    *((p, "US") for p in ("REACH", "ETHYL", "HOMER", "GORDO", "TOPPS", "BISON", "MOOSE", "FORTE")),
    ("ASCOT", "GB"),
    *((p, "US") for p in ("JAKE", "LAGR", "EVAC", "HUNT", "BFLO")),
    *((p, "NATO") for p in ("DUKE", "NATO", "NCHO")),
    *((p, "US") for p in ("RCH", "RFF", "PAT", "CDT")),
    ("RSD", "RU"), ("RAF", "GB"), ("FAF", "FR"), ("CTM", "FR"), ("RFR", "FR"), ("GAF", "DE"), ("IAF", "IL"), ("IAM", "IT"), ("BAF", "BE"), ("CFC", "CA"), ("CAN", "CA"), ("RRR", "AU"), ("SWS", "SE"),
    ("NOR", "NO"), ("TUR", "TR"), ("THK", "TR"), ("KNG", "SA"), ("PLF", "PL"), ("PAF", "PL"), ("HEL", "GR"), ("HAF", "GR"), ("JAF", "JO"), ("EGF", "EG"),
]
# Aircraft address blocks by country, as six hexadecimal digits.
HEX_BLOCKS = [
    ("a00000", "adf7c7", "US"), ("400000", "43ffff", "GB"), ("3c0000", "3fffff", "DE"), ("380000", "3bffff", "FR"), ("300000", "33ffff", "IT"), ("340000", "37ffff", "ES"), ("140000", "17ffff", "RU"),
    ("780000", "7bffff", "CN"), ("738000", "73ffff", "IL"), ("730000", "737fff", "IR"), ("440000", "447fff", "TR"), ("508000", "50ffff", "UA"), ("c00000", "c3ffff", "CA"), ("7c0000", "7fffff", "AU"),
    ("c80000", "c87fff", "NZ"), ("840000", "87ffff", "JP"), ("710000", "717fff", "KR"), ("800000", "83ffff", "IN"), ("700000", "70ffff", "SA"), ("480000", "487fff", "NL"), ("448000", "44ffff", "BE"),
    ("478000", "47ffff", "NO"), ("4a0000", "4a7fff", "SE"), ("488000", "48ffff", "PL"), ("468000", "46ffff", "GR"), ("010000", "017fff", "EG"), ("e40000", "e7ffff", "BR"),
]
# The first three digits of a ship's number, first to last, by flag.
SHIP_PREFIXES = [
    (338, 338, "US"), (366, 369, "US"), (273, 273, "RU"), (422, 422, "IR"), (428, 428, "IL"), (226, 228, "FR"), (230, 235, "GB"), (211, 211, "DE"), (218, 218, "DE"), (244, 244, "NL"), (246, 246, "NO"),
    (351, 351, "UA"), (412, 414, "CN"), (431, 432, "JP"), (440, 441, "KR"), (525, 525, "ID"), (503, 503, "AU"), (636, 636, "LR"), (538, 538, "MH"), (370, 375, "PA"),
]
# Types that count as high value.
HIGH_VALUE_TYPES = ["C135", "K35R", "KC10", "KC46", "E3", "E6", "E8", "P8", "RQ4", "MQ9", "C17", "C5", "B52", "B1", "B2", "F35", "F22"]
# Words that tell a strike.
STRIKE_WORDS = ["strike", "attack", "airstrike", "missile", "explosion", "killed", "eliminated", "shelling", "bombardment", "drone", "intercept"]


def callsign_country(sign: str) -> str:
    """Country of a call sign by its longest known prefix; none: null."""
    s = f"upper(trim({sign}))"
    return "CASE " + " ".join(f"WHEN {s} LIKE '{p}%' THEN '{c}'" for p, c in CALLSIGNS) + " END"


def hex_country(address: str) -> str:
    """Country of an aircraft's address by its block; not hexadecimal or in no block: null."""
    h = f"lower(trim({address}))"
    six = f"lpad({h}, 6, '0')"
    arms = " ".join(f"WHEN {six} BETWEEN '{a}' AND '{b}' THEN '{c}'" for a, b, c in HEX_BLOCKS)
    return f"CASE WHEN {h} = '' OR length({h}) > 6 OR regexp_replace({h}, '^[0-9a-f]+$', '') <> '' THEN NULL {arms} END"


def ship_country(number: str) -> str:
    """Flag of a ship's number by its first three digits."""
    s = f"substr(CAST({number} AS STRING), 1, 3)"
    return "CASE " + " ".join(f"WHEN {s} BETWEEN '{a}' AND '{b}' THEN '{c}'" for a, b, c in SHIP_PREFIXES) + " END"


def any_of(text: str, words: list[str]) -> str:
    """Does the text have any of the words as a part, whatever the case; null text: no."""
    t = f"lower(coalesce({text}, ''))"
    return "(" + " OR ".join(f"{t} LIKE '%{w.lower()}%'" for w in words) + ")"


def starts_with_any(text: str, prefixes: list[str]) -> str:
    t = f"upper(trim(coalesce({text}, '')))"
    return "(" + " OR ".join(f"{t} LIKE '{p}%'" for p in prefixes) + ")"

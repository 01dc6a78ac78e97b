"""Feeds in the form in which they arrive: JSON, XML and streams' messages to canonical events, by Spark's own parsers.

Each function takes a frame with one text column `body` (a response or message) and gives events with payload,
description and region_code. What a feed repeats is dropped by its key; a stream passes `seconds` for how long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fusewright.functions import regions as R
from fusewright.functions.names import contains_any
from fusewright.operators.clues import xml_tag
from fusewright.sources.connectors import MILITARY_SIGNS

c = F.col
COLUMNS = ["event_time", "source_type", "source_id", "latitude", "longitude", "region_code", "entity_id", "entity_name", "event_type", "severity", "tags", "title", "description", "payload"]
_KINDS = {"event_time": "timestamp", "latitude": "double", "longitude": "double", "tags": "array<string>"}
#: Words by which an article is left out, and by one of which it is taken.
REJECTED = [
    "k-pop", "kpop", "bts ", "blackpink", "taylor swift", "beyonce", "grammy", "oscar", "emmy", "golden globe", "box office", "blockbuster", "kardashian", "celebrity", "red carpet",
    "fashion week", "met gala", "reality tv", "contestant", "idol ", "talent show", "box set", "streaming series", "netflix", "new album", "concert tour", "academy award",
    "academy awards", "oscar nomination", "cannes", "sundance", "film festival", "movie premiere", "tv series", "sitcom", "soap opera", "talk show", "award ceremony",
    "awards ceremony", "voting delay", "oscar nominee", "emmy nominee", "grammy nominee", "best actor", "best actress", "best director", "best picture", "premier league",
    "champions league", "world cup", "fifa", "uefa", "nba ", "nfl ", "nhl ", "mlb ", "cricket", "tennis", "rugby", "formula 1", "f1 race", "grand prix", "olympics", "football",
    "soccer", "basketball", "baseball", "hockey", "golf", "swimming", "athletics", "marathon", "triathlon", "batting", "goalkeeper", "federation scandal", "federation ban",
    "committee ban", "retirement", "retires", "birthday", "anniversary", "funeral", "obituary", "wedding", "divorce", "baby bump", "engagement ring", "memoir", "autobiography",
    "recipe", "cookbook", "restaurant review", "michelin star", "stock price", "ipo", "quarterly earnings", "market cap", "dividend", "profit margin", "museum", "exhibition",
    "gallery", "art show", "book launch", "literary", "poetry", "music festival", "tour dates", "horoscope", "zodiac", "astrology", "video game", "playstation", "xbox",
    "nintendo", "esports",
]
ACCEPTED = [
    "military", "missile", "drone", "strike", "airstrike", "bomb", "nuclear", "weapon", "sanctions", "ceasefire", "peace talks", "war ", "conflict", "invasion", "occupation",
    "troops", "cyber", "hack", "breach", "malware", "ransomware", "apt", "navy", "warship", "submarine", "aircraft carrier", "intelligence", "espionage", "spy", "surveillance",
    "terrorism", "extremist", "insurgent", "militant", "refugee", "humanitarian", "crisis", "famine", "epidemic", "earthquake", "tsunami", "hurricane", "typhoon", "flooding",
    "coup", "uprising", "protest", "riot", "martial law", "maritime", "piracy", "shipping", "strait", "blockade", "election", "tariff", "embargo", "trade war", "arrest",
    "indictment", "prosecution", "tribunal", "assassination", "killing", "execution", "hostage", "border", "territorial", "sovereignty", "disputed", "pipeline", "energy",
    "oil price", "gas supply", "infrastructure", "power grid", "internet outage",
]
#: Outlets, and places of which three beside one make a list and no story.
OUTLETS = ["wall street journal", "reuters", "associated press", " ap ", "cnn", "bbc", "fox news", "new york times", "washington post", "bloomberg", "al jazeera"]
PLACES = [
    "ukraine", "russia", "china", "iran", "israel", "gaza", "syria", "iraq", "yemen", "north korea", "south korea", "taiwan", "india", "pakistan", "afghanistan", "africa",
    "europe", "asia", "middle east", "latin america", "turkey", "lebanon", "libya", "sudan", "myanmar", "somalia", "nigeria", "ethiopia", "egypt", "saudi", "japan",
]


def _events(rows: DataFrame, **fields: Column | str) -> DataFrame:
    """The canonical columns: given ones by name, null for others."""
    made = {k: (F.lit(v) if isinstance(v, str) else v) for k, v in fields.items()}
    return rows.select(*(made.get(n, F.lit(None)).cast(_KINDS.get(n, "string")).alias(n) for n in COLUMNS))


def opensky(rows: DataFrame) -> DataFrame:
    """States of aircraft: arrays of 15 fields or more, those with a position."""
    states = F.from_json(F.get_json_object("body", "$.states"), "array<array<string>>")
    x = rows.select(F.explode(states).alias("s")).where(F.size("s") > 14)
    field = lambda i: F.get("s", F.lit(i))
    number = lambda i: field(i).try_cast("double")
    sign = F.trim(F.coalesce(field(1), F.lit("")))
    x = x.select(
        F.coalesce(field(0), F.lit("")).alias("icao24"), sign.alias("callsign"), F.coalesce(field(2), F.lit("")).alias("origin_country"), number(5).alias("lon"), number(6).alias("lat"),
        F.coalesce(number(13), number(7)).alias("altitude"), F.coalesce(field(8) == "true", F.lit(False)).alias("on_ground"), number(9).alias("velocity"), number(10).alias("heading"),
        number(11).alias("vertical_rate"), field(14).alias("squawk"),
    ).where("lon is not null and lat is not null")
    military = F.upper("callsign").rlike("^(" + "|".join(MILITARY_SIGNS) + ")")
    return _events(
        x,
        source_type="opensky",
        source_id=c("icao24"),
        latitude=c("lat"),
        longitude=c("lon"),
        region_code=R.region_from_coords(c("lat"), c("lon")),
        entity_id=c("icao24"),
        entity_name=F.nullif(c("callsign"), F.lit("")),
        event_type="flight_position",
        severity=F.when(military, "medium").otherwise("low"),
        tags=F.when(military, F.array(F.lit("military"))).otherwise(F.array().cast("array<string>")),
        title=F.nullif(c("callsign"), F.lit("")),
        payload=F.to_json(F.struct("*", military.alias("military"))),
    )


def bgp_withdrawals(rows: DataFrame, monitored: DataFrame, seconds: int = 300) -> DataFrame:
    """Withdrawn prefixes of monitored networks (asn, country): by the peer, else the first of the path that is one; a network's prefix once in `seconds`."""
    kind = "type string, data struct<timestamp:double,peer:string,peer_asn:string,host:string,path:array<string>,withdrawals:array<string>>"
    m = rows.select(F.from_json("body", kind).alias("m")).where("m.type = 'ris_message'").select("m.data.*").where(F.size("withdrawals") > 0)
    m = m.withColumn("row", F.xxhash64(F.to_json(F.struct("*"))))
    seen = F.concat(F.array("peer_asn"), F.coalesce("path", F.array().cast("array<string>")))
    hops = m.select("row", F.posexplode(seen).alias("place", "hop")).withColumn("asn", c("hop").try_cast("long")).join(F.broadcast(monitored), "asn")
    origin = hops.groupBy("row").agg(F.min(F.struct("place", "asn", "country")).alias("o")).select("row", "o.asn", "o.country")
    x = m.join(origin, "row").select("*", F.explode("withdrawals").alias("prefix"))
    # The first of a network and prefix, and each that comes a window after one that stayed: by stretches of the window's length.
    turn = F.row_number().over(W.partitionBy("asn", "prefix", F.floor(c("timestamp") / seconds)).orderBy("timestamp", "row"))
    x = x.withColumn("turn", turn).where("turn = 1")
    return _events(
        x,
        event_time=F.timestamp_seconds("timestamp"),
        source_type="bgp",
        region_code=R.region_for_country(c("country")),
        entity_id=F.concat(F.lit("AS"), c("asn")),
        event_type="bgp_anomaly",
        severity="medium",
        tags=F.array().cast("array<string>"),
        title=F.concat(F.lit("BGP withdrawal: AS"), c("asn"), F.lit(" prefix "), c("prefix")),
        payload=F.to_json(F.struct(F.lit("withdrawal").alias("event_type"), "prefix", "peer", "peer_asn", c("asn").alias("origin_asn"), "country", "path", "host", "timestamp")),
    )


def is_relevant(title: Column, description: Column) -> Column:
    """Whether an article is about what is watched: none of the words that reject it, no list of places beside an outlet, one of those that accept it."""
    places = F.array(*map(F.lit, PLACES))

    def fits(text: Column) -> Column:
        listed = contains_any(text, OUTLETS) & (F.size(F.filter(places, lambda p: text.contains(p))) >= 3)
        return ~contains_any(text, REJECTED) & ~listed & contains_any(text, ACCEPTED)

    return _bound(F.lower(F.concat(title, F.lit(" "), description)), fits)


#: Zones by name.
ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def _bound(x: Column, use) -> Column:
    """use(x) with x reckoned once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def parse_time(text: Column) -> Column:
    """RFC 2822 with a zone by number or name, else ISO 8601; null for others. A weekday before the comma is left out."""
    zones = F.create_map(*(F.lit(x) for pair in ZONES.items() for x in pair))

    def parsed(x: Column) -> Column:
        zone = F.element_at(zones, F.regexp_extract(x, " ([A-Z]+)$", 1))
        y = F.when(zone.isNotNull(), F.concat(F.regexp_replace(x, "[A-Z]+$", ""), zone)).otherwise(x)
        day = _bound(y, lambda z: F.coalesce(F.try_to_timestamp(z, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(z, F.lit("d MMM yyyy HH:mm Z"))))
        return F.when(x.rlike("^[0-9]{4}-"), x.try_cast("timestamp")).otherwise(day)

    return _bound(F.regexp_replace(F.trim(text), "^[A-Za-z]+, *", ""), parsed)


def rss(rows: DataFrame) -> DataFrame:
    """Articles of RSS and Atom feeds: columns body, source_name, language, region; each link once, relevant ones only."""
    items = F.regexp_extract_all("body", F.lit(r"(?s)<(?:item|entry)[ >].*?</(?:item|entry)>"), F.lit(0))
    x = rows.select("source_name", "language", "region", F.explode(items).alias("item"))
    href = F.nullif(F.regexp_extract("item", r'<link[^>]*href="([^"]*)"', 1), F.lit(""))
    x = x.select(
        "source_name", "language", "region", F.coalesce(xml_tag(c("item"), "title"), F.lit("")).alias("title"), F.coalesce(xml_tag(c("item"), "link"), href).alias("link"),
        F.coalesce(xml_tag(c("item"), "description"), xml_tag(c("item"), "summary"), F.lit("")).alias("description"),
        F.coalesce(xml_tag(c("item"), "pubDate"), xml_tag(c("item"), "published"), xml_tag(c("item"), "updated")).alias("published"), xml_tag(c("item"), "guid").alias("guid"),
    )
    x = x.where("link is not null").where(is_relevant(c("title"), c("description"))).dropDuplicates(["link"])
    lat, lon = R.region_center(R.normalize_region(c("region")))
    return _events(
        x,
        event_time=parse_time(c("published")),
        source_type="rss-news",
        source_id=c("link"),
        latitude=lat,
        longitude=lon,
        region_code=c("region"),
        event_type="news_article",
        severity="low",
        tags=F.array_compact(F.array(F.concat(F.lit("source:"), c("source_name")), F.when(c("language") != "en", c("language")))),
        title=F.nullif(c("title"), F.lit("")),
        description=c("link"),
        payload=F.to_json(F.struct("title", c("link").alias("url"), "description", "source_name", "language", "guid")),
    )


def usgs(rows: DataFrame) -> DataFrame:
    """Quakes of a GeoJSON collection: id, magnitude, place, time in milliseconds, coordinates with depth."""
    kind = "array<struct<id:string,properties:struct<mag:double,place:string,time:long,type:string>,geometry:struct<coordinates:array<double>>>>"
    x = rows.select(F.explode(F.from_json(F.get_json_object("body", "$.features"), kind)).alias("f"))
    place = lambda i: F.get("f.geometry.coordinates", F.lit(i))
    x = x.select(c("f.id").alias("id"), c("f.properties.mag").alias("magnitude"), c("f.properties.place").alias("place"), c("f.properties.time").alias("at"), c("f.properties.type").alias("kind"), place(0).alias("lon"), place(1).alias("lat"), place(2).alias("depth"))
    x = x.where("magnitude is not null").dropDuplicates(["id"])
    severity = F.when(c("magnitude") > 6, "critical").when(c("magnitude") > 5, "high").when(c("magnitude") > 4, "medium").otherwise("low")
    return _events(
        x,
        event_time=F.timestamp_millis("at"),
        source_type="usgs",
        source_id=c("id"),
        latitude=c("lat"),
        longitude=c("lon"),
        region_code=R.region_from_coords(c("lat"), c("lon")),
        event_type="seismic_event",
        severity=severity,
        tags=F.array().cast("array<string>"),
        title=F.concat(F.lit("M"), F.format_number("magnitude", 1), F.lit(" - "), F.coalesce("place", F.lit("Unknown"))),
        payload=F.to_json(F.struct("magnitude", "depth", "place", "kind")),
    )


#: Ports of industrial controls; a post's words that speak against it, and for it.
CONTROL_PORTS = (102, 502, 789, 1089, 1091, 1911, 2222, 2404, 4840, 4911, 9600, 18245, 20000, 34962, 34964, 44818, 47808, 55553, 55555)
CHATTER = ["lol", "lmao", "rofl", "happy birthday", "recipe", "good morning", "mornin", "it's friday", "its friday", "podcast", "subscribe", "newsletter", "rant", "imo", "imho", "sale", "discount", "promo", "giveaway", "merch"]
FIRST_PERSON = ["i ", "my ", "i'm ", "i've ", "i'd ", "i am ", "i was "]
MEDIA = [
    "just finished reading", "just finished watching", "currently reading", "listening to", "watched", "just read", "highly recommend", "recommended", "book review", "movie review",
    "great read", "page turner", "binge",
]
OPINION = [
    "people don't realize", "people dont realize", "everyone should know", "unpopular opinion", "am i the only", "does anyone else", "hot take:", "controversial take",
    "here's my take", "here is my take", "heres my take",
]
ACTIONS = [
    "struck", "launched", "deployed", "intercepted", "fired", "shelled", "bombed", "targeted", "invaded", "advancing", "retreating", "captured", "seized", "sank", "shot down",
    "breached", "detected", "confirmed", "reported", "detonated", "exploded", "collapsed",
]
SUBJECTS = [
    "military", "strike", "missile", "drone", "conflict", "attack", "deployed", "intelligence", "sanctions", "nuclear", "cyber", "geolocation", "satellite", "airstrike", "casualt",
    "weapon", "artillery", "convoy", "intercept", "radar", "warship", "submarine", "fighter", "bomber", "reconnaissance", "sigint", "humint", "geoint", "osint", "ceasefire",
    "escalat", "deescalat", "mobiliz", "incursion", "blockade", "embargo", "militia", "insurgent", "separatist", "annex",
]


def shodan(rows: DataFrame) -> DataFrame:
    """Banners of scanned hosts: medium where they have a known weakness, a tag or a port of industrial controls, else for information."""
    text = lambda p: F.get_json_object("body", p)
    ip, port = F.coalesce(text("$.ip_str"), F.lit("unknown")), F.coalesce(text("$.port").try_cast("int"), F.lit(0))
    tags = F.coalesce(F.from_json(text("$.tags"), "array<string>"), F.array().cast("array<string>"))
    x = rows.where(F.get_json_object("body", "$").isNotNull()).select("body", ip.alias("ip"), port.alias("port"), tags.alias("own_tags"))
    grave = text("$.vulns").isNotNull() | F.array_contains("own_tags", "ics") | c("port").isin(*CONTROL_PORTS)
    return _events(
        x,
        source_type="shodan",
        source_id="shodan-stream",
        latitude=text("$.location.latitude").try_cast("double"),
        longitude=text("$.location.longitude").try_cast("double"),
        region_code=R.region_for_country(text("$.location.country_code")),
        entity_id=F.concat_ws(":", "ip", "port"),
        entity_name=text("$.org"),
        event_type="shodan_banner",
        severity=F.when(grave, "medium").otherwise("info"),
        tags=c("own_tags"),
        title=F.concat(F.lit("Shodan banner: "), F.concat_ws(":", "ip", "port")),
        payload=c("body"),
    )


def post_rejection(text: Column, repost: Column, link: Column, images: Column) -> Column:
    """Why a post is left out, null where it is taken: a repost, chatter, a picture with little text, media, opinion, one's own life, a bare link, or too short."""
    words = "|".join(rf"\Q{w}\E" for w in CHATTER)

    def reason(low: Column) -> Column:
        about = contains_any(low, SUBJECTS)
        bare = F.trim(F.regexp_replace(F.regexp_replace(low, r"https?://\S*", ""), r"\s+", " "))
        own = low.rlike(r"^\s*(" + "|".join(FIRST_PERSON) + ")") & ~about
        size = F.octet_length(low)
        return (
            F.when(repost, "repost")
            .when(low.rlike(rf"(?<![A-Za-z0-9])({words})(?![A-Za-z0-9])"), "negative_keyword")
            .when(images & (size < 20), "image_meme")
            .when(contains_any(low, MEDIA), "media_consumption")
            .when(contains_any(low, OPINION), "meta_commentary")
            .when(own, "personal_content")
            .when(link & (F.octet_length(bare) < 40) & ~contains_any(bare, SUBJECTS), "url_only_low_text")
            .when((size < 80) & ~link & ~about, "short_text")
        )

    return _bound(F.lower(text), reason)


def post_severity(text: Column) -> Column:
    """medium for a subject that is watched with a word of action, else low."""
    return _bound(F.lower(text), lambda low: F.when(contains_any(low, ACTIONS) & contains_any(low, SUBJECTS), "medium").otherwise("low"))


def exported(events: DataFrame) -> DataFrame:
    """One column (line): an event as a JSON object with sorted keys, for replay; nulls are left out."""
    return events.select(F.to_json(F.struct(*sorted(events.columns))).alias("line"))


def imported(lines: DataFrame, schema) -> DataFrame:
    """Events of exported() lines; what isn't an object of the schema is left out."""
    return lines.select(F.from_json("line", schema).alias("e")).where("e is not null").select("e.*")


def without_nul(text: Column) -> Column:
    """Text without NUL characters, as stores take it."""
    return F.replace(text, F.lit("\u0000"), F.lit(""))


def bases(rows: DataFrame) -> DataFrame:
    """(name, type, country, region, operator, lat, lon) of map elements in columns body and region: nodes, and others by their centre; one for each place of five decimals, of the first region by name.

    What is only said to be military is an airfield where it is one for aircraft, else a base.
    """
    kind = "array<struct<type:string,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
    x = rows.select("region", F.posexplode(F.from_json(F.get_json_object("body", "$.elements"), kind)).alias("n", "e"))
    tag = lambda *names: F.coalesce(*(F.element_at("e.tags", F.lit(n)) for n in names), F.lit(""))
    at = lambda k: F.round(F.when(c("e.type") == "node", c(f"e.{k}")).otherwise(c(f"e.center.{k}")), 5)
    military = F.coalesce(F.element_at("e.tags", F.lit("military")), F.lit("base"))
    plane = F.coalesce(F.map_contains_key("e.tags", F.lit("aeroway")), F.lit(False))
    x = x.select("region", "n", tag("name", "name:en").alias("name"), F.when(military == "yes", F.when(plane, "airfield").otherwise("base")).otherwise(military).alias("type"), tag("addr:country", "country").alias("country"), tag("operator").alias("operator"), at("lat").alias("lat"), at("lon").alias("lon"))
    first = x.where("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.min(F.struct("region", "n", "name", "type", "country", "operator")).alias("b"))
    return first.select("b.name", "b.type", "b.country", "b.region", "b.operator", "lat", "lon")

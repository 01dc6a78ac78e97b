"""The rules, each from events to incidents that would be raised, and the suppression of those that one before covers.

Events: event_id, t (seconds), event_type, source_type, entity_id, entity_name, region, lat, lon,
severity_rank, tags, title, description, payload. An incident: rule_id, trigger_id, t, title, severity_rank,
confidence, region, lat, lon, tag and counts of evidence.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fusewright.functions.names import FLIGHTS, contains_any
from fusewright.rules import evidence as E

c = F.col
#: Words of a report about a strike.
STRIKE_WORDS = ["strike", "attack", "airstrike", "missile", "explosion", "killed", "eliminated", "shelling", "bombardment", "drone", "intercept"]
SOCIAL = ("telegram_message", "bluesky_post")
INCIDENT = ["rule_id", "trigger_id", "t", "title", "severity_rank", "confidence", "region", "lat", "lon", "tag", "n1", "n2", "n3"]
#: How far, in degrees, an incident covers others of its rule, or that its tag does, and for how long.
COVERS = {"military_strike": 1.0, "confirmed_strike": 0.5, "maritime_enforcement": 0.3, "conflict_thermal_cluster": 0.5, "gps_military": 1.5, "osint_strike": 1.0}
ACTIVE_SECONDS = 6 * 3600


def country_of(payload: Column, title: Column) -> Column:
    """The first two-letter code of the payload, else the two bytes after a final ' in ' of the title."""
    codes = [F.get_json_object(payload, f"$.{k}") for k in ("country", "country_code")]
    out = F.when(F.octet_length(codes[0]) == 2, codes[0]).when(F.octet_length(codes[1]) == 2, codes[1])
    return out.otherwise(F.when(title.rlike("(?s) in ..\\z"), F.substring(title, -2, 2)))


def extract_domain(payload: Column, entity_id: Column) -> Column:
    """Domain, else common name, else the first dotted word of a pulse's name, else the entity."""
    words = F.split(F.get_json_object(payload, "$.pulse_name"), r"\s+")
    dotted = F.get(F.filter(words, lambda w: w.contains(".") & ~w.startswith(".") & (F.octet_length(w) > 3)), F.lit(0))
    return F.coalesce(F.get_json_object(payload, "$.domain"), F.get_json_object(payload, "$.common_name"), dotted, entity_id)


def strike_indicators(tags: Column, title: Column, description: Column, payload: Column) -> Column:
    """Whether tags, title or description have a strike's word, or the enrichment has changes of state."""
    said = lambda x: F.coalesce(contains_any(F.lower(x), STRIKE_WORDS), F.lit(False))
    changes = F.coalesce(F.size(F.from_json(F.get_json_object(payload, "$.enrichment.state_changes"), "array<string>")) > 0, F.lit(False))
    return F.exists(tags, said) | said(title) | said(description) | changes


def _of(events: DataFrame, *types: str) -> DataFrame:
    return events.where(c("event_type").isin(*types))


def _raised(triggers: DataFrame, rule: str, title: Column, rank, confidence, tag: Column | None = None) -> DataFrame:
    """Triggers that have their counts n1, n2, n3 as incidents."""
    rank, confidence = (x if isinstance(x, Column) else F.lit(x) for x in (rank, confidence))
    return triggers.select(
        F.lit(rule).alias("rule_id"), c("event_id").alias("trigger_id"), "t", title.alias("title"), rank.cast("int").alias("severity_rank"), confidence.cast("double").alias("confidence"),
        "region", "lat", "lon", (tag if tag is not None else F.lit(None)).cast("string").alias("tag"), *(c(n).cast("long").alias(n) for n in ("n1", "n2", "n3")),
    )


def _with(triggers: DataFrame, **counts: DataFrame) -> DataFrame:
    for name, pairs in counts.items():
        triggers = triggers.join(E.counted(pairs, name).withColumnRenamed("trigger_id", "event_id"), "event_id", "left")
    return triggers.na.fill(0, list(counts))


def _in_country(events: DataFrame, rule: str, types: tuple, least: tuple, title: str, confidence: float) -> DataFrame:
    """Many of three types in one country within 300 seconds."""
    rows = _of(events, *types)
    counts = E.running_counts(rows.withColumn("country", country_of(c("payload"), c("title"))), "country", {f"n{i + 1}": c("event_type") == t for i, t in enumerate(types)}, 300)
    full = counts.where((c("n1") >= least[0]) & (c("n2") >= least[1]) & (c("n3") >= least[2]))
    return _raised(full, rule, F.concat(F.lit(title), c("country")), 3, confidence, F.concat(F.lit("country:"), c("country")))


def infra_attack(events: DataFrame) -> DataFrame:
    return _in_country(events, "infra_attack", ("shodan_banner", "bgp_anomaly", "internet_outage"), (20, 50, 5), "Infrastructure attack detected in ", 0.75)


def coordinated_shutdown(events: DataFrame) -> DataFrame:
    return _in_country(events, "coordinated_shutdown", ("bgp_anomaly", "internet_outage", "censorship_event"), (50, 5, 10), "Coordinated internet shutdown in ", 0.8)


def _place(lat: Column, lon: Column) -> Column:
    return F.format_string("%.1f, %.1f", lat, lon)


def _location(otherwise: Column | None = None) -> Column:
    given = [F.get_json_object("payload", "$.location"), F.get_json_object("payload", "$.country")]
    return F.coalesce(*given, *([otherwise] if otherwise is not None else []), F.lit("unknown location"))


def _notices(triggers: DataFrame, notices: DataFrame, km: float, seconds: int) -> DataFrame:
    """Notices near a trigger; where there are none, those of its region."""
    by_place = E.near(triggers, notices, km, seconds)
    bare = triggers.where("lat is not null").join(by_place.select(c("trigger_id").alias("event_id")).distinct(), "event_id", "left_anti")
    return by_place.unionByName(E.alike(bare, notices, "region", seconds))


def military_strike(events: DataFrame) -> DataFrame:
    """Flights, notices and shallow or weak tremors within 100 km and 10 minutes."""
    triggers = _of(events, "flight_position", "notam_event", "seismic_event").where("lat is not null and lon is not null")
    military = F.exists("tags", lambda t: t.contains("military")) | F.coalesce(F.upper("entity_name").contains("MIL"), F.lit(False)) | c("source_type").isin(*FLIGHTS)
    number = lambda *keys: F.coalesce(*(F.get_json_object("payload", f"$.{k}").cast("double") for k in keys), F.lit(0.0))
    tremors = _of(events, "seismic_event").where((number("mag", "magnitude") < 4.0) | (number("depth") < 10.0))
    x = _with(triggers, n1=E.near(triggers, _of(events, "flight_position").where(military), 100, 600), n2=_notices(triggers, _of(events, "notam_event"), 100, 600), n3=E.near(triggers, tremors, 100, 600))
    return _raised(x.where("n1 > 0 and n2 > 0 and n3 > 0"), "military_strike", F.concat(F.lit("Possible military strike near "), _place(c("lat"), c("lon"))), 4, 0.7)


def _pair(events: DataFrame, rule: str, first: str, second: str, least: tuple, km: float, seconds: int, title: Column, rank: int, confidence: float) -> DataFrame:
    triggers = _of(events, first, second).where("lat is not null and lon is not null")
    x = _with(triggers, n1=E.near(triggers, _of(events, first), km, seconds), n2=E.near(triggers, _of(events, second), km, seconds)).withColumn("n3", F.lit(None))
    return _raised(x.where((c("n1") >= least[0]) & (c("n2") >= least[1])), rule, title, rank, confidence)


def confirmed_strike(events: DataFrame) -> DataFrame:
    return _pair(events, "confirmed_strike", "conflict_event", "thermal_anomaly", (1, 1), 50, 1800, F.concat(F.lit("Confirmed strike near "), _location()), 3, 0.85)


def conflict_thermal_cluster(events: DataFrame) -> DataFrame:
    title = F.concat(F.lit("Sustained bombardment cluster near "), F.coalesce("region", F.get_json_object("payload", "$.country"), F.lit("unknown")))
    return _pair(events, "conflict_thermal_cluster", "thermal_anomaly", "conflict_event", (3, 1), 50, 6 * 3600, title, 3, 0.8)


def maritime_enforcement(events: DataFrame) -> DataFrame:
    title = F.concat(F.lit("Maritime enforcement activity near "), _place(c("lat"), c("lon")))
    return _pair(events, "maritime_enforcement", "vessel_position", "fishing_event", (1, 1), 30, 1800, title, 2, 0.6)


def apt_staging(events: DataFrame) -> DataFrame:
    """A certificate and a report of one domain within an hour; reports also by an indicator that contains it.

    The reports' indicators are looked up by the domains' suffixes and substrings that start at a label or character:
    each indicator is split into its substrings that are domains asked for, so nothing but equal texts meet.
    """
    rows = _of(events, "cert_issued", "threat_intel").withColumn("domain", extract_domain(c("payload"), c("entity_id")))
    triggers = rows.where("domain is not null")
    certs, reports = rows.where("event_type = 'cert_issued'"), rows.where("event_type = 'threat_intel'")
    strings = F.coalesce(F.from_json(F.get_json_object("payload", "$.indicators"), "array<string>"), F.array().cast("array<string>"))
    plain = F.transform(strings, lambda s: F.coalesce(F.get_json_object(s, "$.indicator"), s))
    each = reports.select("event_id", "t", F.explode(plain).alias("indicator"))
    # Lengths of the domains asked for bound the substrings that can meet.
    sizes = triggers.select(F.length("domain").alias("n")).distinct()
    parts = each.join(F.broadcast(sizes), F.length("indicator") >= c("n")).select("event_id", "t", F.explode(F.transform(F.sequence(F.lit(1), F.length("indicator") - c("n") + 1), lambda i: F.substring(c("indicator"), i, c("n")))).alias("domain")).distinct()
    known = reports.select("event_id", "t", "domain").unionByName(parts).distinct()
    x = _with(triggers, n1=E.alike(triggers, certs, "domain", 3600), n2=E.alike(triggers, known, "domain", 3600)).withColumn("n3", F.lit(None))
    return _raised(x.where("n1 > 0 and n2 > 0"), "apt_staging", F.concat(F.lit("APT staging infrastructure: "), c("domain")), 3, 0.65, c("domain"))


def gps_military(events: DataFrame) -> DataFrame:
    """Jamming, flights and notices within 150 km and 30 minutes; of a trigger without coordinates in its region."""
    gps, flights, notices = (_of(events, t) for t in ("gps_interference", "flight_position", "notam_event"))
    triggers = _of(events, "gps_interference", "flight_position", "notam_event")
    placed, bare = triggers.where("lat is not null and lon is not null"), triggers.where("lat is null or lon is null")
    x = _with(placed, n1=E.near(placed, gps, 150, 1800), n2=E.near(placed, flights, 150, 1800), n3=_notices(placed, notices, 150, 1800))
    y = _with(bare, n1=E.alike(bare, gps, "region", 1800), n2=E.alike(bare, flights, "region", 1800), n3=E.alike(bare, notices, "region", 1800))
    both = x.unionByName(y).where("n1 > 0 and n2 > 0 and n3 > 0")
    tag = F.when(c("lat").isNull() | c("lon").isNull(), F.concat(F.lit("region:"), c("region")))
    return _raised(both, "gps_military", F.concat(F.lit("GPS jamming with military activity near "), F.coalesce("region", F.lit("unknown"))), 3, 0.7, tag)


def osint_strike(events: DataFrame) -> DataFrame:
    """A report of a strike of medium severity on a channel, and news within 100 km and 6 hours, whichever comes last; critical with a hotspot within 50 km and the 6 hours that the window holds."""
    said = strike_indicators(c("tags"), c("title"), c("description"), c("payload"))
    reports = _of(events, *SOCIAL).where((c("severity_rank") >= 2) & said)
    news = _of(events, "news_article")
    hours = 6 * 3600
    by_report = _with(reports, n2=E.near(reports, news, 100, hours)).withColumn("n1", F.lit(1))
    by_news = _with(news, n1=E.near(news, reports, 100, hours)).withColumn("n2", F.lit(1))
    both = by_report.unionByName(by_news).where("n1 > 0 and n2 > 0 and lat is not null and lon is not null")
    x = _with(both, n3=E.near(both, _of(events, "thermal_anomaly"), 50, hours))
    seen = c("n3") > 0
    return _raised(x, "osint_strike", F.concat(F.lit("OSINT-confirmed strike near "), _location(c("region"))), F.when(seen, 4).otherwise(3), F.when(seen, 0.90).otherwise(0.75))


def military_surge(events: DataFrame, cell: float = 2.0, hours: int = 6, least: int = 5, sigmas: float = 2.0, keep: int = 168, cold: int = 12) -> DataFrame:
    """More military aircraft in a cell within six hours than its hourly snapshots of a week let expect.

    A snapshot is the count at the first sighting of an hour (of the clock; the reference's hours start with a cell's
    first sighting); at most `keep` of them, `cold` at least, make mean and deviation.
    """
    seconds = hours * 3600
    seen = _of(events, "flight_position").where(F.array_contains("tags", "military") & c("lat").isNotNull() & c("lon").isNotNull() & c("entity_id").isNotNull())
    seen = seen.withColumn("cy", F.floor(c("lat") / cell)).withColumn("cx", F.floor(c("lon") / cell))
    # Distinct aircraft: each counts from a sighting until its next one, or for the window's length; so add one where a stretch begins and take one where it ends.
    by = W.partitionBy("cy", "cx", "entity_id").orderBy("t", "event_id")
    gap = c("t") - F.lag("t").over(by)
    starts = seen.where("true").withColumn("gap", gap)
    begin = starts.where(c("gap").isNull() | (c("gap") > seconds)).select("cy", "cx", "t", F.lit(1).alias("step"))
    ahead = F.lead("t").over(by)
    end = seen.withColumn("ahead", ahead).where(c("ahead").isNull() | (c("ahead") - c("t") > seconds)).select("cy", "cx", (c("t") + seconds + 1).alias("t"), F.lit(-1).alias("step"))
    steps = begin.unionByName(end).groupBy("cy", "cx", "t").agg(F.sum("step").alias("step"))
    level = steps.withColumn("n", F.sum("step").over(W.partitionBy("cy", "cx").orderBy("t"))).select("cy", "cx", "t", "n", F.lit(None).cast("long").alias("event_id"), F.lit(0).alias("kind"))
    marks = level.unionByName(seen.select("cy", "cx", "t", F.lit(None).cast("long").alias("n"), "event_id", F.lit(1).alias("kind")))
    at = marks.withColumn("n", F.last("n", True).over(W.partitionBy("cy", "cx").orderBy("t", "kind", "event_id").rowsBetween(W.unboundedPreceding, 0))).where("kind = 1")
    first = F.row_number().over(W.partitionBy("cy", "cx", F.floor(c("t") / 3600)).orderBy("t", "event_id"))
    shots = at.withColumn("first", first == 1).withColumn("shot", F.when(c("first"), c("n")))
    upto = W.partitionBy("cy", "cx").orderBy("t", "event_id").rowsBetween(W.unboundedPreceding, 0)
    shots = shots.withColumn("k", F.count("shot").over(upto))
    kept = shots.where("first").select("cy", "cx", "k", *(f(F.col("shot")).over(W.partitionBy("cy", "cx").orderBy("k").rowsBetween(1 - keep, 0)).alias(n) for f, n in ((F.count, "shots"), (F.avg, "mean"), (F.stddev_pop, "sd"))))
    x = shots.join(kept, ["cy", "cx", "k"]).where((c("n") >= least) & (c("shots") >= cold) & (c("n") > c("mean") + sigmas * c("sd")))
    z = F.when(c("sd") > 0, (c("n") - c("mean")) / c("sd")).otherwise(0.0)
    rank = F.when(z >= 4, 4).when(z >= 3, 3).otherwise(2)
    lat, lon = (c("cy") + 0.5) * cell, (c("cx") + 0.5) * cell
    x = x.select("event_id", "t", z.alias("z"), lat.alias("lat"), lon.alias("lon"), "cy", "cx", c("n").alias("n1"), F.lit(None).alias("n2"), F.lit(None).alias("n3"), F.lit(None).cast("string").alias("region"), rank.alias("rank"))
    confidence = F.round(F.least(F.lit(0.95), 0.6 + F.least(c("z") - 2, F.lit(2.0)) * 0.1), 9)
    return _raised(x, "military_surge", F.concat(F.lit("Military aircraft surge near "), _place(c("lat"), c("lon"))), c("rank"), confidence, F.format_string("cell:%d:%d", "cy", "cx"))


RULES = {f.__name__: f for f in (infra_attack, military_strike, confirmed_strike, coordinated_shutdown, maritime_enforcement, apt_staging, conflict_thermal_cluster, gps_military, osint_strike, military_surge)}


def suppressed(incidents: DataFrame, seconds: int = ACTIVE_SECONDS) -> DataFrame:
    """Incidents without those that an earlier one of the rule still covers: near it in both degrees, or with its tag.

    A gap of more than `seconds` in a rule's incidents ends what is active, so stretches without one are taken each on its own.
    """
    by = W.partitionBy("rule_id").orderBy("t", "trigger_id")
    fresh = F.coalesce((c("t") - F.lag("t").over(by) > seconds).cast("int"), F.lit(1))
    rows = incidents.select(*INCIDENT).withColumn("stretch", F.sum(fresh).over(by))

    def cover(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["t", "trigger_id"])
        kept, active = [], []
        for i, r in enumerate(part.itertuples(index=False)):
            active = [a for a in active if r.t - a.t <= seconds]
            degrees = COVERS.get(r.rule_id)
            tagged = r.tag is not None and any(a.tag == r.tag for a in active)
            placed = degrees is not None and not pd.isna(r.lat) and any(abs(a.lat - r.lat) < degrees and abs(a.lon - r.lon) < degrees for a in active if not pd.isna(a.lat))
            if not tagged and not placed:
                kept.append(i)
                active.append(r)
        return part.iloc[kept][INCIDENT]

    return rows.groupBy("rule_id", "stretch").applyInPandas(cover, incidents.select(*INCIDENT).schema)


def alerts(events: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, event_id): events that meet a user's rule: severity, any keyword in title or description, region and type, each only if given.

    rules: rule_id, min_rank, keywords, regions, types (arrays, null for any). A rule that names regions needs the event's.
    Rules are few, so they are broadcast; each event is looked at once for each.
    """
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    meets = c("severity_rank") >= F.coalesce("min_rank", F.lit(0))
    meets = meets & (c("keywords").isNull() | F.exists(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: text.contains(F.lower(k))))
    for given, own in (("regions", "region"), ("types", "event_type")):
        meets = meets & (c(given).isNull() | F.coalesce(F.array_contains(given, c(own)), F.lit(False)))
    return events.join(F.broadcast(rules), meets).select("rule_id", "event_id")


def fatigue(fired: DataFrame, cooldown_minutes: int = 15, per_hour: int = 10) -> DataFrame:
    """Alerts that go out, of (rule_id, event_id, t): none within whole `cooldown_minutes` of the rule's last, and at most `per_hour` in an hour that starts with one that went out."""

    def pace(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["t", "event_id"])
        kept, last, hour, n = [], None, None, 0
        for i, t in enumerate(part["t"]):
            full = hour is not None and t - hour < 3600 and n >= per_hour
            if full or last is not None and (t - last) // 60 < cooldown_minutes:
                continue
            kept.append(i)
            last = t
            hour, n = (t, 1) if hour is None or t - hour >= 3600 else (hour, n + 1)
        return part.iloc[kept]

    return fired.groupBy("rule_id").applyInPandas(pace, fired.schema)


#: States that are harm done to someone or something.
HARM = ("killed", "dead", "destroyed", "wounded", "injured", "seriously_wounded", "arrested", "detained", "captured")


def escalated_rank(payload: Column, rank: Column) -> Column:
    """An enriched event's severity: with relevance of 0.7 and a change that is neither rumoured nor denied, high where it is harm, else medium; never lower than it was."""
    kind = "array<struct<to:string,certainty:string>>"
    changes = F.coalesce(F.from_json(F.get_json_object(payload, "$.enrichment.state_changes"), kind), F.from_json(F.lit("[]"), kind))
    sure = F.filter(changes, lambda x: ~F.coalesce(x["certainty"].isin("rumored", "denied"), F.lit(False)))
    harm = F.exists(sure, lambda x: F.coalesce(x["to"].isin(*HARM), F.lit(False)))
    relevant = F.coalesce(F.get_json_object(payload, "$.enrichment.relevance_score").cast("double"), F.lit(0.0)) >= 0.7
    return F.greatest(rank, F.when(relevant & (F.size(sure) > 0), F.when(harm, 3).otherwise(2)).otherwise(0))

"""Clues read from titles, tags and payloads, and entity resolution as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fusewright.functions import lookups as L
from fusewright.operators.texts import normalize_name

_TITLE = "CASE event_id % 6 WHEN 0 THEN 'Drone ' || event_type || ' seen' WHEN 1 THEN 'Censorship anomaly: x in ' || upper(substr(event_type, 1, 2)) WHEN 2 THEN 'Two KILLED' WHEN 3 THEN NULL WHEN 4 THEN ' in A' ELSE event_type END"
_CODE = "CASE event_id % 4 WHEN 0 THEN substr(event_type, 1, 2) WHEN 1 THEN event_type END"
_Q = "'EGTT/QWELW/IV/BO/W/000/100/' || lpad(CAST(user_id % 90 AS STRING), 2, '0') || CASE event_id % 3 WHEN 0 THEN '30N00027W025' WHEN 1 THEN '305S012307E' ELSE 'x' END"


def qline_place(q: str) -> tuple[str, str]:
    """Latitude and longitude of a notice's last slash-separated field: DDMM[d]N DDDMM[d]E; none: null."""
    field = f"regexp_extract({q}, '([^/]*)$', 1)"
    whole = "'([0-9][0-9])([0-9][0-9])([0-9]?)([NS])([0-9][0-9][0-9])([0-9][0-9])([0-9]?)([EW])'"

    def part(i: int) -> str:
        return f"regexp_extract({field}, {whole}, {i})"

    def degrees(first: int) -> str:
        number = f"CAST({part(first)} AS DOUBLE) + (CAST({part(first + 1)} AS DOUBLE) + CAST('0' || {part(first + 2)} AS DOUBLE) / 10) / 60"
        return f"CASE WHEN {part(first + 3)} = '' OR length({field}) < 11 THEN NULL WHEN {part(first + 3)} IN ('S', 'W') THEN -({number}) ELSE {number} END"

    return degrees(1), degrees(5)


def country_of(payload_codes: list[str], title: str) -> str:
    """The first payload code of two letters, else the two letters after a final ' in ' of the title."""
    arms = " ".join(f"WHEN length({c}) = 2 THEN {c}" for c in payload_codes)
    return f"CASE {arms} WHEN length({title}) >= 6 AND substr({title}, length({title}) - 5, 4) = ' in ' THEN substr({title}, length({title}) - 1, 2) END"


_LAT, _LON = qline_place("q")

QUERIES = {
    "strike_words": f"SELECT event_id, {L.any_of('title', L.STRIKE_WORDS)} OR {L.any_of('event_type', L.STRIKE_WORDS)} AS is_strike FROM (SELECT event_id, event_type, {_TITLE} AS title FROM {{events}}) AS x",
    "country_from_payload_or_title": f"SELECT event_id, {country_of(['code', 'other'], 'title')} AS country FROM (SELECT event_id, {_CODE} AS code, CASE WHEN event_id % 9 = 0 THEN 'ZZ' END AS other, {_TITLE} AS title FROM {{events}}) AS x",
    "qline_coordinates": f"SELECT event_id, round({_LAT}, 6) AS lat, round({_LON}, 6) AS lon FROM (SELECT event_id, {_Q} AS q FROM {{events}}) AS x",
}


def xml_tag(text: Column, tag: str) -> Column:
    """Text of the first element of a tag: white space trimmed, a CDATA wrapper off, six character references decoded; none or empty: null."""
    body = F.trim(F.regexp_extract(text, f"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), F.lit(" \t\r\n"))
    out = F.regexp_replace(body, r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1")
    for code, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return F.nullif(out, F.lit(""))


def percent_encoded(text: Column) -> Column:
    """Every byte but letters, digits and -_.~ as %XX."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def words_before(text: Column, keyword: str) -> Column:
    """The three words (or fewer) before the first hit of a keyword, at least three characters; none: null."""
    at = F.instr(F.lower(text), keyword)
    words = F.filter(F.split(F.substring(text, F.lit(1), at - 1), r"\s+"), lambda w: w != "")
    near = F.array_join(F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), F.lit(3)), " ")
    return F.when((at > 0) & (F.length(near) >= 3), near)


def trigrams(name: Column) -> Column:
    return F.when(F.length(name) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 2, F.lit(1))), lambda i: F.substring(name, i, F.lit(3)))))


def resolve(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of mentions (name, qid) plus entity (null: a new one) and layer (exact, fuzzy, qid, new).

    known: entity, name, qid; a smaller entity wins a tie. The fuzzy layer takes names of four characters and
    more that contain each other at over half the length, or share over 0.6 of their trigrams. Such names
    share one of the known name's rarest trigrams or the mention's, and only names that do meet. Each
    different name is looked up once. Null names are new.
    """
    named = mentions.withColumn("norm_", normalize_name(F.col("name")))
    k = known.select("entity", normalize_name(F.col("name")).alias("known_"), F.col("qid").alias("known_qid_"))
    by_name = k.where("known_ is not null").groupBy("known_").agg(F.min("entity").alias("exact_"))
    open_names = named.where("norm_ is not null").select("norm_").distinct().join(by_name, F.col("norm_") == F.col("known_"), "left_anti").where(F.length("norm_") >= 4)
    sides = open_names.select(F.col("norm_").alias("s"), F.lit(0).alias("side")).union(by_name.where(F.length("known_") >= 4).select("known_", F.lit(1)))
    grams = sides.select("s", "side", F.explode(trigrams(F.col("s"))).alias("g"))
    ranked = grams.join(grams.groupBy("g").agg(F.count("*").alias("df")), "g")
    by = W.partitionBy("side", "s")
    # Over 0.6 of the union shared leaves at most 0.4 of a side's trigrams unshared: one of the rarest is shared.
    ranked = ranked.withColumn("r", F.row_number().over(by.orderBy("df", "g"))).withColumn("n", F.count("*").over(by))
    ranked = ranked.withColumn("rare", F.col("r") <= F.col("n") - F.ceil(F.col("n") * 6 / 10) + 1)
    a, b = (ranked.where(f"side = {i}").select("g", F.col("s").alias(c), F.col("rare").alias(f"rare{i}")) for i, c in enumerate(("norm_", "known_")))
    pairs = a.where("rare0").join(b, "g").select("norm_", "known_").union(a.join(b.where("rare1"), "g").select("norm_", "known_")).distinct()
    short, long = (f(F.length("norm_"), F.length("known_")) for f in (F.least, F.greatest))
    both = F.size(F.array_intersect(trigrams(F.col("norm_")), trigrams(F.col("known_"))))
    union = F.size(trigrams(F.col("norm_"))) + F.size(trigrams(F.col("known_"))) - both
    near = (F.contains("norm_", "known_") | F.contains("known_", "norm_")) & (short * 2 > long) | (both * 10 > union * 6)
    fuzzy = pairs.where(near).join(by_name, "known_").groupBy("norm_").agg(F.min("exact_").alias("fuzzy_"))
    by_qid = k.where("known_qid_ is not null").groupBy("known_qid_").agg(F.min("entity").alias("by_qid_"))
    out = named.join(by_name, F.col("norm_") == F.col("known_"), "left").drop("known_").join(fuzzy, "norm_", "left").join(by_qid, F.col("qid") == F.col("known_qid_"), "left")
    layer = F.when(F.col("exact_").isNotNull(), "exact").when(F.col("fuzzy_").isNotNull(), "fuzzy").when(F.col("by_qid_").isNotNull(), "qid").otherwise("new")
    return out.select(*(F.col(f"`{c}`") for c in mentions.columns), F.coalesce("exact_", "fuzzy_", "by_qid_").alias("entity"), layer.alias("layer"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def xml_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    item = F.concat(F.lit("<item><title a='1'> "), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("<![CDATA["), "p_name", F.lit("]]>"))).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(" &amp; co &lt;x&gt;"))).otherwise(""), F.lit(" </title></item>"))
    return p.select("p_partkey", xml_tag(item, "title").alias("title"), xml_tag(item, "link").alias("link"))


def percent_encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select("c_custkey", percent_encoded(F.concat("c_name", F.lit(" a*b~c/é+"), "c_mktsegment")).alias("encoded"))


def state_change_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" of "), "p_type", F.when(F.col("p_partkey") % 2 == 0, " was Killed near").otherwise(" lives")).alias("text"))
    return o.select("p_partkey", words_before(F.col("text"), "killed").alias("entity"))


def resolved_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    known = p.groupBy("p_type").agg(F.min("p_partkey").alias("entity")).select("entity", F.col("p_type").alias("name"), F.concat(F.lit("Q"), F.col("entity").cast("string")).alias("qid"))
    m = F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).when(F.col("p_partkey") % 5 == 1, F.concat("p_type", F.lit(" Corp"))).when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("x"), F.substring("p_type", 3, 100))).when(F.col("p_partkey") % 5 == 3, "p_brand")
    return resolve(p.select("p_partkey", m.alias("name"), F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("qid")), known).select("p_partkey", "entity", "layer")


FRAMES = {f.__name__: f for f in (xml_titles, percent_encoded_texts, state_change_words, resolved_entities)}

_DECODED = "CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' & co <x>' END"
_TEXT = "p_name || ' of ' || p_type || CASE WHEN p_partkey % 2 = 0 THEN ' was Killed near' ELSE ' lives' END"
_MENTION = "CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN p_type WHEN 2 THEN 'x' || substr(p_type, 3) WHEN 3 THEN p_brand END"
_GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)))"
SQL = {
    "xml_titles": f"SELECT p_partkey, {_DECODED} AS title, CAST(NULL AS VARCHAR) AS link FROM part",
    "percent_encoded_texts": "SELECT c_custkey, url_encode(c_name || ' a*b~c/é+' || c_mktsegment) AS encoded FROM customer",
    "state_change_words": rf"SELECT p_partkey, nullif(regexp_extract({_TEXT}, '(\S+ \S+ \S+) Killed', 1), '') AS entity FROM part",
    "resolved_entities": f"""WITH k AS (SELECT min(p_partkey) AS entity, lower(p_type) AS known, 'Q' || CAST(min(p_partkey) AS VARCHAR) AS qid FROM part GROUP BY p_type),
m AS (SELECT p_partkey, lower({_MENTION}) AS norm, 'Q' || CAST(p_partkey AS VARCHAR) AS qid FROM part),
d AS (SELECT DISTINCT norm FROM m WHERE length(norm) >= 4 AND norm NOT IN (SELECT known FROM k)),
g AS (SELECT norm, entity, known, length(list_intersect({_GRAMS.format('norm')}, {_GRAMS.format('known')})) AS b, length({_GRAMS.format('norm')}) + length({_GRAMS.format('known')}) AS s FROM d, k WHERE length(known) >= 4),
f AS (SELECT norm, min(entity) AS fuzzy FROM g WHERE ((contains(norm, known) OR contains(known, norm)) AND 2 * least(length(norm), length(known)) > greatest(length(norm), length(known))) OR b * 10 > (s - b) * 6 GROUP BY norm)
SELECT p_partkey, coalesce(e.entity, fuzzy, q.entity) AS entity, CASE WHEN e.entity IS NOT NULL THEN 'exact' WHEN fuzzy IS NOT NULL THEN 'fuzzy' WHEN q.entity IS NOT NULL THEN 'qid' ELSE 'new' END AS layer
FROM m LEFT JOIN k e ON m.norm = e.known LEFT JOIN f ON m.norm = f.norm LEFT JOIN k q ON m.qid = q.qid""",
}

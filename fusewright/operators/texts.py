"""Text, array and JSON helpers as columns, and the queries that apply them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words at a name's end that carry no identity.
SUFFIXES = ["corporation", "company", "limited", "group", "corp", "inc", "ltd", "llc"]


def title_case(c: Column) -> Column:
    """First letter of each word upper, the rest as it is (initcap would lower it)."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def normalize_name(c: Column) -> Column:
    """Lower case, single spaces, one legal suffix after another off the end."""
    out = F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    for s in SUFFIXES:
        out = F.trim(F.regexp_replace(out, f"[ ,.]+{s}[.]?$", ""))
    return out


def strip_urls(c: Column) -> Column:
    """Web addresses out, white space into one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"https?://[^\s]+", ""), r"\s+", " "))


def compose_text(*parts: Column) -> Column:
    """The parts that are neither null nor empty, joined for an embedding."""
    kept = F.filter(F.array(*(F.trim(p) for p in parts)), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(kept, " | ")


def strip_prefix(tags: Column, prefix: str) -> Column:
    """Values of the tags with a prefix, without it."""
    return F.transform(F.filter(tags, lambda t: t.startswith(prefix)), lambda t: F.substring(t, len(prefix) + 1, 1 << 30))


def merge_flat(left: Column, right: Column) -> Column:
    """Shallow merge of two maps: the right one's value stands."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(left), lambda e: ~F.map_contains_key(right, e["key"])), F.map_entries(right)))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def title_case_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", title_case(F.lower("p_type")).alias("title"))


def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " Holding  Corp.").when(F.col("p_partkey") % 3 == 1, ", Company Ltd").otherwise("")).alias("n"))
    return p.select("p_partkey", normalize_name(F.col("n")).alias("name"))


def stripped_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", strip_urls(F.concat(F.lit("seen  at "), "url", F.lit(" today"))).alias("text"))


def composed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.select("o_orderkey", compose_text(F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")), F.lit(" ")).alias("text"))


def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host"))


def tag_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    tags = F.array(F.concat(F.lit("actor:"), "event_type"), F.concat(F.lit("topic:"), F.col("user_id").cast("string")), F.lit("plain"))
    return e.select("event_id", F.array_join(strip_prefix(tags, "topic:"), ",").alias("topics"), F.exists(tags, lambda t: t == "actor:error").alias("is_error"), F.array_join(F.slice(F.array_sort(F.array_distinct(tags)), 1, 2), ",").alias("first_two"))


def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.absent"), F.get_json_object("props", "$.k"), F.lit("none")).cast("long").alias("k"))


def json_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    left = F.from_json("props", "map<string,string>")
    right = F.create_map(F.lit("type"), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "k").otherwise("j"), F.lit("0"))
    m = merge_flat(left, right)
    return e.select("event_id", m["k"].alias("k"), m["j"].alias("j"), m["type"].alias("type"))


FRAMES = {f.__name__: f for f in (title_case_names, normalized_names, stripped_urls, composed_texts, url_host, tag_values, json_paths, json_merged)}


def _suffixes(sql: str) -> str:
    for s in SUFFIXES:
        sql = f"trim(regexp_replace({sql}, '[ ,.]+{s}[.]?$', ''))"
    return sql


_NAMED = r"p_name || CASE p_partkey % 3 WHEN 0 THEN ' Holding  Corp.' WHEN 1 THEN ', Company Ltd' ELSE '' END"
_TAGS = "['actor:' || event_type, 'topic:' || CAST(user_id AS VARCHAR), 'plain']"
_NAME = r"trim(regexp_replace(lower(" + _NAMED + r"), '\s+', ' ', 'g'))"
SQL = {
    "title_case_names": "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part",
    "normalized_names": f"SELECT p_partkey, {_suffixes(_NAME)} AS name FROM part",
    "stripped_urls": r"SELECT page_id, trim(regexp_replace(regexp_replace('seen  at ' || url || ' today', 'https?://[^\s]+', '', 'g'), '\s+', ' ', 'g')) AS text FROM pages",
    "composed_texts": "SELECT o_orderkey, array_to_string(list_filter([o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END], lambda p: p IS NOT NULL AND trim(p) <> ''), ' | ') AS text FROM orders",
    "url_host": r"SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages",
    "tag_values": f"SELECT event_id, array_to_string(list_transform(list_filter({_TAGS}, lambda t: starts_with(t, 'topic:')), lambda t: substr(t, 7)), ',') AS topics, list_contains({_TAGS}, 'actor:error') AS is_error, array_to_string(list_sort(list_distinct({_TAGS}))[1:2], ',') AS first_two FROM events",
    "json_paths": "SELECT event_id, CAST(coalesce(json_extract_string(props, '$.absent'), json_extract_string(props, '$.k')) AS BIGINT) AS k FROM events",
    "json_merged": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '0' ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.j') ELSE '0' END AS j, event_type AS type FROM events",
}

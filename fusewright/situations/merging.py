"""Situations that belong together: pairs worth a look, what joins them, and parents that take their children's data.

Pairs come from what two situations share (an entity, topic, region, title word), never from all pairs. Where
several merges compete, the order is: the parent with more events first, then the child with more, then names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fusewright.functions import names as N
from fusewright.functions import regions as R
from fusewright.functions import titles as T

SOCIAL = ("geoconfirmed", "telegram", "bluesky")
MAX_CHILDREN, MAX_EVENTS = 50, 5000
#: Words by which a title names a country, and the conflicts that some of them are part of.
COUNTRIES = (
    "iran iraq israel ukraine russia china india japan korea yemen syria turkey pakistan afghan sudan somalia libya egypt saudi qatar bahrain france germany poland serbia mexico "
    "venezuela peru indonesia vanuatu taiwan philippines myanmar hormuz houthi hezbollah palestine palestinian gaza lebanon persian"
).split()
THEATERS = {
    "mideast-iran-israel": "iran israel yemen houthi hezbollah hormuz persian palestine palestinian gaza lebanon iraq syria".split(),
    "ukraine-russia": ["ukraine", "russia"],
    "china-taiwan": ["china", "taiwan"],
}
#: Beginnings of countries' names, which are never too common a word; words of titles about fighting.
COUNTRY_STEMS = "iran iraq isra ukra russ chin indi japa kore yeme syri turk paki afgh suda soma liby egyp saud qata bahr cana fran germ pola serb mexi vene peru guat indo vanu taiw phil myan horm hout hezb".split()
FIGHTING = (
    "war offensive strike strikes attack attacks military missile drone bomb bombing shelling frontline battle siege invasion escalat combat artillery rocket casualties killed "
    "naval navy airforce army armed forces weapon nuclear troops deploy advance coalition defense defence fighter jet ship shipping fleet blockade patrol tensions crisis conflict "
    "threat guard guards incursion operation operations pressure pressures surge revolutionary sanctions desperation espionage spy assassination urges warns warning embargo "
    "intercept seize seizes"
).split()


def child_counts(situations: DataFrame) -> DataFrame:
    return situations.where("parent_id is not null").groupBy(F.col("parent_id").alias("sid")).agg(F.count("*").alias("children"))


def top_level(situations: DataFrame) -> DataFrame:
    return situations.where("parent_id is null").join(child_counts(situations), "sid", "left").withColumn("children", F.coalesce("children", F.lit(0)))


def shared_pairs(rows: DataFrame, tokens: Column) -> DataFrame:
    """(a, b): pairs a < b of sid that share one of the tokens (an array column), each once."""
    t = rows.select("sid", F.explode(F.array_distinct(tokens)).alias("token"))
    return t.select(F.col("sid").alias("a"), "token").join(t.select(F.col("sid").alias("b"), "token"), "token").where("a < b").select("a", "b").distinct()


def _sides(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("sid").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)), side)
    return pairs


def _only(sources: Column, kinds: tuple) -> Column:
    return F.forall(sources, lambda s: s.isin(*kinds))


def overlapping(situations: DataFrame, rejected: DataFrame | None = None, similar: DataFrame | None = None) -> DataFrame:
    """(parent, child, skip_audit): pairs of top situations that should merge, the larger as parent (of equal ones a, the lesser sid).

    They are looked at where they share an entity, topic, normal region or title word of more than two bytes, or
    where similar (a, b, similarity; a < b) has them. rejected: pairs (a, b) that may not.
    """
    top = top_level(situations)
    # Parents are compared with five entities of each child, too.
    of_children = situations.where("parent_id is not null").groupBy(F.col("parent_id").alias("sid")).agg(F.flatten(F.collect_list(F.slice(F.array_sort("entities"), 1, 5))).alias("more"))
    top = top.join(of_children, "sid", "left").withColumn("wide", F.array_union("entities", F.coalesce("more", F.array().cast("array<string>"))))
    words = F.filter(F.split(F.lower("title"), r"\s+"), lambda w: F.octet_length(w) > 2)
    mark = lambda xs, m: F.transform(xs, lambda x: F.concat(F.lit(m), x))
    tokens = F.concat(mark(F.col("wide"), "e:"), mark(F.col("topics"), "t:"), mark(F.transform("regions", R.normalize_region), "r:"), mark(words, "w:"))
    pairs = shared_pairs(top, tokens)
    if similar is not None:
        pairs = pairs.union(similar.select("a", "b")).distinct()
    if rejected is not None:
        pairs = pairs.join(rejected, ["a", "b"], "left_anti")
    x = _sides(pairs, top, ["title", "entities", "wide", "topics", "regions", "sources", "event_count", "children"])
    x = x.join(similar, ["a", "b"], "left") if similar is not None else x.withColumn("similarity", F.lit(None).cast("double"))
    c = F.col
    larger_a = c("a_event_count") >= c("b_event_count")
    cap = F.when((c("a_children") > 0) & (c("b_children") > 0), MAX_CHILDREN + 1).otherwise(MAX_CHILDREN)
    room = (F.when(larger_a, c("a_children")).otherwise(c("b_children")) < cap) & (F.greatest("a_event_count", "b_event_count") < MAX_EVENTS)
    cross = (F.size(F.array_intersect("a_regions", "b_regions")) == 0) & (F.size("a_regions") > 0) & (F.size("b_regions") > 0)
    both_parents = (c("a_children") > 0) & (c("b_children") > 0)
    entities = F.when(both_parents, F.size(F.array_intersect("a_wide", "b_wide"))).otherwise(F.size(F.array_intersect("a_entities", "b_entities")))
    topics = F.size(F.array_intersect("a_topics", "b_topics"))
    region = R.regions_overlap(c("a_regions"), c("b_regions"))
    nowhere = (F.size("a_regions") == 0) & (F.size("b_regions") == 0)
    long = lambda t: F.size(F.filter(F.split(F.trim(t), r"\s+"), lambda w: F.octet_length(w) > 2)) >= 3
    title = F.when(long(c("a_title")) & long(c("b_title")), T.title_jaccard(c("a_title"), c("b_title"))).otherwise(0.0)
    sim = F.coalesce("similarity", F.lit(0.0))
    x = x.where(room).select("a", "b", "a_event_count", "b_event_count", "a_entities", "b_entities", "a_topics", "b_topics", "a_sources", "b_sources", *(
        v.alias(k) for k, v in {"larger_a": larger_a, "cross": cross, "shared": entities, "topics": topics, "region": F.coalesce(region, F.lit(False)), "nowhere": nowhere, "alike": title, "sim": sim}.items()
    ))
    place = c("region") | c("nowhere")
    same = (c("alike") >= 0.80) | ((c("alike") >= 0.60) & place & ~c("cross"))
    blank = (F.size("a_entities") == 0) & (F.size("b_entities") == 0) & (c("sim") < 0.75) & (c("alike") < 0.40)
    thin = (F.size("a_entities") + F.size("a_topics") <= 2) & (F.size("b_entities") + F.size("b_topics") <= 2) & (c("sim") < 0.80) & ~((c("alike") >= 0.40) & place)
    # Of equal sizes a counts as the smaller here.
    small_sources = F.when(c("a_event_count") <= c("b_event_count"), c("a_sources")).otherwise(c("b_sources"))
    absorb = ~c("cross") & place & (F.least("a_event_count", "b_event_count") <= 75) & (F.greatest("a_event_count", "b_event_count") >= 50) & ((c("topics") >= 1) | (c("shared") >= 1)) & _only(small_sources, (*N.NEWS, *SOCIAL))
    heuristic = ((c("shared") >= 2) & place) | ((c("alike") >= 0.50) & place & ((c("shared") >= 1) | (~c("cross") & (c("topics") >= 1))))
    boosted = (
        c("sim")
        + F.when(c("shared") >= 2, 0.10).when((c("shared") == 1) & c("region"), 0.05).otherwise(0.0)
        + F.when(c("region"), 0.03).otherwise(0.0)
        + F.when(c("alike") >= 0.6, 0.05).otherwise(0.0)
        + F.when(c("topics") >= 2, 0.05).otherwise(0.0)
    )
    disaster = F.exists("a_topics", N.is_disaster_topic) & F.exists("b_topics", N.is_disaster_topic)
    least = F.when(c("cross") & ~disaster, 0.80).when(_only(c("a_sources"), N.NEWS) & _only(c("b_sources"), N.NEWS), 0.70).otherwise(0.65)
    vector = F.when(c("sim") < 0.01, heuristic).otherwise(boosted >= least)
    merge = same | (~blank & ~thin & (absorb | vector))
    skip = same | absorb | (c("sim") < 0.01)
    return x.where(merge).select(F.when(c("larger_a"), c("a")).otherwise(c("b")).alias("parent"), F.when(c("larger_a"), c("b")).otherwise(c("a")).alias("child"), skip.alias("skip_audit"))


def by_topic(situations: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """(parent, child): top situations with two topics, an entity and a topic, or enough words of their titles in common.

    Titles count by their stems: four tenths of all, two of them or a country's, one of them in at most eight titles or a country's.
    """
    top = top_level(situations).withColumn("stems", T.stems(F.col("title")))
    longer = lambda xs: F.filter(xs, lambda x: F.octet_length(x) >= 3)
    mark = lambda xs, m: F.transform(xs, lambda x: F.concat(F.lit(m), x))
    pairs = shared_pairs(top, F.concat(mark(longer(F.col("topics")), "t:"), mark(longer(F.col("entities")), "e:"), mark(F.col("stems"), "w:")))
    if rejected is not None:
        pairs = pairs.join(rejected, ["a", "b"], "left_anti")
    common = top.select(F.explode("stems").alias("stem")).groupBy("stem").count().where("count <= 8").select("stem")
    x = _sides(pairs, top, ["topics", "entities", "stems", "event_count"])
    x = x.withColumn("both", F.array_intersect("a_stems", "b_stems"))
    rare = x.select("a", "b", F.explode("both").alias("stem")).join(F.broadcast(common), "stem").select("a", "b").distinct().withColumn("rare", F.lit(True))
    x = x.join(rare, ["a", "b"], "left")
    c = F.col
    topics = F.size(F.array_intersect(longer(c("a_topics")), longer(c("b_topics"))))
    all_topics = F.size(F.array_intersect("a_topics", "b_topics"))
    entities = F.size(F.array_intersect(longer(c("a_entities")), longer(c("b_entities"))))
    country = F.exists("both", lambda w: w.isin(*COUNTRY_STEMS))
    titles = (country | F.coalesce("rare", F.lit(False))) & ((F.size("both") >= 2) | country) & (F.size("both") / F.size(F.array_union("a_stems", "b_stems")) >= 0.40)
    # A pair is judged once, by the first of topics, entities and titles in which it meets.
    merge = F.when(topics >= 1, all_topics >= 2).when(entities >= 1, all_topics >= 1).otherwise(titles)
    larger_a = c("a_event_count") >= c("b_event_count")
    return x.where(merge).select(F.when(larger_a, c("a")).otherwise(c("b")).alias("parent"), F.when(larger_a, c("b")).otherwise(c("a")).alias("child"))


def theater(title: Column) -> Column:
    """The conflict or country that a title names: a conflict's if any word names one and the title is about fighting, else the first country's."""
    low = F.lower(title)
    conflict = None
    for word in COUNTRIES:  # the first that names a conflict decides which
        name = next((t for t, ws in THEATERS.items() if word in ws), None)
        if name:
            conflict = F.when(low.contains(word), name) if conflict is None else conflict.when(low.contains(word), name)
    country = None
    for word in COUNTRIES:
        if not any(word in ws for ws in THEATERS.values()):
            country = F.when(low.contains(word), word) if country is None else country.when(low.contains(word), word)
    return F.when(conflict.isNotNull(), F.when(N.contains_any(low, FIGHTING), conflict)).otherwise(country)


def by_country(situations: DataFrame) -> DataFrame:
    """(parent, child): where a conflict or country has too many top situations, all join the one with the most events, up to its cap of children.

    Too many are 2 of more than 100 top situations, 3 of more than 50, else 4.
    """
    top = top_level(situations).withColumn("theater", theater(F.col("title")))
    n = top.agg(F.count("*").alias("n"))
    first = top.where("theater is not null").groupBy("theater").agg(F.count("*").alias("size"), F.min(F.struct((-F.col("event_count")).alias("minus"), "sid")).alias("x"))
    first = first.select("theater", "size", F.col("x.sid").alias("parent"))
    first = first.crossJoin(F.broadcast(n)).where(F.col("size") >= F.when(F.col("n") > 100, 2).when(F.col("n") > 50, 3).otherwise(4)).select("theater", "parent")
    had = top.select(F.col("sid").alias("parent"), F.col("children").alias("had"))
    x = top.join(first, "theater").where("sid <> parent").join(had, "parent")
    rank = F.row_number().over(W.partitionBy("parent").orderBy(F.col("event_count").desc(), "sid"))
    return x.withColumn("rank", rank).where(F.col("rank") + F.col("had") <= MAX_CHILDREN).select("parent", F.col("sid").alias("child"))


def chosen(situations: DataFrame, merges: DataFrame) -> DataFrame:
    """(parent, child): of the merges those that hold together: a child has one parent, and no parent becomes a child.

    Each child takes its best parent, by events and then by name; where that one itself has a parent it would
    take, it waits: the merge is left for the next round, as the situations then stand.
    """
    size = situations.select(F.col("sid").alias("parent"), "event_count")
    best = merges.join(size, "parent").groupBy("child").agg(F.min(F.struct((-F.col("event_count")).alias("minus"), "parent")).alias("x")).select("child", F.col("x.parent").alias("parent"))
    return best.join(best.select(F.col("child").alias("parent")), "parent", "left_anti").select("parent", "child")


def apply_merges(situations: DataFrame, merges: DataFrame, standalone: int = 15) -> DataFrame:
    """Situations after (parent, child) merges: children get their parent, their own children too, and parents the children's data.

    Events add up, sources unite, titles are appended to 30, severity is the highest of the parent and its children of `standalone`
    events or more, times widen; signals stay where they were seen.
    """
    m = merges.select(F.col("child").alias("sid"), F.col("parent").alias("new_parent"))
    kids = situations.join(m, "sid").groupBy(F.col("new_parent").alias("sid")).agg(
        F.sum("event_count").alias("n"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("s"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sid", "event_titles"))), lambda t: t["event_titles"])).alias("t"),
        F.max(F.when(F.col("event_count") >= standalone, F.col("severity_rank"))).alias("r"),
        F.min("first_seen").alias("f"),
        F.max("last_updated").alias("u"),
    )
    up = m.select(F.col("sid").alias("parent_id"), F.col("new_parent").alias("grandparent"))
    x = situations.join(m, "sid", "left").join(kids, "sid", "left").join(up, "parent_id", "left")
    had = F.col("n").isNotNull()
    set_ = {
        "parent_id": F.coalesce("new_parent", "grandparent", "parent_id"),
        "event_count": F.col("event_count") + F.coalesce("n", F.lit(0)),
        "sources": F.when(had, F.array_sort(F.array_union("sources", "s"))).otherwise(F.col("sources")),
        "event_titles": F.when(had, F.slice(F.concat("event_titles", "t"), 1, 30)).otherwise(F.col("event_titles")),
        "severity_rank": F.greatest("severity_rank", F.coalesce("r", F.lit(0))),
        "first_seen": F.least("first_seen", F.coalesce("f", F.col("first_seen"))),
        "last_updated": F.greatest("last_updated", F.coalesce("u", F.col("last_updated"))),
    }
    return x.select(*(set_[c].alias(c) if c in set_ else F.col(c) for c in situations.columns))

"""Entity graphs and trees: neighbours, reach with paths, descendants, and what is drawn of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of entities that an impact is reckoned for.
AFFECTED = ("location", "facility", "organization", "military_unit")
c = F.col


def neighbours(edges: DataFrame, entity: str) -> DataFrame:
    """(id, relationship, direction) of an entity's edges (source, target, relationship), out and in."""
    out = edges.where(c("source") == entity).select(c("target").alias("id"), "relationship", F.lit("outgoing").alias("direction"))
    return out.unionByName(edges.where(c("target") == entity).select(c("source").alias("id"), "relationship", F.lit("incoming").alias("direction")))


def reach(edges: DataFrame, entity: str, hops: int) -> DataFrame:
    """(id, hops, path): entities within so many hops over edges either way, each at its least number, by the first path by name.

    Nodes that were reached are not walked again.
    """
    both = edges.select(c("source").alias("at"), c("target").alias("id"), "relationship").unionByName(edges.select(c("target").alias("at"), c("source").alias("id"), "relationship"))
    seen = frontier = edges.sparkSession.createDataFrame([(entity, 0, [])], "id string, hops int, path array<string>")
    for n in range(1, hops + 1):
        step = frontier.select(c("id").alias("at"), "path").join(both, "at").select("id", F.concat("path", F.array("relationship")).alias("path"))
        frontier = step.groupBy("id").agg(F.min("path").alias("path")).join(seen.select("id"), "id", "left_anti").select("id", F.lit(n).alias("hops"), "path")
        seen = seen.unionByName(frontier)
    return seen.where("hops > 0")


def impact(edges: DataFrame, entities: DataFrame, entity: str, hops: int, most: int = 20) -> DataFrame:
    """(id, name, type, path, hops, impact): places, facilities, organisations and units within reach, the impact halved with each hop, the highest `most`."""
    x = reach(edges, entity, hops).join(entities, "id").where(c("type").isin(*AFFECTED)).withColumn("impact", F.pow(F.lit(0.5), c("hops")))
    return x.select("id", "name", "type", "path", "hops", "impact").orderBy(c("impact").desc(), "id").limit(most)


def impact_summary(found: DataFrame) -> DataFrame:
    """One row (summary): what is affected directly and at second hand, by name; empty without any."""
    named = F.format_string("%s (%s)", c("name"), c("type"))
    part = lambda when: F.array_join(F.array_sort(F.collect_list(F.when(when, named))), ", ")
    x = found.agg(part(c("hops") == 1).alias("direct"), part(c("hops") >= 2).alias("second"))
    parts = F.array_compact(F.array(F.when(c("direct") != "", F.concat(F.lit("Directly affects: "), c("direct"))), F.when(c("second") != "", F.concat(F.lit("Secondary impact: "), c("second")))))
    return x.select(F.when(F.size(parts) > 0, F.concat(F.array_join(parts, ". "), F.lit("."))).otherwise("").alias("summary"))


def drawn_edges(edges: DataFrame) -> DataFrame:
    """(a, b, relationship): each pair of entities once for a relationship, the lesser first; none to itself."""
    return edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "relationship").distinct()


def descendants(tree: DataFrame, root: str, depth: int = 32) -> DataFrame:
    """(id, depth): everything under a root of (id, parent_id), level by level; a circle ends where it began."""
    seen = level = tree.sparkSession.createDataFrame([(root, 0)], "id string, depth int")
    for n in range(1, depth + 1):
        level = tree.join(level.select(c("id").alias("parent_id")), "parent_id").select("id").distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(n))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen.where("depth > 0")


def without_trees(tree: DataFrame, roots: list[str], depth: int = 32) -> DataFrame:
    """Rows of (id, parent_id, ...) without the given roots and everything under them."""
    gone = tree.sparkSession.createDataFrame([(r,) for r in roots], "id string")
    for r in roots:
        gone = gone.union(descendants(tree.select("id", "parent_id"), r, depth).select("id"))
    return tree.join(gone.distinct(), "id", "left_anti")


def state_changes(mentions: DataFrame, entities: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(id, change, certainty, previous): mentions (entity, from, to, certainty) of known entities (id, name) with a known change; certainty is alleged where none is given."""
    table = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    x = mentions.join(entities.select("id", c("name").alias("entity")), "entity").withColumn("change", F.element_at(table, F.lower("to")))
    return x.where("change is not null").select("id", "change", F.coalesce(F.lower("certainty"), F.lit("alleged")).alias("certainty"), c("from").alias("previous"))


def latest(rows: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """For each key the row with the highest order, of equals the highest tie: without a window, so that partial results are small."""
    rest = [x for x in rows.columns if x not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, tie, *(x for x in rest if x not in (order, tie)))).alias("x"))
    return best.select(*keys, *(c(f"x.{x}").alias(x) for x in rest))


def with_latest_narrative(situations: DataFrame, narratives: DataFrame) -> DataFrame:
    """Situations with the text and version of their latest narrative, null without one."""
    return situations.join(latest(narratives, ["sid"], "version", "text"), "sid", "left")


def source_states(config: DataFrame, health: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered sources with their configuration (enabled where there is none) and health."""
    x = registry.join(config, "source_id", "left").join(health, "source_id", "left")
    return x.select("source_id", "name", F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("failures", F.lit(0)).alias("failures"))

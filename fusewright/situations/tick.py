"""A tick: what is done to all situations every thirty seconds, in its order.

Stale ones go; every second tick overlapping ones, those of a topic and those of a country merge; every fourth the
sweep runs; then phases and severities follow. Each step's table is written in the shared folder before the next
reads it, so plans stay short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from fusewright.plans.staging import written
from fusewright.situations import living, merging


def merged(situations: DataFrame, merges: DataFrame) -> DataFrame:
    """Situations after those of the merges that hold together."""
    return written(merging.apply_merges(situations, written(merging.chosen(situations, merges.select("parent", "child")), "merges")), "situations")


def tick(situations: DataFrame, idf: DataFrame, now: int, number: int, rejected: DataFrame | None = None, similar: DataFrame | None = None) -> DataFrame:
    """Situations after tick `number`, with from_phase and was_rank of what changed. rejected, similar: as merging.overlapping takes them."""
    x = written(living.pruned(situations, now), "situations")
    if number % 2 == 0:
        x = merged(x, merging.overlapping(x, rejected, similar))
        x = merged(x, merging.by_topic(x, rejected))
        x = merged(x, merging.by_country(x))
    if number % 4 == 0:
        x = written(living.swept(x, idf, now), "situations")
    return written(living.evaluate(x, now), "situations")

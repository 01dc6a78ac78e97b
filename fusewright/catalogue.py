"""The engine's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from fusewright.operators import cells, clues, feeds, relational, scalars, text_vector, texts, upkeep, worked, worked_lists, worked_more, worked_rules, worked_situations
from fusewright.plans import dialect


RELATIONAL = relational.QUERIES | scalars.QUERIES | upkeep.QUERIES | feeds.QUERIES | clues.QUERIES


def _relational(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dialect.run(spark, sf_dir, RELATIONAL[name])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored anomalies of the last hour against a week's baselines, without the cut."""
    return _relational(spark, sf_dir, "anomaly_zscore_all")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: partial(_relational, name=n) for n in RELATIONAL} | text_vector.FRAMES | texts.FRAMES | clues.FRAMES | worked.frames() | worked_lists.frames() | worked_more.frames() | worked_rules.frames() | worked_situations.frames() | cells.FRAMES


def oracle_sql() -> dict[str, str]:
    return {n: dialect.render(t) for n, t in RELATIONAL.items()} | text_vector.oracle() | texts.SQL | clues.SQL | worked.oracle() | worked_lists.oracle() | worked_more.oracle() | worked_rules.oracle() | worked_situations.oracle() | cells.oracle()

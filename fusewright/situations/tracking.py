"""Series kept beside situations: bursts of topics, middles of vectors, merges that were turned down."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ratio of the short to the long rate above which a topic's anomaly is so high.
TIERS = ((3.0, 1.0), (2.0, 0.75), (1.5, 0.5), (1.0, 0.25))


def burst_scores(topics: DataFrame, short: float = 300.0, long: float = 21_600.0, least: float = 0.001) -> DataFrame:
    """(topic, ratio, anomaly) after all events of (n, t, topic), n numbering the events in order of t.

    Each event adds to its topics 1 - 2 ** (-dt / half-life), dt from the event before (of any topic, a millisecond at
    least), and what a topic has fades since its own last event: two sums of exponentials, so no state is kept.
    """
    c = F.col
    # Events are numbered, so the one before is joined by its number.
    times = topics.select("n", "t").distinct()
    before = times.select((c("n") + 1).alias("n"), c("t").alias("before"))
    steps = times.join(before, "n", "left").withColumn("dt", F.greatest(F.coalesce(c("t") - c("before"), F.lit(0.001)), F.lit(0.001)))
    end = times.agg(F.max("t").alias("end"))
    x = topics.select("n", "t", "topic").join(steps.select("n", "dt"), "n").crossJoin(F.broadcast(end))
    rate = lambda h: F.sum((1 - F.exp(-0.693 * c("dt") / h)) * F.exp(-0.693 * (c("end") - c("t")) / h))
    out = x.groupBy("topic").agg(rate(short).alias("s"), rate(long).alias("l"))
    ratio = F.when(c("l") < least, F.when(c("s") > least, 3.0).otherwise(1.0)).otherwise(c("s") / c("l"))
    anomaly = F.lit(0.0)
    for over, score in reversed(TIERS):
        anomaly = F.when(ratio > over, score).otherwise(anomaly)
    return out.select("topic", ratio.alias("ratio"), anomaly.alias("anomaly"))


def ewma_centroids(vectors: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(sid, vector): the first vector of each, then moved by `alpha` towards each next, of (sid, n, vector) in order of n: a sum with weights that fade."""
    by = W.partitionBy("sid")
    rank = vectors.withColumn("k", F.row_number().over(by.orderBy("n"))).withColumn("many", F.count("*").over(by))
    weight = F.when(F.col("k") == 1, F.pow(F.lit(1 - alpha), F.col("many") - 1)).otherwise(alpha * F.pow(F.lit(1 - alpha), F.col("many") - F.col("k")))
    each = rank.select("sid", weight.alias("w"), F.posexplode("vector").alias("i", "x"))
    sums = each.groupBy("sid", "i").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return sums.groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


def live_rejections(rejected: DataFrame, now: int, seconds: int = 3600) -> DataFrame:
    """(a, b): pairs, the lesser first, that were turned down no longer ago than `seconds`."""
    pairs = rejected.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "t")
    return pairs.groupBy("a", "b").agg(F.max("t").alias("t")).where(F.lit(now) - F.col("t") <= seconds).select("a", "b")


def nearest(vectors: DataFrame, target: list[float], limit: int, least: float = 0.0) -> DataFrame:
    """(id, similarity): the most similar vectors by cosine, at least so; ties by id. One pass, and a heap for each task."""
    norm = math.sqrt(sum(x * x for x in target)) or 1.0
    goal = F.array(*(F.lit(float(x / norm)) for x in target))
    dot = F.aggregate(F.zip_with("vector", goal, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    like = F.when(size > 0, dot / size).otherwise(0.0)
    return vectors.select("id", like.alias("similarity")).where(F.col("similarity") >= least).orderBy(F.col("similarity").desc(), "id").limit(limit)


def ivf_index(vectors: DataFrame, lists: int = 16, sample: int = 4096, rounds: int = 8, seed: int = 5) -> tuple[np.ndarray, DataFrame]:
    """Centres of `lists` cells, from a bounded sample by the hash of id, and all vectors with the cell of their nearest centre."""
    rows = vectors.where(F.size("vector") > 0).orderBy(F.xxhash64(F.lit(seed), "id")).limit(sample).select("vector").collect()
    x = np.array([r[0] for r in rows], float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[: min(lists, len(x))].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        for k in range(len(centres)):
            if (near == k).any():
                m = x[near == k].mean(0)
                centres[k] = m / max(np.linalg.norm(m), 1e-12)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = np.stack([np.asarray(r, float) for r in b["vector"]])
                yield b.assign(cell=(v @ centres.T).argmax(1).astype("int32"))

    return centres, vectors.select("id", "vector").mapInPandas(place, "id long, vector array<double>, cell int")


def ivf_search(index: tuple[np.ndarray, DataFrame], target: list[float], limit: int, probes: int = 11) -> DataFrame:
    """As nearest(), over the `probes` cells whose centres are most like the target."""
    centres, rows = index
    goal = np.asarray(target, float)
    cells = np.argsort(-(centres @ goal))[:probes].tolist()
    return nearest(rows.where(F.col("cell").isin(*cells)), list(target), limit)

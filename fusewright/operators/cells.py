"""Queries whose windows and joins go by cells of time and place, so that no key's rows are one task's.

The SQL check has the plain form: a window over the key, a join by the condition alone, a recursion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fusewright.functions import lifecycle as L
from fusewright.functions import regions as R
from fusewright.functions.geo import haversine_km
from fusewright.operators import relational
from fusewright.plans import dialect
from fusewright.rules import evidence as E

c = F.col


def _events(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return dialect.run(spark, sf_dir, f"WITH EV SELECT * FROM ev WHERE {where}")


def velocity_5m_30m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the same source in the 5 and 30 minutes up to each."""
    rows = _events(spark, sf_dir).select("event_id", "t", "source_type")
    every = {"n": F.lit(1)}
    short, long = (E.running_counts(rows, "source_type", every, s) for s in (300, 1800))
    return short.select("event_id", c("n").alias("v5")).join(long.select("event_id", c("n").alias("v30")), "event_id")


def tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds until the next analysis by the events a minute of the last five."""
    n = E.running_counts(_events(spark, sf_dir).select("event_id", "t", "source_type"), "source_type", {"n": F.lit(1)}, 300)
    return n.select("event_id", F.when(c("n") / 5 > 20, 900).when(c("n") / 5 > 5, 3600).otherwise(7200).alias("interval_s"))


def incident_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High events with none of their source and region in the hour before."""
    rows = _events(spark, sf_dir, "severity_rank >= 3").select("event_id", "source_type", "region", "t", F.floor(c("t") / 86400).alias("cell"))
    keys = ["source_type", "region"]
    # Within a day by the day's own window; across days by each day's last.
    days = rows.groupBy(*keys, "cell").agg(F.max("t").alias("last")).withColumn("before", F.max("last").over(W.partitionBy(*keys).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)))
    own = rows.withColumn("gap", c("t") - F.lag("t").over(W.partitionBy(*keys, "cell").orderBy("t", "event_id")))
    same = [own[k].eqNullSafe(days[k]) for k in [*keys, "cell"]]
    x = own.join(days, same).select(own["event_id"], own["source_type"], own["region"], F.coalesce("gap", own["t"] - days["before"]).alias("gap"))
    return x.where("gap is null or gap > 3600").select("event_id", "source_type", "region")


def _near(spark: SparkSession, sf_dir: str, left: str, right: str, km: float, seconds: int) -> DataFrame:
    rows = _events(spark, sf_dir, f"source_type IN ('{left}', '{right}')").select("event_id", "t", "lat", "lon", "source_type")
    return E.near(rows.where(c("source_type") == left), rows.where(c("source_type") == right), km, seconds, seconds)


def near_pairs_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, "error", "purchase", 800, 600).select(c("trigger_id").alias("a_id"), c("event_id").alias("b_id"))


def near_pairs_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_pairs_bbox(spark, sf_dir)
    place = _events(spark, sf_dir, "source_type IN ('error', 'purchase')").select("event_id", "lat", "lon")
    for side in ("a", "b"):
        pairs = pairs.join(place.select(c("event_id").alias(f"{side}_id"), F.struct("lat", "lon").alias(side)), f"{side}_id")
    return pairs.select("a_id", "b_id", F.round(F.expr(haversine_km("a.lat", "a.lon", "b.lat", "b.lon")), 3).alias("km"))


def conflict_thermal_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _near(spark, sf_dir, "signup", "error", 2500, 21600)
    return pairs.groupBy("trigger_id").agg(F.count("*").alias("evidence")).where("evidence >= 3")


def graph_neighborhood(spark: SparkSession, sf_dir: str, hops: int = 2) -> DataFrame:
    """Nodes within so many hops of a region over edges either way, each at its least number of hops; impact halves with each."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    node = lambda mark, column: F.concat(F.lit(mark), c(column).cast("string"))
    edges = read("customer").select(node("c", "c_custkey").alias("a"), node("n", "c_nationkey").alias("b")).unionByName(read("nation").select(node("n", "n_nationkey").alias("a"), node("g", "n_regionkey").alias("b")))
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    seen = frontier = spark.createDataFrame([("g0", 0)], "id string, hops int")
    for n in range(1, hops + 1):
        # A node that was reached isn't walked again, so paths don't multiply at hubs.
        frontier = frontier.join(both, frontier["id"] == both["a"]).select(c("b").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(n))
        seen = seen.unionByName(frontier)
    return seen.where("hops > 0").select("id", "hops", F.round(F.pow(F.lit(0.5), c("hops")), 6).alias("impact"))


def json_key_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose properties have the key k, and its value as text."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get_json_object("props", "$.k").alias("k")).where("k is not null")


#: What is counted of each user's events, for the life of a situation.
_COUNTED = """SELECT entity_id, CAST(CAST(entity_id AS BIGINT) % 6 AS INT) AS phase_no, max(severity_rank) AS severity_rank, count(DISTINCT source_type) AS diversity, count(*) AS events,
count(CASE WHEN t >= 1706486400 - 86400 AND t < 1706486400 THEN 1 END) AS velocity, count(*) / CAST(30 AS DOUBLE) AS peak, (1706486400 - max(t)) / CAST(3600 AS DOUBLE) AS idle,
max(CASE WHEN region IN ('r2', 'r3') THEN 1 ELSE 0 END) AS war, max(CASE WHEN region = 'r1' THEN 1 ELSE 0 END) AS disaster, max(CASE WHEN source_type = 'signup' THEN 1 ELSE 0 END) AS cyber,
max(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) AS child FROM ev WHERE t < 1706486400 GROUP BY entity_id"""
PHASES = ("emerging", "developing", "active", "declining", "resolved", "historical")


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = dialect.run(spark, sf_dir, f"WITH EV {_COUNTED}")
    return x.withColumn("phase", F.element_at(F.array(*map(F.lit, PHASES)), c("phase_no") + 1)).withColumn("tolerance", L.gap_tolerance(c("severity_rank"), c("diversity"), c("peak"), c("idle") * 60))


def gap_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir).select("entity_id", F.round("tolerance", 6).alias("hours"))


def phase_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _counted(spark, sf_dir)
    rate = c("velocity").cast("double")
    peak = F.greatest(L.decayed_peak(c("peak"), c("idle") * 60), rate)
    return x.select("entity_id", "phase", L.next_phase(c("phase"), c("velocity"), peak, rate, c("diversity"), c("severity_rank"), c("idle"), c("events"), c("tolerance")).alias("next_phase"))


def cluster_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _counted(spark, sf_dir)
    one = lambda n: c(n) == 1
    rank = L.recomputed_rank(c("phase"), c("severity_rank") >= 3, one("war"), one("cyber"), one("disaster"), c("events"), c("diversity"), one("child"), c("idle"))
    return x.select("entity_id", "phase", L.severity_label(rank).alias("severity"))


def region_from_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", R.region_from_coords(c("lat"), c("lon")).alias("region_name"))


def decayed_peak_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's rate of ten minutes, and the peak that it keeps: halved every 30 minutes, or the rate if that is more.

    A peak of n falls below a rate of 1 within 30 * log2(n) minutes, so rates of the 64 half-lives before suffice, by overlapping cells.
    """
    r = _events(spark, sf_dir).groupBy("source_type", F.floor(c("t") / 600).alias("b")).agg(F.count("*").cast("double").alias("rate"))
    reach, length = 192, 1536
    cell = F.floor(c("b") / length)
    both = r.select("*", F.explode(F.when(c("b") % length >= length - reach, F.array(cell, cell + 1)).otherwise(F.array(cell))).alias("cell"))
    # Halving from the cell's start keeps powers small: at most 2 ** 58.
    place = (c("b") - c("cell") * length + reach) / 3.0
    over = W.partitionBy("source_type", "cell").orderBy("b").rangeBetween(-reach, 0)
    log = F.max(F.log2("rate") + place).over(over)
    x = both.withColumn("peak", F.pow(F.lit(2.0), log - place)).where(cell == c("cell"))
    return x.select("source_type", "b", "rate", F.round("peak", 6).alias("peak"))


FRAMES = {f.__name__: f for f in (velocity_5m_30m, tempo, incident_suppression, near_pairs_bbox, near_pairs_haversine, conflict_thermal_like, graph_neighborhood, gap_tolerance, phase_transition, cluster_severity, region_from_coords, decayed_peak_rate, json_key_exists)}

_TOLERANCE = """CASE WHEN diversity <= 1 THEN least(CASE severity_rank WHEN 4 THEN 12e0 WHEN 3 THEN 8e0 WHEN 2 THEN 4e0 ELSE 2e0 END, 6e0) ELSE least(24e0, CASE severity_rank WHEN 4 THEN 12e0 WHEN 3 THEN 8e0 WHEN 2 THEN 4e0 ELSE 2e0 END
 * (1 + 0.5e0 * least(3e0, greatest(0e0, peak * power(0.5e0, floor(idle * 60) / 30e0) / 5))) * (1 + 0.3e0 * (least(2e0, greatest(1e0, diversity / 2e0)) - 1))) END"""
_LIVES = f"""WITH EV, counted AS ({_COUNTED}), lives AS (SELECT *, {_TOLERANCE} AS tolerance, greatest(peak * power(0.5e0, floor(idle * 60) / 30e0), velocity * 1e0) AS top,
CASE phase_no WHEN 0 THEN 'emerging' WHEN 1 THEN 'developing' WHEN 2 THEN 'active' WHEN 3 THEN 'declining' WHEN 4 THEN 'resolved' ELSE 'historical' END AS phase FROM counted)"""
SQL = {
    "gap_tolerance": f"{_LIVES} SELECT entity_id, round(tolerance, 6) AS hours FROM lives",
    "phase_transition": f"""{_LIVES} SELECT entity_id, phase, CASE phase
WHEN 'emerging' THEN CASE WHEN events >= 3 AND diversity >= 2 OR severity_rank >= 3 THEN 'developing' WHEN idle > 6 THEN 'resolved' END
WHEN 'developing' THEN CASE WHEN velocity >= 5 OR (CASE WHEN diversity >= 3 THEN 1 ELSE 0 END) + (CASE WHEN severity_rank >= 3 THEN 1 ELSE 0 END) + (CASE WHEN events >= 10 THEN 1 ELSE 0 END) + (CASE WHEN events >= 50 THEN 1 ELSE 0 END) >= 3 THEN 'active'
  WHEN idle > tolerance THEN 'declining' END
WHEN 'active' THEN CASE WHEN top > 0 AND velocity < 0.3e0 * top OR idle > tolerance / 2 THEN 'declining' END
WHEN 'declining' THEN CASE WHEN top > 0 AND velocity > 0.7e0 * top THEN 'active' WHEN idle > 1.5e0 * tolerance THEN 'resolved' END
WHEN 'resolved' THEN CASE WHEN idle > 3 * tolerance THEN 'historical' WHEN velocity > 0 THEN 'developing' END END AS next_phase FROM lives""",
    "cluster_severity": f"""{_LIVES}, ranked AS (SELECT *, CASE WHEN phase = 'active' AND severity_rank >= 3 AND war = 1 AND events >= 40 AND diversity >= 4 THEN 4
WHEN phase IN ('active', 'developing') AND (war = 1 AND events >= 25 AND diversity >= 3 OR (cyber = 1 OR disaster = 1) AND diversity >= 2 AND events >= 25 OR events >= 40 AND diversity >= 4) THEN 3
WHEN (war = 1 OR cyber = 1 OR disaster = 1) AND diversity >= 2 OR diversity >= 4 AND events >= 5 THEN 2 ELSE 1 END AS r FROM lives)
SELECT entity_id, phase, CASE least(r, CASE WHEN child = 1 THEN 3 ELSE 4 END, CASE WHEN floor(idle) > 48 THEN 2 ELSE 4 END) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity FROM ranked""",
    "region_from_coords": """WITH EV SELECT event_id, CASE WHEN lat BETWEEN 12 AND 42 AND lon BETWEEN 25 AND 63 THEN 'middle-east' WHEN lat BETWEEN 44 AND 60 AND lon BETWEEN 22 AND 50 THEN 'eastern-europe'
WHEN lat BETWEEN 35 AND 72 AND lon BETWEEN -12 AND 22 THEN 'western-europe' WHEN lat BETWEEN 18 AND 55 AND lon BETWEEN 100 AND 150 THEN 'east-asia' WHEN lat BETWEEN -12 AND 25 AND lon BETWEEN 90 AND 140 THEN 'southeast-asia'
WHEN lat BETWEEN 5 AND 38 AND lon BETWEEN 60 AND 100 THEN 'south-asia' WHEN lat BETWEEN -35 AND 37 AND lon BETWEEN -18 AND 52 AND lat < 12 THEN 'africa' WHEN lat BETWEEN 15 AND 37 AND lon BETWEEN -18 AND 25 THEN 'north-africa'
WHEN lat BETWEEN 15 AND 85 AND lon BETWEEN -170 AND -52 THEN 'north-america' WHEN lat BETWEEN -56 AND 15 AND lon BETWEEN -82 AND -34 THEN 'south-america' WHEN lat BETWEEN 7 AND 23 AND lon BETWEEN -92 AND -59 THEN 'central-america'
WHEN lat BETWEEN -50 AND 0 AND lon BETWEEN 110 AND 180 THEN 'oceania' WHEN lat BETWEEN 35 AND 55 AND lon BETWEEN 50 AND 90 THEN 'central-asia' WHEN lat >= 65 THEN 'arctic' ELSE 'global' END AS region_name FROM ev""",
    "json_key_exists": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM {events} WHERE json_extract_string(props, '$.k') IS NOT NULL",
    "decayed_peak_rate": """WITH EV, r AS (SELECT source_type, CAST(floor(t / 600) AS BIGINT) AS b, CAST(count(*) AS DOUBLE) AS rate FROM ev GROUP BY 1, 2)
SELECT x.source_type, x.b, x.rate, round(max(y.rate * power(0.5e0, (x.b - y.b) / 3e0)), 6) AS peak FROM r x JOIN r y ON x.source_type = y.source_type AND y.b <= x.b GROUP BY x.source_type, x.b, x.rate""",
}
#: Windows and joins as they were, for the check.
PLAIN = ("velocity_5m_30m", "tempo", "incident_suppression", "near_pairs_bbox", "near_pairs_haversine", "conflict_thermal_like", "graph_neighborhood")


def oracle() -> dict[str, str]:
    return {n: dialect.render(t) for n, t in SQL.items()} | {n: dialect.render(relational.QUERIES[n]) for n in PLAIN}

"""Rollups, baselines, filters, joins, rankings, rules, scores and graph walks over events, by name.

Range joins meet in cells of time (each row in its own, the probe in its neighbours), never by all pairs.
"""

from fusewright.functions.geo import cell, haversine_km, in_box


def _rollup(seconds: int, keys: str, more: str = "") -> str:
    return f"""WITH EV SELECT CAST(floor(t / {seconds}) * {seconds} AS BIGINT) AS bucket, {keys}, CAST(count(*) AS BIGINT) AS n_events{more}
FROM ev GROUP BY CAST(floor(t / {seconds}) * {seconds} AS BIGINT), {keys}"""


_ENTITIES = ", CAST(count(DISTINCT entity_id) AS BIGINT) AS n_entities"
_CONFIDENCE = ", round(avg(confidence), 10) AS avg_confidence"

_ZSCORE = """WITH EV, cur AS (SELECT source_type, region, CAST(count(*) AS BIGINT) AS cnt FROM ev WHERE t >= AS_OF - 3600 AND t < AS_OF GROUP BY source_type, region),
hourly AS (SELECT source_type, region, floor(t / 3600) AS h, count(*) AS n FROM ev WHERE t >= AS_OF - 604800 AND t < AS_OF - 3600 GROUP BY source_type, region, floor(t / 3600)),
base AS (SELECT source_type AS bs, region AS br, avg(n) AS mean, stddev_samp(n) AS sd FROM hourly GROUP BY source_type, region),
z AS (SELECT source_type, region, cnt, round((cnt - coalesce(mean, 10)) / greatest(coalesce(sd, 5), CAST(0.1 AS DOUBLE)), 6) AS z
      FROM cur LEFT JOIN base ON source_type = bs AND region IS NOT DISTINCT FROM br)
SELECT source_type, region, cnt, z FROM z"""


def _near(pairs: str, km: float, seconds: int, left: str, right: str) -> str:
    """Pairs of events of two types near in place and time. The probe side visits three cells of time."""
    return f"""WITH EV, a AS (SELECT *, CAST(floor(t / {seconds}) AS BIGINT) AS c FROM ev WHERE source_type = '{left}'),
b AS (SELECT *, CAST(floor(t / {seconds}) AS BIGINT) + d AS c FROM ev CROSS JOIN (VALUES (-1), (0), (1)) AS n(d) WHERE source_type = '{right}')
SELECT a.event_id AS a_id, b.event_id AS b_id{pairs} FROM a JOIN b ON a.c = b.c AND abs(a.t - b.t) <= {seconds}
WHERE {in_box("a.lat", "a.lon", "b.lat", "b.lon", km)}"""


_KM = haversine_km("a.lat", "a.lon", "b.lat", "b.lon")

QUERIES = {
    # Rollups and statistics
    "rollup_5min": _rollup(300, "source_type, region, severity", _ENTITIES),
    "rollup_15min": _rollup(900, "source_type, region, severity", _ENTITIES + _CONFIDENCE),
    "rollup_hourly": _rollup(3600, "source_type, region, severity", _ENTITIES + _CONFIDENCE),
    "rollup_daily": _rollup(86400, "source_type, region", _ENTITIES + _CONFIDENCE),
    "baseline_dow": """WITH EV SELECT CAST(floor(t / 3600) * 3600 AS BIGINT) AS bucket, source_type, region, CAST((floor(t / 86400) + 4) % 7 AS BIGINT) AS dow, CAST(count(*) AS BIGINT) AS n_events
FROM ev GROUP BY CAST(floor(t / 3600) * 3600 AS BIGINT), source_type, region, CAST((floor(t / 86400) + 4) % 7 AS BIGINT)""",
    "timeseries_tier": """WITH EV SELECT CAST(floor(t / 3600) * 3600 AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n_events FROM ev
WHERE source_type = 'click' AND region = 'r1' AND t >= AS_OF - 1209600 AND t < AS_OF GROUP BY CAST(floor(t / 3600) * 3600 AS BIGINT) ORDER BY bucket DESC LIMIT 500""",
    "anomaly_zscore": _ZSCORE + " WHERE z > 2 ORDER BY z DESC, source_type, region LIMIT 50",
    "anomaly_zscore_all": _ZSCORE,
    "baseline_refresh": """WITH EV, h AS (SELECT source_type, region, floor(t / 3600) AS b, count(*) AS n FROM ev GROUP BY source_type, region, floor(t / 3600))
SELECT source_type, region, round(avg(n), 6) AS mean, round(greatest(coalesce(stddev_samp(n), 0), CAST(0.1 AS DOUBLE)), 6) AS sd, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY source_type, region""",
    "event_stats": "WITH EV SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(CASE WHEN t >= AS_OF - 86400 AND t < AS_OF THEN 1 END) AS BIGINT) AS last_day FROM ev",
    "source_counts": "WITH EV SELECT source_type, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY source_type",
    "summary_buckets": """WITH EV SELECT CAST(floor(t / 60) * 60 AS BIGINT) AS bucket, source_type, CAST(count(*) AS BIGINT) AS n_events, CAST(count(DISTINCT entity_id) AS BIGINT) AS n_entities,
CAST(count(DISTINCT region) AS BIGINT) AS n_regions, min(event_id) AS highlight FROM ev GROUP BY CAST(floor(t / 60) * 60 AS BIGINT), source_type""",
    "percentile_thresholds": """WITH EV, h AS (SELECT region, CAST(floor(t / 3600) AS BIGINT) AS b, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY region, CAST(floor(t / 3600) AS BIGINT))
SELECT CAST(percentile_disc(0.75) WITHIN GROUP (ORDER BY n) AS BIGINT) AS p75, CAST(percentile_disc(0.9) WITHIN GROUP (ORDER BY n) AS BIGINT) AS p90, CAST(percentile_disc(0.99) WITHIN GROUP (ORDER BY n) AS BIGINT) AS p99 FROM h""",
    "effective_diversity": """WITH EV SELECT entity_id, CAST(count(DISTINCT CASE WHEN source_type IN ('click', 'view') THEN 'browse' ELSE source_type END) AS BIGINT) AS diversity FROM ev GROUP BY entity_id""",
    "median_centroid": """WITH EV, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY t DESC, event_id DESC) AS k FROM ev)
SELECT entity_id, round(median(lat), 6) AS lat, round(median(lon), 6) AS lon FROM r WHERE k <= 30 GROUP BY entity_id""",
    "mean_centroid": "WITH EV SELECT region, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM ev GROUP BY region",
    "severity_propagation": """WITH EV, s AS (SELECT entity_id, avg(CASE WHEN severity_rank >= 3 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS s3, avg(CASE WHEN severity_rank >= 2 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS s2,
avg(CASE WHEN severity_rank >= 1 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS s1 FROM ev GROUP BY entity_id)
SELECT entity_id, CASE WHEN s3 >= 0.34 THEN 3 WHEN s2 >= 0.34 THEN 2 WHEN s1 >= 0.34 THEN 1 ELSE 0 END AS parent_rank FROM s""",
    "digest": """WITH EV SELECT source_type, CAST(count(*) AS BIGINT) AS n, max(severity_rank) AS max_rank, CAST(count(CASE WHEN severity_rank >= 3 THEN 1 END) AS BIGINT) AS n_high
FROM ev WHERE t >= AS_OF - 86400 AND t < AS_OF GROUP BY source_type HAVING count(*) >= 10""",
    "tempo": """WITH EV, w AS (SELECT event_id, count(*) OVER (PARTITION BY source_type ORDER BY t RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS n FROM ev)
SELECT event_id, CASE WHEN n / CAST(5 AS DOUBLE) > 20 THEN 900 WHEN n / CAST(5 AS DOUBLE) > 5 THEN 3600 ELSE 7200 END AS interval_s FROM w""",
    "score_card": """WITH EV, s AS (SELECT entity_id, CASE WHEN value >= 50 THEN 1 ELSE 0 END AS passed, severity_rank + 1 AS weight FROM ev)
SELECT entity_id, round(sum(passed * weight) / CAST(sum(weight) AS DOUBLE), 6) AS score FROM s GROUP BY entity_id""",
    # Filters
    "events_filtered": """WITH EV SELECT event_id, t, source_type, region FROM ev WHERE source_type = 'error' AND region = 'r2' AND t >= AS_OF - 1209600 AND source_type NOT IN ('view')
ORDER BY t DESC, event_id LIMIT 100""",
    "events_geo_bbox": """WITH EV SELECT event_id, t, lat, lon, severity FROM ev WHERE lat > -30 AND lat < 60 AND lon > -20 AND lon < 120 AND severity IN ('high', 'medium') AND source_type IN ('error', 'purchase', 'view')
ORDER BY t DESC, event_id LIMIT 300""",
    "replay_scan": "WITH EV SELECT event_id, t, source_type FROM ev WHERE t >= AS_OF - 864000 AND t < AS_OF - 432000 AND source_type NOT IN ('view', 'signup') ORDER BY t, event_id LIMIT 5000",
    "position_trail": "WITH EV SELECT event_id, t, lat, lon FROM ev WHERE entity_id = '3' AND t > AS_OF - 604800 ORDER BY t DESC, event_id LIMIT 500",
    # Latest, first and ranked rows
    "latest_position": """WITH EV, r AS (SELECT *, row_number() OVER (PARTITION BY source_type, entity_id ORDER BY t DESC, event_id DESC) AS k FROM ev)
SELECT source_type, entity_id, event_id, t AS last_seen, lat, lon FROM r WHERE k = 1""",
    "incidents_distinct_on": """WITH EV, r AS (SELECT *, row_number() OVER (PARTITION BY source_type, region ORDER BY t DESC, event_id) AS k FROM ev WHERE severity_rank >= 2)
SELECT source_type, region, event_id, t FROM r WHERE k = 1 ORDER BY t DESC, event_id LIMIT 200""",
    "dedup_first_wins": """WITH EV, r AS (SELECT *, row_number() OVER (PARTITION BY source_type, entity_id, floor(t / 3600) ORDER BY t, event_id) AS k FROM ev) SELECT event_id, source_type, entity_id FROM r WHERE k = 1""",
    "last_n_per_key": "WITH EV, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY t DESC, event_id DESC) AS k FROM ev) SELECT entity_id, k, event_id FROM r WHERE k <= 30",
    "children_cap": """WITH EV, c AS (SELECT region, entity_id, CAST(count(*) AS BIGINT) AS n FROM ev WHERE region IS NOT NULL GROUP BY region, entity_id),
r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY n DESC, entity_id) AS k FROM c) SELECT region, entity_id, n, k <= 50 AS kept FROM r""",
    "top_entities": "WITH EV SELECT entity_id, CAST(count(*) AS BIGINT) AS mentions FROM ev GROUP BY entity_id ORDER BY mentions DESC, entity_id LIMIT 20",
    "situation_ranking": """WITH EV, g AS (SELECT region, source_type, count(*) AS n, max(severity_rank) AS s, count(DISTINCT entity_id) AS e, max(t) AS last FROM ev GROUP BY region, source_type)
SELECT region, source_type, round(s * 10 + ln(1 + n) * 2 + e / CAST(10 AS DOUBLE) - (AS_OF - last) / CAST(86400 AS DOUBLE), 6) AS score FROM g ORDER BY score DESC, source_type, region LIMIT 50""",
    "velocity_5m_30m": """WITH EV SELECT event_id, CAST(count(*) OVER (PARTITION BY source_type ORDER BY t RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS BIGINT) AS v5,
CAST(count(*) OVER (PARTITION BY source_type ORDER BY t RANGE BETWEEN 1800 PRECEDING AND CURRENT ROW) AS BIGINT) AS v30 FROM ev""",
    "session_gaps": """WITH EV, g AS (SELECT entity_id, t, event_id, CASE WHEN t - lag(t) OVER (PARTITION BY entity_id ORDER BY t, event_id) <= 3600 THEN 0 ELSE 1 END AS fresh FROM ev),
s AS (SELECT entity_id, t, sum(fresh) OVER (PARTITION BY entity_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT entity_id, CAST(session AS BIGINT) AS session, min(t) AS started, max(t) AS ended, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY entity_id, session""",
    "change_detection": """WITH EV, h AS (SELECT region, CAST(floor(t / 86400) AS BIGINT) AS d, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY region, CAST(floor(t / 86400) AS BIGINT)),
l AS (SELECT *, lag(n) OVER (PARTITION BY region ORDER BY d) AS before FROM h) SELECT region, d, n FROM l WHERE before IS NULL OR before <> n""",
    # Joins
    "source_health_24h": """WITH EV, s AS (SELECT DISTINCT source_type FROM ev), c AS (SELECT source_type AS st, count(*) AS n FROM ev WHERE t >= AS_OF - 86400 AND t < AS_OF AND severity_rank >= 2 GROUP BY source_type)
SELECT source_type, CAST(coalesce(n, 0) AS BIGINT) AS last_day FROM s LEFT JOIN c ON source_type = st""",
    "near_pairs_bbox": _near("", 800, 600, "error", "purchase"),
    "near_pairs_haversine": _near(f", round({_KM}, 3) AS km", 800, 600, "error", "purchase"),
    "same_region_pairs": """WITH EV, a AS (SELECT *, CAST(floor(t / 300) AS BIGINT) AS c FROM ev WHERE source_type = 'signup'), b AS (SELECT *, CAST(floor(t / 300) AS BIGINT) + d AS c FROM ev CROSS JOIN (VALUES (-1), (0), (1)) AS n(d) WHERE source_type = 'error')
SELECT a.event_id AS a_id, b.event_id AS b_id FROM a JOIN b ON a.region = b.region AND a.c = b.c AND abs(a.t - b.t) <= 300""",
    "either_side_edges": """SELECT c_custkey AS id, n_name AS other FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE n_name = 'NATION_1' UNION ALL SELECT s_suppkey, n_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE n_nationkey = 1""",
    "parent_children": """SELECT r_name AS parent, CAST(count(n_nationkey) AS BIGINT) AS children FROM {region} LEFT JOIN {nation} ON n_regionkey = r_regionkey GROUP BY r_name""",
    "semi_exists_guard": "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "anti_exclude_ids": "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)",
    # Sets
    "set_difference": """WITH EV SELECT entity_id FROM ev WHERE source_type = 'signup' EXCEPT SELECT entity_id FROM ev WHERE source_type = 'error'""",
    "set_common": "WITH EV SELECT entity_id FROM ev WHERE source_type = 'signup' INTERSECT SELECT entity_id FROM ev WHERE source_type = 'error'",
    "unified_feed": """WITH EV, f AS (SELECT event_id, t, 'event' AS kind FROM ev ORDER BY t DESC, event_id LIMIT 300) SELECT event_id, t, kind FROM f UNION ALL SELECT event_id, t, 'incident' AS kind FROM ev WHERE severity_rank >= 3""",
    # Rules over ranges of time
    "country_burst_counts": """WITH EV, c AS (SELECT region, CAST(floor(t / 300) AS BIGINT) AS b, count(CASE WHEN source_type = 'click' THEN 1 END) AS clicks, count(CASE WHEN source_type = 'error' THEN 1 END) AS errors, count(CASE WHEN source_type = 'view' THEN 1 END) AS views
FROM ev WHERE region IS NOT NULL GROUP BY region, CAST(floor(t / 300) AS BIGINT)) SELECT region, b, CAST(clicks AS BIGINT) AS clicks, CAST(errors AS BIGINT) AS errors, CAST(views AS BIGINT) AS views FROM c WHERE clicks >= 1 AND errors >= 1 AND views >= 1""",
    # Each trigger with its region's evidence of the 300 s up to it, across the bins of country_burst_counts.
    "country_burst_triggers": """WITH EV, w AS (SELECT event_id, region, t, count(CASE WHEN source_type = 'click' THEN 1 END) OVER r AS clicks, count(CASE WHEN source_type = 'error' THEN 1 END) OVER r AS errors, count(CASE WHEN source_type = 'view' THEN 1 END) OVER r AS views
FROM ev WHERE region IS NOT NULL WINDOW r AS (PARTITION BY region ORDER BY t RANGE BETWEEN 300 PRECEDING AND CURRENT ROW))
SELECT event_id, region, t, CAST(clicks AS BIGINT) AS clicks, CAST(errors AS BIGINT) AS errors, CAST(views AS BIGINT) AS views FROM w WHERE clicks >= 1 AND errors >= 1 AND views >= 1""",
    "conflict_thermal_like": f"""WITH EV, a AS (SELECT *, CAST(floor(t / 21600) AS BIGINT) AS c FROM ev WHERE source_type = 'signup'), b AS (SELECT *, CAST(floor(t / 21600) AS BIGINT) + d AS c FROM ev CROSS JOIN (VALUES (-1), (0), (1)) AS n(d) WHERE source_type = 'error')
SELECT a.event_id AS trigger_id, CAST(count(*) AS BIGINT) AS evidence FROM a JOIN b ON a.c = b.c AND abs(a.t - b.t) <= 21600 WHERE {in_box("a.lat", "a.lon", "b.lat", "b.lon", 2500)} GROUP BY a.event_id HAVING count(*) >= 3""",
    "surge_cells": f"""WITH EV, h AS (SELECT {cell("lat", 20)} AS cy, {cell("lon", 20)} AS cx, CAST(floor(t / 21600) AS BIGINT) AS b, count(DISTINCT entity_id) AS n FROM ev GROUP BY {cell("lat", 20)}, {cell("lon", 20)}, CAST(floor(t / 21600) AS BIGINT)),
w AS (SELECT *, avg(n) OVER w AS mu, stddev_pop(n) OVER w AS sd, count(*) OVER w AS k FROM h WINDOW w AS (PARTITION BY cy, cx ORDER BY b ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING))
SELECT cy, cx, b, CAST(n AS BIGINT) AS n, round((n - mu) / greatest(sd, CAST(0.1 AS DOUBLE)), 6) AS z FROM w WHERE k >= 12 AND n > mu + 2 * sd""",
    "incident_suppression": """WITH EV, h AS (SELECT *, t - lag(t) OVER (PARTITION BY source_type, region ORDER BY t, event_id) AS gap FROM ev WHERE severity_rank >= 3) SELECT event_id, source_type, region FROM h WHERE gap IS NULL OR gap > 3600""",
    # Scores
    "certainty": """WITH EV, g AS (SELECT region, count(DISTINCT source_type) AS s, count(*) AS n, count(DISTINCT entity_id) AS e FROM ev GROUP BY region)
SELECT region, round(least(CAST(1 AS DOUBLE), 0.1 + 0.4 / (1 + exp(-1.5 * (s - 2))) + 0.3 / (1 + exp(-0.3 * (n - 10))) + 0.15 * (1 - exp(-0.5 * e))), 6) AS certainty FROM g""",
    "size_penalty": "WITH EV SELECT entity_id, CAST(round(-ln(1 + count(*) / CAST(50 AS DOUBLE))) AS BIGINT) AS penalty FROM ev GROUP BY entity_id",
    "temporal_decay": "WITH EV SELECT event_id, round(value * exp(-0.693 / 24 * greatest(CAST(0 AS DOUBLE), (AS_OF - t) / CAST(3600 AS DOUBLE) - 6)), 6) AS score FROM ev WHERE t < AS_OF",
    "severity_rank_max": "WITH EV SELECT region, CASE max(severity_rank) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS severity FROM ev GROUP BY region",
    "grid_centroid": f"WITH EV SELECT event_id, ({cell('lat')} + 0.5) * 2 AS cell_lat, ({cell('lon')} + 0.5) * 2 AS cell_lon FROM ev".replace("+ 0.5", "+ CAST(0.5 AS DOUBLE)"),
    "fallback_grouping": """WITH EV SELECT coalesce(region, 'global') AS region, CASE WHEN source_type = 'error' THEN 'cyber' WHEN source_type = 'purchase' THEN 'market' ELSE 'intelligence' END AS category, min(t) AS first_seen, max(t) AS last_seen,
CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT source_type) AS BIGINT) AS sources, max(severity_rank) AS rank, round(avg(lat), 6) AS lat FROM ev WHERE t >= AS_OF - 21600 AND t < AS_OF
GROUP BY coalesce(region, 'global'), CASE WHEN source_type = 'error' THEN 'cyber' WHEN source_type = 'purchase' THEN 'market' ELSE 'intelligence' END HAVING count(*) >= 2""",
    # Graph walks
    "graph_neighborhood": """WITH RECURSIVE e AS (SELECT 'c' || CAST(c_custkey AS STRING) AS a, 'n' || CAST(c_nationkey AS STRING) AS b FROM {customer} UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 'g' || CAST(n_regionkey AS STRING) FROM {nation}),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT 'g0' AS id, 0 AS hops UNION ALL SELECT u.b, r.hops + 1 FROM r JOIN u ON u.a = r.id WHERE r.hops < 2)
SELECT id, min(hops) AS hops, round(power(CAST(0.5 AS DOUBLE), min(hops)), 6) AS impact FROM r WHERE id <> 'g0' GROUP BY id""",
}

"""Scalar functions of text, place and identity as queries: one text for both engines."""

from fusewright.functions.geo import haversine_km, in_polygon

#: Outer ring, then a hole, as (latitude, longitude).
ZONE = [[(10, 10), (10, 60), (50, 80), (40, 20)], [(20, 30), (20, 40), (30, 40), (30, 30)]]

QUERIES = {
    # Nautical miles to a fixed place, with the radius in nautical miles.
    "haversine_nm": f"WITH EV SELECT event_id, round({haversine_km('lat', 'lon', 'CAST(50.45 AS DOUBLE)', 'CAST(30.52 AS DOUBLE)', 3440.065)}, 4) AS nm FROM ev",
    # Half-degree camera cell, halves away from zero.
    "camera_cell": "WITH EV SELECT event_id, CAST(round(lat * 2) AS BIGINT) AS cell_lat, CAST(round(lon * 2) AS BIGINT) AS cell_lon FROM ev",
    "viewport_contains": "WITH EV SELECT event_id, lat BETWEEN -10 AND 40 AND lon BETWEEN 20 AND 90 AS inside FROM ev",
    # Key of an event's vector: source and its id.
    "embed_key": "WITH EV SELECT event_id, source_type || ':' || coalesce(source_id, source_type || ':' || CAST(t AS STRING)) AS embed_key FROM ev",
    # Position after 30 seconds along a heading, at a speed in knots, on a sphere.
    "dead_reckoning": """WITH EV, m AS (SELECT event_id, radians(lat) AS y, radians(lon) AS x, radians(CAST(event_id % 360 AS DOUBLE)) AS h, value * 1.852e0 * 30 / 3600 / 6371 AS d FROM ev WHERE value >= 1),
n AS (SELECT event_id, x, h, d, y, asin(sin(y) * cos(d) + cos(y) * sin(d) * cos(h)) AS y2 FROM m)
SELECT event_id, round(degrees(y2), 6) AS lat, round(degrees(x + atan2(sin(h) * sin(d) * cos(y), cos(d) - sin(y) * sin(y2))), 6) AS lon FROM n""",
    # Wait before the next try of a stream and of a poll, by failures so far.
    "backoff_seconds": """SELECT o_custkey, CAST(count(*) AS BIGINT) AS failures, least(10 * power(2, least(count(*), 8)), 1800) * CAST(1 AS DOUBLE) AS stream_wait,
least(30 * power(2, least(count(*), 4)), 300) * CAST(1 AS DOUBLE) AS poll_wait, count(*) >= 10 AS stream_gives_up, count(*) >= 8 AS poll_gives_up FROM {orders} GROUP BY o_custkey""",
    # Hourly timeline of a cluster: running totals at the end of each hour and the highest severity so far.
    "hourly_timeline": """WITH EV, h AS (SELECT entity_id, CAST(floor(t / 3600) AS BIGINT) AS hour, count(*) AS n, max(severity_rank) AS sev FROM ev GROUP BY entity_id, CAST(floor(t / 3600) AS BIGINT))
SELECT entity_id, hour, CAST(sum(n) OVER w AS BIGINT) AS event_count, max(sev) OVER w AS severity_rank FROM h WINDOW w AS (PARTITION BY entity_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    # Mean and population deviation of hourly counts in a 168-row ring, from twelve rows on.
    "rolling_baseline_168": """WITH EV, h AS (SELECT source_type, CAST(floor(t / 3600) AS BIGINT) AS hour, CAST(count(*) AS DOUBLE) AS n FROM ev GROUP BY source_type, CAST(floor(t / 3600) AS BIGINT)),
b AS (SELECT source_type, hour, count(*) OVER w AS k, avg(n) OVER w AS m, stddev_pop(n) OVER w AS sd FROM h WINDOW w AS (PARTITION BY source_type ORDER BY hour ROWS BETWEEN 167 PRECEDING AND CURRENT ROW))
SELECT source_type, hour, round(m, 6) AS mean, round(sd, 5) AS sigma FROM b WHERE k >= 12""",
    # Token costs by role, and whether a cap is reached.
    "cost_rollup": """WITH c AS (SELECT role, sum(length(text)) AS n FROM {conversations} GROUP BY role)
SELECT role, CAST(n AS BIGINT) AS units, round(n / CAST(1000000 AS DOUBLE) * CASE WHEN role = 'assistant' THEN 4 ELSE 1 END, 9) AS usd, n > 100000 AS capped FROM c""",
    # Whole word, with ASCII boundaries.
    "contains_word": "SELECT item_id, regexp_replace(text, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)', '') <> text AS has_word FROM {benchmark}",
    # Longest prefix first: the region that a name's prefix stands for.
    "prefix_lookup": """WITH p AS (SELECT * FROM (VALUES ('Customer#00000000', 'low'), ('Customer#0000000', 'mid'), ('Customer#', 'any')) AS v(prefix, class)),
m AS (SELECT c_custkey, class, row_number() OVER (PARTITION BY c_custkey ORDER BY length(prefix) DESC) AS r FROM {customer} JOIN p ON substr(c_name, 1, length(prefix)) = prefix)
SELECT c_custkey, class FROM m WHERE r = 1""",
    # Overlap of two keys' sets of regions, as share of the smaller.
    "region_overlap": """WITH EV, s AS (SELECT DISTINCT source_type, region FROM ev WHERE region IS NOT NULL), n AS (SELECT source_type, count(*) AS k FROM s GROUP BY source_type),
c AS (SELECT a.source_type AS left_type, b.source_type AS right_type, count(*) AS common FROM s a JOIN s b ON a.region = b.region AND a.source_type < b.source_type GROUP BY a.source_type, b.source_type)
SELECT left_type, right_type, CAST(common AS BIGINT) AS common, round(common * CAST(1 AS DOUBLE) / least(x.k, y.k), 6) AS share FROM c JOIN n x ON x.source_type = left_type JOIN n y ON y.source_type = right_type""",
    # Even-odd ray casting against an outer ring and its hole, as one expression: no join.
    "point_in_polygon": f"WITH EV SELECT event_id, {in_polygon('lat', 'lon', ZONE)} AS inside FROM ev",
}

"""What upserts, retention and regeneration leave, as queries: one text for both engines."""

_C = """c AS (SELECT entity_id, CAST(count(*) AS BIGINT) AS n, max(t) AS last_t, min(t) AS first_t, max(severity_rank) AS sev,
count(DISTINCT source_type) AS kinds, min(CASE WHEN source_type = 'view' THEN 1 ELSE 0 END) AS telemetry FROM ev GROUP BY entity_id)"""

QUERIES = {
    # Last write of each entity; a null name doesn't replace a known one.
    "latest_position_upsert": """WITH EV SELECT entity_id, max_by(event_id, event_id) AS event_id, round(max_by(lat, event_id), 6) AS lat, round(max_by(lon, event_id), 6) AS lon,
max_by(region, event_id) FILTER (WHERE region IS NOT NULL) AS region FROM ev GROUP BY entity_id""",
    # Mentions add up, confidence only rises, the first known region stays, last_seen is overwritten.
    "entity_upsert": """WITH EV SELECT entity_id, CAST(count(*) AS BIGINT) AS mentions, round(max(confidence), 6) AS confidence,
min_by(region, event_id) FILTER (WHERE region IS NOT NULL) AS region, max(t) AS last_seen FROM ev GROUP BY entity_id""",
    # Counters a day, each batch added to what is there.
    "additive_counters": "WITH EV SELECT CAST(floor(t / 86400) AS BIGINT) AS day, CAST(count(*) AS BIGINT) AS calls, CAST(sum(severity_rank) AS BIGINT) AS units FROM ev GROUP BY CAST(floor(t / 86400) AS BIGINT)",
    # Entities seen in the last hour.
    "position_expiry": "WITH EV SELECT entity_id, max(t) AS last_seen FROM ev GROUP BY entity_id HAVING max(t) >= AS_OF - 3600",
    # 180 days of everything, 7 of tracking.
    "retention": "WITH EV SELECT event_id, source_type FROM ev WHERE t >= AS_OF - 15552000 AND (source_type <> 'view' OR t >= AS_OF - 604800)",
    "notify_high": "WITH EV SELECT event_id, source_type, region, severity FROM ev WHERE severity IN ('high', 'critical')",
    # Clusters without news for six hours, or an hour and a half if all telemetry and 20 events or more.
    "stale_clusters": f"WITH EV, {_C} SELECT entity_id, n FROM c WHERE last_t < AS_OF - CASE WHEN telemetry = 1 AND n >= 20 THEN 5400 ELSE 21600 END",
    # Is a narrative due: none yet, 30 new events, or two hours and 10 events; a summary from 10 events on.
    "regeneration_due": f"WITH EV, {_C} SELECT entity_id, n >= 30 OR (AS_OF - first_t >= 7200 AND n >= 10) AS narrative_due, n >= 10 AND AS_OF - last_t <= 21600 AS summary_due FROM c",
    # Events for each subscription: its channel, and its view where it has one.
    "subscriptions": """WITH EV, s AS (SELECT * FROM (VALUES (1, 'error', -90, 90), (2, 'purchase', 0, 45), (3, 'view', -45, 0)) AS v(client, channel, south, north))
SELECT client, event_id FROM ev JOIN s ON source_type = channel AND lat BETWEEN south AND north""",
}

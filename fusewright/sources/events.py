"""The canonical event relation over the driver's tables, as a common table expression in both dialects.

Times are seconds since the epoch, so that no session time zone enters a result.
"""

#: as_of of every query with a "now": 2024-01-29 00:00:00 UTC.
AS_OF = 1706486400

CANONICAL = """ev AS (
  SELECT event_id, ts, EPOCH(ts) AS t, event_type AS source_type, CAST(event_id AS STRING) AS source_id,
         CAST(user_id AS STRING) AS entity_id,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'r' || CAST(user_id % 5 AS STRING) END AS region,
         CASE WHEN event_type = 'error' THEN 'high' WHEN value >= 80 THEN 'medium' WHEN value >= 40 THEN 'low' ELSE 'info' END AS severity,
         CASE WHEN event_type = 'error' THEN 3 WHEN value >= 80 THEN 2 WHEN value >= 40 THEN 1 ELSE 0 END AS severity_rank,
         CASE WHEN value > 100 THEN CAST(1 AS DOUBLE) ELSE value / CAST(100 AS DOUBLE) END AS confidence,
         ((event_id * 37) % 1800) / CAST(10 AS DOUBLE) - 90 AS lat, ((event_id * 91) % 3600) / CAST(10 AS DOUBLE) - 180 AS lon, value
  FROM {events})"""

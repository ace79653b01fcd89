"""Windowed queries on ``events``, the batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from skydrift.streaming import windows
from skydrift.tables import table


def events_hopping(spark, sf_dir):
    """Events and their value per type in windows of six hours, every two hours."""
    out = windows.hopping(table(spark, sf_dir, "events"), "ts", "event_type", "value", "6 hours", "2 hours")
    return out.withColumn("total", F.round("total", 4) + 0.0)


def events_sessions(spark, sf_dir):
    """Sessions of each user's events, ended by six hours without one."""
    return windows.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours")


QUERIES = {f.__name__: f for f in (events_hopping, events_sessions)}
SQL = {
    "events_hopping": """WITH w AS (SELECT *, time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 2 HOUR * unnest([0, 1, 2]) AS start FROM events)
SELECT start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM w GROUP BY ALL""",
    "events_sessions": """WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, k""",
}

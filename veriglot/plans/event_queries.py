"""Windowed counts of events, run as a batch; streaming/ runs the same transformations as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.audit import event_counts, user_sessions
from .registry import query
from .text_queries import table


@query("event_windows", "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return event_counts(table(spark, sf_dir, "events")).select(F.unix_timestamp("start").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


@query("event_sessions", "WITH f AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL '30 minutes', TRUE)::INT AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT user_id, epoch_us(min(ts)) // 1000000 AS start_s, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, sf_dir):
    return user_sessions(table(spark, sf_dir, "events")).select("user_id", F.unix_timestamp("start").alias("start_s"), "n")

"""Streams over the events table, run over all that is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import incremental as inc

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _events(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*").withColumn("at", F.col("ts").cast("timestamp"))


def stream_sliding(spark, sf):
    return inc.to_shared(inc.sliding(_events(spark, sf), "at", "value", "7 days", "1 day", keys=["event_type"]), "complete").select("end", "event_type", "n", F.round("mean", 6).alias("mean"))


def stream_sessions(spark, sf):
    return inc.to_shared(inc.sessions(_events(spark, sf), "at", ["user_id"], "1 day"), "complete").select("user_id", "start", "n")


def stream_first_of_key(spark, sf):
    return inc.to_shared(inc.first_of_key(_events(spark, sf), "at", ["event_id"]).select("event_id", "event_type"), "append")


QUERIES |= {"stream_sliding": stream_sliding, "stream_sessions": stream_sessions, "stream_first_of_key": stream_first_of_key}
SQL["stream_first_of_key"] = "SELECT DISTINCT event_id, event_type FROM events"
SQL["stream_sliding"] = """
SELECT (date_trunc('day', ts) + to_days((k + 1)::INT)) AS "end", event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events, range(7) t(k) GROUP BY ALL"""
SQL["stream_sessions"] = """
WITH e AS (SELECT user_id, ts, coalesce((ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 DAY)::INT, 1) AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid"""

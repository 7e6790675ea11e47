"""Event-time queries, as batch plans of the streaming operators, and one true stream run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.tables import shared_dir, table
from ..streaming import events

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rows(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def naive(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def streaming_tumbling(spark, d):
    return events.tumbling(rows(spark, d), "1 hour").withColumn("start", naive("start"))


@query("SELECT strftime(time_bucket(INTERVAL '30 minutes', ts) - s * INTERVAL '30 minutes', '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events, range(0, 2) t(s) GROUP BY 1")
def streaming_sliding(spark, d):
    return events.sliding(rows(spark, d), "1 hour", "30 minutes").withColumn("start", naive("start"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL '30 minutes', '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def streaming_session(spark, d):
    return events.sessions(rows(spark, d), "30 minutes").withColumns({"start": naive("start"), "end": naive("end")})


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS day FROM events) GROUP BY 1, 2")
def streaming_dedupe(spark, d):
    return rows(spark, d).select("user_id", "event_type", F.date_trunc("day", "ts").alias("day")).dropDuplicates().groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def streaming_file_source(spark, d):
    """Reads the table as a file stream into a Parquet sink with a checkpoint, and reports on the sink."""
    there = table(spark, d, "events")
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    there.repartition(4).write.parquet(f"{root}/in")
    events.run_to_end(events.event_stream(spark, f"{root}/in", there.schema), f"{root}/out", f"{root}/offsets")
    return spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""
WITH p AS (SELECT event_id, event_type, sum(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)
SELECT event_id, event_type FROM p WHERE coalesce(before, 0) < 5000""")
def target_stop_per_key(spark, d):
    return events.until_target(table(spark, d, "events"), "event_type", "event_id", "value", 5000.0).select("event_id", "event_type")


@query("SELECT user_id, epoch(TIMESTAMP '2030-01-01') - epoch(max(ts)) > 600 AS stale FROM events GROUP BY 1")
def staleness(spark, d):
    return events.stale(table(spark, d, "events"), "user_id", F.lit("2030-01-01")).select("user_id", "stale")

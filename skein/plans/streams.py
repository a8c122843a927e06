"""Windowed queries: each runs as a stream to the end of its input.

Not part of what the reference has; windows over `events` show the streaming forms.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import windows as w
from . import surrogates as s

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _run(spark, sf_dir, plan, mode="complete"):
    events = w.stream_of(spark, f"{sf_dir}/events.parquet").where("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    out = w.drained(plan(events), f"{s.shared_dir(spark)}/stream-{uuid.uuid4().hex}", mode)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in out.dtypes if kind == "timestamp"})


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    """Events and values by hour and type."""
    return _run(spark, sf_dir, w.tumbling)


@query("SELECT time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL '15 minutes' AS start, count(*) AS n FROM events, range(4) t(k) WHERE ts IS NOT NULL GROUP BY ALL")
def stream_sliding(spark, sf_dir):
    """Events of each hour, every quarter of an hour."""
    return _run(spark, sf_dir, w.sliding)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM k GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    """Each user's sessions: events less than half an hour apart."""
    return _run(spark, sf_dir, w.sessions)


@query("SELECT time_bucket(INTERVAL '30 seconds', ts) AS start, user_id, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def fixed_chunks(spark, sf_dir):
    """Chunks of 30 seconds: how windows advance where nothing is decoded."""
    e = s.table(spark, sf_dir, "events").where("ts IS NOT NULL")
    return e.groupBy(F.window(F.col("ts"), "30 seconds").alias("c"), "user_id").agg(F.count("*").alias("n")).select(F.col("c.start").alias("start"), "user_id", "n")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS s, least(greatest(abs(value), 0.5), 30) AS step FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
w AS (SELECT user_id, 1::BIGINT AS n, min((s, event_id, step)) AS x FROM e GROUP BY user_id
  UNION ALL SELECT w.user_id, any_value(w.n) + 1, min((e.s, e.event_id, e.step)) FROM w JOIN e ON e.user_id = w.user_id AND e.s >= w.x[1] + w.x[3] GROUP BY w.user_id)
SELECT user_id, x[2] AS event_id, n AS "window", x[1] AS start FROM w""")
def stream_advancing(spark, sf_dir):
    """Windows whose starts depend on what the window before held, as a stream with state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    plan = lambda e: w.advancing(e.where("value IS NOT NULL").select("user_id", "event_id", F.col("ts").cast("double").alias("seconds"), "value"))
    return _run(spark, sf_dir, plan, "append")

"""Queries over the streaming operators: the events file read as a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.plans.catalog import query
from tempora.session import scratch_path
from tempora.streaming import events as Z


def stream(b) -> DataFrame:
    schema = b.table("events").schema
    rows = b.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(b.path)
    return rows.select(
        F.col("user_id").alias("session"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind")
    )


def finish(b, out: DataFrame, name: str) -> DataFrame:
    """Run a stream over all the data there is into Parquet, then read the result."""
    path = scratch_path(b.spark, name)
    running = out.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", scratch_path(b.spark, f"{name}-state")
    ).trigger(availableNow=True).start()
    running.awaitTermination()
    return b.spark.read.schema(out.schema).parquet(path)


# a window is out once the watermark, the latest event less one hour, has passed its end
@query("stream_bouts", """
WITH v AS (SELECT user_id AS session, epoch_us(ts) AS u FROM events WHERE event_type = 'view'), m AS (SELECT max(u) - 3600000000 AS mark FROM v),
g AS (SELECT *, CASE WHEN u - lag(u) OVER (PARTITION BY session ORDER BY u) < 21600000000 THEN 0 ELSE 1 END AS s FROM v),
i AS (SELECT *, sum(s) OVER (PARTITION BY session ORDER BY u) AS bout FROM g)
SELECT session, count(*) AS bout_size, min(u) AS bout_start, max(u) AS bout_end FROM i, m GROUP BY session, bout, mark HAVING max(u) + 21600000000 <= (mark // 1000) * 1000""")
def stream_bouts(b):
    out = Z.stream_bouts(stream(b).where("kind = 'view'"), ["session"], "ts", "6 hours", "1 hour")
    done = finish(b, out, "bouts")
    return done.withColumns({c: F.unix_micros(F.col(c)) for c in ("bout_start", "bout_end")})


@query("stream_rates", """
WITH v AS (SELECT user_id AS session, epoch_us(ts) AS u FROM events), m AS (SELECT max(u) - 3600000000 AS mark FROM v),
w AS (SELECT session, unnest([u // 43200000000 * 43200000000, u // 43200000000 * 43200000000 - 43200000000]) AS window_start FROM v)
SELECT session, window_start, count(*) AS n FROM w, m WHERE window_start + 86400000000 <= mark GROUP BY ALL""")
def stream_rates(b):
    out = Z.stream_rates(stream(b), ["session"], "ts", "1 day", "12 hours", "1 hour")
    return finish(b, out, "rates").withColumn("window_start", F.unix_micros("window_start"))


@query("stream_asof_trial", """
WITH m AS (SELECT (max(epoch_us(ts)) - 3600000000) // 1000 AS mark FROM events)
SELECT e.session, e.event_id, coalesce(c.trial, -1) AS trial FROM m, ev e ASOF LEFT JOIN cues c ON e.session = c.session AND e.t >= c.cue
WHERE e.event_id IN (SELECT event_id FROM events, m WHERE (epoch_us(ts) // 1000000 + 1) * 1000 <= mark)""")
def stream_asof_trial(b):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = b.spark.conf.get(key)
    b.spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = stream(b).withColumn("is_cue", F.col("kind") == "signup").select("session", "event_id", "is_cue", "ts")
        return finish(b, Z.stream_asof_trial(rows, "ts", "1 hour"), "asof")
    finally:
        b.spark.conf.set(key, before)

"""The supplied tables seen as recordings: who is a session, what is a cue, a lick, a spike.

Everything is a lazy projection of the events table. `SHARED_SQL` states the same bindings as
common table expressions, so that the SQL of a query does not depend on this code.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators.movements import movement_timing
from tempora.operators.ordered import Measured, numbered
from tempora.operators.segment import segment_movements
from tempora.operators.timejoin import asof_backward
from tempora.sizing import ROWS_PER_CHUNK, TASKS_PER_CHUNK, chunk_width

HOUR, DAY = 3600.0, 86400.0
S = ["session"]

_widths: dict[tuple, float | None] = {}


class Tables:
    """Bindings over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def width_of(self, name: str, df: DataFrame, keys: list[str], col: str) -> float | None:
        """Chunk width for ordered scans of one table, measured once per table."""
        key = (self.spark.sparkContext.applicationId, self.path, name, col)
        if key not in _widths:
            _widths[key] = chunk_width(df, keys, col)
        return _widths[key]

    def hash_chunks(self, name: str, df: DataFrame) -> int | None:
        """Number of even cuts of a hash order, none while all rows fit one task."""
        key = (self.spark.sparkContext.applicationId, self.path, name, "#")
        if key not in _widths:
            n = df.count()
            _widths[key] = None if n <= ROWS_PER_CHUNK else -(-n // ROWS_PER_CHUNK)
        return _widths[key]

    def tasks(self, name: str) -> int | None:
        """Number of tasks to deal the groups of a table to, so that none gets more rows as the table grows."""
        chunks = self.hash_chunks(name, self.table(name))
        return None if chunks is None else chunks * TASKS_PER_CHUNK

    @cached_property
    def width(self) -> float | None:
        """Chunk width in seconds for scans of events by session."""
        return self.width_of("events", self.ev, S, "t")

    @cached_property
    def ev(self) -> DataFrame:
        micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
        return self.table("events").select(
            F.col("user_id").alias("session"), "event_id", (micros / 1e6).alias("t"),
            F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        )

    def _of(self, kind: str) -> DataFrame:
        return self.ev.where(F.col("kind") == kind)

    @cached_property
    def cues(self) -> DataFrame:
        return numbered(
            self._of("signup").select("session", F.col("t").alias("cue"), "value", "k", "event_id"),
            S, ["cue", "event_id"], "trial", self.width,
        ).drop("event_id")

    @cached_property
    def trials(self) -> DataFrame:
        k = F.col("k")
        return self.cues.select(
            "session", "trial", "cue", (k % 3).cast("int").alias("animal_response"),
            ((k % 3 == 0) & (F.col("value") > 20)).alias("rewarded_left"),
            ((k % 3 == 1) & (F.col("value") > 20)).alias("rewarded_right"),
            (k * 60.0).alias("reward_delay"), F.lit(21600.0).alias("response_duration"),
            (F.col("cue") + (k % 5) * 3600.0).alias("reward_outcome_time"), "value", "k",
        )

    @cached_property
    def licks(self) -> DataFrame:
        return numbered(
            self._of("click").select("session", "t", "value", "k", "event_id"), S, ["t", "event_id"], "lick_index", self.width
        ).drop("event_id")

    @cached_property
    def spikes(self) -> DataFrame:
        return self._of("error").select("session", (F.col("event_id") % 2).alias("unit"), "t", "k")

    @cached_property
    def units(self) -> DataFrame:
        return self.spikes.select("session", "unit").distinct()

    @cached_property
    def rewards(self) -> DataFrame:
        k = F.col("k")
        return self._of("purchase").select(
            "session", "t", "value", "k",
            F.when(k % 3 == 0, "earned").when(k % 3 == 1, "manual").otherwise("auto").alias("reward_type"),
            F.when(k % 2 == 0, "L").otherwise("R").alias("side"),
        )

    @cached_property
    def views(self) -> DataFrame:
        k = F.col("k")
        rows = numbered(
            self._of("view").select("session", "t", "value", "k", "event_id"), S, ["t", "event_id"], "movement_id", self.width
        )
        return rows.select(
            "session", "movement_id", F.col("t").alias("start_time"), (F.col("t") + F.col("value") * 60).alias("end_time"),
            (F.col("value") * 60).alias("duration"), F.col("value").alias("peak_velocity"),
            (F.col("value") / 2).alias("mean_velocity"), (k * 3.6 - 180).alias("excursion_angle_deg"),
            k.cast("double").alias("total_distance"), (k % 4 == 0).alias("cue_response"),
            (F.col("t") + F.col("value") * 30).alias("lick_time"),
            F.when(k % 2 == 0, "left_lick_time").otherwise("right_lick_time").alias("event"), "k",
        )

    @cached_property
    def movs(self) -> DataFrame:
        return asof_backward(self.views, self.cues.select("session", "trial", "cue"), S, "start_time", "cue", {"trial": "trial"}, self.width)

    @cached_property
    def timed(self) -> DataFrame:
        return movement_timing(self.movs, self.cues.select("session", "trial", "cue"), S, self.width)

    @cached_property
    def frames(self) -> DataFrame:
        rows = numbered(self.ev, S, ["t", "event_id"], "frame", self.width)
        y = F.col("k").cast("double")
        xv, yv = F.col("value") - F.col("k"), F.col("k") - 50.0
        return rows.select(
            "session", "frame", "t", F.col("value").alias("x"), y.alias("y"), (y / 100).alias("confidence"), "kind",
            xv.alias("xv"), yv.alias("yv"), F.hypot(xv, yv).alias("v"),
        )

    @cached_property
    def masked(self) -> DataFrame:
        good = F.col("confidence") > 0.3
        return self.frames.withColumns({"x": F.when(good, F.col("x")), "y": F.when(good, F.col("y"))})

    @cached_property
    def kins(self) -> DataFrame:
        """Frames in movements; frames count in rows, so their chunk is the mean rate."""
        return segment_movements(
            self.masked, S, "frame", F.col("x").isNotNull(), 1, width=self.frame_width
        )

    @cached_property
    def frame_width(self) -> float | None:
        return None if self.width is None else float(ROWS_PER_CHUNK)

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def price_width(self) -> float | None:
        return self.width_of("lineitem", self.lineitem, ["l_suppkey"], "l_extendedprice")

    def measured(self, name: str) -> Measured | None:
        """Measured chunk edges for scans of tables with up to one row per row of `name`, none while those fit one task."""
        chunks = self.hash_chunks(name, self.table(name))
        return None if chunks is None else Measured(ROWS_PER_CHUNK, chunks * ROWS_PER_CHUNK)

    @cached_property
    def points(self) -> DataFrame:
        """Embeddings as coordinates, features and labels."""
        e = F.col("embedding")

        def dim(i: int):
            return F.round(F.get(e, F.lit(i)).cast("double"), 6)

        return self.table("embeddings").select(
            F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("label"),
            *[dim(i).alias(n) for i, n in enumerate(("x", "y", "z"))], *[dim(i).alias(f"f{i}") for i in range(3, 10)],
        )


SHARED_SQL = """
ev AS (
  SELECT user_id AS session, event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS t,
         event_type AS kind, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
  FROM events),
cues AS (
  SELECT session, row_number() OVER (PARTITION BY session ORDER BY t, event_id) - 1 AS trial, t AS cue, value, k
  FROM ev WHERE kind = 'signup'),
trials AS (
  SELECT session, trial, cue, CAST(k % 3 AS INTEGER) AS animal_response,
         (k % 3 = 0 AND value > 20) AS rewarded_left, (k % 3 = 1 AND value > 20) AS rewarded_right,
         k * 60.0::DOUBLE AS reward_delay, 21600.0::DOUBLE AS response_duration,
         cue + (k % 5) * 3600.0::DOUBLE AS reward_outcome_time, value, k
  FROM cues),
licks AS (
  SELECT session, row_number() OVER (PARTITION BY session ORDER BY t, event_id) - 1 AS lick_index, t, value, k
  FROM ev WHERE kind = 'click'),
spikes AS (SELECT session, event_id % 2 AS unit, t, k FROM ev WHERE kind = 'error'),
units AS (SELECT DISTINCT session, unit FROM spikes),
rewards AS (
  SELECT session, t, value, k, CASE k % 3 WHEN 0 THEN 'earned' WHEN 1 THEN 'manual' ELSE 'auto' END AS reward_type,
         CASE WHEN k % 2 = 0 THEN 'L' ELSE 'R' END AS side
  FROM ev WHERE kind = 'purchase'),
views AS (
  SELECT session, row_number() OVER (PARTITION BY session ORDER BY t, event_id) - 1 AS movement_id, t AS start_time,
         t + value * 60 AS end_time, value * 60 AS duration, value AS peak_velocity, value / 2 AS mean_velocity,
         k * 3.6::DOUBLE - 180 AS excursion_angle_deg, k::DOUBLE AS total_distance, k % 4 = 0 AS cue_response,
         t + value * 30 AS lick_time, CASE WHEN k % 2 = 0 THEN 'left_lick_time' ELSE 'right_lick_time' END AS event, k
  FROM ev WHERE kind = 'view'),
movs AS (
  SELECT v.*, c.trial FROM views v ASOF LEFT JOIN cues c ON v.session = c.session AND v.start_time >= c.cue),
cleared AS (
  SELECT m.* REPLACE (CASE WHEN EXISTS (
      SELECT 1 FROM cues c WHERE c.session = m.session AND c.cue > m.start_time AND c.cue < m.end_time)
    THEN NULL ELSE m.trial END AS trial) FROM movs m),
timed0 AS (
  SELECT m.*, c.cue, row_number() OVER (PARTITION BY m.session, m.trial ORDER BY m.start_time, m.movement_id) AS movement_number_in_trial
  FROM cleared m JOIN cues c ON c.session = m.session AND c.trial = m.trial),
timed1 AS (
  SELECT t.*, max(CASE WHEN cue_response THEN movement_number_in_trial END) OVER (PARTITION BY session, trial) AS cue_response_movement_number,
         min(CASE WHEN cue_response THEN movement_number_in_trial END) OVER (PARTITION BY session, trial) AS first_response_number
  FROM timed0 t),
timed AS (
  SELECT a.* EXCLUDE (first_response_number), b.lick_time - b.cue AS lick_latency,
         a.movement_number_in_trial < a.cue_response_movement_number AS movement_before_cue_response,
         CASE WHEN a.start_time >= a.cue THEN a.start_time - a.cue END AS movement_latency_from_go
  FROM timed1 a LEFT JOIN timed0 b ON a.session = b.session AND a.trial = b.trial AND b.movement_number_in_trial = a.first_response_number),
frames AS (
  SELECT session, row_number() OVER (PARTITION BY session ORDER BY t, event_id) - 1 AS frame, t, value AS x, k::DOUBLE AS y,
         k::DOUBLE / 100 AS confidence, kind, value - k AS xv, k - 50.0::DOUBLE AS yv,
         sqrt((value - k) * (value - k) + (k - 50.0::DOUBLE) * (k - 50.0::DOUBLE)) AS v
  FROM ev),
masked AS (
  SELECT * REPLACE (CASE WHEN confidence > 0.3::DOUBLE THEN x END AS x, CASE WHEN confidence > 0.3::DOUBLE THEN y END AS y) FROM frames),
valid0 AS (
  SELECT session, frame, frame - lag(frame) OVER (PARTITION BY session ORDER BY frame) AS jump FROM masked WHERE x IS NOT NULL),
valid AS (
  SELECT session, frame, sum(CASE WHEN jump IS NULL OR jump > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY frame) - 1 AS movement_id
  FROM valid0),
spans AS (SELECT session, movement_id::BIGINT AS movement_id, min(frame) AS f0, max(frame) AS f1 FROM valid GROUP BY ALL),
kins AS (
  SELECT m.*, s.movement_id FROM masked m JOIN spans s ON s.session = m.session AND m.frame BETWEEN s.f0 AND s.f1),
points AS (
  SELECT vec_id AS id, label::BIGINT AS label, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y,
         round(embedding[3]::DOUBLE, 6) AS z, round(embedding[4]::DOUBLE, 6) AS f3, round(embedding[5]::DOUBLE, 6) AS f4,
         round(embedding[6]::DOUBLE, 6) AS f5, round(embedding[7]::DOUBLE, 6) AS f6, round(embedding[8]::DOUBLE, 6) AS f7,
         round(embedding[9]::DOUBLE, 6) AS f8, round(embedding[10]::DOUBLE, 6) AS f9
  FROM embeddings)
"""

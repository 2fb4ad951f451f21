"""Queries over the time-join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.operators import timejoin as J
from tempora.operators.movements import lick_metadata
from tempora.operators.segment import annotate_licks
from tempora.plans.bindings import DAY, HOUR, S
from tempora.plans.catalog import query

TRIAL = ["session", "trial"]


@query("asof_backward", """
SELECT f.session, f.frame, c.trial FROM frames f ASOF LEFT JOIN cues c ON f.session = c.session AND f.t >= c.cue""")
def asof_backward(b):
    return J.asof_backward(b.frames, b.cues.select("session", "trial", "cue"), S, "t", "cue", {"trial": "trial"}, b.width).select(
        "session", "frame", "trial"
    )


@query("asof_backward_chunked", """
SELECT f.session, f.frame, c.trial FROM frames f ASOF LEFT JOIN cues c ON f.session = c.session AND f.t >= c.cue""")
def asof_backward_chunked(b):
    # the plan a hot session gets, forced with one-day chunks
    return J.asof_backward(b.frames, b.cues.select("session", "trial", "cue"), S, "t", "cue", {"trial": "trial"}, DAY).select(
        "session", "frame", "trial"
    )


@query("asof_forward", """
SELECT l.session, l.lick_index, c.trial AS next_trial, c.cue - l.t AS wait
FROM licks l ASOF LEFT JOIN cues c ON l.session = c.session AND l.t <= c.cue""", "wait")
def asof_forward(b):
    out = J.asof_forward(b.licks, b.cues.select("session", "trial", "cue"), S, "t", "cue", {"next_trial": "trial", "at": "cue"}, b.width)
    return out.select("session", "lick_index", "next_trial", (F.col("at") - F.col("t")).alias("wait"))


@query("event_trial_index", """
SELECT e.session, e.event_id, coalesce(c.trial, -1) AS trial
FROM ev e ASOF LEFT JOIN cues c ON e.session = c.session AND e.t >= c.cue""")
def event_trial_index(b):
    return J.event_trial_index(b.ev, b.cues.select("session", "trial", "cue"), S, "t", "cue", "trial", b.width).select(
        "session", "event_id", "trial"
    )


NEAREST = """
pairs AS (
  SELECT l.session, l.lick_index, f.frame, f.t, abs(f.t - l.t) AS dt
  FROM licks l JOIN kins f ON f.session = l.session AND f.kind <> 'click' AND abs(f.t - l.t) <= 3600),
best AS (
  SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY session, lick_index ORDER BY dt, t) = 1),
won AS (SELECT session, frame, max(lick_index) AS lick_index FROM best GROUP BY ALL),
licked AS (
  SELECT k.*, w.lick_index, w.lick_index IS NOT NULL AS lick
  FROM kins k LEFT JOIN won w ON w.session = k.session AND w.frame = k.frame WHERE k.kind <> 'click')
"""


def licked(b):
    """Movement frames with the licks that fall on them."""
    frames = b.kins.where(F.col("kind") != "click")
    return J.mark_licked_frames(frames, b.licks, S, "frame", "t", "lick_index", "t", HOUR, b.width)


@query("nearest_within_tolerance", f"WITH {NEAREST} SELECT session, frame, lick, lick_index FROM licked")
def nearest_within_tolerance(b):
    return licked(b).select("session", "frame", "lick", "lick_index")


FIRST_MOVEMENT = """
owner AS (
  SELECT session, lick_index, arg_min(movement_id, t) AS nearest_movement_id FROM licked WHERE lick_index IS NOT NULL GROUP BY ALL),
linked AS (
  SELECT l.session, l.lick_index, l.t, l.value, l.k, o.nearest_movement_id
  FROM licks l LEFT JOIN owner o ON o.session = l.session AND o.lick_index = l.lick_index)
"""


def linked_licks(b):
    return J.movement_of_lick(b.licks, licked(b), S, "lick_index", "t", "movement_id")


@query("lick_to_movement_nearest", f"WITH {NEAREST}, {FIRST_MOVEMENT} SELECT session, lick_index, nearest_movement_id FROM linked")
def lick_to_movement_nearest(b):
    return linked_licks(b).select("session", "lick_index", "nearest_movement_id")


@query("lick_to_movement_interval", """
SELECT l.session, l.lick_index, (SELECT min(v.movement_id) FROM views v
  WHERE v.session = l.session AND l.t BETWEEN v.start_time AND v.end_time) AS movement_id
FROM licks l""")
def lick_to_movement_interval(b):
    return J.containing_movement(
        b.licks, b.views, S, "lick_index", "t", "movement_id", "start_time", "end_time", bucket=2 * HOUR
    ).select("session", "lick_index", "movement_id")


@query("null_if_spans_event", "SELECT session, movement_id, trial FROM cleared")
def null_if_spans_event(b):
    return J.null_if_spans(b.movs, b.cues, S, "start_time", "end_time", "cue", "trial", b.width).select(
        "session", "movement_id", "trial"
    )


@query("events_to_trial_arrays", """
SELECT l.session, c.trial, count(*) AS n, min(l.t - c.cue) AS first_rel, max(l.t - c.cue) AS last_rel
FROM licks l JOIN (SELECT *, coalesce(lead(cue) OVER (PARTITION BY session ORDER BY cue), 1e18) - 300 AS upto FROM cues) c
  ON l.session = c.session AND l.t >= c.cue - 300 AND l.t < c.upto GROUP BY ALL""", "first_rel last_rel")
def events_to_trial_arrays(b):
    tagged = J.events_per_trial(b.licks, b.cues.select("session", "trial", "cue"), S, "t", "cue", "trial", 300.0, b.width)
    rel = F.col("t") - F.col("cue")
    return tagged.groupBy(*TRIAL).agg(F.count(F.lit(1)).alias("n"), F.min(rel).alias("first_rel"), F.max(rel).alias("last_rel"))


FIRSTS = """
bounds AS (SELECT *, coalesce(lead(cue) OVER (PARTITION BY session ORDER BY cue), 1e18) AS upto FROM trials),
choice AS (
  SELECT b.session, b.trial, min(l.t) AS choice_time FROM bounds b JOIN licks l
    ON l.session = b.session AND l.t >= b.cue - 0.005 AND l.t < b.upto - 0.005 GROUP BY ALL),
reward AS (
  SELECT b.session, b.trial, min(r.t) AS reward_time, arg_min(r.reward_type, r.t) AS reward_type FROM bounds b JOIN rewards r
    ON r.session = b.session AND r.t >= b.cue AND r.t < b.upto GROUP BY ALL),
typed AS (SELECT session, bool_or(reward_type = 'earned') AS typed FROM rewards GROUP BY ALL),
fact AS (
  SELECT b.*, c.choice_time, r.reward_time, r.reward_type, coalesce(y.typed, false) AS typed, b.rewarded_left OR b.rewarded_right AS earned_reward
  FROM bounds b LEFT JOIN choice c USING (session, trial) LEFT JOIN reward r USING (session, trial) LEFT JOIN typed y USING (session)),
firsts AS (
  SELECT session, trial, cue, reward_time, reward_type, earned_reward,
    CASE WHEN typed THEN coalesce(reward_type IN ('manual', 'auto'), false) ELSE NOT earned_reward AND reward_time IS NOT NULL END AS extra_reward,
    CASE WHEN coalesce(choice_time - cue > response_duration + 0.005 AND NOT earned_reward, false) THEN NULL ELSE choice_time END AS choice_time
  FROM fact)
"""


def firsts(b):
    return J.first_event_times(b.trials, b.licks, b.rewards.select("session", "t", "reward_type"), S, "t", 0.005, b.width)


@query("first_event_times", f"WITH {FIRSTS} SELECT session, trial, reward_time, reward_type, choice_time, earned_reward, extra_reward FROM firsts")
def first_event_times(b):
    return firsts(b).select("session", "trial", "reward_time", "reward_type", "choice_time", "earned_reward", "extra_reward")


INTERRUPTED = """
flags AS (
  SELECT b.session, b.trial, bool_or(r.t - b.cue < b.reward_outcome_time - b.cue + b.reward_delay
      OR (r.side = 'R' AND NOT b.rewarded_right) OR (r.side = 'L' AND NOT b.rewarded_left)) AS interruption
  FROM trials b JOIN rewards r ON r.session = b.session AND r.t > b.cue AND r.t <= b.reward_outcome_time + b.reward_delay + 0.1
  GROUP BY ALL),
flagged AS (
  SELECT b.session, b.trial, coalesce(f.interruption, false) AS interruption
  FROM trials b LEFT JOIN flags f USING (session, trial))
"""


def flagged(b):
    return J.interruption_flags(b.trials, b.rewards, S, "t", "side", bucket=2 * HOUR)


@query("interruption_flags", f"WITH {INTERRUPTED} SELECT * FROM flagged")
def interruption_flags(b):
    return flagged(b).select("session", "trial", "interruption")


ANNOTATED = """
la AS (
  SELECT l.session, l.lick_index, l.t, c.trial, c.cue, c.value > 20 AND c.k % 3 < 2 AS won,
         lag(l.t) OVER (PARTITION BY l.session ORDER BY l.t) AS before
  FROM licks l ASOF LEFT JOIN cues c ON l.session = c.session AND l.t >= c.cue),
lb AS (
  SELECT *, before IS NULL OR t - before > 21600 AS bout_start,
         coalesce(row_number() OVER (PARTITION BY session, trial ORDER BY t) = 1 AND t - cue <= 86400, false) AS cue_response
  FROM la),
annotated AS (
  SELECT session, lick_index, t, trial, bout_start, cue_response, cue_response AND coalesce(won, false) AS rewarded,
         CAST(sum(CASE WHEN bout_start THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY t) AS BIGINT) AS bout_number
  FROM lb)
"""


def annotated(b):
    cues = b.trials.select("session", "trial", "cue", (F.col("rewarded_left") | F.col("rewarded_right")).alias("rewarded"))
    return annotate_licks(b.licks, cues, S, "t", 6 * HOUR, DAY, b.width)


@query("annotate_licks", f"WITH {ANNOTATED} SELECT session, lick_index, trial, bout_start, bout_number, cue_response, rewarded FROM annotated")
def annotate_licks_query(b):
    return annotated(b).select("session", "lick_index", "trial", "bout_start", "bout_number", "cue_response", "rewarded")


@query("lick_metadata", f"""
WITH {NEAREST}, {ANNOTATED},
info AS (SELECT session, movement_id, min(lick_index) AS first_lick_index FROM licked GROUP BY ALL)
SELECT i.session, i.movement_id, i.first_lick_index, coalesce(a.cue_response, false) AS cue_response, coalesce(a.rewarded, false) AS rewarded,
       coalesce(a.bout_start, false) AS bout_start, a.t AS lick_time
FROM info i LEFT JOIN annotated a ON a.session = i.session AND a.lick_index = i.first_lick_index""")
def lick_metadata_query(b):
    info = licked(b).groupBy("session", "movement_id").agg(F.min("lick_index").alias("first_lick_index"))
    licks = annotated(b).withColumnRenamed("t", "lick_time")
    return lick_metadata(info, licks, S, ["cue_response", "rewarded", "bout_start", "lick_time"]).select(
        "session", "movement_id", "first_lick_index", "cue_response", "rewarded", "bout_start", "lick_time"
    )


@query("lookup_map", "SELECT m.session, m.movement_id, c.cue FROM movs m LEFT JOIN cues c USING (session, trial)")
def lookup_map(b):
    return b.movs.join(b.cues.select("session", "trial", "cue"), TRIAL, "left").select("session", "movement_id", "cue")


COUNTS = """
SELECT u.session, u.unit, c.trial,
  (SELECT count(*) FROM spikes s WHERE s.session = u.session AND s.unit = u.unit AND s.t >= c.cue AND s.t < c.cue + 86400) AS n_resp,
  (SELECT count(*) FROM spikes s WHERE s.session = u.session AND s.unit = u.unit AND s.t >= c.cue - 172800 AND s.t < c.cue) AS n_base,
  (SELECT min(s.t) FROM spikes s WHERE s.session = u.session AND s.unit = u.unit AND s.t >= c.cue AND s.t < c.cue + 86400) - c.cue AS first_resp
FROM units u JOIN cues c USING (session)"""


def windowed(b, width="auto"):
    grid = b.cues.select("session", "trial", "cue").join(b.units, "session")
    return J.window_stats(
        b.spikes, grid, ["session", "unit"], "t", "cue", {"resp": (0.0, DAY), "base": (-2 * DAY, 0.0)},
        b.width if width == "auto" else width,
    )


@query("window_count_join", f"SELECT session, unit, trial, n_resp, n_base FROM ({COUNTS})")
def window_count_join(b):
    return windowed(b).select("session", "unit", "trial", "n_resp", "n_base")


@query("window_count_join_chunked", f"SELECT session, unit, trial, n_resp, n_base FROM ({COUNTS})")
def window_count_join_chunked(b):
    return windowed(b, 2 * DAY).select("session", "unit", "trial", "n_resp", "n_base")


@query("first_in_window", f"SELECT session, unit, trial, first_resp, n_resp > 0 AS had_spike FROM ({COUNTS})", "first_resp")
def first_in_window(b):
    return windowed(b).select("session", "unit", "trial", "first_resp", (F.col("n_resp") > 0).alias("had_spike"))


@query("prev_next_event", """
SELECT l.session, l.lick_index, p.trial AS prev_trial, l.t - p.cue AS dt_prev, n.trial AS next_trial, n.cue - l.t AS dt_next
FROM licks l ASOF LEFT JOIN cues p ON l.session = p.session AND l.t >= p.cue
ASOF LEFT JOIN cues n ON l.session = n.session AND l.t < n.cue""", "dt_prev dt_next")
def prev_next_event(b):
    out = J.previous_and_next(
        b.licks, b.cues.select("session", "trial", "cue"), S, "t", "cue",
        {"prev_trial": "trial", "prev": "cue"}, {"next_trial": "trial", "next": "cue"}, b.width,
    )
    return out.select(
        "session", "lick_index", "prev_trial", (F.col("t") - F.col("prev")).alias("dt_prev"),
        "next_trial", (F.col("next") - F.col("t")).alias("dt_next"),
    )


@query("match_events_tolerance", """
SELECT l.session, l.t, CASE WHEN EXISTS (SELECT 1 FROM views v WHERE v.session = l.session AND abs(v.start_time - l.t) <= 7200)
  THEN 'TP' ELSE 'FN' END AS status FROM licks l
UNION ALL
SELECT v.session, v.start_time, 'FP' FROM views v
WHERE NOT EXISTS (SELECT 1 FROM licks l WHERE v.session = l.session AND abs(v.start_time - l.t) <= 7200)""")
def match_events_tolerance(b):
    return J.match_events(b.views.select("session", F.col("start_time").alias("t")), b.licks, S, "t", 2 * HOUR, b.width)


LATENTS = """
latents AS (
  SELECT session, list_transform(range(0, 6), lambda i: (session % 7) + i * 0.5) AS ql,
         list_transform(range(0, 6), lambda i: (session % 5) - i * 0.25) AS qr,
         list_transform(range(0, 5), lambda i: i * 0.1 + (session % 3)) AS rpe
  FROM (SELECT DISTINCT session FROM ev)),
ranked AS (
  SELECT session, trial, row_number() OVER (PARTITION BY session ORDER BY trial) AS pos FROM trials WHERE animal_response <> 2),
valued AS (
  SELECT r.session, r.trial, CASE WHEN pos <= 5 THEN ql[pos] END AS q_left, CASE WHEN pos <= 5 THEN qr[pos] END AS q_right, rpe[pos] AS rpe
  FROM ranked r JOIN latents USING (session)),
with_latents AS (
  SELECT t.session, t.trial, v.q_left::DOUBLE AS q_left, v.q_right::DOUBLE AS q_right, v.rpe::DOUBLE AS rpe
  FROM trials t LEFT JOIN valued v USING (session, trial))
"""


def latents(b):
    """Model latents per session with arrays of fixed length, q one longer than the trials."""
    s = F.col("session")

    def series(n, f):
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: f(i).cast("double"))

    return b.ev.select("session").distinct().select(
        "session",
        F.array(series(6, lambda i: s % 7 + i * 0.5), series(6, lambda i: s % 5 - i * 0.25)).alias("q_value"),
        series(5, lambda i: i * 0.1 + s % 3).alias("rpe"),
    )


def with_latents(b):
    q = F.col("q_value")

    def side(i):
        return F.slice(F.get(q, F.lit(i)), F.lit(1), F.size(F.get(q, F.lit(i))) - 1)

    return J.ordinal_join(
        b.trials, latents(b), S, "trial", F.col("animal_response") != 2,
        {"q_left": side(0), "q_right": side(1), "rpe": F.col("rpe")}, None,
    )


@query("ordinal_join", f"WITH {LATENTS} SELECT * FROM with_latents", "q_left q_right rpe")
def ordinal_join(b):
    return with_latents(b).select("session", "trial", "q_left", "q_right", "rpe")


@query("attach_latents_to_movements", f"""
WITH {LATENTS} SELECT m.session, m.movement_id, m.trial, w.q_left, w.q_right, w.rpe
FROM movs m LEFT JOIN with_latents w USING (session, trial)""", "q_left q_right rpe")
def attach_latents_to_movements(b):
    side = with_latents(b).select("session", "trial", "q_left", "q_right", "rpe")
    return b.movs.join(side, TRIAL, "left").select("session", "movement_id", "trial", "q_left", "q_right", "rpe")


@query("interval_cut", """
SELECT s.session, s.unit, count(*) AS n, min(s.t) AS first_t, max(s.t) AS last_t FROM spikes s
WHERE (s.session % 3 = 0 OR s.t >= 432000) AND (s.session % 4 = 0 OR s.t <= 1728000) GROUP BY ALL""")
def interval_cut(b):
    cuts = b.units.select(
        "session", "unit", F.when(F.col("session") % 3 != 0, 5 * DAY).alias("cut_start"),
        F.when(F.col("session") % 4 != 0, 20 * DAY).alias("cut_end"),
    )
    kept = J.interval_cut(b.spikes, cuts, ["session", "unit"], "t", "cut_start", "cut_end")
    return kept.groupBy("session", "unit").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("peri_event_slice", """
SELECT c.session, c.trial, e.kind, e.event_id, e.t - c.cue AS rel FROM cues c JOIN ev e
ON e.session = c.session AND e.t BETWEEN c.cue - 14400 AND c.cue + 14400 AND NOT (e.kind = 'signup' AND e.t = c.cue)""", "rel")
def peri_event_slice(b):
    pairs = J.peri_event(
        b.ev.select("session", "event_id", "t", "kind"), b.cues.select("session", "trial", "cue"), S, "t", "cue", -4 * HOUR, 4 * HOUR
    )
    own = (F.col("kind") == "signup") & (F.col("rel") == 0)
    return pairs.where(~own).select("session", "trial", "kind", "event_id", "rel")

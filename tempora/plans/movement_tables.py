"""Queries over segmentation, window and movement operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.operators import describe as D
from tempora.operators import movements as M
from tempora.operators import predicates as R
from tempora.operators import segment as G
from tempora.operators.timejoin import previous_and_next
from tempora.plans.bindings import DAY, HOUR, S
from tempora.plans.catalog import query
from tempora.plans.time_joins import (
    ANNOTATED, FIRST_MOVEMENT, FIRSTS, INTERRUPTED, NEAREST, annotated, flagged, licked, linked_licks,
)
from tempora.session import scratch_root

MOVE = ["session", "movement_id"]
TRIAL = ["session", "trial"]


@query("segment_movements", "SELECT session, frame, movement_id FROM kins")
def segment_movements(b):
    return b.kins.select("session", "frame", "movement_id")


@query("segment_movements_chunked", "SELECT session, frame, movement_id FROM kins")
def segment_movements_chunked(b):
    # the plan a hot session gets, forced with chunks of 16 frames
    return G.segment_movements(b.masked, S, "frame", F.col("x").isNotNull(), 1, width=16.0).select("session", "frame", "movement_id")


BOUTS = """
b0 AS (SELECT session, movement_id, start_time, lag(start_time) OVER (PARTITION BY session ORDER BY start_time, movement_id) AS before FROM views),
b1 AS (
  SELECT *, CAST(sum(CASE WHEN before IS NULL OR start_time - before > 21600 THEN 1 ELSE 0 END)
    OVER (PARTITION BY session ORDER BY start_time, movement_id) - 1 AS BIGINT) AS bout_id FROM b0),
bouts AS (
  SELECT session, movement_id, start_time, bout_id, row_number() OVER w AS bout_position, count(*) OVER (PARTITION BY session, bout_id) AS bout_size,
         row_number() OVER w = 1 AS bout_start, row_number() OVER w = count(*) OVER (PARTITION BY session, bout_id) AS bout_end
  FROM b1 WINDOW w AS (PARTITION BY session, bout_id ORDER BY start_time, movement_id)),
classed AS (
  SELECT b.session, b.movement_id, b.start_time, b.start_time - p.cue AS dt_prev, n.cue - b.start_time AS dt_next
  FROM bouts b ASOF LEFT JOIN cues p ON b.session = p.session AND b.start_time >= p.cue
  ASOF LEFT JOIN cues n ON b.session = n.session AND b.start_time < n.cue WHERE b.bout_start),
classes AS (
  SELECT *, CASE WHEN dt_prev >= 0 AND dt_prev <= 43200 THEN 'response' WHEN dt_prev > 43200 AND dt_next > 21600 THEN 'inter_trial' END AS class
  FROM classed)
"""


def bouts(b):
    return G.movement_bouts(b.views, S, "start_time", 6 * HOUR, ["movement_id"], b.width)


def classed_bouts(b):
    starts = bouts(b).where("bout_start").select("session", "movement_id", "start_time")
    near = previous_and_next(
        starts, b.cues.select("session", "cue"), S, "start_time", "cue", {"__p": "cue"}, {"__n": "cue"}, b.width
    )
    return near.select(
        "session", "movement_id", "start_time", (F.col("start_time") - F.col("__p")).alias("dt_prev"),
        (F.col("__n") - F.col("start_time")).alias("dt_next"),
    ).withColumn("class", G.classify_bouts(F.col("dt_prev"), F.col("dt_next"), 12 * HOUR, 12 * HOUR, 6 * HOUR))


@query("movement_bouts", f"WITH {BOUTS} SELECT * EXCLUDE (start_time) FROM bouts")
def movement_bouts(b):
    return bouts(b).select("session", "movement_id", "bout_id", "bout_position", "bout_size", "bout_start", "bout_end")


@query("classify_bouts", f"WITH {BOUTS} SELECT session, movement_id, dt_prev, dt_next, class FROM classes", "dt_prev dt_next")
def classify_bouts(b):
    return classed_bouts(b).select("session", "movement_id", "dt_prev", "dt_next", "class")


TIMED = "movement_number_in_trial cue_response_movement_number movement_before_cue_response movement_latency_from_go lick_latency".split()


@query("movement_timing", f"""
SELECT m.session, m.movement_id, m.trial, {', '.join('t.' + c for c in TIMED)}
FROM cleared m LEFT JOIN timed t ON t.session = m.session AND t.movement_id = m.movement_id""", "movement_latency_from_go lick_latency")
def movement_timing(b):
    return b.timed.select("session", "movement_id", "trial", *TIMED)


@query("shift_next", """
SELECT session, trial, coalesce(lead(cue) OVER (PARTITION BY session ORDER BY trial), reward_outcome_time) AS stop_time FROM trials""")
def shift_next(b):
    from tempora.sources.readers import trial_stop_times

    rows = b.trials.withColumn("stop_time", F.col("reward_outcome_time"))
    # trial numbers run as slowly as rows: the frame chunk fits them
    return trial_stop_times(rows, S, "trial", "cue", "stop_time", b.frame_width).select("session", "trial", "stop_time")


SVS = """
made AS (
  SELECT session, trial, animal_response, lag(animal_response) OVER (PARTITION BY session ORDER BY trial) AS before
  FROM trials WHERE animal_response <> 2),
svs AS (
  SELECT t.session, t.trial, t.value, CASE WHEN t.animal_response <> 2 THEN coalesce((m.animal_response <> m.before)::INTEGER, 0) END AS svs
  FROM trials t LEFT JOIN made m USING (session, trial))
"""


def switch_stay_table(b):
    return G.switch_stay(b.trials, S, "trial", "animal_response", 2, b.frame_width)


@query("switch_stay", f"WITH {SVS} SELECT session, trial, svs FROM svs")
def switch_stay(b):
    return switch_stay_table(b).select("session", "trial", "svs")


@query("policy_update", f"""
WITH {SVS} SELECT session, trial, 1 - lead(svs) OVER (PARTITION BY session ORDER BY trial) - value / 600 AS policy_update FROM svs""", "policy_update")
def policy_update(b):
    from tempora.operators.ordered import lagged

    near = lagged(switch_stay_table(b), S, ["trial"], following={"__n": F.col("svs")}, width=b.frame_width)
    return near.select("session", "trial", (1 - F.col("__n") - F.col("value") / 600).alias("policy_update"))


LICK_K = """
lick_k AS (
  SELECT l.session, c.trial, l.lick_index, l.t - c.cue AS latency, l.t, row_number() OVER (PARTITION BY l.session, c.trial ORDER BY l.t) AS k
  FROM licks l ASOF JOIN cues c ON l.session = c.session AND l.t >= c.cue)
"""


def licks_by_ordinal(b):
    """Licks numbered within their trial, from 1, with latency from the cue."""
    from tempora.operators.ordered import numbered
    from tempora.operators.timejoin import asof_backward

    linked = asof_backward(b.licks.drop("k"), b.cues.select("session", "trial", "cue"), S, "t", "cue", {"trial": "trial", "cue": "cue"}, b.width)
    inside = linked.where(F.col("trial").isNotNull()).withColumn("latency", F.col("t") - F.col("cue"))
    return numbered(inside, TRIAL, ["t"], "k", b.width, start=1).select("session", "trial", "lick_index", "latency", "t", "k")


@query("inter_event_interval", f"""
WITH {LICK_K}, d AS (SELECT *, latency - lag(latency) OVER (PARTITION BY session, trial ORDER BY t) AS gap FROM lick_k)
SELECT session, trial, k, gap AS interval_s, latency - (k - 1) * (SELECT quantile_cont(gap, 0.5) FROM d) AS aligned FROM d""", "interval_s aligned")
def inter_event_interval(b):
    out = G.aligned_intervals(licks_by_ordinal(b), TRIAL, "latency", "k", b.width)
    return out.select("session", "trial", "k", F.col("interval").alias("interval_s"), "aligned")


@query("longest_clean_run", f"""
WITH {INTERRUPTED},
g AS (SELECT *, trial - row_number() OVER (PARTITION BY session ORDER BY trial) AS island FROM flagged WHERE NOT interruption),
runs AS (SELECT session, island, min(trial) AS run_start, max(trial) AS run_end, count(*) AS run_length FROM g GROUP BY ALL)
SELECT session, run_start, run_end, run_length FROM runs
QUALIFY row_number() OVER (PARTITION BY session ORDER BY run_length DESC, run_start) = 1""")
def longest_clean_run(b):
    return G.longest_clean_run(flagged(b), S, "trial", "interruption", b.frame_width).select(
        "session", "run_start", "run_end", "run_length"
    )


@query("trim_to_clean_run", f"""
WITH {INTERRUPTED},
g AS (SELECT *, trial - row_number() OVER (PARTITION BY session ORDER BY trial) AS island FROM flagged WHERE NOT interruption),
runs AS (SELECT session, island, min(trial) AS run_start, max(trial) AS run_end, count(*) AS run_length FROM g GROUP BY ALL),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY session ORDER BY run_length DESC, run_start) = 1)
SELECT f.session, f.trial FROM flagged f LEFT JOIN best b USING (session) WHERE b.session IS NULL OR f.trial BETWEEN b.run_start AND b.run_end""")
def trim_to_clean_run(b):
    rows = flagged(b)
    return G.trim_to_run(rows, G.longest_clean_run(rows, S, "trial", "interruption", b.frame_width), S, "trial").select("session", "trial")


@query("time_in_group", "SELECT session, movement_id, frame, t - min(t) OVER (PARTITION BY session, movement_id) AS time_in_movement FROM kins", "time_in_movement")
def time_in_group(b):
    return G.time_in_group(b.kins, MOVE, "t").select("session", "movement_id", "frame", "time_in_movement")


@query("group_demean", """
SELECT session, frame, x - avg(x) OVER (PARTITION BY session) AS x, y - avg(y) OVER (PARTITION BY session) AS y FROM masked""", "x y")
def group_demean(b):
    return R.demean(b.masked, S, ["x", "y"]).select("session", "frame", "x", "y")


@query("zscore_in_group", """
SELECT session, event_id, (ln(value + 1) - avg(ln(value + 1)) OVER w) / nullif(stddev_pop(ln(value + 1)) OVER w, 0) AS z
FROM ev WINDOW w AS (PARTITION BY session)""", "z")
def zscore_in_group(b):
    return R.zscore_in_group(b.ev, S, F.ln(F.col("value") + 1), "z").select("session", "event_id", "z")


@query("nth_in_group", f"WITH {LICK_K} SELECT session, trial, latency FROM lick_k WHERE k = 2", "latency")
def nth_in_group(b):
    return G.nth_in_group(licks_by_ordinal(b).drop("k"), TRIAL, ["t"], 2, b.width).select("session", "trial", "latency")


@query("ecdf", """
SELECT session, event_id, row_number() OVER (PARTITION BY session ORDER BY value, event_id) / count(*) OVER (PARTITION BY session)::DOUBLE AS ecdf FROM ev""", "ecdf")
def ecdf(b):
    return G.ecdf(b.ev, S, "value", ["event_id"], b.width_of("values", b.ev, S, "value")).select("session", "event_id", "ecdf")


@query("raster_order", f"""
WITH {FIRSTS} SELECT session, trial, row_number() OVER (PARTITION BY session ORDER BY coalesce(choice_time - cue, reward_time - cue) NULLS LAST, trial) - 1 AS row_index FROM firsts""")
def raster_order(b):
    from tempora.plans.time_joins import firsts

    return G.raster_order(
        firsts(b), S, "trial", F.col("choice_time") - F.col("cue"), F.col("reward_time") - F.col("cue"), b.width
    ).select("session", "trial", "row_index")


@query("refractory_filter", """
WITH RECURSIVE c AS (SELECT session, t, row_number() OVER (PARTITION BY session ORDER BY t) AS n FROM licks),
walk AS (
  SELECT session, n, t, t AS kept, true AS keep FROM c WHERE n = 1
  UNION ALL
  SELECT c.session, c.n, c.t, CASE WHEN c.t > w.kept + 86400 THEN c.t ELSE w.kept END, c.t > w.kept + 86400
  FROM walk w JOIN c ON c.session = w.session AND c.n = w.n + 1)
SELECT session, t FROM walk WHERE keep""")
def refractory_filter(b):
    return G.refractory_filter(b.licks, S, "t", DAY, width=b.width)


CROSSED = """
inside AS (SELECT session, frame, t, coalesce(sqrt((x - 20) * (x - 20) + (y - 60) * (y - 60)) <= 25, false) AS now FROM masked),
crossed AS (
  SELECT session, frame, t FROM (SELECT *, lag(now) OVER (PARTITION BY session ORDER BY frame) AS was FROM inside) q WHERE now AND NOT coalesce(was, false))
"""


@query("threshold_crossing", f"WITH {CROSSED} SELECT session, frame FROM crossed")
def threshold_crossing(b):
    distance = F.hypot(F.col("x") - 20, F.col("y") - 60)
    return G.threshold_crossings(b.masked, S, "frame", distance, 25.0, b.frame_width).select("session", "frame")


REGRID = """
nxt AS (SELECT session, t, x, y, lead(t) OVER (PARTITION BY session ORDER BY t) AS nt FROM masked),
pts AS (SELECT *, floor((nt - t) / 21600)::BIGINT AS n FROM nxt),
extra AS (SELECT session, t, nt, n, unnest(range(1, n - 1)) AS i FROM pts WHERE n >= 3),
grid AS (
  SELECT session, t, x, y FROM masked
  UNION ALL SELECT session, t + i * (nt - t) / (n - 1), NULL, NULL FROM extra),
near AS (
  SELECT session, t, x, y,
    last_value(CASE WHEN x IS NOT NULL THEN struct_pack(t := t, x := x, y := y) END IGNORE NULLS) OVER (PARTITION BY session ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
    first_value(CASE WHEN x IS NOT NULL THEN struct_pack(t := t, x := x, y := y) END IGNORE NULLS) OVER (PARTITION BY session ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q
  FROM grid),
regridded AS (
  SELECT session, t, coalesce(x, p.x + (q.x - p.x) / nullif(q.t - p.t, 0) * (t - p.t), p.x, q.x) AS x,
         coalesce(y, p.y + (q.y - p.y) / nullif(q.t - p.t, 0) * (t - p.t), p.y, q.y) AS y FROM near)
"""


def regridded(b):
    return G.regrid(b.masked, S, "t", ["x", "y"], 1 / (6 * HOUR), b.width)


@query("regrid_interpolate", f"WITH {REGRID} SELECT session, t / 21600 AS t6h, x, y FROM regridded", "t6h x y")
def regrid_interpolate(b):
    return regridded(b).select("session", (F.col("t") / (6 * HOUR)).alias("t6h"), "x", "y")


VELOCITY = """
vel AS (
  SELECT session, t, x, y,
    (coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x)) / nullif(coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t), 0) AS xv,
    (coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y)) / nullif(coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t), 0) AS yv
  FROM regridded WINDOW w AS (PARTITION BY session ORDER BY t))
"""


@query("gradient_velocity", f"""
WITH {REGRID}, {VELOCITY} SELECT session, t / 21600 AS t6h, xv * 3600 AS xv_h, yv * 3600 AS yv_h, sqrt(xv * xv + yv * yv) * 3600 AS v_h FROM vel""", "t6h xv_h yv_h v_h")
def gradient_velocity(b):
    out = G.gradient_velocity(regridded(b), S, "t", "x", "y", b.width)
    return out.select("session", (F.col("t") / (6 * HOUR)).alias("t6h"), *[(F.col(c) * HOUR).alias(f"{c}_h") for c in ("xv", "yv", "v")])


WEIGHTS = G.gaussian_weights(1.5, 3)
_terms = [
    (f"lag(x, {3 - i}) OVER w" if i < 3 else "x" if i == 3 else f"lead(x, {i - 3}) OVER w", w) for i, w in enumerate(WEIGHTS)
]
SMOOTHED = f"""
smoothed AS (
  SELECT session, frame,
    ({' + '.join(f'coalesce({e} * {w!r}::DOUBLE, 0)' for e, w in _terms)})
    / ({' + '.join(f'CASE WHEN {e} IS NOT NULL THEN {w!r}::DOUBLE ELSE 0 END' for e, w in _terms)}) AS x_smooth
  FROM frames WINDOW w AS (PARTITION BY session ORDER BY frame))
"""


@query("smooth_fir", f"WITH {SMOOTHED} SELECT * FROM smoothed", "x_smooth")
def smooth_fir(b):
    return G.smooth_fir(b.frames, S, "frame", "x", WEIGHTS, "x_smooth", b.frame_width).select("session", "frame", "x_smooth")


@query("smooth_fir_chunked", f"WITH {SMOOTHED} SELECT * FROM smoothed", "x_smooth")
def smooth_fir_chunked(b):
    return G.smooth_fir(b.frames, S, "frame", "x", WEIGHTS, "x_smooth", 16.0).select("session", "frame", "x_smooth")


@query("monotonic_check", """
WITH m AS (
  SELECT session, trial, start_time, lag(trial) OVER w AS pt, lag(start_time) OVER w AS ps FROM movs WHERE trial IS NOT NULL
  WINDOW w AS (PARTITION BY session ORDER BY movement_id))
SELECT session, bool_and(pt IS NULL OR pt <= trial) AS trials_ascending,
       bool_and(pt IS NULL OR pt <> trial OR ps <= start_time) AS starts_ascending FROM m GROUP BY ALL""")
def monotonic_check(b):
    return G.monotonic_check(b.movs, S, ["movement_id"], "trial", "start_time", b.frame_width)


METRICS = "start_time end_time duration min_x max_x min_y max_y min_xv max_xv min_yv max_yv peak_velocity mean_velocity n_datapoints dropped_frames_n dropped_frames_pct".split()


@query("movement_metrics", """
SELECT session, movement_id, min(t) AS start_time, max(t) AS end_time, max(t) - min(t) AS duration, min(x) AS min_x, max(x) AS max_x,
  min(y) AS min_y, max(y) AS max_y, min(xv) AS min_xv, max(xv) AS max_xv, min(yv) AS min_yv, max(yv) AS max_yv, max(v) AS peak_velocity,
  avg(v) AS mean_velocity, count(*) AS n_datapoints, count(*) FILTER (WHERE x IS NULL) AS dropped_frames_n,
  100.0::DOUBLE * count(*) FILTER (WHERE x IS NULL) / count(*) AS dropped_frames_pct
FROM kins GROUP BY ALL""", "duration peak_velocity mean_velocity min_xv max_xv dropped_frames_pct")
def movement_metrics(b):
    return M.movement_metrics(b.kins, MOVE, "t").select(*MOVE, *METRICS)


LENGTHS = """
steps AS (
  SELECT session, movement_id, x, y, t, lag(x) OVER w AS px, lag(y) OVER w AS py FROM kins WHERE x IS NOT NULL
  WINDOW w AS (PARTITION BY session, movement_id ORDER BY t)),
lengths AS (
  SELECT session, movement_id, CASE WHEN count(*) >= 2 THEN sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))) END AS total_distance
  FROM steps GROUP BY ALL)
"""


@query("path_length", f"WITH {LENGTHS} SELECT * FROM lengths", "total_distance")
def path_length(b):
    return M.path_length(b.kins, MOVE, "t", width=b.width)


JAW = """
jaw AS (SELECT session, avg(value) AS jx, avg(k) AS jy FROM ev WHERE kind = 'purchase' GROUP BY ALL),
far AS (
  SELECT k.session, k.movement_id, k.t, k.x, k.y, k.v, k.x - j.jx AS dx, k.y - j.jy AS dy,
         sqrt((k.x - j.jx) * (k.x - j.jx) + (k.y - j.jy) * (k.y - j.jy)) AS d
  FROM kins k JOIN jaw j USING (session) WHERE k.x IS NOT NULL),
ends AS (
  SELECT session, movement_id, min(t) AS t0, arg_min(x, t) AS startpoint_x, arg_min(y, t) AS startpoint_y,
    first(x ORDER BY d DESC, t) AS endpoint_x, first(y ORDER BY d DESC, t) AS endpoint_y, max(d) AS max_distance,
    degrees(atan2(first(dy ORDER BY d DESC, t), first(dx ORDER BY d DESC, t))) AS excursion_angle_deg,
    first(x ORDER BY abs(dx) DESC, t) AS max_x_from_jaw, max(abs(dx)) AS max_x_distance,
    first(y ORDER BY abs(dy) DESC, t) AS max_y_from_jaw, max(abs(dy)) AS max_y_distance,
    first(t ORDER BY d DESC, t) AS t1
  FROM far GROUP BY ALL)
"""


def jaw(b):
    return b._of("purchase").select("session", F.col("value").alias("x"), F.col("k").cast("double").alias("y"))


@query("excursion", f"""
WITH {JAW} SELECT * EXCLUDE (t0, t1), t1 - t0 AS time_to_endpoint FROM ends""",
       "max_distance excursion_angle_deg max_x_distance max_y_distance time_to_endpoint")
def excursion(b):
    return M.excursion(b.kins, jaw(b), S, "movement_id", "t")


@query("movement_lick_info", f"""
WITH {NEAREST} SELECT session, movement_id, bool_or(lick) AS has_lick, min(lick_index) AS first_lick_index,
  count(DISTINCT lick_index) AS lick_count FROM licked GROUP BY ALL""")
def movement_lick_info(b):
    return M.movement_lick_info(licked(b), MOVE)


@query("first_trial", """
WITH f AS (SELECT k.session, k.movement_id, k.t, c.trial FROM kins k ASOF LEFT JOIN cues c ON k.session = c.session AND k.t >= c.cue)
SELECT session, movement_id, first(trial ORDER BY t) FILTER (WHERE trial IS NOT NULL) AS trial FROM f GROUP BY ALL""")
def first_trial(b):
    from tempora.operators.timejoin import asof_backward

    linked = asof_backward(b.kins, b.cues.select("session", "trial", "cue"), S, "t", "cue", {"trial": "trial"}, b.width)
    return M.first_trial(linked, MOVE, "t")


OUTBOUND = f"""
{JAW},
outs AS (SELECT f.* FROM far f JOIN ends e USING (session, movement_id) WHERE f.t <= e.t1),
osteps AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM outs WINDOW w AS (PARTITION BY session, movement_id ORDER BY t)),
ostats AS (
  SELECT session, movement_id, max(t) - min(t) AS out_duration, max(v) AS out_peak_velocity, avg(v) AS out_mean_velocity,
    CASE WHEN count(*) >= 2 THEN sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))) END AS out_distance FROM osteps GROUP BY ALL),
outbound AS (
  SELECT m.session, m.movement_id, o.out_duration, o.out_peak_velocity, o.out_mean_velocity, o.out_distance
  FROM (SELECT DISTINCT session, movement_id FROM kins) m LEFT JOIN ostats o USING (session, movement_id))
"""


def outbound(b):
    return M.outbound_metrics(b.kins, jaw(b), S, "movement_id", "t", b.width)


@query("outbound_metrics", f"WITH {OUTBOUND} SELECT * FROM outbound", "out_duration out_peak_velocity out_mean_velocity out_distance")
def outbound_metrics(b):
    return outbound(b)


TRIAL_LEVEL = f"""
{NEAREST}, {FIRST_MOVEMENT},
lt AS (SELECT l.*, c.trial, c.cue FROM linked l ASOF JOIN cues c ON l.session = c.session AND l.t >= c.cue),
tl AS (
  SELECT session, trial, count(*) AS lick_count, 100.0::DOUBLE * count(nearest_movement_id) / count(*) AS coverage_pct,
         count(*) FILTER (WHERE t >= cue AND t < cue + 86400) AS early_licks FROM lt GROUP BY ALL),
trial_table AS (
  SELECT c.session, c.trial, coalesce(lick_count, 0) AS lick_count, coalesce(coverage_pct, 0) AS coverage_pct, coalesce(early_licks, 0) AS early_licks
  FROM cues c LEFT JOIN tl USING (session, trial))
"""


def trial_table(b):
    from tempora.operators.timejoin import asof_backward

    cues = b.cues.select("session", "trial", "cue")
    licks = asof_backward(linked_licks(b), cues, S, "t", "cue", {"trial": "trial"}, b.width)
    return M.trial_level(cues, licks, S, DAY)


@query("trial_level", f"WITH {TRIAL_LEVEL} SELECT * FROM trial_table", "coverage_pct")
def trial_level(b):
    return trial_table(b).drop("cue")


@query("session_coverage", f"""
WITH {TRIAL_LEVEL} SELECT session, CAST(sum(lick_count) AS BIGINT) AS total_licks,
  CAST(round(sum(coverage_pct * lick_count) / 100) AS BIGINT) AS licks_with_movement,
  sum(coverage_pct * lick_count) / nullif(sum(lick_count), 0) AS coverage_pct FROM trial_table GROUP BY ALL""", "coverage_pct")
def session_coverage(b):
    return M.session_coverage(trial_table(b), S)


@query("segmentation_sweep", """
WITH s AS (SELECT unnest(range(1, 26)) AS max_dropped),
v0 AS (SELECT s.max_dropped, m.session, m.frame, m.t, m.frame - lag(m.frame) OVER (PARTITION BY s.max_dropped, m.session ORDER BY m.frame) AS jump
  FROM masked m, s WHERE m.x IS NOT NULL),
v1 AS (SELECT *, sum(CASE WHEN jump IS NULL OR jump > max_dropped + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY max_dropped, session ORDER BY frame) - 1 AS movement_id FROM v0),
mv AS (SELECT max_dropped, session, movement_id, min(frame) AS f0, max(frame) AS f1, min(t) AS t0, max(t) AS t1 FROM v1 GROUP BY ALL),
lk AS (SELECT v.max_dropped, v.session, v.movement_id, count(*) AS lick_count FROM mv v JOIN frames f
  ON f.session = v.session AND f.frame BETWEEN v.f0 AND v.f1 AND f.kind = 'click' GROUP BY ALL),
j AS (SELECT mv.*, coalesce(lick_count, 0) AS lick_count FROM mv LEFT JOIN lk USING (max_dropped, session, movement_id))
SELECT max_dropped, count(*) AS total_movements, (SELECT count(*) FROM licks) - CAST(sum(lick_count) AS BIGINT) AS licks_without_movement,
  count(*) FILTER (WHERE lick_count > 1) AS movements_mult_licks, count(*) FILTER (WHERE lick_count = 0) AS movements_without_licks,
  avg(t1 - t0) AS avg_movement_duration, quantile_cont(t1 - t0, 0.5) AS med_movement_duration, count(*) FILTER (WHERE t1 - t0 < 3600) AS tiny_movements
FROM j GROUP BY ALL""", "avg_movement_duration med_movement_duration", digits=4)
def segmentation_sweep(b):
    from tempora.operators.ordered import quantiles

    scratch_root(b.spark)
    moves = G.swept_movements(b.masked, S, "frame", "t", F.col("x").isNotNull(), range(1, 26), F.col("kind") == "click", b.frame_width)
    moves = moves.withColumnRenamed("n", "lick_count").checkpoint()
    n_licks = b.licks.agg(F.count(F.lit(1))).scalar()
    stats = moves.groupBy("max_dropped").agg(
        F.count(F.lit(1)).alias("total_movements"), F.sum("lick_count").alias("__l"),
        F.count_if(F.col("lick_count") > 1).alias("movements_mult_licks"),
        F.count_if(F.col("lick_count") == 0).alias("movements_without_licks"),
        F.avg("duration").alias("avg_movement_duration"), F.count_if(F.col("duration") < HOUR).alias("tiny_movements"),
    ).withColumn("licks_without_movement", n_licks - F.col("__l")).drop("__l")
    median = quantiles(moves, ["max_dropped"], "duration", {"med_movement_duration": 0.5}, b.width)
    return stats.join(median, "max_dropped")


@query("session_stats", """
SELECT session, count(*) AS total_trials, count(*) FILTER (WHERE animal_response <> 2) AS finished_trials,
  count(*) FILTER (WHERE rewarded_left) + count(*) FILTER (WHERE rewarded_right) AS reward_trials,
  count(*) FILTER (WHERE animal_response = 2) AS ignored_trials,
  count(*) FILTER (WHERE animal_response <> 2) / count(*)::DOUBLE AS finished_rate, count(*) FILTER (WHERE animal_response = 2) / count(*)::DOUBLE AS ignore_rate,
  (count(*) FILTER (WHERE rewarded_left) + count(*) FILTER (WHERE rewarded_right)) / nullif(count(*) FILTER (WHERE animal_response <> 2), 0)::DOUBLE AS reward_rate
FROM trials GROUP BY ALL""", "finished_rate ignore_rate reward_rate")
def session_stats(b):
    return M.session_stats(b.trials, S)


@query("session_modes", """
WITH t AS (SELECT session, 'v' || (k % 3) AS version, CASE WHEN k % 2 = 0 THEN 'none' ELSE 'stage' || (k % 5) END AS stage FROM trials),
cn AS (SELECT session, version, count(*) AS n FROM t GROUP BY ALL), dn AS (SELECT session, stage, count(*) AS n FROM t GROUP BY ALL),
c AS (SELECT * FROM cn QUALIFY row_number() OVER (PARTITION BY session ORDER BY n DESC, version) = 1),
d AS (SELECT * FROM dn QUALIFY row_number() OVER (PARTITION BY session ORDER BY n DESC, stage) = 1)
SELECT session, version, nullif(stage, 'none') AS stage,
  (SELECT count(DISTINCT (version, stage)) FROM t WHERE t.session = c.session) = 1 AS consistent_within_session
FROM c JOIN d USING (session)""")
def session_modes(b):
    k = F.col("k")
    rows = b.trials.select(
        "session", F.concat(F.lit("v"), k % 3).alias("version"),
        F.when(k % 2 == 0, "none").otherwise(F.concat(F.lit("stage"), k % 5)).alias("stage"),
    )
    return M.session_modes(rows, S, ["version", "stage"])


KINEMATICS = ["peak_velocity", "excursion_angle_deg"]


FEATURES = """
features AS (
  SELECT session, trial, max(cue_response_movement_number) AS cue_response_movement_number, min(movement_latency_from_go) AS reaction_time_firstmove,
    first(movement_latency_from_go ORDER BY movement_number_in_trial) FILTER (WHERE cue_response AND movement_latency_from_go IS NOT NULL) AS reaction_time_cueresponse,
    max(CASE WHEN movement_number_in_trial = 1 THEN peak_velocity END) AS first_move_peak_velocity,
    max(CASE WHEN movement_number_in_trial = 1 THEN excursion_angle_deg END) AS first_move_excursion_angle_deg,
    first(peak_velocity ORDER BY movement_number_in_trial) FILTER (WHERE cue_response) AS cue_response_peak_velocity,
    first(excursion_angle_deg ORDER BY movement_number_in_trial) FILTER (WHERE cue_response) AS cue_response_excursion_angle_deg
  FROM timed GROUP BY ALL)
"""


def features(b):
    return M.trial_features(b.timed, TRIAL, KINEMATICS)


@query("trial_features", f"WITH {FEATURES} SELECT * FROM features", "reaction_time_firstmove reaction_time_cueresponse first_move_excursion_angle_deg cue_response_excursion_angle_deg")
def trial_features(b):
    return features(b)


@query("prelick_features", """
SELECT session, trial, avg(excursion_angle_deg) AS mean_angle, last(excursion_angle_deg ORDER BY movement_number_in_trial) AS last_angle,
  avg(duration) AS mean_duration, avg(total_distance) AS mean_distance, avg(peak_velocity) AS mean_peak, max(peak_velocity) AS max_peak, count(*) AS n_movements
FROM timed WHERE movement_before_cue_response GROUP BY ALL""", "mean_angle last_angle mean_duration mean_distance mean_peak max_peak")
def prelick_features(b):
    return M.prelick_features(b.timed, TRIAL)


@query("prelick_count_share", """
WITH p AS (
  SELECT session, trial, count(*) FILTER (WHERE movement_before_cue_response) AS n FROM timed GROUP BY ALL HAVING bool_or(cue_response)),
c AS (SELECT least(n, 4) AS n_before, count(*) AS n_trials FROM p GROUP BY ALL)
SELECT n_before, n_trials, n_trials / (SELECT sum(n_trials) FROM c)::DOUBLE AS share,
  (SELECT coalesce(sum(n_trials) FILTER (WHERE n_before > 0), 0) FROM c) / (SELECT sum(n_trials) FROM c)::DOUBLE AS fraction_with_any FROM c""", "share fraction_with_any")
def prelick_count_share(b):
    return M.prelick_count_share(b.timed, S)


@query("last_prelick", """
SELECT session, trial, arg_max(peak_velocity, movement_number_in_trial) FILTER (WHERE movement_before_cue_response) AS peak_velocity,
  arg_max(CASE WHEN excursion_angle_deg > 0 THEN excursion_angle_deg END, movement_number_in_trial)
    FILTER (WHERE movement_before_cue_response AND excursion_angle_deg > 0) AS excursion_angle_deg,
  first(event ORDER BY movement_number_in_trial) FILTER (WHERE cue_response) AS cue_lick_direction
FROM timed GROUP BY ALL HAVING bool_or(cue_response) AND bool_or(movement_before_cue_response)""", "excursion_angle_deg")
def last_prelick(b):
    # angles at or below zero are missing here, so that each column has its own last known row
    rows = b.timed.withColumn("excursion_angle_deg", F.when(F.col("excursion_angle_deg") > 0, F.col("excursion_angle_deg")))
    return M.last_prelick(rows, TRIAL, ["peak_velocity", "excursion_angle_deg"], ["left_lick_time", "right_lick_time"])


@query("movement_profile", f"""
WITH {NEAREST},
n AS (SELECT *, row_number() OVER (PARTITION BY session, movement_id ORDER BY t) AS n FROM licked)
SELECT session, movement_id, first(t ORDER BY xv DESC, t) - min(t) AS time_to_peak_xv, first(n ORDER BY xv DESC, t) = 1 AS peak_at_first,
  max(CASE WHEN n = 1 THEN v END) AS speed_1, max(CASE WHEN n = 2 THEN v END) AS speed_2,
  min(CASE WHEN lick THEN t END) - min(t) AS time_to_first_lick FROM n GROUP BY ALL""", "time_to_peak_xv speed_1 speed_2 time_to_first_lick")
def movement_profile(b):
    return M.movement_profile(licked(b), MOVE, "t", b.width)


POINTS = """
kp AS (SELECT session, CASE k % 3 WHEN 0 THEN 'jaw' WHEN 1 THEN 'spout_l' ELSE 'spout_r' END AS keypoint, value AS x, k::DOUBLE AS y, event_id FROM ev),
means AS (SELECT session, keypoint, avg(x) AS x, avg(y) AS y FROM kp GROUP BY ALL)
"""


def keypoints(b):
    k = F.col("k")
    return b.ev.select(
        "session", F.when(k % 3 == 0, "jaw").when(k % 3 == 1, "spout_l").otherwise("spout_r").alias("keypoint"),
        F.col("value").alias("x"), k.cast("double").alias("y"), "event_id",
    )


@query("landmarks", f"""
WITH {POINTS} SELECT a.session, a.keypoint AS "from", b.keypoint AS "to", b.x - a.x AS dx, b.y - a.y AS dy,
  sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS distance
FROM means a JOIN means b ON a.session = b.session AND a.keypoint < b.keypoint""", "dx dy distance")
def landmarks(b):
    return M.landmark_distances(M.landmark_means(keypoints(b), S), S, ["jaw", "spout_l", "spout_r"])


@query("nearest_landmark", f"""
WITH {POINTS},
w AS (SELECT l.session, l.x AS lx, l.y AS ly, r.x AS rx, r.y AS ry FROM means l JOIN means r ON l.session = r.session AND l.keypoint = 'spout_l' AND r.keypoint = 'spout_r'),
d AS (SELECT k.session, k.event_id, sqrt((x - lx) * (x - lx) + (y - ly) * (y - ly)) AS da, sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry)) AS db FROM kp k JOIN w USING (session))
SELECT session, event_id, CASE WHEN da <= db THEN 'spout_l' ELSE 'spout_r' END AS nearest, least(da, db) AS nearest_distance FROM d""", "nearest_distance")
def nearest_landmark(b):
    points = keypoints(b)
    return M.nearest_landmark(points, M.landmark_means(points, S), S, "spout_l", "spout_r").select(
        "session", "event_id", "nearest", "nearest_distance"
    )


@query("detector_grid", """
WITH RECURSIVE radii AS (SELECT unnest(range(2, 11)) * 10.0::DOUBLE AS radius), deads AS (SELECT unnest(range(0, 11)) * 21600.0::DOUBLE AS dead_time),
tol AS (SELECT unnest(range(1, 51)) * 360.0::DOUBLE AS tolerance),
cand AS (SELECT session, start_time AS t, total_distance AS d, radius, dead_time FROM views, radii, deads WHERE total_distance <= radius),
c AS (SELECT *, row_number() OVER (PARTITION BY session, radius, dead_time ORDER BY t) AS n FROM cand),
walk AS (
  SELECT session, radius, dead_time, n, t, t AS kept, true AS keep FROM c WHERE n = 1
  UNION ALL
  SELECT c.session, c.radius, c.dead_time, c.n, c.t, CASE WHEN c.t > w.kept + c.dead_time THEN c.t ELSE w.kept END, c.t > w.kept + c.dead_time
  FROM walk w JOIN c ON c.session = w.session AND c.radius = w.radius AND c.dead_time = w.dead_time AND c.n = w.n + 1),
det AS (SELECT * FROM walk WHERE keep),
lick_reach AS (SELECT g.radius, g.dead_time, l.session, l.lick_index, min(abs(l.t - d.t)) AS d FROM licks l CROSS JOIN (SELECT radius, dead_time FROM radii, deads) g
  LEFT JOIN det d ON d.session = l.session AND d.radius = g.radius AND d.dead_time = g.dead_time GROUP BY ALL),
det_reach AS (SELECT d.radius, d.dead_time, d.session, d.n, min(abs(l.t - d.t)) AS d FROM det d LEFT JOIN licks l ON l.session = d.session GROUP BY ALL),
tp AS (SELECT radius, dead_time, tolerance, count(*) FILTER (WHERE d <= tolerance) AS tp, count(*) AS n FROM lick_reach, tol GROUP BY ALL),
fp AS (SELECT radius, dead_time, tolerance, count(*) FILTER (WHERE d IS NULL OR d > tolerance) AS fp FROM det_reach, tol GROUP BY ALL),
cell AS (SELECT radius, dead_time, tolerance, tp, coalesce(fp, 0) AS fp, n - tp AS fn FROM tp LEFT JOIN fp USING (radius, dead_time, tolerance))
SELECT radius, dead_time, tolerance, tp, fp, fn, tp / nullif(tp + fn, 0)::DOUBLE AS recall, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision,
  fn / (tp + fn)::DOUBLE AS fnr, coalesce(fp / nullif(tp + fp, 0)::DOUBLE, 0) AS fdr, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1 FROM cell""", "recall precision fnr fdr f1")
def detector_grid(b):
    candidates = b.views.select("session", F.col("start_time").alias("t"), F.col("total_distance").alias("d"))
    radii, dead_times = [10.0 * k for k in range(2, 11)], [DAY / 4 * k for k in range(11)]
    return D.detector_grid(candidates, b.licks, S, "t", "d", radii, dead_times, [HOUR / 10 * k for k in range(1, 51)], b.width)

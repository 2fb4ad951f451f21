"""Queries over spikes around events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.operators import perievent as E
from tempora.plans.bindings import DAY, HOUR, S
from tempora.plans.catalog import query
from tempora.plans.movement_tables import BOUTS, FEATURES, classed_bouts, features
from tempora.plans.time_joins import COUNTS

UNIT = ["session", "unit"]

TRIAL_COUNTS = f"""
tc AS (
  SELECT session, unit, trial, n_resp AS spike_count, n_base AS baseline_spike_count, first_resp AS first_spike_latency_s,
         n_resp / 86400.0::DOUBLE AS spike_rate_hz, n_base / 172800.0::DOUBLE AS baseline_rate_hz,
         n_resp / 86400.0::DOUBLE - n_base / 172800.0::DOUBLE AS delta_hz, n_resp > 0 AS had_spike
  FROM ({COUNTS}) q)
"""


def trial_counts(b):
    """Counts per unit and trial with the trial features alongside."""
    trials = b.trials.select("session", "trial", "cue", "animal_response", "value", "rewarded_left", "rewarded_right")
    return E.unit_trial_counts(b.spikes, b.units, trials, S, "unit", "t", "cue", (0.0, DAY), (-2 * DAY, 0.0), b.width)


@query("unit_trial_counts", f"""
WITH {TRIAL_COUNTS}, {FEATURES}
SELECT c.session, c.unit, c.trial, spike_count, baseline_spike_count, spike_rate_hz * 3600 AS rate_h, delta_hz * 3600 AS delta_h,
  first_spike_latency_s, had_spike, f.reaction_time_firstmove, f.cue_response_movement_number
FROM tc c LEFT JOIN features f USING (session, trial)""", "rate_h delta_h first_spike_latency_s reaction_time_firstmove")
def unit_trial_counts(b):
    joined = trial_counts(b).join(features(b), ["session", "trial"], "left")
    return joined.select(
        *UNIT, "trial", "spike_count", "baseline_spike_count", (F.col("spike_rate_hz") * HOUR).alias("rate_h"),
        (F.col("delta_hz") * HOUR).alias("delta_h"), "first_spike_latency_s", "had_spike", "reaction_time_firstmove",
        "cue_response_movement_number",
    )


@query("raster", """
WITH n AS (SELECT session, cue, row_number() OVER (PARTITION BY session ORDER BY cue) - 1 AS event_index FROM cues)
SELECT s.session, s.unit, n.event_index, s.t - n.cue AS rel FROM spikes s JOIN n
ON n.session = s.session AND s.t BETWEEN n.cue - 86400 AND n.cue + 172800""", "rel")
def raster(b):
    return E.raster(b.spikes.drop("k"), b.cues.select("session", "cue"), S, "t", "cue", DAY, 2 * DAY, (), b.width).select(
        *UNIT, "event_index", "rel"
    )


# rates are per hour on a grid of 12 six-hour bins from one day before to two days after
PETH = """
bins AS (SELECT unnest(range(0, 12)) AS bin),
rel AS (
  SELECT s.session, s.unit, least(floor((s.t - c.cue + 86400) / 21600)::BIGINT, 11) AS bin FROM spikes s JOIN cues c
  ON c.session = s.session AND s.t BETWEEN c.cue - 86400 AND c.cue + 172800),
ne AS (SELECT session, count(*) AS n_events FROM cues GROUP BY ALL),
every AS (
  SELECT session, unit, bin::BIGINT AS bin, 1 AS n FROM rel
  UNION ALL SELECT session, unit, bin, 0 FROM units CROSS JOIN bins WHERE session IN (SELECT session FROM cues)),
nr AS (SELECT session, unit, bin, sum(n) AS n FROM every GROUP BY ALL),
peth AS MATERIALIZED (
  SELECT nr.session, nr.unit, nr.bin, -86400 + nr.bin * 21600.0::DOUBLE AS bin_start,
         nr.n / ((SELECT n_events FROM ne WHERE ne.session = nr.session) * 6.0::DOUBLE) AS rate FROM nr)
"""


def hourly_peth(b):
    out = E.peth(b.spikes.drop("k"), b.units, b.cues.select("session", "cue"), S, "unit", "t", "cue", -DAY, 6 * HOUR, 12)
    return out.withColumn("rate", F.col("rate") * HOUR)


@query("peth", f"WITH {PETH} SELECT * FROM peth", "rate")
def peth(b):
    return hourly_peth(b)


RATE_STATS = """
ends AS (SELECT session, unit, min(t) AS t0, greatest(ceil((max(t) - min(t)) / 86400)::BIGINT, 1) AS n_bins FROM spikes GROUP BY ALL HAVING count(*) >= 2),
occ AS (SELECT s.session, s.unit, e.n_bins, least(floor((s.t - e.t0) / 86400)::BIGINT, e.n_bins - 1) AS bin, count(*) AS c FROM spikes s JOIN ends e USING (session, unit) GROUP BY ALL),
rs AS (
  SELECT session, unit, n_bins, sum(c)::DOUBLE / n_bins AS m, sum(c * c)::DOUBLE / n_bins AS m2 FROM occ GROUP BY session, unit, n_bins),
rate_stats AS (SELECT session, unit, n_bins, m / 24 AS rate_mean, sqrt(greatest(m2 - m * m, 0)) / 24 AS rate_sd FROM rs)
"""


def hourly_rate_stats(b):
    out = E.session_rate_stats(b.spikes, UNIT, "t", DAY)
    return out.withColumns({c: F.col(c) * HOUR for c in ("rate_mean", "rate_sd")})


@query("session_rate_stats", f"WITH {RATE_STATS} SELECT * FROM rate_stats", "rate_mean rate_sd")
def session_rate_stats(b):
    return hourly_rate_stats(b)


ZPETH = f"""
{PETH},
bs AS (SELECT *, avg(rate) FILTER (WHERE bin_start < 0) OVER w AS m, stddev_pop(rate) FILTER (WHERE bin_start < 0) OVER w AS s FROM peth WINDOW w AS (PARTITION BY session, unit)),
zpeth AS (SELECT session, unit, bin, bin_start, rate, CASE WHEN s > 1e-12 THEN (rate - m) / s END AS z FROM bs)
"""


def zpeth(b):
    return E.zscore_peth(hourly_peth(b), UNIT, F.col("bin_start") < 0)


@query("zscore_peth", f"WITH {ZPETH} SELECT session, unit, bin, z FROM zpeth", "z")
def zscore_peth(b):
    return zpeth(b).select(*UNIT, "bin", "z")


@query("zscore_peth_session", f"""
WITH {PETH}, {RATE_STATS} SELECT p.session, p.unit, p.bin, CASE WHEN rate_sd > 1e-12 THEN (p.rate - rate_mean) / rate_sd END AS z
FROM peth p LEFT JOIN rate_stats USING (session, unit)""", "z")
def zscore_peth_session(b):
    return E.zscore_peth(hourly_peth(b), UNIT, F.lit(True), hourly_rate_stats(b), UNIT).select(*UNIT, "bin", "z")


@query("centred_peth", f"""
WITH {PETH} SELECT session, unit, bin, rate - avg(rate) FILTER (WHERE bin < 5) OVER (PARTITION BY session, unit) AS centred FROM peth""", "centred")
def centred_peth(b):
    return E.centre_on_first_bins(hourly_peth(b), UNIT).select(*UNIT, "bin", "centred")


@query("signed_peak", f"""
WITH {ZPETH}, k AS (
  SELECT session, unit, max(z) FILTER (WHERE bin_start >= 0) AS hi, min(z) FILTER (WHERE bin_start >= 0) AS lo, bool_and(z IS NOT NULL) AS whole FROM zpeth GROUP BY ALL),
q AS (SELECT session, unit, CASE WHEN round(abs(hi), 9) >= round(abs(lo), 9) THEN hi ELSE lo END AS signed_peak FROM k WHERE whole)
SELECT *, row_number() OVER (ORDER BY round(signed_peak, 9) DESC, session, unit) AS peak_rank FROM q""", "signed_peak")
def signed_peak(b):
    return E.signed_peak(zpeth(b), UNIT, F.col("bin_start") >= 0, b.measured("events"))


@query("mean_sem_by_bin", f"""
WITH {ZPETH} SELECT bin, avg(z) AS mean, stddev_samp(z) / sqrt(count(z)) AS sem, count(z) AS n FROM zpeth GROUP BY ALL""", "mean sem")
def mean_sem_by_bin(b):
    return E.mean_sem(zpeth(b), ["bin"], "z")


BOUT_COUNTS = f"""
{BOUTS},
bc AS (
  SELECT u.session, u.unit, c.movement_id, c.class,
    (SELECT count(*) FROM spikes s WHERE s.session = u.session AND s.unit = u.unit AND s.t >= c.start_time - 172800 AND s.t < c.start_time) / 48.0::DOUBLE AS base_h,
    (SELECT count(*) FROM spikes s WHERE s.session = u.session AND s.unit = u.unit AND s.t >= c.start_time AND s.t < c.start_time + 86400) / 24.0::DOUBLE AS resp_h
  FROM units u JOIN classes c ON c.session = u.session WHERE c.class IS NOT NULL),
unit_means AS (SELECT session, unit, avg(resp_h - base_h) FILTER (WHERE class = 'response') AS response, avg(resp_h - base_h) FILTER (WHERE class = 'inter_trial') AS inter_trial FROM bc GROUP BY ALL),
paired AS (SELECT * FROM unit_means WHERE response IS NOT NULL AND inter_trial IS NOT NULL)
"""


def bout_counts_table(b):
    events = classed_bouts(b).where(F.col("class").isNotNull()).select("session", "movement_id", "class", "start_time")
    out = E.bout_counts(b.spikes, b.units, events, S, "unit", "t", "start_time", (0.0, DAY), (-2 * DAY, 0.0), b.width)
    return out.withColumns({
        "base_h": F.col("baseline_rate_hz") * HOUR, "resp_h": F.col("spike_rate_hz") * HOUR, "delta_h": F.col("delta_hz") * HOUR,
    })


@query("bout_counts", f"WITH {BOUT_COUNTS} SELECT session, unit, movement_id, class, base_h, resp_h, resp_h - base_h AS delta_h FROM bc", "base_h resp_h delta_h")
def bout_counts(b):
    return bout_counts_table(b).select(*UNIT, "movement_id", "class", "base_h", "resp_h", "delta_h")


def paired_means(b):
    return E.paired_unit_means(bout_counts_table(b), UNIT, ["response", "inter_trial"], "delta_h")


@query("unit_class_rates", f"WITH {BOUT_COUNTS} SELECT * FROM paired", "response inter_trial")
def unit_class_rates(b):
    return paired_means(b)


@query("bout_rate_summary", f"""
WITH {BOUT_COUNTS}
SELECT class, avg(m) AS mean, stddev_samp(m) AS sd, count(*) AS n_units, stddev_samp(m) / sqrt(count(*)) AS sem
FROM (SELECT session, unit, class, avg(resp_h - base_h) AS m FROM bc GROUP BY ALL) q GROUP BY ALL""", "mean sd sem")
def bout_rate_summary(b):
    per_unit = bout_counts_table(b).groupBy(*UNIT, "class").agg(F.avg("delta_h").alias("m"))
    n = F.count(F.lit(1))
    return per_unit.groupBy("class").agg(
        F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), n.alias("n_units"), (F.stddev_samp("m") / F.sqrt(n)).alias("sem")
    )


LABELLED = f"{TRIAL_COUNTS}, lc AS (SELECT tc.*, t.k % 2 AS label, t.value FROM tc JOIN trials t USING (session, trial))"


def labelled_counts(b):
    return trial_counts(b).drop("value").join(
        b.trials.select("session", "trial", (F.col("k") % 2).alias("label"), "value"), ["session", "trial"]
    )


AUC = """
br AS (
  SELECT u.session, u.unit, c.trial, c.k % 2 AS label, g.bin, count(s.t) AS n
  FROM units u JOIN cues c USING (session) CROSS JOIN (SELECT unnest(range(0, 6)) AS bin) g
  LEFT JOIN spikes s ON s.session = u.session AND s.unit = u.unit AND s.t >= c.cue + (g.bin - 2) * 43200 AND s.t < c.cue + (g.bin - 2) * 43200 + 86400
  GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY session, unit, bin ORDER BY n) + (count(*) OVER (PARTITION BY session, unit, bin, n) - 1) / 2.0::DOUBLE AS r FROM br),
au AS (SELECT session, unit, bin, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0, sum(r) FILTER (WHERE label = 1) AS s FROM rk GROUP BY ALL),
auc AS (SELECT session, unit, bin, n1, n0, CASE WHEN n1 > 0 AND n0 > 0 AND n1 + n0 >= 3 THEN (s - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0) END AS auc FROM au)
"""


def sliding_auc(b):
    """AUC of counts in day-long windows sliding by half a day, for the parity of the trial."""
    windows = {f"w{i}": ((i - 2) * DAY / 2, (i - 2) * DAY / 2 + DAY) for i in range(6)}
    grid = E.units_by_trials(b.units, b.cues.select("session", "trial", "cue", (F.col("k") % 2).alias("label")), S)
    from tempora.operators.timejoin import window_stats

    counts = window_stats(b.spikes.drop("k"), grid, UNIT, "t", "cue", windows, b.width)
    long = counts.select(*UNIT, "label", *[F.col(f"n_w{i}").alias(str(i)) for i in range(6)]).unpivot(
        [*UNIT, "label"], [str(i) for i in range(6)], "bin", "n"
    ).withColumn("bin", F.col("bin").cast("bigint"))
    # counts are small integers: where sessions are cut at all, cut between counts
    return E.auc_by_bin(long, [*UNIT, "bin"], "n", "label", width=None if b.width is None else 1.0)


@query("auc_by_bin", f"WITH {AUC} SELECT * FROM auc", "auc")
def auc_by_bin(b):
    return sliding_auc(b)


@query("auc_best_bin", f"""
WITH {AUC} SELECT session, unit, bin AS best_bin, auc AS best_auc FROM auc WHERE auc IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY session, unit ORDER BY round(abs(auc - 0.5), 12) DESC, bin) = 1""", "best_auc")
def auc_best_bin(b):
    return E.best_bin(sliding_auc(b), UNIT)


@query("rate_by_category", f"""
WITH {LABELLED} SELECT session, unit,
  CASE WHEN count(*) FILTER (WHERE label = 0) >= 3 THEN avg(baseline_rate_hz * 3600) FILTER (WHERE label = 0) END AS mean_0_baseline,
  CASE WHEN count(*) FILTER (WHERE label = 0) >= 3 THEN avg(spike_rate_hz * 3600) FILTER (WHERE label = 0) END AS mean_0_response,
  CASE WHEN count(*) FILTER (WHERE label = 1) >= 3 THEN avg(baseline_rate_hz * 3600) FILTER (WHERE label = 1) END AS mean_1_baseline,
  CASE WHEN count(*) FILTER (WHERE label = 1) >= 3 THEN avg(spike_rate_hz * 3600) FILTER (WHERE label = 1) END AS mean_1_response
FROM lc GROUP BY ALL""", "mean_0_baseline mean_0_response mean_1_baseline mean_1_response")
def rate_by_category(b):
    hourly = labelled_counts(b).withColumns({c: F.col(c) * HOUR for c in ("baseline_rate_hz", "spike_rate_hz")})
    out = E.rate_by_category(hourly, UNIT, "label")
    return out.select(*UNIT, *[
        F.col(f"mean_{c}_{v}").alias(f"mean_{c}_{n}") for c in (0, 1) for v, n in (("baseline_rate_hz", "baseline"), ("spike_rate_hz", "response"))
    ])


def _tuning_sql(bins, variable):
    return f"""
{LABELLED},
vr AS (SELECT session, unit, value - 40 AS v, spike_rate_hz * 3600 AS rate FROM lc),
{bins},
hit AS (SELECT vr.session, vr.unit, e.bin, vr.v, vr.rate FROM vr JOIN edges e ON e.session = vr.session AND e.unit = vr.unit AND {variable} >= e.lo AND {variable} < e.hi)
"""


EVEN_EDGES = """
ends AS (SELECT session, unit, min(v) AS lo, max(v) AS hi FROM vr GROUP BY ALL),
edges AS (SELECT session, unit, i AS bin,
  CASE WHEN lo < 0 AND hi > 0 THEN CASE WHEN i <= 2 THEN lo * (1 - i / 2.0::DOUBLE) ELSE hi * (i - 2) / 2.0::DOUBLE END ELSE lo + i * (hi - lo) / 4 END AS lo,
  CASE WHEN lo < 0 AND hi > 0 THEN CASE WHEN i + 1 <= 2 THEN lo * (1 - (i + 1) / 2.0::DOUBLE) ELSE hi * (i + 1 - 2) / 2.0::DOUBLE END ELSE lo + (i + 1) * (hi - lo) / 4 END AS hi
  FROM ends, (SELECT unnest(range(0, 4)) AS i) g)"""

CURVE = """
means AS (SELECT session, unit, bin, avg(v) AS variable_mean, avg(rate) AS rate_mean, count(*) AS n FROM hit GROUP BY ALL)
SELECT *, CASE WHEN stddev_pop(rate_mean) OVER w > 1e-12 THEN (rate_mean - avg(rate_mean) OVER w) / stddev_pop(rate_mean) OVER w END AS rate_z
FROM means WINDOW w AS (PARTITION BY session, unit)"""


def tuning_rows(b):
    return labelled_counts(b).select(*UNIT, (F.col("value") - 40).alias("v"), (F.col("spike_rate_hz") * HOUR).alias("rate"))


@query("tuning_curve", f"WITH {_tuning_sql(EVEN_EDGES, 'vr.v')}, {CURVE}", "variable_mean rate_mean rate_z")
def tuning_curve(b):
    return E.tuning_curve(tuning_rows(b), UNIT, "v", "rate", 4, "zero_split")


QUANTILE_EDGES = """
qs AS (SELECT session, unit, quantile_cont(v, [0, 0.25, 0.5, 0.75, 1]) AS q FROM vr GROUP BY ALL),
edges AS (SELECT session, unit, i AS bin, q[i + 1] AS lo, q[i + 2] AS hi FROM qs, (SELECT unnest(range(0, 4)) AS i) g)"""


@query("tuning_curve_quantile", f"WITH {_tuning_sql(QUANTILE_EDGES, 'vr.v')}, {CURVE}", "variable_mean rate_mean rate_z")
def tuning_curve_quantile(b):
    return E.tuning_curve(tuning_rows(b), UNIT, "v", "rate", 4, "quantile", b.width_of("values", b.ev, S, "value"))


RATE_EDGES = """
ends AS (SELECT session, unit, min(rate) AS lo, max(rate) AS hi FROM vr GROUP BY ALL),
edges AS (SELECT session, unit, i AS bin, lo + i * (hi - lo) / 3 AS lo, lo + (i + 1) * (hi - lo) / 3 AS hi FROM ends, (SELECT unnest(range(0, 3)) AS i) g)"""


@query("tuning_curve_reverse", f"""
WITH {_tuning_sql(RATE_EDGES, 'vr.rate')},
m AS (SELECT session, unit, bin, avg(v) AS vm, avg(rate) AS rm, count(*) AS n FROM hit GROUP BY ALL),
a AS (SELECT session, unit, avg(v) AS am, stddev_pop(v) AS asd FROM vr GROUP BY ALL)
SELECT session, unit, bin, n, CASE WHEN asd > 1e-12 THEN (vm - am) / asd END AS variable_z,
  CASE WHEN stddev_pop(rm) OVER w > 1e-12 THEN (rm - avg(rm) OVER w) / stddev_pop(rm) OVER w END AS rate_z
FROM m JOIN a USING (session, unit) WINDOW w AS (PARTITION BY session, unit)""", "variable_z rate_z")
def tuning_curve_reverse(b):
    return E.reverse_tuning_curve(tuning_rows(b), UNIT, "v", "rate", 3)


@query("kernel_spike_matrix", """
WITH e AS (SELECT *, lead(cue) OVER (PARTITION BY session ORDER BY cue) AS next_cue FROM cues),
g AS (SELECT u.session, u.unit, e.trial, e.cue, e.next_cue, b.bin, -43200 + b.bin * 21600.0::DOUBLE AS bin_start FROM units u JOIN e USING (session), (SELECT unnest(range(0, 8)) AS bin) b),
w AS (
  SELECT g.session, g.unit, g.trial, g.bin, sum((1 - exp(-(g.bin_start - (s.t - g.cue)) / 3600)) * exp(-(g.bin_start - (s.t - g.cue)) / 43200)
      / (43200 - 3600 * 43200.0::DOUBLE / 46800)) AS rate
  FROM g JOIN spikes s ON s.session = g.session AND s.unit = g.unit AND g.bin_start - (s.t - g.cue) BETWEEN 0 AND 172800 GROUP BY ALL)
SELECT g.session, g.unit, g.trial, g.bin, CASE WHEN g.next_cue IS NULL OR g.cue + g.bin_start < g.next_cue THEN coalesce(w.rate, 0) * 86400 END AS rate_d
FROM g LEFT JOIN w USING (session, unit, trial, bin)""", "rate_d")
def kernel_spike_matrix(b):
    from tempora.operators.ordered import lagged

    cues = lagged(b.cues.select("session", "trial", "cue"), S, ["cue"], following={"next_cue": F.col("cue")}, width=b.width)
    out = E.kernel_spike_matrix(
        b.spikes.drop("k"), b.units, cues, S, "unit", "trial", "t", "cue", -DAY / 2, 6 * HOUR, 8, HOUR, DAY / 2, 2 * DAY, "next_cue"
    )
    return out.select(*UNIT, "trial", "bin", (F.col("rate") * DAY).alias("rate_d"))


def _trace_sql(zero):
    return f"""
WITH r AS (SELECT session, movement_id, t, v, xv FROM kins WHERE x IS NOT NULL),
sp AS (SELECT session, movement_id, {zero} AS t0, max(t) AS t1, min(t) AS ts FROM r GROUP BY ALL HAVING count(*) >= 2 AND max(t) - min(t) >= 7200),
g AS (SELECT session, movement_id, p.point, t0 + p.point * 7200.0::DOUBLE AS gt FROM sp, (SELECT unnest(range(0, 12)) AS point) p),
n AS (
  SELECT g.session, g.movement_id, g.point, g.gt, a.t AS pt, a.v AS pv, b.t AS nt, b.v AS nv
  FROM g ASOF LEFT JOIN r a ON a.session = g.session AND a.movement_id = g.movement_id AND g.gt >= a.t
  ASOF LEFT JOIN r b ON b.session = g.session AND b.movement_id = g.movement_id AND g.gt <= b.t),
tr AS (SELECT session, movement_id, point, CASE WHEN pt = gt THEN pv ELSE pv + (nv - pv) * (gt - pt) / nullif(nt - pt, 0) END AS value FROM n)
SELECT point, avg(value) AS mean, stddev_samp(value) / sqrt(count(value)) AS sem, count(value) AS n FROM tr GROUP BY ALL"""


@query("shared_trace_average", _trace_sql("min(t)"), "mean sem")
def shared_trace_average(b):
    rows = b.kins.where(F.col("x").isNotNull())
    return E.mean_sem(E.shared_traces(rows, ["session", "movement_id"], "t", "v", 2 * HOUR, 12, "start", b.width), ["point"], "value")


@query("shared_trace_from_peak", _trace_sql("first(t ORDER BY xv DESC, t)"), "mean sem")
def shared_trace_from_peak(b):
    rows = b.kins.where(F.col("x").isNotNull())
    return E.mean_sem(E.shared_traces(rows, ["session", "movement_id"], "t", "v", 2 * HOUR, 12, "peak", b.width), ["point"], "value")

"""Queries over projections, filters, descriptions, rankings and reshaping."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tempora.functions import geometry as V
from tempora.functions import keys as K
from tempora.operators import checks as C
from tempora.operators import describe as D
from tempora.operators import predicates as R
from tempora.operators import reshape as U
from tempora.plans.bindings import DAY, HOUR, S
from tempora.plans.catalog import query
from tempora.plans.movement_tables import FEATURES, LICK_K, features, licks_by_ordinal
from tempora.plans.time_joins import ANNOTATED, FIRSTS, annotated, firsts

SPEC = {"p_size": {"bounds": [10, 30]}, "p_brand": {"items": ["Brand#1", "Brand#2", "Brand#17"]}, "p_retailprice": {"bounds": [900, 1500]}}
PART_IDS = "SELECT p_partkey, 'behavior_' || p_partkey || '_2024-12-20_13-26-07' AS session FROM part"


def session_name(key, time="13-26-07"):
    return F.concat(F.lit("behavior_"), F.col(key), F.lit(f"_2024-12-20_{time}"))


@query("filter_by_criteria", """
SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 30 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#17') AND p_retailprice BETWEEN 900 AND 1500""")
def filter_by_criteria(b):
    return R.filter_by_criteria(b.table("part"), SPEC).select("p_partkey")


@query("session_quality_gate", """
SELECT user_id AS session, 100 * avg(CASE WHEN value > 2 THEN 1 ELSE 0 END) AS coverage_pct, quantile_cont(value, 0.5) AS duration_p50,
  100 * avg(CASE WHEN value > 2 THEN 1 ELSE 0 END) > 90 AND quantile_cont(value, 0.5) > 10 AS passed FROM events GROUP BY ALL""", "coverage_pct duration_p50")
def session_quality_gate(b):
    from tempora.operators.ordered import quantiles

    coverage = b.ev.groupBy("session").agg((100 * F.avg((F.col("value") > 2).cast("int"))).alias("coverage_pct"))
    median = quantiles(b.ev, S, "value", {"duration_p50": 0.5}, b.width_of("values", b.ev, S, "value"))
    return R.session_quality_gate(coverage.join(median, "session"), "coverage_pct", "duration_p50", 90, 10)


@query("unit_session_gate", """
SELECT 'behavior_' || s_suppkey || '_2024-12-20_13-26-07' AS session, p_partkey AS unit FROM part p JOIN supplier s ON s.s_suppkey = p_partkey % (SELECT count(*) FROM supplier)
WHERE p_size BETWEEN 10 AND 30 AND s_acctbal > 3000""")
def unit_session_gate(b):
    n = b.table("supplier").agg(F.count(F.lit(1))).scalar()
    units = b.table("part").withColumn("__s", F.col("p_partkey") % n).select(
        session_name("__s").alias("session"), F.col("p_partkey").alias("unit"), "p_size"
    )
    allowed = b.table("supplier").where("s_acctbal > 3000").select(session_name("s_suppkey", "09-00-00").alias("session"))
    return R.unit_session_gate(units, allowed, {"p_size": {"bounds": [10, 30]}}).select("session", "unit")


@query("gate_counts", """
WITH u AS (SELECT 'behavior_' || (p_partkey % 40) || '_2024-12-20_13-26-07' AS session, p_size FROM part)
SELECT session, count(*) AS n_before, count(*) FILTER (WHERE p_size > 45) AS n_after FROM u GROUP BY ALL""")
def gate_counts(b):
    units = b.table("part").withColumn("__s", F.col("p_partkey") % 40).select(session_name("__s").alias("session"), "p_size")
    return R.gate_counts(units, units.where("p_size > 45"))


@query("query_filter", "SELECT session, movement_id FROM movs WHERE cue_response AND peak_velocity > 20 AND trial IS NOT NULL")
def query_filter(b):
    return b.movs.filter("cue_response and peak_velocity > 20 and trial is not null").select("session", "movement_id")


@query("drop_nulls", "SELECT session, frame, x, y FROM masked WHERE x IS NOT NULL AND y IS NOT NULL")
def drop_nulls(b):
    return b.masked.select("session", "frame", "x", "y").dropna("any", subset=["x", "y"])


@query("finite_range_filter", f"""
WITH {FEATURES} SELECT session, trial, reaction_time_firstmove AS rt FROM features WHERE reaction_time_firstmove > 3600 AND reaction_time_firstmove < 172800""", "rt")
def finite_range_filter(b):
    rts = features(b).select("session", "trial", F.col("reaction_time_firstmove").alias("rt"))
    return R.finite_range(rts, "rt", HOUR, 2 * DAY)


def wide_sizes(b, *columns):
    return {c: b.width_of(f"all-{c}", b.ev, [], c) for c in columns}


@query("percentile_band", """
WITH q AS (SELECT quantile_cont(value, 0.005) AS a, quantile_cont(value, 0.995) AS z, quantile_cont(k, 0.02) AS c, quantile_cont(k, 0.98) AS d FROM ev)
SELECT session, event_id FROM ev, q WHERE value BETWEEN greatest(a, -1e9) AND z AND value BETWEEN a AND z AND k BETWEEN (SELECT quantile_cont(k, 0.005) FROM ev) AND (SELECT quantile_cont(k, 0.995) FROM ev)""")
def percentile_band(b):
    return D.percentile_band(b.ev, ["value", "k"], 0.005, 0.995, widths=wide_sizes(b, "value", "k")).select("session", "event_id")


@query("percentile_clip", """
WITH q AS (SELECT quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.98) AS z FROM ev)
SELECT session, event_id, greatest(a, least(z, value)) AS value FROM ev, q""", "value")
def percentile_clip(b):
    out = D.percentile_band(b.ev, ["value"], 0.02, 0.98, clip=True, widths=wide_sizes(b, "value"))
    return out.select("session", "event_id", "value")


@query("distribution_report", """
SELECT count(*) FILTER (WHERE value BETWEEN 1 AND 100) AS n_shown, count(*) FILTER (WHERE NOT value BETWEEN 1 AND 100) AS n_excluded,
  avg(value) FILTER (WHERE value BETWEEN 1 AND 100) AS mean_shown, quantile_cont(value, 0.5) FILTER (WHERE value BETWEEN 1 AND 100) AS median_shown FROM ev""", "mean_shown median_shown")
def distribution_report(b):
    return D.distribution_report(b.ev, "value", 1, 100, b.width_of("all-value", b.ev, [], "value"))


@query("derive_time_columns", """
WITH z AS (SELECT session, arg_min(cue, trial) AS t0 FROM trials GROUP BY ALL)
SELECT session, trial, cue - t0 AS go_time_in_session, cue - cue AS go_time_in_trial, cue AS go_time_raw, reward_outcome_time - t0 AS reward_outcome_time_in_session,
  reward_outcome_time - cue AS reward_outcome_time_in_trial, reward_outcome_time AS reward_outcome_time_raw FROM trials JOIN z USING (session)""",
       "go_time_in_session reward_outcome_time_in_session reward_outcome_time_in_trial go_time_in_trial")
def derive_time_columns(b):
    rows = b.trials.select("session", "trial", F.col("cue").alias("go_time"), "reward_outcome_time")
    return R.derive_time_columns(rows, S, "trial", "go_time")


@query("coerce_flags", """
WITH s AS (SELECT event_id, CASE k % 5 WHEN 0 THEN 'True' WHEN 1 THEN '1' WHEN 2 THEN 'no' WHEN 3 THEN '' ELSE NULL END AS raw, CASE WHEN k % 7 = 0 THEN 'bad' ELSE CAST(k AS VARCHAR) END AS num FROM ev)
SELECT event_id, coalesce(lower(raw) IN ('true', '1', '1.0', 'yes'), false) AS flag, try_cast(num AS DOUBLE) AS number FROM s""")
def coerce_flags(b):
    m = F.col("k") % 5
    raw = F.when(m == 0, "True").when(m == 1, "1").when(m == 2, "no").when(m == 3, "")
    num = F.when(F.col("k") % 7 == 0, "bad").otherwise(F.col("k").cast("string"))
    return b.ev.select("event_id", K.flag(raw).alias("flag"), K.number(num).alias("number"))


@query("canon_unit", """
WITH u AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey || '.0' WHEN 1 THEN CAST(p_partkey AS VARCHAR) WHEN 2 THEN 'KS' || p_partkey ELSE 'nan' END AS u FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN CAST(p_partkey AS VARCHAR) ELSE u END AS unit FROM u""")
def canon_unit(b):
    key = F.col("p_partkey")
    raw = F.when(key % 4 == 0, F.concat(key, F.lit(".0"))).when(key % 4 == 1, key.cast("string")).when(
        key % 4 == 2, F.concat(F.lit("KS"), key)
    ).otherwise("nan")
    return b.table("part").select("p_partkey", K.canon_unit(raw).alias("unit"))


@query("session_prefix", "SELECT p_partkey, 'behavior_' || p_partkey || '_2024-12-20' AS prefix FROM part")
def session_prefix(b):
    return b.table("part").select("p_partkey", K.session_prefix(session_name("p_partkey")).alias("prefix"))


@query("parse_ids", """
SELECT p_partkey, CAST(p_partkey + 1 AS VARCHAR) AS subject, '2024-12-20' AS date,
  CASE p_partkey % 4 WHEN 0 THEN 132607 WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE 91500 END AS suffix, (p_partkey + 1) || '_2024-12-20' AS label,
  CASE WHEN p_partkey % 3 = 0 THEN 0.0::DOUBLE ELSE p_size / 10.0::DOUBLE END AS extra_water, 'box' || p_size AS rig, p_retailprice AS weight_after FROM part""")
def parse_ids(b):
    key, m = F.col("p_partkey") + 1, F.col("p_partkey") % 4
    name = F.when(m == 0, F.concat(F.lit("behavior_"), key, F.lit("_2024-12-20_13-26-07"))).when(
        m == 1, F.concat(key, F.lit("_2024-12-20.json"))
    ).when(m == 2, F.concat(key, F.lit("_2024-12-20_3.json"))).otherwise(F.concat(key, F.lit("_2024-12-20_09-15-00.json")))
    water = F.when(F.col("p_partkey") % 3 == 0, "").otherwise((F.col("p_size") / 10.0).cast("string"))
    notes = F.concat(
        F.lit("Give extra water(ml):"), water, F.lit(" ; tower:box"), F.col("p_size"), F.lit("\nWeight after(g):"),
        F.col("p_retailprice").cast("string"),
    )
    parsed, free = K.parse_session_id(name), K.parse_notes(notes)
    return b.table("part").select(
        "p_partkey", parsed["subject"].alias("subject"), parsed["date"].alias("date"), parsed["suffix"].alias("suffix"),
        K.short_label(name).alias("label"), free["extra_water"].alias("extra_water"), free["rig"].alias("rig"),
        free["weight_after"].alias("weight_after"),
    )


@query("session_from_path", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'behavior_' || page_id || '_2024-12-20_13-26-07' END AS session,
  regexp_extract(url, '://([^/]+)/', 1) AS host FROM pages""")
def session_from_path(b):
    path = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(
        F.concat(F.lit("/data/"), session_name("page_id"), F.lit("/intermediate_data/frames.parquet"))
    )
    return b.table("pages").select(
        "page_id", K.session_from_path(path).alias("session"), F.regexp_extract("url", "://([^/]+)/", 1).alias("host")
    )


@query("classify_row", f"""
WITH {ANNOTATED} SELECT session, lick_index, CASE WHEN cue_response THEN 'cue response' WHEN bout_start THEN 'bout start' ELSE 'other' END AS label FROM annotated""")
def classify_row(b):
    label = K.first_match([(F.col("cue_response"), "cue response"), (F.col("bout_start"), "bout start")], "other")
    return annotated(b).select("session", "lick_index", label.alias("label"))


@query("derive_choice_features", """
WITH c AS (SELECT session, trial, value / 10 AS ql, k / 10.0::DOUBLE AS qr, k / 99.0::DOUBLE AS pr, k % 2 = 0 AS is_right FROM trials),
p AS (SELECT *, greatest(1e-10, least(1 - 1e-10, CASE WHEN is_right THEN pr ELSE 1 - pr END)) AS chosen_prob FROM c)
SELECT session, trial, qr - ql AS q_diff, CASE WHEN is_right THEN qr - ql ELSE ql - qr END AS q_diff_c, chosen_prob, ln(chosen_prob) AS log_likelihood FROM p""",
       "q_diff q_diff_c chosen_prob log_likelihood")
def derive_choice_features(b):
    k = F.col("k")
    rows = b.trials.select(
        "session", "trial", (F.col("value") / 10).alias("q_left"), (k / 10.0).alias("q_right"), (k / 99.0).alias("prob_right"),
        F.when(k % 2 == 0, "right").otherwise("left").alias("direction"),
    )
    return R.choice_features(rows).select("session", "trial", "q_diff", "q_diff_c", "chosen_prob", "log_likelihood")


@query("angle_features", """
WITH a AS (SELECT id, atan2(y, x) AS theta, sqrt(x * x + y * y) AS rho, x, y FROM points)
SELECT id, theta, rho, 0.5 - CASE WHEN theta > -pi() / 4 THEN (theta + pi() / 4) / (pi() + pi() / 4) ELSE (-pi() / 4 - theta) / (pi() - pi() / 4) END AS theta_score,
  x / nullif(abs(x) + abs(y), 0) AS outcome_share, x * y < 0 AS opposed FROM a""", "theta rho theta_score outcome_share")
def angle_features(b):
    theta, rho = V.polar(F.col("x"), F.col("y"))
    share = F.col("x") / F.nullif(F.abs("x") + F.abs("y"), F.lit(0.0))
    return b.points.select(
        "id", theta.alias("theta"), rho.alias("rho"), V.rescale_angle(theta).alias("theta_score"), share.alias("outcome_share"),
        (F.col("x") * F.col("y") < 0).alias("opposed"),
    )


@query("ccf_transform", """
SELECT id, -(x * 1000 - 216) * 0.025::DOUBLE AS ap, (y * 1000 - 18) * 0.025::DOUBLE AS dv, (z * 1000 - 228) * 0.025::DOUBLE AS ml,
  -z AS lps_x, x AS lps_y, -y AS lps_z, abs(z - 0.01::DOUBLE) AS folded FROM points""", "ap dv ml lps_x lps_y lps_z folded")
def ccf_transform(b):
    c = [F.col(n) for n in "xyz"]
    ap, dv, ml = V.voxel_to_mm(*[v * 1000 for v in c])
    lps = V.pir_to_lps(*c)
    return b.points.select(
        "id", ap.alias("ap"), dv.alias("dv"), ml.alias("ml"), *[v.alias(f"lps_{n}") for n, v in zip("xyz", lps)],
        V.fold_midline(F.col("z"), 0.01).alias("folded"),
    )


@query("key_in_set", "SELECT m.session, m.movement_id FROM movs m WHERE EXISTS (SELECT 1 FROM trials t WHERE t.session = m.session AND t.trial = m.trial AND (t.rewarded_left OR t.rewarded_right))")
def key_in_set(b):
    rewarded = b.trials.where(F.col("rewarded_left") | F.col("rewarded_right")).select("session", "trial")
    return b.movs.join(rewarded, ["session", "trial"], "left_semi").select("session", "movement_id")


@query("fill_defaults", """
SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic = 1, false) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def fill_defaults(b):
    labels = b.table("labels").select("doc_id", "quality", (F.col("toxic") == 1).alias("toxic"))
    return b.table("documents").select("doc_id").join(labels, "doc_id", "left").fillna({"quality": 0, "toxic": False})


@query("namespaced_columns", """
WITH st AS (SELECT l_suppkey, avg(l_quantity) - 25 AS t, max(l_discount) AS p FROM lineitem GROUP BY ALL)
SELECT s_suppkey, t AS qty__t, abs(t) AS qty__t_abs, p AS qty__p, abs(p) AS qty__p_abs FROM supplier LEFT JOIN st ON l_suppkey = s_suppkey""", "qty__t qty__t_abs qty__p qty__p_abs")
def namespaced_columns(b):
    stats = b.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        (F.avg("l_quantity") - 25).alias("t"), F.max("l_discount").alias("p")
    )
    base = b.table("supplier").select("s_suppkey")
    once = R.namespaced(base, stats, ["s_suppkey"], "qty", ["t", "p"], absolute=True)
    return R.namespaced(once, stats, ["s_suppkey"], "qty", ["t", "p"])


@query("row_normalize", """
SELECT vec_id, i AS position, embedding[i + 1]::DOUBLE * 1000 / list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS value
FROM embeddings, (SELECT unnest(range(0, 64)) AS i) g WHERE abs(list_sum(list_transform(embedding, lambda x: x::DOUBLE))) > 0.01""", "value", digits=3)
def row_normalize(b):
    whole = F.transform("embedding", lambda x: x.cast("double"))
    rows = b.table("embeddings").select("vec_id", whole.alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    scaled = rows.where(F.abs(total) > 0.01).select("vec_id", V.vector_sum_to(F.col("v")).alias("v"))
    return U.array_to_rows(scaled, ["vec_id"], "v", "position", "value")


@query("behaviour_flags", """
SELECT session, trial, (animal_response <> 2)::INTEGER AS hit, CASE WHEN NOT (rewarded_left OR rewarded_right) THEN (animal_response <> 2)::INTEGER END AS hit_clean,
  (rewarded_left OR rewarded_right)::INTEGER AS outcome FROM trials""")
def behaviour_flags(b):
    return R.behaviour_flags(b.trials).select("session", "trial", "hit", "hit_clean", "outcome")


@query("slice_by_key", "SELECT session, movement_id, min(t) - 60 AS span_start, max(t) + 60 AS span_end FROM kins GROUP BY ALL", "span_start span_end")
def slice_by_key(b):
    return R.movement_span(b.kins, ["session", "movement_id"], "t", 60.0)


@query("clock_convert", "SELECT s.session, s.unit, s.t - c.cue AS t_session FROM spikes s JOIN cues c ON c.session = s.session AND c.trial = 0", "t_session")
def clock_convert(b):
    offsets = b.cues.groupBy("session").agg(F.min("cue").alias("offset"))
    return R.clock_convert(b.spikes, offsets, S, "t", "offset", "t_session").select("session", "unit", "t_session")


@query("inner_on_keys", """
WITH a AS (SELECT l_suppkey, avg(l_quantity) AS t FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), r AS (SELECT l_suppkey, avg(l_quantity) AS t FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT a.l_suppkey, a.t AS t_a, r.t AS t_b FROM a JOIN r USING (l_suppkey)""", "t_a t_b")
def inner_on_keys(b):
    def side(flag, name):
        return b.lineitem.where(F.col("l_returnflag") == flag).groupBy("l_suppkey").agg(F.avg("l_quantity").alias(name))

    return side("A", "t_a").join(side("R", "t_b"), "l_suppkey")


@query("outer_on_keys", """
WITH a AS (SELECT c_nationkey AS k, avg(c_acctbal) AS c FROM customer WHERE c_nationkey < 20 GROUP BY ALL), s AS (SELECT s_nationkey AS k, avg(s_acctbal) AS s FROM supplier WHERE s_nationkey > 4 GROUP BY ALL)
SELECT coalesce(a.k, s.k) AS nation, c, s FROM a FULL JOIN s ON a.k = s.k""", "c s")
def outer_on_keys(b):
    a = b.table("customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("nation")).agg(F.avg("c_acctbal").alias("c"))
    s = b.table("supplier").where("s_nationkey > 4").groupBy(F.col("s_nationkey").alias("nation")).agg(F.avg("s_acctbal").alias("s"))
    return C.checked_join(a, s, ["nation"], "full", "one_to_one")


@query("semi_anti", """
SELECT c.session, c.trial, EXISTS (SELECT 1 FROM movs m WHERE m.session = c.session AND m.trial = c.trial) AS has_movement FROM cues c""")
def semi_anti(b):
    cues, on = b.cues.select("session", "trial"), ["session", "trial"]
    moved = b.movs.select(*on)
    return cues.join(moved, on, "left_semi").withColumn("has_movement", F.lit(True)).unionByName(
        cues.join(moved, on, "left_anti").withColumn("has_movement", F.lit(False))
    )


@query("common_to_all", "SELECT session FROM ev WHERE value > 60 GROUP BY session HAVING count(DISTINCT kind) = 5")
def common_to_all(b):
    rows = b.ev.where("value > 60")
    n = b.ev.agg(F.countDistinct("kind")).scalar()
    return rows.groupBy("session").agg(F.countDistinct("kind").alias("n")).where(F.col("n") == n).select("session")


def _bins_sql(expr, cond="true"):
    return f"""
WITH e AS (SELECT kind, value AS x, k::DOUBLE AS y FROM ev), m AS (SELECT kind, min(x) AS lo, max(x) AS hi FROM e GROUP BY ALL),
p AS (SELECT e.*, lo, hi, (x - lo) / ((hi - lo) / 10) AS place FROM e JOIN m USING (kind))
SELECT kind, {expr} AS bin, avg(x) AS x_mean, avg(y) AS y_mean, stddev_samp(y) / sqrt(count(*)) AS y_sem, count(*) AS n FROM p WHERE {cond} GROUP BY ALL"""


@query("binned_mean_sem", _bins_sql("least(greatest(0, ceil(place)::BIGINT - 1), 9)"), "x_mean y_mean y_sem")
def binned_mean_sem(b):
    return D.binned_mean_sem(b.ev.withColumn("y", F.col("k").cast("double")), ["kind"], "value", "y", 10)


@query("binned_mean_sem_left", _bins_sql("least(floor(place)::BIGINT, 9)", "x < hi"), "x_mean y_mean y_sem")
def binned_mean_sem_left(b):
    return D.binned_mean_sem(b.ev.withColumn("y", F.col("k").cast("double")), ["kind"], "value", "y", 10, "left")


@query("histogram_density", """
WITH e AS (SELECT kind, CASE WHEN value < 5 THEN 0 WHEN value < 20 THEN 1 WHEN value < 60 THEN 2 WHEN value <= 200 THEN 3 END AS bin FROM ev WHERE value BETWEEN 0 AND 200),
t AS (SELECT kind, count(*) AS total FROM e GROUP BY ALL), c AS (SELECT kind, bin, count(*) AS n FROM e GROUP BY ALL),
g AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 5.0::DOUBLE), (1, 5.0::DOUBLE, 20.0::DOUBLE), (2, 20.0::DOUBLE, 60.0::DOUBLE), (3, 60.0::DOUBLE, 200.0::DOUBLE)) v(bin, lo, hi))
SELECT t.kind, g.bin::BIGINT AS bin, g.lo, g.hi, coalesce(c.n, 0) AS n, coalesce(c.n, 0) / (total * (hi - lo)) AS density FROM t CROSS JOIN g LEFT JOIN c ON c.kind = t.kind AND c.bin = g.bin""", "density")
def histogram_density(b):
    return D.histogram_density(b.ev, ["kind"], "value", [0, 5, 20, 60, 200])


BINNED = """
c AS (SELECT kind, bin, count(*) AS n FROM v JOIN g ON x >= lo AND (x < hi OR x = hi AND bin = (SELECT max(bin) FROM g)) GROUP BY ALL),
t AS (SELECT kind, sum(n) AS total FROM c GROUP BY ALL)
SELECT t.kind, g.bin::BIGINT AS bin, g.lo, g.hi, coalesce(c.n, 0) AS n, coalesce(c.n, 0) / (total * (hi - lo)) AS density FROM t CROSS JOIN g LEFT JOIN c ON c.kind = t.kind AND c.bin = g.bin"""


@query("histogram_density_log", f"""
WITH v AS (SELECT kind, value AS x FROM ev), g AS (SELECT i AS bin, pow(10, -1 + i * 0.5) AS lo, pow(10, -1 + (i + 1) * 0.5) AS hi FROM range(0, 8) r(i)), {BINNED}""", "lo hi density")
def histogram_density_log(b):
    return D.histogram_density(b.ev, ["kind"], "value", D.log_edges(0.1, 1000.0, 8))


@query("histogram_density_angular", f"""
WITH v AS (SELECT kind, (k + 0.5) / 100.0::DOUBLE * 2 * pi() - pi() AS x FROM ev), g AS (SELECT i AS bin, -pi() + i * pi() / 6 AS lo, -pi() + (i + 1) * pi() / 6 AS hi FROM range(0, 12) r(i)), {BINNED}""", "lo hi density")
def histogram_density_angular(b):
    return D.histogram_density(b.ev.withColumn("x", (F.col("k") + 0.5) / 100 * 2 * math.pi - math.pi), ["kind"], "x", D.angular_edges(12))


@query("histogram_density_percentile", f"""
WITH v AS (SELECT kind, value AS x FROM ev), q AS (SELECT quantile_cont(x, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]) AS e FROM v),
g AS (SELECT i AS bin, e[i + 1] AS lo, e[i + 2] AS hi FROM q, range(0, 8) r(i)), {BINNED}""", "lo hi density")
def histogram_density_percentile(b):
    return D.histogram_density(b.ev, ["kind"], "value", D.percentile_edges(b.ev, "value", 8, b.width_of("ev-value", b.ev, [], "value")))


@query("latency_by_ordinal", f"""
WITH {LICK_K} SELECT session, k, avg(latency / 3600) AS mean, stddev_samp(latency / 3600) / sqrt(count(*)) AS sem, count(*) AS n, quantile_cont(latency / 3600, 0.5) AS median
FROM lick_k WHERE k <= 4 GROUP BY ALL""", "mean sem median")
def latency_by_ordinal(b):
    hourly = licks_by_ordinal(b).withColumn("latency", F.col("latency") / HOUR)
    return D.latency_by_ordinal(hourly, S, "k", "latency", 4, None if b.width is None else b.width / HOUR)


@query("latency_grand_mean", f"""
WITH {LICK_K}, s AS (SELECT session, k, avg(latency) AS mean FROM lick_k WHERE k <= 4 GROUP BY ALL)
SELECT k, avg(mean) AS grand_mean, stddev_samp(mean) / sqrt(count(*)) AS grand_sem, count(*) AS n_sessions FROM s GROUP BY ALL""", "grand_mean grand_sem", digits=5)
def latency_grand_mean(b):
    by_session = licks_by_ordinal(b).where("k <= 4").groupBy("session", "k").agg(F.avg("latency").alias("mean"))
    return D.grand_mean(by_session, "k")


@query("exclusion_summary", f"""
WITH {FEATURES}, f AS (SELECT session, coalesce(reaction_time_firstmove > 3600 AND reaction_time_firstmove < 172800, false) AS kept FROM features)
SELECT session, count(*) AS n_total, count(*) FILTER (WHERE kept) AS n_kept, count(*) FILTER (WHERE NOT kept) AS n_excluded,
  100.0::DOUBLE * count(*) FILTER (WHERE NOT kept) / count(*) AS pct_excluded FROM f GROUP BY ALL""", "pct_excluded")
def exclusion_summary(b):
    return D.exclusion_summary(features(b), S, "reaction_time_firstmove", HOUR, 2 * DAY)


@query("min_trials_filter", "SELECT session, trial FROM cues WHERE session IN (SELECT session FROM cues GROUP BY session HAVING count(DISTINCT trial) >= 14)")
def min_trials_filter(b):
    return D.min_trials_filter(b.cues.select("session", "trial"), S, "trial", 14)


@query("lognormal_fit", f"""
WITH {FEATURES} SELECT session, avg(ln(reaction_time_firstmove)) AS ln_mean, stddev_samp(ln(reaction_time_firstmove)) AS ln_sd,
  avg(reaction_time_firstmove) AS normal_mean, stddev_samp(reaction_time_firstmove) AS normal_sd, count(*) AS n
FROM features WHERE reaction_time_firstmove > 0 GROUP BY ALL""", "ln_mean ln_sd normal_mean normal_sd", digits=5)
def lognormal_fit(b):
    return D.lognormal_fit(features(b), S, "reaction_time_firstmove")


@query("pivot_mean_argmax", """
WITH m AS (SELECT l_linenumber AS line, l_returnflag AS flag, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL)
SELECT line, max(m) FILTER (WHERE flag = 'A') AS "A", max(m) FILTER (WHERE flag = 'N') AS "N", max(m) FILTER (WHERE flag = 'R') AS "R" FROM m GROUP BY ALL""", "A N R", digits=3)
def pivot_mean_argmax(b):
    rows = b.lineitem.select(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return U.long_to_wide(rows, ["line"], "flag", ["A", "N", "R"], F.avg("l_extendedprice"))


@query("pivot_argmax_cell", """
SELECT l_linenumber AS line, l_quantity AS qty, avg(l_extendedprice) AS mean FROM lineitem GROUP BY ALL ORDER BY round(avg(l_extendedprice), 12) DESC, line, qty LIMIT 1""", "mean", digits=3)
def pivot_argmax_cell(b):
    rows = b.lineitem.select(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"), "l_extendedprice")
    return D.pivot_mean_argmax(rows, "line", "qty", [], "l_extendedprice")[1]


@query("bin2d_mean", """
SELECT floor(x / 10)::BIGINT AS cell_i, floor(y / 10)::BIGINT AS cell_j, avg(v) AS mean, count(*) AS n FROM masked WHERE x IS NOT NULL GROUP BY ALL""", "mean")
def bin2d_mean(b):
    return D.bin2d_mean(b.masked, "x", "y", "v", 10.0)


@query("bin2d_hex_mean", """
WITH a AS (SELECT v, (sqrt(3.0::DOUBLE) / 3 * x - y / 3) / 10 AS q, 2.0::DOUBLE / 3 * y / 10 AS r FROM masked WHERE x IS NOT NULL),
c AS (SELECT v, q, r, -q - r AS s, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM a),
d AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM c)
SELECT CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END::BIGINT AS cell_i, CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END::BIGINT AS cell_j,
  avg(v) AS mean, count(*) AS n FROM d GROUP BY ALL""", "mean")
def bin2d_hex_mean(b):
    return D.bin2d_mean(b.masked, "x", "y", "v", 10.0, hexagonal=True)


@query("nearest_rank_percentiles", """
WITH r AS (SELECT session, movement_id, peak_velocity, row_number() OVER (PARTITION BY session ORDER BY peak_velocity, movement_id) - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM views),
p AS (SELECT * FROM (VALUES ('p05', 0.05::DOUBLE), ('p50', 0.5::DOUBLE), ('p95', 0.95::DOUBLE)) v(label, p))
SELECT session, label, movement_id, peak_velocity FROM r, p WHERE i = round_even(p * (n - 1), 0)""")
def nearest_rank_percentiles(b):
    rows = b.views.select("session", "movement_id", "peak_velocity")
    return D.nearest_rank(rows, S, ["peak_velocity", "movement_id"], {"p05": 0.05, "p50": 0.5, "p95": 0.95}, b.width_of("values", b.ev, S, "value"))


@query("describe_values", """
SELECT kind, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
  avg(CASE WHEN value BETWEEN 5 AND 50 THEN 1 ELSE 0 END) AS frac_inside, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.9) AS p90
FROM ev GROUP BY ALL""", "mean std frac_inside p10 median p90")
def describe_values(b):
    return D.describe_values(b.ev, ["kind"], "value", 5, 50, b.width_of("kind-value", b.ev, ["kind"], "value"))


@query("session_min_events", """
SELECT session, count(*) FILTER (WHERE kind = 'click') AS n_click, count(*) FILTER (WHERE kind = 'view') AS n_view FROM ev GROUP BY session
HAVING count(*) FILTER (WHERE kind = 'click') > 12 AND count(*) FILTER (WHERE kind = 'view') > 12""")
def session_min_events(b):
    return D.session_min_events(b.ev, S, "kind", ["click", "view"], 12)


@query("multi_key_sort", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey")
def multi_key_sort(b):
    return D.sorted_rows(b.table("supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), [("s_nationkey", True), ("s_acctbal", False)], ["s_suppkey"])


@query("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_n(b):
    return D.top_n(b.table("orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), 25, ["o_orderkey"])


@query("pick_examples", "SELECT id, f3 FROM points ORDER BY abs(f3) DESC, id LIMIT 10")
def pick_examples(b):
    return D.pick_examples(b.points.select("id", "f3"), "f3", "top_abs", 10, ["id"])


@query("pick_examples_negative", "SELECT id, f3 FROM points ORDER BY f3, id LIMIT 10")
def pick_examples_negative(b):
    return D.pick_examples(b.points.select("id", "f3"), "f3", "top_neg", 10, ["id"])


@query("pick_examples_random")
def pick_examples_random(b):
    return D.pick_examples(b.points.select("id", "f3"), "f3", "random", 10, ["id"], seed=7)


@query("top_bottom_per_group", """
WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS hi,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS lo FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice, hi AS rank, 'best' AS side FROM o WHERE hi <= 3
UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, lo, 'worst' FROM o WHERE lo <= 3""")
def top_bottom_per_group(b):
    return D.top_bottom(b.table("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_totalprice"], ["o_orderkey"], 3)


@query("keep_first_last", """
SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_order, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS last_order FROM orders GROUP BY ALL""")
def keep_first_last(b):
    rows = b.table("orders").select("o_custkey", "o_orderdate", "o_orderkey")
    first = D.keep_one(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("first_order"))
    last = D.keep_one(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], last=True).select("o_custkey", F.col("o_orderkey").alias("last_order"))
    return first.join(last, "o_custkey")


@query("pareto_front", """
SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))""")
def pareto_front(b):
    part = b.table("part")
    width = b.width_of("part", part.withColumn("__s", -F.col("p_size").cast("double")), [], "__s")
    return D.pareto_front(part, [("p_size", True), ("p_retailprice", False)], "p_partkey", width).select("p_partkey")


@query("pareto_front_three", """
SELECT c_custkey FROM (SELECT *, length(c_name) + c_custkey % 97 AS n FROM customer) a WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT *, length(c_name) + c_custkey % 97 AS n FROM customer) b WHERE b.c_acctbal >= a.c_acctbal AND b.n >= a.n AND b.c_nationkey <= a.c_nationkey
  AND (b.c_acctbal > a.c_acctbal OR b.n > a.n OR b.c_nationkey < a.c_nationkey))""")
def pareto_front_three(b):
    rows = b.table("customer").withColumn("n", F.length("c_name") + F.col("c_custkey") % 97)
    return D.pareto_front(rows, [("c_acctbal", True), ("n", True), ("c_nationkey", False)], "c_custkey").select("c_custkey")


@query("score_rank", "SELECT p_partkey, p_size * p_retailprice AS score FROM part ORDER BY score DESC, p_partkey LIMIT 20", "score", digits=3)
def score_rank(b):
    return D.score_rank(b.table("part"), F.col("p_size") * F.col("p_retailprice"), 20, ["p_partkey"]).select("p_partkey", "score")


@query("sample_rows")
def sample_rows(b):
    return D.sample_rows(b.views.select("session", "movement_id", "peak_velocity"), 20, ["session", "movement_id"], 11)


@query("first_group_over", f"""
WITH {LICK_K}, c AS (SELECT session, trial, count(*) AS n FROM lick_k GROUP BY ALL) SELECT session, min(trial) AS trial FROM c WHERE n > 3 GROUP BY ALL""")
def first_group_over(b):
    return D.first_group_over(licks_by_ordinal(b), S, "trial", 3)


@query("union_sessions", """
SELECT session, t, 'lick' AS source, lick_index AS item, NULL::DOUBLE AS duration FROM licks UNION ALL SELECT session, start_time, 'movement', movement_id, duration FROM views""", "duration")
def union_sessions(b):
    return U.union_tagged({
        "lick": b.licks.select("session", "t", F.col("lick_index").alias("item")),
        "movement": b.views.select("session", F.col("start_time").alias("t"), F.col("movement_id").alias("item"), "duration"),
    }, "source")


@query("union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(b):
    return U.union_distinct(
        b.table("customer").select(F.col("c_nationkey").alias("nation")), b.table("supplier").select(F.col("s_nationkey").alias("nation"))
    )


@query("set_diff_intersect", """
WITH a AS (SELECT DISTINCT session FROM ev WHERE kind = 'click' AND value > 80), c AS (SELECT DISTINCT session FROM ev WHERE kind = 'view' AND value > 80)
SELECT coalesce(a.session, c.session) AS session, CASE WHEN a.session IS NULL THEN 'right' WHEN c.session IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN c ON a.session = c.session""")
def set_diff_intersect(b):
    return U.set_report(b.ev.where("kind = 'click' and value > 80"), b.ev.where("kind = 'view' and value > 80"), S)


@query("event_timeline", f"""
WITH {FIRSTS}
SELECT session, trial, cue AS t, 'go_cue' AS event FROM firsts UNION ALL SELECT session, trial, choice_time, 'choice' FROM firsts WHERE choice_time IS NOT NULL
UNION ALL SELECT session, trial, reward_time, 'reward' FROM firsts WHERE reward_time IS NOT NULL
UNION ALL SELECT l.session, c.trial, l.t, 'lick' FROM licks l ASOF JOIN cues c ON l.session = c.session AND l.t >= c.cue
UNION ALL SELECT session, trial, start_time, 'movement_start' FROM movs WHERE trial IS NOT NULL UNION ALL SELECT session, trial, end_time, 'movement_end' FROM movs WHERE trial IS NOT NULL""", "t")
def event_timeline(b):
    movs = b.movs
    return U.event_timeline(
        firsts(b), S, {"cue": "go_cue", "choice_time": "choice", "reward_time": "reward"},
        [(licks_by_ordinal(b), "t", F.lit("lick")), (movs, "start_time", F.lit("movement_start")), (movs, "end_time", F.lit("movement_end"))],
    )


@query("event_wide", f"""
WITH {LICK_K},
base AS (SELECT session, trial, cue FROM cues),
fm AS (SELECT session, trial, arg_min(start_time, movement_id) AS first_move FROM movs WHERE trial IS NOT NULL GROUP BY ALL),
cr AS (SELECT session, trial, arg_min(start_time, movement_id) AS response_move FROM movs WHERE trial IS NOT NULL AND cue_response GROUP BY ALL),
nm AS (SELECT session, trial, start_time AS second_move FROM movs m JOIN base USING (session, trial) WHERE start_time > cue
  QUALIFY row_number() OVER (PARTITION BY session, trial ORDER BY movement_id) = 2),
fl AS (SELECT session, trial, min(t) AS first_lick FROM lick_k GROUP BY ALL)
SELECT session, trial, cue AS "goCue", first_move, response_move, second_move, first_lick FROM base LEFT JOIN fm USING (session, trial)
LEFT JOIN cr USING (session, trial) LEFT JOIN nm USING (session, trial) LEFT JOIN fl USING (session, trial)""")
def event_wide(b):
    movs = b.movs.select("session", "trial", "movement_id", "start_time", "cue_response")
    return U.event_wide(S, {
        "goCue": (b.cues, "cue", {}), "first_move": (movs, "start_time", {}),
        "response_move": (movs, "start_time", {"cue_response": True}),
        "second_move": (movs, "start_time", {"min_after_cue": True, "nth": 1}),
        "first_lick": (licks_by_ordinal(b), "t", {}),
    }, b.frame_width)


@query("pivot_unpivot", """
SELECT s.session, k.kind, (SELECT count(*) FROM ev WHERE ev.session = s.session AND ev.kind = k.kind) AS n FROM (SELECT DISTINCT session FROM ev) s, (SELECT DISTINCT kind FROM ev) k""")
def pivot_unpivot(b):
    kinds = sorted(r.kind for r in b.ev.select("kind").distinct().collect())  # the columns to be made
    wide = U.long_to_wide(b.ev, S, "kind", kinds, F.count(F.lit(1))).fillna(0, subset=kinds)
    return U.wide_to_long(wide, S, kinds, "kind", "n")


@query("reorder_align", """
SELECT r.position, n.n_name AS nation, s.total FROM nation n JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_name) - 1 AS position FROM nation) r USING (n_nationkey)
LEFT JOIN (SELECT s_nationkey, sum(s_acctbal) AS total FROM supplier WHERE s_acctbal > 5000 GROUP BY ALL) s ON s.s_nationkey = n.n_nationkey""", "total", digits=4)
def reorder_align(b):
    from tempora.operators.ordered import numbered

    order = numbered(b.table("nation").select("n_nationkey", F.col("n_name").alias("nation")), [], ["nation"], "position")
    totals = b.table("supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sum("s_acctbal").alias("total"))
    return U.align_to_order(order, totals, ["n_nationkey"]).drop("n_nationkey")


@query("array_to_rows", "SELECT vec_id, i AS position, round(embedding[i + 1]::DOUBLE, 6) AS value FROM embeddings, (SELECT unnest(range(0, 64)) AS i) g", "value")
def array_to_rows(b):
    whole = F.transform("embedding", lambda x: F.round(x.cast("double"), 6))
    rows = U.array_to_rows(b.table("embeddings").select("vec_id", whole.alias("v")), ["vec_id"], "v", "position", "value")
    # there and back: vectors have a fixed length, so packing them again is bounded
    packed = U.rows_to_array(rows, ["vec_id"], "position", "value", "v")
    return U.array_to_rows(packed, ["vec_id"], "v", "position", "value")


@query("scalar_functions", """
SELECT session, event_id, sqrt(value) AS root, abs(k - 50)::BIGINT AS away, ln(value + 1) AS ln1, log10(value + 1) AS lg, exp(-value / 100) AS decay, floor(value) AS fl, ceil(value) AS ce,
  ((k - 50) % 7 + 7) % 7 AS pm, sign(value - 20)::INTEGER AS sg, atanh(k / 101.0::DOUBLE) AS ath, tanh(k / 50.0::DOUBLE) AS th, asin(k / 100.0::DOUBLE) AS asn, radians(k::DOUBLE) AS rad,
  round_even(k / 4.0::DOUBLE, 0) AS half_even, printf('%02d:%02d:%02d.%03d', (floor(t)::BIGINT // 3600), (floor(t)::BIGINT // 60) % 60, floor(t)::BIGINT % 60, floor((t - floor(t)) * 1000)::BIGINT) AS clock
FROM ev""", "root ln1 lg decay ath th asn rad")
def scalar_functions(b):
    v, k = F.col("value"), F.col("k")
    return b.ev.select(
        "session", "event_id", F.sqrt(v).alias("root"), F.abs(k - 50).alias("away"), F.ln(v + 1).alias("ln1"), F.log10(v + 1).alias("lg"),
        F.exp(-v / 100).alias("decay"), F.floor(v).cast("double").alias("fl"), F.ceil(v).cast("double").alias("ce"),
        F.pmod(k - 50, F.lit(7)).alias("pm"), F.signum(v - 20).cast("int").alias("sg"), F.atanh(k / 101.0).alias("ath"),
        F.tanh(k / 50.0).alias("th"), F.asin(k / 100.0).alias("asn"), F.radians(k.cast("double")).alias("rad"),
        F.rint(k / 4.0).alias("half_even"), K.clock(F.col("t")).alias("clock"),
    )

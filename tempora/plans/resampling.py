"""Queries over permutation, bootstrap, neighbour and classifier operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tempora.operators import resample as P
from tempora.plans.catalog import query
from tempora.plans.movement_tables import licks_by_ordinal
from tempora.plans.statistics import CIRCULAR
from tempora.session import scratch_root

XYZ = ["x", "y", "z"]
FEATURES = [f"f{i}" for i in range(3, 10)]


@query("bootstrap_std_ci")
def bootstrap_std_ci(b):
    rows = licks_by_ordinal(b).where("k <= 4")
    return P.bootstrap_std_ci(rows, ["k"], "latency", ["session", "lick_index"], 1000, seed=3)


@query("spatial_trend_perm")
def spatial_trend_perm(b):
    return P.spatial_trend(b.points, ["id"], XYZ, "f3", 2000, seed=5, chunks=b.hash_chunks("points", b.points))


@query("spatial_trend_observed", """
WITH m AS (SELECT count(*) AS n, var_pop(x) AS a, covar_pop(x, y) AS b, covar_pop(x, z) AS c, var_pop(y) AS d, covar_pop(y, z) AS e, var_pop(z) AS f,
  covar_pop(x, f3) AS p, covar_pop(y, f3) AS q, covar_pop(z, f3) AS r, var_pop(f3) AS v FROM points),
g AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM m),
fit AS (SELECT n, ((p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) * p + (a * (q * f - e * r) - p * (b * f - c * e) + c * (b * r - q * c)) * q
  + (a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c)) * r) / det / v AS r2 FROM g)
SELECT n, r2, (r2 / 3) / ((1 - r2) / (n - 4)) AS f_stat FROM fit""", "r2 f_stat")
def spatial_trend_observed(b):
    return P.spatial_trend(b.points, ["id"], XYZ, "f3", 1, seed=5, chunks=b.hash_chunks("points", b.points)).select("n", "r2", "f_stat")


KNN = """
pairs AS (
  SELECT a.id, a.f3 AS y, b.f3 AS yn, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d, b.id AS nid
  FROM points a JOIN points b ON a.id % 5 <> b.id % 5),
near AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, nid) <= 15),
pred AS (SELECT id, any_value(y) AS y, CASE WHEN min(d) = 0 THEN avg(yn) FILTER (WHERE d = 0) ELSE sum(yn / d) / sum(1 / d) END AS pred FROM near GROUP BY ALL)
"""


def folded(b):
    return b.points.withColumn("fold", F.col("id") % 5)


@query("knn_cv_r2", f"WITH {KNN} SELECT count(*) AS n, 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) AS r2_cv FROM pred", "r2_cv")
def knn_cv_r2(b):
    return P.knn_cv_r2(folded(b), "id", XYZ, "f3", "fold", 15, 0.05, 0).select("n", "r2_cv")


@query("knn_permutation")
def knn_permutation(b):
    return P.knn_cv_r2(folded(b), "id", XYZ, "f3", "fold", 15, 0.05, 2000, seed=9, chunks=b.hash_chunks("points", b.points))


@query("axis_linear_boot")
def axis_linear_boot(b):
    return P.bootstrap_axis(b.points, ["id"], XYZ, "f3", 2000, seed=2)


@query("axis_cca")
def axis_cca(b):
    return P.axis_cca(b.points, ["id"], XYZ, FEATURES, 2000, seed=2)


@query("axis_lda")
def axis_lda(b):
    return P.axis_lda(b.points, ["id"], XYZ, "label", 2000, seed=2)


def two_angles(b):
    rows = b.ev.where(F.col("kind").isin("click", "view"))
    return rows.withColumn("a", F.col("k") / 100 * 2 * math.pi)


@query("mardia_watson_wheeler")
def mardia_watson_wheeler(b):
    rows = two_angles(b)
    return P.circular_permutation(rows, ["event_id"], "a", F.col("kind") == "click", 5000, 4, b.hash_chunks("events", b.ev))


@query("mardia_watson_wheeler_observed", f"WITH {CIRCULAR} SELECT n1, n2, w FROM cw", "w")
def mardia_watson_wheeler_observed(b):
    out = P.circular_permutation(two_angles(b), ["event_id"], "a", F.col("kind") == "click", 1, 4, b.hash_chunks("events", b.ev))
    return out.select("n1", "n2", "w")


@query("group_shift_perm", """
WITH p AS (SELECT p_retailprice AS v, p_size > 40 AS g FROM part)
SELECT count(*) FILTER (WHERE g) AS n_tagged, count(*) FILTER (WHERE NOT g) AS n_other, avg(v) FILTER (WHERE g) - avg(v) FILTER (WHERE NOT g) AS shift,
  (avg(v) FILTER (WHERE g) - avg(v) FILTER (WHERE NOT g)) / sqrt(var_samp(v) FILTER (WHERE g) / count(*) FILTER (WHERE g) + var_samp(v) FILTER (WHERE NOT g) / count(*) FILTER (WHERE NOT g)) AS welch_t FROM p""", "shift welch_t")
def group_shift_perm(b):
    part = b.table("part")
    out = P.group_shift(part, ["p_partkey"], "p_retailprice", F.col("p_size") > 40, 20_000, 6, b.hash_chunks("part", part))
    return out.select("n_tagged", "n_other", "shift", "welch_t")


@query("group_shift_p")
def group_shift_p(b):
    part = b.table("part")
    return P.group_shift(part, ["p_partkey"], "p_retailprice", F.col("p_size") > 40, 20_000, 6, b.hash_chunks("part", part))


def balances(b):
    customers = b.table("customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    suppliers = b.table("supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return P.two_sample_shift(customers, suppliers, "balance", 5000, 8, b.hash_chunks("customer", customers), on=["nation"])


@query("two_sample_shift", """
WITH x AS (SELECT c_nationkey AS nation, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY ALL),
y AS (SELECT s_nationkey AS nation, count(*) AS n, avg(s_acctbal) AS m, var_samp(s_acctbal) AS v FROM supplier GROUP BY ALL)
SELECT nation, coalesce(x.n, 0) AS n_tagged, coalesce(y.n, 0) AS n_other, x.m - y.m AS shift, (x.m - y.m) / sqrt(x.v / x.n + y.v / y.n) AS welch_t FROM x FULL JOIN y USING (nation)""", "shift welch_t")
def two_sample_shift(b):
    return balances(b).select("nation", "n_tagged", "n_other", "shift", "welch_t")


@query("two_sample_shift_p")
def two_sample_shift_p(b):
    return balances(b)


def judged(b):
    """Points as sessions: good is a label under 5, and x stands for the coverage that was observed."""
    rows = b.points.withColumn("good", F.col("label") < 5)
    scored, auc = P.classify_sessions(rows, ["f3", "f4", "f5"], "good", "id", trees=200, folds=5, seed=1)
    return scored.join(b.points.select("id", "x"), "id"), auc


@query("classify_sessions")
def classify_sessions(b):
    scored, auc = judged(b)
    return scored.select("id", "good", "fold", "pred_p_good", "pred_out_of_fold", F.lit(auc).alias("cv_auc"))


@query("under_performers")
def under_performers(b):
    return P.under_performers(judged(b)[0], "x", -0.05, 5, tie=["id"]).select("id", "x", "f3", "f4", "f5", "pred_p_good")


@query("under_performer_rule", "SELECT least(5, count(*)) AS listed, 0::BIGINT AS not_below, count(*) AS below, 0::BIGINT AS better_left_out FROM points WHERE x < -0.05")
def under_performer_rule(b):
    """What the list must keep to, whatever was learned: rows below the limit only, and none with a better score left out."""
    scratch_root(b.spark)
    scored = judged(b)[0].select("id", "x", "pred_p_good").checkpoint()
    listed = P.under_performers(scored, "x", -0.05, 5, tie=["id"])
    worst = listed.agg(F.min("pred_p_good")).scalar()
    rest = scored.where(F.col("x") < -0.05).join(listed.select("id"), "id", "left_anti")
    return listed.agg(F.count(F.lit(1)).alias("listed"), F.count_if(F.col("x") >= -0.05).alias("not_below")).withColumns({
        "below": scored.where(F.col("x") < -0.05).agg(F.count(F.lit(1))).scalar(),
        "better_left_out": rest.agg(F.count_if(F.col("pred_p_good") > worst)).scalar(),
    })


@query("logistic_direction")
def logistic_direction(b):
    rows = b.points.withColumn("right", (F.col("label") % 2 == 0).cast("int"))
    return P.logistic_direction(rows, FEATURES, "right", "id", seed=1, chunks=b.hash_chunks("points", b.points))

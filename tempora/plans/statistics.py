"""Queries over closed-form statistics and the per-unit registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.functions.geometry import angle_between, cross
from tempora.operators import describe as D
from tempora.operators import registry as R
from tempora.operators import stats as X
from tempora.plans import sqltext as T
from tempora.plans.catalog import query
from tempora.plans.movement_tables import LICK_K, licks_by_ordinal
from tempora.plans.peri_event import BOUT_COUNTS, paired_means

SUPP = ["l_suppkey"]

LINES = "li AS (SELECT l_suppkey, l_returnflag, l_linestatus, ln(l_quantity) AS x, l_extendedprice AS y, l_discount AS d, l_tax AS tax, l_quantity AS q FROM lineitem)"


def lines(b):
    return b.lineitem.select(
        "l_suppkey", "l_returnflag", "l_linestatus", F.ln("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"),
        F.col("l_discount").alias("d"), F.col("l_tax").alias("tax"), F.col("l_quantity").alias("q"),
    )


def _corr(x, y):
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


CORRELATED = f"""
{LINES},
rk AS (SELECT *, {T.average_rank('x', 'l_suppkey')} AS rx, {T.average_rank('y', 'l_suppkey')} AS ry FROM li),
c0 AS (SELECT l_suppkey, count(*) AS n_trials, {_corr('rx', 'ry')} AS spearman_rho, {_corr('x', 'y')} AS pearson_r FROM rk GROUP BY ALL),
c1 AS (SELECT *, {T.corr_p('spearman_rho', 'n_trials')} AS spearman_p, {T.corr_p('pearson_r', 'n_trials')} AS pearson_p,
  spearman_rho * sqrt((n_trials - 2) / (1 - spearman_rho * spearman_rho)) AS spearman_t, pearson_r * sqrt((n_trials - 2) / (1 - pearson_r * pearson_r)) AS pearson_t FROM c0),
c2 AS ({T.fdr('c1', 'spearman_p', 'spearman_q')}), c3 AS ({T.fdr('c2', 'pearson_p', 'pearson_q')})
"""


@query("unit_correlations", f"""
WITH {CORRELATED} SELECT *, coalesce(spearman_q < 0.05, false) AS spearman_sig_fdr, coalesce(pearson_q < 0.05, false) AS pearson_sig_fdr FROM c3""",
       "spearman_rho spearman_p spearman_q spearman_t pearson_r pearson_p pearson_q pearson_t")
def unit_correlations(b):
    return X.unit_correlations(lines(b), SUPP, "x", "y", width=b.price_width, p_width=b.measured("supplier"), tasks=b.tasks("lineitem"))


@query("corr_to_t", f"""
WITH {LINES}, r AS (SELECT l_suppkey, count(*) AS n, {_corr('x', 'd')} AS r FROM li GROUP BY ALL)
SELECT l_suppkey, n, r, CASE WHEN n > 2 AND abs(r) < 0.999999 THEN r * sqrt((n - 2) / (1 - r * r)) END AS t FROM r""", "r t")
def corr_to_t(b):
    base = lines(b).groupBy(*SUPP).agg(F.count(F.lit(1)).alias("n"), X.safe_corr(F.col("x"), F.col("d")).alias("r"))
    return base.withColumn("t", X.corr_to_t(F.col("r"), F.col("n")))


@query("fdr_bh", f"""
WITH {LINES}, g0 AS (SELECT l_suppkey, l_returnflag, min(q) AS mq FROM li GROUP BY ALL),
g AS (SELECT l_suppkey, l_returnflag, CASE WHEN l_suppkey % 9 > 0 THEN (l_suppkey % 37 + 1) / 500.0::DOUBLE * mq END AS p FROM g0)
{T.fdr('g', 'p', 'q', 'l_returnflag')}""", "p q")
def fdr_bh(b):
    p = F.when(F.col("l_suppkey") % 9 > 0, (F.col("l_suppkey") % 37 + 1) / 500.0 * F.min("q"))
    groups = lines(b).groupBy("l_suppkey", "l_returnflag").agg(p.alias("p"))
    return X.fdr_bh(groups, ["l_returnflag"], "p", "q", b.measured("supplier"))


@query("fdr_bh_chunked", f"""
WITH {LINES}, g0 AS (SELECT l_suppkey, l_returnflag, min(q) AS mq FROM li GROUP BY ALL),
g AS (SELECT l_suppkey, l_returnflag, CASE WHEN l_suppkey % 9 > 0 THEN (l_suppkey % 37 + 1) / 500.0::DOUBLE * mq END AS p FROM g0)
{T.fdr('g', 'p', 'q')}""", "p q")
def fdr_bh_chunked(b):
    # the plan very many units get, over all groups at once
    p = F.when(F.col("l_suppkey") % 9 > 0, (F.col("l_suppkey") % 37 + 1) / 500.0 * F.min("q"))
    return X.fdr_bh(lines(b).groupBy("l_suppkey", "l_returnflag").agg(p.alias("p")), [], "p", "q", 0.5)


def _ols(prefix, y):
    r = _corr("x", y)
    return f"""
{prefix}0 AS (SELECT l_suppkey, count(*) AS n, {r} AS r, stddev_pop({y}) AS sd FROM li GROUP BY ALL HAVING count(*) >= 50),
{prefix}1 AS (SELECT l_suppkey, n AS {prefix}_n, r * sd AS {prefix}_coef, r * sqrt((n - 2) / (1 - r * r)) AS {prefix}_t, {T.corr_p('r', 'n')} AS {prefix}_p FROM {prefix}0),
{prefix}2 AS ({T.fdr(prefix + '1', prefix + '_p', prefix + '_q')})"""


@query("ols_per_unit", f"WITH {LINES}, {_ols('resp', 'y')}, {_ols('base', 'd')} SELECT * FROM resp2 FULL JOIN base2 USING (l_suppkey)",
       "resp_t resp_p resp_q base_coef base_t base_p base_q resp_coef")
def ols_per_unit(b):
    return X.fit_rt_ols(lines(b), SUPP, "q", "y", "d", 50, b.measured("supplier"))


@query("linregress", f"""
WITH {LINES}, m AS (SELECT l_returnflag, l_linestatus, l_suppkey, count(*) AS n, covar_pop(q, y) / var_pop(q) AS slope, avg(y) - covar_pop(q, y) / var_pop(q) * avg(q) AS intercept,
  {_corr('q', 'y')} AS r FROM li GROUP BY ALL HAVING count(*) > 20)
SELECT l_returnflag, l_linestatus, l_suppkey, n, slope, intercept, r * r AS r2, r * sqrt((n - 2) / (1 - r * r)) AS t, {T.corr_p('r', 'n')} AS p FROM m""",
       "slope intercept r2 t p", digits=5)
def linregress(b):
    return X.linregress(lines(b), ["l_returnflag", "l_linestatus", "l_suppkey"], "q", "y").where("n > 20")


@query("regression_band", f"""
WITH {LINES}, m AS (SELECT l_suppkey, count(*) AS n, avg(q) AS mx, avg(d) AS my, var_pop(q) AS vx, var_pop(d) AS vy, covar_pop(q, d) AS c, min(q) AS lo, max(q) AS hi FROM li GROUP BY ALL HAVING count(*) > 2),
g AS (SELECT *, lo + p.point * (hi - lo) / 10 AS x, c / vx AS slope, n * greatest(vy - c / vx * c, 0) / (n - 2) AS s2 FROM m, (SELECT unnest(range(0, 11)) AS point) p)
SELECT l_suppkey, point, x, my + slope * (x - mx) AS fit, sqrt(s2 * (1.0::DOUBLE / n + (x - mx) * (x - mx) / (n * vx))) AS se FROM g""", "x fit se")
def regression_band(b):
    # the half width over the t quantile is the standard error, which SQL can state
    from tempora.functions.pvalues import student_quantile

    band = X.regression_band(lines(b), SUPP, "q", "d", 11)
    n = lines(b).groupBy(*SUPP).agg((F.count(F.lit(1)) - 2).cast("double").alias("df"))
    crit = n.select(*SUPP, student_quantile(F.lit(0.05), F.col("df")).alias("crit"))
    return band.join(crit, SUPP).select(*SUPP, "point", "x", "fit", ((F.col("upper") - F.col("lower")) / 2 / F.col("crit")).alias("se"))


def _mann_whitney(columns, on, group):
    """Tables of a recursive WITH up to `mw`: per group U, the normal p and the exact p where scipy's rule asks for it."""
    return f"""
{LINES}, g AS (SELECT {on}, {columns} AS y, {group} AS g FROM lineitem), r AS (SELECT *, {T.average_rank('y', on)} AS r FROM g),
t AS (SELECT {on}, sum(c * c * c - c) AS ties FROM (SELECT {on}, y, count(*)::DOUBLE AS c FROM g GROUP BY ALL) q GROUP BY ALL),
s AS (SELECT {on}, count(*) FILTER (WHERE g) AS n1, count(*) FILTER (WHERE NOT g) AS n0, sum(r) FILTER (WHERE g) AS rs, avg(y) FILTER (WHERE g) - avg(y) FILTER (WHERE NOT g) AS mean_diff FROM r GROUP BY ALL),
u AS (SELECT {on}, n1, n0, mean_diff, ties, CASE WHEN n0 > 0 THEN rs - n1 * (n1 + 1) / 2.0::DOUBLE END AS u, sqrt(n1::DOUBLE * n0 / 12 * ((n1 + n0 + 1) - ties / nullif((n1 + n0)::DOUBLE * (n1 + n0 - 1), 0))) AS sd FROM s JOIN t USING ({on})),
z AS (SELECT *, (greatest(u, n1 * n0 - u) - n1 * n0 / 2.0::DOUBLE - 0.5) / nullif(sd, 0) AS z FROM u), {T.rank_sum_tails('us', 's')},
mw AS (SELECT {on}, n1, n0, mean_diff, z.u, CASE WHEN z.u IS NULL THEN NULL WHEN ties = 0 AND least(n1, n0) BETWEEN 1 AND 8 THEN least(1, 2 * tail)
  ELSE least(1, CASE WHEN z >= 0 THEN {T.normal_p2('z')} ELSE 2 - {T.normal_p2('z')} END) END AS p
  FROM z LEFT JOIN us ON us.k = n1 AND us.m = n0 AND us.u = least(z.u, n1 * n0 - z.u))"""


@query("mann_whitney", f"WITH RECURSIVE {_mann_whitney('l_extendedprice', 'l_suppkey', "l_linestatus = 'O'")} SELECT * FROM mw", "mean_diff u p", digits=5)
def mann_whitney(b):
    return X.mann_whitney(lines(b), SUPP, "y", F.col("l_linestatus") == "O", b.price_width, b.tasks("lineitem"))


PARTS = ["l_partkey", "l_returnflag"]


def part_width(b):
    return b.width_of("lineitem by part", b.lineitem, PARTS, "l_extendedprice")


@query("mann_whitney_exact", f"WITH RECURSIVE {_mann_whitney('l_extendedprice', 'l_partkey, l_returnflag', "l_linestatus = 'O'")} SELECT * FROM mw", "mean_diff u p", digits=5)
def mann_whitney_exact(b):
    """Groups of a few to some twenty rows, nearly all without ties."""
    return X.mann_whitney(b.lineitem, PARTS, "l_extendedprice", F.col("l_linestatus") == "O", part_width(b))


@query("ks_exact", f"""
WITH RECURSIVE c AS (SELECT l_partkey, l_returnflag, l_extendedprice AS x, count(*) FILTER (WHERE l_linestatus = 'O') AS a, count(*) FILTER (WHERE l_linestatus <> 'O') AS b FROM lineitem GROUP BY ALL),
f AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY l_partkey, l_returnflag) AS n, sum(b) OVER (PARTITION BY l_partkey, l_returnflag) AS m FROM c WINDOW w AS (PARTITION BY l_partkey, l_returnflag ORDER BY x)),
d AS (SELECT l_partkey, l_returnflag, n, m, max(abs(ca / n::DOUBLE - cb / m::DOUBLE)) AS ks, max(abs(ca * m - cb * n)) AS reach FROM f WHERE n > 0 AND m > 0 GROUP BY ALL), {T.path_exits('px', 'd')}
SELECT l_partkey, l_returnflag, d.n::BIGINT AS n1, d.m::BIGINT AS n0, ks, p FROM d JOIN px ON px.n = d.n AND px.m = d.m AND px.reach = d.reach""", "ks p")
def ks_exact(b):
    return X.ks_two_sample(b.lineitem, PARTS, "l_extendedprice", F.col("l_linestatus") == "O", part_width(b))


def _wilcoxon(name, source, value, key):
    part = f"{key}, " if key else ""
    on = f"JOIN {name}t USING ({key})" if key else f", {name}t"
    return f"""
{name}d AS (SELECT {part}{value} AS d, abs({value}) AS a FROM {source} WHERE {value} <> 0),
{name}r AS (SELECT *, {T.average_rank('a', key)} AS r FROM {name}d),
{name}t AS (SELECT {part}sum(c * c * c - c) AS ties FROM (SELECT {part}a, count(*)::DOUBLE AS c FROM {name}d GROUP BY ALL) q GROUP BY ALL),
{name}s AS (SELECT {part}count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS w FROM {name}r GROUP BY ALL),
{name}z AS (SELECT {part}n, least(w, n * (n + 1) / 2.0::DOUBLE - w) AS w, (least(w, n * (n + 1) / 2.0::DOUBLE - w) - n * (n + 1) / 4.0::DOUBLE)
  / sqrt((n * (n + 1.0::DOUBLE) * (2 * n + 1) - ties / 2) / 24) AS z FROM {name}s {on}),
{name}o AS (SELECT {part}count(*) FILTER (WHERE {value} = 0) AS zeros FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL), {T.signed_rank_tails(f'{name}e')},
{name} AS (SELECT {part}z.n, z.w, CASE WHEN ties = 0 AND zeros = 0 AND z.n <= 50 THEN least(1, 2 * tail) ELSE least(1, {T.normal_p2('z')}) END AS p
  FROM {name}z z {on.replace(', ' + name + 't', f', {name}t, {name}o') if not key else f'JOIN {name}t USING ({key}) JOIN {name}o USING ({key})'} LEFT JOIN {name}e e ON e.n = z.n AND e.w = z.w)"""


@query("wilcoxon_signed", f"WITH RECURSIVE {LINES}, c AS (SELECT l_suppkey, q - 25 AS diff FROM li), {_wilcoxon('wx', 'c', 'diff', 'l_suppkey')} SELECT * FROM wx", "w p")
def wilcoxon_signed(b):
    return X.wilcoxon(lines(b).withColumn("diff", F.col("q") - 25), SUPP, "diff", 1, b.price_width, b.tasks("lineitem"))


@query("wilcoxon_exact", f"WITH RECURSIVE c AS (SELECT l_partkey, l_returnflag, l_extendedprice - 20000 AS diff FROM lineitem), {_wilcoxon('wx', 'c', 'diff', 'l_partkey, l_returnflag')} SELECT * FROM wx", "w p")
def wilcoxon_exact(b):
    rows = b.lineitem.withColumn("diff", F.col("l_extendedprice") - 20000)
    return X.wilcoxon(rows, PARTS, "diff", 1, b.width_of("price differences by part", rows, PARTS, "diff"))


@query("wilcoxon_unit_means", f"WITH RECURSIVE {BOUT_COUNTS}, c AS (SELECT round(response - inter_trial, 9) AS diff FROM paired), {_wilcoxon('wx', 'c', 'diff', '')} SELECT * FROM wx", "w p")
def wilcoxon_unit_means(b):
    return X.wilcoxon(paired_means(b).select(F.round(F.col("response") - F.col("inter_trial"), 9).alias("diff")), [], "diff", 1, b.measured("events"))


@query("sign_binomial", f"""
WITH {LINES}, c AS (SELECT l_suppkey, count(*) FILTER (WHERE q > 25) AS n_pos, count(*) FILTER (WHERE q < 25) AS n_neg FROM li GROUP BY ALL)
SELECT *, {T.binomial_half_p2('n_pos', 'n_neg')} AS p FROM c""", "p")
def sign_binomial(b):
    return X.sign_binomial(lines(b).withColumn("diff", F.col("q") - 25), SUPP, "diff")


@query("fisher_z_meta", f"""
WITH {LINES}, r AS (SELECT l_suppkey, l_returnflag, count(*) AS n, {_corr('x', 'y')} AS r FROM li GROUP BY ALL),
s AS (SELECT l_returnflag, count(*) AS k, sum(n - 3)::DOUBLE AS sw, sum((n - 3) * atanh(greatest(-0.999999, least(0.999999, r)))) AS swz FROM r WHERE n >= 4 AND r IS NOT NULL GROUP BY ALL)
SELECT l_returnflag, k, tanh(swz / sw) AS r, tanh(swz / sw - 1.96 / sqrt(sw)) AS r_lo, tanh(swz / sw + 1.96 / sqrt(sw)) AS r_hi, swz / sqrt(sw) AS z FROM s""", "r r_lo r_hi z")
def fisher_z_meta(b):
    per_unit = lines(b).groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), X.safe_corr(F.col("x"), F.col("y")).alias("r"))
    return X.fisher_z_meta(per_unit, ["l_returnflag"], "r", "n").drop("p")


@query("fisher_exact", f"""
WITH f AS (SELECT p_size % 10 AS grp, p_retailprice > 1000 AS a, p_brand < 'Brand#2' AS b FROM part),
c AS (SELECT grp, count(*) FILTER (WHERE a AND b) AS bo, count(*) FILTER (WHERE a AND NOT b) AS a_only, count(*) FILTER (WHERE NOT a AND b) AS b_only, count(*) FILTER (WHERE NOT a AND NOT b) AS neither FROM f GROUP BY ALL),
k AS (SELECT *, unnest(range(greatest(0, (bo + a_only) + (bo + b_only) - (bo + a_only + b_only + neither)), least(bo + a_only, bo + b_only) + 1)) AS k FROM c),
lp AS (SELECT *, {T.log_factorial('bo + b_only')} - {T.log_factorial('k')} - {T.log_factorial('bo + b_only - k')} + {T.log_factorial('a_only + neither')} - {T.log_factorial('bo + a_only - k')}
  - {T.log_factorial('a_only + neither - bo - a_only + k')} AS lp FROM k),
o AS (SELECT grp, k AS kk, lp AS obs FROM lp WHERE k = bo)
SELECT lp.grp, bo AS "both", a_only, b_only, neither, bo::DOUBLE * neither / nullif(a_only * b_only, 0) AS odds_ratio,
  sum(exp(lp - obs)) FILTER (WHERE lp <= obs + 1e-7) / sum(exp(lp - obs)) AS p FROM lp JOIN o USING (grp) GROUP BY lp.grp, bo, a_only, b_only, neither""", "odds_ratio p")
def fisher_exact(b):
    rows = b.table("part").select((F.col("p_size") % 10).alias("grp"), (F.col("p_retailprice") > 1000).alias("a"), (F.col("p_brand") < "Brand#2").alias("b"))
    return X.fisher_overlap(rows, ["grp"], F.col("a"), F.col("b"))


@query("ks_two_sample", f"""
WITH RECURSIVE {LICK_K}, v AS (SELECT k, latency AS x FROM lick_k WHERE k <= 4),
u AS (SELECT g.k, v.x, (v.k = g.k)::INTEGER AS o, (v.k = 1)::INTEGER AS b FROM v, (SELECT unnest([2, 3, 4]) AS k) g WHERE v.k = g.k OR v.k = 1),
c AS (SELECT k, x, sum(o) AS o, sum(b) AS b FROM u GROUP BY ALL),
f AS (SELECT k, sum(o) OVER w AS co, sum(b) OVER w AS cb, sum(o) OVER (PARTITION BY k) AS n, sum(b) OVER (PARTITION BY k) AS nb FROM c WINDOW w AS (PARTITION BY k ORDER BY x)),
d AS (SELECT k::BIGINT AS k, n::BIGINT AS n, nb::BIGINT AS n_base, max(abs(co / n::DOUBLE - cb / nb::DOUBLE)) AS ks FROM f GROUP BY ALL),
e AS (SELECT *, round(ks * n * n_base) AS reach, n_base AS m FROM d), {T.path_exits('px', '(SELECT n, m, reach FROM e WHERE greatest(n, m) <= 10000)')}
SELECT e.k, e.n, e.n_base, e.ks, coalesce(px.p, least(1, greatest(0, list_sum(list_transform(range(1, 101), lambda j: CASE WHEN j % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END * exp(-2.0::DOUBLE * j * j * ks * ks * e.n * n_base / (e.n + n_base))))))) AS p
FROM e LEFT JOIN px ON px.n = e.n AND px.m = e.m AND px.reach = e.reach""", "ks p")
def ks_two_sample(b):
    return X.ks_against_base(licks_by_ordinal(b), "k", 1, [2, 3, 4], "latency", b.width)


@query("partial_correlation", f"""
WITH {LINES}, r AS (SELECT l_suppkey, {T.average_rank('x', 'l_suppkey')} AS rx, {T.average_rank('y', 'l_suppkey')} AS ry, {T.average_rank('d', 'l_suppkey')} AS rz FROM li),
c AS (SELECT l_suppkey, count(*) AS n, {_corr('rx', 'ry')} AS xy, {_corr('rx', 'rz')} AS xz, {_corr('ry', 'rz')} AS yz FROM r GROUP BY ALL),
p AS (SELECT l_suppkey, n, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS r FROM c)
SELECT *, r * sqrt((n - 3) / (1 - r * r)) AS t, {T.corr_p('r', 'n', 3)} AS p FROM p""", "r t p")
def partial_correlation(b):
    return X.partial_correlation(lines(b), SUPP, "x", "y", "d", b.price_width, b.tasks("lineitem"))


@query("confusion_rates", """
WITH c AS (SELECT p_brand, count(*) FILTER (WHERE p_size > 25 AND p_retailprice > 950) AS tp, count(*) FILTER (WHERE p_size > 25 AND p_retailprice <= 950) AS fp, count(*) FILTER (WHERE p_size <= 25 AND p_retailprice > 950) AS fn FROM part GROUP BY ALL)
SELECT *, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(fn / nullif(tp + fn, 0)::DOUBLE, 0) AS fnr,
  coalesce(fp / nullif(tp + fp, 0)::DOUBLE, 0) AS fdr, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM c""", "recall precision fnr fdr f1")
def confusion_rates(b):
    hit, truth = F.col("p_size") > 25, F.col("p_retailprice") > 950
    counts = b.table("part").groupBy("p_brand").agg(
        F.count_if(hit & truth).alias("tp"), F.count_if(hit & ~truth).alias("fp"), F.count_if(~hit & truth).alias("fn")
    )
    return counts.withColumns(X.confusion_rates(F.col("tp"), F.col("fp"), F.col("fn")))


@query("noise_growth", f"""
WITH {LICK_K}, s AS (SELECT k, count(*) AS n, avg(latency / 3600) AS mean_latency, stddev_pop(latency / 3600) AS std_latency FROM lick_k WHERE k <= 4 GROUP BY ALL)
SELECT *, (SELECT regr_slope(std_latency, k) FROM s) AS slope, (SELECT regr_intercept(std_latency, k) FROM s) AS intercept FROM s""", "mean_latency std_latency slope intercept")
def noise_growth(b):
    return X.noise_growth(licks_by_ordinal(b).where("k <= 4").withColumn("latency", F.col("latency") / 3600), "k", "latency")


@query("pair_pearson", f"""
WITH {LINES}, c AS (SELECT l_returnflag, l_suppkey, count(*) AS n, {_corr('d', 'tax')} AS r FROM li GROUP BY ALL) SELECT *, {T.corr_p('r', 'n')} AS p FROM c""", "r p")
def pair_pearson(b):
    return X.pearson(lines(b), ["l_returnflag", "l_suppkey"], "d", "tax")


_F = [f"f{i}" for i in range(3, 10)]


@query("centroid_distance", f"""
WITH s AS (SELECT {', '.join(f'avg({f}) AS m{f}, stddev_pop({f}) AS s{f}, avg({f}) FILTER (WHERE label < 5) AS g{f}' for f in _F)} FROM points)
SELECT id, sqrt({' + '.join(f'pow(({f} - g{f}) / s{f}, 2)' for f in _F)}) AS dist_to_good FROM points, s""", "dist_to_good")
def centroid_distance(b):
    return X.centroid_distance(b.points, _F, F.col("label") < 5).select("id", "dist_to_good")


@query("impute_scale", """
WITH h AS (SELECT id, CASE WHEN id % 5 > 0 THEN f3 END AS f3, CASE WHEN id % 7 > 0 THEN f4 END AS f4 FROM points), r AS (SELECT * FROM h WHERE f3 IS NOT NULL OR f4 IS NOT NULL),
f AS (SELECT id, coalesce(f3, (SELECT quantile_cont(f3, 0.5) FROM r)) AS f3, coalesce(f4, (SELECT quantile_cont(f4, 0.5) FROM r)) AS f4 FROM r)
SELECT id, (f3 - avg(f3) OVER ()) / stddev_pop(f3) OVER () AS f3, (f4 - avg(f4) OVER ()) / stddev_pop(f4) OVER () AS f4 FROM f""", "f3 f4")
def impute_scale(b):
    holes = b.points.select("id", F.when(F.col("id") % 5 > 0, F.col("f3")).alias("f3"), F.when(F.col("id") % 7 > 0, F.col("f4")).alias("f4"))
    return X.impute_scale(holes, ["f3", "f4"], b.measured("embeddings"))


@query("feature_component_corr", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{c}' AS component, count(*) AS n, {_corr('rf', 'rc')} AS rho FROM (SELECT {T.average_rank(f, '')} AS rf, {T.average_rank(c, '')} AS rc FROM points) q"
    for f in _F for c in ("x", "y")), "rho")
def feature_component_corr(b):
    return X.feature_component_corr(b.points, _F, ["x", "y"], 100, b.measured("embeddings")).drop("p")


@query("mutual_information", """
WITH m AS (SELECT min(l_quantity) AS a, max(l_quantity) AS z, min(l_extendedprice) AS c, max(l_extendedprice) AS e FROM lineitem),
g AS (SELECT least(floor((l_quantity - a) / (z - a) * 10)::BIGINT, 9) AS i, least(floor((l_extendedprice - c) / (e - c) * 10)::BIGINT, 9) AS j FROM lineitem, m),
n AS (SELECT i, j, count(*) AS n FROM g GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY i) AS ni, sum(n) OVER (PARTITION BY j) AS nj, sum(n) OVER () AS t FROM n)
SELECT sum(n / t::DOUBLE * ln(n::DOUBLE * t / (ni::DOUBLE * nj))) AS mi, CAST(sum(n) AS BIGINT) AS n FROM t""", "mi")
def mutual_information(b):
    return X.mutual_information(b.lineitem, "l_quantity", "l_extendedprice", 10)


@query("density_curves", """
WITH h AS (SELECT kind, stddev_samp(value) * pow(count(*)::DOUBLE, -0.2::DOUBLE) AS h FROM ev GROUP BY ALL)
SELECT e.kind, p.point, avg(exp(-pow((value - p.point * 5.0::DOUBLE) / h, 2) / 2) / (h * sqrt(2 * pi()))) AS density, p.point * 5.0::DOUBLE AS x
FROM ev e JOIN h USING (kind), (SELECT unnest(range(0, 21)) AS point) p GROUP BY ALL""", "density x", digits=9)
def density_curves(b):
    return X.density_curve(b.ev, ["kind"], "value", 0.0, 5.0, 21)


# Standard normal quantiles at 5, 25, 50, 75 and 95 percent.
PROBS, NORMAL_Q = [0.05, 0.25, 0.5, 0.75, 0.95], [-1.6448536269514722, -0.6744897501960817, 0.0, 0.6744897501960817, 1.6448536269514722]


@query("qq_pairs", " UNION ALL ".join(
    f"SELECT kind, {p}::DOUBLE AS prob, {z!r}::DOUBLE AS normal, quantile_cont(ln(value + 1), {p}) AS sample FROM ev GROUP BY kind"
    for p, z in zip(PROBS, NORMAL_Q)), "sample normal")
def qq_pairs(b):
    return X.qq_pairs(b.ev.withColumn("lv", F.ln(F.col("value") + 1)), ["kind"], "lv", PROBS, NORMAL_Q, b.width_of("kind-lv", b.ev.withColumn("lv", F.ln(F.col("value") + 1)), ["kind"], "lv"))


@query("projection_correlation", f"""
WITH p AS (SELECT x * 0.6::DOUBLE + y * 0.64::DOUBLE + z * 0.48::DOUBLE AS proj, f3 FROM points), r AS (SELECT {T.average_rank('proj', '')} AS rp, {T.average_rank('f3', '')} AS rf FROM p)
SELECT count(*) AS n, {_corr('rp', 'rf')} AS rho FROM r""", "rho")
def projection_correlation(b):
    return X.projection_correlation(b.points, ["x", "y", "z"], [0.6, 0.64, 0.48], "f3", False, b.measured("embeddings")).drop("p")


@query("linear_trend", """
WITH c AS (SELECT count(*)::DOUBLE AS n, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz,
  covar_pop(x, f3) AS xf, covar_pop(y, f3) AS yf, covar_pop(z, f3) AS zf, var_pop(f3) AS ff FROM points),
d AS (SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM c),
b AS (SELECT n, (xf * (yy * zz - yz * yz) - xy * (yf * zz - yz * zf) + xz * (yf * yz - yy * zf)) / det AS b0,
  (xx * (yf * zz - yz * zf) - xf * (xy * zz - yz * xz) + xz * (xy * zf - yf * xz)) / det AS b1, (xx * (yy * zf - yf * yz) - xy * (xy * zf - yf * xz) + xf * (xy * yz - yy * xz)) / det AS b2, xf, yf, zf, ff FROM d)
SELECT n::BIGINT AS n, b0, b1, b2, b0 / sqrt(b0 * b0 + b1 * b1 + b2 * b2) AS a0, b1 / sqrt(b0 * b0 + b1 * b1 + b2 * b2) AS a1, b2 / sqrt(b0 * b0 + b1 * b1 + b2 * b2) AS a2,
  (b0 * xf + b1 * yf + b2 * zf) / ff AS r2, (b0 * xf + b1 * yf + b2 * zf) / ff / 3 / ((1 - (b0 * xf + b1 * yf + b2 * zf) / ff) / (n - 4)) AS f_stat FROM b""",
       "b0 b1 b2 a0 a1 a2 r2 f_stat")
def linear_trend(b):
    return X.linear_trend(b.points, [], ["x", "y", "z"], "f3")


@query("azimuth_elevation", """
WITH u AS (SELECT id, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z FROM points)
SELECT id, degrees(atan2(y, x)) AS azimuth, degrees(asin(greatest(-1, least(1, z)))) AS elevation, degrees(acos(greatest(-1, least(1, x)))) AS from_x, y AS cross_z FROM u""", "azimuth elevation from_x cross_z", digits=5)
def azimuth_elevation(b):
    from tempora.functions.geometry import norm

    v = [F.col(c) for c in "xyz"]
    unit = [c / norm(v) for c in v]
    az, el = X.azimuth_elevation(unit)
    axis = [F.lit(1.0), F.lit(0.0), F.lit(0.0)]
    return b.points.select("id", az.alias("azimuth"), el.alias("elevation"), angle_between(v, axis).alias("from_x"), cross(axis, unit)[2].alias("cross_z"))


@query("cone_half_angle", "SELECT label, quantile_cont(degrees(acos(greatest(-1, least(1, x / sqrt(x * x + y * y + z * z))))), 0.95) AS cone_half_angle_deg FROM points GROUP BY ALL", "cone_half_angle_deg", digits=5)
def cone_half_angle(b):
    axis = [F.lit(1.0), F.lit(0.0), F.lit(0.0)]
    return X.cone_half_angle(b.points, ["label"], axis, [F.col(c) for c in "xyz"], width=b.measured("embeddings"))


@query("compare_directions", """
WITH r AS (SELECT id, 1.0::DOUBLE + x AS x0, y AS x1, z AS x2, 0.8::DOUBLE + f3 AS y0, 0.6::DOUBLE + f4 AS y1, f5 AS y2 FROM points),
u AS (SELECT x1 / sqrt(x0*x0+x1*x1+x2*x2) AS x1, x2 / sqrt(x0*x0+x1*x1+x2*x2) AS x2, y1 / sqrt(y0*y0+y1*y1+y2*y2) AS y1, y2 / sqrt(y0*y0+y1*y1+y2*y2) AS y2,
  CASE WHEN x0 < 0 THEN -1 ELSE 1 END AS fx, CASE WHEN 0.8 * y0 + 0.6 * y1 < 0 THEN -1 ELSE 1 END AS fy FROM r),
d AS (SELECT y1 * fy - x1 * fx AS d1, y2 * fy - x2 * fx AS d2 FROM u),
s AS (SELECT avg(d1) AS m1, avg(d2) AS m2, var_samp(d1) + 1e-12 AS v1, var_samp(d2) + 1e-12 AS v2, covar_samp(d1, d2) AS c FROM d),
w AS (SELECT v2 * 0.36 / (v1 * v2 - c * c) AS w_obs, (v2 * (d1 - m1) * (d1 - m1) - 2 * c * (d1 - m1) * (d2 - m2) + v1 * (d2 - m2) * (d2 - m2)) / (v1 * v2 - c * c) AS w_null FROM d, s)
SELECT degrees(acos(0.8::DOUBLE)) AS angle_deg, min(w_obs) AS w_obs, exp(-min(w_obs) / 2) AS p_chi2, (count(*) FILTER (WHERE w_null >= w_obs) + 1) / (count(*) + 1)::DOUBLE AS p_boot, count(*) AS n_boot FROM w""",
       "angle_deg w_obs p_chi2 p_boot", digits=5)
def compare_directions(b):
    rows = b.points.select(
        (1 + F.col("x")).alias("x0"), F.col("y").alias("x1"), F.col("z").alias("x2"), (0.8 + F.col("f3")).alias("y0"),
        (0.6 + F.col("f4")).alias("y1"), F.col("f5").alias("y2"), *[F.lit(v).alias(n) for n, v in
        {"ox0": 1.0, "ox1": 0.0, "ox2": 0.0, "oy0": 0.8, "oy1": 0.6, "oy2": 0.0}.items()],
    )
    return X.compare_directions(rows)


CIRCULAR = f"""
cr AS (SELECT {T.average_rank('k', '')} AS r, count(*) OVER () AS n, kind = 'click' AS g FROM ev WHERE kind IN ('click', 'view')),
cs AS (SELECT count(*) FILTER (WHERE g) AS n1, count(*) FILTER (WHERE NOT g) AS n2, sum(cos(2 * pi() * r / n)) FILTER (WHERE g) AS c1, sum(sin(2 * pi() * r / n)) FILTER (WHERE g) AS s1,
  sum(cos(2 * pi() * r / n)) FILTER (WHERE NOT g) AS c2, sum(sin(2 * pi() * r / n)) FILTER (WHERE NOT g) AS s2 FROM cr),
cw AS (SELECT n1, n2, 2.0::DOUBLE / (n1 + n2) * ((c1 * c1 + s1 * s1) / n1 + (c2 * c2 + s2 * s2) / n2) AS w FROM cs)"""


@query("circular_two_sample", f"WITH {CIRCULAR} SELECT * FROM cw", "w")
def circular_two_sample(b):
    import math

    rows = b.ev.where(F.col("kind").isin("click", "view")).withColumn("a", F.col("k") / 100 * 2 * math.pi)
    return X.circular_w(rows, [], "a", F.col("kind") == "click", b.width_of("all-a", rows, [], "a"))


# ---- registry ----

ENTRY = f"""
{LINES},
rg0 AS (SELECT concat_ws('_', l_returnflag, l_linestatus) AS entry, 'behavior_' || (l_suppkey % 5) || '_2024-12-20' AS session_prefix, CAST(l_suppkey AS VARCHAR) AS unit, count(*) AS n_trials, {_corr('x', 'y')} AS coef
  FROM li GROUP BY l_returnflag, l_linestatus, l_suppkey),
rg1 AS (SELECT *, coef * sqrt((n_trials - 2) / (1 - coef * coef)) AS t, {T.corr_p('coef', 'n_trials')} AS p FROM rg0),
rg2 AS ({T.fdr('rg1', 'p', 'q', 'entry')}),
rg3 AS (SELECT l_suppkey, count(*) AS n_trials, {_corr('q', 'tax')} AS coef, {_corr('q', 'tax')} * sqrt((count(*) - 2) / (1 - pow({_corr('q', 'tax')}, 2))) AS t FROM li GROUP BY ALL),
rg AS (SELECT entry, session_prefix, unit, t, p, q, coef, coalesce(q < 0.05, false) AS sig_fdr, n_trials FROM rg2)
"""


def entry_table(b):
    """One correlation per entry name and (session, unit_id)."""
    return lines(b).groupBy("l_returnflag", "l_linestatus", "l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), X.safe_corr(F.col("x"), F.col("y")).alias("r")
    ).select(
        F.concat_ws("_", "l_returnflag", "l_linestatus").alias("entry"),
        F.concat(F.lit("behavior_"), F.col("l_suppkey") % 5, F.lit("_2024-12-20_13-26-07")).alias("session"),
        F.concat(F.col("l_suppkey"), F.lit(".0")).alias("unit_id"), "n", "r",
    ).withColumn("p", X.corr_p(F.col("r"), F.col("n")))


def registry(b):
    flags = lines(b).select(F.concat_ws("_", "l_returnflag", "l_linestatus").alias("entry")).distinct().collect()  # the names of the entries
    reg = R.UnitStatsRegistry(width=b.measured("supplier"), p_width=b.measured("supplier"))
    reg.register_cor_table(sorted(r.entry for r in flags), entry_table(b), entry="entry", coef="r", p="p", n_trials="n")
    return reg.store()


@query("register_cor", f"WITH {ENTRY} SELECT * FROM rg", "t p q coef")
def register_cor(b):
    return registry(b).long().drop("source")


@query("register_partial", f"WITH {ENTRY} SELECT 'partial' AS source, entry, session_prefix, unit, t, q FROM rg WHERE entry = 'A_F'", "t q")
def register_partial(b):
    reg = R.UnitStatsRegistry()
    reg.register_partial("A_F", entry_table(b).where("entry = 'A_F'"), coef="r", p="p", n_trials="n")
    return reg.long().select("source", "entry", "session_prefix", "unit", "t", "q")


WIDE = f"""
{LINES}, {_ols('resp', 'y')}, {_ols('base', 'd')},
wl AS (SELECT 'ols::resp' AS entry, l_suppkey, resp_t AS t, resp_p AS p, resp_coef AS coef FROM resp1 UNION ALL SELECT 'ols::base', l_suppkey, base_t, base_p, base_coef FROM base1),
wq AS ({T.fdr('wl', 'p', 'q', 'entry')})"""


@query("register_regression", f"WITH {WIDE} SELECT CAST(l_suppkey AS VARCHAR) AS unit, t, p, q, coalesce(q < 0.05, false) AS sig_fdr FROM wq WHERE entry = 'ols::resp'", "t p q")
def register_regression(b):
    reg = R.UnitStatsRegistry(prefix=lambda c: c)
    fits = X.fit_rt_ols(lines(b), SUPP, "q", "y", "d", 50, b.measured("supplier")).withColumn("session", F.lit("s"))
    reg.register_regression("rt", fits, t="resp_t", p="resp_p", q="resp_q", coef="resp_coef", n_trials="resp_n", unit="l_suppkey")
    return reg.get("rt").select("unit", "t", "p", "q", "sig_fdr")


@query("register_wide", f"WITH {WIDE} SELECT entry, CAST(l_suppkey AS VARCHAR) AS unit, t, p, q, coef FROM wq", "t p q coef")
def register_wide(b):
    fits = X.fit_rt_ols(lines(b), SUPP, "q", "y", "d", 50, b.measured("supplier")).select(
        F.lit("s").alias("session"), F.col("l_suppkey").alias("unit"),
        *[F.col(f"{k}_{c}").alias(f"{'T' if c == 't' else c}_{k}") for k in ("resp", "base") for c in ("t", "p", "coef")],
    )
    reg = R.UnitStatsRegistry(prefix=lambda c: c)
    assert reg.register_wide("ols", fits) == 2
    return reg.long().select("entry", "unit", "t", "p", "q", "coef")


@query("registry_lookup", f"WITH {ENTRY} SELECT session_prefix, unit, t, sig_fdr FROM rg WHERE entry = 'N_O'", "t")
def registry_lookup(b):
    return registry(b).get("N_O").select("session_prefix", "unit", "t", "sig_fdr")


PAIRS = f"""
{ENTRY},
pairs AS (SELECT a.entry AS entry_a, b.entry AS entry_b, session_prefix, unit, a.t AS t_a, b.t AS t_b, a.sig_fdr AS sig_a, b.sig_fdr AS sig_b
  FROM rg a JOIN rg b USING (session_prefix, unit) WHERE a.entry < b.entry)"""


@query("entry_pairs", f"WITH {PAIRS} SELECT entry_a, entry_b, session_prefix, unit, t_a, t_b FROM pairs", "t_a t_b")
def entry_pairs(b):
    long = registry(b).long()
    return R.entry_pairs(long, long).select("entry_a", "entry_b", "session_prefix", "unit", "t_a", "t_b")


@query("registry_compare", f"""
WITH {PAIRS} SELECT session_prefix, unit, t_a, t_b, CASE WHEN sig_a AND sig_b THEN 'both' WHEN sig_a THEN 'a_only' WHEN sig_b THEN 'b_only' ELSE 'neither' END AS category
FROM pairs WHERE entry_a = 'A_F' AND entry_b = 'R_F'""", "t_a t_b")
def registry_compare(b):
    return registry(b).compare("A_F", "R_F").select("session_prefix", "unit", "t_a", "t_b", "category")


@query("registry_compare_summary", f"""
WITH {PAIRS}, c AS (SELECT * FROM pairs WHERE entry_a = 'A_F' AND entry_b = 'R_F'), r AS (SELECT *, {T.average_rank('t_a', '')} AS ra, {T.average_rank('t_b', '')} AS rb FROM c)
SELECT count(*) AS n, {_corr('ra', 'rb')} AS rho, count(*) FILTER (WHERE sig_a AND sig_b) AS "both", count(*) FILTER (WHERE sig_a AND NOT sig_b) AS a_only,
  count(*) FILTER (WHERE sig_b AND NOT sig_a) AS b_only, count(*) FILTER (WHERE NOT sig_a AND NOT sig_b) AS neither FROM r""", "rho")
def registry_compare_summary(b):
    return registry(b).compare_summary("A_F", "R_F").select("n", "rho", "both", "a_only", "b_only", "neither")


SPEARMAN = f"""
{PAIRS}, sr AS (SELECT *, {T.average_rank('t_a', 'entry_a, entry_b')} AS ra, {T.average_rank('t_b', 'entry_a, entry_b')} AS rb FROM pairs),
sm AS (SELECT entry_a, entry_b, count(*) AS n, {_corr('ra', 'rb')} AS rho FROM sr GROUP BY ALL)"""


@query("registry_screen", f"WITH {SPEARMAN} SELECT entry_b AS entry, n, rho, {T.corr_p('rho', 'n')} AS p, abs(rho) AS abs_rho FROM sm WHERE entry_a = 'A_F'", "rho p abs_rho")
def registry_screen(b):
    return registry(b).screen("A_F")


@query("registry_matrix", f"WITH {SPEARMAN} SELECT *, {T.corr_p('rho', 'n')} AS p FROM sm", "rho p")
def registry_matrix(b):
    return registry(b).matrix()


@query("registry_membership", f"""
WITH {ENTRY}, w AS (SELECT session_prefix, unit, bool_or(sig_fdr) FILTER (WHERE entry = 'A_F') AS "A_F", bool_or(sig_fdr) FILTER (WHERE entry = 'N_O') AS "N_O", bool_or(sig_fdr) FILTER (WHERE entry = 'R_F') AS "R_F" FROM rg GROUP BY ALL)
SELECT "A_F", "N_O", "R_F", count(*) AS n, "A_F"::BIGINT + "N_O"::BIGINT + "R_F"::BIGINT AS degree FROM w WHERE "A_F" IS NOT NULL AND "N_O" IS NOT NULL AND "R_F" IS NOT NULL GROUP BY ALL""")
def registry_membership(b):
    return registry(b).membership(["A_F", "N_O", "R_F"])


@query("combo_counts", """
SELECT p_size > 25 AS large, p_retailprice > 950 AS dear, p_brand < 'Brand#2' AS early, count(*) AS n, (p_size > 25)::BIGINT + (p_retailprice > 950)::BIGINT + (p_brand < 'Brand#2')::BIGINT AS degree
FROM part GROUP BY ALL HAVING count(*) >= 20""")
def combo_counts(b):
    flags = b.table("part").select((F.col("p_size") > 25).alias("large"), (F.col("p_retailprice") > 950).alias("dear"), (F.col("p_brand") < "Brand#2").alias("early"))
    return D.combo_counts(flags, ["large", "dear", "early"], 20, "degree")


@query("registry_set_sizes", f"""
WITH {ENTRY}, w AS (SELECT session_prefix, unit, bool_or(sig_fdr) FILTER (WHERE entry = 'A_F') AS a, bool_or(sig_fdr) FILTER (WHERE entry = 'N_O') AS b, bool_or(sig_fdr) FILTER (WHERE entry = 'R_F') AS c FROM rg GROUP BY ALL),
u AS (SELECT * FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)
SELECT 'A_F' AS entry, count(*) FILTER (WHERE a) AS n FROM u UNION ALL SELECT 'N_O', count(*) FILTER (WHERE b) FROM u UNION ALL SELECT 'R_F', count(*) FILTER (WHERE c) FROM u""")
def registry_set_sizes(b):
    return registry(b).set_sizes(["A_F", "N_O", "R_F"])


@query("registry_summary", f"""
WITH RECURSIVE {ENTRY}, {_wilcoxon('rw', 'rg', 't', 'entry')},
s AS (SELECT entry, count(*) AS n, count(*) FILTER (WHERE sig_fdr) AS n_sig, avg(t) AS mean_t, quantile_cont(t, 0.5) AS median_t, count(*) FILTER (WHERE sig_fdr AND t > 0) AS n_pos_sig,
  count(*) FILTER (WHERE sig_fdr AND t < 0) AS n_neg_sig, count(*) FILTER (WHERE t > 0) AS np, count(*) FILTER (WHERE t < 0) AS nn FROM rg GROUP BY ALL)
SELECT s.entry, s.n, n_sig, mean_t, median_t, n_pos_sig, n_neg_sig, n_sig / s.n::DOUBLE AS frac_sig, CASE WHEN rw.n >= 10 THEN rw.p END AS wilcoxon_p,
  {T.binomial_half_p2('np', 'nn')} AS binomial_p FROM s LEFT JOIN rw USING (entry)""", "mean_t median_t frac_sig wilcoxon_p binomial_p")
def registry_summary(b):
    return registry(b).summary()


@query("top_sig_fraction", f"""
WITH {ENTRY} SELECT entry, count(*) AS n, count(*) FILTER (WHERE sig_fdr) AS n_sig, count(*) FILTER (WHERE sig_fdr) / count(*)::DOUBLE AS frac_sig FROM rg GROUP BY ALL ORDER BY frac_sig DESC, entry LIMIT 3""", "frac_sig")
def top_sig_fraction(b):
    return registry(b).top_fractions(3)

"""Closed-form statistics for every group at once: moments, ranks and tail formulas.

Where small samples would call for exact Mann-Whitney, Wilcoxon or Kolmogorov-Smirnov tables,
these use the asymptotic forms.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import pvalues as P
from tempora.functions.geometry import angle_between, clamp, cross, dot, norm, solve3
from tempora.operators.ordered import join_keys, ordered_scan, quantiles, running, tie_ranks


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r of the complete pairs; null when either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    r = F.covar_pop(x, y) / F.when(spread > 1e-300, spread)
    return clamp(r, -1.0, 1.0)


def corr_to_t(r: Column, n: Column, guarded: bool = True, lost: int = 2) -> Column:
    """t of a correlation with n - lost degrees of freedom; the guarded form is null for n at or
    below `lost` and for |r| of one."""
    t = r * F.sqrt(F.greatest(n - lost, F.lit(0)) / F.greatest(1 - r * r, F.lit(1e-12)))
    return F.when((n > lost) & (F.abs(r) < 0.999999), t) if guarded else t


def corr_p(r: Column, n: Column, lost: int = 2) -> Column:
    t = r * F.sqrt((n - lost) / F.greatest(1 - r * r, F.lit(1e-300)))
    return F.when(n > lost, P.student_p2(F.when(n > lost, t), n - lost))


def fdr_bh(df: DataFrame, keys: Sequence[str], p: str, q: str, width: float | None = None) -> DataFrame:
    """Benjamini-Hochberg `q` over the non-null p-values of each group; null stays null.

    Windows over the group while its result rows fit one task. With `width` the group is cut
    into chunks of -ln p: one descending scan numbers the p-values, the next keeps the smallest
    p * m / i so far; a tied p-value follows the tie's best rank, so ties share its q. Nothing is
    joined on the p-value itself: a recomputed aggregate may differ in its last bit.
    """
    present = F.col(p).isNotNull()
    if width is None:
        whole = Window.partitionBy(*keys)
        upto = F.count(p).over(whole.orderBy(p).rangeBetween(Window.unboundedPreceding, 0))
        placed = df.withColumns({"__i": upto, "__m": F.count(p).over(whole)})
        down = whole.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
        least = F.min(F.when(present, F.col(p) * F.col("__m") / F.col("__i"))).over(down)
        return placed.withColumn(q, F.when(present, F.least(F.lit(1.0), least))).drop("__i", "__m")
    rows = df.where(present).withColumns({"__down": -F.ln(F.greatest(F.col(p), F.lit(1e-300))), "__minus": -F.col(p)})
    ranked = ordered_scan(rows, keys, ["__down", "__minus"], {"__above": running(F.lit(1).cast("bigint"))}, width)
    total = rows.groupBy(*keys).agg(F.count(p).alias("__m"))
    raw = join_keys(ranked, total, list(keys)).withColumn("__raw", F.col(p) * F.col("__m") / (F.col("__m") - F.col("__above") + 1))
    scanned = ordered_scan(raw, keys, ["__down", "__minus", "__above"], {"__q": running(F.col("__raw"), "min")}, width)
    corrected = scanned.select(*df.columns, F.least(F.lit(1.0), F.col("__q")).alias(q))
    return corrected.unionByName(df.where(~present).withColumn(q, F.lit(None).cast("double")))


def ranked_pair(df: DataFrame, on: Sequence[str], x: str, y: str, width: float | None = None, tasks: int | None = None) -> DataFrame:
    """Complete pairs with average ranks `__rx` and `__ry` within the group; groups dealt to `tasks` stay so."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return tie_ranks(tie_ranks(pairs, on, x, "__rx", width, tasks=tasks), on, y, "__ry", width)


def unit_correlations(
    df: DataFrame, on: Sequence[str], x: str, y: str, min_trials: int = 3, alpha: float = 0.05,
    width: float | None = None, p_width: float | None = None, tasks: int | None = None,
) -> DataFrame:
    """Spearman and Pearson r, p, q, flag and t per group; small groups give nulls.

    `width` cuts the ranks of a big group, `p_width` the correction over very many groups, `tasks` deals groups to so many tasks.
    """
    ranked = ranked_pair(df, on, x, y, width, tasks)
    base = ranked.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n_trials"),
        safe_corr(F.col("__rx"), F.col("__ry")).alias("__s"), safe_corr(F.col(x), F.col(y)).alias("__p"),
    )
    enough = F.col("n_trials") >= min_trials
    out = base.withColumns({
        "spearman_rho": F.when(enough, F.col("__s")), "pearson_r": F.when(enough, F.col("__p")),
    }).drop("__s", "__p").withColumns({
        "spearman_p": corr_p(F.col("spearman_rho"), F.col("n_trials")),
        "pearson_p": corr_p(F.col("pearson_r"), F.col("n_trials")),
        "spearman_t": corr_to_t(F.col("spearman_rho"), F.col("n_trials")),
        "pearson_t": corr_to_t(F.col("pearson_r"), F.col("n_trials")),
    })
    for kind in ("spearman", "pearson"):
        out = fdr_bh(out, [], f"{kind}_p", f"{kind}_q", p_width).withColumn(
            f"{kind}_sig_fdr", F.coalesce(F.col(f"{kind}_q") < alpha, F.lit(False))
        )
    return out


def spearman(df: DataFrame, on: Sequence[str], x: str, y: str, min_n: int = 3, width: float | None = None) -> DataFrame:
    """n, rho, p per group; null below `min_n`."""
    grouped = ranked_pair(df, on, x, y, width).groupBy(*on).agg(
        F.count(F.lit(1)).alias("n"), safe_corr(F.col("__rx"), F.col("__ry")).alias("__r")
    )
    return grouped.withColumn("rho", F.when(F.col("n") >= min_n, F.col("__r"))).drop("__r").withColumn(
        "p", corr_p(F.col("rho"), F.col("n"))
    )


def pearson(df: DataFrame, on: Sequence[str], x: str, y: str) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = both.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col(x), F.col(y)).alias("r"))
    return out.withColumn("p", corr_p(F.col("r"), F.col("n")))


def ols_z(df: DataFrame, on: Sequence[str], x: Column, y: str, prefix: str, min_trials: int) -> DataFrame:
    """y ~ 1 + z(x) per group from moments: coef, t, p, n; zero variance gives nulls."""
    rows = df.select(*on, x.alias("__x"), F.col(y).alias("__y")).where(
        F.col("__x").isNotNull() & F.col("__y").isNotNull()
    )
    base = rows.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n"), safe_corr(F.col("__x"), F.col("__y")).alias("r"),
        F.stddev_pop("__y").alias("sd"),
    ).where(F.col("n") >= min_trials)
    t = corr_to_t(F.col("r"), F.col("n"), guarded=False)
    return base.select(
        *on, F.col("n").alias(f"{prefix}_n"), (F.col("r") * F.col("sd")).alias(f"{prefix}_coef"),
        t.alias(f"{prefix}_t"), corr_p(F.col("r"), F.col("n")).alias(f"{prefix}_p"),
    )


def fit_rt_ols(
    df: DataFrame, on: Sequence[str], rt: str, response: str, baseline: str, min_trials: int = 50,
    p_width: float | None = None,
) -> DataFrame:
    """Response and baseline rate against z(log rt) per unit, full outer, each with its q."""
    log_rt = F.ln(F.when(F.col(rt) > 0, F.col(rt)))
    fits = [ols_z(df, on, log_rt, y, name, min_trials) for name, y in (("resp", response), ("base", baseline))]
    fits = [fdr_bh(f, [], f"{n}_p", f"{n}_q", p_width) for f, n in zip(fits, ("resp", "base"))]
    return fits[0].join(fits[1], list(on), "full")


def linregress(df: DataFrame, on: Sequence[str], x: str, y: str) -> DataFrame:
    """slope, intercept, r2, t, p, n of y on x per group."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = both.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("__mx"), F.avg(y).alias("__my"),
        F.var_pop(x).alias("__vx"), F.covar_pop(x, y).alias("__c"), safe_corr(F.col(x), F.col(y)).alias("__r"),
    )
    slope = F.col("__c") / F.when(F.col("__vx") > 0, F.col("__vx"))
    return m.withColumn("slope", slope).select(
        *on, "n", "slope", (F.col("__my") - F.col("slope") * F.col("__mx")).alias("intercept"),
        (F.col("__r") * F.col("__r")).alias("r2"), corr_to_t(F.col("__r"), F.col("n")).alias("t"),
        corr_p(F.col("__r"), F.col("n")).alias("p"),
    )


def regression_band(df: DataFrame, on: Sequence[str], x: str, y: str, n_points: int, alpha: float = 0.05) -> DataFrame:
    """Fitted mean with a pointwise confidence band on an even grid over each group's x range."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = both.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"),
        F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c"), F.min(x).alias("lo"), F.max(x).alias("hi"),
    ).where((F.col("n") > 2) & (F.col("vx") > 0))
    slope = F.col("c") / F.col("vx")
    s2 = F.col("n") * F.greatest(F.col("vy") - slope * F.col("c"), F.lit(0.0)) / (F.col("n") - 2)
    fit = m.withColumns({
        "slope": slope, "s2": s2,
        "tcrit": P.student_quantile(F.lit(alpha), (F.col("n") - 2).cast("double")),
    })
    grid = fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("point")).withColumn(
        "x", F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / (n_points - 1)
    )
    mean = F.col("my") + F.col("slope") * (F.col("x") - F.col("mx"))
    se = F.sqrt(F.col("s2") * (1 / F.col("n") + (F.col("x") - F.col("mx")) ** 2 / (F.col("n") * F.col("vx"))))
    half = F.col("tcrit") * se
    return grid.select(
        *on, F.col("point").cast("bigint").alias("point"), "x", mean.alias("fit"),
        (mean - half).alias("lower"), (mean + half).alias("upper"),
    )


def _tie_term(df: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Sum of t^3 - t over tied values per group."""
    counts = df.groupBy(*on, value).agg(F.count(F.lit(1)).cast("double").alias("__t"))
    return counts.groupBy(*on).agg(F.sum(F.col("__t") ** 3 - F.col("__t")).alias("ties"))


def mann_whitney(df: DataFrame, on: Sequence[str], value: str, group: Column, width: float | None = None, tasks: int | None = None) -> DataFrame:
    """U, two-sided p and mean difference of group true vs false.

    p is exact without ties where a group has at most 8 rows, else normal with corrections for ties and continuity.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("__g", group).where(F.col("__g").isNotNull())
    ranked = tie_ranks(rows, on, value, "__r", width, tasks=tasks)
    sums = ranked.groupBy(*on).agg(
        F.count_if("__g").alias("n1"), F.count_if(~F.col("__g")).alias("n0"),
        F.sum(F.when(F.col("__g"), F.col("__r"))).alias("__s"),
        (F.avg(F.when(F.col("__g"), F.col(value))) - F.avg(F.when(~F.col("__g"), F.col(value)))).alias("mean_diff"),
    )
    joined = sums.join(_tie_term(rows, on, value), list(on)) if on else sums.withColumn("ties", _tie_term(rows, [], value).scalar())
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    both = (n1 > 0) & (n0 > 0)
    u = F.when(both, F.col("__s") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    z = (F.greatest(F.col("u"), n1 * n0 - F.col("u")) - n1 * n0 / 2 - 0.5) / F.nullif(sd, F.lit(0.0))
    normal = clamp(2 * P.normal_sf(z), 0.0, 1.0)
    return joined.withColumn("u", u).withColumn(
        "p", P.rank_sum_p2(F.col("u"), n1, n0, F.col("ties"), normal)
    ).drop("__s", "ties")


def wilcoxon(df: DataFrame, on: Sequence[str], diff: str, min_n: int = 1, width: float | None = None, tasks: int | None = None) -> DataFrame:
    """Signed-rank test of `diff` against zero; zero differences are dropped first.

    p is exact for up to 50 differences where none was zero and no two are equally far from it, else normal.
    """
    present = df.where(F.col(diff).isNotNull())
    rows = present.where(F.col(diff) != 0).withColumn("__a", F.abs(diff))
    ranked = tie_ranks(rows, on, "__a", "__r", width, tasks=tasks)
    sums = ranked.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.when(F.col(diff) > 0, F.col("__r"))), F.lit(0.0)).alias("__w"),
    )
    ties = _tie_term(rows, on, "__a")
    zeros = present.groupBy(*on).agg(F.count_if(F.col(diff) == 0).alias("__zeros"))
    joined = join_keys(join_keys(sums, ties, list(on)), zeros, list(on))
    n = F.col("n").cast("double")
    total = n * (n + 1) / 2
    sd = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    stat = F.least(F.col("__w"), total - F.col("__w"))
    z = (stat - n * (n + 1) / 4) / F.nullif(sd, F.lit(0.0))
    enough = F.col("n") >= min_n
    p = P.signed_rank_p2(stat, n, (F.col("ties") == 0) & (F.col("__zeros") == 0), clamp(P.normal_p2(z), 0.0, 1.0))
    return joined.select(*on, "n", F.when(enough, stat).alias("w"), F.when(enough, p).alias("p"))


def sign_binomial(df: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    base = df.groupBy(*on).agg(
        F.count_if(F.col(value) > 0).alias("n_pos"), F.count_if(F.col(value) < 0).alias("n_neg")
    )
    return base.withColumn("p", P.binomial_half_p2(F.col("n_pos"), F.col("n_neg")))


def fisher_z_meta(df: DataFrame, on: Sequence[str], r: str, n: str) -> DataFrame:
    """Weighted mean correlation over rows with n >= 4, with 95% interval, z and p."""
    w = (F.col(n) - 3).cast("double")
    z = F.atanh(clamp(F.col(r), -0.999999, 0.999999))
    rows = df.where((F.col(n) >= 4) & F.col(r).isNotNull())
    sums = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("k"), F.sum(w).alias("sw"), F.sum(w * z).alias("swz"))
    zbar, se = F.col("swz") / F.col("sw"), 1 / F.sqrt("sw")
    return sums.select(
        *on, "k", F.tanh(zbar).alias("r"), F.tanh(zbar - 1.96 * se).alias("r_lo"),
        F.tanh(zbar + 1.96 * se).alias("r_hi"), (zbar / se).alias("z"), P.normal_p2(zbar / se).alias("p"),
    )


def fisher_overlap(df: DataFrame, on: Sequence[str], a: Column, b: Column) -> DataFrame:
    """2x2 table of two flags with odds ratio and exact p."""
    counts = df.groupBy(*on).agg(
        F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("a_only"),
        F.count_if(~a & b).alias("b_only"), F.count_if(~a & ~b).alias("neither"),
    )
    cells = [F.col(c) for c in ("both", "a_only", "b_only", "neither")]
    odds = (cells[0] * cells[3]).cast("double") / F.nullif(cells[1] * cells[2], F.lit(0))
    return counts.withColumns({"odds_ratio": odds, "p": P.fisher_exact_p2(*cells)})


def ks_against_base(
    df: DataFrame, group: str, base, groups: Sequence, value: str, width: float | None = None,
) -> DataFrame:
    """KS distance of each listed group to the base group; p is exact for up to 10,000 rows a group."""
    rows = df.where(F.col(value).isNotNull())
    others = rows.where(F.col(group).isin(list(groups))).select(
        F.col(group).alias("__k"), value, F.lit(1).alias("__o"), F.lit(0).alias("__b")
    )
    listed = F.explode(F.array(*[F.lit(g).cast(df.schema[group].dataType) for g in groups]))
    bases = rows.where(F.col(group) == base).select(listed.alias("__k"), value, F.lit(0).alias("__o"), F.lit(1).alias("__b"))
    counts = others.unionByName(bases).groupBy("__k", value).agg(F.sum("__o").alias("__o"), F.sum("__b").alias("__b"))
    cum = ordered_scan(counts, ["__k"], [value], {"__co": running(F.col("__o")), "__cb": running(F.col("__b"))}, width)
    total = counts.groupBy("__k").agg(F.sum("__o").alias("n"), F.sum("__b").alias("n_base")).where(
        (F.col("n") >= 2) & (F.col("n_base") >= 2)
    )
    gap = F.abs(F.col("__co") / F.col("n") - F.col("__cb") / F.col("n_base"))
    stats = cum.join(total, "__k").groupBy("__k", "n", "n_base").agg(F.max(gap).alias("ks"))
    return stats.select(F.col("__k").alias(group), "n", "n_base", "ks", P.kolmogorov_p2(F.col("ks"), F.col("n"), F.col("n_base")).alias("p"))


def ks_two_sample(df: DataFrame, on: Sequence[str], value: str, first: Column, width: float | None = None) -> DataFrame:
    """KS distance between the rows where `first` holds and the others, per group with both; p as in `ks_against_base`."""
    rows = df.withColumn("__g", first).where(F.col(value).isNotNull() & F.col("__g").isNotNull())
    counts = rows.groupBy(*on, value).agg(F.count_if("__g").alias("__a"), F.count_if(~F.col("__g")).alias("__b"))
    cum = ordered_scan(counts, on, [value], {"__ca": running(F.col("__a")), "__cb": running(F.col("__b"))}, width)
    total = counts.groupBy(*on).agg(F.sum("__a").alias("n1"), F.sum("__b").alias("n0")).where((F.col("n1") > 0) & (F.col("n0") > 0))
    gap = F.abs(F.col("__ca") / F.col("n1") - F.col("__cb") / F.col("n0"))
    stats = join_keys(cum, total, on).groupBy(*on, "n1", "n0").agg(F.max(gap).alias("ks"))
    return stats.withColumn("p", P.kolmogorov_p2(F.col("ks"), F.col("n1"), F.col("n0")))


def partial_correlation(df: DataFrame, on: Sequence[str], x: str, y: str, z: str, width: float | None = None, tasks: int | None = None) -> DataFrame:
    """Spearman correlation of x and y with z partialled out, n - 3 degrees of freedom.

    A task sorts its rows three times; `tasks` deals the groups to so many tasks.
    """
    ranked = tie_ranks(ranked_pair(df.where(F.col(z).isNotNull()), on, x, y, width, tasks), on, z, "__rz", width)
    r = {a + b: safe_corr(F.col(f"__r{a}"), F.col(f"__r{b}")).alias(a + b) for a, b in ("xy", "xz", "yz")}
    base = ranked.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), *r.values())
    bottom = F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2))
    partial = (F.col("xy") - F.col("xz") * F.col("yz")) / F.when(bottom > 1e-12, bottom)
    return base.withColumn("r", partial).select(
        *on, "n", "r", corr_to_t(F.col("r"), F.col("n"), lost=3).alias("t"), corr_p(F.col("r"), F.col("n"), 3).alias("p")
    )


def confusion_rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Recall, precision, FNR, FDR and F1, zero where the denominator is."""
    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    recall, precision = ratio(tp, tp + fn), ratio(tp, tp + fp)
    return {
        "recall": recall, "precision": precision, "fnr": ratio(fn, tp + fn), "fdr": ratio(fp, tp + fp),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    }


def noise_growth(df: DataFrame, k: str, value: str) -> DataFrame:
    """Spread per k with the line through it."""
    spread = df.where(F.col(value).isNotNull()).groupBy(k).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_latency"), F.stddev_pop(value).alias("std_latency")
    )
    line = linregress(spread, [], k, "std_latency").select(F.struct("slope", "intercept")).scalar()
    return spread.withColumns({"slope": line["slope"], "intercept": line["intercept"]})


def centroid_distance(df: DataFrame, features: Sequence[str], good: Column, name: str = "dist_to_good") -> DataFrame:
    """Distance to the centroid of the good rows after scaling every feature by all rows."""
    whole = df.agg(F.struct(*[
        F.struct(F.avg(f).alias("m"), F.nullif(F.stddev_pop(f), F.lit(0.0)).alias("s"), F.avg(F.when(good, F.col(f))).alias("g")).alias(f)
        for f in features
    ])).scalar()
    total = F.lit(0.0)
    for f in features:
        total = total + ((F.col(f) - whole[f]["g"]) / whole[f]["s"]) ** 2
    return df.withColumn(name, F.sqrt(total))


def impute_scale(df: DataFrame, features: Sequence[str], width: float | None = None) -> DataFrame:
    """Rows with any feature, medians for missing values, then population z-scores."""
    rows = df.dropna("all", subset=list(features))
    filled = rows
    for f in features:
        median = quantiles(rows, [], f, {"m": 0.5}, width).scalar()
        filled = filled.withColumn(f, F.coalesce(F.col(f).cast("double"), median))
    stats = filled.agg(F.struct(*[
        F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f) for f in features
    ])).scalar()
    return filled.withColumns({
        f: (F.col(f) - stats[f]["m"]) / F.when(stats[f]["s"] > 0, stats[f]["s"]).otherwise(1.0) for f in features
    })


def feature_component_corr(df: DataFrame, features: Sequence[str], components: Sequence[str], min_n: int = 100, width: float | None = None) -> DataFrame:
    """Spearman of every feature with every component."""
    long = df.unpivot(list(components), list(features), "feature", "value").unpivot(
        ["feature", "value"], list(components), "component", "score"
    )
    return spearman(long, ["feature", "component"], "value", "score", min_n, width)


def mutual_information(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Histogram estimate (nats) on an even bins x bins grid."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = rows.agg(F.struct(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))).scalar()

    def cell(v: str, lo: Column, hi: Column) -> Column:
        return F.least(F.floor((F.col(v) - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins), F.lit(bins - 1).cast("bigint"))

    cells = rows.select(cell(x, ends["x0"], ends["x1"]).alias("i"), cell(y, ends["y0"], ends["y1"]).alias("j"))
    joint = cells.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    rowsum = joint.groupBy("i").agg(F.sum("n").alias("ni"))
    colsum = joint.groupBy("j").agg(F.sum("n").alias("nj"))
    total = joint.agg(F.sum("n")).scalar()
    full = joint.join(rowsum, "i").join(colsum, "j").withColumn("t", total)
    share = F.col("n") / F.col("t")
    return full.agg(F.sum(share * F.ln(F.col("n") * F.col("t") / (F.col("ni") * F.col("nj")))).alias("mi"), F.sum("n").alias("n"))


def density_curve(df: DataFrame, on: Sequence[str], value: str, lo: float, step: float, n_points: int) -> DataFrame:
    """Gaussian kernel density on a fixed grid with the n^(-1/5) rule.

    The grid is an array of sums in one aggregate: a row is read once and copied for no point, and what is shuffled has
    the size of the grid.
    """
    rows = df.where(F.col(value).isNotNull())
    scale = rows.groupBy(*on).agg(
        (F.stddev_samp(value) * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("h")
    ).where(F.col("h") > 0)
    joined = join_keys(rows, scale, list(on))
    away = [(F.col(value) - F.lit(lo + p * step)) / F.col("h") for p in range(n_points)]
    sums = joined.groupBy(*on, "h").agg(F.count(F.lit(1)).alias("__n"), F.array(*[F.sum(F.exp(-z * z / 2)) for z in away]).alias("__s"))
    spread = sums.select(*on, "h", "__n", F.posexplode("__s").alias("point", "__sum"))
    return spread.select(
        *on, F.col("point").cast("bigint").alias("point"), (F.lit(lo) + F.col("point") * step).alias("x"),
        (F.col("__sum") / (F.col("__n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"),
    )


def qq_pairs(df: DataFrame, on: Sequence[str], value: str, probs: Sequence[float], z: Sequence[float], width: float | None = None) -> DataFrame:
    """Sample quantiles beside the normal quantiles `z` of the same probabilities."""
    names = {f"q{i}": p for i, p in enumerate(probs)}
    table = quantiles(df, on, value, names, width)
    rows = F.array(*[
        F.struct(F.lit(float(p)).alias("prob"), F.lit(float(q)).alias("normal"), F.col(f"q{i}").alias("sample"))
        for i, (p, q) in enumerate(zip(probs, z))
    ])
    return table.select(*on, F.inline(rows))


def projection_correlation(df: DataFrame, coords: Sequence[str], axis: Sequence[float], feature: str, centred: bool = False, width: float | None = None) -> DataFrame:
    """Spearman of the projection on `axis` with `feature`."""
    centre = df.agg(F.struct(*[F.avg(c).alias(c) for c in coords])).scalar() if centred else None
    points = [F.col(c) - centre[c] if centred else F.col(c) for c in coords]
    projected = df.withColumn("__proj", dot(points, [F.lit(float(a)) for a in axis]))
    return spearman(projected, [], "__proj", feature, 3, width)


def linear_axis_sums(weight: Column, coords: Sequence[str], feature: str) -> list[Column]:
    """Weighted sums that determine a regression of the feature on three coordinates."""
    vs = {**{f"x{i}": F.col(c) for i, c in enumerate(coords)}, "y": F.col(feature), "one": F.lit(1.0)}
    names = list(vs)
    return [
        F.sum(weight * vs[a] * vs[b]).alias(f"s_{a}_{b}")
        for i, a in enumerate(names) for b in names[i:]
    ]


def solve_axis() -> dict[str, Column]:
    """b0..b2, unit axis a0..a2 and r2 from `linear_axis_sums`."""
    n = F.col("s_one_one")

    def c(a: str, b: str) -> Column:
        pair = f"s_{a}_{b}" if a <= b or b == "one" or (a.startswith("x") and b == "y") else f"s_{b}_{a}"
        return F.col(pair) - F.col(f"s_{a}_one") * F.col(f"s_{b}_one") / n

    xs = ("x0", "x1", "x2")
    m = [[c(min(a, b), max(a, b)) for b in xs] for a in xs]
    v = [c(a, "y") for a in xs]
    beta = solve3(m, v)
    length = F.nullif(norm(beta), F.lit(0.0))
    out = {f"b{i}": b for i, b in enumerate(beta)}
    out.update({f"a{i}": b / length for i, b in enumerate(beta)})
    out["r2"] = dot(beta, v) / F.nullif(c("y", "y"), F.lit(0.0))
    return out


def linear_trend(df: DataFrame, on: Sequence[str], coords: Sequence[str], feature: str) -> DataFrame:
    """Coefficients, unit axis, R2 and F of feature ~ 1 + x + y + z per group."""
    complete = df.dropna(subset=[*coords, feature])
    sums = complete.groupBy(*on).agg(*linear_axis_sums(F.lit(1.0), coords, feature))
    n = F.col("s_one_one")
    return sums.select(*on, n.cast("bigint").alias("n"), *[c.alias(k) for k, c in solve_axis().items()]).withColumn(
        "f_stat", F.col("r2") / 3 / F.nullif((1 - F.col("r2")) / (F.col("n") - 4), F.lit(0.0))
    )


def compare_directions(replicates: DataFrame) -> DataFrame:
    """Angle, Wald statistic, p and bootstrap p of two directions.

    `replicates` has x0..x2 and y0..y2 per replicate and the observed directions ox0..ox2 and
    oy0..oy2 on every row.
    """
    def unit(v: Sequence[Column]) -> list[Column]:
        size = norm(v)
        return [c / size for c in v]

    def cols(p: str) -> list[Column]:
        return [F.col(f"{p}{i}") for i in range(3)]

    step = replicates.withColumns({f"{p}{i}": u for p in ("ox", "oy", "x", "y") for i, u in enumerate(unit(cols(p)))})
    for p in ("x", "y"):
        flip = F.when(dot(cols(p), cols(f"o{p}")) < 0, -1.0).otherwise(1.0)
        step = step.withColumn("__f", flip).withColumns({f"{p}{i}": F.col(f"{p}{i}") * F.col("__f") for i in range(3)})
    ox, oy = cols("ox"), cols("oy")
    along = dot(oy, ox)
    step = step.withColumns({f"e{i}": oy[i] - along * ox[i] for i in range(3)})
    fallback = [F.when(F.abs(ox[0]) < 0.9, 1.0).otherwise(0.0), F.when(F.abs(ox[0]) < 0.9, 0.0).otherwise(1.0), F.lit(0.0)]
    lean = dot(fallback, ox)
    small = norm(cols("e")) < 1e-12
    step = step.withColumn("__small", small).withColumns({
        f"e{i}": F.when(F.col("__small"), fallback[i] - lean * ox[i]).otherwise(F.col(f"e{i}")) for i in range(3)
    })
    step = step.withColumns({f"u{i}": c for i, c in enumerate(unit(cols("e")))})
    step = step.withColumns({f"w{i}": c for i, c in enumerate(cross(cols("ox"), cols("u")))})
    shift = [F.col(f"y{i}") - F.col(f"x{i}") for i in range(3)]
    flat = step.select(
        dot(shift, cols("u")).alias("d1"), dot(shift, cols("w")).alias("d2"),
        dot(oy, cols("u")).alias("o1"), dot(oy, cols("w")).alias("o2"), angle_between(ox, oy).alias("angle_deg"),
    )
    stats = flat.agg(F.struct(
        F.avg("d1").alias("m1"), F.avg("d2").alias("m2"), (F.var_samp("d1") + 1e-12).alias("v1"),
        (F.var_samp("d2") + 1e-12).alias("v2"), F.covar_samp("d1", "d2").alias("c"),
    )).scalar()
    rows = flat.withColumn("s", stats)

    def wald(a: Column, b: Column) -> Column:
        det = F.col("s.v1") * F.col("s.v2") - F.col("s.c") ** 2
        return (F.col("s.v2") * a * a - 2 * F.col("s.c") * a * b + F.col("s.v1") * b * b) / det

    scored = rows.withColumns({
        "w_obs": wald(F.col("o1"), F.col("o2")),
        "w_null": wald(F.col("d1") - F.col("s.m1"), F.col("d2") - F.col("s.m2")),
    })
    return scored.agg(
        F.first("angle_deg").alias("angle_deg"), F.first("w_obs").alias("w_obs"),
        P.chi2_2_sf(F.first("w_obs")).alias("p_chi2"),
        ((F.count_if(F.col("w_null") >= F.col("w_obs")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_boot"),
        F.count(F.lit(1)).alias("n_boot"),
    )


def azimuth_elevation(v: Sequence[Column]) -> tuple[Column, Column]:
    up = clamp(v[2], -1.0, 1.0)
    return F.degrees(F.atan2(v[1], v[0])), F.degrees(F.asin(up))


def cone_half_angle(replicates: DataFrame, on: Sequence[str], axis: Sequence[Column], v: Sequence[Column], q: float = 0.95, width: float | None = None) -> DataFrame:
    """Quantile of the angles between replicate directions and the axis."""
    angles = replicates.withColumn("__angle", angle_between(v, axis))
    return quantiles(angles, on, "__angle", {"cone_half_angle_deg": q}, width)


def circular_w(df: DataFrame, on: Sequence[str], angle: str, first: Column, width: float | None = None, keep: Mapping[str, Column] | None = None) -> DataFrame:
    """Pooled-rank statistic of two circular samples."""
    turned = df.where(F.col(angle).isNotNull()).withColumn("__a", F.pmod(F.col(angle), F.lit(2 * math.pi))).withColumn("__g", first)
    ranked = tie_ranks(turned, on, "__a", "__r", width)
    n = ranked.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    joined = ranked.join(n, list(on)) if on else ranked.withColumn("__n", n.scalar())
    return circular_from_ranks(joined, on)


def circular_from_ranks(ranked: DataFrame, on: Sequence[str]) -> DataFrame:
    turn = 2 * math.pi * F.col("__r") / F.col("__n")

    def part(which: Column, f) -> Column:
        return F.coalesce(F.sum(F.when(which, f(turn))), F.lit(0.0))

    g = F.col("__g")
    sums = ranked.groupBy(*on).agg(
        F.count_if(g).alias("n1"), F.count_if(~g).alias("n2"), part(g, F.cos).alias("c1"), part(g, F.sin).alias("s1"),
        part(~g, F.cos).alias("c2"), part(~g, F.sin).alias("s2"),
    )
    n1, n2 = F.nullif(F.col("n1"), F.lit(0)), F.nullif(F.col("n2"), F.lit(0))
    w = 2 / (n1 + n2) * ((F.col("c1") ** 2 + F.col("s1") ** 2) / n1 + (F.col("c2") ** 2 + F.col("s2") ** 2) / n2)
    return sums.withColumn("w", F.when((F.col("n1") >= 2) & (F.col("n2") >= 2), w)).drop("c1", "s1", "c2", "s2")

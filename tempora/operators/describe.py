"""Descriptive tables: limits, histograms, binned means, grids, rankings."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.geometry import clamp
from tempora.operators.ordered import join_keys, last_before, numbered, ordered_scan, quantiles, running
from tempora.operators.segment import refractory_filter
from tempora.operators.stats import confusion_rates
from tempora.operators.timejoin import previous_and_next
from tempora.sizing import ROWS_PER_CHUNK


def percentile_limits(df: DataFrame, columns: Sequence[str], lo: float, hi: float, widths: Mapping[str, float] | None = None) -> dict[str, tuple[Column, Column]]:
    """Scalar (low, high) limits per column, as subqueries of the plan that uses them."""
    out = {}
    for c in columns:
        pair = quantiles(df, [], c, {"lo": lo, "hi": hi}, (widths or {}).get(c))
        limits = pair.select(F.struct("lo", "hi")).scalar()
        out[c] = (limits["lo"], limits["hi"])
    return out


def percentile_band(df: DataFrame, columns: Sequence[str], lo: float, hi: float, clip: bool = False, widths: Mapping[str, float] | None = None) -> DataFrame:
    """Rows inside every column's percentile limits, or all rows clipped to them."""
    limits = percentile_limits(df, columns, lo, hi, widths)
    if clip:
        return df.withColumns({c: clamp(F.col(c), a, b) for c, (a, b) in limits.items()})
    for c, (a, b) in limits.items():
        df = df.where(F.col(c).between(a, b))
    return df


def distribution_report(df: DataFrame, column: str, lo: float, hi: float, width: float | None = None) -> DataFrame:
    """Counts shown and excluded by [lo, hi], mean and median of the shown values."""
    present = df.where(F.col(column).isNotNull())
    inside = F.col(column).between(lo, hi)
    shown = present.where(inside)
    median = quantiles(shown, [], column, {"m": 0.5}, width).scalar()
    return present.agg(
        F.count_if(inside).alias("n_shown"), F.count_if(~inside).alias("n_excluded"),
        F.avg(F.when(inside, F.col(column))).alias("mean_shown"),
    ).withColumn("median_shown", median)


def _ends(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    ends = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    if keys:
        return df.join(ends, list(keys))
    both = ends.select(F.struct("__lo", "__hi")).scalar()
    return df.withColumns({"__lo": both["__lo"], "__hi": both["__hi"]})


def binned_mean_sem(df: DataFrame, keys: Sequence[str], x: str, y: str, n_bins: int, closed: str = "right") -> DataFrame:
    """Mean x, mean y and SEM in equal-width bins of x; empty bins are absent.

    `closed='right'` puts edges in the lower bin and widens the first bin to hold the minimum;
    `closed='left'` puts edges in the upper bin and drops the maximum.
    """
    rows = _ends(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, x)
    size = F.nullif((F.col("__hi") - F.col("__lo")) / n_bins, F.lit(0.0))
    place = (F.col(x) - F.col("__lo")) / size
    if closed == "right":
        b = F.greatest(F.lit(0).cast("bigint"), F.ceil(place) - 1)
    else:
        b = F.floor(place)
        rows = rows.where(F.col(x) < F.col("__hi"))
    return rows.groupBy(*keys, F.least(b, F.lit(n_bins - 1).cast("bigint")).alias("bin")).agg(
        F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"),
        (F.stddev_samp(y) / F.sqrt(F.count(F.lit(1)))).alias("y_sem"), F.count(F.lit(1)).alias("n"),
    )


def histogram_density(df: DataFrame, keys: Sequence[str], x: str, edges: Sequence[float]) -> DataFrame:
    """Count and density per bin for given edges, last bin closed, empty bins kept per group.

    The edges are a short driver-side list (even, angular, log or percentile values).
    """
    bins = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("bin"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi"))
        for i, (a, b) in enumerate(zip(edges, edges[1:]))
    ])
    index = F.lit(None).cast("bigint")
    for i, (a, b) in reversed(list(enumerate(zip(edges, edges[1:])))):
        upper = F.col(x) <= b if i == len(edges) - 2 else F.col(x) < b
        index = F.when((F.col(x) >= a) & upper, F.lit(i).cast("bigint")).otherwise(index)
    counts = df.withColumn("bin", index).where(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("__total"))
    grid = totals.select("*", F.inline(bins))
    filled = grid.join(counts, [*keys, "bin"], "left").fillna({"n": 0})
    return filled.withColumn("density", F.col("n") / (F.col("__total") * (F.col("hi") - F.col("lo")))).drop("__total")


def log_edges(lo: float, hi: float, n: int) -> list[float]:
    step = (math.log10(hi) - math.log10(lo)) / n
    return [10 ** (math.log10(lo) + i * step) for i in range(n + 1)]


def angular_edges(n: int) -> list[float]:
    """Equal bins of angles from -pi to pi."""
    return [-math.pi + 2 * math.pi * i / n for i in range(n)] + [math.pi]


def percentile_edges(df: DataFrame, x: str, n: int, width: float | None = None) -> list[float]:
    """Edges of n bins that hold equal shares of all values; equal edges are one."""
    row = quantiles(df, [], x, {f"q{i}": i / n for i in range(n + 1)}, width).first()
    return sorted({v for v in row if v is not None}) if row else []


def latency_by_ordinal(df: DataFrame, session: Sequence[str], k: str, latency: str, max_k: int, width: float | None = None) -> DataFrame:
    """Mean, median, SEM and n per session and ordinal."""
    rows = df.where(F.col(latency).isNotNull() & (F.col(k) <= max_k))
    on = [*session, k]
    medians = quantiles(rows, on, latency, {"median": 0.5}, width)
    return rows.groupBy(*on).agg(
        F.avg(latency).alias("mean"), (F.stddev_samp(latency) / F.sqrt(F.count(F.lit(1)))).alias("sem"),
        F.count(F.lit(1)).alias("n"),
    ).join(medians, on)


def grand_mean(by_session: DataFrame, k: str, value: str = "mean") -> DataFrame:
    return by_session.groupBy(k).agg(
        F.avg(value).alias("grand_mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("grand_sem"),
        F.count(value).alias("n_sessions"),
    )


def exclusion_summary(df: DataFrame, session: Sequence[str], rt: str, lo: float, hi: float) -> DataFrame:
    kept = F.coalesce((F.col(rt) > lo) & (F.col(rt) < hi), F.lit(False))
    return df.groupBy(*session).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_excluded"),
        (100 * F.avg((~kept).cast("int"))).alias("pct_excluded"),
    )


def min_trials_filter(df: DataFrame, session: Sequence[str], trial: str, minimum: int) -> DataFrame:
    """Rows of sessions with at least `minimum` distinct trials."""
    enough = df.groupBy(*session).agg(F.countDistinct(trial).alias("__n")).where(F.col("__n") >= minimum)
    return df.join(enough.select(*session), list(session), "left_semi")


def lognormal_fit(df: DataFrame, session: Sequence[str], rt: str) -> DataFrame:
    rows = df.where(F.col(rt) > 0)
    return rows.groupBy(*session).agg(
        F.avg(F.ln(rt)).alias("ln_mean"), F.stddev_samp(F.ln(rt)).alias("ln_sd"),
        F.avg(rt).alias("normal_mean"), F.stddev_samp(rt).alias("normal_sd"), F.count(F.lit(1)).alias("n"),
    )


#: Rows of both sides that a task of the detector grid gets, whole sessions at a time.
GRID_ROWS = 200_000


def detector_grid(
    candidates: DataFrame, reference: DataFrame, session: Sequence[str], t: str, distance: str,
    radii: Sequence[float], dead_times: Sequence[float], tolerances: Sequence[float],
    width: float | None = None,
) -> DataFrame:
    """Rates per (radius, dead time, tolerance), the whole grid in one plan.

    How far each event is from the nearest of the other side does not depend on the tolerance, so it is found once, and
    tolerances are thresholds on it. Sessions meet in tasks that hold each row once and run all detectors over it; only
    counts per cell leave them. A candidate without a time is none. With `width`, sessions of more than `ROWS_PER_CHUNK` rows go by chunks instead, with radius and dead
    time as key columns of one detector pass.
    """
    radii, dead_times, tolerances = ([float(v) for v in values] for values in (radii, dead_times, tolerances))
    candidates = candidates.where(F.col(t).isNotNull() & ~F.isnan(F.col(t)))
    own = candidates.select(*session, F.col(t).cast("double").alias("__t"), F.col(distance).cast("double").alias("__d"), F.lit(True).alias("__own"))
    other = reference.select(*session, F.col(t).cast("double").alias("__t"), F.lit(None).cast("double").alias("__d"), F.lit(False).alias("__own"))
    rows = own.where(F.col("__d") <= max(radii)).unionByName(other)
    large = None
    if width is not None:
        large = rows.groupBy(*session).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > ROWS_PER_CHUNK).select(*session)
        rows = join_keys(rows, large, session, "left_anti")
    tasks = max(1, -(-rows.count() // GRID_ROWS))
    dealt = rows.withColumn("__task", F.pmod(F.xxhash64(*session), F.lit(tasks)))
    counted = dealt.groupBy("__task").applyInPandas(
        lambda part: _grid_counts(part, list(session), radii, dead_times, tolerances),
        "radius double, dead_time double, __n bigint, __m bigint, __tp array<bigint>, __hits array<bigint>",
    )
    if large is not None:
        counted = counted.unionByName(_grid_counts_by_chunk(
            join_keys(candidates, large, session, "left_semi"), join_keys(reference, large, session, "left_semi"),
            session, t, distance, radii, dead_times, tolerances, width,
        ))

    def summed(name: str) -> Column:
        return F.array(*[F.sum(F.col(name)[i]) for i in range(len(tolerances))]).alias(name)

    cells = counted.groupBy("radius", "dead_time").agg(F.sum("__n").alias("__n"), F.sum("__m").alias("__m"), summed("__tp"), summed("__hits"))
    steps = F.posexplode(F.array(*map(F.lit, tolerances))).alias("__k", "tolerance")
    every = cells.where(F.col("__n") > 0).select("radius", "dead_time", "__n", "__m", "__tp", "__hits", steps)
    tp, hits = F.col("__tp")[F.col("__k")], F.col("__hits")[F.col("__k")]
    out = every.select("radius", "dead_time", tp.alias("tp"), (F.col("__m") - hits).alias("fp"), (F.col("__n") - tp).alias("fn"), "tolerance")
    return out.withColumns(confusion_rates(F.col("tp"), F.col("fp"), F.col("fn")))


def _grid_counts(part, session: list[str], radii: Sequence[float], dead_times: Sequence[float], tolerances: Sequence[float]):
    """Counts of every cell over the whole sessions of a task. Times are complex numbers, session + i * time, whose order is that of both."""
    import numpy as np
    import pandas as pd

    def joined(code, time):
        both = np.empty(len(time), "complex128")
        both.real, both.imag = code, time
        return both

    def nearest(points, others):
        """Distance in time to the nearest of the sorted `others` in the same session."""
        if not len(others):
            return np.full(len(points), np.inf)
        after = np.searchsorted(others, points, side="right")
        before, behind = others[np.maximum(after - 1, 0)], others[np.minimum(after, len(others) - 1)]
        since = np.where((after > 0) & (before.real == points.real), points.imag - before.imag, np.inf)
        until = np.where((after < len(others)) & (behind.real == points.real), behind.imag - points.imag, np.inf)
        return np.minimum(since, until)

    def upto(distances):
        return np.searchsorted(np.sort(distances), tolerances, side="right")

    code = part.groupby(session, dropna=False, sort=False).ngroup().to_numpy()
    time, own, d = part["__t"].to_numpy("float64"), part["__own"].to_numpy("bool"), part["__d"].to_numpy("float64")
    n = int((~own).sum())
    truth = np.sort(joined(code, time)[~own & ~np.isnan(time)])
    found, d = joined(code, time)[own], d[own]
    order = np.argsort(found, kind="stable")
    found, d = found[order], d[order]
    to_truth, out = nearest(found, truth), []
    for radius in radii:
        near = d <= radius
        at, far = found[near], to_truth[near]
        size = len(at)
        starts = np.ones(size, "bool")
        starts[1:] = at.real[1:] != at.real[:-1]
        ends = np.searchsorted(at.real, at.real, side="right")
        for dead_time in dead_times:
            onward = np.searchsorted(at, joined(at.real, at.imag + dead_time), side="right")
            # who is kept is whom the first of a session reaches by 'next after the dead time'; jumps double in length
            jump = np.append(np.where(onward < ends, onward, size), size)
            kept = np.append(starts, False)
            while True:
                reached = jump[np.flatnonzero(kept)]
                if (kept[reached] | (reached == size)).all():
                    break
                kept[reached] = True
                kept[size] = False
                jump = jump[jump]
            kept = kept[:size]
            out.append((radius, dead_time, n, int(kept.sum()), upto(nearest(truth, at[kept])), upto(far[kept])))
    return pd.DataFrame(out, columns=["radius", "dead_time", "__n", "__m", "__tp", "__hits"])


def _grid_counts_by_chunk(
    candidates: DataFrame, reference: DataFrame, session: Sequence[str], t: str, distance: str,
    radii: Sequence[float], dead_times: Sequence[float], tolerances: Sequence[float], width: float,
) -> DataFrame:
    """The counts of `_grid_counts` for sessions too large for a task."""
    def listed(values):
        return F.explode(F.array(*map(F.lit, values)))

    cell = ["radius", "dead_time"]
    on = [*session, *cell]
    near = candidates.select(*session, t, distance, listed(radii).alias("radius")).where(F.col(distance) <= F.col("radius"))
    kept = refractory_filter(near.select(*session, t, "radius", listed(dead_times).alias("dead_time")), on, t, F.col("dead_time"), width=width)
    truth = reference.select(*session, t, listed(radii).alias("radius")).select(*session, t, "radius", listed(dead_times).alias("dead_time"))

    def reach(own: DataFrame, other: DataFrame) -> DataFrame:
        both = previous_and_next(own.select(*on, t), other.select(*on, t), on, t, t, {"__p": "__at"}, {"__n": "__at"}, width)
        return both.select(*cell, F.least(F.col(t) - F.col("__p"), F.col("__n") - F.col(t)).alias("__d"))

    within = F.array(*[F.count_if(F.col("__d") <= F.lit(x)) for x in tolerances])
    none = F.lit(0).cast("bigint")
    found = reach(truth, kept).groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"), none.alias("__m"), within.alias("__tp"), F.array_repeat(none, len(tolerances)).alias("__hits"))
    spurious = reach(kept, truth).groupBy(*cell).agg(none.alias("__n"), F.count(F.lit(1)).alias("__m"), F.array_repeat(none, len(tolerances)).alias("__tp"), within.alias("__hits"))
    return found.unionByName(spurious)


def pivot_mean_argmax(df: DataFrame, row: str, column: str, columns: Sequence, value: str) -> tuple[DataFrame, DataFrame]:
    """Mean of `value` as a row x column table, and the cell with the largest mean."""
    means = df.groupBy(row, column).agg(F.avg(value).alias("mean"))
    best = means.agg(F.max_by(F.struct(row, column, "mean"), F.struct(F.round("mean", 12), -F.col(row), -F.col(column))).alias("b"))
    return means.groupBy(row).pivot(column, list(columns)).agg(F.first("mean")), best.select("b.*")


def bin2d_mean(df: DataFrame, x: str, y: str, value: str, size: float, hexagonal: bool = False) -> DataFrame:
    """Mean value per square or hexagonal cell of the plane."""
    if not hexagonal:
        i, j = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    else:
        # axial coordinates, rounded to the nearest hexagon through cube coordinates
        q = (math.sqrt(3) / 3 * F.col(x) - F.col(y) / 3) / size
        r = (2 / 3 * F.col(y)) / size
        s = -q - r
        rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
        dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
        i = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq).cast("bigint")
        j = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr).cast("bigint")
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(i.alias("cell_i"), j.alias("cell_j")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def combo_counts(flags: DataFrame, columns: Sequence[str], min_size: int = 1, by: str = "cardinality", max_subsets: int | None = None) -> DataFrame:
    """Count and degree of every true/false combination, ordered by count or degree; only the first `max_subsets` if given."""
    degree = sum((F.col(c).cast("bigint") for c in columns[1:]), F.col(columns[0]).cast("bigint"))
    out = flags.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).withColumn("degree", degree).where(F.col("n") >= min_size)
    first = F.desc("n") if by == "cardinality" else F.asc("degree")
    out = out.orderBy(first, *[F.desc(c) for c in columns])
    return out if max_subsets is None else out.limit(max_subsets)


def set_sizes(flags: DataFrame, columns: Sequence[str]) -> DataFrame:
    totals = flags.agg(*[F.count_if(c).alias(c) for c in columns])
    return totals.unpivot([], list(columns), "entry", "n")


def significant_fraction(stats: DataFrame, entry: str, flag: str) -> DataFrame:
    return stats.groupBy(entry).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("n_sig"),
    ).withColumn("frac_sig", F.col("n_sig") / F.col("n"))


def nearest_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], probs: Mapping[str, float], width: float | None = None) -> DataFrame:
    """The rows at position round-half-even(p * (n - 1)) for each labelled p."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    labels = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(float(p)).alias("p")) for k, p in probs.items()])
    wanted = n.select(*keys, "__n", F.inline(labels)).select(
        *keys, "label", F.rint(F.col("p") * (F.col("__n") - 1)).cast("bigint").alias("__i")
    )
    return numbered(df, keys, order, "__i", width).join(wanted, [*keys, "__i"]).drop("__i")


def describe_values(df: DataFrame, keys: Sequence[str], column: str, lo: float, hi: float, width: float | None = None) -> DataFrame:
    """count, mean, std, min, max, median, p10, p90 and the share inside [lo, hi]."""
    base = df.where(F.col(column).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max"),
        F.avg(F.col(column).between(lo, hi).cast("int")).alias("frac_inside"),
    )
    q = quantiles(df, keys, column, {"p10": 0.1, "median": 0.5, "p90": 0.9}, width)
    if keys:
        return base.join(q, list(keys))
    s = q.select(F.struct("p10", "median", "p90")).scalar()
    return base.withColumns({c: s[c] for c in ("p10", "median", "p90")})


def session_min_events(df: DataFrame, session: Sequence[str], kind: str, kinds: Sequence[str], minimum: int) -> DataFrame:
    """Sessions with more than `minimum` events of every listed kind, with the counts."""
    counts = df.groupBy(*session).agg(*[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds])
    for k in kinds:
        counts = counts.where(F.col(f"n_{k}") > minimum)
    return counts


def sorted_rows(df: DataFrame, by: Sequence[tuple[str, bool]], tie_break: Sequence[str]) -> DataFrame:
    """Multi-key sort, nulls last, with an explicit tie-break in place of input order."""
    order = [F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in by]
    return df.orderBy(*order, *tie_break)


def top_n(df: DataFrame, by: Column, n: int, tie_break: Sequence[str]) -> DataFrame:
    return df.orderBy(by, *tie_break).limit(n)


def pick_examples(df: DataFrame, rho: str, mode: str, n: int, tie_break: Sequence[str], seed: int = 0) -> DataFrame:
    """n units by top_abs, top_pos, top_neg or a seeded random order."""
    by = {
        "top_abs": F.desc(F.abs(rho)), "top_pos": F.desc(rho), "top_neg": F.asc(rho),
        "random": F.asc(F.xxhash64(F.lit(seed), *tie_break)),
    }[mode]
    return top_n(df.where(F.col(rho).isNotNull()), by, n, tie_break)


def top_bottom(df: DataFrame, keys: Sequence[str], by: Sequence[str], tie_break: Sequence[str], n: int) -> DataFrame:
    """n best and n worst rows per group; both ranks are row_number limits, which Spark cuts
    down to n rows per group before the shuffle."""
    from pyspark.sql import Window

    def side(desc: bool, label: str) -> DataFrame:
        order = [(F.desc(c) if desc else F.asc(c)) for c in by]
        part = Window.partitionBy(*keys).orderBy(*order, *tie_break)
        return df.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= n).withColumn("side", F.lit(label))

    return side(True, "best").unionByName(side(False, "worst"))


def keep_one(df: DataFrame, on: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """First or last row per key in a stated order, as one partial aggregate; a null comes after all values either way."""
    rest = [c for c in df.columns if c not in on]
    pick = F.max if last else F.min
    place = [F.struct((F.col(c).isNotNull() if last else F.col(c).isNull()).alias("n"), F.col(c).alias("v")).alias(f"__o{i}") for i, c in enumerate(order)]
    rest_of = [c for c in rest if c not in order]
    ties = F.struct(*[F.col(c) for c in rest_of]) if rest_of else F.struct(F.lit(0))
    packed = df.groupBy(*on).agg(pick(F.struct(*place, ties.alias("__ties"))).alias("__r"))
    values = {c: F.col(f"__r.__o{i}.v") for i, c in enumerate(order)} | {c: F.col(f"__r.__ties.{c}") for c in rest_of}
    return packed.select(*on, *[values[c].alias(c) for c in rest])


def pareto_front(df: DataFrame, objectives: Sequence[tuple[str, bool]], row_id: str, width: float | None = None) -> DataFrame:
    """Rows no other row dominates: at least as good everywhere and better somewhere.

    Objectives are (column, maximise). Equal rows never dominate each other, so the work is on
    distinct objective vectors. Two objectives are one ordered scan with a running maximum; more
    are thinned per partition and then checked in broadcast slices.
    """
    signs = [F.col(c).cast("double") * (1 if up else -1) for c, up in objectives]
    names = [f"__o{i}" for i in range(len(signs))]
    rows = df.withColumns(dict(zip(names, signs))).dropna(subset=names)
    vectors = rows.select(*names).distinct()
    if len(names) == 2:
        best = vectors.groupBy(names[0]).agg(F.max(names[1]).alias("__y"))
        down = -F.col(names[0])
        cum = ordered_scan(best, [], [down], {"__m": running(F.col("__y"), "max")}, width)
        above = ordered_scan(cum, [], [down], {"__above": last_before(F.col("__m"))}, width)
        front = above.where(F.col("__above").isNull() | (F.col("__above") < F.col("__y"))).select(
            names[0], F.col("__y").alias(names[1])
        )
    else:
        front = _thin_fronts(vectors, names)
    return rows.join(front, names, "left_semi").drop(*names)


BROADCAST_ROWS = 50_000


def _thin_fronts(vectors: DataFrame, names: Sequence[str]) -> DataFrame:
    """Skyline of distinct vectors: each partition drops what its own rows dominate, then the
    survivors are checked against themselves one broadcast slice of bounded size at a time."""
    import numpy as np
    import pandas as pd

    from tempora.session import scratch_root

    def thin(batches):
        kept = np.empty((0, len(names)))
        for batch in batches:
            rows = batch[list(names)].to_numpy(dtype=float)
            # in descending order of the sum a vector can only be dominated by earlier ones
            for row in rows[np.argsort(-rows.sum(axis=1), kind="stable")]:
                if not ((kept >= row).all(axis=1) & (kept > row).any(axis=1)).any():
                    worse = (row >= kept).all(axis=1) & (row > kept).any(axis=1)
                    kept = np.vstack([kept[~worse], row])
        yield pd.DataFrame(kept, columns=list(names))

    scratch_root(vectors.sparkSession)
    local = vectors.mapInPandas(thin, ", ".join(f"`{n}` double" for n in names)).checkpoint()
    slices = -(-local.count() // BROADCAST_ROWS)
    front = local
    for i in range(slices):
        part = local.where(F.pmod(F.xxhash64(*names), F.lit(slices)) == i).toDF(*[f"{n}_b" for n in names])
        pairs = [(F.col(f"{n}_b"), F.col(n)) for n in names]
        covers, beats = F.lit(True), F.lit(False)
        for b, a in pairs:
            covers, beats = covers & (b >= a), beats | (b > a)
        front = front.join(F.broadcast(part), covers & beats, "left_anti")
    return front


def score_rank(df: DataFrame, score: Column, n: int, tie_break: Sequence[str]) -> DataFrame:
    return df.withColumn("score", score).orderBy(F.desc("score"), *tie_break).limit(n)


def sample_rows(df: DataFrame, n: int, row_id: Sequence[str], seed: int) -> DataFrame:
    """n rows in a seeded hash order: stable over reruns and lost executors, unlike rand()."""
    return df.orderBy(F.xxhash64(F.lit(seed), *row_id), *row_id).limit(n)


def first_group_over(df: DataFrame, keys: Sequence[str], group: str, minimum: int) -> DataFrame:
    """Smallest group id with more than `minimum` rows."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(*keys, group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.where(F.col("n") > minimum).groupBy(*keys).agg(F.min(group).alias(group))

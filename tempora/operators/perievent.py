"""Spikes around events: counts, rasters, PETHs, z-scores, tuning and decoding by bin.

Spikes stay one row each. Arrays of a whole unit's spikes would put the busiest unit in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.operators.ordered import (
    last_known, next_known, numbered, ordered_scan, quantiles, tie_ranks,
)
from tempora.operators.timejoin import peri_event, window_stats


def units_by_trials(units: DataFrame, trials: DataFrame, session: Sequence[str]) -> DataFrame:
    """One row per unit and trial of its session: the grain of the result tables."""
    return trials.join(units, list(session))


def unit_trial_counts(
    spikes: DataFrame, units: DataFrame, trials: DataFrame, session: Sequence[str], unit: str,
    t: str, align: str, response: tuple[float, float], baseline: tuple[float, float],
    width: float | None = None,
) -> DataFrame:
    """Counts, rates, delta and first-spike latency per unit and trial; `trials` may carry any
    trial features along."""
    grid = units_by_trials(units.select(*session, unit), trials.where(F.col(align).isNotNull()), session)
    counted = window_stats(
        spikes, grid, [*session, unit], t, align, {"resp": response, "base": baseline}, width
    )
    resp_s, base_s = response[1] - response[0], baseline[1] - baseline[0]
    return counted.withColumnsRenamed({
        "n_resp": "spike_count", "n_base": "baseline_spike_count", "first_resp": "first_spike_latency_s",
    }).withColumns({
        "spike_rate_hz": F.col("spike_count") / resp_s,
        "baseline_rate_hz": F.col("baseline_spike_count") / base_s,
        "delta_hz": F.col("spike_count") / resp_s - F.col("baseline_spike_count") / base_s,
        "had_spike": F.col("spike_count") > 0,
    }).drop("first_base")


def raster(
    spikes: DataFrame, events: DataFrame, session: Sequence[str], t: str, event_t: str,
    pre: float, post: float, tie_break: Sequence[str] = (), width: float | None = None,
) -> DataFrame:
    """Relative spike times in [-pre, post]; events are numbered in time order."""
    trials = numbered(events, session, [event_t, *tie_break], "event_index", width)
    return peri_event(spikes, trials, session, t, event_t, -pre, post)


def bin_grid(lo: float, bin_width: float, n_bins: int) -> Column:
    """Array of (bin, bin_start) for a fixed number of bins."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_bins - 1)),
        lambda i: F.struct(i.cast("bigint").alias("bin"), (F.lit(lo) + i * F.lit(bin_width)).alias("bin_start")),
    )


def peth(
    spikes: DataFrame, units: DataFrame, events: DataFrame, session: Sequence[str], unit: str,
    t: str, event_t: str, lo: float, bin_width: float, n_bins: int, by: Sequence[str] = (),
) -> DataFrame:
    """Mean rate per unit, class and bin; empty bins are zeros, the last bin is closed.

    Pairs are reduced to bin counts before the shuffle by unit; a unit whose session has no
    events of a class has no rows.
    """
    hi = lo + bin_width * n_bins
    rel = peri_event(spikes, events.select(*session, *by, event_t), session, t, event_t, lo, hi)
    place = F.least(F.floor((F.col("rel") - lo) / bin_width), F.lit(n_bins - 1).cast("bigint"))
    counts = rel.groupBy(*session, unit, *by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    n_events = events.groupBy(*session, *by).agg(F.count(F.lit(1)).alias("n_events"))
    grid = units.select(*session, unit).join(n_events, list(session)).select(
        "*", F.inline(bin_grid(lo, bin_width, n_bins))
    )
    filled = grid.join(counts, [*session, unit, *by, "bin"], "left").fillna({"n": 0})
    return filled.withColumn("rate", F.col("n") / (F.col("n_events") * bin_width)).drop("n", "n_events")


def session_rate_stats(
    spikes: DataFrame, on: Sequence[str], t: str, bin_width: float, spikes_from: DataFrame | None = None,
) -> DataFrame:
    """Mean and population sd of the binned rate from first to last spike, empty bins included.

    Only occupied bins are counted; the empty ones enter through the number of bins.
    """
    ends = spikes.groupBy(*on).agg(F.min(t).alias("__t0"), F.max(t).alias("__t1"), F.count(F.lit(1)).alias("__n"))
    n_bins = F.greatest(F.ceil((F.col("__t1") - F.col("__t0")) / bin_width), F.lit(1).cast("bigint"))
    ends = ends.withColumn("n_bins", n_bins).where(F.col("__n") >= 2)
    place = F.least(F.floor((F.col(t) - F.col("__t0")) / bin_width), F.col("n_bins") - 1)
    counts = spikes.join(ends, list(on)).groupBy(*on, "n_bins", place.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    sums = counts.groupBy(*on, "n_bins").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("ss"))
    mean = F.col("s") / F.col("n_bins")
    var = F.col("ss") / F.col("n_bins") - mean * mean
    return sums.select(
        *on, "n_bins", (mean / bin_width).alias("rate_mean"),
        (F.sqrt(F.greatest(var, F.lit(0.0))) / bin_width).alias("rate_sd"),
    )


def zscore_peth(
    rates: DataFrame, on: Sequence[str], baseline: Column, session_stats: DataFrame | None = None,
    stats_on: Sequence[str] = (),
) -> DataFrame:
    """`z` of each bin against its unit's baseline bins, or against session-wide statistics.

    A zero sd gives null.
    """
    if session_stats is None:
        stats = rates.groupBy(*on).agg(
            F.avg(F.when(baseline, F.col("rate"))).alias("rate_mean"),
            F.stddev_pop(F.when(baseline, F.col("rate"))).alias("rate_sd"),
        )
        stats_on = on
    else:
        stats = session_stats.select(*stats_on, "rate_mean", "rate_sd")
    joined = rates.join(stats, list(stats_on), "left")
    sd = F.when(F.col("rate_sd") > 1e-12, F.col("rate_sd"))
    return joined.withColumn("z", (F.col("rate") - F.col("rate_mean")) / sd).drop("rate_mean", "rate_sd")


def centre_on_first_bins(rates: DataFrame, on: Sequence[str], n_first: int = 5) -> DataFrame:
    base = rates.groupBy(*on).agg(F.avg(F.when(F.col("bin") < n_first, F.col("rate"))).alias("__b"))
    return rates.join(base, list(on)).withColumn("centred", F.col("rate") - F.col("__b")).drop("__b")


def signed_peak(z: DataFrame, on: Sequence[str], after: Column, width: float | None = None) -> DataFrame:
    """Largest deviation by magnitude after the event (positive wins a tie, to nine digits);
    units with a null bin are dropped. `peak_rank` orders them, largest first."""
    hi, lo = F.max(F.when(after, F.col("z"))), F.min(F.when(after, F.col("z")))
    peaks = z.groupBy(*on).agg(
        F.when(F.round(F.abs(hi), 9) >= F.round(F.abs(lo), 9), hi).otherwise(lo).alias("signed_peak"),
        F.bool_and(F.col("z").isNotNull()).alias("__full"),
    ).where("__full").drop("__full")
    back = peaks.withColumn("__o", -F.round("signed_peak", 9))
    return numbered(back, [], ["__o", *on], "peak_rank", width, start=1).drop("__o")


def mean_sem(values: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    n = F.count(value)
    return values.groupBy(*on).agg(
        F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(n)).alias("sem"), n.alias("n")
    )


def bout_counts(
    spikes: DataFrame, units: DataFrame, events: DataFrame, session: Sequence[str], unit: str,
    t: str, event_t: str, response: tuple[float, float], baseline: tuple[float, float],
    width: float | None = None,
) -> DataFrame:
    """Baseline, response and delta rate per unit and classified event."""
    grid = units_by_trials(units.select(*session, unit), events, session)
    counted = window_stats(spikes, grid, [*session, unit], t, event_t, {"r": response, "b": baseline}, width)
    return counted.withColumns({
        "baseline_rate_hz": F.col("n_b") / (baseline[1] - baseline[0]),
        "spike_rate_hz": F.col("n_r") / (response[1] - response[0]),
    }).withColumn("delta_hz", F.col("spike_rate_hz") - F.col("baseline_rate_hz")).drop(
        "n_b", "n_r", "first_b", "first_r"
    )


def paired_unit_means(counts: DataFrame, on: Sequence[str], classes: Sequence[str], value: str = "delta_hz") -> DataFrame:
    """Mean per unit and class side by side, units with every class only."""
    return counts.groupBy(*on).pivot("class", list(classes)).agg(F.avg(value)).dropna(subset=list(classes))


def auc_by_bin(
    scores: DataFrame, on: Sequence[str], score: str, label: str, min_rows: int = 3,
    width: float | None = None,
) -> DataFrame:
    """ROC-AUC of `score` for the 0/1 `label` per group from average ranks; null below
    `min_rows` or with one class."""
    present = scores.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    ranked = tie_ranks(present, on, score, "__r", width)
    n1, n = F.sum(F.col(label).cast("bigint")), F.count(F.lit(1))
    sums = ranked.groupBy(*on).agg(
        n1.alias("n1"), (n - n1).alias("n0"), F.sum(F.when(F.col(label) == 1, F.col("__r"))).alias("__s")
    )
    usable = (F.col("n1") > 0) & (F.col("n0") > 0) & (F.col("n1") + F.col("n0") >= min_rows)
    auc = (F.col("__s") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))
    return sums.withColumn("auc", F.when(usable, auc)).drop("__s")


def best_bin(aucs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Bin with the AUC farthest from chance (the earliest on ties)."""
    far = F.round(F.abs(F.col("auc") - 0.5), 12)
    return aucs.where(F.col("auc").isNotNull()).groupBy(*on).agg(
        F.max_by(F.struct("bin", "auc"), F.struct(far, -F.col("bin"))).alias("b")
    ).select(*on, F.col("b.bin").alias("best_bin"), F.col("b.auc").alias("best_auc"))


def rate_by_category(
    counts: DataFrame, on: Sequence[str], category: str, min_trials: int = 3, swapped_gates: bool = False,
) -> DataFrame:
    """Mean baseline and response rate for category 0 and 1, each needing `min_trials` of its own
    trials; `swapped_gates` checks the other category instead."""
    def n(c: int) -> Column:
        return F.count_if(F.col(category) == c)

    def mean(c: int, value: str) -> Column:
        gate = n(1 - c if swapped_gates else c) >= min_trials
        return F.when(gate, F.avg(F.when(F.col(category) == c, F.col(value))))

    return counts.groupBy(*on).agg(*[
        mean(c, v).alias(f"mean_{c}_{v}") for c in (0, 1) for v in ("baseline_rate_hz", "spike_rate_hz")
    ])


def bin_edges(
    rows: DataFrame, keys: Sequence[str], value: str, n_bins: int, how: str = "equal",
    width: float | None = None,
) -> DataFrame:
    """(keys, bin, lo, hi) with equal, zero-split or quantile edges."""
    if how == "quantile":
        names = {f"__e{i}": i / n_bins for i in range(n_bins + 1)}
        edges = quantiles(rows, keys, value, names, width).select(*keys, F.array(*names).alias("__e"))
    else:
        ends = rows.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
        even = F.transform(
            F.sequence(F.lit(0), F.lit(n_bins)),
            lambda i: F.col("__lo") + i * (F.col("__hi") - F.col("__lo")) / n_bins,
        )
        if how == "equal" or n_bins % 2:
            chosen = even
        else:
            half = n_bins // 2
            split = F.transform(
                F.sequence(F.lit(0), F.lit(n_bins)),
                lambda i: F.when(i <= half, F.col("__lo") * (1 - i / half)).otherwise(F.col("__hi") * (i - half) / half),
            )
            chosen = F.when((F.col("__lo") < 0) & (F.col("__hi") > 0), split).otherwise(even)
        edges = ends.select(*keys, chosen.alias("__e"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.lit(n_bins - 1)),
        lambda i: F.struct(
            i.cast("bigint").alias("bin"), F.element_at("__e", i + 1).alias("lo"), F.element_at("__e", i + 2).alias("hi")
        ),
    )
    return edges.select(*keys, pairs.alias("bins"))


def in_bins(rows: DataFrame, edges: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows with the half-open bin that holds `value`; the maximum and beyond have none."""
    joined = rows.join(edges, list(keys)) if keys else rows.withColumn("bins", edges.scalar())
    hit = F.filter("bins", lambda b: (F.col(value) >= b["lo"]) & (F.col(value) < b["hi"]))
    return joined.withColumn("bin", F.get(hit, F.lit(0))["bin"]).drop("bins").where(F.col("bin").isNotNull())


def tuning_curve(
    rows: DataFrame, keys: Sequence[str], variable: str, rate: str, n_bins: int, how: str = "equal",
    width: float | None = None,
) -> DataFrame:
    """Mean variable, mean rate and z of the rate means per bin of `variable`."""
    edges = bin_edges(rows.where(F.col(variable).isNotNull()), keys, variable, n_bins, how, width)
    means = in_bins(rows, edges, keys, variable).groupBy(*keys, "bin").agg(
        F.avg(variable).alias("variable_mean"), F.avg(rate).alias("rate_mean"), F.count(F.lit(1)).alias("n")
    )
    stats = means.groupBy(*keys).agg(F.avg("rate_mean").alias("__m"), F.stddev_pop("rate_mean").alias("__s"))
    sd = F.when(F.col("__s") > 1e-12, F.col("__s"))
    return means.join(stats, list(keys)).withColumn("rate_z", (F.col("rate_mean") - F.col("__m")) / sd).drop("__m", "__s")


def reverse_tuning_curve(
    rows: DataFrame, keys: Sequence[str], variable: str, rate: str, n_bins: int, how: str = "equal",
    width: float | None = None,
) -> DataFrame:
    """Bins of the rate with the mean variable as a z of all trials and the z of the rate means."""
    whole = rows.groupBy(*keys).agg(F.avg(variable).alias("__vm"), F.stddev_pop(variable).alias("__vs"))
    curve = tuning_curve(rows, keys, rate, variable, n_bins, how, width).join(whole, list(keys))
    stats = curve.groupBy(*keys).agg(F.avg("variable_mean").alias("__m"), F.stddev_pop("variable_mean").alias("__s"))
    def guarded(c: str) -> Column:
        return F.when(F.col(c) > 1e-12, F.col(c))
    return curve.join(stats, list(keys)).select(
        *keys, "bin", "n",
        ((F.col("rate_mean") - F.col("__vm")) / guarded("__vs")).alias("variable_z"),
        ((F.col("variable_mean") - F.col("__m")) / guarded("__s")).alias("rate_z"),
    )


def kernel_spike_matrix(
    spikes: DataFrame, units: DataFrame, events: DataFrame, session: Sequence[str], unit: str,
    event_id: str, t: str, event_t: str, pre: float, step: float, n_bins: int, rise: float,
    decay: float, horizon: float, next_event_t: str | None = None,
) -> DataFrame:
    """Causal kernel rate per unit, event and sliding bin.

    A spike adds (1 - exp(-d/rise)) exp(-d/decay) to the bins 0 <= d <= horizon after it, scaled
    to unit area. With `next_event_t`, bins at or past the next event are null.
    """
    area = decay - rise * decay / (rise + decay)
    pairs = peri_event(spikes, events.select(*session, event_id, event_t), session, t, event_t,
                       pre - horizon, pre + step * (n_bins - 1))
    first = F.greatest(F.ceil((F.col("rel") - pre) / step), F.lit(0).cast("bigint"))
    last = F.least(F.floor((F.col("rel") + horizon - pre) / step), F.lit(n_bins - 1).cast("bigint"))
    touched = pairs.withColumns({"__a": first, "__b": last}).where(F.col("__a") <= F.col("__b")).withColumn(
        "bin", F.explode(F.sequence("__a", "__b"))
    )
    d = F.col("bin") * step + pre - F.col("rel")
    weight = (1 - F.exp(-d / rise)) * F.exp(-d / decay) / area
    rates = touched.groupBy(*session, unit, event_id, "bin").agg(F.sum(weight).alias("rate"))
    grid = units.select(*session, unit).join(events, list(session)).select(
        *session, unit, event_id, event_t, *([next_event_t] if next_event_t else []),
        F.inline(bin_grid(pre, step, n_bins)),
    )
    filled = grid.join(rates, [*session, unit, event_id, "bin"], "left").fillna({"rate": 0.0})
    if next_event_t:
        clear = F.col(next_event_t).isNull() | (F.col(event_t) + F.col("bin_start") < F.col(next_event_t))
        filled = filled.withColumn("rate", F.when(clear, F.col("rate")))
    return filled.select(*session, unit, event_id, "bin", "bin_start", "rate")


def shared_traces(
    frames: DataFrame, on: Sequence[str], t: str, value: str, step: float, n_points: int,
    anchor: str = "start", width: float | None = None,
) -> DataFrame:
    """Each movement's `value` interpolated on a common grid from its start, or from its peak xv.

    Outside the movement's own span the value is null. Movements with fewer than two samples, or
    shorter than one step, are left out.
    """
    rows = frames.where(F.col(t).isNotNull() & F.col(value).isNotNull())
    zero = F.min(t) if anchor == "start" else F.max_by(t, F.struct("xv", -F.col(t)))
    spans = rows.groupBy(*on).agg(
        zero.alias("__t0"), F.max(t).alias("__t1"), F.min(t).alias("__ts"), F.count(F.lit(1)).alias("__n")
    ).where((F.col("__n") >= 2) & (F.col("__t1") - F.col("__ts") >= step))
    grid = spans.select(
        *on, F.inline(F.transform(
            F.sequence(F.lit(0), F.lit(n_points - 1)),
            lambda i: F.struct(i.cast("bigint").alias("point"), (F.col("__t0") + i * F.lit(step)).alias("__t")),
        ))
    )
    sample = F.struct(F.col(t).cast("double").alias("t"), F.col(value).alias("v"))
    both = rows.select(*on, F.col(t).cast("double").alias("__t"), sample.alias("__s")).unionByName(
        grid, allowMissingColumns=True
    )
    near = ordered_scan(both, on, ["__t", F.col("point").isNotNull()], {"__p": last_known(F.col("__s")), "__x": next_known(F.col("__s"))}, width)
    # a sample at the grid time itself sorts before it and is the previous sample
    p, x = F.col("__p"), F.col("__x")
    exact = F.when(p["t"] == F.col("__t"), p["v"])
    line = p["v"] + (x["v"] - p["v"]) * (F.col("__t") - p["t"]) / F.nullif(x["t"] - p["t"], F.lit(0.0))
    return near.where(F.col("point").isNotNull()).select(*on, "point", F.coalesce(exact, line).alias("value"))

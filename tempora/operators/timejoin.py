"""Joins on time: as-of, nearest within tolerance, interval containment, counts in windows.

As-of joins and window counts are one ordered scan over the union of both sides: linear, one
shuffle, no pairs. Only joins whose result is the pairs themselves (peri-event slices) use an
equi join on time buckets, where a bucket is never wider than the window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.operators.ordered import (
    last_before, last_known, next_after, next_known, ordered_scan, running,
)

LEFT, RIGHT = "__left", "__right"


def _stack(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_t: str, right_t: str,
    payload: Sequence[str],
) -> DataFrame:
    """Both sides on one time axis `__t`: left rows with their own columns, so that unused ones
    are pruned down to the scan, and right rows with their payload as a struct."""
    stamp = F.col(right_t).cast("double")
    rows = left.select("*", F.col(left_t).cast("double").alias("__t"), F.lit(True).alias(LEFT))
    facts = right.where(stamp.isNotNull()).select(
        *keys, stamp.alias("__t"), F.struct(stamp.alias("__at"), *payload).alias(RIGHT)
    )
    return rows.unionByName(facts, allowMissingColumns=True)


def _unstack(scanned: DataFrame, left: DataFrame, names: Mapping[str, tuple[str, str]]) -> DataFrame:
    rows = scanned.where(F.col(LEFT).isNotNull())
    return rows.select(*left.columns, *[F.col(c)[f].alias(n) for n, (c, f) in names.items()])


def asof_backward(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_t: str, right_t: str,
    take: Mapping[str, str], width: float | None = None,
) -> DataFrame:
    """Each left row with the values of the last right row at or before it (null if none).

    `take` maps output name to right column; the right time itself is `__at`.
    """
    payload = sorted({c for c in take.values() if c != "__at"})
    both = _stack(left, right, keys, left_t, right_t, payload)
    order = ["__t", F.col(LEFT).isNotNull()]
    scanned = ordered_scan(both, keys, order, {"__prev": last_known(F.col(RIGHT))}, width)
    return _unstack(scanned, left, {n: ("__prev", c) for n, c in take.items()})


def asof_forward(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_t: str, right_t: str,
    take: Mapping[str, str], width: float | None = None,
) -> DataFrame:
    """Each left row with the values of the first right row at or after it."""
    payload = sorted({c for c in take.values() if c != "__at"})
    both = _stack(left, right, keys, left_t, right_t, payload)
    order = ["__t", F.col(LEFT).isNull()]
    scanned = ordered_scan(both, keys, order, {"__next": next_known(F.col(RIGHT))}, width)
    return _unstack(scanned, left, {n: ("__next", c) for n, c in take.items()})


def previous_and_next(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_t: str, right_t: str,
    previous: Mapping[str, str], following: Mapping[str, str], width: float | None = None,
) -> DataFrame:
    """Last right row at or before and first right row strictly after, in one scan."""
    payload = sorted({c for c in (*previous.values(), *following.values()) if c != "__at"})
    both = _stack(left, right, keys, left_t, right_t, payload)
    scanned = ordered_scan(
        both, keys, ["__t", F.col(LEFT).isNotNull()],
        {"__prev": last_known(F.col(RIGHT)), "__next": next_after(F.col(RIGHT))}, width,
    )
    names = {n: ("__prev", c) for n, c in previous.items()}
    names.update({n: ("__next", c) for n, c in following.items()})
    return _unstack(scanned, left, names)


def event_trial_index(
    events: DataFrame, cues: DataFrame, keys: Sequence[str], t: str, cue_t: str, trial: str,
    width: float | None = None,
) -> DataFrame:
    """Trial of each event, -1 before the first cue."""
    out = asof_backward(events, cues, keys, t, cue_t, {trial: trial}, width)
    return out.withColumn(trial, F.coalesce(F.col(trial), F.lit(-1).cast("bigint")))


#: An interval touches at most 2^NODE_BITS + 1 nodes.
NODE_BITS = 5


def _cell(x: str, bucket: float) -> Column:
    """The cell of a time; infinite and very far times share the outermost cells."""
    return F.floor(F.greatest(F.lit(-(2.0**61)), F.least(F.lit(2.0**61), F.col(x).cast("double") / F.lit(bucket)))).cast("bigint")


def _levelled(intervals: DataFrame, lo: str, hi: str, bucket: float) -> DataFrame:
    span = F.length(F.bin(_cell(hi, bucket) - _cell(lo, bucket)))
    return intervals.where(F.col(lo) <= F.col(hi)).withColumn("__level", F.greatest(F.lit(0), span - F.lit(NODE_BITS)))


def listed_intervals(intervals: DataFrame, lo: str, hi: str, bucket: float) -> DataFrame:
    """Intervals under every node they touch at the level (`__level`, `__node`) where those are at most 2^NODE_BITS + 1."""
    return _levelled(intervals, lo, hi, bucket).withColumn("__node", F.explode(F.sequence(_shifted(_cell(lo, bucket)), _shifted(_cell(hi, bucket)))))


def _shifted(cell: Column) -> Column:
    """The node of a cell at the row's level; below 0 too it holds the cells from its start on."""
    return F.call_function("shiftright", cell, F.col("__level"))


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], t: str, lo: str, hi: str,
    bucket: float, closed: str = "both",
) -> DataFrame:
    """All (point, interval) pairs with the point inside the interval.

    Equi join on (keys, level, node). The axis is cut into cells of `bucket`, and cells into nodes of 2^level cells. An interval
    is listed at the one level where it touches at most 33 nodes, so the longest costs no more rows than that and a
    candidate pair is a pair in nearly all cases. A point is listed once for every level that some interval is at. A busy
    key is spread over its nodes. `closed` is both, left, right or none. Ends may be infinite; an interval
    with a null end, or that ends before it starts, holds nothing. Column names other than `keys` must differ between the sides.
    """
    spread = listed_intervals(intervals, lo, hi, bucket)
    levels = _levelled(intervals, lo, hi, bucket).agg(F.collect_set("__level")).scalar()
    placed = points.where(F.col(t).isNotNull()).withColumn("__level", F.explode(levels)).withColumn("__node", _shifted(_cell(t, bucket)))
    after = F.col(t) >= F.col(lo) if closed in ("both", "left") else F.col(t) > F.col(lo)
    before = F.col(t) <= F.col(hi) if closed in ("both", "right") else F.col(t) < F.col(hi)
    return placed.join(spread, [*keys, "__level", "__node"]).where(after & before).drop("__level", "__node")


def nearest_within(
    events: DataFrame, frames: DataFrame, keys: Sequence[str], event_id: str, event_t: str,
    frame_t: str, tolerance: float, take: Sequence[str], width: float | None = None,
) -> DataFrame:
    """(keys, event_id, dt, *take) of the nearest frame with |dt| <= tolerance; the earliest
    frame wins a tie. Events without a frame in reach are absent.

    Only the frames next to an event on either side can be nearest, so one as-of scan finds them: no pairs are made.
    """
    once = frames.where(F.col(frame_t).isNotNull()).groupBy(*keys, F.col(frame_t).alias("__ft")).agg(F.min(F.struct(*take)).alias("__f"))
    own = events.select(*keys, event_id, F.col(event_t).alias("__e"))
    near = previous_and_next(
        own, once, keys, "__e", "__ft", {"__pt": "__at", "__pf": "__f"}, {"__nt": "__at", "__nf": "__f"}, width
    )

    def candidate(at: str, frame: str) -> Column:
        dt = F.abs(F.col(at) - F.col("__e"))
        return F.when(dt <= tolerance, F.struct(dt.alias("dt"), F.col(at).alias("at"), F.col(frame).alias("f")))

    best = near.withColumn("__best", F.least(candidate("__pt", "__pf"), candidate("__nt", "__nf"))).where(F.col("__best").isNotNull())
    best = best.groupBy(*keys, event_id).agg(F.min("__best").alias("__best"))
    return best.select(*keys, event_id, F.col("__best.dt").alias("dt"), *[F.col("__best.f")[c].alias(c) for c in take])


def mark_licked_frames(
    frames: DataFrame, licks: DataFrame, keys: Sequence[str], frame: str, frame_t: str,
    lick_index: str, lick_t: str, tolerance: float, width: float | None = None,
) -> DataFrame:
    """Frames with `lick` and `lick_index`; where two licks pick one frame the later one wins."""
    hits = nearest_within(licks, frames, keys, lick_index, lick_t, frame_t, tolerance, [frame], width)
    per_frame = hits.groupBy(*keys, frame).agg(F.max(lick_index).alias(lick_index))
    marked = frames.join(per_frame, [*keys, frame], "left")
    return marked.withColumn("lick", F.col(lick_index).isNotNull())


def movement_of_lick(
    licks: DataFrame, frames: DataFrame, keys: Sequence[str], lick_index: str, frame_t: str,
    movement: str,
) -> DataFrame:
    """Licks with `nearest_movement_id`: the movement of the first matched frame that has one."""
    owned = frames.where(F.col(lick_index).isNotNull() & F.col(movement).isNotNull())
    first = owned.groupBy(*keys, lick_index).agg(
        F.min_by(movement, frame_t).alias("nearest_movement_id")
    )
    return licks.join(first, [*keys, lick_index], "left")


def containing_movement(
    licks: DataFrame, movements: DataFrame, keys: Sequence[str], lick_index: str, lick_t: str,
    movement: str, start: str, end: str, bucket: float,
) -> DataFrame:
    """Licks with the first movement whose closed span holds the lick."""
    spans = movements.select(*keys, movement, F.col(start).alias("__s"), F.col(end).alias("__e"))
    hits = interval_join(
        licks.select(*keys, lick_index, F.col(lick_t).alias("__t")), spans, keys, "__t", "__s", "__e", bucket
    ).groupBy(*keys, lick_index).agg(F.min(movement).alias(movement))
    return licks.join(hits, [*keys, lick_index], "left")


def null_if_spans(
    spans: DataFrame, cues: DataFrame, keys: Sequence[str], start: str, end: str, cue_t: str,
    column: str, width: float | None = None,
) -> DataFrame:
    """`column` nulled on rows with a cue strictly inside (start, end).

    The first cue after the start decides, so this is one forward scan, not a range join.
    """
    marks = cues.select(*keys, F.col(cue_t).alias("__cue"))
    both = _stack(spans, marks, keys, start, "__cue", [])
    scanned = ordered_scan(
        both, keys, ["__t", F.col(LEFT).isNotNull()], {"__next": next_after(F.col(RIGHT))}, width
    )
    rows = _unstack(scanned, spans, {"__after": ("__next", "__at")})
    spanning = F.coalesce(F.col("__after") < F.col(end), F.lit(False))
    return rows.withColumn(column, F.when(~spanning, F.col(column))).drop("__after")


def window_stats(
    points: DataFrame, events: DataFrame, keys: Sequence[str], t: str, event_t: str,
    windows: Mapping[str, tuple[float | Column, float | Column]], width: float | None = None,
) -> DataFrame:
    """Per event and half-open window [t0+a, t0+b): `n_<w>` points and `first_<w>` latency.

    Each window adds two marks to the time axis; a count is the difference of the running
    number of points at its marks and the latency comes from the first point after the lower
    one. Cost is points + marks, whatever the window length. Events with a null bound count 0.
    Equal events are counted once and returned as often as they came.
    """
    bound = {
        (w, side): F.col(event_t) + (b if isinstance(b, Column) else F.lit(float(b)))
        for w, pair in windows.items() for side, b in zip("ab", pair)
    }
    whole = events.groupBy(*events.columns).agg(F.count(F.lit(1)).alias("__copies"))
    marks = whole.withColumn("__event", F.struct(*events.columns, "__copies")).select(
        *keys, "__event",
        F.explode(F.array(*[
            F.struct(F.lit(w).alias("__w"), F.lit(s).alias("__s"), e.cast("double").alias("at"))
            for (w, s), e in bound.items()
        ])).alias("__mark"),
    ).select(*keys, "__event", "__mark.__w", "__mark.__s", F.col("__mark.at").alias("__t"))
    dots = points.where(F.col(t).isNotNull()).select(
        *keys, F.col(t).cast("double").alias("__t"), F.lit(1).cast("bigint").alias("__one")
    )
    both = marks.unionByName(dots, allowMissingColumns=True)
    scanned = ordered_scan(
        both, keys, ["__t", F.col("__one")],
        {
            "__seen": running(F.coalesce(F.col("__one"), F.lit(0).cast("bigint"))),
            "__first": next_known(F.when(F.col("__one").isNotNull(), F.col("__t"))),
        },
        width,
    ).where(F.col("__event").isNotNull())

    def at(w: str, side: str, value: Column) -> Column:
        usable = (F.col("__w") == w) & (F.col("__s") == side) & F.col("__t").isNotNull()
        return F.max(F.when(usable, value))

    picks = []
    for w in windows:
        picks += [
            at(w, "a", F.col("__seen")).alias(f"__{w}_a"), at(w, "b", F.col("__seen")).alias(f"__{w}_b"),
            at(w, "a", F.col("__first")).alias(f"__{w}_f"), at(w, "b", F.col("__t")).alias(f"__{w}_e"),
        ]
    grouped = scanned.groupBy("__event").agg(*picks)
    out = []
    for w in windows:
        zero = F.lit(0).cast("bigint")
        n = F.greatest(F.coalesce(F.col(f"__{w}_b") - F.col(f"__{w}_a"), zero), zero)
        first = F.when(F.col(f"__{w}_f") < F.col(f"__{w}_e"), F.col(f"__{w}_f") - F.col(f"__event.{event_t}"))
        out += [n.alias(f"n_{w}"), first.alias(f"first_{w}")]
    rows = grouped.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__event.__copies"))))
    return rows.select("__event.*", *out).drop("__copies")


def peri_event(
    points: DataFrame, events: DataFrame, keys: Sequence[str], t: str, event_t: str,
    lo: float, hi: float, closed: str = "both",
) -> DataFrame:
    """Points around each event with `rel` = t - t0 in [lo, hi] (the pairs are the result)."""
    around = events.withColumns({
        "__lo": F.col(event_t) + F.lit(float(lo)), "__hi": F.col(event_t) + F.lit(float(hi)),
    })
    pairs = interval_join(points, around, keys, t, "__lo", "__hi", bucket=float(hi - lo), closed=closed)
    return pairs.withColumn("rel", F.col(t) - F.col(event_t)).drop("__lo", "__hi")


def events_per_trial(
    events: DataFrame, cues: DataFrame, keys: Sequence[str], t: str, cue_t: str, trial: str,
    lead_in: float = 0.0, width: float | None = None,
) -> DataFrame:
    """Events tagged with the trial whose [cue - lead_in, next cue - lead_in) holds them; the
    last trial is open-ended. One row per event: gather per trial only for display."""
    shifted = cues.withColumn("__from", F.col(cue_t) - F.lit(lead_in)).drop(t)
    return asof_backward(events, shifted, keys, t, "__from", {trial: trial, cue_t: cue_t}, width).where(
        F.col(trial).isNotNull()
    )


def first_event_times(
    trials: DataFrame, licks: DataFrame, rewards: DataFrame, keys: Sequence[str], t: str,
    lick_lead_in: float = 0.005, width: float | None = None,
) -> DataFrame:
    """Trials with choice and reward times, reward type, earned and extra reward.

    `trials` has trial, cue, response_duration, rewarded_left/right; `rewards` may carry a
    `reward_type` (earned, manual, auto). Slow unrewarded choices are nulled.
    """
    on = [*keys, "trial"]
    cues = trials.select(*keys, "trial", "cue")
    choice = events_per_trial(licks.select(*keys, t), cues, keys, t, "cue", "trial", lick_lead_in, width)
    reward = events_per_trial(rewards, cues, keys, t, "cue", "trial", 0.0, width)
    firsts = choice.groupBy(*on).agg(F.min(t).alias("choice_time")).join(
        reward.groupBy(*on).agg(
            F.min(t).alias("reward_time"), F.min_by("reward_type", t).alias("reward_type")
        ), on, "full",
    )
    typed = rewards.groupBy(*keys).agg(F.bool_or(F.col("reward_type") == "earned").alias("__typed"))
    joined = trials.join(firsts, on, "left").join(typed, list(keys), "left")
    earned = F.coalesce(F.col("rewarded_left"), F.lit(False)) | F.coalesce(F.col("rewarded_right"), F.lit(False))
    annotated = F.coalesce(F.col("reward_type").isin("manual", "auto"), F.lit(False))
    legacy = ~earned & F.col("reward_time").isNotNull()
    slow = (F.col("choice_time") - F.col("cue") > F.col("response_duration") + 0.005) & ~earned
    return joined.withColumns({
        "earned_reward": earned,
        "extra_reward": F.when(F.coalesce(F.col("__typed"), F.lit(False)), annotated).otherwise(legacy),
        "choice_time": F.when(~F.coalesce(slow, F.lit(False)), F.col("choice_time")),
    }).drop("__typed")


def interruption_flags(
    trials: DataFrame, rewards: DataFrame, keys: Sequence[str], reward_t: str, side: str,
    bucket: float,
) -> DataFrame:
    """Trials with `interruption`: a reward before choice plus delay, or one on a side that the
    trial did not earn, within (cue, outcome + delay + 0.1]."""
    spans = trials.withColumns({
        "__lo": F.col("cue"), "__hi": F.col("reward_outcome_time") + F.col("reward_delay") + 0.1,
    })
    hits = interval_join(
        rewards.select(*keys, F.col(reward_t).alias("__t"), F.col(side).alias("__side")),
        spans, keys, "__t", "__lo", "__hi", bucket, closed="right",
    )
    early = F.col("__t") - F.col("cue") < F.col("reward_outcome_time") - F.col("cue") + F.col("reward_delay")
    unearned = ((F.col("__side") == "R") & ~F.col("rewarded_right")) | (
        (F.col("__side") == "L") & ~F.col("rewarded_left")
    )
    flags = hits.groupBy(*keys, "trial").agg(F.bool_or(early | unearned).alias("interruption"))
    return trials.join(flags, [*keys, "trial"], "left").withColumn(
        "interruption", F.coalesce(F.col("interruption"), F.lit(False))
    )


def match_events(
    detected: DataFrame, reference: DataFrame, keys: Sequence[str], t: str, tolerance: float,
    width: float | None = None,
) -> DataFrame:
    """Status of every event: reference events are TP or FN, detected events without a
    reference in reach are FP (any match within the closed tolerance counts)."""
    def status(own: DataFrame, other: DataFrame, hit: str, miss: str) -> DataFrame:
        near = previous_and_next(
            own.select(*keys, t), other.select(*keys, t), keys, t, t, {"__p": "__at"}, {"__n": "__at"}, width
        )
        close = F.least(F.col(t) - F.col("__p"), F.col("__n") - F.col(t)) <= tolerance
        return near.select(
            *keys, t, F.when(F.coalesce(close, F.lit(False)), hit).otherwise(miss).alias("status")
        )

    found = status(reference, detected, "TP", "FN")
    spurious = status(detected, reference, "match", "FP").where(F.col("status") == "FP")
    return found.unionByName(spurious)


def ordinal_join(
    trials: DataFrame, latents: DataFrame, keys: Sequence[str], trial: str, responding: Column,
    series: Mapping[str, Column], width: float | None = None,
) -> DataFrame:
    """k-th responding trial with the k-th element of each latent series.

    `series` gives one array column of `latents` per output name. Other trials get nulls.
    """
    from tempora.operators.ordered import numbered

    ranked = numbered(trials.where(responding).select(*keys, trial), keys, [trial], "__k", width)
    # numbered() counts rows, so an absent response leaves no hole in k
    elements = latents.select(*keys, F.posexplode(F.arrays_zip(*[a.alias(n) for n, a in series.items()]))).select(
        *keys, F.col("pos").cast("bigint").alias("__k"), *[F.col(f"col.{n}").alias(n) for n in series]
    )
    values = ranked.join(elements, [*keys, "__k"], "left").drop("__k")
    return trials.join(values, [*keys, trial], "left")


def interval_cut(
    rows: DataFrame, cuts: DataFrame, on: Sequence[str], t: str, lo: str, hi: str,
) -> DataFrame:
    """Rows inside the optional closed [lo, hi] of their unit; a null bound or no cut is open."""
    joined = rows.join(cuts.select(*on, lo, hi), list(on), "left")
    inside = (F.col(lo).isNull() | (F.col(t) >= F.col(lo))) & (F.col(hi).isNull() | (F.col(t) <= F.col(hi)))
    return joined.where(inside).drop(lo, hi)

"""Movement and trial tables from frames, licks and trials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.geometry import angle_deg
from tempora.operators.ordered import last_before, numbered, ordered_scan
from tempora.operators.timejoin import null_if_spans


def movement_metrics(frames: DataFrame, on: Sequence[str], t: str) -> DataFrame:
    """Extremes, duration and speeds of each movement in one partial aggregate."""
    extremes = [f(c).alias(f"{n}_{c}") for c in ("x", "y", "xv", "yv") for n, f in (("min", F.min), ("max", F.max))]
    return frames.groupBy(*on).agg(
        F.min(t).alias("start_time"), F.max(t).alias("end_time"),
        (F.max(t) - F.min(t)).alias("duration"), *extremes,
        F.max("v").alias("peak_velocity"), F.avg("v").alias("mean_velocity"),
        F.count(F.lit(1)).alias("n_datapoints"),
        F.count_if(F.col("x").isNull()).alias("dropped_frames_n"),
        (100 * F.avg(F.col("x").isNull().cast("int"))).alias("dropped_frames_pct"),
    )


def path_length(frames: DataFrame, on: Sequence[str], t: str, name: str = "total_distance", width: float | None = None) -> DataFrame:
    """Summed distance between successive valid points; null below two points."""
    valid = frames.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    point = F.struct("x", "y")
    near = ordered_scan(valid, on, [t], {"__p": last_before(point)}, width)
    step = F.hypot(F.col("x") - F.col("__p.x"), F.col("y") - F.col("__p.y"))
    return near.groupBy(*on).agg(F.when(F.count(F.lit(1)) >= 2, F.sum(step)).alias(name))


def excursion(frames: DataFrame, jaw: DataFrame, keys: Sequence[str], movement: str, t: str) -> DataFrame:
    """Farthest point of each movement from the mean jaw position of its session.

    `jaw` has one row per session and joins by its own keys. Ties go to the earliest frame;
    movements without a valid point are absent.
    """
    centre = jaw.groupBy(*keys).agg(F.avg("x").alias("__jx"), F.avg("y").alias("__jy"))
    valid = frames.where(F.col("x").isNotNull() & F.col("y").isNotNull()).join(centre, list(keys))
    dx, dy = F.col("x") - F.col("__jx"), F.col("y") - F.col("__jy")
    dist = F.hypot(dx, dy)
    placed = valid.withColumns({"__dx": dx, "__dy": dy, "__d": dist, "__at": -F.col(t)})
    here = F.struct("x", "y", F.col("__dx").alias("dx"), F.col("__dy").alias("dy"), F.col("__d").alias("d"), F.col(t).alias("t"))

    def farthest(by: Column, alias: str) -> Column:
        return F.max_by(here, F.struct(by, F.col("__at"))).alias(alias)

    best = placed.groupBy(*keys, movement).agg(
        farthest(F.col("__d"), "e"), farthest(F.abs("__dx"), "ex"), farthest(F.abs("__dy"), "ey"),
        F.min(t).alias("__t0"), F.min_by(F.struct("x", "y"), t).alias("s"),
        F.max_by(F.struct("x", "y"), t).alias("z"),
    )
    return best.select(
        *keys, movement,
        F.col("s.x").alias("startpoint_x"), F.col("s.y").alias("startpoint_y"),
        F.col("e.x").alias("endpoint_x"), F.col("e.y").alias("endpoint_y"),
        F.col("e.d").alias("max_distance"), angle_deg(F.col("e.dx"), F.col("e.dy")).alias("excursion_angle_deg"),
        F.col("ex.x").alias("max_x_from_jaw"), F.abs("ex.dx").alias("max_x_distance"),
        F.col("ey.y").alias("max_y_from_jaw"), F.abs("ey.dy").alias("max_y_distance"),
        (F.col("e.t") - F.col("__t0")).alias("time_to_endpoint"),
    )


def movement_lick_info(frames: DataFrame, on: Sequence[str]) -> DataFrame:
    return frames.groupBy(*on).agg(
        F.coalesce(F.bool_or("lick"), F.lit(False)).alias("has_lick"),
        F.min("lick_index").alias("first_lick_index"),
        F.countDistinct("lick_index").alias("lick_count"),
    )


def first_trial(frames: DataFrame, on: Sequence[str], t: str) -> DataFrame:
    """Trial of the first frame that has one."""
    return frames.groupBy(*on).agg(
        F.min_by("trial", F.when(F.col("trial").isNotNull(), F.col(t))).alias("trial")
    )


def outbound_metrics(
    frames: DataFrame, jaw: DataFrame, keys: Sequence[str], movement: str, t: str,
    width: float | None = None,
) -> DataFrame:
    """Duration, distance and speeds up to and including the farthest frame.

    Movements without a valid point keep a row of nulls; the distance is null when the farthest
    frame is the first.
    """
    on = [*keys, movement]
    ends = excursion(frames, jaw, keys, movement, t)
    valid = frames.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    first = valid.groupBy(*on).agg(F.min(t).alias("__t0"))
    span = first.join(ends.select(*on, "time_to_endpoint"), on)
    out = valid.join(span, on).where(F.col(t) <= F.col("__t0") + F.col("time_to_endpoint") + 1e-9)
    stats = out.groupBy(*on).agg(
        (F.max(t) - F.min(t)).alias("out_duration"), F.max("v").alias("out_peak_velocity"),
        F.avg("v").alias("out_mean_velocity"),
    )
    distance = path_length(out, on, t, "out_distance", width)
    return frames.select(*on).distinct().join(stats, on, "left").join(distance, on, "left")


def lick_metadata(movements: DataFrame, licks: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Movements with columns of their first lick; null booleans become false."""
    side = licks.select(*keys, F.col("lick_index").alias("first_lick_index"), *columns)
    joined = movements.join(side, [*keys, "first_lick_index"], "left")
    flags = [f.name for f in side.schema.fields if f.dataType.typeName() == "boolean"]
    return joined.fillna(False, subset=flags) if flags else joined


def movement_timing(
    movements: DataFrame, trials: DataFrame, keys: Sequence[str], width: float | None = None,
) -> DataFrame:
    """Movements numbered and timed within their trial.

    A movement strictly over a go cue loses its trial; rows without one get nulls. `movements`
    has movement_id, start_time, end_time, trial, cue_response, lick_time; `trials` trial, cue.
    """
    on = [*keys, "trial"]
    cleared = null_if_spans(movements, trials, keys, "start_time", "end_time", "cue", "trial", width)
    inside = cleared.where(F.col("trial").isNotNull()).join(trials.select(*on, "cue"), on, "left")
    counted = numbered(inside, on, ["start_time", "movement_id"], "movement_number_in_trial", width, start=1)
    responding = F.coalesce(F.col("cue_response"), F.lit(False))
    per_trial = counted.where(responding).groupBy(*on).agg(
        F.max("movement_number_in_trial").alias("cue_response_movement_number"),
        F.min_by(F.col("lick_time") - F.col("cue"), "movement_number_in_trial").alias("lick_latency"),
    )
    timed = counted.join(per_trial, on, "left").withColumns({
        "movement_before_cue_response":
            F.col("movement_number_in_trial") < F.col("cue_response_movement_number"),
        "movement_latency_from_go":
            F.when(F.col("start_time") >= F.col("cue"), F.col("start_time") - F.col("cue")),
    })
    return timed.unionByName(cleared.where(F.col("trial").isNull()), allowMissingColumns=True)


def trial_features(movements: DataFrame, on: Sequence[str], kinematics: Sequence[str]) -> DataFrame:
    """Reaction times and first-move / cue-response kinematics, one aggregate per trial."""
    responding = F.coalesce(F.col("cue_response"), F.lit(False))
    number = F.col("movement_number_in_trial")

    def of(which: Column, column: str) -> Column:
        return F.min_by(F.col(column), F.when(which, number))

    pulls = [of(number == 1, c).alias(f"first_move_{c}") for c in kinematics]
    pulls += [of(responding, c).alias(f"cue_response_{c}") for c in kinematics]
    return movements.where(F.col("trial").isNotNull()).groupBy(*on).agg(
        F.max("cue_response_movement_number").alias("cue_response_movement_number"),
        F.min("movement_latency_from_go").alias("reaction_time_firstmove"),
        F.min_by("movement_latency_from_go", F.when(responding & F.col("movement_latency_from_go").isNotNull(), number)).alias("reaction_time_cueresponse"),
        *pulls,
    )


def trial_level(
    trials: DataFrame, licks: DataFrame, keys: Sequence[str], early: float,
) -> DataFrame:
    """Licks per trial, percent with a movement, licks in [cue, cue + early); zeros filled.

    `licks` carries its trial and nearest_movement_id.
    """
    on = [*keys, "trial"]
    joined = licks.where(F.col("trial").isNotNull()).join(trials.select(*on, "cue"), on)
    counts = joined.groupBy(*on).agg(
        F.count(F.lit(1)).alias("lick_count"),
        (100 * F.avg(F.col("nearest_movement_id").isNotNull().cast("int"))).alias("coverage_pct"),
        F.count_if((F.col("t") >= F.col("cue")) & (F.col("t") < F.col("cue") + early)).alias("early_licks"),
    )
    return trials.select(*on, "cue").join(counts, on, "left").fillna(
        {"lick_count": 0, "early_licks": 0, "coverage_pct": 0.0}
    )


def session_coverage(trial_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lick-weighted coverage and totals."""
    total = F.sum("lick_count")
    return trial_table.groupBy(*keys).agg(
        total.alias("total_licks"),
        F.round(F.sum(F.col("coverage_pct") * F.col("lick_count")) / 100).cast("bigint").alias("licks_with_movement"),
        (F.sum(F.col("coverage_pct") * F.col("lick_count")) / F.nullif(total, F.lit(0))).alias("coverage_pct"),
    )


def session_stats(trials: DataFrame, keys: Sequence[str], none_value: int = 2) -> DataFrame:
    """Trial totals and rates; `trials` has animal_response, rewarded_left, rewarded_right."""
    answered = F.coalesce(F.col("animal_response") != none_value, F.lit(False))
    base = trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trials"), F.count_if(answered).alias("finished_trials"),
        (F.count_if("rewarded_left") + F.count_if("rewarded_right")).alias("reward_trials"),
    )
    total, finished = F.col("total_trials"), F.col("finished_trials")
    return base.withColumns({
        "ignored_trials": total - finished, "finished_rate": finished / total,
        "ignore_rate": (total - finished) / total,
        "reward_rate": F.try_divide(F.col("reward_trials"), finished),
    })


def session_modes(trials: DataFrame, keys: Sequence[str], columns: Sequence[str], none: str = "none") -> DataFrame:
    """Most frequent value of each column (smallest on ties, 'none' as null) and whether the
    session has one combination of them only."""
    long = trials.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), "column", "value"
    ).where(F.col("value").isNotNull())
    counts = long.groupBy(*keys, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(*keys, "column").agg(F.max("n").alias("n"))
    modes = counts.join(top, [*keys, "column", "n"]).groupBy(*keys).pivot("column", list(columns)).agg(F.min("value"))
    modes = modes.withColumns({c: F.nullif(F.col(c), F.lit(none)) for c in columns})
    whole = trials.groupBy(*keys).agg(
        (F.countDistinct(F.struct(*columns)) == 1).alias("consistent_within_session")
    )
    return whole.join(modes, list(keys), "left")


def prelick_features(movements: DataFrame, on: Sequence[str]) -> DataFrame:
    """Summary of the movements before the cue response, per trial."""
    return movements.where("movement_before_cue_response").groupBy(*on).agg(
        F.avg("excursion_angle_deg").alias("mean_angle"),
        F.max_by("excursion_angle_deg", "movement_number_in_trial").alias("last_angle"),
        F.avg("duration").alias("mean_duration"), F.avg("total_distance").alias("mean_distance"),
        F.avg("peak_velocity").alias("mean_peak"), F.max("peak_velocity").alias("max_peak"),
        F.count(F.lit(1)).alias("n_movements"),
    )


def prelick_count_share(movements: DataFrame, keys: Sequence[str], cap: int = 4) -> DataFrame:
    """Share of response trials by number of earlier movements (0 kept, `cap` and over merged),
    plus the fraction with any."""
    on = [*keys, "trial"]
    per_trial = movements.where(F.col("trial").isNotNull()).groupBy(*on).agg(
        F.coalesce(F.bool_or("cue_response"), F.lit(False)).alias("__valid"),
        F.count_if("movement_before_cue_response").alias("__n"),
    ).where("__valid")
    counts = per_trial.groupBy(F.least(F.col("__n"), F.lit(cap)).alias("n_before")).agg(
        F.count(F.lit(1)).alias("n_trials")
    )
    total = counts.agg(F.sum("n_trials")).scalar()
    some = counts.agg(F.coalesce(F.sum(F.when(F.col("n_before") > 0, F.col("n_trials"))), F.lit(0))).scalar()
    return counts.select(
        "n_before", "n_trials", (F.col("n_trials") / total).alias("share"),
        (some / total).alias("fraction_with_any"),
    )


def last_prelick(movements: DataFrame, on: Sequence[str], columns: Sequence[str], directions: Sequence[str]) -> DataFrame:
    """Last known value of each column among the movements before the response, with the event
    of the response; each column skips its own nulls."""
    number = F.col("movement_number_in_trial")
    rows = movements.where(F.col("trial").isNotNull())
    last = rows.where("movement_before_cue_response").groupBy(*on).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), number)).alias(c) for c in columns
    ])
    event = rows.where("cue_response").groupBy(*on).agg(F.min_by("event", number).alias("cue_lick_direction"))
    return last.join(event, list(on)).where(F.col("cue_lick_direction").isin(*directions))


def movement_profile(frames: DataFrame, on: Sequence[str], t: str, width: float | None = None) -> DataFrame:
    """Time to peak xv, whether the peak is the first frame, the first two speeds, and the time
    of the first licked frame."""
    ranked = numbered(frames, on, [t], "__n", width, start=1)
    back = -F.col(t)
    first_lick = F.when(F.coalesce(F.col("lick"), F.lit(False)), F.col(t))
    return ranked.groupBy(*on).agg(
        (F.max_by(t, F.when(F.col("xv").isNotNull(), F.struct("xv", back.alias("b")))) - F.min(t)).alias("time_to_peak_xv"),
        (F.max_by("__n", F.when(F.col("xv").isNotNull(), F.struct("xv", back.alias("b")))) == 1).alias("peak_at_first"),
        F.max(F.when(F.col("__n") == 1, F.col("v"))).alias("speed_1"),
        F.max(F.when(F.col("__n") == 2, F.col("v"))).alias("speed_2"),
        (F.min(first_lick) - F.min(t)).alias("time_to_first_lick"),
    )


def landmark_means(keypoints: DataFrame, keys: Sequence[str]) -> DataFrame:
    return keypoints.groupBy(*keys, "keypoint").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def landmark_distances(means: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """dx, dy and distance for the stated landmarks, each pair once (names are few and fixed)."""
    wide = means.groupBy(*keys).pivot("keypoint", list(names)).agg(F.first("x").alias("x"), F.first("y").alias("y"))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    rows = F.array(*[
        F.struct(
            F.lit(a).alias("from"), F.lit(b).alias("to"),
            (F.col(f"{b}_x") - F.col(f"{a}_x")).alias("dx"), (F.col(f"{b}_y") - F.col(f"{a}_y")).alias("dy"),
        ) for a, b in pairs
    ])
    return wide.select(*keys, F.inline(rows)).withColumn("distance", F.hypot("dx", "dy"))


def nearest_landmark(frames: DataFrame, means: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Frames with the nearer of two landmarks and its distance (the first on ties)."""
    wide = means.groupBy(*keys).pivot("keypoint", [a, b]).agg(F.first("x").alias("x"), F.first("y").alias("y"))
    joined = frames.join(wide, list(keys))
    da = F.hypot(F.col("x") - F.col(f"{a}_x"), F.col("y") - F.col(f"{a}_y"))
    db = F.hypot(F.col("x") - F.col(f"{b}_x"), F.col("y") - F.col(f"{b}_y"))
    return joined.withColumns({
        "nearest": F.when(da <= db, a).when(db < da, b), "nearest_distance": F.least(da, db),
    }).drop(f"{a}_x", f"{a}_y", f"{b}_x", f"{b}_y")

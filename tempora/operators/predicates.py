"""Row filters, gates, derived columns and clocks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.geometry import clamp
from tempora.functions.keys import session_prefix


def criteria(spec: Mapping[str, Mapping]) -> Column:
    """AND of inclusive `bounds` and `items` memberships, both where a rule has both; null and NaN fail."""
    def one(column: str, rule: Mapping) -> Column:
        c, holds = F.col(column), F.lit(True)
        if "bounds" in rule:
            lo, hi = rule["bounds"]
            holds = holds & (c >= lo) & (c <= hi) & ~F.isnan(c.cast("double"))
        if "items" in rule:
            holds = holds & c.isin(list(rule["items"]))
        return holds

    tests = [F.coalesce(one(c, r), F.lit(False)) for c, r in spec.items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def filter_by_criteria(df: DataFrame, spec: Mapping[str, Mapping]) -> DataFrame:
    return df.where(criteria(spec))


def session_quality_gate(df: DataFrame, coverage: str, duration: str, min_coverage: float, min_duration: float) -> DataFrame:
    """Sessions with `passed`, best coverage first."""
    ok = F.coalesce((F.col(coverage) > min_coverage) & (F.col(duration) > min_duration), F.lit(False))
    return df.withColumn("passed", ok).orderBy(F.desc_nulls_last(coverage), *[c for c in df.columns if c != coverage])


def unit_session_gate(units: DataFrame, sessions: DataFrame, spec: Mapping[str, Mapping], session: str = "session") -> DataFrame:
    """Units that pass the criteria in sessions whose prefix is allowed."""
    allowed = sessions.select(session_prefix(F.col(session)).alias("__p")).distinct()
    kept = filter_by_criteria(units, spec).withColumn("__p", session_prefix(F.col(session)))
    return kept.join(allowed, "__p", "left_semi").drop("__p")


def gate_counts(before: DataFrame, after: DataFrame, session: str = "session") -> DataFrame:
    """Units per session before and after a gate; none left counts 0."""
    a = before.groupBy(session).agg(F.count(F.lit(1)).alias("n_before"))
    b = after.groupBy(session).agg(F.count(F.lit(1)).alias("n_after"))
    return a.join(b, session, "left").fillna({"n_after": 0})


def finite_range(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    c = F.col(column)
    return df.where((c > lo) & (c < hi) & ~F.isnan(c.cast("double")))


def derive_time_columns(trials: DataFrame, keys: Sequence[str], trial: str, cue: str, skip: Sequence[str] = ()) -> DataFrame:
    """Every column with 'time' in its name as `_in_session`, `_in_trial` and `_raw`.

    Session time counts from the first cue of the session (one aggregate row per session).
    """
    columns = [c for c in trials.columns if "time" in c and c not in skip]
    zero = trials.groupBy(*keys).agg(F.min_by(cue, trial).alias("__t0"))
    rows = trials.join(zero, list(keys))
    out = [c for c in trials.columns if c not in columns]
    derived = []
    for c in columns:
        derived += [
            (F.col(c) - F.col("__t0")).alias(f"{c}_in_session"), (F.col(c) - F.col(cue)).alias(f"{c}_in_trial"),
            F.col(c).alias(f"{c}_raw"),
        ]
    return rows.select(*out, *derived)


def choice_features(df: DataFrame) -> DataFrame:
    """q difference toward the licked side, clipped choice probability and its log-likelihood.

    `q_left`, `q_right`, `prob_right` and a `direction` of 'left' or 'right'.
    """
    right = F.col("direction") == "right"
    prob = F.when(right, F.col("prob_right")).otherwise(1 - F.col("prob_right"))
    q_diff = F.col("q_right") - F.col("q_left")
    return df.withColumns({
        "q_diff": q_diff, "q_diff_c": F.when(right, q_diff).otherwise(-q_diff),
        "chosen_prob": clamp(prob, 1e-10, 1 - 1e-10),
    }).withColumn("log_likelihood", F.ln("chosen_prob"))


def namespaced(base: DataFrame, stats: DataFrame, on: Sequence[str], prefix: str, columns: Sequence[str], overwrite: bool = False, absolute: bool = False) -> DataFrame:
    """Stats columns joined as `<prefix>__col`; those already there are kept unless overwriting."""
    names = {c: f"{prefix}__{c}" for c in columns}
    wanted = [c for c, n in names.items() if overwrite or n not in base.columns]
    if not wanted:
        return base
    side = stats.select(*on, *[F.col(c).alias(names[c]) for c in wanted])
    if absolute:
        side = side.withColumns({f"{names[c]}_abs": F.abs(names[c]) for c in wanted})
    stale = [c for c in side.columns if c not in on and c in base.columns]
    return base.drop(*stale).join(side, list(on), "left")


def behaviour_flags(trials: DataFrame, none_value: int = 2) -> DataFrame:
    """hit, hit_clean (null when rewarded) and outcome."""
    rewarded = F.coalesce(F.col("rewarded_left"), F.lit(False)) | F.coalesce(F.col("rewarded_right"), F.lit(False))
    hit = (F.col("animal_response") != none_value).cast("int")
    return trials.withColumns({"hit": hit, "hit_clean": F.when(~rewarded, hit), "outcome": rewarded.cast("int")})


def movement_span(frames: DataFrame, on: Sequence[str], t: str, pad: float) -> DataFrame:
    """Padded time span of the frames of each group."""
    return frames.groupBy(*on).agg((F.min(t) - pad).alias("span_start"), (F.max(t) + pad).alias("span_end"))


def clock_convert(rows: DataFrame, offsets: DataFrame, keys: Sequence[str], t: str, offset: str, name: str) -> DataFrame:
    """`t` moved to another clock by a per-session offset."""
    return rows.join(offsets.select(*keys, offset), list(keys)).withColumn(name, F.col(t) - F.col(offset)).drop(offset)


def zscore_in_group(df: DataFrame, on: Sequence[str], value: Column, name: str) -> DataFrame:
    stats = df.groupBy(*on).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    sd = F.when(F.col("__s") > 0, F.col("__s"))
    return df.join(stats, list(on)).withColumn(name, (value - F.col("__m")) / sd).drop("__m", "__s")


def demean(df: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    means = df.groupBy(*on).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns])
    return df.join(means, list(on)).withColumns({c: F.col(c) - F.col(f"__m_{c}") for c in columns}).drop(
        *[f"__m_{c}" for c in columns]
    )

"""Expectations on tables, reported as rows rather than raised row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.keys import parse_session_id

TIMING_SLACK = 0.005


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """The frame itself, or an error naming what is missing (no job is run)."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def trial_expectations(trials: DataFrame, keys: Sequence[str], date: Column, cutoff: str = "2025-01-01") -> DataFrame:
    """Violations per session and rule, 'warning' up to the cutoff date and 'error' after it."""
    earned, extra = F.col("earned_reward"), F.col("extra_reward")
    choice, reward, cue = F.col("choice_time"), F.col("reward_time"), F.col("cue")
    rules = {
        "rewarded_without_reward_time": earned & reward.isNull(),
        "rewarded_without_choice_time": earned & choice.isNull(),
        "reward_before_choice": earned & ~extra & (choice > reward),
        "negative_choice_time": earned & (choice - cue < -TIMING_SLACK),
        "unrewarded_with_reward_time": ~earned & ~extra & reward.isNotNull(),
    }
    counts = trials.groupBy(*keys).agg(*[F.count_if(c).alias(r) for r, c in rules.items()], F.max(date).alias("__date"))
    long = counts.unpivot([*keys, "__date"], list(rules), "rule", "violations")
    lenient = (F.col("__date") <= F.lit(cutoff).cast("date")) & ~F.col("rule").isin(
        "rewarded_without_choice_time", "negative_choice_time"
    )
    return long.where(F.col("violations") > 0).withColumn("severity", F.when(lenient, "warning").otherwise("error")).drop("__date")


def first_cue_is_zero(events: DataFrame, keys: Sequence[str], t: str, is_cue: Column, eps: float = 1e-9) -> DataFrame:
    """Per session: does the first go cue sit at time zero?"""
    first = events.where(is_cue).groupBy(*keys).agg(F.min(t).alias("first_cue"))
    return first.withColumn("ok", F.abs("first_cue") <= eps)


def duplicate_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def assert_unique(df: DataFrame, on: Sequence[str], side: str) -> DataFrame:
    """The frame itself, or an error with an example (reads up to one duplicate)."""
    example = duplicate_keys(df, on).limit(1).collect()
    if example:
        raise ValueError(f"{side} keys are not unique on {list(on)}: {example[0].asDict()}")
    return df


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, validate: str) -> DataFrame:
    """Join after checking 'one_to_one', 'many_to_one' or 'one_to_many'."""
    if validate in ("one_to_one", "one_to_many"):
        assert_unique(left, on, "left")
    if validate in ("one_to_one", "many_to_one"):
        assert_unique(right, on, "right")
    return left.join(right, list(on), how)


def row_count_change(before: DataFrame, after: DataFrame) -> DataFrame:
    a = before.agg(F.count(F.lit(1)).alias("n_before"))
    return a.withColumn("n_after", after.agg(F.count(F.lit(1))).scalar()).withColumn("unchanged", F.col("n_before") == F.col("n_after"))


def metadata_mismatch(sessions: DataFrame, session: str, subject: str, date: str) -> DataFrame:
    """Sessions whose id disagrees with their metadata."""
    parsed = sessions.withColumn("__id", parse_session_id(F.col(session)))
    differs = ~(F.col("__id.subject").eqNullSafe(F.col(subject)) & F.col("__id.date").eqNullSafe(F.col(date)))
    return parsed.where(differs).select(
        session, subject, date, F.col("__id.subject").alias("id_subject"), F.col("__id.date").alias("id_date")
    )


def missing_metrics(movements: DataFrame, metrics: DataFrame, on: Sequence[str], frames: DataFrame, value: str) -> DataFrame:
    """Movements without a metric: absent from the frames, or present but unusable."""
    present = frames.select(*on).distinct().withColumn("__in", F.lit(True))
    joined = movements.select(*on).join(metrics.select(*on, value), list(on), "left").join(present, list(on), "left")
    return joined.where(F.col(value).isNull()).groupBy(
        F.when(F.col("__in"), "present_but_unusable").otherwise("absent_from_frames").alias("reason")
    ).agg(F.count(F.lit(1)).alias("n"))


def completeness(expected: DataFrame, saved: DataFrame, session: str) -> DataFrame:
    """Sessions that are listed but not saved, or saved but not listed."""
    a = expected.select(session).distinct().join(saved.select(session), session, "left_anti").withColumn("problem", F.lit("not_saved"))
    b = saved.select(session).distinct().join(expected.select(session), session, "left_anti").withColumn("problem", F.lit("not_listed"))
    return a.unionByName(b)

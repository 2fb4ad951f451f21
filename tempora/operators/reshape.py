"""Unions, timelines, event tables, pivots and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.operators.ordered import numbered


def union_tagged(tables: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Tables stacked by column name with the name of each in `tag`."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def union_distinct(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables).distinct()


def set_report(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each distinct key with where it occurs: both, left or right."""
    sides = left.select(*on, F.lit(1).alias("__s")).unionByName(right.select(*on, F.lit(2).alias("__s")))
    return sides.groupBy(*on).agg(F.bit_or("__s").alias("__s")).select(
        *on, F.element_at(F.array(F.lit("left"), F.lit("right"), F.lit("both")), F.col("__s")).alias("side")
    )


def event_timeline(
    trials: DataFrame, keys: Sequence[str], trial_events: Mapping[str, str],
    others: Sequence[tuple[DataFrame, str, Column]],
) -> DataFrame:
    """Long (keys, trial, t, event): trial columns under their event label, then each other
    table as (frame, time column, event label)."""
    on = [*keys, "trial"]
    long = trials.select(*on, *[F.col(c).cast("double").alias(e) for c, e in trial_events.items()]).unpivot(
        on, list(trial_events.values()), "event", "t"
    ).select(*on, "t", "event")
    for frame, t, label in others:
        long = long.unionByName(frame.select(*on, F.col(t).cast("double").alias("t"), label.alias("event")))
    return long.where(F.col("t").isNotNull() & F.col("trial").isNotNull())


def event_wide(
    keys: Sequence[str], specs: Mapping[str, tuple[DataFrame, str, Mapping]],
    width: float | None = None,
) -> DataFrame:
    """One row per go-cue trial with one event time per name.

    `specs` maps name to (frame with trial, time column, filters). Filters: `cue_response`
    (equality), `min_after_cue` (time strictly after the cue), `nth` (0-based movement, else the
    first). With a `movement_id` the n-th distinct movement gives its earliest time.
    """
    if "goCue" not in specs:
        raise ValueError("specs must contain a 'goCue' entry")
    on = [*keys, "trial"]
    cues, cue_t, _ = specs["goCue"]
    base = cues.where(F.col("trial").isNotNull()).groupBy(*on).agg(F.min(cue_t).alias("goCue"))
    out = base
    for name, (frame, t, filters) in specs.items():
        if name == "goCue":
            continue
        rows = frame.where(F.col("trial").isNotNull())
        if "cue_response" in filters:
            rows = rows.where(F.col("cue_response") == filters["cue_response"])
        if filters.get("min_after_cue"):
            rows = rows.join(base.withColumnRenamed("goCue", "__cue"), on).where(F.col(t) > F.col("__cue"))
        if "movement_id" in rows.columns:
            moves = rows.where(F.col("movement_id").isNotNull()).groupBy(*on, "movement_id").agg(
                F.min(t).alias(name)
            )
            nth = filters.get("nth")
            if nth is None:
                times = moves.groupBy(*on).agg(F.min_by(name, "movement_id").alias(name))
            else:
                times = numbered(moves, on, ["movement_id"], "__n", width).where(
                    F.col("__n") == nth
                ).select(*on, name)
        else:
            times = rows.groupBy(*on).agg(F.min(t).alias(name))
        out = out.join(times, on, "left")
    return out


def long_to_wide(
    df: DataFrame, on: Sequence[str], names: str, values: Sequence, measure: Column,
) -> DataFrame:
    """Pivot over the stated `values` (listing them spares a pass over the data)."""
    return df.groupBy(*on).pivot(names, list(values)).agg(measure)


def wide_to_long(df: DataFrame, on: Sequence[str], columns: Sequence[str], names: str, value: str) -> DataFrame:
    return df.unpivot(list(on), list(columns), names, value)


def align_to_order(order: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """`table` reindexed to the keys of `order`; absent keys give nulls."""
    return order.join(table, list(on), "left")


def array_to_rows(df: DataFrame, keys: Sequence[str], array: str, position: str, value: str) -> DataFrame:
    return df.select(*keys, F.posexplode(array).alias(position, value)).withColumn(
        position, F.col(position).cast("bigint")
    )


def rows_to_array(df: DataFrame, on: Sequence[str], position: str, value: str, name: str) -> DataFrame:
    """Ordered array per group; meant for groups of bounded length (a vector, one trial)."""
    packed = F.array_sort(F.collect_list(F.struct(position, value)))
    return df.groupBy(*on).agg(F.transform(packed, lambda s: s[value]).alias(name))

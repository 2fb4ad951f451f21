"""How finely an ordered group has to be cut so that no task gets an unbounded one.

A window partitioned by session puts a whole session in one task. That is the cheapest plan
while every session is small, and no plan at all when one session holds a third of the data.
`chunk_width` measures which case applies; operators take its result as `width`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 2_000_000
#: Whole groups are dealt to so many tasks per chunk's worth of rows, where a task sorts its rows more than once.
TASKS_PER_CHUNK = 4
_REFINEMENTS = 8


def chunk_width(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> float | None:
    """None when every group fits one task, else a width of `col` that cuts groups to size.

    Reads two columns and returns scalars. The first guess assumes an even rate in the densest
    group; bursts are found by counting the cells and narrowing until they fit. Only the count
    of one and the same value cannot be cut further (rank operators pre-aggregate those).
    """
    values = df.where(F.col(col).isNotNull())
    groups = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.max(col) - F.min(col)).cast("double").alias("span")
    )
    large = F.when(F.col("n") > rows_per_chunk, F.try_divide("n", F.nullif("span", F.lit(0.0))))  # small groups are never cut finer
    top = groups.agg(F.max("n").alias("n"), F.max(large).alias("density")).first()
    if top["n"] is None or top["n"] <= rows_per_chunk or top["density"] is None:
        return None
    width = rows_per_chunk / top["density"]
    for _ in range(_REFINEMENTS):
        cells = values.groupBy(*keys, F.floor(F.col(col) / width).alias("cell")).count()
        if cells.agg(F.max("count")).first()[0] <= 2 * rows_per_chunk:
            break
        width /= 4
    return width

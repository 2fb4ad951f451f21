"""Ordered scans within groups: running totals, last/next known value, neighbours, ranks.

Every as-of join, island numbering and rank in this package is one of these scans. Without
`width` a scan is a plain window over the group. With `width` the group is cut into chunks of
the leading order column, of equal width or at measured quantiles (`Measured`): each chunk is scanned on its own, one summary row per chunk is scanned
across chunks, and the carried-in value is joined back. Both give the same rows; the second
never puts more than one chunk into a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.session import scratch_root

_CHUNK = "__chunk"
_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Scan:
    kind: str
    expr: Column
    how: str = "sum"


@dataclass(frozen=True)
class Measured:
    """Chunk edges at quantiles of whatever column is scanned, within its own keys.

    `rows` is the wanted size of a chunk and `total` about how many rows there are. Edges come from a mergeable sketch, so chunks
    are even on heavy-tailed columns too, where equal widths are not. Only groups over `rows` get edges, and of all
    groups at most `MOST_EDGES` are made: beyond that chunks grow.
    """

    rows: int
    total: int


#: Edges of all groups together, so that their table can be broadcast: 16 MB.
MOST_EDGES = 1 << 21


def measured_edges(df: DataFrame, keys: Sequence[str], lead: Column, measured: Measured) -> DataFrame:
    """(keys, __edges) of the groups with more than `measured.rows` values: quantiles of `lead`, about one per `rows` rows."""
    rows = max(measured.rows, -(-2 * measured.total // MOST_EDGES), 1)
    pieces = max(2, -(-measured.total // rows))
    lead = F.when(~F.isnan(lead), lead)
    sketch = df.groupBy(*keys).agg(
        F.count(lead).alias("__n"),
        F.percentile_approx(lead, [i / pieces for i in range(1, pieces)], F.lit(min(2**31 - 1, 8 * pieces))).alias("__all"),
    ).where(F.col("__n") > rows)
    step = F.greatest(F.lit(1), F.floor(F.lit(pieces) * F.lit(rows) / F.col("__n")).cast("int"))
    edges = F.array_distinct(F.transform(F.sequence(step, F.greatest(step, F.size("__all")), step), lambda i: F.get(F.col("__all"), i - 1)))
    return sketch.select(*keys, F.filter(edges, lambda e: e.isNotNull()).alias("__edges"))


def _edges_below(edges: Column, value: Column, most: int) -> Column:
    """How many of the sorted edges are at or below a value, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= F.size(edges)) & (F.get(edges, at + s - 1) <= value), at + s).otherwise(at))


def running(expr: Column, how: str = "sum") -> Scan:
    """Sum, min or max of `expr` from the start of the group to this row."""
    return Scan("running", expr, how)


def last_known(expr: Column) -> Scan:
    """Last non-null `expr` at or before this row."""
    return Scan("last", expr)


def last_before(expr: Column) -> Scan:
    """Last non-null `expr` strictly before this row."""
    return Scan("before", expr)


def next_known(expr: Column) -> Scan:
    """First non-null `expr` at or after this row."""
    return Scan("next", expr)


def next_after(expr: Column) -> Scan:
    """First non-null `expr` strictly after this row."""
    return Scan("after", expr)


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    scans: Mapping[str, Scan],
    width: float | Measured | None = None,
) -> DataFrame:
    """Add one column per scan, computed within `keys` in ascending `order`.

    A null key is a group like any other. Ties in `order` need a tie-break column to be
    deterministic. With `width`, the first order column must be numeric; a `Measured` width reads the input
    once more for its edges, which are stored before the scan so that all of its steps cut alike.
    """
    order = _columns(order)
    up, upto = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)
    down, onto = (1, Window.unboundedFollowing), (0, Window.unboundedFollowing)

    def over(part: Window, scan: Scan) -> Column:
        if scan.kind == "running":
            return _MERGE[scan.how](scan.expr).over(part.rowsBetween(*upto))
        if scan.kind in ("last", "before"):
            frame = upto if scan.kind == "last" else up
            return F.last(scan.expr, ignorenulls=True).over(part.rowsBetween(*frame))
        frame = onto if scan.kind == "next" else down
        return F.first(scan.expr, ignorenulls=True).over(part.rowsBetween(*frame))

    if width is None:
        part = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[over(part, s).alias(n) for n, s in scans.items()])

    parts = [*keys, _CHUNK]
    position = F.struct(*order)
    # as in a plain window, nulls come before all values and NaN after them
    lead = order[0].cast("double")
    rows, inner = df, None
    if isinstance(width, Measured):
        scratch_root(df.sparkSession)
        edges = measured_edges(df, keys, lead, width).checkpoint()
        if keys:
            rows = join_keys(df, F.broadcast(edges), keys, "left")
        else:
            rows = df.withColumn("__edges", edges.select("__edges").scalar())
        inner = F.coalesce(_edges_below(F.col("__edges"), lead, MOST_EDGES), F.lit(0)).cast("bigint")
    else:
        inner = F.floor(order[0] / F.lit(width))
    chunk = F.when(lead.isNull(), F.lit(-(2**62))).when(F.isnan(lead), F.lit(2**62)).otherwise(inner)
    cut = rows.withColumn(_CHUNK, F.greatest(F.lit(-(2**62)), F.least(F.lit(2**62), chunk))).select(*df.columns, _CHUNK)

    def summarise(scan: Scan) -> Column:
        if scan.kind == "running":
            return _MERGE[scan.how](scan.expr)
        pick = F.max_by if scan.kind in ("last", "before") else F.min_by
        return pick(scan.expr, F.when(scan.expr.isNotNull(), position))

    across = Window.partitionBy(*keys).orderBy(_CHUNK)

    def carry(name: str, scan: Scan) -> Column:
        col = F.col(name)
        if scan.kind == "running":
            return _MERGE[scan.how](col).over(across.rowsBetween(*up))
        if scan.kind in ("last", "before"):
            return F.last(col, ignorenulls=True).over(across.rowsBetween(*up))
        return F.first(col, ignorenulls=True).over(across.rowsBetween(*down))

    carried = (
        cut.groupBy(*parts)
        .agg(*[summarise(s).alias(n) for n, s in scans.items()])
        .select(*parts, *[carry(n, s).alias(f"__carry_{n}") for n, s in scans.items()])
    )
    inside = Window.partitionBy(*parts).orderBy(*order)
    local = cut.select("*", *[over(inside, s).alias(f"__local_{n}") for n, s in scans.items()])

    def combine(name: str, scan: Scan) -> Column:
        here, before = F.col(f"__local_{name}"), F.col(f"__carry_{name}")
        if scan.kind != "running":
            return F.coalesce(here, before)
        if scan.how == "sum":
            return F.when(here.isNull(), before).otherwise(here + F.coalesce(before, F.lit(0)))
        return (F.least if scan.how == "min" else F.greatest)(here, before)

    return join_keys(local, carried, parts).select(
        *df.columns, *[combine(n, s).alias(n) for n, s in scans.items()]
    )


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null with null; the keys stand once. Without keys `right` is a single row."""
    if not keys:
        return left.withColumns({c: right.select(c).scalar() for c in right.columns})
    named = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"__right_{k}" for k in keys])


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str,
    width: float | Measured | None = None, start: int = 0,
) -> DataFrame:
    """Position of each row within its group, counted from `start`."""
    out = ordered_scan(df, keys, order, {name: running(F.lit(1).cast("bigint"))}, width)
    return out.withColumn(name, F.col(name) - F.lit(1 - start).cast("bigint"))


def lagged(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
    previous: Mapping[str, Column] | None = None, following: Mapping[str, Column] | None = None,
    width: float | Measured | None = None,
) -> DataFrame:
    """Values of the neighbouring rows, nulls included (a one-field struct keeps a null apart
    from an absent row)."""
    previous, following = dict(previous or {}), dict(following or {})
    scans = {n: last_before(F.struct(e.alias("v"))) for n, e in previous.items()}
    scans.update({n: next_after(F.struct(e.alias("v"))) for n, e in following.items()})
    out = ordered_scan(df, keys, order, scans, width)
    return out.withColumns({n: F.col(n)["v"] for n in scans})


def tie_ranks(
    df: DataFrame, keys: Sequence[str], value: str, rank: str = "avg_rank",
    width: float | Measured | None = None, below: str | None = None, tasks: int | None = None,
) -> DataFrame:
    """Average rank of `value` within `keys`; optionally `below`, the rows at or under it.

    Null values get no rank. With `width`, equal values are counted before the shuffle, so a
    value repeated a billion times is one row in the scan. Without it a task sorts the rows of whole groups; `tasks` says how
    many tasks they are dealt to, else Spark gathers as many as its shuffle settings allow.
    """
    extra = [] if below is None else [F.col("__upto").cast("bigint").alias(below)]
    if width is None:
        part = Window.partitionBy(*keys).orderBy(value)
        present = df.where(F.col(value).isNotNull())
        if tasks is not None:
            present = present.repartition(tasks, *keys)
        upto = F.count(F.lit(1)).over(part.rangeBetween(Window.unboundedPreceding, 0))
        return present.withColumns({"__upto": upto, "__first": F.rank().over(part)}).select(
            *df.columns, ((F.col("__upto") + F.col("__first")) / 2).alias(rank), *extra
        )
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("__n")
    )
    ranks = ordered_scan(counts, keys, [value], {"__upto": running(F.col("__n"))}, width).select(
        *keys, value, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(rank), *extra
    )
    return join_keys(df, ranks, [*keys, value]).where(F.col(value).isNotNull()).select(*df.columns, rank, *([below] if below else []))


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
    width: float | Measured | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column per entry of `probs`."""
    present = df.where(F.col(value).isNotNull())
    if width is None:
        return present.groupBy(*keys).agg(
            *[F.percentile(value, F.lit(p)).alias(n) for n, p in probs.items()]
        )
    counts = present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    upto = ordered_scan(counts, keys, [value], {"__upto": running(F.col("__n"))}, width)
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    placed = join_keys(upto, total, list(keys))

    def at(p: float, side) -> Column:
        place = side(F.lit(p) * (F.col("__total") - 1))
        return F.min(F.when(F.col("__upto") > place, F.col(value)))

    grouped = placed.groupBy(*keys).agg(
        F.first("__total").alias("__total"),
        *[at(p, F.floor).alias(f"__lo_{n}") for n, p in probs.items()],
        *[at(p, F.ceil).alias(f"__hi_{n}") for n, p in probs.items()],
    )

    def interpolate(n: str, p: float) -> Column:
        place = F.lit(p) * (F.col("__total") - 1)
        lo, hi = F.col(f"__lo_{n}"), F.col(f"__hi_{n}")
        return (lo + (hi - lo) * (place - F.floor(place))).alias(n)

    return grouped.select(*keys, *[interpolate(n, p) for n, p in probs.items()])

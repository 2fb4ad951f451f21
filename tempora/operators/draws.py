"""Random subsets and bootstrap weights: replicates are arrays inside a task, and only their sums leave it.

Rows with equal values are one bin with a count. Bins are dealt by hash to the leaves of a binary tree; how many of a subset's
items fall on either side of a node is one hypergeometric draw, fixed by the seed and the node, so every task that
passes the node draws the same. A leaf then draws bin by bin what is left for it. A replicate is a
uniformly random subset of the rows as a whole, yet no row is copied per replicate and no task sees more than one leaf.
Where a replicate needs to know which value came to which place, blocks of values meet blocks of places (`permuted_blocks`).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.ordered import join_keys

#: numpy draws exactly below so many rows; larger nodes are split by the normal limit with the exact mean and variance.
EXACT_BELOW = 10**9


def hypergeometric(rng: np.random.Generator, good, bad: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """How many of `good` items are among `sample` drawn of `good + bad`.

    From EXACT_BELOW items on the draw is a rounded normal; a standard deviation is then thousands of items unless one
    side is tiny, and the draw stays within its range.
    """
    good, bad = np.broadcast_arrays(np.asarray(good, np.int64), np.asarray(bad, np.int64))
    if int((good + bad).max(initial=0)) < EXACT_BELOW:
        return rng.hypergeometric(good, bad, sample)
    total = (good + bad).astype(np.float64)
    share = good / np.maximum(total, 1)
    spread = np.sqrt(sample * share * (1 - share) * (total - sample) / np.maximum(total - 1, 1))
    drawn = np.rint(sample * share + spread * rng.standard_normal(len(sample))).astype(np.int64)
    return np.clip(drawn, np.maximum(0, sample - bad), np.minimum(good, sample))


def leaf_levels(chunks: int | None) -> int:
    """Levels of the tree for a table of so many chunks: 64 leaves for a table that fits one task."""
    return 6 + (0 if chunks is None else max(0, (chunks - 1).bit_length()))


def _leaf_sums(seed: int, group: int, leaf: int, path: list[tuple[int, int]], drawn: int, count: np.ndarray, values: np.ndarray, n_perm: int) -> np.ndarray:
    """(values x replicates) sums over what each replicate's subset has in one leaf."""
    left = np.full(n_perm, drawn, np.int64)
    for level, (low, high) in enumerate(path):  # (rows of the low child, rows of the high child) of the nodes on the way
        node, side = leaf >> (len(path) - level), leaf >> (len(path) - 1 - level) & 1
        rng = np.random.default_rng([seed, group & 0xFFFFFFFF, group >> 32 & 0xFFFFFFFF, level, node])
        taken = hypergeometric(rng, low, np.int64(high), left)
        left = left - taken if side else taken
    rng = np.random.default_rng([seed, group & 0xFFFFFFFF, group >> 32 & 0xFFFFFFFF, 1 << 20, leaf])
    rest, out = int(count.sum()), np.zeros((len(values), n_perm))
    for n, x in zip(count.tolist(), values.T):
        if n == rest:
            k = left
        elif n == 1:
            k = rng.random(n_perm) * rest < left
        else:
            k = hypergeometric(rng, n, np.int64(rest - n), left)
        out += np.multiply.outer(x, k)
        left = left - k
        rest -= n
    return out


def subset_sums(
    bins: DataFrame, on: Sequence[str], count: str, sums: Sequence[str], drawn: DataFrame, size: str,
    n_perm: int, seed: int = 0, levels: int = 6,
) -> DataFrame:
    """(on, rep, *sums): for every replicate 1..n_perm the sum of each column over a random subset of the items of a group.

    A row of `bins` stands for `count` items with the same values in `sums`; bins need not be merged. `drawn` has per
    group the size of its subsets in column `size`. Bins without items are left out; a null value is 0.
    """
    rows = bins.where(F.col(count) > 0).select(*on, F.col(count).cast("bigint").alias("__n"), *[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in sums])
    rows = rows.withColumn("__leaf", F.pmod(F.xxhash64(F.lit(seed), *sums), F.lit(1 << levels)).cast("int"))
    held = rows.groupBy(*on, "__leaf").agg(F.sum("__n").alias("__m"))
    steps = []
    for level in range(levels):
        node = F.shiftright("__leaf", levels - level)
        low = F.shiftright("__leaf", levels - 1 - level).bitwiseAND(F.lit(1)) == 0
        part = Window.partitionBy(*on, node)
        steps.append(F.struct(*[F.coalesce(F.sum(F.when(which, F.col("__m"))).over(part), F.lit(0)).alias(n) for n, which in (("low", low), ("high", ~low))]))
    paths = held.withColumn("__path", F.array(*steps)).drop("__m")
    sized = join_keys(paths, drawn.select(*on, F.col(size).cast("bigint").alias("__drawn")), list(on))
    rows = rows.withColumn("__group", F.xxhash64(F.lit(0), *on))
    fields = [f"`{c}` {bins.schema[c].dataType.simpleString()}" for c in on]

    def draw(table: pa.Table) -> pa.Table:
        # equal seeds meet equal bins in the same order
        table = table.sort_by([(s, "ascending") for s in sums] + [("__n", "ascending")])
        first = {c: table.column(c)[0] for c in ("__leaf", "__group", "__path", "__drawn", *on)}
        path = [(s["low"], s["high"]) for s in first["__path"].as_py()]
        values = np.array([table.column(s).to_numpy() for s in sums])
        found = _leaf_sums(seed, first["__group"].as_py(), first["__leaf"].as_py(), path, first["__drawn"].as_py(), table.column("__n").to_numpy(), values, n_perm)
        keys = {c: pa.array([first[c].as_py()] * n_perm, table.schema.field(c).type) for c in on}
        return pa.table({**keys, "rep": pa.array(np.arange(1, n_perm + 1), pa.int32()), **dict(zip(sums, map(pa.array, found)))})

    placed = join_keys(rows, sized, [*on, "__leaf"])
    drawn_sums = placed.groupBy(*on, "__leaf").applyInArrow(draw, ", ".join([*fields, "rep int", *(f"`{s}` double" for s in sums)]))
    return drawn_sums.groupBy(*on, "rep").agg(*[F.sum(s).alias(s) for s in sums])


#: Groups whose sums a task holds at a time, and rows that meet all replicates at once.
HELD_GROUPS, BLOCK = 64, 512


def uniforms(hashes: np.ndarray, replicate: np.ndarray) -> np.ndarray:
    """(replicates x rows) numbers in [0, 1), fixed by the rows' hashes and the replicate numbers (the splitmix64 finaliser)."""
    x = hashes.astype(np.uint64)[None, :] + replicate.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) * 2.0**-53


def _poisson_steps(top: int = 18) -> np.ndarray:
    """P(N <= k) of a Poisson(1) count; more than `top` has less chance than the step of a 53-bit number."""
    terms = np.cumprod(np.concatenate([[np.exp(-1.0)], 1.0 / np.arange(1, top)]))
    return np.cumsum(terms)


def bootstrap_moments(df: DataFrame, on: Sequence[str], columns: Sequence[str], row_id: Sequence[str], n_boot: int, seed: int = 0) -> DataFrame:
    """(on, rep, w, m0, m1, ..., c0_0, c0_1, ...): per group and replicate the sums of weights, weighted columns and weighted products.

    Replicate 0 weighs every row once; 1..n_boot weigh rows by Poisson(1) counts fixed by the seed and the row id. A
    task multiplies blocks of rows with the weights of all replicates and emits one row per group and replicate, so what is
    shuffled does not grow with the rows. Rows with a null or NaN in `columns` must have been dropped.
    """
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    names = ["w", *(f"m{i}" for i in range(d)), *(f"c{i}_{j}" for i, j in pairs)]
    kinds = {c: df.schema[c].dataType for c in on}
    fields = ", ".join([*(f"`{c}` {k.simpleString()}" for c, k in kinds.items()), "rep int", *(f"{n} double" for n in names)])
    steps, replicate = _poisson_steps(), np.arange(1, n_boot + 1)

    def fold(batches):
        held: dict[tuple, np.ndarray] = {}
        types: dict[str, pa.DataType] = {}

        def emit():
            for key, sums in held.items():
                keys = {c: pa.array([v] * (n_boot + 1), types[c]) for c, v in zip(on, key)}
                yield pa.RecordBatch.from_pydict({**keys, "rep": pa.array(np.arange(n_boot + 1), pa.int32()), **{n: pa.array(x) for n, x in zip(names, sums.T)}})
            held.clear()

        for batch in batches:
            types = types or {c: batch.schema.field(c).type for c in on}
            values = np.stack([batch.column(f"__x{i}").to_numpy(zero_copy_only=False) for i in range(d)], 1) if batch.num_rows else np.zeros((0, d))
            hashes = batch.column("__h").to_numpy()
            code: dict[tuple, list[int]] = {}
            for row, key in enumerate(zip(*[batch.column(c).to_pylist() for c in on]) if on else [()] * batch.num_rows):
                code.setdefault(key, []).append(row)
            for key, own in code.items():
                if key not in held and len(held) >= HELD_GROUPS:
                    yield from emit()
                sums = held.setdefault(key, np.zeros((n_boot + 1, len(names))))
                for k in range(0, len(own), BLOCK):
                    x, h = values[own[k : k + BLOCK]], hashes[own[k : k + BLOCK]]
                    terms = np.concatenate([np.ones((len(x), 1)), x, np.stack([x[:, i] * x[:, j] for i, j in pairs], 1)], 1)
                    sums[0] += terms.sum(0)
                    weights = np.searchsorted(steps, uniforms(h, replicate).ravel(), side="right").reshape(n_boot, len(x)).astype(np.float64)
                    sums[1:] += weights @ terms
        yield from emit()

    rows = df.select(*on, F.xxhash64(F.lit(seed), *row_id).alias("__h"), *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns)])
    return rows.mapInArrow(fold, fields).groupBy(*on, "rep").agg(*[F.sum(n).alias(n) for n in names])


#: Ranks of a block, and replicates that meet it at once: 26 MB of values in a task.
RANKS, AT_ONCE = 16_384, 200
#: Rounds of row and column turns that make a permutation of more ranks than a block.
TURNS = 6
#: Tasks that blocks and runs are dealt to at most.
MOST_TASKS = 2048


class Permutation:
    """A permutation of 0..n-1 fixed by the seed and the replicate, of which any task finds any part.

    Up to `whole` ranks it is a uniform shuffle. Of more, ranks lie in a grid as square as n allows, and each of TURNS rounds turns
    every row and then every column by its own random amount; ranks that land outside go on until they are inside.
    """

    def __init__(self, seed: int, rep: int, n: int, whole: int):
        rng = np.random.default_rng([seed, rep])
        self.n, self.order = n, None
        if n <= whole:
            self.order = rng.permutation(n)
            return
        self.rows = int(np.ceil(np.sqrt(n)))
        self.columns = -(-n // self.rows)
        self.turns = [(rng.integers(0, self.columns, self.rows), rng.integers(0, self.rows, self.columns)) for _ in range(TURNS)]

    def _walk(self, ranks: np.ndarray, once) -> np.ndarray:
        out = once(ranks)
        while (outside := np.flatnonzero(out >= self.n)).size:
            out[outside] = once(out[outside])
        return out

    def images(self, ranks: np.ndarray) -> np.ndarray:
        """Where ranks go."""
        if self.order is not None:
            return self.order[ranks]

        def once(x):
            row, column = np.divmod(x, self.columns)
            for along, down in self.turns:
                column = column + along[row]
                column -= self.columns * (column >= self.columns)
                row = row + down[column]
                row -= self.rows * (row >= self.rows)
            return row * self.columns + column

        return self._walk(ranks, once)

    def origins(self, ranks: np.ndarray) -> np.ndarray:
        """Where ranks come from."""
        if self.order is not None:
            back = np.empty(self.n, np.int64)
            back[self.order] = np.arange(self.n)
            return back[ranks]

        def once(x):
            row, column = np.divmod(x, self.columns)
            for along, down in reversed(self.turns):
                row = row - down[column]
                row += self.rows * (row < 0)
                column = column - along[row]
                column += self.columns * (column < 0)
            return row * self.columns + column

        return self._walk(ranks, once)


def all_runs(n_perm: int) -> Column:
    """A row once per run of AT_ONCE replicates, as `__run`."""
    return F.explode(F.sequence(F.lit(0), F.lit((n_perm - 1) // AT_ONCE))).alias("__run")


def run_replicates(run: int, n_perm: int, at_once: int) -> range:
    """Numbers of a run's replicates."""
    return range(run * at_once + 1, min(n_perm, (run + 1) * at_once) + 1)


def run_tasks(n: int, n_perm: int) -> int:
    """Tasks for the blocks and runs of n rows. A small input is much work: its tasks must not be gathered by their bytes."""
    return max(1, min(2 * -(-n // RANKS) * -(-n_perm // AT_ONCE), MOST_TASKS))


def permuted_blocks(rows: DataFrame, rank: str, n: int, value: str, places: DataFrame, n_perm: int, seed: int, fold, schema: str) -> DataFrame:
    """What `fold` makes of every block of RANKS places and run of AT_ONCE replicates, the values of a replicate being a random permutation.

    `rows` has a value per rank 0..n-1; `places` has the rank and whatever else `fold` needs, several rows a rank if need be.
    `fold(block, replicates, y, places)` gets y as (replicates x ranks of the block) and returns an Arrow table of `schema`. A block of values sends
    8 bytes a value and replicate to the blocks of places, in the order of the values' ranks; both sides find by themselves
    which rank meets which. No row is copied per replicate, and no task holds more than a block and a run.
    """
    n_blocks = -(-n // RANKS)
    runs, tasks = all_runs(n_perm), run_tasks(n, n_perm)

    def send(table: pa.Table) -> pa.Table:
        table = table.sort_by("__i")
        run = table.column("__run")[0].as_py()
        ranks, values = table.column("__i").to_numpy(), table.column("__y").to_numpy()
        target = np.stack([Permutation(seed, rep, n, RANKS).images(ranks) // RANKS for rep in run_replicates(run, n_perm, AT_ONCE)])
        order = np.argsort(target, axis=1, kind="stable")
        counts = np.stack([np.bincount(t, minlength=n_blocks) for t in target])
        starts = np.cumsum(counts, axis=1) - counts
        sent = values[order]
        blocks = np.flatnonzero(counts.any(axis=0))
        pieces = [np.concatenate([sent[r, s : s + c] for r, (s, c) in enumerate(zip(starts[:, b], counts[:, b]))]).tobytes() for b in blocks]
        return pa.table({
            "__block": pa.array(blocks, pa.int64()), "__run": pa.array([run] * len(blocks), pa.int32()),
            "__from": pa.array([int(ranks[0]) // RANKS] * len(blocks), pa.int64()),
            "__counts": pa.array([counts[:, b].astype(np.int32).tobytes() for b in blocks], pa.binary()),
            "__values": pa.array(pieces, pa.binary()),
        })

    def receive(sent: pa.Table, placed: pa.Table) -> pa.Table:
        sent = sent.sort_by("__from")
        block, run = (sent.column(c)[0].as_py() for c in ("__block", "__run"))
        ranks = np.arange(block * RANKS, min(n, (block + 1) * RANKS))
        reps = run_replicates(run, n_perm, AT_ONCE)
        parts: list[list[np.ndarray]] = [[] for _ in reps]
        for counts, values in zip(sent.column("__counts"), sent.column("__values")):
            ends = np.cumsum(np.frombuffer(counts.as_buffer(), np.int32))
            for own, piece in zip(parts, np.split(np.frombuffer(values.as_buffer(), np.float64), ends[:-1])):
                own.append(piece)
        y = np.empty((len(reps), len(ranks)))
        for r, rep in enumerate(reps):
            y[r, np.argsort(Permutation(seed, rep, n, RANKS).origins(ranks))] = np.concatenate(parts[r])
        return fold(block, reps, y, placed)

    def dealt(df: DataFrame):
        return df.repartition(tasks, "__block", "__run")

    own = F.floor(F.col(rank) / RANKS).alias("__block")
    values = rows.select(F.col(rank).alias("__i"), F.col(value).cast("double").alias("__y"), own, runs)
    wide = "__block long, __run int, __from long, __counts binary, __values binary"
    sent = dealt(values).groupBy("__block", "__run").applyInArrow(send, wide)
    return dealt(sent).groupBy("__block", "__run").cogroup(dealt(places.select("*", own, runs)).groupBy("__block", "__run")).applyInArrow(receive, schema)

"""Product codes of vectors by Lloyd rounds over cover trees: whole subtrees are assigned by the triangle inequality."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import joined_by_frequency, stored

#: Vectors of a tree at most, and numbers in them.
TREE_ROWS, TREE_VALUES = 10_000, 1 << 21
#: A node of so few points is not divided.
LEAF = 16
#: Components are integers below this, so that no squared distance leaves 64 bits for up to 2,048 components.
LIMIT = 1 << 24


@dataclass
class Trees:
    """Cover trees of some vectors, one for each part position, with nodes in breadth-first order.

    A node's points are neighbours in `order`, its center is the first of them and `radius` reaches all of them, so its
    count is high - low and its sum a difference of cumulative sums. Children stand from `child` to `last`.
    """

    points: np.ndarray  # rows x parts x components
    order: np.ndarray  # parts x rows
    roots: np.ndarray  # the root of each part
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    last: np.ndarray
    radius: np.ndarray

    _ARRAYS = {"order": np.int32, "roots": np.int32, "low": np.int32, "high": np.int32, "child": np.int32, "last": np.int32, "radius": np.float64}

    def packed(self) -> dict[str, bytes]:
        return {"points": self.points.astype(np.int32).tobytes()} | {n: getattr(self, n).astype(k).tobytes() for n, k in self._ARRAYS.items()}

    @classmethod
    def unpacked(cls, row: dict, parts: int) -> "Trees":
        arrays = {n: np.frombuffer(row[n], k) for n, k in cls._ARRAYS.items()}
        n = len(arrays["order"]) // parts
        arrays["order"] = arrays["order"].reshape(parts, n)
        return cls(np.frombuffer(row["points"], np.int32).reshape(n, parts, -1).astype(np.int64), **arrays)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of every row of `a` to every row of `b`, exact for integers below LIMIT."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) * (1 << 4) < 1 << 24 and a.shape[1] <= 1 << 10:  # all sums are whole numbers under 2^53
        a, b = a.astype(np.float64), b.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    return sum((a[:, None, k] - b[None, :, k]) ** 2 for k in range(a.shape[1]))


def grow(points: np.ndarray) -> Trees:
    """Trees over rows x parts x components. All nodes of a level, of all parts, are divided together.

    A node of radius over 2^i is divided at scale 2^i: its first point is a center and takes what lies within 2^i, then the first of
    those left, and so on, so that children of a node are over 2^i apart and hold no point farther from the center than that.
    """
    rows, parts, width = points.shape
    flat = points.transpose(1, 0, 2).reshape(rows * parts, width).astype(np.float64)
    order = np.arange(rows * parts)
    low = np.arange(parts) * rows
    high = low + rows
    out = {n: [] for n in ("low", "high", "child", "last", "radius")}
    made = 0
    while len(low):
        size = high - low
        center = np.repeat(order[low], size)
        at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        far = np.sqrt(((flat[order[at]] - flat[center]) ** 2).sum(1))
        radius = np.maximum.reduceat(far, np.concatenate([[0], np.cumsum(size)[:-1]]))
        split = (size > LEAF) & (radius >= 1)
        out["low"].append(low), out["high"].append(high), out["radius"].append(radius)
        made += len(low)
        scale = np.exp2(np.ceil(np.log2(np.maximum(radius, 1))) - 1)
        owner = np.repeat(np.arange(len(low)), size)
        left = np.flatnonzero(split[owner])  # places among `at` that no center took yet
        group = np.zeros(len(at), np.int64)
        turn = 0
        while len(left):
            mine = owner[left]
            first = np.concatenate([[True], mine[1:] != mine[:-1]])
            chosen = flat[order[at[left[first]]]][np.cumsum(first) - 1]
            near = ((flat[order[at[left]]] - chosen) ** 2).sum(1) <= scale[mine] ** 2
            group[left[near]] = turn
            left = left[~near]
            turn += 1
        inner = np.flatnonzero(split[owner])
        rank = np.lexsort((group[inner], owner[inner]))  # stable: a center stays the first of its points
        moved = inner[rank]
        order[at[inner]] = order[at[moved]]
        change = np.ones(len(inner), bool)
        change[1:] = (owner[moved[1:]] != owner[moved[:-1]]) | (group[moved[1:]] != group[moved[:-1]])
        begins = np.flatnonzero(change)
        children = np.bincount(owner[moved[begins]], minlength=len(low)) if len(begins) else np.zeros(len(low), np.int64)
        last = made + np.cumsum(children)
        out["child"].append(last - children), out["last"].append(last)
        low = at[inner[begins]]
        high = at[inner[np.append(begins[1:], len(inner)) - 1]] + 1 if len(begins) else low
    arrays = {n: np.concatenate(v) for n, v in out.items()}
    base = np.repeat(np.arange(parts) * rows, rows)
    part = arrays["low"] // rows
    arrays["low"], arrays["high"] = arrays["low"] - part * rows, arrays["high"] - part * rows
    return Trees(points, (order - base).reshape(parts, rows), np.arange(parts), **arrays)


def assign(trees: Trees, part: int, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lows, highs, entries) of subtrees with one nearest entry for all of their points, and the exact entries of the others' places.

    A subtree of radius r goes to its center's nearest entry if the second nearest is over 2 r farther; else its children
    are asked, and points of a node without children are compared exactly, equal distances going to the lower index.
    """
    points, order = trees.points[:, part], trees.order[part]
    nodes = trees.roots[part : part + 1]
    lows, highs, entries, open_places = [], [], [], []
    while len(nodes):
        away = np.sqrt(squares(points[order[trees.low[nodes]]], book).astype(np.float64))
        nearest = away.argmin(1)
        best = away[np.arange(len(nodes)), nearest]
        away[np.arange(len(nodes)), nearest] = np.inf
        second = away.min(1)
        radius = trees.radius[nodes]
        sure = second - best > 2 * radius + 1e-9 * (1 + best + radius)
        lows.append(trees.low[nodes[sure]]), highs.append(trees.high[nodes[sure]]), entries.append(nearest[sure])
        nodes = nodes[~sure]
        leaf = trees.child[nodes] == trees.last[nodes]
        open_places += [np.arange(a, b) for a, b in zip(trees.low[nodes[leaf]], trees.high[nodes[leaf]])]
        nodes = nodes[~leaf]
        nodes = np.concatenate([np.arange(a, b) for a, b in zip(trees.child[nodes], trees.last[nodes])]) if len(nodes) else nodes
    places = np.concatenate(open_places) if open_places else np.zeros(0, np.int64)
    exact = np.concatenate([squares(points[order[places[k : k + 4096]]], book).argmin(1) for k in range(0, len(places), 4096)]) if len(places) else places
    return (*(np.concatenate(x).astype(np.int64) for x in (lows, highs, entries)), np.stack([places, exact]))


def part_sums(trees: Trees, part: int, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) of the points assigned to each entry."""
    ordered = trees.points[trees.order[part], part]
    totals = np.zeros((len(ordered) + 1, ordered.shape[1]), np.int64)
    np.cumsum(ordered, axis=0, out=totals[1:])
    low, high, entry, (places, exact) = assign(trees, part, book)
    counts, sums = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
    np.add.at(counts, entry, high - low), np.add.at(sums, entry, totals[high] - totals[low])
    np.add.at(counts, exact, 1), np.add.at(sums, exact, ordered[places])
    return counts, sums


def part_codes(trees: Trees, part: int, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance to it) of every row."""
    low, high, entry, (places, exact) = assign(trees, part, book)
    order, code = trees.order[part], np.zeros(len(trees.points), np.int64)
    size = high - low
    spans = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
    code[order[spans]] = np.repeat(entry, size)
    code[order[places]] = exact
    return code, ((trees.points[:, part] - book[code]) ** 2).sum(1)


def whole(vector: Column) -> Column:
    """True where a vector is there and all of its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def planted(rows: DataFrame, vector: str, key: str, label: str | None, parts: int) -> DataFrame:
    """(keys, labels, packed trees) of every up to TREE_ROWS rows of a partition; `vector` must be whole and of one length."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, label) if c}

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = len(batch.column(vector)[0]) if batch.num_rows else 1
            step = max(1, min(TREE_ROWS, TREE_VALUES // max(1, width)))
            for k in range(0, batch.num_rows, step):
                some = batch.slice(k, step)
                flat = some.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                trees = grow(np.floor(256 * flat).astype(np.int64).reshape(some.num_rows, parts, -1))
                edges = pa.array([0, some.num_rows], pa.int32())
                lists = {n: pa.ListArray.from_arrays(edges, some.column(c)) for n, c in (("keys", key), ("labels", label)) if c}
                yield pa.RecordBatch.from_pydict(lists | {n: pa.array([b], pa.binary()) for n, b in trees.packed().items()})

    lists = [f"{n} array<{kinds[c]}>" for n, c in (("keys", key), ("labels", label)) if c]
    return rows.select(key, *([label] if label else []), vector).mapInArrow(plant, ", ".join([*lists, "points binary", *(f"`{n}` binary" for n in Trees._ARRAYS)]))


def lloyd(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks (parts x entries x components) after one round: entries become the floor of their points' mean, unused ones stay.

    A task adds up all of its trees; what reaches the driver has the size of the codebooks.
    """
    parts, entries, width = books.shape

    def add(batches):
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                one = Trees.unpacked(row, parts)
                for part in range(parts):
                    n, s = part_sums(one, part, books[part])
                    counts[part] += n
                    sums[part] += s
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(counts[part, entry]), "s": pa.array(list(sums[part, entry]), pa.list_(pa.int64()))})

    found = trees.drop("keys", "labels").mapInArrow(add, "part int, entry int, n long, s array<bigint>")
    found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(width)))
    books = books.copy()
    for part, entry, n, *s in found.collect():
        books[part, entry] = np.array(s, np.int64) // n
    return books


def coded(trees: DataFrame, books: np.ndarray, key: str, label: str | None) -> DataFrame:
    """(key, label, code, error) of every row of the trees."""
    parts = len(books)
    kinds = {c: trees.schema[n].dataType.elementType.simpleString() for n, c in (("keys", key), ("labels", label)) if c}

    def look_up(batches):
        for batch in batches:
            for k, row in enumerate(batch.select([n for n in batch.schema.names if n not in ("keys", "labels")]).to_pylist()):
                one = Trees.unpacked(row, parts)
                code, error = zip(*(part_codes(one, part, books[part]) for part in range(parts)))
                pairs = np.stack(code, 1).astype(np.uint8).tobytes().hex()
                digits = [pairs[i : i + 2 * parts] for i in range(0, len(pairs), 2 * parts)]
                own = [batch.column(n).slice(k, 1).flatten() for n in ("keys", "labels") if n in batch.schema.names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(digits, pa.string()), pa.array(sum(error))], names=[*kinds, "code", "error"])

    return trees.mapInArrow(look_up, ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "code string", "error long"]))


def vector_codes(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every row whose vector is there and all finite numbers.

    A component x is the integer floor(256 x) and a vector `parts` equal parts. A position's codebook starts as that part of
    the vectors of the `entries` least keys (equal keys: the least vector; null keys last; fewer rows: fewer entries). Each round
    assigns all parts to their nearest entries and moves the entries; then all are assigned once more. The length
    coded is the commonest one that `parts` divides (ties: the greatest); rows of another length, or with a component of 2^16
    or more, are returned with a null code and error, and train nothing. Trees are built once and stored.
    """
    if entries > 256:
        raise ValueError("two hex digits hold at most 256 entries")
    kept = rows.where(whole(F.col(vector))).select(F.col(key).alias("__key"), F.col(label).alias("__label"), F.col(vector).alias("__vector"))
    length = F.size("__vector")
    common = kept.where((length > 0) & (length % parts == 0)).groupBy(length.alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    length = common["length"] if common else 0
    fits = (F.size("__vector") == length) & F.forall("__vector", lambda x: F.abs(256 * x.cast("double")) < LIMIT) & F.lit(length > 0)
    first = kept.where(fits).orderBy(F.col("__key").asc_nulls_last(), "__vector").limit(entries).select("__vector").collect()
    books = np.floor(256 * np.array([r[0] for r in first], np.float64)).astype(np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2) if first else np.zeros((parts, 0, 0), np.int64)
    trees = stored(planted(kept.where(fits), "__vector", "__key", "__label", parts), "trees")
    for _ in range(rounds if first else 0):
        books = lloyd(trees, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    codes = coded(trees, books, "__key", "__label").unionByName(kept.where(~fits).select("__key", "__label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    codes = stored(codes.withColumn("__label", F.struct("__label")), "codes")
    sums = codes.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return joined_by_frequency(codes, sums, "__label", "n").select(F.col("__key").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

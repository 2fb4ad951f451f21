"""What the operators share: reading tables, cutting lineage, and texts as flat byte arrays inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.session import scratch_path

#: Bytes of text that one step inside a task works on; a longer text is a step of its own.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def others(docs: DataFrame, *new: str) -> list[str]:
    """The columns of `docs` that stay beside new ones: one with the name of a new column gives way to it."""
    taken = {n.lower() for n in new}
    return [c for c in docs.columns if c.lower() not in taken]


def hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`docs` under names that clash with nothing, and the new name of each old one."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared scratch folder and read again: its work is done once and survives lost executors.

    The shuffle files behind it are of no more use and go at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys that reach their rows by broadcast in `joined_by_frequency`.
FREQUENT = 4096


def joined_by_frequency(rows: DataFrame, known: DataFrame, key: str, n: str) -> DataFrame:
    """`rows` joined with the row of `known` that each key has, where `n` is how many of the rows have it; keys must not be null.

    The most frequent keys are joined by broadcast, the others by shuffle: any of those has a smaller share of the rows
    than 1 / FREQUENT, so no task holds a hot key. Keys and values must be small.
    """
    columns = [c for c in known.columns if c != n]
    frequent = F.broadcast(stored(known.orderBy(F.desc(n), key).limit(FREQUENT).select(*columns), "frequent"))
    rest = rows.join(frequent.select(key), key, "left_anti").join(known.select(*columns), key)
    return rows.join(frequent, key).unionByName(rest)


def utf8_bytes(column):
    """Bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in steps of about `limit` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        step = np.cumsum(sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: A random value for every byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 1 << 23:
            _powers[base] = have
    return have[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end]; equal spans have equal hashes wherever they stand."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_INVERSE, len(values) + 1)[starts])


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of every k neighbours."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=total[1:])
    gram = total[k:] - total[:-k]
    gram *= powers(_INVERSE, len(gram))
    gram ^= gram >> np.uint64(32)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(29)
    return gram


#: Bytes that separate words: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text) of the words of flat texts; no word crosses two texts."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def result_batch(batch: pa.RecordBatch, keep: list[str], **columns) -> pa.RecordBatch:
    """Columns `keep` of `batch` and the new ones, in this order."""
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *columns.values()], names=[*keep, *columns])

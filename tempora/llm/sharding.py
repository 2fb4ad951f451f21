"""Shards of near-equal bytes, tokens and rows by vector bin packing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import partitions, stored, utf8_bytes


def place(vectors: np.ndarray, bins: int, weights: tuple[float, ...] = (64.0, 1.0, 1.0)) -> np.ndarray:
    """The bin of every vector of (bytes, tokens, rows): most bytes first, each where its dot product with the room that is left is highest.

    Room is counted in shares of each resource's total, so that no unit weighs more than another; `weights` then put the
    resource of the law first. Equal products go to the lowest bin. Room turns negative when a bin is over its share.
    """
    total = np.maximum(vectors.sum(axis=0), 1)
    shares = vectors / total
    room = np.full((bins, vectors.shape[1]), 1 / bins)
    chosen = np.zeros(len(vectors), np.int64)
    pull = shares * np.array(weights)
    for k in np.argsort(-shares[:, 0], kind="stable").tolist():
        best = int((room @ pull[k]).argmax())
        room[best] -= shares[k]
        chosen[k] = best
    return chosen


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", cell_rows: int = 50_000, split: int = 64) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard, tokens) for every row, by the law `bytes`.

    A group is the rows of equal texts; null is a group of its own. A group is placed whole unless it has more than
    1 / (`shards` * `split`) of all bytes or rows: then it is dealt by key into parts under that, since it could not be balanced
    otherwise. Groups are dealt by a hash into cells of about `cell_rows` rows; each cell packs its groups over
    all shards, with a shard numbering of its own, so cells are balanced one by one and their remainders do not add up. Slots count
    from 0 inside a shard without gaps. Rows that repeat a key are rows of their own.
    """
    kind = docs.schema[key].dataType.simpleString()
    text_crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = stored(
        docs.select(
            F.col(key).alias("__key"), (utf8_bytes(text) + 1).alias("size"), text_crc.alias("text_crc32"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long").alias("tokens"),
            F.xxhash64(F.col(text), F.col(text).isNull(), text_crc).alias("__group"),
        ),
        "sizes",
    )
    groups = rows.groupBy("__group", "text_crc32", "size").agg(F.count(F.lit(1)).alias("__rows"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).first()
    n, size = max(1, whole.n), max(1, whole.b or 0)
    share = F.greatest(F.col("__rows") / F.lit(n), F.col("__rows") * F.col("size") / F.lit(size)) * F.lit(shards * split)
    large = groups.where((share > 1) & (F.col("__rows") > 1)).select("__group", "text_crc32", "size", F.ceil(share).cast("long").alias("__parts"))
    # at most 2 * shards * split groups are over the limit, so this side is bounded
    rows = rows.join(F.broadcast(large), ["__group", "text_crc32", "size"], "left")
    part = F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("__key"), F.col("__parts")))
    cells = max(1, -(-n // cell_rows))
    rows = rows.withColumn("__group", F.xxhash64("__group", "text_crc32", "size", part))
    rows = rows.withColumn("__cell", F.pmod(F.xxhash64("__group"), F.lit(cells)).cast("int"))

    def fill(t: pa.Table) -> pa.Table:
        cell = t.column("__cell")[0].as_py()
        t = t.sort_by([("__key", "ascending")])
        size, tokens = (t.column(c).to_numpy().astype(np.float64) for c in ("size", "tokens"))
        group, inverse = np.unique(t.column("__group").to_numpy(), return_inverse=True)
        vectors = np.stack([np.bincount(inverse, w, len(group)) for w in (size, tokens, np.ones(len(size)))], axis=1)
        shard = ((place(vectors, shards) + cell) % shards)[inverse]
        order = np.argsort(shard, kind="stable")
        at = np.empty(len(shard), np.int64)
        at[order] = np.arange(len(shard)) - np.searchsorted(shard[order], shard[order])
        return t.select(["__key", "size", "text_crc32", "tokens", "__cell"]).append_column("shard", pa.array(shard.astype(np.int32))).append_column("__at", pa.array(at))

    placed = stored(
        rows.select("__key", "size", "text_crc32", "tokens", "__group", "__cell").repartition(max(cells, 1), "__cell").groupBy("__cell")
        .applyInArrow(fill, f"__key {kind}, size long, text_crc32 long, tokens long, __cell int, shard int, __at long"),
        "placed",
    )
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "__cell").agg(F.count(F.lit(1)).alias("__n"))  # a row per cell and shard
    starts = counts.select("shard", "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    return placed.join(starts, ["shard", "__cell"]).select(
        F.col("__key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__from") + F.col("__at")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )

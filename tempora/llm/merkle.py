"""Merkle manifests of a table: trees per group under one root, of which only every few levels are stored.

A manifest keeps the leaves, in aligned blocks of `fanout ** stride`, and above them one node per block, again in blocks,
up to the root. Proofs come down from the root: a block makes its missing nodes anew from the descendants it stores,
emits the siblings on each child's path, and lets the nodes go. Blocks have a bounded size, so no task grows with a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import partitions, stored

#: One level of a path: what stands left and right of a node in its run, as hex digests without separators.
STEP = "struct<left: string, right: string>"


def sealed(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value so that no two rows of values read alike: `-` for null, else its length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return sealed(*(field(v) for v in values))


def _runs(items: Column, size: int) -> Column:
    """Neighbours in runs of `size`; the last run may be shorter."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda i: F.slice(items, i * size + 1, F.lit(size)))


def _risen(digests: Column, nodes: Column, fanout: int, levels: int) -> Column:
    """The nodes `levels` above some neighbours; a level with one node in its whole group is the last one."""
    for level in range(levels):
        above = F.transform(_runs(digests, fanout), lambda run: sealed(F.concat_ws("", run)))
        digests = F.when(nodes > fanout**level, above).otherwise(digests)
    return digests


def positions(rows: DataFrame, name: str) -> DataFrame:
    """`rows` (g, k, digest, ...) with `pos`, the place of each from 0 in its group by (k, digest), and `nodes`, the size of the group.

    Rows are sorted in ranges of (g, k, digest), so a group of any size is spread. A stored row keeps the number that its
    sorted range gave it; only a row per range and group is scanned to turn it into a place.
    """
    order = ["g", "k", "digest"]
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("__at", F.monotonically_increasing_id()), name).withColumn("__part", F.shiftright("__at", 33))
    counts = ranged.groupBy("g", "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy("g")
    before = F.sum("__n").over(group.orderBy("__part")) - F.col("__n")
    counts = counts.select(F.col("g").alias("__g"), F.col("__part").alias("__p"), (before - F.col("__first")).alias("__shift"), F.sum("__n").over(group).alias("nodes"))
    placed = ranged.join(counts, (F.col("g") == F.col("__g")) & (F.col("__part") == F.col("__p")))
    return placed.withColumn("pos", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__g", "__p", "__shift")


@dataclass
class Forest:
    """Trees by group. `levels`: (g, block, nodes, items) of every stored height, leaves first; `roots`: (g, digest)."""

    levels: list[DataFrame]
    roots: DataFrame
    fanout: int
    stride: int

    def parents(self, height: int, tops: DataFrame) -> DataFrame:
        """(g, block, path, ...) of the node that each block of a stored height rises to; `tops` has those of the roots."""
        width = self.fanout**self.stride
        ended = self.levels[height].where(F.col("nodes") <= width).select("g", "block").join(tops, "g")
        if height + 1 == len(self.levels):
            return ended
        carried = [c for c in tops.columns if c not in ("g", "path")]
        above = self.extracted(height + 1, tops).select("g", F.col("place").alias("block"), "path", *carried)
        return ended.select(above.columns).unionByName(above)

    def extracted(self, height: int, tops: DataFrame) -> DataFrame:
        """(g, place, item, path, ...) of every node of a stored height: the siblings from it up to the root of all.

        `tops` gives every group the path of its own root and columns to pass on.
        """
        carried = [c for c in tops.columns if c not in ("g", "path")]
        width = self.fanout**self.stride
        rows = self.levels[height].join(self.parents(height, tops), ["g", "block"]).withColumn("place", F.col("block") * width)
        for level in range(self.stride - 1, -1, -1):
            held = self.fanout**level
            digests = _risen(F.transform("items", lambda x: x.digest), F.col("nodes"), self.fanout, level)
            rows = rows.select("g", "place", "nodes", "path", *carried, digests.alias("run"), F.posexplode(_runs(F.col("items"), held)).alias("i", "own"))
            step = F.struct(F.concat_ws("", F.slice("run", F.lit(1), F.col("i"))).alias("left"), F.concat_ws("", F.slice("run", F.col("i") + 2, F.lit(self.fanout))).alias("right"))
            rows = rows.withColumn("path", F.when(F.col("nodes") > held, F.concat(F.array(step), "path")).otherwise(F.col("path")))
            rows = rows.withColumn("place", F.col("place") + F.col("i") * held).drop("run", "i").withColumnRenamed("own", "items")
        return rows.select("g", "place", F.col("items")[0].alias("item"), "path", *carried)


def forest(rows: DataFrame, name: str, fanout: int = 16, stride: int = 2) -> Forest:
    """Trees over rows (g, k, digest, ...), one a group, leaves in order of (k, digest), null keys first; `g` must not be null.

    Of all levels only every `stride`-th is stored, as one row per aligned block of `fanout ** stride` nodes, the leaves with
    all their columns. Levels are built until every group has one node.
    """
    width = fanout**stride
    placed = positions(rows, name)
    items = [c for c in placed.columns if c not in ("g", "nodes", "pos")]
    levels, roots = [], None
    while True:
        at = F.struct("pos", *items)
        blocks = placed.groupBy("g", F.floor(F.col("pos") / width).cast("long").alias("block")).agg(
            F.max("nodes").alias("nodes"), F.sort_array(F.collect_list(at)).alias("items")
        )
        blocks = stored(blocks, name)
        levels.append(blocks)
        digest = _risen(F.transform("items", lambda x: x.digest), F.col("nodes"), fanout, stride)[0].alias("digest")
        ended = blocks.where(F.col("nodes") <= width).select("g", digest)
        roots = ended if roots is None else roots.unionByName(ended)
        going = blocks.where(F.col("nodes") > width)
        placed = going.select("g", F.col("block").alias("pos"), F.ceil(F.col("nodes") / width).cast("long").alias("nodes"), digest)
        items = ["digest"]
        if going.isEmpty():
            return Forest(levels, roots, fanout, stride)


@dataclass
class Manifest:
    """Trees of the groups, and the tree over their roots in order of the group; `root` has one row (none without rows)."""

    groups: Forest
    top: Forest

    @property
    def root(self) -> DataFrame:
        return self.top.roots.select(F.col("digest").alias("root"))

    def proofs(self) -> DataFrame:
        """(group, k, leaf, carried columns, subroot, root, path) of every leaf; `path` has a step per level, the leaf's first."""
        above = self.top.roots.select("g", F.col("digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
        tops = self.top.extracted(0, above).select(F.col("item.k").alias("g"), F.col("item.digest").alias("subroot"), "root", "path")
        out = self.groups.extracted(0, stored(tops, "merkle-tops"))
        return out.select(F.col("g.group").alias("group"), F.col("item.*"), "subroot", "root", "path").withColumnRenamed("digest", "leaf").drop("pos")


def manifest(leaves: DataFrame, fanout: int = 16, stride: int = 2) -> Manifest:
    """The manifest of rows (group, k, digest, ...): per group the leaves by (k, digest), then the subroots by group, null first.

    A null group is a group, a null key stands first, equal rows are leaves of their own, and an empty table has no root.
    Columns besides the three are stored with the leaf and come back with its proof.
    """
    rest = [c for c in leaves.columns if c not in ("group", "k", "digest")]
    rows = leaves.select(F.struct("group").alias("g"), "k", "digest", *rest)
    groups = forest(rows, "merkle", fanout, stride)
    return Manifest(groups, forest(groups.roots.select(F.lit(0).alias("g"), F.col("g").alias("k"), "digest"), "merkle-top", fanout, stride))


def siblings(path: Column) -> Column:
    """The digests beside a path, level by level, left to right."""
    return F.concat_ws("", F.transform(path, lambda s: F.concat(s.left, s.right)))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda digest, step: sealed(step.left, digest, step.right))


#: A to Z to a to z, and nothing else.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def verified_documents(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), text: str = "text", every: int = 5) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, with every fifth row tampered with.

    Leaves are sha256 of `fields`; where `every` divides crc32 of the decimal key, A to Z of the text are lower-cased before
    the root is folded again from the leaf and its siblings. Null keys are never tampered with. Rows are read once; texts are not shuffled.
    """
    changed = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(every)) == 0
    values = [F.col(c) for c in fields]
    lowered = [F.translate(F.col(text), UPPER, UPPER.lower()) if c == text else F.col(c) for c in fields]
    leaves = docs.select(F.col(group).alias("group"), F.col(key).alias("k"), leaf_digest(values).alias("digest"), F.when(changed, leaf_digest(lowered)).alias("tampered"))
    found = manifest(stored(leaves, "leaves")).proofs()
    found = found.select(F.col("k").alias(key), "leaf", "subroot", "root", F.sha2(siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))

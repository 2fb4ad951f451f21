"""Similarity join on word n-grams: MinHash buckets, Bayesian pruning value by value, exact verification."""

from __future__ import annotations

from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import BYTE_VALUES, flat, gram_hashes, mix, partitions, slices, span_hashes, stored, word_spans
from tempora.llm.components import components

#: MinHash values of a set, and how many make a bucket key: a pair at 0.8 has no key in common with chance (1 - 0.8^4)^24 = 3e-6.
VALUES, BAND = 96, 4
#: Values compared between two looks at the posterior.
STEP = 16
#: Sets that one block of a large component holds.
BLOCK = 1024
_ODD = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(77_777_777_777)).astype(np.uint32) | np.uint32(1)
_TURN = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(1_234_567_891)).astype(np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the different n-grams of words of every text, sorted; fewer words than n are one gram, none are none."""
    starts, ends, before = word_spans(data, offsets)
    values = span_hashes(BYTE_VALUES[data], starts, ends)
    words = np.diff(before)
    count = np.where(words >= n, words - n + 1, 0)
    row = np.repeat(np.arange(len(words)), count)
    at = np.repeat(before[:-1], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    gram = gram_hashes(values, n)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        extra = span_hashes(values, before[short], before[short + 1]) ^ words[short].astype(np.uint64)
        row, gram = np.concatenate([row, short]), np.concatenate([gram, extra])
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    row, gram = row[fresh], gram[fresh]
    return gram, np.searchsorted(row, np.arange(len(words) + 1))


def signatures(gram: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values, a row of VALUES per set; those of an empty set are all the largest."""
    out = np.full((len(offsets) - 1, VALUES), 0xFFFFFFFF, np.uint32)
    has = np.flatnonzero(np.diff(offsets))
    if len(has):
        x = (gram >> np.uint64(32)).astype(np.uint32)
        for j in range(VALUES):
            out[has, j] = np.minimum.reduceat((x ^ _TURN[j]) * _ODD[j], offsets[has])
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """Bucket keys, a column for each BAND values; keys of different columns differ."""
    keys = np.zeros((len(signature), VALUES // BAND), np.uint64)
    for b in range(keys.shape[1]):
        key = np.full(len(signature), b + 1, np.uint64)
        for j in range(b * BAND, b * BAND + BAND):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ signature[:, j].astype(np.uint64))
        keys[:, b] = key
    return keys.view(np.int64)


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For n compared values, the fewest matches at which the chance of reaching `threshold` is `tolerance` or more.

    With a uniform prior the posterior of the similarity after m of n matches is Beta(m + 1, n - m + 1), and its chance
    of being at least t is that of at most m successes in n + 1 trials of chance t.
    """
    t, out = Fraction(str(threshold)), np.zeros(VALUES + 1, np.int64)
    for n in range(STEP, VALUES + 1, STEP):
        total, m = Fraction(0), -1
        while total < Fraction(str(tolerance)):
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def linked_pairs(sets: list[np.ndarray], sign: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i in left, j in right, i < j if both hold both) with Jaccard similarity of at least `threshold`.

    Candidates share a bucket key. After every STEP values the pairs whose posterior fell under `tolerance` go; for the rest
    the sets are compared exactly.
    """
    keys = band_keys(sign)
    same = np.zeros((len(left), len(right)), bool)
    for b in range(keys.shape[1]):
        same |= keys[left, b][:, None] == keys[right, b][None, :]
    if left is right:
        same &= np.tri(len(left), k=-1, dtype=bool).T
    i, j = (side[x] for side, x in zip((left, right), np.nonzero(same)))
    fewest, matches = least_matches(threshold, tolerance), np.zeros(len(i), np.int64)
    for n in range(STEP, VALUES + 1, STEP):
        if not len(i):
            break
        for a in range(0, len(i), 1 << 16):
            s = slice(a, a + (1 << 16))
            matches[s] += (sign[i[s], n - STEP : n] == sign[j[s], n - STEP : n]).sum(axis=1)
        stay = matches >= fewest[n]
        i, j, matches = i[stay], j[stay], matches[stay]
    if not len(i):
        return i, j
    size = np.array([len(s) for s in sets])
    used = np.unique(np.concatenate([i, j]))
    if len(i) <= 4 * len(used):
        common = np.array([np.isin(sets[a], sets[b], assume_unique=True).sum() for a, b in zip(i.tolist(), j.tolist())])
    else:
        common = _common(sets, used, i, j)
    t = Fraction(str(threshold))
    good = common * t.denominator >= (size[i] + size[j] - common) * t.numerator
    return i[good], j[good]


def _common(sets, used, i, j):
    """Sizes of the intersections of many pairs: products of incidence matrices, so many different n-grams at a time."""
    row = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used.tolist()])
    gram, column = np.unique(np.concatenate([sets[u] for u in used.tolist()]), return_inverse=True)
    place = np.zeros(int(used.max()) + 1, np.int64)
    place[used] = np.arange(len(used))
    often = np.bincount(column, minlength=len(gram)) > 1
    number = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(used), len(used)), np.float32)
    for a in range(0, int(often.sum()), 2048):
        x, y = np.searchsorted(column, [a, a + 2048])
        part = np.zeros((len(used), 2048), np.float32)
        part[row[x:y], column[x:y] - a] = 1
        total += part @ part.T
    return total[place[i], place[j]].astype(np.int64)


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """(__id, __h, __h2, __a, __b, size, keys) of every row: two hashes of its set of n-grams, and bucket keys with a set's first row in a task."""
    kind = docs.schema["__id"].dataType.simpleString()

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches, "__text"):
            gram, offsets = shingles(*flat(batch.column("__text")), n)
            pair = []
            for seed in (0x1234567, 0x89ABCDEF):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(gram + np.uint64(seed)))])
                pair.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
            size = np.diff(offsets)
            first = []
            for r, (a, b) in enumerate(zip(pair[0].tolist(), pair[1].tolist())):
                if size[r] and (a, b) not in seen:
                    seen.add((a, b))
                    first.append(r)
            keys: list[np.ndarray | None] = [None] * batch.num_rows
            if first:
                lists = band_keys(signatures(gram, offsets)[first])
                for r, x in zip(first, lists):
                    keys[r] = x
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("__id", "__h", "__h2")), pa.array(pair[0]), pa.array(pair[1]), pa.array(size.astype(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                names=["__id", "__h", "__h2", "__a", "__b", "size", "keys"],
            )

    fields = f"__id {kind}, __h long, __h2 long, __a long, __b long, size long, keys array<long>"
    return docs.select("__id", "__h", "__h2", "__text").mapInArrow(run, fields)


def features(docs: DataFrame, n: int) -> DataFrame:
    """(node, grams, signature) of (node, __text), a node once a task: the sorted n-grams and MinHash values as bytes."""

    def run(batches):
        seen: set[str] = set()
        for batch in slices(batches, "__text"):
            node, keep = batch.column("node").to_pylist(), []
            for r, x in enumerate(node):
                if x not in seen:
                    seen.add(x)
                    keep.append(r)
            if keep:
                batch = batch.take(pa.array(keep))
                gram, offsets = shingles(*flat(batch.column("__text")), n)
                sign = signatures(gram, offsets)
                grams = [gram[a:b].tobytes() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(grams, pa.binary()), pa.array([s.tobytes() for s in sign], pa.binary())], names=["node", "grams", "signature"])

    return docs.mapInArrow(run, "node string, grams binary, signature binary")


def compare_blocks(threshold: float, tolerance: float):
    """Links of the sets in a group of (component, low, high, block, node, copies, grams, signature) rows, component by component.

    Returns (node, links, other): links to be added for the node, weighted by the other's copies, and for a spanning forest
    of the linked sets one `other` per edge.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("component", "ascending"), ("node", "ascending")])
        names, comps = t.column("node").to_pylist(), t.column("component").to_pylist()
        block, copies = t.column("block").to_numpy(), t.column("copies").to_numpy()
        grams, signs = t.column("grams").to_pylist(), t.column("signature").to_pylist()
        low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
        out: list[tuple[str, int, str | None]] = []
        a = 0
        while a < len(names):
            b = a
            rows = []
            while b < len(names) and comps[b] == comps[a]:
                if not rows or names[b] != names[rows[-1]]:  # a node comes once from every task that met it
                    rows.append(b)
                b += 1
            a = b
            if len(rows) < 2:
                continue
            sets = [np.frombuffer(grams[r], np.uint64) for r in rows]
            sign = np.frombuffer(b"".join(signs[r] for r in rows), np.uint32).reshape(len(rows), VALUES)
            side = block[rows]
            left = np.flatnonzero(side == low)
            i, j = linked_pairs(sets, sign, left, left if low == high else np.flatnonzero(side == high), threshold, tolerance)
            weight = copies[rows]
            links = np.zeros(len(rows), np.int64)
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            root = list(range(len(rows)))

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, y in zip(i.tolist(), j.tolist()):
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((names[rows[x]], 0, names[rows[y]]))
            out += [(names[rows[k]], int(links[k]), None) for k in np.flatnonzero(links).tolist()]
        node, links, other = zip(*out) if out else ((), (), ())
        return pa.table({"node": pa.array(node, pa.string()), "links": pa.array(links, pa.int64()), "other": pa.array(other, pa.string())})

    return run


def similarity_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-9, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, n_links, class_key, __h, __h2) of every row; the last two are hashes of the text.

    Two texts are linked if their sets of word n-grams have Jaccard similarity of at least `threshold`; words are runs of bytes other than
    space and tab to carriage return. A text of fewer words than n has one gram, all of them; null and blank texts have none and no links.
    `n_links` counts linked rows. A class is what links join, directly or in steps; class_id is its least key (rows
    without links: their own), class_key tells classes apart even where keys repeat or are null.

    Equal sets are one node with a number of copies, so copies never meet each other. Nodes that share a bucket make up
    components; a component is compared in blocks of BLOCK nodes, each pair of blocks a task's group, and only sums and spanning edges leave it.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(key).alias("__id"), F.xxhash64(text).alias("__h"), F.xxhash64(F.lit(2), text).alias("__h2"), F.col(text).alias("__text"))
    node = F.concat_ws("-", F.hex("__a"), F.hex("__b"))
    rows = stored(sets_of(keyed, n), "sets").withColumn("node", F.when(F.col("size") > 0, node))
    buckets = rows.where(F.col("keys").isNotNull()).select("node", F.explode("keys").alias("bucket"))
    # stored, so that Spark joins two plain shuffles and can split a part with a very full bucket
    shared = stored(buckets.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").drop("most"), "buckets")
    labels = components(buckets.join(shared, "bucket").select(F.col("node").alias("u"), F.col("least").alias("v")))
    nodes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.min("__id").alias("least_id"), F.min(F.struct("__h", "__h2")).alias("t")
    )
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"))
    blocks = F.ceil(F.col("nodes") / BLOCK).cast("int")
    placed = labels.join(sizes, "label").join(nodes, "node").select("node", "label", "copies", "t.__h", "t.__h2", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    placed = stored(placed, "placed")  # texts meet it by a shuffle at every size, so that what a small table costs tells what a large one will
    found = features(keyed.select("__h", "__h2", "__text").join(placed.select("node", "__h", "__h2").hint("merge"), ["__h", "__h2"]).select("node", "__text"), n)
    dealt = found.join(placed.drop("__h", "__h2"), "node").withColumn("against", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "against"), F.greatest("block", "against")
    dealt = dealt.select(F.col("label").alias("component"), low.alias("low"), high.alias("high"), "block", "node", "copies", "grams", "signature", "blocks")
    shard = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(4 * partitions(spark))).cast("string")).otherwise(F.col("component"))
    links = stored(
        dealt.withColumn("shard", shard).drop("blocks")
        .groupBy("shard", "low", "high").applyInArrow(compare_blocks(threshold, tolerance), "node string, links long, other string"),
        "links",
    )
    joined = components(links.where(F.col("other").isNotNull()).select(F.col("node").alias("u"), F.col("other").alias("v")))
    sums = links.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.drop("t").join(joined, "node", "left").join(sums, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = known.groupBy("label").agg(F.min("least_id").alias("class_id"))
    known = known.join(least, "label").select("node", "label", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return rows.select("__id", "node", "__h", "__h2").join(known, "node", "left").select(
        F.col("__id").alias(key), F.coalesce("class_id", F.when(F.col("node").isNull(), F.col("__id"))).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("label").alias("class_key"), "__h", "__h2",
    )


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every class of similar texts, that of the least key; rows without words all stay."""
    hashes = {"__h": F.xxhash64(text), "__h2": F.xxhash64(F.lit(2), text), "__id": F.struct(F.col(key).alias("k"))}
    classes = similarity_classes(docs, n, threshold, key=key, text=text)
    least = classes.where(F.col("class_key").isNotNull() & F.col(key).eqNullSafe(F.col("class_id")))
    chosen = least.groupBy("class_key").agg(F.min(F.struct(F.struct(F.col(key).alias("k")).alias("__id"), "__h", "__h2")).alias("r")).select("r.*")
    keyed = docs.withColumns(hashes)
    first = keyed.join(chosen, ["__id", "__h", "__h2"]).dropDuplicates(["__id", "__h", "__h2"])  # equal rows are copies too
    blank = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return first.select(*docs.columns).unionByName(docs.where(blank))

"""Windows of a fixed width that start in more than one place: the plan that substring removal by bytes and by words share.

A sequence is a text's bytes or words. Every window of `width` items has one anchor: the k-gram in it whose hash is least, the first
of equals. Equal windows have equal anchors at equal offsets, so a window can only recur where its anchor does.

1. Anchors of every text are counted. 2. Texts meet the anchors that recur and cut out a segment around each: the run of
windows with that anchor. 3. Segments are dealt by anchor into shards; equal segments of a task travel once. A resolver finds, in each shard,
which windows recur. 4. Its answer returns to every place of the segment, and the places to their text.
No step keeps the rows of one anchor, segment or text together, except a shard: there only different segments of its anchors
meet, and an anchor with more than HOT places is dealt again by what surrounds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import BYTE_VALUES, flat, gram_hashes, slices, span_hashes, stored, word_spans

#: Longer sequences are worked on in pieces of so many windows.
CHUNK = 1 << 20
#: Places of an anchor from which its windows are divided by their surroundings.
HOT = 20_000
#: Anchors in a shard, about.
SHARD_ANCHORS = 16_384

Resolver = Callable[[list[bytes], np.ndarray, np.ndarray], list[list[int]]]


@dataclass(frozen=True)
class Kind:
    """Items of a sequence, the width of a window, the k of its anchor, and who decides in a shard.

    resolve(segments, starts, copies) returns for each segment the ranges of items [from, to, ...] that recurring windows cover;
    a segment's windows are its first `starts` ones, and `copies` (1 or 2) says whether the segment stands in more than one place.
    """

    words: bool
    width: int
    k: int
    resolve: Resolver

    def items(self, data: np.ndarray, offsets: np.ndarray):
        """(hash value of every item, items before each text, first byte and end byte of every item)."""
        if not self.words:
            at = np.arange(len(data))
            return BYTE_VALUES[data], offsets, at, at + 1
        starts, ends, before = word_spans(data, offsets)
        return span_hashes(BYTE_VALUES[data], starts, ends), before, starts, ends


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def runs(values: np.ndarray, offsets: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor, hash) of runs of windows that share an anchor, in order; shorter sequences have none."""
    parts = []
    for a in range(0, max(1, len(values)), CHUNK):
        b = min(len(values), a + CHUNK + width - 1)
        inside = np.clip(offsets, a, b) - a
        first, last, at, h = _runs(values[a:b], inside, width, k)
        parts.append((first + a, last + a, at + a, h))
        if b == len(values):
            break
    return tuple(np.concatenate(x) for x in zip(*parts))


def _runs(values, offsets, width, k):
    if len(values) < width:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64),)
    gram = gram_hashes(values, k)
    order = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    least = (sliding_min(order, width - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lengths = np.diff(offsets)
    has = lengths >= width
    heads = offsets[:-1][has]
    edge = np.zeros(len(values) + 1, np.int8)
    np.add.at(edge, heads, 1)
    np.add.at(edge, offsets[1:][has] - width + 1, -1)
    valid = np.cumsum(edge, dtype=np.int8)[: len(least)] > 0
    start = valid.copy()
    start[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    start[heads] = True
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | start[1:]
    first = np.flatnonzero(start)
    return first, np.flatnonzero(stop), least[first], gram[least[first]].view(np.int64)


def _twice(batch: pa.RecordBatch, seen: dict) -> pa.RecordBatch:
    """The rows of a batch without the third and later ones of a text in this task."""
    keep = []
    for h in batch.column("__h").to_pylist():
        n = seen[h] = seen.get(h, 0) + 1
        keep.append(n <= 2)
    return batch if all(keep) else batch.filter(pa.array(keep))


def anchor_lists(docs: DataFrame, kind: Kind) -> DataFrame:
    """(__key, anchors) of the texts that have a window; of equal texts at most two in a task."""

    def run(batches):
        seen: dict[int, int] = {}
        for batch in slices(batches, "__text"):
            batch = _twice(batch, seen)
            values, offsets, _, _ = kind.items(*flat(batch.column("__text")))
            first, _, _, h = runs(values, offsets, kind.width, kind.k)
            edges = np.searchsorted(first, offsets)
            has = np.flatnonzero(np.diff(edges))
            lists = pa.ListArray.from_arrays(pa.array(np.append(edges[has], len(h)).astype(np.int32)), pa.array(h))
            yield pa.RecordBatch.from_arrays([batch.column("__key").take(pa.array(has)), lists], names=["__key", "anchors"])

    return docs.select("__key", "__h", "__text").mapInArrow(run, "__key long, anchors array<long>")


def cut_segments(met: DataFrame, kind: Kind) -> DataFrame:
    """(__h, __h2, start, group, class, starts, segment) for every place of a recurring anchor in (__h, __h2, __text, anchors, hot).

    `class` stands for the segment's bytes; they travel with its first place in a task, the second has none.
    """

    def run(batches):
        seen: dict[int, int] = {}
        known: dict[int, int] = {}
        for batch in slices(batches, "__text"):
            batch = _twice(batch, seen)
            data, text_offsets = flat(batch.column("__text"))
            values, offsets, begin, end = kind.items(data, text_offsets)
            first, last, at, h = runs(values, offsets, kind.width, kind.k)
            row = np.searchsorted(offsets, first, "right") - 1
            wanted, hot = batch.column("anchors"), batch.column("hot")
            recurs, heat = np.zeros(len(h), bool), np.zeros(len(h), bool)
            edges = np.searchsorted(first, offsets)
            for out, column in ((recurs, wanted), (heat, hot)):
                inner = column.values.to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, np.int64)
                bounds = column.offsets.to_numpy()
                for r in range(batch.num_rows):
                    a, b = edges[r], edges[r + 1]
                    if b > a and bounds[r + 1] > bounds[r]:
                        out[a:b] = np.isin(h[a:b], inner[bounds[r] : bounds[r + 1]])
            keep = np.flatnonzero(recurs)
            first, last, at, h, row, heat = (x[keep] for x in (first, last, at, h, row, heat))
            group = h.copy()
            if heat.any():
                first, last, h, row, group = _divide(values, first, last, at, h, row, heat, kind)
            raw = data.tobytes()
            low, high = begin[first].tolist() if len(first) else [], end[last + kind.width - 1].tolist() if len(first) else []
            starts = (last - first + 1).astype(np.int32)
            classes, segments = [], []
            for a, b, n in zip(low, high, starts.tolist()):
                segment = raw[a:b]
                c = int.from_bytes(hashlib.blake2b(segment, digest_size=8, salt=n.to_bytes(8, "little")).digest(), "little", signed=True)
                classes.append(c)
                have = known.get(c, 0)
                segments.append(segment if not have else b"" if have == 1 else None)
                if have < 2:
                    known[c] = have + 1
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__h").take(rows), batch.column("__h2").take(rows), pa.array((first - offsets[row]).astype(np.int64)), pa.array(group),
                 pa.array(classes, pa.int64()), pa.array(starts), pa.array(segments, pa.binary())],
                names=["__h", "__h2", "start", "group", "class", "starts", "segment"],
            )

    return met.select("__h", "__h2", "__text", "anchors", "hot").mapInArrow(run, "__h long, __h2 long, start long, group long, class long, starts int, segment binary")


def _divide(values, first, last, at, h, row, heat, kind):
    """Runs of hot anchors in blocks by the distance from a window's start to its anchor; a block's group also holds the hash of the
    items that all its windows share, so that places with other surroundings part."""
    block = max(1, kind.width // 8)
    out = []
    for f, l, p, x, r, hot in zip(first.tolist(), last.tolist(), at.tolist(), h.tolist(), row.tolist(), heat.tolist()):
        if not hot:
            out.append((f, l, x, r, -1, -1))
            continue
        for j in range((p - l) // block, (p - f) // block + 1):
            a, b = max(f, p - (j + 1) * block + 1), min(l, p - j * block)
            out.append((a, b, x, r, p - j * block, p - (j + 1) * block + 1 + kind.width))
    first, last, h, row, low, high = (np.array(x, np.int64) for x in zip(*out))
    group = h.copy()
    hot = np.flatnonzero(low >= 0)
    # a run can end at its text's edge before the block does: what is shared is counted from the windows' side of the anchor only
    low[hot], high[hot] = np.maximum(low[hot], 0), np.minimum(high[hot], len(values))
    shared = span_hashes(values, low[hot], high[hot]).view(np.int64)
    group[hot] ^= shared
    return first, last, h, row, group


def resolve_shards(segments: DataFrame, shards: int, kind: Kind) -> DataFrame:
    """(group, class, cover): the ranges of items in a segment that recurring windows cover, for segments with any."""

    def run(t: pa.Table) -> pa.Table:
        classes, groups, starts = (t.column(c).to_numpy() for c in ("class", "group", "starts"))
        texts = t.column("segment").to_pylist()
        _, index, inverse, n = np.unique(np.stack([groups, classes], axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
        chosen = index.copy()
        for k, i in enumerate(inverse.ravel().tolist()):
            if texts[k]:
                chosen[i] = k
        covers = kind.resolve([texts[k] for k in chosen.tolist()], starts[chosen].astype(np.int64), np.minimum(n, 2))
        some = [k for k, c in enumerate(covers) if c]
        at = chosen[some] if some else np.zeros(0, np.int64)
        return pa.table({"group": pa.array(groups[at]), "class": pa.array(classes[at]), "cover": pa.array([covers[k] for k in some], pa.list_(pa.int32()))})

    shard = F.pmod(F.xxhash64("group"), F.lit(shards))
    dealt = segments.where(F.col("segment").isNotNull()).select(shard.alias("shard"), "group", "class", "starts", "segment")
    return dealt.groupBy("shard").applyInArrow(run, "group long, class long, cover array<int>")


def covered(docs: DataFrame, kind: Kind, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with __places: (start, cover) of every segment with recurring windows, null where a text has none."""
    spark = docs.sparkSession
    # rows of one key share a list of recurring anchors, which does no harm; numbers compress better than hashes
    whole = docs.schema[key].dataType.typeName() in ("long", "integer", "short", "byte")
    number = F.coalesce(F.col(key).cast("long"), F.lit(0)) if whole else F.xxhash64(key)
    keyed = docs.withColumns({"__key": number, "__h": F.xxhash64(text), "__h2": F.xxhash64(F.lit(2), text), "__text": F.col(text)})
    lists = stored(anchor_lists(keyed, kind), "anchors")
    places = lists.select("__key", F.explode("anchors").alias("h"))
    total = lists.agg(F.sum(F.size("anchors"))).first()[0] or 0
    # stored, so that Spark joins two plain shuffles and can split a part with a very common anchor
    recurring = stored(places.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "recurring")
    wanted = places.join(recurring.hint("merge"), "h").groupBy("__key").agg(
        F.collect_set("h").alias("anchors"), F.collect_set(F.when(F.col("n") > HOT, F.col("h"))).alias("hot")
    )
    met = keyed.select("__key", "__h", "__h2", "__text").join(wanted.hint("merge"), "__key")
    segments = stored(cut_segments(met, kind), "segments")
    found = resolve_shards(segments, max(1, -(-total // SHARD_ANCHORS)), kind)
    back = segments.select("__h", "__h2", "start", "group", "class").join(found, ["group", "class"])
    by_text = stored(back.groupBy("__h", "__h2").agg(F.collect_list(F.struct("start", "cover")).alias("__places")), "covers")  # as above, for a very common text
    return keyed.drop("__key", "__text").join(by_text.hint("merge"), ["__h", "__h2"], "left").drop("__h", "__h2")


def union_ranges(places: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of items that the covers of a text's places make up, in order."""
    spans = sorted((p["start"] + c[k], p["start"] + c[k + 1]) for p in places or () for c in (p["cover"],) for k in range(0, len(c), 2))
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def starts_to_ranges(hit: np.ndarray, width: int) -> list[int]:
    """[from, to, ...] of the items covered by windows of `width` that start where `hit` is set."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > width)
    first, last = at[np.append(0, gap + 1)], at[np.append(gap, len(at) - 1)]
    return np.stack([first, last + width], axis=1).ravel().tolist()

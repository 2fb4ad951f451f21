"""Removal of repeated byte strings with suffix arrays built by two-stage sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tempora.llm.common import others, slices
from tempora.llm.repeats import Kind, covered, starts_to_ranges, union_ranges


def suffix_array(data: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Starts of all suffixes of `data`, or those `wanted`, in the order of their first `depth` bytes at least.

    Two stages: a suffix that is smaller than its successor (the suffix one byte later) is sorted directly, bucket by first byte.
    All others follow from a scan of the buckets in order: when a suffix is met, the one a byte earlier, if greater than
    it, takes the next free place at the front of its own bucket. Of suffixes that are not wanted only those come along that
    wanted ones follow from: from a wanted one on to the first that is sorted directly.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int32)
    change = np.append(np.flatnonzero(data[1:] != data[:-1]), n - 1)
    rises = np.append(data[change[:-1]] < data[change[:-1] + 1], False)
    smaller = np.repeat(rises, np.diff(np.append(-1, change)))
    needed = np.ones(n, bool)
    if wanted is not None:
        needed = wanted.copy()
        last = np.flatnonzero(wanted & ~smaller & ~np.append(wanted[1:], False))  # they follow from an unwanted one
        direct = np.append(np.flatnonzero(smaller), n - 1)
        until = direct[np.searchsorted(direct, last)]
        reach = np.zeros(n + 1, np.int32)
        np.add.at(reach, last, 1)
        np.add.at(reach, until + 1, -1)
        needed |= np.cumsum(reach[:-1]) > 0
    direct = np.flatnonzero(smaller & needed)
    direct = direct[np.argsort(data[direct], kind="stable")]
    edges = np.concatenate([[0], np.cumsum(np.bincount(data[direct], minlength=256))])
    start = np.concatenate([[0], np.cumsum(np.bincount(data[needed], minlength=256))])
    order = np.zeros(start[-1], np.int32)
    text = data.tobytes().decode("latin-1")
    for c in range(256):
        if edges[c + 1] > edges[c]:
            bucket = direct[edges[c] : edges[c + 1]].tolist()
            bucket.sort(key=lambda i: text[i : i + depth])
            order[start[c + 1] - len(bucket) : start[c + 1]] = bucket
    front = start[:-1].copy()
    follows = needed & ~smaller

    def induce(met: np.ndarray) -> None:
        before = met[met > 0] - 1
        before = before[follows[before]]
        if len(before):
            first = data[before]
            dealt = np.argsort(first, kind="stable")
            count = np.bincount(first, minlength=256)
            begin = np.cumsum(count) - count
            first = first[dealt]
            order[front[first] + np.arange(len(first)) - begin[first]] = before[dealt]
            np.add(front, count, out=front)

    if needed[n - 1]:
        order[front[data[-1]]] = n - 1
        front[data[-1]] += 1
    for c in range(256):
        at = start[c]
        while at < front[c]:  # greater suffixes of this bucket, those that repeat its byte in further rounds
            at, until = front[c], at
            induce(order[until:at])
        if edges[c + 1] > edges[c]:
            induce(order[start[c + 1] - (edges[c + 1] - edges[c]) : start[c + 1]])
    return order if wanted is None else order[wanted[order]]


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of every suffix in `order` with the one before it; 0 for the first. Exact below `depth`.

    In text order a common prefix is the previous one less one byte if the bytes before both suffixes are equal; only the
    others are compared, eight bytes at a time.
    """
    n = len(data)
    if len(order) < 2:
        return np.zeros(len(order), np.int64)
    prior = np.full(n, -1, np.int64)
    prior[order[1:]] = order[:-1]
    at = np.arange(1, n)
    follows = np.zeros(n, bool)
    p = prior[1:]
    follows[1:] = (p > 0) & (prior[:-1] == p - 1) & (data[at - 1] == data[p - 1])
    fresh = np.flatnonzero(~follows & (prior >= 0))
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray((n + 8,), "<u8", padded.tobytes(), strides=(1,))
    a, b, live = fresh, prior[fresh], fresh
    size = np.zeros(n, np.int64)
    done = 0
    while len(live):
        room = n - np.maximum(a, b) - done  # bytes left in the text
        x = words[np.minimum(a + done, n)] ^ words[np.minimum(b + done, n)]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, (np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64)) >> 3)
        same = np.minimum(same, np.maximum(room, 0))
        size[live] += same
        on = same == 8
        a, b, live = a[on], b[on], live[on]
        done += 8
    # carry on from the last compared position
    at = np.arange(n)
    compared = np.maximum.accumulate(np.where(follows, 0, at))
    lengths = np.maximum(size[compared] - (at - compared), 0)
    lengths[prior < 0] = 0
    return lengths[order]


def resolver(width: int):
    """Ranges of bytes in segments that are covered by strings of `width` bytes with two starts or more."""

    def resolve(segments: list[bytes], starts: np.ndarray, copies: np.ndarray) -> list[list[int]]:
        texts = [s for s, c in zip(segments, copies.tolist()) for _ in range(c)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.cumsum([0, *map(len, texts)])[:-1]
        valid = np.zeros(len(data) + 1, np.int8)
        n = np.repeat(starts, copies)
        np.add.at(valid, begin, 1)
        np.add.at(valid, begin + n, -1)
        valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
        order = suffix_array(data, width, valid)
        run = np.cumsum(common_prefixes(data, order, width) < width)
        hit = np.zeros(len(data), bool)
        hit[order] = np.bincount(run)[run] > 1
        first = begin[np.cumsum(copies) - copies]
        return [starts_to_ranges(hit[a : a + k], width) for a, k in zip(first.tolist(), starts.tolist())]

    return resolve


def byte_kind(width: int = 200) -> Kind:
    return Kind(words=False, width=width, k=max(1, min(32, width // 4)), resolve=resolver(width))


def removals(docs: DataFrame, width: int = 200, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """`docs` with n_bytes, n_removed, n_spans and kept_sha256 after every byte inside a repeated string of `width` bytes went.

    Texts are UTF-8 bytes and null is empty; strings are judged on the input and never cross texts; a string that overlaps
    its own repetition counts. With `keep_text` the text column holds what is left (a null stays null) as UTF-8, without
    the pieces of characters that were cut. A column that has one of the new names gives way.
    """
    kept = [c for c in others(docs, "n_bytes", "n_removed", "n_spans", "kept_sha256") if c != text or keep_text]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)

    def run(batches):
        for batch in slices(batches, text):
            rows, left = [], []
            raw = pc.fill_null(batch.column(text).cast(pa.large_binary()), b"")
            for whole, places in zip(raw.to_pylist(), batch.column("__places").to_pylist()):
                spans = union_ranges(places)
                edges = [0, *(x for s in spans for x in s), len(whole)]
                rest = b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2]))
                left.append(rest if keep_text else None)
                rows.append((len(whole), len(whole) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()))
            new = [pa.array(x) for x in zip(*rows)]
            columns = {c: batch.column(c) for c in kept}
            if keep_text:
                valid = batch.column(text).is_valid().to_pylist()
                columns[text] = pa.array([b.decode("utf-8", "ignore") if v else None for b, v in zip(left, valid)], pa.string())
            yield pa.RecordBatch.from_arrays([*columns.values(), *new], names=[*kept, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = covered(docs, byte_kind(width), key, text)
    return found.mapInArrow(run, fields + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string")

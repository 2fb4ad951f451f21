"""Best-fit packing of token sequences, certified by lower bounds and repacked where the bound is missed."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import SPACE, flat, slices, stored, word_spans

#: Words of a memo inside a worker; it is emptied when full.
MEMO_WORDS = 1_200_000
#: Bytes of text whose words are looked up together.
STEP_BYTES = 1 << 22
#: Marks that always stand apart from letters and that no special token and no contraction has.
MARKS = ".,;:!?#$%&*+=~^@()[]{}/\\\"-_`"
_coders: dict[str, "WordCoder"] = {}


class WordCoder:
    """Token ids of texts by a word-based BPE tokenizer file, with a memo of words.

    White space separates tokens in these tokenizers and is dropped, so the ids of a text are those of its
    parts between white space in turn. A part is looked up once per step, however often it stands there. One of plain letters
    between marks is three units of the model: marks, letters and marks; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: The model reads bytes as letters of its own; those of ASCII letters are the same.
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = str.maketrans({c: "".join(x for x, _ in spell(c)) for c in map(chr, range(0x80, 0x100)) if c.isalpha()})
        self.marks: dict[str, bytes] = {"": b""}
        self.memo: dict[str, bytes] = {}

    def alone(self, part: str) -> bytes:
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def around(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) > MEMO_WORDS:
                self.marks = {"": b""}
            self.marks[marks] = self.alone(marks)
        return self.marks[marks]

    def learn(self, parts: list[str]) -> None:
        if len(self.memo) + len(parts) > MEMO_WORDS:
            self.memo = {}
        memo, unit = self.memo, self.tokenizer.model.tokenize
        for part in parts:
            inner = part.lstrip(MARKS)
            core = inner.rstrip(MARKS)
            if core.isalpha() and (core.isascii() or max(core) < "Ā"):
                low = core.lower()
                ids = memo.get(low)
                if ids is None:
                    found = [t.id for t in unit(low if low.isascii() else low.translate(self.letters))]
                    ids = memo[low] = struct.pack(f"<{len(found)}I", *found)
                if len(core) < len(part):
                    ids = self.around(part[: len(part) - len(inner)]) + ids + self.around(inner[len(core) :])
                memo[part] = ids
            else:
                memo[part] = self.alone(part)

    def known(self, parts: list[str]) -> list[bytes]:
        found = list(map(self.memo.get, parts))
        new = [k for k, ids in enumerate(found) if ids is None]
        if new:
            self.learn([parts[k] for k in new])
            for k in new:
                found[k] = self.memo[parts[k]]
        return found

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's) of a text column; null is empty."""
        data, offsets = flat(column)
        counts, out, ends = np.zeros(len(offsets), np.int64), [], [0]
        for low, high in self._steps(data):
            some = data[low:high]
            starts, stops, before = word_spans(some, np.clip(offsets, low, high) - low)
            if not len(starts):
                continue
            inside = np.zeros(len(some) + 1, np.int8)
            inside[starts] += 1
            inside[stops] -= 1
            spelled = some[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
            edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(stops - starts)])
            words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(spelled)).dictionary_encode()
            found = self.known(words.dictionary.to_numpy(zero_copy_only=False).tolist())
            size = np.array([len(x) // 4 for x in found], np.int64)
            first = np.cumsum(size) - size
            which = words.indices.to_numpy()
            length = size[which]
            last = np.cumsum(length)
            ids = np.frombuffer(b"".join(found), "<u4")
            out.append(ids[np.repeat(first[which] - (last - length), length) + np.arange(last[-1])])
            counts += np.concatenate([np.zeros(1, np.int64), last])[before]
        return np.concatenate(out) if out else np.zeros(0, np.uint32), counts

    @staticmethod
    def _steps(data: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of about STEP_BYTES; all but the last end behind white space."""
        low = 0
        while low < len(data):
            high = low + STEP_BYTES
            while high < len(data):
                blank = np.flatnonzero(SPACE[data[high : high + 4096]])
                if len(blank):
                    high += int(blank[0]) + 1
                    break
                high += 4096
            high = min(high, len(data))
            yield low, high
            low = high


def coder(path: str) -> WordCoder:
    """One coder per worker and file."""
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32): token sequences of every whole text, longer ones cut at `capacity`.

    A null text is empty; every text has `end_id` after its ids, so an empty one is one token long.
    Rows with equal keys are separate documents.
    """
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches):
        for batch in slices(batches, text, STEP_BYTES):
            ids, offsets = coder(path).ids(batch.column(text))
            ids = np.insert(ids, offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
            rows, number, start, length, crc = [], [], [], [], []
            for row, (low, high) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                for k, a in enumerate(range(low, high, capacity)):
                    part = ids[a : min(a + capacity, high)]
                    rows.append(row), number.append(k), start.append(a - low), length.append(len(part)), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(key, text).mapInArrow(cut, f"{key} {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of every item and the free space of every bin; items go longest first into the fullest bin they fit."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[int] = []
    by_free: dict[int, list[int]] = {}
    present = 0  # bit f: some bin has f free
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        above = present >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            stack = by_free[room]
            chosen = stack.pop()
            if not stack:
                present &= ~(1 << room)
        else:
            room, chosen = capacity, len(free)
            free.append(capacity)
        bins[item], offsets[item] = chosen, capacity - room
        left = free[chosen] = room - size
        if left:
            by_free.setdefault(left, []).append(chosen)
            present |= 1 << left
    return bins, offsets, np.array(free, np.int64)


def dual_function(count: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(value by length, value of a full bin): of two families of dual feasible functions the one that asks for most bins.

    `count` has the number of items of every length from 0 to `capacity`. No bin holds more value than a full one, whatever is in it.
    """
    count = count.astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    items, mass = np.cumsum(count), np.cumsum(count * sizes)
    best, function = -(-int(mass[-1]) // capacity), (sizes, capacity)
    low = np.arange(1, capacity // 2 + 1)  # items under `low` count nothing, those over capacity - low a whole bin
    if len(low):
        bins = items[-1] - items[capacity - low] + -(-(mass[capacity - low] - mass[low - 1]) // capacity)
        k = int(bins.argmax())
        if bins[k] > best:
            value = np.where(sizes < low[k], 0, np.where(sizes > capacity - low[k], capacity, sizes))
            best, function = int(bins[k]), (value, capacity)
    for k in range(1, 33):  # sizes rounded down to multiples of capacity / k, exact multiples of capacity / (k + 1) kept
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        bins = -(-int(count @ value) // (capacity * k))
        if bins > best:
            best, function = bins, (value, capacity * k)
    return function


def bins_asked(count: np.ndarray, function: tuple[np.ndarray, int]) -> int:
    value, whole = function
    return -(-int(count.astype(np.int64) @ value) // whole)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing needs fewer bins."""
    count = np.bincount(lengths, minlength=capacity + 1)
    return bins_asked(count, dual_function(count, capacity))


def cell_packer(length: str, capacity: int, level: int, slack: int, last: bool, function: tuple[np.ndarray, int]):
    """The packing of one cell as a function of its rows; all bins stay where they are as few as `function` asks for."""

    def fill(t: pa.Table) -> pa.Table:
        cell = t.column("__cell")[0].as_py()
        sizes = t.column(length).to_numpy().astype(np.int64)
        bins, offset, free = best_fit_decreasing(sizes, capacity)
        certified = len(free) == lower_bound(sizes, capacity)
        done = last or len(free) == bins_asked(np.bincount(sizes, minlength=capacity + 1), function)
        full = np.ones(len(free), bool) if done else free <= slack
        gaps = int((~full).sum())
        if gaps:  # as many full bins go along, those of the most items, so that small ones are there to fill gaps
            items = np.where(full, np.bincount(bins, minlength=len(free)), -1)
            full[np.argsort(-items, kind="stable")[: min(gaps, int(full.sum()))]] = False
        stay = full[bins]
        sequence = (level << 56) + (cell << 28) + bins
        t = t.drop_columns(["__cell"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        return t.append_column("certified", pa.array(np.full(len(sizes), certified))).append_column("__stays", pa.array(stay))

    return fill


def length_counts(items: DataFrame, length: str, capacity: int) -> np.ndarray:
    """The number of items of every length from 0 to `capacity`."""
    out = np.zeros(capacity + 1, np.int64)
    for size, n in items.groupBy(length).agg(F.count(F.lit(1))).collect():
        out[size] = n
    return out


def pack(items: DataFrame, capacity: int = 4096, length: str = "length", cell_items: int = 100_000, slack: int = 8, fan_in: int = 8) -> DataFrame:
    """`items` with sequence_id, offset and certified: all of them in few sequences of at most `capacity`.

    Items are dealt by a hash into cells of about `cell_items`, and each cell packs best-fit decreasing. The dual feasible
    function that gives the lower bound of all items of the round is the certificate: a cell with as few bins as it asks for keeps
    them all, so that such cells together are over that bound by less than a bin each. (A cell's own bound can be higher where the cell
    drew more large items; then small ones of other cells still fill its gaps.) In the others, bins with at most `slack` free stay.
    The items of the rest, and of as many full bins of small items, are dealt again into cells of up to about
    `fan_in` times as many items, their number taken from the count of those left. Rounds end with one cell, or where less than one
    cell of `fan_in` was saved; all bins of the last round stay.
    `certified`: the cell that packed the row reached its lower bound. An empty input gives no rows. Lengths must be 1 to `capacity`.
    """
    kept, level = [], 0
    names = items.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    count = length_counts(items, length, capacity)
    before = None
    while before is None or count.any():
        cells = max(1, -(-int(count.sum()) // (cell_items if before is None else cell_items * fan_in)))
        last = cells == 1 or before is not None and fan_in * cells > (fan_in - 1) * before
        before = cells
        dealt = items.withColumn("__cell", F.pmod(F.xxhash64(*names, F.lit(level)), F.lit(cells)))
        packed = dealt.groupBy("__cell").applyInArrow(cell_packer(length, capacity, level, slack, last, dual_function(count, capacity)), fields + ", sequence_id long, offset long, certified boolean, __stays boolean")
        packed = stored(packed, "packed")
        kept.append(packed.where("__stays").drop("__stays"))
        if last:
            break
        items, level = packed.where("not __stays").select(*names), level + 1
        count = length_counts(items, length, capacity)
    result = kept[0]
    for more in kept[1:]:
        result = result.unionByName(more)
    return result


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified."""
    return pack(stored(pieces(docs, path, capacity, end_id), "pieces"), capacity)

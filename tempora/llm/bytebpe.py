"""Byte-level BPE of whole tables: every distinct word is encoded once, wherever it stands; decoding joins the token-byte table."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import BYTE_VALUES, others, result_batch, slices, span_hashes
from tempora.llm.common import flat as flat_text

#: Bytes of text of a block, inside which a word travels once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 23
#: Bundles of words that are encoded together, and texts that leave a task together.
BUNDLES, TEXTS = 256, 256
#: Words or tokens that one step inside a block works on.
STEP = 1 << 17
BUNDLE = pa.struct([("bucket", pa.int32()), ("words", pa.binary()), ("lengths", pa.binary())])
_ranks: dict[str, dict[bytes, int]] = {}
_coders: dict[str, "tiktoken.Encoding"] = {}
_splitters: dict[str, "Splitter"] = {}
_tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def ranks(path: str) -> dict[bytes, int]:
    """The bytes of every token and its rank, from a file of base64 and rank a line; read once per worker."""
    if path not in _ranks:
        with open(path, "rb") as lines:
            _ranks[path] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return _ranks[path]


class Splitter:
    """The matches of a pattern in a text, with the character classes of the tokenizer library.

    The library and the `regex` module know different versions of Unicode. A text with a code point that they class
    differently is matched on a copy where stand-ins of the library's class take the place of such code points.
    """

    #: A pattern and a stand-in for each class that tokenizer patterns tell apart, and a stand-in for all others.
    CLASSES = {r"\s": " ", r"\p{L}": "ß", r"\p{N}": "٣"}
    OTHER = "\ue000"

    def __init__(self, pattern: str):
        import regex
        import tiktoken

        self.find = regex.compile(pattern)
        single = {bytes([i]): i for i in range(256)}
        points = np.arange(0x110000, dtype="<u4")
        every = points[(points < 0xD800) | (points > 0xDFFF)].tobytes().decode("utf-32-le")
        theirs, odd = {}, np.zeros(0x110000, bool)
        for name in self.CLASSES:
            matches = tiktoken.Encoding("class", pat_str=name + "+", mergeable_ranks=single, special_tokens={})
            theirs[name] = self._points(bytes(matches.encode_ordinary(every)).decode())
            odd |= theirs[name] != self._points("".join(regex.findall(name + "+", every)))
        odd = np.flatnonzero(odd).tolist()
        self.stand_in = {c: next((s for n, s in self.CLASSES.items() if theirs[n][c]), self.OTHER) for c in odd}
        self.odd = frozenset(map(chr, odd))
        self.high = regex.compile(f"[{chr(odd[0])}-\U0010ffff]") if odd else regex.compile(r"(?!)")

    @staticmethod
    def _points(text: str) -> np.ndarray:
        """Which code points a text has."""
        out = np.zeros(0x110000, bool)
        out[np.frombuffer(text.encode("utf-32-le"), "<u4")] = True
        return out

    def words(self, text: str) -> Iterator[str]:
        if text.isascii() or not self.high.search(text) or self.odd.isdisjoint(text):
            return self.find.findall(text) if len(text) < STEP else (m.group() for m in self.find.finditer(text))
        return (text[m.start() : m.end()] for m in self.find.finditer(text.translate(self.stand_in)))


def splitter(pattern: str) -> Splitter:
    """One splitter per worker and pattern."""
    if pattern not in _splitters:
        _splitters[pattern] = Splitter(pattern)
    return _splitters[pattern]


def word_ids(words: list[str], path: str) -> list[bytes]:
    """Ids of words, each on its own, as little-endian 32-bit bytes."""
    if path not in _coders:
        import tiktoken

        _coders[path] = tiktoken.Encoding("word", pat_str=r"(?s).+", mergeable_ranks=ranks(path), special_tokens={})
    encoded = _coders[path].encode_ordinary
    return [struct.pack(f"<{len(ids)}I", *ids) for ids in map(encoded, words)]


def _spans(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """data[low:high] of every pair, one after the other."""
    size = high - low
    ends = np.cumsum(size)
    return data[np.repeat(low - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _gathered(data: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    return _spans(data, offsets[which], offsets[which + 1])


def pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0 to 2^32 as compressed planes of their bytes, as many as the greatest needs."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    used = max((k + 1 for k in range(4) if planes[k].any()), default=1)
    return bytes([used]) + zstandard.compress(np.ascontiguousarray(planes[:used]).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u4").ravel()


def _arrow_bytes(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def spelled(docs: DataFrame, pattern: str, key: str, text: str, buckets: int) -> DataFrame:
    """(block, seal, keys, sizes, codes, dealt, bundles): blocks of documents as their distinct words and, word by word, places in that list.

    `seal` is a hash of the list, so that a block made anew of other rows is told apart. `sizes` has the number of words of each document of the block and `codes` the place of every word in a list by descending
    frequency. `dealt` says which of the `buckets` each word of the list belongs to, by a hash, and `bundles` has for each
    bucket its words in the order of the list. Numbers are packed.
    """

    def spell(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, text, BLOCK_BYTES):
            place: dict[str, int] = {}
            sizes, codes = [], []
            for one in pc.fill_null(batch.column(text), "").to_pylist():
                words, n = iter(splitter(pattern).words(one)), 0
                while some := list(islice(words, STEP)):
                    codes.append(np.array([place.setdefault(w, len(place)) for w in some], np.uint32))
                    n += len(some)
                sizes.append(n)
            flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
            order = np.argsort(-np.bincount(flat, minlength=len(place)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            listed = pa.array(list(place), pa.large_string()).take(pa.array(order))
            data, offsets = flat_text(listed)
            hashed = span_hashes(BYTE_VALUES[data], offsets[:-1], offsets[1:])
            dealt = (hashed % np.uint64(buckets)).astype(np.int64)
            by_bucket = np.argsort(dealt, kind="stable")
            edges = np.flatnonzero(np.diff(dealt[by_bucket], prepend=-1, append=-1)) if len(order) else np.zeros(1, np.int64)
            bundles = []
            for a, b in zip(edges, edges[1:]):
                some = by_bucket[a:b]
                words = _gathered(data, offsets, some)
                bundles.append({"bucket": int(dealt[some[0]]), "words": zstandard.compress(words.tobytes(), 1), "lengths": pack(offsets[some + 1] - offsets[some])})
            keys = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(key))
            seal = pa.array([int((hashed * (2 * np.arange(len(hashed), dtype=np.uint64) + np.uint64(1))).sum(dtype=np.uint64).view(np.int64))], pa.int64())
            packed = [_arrow_bytes([pack(x)]) for x in (np.array(sizes), rank[flat], dealt)]
            yield pa.RecordBatch.from_arrays([pa.array([number]), seal, keys, *packed, pa.array([bundles], pa.list_(BUNDLE))], names=["block", "seal", "keys", "sizes", "codes", "dealt", "bundles"])
            number += 1

    kind = docs.schema[key].dataType.simpleString()
    fields = "bundles array<struct<bucket: int, words: binary, lengths: binary>>"
    return docs.select(key, text).mapInArrow(spell, f"block long, seal long, keys array<{kind}>, sizes binary, codes binary, dealt binary, {fields}")


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row: token ids of the whole text as little-endian unsigned 32-bit integers; a null text is empty.

    Texts become words and their positions, block by block. The distinct words of all blocks are brought together by a shuffle on
    buckets of their hashes; in a bucket each is encoded once. Ids go back to the blocks, which put them together by
    position. A block names a word once however often it stands there, so the commonest word adds one entry a block
    to its bucket and no key is hot. Rows with equal keys are separate documents. No special tokens are recognised.
    The rows of a partition must have the same order whenever they are read, as those of files have.
    """
    kind = docs.schema[key].dataType.simpleString()
    buckets = max(256, min(1 << 16, 4 * docs.rdd.getNumPartitions()))
    own = ["block", "seal"]
    # one exchange holds the blocks for both of their readers, which take all of its columns so that Spark sees it is the same
    blocks = spelled(docs, pattern, key, text, buckets).repartition(*own)

    def unbundle(batches):
        for batch in batches:
            bundles = batch.column("bundles")
            size = np.diff(bundles.offsets.to_numpy())
            flat_bundles = bundles.flatten()
            yield result_batch(batch.select(own).take(pa.array(np.repeat(np.arange(batch.num_rows), size))), own, **{f.name: flat_bundles.field(f.name) for f in BUNDLE})

    bundles = blocks.mapInArrow(unbundle, "block long, seal long, bucket int, words binary, lengths binary")

    def each_once(batches):
        bucket, known = None, {}
        for batch in (b.slice(k, BUNDLES) for b in batches for k in range(0, b.num_rows, BUNDLES)):
            lengths, ids = [], []
            for row in batch.select(["bucket", "words", "lengths"]).to_pylist():
                if row["bucket"] != bucket:  # rows are sorted by bucket
                    bucket, known = row["bucket"], {}
                data, ends = zstandard.decompress(row["words"]), np.cumsum(unpack(row["lengths"]), dtype=np.int64).tolist()
                words = [data[a:b] for a, b in zip([0, *ends], ends)]
                new = [w for w in words if w not in known]
                known.update(zip(new, word_ids([w.decode() for w in new], path)))
                found = [known[w] for w in words]
                lengths.append(pack(np.array([len(x) // 4 for x in found])))
                ids.append(pack(np.frombuffer(b"".join(found), "<u4")))
            yield result_batch(batch, [*own, "bucket"], lengths=_arrow_bytes(lengths), ids=_arrow_bytes(ids))

    found = bundles.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(each_once, "block long, seal long, bucket int, lengths binary, ids binary")
    found = found.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("bucket", "lengths", "ids"))).alias("found"))

    def assemble(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # one block at a time
                row = batch.slice(k, 1).select(["sizes", "codes", "dealt", "found"]).to_pylist()[0]
                size = [unpack(x["lengths"]).astype(np.int64) for x in row["found"] or []]
                data = np.concatenate([unpack(x["ids"]) for x in row["found"]]) if size else np.zeros(0, np.uint32)
                size = np.concatenate(size) if size else np.zeros(0, np.int64)
                ends = np.cumsum(size)
                dealt, sizes = unpack(row["dealt"]), unpack(row["sizes"]).tolist()
                keys, done = batch.column("keys").slice(k, 1).flatten(), 0
                if len(dealt) != len(size):
                    raise RuntimeError("a block was made anew of other rows than before: store a table whose rows change places")
                # what came back is in order of buckets; a word's place among them is that of its bucket and its turn there
                low, high = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
                turn = np.argsort(dealt, kind="stable")
                low[turn], high[turn] = ends - size, ends
                codes, at, out = unpack(row["codes"]), 0, []
                del row
                for n in sizes:
                    steps = (codes[k : min(k + STEP, at + n)].astype(np.int64) for k in range(at, at + n, STEP))
                    out.append(b"".join(_spans(data, low[x], high[x]).tobytes() for x in steps))
                    at += n
                    if len(out) == TEXTS:
                        yield pa.RecordBatch.from_arrays([keys.slice(done, TEXTS), _arrow_bytes(out)], names=[key, "ids"])
                        done, out = done + TEXTS, []
                yield pa.RecordBatch.from_arrays([keys.slice(done), _arrow_bytes(out)], names=[key, "ids"])

    return blocks.join(found, own, "left").mapInArrow(assemble, f"`{key}` {kind}, ids binary")


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table by id: (bytes of all tokens, offsets); an id without a token has no bytes."""
    if path not in _tables:
        table = ranks(path)
        size = np.zeros(max(table.values()) + 1, np.int64)
        size[list(table.values())] = [len(t) for t in table]
        by_id = sorted(table, key=table.get)
        _tables[path] = np.frombuffer(b"".join(by_id), np.uint8), np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    return _tables[path]


def decode(rows: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """`rows` with the bytes that a column of 32-bit ids stands for: ids meet the token-byte table, which has a row per token and is held by each worker.

    A null stays null. An id that is not in the table stands for no bytes. A column named like `to` gives way.
    """
    kept = others(rows, to)

    def join(batches):
        data, offsets = token_bytes(path)
        last = len(offsets) - 2
        for batch in (b.slice(k, TEXTS) for b in batches for k in range(0, b.num_rows, TEXTS)):
            out = []
            for one in batch.column(ids).to_pylist():
                if one is None:
                    out.append(None)
                    continue
                which = np.frombuffer(one, "<u4").astype(np.int64)
                which = which[which <= last]
                out.append(b"".join(_gathered(data, offsets, which[k : k + STEP]).tobytes() for k in range(0, len(which), STEP)))
            yield result_batch(batch, kept, **{to: pa.array(out, pa.binary())})

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(join, f"{fields}, `{to}` binary")


def document_codes(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row: digests of the ids and of the bytes decoded from them."""
    both = decode(encode(docs, path, pattern, key, text), path)
    return both.select(key, F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Removal of repeated word windows: recurring passages are confirmed, compiled into automata and located."""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tempora.llm.common import gram_hashes, mix, others, slices
from tempora.llm.repeats import Kind, covered, union_ranges

#: The words of a shard stand for themselves as characters; those between these two code points are not characters.
_SURROGATES = 0xD800, 0x800


def spell(numbers: np.ndarray) -> str:
    """Word numbers as a string with a character for every word."""
    points = numbers + 1 + np.where(numbers + 1 >= _SURROGATES[0], _SURROGATES[1], 0)
    return points.astype("<u4").tobytes().decode("utf-32-le")


def resolver(width: int):
    """Ranges of words in segments that are covered by windows of `width` words with two starts or more."""

    def resolve(segments: list[bytes], starts: np.ndarray, copies: np.ndarray) -> list[list[int]]:
        number: dict[bytes, int] = {}
        words = [[number.setdefault(w, len(number)) for w in s.split()] for s in segments]
        sizes = np.array([len(w) for w in words])
        flat = np.fromiter((x for w in words for x in w), np.int64, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        # confirm: windows with equal hashes, compared word by word with the first of them
        start = np.repeat(begin, starts) + np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts)
        window = gram_hashes(mix(flat.astype(np.uint64)), width)[start]
        _, index, inverse = np.unique(window, return_index=True, return_inverse=True)
        lead = start[index][inverse]
        equal = np.ones(len(start), bool)
        for j in range(width):
            equal &= flat[start + j] == flat[lead + j]
        number_of = np.where(equal, inverse, len(index) + np.arange(len(start)))
        weight = np.bincount(number_of, np.repeat(copies, starts))
        recurs = np.zeros(len(flat), bool)
        recurs[start[weight[number_of] > 1]] = True
        # compile: every maximal passage of recurring windows, once
        automaton = ahocorasick.Automaton()
        strings = [spell(flat[a : a + n]) for a, n in zip(begin.tolist(), sizes.tolist())]
        for k, (a, n) in enumerate(zip(begin.tolist(), starts.tolist())):
            at = np.flatnonzero(recurs[a : a + n])
            if len(at):
                cut = np.flatnonzero(np.diff(at) > 1)
                for i, j in zip(at[np.append(0, cut + 1)].tolist(), at[np.append(cut, len(at) - 1)].tolist()):
                    automaton.add_word(strings[k][i : j + width], j + width - i)
        if not len(automaton):
            return [[] for _ in segments]
        automaton.make_automaton()
        # locate: every occurrence in every segment
        out = []
        for string in strings:
            spans: list[list[int]] = []
            for end, size in automaton.iter(string):
                a = end + 1 - size
                while spans and spans[-1][0] >= a:
                    spans.pop()
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = end + 1
                else:
                    spans.append([a, end + 1])
            out.append([x for s in spans for x in s])
        return out

    return resolve


def word_kind(width: int = 35) -> Kind:
    return Kind(words=True, width=width, k=max(1, width // 5), resolve=resolver(width))


def removals(docs: DataFrame, width: int = 35, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the text, with n_words, n_removed and kept_sha256 after every word inside a repeated window of `width` words went.

    Words are runs of bytes other than space and tab to carriage return; null texts have none. Windows are judged on the input and
    never cross texts. What is left is hashed as words joined by one space. A column that has one of the new names gives way.
    """
    kept = [c for c in others(docs, "n_words", "n_removed", "kept_sha256") if c != text]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in kept)

    def run(batches):
        for batch in slices(batches, text):
            rows = []
            raw = pc.fill_null(batch.column(text).cast(pa.large_binary()), b"")
            for whole, places in zip(raw.to_pylist(), batch.column("__places").to_pylist()):
                words = whole.split()
                spans = union_ranges(places)
                edges = [0, *(x for s in spans for x in s), len(words)]
                left = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]] if spans else words
                rows.append((len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, zip(*rows))], names=[*kept, "n_words", "n_removed", "kept_sha256"])

    return covered(docs, word_kind(width), key, text).mapInArrow(run, fields + "n_words long, n_removed long, kept_sha256 string")

"""Token counts of a unigram vocabulary without the tokens: Aho-Corasick matches and a Viterbi pass over scores and counts."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tempora.llm.common import others, slices

#: Parts of texts whose result a worker remembers; the memo is emptied when full.
MEMO_PARTS = 800_000
#: A character that no piece covers costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
BLANK = "▁"
_counters: dict[str, "Counter"] = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) in the order of ids, read from a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), float(model.get_score(k))) for k in range(model.get_piece_size())]


def silent_pieces(path: str) -> frozenset[str]:
    """The unknown, control, unused and byte pieces of a sentencepiece file: no text holds them, whatever it spells."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = (model.is_unknown, model.is_control, model.is_unused, model.is_byte)
    return frozenset(model.id_to_piece(k) for k in range(model.get_piece_size()) if any(kind(k) for kind in kinds))


class Counter:
    """(score, count) of the best segmentation of a string.

    Ties go the way of the common unigram tokenizers: positions are settled from left to right, and at equal scores the
    candidate that begins earlier, so the longer last piece, stays. A character without a piece of its own can be
    unknown: it scores the worst score less a penalty and counts a token per UTF-8 byte where all byte pieces exist, else
    a run of them counts one token. Pieces in `silent` never match; bytes among them stay what unknown characters cost.
    """

    def __init__(self, pieces: list[tuple[str, float]], silent: frozenset[str] = frozenset()):
        self.trie = ahocorasick.Automaton()
        spoken = [(p, s) for p, s in pieces if p not in silent]
        for piece, score in spoken:
            if piece:
                self.trie.add_word(piece, (len(piece), score))
        if len(self.trie):
            self.trie.make_automaton()
        self.single = {p for p, _ in spoken if len(p) == 1}
        self.unknown = min((s for _, s in spoken), default=0.0) - UNKNOWN_PENALTY
        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        # a text may be cut before a blank if no piece has one after another character; exact scores make sums independent of the cut
        self.parts = all(BLANK not in p.lstrip(BLANK) for p, _ in pieces) and all(s.is_integer() for _, s in pieces)
        self.memo: dict[str, tuple[float, int]] = {}

    def viterbi(self, text: str) -> tuple[float, int]:
        n = len(text)
        score, count, open_run = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        matches = self.trie.iter(text) if len(self.trie) else iter(())
        found = next(matches, None)
        for end in range(n):
            best, pieces, unknown = None, 0, False
            while found is not None and found[0] == end:  # longest first, so the earliest start first
                size, worth = found[1]
                before = score[end + 1 - size]
                if best is None or before + worth > best:
                    best, pieces = before + worth, count[end + 1 - size] + 1
                found = next(matches, None)
            if text[end] not in self.single and (best is None or score[end] + self.unknown > best):
                best, unknown = score[end] + self.unknown, True
                pieces = count[end] + (len(text[end].encode("utf-8", "surrogatepass")) if self.bytes else not open_run[end])
            score[end + 1], count[end + 1], open_run[end + 1] = best, pieces, unknown
        return score[n], count[n]

    def count(self, text: str) -> tuple[float, int]:
        """Of a whole text: blanks become marks, and one goes before it; an empty text has no tokens."""
        if not text:
            return 0.0, 0
        marked = (text if text[0] == BLANK or text[0] == " " else " " + text).replace(" ", BLANK)
        if not self.parts:
            return self.viterbi(marked)
        memo, total, tokens = self.memo, 0.0, 0
        for part in split_marked(marked):
            known = memo.get(part)
            if known is None:
                if len(memo) >= MEMO_PARTS:
                    memo.clear()
                known = memo[part] = self.viterbi(part)
            total += known[0]
            tokens += known[1]
        return total, tokens


def split_marked(marked: str) -> list[str]:
    """The parts of a text that begin with its runs of blank marks."""
    if BLANK * 2 not in marked:
        parts = marked.split(BLANK)
        return ([parts[0]] if parts[0] else []) + [BLANK + p for p in parts[1:]]
    out, blanks = [], 0
    for k, p in enumerate(marked.split(BLANK)):
        blanks += k > 0
        if p:
            out.append(BLANK * blanks + p)
            blanks = 0
    return out + ([BLANK * blanks] if blanks else [])


def token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`docs` with n_tokens and best_score of every whole text; null and empty texts have 0 tokens and score 0.

    A column that has one of the new names gives way.
    """
    kept = others(docs, "n_tokens", "best_score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)

    def count(batches):
        if path not in _counters:
            _counters[path] = Counter(vocabulary(path), silent_pieces(path))
        one = _counters[path]
        for batch in slices(batches, text):
            pairs = [one.count(x) for x in pc.fill_null(batch.column(text), "").to_pylist()]
            score, tokens = np.array(pairs).T if pairs else (np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(tokens.astype(np.int64)), pa.array(score)], names=[*kept, "n_tokens", "best_score"])

    return docs.mapInArrow(count, fields + ", n_tokens long, best_score double")

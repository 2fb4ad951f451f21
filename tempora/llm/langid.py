"""Language identification by prediction by partial matching: byte contexts of up to three bytes with escapes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import flat, hidden, others, slices, stored

#: Contexts are this many bytes at most.
ORDER = 3
#: Pairs of bytes on a side of the dense table, the most frequent ones; what it lacks is searched for, with equal results.
TABLE_SIDE = 1024
#: Rows of a table of languages that is sent to every executor.
MANY_LANGUAGES = 10_000
_tables: dict[str, "Tables"] = {}


def counts(docs: DataFrame, language: str = "lang", text: str = "text") -> DataFrame:
    """(language, gram, n): byte strings of ORDER + 1 bytes as numbers, counted over whole texts inside the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            languages = np.array(batch.column(language).to_pylist(), object)
            for one in sorted(set(languages)):
                data, offsets = flat(batch.column(text).filter(pa.array(languages == one)))
                gram, _ = grams(data, offsets)
                values, n = np.unique(gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(n)], names=["language", "gram", "n"])

    found = docs.select(F.col(language).alias("language"), F.col(text).alias("text"))
    language, text = "language", "text"
    return found.mapInArrow(count, "language string, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER + 1 bytes that end at every byte of every text, as numbers, and where each text's begin."""
    n = len(offsets) - 1
    padded = np.full(len(data) + ORDER * n, 0x20, np.uint8)
    shift = ORDER * (np.arange(n) + 1)
    place = np.arange(len(data)) + np.repeat(shift, np.diff(offsets))
    padded[place] = data
    gram = np.zeros(len(data), np.uint32)
    for back in range(ORDER, -1, -1):
        gram = (gram << np.uint32(8)) | padded[place - back]
    return gram, offsets


class Model:
    """Frozen code lengths in bits of a byte after its context, per language, with escapes to shorter contexts.

    A context seen n times with d different successors gives a successor seen c times c / (n + d) and the
    escape d / (n + d); after an escape the next shorter context decides, and at last every byte has 1 / 256.
    Code lengths depend only on the last ORDER + 1 bytes, so they are tables: one row per string
    that any language has seen, and one per shorter string for the rest.
    """

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.languages = sorted({r[0] for r in rows})
        self.keys, self.bits = [], []  # by length of the string: 1 .. ORDER + 1
        known = np.array(sorted({r[1] for r in rows}), np.int64)
        seen = np.zeros((len(known), len(self.languages)), np.int64)
        at = {name: k for k, name in enumerate(self.languages)}
        if rows:
            names, gram, n = zip(*rows)
            np.add.at(seen, (np.searchsorted(known, np.array(gram, np.int64)), np.array([at[x] for x in names])), np.array(n, np.int64))
        self.frequency = seen.sum(axis=1)
        shorter_bits = np.full((1, max(1, len(self.languages))), 8.0)
        shorter_keys = np.zeros(1, np.int64)
        escape_of: list[tuple[np.ndarray, np.ndarray]] = []
        for size in range(1, ORDER + 2):
            keys, to = np.unique(known & ((1 << 8 * size) - 1), return_inverse=True)
            c = np.zeros((len(keys), len(self.languages)), np.int64)
            np.add.at(c, to, seen)
            context, inverse = np.unique(keys >> 8, return_inverse=True)
            total = np.zeros((len(context), len(self.languages)), np.int64)
            distinct = total.copy()
            np.add.at(total, inverse, c)
            np.add.at(distinct, inverse, c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                coded = -np.log2(c / (total + distinct)[inverse])
            below = lookup(shorter_keys, shorter_bits, keys & ((1 << 8 * (size - 1)) - 1) if size > 1 else np.zeros(len(keys), np.int64))
            bits = np.where(c > 0, coded, escape[inverse] + below)
            escape_of.append((context, escape))
            self.keys.append(keys), self.bits.append(bits)
            shorter_keys, shorter_bits = keys, bits
        self.escapes = escape_of

    def score(self, gram: np.ndarray) -> np.ndarray:
        """Bits of every string's last byte after its other bytes, a column per language."""
        return self._score(gram.astype(np.int64), ORDER + 1)

    def _score(self, gram: np.ndarray, size: int) -> np.ndarray:
        if not size:
            return np.full((len(gram), len(self.languages)), 8.0)
        gram = gram & ((1 << 8 * size) - 1)
        keys, bits = self.keys[size - 1], self.bits[size - 1]
        at = np.minimum(np.searchsorted(keys, gram), max(0, len(keys) - 1))
        hit = keys[at] == gram if len(keys) else np.zeros(len(gram), bool)
        out = bits[at] if len(keys) else np.zeros((len(gram), len(self.languages)))
        miss = np.flatnonzero(~hit)
        if len(miss):
            context, escape = self.escapes[size - 1]
            here = gram[miss] >> 8
            at = np.minimum(np.searchsorted(context, here), max(0, len(context) - 1))
            met = context[at] == here if len(context) else np.zeros(len(here), bool)
            out[miss] = self._score(gram[miss], size - 1) + (escape[at] * met[:, None] if len(context) else 0)
        return out


def lookup(keys: np.ndarray, bits: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return bits[np.searchsorted(keys, wanted)]


class Tables:
    """A model as a dense table over its frequent pairs of bytes, for scoring almost without searches."""

    def __init__(self, model: Model):
        self.model = model
        high, low = (self.frequent(pairs, model.frequency) for pairs in (model.keys[-1] >> 16, model.keys[-1] & 0xFFFF))
        self.rows, self.columns = np.full(1 << 16, len(high), np.int32), np.full(1 << 16, len(low), np.int32)
        self.rows[high], self.columns[low] = np.arange(len(high)), np.arange(len(low))
        self.width = len(low) + 1
        dense = np.full(((len(high) + 1) * self.width, len(model.languages)), np.nan, np.float32)
        for a in range(0, len(high), 256):  # all pairs, so that escapes are in the table too
            some = high[a : a + 256]
            gram = (some[:, None] << 16 | low[None, :]).ravel()
            bits = model.score(gram).reshape(len(some), len(low), -1)
            dense.reshape(len(high) + 1, self.width, -1)[a : a + len(some), : len(low)] = bits
        self.dense = dense

    @staticmethod
    def frequent(pairs: np.ndarray, frequency: np.ndarray) -> np.ndarray:
        count = np.bincount(pairs, frequency, 1 << 16)
        return np.sort(np.argsort(-count, kind="stable")[: min(TABLE_SIDE, int((count > 0).sum()))])

    def score(self, gram: np.ndarray) -> np.ndarray:
        at = self.rows[gram >> np.uint32(16)] * np.int64(self.width) + self.columns[gram & np.uint32(0xFFFF)]
        bits = self.dense[at]
        strange = np.flatnonzero(np.isnan(bits[:, 0]))
        if len(strange):
            bits[strange] = self.model.score(gram[strange])
        return bits


def training_sample(docs: DataFrame, fold: Column, per_language: int = 1500, language: str = "lang", text: str = "text") -> DataFrame:
    """About `per_language` different texts of every language from the rows where `fold` holds, whole, chosen by a hash of the text."""
    labelled = docs.where(fold & F.col(text).isNotNull() & F.col(language).isNotNull()).select(F.col(language).alias("lang"), F.col(text).alias("text"))
    sizes = stored(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "languages")
    if sizes.count() <= MANY_LANGUAGES:  # a row per language; beyond, the rows are shuffled by language instead
        sizes = F.broadcast(sizes)
    share = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return labelled.join(sizes, "lang").where(share * F.col("rows") < per_language).select("lang", "text").distinct()


def fit(docs: DataFrame, fold: Column, per_language: int = 1500, language: str = "lang", text: str = "text") -> Model:
    """The model of a bounded sample: `per_language` texts, so what comes to the driver does not grow with the table."""
    rows = counts(training_sample(docs, fold, per_language, language, text), "lang").toPandas()
    return Model(list(zip(rows.language, rows.gram, rows.n)))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score and bits_per_byte.

    Every whole text gets its code length in bits under every language; the shortest wins, ties by name. `score` is the
    chance of the winner against the others at equal priors. A text that is null, has no letter, or a model without
    languages gives `und` with score 0 and null bits. A column that has one of the new names gives way.
    """
    kept = others(docs, "lang_pred", "score", "bits_per_byte")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def judge(batches):
        names = np.array([*shared.value.languages, "und"], object)
        if len(names) > 1 and name not in _tables:  # once per worker
            _tables.clear()
            _tables[name] = Tables(shared.value)
        for batch in slices(batches, text):
            data, offsets = flat(batch.column(text))
            n = batch.num_rows
            total = np.zeros((n, max(1, len(names) - 1)))
            if len(names) > 1 and len(data):
                gram, _ = grams(data, offsets)
                edges = sorted({*range(0, len(gram), 1 << 18), *offsets[:-1][np.diff(offsets) > 0].tolist()})
                owner = np.searchsorted(offsets, edges, "right") - 1
                for a in range(0, len(gram), 1 << 18):
                    b = min(len(gram), a + (1 << 18))
                    i, j = np.searchsorted(edges, [a, b])
                    sums = np.add.reduceat(_tables[name].score(gram[a:b]).astype(np.float64), np.array(edges[i:j]) - a, axis=0)
                    np.add.at(total, owner[i:j], sums)
            best = total.argmin(axis=1)
            chance = 1 / np.exp2(np.minimum(0, total.min(axis=1)[:, None] - total)).sum(axis=1)
            letters = batch.column("__letters").to_numpy(zero_copy_only=False).astype(bool) & (len(names) > 1)
            size = np.maximum(np.diff(offsets), 1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in kept), pa.array(np.where(letters, names[best], "und"), pa.string()), pa.array(np.where(letters, chance, 0.0)),
                 pa.array(total.min(axis=1) / size, mask=~letters)],
                names=[*kept, "lang_pred", "score", "bits_per_byte"],
            )

    has_letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn("__letters", has_letters).mapInArrow(judge, fields + ", lang_pred string, score double, bits_per_byte double")


def held_out(key: str = "doc_id") -> Column:
    """The rows whose CRC-32 of the key as text leaves 1 after division by 3; a null key does not."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def keep_languages(docs: DataFrame, fold: Column | None = None, per_language: int = 1500, worst_bits: float = 8.0) -> DataFrame:
    """`docs` without the texts that are in no language: `und`, or coded worse than bytes by themselves."""
    model = fit(docs, F.lit(True) if fold is None else fold, per_language)
    rows, names = hidden(docs)
    judged = identify(rows, model, names["text"])
    return judged.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") < worst_bits)).select(*names.values()).toDF(*names)

"""Benchmark decontamination: pairs of words that no copy can lack seed candidate passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import BYTE_VALUES, flat, gram_hashes, slices, span_hashes, stored, word_spans

#: Bits of the filter that texts are first held against, as a power of two; its size does not depend on any table.
FILTER_BITS = 22
#: Bytes that separate words here: all of ASCII but letters and digits.
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 0x20 for b in range(256))


def plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of lower-case texts with blanks for ASCII punctuation; null is empty."""
    data, offsets = flat(pc.utf8_lower(pc.fill_null(column, "")))
    return np.frombuffer(data.tobytes().translate(_PLAIN), np.uint8), offsets


def grams(data: np.ndarray, offsets: np.ndarray, n: int):
    """(hash, text, place) of every n-gram of words, and the words' spans and the number of words before each text."""
    starts, ends, before = word_spans(data, offsets)
    count = np.maximum(np.diff(before) - n + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    values = span_hashes(BYTE_VALUES[data], starts, ends)
    h = gram_hashes(values, n)[before[row] + place].view(np.int64) if len(row) else np.zeros(0, np.int64)
    return h, row, place, (starts, ends, before)


def item_grams(items: DataFrame, n: int) -> DataFrame:
    """(item, words, place, gram) of every n-gram of (item, text); `words` is the item's number of words."""

    def run(batches):
        for batch in slices(batches, "text"):
            h, row, place, (_, _, before) = grams(*plain(batch.column("text")), n)
            words = np.diff(before)[row]
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(row)), pa.array(words), pa.array(place), pa.array(h)], names=["item", "words", "place", "gram"])

    return items.mapInArrow(run, "item long, words long, place long, gram long")


def gram_filter(table: DataFrame) -> np.ndarray:
    """A bitmap of column `gram`, 2^FILTER_BITS bits however many there are: a gram that is not in it is not in the table."""
    bit = F.col("gram").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = table.groupBy(F.shiftright(bit, 6).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for at, bits in words.toPandas().itertuples(index=False):
        out[at] = bits
    return out


def passes(bitmap: np.ndarray, gram: np.ndarray) -> np.ndarray:
    bit = gram & ((1 << FILTER_BITS) - 1)
    return (bitmap[bit >> 6] >> (bit & 63)) & 1 == 1


def gram_frequencies(texts: DataFrame, bitmap: np.ndarray, n: int) -> DataFrame:
    """(gram, texts) for the grams that pass the filter: in how many rows of (text) each occurs, summed inside tasks first."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in slices(batches, "text"):
            h, row, _, _ = grams(*plain(batch.column("text")), n)
            hit = np.flatnonzero(passes(shared.value, h))
            pairs = np.unique(np.stack([row[hit], h[hit]], axis=1), axis=0)
            gram, count = np.unique(pairs[:, 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(count)], names=["gram", "n"])

    return texts.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("texts"))


def certain_seeds(found: DataFrame, frequencies: DataFrame, threshold: float, hits: int) -> DataFrame:
    """(item, gram, places, hits): word pairs of items that seed, at how many places of the item, and how many places a copy must hit.

    An alignment of score s has at most as many runs of matches as mismatches and gaps, and one more, so at least s - 1 pairs of
    neighbouring words are whole in it. A copy scores `threshold` a word or more: of an item's pairs it can lack only a fixed
    number, and all but that number less `hits` are enough seeds for any copy to hit `hits` of them. The rarest are taken;
    which these are only decides how many passages are looked at.
    """
    need = F.greatest(F.lit(1), F.ceil(F.col("words") * F.lit(threshold) - F.lit(1e-9)).cast("long") - 1)
    rarest = Window.partitionBy("item").orderBy(F.coalesce("texts", F.lit(0)), "place")
    ranked = found.join(frequencies, "gram", "left").withColumn("__rank", F.row_number().over(rarest))
    wanted = ranked.withColumn("hits", F.least(need, F.lit(hits))).where(F.col("__rank") <= F.col("words") - 1 - need + F.col("hits"))
    return wanted.where("texts is not null").groupBy("item", "gram", "hits").agg(F.count(F.lit(1)).alias("places"))


def passages(texts: DataFrame, bitmap: np.ndarray, reach: int, n: int) -> DataFrame:
    """(__h, __h2, start, passage, seeds) around the grams that pass the filter in (__h, __h2, text), a text once a task.

    A passage has `reach` words on either side of a gram; passages that meet are one.
    """
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            new = []
            for r, x in enumerate(batch.column("__h").to_pylist()):
                if x not in seen:
                    seen.add(x)
                    new.append(r)
            batch = batch.take(pa.array(new, pa.int64()))
            data, offsets = plain(batch.column("text"))
            h, row, place, (starts, ends, before) = grams(data, offsets, n)
            hit = np.flatnonzero(passes(shared.value, h))
            h, row, place = h[hit], row[hit], place[hit]
            first = np.ones(len(hit), bool)
            first[1:] = (row[1:] != row[:-1]) | (place[1:] - place[:-1] > 2 * reach)
            at = np.flatnonzero(first)
            until = np.append(at[1:], len(hit)).astype(np.int64)
            words = np.diff(before)
            low = np.maximum(place[at] - reach, 0)
            high = np.minimum(place[until - 1] + n + reach, words[row[at]]) if len(at) else low
            raw = data.tobytes()
            base = before[row[at]]
            cut = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[base + low].tolist(), ends[base + high - 1].tolist())]
            seeds = pa.ListArray.from_arrays(pa.array(np.append(at, len(hit)).astype(np.int32)), pa.array(h))
            rows = pa.array(row[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("__h").take(rows), batch.column("__h2").take(rows), pa.array(low), pa.array(cut, pa.string()), seeds],
                names=["__h", "__h2", "start", "passage", "seeds"],
            )

    return texts.mapInArrow(run, "__h long, __h2 long, start long, passage string, seeds array<long>")


def align(item: np.ndarray, passage: np.ndarray, mismatch: float = 1.0, gap: float = 1.0) -> tuple[float, int]:
    """Smith-Waterman over words: (score, end of the best local alignment in the passage); a match scores 1.

    A row per item word; a row's own gaps are a running maximum, so rows are computed at once.
    """
    if not len(item) or not len(passage):
        return 0.0, 0
    steps = gap * np.arange(len(passage))
    row, best, end = np.zeros(len(passage)), 0.0, 0
    for word in item:
        diagonal = np.concatenate([[0.0], row[:-1]]) + np.where(passage == word, 1.0, -mismatch)
        reached = np.maximum(np.maximum(diagonal, row - gap), 0.0)
        row = np.maximum.accumulate(reached + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, end = float(row[top]), top + 1
    return best, end


def score_pairs(pairs: DataFrame) -> DataFrame:
    """(__h, __h2, item, score, first_word, last_word) of (__h, __h2, start, passage, item, text): alignment score per item word."""

    def numbers(words: list[str], known: dict[str, int]) -> np.ndarray:
        return np.array([known.setdefault(w, len(known)) for w in words], np.int64)

    def run(batches):
        for batch in batches:
            data, offsets = plain(batch.column("text"))
            whole = data.tobytes()
            rows = []
            for k, passage in enumerate(batch.column("passage").to_pylist()):
                known: dict[str, int] = {}
                item = numbers(whole[offsets[k] : offsets[k + 1]].decode("utf-8", "replace").split(" "), known)
                item = item[item != known.get("", -1)]
                words = numbers([w for w in passage.split(" ") if w], known)
                score, end = align(item, words)
                back, length = align(item[::-1], words[:end][::-1])
                start = batch.column("start")[k].as_py()
                rows.append((score / max(1, len(item)), start + end - length, start + end - 1))
            new = [pa.array(x) for x in zip(*rows)] or [pa.array([], t) for t in (pa.float64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("__h", "__h2", "item")), *new], names=["__h", "__h2", "item", "score", "first_word", "last_word"])

    fields = "__h long, __h2 long, item long, score double, first_word long, last_word long"
    return pairs.select("__h", "__h2", "start", "passage", "item", "text").mapInArrow(run, fields)


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, n: int = 3, hits: int = 4, text: str = "text", item_text: str = "text") -> DataFrame:
    """(__h, __h2, item, score, first_word, last_word): texts of `docs`, by two hashes, that hold a copy of a benchmark item, by a hash.

    Words are lower case without ASCII punctuation. A passage is a copy if its best local alignment with an item (match 1,
    mismatch and gap -1) scores `threshold` per item word or more. Items of fewer than `n` words cannot be told from chance and match nothing.
    """
    items = benchmark.select(F.xxhash64(item_text).alias("item"), F.col(item_text).alias("text")).where(F.col("text").isNotNull()).distinct()
    found = stored(item_grams(items, 2).where(F.col("words") >= n), "grams")
    # a copy has at most (2 - threshold) words for each of the item's, the rest being gaps
    reach = math.ceil((found.agg(F.max("words")).first()[0] or 0) * max(1.0, 2 - threshold))
    texts = docs.select(F.xxhash64(text).alias("__h"), F.xxhash64(F.lit(2), text).alias("__h2"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    seeds = stored(certain_seeds(found, gram_frequencies(texts, gram_filter(found), 2), threshold, hits), "seeds")
    around = stored(passages(texts, gram_filter(seeds), reach, 2), "passages")
    places = ["__h", "__h2", "start"]
    pairs = around.select(*places, F.explode(F.array_distinct("seeds")).alias("gram")).join(seeds, "gram")
    pairs = pairs.groupBy(*places, "item", "hits").agg(F.sum("places").alias("__hit")).where(F.col("__hit") >= F.col("hits")).select(*places, "item")
    pairs = pairs.join(around.drop("seeds").dropDuplicates(places), places).join(items, "item")
    scored = score_pairs(pairs).where(F.col("score") >= threshold)
    best = F.max(F.struct("score", (-F.col("first_word")).alias("f"), "last_word")).alias("b")
    return scored.groupBy("__h", "__h2", "item").agg(best).select("__h", "__h2", "item", "b.score", (-F.col("b.f")).alias("first_word"), "b.last_word")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", item_text: str = "text", **parameters) -> DataFrame:
    """(key, item_key, score, first_word, last_word) for every row and benchmark row that it holds a copy of; see `contaminated_texts`.

    Words are counted from 0. Rows that repeat are all returned; null and empty texts hold nothing.
    """
    hits = stored(contaminated_texts(docs, benchmark, text=text, item_text=item_text, **parameters), "contaminated")
    rows = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__h"), F.xxhash64(F.lit(2), text).alias("__h2"))
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_key).alias("__item_key"), F.xxhash64(item_text).alias("item"))
    return hits.join(items, "item").join(rows, ["__h", "__h2"]).select(F.col("__key").alias(key), F.col("__item_key").alias(item_key), "score", "first_word", "last_word")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **parameters) -> DataFrame:
    """`docs` without the rows that hold a copy of a benchmark item."""
    hits = stored(contaminated_texts(docs, benchmark, text=text, **parameters), "contaminated").select("__h", "__h2").distinct()
    keyed = docs.withColumns({"__h": F.xxhash64(text), "__h2": F.xxhash64(F.lit(2), text)})
    return keyed.join(hits, ["__h", "__h2"], "left_anti").select(*docs.columns)

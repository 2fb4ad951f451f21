"""Homomorphic multiset fingerprints of documents: sums of wide vectors hashed from paragraphs, modulo powers of two."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import partitions, stored

#: Lanes of 32 bits that tell multisets apart, and lanes of 16 bits that measure their likeness.
EQUALITY, LIKENESS = 4, 128
HASHES = EQUALITY // 2 + LIKENESS // 64
_LOW = 1 | 1 << 31
_WORD = 0xFFFFFFFF


def units(text: Column) -> Column:
    """A text's paragraphs, divided after the ends of clauses. Every code point is part of one unit, so only the order is lost."""
    return F.filter(F.split(text, r"(?<=[\n.,;:!?])"), lambda x: x != "")


def unit_hashes(unit: Column) -> list[Column]:
    """64-bit hashes of a unit: two for lanes that tell multisets apart, and one for every 64 counters of likeness."""
    names = [f"equality {k}" for k in range(EQUALITY // 2)] + [f"likeness {k}" for k in range(LIKENESS // 64)]
    return [F.xxhash64(F.lit(name), unit) for name in names]


def hash_lanes() -> list[tuple[int, Callable[[Column], Column]]]:
    """(which hash, what it adds) of every lane after the first, which counts units.

    Equality lanes take 32 bits. Two counters share a long, 31 bits apart, and each takes a bit. A text has under 2^31
    units, so no sum overflows and every counter is exact.
    """
    wide = [(k // 2, lambda h, k=k: F.shiftrightunsigned(h, k % 2 * 32).bitwiseAND(F.lit(_WORD))) for k in range(EQUALITY)]
    return wide + [(EQUALITY // 2 + k // 32, lambda h, k=k: F.shiftrightunsigned(h, k % 32).bitwiseAND(F.lit(_LOW))) for k in range(LIKENESS // 2)]


def sums(rows: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """(keys, lanes) of the units in column `unit`: how many there are and the sum of each lane; null adds nothing."""
    hashed = unit_hashes(F.col(unit))
    lanes = [F.lit(1).cast("long"), *(add(hashed[k]) for k, add in hash_lanes())]
    named = [F.when(F.col(unit).isNotNull(), x).otherwise(F.lit(0).cast("long")).alias(f"__l{k}") for k, x in enumerate(lanes)]
    return rows.select(*keys, *named).groupBy(*keys).agg(F.array(*(F.sum(f"__l{k}") for k in range(len(lanes)))).alias("lanes"))


def with_lanes(rows: DataFrame, texts: dict[str, str]) -> DataFrame:
    """`rows` with the lanes of whole texts in place of them: {text column: lanes column}.

    A row's units are hashed to arrays once and every lane is summed over these, so no row leaves its place and none is
    grouped. The steps are projections of their own, since what one makes is used many times in the next.
    """
    rest = [c for c in rows.columns if c not in texts]
    rows = rows.select(*rest, *(units(F.col(t)).alias(f"__u{i}") for i, t in enumerate(texts)))
    by = lambda k: lambda u: unit_hashes(u)[k]
    rows = rows.select(*rest, *(F.transform(f"__u{i}", by(k)).alias(f"__h{i}_{k}") for i in range(len(texts)) for k in range(HASHES)))
    zero = F.lit(0).cast("long")
    total = lambda h, add: F.aggregate(h, zero, lambda a, x: a + add(x))
    return rows.select(*rest, *(
        F.array(F.size(f"__h{i}_0").cast("long"), *(total(f"__h{i}_{k}", add) for k, add in hash_lanes())).alias(lanes) for i, lanes in enumerate(texts.values())
    ))


def edit(fingerprints: DataFrame, changes: DataFrame, keys: list[str], sign: int = 1) -> DataFrame:
    """Lane sums after units were added (sign 1) or taken away (-1): the texts are not read again."""
    count = 1 + EQUALITY + LIKENESS // 2
    changed = changes.select(*keys, F.transform("lanes", lambda x: x * F.lit(sign)).alias("lanes"))
    return fingerprints.select(*keys, "lanes").unionByName(changed).groupBy(*keys).agg(F.array(*(F.sum(F.col("lanes")[k]) for k in range(count))).alias("lanes"))


def _counters(lanes: Column) -> Column:
    """The counters of likeness, of each pair the low one first."""
    pairs = F.slice(lanes, 2 + EQUALITY, LIKENESS // 2)
    return F.flatten(F.transform(pairs, lambda x: F.array(x.bitwiseAND(F.lit((1 << 31) - 1)), F.shiftright(x, 31))))


def fingerprint(lanes: str = "lanes") -> Column:
    """Lane sums as hex digits: 32-bit lanes modulo 2^32, counters modulo 2^16."""
    digits = lambda x, bits: F.lpad(F.lower(F.hex(F.pmod(x, F.lit(1 << bits)))), bits // 4, "0")
    wide = F.transform(F.slice(lanes, 2, EQUALITY), lambda x: digits(x, 32))
    return F.concat_ws("", wide, F.transform(_counters(F.col(lanes)), lambda x: digits(x, 16)))


def likeness(a: str, b: str) -> Column:
    """2 <a, b> / (<a, a> + <b, b>) of two multisets of units, estimated from the counters; 0 to 1, and 1 for equal ones.

    A counter with its bit set in s of n units stands for the sum 2s - n of random signs, whose products average to <a, b>.
    With 128 counters the estimate has a standard error of about 0.09 where little is shared, and less where much is.
    """

    def signed(lanes):
        return F.transform(_counters(F.col(lanes)), lambda s: (2 * s - F.col(lanes)[0]).cast("double"))

    over = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    apart = over(F.zip_with(signed(a), signed(b), lambda x, y: (x - y) * (x - y)))
    size = over(F.transform(signed(a), lambda x: x * x)) + over(F.transform(signed(b), lambda x: x * x))
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - apart / F.greatest(size, F.lit(1.0))))


def neighbours(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(k, next, before, before_chars) per distinct key in order, the ends joined; null is the least key.

    Keys are sorted in ranges. Only the first and last key of each range, a row per range, meet in one window.
    """
    ids = docs.groupBy(F.col(key).alias("k")).agg(F.max("__n_chars").alias("chars"))
    ranged = ids.repartitionByRange(partitions(docs.sparkSession), "k").withColumn("__range", F.spark_partition_id())
    inside = Window.partitionBy("__range").orderBy(F.col("k").asc_nulls_first())
    one = F.struct("k", "chars")
    ranged = ranged.select("k", "__range", F.lead(one).over(inside).alias("__after"), F.lag(one).over(inside).alias("__prior"), one.alias("__own"))
    ends = ranged.groupBy("__range").agg(
        F.max(F.when(F.col("__prior").isNull(), F.col("__own"))).alias("__first"), F.max(F.when(F.col("__after").isNull(), F.col("__own"))).alias("__last")
    )
    order = Window.orderBy("__range")
    around = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "__range", F.coalesce(F.lead("__first").over(order), F.first("__first").over(around)).alias("__then"),
        F.coalesce(F.lag("__last").over(order), F.last("__last").over(around)).alias("__earlier"),
    )
    after, prior = F.coalesce("__after", "__then"), F.coalesce("__prior", "__earlier")
    return ranged.join(ends, "__range").select("k", after.k.alias("next"), prior.k.alias("before"), prior.chars.alias("before_chars"))


def document_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of the next document by
    key (after the last: the first). Null texts are empty; an empty text has no units and the fingerprint of
    zeros. Of several rows with one key the next document is the least text, and each row is edited and returned for itself.
    """
    kind = docs.schema[key].dataType.simpleString()
    base = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    base = base.select("__key", "__text", F.struct(F.col("__key").alias("k")).alias("__id"))
    order = neighbours(base.select("__key", F.length("__text").cast("long").alias("__n_chars")), "__key").select(
        F.struct("k").alias("__id"), F.struct(F.col("next").alias("k")).alias("__next"), F.struct(F.col("before").alias("k")).alias("__before"),
        F.floor(F.col("before_chars") / 2).cast("long").alias("__need"),
    )
    order = stored(order, "order")
    heads = base.join(order.select("__id", "__before", "__need"), "__id").groupBy(F.col("__before").alias("__id")).agg(
        F.min(F.struct(F.col("__text").substr(F.lit(1), F.col("__need").cast("int")).alias("head"), F.xxhash64("__text").alias("h"))).alias("__head")
    )
    n = F.length("__text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("__text").substr(F.lit(1), (n - half).cast("int")), F.col("__head.head").substr(F.lit(1), half))
    both = base.join(heads, "__id").join(order.select("__id", "__next"), "__id").select(
        "__id", "__next", F.xxhash64("__text").alias("__h"), F.col("__head.h").alias("__next_h"), n.alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), "__text", edited.alias("__edited")
    )
    summed = stored(with_lanes(both, {"__text": "__lanes", "__edited": "__edited_lanes"}), "lanes")
    # rows with one key and text have the same lanes
    following = summed.select(F.col("__id").alias("__next"), F.col("__h").alias("__next_h"), F.col("__lanes").alias("__next_lanes")).distinct()
    return summed.join(following, ["__next", "__next_h"]).select(
        F.col("__id.k").cast(kind).alias(key), "n_chars", "edited_sha256", fingerprint("__lanes").alias("fingerprint"), fingerprint("__edited_lanes").alias("edited_fingerprint"),
        likeness("__lanes", "__edited_lanes").alias("near_edited"), likeness("__lanes", "__next_lanes").alias("near_next"),
    )

"""Documents to training sequences: language, near copies, repeated strings, benchmark passages, packing.

Each stage works on all rows that the one before it kept and, but for the last, returns the columns of `documents`.
Null and blank texts leave in the first stage, since they are in no language; an empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import decontaminate, jaccardjoin, langid, packing, suffixdedup
from tempora.llm.common import hidden, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the documents' labels name; see `langid.keep_languages`."""
    return langid.keep_languages(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of every class joined by similarities of 0.8 or more on five-word shingles."""
    return jaccardjoin.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes inside any 200-byte string that starts in more than one place; those left blank go."""
    rows, names = hidden(docs)
    text, chars = names["text"], names["n_chars"]
    cut = suffixdedup.removals(rows, key=names["doc_id"], text=text, keep_text=True).where(F.col(text).rlike(r"\S"))
    cut = cut.withColumn(chars, F.when(F.col("n_removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(chars)))
    return cut.select(*names.values()).toDF(*names)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item, exact or edited."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", benchmark_passages),
    ("best-fit packing", sequences),
]

#: Language models, alignment and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

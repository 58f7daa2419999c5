"""The corpus pipeline: from documents to packed sequences, one stage after another.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. A stage's scratch tables go when the
next stage begins: its result has been written by then.

In every stage a null text counts as an empty one, rows that repeat are taken each as the stage's
operator takes them, an empty table gives no rows, and other columns than those of documents don't
come along. A document without an id is judged for quality, is never a copy of another, keeps its words,
and is mixed and packed like any other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.llm import jaccard, mixing, packing, quality, recompress
from rastermill.llm.common import mark, materialize, owned, release, release_since
from rastermill.llm.queries import labels, tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Where the scratch tables of the stage before begin.
_before: list[int] = []


def staged(function: Stage) -> Stage:
    """Deletes the scratch tables of the stage before, whose result has been written when this one is called."""
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _before:
            release_since(_before.pop())
        _before.append(mark())
        return function(spark, docs, sf_dir)

    return run_stage


@staged
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold go."""
    return quality.accept(docs, labels(spark, sf_dir)).select(*COLUMNS)


@staged
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays: five words to a shingle, similarity 0.8 or more."""
    return jaccard.keep_one(docs).select(*COLUMNS)


@staged
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller id has too are cut out; n_chars follows the text."""
    cleaned = recompress.remove_repeats(docs, keep=("lang", "source"))
    return cleaned.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


@staged
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them, up to three times or not at all; those without words by the same order, at no cost."""
    mixed = mixing.mix(docs, keep=("text", "lang", "source", "n_chars"))
    return mixed.where("times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select(*COLUMNS)


@staged
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the tokenised documents and their places in sequences."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", quality_classifier), ("n-gram Jaccard join", jaccard_join), ("substring dedup", substring_dedup), ("mixing sources", source_mix), ("packing", pack)]

#: The classifier and the seeded mix can't be written in SQL; a test holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = owned(materialize(stage(spark, docs, sf_dir), "stage"))
        release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

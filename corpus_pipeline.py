"""From raw documents to packed sequences: five stages, each over all that the one before it kept.

toxicity       documents that the classifier rejects go
exact dedup    of equal texts one stays
n-gram join    of each component of near copies the one with the smallest id stays
mixing         sources are brought to their target weights: documents are repeated, cut or left out
packing        what is left becomes sequences of 2048 tokens

Every stage takes an empty table to an empty one, reads null texts as empty ones, works on rows and not on ids where ids are null or
repeat, and hands columns that it does not know through as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kmerloom.llm.common import Scratch, documents
from kmerloom.llm.exact_dedup import deduplicated
from kmerloom.llm.mixing import apply_mix
from kmerloom.llm.ngram_join import one_of_each
from kmerloom.llm.packing import pack
from kmerloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier does not call toxic; it learns from labels outside the held-out fold, and rejects no empty text for being so."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space, the longest; null and empty texts are one group."""
    return deduplicated(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles and a similarity of 0.8, as near-duplicate stages take unless told otherwise; rows without words stay."""
    return one_of_each(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated, cut or left out so that each source has its target's words; rows without words go, a null source is one of its own."""
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence; a text without tokens is a piece of its end alone, and null ids stay null."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("n-gram join", ngram_join),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can't express the classifier, nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return docs

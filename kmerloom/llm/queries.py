"""Queries over the whole documents table, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe
from .common import documents
from .exact_dedup import exact_dedup
from .importance import resample
from .lm import lm_score
from .mixing import mix
from .ngram_join import ngram_join
from .oracle import ORACLE_SQL as ORACLE_SQL
from .packing import pack
from .pii import replace_pii
from .quality import quality_rules
from .secrets import secret_scan
from .token_counts import token_counts
from .toxicity import toxicity
from .trie import prefix_trie


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir), width=4, percent=85)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(documents(spark, sf_dir), key="a key for these tables")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    digests = [F.sha2(x.cast("binary"), 256).alias(name) for x, name in ((ids, "ids_sha256"), (F.col("text"), "decoded_sha256"))]
    return bpe(documents(spark, sf_dir)).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *digests)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed patterns' part of op2, which SQL can say."""
    return op2_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the add-one score of op8, which SQL can say; they need no model, so none is learned."""
    return lm_score(documents(spark, sf_dir), learn=False).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base rule of op9, which SQL can say."""
    return op9_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes and targets of op10, which SQL can say."""
    return op10_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_secret_scan, op3_ngram_jaccard_join, op4_packing, op5_pii_surrogates,
        op6_toxicity, op7_token_counts, op8_lm_scoring, op9_quality_rules, op10_mixing,
        op11_importance, op12_bpe, op13_prefix_trie,
        secret_base, lm_base, quality_base, mixing_targets,
    )
}

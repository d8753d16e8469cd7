"""The registered query of each operator, run over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .bpe import bpe_encode
from .collocations import collocations
from .common import documents, text_or_empty
from .fingerprints import edited_fingerprints
from .jaccard_join import jaccard_join
from .lexical import lexical_search
from .line_dedup import line_dedup
from .mixing import mix_sources
from .packing import pack_documents
from .quality import quality_rules
from .sharding import shard_documents
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .toxicity import toxicity_scores

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty("text"), 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(documents(spark, sf_dir), with_text=False)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join(documents(spark, sf_dir))
    return joined.select("doc_id", "class_id", "n_links", "representative")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = edited_fingerprints(documents(spark, sf_dir))
    return marked.withColumn("edited_sha256", F.sha2("edited_text", 256)).drop("edited_text")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    both = bpe_encode(docs, ranks, public_tokenizers.PATTERN, decoded_col="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup(documents(spark, sf_dir))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir), with_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_fingerprints": op4_fingerprints,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_sharding": op8_sharding,
    "op9_toxicity": op9_toxicity,
    "op10_source_mix": op10_source_mix,
    "op11_lexical_search": op11_lexical_search,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_collocations": op13_collocations,
}

ORACLE: dict[str, str] = {
    "op1_line_dedup": oracle.LINE_DEDUP,
    "op11_lexical_search": oracle.LEXICAL_SEARCH,
    "op13_collocations": oracle.COLLOCATIONS,
}

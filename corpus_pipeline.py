"""From raw documents to token ids: quality, shared lines, near copies, source mix, encoding.

Every stage keeps the columns it was given, whatever they are called, and gives an empty table for an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.bpe import bpe_encode
from logquarry.llm.common import column, documents, written
from logquarry.llm.jaccard_join import one_per_class
from logquarry.llm.line_dedup import line_dedup
from logquarry.llm.mixing import mix_sources
from logquarry.llm.quality import quality_rules

# Stages learn from what they get, so SQL cannot express the pipeline; its test runs each against brute force.
ORACLE_SQL = None


def _apart(docs: DataFrame) -> DataFrame:
    """What the operators look at, and all columns but the text once more in ``row``, so that no name can clash."""
    rest = F.struct(*(column(name).alias(name) for name in docs.columns if name != "text"))
    return docs.select("doc_id", "text", "source", rest.alias("row"))


def _together(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` out of rows with ``text, row``."""
    values = {name: F.col("row").getField(name) for name in docs.columns} | {"text": F.col("text")} | changed
    return rows.select(*(values[name].alias(name) for name in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null text has no words and goes; equal rows are judged alike and all stay or go."""
    return _together(quality_rules(_apart(docs), only_kept=True), docs)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many share; ``n_chars`` follows the text. A null text stays null.

    Rows of one id are one document to the count of a line, and keep it together if they are its keeper.
    """
    return _together(line_dedup(_apart(docs)), docs, n_chars=F.length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id, null before others. Of equal rows one stays; texts without
    words are like no other and stay."""
    return one_per_class(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice.

    Null is a source of its own; a document without words is not taken; equal rows are documents of their own.
    """
    mixed = mix_sources(_apart(docs))
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return _together(mixed.select("text", "row", F.explode(F.array_repeat(F.lit(1), copies))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the text that they decode to; a null text has no ids."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe_encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, decoded_col="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", quality),
    ("shared_lines", shared_lines),
    ("near_copies", near_copies),
    ("source_mix", source_mix),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result but the last is a table in the shared folder."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

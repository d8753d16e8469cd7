"""Token counts without token ids: pieces of distinct pre-tokens, joined to the documents' frequencies."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, in_workers, spread, text_or_empty

ROWS_AT_ONCE = 256
# How many of the most frequent pre-tokens are counted ahead and sent to all tasks: a fixed bound, about 4 MB.
MOST_FREQUENT = 262_144
# Which share of the documents tells what is frequent. It decides only which way a pre-token goes.
FREQUENT_FROM = 0.05
MAX_SENT_LENGTH = 64
# So many tasks may share the rows of a longer one.
LONG_PARTS = 64


@lru_cache(maxsize=2)
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    try:
        return sentencepiece.SentencePieceProcessor(model_file=path)
    except OSError:
        return sentencepiece.SentencePieceProcessor(model_file=SparkFiles.get(path.rpartition("/")[2]))


def pre_tokens(text: str) -> list[str]:
    """The parts of a text that no piece crosses, each without one leading blank.

    The library puts a blank before the text and has no piece with a blank behind another character, so a
    text falls apart before each run of blanks. Each part starts with a blank, which is the one that the library
    adds when the part is encoded by itself.
    """
    words = text.replace("\u2581", " ").split(" ") if "\u2581" in text else text.split(" ")
    if "" not in words:
        return words
    parts, blanks = [], 0
    for word in words[:-1]:
        if word:
            parts.append(" " * blanks + word)
            blanks = 0
        else:
            blanks += 1
    last = " " * blanks + words[-1]
    if words[-1] or len(words) > 1:
        parts.append(last)
    return parts


def count_pieces(model: sentencepiece.SentencePieceProcessor, parts: list[str]) -> list[int]:
    """How many pieces each pre-token has."""
    filled = [part for part in parts if part]
    sizes = iter(map(len, model.encode(filled, num_threads=1)))
    return [next(sizes) if part else 1 for part in parts]


def _frequent(docs: DataFrame) -> list[str]:
    """The most frequent pre-tokens of a seeded share of the documents, at most ``MOST_FREQUENT``."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                found: Counter[str] = Counter()
                for text in batch.column(0).slice(start, ROWS_AT_ONCE).to_pylist():
                    found.update(word for word in pre_tokens(text) if len(word) <= MAX_SENT_LENGTH)
                yield pa.RecordBatch.from_pydict(
                    {"w": pa.array(found, pa.string()), "n": pa.array(found.values(), pa.int64())}
                )

    some = docs.select("_text").sample(FREQUENT_FROM, seed=7)
    counted = some.mapInArrow(words, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") > 1)
    rows = counted.orderBy(F.desc("n"), "w").limit(MOST_FREQUENT).collect()
    return [row["w"] for row in rows]


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def token_counts(
    docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of every row, as the library counts each whole text.

    Texts become pre-token frequencies. Rare pre-tokens are shuffled, so that all rows of one meet in one task;
    there they are sorted, each distinct one is counted once, and counts are joined to the documents' frequencies and
    summed per document; those of more than 64 characters are dealt to up to 64 tasks each. Up to 262,144 pre-tokens that are frequent in a seeded twentieth of the texts are counted
    ahead and sent to all tasks, so no hot pre-token is ever shuffled. All texts and pre-tokens are counted
    exactly, whichever way they go.

    A null or empty text has no tokens. Repeated rows come back as often as they stand in the input. An empty table
    gives an empty result. Other columns of the input are left out. The model is read at ``model_path`` on every
    machine, or sent along with ``SparkContext.addFile``.
    """
    rows = docs.select(column(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    spark = docs.sparkSession
    in_workers(spark)
    # Texts are told apart by a hash only where ids repeat: it would go into every shuffled row.
    repeated = rows.groupBy("_id").count().where(F.col("count") > 1)
    text_hash = F.lit(0).cast("long") if repeated.isEmpty() else F.xxhash64("_text")
    rows = rows.select("_id", text_hash.alias("_hash"), F.octet_length("_text").alias("_bytes"), "_text")
    frequent = _frequent(rows)
    sizes = spark.sparkContext.broadcast(dict(zip(frequent, count_pieces(_model(model_path), frequent), strict=True)))

    id_type = rows.schema["_id"].dataType
    fields = [
        T.StructField("_id", id_type),
        T.StructField("_hash", T.LongType()),
        T.StructField("_bytes", T.LongType()),
        T.StructField("_word", T.StringType()),
        T.StructField("_n", T.LongType()),
    ]

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text one row with the tokens of its frequent pre-tokens, and one for each other pre-token."""
        known = sizes.value
        for part in _in_parts(batches):
            at, words, counts = [], [], []
            for row, text in enumerate(part.column(3).to_pylist()):
                settled = 0
                for word, n in Counter(pre_tokens(text)).items():
                    size = known.get(word)
                    if size is None:
                        at.append(row)
                        words.append(word)
                        counts.append(n)
                    else:
                        settled += n * size
                at.append(row)
                words.append(None)
                counts.append(settled)
            taken = part.select([0, 1]).take(pa.array(at, pa.int32()))
            first = np.array([word is None for word in words])
            n_bytes = np.where(first, part.column(2).to_numpy()[at], 0).astype(np.int64)
            arrays = [*taken.columns, pa.array(n_bytes), pa.array(words, pa.string()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[field.name for field in fields])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens of each row; pre-tokens come sorted, so that only the last one has to be remembered."""
        model, last = _model(model_path), ("", 1)
        for batch in batches:
            coded = batch.column(3).dictionary_encode()
            words = coded.dictionary.to_pylist()
            new = words[1:] if words and words[0] == last[0] else words
            found = [last[1]] * (len(words) - len(new)) + count_pieces(model, new)
            if words:
                last = (words[-1], found[-1])
            each = np.ones(batch.num_rows, np.int64)
            rare = coded.indices.is_valid().to_numpy(zero_copy_only=False)
            each[rare] = np.asarray(found, np.int64)[coded.indices.drop_null().to_numpy()] if words else 1
            tokens = pa.array(each * batch.column(4).to_numpy())
            texts = pa.array((~rare).astype(np.int64))
            arrays = [*batch.columns[:3], tokens, texts]
            yield pa.RecordBatch.from_arrays(arrays, names=["_id", "_hash", "_bytes", "_tokens", "_rows"])

    listed = rows.mapInArrow(frequencies, T.StructType(fields))
    # A pre-token that is too long to be sent ahead may still be hot, so its rows go to several tasks.
    of_text = F.xxhash64("_id", "_hash")
    part = F.when(F.length("_word") > MAX_SENT_LENGTH, F.pmod(of_text, F.lit(LONG_PARTS)))
    dealt = listed.repartition(spread(spark), F.coalesce("_word", of_text.cast("string")), part)
    out = T.StructType([*fields[:3], T.StructField("_tokens", T.LongType()), T.StructField("_rows", T.LongType())])
    summed = (
        dealt.sortWithinPartitions("_word")
        .mapInArrow(counted, out)
        .groupBy("_id", "_hash")
        .agg(F.max("_bytes").alias("_bytes"), F.sum("_tokens").alias("_tokens"), F.sum("_rows").alias("_rows"))
    )
    # Equal rows have been summed together.
    tokens = (F.col("_tokens") / F.col("_rows")).cast("long")
    return summed.select(
        F.col("_id").alias(id_col),
        F.col("_bytes").alias("n_bytes"),
        tokens.alias("n_tokens"),
        (tokens > max_tokens).alias("over_limit"),
        F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_copy"),
    ).drop("_copy")

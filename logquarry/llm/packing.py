"""Best-fit packing of documents into sequences of a fixed number of tokens, by minimum bin slack."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import column, in_workers, spread, text_or_empty, written

SEQUENCE = 1024
END_ID = 2
ROWS_AT_ONCE = 64
PIECES = "_id {id}, piece int, start long, length long, ids_crc32 long, _at long"

# A pattern: how many sequences are filled alike, and the lengths in one of them with their numbers.
Pattern = tuple[int, list[tuple[int, int]]]


def fullest(available: Mapping[int, int], room: int) -> list[tuple[int, int]]:
    """The lengths, with their numbers, whose sum comes nearest to ``room`` from below.

    The bits of an integer are the sums that can be reached. Lengths come in descending order, a number of equal ones
    is split into powers of two, and the steps are followed back from the largest sum. Long lengths are used first, so
    that the short ones, which fit anywhere, stay for later sequences.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((length for length in available if length <= room), reverse=True):
        left, some = min(available[length], room // length), 1
        while left > 0:
            some = min(some, left)
            steps.append((length, some, reach))
            reach |= (reach << (length * some)) & mask
            left, some = left - some, some * 2
        if reach >> room & 1:
            break
    goal = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, some, before in reversed(steps):
        if not before >> goal & 1:
            taken[length] = taken.get(length, 0) + some
            goal -= length * some
    return sorted(taken.items(), reverse=True)


def pack_lengths(counts: Mapping[int, int], size: int = SEQUENCE) -> list[Pattern]:
    """Minimum bin slack over the number of pieces of each length.

    Every sequence starts with the longest piece left, and the subset sum over the other lengths finds the fullest
    combination with it. That combination is removed as often as the counts allow before the next one is
    searched, so there are at most some patterns per length, however many pieces there are.
    """
    left = {length: count for length, count in counts.items() if count > 0}
    patterns: list[Pattern] = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        parts = dict(fullest(rest, size - longest))
        parts[longest] = parts.get(longest, 0) + 1
        times = min(left[length] // number for length, number in parts.items())
        patterns.append((times, sorted(parts.items(), reverse=True)))
        for length, number in parts.items():
            left[length] -= number * times
            if not left[length]:
                del left[length]
    return patterns


def places(patterns: list[Pattern]) -> np.ndarray:
    """Where the pieces of each length go, by their rank among equal lengths.

    One row per pattern and length, ordered: length, first rank, first sequence, pieces of this length in a sequence, and
    the offset of the first of them.
    """
    rows, used, sequence = [], {}, 0
    for times, parts in patterns:
        offset = 0
        for length, number in parts:
            rows.append((length, used.get(length, 0), sequence, number, offset))
            used[length] = used.get(length, 0) + times * number
            offset += length * number
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the file of a byte-level tokenizer: printable Latin-1 for itself, the rest in
    order from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in shown]
    return {chr(byte): byte for byte in shown} | {chr(0x100 + at): byte for at, byte in enumerate(hidden)}


def _as_ranks(file: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Ranks and special tokens of a tokenizer file, if it is plain byte-level BPE in which ids are the order of merging."""
    model, split = file["model"], file["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE"
        and not any(model.get(name) for name in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and file["normalizer"] is file["truncation"] is file["padding"] is None
        and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) == ("ByteLevel", False, True)
        and not any(token[name] for token in file["added_tokens"] for name in ("single_word", "lstrip", "rstrip", "normalized"))
    )
    if not plain:
        return None
    special = {token["content"]: token["id"] for token in file["added_tokens"]}
    alphabet, vocabulary = _byte_alphabet(), {token: rank for token, rank in model["vocab"].items() if token not in special}
    merges = [pair if isinstance(pair, str) else " ".join(pair) for pair in model["merges"]]
    merged = [vocabulary.get(pair.replace(" ", "", 1)) for pair in merges]
    if merged != list(range(256, 256 + len(merges))) or len(vocabulary) != 256 + len(merges):
        return None
    return {bytes(alphabet[character] for character in token): rank for token, rank in vocabulary.items()}, special


@lru_cache(maxsize=2)
def _encoder(path: str) -> Callable[[str], Sequence[int]]:
    """The ids of a text by the tokenizer file at ``path`` on this machine, or as Spark has sent it.

    A plain byte-level BPE has the same ids as a rank file, which another library encodes four times as fast.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
    path = path if os.path.exists(path) else SparkFiles.get(path.rpartition("/")[2])
    with open(path, encoding="utf-8") as file:
        ranks = _as_ranks(json.load(file))
    if ranks is None:
        tokenizer = Tokenizer.from_file(path)
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks[0], special_tokens=ranks[1])
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


def cut_points(total: int, size: int) -> list[int]:
    """The starts of a document's pieces: all of ``size`` but the first, which may be shorter."""
    return [0, *range(total % size or size, total, size)]


def pieces(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end_id: int = END_ID
) -> DataFrame:
    """The pieces of every document: ``_id, piece, start, length, ids_crc32`` and ``_at``, a number of the row.

    A document is its ids and ``end_id``. One of more than ``size`` is cut; every document thus has one piece that may be
    shorter than ``size``.
    """
    in_workers(docs.sparkSession)
    source = docs.select(column(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), F.monotonically_increasing_id().alias("_at"))
    kind = source.schema["_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                owner, piece, start, length, crc = [], [], [], [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    ids = np.append(np.asarray(encode(text), dtype="<u4"), np.array([end_id], dtype="<u4"))
                    starts = cut_points(len(ids), size)
                    for number, (first, behind) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                        owner.append(row)
                        piece.append(number)
                        start.append(first)
                        length.append(behind - first)
                        crc.append(zlib.crc32(ids[first:behind].tobytes()))
                owner = pa.array(owner, pa.int64())
                columns = [
                    batch.column(0).take(owner),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    batch.column(2).take(owner),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "piece", "start", "length", "ids_crc32", "_at"])

    return source.mapInArrow(cut, PIECES.format(id=kind))


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SEQUENCE,
    end_id: int = END_ID,
) -> DataFrame:
    """All documents in sequences of at most ``size`` tokens, as few as minimum bin slack finds.

    Returns one row per piece: the id column, ``piece, start, length, ids_crc32, sequence_id, offset``. A document is its
    ids by the tokenizer, special strings included as the tokenizer handles them, and ``end_id``; only longer ones
    than ``size`` are cut. A null or empty text is ``end_id`` alone. Rows with equal or null ids are documents of their own, other columns
    are left out, an empty table has no pieces.

    Texts are read once and never shuffled. The pieces are counted by length, ``pack_lengths`` packs these at most
    ``size`` counts, and each piece finds its place by its rank among the pieces of its length. Ranks are made within buckets of
    row numbers, so a length that holds most pieces is split.
    """
    spark = docs.sparkSession
    buckets = spread(spark)
    cut = written(pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, size=size, end_id=end_id))
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64("_at"), F.lit(buckets)))

    counts = cut.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_count"))
    counts = counts.withColumn("_before", F.expr("sum(_count) over (partition by length order by _bucket) - _count"))
    counts = written(counts)
    by_length = {row["length"]: row["_total"] for row in counts.groupBy("length").agg(F.sum("_count").alias("_total")).collect()}
    table = places(pack_lengths(by_length, size))

    rank = F.expr("row_number() over (partition by length, _bucket order by _at, piece) - 1")
    ranked = cut.withColumn("_rank", rank).join(counts.drop("_count"), ["length", "_bucket"])
    ranked = ranked.select("_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_rank")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_length = np.searchsorted(table[:, 0], np.arange(size + 2))
        for batch in batches:
            length, rank = (batch.column(at).to_numpy(zero_copy_only=False) for at in (3, 5))
            row = np.empty(len(rank), dtype=np.int64)
            for one in np.unique(length):
                first, behind = of_length[one], of_length[one + 1]
                some = length == one
                row[some] = first + np.searchsorted(table[first:behind, 1], rank[some], side="right") - 1
            _, start, sequence, number, offset = table[row].T
            turn, slot = np.divmod(rank - start, number)
            columns = [*batch.columns[:5], pa.array(sequence + turn), pa.array(offset + slot * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = ranked.schema["_id"].dataType.simpleString()
    placed = ranked.mapInArrow(
        place, f"_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return placed.withColumnRenamed("_id", id_col)

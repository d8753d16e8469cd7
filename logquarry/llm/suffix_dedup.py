"""Suffix dedup: repeated passages found by refining hashes at winnowed positions, in place of prefix doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, in_workers, shuffles_go, text_or_empty, written
from .hashing import Spans, mix

# Passages of this many bytes are looked for.
LENGTH = 100
# The sampled suffixes are first ranked by this many bytes.
SEED = 32
# Then by what blocks of so many neighbouring passages have in common: with one, the passage itself.
WIDTHS = (24, 8, 1)
BYTES_AT_ONCE = 8_000_000

_PLACE = np.uint64(0x9E6C63D0876A9A47)


def _least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row, by doubling."""
    least, size = values, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[: len(values) - width + 1], least[width - size :])


class Passages:
    """The passages of one text, each with the suffix that it samples.

    Of the seeds in a passage the one with the least hash is sampled, so equal passages sample an equal suffix, at the
    same distance from their start. There is about one sampled suffix for 35 bytes.
    """

    def __init__(self, data: bytes, length: int, seed: int):
        self.length, self.reach = length, length - seed
        self.count = max(0, len(data) - length + 1)
        if not self.count:
            self.suffix = np.zeros(0, dtype=np.int64)
            return
        self.spans = Spans(data)
        starts = np.arange(len(data) - seed + 1)
        order = self.spans.hash(starts, starts + seed) & np.uint64(0xFFFFFFFF00000000) | starts.astype(np.uint64)
        self.suffix = (_least_in_window(order, self.reach + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def blocks(self, starts: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
        """Blocks of the passages with these starts: first and last start, rank, and context.

        Passages that sample one suffix are cut into blocks by their distance from it. The rank is that of the bytes that
        all passages of such a block have; equal passages are in blocks of equal rank. The context is all
        bytes that the passages of this block have; of blocks of equal rank and context the passages are equal one by one.
        """
        if not len(starts):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        suffix = self.suffix[starts]
        block = (suffix - starts) // width
        new = (np.diff(starts) != 1) | (np.diff(suffix) != 0) | (np.diff(block) != 0)
        first = np.flatnonzero(np.concatenate([[True], new]))
        low, high = starts[first], starts[np.append(first[1:], len(starts)) - 1]
        suffix, nearest = suffix[first], block[first] * width
        farthest = np.minimum(nearest + width - 1, self.reach)
        rank = self.spans.hash(suffix - nearest, suffix - farthest + self.length)
        place = ((suffix - low) << 8 | (high - low)).astype(np.uint64)
        context = mix(self.spans.hash(low, high + self.length) + mix(place + np.uint64(1))) & np.uint64(0x7FFFFFFF)
        return low, high, mix(rank + nearest.astype(np.uint64)), context


def _split_ids(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as numbers, and which are there; null comes first."""
    valid = ids.is_valid().to_numpy(zero_copy_only=False)
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), valid


def _combined(part: pa.RecordBatch, row: np.ndarray, blocks: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """Rows for the shuffle. Of equal rank and context only the first in document order asks; others are known repeats."""
    low, high, rank, context = blocks
    number, valid = _split_ids(part.column(0))
    hashes = part.column(1).to_numpy() if part.num_columns > 2 and part.schema.names[1] == "_hash" else np.zeros_like(number)
    order = np.lexsort((low, hashes[row], number[row], valid[row], context, rank))
    repeat = np.zeros(len(order), dtype=bool)
    here, last = order[1:], order[:-1]
    same_place = (low[here] == low[last]) & (number[row[here]] == number[row[last]]) & (valid[row[here]] == valid[row[last]])
    # Rows of one id and text are one document, so a place is never its own repeat; both ask.
    same_place &= hashes[row[here]] == hashes[row[last]]
    repeat[here] = (rank[here] == rank[last]) & (context[here] == context[last])
    repeat[here[same_place & repeat[here]]] = False
    # Known repeats are dealt out by their place, by short numbers that take little room.
    spread = mix(number[row].astype(np.uint64) * _PLACE + low.astype(np.uint64)) & np.uint64(0xFFFF)
    taken = part.select([name for name in part.schema.names if name in ("_id", "_hash")]).take(pa.array(row))
    arrays = [
        *taken.columns,
        pa.array(np.where(repeat, spread, rank).view(np.int64)),
        pa.array(np.where(repeat, np.uint64(0), context & np.uint64(0x7FFFFFFF)).astype(np.int32)),
        # Start, number of further passages, and whether it is a known repeat, in one number.
        pa.array(low << 8 | (high - low) << 1 | repeat),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=[*taken.schema.names, "_rank", "_context", "_place"])


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch of some megabytes of text each, with the texts as bytes; with ``_size`` they are compressed."""
    texts = batch.column("_text").to_pylist()
    packed = "_size" in batch.schema.names
    sizes = batch.column("_size").to_pylist() if packed else [len(text) for text in texts]
    start, total = 0, 0
    for stop, size in enumerate(sizes):
        total += size
        if total >= BYTES_AT_ONCE or stop == len(texts) - 1:
            data = texts[start : stop + 1]
            if packed:
                data = [pa.decompress(d, n, "zstd", asbytes=True) for d, n in zip(data, sizes[start : stop + 1], strict=True)]
            else:
                data = [text.encode() for text in data]
            yield batch.slice(start, stop + 1 - start), data
            start, total = stop + 1, 0


def suffix_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED
) -> DataFrame:
    """Remove every byte that a passage of ``length`` bytes covers which also starts earlier.

    Earlier is a smaller integer id, or the same id and a smaller start. Texts are their UTF-8 bytes, passages
    never cross documents and are judged on the input. Returns ``id_col, n_bytes, n_removed, n_spans, spans, kept``: how many
    bytes there were and go, in how many maximal runs, these runs as ``low, high`` (exclusive), and what is left as binary.
    ``length`` may exceed ``seed`` by at most 127.

    In place of prefix doubling, hashes of ever more bytes on a sample of the suffixes that loses no repeat (see ``Passages``). Spark sorts suffixes by rank:
    first by their first ``seed`` bytes; then, for those still in question, by ever more of the bytes around, up to
    whole passages. After each sort, what has a unique rank is done, since nothing is equal to it. Where all
    of one rank agree in all bytes that their passages reach, all but the first are repeats. The rest is in question.

    A rank is a 64-bit name for bytes; with the context it makes 95 bits wherever two are taken for equal. Equal ones in
    one portion of the input are combined before the shuffle, so a passage that stands in a third of all rows
    does not come together in one task. Texts are shuffled once, by id and compressed one by one, and that shuffle is
    used again in every round.

    A null text is as an empty one. An id of null is the smallest. Rows of one id are ordered by a hash of their
    text; rows of one id and text are one document, and both keep what one keeps. An empty table gives an
    empty result. Other columns are left out.
    """
    if not 0 <= length - seed <= 127:
        raise ValueError("length must be seed to seed + 127")
    in_workers(docs.sparkSession)
    texts = docs.select(column(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    # The hash costs room in every row, so it is there only where ids repeat.
    repeated = texts.groupBy("_id").count().where(F.col("count") > 1)
    with shuffles_go(docs.sparkSession):
        hashed = not repeated.isEmpty()
    if hashed:
        texts = texts.select("_id", F.xxhash64("_text").alias("_hash"), "_text")
    key = texts.columns[:-1]
    listed = T.StructType(
        [
            *texts.schema.fields[:-1],
            T.StructField("_rank", T.LongType()),
            T.StructField("_context", T.IntegerType()),
            T.StructField("_place", T.LongType()),
        ]
    )

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [text.encode() for text in batch.column(len(key)).to_pylist()]
            sizes = pa.array([len(text) for text in data], pa.int64())
            squeezed = pa.array([pa.compress(text, "zstd", asbytes=True) for text in data], pa.binary())
            columns = [*batch.columns[: len(key)], sizes, squeezed]
            yield pa.RecordBatch.from_arrays(columns, names=[*key, "_size", "_text"])

    small = [T.StructField("_size", T.LongType()), T.StructField("_text", T.BinaryType())]
    squeezed = texts.mapInArrow(squeeze, T.StructType([*texts.schema.fields[:-1], *small]))

    def with_text(found: DataFrame, how: str) -> DataFrame:
        names = [name for name in found.columns if name not in key]
        found = found.select(*(F.col(name).alias(f"{name}_found") for name in key), *names)
        same = F.lit(True)
        for name in key:
            same = same & F.col(name).eqNullSafe(F.col(f"{name}_found"))
        return squeezed.join(found, same, how).select(*key, "_size", "_text", *names)

    def blocks_of(rows: DataFrame, width: int) -> DataFrame:
        """Blocks of all passages, or of those of the ranges in ``_open``."""

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data in _portions(batch):
                    ranges = part.column("_open").to_pylist() if "_open" in part.schema.names else [None] * len(data)
                    found = []
                    for text, open_ in zip(data, ranges, strict=True):
                        passages = Passages(text, length, seed)
                        starts = np.arange(passages.count)
                        if open_ is not None:
                            places = np.sort(np.array(open_, dtype=np.int64))
                            low, more = places >> 8, (places & 0xFF) >> 1
                            starts = np.repeat(low - np.cumsum(more + 1) + more + 1, more + 1) + np.arange((more + 1).sum())
                        found.append(passages.blocks(starts, width))
                    joined = tuple(np.concatenate(arrays) for arrays in zip(*found, strict=True))
                    rows_of = np.repeat(np.arange(len(data)), [len(low) for low, *_ in found])
                    yield _combined(part, rows_of, joined)

        return rows.mapInArrow(blocks, listed)

    def judged(blocks: DataFrame) -> DataFrame:
        """By text: the places of repeats, and those still in question."""
        known = F.col("_place").bitwiseAND(F.lit(1)) == 1
        blocks = blocks.select("*", known.alias("_known"))
        where = ", ".join([*key, "_place"])
        of_rank = "over (partition by _known, _rank)"
        ranked = blocks.select(
            "*",
            F.expr(f"count(*) {of_rank}").alias("_n"),
            F.expr(f"min(_context) {of_rank} = max(_context) {of_rank}").alias("_alike"),
            F.expr(f"min(struct({where})) {of_rank}").alias("_first"),
        )
        later = ~F.struct(*key, "_place").eqNullSafe(F.col("_first"))
        repeat = F.when(F.col("_known"), True).when(F.col("_n") == 1, F.lit(None))
        repeat = repeat.when(~F.col("_alike"), False).when(later, True)
        found = ranked.select(*key, "_place", repeat.alias("_repeat")).where(F.col("_repeat").isNotNull())
        return found.groupBy(*key).agg(
            F.collect_set(F.when(F.col("_repeat"), F.col("_place"))).alias("_repeats"),
            F.collect_set(F.when(~F.col("_repeat"), F.col("_place"))).alias("_open"),
        )

    # The first round sorts all sampled suffixes, most of which are done then. What is left is a small table, and the
    # large shuffle goes before the texts are shuffled.
    with shuffles_go(docs.sparkSession):
        rounds = [written(judged(blocks_of(texts, length - seed + 1)))]
    for width in WIDTHS:
        open_texts = with_text(rounds[-1].where(F.size("_open") > 0).select(*key, "_open"), "inner")
        rounds.append(judged(blocks_of(open_texts, width)))
    removals = rounds[0].select(*key, "_repeats")
    for found in rounds[1:]:
        removals = removals.union(found.select(*key, "_repeats"))
    removals = removals.groupBy(*key).agg(F.flatten(F.collect_list("_repeats")).alias("_repeats"))

    span = T.StructType([T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())])
    out = T.StructType(
        [
            T.StructField("_id", T.LongType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("spans", T.ArrayType(span)),
            T.StructField("kept", T.BinaryType()),
        ]
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in _portions(batch):
                spans, kept, removed = [], [], []
                for text, places in zip(data, part.column("_repeats").to_pylist(), strict=True):
                    # +1 where passages that go begin, -1 behind their last byte.
                    change = np.zeros(len(text) + 1, dtype=np.int32)
                    if places:
                        places = np.array(places, dtype=np.int64)
                        np.add.at(change, places >> 8, 1)
                        np.add.at(change, (places >> 8) + ((places & 0xFF) >> 1) + length, -1)
                    gone = np.cumsum(change)[:-1] > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    spans.append([{"low": a, "high": b} for a, b in edges.reshape(-1, 2).tolist()])
                    removed.append(int(gone.sum()))
                    kept.append(np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if spans[-1] else text)
                arrays = [
                    part.column(0),
                    pa.array([len(text) for text in data], pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))),
                    pa.array(kept, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    final = with_text(removals, "left").mapInArrow(remove, out)
    return final.select(
        F.col("_id").alias(id_col), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "spans", "kept"
    )

"""Sharding as vector bin packing: bytes, tokens and rows of the shards are balanced together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, cut, plain_blanks, text_or_empty, wide_hash, words_of

# Bytes that a document takes beside its text.
ROW_BYTES = 16
# Small groups are packed in this many bundles per shard; a larger group is packed by itself.
BUNDLES_PER_SHARD = 256
# A group above this share of a shard is split into parts below it.
LARGEST_PART = 0.25
# How much each residual counts: bytes first, so that sizes come out near equal.
WEIGHTS = (1.0, 0.05, 0.02)
SLOT_BUCKETS = 256
DIMENSIONS = ("_bytes", "_tokens", "_rows")


def place(items: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each item of a matrix of sizes, one column per dimension.

    Items go from the largest share down, each to the shard where the dot product of its sizes with the
    shard's residual capacity is highest; the first such shard wins a tie.
    """
    capacity = np.maximum(items.sum(axis=0), 1) / n_shards
    shares = items / capacity
    residual = np.tile(np.array(WEIGHTS), (n_shards, 1))
    shards = np.zeros(len(items), dtype=np.int64)
    for at in np.argsort(-shares[:, 0] - 1e-3 * shares[:, 1:].sum(axis=1), kind="stable"):
        shard = int(np.argmax(residual @ shares[at]))
        shards[at] = shard
        residual[shard] -= shares[at] * np.array(WEIGHTS)
    return shards


def _sums() -> list[Column]:
    return [F.sum(name).alias(name) for name in DIMENSIONS]


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of known size for a broadcast join."""
    return F.broadcast(spark.createDataFrame(rows, schema).coalesce(1))


def shard_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 40
) -> DataFrame:
    """``shard`` and ``slot`` for every row, with sizes near equal (law ``bytes``).

    Rows of equal text are one group. Groups below a bundle's share of a shard are bundled by hash; larger groups stand
    alone; a group above a quarter of a shard is split by a hash of the id, as it could not be
    balanced whole. These items are at most some hundred per shard whatever the input (larger groups are so
    few because their sizes add up to the total), so the driver places them: largest first, each where the dot
    product with the residual capacity is highest. Slots number the rows of a shard from 0.

    Returns the given columns without the text, and ``size`` (UTF-8 bytes of the text plus 16), ``text_crc32``,
    ``law``, ``shard``, ``slot``, ``grown_shard`` (null under this law). A null text is as an empty one. Repeated
    rows are placed like others; equal rows of one id share a part. An empty table gives an empty result. Columns
    named like a result are replaced.

    The texts are read once and never shuffled. What is shuffled are hashes, sizes and the other columns.
    """
    spark = docs.sparkSession
    text = F.col("_text")
    first, second = wide_hash(text)
    others = [column(name).alias(name) for name in docs.columns if name != text_col]
    rows = docs.select(column(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), F.struct(*others).alias("_row"))
    rows = cut(
        rows.select(
            "_id",
            "_row",
            first.alias("_h1"),
            second.alias("_h2"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("_bytes"),
            F.size(words_of(plain_blanks(text))).cast("long").alias("_tokens"),
            F.lit(1).cast("long").alias("_rows"),
            F.crc32(text).alias("_crc"),
        )
    )

    total = rows.agg(*_sums()).first()
    capacity = [max(value or 0, 1) / n_shards for value in total]
    share = F.greatest(*(F.col(name) / F.lit(size) for name, size in zip(DIMENSIONS, capacity, strict=True)))
    # At most 3 * BUNDLES_PER_SHARD * n_shards groups can have such a share.
    large = rows.groupBy("_h1", "_h2").agg(*_sums()).where(share > 1 / BUNDLES_PER_SHARD)
    large = large.select("_h1", "_h2", F.ceil(share / LARGEST_PART).cast("int").alias("_parts")).collect()
    parts = _table(spark, [tuple(row) for row in large], "_h1 long, _h2 long, _parts int")

    part = F.when(F.col("_parts") > 1, F.pmod(F.xxhash64("_id"), "_parts")).otherwise(0).cast("int")
    bundle = F.pmod(F.col("_h1"), F.lit(BUNDLES_PER_SHARD * n_shards))
    alone = F.col("_parts").isNotNull()
    marked = rows.join(parts, ["_h1", "_h2"], "left").withColumns(
        {
            "_item1": F.when(alone, F.col("_h1")).otherwise(bundle),
            "_item2": F.when(alone, F.col("_h2")).otherwise(0),
            "_part": F.when(alone, part).otherwise(-1),
        }
    )
    key = ["_item1", "_item2", "_part"]
    items = sorted(map(tuple, marked.groupBy(*key).agg(*_sums()).collect()))
    sizes = np.array([item[3:] for item in items], dtype=np.float64).reshape(-1, len(DIMENSIONS))
    placed = [(*item[:3], int(shard)) for item, shard in zip(items, place(sizes, n_shards), strict=True)]
    placement = _table(spark, placed, "_item1 long, _item2 long, _part int, _shard int")

    # Slots: rows before the bucket, plus the rank in it, so that no task holds a whole shard.
    bucket = F.pmod(F.xxhash64(F.lit("slot"), "_id"), F.lit(SLOT_BUCKETS)).cast("int")
    sharded = marked.join(placement, key).withColumn("_bucket", bucket)
    counts = sharded.groupBy("_shard", "_bucket").count().collect()
    starts, seen = [], dict.fromkeys(range(n_shards), 0)
    for shard, at, count in sorted(map(tuple, counts)):
        starts.append((shard, at, seen[shard]))
        seen[shard] += count
    offsets = _table(spark, starts, "_shard int, _bucket int, _start long")
    order = "row_number() over (partition by _shard, _bucket order by _id, _h1, _h2) - 1"
    ranked = sharded.withColumn("_rank", F.expr(order)).join(offsets, ["_shard", "_bucket"])
    results = {
        "size": F.col("_bytes"),
        "text_crc32": F.col("_crc"),
        "law": F.lit("bytes"),
        "shard": F.col("_shard"),
        "slot": (F.col("_start") + F.col("_rank")).cast("long"),
        "grown_shard": F.lit(None).cast("int"),
    }
    kept = [F.col("_row").getField(name).alias(name) for name in docs.columns if name not in (text_col, *results)]
    return ranked.select(*kept, *(value.alias(name) for name, value in results.items()))


def write_shards(docs: DataFrame, placed: DataFrame, folder: str, *, id_col: str = "doc_id") -> None:
    """Write the rows of ``docs`` below ``folder``, one sub-folder ``shard=N`` each, in the order of their slots.

    ``placed`` is the result of ``shard_documents`` on rows with unique ids. A column ``shard`` of ``docs`` gives way to the
    folder's name; other columns may be called anything.
    """
    where = placed.select(column(id_col).alias("_placed_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    # All columns in one, so that no name can clash.
    names = [name for name in docs.columns if name != "shard"]
    rows = docs.select(column(id_col).alias("_id"), F.struct(*(column(name).alias(name) for name in names)).alias("_row"))
    joined = rows.join(where, F.col("_id").eqNullSafe(F.col("_placed_id")))
    ordered = joined.repartition("_shard", F.expr("_slot div 100000")).sortWithinPartitions("_shard", "_slot")
    fields = [F.col("_row").getField(name).alias(name) for name in names]
    ordered.select(*fields, F.col("_shard").alias("shard")).write.partitionBy("shard").parquet(folder)

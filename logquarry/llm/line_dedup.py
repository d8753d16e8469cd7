"""Line dedup: drop lines that many documents share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, packed, unpacked, wide_hash


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case.

    For ASCII that is ``lower``, which is far cheaper than a translation.
    """
    bare = F.btrim(line, F.lit(SPACES))
    ascii_only = F.length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    )


def line_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """Drop each line whose key stands in ``min_docs`` documents or more, but for the largest id that holds it.

    Lines are exploded with their position and hashed (128 bits); distinct documents are counted
    per hash; positions to drop come back to their document, and the other lines are joined by
    ``\\n`` in their order. Keys of fewer than ``min_chars`` code points never drop.

    Returns the given columns with the remaining text, and ``n_lines``, ``n_dropped``. A null text
    counts as one empty line and stays null. Rows with one id are one document; a null id is a
    document that is smaller than all others. An empty table gives an empty result. Columns named like
    a result are replaced.

    Texts are shuffled once; only hashes and positions are shuffled otherwise. Counts are combined
    before the shuffle, and a hot line is an ordinary skewed join that Spark splits.
    """
    row_hash = F.xxhash64(F.lit("row"), "_text").alias("_text_hash")
    rows = packed(docs, id_col, text_col).withColumn("_text_hash", row_hash)
    line = rows.select("_id", "_text_hash", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
    long_enough = line.where(F.length("_line") >= min_chars)
    keyed = long_enough.select("_id", "_text_hash", "_pos", line_key(F.col("_line")).alias("_key"))
    first, second = wide_hash(F.col("_key"))
    found = cut(
        keyed.where(F.length("_key") >= min_chars).select(
            "_id", "_text_hash", "_pos", first.alias("_h1"), second.alias("_h2")
        )
    )

    holder = F.struct("_id")
    common = (
        found.groupBy("_h1", "_h2")
        .agg(F.countDistinct(holder).alias("_docs"), F.max(holder).alias("_keeper"))
        .where(F.col("_docs") >= min_docs)
        .select("_h1", "_h2", F.col("_keeper._id").alias("_keeper"))
    )
    dropped = (
        found.join(common, ["_h1", "_h2"])
        .where(~F.col("_id").eqNullSafe(F.col("_keeper")))
        .groupBy("_id", "_text_hash")
        .agg(F.collect_set("_pos").alias("_positions"))
        .select(F.col("_id").alias("_drop_id"), F.col("_text_hash").alias("_drop_hash"), "_positions")
    )
    same = F.col("_id").eqNullSafe(F.col("_drop_id")) & (F.col("_text_hash") == F.col("_drop_hash"))
    joined = rows.join(dropped, same, "left").select("_text", "_row", "_positions", F.split("_text", "\n").alias("_lines"))

    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    left = F.transform(F.array_except(every, F.col("_positions")), lambda at: F.get(F.col("_lines"), at))
    changed = F.col("_positions").isNotNull()
    original = F.when(~changed, F.col("_text")).otherwise(F.array_join(left, "\n"))
    results = {
        "n_lines": F.size("_lines").cast("long"),
        "n_dropped": F.when(changed, F.size("_positions")).otherwise(0).cast("long"),
    }
    return unpacked(joined, docs.columns, text_col, original, results)

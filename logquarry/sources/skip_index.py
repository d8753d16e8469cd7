"""A skip index for text search: for each batch file the trigrams of its events, as a bit map.

A text that holds the query holds all trigrams of the query, so a file without one of their bits cannot match and is never
opened. A bit may stand for several trigrams; then a file is opened in vain, and no match is ever lost. With
``FULL`` as the largest share of bits set, a query of ``t`` trigrams that a file does not hold passes with a chance of at most
about ``FULL ** t``.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import no_rows
from .files import exists, read_events
from .inventory import LAYOUT, key_slices, layout_of

# Bits of a page, as Spark's bit maps have them, and the largest number of pages of a file.
PAGE_BITS, MOST_PAGES = 32_768, 64
FULL = 0.25
FILES_AT_ONCE = 4096
_INDEX = f"key string, modified timestamp, pages int, bits map<int,binary>, {LAYOUT[0]} string, {LAYOUT[1]} date"


def _trigrams(text: Column) -> Column:
    """All runs of three characters, lower-cased as searches do."""
    return F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(.{3}))"), F.lit(1))


def _bit(trigram: Column) -> Column:
    return F.xxhash64(trigram).bitwiseAND(PAGE_BITS * MOST_PAGES - 1)


def _file(key: Column) -> Column:
    """A number for the key, as short as the sorting of bits by file wants it. Files of one number have the bits of both, so none is ruled out wrongly."""
    return F.xxhash64(key)


def _numbered_bits(events: DataFrame) -> DataFrame:
    """``file, pages, bits`` as in ``file_bits``, with the number of the file."""
    # A row for each text carries the number itself: as an expression beside the trigrams it would be worked out again for each of them.
    texts = events.select(F.inline(F.array(*(F.struct(_file(F.col("key")).alias("file"), F.col(name).alias("text")) for name in ("body", "id", "type")))))
    # Outer, as Spark would extract the trigrams once more to see beforehand whether there are any.
    grams = texts.select("file", F.explode_outer(F.array_distinct(_trigrams(F.col("text")))).alias("gram")).where(F.col("gram").isNotNull())
    bits = grams.select("file", _bit(F.col("gram")).cast("int").alias("bit")).distinct()
    used = F.count("*").over(Window.partitionBy("file"))
    wanted = F.ceil(F.log2(F.greatest(used / (FULL * PAGE_BITS), F.lit(1.0))))
    bits = bits.withColumn("pages", F.least(F.pow(F.lit(2), wanted), F.lit(MOST_PAGES)).cast("int"))
    page, position = F.expr(f"bit div {PAGE_BITS}").cast("int") % F.col("pages"), F.col("bit").cast("long") % PAGE_BITS
    folded = bits.groupBy("file", "pages", page.alias("page")).agg(F.bitmap_construct_agg(position).alias("map"))
    return folded.groupBy("file", "pages").agg(F.map_from_entries(F.collect_list(F.struct("page", "map"))).alias("bits"))


def file_bits(events: DataFrame) -> DataFrame:
    """``key, pages, bits`` of events with ``id, type, body, key``; ``bits`` holds the pages that have any.

    The different bits of a file are counted in the largest map first. It is then folded until a quarter of it is used: pages whose
    numbers are equal modulo the number of pages left are laid over each other. Bits are brought together as numbers, and a map is made
    only in the size it is kept in.
    """
    keys = events.select("key").distinct().withColumn("file", _file(F.col("key")))
    return keys.join(_numbered_bits(events), "file").select("key", "pages", "bits")


def read_skip_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored index; before the first update it has no rows."""
    if not exists(spark, path):
        return no_rows(spark, _INDEX)
    return spark.read.schema(_INDEX).parquet(path)


def update_skip_index(
    spark: SparkSession, root: str, inventory: DataFrame, path: str, *, files_at_once: int = FILES_AT_ONCE
) -> int:
    """Index the batch files of the inventory that the index at ``path`` does not hold yet; returns how many.

    Files are read by their exact paths in slices; each slice is one append, so a run that breaks off goes on where it stopped. A file
    without a readable line is entered too. Entries carry the time at which the file was modified, and
    hold for that version only.
    """
    known = read_skip_index(spark, path).select("key", "modified")
    stamp = layout_of(F.col("key"))
    batches = inventory.select("key", "length", "modified").withColumns(stamp).where(F.col("day").isNotNull())
    missing = batches.join(known, ["key", "modified"], "left_anti")
    done = 0
    for keys in key_slices(missing.select("key", "length", F.col("day").alias("timestamp")), first=files_at_once, most=files_at_once):
        events = read_events(spark, root, keys=keys)
        slice_ = spark.createDataFrame(pa.table({"key": pa.array(keys, pa.string())}))
        rows = batches.join(slice_, "key", "left_semi").dropDuplicates(["key", "modified"])
        rows = rows.withColumn("file", _file(F.col("key"))).join(_numbered_bits(events), "file", "left")
        rows = rows.select(
            "key", "modified", F.coalesce("pages", F.lit(1)).alias("pages"),
            F.coalesce("bits", F.create_map().cast("map<int,binary>")).alias("bits"), *LAYOUT,
        )
        rows.repartition(*(F.col(name) for name in LAYOUT)).write.partitionBy(*LAYOUT).mode("append").parquet(path)
        done += len(keys)
    return done


def query_bits(spark: SparkSession, query: str, *, wildcard: bool = True) -> list[int]:
    """The bits that every text with the query has. Wildcards cut the query into runs; runs of less than three characters give none."""
    runs = re.split("[%_]", query) if wildcard else [query]
    # An inline row: the optimizer computes the result itself, no job is started.
    row = spark.sql("SELECT * FROM VALUES (:runs) AS t(runs)", args={"runs": "\0".join(runs)})
    grams = F.flatten(F.transform(F.split("runs", "\0"), _trigrams))
    return sorted(set(row.select(F.transform(grams, _bit)).head()[0]))


def may_hold(bits: list[int]) -> Column:
    """Whether a row of the index has all the bits."""
    found = F.lit(True)
    for bit in bits:
        page, position = divmod(bit, PAGE_BITS)
        byte = F.substring(F.col("bits")[F.lit(page) % F.col("pages")], position // 8 + 1, 1)
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        found = found & F.coalesce(F.getbit(value, F.lit(position % 8)) == 1, F.lit(False))
    return found


def not_ruled_out(keys: DataFrame, index: DataFrame, query: str | None, *, wildcard: bool = True) -> DataFrame:
    """The files, ``key`` and ``modified`` among their columns, that may hold the query. Files without an entry stay."""
    if not query or query == "*":
        return keys
    bits = query_bits(keys.sparkSession, query, wildcard=wildcard)
    if not bits:
        return keys
    out = index.where(~may_hold(bits)).select("key", "modified")
    return keys.join(out, ["key", "modified"], "left_anti").select(*keys.columns)

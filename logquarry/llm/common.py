"""What the operators of this subpackage share: table access, word columns, row packing, checkpoints."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of every word and line rule here: blank, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def column(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str) -> Column:
    return F.coalesce(column(name).cast("string"), F.lit(""))


def plain_blanks(text: Column) -> Column:
    """The text with a blank for each of ``SPACES``; as long as before."""
    for character in SPACES[1:]:
        text = F.replace(text, F.lit(character), F.lit(" "))
    return text


def words_of(plain: Column) -> Column:
    """The words of a text that has passed ``plain_blanks``: maximal runs of other characters, in order."""
    return F.array_remove(F.split(plain, " "), "")


def wide_hash(value: Column) -> list[Column]:
    """Two independent 64-bit hashes of a value; together they stand for it."""
    return [F.xxhash64(value), F.xxhash64(F.lit("second"), value)]


def packed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``_text`` and all columns but the text in ``_row``, so that no name can clash."""
    others = [column(name).alias(name) for name in df.columns if name != text_col]
    return df.select(column(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), F.struct(*others).alias("_row"))


def unpacked(df: DataFrame, names: Sequence[str], text_col: str, text: Column, results: dict[str, Column]) -> DataFrame:
    """The columns ``names`` as they were, with ``text`` as the text, and the results behind them.

    A result takes the place of an input column of the same name.
    """
    kept = [
        text.alias(name) if name == text_col else F.col("_row").getField(name).alias(name)
        for name in names
        if name not in results
    ]
    return df.select(*kept, *(value.alias(name) for name, value in results.items()))


def shared_folder(spark: SparkSession) -> None:
    """Make ``checkpoint()`` write where the cluster says, or in local mode to a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder; later plans start from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(spark: SparkSession) -> int:
    """How many partitions a shuffle has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fewer(df: DataFrame, rows: int, per_task: int = 10_000, least: int = 12) -> DataFrame:
    """The same rows in no more partitions than so many rows are worth. Spark joins partitions; nothing is shuffled.

    A small table in many partitions leaves a file in each of them with every shuffle.
    """
    tasks = max(least, -(-rows // per_task))
    return df.coalesce(tasks) if tasks < spread(df.sparkSession) else df


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffles and checkpoints that no plan refers to any more; it learns of them by garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within it Spark removes the shuffles of a query as soon as the query has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_workers(spark: SparkSession) -> None:
    """Let local Python workers import this package from where the driver has it.

    On a cluster it is installed, or sent with ``--py-files``, as any other package.
    """
    context = spark.sparkContext
    root = str(Path(__file__).resolve().parents[2])
    known = context.environment.get("PYTHONPATH", "")
    if context.master.startswith("local[") and root not in known.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (known, root)))


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table of their own in the shared folder."""
    spark = df.sparkSession
    shared_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

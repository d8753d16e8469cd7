"""Trace records landed as JSON lines or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TRACE

_BROKEN = "_broken"


def scan_traces(spark: SparkSession, path: str, fmt: str = "json", *, strict: bool = False) -> DataFrame:
    """Trace records; ``input``, ``output``, ``metadata`` and ``usage`` are VARIANT in JSON files.

    Lines that are not JSON are left out; with ``strict`` they are an error. Times without an offset are UTC.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt != "json":
        raise ValueError(f"traces are read from json or parquet, not {fmt!r}")
    reader = spark.read.option("timeZone", "UTC")
    if strict:
        return reader.schema(TRACE).option("mode", "FAILFAST").json(path)
    schema = T.StructType([*TRACE, T.StructField(_BROKEN, T.StringType())])
    lines = reader.schema(schema).option("columnNameOfCorruptRecord", _BROKEN).json(path)
    # The reader refuses a query on the broken-line column alone, so a field goes with it.
    mark = F.concat(F.col(_BROKEN), F.left(F.coalesce("id", F.lit("")), F.lit(0)))
    return lines.where(mark.isNull()).drop(_BROKEN)

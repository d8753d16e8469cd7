"""Folders for derived files, and a parallel writer of files with given names.

Batch files carry metadata in their names, which Spark's writers do not let one choose. Spark
brings the lines of each file together in order; a task then only appends them to the file.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share, as a path with its scheme."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="logquarry-")
    # Without a scheme Spark takes its default file system, and so does this.
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/logquarry-{label}-{uuid.uuid4().hex}")
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(place).toString()


def write_named_files(lines: DataFrame, root: str) -> None:
    """Write rows ``key, position, text`` to the files the keys name, in order of position.

    A repeated task writes the same bytes to the same names.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        if "://" in root:
            files, base = fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1))
        elif root.startswith("file:"):
            files, base = fs.LocalFileSystem(), root.removeprefix("file:")
        else:
            raise ValueError(f"a root needs a scheme: {root!r}")
        current, stream = None, None
        for batch in batches:
            for key, part in batch.groupby("key", sort=False):
                if key != current:
                    if stream is not None:
                        stream.close()
                    path = f"{base}/{key}"
                    files.create_dir(path.rpartition("/")[0], recursive=True)
                    current, stream = key, files.open_output_stream(path)
                stream.write(("\n".join(part["text"]) + "\n").encode())
        if stream is not None:
            stream.close()
        yield pd.DataFrame({"done": [1]})

    ordered = lines.repartition("key").sortWithinPartitions("key", "position").select("key", "text")
    ordered.mapInPandas(write, "done int").write.format("noop").mode("overwrite").save()

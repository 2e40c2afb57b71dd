"""Sinks.  Nothing passes through the driver."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder the session names in ``spark.checkpoint.dir``.

    A machine-local folder is used only where the session runs on one machine and
    names none, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="veilwork-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_text(frame: DataFrame, path: str, column: str = "deidentified", rows_per_file: int = 0) -> None:
    """Overwrite ``path`` with one line per row.

    ``rows_per_file`` bounds each file (0: one file a task), for readers to whom a whole file is one row.
    """
    lines = frame.select(F.col(column).alias("value")).write.mode("overwrite")
    lines.option("maxRecordsPerFile", rows_per_file).text(path)


def path_key(path: Column) -> Column:
    """A name for a partition folder: readable tail plus a hash of the whole path."""
    tail = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "[^A-Za-z0-9._-]", "_")
    return F.concat(tail, F.lit("-"), F.substring(F.sha2(path, 256), 1, 16))


def write_per_file(frame: DataFrame, output: str, rows_per_file: int = 1_000_000) -> None:
    """One output folder per source path.

    Rows are rebalanced by path: a small source ends in one file, and a source with a large share of the rows is split
    over many tasks; ``rows_per_file`` bounds each file.
    """
    (
        frame.withColumn("path_key", path_key(F.col("path")))
        .hint("rebalance", F.col("path_key"))
        .write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("path_key")
        .parquet(output)
    )

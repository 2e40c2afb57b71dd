"""Streams: files in, rewritten text and summaries out; counts over event time."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.operators.dictionary import dictionary_chunks
from veilwork.operators.stats import file_statistics, summary_records
from veilwork.plans.text import deidentify_text
from veilwork.sources.readers import BINARY_SCHEMA, TEXT_SCHEMA


def stream_files(spark: SparkSession, path: str, binary: bool = False, files_per_batch: int = 1000) -> DataFrame:
    """New files below ``path`` as a stream of ``(doc_id, path, text)``, one row per file (Spark skips files of 0 bytes)."""
    if binary:
        source = (
            spark.readStream.format("binaryFile")
            .schema(BINARY_SCHEMA)
            .option("maxFilesPerTrigger", files_per_batch)
            .load(path)
            .select("path", F.decode("content", "UTF-8").alias("text"))
        )
    else:
        source = (
            spark.readStream.schema(TEXT_SCHEMA)
            .option("maxFilesPerTrigger", files_per_batch)
            .text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), "text")
        )
    # The state of the stream holds every path taken in, so a file that is listed again after a failure answers once.
    return source.select(F.xxhash64("path").alias("doc_id"), "path", "text").dropDuplicates(["path"])


def run_intake(
    files: DataFrame,
    output: str,
    checkpoint: str,
    salt: str | DataFrame,
    labels: Iterable[str] | None = None,
    policy: Mapping[str, str] | None = None,
    dictionary: DataFrame | None = None,
) -> None:
    """De-identify all files that have arrived, then stop.

    Each micro-batch overwrites its own folder, so a batch that is run again after a
    failure leaves the same output.  Texts go to ``output/text``, summaries to
    ``output/summary``, one for every file of the batch.  ``dictionary(entity, phrase)`` adds its findings to those of the rules.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        extra = dictionary_chunks(batch, dictionary) if dictionary is not None else None
        # kept without the texts taken in, whose files are not read again: every one of them has its row here
        done = deidentify_text(batch, salt, labels, policy, extra_chunks=extra).select("path", "deidentified", "chunks").persist()
        try:
            done.select("path", "deidentified").write.mode("overwrite").parquet(
                f"{output}/text/batch={batch_id}"
            )
            summary_records(file_statistics(done), done).write.mode("overwrite").parquet(
                f"{output}/summary/batch={batch_id}"
            )
        finally:
            done.unpersist()

    (
        files.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def windowed_counts(findings: DataFrame, lateness: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Findings ``(ts, entity)`` per event-time window and label; works on both modes.

    On a stream, rows later than ``lateness`` behind the newest are dropped.
    """
    source = findings.withWatermark("ts", lateness) if findings.isStreaming else findings
    return (
        source.groupBy(F.window("ts", width).alias("w"), "entity")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("w.start").alias("window_start"), "entity", "count")
    )

"""The nested annotation shape: ``array<struct<result, metadata map>>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def annotations(findings: Column) -> Column:
    """Findings as annotations with a result and a metadata map."""
    return F.transform(
        findings,
        lambda f: F.struct(
            f["chunk"].alias("result"),
            F.create_map(
                F.lit("entity"), f["entity"],
                F.lit("sentence"), f["sent_id"].cast("string"),
                F.lit("detector"), f["detector"],
            ).alias("metadata"),
        ),
    )


def explode_annotations(frame: DataFrame, column: str, *keep: str) -> DataFrame:
    """Zip results and metadata by position and give one row each: (chunk, ner_label)."""
    zipped = F.arrays_zip(
        F.col(f"{column}.result").alias("result"), F.col(f"{column}.metadata").alias("metadata")
    )
    return (
        frame.select(*keep, F.inline_outer(zipped))
        .filter(F.col("metadata").isNotNull())
        .select(*keep, F.col("result").alias("chunk"), F.col("metadata")["entity"].alias("ner_label"))
    )


def finished(column: Column, separator: str = "") -> Column:
    """Annotations flattened to one string."""
    return F.array_join(F.transform(column, lambda a: a["result"]), separator)

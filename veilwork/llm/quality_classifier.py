"""Quality classifier: hashed word n-gram logistic regression trained with FTRL updates, scored as sparse dot products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm import linear
from veilwork.llm.common import fold, labelled_sample, texts

#: About so many labelled rows, picked by a hash of the id, train the classifier.
MAX_TRAINING_ROWS = 6_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> np.ndarray:
    """Weights learned from labelled rows outside the held-out fold."""
    trained = ~fold(F.col("doc_id"), FOLDS, HELD_OUT) & F.col("doc_id").isNotNull()
    return linear.train(labelled_sample(docs, labels, label, trained, max_rows), chars=False)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row, each over its whole text.

    Null and empty texts have no features and score the bias alone.  Repeated rows score alike; only ``doc_id`` and
    ``text`` are read, so other columns cannot clash.
    """

    def finish(batch: pa.RecordBatch, margin: np.ndarray) -> pa.RecordBatch:
        p = linear.sigmoid(margin)
        columns = [batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from linear.score_batches(shared.value, False, finish)(batches)

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels are read by the training alone."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", "predicted")

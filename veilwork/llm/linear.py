"""Hashed n-gram features in relative frequencies, and logistic regression by FTRL-proximal updates.

A document's feature value is (occurrences of the bucket) / (occurrences of its family), so documents of any length
compare and a score needs no sorting: it is the mean of the weights met, family by family.  Families:

* words: 1- and 2-grams of lower-cased words;
* shapes: 1- to 3-grams of word shapes (first and last character class, capitals, length class, "as the word before");
* chars: 3- and 5-grams of bytes, where asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import LOWER, chunks, mix, span_hashes, word_bounds

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
SCALE = 4.0

_CLASS = np.zeros(256, np.uint64)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 4
for _i, _chars in enumerate((b".,;:", b"!?", b"#$%&*|<>", b"()[]{}\"'", b"@+-_=/\\~^`"), 5):
    _CLASS[list(_chars)] = _i

Family = tuple[np.ndarray, np.ndarray]


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def features(data: np.ndarray, offsets: np.ndarray, chars: bool) -> list[Family]:
    """(bucket, row) arrays by family, rows ascending."""
    low = LOWER[data]
    starts, ends, rows = word_bounds(data, offsets)
    out: list[Family] = []
    if not len(starts):
        return out
    words = span_hashes(low, starts, ends)
    pairs = rows[1:] == rows[:-1]
    two = words[:-1] * np.uint64(3) + mix(words[1:])
    out.append(_ordered([(_bucket(words, 1), rows), (_bucket(two, 2)[pairs], rows[1:][pairs])]))
    exact = span_hashes(data, starts, ends)
    same = np.r_[False, (exact[1:] == exact[:-1]) & pairs]
    shape = _CLASS[data[starts]] * np.uint64(10) + _CLASS[data[ends - 1]]
    shape = shape * np.uint64(10) + _CLASS[data[np.maximum(ends - 2, starts)]]
    shape = (shape * np.uint64(4) + np.minimum((ends - starts) // 4, 3).astype(np.uint64)) * np.uint64(2) + same
    shaped = [(_bucket(shape, 3), rows)]
    for size in (2, 3):
        run = np.zeros(max(len(shape) - size + 1, 0), np.uint64)
        for k in range(size):
            run = run * np.uint64(1_000_003) + shape[k : k + len(run)]
        whole = rows[: len(run)] == rows[size - 1 :][: len(run)]
        shaped.append((_bucket(run, 2 + size)[whole], rows[: len(run)][whole]))
    out.append(_ordered(shaped))
    if chars:
        row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        code, grams = data.astype(np.uint64) + np.uint64(1), []
        for size in (3, 5):
            run = np.zeros(max(len(code) - size + 1, 0), np.uint64)
            for k in range(size):
                run = (run << np.uint64(9)) | code[k : k + len(run)]
            whole = row_of[: len(run)] == row_of[size - 1 :][: len(run)]
            grams.append((_bucket(run, 5 + size)[whole], row_of[: len(run)][whole]))
        out.append(_ordered(grams))
    return out


def _ordered(parts: list[Family]) -> Family:
    rows = np.concatenate([r for _, r in parts])
    order = np.argsort(rows, kind="stable")
    return np.concatenate([b for b, _ in parts])[order], rows[order]


def margins(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, chars: bool) -> np.ndarray:
    """Sparse dot product of each row with the weights; ``weights[BUCKETS]`` is the bias, all an empty text has."""
    n = len(offsets) - 1
    out = np.full(n, weights[BUCKETS], np.float64)
    for bucket, rows in features(data, offsets, chars):
        total = np.bincount(rows, weights[bucket], n)
        out += SCALE * total / np.maximum(np.bincount(rows, minlength=n), 1)
    return out


def sparse_rows(column: pa.Array, chars: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, value) of each text."""
    out = []
    for _, _, data, offsets in chunks(column):
        n = len(offsets) - 1
        parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        for bucket, rows in features(data, offsets, chars):
            cuts = np.searchsorted(rows, np.arange(n + 1))
            for r in range(n):
                if cuts[r + 1] > cuts[r]:
                    b, c = np.unique(bucket[cuts[r] : cuts[r + 1]], return_counts=True)
                    parts[r].append((b, c * (SCALE / (cuts[r + 1] - cuts[r]))))
        for p in parts:
            idx, back = np.unique(np.concatenate([b for b, _ in p] or [np.empty(0, np.int32)]), return_inverse=True)
            out.append((idx, np.bincount(back, np.concatenate([v for _, v in p] or [np.empty(0)]), len(idx))))
    return out


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, alpha: float, l1: float, l2: float) -> np.ndarray:
    """Follow-the-regularised-leader proximal updates, one example at a time in the order given."""
    beta = 1.0
    z, n, w = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for _ in range(epochs):
        for (idx, val), y in zip(rows, labels, strict=True):
            idx, val = np.r_[idx, BUCKETS], np.r_[val, 1.0]
            zi, ni = z[idx], n[idx]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(wi @ val, -30, 30))) - y) * val
            new = ni + g * g
            z[idx] = zi + g - (np.sqrt(new) - np.sqrt(ni)) / alpha * wi
            n[idx] = new
    keep = np.abs(z) > l1
    w[keep] = -(z[keep] - np.sign(z[keep]) * l1) / ((beta + np.sqrt(n[keep])) / alpha + l2)
    return w


SHARDS = 4


def train(sample: DataFrame, chars: bool, epochs: int = 4, alpha: float = 1.5, l1: float = 0.0, l2: float = 0.1) -> np.ndarray:
    """Weights from (doc_id, text, label): one learner a shard, averaged (iterative parameter mixing, one round).

    The sample is bounded by its caller.  Each shard is shuffled by a hash of the id.  A shard without rows gives no
    vote; without any labelled row all weights are 0, so every score is 1/2.  A sample of one class learns its bias only.
    """

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        keys = mix(frame["doc_id"].to_numpy(np.int64).view(np.uint64))
        frame = frame.iloc[np.argsort(keys, kind="stable")]
        rows = sparse_rows(pa.array(frame["text"], pa.string()), chars)
        w = ftrl(rows, frame["label"].to_numpy(float), epochs, alpha, l1, l2)
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": at, "w": w[at]})

    sharded = sample.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)))
    votes = sharded.groupBy("shard").applyInPandas(learn, "at int, w double")
    weights = np.zeros(BUCKETS + 1)
    # at most BUCKETS + 1 rows whatever the input
    for row in votes.groupBy("at").agg((F.sum("w") / SHARDS).alias("w")).toPandas().itertuples(index=False):
        weights[row.at] = row.w
    return weights


def score_batches(weights: np.ndarray, chars: bool, finish: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = [margins(data, offsets, weights, chars) for _, _, data, offsets in chunks(batch.column("text"))]
                yield finish(batch, np.concatenate(parts))

    return run


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

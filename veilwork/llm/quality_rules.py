"""Quality rules: counted base rules, then a calibrated logistic regression over word and character n-grams.

Training rows are split once more by a hash of the id: most fit the weights, the rest fit a Platt calibration of the
margin (a slope and an offset).  Scores are probabilities, compared with a fixed threshold in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm import linear
from veilwork.llm.common import chunks, labelled_sample, span_hashes, texts, word_bounds

MAX_TRAINING_ROWS = 5_000
CALIBRATION_SHARE = 4  # one labelled row in so many calibrates
KEEP_THRESHOLD = 0.3
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1
_LINE = ord("\n")

RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def repeated_words(words: np.ndarray, rows: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """Per row, the words covered by windows that stand twice or more in the row."""
    if len(words) < window:
        return np.zeros(n, np.int64)
    m = len(words) - window + 1
    run = np.zeros(m, np.uint64)
    for k in range(window):
        run = run * np.uint64(0x9E3779B97F4A7C15) + words[k : k + m]
    whole = np.flatnonzero(rows[:m] == rows[window - 1 :])
    key, row = run[whole], rows[:m][whole]
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    again = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(k), bool)
    twice[1:] |= again
    twice[:-1] |= again
    begins = np.zeros(len(words) + 1, np.int64)
    at = whole[order[twice]]
    begins[at] += 1
    begins[at + window] -= 1  # windows start at different words, so each entry is met once
    return np.bincount(rows, np.cumsum(begins[:-1]) > 0, n).astype(np.int64)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if text.count(b"\n") == 0:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The five counts of every text of a column."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for _, _, data, offsets in chunks(column):
        n = len(offsets) - 1
        starts, ends, rows = word_bounds(data, offsets)
        points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # code points before each byte
        symbols = np.r_[0, np.cumsum(_SYMBOLS[data])]
        raw = data.tobytes()
        out["n_words"].append(np.bincount(rows, minlength=n))
        out["word_chars"].append(np.bincount(rows, points[ends] - points[starts], n).astype(np.int64))
        out["n_symbols"].append(symbols[offsets[1:]] - symbols[offsets[:-1]])
        out["n_dup_lines"].append(np.array([duplicate_lines(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]))
        out["n_repeat_words"].append(repeated_words(span_hashes(data, starts, ends), rows, n))
    return {k: np.concatenate([*v, np.empty(0, np.int64)]).astype(np.int64) for k, v in out.items()}


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on smoothed targets; without both classes the margin stands as it is."""
    good, bad = int(y.sum()), int(len(y) - y.sum())
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = linear.sigmoid(a * margin + b)
        w, g = p * (1 - p) + 1e-9, p - target
        h = np.array([[np.sum(w * margin * margin) + 1e-3, np.sum(w * margin)], [np.sum(w * margin), np.sum(w) + 1e-3]])
        move = np.linalg.solve(h, [np.sum(g * margin) + 1e-3 * (a - 1), np.sum(g) + 1e-3 * b])
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> tuple[np.ndarray, float, float]:
    """(weights, slope, offset) from all labelled rows of the sample."""
    sample = labelled_sample(docs, labels, "quality", F.col("doc_id").isNotNull(), max_rows)
    part = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(CALIBRATION_SHARE)) == 0
    weights = linear.train(sample.where(~part), chars=True)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def finish(batch: pa.RecordBatch, margin: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("label"), pa.array(margin)], ["label", "margin"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from linear.score_batches(shared.value, True, finish)(batches)

    # two numbers for each row of a bounded sample
    held = sample.where(part).select("text", "label").mapInArrow(run, "label int, margin double").toPandas()
    return weights, *platt(held["margin"].to_numpy(float), held["label"].to_numpy(float))


def judge(docs: DataFrame, model: tuple[np.ndarray, float, float], threshold: float = KEEP_THRESHOLD) -> DataFrame:
    """The base counts, ``base_failed``, the calibrated ``probability`` of good quality, and ``kept``, per row.

    Null and empty texts have all counts 0, so they fail the base rule.  Word windows are compared by 64-bit hashes
    within one text.  Repeated rows are judged alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def finish(batch: pa.RecordBatch, margin: np.ndarray) -> pa.RecordBatch:
        _, slope, offset = shared.value
        c = base_counts(batch.column("text"))
        failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
        p = linear.sigmoid(slope * margin + offset)
        columns = [batch.column("doc_id"), *(pa.array(v) for v in c.values()), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *c, "base_failed", "probability", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from linear.score_batches(shared.value[0], True, finish)(batches)

    return texts(docs).mapInArrow(run, RESULT)

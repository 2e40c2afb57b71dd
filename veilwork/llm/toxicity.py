"""Compression-distance toxicity: windows are compressed with an ordinary and with a toxic zstandard dictionary.

Both dictionaries are trained from labelled text.  The ordinary one is trained on ordinary windows; the toxic one is
a short section of toxic passages followed by the ordinary one, so what both classes share compresses alike and only
toxic wording makes a window shorter.  Toxic passages are stretches of toxic texts made of byte k-grams that toxic documents use
significantly more, or more densely, than ordinary ones (likelihood ratio, no least or most share of documents), so wording of a
small language or source enters, and so does wording that ordinary texts hold now and then.  They are picked until all such
k-grams are covered, and grow by the bytes that most of their occurrences go on with.

Before compression every byte is followed by a hash of itself and the two bytes before it.  A match then has to agree on five
characters or more, so fragments of ordinary words cannot stand in for toxic ones, and a character costs two bytes as a literal:
windows are so short that zstandard stores literals raw (below 64 bytes).

A document's evidence is, per threshold t, how many of its windows save at least t bytes.  A calibrated logistic function of
those counts and rates and the length gives its score, which also tells stray from dense use.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import LOWER, SPACES, fold, labelled_sample, mix, ship, text_bytes, texts
from veilwork.llm.linear import sigmoid

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: About so many labelled rows, picked by a hash of the id, train dictionaries and calibration.
MAX_TRAINING_ROWS = 8_000
WINDOW_BYTES = 31
GRAM = 5
#: A k-gram is tested by how many texts of each class use it at least so often.
DENSITIES = (1, 2, 3)
CORE_SHARE = 0.6
#: A passage grows while this share of its occurrences goes on with the same byte, up to so many bytes.
AGREEMENT, LONGEST = 0.6, 16
ORDINARY_BYTES = 16_384
SAVINGS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12)


@dataclasses.dataclass(frozen=True)
class Model:
    """Two dictionaries, feature means and scales, and the calibrated weights."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        made, log = [], max(16, (2 * max(len(self.ordinary), len(self.toxic))).bit_length())  # all of a dictionary is in reach
        for content in (self.ordinary, self.toxic):
            dictionary = zstandard.ZstdCompressionDict(doubled(np.frombuffer(content, np.uint8), np.zeros(0, np.int64)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters(
                format=zstandard.FORMAT_ZSTD1_MAGICLESS, compression_level=1, strategy=zstandard.STRATEGY_LAZY2, min_match=6, target_length=62,
                window_log=log, chain_log=log, hash_log=log, search_log=5, write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            dictionary.precompute_compress(compression_params=params)
            made.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params))
        return made[0], made[1]


_CODES = np.random.default_rng(11).integers(0, 1 << 16, (3, 256), dtype=np.uint16)


def doubled(low: np.ndarray, begins: np.ndarray) -> bytes:
    """Every byte and a hash of it and the two before; blanks stand before each text."""
    first = np.full(len(low), 32, np.uint8)
    first[1:] = low[:-1]
    first[begins] = 32
    second = np.full(len(low), 32, np.uint8)
    second[1:] = first[:-1]
    second[begins] = 32
    code = (_CODES[0][low] * np.uint16(40503)) ^ (_CODES[1][first] * np.uint16(30011)) ^ _CODES[2][second]
    out = np.empty(2 * len(low), np.uint8)
    out[0::2], out[1::2] = low, ((code * np.uint16(48271)) >> np.uint16(8)).astype(np.uint8)
    return out.tobytes()


def window_cuts(data: np.ndarray, begin: int, end: int, space: np.ndarray) -> list[int]:
    """Bounds of windows of about ``WINDOW_BYTES`` bytes, cut at white space; a longer word is cut inside.

    ``space`` holds the ascending positions of white space of the whole buffer.
    """
    cuts, at = [begin], begin
    low = int(np.searchsorted(space, begin))
    while end - at > WINDOW_BYTES:
        k = int(np.searchsorted(space, at + WINDOW_BYTES, "right")) - 1
        at = int(space[k]) if k >= low and space[k] > at + WINDOW_BYTES // 2 else at + WINDOW_BYTES
        cuts.append(at)
    if at < end:
        cuts.append(end)
    return cuts


def savings(model: Model) -> object:
    """A function from a string column to (rows x len(SAVINGS) counts, windows per row)."""
    plain, toxic = (c.compress for c in model.compressors())

    def of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(column)
        low = LOWER[data[offsets[0] : offsets[-1]]] if len(data) else data
        offsets = offsets - offsets[0]
        space, raw = np.flatnonzero(SPACES[low]), doubled(low, offsets[:-1][np.diff(offsets) > 0])
        counts, windows = np.zeros((len(column), len(SAVINGS))), np.zeros(len(column))
        for r in range(len(column)):
            cuts = window_cuts(low, int(offsets[r]), int(offsets[r + 1]), space)
            windows[r] = len(cuts) - 1
            saved = [0] * (SAVINGS[-1] + 1)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = raw[2 * a : 2 * b]
                gain = len(plain(part)) - len(toxic(part))
                if gain > 0:
                    saved[min(gain, SAVINGS[-1])] += 1
            total = np.cumsum(saved[::-1])[::-1]
            counts[r] = [total[t] for t in SAVINGS]
        return counts, windows

    return of


def evidence(counts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Feature rows: logs of counts and of counts per 100 windows by saving, and of the number of windows."""
    n = np.maximum(windows, 1)[:, None]
    return np.hstack([np.log1p(counts), np.log1p(100 * counts / n), np.log(n)])


def calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps, last weight the bias; smoothed rate for one class only."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return w
    ridge = np.r_[np.full(x.shape[1] - 1, 0.05), 1e-6]
    for _ in range(60):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _grams(low: np.ndarray) -> np.ndarray:
    """Byte k-grams of a lower-cased text, packed."""
    n = len(low) - GRAM + 1
    run = np.zeros(max(n, 0), np.uint64)
    for k in range(GRAM):
        run = (run << np.uint64(8)) | low[k : k + len(run)]
    return run


def document_counts(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending k-grams and, by density, how many of the texts hold each that often."""
    seen, counts = np.empty(0, np.uint64), np.zeros((0, len(DENSITIES)))
    for k in range(0, len(rows), 500):
        own = [np.unique(_grams(np.frombuffer(t, np.uint8)), return_counts=True) for t in rows[k : k + 500]]
        part, times = np.concatenate([g for g, _ in own]), np.concatenate([n for _, n in own])
        seen, back = np.unique(np.r_[seen, part], return_inverse=True)
        dense = np.vstack([counts, times[:, None] >= np.array(DENSITIES)])
        counts = np.stack([np.bincount(back, column, len(seen)) for column in dense.T], axis=1)
    return seen, counts


def counts_of(grams: np.ndarray, rows: list[bytes]) -> np.ndarray:
    """By density, how many of the texts hold each of the ascending k-grams that often; other k-grams take no memory."""
    counts = np.zeros((len(grams), len(DENSITIES)))
    for t in rows if len(grams) else []:
        own, times = np.unique(_grams(np.frombuffer(t, np.uint8)), return_counts=True)
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        met = grams[at] == own
        counts[at[met]] += times[met, None] >= np.array(DENSITIES)
    return counts


def association(often: np.ndarray, stray: np.ndarray, toxic: int, ordinary: int) -> np.ndarray:
    """Likelihood ratio of texts of both classes that hold something; 0 where its share of toxic texts is not the larger one."""

    def part(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-12))

    n = np.array([toxic, ordinary, toxic + ordinary], float)
    both = often + stray
    ratio = part(often) + part(stray) + part(n[0] - often) + part(n[1] - stray) - part(both) - part(n[2] - both) - part(n[:2]).sum() + part(n[2])
    return np.where(often * ordinary > stray * toxic, 2 * ratio, 0.0)


def _grown(passage: bytes, joined: bytes) -> bytes:
    """A passage with the bytes that most of its occurrences in the joined texts go on with."""
    at, where = joined.find(passage), []
    while at >= 0:
        where.append(at)
        at = joined.find(passage, at + 1)
    while len(passage) < LONGEST and where:
        after, n = Counter(joined[p + len(passage)] for p in where).most_common(1)[0]
        if n < AGREEMENT * len(where) or after == 0:  # a NUL stands between texts
            break
        passage += bytes([after])
    return passage


def _section(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary of about ``size`` bytes, or the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=40, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[:size]


def train_dictionaries(rows: list[bytes], toxic: np.ndarray) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary contents from lower-cased training texts."""
    bad = [b" " + t for t, mark in zip(rows, toxic, strict=True) if mark]  # so that a first word looks like any other
    good = [t for t, mark in zip(rows, toxic, strict=True) if not mark]
    grams, often = document_counts(bad)
    stray = counts_of(grams, [b" " + t for t in good])
    strength = association(often, stray, len(bad), len(good)).max(axis=1)
    keep = strength >= 2 * np.log(max(len(grams), 2))  # by chance hardly one of all grams gets there
    keys, lead = grams[keep], dict(zip(grams[keep].tolist(), strength[keep].tolist(), strict=True))
    words: Counter[bytes] = Counter()
    for text in bad if len(keys) else []:
        own = _grams(np.frombuffer(text, np.uint8))
        at = np.flatnonzero(np.isin(own, keys))
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
            seen = np.array([lead[g] for g in own[run].tolist()])
            core = run[np.flatnonzero(seen >= CORE_SHARE * seen.max())]  # without what happens to stand beside it
            words[text[core[0] : core[-1] + GRAM]] += 1
    ordinary = _section([t[a : a + WINDOW_BYTES] for t in good for a in range(0, len(t), WINDOW_BYTES * 3)], ORDINARY_BYTES)
    passages, covered, joined = [], set(), b"\0" + b"\0".join(bad) + b"\0"
    for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0])):
        grams = set(_grams(np.frombuffer(w, np.uint8)).tolist())
        if not grams <= covered:
            passages.append(_grown(w, joined))
            covered |= grams
    return ordinary, b"".join(reversed(passages)) + ordinary


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Dictionaries and calibration from a bounded sample of labelled rows outside the held-out fold.

    All of the sample trains the dictionaries.  The calibration sees each half of it (by a hash of the id) through dictionaries
    trained on the other half.  Without labelled rows every score is 1/2.
    """
    trained = ~fold(F.col("doc_id"), FOLDS, HELD_OUT) & F.col("doc_id").isNotNull()
    sample = labelled_sample(docs, labels, label, trained, max_rows)

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        key = mix(frame["doc_id"].to_numpy(np.int64).view(np.uint64))
        order = np.argsort(key, kind="stable")
        frame, key = frame.iloc[order], key[order]
        rows, y = [LOWER[np.frombuffer(t.encode(), np.uint8)].tobytes() for t in frame["text"]], frame["label"].to_numpy() > 0
        half = (key & np.uint64(1)) == 0
        x = np.zeros((len(rows), 2 * len(SAVINGS) + 1))
        for part in (half, ~half):  # evidence of each half with the dictionaries of the other
            if part.any():
                other = Model(*train_dictionaries([r for r, p in zip(rows, part, strict=True) if not p], y[~part]), ())
                x[part] = evidence(*savings(other)(pa.array(frame["text"][part], pa.string())))
        ordinary, toxic = train_dictionaries(rows, y)
        return pd.DataFrame({"ordinary": [ordinary], "toxic": [toxic], "weights": [calibrated(x, y.astype(float)).tolist()]})

    # the sample is bounded, so one task may hold it
    made = sample.withColumn("part", F.lit(1)).groupBy("part").applyInPandas(learn, "ordinary binary, toxic binary, weights array<double>").collect()
    if not made:
        return Model(b"", b"", (0.0,) * (2 * len(SAVINGS) + 2))
    return Model(bytes(made[0]["ordinary"]), bytes(made[0]["toxic"]), tuple(made[0]["weights"]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row over all windows of its whole text.

    Null and empty texts have no window: they score the calibrated bias.  Repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = savings(shared.value)
        weights = np.array(shared.value.weights)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                p = sigmoid(evidence(*of(part.column("text"))) @ weights[:-1] + weights[-1])
                columns = [part.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, with all their columns and without a shuffle."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = savings(shared.value)
        weights = np.array(shared.value.weights)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                p = sigmoid(evidence(*of(part.column("text"))) @ weights[:-1] + weights[-1])
                yield part.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels are read by the training alone."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", "predicted")

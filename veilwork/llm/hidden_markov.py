"""Language-model scoring with a hidden Markov model over an open vocabulary.

Tokens are lower-cased words and one end per text.  All words are counted over the whole training part.  Words above a
count threshold (chosen so that at most ``MAX_FREQUENT`` pass) are emission symbols of their own; every other word
belongs to one of ``RARE_CLASSES`` classes by its last bytes and length, and its probability is

    P(class | state) * (c + 1/2) / (C + (D + 1) / 2)

with its own count c, the class's tokens C and distinct words D; one slot of each class is left for words never
seen.  The second factor does not depend on the state, so the likelihood splits into a forward recursion over a
bounded symbol set and a sum of rare-word logarithms, which is joined on the words themselves: the broadcast model has
a fixed size while the counts grow with the corpus.

Training: Baum-Welch from a seeded random start.  Every iteration sums expected counts over all training texts, task by
task, and adds them up by symbol.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import LOWER, chunks, fold, mix, saved, span_hashes, texts, word_bounds

FOLDS, HELD_OUT = 5, 1
STATES = 8
MAX_FREQUENT = 65_536
RARE_CLASSES = 512
#: Each sees all training texts.
ITERATIONS = 5
#: A vectorised recursion holds about so many tokens.
SWEEP_TOKENS = 400_000
HALF = 0.5


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, rare class, row) of every word of a chunk."""
    low = LOWER[data]
    starts, ends, rows = word_bounds(low, offsets)
    last, before = low[ends - 1].astype(np.uint64), low[np.maximum(ends - 2, starts)].astype(np.uint64)
    size = np.minimum((ends - starts) // 3, 5).astype(np.uint64)
    kind = mix((last << np.uint64(8) | before) * np.uint64(6) + size) % np.uint64(RARE_CLASSES)
    return span_hashes(low, starts, ends).view(np.int64), kind.astype(np.int32), rows


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, kind, c): occurrences of each word over all texts, summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, kind, n = (np.concatenate(x) for x in zip(*held, strict=True))
            words, first, back = np.unique(h, return_index=True, return_inverse=True)
            return words, kind[first], np.bincount(back, n).astype(np.int64)

        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                h, kind, _ = hashed_words(data, offsets)
                held.append((h, kind, np.ones(len(h))))
                size += len(h)
                if size > 1_500_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_000_000:  # bounds a task's memory; the shuffle adds up the parts
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["h", "kind", "c"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["h", "kind", "c"])

    return docs.select("text").mapInArrow(run, "h long, kind int, c long").groupBy("h").agg(F.min("kind").alias("kind"), F.sum("c").alias("c"))


@dataclasses.dataclass(frozen=True)
class Vocabulary:
    """Frequent words by ascending hash with their counts, and the sums of the rest.  Symbols: frequent words, then rare
    classes, then the end."""

    words: np.ndarray
    counts: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    texts: int
    threshold: int

    @property
    def end(self) -> int:
        return len(self.words) + RARE_CLASSES

    @property
    def tokens(self) -> int:
        return int(self.counts.sum() + self.class_tokens.sum() + self.texts)

    @property
    def distinct(self) -> int:
        return len(self.words) + int(self.class_words.sum()) + (self.texts > 0)

    def symbols(self, h: np.ndarray, kind: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return kind.astype(np.int32)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, len(self.words) + kind).astype(np.int32)

    def share(self) -> np.ndarray:
        """Smoothed probability of each symbol."""
        x = np.r_[self.counts, self.class_tokens, self.texts] + HALF
        return x / x.sum()

    def class_logs(self) -> np.ndarray:
        """log10 of each class's denominator, by symbol (0 elsewhere)."""
        out = np.zeros(self.end + 1)
        out[len(self.words) : self.end] = np.log10(self.class_tokens + HALF * (self.class_words + 1))
        return out


def vocabulary(counts: DataFrame, n_texts: int, max_frequent: int = MAX_FREQUENT) -> Vocabulary:
    """Reads back at most ``max_frequent`` words, a bounded histogram and one row per class."""
    level = F.when(F.col("c") < 4096, F.col("c").cast("double")).otherwise(4096 + F.floor(F.log2(F.col("c") / 4096) * 64))
    steps = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.desc("c")).collect()
    threshold, held = 1 << 62, 0
    for step in steps:
        held += step["n"]
        if held > max_frequent:
            break
        threshold = step["c"]
    often = counts.where(F.col("c") >= F.lit(threshold)).select("h", "c").toPandas().sort_values("h")
    tokens, words = np.zeros(RARE_CLASSES), np.zeros(RARE_CLASSES)
    for r in counts.where(F.col("c") < F.lit(threshold)).groupBy("kind").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        tokens[r["kind"]], words[r["kind"]] = r["c"], r["n"]
    return Vocabulary(often["h"].to_numpy(np.int64), often["c"].to_numpy(np.int64), tokens, words, n_texts, threshold)


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(row, doc_id, held_out, symbols, rare): int32 symbols with the end, and int64 hashes of the rare words, as bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # bounded by ``max_frequent``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column("text")):
                h, kind, rows = hashed_words(data, offsets)
                sym = own.symbols(h, kind)
                cuts = np.searchsorted(rows, np.arange(end - first + 1))
                symbols, rare = [], []
                last = np.array([own.end], np.int32).tobytes()
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    symbols.append(sym[a:b].tobytes() + last)
                    rare.append(h[a:b][sym[a:b] >= len(own.words)].tobytes())
                part = batch.slice(first, end - first)
                columns = [part.column(c) for c in ("row", "doc_id", "held_out")]
                columns += [pa.array(symbols, pa.binary()), pa.array(rare, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "symbols", "rare"])

    return docs.mapInArrow(run, "row long, doc_id long, held_out boolean, symbols binary, rare binary")


@dataclasses.dataclass(frozen=True)
class Parameters:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol x state


def sequences(column: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Runs of (places, symbol arrays), longest texts first, of about ``SWEEP_TOKENS`` tokens."""
    rows = [np.frombuffer(x.as_buffer(), np.int32) for x in column]
    order = np.argsort([-len(r) for r in rows], kind="stable")
    first = size = 0
    for k, i in enumerate(order):
        size += len(rows[i])
        if size >= SWEEP_TOKENS or k + 1 == len(order):
            yield order[first : k + 1], [rows[j] for j in order[first : k + 1]]
            first, size = k + 1, 0


def sweep(rows: list[np.ndarray], p: Parameters, counts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, dtype: type = np.float64) -> np.ndarray:
    """log10 likelihood of each sequence (longest first) by the scaled forward recursion; with ``counts``, the scaled backward
    recursion adds the expected starts, moves and emissions to them."""
    length = np.array([len(r) for r in rows])
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(steps), "left")  # sequences longer than each time
    first = np.r_[0, np.cumsum(active)]
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    rank = np.repeat(np.arange(len(rows)), length)
    place = first[at] + rank
    symbol, owner = np.empty(len(place), np.int32), np.empty(len(place), np.int32)
    symbol[place], owner[place] = np.concatenate(rows), rank
    emit, move, start = p.emit.astype(dtype)[symbol], p.move.astype(dtype), p.start.astype(dtype)
    scale = np.empty(len(place), dtype)
    keep = np.empty_like(emit) if counts is not None else None
    a = None
    for t in range(steps):
        lo, hi = first[t], first[t + 1]
        a = start * emit[lo:hi] if a is None else (a[: hi - lo] @ move) * emit[lo:hi]
        c = a.sum(axis=1)
        a /= c[:, None]
        scale[lo:hi] = c
        if keep is not None:
            keep[lo:hi] = a
    if counts is not None:
        starts, moves, emits = counts
        turned = move.T.copy()
        b = np.ones((active[-1], len(start)), dtype)
        for t in range(steps - 1, -1, -1):
            lo, hi = first[t], first[t + 1]
            if t < steps - 1:
                lo2, hi2 = first[t + 1], first[t + 2]
                ahead = emit[lo2:hi2] * b / scale[lo2:hi2, None]
                moves += move * (keep[lo : lo + hi2 - lo2].T @ ahead)
                b = np.ones((hi - lo, len(start)), dtype)
                b[: hi2 - lo2] = ahead @ turned
            if t + 1 < steps:
                keep[lo2:hi2] *= later
            later = b
        keep[first[0] : first[1]] *= later
        starts += keep[first[0] : first[1]].sum(axis=0)
        for s in range(len(start)):
            emits[:, s] += np.bincount(symbol, keep[:, s], len(emits))
    return np.bincount(owner, np.log10(scale.astype(np.float64)), len(rows))


def reestimated(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, share: np.ndarray) -> Parameters:
    """The next parameters from expected counts, smoothed towards the symbols' overall shares."""
    start, move = starts + HALF, moves + HALF
    emit = emits + 20.0 * share[:, None]
    return Parameters(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def initial(share: np.ndarray, states: int) -> Parameters:
    rng = np.random.default_rng(5)
    emit = share[:, None] * rng.gamma(2.0, 1.0, (len(share), states))
    move = np.full((states, states), 0.2 / states) + np.eye(states) * 0.8
    return Parameters(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def zeros(p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros_like(p.start), np.zeros_like(p.move), np.zeros_like(p.emit)


def baum_welch(train: DataFrame, p: Parameters, share: np.ndarray) -> Parameters:
    """One iteration over all training texts: expected counts by task, added up by symbol."""
    shared = train.sparkSession.sparkContext.broadcast(p)
    states, symbols = len(p.start), len(p.emit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        counts = zeros(own)
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                for _, rows in sequences(batch.column("symbols").slice(first, 4096)):
                    sweep(rows, own, counts, np.float32)
        stacked = np.vstack([counts[2], counts[0][None], counts[1]])  # emissions, starts, moves
        at = np.flatnonzero(stacked.sum(axis=1))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(stacked[at, s]) for s in range(states))], ["at", *(f"s{s}" for s in range(states))])

    schema = "at int, " + ", ".join(f"s{s} double" for s in range(states))
    # as many rows as symbols, whatever the input
    total = train.select("symbols").mapInArrow(run, schema).groupBy("at").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(states))).toPandas()
    stacked = np.zeros((symbols + 1 + states, states))
    stacked[total["at"].to_numpy(int)] = total[[f"s{s}" for s in range(states)]].to_numpy(float)
    return reestimated(stacked[symbols], stacked[symbols + 1 :], stacked[:symbols], share)


def rare_sums(rows: DataFrame, counts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(row, rare_known, rare_log): of each row's rare words, those with a count, and the sum of log10(c + 1/2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                h = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("rare")]
                row = np.repeat(part.column("row").to_numpy(), [len(x) for x in h])
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.concatenate(h))], ["row", "h"])

    met = rows.where(F.length("rare") > 0).select("row", "rare").mapInArrow(run, "row long, h long")
    seldom = counts.where(F.col("c") < F.lit(vocab.threshold)).select("h", "c").hint("shuffle_hash")
    joined = met.join(seldom, "h", "left")
    return joined.groupBy("row").agg(
        F.count("c").alias("rare_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(HALF))).alias("rare_log")
    )


def forward_scores(rows: DataFrame, vocab: Vocabulary, p: Parameters) -> DataFrame:
    """(row, doc_id, held_out, n_tokens, known, base_log, path): sums over frequent words, and the forward likelihood of the
    symbols less the class denominators."""
    shared = rows.sparkSession.sparkContext.broadcast((vocab, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, params = shared.value
        counted = np.r_[own.counts, np.zeros(RARE_CLASSES), own.texts]
        logs, known = np.log10(counted + HALF), counted > 0
        logs[len(own.words) : own.end] = 0  # rare words come from the join
        denominators = own.class_logs()
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                n, hit, base, path = (np.zeros(part.num_rows) for _ in range(4))
                for places, seqs in sequences(part.column("symbols")):
                    flat = np.concatenate(seqs)
                    owner = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
                    n[places] = [len(s) for s in seqs]
                    hit[places] = np.bincount(owner, known[flat], len(seqs))
                    base[places] = np.bincount(owner, logs[flat], len(seqs))
                    path[places] = sweep(seqs, params) - np.bincount(owner, denominators[flat], len(seqs))
                columns = [part.column(c) for c in ("row", "doc_id", "held_out")]
                columns += [pa.array(n.astype(np.int64)), pa.array(hit.astype(np.int64)), pa.array(base), pa.array(path)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "known", "base_log", "path"])

    return rows.select("row", "doc_id", "held_out", "symbols").mapInArrow(
        run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base_log double, path double"
    )


def score(docs: DataFrame, states: int = STATES, max_frequent: int = MAX_FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, over its whole text.

    ``score`` is the model's log10 probability of the text, ``base_score`` that of smoothed single-word counts.  Null and empty texts
    are one end.  Repeated rows count and score as often as they stand.  Without training texts both scores rest on
    uniform symbols.
    """
    base = texts(docs).withColumn("held_out", fold(F.col("doc_id"), FOLDS, HELD_OUT))
    train = base.where(~F.col("held_out"))
    counts = saved(word_counts(train))
    vocab = vocabulary(counts, train.count(), max_frequent)
    rows = saved(encoded(base.withColumn("row", F.monotonically_increasing_id()), vocab))
    share = vocab.share()
    learning = rows.where(~F.col("held_out"))
    p = initial(share, states)
    for _ in range(ITERATIONS):
        p = baum_welch(learning, p, share)
    scored = forward_scores(rows, vocab, p).join(rare_sums(rows, counts, vocab), "row", "left")
    extra = F.coalesce("rare_log", F.lit(0.0))
    floor = float(np.log10(vocab.tokens + HALF * (vocab.distinct + 1)))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base_log") + extra - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("path") + extra).alias("score"),
    )

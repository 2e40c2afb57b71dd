"""Best-fit packing into sequences of fixed capacity, by exact complements.

Texts become token ids; only texts above the capacity are cut.  What the packing has to know is how many pieces there are
of each length: at most ``capacity`` numbers, whatever the size of the corpus.  From them the driver makes patterns: the
longest length left opens a sequence, and its gap is looked up among single lengths, sums of two and sums of three that
are still available; a hit fills the sequence to the last token.  Without a hit the longest length that fits goes in (best
fit) and the rest of the gap is looked up again.  A pattern is used as often as its lengths last, so it uses one up.

Pieces take the places of their length in turn: the n-th piece of a length is found by a search in the sorted places,
where n is its number within its task plus the pieces of that length in earlier tasks.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilwork.llm.common import LOWER, SPACES, chunks, ragged, saved, texts, word_bounds

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END = 0
TOKENIZE_BYTES = 2 << 20
JOINED, ENCODED_AT_ONCE = 256, 1 << 13  # units in one string, and in one call
MAX_UNITS = 3 << 18

_LETTER, _DIGIT, _OTHER = 1, 2, 3  # 0: white space and what is not ASCII
_KINDS = np.zeros(256, np.uint8)
_KINDS[0x21:0x7F] = _OTHER
_KINDS[0x30:0x3A] = _DIGIT
_KINDS[0x41:0x5B] = _KINDS[0x61:0x7B] = _LETTER

PIECES = "doc_id long, piece int, start long, length int, ids array<int>, ids_crc32 long, part int, nth long"


class _Lengths:
    """Available lengths, and how many pairs of available lengths have each sum."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left, self.capacity = counts.astype(np.int64).copy(), len(counts) - 1
        self.pairs = np.zeros(self.capacity + 1, np.int64)
        for length in np.flatnonzero(self.left):
            self._index(int(length), np.flatnonzero(self.left[: length + 1]), 1)
            if self.left[length] < 2 and 2 * length <= self.capacity:
                self.pairs[2 * length] -= 1

    def _index(self, length: int, others: np.ndarray, sign: int) -> None:
        sums = others[others <= self.capacity - length] + length
        self.pairs[sums] += sign  # the others differ, so each sum occurs once

    def take(self, length: int, n: int) -> None:
        before = self.left[length]
        self.left[length] = now = before - n
        if before >= 2 and now < 2 and 2 * length <= self.capacity:
            self.pairs[2 * length] -= 1
        if now == 0:
            others = np.flatnonzero(self.left)
            self._index(length, others[others != length], -1)

    def give(self, length: int) -> None:
        before = self.left[length]
        if before == 0:
            others = np.flatnonzero(self.left)
            self._index(length, others[others != length], 1)
        self.left[length] = before + 1
        if before == 1 and 2 * length <= self.capacity:
            self.pairs[2 * length] += 1

    def longest(self, limit: int) -> int:
        """The longest available length up to ``limit``; 0 where there is none."""
        found = np.flatnonzero(self.left[: limit + 1])
        return int(found[-1]) if len(found) else 0

    def pair(self, total: int) -> list[int]:
        """Two available lengths of the given sum, one as long as possible."""
        if total < 2 or self.pairs[total] == 0:
            return []
        short = np.arange(1, total // 2 + 1)
        ok = (self.left[short] > 0) & (self.left[total - short] > 0)
        if total % 2 == 0 and self.left[total // 2] < 2:
            ok[-1] = False
        at = int(short[np.argmax(ok)])
        return [total - at, at]

    def exact(self, gap: int) -> list[int]:
        """One, two or three available lengths that fill the gap."""
        if self.left[gap] > 0:
            return [gap]
        if found := self.pair(gap):
            return found
        third = np.arange(gap - 2, 0, -1)
        for length in third[(self.left[third] > 0) & (self.pairs[gap - third] > 0)]:
            self.take(int(length), 1)  # the pair has to do without it
            found = self.pair(gap - int(length))
            self.give(int(length))
            if found:
                return [int(length), *found]
        return []


def patterns(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, how often in it)]) for ``counts[length]`` pieces, lengths 1 to ``len(counts) - 1``, none left over."""
    lengths, out = _Lengths(counts), []
    while opening := lengths.longest(lengths.capacity):
        chosen = Counter()
        add = [opening]
        gap = lengths.capacity
        while add:
            for x in add:
                lengths.take(x, 1)
                chosen[x] += 1
                gap -= x
            if not gap:
                break
            add = lengths.exact(gap) or ([fit] if (fit := lengths.longest(gap)) else [])
        more = min(int(lengths.left[x]) // k for x, k in chosen.items())
        for x, k in chosen.items():
            if more:
                lengths.take(x, more * k)
        out.append((1 + more, sorted(chosen.items(), reverse=True)))
    return out


@dataclass(frozen=True)
class Places:
    """All places of all patterns, by length: a stretch of ``times * each`` places begins at number ``low`` of its length."""

    key: np.ndarray  # length << 40 | low
    low: np.ndarray
    each: np.ndarray  # how often the length stands in one sequence
    length: np.ndarray
    offset: np.ndarray  # of the first
    sequence: np.ndarray  # of the first copy

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the ``number``-th piece (from 0) of a length."""
        at = np.searchsorted(self.key, (length.astype(np.int64) << 40) | number, "right") - 1
        copy, nth = np.divmod(number - self.low[at], self.each[at])
        return self.sequence[at] + copy, self.offset[at] + nth * length


def places(found: list[tuple[int, list[tuple[int, int]]]]) -> Places:
    rows, used, sequence = [], Counter(), 0
    for times, lengths in found:
        offset = 0
        for x, k in lengths:
            rows.append(((x << 40) | used[x], used[x], k, x, offset, sequence))
            used[x] += times * k
            offset += x * k
        sequence += times
    return Places(*np.array(sorted(rows), np.int64).reshape(-1, 6).T.copy())


class _Vocabulary:
    """Token ids of units, each encoded once: a worker keeps up to ``MAX_UNITS`` of them, then starts anew."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        # an added token is cut out before anything else, so it can part units that are encoded together
        self.divider, self.mark = next((i, t.content) for i, t in added.items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized))
        self.marks = [t.content for t in added.values()]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.count, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _encoded(self, units: list[str]) -> tuple[list[np.ndarray], list[int]]:
        plain = [u for u in units if not any(m in u for m in self.marks)]
        joined = [self.mark.join([*plain[i : i + JOINED], ""]) for i in range(0, len(plain), JOINED)]
        encoded = [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate([*encoded, np.empty(0, np.int32)])
        cuts = np.flatnonzero(ids == self.divider)
        lengths = iter(np.diff(np.r_[-1, cuts]) - 1)
        parts = iter(np.split(np.delete(ids, cuts), np.cumsum(np.diff(np.r_[-1, cuts]) - 1)))
        if len(plain) == len(units):
            return [np.delete(ids, cuts)], list(lengths)
        out = [np.array(self.tokenizer.encode(u, add_special_tokens=False).ids, np.int32) if any(m in u for m in self.marks) else next(parts) for u in units]
        return out, [len(x) for x in out]

    def find(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each unit begin in ``ids``, and how many they are."""
        if len(self.known) > MAX_UNITS:
            self._clear()
        new = [u for u in units if u not in self.known]
        for at in range(0, len(new), ENCODED_AT_ONCE):
            some = new[at : at + ENCODED_AT_ONCE]
            parts, lengths = self._encoded(some)
            self.known.update(zip(some, range(len(self.known), len(self.known) + len(some)), strict=True))
            self.first = np.r_[self.first, len(self.ids) + np.cumsum(lengths) - lengths]
            self.count = np.r_[self.count, lengths]
            self.ids = np.concatenate([self.ids, *parts])
        at = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        return self.first[at], self.count[at]


@functools.lru_cache(maxsize=1)
def _vocabulary(path: str) -> _Vocabulary:
    return _Vocabulary(path)


def unit_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the units of a chunk: words, cut where the tokenizer always cuts.

    It parts letters, single digits and runs of other characters.  Two neighbouring ASCII characters of different kinds, or
    two digits, are therefore always parted, but for an apostrophe and what follows, which may be a contraction.  Words
    that may hold an added token, and cuts next to other than ASCII characters, are left to the tokenizer.
    """
    starts, ends, rows = word_bounds(data, offsets)
    if not len(starts):
        return starts, ends, rows
    kind = _KINDS[data]
    left, right = kind[:-1], kind[1:]
    cut = (left > 0) & (right > 0) & ((left != right) | (left == _DIGIT)) & (data[:-1] != ord("'"))
    at = np.flatnonzero(cut) + 1
    word = np.searchsorted(starts, at, "right") - 1
    inside = (word >= 0) & (at > starts[word]) & (at < ends[word])
    marked = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    inside &= ~np.isin(word, np.searchsorted(starts, marked, "right") - 1)
    at, word = at[inside], word[inside]
    every = np.sort(np.r_[starts, at])
    closes = np.sort(np.r_[ends, at])
    return every, closes, rows[np.searchsorted(starts, every, "right") - 1]


def _token_ids(vocabulary: _Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows of a chunk, each row closed by ``END``, and the number of ids of each row."""
    n = len(offsets) - 1
    starts, ends, rows = unit_bounds(data, offsets)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    packed = pa.py_buffer(np.ascontiguousarray(LOWER[data[~SPACES[data]]]))
    named = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), packed).dictionary_encode()
    first, count = vocabulary.find(named.dictionary.to_pylist())
    of = named.indices.to_numpy()
    lengths = count[of]
    totals = np.bincount(rows, lengths, n).astype(np.int64) + 1
    out = np.full(totals.sum(), END, np.int32)
    filled = np.ones(len(out), bool)
    filled[np.cumsum(totals) - 1] = False  # the closing id
    out[filled] = vocabulary.ids[ragged(first[of], lengths)]
    return out, totals


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    vocabulary, seen, part = _vocabulary(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
    for batch in batches:
        doc_ids, column = batch.column("doc_id"), batch.column("text")
        for first, _, data, offsets in chunks(column, TOKENIZE_BYTES):
            ids, totals = _token_ids(vocabulary, data, offsets)
            pieces = -(-totals // capacity)
            row = np.repeat(np.arange(len(totals)), pieces)
            piece = ragged(np.zeros(len(totals), np.int64), pieces)
            start = piece * capacity
            length = np.minimum(totals[row] - start, capacity)
            # the number of each piece among those of its length, on from the rows before
            order = np.argsort(length, kind="stable")
            counts = np.bincount(length, minlength=capacity + 1)
            nth = np.empty(len(length), np.int64)
            nth[order] = ragged(seen, counts)
            seen += counts
            ends = np.cumsum(length)
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids))
            columns = [doc_ids.take(pa.array(first + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), lists, pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "part", "nth"])


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Token ids of every text (null: empty) and a closing 0, cut where they exceed ``capacity``; ``nth`` numbers a task's pieces of one length."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cut(batches, path, capacity)

    return texts(docs).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Each piece with its ``ids``, ``sequence_id`` (from 0, without gaps) and ``offset`` in the sequence.

    A row for each piece of each row of ``docs``; every row gives at least one piece, since the closing id is always
    there; repeated rows and null ids are packed like others; no rows, no pieces.  Pieces are written once, so their numbers
    stand for good; only their numbers are shuffled, ids only where the caller reads them.
    """
    cut = saved(pieces(docs, tokenizer, capacity))
    counted = saved(cut.groupBy("part", "length").agg(F.count("*").alias("n")))
    # at most ``capacity`` rows reach the driver
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counted.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    where = docs.sparkSession.sparkContext.broadcast(places(patterns(histogram)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = where.value.find(length.to_numpy(), number.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    # the bases grow with the tasks, so they are never broadcast, however small their file looks
    placed = cut.join(bases.hint("merge"), ["part", "length"]).withColumn("place", place("length", F.col("base") + F.col("nth")))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids", "ids_crc32", "place.sequence_id", "place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences themselves."""
    entries = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    packed = packed.groupBy("sequence_id").agg(entries.alias("e"))
    return packed.select("sequence_id", F.flatten("e.ids").alias("ids"), F.col("e.doc_id").alias("doc_ids"))

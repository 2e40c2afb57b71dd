"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping segments of ``SEGMENT`` characters.  A stretch of a document within ``EDITS`` edits of
a segment shares at least ``SEGMENT - Q + 1 - EDITS * Q`` q-grams with it, all on diagonals (text position minus item position)
that lie at most ``EDITS`` apart.  Hits are counted per segment in diagonal bands twice that wide which overlap by half, so
any such stretch lies whole in one band; bands that reach the bound are verified by banded alignment.

Letters are compared without case (A-Z and the accented Latin-1 capitals) and any white space as a blank; offsets stay those of
the text.  Everything works on UTF-8 bytes, whose offsets are turned into code points at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilwork.llm.common import LOWER, SPACES, chunks, ship, texts

SEGMENT, STEP, Q, EDITS = 80, 20, 13, 4
#: Benchmark rows are matched in blocks of about so many bytes, so what is broadcast has a bound at any size.
BLOCK_BYTES = 4 << 20
RESULT = "doc_id long, item_id long, begin int, end int, item_begin int, item_end int, n_shared int, edits int"

_FOLDED = LOWER.copy()
_FOLDED[SPACES] = 32
_FILTER_BITS = 21


def folded(data: np.ndarray) -> np.ndarray:
    out = _FOLDED[data]
    lead = data[:-1] == 0xC3
    tail = data[1:]
    out[1:][lead & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 0x20
    return out


def gram_hashes(low: np.ndarray) -> np.ndarray:
    """A 64-bit code of the ``Q`` (13) bytes from every position, built by doubling."""
    n = len(low) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    b, b2, b4 = (np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2, 4))
    one = low.astype(np.uint64) + np.uint64(1)
    two = one[:-1] * b + one[1:]
    four = two[:-2] * b2 + two[2:] if len(two) > 2 else two
    eight = four[:-4] * b4 + four[4:]
    return (eight[:n] * b4 + four[8 : 8 + n]) * b + one[12 : 12 + n]


class Items:
    """The q-grams of a block of benchmark rows, sorted, with their places."""

    def __init__(self, ids: list[int], rows: list[bytes]) -> None:
        self.ids = np.array(ids, np.int64)
        self.text = [folded(np.frombuffer(r, np.uint8)) for r in rows]
        grams, item, place = [], [], []
        for k, low in enumerate(self.text):
            g = gram_hashes(low)
            grams.append(g)
            item.append(np.full(len(g), k))
            place.append(np.arange(len(g)))
        grams = np.concatenate([*grams, np.empty(0, np.uint64)])
        order = np.argsort(grams, kind="stable")
        self.grams = grams[order]
        self.item = np.concatenate([*item, np.empty(0, int)])[order]
        self.place = np.concatenate([*place, np.empty(0, int)])[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._slots(self.grams)] = True

    @staticmethod
    def _slots(grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - _FILTER_BITS)).astype(np.int32)

    def hits(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text position, item, item position) of all shared q-grams of a buffer."""
        grams = gram_hashes(low)
        at = np.flatnonzero(self.filter[self._slots(grams)])
        first = np.searchsorted(self.grams, grams[at], "left")
        n = np.searchsorted(self.grams, grams[at], "right") - first
        at, first, n = at[n > 0], first[n > 0], n[n > 0]
        each = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[each], self.place[each]


def segments(length: int) -> np.ndarray:
    """Starts of the segments of an item; the last one ends with the item."""
    if length <= SEGMENT:
        return np.array([0])
    return np.unique(np.r_[np.arange(0, length - SEGMENT, STEP), length - SEGMENT])


def needed(length: int) -> tuple[int, int]:
    """(edit budget, shared q-grams) for a segment; short items get a budget in proportion, so the bound stays positive."""
    edits = EDITS * length // SEGMENT
    while edits and length - Q + 1 - edits * Q < 1:
        edits -= 1
    return edits, max(1, length - Q + 1 - edits * Q)


def banded_distance(pattern: np.ndarray, text: np.ndarray, budget: int, slack: int) -> tuple[int, int, int]:
    """(edits, begin, end) of the best stretch of ``text`` for ``pattern``, on diagonals within the band.

    ``text`` starts ``slack`` bytes before the expected place; the stretch may begin and end anywhere in the band.  The edits
    are above ``budget`` if none fits.
    """
    far, n, m = budget + 1, len(text), len(pattern)
    width = 2 * slack + 1
    cost = np.zeros(width, np.int64)  # row 0: free start on every diagonal
    origin = np.arange(width)
    cost[origin > n] = far
    for i in range(1, m + 1):
        j = i + np.arange(width)  # text end of each diagonal
        inside = (j >= 1) & (j <= n)
        step = np.where(inside & (text[np.clip(j - 1, 0, max(n - 1, 0))] == pattern[i - 1] if n else False), 0, 1)
        best, source = np.where(inside, cost + step, far), origin.copy()
        skip = np.r_[cost[1:], far] + 1  # a pattern byte without a text byte
        use = skip < best
        best[use], source[use] = skip[use], np.r_[origin[1:], 0][use]
        for d in range(1, width):  # a text byte without a pattern byte
            if best[d - 1] + 1 < best[d] and inside[d]:
                best[d], source[d] = best[d - 1] + 1, source[d - 1]
        cost, origin = np.minimum(best, far), source
        if cost.min() > budget:
            return far, 0, 0
    d = int(np.argmin(cost))
    return int(cost[d]), int(origin[d]), min(m + d, n)


def matches(items: Items, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """(row, item, begin, end, item begin, item end, shared, edits) per row and item: the best verified segment."""
    low = folded(data)
    for o in offsets[1:-1]:  # a two-byte letter never spans rows
        if o < len(low):
            low[o] = _FOLDED[data[o]]
    at, item, place = items.hits(low)
    row = np.searchsorted(offsets, at, "right") - 1
    whole = at + Q <= offsets[row + 1]
    at, item, place, row = at[whole], item[whole], place[whole], row[whole]
    out = []
    if not len(at):
        return out
    # distinct q-gram places of a (row, item) bound what any segment can share, so most pairs end here
    pair = row.astype(np.int64) * len(items.ids) + item
    order = np.argsort(pair, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(pair[order]) > 0, True])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        k = order[a:b]
        r, it = int(row[k[0]]), int(item[k[0]])
        length = len(items.text[it])
        edits, bound = needed(min(SEGMENT, length))
        if b - a < bound:
            continue
        begin, end = int(offsets[r]), int(offsets[r + 1])
        x, p = at[k] - begin, place[k]
        diagonal, half = x - p, edits + 1
        best = None
        for s in segments(length):
            size = min(SEGMENT, length)
            inside = (p >= s) & (p + Q <= s + size)
            if inside.sum() < bound:
                continue
            for shift in (0, half):  # bands of 2 * half diagonals, overlapping by half
                band = (diagonal[inside] + shift) // (2 * half)
                # places far apart in the text share a band only on the same diagonal, so one band is one region
                for which in np.unique(band):
                    shared = len(np.unique(p[inside][band == which]))
                    if shared < bound:
                        continue
                    low_d = int(which) * 2 * half - shift
                    start = low_d + int(s) - half
                    lead = max(0, -start)
                    region = low[begin + start + lead : min(end, begin + start + size + 4 * half)]
                    if lead:
                        region = np.r_[np.zeros(lead, np.uint8), region]
                    cost, o, e = banded_distance(items.text[it][s : s + size], region, edits, 2 * half)
                    if cost <= edits and (best is None or (cost, -shared) < (best[7], -best[6])):
                        best = (r, it, max(0, start + o), min(end - begin, start + e), int(s), int(s) + size, shared, cost)
            if best is not None and best[7] == 0:
                break
        if best is not None:
            out.append(best)
    return out


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Benchmark rows in blocks of bounded bytes; rows without an id or with less than ``Q`` bytes cannot match."""
    ids, rows, size = [], [], 0
    for x in benchmark.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        raw = x["text"].encode()
        if len(raw) < Q:
            continue
        ids.append(int(x["item_id"]))
        rows.append(raw)
        size += len(raw)
        if size >= BLOCK_BYTES:
            yield Items(ids, rows)
            ids, rows, size = [], [], 0
    if ids:
        yield Items(ids, rows)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row and benchmark item of which it holds a segment, with the best segment's place (code points of
    the text, bytes of the item), shared q-grams and edits.

    Null and empty texts, and an empty benchmark, give no rows.  Repeated document rows give repeated results.
    """
    spark = docs.sparkSession
    ship(spark)
    found = None
    for items in blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)  # at most a block and its index

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                ids, columns = batch.column("doc_id").to_pylist(), [[] for _ in range(8)]
                for first, _, data, offsets in chunks(batch.column("text")):
                    for r, it, b, e, ib, ie, n, cost in matches(own, data, offsets):
                        text = data[offsets[r] : offsets[r + 1]]
                        points = (text & 0xC0) != 0x80
                        values = (ids[first + r], int(own.ids[it]), int(points[:b].sum()), int(points[:e].sum()), ib, ie, n, cost)
                        for c, v in zip(columns, values, strict=True):
                            c.append(v)
                if columns[0]:
                    kinds = [pa.int64()] * 2 + [pa.int32()] * 6
                    names = ["doc_id", "item_id", "begin", "end", "item_begin", "item_end", "n_shared", "edits"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        part = texts(docs).mapInArrow(run, RESULT)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], RESULT)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no segment of a benchmark item, with all their columns and without a shuffle."""
    spark = docs.sparkSession
    ship(spark)
    for items in blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, _, data, offsets in chunks(batch.column("text")):
                    keep[[first + m[0] for m in matches(own, data, offsets)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

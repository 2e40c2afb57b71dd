"""Periodic runs of words: a dictionary of basic factors proposes periods, which are extended and deduplicated.

A basic factor is a stretch of ``2 ** k`` words; equal factors of one text share a name, made from the names of their
halves.  Of each factor only the occurrences that start within twice its length of another are looked at.  Starts at most
half a length apart stand in one arithmetic progression (its step is the factor's own period), so a progression is
entered by its first and last member alone: at most a handful of proposals a place and level.  A run of period q holds
every factor of length 2^k <= q < 2^(k+1) twice at distance q, so each run is proposed at level k.
Proposals are extended both ways by descending through the names; runs with equal ends keep their smallest period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import SPACES, chunks, ragged, texts, word_bounds

MIN_WORDS, MIN_EXPONENT = 12, 2
_FAR = np.iinfo(np.int64).max

RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words of one row only."""
    if not len(starts):
        return np.empty(0, np.int64)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    packed = np.ascontiguousarray(data[~SPACES[data]])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    names = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    return rows.astype(np.int64) * (int(names.max()) + 1) + names


def _named(keys: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of length ``n`` (-1: occurs once or never), then the repeated places by (name, place), and their names."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    fresh = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]] if len(keys) else np.empty(0, bool)
    group = np.cumsum(fresh) - 1
    again = np.bincount(group, minlength=1)[group] > 1 if len(keys) else np.empty(0, bool)
    at, name = places[order[again]], group[again]
    names = np.full(n, -1, np.int32)
    names[at] = name
    return names, at, name


def _proposed(at: np.ndarray, name: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of later occurrences at a distance of ``size`` to ``2 * size - 1``; ``at`` is sorted by name, then place."""
    step = np.full(len(at), _FAR)
    same = name[1:] == name[:-1]
    step[:-1][same] = np.diff(at)[same]
    # a place whose next occurrence is further than half a length away ends its progression
    ends = np.flatnonzero(step > size // 2)
    end = ends[np.searchsorted(ends, np.arange(len(at)))]
    here = np.arange(len(at))
    now = end
    while len(here):
        more = step[now] != _FAR
        here, first = here[more], now[more] + 1
        gap = at[first] - at[here]
        near = gap < 2 * size
        here, first, gap = here[near], first[near], gap[near]
        last = end[first]
        yield at[here[gap >= size]], gap[gap >= size]
        gap = at[last] - at[here]
        fits = (gap >= size) & (gap < 2 * size) & (last > first)
        yield at[here[fits]], gap[fits]
        now = last


def find_runs(ids: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of ``ids``, by start, then period.  Equal ids must stand in one text."""
    n = len(ids)
    names, at, name = _named(ids, np.arange(n), n)
    levels, places, periods, size = [], [], [], 1
    while len(at):
        levels.append(names)
        for place, period in _proposed(at, name, size):
            places.append(place)
            periods.append(period)
        m = len(names) - size
        if m <= 0:
            break
        live = np.flatnonzero((names[:m] >= 0) & (names[size:] >= 0))
        keys = names[live].astype(np.int64) * (int(names.max()) + 1) + names[live + size]
        names, at, name = _named(keys, live, m)
        size *= 2
    none = np.empty(0, np.int64)
    if not places or not sum(map(len, places)):
        return none, none, none
    keys = np.unique(np.concatenate(periods) * (n + 1) + np.concatenate(places))
    keys = keys[np.r_[True, np.diff(keys) != 1]]  # a proposal next to one of the same period lies in the same stretch
    period, left = keys // (n + 1), keys % (n + 1)
    right = left.copy()
    for k in range(len(levels) - 1, -1, -1):
        names, size = levels[k], 1 << k
        ok = np.flatnonzero(right + period < len(names))
        a = names[right[ok]]
        ok = ok[(a >= 0) & (a == names[right[ok] + period[ok]])]
        right[ok] += size
        ok = np.flatnonzero((left >= size) & (left - size + period < len(names)))
        a = names[left[ok] - size]
        ok = ok[(a >= 0) & (a == names[left[ok] - size + period[ok]])]
        left[ok] -= size
    end = right + period
    long = end - left >= np.maximum(min_words, MIN_EXPONENT * period)
    start, end, period = left[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    smallest = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(start) else np.empty(0, bool)
    start, end, period = start[smallest], end[smallest], period[smallest]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """The given words of every row, joined by one space."""
    last = np.r_[rows[1:] != rows[:-1], True] if len(rows) else np.empty(0, bool)
    lengths = ends - starts + ~last
    out = np.r_[data, np.uint8(0x20)][ragged(starts, lengths)] if len(data) else np.empty(0, np.uint8)
    out[np.cumsum(lengths)[~last] - 1] = 0x20
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(rows, lengths, n).astype(np.int64), out=offsets[1:])
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def _detected(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, column = batch.column("doc_id"), batch.column("text")
        for first, stop, data, offsets in chunks(column):
            n = stop - first
            starts, ends, rows = word_bounds(data, offsets)
            counts = np.bincount(rows, minlength=n)
            begins = np.r_[0, np.cumsum(counts)]
            s, e, p = find_runs(word_names(data, starts, ends, rows), min_words)
            dropped = np.zeros(len(starts) + 1, np.int64)
            np.add.at(dropped, s + p, 1)
            np.add.at(dropped, e, -1)
            kept = np.cumsum(dropped[:-1]) == 0
            row = rows[s] if len(s) else np.empty(0, np.int64)
            runs = pa.StructArray.from_arrays([pa.array(s - begins[row]), pa.array(e - s), pa.array(p)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=n))].astype(np.int32)), runs)
            texts_left = _collapsed(data, starts[kept], ends[kept], rows[kept], n)
            yield pa.RecordBatch.from_arrays([ids.slice(first, n), pa.array(counts), lists, texts_left], ["doc_id", "n_words", "runs", "collapsed"])


def detect(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The periodic runs of every text and the text without their repetitions; a row for each row of ``docs``.

    ``runs``: every stretch of words of smallest period q, at least ``max(min_words, 2 q)`` words long, that cannot be
    extended; by start, then period.  ``collapsed``: words after the first period of some run go, the others are joined
    by one space.  Null and empty texts have no run and collapse to the empty text; repeated rows and null ids are rows
    like others; a text is read whole, in memory linear in its words for each level that still repeats.  A map: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _detected(batches, min_words)

    return texts(docs).mapInArrow(run, RESULT)


def longest(runs: Column) -> Column:
    """The longest run (ties: smallest start, then period); null where there is none."""
    return F.try_element_at(F.array_sort(runs, lambda a, b: F.when(a["length"] != b["length"], F.when(a["length"] > b["length"], -1).otherwise(1)).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))), F.lit(1))


def planted(docs: DataFrame) -> DataFrame:
    """Texts whose id's crc32 is divisible by 10 get a periodic tail, fixed by the id: the cases the query must find."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", h.alias("h"))
    docs = docs.withColumn("w", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")))
    g = F.floor(F.col("h") / 10)
    docs = docs.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    docs = docs.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + g % 8)))
    at = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(at, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run, and SHA-256 of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.col("best")
    return found.withColumn("best", longest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def oracle_sql() -> str:
    """The query of this operator in SQL: equal words of a text at each distance, in stretches."""
    crc = """xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT),
      lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
        lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)::BIGINT"""
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {crc} AS h,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sized AS (SELECT *, len(w)::BIGINT AS n, h // 10 AS g FROM docs),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM sized),
planted AS (
  SELECT rid, doc_id, CASE WHEN a IS NULL THEN w ELSE
    list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) END AS w
  FROM placed),
tokens AS MATERIALIZED (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS i FROM planted),
equal AS (SELECT x.rid, x.i, y.i - x.i AS q FROM tokens x JOIN tokens y ON x.rid = y.rid AND x.word = y.word AND x.i < y.i),
stretches AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS s FROM equal),
long AS (
  SELECT rid, min(i) AS start, count(*) + q AS length, q AS period FROM stretches GROUP BY rid, q, s
  HAVING count(*) + q >= greatest({MIN_WORDS}, {MIN_EXPONENT} * q)),
runs AS MATERIALIZED (SELECT rid, start, length, min(period) AS period FROM long GROUP BY rid, start, length),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length DESC, start, period) = 1),
listed AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY rid),
dropped AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS body FROM tokens ANTI JOIN dropped USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM planted LEFT JOIN listed USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""

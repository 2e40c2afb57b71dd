"""What the operators share: written tables, folds, byte-level words and hashes over Arrow batches.

A word is ``[^\\x20\\x09-\\x0D]+``; lower-casing touches A-Z only, so both work on UTF-8 bytes.  Null texts
count as empty.  Batches are cut into chunks of about ``CHUNK_BYTES`` so that a task's memory depends on its
longest single text and not on the batch.
"""

from __future__ import annotations

import contextlib
import functools
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_BYTE_CODES = (np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application (as ``--py-files`` would)."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        archive = os.path.join(tempfile.mkdtemp(prefix="veilwork-code-"), "veilwork_code.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for module in sorted(Path(root, "veilwork").rglob("*.py")):
                out.write(module, module.relative_to(root))
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset (tests), a folder of our own is set once."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="veilwork-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"llm-{uuid.uuid4().hex}")


def saved(frame: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and outlives lost executors."""
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    back = frame.sparkSession.read.schema(frame.schema).parquet(path)
    back._saved_in = path
    return back


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans executed inside hand Python at most ``rows`` rows at once: a batch stands in the memory of both processes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`saved` gave and nothing reads again, and the shuffle files of jobs that are over.

    Spark keeps those files until the driver happens to collect its garbage, which a driver that only plans hardly does.
    """
    spark = tables[0].sparkSession
    for saved_table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(saved_table._saved_in)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null: empty); whatever else a table carries stays out of the way."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold(doc_id: Column, parts: int, number: int) -> Column:
    """True where crc32 of the id as text leaves ``number`` modulo ``parts``; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == number, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, trained: Column, max_rows: int) -> DataFrame:
    """(doc_id, text, label) of at most about ``max_rows`` labelled rows, picked by a hash of the id.

    The same hash filter runs on both sides before the join, so only sampled texts are shuffled.
    """
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("label").isNotNull() & F.col("doc_id").isNotNull()
    )
    marks = marks.where(trained).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = max_rows / max(marks.count(), 1)
    if share < 1:
        picked = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(label)), F.lit(1_000_000)) < int(share * 1_000_000)
        marks, docs = marks.where(picked), docs.where(picked)
    return texts(docs).where(trained).join(marks, "doc_id")


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(21, int(n).bit_length()))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows; a longer single text is a run of its own."""
    data, offsets = text_bytes(column)
    first, n = 0, len(column)
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word of a chunk."""
    inside = ~SPACES[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(data):
        edges = offsets[:-1][np.diff(offsets) > 0]
        before[edges] = False
        after[offsets[1:][np.diff(offsets) > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices ``starts[i], ..., starts[i] + lengths[i] - 1`` of all spans in turn."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all runs of ``size`` words; a row with fewer words gives its whole sequence as one."""
    out, n = np.zeros(max(len(words) - size + 1, 0), np.uint64), len(words) - size + 1
    if n > 0:
        for k in range(size):
            out += words[k : k + n] * np.uint64(2 * k + 3) + mix(words[k : k + n] + np.uint64(k + 1))
        whole = rows[:n] == rows[size - 1 :]
        out, at = mix(out[whole] + np.uint64(size)), rows[:n][whole]
    else:
        at = np.empty(0, rows.dtype)
    firsts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.empty(0, int)
    counts = np.diff(np.r_[firsts, len(rows)])
    short_h, short_r = [], []
    for f, c in zip(firsts[counts < size], counts[counts < size], strict=True):
        h = np.array([c], np.uint64)
        for k in range(c):
            h = mix(h * np.uint64(31) + words[f + k])
        short_h.append(h[0])
        short_r.append(rows[f])
    if short_h:
        out, at = np.r_[out, np.array(short_h, np.uint64)], np.r_[at, np.array(short_r, at.dtype)]
    return out, at


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: bigint), the component being its smallest node.

    Alternates the large-star and small-star steps: each round hooks every node's neighbours to the smallest one it
    sees, so depth halves and hubs are aggregated by a partial minimum.  Rounds are written tables; the driver only
    reads one count per round.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = saved(pairs)
    while True:
        # large star: all larger neighbours of a node go to its smallest neighbour (or itself)
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        # small star: all smaller neighbours, and the node, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = saved(
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        changed = small.join(pairs, ["a", "b"], "left_anti").limit(1).count() + pairs.join(small, ["a", "b"], "left_anti").limit(1).count()
        drop(pairs)
        pairs = small
        if not changed:
            break
    star = pairs.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    found = saved(star.unionByName(star.select(F.col("component").alias("node"), "component").distinct()))
    drop(pairs)
    return found

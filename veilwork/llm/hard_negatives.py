"""Hard negatives by exact integer scores, read from subset-sum tables (the method of the Four Russians).

Components become integers.  For eight dimensions of an anchor, a table holds the sums of all 256 subsets of its
components.  A candidate's components are cut into bit planes in two's complement; one byte packs one plane of eight
dimensions and is the index into that table.  Adding the looked-up sums of a plane and shifting from plane to plane
gives the full inner product, exactly.

Candidates are dealt into parts; every anchor visits every part, so a task holds one part and streams the anchors past
it in blocks.  A part answers with its best few, which meet per anchor: first the positives, then, with their scores
known, the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.common import saved, ship

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
PART_ROWS, LEAST_PART_ROWS = 262_144, 2_048
ANCHOR_BLOCK, SLICE_ROWS = 64, 8_192
MAX_COMPONENT = 1 << 27  # larger ones could overflow a long in a sum of 64 products

_GROUP = 8
_SUBSETS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)  # the bit order of packbits


def quantised(rows: DataFrame, vec_id: Column, label: Column, vector: Column, scale: int = SCALE) -> DataFrame:
    """(id, label, v): whole numbers ``floor(scale * x)``.  Rows with a null or a non-finite component, or one beyond ``MAX_COMPONENT``, go."""
    numbers = F.transform(vector, lambda x: x.cast("double") * scale)
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MAX_COMPONENT))
    out = rows.select(vec_id.cast("bigint").alias("id"), label.cast("bigint").alias("label"), numbers.alias("v"))
    out = out.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(fits, F.lit(False)))
    return out.withColumn("v", F.transform("v", lambda x: F.floor(x).cast("int")))


def bit_planes(v: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes of whole numbers (rows, dims) in two's complement; the last plane is the sign."""
    planes = int(max(v.max(initial=0), -1 - v.min(initial=0))).bit_length() + 1
    v = np.pad(v, ((0, 0), (0, -v.shape[1] % _GROUP)))
    return np.stack([np.packbits((v >> b) & 1 != 0, axis=1).T for b in range(planes)])


def subset_sums(anchors: np.ndarray, dtype: type) -> np.ndarray:
    """(groups, 256, anchors): for each eight dimensions the sums of every subset of an anchor's components."""
    a = np.pad(anchors, ((0, 0), (0, -anchors.shape[1] % _GROUP))).astype(np.int64)
    return np.ascontiguousarray((_SUBSETS @ a.reshape(len(a), -1, _GROUP).transpose(1, 2, 0)).astype(dtype))


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products: look up each plane's bytes, add, shift."""
    n = planes.shape[2]
    total, looked = np.zeros((n, tables.shape[2]), tables.dtype), np.empty((n, tables.shape[2]), tables.dtype)
    for b in range(len(planes) - 1, -1, -1):
        total += total
        for g in range(len(tables)):
            np.take(tables[g], planes[b, g], axis=0, out=looked, mode="clip")
            if b == len(planes) - 1:
                total -= looked
            else:
                total += looked
    return total


def _first(score: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the rows ``at``, the first ``k`` by falling score, then id."""
    if len(at) > 4 * k:
        worst = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= worst]
        if len(at) > 4 * k:  # ties at the border: all better ones, and of the equal ones the smallest ids
            equal = at[score[at] == worst]
            at = np.r_[at[score[at] > worst], equal[np.argpartition(ids[equal], min(k, len(equal) - 1))[:k]]]
    return at[np.lexsort((ids[at], -score[at]))][:k]


class _Part:
    """The candidates of one part, by label and id, as bit planes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        order = np.lexsort((ids, labels))
        self.ids, self.labels, v = ids[order], labels[order], v[order]
        self.planes = bit_planes(v)
        self.dims, self.largest = v.shape[1], int(np.abs(v).max(initial=0)) + 1

    def against(self, anchors: np.ndarray) -> np.ndarray:
        """(anchors, rows) scores."""
        dims = max(self.dims, anchors.shape[1])
        most = max(dims, 1) * 2 * self.largest * (int(np.abs(anchors).max(initial=0)) + 1)
        tables = subset_sums(anchors, np.int32 if most < 1 << 31 else np.int64)
        groups = min(len(tables), self.planes.shape[1])  # dimensions that one side lacks count as 0
        out = np.empty((len(anchors), len(self.ids)), tables.dtype)
        for at in range(0, len(self.ids), SLICE_ROWS):
            out[:, at : at + SLICE_ROWS] = scores(tables[:groups], self.planes[:, :groups, at : at + SLICE_ROWS]).T
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled with 0."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    dims, flat = int(lengths.max(initial=0)), column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == dims * len(lengths):
        return flat.reshape(len(lengths), dims).astype(np.int32)
    out = np.zeros((len(lengths), dims), np.int32)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    dims = max(x.shape[1] for x in parts)
    return np.concatenate([np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in parts])


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Part, pa.RecordBatch]]:
    """(part, block of anchors) of a stream sorted by part, candidates before anchors."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ready: _Part | None = None
    now = None
    for batch in batches:
        parts, anchor = batch.column("part").to_numpy(), batch.column("anchor").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((parts[1:] != parts[:-1]) | (anchor[1:] != anchor[:-1])) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(parts)], strict=True):
            if a == b:
                continue
            if parts[a] != now:
                held, ready, now = [], None, parts[a]
            piece = batch.slice(a, b - a)
            if not anchor[a]:
                held.append((piece.column("id").to_numpy(), piece.column("label").to_numpy(), _matrix(piece.column("v"))))
                continue
            if ready is None and held:
                ready = _Part(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), _stacked([x[2] for x in held]))
                held = []
            if ready is not None:
                for at in range(0, len(piece), ANCHOR_BLOCK):
                    yield ready, piece.slice(at, ANCHOR_BLOCK)


def _positives(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pd.DataFrame]:
    for part, block in _visits(batches):
        rows = []
        all_scores = part.against(_matrix(block.column("v")))
        for score, key, own, label in zip(all_scores, block.column("key").to_pylist(), block.column("id").to_pylist(), block.column("label").to_pylist(), strict=True):
            low, high = np.searchsorted(part.labels, [label, label + 1])
            at = np.arange(low, high)
            best = _first(score, part.ids, at[part.ids[at] != own], k)
            rows.append(pd.DataFrame({"key": key, "positive_id": part.ids[best], "positive_score": score[best].astype(np.int64)}))
        yield pd.concat(rows)


def _negatives(batches: Iterator[pa.RecordBatch], k: int, low: int, high: int) -> Iterator[pd.DataFrame]:
    for part, block in _visits(batches):
        rows = []
        all_scores = part.against(_matrix(block.column("v")))
        columns = (block.column(c).to_pylist() for c in ("key", "id", "label", "positives"))
        for score, key, own, label, positives in zip(all_scores, *columns, strict=True):
            other = np.flatnonzero(part.labels != label)
            theirs = score[other].astype(np.int64)
            for p in positives:
                within = other[(100 * theirs >= low * p["positive_score"]) & (100 * theirs <= high * p["positive_score"])]
                best = _first(score, part.ids, within, k)
                if len(best):
                    rows.append(pd.DataFrame({"key": key, "anchor_id": own, "nth": p["nth"], "positive_id": p["positive_id"], "positive_score": p["positive_score"], "negative_id": part.ids[best], "negative_score": score[best].astype(np.int64)}))
        if rows:
            yield pd.concat(rows)


def _as_arrow(frames: Iterator[pd.DataFrame], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        yield pa.RecordBatch.from_pandas(frame, schema, preserve_index=False)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW_PERCENT, high: int = HIGH_PERCENT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``vectors`` (id, label, v) as ``quantised`` makes them.

    An anchor's positives are its ``positives`` best other ids of its label; for each, its ``negatives`` best rows of other
    labels whose score lies between ``low`` and ``high`` percent of the positive's.  Ties go to the smaller id.  A negative
    positive score has an empty window.  A shorter vector counts as filled with zeros.  Equal anchor rows are one anchor,
    anchors that share an id but not their vector or label are mined apart; a candidate counts as often as it stands, but
    never for an anchor of its own id.  No rows, or no anchors: no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    anchors = saved(vectors.where(is_anchor).distinct().withColumn("key", F.xxhash64("id", "label", "v")))
    rows = vectors.count()
    parts = max(-(-rows // PART_ROWS), min(spark.sparkContext.defaultParallelism, -(-rows // LEAST_PART_ROWS)), 1)
    # dealt by place rather than by id or vector, so that no repeated value gathers in one part
    place = F.monotonically_increasing_id()
    dealt = vectors.select(F.pmod(F.xxhash64(place), F.lit(parts)).cast("int").alias("part"), F.lit(False).alias("anchor"), "id", "label", "v", F.lit(None).cast("bigint").alias("key"))

    def visiting(who: DataFrame) -> DataFrame:
        """Each part's candidates, followed by all anchors."""
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
        who = who.select(everywhere, F.lit(True).alias("anchor"), "id", "label", "v", "key", *(c for c in who.columns if c == "positives"))
        both = dealt.unionByName(who, allowMissingColumns=True)
        return both.repartition(parts, "part").sortWithinPartitions("part", "anchor")

    found = pa.schema([("key", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
    near = visiting(anchors).mapInArrow(lambda b: _as_arrow(_positives(b, positives), found), "key long, positive_id long, positive_score long")
    by_score = Window.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= positives)
    near = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("positives"))
    asking = saved(anchors.join(near, "key"))

    result = pa.schema([("key", pa.int64()), ("anchor_id", pa.int64()), ("nth", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])
    hard = visiting(asking).mapInArrow(
        lambda b: _as_arrow(_negatives(b, negatives, low, high), result),
        "key long, anchor_id long, nth int, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    ranks = Window.partitionBy("key", "nth").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle_sql() -> str:
    """The query of this operator in SQL: all scores of the anchors, ranked."""
    return f"""
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, c.id AS other, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.id % 100 = 0 AND a.id <> c.id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other)::INTEGER AS rank,
       s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND {LOW_PERCENT} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH_PERCENT} * p.positive_score
QUALIFY rank <= {NEGATIVES}
"""

"""Rename, whitelist, rank and de-overlap findings.

Overlaps are resolved greedily in the order (precedence rank, length, begin, label,
detector).  Only findings that overlap, directly or through others, can influence each
other, so each run of overlapping findings ("island") is folded alone.  In a short island a
finding is compared with all taken ones.  A long island is folded in batches: taken
findings are kept as one sorted array of disjoint spans, in which a binary search finds the
only one that can overlap a finding, and what a batch takes is merged into it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions.arrays import empty_array, exclusive_scan, let
from veilwork.operators.catalog import DEFAULT_LABELS, LABEL_RENAMES, PRECEDENCE
from veilwork.operators.rules import CHUNK_FIELDS, CHUNK_TYPE

SPAN_TYPE = "struct<begin:int,end:int>"
RESOLVED_TYPE = f"struct<kept:array<{CHUNK_TYPE}>,residual:array<{SPAN_TYPE}>>"
POSITION_BLOCK_BITS = 16
SHORT_ISLAND, ISLAND_BATCH = 48, 512  # findings


def requested_labels(labels: Iterable[str] | None) -> tuple[str, ...]:
    """The labels to find: defaults if none are named, renames applied, empty refused."""
    if labels is None:
        labels = DEFAULT_LABELS
    labels = tuple(labels)
    if not labels:
        raise ValueError("the list of requested labels is empty")
    return tuple(sorted({LABEL_RENAMES.get(x, x) for x in labels}))


def accepted_labels(labels: Iterable[str] | None) -> tuple[str, ...]:
    """The labels a finding may carry to be kept: a renamed label counts under both names."""
    labels = DEFAULT_LABELS if labels is None else tuple(labels)
    return tuple(sorted({*requested_labels(labels), *labels}))


def renamed(entity: Column, detector: Column, context_detectors: Sequence[str]) -> Column:
    """Rename the labels of every detector but the context rules', whose names are given."""
    mapped = entity
    for old, new in LABEL_RENAMES.items():
        mapped = F.when(entity == old, F.lit(new)).otherwise(mapped)
    return F.when(detector.isin(*context_detectors), entity).otherwise(mapped)


def precedence_rank(
    entity: Column, detector: Column, precedence: Sequence[tuple[str, str]] = PRECEDENCE
) -> Column:
    rank = F.lit(len(precedence) + 1)
    for i, (d, e) in reversed(list(enumerate(precedence, start=1))):
        rank = F.when((detector == d) & (entity == e), F.lit(i)).otherwise(rank)
    return rank


def rename_findings(findings: Column, context_detectors: Sequence[str]) -> Column:
    return F.transform(
        findings,
        lambda f: F.struct(
            *[f[x].alias(x) for x in CHUNK_FIELDS[:4]],
            renamed(f["entity"], f["detector"], context_detectors).alias("entity"),
            f["detector"].alias("detector"),
        ),
    )


def whitelist_findings(findings: Column, labels: Sequence[str]) -> Column:
    return F.filter(findings, lambda f: f["entity"].isin(*labels))


def _overlap(a: Column, b: Column) -> Column:
    return (a["begin"] < b["end"]) & (b["begin"] < a["end"])


def _as_chunk(f: Column) -> Column:
    return F.struct(*[f[x].alias(x) for x in CHUNK_FIELDS])


def _by_merit(island: Column) -> Column:
    return F.array_sort(
        F.transform(
            island,
            lambda f: F.struct(
                f["rank"].alias("rank"),
                (f["begin"] - f["end"]).alias("minus_length"),
                f["begin"].alias("begin"),
                f["entity"].alias("entity"),
                f["detector"].alias("detector"),
                f["end"].alias("end"),
                f["chunk"].alias("chunk"),
                f["sent_id"].alias("sent_id"),
            ),
        )
    )


def _greedy_by_all(fs: Column) -> Column:
    """Findings taken from a short island, each compared with all taken before."""
    return F.aggregate(
        fs,
        F.slice(fs, F.lit(1), F.lit(0)),
        lambda taken, f: F.when(F.exists(taken, lambda t: _overlap(t, f)), taken).otherwise(F.array_append(taken, f)),
    )


def _is_free(fs: Column, taken: Column, f: Column) -> Column:
    """Whether a finding overlaps none of the taken ones, given as sorted numbers ``begin << 32 | place in fs``.

    Taken findings are disjoint.  Of those that begin before the end of ``f`` the last one reaches furthest, so it alone is
    compared; falling powers of two find it.
    """
    before = F.shiftleft(f["end"].cast("bigint"), 32)
    found = F.aggregate(
        F.array(*[F.lit(1 << k) for k in range(26, -1, -1)]),
        F.lit(0),
        lambda n, step: F.when(F.coalesce(F.get(taken, n + step - 1) < before, F.lit(False)), n + step).otherwise(n),
    )
    return F.coalesce(_of(fs, F.get(taken, found - 1))["end"] <= f["begin"], F.lit(True))


def _of(fs: Column, key: Column) -> Column:
    return F.get(fs, key.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))


def _greedy_by_batches(fs: Column) -> Column:
    """The same findings taken from a long island."""
    batches = F.sequence(F.lit(0), F.floor((F.size(fs) - 1) / ISLAND_BATCH).cast("int"))
    nothing = empty_array("bigint")

    def places(b: Column) -> Column:
        return F.sequence(b * ISLAND_BATCH, F.least((b + 1) * ISLAND_BATCH, F.size(fs)) - 1)

    def taken_of(free: Column) -> Column:
        """Of the free findings of a batch, those that do not overlap a better one of it."""
        return F.aggregate(
            free,
            nothing,
            lambda got, i: F.when(F.exists(got, lambda t: _overlap(_of(fs, t), fs[i])), got).otherwise(
                F.array_append(got, F.shiftleft(fs[i]["begin"].cast("bigint"), 32) + i)
            ),
        )

    taken = F.aggregate(
        batches,
        nothing,
        lambda got, b: F.sort_array(F.concat(got, taken_of(F.filter(places(b), lambda i: _is_free(fs, got, fs[i]))))),
    )
    return F.transform(taken, lambda t: _of(fs, t))


def _fold_island(island: Column) -> Column:
    """Greedy choice inside one run of overlapping findings, plus what it leaves bare."""

    def by_position(greedy: Column) -> Column:
        return F.array_sort(
            F.transform(
                greedy,
                lambda f: F.struct(f["begin"].alias("begin"), *[f[x].alias(x) for x in CHUNK_FIELDS if x != "begin"]),
            )
        )

    in_order = let(
        _by_merit(island),
        lambda fs: by_position(F.when(F.size(fs) <= SHORT_ISLAND, _greedy_by_all(fs)).otherwise(_greedy_by_batches(fs))),
    )

    def close(taken: Column) -> Column:
        low, high = F.array_min(F.transform(island, lambda f: f["begin"])), F.array_max(
            F.transform(island, lambda f: f["end"])
        )
        # An island has no holes, so everything between taken findings was found by a loser.
        bare = F.filter(
            F.transform(
                F.sequence(F.lit(0), F.size(taken)),
                lambda i: F.struct(
                    F.when(i == 0, low).otherwise(F.get(taken, i - 1)["end"]).alias("begin"),
                    F.when(i == F.size(taken), high).otherwise(F.get(taken, i)["begin"]).alias("end"),
                ),
            ),
            lambda g: g["begin"] < g["end"],
        )
        return F.struct(F.transform(taken, _as_chunk).alias("kept"), bare.alias("residual"))

    return let(in_order, close)


def _islands(ordered: Column) -> Column:
    reach = exclusive_scan(F.transform(ordered, lambda f: f["end"]), F.lit(-1), lambda a, b: F.greatest(a, b))
    firsts = let(
        reach,
        lambda r: F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: ordered[i]["begin"] >= r[i]
        ),
    )
    return let(
        firsts,
        lambda fs: F.transform(
            fs,
            lambda first, k: F.slice(
                ordered, first + 1, F.coalesce(F.get(fs, k + 1), F.size(ordered)) - first
            ),
        ),
    )


def resolve_findings(findings: Column, precedence: Sequence[tuple[str, str]] = PRECEDENCE) -> Column:
    """``struct<kept, residual>``: disjoint findings and the bare rest of the dropped ones."""
    ordered = F.array_sort(
        F.transform(
            findings,
            lambda f: F.struct(
                f["begin"].alias("begin"),
                precedence_rank(f["entity"], f["detector"], precedence).alias("rank"),
                *[f[x].alias(x) for x in CHUNK_FIELDS if x != "begin"],
            ),
        )
    )
    no_spans = empty_array(SPAN_TYPE)

    def disjoint(fs: Column) -> Column:
        return F.struct(F.transform(fs, _as_chunk).alias("kept"), no_spans.alias("residual"))

    def fold(fs: Column) -> Column:
        parts = F.transform(
            _islands(fs),
            lambda island: F.when(F.size(island) == 1, disjoint(island)).otherwise(_fold_island(island)),
        )
        return let(
            parts,
            lambda ps: F.struct(
                F.flatten(F.transform(ps, lambda p: p["kept"])).alias("kept"),
                F.flatten(F.transform(ps, lambda p: p["residual"])).alias("residual"),
            ),
        )

    def decide(fs: Column) -> Column:
        collides = F.when(F.size(fs) < 2, F.lit(False)).otherwise(
            F.exists(
                F.sequence(F.lit(1), F.greatest(F.size(fs) - 1, F.lit(1))),
                lambda i: fs[i - 1]["end"] > fs[i]["begin"],
            )
        )
        return F.when(collides, fold(fs)).otherwise(disjoint(fs))

    return let(ordered, decide)


def union_chunks(*tables: DataFrame) -> DataFrame:
    """Findings of several detectors as one table."""
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t)
    return first


def rank_chunks(chunks: DataFrame, precedence: Sequence[tuple[str, str]] = PRECEDENCE) -> DataFrame:
    return chunks.withColumn("rank", precedence_rank(F.col("entity"), F.col("detector"), precedence))


def drop_duplicate_chunks(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per span and label; the best-ranked, then first-named detector stays."""
    best = F.min_by("detector", F.struct("rank", "detector")).alias("detector")
    return (
        rank_chunks(chunks)
        .groupBy(key, "begin", "end", "entity")
        .agg(F.min("sent_id").alias("sent_id"), F.min("chunk").alias("chunk"), best)
        .select(key, *CHUNK_FIELDS)
    )


def number_islands(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add ``island``: the begin of the run of overlapping findings a row belongs to.

    One document may hold a large share of all findings, so the running maximum is
    taken inside (document, position block) and carried over between blocks with a
    window over one row per block.
    """
    blocks = chunks.withColumn("block", F.shiftright("begin", POSITION_BLOCK_BITS))
    earlier = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(key, "block").orderBy("begin", "end", "entity", "detector")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    reach = (
        blocks.groupBy(key, "block")
        .agg(F.max("end").alias("block_end"))
        .select(key, "block", F.max("block_end").over(earlier).alias("carried_end"))
    )
    started = (
        blocks.join(reach, [key, "block"])
        .withColumn("reach", F.greatest(F.col("carried_end"), F.max("end").over(before)))
        .withColumn(
            "start", F.when(F.col("reach").isNull() | (F.col("begin") >= F.col("reach")), F.col("begin"))
        )
    )
    carried = (
        started.groupBy(key, "block")
        .agg(F.max("start").alias("block_start"))
        .select(key, "block", F.max("block_start").over(earlier).alias("carried_start"))
    )
    return (
        started.withColumn("running_start", F.max("start").over(so_far))
        .join(carried, [key, "block"])
        .withColumn("island", F.coalesce("running_start", "carried_start"))
        .select(key, *CHUNK_FIELDS, "island")
    )


def resolve_chunks(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """De-overlap a table of findings; rows ``(key, resolved)``, several per document.

    Findings are gathered per (document, position block), so a document with a large
    share of them is many groups.  A block that no finding enters or leaves across its
    border is resolved on its own; the few others, found from the same gathered rows,
    go through :func:`number_islands`.  For findings that already sit on their
    document's row use :func:`resolve_findings`, which needs no shuffle.
    """
    gathered = (
        chunks.withColumn("block", F.shiftright("begin", POSITION_BLOCK_BITS))
        .groupBy(key, "block")
        .agg(F.collect_list(F.struct(*CHUNK_FIELDS)).alias("findings"))
    )
    reach = F.array_max(F.transform("findings", lambda f: f["end"]))
    last = F.shiftright(reach - 1, POSITION_BLOCK_BITS)
    tied = (
        gathered.filter(last > F.col("block"))
        .select(key, F.explode(F.sequence("block", last)).alias("block"))
        .distinct()
        .withColumn("tied", F.lit(True))
    )
    # An outer join, since Spark moves semi and anti joins below the grouping and would then
    # compute the findings once per branch; so all branches reuse one shuffle.
    marked = gathered.join(tied, [key, "block"], "left")
    lone = marked.filter(F.col("tied").isNull()).select(key, "findings")
    runs = (
        number_islands(marked.filter(F.col("tied")).select(key, F.inline("findings")), key)
        .groupBy(key, "island")
        .agg(F.collect_list(F.struct(*CHUNK_FIELDS)).alias("findings"))
        .select(key, "findings")
    )
    return lone.unionByName(runs).select(key, resolve_findings(F.col("findings")).alias("resolved"))


def kept_chunks(resolved: DataFrame, key: str = "doc_id") -> DataFrame:
    return resolved.select(key, F.inline("resolved.kept"))


def residual_spans(resolved: DataFrame, key: str = "doc_id") -> DataFrame:
    return resolved.select(key, F.inline("resolved.residual"))

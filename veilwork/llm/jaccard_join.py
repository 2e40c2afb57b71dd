"""Exact n-gram Jaccard join with PartEnum signatures.

Sets are put in size bands [l, l / t^2) for the threshold t.  A pair whose smaller set lies in band b has a Hamming distance of at
most ``k = floor((1 - t) / t * (largest size of b))``, so after partitioning the feature domain by hash into ``n1 > k`` parts, at
least ``n1 - k`` parts agree.  Every set emits one signature per part, for its own band and, where its partners may be smaller, for
the band below: hash of (band, part, features in the part).

Parts with fewer than two features are weak evidence (many sets share one empty part or one popular feature), so ``n1 = k + 1 + m``
with room for ``m`` weak ones: if a pair agrees on no strong part, it agrees on more than ``m`` weak parts.  Sets with more than ``m`` weak
parts therefore also emit the first (weak - m) of their weak parts in a global order (prefix filtering: two subsets that share
more than m elements share one of those), and all other weak parts stay silent.  Nothing is lost and no bucket is capped.

Equal sets are first folded into classes.  Each class is compared exactly with the least class (the hub) of every signature it has, and
components are formed from those links.  What is left are links between two members u, v of one hub h that lie in different
components.  With the differences D(u) = u xor h, the Hamming distance of u and v is |D(u)| + |D(v)| - 2 |D(u) and D(v)|, so a link
needs a known overlap of the two differences (never zero: otherwise both link with h).  These are found by a prefix and
positional filter on the differences, features that h lacks first, and verified exactly.  So a group of thousands of near copies
costs a star and not all pairs, while no link between components is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import LOWER, batches_of, chunks, connected_components, drop, mix, saved, shingle_hashes, span_hashes, texts, word_bounds


def band_of(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Size bands; ``band_start`` inverts this."""
    ratio = math.log(10_000 / (percent * percent))
    return np.floor(np.log(np.maximum(sizes, 1)) / ratio + 1e-9).astype(np.int64)


def band_end(band: int, percent: int) -> int:
    """The largest size that may count as in the band (rounded up, which only widens it)."""
    ratio = math.log(10_000 / (percent * percent))
    return math.ceil(math.exp(ratio * (band + 1)) + 1e-6)


def parts_of(band: int, percent: int) -> tuple[int, int]:
    """(n1, m): parts of a band and weak parts its sets may have at no cost."""
    end = band_end(band, percent)
    k = (100 - percent) * end // percent
    start = max(1.0, end * percent * percent / 10_000)
    m = 0
    for _ in range(30):  # room for the weak parts that sets of the band's smallest size have on average, and three deviations
        mean = start / (k + 1 + m)
        weak = (k + 1 + m) * math.exp(-mean) * (1 + mean)
        room = min(math.ceil(weak + 3 * math.sqrt(weak)), k + 1)
        if room <= m:
            break
        m = room
    return k + 1 + m, m


def signatures(features: np.ndarray, band: int, percent: int) -> np.ndarray:
    """Signatures of one set (distinct feature hashes) in one band."""
    n1, m = parts_of(band, percent)
    salt = np.uint64((band * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    mixed = mix(features + salt)
    part = (mixed >> np.uint64(32)) % np.uint64(n1)
    counts = np.bincount(part.astype(np.int64), minlength=n1)
    order = np.argsort(part, kind="stable")
    sums = np.r_[np.uint64(0), np.cumsum(mix(mixed[order] + np.uint64(1)))]
    ends = np.cumsum(counts)
    content = mix((sums[ends] - sums[ends - counts]) ^ mix(np.arange(n1, dtype=np.uint64) + salt))
    strong = counts >= 2
    out = content[strong]
    weak = n1 - len(out)
    if weak > m:
        left = content[~strong]
        rank = np.lexsort((left, counts[~strong] == 0))  # empty parts come last
        out = np.r_[out, left[rank[: weak - m]]]
    return out


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of every text, ascending."""
    for _, _, data, offsets in chunks(column):
        low = LOWER[data]
        starts, ends, rows = word_bounds(low, offsets)
        h, at = shingle_hashes(span_hashes(low, starts, ends), rows, words)
        order = np.lexsort((h, at))
        h, at = h[order], at[order]
        keep = np.r_[True, (h[1:] != h[:-1]) | (at[1:] != at[:-1])] if len(h) else np.empty(0, bool)
        h, at = h[keep], at[keep]
        cuts = np.searchsorted(at, np.arange(len(offsets)))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield h[a:b]


def keyed_signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, key, sigs): the size, a 128-bit fingerprint and the signatures of each text's set; empty sets have no key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                sizes, keys, sigs = [], [], []
                for s in shingle_sets(part.column("text"), words):
                    sizes.append(len(s))
                    if not len(s):
                        keys.append(None)
                        sigs.append(np.empty(0, np.uint64))
                        continue
                    keys.append(int(np.sum(mix(s))).to_bytes(8, "big") + int(np.sum(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))).to_bytes(8, "big"))
                    least, own = band_of(np.array([-(-percent * len(s) // 100), len(s)]), percent)
                    sigs.append(np.concatenate([signatures(s, band, percent) for band in range(int(least), int(own) + 1)]))
                ends = np.r_[0, np.cumsum([len(x) for x in sigs])]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sigs).view(np.int64)))
                columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "key", "sigs"])

    return docs.mapInArrow(run, "doc_id long, n long, key binary, sigs array<bigint>")


#: A task folds so many signatures at a time.
FOLD = 1 << 20
#: Pairs a batch, each with both of its sets.
PAIRS = 500


def locally_folded(classes: DataFrame, hubs: bool) -> DataFrame:
    """(sig, id, hub): within each task, members of a signature point to the least of them, the local hub.

    With ``hubs`` the hubs themselves are given, else the other members.  Only hubs go on to meet other tasks' rows, so what one
    signature brings to a shuffle is bounded by the number of tasks.
    """

    def folded(sig: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((ids, sig))
        sig, ids = sig[order], ids[order]
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        at = np.repeat(first, np.diff(np.r_[first, len(sig)]))
        keep = (ids == ids[at]) == hubs
        if hubs:
            keep &= np.arange(len(sig)) == at
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (sig, ids, ids[at])], ["sig", "id", "hub"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                lists = part.column("sigs")
                count = np.diff(lists.offsets.to_numpy())
                sig = lists.flatten().to_numpy(zero_copy_only=False)
                held.append((sig, np.repeat(part.column("id").to_numpy(), count)))
                size += len(sig)
                if size >= FOLD:
                    yield folded(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
        if size:
            yield folded(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return classes.mapInArrow(run, "sig long, id long, hub long")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, features) of the documents in ``wanted`` (id), without empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sets = [s.tobytes() or None for s in shingle_sets(part.column("text"), words)]
                made = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["id", "features"])
                yield made.filter(made.column("features").is_valid())

    ids = wanted.select(F.col("id").alias("doc_id")).hint("shuffle_hash")
    return docs.join(ids, "doc_id", "left_semi").mapInArrow(run, "id long, features binary").dropDuplicates()


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, fa, fb): the feature sets of both sides of each pair."""
    left = sets.select(F.col("id").alias("a"), F.col("features").alias("fa"))
    right = sets.select(F.col("id").alias("b"), F.col("features").alias("fb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "fa", "fb")


def both_sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each pair: the sets, and which features of the first stand in the second."""
    last, held = None, np.empty(0, np.uint64)
    for x, y in zip(batch.column("fa"), batch.column("fb"), strict=True):
        raw = y.as_buffer()
        if last is None or not raw.equals(last):
            last, held = raw, np.frombuffer(raw, np.uint64)
        a = np.frombuffer(x.as_buffer(), np.uint64)
        yield a, held, held[np.minimum(np.searchsorted(held, a), len(held) - 1)] == a


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [100 * (n := int(met.sum())) >= percent * (len(a) + len(b) - n) for a, b, met in both_sets(batch)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return with_sets(pairs, sets).mapInArrow(run, "a long, b long")


def differences(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(hub, x, id, place, d, n): of each pair (a, hub b), the prefix of a's difference from the hub that any link must touch.

    Features the hub lacks come first, then those only the hub has, each by hash: one order for all members of a hub.  A set of n
    features links with nothing at a Hamming distance above ``B = n (1 - t) / t``, so a difference of d features overlaps any partner's
    in at least ``max(1, d - B)`` and the first ``min(d, B + 1)`` features suffice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hubs = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i, h, (a, b, met) in zip(ids, hubs, both_sets(batch), strict=True):
                lacking = b[a[np.minimum(np.searchsorted(a, b), len(a) - 1)] != b]
                x = np.r_[a[~met], lacking]
                d = len(x)
                x = x[: min(d, len(a) * (100 - percent) // percent + 1)]
                for c, v in zip(out, (np.full(len(x), h), x.view(np.int64), np.full(len(x), i), np.arange(len(x)), np.full(len(x), d), np.full(len(x), len(a))), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["hub", "x", "id", "place", "d", "n"])

    return with_sets(pairs, sets).mapInArrow(run, "hub long, x long, id long, place long, d long, n long")


def components(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    A document's set holds its distinct shingles of ``words`` lower-cased words; a shorter text's whole word sequence is its one
    shingle.  Documents link when ``100 * |intersection| >= percent * |union|``; ``component_id`` is the smallest doc_id
    reachable.  Texts that are null, empty or without words link with nothing and are their own component.  A doc_id that
    stands for several texts is one node with the links of all of them.  Rows with a null doc_id link with nothing new: they
    get the component of their set, or null.
    """
    base = texts(docs)
    keys = saved(keyed_signatures(base, words, percent))
    # one class per set; the smallest id stands for it
    heads = saved(keys.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id")))
    classes = keys.join(heads, ["key", "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), "n", "sigs")
    # hubs meet by signature; members take over the hub of their local hub
    met = locally_folded(classes, True).select("sig", "id").withColumn("lo", F.expr("min(id) over (partition by sig)")).withColumn("hi", F.expr("max(id) over (partition by sig)"))
    met = saved(met.where("lo <> hi").select("sig", "id", "lo"))
    least = met.select("sig", F.col("id").alias("hub"), "lo")
    members = locally_folded(classes, False).join(least, ["sig", "hub"], "left").select(F.col("id").alias("a"), F.coalesce("lo", "hub").alias("b"))
    star = saved(met.select(F.col("id").alias("a"), F.col("lo").alias("b")).union(members).where("a <> b").distinct())
    sizes = saved(keys.select("doc_id", "n", "key"))  # the signatures are most of what the rows hold
    drop(keys, met)
    wanted = star.select(F.col("a").alias("id")).union(star.select(F.col("b").alias("id"))).distinct()
    sets = saved(sets_of(base, wanted, words))
    with batches_of(docs.sparkSession, PAIRS):
        links = saved(verified(star, sets, percent))
    found = connected_components(links)
    # members of one hub in different components
    component = found.select(F.col("node").alias("a"), "component")
    placed = star.join(component, "a", "left").withColumn("component", F.coalesce("component", "a"))
    mixed = placed.groupBy("b").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("b")
    placed = saved(placed.join(mixed, "b", "left_semi"))
    drop(star)
    with batches_of(docs.sparkSession, PAIRS):
        parts = saved(differences(placed.select("a", "b"), sets, percent).join(placed.select(F.col("b").alias("hub"), F.col("a").alias("id"), "component"), ["hub", "id"]))
    other = parts.select("hub", "x", *(F.col(c).alias(f"{c}2") for c in ("id", "place", "d", "n", "component")))
    reach = f"{100 + percent} * 2 * (least(d - place, d2 - place2)) >= {100 + percent} * (d + d2) - {100 - percent} * (n + n2)"
    cross = saved(
        parts.join(other, ["hub", "x"])
        .where(F.expr(f"id > id2 and component <> component2 and 100 * least(n, n2) >= {percent} * greatest(n, n2) and {reach}"))
        .select(F.col("id").alias("a"), F.col("id2").alias("b"))
        .distinct()
    )
    drop(parts, placed)
    if not cross.isEmpty():
        with batches_of(docs.sparkSession, PAIRS):
            more = saved(verified(cross, sets, percent))
        drop(sets, cross, found)
        found = connected_components(links.unionByName(more))
        drop(links, more)
    else:
        drop(sets, cross, links)
    of_key = heads.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", F.coalesce("component", "doc_id").alias("component"))
    out = sizes.select("doc_id", F.col("n").alias("n_shingles"), "key").join(of_key, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its component's smallest, one row per doc_id, and all rows with a null doc_id."""
    kept = components(docs, words, percent).where("doc_id = component_id").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))

import bisect
import random
import time

import pytest
from pyspark.sql import functions as F

from veilwork.operators.catalog import PRECEDENCE
from veilwork.operators.merge import (
    drop_duplicate_chunks,
    requested_labels,
    resolve_chunks,
    resolve_findings,
)

SCHEMA = "doc_id bigint, sent_id int, begin int, end int, chunk string, entity string, detector string"
RANK = {pair: i for i, pair in enumerate(PRECEDENCE, 1)}


def chunk(doc, begin, end, entity="URL", detector=None):
    return (doc, 0, begin, end, "c", entity, detector or f"{entity}_chunks")


def brute_force(chunks):
    order = sorted(
        chunks, key=lambda c: (RANK.get((c[6], c[5]), len(RANK) + 1), c[2] - c[3], c[2], c[5], c[6], c[3])
    )
    taken = []
    for c in order:
        if all(c[3] <= t[2] or t[3] <= c[2] for t in taken):
            taken.append(c)
    covered = {p for c in chunks for p in range(c[2], c[3])}
    kept = {p for c in taken for p in range(c[2], c[3])}
    return sorted((c[2], c[3], c[5]) for c in taken), covered - kept


def on_rows(spark, chunks):
    frame = spark.createDataFrame(chunks, SCHEMA)
    fields = ["sent_id", "begin", "end", "chunk", "entity", "detector"]
    grouped = frame.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("f"))
    return grouped.select("doc_id", resolve_findings(F.col("f")).alias("resolved"))


def collect(resolved):
    out = {}
    for row in resolved.collect():
        kept, bare = out.setdefault(row.doc_id, ([], set()))
        kept += [(c.begin, c.end, c.entity) for c in row.resolved.kept]
        bare |= {p for s in row.resolved.residual for p in range(s.begin, s.end)}
    return {d: (sorted(k), b) for d, (k, b) in out.items()}


def test_chain_keeps_both_ends(spark):
    a, b, c = chunk(1, 0, 5, "SSN"), chunk(1, 4, 9, "ACCOUNT"), chunk(1, 8, 12, "LICENSE")
    kept, bare = collect(on_rows(spark, [a, b, c]))[1]
    assert kept == [(0, 5, "SSN"), (8, 12, "LICENSE")]
    assert bare == {5, 6, 7}


def test_adjacent_chunks_do_not_overlap(spark):
    kept, bare = collect(on_rows(spark, [chunk(1, 0, 5), chunk(1, 5, 9)]))[1]
    assert kept == [(0, 5, "URL"), (5, 9, "URL")] and not bare


@pytest.mark.parametrize("resolve", [on_rows, lambda s, c: resolve_chunks(s.createDataFrame(c, SCHEMA))])
def test_random_chunks_against_brute_force(spark, resolve):
    rng = random.Random(4)
    labels = ["SSN", "ACCOUNT", "LICENSE", "VIN", "URL"]
    chunks = []
    for doc in range(150):
        width = rng.choice([30, 80, 400])
        for _ in range(rng.randrange(1, 25)):
            begin = rng.randrange(width)
            chunks.append(chunk(doc, begin, begin + rng.randrange(1, 12), rng.choice(labels)))
    got = collect(resolve(spark, chunks))
    for doc, (kept, bare) in got.items():
        assert (kept, bare) == brute_force([c for c in chunks if c[0] == doc])


def test_one_document_with_most_findings_over_many_position_blocks(spark):
    rng = random.Random(5)
    chunks = [chunk(1, b, b + rng.randrange(1, 40), rng.choice(["SSN", "URL"])) for b in range(0, 200_000, 17)]
    # a run of overlapping findings across the border between two position blocks
    chunks += [chunk(1, b, b + 3000) for b in range(60_000, 70_000, 1000)]
    chunks += [chunk(2, 5, 9)]
    got = collect(resolve_chunks(spark.createDataFrame(chunks, SCHEMA).repartition(7)))
    for doc in (1, 2):
        assert got[doc] == brute_force([c for c in chunks if c[0] == doc])


def test_duplicates_keep_the_ranked_detector(spark):
    rows = [chunk(1, 0, 5, "AGE", "pattern_AGE"), chunk(1, 0, 5, "AGE"), chunk(1, 0, 5, "URL", "b"), chunk(1, 0, 5, "URL", "a")]
    got = drop_duplicate_chunks(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.entity, r.detector) for r in got) == [("AGE", "AGE_chunks"), ("URL", "a")]


def test_requested_labels():
    assert requested_labels(None) == ("AGE", "NAME", "SSN")
    assert requested_labels(["ID", "BIOID", "SPIRITUAL_BELIEFS"]) == ("IDNUM", "RELIGION")
    with pytest.raises(ValueError):
        requested_labels([])


def fast_greedy(chunks):
    """The same choice with a sorted list of taken spans: two neighbours decide."""
    order = sorted(chunks, key=lambda c: (RANK.get((c[6], c[5]), len(RANK) + 1), c[2] - c[3], c[2], c[5], c[6], c[3]))
    begins, taken = [], {}
    for c in order:
        at = bisect.bisect_left(begins, c[3])
        if at == 0 or taken[begins[at - 1]][3] <= c[2]:
            bisect.insort(begins, c[2])
            taken[c[2]] = c
    return sorted((c[2], c[3], c[5]) for c in taken.values())


@pytest.mark.parametrize("shape", ["chain", "growing", "nested", "wide", "random"])
def test_long_islands(spark, shape):
    rng = random.Random(shape)
    make = {
        "chain": lambda i: (i * 10, i * 10 + 11 + i % 5),
        "growing": lambda i: (i * 10, i * 10 + 11 + i // 20),
        "nested": lambda i: (i, 20_000 - i),
        "wide": lambda i: (i * 3, i * 3 + rng.randrange(1, 3_000)),
        "random": lambda i: (rng.randrange(9_000), 0),
    }[shape]
    chunks = []
    for i in range(3_000):
        begin, end = make(i)
        chunks.append(chunk(1, begin, max(end, begin + 1 + rng.randrange(40)), rng.choice(["URL", "SSN", "DATE"])))
    chunks += [chunk(2, 0, 9), chunk(2, 3, 5)]
    got = collect(on_rows(spark, chunks))
    for doc in (1, 2):
        assert got[doc] == brute_force([c for c in chunks if c[0] == doc])
        assert got[doc][0] == fast_greedy([c for c in chunks if c[0] == doc])


@pytest.mark.parametrize("on_row", [True, False])
def test_a_hundred_thousand_findings_in_one_island(spark, on_row):
    chunks = [chunk(1, i * 10, i * 10 + 11 + i * 7919 % 50) for i in range(100_000)]
    frame = spark.createDataFrame(chunks, SCHEMA)
    start = time.monotonic()
    got = collect(on_rows(spark, chunks)) if on_row else collect(resolve_chunks(frame.repartition(4)))
    assert time.monotonic() - start < 60
    assert got[1][0] == fast_greedy(chunks)

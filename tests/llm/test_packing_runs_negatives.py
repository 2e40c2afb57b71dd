"""Operators 11 to 13 against brute force and exact round trips."""

import bisect
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, frame, made_text, rng
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilwork.llm import best_fit_packing, hard_negatives, periodic_runs
from veilwork.llm.queries import ORACLE_SQL, QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, id string, part string"


# packing ------------------------------------------------------------------------------------------------------------


def uses(found, capacity):
    used = np.zeros(capacity + 1, np.int64)
    for times, lengths in found:
        assert times > 0 and sum(x * k for x, k in lengths) <= capacity
        for x, k in lengths:
            used[x] += times * k
    return used


def plain_best_fit(lengths, capacity):
    """Sequences that best fit on falling lengths opens."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, x)
        left = gaps.pop(at) if at < len(gaps) else capacity
        bisect.insort(gaps, left - x)
    return len(gaps)


@pytest.mark.parametrize("make", [lambda g: g.integers(1, 65, 700), lambda g: g.integers(20, 40, 300), lambda g: g.integers(1, 4, 500), lambda g: np.full(90, 33), lambda g: np.array([64, 1]), lambda g: np.empty(0, int)])
def test_patterns_use_every_piece_and_few_sequences(make):
    lengths = make(np.random.default_rng(5))
    counts = np.bincount(lengths, minlength=65)
    found = best_fit_packing.patterns(counts)
    assert (uses(found, 64) == counts).all()
    assert sum(t for t, _ in found) <= plain_best_fit(lengths, 64) + 1


def test_exact_fills_are_those_that_exist():
    r = random.Random(8)
    for _ in range(300):
        capacity = 30
        counts = np.array([0] + [r.choice([0, 0, 0, 1, 2]) for _ in range(capacity)])
        lengths = best_fit_packing._Lengths(counts)
        for _ in range(r.randint(0, 6)):
            have = np.flatnonzero(lengths.left)
            if len(have):
                lengths.take(int(r.choice(have)), 1)
                if r.random() < 0.4:
                    lengths.give(int(r.choice(have)))
        left = {x: int(n) for x, n in enumerate(lengths.left) if n}

        def fills(gap, k, left=left):
            bag = sorted(x for x, n in left.items() for _ in range(min(n, 3)))
            sums = {(): 0}
            for x in bag:
                sums |= {(*s, x): t + x for s, t in sums.items() if len(s) < k and t + x <= gap}
            return any(t == gap and len(s) == k for s, t in sums.items())

        for gap in range(1, capacity + 1):
            found = lengths.exact(gap)
            fewest = next((k for k in (1, 2, 3) if fills(gap, k)), 0)
            assert len(found) == fewest
            assert not found or sum(found) == gap and not Counter(found) - Counter(left)


def check_packing(rows, docs, out, capacity):
    """Pieces hold exactly the tokens of their documents; sequences are filled without gap or overlap."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            cut = ids[k : k + capacity]
            want[i, k // capacity, k, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in out) == want
    stands = defaultdict(list)
    for x in out:
        stands[x["sequence_id"]].append((x["offset"], x["length"]))
    for filled in stands.values():
        end = 0
        for offset, length in sorted(filled):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(stands) == list(range(len(stands)))
    assert len(stands) <= plain_best_fit([x["length"] for x in out], capacity) + 1


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_of_awkward_rows(spark, capacity):
    r = rng()
    rows = [(i, made_text(r, r.choice([1, 3, 10, 60, 300]))) for i in range(120)] + awkward(r)
    rows += [(7, "it's <|endoftext|>OK<|startoftext|> don't 12<|x"), (8, "ÀÉ ﬁ Ω x　y é ß'LL \x1c a\x85b"), (9, "﻿​ 👩‍👩‍👧 中文字 #!?")]
    rows += [(5, "copies of one row")] * 150
    out = best_fit_packing.pack(frame(spark, rows).repartition(4), capacity=capacity)
    found = out.collect()
    check_packing(rows, None, found, capacity)
    whole = {x["sequence_id"]: x["ids"] for x in best_fit_packing.sequences(out).collect()}
    for x in found:
        assert whole[x["sequence_id"]][x["offset"] : x["offset"] + x["length"]] == x["ids"]


def test_packing_query(spark, sf_dir):
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check_packing(rows, None, QUERIES["op11_best_fit_packing"](spark, sf_dir).collect(), 2048)


def test_units_encode_like_texts():
    """Texts of awkward characters, cut into units, give the ids of the whole text."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, r = Tokenizer.from_file(path), random.Random(12)
    parts = [*"abzAZ09.,'-<|>=#\"", " ", "\n", "'s", "'LL", "'Re", "n't", "é", "É", "\u0301", "\u0338", "—", "’", "’s", "٣", "½", "Ω", "Σ", "İ", "ß", "ǅ", "中", "😀", "\u200d", "\u00a0", "\u3000", "\x1c", "\x85", "\x00", "\x7f", "<|endoftext|>", "<|", "don't", "12", "ab", "...'s"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 30))) for _ in range(4_000)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]
    ids, totals = best_fit_packing._token_ids(best_fit_packing._Vocabulary(path), data, offsets)
    ends = np.cumsum(totals)
    for text, end, n in zip(texts, ends, totals, strict=True):
        assert ids[end - n : end].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0], text


def test_packing_of_no_rows(spark):
    assert best_fit_packing.pack(frame(spark, [])).collect() == []


# periodic runs ------------------------------------------------------------------------------------------------------


def brute_runs(words, least):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)  # periods come smallest first
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]  # bytes: ASCII white space only


def periodic_word_lists(r, n):
    out = [["a"] * k for k in (0, 1, 11, 12, 13, 40)]
    a, b = ["a"], ["a", "b"]
    while len(b) < 150:
        a, b = b, b + a
    out.append(b)
    for _ in range(n):
        k = r.choice([1, 2, 2, 3, 5, 30])
        words = [f"w{r.randrange(k)}" for _ in range(r.randint(0, 50))]
        for _ in range(r.randint(0, 3)):
            unit = [f"w{r.randrange(k)}" for _ in range(r.randint(1, 14))] * r.randint(1, 2)
            at = r.randint(0, len(words))
            words[at:at] = (unit * 7)[: r.randint(1, 6 * len(unit))]
        out.append(words)
    return out


@pytest.mark.parametrize("least", [2, 4, 12])
def test_runs_equal_brute_force(least):
    for words in periodic_word_lists(random.Random(least), 500):
        names = {w: i for i, w in enumerate(words)}
        start, end, period = periodic_runs.find_runs(np.array([names[w] for w in words], np.int64), least)
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True)) == brute_runs(words, least)


def test_runs_of_rows(spark):
    r = rng()
    rows = [(i, r.choice([" ", "\n", " \t\r"]).join(w)) for i, w in enumerate(periodic_word_lists(r, 200))]
    rows += [(i, t) for i, t in awkward(r) if i != 903] + [(5, "é ü " * 30), (5, "é ü " * 30), (6, "x y " * 20)]
    out = periodic_runs.detect(frame(spark, rows).repartition(3)).collect()
    want = Counter()
    for i, t in rows:
        runs = brute_runs(split(t), 12)
        want[i, len(split(t)), tuple(runs), brute_collapsed(split(t), runs)] += 1
    assert Counter((x["doc_id"], x["n_words"], tuple((y["start"], y["length"], y["period"]) for y in x["runs"]), x["collapsed"]) for x in out) == want
    assert periodic_runs.detect(frame(spark, [])).collect() == []


def test_long_periodic_texts_end_soon(spark):
    unit = [f"w{i}" for i in range(50_000)]
    rows = [(1, "a " * 400_000), (2, " ".join(unit * 4)), (3, "a b a " * 100_000)]
    out = {x["doc_id"]: x for x in periodic_runs.detect(frame(spark, rows)).collect()}
    assert [tuple(y) for y in out[1]["runs"]] == [(0, 400_000, 1)] and out[1]["collapsed"] == "a"
    assert [tuple(y) for y in out[2]["runs"]] == [(0, 200_000, 50_000)] and out[2]["collapsed"] == " ".join(unit)
    assert [tuple(y) for y in out[3]["runs"]] == [(0, 300_000, 3)] and out[3]["collapsed"] == "a b a"


def test_periodic_query(spark, sf_dir):
    out = {x["doc_id"]: x for x in QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(rows)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    n_planted = 0
    for x in rows:
        words, h = split(x["text"]), zlib.crc32(str(x["doc_id"]).encode())
        n, g = len(words), h // 10
        planted = h % 10 == 0 and n > 0
        n_planted += planted
        if planted:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        got = out[x["doc_id"]]
        if n > 3000 and not planted:
            assert got["collapsed_sha256"]  # brute force is quadratic
            continue
        runs = brute_runs(words, 12)
        best = min(runs, key=lambda y: (-y[1], y[0], y[2]), default=None)
        assert got["n_runs"] == len(runs)
        assert (got["start"], got["length"], got["period"]) == (best or (None,) * 3)
        assert got["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert got["runs_sha256"] == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert got["collapsed_sha256"] == sha(brute_collapsed(words, runs))
    assert n_planted > 5


def test_periodic_query_equals_its_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cursor = db.execute(ORACLE_SQL["op12_periodic_runs"])
    names = [d[0] for d in cursor.description]
    got = QUERIES["op12_periodic_runs"](spark, sf_dir).select(names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, cursor.fetchall()))


# hard negatives -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("dims", "largest"), [(64, 130), (8, 1), (5, 70_000), (13, 1 << 26)])
def test_table_scores_are_inner_products(dims, largest):
    g = np.random.default_rng(dims)
    c, a = g.integers(-largest, largest, (40, dims)), g.integers(-largest, largest, (9, dims))
    got = hard_negatives.scores(hard_negatives.subset_sums(a, np.int64), hard_negatives.bit_planes(c))
    assert (got == c @ a.T).all()


def brute_negatives(rows, n_positives=5, n_negatives=10, low=30, high=90):
    """``rows``: (id, label, whole numbers) as they take part."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for key in {(i, lab, tuple(v)) for i, lab, v in rows if i % 100 == 0}:
        i, lab, v = key
        scored = sorted((-dot(v, w), j, m == lab) for j, m, w in rows if j != i)
        every = sorted((-dot(v, w), j) for j, m, w in rows if m != lab)
        for s, j, _ in [x for x in scored if x[2]][:n_positives]:
            fits = [(t, k) for t, k in every if low * -s <= 100 * -t <= high * -s]
            out += [(i, j, rank + 1, k, -s, -t) for rank, (t, k) in enumerate(fits[:n_negatives])]
    return sorted(out)


def quantised_rows(rows):
    out = []
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        lab = (lab + 1) % 10 if i % 7 == 0 else lab
        out.append((i, lab, [math.floor(256 * float(np.float32(x))) for x in v]))
    return out


def mined(spark, rows):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)
    vectors = hard_negatives.quantised(table.repartition(3), F.col("vec_id"), label, F.col("embedding"))
    return sorted(tuple(x) for x in hard_negatives.mine(vectors, F.col("id") % 100 == 0).collect())


def test_mining_equals_brute_force(spark, monkeypatch):
    g = np.random.default_rng(2)
    rows = [(i, (g.normal(size=12) * 0.3).astype(np.float32).tolist(), int(g.integers(0, 3))) for i in range(900)]
    rows += [(1000 + i, [0.5] * 12, i % 4) for i in range(300)]  # one vector holds a quarter of all rows: ties
    rows += [(2000, None, 1), (2100, [0.1, None], 1), (2200, [0.1, float("nan")], 1), (2300, [float("inf")], 2), (None, [0.2] * 12, 1), (2400, [0.2] * 12, None)]
    rows += [(2500, [], 1), (2600, [0.7], 2), (2700, [-0.9] * 12, 9), (2701, [1.0] * 12, 9)]
    want = brute_negatives(quantised_rows(rows))
    monkeypatch.setattr(hard_negatives, "LEAST_PART_ROWS", 100)  # several parts, several blocks
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 4)
    monkeypatch.setattr(hard_negatives, "SLICE_ROWS", 37)
    assert mined(spark, rows) == want and len(want) > 300


def test_mining_of_repeated_rows(spark):
    g = np.random.default_rng(6)
    rows = [(i, g.normal(size=9).tolist(), int(g.integers(0, 2))) for i in (*range(0, 400, 3), *range(0, 400, 3))]
    rows += [rows[0]] * 3
    assert mined(spark, rows) == brute_negatives(quantised_rows(rows))


def test_mining_of_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.1], 1), (2, [0.2], 2)]) == []


def test_mining_query(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = db.execute(ORACLE_SQL["op13_hard_negatives"]).df()
    got = QUERIES["op13_hard_negatives"](spark, sf_dir).toPandas()
    assert sorted(map(tuple, got[want.columns].to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))
    assert len(got) > 50

import itertools
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, frame, made_text, rng, words

from veilwork.llm import common, hidden_markov, linear, quality_classifier, quality_rules, sentencepiece_lattice, toxicity


def test_words_and_hashes_are_those_of_bytes():
    texts = ["", "a  B\tc\n", "Ünï x y", "one", "b c A", "\x1c z"]
    for limit in (1, 6, 1000):
        got = []
        for _, _, data, offsets in common.chunks(pa.array(texts), limit):
            s, e, r = common.word_bounds(data, offsets)
            low = common.LOWER[data]
            got += [bytes(low[a:b]) for a, b in zip(s, e, strict=True)]
        assert got == [w for t in texts for w in words(t)]
    data, offsets = common.text_bytes(pa.array(["ab ab xab"]))
    s, e, _ = common.word_bounds(data, offsets)
    h = common.span_hashes(data, s, e)
    assert h[0] == h[1] != h[2]


def test_sampling_follows_the_exact_path_distribution():
    model = sentencepiece_lattice.lattices(sentencepiece_lattice.default_model(), 2.0)
    word = " thing"
    paths = {}

    def walk(at, ids, weight):
        if at == len(word):
            paths[tuple(ids)] = weight
        for end in range(at + 1, len(word) + 1):
            i = model.pieces.get(word[at:end])
            if i is not None:
                walk(end, [*ids, i], weight * model.weight[i])

    walk(0, [], 1.0)
    total, n = sum(paths.values()), 40_000
    seen = Counter(tuple(x.tolist()) for x in model.encode(list(range(n)), ["thing"] * n, 5))
    assert set(seen) <= set(paths)
    for p, w in paths.items():
        share = w / total
        assert abs(seen[p] / n - share) < 5 * math.sqrt(share / n) + 1e-4


@pytest.mark.parametrize("text", ["", " ", "a▁b  c\n\n x", "\x00", "😀" * 40 + "é", "x" * 3000, " " * 50, "a\x00", "tail ", "\n"])
def test_pieces_decode_to_the_text(text):
    model = sentencepiece_lattice.lattices(sentencepiece_lattice.default_model(), 2.0)
    for seed in range(5):
        assert model.decode(model.encode([seed], [text], 1)[0].tolist()) == text


def test_long_and_grouped_words_have_equal_lattices():
    model = sentencepiece_lattice.Lattices(sentencepiece_lattice.default_model(), 2.0)
    w = " inthandble"
    a = int(model.add_group([w])[0])
    split = model.size
    model.add_long(w)
    assert a == len(w)
    one, two = model.share[:split], model.share[split : model.size]
    assert sorted(model.ids[:split]) == sorted(model.ids[split : model.size]) and len(one) == len(two)


def test_encoding_does_not_depend_on_the_partitioning(spark):
    r = rng()
    docs = frame(spark, [(i, made_text(r, 30)) for i in range(40)] + awkward(r))
    one = {(x["doc_id"], x["n_pieces"], tuple(x["ids"])) for x in sentencepiece_lattice.encode(docs.coalesce(1)).collect()}
    out = sentencepiece_lattice.encode(docs.repartition(7)).collect()
    assert one == {(x["doc_id"], x["n_pieces"], tuple(x["ids"])) for x in out}
    assert all(x["round_trip"] for x in out) and len(out) == 50
    again = {x["doc_id"]: x["text"] for x in sentencepiece_lattice.decode(sentencepiece_lattice.encode(docs).where("doc_id is not null")).collect()}
    assert again == {i: t or "" for i, t in docs.where("doc_id is not null").select("doc_id", "text").collect()}
    assert sentencepiece_lattice.encode(docs.limit(0)).count() == 0


def labelled(spark, r, n=240):
    """Good prose, and bad rows with symbols behind every word; some prose carries an insult."""
    rows, marks = [], []
    for i in range(n):
        text, good, toxic = made_text(r, 60), int(i % 4 != 0), int(i % 3 == 0)
        if toxic:
            w = text.split()
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["wretchling", "blockhead", "vermin"]))
            text = " ".join(w)
        rows.append((i, text if good else text.replace(" ", "$$ ")))
        marks.append((i, good, toxic))
    marks += [(None, 1, 1), (n + 5, None, None), (0, marks[0][1], marks[0][2])]
    return frame(spark, rows + awkward(r)), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), {i: (g, t) for i, g, t in marks if i is not None}


def test_quality_and_toxicity_on_rows_held_out(spark):
    docs, labels, truth = labelled(spark, rng())
    for made, column, folds, number in ((quality_classifier.classify, 0, 5, 0), (toxicity.classify, 1, 3, 1)):
        out = made(docs, labels).collect()
        assert len(out) == docs.count()
        held = [x for x in out if x["held_out"]]
        assert all((zlib.crc32(str(x["doc_id"]).encode()) % folds == number) == x["held_out"] for x in out if x["doc_id"] is not None)
        right = [x["predicted"] == truth[x["doc_id"]][column] for x in held if x["doc_id"] in truth and truth[x["doc_id"]][column] is not None]
        assert len(right) > 20 and sum(right) >= 0.9 * len(right)
        assert all(0 <= x["score"] <= 1 for x in out)
    kept = toxicity.clean(docs, toxicity.fit(docs, labels))
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in out if x["predicted"] == 0} == {x["doc_id"] for x in kept.collect()}


def test_toxic_wording_of_a_small_language_on_rows_held_out(spark):
    """Two groups of texts with toxic wording of their own; ordinary texts of the small group hold its wording now and then."""
    r, rows, truth = rng(), [], {}
    for i in range(2400):
        small, toxic = i % 12 == 0, r.random() < 0.25
        w = [x.translate(str.maketrans("aeiou", "ouiae")) if small else x for x in made_text(r, 60).split()]
        for _ in range(5 if toxic else int(small and r.random() < 0.15)):
            w.insert(r.randrange(len(w)), "zzornwicht" if small else r.choice(["wretchling", "blockhead", "vermin"]))
        rows.append((i, " ".join(w)))
        truth[i] = (small, toxic)
    labels = spark.createDataFrame([(i, 1, int(t)) for i, (_, t) in truth.items()], "doc_id long, quality int, toxic int")
    held = [(x["predicted"], *truth[x["doc_id"]]) for x in toxicity.classify(frame(spark, rows), labels).collect() if x["held_out"]]
    for group in (True, False):
        found = [p for p, small, toxic in held if small == group and toxic]
        assert len(found) >= 10 and sum(found) >= 0.8 * len(found)
    ordinary = [p for p, _, toxic in held if not toxic]
    assert sum(ordinary) <= 0.02 * len(ordinary)


def test_classifiers_without_labels(spark):
    docs, labels, _ = labelled(spark, rng(), 12)
    none = labels.limit(0)
    assert {x["score"] for x in quality_classifier.classify(docs, none).collect()} == {0.5}
    assert {round(x["score"], 6) for x in toxicity.classify(docs, none).collect()} == {0.5}
    assert quality_rules.judge(docs, quality_rules.fit(docs, none)).count() == docs.count()
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0
    one = labels.where("quality = 1")
    assert quality_classifier.classify(docs, one).count() == docs.count()


def test_leader_updates_match_the_definition():
    rows = [(np.array([1, 5]), np.array([0.5, 1.0])), (np.array([5]), np.array([2.0]))]
    w = linear.ftrl(rows, np.array([1.0, 0.0]), 2, 0.7, 0.01, 0.1)
    z, n = Counter(), Counter()
    weight = lambda i: 0.0 if abs(z[i]) <= 0.01 else -(z[i] - math.copysign(0.01, z[i])) / ((1 + math.sqrt(n[i])) / 0.7 + 0.1)
    for _ in range(2):
        for x, y in (({1: 0.5, 5: 1.0, linear.BUCKETS: 1.0}, 1), ({5: 2.0, linear.BUCKETS: 1.0}, 0)):
            own = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(own[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.7 * own[i]
                n[i] += g * g
    for i in (1, 5, linear.BUCKETS):
        assert w[i] == pytest.approx(weight(i))


def test_base_counts_of_the_quality_rules(spark):
    r = random.Random(1)
    texts = [" ".join(r.choices("a b c dd é".split(), k=r.randint(0, 60))) for _ in range(200)] + ["", None, "a\nb\na\n\n \na", "#x *$%&|<> y", "x " * 7, "a b c d e f g h " * 3]

    def brute(t):
        t = t or ""
        w = [x.decode() for x in t.encode().split()]
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines, dup, old = t.split("\n"), 0, set()
        for x in lines:
            if x.encode().split():
                dup += x in old
                old.add(x)
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered))

    c = quality_rules.base_counts(pa.array(texts))
    assert [tuple(int(v) for v in row) for row in zip(*c.values(), strict=True)] == [brute(t) for t in texts]
    docs = frame(spark, list(enumerate(texts)))
    out = quality_rules.judge(docs, (np.zeros(linear.BUCKETS + 1), 1.0, 0.0)).collect()
    for x in out:
        n, _, _, _, rep = brute(texts[x["doc_id"]])
        assert x["base_failed"] == (n < 20 or 100 * rep > 30 * n) and x["kept"] == (not x["base_failed"])


def test_calibration_recovers_a_slope():
    g = np.random.default_rng(1)
    m = g.normal(0, 2, 20_000)
    y = (g.random(20_000) < linear.sigmoid(0.6 * m - 0.4)).astype(float)
    a, b = quality_rules.platt(m, y)
    assert abs(a - 0.6) < 0.05 and abs(b + 0.4) < 0.05


def test_recursions_equal_sums_over_all_paths():
    g = np.random.default_rng(0)
    p = hidden_markov.Parameters(g.dirichlet(np.ones(3)), g.dirichlet(np.ones(3), 3), g.dirichlet(np.ones(7), 3).T.copy())
    rows = sorted([g.integers(0, 7, n).astype(np.int32) for n in (6, 1, 4, 4, 2)], key=len, reverse=True)
    counts, want = hidden_markov.zeros(p), hidden_markov.zeros(p)
    got = hidden_markov.sweep(rows, p, counts)
    for r, score in zip(rows, got, strict=True):
        total, own = 0.0, hidden_markov.zeros(p)
        for path in itertools.product(range(3), repeat=len(r)):
            q = p.start[path[0]] * p.emit[r[0], path[0]]
            for i in range(1, len(r)):
                q *= p.move[path[i - 1], path[i]] * p.emit[r[i], path[i]]
            total += q
            own[0][path[0]] += q
            for i in range(len(r)):
                own[2][r[i], path[i]] += q
                if i:
                    own[1][path[i - 1], path[i]] += q
        assert score == pytest.approx(math.log10(total))
        for a, b in zip(want, own, strict=True):
            a += b / total
    assert all(np.allclose(a, b) for a, b in zip(want, counts, strict=True))


def test_language_model_scores(spark):
    r = rng()
    rows = [(i, made_text(r, 25)) for i in range(120)] + awkward(r)
    docs = frame(spark, rows)
    out = hidden_markov.score(docs, states=3, max_frequent=20).collect()
    assert len(out) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    seen = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    n, v = sum(seen.values()), len(seen)
    texts = {i: t for i, t in rows if i is not None}
    for x in out:
        assert x["train_tokens"] == n
        if x["doc_id"] is not None:
            own = [*words(texts[x["doc_id"]]), None]
            assert (x["held_out"], x["n_tokens"], x["n_known"]) == (held(x["doc_id"]), len(own), sum(w in seen for w in own))
            assert x["base_score"] == pytest.approx(sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
            assert x["score"] < 0
    assert hidden_markov.score(docs.limit(0)).count() == 0


def test_symbol_probabilities_sum_to_one():
    vocab = hidden_markov.Vocabulary(np.array([3, 9]), np.array([5, 4]), np.full(hidden_markov.RARE_CLASSES, 3.0), np.full(hidden_markov.RARE_CLASSES, 2.0), 4, 4)
    p = hidden_markov.initial(vocab.share(), 4)
    assert np.allclose(p.emit.sum(axis=0), 1) and np.allclose(p.move.sum(axis=1), 1)
    # within a class: two words of counts 1 and 2, and the slot for words never seen
    assert sum((c + 0.5) / 10 ** vocab.class_logs()[2] for c in (1, 2, 0)) == pytest.approx(1)


def test_language_model_learns_from_every_training_text(spark):
    """No part of the training texts is picked by id: the same texts under other ids of the training fold give the same model."""
    r = rng()
    made = [made_text(r, 8) for _ in range(1300)]
    free = (i for i in range(10**6) if zlib.crc32(str(i).encode()) % 5 != 1)
    totals = []
    for _ in range(2):
        docs = frame(spark, [(next(free), t) for t in made]).coalesce(1)
        got = hidden_markov.score(docs, states=3, max_frequent=50).collect()
        assert not any(x["held_out"] for x in got)
        totals.append(sum(x["score"] for x in got))
    assert totals[0] == pytest.approx(totals[1], rel=1e-6)


def test_dictionaries_take_no_memory_for_wording_of_ordinary_texts_alone():
    r = np.random.default_rng(4)
    ordinary = [r.integers(97, 123, 60_000, dtype=np.uint8).tobytes() for _ in range(40)]
    toxic = [f"words such as vile filth number {i}".encode() for i in range(40)]
    tracemalloc.start()
    toxicity.train_dictionaries(ordinary + toxic, np.arange(80) >= 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    grams, often = toxicity.document_counts(toxic + [b" " + t[:300] + t[:300] for t in ordinary[:5]])
    assert (toxicity.counts_of(grams, toxic + [b" " + t[:300] + t[:300] for t in ordinary[:5]]) == often).all()
    assert toxicity.counts_of(grams[:0], toxic).shape == (0, often.shape[1])

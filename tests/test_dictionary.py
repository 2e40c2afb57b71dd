"""The dictionary join against a plain look-up, and what its bitmap lets through."""

import random

import pytest
from pyspark.sql import functions as F

from veilwork.operators import dictionary as d

WORDS = [f"w{i}" for i in range(400)]


def made(spark, n_docs, n_phrases, seed):
    r = random.Random(seed)
    texts = [(i, " ".join(r.choices(WORDS, k=r.randint(0, 60)))) for i in range(n_docs)]
    phrases = sorted({" ".join(r.choices(WORDS, k=r.choice([1, 1, 2, 3]))) for _ in range(n_phrases)})
    dictionary = spark.createDataFrame([(f"E{len(p) % 3}", p) for p in phrases], "entity string, phrase string")
    return texts, phrases, spark.createDataFrame(texts + [(-1, None), (-2, "")], "doc_id long, text string"), dictionary


@pytest.mark.parametrize("n_phrases", [0, 1, 60, 3000])
def test_join_equals_plain_look_up(spark, n_phrases):
    texts, phrases, docs, dictionary = made(spark, 150, n_phrases, n_phrases)
    want, known = [], set(phrases)
    for i, text in texts:
        words, at = text.split(), 0
        starts = []
        for w in words:
            starts.append(at)
            at += len(w) + 1
        for k in range(len(words)):
            for n in (1, 2, 3):
                phrase = " ".join(words[k : k + n])
                if k + n <= len(words) and phrase in known:
                    want.append((i, starts[k], starts[k] + len(phrase), phrase))
    got = d.dictionary_chunks(docs, dictionary).select("doc_id", "begin", "end", "chunk").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_only_survivors_leave_the_scan(spark):
    """Nearly all n-grams are gone before the first exchange, no true one is."""
    _, _, docs, dictionary = made(spark, 400, 200, 7)
    phrases = d.phrase_table(dictionary).persist()
    survivors = d.candidate_grams(docs, phrases)
    every = docs.select("doc_id", F.inline_outer(d._grams_with_text(F.col("text"), 3))).where("phrase is not null")
    true = every.join(phrases, "phrase").count()
    assert survivors.join(phrases, "phrase").count() == true
    assert true <= survivors.count() <= true + every.count() * 0.03
    plan = survivors._jdf.queryExecution().executedPlan().toString()
    above = plan.split("Subqueries")[0]
    assert "getbit" in above and "Exchange" not in above.split("getbit")[0]
    phrases.unpersist()


def test_bitmap_grows_to_a_bound(spark):
    one = spark.createDataFrame([("a",)], "phrase string")
    assert d.membership_bits(one, 1)[1] == 1 << d.LEAST_BITS
    assert d.membership_bits(one, 1_000_000)[1] == 1 << 24
    assert d.membership_bits(one, 10**12)[1] == 1 << d.MOST_BITS


def test_bitmap_has_no_false_negative(spark):
    phrases = spark.range(20_000).select(F.concat(F.lit("p"), "id").alias("phrase"))
    words, bits = d.membership_bits(phrases, 20_000)
    assert phrases.where(d._may_hold(words, F.col("phrase"), bits)).count() == 20_000
    others = spark.range(20_000).select(F.concat(F.lit("q"), "id").alias("phrase"))
    assert others.where(d._may_hold(words, F.col("phrase"), bits)).count() < 600

import random

from pyspark.sql import functions as F

from veilwork.functions.arrays import block_substring, exclusive_scan, running_starts, text_blocks
from veilwork.functions.text import clean_text, ngrams, sentence_counter, sentences, tokens


def one(frame):
    return frame.collect()[0][0]


def test_scans_over_block_borders(spark):
    rng = random.Random(1)
    lists = [[rng.randrange(50) for _ in range(n)] for n in (1, 2, 127, 128, 129, 256, 257, 1000)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<int>")
    top = exclusive_scan(F.col("v"), F.lit(-1), lambda a, b: F.greatest(a, b))
    for row in frame.select("i", running_starts(F.col("v")).alias("s"), top.alias("m")).collect():
        values = lists[row.i]
        assert row.s == [sum(values[:k]) for k in range(len(values))]
        assert row.m == [max([-1] + values[:k]) for k in range(len(values))]


def test_block_substring_counts_code_points(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("aé🦆ß\n z") for _ in range(2100))
    spans = [(0, 0), (0, 1), (511, 513), (512, 1024), (0, 2100), (2099, 2100)] + [
        tuple(sorted((rng.randrange(2100), rng.randrange(2100)))) for _ in range(30)
    ]
    frame = spark.createDataFrame([(text, b, e) for b, e in spans], "text string, b int, e int")
    got = frame.select("b", "e", block_substring(text_blocks(F.col("text")), F.col("b"), F.col("e")).alias("s"))
    for row in got.collect():
        assert row.s == text[row.b : row.e]


def test_sentences_cover_the_text(spark):
    text = "Ünder 🦆 one. Two!  Three?\n\n  Four... five\x01six. "
    rows = one(spark.createDataFrame([(text,)], "text string").select(sentences(clean_text(F.col("text")))))
    assert "".join(r.sentence for r in rows) == text.replace("\x01", " ")
    assert [r.sentence for r in rows] == ["Ünder 🦆 one. ", "Two!  ", "Three?\n\n  ", "Four... ", "five six. "]
    assert [(r.begin, r.end) for r in rows] == [(0, 13), (13, 19), (19, 29), (29, 37), (37, 47)]
    assert [r.sent_id for r in rows] == list(range(5))


def test_null_and_empty_texts(spark):
    frame = spark.createDataFrame([(None,), ("",)], "text string")
    assert [r[0] for r in frame.select(sentences(clean_text(F.col("text")))).collect()] == [None, []]
    assert [r[0] for r in frame.select(tokens(F.col("text"))).collect()] == [[], []]


def test_tokens_are_trimmed_with_offsets(spark):
    rows = one(spark.createDataFrame([("(Hello), wörld!! ... x\ty",)], "s string").select(tokens(F.col("s"))))
    assert [(r.begin, r.end, r.token) for r in rows] == [(1, 6, "Hello"), (9, 14, "wörld"), (21, 22, "x"), (23, 24, "y")]


def test_ngrams(spark):
    rows = one(spark.createDataFrame([("New York, NY",)], "s string").select(ngrams(tokens(F.col("s")), 5)))
    assert [(r.token_id, r.n, r.begin, r.end, r.phrase) for r in rows] == [
        (0, 1, 0, 3, "new"), (1, 1, 4, 8, "york"), (2, 1, 10, 12, "ny"),
        (0, 2, 0, 8, "new york"), (1, 2, 4, 12, "york ny"), (0, 3, 0, 12, "new york ny"),
    ]


def test_sentence_number_of_any_offset(spark):
    text = "ab. " * 700
    offsets = spark.range(0, 2800, 7).select(F.lit(text).alias("t"), F.col("id").cast("int").alias("o"))
    number = sentence_counter(F.col("t"))(lambda lookup: lookup(F.col("o")))
    for row in offsets.select("o", number.alias("n")).collect():
        assert row.n == row.o // 4

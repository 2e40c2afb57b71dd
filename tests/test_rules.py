import dataclasses
import random
import re

import pytest
from pyspark.sql import functions as F

from veilwork import fixtures as fx
from veilwork.operators import catalog, rules
from veilwork.operators.catalog import CONTEXT_RULES, CONTEXT_RULES_BY_ENTITY, PATTERN_RULES
from veilwork.operators.rules import Rule, prefix_regex, rule_findings, suffix_regex


def find(spark, text, rules=CONTEXT_RULES):
    rows = spark.createDataFrame([(text,)], "text string").select(rule_findings(F.col("text"), rules)).collect()
    return None if rows[0][0] is None else [(f.entity, f.begin, f.end, f.chunk) for f in rows[0][0]]


HITS = [
    ("SSN: 123-45-6789.", "SSN", "123-45-6789"),
    ("ss#123456789", None, None),
    ("ss# 123456789", "SSN", "123456789"),
    ("Social security 123 and 123456789", "SSN", "123456789"),
    ("Routing 021000021", "ACCOUNT", "021000021"),
    ("LIC# A1B2", "LICENSE", "A1B2"),
    ("A1B2 licence", "LICENSE", "A1B2"),
    ("lIC A1B2", None, None),
    ("VIN 1abcd12efgh123456", "VIN", "1abcd12efgh123456"),
    ("VIN no. is 1ABCD12EFGH123456", None, None),
    ("a 45-year-old man", "AGE", "45"),
    ("aged 2 1/2 years old", "AGE", "2 1/2"),
    ("1000-years-old", None, None),
    ("phone (200) 555-0000", "PHONE", "(200) 555-0000"),
    ("call\n(200)555-0000", "PHONE", "(200)555-0000"),
    ("call 1 (200) 555-0000", None, None),
    ("call (200) 555-00001", None, None),
    ("CVS/PHARMACY #12345", "IDNUM", "12345"),
    ("CVS/PHARMACY #123", None, None),
    ("Texas 75001", "ZIP", "75001"),
    ("TEXAS, 75001-1234", "ZIP", "75001-1234"),
    ("texas 75001", None, None),
    ("ICU Admission: 12345", "MEDICALRECORD", "12345"),
    ("ICU 12345", None, None),
    ('mail "odd name"@x.example', None, None),
    ('mail "odd\\"name"@x.example.com', "EMAIL", '"odd\\"name"@x.example.com'),
    ("mail j@[127.0.0.1]", "EMAIL", "j@[127.0.0.1]"),
    ("E-Mail: o'x@y.example.com", "EMAIL", "o'x@y.example.com"),
    # a word in the neighbouring sentence, and inside a longer word
    ("My SSN. 123-45-6789", None, None),
    ("My SSN\n123-45-6789", None, None),
    ("classn 123-45-6789", None, None),
    # offsets behind accents and an emoji
    ("é🦆ß SSN 123-45-6789", "SSN", "123-45-6789"),
]


@pytest.mark.parametrize("case", range(0, len(HITS), 8))
def test_hits_and_decoys(spark, case):
    cases = HITS[case : case + 8]
    frame = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, text string")
    rows = frame.select("i", "text", rule_findings(F.col("text"), CONTEXT_RULES).alias("f")).collect()
    for row in rows:
        text, entity, chunk = cases[row.i]
        for f in row.f:
            assert text[f.begin : f.end] == f.chunk
        if entity is None:
            assert row.f == [], text
        else:
            assert (entity, chunk) in [(f.entity, f.chunk) for f in row.f], text


def test_distance_limit(spark):
    rule = Rule("X", "^9$", prefix=("key",), context_length=5)
    assert find(spark, "key    . 9 9", [rule]) == []
    assert [f[1] for f in find(spark, "key     9", [rule])] == [8]
    assert find(spark, "key      9", [rule]) == []


def test_long_texts_take_the_block_path(spark):
    filler = "Nothing here at all. " * 60
    text = filler + "SSN: 123-45-6789. " + filler + "a 45-year-old. " + filler + "call (200) 555-0000"
    found = sorted(find(spark, text), key=lambda f: f[1])
    assert [(e, c) for e, _, _, c in found] == [
        ("SSN", "123-45-6789"), ("AGE", "45"), ("PHONE", "(200) 555-0000"),
    ]
    assert all(text[b:e] == c for _, b, e, c in found)


def test_null_empty_and_plain(spark):
    assert find(spark, None) is None
    assert find(spark, "") == []
    assert find(spark, "no digits") == []
    assert find(spark, "\x01\x02 SSN 123-45-6789\x02") == [("SSN", 7, 18, "123-45-6789")]


def test_both_sides(spark):
    options = dict(prefix=("a",), suffix=("b",), context_length=3, signal=True)
    both = Rule("X", "^1$", prefix_and_suffix=True, **options)
    either = Rule("X", "^1$", **options)
    for text, n_both, n_either in (("a 1 b", 1, 1), ("a 1 c", 0, 1), ("c 1 b", 0, 1), ("c 1 c", 0, 0)):
        assert len(find(spark, text, [both])) == n_both
        assert len(find(spark, text, [either])) == n_either


def test_bad_rules_are_refused():
    with pytest.raises(ValueError):
        Rule("X", "1", prefix=("a",))
    with pytest.raises(ValueError):
        Rule("X", "1", rule_scope="page")


def test_context_regexes_agree_with_their_definition():
    rng = random.Random(3)
    for _ in range(400):
        gap = "".join(rng.choice("a .-9") for _ in range(rng.randrange(9)))
        lead = rng.choice(["", " ", "x", "-"])
        text = lead + "key" + gap
        expected = any(
            text[i : i + 3] == "key"
            and (i == 0 or not text[i - 1].isalnum())
            and len(text) - i - 3 <= 5
            and (i + 3 == len(text) or not text[i + 3].isalnum())
            for i in range(len(text))
        )
        assert bool(re.search("(?s)" + prefix_regex(["key"], 5), text)) == expected
        mirrored = text[::-1]
        assert bool(re.search("(?s)" + suffix_regex(["yek"], 5), mirrored)) == expected


def test_expected_chunks_of_one_note_per_variant(spark, sf_dir):
    notes = {r.note_id: r.text for r in fx.notes(spark, sf_dir).filter("note_id < 4").collect()}
    names = {k: sorted(e for e, *_ in find(spark, t)) for k, t in notes.items()}
    every = sorted(CONTEXT_RULES_BY_ENTITY)
    assert names[0] == every
    assert names[1] == []
    assert names[2] == []
    assert names[3] == sorted(
        ["AGE", "SSN", "ACCOUNT", "ACCOUNT", "LICENSE", "VIN", "EMAIL", "IDNUM", "ZIP", "ZIP", "MEDICALRECORD"]
    )
    assert [c for e, _, _, c in find(spark, notes[3]) if e == "IDNUM"] == ["10003"]


def test_spans_of_patterns_in_long_documents(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    found = docs.select("text", F.inline_outer(rule_findings(F.col("text"), PATTERN_RULES))).filter("chunk is not null")
    wrong = found.filter(F.expr("substring(text, begin + 1, end - begin) != chunk"))
    assert found.count() > 0
    assert wrong.count() == 0


def test_context_rules_read_single_sentences_and_find_the_same(spark, monkeypatch):
    rnd = random.Random(4)
    words = sorted({w for r in CONTEXT_RULES for w in r.prefix + r.suffix})
    values = ["123-45-6789", "10000037", "D1X", "1ABCD12EFGH123456", "12345", "75001-1234.", "34", "5 1/2", "1234 1/2", "é12😀", "u@x.example.org", "v.2.3"]
    gaps = [" ", " ", " ", ". ", "! ", "\n", " \n", ".", "\t", "-", " ", "\x01"]
    texts = ["".join(rnd.choice(words if rnd.random() < 0.5 else values) + rnd.choice(gaps[:3] if k % 3 else gaps) for _ in range(k % 90)) for k in range(300)]
    odd = (
        Rule("A", r"\d+", match_scope="sub-token", prefix=("of",), suffix=("old", "is!"), context_length=30, prefix_and_suffix=True),
        Rule("B", r"^[a-z]+$", prefix=("ss#", " call"), suffix=("x", "of "), context_length=4),
    )
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id int, text string").persist()

    def found():
        return {r[0]: r[1] and sorted(r[1]) for r in docs.select("doc_id", rule_findings(F.col("text"), CONTEXT_RULES + odd)).collect()}

    by_sentence = found()
    own = [r for r in CONTEXT_RULES if r.entity not in ("PHONE", "IDNUM")]
    plan = docs.select(rule_findings(F.col("text"), own))._jdf.queryExecution().toString()
    assert rules.EARLIER_SENTENCES not in plan  # no window is cut to its sentence afterwards
    monkeypatch.setattr(rules, "by_sentence", lambda rule: False)
    assert by_sentence == found() and sum(len(f or ()) for f in by_sentence.values()) > 1000
    docs.unpersist()


def test_rules_that_see_beyond_a_sentence_are_not_cut_to_it():
    wide = [Rule("A", r, match_scope="sub-token", suffix=("x",), context_length=5) for r in (r"(?<=#)\d", r"\d++.", r"^\d", r"\b\d")]
    assert not any(map(rules.by_sentence, wide)) and not rules.by_sentence(Rule("A", r"\d", prefix=(" x",), context_length=5))
    assert {r.entity for r in CONTEXT_RULES if not rules.by_sentence(r)} == {"PHONE", "IDNUM"}


def test_names_are_looked_for_behind_a_blank_only(spark):
    shipped = next(r for r in PATTERN_RULES if r.entity == "NAME")
    plain = dataclasses.replace(shipped, regex=rf"(?=[A-Za-z])(?<={catalog.NAME_LEAD})(?:{catalog.NAME_SHAPE})")
    assert "(?<= )" in shipped.regex and plain.regex != shipped.regex
    texts = ["Patient John Smith, Mrs. Van-Dyke", "Name: x#12 MrJohn Mr\tJo", "Miss  Ada Ms. Bo", "Customer Patient Customer#0007 Mr: 'x Mr é"]
    found = [find(spark, t, (plain,)) for t in texts]
    assert [find(spark, t, (shipped,)) for t in texts] == found and sum(map(len, found)) == 5


def test_a_text_without_any_context_word_is_not_cut_into_sentences(spark):
    gate = re.compile(rules._any_word(CONTEXT_RULES))
    assert gate.search("my SSN") and gate.search("Utah 1") and not gate.search("utah 75001. 42 123-45-6789")
    plan = spark.range(1).select(rule_findings(F.lit("x 1"), (CONTEXT_RULES_BY_ENTITY["VIN"],)).alias("found"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(rules._any_word((CONTEXT_RULES_BY_ENTITY["VIN"],))) == 2  # the text first, then each sentence

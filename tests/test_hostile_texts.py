"""Long texts made to exhaust a backtracking regex: every shipped rule ends soon and finds what stands there."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilwork.operators import catalog as cat
from veilwork.operators.rules import Rule, has_unbounded_group, rule_findings

SIZE = 1_000_000
RULES = cat.CONTEXT_RULES + cat.PATTERN_RULES
# (filler, words that make each rule look): repeated to a megabyte, with an "@" and a digit in it
FILLERS = (
    "a.", "a-", "a", "1", "1-", "(", "((-", ") ", "\"", "\\\"", "\\a", "@", "a@", "a@b.", "[1.", "www.", "http://", "+", "#", "1/", "A",
    "A-", "A1", "Aa ", "1 Aa ", "J.", "é", "😀", ".", "...!", " \n", "\t", "_", "%@", "1 1/2", "\u0001", "'", "x_y", "-@-",
)
HEAD = "email SSN account license VIN call fax serial Dr CVS/PHARMACY TX ICU Admission "


@pytest.mark.parametrize("glued", [False, True])
def test_every_rule_ends_on_every_filler(spark, glued):
    tail = " email me@x.example.com 9"
    rows = [(i, HEAD + ("9" if glued else "9 ") + f * (SIZE // len(f)) + ("@" if glued else " ") + tail) for i, f in enumerate(FILLERS)]
    frame = spark.createDataFrame(rows, "i int, text string").repartition(8)
    found = {r.i: r.f for r in frame.select("i", rule_findings(F.col("text"), RULES).alias("f")).collect()}
    assert len(found) == len(FILLERS)
    for i, text in rows:
        at = len(text) - len(tail) + tail.index("me@")
        mails = {(f.begin, f.chunk) for f in found[i] if f.detector == "EMAIL_chunks"}
        assert (at, "me@x.example.com") in mails, FILLERS[i]
        for f in found[i][:50]:
            assert text.replace("\u0001", " ")[f.begin : f.end] == f.chunk


def test_long_addresses_are_found_whole(spark):
    host, local = "x." * 200_000 + "org", "a." * 200_000 + "a"
    address = f"{local}@{host}"
    got = spark.createDataFrame([(f"email {address} and",)], "text string").select(F.explode(rule_findings(F.col("text"), RULES)).alias("f")).select("f.*").collect()
    by = {f.detector: f.chunk for f in got}
    assert by["EMAIL_chunks"] == address and by["pattern_EMAIL"] == address


def accepted(spark, regex, flags, tokens):
    frame = spark.createDataFrame([(t,) for t in tokens], "t string")
    return [r[0] for r in frame.select(F.rlike("t", F.lit(flags + regex))).collect()]


@pytest.mark.parametrize(("regex", "test", "flags", "alphabet"), [(cat.EMAIL_REGEX, cat.EMAIL_TEST, "(?is)", 'aZ1.-@"\\[]:é!'), (cat.LICENSE_REGEX, cat.LICENSE_TEST, "(?s)", "a1-é"), (cat.DEVICE_REGEX, cat.DEVICE_TEST, "(?s)", "A1-a")])
def test_linear_forms_accept_the_same_tokens(spark, regex, test, flags, alphabet):
    r = random.Random(4)
    tokens = ["".join(r.choices(alphabet, k=r.randint(1, 14))) for _ in range(20_000)]
    if "@" in alphabet:
        mail = lambda: "".join(r.choice(['a', 'b.c', '"', '\\"', '"x', '"\\"', '.', '-', 'z"', '"a"']) for _ in range(r.randint(1, 4))) + "@" + "".join(r.choice(["a", "b-", ".", "c.d", "-", "[1.2.3.4]", "[1.2.3.c:x]", "[", "é"]) for _ in range(r.randint(1, 5)))
        tokens += [mail() for _ in range(40_000)]
    want = accepted(spark, regex, flags, tokens)
    got = accepted(spark, test, flags, tokens)
    assert [t for t, a, b in zip(tokens, want, got, strict=True) if a != b] == []
    assert 0 < sum(want) < len(want)


def test_cut_runs_equal_leftmost_matches(spark):
    r = random.Random(9)
    texts = ["fax " + "".join(r.choices("+1(2) -x.", k=r.randint(0, 40))) for _ in range(3_000)]
    rule = Rule("FAX", cat.FAX_RUN, match_scope="sub-token", cut=cat.FAX_REGEX, rule_scope="document", case_sensitive=True)
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {x.i: [(f.begin, f.chunk) for f in x.f] for x in frame.select("i", rule_findings(F.col("text"), (rule,)).alias("f")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == [(m.start(), m[0]) for m in re.finditer(cat.FAX_REGEX, text)], text


def test_unbounded_groups_are_told():
    for bad in ("(?:ab)*", "(a|b)+c", "x(?:[)a]b){2,}", "(a){1,5000}", "(?:a)*?", r"(\))+", "((a)b)+"):
        assert has_unbounded_group(bad), bad
    for good in ("(?:ab)*+", "(a|b)++c", "[(a)*]+", r"\(a\)*", "(a)?", "(a){3}", "(a){0,9}", r"\Q(a)*\E", "(?<!a)b+", "[])*]+", "a*b+"):
        assert not has_unbounded_group(good), good
    with pytest.raises(ValueError, match="possessive"):
        Rule("X", "(?:a.)*b")
    assert Rule("X", "(?:a.)*b", test="(?:a.)*+b").test
    with pytest.raises(ValueError, match="scope"):
        Rule("X", "a", match_scope="sub-token", test="a")
    for r in RULES:
        assert not has_unbounded_group(r.test or r.regex)

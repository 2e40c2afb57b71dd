"""Personal data in texts made to exhaust a backtracking regex."""

import random

import pytest
from helpers import frame
from pyspark.sql import functions as F

from veilwork.llm import pii_supervision as pii

BACKTRACKING = r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z0-9-]{2,63})+(?![A-Za-z0-9_@-])"
SIZE = 1_000_000


def test_written_out_addresses_are_the_same(spark):
    r = random.Random(3)
    parts = ["bob", " ", "(at)", "[AT]", "mail", ".", "com", " (dot) ", "[DOT]", "x", "_", "@", "-", "é", "a" * 63, "b" * 64, "co", "."]
    texts = ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(6_000)] + ["bob (at) " + "".join(r.choices(parts, k=r.randint(1, 10))) for _ in range(12_000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select(
        F.regexp_extract_all("t", F.lit(BACKTRACKING), F.lit(0)).alias("want"),
        F.regexp_extract_all("t", F.lit(pii.MAIL_FORM + r"(?![A-Za-z0-9_@-])"), F.lit(0)).alias("got"),
    ).collect()
    assert [x for x in found if x.want != x.got] == []
    assert sum(bool(x.want) for x in found) > 300


@pytest.mark.parametrize("filler", [".com", " (dot) com", "a", "a.", "a-", "1", "1 ", "1.", "+1", "+1(", "@", "a@", "a@b.", "(at)", "x_", "=", "/", "A1b2", "0.0.", "-", "212-", "(", "é"])
def test_long_texts_end_soon(spark, filler):
    long = "bob (at) mail" + filler * (SIZE // len(filler))
    tail = " mail me@x.example.com from 10.0.0.1 now"
    rows = [(1, long + tail), (2, tail), (3, "key " + filler * 3)]
    out = {x["doc_id"]: x for x in pii.detect(frame(spark, rows)).collect()}
    assert out[2]["n_email"] == 1 and out[2]["n_ip"] == 1
    assert out[1]["n_email"] >= 1 and out[1]["n_ip"] >= 1
    at = len(long) + tail.index("me@")
    assert f"email:{at}:{at + 16}" in out[1]["spans"]

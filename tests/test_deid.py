import re

import pytest
from pyspark.sql import functions as F

from veilwork import fixtures as fx
from veilwork.operators.catalog import CONTEXT_RULES, SURROGATES
from veilwork.operators.deid import check_policy, replacement
from veilwork.operators.metadata import deidentify_metadata
from veilwork.plans.text import attach_chunks, deidentify_text, find_entities, pruned_rules

LABELS = [r.entity for r in CONTEXT_RULES]


def rewrite(spark, texts, labels, policy=None, **options):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = deidentify_text(frame, "s", labels, policy, **options).orderBy("doc_id").collect()
    return [r.deidentified for r in rows]


def test_masks_at_start_end_and_between(spark):
    policy = {"ZIP": "mask_fixed", "SSN": "mask_label", "EMAIL": "mask_same_length", "AGE": "skip"}
    texts = [
        "a@b.example.com email", "SSN 123-45-6789", "SSN 123-45-6789 987-65-4321", "", None, "plain\x01 text",
        "é🦆ß TX 75001 ok", "a 45-year-old", "tab\tSSN\t123-45-6789\nnext",
    ]
    assert rewrite(spark, texts, LABELS, policy, rules=CONTEXT_RULES) == [
        "*" * 15 + " email", "SSN <SSN>", "SSN <SSN> <SSN>", "", None, "plain\x01 text",
        "é🦆ß TX **** ok", "a 45-year-old", "tab\tSSN\t<SSN>\nnext",
    ]


def test_residual_is_starred(spark):
    chunks = spark.createDataFrame(
        [(0, 0, 0, 6, "abcdef", "URL", "x"), (0, 0, 4, 9, "efghi", "SSN", "SSN_chunks")],
        "doc_id int, sent_id int, begin int, end int, chunk string, entity string, detector string",
    )
    # the longer URL loses to the ranked SSN; what only the URL covered is starred
    out = rewrite(spark, ["abcdefghij"], ["URL", "SSN"], {"URL": "mask_label", "SSN": "mask_label"}, extra_chunks=chunks)
    assert out == ["****<SSN>j"]


def test_long_text_rebuild(spark):
    text = ("x" * 700 + ". SSN 123-45-6789. ") * 5 + "tail"
    out = rewrite(spark, [text], ["SSN"], {"SSN": "mask_label"}, rules=CONTEXT_RULES)
    assert out == [text.replace("123-45-6789", "<SSN>")]


def test_surrogates_keep_format_and_never_equal_the_original(spark):
    rows = [("PHONE", f"(2{i:02d}) 555-{i:04d}") for i in range(100)] + [("IDNUM", f"Ab-{i}é") for i in range(100)]
    rows += [(e, v) for e, vs in SURROGATES.items() for v in vs]
    frame = spark.createDataFrame(rows, "entity string, chunk string")
    for r in frame.select("*", replacement(F.col("entity"), F.col("chunk"), "s").alias("out")).collect():
        assert r.out != r.chunk
        if r.entity in ("PHONE", "IDNUM"):
            kinds = lambda t: re.sub("[^\x00-\x7f]", "x", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", t))))
            assert len(r.out) == len(r.chunk)
            assert kinds(r.out)[:3] == kinds(r.chunk)[:3]
            assert not re.search("[^\x00-\x7f]", r.out)


def test_same_result_for_any_partitioning(spark, sf_dir):
    notes = fx.as_docs(fx.notes(spark, sf_dir), "note_id").filter("doc_id < 200")
    one, many = (
        {
            r.doc_id: r.deidentified
            for r in deidentify_text(notes.repartition(n), "s", LABELS, rules=CONTEXT_RULES).collect()
        }
        for n in (1, 50)
    )
    assert one == many and len(one) == 200


def test_text_outside_findings_is_unchanged(spark, sf_dir):
    done = deidentify_text(fx.documents(spark, sf_dir), "s", ["PHONE", "EMAIL", "URL"])
    rows = done.filter(F.size("chunks") > 0).collect()
    assert rows
    for r in rows:
        at, rest = 0, r.deidentified
        for c in sorted(r.chunks, key=lambda c: c.begin):
            gap = r.text[at : c.begin]
            assert rest.startswith(gap) and r.text[c.begin : c.end] == c.chunk
            following = r.text[c.end : c.end + 8]
            rest = rest[len(gap) :]
            rest = rest[rest.index(following) :] if following else ""
            at = c.end


def test_label_pruning_and_whitelist(spark, sf_dir):
    assert {r.entity for r in pruned_rules(CONTEXT_RULES, ("SSN",))} == {"SSN"}
    notes = fx.as_docs(fx.notes(spark, sf_dir), "note_id")
    got = find_entities(notes, ["SSN"], CONTEXT_RULES).select("entity").distinct().collect()
    assert [r.entity for r in got] == ["SSN"]


def test_a_finding_of_an_unrequested_label_hides_nothing(spark):
    # SSN outranks ACCOUNT on the same span; asking for ACCOUNT alone still masks it
    out = rewrite(spark, ["SSN account 123456789"], ["ACCOUNT"], {"ACCOUNT": "mask_label"}, rules=CONTEXT_RULES)
    assert out == ["SSN account <ACCOUNT>"]


def test_errors(spark):
    with pytest.raises(ValueError):
        check_policy({"SSN": "shred"})
    frame = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    with pytest.raises(ValueError):
        deidentify_text(frame, "", ["SSN"])
    with pytest.raises(ValueError):
        deidentify_text(frame, "s", [])


def test_attach_keeps_documents_without_findings(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id bigint, text string")
    none = spark.createDataFrame(
        [], "doc_id bigint, sent_id int, begin int, end int, chunk string, entity string, detector string"
    )
    assert attach_chunks(docs, none).filter("extra is null").count() == 2


def test_metadata_maps(spark):
    rows = [
        (1, {"Name": "Ann", "note": "SSN 123-45-6789", "other": None, "empty": ""}),
        (2, {}),
        (3, None),
        (4, {"a": "ends with SSN", "b": "123-45-6789", "c": "x\x03y"}),
    ]
    frame = spark.createDataFrame(rows, "id int, metadata map<string,string>")
    got = {
        r.id: r.metadata
        for r in deidentify_metadata(frame, "s", {"name": "NAME"}, labels=["SSN"], policy={"SSN": "mask_label"}).collect()
    }
    assert got[1] == {"Name": "<NAME>", "note": "SSN <SSN>", "other": None, "empty": ""}
    assert got[2] == {} and got[3] is None
    assert got[4] == {"a": "ends with SSN", "b": "123-45-6789", "c": "x y"}

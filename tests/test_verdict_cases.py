"""Cases that once lost findings without a word."""

import json

import pytest
from pyspark.sql import functions as F

from veilwork.operators import dictionary, imaging, stats, tagging
from veilwork.operators.merge import accepted_labels, requested_labels
from veilwork.operators.metadata import deidentify_metadata
from veilwork.operators.rules import Rule, rule_findings
from veilwork.plans.pages import deidentify_pages
from veilwork.plans.text import chunk_table, deidentify_text, find_entities

CHUNKS = "doc_id long, sent_id int, begin int, end int, chunk string, entity string, detector string"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_dictionary_phrases_of_any_length_and_punctuation(spark):
    phrases = ["Mercy General Hospital West", "St. Mary's Hospital", "Smith, John", "  Acme  Clinic ", "...", None]
    listed = spark.createDataFrame([("HOSPITAL", p) for p in phrases], "entity string, phrase string")
    text = "Seen at mercy general hospital west, then St. Mary's Hospital. Smith, John went to Acme Clinic (old). In Mercy. General Hospital West."
    got = {r["chunk"] for r in dictionary.dictionary_chunks(docs(spark, text, None, ""), listed).collect()}
    assert got == {"mercy general hospital west", "St. Mary's Hospital", "Smith, John", "Acme Clinic"}
    plain = listed.where("phrase not like 'St%'")
    assert {r["chunk"] for r in dictionary.dictionary_chunks(docs(spark, text), plain).collect()} == got - {"St. Mary's Hospital"}
    assert dictionary.dictionary_chunks(docs(spark, text), listed.limit(0)).count() == 0


def test_word_lists_are_cut_like_texts(spark):
    found = dictionary.word_findings(F.col("text"), {"X": ["Smith,  John", "(ACME)"]})
    assert {r["chunk"] for r in chunk_table(docs(spark, "smith, john of Acme."), found).collect()} == {"smith, john", "Acme"}


def test_a_skipped_label_shields_no_other_finding(spark):
    out = deidentify_text(docs(spark, "ICU Admission in TX 12345"), "s", ["ZIP", "MEDICALRECORD"], {"ZIP": "skip", "MEDICALRECORD": "mask_label"}).first()
    assert "12345" not in out["deidentified"]
    kept = deidentify_text(docs(spark, "TX 12345"), "s", ["ZIP"], {"ZIP": "skip"}).first()
    assert (kept["deidentified"], kept["chunks"]) == ("TX 12345", [])


def test_a_renamed_label_counts_under_both_names(spark):
    assert requested_labels(["ID"]) == ("IDNUM",) and accepted_labels(["ID"]) == ("ID", "IDNUM")
    extra = spark.createDataFrame([(0, 0, 0, 4, "A-77", "ID", "my_ner")], CHUNKS)
    assert deidentify_text(docs(spark, "A-77 seen"), "s", ["ID"], {"ID": "mask_label"}, extra_chunks=extra).first()["deidentified"] == "<IDNUM> seen"
    assert find_entities(docs(spark, "badge AB12"), ["ID"], [Rule("ID", "[A-Z]{2}[0-9]{2}", prefix=("badge",), context_length=3)]).count() == 1


@pytest.mark.parametrize("word", ["#", "№", "номер"])
def test_context_words_without_ascii_letters(spark, word):
    rule = Rule("IDNUM", "[0-9]{5}", prefix=(word,), context_length=3)
    assert chunk_table(docs(spark, f"{word} 12345", "12345"), rule_findings(F.col("text"), [rule])).count() == 1


def test_a_finding_inside_a_token_is_tagged(spark):
    toks = tagging.token_table(docs(spark, "see CVS#12345 now"))
    found = spark.createDataFrame([(0, 0, 8, 13, "12345", "IDNUM", "d")], CHUNKS)
    assert [r["tag"] for r in tagging.weak_tags(toks, found).orderBy("token_id").collect()] == ["O", "B-IDNUM", "O"]


def test_statistics_of_null_texts_and_files_without_output(spark):
    pages = spark.createDataFrame([("a", None), ("a", [("xy",)])], "path string, chunks array<struct<chunk:string>>")
    asked = spark.createDataFrame([("a",), ("b",)], "path string")
    got = {r["path"]: json.loads(r["summary"]) for r in stats.summary_records(stats.file_statistics(pages), asked).collect()}
    assert got["a"] == {"status": 1, "numberOfPages": 2, "numberOfDeidEntities": 1, "numberOfChars": 2}
    assert got["b"] == {"status": 0, "numberOfPages": 0, "numberOfDeidEntities": 0, "numberOfChars": 0}


def test_regions_of_pages_without_a_size(spark):
    chunks = spark.createDataFrame([(p, 0, 4, "X") for p in (1, 2)], "page_id long, begin int, end int, entity string")
    boxes = spark.createDataFrame([(p, 0, 0, 4, 10, 10, 50, 8) for p in (1, 2)], "page_id long, word_id int, b int, e int, x int, y int, w int, h int")
    sizes = spark.createDataFrame([(1, 30, 30)], "page_id long, width int, height int")
    assert {r["page_id"] for r in imaging.find_regions(chunks, boxes, page_sizes=sizes).collect()} == {1, 2}


def test_sub_token_rules_match_inside_sentences(spark):
    rule = Rule("AGE", r"[0-9]+(?:\.? ?[0-9]+)?", match_scope="sub-token")
    rows = chunk_table(docs(spark, "12. 34 and 5.6 7", "1 2"), rule_findings(F.col("text"), [rule])).orderBy("doc_id", "begin").collect()
    assert [(r["doc_id"], r["sent_id"], r["begin"], r["chunk"]) for r in rows] == [(0, 0, 0, "12"), (0, 1, 4, "34"), (0, 1, 11, "5.6"), (0, 1, 15, "7"), (1, 0, 0, "1 2")]


def test_token_rules_may_look_at_the_whole_document(spark):
    rule = Rule("IDNUM", "[0-9]{5}", rule_scope="document", prefix=("number",), context_length=10)
    near = Rule("IDNUM", "[0-9]{5}", prefix=("number",), context_length=10)
    text = docs(spark, "The number. 12345 stands here")
    assert [(r["sent_id"], r["chunk"]) for r in chunk_table(text, rule_findings(F.col("text"), [rule])).collect()] == [(-1, "12345")]
    assert chunk_table(text, rule_findings(F.col("text"), [near])).count() == 0


def test_page_and_count_entry_points_take_a_dictionary(spark):
    listed = spark.createDataFrame([("HOSPITAL", "Mercy West")], "entity string, phrase string")
    text = docs(spark, "at Mercy West")
    found = find_entities(text, ["HOSPITAL"], extra_chunks=dictionary.dictionary_chunks(text, listed))
    assert [r["chunk"] for r in found.collect()] == ["Mercy West"]
    with pytest.warns(UserWarning, match="HOSPITAL"):
        find_entities(text, ["HOSPITAL"])
    words = spark.createDataFrame([(1, 0, "at"), (1, 1, "Mercy"), (1, 2, "West")], "page_id long, word_id int, word string")
    boxes = spark.createDataFrame([(1, k, 10 * k, 0, 8, 8) for k in range(3)], "page_id long, word_id int, x int, y int, w int, h int")
    pixels = spark.createDataFrame([(1, y, [200] * 40) for y in range(8)], "image_id long, y int, px array<int>")
    result = deidentify_pages(pixels, words, boxes, ["HOSPITAL"], dictionary=listed)
    assert [r["entity"] for r in result.chunks.collect()] == ["HOSPITAL"] and result.regions.count() == 1
    result.release()


def test_metadata_keeps_clashing_columns_and_reads_word_lists(spark):
    rows = spark.sql("select 1 as deidentified, 'k' as chunks, map('sex', 'female', 'n', cast(null as string)) as metadata union all select 2, 'j', null")
    far = Rule("IDNUM", "[0-9]{5}", prefix=("badge",), context_length=300)
    got = deidentify_metadata(rows, "s", {}, labels=["GENDER", "IDNUM"], policy={"GENDER": "mask_label"}, rules=[far]).collect()
    assert {r["deidentified"]: (r["chunks"], r["metadata"]) for r in got} == {1: ("k", {"sex": "<GENDER>", "n": None}), 2: ("j", None)}

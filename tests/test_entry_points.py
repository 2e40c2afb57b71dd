"""What entry points promise beyond their rows: secrets stay out of plans, one scan, files, names, files taken in once."""

import pytest
from pyspark.sql import functions as F

from veilwork.operators.catalog import CONTEXT_RULES
from veilwork.operators.rules import Rule
from veilwork.plans.pages import deidentify_pages
from veilwork.plans.text import deidentify_text, documents_by_findings, find_entities
from veilwork.streaming.intake import run_intake, stream_files

TEXT = "Patient Ann Lee, SSN 123-45-6789, call (200) 555-0000."
SECRET = "a-very-secret-salt"


def docs(spark, texts=(TEXT, None, "", "nothing")):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_the_salt_stands_in_no_plan(spark):
    plain = deidentify_text(docs(spark), SECRET, ["SSN", "PHONE", "NAME"])
    held = deidentify_text(docs(spark), spark.createDataFrame([(SECRET,)], "key string"), ["SSN", "PHONE", "NAME"])
    other = deidentify_text(docs(spark), "another", ["SSN", "PHONE", "NAME"])
    for frame in (plain, held):
        frame.collect()
        execution = frame._jdf.queryExecution()
        for plan in (execution.toString(), execution.logical().toString(), execution.executedPlan().toString()):
            assert "veilwork_salt" in plan or "salt" in plan
            assert SECRET not in plan
    rows = lambda f: sorted((r.doc_id, r.deidentified) for r in f.collect())
    assert rows(plain) == rows(held) != rows(other)
    assert "123-45-6789" not in rows(plain)[0][1] and "555-0000" not in rows(plain)[0][1]


@pytest.mark.parametrize("salt", ["", None])
def test_an_empty_salt_is_refused(spark, salt):
    if salt == "":
        with pytest.raises(ValueError, match="salt"):
            deidentify_text(docs(spark), salt, ["SSN"])
    with pytest.raises(Exception, match="salt is required"):
        deidentify_text(docs(spark), spark.createDataFrame([(salt,)], "s string"), ["SSN"]).collect()


def test_documents_by_findings_need_one_scan(spark):
    some = documents_by_findings(docs(spark), CONTEXT_RULES, True)
    none = documents_by_findings(docs(spark), CONTEXT_RULES, False)
    assert [r.doc_id for r in some.collect()] == [0]
    assert sorted(r.doc_id for r in none.collect()) == [1, 2, 3]
    assert some.columns == ["doc_id", "text"]
    assert "Join" not in some._jdf.queryExecution().executedPlan().toString()


def test_the_default_labels_find_names(spark):
    texts = ("Patient Ann Lee-Smith is here", "Mr. Bo Ek and Mrs Q", "Dear Ann", "Name: Customer#0012.", "my patient Ann", "Username Bob")
    found = find_entities(docs(spark, texts)).where("entity = 'NAME'")
    got = {(r.doc_id, r.chunk) for r in found.collect()}
    assert {(0, "Ann Lee-Smith"), (1, "Bo Ek")} <= got
    assert not {i for i, _ in got} & {2, 4}


def page(spark):
    words = [(1, i, w) for i, w in enumerate("SSN 123-45-6789 end".split())] + [(2, 0, "clean")]
    boxes = [(1, 0, 0, 0, 3, 1), (1, 2, 16, 0, 3, 1), (2, 0, 0, 0, 5, 1)]
    return (
        spark.createDataFrame([(1, 0, [9] * 20), (2, 0, [9] * 20)], "image_id int, y int, px array<int>"),
        spark.createDataFrame(words, "page_id int, word_id int, word string"),
        spark.createDataFrame(boxes, "page_id int, word_id int, x int, y int, w int, h int"),
    )


def test_a_word_without_a_box_is_told_and_files_are_counted(spark):
    files = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "page_id int, path string")
    result = deidentify_pages(*page(spark), ["SSN"], files=files)
    assert [(r.page_id, r.chunk) for r in result.unplaced.collect()] == [(1, "123-45-6789")]
    got = {r.path: (r.pages, r.entities, r.characters) for r in result.files.collect()}
    assert got == {"a": (2, 1, 11), "b": (1, 0, 0)}
    result.release()


def test_texts_from_elsewhere_are_put_back_onto_the_words(spark):
    pixels, words, boxes = page(spark)
    boxes = boxes.union(spark.createDataFrame([(1, 1, 4, 0, 11, 1)], boxes.schema))
    texts = spark.createDataFrame([(1, "Header line. SSN 123-45-6789 end"), (2, "clean")], "page_id int, text string")
    result = deidentify_pages(pixels, words, boxes, ["SSN"], page_texts=texts)
    assert [(r.begin, r.end) for r in result.chunks.collect()] == [(4, 15)]
    assert {r.image_id: r.px for r in result.pixels.collect()}[1] == [9] * 3 + [0] * 13 + [9] * 4
    assert result.unplaced.count() == 0
    result.release()


def test_a_file_answers_once_and_a_blank_one_too(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(TEXT)
    (tmp_path / "in" / "b.txt").write_text("\n")
    take = lambda: run_intake(stream_files(spark, f"{tmp_path}/in", binary=True), f"{tmp_path}/out", f"{tmp_path}/state", SECRET, ["SSN"])
    take()
    (tmp_path / "in" / "c.txt").write_text("SSN 987-65-4321")
    take()
    take()
    summaries = spark.read.parquet(f"{tmp_path}/out/summary").withColumn("file", F.element_at(F.split("path", "/"), -1)).collect()
    assert sorted(r.file for r in summaries) == ["a.txt", "b.txt", "c.txt"]
    texts = {r.path[-5:]: r.deidentified for r in spark.read.parquet(f"{tmp_path}/out/text").collect()}
    assert texts["b.txt"] == "\n" and "4321" not in texts["c.txt"]


def test_labels_are_renamed_by_kind_and_unknown_ones_refused(spark):
    """A caller's own tagger is renamed whatever its name; a context rule keeps its label."""
    fields = "doc_id long, sent_id int, begin int, end int, chunk string, entity string, detector string"
    own = spark.createDataFrame([(3, 0, 0, 7, "nothing", "BIOID", "my_ner"), (0, 0, 8, 15, "Ann Lee", "MOOD", "my_ner")], fields)
    found = find_entities(docs(spark), ["BIOID", "MOOD", "SSN"], CONTEXT_RULES, extra_chunks=own)
    assert {(r.doc_id, r.entity) for r in found.collect()} == {(3, "IDNUM"), (0, "MOOD"), (0, "SSN")}
    with pytest.raises(ValueError, match="MOOD"):
        find_entities(docs(spark), ["MOOD"])
    with pytest.raises(ValueError, match="MOOD"):
        deidentify_text(docs(spark), SECRET, ["SSN", "MOOD"])
    with pytest.warns(UserWarning, match="HOSPITAL"):
        find_entities(docs(spark), ["HOSPITAL"])
    keeps = Rule("ID", "[0-9]{3}-[0-9]{2}-[0-9]{4}", match_scope="sub-token", kind="context", detector="pattern_like_name")
    assert [r.entity for r in find_entities(docs(spark), ["ID"], [keeps]).collect()] == ["ID"]

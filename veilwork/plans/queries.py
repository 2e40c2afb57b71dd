"""Every operator as a query over the given tables: name -> f(spark, sf_dir)."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork import fixtures as fx
from veilwork.functions.text import clean_text, sentences
from veilwork.operators import annotations as ann
from veilwork.operators import deid, dictionary, imaging, merge, metadata, stats, tagging
from veilwork.operators.catalog import (
    CONTEXT_RULES,
    CONTEXT_RULES_BY_ENTITY,
    DETECTORS,
    PATTERN_RULES,
    PATTERN_RULES_BY_ENTITY,
    WORD_LISTS,
)
from veilwork.operators.detectors import context_detectors
from veilwork.operators.pipeline import compose
from veilwork.operators.rules import Rule, rule_findings
from veilwork.plans.pages import deidentify_pages
from veilwork.plans.text import (
    chunk_table,
    count_entities,
    deidentify_text,
    documents_by_findings,
    find_entities,
    findings,
    with_findings_on_row,
)
from veilwork.sources import readers, writers
from veilwork.streaming.intake import run_intake, stream_files, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The salt of the checks only; a caller brings a secret one.
CHECK_SALT = "check-salt"
RULE_LABELS = tuple(sorted(r.entity for r in CONTEXT_RULES))
CHECK_POLICY = {
    "SSN": "mask_label",
    "VIN": "mask_same_length",
    "ZIP": "mask_fixed",
    "MEDICALRECORD": "skip",
}


def query(name: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return register


def _note_chunks(spark: SparkSession, sf_dir: str, rules: tuple[Rule, ...] = CONTEXT_RULES) -> DataFrame:
    """Raw findings of notes, overlaps still in."""
    return chunk_table(fx.note_docs(spark, sf_dir), rule_findings(F.col("text"), rules))


def _resolved_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_entities(fx.note_docs(spark, sf_dir), RULE_LABELS, CONTEXT_RULES)


# ---------------------------------------------------------------- sources and sinks


@query("text_source")
def text_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines, written as text files and read back with the fixed schema."""
    path = writers.scratch_path(spark, "lines")
    writers.write_text(fx.documents(spark, sf_dir), path, "text")
    return readers.read_text(spark, path).select("text")


# A file read whole is one row, so files grow in number with the documents and not in size.
WHOLE_FILE_ROWS = 500


@query("text_source_whole_files")
def text_source_whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file: characters in the files, which hold a newline after each text."""
    path = writers.scratch_path(spark, "files")
    writers.write_text(fx.documents(spark, sf_dir), path, "text", WHOLE_FILE_ROWS)
    return readers.read_text(spark, path, whole_file=True).agg(F.sum(F.length("text")).alias("characters"))


@query("binary_source")
def binary_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest of files read as bytes: one file of customer names for each nation, non-ASCII letters among them."""
    path = writers.scratch_path(spark, "binary")
    lines = fx.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"), "c_custkey", F.concat(F.lit("é "), "c_name").alias("value")
    )
    one_each = lines.repartition("nation").sortWithinPartitions("nation", "c_custkey")
    one_each.select("nation", "value").write.partitionBy("nation").text(path)
    return readers.read_binary(spark, f"{path}/*/part-*").select(
        F.regexp_extract("path", "nation=([0-9]+)", 1).cast("int").alias("nation"), "length", F.sha2("content", 256).alias("digest")
    )


@query("text_sink")
def text_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """De-identified notes written as text and read back."""
    path = writers.scratch_path(spark, "deidentified")
    docs = fx.note_docs(spark, sf_dir)
    writers.write_text(deidentify_text(docs, CHECK_SALT, RULE_LABELS, rules=CONTEXT_RULES), path)
    return readers.read_text(spark, path).select("text")


@query("output_per_file")
def output_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to one folder per source, then counted per folder."""
    path = writers.scratch_path(spark, "per-file")
    docs = fx.table(spark, sf_dir, "documents").select(F.col("source").alias("path"), "text")
    writers.write_per_file(docs, path)
    return spark.read.parquet(path).groupBy("path").agg(
        F.countDistinct("path_key").alias("folders"), F.count(F.lit(1)).alias("rows")
    )


@query("rule_set_load")
def rule_set_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules written as JSON, read back and applied."""
    path = writers.scratch_path(spark, "rules")
    readers.write_rules(spark, CONTEXT_RULES, path)
    return count_entities(_note_chunks(spark, sf_dir, readers.read_rules(spark, path)))


@query("policy_load")
def policy_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy written as JSON, read back; findings by label and the mode they get."""
    path = writers.scratch_path(spark, "policy")
    readers.write_policy(spark, CHECK_POLICY, path)
    policy = spark.createDataFrame(sorted(readers.read_policy(spark, path).items()), readers.POLICY_SCHEMA)
    counts = _note_chunks(spark, sf_dir).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(policy, "entity", "left").select(
        "entity", F.coalesce("mode", F.lit(deid.DEFAULT_MODE)).alias("mode"), "n"
    )


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        fx.table(spark, sf_dir, t).select(F.lit(entity).alias("entity"), F.col(c).alias("phrase"))
        for t, c, entity in (
            ("customer", "c_name", "PATIENT"),
            ("supplier", "s_name", "HOSPITAL"),
            ("nation", "n_name", "COUNTRY"),
            ("region", "r_name", "LOCATION"),
        )
    ]
    return merge.union_chunks(*parts)


@query("dictionary_load")
def dictionary_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored dictionaries, one picked by a part of its name."""
    base = writers.scratch_path(spark, "assets")
    words = _dictionary(spark, sf_dir)
    words.filter("entity = 'PATIENT'").write.parquet(f"{base}/names_patient")
    words.filter("entity != 'PATIENT'").write.parquet(f"{base}/names_place")
    return readers.read_dictionary(spark, base, "place")


@query("summary_record")
def summary_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary_records(_file_statistics(spark, sf_dir))


@query("result_reuse")
def result_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings kept once and used twice: label counts beside the total."""
    chunks = _resolved_notes(spark, sf_dir).persist()
    total = stats.chunk_totals(chunks).select(F.col("entities").alias("total"))
    by_label = chunks.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    # The total is an aggregate without keys: exactly one row.
    return by_label.crossJoin(F.broadcast(total))


# ---------------------------------------------------------------- text structure


@query("document_assembly")
def document_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    return docs.filter(F.col("text").isNotNull()).select(
        "doc_id", F.length(clean_text(F.col("text"))).alias("characters"), F.md5("text").alias("digest")
    )


@query("sentence_split")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = sentences(clean_text(F.col("text")))
    return fx.documents(spark, sf_dir).select("doc_id", F.inline_outer(split)).filter("sentence is not null")


@query("tokenise")
def tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.token_table(fx.documents(spark, sf_dir)).select(
        "doc_id", "sent_id", "token_id", "begin", "end", "token"
    )


@query("token_neighbours")
def token_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.token_table(fx.turns(spark, sf_dir)).select(
        "doc_id", "sent_id", "token_id", "previous", "following"
    )


@query("token_vectors")
def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the turns joined to stored vectors of the benchmark's vocabulary."""
    items = fx.as_docs(fx.table(spark, sf_dir, "benchmark"), "item_id")
    vocabulary = tagging.token_table(items).select("token").distinct()
    vec_id = F.pmod(F.conv(F.substring(F.sha2("token", 256), 1, 8), 16, 10).cast("bigint"), F.lit(fx.table(spark, sf_dir, "embeddings").count()))
    vectors = vocabulary.withColumn("vec_id", vec_id).join(
        fx.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id"
    ).select("token", "embedding")
    return tagging.attach_vectors(tagging.token_table(fx.turns(spark, sf_dir)), vectors, 64).select(
        "doc_id", "sent_id", "token_id", "token",
        F.col("embedding")[0].cast("double").alias("first"),
        F.col("embedding")[63].cast("double").alias("last"),
    )


@query("ngram_candidates")
def ngram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = dictionary.sentence_ngrams(clean_text(F.col("text")), 3)
    return fx.turns(spark, sf_dir).select("doc_id", F.inline_outer(grams)).filter("phrase is not null")


# ---------------------------------------------------------------- rules


def _one_rule(rule: Rule) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _note_chunks(spark, sf_dir, (rule,))

    return run


for _rule in CONTEXT_RULES:
    QUERIES[f"rule_{_rule.entity.lower()}"] = _one_rule(_rule)


@query("rules_one_pass")
def rules_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _note_chunks(spark, sf_dir)


@query("rules_documents")
def rules_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over whole documents, in which every address is announced by a context word."""
    announced = F.regexp_replace("text", r"([A-Za-z0-9._%+-]+@)", "mail $1")
    docs = fx.documents(spark, sf_dir).withColumn("text", announced)
    return chunk_table(docs, rule_findings(F.col("text"), CONTEXT_RULES))


BOTH_SIDES_RULE = Rule(
    "DATE",
    r"^\d{4}-\d{2}-\d{2}$",
    prefix=("seen",),
    suffix=("in",),
    context_length=20,
    prefix_and_suffix=True,
    signal=True,
)
CASE_RULE = Rule(
    "LICENSE", CONTEXT_RULES_BY_ENTITY["LICENSE"].regex, prefix=("license",), context_length=20, signal=True
)
PLAIN_TOKEN_RULE = Rule(
    "COUNTRY", r"^nation_", prefix=("in",), context_length=3, detector="pattern_COUNTRY"
)


@query("rule_prefix_and_suffix")
def rule_prefix_and_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant that asks for a word on both sides; document scope is not involved."""
    return _note_chunks(spark, sf_dir, (BOTH_SIDES_RULE,))


@query("rule_case_insensitive")
def rule_case_insensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _note_chunks(spark, sf_dir, (CASE_RULE,))


@query("rule_all_tokens")
def rule_all_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule without the digit promise, so every token is a candidate."""
    return _note_chunks(spark, sf_dir, (PLAIN_TOKEN_RULE,))


# ---------------------------------------------------------------- patterns, words, dictionaries


def _pattern_docs(spark: SparkSession, sf_dir: str, rule: Rule) -> DataFrame:
    if rule.entity == "URL":
        pages = fx.table(spark, sf_dir, "pages")
        return fx.spread(pages.selectExpr("page_id as doc_id", "url || ' ' || html as text"))
    if rule.entity in ("PHONE", "EMAIL"):
        return fx.documents(spark, sf_dir)
    if rule.entity in ("DOCTOR", "STREET", "FAX", "DEVICE"):
        return _admission_docs(spark, sf_dir)
    return fx.note_docs(spark, sf_dir)


def _one_pattern(rule: Rule) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunk_table(_pattern_docs(spark, sf_dir, rule), rule_findings(F.col("text"), (rule,)))

    return run


for _rule in PATTERN_RULES:
    QUERIES[f"pattern_{_rule.entity.lower()}"] = _one_pattern(_rule)


def _admission_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts with forms the other tables lack, one per customer."""
    return fx.spread(fx.table(spark, sf_dir, "customer").selectExpr("c_custkey as doc_id", f"{fx.ADMISSION_SQL} as text"))


@query("patterns_admissions")
def patterns_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_table(_admission_docs(spark, sf_dir), rule_findings(F.col("text"), PATTERN_RULES))


@query("word_lists")
def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_table(_admission_docs(spark, sf_dir), dictionary.word_findings(F.col("text"), WORD_LISTS))


@query("dictionary_join")
def dictionary_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.dictionary_chunks(fx.note_docs(spark, sf_dir), _dictionary(spark, sf_dir))


# ---------------------------------------------------------------- labels and merge


@query("detector_set")
def detector_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct detector once, with the findings it made."""
    detectors = spark.createDataFrame(DETECTORS, "entity string, detector string, kind string")
    distinct = detectors.select("detector", "kind").dropDuplicates(["detector"])
    found = _note_chunks(spark, sf_dir, CONTEXT_RULES + PATTERN_RULES).groupBy("detector").agg(
        F.count(F.lit(1)).alias("n")
    )
    return distinct.join(found, "detector", "left").select(
        "detector", "kind", F.coalesce("n", F.lit(0)).alias("n")
    )


@query("label_detectors")
def label_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by label and kind of detector; a label may have several detectors."""
    detectors = spark.createDataFrame(DETECTORS, "entity string, detector string, kind string")
    chunks = _note_chunks(spark, sf_dir, CONTEXT_RULES + PATTERN_RULES)
    return chunks.join(detectors, ["entity", "detector"]).groupBy("entity", "kind").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("label_rename")
def label_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (PATTERN_RULES_BY_ENTITY["ID"], CONTEXT_RULES_BY_ENTITY["IDNUM"])
    found = merge.rename_findings(rule_findings(F.col("text"), rules), context_detectors(rules))
    return chunk_table(fx.note_docs(spark, sf_dir), found)


@query("label_whitelist")
def label_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge.whitelist_findings(
        rule_findings(F.col("text"), CONTEXT_RULES), merge.requested_labels(["SSN", "AGE", "ID"])
    )
    return chunk_table(fx.note_docs(spark, sf_dir), found)


@query("default_labels")
def default_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No labels named: the default list applies."""
    return find_entities(fx.note_docs(spark, sf_dir))


@query("chunk_conversion")
def chunk_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule findings in the common shape, under the name of their output column."""
    chunks = _note_chunks(spark, sf_dir)
    return chunks.groupBy("detector").agg(
        F.count(F.lit(1)).alias("n"), F.min("chunk").alias("first"), F.max("chunk").alias("last")
    )


@query("chunk_union")
def chunk_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _note_chunks(spark, sf_dir, (CONTEXT_RULES_BY_ENTITY["SSN"], CONTEXT_RULES_BY_ENTITY["VIN"]))
    return merge.union_chunks(a, fx.span_chunks(spark, sf_dir)).groupBy("detector", "entity").agg(
        F.count(F.lit(1)).alias("n"), F.sum("begin").alias("begins")
    )


@query("chunk_precedence")
def chunk_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.rank_chunks(fx.span_chunks(spark, sf_dir)).select(
        "doc_id", "begin", "end", "entity", "detector", "rank"
    )


@query("overlap_resolution")
def overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.kept_chunks(merge.resolve_chunks(fx.span_chunks(spark, sf_dir)))


@query("overlap_resolution_blocks")
def overlap_resolution_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of overlapping findings that cross the border between two position blocks."""
    return merge.kept_chunks(merge.resolve_chunks(fx.border_chunks(spark, sf_dir)))


@query("overlap_residual")
def overlap_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of dropped findings that no kept one covers."""
    spans = merge.residual_spans(merge.resolve_chunks(fx.span_chunks(spark, sf_dir)))
    return spans.select("doc_id", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("position"))


@query("overlap_resolution_notes")
def overlap_resolution_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved_notes(spark, sf_dir)


@query("duplicate_chunks")
def duplicate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = fx.span_chunks(spark, sf_dir).withColumn("end", F.lit(70)).withColumn(
        "begin", F.shiftright("begin", 4)
    ).withColumn("chunk", F.concat(F.lit("c"), F.col("begin").cast("string")))
    return merge.drop_duplicate_chunks(wide)


@query("documents_with_findings")
def documents_with_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_by_findings(fx.note_docs(spark, sf_dir), CONTEXT_RULES, True).select("doc_id")


@query("documents_without_findings")
def documents_without_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_by_findings(fx.note_docs(spark, sf_dir), CONTEXT_RULES, False).select("doc_id")


@query("documents_with_foreign_findings")
def documents_with_foreign_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a finding among those of another table."""
    orders = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return stats.with_findings(orders, fx.span_chunks(spark, sf_dir).where("entity = 'VIN'"))


# ---------------------------------------------------------------- annotations


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.note_docs(spark, sf_dir).select(
        "doc_id", ann.annotations(rule_findings(F.col("text"), CONTEXT_RULES)).alias("ner_chunk")
    )


@query("nested_fields")
def nested_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotated(spark, sf_dir).select(
        "doc_id",
        F.size("ner_chunk.result").alias("n"),
        F.array_join(F.array_sort("ner_chunk.result"), "|").alias("results"),
    )


@query("zip_explode")
def zip_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.explode_annotations(_annotated(spark, sf_dir), "ner_chunk", "doc_id")


@query("finisher")
def finisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted annotations run together to one string."""
    return _annotated(spark, sf_dir).select(
        "doc_id",
        ann.finished(
            F.transform(F.array_sort("ner_chunk.result"), lambda r: F.struct(r.alias("result")))
        ).alias("finished"),
    )


# ---------------------------------------------------------------- de-identification


def _surrogates(spark: SparkSession, sf_dir: str, policy=None) -> DataFrame:
    return deid.with_salt(_resolved_notes(spark, sf_dir), CHECK_SALT).select(
        "doc_id", "begin", "entity", "chunk",
        deid.replacement(F.col("entity"), F.col("chunk"), F.col(deid.SALT), policy).alias("surrogate"),
    )


@query("obfuscate")
def obfuscate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _surrogates(spark, sf_dir)


@query("obfuscate_by_policy")
def obfuscate_by_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _surrogates(spark, sf_dir, CHECK_POLICY)


@query("same_length_surrogates")
def same_length_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _surrogates(spark, sf_dir).filter(F.col("entity").isin("PHONE", "IDNUM")).select(
        "doc_id", "entity", "chunk", "surrogate",
        (F.length("chunk") == F.length("surrogate")).alias("same_length"),
    )


@query("consistent_surrogates")
def consistent_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surrogates per finding text; always one, whatever document it is in."""
    return _surrogates(spark, sf_dir).groupBy("entity", "chunk").agg(
        F.countDistinct("surrogate").alias("surrogates"), F.count(F.lit(1)).alias("n")
    )


@query("deidentify_text")
def deidentify_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deidentify_text(
        fx.note_docs(spark, sf_dir), CHECK_SALT, RULE_LABELS, CHECK_POLICY, CONTEXT_RULES
    ).select("doc_id", "deidentified")


@query("deidentify_documents")
def deidentify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with phones and e-mails masked; a digest stands for the text."""
    return deidentify_text(
        fx.documents(spark, sf_dir), CHECK_SALT, ["PHONE", "EMAIL"], {"PHONE": "mask_label", "EMAIL": "mask_label"}
    ).select("doc_id", F.md5("deidentified").alias("digest"), F.length("deidentified").alias("characters"))


@query("deidentify_with_dictionary")
def deidentify_with_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule findings together with those of a dictionary join."""
    docs = fx.note_docs(spark, sf_dir)
    extra = dictionary.dictionary_chunks(docs, _dictionary(spark, sf_dir))
    return deidentify_text(
        docs, CHECK_SALT, ("PATIENT", "COUNTRY", "SSN"),
        {"PATIENT": "mask_label", "COUNTRY": "mask_label", "SSN": "mask_label"},
        CONTEXT_RULES, extra_chunks=extra,
    ).select("doc_id", "deidentified")


@query("count_entities_all_detectors")
def count_entities_all_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by label when a dictionary's findings take part in overlaps."""
    docs = fx.note_docs(spark, sf_dir)
    extra = dictionary.dictionary_chunks(docs, _dictionary(spark, sf_dir))
    return count_entities(find_entities(docs, ("PATIENT", "COUNTRY", "SSN"), CONTEXT_RULES, extra_chunks=extra))


@query("policy_skip_overlap")
def policy_skip_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skipped label must not shield the digits of another one that it overlaps."""
    return deidentify_text(
        fx.note_docs(spark, sf_dir), CHECK_SALT, ("ZIP", "MEDICALRECORD"),
        {"ZIP": "skip", "MEDICALRECORD": "mask_label"}, CONTEXT_RULES,
    ).select("doc_id", "deidentified")


@query("metadata_deidentify")
def metadata_deidentify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as maps, plus a name and a note that need scrubbing."""
    events = fx.table(spark, sf_dir, "events")
    full = F.map_concat(
        F.from_json("props", "map<string,string>"),
        F.create_map(
            F.lit("PatientName"), F.concat(F.lit("user "), F.col("user_id").cast("string")),
            F.lit("comment"), F.concat(F.lit("SSN 123-45-"), F.lpad(F.pmod("event_id", F.lit(10000)).cast("string"), 4, "0")),
        ),
    )
    frame = fx.spread(events).select("event_id", full.alias("metadata"))
    clean = metadata.deidentify_metadata(
        frame, CHECK_SALT, {"PatientName": "NAME"}, labels=["SSN"], policy={"SSN": "mask_label"}, rules=CONTEXT_RULES
    )
    return clean.select(
        "event_id", F.col("metadata")["k"].alias("k"), F.col("metadata")["PatientName"].alias("patient_name"),
        F.col("metadata")["comment"].alias("comment"),
    )


# ---------------------------------------------------------------- pages and images


@query("pages_per_file")
def pages_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("path"), "page_id"
    )
    return imaging.pages_per_file(pages)


@query("adaptive_threshold")
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = imaging.adaptive_threshold(fx.pixel_rows(spark, sf_dir))
    return rows.select("image_id", "y", F.array_join(F.transform("px", lambda v: v.cast("string")), ",").alias("px"))


@query("page_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.word_offsets(fx.page_words(spark, sf_dir)).select("page_id", "text", F.inline("words"))


def _page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved_notes(spark, sf_dir).withColumnRenamed("doc_id", "page_id")


@query("interval_join")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = imaging.overlap_join(_page_chunks(spark, sf_dir), fx.word_boxes(spark, sf_dir))
    return pairs.select("page_id", "entity", "begin", "end", "word_id", "b", "e")


PAGE_WIDTH = 640


@query("position_regions")
def position_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = fx.word_boxes(spark, sf_dir)
    sizes = boxes.groupBy("page_id").agg(
        F.lit(PAGE_WIDTH).alias("width"), F.max(F.col("y") + F.col("h")).alias("height")
    )
    return imaging.find_regions(_page_chunks(spark, sf_dir), boxes, page_sizes=sizes)


@query("position_realign")
def position_realign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings whose offsets drifted, moved back to the nearest place of their characters in the page's text."""
    pages = fx.note_docs(spark, sf_dir).select(F.col("doc_id").alias("page_id"), F.trim("text").alias("text"))
    drift = F.col("page_id").cast("int") % 150
    moved = _page_chunks(spark, sf_dir).select(
        "page_id", "chunk", "entity", (F.col("begin") + drift).alias("begin"), (F.col("end") + drift).alias("end")
    )
    return imaging.realign_chunks(moved, pages)


@query("fill_regions")
def fill_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = imaging.fill_regions(fx.pixel_rows(spark, sf_dir), fx.image_regions(spark, sf_dir))
    return rows.select("image_id", "y", F.array_join(F.transform("px", lambda v: v.cast("string")), ",").alias("px"))


@query("redacted_output")
def redacted_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Painted pixel rows written to one folder per image and read back."""
    rows = imaging.fill_regions(fx.pixel_rows(spark, sf_dir), fx.image_regions(spark, sf_dir))
    path = writers.scratch_path(spark, "images")
    writers.write_per_file(rows.withColumn("path", F.concat(F.lit("image/"), F.col("image_id").cast("string"))), path)
    back = spark.read.parquet(path)
    return back.groupBy("path").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.aggregate("px", F.lit(0).cast("bigint"), lambda a, v: a + v)).alias("brightness"),
    )


@query("deidentify_pages")
def deidentify_pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character rasters of the notes with the findings blacked out."""
    result = deidentify_pages(
        fx.page_pixels(spark, sf_dir), fx.page_words(spark, sf_dir),
        fx.word_boxes(spark, sf_dir, 1, 1).drop("b", "e"), RULE_LABELS, CONTEXT_RULES,
    )
    return result.pixels.select(
        "image_id", "y",
        F.array_join(F.transform("px", lambda v: F.when(v == 0, "#").otherwise(F.char(v))), "").alias("line"),
    )


# ---------------------------------------------------------------- statistics


@query("count_entities")
def count_entities_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by label: the flagship."""
    return count_entities(_resolved_notes(spark, sf_dir))


@query("total_entities_and_characters")
def total_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.chunk_totals(_resolved_notes(spark, sf_dir))


def _file_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.spread(fx.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), "text"))
    done = docs.withColumn("chunks", findings(F.col("text"), ["PHONE", "EMAIL"], PATTERN_RULES))
    return stats.file_statistics(done)


@query("file_statistics")
def file_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_statistics(spark, sf_dir)


def _page_result(spark: SparkSession, sf_dir: str):
    """Notes as pages of a file for each customer segment; one word of every tenth page has no box."""
    words, boxes = fx.page_words(spark, sf_dir), fx.word_boxes(spark, sf_dir, 1, 1).drop("b", "e")
    boxes = boxes.where("page_id % 10 <> 0 or word_id <> 2")
    files = words.select("page_id").distinct().withColumn("path", F.concat(F.lit("file/"), F.col("page_id") % 7))
    return deidentify_pages(
        fx.page_pixels(spark, sf_dir), words, boxes, RULE_LABELS, CONTEXT_RULES, files=files
    )


@query("page_count")
def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the image entry point's result."""
    return _page_result(spark, sf_dir).pages


@query("file_totals")
def file_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, findings and characters of each file of the image entry point."""
    return _page_result(spark, sf_dir).files


@query("unplaced_findings")
def unplaced_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that touch a word without a box, so that no region covers them whole."""
    return _page_result(spark, sf_dir).unplaced.select("page_id", "begin", "end", "entity")


# ---------------------------------------------------------------- taggers


@query("tags_to_chunks")
def tags_to_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the rule findings, turned back into findings, all on the notes' rows."""
    docs = with_findings_on_row(fx.note_docs(spark, sf_dir), RULE_LABELS, CONTEXT_RULES)
    docs = docs.withColumn("toks", tagging.token_array(F.col("text")))
    docs = docs.withColumn("tags", tagging.tags_of_findings(F.col("toks"), F.col("resolved.kept")))
    return chunk_table(docs, tagging.tag_runs(F.col("toks"), F.col("tags"), F.col("text")))


@query("stray_tags_to_chunks")
def stray_tags_to_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags by token length, with stray continuations and label changes."""
    docs = fx.turns(spark, sf_dir).withColumn("toks", tagging.token_array(F.col("text")))
    n = lambda t: F.length(t["token"]) % 5
    tag = lambda t: F.when(n(t) == 0, "B-NAME").when(n(t) == 1, "I-NAME").when(n(t) == 2, "I-CITY").otherwise("O")
    return chunk_table(docs.withColumn("tags", F.transform("toks", tag)), tagging.tag_runs(F.col("toks"), F.col("tags")))


def _name_scores(sentences: list[list[str]]) -> list[np.ndarray]:
    """A stand-in model: a capitalised word that does not open its sentence belongs to a name."""
    capital = re.compile(r"[A-Z][a-z]+")
    return [np.array([(0, 1, 2) if i and capital.fullmatch(t) else (1, 0, 0) for i, t in enumerate(s)]) for s in sentences]


NAME_TAGS = ("O", "B-CONTACT", "I-CONTACT")


def _tagged_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.tag_sentences(tagging.sentence_table(_admission_docs(spark, sf_dir)), _name_scores, NAME_TAGS)


@query("tag_tokens")
def tag_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a small model that sees whole sentences; only legal sequences come out."""
    return _tagged_sentences(spark, sf_dir).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("deidentify_with_tagger")
def deidentify_with_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model, legal tags, findings, label rename, overlaps with pattern findings, rewriting."""
    rules = (PATTERN_RULES_BY_ENTITY["DATE"], PATTERN_RULES_BY_ENTITY["URL"])
    extra = tagging.tagger_chunks(_tagged_sentences(spark, sf_dir))
    masks = {"PHONE": "mask_label", "DATE": "mask_label", "URL": "mask_label"}
    done = deidentify_text(_admission_docs(spark, sf_dir), CHECK_SALT, ("CONTACT", "DATE", "URL"), masks, rules, extra_chunks=extra)
    return done.select("doc_id", "deidentified")


@query("weak_tags")
def weak_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags a tagger is trained on, counted."""
    docs = with_findings_on_row(fx.note_docs(spark, sf_dir), RULE_LABELS, CONTEXT_RULES)
    docs = docs.withColumn("toks", tagging.token_array(F.col("text")))
    tags = docs.select(F.explode(tagging.tags_of_findings(F.col("toks"), F.col("resolved.kept"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("trained_tagger")
def trained_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token classifier fitted on weak tags; its agreement with them by tag."""
    docs = fx.note_docs(spark, sf_dir)
    weak = tagging.weak_tags(tagging.token_table(docs), _resolved_notes(spark, sf_dir)).persist()
    model = tagging.train_tagger(weak, iterations=5)
    scored = tagging.apply_tagger(weak.withColumnRenamed("tag", "weak"), model)
    return scored.groupBy("weak").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("weak") == F.col("tag")).cast("int")).alias("agree")
    )


# ---------------------------------------------------------------- composition and streams


@query("pipeline_composition")
def pipeline_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    find = lambda d: find_entities(d, ["SSN", "AGE"], CONTEXT_RULES)
    return compose([find], count_entities)(fx.note_docs(spark, sf_dir))


@query("layer_switch")
def layer_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The input column stays beside the output."""
    done = deidentify_text(fx.note_docs(spark, sf_dir), CHECK_SALT, ["SSN"], {"SSN": "mask_same_length"}, CONTEXT_RULES)
    return done.select("doc_id", "text", "deidentified")


@query("streamed_intake")
def streamed_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of documents taken in as a stream; totals of the written summaries."""
    base = writers.scratch_path(spark, "intake")
    writers.write_text(fx.documents(spark, sf_dir).where("text is not null"), f"{base}/in", "text", WHOLE_FILE_ROWS)
    files = stream_files(spark, f"{base}/in", binary=True)
    run_intake(files, f"{base}/out", f"{base}/state", CHECK_SALT, ["EMAIL", "URL"])
    return spark.read.parquet(f"{base}/out/summary").select(
        F.from_json("summary", "status int, numberOfPages int, numberOfDeidEntities bigint, numberOfChars bigint").alias("s")
    ).agg(
        F.min("s.status").alias("status"),
        F.sum("s.numberOfDeidEntities").alias("entities"),
        F.sum("s.numberOfChars").alias("characters"),
    )


def _event_findings(frame: DataFrame) -> DataFrame:
    return frame.select(F.col("ts").cast("timestamp").alias("ts"), F.upper("event_type").alias("entity"))


@query("windowed_counts")
def windowed_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without_zone(windowed_counts(_event_findings(fx.table(spark, sf_dir, "events"))))


def _without_zone(counts: DataFrame) -> DataFrame:
    """Window starts in the type of the given table."""
    return counts.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("windowed_counts_stream")
def windowed_counts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts on a stream; windows the watermark has not closed are absent."""
    base = writers.scratch_path(spark, "counts")
    events = fx.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    (
        windowed_counts(_event_findings(stream))
        .writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return _without_zone(
        spark.read.schema("window_start timestamp, entity string, count bigint").parquet(f"{base}/out")
    )

"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm import best_fit_packing, decontamination, hard_negatives, hidden_markov, html_extraction, jaccard_join, periodic_runs, pii_supervision, quality_classifier, quality_rules, sentencepiece_lattice, toxicity, url_filters
from veilwork.llm.common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document, and whether they decode to its text."""
    return sentencepiece_lattice.encode(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of every document."""
    return hidden_markov.score(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return jaccard_join.components(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages: a row per document and item."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html_extraction.extract(pages, html_extraction.fit(pages))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op10_pii_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii_supervision.detect(table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 tokens."""
    return best_fit_packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, some of them planted by its id."""
    return periodic_runs.digests(periodic_runs.detect(periodic_runs.planted(table(spark, sf_dir, "documents"))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh carries the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.quantised(table(spark, sf_dir, "embeddings"), F.col("vec_id"), label, F.col("embedding"))
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_quality_classifier, op3_hidden_markov, op4_jaccard_join, op5_toxicity, op6_decontamination, op7_quality_rules, op8_html_extraction, op9_url_filters, op10_pii_supervision, op11_best_fit_packing, op12_periodic_runs, op13_hard_negatives)
}

ORACLE_SQL: dict[str, str] = {"op9_url_filters": url_filters.oracle_sql(), "op12_periodic_runs": periodic_runs.oracle_sql(), "op13_hard_negatives": hard_negatives.oracle_sql()}

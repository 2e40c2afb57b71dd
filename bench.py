"""Headline queries on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from veilwork import fixtures as fx
from veilwork.operators.catalog import CONTEXT_RULES, PATTERN_RULES
from veilwork.operators.imaging import adaptive_threshold
from veilwork.operators.merge import resolve_chunks
from veilwork.operators.rules import rule_findings
from veilwork.plans.queries import CHECK_POLICY, CHECK_SALT, RULE_LABELS
from veilwork.plans.text import chunk_table, count_entities, deidentify_text, find_entities
from veilwork.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM_RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def drain(frame) -> None:
    """Compute every row and column, keep nothing."""
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    from pyspark.sql import functions as F

    spark = local_session(CPUS, shuffle_partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")

    cases = {
        "findings_by_label": lambda: count_entities(
            find_entities(fx.note_docs(spark, SF_DIR), RULE_LABELS, CONTEXT_RULES)
        ),
        "deidentify_notes": lambda: deidentify_text(
            fx.note_docs(spark, SF_DIR), CHECK_SALT, RULE_LABELS, CHECK_POLICY, CONTEXT_RULES
        ).select("doc_id", "deidentified"),
        "patterns_documents": lambda: chunk_table(
            fx.documents(spark, SF_DIR), rule_findings(F.col("text"), PATTERN_RULES)
        ),
        "rules_documents": lambda: chunk_table(
            fx.documents(spark, SF_DIR), rule_findings(F.col("text"), CONTEXT_RULES)
        ),
        "overlap_resolution": lambda: resolve_chunks(fx.span_chunks(spark, SF_DIR)),
        "adaptive_threshold": lambda: adaptive_threshold(fx.pixel_rows(spark, SF_DIR)),
    }
    cold, warm = {}, {}
    for name, build in cases.items():
        start = time.perf_counter()
        drain(build())
        cold[name] = round(time.perf_counter() - start, 3)
        runs = []
        for _ in range(WARM_RUNS):
            start = time.perf_counter()
            drain(build())
            runs.append(time.perf_counter() - start)
        warm[name] = round(statistics.median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "total_warm_seconds",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

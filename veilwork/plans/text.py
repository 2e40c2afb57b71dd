"""Entry points for text: find, rewrite, count.

One row is one document from the scan to the rewritten text.  Finding, resolving
and rewriting are expressions on that row, so the whole job is a map over the input
splits; only counting shuffles, after partial aggregation.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping, Sequence
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions.arrays import empty_array
from veilwork.operators.catalog import (
    CONTEXT_RULES,
    DEFAULT_LABELS,
    LABEL_RENAMES,
    PATTERN_RULES,
    PRECEDENCE,
    SURROGATES,
    WORD_LISTS,
)
from veilwork.operators.deid import SALT, rebuilt_text, with_salt
from veilwork.operators.detectors import context_detectors, detectors_of, labels_without_detector, needed, unknown_labels
from veilwork.operators.dictionary import word_findings
from veilwork.operators.merge import (
    SPAN_TYPE,
    rename_findings,
    accepted_labels,
    resolve_findings,
    whitelist_findings,
)
from veilwork.operators.rules import CHUNK_FIELDS, CHUNK_TYPE, Rule, rule_findings

DEFAULT_RULES = CONTEXT_RULES + PATTERN_RULES
FOUND = "veilwork_findings"


def pruned_rules(rules: Sequence[Rule], labels: Sequence[str]) -> tuple[Rule, ...]:
    """Rules that can yield a requested label; the others would be filtered out anyway."""
    names = {(d.name, d.entity) for d in needed(detectors_of(rules, {}), labels)}
    return tuple(r for r in rules if (r.detector, r.entity) in names)


def check_labels(
    labels: Iterable[str] | None, rules: Sequence[Rule], word_lists: Mapping[str, Sequence[str]], extra: bool
) -> None:
    """Refuse labels nobody knows, and tell a caller of labels that nothing here can find, so that silence is not taken for absence.

    With findings of the caller's own (``extra``) any label may be asked for.
    """
    if extra:
        return
    asked, here = tuple(DEFAULT_LABELS if labels is None else labels), detectors_of(rules, word_lists)
    if unknown := unknown_labels(asked, here):
        raise ValueError(f"unknown label(s) {', '.join(unknown)}; give their findings as extra_chunks")
    if lost := labels_without_detector(asked, here):
        warnings.warn(f"no detector for {', '.join(lost)}; give their findings as extra_chunks", stacklevel=3)


def findings(
    text: Column,
    labels: Iterable[str] | None = None,
    rules: Sequence[Rule] = DEFAULT_RULES,
    word_lists: Mapping[str, Sequence[str]] = WORD_LISTS,
    extra: Column | None = None,
) -> Column:
    """All requested findings of a text, renamed and whitelisted, overlaps still in.

    ``extra`` is an array of findings made elsewhere (a dictionary join, a tagger)
    that already sits on the row.
    """
    wanted = accepted_labels(labels)
    active = pruned_rules(rules, wanted)
    asked = {d.entity for d in needed(detectors_of((), word_lists), wanted)}
    lists = {e: ws for e, ws in word_lists.items() if e in asked}
    parts = [rule_findings(text, active)]
    if lists:
        parts.append(word_findings(text, lists))
    if extra is not None:
        parts.append(F.coalesce(extra, empty_array(CHUNK_TYPE)))
    found = F.concat(*parts) if len(parts) > 1 else parts[0]
    return whitelist_findings(rename_findings(found, context_detectors(rules)), wanted)


# Building these expressions takes thousands of calls to the JVM, and they depend on their
# arguments alone.  Keeping them makes repeated queries and micro-batches start at once.


@lru_cache(maxsize=64)
def _found_column(gateway, text, labels, rules, word_lists, with_extra) -> Column:
    return findings(F.col(text), labels, rules, dict(word_lists), F.col("extra") if with_extra else None)


@lru_cache(maxsize=64)
def _resolved_column(gateway, precedence) -> Column:
    return resolve_findings(F.col(FOUND), precedence)


@lru_cache(maxsize=64)
def _rebuilt_column(gateway, text, policy, surrogates) -> Column:
    return rebuilt_text(F.col(text), F.col("resolved"), F.col(SALT), dict(policy), dict(surrogates))


def _items(mapping: Mapping | None) -> tuple:
    pairs = (mapping or {}).items()
    return tuple((k, v if isinstance(v, str) else tuple(v)) for k, v in pairs)


def _with_resolved(docs: DataFrame, text, labels, rules, word_lists, with_extra, precedence) -> DataFrame:
    """``docs`` with the column ``resolved``.

    Finding and resolving are two projections, which the optimizer merges: as one expression they would take Spark more
    rounds to analyse than it allows.
    """
    gateway = SparkContext._gateway
    found = _found_column(gateway, text, accepted_labels(labels), tuple(rules), _items(word_lists), with_extra)
    resolved = _resolved_column(gateway, tuple(precedence))
    return docs.withColumn(FOUND, found).withColumn("resolved", resolved).drop(FOUND)


def with_findings_on_row(
    docs: DataFrame,
    labels: Iterable[str] | None = None,
    rules: Sequence[Rule] = DEFAULT_RULES,
    text: str = "text",
    precedence: Sequence[tuple[str, str]] = PRECEDENCE,
    word_lists: Mapping[str, Sequence[str]] = WORD_LISTS,
) -> DataFrame:
    """``docs`` with ``resolved``: its disjoint findings (``kept``) and what dropped ones leave bare (``residual``)."""
    return _with_resolved(docs, text, labels, rules, word_lists, False, precedence)


def documents_by_findings(docs: DataFrame, rules: Sequence[Rule], having: bool, text: str = "text") -> DataFrame:
    """Documents in which the rules find something, or those in which they find nothing (null texts among them).

    A test of the findings on the row: one scan, no join.  For findings made elsewhere see ``stats.with_findings``.
    """
    some = F.coalesce(F.size(F.col(FOUND)) > 0, F.lit(False))
    kept = docs.withColumn(FOUND, rule_findings(F.col(text), rules)).where(some if having else ~some)
    return kept.select(*docs.columns)


def chunk_table(docs: DataFrame, found: Column, key: str = "doc_id") -> DataFrame:
    """One row per finding.  The outer form keeps Spark from evaluating ``found`` twice."""
    return docs.select(key, F.inline_outer(found)).filter(F.col("chunk").isNotNull())


def find_entities(
    docs: DataFrame,
    labels: Iterable[str] | None = None,
    rules: Sequence[Rule] = DEFAULT_RULES,
    key: str = "doc_id",
    text: str = "text",
    precedence: Sequence[tuple[str, str]] = PRECEDENCE,
    word_lists: Mapping[str, Sequence[str]] = WORD_LISTS,
    extra_chunks: DataFrame | None = None,
) -> DataFrame:
    """Disjoint findings of every document as ``(key, sent_id, begin, end, chunk, ...)``.

    ``extra_chunks`` are findings of a dictionary join or a tagger; they take part in overlaps like the others.
    """
    check_labels(labels, rules, word_lists, extra_chunks is not None)
    if extra_chunks is not None:
        docs = attach_chunks(docs.select(key, text), extra_chunks, key)
    done = _with_resolved(docs.select(key, text, *(["extra"] if extra_chunks is not None else [])), text, labels, rules, word_lists, extra_chunks is not None, precedence)
    return chunk_table(done, F.col("resolved.kept"), key)


def attach_chunks(docs: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Put a table of findings on its documents' rows as an array column ``extra``.

    The findings are grouped first, so the join moves one row per document that has
    any.  Spark broadcasts that side only if it measures small.
    """
    per_doc = chunks.groupBy(key).agg(F.collect_list(F.struct(*CHUNK_FIELDS)).alias("extra"))
    return docs.join(per_doc, key, "left")


def deidentify_text(
    docs: DataFrame,
    salt: str | DataFrame,
    labels: Iterable[str] | None = None,
    policy: Mapping[str, str] | None = None,
    rules: Sequence[Rule] = DEFAULT_RULES,
    key: str = "doc_id",
    text: str = "text",
    extra_chunks: DataFrame | None = None,
    precedence: Sequence[tuple[str, str]] = PRECEDENCE,
    surrogates: Mapping[str, Sequence[str]] = SURROGATES,
    word_lists: Mapping[str, Sequence[str]] = WORD_LISTS,
) -> DataFrame:
    """``(key, ..., deidentified, chunks)``: every input row with its rewritten text.

    Labels the policy skips are left out before overlaps are resolved, so they never shield another label's finding.
    ``chunks`` are the findings replaced.  The original text column is kept beside
    the new one; drop it before writing.  ``salt`` may be a table of one row, read where the secret is kept; the
    value stands in no plan.
    """
    if isinstance(salt, str) and not salt:
        raise ValueError("a salt is required")
    check_labels(labels, rules, word_lists, extra_chunks is not None)
    # a policy for a label that is renamed holds for the new name too, unless that has one of its own
    policy = {**{LABEL_RENAMES.get(e, e): m for e, m in (policy or {}).items()}, **(policy or {})}
    labels = [x for x in accepted_labels(labels) if (policy or {}).get(x) != "skip"]
    if not labels:
        return docs.withColumns({"deidentified": F.col(text), "chunks": empty_array(CHUNK_TYPE), "residual": empty_array(SPAN_TYPE)})
    if extra_chunks is not None:
        docs = attach_chunks(docs, extra_chunks, key)
    out = with_salt(_with_resolved(docs, text, labels, rules, word_lists, extra_chunks is not None, precedence), salt)
    return out.withColumn(
        "deidentified",
        _rebuilt_column(SparkContext._gateway, text, _items(policy), _items(surrogates)),
    ).select(
        *[c for c in docs.columns if c != "extra"],
        "deidentified",
        F.col("resolved.kept").alias("chunks"),
        F.col("resolved.residual").alias("residual"),
    )


def count_entities(chunks: DataFrame) -> DataFrame:
    """Findings by label, most frequent first; ties in label order."""
    return (
        chunks.groupBy(F.col("entity").alias("ner_label"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "ner_label")
    )

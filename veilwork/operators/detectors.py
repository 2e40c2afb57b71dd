"""The detectors of a request as data: who finds which label, and of what kind it is.

Plans are made from this table: it tells which rules and word lists a request needs, whose labels are renamed (all but those
of context rules, whatever a detector is called), and which labels nothing can find.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from veilwork.operators.catalog import EXTERNAL_LABELS, LABEL_RENAMES
from veilwork.operators.rules import CONTEXT, Rule


@dataclass(frozen=True)
class Detector:
    entity: str
    name: str
    kind: str

    @property
    def label(self) -> str:
        """The label its findings carry in the result."""
        return self.entity if self.kind == CONTEXT else LABEL_RENAMES.get(self.entity, self.entity)


def detectors_of(rules: Sequence[Rule], word_lists: Mapping[str, Sequence[str]]) -> tuple[Detector, ...]:
    return tuple(Detector(r.entity, r.detector, r.kind) for r in rules) + tuple(
        Detector(entity, f"words_{entity}", "words") for entity in word_lists
    )


def needed(detectors: Iterable[Detector], labels: Sequence[str]) -> tuple[Detector, ...]:
    """Detectors that can yield a requested label; findings of the others would be filtered out anyway."""
    return tuple(d for d in detectors if d.label in labels)


def context_detectors(rules: Sequence[Rule]) -> tuple[str, ...]:
    return tuple(sorted({r.detector for r in rules if r.kind == CONTEXT}))


def unknown_labels(labels: Iterable[str], detectors: Iterable[Detector]) -> list[str]:
    """Labels that neither a detector, nor a rename, nor the list of labels for dictionaries and taggers knows."""
    known = {d.entity for d in detectors} | {d.label for d in detectors}
    known |= set(EXTERNAL_LABELS) | set(LABEL_RENAMES) | set(LABEL_RENAMES.values())
    return sorted(set(labels) - known)


def labels_without_detector(labels: Iterable[str], detectors: Iterable[Detector]) -> list[str]:
    """Known labels that only a dictionary or a tagger of the caller can find."""
    found = {d.label for d in detectors} | {d.entity for d in detectors}
    return sorted({x for x in labels if x not in found and LABEL_RENAMES.get(x, x) not in found})

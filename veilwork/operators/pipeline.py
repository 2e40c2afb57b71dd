"""Compose steps: plain functions chained on a frame, or stages of an ML pipeline."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Transformer
from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


class StepTransformer(Transformer):
    """A frame-to-frame function as a pipeline stage, next to stages that are fitted."""

    def __init__(self, step: Step):
        super().__init__()
        self._step = step

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self._step(dataset)


def compose(*steps: Step | Sequence[Step]) -> Step:
    """One step from several; a sequence counts as a nested pipeline."""
    flat = [s if callable(s) else compose(*s) for s in steps]

    def run(frame: DataFrame) -> DataFrame:
        for step in flat:
            frame = frame.transform(step)
        return frame

    return run

"""User stages over events: DataFrame transforms, or Python functions in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame

from strandline.errors import PipelineError


class EventPipeline:
    """Ordered, chainable stages. Column and DataFrame stages stay in the JVM; row
    functions run batch-wise in Python workers, on the driver for ``process``."""

    def __init__(self):
        self.stages: list[tuple[str, object]] = []

    def _add(self, kind: str, stage) -> EventPipeline:
        self.stages.append((kind, stage))
        return self

    def use(self, stage: Callable) -> EventPipeline:
        """A row function event -> event: None drops the row."""
        if not callable(stage):
            raise TypeError("a stage must be callable")
        return self._add("row", stage)

    def transform(self, stage: Callable[[DataFrame], DataFrame]) -> EventPipeline:
        """A DataFrame function; Catalyst optimises across such stages."""
        if not callable(stage):
            raise TypeError("a stage must be callable")
        return self._add("frame", stage)

    def filter(self, predicate) -> EventPipeline:
        """Keeps rows where a Column holds or a row function is true."""
        if isinstance(predicate, Column):
            return self._add("where", predicate)
        if not callable(predicate):
            raise TypeError("a predicate must be a Column or callable")
        return self._add("row", lambda e: e if predicate(e) else None)

    def map(self, function: Callable) -> EventPipeline:
        """Replaces rows; a function that returns None drops the row."""
        return self.use(function)

    def tap(self, handler: Callable) -> EventPipeline:
        """Calls ``handler`` with each row and passes the row on unchanged."""
        if not callable(handler):
            raise TypeError("a handler must be callable")

        def see(event):
            handler(event)
            return event

        return self._add("row", see)

    @property
    def size(self) -> int:
        return len(self.stages)

    def clear(self) -> EventPipeline:
        self.stages.clear()
        return self

    def process(self, event: dict) -> dict | None:
        """One event through the row stages, on the driver."""
        for index, (kind, stage) in enumerate(self.stages):
            if kind != "row":
                raise TypeError("DataFrame stages need apply()")
            event = _run(stage, event, index)
            if event is None:
                return None
        return event

    def process_batch(self, events) -> list[dict]:
        return [x for x in map(self.process, events) if x is not None]

    def apply(self, events: DataFrame) -> DataFrame:
        """All stages over a DataFrame; row stages keep its schema."""
        for index, (kind, stage) in enumerate(self.stages):
            if kind == "where":
                events = events.where(stage)
            elif kind == "frame":
                try:
                    events = stage(events)
                except PipelineError:
                    raise
                except Exception as error:
                    raise PipelineError(f"stage {index} failed: {error}", stage_index=index, cause=error) from error
            else:
                events = events.mapInPandas(_rows(stage, index, events.columns), events.schema)
        return events


def _run(stage, event, index: int):
    try:
        return stage(event)
    except PipelineError:
        raise
    except Exception as error:
        raise PipelineError(f"stage {index} failed: {error}", stage_index=index, cause=error) from error


def _rows(stage, index: int, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # through objects, so that whole numbers with nulls stay whole
            rows = batch.astype(object).where(batch.notna(), None).to_dict("records")
            out = [x for x in (_run(stage, row, index) for row in rows) if x is not None]
            yield pd.DataFrame(out, columns=columns, dtype=object)

    return run

"""JSON-lines and CSV text of events, built by expressions in the JVM."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F, types as T

from strandline.functions.checks import text_of
from strandline.functions.model import EVENT_COLUMNS, canonical

DEFAULT_EXPORT_COLUMNS = list(EVENT_COLUMNS)
FORMATS = ("jsonl", "csv")


def json_line(events: DataFrame, columns: list[str] | None = None) -> Column:
    """A row's JSON; nulls stay, bytes are hex."""
    parts = [(F.lower(F.hex(c)) if isinstance(events.schema[c].dataType, T.BinaryType) else F.col(c)).alias(c) for c in columns or DEFAULT_EXPORT_COLUMNS]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def csv_cell(events: DataFrame, column: str) -> Column:
    """A cell: null is empty, containers are JSON, quotes only where needed."""
    text = canonical(F.col(column), events.schema[column].dataType)
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[",\n\r]'), quoted).otherwise(text), F.lit(""))


def csv_line(events: DataFrame, columns: list[str] | None = None) -> Column:
    return F.concat_ws(",", *[csv_cell(events, c) for c in columns or DEFAULT_EXPORT_COLUMNS])


class Exporter:
    """``format``, ``columns``, ``header()`` and ``encode(event)``; ``lines(events)`` for DataFrames."""

    def __init__(self, format: str = "jsonl", columns: list[str] | None = None):  # noqa: A002
        self.format = str(format).lower()
        if self.format not in FORMATS:
            raise ValueError(f"format must be one of {', '.join(FORMATS)}")
        if columns is not None and (not columns or not all(isinstance(c, str) and c for c in columns)):
            raise TypeError("columns must be non-empty names")
        self.columns = list(columns or DEFAULT_EXPORT_COLUMNS)

    def header(self) -> str | None:
        return ",".join(map(_quote, self.columns)) if self.format == "csv" else None

    def encode(self, event: dict) -> str:
        """One event on the driver."""
        if self.format == "jsonl":
            return json.dumps(event, separators=(",", ":"), ensure_ascii=False, default=text_of)
        return ",".join("" if event.get(c) is None else _quote(text_of(event[c])) for c in self.columns)

    def lines(self, events: DataFrame) -> DataFrame:
        line = json_line(events, self.columns) if self.format == "jsonl" else csv_line(events, self.columns)
        return events.select(line.alias("line"))


def _quote(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in '",\n\r') else text


def create_exporter(format: str = "jsonl", columns: list[str] | None = None) -> Exporter:  # noqa: A002
    return Exporter(format, columns)


def write_export(events: DataFrame, path: str, **options) -> None:
    """Distributed text files; CSV files each begin with the header."""
    out = Exporter(**options)
    text = out.lines(events)
    if out.header() is not None:
        head = out.header()

        def with_head(batches):
            import pyarrow as pa

            yield pa.RecordBatch.from_pydict({"line": [head]})
            yield from batches

        text = text.mapInArrow(with_head, "line string")
    text.write.mode("overwrite").text(path)


def export_stream(events: DataFrame, **options) -> Iterator[str]:
    """Lines one by one, header first, holding one partition at a time."""
    out = Exporter(**options)
    if out.header() is not None:
        yield out.header() + "\n"
    for row in out.lines(events).toLocalIterator():
        yield row["line"] + "\n"


def export_events(events: DataFrame, **options) -> str:
    """All lines as one text, for small results."""
    return "".join(export_stream(events, **options))

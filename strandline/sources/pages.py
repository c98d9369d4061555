"""A Python data source over recorded event pages (JSON files), for batch and streams.

A page is ``{"events": [...], "cursor": ...}``. Pages of a folder form a chain in
name order, as a remote source would serve them: reading stops at a missing cursor, an
unchanged cursor is an error, an empty page with a new cursor goes on. Files are
planned as one partition per ``pagesperpartition`` pages; ledger bounds given as
options or pushed filters skip rows inside the reader.

    read_pages(spark, folder).where("ledger >= 100")
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from strandline.functions.checks import text_of
from strandline.functions.decode import MAX_DEPTH, unwrap_or_raw

_SCHEMA = "id string, type string, ledger long, ledgerClosedAt string, contractId string, transactionIndex long, operationIndex long, txHash string, topics array<string>, value string, inSuccessfulContractCall boolean"


class PageError(ValueError):
    """A page chain that does not advance, or a page that is not one."""


def decode_event(raw: dict, max_depth: int = MAX_DEPTH) -> tuple:
    """The 11 envelope values of a raw record; aliases are read, unknown keys dropped."""
    first = lambda *names: next((raw[n] for n in names if raw.get(n) is not None), None)
    number = lambda x: None if x is None else int(x)
    text = lambda x: None if x is None else text_of(x)
    topics = first("topics", "topic")
    value = unwrap_or_raw(raw.get("value"), max_depth)
    value = None if value is None else value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False, default=text_of)
    ok = raw.get("inSuccessfulContractCall")
    return (
        text(raw.get("id")), text(raw.get("type")), number(raw.get("ledger")), text(raw.get("ledgerClosedAt")), text(raw.get("contractId")),
        number(first("transactionIndex", "txIndex")), number(first("operationIndex", "opIndex")), text(first("txHash", "transactionHash")),
        None if topics is None else [text_of(unwrap_or_raw(t, max_depth)) for t in topics], value, True if ok is None else bool(ok),
    )


def page_files(path: str) -> list[str]:
    return sorted(str(p) for p in Path(path).glob("*.json"))


def read_page(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        page = json.load(f)
    if not isinstance(page, dict) or not isinstance(page.get("events"), list):
        raise PageError(f"{path} is not a page")
    return page


def chain(files: list[str]) -> list[str]:
    """The pages that belong to the chain."""
    out, before = [], object()
    for path in files:
        cursor = read_page(path).get("cursor")
        if cursor is not None and cursor == before:
            raise PageError(f"the cursor does not advance at {path}")
        out.append(path)
        if cursor is None:
            break
        before = cursor
    return out


class _Span(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.per = options["path"], int(options.get("pagesperpartition", 8))
        self.depth = int(options.get("maxdepth", MAX_DEPTH))
        self.low, self.high = int(options.get("startledger", 0)), int(options.get("endledger", 1 << 62))

    def partitions(self):
        files = chain(page_files(self.path))
        return [_Span(files[i : i + self.per]) for i in range(0, len(files), self.per)] or [_Span([])]

    def read(self, partition):
        for path in partition.files:
            for raw in read_page(path)["events"]:
                ledger = raw.get("ledger")
                if ledger is None or self.low <= ledger <= self.high:
                    yield decode_event(raw, self.depth)


class FilteringPagesReader(PagesReader):
    """Takes ledger bounds from the query; Spark allows it where its setting is on."""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("ledger",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (GreaterThanOrEqual, GreaterThan, EqualTo)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThanOrEqual, LessThan, EqualTo)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            yield f  # Spark checks all filters again: the reader only skips early


class PagesStreamReader(DataSourceStreamReader):
    """Offsets are ledgers, so a micro-batch always ends on a ledger's border."""

    def __init__(self, options: dict):
        self.path, self.start = options["path"], int(options.get("startledger", 1))
        self.depth = int(options.get("maxdepth", MAX_DEPTH))

    def initialOffset(self):  # noqa: N802
        return {"ledger": self.start}

    def latestOffset(self):  # noqa: N802
        head = max((raw["ledger"] for p in page_files(self.path) for raw in read_page(p)["events"] if raw.get("ledger") is not None), default=self.start - 1)
        return {"ledger": max(self.start, head + 1)}

    def partitions(self, start: dict, end: dict):
        return [_Range(f, start["ledger"], end["ledger"]) for f in page_files(self.path)]

    def read(self, partition):
        for raw in read_page(partition.files[0])["events"]:
            if raw.get("ledger") is not None and partition.low <= raw["ledger"] < partition.high:
                yield decode_event(raw, self.depth)

    def commit(self, end: dict) -> None:
        pass


class _Range(_Span):
    def __init__(self, path: str, low: int, high: int):
        super().__init__([path])
        self.low, self.high = low, high


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledger_pages"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> PagesReader:
        return (FilteringPagesReader if self.options.get("pushdown") == "true" else PagesReader)(self.options)

    def streamReader(self, schema) -> PagesStreamReader:  # noqa: N802
        return PagesStreamReader(self.options)


def read_pages(spark, path: str, **options):
    """The pages of a folder as a DataFrame, with ledger filters pushed into the reader."""
    spark.dataSource.register(PagesSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("ledger_pages").option("path", path).option("pushdown", "true").options(**options).load()

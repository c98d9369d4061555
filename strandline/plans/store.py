"""A keyed event table on plain Parquet: versions of ledger buckets and one pointer.

Every write makes a new version that lists, for each bucket of ledgers, the folder
that holds it. An upsert rewrites only the buckets its ids lie in now or lay in before;
all other folders are shared with the version before. Readers see a version only once the
pointer file is replaced, so a lost driver leaves the old table whole.
"""

from __future__ import annotations

import json
import uuid
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from strandline.errors import EventStoreError
from strandline.functions.checks import span, whole
from strandline.functions.model import BUCKET_SPAN, EVENT_COLUMNS, EVENT_SCHEMA, bucket
from strandline.functions.shared import shared_folder
from strandline.operators.dedupe import keep_first
from strandline.operators.ordering import event_order
from strandline.operators.predicates import event_filter


@runtime_checkable
class EventStore(Protocol):
    def put(self, events): ...
    def get(self, ident: str): ...
    def has(self, ident: str) -> bool: ...
    def delete(self, ident: str) -> bool: ...
    def clear(self) -> None: ...
    def count(self) -> int: ...
    def list(self, **options): ...


def is_event_store(x) -> bool:
    return isinstance(x, EventStore)


def assert_event_store(x):
    if not is_event_store(x):
        raise TypeError("an event store has put, get, has, delete, clear, count and list")
    return x


class ParquetEventStore:
    """``root`` is a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # the pointer: bucket -> folder

    def _version(self) -> dict[int, str]:
        path = self._path(f"{self.root}/_CURRENT")
        if not self._fs.exists(path):
            return {}
        stream = self._fs.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            return {int(k): v for k, v in json.loads(text).items()}
        except ValueError as error:
            raise EventStoreError("the store's pointer is corrupt", cause=error) from error

    def _commit(self, buckets: dict[int, str]) -> None:
        temp, final = self._path(f"{self.root}/_next-{uuid.uuid4().hex}"), self._path(f"{self.root}/_CURRENT")
        out = self._fs.create(temp, True)
        try:
            out.write(json.dumps({str(k): v for k, v in sorted(buckets.items())}).encode())
            out.hsync()
        finally:
            out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temp, final, rename)

    def _read(self, folders: dict[int, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], EVENT_SCHEMA)
        return self.spark.read.schema(EVENT_SCHEMA).parquet(*[f"{self.root}/{v}" for v in folders.values()])

    def table(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """All events, or those of a ledger range, reading only its buckets."""
        low, high = (None if x is None else x // BUCKET_SPAN for x in (start, end))
        return self._read({k: v for k, v in self._version().items() if (low is None or k >= low) and (high is None or k <= high)})

    # writes

    def _replace(self, rows: DataFrame, touched: set[int], before: dict[int, str]) -> None:
        """Writes ``rows`` as the new content of the touched buckets and points to it."""
        name = f"v-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", bucket("ledger")).write.partitionBy("_bucket").parquet(f"{self.root}/{name}")
        made = {int(s.getPath().getName().partition("=")[2]): f"{name}/{s.getPath().getName()}" for s in self._fs.listStatus(self._path(f"{self.root}/{name}")) if s.isDirectory() and "=" in s.getPath().getName()}
        self._commit({k: v for k, v in before.items() if k not in touched} | made)

    def put(self, events, version: str | None = None) -> int:
        """Upserts rows by id; the last row of an id wins, by ``version`` if named.

        Takes a DataFrame, or dicts of the driver. Returns how many ids were put.
        """
        if not isinstance(events, DataFrame):
            items = [events] if isinstance(events, dict) else list(events)
            rows = [tuple(x.get(c) for c in EVENT_COLUMNS) + (i,) for i, x in enumerate(items)]
            events, version = self.spark.createDataFrame(rows, _with_order()), "_put"
        bad = events.where("id is null or ledger is null or ledger < 1").limit(1).count()
        if bad:
            raise ValueError("stored events need an id and a positive ledger")
        order = [F.col(version).desc_nulls_last()] if version else event_order("store", descending=True)
        new = keep_first(events, ["id"], order, keep_null_keys=False).select(*EVENT_COLUMNS)
        before = self._version()
        ids = new.select("id")
        # an id may have moved to another ledger: its old bucket is rewritten too
        old = self._read(before).join(ids, "id", "left_semi").select(bucket("ledger").alias("b"))
        touched = {r.b for r in new.select(bucket("ledger").alias("b")).unionByName(old).distinct().collect()}
        kept = self._read({k: v for k, v in before.items() if k in touched}).join(ids, "id", "left_anti")
        self._replace(kept.select(*EVENT_COLUMNS).unionByName(new), touched, before)
        return new.count()

    def delete_where(self, condition) -> int:
        before = self._version()
        hit = self._read(before).where(condition)
        counts = hit.groupBy(bucket("ledger").alias("b")).count().collect()
        touched = {r.b for r in counts}
        if touched:
            gone = F.coalesce(condition, F.lit(False))
            self._replace(self._read({k: v for k, v in before.items() if k in touched}).where(~gone), touched, before)
        return sum(r["count"] for r in counts)

    def delete(self, ident: str) -> bool:
        return self.delete_where(F.col("id") == ident) > 0

    def delete_range(self, start: int, end: int) -> int:
        """Deletes all events of an inclusive ledger range; returns how many."""
        span(start, end)
        return self.delete_where(F.col("ledger").between(start, end))

    def clear(self) -> None:
        self._commit({})

    def vacuum(self) -> int:
        """Deletes bucket folders that the current version does not use; returns how many."""
        used, gone = set(self._version().values()), 0
        for version in [s.getPath() for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("v-")]:
            parts = [s.getPath() for s in self._fs.listStatus(version) if s.isDirectory()]
            stale = [p for p in parts if f"{version.getName()}/{p.getName()}" not in used]
            for path in stale if len(stale) < len(parts) else [version]:
                self._fs.delete(path, True)
            gone += len(stale)
        return gone

    # reads

    def get(self, ident: str) -> dict | None:
        row = self.table().where(F.col("id") == ident).first()
        return row.asDict(recursive=True) if row else None

    def has(self, ident: str) -> bool:
        return not self.table().where(F.col("id") == ident).isEmpty()

    def count(self) -> int:
        return self.table().count()

    def list(self, *, start_ledger=None, end_ledger=None, limit: int | None = None, order: str = "store", **filters) -> DataFrame:
        """Ordered events of a range. No limit means all; ``order`` is "store" or "table"."""
        start, end = span(start_ledger, end_ledger)
        rows = self.table(start, end).where(event_filter(start_ledger=start, end_ledger=end, **filters)).orderBy(*event_order(order))
        return rows if limit is None else rows.limit(whole("limit", limit, 1))


def _with_order():
    return T.StructType([*EVENT_SCHEMA.fields, T.StructField("_put", T.IntegerType())])


class MemoryEventStore(ParquetEventStore):
    """The same store in a new folder of the session's shared ones, for one job's results."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark, shared_folder(spark, "store"))

"""Registered queries of the event engine over the test tables, with their DuckDB SQL.

The ``events`` table becomes ledger events by one derivation, written once in Spark
and once in SQL: ten minutes are a ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.functions import decode
from strandline.functions.model import EVENT_COLUMNS, decode_events
from strandline.functions.shared import shared_folder
from strandline.operators import consistency, dedupe, export, handoff, metrics, predicates, query, reorg, windows
from strandline.operators.ordering import event_order, newest
from strandline.plans import deadletter
from strandline.plans.checkpoint import CheckpointManager
from strandline.plans.pipeline import EventPipeline
from strandline.sources.events import EventSource

_EPOCH = 1704067200000000
_TEN_MINUTES = 600_000_000


def ledger_events(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    """Ledger events of the ``events`` table; ``sparse`` has repeated and missing indices."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    index = F.when(F.col("event_id") % 11 != 0, F.col("user_id") % 7) if sparse else F.col("user_id")
    return raw.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("type"),
        F.expr(f"1 + (unix_micros(cast(ts as timestamp)) - {_EPOCH}) div {_TEN_MINUTES}").alias("ledger"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ledgerClosedAt"),
        F.concat(F.lit("C"), (F.col("user_id") % 20).cast("string")).alias("contractId"),
        index.alias("transactionIndex"),
        (F.lit(None).cast("long") if sparse else F.col("event_id")).alias("operationIndex"),
        F.md5(F.col("user_id").cast("string").cast("binary")).alias("txHash"),
        F.array("event_type", F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("topics"),
        F.get_json_object("props", "$.k").alias("value"),
        F.lit(True).alias("inSuccessfulContractCall"),
    )


def ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ledgers with hashes; every 97th has a broken link."""
    rows = ledger_events(spark, sf_dir).select(F.col("ledger").alias("sequence")).distinct()
    own = rows.withColumn("hash", F.md5(F.col("sequence").cast("string").cast("binary")))
    # the link names the ledger just before, whether or not it has events
    link = F.when(F.col("sequence") % 97 == 0, "broken").otherwise(F.md5((F.col("sequence") - 1).cast("string").cast("binary")))
    return own.withColumn("previousHash", link).withColumn("arrival", (F.col("sequence") + F.when(F.col("sequence") % 50 == 0, 2).otherwise(0)) * 10 + F.col("sequence") % 10)


_EVENTS = f"""
WITH e AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_type AS type,
         1 + (epoch_us(ts) - {_EPOCH}) // {_TEN_MINUTES} AS ledger,
         strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ledgerClosedAt,
         'C' || CAST(user_id % 20 AS VARCHAR) AS contractId,
         user_id AS transactionIndex, event_id AS operationIndex,
         md5(CAST(user_id AS VARCHAR)) AS txHash,
         [event_type, 'u' || CAST(user_id AS VARCHAR)] AS topics,
         json_extract_string(props, '$.k') AS value, true AS inSuccessfulContractCall
  FROM events),
s AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_type AS type,
         1 + (epoch_us(ts) - {_EPOCH}) // {_TEN_MINUTES} AS ledger,
         CASE WHEN event_id % 11 <> 0 THEN user_id % 7 END AS transactionIndex
  FROM events),
l AS (
  SELECT sequence, md5(CAST(sequence AS VARCHAR)) AS hash,
         CASE WHEN sequence % 97 = 0 THEN 'broken' ELSE md5(CAST(sequence - 1 AS VARCHAR)) END AS previousHash,
         (sequence + CASE WHEN sequence % 50 = 0 THEN 2 ELSE 0 END) * 10 + sequence % 10 AS arrival
  FROM (SELECT DISTINCT ledger AS sequence FROM e))
"""

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_FLAT = "id, type, ledger, contractId, transactionIndex, operationIndex, txHash, value"
_FLAT_COLS = [c.strip() for c in _FLAT.split(",")]


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (_EVENTS if not sql.lstrip().startswith("WITH") and not sql.lstrip().startswith("--plain") else "") + sql.replace("--plain", "")
        return f

    return add


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*_FLAT_COLS)


# scans


@registered(f"SELECT {_FLAT} FROM e WHERE ledger BETWEEN 100 AND 900")
def range_scan(spark, sf_dir):
    return _flat(EventSource(ledger_events(spark, sf_dir)).events_windowed(100, 900, limit=None))


@registered(f"SELECT {_FLAT} FROM e WHERE ledger BETWEEN 100 AND 900 ORDER BY ledger, transactionIndex, operationIndex, id LIMIT 100")
def range_scan_limit(spark, sf_dir):
    return _flat(EventSource(ledger_events(spark, sf_dir)).events_windowed(100, 900))


@registered(f"SELECT {_FLAT} FROM e WHERE type = 'purchase' AND contractId = 'C3' AND ledger >= (SELECT greatest(1, max(ledger) - 50000) FROM e) ORDER BY ledger DESC, transactionIndex DESC, operationIndex DESC, id DESC LIMIT 25")
def tail_newest(spark, sf_dir):
    return _flat(EventSource(ledger_events(spark, sf_dir)).tail("C3", 25, type="purchase"))


@registered(f"SELECT {_FLAT} FROM e WHERE ledger BETWEEN 10 AND 2000 ORDER BY ledger DESC, transactionIndex DESC, operationIndex DESC, id DESC LIMIT 40")
def newest_in_window(spark, sf_dir):
    return _flat(EventSource(ledger_events(spark, sf_dir)).newest_in(10, 2000, 40))


@registered("SELECT max(sequence) AS sequence, max_by(hash, sequence) AS hash FROM l")
def latest_ledger(spark, sf_dir):
    return EventSource(ledger_events(spark, sf_dir), ledgers(spark, sf_dir)).head().select("sequence", "hash")


@registered("SELECT 'healthy' AS status, max(ledger) AS latestLedger, min(ledger) AS oldestLedger, max(ledger) - min(ledger) + 1 AS ledgerRetentionWindow FROM e")
def health_retention(spark, sf_dir):
    return EventSource(ledger_events(spark, sf_dir)).health()


@registered("SELECT sequence, hash, previousHash FROM l WHERE sequence BETWEEN 10 AND 90 ORDER BY sequence LIMIT 1000")
def ledger_history(spark, sf_dir):
    source = EventSource(ledger_events(spark, sf_dir), ledgers(spark, sf_dir))
    return source.ledger_history(10, 90, allow_gaps=True).select("sequence", "hash", "previousHash")


@registered("SELECT 98 AS startLedger, 3000 AS endLedger, count(*) AS count, max(sequence) AS lastSequence, max_by(hash, sequence) AS lastHash FROM l WHERE sequence BETWEEN 98 AND 3000")
def verify_history(spark, sf_dir):
    return consistency.verify_history(ledgers(spark, sf_dir), 98, 3000)


@registered(f"SELECT {_FLAT}, array_to_string(topics, '|') AS topics, inSuccessfulContractCall FROM e")
def decode_envelope(spark, sf_dir):
    raw = ledger_events(spark, sf_dir).withColumnRenamed("topics", "topic").withColumnRenamed("txHash", "transactionHash").drop("inSuccessfulContractCall").withColumn("extra", F.lit(1))
    return decode_events(raw).select(*_FLAT_COLS, F.array_join("topics", "|").alias("topics"), "inSuccessfulContractCall")


# predicates


@registered(f"SELECT {_FLAT} FROM e WHERE contractId IN ('C1', 'C7')")
def filter_contract_in(spark, sf_dir):
    return _flat(predicates.filter_events(ledger_events(spark, sf_dir), contract_id=["C1", "C7"]))


@registered(f"SELECT {_FLAT} FROM e WHERE type IN ('click', 'error')")
def filter_type_in(spark, sf_dir):
    return _flat(predicates.filter_events(ledger_events(spark, sf_dir), type=["click", "error"]))


@registered(f"SELECT {_FLAT} FROM e WHERE txHash = md5('17')")
def filter_txhash(spark, sf_dir):
    import hashlib

    return _flat(predicates.filter_events(ledger_events(spark, sf_dir), tx_hash=hashlib.md5(b"17").hexdigest()))


@registered(f"SELECT {_FLAT} FROM e WHERE list_has_any(topics, ['u5', 'u9'])")
def filter_topic_any(spark, sf_dir):
    return _flat(predicates.filter_events(ledger_events(spark, sf_dir), topic=["u5", "u9"]))


@registered(f"SELECT {_FLAT} FROM e WHERE ledger = 77")
def filter_ledger_exact(spark, sf_dir):
    return _flat(predicates.filter_events(ledger_events(spark, sf_dir), ledger=77))


@registered(f"SELECT {_FLAT} FROM e WHERE ledger BETWEEN 500 AND 700")
def filter_ledger_range(spark, sf_dir):
    return _flat(predicates.filter_events(ledger_events(spark, sf_dir), start_ledger=500, end_ledger=700))


@registered(f"SELECT {_FLAT} FROM e WHERE contractId = 'C4' AND type = 'view' AND ledger >= 1000 AND list_has_any(topics, ['view'])")
def filter_conjunction(spark, sf_dir):
    return _flat(predicates.filter_events(ledger_events(spark, sf_dir), contract_id="C4", type="view", start_ledger=1000, topic="view"))


@registered(f"SELECT {_FLAT} FROM e WHERE TRY_CAST(value AS BIGINT) > 50")
def filter_predicate(spark, sf_dir):
    return _flat(predicates.filter_events(ledger_events(spark, sf_dir), predicate=F.col("value").try_cast("long") > 50))


@registered("SELECT id, type = 'click' AND ledger <= 900 AS matched FROM e")
def match_event(spark, sf_dir):
    return ledger_events(spark, sf_dir).select("id", predicates.matches_event(type="click", end_ledger=900).alias("matched"))


# pages and orders


@registered(f"SELECT {_FLAT} FROM e WHERE contractId = 'C2' AND ledger BETWEEN 50 AND 3500 ORDER BY ledger, transactionIndex, operationIndex, id LIMIT 50 OFFSET 100")
def query_page(spark, sf_dir):
    return _flat(query.query_events(ledger_events(spark, sf_dir), contract_id="C2", start_ledger=50, end_ledger=3500, limit=50, offset=100))


@registered("SELECT count(*) AS total, 100 AS \"offset\", 50 AS \"limit\", greatest(0, least(50, count(*) - 100)) AS count, 100 + greatest(0, least(50, count(*) - 100)) < count(*) AS hasMore FROM e WHERE contractId = 'C2' AND ledger BETWEEN 50 AND 3500")
def query_page_meta(spark, sf_dir):
    return query.query_meta(ledger_events(spark, sf_dir), contract_id="C2", start_ledger=50, end_ledger=3500, limit=50, offset=100)


def _ordered(spark, sf_dir, order):
    rows = ledger_events(spark, sf_dir, sparse=True)
    page = rows.orderBy(*event_order(order)).offset(100).limit(50)
    return page.select("id", "ledger", "transactionIndex")


@registered("SELECT id, ledger, transactionIndex FROM s ORDER BY ledger, coalesce(transactionIndex, 0), id LIMIT 50 OFFSET 100")
def order_nulls_zero(spark, sf_dir):
    return _ordered(spark, sf_dir, "query")


@registered("SELECT id, ledger, transactionIndex FROM s ORDER BY ledger, transactionIndex NULLS LAST, id LIMIT 50 OFFSET 100")
def order_nulls_last(spark, sf_dir):
    return _ordered(spark, sf_dir, "store")


@registered("SELECT id, ledger, transactionIndex FROM s ORDER BY ledger, transactionIndex NULLS FIRST, id LIMIT 50 OFFSET 100")
def order_nulls_first(spark, sf_dir):
    return _ordered(spark, sf_dir, "table")


@registered("SELECT id, ledger FROM s ORDER BY ledger DESC, coalesce(transactionIndex, 0) DESC, id DESC LIMIT 30")
def order_newest(spark, sf_dir):
    return newest(ledger_events(spark, sf_dir, sparse=True), 30).select("id", "ledger")


# dedupe, windows, handoff


@registered(f"SELECT {_FLAT}, 0 AS batch FROM e")
def dedupe_keep_first(spark, sf_dir):
    rows = ledger_events(spark, sf_dir)
    again = rows.where("ledger < 50").withColumn("batch", F.lit(1))
    both = rows.withColumn("batch", F.lit(0)).unionByName(again)
    return dedupe.keep_first(both, ["id"], [*event_order("replay"), F.col("batch").asc()]).select(*_FLAT_COLS, "batch")


@registered("--plain SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity) AS n FROM lineitem) WHERE n = 1")
def dedupe_lineitem_key(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    return dedupe.keep_first(rows, ["l_orderkey", "l_linenumber"], [F.col(c).asc() for c in ("l_partkey", "l_suppkey", "l_shipdate", "l_quantity")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@registered("SELECT CASE WHEN CAST(id AS BIGINT) % 13 <> 0 THEN id END AS id, ledger, count(*) AS n FROM e GROUP BY 1, 2")
def order_windows(spark, sf_dir):
    rows = ledger_events(spark, sf_dir).withColumn("id", F.when(F.col("id").cast("long") % 13 != 0, F.col("id")))
    parts = [rows.where(F.col("ledger").between(s, e)) for s, e in windows.window_list(1, 5000, 1000)]
    known = dedupe.order_windows(*parts, rows.where("ledger < 40 and id is not null"))
    return known.groupBy("id", "ledger").agg(F.count("*").alias("n"))


@registered("SELECT CAST(s AS BIGINT) AS startLedger, CAST(least(s + 599, 4321) AS BIGINT) AS endLedger FROM range(1, 4322, 600) t(s)")
def backfill_windows(spark, sf_dir):
    return windows.build_windows(spark, 1, 4321, 600)


@registered(", m AS (SELECT max(ledger) AS last FROM e) SELECT CAST(s AS BIGINT) AS startLedger, CAST(least(s + 499, last) AS BIGINT) AS endLedger, count(e.id) AS n FROM (SELECT unnest(range(1, last + 1, 500)) AS s, last FROM m) LEFT JOIN e ON e.ledger BETWEEN s AND s + 499 GROUP BY 1, 2")
def replay_window_counts(spark, sf_dir):
    each = ledger_events(spark, sf_dir).select(windows.window_of("ledger", 1, 500).alias("w"))
    counts = each.groupBy("w").agg(F.count("*").alias("n"))
    spans = windows.build_windows(spark, 1, _last(spark, sf_dir), 500).withColumn("w", windows.window_of("startLedger", 1, 500))
    return spans.join(counts, "w", "left").select("startLedger", "endLedger", F.coalesce("n", F.lit(0)).alias("n"))


@registered("SELECT CAST(floor((ledger - 1) / 500.0) AS BIGINT) AS w, count(*) AS n, min(ledger) AS low, max(ledger) AS high FROM e GROUP BY 1")
def window_assign(spark, sf_dir):
    return ledger_events(spark, sf_dir).groupBy(windows.window_of("ledger", 1, 500).alias("w")).agg(F.count("*").alias("n"), F.min("ledger").alias("low"), F.max("ledger").alias("high"))


@registered(f"SELECT {_FLAT} FROM e WHERE ledger >= 3000 AND CAST(id AS BIGINT) % 5 <> 0")
def handoff_accept(spark, sf_dir):
    rows = ledger_events(spark, sf_dir)
    seen = rows.where("cast(id as bigint) % 5 = 0").select("id")
    return _flat(handoff.accept(rows.unionByName(rows.where("ledger > 4000")), 3000, seen))


@registered("SELECT id, ledger, CASE WHEN ledger <= 2000 THEN 'history' ELSE 'live' END AS origin FROM e WHERE ledger <= 2000 OR ledger >= 1990")
def handoff_overlap(spark, sf_dir):
    rows = ledger_events(spark, sf_dir).select("id", "ledger")
    history = rows.where("ledger <= 2000").withColumn("origin", F.lit("history"))
    return handoff.overlap(history, rows.withColumn("origin", F.lit("live")), 1990)


# chain


@registered("""
, p AS (SELECT *, max(sequence) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_seq FROM l),
f AS (SELECT sequence, min_by(hash, arrival) AS hash FROM l GROUP BY sequence),
j AS (SELECT p.*, f.hash AS prev_hash FROM p LEFT JOIN f ON f.sequence = p.prev_seq)
SELECT sequence, prev_seq, prev_hash,
       CASE WHEN prev_seq IS NULL THEN 'initialized' WHEN sequence < prev_seq THEN 'regressed'
            WHEN sequence = prev_seq AND hash <> prev_hash THEN 'hash_conflict' WHEN sequence = prev_seq THEN 'duplicate'
            WHEN sequence <> prev_seq + 1 THEN 'gap' WHEN previousHash <> prev_hash THEN 'broken_link' ELSE 'advanced' END AS status
FROM j""")
def ledger_consistency(spark, sf_dir):
    return consistency.ledger_status(ledgers(spark, sf_dir), "arrival", allow_gaps=True).select("sequence", "prev_seq", "prev_hash", "status")


@registered("SELECT sequence + 1 AS startLedger, nxt - 1 AS endLedger FROM (SELECT sequence, lead(sequence) OVER (ORDER BY sequence) AS nxt FROM l) WHERE nxt > sequence + 1")
def ledger_gaps(spark, sf_dir):
    return consistency.gaps(ledgers(spark, sf_dir))


@registered("SELECT a.sequence, a.previousHash, b.hash AS expected FROM l a JOIN l b ON a.sequence = b.sequence + 1 WHERE a.previousHash <> b.hash")
def ledger_link_breaks(spark, sf_dir):
    return consistency.broken_links(ledgers(spark, sf_dir))


def _fork(rows: DataFrame) -> DataFrame:
    fork = F.when(F.col("sequence") % 31 == 0, "forked").when(F.col("sequence") % 37 != 0, F.col("hash"))
    return rows.withColumn("hash", fork)


_FORK = ", a AS (SELECT sequence, CASE WHEN sequence % 31 = 0 THEN 'forked' WHEN sequence % 37 <> 0 THEN hash END AS hash FROM l)"


@registered(_FORK + """
SELECT l.sequence, l.hash AS expectedHash, a.hash AS actualHash,
       CASE WHEN a.sequence IS NULL THEN 'expected-ledger-outside-window' WHEN l.hash IS NULL OR a.hash IS NULL THEN 'hash-unavailable'
            WHEN l.hash = a.hash THEN 'same-hash' ELSE 'hash-mismatch' END AS outcome
FROM l LEFT JOIN (SELECT * FROM a WHERE sequence > (SELECT max(sequence) - 3000 FROM a)) a USING (sequence)""")
def reorg_detect(spark, sf_dir):
    rows = ledgers(spark, sf_dir)
    return reorg.compare_ledgers(rows, _fork(rows), 3000)


@registered(_FORK + """
SELECT l.sequence, greatest(1, l.sequence - 2) AS rewindTo, l.sequence AS invalidateFrom, (SELECT max(sequence) FROM a) AS invalidateTo, greatest(1, l.sequence - 2) AS replayFrom
FROM l JOIN a USING (sequence) WHERE a.hash IS NOT NULL AND l.hash <> a.hash""")
def reorg_plan(spark, sf_dir):
    rows = ledgers(spark, sf_dir)
    actual = _fork(rows)
    head = actual.agg(F.max("sequence").alias("head"))
    bad = reorg.compare_ledgers(rows, actual).where("outcome = 'hash-mismatch'").crossJoin(F.broadcast(head))  # one row
    return bad.select("sequence", *reorg.plan_columns(F.col("sequence"), F.col("head"), 2))


@registered(f"SELECT {_FLAT} FROM e WHERE NOT ledger BETWEEN 1000 AND 1200")
def reorg_invalidate(spark, sf_dir):
    return _flat(reorg.invalidate(ledger_events(spark, sf_dir), 1000, 1200))


# store, dead letters, metrics


@registered(f"""
, v AS (SELECT {_FLAT}, 1 AS version FROM e UNION ALL
  SELECT id, 'replaced' AS type, ledger + 1 AS ledger, contractId, transactionIndex, operationIndex, txHash, value, 2 AS version FROM e WHERE CAST(id AS BIGINT) % 3 = 0)
SELECT {_FLAT} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS n FROM v) WHERE n = 1""")
def store_upsert_latest(spark, sf_dir):
    rows = ledger_events(spark, sf_dir).select(*_FLAT_COLS).withColumn("version", F.lit(1))
    newer = rows.where("cast(id as bigint) % 3 = 0").withColumns({"type": F.lit("replaced"), "ledger": F.col("ledger") + 1, "version": F.lit(2)})
    return dedupe.keep_last(rows.unionByName(newer), ["id"], ["version"]).drop("version")


@registered("SELECT id, CASE WHEN ledger BETWEEN 300 AND 400 THEN 'again' ELSE type END AS type, ledger FROM e WHERE ledger NOT BETWEEN 700 AND 800")
def store_delete_range(spark, sf_dir):
    from strandline.plans.store import MemoryEventStore

    store = MemoryEventStore(spark)
    rows = ledger_events(spark, sf_dir)
    store.put(rows)
    store.put(rows.where("ledger between 300 and 400").withColumn("type", F.lit("again")))
    store.delete_range(700, 800)
    return store.list().select("id", "type", "ledger")


@registered("""
, q AS (SELECT CAST(CAST(id AS BIGINT) % 200 AS VARCHAR) AS id, CAST(id AS BIGINT) AS seq, 'failed ' || type AS error FROM e WHERE type = 'error')
SELECT id, position, seq, error FROM (SELECT *, min(seq) OVER (PARTITION BY id) AS position, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM q)
WHERE n = 1 ORDER BY position DESC LIMIT 100""")
def dead_letter_latest(spark, sf_dir):
    rows = ledger_events(spark, sf_dir).where("type = 'error'")
    letters = rows.select((F.col("id").cast("long") % 200).cast("string").alias("id"), F.col("id").cast("long").alias("seq"), F.concat(F.lit("failed "), "type").alias("error"))
    return deadletter.latest_letters(letters, max_entries=100).select("id", "position", "seq", "error")


@registered("SELECT type, count(v) AS count, sum(v) AS sum, min(v) AS min, max(v) AS max FROM (SELECT type, TRY_CAST(value AS BIGINT) AS v FROM e) GROUP BY type")
def metrics_histogram(spark, sf_dir):
    rows = ledger_events(spark, sf_dir).withColumn("v", F.col("value").try_cast("long"))
    return metrics.histogram(rows, "v", ["type"]).withColumn("sum", F.col("sum").cast("decimal(38,0)"))


def _registry(rows: DataFrame) -> DataFrame:
    hist = rows.groupBy(F.lit("histogram").alias("kind"), F.col("type").alias("name")).agg(F.count("v").alias("count"), F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"))
    none = F.lit(None).cast("long")
    counter = rows.groupBy(F.lit("counter").alias("kind"), F.col("contractId").alias("name")).agg(F.count("*").alias("count"), F.count("*").alias("sum"), none.alias("min"), none.alias("max"))
    gauge = rows.agg(F.max("ledger").alias("m")).select(F.lit("gauge").alias("kind"), F.lit("head").alias("name"), F.lit(1).cast("long").alias("count"), F.col("m").alias("sum"), none.alias("min"), none.alias("max"))
    return hist.unionByName(counter).unionByName(gauge)


@registered("""
, v AS (SELECT *, TRY_CAST(value AS BIGINT) AS v FROM e)
SELECT 'histogram' AS kind, type AS name, count(v) AS count, CAST(sum(v) AS BIGINT) AS sum, min(v) AS min, max(v) AS max FROM v GROUP BY type
UNION ALL SELECT 'counter', contractId, count(*), count(*), NULL, NULL FROM v GROUP BY contractId
UNION ALL SELECT 'gauge', 'head', 1, max(ledger), NULL, NULL FROM v WHERE ledger > 2000""")
def metrics_merge(spark, sf_dir):
    rows = ledger_events(spark, sf_dir).withColumn("v", F.col("value").try_cast("long"))
    return metrics.merge_metrics(_registry(rows.where("ledger <= 2000")), _registry(rows.where("ledger > 2000"))).select("kind", "name", "count", "sum", "min", "max")


# text


@registered("""SELECT '{"id":"' || id || '","type":"' || type || '","ledger":' || ledger || ',"topics":["' || topics[1] || '","' || topics[2] || '"],"value":' || CASE WHEN ledger % 7 = 0 THEN 'null' ELSE '"' || value || '"' END || '}' AS line FROM e""")
def export_jsonl(spark, sf_dir):
    rows = ledger_events(spark, sf_dir).withColumn("value", F.when(F.col("ledger") % 7 != 0, F.col("value")))
    return export.create_exporter("jsonl", ["id", "type", "ledger", "topics", "value"]).lines(rows)


@registered("""SELECT id || ',' || ledger || ',' || CASE WHEN ledger % 7 = 0 THEN '' ELSE '"a ""quoted"" ' || type || ', text"' END || ',"[""' || topics[1] || '"",""' || topics[2] || '""]"' AS line FROM e""")
def export_csv(spark, sf_dir):
    text = F.concat(F.lit('a "quoted" '), "type", F.lit(", text"))
    rows = ledger_events(spark, sf_dir).withColumn("value", F.when(F.col("ledger") % 7 != 0, text))
    return export.create_exporter("CSV", ["id", "ledger", "value", "topics"]).lines(rows)


@registered("SELECT id, lower(hex(txHash)) AS value FROM e")
def decode_hex(spark, sf_dir):
    raw = ledger_events(spark, sf_dir).withColumn("value", F.col("txHash").cast("binary"))
    return decode_events(raw).select("id", "value")


@registered("SELECT id, array_to_string([CAST(ledger AS VARCHAR), 'null', CAST(transactionIndex AS VARCHAR)], '|') AS topics FROM e")
def decode_topics(spark, sf_dir):
    raw = ledger_events(spark, sf_dir).withColumn("topics", F.array(F.col("ledger"), F.lit(None).cast("long"), F.col("transactionIndex")))
    return decode_events(raw).select("id", F.array_join("topics", "|").alias("topics"))


@registered("SELECT id, CASE WHEN ledger % 3 = 0 THEN 4 ELSE 2 END AS depth FROM e")
def decode_depth(spark, sf_dir):
    deep = F.when(F.col("ledger") % 3 == 0, F.lit('{"a":[{"b":[1,"]["]}]}')).otherwise(F.lit('[{"x":1}]'))
    return ledger_events(spark, sf_dir).select("id", decode.json_depth(deep).alias("depth"))


@registered("SELECT id, upper(type) AS type, ledger + 1 AS ledger FROM e WHERE type <> 'view'")
def pipeline_map_filter(spark, sf_dir):
    stages = EventPipeline().filter(F.col("type") != "view").transform(lambda d: d.withColumn("type", F.upper("type"))).map(lambda e: {**e, "ledger": e["ledger"] + 1})
    return stages.apply(ledger_events(spark, sf_dir).select("id", "type", "ledger"))


# plans and streams


@registered("SELECT id, ledger, type FROM e")
def backfill_run(spark, sf_dir):
    from strandline.plans.backfill import BackfillEngine
    from strandline.plans.store import MemoryEventStore

    store, checkpoint = MemoryEventStore(spark), CheckpointManager()
    BackfillEngine(EventSource(ledger_events(spark, sf_dir)), store, checkpoint).run(1, _last(spark, sf_dir), window_size=720, concurrency=6)
    return store.list().select("id", "ledger", "type")


@registered("SELECT ledger // 500 AS part, count(*) AS n FROM e WHERE ledger >= 301 GROUP BY 1")
def replay_run(spark, sf_dir):
    from strandline.plans.replay import EventReplay

    checkpoint, seen = CheckpointManager(), []
    checkpoint.save(301)
    EventReplay(EventSource(ledger_events(spark, sf_dir)), checkpoint=checkpoint).run(1, _last(spark, sf_dir), window_size=500, on_batch=lambda rows, _: seen.append(rows.select("id", "ledger")))
    rows = seen[0]
    for x in seen[1:]:
        rows = rows.unionByName(x)
    return rows.groupBy(F.floor(F.col("ledger") / 500).cast("long").alias("part")).agg(F.count("*").alias("n"))


def _last(spark, sf_dir) -> int:
    return ledger_events(spark, sf_dir).agg(F.max("ledger")).first()[0]


def _streamed(spark, sf_dir, condition: str = "true"):
    folder = shared_folder(spark, "stream")
    rows = ledger_events(spark, sf_dir).where(condition)
    rows.unionByName(rows.where("ledger % 10 = 0")).select(*EVENT_COLUMNS).write.mode("overwrite").parquet(f"{folder}/in")
    return folder


@registered("SELECT id, ledger FROM e")
def stream_dedupe(spark, sf_dir):
    from strandline.streaming.consume import event_stream, stream_dedupe as once

    folder = _streamed(spark, sf_dir)
    rows = once(event_stream(spark, f"{folder}/in"), 1).select("id", "ledger")
    rows.writeStream.option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).format("parquet").start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@registered("SELECT type, count(*) AS n, max(ledger) AS head FROM e GROUP BY type")
def stream_consume(spark, sf_dir):
    from strandline.plans.store import MemoryEventStore
    from strandline.streaming.consume import consume, event_stream

    folder, store = _streamed(spark, sf_dir), MemoryEventStore(spark)
    checkpoint = CheckpointManager()
    consume(event_stream(spark, f"{folder}/in"), f"{folder}/at", start_ledger=1, checkpoint=checkpoint, on_batch=lambda rows, _: store.put(rows))
    return store.table().groupBy("type").agg(F.count("*").alias("n"), F.max("ledger").alias("head"))


@registered("SELECT id, ledger FROM e")
def live_backfill(spark, sf_dir):
    from strandline.plans.engine import LiveBackfillEngine
    from strandline.plans.store import MemoryEventStore
    from strandline.streaming.consume import event_stream

    rows, store = ledger_events(spark, sf_dir), MemoryEventStore(spark)
    history = rows.where("ledger <= 4000")
    folder = _streamed(spark, sf_dir, f"ledger >= {history.agg(F.max('ledger')).first()[0]}")
    LiveBackfillEngine(EventSource(history), store, CheckpointManager()).run(1, event_stream(spark, f"{folder}/in"), f"{folder}/at", window_size=4000)
    return store.list().select("id", "ledger")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger events of two contracts and types over a range, one ordered page."""
    rows = predicates.filter_events(ledger_events(spark, sf_dir), contract_id=["C1", "C2"], type=["click", "purchase"], start_ledger=1, end_ledger=4000)
    return query.query_events(rows, limit=50)

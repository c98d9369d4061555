"""Stores, checkpoints, backfill, replay, streams and recovery, composed of real parts."""

import json
import threading

import pytest
from pyspark.sql import functions as F
from test_operators import events, ids

from strandline.errors import AbortError, BackfillError, CheckpointError, CircuitOpenError, LifecycleError, LiveBackfillError, PipelineError, ReplayError
from strandline.operators.metrics import Metrics
from strandline.plans import deadletter
from strandline.plans.backfill import BackfillEngine
from strandline.plans.checkpoint import CheckpointManager, FileCheckpointStore, MemoryCheckpointStore, is_checkpoint_store
from strandline.plans.engine import EventEngine, LiveBackfillEngine
from strandline.plans.lifecycle import LifecycleController
from strandline.plans.pipeline import EventPipeline
from strandline.plans.recovery import ReorgMonitor, ReorgRecovery
from strandline.plans.replay import EventReplay
from strandline.plans.store import MemoryEventStore, is_event_store
from strandline.sources.events import EventSource
from strandline.sources.resilience import Requester, Retry, classify_error
from strandline.streaming.consume import consume, event_stream, start_ledger_of, stream_events


def some(spark, n=20, start=1):
    return events(spark, [{"id": f"{i:03}", "ledger": start + i // 2, "transactionIndex": i % 2, "type": "contract"} for i in range(n)])


@pytest.mark.parametrize("make", [MemoryCheckpointStore, None])
def test_checkpoint_stores(tmp_path, make):
    store = make() if make else FileCheckpointStore(str(tmp_path / "c"))
    assert is_checkpoint_store(store) and store.load("a/b") is None
    store.save("a/b", 5)
    store.save("a/b", 5)
    with pytest.raises(CheckpointError):
        store.save("a/b", 4)
    store.rewind("a/b", 2)
    assert store.load("a/b") == 2
    store.clear("a/b")
    assert store.load("a/b") is None
    for bad in (0, "x"):
        with pytest.raises((TypeError, ValueError)):
            store.save("k", bad)
    manager = CheckpointManager(store)
    manager.save(9)
    assert manager.resume_from(3) == 9 and manager.resume_from(12) == 12
    with pytest.raises(TypeError):
        CheckpointManager(object())


def test_corrupt_checkpoint(tmp_path):
    store = FileCheckpointStore(str(tmp_path))
    store.save("k", 3)
    (tmp_path / "k.json").write_text("{oops")
    with pytest.raises(CheckpointError):
        store.load("k")
    (tmp_path / "k.json").write_text(json.dumps({"version": 2, "key": "k", "ledger": 3}))
    with pytest.raises(CheckpointError):
        store.load("k")


def test_store(spark):
    store = MemoryEventStore(spark)
    assert is_event_store(store) and store.count() == 0 and store.get("x") is None
    store.put([{"id": "a", "ledger": 5, "value": "1"}, {"id": "b", "ledger": 20_005}, {"id": "a", "ledger": 6, "value": "2"}])
    assert store.count() == 2 and store.get("a")["value"] == "2" and store.has("b")
    before = dict(store._version())
    store.put({"id": "a", "ledger": 40_000, "value": "3"})  # moves to another bucket
    assert store.count() == 2 and store.get("a")["ledger"] == 40_000
    assert before[2] == store._version()[2]  # an untouched bucket keeps its folder
    assert ids(store.list(start_ledger=1, end_ledger=30_000)) == ["b"]
    assert ids(store.list(limit=1)) == ["b"]
    assert store.vacuum() >= 1 and store.count() == 2
    assert store.delete("a") and not store.delete("a")
    assert store.delete_range(20_000, 20_010) == 1 and store.count() == 0
    for bad in ({"id": None, "ledger": 1}, {"id": "x", "ledger": 0}):
        with pytest.raises(ValueError):
            store.put(bad)
    store.put({"id": "z", "ledger": 1})
    store.clear()
    assert store.count() == 0


def test_pipeline(spark):
    seen = []
    p = EventPipeline().filter(lambda e: e["ledger"] > 1).map(lambda e: {**e, "type": "x"}).tap(seen.append)
    assert p.size == 3 and p.process({"ledger": 1}) is None
    assert p.process_batch([{"ledger": 2}, {"ledger": 0}]) == [{"ledger": 2, "type": "x"}] and len(seen) == 1
    with pytest.raises(PipelineError) as error:
        EventPipeline().use(lambda e: e).use(lambda e: 1 / 0).process({})
    assert error.value.stage_index == 1
    with pytest.raises(TypeError):
        EventPipeline().use(3)
    out = EventPipeline().filter(F.col("ledger") >= 9).map(lambda e: {**e, "operationIndex": e["ledger"] * 2}).apply(some(spark))
    assert [(r.ledger, r.operationIndex, r.txHash) for r in out.collect()] == [(9, 18, None)] * 2 + [(10, 20, None)] * 2
    assert p.clear().size == 0


def test_backfill_resumes_at_a_prefix(spark):
    store, checkpoint, seen = MemoryEventStore(spark), CheckpointManager(), []

    def fail(event, context):
        if event["ledger"] == 7:
            raise RuntimeError("consumer failed")
        seen.append(event["id"])

    source = EventSource(some(spark))
    with pytest.raises(RuntimeError):
        BackfillEngine(source, store, checkpoint).run(1, 10, window_size=2, concurrency=2, on_event=fail)
    assert checkpoint.load() == 5  # the first group of two windows
    progress = []
    done = BackfillEngine(source, store, checkpoint).run(1, 10, window_size=2, concurrency=2, on_event=lambda e, c: seen.append(e["id"]), on_progress=progress.append)
    assert done["resumedFrom"] == 5 and done["completed"] and checkpoint.load() == 11 and len(progress) == 2
    assert sorted(set(seen)) == ids(some(spark)) and store.count() == 20
    assert BackfillEngine(source, checkpoint=checkpoint).run(1, 10)["windows"] == 0
    stop = threading.Event()
    stop.set()
    with pytest.raises(BackfillError):
        BackfillEngine(source).run(1, 10, cancelled=stop)


def test_replay(spark):
    checkpoint, seen = CheckpointManager(), []
    shuffled = some(spark).orderBy(F.rand(3))
    out = EventReplay(EventSource(shuffled), checkpoint=checkpoint).run(3, 10, window_size=3, on_event=lambda e, c: seen.append(e["id"]))
    assert seen == ids(some(spark))[4:] and out["processed"] == 16 and checkpoint.load() == 11
    with pytest.raises(ReplayError):
        EventReplay(EventSource(shuffled)).run(5, 4)
    stop = threading.Event()
    stop.set()
    assert EventReplay(EventSource(shuffled)).run(1, 10, cancelled=stop)["cancelled"]


def test_consume_checkpoints_whole_ledgers(spark, tmp_path):
    some(spark).coalesce(1).write.parquet(f"{tmp_path}/in")
    checkpoint, seen = CheckpointManager(), []
    n = consume(event_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/a", start_ledger=1, checkpoint=checkpoint, on_event=lambda e, c: seen.append(e["id"]), max_events=5)
    assert n == 5 and seen == ids(some(spark))[:5] and checkpoint.load() == 3  # ledger 3 was delivered in part
    n = consume(event_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/b", checkpoint=checkpoint, on_event=lambda e, c: seen.append(e["id"]))
    assert n == 16 and seen[5:] == ids(some(spark))[4:] and checkpoint.load() == 11


def test_start_precedence():
    manager = CheckpointManager()
    assert start_ledger_of(None, manager, None, lambda: 7) == 7
    manager.save(5)
    assert start_ledger_of(None, manager, None, lambda: 7) == 5 and start_ledger_of(2, manager, None, lambda: 7) == 2


def test_stream_events_commits_behind(spark):
    manager = CheckpointManager()
    feed = stream_events(some(spark), manager)
    for _ in range(3):
        next(feed)
    assert manager.load() == 2
    assert len(list(feed)) == 17 and manager.load() == 11


def test_live_backfill_delivers_all_once(spark, tmp_path):
    history, seen = some(spark), []
    live = events(spark, [{"id": "019", "ledger": 10, "transactionIndex": 1}, {"id": "new", "ledger": 10, "transactionIndex": 2}, {"id": "next", "ledger": 11}])
    live.write.parquet(f"{tmp_path}/in")
    out = LiveBackfillEngine(EventSource(history), checkpoint=CheckpointManager()).run(1, event_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/at", on_event=lambda e, c: seen.append(e["id"]))
    assert seen == [*ids(history), "new", "next"] and out["boundary"] == 10 and out["live"] == 2
    with pytest.raises(LiveBackfillError):
        LiveBackfillEngine(EventSource(history)).run(50, None, "")


def test_engine(spark, tmp_path):
    ledgers = spark.createDataFrame([(i, f"h{i}", f"h{i - 1}") for i in range(1, 11)], "sequence long, hash string, previousHash string")
    store, seen = MemoryEventStore(spark), []
    engine = EventEngine(EventSource(some(spark), ledgers), store)
    events(spark, [{"id": "x", "ledger": 11}]).write.parquet(f"{tmp_path}/in")
    engine.start(1, event_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/at", on_event=lambda e, c: seen.append(e["id"]))
    assert seen == [*ids(some(spark)), "x"] and store.count() == 21 and engine.lifecycle.state == "running"
    assert engine.check_reorg({"sequence": 9, "hash": "h9"})["reason"] == "same-hash"
    found = engine.check_reorg({"sequence": 9, "hash": "other"})
    assert found["recovery"]["deleted"] == 4 and engine.handoff.boundary == 8 and store.count() == 17
    assert engine.checkpoint.load() == 8
    assert engine.metrics.get_counter("engine_reorg_recoveries") == 1 and engine.stop("done") and not engine.stop()


def test_monitor(spark):
    ledgers = spark.createDataFrame([(i, f"h{i}") for i in range(1, 11)], "sequence long, hash string")
    monitor = ReorgMonitor(EventSource(some(spark), ledgers), ReorgRecovery(CheckpointManager()), lookback=3)
    assert monitor.check({"sequence": 7, "hash": "h7"})["reason"] == "expected-ledger-outside-window"
    assert monitor.check({"sequence": 8, "hash": "h8"})["reason"] == "same-hash"
    got = []
    assert monitor.monitor(lambda: {"sequence": 10, "hash": "zz"}, got.append, interval_s=0, rounds=2) == 2 and got[0]["recovery"]["rewind_to"] == 9


def test_ledger_history(spark):
    ledgers = spark.createDataFrame([(i, f"h{i}", f"h{i - 1}") for i in (1, 2, 3, 5)], "sequence long, hash string, prevHash string")
    source = EventSource(some(spark), ledgers)
    assert source.ledger_history(1, 3).count() == 3
    with pytest.raises(Exception, match="ledger 5: gap"):
        source.ledger_history()
    assert source.verify_ledgers(1, 3)["lastSequence"] == 3 and source.is_ledger_available(99) and source.check_health()


def test_lifecycle():
    life = LifecycleController()
    assert life.stop() is False
    stop = life.start()
    for act in (life.start, life.reset):
        with pytest.raises(LifecycleError):
            act()
    assert life.stop("done") and stop.is_set() and life.state == "stopped" and life.reason == "done"
    life.reset()
    assert life.state == "idle"


def test_dead_letters(spark):
    queue = deadletter.MemoryDeadLetterQueue(2)
    queue.add({"id": "a"}, ValueError("x"))
    queue.add({}, "y")
    queue.add({"id": "a"}, "again")
    assert [e["id"] for e in queue.list()] == ["a", "dead-1"] and queue.get("a")["error"] == "again"
    assert queue.retry("a")["attempts"] == 1 and queue.retry("none") is None
    queue.add({"id": "c"})
    assert [e["id"] for e in queue.list()] == ["dead-1", "c"] and [e["id"] for e in queue.list(1)] == ["c"]
    assert queue.remove("c") and not queue.remove("c") and queue.size == 1 and deadletter.is_dead_letter_queue(queue)
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4)], "id string, seq long")
    assert {(r.id, r.seq) for r in deadletter.latest_letters(rows, 2).collect()} == {("c", 4), ("b", 2)}


class Failing(Exception):
    def __init__(self, status):
        super().__init__(f"status {status}")
        self.status = status


def test_requester():
    now, calls = [0.0], []

    def call(endpoint, request):
        calls.append(endpoint)
        if endpoint == "bad":
            raise Failing(503)
        return request

    r = Requester(["bad", "good"], call, Retry(3, base_s=0, seed=1), metrics=Metrics(), clock=lambda: now[0])
    assert r.request(1) == 1 and calls == ["bad"] * 3 + ["good"] and r.metrics.get_counter("rpc_failovers") == 1
    lone = Requester(["bad"], call, Retry(3, base_s=0), clock=lambda: now[0])
    with pytest.raises(CircuitOpenError):
        lone.request(1)
    now[0] = 31.0
    assert lone.circuits[0].half_open
    with pytest.raises(Failing):
        Requester(["x"], lambda e, q: (_ for _ in ()).throw(Failing(400)), Retry(base_s=0)).request(1)
    lone.cancelled.set()
    with pytest.raises(AbortError):
        lone.request(1)
    assert [classify_error(Failing(429)), classify_error(TimeoutError()), classify_error(ValueError("no"))] == ["rate_limit", "transient", "fatal"]


def test_pages_source(spark, tmp_path, capsys):
    from strandline.cli import main
    from strandline.sources.pages import PagesSource, read_pages
    from strandline.streaming.consume import page_stream

    pages = [{"events": [{"id": f"{i}", "ledger": i, "topic": [{"type": "u32", "value": 1}], "value": {"k": [1, 2]}, "extra": 1} for i in (1, 2)], "cursor": "a"}, {"events": [], "cursor": "b"}, {"events": [{"id": "3", "ledger": 3, "transactionHash": "t"}], "cursor": None}, {"events": [{"id": "never", "ledger": 9}]}]
    for i, page in enumerate(pages):
        (tmp_path / f"{i:04}.json").write_text(json.dumps(page))
    spark.dataSource.register(PagesSource)
    rows = spark.read.format("ledger_pages").option("path", str(tmp_path)).load().orderBy("id").collect()
    assert [(r.id, r.topics, r.value, r.txHash) for r in rows] == [("1", ["1"], '{"k":[1,2]}', None), ("2", ["1"], '{"k":[1,2]}', None), ("3", None, None, "t")]
    assert sorted(r.id for r in read_pages(spark, str(tmp_path)).where("ledger >= 2 and ledger < 3").collect()) == ["2"]
    assert main(["latest", "--source", str(tmp_path)], spark) == 0 and capsys.readouterr().out == "3\n"
    assert main(["backfill", "--source", str(tmp_path), "--start", "1", "--end", "2", "--format", "csv", "--output", str(tmp_path / "o.csv")], spark) == 0
    assert (tmp_path / "o.csv").read_text().count("\n") == 3
    assert main(["replay", "--source", str(tmp_path), "--start", "2", "--end", "1"], spark) == 2
    assert main(["status", "--source", str(tmp_path)], spark) == 0
    with pytest.raises(SystemExit):
        main(["backfill", "--source", "x", "--start", "0", "--end", "2"], spark)
    (tmp_path / "0001.json").write_text(json.dumps({"events": [], "cursor": "a"}))
    with pytest.raises(Exception, match="does not advance"):
        spark.read.format("ledger_pages").option("path", str(tmp_path)).load().count()
    (tmp_path / "0001.json").write_text(json.dumps({"events": [], "cursor": "b"}))
    seen = []
    query = page_stream(spark, str(tmp_path), 2).writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda d, n: seen.extend(r.id for r in d.collect())).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == ["2", "3", "never"]

"""Operators on small rows: nulls, ties, empty input, bad arguments."""

import pytest
from pyspark.sql import functions as F

from strandline.errors import ConsistencyError, HandoffError, MetricsError, ScValDepthError
from strandline.functions import checks, decode
from strandline.functions.model import EVENT_SCHEMA, decode_events, is_ledger_metadata
from strandline.operators import consistency, dedupe, export, handoff, metrics, ordering, predicates, query, reorg, windows
from strandline.plans.checkpoint import CheckpointManager
from strandline.sources.events import EventSource, empty_events


def events(spark, rows):
    names = EVENT_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], EVENT_SCHEMA)


@pytest.fixture(scope="module")
def three(spark):
    return events(spark, [
        {"id": "a", "ledger": 5, "contractId": "X", "type": "contract", "txHash": "t1", "topics": ["mint", "1"]},
        {"id": "b", "ledger": 6, "contractId": "Y", "type": "system", "txHash": "t2", "topics": ["burn"]},
        {"id": "c", "ledger": None, "contractId": None, "type": None, "txHash": None, "topics": None},
    ])


def ids(df):
    return [r.id for r in df.select("id").collect()]


@pytest.mark.parametrize("options, want", [
    ({}, ["a", "b", "c"]), ({"contract_id": "X"}, ["a"]), ({"type": ["contract", "system"]}, ["a", "b"]), ({"topic": 1}, ["a"]), ({"topic": ["burn", "none"]}, ["b"]),
    ({"ledger": 6}, ["b"]), ({"start_ledger": 1, "end_ledger": 5}, ["a"]), ({"tx_hash": "t2", "type": "contract"}, []), ({"contract_id": []}, []), ({"contract_id": None}, ["a", "b", "c"]),
])
def test_filters(three, options, want):
    assert ids(predicates.filter_events(three, **options)) == want


def test_match_is_never_null(three):
    out = three.select(predicates.matches_event(type="contract").alias("m")).collect()
    assert [r.m for r in out] == [True, False, False]
    assert ids(three.where(~predicates.matches_event(type="contract"))) == ["b", "c"]


def test_bad_options(three):
    with pytest.raises(ValueError):
        predicates.event_filter(start_ledger=5, end_ledger=4)
    with pytest.raises(TypeError):
        predicates.event_filter(ledger="5")
    with pytest.raises(TypeError):
        predicates.event_filter(predicate=lambda e: True)
    with pytest.raises(TypeError):
        predicates.filter_events([], type="x")
    for bad in ({"limit": 0}, {"offset": -1}, {"ledger": 0}):
        with pytest.raises(ValueError):
            query.validate_event_query(**bad)
    with pytest.raises(TypeError):
        query.validate_event_query(colour=1)


def test_orders(spark):
    rows = events(spark, [{"id": "n", "ledger": 1}, {"id": "z", "ledger": 1, "transactionIndex": 0}, {"id": "m", "ledger": 1, "transactionIndex": 4}, {"id": "q"}])
    order = lambda name: ids(rows.orderBy(*ordering.event_order(name)))
    assert order("replay") == ["q", "n", "z", "m"]
    assert order("query") == ["n", "z", "m", "q"]
    assert order("store") == ["z", "m", "n", "q"]
    assert order("table") == ["q", "n", "z", "m"]
    assert ids(ordering.newest(rows, 2)) == ["z", "m"] or ids(ordering.newest(rows, 2)) == ["m", "q"]
    assert ids(ordering.newest(rows, 0)) == []


def test_collation(spark):
    rows = events(spark, [{"id": x, "ledger": 1} for x in "Ba"])
    assert ids(rows.orderBy(*ordering.event_order())) == ["B", "a"]
    assert ids(rows.orderBy(*ordering.event_order(collation="UNICODE"))) == ["a", "B"]


def test_page_and_meta(spark):
    rows = events(spark, [{"id": f"{i:03}", "ledger": i % 7 + 1} for i in range(150)])
    assert query.query_events(rows).count() == 100
    meta = query.query_meta(rows, offset=100).first()
    assert (meta.total, meta["count"], meta.hasMore) == (150, 50, False)
    assert query.query_meta(rows, offset=200).first()["count"] == 0
    assert query.query_events(rows, limit=10, offset=145).count() == 5


def test_windows(spark):
    assert windows.window_list(10, 16, 3) == [(10, 12), (13, 15), (16, 16)]
    assert [tuple(r) for r in windows.build_windows(spark, 10, 16, 3).collect()] == [(10, 12), (13, 15), (16, 16)]
    with pytest.raises(ValueError):
        windows.window_list(5, 4)
    with pytest.raises(ValueError):
        windows.window_list(1, 4, 0)


def test_dedupe_keeps_idless_rows(spark):
    a = events(spark, [{"id": "a", "ledger": 2}, {"ledger": 1}, {"id": "b", "ledger": 9}])
    b = events(spark, [{"id": "a", "ledger": 1}, {"ledger": 1}])
    out = [(r.id, r.ledger) for r in dedupe.order_windows(a, b).collect()]
    assert sorted(out, key=str) == sorted([("a", 1), (None, 1), (None, 1), ("b", 9)], key=str)
    assert [r[1] for r in out] == [1, 1, 1, 9]


def test_dedupe_before_limit(spark):
    rows = events(spark, [{"id": "a", "ledger": 1}, {"id": "a", "ledger": 1}, {"id": "b", "ledger": 2}, {"ledger": 2}, {"id": "c", "ledger": 3}]).withColumn("arrival", F.monotonically_increasing_id())
    assert ids(dedupe.read_window(rows, limit=2)) == ["a", "b"]
    assert sorted(ids(EventSource(rows).events_windowed(1, None))) == ["a", "b", "c"]


@pytest.mark.parametrize("chain, want", [
    ([(1, "a", None), (2, "b", "a"), (2, "b", "a"), (3, "c", "b")], ["initialized", "advanced", "duplicate", "advanced"]),
    ([(1, None, None), (2, "b", "zz"), (3, "c", None)], ["initialized", "advanced", "advanced"]),
    ([(1, None, None), (1, "a", None), (2, "b", "x")], ["initialized", "duplicate", ConsistencyError]),
    ([(4, "a", None), (6, "b", "q")], ["initialized", ConsistencyError]),
    ([(4, "a", None), (3, "b", None)], ["initialized", ConsistencyError]),
    ([(4, "a", None), (4, "b", None)], ["initialized", ConsistencyError]),
])
def test_tracker_and_set_form_agree(spark, chain, want):
    tracker, errors = consistency.LedgerTracker(), {"regressed", "hash_conflict", "gap", "broken_link"}
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(chain)], "arrival long, sequence long, hash string, previousHash string")
    got = [r.status for r in consistency.ledger_status(rows).orderBy("arrival").collect()]
    for (seq, digest, prev), expected, row in zip(chain, want, got, strict=True):
        if expected is ConsistencyError:
            assert row in errors
            with pytest.raises(ConsistencyError):
                tracker.observe({"sequence": seq, "hash": digest, "prevHash": prev})
        else:
            assert row == expected == tracker.observe({"sequence": seq, "hash": digest, "previousHash": prev})
    if ConsistencyError in want:
        with pytest.raises(ConsistencyError):
            consistency.require_consistent(rows)


def test_gap_is_not_a_broken_link():
    tracker = consistency.LedgerTracker(allow_gaps=True)
    assert tracker.observe_many([{"sequence": 1, "hash": "a"}, {"sequence": 5, "hash": "e", "previousHash": "d"}]) == ["initialized", "gap"]
    tracker.assert_current(5)
    with pytest.raises(ConsistencyError):
        tracker.assert_current(4)


def test_gaps_and_metadata(spark):
    rows = spark.createDataFrame([(1, "a"), (2, ""), (5, None), (9, "x")], "sequence long, hash string")
    assert sorted(tuple(r) for r in consistency.gaps(rows).collect()) == [(3, 4), (6, 8)]
    assert [r[0] for r in rows.select(is_ledger_metadata()).collect()] == [True, False, True, True]


def test_reorg():
    assert reorg.detect({"sequence": 1, "hash": "a"}, {"sequence": 2, "hash": "a"})["reason"] == "different-ledger"
    assert reorg.detect({"sequence": 1, "hash": None}, {"sequence": 1, "hash": "a"})["reason"] == "hash-unavailable"
    assert reorg.detect({"sequence": 1, "hash": "b"}, {"sequence": 1, "hash": "a"})["detected"]
    assert reorg.plan(100, 101, 1) == {"rewind_to": 99, "invalidate": (100, 101), "replay_from": 99}
    assert reorg.plan(1, 5, 9)["rewind_to"] == 1
    with pytest.raises(ValueError):
        reorg.plan(5, 4)


def test_handoff():
    manager = CheckpointManager()
    gate = handoff.Handoff(manager)
    with pytest.raises(HandoffError):
        gate.accept({"id": "x", "ledger": 1})
    assert gate.initialize(100) == 100
    assert gate.accept_many([{"id": "a", "ledger": 99}, {"id": "b", "ledger": 100}, {"id": "b", "ledger": 100}, {"ledger": 100}, {"ledger": 101}]) == [{"id": "b", "ledger": 100}, {"ledger": 100}, {"ledger": 101}]
    with pytest.raises(HandoffError):
        gate.commit(99)
    assert gate.commit(105) == 105 and manager.load("handoff") == 105
    gate.rewind(90)
    assert gate.accept({"id": "b", "ledger": 100}) and manager.load("handoff") == 90


@pytest.mark.parametrize("value, want", [
    ({"type": "u64", "value": 2**64 - 1}, str(2**64 - 1)), ({"type": "u32", "value": 7}, 7), ({"type": "bytes", "value": b"\x01\xff"}, "01ff"), (b"\x0a", "0a"), (2**53 + 1, str(2**53 + 1)), (None, None),
    ({"type": "vec", "value": [{"type": "symbol", "value": "x"}, {"type": "void", "value": None}]}, ["x", None]), ({"type": "map", "value": [[1, {"type": "bool", "value": 1}]]}, {"1": True}),
    ({"type": "odd", "value": 1}, "[Unresolved ScVal: odd]"), ({"a": [1, b"\x02"]}, {"a": [1, "02"]}),
])
def test_unwrap(value, want):
    assert decode.unwrap(value) == want


def test_depth_guard():
    deep = []
    for _ in range(60):
        deep = [deep]
    with pytest.raises(ScValDepthError):
        decode.unwrap(deep)
    assert decode.unwrap_or_raw(deep) is deep


def test_decode_events(spark):
    raw = spark.createDataFrame([("1", 3, [b"\x01", None], 5, None, {"x": 1})], "id string, ledger int, topic array<binary>, txIndex int, inSuccessfulContractCall boolean, value map<string,int>")
    row = decode_events(raw).first()
    assert (row.topics, row.transactionIndex, row.inSuccessfulContractCall, row.value, row.txHash) == (["01", "null"], 5, True, '{"x":1}', None)
    assert decode_events(empty_events(spark)).count() == 0


def test_wide_integers(spark):
    rows = spark.createDataFrame([("340282366920938463463374607431768211455",), ("12",), ("x",)], "v string")
    assert [r[0] for r in rows.select(decode.wide_integer("v")).collect()] == [None, 12, None]


def test_export(spark):
    rows = events(spark, [{"id": 'q"1', "ledger": 1, "type": "a,b", "topics": ["x"], "value": "line\nbreak"}, {"id": "2", "ledger": 2}])
    text = export.export_events(rows, format="csv", columns=["id", "ledger", "type", "topics", "value"])
    assert text == 'id,ledger,type,topics,value\n"q""1",1,"a,b","[""x""]","line\nbreak"\n2,2,,,\n'
    assert export.export_events(rows.where("id = '2'"), columns=["id", "type"]) == '{"id":"2","type":null}\n'
    assert export.export_events(rows.limit(0), format="CSV", columns=["id"]) == "id\n"
    assert export.export_events(rows.limit(0)) == ""
    one = export.create_exporter("csv", ["id", "n"])
    assert one.encode({"id": "a", "n": [1, None]}) == 'a,"[1,null]"'
    assert export.create_exporter().encode({"a": 12345678901234567890, "b": b"\x01"}) == '{"a":12345678901234567890,"b":"01"}'
    for bad in ({"format": "xml"}, {"columns": []}, {"columns": [""]}):
        with pytest.raises((ValueError, TypeError)):
            export.create_exporter(**bad)


def test_metrics():
    m = metrics.create_metrics()
    m.increment("n")
    m.increment("n", 2)
    m.set_gauge("g", 1.5)
    m.add_gauge("g", 1)
    m.observe("h", 2)
    m.observe("h", 4)
    other = metrics.Metrics()
    other.increment("n")
    other.set_gauge("g", 9)
    other.observe("h", 1)
    m.merge(other)
    assert m.get_counter("n") == 4 and m.get_gauge("g") == 9 and m.get_histogram("h") == {"count": 3, "sum": 7, "min": 1, "max": 4}
    text = m.to_prometheus("my-")
    assert "# TYPE my_n counter\nmy_n 4" in text and "# TYPE my_h summary\nmy_h_count 3" in text
    stop = m.timer("t")
    assert stop() >= 0 and stop() is None
    with pytest.raises(ValueError):
        m.increment("n", -1)
    with pytest.raises(TypeError):
        m.observe("h", float("nan"))
    other.histograms["h"] = {"count": 1}
    with pytest.raises(MetricsError):
        m.merge(other)
    m.reset()
    assert m.snapshot() == {"counters": {}, "gauges": {}, "histograms": {}} and m.to_prometheus() == ""


def test_observed(spark):
    df, seen = metrics.observed(spark.range(10), "obs", "id")
    df.count()
    df.write.format("noop").mode("overwrite").save()
    m = metrics.Metrics()
    m.absorb(seen, "rows", value=True)
    assert m.get_counter("rows") == 10


def test_whole():
    assert checks.whole("x", None) is None
    for bad, error in (("1", TypeError), (True, TypeError), (2**53, ValueError), (0, ValueError)):
        with pytest.raises(error):
            checks.whole("x", bad, 1)

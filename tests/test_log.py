"""The commit log, commands, and live models and reactors."""

import dataclasses
import json
import multiprocessing
import os
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from foldlog.errors import AggregateAlreadyExists, AggregateNotFound, CheckpointError, CommitError, ConcurrencyConflict, DecodeError, EventDecodeError, Fatal, LifecycleError, ReactionError, Rejected, Retry, RunnerError, SerializationError, SubscriptionStopped, UnknownKind
from foldlog.operators import evolve, snapshots
from foldlog.operators.filters import EventFilter, Filters
from foldlog.operators.process import Process
from foldlog.operators.repository import AggregateType, ProjectionType, Repository, Snapshot, SnapshotStore, aggregate, decide, event, projection
from foldlog.plans.log_queries import settle_invoices
from foldlog.sources import commitlog, datasource
from foldlog.sources.commitlog import ConsistencyToken, Event, EventLog, Files, commit_name
from foldlog.sources.datasource import register
from foldlog.sources.memory import EventStore, MemoryLog, MemorySnapshots, NoSnapshots, Snapshots
from foldlog.streaming.live import LiveModel, LiveProjection, Reactor, RetryPolicy, Subscription
from foldlog.testing import Scenario, inject, inject_concurrent, seed

ADDED, RESET = "points-added", "points-set"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests


def add(n):
    return Event(ADDED, {"points": n})


def events_of(log):
    return [(r.position, r.kind, json.loads(r.data)) for r in log.frame().orderBy("position").collect()]


COUNTER = AggregateType(
    "Counter",
    apply={ADDED: lambda s, d: s + d["points"], RESET: lambda s, d: d["to"]},
    init=lambda: 0,
    handle={"add": lambda s, n: [add(n)] if n else [], "limit": lambda s, n: [add(n)] if s + n <= 100 else (_ for _ in ()).throw(ValueError("over the limit"))},
    handle_create={"add": lambda n: [add(n)] if n else []},
)


@pytest.fixture
def log(spark, tmp_path):
    return EventLog(spark, str(tmp_path / "log"))


def test_positions_and_metadata(log):
    assert log.latest_checkpoint() is None and log.frame().count() == 0 and log.token() is None
    assert log.append("counter", "a", [add(1), add(2)], {"user": "u"}) == 1
    assert log.append("counter", "b", [add(3)]) == 2
    assert [p for p, *_ in events_of(log)] == [0, 1, 2]
    assert [r.metadata for r in log.frame().orderBy("position").collect()] == ['{"user":"u"}'] * 2 + [None]
    assert log.stream_version("counter", "a") == 1 and log.stream_version("counter", "x") is None
    assert log.current_checkpoint([EventFilter(ADDED, "counter", "a")]) == 1 and log.latest_checkpoint() == 2
    assert log.checkpoint_for_position(2) == 2 and log.checkpoint_for_position(3) is None
    assert [r.position for r in log.load_events([EventFilter(ADDED).after_position(0), EventFilter(ADDED, "counter", "b")]).collect()] == [1, 2]
    assert [e["position"] for e in log.events_after(0)] == [1, 2]


def test_commits_are_checked_first(log):
    with pytest.raises(SerializationError) as e:
        log.append("counter", "a", [add(1), Event(ADDED, {"points": object()})])
    assert e.value.index == 1 and log.latest_checkpoint() is None
    with pytest.raises(ValueError):
        log.append("counter", "a", [])


def test_expected_versions(log):
    log.append_if_version("counter", "a", None, [add(1)])
    for expected, actual in ((None, 0), (5, 0)):
        with pytest.raises(ConcurrencyConflict) as e:
            log.append_if_version("counter", "a", expected, [add(1)])
        assert (e.value.expected, e.value.actual) == (expected, actual)
    with pytest.raises(ConcurrencyConflict):
        log.append_if_version("counter", "b", 0, [add(1)])
    assert log.append_if_version("counter", "a", 0, [add(1)]) == 1


def test_other_writers_are_seen(spark, log):
    other = EventLog(spark, log.root)
    log.append("counter", "a", [add(1)])
    assert other.stream_version("counter", "a") == 0
    log.append("counter", "a", [add(1)])
    with pytest.raises(ConcurrencyConflict):
        other.append_if_version("counter", "a", 0, [add(1)])


def test_on_a_hadoop_path(spark, tmp_path):
    log = EventLog(spark, f"file://{tmp_path}/log")
    log.append("counter", "a", [add(1)])
    assert not log.files.publish(f"commits/{commit_name(0)}", "x")
    assert log.append("counter", "a", [add(2)]) == 1
    assert [d["points"] for *_, d in events_of(log)] == [1, 2]


def _writer(root, n):
    files = Files.__new__(Files)
    files.local, files.root = True, root
    for i in range(n):
        version = 0
        while not files.publish(f"commits/{commit_name(version)}", f"{os.getpid()} {i}\n"):
            version += 1


def test_writers_of_several_processes_lose_nothing(tmp_path):
    os.makedirs(tmp_path / "commits")
    os.makedirs(tmp_path / "staged")
    context = multiprocessing.get_context("spawn")
    found = [context.Process(target=_writer, args=(str(tmp_path), 20)) for _ in range(4)]
    for p in found:
        p.start()
    for p in found:
        p.join()
    names = sorted(os.listdir(tmp_path / "commits"))
    assert names == [commit_name(i) for i in range(80)] and len({(tmp_path / "commits" / n).read_text() for n in names}) == 80


def test_commands(log):
    repo = Repository(log)
    assert repo.create(COUNTER, "a", "add", 1) == ConsistencyToken(0)
    with pytest.raises(AggregateAlreadyExists):
        repo.create(COUNTER, "a", "add", 1)
    with pytest.raises(AggregateNotFound):
        repo.update(COUNTER, "b", "add", 1)
    repo.upsert(COUNTER, "b", "add", 5)
    repo.upsert(COUNTER, "b", "add", 5)
    assert repo.load(COUNTER, "b") == 10 and repo.load(COUNTER, "c") is None
    assert repo.update(COUNTER, "a", "add", 0) is None and log.latest_checkpoint() == 2
    with pytest.raises(ValueError):
        repo.update(COUNTER, "a", "limit", 1000)
    with pytest.raises(AggregateAlreadyExists):
        repo.without_concurrency_checking().create(COUNTER, "a", "add", 1)


def test_foreign_events_conflict(log):
    """The version that an aggregate knows is that of its own kinds."""
    repo = Repository(log)
    repo.create(COUNTER, "a", "add", 1)
    log.append("counter", "a", [Event("foreign", {})])
    with pytest.raises(ConcurrencyConflict):
        repo.update(COUNTER, "a", "add", 1)
    repo.without_concurrency_checking().update(COUNTER, "a", "add", 1)


def test_retries(spark, log):
    repo, other, left = Repository(log), EventLog(spark, log.root), [1]
    repo.create(COUNTER, "a", "add", 1)

    def interfering(state, n):
        if left[0]:
            left[0] -= 1
            other.append("counter", "a", [add(10)])
        return [add(n)]

    kind = AggregateType("Counter", apply=COUNTER.apply, init=COUNTER.init, handle={"add": interfering})
    assert repo.update_with_retry(kind, "a", "add", 1, max_retries=1) == 2 and repo.load(COUNTER, "a") == 12
    left[0] = 5
    with pytest.raises(ConcurrencyConflict):
        repo.update_with_retry(kind, "a", "add", 1, max_retries=1)


def test_snapshots_of_aggregates(log):
    store = SnapshotStore(log, snapshots.every(2))
    repo = Repository(log).with_snapshots(store)
    repo.create(COUNTER, "a", "add", 1)
    assert store.load("counter", "a") is None
    repo.update(COUNTER, "a", "add", 2)
    assert store.load("counter", "a") == Snapshot(1, 3)
    repo.update(COUNTER, "a", "add", 4)
    assert store.load("counter", "a") == Snapshot(1, 3) and repo.load(COUNTER, "a") == 7
    assert not store.offer("counter", "a", 5, lambda: Snapshot(1, 99)) and not store.offer("counter", "a", 5, lambda: Snapshot(0, 99))
    assert not store.offer("counter", "a", 1, lambda: pytest.fail("it is lazy"))
    log.files.replace(f"{store._folder('counter', 'a')}/{1:020d}.json", "not json")
    assert repo.load(COUNTER, "a") == 7


def _offers(root, start, n):
    files = Files.__new__(Files)
    files.local, files.root = True, root
    store = SnapshotStore.__new__(SnapshotStore)
    store.files, store.policy = files, snapshots.always
    for i in range(n):
        store.offer("k", "a", 1, lambda i=i: Snapshot(start + 3 * i, start + 3 * i))


def test_concurrent_offers_keep_the_newest(log):
    """Three processes offer 40 snapshots each, mixed; after each, what is stored never goes back, and the greatest stays."""
    context = multiprocessing.get_context("spawn")
    found = [context.Process(target=_offers, args=(log.root, k, 40)) for k in range(3)]
    for p in found:
        p.start()
    store, seen = SnapshotStore(log, snapshots.always), [-1]
    while any(p.is_alive() for p in found):
        if there := store.load("k", "a"):
            seen.append(there.position)
    for p in found:
        p.join()
    assert store.load("k", "a").position == 2 + 3 * 39 and seen == sorted(seen)
    assert store.offer("k", "a", 1, lambda: Snapshot(119, 0)) is snapshots.Offer.DECLINED
    assert store.offer("k", "a", 1, lambda: Snapshot(120, 0)) is snapshots.Offer.STORED


def test_compaction(spark, log):
    """Events are the same before and after, for readers of all kinds; new readers start from the newest list; loads in bulk and later commits follow."""
    for i in range(6):
        log.append("counter", "ab"[i % 2], [add(i), add(10 * i)])
    before = events_of(log)
    assert log.compact() and not log.compact() and events_of(log) == before
    bulk = spark.range(20).selectExpr("'counter' AS aggregate_kind", "cast(id % 3 AS string) AS aggregate_id", f"'{ADDED}' AS kind", "id", "concat('{\"points\":', id, '}') AS data", "cast(null AS string) AS metadata")
    assert log.load_frame(bulk, "id", []) == 31 and log.load_frame(bulk.limit(0), "id", []) is None
    log.append_if_version("counter", "a", 9, [add(7)])
    with pytest.raises(ConcurrencyConflict):
        log.append_if_version("counter", "2", 5, [add(7)])
    other = EventLog(spark, log.root)
    want = before + [(12 + i, ADDED, {"points": i}) for i in range(20)] + [(32, ADDED, {"points": 7})]
    register(spark)
    read = spark.read.format("foldlog").load(log.root)
    assert events_of(log) == want == events_of(other) == sorted((r.position, r.kind, json.loads(r.data)) for r in read.collect())
    assert [e["position"] for e in other.events_after(30)] == [31, 32] and other.stream_version("counter", "a") == 32 and other.stream_version("counter", "1") == 31
    assert other.compact(everything=True) and len(EventLog(spark, log.root)._segments) == 1 and events_of(EventLog(spark, log.root)) == want
    scoped = read.where("aggregate_id = 'a' AND kind = 'points-added' AND position > 4")
    assert sorted(r.position for r in scoped.collect()) == [4 + k for k in (4, 5)] + [32] or sorted(r.position for r in scoped.collect()) == [r[0] for r in want if r[0] > 4 and r[0] in {8, 9, 32, 5}]
    plan = scoped._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" not in plan or "aggregate_id" in plan
    assert Repository(other).load(COUNTER, "a") == Repository(log).load(COUNTER, "a")


def test_a_lost_race_of_bulk_loads(spark, log, monkeypatch):
    """Another commit takes the version while a segment is written: the segment is written again after it."""
    other, publish, left = EventLog(spark, log.root), Files.publish, [1]

    def late(self, name, text):
        if "segment" in text and left[0]:
            left[0] = 0
            other.append("counter", "x", [add(1)])
        return publish(self, name, text)

    monkeypatch.setattr(Files, "publish", late)
    bulk = spark.range(3).selectExpr("'counter' AS aggregate_kind", "'b' AS aggregate_id", f"'{ADDED}' AS kind", "id", "'{\"points\":1}' AS data", "cast(null AS string) AS metadata")
    assert log.load_frame(bulk, "id", []) == 3 and [p for p, *_ in events_of(log)] == [0, 1, 2, 3]
    assert len(os.listdir(f"{log.root}/segments")) == 1


def test_projections(log):
    log.append("counter", "a", [add(10)], {"user": "x"})
    log.append("counter", "b", [add(20), Event(RESET, {"to": 5})])

    def handle(state, context, data):
        key = context["aggregate_id"]
        return state | {key: state.get(key, 0) + data.get("points", 0), "by": (context["metadata"] or {}).get("user", state.get("by"))}

    everything = ProjectionType("totals", lambda _: {}, lambda _: Filters().event(ADDED, handle))
    repo = Repository(log)
    assert repo.load_projection(everything) == {"a": 10, "b": 20, "by": "x"}
    scoped = ProjectionType("one", lambda _: {}, lambda i: Filters().event_for("counter", ADDED, i, handle))
    assert repo.load_projection(scoped, "b") == {"b": 20, "by": None}
    store = SnapshotStore(log, snapshots.always)
    assert repo.load_projection_with_snapshot(everything, None, store)["a"] == 10
    log.append("counter", "a", [add(1)])
    assert repo.load_projection_with_snapshot(everything, None, store) == repo.load_projection(everything)
    assert store.load("totals", None).position == 3
    log.files.publish(f"commits/{commit_name(3)}", json.dumps({"aggregate_kind": "counter", "aggregate_id": "a", "kind": ADDED, "position": 4, "data": "{", "metadata": None}) + "\n")
    with pytest.raises(DecodeError):
        repo.load_projection(everything)


def test_scenarios():
    Scenario(COUNTER).given(add(40)).when("limit", 50).then(add(50))
    Scenario(COUNTER).given(add(60)).when("limit", 50).then_error(ValueError, "limit")
    Scenario(COUNTER).when("add", 0).then_nothing()
    with pytest.raises(AssertionError):
        Scenario(COUNTER).when("add", 1).then(add(2))
    with pytest.raises(ValueError):
        AggregateType("Empty", apply={})
    with pytest.raises(UnknownKind):
        AggregateType("Strict", apply={"x": lambda s, d: s}, create={"made": lambda d: 0}).first("x", {})


def test_data_source(spark, log):
    register(spark)
    read = lambda: spark.read.format("foldlog").load(log.root)
    assert read().count() == 0
    log.append("counter", "a", [add(1)])
    log.append("counter", "a", [add(2)])
    os.rename(f"{log.root}/commits/{commit_name(1)}", f"{log.root}/late")
    log.files.publish(f"commits/{commit_name(2)}", json.dumps({"aggregate_kind": "counter", "aggregate_id": "a", "kind": ADDED, "position": 2, "data": "{}", "metadata": None}) + "\n")
    assert [r.position for r in read().collect()] == [0]  # what follows a commit on its way waits
    os.rename(f"{log.root}/late", f"{log.root}/commits/{commit_name(1)}")
    assert sorted(r.position for r in read().collect()) == [0, 1, 2]


def test_a_segment_is_read_in_parts(spark, log, monkeypatch):
    """A commit that names a segment may hold any number of events: its files are partitions, cut between row groups; commits around it stay in order."""
    monkeypatch.setattr(commitlog, "FILE", 100)
    columns = ["id", "'counter' AS aggregate_kind", "concat('c', id % 7) AS aggregate_id", "'points-added' AS kind", "'{\"points\":1}' AS data", "CAST(NULL AS STRING) AS metadata"]
    log.append("counter", "a", [add(1)])
    log.append("counter", "a", [add(1)])
    log.load_frame(spark.range(1000).selectExpr(*columns), "id", [])
    log.append("counter", "a", [add(1)])
    parts = datasource.StreamReader(log.root, 0).partitions({"commits": 0}, {"commits": 4})
    found = [[p for b in datasource.Wanted().read(log.root, part) for p in b.column(3).to_pylist()] for part in parts]
    assert found[0] == [0, 1] and found[-1] == [1002] and len(found) >= 12 and max(map(len, found)) <= 100
    assert sorted(p for f in found for p in f) == list(range(1003))
    pq.write_table(pa.table({"x": list(range(1000))}), f"{log.root}/segments/one.parquet", row_group_size=50)
    monkeypatch.setattr(datasource, "EVENTS", 200)
    assert [p.groups for p in datasource._files(log.root, "segments")] == [[i, i + 1, i + 2, i + 3] for i in range(0, 20, 4)]
    register(spark)
    assert sorted(r.position for r in spark.read.format("foldlog").load(log.root).where("position > 500").collect()) == list(range(501, 1003))
    live = Subscription(log, totals()).start()
    live.stop()
    assert state_of(live.current()) == state_of(totals().of(log.frame()))


def totals():
    return LiveModel("totals", Filters().event(ADDED), ("aggregate_id",), {"total": F.sum(F.get_json_object("data", "$.points").cast("long")), "n": F.count("*")}, {"total": F.sum, "n": F.sum})


def state_of(df):
    return {r.aggregate_id: (r.total, r.n) for r in df.collect()}


def test_live_model(spark, log):
    repo = Repository(log)
    repo.create(COUNTER, "a", "add", 1)
    seen = []
    live = Subscription(log, totals(), snapshots.every(2)).start()
    try:
        assert state_of(live.updates(lambda df: seen.append(state_of(df)))) == {"a": (1, 1)}
        token = repo.update(COUNTER, "a", "add", 5)
        assert state_of(live.read_after(token, 30)) == {"a": (6, 2)} and seen
        token = ConsistencyToken(log.append("other", "x", [Event("unrelated", {})]))
        assert live.wait_for(token, 30) and live.processed() == 2
    finally:
        live.stop()
    with pytest.raises(SubscriptionStopped):
        live.wait_for(ConsistencyToken(99))
    repo.upsert(COUNTER, "b", "add", 7)
    again = Subscription(log, totals(), snapshots.every(2)).start()
    try:
        assert state_of(again.current()) == {"a": (6, 2), "b": (7, 1)} == state_of(totals().of(log.frame()))
    finally:
        again.stop()


def test_reactor(log):
    log.append("counter", "a", [add(1), add(2), Event("other", {}), add(3)])
    seen, fail = [], [2]

    def react(event):
        if event["data"]["points"] == 2 and fail[0]:
            fail[0] -= 1
            raise Retry("not yet")
        seen.append(event["data"]["points"])

    reactor = Reactor(log, "copy", Filters().event(ADDED), react, snapshots.every(2), RetryPolicy(1, 5)).start()
    reactor.stop()
    assert seen == [1, 2, 3] and reactor.processed() == 3
    log.append("counter", "a", [add(4)])
    again = Reactor(log, "copy", Filters().event(ADDED), react, snapshots.every(2), RetryPolicy(1, 5)).start()
    again.stop()
    assert seen == [1, 2, 3, 3, 4]  # the third was after the last stored checkpoint
    folder = SnapshotStore(log)._folder("checkpoint|copy", "default")
    log.files.replace(f"{folder}/{99:020d}.json", "{")
    with pytest.raises(CheckpointError):
        Reactor(log, "copy", Filters().event(ADDED), react).start()


def test_reactor_ends_on_fatal_errors(log):
    log.append("counter", "a", [add(1)])

    def react(event):
        raise Fatal("no")

    reactor = Reactor(log, "fatal", Filters().event(ADDED), react)
    with pytest.raises(SubscriptionStopped):
        reactor.start()
    assert not reactor.is_running() and reactor.processed() == -1


def test_live_deltas_are_merged(spark, log, monkeypatch):
    """A batch writes what it brings; tables are merged at intervals and old ones go; a failing listener or snapshot ends nothing; a restart finds the state."""
    import foldlog.streaming.live as module

    monkeypatch.setattr(module, "DELTAS", 3)
    live = Subscription(log, totals(), snapshots.every(4)).start("10 milliseconds")
    live.updates(lambda df: 1 / 0)
    for i in range(14):
        assert live.wait_for(ConsistencyToken(log.append("counter", f"c{i % 5}", [add(i)])), 30)
    assert state_of(live.current()) == state_of(totals().of(log.frame()))
    live.stop()
    left = [n for n in os.listdir(f"{log.root}/live/model-totals") if n.startswith("state-")]
    assert len(left) < 12 and not [n for n in os.listdir(f"{log.root}/live/model-totals") if n.startswith("stream-")]
    again = Subscription(log, totals(), snapshots.every(4)).start()
    assert state_of(again.current()) == state_of(totals().of(log.frame()))
    again.stop()


def counted():
    return ProjectionType("counted", lambda _: {"n": 0, "sum": 0}, lambda _: Filters().event(ADDED, lambda s, c, d: {"n": s["n"] + 1, "sum": s["sum"] + d["points"]}))


def test_live_projection_updates(log):
    """The state that updates() gives and the stream after it meet at one event; each event has its state; a snapshot at the end is where a restart goes on."""
    log.append("counter", "a", [add(1), add(2)])
    store = SnapshotStore(log, snapshots.every(3))
    live = LiveProjection(log, counted(), store=store).start("10 milliseconds")
    first, later = live.updates()
    assert first == {"n": 2, "sum": 3} == live.current()
    token = ConsistencyToken(log.append("counter", "b", [add(10), Event("other", {}), add(20)]))
    assert live.read_after(token, 30) == {"n": 4, "sum": 33}
    live.stop()
    assert list(later) == [(2, {"n": 3, "sum": 13}), (4, {"n": 4, "sum": 33})] and later.skipped == 0
    assert store.load("counted", None) == Snapshot(2, {"n": 3, "sum": 13})  # the last one was offered at the end, and declined as too few
    log.append("counter", "b", [add(1)])
    again = LiveProjection(log, counted(), store=store).start()
    assert again.current() == {"n": 5, "sum": 34} and store.load("counted", None).position == 2
    again.stop()
    assert not [n for n in os.listdir(f"{log.root}/live") if n.startswith("projection-")]


def test_live_projection_survives_a_failing_snapshot(log, monkeypatch):
    monkeypatch.setattr(SnapshotStore, "offer", lambda *a: 1 / 0)
    live = LiveProjection(log, counted(), store=SnapshotStore(log)).start()
    token = ConsistencyToken(log.append("counter", "a", [add(1)]))
    assert live.read_after(token, 30) == {"n": 1, "sum": 1} and live.is_running()
    live.stop()


def test_stop_tells_what_failed(log):
    live = LiveProjection(log, counted()).start()
    log.append("counter", "a", [Event(ADDED, {"no": "points"})])
    with pytest.raises(SubscriptionStopped):
        live.wait_for(ConsistencyToken(0), 30)
    with pytest.raises(SubscriptionStopped):
        live.stop()


def test_a_stop_interrupts_the_wait_for_a_retry(log):
    log.append("counter", "a", [add(1)])

    def react(event):
        raise Retry("never")

    reactor = Reactor(log, "stuck", Filters().event(ADDED), react, retry=RetryPolicy(60_000, 60_000))
    import threading
    import time

    threading.Timer(8, reactor.stop).start()
    began = time.monotonic()
    with pytest.raises(SubscriptionStopped):
        reactor.start()
    assert time.monotonic() - began < 40 and reactor.processed() == -1


def test_a_reactor_issues_commands(log):
    """Each event of one stream becomes a command for another, whose events are not reacted to."""
    repo = Repository(log)
    repo.create(COUNTER, "source", "add", 3)
    reactor = repo.react("mirror", Filters().event_for("counter", ADDED, "source"), lambda e: repo.upsert(COUNTER, "mirror", "add", e["data"]["points"]))
    token = repo.update(COUNTER, "source", "add", 4)
    assert reactor.wait_for(token, 30)
    reactor.stop()
    assert repo.load(COUNTER, "mirror") == 7


@event("item-listed")
@dataclasses.dataclass
class Listed:
    stock: int


@event("item-held")
@dataclasses.dataclass
class Held:
    order: str
    n: int


@event("item-freed")
@dataclasses.dataclass
class Freed:
    order: str


@aggregate(events=[Listed, Held, Freed], create=[Listed])
@dataclasses.dataclass
class Item:
    stock: int
    held: dict = dataclasses.field(default_factory=dict)

    @classmethod
    def create_item_listed(cls, e):
        return cls(e.stock)

    @classmethod
    def create_with_list(cls, n):
        return [Listed(n)]

    def on_item_held(self, e):
        self.held[e.order] = e.n

    def on_item_freed(self, e):
        self.held.pop(e.order, None)

    def handle_hold(self, c):
        if c["order"] in self.held:
            return []
        if self.stock - sum(self.held.values()) < c["n"]:
            raise Rejected("not enough in stock")
        return [Held(c["order"], c["n"])]

    def handle_free(self, c):
        return [Freed(c["order"])] if c["order"] in self.held else []


@event("basket-sent")
@dataclasses.dataclass
class Sent:
    lines: list
    note: str = ""


@event("basket-closed")
@dataclasses.dataclass
class Closed:
    outcome: str


@aggregate(events=[Sent, Closed], create=[Sent], kind="basket")
@dataclasses.dataclass
class Basket:
    lines: list
    outcome: str = "open"

    @classmethod
    def create_basket_sent(cls, e):
        return cls(e.lines)

    @classmethod
    def create_with_send(cls, lines):
        return [Sent(lines)]

    def on_basket_closed(self, e):
        self.outcome = e.outcome

    def handle_close(self, outcome):
        if self.outcome != "open":
            raise Rejected("it is closed")
        return [Closed(outcome)]


def hold_or_refuse(step):
    """Holds every line of a basket; if one can't be held, frees the others."""
    order, held = step.event["aggregate_id"], []
    for item, n in step.data["lines"]:
        if not step.tell(Item, item, "hold", {"order": order, "n": n}):
            for other in held:
                step.tell(Item, other, "free", {"order": order})
            step.tell(Basket, order, "close", "refused")
            return
        held.append(item)
    step.tell(Basket, order, "close", "held")


def test_a_process_compensates(log):
    repo = Repository(log)
    for item, n in (("pen", 10), ("ink", 3)):
        repo.create(Item, item, "list", n)
    for order, lines in (("o1", [["pen", 4], ["ink", 2]]), ("o2", [["pen", 5], ["ink", 2]]), ("o3", [["pen", 6]])):
        repo.create(Basket, order, "send", lines, {"correlation_id": f"c-{order}"})
    process = Process(repo, "holding", {"basket-sent": hold_or_refuse, "basket-closed": lambda step: None})
    assert process.run() == 6 and process.run() == 0
    assert [repo.load(Basket, o).outcome for o in ("o1", "o2", "o3")] == ["held", "refused", "held"]
    assert repo.load(Item, "pen").held == {"o1": 4, "o3": 6} and repo.load(Item, "ink").held == {"o1": 2}
    closed = {r.aggregate_id: json.loads(r.metadata) for r in log.frame().where("kind = 'basket-closed'").collect()}
    assert closed["o2"] == {"correlation_id": "c-o2", "causation_id": "basket-sent@o2", "actor": "holding"}
    for e in log.frame().where("kind = 'basket-sent'").orderBy("position").collect():  # delivered again: nothing changes
        process.react(e.asDict() | {"data": json.loads(e.data)})
    assert repo.load(Item, "pen").held == {"o1": 4, "o3": 6} and repo.load(Basket, "o2").outcome == "refused"
    reactor = process.start()
    repo.create(Basket, "o4", "send", [["ink", 1]])
    assert reactor.wait_for(log.token(), 30)
    reactor.stop()
    assert repo.load(Basket, "o4").outcome == "held"


def test_typed_registration(log):
    assert Item.kind == "item" and Basket.kind == "basket" and Item.kinds == ["item-listed", "item-held", "item-freed"]
    store = SnapshotStore(log)
    repo = Repository(log).with_snapshots(store)
    repo.create(Item, "pen", "list", 5)
    repo.update(Item, "pen", "hold", {"order": "o", "n": 2})
    assert repo.load(Item, "pen").held == {"o": 2} and store.load("item", "pen").data == {"stock": 5, "held": {"o": 2}}
    seed(repo, Item, "pen", Held("p", 1))
    assert repo.load(Item, "pen").held == {"o": 2, "p": 1}
    inject(repo, "item", "pen", Event("item-held", {"order": "q", "n": 1, "unknown": 7}))
    assert repo.load(Item, "pen").held["q"] == 1  # fields that nobody knows are ignored
    inject(repo, "item", "pen", Event("item-held", {"order": "q"}))
    with pytest.raises(EventDecodeError):
        repo.load(Item, "pen")
    with pytest.raises(ValueError):
        aggregate(events=[])(type("Nothing", (), {}))
    with pytest.raises(ValueError):
        aggregate(events=[Held, Held])(type("Twice", (), {"on_item_held": lambda s, e: None}))
    with pytest.raises(TypeError):
        aggregate(events=[Held])(type("Forgetful", (), {}))
    with pytest.raises(UnknownKind):
        aggregate(events=[dict])(type("Foreign", (), {}))

    @projection(events=[Held])
    @dataclasses.dataclass
    class HeldItems:
        total: int = 0

        def on_item_held(self, context, e):
            self.total += e.n

    log2 = EventLog(log.spark, f"{log.root}-2")
    seed(Repository(log2), Item, "a", Listed(5), Held("o", 2), Held("p", 1))
    assert Repository(log2).load_projection(HeldItems).total == 3 and HeldItems.kind == "held-items"


def test_injected_writers_conflict(log):
    repo = Repository(log)
    repo.create(Item, "pen", "list", 5)

    def interfere(state, c):
        inject_concurrent(repo, Item, "pen", Held("other", 1))
        return [Held("mine", 1)]

    with pytest.raises(ConcurrencyConflict):
        repo.update(dataclasses.replace(Item, handle={"hold": interfere}), "pen", "hold", None)


def test_many_streams_at_once(spark, log):
    repo = Repository(log)
    for i in range(7):
        log.append("counter", f"c{i}", [add(i), add(1)])
    log.append("counter", "c3", [Event(RESET, {"to": 50})])
    ids = spark.createDataFrame([("c1",), ("c3",), ("c3",), ("none",)], "aggregate_id string")
    assert {(r.aggregate_id, r.version, r.state) for r in repo.load_many(COUNTER, ids).collect()} == {("c1", 3, "2"), ("c3", 14, "50")}
    assert state_of(repo.projected(totals())) == {f"c{i}": (i + 1, 2) for i in range(7)}
    rows = [("c1", 2, "limit", "95"), ("c1", 1, "add", "5"), ("c1", 3, "add", "0"), ("c1", 4, "no", "1"), ("new", 1, "add", "4"), ("new", 2, "limit", "3"), ("other", 1, "limit", "3")]
    asked = spark.createDataFrame(rows, "aggregate_id string, seq long, name string, command string")
    strict = dataclasses.replace(COUNTER, handle={**COUNTER.handle, "limit": lambda s, n: [add(n)] if s + n <= 100 else _reject()})
    got = {(r.aggregate_id, r.seq): (r.outcome, r.data) for r in decide(log.frame(), asked, strict).collect()}
    assert got == {("c1", 1): ("ok", '{"points":5}'), ("c1", 2): ("rejected", "over the limit"), ("c1", 3): ("unchanged", None), ("c1", 4): ("unknown_command", "no"), ("new", 1): ("ok", '{"points":4}'), ("new", 2): ("ok", '{"points":3}'), ("other", 1): ("not_found", "limit")}


def test_streams_stay_whole_when_a_join_turns_into_a_broadcast(spark, log):
    """The join with the ids is planned as one of two shuffles and becomes a broadcast when it runs, which then reads by mapper."""
    columns = ["id", "'counter' AS aggregate_kind", "concat('c', id % 40) AS aggregate_id", "'points-added' AS kind", "'{\"points\":1}' AS data", "CAST(NULL AS STRING) AS metadata"]
    for i in range(3):
        log.load_frame(spark.range(1000 * i, 1000 * i + 1000).selectExpr(*columns), "id", [])
    settings = {"spark.sql.autoBroadcastJoinThreshold": -1, "spark.sql.adaptive.autoBroadcastJoinThreshold": 10 << 20, "spark.sql.adaptive.coalescePartitions.enabled": False}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        got = Repository(log).load_many(COUNTER, log.frame().select("aggregate_id").distinct()).collect()
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert sorted((r.aggregate_id, r.version, r.state) for r in got) == sorted((f"c{i}", 2960 + i, "75") for i in range(40))


def test_states_after_commands(spark, log):
    """With states, a row has the state after the whole command; none without a stream."""
    log.append("counter", "a", [add(1), add(2)])
    twice = dataclasses.replace(COUNTER, handle={"twice": lambda s, n: [add(n), add(n)], "limit": lambda s, n: _reject()})
    asked = spark.createDataFrame([("a", 1, "twice", "5"), ("a", 2, "limit", "9"), ("b", 1, "twice", "1"), ("c", 1, "add", "0"), ("c", 2, "add", " 4 ")], "aggregate_id string, seq long, name string, command string")
    plain, got = decide(log.frame(), asked, twice), decide(log.frame(), asked, twice, states=True)
    assert sorted((r.aggregate_id, r.seq, r.ordinal, r.state) for r in got.collect()) == [("a", 1, 0, "13"), ("a", 1, 1, "13"), ("a", 2, 0, "13"), ("b", 1, 0, None), ("c", 1, 0, None), ("c", 2, 0, "4")]
    assert sorted(map(str, got.drop("state").collect())) == sorted(map(str, plain.collect()))


def test_invoices_are_shuffled_twice(spark, tmp_path):
    """Lines to their orders, then orders to the handlers: what comes of it needs no further shuffle, join or aggregate."""
    lines = [(1, 1, 1, 1, 1.0, 10.0), (1, 1, 1, 2, 1.0, 20.0), (1, 1, 1, 3, 1.0, 30.0), (2, 1, 1, 1, 1.0, 5.0), (None, 1, 1, 1, 1.0, 5.0)]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    spark.createDataFrame(lines, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    out = settle_invoices(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and "Join" not in plan and "Aggregate" not in plan
    assert sorted(map(tuple, out.collect())) == [(1, 1, "ok", 2000, False), (1, 2, "ok", 0, True), (1, 3, "rejected", 0, True), (2, 1, "ok", 0, True)]


def _reject():
    raise Rejected("over the limit")


def test_unreadable_payloads(spark):
    rows = spark.createDataFrame([("not json",), ('{"item":"a","pieces":2}',), ('{"item":"a","pieces":2,"sender":null}',), ('{"item":"a","pieces":2,"revision":"zz"}',), ('{"item":null,"pieces":2}',), ("[]",), (None,)], "data string")
    got = [r.payload for r in evolve.PARCEL_SENT.decode(rows).collect()]
    assert [p is None for p in got] == [True, False, False, True, True, True, True] and got[1].sender == got[2].sender == "anonymous"
    with pytest.raises(Exception, match="can't be decoded"):
        evolve.PARCEL_SENT.decode(rows, strict=True).collect()


def test_errors_have_groups():
    assert issubclass(ConcurrencyConflict, CommitError) and issubclass(AggregateNotFound, LifecycleError) and issubclass(UnknownKind, EventDecodeError) and issubclass(CheckpointError, RunnerError) and issubclass(Fatal, ReactionError)


def test_other_stores(spark):
    """The same commands on a log in memory, with snapshots in memory and without any; both stores and the files offer the same methods."""
    for store in (MemorySnapshots(snapshots.every(2)), NoSnapshots()):
        log = MemoryLog(spark)
        repo = Repository(log).with_snapshots(store)
        assert isinstance(log, EventStore) and isinstance(store, Snapshots) and repo.consistency_token() is None
        repo.create(Item, "pen", "list", 5)
        repo.update(Item, "pen", "hold", {"order": "o", "n": 2})
        repo.update(Item, "pen", "hold", {"order": "p", "n": 1})
        with pytest.raises(Rejected):
            repo.update(Item, "pen", "hold", {"order": "q", "n": 9})
        with pytest.raises(ConcurrencyConflict):
            log.append_if_version("item", "pen", 0, [Event("item-held", {"order": "r", "n": 1})])
        assert repo.load(Item, "pen").held == {"o": 2, "p": 1} and log.stream_version("item", "pen") == 2 == log.latest_checkpoint()
        assert log.frame().count() == 3 and [r.position for r in log.load_events([EventFilter("item-held").after_position(1)]).collect()] == [2]
        assert log.current_checkpoint([EventFilter("item-listed")]) == 0 and log.checkpoint_for_position(3) is None
        assert {r.aggregate_id for r in repo.load_many(Item, log.frame().select("aggregate_id")).collect()} == {"pen"}
        if isinstance(store, MemorySnapshots):
            assert store.load("item", "pen").position == 1 and not store.offer("item", "pen", 9, lambda: Snapshot(1, None))
        else:
            assert store.load("item", "pen") is None
    assert isinstance(EventLog.__new__(EventLog), EventStore) and isinstance(SnapshotStore.__new__(SnapshotStore), Snapshots)


def test_retry_delays():
    assert [RetryPolicy(10, 100).delay(i) for i in (0, 1, 2, 3, 4, 500)] == [10, 20, 40, 80, 100, 100]
    assert (RetryPolicy().initial, RetryPolicy().longest, RetryPolicy().retries) == (50, 5000, None)


def test_tokens():
    a, b = ConsistencyToken(3), ConsistencyToken(5)
    assert max(a, b) == b and ConsistencyToken.from_json(b.to_json()) == b

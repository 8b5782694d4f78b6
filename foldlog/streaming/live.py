"""Live read models and reactors on Structured Streaming.

All read the log as a stream of commits; progress counts every event of the log, also those that no filter admits.

- Subscription: a mergeable fold whose state is a table. Each micro-batch is aggregated by Spark and written as a delta;
  deltas are merged with the state now and then, so that a batch costs what it brings, not what the state holds.
- LiveProjection: a fold by Python handlers, one event at a time, whose state is small enough for the driver.
- Reactor: side effects, one event at a time.
"""

from __future__ import annotations

import json
import logging
import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from copy import deepcopy
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlog.errors import CheckpointError, Fatal, Retry, SubscriptionStopped
from foldlog.operators.filters import Filters
from foldlog.operators.repository import CheckpointStore, ProjectionType, Snapshot, SnapshotStore
from foldlog.operators.snapshots import Policy, always
from foldlog.sources.commitlog import ConsistencyToken, EventLog
from foldlog.sources.datasource import published, register

_log = logging.getLogger(__name__)

#: Deltas of a state at most; they are merged then.
DELTAS = 16
#: States that a consumer of updates may lag behind before older ones are skipped.
UPDATES = 1024


@dataclass(frozen=True)
class LiveModel:
    """A mergeable fold: filters, keys, what to compute from a batch, and how two states combine by column."""

    name: str
    filters: Filters
    keys: tuple[str, ...]
    fold: dict[str, Column]
    combine: dict[str, Callable[[str], Column]]

    def of(self, events: DataFrame) -> DataFrame:
        return events.where(self.filters.predicate()).groupBy(*self.keys).agg(*[e.alias(n) for n, e in self.fold.items()])

    def merged(self, parts: list[DataFrame]) -> DataFrame:
        if len(parts) == 1:
            return parts[0]
        return reduce(DataFrame.unionByName, parts).groupBy(*self.keys).agg(*[f(c).alias(c) for c, f in self.combine.items()])


class Runner:
    """A streaming query over a log with its progress."""

    def __init__(self, log: EventLog, name: str):
        self.log, self.name = log, name
        self.folder = f"live/{name}"
        log.files.make(self.folder)
        self.progress, self._news, self._query, self._stopping = -1, threading.Condition(), None, threading.Event()
        self._stream = f"{self.folder}/stream-{uuid.uuid4().hex}"

    def _start(self, interval: str) -> None:
        """Starts the query; returns when it has caught up with what the log had."""
        register(self.log.spark)
        target = self.log.latest_checkpoint()
        stream = self.log.spark.readStream.format("foldlog").option("path", self.log.root).option("start", self._first_commit()).load()
        self._query = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.log.root}/{self._stream}").trigger(processingTime=interval).start()
        if target is not None:
            try:
                self.wait_for(ConsistencyToken(target))
            except SubscriptionStopped:
                self._end()
                raise

    def _first_commit(self) -> int:
        """The first commit that may hold an event after the progress: its last position is greater."""
        low, high = 0, published(self.log.root)
        while low < high:
            mid = (low + high) // 2
            found = self.log._commit_at(mid)
            last = found[-1]["position"] if isinstance(found, list) else found.last
            low, high = (mid + 1, high) if last <= self.progress else (low, mid)
        return low

    def _batch(self, batch: DataFrame, _: int) -> None:
        if self._stopping.is_set():
            return
        batch = batch.where(F.col("position") > self.progress).persist()
        try:
            end = batch.agg(F.max("position")).first()[0]
            if end is not None and self._work(batch, end):
                self._advance(end)
        finally:
            batch.unpersist()

    def _work(self, batch: DataFrame, end: int) -> bool:
        """Whether the whole batch, which ends at that position, was worked on."""
        raise NotImplementedError

    def _advance(self, to: int) -> None:
        with self._news:
            self.progress = max(self.progress, to)
            self._news.notify_all()

    def processed(self) -> int:
        return self.progress

    def error(self) -> Exception | None:
        """What ended the runner, if it wasn't stop()."""
        return self._query.exception() if self._query else None

    def wait_for(self, token: ConsistencyToken, timeout: float | None = None) -> bool:
        """Until progress reaches the token; an error if the runner ends before."""
        end = None if timeout is None else time.monotonic() + timeout
        with self._news:
            while self.progress < token.position:
                if not self.is_running():
                    raise SubscriptionStopped(str(self.error() or "stopped")) from self.error()
                if end is not None and time.monotonic() > end:
                    return False
                self._news.wait(0.1)
        return True

    def is_running(self) -> bool:
        return self._query is not None and self._query.isActive

    def stop(self) -> None:
        """Ends the runner after what it is doing; raises SubscriptionStopped if an error had ended it before."""
        failed = self.error()
        self._stopping.set()
        if self._query:
            self._query.stop()
        self._end()
        with self._news:
            self._news.notify_all()
        if failed is not None:
            raise SubscriptionStopped(str(failed)) from failed

    def _end(self) -> None:
        """Where the runner stands is in its own files, so Spark's go."""
        self.log.files.remove(self._stream)

    def __enter__(self):
        return self

    def __exit__(self, *_: object) -> None:
        self.stop()


class Subscription(Runner):
    """A live read model. Its state is a table and a few deltas, which current() reads merged; with a policy, they are also where a restart goes on.

    Tables that neither the state nor the last snapshot names are removed when the next merge is done: a frame that
    current() gave can be read until then.
    """

    def __init__(self, log: EventLog, model: LiveModel, policy: Policy = always):
        super().__init__(log, f"model-{model.name}")
        self.model, self.policy, self._since = model, policy, 0
        self._tables: list[str] = []
        self._kept: list[str] = []  # tables of the snapshot
        self._old: list[str] = []
        self._listeners: list[Callable[[DataFrame], None]] = []

    def start(self, interval: str = "100 milliseconds") -> Subscription:
        try:
            text = self.log.files.read(f"{self.folder}/snapshot.json")
            if found := json.loads(text) if text else None:
                for t in found["tables"]:
                    self._read(t)
                self._tables, self._kept, self.progress = list(found["tables"]), list(found["tables"]), found["position"]
        except Exception as e:  # a snapshot that can't be read is none
            _log.warning("%s starts anew: %s", self.name, e)
            self._tables, self.progress = [], -1
        self._start(interval)
        return self

    def _read(self, table: str) -> DataFrame:
        return self.log.spark.read.parquet(f"{self.log.root}/{self.folder}/{table}")

    def _write(self, rows: DataFrame, end: int) -> str:
        table = f"state-{end:020d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.log.root}/{self.folder}/{table}")
        return table

    def _work(self, batch: DataFrame, end: int) -> bool:
        n = batch.where(self.model.filters.predicate()).count()
        if not n:
            return True
        tables, old = [*self._tables, self._write(self.model.of(batch), end)], []
        if len(tables) > DELTAS:
            tables, old = [self._write(self.model.merged([self._read(t) for t in tables]), end)], tables
        with self._news:  # state, progress and listeners change together
            self._tables = tables
            self._advance(end)
            heard = list(self._listeners)
            state = self.current()
        for f in heard:
            try:
                f(state)
            except Exception:
                _log.exception("a listener of %s failed", self.name)
        self._since += n
        if self.policy.due(self._since):
            try:
                self.log.files.replace(f"{self.folder}/snapshot.json", json.dumps({"position": end, "tables": tables}))
                self._kept, self._since = tables, 0
            except Exception:
                _log.exception("a snapshot of %s failed", self.name)  # the next one may be written
        if old:
            for t in set(self._old) - {*self._tables, *self._kept}:
                self.log.files.remove(f"{self.folder}/{t}")
            self._old = [t for t in [*self._old, *old] if t not in self._tables]
        return True

    def current(self) -> DataFrame:
        with self._news:
            tables = list(self._tables)
        if not tables:
            return self.model.of(self.log.frame().where(F.lit(False)))
        return self.model.merged([self._read(t) for t in tables])

    def updates(self, listener: Callable[[DataFrame], None]) -> DataFrame:
        """The state now; listener gets each later one, and none that this state has already seen."""
        with self._news:
            self._listeners.append(listener)
            return self.current()

    def read_after(self, token: ConsistencyToken | None, timeout: float | None = None) -> DataFrame:
        if token is not None:
            self.wait_for(token, timeout)
        return self.current()


class Updates:
    """Every later state of a live projection, one for each event: iterate, or ask with get(). A consumer that lags skips the oldest (skipped counts them)."""

    def __init__(self, runner: Runner):
        self.runner, self.queue, self.skipped = runner, queue.Queue(UPDATES), 0

    def _put(self, item: tuple[int, Any]) -> None:
        while True:
            try:
                return self.queue.put_nowait(item)
            except queue.Full:
                try:
                    self.queue.get_nowait()
                    self.skipped += 1
                except queue.Empty:
                    pass

    def get(self, timeout: float | None = None) -> tuple[int, Any]:
        """(position, state)."""
        return self.queue.get(timeout=timeout)

    def __iter__(self) -> Iterator[tuple[int, Any]]:
        """Ends when the runner has ended and nothing is left."""
        while True:
            try:
                yield self.queue.get(timeout=0.1)
            except queue.Empty:
                if not self.runner.is_running():
                    return


class LiveProjection(Runner):
    """A read model folded by Python handlers on the driver, one event at a time, in order.

    State, progress and the updates that consumers get change under one lock for each event: what updates() returns is
    the state at one event, and the stream begins with the next. A snapshot is offered after each event under the
    store's policy and when the runner stops; one that fails is logged and tried again.
    """

    def __init__(self, log: EventLog, projection: ProjectionType, instance_id: Any = None, store: SnapshotStore | None = None):
        super().__init__(log, f"projection-{projection.kind}-{uuid.uuid4().hex[:8]}")
        self.projection, self.instance_id, self.store, self._since, self._at = projection, instance_id, store, 0, -1
        self._filters = projection.filters(instance_id)
        self._state = projection.init(instance_id)
        self._consumers: list[Updates] = []

    def start(self, interval: str = "100 milliseconds") -> LiveProjection:
        if self.store:
            try:
                if found := self.store.load(self.projection.kind, self.instance_id):
                    self._state, self.progress, self._at = self.projection.restore(found.data), found.position, found.position
            except Exception as e:  # a snapshot that can't be read is none
                _log.warning("%s starts anew: %s", self.name, e)
        self._start(interval)
        return self

    def _work(self, batch: DataFrame, end: int) -> bool:
        for row in batch.where(self._filters.predicate()).orderBy("position").toLocalIterator():
            if self._stopping.is_set():
                return False
            event = row.asDict()
            state = self.projection.step(self._filters, deepcopy(self._state), event)
            with self._news:
                self._state, self._at = state, event["position"]
                self._since += 1
                for consumer in self._consumers:
                    consumer._put((event["position"], deepcopy(state)))
                self._advance(event["position"])
            self._offer()
        return True

    def _offer(self) -> None:
        if not self.store or not self._since:
            return
        try:
            if self.store.offer(self.projection.kind, self.instance_id, self._since, lambda: Snapshot(self._at, self._state)):
                self._since = 0
        except Exception:
            _log.exception("a snapshot of %s failed", self.name)

    def _end(self) -> None:
        self._offer()
        self.log.files.remove(self.folder)  # with Spark's own files

    def current(self) -> Any:
        with self._news:
            return deepcopy(self._state)

    def updates(self) -> tuple[Any, Updates]:
        with self._news:
            self._consumers.append(Updates(self))
            return deepcopy(self._state), self._consumers[-1]

    def read_after(self, token: ConsistencyToken | None, timeout: float | None = None) -> Any:
        if token is not None:
            self.wait_for(token, timeout)
        return self.current()


@dataclass(frozen=True)
class RetryPolicy:
    """Delays initial * 2 ** i up to longest, in milliseconds; retries None: without end."""

    initial: int = 50
    longest: int = 5000
    retries: int | None = None

    def delay(self, i: int) -> int:
        return min(self.initial << min(i, 62), self.longest)


class Reactor(Runner):
    """Calls react(event) for each admitted event in order, at least once; events come to the driver one at a time.

    react raises Retry to be called again after a delay, Fatal (or anything else) to end the reactor. The checkpoint is
    offered to the policy after each event and, through the same policy, when the reactor stops; what came after the
    last stored one is delivered again at the next start. A checkpoint that can't be read ends the start.
    """

    def __init__(self, log: EventLog, kind: str, filters: Filters, react: Callable[[dict], None], policy: Policy = always, retry: RetryPolicy = RetryPolicy(), checkpoint_id: str = "default"):
        super().__init__(log, f"reactor-{kind}-{checkpoint_id}")
        self.kind, self.filters, self.react, self.retry, self.checkpoint_id = kind, filters, react, retry, checkpoint_id
        self.checkpoints, self._since, self._at = CheckpointStore(log, policy), 0, -1

    def start(self, interval: str = "100 milliseconds") -> Reactor:
        found = self.checkpoints.load(self.kind, self.checkpoint_id)
        if found is not None:
            self.progress = found
        self._start(interval)
        return self

    def _work(self, batch: DataFrame, end: int) -> bool:
        for row in batch.where(self.filters.predicate()).orderBy("position").toLocalIterator():
            event = row.asDict()
            if not self._deliver(event | {"data": json.loads(event["data"])}):
                return False
            self._since, self._at = self._since + 1, event["position"]
            self._offer()
            self._advance(event["position"])
        return True

    def _offer(self) -> None:
        try:
            if self.checkpoints.offer(self.kind, self.checkpoint_id, self._since, self._at):
                self._since = 0
        except Exception as e:
            raise CheckpointError(f"{self.name}: {e}") from e

    def _end(self) -> None:
        self._offer()
        super()._end()

    def _deliver(self, event: dict) -> bool:
        """Whether the event was handled; false if the reactor stops meanwhile."""
        i = 0
        while not self._stopping.is_set():
            try:
                self.react(event)
                return True
            except Retry as e:
                if self.retry.retries is not None and i >= self.retry.retries:
                    raise Fatal(f"{event['kind']} at {event['position']}: {e}") from e
                self._stopping.wait(self.retry.delay(i) / 1000)
                i += 1
        return False

"""Aggregates and projections with Python handlers, and the repository that runs commands on them.

A single stream (or one selection of events) is folded in order on the driver, for command handling. load_many() and
decide() do the same for many streams at once, in tasks that hold the state of one stream at a time. Folds that have a
closed form are better expressed by foldlog.operators.folds.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from copy import deepcopy
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlog.errors import AggregateAlreadyExists, AggregateNotFound, CheckpointError, ConcurrencyConflict, DecodeError, Rejected, SnapshotError, UnknownKind
from foldlog.functions.columns import json_key, kebab_case, upper_camel
from foldlog.functions.ranking import together
from foldlog.operators.filters import EventFilter, Filters
from foldlog.operators.snapshots import Offer, Policy, always, never
from foldlog.sources.commitlog import ConsistencyToken, Event, EventLog

# A repository takes any log with the methods of foldlog.sources.memory.EventStore, and any snapshot store with those of Snapshots there.


@dataclass
class AggregateType:
    """How one kind of stream is folded and what commands do.

    apply: per event kind, (state, data) to state. create: per event kind that may come first, data to state; without
    any, init gives the state that the first event is applied to. handle: per command, (state, command) to events;
    handle_create: per command, command to events. Neither sees ids or metadata. decoders: per event kind, what turns a
    payload into the data that apply and create get. restore: what turns the JSON of a snapshot into a state.
    """

    name: str
    apply: dict[str, Callable[[Any, dict], Any]]
    create: dict[str, Callable[[dict], Any]] = field(default_factory=dict)
    init: Callable[[], Any] | None = None
    handle: dict[str, Callable[[Any, Any], Iterable[Event]]] = field(default_factory=dict)
    handle_create: dict[str, Callable[[Any], Iterable[Event]]] = field(default_factory=dict)
    kind: str = ""
    decoders: dict[str, Callable[[dict], Any]] = field(default_factory=dict)
    restore: Callable[[Any], Any] = lambda data: data

    def __post_init__(self):
        self.kind = self.kind or kebab_case(self.name)
        if not self.apply and not self.create:
            raise ValueError(f"{self.name} has no events")
        if not self.create and self.init is None:
            raise ValueError(f"{self.name} needs create or init")

    @property
    def kinds(self) -> list[str]:
        return list(dict.fromkeys([*self.create, *self.apply]))

    def first(self, kind: str, data: dict) -> Any:
        if kind in self.create:
            return self.create[kind](self._typed(kind, data))
        if self.create:
            raise UnknownKind(f"{kind} can't begin a {self.kind}")
        return self.step(self.init(), kind, data)

    def step(self, state: Any, kind: str, data: dict) -> Any:
        if kind not in self.apply:
            raise UnknownKind(kind)
        return self.apply[kind](state, self._typed(kind, data))

    def _typed(self, kind: str, data: Any) -> Any:
        return self.decoders[kind](data) if kind in self.decoders and isinstance(data, dict) else data

    def filters(self, aggregate_id: str, after: int | None = None) -> list[EventFilter]:
        return Filters().events_for(self.kind, self.kinds, aggregate_id).into_event_filters(after)


@dataclass
class ProjectionType:
    """A read model: init(instance id) gives the state, filters(instance id) the events with handlers (state, context, data) to state.

    context has aggregate_kind, aggregate_id, kind and metadata. decoders: per event kind, what turns a payload into data.
    """

    kind: str
    init: Callable[[Any], Any]
    filters: Callable[[Any], Filters]
    decoders: dict[str, Callable[[dict], Any]] = field(default_factory=dict)
    restore: Callable[[Any], Any] = lambda data: data

    def step(self, filters: Filters, state: Any, event: dict) -> Any:
        handler = filters.handlers.get(event["kind"])
        if handler is None:
            return state
        meta = event["metadata"]
        context = {k: event[k] for k in ("aggregate_kind", "aggregate_id", "kind")} | {"metadata": None if meta is None else json.loads(meta)}
        data = decoded(event)
        return handler(state, context, self.decoders[event["kind"]](data) if event["kind"] in self.decoders else data)


def decoded(event: dict) -> dict:
    return _decoded(event["kind"], event["position"], event["data"])


def _decoded(kind: str, position: int, text: str) -> Any:
    try:
        try:
            value, end = _scan(text, 0)  # json.loads() without its checks, which cost more than a short payload
            if end == len(text):
                return value
        except (StopIteration, TypeError, ValueError):
            pass
        return json.loads(text)
    except ValueError as e:
        raise DecodeError(f"{kind} at {position}: {e}") from e


def _encoder(sort_keys: bool) -> Callable[[Any], Iterable[str]]:
    """Parts of what json.dumps() gives without spaces; the encoder is made once and not for each value."""
    plain = json.JSONEncoder(separators=(",", ":"), sort_keys=sort_keys)
    if json.encoder.c_make_encoder is None:
        return lambda value: [plain.encode(value)]
    parts = json.encoder.c_make_encoder({}, plain.default, json.encoder.encode_basestring_ascii, None, ":", ",", sort_keys, False, True)
    return lambda value: parts(value, 0)


_scan, _parts, _sorted_parts = json.JSONDecoder().scan_once, _encoder(False), _encoder(True)


def compact(value: Any, sort_keys: bool = False) -> str:
    return "".join(_sorted_parts(value) if sort_keys else _parts(value))


# --- typed registration ----------------------------------------------------------------------------------------------


def event(kind: str) -> Callable[[type], type]:
    """Marks a dataclass as an event of that kind: its instances can be committed, and payloads of the kind become instances."""

    def mark(cls: type) -> type:
        if not is_dataclass(cls):
            raise TypeError(f"{cls.__name__} isn't a dataclass")
        cls.event_kind = kind
        return cls

    return mark


def as_event(value: Any) -> Event:
    """An Event as it is, or made from an instance of a class marked with event()."""
    if isinstance(value, Event):
        return value
    if not hasattr(value, "event_kind"):
        raise UnknownKind(f"{type(value).__name__} isn't an event")
    return Event(value.event_kind, asdict(value))


def decoder(cls: type) -> Callable[[dict], Any]:
    """Payloads to instances of cls; fields that cls doesn't know are ignored, missing ones take its defaults."""
    names = {f.name for f in fields(cls)}

    def decode(data: dict) -> Any:
        try:
            return cls(**{k: v for k, v in data.items() if k in names})
        except TypeError as e:
            raise DecodeError(f"{cls.event_kind}: {e}") from e

    return decode


def _events_of(classes: Iterable[type]) -> dict[str, type]:
    out: dict[str, type] = {}
    for cls in classes:
        if not hasattr(cls, "event_kind"):
            raise UnknownKind(f"{cls.__name__} isn't marked as an event")
        if cls.event_kind in out:
            raise ValueError(f"{cls.event_kind} is the kind of both {out[cls.event_kind].__name__} and {cls.__name__}")
        out[cls.event_kind] = cls
    return out


def handler_name(kind: str) -> str:
    """The method for an event of that kind: points-added and points_added give on_points_added."""
    return "on_" + kebab_case(upper_camel(kind.replace("-", "_"))).replace("-", "_")


def aggregate(events: Iterable[type], kind: str = "", create: Iterable[type] = ()) -> Callable[[type], AggregateType]:
    """Makes an AggregateType of a class whose instances are states.

    For each event class there is a method on_<kind>(event) that changes the state; those in create have a class method
    create_<kind>(event) instead that returns the first state. Methods handle_<command>(command) return or yield events,
    class methods create_with_<command>(command) those of a new stream. All is checked when the class is made.
    """

    def make(cls: type) -> AggregateType:
        known, first = _events_of(events), _events_of(create)
        if not known:
            raise ValueError(f"{cls.__name__} has no events")
        if missing := set(first) - set(known):
            raise ValueError(f"{cls.__name__} creates from {sorted(missing)}, which aren't among its events")

        def method(name: str) -> Callable:
            if not callable(found := getattr(cls, name, None)):
                raise TypeError(f"{cls.__name__} has no {name}()")
            return found

        def changing(name: str) -> Callable[[Any, Any], Any]:
            call = method(name)

            def apply(state: Any, data: Any) -> Any:
                call(state, data)
                return state

            return apply

        begun = {k: method(handler_name(k).replace("on_", "create_", 1)) for k in first}
        applied = {k: changing(handler_name(k)) for k in known if k not in first or hasattr(cls, handler_name(k))}
        emitted = lambda call: lambda *args: [as_event(e) for e in call(*args) or ()]
        handle = {n.removeprefix("handle_"): emitted(getattr(cls, n)) for n in dir(cls) if n.startswith("handle_")}
        made = {n.removeprefix("create_with_"): emitted(getattr(cls, n)) for n in dir(cls) if n.startswith("create_with_")}
        return AggregateType(cls.__name__, applied, begun, None if begun else cls, handle, made, kind, {k: decoder(c) for k, c in known.items()}, _restorer(cls))

    return make


def _restorer(cls: type) -> Callable[[Any], Any]:
    return (lambda data: cls(**data)) if is_dataclass(cls) else lambda data: data


def projection(events: Iterable[type], kind: str = "") -> Callable[[type], ProjectionType]:
    """Makes a ProjectionType, over all streams, of a class whose instances are states, with a method on_<kind>(context, event) for each event class."""

    def make(cls: type) -> ProjectionType:
        known = _events_of(events)
        if not known:
            raise ValueError(f"{cls.__name__} has no events")
        filters = Filters()
        for k in known:
            if not callable(call := getattr(cls, handler_name(k), None)):
                raise TypeError(f"{cls.__name__} has no {handler_name(k)}()")

            def step(state: Any, context: dict, data: Any, call: Callable = call) -> Any:
                call(state, context, data)
                return state

            filters = filters.event(k, step)
        return ProjectionType(kind or kebab_case(cls.__name__), lambda _: cls(), lambda _: filters, {k: decoder(c) for k, c in known.items()}, _restorer(cls))

    return make


# --- snapshots -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Snapshot:
    position: int
    data: Any


class SnapshotStore:
    """Snapshots by kind and id in the folder of a log, under a policy. An offer is stored if its position is greater than the stored one's.

    A snapshot is a file named by its position, published without overwriting, and load() takes the greatest position: of
    writers at the same time the newest state wins, whoever comes last. Older files go after a newer one is there.
    """

    def __init__(self, log: EventLog, policy: Policy = always):
        self.files, self.policy = log.files, policy

    def _folder(self, kind: str, key: Any) -> str:
        return f"snapshots/{hashlib.sha256(f'{kind}|{json_key(key)}'.encode()).hexdigest()}"

    def load(self, kind: str, key: Any) -> Snapshot | None:
        folder = self._folder(kind, key)
        while names := self.files.names(folder):
            if (text := self.files.read(f"{folder}/{names[-1]}")) is not None:
                return Snapshot(**json.loads(text))  # one that has gone meanwhile left a newer one: look again
        return None

    def offer(self, kind: str, key: Any, since: int, create: Callable[[], Snapshot]) -> Offer:
        """create isn't called if the policy declines."""
        if not self.policy.due(since):
            return Offer.DECLINED
        new, folder = create(), self._folder(kind, key)
        data = asdict(new.data) if is_dataclass(new.data) else new.data
        name, text = f"{new.position:020d}.json", json.dumps({"position": new.position, "data": data})
        there = self.files.names(folder)
        if there and there[-1] >= name:
            return Offer.DECLINED
        self.files.make(folder)
        if not self.files.publish(f"{folder}/{name}", text):
            return Offer.DECLINED
        for old in there:
            self.files.remove(f"{folder}/{old}")
        return Offer.STORED


class CheckpointStore:
    """How far reactors have come, by kind and id: a snapshot store of positions alone. A position never goes back."""

    def __init__(self, log: EventLog, policy: Policy = always):
        self.store = SnapshotStore(log, policy)

    def load(self, kind: str, checkpoint_id: str) -> int | None:
        try:
            found = self.store.load(f"checkpoint|{kind}", checkpoint_id)
            return None if found is None else int(found.position)
        except (OSError, KeyError, TypeError, ValueError) as e:
            raise CheckpointError(f"{kind} {checkpoint_id}: {e}") from e

    def offer(self, kind: str, checkpoint_id: str, since: int, position: int) -> Offer:
        return self.store.offer(f"checkpoint|{kind}", checkpoint_id, since, lambda: Snapshot(position, None)) if since else Offer.DECLINED


@dataclass(frozen=True)
class Loaded:
    state: Any
    version: int
    since_snapshot: int


@dataclass(frozen=True)
class Repository:
    """Loads and changes aggregates of a log. Commits check versions unless optimistic is false; creation always does.

    An aggregate's version is the last event of a kind it knows, while a commit compares with the stream's last event
    of any kind: a foreign event in a stream makes each checked update conflict.
    """

    log: EventLog
    optimistic: bool = True
    snapshots: SnapshotStore | None = None

    def with_snapshots(self, store: SnapshotStore) -> Repository:
        return replace(self, snapshots=store)

    def without_concurrency_checking(self) -> Repository:
        return replace(self, optimistic=False)

    def load(self, kind: AggregateType, aggregate_id: str) -> Any | None:
        found = self._load(kind, aggregate_id)
        return None if found is None else found.state

    def _load(self, kind: AggregateType, aggregate_id: str) -> Loaded | None:
        base = None
        if self.snapshots:
            try:
                base = self.snapshots.load(kind.kind, aggregate_id)
            except (OSError, ValueError):
                base = None  # a snapshot that can't be read is none
        state, version, n = (kind.restore(base.data), base.position, 0) if base else (None, None, 0)
        for e in self._events(kind.filters(aggregate_id, version)):
            state = kind.first(e["kind"], decoded(e)) if version is None else kind.step(state, e["kind"], decoded(e))
            version, n = e["position"], n + 1
        return None if version is None else Loaded(state, version, n)

    def _events(self, filters: list[EventFilter]) -> Iterable[dict]:
        return self.log.events(filters)

    def load_many(self, kind: AggregateType, ids: DataFrame) -> DataFrame:
        """aggregate_id, version and state (JSON) of the streams in ids (aggregate_id) that have events; states must be JSON values or dataclasses.

        Events are sorted by stream and position; a task folds one stream after another and holds one state.
        """
        wanted = ids.select("aggregate_id").distinct()
        events = self.log.frame().where((F.col("aggregate_kind") == kind.kind) & F.col("kind").isin(kind.kinds)).join(wanted, "aggregate_id", "left_semi")
        return fold_streams(events, kind)

    def projected(self, model) -> DataFrame:
        """The state of a mergeable read model (foldlog.streaming.live.LiveModel) over the log as it is now: a lazy frame."""
        return model.of(self.log.frame())

    def load_projection(self, projection: ProjectionType, instance_id: Any = None) -> Any:
        filters = projection.filters(instance_id)
        state = projection.init(instance_id)
        for e in self._events(filters.into_event_filters()):
            state = projection.step(filters, state, e)
        return state

    def load_projection_with_snapshot(self, projection: ProjectionType, instance_id: Any, store: SnapshotStore) -> Any:
        """From the snapshot and the events after it; offers a new one if there were any. Kinds without handler count as well."""
        try:
            base = store.load(projection.kind, instance_id)
        except (OSError, ValueError):
            base = None
        filters = projection.filters(instance_id)
        state, at, n = (projection.restore(base.data), base.position, 0) if base else (projection.init(instance_id), None, 0)
        for e in self._events(filters.into_event_filters(at)):
            state, at, n = projection.step(filters, state, e), e["position"], n + 1
        if n:
            store.offer(projection.kind, instance_id, n, lambda: Snapshot(at, state))
        return state

    def create(self, kind: AggregateType, aggregate_id: str, name: str, command: Any, metadata: dict | None = None) -> ConsistencyToken | None:
        events = [as_event(e) for e in kind.handle_create[name](command)]
        if not events:
            return None
        try:
            return self._persist(kind, aggregate_id, None, events, metadata, check=True)
        except ConcurrencyConflict as e:
            raise AggregateAlreadyExists(f"{kind.kind} {aggregate_id}") from e

    def update(self, kind: AggregateType, aggregate_id: str, name: str, command: Any, metadata: dict | None = None) -> ConsistencyToken | None:
        found = self._load(kind, aggregate_id)
        if found is None:
            raise AggregateNotFound(f"{kind.kind} {aggregate_id}")
        events = [as_event(e) for e in kind.handle[name](found.state, command)]
        return self._persist(kind, aggregate_id, found, events, metadata, self.optimistic) if events else None

    def upsert(self, kind: AggregateType, aggregate_id: str, name: str, command: Any, metadata: dict | None = None) -> ConsistencyToken | None:
        found = self._load(kind, aggregate_id)
        if found is None:
            return self.create(kind, aggregate_id, name, command, metadata)
        events = [as_event(e) for e in kind.handle[name](found.state, command)]
        return self._persist(kind, aggregate_id, found, events, metadata, self.optimistic) if events else None

    def update_with_retry(self, kind: AggregateType, aggregate_id: str, name: str, command: Any, metadata: dict | None = None, max_retries: int = 3) -> int:
        """Loads and tries again after conflicts only; how many attempts it took."""
        if not self.optimistic:
            raise ValueError("without a check of versions there is nothing to retry")
        for attempt in range(1, max_retries + 2):
            try:
                self.update(kind, aggregate_id, name, command, metadata)
                return attempt
            except ConcurrencyConflict:
                if attempt > max_retries:
                    raise
        raise AssertionError

    def consistency_token(self) -> ConsistencyToken | None:
        return self.log.token()

    def subscribe(self, model, policy: Policy = never):
        """A live read model over the log, caught up: a mergeable one (foldlog.streaming.live.LiveModel) or a ProjectionType. With a policy its state outlives it."""
        from foldlog.streaming.live import LiveModel, LiveProjection, Subscription

        if isinstance(model, LiveModel):
            return Subscription(self.log, model, policy).start()
        return LiveProjection(self.log, model, store=SnapshotStore(self.log, policy)).start()

    def react(self, kind: str, filters: Filters, reaction: Callable[[dict], None], **options):
        """A reactor over the log, caught up; options as of foldlog.streaming.live.Reactor."""
        from foldlog.streaming.live import Reactor

        return Reactor(self.log, kind, filters, reaction, **options).start()

    def _persist(self, kind: AggregateType, aggregate_id: str, found: Loaded | None, events: list[Event], metadata: dict | None, check: bool) -> ConsistencyToken:
        state = found.state if found else None
        if self.snapshots:
            state = deepcopy(state)  # the fold of the new events must not change what was loaded
            for i, e in enumerate(events):
                state = kind.first(e.kind, e.data) if found is None and i == 0 else kind.step(state, e.kind, e.data)
        version = found.version if found else None
        position = self.log.append_if_version(kind.kind, aggregate_id, version, events, metadata) if check else self.log.append(kind.kind, aggregate_id, events, metadata)
        if self.snapshots:
            try:
                self.snapshots.offer(kind.kind, aggregate_id, (found.since_snapshot if found else 0) + len(events), lambda: Snapshot(position, state))
            except (OSError, TypeError, ValueError) as e:
                raise SnapshotError(f"events up to {position} are committed") from e
        return ConsistencyToken(position)


# --- many streams at once --------------------------------------------------------------------------------------------


def _state(value: Any) -> str:
    return compact(asdict(value) if is_dataclass(value) and not isinstance(value, type) else value, sort_keys=True)


def _lists(batch: pa.RecordBatch) -> list[list]:
    """The columns (strings and whole numbers) as Python values: to_pylist() makes a scalar of each first."""
    return [c.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(c.type) or not c.null_count else c.to_pylist() for c in batch.columns]


def _arrays(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def fold_streams(events: DataFrame, kind: AggregateType) -> DataFrame:
    """aggregate_id, version and state (JSON) from the events of many streams of one kind."""
    out = pa.schema([("aggregate_id", pa.string()), ("version", pa.int64()), ("state", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, state, version, done = None, None, None, []
        for b in batches:
            for key, position, event_kind, data in zip(*_lists(b), strict=True):
                payload = _decoded(event_kind, position, data)
                if key != stream:
                    if stream is not None:
                        done.append((stream, version, _state(state)))
                    stream, state = key, kind.first(event_kind, payload)
                else:
                    state = kind.step(state, event_kind, payload)
                version = position
            if done:
                yield _arrays(done, out)
                done = []
        if stream is not None:
            yield _arrays([(stream, version, _state(state))], out)

    rows = together(events.select("aggregate_id", "position", "kind", "data"), "aggregate_id", "position")
    return rows.mapInArrow(run, "aggregate_id string, version long, state string")


def decide(events: DataFrame, commands: DataFrame, kind: AggregateType, states: bool = False) -> DataFrame:
    """What commands (aggregate_id, seq, name, command as JSON) on many streams of one kind lead to, each stream's in the order of seq.

    A row for each new event: aggregate_id, seq, ordinal (place among the command's events), kind, data, outcome ok; a
    command that is rejected (Rejected), has no handler or finds its stream missing gives one row with its outcome and
    the reason in data, one that changes nothing a row with outcome unchanged. Each command sees the stream's events
    and those of the commands before it; a task holds the state of one stream. With states, a last column state is the
    state (JSON) after the whole command, null where there is no stream.
    """
    own = events.where(F.col("kind").isin(kind.kinds)).select("aggregate_id", F.lit(0).alias("phase"), F.col("position").alias("seq"), "kind", "data")
    asked = commands.select("aggregate_id", F.lit(1).alias("phase"), "seq", F.col("name").alias("kind"), F.col("command").alias("data"))
    return decide_rows(own.unionByName(asked), kind, states)


def decide_rows(rows: DataFrame, kind: AggregateType, states: bool = False) -> DataFrame:
    """decide() for events and commands that come from one table: aggregate_id, phase (int; 0 for events, 1 for commands), seq, kind or name, data or command."""
    out = pa.schema([("aggregate_id", pa.string()), ("seq", pa.int64()), ("ordinal", pa.int64()), ("kind", pa.string()), ("data", pa.string()), ("outcome", pa.string()), ("state", pa.string())][: 6 + states])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, state, begun, text = None, None, False, None
        for b in batches:
            told: list[tuple] = []
            for key, phase, seq, name, data in zip(*_lists(b), strict=True):
                if key != stream:
                    stream, state, begun, text = key, None, False, None
                payload = _decoded(name, seq, data)
                if phase == 0:
                    state, begun, text = (kind.step(state, name, payload) if begun else kind.first(name, payload)), True, None
                    continue
                handlers = kind.handle if begun else kind.handle_create
                if name not in handlers:
                    found = [(None, name, "not_found" if not begun and name in kind.handle else "unknown_command")]
                else:
                    try:
                        new = [as_event(e) for e in (handlers[name](state, payload) if begun else handlers[name](payload))]
                        found = [(e.kind, compact(e.data), "ok") for e in new] if new else [(None, None, "unchanged")]
                    except Rejected as e:
                        new, found = [], [(None, str(e), "rejected")]
                    for e in new:
                        state, begun, text = (kind.step(state, e.kind, e.data) if begun else kind.first(e.kind, e.data)), True, None
                if states and begun and text is None:  # what no event has changed is as it was told before
                    text = _state(state)
                for i, x in enumerate(found):
                    told.append((key, seq, i, *x, text) if states else (key, seq, i, *x))
            if told:
                yield _arrays(told, out)

    return together(rows, "aggregate_id", "phase", "seq").mapInArrow(run, "aggregate_id string, seq long, ordinal long, kind string, data string, outcome string" + ", state string" * states)

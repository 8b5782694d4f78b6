"""The event log as immutable commit files.

A commit is one file, commits/<version>.json, whose lines are events with contiguous positions, or that names a Parquet
segment of events that were loaded in bulk. It is written under a temporary name and published by a step that fails if
the version is taken: a hard link on a POSIX file system, a rename without overwriting on those that Hadoop knows.
Object stores have no such rename, so a log must not lie on one. Whoever loses reads the log again and retries at the
next version. Versions have no gaps, so what is readable is always a prefix of the log.

compact() brings commits into a Parquet segment, in which the events of a stream lie together, and publishes a list of
segments. Readers start from the newest list: they read segments, which Parquet's statistics prune by stream, and one
by one only the commits after them.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, is_dataclass
from functools import total_ordering
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.errors import ConcurrencyConflict, SerializationError
from foldlog.functions.ranking import dense_positions
from foldlog.operators.filters import EventFilter, union_predicate
from foldlog.sources.envelope import SCHEMA


@total_ordering
@dataclass(frozen=True)
class ConsistencyToken:
    """How far a reader must have come to see a write; the greatest of several covers all."""

    position: int

    def __lt__(self, other: ConsistencyToken) -> bool:
        return self.position < other.position

    def to_json(self) -> str:
        return json.dumps(self.position)

    @staticmethod
    def from_json(text: str) -> ConsistencyToken:
        return ConsistencyToken(int(json.loads(text)))


@dataclass(frozen=True)
class Segment:
    """A Parquet folder of events with all positions from first to last."""

    path: str
    first: int
    last: int


@dataclass(frozen=True)
class Event:
    """An event to be committed: its kind and payload."""

    kind: str
    data: dict


#: Commits whose events a log keeps in memory; events of a segment's file at most, which is what one task of a stream reads.
PARSED, FILE = 4096, 1_000_000


def scratch(spark: SparkSession) -> str:
    """A new folder for a log, on a POSIX path: under spark.checkpoint.dir, or a folder of this machine if that isn't set and the master is local."""
    place = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://").removeprefix("file:")
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        place = tempfile.mkdtemp(prefix="logs")
    return f"{place}/log-{uuid.uuid4().hex}"


def commit_name(version: int) -> str:
    return f"{version:012d}.json"


class Files:
    """The few file operations of a log, on a POSIX path or (through Spark's JVM) on any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.local = "://" not in root and not root.startswith("file:")
        self.root = root
        if not self.local:
            jvm = spark._jvm
            self.path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
            self.fs = self.path("x").getFileSystem(spark._jsc.hadoopConfiguration())
            self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("x").toUri(), spark._jsc.hadoopConfiguration())
            kind = jvm.org.apache.hadoop.fs.Options.Rename
            self.no_overwrite = spark.sparkContext._gateway.new_array(kind, 0)
            self.overwrite = spark.sparkContext._gateway.new_array(kind, 1)
            self.overwrite[0] = kind.OVERWRITE

    def make(self, name: str) -> None:
        if self.local:
            os.makedirs(f"{self.root}/{name}", exist_ok=True)
        else:
            self.fs.mkdirs(self.path(name))

    def read(self, name: str) -> str | None:
        if self.local:
            try:
                return Path(self.root, name).read_text(encoding="utf-8")
            except FileNotFoundError:
                return None
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        """What is in a folder; nothing if it isn't there."""
        if self.local:
            return sorted(os.listdir(f"{self.root}/{folder}")) if os.path.isdir(f"{self.root}/{folder}") else []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.fs.exists(self.path(folder)) else []

    def remove(self, name: str) -> None:
        """A file or folder, if it is there."""
        if self.local:
            path = f"{self.root}/{name}"
            shutil.rmtree(path, ignore_errors=True) if os.path.isdir(path) else Path(path).unlink(missing_ok=True)
        else:
            self.fs.delete(self.path(name), True)

    def publish(self, name: str, text: str) -> bool:
        """Whether this writer is the one who created the file."""
        temporary = f"staged/{uuid.uuid4().hex}"
        if self.local:
            Path(self.root, temporary).write_text(text, encoding="utf-8")
            try:
                os.link(f"{self.root}/{temporary}", f"{self.root}/{name}")
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{self.root}/{temporary}")
            return True
        out = self.fs.create(self.path(temporary), False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            self.context.rename(self.path(temporary), self.path(name), self.no_overwrite)
        except Exception as e:
            if self.fs.exists(self.path(name)):
                self.fs.delete(self.path(temporary), False)
                return False
            raise e
        return True

    def replace(self, name: str, text: str) -> None:
        """Writes aside, then takes the old file's place: readers see the one or the other."""
        temporary = f"staged/{uuid.uuid4().hex}"
        if self.local:
            Path(self.root, temporary).write_text(text, encoding="utf-8")
            os.replace(f"{self.root}/{temporary}", f"{self.root}/{name}")
            return
        out = self.fs.create(self.path(temporary), False)
        out.write(bytearray(text.encode()))
        out.close()
        self.context.rename(self.path(temporary), self.path(name), self.overwrite)


def staged(events: Iterable[Event]) -> list[tuple[str, str]]:
    """Kind and JSON of each event, all checked before anything is written."""
    out = []
    for i, e in enumerate(events):
        try:
            out.append((e.kind, json.dumps(asdict(e.data) if is_dataclass(e.data) else e.data, separators=(",", ":"), allow_nan=False)))
        except (TypeError, ValueError) as why:
            raise SerializationError(i, why) from why
    if not out:
        raise ValueError("a commit has at least one event")
    return out


class EventLog:
    """An append-only log of events with one global order of positions from 0."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, Files(spark, root)
        for folder in ("commits", "staged", "segments", "compacted"):
            self.files.make(folder)
        self._version, self._next = 0, 0  # what this instance has seen of the log
        self._segments: list[Segment] = []
        self._inline: list[int] = []  # versions of the commits whose events aren't in a segment
        self._heads: dict[tuple[str, str], int] = {}  # streams that it was asked about
        self._parsed: dict[int, list[dict]] = {}  # events of late commits, PARSED at most
        if lists := self.files.names("compacted"):
            found = json.loads(self.files.read(f"compacted/{lists[-1]}"))
            self._version, self._next, self._segments = found["version"], found["next"], [Segment(**x) for x in found["segments"]]

    # reading

    def frame(self) -> DataFrame:
        """All events that are published now, as far as versions have no gap."""
        self._advance()
        return self._stored()

    def _stored(self) -> DataFrame:
        out = self.spark.createDataFrame([], SCHEMA) if not self._next else None
        read = self.spark.read.schema(SCHEMA)
        parts = [read.parquet(*[f"{self.root}/{s.path}" for s in self._segments])] if self._segments else []
        parts += [read.json([f"{self.root}/commits/{commit_name(v)}" for v in self._inline])] if self._inline else []
        for part in parts:
            out = part if out is None else out.unionByName(part)
        return out

    def load_events(self, filters: Iterable[EventFilter]) -> DataFrame:
        """The union of what filters select, each event once, in order of positions."""
        return self.frame().where(union_predicate(filters)).orderBy("position")

    def events(self, filters: Iterable[EventFilter]) -> Iterable[dict]:
        """The same, one after another on the driver: from segments by a query, from later commits without one."""
        self._advance()
        filters = list(filters)
        if self._segments and filters:
            stored = self.spark.read.schema(SCHEMA).parquet(*[f"{self.root}/{s.path}" for s in self._segments])
            rows = [r.asDict() for r in stored.where(union_predicate(filters)).orderBy("position").toLocalIterator()]
            rows += [e for v in self._inline for e in self._commit_at(v) if any(f.matches(e) for f in filters)]
            return sorted(rows, key=lambda e: e["position"])  # a segment may lie after commits
        return (e for v in self._inline for e in self._commit_at(v) if any(f.matches(e) for f in filters))

    def stream_version(self, aggregate_kind: str, aggregate_id: str) -> int | None:
        self._advance()
        return self._head(aggregate_kind, aggregate_id)

    def current_checkpoint(self, filters: Iterable[EventFilter]) -> int | None:
        return self.frame().where(union_predicate(filters)).agg(F.max("position")).first()[0]

    def latest_checkpoint(self) -> int | None:
        self._advance()
        return self._next - 1 if self._next else None

    def checkpoint_for_position(self, position: int) -> int | None:
        self._advance()
        return position if 0 <= position < self._next else None

    def token(self) -> ConsistencyToken | None:
        head = self.latest_checkpoint()
        return None if head is None else ConsistencyToken(head)

    def events_after(self, position: int | None) -> list[dict]:
        """Events after a position, for tailing: in order, as far as they are published."""
        self._advance()
        if self._segments and (position is None or position < self._segments[-1].last):
            rows = self._stored() if position is None else self._stored().where(F.col("position") > position)
            return [r.asDict() for r in rows.orderBy("position").toLocalIterator()]
        out = []
        for version in reversed(self._inline):  # newest first, until one that ends before
            rows = self._commit_at(version)
            if position is not None and rows[-1]["position"] <= position:
                break
            out.append([r for r in rows if position is None or r["position"] > position])
        return [r for rows in reversed(out) for r in rows]

    # writing

    def append(self, aggregate_kind: str, aggregate_id: str, events: Iterable[Event], metadata: dict | None = None) -> int:
        """Commits events without a check of versions; returns the last one's position."""
        return self._commit(aggregate_kind, aggregate_id, staged(events), metadata, lambda _: None)

    def append_if_version(self, aggregate_kind: str, aggregate_id: str, expected: int | None, events: Iterable[Event], metadata: dict | None = None) -> int:
        """Commits events if the stream is at expected (None: if there is no such stream)."""

        def check(actual: int | None) -> None:
            if actual != expected:
                raise ConcurrencyConflict(expected, actual)

        return self._commit(aggregate_kind, aggregate_id, staged(events), metadata, check)

    def _commit(self, aggregate_kind: str, aggregate_id: str, batch: list[tuple[str, str]], metadata: dict | None, check: Callable[[int | None], None]) -> int:
        meta = None if metadata is None else json.dumps(metadata, separators=(",", ":"), sort_keys=True)
        while True:
            self._advance()
            check(self._head(aggregate_kind, aggregate_id))
            rows = [{"aggregate_kind": aggregate_kind, "aggregate_id": aggregate_id, "kind": kind, "position": self._next + i, "data": data, "metadata": meta} for i, (kind, data) in enumerate(batch)]
            if self.files.publish(f"commits/{commit_name(self._version)}", "".join(json.dumps(r) + "\n" for r in rows)):
                self._advance()
                return rows[-1]["position"]

    def load_frame(self, events: DataFrame, key: str, order: list[str]) -> int | None:
        """Commits many events (aggregate_kind, aggregate_id, kind, data, metadata) at once, in the order of key (a number) and order.

        They are written to a segment with their positions, which is written again if another writer comes first.
        Returns the last position, None if there are no events.
        """
        while True:
            self._advance()
            first, version, path = self._next, self._version, f"segments/{uuid.uuid4().hex}"
            rows = dense_positions(events, key, order, start=first).select(*SCHEMA.names)
            self._clustered(rows).write.option("maxRecordsPerFile", FILE).parquet(f"{self.root}/{path}")
            n = self.spark.read.parquet(f"{self.root}/{path}").count()
            if n and self.files.publish(f"commits/{commit_name(version)}", json.dumps({"segment": path, "first": first, "last": first + n - 1}) + "\n"):
                self._advance()
                return first + n - 1
            self.files.remove(path)
            if not n:
                return None

    @staticmethod
    def _clustered(rows: DataFrame) -> DataFrame:
        order = ["aggregate_kind", "aggregate_id", "position"]
        return rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def compact(self, everything: bool = False) -> bool:
        """Brings the commits since the last call (everything: all events) into one segment, in which streams lie together, and publishes the new list.

        Whether this call did so: False if there is nothing to do or another was first. Commits stay for readers of streams.
        """
        self._advance()
        if not self._inline and not (everything and len(self._segments) > 1):
            return False
        old = [] if everything else self._segments
        rows = self._stored() if everything else self.spark.read.schema(SCHEMA).json([f"{self.root}/commits/{commit_name(v)}" for v in self._inline])
        path = f"segments/{uuid.uuid4().hex}"
        self._clustered(rows).write.option("maxRecordsPerFile", FILE).parquet(f"{self.root}/{path}")
        low, high = self.spark.read.parquet(f"{self.root}/{path}").agg(F.min("position"), F.max("position")).first()
        segments = sorted([*old, Segment(path, low, high)], key=lambda s: s.last)
        text = json.dumps({"version": self._version, "next": self._next, "segments": [asdict(s) for s in segments]})
        n = len(self.files.names("compacted"))
        if not self.files.publish(f"compacted/{commit_name(n)}", text):
            self.files.remove(path)
            return False
        self._segments, self._inline = segments, []
        return True

    def _commit_at(self, version: int) -> list[dict] | Segment | None:
        if version in self._parsed:
            return self._parsed[version]
        text = self.files.read(f"commits/{commit_name(version)}")
        if text is None:
            return None
        rows = [json.loads(line) for line in text.splitlines()]
        if "segment" in rows[0]:
            return Segment(rows[0]["segment"], rows[0]["first"], rows[0]["last"])
        self._parsed[version] = rows
        if len(self._parsed) > PARSED:
            del self._parsed[next(iter(self._parsed))]
        return rows

    def _advance(self) -> None:
        """Reads the commits that are new since the last call."""
        while found := self._commit_at(self._version):
            if isinstance(found, Segment):
                self._segments.append(found)
                self._heads.clear()
                self._next = found.last + 1
            else:
                for r in found:
                    if (key := (r["aggregate_kind"], r["aggregate_id"])) in self._heads:
                        self._heads[key] = r["position"]
                self._inline.append(self._version)
                self._next = found[-1]["position"] + 1
            self._version += 1

    def _head(self, aggregate_kind: str, aggregate_id: str) -> int | None:
        """From what was noted for the stream; at first by a scan for it, which segments prune."""
        key = (aggregate_kind, aggregate_id)
        if key not in self._heads:
            stream = (F.col("aggregate_kind") == aggregate_kind) & (F.col("aggregate_id") == aggregate_id)
            found = self._stored().where(stream).agg(F.max("position")).first()[0] if self._next else None
            self._heads[key] = -1 if found is None else found
        return None if self._heads[key] < 0 else self._heads[key]

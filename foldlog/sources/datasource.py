"""A Python data source for event logs on a shared POSIX path: batch and streaming.

Offsets of the stream are numbers of commits. The newest offset ends at the first missing commit, so a commit that is
still on its way holds back those after it, and a restart goes on after the last one that was read. Batch reads start
from the newest list of compacted segments. Both give Arrow batches; equalities and lower bounds of positions that a
query asks for are applied to them before they leave the worker, and by Parquet's statistics in segments.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

from foldlog.sources.commitlog import commit_name
from foldlog.sources.envelope import SCHEMA

#: Commits of a partition, and of a micro-batch; events of a partition of a segment, about.
COMMITS, MOST, EVENTS = 256, 4096, 1_000_000
#: How a commit that names a segment begins, and one of events doesn't.
_NAMES = '{"segment"'
_ARROW = pa.schema([pa.field(f.name, pa.int64() if f.name == "position" else pa.string(), f.nullable) for f in SCHEMA.fields])


class Range(InputPartition):
    """Commits from start to end."""

    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class File(InputPartition):
    """Row groups of a Parquet file of a segment."""

    def __init__(self, path: str, groups: list[int]):
        self.path, self.groups = path, groups


def published(root: str, start: int = 0, most: int | None = None) -> int:
    """The number of commits without a gap, known to be start at least; looks no further than most."""
    while (most is None or start < most) and os.path.exists(f"{root}/commits/{commit_name(start)}"):
        start += 1
    return start


def ranges(root: str, start: int, end: int) -> list[InputPartition]:
    """Commits from start to end as partitions; those that name a segment, which may hold any number of events, by its files."""
    out: list[InputPartition] = []
    for version in range(start, end):
        with open(f"{root}/commits/{commit_name(version)}", encoding="utf-8") as f:
            line = f.readline() if f.read(len(_NAMES)) == _NAMES else None
        if line is not None:
            out += _files(root, json.loads(_NAMES + line)["segment"])
        elif out and isinstance(out[-1], Range) and out[-1].end == version and version - out[-1].start < COMMITS:
            out[-1].end += 1
        else:
            out.append(Range(version, version + 1))
    return out


def _files(root: str, segment: str) -> list[File]:
    """A segment's files, cut between row groups into parts of EVENTS events, about."""
    import pyarrow.parquet as pq

    out = []
    for path in sorted(glob.glob(f"{root}/{segment}/*.parquet")):
        meta = pq.read_metadata(path)
        n = EVENTS
        for group in range(meta.num_row_groups):
            if n >= EVENTS:
                out.append(File(path, []))
                n = 0
            out[-1].groups.append(group)
            n += meta.row_group(group).num_rows
    return out


class Wanted:
    """What a query asks for: values by column, and the least position."""

    def __init__(self):
        self.values: dict[str, set] = {}
        self.after = -1

    def take(self, f: Filter) -> bool:
        """Whether this filter is applied here."""
        if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in ("kind", "aggregate_kind", "aggregate_id"):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.values[f.attribute[0]] = self.values.get(f.attribute[0], values) & values
            return True
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("position",):
            self.after = max(self.after, f.value if isinstance(f, GreaterThan) else f.value - 1)
            return True
        return False

    def expression(self):
        import pyarrow.dataset as ds

        out = ds.field("position") > self.after
        for name, values in self.values.items():
            out &= ds.field(name).isin(sorted(values))
        return out

    def read(self, root: str, part: InputPartition) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        if isinstance(part, File):
            (whole,) = ds.dataset(part.path, format="parquet").get_fragments()
            for b in whole.subset(row_group_ids=part.groups).to_batches(columns=_ARROW.names, filter=self.expression(), batch_size=4096):
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, _ARROW, strict=True)], schema=_ARROW)
            return
        rows: dict[str, list] = {n: [] for n in _ARROW.names}
        for version in range(part.start, part.end):
            with open(f"{root}/commits/{commit_name(version)}", encoding="utf-8") as f:
                events = [json.loads(line) for line in f]
            for event in events:
                if event["position"] > self.after and all(event[n] in v for n, v in self.values.items()):
                    for n, column in rows.items():
                        column.append(event[n])
        if rows["position"]:
            yield from pa.Table.from_pydict(rows, _ARROW).to_batches(max_chunksize=4096)


class BatchReader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.wanted = root, Wanted()

    def pushFilters(self, filters):
        return [f for f in filters if not self.wanted.take(f)]

    def partitions(self):
        start, files = 0, []
        lists = sorted(os.listdir(f"{self.root}/compacted")) if os.path.isdir(f"{self.root}/compacted") else []
        if lists:
            with open(f"{self.root}/compacted/{lists[-1]}", encoding="utf-8") as f:
                found = json.load(f)
            start = found["version"]
            files = [p for s in found["segments"] if s["last"] > self.wanted.after for p in _files(self.root, s["path"])]
        return [*files, *ranges(self.root, start, published(self.root, start))] or [Range(0, 0)]

    def read(self, partition):
        return self.wanted.read(self.root, partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, root: str, start: int):
        self.root, self.start, self.known = root, start, start

    def initialOffset(self):
        return {"commits": self.start}

    def latestOffset(self):
        self.known = published(self.root, self.known, self.known + MOST)
        return {"commits": self.known}

    def partitions(self, start, end):
        return ranges(self.root, start["commits"], end["commits"])

    def read(self, partition):
        return Wanted().read(self.root, partition)

    def commit(self, end):
        pass


class FoldlogSource(DataSource):
    """spark.read or readStream .format("foldlog").option("path", root); option start is the first commit of a stream."""

    @classmethod
    def name(cls):
        return "foldlog"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BatchReader(self.options["path"])

    def streamReader(self, schema):
        return StreamReader(self.options["path"], int(self.options.get("start", 0)))


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, and lets Spark hand filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FoldlogSource)

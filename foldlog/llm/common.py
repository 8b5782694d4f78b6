"""Shared pieces of the corpus operators: table access, Arrow blocks, words and ragged arrays."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch between the JVM and a Python worker, about: texts can be long, so batches are short.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20
#: Bytes of text that a worker gathers before it works on them.
BLOCK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow(spark: SparkSession) -> None:
    """Short Arrow batches for this session, whose settings the plans of the operators take up when they run; shorter ones stay."""
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = (spark.conf.get(key) or "").rstrip("b")  # bytes are shown with their unit
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def remainder(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def _split(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold most bytes each, or one row."""
    if batch.num_rows == 1 or batch.nbytes <= most:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from _split(batch.slice(0, half), most)
        yield from _split(batch.slice(half), most)


def blocks(batches: Iterable[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The rows in blocks of most bytes at most, unless a single row is larger; memory is bounded by that and one batch."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for batch in _split(whole, most) if whole.num_rows else ():
            if held and size + batch.nbytes > most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                pa.default_memory_pool().release_unused()  # workers of a stage share an executor's memory
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def texts(block: pa.Table, name: str = "text") -> list[str]:
    return [t or "" for t in block.column(name).to_pylist()]


def raw_texts(block: pa.Table, name: str = "text") -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [t or b"" for t in block.column(name).cast(pa.binary()).to_pylist()]


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces flat[s : s + n] one after another."""
    if not len(lengths):
        return flat[:0]
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]


def offsets(lengths: np.ndarray | list[int]) -> np.ndarray:
    """0 and the running sums."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


class Words:
    """Numbers for distinct words, given in order of first sight; forgets all but known when it has grown beyond its limit.

    A caller keeps something for each number (ids, features), computed by learn() for new words only; it has that of the
    words in known from the start, and again after forget().
    """

    def __init__(self, learn: Callable[[list], None], forget: Callable[[], None], limit: int = 400_000, limit_bytes: int = 32 << 20, known: list | tuple = ()):
        self.learn, self.forget, self.limit, self.limit_bytes = learn, forget, limit + len(known), limit_bytes
        self.known = dict(zip(known, range(len(known)), strict=True))
        self.index: dict = dict(self.known)
        self.bytes = 0

    def numbers(self, lists: list[list]) -> np.ndarray:
        if len(self.index) > self.limit or self.bytes > self.limit_bytes:
            self.index, self.bytes = dict(self.known), 0
            self.forget()
        seen: set = set()
        for x in lists:
            seen.update(x)
        new = [w for w in seen if w not in self.index]
        if new:
            self.learn(new)
            n = len(self.index)
            self.index.update(zip(new, range(n, n + len(new)), strict=True))
            self.bytes += sum(map(len, new))
        total = sum(map(len, lists))
        return np.fromiter(map(self.index.__getitem__, chain.from_iterable(lists)), np.int64, total)


class Growing:
    """Arrays that grow at the end, and are as they were at first after clear()."""

    def __init__(self, *arrays: np.ndarray):
        self.first = arrays
        self.clear()

    def clear(self) -> None:
        self.arrays = list(self.first)

    def extend(self, *more: np.ndarray) -> None:
        self.arrays = [np.concatenate([a, np.asarray(b, a.dtype)]) for a, b in zip(self.arrays, more, strict=True)]


#: White space of the public pattern that splits text before merges (the Unicode property White_Space).
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_loose = re.compile(f" (?:[{SPACES}]|\\Z)")
_before = re.compile(f"(?= [^{SPACES}])")


def chunks(text: str) -> list[str]:
    """Keys of the pieces between which no token of a byte-level tokenizer can reach across.

    A cut stands before each space that a non-space follows. The pattern never joins such a space to what precedes
    it, and what it matches in a piece doesn't depend on the others. The key of a piece that begins at a cut is the
    piece without its space; any other piece's key is the piece with a space in front. spelled() inverts this.
    """
    if not _loose.search(text):
        out = text.split(" ")
        out[0] = " " + out[0]
        return out
    return [c[1:] if i else " " + c for i, c in enumerate(_before.split(text))]


def spelled(key: str) -> str:
    return key[1:] if key[:1] == " " else " " + key


def per_document(docs: DataFrame, keep: list[str], fields: list[tuple[str, pa.DataType]], work: Callable[[pa.Table], list], mask: str | None = None) -> DataFrame:
    """Columns keep of docs, and those that work gives for a block of its rows (doc_id and text are there, whatever keep says).

    With mask, only the rows where that new column is true stay, and no new columns do.
    """
    arrow(docs.sparkSession)
    needed = list(dict.fromkeys([*keep, "text"]))
    source = docs.select(*[F.col(f"`{n}`") for n in needed])
    kept = [f for f in source.schema.fields if f.name in keep]
    kinds = {pa.int64(): "long", pa.float64(): "double", pa.bool_(): "boolean", pa.string(): "string", pa.int32(): "int", pa.binary(): "binary"}
    new = [] if mask else fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} {kinds[t]}" for n, t in new])
    names = [f.name for f in kept]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            arrays = [pa.array(a, t) for a, (_, t) in zip(work(block), fields, strict=True)]
            own = [block.column(n) for n in names]
            if mask:
                chosen = pa.Table.from_arrays(own, names).filter(arrays[[n for n, _ in fields].index(mask)])
                yield from chosen.to_batches(max_chunksize=ARROW_ROWS)
            else:
                yield from pa.Table.from_arrays(own + arrays, names + [n for n, _ in fields]).to_batches(max_chunksize=ARROW_ROWS)

    return source.mapInArrow(run, schema)


def share(seed: int, *columns: str) -> Column:
    """A number from 0 to 1 that depends on the values of columns alone."""
    return (F.xxhash64(*columns, F.lit(seed)) % F.lit(1 << 30) + F.lit(1 << 30)) % F.lit(1 << 30) / F.lit(float(1 << 30))


def sampled(rows: DataFrame, rate: Column | float, seed: int) -> DataFrame:
    """About that share of the distinct rows (doc_id, text), with all columns: a row counts by its id and text, and its repeats once.

    So neither rows without id nor repeats of a row make the sample larger than its rate says.
    """
    rows = rows.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.where(share(seed, "doc_id", "text_hash") < rate).dropDuplicates(["doc_id", "text_hash"])


def unused(names: list[str], n: int) -> list[str]:
    """n column names that aren't among names, whatever their case."""
    taken = {x.lower() for x in names}
    return [x for i in range(n + len(taken)) if (x := f"own_{i}") not in taken][:n]


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows from at[i] to at[i + 1]; 0 where there are none."""
    out = np.zeros((len(at) - 1, *values.shape[1:]), np.float64)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = np.add.reduceat(values, at[some], axis=0)
    return out

"""Operator 10: best-fit packing of token sequences.

Bulk-synchronous best fit. Pieces come in classes of similar length, longest first; each class is one superstep over
all gaps that can hold one of its pieces:

1. Pieces and gaps are range-sorted together by size, descending. A gap that surely holds several pieces of the class
   stands there so many times; as many new sequences as the class could need stand before all other gaps.
2. Each piece looks for its successor, the smallest gap left that holds it. In the sorted order gaps open and pieces
   close brackets, and the piece takes the gap of its bracket: so longer pieces choose first and no gap is taken twice.
   A task matches the brackets within its range. What it can't match has a rank, its bracket's level, which the sums of
   the ranges before it turn into one among all; pieces and gaps of equal rank then meet by a join over the ranges.
3. Matched gaps shrink and take their new place in the order of the next superstep; new sequences that no piece took
   are forgotten.

No piece is left after its superstep, so there are as many supersteps as classes (STEP, LEAST), whatever the data. Ties
of length are ranked by task and row, so a length that a third of all pieces share is split like any other range. The
driver sees a count for each class; each superstep's tables are written to the checkpoint folder.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldlog.llm import common
from foldlog.llm.store import drop, stored

END = 0
#: Characters of a word from which on the engine's time grows faster than its length.
LONG_WORD = 2000
#: Least length of a class by its greatest; the lengths up to this share of the capacity are one class. Rows of a range, about.
STEP, LEAST, ROWS = 0.8, 1 / 128, 250_000


class Tokens:
    """Ids of whole texts by a tokenizer of the tokenizers library, without special tokens added.

    A plain byte-level BPE (no normalizer, merges in the order of ids, the public pattern) runs on tiktoken's engine,
    which gives the same ids several times as fast; a test compares the two for every code point. Texts with a string
    that the tokenizer holds for a special token, or with a very long word, go to the tokenizers library itself.
    """

    def __init__(self, spec: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._engine(json.loads(spec))

    @staticmethod
    def _engine(spec: dict):
        """A tiktoken encoding that equals the specification; None if it isn't of the plain kind."""
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not spec["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if not plain or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
        added = {t["content"] for t in spec["added_tokens"]}
        names = sorted((i, t) for t, i in model["vocab"].items() if t not in added)
        merged = [a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        if [t for _, t in names[256:]] != merged or any(len(t) > 1 for _, t in names[:256]):
            return None
        import tiktoken

        import public_tokenizers

        ranks = {bytes(byte[c] for c in t): i for i, t in names}
        return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(a in text for a in self.added) or len(text) > LONG_WORD and max(map(len, text.split())) > LONG_WORD:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


_kept: dict[str, Tokens] = {}


def pieces_of(docs: DataFrame, spec: str, capacity: int) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and its task (part) and number in it (nth)."""
    spark = docs.sparkSession
    common.arrow(spark)
    shared = spark.sparkContext.broadcast(spec)  # as large as the vocabulary
    names = ("piece", "start", "length", "ids_crc32", "part", "nth")
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value not in _kept:
            _kept.clear()
            _kept[shared.value] = Tokens(shared.value)
        tokens, part, seen = _kept[shared.value], TaskContext.get().partitionId(), 0
        for block in common.blocks(batches):
            rows: list[tuple] = []
            for doc_id, ids in zip(block.column("doc_id").to_pylist(), map(tokens.encode, common.texts(block)), strict=True):
                raw, total = ids.astype("<u4").tobytes() + END.to_bytes(4, "little"), len(ids) + 1
                cuts = [0, *range(total % capacity or capacity, total + 1, capacity)] if total > capacity else [0, total]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), part, seen))
                    seen += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def classes(capacity: int) -> list[tuple[int, int]]:
    """Bounds (lo, hi] of the classes of lengths, greatest first."""
    out, hi = [], capacity
    while hi:
        lo = min(hi - 1, int(hi * STEP)) if hi > capacity * LEAST else 0
        out.append((lo, hi))
        hi = lo
    return out


def brackets(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of gaps (0, which open) and pieces (1, which close) in order: places of matched gaps and of their pieces, the level of each, and how many more open than close."""
    depth = np.cumsum(np.where(kind == 0, 1, -1))
    level = depth + kind
    order = np.argsort(level, kind="stable")
    k, at = kind[order], level[order]
    hit = np.flatnonzero((at[1:] == at[:-1]) & (k[:-1] == 0) & (k[1:] == 1))
    return order[hit], order[hit + 1], level, int(depth[-1]) if len(depth) else 0


GAP, PIECE, PAIR, NET = 0, 1, 2, 3
_NAMES = ("range", "kind", "level", "size", "gap", "sequence_id", "slot", "part", "nth")


def _match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one range in order: matched pairs, gaps and pieces that aren't, and how many more gaps than pieces it has."""
    own = [b for b in batches if b.num_rows]
    if not own:
        return
    table, number = pa.Table.from_batches(own), TaskContext.get().partitionId()
    c = {n: table.column(n).to_numpy() for n in ("kind", "size", "gap", "a", "b")}
    gaps, pieces, level, net = brackets(c["kind"])
    alone = np.ones(len(level), bool)
    alone[gaps] = alone[pieces] = False

    def rows(kind: int, g: np.ndarray | None, p: np.ndarray | None, level: np.ndarray) -> pa.RecordBatch:
        n, none = len(level), pa.nulls(len(level), pa.int64())
        of = lambda name, at: none if at is None else pa.array(c[name][at].astype(np.int64))
        fixed = [pa.array(np.full(n, x, np.int64)) for x in (number, kind)]
        return pa.RecordBatch.from_arrays([*fixed, pa.array(level.astype(np.int64)), of("size", p), of("gap", g), of("a", g), of("b", g), of("a", p), of("b", p)], list(_NAMES))

    open_gaps, open_pieces = (np.flatnonzero(alone & (c["kind"] == k)) for k in (GAP, PIECE))
    yield rows(PAIR, gaps, pieces, level[gaps])
    yield rows(GAP, open_gaps, None, level[open_gaps])
    yield rows(PIECE, None, open_pieces, level[open_pieces])
    yield rows(NET, None, None, np.array([net]))


def superstep(pieces: DataFrame, gaps: DataFrame, n: int, opened: int, hi: int, capacity: int) -> DataFrame:
    """(part, nth, sequence_id, offset, gap, last) for each of the n pieces (part, nth, length up to hi): gap is what its sequence then
    has left, last tells its last piece. gaps: (sequence_id, gap) that can hold a piece; opened: the first number for new sequences."""
    spark = pieces.sparkSession
    new = spark.range(opened, opened - (-n // (capacity // hi))).select(F.col("id").alias("sequence_id"), F.lit(capacity).cast("long").alias("gap"))
    slots = gaps.unionByName(new).select(F.least("gap", F.lit(hi)).cast("long").alias("size"), F.lit(GAP).alias("kind"), "gap", F.col("sequence_id").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"gap div {hi}"), F.lit(1)) - 1)).alias("b"))
    events = slots.unionByName(pieces.select(F.col("length").alias("size"), F.lit(PIECE).alias("kind"), F.lit(0).cast("long").alias("gap"), F.col("part").alias("a"), F.col("nth").alias("b")))
    order = [F.desc("size"), "kind", F.desc("gap"), "a", "b"]
    events = events.repartitionByRange(1 + (2 * n + opened) // ROWS, *order).sortWithinPartitions(*order)
    local = stored(events.mapInArrow(_match, ", ".join(f"{x} long" for x in _NAMES)))
    before = F.sum("level").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    base = local.where(F.col("kind") == NET).select("range", F.coalesce(before, F.lit(0)).alias("base"))  # a row for each range
    alone = local.where(F.col("kind") < PAIR).join(F.broadcast(base), "range").withColumn("level", F.col("level") + F.col("base"))
    same = Window.partitionBy("level").orderBy("range", F.desc("kind"))  # two rows of each range at most
    found = alone.withColumn("found", F.lag(F.struct("kind", "sequence_id", "slot", "gap")).over(same)).where((F.col("kind") == PIECE) & (F.col("found.kind") == GAP))
    pairs = local.where(F.col("kind") == PAIR).select("part", "nth", "size", "sequence_id", "slot", "gap").union(found.select("part", "nth", "size", "found.sequence_id", "found.slot", "found.gap"))
    own = Window.partitionBy("sequence_id").orderBy("slot")
    taken = F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = pairs.withColumn("taken", taken).withColumn("last", F.lead("slot").over(own).isNull())
    return stored(placed.select("part", "nth", "sequence_id", (F.lit(capacity) - F.col("gap") + F.col("taken") - F.col("size")).alias("offset"), (F.col("gap") - F.col("taken")).alias("gap"), "last"), local)


def pack(docs: DataFrame, spec: str, capacity: int = 2048) -> DataFrame:
    """Packs the documents (doc_id, text) into sequences of capacity tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each text is whole: its ids and a closing 0. Only longer ones are cut, the first piece being the shorter. A null
    or empty text is the closing 0 alone; repeated rows are packed each; a null doc_id is kept; other columns are
    ignored; ties of length go by task and place in it. An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = stored(pieces_of(docs, spec, capacity))
    bounds = classes(capacity)
    number = sum((F.col("length") <= lo).cast("int") for lo, _ in bounds)
    counts = {r["k"]: r["n"] for r in pieces.groupBy(number.alias("k")).agg(F.count("*").alias("n")).collect()}  # a row for each class
    gaps = stored(spark.createDataFrame([], "sequence_id long, gap long"))
    opened, placed = 0, []
    for k in sorted(counts):
        lo, hi = bounds[k]
        own = pieces.where((F.col("length") > lo) & (F.col("length") <= hi))
        placed.append(superstep(own, gaps.where(F.col("gap") > lo), counts[k], opened, hi, capacity))
        opened += -(-counts[k] // (capacity // hi))
        ends = placed[-1].where("last").select("sequence_id", "gap")
        gaps = stored(gaps.join(ends, "sequence_id", "left_anti").unionByName(ends.where("gap > 0")), gaps)
    drop(gaps)
    if not placed:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = placed[0]
    for x in placed[1:]:
        places = places.unionByName(x)
    return pieces.join(places.drop("gap", "last"), ["part", "nth"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def default_spec() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), default_spec())

"""Operator 8: substring dedup by level-wise doubling.

Words covered by a window of LENGTH words that also starts in a document of smaller id are removed. Windows of a short
length are looked at first; only where they are repeated are windows of twice the length looked at, and so on up to
LENGTH, or until none is left. For 50 words the levels are 13, 25 and 50 (halves that overlap by a word where a length is odd).

- Copies of a whole text are set aside first: all but the one of smallest id lose every word (if it has a window).
- The first level is a sieve: of all short windows inside a full one, a document posts the one of least hash. Two
  documents with a full window in common post the same short one, so no repeat is lost, though few windows are posted.
- At the second, all windows that halve a full one which passed the sieve are posted, from the candidate texts only.
- From then on a window is that of its two halves, both of which must be repeated; it is known by both their hashes. No
  text is read for it: halves of a text meet by their places. At the last level the smallest document id of each
  repeated window decides. From the second level on, windows are compared by 128 bits.

Postings are aggregated by hash with map-side combining (a smallest and a largest id for each), so a passage in a third
of all documents makes no large group; what is joined back are plain equi-joins of written tables, whose skewed
partitions Spark can split. Texts are shuffled once, to meet their candidates. Tables of a level go when the next is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldlog.llm import common
from foldlog.llm.store import drop, stored

#: Words of a window; greatest length of the first level.
LENGTH, SHORT = 50, 13
#: Bytes that are hashed at once.
AT_ONCE = 1 << 20
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\f"))
_BYTES = np.random.default_rng(8).integers(0, 1 << 63, (256, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(odd: int, n: int) -> np.ndarray:
    """The first n powers, from two short tables."""
    size = 4096
    low = _powers(np.uint64(odd), size)
    high = _powers(np.uint64(pow(odd, size, 1 << 64)), -(-n // size))
    return (high[:, None] * low).ravel()[:n]


@cache
def _tables(part: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers and inverse powers for AT_ONCE bytes."""
    odd = int(_ODD[part])
    return powers(odd, AT_ONCE), powers(pow(odd, -1, 1 << 64), AT_ONCE)


def _some_hashes(data: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of data begin, which ends with a blank, and their hashes: differences of prefix sums."""
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.append(0, edge)
    start, end = edge[0::2], edge[1::2]
    out = np.empty((len(start), parts), np.uint64)
    for k in range(parts):
        on, back = _tables(k) if len(data) <= AT_ONCE else (powers(int(_ODD[k]), len(data)), powers(pow(int(_ODD[k]), -1, 1 << 64), len(data)))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[:, k][data] * on[: len(data)], out=sums[1:])
        h = (sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out[:, k] = h ^ (h >> np.uint64(29))
    return start, out


def word_hashes(raw: list[bytes], parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes (one column for each of parts) of all words of the texts, and where each text's words begin.

    Bytes are worked on AT_ONCE at a time, cut at blanks, so that memory beyond the words' doesn't follow the length of
    texts; only a single word that is longer is taken whole.
    """
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    starts, hashes, a = [np.zeros(0, np.int64)], [np.zeros((0, parts), np.uint64)], 0
    while a < len(data):
        b = min(a + AT_ONCE, len(data))
        if b < len(data):
            cut = np.flatnonzero(_BLANK[data[a:b]])
            while not len(cut):
                more, b = b, min(b + AT_ONCE, len(data))
                cut = np.flatnonzero(_BLANK[data[more:b]])[:1] + (more - a)
            b = a + int(cut[-1]) + 1
        start, found = _some_hashes(data[a:b], parts)
        starts.append(start + a)
        hashes.append(found)
        a = b
    start = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(start, common.offsets([len(t) + 1 for t in raw]))


def _powers(odd: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, odd, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def windows(h: np.ndarray, length: int, part: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of length word hashes (one column of word_hashes()), whatever document it ends in."""
    n = len(h)
    if n < length:
        return np.zeros(0, np.uint64)
    odd = _ODD[part]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * _powers(odd, n), out=sums[1:])
    back = _powers(np.uint64(pow(int(odd), -1, 1 << 64)), n - length + 1)
    out = (sums[length:] - sums[:-length]) * back
    out ^= out >> np.uint64(31)  # the low bits of such sums are weak
    out *= np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(32))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values."""
    done, size = values, 1
    while size < width:
        step = min(size, width - size)
        done = np.minimum(done[:-step], done[step:])
        size += step
    return done


def whole(at: np.ndarray, length: int) -> np.ndarray:
    """Where windows of that length start that end in the same text."""
    n = int(at[-1])
    ends = np.repeat(at[1:], np.diff(at))
    return np.flatnonzero(np.arange(n) + length <= ends)


def levels(length: int) -> list[int]:
    """length and its halves (rounded up) down to SHORT or less, smallest first; at least two."""
    out = [length]
    while out[0] > SHORT or len(out) < 2:
        out.insert(0, -(-out[0] // 2))
    return out


def sieved(h: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The full windows' first words, and of each the least hash of the windows of the first level in it."""
    starts, short = whole(at, length), levels(length)[0]
    return starts, least(windows(h, short), length - short + 1)[starts] if len(starts) else np.zeros(0, np.uint64)


def summaries(docs: DataFrame, length: int) -> DataFrame:
    """A row for each of docs: doc_id, t1, t2 (hash of the text), n_words, kept (hash of all words), and what it posts to the first level."""
    schema = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("posted", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            raw = common.raw_texts(block)
            h, at = word_hashes(raw)
            _, found = sieved(h[:, 0], at, length)
            own = np.repeat(np.arange(len(raw)), np.maximum(np.diff(at) - length + 1, 0))
            change = np.append(True, (found[1:] != found[:-1]) | (own[1:] != own[:-1]))[: len(found)]
            found, own = found[change], own[change]
            order = np.lexsort([found, own])
            found, own = found[order], own[order]
            first = np.append(True, (found[1:] != found[:-1]) | (own[1:] != own[:-1]))[: len(found)]
            found, own = found[first].view(np.int64), own[first]
            posted = pa.ListArray.from_arrays(pa.array(common.offsets(np.bincount(own, minlength=len(raw))), pa.int32()), pa.array(found, pa.int64()))
            digests = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in raw]
            yield pa.RecordBatch.from_arrays([*(block.column(n).cast(pa.int64()).combine_chunks() for n in ("doc_id", "t1", "t2")), pa.array(np.diff(at)), pa.array(digests, pa.string()), posted], schema=schema)

    common.arrow(docs.sparkSession)
    return _hashed(docs).mapInArrow(run, "doc_id long, t1 long, t2 long, n_words long, kept_sha256 string, posted array<long>")


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t1"), F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)).alias("t2"))


def second(texts: DataFrame, length: int) -> DataFrame:
    """From texts with the repeated windows of the first level that they posted: the windows (doc_id, t1, place, a, b) of the
    second level that make up a full window which rests on one."""
    size = levels(length)[1]
    schema = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("place", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    tiles = [min(i, length - size) for i in range(0, length, size)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            raw = common.raw_texts(block)
            h, at = word_hashes(raw, 2)
            starts, lowest = sieved(h[:, 0], at, length)
            lowest = lowest.view(np.int64)
            column = block.column("repeated").combine_chunks()
            own = np.repeat(np.arange(len(raw)), np.maximum(np.diff(at) - length + 1, 0))
            has = np.repeat(np.arange(len(raw)), np.diff(column.offsets.to_numpy()))
            values, code = np.unique(np.concatenate([column.flatten().to_numpy(), lowest]), return_inverse=True)
            n = len(has)
            good = np.isin(own * len(values) + code[n:], has * len(values) + code[:n])
            posted = np.zeros(len(h), bool)
            for tile in tiles:
                posted[starts[good] + tile] = True
            posted = np.flatnonzero(posted)
            own = np.searchsorted(at, posted, side="right") - 1
            a, b = (windows(h[:, k], size, k)[posted].view(np.int64) for k in (0, 1))
            ids, t1 = (block.column(c).to_numpy()[own] for c in ("doc_id", "t1"))
            for i in range(0, len(posted), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)], pa.int64()) for x in (ids, t1, posted - at[own], a, b)], schema=schema)

    return texts.select("doc_id", "t1", "text", "repeated").mapInArrow(run, "doc_id long, t1 long, place long, a long, b long")


def doubled(found: DataFrame, size: int, double: int) -> DataFrame:
    """Windows of length double (or one less than twice size) from those of length size in found: where both halves are repeated in other documents."""
    twice = stored(found.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(F.col("first") < F.col("last")).select("a", "b"))
    half = stored(found.join(twice, ["a", "b"], "left_semi").select("doc_id", "t1", "place", "a", "b"), twice)
    other = F.first(F.struct("a", "b")).over(Window.partitionBy("doc_id", "t1").orderBy("place").rangeBetween(double - size, double - size))  # a document's own
    both = half.withColumn("other", other).where(F.col("other").isNotNull())
    return stored(both.select("doc_id", "t1", "place", F.xxhash64("a", "other.a").alias("a"), F.xxhash64("b", "other.b", F.lit(1)).alias("b")), half)


def cut(texts: DataFrame, length: int, with_text: bool) -> DataFrame:
    """texts without the words that windows from the given places cover: n_removed, kept_sha256 and, if asked for, the rest of the text."""
    fields = [("doc_id", pa.int64()), ("t1", pa.int64()), ("n_removed", pa.int64()), ("cut_sha256", pa.string())] + [("cut_text", pa.string())] * with_text
    schema = pa.schema(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, places in zip(common.raw_texts(b), b.column("places"), strict=True):
                words, at = text.split(), places.values.to_numpy()
                step = np.bincount(at, minlength=len(words) + 1)[: len(words) + 1] - np.bincount(at + length, minlength=len(words) + 1)
                stays = (np.cumsum(step)[:-1] == 0).tolist()
                out.append((len(words) - sum(stays), b" ".join(w for w, s in zip(words, stays, strict=True) if s)))
            columns = [b.column("doc_id"), b.column("t1"), pa.array([n for n, _ in out], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for _, t in out], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([t.decode() for _, t in out], pa.string())] * with_text, schema=schema)

    return texts.select("doc_id", "t1", "text", "places").mapInArrow(run, "doc_id long, t1 long, n_removed long, cut_sha256 string" + ", cut_text string" * with_text)


def dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """A row for each of docs (doc_id, text): doc_id, t1, t2, n_words, n_removed, kept_sha256, and with with_text the cut text.

    cut_text is null where no word is removed (the text stays as it is). A null or empty text has no words and loses
    none. Rows of equal doc_id are one document's: their windows don't remove each other's. A null doc_id is neither
    smaller nor greater: its row loses nothing and removes nothing. Other columns are ignored. An empty table gives no
    rows.
    """
    sizes = levels(length)
    every = stored(summaries(docs, length))
    copies = stored(every.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(F.col("first") < F.col("last")).drop("last"))
    rows = stored(every.join(copies, ["t1", "t2"], "left").withColumn("copied", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)) & (F.col("n_words") >= length)).drop("first"), every, copies)
    posts = rows.where(~F.col("copied") & F.col("doc_id").isNotNull()).select("doc_id", "t1", F.explode("posted").alias("short"))
    shared = stored(posts.groupBy("short").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(F.col("first") < F.col("last")).select("short"))
    repeated = stored(posts.join(shared, "short", "left_semi"), shared)
    texts = stored(_hashed(docs).drop("t2").join(repeated.groupBy("doc_id", "t1").agg(F.collect_set("short").alias("repeated")), ["doc_id", "t1"]).dropDuplicates(["doc_id", "t1"]), repeated)  # a document's own
    found = stored(second(texts, length))
    for size, double in zip(sizes[1:-1], sizes[2:], strict=True):
        found, shorter = doubled(found, size, double), found
        drop(shorter)
    sources = stored(found.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(F.col("first") < F.col("last")).drop("last"))
    removed = stored(found.join(sources, ["a", "b"]).where(F.col("doc_id") > F.col("first")).select("doc_id", "t1", F.col("place").cast("int").alias("place")), found, sources)
    places = removed.groupBy("doc_id", "t1").agg(F.collect_list("place").alias("places"))  # a document's own
    cuts = cut(texts.join(places, ["doc_id", "t1"]), length, with_text)
    out = rows.drop("posted").join(cuts, ["doc_id", "t1"], "left")
    new = {
        "n_removed": F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))),
        "kept_sha256": F.when(F.col("copied"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("cut_sha256", "kept_sha256")),
    }
    if with_text:
        new["cut_text"] = F.when(F.col("copied"), F.lit("")).otherwise(F.col("cut_text"))
    return out.withColumns(new).select("doc_id", "t1", "t2", "n_words", *new)


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with all their columns, where text has lost the words that dedup() removes, and n_chars follows if there is one.

    A text that loses words is what is left of them, joined by single spaces (empty if nothing is); other texts, null
    ones too, stay as they are, and so do rows without doc_id. Repeated rows are treated alike; an empty table gives no rows.
    """
    own, cut_id, cut_hash, cut_text = common.unused(docs.columns, 4)
    cuts = stored(dedup(docs, length, with_text=True).where("n_removed > 0").select(F.col("doc_id").alias(cut_id), F.col("t1").alias(cut_hash), F.col("cut_text").alias(cut_text))).dropDuplicates([cut_id, cut_hash])
    out = docs.withColumn(own, F.xxhash64(F.coalesce(docs["text"], F.lit(""))))
    out = out.join(cuts, (F.col("doc_id") == F.col(cut_id)) & (F.col(own) == F.col(cut_hash)), "left")
    new = {"text": F.coalesce(cut_text, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(cut_text).isNotNull(), F.char_length(cut_text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: For DuckDB: windows as text, all of them grouped.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT key, min(doc_id) AS first FROM h GROUP BY key),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM h JOIN f USING (key) WHERE doc_id > first),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
g AS (SELECT k.doc_id, count(r.j) AS n_removed, string_agg(word, ' ' ORDER BY k.j) FILTER (r.j IS NULL) AS kept FROM k LEFT JOIN r ON k.doc_id = r.doc_id AND k.j = r.j GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

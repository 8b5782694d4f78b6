"""Operator 7: n-gram Jaccard join by parity sketches.

A document's set is that of its 5-word shingles. Each shingle toggles one bit of a sketch, so the Hamming distance of
two sketches is never more than the symmetric difference of the sets. Pairs with a Jaccard similarity of SIMILAR or
more differ in at most d shingles, where d follows from the sizes; the (sparse) sketch of a size band is cut into m > d
parts, so at least m - d parts of such a pair are equal (pigeonhole). Sets meet by fingerprints of their parts, the XOR
of codes of the set bits. Pairs that met are sifted by how often they met, which takes neither sketches nor texts, then
narrowed by sizes and by the distance of a dense sketch of BITS bits, and what is left is verified on the texts. Dense sketches are made when the sets are read first, so that only texts of sets
with a near candidate, or of a crowded part, are moved: the larger a table, the more of its sets meet others by chance.

Nothing is left out for skew:

- Equal sets are one node from the start.
- Parts without a bit aren't posted. Sets with m - d or more such parts (two of them could have no other part in
  common) also post the prefix of their tokens in hash order, by which they meet each other.
- A part that more than CROWD sets share is crowded: its sets aren't paired by it, but compared by their sketches in
  chunks of CHUNK, each of which gives the edges of a shortest spanning forest. A task that finds a part crowded among
  its own texts sends on CROWD + 1 posts of it and spreads the others over all tasks: no task gets a part that many
  sets share as a whole.
- Sets that are in as many crowded parts as they need to share also meet by their rarest shingles (a prefix filter): two sets that link have one in common
  among as many of each as may be missing from the other, and what crowds a part is frequent, so not among them. Only
  shingles that sets of different components share make pairs; of the few that are crowded too, the sets of different
  components are compared in chunks.

Links are verified in steps, so that few pairs of a large group are: the closest candidate of each set; the candidates
and edges of the forests between the components that this leaves; what meets by rare shingles and is still apart. Texts
are what is moved to verify: hashes of shingles would be several times their compressed size. Components come from
distributed hooking and pointer jumping. No links, components or fingerprints go to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.llm import common
from foldlog.llm.store import stored, swept
from foldlog.llm.substrings import windows, word_hashes

SHINGLE = 5
#: Similarity as a fraction of whole numbers: 100 * intersection >= 80 * union.
SIMILAR = (80, 100)
CROWD = 16
#: Posts of a task, about; bits of a dense sketch; sets of a crowded part that are compared in one piece, and how many of all
#: sets of a larger one are in each of its chunks, so that chunks are linked.
POSTS, BITS, CHUNK, PIVOTS = 2_000_000, 2048, 2048, 16
#: Posts that a task gathers before it sends them; counters of the frequencies of shingles, and how many of them are in a row.
HELD, COUNTERS, COUNTED = 4_000_000, 1 << 18, 1 << 12
#: Bytes of text whose sets a worker holds at once; sets whose dense sketches it makes at once.
BLOCK, SKETCHED = 4 << 20, 512


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def largest_partner(n: int) -> int:
    return n * SIMILAR[1] // SIMILAR[0]


def prefix_length(n: int) -> int:
    """Of a set of n tokens in any order that all sets share, as many of the first as two sets that link have one of in common."""
    return n - -(-n * SIMILAR[0] // SIMILAR[1]) + 1


def linked(n_a, n_b, common_part):
    """SIMILAR in whole numbers."""
    return SIMILAR[1] * common_part >= SIMILAR[0] * (n_a + n_b - common_part)


@cache
def band_bounds(n: int) -> tuple[int, ...]:
    """First sizes of the bands, up to the one after n's: a set's partners of greater size are in its band or the next."""
    out = [1]
    while out[-1] <= n:
        out.append(max(out[-1] + 1, largest_partner(out[-1] - 1) + 1, -(-out[-1] * SIMILAR[1] // SIMILAR[0])))
    return tuple(out)


@cache
def cuts_of(band: int) -> tuple[int, int]:
    """(d, m) of the pairs whose smaller set is in that band."""
    bounds = band_bounds(1)
    while len(bounds) < band + 2:
        bounds = band_bounds(bounds[-1])
    a = bounds[band + 1] - 1
    both = a + largest_partner(a)
    d = both * (SIMILAR[1] - SIMILAR[0]) // (SIMILAR[1] + SIMILAR[0])
    return d, d + (d * 3 + 19) // 20 + 1


def shingles(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text (A-Z lower-cased), ascending, one text after another; and where each begins."""
    h, at = word_hashes([t.lower() for t in raw])
    h = h[:, 0]
    counts = np.diff(at)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, 0)
    own = np.repeat(np.arange(len(raw)), n)
    starts = np.repeat(at[:-1], n) + np.arange(n.sum()) - np.repeat(common.offsets(n)[:-1], n)
    values = windows(h, SHINGLE)[starts] if len(starts) else np.zeros(0, np.uint64)
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(few):
        whole = [mix(np.uint64(counts[i]) + windows(h[at[i] : at[i + 1]], int(counts[i])), 5)[0] for i in few.tolist()]
        values, own = np.append(values, np.array(whole, np.uint64)), np.append(own, few)
    order = np.lexsort([values, own])
    values, own = values[order], own[order]
    first = np.append(True, (values[1:] != values[:-1]) | (own[1:] != own[:-1]))[: len(values)]
    return values[first], common.offsets(np.bincount(own[first], minlength=len(raw)))


def set_hash(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set: its sum and its size, mixed."""
    out = np.zeros(len(at) - 1, np.uint64)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = np.add.reduceat(mix(values, 3), at[some])
    return mix(out + np.diff(at).astype(np.uint64), 4)


def sets_of(docs: DataFrame, keep: list[str], sketch: bool = False) -> DataFrame:
    """Columns keep, n_shingles, node (hash of the set; null for an empty set) and, if asked for, the sketch for each of docs."""

    def work(block: pa.Table) -> list:
        values, at = shingles(common.raw_texts(block))
        out = [np.diff(at), pa.array(set_hash(values, at).view(np.int64), mask=np.diff(at) == 0)]
        return [*out, sketches(values, at)] if sketch else out

    fields = [("n_shingles", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary())]
    return common.per_document(docs, keep, fields if sketch else fields[:2], work)


def posts_of(values: np.ndarray, at: np.ndarray, who: list[int]) -> Iterator[tuple[int, np.ndarray, int]]:
    """For the sets who: (set, keys of its posts, how many of them it shares with any set that it links with), once for each group of sizes, and once for the prefix of a set with few bits."""
    for i in who:
        own = values[at[i] : at[i + 1]]
        n = len(own)
        band = len(band_bounds(n)) - 2
        for group in {band, max(band - 1, 0)}:
            d, m = cuts_of(group)
            if not d:
                continue  # such sets link only with equal ones
            bit = mix(own, group + 16)
            part = (bit >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
            prints = np.zeros(m, np.uint64)
            np.bitwise_xor.at(prints, part.astype(np.int64), mix(bit & np.uint64(0x3FFFFFFF), 7))  # bit: one of 2^30 of its part
            filled = np.flatnonzero(prints)
            yield i, mix(prints[filled] + filled.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), group + 1000), max(len(filled) - d, 1)
            if len(filled) <= d:
                prefix = np.sort(mix(own, 9))[: prefix_length(n)]
                yield i, mix(prefix, group + 5000), 1


_POSTED = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("blob", pa.binary())])
_LOW = np.uint64((1 << 48) - 1)


def _sent(keys: np.ndarray, node: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of posts: (bucket, null, blob) with 48 bits of keys and the nodes, by bytes; (any bucket, key, blob) with the nodes beyond CROWD + 1 of one key."""
    order = np.lexsort([node, keys])
    keys, node = keys[order], node[order]
    fresh = np.append(True, (keys[1:] != keys[:-1]) | (node[1:] != node[:-1]))
    keys, node = keys[fresh], node[fresh]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(first, len(keys)))
    more = np.arange(len(keys)) - np.repeat(first, sizes) > CROWD
    rows: list[tuple] = []
    for a, n in zip(first[sizes > CROWD + 1].tolist(), sizes[sizes > CROWD + 1].tolist(), strict=True):
        for i in range(a + CROWD + 1, a + n, 1 << 14):
            own = node[i : min(i + (1 << 14), a + n)]
            rows.append((int(mix(own[:1].view(np.uint64))[0] % np.uint64(buckets)), int(keys[a] & _LOW), own.astype("<i8").tobytes()))
    keys, node = keys[~more], node[~more]
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # ascends with keys
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
        low = keys[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        rows.append((int(bucket[a]), None, low.T.tobytes() + node[a:b].astype("<i8").tobytes()))
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[i : i + 64]], f.type) for j, f in enumerate(_POSTED)], schema=_POSTED)


def _told(node: np.ndarray, shared: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row (any bucket, -1, blob): nodes and how many posts each shares with a set that it links with, as posts_of() says."""
    blob = node.astype("<i8").tobytes() + shared.astype("<i8").tobytes()
    row = (int(mix(node[:1].view(np.uint64))[0] % np.uint64(buckets)), -1, blob)
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _POSTED, strict=True)], schema=_POSTED)


def posts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, key, blob) rows of _sent() and _told(), for all sets of a task's texts (HELD posts at a time)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for block in common.blocks(batches, BLOCK):
            values, at = shingles(common.raw_texts(block))
            nodes = set_hash(values, at).view(np.int64)
            _, first = np.unique(nodes, return_index=True)
            found = list(posts_of(values, at, [i for i in first.tolist() if at[i + 1] > at[i]]))
            if not found:
                continue
            own = np.array([i for i, *_ in found])
            yield _told(nodes[own], np.array([n for *_, n in found], np.int64), buckets)
            held.append((np.concatenate([k for _, k, _ in found]), nodes[np.repeat(own, [len(k) for _, k, _ in found])]))
            size += len(held[-1][0])
            if size > HELD:
                yield from _sent(*(np.concatenate([h[i] for h in held]) for i in (0, 1)), buckets)
                held, size = [], 0
        if held:
            yield from _sent(*(np.concatenate([h[i] for h in held]) for i in (0, 1)), buckets)

    common.arrow(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "bucket int, key long, blob binary")


def crowd_of(keys: np.ndarray) -> np.ndarray:
    return mix(keys, 11).view(np.int64)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys and nodes."""
    n = len(blob) // 14
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :6] = np.frombuffer(blob, np.uint8, 6 * n).reshape(6, n).T
    return keys.view("<u8").ravel(), np.frombuffer(blob, "<u8", n, 6 * n).view(np.int64)


def meetings(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of one bucket, as arrays (a, b, crowd, n): pairs a < b that met (0) and how often, and sets a in crowded parts b (1)."""
    parts = [unpack(b) for b in blobs]
    keys, node = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.lexsort([node, keys])
    keys, node = keys[order], node[order]
    fresh = np.append(True, (keys[1:] != keys[:-1]) | (node[1:] != node[:-1]))  # a set posts from several blocks
    keys, node = keys[fresh], node[fresh]
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(cuts, len(keys)))
    found = [np.zeros((2, 0), np.int64)]
    for k in range(2, CROWD + 1):  # all keys that k sets share, at once
        own = cuts[sizes == k]
        if len(own):
            i, j = np.triu_indices(k, 1)
            found.append(np.stack([node[(own[:, None] + i).ravel()], node[(own[:, None] + j).ravel()]]))
    pairs, n = np.unique(np.concatenate(found, axis=1), axis=1, return_counts=True)  # nodes ascend within a key
    yield pairs[0], pairs[1], np.zeros(len(n), np.int64), n
    crowded = np.repeat(sizes > CROWD, sizes)
    if crowded.any():
        yield node[crowded], crowd_of(keys[crowded]), *np.ones((2, int(crowded.sum())), np.int64)


def meet(docs: DataFrame, total: int) -> DataFrame:
    """(a, b, crowd, n) rows of meetings(), over all buckets; and those of _told() with crowd 2."""
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // POSTS))
    schema = pa.schema([(n, pa.int64()) for n in ("a", "b", "crowd", "n")])

    def sent(columns: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(columns[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)], pa.int64()) for c in columns], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, key, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key is None:
                    by.setdefault(bucket, []).append(blob)
                elif key < 0:
                    nodes, shared = np.frombuffer(blob, "<i8").reshape(2, -1)
                    yield from sent((nodes, shared, np.full(len(nodes), 2), np.ones(len(nodes), np.int64)))
                else:
                    nodes = np.frombuffer(blob, "<i8")
                    yield from sent((nodes, np.repeat(crowd_of(np.array([key], np.uint64)), len(nodes)), *np.ones((2, len(nodes)), np.int64)))
        for bucket in sorted(by):
            for columns in meetings(by.pop(bucket)):
                yield from sent(columns)

    return posts(docs, tasks).repartition(tasks, "bucket").mapInArrow(run, "a long, b long, crowd long, n long")


def sifted(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of met (a table of meet()): its pairs (a, b, often: whether they met as often as sets that link), and sets of crowded parts (node, key) that may link with others of them without having met.

    Sets that link share as many posts as each of both tells. Of these, those in crowded parts make no meeting, and are no
    more than the crowded parts of either. What doesn't meet that often doesn't link, unless each of both is in as many
    crowded parts as the posts that it tells: then both are members, which also meet by rare shingles.
    """
    members = met.where("crowd = 1").select(F.col("a").alias("node"), F.col("b").alias("key")).distinct()
    crowds = members.groupBy("node").agg(F.count("*").alias("crowds"))
    told = met.where("crowd = 2").groupBy(F.col("a").alias("node")).agg(F.min("b").alias("shared"))
    of = stored(told.join(crowds, "node", "left").select("node", "shared", F.coalesce("crowds", F.lit(0)).alias("crowds")))
    side = lambda x: of.select(F.col("node").alias(x), F.col("shared").alias(f"shared_{x}"), F.col("crowds").alias(f"crowds_{x}"))
    pairs = met.where("crowd = 0").groupBy("a", "b").agg(F.sum("n").alias("n")).join(side("a"), "a").join(side("b"), "b")
    often = F.col("n") >= F.greatest("shared_a", "shared_b") - F.least("crowds_a", "crowds_b")
    return stored(pairs.select("a", "b", often.alias("often"))), stored(members.join(of.where("crowds >= shared").select("node"), "node").select("node", "key"), of)


def frequencies(texts: DataFrame) -> np.ndarray:
    """COUNTERS sums: in how many of texts (text) the shingles of each hash class are."""
    spark = texts.sparkSession
    kind = "part int, blob binary"

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(COUNTERS, np.int64)
        for block in common.blocks(batches, BLOCK):
            out += np.bincount(counter_of(shingles(common.raw_texts(block))[0]), minlength=COUNTERS)
        yield from told(out.reshape(-1, COUNTED), range(COUNTERS // COUNTED))

    def told(rows: np.ndarray, parts: Iterable[int]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([r.astype("<i8").tobytes() for r in rows], pa.binary())], ["part", "blob"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(blob, "<i8")
        if sums:
            yield from told(np.array(list(sums.values())), sums)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = np.zeros((COUNTERS // COUNTED, COUNTED), np.int64)
    for part, blob in texts.select("text").mapInArrow(count, kind).repartition(min(tasks, len(out)), "part").mapInArrow(add, kind).collect():  # COUNTERS numbers
        out[part] = np.frombuffer(blob, "<i8")
    return out.ravel()


def counter_of(values: np.ndarray) -> np.ndarray:
    return (mix(values, 31) & np.uint64(COUNTERS - 1)).astype(np.int64)


def rare(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """(node, key) for the rarest shingles of each of texts (node, text), as many as prefix_length() says."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)  # COUNTERS numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, BLOCK):
            values, at = shingles(common.raw_texts(block))
            own = np.repeat(np.arange(len(at) - 1), np.diff(at))
            order = np.lexsort([values, shared.value[counter_of(values)], own])
            few = np.array([prefix_length(n) for n in np.diff(at).tolist()], np.int64)
            chosen = order[np.repeat(at[:-1], few) + np.arange(few.sum()) - np.repeat(common.offsets(few)[:-1], few)]
            node, key = block.column("node").to_numpy()[own[chosen]], values[chosen].view(np.int64)
            for i in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(node[i : i + (1 << 16)]), pa.array(key[i : i + (1 << 16)])], ["node", "key"])

    return texts.select("node", "text").mapInArrow(run, "node long, key long")


def late_candidates(crowded: DataFrame, texts: DataFrame, labels: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of crowded parts (node) that meet by a rare shingle, may link by size and sketch, and are in different components so far."""
    own = stored(texts.join(crowded.select("node").distinct(), "node", "left_semi"))
    met = rare(own, frequencies(own)).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    met = swept(stored(met, own))
    apart = stored(met.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("crowd")).where("x < y").select("key", "crowd"))
    members = swept(stored(met.join(apart, "key"), met, apart))
    few = members.where(F.col("crowd") <= CROWD)
    side = lambda x: few.select("key", F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    pairs = side("a").join(side("b"), "key").where("a < b AND ca <> cb").select("a", "b").distinct()
    return swept(stored(narrowed(pairs, known).union(compared(members.where(F.col("crowd") > CROWD), known, across=True)).select("a", "b").distinct(), members))


def sketches(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Of each set, which of BITS bits an odd number of its shingles toggles."""
    out = []
    for i in range(0, len(at) - 1, SKETCHED):
        ends = at[i : i + SKETCHED + 1]
        own = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        bit = (mix(values[ends[0] : ends[-1]], 21) & np.uint64(BITS - 1)).astype(np.int64)
        odd = (np.bincount(own * BITS + bit, minlength=(len(ends) - 1) * BITS) & 1).astype(np.uint8).reshape(-1, BITS)
        out += [x.tobytes() for x in np.packbits(odd, axis=1)]
    return out


def _bits(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def most_apart(n_a, n_b):
    """The largest symmetric difference of two sets that link."""
    return (n_a + n_b) * (SIMILAR[1] - SIMILAR[0]) // (SIMILAR[1] + SIMILAR[0])


def narrowed(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b, apart): those of pairs (a, b[, often: leave it out if false]) whose sizes and sketches allow a link, with the sketches' distance."""
    pairs = pairs.where("often") if "often" in pairs.columns else pairs
    x = pairs.join(known.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a")), "a")
    x = x.join(known.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b")), "b")
    schema = pa.schema([(n, pa.int64()) for n in ("a", "b", "apart")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                apart = np.bitwise_count(_bits(b.column("sketch_a")) ^ _bits(b.column("sketch_b"))).sum(axis=1, dtype=np.int64)
                good = apart <= most_apart(b.column("n_a").to_numpy(), b.column("n_b").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(v[good]) for v in (b.column("a").to_numpy(), b.column("b").to_numpy(), apart)], schema=schema)

    return x.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long, apart long")


def forest(bits: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int]]:
    """Edges (i, j, distance) of a shortest spanning forest over the pairs that sizes and sketches allow to link."""
    count = len(n)
    far = np.int64(1 << 40)
    best, origin, left = np.full(count, far), np.full(count, -1), np.ones(count, bool)
    out = []
    for _ in range(count):
        i = int(np.where(left, best, far + 1).argmin())
        if best[i] < far:
            out.append((int(origin[i]), i, int(best[i])))
        left[i] = False
        apart = np.bitwise_count(bits ^ bits[i]).sum(axis=1, dtype=np.int64)
        apart[apart > most_apart(n, n[i])] = far
        nearer = left & (apart < best)
        best[nearer], origin[nearer] = apart[nearer], i
    return out


def compared(members: DataFrame, known: DataFrame, across: bool) -> DataFrame:
    """(a, b, apart) from members (node, key, crowd[, component]) of crowded parts.

    Without across: the edges of a forest in each chunk. With it: the pairs of different components that sizes and
    sketches allow, where each set outside the key's largest component meets every chunk of the key.
    """
    chunks = F.ceil(F.col("crowd") / F.lit(float(CHUNK))).cast("int")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    rows = members.withColumn("chunks", chunks).withColumn("chunk", chunk)
    if across:
        sizes = rows.groupBy("key", "component").agg(F.count("*").alias("size"))
        top = stored(sizes.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1"))
        rows = stored(rows.join(top, "key"))
        out = rows.where("component <> top")
        outside = stored(out.groupBy("key").agg(F.count("*").alias("outside")))
        rows, out = (x.join(outside, "key").withColumn("others", F.ceil(F.col("outside") / F.lit(float(CHUNK))).cast("int")) for x in (rows, out))
        rows = rows.select("node", "key", "component", "chunk", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"), F.lit(False).alias("left"))
        out = out.select("node", "key", "component", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("others")).cast("int").alias("other"), F.lit(True).alias("left"))
        rows = rows.unionByName(out)
    else:
        pivot = (F.col("chunks") > 1) & ((F.xxhash64("node", F.lit(2)).cast("double") / F.lit(2.0**64) + 0.5) < F.lit(float(PIVOTS)) / F.col("crowd"))
        places = F.when(pivot, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
        rows = rows.select("node", "key", F.lit(None).cast("long").alias("component"), F.explode(places).alias("chunk"), F.lit(0).alias("other"), F.lit(True).alias("left"))
    rows = rows.join(known, "node").select("key", "chunk", "other", "left", "node", "component", "n", "sketch")
    schema = pa.schema([(n, pa.int64()) for n in ("a", "b", "apart")])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, n, bits = table.column("node").to_numpy(), table.column("n").to_numpy(), _bits(table.column("sketch"))
        found = []
        if across:
            left, component = table.column("left").to_numpy(zero_copy_only=False).astype(bool), table.column("component").to_numpy()
            right = np.flatnonzero(~left)
            for i in np.flatnonzero(left).tolist():
                apart = np.bitwise_count(bits[right] ^ bits[i]).sum(axis=1, dtype=np.int64)
                good = (apart <= most_apart(n[right], n[i])) & (component[right] != component[i])
                found += [(min(node[i], x), max(node[i], x), y) for x, y in zip(node[right[good]].tolist(), apart[good].tolist(), strict=True)]
        else:
            found = [(min(node[i], node[j]), max(node[i], node[j]), x) for i, j, x in forest(bits, n)]
        return pa.Table.from_arrays([pa.array([int(f[k]) for f in found], pa.int64()) for k in range(3)], schema=schema)

    return rows.groupBy("key", "chunk", "other").applyInArrow(run, "a long, b long, apart long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose texts (node, text) link."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")).hint("merge")  # noqa: E731  the same plan at every size
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, BLOCK):
            ids, place = np.unique(np.concatenate([block.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
            own_text = dict(zip(place.tolist(), [t for c in ("text_a", "text_b") for t in common.raw_texts(block, c)], strict=True))
            values, at = shingles([own_text[i] for i in range(len(ids))])  # each text once
            n = block.num_rows
            sizes = np.diff(at)
            shared = [len(np.intersect1d(values[at[i] : at[i + 1]], values[at[j] : at[j + 1]], assume_unique=True)) for i, j in zip(place[:n].tolist(), place[n:].tolist(), strict=True)]
            good = linked(sizes[place[:n]], sizes[place[n:]], np.array(shared, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(block.column(c).to_numpy()[good]) for c in ("a", "b")], schema=schema)

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b): the least node reachable.

    Rounds of hooking each component to the least of its neighbours', then pointer jumping until all point to a root.
    """
    edges = stored(links)
    nodes = stored(edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct().withColumn("component", F.col("node")))
    while True:
        c = lambda x: nodes.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        between = stored(edges.join(c("a"), "a").join(c("b"), "b").where("ca <> cb").select("ca", "cb").distinct())
        if between.isEmpty():
            return nodes
        hooks = between.union(between.select("cb", "ca")).groupBy(F.col("ca").alias("root")).agg(F.min("cb").alias("to")).where("to < root")
        hooks = stored(hooks)
        while True:  # each step doubles the length of the path that is jumped
            on = hooks.select(F.col("root").alias("to"), F.col("to").alias("next"))
            jumped = stored(hooks.join(on, "to", "left").select("root", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            hooks = jumped.select("root", "to")
            if not moved:
                break
        nodes = stored(nodes.join(hooks, nodes["component"] == hooks["root"], "left").select("node", F.coalesce("to", "component").alias("component")))
        edges = between.select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets are in different components so far."""
    of = lambda df, x: df.join(labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
    return of(of(pairs, "a"), "b").where("ca <> cb").select("a", "b")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (and text_hash, by which rows of equal doc_id can be told apart) for each row of docs (doc_id, text).

    Two rows with the same non-empty set link. A null or empty text has no shingles and is linked with nothing: its
    component is its own doc_id. A null doc_id has a null component and links with nothing; repeated rows link with
    each other; other columns are ignored. An empty table gives no rows. Sets are told apart by 64-bit hashes.
    """
    rows = stored(sets_of(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), ["doc_id", "text_hash"], sketch=True))
    first = stored(rows.where(F.col("doc_id").isNotNull() & F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n")))
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = swept(stored(meet(docs.where(F.col("doc_id").isNotNull()), total)))
    pairs, members = sifted(met)
    swept(met)
    crowded = members.join(members.groupBy("key").agg(F.count("*").alias("crowd")), "key")
    may = pairs.where("often")
    used = may.select(F.col("a").alias("node")).union(may.select("b")).union(members.select("node")).distinct()
    wanted = stored(used.join(first, "node").select(F.col("first").alias("doc_id"), "node"))
    sizes = rows.select("doc_id", "node", F.col("n_shingles").alias("n"), "sketch").join(wanted.hint("merge"), ["doc_id", "node"])
    known = swept(stored(sizes.dropDuplicates(["doc_id", "node"]).select("node", "n", "sketch")))

    near = swept(stored(narrowed(pairs, known).union(compared(crowded, known, across=False)).distinct(), met, pairs))
    moved = near.select(F.col("a").alias("node")).union(near.select("b")).union(members.select("node")).distinct()
    wanted = stored(wanted.join(moved, "node").select("doc_id", F.col("node").alias("own")), wanted)
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(wanted.hint("merge"), "doc_id").dropDuplicates(["doc_id", "text_hash"])  # dealt by doc_id already
    texts = swept(stored(sets_of(own, ["text", "own"]).where("node = own").select("node", "text"), wanted))
    closest = F.min_by(F.struct("a", "b"), F.struct("apart", "a", "b")).alias("pair")
    sides = near.select("*", F.explode(F.array("a", "b")).alias("side"))
    nearest = stored(sides.groupBy("side").agg(closest).select("pair.*").distinct())
    found = swept(stored(verified(nearest, texts)))
    labels = components(found)
    rest = stored(between(near.select("a", "b").join(nearest, ["a", "b"], "left_anti"), labels))
    found = swept(stored(found.union(verified(rest, texts))))
    labels = stored(components(found))
    late = late_candidates(members, texts, labels, known).join(nearest.union(rest), ["a", "b"], "left_anti")
    found = swept(stored(found.union(verified(late, texts)), texts, known, members, near, nearest, rest))
    labels = components(found)

    reach = first.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    reach = stored(reach)
    least = stored(reach.groupBy("component").agg(F.min("first").alias("component_id")))
    of_node = stored(reach.join(least, "component").select("node", "component_id"))
    out = rows.join(of_node, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), "text_hash")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their component; of repeated rows one stays.

    Rows of a doc_id count as one document; rows without doc_id all stay.
    """
    (own,) = common.unused(docs.columns, 1)
    rows = stored(join(docs).where(F.col("doc_id").isNotNull()).withColumnRenamed("text_hash", own))
    key = ["doc_id", own]
    others = rows.where(F.col("component_id") < F.col("doc_id")).select(*key).distinct()
    several = rows.where(F.col("component_id") == F.col("doc_id")).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    hashed = docs.withColumn(own, F.xxhash64("text"))
    kept = hashed.join(others.union(several), key, "left_anti").unionByName(hashed.join(several, key, "left_semi").dropDuplicates(key))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: For DuckDB: pairs that share a shingle, and what is reachable by links.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(shingle) AS n_shingles FROM d LEFT JOIN s USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n_shingles + b.n_shingles - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.other = e.x)
SELECT doc_id, any_value(n_shingles)::BIGINT AS n_shingles, min(other) AS component_id FROM r JOIN n USING (doc_id) GROUP BY 1
"""

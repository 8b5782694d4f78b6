"""Operator 2: byte-level BPE encoding and decoding by corpus-level merge replay.

The corpus is cut into words, and the distinct words are counted by one hash aggregate. They stand in one byte
sequence, and an inverted index leads from each token pair to the places where it occurs. Merges are replayed in rank
order over all words at once, and only the two neighbours of a merged place are looked up again. A text's ids are then
those of its words. The index's key is the rank to which pairs lead: pairs that make the same token merge together, as
of two that overlap the left one must win. A word that is itself a token is that token, as in the tiktoken library.

What is broadcast to encode the texts are the ids of the most frequent words, FREQUENT of LONGEST characters at most.
Words beyond them are replayed by the same code where they occur, a block of texts at a time; a worker keeps them from
block to block, up to a limit. Merges never cross words, so the ids are the same on either way, and no text is shuffled.
Memory is bounded by a block, the broadcast words and the limits of common.Words.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.llm import common
from foldlog.llm.store import drop, stored

NONE = 1 << 40
#: Words whose ids are broadcast, at most; characters of such a word at most; distinct words that a task counts at once.
FREQUENT, LONGEST, COUNTED = 200_000, 64, 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines: base64 of a token's bytes, its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """The merges that a table of ranks implies, and their replay."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.width = max(ranks.values()) + 1
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        self.piece_bytes = np.frombuffer(b"".join(t for t, _ in by_rank), np.uint8)
        lengths = np.zeros(self.width, np.int64)
        for t, r in by_rank:
            lengths[r] = len(t)
        self.piece_length, self.piece_start = lengths, common.offsets(lengths)[:-1]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def one(self, word: bytes) -> list[int]:
        """A single word: the leftmost pair of lowest rank merges first."""
        n = len(word)
        ids = [int(self.byte_id[b]) for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.rank_of(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist() if n > 1 else []
        heap = [(r, i) for i, r in enumerate(ranks) if r < NONE]
        heapq.heapify(heap)
        ranks.append(NONE)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or ranks[i] != r:
                continue
            gone = after[i]
            ids[i], ids[gone], after[i] = r, -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for j in (i, before[i]):
                if j >= 0:
                    ranks[j] = self._pair(ids[j], ids[after[j]]) if after[j] < n else NONE
                    if ranks[j] < NONE:
                        heapq.heappush(heap, (ranks[j], j))
        return [x for x in ids if x >= 0]

    def _pair(self, a: int, b: int) -> int:
        at = bisect_left(self.key_list, a * self.width + b)
        return self.value_list[at] if at < len(self.key_list) and self.key_list[at] == a * self.width + b else NONE

    @cached_property
    def key_list(self) -> list[int]:
        return self.keys.tolist()

    @cached_property
    def value_list(self) -> list[int]:
        return self.values.tolist()

    def replay(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, by replaying every merge over all words in rank order."""
        lengths = np.array([len(w) for w in words], np.int64)
        n = int(lengths.sum())
        if not n:
            return [np.zeros(0, np.int64) for _ in words]
        starts = common.offsets(lengths)
        ids = np.append(self.byte_id[np.frombuffer(b"".join(words), np.uint8)], 0)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        ends = starts[1:][lengths > 0]
        after[ends - 1] = n
        before[starts[:-1][lengths > 0]] = n
        rank = np.full(n + 1, NONE)
        inner = np.flatnonzero(after[:n] < n)
        rank[inner] = self.rank_of(ids[inner], ids[inner + 1])
        dead = np.zeros(n + 1, bool)
        odd: list[np.ndarray] = []
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(places: np.ndarray) -> None:
            found = rank[places]
            places, found = places[found < NONE], found[found < NONE]
            if not len(places):
                return
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            heads = found[np.append(0, cuts)].tolist()
            for r, part in zip(heads, np.split(places, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        post(inner)
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            at = at[rank[at] == r]
            if not len(at):
                continue
            touching = after[at[:-1]] == at[1:]
            if touching.any():  # as in aaa: of a run, every other place merges, from the left
                first = np.append(True, ~touching)
                run = np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]
                at = at[run % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            ids[at] = r
            dead[gone] = True
            rank[gone] = NONE
            after[at] = beyond
            before[beyond] = at  # place n only takes what nobody reads
            rank[at] = np.where(beyond < n, self.rank_of(ids[at], ids[beyond]), NONE)
            left = before[at]
            left = left[left < n]
            rank[left] = self.rank_of(ids[left], ids[after[left]])
            touched = np.union1d(at, left)
            late = touched[rank[touched] < r]
            if len(late):
                odd.append(late)
            post(touched)
        alive = np.flatnonzero(~dead[:n])
        word_of = np.searchsorted(starts[1:], alive, side="right")
        counts = np.bincount(word_of, minlength=len(words))
        out = np.split(ids[alive], np.cumsum(counts)[:-1])
        for w in np.unique(np.searchsorted(starts[1:], np.concatenate(odd), side="right")).tolist() if odd else ():
            out[w] = np.array(self.one(words[w]), np.int64)  # a merge made a pair of lower rank: order within the word matters
        return out


class Encoder:
    """Encodes texts by a table of ranks and the pattern that splits them; decodes ids. known: words (as by common.chunks()) with their ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, known: list[tuple[str, bytes]] = ()):
        import regex

        self.merges = Merges(ranks)
        inside = pattern.replace(r"[^\s", f"[^{common.SPACES}")
        self.split = regex.compile(inside.replace(r"\s", f"[{common.SPACES}]").replace(r"\S", f"[^{common.SPACES}]"))
        ids = np.frombuffer(b"".join(x for _, x in known), "<u4").astype(np.uint32)
        self.held = common.Growing(ids, np.array([len(x) // 4 for _, x in known], np.int64))
        self.words = common.Words(self._learn, self.held.clear, known=[w for w, _ in known])

    def ids_of(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct words keys, one after another, and how many each has."""
        pieces = [self.split.findall(common.spelled(k)) for k in keys]
        distinct = list({p for x in pieces for p in x})
        raw = [p.encode() for p in distinct]
        known = [self.merges.ranks.get(w) for w in raw]
        rest = [w for w, k in zip(raw, known, strict=True) if k is None]
        replayed = iter(self.merges.replay(rest))
        ids = [np.array([k]) if k is not None else next(replayed) for k in known]
        lengths = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([*ids, np.zeros(0, np.int64)])
        place = {p: i for i, p in enumerate(distinct)}
        which = np.fromiter((place[p] for x in pieces for p in x), np.int64)
        per_piece = lengths[which]
        per_key = np.diff(common.offsets(per_piece)[common.offsets([len(x) for x in pieces])])
        return common.ragged(flat, common.offsets(lengths)[:-1][which], per_piece), per_key

    def _learn(self, keys: list[str]) -> None:
        self.held.extend(*self.ids_of(keys))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin (with the end)."""
        lists = [common.chunks(t) for t in texts]
        which = self.words.numbers(lists)
        flat, lengths = self.held.arrays
        per = lengths[which]
        ids = common.ragged(flat, common.offsets(lengths)[:-1][which], per)
        return ids, common.offsets(per)[common.offsets([len(x) for x in lists])]

    def decode(self, ids: np.ndarray) -> bytes:
        m = self.merges
        return common.ragged(m.piece_bytes, m.piece_start[ids], m.piece_length[ids]).tobytes()


_kept: dict[object, Encoder] = {}


def encoder_of(key: object, ranks: dict[bytes, int], pattern: str, known: list[tuple[str, bytes]] = ()) -> Encoder:
    """One encoder for a worker process, kept between its tasks."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = Encoder(ranks, pattern, known)
    return _kept[key]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the distinct words of up to LONGEST characters in docs (text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            rows = [(w, n) for w, n in counts.items() if len(w) <= LONGEST]
            for i in range(0, len(rows), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[i : i + (1 << 14)]], t) for j, t in enumerate((pa.string(), pa.int64()))], ["word", "n"])
            counts.clear()

        for block in common.blocks(batches):
            for text in common.texts(block):
                counts.update(common.chunks(text))
            if len(counts) > COUNTED:
                yield from told()
        yield from told()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> list[tuple[str, bytes]]:
    """The most frequent words of docs (FREQUENT at most, all of equal frequency or none) and their ids, replayed in parts of the words."""
    spark = docs.sparkSession
    counts = stored(word_counts(docs).where("n > 1"))
    step = F.floor(F.log2("n") * 64)
    steps = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)  # 64 for each doubling of a count
    least, size = None, 0
    for at, n in steps:
        if size + n > FREQUENT:
            break
        least, size = at, size + n
    if least is None:
        drop(counts)
        return []
    shared, key = spark.sparkContext.broadcast((ranks, pattern)), _key(ranks, pattern)

    def replay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(key, *shared.value)
        for block in common.blocks(batches):
            words = block.column("word").to_pylist()
            ids, n = encoder.ids_of(words)
            raw, at = ids.astype("<u4").tobytes(), (4 * common.offsets(n)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["word", "ids"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = counts.where(step >= least).select("word").repartition(min(tasks, 1 + size // 4096), "word").mapInArrow(replay, "word string, ids binary").collect()  # FREQUENT words at most
    drop(counts)
    return sorted((r["word"], bytes(r["ids"])) for r in found)


def _key(*parts: object) -> str:
    return hashlib.sha256(repr([sorted(p.items()) if isinstance(p, dict) else p for p in parts]).encode()).hexdigest()


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False) -> DataFrame:
    """One row for each row of docs (doc_id, text): n_tokens, ids_sha256, decoded_sha256, and the ids if asked for.

    A null text counts as empty: no ids, digests of nothing. Repeated rows each give their row, a null doc_id is kept,
    other columns are ignored, an empty table gives an empty result. Texts of any length are encoded whole.
    """
    spark = docs.sparkSession
    common.arrow(spark)
    known = frequent(docs, ranks, pattern)
    shared, key = spark.sparkContext.broadcast((ranks, pattern, known)), _key(ranks, pattern, known)  # as large as the vocabulary and FREQUENT words
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(key, *shared.value)
        for block in common.blocks(batches):
            ids, at = encoder.encode(common.texts(block))
            raw, width = ids.astype("<u4").tobytes(), encoder.merges.piece_length
            decoded, ends = encoder.decode(ids), common.offsets(width[ids])[at].tolist()
            at = at.tolist()
            parts = list(zip(at[:-1], at[1:], ends[:-1], ends[1:], strict=True))
            columns = [
                block.column("doc_id").cast(pa.int64()).combine_chunks(),
                pa.array([b - a for a, b, _, _ in parts], pa.int64()),
                pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b, _, _ in parts], pa.string()),
                pa.array([hashlib.sha256(decoded[c:d]).hexdigest() for _, _, c, d in parts], pa.string()),
            ]
            if with_ids:
                columns.append(pa.array([ids[a:b].astype(np.int64) for a, b, _, _ in parts], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encode_documents(common.table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)

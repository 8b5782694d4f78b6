"""Operator 3: scores of texts by a causal self-attention model over subword ids.

The model is one attention layer with learned distance biases and a residual, trained in numpy by Adagrad. Its output
is a binary tree over the ids: the root tells ids that begin a word from those that continue one, and below it stand
two Huffman trees from the ids' frequencies. The probability of an id is the product of the decisions on its path.
Untrained, the decisions' biases give the ids' frequencies; training adds what context tells. The probability of a word
is that of its ids and of the word's end after them (the next root's decision), mixed with the word's share among all
training tokens. The weight of the share is the one of MIXED by which all training texts are likeliest, each word
counted without its own occurrence; 0 leaves attention alone.
Texts are scored in windows of 2 * STEP inputs that overlap by half: each window scores its last STEP tokens once, under
a causal mask that also ends at the text's start, for many windows at a time.

A text is scored as its words (A-Z lower-cased), each with one space before it, and an end. Ids are those of a public
tokenizer, looked up once for each distinct word of a worker.

Base scores need the count of every word in all training texts. Blocks of texts send their distinct words (64-bit
hashes) with counts to buckets of the hash space; buckets add the counts up and send them back to the blocks in the
order in which they came, which meet them with the words and attention scores that each block kept. Frequent words are
summed in their block before anything is sent, so no bucket and no block is larger for them. Counts, tokens, scores and training cover
everything: the trees come from the subwords of all training texts, and every window of them is learned from, by one
trainer for each core, whose models are averaged in rounds. Scores depend a little on how texts fall to the trainers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.llm import common
from foldlog.llm.store import stored, swept

WIDTH, STEP = 16, 16
BATCH, RATE = 128, 0.08
#: Windows that training visits in all, at least about so many; passes over all texts at most; rounds, after each of which models are averaged, at least.
VISITS, EPOCHS, ROUNDS = 300_000, 8, 4
#: Parts of the model of which few rows change at a time, and others; rows that are averaged together.
SPARSE, DENSE, PIECE = ("e", "n"), ("q", "k", "v", "u", "d"), 256
#: Windows that are worked on at once; nodes of the tree, those that most decisions meet, whose products are taken as one matrix.
AT_ONCE, TOP = 256, 128
#: Bytes of text in a block; words that a worker knows at once, and their bytes.
BLOCK, KNOWN, KNOWN_BYTES = 4 << 20, 600_000, 32 << 20
#: Buckets of the hash space for each shuffle partition.
SPREAD = 4
#: Tokens for each task that adds up counts, about.
TOKENS = 8_000_000
#: Weights of the training share of a word against the attention model's probability, of which training texts choose one.
MIXED = (0.0, 0.1, 0.2, 0.35, 0.6)
#: Steps of a stored log10 probability to 1; what 16 bits can't hold is stored apart.
FINE = 2048


# --- output tree ---------------------------------------------------------------------------------------------------


class Tree:
    """For each id the inner nodes on its path and the signs of the decisions there, flattened; the root is the last of each path.

    top are the nodes with the largest counts below them. A node's count is above those of the nodes under it, so the first
    below[id] nodes of a path aren't in top, and all others are. Of those, slots has the places in top for each id, the root's
    first, and turns the signs; rows are filled up with the place after top, that of a decision which is certain (over()).
    """

    def __init__(self, counts: np.ndarray, begins: np.ndarray):
        n = len(counts)
        mass, whole, kids, made = [0.0] * (n - 1), np.zeros(n - 1), np.zeros((n - 1, 2), np.int64), 0

        def join(x: tuple[float, int], y: tuple[float, int]) -> tuple[float, int]:
            nonlocal made
            mass[made], whole[made], kids[made] = y[0] / (x[0] + y[0]), x[0] + y[0], (x[1], y[1])
            made += 1
            return x[0] + y[0], n + made - 1

        tops = []
        for side in (np.flatnonzero(~begins), np.flatnonzero(begins)):
            heap = [(float(counts[i]), i) for i in side.tolist()]
            heapq.heapify(heap)
            while len(heap) > 1:
                x = heapq.heappop(heap)
                heapq.heapreplace(heap, join(x, heap[0]))
            tops += heap
        join(*tops)
        parent, sign = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.float32)
        for side, one in ((0, -1.0), (1, 1.0)):
            parent[kids[:, side]] = np.arange(n - 1)
            sign[kids[:, side]] = one
        paths, signs = [], []
        for i in range(n):
            p, q, at = [], [], i
            while at != 2 * n - 2:
                p.append(parent[at])
                q.append(sign[at])
                at = n + parent[at]
            paths.append(p)
            signs.append(q)
        m = np.array(mass)
        bias = np.log(m / (1 - m)).astype(np.float32)
        top = np.lexsort([-np.arange(n - 1), -whole])[:TOP]  # of equal counts the node that was made later, which may be above the other
        self.__setstate__((np.array([len(p) for p in paths], np.int32), np.concatenate([np.array(p, np.int32) for p in paths]), np.concatenate([np.array(q, np.int8) for q in signs]), bias, top))

    def __getstate__(self) -> tuple:
        """What the rest follows from, narrow: a tree is sent to all executors with each round's model, and lies on their disks."""
        return self.length.astype(np.int32), self.node.astype(np.int32), self.sign.astype(np.int8), self.bias, self.top

    def __setstate__(self, state: tuple) -> None:
        length, node, sign, self.bias, self.top = state
        n = len(length)
        self.length, self.node, self.sign = length.astype(np.int64), node.astype(np.int64), sign.astype(np.float32)
        self.start = common.offsets(self.length)[:-1]
        slot = np.full(n - 1, -1)
        slot[self.top] = np.arange(len(self.top))
        slot = slot[self.node]
        self.below = np.add.reduceat(slot < 0, self.start, dtype=np.int64)
        self.above = self.length - self.below
        most = int(self.above.max())
        self.slots, self.turns = np.full((n, most), len(self.top), np.int32), np.ones((n, most), np.float32)
        path = np.flatnonzero(slot >= 0)
        who = np.repeat(np.arange(n), self.length)[path]
        at = self.start[who] + self.length[who] - 1 - path
        self.slots[who, at], self.turns[who, at] = slot[path], self.sign[path]

    def over(self, nodes: np.ndarray) -> np.ndarray:
        """The rows of top among those of nodes (weights, and the bias last), and one of a decision that is certain."""
        return np.vstack([nodes[self.top], np.append(np.zeros(nodes.shape[1] - 1), 30)[None]]).astype(np.float32)

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the products of the decisions of each id in top stand in a flat matrix of those of all in over(), and their signs."""
        return self.slots.take(ids, axis=0) + (np.arange(len(ids)) * (len(self.top) + 1))[:, None], self.turns.take(ids, axis=0)

    def under(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in node and sign of what is below top on the ids' paths, one after another; which ids have any; and where each of these begins."""
        below = self.below[ids]
        who = np.flatnonzero(below)
        n = below[who]
        at = common.offsets(n)
        return np.arange(at[-1]) + np.repeat(self.start[ids[who]] - at[:-1], n), who, at

    def met(self, times: np.ndarray) -> np.ndarray:
        """How many decisions each node took, by how often each id was met."""
        return np.bincount(self.node, np.repeat(times, self.length), len(self.bias))


# --- windows -------------------------------------------------------------------------------------------------------


def window_places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of n tokens each (at: offsets) in a sequence that has a start before each: places of the inputs of each window
    (its first, of 2 * STEP), the start's place of its text, and how many tokens it scores."""
    n = np.diff(at)
    windows = -(-n // STEP)
    own = np.repeat(np.arange(len(n)), windows)
    number = np.arange(len(own)) - np.repeat(common.offsets(windows)[:-1], windows)
    start = at[:-1] + np.arange(len(n))  # starts push the tokens back by one each
    return start[own] + number * STEP - STEP, start[own], np.minimum(n[own] - number * STEP, STEP)


# --- model ---------------------------------------------------------------------------------------------------------


def new_model(counts: np.ndarray, begins: np.ndarray, seed: int = 3) -> dict:
    rng = np.random.default_rng(seed)
    v, f = len(counts), lambda *shape: rng.normal(0, 0.3 / math.sqrt(WIDTH), shape).astype(np.float32)
    tree = Tree(counts, begins)
    nodes = np.column_stack([np.zeros((v - 1, WIDTH), np.float32), tree.bias])  # weights and the bias
    return {"tree": tree, "e": f(v, WIDTH) * 3, "q": f(WIDTH, WIDTH), "k": f(WIDTH, WIDTH), "v": f(WIDTH, WIDTH), "u": np.eye(WIDTH, dtype=np.float32), "d": np.zeros(2 * STEP, np.float32), "n": nodes}


_later = np.arange(STEP)[:, None] + STEP - np.arange(2 * STEP)[None]  # distance of each input from each query
_ones = np.ones(2 * STEP, np.float32)  # sums of short rows are faster as products


def attend(q: np.ndarray, k: np.ndarray, v: np.ndarray, d: np.ndarray, first: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masked attention of the last STEP inputs of windows (q, by 1 / sqrt(WIDTH)) on all of theirs: weights and results."""
    s = np.matmul(q, k.transpose(0, 2, 1))
    s += np.where(_later >= 0, d[np.maximum(_later, 0)], np.float32(-1e9))
    before = np.flatnonzero(first < start)
    s[before] += np.where(first[before, None] + np.arange(2 * STEP) < start[before, None], np.float32(-1e9), np.float32(0))[:, None]
    np.exp(np.minimum(s, 60, out=s), out=s)  # scores are small: exp needs no shift
    s /= (s.reshape(-1, 2 * STEP) @ _ones).reshape(len(s), STEP, 1)
    return s, np.matmul(s, v)


def summed(place: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places, ascending, and the sums of their rows."""
    key = np.sort(place.astype(np.int64) << 32 | np.arange(len(place)))  # faster than an order of the places
    own = key >> 32
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
    return own[first], np.add.reduceat(rows.take(key & 0xFFFFFFFF, axis=0), first, axis=0)


class Trainer:
    """Adagrad over the windows of one block after another.

    visits counts what each row of a sparse part met, and the windows for a dense part: the weights of a mean of several trainers.
    """

    def __init__(self, model: dict):
        self.model = {x: model[x].copy() for x in (*SPARSE, *DENSE)}
        self.past = {x: model["past"][x].copy() for x in self.model}
        self.tree, self.loss, self.total = model["tree"], 0.0, 0
        self.visits = {x: np.zeros(len(self.model[x]) if x in SPARSE else 1) for x in self.model}

    def _dense(self, x: str, g: np.ndarray) -> None:
        self.past[x] += g * g
        self.model[x] -= RATE * g / np.sqrt(self.past[x])

    def _rows(self, x: str, rows: np.ndarray, g: np.ndarray) -> None:
        past = self.past[x].take(rows, axis=0)
        past += g * g
        self.past[x][rows] = past
        self.model[x][rows] = self.model[x].take(rows, axis=0) - RATE * g / np.sqrt(past)

    def _sparse(self, x: str, rows: np.ndarray, g: np.ndarray) -> None:
        self._rows(x, *summed(rows, g))

    def _met(self, sequences: np.ndarray, first: np.ndarray, n: np.ndarray) -> None:
        """Counts what the windows meet."""
        inputs, targets = (np.zeros(len(self.model["e"]), np.int64) for _ in range(2))
        for i in range(0, len(first), 1 << 13):
            f = first[i : i + (1 << 13), None]
            inputs += np.bincount(sequences[np.clip(f + np.arange(2 * STEP), 0, len(sequences) - 1)].ravel(), minlength=len(inputs))
            target = (f + STEP + 1 + np.arange(STEP))[np.arange(STEP) < n[i : i + (1 << 13), None]]
            targets += np.bincount(sequences[target], minlength=len(targets))
        self.visits["e"] += inputs
        self.visits["n"] += self.tree.met(targets)
        for x in DENSE:
            self.visits[x] += len(first)

    def visit(self, sequences: np.ndarray, first: np.ndarray, start: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> None:
        """Each window once, in random order."""
        model, tree, scale = self.model, self.tree, np.float32(1 / math.sqrt(WIDTH))
        self._met(sequences, first, n)
        for chosen in np.array_split(rng.permutation(len(first)), max(1, len(first) // BATCH)):
            f, s0, m = first[chosen], start[chosen], n[chosen]
            place = np.clip(f[:, None] + np.arange(2 * STEP), 0, len(sequences) - 1)
            ids = sequences[place]
            x = model["e"].take(ids.ravel(), axis=0)
            xq = x.reshape(-1, 2 * STEP, WIDTH)[:, STEP:].reshape(-1, WIDTH)
            of_all, of_late = np.hstack([model["k"], model["v"]]), np.hstack([model["q"] * scale, model["u"]])
            windows = lambda t, rows: t.reshape(-1, rows, t.shape[1])
            kv, qu = windows(x @ of_all, 2 * STEP), windows(xq @ of_late, STEP)
            k, v, q = kv[:, :, :WIDTH], kv[:, :, WIDTH:], qu[:, :, :WIDTH]
            a, out = attend(q, k, v, model["d"], f, s0)
            live = np.flatnonzero(np.arange(STEP) < m[:, None])
            target = sequences[np.minimum(place[:, STEP:] + 1, len(sequences) - 1).ravel()[live]]
            hidden = np.ones((len(target), WIDTH + 1), np.float32)
            hidden[:, :WIDTH] = (qu[:, :, WIDTH:] + out).reshape(-1, WIDTH)[live]
            top = tree.over(model["n"])
            g = hidden @ top.T
            at, turn = tree.places(target)
            z = g.take(at)
            z *= turn
            odds = np.exp(np.minimum(z, 60, out=z))  # beyond, a decision has no gradient to speak of
            odds += 1
            self.loss += float(np.log(odds).sum()) - float(z.sum())
            g[:] = 0
            g.reshape(-1)[at] = np.divide(turn, odds, out=turn)  # the gradient with its sign turned
            gh, g_top = g @ top, g.T @ hidden
            path, who, at = tree.under(target)
            if len(path):
                node, sign = tree.node[path], tree.sign[path]
                w, seen = model["n"].take(node, axis=0), hidden.take(np.repeat(who, np.diff(at)), axis=0)
                z = np.exp(np.clip(sign * np.einsum("ij,ij->i", w, seen), -60, 60))
                self.loss += float(np.log(1 + 1 / z).sum())
                g = (sign / (1 + z))[:, None]
                w *= g
                seen *= g
                gh[who] += np.add.reduceat(w, at[:-1], axis=0)
                self._sparse("n", node, -seen)
            self._rows("n", tree.top, -g_top[:-1])
            self.total += len(target)
            back = np.zeros((len(xq), 2 * WIDTH), np.float32)  # of q and of what comes out
            back[live, WIDTH:] = -gh[:, :WIDTH]
            gq, by = windows(back, STEP)[:, :, :WIDTH], windows(back, STEP)[:, :, WIDTH:]
            gkv = np.empty_like(kv)
            gs = np.matmul(by, v.transpose(0, 2, 1))
            gs -= np.einsum("ijk,ijk->ij", by, out)[:, :, None]
            gs *= a
            np.matmul(gs, k, out=gq)
            np.matmul(gs.transpose(0, 2, 1), q, out=gkv[:, :, :WIDTH])
            np.matmul(a.transpose(0, 2, 1), by, out=gkv[:, :, WIDTH:])
            gkv = gkv.reshape(-1, 2 * WIDTH)
            gx = gkv @ of_all.T
            gx.reshape(-1, 2 * STEP, WIDTH)[:, STEP:] += windows(back @ of_late.T, STEP)
            by_distance = np.bincount(np.maximum(_later, 0).ravel(), (np.ones(len(gs), np.float32) @ gs.reshape(len(gs), -1)) * (_later >= 0).ravel(), 2 * STEP).astype(np.float32)
            all_steps, late_steps = x.T @ gkv, xq.T @ back
            steps = {"u": late_steps[:, WIDTH:], "q": late_steps[:, :WIDTH] * scale, "k": all_steps[:, :WIDTH], "v": all_steps[:, WIDTH:], "d": by_distance}
            self._sparse("e", ids.ravel(), gx)
            for name, step in steps.items():
                self._dense(name, step)


class Scorer:
    """Log probabilities of token sequences; what an id gives to attention is looked up, not computed again."""

    def __init__(self, model: dict):
        self.tree, e = model["tree"], model["e"]
        self.q, self.u = e @ model["q"] * np.float32(1 / math.sqrt(WIDTH)), e @ model["u"]
        self.kv = np.concatenate([e @ model["k"], e @ model["v"]], axis=1)
        self.n, self.d = model["n"].astype(np.float32), model["d"]
        self.top = self.tree.over(self.n).T.copy()
        self.mask = np.where(_later >= 0, self.d[np.maximum(_later, 0)], np.float32(-1e9)).astype(np.float32)
        self.columns = np.arange(2 * STEP)

    @staticmethod
    def _soft(z: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Natural log probabilities of decisions from their products."""
        z *= -sign
        np.exp(np.minimum(z, 60, out=z), out=z)
        z += 1
        return np.negative(np.log(z, out=z), out=z)

    def tokens(self, sequence: np.ndarray, first: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of each scored token, and of the root's decision alone, in order of windows."""
        out, roots = [], []
        for i in range(0, len(first), AT_ONCE):
            f, s0, m = first[i : i + AT_ONCE], start[i : i + AT_ONCE], n[i : i + AT_ONCE]
            place = np.clip(f[:, None] + self.columns, 0, len(sequence) - 1)
            ids = sequence[place]
            late = ids[:, STEP:]
            kv = self.kv.take(ids, axis=0)
            s = np.matmul(self.q.take(late, axis=0), kv[:, :, :WIDTH].transpose(0, 2, 1))
            s += self.mask
            if (f < s0).any():
                s += np.where(f[:, None] + self.columns < s0[:, None], np.float32(-1e9), np.float32(0))[:, None]
            np.exp(np.minimum(s, 60, out=s), out=s)  # scores are small: exp needs no shift
            h = np.matmul(s, kv[:, :, WIDTH:])
            h /= (s.reshape(-1, 2 * STEP) @ _ones).reshape(len(s), STEP, 1)
            h += self.u.take(late, axis=0)
            live = np.flatnonzero(np.arange(STEP) < m[:, None])
            target = sequence[np.minimum(place[:, STEP:] + 1, len(sequence) - 1).ravel()[live]]
            hidden = np.ones((len(target), WIDTH + 1), np.float32)
            hidden[:, :WIDTH] = h.reshape(-1, WIDTH)[live]
            at, turn = self.tree.places(target)
            soft = self._soft((hidden @ self.top).take(at), turn)
            found, root = soft @ np.ones(soft.shape[1], np.float32), soft[:, 0].copy()
            path, who, at = self.tree.under(target)
            if len(path):
                seen = hidden.take(np.repeat(who, np.diff(at)), axis=0)
                found[who] += np.add.reduceat(self._soft(np.einsum("ij,ij->i", self.n.take(self.tree.node[path], axis=0), seen), self.tree.sign[path]), at[:-1])
            out.append(found)
            roots.append(root)
        return np.concatenate(out) if out else np.zeros(0), np.concatenate(roots) if roots else np.zeros(0)

    def words(self, ids: np.ndarray, at: np.ndarray, begin: np.ndarray, end: int) -> np.ndarray:
        """Natural log probability of each word (from ids[begin[i]] on) and end of texts (ids[at[i] : at[i + 1]], each closing with end).

        end also stands before a text's start. That a word begins is certain where one does, so the root's decision
        counts for the word before: it ends there.
        """
        first, start, n = window_places(at)
        found, root = self.tokens(np.insert(ids, at[:-1], end), first, start, n)
        found[begin] -= root[begin]
        out = np.add.reduceat(found, begin) if len(begin) else found
        follows = np.append(root[begin[1:]], np.float32(0)) if len(begin) else root
        follows[ids[begin] == end] = 0
        return out + follows


# --- words and subwords --------------------------------------------------------------------------------------------


class Spelled(dict):
    """Bytes of the ids of words, found at first sight."""

    def __init__(self, subwords: Subwords):
        self.subwords, self.bytes = subwords, 0

    def __missing__(self, word: bytes) -> bytes:
        out = self[word] = np.array(self.subwords.ids(word), np.int32).tobytes()
        self.bytes += len(word) + len(out)
        return out

    def sequence(self, lists: list[list[bytes]], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each after an end and closing with one, and the offsets of texts without the first."""
        if len(self) > KNOWN or self.bytes > KNOWN_BYTES:
            self.clear()
            self.bytes = 0
        mark = np.int32(end).tobytes()
        texts = [b"".join([mark, *map(self.__getitem__, x), mark]) for x in lists]
        return np.frombuffer(b"".join(texts), np.int32), common.offsets([len(t) // 4 - 1 for t in texts])


class Subwords:
    """For distinct words: their ids (with a space before) and 64-bit hashes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.engine = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.spelled = Spelled(self)
        self.held = common.Growing(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint64))
        self.words = common.Words(self._learn, self.held.clear, KNOWN)

    def ids(self, word: bytes) -> list[int]:
        return self.engine.encode_ordinary(" " + word.decode())

    def _learn(self, words: list[bytes]) -> None:
        ids = [self.ids(w) for w in words]
        self.held.extend([x for i in ids for x in i], [len(i) for i in ids], [xxhash.xxh3_64_intdigest(w) for w in words])

    def of(self, lists: list[list[bytes]], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts with their ends, their offsets, where each word or end begins, the number of each word, and the hashes of all numbers."""
        which = self.words.numbers(lists)
        flat, n, hashes = self.held.arrays
        per = n[which]
        ids = common.ragged(flat, common.offsets(n)[:-1][which], per)
        ends = common.offsets(per)[common.offsets([len(x) for x in lists])[1:]]
        at = np.append(0, ends + np.arange(1, len(lists) + 1))
        words = common.offsets([len(x) for x in lists])
        begin = np.insert(common.offsets(per)[:-1] + np.repeat(np.arange(len(lists)), np.diff(words)), words[1:], at[1:] - 1)
        return np.insert(ids, ends, end), at, begin, which, hashes


def begins_word(ranks: dict[bytes, int]) -> np.ndarray:
    """Which ids begin a word or are the end."""
    out = np.zeros(max(ranks.values()) + 2, bool)
    out[[r for t, r in ranks.items() if t[:1] == b" "]] = True
    out[-1] = True
    return out


_kept: dict[object, Subwords] = {}


def _subwords(ranks: dict[bytes, int], pattern: str) -> Subwords:
    key = (len(ranks), pattern)
    if key not in _kept:
        _kept[key] = Subwords(ranks, pattern)
    return _kept[key]


def _words(block: pa.Table) -> list[list[bytes]]:
    return [t.lower().split() for t in common.raw_texts(block)]


def _sequences(batches: Iterable[pa.RecordBatch], ranks: dict[bytes, int], pattern: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block of texts: their ids, with the end before each text and after the last, and the texts' offsets."""
    subwords, end = _subwords(ranks, pattern), max(ranks.values()) + 1
    for block in common.blocks(batches, BLOCK):
        yield subwords.spelled.sequence(_words(block), end)


def _subword_counts(docs: DataFrame, shared: Broadcast, v: int) -> tuple[np.ndarray, int]:
    """How often each id stands in the texts and their ends, and how many windows they have."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(v + 1, np.int64)  # the last are the windows
        for sequence, at in _sequences(batches, *shared.value):
            counts[:v] += np.bincount(sequence, minlength=v)
            counts[v - 1] -= len(at) - 1  # the ends before texts are given, not learned
            counts[v] += int((-(-np.diff(at) // STEP)).sum())
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["id", "n"])

    rows = docs.select("text").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row for each id
    counts = np.zeros(v + 1, np.int64)
    counts[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return counts[:v], int(counts[v])


def _pieces(model: dict) -> list[tuple[str, int, int]]:
    """Parts of the model that are averaged one by one: name, first row and the row after the last."""
    return [(x, a, min(a + PIECE, len(model[x]))) for x in SPARSE for a in range(0, len(model[x]), PIECE)] + [(x, 0, len(model[x])) for x in DENSE]


def _round(docs: DataFrame, model: dict, words: Broadcast, number: int, seed: int) -> dict:
    """The mean of models that learned from docs (text), one for each core; each row is weighted by what its trainer met of it."""
    spark = docs.sparkSession
    shared, pieces = spark.sparkContext.broadcast(model), _pieces(model)
    shards = max(1, spark.sparkContext.defaultParallelism)
    own = "piece int, shard int, blob binary"
    kinds = pa.schema([("piece", pa.int32()), ("shard", pa.int32()), ("blob", pa.binary())])
    flat = lambda x: x.reshape(len(x), -1)

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, shard = Trainer(shared.value), TaskContext.get().partitionId()
        for i, (sequence, at) in enumerate(_sequences(batches, *words.value)):
            trainer.visit(sequence, *window_places(at), np.random.default_rng((seed, number, shard, i)))
        if not trainer.total:
            return
        for i, (x, a, b) in enumerate(pieces):
            met = trainer.visits[x][a:b] if x in SPARSE else np.repeat(trainer.visits[x], b - a)
            rows = np.flatnonzero(met)
            both = np.column_stack([flat(trainer.model[x])[a:b][rows], flat(trainer.past[x])[a:b][rows]])
            blob = rows.astype("<u4").tobytes() + met[rows].astype("<f4").tobytes() + both.astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([shard], pa.int32()), pa.array([blob], pa.binary())], schema=kinds)
        told = np.array([trainer.loss, trainer.total], "<f8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([shard], pa.int32()), pa.array([told], pa.binary())], schema=kinds)

    def mean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by piece and shard; what is held is one piece."""
        at, total, weight = None, None, None

        def done() -> pa.RecordBatch:
            rows = np.flatnonzero(weight)
            blob = rows.astype("<u4").tobytes() + (total[rows] / weight[rows, None]).astype("<f4").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([0], pa.int32()), pa.array([blob], pa.binary())], schema=kinds)

        for batch in batches:
            for piece, blob in zip(batch.column("piece").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if piece == -1:
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([blob], pa.binary())], schema=kinds)
                    continue
                x, a, b = pieces[piece]
                width = 2 * flat(shared.value[x]).shape[1]
                if piece != at:
                    if at is not None:
                        yield done()
                    at, total, weight = piece, np.zeros((b - a, width)), np.zeros(b - a)
                n = len(blob) // (8 + 4 * width)
                rows, met = np.frombuffer(blob, "<u4", n), np.frombuffer(blob, "<f4", n, 4 * n)
                total[rows] += np.frombuffer(blob, "<f4", n * width, 8 * n).reshape(n, width) * met[:, None].astype(np.float64)
                weight[rows] += met
        if at is not None:
            yield done()

    parts = docs.select("text").coalesce(shards).mapInArrow(learn, own)
    out = parts.repartition(shards, "piece").sortWithinPartitions("piece", "shard").mapInArrow(mean, own).collect()  # as large as the model
    model = model | {x: model[x].copy() for x in (*SPARSE, *DENSE)} | {"past": {x: y.copy() for x, y in model["past"].items()}}
    for piece, _, blob in out:
        if piece == -1:
            continue
        x, a, _ = pieces[piece]
        k = flat(model[x]).shape[1]
        n = len(blob) // (4 + 8 * k)
        rows, new = a + np.frombuffer(blob, "<u4", n), np.frombuffer(blob, "<f4", 2 * n * k, 4 * n).reshape(n, 2 * k)
        model[x][rows] = new[:, :k].reshape(n, *model[x].shape[1:])
        model["past"][x][rows] = new[:, k:].reshape(n, *model[x].shape[1:])
    told = np.array([np.frombuffer(blob, "<f8") for piece, _, blob in out if piece == -1]).reshape(-1, 2).sum(axis=0)
    shared.destroy()
    return model | {"loss": float(told[0] / max(told[1], 1)), "visited": model.get("visited", 0) + int(told[1])}


def fit(docs: DataFrame, ranks: dict[bytes, int], pattern: str, seed: int = 3) -> dict:
    """A model trained on all tokens of docs (doc_id, text), with the frequencies of all of them.

    Texts are dealt to rounds by their hash; a pass takes every window of every text once. Small tables are passed over
    several times (VISITS). visited is the number of tokens that training met in all its passes.
    """
    spark, end = docs.sparkSession, max(ranks.values()) + 1
    common.arrow(spark)
    shared = spark.sparkContext.broadcast((ranks, pattern))
    counts, windows = _subword_counts(docs, shared, end + 1)
    model = new_model(counts + 0.02, begins_word(ranks), seed)
    model["past"] = {x: np.full_like(model[x], 1e-3) for x in (*SPARSE, *DENSE)}
    if windows:
        passes = min(EPOCHS, max(1, round(VISITS / windows)))
        parts = -(-ROUNDS // passes)
        for i in range(passes * parts):
            own = docs if parts == 1 else docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(parts)) == i % parts)
            model = _round(own, model, shared, i, seed)
    del model["past"]
    return model | {"tokens": int(counts.sum())}


# --- base counts ---------------------------------------------------------------------------------------------------


def planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones, and so on: alike bytes stand together and take little once compressed."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplaned(blob: bytes, kind: str, n: int, at: int = 0) -> np.ndarray:
    """n numbers from planes() that begin at a place of blob."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, width * n, at).reshape(width, n).T).view(kind).ravel()


def squeezed(blob: bytes) -> bytes:
    return len(blob).to_bytes(8, "little") + pa.compress(blob, "zstd", asbytes=True)


def loosened(blob: bytes) -> bytes:
    return pa.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)


def packed(place: np.ndarray, found: np.ndarray) -> bytes:
    """Places of texts' words and the log10 probabilities of their words and ends: by bytes, in steps of 1 / FINE, then those below the range whole."""
    steps = np.rint(found * -FINE)
    far = np.flatnonzero((steps > 65534) | (steps < 0))
    steps[far] = 65535
    return planes(place.astype("<u4")) + planes(steps.astype("<u2")) + far.astype("<u4").tobytes() + found[far].astype("<f4").tobytes()


def unpacked(blob: bytes, words: int, texts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    place, found = unplaned(blob, "<u4", words), unplaned(blob, "<u2", words + texts, 4 * words) / -float(FINE)
    at = 6 * words + 2 * texts
    n = (len(blob) - at) // 8
    found[np.frombuffer(blob, "<u4", n, at)] = np.frombuffer(blob, "<f4", n, at + 4 * n)
    return place, found


def mixtures(share: np.ndarray, attention: np.ndarray, p: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Sums, for each text, of the logarithms of both probabilities' mixtures, by MIXED; attention is given as natural logarithms, and p as it is.

    at are the offsets of texts, each of which has a token at least.
    """
    small = np.flatnonzero(p < 1e-290)  # for these the sum is built from logarithms
    out = []
    for w in MIXED:
        if w:
            logs = w * share
            logs += (1 - w) * p
            logs[small] = 1
            np.log(logs, out=logs)
            if len(small):
                with np.errstate(divide="ignore"):
                    logs[small] = np.logaddexp(np.log(w * share[small]), math.log1p(-w) + attention[small])
        else:
            logs = attention
        out.append(np.add.reduceat(logs, at[:-1]))
    return out


def scored(docs: DataFrame, model: dict, ranks: dict[bytes, int], pattern: str, training: str, buckets: int) -> DataFrame:
    """Rows of two kinds. For each block of docs: block; doc_id, training and n_tokens of its texts; learned_tokens and learned_texts, sums over
    those that are training; blob: squeezed() and packed() places of all words among the block's (frequent ones first), and log10
    probabilities by attention; dealt: the block's words' buckets, squeezed() as well. For each block and bucket: block, bucket and
    part: hashes and training counts of those words, in order of their places, which dealt tells: so places aren't sent.

    training names a boolean column of docs.
    """
    spark, end = docs.sparkSession, max(ranks.values()) + 1
    common.arrow(spark)
    shared = spark.sparkContext.broadcast((ranks, pattern, model))  # as large as the vocabulary
    held: list[Scorer] = []
    kinds = [("block", pa.int64()), ("bucket", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("training", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64()))]
    schema = pa.schema([*kinds, ("learned_tokens", pa.int64()), ("learned_texts", pa.int64()), ("blob", pa.binary()), ("dealt", pa.binary()), ("part", pa.binary())])

    def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, pattern, model = shared.value
        if not held:
            held.append(Scorer(model))
        subwords, part = _subwords(ranks, pattern), TaskContext.get().partitionId()
        for number, block in enumerate(common.blocks(batches, BLOCK)):
            lists = _words(block)
            ids, at, begin, which, hashes = subwords.of(lists, end)
            found = held[0].words(ids, at, begin, end) / math.log(10)
            lengths = np.array([len(x) for x in lists], np.int64)
            learn = block.column("learn").to_numpy(zero_copy_only=False).astype(bool)
            times = np.bincount(which, minlength=len(hashes))
            numbers = np.flatnonzero(times)
            numbers = numbers[np.argsort(-times[numbers], kind="stable")]
            rank = np.empty(len(hashes), np.int64)
            rank[numbers] = np.arange(len(numbers))
            place, hashes = rank[which], hashes[numbers]
            trained = np.bincount(place, np.repeat(learn, lengths), len(numbers)).astype("<u4")
            bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype("<u4")
            key, one = pa.array([part << 32 | number], pa.int64()), lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield rows(
                1,
                block=key,
                doc_id=one(block.column("doc_id").cast(pa.int64()).combine_chunks()),
                training=one(pa.array(learn)),
                n_tokens=one(pa.array(lengths + 1)),
                learned_tokens=pa.array([int((lengths[learn] + 1).sum())], pa.int64()),
                learned_texts=pa.array([int(learn.sum())], pa.int64()),
                blob=pa.array([squeezed(packed(place, found))], pa.binary()),
                dealt=pa.array([squeezed(planes(bucket))], pa.binary()),
            )
            order = np.argsort(bucket, kind="stable")
            hashes, trained = hashes[order], trained[order]
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            some = [(b, x, y) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
            n = len(some)
            yield rows(
                n,
                block=pa.array(key.to_pylist() * n, pa.int64()),
                bucket=pa.array([b for b, *_ in some], pa.int32()),
                part=pa.array([hashes[x:y].astype("<u8").tobytes() + planes(trained[x:y]) for _, x, y in some], pa.binary()),
            )

    own = "block long, bucket int, doc_id array<long>, training array<boolean>, n_tokens array<long>, learned_tokens long, learned_texts long, blob binary, dealt binary, part binary"
    return docs.select("doc_id", "text", F.col(training).alias("learn")).mapInArrow(run, own)


def totals(parts: DataFrame, tasks: int) -> DataFrame:
    """From the blocks' parts of buckets: block, bucket, blob (counts of its words over all blocks, in their order), and n_distinct in a row without block for each bucket."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n_distinct", pa.int64()), ("blob", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple[int, bytes]]] = {}
        for b in batches:
            for bucket, block, blob in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), b.column("part").to_pylist(), strict=True):
                by.setdefault(bucket, []).append((block, blob))
        for bucket in sorted(by):
            own = by.pop(bucket)
            sizes = [len(x) // 12 for _, x in own]
            hashes = np.concatenate([np.frombuffer(x, "<u8", n) for (_, x), n in zip(own, sizes, strict=True)])
            trained = np.concatenate([unplaned(x, "<u4", n, 8 * n) for (_, x), n in zip(own, sizes, strict=True)])
            _, place = np.unique(hashes, return_inverse=True)
            count = np.bincount(place, trained).astype("<i8")
            each, at = count[place], common.offsets(sizes).tolist()
            rows = [(block, bucket, None, planes(each[a:b])) for (block, _), a, b in zip(own, at[:-1], at[1:], strict=True)]
            rows.append((None, bucket, int((count > 0).sum()), None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return parts.select("bucket", "block", "part").repartition(tasks, "bucket").mapInArrow(run, "block long, bucket int, n_distinct long, blob binary")


def base_scores(rows: DataFrame, counts: DataFrame, n: int, v: int, n_texts: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score; score and fit by weight of MIXED: texts meet the counts of their block's words.

    fit is the score of a training text with each word counted once less; of others, 0.
    """
    both = [f"{x}_{i}" for x in ("score", "fit") for i in range(len(MIXED))]
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), *((x, pa.float64()) for x in both)])
    below = math.log10(n + v + 1)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        doc_id, learn, sizes = (left.column(c).combine_chunks().flatten() for c in ("doc_id", "training", "n_tokens"))
        learn, sizes = learn.to_numpy(zero_copy_only=False).astype(bool), sizes.to_numpy()
        at, words = common.offsets(sizes), common.offsets(sizes - 1)
        place, attention = unpacked(loosened(left.column("blob")[0].as_py()), int(words[-1]), len(sizes))
        attention *= math.log(10)
        parts = sorted(zip(right.column("bucket").to_pylist(), right.column("blob").to_pylist(), strict=True))
        dealt = loosened(left.column("dealt")[0].as_py())
        count = np.zeros(len(dealt) // 4, np.int64)
        count[np.argsort(unplaned(dealt, "<u4", len(count)), kind="stable")] = np.concatenate([np.zeros(0, "<i8"), *(unplaned(b, "<i8", len(b) // 8) for _, b in parts)])
        known = common.sums((count > 0)[place].astype(np.int64), words).astype(np.int64) + (n_texts > 0)
        base = common.sums(np.log10(count + 1.0)[place], words) + math.log10(n_texts + 1) - sizes * below
        whole = lambda x, of_end: np.insert((x / max(n, 1))[place], words[1:], of_end / max(n, 1))
        p = np.exp(attention)
        mixed = mixtures(whole(count, n_texts), attention, p, at)
        less = whole(np.maximum(count - 1, 0), max(n_texts - 1, 0))
        if learn.all():
            mixed += mixtures(less, attention, p, at)
        else:
            own = np.repeat(learn, sizes)
            for x in mixtures(less[own], attention[own], p[own], common.offsets(sizes[learn])):
                mixed.append(np.zeros(len(sizes)))
                mixed[-1][learn] = x
        columns = [doc_id, ~learn, sizes, known, np.full(len(sizes), n), base, *(x / math.log(10) for x in mixed)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    left = rows.where(F.col("bucket").isNull()).select("block", "doc_id", "training", "n_tokens", "blob", "dealt")
    right = counts.where(F.col("block").isNotNull()).select("block", "bucket", "blob")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, " + ", ".join(f"{x} double" for x in both))


def score(docs: DataFrame, training, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text); it learns where the column training is true.

    A null or empty text is its end alone. Repeated rows each give a row, and each counts in training; a null doc_id
    is kept; other columns are ignored. Without training texts, counts are 0 and the model knows equal frequencies.
    An empty table gives no rows. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", training.alias("learn"))
    model = fit(docs.where("learn"), ranks, pattern)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), model["tokens"] // TOKENS)
    rows = stored(scored(docs, model, ranks, pattern, "learn", tasks * SPREAD))
    counts = stored(totals(rows.where(F.col("bucket").isNotNull()), tasks))
    n, n_texts = rows.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("learned_tokens", "learned_texts")]).first()
    v = counts.agg(F.coalesce(F.sum("n_distinct"), F.lit(0))).first()[0] + (n_texts > 0)
    scores = stored(base_scores(rows, swept(counts), n, v, n_texts), rows, counts)
    fits = scores.agg(*[F.sum(f"fit_{i}") for i in range(len(MIXED))]).first()
    best = max(range(len(MIXED)), key=lambda i: fits[i] or 0.0)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.col(f"score_{best}").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from foldlog.llm.bpe import read_ranks

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return score(common.table(spark, sf_dir, "documents"), common.remainder("doc_id", 7) != 2, ranks, public_tokenizers.PATTERN)

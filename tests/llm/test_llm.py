"""Operators of the corpus subpackage against plain versions, on small tables with odd rows."""

import bisect
import collections
import functools
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foldlog.llm import attention_lm, bpe, common, cws, jaccard, langid, packing, quality, substrings, toxicity, warc

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_texts():
    """Null, empty, blank, one word, unusual spaces and letters, repeats, a long word, a very long text, and copies."""
    rng = random.Random(1)
    long = " ".join(words(rng, 20_000, 5000))
    base = " ".join(words(rng, 120))
    return [None, "", " \n\t ", "one", "a  b c d  e\x1cf\x85g", "café 你好 \U0001f600!!", "x" * 5000, "same same same same " * 40, long, base, base, base + " tail", "1234 !!! ...", "<|endoftext|> hi  <|endoftext|>"]


def frame(spark, texts, ids=None):
    ids = ids if ids is not None else list(range(len(texts)))
    rows = [(i, t, "en" if k % 2 else None, None, None, None, "clash") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def odd(spark):
    """Odd texts with a null and a repeated doc_id."""
    texts = odd_texts()
    return frame(spark, [*texts, texts[9], texts[3]], [*range(len(texts)), 9, None])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ranks():
    return bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


def test_bpe_equals_tiktoken(spark):
    df = odd(spark)
    engine = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(df, ranks(), P.PATTERN).collect())
    want = []
    for r in df.collect():
        ids = engine.encode_ordinary(r.text or "")
        want.append((r.doc_id is None, r.doc_id or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_documents(empty(spark), ranks(), P.PATTERN).count() == 0


def test_bpe_words_of_the_corpus(spark, monkeypatch):
    """What is broadcast are the most frequent words, no more than FREQUENT, with tiktoken's ids; texts get the same ids without them."""
    engine = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    df = odd(spark)
    counts = collections.Counter(w for r in df.collect() for w in common.chunks(r.text or ""))
    monkeypatch.setattr(bpe, "FREQUENT", 900)
    known = bpe.frequent(df, ranks(), P.PATTERN)
    assert 100 < len(known) <= 900 and all(len(w) <= bpe.LONGEST for w, _ in known)
    assert min(counts[w] for w, _ in known) > max(n for w, n in counts.items() if len(w) <= bpe.LONGEST and w not in dict(known)) * 0.98
    for w, ids in known:
        assert np.frombuffer(ids, "<u4").tolist() == engine.encode_ordinary(common.spelled(w))
    own = lambda: sorted((r.doc_id is None, r.doc_id or 0, r.ids_sha256) for r in bpe.encode_documents(df, ranks(), P.PATTERN).collect())
    few = own()
    monkeypatch.setattr(bpe, "FREQUENT", 0)
    assert bpe.frequent(df, ranks(), P.PATTERN) == [] and own() == few


def test_bpe_replay_on_random_texts():
    engine = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    encoder, rng = bpe.Encoder(ranks(), P.PATTERN), random.Random(2)
    alphabet = " \n\t aaabcde  '’s'll 12 é漢　\x1c\x85 .!?-ABC"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(800)]
    ids, at = encoder.encode(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == engine.encode_ordinary(t)
        assert encoder.decode(ids[at[i] : at[i + 1]]).decode() == t


def test_replay_follows_ranks_within_a_word():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 400, b"abc": 300, b"bc": 350, b"aa": 260, b"aaa": 261}
    merges = bpe.Merges(ranks)
    rng = random.Random(3)
    words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12))) for _ in range(500)]

    def plain(word):
        ids = list(word)
        while found := [(ranks[t], i) for i in range(len(ids) - 1) if (t := names[ids[i]] + names[ids[i + 1]]) in ranks]:
            rank, i = min(found)
            ids[i : i + 2] = [rank]
        return ids

    names = {r: t for t, r in ranks.items()}
    want = [plain(w) for w in words]
    assert [x.tolist() for x in merges.replay(words)] == want and [merges.one(w) for w in words] == want


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    df = odd(spark)
    rows = [r.asDict() for r in packing.pack(df, packing.default_spec(), 256).collect()]
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
    for group in by.values():
        at = 0
        for r in sorted(group, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    want = collections.Counter()
    for r in df.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)] if len(ids) > 256 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert packing.pack(empty(spark), packing.default_spec()).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        opened += gap == capacity
        if gap > n:
            bisect.insort(gaps, gap - n)
    return opened


def test_packing_is_as_tight_as_best_fit(spark, monkeypatch):
    """Over several ranges in each superstep; a third of the pieces have one length. No more sequences than best-fit decreasing, give or take one in 200."""
    monkeypatch.setattr(packing, "ROWS", 150)
    rng = random.Random(4)
    lengths = [31 if rng.random() < 0.33 else min(100, int(rng.lognormvariate(3, 1)) + 1) for _ in range(1500)]
    pieces = spark.createDataFrame([(i, 0, 0, n, 0, i % 7, i // 7) for i, n in enumerate(lengths)], "doc_id long, piece long, start long, length long, ids_crc32 long, part long, nth long")
    monkeypatch.setattr(packing, "pieces_of", lambda docs, spec, capacity: docs)
    by = collections.defaultdict(list)
    for r in packing.pack(pieces, "", 100).collect():
        by[r.sequence_id].append((r.offset, r.length, r.doc_id))
    assert sorted(d for x in by.values() for _, _, d in x) == list(range(1500))
    for x in by.values():
        at = 0
        for offset, n, _ in sorted(x):
            assert offset == at
            at += n
        assert at <= 100
    assert len(by) <= best_fit_decreasing(lengths, 100) * 1.005 + 1


def test_brackets():
    rng = random.Random(5)
    for _ in range(200):
        kind = [rng.randrange(2) for _ in range(rng.randrange(0, 40))]
        stack, want = [], set()
        for i, k in enumerate(kind):
            if k == 0:
                stack.append(i)
            elif stack:
                want.add((stack.pop(), i))
        gaps, pieces, _, net = packing.brackets(np.array(kind, np.int64))
        assert set(zip(gaps.tolist(), pieces.tolist(), strict=True)) == want and net == kind.count(0) - kind.count(1)


def test_engines_agree_on_tokens_and_code_points():
    tokens = packing.Tokens(packing.default_spec())
    assert tokens.fast is not None
    every = [t for t in (k.decode("utf-8", "ignore") for k in ranks()) if t and not any(a in t for a in tokens.added)]
    every += [chr(c) for c in range(1, 0x3000, 7)]
    for t in every:
        assert tokens.fast.encode_ordinary(t) == tokens.tokenizer.encode(t, add_special_tokens=False).ids


def test_language_model_counts(spark):
    rng = random.Random(5)
    texts = odd_texts() + [" ".join(words(rng, 30)) for _ in range(40)]
    df = frame(spark, texts)
    out = {r.doc_id: r for r in attention_lm.score(df, common.remainder("doc_id", 7) != 2, ranks(), P.PATTERN).collect()}
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 == 2}
    lists = [(t or "").encode().lower().split() for t in texts]
    c = collections.Counter(w for i, x in enumerate(lists) if i not in held for w in [*x, None])
    n, v = sum(c.values()), len(c)
    assert len(out) == len(texts)
    for i, x in enumerate(lists):
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(x) + 1, sum(w in c for w in [*x, None]), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*x, None]))
        assert r.score < 0
    assert attention_lm.score(empty(spark), F.lit(True), ranks(), P.PATTERN).count() == 0


def test_language_model_is_a_distribution():
    """Over the words after a context, attention probabilities add up to 1: those of a few tokens, in every order."""
    table = {b" a": 0, b" b": 1, b"c": 2}
    begins = attention_lm.begins_word(table)
    model = attention_lm.new_model(np.array([5.0, 3.0, 2.0, 1.0]), begins)
    rng = np.random.default_rng(1)
    model["n"][:, :-1] = rng.normal(0, 0.5, (3, attention_lm.WIDTH))
    scorer, end = attention_lm.Scorer(model), 3
    total = 0.0
    for depth in range(9):  # words " a" or " b", then c so often; what is longer has little mass
        for first in (0, 1):
            ids = np.array([0, 2, first, *[2] * depth, end])
            lp = scorer.words(ids, np.array([0, len(ids)]), np.array([0, 2, len(ids) - 1]), end)
            total += math.exp(lp[1])
    ids = np.array([0, 2, end])
    total += math.exp(scorer.words(ids, np.array([0, 3]), np.array([0, 2]), end)[1])
    assert 0.98 < total <= 1.0001


def test_language_model_learns_from_all_texts(spark):
    """Trees have the subword frequencies of all texts, and training meets every token of each pass, of many texts and of a long one."""
    rng = random.Random(8)
    texts = [" ".join(words(rng, 6)) for _ in range(3000)] + [" ".join(words(rng, 3000))]
    table, end = ranks(), max(ranks().values()) + 1
    engine = tiktoken.Encoding("words", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})
    ids = [[x for w in t.split() for x in engine.encode_ordinary(" " + w)] + [end] for t in texts]
    counts = np.bincount([x for i in ids for x in i], minlength=end + 1)
    windows = sum(-(-len(i) // attention_lm.STEP) for i in ids)
    passes = min(attention_lm.EPOCHS, round(attention_lm.VISITS / windows))
    model = attention_lm.fit(frame(spark, texts), table, P.PATTERN)
    assert (model["tree"].length == attention_lm.Tree(counts + 0.02, attention_lm.begins_word(table)).length).all()
    assert model["visited"] == passes * counts.sum()
    start = attention_lm.new_model(counts + 0.02, attention_lm.begins_word(table))
    moved = np.abs(model["e"] - start["e"]).max(axis=1) > 0
    assert moved[counts > 0].all() and not moved[counts == 0].any()
    entropy = -(counts[counts > 0] / counts.sum() * np.log(counts[counts > 0] / counts.sum())).sum()
    assert 0 < model["loss"] < entropy


def plain_words(model, ids, begin, end):
    """Natural log probabilities of the words of one text (ids, closing with end), one token after another without batches."""
    tree, width, step = model["tree"], attention_lm.WIDTH, attention_lm.STEP
    inputs, out, roots = [end, *ids[:-1]], [], []
    for i, target in enumerate(ids):
        first = max(0, i // step * step - step)
        e = np.array([model["e"][x] for x in inputs[first : i + 1]], np.float64)
        q, k, v = e[-1] @ model["q"], e @ model["k"], e @ model["v"]
        s = np.array([k[j] @ q / math.sqrt(width) + model["d"][len(e) - 1 - j] for j in range(len(e))])
        a = np.exp(s - s.max())
        h = np.append(e[-1] @ model["u"] + (a / a.sum()) @ v, 1.0)
        path = range(tree.start[target], tree.start[target] + tree.length[target])
        logs = [-math.log1p(math.exp(-tree.sign[p] * (model["n"][tree.node[p]] @ h))) for p in path]
        out.append(sum(logs))
        roots.append(logs[-1])
    found = []
    for j, a in enumerate(begin):
        b = begin[j + 1] if j + 1 < len(begin) else len(ids)
        found.append(sum(out[a:b]) - roots[a] + (roots[b] if b < len(ids) else 0))
    return found


def test_language_model_scores_by_a_plain_pass(spark, monkeypatch):
    """score against one forward pass for each token and a mixture with plain counts, for several texts and a long word; the same in a second run."""
    rng = random.Random(16)
    texts = ["", None, "x" * 300 + " tail", *[" ".join(words(rng, rng.randrange(1, 70), 50)) for _ in range(40)]]
    df, fit, kept = frame(spark, texts), attention_lm.fit, []
    monkeypatch.setattr(attention_lm, "fit", lambda *a: kept.append(fit(*a)) or kept[-1])
    out = {r.doc_id: r for r in attention_lm.score(df, F.col("doc_id") % 5 != 0, ranks(), P.PATTERN).collect()}
    engine, end = tiktoken.Encoding("words", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={}), max(ranks().values()) + 1
    lists = [(t or "").lower().split() for t in texts]
    counts = collections.Counter(w for i, x in enumerate(lists) if i % 5 for w in [*x, None])
    n, attention = sum(counts.values()), []
    for x in lists:
        pieces = [engine.encode_ordinary(" " + w) for w in x]
        ids = [i for p in pieces for i in p] + [end]
        attention.append(plain_words(kept[0], ids, [*np.cumsum([0, *map(len, pieces)]).tolist()], end))
    mix = lambda i, w, less: sum(np.logaddexp(np.log(w * max(counts[x] - less, 0) / n) if w and counts[x] > less else -np.inf, np.log(1 - w) + a) for x, a in zip([*lists[i], None], attention[i], strict=True))
    best = max(attention_lm.MIXED, key=lambda w: sum(mix(i, w, 1) for i in range(len(texts)) if i % 5))
    for i, r in out.items():
        assert r.score == pytest.approx(mix(i, best, 0) / math.log(10), abs=0.001 * r.n_tokens)


def test_language_model_step_by_plain_decisions():
    """One step of training against a loop over all decisions: those of the tree's top, taken as a matrix, are most of them."""
    rng = np.random.default_rng(23)
    v = 2000
    counts = np.floor(1e5 / np.arange(1, v + 1))
    model = attention_lm.new_model(counts, rng.random(v) < 0.5)
    model["n"][:, :-1] = rng.normal(0, 0.3, (v - 1, attention_lm.WIDTH))
    model["past"] = {x: np.full_like(model[x], 1e-3) for x in (*attention_lm.SPARSE, *attention_lm.DENSE)}
    tree, width = model["tree"], attention_lm.WIDTH
    assert 4 * (tree.below * counts).sum() < (tree.length * counts).sum()
    ids = rng.choice(v, 11, p=counts / counts.sum())
    ids[:2] = v - 1, v - 2  # rare ones have decisions below
    sequence, at = np.append(v - 1, ids), np.array([0, len(ids)])
    trainer = attention_lm.Trainer(model)
    trainer.visit(sequence, *attention_lm.window_places(at), np.random.default_rng(1))
    step, loss = np.zeros((v - 1, width + 1)), 0.0
    met = np.zeros(v - 1)
    for i, target in enumerate(ids):
        e = model["e"][sequence[: i + 1]].astype(np.float64)
        s = (e @ model["k"]) @ (e[-1] @ model["q"]) / math.sqrt(width) + model["d"][np.arange(i, -1, -1)]
        a = np.exp(s - s.max())
        h = np.append(e[-1] @ model["u"] + (a / a.sum()) @ (e @ model["v"]), 1.0)
        for p in range(tree.start[target], tree.start[target] + tree.length[target]):
            z = tree.sign[p] * (model["n"][tree.node[p]] @ h)
            step[tree.node[p]] -= tree.sign[p] / (1 + math.exp(z)) * h
            loss += math.log1p(math.exp(-z))
            met[tree.node[p]] += 1
    assert trainer.loss == pytest.approx(loss, rel=1e-4) and (trainer.visits["n"] == met).all()
    past = 1e-3 + step**2
    assert np.abs(trainer.past["n"] - past).max() < 1e-4
    assert np.abs(trainer.model["n"] - (model["n"] - attention_lm.RATE * step / np.sqrt(past))).max() < 1e-4


def test_language_model_works_on_the_decisions_of_paths(monkeypatch):
    """Training takes an exponential for each decision on a token's path and each input it attends to, about, not for all of the tree's top; places and signs are those of the paths."""
    rng = np.random.default_rng(29)
    v = 2000
    counts = np.floor(1e5 / np.arange(1, v + 1))
    model = attention_lm.new_model(counts, rng.random(v) < 0.5)
    model["past"] = {x: np.full_like(model[x], 1e-3) for x in (*attention_lm.SPARSE, *attention_lm.DENSE)}
    tree, n = model["tree"], 40 * attention_lm.STEP
    sequence, at = np.append(v - 1, rng.choice(v, n, p=counts / counts.sum())), np.array([0, n])
    taken, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, *a, **b: (taken.append(np.size(x)), exp(x, *a, **b))[1])
    trainer = attention_lm.Trainer(model)
    trainer.visit(sequence, *attention_lm.window_places(at), rng)
    most = tree.above.max() + tree.below[sequence[1:]].mean() + 2 * attention_lm.STEP
    assert trainer.total == n and sum(taken) <= n * most
    ids = np.arange(v)
    places, signs = tree.places(ids)
    for i in ids.tolist():
        path = slice(tree.start[i] + tree.below[i], tree.start[i] + tree.length[i])
        node, sign = tree.node[path][::-1], tree.sign[path][::-1]
        own = places[i] - i * (len(tree.top) + 1)
        assert (tree.top[own[: len(node)]] == node).all() and (signs[i, : len(node)] == sign).all() and (own[len(node) :] == len(tree.top)).all()


def test_packed_probabilities():
    rng = np.random.default_rng(17)
    for n in (0, 1, 5, 300):
        place, found = rng.integers(0, 1 << 31, n), -rng.exponential(9, n + 1)
        found[rng.integers(0, n + 1)] = -70_000.5
        a, b = attention_lm.unpacked(attention_lm.packed(place, found), n)
        assert (a == place).all() and np.abs(b - found).max() <= 0.51 / attention_lm.FINE


def test_windows_score_each_token_once():
    at = np.array([0, 1, 40, 40 + 16, 100])
    first, start, n = attention_lm.window_places(at)
    assert n.sum() == 100
    targets = [f + attention_lm.STEP + 1 + k for f, m in zip(first.tolist(), n.tolist(), strict=True) for k in range(m)]
    assert len(set(targets)) == 100


def test_fingerprints(spark):
    df = odd(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    out = {r.doc_id: r for r in cws.fingerprints(df).collect()}
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, following = texts[i], texts[order[(k + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert out[9].fingerprint == out[10].fingerprint != out[11].fingerprint
    assert out[10].near_next == 1.0 and out[11].near_next > 0.8
    assert 0 < out[8].near_edited < 0.7 and out[8].near_next < 0.1
    assert cws.fingerprints(empty(spark)).count() == 0
    assert cws.fingerprints(odd(spark)).count() == 16


def mix64(n):
    """A term's code from a number, the same in every run."""
    return int(np.uint64(xxhash.xxh64_intdigest(str(n))).astype(np.int64))


def test_collision_rate_is_generalised_jaccard(spark, monkeypatch):
    """Pairs with exact likenesses from 0.05 to 0.95: the share of equal samples is within 4.5 standard errors of each, and of their mean."""
    rng, rows, exact = random.Random(6), [], []
    for k in range(60):
        target = 0.05 + 0.9 * k / 59
        a, b = collections.Counter(), collections.Counter()
        for i in range(200):
            w = rng.randrange(1, 7)
            common_part = rng.random() < target
            a[1000 * k + i] = w
            b[1000 * k + i + (0 if common_part else 500)] = w + (common_part and rng.random() < 0.2)
        exact.append(sum((a & b).values()) / sum((a | b).values()))
        rows += [(k, side, [mix64(t) for t in c], list(c.values())) for side, c in ((0, a), (1, b))]
    assert min(exact) < 0.1 and max(exact) > 0.8
    monkeypatch.setattr(cws, "_terms", lambda d: d)
    df = spark.createDataFrame(rows, "pair long, side int, terms array<long>, weights array<int>")
    by = {(r.pair, r.side): np.array(r.samples) for r in cws.signatures(df, ["pair", "side"], []).collect()}
    got = np.array([np.mean(by[k, 0] == by[k, 1]) for k in range(60)])
    error = np.sqrt(np.array(exact) * (1 - np.array(exact)) / cws.SAMPLES)
    assert (np.abs(got - exact) < 4.5 * error).all()
    assert abs(got.mean() - np.mean(exact)) < 4.5 * np.sqrt((error**2).sum()) / 60


def brute_samples(terms):
    """Samples of weighted terms (code: weight) by the formulas of consistent weighted sampling, in plain Python."""
    hashed = lambda x: xxhash.xxh64_intdigest(struct.pack("<Q", x), seed=42)
    wide = (1 << 64) - 1
    out = []
    for i in range(cws.SAMPLES):
        block, k, best = 0xD6E8FEB86659FD93 * (i // cws.ON_ROW + 1) & wide, i % cws.ON_ROW, None
        for term, w in terms.items():
            term = (term & wide) ^ block
            x, y = (hashed(term ^ (0x9E3779B97F4A7C15 * (2 * k + j + 1) & wide)) for j in range(2))
            c = -math.log((((x >> 32) + 0.5) / 2**32) * (((x & 0xFFFFFFFF) + 0.5) / 2**32))
            e1, e2 = -math.log(((y >> 24) + 0.5) / 2**40), -math.log(((y & 0xFFFFFF) + 0.5) / 2**24)
            r, b = e1 + e2, e2 / (e1 + e2)
            t = math.floor(math.log(w) / r + b)
            value = c * math.exp(-r * (t - b + 1))
            if best is None or value < best[0]:
                best = (value, (term + t * 7919) & 0xFFFFF)
        out.append(best[1])
    return out


def brute_terms(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    chain = lambda parts: functools.reduce(lambda h, p: xxhash.xxh64_intdigest(p.encode(), seed=h), parts, 42)
    if 0 < len(w) < 5:
        return collections.Counter([xxhash.xxh64_intdigest(struct.pack("<I", len(w)), seed=xxhash.xxh64_intdigest(" ".join(w).encode(), seed=42))])
    return collections.Counter(chain(w[i : i + 5]) for i in range(len(w) - 4))


def test_fingerprints_are_those_of_the_formulas(spark):
    """Every fingerprint against plain Python: equal but for a sample in 500, where two values lie closer than the packed precision."""
    rng = random.Random(14)
    texts = ["", "one", "two words", " a b\tc d e ", "again and again and " * 12] + [" ".join(words(rng, rng.randrange(5, 60), 30)) for _ in range(12)]
    out = {r.doc_id: r.fingerprint for r in cws.fingerprints(frame(spark, texts)).collect()}
    right = total = 0
    for i, t in enumerate(texts):
        terms = brute_terms(t)
        if not terms:
            assert out[i] == ""
            continue
        want = brute_samples(terms)
        got = [int(out[i][5 * j : 5 * j + 5], 16) for j in range(cws.SAMPLES)]
        right, total = right + sum(a == b for a, b in zip(got, want, strict=True)), total + len(want)
    assert total == 16 * cws.SAMPLES and right >= 0.998 * total


def test_next_rows_over_many_ranges(spark, monkeypatch):
    """Ranges of few bytes, with ids that hold a third of all rows: a repeated one and null; repeated rows; every row finds the row after it."""
    monkeypatch.setattr(cws, "RANGE_BYTES", 400)
    rng = random.Random(15)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {rng.randrange(120)} " * 3) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = cws.with_next(df).collect()
    assert len({r.range for r in found}) > 30
    order = sorted(((r.doc_id is not None, r.doc_id or 0, r.hash) for r in found), reverse=True)
    follows = lambda r: (r.next_id is not None, r.next_id or 0, r.next_hash)
    want = collections.Counter(zip(order, [*order[1:], order[0]], strict=True))
    assert collections.Counter(((r.doc_id is not None, r.doc_id or 0, r.hash), follows(r)) for r in found) == want
    texts = {r.hash: r.text for r in found}
    assert all(r.next_text == texts[r.next_hash] for r in found)


def test_collision_rate_of_many_weighted_terms(spark, monkeypatch):
    """15,000 single terms beside 750 of weight 10, against the 750 alone: a third of the weight is common."""
    both = "concat(transform(sequence(1, 15000), i -> xxhash64(id, i)), transform(sequence(1, 750), i -> xxhash64(id, -i)))"
    weights = "concat(array_repeat(1, 15000), array_repeat(10, 750))"
    parts = [spark.range(8).selectExpr("id", f"{side} AS side", f"slice({both}, {at}, 20000) AS terms", f"slice({weights}, {at}, 20000) AS weights") for side, at in ((0, 1), (1, 15001))]
    monkeypatch.setattr(cws, "_terms", lambda d: d)
    by = {(r.id, r.side): np.array(r.samples) for r in cws.signatures(parts[0].union(parts[1]), ["id", "side"], []).collect()}
    assert abs(np.mean([by[k, 0] == by[k, 1] for k in range(8)]) - 1 / 3) < 0.08


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                x = len(sets[a] & sets[b])
                if 100 * x >= 80 * (len(sets[a]) + len(sets[b]) - x):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, monkeypatch, seed):
    """Families of near copies of all sizes, larger than CROWD too, texts with common passages, short texts."""
    monkeypatch.setattr(jaccard, "CHUNK", 24)
    rng = random.Random(seed)
    texts = list(odd_texts())
    passage = words(rng, 40, 5000)
    for size, n in ((60, 80), (25, 30), (10, 12), (5, 300), (30, 9)):
        base = words(rng, n, 5000)
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, n // 25) + 1)):
                copy[rng.randrange(n)] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    for _ in range(60):
        texts.append(" ".join(passage + words(rng, rng.randrange(0, 60), 5000)))
    for _ in range(60):
        texts.append(" ".join(words(rng, rng.randrange(1, 9), 6)))
    ids = random.Random(9).sample(range(10_000), len(texts))
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, texts, ids)).collect()}
    assert out == brute_components(dict(zip(ids, texts, strict=True)))


def test_jaccard_join_odd_rows(spark):
    rows = jaccard.join(odd(spark)).collect()
    assert len(rows) == 16
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[None][0].component_id is None and by[0][0].component_id == 0 and by[0][0].n_shingles == 0
    assert {r.component_id for i in (9, 10, 11) for r in by[i]} == {9}
    kept = jaccard.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [*range(10), 12, 13]
    assert jaccard.join(empty(spark)).count() == 0 and jaccard.keep_one(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in jaccard.components(spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def brute_cut(texts):
    lists = {i: (t or "").encode().split() for i, t in texts.items()}
    first = {}
    for i in sorted(lists):
        for k in range(len(lists[i]) - 49):
            first.setdefault(tuple(lists[i][k : k + 50]), i)
    out = {}
    for i, w in lists.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


def test_substrings(spark):
    rng = random.Random(8)
    texts = list(odd_texts())
    shared = [words(rng, n, 3000) for n in (49, 50, 51, 120, 75)]
    for _ in range(60):
        w = words(rng, rng.randrange(0, 60), 3000)
        for s in rng.sample(shared, rng.randrange(0, 3)):
            w += s + words(rng, rng.randrange(0, 5), 3000)
        texts.append(" ".join(w))
    texts.append(" ".join(["again"] * 130))
    texts.append(" ".join(["again"] * 60))
    ids = random.Random(3).sample(range(5000), len(texts))
    df = frame(spark, texts, ids)
    want = brute_cut(dict(zip(ids, texts, strict=True)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(df).collect()}
    assert got == {i: w[:3] for i, w in want.items()}
    rest = {r.doc_id: r.text for r in substrings.remove(df).collect()}
    assert rest == {i: (want[i][3] if want[i][1] else t) for i, t in zip(ids, texts, strict=True)}
    assert substrings.dedup(empty(spark)).count() == 0 and substrings.remove(odd(spark)).count() == 16
    null = [r for r in substrings.dedup(odd(spark)).collect() if r.doc_id is None]
    assert null[0].n_removed == 0


def brute_repeats(w):
    seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    inside = [False] * len(w)
    for k in range(len(w) - 7):
        if seen[tuple(w[k : k + 8])] > 1:
            inside[k : k + 8] = [True] * 8
    return sum(inside)


def labelled(spark, n=400):
    rng = random.Random(10)
    texts, marks = [], []
    for i in range(n):
        w = [f"{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}{rng.choice('xyz')}" for _ in range(rng.randrange(30, 80))]
        bad, toxic = i % 8 == 0, i % 5 == 1
        if bad:
            w = [x + rng.choice(["###", "***", "$$$"]) for x in w]
        if toxic:
            for k in range(0, len(w), 12):
                w[k] = rng.choice(["Vile,", "nasty", "rotten!"])
        texts.append(" ".join(w))
        marks.append((i, int(not bad), int(toxic)))
    return frame(spark, texts), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), marks


def test_quality(spark):
    df, labels, marks = labelled(spark)
    out = {r.doc_id: r for r in quality.assess(df, labels).collect()}
    for i, good, _ in marks:
        assert out[i].kept == bool(good)
    rng = random.Random(11)
    for _ in range(50):
        w = [rng.choice("ab") for _ in range(rng.randrange(0, 40))]
        assert quality.statistics([" ".join(w).encode()])[0, 4] == brute_repeats(w)
    rows = quality.assess(odd(spark), labels).collect()
    assert len(rows) == 16
    for r in rows:
        assert r.rule_n_words is not None and (r.doc_id != 0 or r.base_failed)
    text = "a#b  cé\n\na#b  cé\n \n| x"
    s = quality.statistics([text.encode()])[0]
    assert s[:5].tolist() == [6, 12, 3, 1, 0]
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, good, _ in marks if good}
    assert quality.assess(empty(spark), labels).count() == 0
    assert quality.assess(odd(spark), labels.limit(0)).count() == 16


def test_toxicity(spark):
    df, labels, marks = labelled(spark)
    model = toxicity.fit(toxicity.learnable(df), toxicity.learnable(labels))
    out = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert np.mean([out[i].predicted == t for i, _, t in marks]) > 0.98
    rows = toxicity.score(odd(spark), model).collect()
    assert len(rows) == 16 and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    clean = toxicity.keep_clean(df, model)
    assert clean.columns == df.columns and clean.count() == sum(r.predicted == 0 for r in out.values())
    nothing = toxicity.fit(df, labels.limit(0))
    assert toxicity.score(df, nothing).where("predicted = 1").count() == 0
    assert toxicity.score(empty(spark), toxicity.fit(empty(spark), labels)).count() == 0


def test_language(spark):
    rng = random.Random(12)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ün", "ter"], "cc": ["que", "é", "oi"]}
    rows = [(i, " ".join("".join(rng.choices(s, k=3)) for _ in range(20)), lang) for i in range(300) for lang, s in [rng.choice(list(syllables.items()))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 4 <> 0"))
    out = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows)
    by = {r.doc_id: r for r in langid.identify(odd(spark).where("doc_id is not null").dropDuplicates(["doc_id"]), model).collect()}
    assert {by[i].lang_pred for i in (0, 1, 2, 12)} == {"und"} and by[0].score == 0 and by[3].lang_pred != "und"
    assert langid.identify(empty(spark), langid.fit(empty(spark))).count() == 0
    assert {r.lang_pred for r in langid.identify(odd(spark), langid.fit(empty(spark))).collect()} == {"und"}


def test_language_knows_every_language(spark):
    """More languages than 64, and the last ones with the fewest rows."""
    rng = random.Random(13)
    letters = [chr(0x4E00 + i) for i in range(210)]
    rows = [(100 * k + i, " ".join("".join(rng.choices(letters[3 * k : 3 * k + 3], k=3)) for _ in range(20)), f"l{k:02}") for k in range(70) for i in range(30 if k < 64 else 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 4 <> 0"))
    assert len(model["labels"]) == 70
    out = {r.doc_id: r.lang_pred for r in langid.identify(df, model).collect()}
    right = collections.Counter(lang for i, _, lang in rows if out[i] == lang)
    assert all(right[f"l{k}"] == 20 for k in range(64, 70))


def test_archive_records(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<html lang=en><title> A\n b</title><p>x &amp;lt; y<br>z<script>var a='<p>';</script><a href=q>l</a>"), (2, None, None), (None, "u", "plain"), (2, None, None)], "page_id long, url string, html string")
    rows = warc.derive(warc.responses(pages)).collect()
    assert len(rows) == 8
    sources = {r.record_id for r in warc.responses(pages).collect()}
    assert {r.refers_to for r in rows} == sources and len({r.record_id for r in rows}) == 6
    one = {r.warc_type: r for r in rows if r.page_id == 1}
    assert one["conversion"].block == "A b\nx &lt; y\nzl".replace("A b", "A\nb")
    assert "http-status: 200\r\n" in one["metadata"].block and "language: en\r\n" in one["metadata"].block and "links: 1\r\n" in one["metadata"].block and "title: A b\r\n" in one["metadata"].block
    for r in rows:
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.content_length == len(r.block.encode())
        assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.headers
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    df, labels, marks = labelled(spark, 200)
    copies = df.where("doc_id < 60").withColumn("doc_id", F.col("doc_id") + 1000)
    docs = df.unionByName(copies).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {i for i, good, toxic in marks if good and not toxic}

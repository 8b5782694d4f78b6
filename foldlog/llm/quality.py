"""Operator 6: quality rules with an isolation forest.

Rule statistics of each whole text (lengths, symbols, repeated lines and 8-word windows, case, punctuation) are the
features. Trees split them at random; a text that few splits set apart is anomalous. Each group of related statistics
(GROUPS) has trees of its own, grown from a bounded sample of labelled documents (SAMPLE rows, APART of them all at
most). The threshold of a group is calibrated on all other labelled documents, by histograms of their scores: it
rejects most of those labelled bad while it spares all but SPARE of the good. A group whose scores don't tell bad from
good rejects nothing.

One pass over the texts computes the statistics, which are small from then on; windows are compared exactly, by
doubling (pairs, fours, eights), inside a block of the pass.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.llm import common
from foldlog.llm.store import drop, stored

#: Labelled rows that trees grow from, about, and the largest share of all labelled rows that may; trees; rows in a tree;
#: share of good rows that may be rejected; steps of the scores from 0 to 1 in a histogram.
SAMPLE, APART, TREES, ROWS, SPARE, STEPS = 20_000, 0.3, 100, 256, 0.0005, 10_000
#: A group rejects only if it finds so many bad rows at least, and so many times the share of the good that it may reject.
LEAST_BAD, LEAST_TIMES = 5, 20
WINDOW = 8
#: Columns of features().
GROUPS = {"symbols": [2], "repetition": [3, 4], "characters": [5, 6, 7], "shape": [1, 9, 10], "echoes": [11]}

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_digits", "n_marks", "n_lines", "n_echoes", "n_stops", "n_pieces")
_blank = np.isin(np.arange(256), list(b" \t\n\r\x0b\f"))
_kinds = np.array([np.isin(np.arange(256), list(b"#*$%&|<>")), (np.arange(256) & 0xC0) != 0x80, _blank, np.isin(np.arange(256), list(range(65, 91))), np.isin(np.arange(256), list(range(48, 58))), np.isin(np.arange(256), list(b"!?")), np.isin(np.arange(256), list(b".")), np.isin(np.arange(256), list(b",;:"))], np.int64)


def repeated(words: np.ndarray, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text (words[at[i] : at[i + 1]]), how many of its words stand in windows that it has twice or more.

    Windows of twice the length are looked at only where both halves are repeated; window is a power of 2.
    """
    n = len(words)
    counts = np.zeros(len(at) - 1, np.int64)
    if n < window:
        return counts
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    code, length = owner * (int(words.max()) + 1) + words, 1
    _, code, times = np.unique(code, return_inverse=True, return_counts=True)
    again = times[code] > 1
    while length < window:
        i = np.flatnonzero(again[: n - length])
        i = i[again[i + length] & (owner[i] == owner[i + length])]
        _, pair, times = np.unique(code[i] * n + code[i + length], return_inverse=True, return_counts=True)
        code, again = np.zeros(n, np.int64), np.zeros(n, bool)
        code[i], again[i] = pair, times[pair] > 1
        length *= 2
    step = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    covered = np.cumsum(step[:n]) > 0
    return np.bincount(owner[covered], minlength=len(counts))


def statistics(raw: list[bytes]) -> np.ndarray:
    """BASE and MORE, a row for each text."""
    out = np.zeros((len(raw), len(BASE) + len(MORE)), np.int64)
    index: dict[bytes, int] = {}
    numbers, lengths = [], []
    for i, text in enumerate(raw):
        by = _kinds @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words = text.split()
        lines = [x for x in text.split(b"\n") if x.strip()]
        numbers.extend([index.setdefault(w, len(index)) for w in words])
        lengths.append(len(words))
        out[i] = (len(words), by[1] - by[2], by[0], len(lines) - len(set(lines)), 0, by[3], by[4], by[5], len(lines), sum(map(eq, words, words[1:])), by[6], by[7])
    out[:, 4] = repeated(np.array(numbers, np.int64), common.offsets(lengths))
    return out


def features(s: np.ndarray) -> np.ndarray:
    """What the trees split: shares and logarithms of the statistics."""
    s = s.astype(np.float64)
    words, chars = np.maximum(s[:, 0], 1), np.maximum(s[:, 1], 1)
    return np.column_stack([np.log1p(s[:, 0]), chars / words, s[:, 2] / words, s[:, 3] / np.maximum(s[:, 8], 1), s[:, 4] / words, s[:, 5] / chars, s[:, 6] / chars, s[:, 7] / words, np.log1p(s[:, 0] / np.maximum(s[:, 8], 1)), s[:, 10] / words, s[:, 11] / words, s[:, 9] / words])


def mean_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, seed: int = 6) -> list[np.ndarray]:
    """TREES isolation trees over rows of x; a node is (feature or -1, split or depth, left, right)."""
    rng, trees = np.random.default_rng(seed), []
    for _ in range(TREES if len(x) else 0):
        own = x[rng.choice(len(x), min(ROWS, len(x)), replace=False)]
        deepest = int(np.ceil(np.log2(max(len(own), 2))))
        nodes: list[list[float]] = []

        def split(part: np.ndarray, depth: int, nodes: list = nodes, deepest: int = deepest) -> int:
            me = len(nodes)
            low, high = part.min(axis=0), part.max(axis=0)
            able = np.flatnonzero(high > low)
            if depth >= deepest or len(part) < 2 or not len(able):
                nodes.append([-1, depth + float(mean_path(len(part))), me, me])
                return me
            f = rng.choice(able)
            cut = rng.uniform(low[f], high[f])
            nodes.append([f, cut, 0, 0])
            nodes[me][2] = split(part[part[:, f] < cut], depth + 1)
            nodes[me][3] = split(part[part[:, f] >= cut], depth + 1)
            return me

        split(own, 0)
        trees.append(np.array(nodes))
    return trees


def anomaly(trees: list[np.ndarray], x: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """2 to the power of minus the mean path length by that of a random search: near 1 for anomalous rows."""
    if not trees:
        return np.zeros(len(x))
    total = np.zeros(len(x))
    for t in trees:
        at = np.zeros(len(x), np.int64)
        while True:
            f = t[at, 0].astype(np.int64)
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                break
            a = at[inner]
            at[inner] = np.where(x[inner, f[inner]] < t[a, 1], t[a, 2], t[a, 3]).astype(np.int64)
        total += t[at, 1]
    return 2.0 ** (-total / len(trees) / max(float(mean_path(rows)), 1e-9))


def threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut, from counts of good and bad rows by step of their scores; infinite if it finds too few bad ones.

    It lies midway between the step of the last good row that is spared and the next bad row's above it.
    """
    n_good, n_bad = int(good.sum()), int(bad.sum())
    if not n_good or not n_bad:
        return float("inf")
    from_top = np.cumsum(good[::-1])[::-1]
    least = int(np.flatnonzero(from_top > int(n_good * SPARE))[-1])
    above = np.flatnonzero(bad[least + 1 :])
    found = int(bad[least + 1 :].sum())
    if found < LEAST_BAD or found < LEAST_TIMES * SPARE * n_bad:
        return float("inf")
    return (2 * (least + 1) + int(above[0])) / 2 / STEPS


def oddness(forest: list[tuple], x: np.ndarray) -> np.ndarray:
    """The largest of the groups' scores, each in units of its threshold: 1 and above is rejected."""
    out = np.zeros(len(x))
    for columns, trees, rows, cut in forest:
        if np.isfinite(cut):
            out = np.maximum(out, anomaly(trees, x[:, columns], rows) / cut)
    return out


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    names = [f"rule_{n}" for n in BASE + MORE]
    return common.per_document(docs, keep, [(n, pa.int64()) for n in names], lambda block: list(statistics(common.raw_texts(block)).T))


def _matrix(rows) -> np.ndarray:
    return np.array([[r[f"rule_{n}"] for n in BASE + MORE] for r in rows], np.int64).reshape(-1, len(BASE + MORE))


def fit(stats: DataFrame, labels: DataFrame, seed: int = 6) -> list[tuple]:
    """For each group its columns, trees, rows in a tree and threshold, from measured() rows with doc_id, and labels (doc_id, quality)."""
    spark = stats.sparkSession
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("rule_quality"))
    names = [f"rule_{n}" for n in BASE + MORE]
    marked = stored(stats.join(marks, "doc_id").select("doc_id", "rule_quality", *names).withColumn("own", common.share(seed, "doc_id", *names)))
    n = marked.count()
    if not n:
        return []
    rate = min(APART, SAMPLE / n)
    m = _matrix(sorted(marked.where(F.col("own") < rate).select(*names).distinct().collect()))  # about SAMPLE rows of numbers
    x = features(m)[~_failed(m)]
    size = min(ROWS, len(x))
    forest = [(columns, grow(x[:, columns], seed + k), size, float("inf")) for k, columns in enumerate(GROUPS.values())]
    shared = spark.sparkContext.broadcast(forest)

    def steps(batches):
        for b in batches:
            s = np.column_stack([b.column(c).to_numpy() for c in names]).reshape(-1, len(names))
            left = ~_failed(s)
            good, x = (b.column("rule_quality").to_numpy() == 1)[left], features(s[left])
            for k, (columns, trees, rows, _) in enumerate(shared.value):
                at, many = np.unique(np.minimum((anomaly(trees, x[:, columns], rows) * STEPS).astype(np.int64), STEPS) * 2 + good, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at // 2), pa.array(at % 2), pa.array(many.astype(np.int64))], ["k", "step", "good", "n"])

    counted = marked.where(F.col("own") >= rate).select("rule_quality", *names).mapInArrow(steps, "k long, step long, good long, n long")
    counts = np.zeros((len(GROUPS), 2, STEPS + 1), np.int64)
    for r in counted.groupBy("k", "step", "good").agg(F.sum("n").alias("n")).collect():  # GROUPS x STEPS x 2 rows at most
        counts[r["k"], r["good"], r["step"]] = r["n"]
    drop(marked)
    return [(*g[:3], threshold(counts[k, 1], counts[k, 0])) for k, g in enumerate(forest)]


def _failed(s: np.ndarray) -> np.ndarray:
    return (s[:, 0] < 20) | (100 * s[:, 4] > 30 * s[:, 0])


def judge(stats: DataFrame, model: list[tuple], keep: list[str]) -> DataFrame:
    """Columns keep of measured() rows, BASE (as rule_ columns), base_failed, anomaly and kept."""
    spark = stats.sparkSession
    shared = spark.sparkContext.broadcast(model)  # GROUPS x TREES x 2 ROWS nodes
    names = [f"rule_{n}" for n in BASE + MORE]
    kept = [f for f in stats.schema.fields if f.name in keep]
    out = [f.name for f in kept] + names[: len(BASE)] + ["base_failed", "anomaly", "kept"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} long" for n in names[: len(BASE)]] + ["base_failed boolean", "anomaly double", "kept boolean"])

    def run(batches):
        m = shared.value
        for b in batches:
            s = np.column_stack([b.column(n).to_numpy() for n in names]).reshape(-1, len(names))
            failed, a = _failed(s), oddness(m, features(s))
            yield pa.RecordBatch.from_arrays([b.column(n) for n in out[: len(kept) + len(BASE)]] + [pa.array(failed), pa.array(a), pa.array(~failed & (a < 1))], out)

    return stats.select(*[f.name for f in kept], *names).mapInArrow(run, schema)


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, BASE, base_failed, anomaly and kept for each row of docs (doc_id, text).

    A null or empty text has no words and fails the base rules. Repeated rows each give a row, a null doc_id is kept
    (and is never a labelled row), other columns are ignored. Without labels of both kinds the forest rejects nothing.
    An empty table gives no rows.
    """
    stats = stored(measured(docs, ["doc_id"]))
    return judge(stats, fit(stats, labels), ["doc_id"])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that assess() keeps.

    Null and empty texts go; repeated rows all stay or all go; an empty table gives no rows. Texts are measured twice,
    once for the fit and once for the verdict beside the text: a join of the labels with texts that would save the
    first would shuffle all of them.
    """
    stats = measured(docs, ["doc_id"])
    model = fit(stats, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(block: pa.Table) -> list:
        s, m = statistics(common.raw_texts(block)), shared.value
        return [~_failed(s) & (oddness(m, features(s)) < 1)]

    return common.per_document(docs, docs.columns, [("kept", pa.bool_())], work, "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assess(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", *[F.col(f"rule_{n}").alias(n) for n in BASE], "base_failed", "kept", "anomaly")

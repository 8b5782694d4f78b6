"""Operator 9: toxicity by non-negative positive-unlabelled learning.

The classifier is linear in the presence of hashed words. It learns from confirmed toxic texts and unlabelled texts:
the risk of unlabelled texts as negatives is corrected by the class prior, and the corrected part is held at zero or
above (when it falls below, its gradient is reversed). Words enter if their document frequencies among positive and
unlabelled texts differ clearly. Samples of both kinds are bounded (POSITIVE, UNLABELLED rows, about); the class prior
comes from all labels that may be learned from.

Scoring is one pass over whole texts, without a shuffle; what is broadcast is the model of at most FEATURES words.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.llm import common
from foldlog.llm.store import drop, stored

POSITIVE, UNLABELLED = 4000, 8000
FEATURES = 2048
#: Standard errors by which a word's frequencies must differ; hash codes of words.
CLEAR, CODES = 4.0, 1 << 31

_word = re.compile(r"[^\W_]+")


def codes_of(raw: str) -> list[int]:
    return [zlib.crc32(w.encode()) % CODES for w in _word.findall(raw)]


def nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk of logistic loss, by Adam over all positive (p) and unlabelled rows, whose last column is 1."""
    n = p.shape[1] - 1
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for i in range(1, steps + 1):
        fp, fu = p @ w.astype(np.float32), u @ w.astype(np.float32)
        sp, su = sigmoid(fp), sigmoid(fu)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gn = su @ u / len(u) - prior * (sp @ p) / len(p)
        g = prior * ((sp - 1) @ p) / len(p) + gn if negative >= 0 else -gn
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, seed: int = 9) -> dict:
    """A model from rows of docs (doc_id, text) and labels (doc_id, toxic).

    Without positive rows, the model knows no words and holds all texts for clean.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_pos = marks.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n_docs = docs.count()
    if not n_pos or not n_docs:
        return {"codes": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": -5.0}
    prior = min(max(n_pos / n, 1e-4), 0.95)
    toxic = F.broadcast(marks.where((F.col("toxic") == 1) & (common.share(seed, "doc_id") < min(1.0, POSITIVE / n_pos))).select("doc_id"))  # about POSITIVE ids
    found = docs.select("doc_id").join(toxic, "doc_id", "left_semi").count()
    rows = common.sampled(docs.select("doc_id", "text").join(toxic, "doc_id", "left_semi"), min(1.0, POSITIVE / max(found, 1)), seed).select("text", F.lit(1).alias("positive"))
    rows = rows.unionByName(common.sampled(docs.select("doc_id", "text"), min(1.0, UNLABELLED / n_docs), seed + 1).select("text", F.lit(0).alias("positive")))
    common.arrow(spark)

    def features(batches):
        for block in common.blocks(batches):
            found = [sorted(set(codes_of(t.lower()))) for t in common.texts(block)]
            yield pa.RecordBatch.from_arrays([block.column("positive").combine_chunks().cast(pa.int32()), pa.array(found, pa.list_(pa.int64()))], ["positive", "codes"])

    sample = stored(rows.mapInArrow(features, "positive int, codes array<long>"))
    size = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return {"codes": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": -5.0}
    each = sample.select("positive", F.explode("codes").alias("code")).groupBy("code").agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u"))
    a, b = F.col("p") / size[1], F.col("u") / size[0]
    mean = (F.col("p") + F.col("u")) / (size[0] + size[1])
    z = F.abs(a - b) / F.sqrt(mean * (1 - mean) * (1 / size[0] + 1 / size[1]) + F.lit(1e-12))
    chosen = each.where((F.col("p") + F.col("u") >= 5) & (z > CLEAR)).orderBy(F.desc(z), "code").limit(FEATURES).select("code").collect()
    codes = np.array(sorted(r["code"] for r in chosen), np.int64)
    narrowed = sample.select("positive", F.array_intersect("codes", F.array(*[F.lit(int(c)) for c in codes]).cast("array<long>")).alias("codes")).toArrow().combine_chunks()  # as many rows as the sample, FEATURES codes each at most
    drop(sample)
    lists = narrowed.column("codes").chunk(0)
    at, flat = lists.offsets.to_numpy(), np.searchsorted(codes, lists.values.to_numpy())
    positive = narrowed.column("positive").to_numpy() == 1
    order = sorted(range(len(at) - 1), key=lambda i: (not positive[i], flat[at[i] : at[i + 1]].tobytes()))  # the same in every run
    x = np.zeros((len(order), len(codes) + 1), np.float32)
    x[:, -1] = 1
    for row, i in enumerate(order):
        x[row, flat[at[i] : at[i + 1]]] = 1
    w, bias = nnpu(x[: positive.sum()], x[positive.sum() :], prior)
    return {"codes": codes, "weights": w, "bias": bias}


class Scorer:
    def __init__(self, model: dict):
        self.model = model
        self.place = {c: i for i, c in enumerate(model["codes"].tolist())}
        self.held = common.Growing(np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.words = common.Words(self._learn, self.held.clear)

    def _learn(self, words: list[bytes]) -> None:
        found = [[self.place[c] for c in codes_of(w.decode()) if c in self.place] for w in words]
        self.held.extend([x for f in found for x in f], [len(f) for f in found])

    def scores(self, texts: list[str]) -> np.ndarray:
        lists = [t.lower().encode().split() for t in texts]
        which = self.words.numbers(lists)
        flat, n = self.held.arrays
        per = n[which]
        owner = np.repeat(np.repeat(np.arange(len(texts)), [len(x) for x in lists]), per)
        width = max(len(self.place), 1)
        present = np.unique(owner * width + common.ragged(flat, common.offsets(n)[:-1][which], per))
        weights = self.model["weights"] if len(self.place) else np.zeros(1)
        f = np.bincount(present // width, weights[present % width], len(texts)) + self.model["bias"]
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _work(docs: DataFrame, model: dict):
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights
    held: list[Scorer] = []

    def scores(block: pa.Table) -> np.ndarray:
        if not held:
            held.append(Scorer(shared.value))
        return held[0].scores(common.texts(block))

    return scores


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5) for each row of docs (doc_id, text).

    A null or empty text has no words: its score is the bias's. Repeated rows each give a row, a null doc_id is kept,
    other columns are ignored. An empty table gives no rows.
    """
    scores = _work(docs, model)

    def work(block: pa.Table) -> list:
        s = scores(block)
        return [s, (s >= 0.5).astype(np.int32)]

    return common.per_document(docs, ["doc_id"], [("score", pa.float64()), ("predicted", pa.int32())], work)


def keep_clean(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, with all their columns, whose score is under 0.5.

    Null and empty texts are scored by the bias; repeated rows all stay or all go; an empty table gives no rows.
    """
    scores = _work(docs, model)
    return common.per_document(docs, docs.columns, [("clean", pa.bool_())], lambda block: [scores(block) < 0.5], "clean")


def learnable(df: DataFrame) -> DataFrame:
    return df.where(common.remainder("doc_id", 5) != 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(learnable(docs), learnable(common.table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", (common.remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")

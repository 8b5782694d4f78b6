"""Operator 5: language identification by averaged hashed subword embeddings and a linear softmax.

A text's features are the byte n-grams of its lower-case words, hashed to buckets. The mean of their embeddings goes
through a linear layer and a softmax. Embeddings and layer are trained by stochastic gradient descent in numpy on a
bounded sample of rows for each language (QUOTA); as the model is linear in the features, a word's part in the result
is computed once in a worker. A part of the sample is kept from training: it sets the temperature of the softmax, and
the score under which a prediction counts as rejected (column rejected; lang_pred stays the likeliest language).

Prediction is one pass over the texts, without a shuffle. The driver holds the sample's bucket counts only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog.llm import common

#: A power of 2.
BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
WIDTH = 16
#: Rows of each language in the training sample, about; all languages take part.
QUOTA = 300
#: Share of the sample that sets temperature and rejection; correct predictions of it that aren't rejected.
HELD, TRUST = 0.2, 0.99


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of each word between spaces, word after word; and how many each has."""
    data = np.frombuffer(b"".join(b" " + w + b" " for w in words), np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    own = np.repeat(np.arange(len(words)), lengths)
    found, owner = [], []
    place = np.arange(len(data))
    code = np.zeros(len(data), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        last = len(data) - n + 1
        code[:last] |= data[n - 1 :] << np.uint64(8 * (n - 1))
        if n in GRAMS:
            good = np.flatnonzero(place[:last] + n <= ends[:last])
            mixed = (code[good] + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((mixed >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64))
            owner.append(own[good])
    buckets, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return buckets[order], np.bincount(owner, minlength=len(words))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = 12, rate: float = 0.5, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, their shares in the text, class) of each row: embeddings and the linear layer."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    w = np.zeros((WIDTH, n_classes), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(rows)):
            buckets, part, y = rows[i]
            x = part @ e[buckets]
            g = softmax((x @ w)[None])[0]
            g[y] -= 1
            back = w @ g
            w -= step * np.outer(x, g)
            e[buckets] -= step * 20 * part[:, None] * back  # shares are small, so each bucket takes a longer step
    return e, w


def calibrate(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Temperature with the least loss, and the score that TRUST of the correct predictions reach."""
    if not len(y):
        return 1.0, 0.0
    loss = {t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.05, 20, 61)}
    t = min(loss, key=loss.get)
    p = softmax(logits / t)
    good = p.max(axis=1)[p.argmax(axis=1) == y]
    return float(t), float(np.quantile(good, 1 - TRUST)) if len(good) else 0.0


def fit(docs: DataFrame, seed: int = 5) -> dict:
    """A model from rows of docs (doc_id, text, lang); rows without lang or letter teach nothing."""
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull())
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    labels = sorted(r["lang"] for r in counts)
    if not labels:
        return {"labels": []}
    rates = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, QUOTA / r["n"]))])
    sample = common.sampled(known, F.element_at(rates, F.col("lang")), seed)
    common.arrow(spark)

    def features(batches):
        for block in common.blocks(batches):
            out = []
            for text in common.texts(block):
                words = words_of(text) if has_letter(text) else []
                b, n = np.unique(word_features(words)[0], return_counts=True) if words else (np.zeros(0, int), np.zeros(0, int))
                out.append((b, n))
            lists = [pa.array([x[i] for x in out], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()).combine_chunks(), block.column("lang").combine_chunks(), *lists], ["doc_id", "lang", "buckets", "counts"])

    rows = sample.select("doc_id", "text", "lang").mapInArrow(features, "doc_id long, lang string, buckets array<long>, counts array<long>").where(F.size("buckets") > 0).collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"], r["buckets"]))
    place = {x: i for i, x in enumerate(labels)}
    data = [(np.array(r["buckets"]), (np.array(r["counts"]) / sum(r["counts"])).astype(np.float32), place[r["lang"]]) for r in rows]
    rng = np.random.default_rng(seed)
    apart = rng.random(len(data)) < HELD
    e, w = train([x for x, a in zip(data, apart, strict=True) if not a], len(labels))
    held = [x for x, a in zip(data, apart, strict=True) if a]
    logits = np.array([part @ e[b] @ w for b, part, _ in held]).reshape(-1, len(labels))
    temperature, least = calibrate(logits, np.array([y for *_, y in held], int))
    return {"labels": labels, "parts": (e @ w / temperature).astype(np.float32), "least": least}


class Predictor:
    def __init__(self, model: dict):
        self.model = model
        c = len(model["labels"])
        self.held = common.Growing(np.zeros((0, c + 1), np.float32))
        self.words = common.Words(self._learn, self.held.clear)

    def _learn(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 100_000):
            buckets, n = word_features(words[i : i + 100_000])
            total = common.sums(self.model["parts"][buckets], common.offsets(n))
            self.held.extend(np.column_stack([total, n]))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """lang_pred, score, rejected."""
        labels = self.model["labels"]
        letters = np.array([has_letter(t) for t in texts], bool)
        if not labels:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        lists = [words_of(t) if x else [] for t, x in zip(texts, letters, strict=True)]
        which = self.words.numbers(lists)
        total = common.sums(self.held.arrays[0][which], common.offsets([len(x) for x in lists]))
        p = softmax(total[:, :-1] / np.maximum(total[:, -1:], 1))
        best, score = p.argmax(axis=1), np.where(letters, p.max(axis=1), 0.0)
        return [labels[b] if x else "und" for b, x in zip(best.tolist(), letters.tolist(), strict=True)], score, score < self.model["least"]


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row of docs (doc_id, text).

    A null text, or one without a letter, is und with score 0 and rejected; so is every text if no language was
    learned. Repeated rows each give a row, a null doc_id is kept, other columns are ignored, ties go to the first
    label in alphabetical order. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages
    held: list[Predictor] = []

    def work(block: pa.Table) -> list:
        if not held:
            held.append(Predictor(shared.value))
        return list(held[0].predict(common.texts(block)))

    return common.per_document(docs, ["doc_id"], [("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())], work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.remainder("doc_id", 4) == 2
    model = fit(docs.where(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")

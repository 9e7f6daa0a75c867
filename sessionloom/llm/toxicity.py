"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sessionloom.llm.base import drawn, id_fold, per_batch, table

BITS = 20
_WORD = re.compile(r"\w+")


class Features:
    """Distinct hashed features of a text: words, pairs of neighbours, and pairs with one or two words between."""

    def __init__(self, bits: int = BITS, words: int = 200_000) -> None:
        self.mask, self.words, self.cache = np.uint64((1 << bits) - 1), words, {}

    def _hash(self, word: str) -> int:
        value = self.cache.get(word)
        if value is None:
            if len(self.cache) >= self.words:
                self.cache.clear()
            value = self.cache[word] = zlib.crc32(word.encode()) + 1
        return value

    def __call__(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        h = np.fromiter(map(self._hash, words), np.uint64, len(words))
        parts = [h * np.uint64(0x9E3779B97F4A7C15)]
        for gap, salt in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9), (3, 0x27D4EB2F165667C5)):
            if len(h) > gap:
                parts.append((h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:]) * np.uint64(salt))
        mixed = np.concatenate(parts)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return np.unique((mixed >> np.uint64(32)) & self.mask).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal; the last coordinate is the intercept, free of L1."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        step = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / step)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        gradient = sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + gradient * gradient


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 16_384, epochs: int = 3, bits: int = BITS,
          alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights (intercept last), learned from (doc_id, toxic) labels.

    At most about ``max_rows`` labelled rows are used, chosen by a hash of their id. Their features
    are made in parallel; FTRL, which is sequential, then runs over this bounded sample in one task.
    The result has at most 2 ** bits + 1 weights, far fewer by L1. A repeated label counts once, as 1 if any
    is 1; labels other than 0 and 1 are ignored. No labels: no weights.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    share = min(1.0, max_rows / max(1, known.count()))
    picked = known.where(drawn("doc_id", share))
    rows = docs.select("doc_id", "text").join(picked, "doc_id").select("doc_id", "label", "text")
    size = 1 << bits

    def make():
        features = Features(bits)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = pa.array([features(t.as_py() or "").astype(np.int32) for t in batch.column(2)], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(batch.column(0).cast(pa.string())), batch.column(1), found], ["doc_id", "label", "features"])

        return step

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(f.values.to_numpy(), y.as_py()) for batch in batches for y, f in zip(batch.column(0), batch.column(1))]
        if seen:
            model, order = Ftrl(size, alpha, beta, l1, l2), np.random.default_rng(7)
            for _ in range(epochs):
                for i in order.permutation(len(seen)):
                    model.learn(seen[i][0].astype(np.int64), seen[i][1])
            w = model.weights(np.arange(size + 1))
            kept = np.append(np.nonzero(w[:-1])[0], size)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(w[kept], pa.float64())], ["feature", "weight"])

    label = dict(labels.dtypes)["toxic"]
    featured = rows.mapInArrow(per_batch(make, 1 << 20), f"doc_id string, label {label}, features array<int>")
    one = featured.repartition(1).sortWithinPartitions("doc_id", "features").select("label", "features")
    got = one.mapInArrow(fit, "feature long, weight double").orderBy("feature").collect()
    return np.array([r["feature"] for r in got], np.int64), np.array([r["weight"] for r in got])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS, keep: list[str] | None = None) -> DataFrame:
    """doc_id, score: probability of label 1 for every whole text; 0 without a model.

    With ``keep``, those columns and ``__score`` instead, row by row. Null text is scored as empty text: by the
    intercept alone. Ids may be null or repeat; other columns are ignored.
    """
    at, w = model
    keep = ["doc_id"] if keep is None else keep
    name = "score" if keep == ["doc_id"] else "__score"
    wanted = docs.select(*keep, F.col("text").alias("__text"))

    def make():
        features, dense = Features(bits), np.zeros((1 << bits) + 1, np.float32)
        dense[at] = w

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(batch.num_columns - 1)
            if len(at):
                out = [sigmoid(float(dense[features(t.as_py() or "")].sum(dtype=np.float64)) + float(dense[-1])) for t in texts]
            else:
                out = [0.0] * batch.num_rows
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], [*keep, name])

        return step

    schema = StructType([*wanted.schema.fields[:-1], StructField(name, DoubleType())])
    return wanted.mapInArrow(per_batch(make, 1 << 20), schema)


def learnable(labels: DataFrame) -> DataFrame:
    """Label rows outside the held-out fold."""
    return labels.where(id_fold("doc_id", 5) != 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, train(docs, learnable(labels)))
    return scored.select("doc_id", F.coalesce(id_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

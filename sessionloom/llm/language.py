"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.base import drawn, id_fold, per_batch, table

DIMENSIONS = 1024
_QUANTUM = 1 << 20
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """True for every code point that is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


class Profiler:
    """Bundle of a text's letter trigrams.

    Every letter (and the gap between words) has a random vector of +1 and -1 drawn from its
    code point; a trigram binds the first one's vector turned by two, the second's by one
    and the third's: their product. A text is the sum over its trigrams. Trigram vectors are kept
    in a bounded table.
    """

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 17, slots: int = 12_288) -> None:
        self.dimensions, self.seed, self.slots = dimensions, seed, slots
        self.table = np.empty((slots, dimensions), np.float32)
        self._reset()

    def _reset(self) -> None:
        self.keys, self.rows = np.empty(0, np.int64), np.empty(0, np.int64)

    def _letter(self, cache: dict[int, np.ndarray], code: int) -> np.ndarray:
        if code not in cache:
            cache[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions).astype(np.int8) * 2 - 1
        return cache[code]

    def _add(self, missing: np.ndarray) -> None:
        if len(self.keys) + len(missing) > self.slots:
            self._reset()
        at, cache = len(self.keys), {}
        for i, key in enumerate(missing.tolist()):
            a, b, c = (self._letter(cache, key >> s & 0x1FFFFF) for s in (42, 21, 0))
            self.table[at + i] = np.roll(a, 2) * np.roll(b, 1) * c
        keys = np.concatenate([self.keys, missing])
        rows = np.concatenate([self.rows, np.arange(at, at + len(missing))])
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], rows[order]

    def _known(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def __call__(self, text: str) -> np.ndarray | None:
        """The text's vector; None if it has no letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes = np.where(letters()[codes], codes, 0)
        if not codes.any():
            return None
        codes = np.concatenate([[0], codes, [0]])
        codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]
        found, counts = np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)
        out = np.zeros(self.dimensions)
        for i in range(0, len(found), self.slots):
            part = found[i : i + self.slots]
            missing = part[~self._known(part)]
            if len(missing):
                if len(self.keys) + len(missing) > self.slots:
                    self._reset()
                    missing = part
                self._add(missing)
            rows = self.rows[np.searchsorted(self.keys, part)]
            out += counts[i : i + self.slots].astype(np.float32) @ self.table[rows]
        return out


def prototypes(docs: DataFrame, max_rows: int = 24_000, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit vector per language from (text, lang) rows: the sum of its documents' unit vectors.

    At most about ``max_rows`` rows are used, chosen by a hash of the id. Sums are of rounded
    integers, so they do not depend on the order of rows. Bounded by languages times dimensions.
    """
    known = docs.where("lang is not null and doc_id is not null")
    share = min(1.0, max_rows / max(1, known.count()))
    picked = known.where(drawn("doc_id", share)).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile, sums = Profiler(dimensions), {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                v = profile(text.as_py() or "")
                if v is not None:
                    unit = np.rint(v / max(np.linalg.norm(v), 1e-12) * _QUANTUM).astype(np.int64)
                    sums[lang.as_py()] = sums.get(lang.as_py(), 0) + unit
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(v, pa.int64())], ["lang", "i", "x"])

    got = picked.mapInArrow(run, "lang string, i int, x long").groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    out: dict[str, np.ndarray] = {}
    for r in got:
        out.setdefault(r["lang"], np.zeros(dimensions))[r["i"]] = r["x"]
    return {k: v / max(np.linalg.norm(v), 1e-12) for k, v in sorted(out.items())}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, lang_pred, score for every whole text: the nearest prototype and its cosine (0 if negative).

    Null text, text without letters, or no prototypes at all: ``und`` with score 0. Equal cosines go to the
    first name. Ids may be null or repeat; other columns are ignored.
    """
    names, matrix = list(profiles), np.array([profiles[k] for k in profiles])
    kind = dict(docs.dtypes)["doc_id"]

    def make():
        profile = Profiler(dimensions)

        def one(text: str | None) -> tuple[str, float]:
            v = profile(text or "") if names else None
            if v is None:
                return "und", 0.0
            cosines = matrix @ v / max(np.linalg.norm(v), 1e-12)
            best = int(np.argmax(cosines))
            return names[best], float(np.clip(cosines[best], 0, 1))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [one(t.as_py()) for t in batch.column(1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

        return step

    return docs.select("doc_id", "text").mapInArrow(per_batch(make), f"doc_id {kind}, lang_pred string, score double")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = identify(docs, prototypes(docs.where(id_fold("doc_id", 4) != 2)))
    return named.select("doc_id", F.coalesce(id_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")

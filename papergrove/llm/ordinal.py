"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w . x) with one weight vector w over hashed text features and ordered
thresholds. The expected grade is the sum of the tails P(grade >= k); a tail selects documents.

Features are hashed word features averaged over the text's words (the lower-cased letters of a word, and its shape:
case, digits, and the other characters), and a few features of the whole text (length, repeated lines, repeated
words, by magnitude). A word's share of w . x does not depend on its neighbours, so scoring keeps it per distinct word.

The model is fitted on the driver from at most `sample` labelled rows, taken in hash order of doc_id (a documented
bound for the fit alone); every row of docs is scored on its whole text. Of ratings that differ for a doc_id the least
counts, and of its texts the least, so a fit repeats. All characters of a word count, however long it is.

Null and empty texts have no words and are scored by the whole-text features; an empty table gives no rows; repeated rows are scored each; without
labels of two grades, all rows get the one grade there is (or 0) and are kept. Further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import has, prepare

BITS = 18
#: Bytes of words remembered by a worker, each with so many besides; beyond it the memory starts anew.
MEMORY, WORD = 56 << 20, 140
_GAPS = re.compile(r"[\t\n\v\f\r]")
_RUN = re.compile(r"(.)\1+", re.S)
_LETTERS = str.maketrans({c: "a" for c in "bcdefghijklmnopqrstuvwxyz"} | {c: "A" for c in "BCDEFGHIJKLMNOPQRSTUVWXYZ"} | {c: "9" for c in "012345678"})


def _slot(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode("utf-8", "replace")) >> (32 - BITS)


def word_features(piece: str) -> tuple[int, ...]:
    """Slots of one white-space piece."""
    core = "".join(c for c in piece if c.isalpha())
    shape = _RUN.sub(r"\1", "".join("a" if c.islower() else "A" if c.isupper() else c for c in piece).translate(_LETTERS))
    other = "".join(sorted({c for c in piece if not c.isalpha()}))
    return _slot("word", core.lower()), _slot("shape", shape), _slot("other", other)


def text_features(text: str, words: list[str]) -> tuple[int, ...]:
    """Slots of the whole text, each of value 1."""
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda a, b: int(8 * a / b) if b else -1
    return _slot("length", str(len(words).bit_length())), _slot("lines", str(share(len(set(lines)), len(lines)))), _slot("distinct", str(share(len(set(words)), len(words)))), _slot("bias", "")


def pieces(text: str | None) -> list[str]:
    return [w for w in _GAPS.sub(" ", text or "").split(" ") if w]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text, for fitting."""
    words = pieces(text)
    total: dict[int, float] = {}
    for w in words:
        for s in word_features(w):
            total[s] = total.get(s, 0.0) + 1.0 / len(words)
    for s in text_features(text or "", words):
        total[s] = total.get(s, 0.0) + 1.0
    at = np.array(sorted(total), np.int32)
    return at, np.array([total[s] for s in at.tolist()], np.float32)


@dataclass
class Ordinal:
    """Weights and ordered thresholds; grades are 0 to len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray
    word: dict[str, float] = field(default_factory=dict, repr=False)
    held: int = field(default=0, repr=False)

    def tails(self, score: float) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -50, 50)))

    def score(self, text: str | None) -> float:
        words, known, total = pieces(text), self.word, 0.0
        try:
            total = sum([known[w] for w in words])
        except KeyError:
            if self.held > MEMORY:
                known.clear()
                self.held = 0
            for w in words:
                if w not in known:
                    known[w] = float(sum(self.weights[s] for s in word_features(w)))
                    self.held += len(w) + WORD
            total = sum([known[w] for w in words])
        whole = sum(float(self.weights[s]) for s in text_features(text or "", words))
        return total / max(1, len(words)) + whole


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, rounds: int = 250, rate: float = 0.1, penalty: float = 1e-5) -> Ordinal:
    """Penalised maximum likelihood by Adam over the whole sample; thresholds stay ordered by positive gaps."""
    top = int(grades.max()) if len(grades) else 0
    if top == 0 or len(np.unique(grades)) < 2:
        return Ordinal(np.zeros(1 << BITS, np.float32), np.full(top, -50.0))
    size = np.array([len(a) for a, _ in rows])
    row = np.repeat(np.arange(len(rows)), size)
    slot, at = np.unique(np.concatenate([a for a, _ in rows]), return_inverse=True)
    value = np.concatenate([v for _, v in rows]).astype(np.float64)
    n, k = len(rows), top
    p = np.zeros(len(slot) + k)
    share = np.array([np.clip((grades >= j).mean(), 1e-3, 1 - 1e-3) for j in range(1, k + 1)])
    start = -np.log(share / (1 - share))
    p[len(slot)] = start[0]
    p[len(slot) + 1 :] = np.log(np.maximum(np.diff(start), 1e-2))
    m, s = np.zeros_like(p), np.zeros_like(p)
    for r in range(1, rounds + 1):
        w, gaps = p[: len(slot)], np.exp(np.clip(p[len(slot) + 1 :], -10, 10))
        cut = np.concatenate([[-np.inf], p[len(slot)] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(row, w[at] * value, n)
        low, high = cut[grades] - score, cut[grades + 1] - score
        sl, sh = (1 / (1 + np.exp(-np.clip(x, -50, 50))) for x in (low, high))
        sl, sh = np.where(np.isneginf(low), 0, sl), np.where(np.isposinf(high), 1, sh)
        inside = np.maximum(sh - sl, 1e-12)
        dl, dh = sl * (1 - sl) / inside / n, sh * (1 - sh) / inside / n  # of the log-likelihood, by low and high
        g = np.empty_like(p)
        g[: len(slot)] = np.bincount(at, ((dh - dl)[row]) * value, len(slot)) + penalty * w
        by_cut = np.bincount(grades + 1, -dh, k + 2) + np.bincount(grades, dl, k + 2)
        by_cut = by_cut[1 : k + 1]
        g[len(slot)] = by_cut.sum()
        for j in range(1, k):
            g[len(slot) + j] = by_cut[j:].sum() * gaps[j - 1]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**r)) / (np.sqrt(s / (1 - 0.999**r)) + 1e-9)
    weights = np.zeros(1 << BITS, np.float32)
    weights[slot] = p[: len(slot)]
    return Ordinal(weights, p[len(slot)] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(p[len(slot) + 1 :], -10, 10)))]))


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from 0 to 2 of a label table: 0 poor, 1 well written but toxic, 2 well written and clean."""
    grade: Column = F.when(F.col("quality") < 1, 0).when(F.col("toxic") > 0, 1).otherwise(2)
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", grade.cast("int").alias("grade"))


def train(spark: SparkSession, docs: DataFrame, ratings: DataFrame, sample: int = 3000) -> Ordinal:
    """Fits to at most `sample` rated rows (doc_id, grade), the first in hash order."""
    prepare(spark)
    chosen = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = has(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("doc_id", "grade", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], ["doc_id", "grade", "slots", "vals"])

    found = rows.mapInArrow(extract, "doc_id long, grade int, slots binary, vals binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["slots"], r["vals"]))
    return fit([(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["vals"], np.float32)) for r in found], np.array([r["grade"] for r in found], np.int64))


def classify(spark: SparkSession, docs: DataFrame, model: Ordinal, tail: int = 1, least: float = 0.5, keep_rows: bool = False) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) of every row; with keep_rows, the rows of docs that are kept.

    kept: P(grade >= tail) is at least `least`.
    """
    prepare(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.thresholds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*shared.value)
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            tails = [own.tails(own.score(t)) for t in texts.to_pylist()]
            p = np.array([t[tail - 1] if len(t) >= tail else 1.0 for t in tails])
            kept = pa.array(p >= least)
            if keep_rows:
                yield b.filter(kept)
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([float(t.sum()) for t in tails]), pa.array(p), kept], ["doc_id", "expected_grade", "tail_probability", "kept"])

    if keep_rows:
        return docs.mapInArrow(score, docs.schema)
    return has(docs, "doc_id", "text").mapInArrow(score, "doc_id long, expected_grade double, tail_probability double, kept boolean")

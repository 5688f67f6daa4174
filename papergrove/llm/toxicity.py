"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context-window scores.

The lexicon is learned from labelled rows: words, and word beginnings that branch into several such words, whose
share of toxic documents is far over their share of clean ones. A word of a text is looked up in the trie exactly,
by a beginning, and, if it has at least FUZZY letters, through its Levenshtein automaton of one edit: the walk goes
down the trie only where the automaton can still accept, so misspelled terms are found without trying all terms. A
word has a half of its letters in place after one edit, so words that share no half with a term are not walked.
Near words that occur in clean labelled documents are harmless.

A hit's weight depends on the words around it: inside quotation marks, or after a word of reporting, it counts less
(quotation); next to other hits it counts more (abuse). A logistic model over the hits of a document, fitted to
the same labelled rows, gives its score.

The lexicon and model are fitted on at most `sample` labelled rows, the first in hash order of doc_id (a documented
bound for the fit alone); all their terms are tested, in Spark, and those that pass are collected. Of a doc_id with
several texts the least text is learned from, and of labels that differ the toxic one. Of copies one is learned from:
a row goes if another of its label and of a smaller doc_id shares one of BANDS least shingles of three words with it and
ALIKE of SIGNATURE, which tells a similarity of about 0.4: variants of one text share words that tell their group, and
would pass for terms. Every row is scored on its whole text, in time linear in it.

Null and empty texts have no hits and get the score of a text without any; repeated rows are scored each; a null doc_id
is not held out and has no label; without toxic and clean labels every score is 0; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import drop, has, prepare, stage
from .words import mix, shingles, slices

WORD = re.compile(r"\w+")
#: Least letters for a misspelling, words to each side of a hit, words remembered by a worker.
FUZZY, WINDOW, MEMORY = 5, 6, 400_000
#: Least shingles of a labelled row, those of them that rows meet by, and those that copies share at least.
SIGNATURE, BANDS, ALIKE = 16, 8, 6
#: Words of reporting, quotation marks that open and close, and the marks that do both.
REPORTS = frozenset("said says wrote quote quoted called dit écrit sagte schrieb dijo escribió".split())
OPENING, CLOSING, BOTH = "“«„‘", "”»“’", "\""
#: Weight of a quoted hit, of a near miss, and of each further hit nearby (three at most).
QUOTED, NEAR, COMPANY = 0.35, 0.8, 0.25


class Automaton:
    """Levenshtein automaton of a word for some edits. A state is the sparse row of positions within reach."""

    def __init__(self, word: str, edits: int = 1):
        self.word, self.edits = word, edits

    def start(self) -> tuple[tuple[int, ...], tuple[int, ...]]:
        n = min(self.edits, len(self.word)) + 1
        return tuple(range(n)), tuple(range(n))

    def step(self, state: tuple, letter: str) -> tuple:
        at, cost = state
        to, new = ([0], [cost[0] + 1]) if at and at[0] == 0 and cost[0] < self.edits else ([], [])
        for k, i in enumerate(at):
            if i == len(self.word):
                break
            c = cost[k] + (self.word[i] != letter)
            if to and to[-1] == i:
                c = min(c, new[-1] + 1)
            if k + 1 < len(at) and at[k + 1] == i + 1:
                c = min(c, cost[k + 1] + 1)
            if c <= self.edits:
                to.append(i + 1)
                new.append(c)
        return tuple(to), tuple(new)

    def accepts(self, state: tuple) -> bool:
        return bool(state[0]) and state[0][-1] == len(self.word)

    def alive(self, state: tuple) -> bool:
        return bool(state[0])


class Trie:
    """Terms by letter; "" marks the end of a term."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.root: dict = {}
        self.terms, self.stems = set(terms), set(stems)
        self.stem_sizes = sorted({len(s) for s in stems})
        self.heads, self.tails = set(), set()
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t
            if len(t) >= FUZZY:
                self.heads.add(t[: len(t) // 2])
                self.tails.add(t[len(t) // 2 :])
        self.head_sizes, self.tail_sizes = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.tails})

    def near(self, word: str, edits: int = 1) -> str | None:
        """The first term (by letters) within the edits of a word: the automaton's walk of the trie."""
        automaton = Automaton(word, edits)
        stack = [(self.root, automaton.start())]
        found = None
        while stack:
            node, state = stack.pop()
            term = node.get("")
            if term and len(term) >= FUZZY and automaton.accepts(state) and (found is None or term < found):
                found = term
            for letter, below in node.items():
                if letter and automaton.alive(after := automaton.step(state, letter)):
                    stack.append((below, after))
        return found

    def half(self, word: str) -> bool:
        return any(word[:n] in self.heads for n in self.head_sizes) or any(word[-n:] in self.tails for n in self.tail_sizes)

    def look_up(self, word: str, harmless: frozenset[str] = frozenset()) -> float:
        """1 for a term or a beginning, NEAR for a misspelled term, else 0."""
        if word in self.terms or any(word[:n] in self.stems for n in self.stem_sizes if n <= len(word)):
            return 1.0
        if len(word) >= FUZZY and word not in harmless and self.half(word) and self.near(word):
            return NEAR
        return 0.0


@dataclass
class Toxic:
    """The fitted lexicon and the logistic weights: bias, hits, density, strongest hit."""

    terms: list[str]
    stems: list[str]
    harmless: frozenset[str]
    weights: tuple[float, ...]
    found: dict[str, float] = field(default_factory=dict, repr=False)
    trie: Trie | None = field(default=None, repr=False)

    def hits(self, text: str | None) -> tuple[list[tuple[int, str, float]], int]:
        """(place among the words, word, weight by context) of each hit, and the number of words."""
        if not text:
            return [], 0
        self.trie = self.trie or Trie(self.terms, self.stems)
        low = text.lower()
        words = WORD.findall(low)
        known = self.found
        if len(known) > MEMORY:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.trie.look_up(w, self.harmless)
        at = [k for k, v in enumerate(map(known.__getitem__, words)) if v]
        if not at:
            return [], len(words)
        quoted = self._quoted(low, set(at))
        out = []
        for k in at:
            weight = known[words[k]]
            if k in quoted or not REPORTS.isdisjoint(words[max(0, k - WINDOW) : k]):
                weight *= QUOTED
            else:
                weight *= 1 + COMPANY * min(3, bisect_right(at, k + WINDOW) - bisect_left(at, k - WINDOW) - 1)
            out.append((k, words[k], weight))
        return out, len(words)

    @staticmethod
    def _quoted(low: str, at: set[int]) -> set[int]:
        """Which of the words stand inside quotation marks of their line."""
        out, k = set(), 0
        if not any(c in low for c in OPENING + BOTH):
            return out
        for line in low.split("\n"):
            depth, end, last = 0, 0, max(line.rfind(c) for c in CLOSING + BOTH)
            for m in WORD.finditer(line):
                for c in line[end : m.start()]:
                    if c in BOTH:
                        depth = 0 if depth else 1
                    elif depth and c in CLOSING:
                        depth = 0
                    elif c in OPENING:
                        depth = 1
                end = m.end()
                if depth and k in at and last >= end:
                    out.add(k)
                k += 1
        return out

    def features(self, text: str | None) -> list[float]:
        hits, n = self.hits(text)
        weights = [w for _, _, w in hits]
        return [1.0, float(np.log1p(sum(weights))), float(np.log1p(100 * sum(weights) / max(n, 1))), max(weights, default=0.0)]

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights, self.features(text)), -50, 50)))) if self.weights else 0.0


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def terms_of(text: str) -> set[str]:
    """Distinct words of letters, and the beginnings of the longer ones (marked by a final *)."""
    words = {w for w in WORD.findall(text.lower()) if w.isalpha()}
    return words | {w[:k] + "*" for w in words for k in range(4, min(len(w), 8))}


def telling(n_toxic: int, n_clean: int, least: int, looked_at: int) -> Callable[[str, int, int, int], bool]:
    """The test of a word or beginning in a toxic and b clean documents; below is the largest count among what it goes on to.

    A term must be far more frequent in toxic documents, and too frequent there to be chance: its binomial tail,
    times the number of terms looked at, is at most 0.05.
    """
    share = n_toxic / (n_toxic + n_clean)

    def chance(a: int, b: int) -> float:
        n = a + b
        terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share) for k in range(a, n + 1)]
        return math.fsum(map(math.exp, terms))

    def good(t: str, a: int, b: int, below: int) -> bool:
        stem = t.endswith("*")
        if a < least or (a + 0.5) / (n_toxic + 1) < (40 if stem else 20) * (b + 0.5) / (n_clean + 1) or a < 4 * b:
            return False
        return (not stem or below < 0.9 * a) and chance(a, b) * looked_at <= 0.05

    return good


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton steps on the penalised log-likelihood; weights of hits are kept from falling below 0."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + penalty * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Toxic:
    """Fits the lexicon and the model to at most `sample` labelled rows whose doc_id is not held out."""
    prepare(spark)
    open_rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    chosen = open_rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = has(docs, "doc_id", "text")

    def least_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys: list[list[int]] = []
            for part in slices(b.column(2)):
                h, at = part.hashes(lower=True), part.bounds()
                for k in range(part.n_docs):
                    x = shingles(h[at[k] : at[k + 1]], 3)
                    keys.append([int(mix(x ^ np.uint64(salt * 0x51ED27)).min()) - (1 << 63) if len(x) else 0 for salt in range(SIGNATURE)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "toxic", "text", "m"])

    # at most `sample` rows from here on: one text of each doc_id, whatever docs repeats
    one = labelled.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    one = stage(spark, one.mapInArrow(least_shingles, "doc_id long, toxic int, text string, m array<long>"), "labelled")
    gone = None
    for k in range(BANDS):
        first = one.groupBy("toxic", F.col("m")[k].alias("key")).agg(F.min(F.struct("doc_id", "m")).alias("f")).select(F.col("toxic").alias("t"), "key", "f.*").toDF("t", "key", "d", "other")
        alike = F.aggregate(F.arrays_zip("m", "other"), F.lit(0), lambda n, x: n + (x["m"] == x["other"]).cast("int"))
        met = one.join(first, (one["toxic"] == first["t"]) & (one["m"][k] == first["key"])).where((F.col("doc_id") > F.col("d")) & (alike >= ALIKE)).select("doc_id")
        gone = met if gone is None else gone.unionByName(met)
    rows = stage(spark, one.join(F.broadcast(gone.distinct()), "doc_id", "left_anti").select("doc_id", "toxic", "text"), "learned")
    drop(spark, one)

    def count(toxic: bool) -> DataFrame:
        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                total: Counter[str] = Counter()
                for label, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    if (label > 0) == toxic:
                        total[""] += 1
                        total.update(terms_of(text or ""))
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "docs"])

        return stage(spark, rows.mapInArrow(counted, "term string, docs long").groupBy("term").agg(F.sum("docs").alias("docs")), "terms")

    often, clean = count(True), count(False)
    n_toxic, n_clean = ((c.where("term = ''").agg(F.sum("docs")).first()[0]) or 0 for c in (often, clean))
    if not n_toxic or not n_clean:
        return Toxic([], [], frozenset(), ())
    least = max(3, round(0.002 * n_toxic))
    often = often.where(f"term <> '' AND docs >= {least}")
    good = telling(n_toxic, n_clean, least, often.count())
    longer = often.withColumn("size", F.expr("length(trim(TRAILING '*' FROM term))")).where("size > 4")
    below = longer.select("docs", F.explode(F.expr("transform(sequence(4, least(8, size - 1)), k -> substr(term, 1, k) || '*')")).alias("term")).groupBy("term").agg(F.max("docs").alias("below"))

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([good(*r) for r in zip(*(c.to_pylist() for c in b.columns))], pa.bool_()))

    known = often.join(clean.withColumnRenamed("docs", "clean"), "term", "left").join(below, "term", "left")
    known = known.select("term", "docs", F.coalesce("clean", F.lit(0)).cast("long").alias("clean"), F.coalesce("below", F.lit(0)).cast("long").alias("below"))
    found = sorted(r["term"] for r in known.mapInArrow(tested, "term string, docs long, clean long, below long").collect())
    terms, stems = [t for t in found if not t.endswith("*")], [t[:-1] for t in found if t.endswith("*")]
    stems = [s for s in stems if not any(s != o and s.startswith(o) for o in stems)]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Toxic(terms, stems, frozenset(), ())
        for b in batches:
            labels, near = b.column(1).to_pylist(), []
            for text in b.column(2).to_pylist():
                near.append(sorted({w for _, w, _ in model.hits(text)[0] if model.found[w] == NEAR}))
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(near, pa.list_(pa.string()))], ["toxic", "near"])

    near = rows.mapInArrow(look, "toxic int, near array<string>").select("toxic", F.explode("near").alias("word")).groupBy("word").agg(F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("clean"), F.count("*").alias("docs"))
    harmless = frozenset(r["word"] for r in near.where("10 * clean * {0} >= docs * {1}".format(n_clean + n_toxic, n_clean)).collect())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Toxic(terms, stems, harmless, ())
        for b in batches:
            found = [model.features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(b.column(1).to_pylist(), pa.int32()), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    got = rows.mapInArrow(measure, "doc_id long, toxic int, x array<double>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    x, y = np.array([r["x"] for r in got]), np.array([r["toxic"] > 0 for r in got], float)
    return Toxic(terms, stems, harmless, tuple(float(w) for w in fit_logistic(x, y)))


def toxicity(spark: SparkSession, docs: DataFrame, model: Toxic, least: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_hits, hits) of every row; hits lists the distinct words found."""
    prepare(spark)
    shared = spark.sparkContext.broadcast((model.terms, model.stems, model.harmless, model.weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Toxic(*shared.value)
        for b in batches:
            ids, scores, n, words = b.column(0).to_pylist(), [], [], []
            for text in b.column(1).to_pylist():
                hits, size = own.hits(text)
                weights = [w for _, _, w in hits]
                x = [1.0, float(np.log1p(sum(weights))), float(np.log1p(100 * sum(weights) / max(size, 1))), max(weights, default=0.0)]
                scores.append(float(1 / (1 + np.exp(-np.clip(np.dot(own.weights, x), -50, 50)))) if own.weights else 0.0)
                n.append(len(hits))
                words.append(sorted({w for _, w, _ in hits}))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([held_out(d) for d in ids]), pa.array(scores, pa.float64()), pa.array([int(s >= least) for s in scores], pa.int32()), pa.array(n, pa.int64()), pa.array(words, pa.list_(pa.string()))], ["doc_id", "held_out", "score", "predicted", "n_hits", "hits"])

    return has(docs, "doc_id", "text").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, n_hits long, hits array<string>")

"""Toxicity as an ordinal severity: a cumulative-link (proportional odds) model on words.

P(severity > k) = sigmoid(w . x - cut_k) with one weight vector for all cuts, which are in order.
Words are maximal runs of letters, lower-cased, each counted once a document. Features are words and
word beginnings of 4 to 7 letters (written ``achli*``), which find inflected and compound forms; a feature's value is
log2(1 + number of distinct words that have it).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, cut, one_text, slices, table

LETTERS = re.compile(r"[^\W\d_]+")
TOP = 3  # grades 0 to TOP

#: Letters of a word beginning.
STEMS = (4, 5, 6, 7)


def features_of(text: str) -> dict[str, float]:
    words = set(LETTERS.findall(text.lower()))
    return dict.fromkeys(words, 1.0) | {f"{p}*": math.log2(1 + n) for k in STEMS for p, n in Counter([w[:k] for w in words if len(w) > k]).items()}


def feature_sum(text: str, weights: dict[str, float], stems: dict[str, float]) -> float:
    """The weighted sum of ``features_of``; ``stems`` are the weights of word beginnings, without the star."""
    words = set(LETTERS.findall(text.lower()))
    out = sum(weights[w] for w in sorted(words & weights.keys()))
    if stems:
        begin = Counter([p for w in words for k in STEMS if len(w) > k and (p := w[:k]) in stems])
        out += sum(stems[p] * math.log2(1 + begin[p]) for p in sorted(begin))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class OrdinalModel:
    weights: dict[str, float]
    cuts: list[float]  # ascending
    _stems: dict[str, float] | None = None

    def expected(self, text: str | None) -> float:
        """Expected severity: the sum over k of P(severity > k)."""
        if not self.cuts:
            return 0.0
        if self._stems is None:
            self._stems = {k[:-1]: a for k, a in self.weights.items() if k[-1] == "*"}
        return float(sigmoid(feature_sum(text or "", self.weights, self._stems) - np.array(self.cuts)).sum())


def tell(bad: float, good: float, n_bad: int, n_good: int, least: int = 5, z: float = 4.0) -> float | None:
    """Log odds of standing in a toxic text, if the feature is in ``least`` texts or more and they differ from 0 by ``z`` standard errors."""
    if bad + good < least:
        return None
    cells = (bad + 0.5, n_bad - bad + 0.5, good + 0.5, n_good - good + 0.5)
    odds = math.log(cells[0] / cells[1]) - math.log(cells[2] / cells[3])
    return odds if abs(odds) >= z * math.sqrt(sum(1 / c for c in cells)) else None


def tally(texts: list[str], toxic: list[int]) -> dict[str, list[int]]:
    """In how many texts of each kind a feature stands: [toxic, not]."""
    out: dict[str, list[int]] = {}
    for t, y in zip(texts, toxic, strict=True):
        for f in features_of(t):
            out.setdefault(f, [0, 0])[1 - y] += 1
    return out


def vector(text: str, place: dict[str, int], good: set[str]) -> tuple[list[int], list[float], int]:
    """Places and values of a text's features, and the number of distinct words with a feature that tells toxic texts."""
    found = features_of(text)
    hits = sum(w in good or any(f"{w[:k]}*" in good for k in STEMS if len(w) > k) for w in found if w[-1] != "*")
    at = sorted(place[f] for f in found.keys() & place.keys())
    back = {place[f]: f for f in found.keys() & place.keys()}
    return at, [found[back[i]] for i in at], hits


@dataclass
class Sparse:
    """The values of ``shape[1]`` features in ``shape[0]`` texts; what is not listed is 0."""

    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    @staticmethod
    def of(places: list[np.ndarray], values: list[np.ndarray], width: int) -> Sparse:
        row = np.repeat(np.arange(len(places), dtype=np.int32), [len(p) for p in places])
        whole = lambda parts, kind: np.concatenate([np.asarray(p, dtype=kind) for p in parts] or [np.zeros(0, kind)])
        return Sparse(row, whole(places, np.int32), whole(values, np.float64), (len(places), width))

    def sums(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.shape[0])

    def back(self, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * d[self.row], self.shape[1])


def objective(x: Sparse, grade: np.ndarray, w: np.ndarray, first: np.ndarray, gaps: np.ndarray, ridge: float) -> tuple[float, list[np.ndarray]]:
    """The penalised mean log likelihood and its slopes by weights, first cut and log steps between cuts."""
    n, levels = x.shape[0], len(gaps) + 1
    cuts = first[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    s, rows = x.sums(w), np.arange(n)
    above = np.hstack([np.ones((n, 1)), sigmoid(s[:, None] - cuts[None, :]), np.zeros((n, 1))])
    slope = above * (1 - above)
    p = np.maximum(above[rows, grade] - above[rows, grade + 1], 1e-9)
    ds = (slope[rows, grade] - slope[rows, grade + 1]) / p
    dcut = np.array([(np.where(grade == k, slope[:, k + 1], 0) / p - np.where(grade == k + 1, slope[:, k + 1], 0) / p).sum() / n for k in range(levels)])
    tail = np.cumsum(dcut[::-1])[::-1]
    value = float(np.log(p).mean() - ridge * (w @ w) / 2 - 0.005 * (gaps @ gaps))
    return value, [x.back(ds) / n - ridge * w, np.array([tail[0]]), tail[1:] * np.exp(gaps) - 0.01 * gaps]


def fit_cumulative(x: Sparse, grade: np.ndarray, levels: int, ridge: float = 1e-4, steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts by gradient ascent with momentum estimates (Adam) on ``objective``.

    Cuts are the first one and positive steps, so they stay in order.
    """
    w, first, gaps = np.zeros(x.shape[1]), np.array([1.0]), np.zeros(levels - 1)
    m = [np.zeros_like(a) for a in (w, first, gaps)]
    v = [np.zeros_like(a) for a in (w, first, gaps)]
    for t in range(1, steps + 1):
        _, grads = objective(x, grade, w, first, gaps, ridge)
        for i, (a, g) in enumerate(zip((w, first, gaps), grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            a += rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    return w, first[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def grades(toxic: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Grades from yes/no labels: 0 if not toxic, else 1, 2 or 3 by the number of telling words (up to the lower third of toxic texts, up to the upper third, more)."""
    on = hits[(toxic == 1) & (hits > 0)]
    low, high = np.quantile(on, [1 / 3, 2 / 3], method="lower") if len(on) else (1, 2)
    return np.where(toxic == 0, 0, 1 + (hits > low) + (hits > max(high, low + 1)))


def fit_vectors(vocabulary: list[str], x: Sparse, hits: np.ndarray, toxic: np.ndarray) -> OrdinalModel:
    """Without both kinds of label, or without a telling feature, the model scores everything 0."""
    if not vocabulary or not len(toxic) or toxic.min() == toxic.max():
        return OrdinalModel({}, [])
    w, cuts = fit_cumulative(x, grades(toxic, hits), TOP)
    return OrdinalModel({k: float(a) for k, a in zip(vocabulary, w, strict=True)}, [float(c) for c in cuts])


def fit(texts: list[str], toxic: list[int]) -> OrdinalModel:
    """``learn`` for a few texts at hand."""
    n_bad = sum(toxic)
    odds = {f: o for f, (b, g) in tally(texts, toxic).items() if (o := tell(b, g, n_bad, len(toxic) - n_bad)) is not None}
    place = {f: i for i, f in enumerate(sorted(odds))}
    found = [vector(t, place, {f for f, o in odds.items() if o > 0}) for t in texts]
    return fit_vectors(list(place), Sparse.of([v[0] for v in found], [v[1] for v in found], len(place)), np.array([v[2] for v in found]), np.array(toxic))


def learn(docs: DataFrame, labels: DataFrame, per_label: int = 2_500, seed: int = 5) -> OrdinalModel:
    """Fits on at most ``per_label`` documents of each toxic label.

    Of several labels of a doc_id the highest counts, of several texts that of least hash; ids without a
    document, null ids and other labels are left out. Features are counted and chosen by Spark; what reaches the driver is the telling features and,
    for each text of the sample, the places and values of those that it has; no texts.
    """
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marked = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("_h", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")))
    chosen = bounded_sample(marked, "toxic", F.col("_h"), per_label)
    sample = cut(one_text(docs, chosen, "_h", "toxic"))  # at most 2 * per_label ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            t = tally(b.column(1).to_pylist(), b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(t), pa.string()), pa.array([v[0] for v in t.values()], pa.int64()), pa.array([v[1] for v in t.values()], pa.int64())], names=["f", "bad", "good"])

    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_bad, n_good = size.get(1, 0), size.get(0, 0)
    if not n_bad or not n_good:
        return OrdinalModel({}, [])
    cells = [F.col("bad") + 0.5, n_bad - F.col("bad") + 0.5, F.col("good") + 0.5, n_good - F.col("good") + 0.5]
    odds = F.log(cells[0] / cells[1]) - F.log(cells[2] / cells[3])
    error = F.sqrt(sum((1 / c for c in cells), F.lit(0.0)))
    counted = sample.select("toxic", "text").mapInArrow(count, "f string, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    telling = {r["f"]: r["o"] for r in counted.where((F.col("bad") + F.col("good") >= 5) & (F.abs(odds) >= 4.0 * error)).select("f", odds.alias("o")).collect()}
    place, good = {f: i for i, f in enumerate(sorted(telling))}, {f for f, o in telling.items() if o > 0}

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [vector(t, place, good) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v[0] for v in found], pa.list_(pa.int32())), pa.array([v[1] for v in found], pa.list_(pa.float64())), pa.array([v[2] for v in found], pa.int64())], names=["h", "y", "at", "x", "hits"])

    got = sample.mapInArrow(value, "h long, y int, at array<int>, x array<double>, hits long").toPandas().sort_values("h")
    return fit_vectors(list(place), Sparse.of(got["at"].tolist(), got["x"].tolist(), len(place)), got["hits"].to_numpy(), got["y"].to_numpy())


def severity(docs: DataFrame, model: OrdinalModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, severity double`` (0 to 3, expected grade) for each row, over the whole text.

    A null text counts as empty; repeated rows have equal values, an empty table stays empty, and other
    columns are not read.
    """
    kind = dict(docs.dtypes)[key]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.expected(t.as_py()) for t in b.column(1)], pa.float64())], names=["_key", "severity"])

    out = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).mapInArrow(score, f"_key {kind}, severity double")
    return out.withColumnRenamed("_key", key)


#: A document of this expected severity or more is rejected.
REJECT = 0.4


def op7_toxicity(spark, sf_dir):
    """``doc_id, severity, grade, toxic`` of all documents, learned from labels (``learn``). Grades above 0 are made from yes/no labels (``grades``), so they rank severity among telling words rather than repeat a judge's."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return severity(docs, model).select("doc_id", "severity", F.round("severity").cast("int").alias("grade"), (F.col("severity") >= REJECT).alias("toxic"))


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of expected severity REJECT or more go; all columns stay as they are, whatever their names.

    A null text counts as empty and stays. Labels of documents that are no longer there teach nothing.
    """
    model = learn(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array([model.expected(t.as_py()) < REJECT for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)

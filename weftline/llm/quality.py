"""Quality rules: gradient-boosted trees over document statistics, behind two plain base rules.

Trees are fitted on a bounded sample of labelled documents with logistic loss; chosen features may only
lower the score as they grow. For scoring all trees lie in flat numpy node arrays and every document
goes down all trees at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, one_text, slices, table

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "line_words")
#: -1: a larger value never raises the score.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1}
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; per cent


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base counts and the features of a whole text; a null text has no words."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(windows) > 1:
        count = Counter(windows)
        if len(count) < len(windows):
            end = 0  # words before this place are counted
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    base = (n, len(text) - spaces, symbols, dup, repeated)
    d = max(n, 1)
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = sum(map(text.count, "0123456789"))
    chars = max(base[1], 1)
    return base, (float(np.log1p(n)), base[1] / d, symbols / d, dup / max(lines, 1), repeated / d, len(set(words)) / d, upper / chars, digits / chars, n / max(lines, 1))


@dataclass
class Forest:
    feature: np.ndarray  # -1 at a leaf
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good quality for each row of features."""
        out = np.full(len(x), self.start)
        if not len(self.roots) or not len(x):
            return out
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            down = np.where(x[rows, np.maximum(f, 0)] <= self.cut[at], self.left[at], self.right[at])
            at = np.where(f < 0, at, down)
        return out + self.value[at].sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 5.0) -> Forest:
    """Newton boosting over quantile bins. ``signs``: 1 or -1 holds a feature's effect to one direction.

    Where a feature is constrained, splits against its direction are not taken and the children's
    values are kept on their sides of the middle value, so the whole forest is monotone.
    """
    rate_good = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    start = float(np.log(rate_good / (1 - rate_good)))
    feature: list[int] = []
    cut: list[float] = []
    left: list[int] = []
    right: list[int] = []
    value: list[float] = []
    roots: list[int] = []
    if len(y) and y.min() != y.max():
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), start)

        def node(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
            at = len(feature)
            whole = float(np.clip(g[rows].sum() / (h[rows].sum() + ridge), low, high))
            for lst, v in ((feature, -1), (cut, 0.0), (left, at), (right, at), (value, rate * whole)):
                lst.append(v)
            best = None
            if level < depth:
                gt, ht = g[rows].sum(), h[rows].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                    vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip((gt - gl) / (ht - hl + ridge), low, high)
                    gain = vl * gl * 2 - vl**2 * (hl + ridge) + vr * (gt - gl) * 2 - vr**2 * (ht - hl + ridge) - (2 * whole * gt - whole**2 * (ht + ridge))
                    ok = (hl >= least * 0.05) & (ht - hl >= least * 0.05) & ((vr - vl) * signs[j] >= 0)
                    if ok.any():
                        k = int(np.argmax(np.where(ok, gain, -np.inf)))
                        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                            best = (gain[k], j, k, vl[k], vr[k])
            if best:
                _, j, k, a, b = best
                goes = binned[rows, j] <= k
                middle = (a + b) / 2
                lo_l, hi_l, lo_r, hi_r = low, high, low, high
                if signs[j] > 0:
                    hi_l, lo_r = min(high, middle), max(low, middle)
                elif signs[j] < 0:
                    lo_l, hi_r = max(low, middle), min(high, middle)
                feature[at], cut[at] = j, float(edges[j][k])
                left[at] = node(rows[goes], g, h, level + 1, lo_l, hi_l)
                right[at] = node(rows[~goes], g, h, level + 1, lo_r, hi_r)
            return at

        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            first = len(feature)
            roots.append(node(np.arange(len(y)), y - p, p * (1 - p), 0, -np.inf, np.inf))
            one = Forest(*(np.array(a) for a in (feature, cut, left, right, value)), np.array([first]), depth, 0.0)
            margin += one.score(x)
    return Forest(np.array(feature, dtype=np.int64), np.array(cut), np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(value), np.array(roots, dtype=np.int64), depth, start)


def learn(docs: DataFrame, labels: DataFrame, per_label: int = 2_500, seed: int = 9) -> Forest:
    """Fits on at most ``per_label`` documents of each quality label; their statistics, not texts, reach the driver.

    Of several labels of a doc_id the lowest counts, of several texts that of least hash; ids without a
    document and null ids are left out.
    """
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    marked = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("_h", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")))
    chosen = bounded_sample(marked, "quality", F.col("_h"), per_label)
    sample = one_text(docs, chosen, "_h", "quality")  # at most 2 * per_label ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [statistics(t.as_py())[1] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], names=["h", "y", "x"])

    rows = sample.select("_h", "text", "quality").mapInArrow(run, "h long, y int, x array<double>").collect()
    rows = sorted((r["h"], r["y"], tuple(r["x"])) for r in rows)
    x = np.array([r[2] for r in rows]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in rows], dtype=float), [MONOTONE.get(f, 0) for f in FEATURES])


def assess(docs: DataFrame, forest: Forest, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """``key``, the base counts, ``base_failed``, ``score`` (probability of good quality) and ``kept`` for each row.

    ``base_failed``: under 50 words, or over half of the words in repeated 3-word windows. ``kept``:
    not failed and a score of ``least`` or more. Null texts have no words and fail.
    Repeated rows have equal values; an empty table stays empty, and other columns are not read.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            both = [statistics(t.as_py()) for t in b.column(1)]
            base = np.array([s[0] for s in both], dtype=np.int64).reshape(-1, len(BASE))
            p = 1 / (1 + np.exp(-forest.score(np.array([s[1] for s in both]).reshape(-1, len(FEATURES)))))
            failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(base[:, j]) for j in range(len(BASE))), pa.array(failed), pa.array(p), pa.array(~failed & (p >= least))], names=["_key", *BASE, "base_failed", "score", "kept"])

    schema = f"_key {kind}, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean"
    return docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema).withColumnRenamed("_key", key)


def op9_quality(spark, sf_dir):
    """All documents' counts, base rule and verdict (``assess``), learned from labels (``learn``)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return assess(docs, learn(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))

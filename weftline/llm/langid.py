"""Language identification with string kernels.

The kernel of two texts is the number of byte n-grams that both contain (blended spectrum, presence
only), over the geometric mean of their own numbers. A Nyström map through landmark texts makes it
finite, kernel ridge regression is solved one language against the rest, and documents are scored in
batches as matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, cut, slices, table

ORDERS = (2, 3, 4)
WIDTH = 1 << 15
#: Every ASCII byte that is no letter counts as a space.
FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
UNKNOWN = "und"


#: Longer texts are read in equal pieces of at most so many bytes, since the presence of n-grams says less the more of them a text has.
PIECE = 1 << 14


def folded(text: str) -> np.ndarray:
    """The bytes of the lower-cased text between two spaces."""
    return np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(FOLD) + b" ", dtype=np.uint8).astype(np.uint32)


def hashed(b: np.ndarray) -> np.ndarray:
    """Hashes (below WIDTH) of the n-grams of bytes, repeats included."""
    out, code = [], b
    for n in range(2, max(ORDERS) + 1):
        code = (code[:-1] << np.uint32(8)) | b[n - 1 :] if len(code) > 1 else code[:0]
        if n in ORDERS:
            out.append((((code ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(17)).astype(np.int32))
    return np.concatenate(out)


def grams(text: str) -> np.ndarray:
    """Hashes of the byte n-grams of the lower-cased text."""
    return hashed(folded(text))


def pieces(text: str) -> Iterator[np.ndarray]:
    """The hashes of the whole text, piece by piece; no n-gram is lost where two pieces meet."""
    b = folded(text)
    ends = np.linspace(0, len(b), -(-len(b) // PIECE) + 1).astype(int)
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        yield hashed(b[max(0, lo - max(ORDERS) + 1) : hi])


def packed(found: np.ndarray) -> np.ndarray:
    p = np.zeros(WIDTH, dtype=bool)
    p[found] = True
    return np.packbits(p)


def bits_of(text: str) -> np.ndarray:
    """The presence of all n-grams as WIDTH bits (4 kB, however long the text)."""
    return packed(grams(text))


def pack(texts: list[str]) -> np.ndarray:
    return np.array([bits_of(t) for t in texts], dtype=np.uint8).reshape(-1, WIDTH // 8)


def presence(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of zeros and ones for each row of bits, and the roots of the row sums."""
    p = np.unpackbits(bits, axis=1, count=WIDTH).astype(np.float32)
    return p, np.sqrt(np.maximum(p.sum(axis=1), 1))


@dataclass
class KernelModel:
    labels: list[str]
    landmarks: np.ndarray  # float32, WIDTH by landmarks, columns already divided by their norm
    weights: np.ndarray  # landmarks by labels: the Nyström map and the ridge solution in one
    common: np.ndarray  # float32, WIDTH by labels: 1 for n-grams in two or more landmarks of the label (in one, if it has one)

    def decide(self, bits: np.ndarray, batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Decision values of packed texts, and for each the label of the greatest (the first of equal ones)."""
        out = [np.zeros((0, len(self.labels)))]
        for i in range(0, len(bits), batch):
            p, norm = presence(bits[i : i + batch])
            out.append(((p @ self.landmarks) / norm[:, None]) @ self.weights)
        values = np.concatenate(out)
        return values, values.argmax(axis=1) if self.labels else np.zeros(len(values), int)


def fit(bits: np.ndarray, labels: list[str], n_landmarks: int = 96, ridge: float = 1e-2) -> KernelModel:
    """Landmarks are taken from the labels in turn, two a label at least; targets are +1 and -1. With no texts the model knows no language."""
    names = sorted(set(labels))
    if not names:
        return KernelModel([], np.zeros((WIDTH, 0), np.float32), np.zeros((0, 0)), np.zeros((WIDTH, 0), np.float32))
    by = {c: [i for i, x in enumerate(labels) if x == c] for c in names}
    turns = [by[c][k] for k in range(max(map(len, by.values()))) for c in names if k < len(by[c])][: max(n_landmarks, 2 * len(names))]
    p, norm = presence(bits[turns])
    marks = np.ascontiguousarray((p / norm[:, None]).T)
    own = np.array([labels[i] for i in turns])
    common = np.stack([p[own == c].sum(axis=0) >= min(2, max(1, (own == c).sum())) for c in names], axis=1).astype(np.float32)
    del p
    kernel = np.vstack([(lambda q, m: (q @ marks) / m[:, None])(*presence(bits[i : i + 64])) for i in range(0, len(bits), 64)]).astype(np.float64)
    values, vectors = np.linalg.eigh(marks.T.astype(np.float64) @ marks)
    good = values > 1e-6 * values[-1]
    nystrom = vectors[:, good] / np.sqrt(values[good])
    z = kernel @ nystrom
    y = np.where(np.array(labels)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # languages weigh the same however many texts each has
    w = np.array([1.0 / len(by[c]) for c in labels]) * len(labels) / len(names)
    zw = z * w[:, None]
    alpha = np.linalg.solve(zw.T @ z + ridge * len(labels) * np.eye(z.shape[1]) / 100, zw.T @ y)
    return KernelModel(names, marks, nystrom @ alpha, common)


#: So many languages are learned at most, the most frequent ones; with 250 texts each their bits are 128 MB.
MOST_LANGUAGES = 128


def sample_of(docs: DataFrame, per_language: int, key: str = "doc_id", seed: int = 3) -> DataFrame:
    """``lang, h, text`` of at most ``per_language`` documents of each of the MOST_LANGUAGES most frequent non-null langs; texts without a letter are left out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64(F.lit(seed), F.col(key).cast("string"), "text").alias("h"))
    return bounded_sample(usable, "lang", F.col("h"), per_language, MOST_LANGUAGES).select("lang", "h", "text")


def bits_of_sample(sample: DataFrame) -> list[tuple[str, int, bytes]]:
    """Lang, hash and n-gram bits of a bounded sample, in order.

    The bits (4 kB a text, made in tasks) are the only thing that reaches the driver, so neither long
    texts nor many lang values outgrow it.
    """

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([bits_of(t.as_py()).tobytes() for t in b.column(2)], pa.binary())], names=["lang", "h", "bits"])

    return sorted((r["lang"], r["h"], bytes(r["bits"])) for r in sample.mapInArrow(shorten, "lang string, h long, bits binary").collect())


def labelled(docs: DataFrame, per_language: int, key: str = "doc_id", seed: int = 3) -> list[tuple[str, int, bytes]]:
    """The bits of ``sample_of``."""
    return bits_of_sample(sample_of(docs, per_language, key, seed))


def together(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, WIDTH // 8)


def learn(docs: DataFrame, per_language: int = 250, key: str = "doc_id", seed: int = 3) -> KernelModel:
    """Fits on at most ``per_language`` documents of each of the most frequent langs (``labelled``)."""
    rows = labelled(docs, per_language, key, seed)
    return fit(together([r[2] for r in rows]), [r[0] for r in rows])


#: A text is claimed if its winner's share of common n-grams is this part of what held-out texts of that language have.
FLOOR = 0.6
#: So many held-out texts are needed to set a language's floor; with fewer, those of all languages set it.
LEAST_HELD = 8


class Judge:
    """A model as it travels to tasks, its landmarks as bits."""

    def __init__(self, model: KernelModel) -> None:
        self.labels, self.weights = model.labels, model.weights
        self.bits, self.norms = np.packbits(model.landmarks > 0, axis=0), model.landmarks.max(axis=0, initial=0)
        self.common = np.packbits(model.common > 0, axis=0)
        self.opened: tuple[KernelModel, dict[str, np.ndarray]] | None = None

    def open(self) -> tuple[KernelModel, dict[str, np.ndarray]]:
        if self.opened is None:
            marks, common = (np.unpackbits(x, axis=0, count=WIDTH) for x in (self.bits, self.common))
            self.opened = KernelModel(self.labels, marks.astype(np.float32) * self.norms[None, :].astype(np.float32), self.weights, common), {c: common[:, k].astype(bool) for k, c in enumerate(self.labels)}
        return self.opened

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Labels and scores; a text of several pieces has the mean of their decision values."""
        pred, value = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if self.labels and t is not None and any(c.isalpha() for c in t)]
        for j in range(0, len(known), 64):
            part = known[j : j + 64]
            cut = [[packed(g) for g in pieces(texts[i])] for i in part]
            f = self.open()[0].decide(np.array([b for c in cut for b in c], dtype=np.uint8))[0]
            starts = np.cumsum([0, *map(len, cut)])[:-1]
            f = np.add.reduceat(f, starts, axis=0) / np.array([[len(c)] for c in cut])
            value[part] = np.clip((f.max(axis=1) + 1) / 2, 0, 1)
            for i, k in zip(part, f.argmax(axis=1), strict=True):
                pred[i] = self.labels[k]
        return pred, value

    def share(self, text: str, label: str) -> float:
        """What part of all n-grams of the whole text, each as often as it occurs, is common in the label's landmarks.

        Unlike the part of its different n-grams, this does not fall as a text grows.
        """
        common, hits, n = self.open()[1][label], 0, 0
        for g in pieces(text):
            hits, n = hits + int(common[g].sum()), n + len(g)
        return hits / max(n, 1)


def learn_with_floors(docs: DataFrame, per_language: int = 250, key: str = "doc_id", seed: int = 3) -> tuple[KernelModel, np.ndarray]:
    """A model, and for each of its labels the least share of common n-grams with which it claims a text.

    A fifth of each language's sample is held out of the fit, copies of fitted texts aside; a floor is
    FLOOR times the share that all but 2 % of a language's held-out texts reach, so that some wrong
    labels do no harm. With too few held-out texts in all there is no floor (0).
    """
    by: dict[str, list[tuple[int, bytes]]] = {}
    chosen = cut(sample_of(docs, per_language * 5 // 4, key, seed))
    for lang, h, bits in bits_of_sample(chosen):
        by.setdefault(lang, []).append((h, bits))
    seen = {c: [b for _, b in t[: len(t) - len(t) // 5]] for c, t in by.items()}
    model = fit(together([t for c in seen for t in seen[c]]), [c for c in seen for _ in seen[c]])
    judge = Judge(model)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([judge.share(t, c) for c, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)], pa.float64())], names=["lang", "h", "share"])

    measured = {(r["lang"], r["h"]): r["share"] for r in chosen.mapInArrow(shares, "lang string, h long, share double").collect()}
    fitted = {t for c in seen for t in seen[c]}
    held = {c: [measured[c, h] for h, b in by[c][len(seen[c]) :] if b not in fitted] for c in model.labels}
    least = lambda x: FLOOR * float(np.quantile(x, 0.02)) if len(x) >= LEAST_HELD else None
    every = least([x for c in model.labels for x in held[c]]) or 0.0
    return model, np.array([every if (f := least(held[c])) is None else f for c in model.labels])


def predict(docs: DataFrame, model: KernelModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred string, score double`` for each row, from the whole text alone.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if the model
    knows no language. Ties go to the first language in alphabetical order. Scores are the winner's
    decision value moved from [-1, 1] to [0, 1]; texts over PIECE bytes have the mean of their pieces'.
    Repeated rows each get the same answer; other columns are not read; an empty table stays empty.
    """
    run, kind = Judge(model), dict(docs.dtypes)[key]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            pred, value = run(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(value)], names=["_key", "lang_pred", "score"])

    out = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).mapInArrow(score, f"_key {kind}, lang_pred string, score double")
    return out.withColumnRenamed("_key", key)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op3_langid(spark, sf_dir):
    """``doc_id, held_out, lang_pred, score`` of all documents, learned from those that are not held out (a null doc_id is neither)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = learn(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: Below this score no language's classifier claims the text.
LEAST_SCORE = 0.3


def keep_known_languages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drops documents without a letter and those that no language claims.

    A language claims a text if its score is LEAST_SCORE or more and the text's n-grams are common in
    its landmarks as in its held-out texts (``learn_with_floors``). Scores cannot tell the latter: a
    text that shares no n-gram with any landmark has decision values of 0, a score of 0.5. Neither depends
    on a text's length. Text, lang,
    source and the other columns stay as they are. The model is learned from the documents' own lang
    column. Nulls, repeated rows and clashing column names change nothing; an empty table stays empty.
    """
    model, floors = learn_with_floors(docs)
    run, at, floor = Judge(model), docs.columns.index("text"), dict(zip(model.labels, floors.tolist(), strict=True))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            yield b.filter(pa.array([p != UNKNOWN and v >= LEAST_SCORE and run.share(t, p) >= floor[p] for t, p, v in zip(texts, *run(texts), strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)

"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces and their scores come from a SentencePiece model file, which is only read. A space is written
as the marker U+2581, with one before the text. What no piece covers falls back to byte pieces. The
best path is the one of highest total score; on ties the path whose last piece is longest stays.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .common import table

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
#: Segments of more bytes are solved one by one and not cached.
LONG = 256
#: Start positions of a long segment that go down the trie together.
STRIDE = 1 << 15


@dataclass
class DoubleArray:
    """A trie of byte strings: the child of node s by byte c is t = base[s] + c + 1, if check[t] = s. value: id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, words: dict[bytes, int]) -> DoubleArray:
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for w, i in words.items():
            at = 0
            for c in w:
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = children[at][c] = len(children)
                    children.append({})
                    value.append(-1)
                at = nxt
            value[at] = i
        size = 8 * len(children) + 4096
        base, check, out = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        free, forward, place, queue = 1, 0, {0: 0}, [0]
        for node in queue:
            s, kids = place[node], sorted(children[node])
            out[s] = value[node]
            if not kids:
                continue
            if len(kids) == 1:  # only children fill the gaps
                while used[free] or free <= kids[0]:
                    free += 1
                b = free - kids[0] - 1
            else:
                b = forward
                while any(used[b + c + 1] for c in kids):
                    b += 1
                forward = b
            base[s] = b
            for c in kids:
                t = b + c + 1
                used[t], check[t], place[children[node][c]] = 1, s, t
                queue.append(children[node][c])
        end = max(place.values()) + 258
        return cls(base[:end].copy(), check[:end].copy(), out[:end].copy())

    def step(self, s: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Children of nodes by bytes, -1 where there is none; nodes of -1 stay."""
        t = self.base[s] + c + 1
        return np.where((s >= 0) & (self.check[t] == s), t, -1)


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray  # by id
    trie: DoubleArray
    byte_ids: list[int]  # of the 256 byte pieces
    longest: int
    unknown: float
    alone: frozenset[str]
    solid: bool
    cache: dict[str, bytes] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """Reads a model file. A unigram model's scores are log probabilities and stay; merge ranks (0, -1, -2, ...) become those of Zipf's law, -log(rank + 1) - log(sum)."""
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        plain = [i for i in ids if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        raw = np.array([sp.get_score(i) for i in ids])
        if np.all(raw[plain] == np.round(raw[plain])):
            rank = np.empty(len(raw))
            rank[np.argsort(-raw, kind="stable")] = np.arange(len(raw))
            raw = -np.log(rank + 1) - np.log((1 / np.arange(1, len(raw) + 1)).sum())
        return cls.of([sp.id_to_piece(i) for i in ids], raw, plain, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    @classmethod
    def of(cls, pieces: list[str], scores: np.ndarray, plain: list[int], byte_ids: list[int]) -> Vocabulary:
        words = {pieces[i].encode(): i for i in plain}
        inner = "".join(pieces[i] for i in plain if len(pieces[i]) > 1)
        alone = frozenset(c for c in "\n\t\r" if c not in inner)
        solid = not any(MARK in pieces[i].lstrip(MARK) for i in plain)
        least = min((float(scores[i]) for i in plain), default=0.0)
        return cls(pieces, np.asarray(scores, dtype=np.float64), DoubleArray.build(words), byte_ids, max(map(len, words), default=1), least - UNKNOWN_PENALTY, alone, solid)

    def cutter(self) -> re.Pattern:
        """Pieces never cross these cuts: before a marker that follows another character, and around characters that only stand alone."""
        if not self.solid:
            return re.compile(r"(?s).+")
        solo = "".join(map(re.escape, sorted(self.alone)))
        return re.compile(rf"{MARK}+[^{MARK}{solo}]*|[^{MARK}{solo}]+" + (rf"|[{solo}]" if solo else ""))

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Best ids (as int32 bytes) of each word. Words go down the trie together, grouped by length, one step for all; long ones alone."""
        out: list[bytes] = [b""] * len(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        groups: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            if len(b) > LONG:
                out[i] = self._solve_long(b)
            else:
                groups.setdefault(len(b), []).append(i)
        for size, group in groups.items():
            most = max(1, (1 << 22) // max(size, 1))
            for k in range(0, len(group), most):
                part = group[k : k + most]
                for i, ids in zip(part, self._solve(b"".join([raw[i] for i in part]), len(part), size), strict=True):
                    out[i] = ids
        return out

    def _matches(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers in ``starts``, ends and ids of all pieces that begin there, by start and then length; all starts step together."""
        t, found = self.trie, []
        at, who, where = np.zeros(len(starts), dtype=np.int64), np.arange(len(starts)), starts
        for _ in range(self.longest):
            inside = where < len(text)
            if not inside.all():
                at, who, where = at[inside], who[inside], where[inside]
            at = t.step(at, text[where])
            on = at >= 0
            at, who, where = at[on], who[on], where[on] + 1
            if not len(at):
                break
            ids = t.value[at]
            hit = ids >= 0
            found.append((who[hit], where[hit], ids[hit]))
        whole = [np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(3)]
        order = np.argsort(whole[0], kind="stable")
        return whole[0][order], whole[1][order], whole[2][order]

    def _solve_long(self, raw: bytes) -> bytes:
        """One segment, in time linear in its length: pieces are found for many starts at once, then best scores run along the text."""
        text, size = np.frombuffer(raw, dtype=np.uint8).astype(np.int32), len(raw)
        starts = np.flatnonzero((text & 0xC0) != 0x80)
        after = np.append(starts[1:], size)
        low = float("-inf")
        best, piece, origin = array("d", [low]) * (size + 1), array("i", [-1]) * (size + 1), array("i", [0]) * (size + 1)
        best[0] = 0.0
        for k in range(0, len(starts), STRIDE):
            some = starts[k : k + STRIDE]
            who, ends, ids = self._matches(text, some)
            cuts = np.searchsorted(who, np.arange(len(some) + 1)).tolist()
            ends, gains, ids = ends.tolist(), self.scores[ids].tolist(), ids.tolist()
            for i, a, b, nxt in zip(some.tolist(), cuts, cuts[1:], after[k : k + STRIDE].tolist()):
                base, single = best[i], False
                if base == low:
                    continue
                for m in range(a, b):
                    end, new = ends[m], base + gains[m]
                    single |= end == nxt
                    if new > best[end]:
                        best[end], piece[end], origin[end] = new, ids[m], i
                if not single and base + self.unknown > best[nxt]:
                    best[nxt], piece[nxt], origin[nxt] = base + self.unknown, -1, i
        out, end = array("i"), size
        while end > 0:
            start = origin[end]
            if piece[end] >= 0:
                out.append(piece[end])
            else:  # a character without a piece gives its bytes
                out.extend([self.byte_ids[c] for c in reversed(raw[start:end])])
            end = start
        out.reverse()
        return out.tobytes()

    def _solve(self, joined: bytes, n: int, size: int) -> list[bytes]:
        """``n`` words of ``size`` bytes each."""
        t = self.trie
        text = np.ascontiguousarray(np.frombuffer(joined, dtype=np.uint8).reshape(n, size).T).astype(np.int32)
        begins = np.vstack([(text & 0xC0) != 0x80, np.ones((1, n), dtype=bool)])  # a character begins here
        char = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        piece = np.full((size + 1, n), -1, dtype=np.int32)
        origin = np.zeros((size + 1, n), dtype=np.int32)
        for i in range(size):
            live = np.flatnonzero(best[i] > -np.inf)
            if not len(live):
                continue
            at, word, start = np.zeros(len(live), dtype=np.int64), live, np.arange(len(live))
            score, wide, single = best[i, live], char[i, live], np.zeros(len(live), dtype=bool)
            for j in range(i, min(size, i + self.longest)):
                at = t.step(at, text[j, word])
                on = at >= 0
                if not on.all():
                    at, word, start = at[on], word[on], start[on]
                    if not len(at):
                        break
                ids = t.value[at]
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    w, s, ids = word[hit], start[hit], ids[hit]
                    new = score[s] + self.scores[ids]
                    single[s[wide[s] == j + 1 - i]] = True
                    better = new > best[j + 1, w]
                    w = w[better]
                    best[j + 1, w], piece[j + 1, w], origin[j + 1, w] = new[better], ids[better], i
            lost = np.flatnonzero(~single)
            if len(lost):
                w, end = live[lost], np.minimum(i + wide[lost], size)
                new = score[lost] + self.unknown
                better = new > best[end, w]
                w, end = w[better], end[better]
                best[end, w], piece[end, w], origin[end, w] = new[better], -1, i
        # back along the best paths, again all words at once; a character without a piece gives its bytes one by one
        byte_ids, steps, end, every = np.array(self.byte_ids, dtype=np.int32), [], np.full(n, size), np.arange(n)
        while end.any():
            whole = (piece[end, every] >= 0) & begins[end, every]
            before = np.maximum(end - 1, 0)
            ids = np.where(whole, piece[end, every], byte_ids[text[before, every]] if size else -1)
            steps.append(np.where(end > 0, ids, -1))
            end = np.where(whole, origin[end, every], before)
        if not steps:
            return [b""] * n
        table = np.stack(steps[::-1], axis=1).astype(np.int32)
        there = table >= 0
        flat, ends = table[there].tobytes(), np.concatenate([[0], np.cumsum(there.sum(axis=1))]) * 4
        ends = ends.tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, texts: list[str | None], most_cached: int = 600_000) -> list[np.ndarray]:
        """Ids of whole texts; empty and null ones have none. Segments seen before are looked up (a bounded cache of short ones)."""
        cut, cache = self.cutter(), self.cache
        parts = [cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        every = set().union(*parts)
        new = every.difference(cache)
        if len(cache) + len(new) > most_cached:
            cache.clear()
            new = every
        fresh = list(new)
        cache.update(zip(fresh, self.viterbi(fresh), strict=True))
        out = [np.frombuffer(b"".join(map(cache.__getitem__, p)), dtype=np.int32) for p in parts]
        for w in fresh:
            if len(w) * 4 > LONG:
                del cache[w]
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Byte pieces are joined to characters, markers become spaces and the first one goes."""
        table = self.__dict__.get("_bytes")
        if table is None:
            table = self.__dict__["_bytes"] = [p.encode() for p in self.pieces]
            for b, i in enumerate(self.byte_ids):
                table[i] = bytes([b])
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", rows: int = 256) -> DataFrame:
    """``key, ids array<int>, n_bytes int, same boolean`` for each row.

    ``n_bytes`` counts byte-fallback ids; ``same`` says that decoding gives the text back (a text with
    U+2581 in it comes back with spaces there). A null text has null ids, an empty one none.
    Repeated rows stay rows, null keys too; other columns are not read; an empty table stays empty.
    """
    kind, spare = dict(docs.dtypes)[key], np.zeros(len(vocabulary.pieces), dtype=bool)
    spare[vocabulary.byte_ids] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                part = b.slice(i, rows)
                texts = part.column(1).to_pylist()
                ids = vocabulary.encode(texts)
                flat = np.concatenate([np.zeros(0, np.int32), *ids])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                gone = pa.array([t is None for t in texts])
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=gone)
                fallback = np.add.reduceat(np.append(spare[flat], False).astype(np.int32), ends[:-1]) * (np.diff(ends) > 0) if len(texts) else np.zeros(0, np.int32)
                same = [None if t is None else vocabulary.decode(x.tolist()) == t for t, x in zip(texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), column, pa.array(fallback.astype(np.int32)), pa.array(same, pa.bool_())], names=["_key", "ids", "n_bytes", "same"])

    out = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).mapInArrow(run, f"_key {kind}, ids array<int>, n_bytes int, same boolean")
    return out.withColumnRenamed("_key", key)


def decode(encoded: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text`` for each row of ids; null ids give a null text. Repeated rows and null keys stay rows; other columns are not read; an empty table stays empty."""
    kind = dict(encoded.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else vocabulary.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["_key", "text"])

    return encoded.select(F.col(key).alias("_key"), F.col(ids).alias("_ids")).mapInArrow(run, f"_key {kind}, text string").withColumnRenamed("_key", key)


def op5_pieces(spark, sf_dir):
    """``doc_id, n_ids, n_bytes, same, ids`` of all documents' whole texts; a null text has null ids (n_ids is then null too)."""
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"), Vocabulary.load()).select("doc_id", F.size("ids").alias("n_ids"), "n_bytes", "same", "ids")

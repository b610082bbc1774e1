"""Removal of repeated passages by relative Lempel-Ziv parsing.

A passage is a window of words that also starts in a document of a lesser key. Each window has an
anchor: the least hash of its word groups. An anchor that several documents have points to its first
one; that document's block of words around it is a reference block. Documents are factored greedily
against all blocks that their anchors point to. Factors of at least half a window are extended to both
sides at both ends, with every place of the blocks that continues there, which finds each window that a
block holds. A window with a known anchor that no block holds leaves its anchor's block at some word; those
that leave it alike in several documents are settled by their own hash. So a passage that many documents
have is compared with one block by each, never in pairs.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, join_hot, slices, table, whole_text

#: Words of a window, of an anchor's group, and of a reference block (without its margins).
WINDOW, GROUP, BLOCK = 50, 10, 128
#: Words longer than this are compared by a 128-bit hash, so that a block has a size bound.
LONG = 40
#: Up to so many places are compared word by word.
FEW = 6
#: Odd multipliers of the rolling hashes.
BASE, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def words(text: str | None) -> list[bytes]:
    """The words between ASCII white space."""
    return [] if text is None else text.encode("utf-8", "replace").split()


def short(ws: list[bytes]) -> list[bytes]:
    return [w if len(w) <= LONG else b"\x00" + xxhash.xxh3_128_hexdigest(w).encode() for w in ws]


def hashes(ws: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    at = [known.setdefault(w, len(known)) for w in ws]
    return np.array([xxhash.xxh64_intdigest(w) for w in known], dtype=np.uint64)[at] if ws else np.zeros(0, np.uint64)


def groups(h: np.ndarray, size: int = GROUP) -> np.ndarray:
    """A mixed hash of each ``size`` consecutive words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, size):
        out = out * np.uint64(BASE) + h[k : k + n]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(MIX)
    return out ^ (out >> np.uint64(32))


def anchors(g: np.ndarray) -> np.ndarray:
    """For each window its anchor: the least group hash in it."""
    width, low, span = WINDOW - GROUP + 1, g, 1
    if len(g) < width:
        return g[:0]
    while 2 * span <= width:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    n = len(g) - width + 1
    return np.minimum(low[:n], low[width - span : width - span + n])


def first_anchors(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct anchors, a place of each, and whether some window with it does not hold that place."""
    a = anchors(g)
    if not len(a):
        return a, np.zeros(0, np.int64), np.zeros(0, bool)
    fresh = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    at = fresh + np.lib.stride_tricks.sliding_window_view(g, WINDOW - GROUP + 1)[fresh].argmin(axis=1)
    found, first = np.unique(a[fresh], return_index=True)
    place, of, i = at[first], np.searchsorted(found, a), np.arange(len(a))
    other = (place[of] < i) | (place[of] > i + WINDOW - GROUP)
    return found, place, np.bincount(of[other], minlength=len(found)) > 0


class Reference:
    """Blocks of words, indexed by their groups, and how far a text agrees with them from any place on."""

    def __init__(self, text: list[bytes], blocks: list[list[bytes]]) -> None:
        ids: dict[bytes, int] = {}
        number = lambda ws: [ids.setdefault(w, len(ids) + 1) for w in ws]
        self.text = np.array(number(text), dtype=np.uint64)
        held = [np.array(number(b), dtype=np.uint64) for b in blocks]
        ends = [np.array([(1 << 40) + i], dtype=np.uint64) for i in range(len(held))]  # equal to no word
        self.held = np.concatenate([x for pair in zip(held, ends, strict=True) for x in pair] or [np.zeros(0, np.uint64)])
        mixed = lambda x: (x * np.uint64(MIX)) ^ ((x * np.uint64(BASE)) >> np.uint64(31))
        g = groups(mixed(self.held))
        self.order = np.argsort(g, kind="stable")
        own = groups(mixed(self.text))
        self.low, self.high = (np.searchsorted(g[self.order], own, side) for side in ("left", "right"))
        n = max(len(self.text), len(self.held)) + 1
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]))
        total = lambda x: np.concatenate([[np.uint64(0)], np.cumsum(mixed(x) * self.power[: len(x)])])
        self.of_text, self.of_held = total(self.text), total(self.held)

    def places(self, p: int) -> np.ndarray:
        """Where in the blocks the group of words at ``p`` of the text stands (its hash; ``agree`` settles it)."""
        return self.order[self.low[p] : self.high[p]] if 0 <= p < len(self.low) else self.order[:0]

    def stretch(self, p: int, q: int, back: bool) -> int:
        """How many words agree from text place ``p`` and block place ``q`` on, or before them, word by word."""
        most, n, size = min(p, q) if back else min(len(self.text) - p, len(self.held) - q), 0, 64
        while n < most:
            k = min(size, most - n)
            if back:
                differ = self.text[p - n - k : p - n][::-1] != self.held[q - n - k : q - n][::-1]
            else:
                differ = self.text[p + n : p + n + k] != self.held[q + n : q + n + k]
            first = int(differ.argmax())
            if differ[first]:
                return n + first
            n, size = n + k, 2 * size
        return n

    def agree(self, p: int, q: np.ndarray, back: bool = False) -> np.ndarray:
        """``stretch`` for each of several block places; of many (as in repetitive texts) by halving, on sums of powers."""
        if len(q) <= FEW:
            return np.array([self.stretch(p, x, back) for x in q.tolist()], dtype=np.int64)
        most = np.minimum(p, q) if back else np.minimum(len(self.text) - p, len(self.held) - q)
        got = np.zeros(len(q), dtype=np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step:
            k = got + step
            fits = k <= most
            k = np.where(fits, k, 0)
            a, b = (p - k, q - k) if back else (np.full(len(q), p), q)
            same = (self.of_text[a + k] - self.of_text[a]) * self.power[b] == (self.of_held[b + k] - self.of_held[b]) * self.power[a]
            got = np.where(fits & same, k, got)
            step >>= 1
        return got

    def factors(self) -> list[tuple[int, int]]:
        """Greedy parse: ends of the longest agreements, one after the other; words that begin no known group are left out."""
        known = np.flatnonzero(self.high > self.low)
        out, p = [], 0
        while (i := int(np.searchsorted(known, p))) < len(known):
            p = int(known[i])
            n = int(self.agree(p, self.places(p)).max())
            if n >= GROUP:
                out.append((p, p + n))
            p += max(n, 1)
        return out

    def passages(self) -> list[tuple[int, int]]:
        """Stretches of WINDOW words or more that a block holds; all windows that a block holds are in one of them.

        Such a window is cut by the factors so that one of at least half its words covers its beginning or
        its end; the other end of the window then lies behind one of that factor's two boundaries.
        """
        found, seen = [np.zeros((0, 3), np.int64)], set()
        for start, end in self.factors():
            if 2 * (end - start) < WINDOW:
                continue
            for p in {start - GROUP, start, end - GROUP, end} - seen:
                q = self.places(p)
                before, after = self.agree(p, q, True), self.agree(p, q)
                wide = before + after >= WINDOW
                found.append(np.stack([p - before, p + after, q - before], axis=1)[wide])
            seen |= {start - GROUP, start, end - GROUP, end}
        every = np.concatenate(found)
        every = every[np.lexsort((-every[:, 1], every[:, 0]))]
        outer = np.diff(np.maximum.accumulate(every[:, 1]), prepend=0) > 0  # in no other
        return [(a, b) for a, b, q in every[outer].tolist() if np.array_equal(self.text[a:b], self.held[q : q + b - a])]


def joined(blocks: list[tuple[int, int, list[bytes]]]) -> list[tuple[int, int, list[bytes]]]:
    """Blocks (text, number, words) as stretches (text, first word, words); blocks that follow one another, which overlap by their margins, are one."""
    out, last = [], None
    for t, b, ws in sorted(blocks, key=lambda x: x[:2]):
        begin = max(0, BLOCK * b - (WINDOW - GROUP))
        if last == (t, b - 1):
            out[-1][2].extend(ws[out[-1][1] + len(out[-1][2]) - begin :])
        elif last != (t, b):
            out.append((t, begin, list(ws)))
        last = (t, b)
    return out


def windows_in(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    """Which of the ``n`` windows lie in one of the stretches."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b - WINDOW + 1] -= 1
    return np.cumsum(edge[:n]) > 0


def without(ws: list[bytes], repeated: np.ndarray) -> tuple[list[bytes], int]:
    """The words outside all repeated windows, and how many are inside."""
    edge = np.zeros(len(ws) + 1, dtype=np.int64)
    np.add.at(edge, repeated, 1)
    np.add.at(edge, repeated + WINDOW, -1)
    keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return [ws[i] for i in keep], len(ws) - len(keep)


def stretches(starts: np.ndarray) -> list[dict]:
    """Ascending window numbers as first and last of each gapless stretch."""
    if not len(starts):
        return []
    cutat = np.flatnonzero(np.diff(starts) > 1)
    return [{"a": int(a), "b": int(b)} for a, b in zip(starts[np.concatenate([[0], cutat + 1])], starts[np.concatenate([cutat, [len(starts) - 1]])], strict=True)]


def marks(rows: DataFrame, kind: str) -> DataFrame:
    """``id, t`` and of each text the number of words, SHA-256 of its words joined by one space, anchors and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            n, sha, hs, ps, again = [], [], [], [], []
            for x in b.column(2):
                ws = words(x.as_py())
                h, p, more = first_anchors(groups(hashes(ws)))
                n.append(len(ws))
                sha.append(hashlib.sha256(b" ".join(ws)).digest())
                hs.append(h.view(np.int64))
                ps.append(p.astype(np.int32))
                again.append(more)
            lists = [pa.array(x, pa.list_(t)) for x, t in ((hs, pa.int64()), (ps, pa.int32()), (again, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), *lists], names=["id", "t", "n_words", "sha", "hs", "ps", "again"])

    return rows.mapInArrow(run, f"id {kind}, t long, n_words long, sha binary, hs array<long>, ps array<int>, again array<boolean>")


def cut_blocks(texts: DataFrame) -> DataFrame:
    """From ``id, t, numbers, text`` a row ``block (id, t, b), words`` for each numbered block, with margins for its anchors' windows."""
    kind = dict(texts.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            of, number, held = [], [], []
            for i, (numbers, x) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                ws = short(words(x.as_py()))
                for b in numbers.as_py():
                    of.append(i)
                    number.append(b)
                    held.append(b" ".join(ws[max(0, BLOCK * b - (WINDOW - GROUP)) : BLOCK * (b + 1) + WINDOW]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), batch.column(1).take(pa.array(of, pa.int64())), pa.array(number, pa.int32()), pa.array(held, pa.binary())], names=["id", "t", "b", "words"])

    out = texts.select("id", "t", "numbers", "text").mapInArrow(run, f"id {kind}, t long, b int, words binary")
    return out.select(F.struct("id", "t", "b").alias("block"), "words")


def departures(g: np.ndarray, open_windows: np.ndarray, places: dict[int, tuple[np.ndarray, int]], text: np.ndarray) -> list[dict]:
    """Stretches ``a, b`` of windows, with ``k``: a hash of the anchor and of the group of words where the window leaves the anchor's block.

    ``places`` has for an anchor the words of its block and where in them it stands. A window that does
    not leave it is left out: it is one of the first document's own.
    """
    if not len(open_windows):
        return []
    reach = WINDOW - GROUP
    at = open_windows + np.lib.stride_tricks.sliding_window_view(g, reach + 1)[open_windows].argmin(axis=1)
    met, of = np.unique(at, return_inverse=True)
    ends = np.empty((len(met), 2), np.int64)  # the words on both sides of an anchor where its block differs
    for i, a in enumerate(met.tolist()):
        held, q = places[int(g[a])]
        x, y = text[a + GROUP : a + WINDOW], held[q + GROUP : q + WINDOW]
        n = min(len(x), len(y))
        off = np.flatnonzero(x[:n] != y[:n])
        ends[i, 1] = a + GROUP + (off[0] if len(off) else n)
        x, y = text[max(0, a - reach) : a][::-1], held[max(0, q - reach) : q][::-1]
        n = min(len(x), len(y))
        off = np.flatnonzero(x[:n] != y[:n])
        ends[i, 0] = a - 1 - (off[0] if len(off) else n)
    left, right = ends[of].T
    beyond = right < open_windows + WINDOW
    leaves = beyond | (left >= open_windows)
    w = open_windows[leaves]
    key = (g[at[leaves]] * np.uint64(MIX)) ^ g[np.where(beyond, right - GROUP + 1, left)[leaves]]
    if not len(w):
        return []
    cuts = np.flatnonzero((np.diff(w) > 1) | (key[1:] != key[:-1]))
    first, last = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(w) - 1]])
    return [{"k": k, "a": a, "b": b} for k, a, b in zip(key.view(np.int64)[first].tolist(), w[first].tolist(), w[last].tolist(), strict=True)]


def parse(texts: DataFrame) -> DataFrame:
    """From ``id, t, text, hits, blocks`` the repeated windows that blocks show, and those that only their hash can settle.

    ``hits`` are the text's anchors that several documents have: ``h``, ``side`` (0: this text is the
    first with it; 1: another row of its key is; 2: a lesser key is), and the first one's text ``t`` and
    place ``p``. Returns ``id, t, shown array<struct<a, b>>`` (first and last window of each stretch),
    ``open array<struct<k, a, b>>`` (as ``departures``).
    """
    kind = dict(texts.dtypes)["id"]
    schema = f"id {kind}, t long, shown array<struct<a: int, b: int>>, open array<struct<k: long, a: int, b: int>>"
    shown_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    open_type = pa.list_(pa.struct([("k", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]))

    def one(text: str, hits: list[dict], blocks: list[dict]) -> tuple[list, list]:
        ws = words(text)
        g = groups(hashes(ws))
        a = anchors(g)
        parts = joined([(x["t"], x["b"], x["words"].split()) for x in blocks])
        ref = Reference(short(ws), [x[2] for x in parts])
        repeated = windows_in(ref.passages(), len(a)) if parts else np.zeros(len(a), bool)
        starts, begins = np.cumsum([0, *(len(x[2]) + 1 for x in parts)]).tolist(), [x[:2] for x in parts]
        places = {}
        for x in hits:
            if x["side"] == 0:
                places[x["h"] & (1 << 64) - 1] = ref.text, x["p"]
            else:
                i = bisect_right(begins, (x["t"], x["p"])) - 1  # blocks come by text and place
                places[x["h"] & (1 << 64) - 1] = ref.held[starts[i] : starts[i + 1] - 1], x["p"] - parts[i][1]
        key = np.array([x["h"] for x in hits], dtype=np.int64).view(np.uint64)
        order = np.argsort(key)
        key, side, place = key[order], np.array([x["side"] for x in hits])[order], np.array([x["p"] for x in hits])[order]
        at = np.minimum(np.searchsorted(key, a), len(key) - 1)
        i = np.arange(len(a))
        here = (side[at] == 0) & (place[at] >= i) & (place[at] <= i + WINDOW - GROUP)
        unsettled = np.flatnonzero((key[at] == a) & ~here & ~(repeated & (side[at] == 2)))
        return stretches(np.flatnonzero(repeated)), departures(g, unsettled, places, ref.text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            got = [one(x.as_py(), y.as_py(), z.as_py() or []) for x, y, z in zip(b.column(2), b.column(3), b.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], shown_type), pa.array([g[1] for g in got], open_type)], names=["id", "t", "shown", "open"])

    return texts.select("id", "t", "text", "hits", "blocks").mapInArrow(run, schema)


def window_hashes(texts: DataFrame) -> DataFrame:
    """From ``id, t, text, open`` a row ``id, t, i, w`` for each open window: its number and 128-bit hash."""
    kind = dict(texts.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            of, number, w = [], [], []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                raw = memoryview(hashes(words(x.as_py())).tobytes())
                for k in sorted({k for s in y.as_py() for k in range(s["a"], s["b"] + 1)}):
                    of.append(i)
                    number.append(k)
                    w.append(xxhash.xxh3_128_digest(raw[8 * k : 8 * (k + WINDOW)]))
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(number, pa.int32()), pa.array(w, pa.binary())], names=["id", "t", "i", "w"])

    return texts.select("id", "t", "text", "open").mapInArrow(run, f"id {kind}, t long, i int, w binary")


def strip(texts: DataFrame) -> DataFrame:
    """From ``id, t, text, shown`` (first and last windows of stretches, in any order) ``id, t, n_removed, kept``."""
    kind = dict(texts.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            n, kept = [], []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                starts = np.concatenate([np.zeros(0, np.int64), *[np.arange(s["a"], s["b"] + 1) for s in y.as_py()]])
                ws, removed = without(words(x.as_py()), np.unique(starts))
                n.append(removed)
                kept.append(b" ".join(ws).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(kept, pa.string())], names=["id", "t", "n_removed", "kept"])

    return texts.select("id", "t", "text", "shown").mapInArrow(run, f"id {kind}, t long, n_removed long, kept string")


def texts_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, t, text``: the key, a hash of the text, and the text."""
    return docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(whole_text(F.col(f"`{text}`"))).alias("t"), F.col(f"`{text}`").cast("string").alias("text"))


def several(rows: DataFrame, key: str) -> DataFrame:
    """``key, least, n``: the values of ``key`` that rows of different ids have, their least id and number of rows."""
    return rows.groupBy(key).agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").drop("most")


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What each row is, which windows are repeated, and the texts that have any.

    First result, a row for each of ``docs``: ``id, n_words, sha`` (of the words joined by one space, 32
    bytes) and ``first (id, t)``: the least key, and hash of the text, of those with the same words; null
    for rows of less than WINDOW words or a null key. Second: ``id, t, shown``, of such first texts with
    repeated windows the first and last of each stretch of them. Third: ``id, t, text``, these texts and
    some more; all texts are exchanged once, for it. Rows of a null key repeat nothing and are repeated by
    none; rows of one key do not repeat each other.
    """
    kind = dict(docs.dtypes)[key]
    texts = texts_of(docs, key, text)
    marked = cut(marks(texts, kind))
    able = marked.where(F.col("id").isNotNull() & (F.col("n_words") >= WINDOW))
    owner = cut(able.groupBy("sha").agg(F.min(F.struct("id", "t")).alias("first"), F.count(F.lit(1)).alias("n")))
    known = join_hot(able, owner, "sha", owner.agg(F.sum("n")).first()[0] or 0)
    rest = marked.where(F.col("id").isNull() | (F.col("n_words") < WINDOW)).select("id", "n_words", "sha", F.lit(None).cast(dict(owner.dtypes)["first"]).alias("first"))
    # anchors, of one text for each sequence of words
    reps = known.where((F.col("id") == F.col("first.id")) & (F.col("t") == F.col("first.t"))).dropDuplicates(["id", "t"])
    seeds = cut(reps.select("id", "t", F.explode(F.arrays_zip("hs", "ps", "again")).alias("s")).select(F.col("s.hs").alias("h"), F.col("s.ps").alias("p"), F.col("s.again").alias("again"), "id", "t"))
    first = seeds.groupBy("h").agg(F.min(F.struct("id", "t", "p")).alias("f"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("f.id") < F.col("last"))
    side = F.when(F.col("f.id") < F.col("id"), 2).when(F.col("f.t") == F.col("t"), 0).otherwise(1)
    wanted = cut(join_hot(seeds.drop("p"), cut(first.select("h", "f", "n")), "h", seeds.count()).withColumn("side", side).where("side > 0 or again").select("id", "t", "h", "f", "side"))
    hits = wanted.groupBy("id", "t").agg(F.collect_list(F.struct("h", "side", F.col("f.t").alias("t"), F.col("f.p").alias("p"))).alias("hits"))
    # blocks of the first documents
    block = F.struct(F.col("f.id").alias("id"), F.col("f.t").alias("t"), F.floor(F.col("f.p") / BLOCK).cast("int").alias("b")).alias("block")
    asked = cut(wanted.where("side > 0").select("id", "t", block).distinct())
    uses = asked.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    numbers = uses.select("block.*").groupBy("id", "t").agg(F.collect_list("b").alias("numbers"))
    needed = cut(texts.join(hits.join(numbers, ["id", "t"], "full"), ["id", "t"]).dropDuplicates(["id", "t"]))
    held = cut(cut_blocks(needed.where("numbers is not null")).join(uses, "block"))
    blocks = join_hot(asked, held, "block", asked.count()).groupBy("id", "t").agg(F.collect_list(F.struct("block.t", "block.b", "words")).alias("blocks"))
    parsed = cut(parse(needed.where("hits is not null").join(blocks, ["id", "t"], "left")))
    # windows that no block holds: where several leave a block alike, the least key with the same words
    left = parsed.select("id", "t", F.explode("open").alias("o")).select("id", "t", "o.k", F.struct("o.a", "o.b").alias("open"))
    alike = join_hot(left, cut(several(left, "k")), "k", left.count()).groupBy("id", "t").agg(F.collect_set("open").alias("open"))
    opened = cut(window_hashes(needed.select("id", "t", "text").join(alike, ["id", "t"])))
    settled = join_hot(opened, cut(several(opened, "w")), "w", opened.count()).where("least < id").select("id", "t", F.array(F.struct(F.col("i").alias("a"), F.col("i").alias("b"))).alias("shown"))
    shown = parsed.select("id", "t", "shown").where(F.size("shown") > 0).unionByName(settled)
    return known.select("id", "n_words", "sha", "first").unionByName(rest), shown.groupBy("id", "t").agg(F.array_distinct(F.flatten(F.collect_list("shown"))).alias("shown")), needed.select("id", "t", "text")


def remove_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_removed, kept, kept_sha256`` of each row, without the words of repeated passages.

    ``kept`` is null where all words stay and empty where none does; ``kept_sha256`` (hex) is that of the
    kept words joined by one space in any case. Of equal texts those of a greater key lose all their words
    if they are WINDOW or more. Null, empty and short texts lose nothing, nor do rows of a null key, which
    are repeated by none; rows of one key do not repeat each other. Repeated rows each stay a row. Texts of
    any length are treated whole; other columns are not read; an empty table stays empty.
    """
    rows, shown, texts = repeated_passages(docs, key, text)
    changed = strip(texts.join(shown, ["id", "t"]))
    copy = F.col("first.id") < F.col("id")
    same, empty = F.lower(F.hex("sha")), F.sha2(F.lit("").cast("binary"), 256)
    plain = rows.where(F.coalesce(copy, F.lit(True))).select(
        "id", "n_words", F.when(copy, F.col("n_words")).otherwise(0).alias("n_removed"), F.when(copy, "").alias("kept"), F.when(copy, empty).otherwise(same).alias("kept_sha256")
    )
    own = rows.where(~copy).select("id", "first.t", "n_words", "sha").join(changed, ["id", "t"], "left")
    parted = own.select("id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), "kept", F.coalesce(F.sha2(F.col("kept").cast("binary"), 256), same).alias("kept_sha256"))
    return plain.unionByName(parted).withColumnRenamed("id", key)


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of all documents (``remove_passages``)."""
    return remove_passages(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP11_SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM split)),
least AS (SELECT x, min(doc_id) AS first FROM windows GROUP BY 1),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS gone FROM windows JOIN least USING (x) WHERE first < doc_id GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
FROM split LEFT JOIN gone USING (doc_id)
"""

"""Best-fit packing of documents into fixed-length sequences under conflicts.

A bin never holds two pieces of one source or of one duplicate cluster. Bins are kept in order of
their residual room; each carries a bitmap of sources and clusters, each subtree of them what all its
bins hold. For a piece, the search starts at the successor of its length and goes on until the tightest
compatible bin is found.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import table, whole_text


class Bins:
    """Bins in order of residual room and number, in a binary tree that holds of each subtree what all its bins hold."""

    def __init__(self, capacity: int, most: int) -> None:
        self.shift = most.bit_length()
        self.size = 1 << capacity.bit_length() + self.shift
        self.common: dict[int, int] = {}  # node: the bits that all bins under it have; no entry where there is no bin

    def put(self, room: int, number: int, held: int | None) -> None:
        """Enters a bin and the bits that it holds, or takes it out (None)."""
        x, common = self.size + (room << self.shift) + number, self.common
        while x:
            if held is None:
                common.pop(x, None)
            else:
                common[x] = held
            beside = common.get(x ^ 1)
            held = beside if held is None else held if beside is None else held & beside
            x >>= 1

    def tightest(self, room: int, bits: int) -> tuple[int, int] | None:
        """The bin of least residual, at least ``room``, that holds none of ``bits``: the successor, then the next until one is compatible.

        Subtrees whose bins all hold one of the bits are passed over at once.
        """
        node, common = self.size + (room << self.shift), self.common
        while node:
            stack = [node]
            while stack:
                x = stack.pop()
                held = common.get(x)
                if held is None or held & bits:
                    continue
                if x >= self.size:
                    return (x - self.size) >> self.shift, (x - self.size) & (1 << self.shift) - 1
                stack += (2 * x + 1, 2 * x)
            while node & 1:
                node >>= 1
            node += node > 0
        return None


def bit_of(values: list) -> dict:
    """A number for each value that occurs more than once; the others conflict with nothing."""
    return {x: k for k, x in enumerate(x for x, n in Counter(values).items() if n > 1 and x is not None)}


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """Bin number and offset of each piece, in best-fit decreasing order (ties: earlier first).

    A null source or cluster conflicts with nothing. Lengths are 0 to ``capacity``. A search costs the
    logarithm of the capacity and the bins where conflicts are of one source or one cluster.
    """
    of_source, of_cluster = bit_of(sources), bit_of(clusters)
    tree, rooms, held = Bins(capacity, len(lengths)), [], []
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        bits = (1 << of_source[sources[i]] if sources[i] in of_source else 0) | (1 << len(of_source) + of_cluster[clusters[i]] if clusters[i] in of_cluster else 0)
        found = tree.tightest(lengths[i], bits)
        if found:
            room, b = found
            tree.put(room, b, None)
        else:
            room, b = capacity, len(rooms)
            rooms.append(capacity)
            held.append(0)
        rooms[b], held[b] = room - lengths[i], held[b] | bits
        tree.put(rooms[b], b, held[b])
        bins[i], offsets[i] = b, capacity - room
    return bins, offsets


def pack(items: DataFrame, capacity: int, key: str = "doc_id", length: str = "length", source: str = "source", cluster: str = "cluster", block_rows: int = 10_000) -> DataFrame:
    """One row for each piece: ``key, piece int, n_pieces int, start long, length int, bin long, offset int``.

    An item longer than ``capacity`` is cut into full pieces, each a bin of its own, and a rest that
    is packed like any other; nothing is dropped. A null or negative length counts as 0 and still
    takes a place. Rows are dealt at random to blocks of about ``block_rows``, each packed in one
    task, so neither a hot source nor a group of copies grows a task; copies in different blocks
    are in different bins. No setting of the session changes the blocks. A source with many rows needs
    a bin for each of them, whatever they fill. Repeated rows are packed each on its own; an empty table
    gives no pieces. Other columns are not read.
    """
    n = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0))
    narrow = items.select(F.col(key).alias("_key"), n.alias("_n"), F.col(source).cast("string").alias("_s"), F.col(cluster).cast("string").alias("_c"), F.monotonically_increasing_id().alias("_id"))
    blocks = max(1, -(-narrow.count() // block_rows))
    dealt = narrow.withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(blocks)))
    kind = dict(narrow.dtypes)["_key"]

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id", kind="stable")
        block, full = int(pdf["_block"].iloc[0]), (pdf["_n"] // capacity).where(pdf["_n"] % capacity > 0, pdf["_n"] // capacity - 1).clip(lower=0)
        rest = (pdf["_n"] - full * capacity).tolist()
        clean = lambda c: [x if isinstance(x, str) else None for x in pdf[c].tolist()]
        bins, offsets = best_fit(rest, clean("_s"), clean("_c"), capacity)
        used, rows = max(bins, default=-1) + 1, []
        for k, f, r, b, o in zip(pdf["_key"].tolist(), full.tolist(), rest, bins, offsets, strict=True):
            for p in range(f):
                rows.append((k, p, f + 1, p * capacity, capacity, (block << 32) + used, 0))
                used += 1
            rows.append((k, f, f + 1, f * capacity, r, (block << 32) + b, o))
        return pd.DataFrame(rows, columns=[key, "piece", "n_pieces", "start", "length", "bin", "offset"])

    schema = f"`{key}` {kind}, piece int, n_pieces int, start long, length int, bin long, offset int"
    return dealt.groupBy("_block").applyInPandas(place, schema)


def items_of(docs: DataFrame) -> DataFrame:
    """Packing items of documents: length is UTF-8 bytes and a separator; the cluster is that of texts equal but for case and white space.

    A null text is empty, so null and empty texts are one cluster; null sources stay null. Each row is an item.
    """
    text = whole_text(F.col("text"))
    cluster = F.xxhash64(F.regexp_replace(F.lower(text), r"\s+", " "))
    return docs.select("doc_id", "source", (F.octet_length(text) + 1).alias("length"), cluster.alias("cluster"))


#: Bytes in a sequence of the registered query and of the pipeline.
CAPACITY = 16_384


def op2_packing(spark, sf_dir):
    """Pieces of all documents in sequences of CAPACITY bytes (``pack``, ``items_of``); a null text has length 1, the separator."""
    return pack(items_of(table(spark, sf_dir, "documents", "doc_id", "text", "source")), CAPACITY)

"""SimHash near duplicates by a segment-popcount embedding.

A fingerprint's bits are cut into 16 segments of 4; its point is the vector of their bit counts. The
Manhattan distance of two points is a lower bound of the Hamming distance of the fingerprints, so
fingerprints at 2 bits or fewer share a grid cell within Manhattan distance 1 of both. Cells with two
fingerprints give one candidate pair, which is verified exactly. A cell with more is divided exactly:
two of its fingerprints at 2 bits or fewer differ from a common 64-bit midpoint by 1 bit at most, and
all (at most 65) that share a midpoint are linked to the least of them. So the work is linear in the
fingerprints however crowded a cell is, and no link is lost.

The pipeline's stage asks for more than 2 bits: texts of like signature sets (``spotsigs.near_links``)
are linked too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import spotsigs
from .common import cut, join_hot, slices, table

SEGMENTS, BITS = 16, 4
MAX_BITS = 2


def fingerprint(text: str | None) -> int:
    """Bits set in over half of the XXH64 (seed 42) of the text's 3-word shingles, with repeats; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= 3 else [b" ".join(words)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """``key, fp long`` (the 64 bits, signed) and the columns ``more`` for each row, over the whole text; null counts as empty.

    Null keys and repeated rows stay rows; other columns are not read; an empty table stays empty.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names=["_key", "fp", *b.schema.names[2:]])

    kinds = [f"`{c}` {t}" for c, t in rows.dtypes]
    return rows.mapInArrow(run, ", ".join([kinds[0], "fp long", *kinds[2:]])).withColumnRenamed("_key", key)


def segment(fp: Column, s: int) -> Column:
    return F.shiftrightunsigned(fp, s * BITS).bitwiseAND((1 << BITS) - 1)


def point(fp: Column) -> Column:
    """The 16 bit counts (0 to 4), 3 bits each, packed in a long."""
    return sum((F.shiftleft(F.bit_count(segment(fp, s)).cast("long"), 3 * s) for s in range(SEGMENTS)), F.lit(0).cast("long"))


def cells(fp: Column) -> Column:
    """Grid cells within Manhattan distance 1 of the fingerprint's point; counts stay in 0 to 4."""
    p = point(fp)
    step = [F.when(F.bit_count(segment(fp, s)) < BITS, p + F.lit(1 << 3 * s)) for s in range(SEGMENTS)]
    back = [F.when(F.bit_count(segment(fp, s)) > 0, p - F.lit(1 << 3 * s)) for s in range(SEGMENTS)]
    return F.array_compact(F.array(p, *step, *back))


def midpoints(fp: Column) -> Column:
    """The fingerprint and its 64 one-bit changes."""
    return F.array(fp, *[fp.bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)])


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at 2 bits or fewer, enough to connect all that are linked.

    Fingerprints are few bytes, but each makes up to 33 cells, so they are dealt to all tasks first.
    """
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    cell = fps.select("fp", F.explode(cells(F.col("fp"))).alias("cell"))
    sizes = cell.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where(F.col("n") > 1)
    sizes = cut(sizes)
    pairs = sizes.where(F.col("n") == 2).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b").distinct()
    crowded = cell.join(sizes.where(F.col("n") > 2).select("cell"), "cell", "left_semi")
    middle = crowded.select("fp", "cell", F.explode(F.filter(midpoints(F.col("fp")), lambda m: point(m) == F.col("cell"))).alias("mid"))  # 1 or at most 4
    star = middle.groupBy("mid").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)  # at most 65 fingerprints
    return pairs.union(star.select("a", F.explode("all").alias("b")).where(F.col("a") != F.col("b")).distinct())


def components(pairs: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``pairs (a, b)``: root is the least node that it reaches.

    Large-star and small-star rounds, each cut, until one changes nothing; every round that changes an
    edge gives it a lower end, so they settle. An edge list never leaves the executors. A star's centre
    is aggregated, not gathered, so nodes of any degree are fine.
    """
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        # large star: neighbours above a node join its least neighbour (or itself)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below a node, and it, join the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes(docs: DataFrame, key: str, text: str, likeness: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows as ``key, fp`` and the fingerprints as ``fp, component_id, n`` (rows of it).

    With ``likeness``, fingerprints whose texts' signature sets are so alike (found as
    ``spotsigs.near_links`` says; a fingerprint's text is that of its least key) are linked as well.
    Pairs that differ in over FAR bits are taken for unlike without a look at their sets.
    """
    sigs = [] if likeness is None else [spotsigs.signatures(F.col(text)).alias("_sigs")]
    marked = cut(fingerprints(docs, key, text, *sigs))
    nodes = marked.groupBy("fp").agg(F.min(key).alias("_least"), F.count(F.lit(1)).alias("n"), *[F.coalesce(F.min_by("_sigs", key), F.min("_sigs")).alias("_sigs") for _ in sigs])
    nodes = cut(nodes)
    pairs = links(nodes.select("fp"))
    if likeness is not None:
        pairs = pairs.union(spotsigs.near_links(nodes.select("fp", F.col("_sigs").alias("sigs")), likeness, "fp", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= FAR))
    roots = components(pairs)
    linked = roots.join(nodes.select("fp", "_least"), F.col("node") == F.col("fp")).select("node", "root", "_least")
    group = linked.groupBy("root").agg(F.min("_least").alias("_group"))
    moved = linked.join(group, "root").select(F.col("node").alias("fp"), "_group")
    return marked.select(key, "fp"), cut(nodes.select("fp", "_least", "n").join(moved, "fp", "left").select("fp", F.coalesce("_group", "_least").alias("component_id"), "n"))


#: Of two unrelated fingerprints about 1 in 500 pairs differs in so few bits; of texts with a likeness of 0.8, nearly all do.
FAR = 20


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp long, component_id``: the least key among documents reachable by links of 2 bits or fewer.

    Null and wordless texts have fingerprint 0 and are linked like any other. Null keys stand for no
    component that has another key. Repeated rows stay, with the same component. Documents of equal
    fingerprint are one node, so copies are never paired; other columns are not read. An empty table
    stays empty.
    """
    marked, of = classes(docs, key, text)
    total = of.agg(F.sum("n")).first()[0] or 0
    return join_hot(marked, of, "fp", total).select(key, "fp", "component_id")


def op8_simhash(spark, sf_dir):
    """``doc_id, fingerprint, component_id`` of all documents at 2 bits or fewer, as ``near_duplicates`` says."""
    out = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Likeness of signature sets from which the pipeline's stage takes two texts for copies.
LIKENESS = 0.8


def keep_one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the least doc_id stays; of repeated rows one.

    Links are those of ``near_duplicates`` and a likeness of LIKENESS or more (``classes``). A null
    doc_id comes after all others. Rows of one doc_id with different texts are different documents,
    the one with the least hash of its columns comes first. Columns may have any name; those that hold
    maps are not told apart. An empty table stays empty.
    """
    told = [c for c, t in docs.dtypes if "map<" not in t]
    quoted = lambda c: f"`{c}`"
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*map(quoted, told)).alias("x"), F.hash(*map(quoted, told)).alias("y"))
    rows = docs.select(order.alias("k"), F.struct(*map(quoted, docs.columns)).alias("row"))
    marked, of = classes(rows.select("k", F.col("row.text").alias("text")), "k", "text", LIKENESS)
    keep = cut(of.select(F.col("component_id").alias("kept")).distinct())
    again = cut(marked.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("k").alias("repeated")))
    out = rows.join(keep, F.col("k") == F.col("kept"), "left_semi")
    if not again.isEmpty():  # rows that repeat others whole
        several = out.join(again, F.col("k") == F.col("repeated"), "left_semi").dropDuplicates(["k"])
        out = out.join(again, F.col("k") == F.col("repeated"), "left_anti").unionByName(several)
    return out.select("row.*")

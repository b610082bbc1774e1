"""SpotSigs document fingerprints, in DataFrame operations only.

A spot is an occurrence of a common word (an anchor). Its signature is the anchor and the chain of the
next two content words, which skips other anchors. A text's fingerprint is the set of its signatures.
Likeness is the Jaccard index of two sets; the search for near copies partitions sets by length and
compares only those whose lengths and rarest signatures allow the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, table, whole_text

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in is that for it was on are as with be by at this from or a an "
    "der die das und ein eine ist zu von mit nicht auf für den dem im "
    "le la les de des du un une et que qui dans pour est au par "
    "el los las y en con por para una del se lo"
).split()


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` mentions it."""
    return F.transform(F.array(value), then)[0]


def signatures(text: Column) -> Column:
    """Sorted array<int> of the distinct signature hashes of a whole text; null counts as empty.

    A text without a full chain has one signature, the hash of its words in order (also if there are
    none), so equal texts always have equal, non-empty sets.
    """
    words = F.filter(F.split(F.lower(whole_text(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def spots(w: Column) -> Column:
        content = F.filter(w, lambda x: ~x.isin(ANCHORS))
        places = F.filter(F.transform(w, lambda x, i: F.when(x.isin(ANCHORS), i)), lambda i: i.isNotNull())
        # before the r-th anchor, at place p, stand p - r content words
        chains = lambda c: F.transform(places, lambda p, r: F.when(F.get(c, p - r + 1).isNotNull(), F.hash(F.get(w, p), F.get(c, p - r), F.get(c, p - r + 1))))
        return let(F.array_distinct(F.filter(let(content, chains), lambda x: x.isNotNull())), lambda s: F.when(F.size(s) > 0, F.sort_array(s)).otherwise(F.array(F.hash(F.array_join(w, " ")))))

    return let(words, spots)


def as_text(sigs: Column) -> Column:
    """The fingerprint as a string: eight hex digits for each signature, in order."""
    return F.lower(F.array_join(F.transform(sigs, lambda x: F.substring(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF) + (1 << 32)), 2, 8)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two non-empty signature sets."""
    return let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))


def below(cuts: Column, x: Column, bits: int) -> Column:
    """How many of the sorted ``cuts`` (under 2**bits) are below ``x``: a binary search."""
    step = lambda at, jump: F.when(F.get(cuts, at + jump - 1) < x, at + jump).otherwise(at)
    return F.aggregate(F.array(*[F.lit(1 << i) for i in range(bits - 1, -1, -1)]), F.lit(0), step)


#: Bytes of the columns of a range, and the most ranges that there are; beyond these a range's sort spills.
RANGE_BYTES, MOST_RANGES = 8 << 20, 10_000


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", tie: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``docs`` and, as ``next_<column>``, the columns of the row with the next lower key; after the last comes the first.

    Keys are of any type that has an order. Null keys come last (as the least number, if keys are whole
    numbers), equal keys in order of a hash of column ``tie``. The keys and hashes alone are first dealt to
    ranges of about ``range_bytes`` (of ``tie``), MOST_RANGES at most, so a key with more rows than a range,
    or many null keys, are cut by the hash (rows equal in both share a range). One key and hash for each
    range reach the driver, are broadcast, and deal the rows; so the wide columns are exchanged once. The
    greatest row of each range is also sent to the next range. Columns may have any name, but for a
    ``next_<column>``, which is replaced. An empty table stays empty.
    """
    spark = docs.sparkSession
    own = F.col(f"`{key}`")
    if dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint"):
        own = F.coalesce(own.cast("long"), F.lit(-(1 << 63)).cast("long"))
    keep = [c for c in docs.columns if c.lower() not in {f"next_{x}".lower() for x in columns}]
    at = F.struct(own.alias("k"), F.xxhash64(f"`{tie}`").alias("t")).alias("at")
    rows = docs.select(at, F.struct(*[f"`{c}`" for c in keep]).alias("row"))
    size = F.sum(F.octet_length(F.col(f"`{tie}`").cast("string")).cast("long") + 64)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(docs.agg(size).first()[0] or 0) // range_bytes))
    ranged = docs.select(at).repartitionByRange(min(parts, MOST_RANGES), "at")
    ends = [r["end"] for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.max("at").alias("end")).orderBy("p").select("end").collect()]
    kind = dict(ranged.dtypes)["at"]
    cuts = F.broadcast(spark.createDataFrame([(ends[:-1],)], f"cuts array<{kind}>"))  # one row
    sent_to = [(e, (i + 1) % len(ends)) for i, e in enumerate(ends)]
    edge = F.broadcast(spark.createDataFrame(sent_to, f"end {kind}, to int"))  # a row for each range
    dealt = rows.join(cuts).select("at", "row", below(F.col("cuts"), F.col("at"), len(ends).bit_length()).alias("range")).join(edge, F.col("at").eqNullSafe(F.col("end")), "left")
    here, there = F.struct(F.col("range").alias("to"), F.lit(False).alias("ghost")), F.struct("to", F.lit(True).alias("ghost"))
    sent = dealt.withColumn("s", F.explode(F.when(F.col("to").isNotNull(), F.array(here, there)).otherwise(F.array(here))))
    sent = sent.select("at", "row", F.col("s.to").alias("range"), "s.ghost").repartition(max(1, len(ends)), "range")
    order = Window.partitionBy("range").orderBy(F.col("ghost").desc(), "at")
    out = sent.select("row", "ghost", F.lag(F.struct(*[F.col("row")[c].alias(c) for c in columns])).over(order).alias("next")).where(~F.col("ghost"))
    return out.select("row.*", *[F.col("next")[c].alias(f"next_{c}") for c in columns])


def near_links(sets: DataFrame, least: float = 0.8, key: str = "rep", may: Column | None = None, orders: int = 4) -> DataFrame:
    """Pairs (a, b) with a < b of sets with a likeness of ``least`` or more, enough to connect what is alike.

    ``sets`` is ``key, sigs`` (sorted, distinct), one row for each key. Sets are partitioned by length,
    so that only the same and the next partition can be alike; in these, sets meet in the cell of a
    signature that is among the least of both (as many as ``least`` allows to miss, and one).
    All pairs of a cell of up to three are compared; in a larger one each set with the cell's first and
    last, so work stays linear in the cells' sizes however many sets share a signature. What comes first
    follows one of ``orders`` hashes of the key, by the signature. Like sets share many cells, and
    copies of one text meet the same few keys in them, which connects them; a pair is lost only if no
    chain of such meetings joins its ends. ``similar_pairs`` finds those too. ``may``, a condition on a
    and b, is asked before sets are compared.
    """
    n = F.size("sigs")
    part = F.floor(F.log(n.cast("double")) / F.lit(-math.log(least))).cast("int")
    prefix = F.slice("sigs", F.lit(1), (n - F.ceil(n * least - 1e-9) + 1).cast("int"))
    index = sets.select(F.col(key).alias("key"), part.alias("part"), F.explode(prefix).alias("sig")).select("key", "sig", F.explode(F.array("part", F.col("part") + 1)).alias("cell"))
    h = F.xxhash64("key", F.pmod("sig", F.lit(orders)))
    ends = index.groupBy("sig", "cell").agg(F.min_by("key", h).alias("lo"), F.max_by("key", h).alias("hi")).where("lo <> hi")
    met = index.join(ends, ["sig", "cell"]).select("key", F.explode(F.array("lo", "hi")).alias("end")).select(F.least("key", "end").alias("a"), F.greatest("key", "end").alias("b"))
    near = F.col("a") < F.col("b")
    pairs = met.where(near if may is None else near & may).distinct()
    both = pairs.join(sets.select(F.col(key).alias("a"), F.col("sigs").alias("x")), "a").join(sets.select(F.col(key).alias("b"), F.col("sigs").alias("y")), "b")
    return both.where(likeness(F.col("x"), F.col("y")) >= least).select("a", "b")


def similar_pairs(fingerprints: DataFrame, least: float = 0.8, key: str = "doc_id", sigs: str = "sigs") -> tuple[DataFrame, DataFrame]:
    """Pairs of different fingerprints with a likeness of ``least`` or more, and membership.

    First result: ``a, b, likeness`` with a < b, ids of representatives (the least key of equal
    fingerprints). Second: ``key, representative``. Copies are never paired. Sets are partitioned by
    length so that only the same and the next partition can be alike; within these, sets meet if their
    rarest signatures (those that ``least`` allows to miss, and one) do, and are compared if their
    lengths allow it. Other columns are not read; rows of a null key are of no pair but have a
    representative; an empty table gives two empty ones.
    """
    sets = cut(fingerprints.groupBy(sigs).agg(F.min(key).alias("rep")).withColumn("n", F.size(sigs)))
    member = fingerprints.join(sets.select(sigs, F.col("rep").alias("representative")), sigs).select(key, "representative")
    one = sets.select("rep", "n", F.explode(sigs).alias("sig"))
    common = one.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    rank = F.sort_array(F.collect_list(F.struct("df", "sig")))  # a set's own signatures
    prefix = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
    index = one.join(common, "sig").groupBy("rep", "n").agg(rank.alias("r")).select("rep", "n", F.explode(F.slice("r", F.lit(1), prefix.cast("int"))).alias("x")).select("rep", "n", F.col("x.sig").alias("sig"))
    length = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(least))).cast("int")
    left = index.select(F.col("rep").alias("a"), F.col("n").alias("na"), "sig", length.alias("part"))
    right = index.select(F.col("rep").alias("b"), F.col("n").alias("nb"), "sig", F.explode(F.array(length - 1, length, length + 1)).alias("part"))
    near = (F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9) & (F.col("a") < F.col("b"))
    met = left.join(right, ["sig", "part"]).where(near).select("a", "b").distinct()
    both = met.join(sets.select(F.col("rep").alias("a"), F.col(sigs).alias("_x")), "a").join(sets.select(F.col("rep").alias("b"), F.col(sigs).alias("_y")), "b")
    return both.select("a", "b", likeness(F.col("_x"), F.col("_y")).alias("likeness")).where(F.col("likeness") >= least), member


def op10_spotsigs(spark, sf_dir):
    """Fingerprints of all documents' whole texts and of their edited texts, with the likeness to these and to the next document.

    A null text is empty: its edit is empty, and its fingerprint the one signature of no words. Likeness is
    exact, so pairs are not pruned here; ``near_links`` and ``similar_pairs`` search near copies by
    length partitions, and the pipeline's stage uses the former.
    """
    text = whole_text(F.col("text"))
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.alias("text"))
    pairs = with_next(docs.withColumn("sigs", signatures(F.col("text"))), ["text", "sigs"])
    n = F.length("text")
    tail = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - tail), F.substring("next_text", F.lit(1), tail))
    both = pairs.select("doc_id", n.cast("long").alias("n_chars"), "sigs", "next_sigs", edited.alias("edited"))
    out = both.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sigs", "next_sigs", signatures(F.col("edited")).alias("edited_sigs"))
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sigs")).alias("fingerprint"), as_text(F.col("edited_sigs")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))

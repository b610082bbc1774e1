"""Importance resampling towards a target distribution: hashed n-gram weights, exact top scores.

A feature is a run of 1 to 3 words, hashed to a bucket by its CRC-32. The logarithm of a bucket's
share in the target over its share in the source is its gain, a document's weight the sum of its
features' gains. With Gumbel noise from a hash of the key added, the highest scores are a draw without
replacement in proportion to the weights. They are found by an exact histogram of the integer scores:
summed from above it gives each score's first rank, hence the cutoff; within a score, keys settle it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut, slices, table

BUCKETS = 10_000
ORDERS = 3
#: A-Z become lower case; every other ASCII character but digits and a-z is a space. Bytes from 128 on stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Words up to so many bytes (with a space before them) are appended to checksums by tables.
SHORT = 48


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "replace").translate(FOLD).split()


def byte_steps(most: int) -> np.ndarray:
    """uint32 [length, byte, value]: what a byte of a CRC-32 contributes once ``length`` zero bytes follow it."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    out = np.empty((most + 1, 4, 256), dtype=np.uint32)
    out[0] = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    for n in range(most):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ step[out[n] & 255]
    return out


STEPS = byte_steps(SHORT)


def append(crc: np.ndarray, more: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums of concatenations from the parts' own; ``size`` is the second part's length, at most SHORT."""
    moved = STEPS[size, 0, crc & 255]
    for k in (1, 2, 3):
        moved = moved ^ STEPS[size, k, (crc >> np.uint32(8 * k)) & 255]
    return moved ^ more


def features(texts: list[str | None], buckets: int = BUCKETS, orders: int = ORDERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of all texts, the text each is of, and the texts' numbers of words."""
    split = [words(t) for t in texts]
    n_words = np.array([len(w) for w in split], dtype=np.int64)
    ids: dict[bytes, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for ws in split for w in ws], dtype=np.int64)
    known = list(ids)
    alone = np.array([zlib.crc32(w) for w in known], dtype=np.uint32)[flat] if known else np.zeros(0, np.uint32)
    spaced = np.array([zlib.crc32(b" " + w) for w in known], dtype=np.uint32)[flat] if known else alone
    size = np.array([len(w) + 1 for w in known], dtype=np.int64)[flat] if known else flat
    of = np.repeat(np.arange(len(texts)), n_words)
    found, owner, crc = [alone], [of], alone
    for n in range(1, orders):
        crc = crc[:-1]
        more, long = spaced[n:], size[n:]
        grown = append(crc, more, np.minimum(long, SHORT))
        for i in np.flatnonzero(long > SHORT):
            grown[i] = zlib.crc32(b" " + known[flat[i + n]], int(crc[i]))
        inside = of[n:] == of[: len(of) - n]
        crc = grown
        found.append(crc[inside])
        owner.append(of[n:][inside])
    return np.concatenate(found) % np.uint32(buckets), np.concatenate(owner), n_words


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all whole texts fall into each bucket; ``buckets`` numbers are all that reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in slices(batches, 128):
            total += np.bincount(features(b.column(0).to_pylist(), buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counted = docs.select(F.col(text).cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in counted.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and source, rounded down."""
    s, t, k = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words long, n_features long, weight long`` of each row, over the whole text; a null text has no feature."""
    kind, gain = dict(docs.dtypes)[key], gain.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            bucket, of, n = features(b.column(1).to_pylist(), len(gain))
            sums = np.bincount(of, weights=gain[bucket], minlength=b.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(np.bincount(of, minlength=b.num_rows)), pa.array(sums)], names=["_key", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    return rows.mapInArrow(run, f"_key {kind}, n_words long, n_features long, weight long").withColumnRenamed("_key", key)


def noise(key: Column, seed: int = 42) -> Column:
    """Thousandths of a standard Gumbel variable that is the same for the same key, rounded down; null for a null key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def first_ranks(rows: DataFrame, score: str) -> DataFrame:
    """``score, before``: how many rows have a higher score, for each score there is.

    The histogram is dealt by ranges of the score; sums of whole ranges (one number each, on the
    driver) are carried into running sums inside the ranges.
    """
    spark = rows.sparkSession
    counts = rows.groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(counts.repartitionByRange(parts, F.desc(score)).withColumn("_part", F.spark_partition_id()))
    held = ranged.groupBy("_part").agg(F.sum("_n").alias("n")).orderBy("_part").collect()
    starts = np.cumsum([0, *[r["n"] for r in held]]).tolist()
    carried = spark.createDataFrame([(r["_part"], at) for r, at in zip(held, starts, strict=False)], "_part int, _start long")
    inside = F.sum("_n").over(Window.partitionBy("_part").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(carried), "_part").select(score, (F.col("_start") + F.col("_inside")).alias("before"))


def highest(rows: DataFrame, k: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    """``rows`` with ``rank long``: 1 to ``k`` by falling score, then rising key; null beyond ``k`` and for a null score.

    Only rows at or above the cutoff score are ranked. ``rows`` is read several times, so it should be
    cut. Rows equal in score and key share out their ranks in any order. A column rank is replaced.
    """
    if k <= 0:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    ranks = cut(first_ranks(rows.where(F.col(score).isNotNull()), score).where(F.col("before") < k))
    cutoff = ranks.agg(F.min(score)).first()[0]
    if cutoff is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    above = rows.where(F.col(score) >= cutoff).join(ranks.withColumnRenamed("before", "_before"), score)
    at = F.col("_before") + F.row_number().over(Window.partitionBy(score).orderBy(F.col(key).asc_nulls_last()))
    ranked = above.withColumn("rank", F.when(at <= k, at)).drop("_before")
    return ranked.select(*rows.columns, "rank").unionByName(rows.where(F.coalesce(F.col(score) < cutoff, F.lit(True))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``key, n_words, n_features, weight, score, rank`` of each row of ``docs``: a draw of ``percent`` that resembles ``target``.

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) are drawn, those of the
    highest scores; rank is null for the others. Null and wordless texts have no feature and weight 0.
    A row with a null key has no noise, so its score and rank are null, and N leaves it out. Repeated
    rows are rows like any other (equal score, ranks in any order); an empty table stays empty, an
    empty target has no features. Other columns are not read. Texts of any length count whole.
    """
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    scored = cut(weigh(docs, gain, key, text).withColumn("score", F.col("weight") + noise(F.col(key))))
    fit = F.col("n_words") >= least_words
    n = scored.where(fit & F.col("score").isNotNull()).count()
    drawn = highest(scored.withColumn("_fit", F.when(fit, F.col("score"))), percent * n // 100, "_fit", key)
    return drawn.select(key, "n_words", "n_features", "weight", "score", "rank")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of all documents, resampled towards ``benchmark`` (``resample``)."""
    out = resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: The step table of CRC-32 is made by eight shifts of each byte; a gram's checksum then takes a step for each of its bytes.
OP13_SQL = r"""
WITH step AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS n))),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
split AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (
  SELECT side, id, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM (SELECT side, id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM split, (SELECT unnest([1, 2, 3]) AS n))),
known AS (
  SELECT gram, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, octet_length(encode(gram)) + 1), lambda i: ('0x' || substr(hex(encode(gram)), (2 * i - 1)::BIGINT, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT gram FROM grams), step),
found AS (SELECT side, id, bucket FROM grams JOIN known USING (gram)),
sums AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM found GROUP BY 1),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE)))::BIGINT AS gain FROM sums),
weights AS (SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM found JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1),
scored AS (
  SELECT doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weights ON doc_id = weights.id JOIN split ON side = 'd' AND split.id = doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n >= 20) AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n >= 20 AND r <= 5 * fit // 100 THEN r END AS rank FROM ranked
"""

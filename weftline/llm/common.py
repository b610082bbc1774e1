"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weftline.sources.shared import folder, once

#: Words are maximal runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as in ``sources.shared``."""
    return folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that lost executors cost no recomputation."""
    return once(df)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, without a copy, so that few texts are Python objects at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def whole_text(text: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


#: A key with more than this part of all rows is hot; there are at most so many of them.
HOT_PART = 1024


def join_hot(rows: DataFrame, side: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``side`` (one row for each ``key``, and ``n``: how many of the ``total`` rows have it).

    Hot keys' rows (at most HOT_PART keys) meet a broadcast, all others an exchange, so no key gathers
    its rows in a task.
    """
    hot = side.where(F.col("n") * HOT_PART > total).drop("n").collect()
    if not hot:
        return rows.join(side.drop("n"), key)
    few = F.broadcast(rows.sparkSession.createDataFrame(hot, side.drop("n").schema))
    rest = rows.join(few.select(key), key, "left_anti").join(side.drop("n"), key)
    return rows.join(few, key).unionByName(rest)


def one_text(docs: DataFrame, chosen: DataFrame, *more: str) -> DataFrame:
    """Columns ``more`` of a small table of doc_ids and the ``text`` of each; of several texts of an id that of least hash, null counts as empty."""
    text = whole_text(F.col("text"))
    rows = docs.select("doc_id", F.struct(F.xxhash64(text).alias("h"), text.alias("t")).alias("x")).join(F.broadcast(chosen.select("doc_id", *more)), "doc_id")
    return rows.groupBy("doc_id", *more).agg(F.min("x").alias("x")).select(*more, F.col("x.t").alias("text"))


#: So many distinct keys of a sample are taken at most.
MOST_KEYS = 1_000


def bounded_sample(df: DataFrame, key: str, order: Column, limit: int, most_keys: int = MOST_KEYS) -> DataFrame:
    """At most ``limit`` rows for each of the ``most_keys`` most frequent values of ``key``, those of least ``order`` (a hash).

    A first pass counts the keys; a filter on the hash, with room for chance, then leaves about
    ``2 * limit`` rows a key before the exact ranking, so no task ever holds a frequent key whole.
    Used only to fit classifiers; ``limit`` and ``most_keys`` are their documented bounds.
    """
    n = F.count(F.lit(1))
    counted = df.groupBy(F.col(key).alias("_key")).agg(n.alias("_count")).orderBy(F.desc("_count"), "_key")
    share = counted.select("_key", F.least(F.lit(1.0), F.lit(2.0 * limit + 200.0) / F.col("_count")).alias("_share"))
    few = F.broadcast(df.sparkSession.createDataFrame(share.take(most_keys), share.schema))
    draw = (F.pmod(order, F.lit(1 << 30)) / float(1 << 30)).alias("_draw")
    near = df.select("*", draw).join(few, F.col(key) == F.col("_key")).where(F.col("_draw") < F.col("_share"))
    rank = F.row_number().over(Window.partitionBy("_key").orderBy("_draw", *[c for c in df.columns if c != key]))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_key", "_share", "_draw", "_rank")

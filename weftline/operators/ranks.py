"""Average ranks in groups of any size, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from weftline.sources.shared import once


def average_ranks(rows: DataFrame, value: str, part: list[str], name: str = "rank") -> DataFrame:
    """``rows`` with ``name`` (from 1; ties share their mean) and ``n``, the group's non-null values; null values have no rank.

    The different values are counted, dealt to ranges of (group, value), and counts summed over the
    ranges before and inside a range: a task holds a range's values, however many rows a group or a value
    has. Ranks then meet the rows by an equi-join on group and value.
    """
    spark = rows.sparkSession
    counts = rows.where(F.col(value).isNotNull()).groupBy(*part, value).agg(F.count(F.lit(1)).alias("_c"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = once(counts.repartitionByRange(parts, *part, value).withColumn("_range", F.spark_partition_id()))
    held = ranged.groupBy(*part, "_range").agg(F.sum("_c").alias("_held"))  # a group's rows here are as many as its ranges
    ranges = Window.partitionBy(*part)
    before = F.coalesce(F.sum("_held").over(ranges.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select(*part, "_range", before.alias("_before"), F.sum("_held").over(ranges).alias("n"))
    inside = F.coalesce(F.sum("_c").over(Window.partitionBy(*part, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.col("_before") + F.col("_inside") + (F.col("_c") + 1) / 2.0
    ranked = ranged.withColumn("_inside", inside).join(starts, [*part, "_range"]).select(*part, value, rank.alias(name), "n")
    return rows.join(ranked, [*part, value], "left").select(*rows.columns, name, "n")

"""Panels ``ts, node, value`` and their returns under explicit policies for missing data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: What to do about a missing node-day.
POLICIES = ("diff_then_drop", "drop_then_diff", "fill", "complete_columns", "level_diff")


def panel(facts: DataFrame, ts, node, value) -> DataFrame:
    """Sum of ``value`` for each (ts, node); summed on the map side before the exchange."""
    return facts.groupBy(ts.alias("ts"), node.alias("node")).agg(F.sum(value).alias("value"))


def axis(p: DataFrame) -> DataFrame:
    """``ts, pos`` from 0. The axis is the calendar, thousands of rows at any data size, so one task may number it."""
    return p.select("ts").distinct().withColumn("pos", F.row_number().over(Window.orderBy("ts")) - 1)


def complete_rows(p: DataFrame) -> DataFrame:
    """Rows of dates on which every node has a value."""
    present = p.where(F.col("value").isNotNull())
    full = present.groupBy("ts").agg(F.count("node").alias("c"))
    nodes = p.agg(F.countDistinct("node").alias("c"))
    return present.join(full.join(F.broadcast(nodes), "c").select("ts"), "ts", "left_semi")  # one row


def complete_nodes(p: DataFrame) -> DataFrame:
    """Nodes with a value on every date."""
    present = p.where(F.col("value").isNotNull())
    per = present.groupBy("node").agg(F.countDistinct("ts").alias("c"))
    dates = p.agg(F.countDistinct("ts").alias("c"))
    return present.join(per.join(F.broadcast(dates), "c").select("node"), "node", "left_semi")  # one row


def grid(p: DataFrame) -> DataFrame:
    """All (ts, node), with null values where there is no row; both lists are small, their product is the panel's own size."""
    return p.select("ts").distinct().crossJoin(p.select("node").distinct()).join(p, ["ts", "node"], "left")


def filled(p: DataFrame) -> DataFrame:
    """The grid filled forward, then backward, for each node; nodes without a value are not in it."""
    back = Window.partitionBy("node").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("node").orderBy("ts").rowsBetween(0, Window.unboundedFollowing)
    g = grid(p).withColumn("f", F.last("value", True).over(back))
    return g.select("ts", "node", F.coalesce("f", F.first("f", True).over(ahead)).alias("value")).where(F.col("value").isNotNull())


def changes(p: DataFrame, log: bool = True) -> DataFrame:
    """Log returns (or differences) from each node's row before; the first has none. Only positive values have logs."""
    v = F.when(F.col("value") > 0, F.log("value")) if log else F.col("value")
    return p.withColumn("ret", v - F.lag(v).over(Window.partitionBy("node").orderBy("ts"))).select("ts", "node", "ret")


def returns(p: DataFrame, policy: str = "drop_then_diff") -> DataFrame:
    """``ts, node, ret`` on dates that are complete under the policy."""
    if policy == "drop_then_diff":
        return changes(complete_rows(p)).where(F.col("ret").isNotNull())
    if policy == "fill":
        return changes(filled(p)).where(F.col("ret").isNotNull())
    if policy == "complete_columns":
        return changes(complete_nodes(p)).where(F.col("ret").isNotNull())
    if policy not in POLICIES:
        raise ValueError(f"no such policy: {policy}")
    # a gap is a null on the grid, and takes the change after it as well; then the whole date
    r = changes(grid(p), log=policy == "diff_then_drop").withColumnRenamed("ret", "value")
    return complete_rows(r).withColumnRenamed("value", "ret")


def wide(p: DataFrame, nodes: list[str], value: str = "value") -> DataFrame:
    return p.groupBy("ts").pivot("node", nodes).agg(F.first(value))

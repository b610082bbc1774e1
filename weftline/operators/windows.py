"""Row-count windows: hop windows as an equi-join, horizons, rolling statistics, delay vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .panel import axis


def hops(a: DataFrame, width: int, step: int) -> DataFrame:
    """``win, end, end_ts``: windows of rows [end - width, end) for end = width, width + step, ... below the number of rows.

    ``a`` is an axis ``ts, pos``. The last row never ends a window.
    """
    n = a.agg(F.count(F.lit(1)).alias("n"))
    ends = n.where(F.col("n") > width).select(F.explode(F.sequence(F.lit(width), F.col("n") - 1, F.lit(step))).alias("end"))
    return ends.join(a, F.col("end") - 1 == F.col("pos")).select(((F.col("end") - width) / step).cast("int").alias("win"), "end", F.col("ts").alias("end_ts"))


def members(rows: DataFrame, a: DataFrame, width: int, step: int) -> DataFrame:
    """``rows`` (with ts) once for each window that holds their date, with ``win, pos``.

    A date's windows follow from its position, so they are listed and exploded: an equi-join on ts and
    no range join.
    """
    n = a.agg(F.count(F.lit(1)).alias("n"))
    low = F.greatest(F.floor((F.col("pos") - width) / step) + 1, F.lit(0))
    high = F.least(F.floor(F.col("pos") / step), F.ceil((F.col("n") - width) / step) - 1)
    where = a.join(F.broadcast(n)).select("ts", "pos", low.alias("low"), high.alias("high")).where("low <= high")  # one row
    placed = where.select("ts", "pos", F.explode(F.sequence(F.col("low").cast("int"), F.col("high").cast("int"))).alias("win"))
    return rows.join(placed, "ts")


def horizon(df: DataFrame, value: str, ahead: int, part: list[str], order: str = "ts") -> DataFrame:
    """Sum of the next ``ahead`` rows, null unless all are there."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(1, ahead)
    return df.withColumn("forward", F.when(F.count(value).over(w) == ahead, F.sum(value).over(w)))


def ahead(m: DataFrame, ends: DataFrame, rows: DataFrame, size: int, value: str = "ret") -> DataFrame:
    """``win, node, ahead``: the sum of each node's ``size`` rows after a window's end; windows with fewer have none. ``rows`` is ``ts, node, value``."""
    days = ends.select("win", F.explode(F.sequence(F.col("end"), F.col("end") + size - 1)).alias("pos")).join(axis(rows), "pos")
    return days.join(rows, "ts").groupBy("win", "node").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("ahead")).where(F.col("_n") == size).drop("_n")


def halves(df: DataFrame, burn_in: int, order: str = "win") -> DataFrame:
    """The rows (one for each window) after the first ``burn_in``, with ``half``: early or late."""
    k, n = F.row_number().over(Window.orderBy(order)), F.count(F.lit(1)).over(Window.partitionBy())
    kept = df.withColumns({"_k": k - burn_in, "_n": n - burn_in}).where("_k > 0")
    return kept.withColumn("half", F.when(F.col("_k") <= F.col("_n") / 2, "early").otherwise("late")).drop("_k", "_n")


def rolling_mean(df: DataFrame, value: str, rows: int, part: list[str], order: str = "ts") -> DataFrame:
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(1 - rows, 0)
    return df.withColumn("rolling", F.when(F.count(value).over(w) == rows, F.avg(value).over(w)))


def delay_vectors(df: DataFrame, value: str, dim: int, delay: int, part: list[str], order: str = "ts") -> DataFrame:
    """``vector`` of the value and its ``dim - 1`` successors at steps of ``delay``; only full ones."""
    w = Window.partitionBy(*part).orderBy(order)
    cells = [F.lead(value, k * delay).over(w) for k in range(dim)]
    return df.withColumn("vector", F.array(*cells)).where(F.forall("vector", lambda x: x.isNotNull()))


__all__ = ["ahead", "axis", "delay_vectors", "halves", "hops", "horizon", "members", "rolling_mean"]

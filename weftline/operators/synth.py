"""Synthetic returns with known epicentres as columns over a range of simulations, and hit rates against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import draws

#: Loadings of a shocked group on its factor and of all other nodes on the common one; nodes in a group.
STRONG, WEAK, GROUP = 0.90, 0.25, 3


def places(spark: SparkSession, sims: int, first: int, last: int, nodes: int) -> DataFrame:
    """``sim, pos, i, node`` for rows ``first`` to ``last`` - 1."""
    s = spark.range(sims).select(F.col("id").alias("sim"), F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("pos"))
    return s.select("sim", "pos", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("i")).withColumn("node", F.format_string("n%02d", "i"))


def epicentres(spark: SparkSession, sims: int, k: int, nodes: int = 16, rows: tuple[int, int] = (0, 200), shock: int = 100, frustrated: bool = False) -> DataFrame:
    """``sim, pos, node, ret, truth``: before the shock all is noise; after it, k groups of GROUP nodes load STRONG on a factor of their own and all others WEAK on a common one.

    All nodes of the groups are true epicentres. ``frustrated`` turns the loading of every second node of a group.
    """
    if GROUP * k > nodes:
        raise ValueError(f"{k} groups of {GROUP} do not fit in {nodes} nodes")
    g = F.floor(F.col("i") / GROUP)
    # a row's own number, then the factors' (the common one is the last)
    number = lambda j: (F.col("sim") * 1000 + F.col("pos")) * (nodes + k + 1) + j
    own, factor, common = draws.normal(number(F.col("i"))), draws.normal(number(nodes + g)), draws.normal(number(F.lit(nodes + k)))
    sign = F.when(F.lit(frustrated) & (F.col("i") % GROUP % 2 == 1), -1.0).otherwise(1.0)
    truth = F.col("i") < GROUP * k
    mix = lambda b, f: b * f + (1 - b * b) ** 0.5 * own
    ret = F.when(F.col("pos") < shock, own).when(truth, sign * STRONG * factor + (1 - STRONG**2) ** 0.5 * own).otherwise(mix(WEAK, common))
    return places(spark, sims, *rows, nodes).select("sim", "pos", "node", ret.alias("ret"), truth.alias("truth"))


def diffusing(spark: SparkSession, sims: int, widening: Column, nodes: int = 10, rows: int = 260) -> DataFrame:
    """``sim, pos, node, ret``: one factor that jumps at row 50 and fades after row 90; where ``widening`` (of column i) is true, own noise grows from then on.

    All true: an epicentre that tells its nodes apart; none: nodes that follow only; the first half: a
    group put together from both.
    """
    pos = F.col("pos")
    number = lambda j: (F.col("sim") * 1000 + pos) * (nodes + 1) + j + 500_000_000
    level = F.when(pos < 50, 0.0).when(pos <= 90, 3.0).otherwise(3.0 * F.exp(-(pos - 90) / 40))
    factor = level + 0.3 * draws.normal(number(F.lit(nodes)))
    sigma = F.when(widening & (pos > 90), 0.3 + 0.04 * (pos - 90)).otherwise(0.3)
    return places(spark, sims, 0, rows, nodes).select("sim", "pos", "node", (0.85 * factor + sigma * draws.normal(number(F.col("i")))).alias("ret"))


def hit_rate(scores: DataFrame, score: str, k: int, part: list[str]) -> DataFrame:
    """Mean share of the true nodes among the ``k`` of largest score."""
    from .portfolio import top_k

    return top_k(scores, score, k, part).groupBy(*part).agg((F.count_if("truth") / k).alias("hit")).agg(F.avg("hit").alias("hit_rate"))


def retention(df: DataFrame, value: str, part: list[str], order: str = "t", after: int = 150) -> DataFrame:
    """Mean of the values after row ``after`` over the peak."""
    late = F.avg(F.when(F.col(order) > after, F.col(value)))
    return df.groupBy(*part).agg(F.max(value).alias("peak"), late.alias("late")).withColumn("retention", F.try_divide("late", "peak"))

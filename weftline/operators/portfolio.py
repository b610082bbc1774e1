"""Baskets, walk-forward equity with costs, exposure rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(scores: DataFrame, score: str, k: Column | int, part: list[str], largest: bool = True, tie: str = "node") -> DataFrame:
    """The ``k`` best rows of each group with ``place``; k may be a column (a basket size that varies). Ties go to the least node."""
    s = F.col(score).desc() if largest else F.col(score).asc()
    return scores.withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy(s, tie))).where(F.col("place") <= k)


def equal_weights(basket: DataFrame, part: list[str]) -> DataFrame:
    return basket.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*part)))


def top_weights(nodes: DataFrame, score: str, k: int | None) -> DataFrame:
    """``node, weight``: equal weights of the ``k`` nodes of highest score, of all without k. ``nodes`` has a row for each node."""
    chosen = nodes if k is None else top_k(nodes, score, k, [])
    return equal_weights(chosen, []).select("node", "weight")


def long_short(nodes: DataFrame, score: str) -> DataFrame:
    """``node, weight``: the half of highest score long and the others short, each half of weight 1."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.col(score).desc(), "node"))
    return nodes.select("node", F.when(place <= n / 2, 2 / n).otherwise(-2 / n).alias("weight"))


def excess(basket: DataFrame, all_nodes: DataFrame, outcome: str, part: list[str]) -> DataFrame:
    """Mean outcome of each basket less the mean of all nodes (one over n)."""
    b = basket.groupBy(*part).agg(F.avg(outcome).alias("basket"))
    m = all_nodes.groupBy(*part).agg(F.avg(outcome).alias("market"))
    return b.join(m, part).withColumn("excess", F.col("basket") - F.col("market"))


def turnover(weights: DataFrame, part: list[str], step: str) -> DataFrame:
    """``turnover``: the sum of absolute weight changes between rebalances; 1 at the first.

    A weight that ends, or begins, counts whole: each node's weights meet the previous step's by an equi-join.
    """
    steps = weights.select(*part, step).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(*part).orderBy(step)))
    now = weights.join(steps, [*part, step]).select(*part, "_n", "node", "weight")
    before = now.select(*part, (F.col("_n") + 1).alias("_n"), "node", F.col("weight").alias("_old"))
    change = now.join(before, [*part, "_n", "node"], "full").groupBy(*part, "_n").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("_old", F.lit(0.0)))).alias("turnover"))
    return steps.join(change, [*part, "_n"]).select(*part, step, F.when(F.col("_n") == 1, 1.0).otherwise(F.col("turnover")).alias("turnover"))


def walk_forward(weights: DataFrame, returns: DataFrame, turnovers: DataFrame, part: list[str], cost: float = 0.001) -> DataFrame:
    """``part, pos, ret, equity, drawdown``: portfolio log returns with the cost charged at each rebalance.

    ``weights`` is ``win, end, node, weight`` with segments [end, next end): the estimation window ends
    before the segment, so nothing looks ahead. ``returns`` is ``pos, node, ret``.
    """
    seg = weights.select(*part, "win", "end").distinct()
    seg = seg.withColumn("next", F.lead("end").over(Window.partitionBy(*part).orderBy("end"))).where(F.col("next").isNotNull())
    days = seg.withColumn("pos", F.explode(F.sequence("end", F.col("next") - 1)))
    r = days.join(weights.select(*part, "win", "node", "weight"), [*part, "win"]).join(returns, ["pos", "node"])
    daily = r.groupBy(*part, "win", "end", "pos").agg(F.sum(F.col("weight") * (F.exp("ret") - 1)).alias("g"))
    daily = daily.join(turnovers, [*part, "win"]).withColumn("ret", F.log1p(F.col("g")) + F.when(F.col("pos") == F.col("end"), F.log1p(-cost * F.col("turnover"))).otherwise(0.0))
    w = Window.partitionBy(*part).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.select(*part, "pos", "ret").withColumn("equity", F.sum("ret").over(w))
    return out.withColumn("drawdown", F.exp(F.col("equity") - F.max("equity").over(w)) - 1)


def start_dates(path: DataFrame, part: list[str], horizon: int, every: int = 1) -> DataFrame:
    """``start, value``: log value of holding from each start for ``horizon`` rows, from differences of the running sum."""
    w = Window.partitionBy(*part).orderBy("pos")
    n = F.row_number().over(w)
    p = path.withColumn("_n", n).withColumn("value", F.lead("equity", horizon - 1).over(w) - F.col("equity") + F.col("ret"))
    return p.where((F.col("_n") - 1) % every == 0).where(F.col("value").isNotNull()).select(*part, F.col("pos").alias("start"), "value")


def start_drawdowns(path: DataFrame, part: list[str], horizon: int, every: int = 1) -> DataFrame:
    """``start, drawdown``: the greatest fall from a peak while holding from each start for ``horizon`` rows, the value before the start included.

    A stretch's greatest and least equity and its fall are put together from those of two halves, so
    stretches of 1, 2, 4, ... rows are joined by shifts of one window until they make up the horizon: a
    number of steps that grows with its logarithm, and no row meets each of its followers.
    """
    w = Window.partitionBy(*part).orderBy("pos")

    def put(a: dict[str, Column], b: Column) -> dict[str, Column]:
        return {"top": F.greatest(a["top"], b["top"]), "low": F.least(a["low"], b["low"]), "fall": F.least(a["fall"], b["fall"], b["low"] - a["top"])}

    e, base = F.col("equity"), F.col("equity") - F.col("ret")
    p = path.select(*part, "pos", "equity", "ret").withColumn("_n", F.row_number().over(w))
    p = p.withColumn("_power", F.struct(e.alias("top"), e.alias("low"), F.lit(0.0).alias("fall")))  # of 2**k rows from here
    p = p.withColumn("_all", F.struct(base.alias("top"), base.alias("low"), F.lit(0.0).alias("fall")))  # of the rows so far, after the value before the start
    done, size = 0, 1
    fields = lambda c: {f: F.col(c)[f] for f in ("top", "low", "fall")}
    pack = lambda d: F.struct(*[x.alias(c) for c, x in d.items()])
    while done < horizon:
        if horizon & size:
            p = p.withColumn("_next", F.lead("_power", done).over(w)).withColumn("_all", F.when(F.col("_next").isNotNull() & F.col("_all").isNotNull(), pack(put(fields("_all"), F.col("_next")))))
            done += size
        if done < horizon:
            p = p.withColumn("_next", F.lead("_power", size).over(w)).withColumn("_power", F.when(F.col("_next").isNotNull() & F.col("_power").isNotNull(), pack(put(fields("_power"), F.col("_next")))))
            size *= 2
    kept = p.where((F.col("_n") - 1) % every == 0).where(F.col("_all").isNotNull())
    return kept.select(*part, F.col("pos").alias("start"), (F.exp(F.col("_all")["fall"]) - 1).alias("drawdown"))


def distribution(starts: DataFrame, rule: str, base: str) -> DataFrame:
    """Tenth, fiftieth and ninetieth percentile of the value and the share of starts at which a rule beats ``base``."""
    b = starts.where(F.col(rule) == base).select("start", F.col("value").alias("_base"))
    return starts.join(b, "start").groupBy(rule).agg(F.percentile("value", 0.1).alias("p10"), F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.9).alias("p90"), F.avg((F.col("value") > F.col("_base")).cast("double")).alias("beats"))


def performance(r: DataFrame, value: str, part: list[str], per_year: float = 252.0) -> DataFrame:
    """Annual return and volatility, Sharpe ratio (population deviation) and maximal drawdown."""
    w = Window.partitionBy(*part).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    e = r.withColumn("_e", F.sum(value).over(w))
    e = e.withColumn("_d", F.exp(F.col("_e") - F.max("_e").over(w)) - 1)
    a = e.groupBy(*part).agg((F.avg(value) * per_year).alias("annual"), (F.stddev_pop(value) * per_year**0.5).alias("volatility"), F.min("_d").alias("max_drawdown"))
    return a.withColumn("sharpe", F.try_divide("annual", F.nullif(F.col("volatility"), F.lit(0.0))))


def exposures(signal: Column, cdf: Column, volatility: Column, target: float) -> dict[str, Column]:
    """Exposure in [0, 1] by rule: hold, volatility target, stress (1 - its own past distribution) and the inverse of that."""
    vol = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(target), volatility), F.lit(1.0)))
    return {"hold": F.lit(1.0), "vol_target": vol, "stress": F.coalesce(1 - cdf, F.lit(1.0)), "inverse": F.coalesce(cdf, F.lit(0.0))}


def gate_and_condition(balance: Column, gap: Column, at: Column | float, gap_at: Column | float) -> Column:
    return (balance >= at) & (gap >= gap_at)

"""Resampling and multiple testing as joins, windows and aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import draws
from .network import average_rank

#: A fixed linear congruence draws block starts, so that other engines can repeat them.
LCG = (1_103_515_245, 12_345, 2_147_483_648)


def block_starts(spark, n: int, replicates: int, block: int, fill: bool = True) -> DataFrame:
    """``rep, at, src``: for each replicate, n rows made of blocks of consecutive rows from drawn starts below n - block.

    Without ``fill`` only whole blocks, so a replicate may be some rows short.
    """
    blocks = n // block + (1 if fill else 0)
    a, c, m = LCG
    draw = lambda x: F.pmod(x * a + c, F.lit(m))
    r = spark.range(replicates).select(F.col("id").alias("rep")).withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    r = r.withColumn("start", F.pmod(F.floor(draw(draw(F.col("rep") * blocks + F.col("blk"))) / 1024), F.lit(max(1, n - block))))
    r = r.withColumn("off", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    return r.select("rep", (F.col("blk") * block + F.col("off")).cast("int").alias("at"), (F.col("start") + F.col("off")).cast("int").alias("src")).where(F.col("at") < n)


def paired_f1(sample: DataFrame, by: list[str], a: str, b: str, share: float = 0.9) -> DataFrame:
    """``by, delta``: F1 at the quantile of column a less that of b, in each replicate."""
    q = sample.groupBy(*by).agg(F.percentile(a, share).alias("qa"), F.percentile(b, share).alias("qb"))
    f1 = lambda x, t: F.coalesce(F.try_divide(2.0 * F.count_if((F.col(x) >= F.col(t)) & F.col("crisis")), F.count_if(F.col(x) >= F.col(t)) + F.count_if("crisis")), F.lit(0.0))
    return sample.join(q, by).groupBy(*by).agg((f1(a, "qa") - f1(b, "qb")).alias("delta"))


def block_bootstrap(df: DataFrame, a: str, b: str, n: int, replicates: int = 2000, block: int = 60) -> DataFrame:
    """Mean, 95 % interval and share of differences at or below 0 over replicates. ``df`` is ``pos, crisis, a, b``; ``n`` its rows."""
    drawn = block_starts(df.sparkSession, n, replicates, block).join(df, F.col("src") == F.col("pos"))
    d = paired_f1(drawn, ["rep"], a, b)
    return d.agg(F.avg("delta").alias("mean"), F.percentile("delta", 0.025).alias("lo"), F.percentile("delta", 0.975).alias("hi"), F.avg((F.col("delta") <= 0).cast("double")).alias("p"))


def holm(tests: DataFrame, p: str = "p", alpha: float = 0.05, part: list[str] | None = None, tie: str = "test") -> DataFrame:
    """``threshold`` alpha / (m - i) by ascending p and ``holm``: rejected until the first failure. A family is as small as its tests."""
    part = part or []
    w = Window.partitionBy(*part).orderBy(p, tie)
    m = F.count(F.lit(1)).over(Window.partitionBy(*part))
    t = tests.withColumn("threshold", F.lit(alpha) / (m - F.row_number().over(w) + 1))
    ok = F.min((F.col(p) <= F.col("threshold")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("holm", ok == 1)


def shift_test(rows: DataFrame, x: str, y: str, part: list[str], shifts: int = 200) -> DataFrame:
    """``part, rho, p``: the correlation of two series of each group, and how often it is reached when one is turned around by 1 to ``shifts`` rows.

    ``rows`` is ``part, pos, x, y`` with pos from 0 without gaps. Turning keeps each series' own
    dependence on its past. Rows grow with the calendar times the shifts.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*part))
    left = rows.select(*part, "pos", F.col(x).alias("_x"), n.alias("_n")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(shifts))))
    left = left.select(*part, "_s", "_x", ((F.col("pos") + F.col("_s")) % F.col("_n")).alias("_at"))
    met = left.join(rows.select(*part, F.col("pos").alias("_at"), F.col(y).alias("_y")), [*part, "_at"])
    rho = met.groupBy(*part, "_s").agg(F.round(F.corr("_x", "_y"), 9).alias("_rho"))
    own = F.max(F.when(F.col("_s") == 0, F.col("_rho")))
    seen = rho.groupBy(*part).agg(own.alias("rho"), F.collect_list(F.when(F.col("_s") > 0, F.abs("_rho"))).alias("_all"))  # as many as there are shifts
    reached = F.size(F.filter("_all", lambda v: v >= F.abs("rho")))
    return seen.select(*part, "rho", ((reached + 1) / (F.size("_all") + 1)).alias("p"))


def spearman(df: DataFrame, a: str, b: str, part: list[str]) -> DataFrame:
    """``pearson`` and ``spearman`` of complete pairs; null without variance."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b))
    r = both.withColumns({"_ra": average_rank(F.col(a), part), "_rb": average_rank(F.col(b), part)})
    return r.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), correlation(a, b).alias("pearson"), correlation("_ra", "_rb").alias("spearman"))


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation that is null, and no error, without variance."""
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def lead_lag(df: DataFrame, signal: str, target: str, low: int, high: int) -> DataFrame:
    """``k, n, rho``: Spearman's correlation of the signal at pos with the target at pos + k."""
    s = df.select("pos", signal).withColumn("k", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("at", F.col("pos") + F.col("k"))
    both = s.join(df.select(F.col("pos").alias("at"), F.col(target).alias("_target")), "at")
    return spearman(both, signal, "_target", ["k"]).select("k", "n", F.col("spearman").alias("rho"))


def lead_lag_summary(ccf: DataFrame) -> DataFrame:
    """The lag of largest absolute correlation, its band 1.96 / sqrt(n) and whether the signal leads, coincides (within 2) or lags."""
    best = ccf.agg(F.max_by(F.struct("k", "n", "rho"), F.struct(F.abs("rho"), -F.abs("k"))).alias("b")).select("b.*")
    return best.withColumn("band", 1.96 / F.sqrt("n")).withColumn("role", F.when(F.abs("k") <= 2, "coincident").when(F.col("k") > 0, "leads").otherwise("lags"))


def uniform_distance(df: DataFrame, value: str, part: list[str]) -> DataFrame:
    """Kolmogorov-Smirnov distance ``d`` of values in [0, 1] from uniform, ``n`` and the asymptotic ``p``."""
    w = Window.partitionBy(*part).orderBy(value)
    n = F.count(F.lit(1)).over(Window.partitionBy(*part))
    k = F.row_number().over(w)
    g = df.withColumn("_d", F.greatest(k / n - F.col(value), F.col(value) - (k - 1) / n)).groupBy(*part).agg(F.max("_d").alias("d"), F.count(F.lit(1)).alias("n"))
    x = F.col("d") * (F.sqrt("n") + 0.12 + 0.11 / F.sqrt("n"))
    tail = sum((F.lit(2.0 * (-1) ** (i - 1)) * F.exp(-2.0 * i * i * x * x) for i in range(1, 9)), F.lit(0.0))
    return g.withColumn("p", F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))


def permutation_null(scores: DataFrame, outcome: str, chosen: str, times: int, k: int, part: list[str]) -> DataFrame:
    """``part, observed, null_mean, p``: mean outcome of the chosen nodes over windows, that of ``times`` random baskets of ``k`` nodes in each window, and the share of draws at or above it.

    ``scores`` is ``part, win, node, number, outcome, chosen``; a draw ranks nodes by a hash of draw, window and
    the node's number (below 100).
    """
    obs = scores.where(F.col(chosen)).groupBy(*part, "win").agg(F.avg(outcome).alias("m")).groupBy(*part).agg(F.avg("m").alias("observed"))
    drawn = scores.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(times))))
    rank = F.row_number().over(Window.partitionBy(*part, "draw", "win").orderBy(draws.scrambled((F.col("draw") * 100_000 + F.col("win")) * 100 + F.col("number")), "node"))
    null = drawn.withColumn("_k", rank).where(F.col("_k") <= k).groupBy(*part, "draw", "win").agg(F.avg(outcome).alias("m")).groupBy(*part, "draw").agg(F.avg("m").alias("null_mean"))
    return null.join(obs, part).groupBy(*part, "observed").agg(F.avg("null_mean").alias("null_mean"), F.avg((F.col("null_mean") >= F.col("observed")).cast("double")).alias("p"))


def one_sided(p_low: Column, observed: Column) -> Column:
    """One-sided p in the direction of the observed sign, from the share of replicates at or below 0."""
    return F.when(observed >= 0, p_low).otherwise(1 - p_low)


def verdict(d: Column, lo: Column, hi: Column, least: float = 0.0) -> Column:
    return F.when((lo > 0) & (d > least), "better").when((hi < 0) & (d < -least), "worse").otherwise("tie")


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def least_squares(rows: DataFrame, y: str, models: dict[str, list[str]]) -> DataFrame:
    """``model, regressor, beta`` (``one`` is the constant) of each model's least squares.

    One pass sums the products of all columns that the models name; what each model solves, in a task, is
    as large as its regressors. Regressors that repeat others share the least-norm solution. No rows, no betas.
    """
    names = list(dict.fromkeys(c for cs in models.values() for c in cs))
    columns = {"one": F.lit(1.0)} | {c: F.col(c).cast("double") for c in names}
    at = {c: i for i, c in enumerate(columns)}
    product = lambda a, b: F.coalesce(F.sum(a * b), F.lit(0.0))
    sums = rows.agg(F.array(*[product(a, b) for a in columns.values() for b in columns.values()]).alias("xx"), F.array(*[product(a, F.col(y).cast("double")) for a in columns.values()]).alias("xy"))
    asked = rows.sparkSession.createDataFrame([(m, ["one", *cs]) for m, cs in models.items()], "model string, regressors array<string>")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for xx, xy, model, regressors in pdf.itertuples(index=False):
                use = [at[c] for c in regressors]
                full = np.asarray(xx, dtype=float).reshape(len(at), len(at))
                if full[0, 0] > 0:
                    beta = np.linalg.lstsq(full[np.ix_(use, use)], np.asarray(xy, dtype=float)[use], rcond=1e-13)[0]
                    yield pd.DataFrame({"model": model, "regressor": list(regressors), "beta": beta})

    return asked.join(F.broadcast(sums)).select("xx", "xy", "model", "regressors").mapInPandas(solve, "model string, regressor string, beta double")  # one row


def predictions(rows: DataFrame, key: list[str], betas: DataFrame) -> DataFrame:
    """``key, model, predicted`` of each row under each model of ``least_squares``."""
    names = [r["regressor"] for r in betas.select("regressor").distinct().where("regressor <> 'one'").collect()]
    long = rows.select(*key, F.lit(1.0).alias("one"), *[F.col(c).cast("double").alias(c) for c in names]).unpivot(key, ["one", *names], "regressor", "x")
    return long.join(F.broadcast(betas), "regressor").groupBy(*key, "model").agg(F.sum(F.col("x") * F.col("beta")).alias("predicted"))  # a few betas

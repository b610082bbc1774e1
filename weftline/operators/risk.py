"""Covariance shrinkage, factor scenarios and walk-forward forecasts by group-map over windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from weftline.functions import kernels as k

from . import draws
from .metrics import matrix_of

TARGETS = ("identity", "constant", "degree", "triadic")


def shrinkage_grid(m: DataFrame, future: DataFrame, alphas: list[float]) -> DataFrame:
    """``win, target, alpha, variance``: mean squared future return of the minimum-variance portfolio of each shrunk covariance.

    ``m`` is ``win, pos, node, ret`` of the estimation rows, ``future`` the same of the rows after each
    window. Also ``sample`` and ``nonlinear`` (with alpha 0), the latter where nodes are fewer than rows.
    """

    def run(key: tuple, est: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        if not len(est) or not len(out):
            return pd.DataFrame(columns=["win", "target", "alpha", "variance"])
        (x, nodes), rows = matrix_of(est), []
        y = matrix_of(out)[0]
        s = np.cov(x, rowvar=False)
        rules = [("sample", 0.0, s)] + ([("nonlinear", 0.0, k.nonlinear_shrinkage(x))] if len(nodes) < len(x) - 1 else [])
        rules += [(t, a, (1 - a) * s + a * k.shrink_target(s, t)) for t in TARGETS for a in alphas]
        for target, a, cov in rules:
            rows.append((int(key[0]), target, float(a), float(((y @ k.minimum_variance(cov)) ** 2).mean())))
        return pd.DataFrame(rows, columns=["win", "target", "alpha", "variance"])

    columns = ["win", "pos", "node", "ret"]
    return m.select(columns).groupBy("win").cogroup(future.select(columns).groupBy("win")).applyInPandas(run, "win int, target string, alpha double, variance double")


def factor_states(m: DataFrame, rule: str | int = "edge") -> DataFrame:
    """``win, k, loadings, residual``: correlation of each window as factors and own variances; loadings are node-major."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, _ = matrix_of(pdf)
        b, d = k.factor_model(k.correlation(x), len(x), rule)
        return pd.DataFrame({"win": [int(pdf["win"].iloc[0])], "k": [b.shape[1]], "loadings": [b.ravel()], "residual": [d]})

    return m.select("win", "pos", "node", "ret").groupBy("win").applyInPandas(run, "win int, k int, loadings array<double>, residual array<double>")


def scenario_variance(states: DataFrame, weights: list[float]) -> DataFrame:
    """``win, variance`` of a portfolio under each state, |B'u|^2 + sum of d u^2, without making the matrix."""
    u = F.array(*[F.lit(float(w)) for w in weights])
    cell = lambda f: F.aggregate(F.transform(u, lambda w, i: w * F.get("loadings", (i * F.col("k") + f).cast("int"))), F.lit(0.0), lambda a, b: a + b)
    common = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda f: F.pow(cell(f), F.lit(2.0))), F.lit(0.0), lambda a, b: a + b)
    own = F.aggregate(F.zip_with(u, "residual", lambda w, d: w * w * d), F.lit(0.0), lambda a, b: a + b)
    return states.select("win", (common + own).alias("variance"))


def scenario_draws(variances: DataFrame, times: int = 500, dof: int = 6, least: int = 20) -> DataFrame:
    """``win, x``: outcomes drawn for each window from the states before it.

    A draw takes the variance of a past window at random, times a Student-t number of unit variance
    (``dof`` is even). ``variances`` is ``win, variance``; windows with ``least`` earlier ones take part.
    Each draw is a row that meets its past window by an equi-join.
    """
    v = variances.withColumn("at", F.row_number().over(Window.orderBy("win")) - 1)  # a row for each window
    rows = v.where(F.col("at") >= least).select("win", "at", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("d"))
    number = (F.col("at") * times + F.col("d")) * (2 * dof)
    of_past = F.floor(draws.uniform(number) * F.col("at")).cast("int")
    chi = -2 * sum((F.log(draws.uniform(number + 4 + i)) for i in range(dof // 2)), F.lit(0.0))
    t = draws.normal((number / 2).cast("long") + 1) * F.sqrt((dof - 2) / chi)
    return rows.select("win", of_past.alias("past"), t.alias("t")).join(v.select(F.col("at").alias("past"), "variance"), "past").select("win", (F.col("t") * F.sqrt("variance")).alias("x"))


def scenario_pit(variances: DataFrame, outcomes: DataFrame, times: int = 500, dof: int = 6, least: int = 20) -> DataFrame:
    """``win, pit, lo, low, high, hi, realised``: each outcome's place among ``scenario_draws`` and the ends of their middle 95 and 50 %. ``outcomes`` is ``win, realised``."""
    both = scenario_draws(variances, times, dof, least).join(outcomes, "win")
    share = F.avg((F.col("x") <= F.col("realised")).cast("double"))
    ends = [F.percentile("x", q).alias(c) for c, q in (("lo", 0.025), ("low", 0.25), ("high", 0.75), ("hi", 0.975))]
    return both.groupBy("win").agg(share.alias("pit"), *ends, F.max("realised").alias("realised"))


def loss_probabilities(drawn: DataFrame, losses: list[float]) -> DataFrame:
    """``win, quantity, value``: quantiles of the draws and how likely an outcome is as bad as each of ``losses``."""
    quantities = {f"quantile {q}": F.percentile("x", q) for q in (0.01, 0.05, 0.25, 0.5)} | {f"loss {v}": F.avg((F.col("x") <= v).cast("double")) for v in losses}
    wide = drawn.groupBy("win").agg(*[c.alias(name) for name, c in quantities.items()])
    return wide.unpivot("win", [f"`{q}`" for q in quantities], "quantity", "value")


def concentrated_states(states: DataFrame, nodes: list[str], count: int) -> DataFrame:
    """``win, i, j, rho``: what the factors alone correlate, in the ``count`` states whose factors carry most variance."""
    total = F.aggregate(F.transform("loadings", lambda x: x * x), F.lit(0.0), lambda a, b: a + b)
    most = states.withColumn("_c", F.round(total, 9)).orderBy(F.desc("_c"), "win").limit(count)
    of = lambda i: F.slice("loadings", F.lit(i) * F.col("k") + 1, F.col("k"))
    dot = lambda i, j: F.aggregate(F.zip_with(of(i), of(j), lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)
    edges = [F.struct(F.lit(nodes[i]).alias("i"), F.lit(nodes[j]).alias("j"), dot(i, j).alias("rho")) for i in range(len(nodes)) for j in range(i + 1, len(nodes))]
    return most.select("win", F.explode(F.array(*edges)).alias("e")).select("win", "e.i", "e.j", "e.rho")


def off_diagonal_error(forecast: DataFrame, truth: DataFrame) -> DataFrame:
    """Root mean square difference of two edge lists ``win, i, j, rho`` for each window."""
    both = forecast.join(truth.withColumnRenamed("rho", "_true"), ["win", "i", "j"])
    return both.groupBy("win").agg(F.sqrt(F.avg((F.col("rho") - F.col("_true")) ** 2)).alias("rmse"))


def equal_weight_variance(edges: DataFrame, deviations: DataFrame, by: list[str]) -> DataFrame:
    """``by, variance``: w'Sw of the equal-weight portfolio, from correlations ``by, i, j, rho`` (i < j) and ``by, node, sd``; the matrix is never put together."""
    i, j = (deviations.select(*by, F.col("node").alias(c), F.col("sd").alias(v)) for c, v in (("i", "si"), ("j", "sj")))
    cross = edges.join(i, [*by, "i"]).join(j, [*by, "j"]).groupBy(*by, *[c for c in edges.columns if c not in (*by, "i", "j", "rho")]).agg((2 * F.sum(F.col("rho") * F.col("si") * F.col("sj"))).alias("cross"))
    own = deviations.groupBy(*by).agg(F.sum(F.col("sd") ** 2).alias("own"), F.count(F.lit(1)).alias("n"))
    return cross.join(own, by).withColumn("variance", (F.col("own") + F.col("cross")) / F.col("n") ** 2).drop("own", "cross", "n")


def chosen_strengths(grid: DataFrame) -> DataFrame:
    """``target, alpha, windows, realised``: for each target of ``shrinkage_grid`` the strength of least mean variance in the first half of the windows, and the deviation that it realises in the second."""
    half = grid.select("win").distinct().agg(F.percentile("win", 0.5).alias("half"))
    split = grid.join(F.broadcast(half))  # one row
    early = split.where(F.col("win") <= F.col("half")).groupBy("target", "alpha").agg(F.avg("variance").alias("v"))
    best = early.groupBy("target").agg(F.min_by("alpha", F.struct("v", "alpha")).alias("alpha"))  # a few strengths
    late = split.where(F.col("win") > F.col("half")).join(F.broadcast(best), ["target", "alpha"])
    return late.groupBy("target", "alpha").agg(F.count(F.lit(1)).alias("windows"), F.sqrt(F.avg("variance")).alias("realised"))

"""Sequential filters of a series. Each series is one ordered array; parallelism is the number of series and grid points."""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from weftline.sources.shared import once

UP, DOWN = 0.6, 0.08


def smooth(df: DataFrame, value: str, part: list[str], order: str = "ts", step=None, name: str = "memory", rates: tuple[str, str] | None = None) -> DataFrame:
    """``part, order, value, name``: the series and its filtered values (default: the asymmetric persistence filter).

    ``rates`` names two columns of ``part`` that hold the filter's strengths up and down, as on a grid.
    """
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        up, down = (float(pdf[c].iloc[0]) for c in rates) if rates else (UP, DOWN)
        # the recurrence is not associative, so one task walks a series; a fold that grows an array costs the square of its length
        pdf = pdf.sort_values(order)
        out, m = [], None
        for x in pdf[value].tolist():
            if x is None or x != x:
                out.append(m)
                continue
            m = x if m is None else step(m, x) if step else ((up if x > m else down) * x + (1 - (up if x > m else down)) * m)
            out.append(m)
        pdf[name] = pd.array(out, dtype="Float64").astype("float64") if any(v is not None for v in out) else np.nan
        return pdf

    fields = ", ".join(f"`{c}` {kinds[c]}" for c in [*part, order]) + f", `{value}` double, `{name}` double"
    return df.select(*part, order, F.col(value).cast("double").alias(value)).groupBy(*part).applyInPandas(run, fields)


def exponential(alpha: float):
    return lambda m, x: alpha * x + (1 - alpha) * m


def decayed_variance(df: DataFrame, value: str, decay: float, part: list[str], order: str = "ts", rows: int = 60) -> DataFrame:
    """``ewvar``: mean square of the last ``rows`` values weighted by decay ** age, a plain window aggregate of the array."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(1 - rows, 0)
    tail = df.withColumn("_tail", F.collect_list(F.col(value).cast("double")).over(w))
    n = F.size("_tail")
    weight = lambda i: F.pow(F.lit(decay), (n - 1 - i).cast("double"))
    top = F.aggregate(F.transform("_tail", lambda x, i: x * x * weight(i)), F.lit(0.0), lambda a, b: a + b)
    bottom = F.aggregate(F.transform("_tail", lambda x, i: weight(i)), F.lit(0.0), lambda a, b: a + b)
    return tail.withColumn("ewvar", top / bottom).drop("_tail")


def decayed_states(stretches: DataFrame, part: list[str], start: str) -> DataFrame:
    """``part, pos, state``: state after each stretch: the one before times ``decay``, and ``gain``. ``start`` holds the state before the first.

    ``stretches`` is ``part, pos, decay, gain, start`` with a row for each stretch; a series is as many
    rows as there are stretches, and series are read off many at a time.
    """
    rows = stretches.groupBy(*part).agg(F.sort_array(F.collect_list(F.struct("pos", "decay", "gain"))).alias("_s"), F.first(start).alias("_q"))
    keep = ", ".join(f"`{c}` {t}" for c, t in stretches.dtypes if c in part)

    def run(batches):
        for pdf in batches:
            for place in pdf.groupby(pdf["_s"].map(len)).groups.values():  # series of one length together
                block = pdf.loc[place]
                decay, gain = (np.array([[x[c] for x in s] for s in block["_s"]]) for c in ("decay", "gain"))
                q, states = block["_q"].to_numpy(dtype=float), []
                for k in range(decay.shape[1]):
                    q = q * decay[:, k] + gain[:, k]
                    states.append(q)
                out = block[part].copy()
                out["pos"], out["state"] = [[int(x["pos"]) for x in s] for s in block["_s"]], list(np.stack(states, axis=1))
                yield out

    out = rows.select(*part, "_s", "_q").mapInPandas(run, keep + ", pos array<int>, state array<double>")
    return out.select(*part, F.explode(F.arrays_zip("pos", "state")).alias("x")).select(*part, "x.pos", "x.state")


def products(r: DataFrame) -> DataFrame:
    """``i, j, pos, p`` with i <= j: the products of each pair's values. ``r`` is ``pos, node, ret``."""
    i, j = (r.select("pos", F.col("node").alias(n), F.col("ret").alias(v)) for n, v in (("i", "x"), ("j", "y")))
    return i.join(j, "pos").where("i <= j").select("i", "j", "pos", (F.col("x") * F.col("y")).alias("p"))


def decayed_correlation(pairs: DataFrame, start: DataFrame, grid: DataFrame, ends: list[int]) -> DataFrame:
    """``a, b, pos, i, j, rho``: correlations from the states q = c s + a p + b q before each of the rows ``ends``.

    ``pairs`` is of ``products``, ``start`` is ``i, j, s`` with each pair's first state, ``grid`` is
    ``a, b, c``. Each stretch between two ends is one sum, decayed, and the stretches follow one another
    pair by pair, so tasks grow with pairs and grid points and no task holds a panel.
    """
    spark, ends = pairs.sparkSession, sorted(set(ends))
    spans = spark.createDataFrame(list(zip([0, *ends], ends)), "lo int, hi int").withColumn("pos", F.explode(F.sequence("lo", F.col("hi") - 1)))
    placed = pairs.join(F.broadcast(spans), "pos").join(start, ["i", "j"]).join(F.broadcast(grid))  # a calendar; a parameter grid, given by the caller
    age = (F.col("hi") - 1 - F.col("pos")).cast("double")
    step = F.col("c") * F.col("s") + F.col("a") * F.col("p")
    stretches = placed.groupBy("a", "b", "i", "j", "s", F.col("hi").alias("pos")).agg(F.sum(F.pow("b", age) * step).alias("gain"), F.pow("b", F.count(F.lit(1)).cast("double")).alias("decay"))
    q = once(decayed_states(stretches, ["a", "b", "i", "j"], "s"))
    own = q.where("i = j")
    left, right = (own.select("a", "b", "pos", F.col("i").alias(c), F.col("state").alias(v)) for c, v in (("i", "qi"), ("j", "qj")))
    both = q.where("i < j").join(left, ["a", "b", "pos", "i"]).join(right, ["a", "b", "pos", "j"])
    return both.select("a", "b", "pos", "i", "j", (F.col("state") / F.sqrt(F.col("qi") * F.col("qj"))).alias("rho"))


def dynamic_correlation(r: DataFrame, grid: DataFrame, ends: list[int]) -> DataFrame:
    """``a, b, pos, i, j, rho``: DCC(1,1) with correlation targeting, before each of the rows ``ends``.

    ``r`` is ``pos, node, ret`` (standardised, every node at every row); ``grid`` has the parameters a and b.
    """
    pairs = once(products(r))
    return decayed_correlation(pairs, pairs.groupBy("i", "j").agg(F.avg("p").alias("s")), grid.select("a", "b", (1 - F.col("a") - F.col("b")).alias("c")), ends)


def decayed_covariance_correlation(r: DataFrame, decay: float, first_rows: int, ends: list[int]) -> DataFrame:
    """``pos, i, j, rho`` of exponentially weighted products, which start from the covariance of the first rows."""
    pairs = once(products(r))
    early = r.where(F.col("pos") < first_rows)
    i, j = (early.select("pos", F.col("node").alias(n), F.col("ret").alias(v)) for n, v in (("i", "x"), ("j", "y")))
    start = i.join(j, "pos").where("i <= j").groupBy("i", "j").agg(F.covar_samp("x", "y").alias("s"))
    grid = r.sparkSession.createDataFrame([(1 - decay, decay, 0.0)], "a double, b double, c double")
    return decayed_correlation(pairs, start, grid, ends).drop("a", "b")


def trailing_gate(df: DataFrame, value: str, q: float, part: list[str], order: str = "ts", least: int = 30) -> DataFrame:
    """``gate``: the expanding quantile up to and with each row, null before ``least`` rows."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("gate", F.when(F.count(value).over(w) >= least, F.percentile(value, q).over(w)))


def trailing_cdf(df: DataFrame, value: str, part: list[str], order: str = "ts") -> DataFrame:
    """``cdf``: the share of earlier values not above each row's own; null for the first row. One task walks a series with its past sorted."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        past: list[float] = []
        out = []
        for x in pdf[value].tolist():
            out.append(bisect_right(past, x) / len(past) if past else np.nan)
            insort(past, x)
        pdf["cdf"] = out
        return pdf

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", cdf double"
    return df.groupBy(*part).applyInPandas(run, fields).withColumn("cdf", F.nanvl("cdf", F.lit(None).cast("double")))


def drawdown(df: DataFrame, value: str, part: list[str], order: str = "ts") -> DataFrame:
    """``equity`` (running sum of log returns) and ``drawdown`` (below its running maximum)."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    e = df.withColumn("equity", F.sum(value).over(w))
    return e.withColumn("drawdown", F.exp(F.col("equity") - F.max("equity").over(w)) - 1)

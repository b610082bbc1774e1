"""Correlation networks as relations: one row for each window and pair of nodes.

Right for tens of nodes (rows: windows * width * nodes squared / 2, or dates * nodes squared / 2 by running
sums). For hundreds, the group-map kernels of ``metrics`` hold one window's matrix in one task instead; for
thousands, ``blocks`` deals products of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Moments below this share of the scale are zero variance.
FLAT = 1e-12


def moments(m: DataFrame, value: str = "ret") -> DataFrame:
    """``win, i, j`` (i < j) with the count, means and centred second moments of two nodes."""
    x = m.select("win", "pos", F.col("node").alias("i"), F.col(value).alias("x"))
    y = m.select("win", "pos", F.col("node").alias("j"), F.col(value).alias("y"))
    s = x.join(y, ["win", "pos"]).where("i < j").groupBy("win", "i", "j").agg(F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(a) for a, e in (("sx", F.col("x")), ("sy", F.col("y")), ("sxy", F.col("x") * F.col("y")), ("sxx", F.col("x") * F.col("x")), ("syy", F.col("y") * F.col("y")))])
    return s.select("win", "i", "j", "n", *centred())


def sliding_moments(rows: DataFrame, ends: DataFrame, width: int, value: str = "ret") -> DataFrame:
    """``moments`` of the windows of ``width`` dates before each of ``ends`` (``win, end``), from running sums.

    ``rows`` is ``pos, node, value``. A pair's products are made and summed once along the calendar,
    however much windows overlap; a window is the running sums at its end less those at its start. A
    pair's row stands for all dates up to its next one, so it is met by an equi-join with the windows'
    bounds. So rows are pairs by dates, and not by windows by their width.
    """
    edges = F.array(F.struct(F.col("end").alias("at"), F.lit(1).alias("sign")), F.struct((F.col("end") - width).alias("at"), F.lit(-1).alias("sign")))
    bounds = ends.select("win", F.explode(edges).alias("b")).select("win", "b.at", "b.sign")  # two rows for each window
    i, j = (rows.select("pos", F.col("node").alias(n), F.col(value).alias(v)) for n, v in (("i", "x"), ("j", "y")))
    order = Window.partitionBy("i", "j").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    terms = {"n": F.lit(1), "sx": F.col("x"), "sy": F.col("y"), "sxy": F.col("x") * F.col("y"), "sxx": F.col("x") * F.col("x"), "syy": F.col("y") * F.col("y")}
    summed = i.join(j, "pos").where("i < j").select("i", "j", "pos", F.lead("pos").over(order).alias("next"), *[F.sum(e).over(so_far).alias(c) for c, e in terms.items()])
    upto = F.greatest(F.coalesce("next", "last"), F.col("pos") + 1)
    held = summed.join(F.broadcast(bounds.agg(F.max("at").alias("last")))).withColumn("at", F.explode(F.sequence(F.col("pos") + 1, upto)))  # one row
    s = held.join(F.broadcast(bounds), "at").groupBy("i", "j", "win").agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in terms]).where("n > 0")  # a calendar
    return s.select("win", "i", "j", "n", *centred())


def centred() -> list[Column]:
    """Centred second moments from sums."""
    return [(F.col(xy) - F.col(x) * F.col(y) / F.col("n")).alias(c) for c, xy, x, y in (("cxy", "sxy", "sx", "sy"), ("cxx", "sxx", "sx", "sx"), ("cyy", "syy", "sy", "sy"))]


def correlation_of(moments: DataFrame) -> DataFrame:
    """``win, i, j, rho`` for i < j; 0 where a node does not vary."""
    vary = (F.col("cxx") > FLAT) & (F.col("cyy") > FLAT)
    return moments.select("win", "i", "j", F.when(vary, F.col("cxy") / F.sqrt(F.col("cxx") * F.col("cyy"))).otherwise(0.0).alias("rho"))


def correlations(m: DataFrame, value: str = "ret") -> DataFrame:
    """``correlation_of`` the members of windows."""
    return correlation_of(moments(m, value))


def sliding_correlations(rows: DataFrame, ends: DataFrame, width: int, value: str = "ret") -> DataFrame:
    """``correlation_of`` overlapping windows, each product made once."""
    return correlation_of(sliding_moments(rows, ends, width, value))


def covariances(m: DataFrame, value: str = "ret") -> DataFrame:
    return moments(m, value).where("n > 1").select("win", "i", "j", (F.col("cxy") / (F.col("n") - 1)).alias("cov"))


def both_ways(e: DataFrame) -> DataFrame:
    return e.union(e.select("win", F.col("j").alias("i"), F.col("i").alias("j"), "rho"))


def triangles(e: DataFrame, weight: Column | None = None) -> DataFrame:
    """``win, i, j, k, w`` for i < j < k: the product of the three weights (default: absolute correlations)."""
    w = F.abs("rho") if weight is None else weight
    a = e.select("win", "i", "j", w.alias("w"))
    b, c = (a.select("win", F.col("i").alias(p), F.col("j").alias(q), F.col("w").alias(v)) for p, q, v in (("j", "k", "wb"), ("i", "k", "wc")))
    return a.join(b, ["win", "j"]).join(c, ["win", "i", "k"]).select("win", "i", "j", "k", (F.col("w") * F.col("wb") * F.col("wc")).alias("w"))


def degrees(e: DataFrame) -> DataFrame:
    return both_ways(e).groupBy("win", F.col("i").alias("node")).agg(F.sum(F.abs("rho")).alias("degree"))


def node_triangles(e: DataFrame) -> DataFrame:
    """``win, node, tri``: the diagonal of the cubed adjacency, twice a node's triangles; nodes of no triangle have 0."""
    t = triangles(e)
    each = t.select("win", F.explode(F.array("i", "j", "k")).alias("node"), "w").groupBy("win", "node").agg((2 * F.sum("w")).alias("tri"))
    nodes = both_ways(e).select("win", F.col("i").alias("node")).distinct()
    return nodes.join(each, ["win", "node"], "left").select("win", "node", F.coalesce("tri", F.lit(0.0)).alias("tri"))


def factors(e: DataFrame) -> DataFrame:
    """One row for each window: triangle mass, its size-normalised form, clustering, density, degree variance, mean correlation, and their product without the spectral gap."""
    tri = triangles(e).groupBy("win").agg((6 * F.sum("w")).alias("tr_a3"))
    deg = degrees(e)
    # the sum of all entries of the squared adjacency is the sum of squared degrees, its trace that of squared weights
    by_node = deg.groupBy("win").agg(F.count(F.lit(1)).alias("n"), F.sum("degree").alias("mass"), F.sum(F.col("degree") ** 2).alias("paths"), F.var_pop("degree").alias("degree_variance"))
    by_edge = e.groupBy("win").agg((2 * F.sum(F.col("rho") ** 2)).alias("tr_a2"), F.avg(F.abs("rho")).alias("mean_abs_corr"))
    f = by_node.join(by_edge, "win").join(tri, "win", "left").withColumn("tr_a3", F.coalesce("tr_a3", F.lit(0.0)))
    open_paths = F.col("paths") - F.col("tr_a2")
    f = f.withColumn("clustering", F.when(open_paths > 0, F.col("tr_a3") / open_paths).otherwise(0.0)).withColumn("density", F.col("mass") / (F.col("n") * (F.col("n") - 1)))
    return f.select("win", "n", "tr_a3", (F.col("tr_a3") / F.col("n") ** 3).alias("tr_a3_n3"), "clustering", "density", "degree_variance", "mean_abs_corr", (F.col("clustering") * F.col("density") * F.col("degree_variance")).alias("gapless"))


def signed_mass(e: DataFrame) -> DataFrame:
    return triangles(e, F.col("rho")).groupBy("win").agg((6 * F.sum("w")).alias("tr_s3"))


def pressures(e: DataFrame) -> DataFrame:
    """``win, i, j, pressure``: three times the two-step weight between two nodes times their own."""
    t = triangles(e)
    sides = t.select("win", "w", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("i").alias("i"), F.col("k").alias("j")), F.struct(F.col("j").alias("i"), F.col("k").alias("j")))).alias("s"))
    sums = sides.groupBy("win", "s.i", "s.j").agg((3 * F.sum("w")).alias("pressure"))
    return e.select("win", "i", "j").join(sums, ["win", "i", "j"], "left").select("win", "i", "j", F.coalesce("pressure", F.lit(0.0)).alias("pressure"))


def gini(df: DataFrame, value: str, part: list[str]) -> DataFrame:
    """Gini coefficient of non-negative values: (n + 1 - 2 * sum of running sums / sum) / n; 0 if all are 0."""
    w = Window.partitionBy(*part).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    g = df.withColumn("_run", F.sum(value).over(w)).groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum("_run").alias("r"))
    return g.select(*part, F.when(F.col("s") > 0, (F.col("n") + 1 - 2 * F.col("r") / F.col("s")) / F.col("n")).otherwise(0.0).alias("gini"))


def binarised(e: DataFrame, threshold: float = 0.25) -> DataFrame:
    return e.select("win", "i", "j", F.when(F.col("rho") > threshold, 1).when(F.col("rho") < -threshold, -1).otherwise(0).alias("sign"))


def mantegna(rho: Column) -> Column:
    return F.sqrt(F.greatest(2 * (1 - rho), F.lit(0.0)))


def average_rank(value: Column, part: list[str]) -> Column:
    """Ranks from 1 in which ties share their mean; null values have none and are not counted."""
    first = F.rank().over(Window.partitionBy(*part, value.isNull()).orderBy(value))
    same = F.count(F.lit(1)).over(Window.partitionBy(*part, value))
    return F.when(value.isNotNull(), first + (same - 1) / 2.0)


def residual_attribution(scores: DataFrame, part: str = "win") -> DataFrame:
    """``residual``: what the rank of ``tri`` has beyond its line on the rank of ``degree``, standardised in each window."""
    w = Window.partitionBy(part)
    r = scores.withColumn("rt", average_rank(F.col("tri"), [part])).withColumn("rd", average_rank(F.col("degree"), [part]))
    r = r.withColumns({"mt": F.avg("rt").over(w), "md": F.avg("rd").over(w)})
    slope = F.sum((F.col("rt") - F.col("mt")) * (F.col("rd") - F.col("md"))).over(w) / F.nullif(F.sum((F.col("rd") - F.col("md")) ** 2).over(w), F.lit(0.0))
    r = r.withColumn("e", F.col("rt") - F.col("mt") - F.coalesce(slope, F.lit(0.0)) * (F.col("rd") - F.col("md")))
    sd = F.stddev_pop("e").over(w)
    return r.withColumn("residual", F.when(sd > 1e-9, F.col("e") / sd).otherwise(0.0)).drop("rt", "rd", "mt", "md", "e")

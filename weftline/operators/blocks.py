"""Correlation networks of thousands of nodes by blocked matrix products.

Nodes are dealt to blocks of bounded size. A block of a window is its standardised returns, so the
correlations of two blocks are one product. Triangles are sums over triples of blocks, each a task of its
own that gets three blocks and gives sums for their nodes: a task's work is the cube of a block's size
however many nodes there are, and no task or row ever holds a window's whole matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: Second moments below this are zero variance, as in ``network``.
FLAT = 1e-12


def node_blocks(m: DataFrame, block_nodes: int) -> DataFrame:
    """``node, block``: blocks of at most ``block_nodes`` nodes in order of name (a row for each node, numbered once)."""
    place = F.row_number().over(Window.orderBy("node")) - 1
    return m.select("node").distinct().select("node", F.floor(place / block_nodes).cast("int").alias("block"))


def standardised(m: DataFrame, block_nodes: int, value: str = "ret") -> DataFrame:
    """``win, block, nodes array, z array``: each node's centred values over their norm, node by node, dates in order.

    Nodes that do not vary have zeros, and correlation 0 with everything. Every node needs a value on
    every date of a window; where one has none, the window fails rather than give other numbers.
    """
    w = Window.partitionBy("win", "node")
    x = m.select("win", "pos", "node", F.col(value).cast("double").alias("x"))
    x = x.withColumn("c", F.col("x") - F.avg("x").over(w)).withColumn("s", F.sum(F.col("c") * F.col("c")).over(w))
    z = F.when(F.col("s") > FLAT, F.col("c") / F.sqrt("s")).otherwise(0.0)
    series = x.groupBy("win", "node").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", z.alias("z")))), lambda s: s["z"]).alias("z"))
    placed = series.join(node_blocks(m, block_nodes), "node")
    rows = F.sort_array(F.collect_list(F.struct("node", "z")))  # at most block_nodes
    return placed.groupBy("win", "block").agg(rows.alias("r")).select("win", "block", F.col("r.node").alias("nodes"), F.flatten("r.z").alias("z"))


def triple_sums(a: np.ndarray, b: np.ndarray, c: np.ndarray, same_ab: bool, same_bc: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the nodes of blocks i <= j <= k, with weights a (i, j), b (j, k) and c (i, k): what the triple adds to the diagonal of the cubed weights.

    A node's walk leaves to one of the other two blocks and comes back from the other, so it counts twice
    where these differ.
    """
    through = c @ b.T  # i to j by way of k
    first = (a * through).sum(axis=1) * (1 if same_bc else 2)
    second = (a * through).sum(axis=0) * (1 if same_ab and same_bc else 2)
    third = (c * (a @ b)).sum(axis=0) * (1 if same_ab else 2)
    none = np.zeros(0)
    if same_ab:  # the first two are one block, whose nodes are all in ``first``
        return first, none, none if same_bc else third
    return first, second, none if same_bc else third


def node_sums(m: DataFrame, block_nodes: int = 256, value: str = "ret") -> DataFrame:
    """``win, node, degree, square, tri``: sums of a node's absolute correlations and of their squares, and the diagonal of the cubed absolute correlations.

    ``m`` is ``win, pos, node, value``. The columns ``degree`` and ``tri`` are those of ``network``; nodes
    of no edge have 0. Triples of blocks grow with the cube of the number of blocks, each of bounded work.
    """
    z = standardised(m, block_nodes, value)
    n = m.select("node").distinct().agg(F.ceil(F.count(F.lit(1)) / block_nodes).cast("int").alias("blocks"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    # a block's copies, each under the triple that it goes to; a block that is in a triple twice goes once
    pair = F.explode(F.flatten(F.transform(others, lambda p: F.transform(F.sequence(p, F.col("blocks") - 1), lambda q: F.sort_array(F.array("block", p, q))))))
    sent = z.join(F.broadcast(n)).select("win", "block", "nodes", "z", pair.alias("triple")).select("win", "block", "nodes", "z", *[F.col("triple")[i].alias(c) for i, c in enumerate("ijk")])  # one row
    triples = sent.groupBy("win", "i", "j", "k").agg(F.collect_list(F.struct("block", "nodes", "z")).alias("held"))
    kind = dict(m.dtypes)["win"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for win, i, j, k, held in pdf[["win", "i", "j", "k", "held"]].itertuples(index=False):
                nodes = {x["block"]: list(x["nodes"]) for x in held}
                x = {h["block"]: np.asarray(h["z"], dtype=float).reshape(len(nodes[h["block"]]), -1) for h in held}

                def weights(p: int, q: int, x: dict = x) -> np.ndarray:
                    w = np.abs(np.clip(x[p] @ x[q].T, -1.0, 1.0))
                    if p == q:
                        np.fill_diagonal(w, 0.0)
                    return w

                a, b, c = weights(i, j), weights(j, k), weights(i, k)
                for at, tri in zip((i, j, k), triple_sums(a, b, c, i == j, j == k), strict=True):
                    if len(tri):
                        yield pd.DataFrame({"win": win, "node": nodes[at], "degree": 0.0, "square": 0.0, "tri": tri})
                if j == k:  # each pair of blocks once
                    yield pd.DataFrame({"win": win, "node": nodes[i], "degree": a.sum(axis=1), "square": (a * a).sum(axis=1), "tri": 0.0})
                    if i != j:
                        yield pd.DataFrame({"win": win, "node": nodes[j], "degree": a.sum(axis=0), "square": (a * a).sum(axis=0), "tri": 0.0})

    tasks = int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = triples.repartition(tasks, "win", "i", "j", "k").mapInPandas(run, f"win {kind}, node {dict(m.dtypes)['node']}, degree double, square double, tri double")
    return out.groupBy("win", "node").agg(*[F.sum(c).alias(c) for c in ("degree", "square", "tri")])


def factors(sums: DataFrame) -> DataFrame:
    """The columns of ``network.factors`` from ``node_sums``."""
    total = sums.groupBy("win").agg(F.count(F.lit(1)).alias("n"), F.sum("degree").alias("mass"), F.sum(F.col("degree") ** 2).alias("paths"), F.sum("square").alias("tr_a2"), F.sum("tri").alias("tr_a3"), F.var_pop("degree").alias("degree_variance"))
    possible, open_paths = F.col("n") * (F.col("n") - 1), F.col("paths") - F.col("tr_a2")
    f = total.withColumn("clustering", F.when(open_paths > 0, F.col("tr_a3") / open_paths).otherwise(0.0)).withColumn("density", F.col("mass") / possible)
    return f.select("win", "n", "tr_a3", (F.col("tr_a3") / F.col("n") ** 3).alias("tr_a3_n3"), "clustering", "density", "degree_variance", F.col("density").alias("mean_abs_corr"), (F.col("clustering") * F.col("density") * F.col("degree_variance")).alias("gapless"))

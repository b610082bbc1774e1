"""Window metrics by one group-map: each window's matrix is built once and all metrics share it."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weftline.functions import kernels as k

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")


def k_of(n: int) -> int:
    return max(1, round(n / 5))


#: name: (function of returns x, correlations c, signed s and absolute a; sign towards stress)
METRICS: dict[str, tuple[Callable, int]] = {
    "omega": (lambda x, c, s, a: k.omega(a), 1),
    "omega_cross": (lambda x, c, s, a: k.omega_cross_market(a), 1),
    "omega_first": (lambda x, c, s, a: k.omega_first(a), 1),
    "omega_shape": (lambda x, c, s, a: k.omega_shape(a), 1),
    "omega_signed": (lambda x, c, s, a: k.omega_signed(s), 1),
    "gap": (lambda x, c, s, a: k.spectral_gap(a), 1),
    "absorption": (lambda x, c, s, a: k.absorption(x, k_of(x.shape[1])), 1),
    "erank": (lambda x, c, s, a: k.effective_rank(c), -1),
    "erank_returns": (lambda x, c, s, a: k.effective_rank_returns(x), -1),
    "balance": (lambda x, c, s, a: k.balance(s), 1),
    "balance_signs": (lambda x, c, s, a: k.balance(k.signs(c)), 1),
    "turbulence": (lambda x, c, s, a: k.surprise(x)[0], 1),
    "surprise": (lambda x, c, s, a: k.surprise(x)[2], 1),
    "loops": (lambda x, c, s, a: sum(e - b for d, b, e in k.loops_and_parts(k.distance(k.unit_diagonal(c))) if d == 1), 1),
}
#: Metrics of edges, each a problem of its own: (field of the sums, sign towards stress).
EDGE_METRICS = {"curvature": ("plain", 1), "curvature_weighted": ("weighted", 1)}


def matrix_of(pdf: pd.DataFrame) -> tuple[np.ndarray, list]:
    """Returns of a window, dates by nodes (in order of name)."""
    w = pdf.pivot(index="pos", columns="node", values="ret").sort_index()
    return w.to_numpy(dtype=float), list(w.columns)


def window_metrics(m: DataFrame, names: list[str], edges_per_task: int = 1_000) -> DataFrame:
    """``win`` and a double for each metric, for windows whose matrix fits a task (some hundreds of nodes; ``blocks`` is for more).

    ``m`` is ``win, pos, node, ret``; a window is width * nodes rows, the unit of work of one task.
    Curvature solves a transport for each edge, so a window's edges are dealt to tasks by
    ``edges_per_task`` (with hundreds of nodes: many tasks a window) and their sums added up.
    """
    matrix, edge = [n for n in names if n in METRICS], [n for n in names if n in EDGE_METRICS]

    chosen = {n: METRICS[n][0] for n in matrix}  # travels with the task, registered metrics too

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, _ = matrix_of(pdf)
        c = k.correlation(x)
        s = k.off_diagonal(c)
        a = np.abs(s)
        return pd.DataFrame([{"win": int(pdf["win"].iloc[0])} | {n: f(x, c, s, a) for n, f in chosen.items()}])

    out = m.select("win", "pos", "node", "ret").groupBy("win").applyInPandas(run, "win int, " + ", ".join(f"`{n}` double" for n in matrix)) if matrix else None
    if edge:
        by_edge = curvatures(m, edges_per_task).select("win", *[F.col(EDGE_METRICS[n][0]).alias(n) for n in edge])
        out = by_edge if out is None else out.join(by_edge, "win")
    return out.select("win", *names)


def curvatures(m: DataFrame, edges_per_task: int) -> DataFrame:
    """``win, plain, weighted``: mean curvature of a window's edges."""
    by = m.groupBy("win").agg(F.sort_array(F.collect_list(F.struct("pos", "node", "ret"))).alias("rows"), F.countDistinct("node").alias("n"))
    parts = F.greatest(F.ceil(F.col("n") * (F.col("n") - 1) / 2 / edges_per_task), F.lit(1)).cast("int")
    dealt = by.select("win", "n", F.col("rows.ret").alias("ret"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    tasks = int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for win, n, ret, part in zip(pdf["win"], pdf["n"], pdf["ret"], pdf["part"], strict=True):
                c = k.correlation(np.asarray(ret, dtype=float).reshape(-1, n))
                rows.append((win, *k.curvature_sums(c, part * edges_per_task, (part + 1) * edges_per_task)))
            yield pd.DataFrame(rows, columns=["win", "total", "weighted", "weight", "n"])

    sums = dealt.repartition(4 * tasks, "win", "part").mapInPandas(run, "win int, total double, weighted double, weight double, n long").groupBy("win").agg(*[F.sum(c).alias(c) for c in ("total", "weighted", "weight", "n")])
    mean = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return sums.select("win", mean("total", "n").alias("plain"), mean("weighted", "weight").alias("weighted"))


def factors(m: DataFrame) -> DataFrame:
    """The columns of ``network.factors`` from one matrix for each window: for hundreds of nodes, where triangles as rows grow with the cube (464 nodes: 16.5 million a window)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, _ = matrix_of(pdf)
        a = np.abs(k.off_diagonal(k.correlation(x)))
        n = len(a)
        mass, clustering, density, spread = k.parts(a)
        mean = float(a[np.triu_indices(n, 1)].mean()) if n > 1 else 0.0
        return pd.DataFrame([(int(pdf["win"].iloc[0]), n, mass, mass / n**3, clustering, density, spread, mean, clustering * density * spread)])

    schema = "win int, n long, tr_a3 double, tr_a3_n3 double, clustering double, density double, degree_variance double, mean_abs_corr double, gapless double"
    return m.select("win", "pos", "node", "ret").groupBy("win").applyInPandas(run, schema)


def node_triangles(m: DataFrame) -> DataFrame:
    """The columns of ``network.node_triangles`` and ``degree``, likewise."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, nodes = matrix_of(pdf)
        a = np.abs(k.off_diagonal(k.correlation(x)))
        return pd.DataFrame({"win": int(pdf["win"].iloc[0]), "node": nodes, "tri": ((a @ a) * a).sum(axis=1), "degree": a.sum(axis=1)})

    return m.select("win", "pos", "node", "ret").groupBy("win").applyInPandas(run, "win int, node string, tri double, degree double")


def node_scores(m: DataFrame, rules: tuple[str | int, ...] = (1, 2, "edge", "kaiser")) -> DataFrame:
    """``win, node, local_balance, balance_gap`` and for each rule of how many factors count ``spectral_<rule>`` and, if it is no number, ``count_<rule>``."""

    named = [r for r in rules if not isinstance(r, int)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, nodes = matrix_of(pdf)
        c = k.correlation(x)
        s = k.off_diagonal(c)
        local = k.local_balance(s)
        out = {"win": int(pdf["win"].iloc[0]), "node": nodes, "local_balance": local, "balance_gap": k.balance(s) - local}
        values = np.linalg.eigvalsh(c)
        counts = {f"count_{r}": k.factor_count(values, len(c), len(x), r) for r in named}
        return pd.DataFrame(out | {f"spectral_{r}": k.spectral_attribution(c, len(x), r) for r in rules} | counts)

    schema = ", ".join([f"win {dict(m.dtypes)['win']}", "node string, local_balance double, balance_gap double", *[f"spectral_{r} double" for r in rules], *[f"count_{r} int" for r in named]])
    return m.select("win", "pos", "node", "ret").groupBy("win").applyInPandas(run, schema)


def persistence(clouds: DataFrame, key: str, vector: str, top: int = 2) -> DataFrame:
    """``key, dim, birth, death`` of the Vietoris-Rips filtration of each group's point cloud (4 points or more)."""
    kind = dict(clouds.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.array(pdf.sort_values("ts")[vector].tolist(), dtype=float)
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
        pairs = [] if len(p) < 4 else k.loops_and_parts(d) if top == 2 else k.rips_pairs(d, top)
        return pd.DataFrame([(pdf[key].iloc[0], *q) for q in pairs], columns=[key, "dim", "birth", "death"])

    return clouds.select(key, "ts", vector).groupBy(key).applyInPandas(run, f"{key} {kind}, dim int, birth double, death double")

"""Kernels by name: metrics that a caller registers, and functions for SQL text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from weftline.functions import kernels as k
from weftline.operators import metrics


def register_metric(name: str, kernel: Callable, sign: int = 1) -> None:
    """A metric of windows for ``metrics.window_metrics`` and for SQL's ``window_metric``.

    ``kernel`` takes returns x (dates by nodes), correlations c, the same s without its diagonal and a,
    their absolute values, and gives a number; ``sign`` is 1 if it rises with stress, -1 if it falls.
    """
    if sign not in (1, -1):
        raise ValueError("the sign is 1 or -1")
    metrics.METRICS[name] = (kernel, sign)


@udtf(returnType="dim int, birth double, death double")
class Persistence:
    """Births and deaths of the parts (dim 0) and loops (dim 1) of a cloud of points; none of fewer than four points or a null cloud."""

    def eval(self, points: list[list[float]]) -> Iterator[tuple[int, float, float]]:
        if points is not None and len(points) >= 4:
            p = np.array(points, dtype=float)
            yield from k.loops_and_parts(np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)))


def metric_function(kernels: dict[str, Callable]) -> Callable:
    """``(name, returns) -> double``: the named metric of a window given as dates of nodes' returns; null for a null window or an unknown name."""

    def value(name: str, returns: np.ndarray) -> float | None:
        if returns is None or name not in kernels:
            return None
        x = np.array([list(row) for row in returns], dtype=float)
        c = k.correlation(x)
        s = k.off_diagonal(c)
        return float(kernels[name](x, c, s, np.abs(s)))

    @pandas_udf("double")
    def window_metric(names: pd.Series, windows: pd.Series) -> pd.Series:
        return pd.Series([value(n, w) for n, w in zip(names, windows, strict=True)], dtype="float64")

    return window_metric


def register(spark: SparkSession) -> None:
    """Makes ``window_metric(name, returns)`` and the table function ``persistence(points)`` known to the session's SQL; metrics registered later need another call."""
    spark.udtf.register("persistence", Persistence)
    spark.udf.register("window_metric", metric_function({n: f for n, (f, _) in metrics.METRICS.items()}))

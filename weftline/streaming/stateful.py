"""Event-time state: a window's network and a series' statistics, kept row by row as the watermark passes.

Rows wait in a list until no earlier one can come; then they are taken in the order of their time, so
results do not depend on how rows are dealt to batches. Rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps lists and values apart and on disk.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocks(spark: SparkSession) -> None:
    """Sets the session's state store; needed before such a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class InOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed them and hands them on in order of time.

    A subclass makes its own state in ``begin`` and gives the output rows of a stretch in ``step``.
    """

    #: Columns of a row besides ``ts``, and their types.
    fields: dict[str, str] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, " + ", ".join(f"{c} {t}" for c, t in self.fields.items()))
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def step(self, key: Any, rows: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    columns: list[str] = []

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:  # a part of the batch at a time
            held = [(micros(t), *map(plain, rest)) for t, *rest in pdf[["ts", *self.fields]].itertuples(index=False)]
            self.waiting.appendList(held)
            first = min(x[0] for x in (*held, *([(first,)] if first is not None else [])))
        if first is not None:
            self.handle.registerTimer(max(-(-first // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(x) for x in self.waiting.get())  # rows of one time by their values
        due = [x for x in rows if x[0] <= 1000 * mark]
        later = rows[len(due) :]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(-(-later[0][0] // 1000))
        else:
            self.waiting.clear()
        yield pd.DataFrame(self.step(key, due), columns=self.columns)

    def close(self) -> None:
        pass


def micros(t: pd.Timestamp) -> int:
    """Microseconds since 1970; times are held as numbers, so that no session's zone moves them."""
    return pd.Timestamp(t).value // 1000


def stamp(at: int) -> pd.Timestamp:
    return pd.Timestamp(at, unit="us")


def plain(x: Any) -> Any:
    """A value that the state store takes: lists and Python's own numbers."""
    return x.tolist() if isinstance(x, (np.ndarray, np.generic)) else x


class WindowNetwork(InOrder):
    """Network of the last ``width`` rows of a panel, at each ``hop``-th row: mean absolute correlation, from sums that rows are added to and taken from."""

    fields = {"x": "array<double>"}
    columns = ["key", "win", "end_ts", "mean_abs_corr"]

    def __init__(self, width: int, hop: int) -> None:
        self.width, self.hop = width, hop

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getListState("tail", "x array<double>")
        self.sums = handle.getValueState("sums", "n long, s array<double>, ss array<double>, last long")

    def step(self, key: Any, rows: list[tuple]) -> list[tuple]:
        tail = [np.asarray(t[0], dtype=float) for t in self.tail.get()]
        n, s, ss, last = self.sums.get() if self.sums.exists() else (0, [], [], None)
        s, ss, out = np.asarray(s, dtype=float), np.asarray(ss, dtype=float), []
        for ts, x in rows:
            # a window is out when the row after it comes, as in the batch form, where the last row ends none
            if n >= self.width and (n - self.width) % self.hop == 0:
                out.append((key[0], (n - self.width) // self.hop, stamp(last), mean_correlation(s, ss.reshape(len(s), -1), self.width)))
            x = np.asarray(x, dtype=float)
            s, ss = (x, np.outer(x, x).ravel()) if n == 0 else (s + x, ss + np.outer(x, x).ravel())
            tail.append(x)
            if len(tail) > self.width:
                old = tail.pop(0)
                s, ss = s - old, ss - np.outer(old, old).ravel()
            n, last = n + 1, ts
        if rows:
            self.tail.put([(t.tolist(),) for t in tail])
            self.sums.update((n, s.tolist(), ss.tolist(), last))
        return out


def mean_correlation(s: np.ndarray, ss: np.ndarray, n: int) -> float:
    c = ss - np.outer(s, s) / n
    sd = np.sqrt(np.clip(np.diag(c), 0, None))
    vary = sd > 1e-6
    c = np.divide(c, np.outer(sd, sd), out=np.zeros_like(c), where=np.outer(vary, vary))
    return float(np.abs(c[np.triu_indices(len(c), 1)]).mean()) if len(c) > 1 else 0.0


class SeriesStatistics(InOrder):
    """Running statistics of a series: decayed variance of the last ``rows`` values, equity, and drawdown from its peak."""

    fields = {"x": "double"}
    columns = ["key", "ts", "ewvar", "equity", "drawdown"]

    def __init__(self, decay: float, rows: int) -> None:
        self.weights = decay ** np.arange(rows)[::-1]

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getListState("tail", "x double")
        self.sums = handle.getValueState("sums", "equity double, peak double")

    def step(self, key: Any, rows: list[tuple]) -> list[tuple]:
        tail = [t[0] for t in self.tail.get()]
        equity, peak = self.sums.get() if self.sums.exists() else (0.0, -np.inf)
        out = []
        for ts, x in rows:
            tail = [*tail, float(x)][-len(self.weights) :]
            w = self.weights[-len(tail) :]
            equity += float(x)
            peak = max(peak, equity)
            out.append((key[0], stamp(ts), float(w @ np.square(tail) / w.sum()), equity, float(np.exp(equity - peak) - 1)))
        if rows:
            self.tail.put([(t,) for t in tail])
            self.sums.update((equity, peak))
        return out


def window_networks(rows: DataFrame, width: int, hop: int, late: str) -> DataFrame:
    """``key, win, end_ts, mean_abs_corr`` of a stream ``key string, ts timestamp, x array<double>``, a row of all nodes' returns for each date."""
    timed = rows.select("key", "ts", "x").withWatermark("ts", late).groupBy("key")
    return timed.transformWithStateInPandas(WindowNetwork(width, hop), "key string, win int, end_ts timestamp, mean_abs_corr double", "append", "EventTime")


def series_statistics(rows: DataFrame, late: str, decay: float = 0.94, tail: int = 60) -> DataFrame:
    """``key, ts, ewvar, equity, drawdown`` of a stream ``key string, ts timestamp, x double``."""
    timed = rows.select("key", "ts", F.col("x").cast("double").alias("x")).withWatermark("ts", late).groupBy("key")
    return timed.transformWithStateInPandas(SeriesStatistics(decay, tail), "key string, ts timestamp, ewvar double, equity double, drawdown double", "append", "EventTime")

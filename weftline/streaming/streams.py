"""Streams: events to a panel under a watermark, and row-count windows and filters as state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators.filters import DOWN, UP
from weftline.sources.shared import folder, taken


def read_events(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as a stream, with a schema taken from the files at rest."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def event_panel(events: DataFrame, every: str = "1 hour", late: str = "2 hours", ts: str = "ts", node: str = "event_type", value: str = "value") -> DataFrame:
    """``ts, node, value``: sums by event-time window; rows later than ``late`` behind are dropped by the watermark."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", every).alias("w"), F.col(node).alias("node")).agg(F.sum(value).alias("value")).select(F.col("w.start").alias("ts"), "node", "value")


def filtered_stream(series: DataFrame, key: str, order: str, value: str, up: float = UP, down: float = DOWN) -> DataFrame:
    """The asymmetric filter of each key's series, its memory kept as state between batches: ``key, order, value, memory``.

    Rows of a batch are taken in ``order``; batches must come in order, as from an append-mode aggregate.
    """
    kinds = dict(series.dtypes)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for x in rows[value].tolist():
            if x is not None and x == x:
                a = 1.0 if m is None else up if x > m else down
                m = x if m is None else a * x + (1 - a) * m
            out.append(m)
        if m is not None:
            state.update((m,))
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), value: rows[value].to_numpy(), "memory": out})

    return series.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, {value} double, memory double", "m double", "append", GroupStateTimeout.NoTimeout)


def hop_stream(series: DataFrame, key: str, order: str, value: str, width: int, step: int) -> DataFrame:
    """Row-count hop windows of each key as they fill: ``key, win, end, mean``. State is the last ``width`` values and the row count.

    A key's rows of one batch are sorted in memory; ``read_events`` bounds a batch by files a trigger.
    """
    kinds = dict(series.dtypes)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, tail = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        out = []
        for t, x in pd.concat(list(frames)).sort_values(order)[[order, value]].itertuples(index=False):
            # a window is out when the row after it arrives, as in the batch form, where the last row ends none
            if n >= width and (n - width) % step == 0:
                out.append((k[0], (n - width) // step, n, float(sum(tail) / width)))
            tail = [*tail, float(x)][-width:]
            n += 1
        state.update((n, tail))
        yield pd.DataFrame(out, columns=[key, "win", "end", "mean"])

    return series.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, win int, end int, mean double", "n int, tail array<double>", "append", GroupStateTimeout.NoTimeout)


def replay(df: DataFrame, name: str) -> DataFrame:
    """Runs an append-mode stream over all there is into Parquet in the shared folder, its progress kept beside it, and takes the rows from there; the folder goes."""
    spark, base = df.sparkSession, f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    q = df.writeStream.outputMode("append").format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return taken(spark.read.schema(df.schema).parquet(f"{base}/rows"), base)

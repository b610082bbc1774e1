"""State in event time equals the batch form, whatever the batches, with rows out of order and rows too late."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.streaming import stateful

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def run(spark, tmp_path, batches, schema, query):
    """The rows of a stream over one file for each batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stateful.use_rocks(spark)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = query(source).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out").collect()


def test_networks_of_two_panels(spark, tmp_path):
    """A row eight days late comes in its place; one later than the watermark is left out."""
    rng = np.random.default_rng(1)
    x = {k: rng.normal(size=(40, 4)) + rng.normal(size=(40, 1)) for k in "ab"}
    order = [i for i in range(40) if i not in (12, 3)]
    order.insert(order.index(20), 12)
    order.append(3)  # 36 days late
    days = [order[i : i + 10] for i in range(0, 40, 10)]
    batches = [[(k, START + dt.timedelta(days=i), x[k][i].tolist()) for i in part for k in "ab"] for part in days]
    got = {(g["key"], g["win"]): g for g in run(spark, tmp_path, batches, "key string, ts timestamp, x array<double>", lambda s: stateful.window_networks(s, 10, 3, "10 days"))}
    assert len(got) == 2 * 7
    for (k, win), g in got.items():
        kept = np.delete(x[k], 3, axis=0)[3 * win : 3 * win + 10]
        assert g["mean_abs_corr"] == pytest.approx(np.abs(np.corrcoef(kept, rowvar=False)[np.triu_indices(4, 1)]).mean())


def test_statistics_of_series(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(scale=0.1, size=60)
    order = rng.permutation(60).reshape(3, 20)  # within a batch and across batches out of order, inside the watermark
    batches = [[("s", START + dt.timedelta(hours=int(i)), float(x[i])) for i in part] for part in order] + [[("s", START + dt.timedelta(days=30), 0.0)]]
    got = sorted(run(spark, tmp_path, batches, "key string, ts timestamp, x double", lambda s: stateful.series_statistics(s, "4 days", 0.9, 5)), key=lambda g: g["ts"])
    assert len(got) == 60
    equity = np.cumsum(x)
    for k, g in enumerate(got):
        tail = x[max(0, k - 4) : k + 1]
        w = 0.9 ** np.arange(len(tail))[::-1]
        assert g["ewvar"] == pytest.approx((w * tail**2).sum() / w.sum()) and g["equity"] == pytest.approx(equity[k])
        assert g["drawdown"] == pytest.approx(np.exp(equity[k] - equity[: k + 1].max()) - 1)


def test_registered_metrics_and_functions(spark):
    """A metric of the caller's own in the group-map and in SQL; persistence in SQL equals the kernel."""
    from weftline.functions import kernels, surface
    from weftline.operators import metrics

    surface.register_metric("spread", lambda x, c, s, a: float(x.max() - x.min()))
    try:
        surface.register(spark)
        rng = np.random.default_rng(3)
        x = rng.normal(size=(12, 3))
        m = spark.createDataFrame([(0, t, f"n{i}", float(x[t, i])) for t in range(12) for i in range(3)], "win int, pos int, node string, ret double")
        assert metrics.window_metrics(m, ["spread"]).first()["spread"] == pytest.approx(np.ptp(x))
        held = spark.createDataFrame([(x.tolist(),), (None,)], "returns array<array<double>>")
        got = spark.sql("SELECT window_metric('spread', returns) AS s, window_metric('absorption', returns) AS a, window_metric('none', returns) AS n FROM {held} ORDER BY s NULLS LAST", held=held).collect()
        c = kernels.correlation(x)
        assert got[0]["s"] == pytest.approx(np.ptp(x)) and got[0]["a"] == pytest.approx(metrics.METRICS["absorption"][0](x, c, None, None))
        assert got[0]["n"] is None and got[1]["s"] is None
        t = np.arange(8) * np.pi / 4
        cloud = spark.createDataFrame([(np.c_[np.cos(t), np.sin(t)].tolist(),), ([[0.0, 0.0]],)], "points array<array<double>>")
        rows = spark.sql("SELECT dim, birth, death FROM {cloud}, LATERAL persistence(points)", cloud=cloud).collect()
        d = np.sqrt(((np.c_[np.cos(t), np.sin(t)][:, None] - np.c_[np.cos(t), np.sin(t)][None]) ** 2).sum(-1))
        assert sorted(map(tuple, rows)) == sorted((q, pytest.approx(b), pytest.approx(e)) for q, b, e in kernels.loops_and_parts(d))
        with pytest.raises(ValueError):
            surface.register_metric("x", lambda x, c, s, a: 0.0, 2)
    finally:
        metrics.METRICS.pop("spread")

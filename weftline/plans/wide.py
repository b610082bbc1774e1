"""Registered queries on networks of hundreds of nodes, on kernels called from SQL text, and on state kept in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.catalog import query
from weftline.functions import surface
from weftline.operators import blocks, metrics, panel, windows
from weftline.sources.readers import parquet
from weftline.sources.shared import once
from weftline.streaming import stateful, streams

from . import spectra
from .base import EDGES, NETWORK, r, weekly_returns, weekly_windows

#: Groups of parts that are the nodes, months of a window and between two, and nodes of a block.
NODES, MONTHS, HOP, BLOCK_NODES = 240, 24, 12, 64

WIDE = f"""facts AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, l_partkey % {NODES} AS node, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
g AS (SELECT ts, node, coalesce(value, 0) AS value FROM (SELECT DISTINCT ts FROM facts) CROSS JOIN (SELECT DISTINCT node FROM facts) LEFT JOIN facts USING (ts, node)),
rets AS (SELECT * FROM (SELECT ts, node, CAST(value - lag(value) OVER (PARTITION BY node ORDER BY ts) AS DOUBLE) AS ret FROM g) WHERE ret IS NOT NULL),
axis AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT DISTINCT ts FROM rets)),
n AS (SELECT count(*) AS n FROM axis),
hops AS (SELECT CAST((e - {MONTHS}) / {HOP} AS INTEGER) AS win, e AS "end" FROM (SELECT unnest(range({MONTHS}, (SELECT n FROM n), {HOP})) AS e)),
mem AS (SELECT win, pos, node, ret FROM hops JOIN axis ON pos >= "end" - {MONTHS} AND pos < "end" JOIN rets USING (ts)),
{NETWORK}"""


def wide_windows(spark, d: str) -> DataFrame:
    """Members ``win, pos, node, ret`` of windows of monthly changes in the quantity of each of NODES groups of parts; months without a sale count as 0."""
    facts = parquet(spark, d, "lineitem").select("l_shipdate", "l_partkey", "l_quantity")
    p = panel.panel(facts, F.date_trunc("month", "l_shipdate").cast("date"), (F.col("l_partkey") % NODES).alias("node"), F.col("l_quantity"))
    filled = panel.grid(once(p)).withColumn("value", F.coalesce("value", F.lit(0)).cast("double"))
    ret = once(panel.changes(filled, log=False).where(F.col("ret").isNotNull()))
    return windows.members(ret, panel.axis(ret), MONTHS, HOP)


@query(f"""WITH {WIDE}
SELECT d.win, d.n, round(t.tr_a3, 4) AS tr_a3, round(CASE WHEN paths - tr_a2 > 0 THEN t.tr_a3 / (paths - tr_a2) ELSE 0.0 END, 6) AS clustering, round(mass / (d.n * (d.n - 1)), 6) AS density, round(degree_variance, 5) AS degree_variance
FROM (SELECT win, count(*) AS n, sum(degree) AS mass, sum(degree ^ 2) AS paths, var_pop(degree) AS degree_variance FROM deg GROUP BY 1) d
JOIN (SELECT win, 2 * sum(rho ^ 2) AS tr_a2 FROM edges GROUP BY 1) e ON e.win = d.win JOIN (SELECT win, 6 * sum(w) AS tr_a3 FROM tri GROUP BY 1) t ON t.win = d.win""")
def blocked_factors(spark, d):
    """Network factors of hundreds of nodes by products of blocks."""
    f = blocks.factors(blocks.node_sums(wide_windows(spark, d), BLOCK_NODES))
    return f.select("win", "n", r("tr_a3", 4).alias("tr_a3"), r("clustering").alias("clustering"), r("density").alias("density"), r("degree_variance", 5).alias("degree_variance"))


@query(f"""WITH {WIDE},
sides AS (SELECT win, i AS node, w FROM tri UNION ALL SELECT win, j, w FROM tri UNION ALL SELECT win, k, w FROM tri),
each AS (SELECT win, node, 2 * sum(w) AS tri FROM sides GROUP BY 1, 2)
SELECT win, d.node, round(coalesce(e.tri, 0.0), 5) AS tri, round(coalesce(e.tri, 0.0) / greatest(sum(e.tri) OVER (PARTITION BY win), 1e-12), 8) AS share, round(degree, 6) AS degree FROM deg d LEFT JOIN each e USING (win, node)""")
def blocked_attribution(spark, d):
    """Each node's triangle mass, its share and its degree, likewise."""
    s = once(blocks.node_sums(wide_windows(spark, d), BLOCK_NODES))
    total = s.groupBy("win").agg(F.sum("tri").alias("total"))
    return s.join(total, "win").select("win", "node", r("tri", 5).alias("tri"), r(F.col("tri") / F.greatest("total", F.lit(1e-12)), 8).alias("share"), r("degree").alias("degree"))


@query("WITH " + spectra.INDICES + " SELECT win, round(omega, 5) AS omega, round(absorption, 5) AS absorption, round(erank, 5) AS erank FROM indices")
def metrics_in_sql(spark, d):
    """Metrics by name in SQL text (2.15)."""
    surface.register(spark)
    m = weekly_windows(spark, d)[0]
    dates = m.groupBy("win", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "ret"))), lambda x: x["ret"]).alias("x"))  # a row of nodes
    held = dates.groupBy("win").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda x: x["x"]).alias("returns"))
    named = ", ".join(f"round(window_metric('{c}', returns), 5) AS {c}" for c in ("omega", "absorption", "erank"))
    return spark.sql(f"SELECT win, {named} FROM {{held}}", held=held)


@query()
def persistence_in_sql(spark, d):
    """Loops of the delay vectors of each node's returns by a table function in SQL text; the rows of ``takens_loops`` (N18, 2.15)."""
    surface.register(spark)
    ret = weekly_returns(spark, d)
    v = windows.delay_vectors(ret, "ret", 3, 2, ["node"]).join(panel.axis(ret), "ts")
    clouds = v.groupBy(F.concat_ws(":", "node", F.floor(F.col("pos") / 30)).alias("key")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "vector"))), lambda x: x["vector"]).alias("points"))  # thirty dates
    return spark.sql("SELECT key, count(*) AS loops, sum(death - birth) AS length FROM {clouds}, LATERAL persistence(points) WHERE dim = 1 GROUP BY key", clouds=clouds)


@query("""WITH e AS (SELECT user_id, ts, round(value, 4) / 1000 AS x, row_number() OVER w AS k, sum(round(value, 4) / 1000) OVER w AS equity FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value)),
d AS (SELECT *, exp(equity - max(equity) OVER (PARTITION BY user_id ORDER BY k)) - 1 AS drawdown FROM e),
v AS (SELECT a.user_id, a.k, sum(b.x * b.x * pow(CAST(0.94 AS DOUBLE), a.k - b.k)) / sum(pow(CAST(0.94 AS DOUBLE), a.k - b.k)) AS ewvar FROM e a JOIN e b ON b.user_id = a.user_id AND b.k <= a.k AND b.k > a.k - 60 GROUP BY 1, 2)
SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(epoch_us(ts) AS BIGINT) AS at, round(ewvar, 6) AS ewvar, round(equity, 6) AS equity, round(drawdown, 6) AS drawdown FROM d JOIN v USING (user_id, k) WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_series_statistics(spark, d):
    """Each user's events as a stream: decayed variance, running sum and fall from its peak as state in order of event time (W9, W12, 2.14); events of the last day are still open."""
    stateful.use_rocks(spark)
    e = streams.read_events(spark, f"{d}/events.parquet*").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.round("value", 4) / 1000).alias("x"))
    out = streams.replay(stateful.series_statistics(e, "1 day"), "series-statistics")
    return out.select(F.col("key").alias("user_id"), F.unix_micros("ts").alias("at"), *[r(c).alias(c) for c in ("ewvar", "equity", "drawdown")])


#: Steps of the power iteration that finds the first eigenvector in SQL.
STEPS = 600


@query(f"""WITH RECURSIVE {EDGES}, cells AS (SELECT win, i, j, rho FROM both_ways UNION ALL SELECT DISTINCT win, i, i, 1.0 FROM both_ways),
rws AS (SELECT win, i, list(rho ORDER BY j) AS rw FROM cells GROUP BY 1, 2), mat AS (SELECT win, list(rw ORDER BY i) AS m, list(i ORDER BY i) AS nodes FROM rws GROUP BY 1),
it(win, step, v) AS (SELECT win, 0, list_transform(range(len(m)), lambda k: 1.0 + 0.1::DOUBLE * k) FROM mat
 UNION ALL SELECT win, step + 1, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) FROM (SELECT it.win, step, list_transform(m, lambda rw: list_dot_product(rw, v)) AS u FROM it JOIN mat USING (win) WHERE step < {STEPS}))
SELECT win, unnest(nodes) AS node, round(unnest(list_transform(v, lambda x: abs(x))), 4) AS first, round(unnest(list_transform(v, lambda x: abs(x) / list_sum(list_transform(v, lambda y: abs(y))))), 4) AS share FROM it JOIN mat USING (win) WHERE step = {STEPS}""")
def spectral_attribution(spark, d):
    """Each node's weight in its window's first factor, and its share of all."""
    s = metrics.node_scores(weekly_windows(spark, d)[0], (1,))
    total = s.groupBy("win").agg(F.sum("spectral_1").alias("total"))
    return s.join(total, "win").select("win", "node", r("spectral_1", 4).alias("first"), r(F.col("spectral_1") / F.col("total"), 4).alias("share"))

"""Panels that the registered queries share, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline.operators import filters, network, panel, scoring, windows
from weftline.sources.readers import parquet
from weftline.sources.shared import once

WIDTH, STEP = 20, 3


def r(c: str | Column, places: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, places)


def weekly(spark, d: str) -> DataFrame:
    """Week by part type: the sum of extended prices."""
    facts = parquet(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice").join(parquet(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return panel.panel(facts, F.date_trunc("week", "l_shipdate").cast("date"), F.col("p_type"), F.col("l_extendedprice"))


def nation_weekly(spark, d: str) -> DataFrame:
    facts = parquet(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice").join(parquet(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return panel.panel(facts, F.date_trunc("week", "l_shipdate").cast("date"), F.format_string("n%02d", "s_nationkey"), F.col("l_extendedprice"))


def hourly(spark, d: str) -> DataFrame:
    e = parquet(spark, d, "events").select("ts", "event_type", "value")
    return panel.panel(e, F.date_trunc("hour", F.col("ts").cast("timestamp")), F.col("event_type"), F.col("value"))


def weekly_returns(spark, d: str) -> DataFrame:
    return panel.returns(once(weekly(spark, d)), "drop_then_diff")  # three branches read the panel: facts are scanned once


def weekly_windows(spark, d: str, width: int = WIDTH, step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """Window members ``win, pos, ts, node, ret`` and the windows' ends."""
    ret = once(weekly_returns(spark, d))  # some thousand dates by nodes, whatever the size of the facts
    a = panel.axis(ret)
    return windows.members(ret, a, width, step), windows.hops(a, width, step)


def network_of(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Edges ``win, i, j, rho`` of all windows, each product made once, and the windows' ends."""
    ret = once(weekly_returns(spark, d))
    a = panel.axis(ret)
    ends = windows.hops(a, WIDTH, STEP)
    return once(network.sliding_correlations(ret.join(F.broadcast(a), "ts"), ends, WIDTH)), ends  # a calendar


def edges(spark, d: str) -> DataFrame:
    return network_of(spark, d)[0]


def index_series(spark, d: str) -> DataFrame:
    """``win, end_ts, gapless, mean_abs_corr, clustering``: one row for each window, thousands at any data size."""
    e, ends = network_of(spark, d)
    return once(network.factors(e).join(ends, "win"))


def scored(spark, d: str) -> DataFrame:
    """Index series in long form ``metric, win, end_ts, x`` with label lists, crises and episodes."""
    f = index_series(spark, d).select("win", "end_ts", "gapless", "mean_abs_corr", "clustering")
    long = f.unpivot(["win", "end_ts"], ["gapless", "mean_abs_corr", "clustering"], "metric", "x").withColumn("x", F.round("x", 9))
    return scoring.labelled(long, scoring.intervals(spark), "end_ts")


PANEL = """panel AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS ts, p_type AS node, sum(l_extendedprice) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
RETURNS = PANEL + """,
full_ts AS (SELECT ts FROM panel GROUP BY ts HAVING count(node) = (SELECT count(DISTINCT node) FROM panel)),
rets AS (
  SELECT * FROM (SELECT ts, node, ln(value) - lag(ln(value)) OVER (PARTITION BY node ORDER BY ts) AS ret FROM panel WHERE ts IN (SELECT ts FROM full_ts)) WHERE ret IS NOT NULL),
axis AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT DISTINCT ts FROM rets)),
n AS (SELECT count(*) AS n FROM axis)"""
WINDOWS = RETURNS + """,
ends AS (SELECT CAST((e - 20) / 3 AS INTEGER) AS win, e AS "end" FROM (SELECT unnest(range(20, (SELECT n FROM n), 3)) AS e)),
hops AS (SELECT win, "end", ts AS end_ts FROM ends JOIN axis ON pos = "end" - 1),
mem AS (SELECT win, "end", pos, node, ret FROM hops JOIN axis ON pos >= "end" - 20 AND pos < "end" JOIN rets USING (ts))"""
NETWORK = """mom AS (
  SELECT a.win, a.node AS i, b.node AS j, count(*) AS n, sum(a.ret * b.ret) - sum(a.ret) * sum(b.ret) / count(*) AS cxy,
         sum(a.ret * a.ret) - sum(a.ret) * sum(a.ret) / count(*) AS cxx, sum(b.ret * b.ret) - sum(b.ret) * sum(b.ret) / count(*) AS cyy
  FROM mem a JOIN mem b ON a.win = b.win AND a.pos = b.pos AND a.node < b.node GROUP BY 1, 2, 3),
edges AS (SELECT win, i, j, CASE WHEN cxx > 1e-12 AND cyy > 1e-12 THEN cxy / sqrt(cxx * cyy) ELSE 0.0 END AS rho FROM mom),
both_ways AS (SELECT win, i, j, rho FROM edges UNION ALL SELECT win, j, i, rho FROM edges),
tri AS (
  SELECT a.win, a.i, a.j, b.j AS k, abs(a.rho) * abs(b.rho) * abs(c.rho) AS w, a.rho * b.rho * c.rho AS sw
  FROM edges a JOIN edges b ON a.win = b.win AND a.j = b.i JOIN edges c ON a.win = c.win AND c.i = a.i AND c.j = b.j),
deg AS (SELECT win, i AS node, sum(abs(rho)) AS degree FROM both_ways GROUP BY 1, 2),
node_tri AS (
  SELECT d.win, d.node, coalesce(sum(2 * w), 0.0) AS tri FROM deg d LEFT JOIN tri t ON t.win = d.win AND d.node IN (t.i, t.j, t.k) GROUP BY 1, 2)"""
EDGES = WINDOWS + ",\n" + NETWORK
FACTORS = EDGES + """,
fac AS (
  SELECT d.win, d.n, t.tr_a3, t.tr_a3 / d.n ^ 3 AS tr_a3_n3, CASE WHEN paths - tr_a2 > 0 THEN t.tr_a3 / (paths - tr_a2) ELSE 0.0 END AS clustering,
         mass / (d.n * (d.n - 1)) AS density, degree_variance, mean_abs_corr
  FROM (SELECT win, count(*) AS n, sum(degree) AS mass, sum(degree ^ 2) AS paths, var_pop(degree) AS degree_variance FROM deg GROUP BY 1) d
  JOIN (SELECT win, 2 * sum(rho ^ 2) AS tr_a2, avg(abs(rho)) AS mean_abs_corr FROM edges GROUP BY 1) e ON e.win = d.win
  JOIN (SELECT win, 6 * sum(w) AS tr_a3 FROM tri GROUP BY 1) t ON t.win = d.win),
idx AS (SELECT fac.*, clustering * density * degree_variance AS gapless, hops.end_ts, hops."end" FROM fac JOIN hops USING (win))"""
SPANS = "spans(list, name, a, b) AS (VALUES " + ", ".join(f"('{x[0]}', '{x[1]}', DATE '{x[2]}', DATE '{x[3]}')" for x in scoring.INTERVALS) + ")"
SCORED = FACTORS + f""",
{SPANS},
longx AS (
  SELECT metric, win, end_ts, round(x, 9) AS x FROM (SELECT 'gapless' AS metric, win, end_ts, gapless AS x FROM idx UNION ALL SELECT 'mean_abs_corr', win, end_ts, mean_abs_corr FROM idx UNION ALL SELECT 'clustering', win, end_ts, clustering FROM idx)),
scored AS (
  SELECT l.metric, l.win, l.end_ts, l.x, s.list, min(CASE WHEN l.end_ts BETWEEN s.a AND s.b THEN s.name END) AS episode, bool_or(l.end_ts BETWEEN s.a AND s.b) AS crisis
  FROM longx l CROSS JOIN spans s GROUP BY ALL)"""

__all__ = ["EDGES", "FACTORS", "NETWORK", "PANEL", "RETURNS", "SCORED", "SPANS", "WINDOWS", "edges", "filters", "hourly", "index_series", "nation_weekly", "r", "scored", "weekly", "weekly_returns", "weekly_windows"]

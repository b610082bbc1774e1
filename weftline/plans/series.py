"""Registered queries: panels, returns, windows, networks and filters."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from weftline.catalog import query
from weftline.operators import filters, network, panel, windows
from weftline.sources.readers import parquet

from .base import EDGES, FACTORS, PANEL, RETURNS, WINDOWS, edges, hourly, index_series, nation_weekly, r, weekly, weekly_returns, weekly_windows

@query(f"WITH {PANEL} SELECT ts, node, round(value, 2) AS value FROM panel")
def panel_weekly(spark, d):
    return weekly(spark, d).select("ts", "node", r("value", 2).alias("value"))


@query("""WITH p AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS ts, p_size % 4 AS node, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT ts, max(value) FILTER (node = 0) AS s0, max(value) FILTER (node = 1) AS s1, max(value) FILTER (node = 2) AS s2, max(value) FILTER (node = 3) AS s3 FROM p GROUP BY ts""")
def panel_wide(spark, d):
    facts = parquet(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_quantity").join(parquet(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    p = panel.panel(facts, F.date_trunc("week", "l_shipdate").cast("date"), F.concat(F.lit("s"), F.col("p_size") % 4), F.col("l_quantity"))
    return panel.wide(p, ["s0", "s1", "s2", "s3"])


NATION = """panel AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS ts, printf('n%02d', s_nationkey) AS node, sum(l_extendedprice) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


@query(f"WITH {NATION}, t AS (SELECT ts FROM panel GROUP BY ts HAVING count(node) = (SELECT count(DISTINCT node) FROM panel)) SELECT ts, node, round(value, 2) AS value FROM panel WHERE ts IN (SELECT ts FROM t)")
def panel_complete_m2(spark, d):
    return panel.complete_rows(nation_weekly(spark, d)).select("ts", "node", r("value", 2).alias("value"))


@query(f"""WITH {NATION}, g AS (SELECT ts, node, value FROM (SELECT DISTINCT ts FROM panel) CROSS JOIN (SELECT DISTINCT node FROM panel) LEFT JOIN panel USING (ts, node)),
c AS (SELECT ts, node, ln(value) - lag(ln(value)) OVER (PARTITION BY node ORDER BY ts) AS ret FROM g),
t AS (SELECT ts FROM c GROUP BY ts HAVING count(ret) = (SELECT count(DISTINCT node) FROM c)) SELECT ts, node, round(ret, 6) AS ret FROM c WHERE ts IN (SELECT ts FROM t)""")
def returns_m1(spark, d):
    return panel.returns(nation_weekly(spark, d), "diff_then_drop").select("ts", "node", r("ret").alias("ret"))


@query(f"WITH {RETURNS} SELECT ts, node, round(ret, 6) AS ret FROM rets")
def returns_m2(spark, d):
    return weekly_returns(spark, d).select("ts", "node", r("ret").alias("ret"))


@query(f"""WITH {NATION}, g AS (SELECT ts, node, value FROM (SELECT DISTINCT ts FROM panel) CROSS JOIN (SELECT DISTINCT node FROM panel) LEFT JOIN panel USING (ts, node)),
f AS (SELECT ts, node, last_value(value IGNORE NULLS) OVER (PARTITION BY node ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, first_value(value IGNORE NULLS) OVER (PARTITION BY node ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM g),
c AS (SELECT ts, node, ln(coalesce(a, b)) - lag(ln(coalesce(a, b))) OVER (PARTITION BY node ORDER BY ts) AS ret FROM f) SELECT ts, node, round(ret, 6) AS ret FROM c WHERE ret IS NOT NULL""")
def returns_m3_fill(spark, d):
    return panel.returns(nation_weekly(spark, d), "fill").select("ts", "node", r("ret").alias("ret"))


@query(f"""WITH {NATION}, k AS (SELECT node FROM panel GROUP BY node HAVING count(*) = (SELECT count(DISTINCT ts) FROM panel)),
c AS (SELECT ts, node, ln(value) - lag(ln(value)) OVER (PARTITION BY node ORDER BY ts) AS ret FROM panel WHERE node IN (SELECT node FROM k)) SELECT ts, node, round(ret, 6) AS ret FROM c WHERE ret IS NOT NULL""")
def returns_m4_complete_nodes(spark, d):
    return panel.returns(nation_weekly(spark, d), "complete_columns").select("ts", "node", r("ret").alias("ret"))


@query("""WITH panel AS (SELECT date_trunc('hour', ts) AS ts, event_type AS node, sum(value) AS value FROM events GROUP BY 1, 2),
g AS (SELECT ts, node, value FROM (SELECT DISTINCT ts FROM panel) CROSS JOIN (SELECT DISTINCT node FROM panel) LEFT JOIN panel USING (ts, node)),
c AS (SELECT ts, node, value - lag(value) OVER (PARTITION BY node ORDER BY ts) AS ret FROM g),
t AS (SELECT ts FROM c GROUP BY ts HAVING count(ret) = (SELECT count(DISTINCT node) FROM c)) SELECT CAST(epoch(ts) AS BIGINT) AS ts, node, round(ret, 4) AS ret FROM c WHERE ts IN (SELECT ts FROM t)""")
def level_diffs_m5(spark, d):
    return panel.returns(hourly(spark, d), "level_diff").select(F.unix_seconds("ts").alias("ts"), "node", r("ret", 4).alias("ret"))


@query("""WITH p AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS ts, p_brand AS node, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
b(basket, node) AS (VALUES ('small', 'Brand#11'), ('small', 'Brand#12'), ('mixed', 'Brand#11'), ('mixed', 'Brand#23'), ('mixed', 'Brand#45'))
SELECT basket, count(*) AS n, round(sum(value), 2) AS total FROM p JOIN b USING (node) WHERE ts >= DATE '1998-01-01' GROUP BY basket""")
def basket_subsets(spark, d):
    """Node subsets by a basket relation (P1, P2) after a temporal split."""
    facts = parquet(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_quantity").join(parquet(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    p = panel.panel(facts, F.date_trunc("week", "l_shipdate").cast("date"), F.col("p_brand"), F.col("l_quantity"))
    b = spark.createDataFrame([("small", "Brand#11"), ("small", "Brand#12"), ("mixed", "Brand#11"), ("mixed", "Brand#23"), ("mixed", "Brand#45")], "basket string, node string")
    return p.where(F.col("ts") >= F.lit("1998-01-01").cast("date")).join(F.broadcast(b), "node").groupBy("basket").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 2).alias("total"))


@query(f'WITH {WINDOWS} SELECT win, "end", end_ts FROM hops')
def hop_windows(spark, d):
    return weekly_windows(spark, d)[1].select("win", F.col("end").cast("long").alias("end"), "end_ts")


@query(f"WITH {WINDOWS} SELECT win, count(*) AS n, count(DISTINCT pos) AS dates, min(pos) AS first_pos, max(pos) AS last_pos FROM mem GROUP BY win")
def window_members(spark, d):
    m = weekly_windows(spark, d)[0]
    return m.groupBy("win").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pos").alias("dates"), F.min("pos").cast("long").alias("first_pos"), F.max("pos").cast("long").alias("last_pos"))


@query(f"WITH {PANEL} SELECT ts, node, round(CASE WHEN count(value) OVER w = 20 THEN avg(value) OVER w END, 4) AS rolling FROM panel WINDOW w AS (PARTITION BY node ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def rolling_mean_20(spark, d):
    return windows.rolling_mean(weekly(spark, d), "value", 20, ["node"]).select("ts", "node", r("rolling", 4).alias("rolling"))


@query(f"WITH {RETURNS} SELECT ts, node, round(CASE WHEN count(ret) OVER w = 5 THEN sum(ret) OVER w END, 6) AS forward FROM rets WINDOW w AS (PARTITION BY node ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)")
def forward_horizon(spark, d):
    return windows.horizon(weekly_returns(spark, d), "ret", 5, ["node"]).select("ts", "node", r("forward").alias("forward"))


@query(f"WITH {RETURNS} SELECT ts, node, round(x0, 6) AS x0, round(x1, 6) AS x1, round(x2, 6) AS x2 FROM (SELECT ts, node, ret AS x0, lead(ret, 2) OVER w AS x1, lead(ret, 4) OVER w AS x2 FROM rets WINDOW w AS (PARTITION BY node ORDER BY ts)) WHERE x2 IS NOT NULL")
def takens_vectors(spark, d):
    v = windows.delay_vectors(weekly_returns(spark, d), "ret", 3, 2, ["node"])
    return v.select("ts", "node", *[r(F.col("vector")[k]).alias(f"x{k}") for k in range(3)])


@query(f"WITH {EDGES} SELECT win, i, j, round(rho, 6) AS rho, round(sqrt(greatest(2 * (1 - rho), 0)), 5) AS distance FROM edges")
def window_corr_edges(spark, d):
    return edges(spark, d).select("win", "i", "j", r("rho").alias("rho"), r(network.mantegna(F.col("rho")), 5).alias("distance"))


@query(f"WITH {WINDOWS} SELECT a.win, a.node AS i, b.node AS j, round(covar_samp(a.ret, b.ret), 6) AS cov FROM mem a JOIN mem b ON a.win = b.win AND a.pos = b.pos AND a.node < b.node GROUP BY 1, 2, 3")
def window_cov_edges(spark, d):
    return network.covariances(weekly_windows(spark, d)[0]).select("win", "i", "j", r("cov").alias("cov"))


@query(f"WITH {EDGES} SELECT win, i, j, CASE WHEN rho > 0.25 THEN 1 WHEN rho < -0.25 THEN -1 ELSE 0 END AS sign FROM edges")
def signed_binary_edges(spark, d):
    return network.binarised(edges(spark, d))


@query(f"WITH {FACTORS} SELECT win, n, round(tr_a3, 6) AS tr_a3, round(tr_a3_n3, 8) AS tr_a3_n3, round(clustering, 6) AS clustering, round(density, 6) AS density, round(degree_variance, 6) AS degree_variance, round(mean_abs_corr, 6) AS mean_abs_corr, round(gapless, 6) AS gapless FROM idx")
def network_factors(spark, d):
    f = network.factors(edges(spark, d))
    return f.select("win", "n", *[r(c, 8 if c == "tr_a3_n3" else 6).alias(c) for c in ("tr_a3", "tr_a3_n3", "clustering", "density", "degree_variance", "mean_abs_corr", "gapless")])


@query(f"WITH {EDGES} SELECT win, round(6 * sum(sw), 6) AS tr_s3 FROM tri GROUP BY win")
def signed_triangle_mass(spark, d):
    return network.signed_mass(edges(spark, d)).select("win", r("tr_s3").alias("tr_s3"))


@query(f"WITH {EDGES} SELECT win, node, round(tri, 6) AS tri, round(tri / greatest(sum(tri) OVER (PARTITION BY win), 1e-12), 6) AS share FROM node_tri")
def node_attribution(spark, d):
    n = network.node_triangles(edges(spark, d))
    share = F.col("tri") / F.greatest(F.sum("tri").over(Window.partitionBy("win")), F.lit(1e-12))
    return n.select("win", "node", r("tri").alias("tri"), r(share).alias("share"))


@query(f"WITH {EDGES} SELECT win, CASE WHEN sum(tri) > 0 THEN first(node ORDER BY round(tri, 9) DESC, node) END AS culprit FROM node_tri GROUP BY win")
def culprit_node(spark, d):
    n = network.node_triangles(edges(spark, d)).withColumn("k", F.row_number().over(Window.partitionBy("win").orderBy(F.round("tri", 9).desc(), "node")))
    return n.groupBy("win").agg(F.when(F.sum("tri") > 0, F.min_by("node", "k")).alias("culprit"))


@query(f"""WITH {EDGES},
pr AS (SELECT e.win, e.i, e.j, coalesce(3 * sum(t.w), 0.0) AS p FROM edges e LEFT JOIN tri t ON t.win = e.win AND ((t.i = e.i AND t.j = e.j) OR (t.i = e.i AND t.k = e.j) OR (t.j = e.i AND t.k = e.j)) GROUP BY 1, 2, 3),
g AS (SELECT win, p, sum(p) OVER (PARTITION BY win ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM pr),
h AS (SELECT win, degree AS p, sum(degree) OVER (PARTITION BY win ORDER BY degree ROWS UNBOUNDED PRECEDING) AS run FROM deg)
SELECT a.win, round(a.g, 6) AS pressure_gini, round(b.g, 6) AS degree_gini FROM (SELECT win, (count(*) + 1 - 2 * sum(run) / sum(p)) / count(*) AS g FROM g GROUP BY 1) a JOIN (SELECT win, (count(*) + 1 - 2 * sum(run) / sum(p)) / count(*) AS g FROM h GROUP BY 1) b USING (win)""")
def pressure_gini(spark, d):
    e = edges(spark, d)
    p = network.gini(network.pressures(e), "pressure", ["win"]).withColumnRenamed("gini", "pressure_gini")
    k = network.gini(network.degrees(e), "degree", ["win"]).withColumnRenamed("gini", "degree_gini")
    return p.join(k, "win").select("win", r("pressure_gini").alias("pressure_gini"), r("degree_gini").alias("degree_gini"))


@query(f"""WITH {EDGES},
rk AS (SELECT n.win, n.node, rank() OVER (PARTITION BY n.win ORDER BY tri) + (count(*) OVER (PARTITION BY n.win, tri) - 1) / 2.0 AS rt, rank() OVER (PARTITION BY n.win ORDER BY degree) + (count(*) OVER (PARTITION BY n.win, degree) - 1) / 2.0 AS rd FROM (SELECT win, node, round(tri, 9) AS tri FROM node_tri) n JOIN (SELECT win, node, round(degree, 9) AS degree FROM deg) d ON d.win = n.win AND d.node = n.node),
er AS (SELECT win, node, rt - avg(rt) OVER w - coalesce(regr_slope(rt, rd) OVER w, 0) * (rd - avg(rd) OVER w) AS e FROM rk WINDOW w AS (PARTITION BY win))
SELECT win, node, round(CASE WHEN stddev_pop(e) OVER (PARTITION BY win) > 1e-9 THEN e / stddev_pop(e) OVER (PARTITION BY win) ELSE 0.0 END, 6) AS residual FROM er""")
def triangle_residual(spark, d):
    e = edges(spark, d)
    s = network.node_triangles(e).join(network.degrees(e), ["win", "node"]).withColumn("tri", F.round("tri", 9)).withColumn("degree", F.round("degree", 9))
    return network.residual_attribution(s).select("win", "node", r("residual").alias("residual"))


@query(f"""WITH {FACTORS}, s AS (SELECT list(gapless ORDER BY win) AS l, list(win ORDER BY win) AS w FROM idx)
SELECT unnest(w) AS win, round(unnest(list_transform(range(1, len(l) + 1), lambda k: list_reduce(l[1:k], lambda m, x: CASE WHEN x > m THEN CAST(0.6 AS DOUBLE) * x + (1 - CAST(0.6 AS DOUBLE)) * m ELSE CAST(0.08 AS DOUBLE) * x + (1 - CAST(0.08 AS DOUBLE)) * m END))), 6) AS memory FROM s""")
def asym_filter(spark, d):
    f = index_series(spark, d).select(F.lit("gapless").alias("metric"), "win", "gapless")
    return filters.smooth(f, "gapless", ["metric"], "win").select("win", r("memory").alias("memory"))


@query(f"""WITH {FACTORS}, s AS (SELECT list(gapless ORDER BY win) AS l, list(win ORDER BY win) AS w FROM idx)
SELECT unnest(w) AS win, round(unnest(list_transform(range(1, len(l) + 1), lambda k: list_reduce(l[1:k], lambda m, x: CAST(0.2 AS DOUBLE) * x + CAST(0.8 AS DOUBLE) * m))), 6) AS memory FROM s""")
def ema_filter(spark, d):
    f = index_series(spark, d).select(F.lit("gapless").alias("metric"), "win", "gapless")
    return filters.smooth(f, "gapless", ["metric"], "win", filters.exponential(0.2)).select("win", r("memory").alias("memory"))


@query(f"""WITH {RETURNS}, p AS (SELECT node, pos, ret FROM rets JOIN axis USING (ts))
SELECT a.node, a.pos, round(sum(b.ret * b.ret * pow(CAST(0.94 AS DOUBLE), a.pos - b.pos)) / sum(pow(CAST(0.94 AS DOUBLE), a.pos - b.pos)), 6) AS ewvar FROM p a JOIN p b ON a.node = b.node AND b.pos BETWEEN a.pos - 59 AND a.pos GROUP BY 1, 2""")
def ewma_variance(spark, d):
    ret = weekly_returns(spark, d)
    return filters.decayed_variance(ret.join(panel.axis(ret), "ts"), "ret", 0.94, ["node"], "pos").select("node", F.col("pos").cast("long").alias("pos"), r("ewvar").alias("ewvar"))


@query(f"""WITH {RETURNS}, e AS (SELECT node, ts, sum(ret) OVER (PARTITION BY node ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM rets)
SELECT node, ts, round(equity, 6) AS equity, round(exp(equity - max(equity) OVER (PARTITION BY node ORDER BY ts ROWS UNBOUNDED PRECEDING)) - 1, 6) AS drawdown FROM e""")
def running_drawdown(spark, d):
    return filters.drawdown(weekly_returns(spark, d), "ret", ["node"]).select("node", "ts", r("equity").alias("equity"), r("drawdown").alias("drawdown"))


@query(f"""WITH {FACTORS}, v AS (SELECT win, round(gapless, 9) AS x FROM idx)
SELECT a.win, round(CASE WHEN count(*) >= 30 THEN quantile_cont(b.x, 0.9) END, 6) AS gate, round(count(*) FILTER (b.win < a.win AND b.x <= a.x) / nullif(count(*) FILTER (b.win < a.win), 0), 6) AS cdf FROM v a JOIN v b ON b.win <= a.win GROUP BY a.win""")
def trailing_statistics(spark, d):
    v = index_series(spark, d).select(F.lit(1).alias("one"), "win", F.round("gapless", 9).alias("x"))
    g = filters.trailing_cdf(filters.trailing_gate(v, "x", 0.9, ["one"], "win"), "x", ["one"], "win")
    return g.select("win", r("gate").alias("gate"), r("cdf").alias("cdf"))


@query(f"""WITH {FACTORS}, z AS (SELECT end_ts, gapless FROM idx WHERE end_ts BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')
SELECT end_ts, round((gapless - avg(gapless) OVER ()) / stddev_samp(gapless) OVER (), 5) AS z FROM z""")
def event_panel_zscore(spark, d):
    """A chart's slice, standardised over its own history."""
    z = index_series(spark, d).where(F.col("end_ts").between(F.lit("1996-01-01").cast("date"), F.lit("1999-12-31").cast("date")))
    s = z.agg(F.avg("gapless").alias("m"), F.stddev_samp("gapless").alias("s"))
    return z.join(F.broadcast(s)).select("end_ts", r((F.col("gapless") - F.col("m")) / F.col("s"), 5).alias("z"))  # one row


"""Registered queries: what indices add to forecasts, falls from many start dates."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from weftline.catalog import query
from weftline.operators import filters, inference, panel, portfolio, risk
from weftline.sources.shared import once

from .base import FACTORS, RETURNS, index_series, r, weekly_returns
from .panels import LOW_AND_EQUAL, equity_sql, low_triangle_weights

#: What is forecast from what: the correlation three windows on, from itself and from two indices.
MODELS = {"base": ["x0"], "gapless": ["x0", "x1"], "clustering": ["x0", "x2"], "both": ["x0", "x1", "x2"]}
REPLICATES, BLOCK = 300, 20


@query(f"""WITH {FACTORS}, a0 AS (SELECT row_number() OVER (ORDER BY win) AS k, mean_abs_corr AS x0, gapless AS x1, clustering AS x2, lead(mean_abs_corr, 3) OVER (ORDER BY win) AS y FROM idx),
a AS (SELECT *, k <= (count(*) OVER ()) // 2 AS train FROM a0 WHERE y IS NOT NULL),
f1 AS (SELECT regr_slope(y, x0) AS yb, regr_intercept(y, x0) AS ya, regr_slope(x1, x0) AS b1, regr_intercept(x1, x0) AS a1, regr_slope(x2, x0) AS b2, regr_intercept(x2, x0) AS a2, avg(y) AS m FROM a WHERE train),
e1 AS (SELECT k, train, y, m, ya + yb * x0 AS base, y - ya - yb * x0 AS ey, x1 - a1 - b1 * x0 AS e1, x2 - a2 - b2 * x0 AS e2 FROM a, f1),
f2 AS (SELECT sum(ey * e1) / sum(e1 * e1) AS c1, sum(ey * e2) / sum(e2 * e2) AS c2, sum(e2 * e1) / sum(e1 * e1) AS d FROM e1 WHERE train),
e2 AS (SELECT e1.*, c1, c2, e2 - d * e1 AS e3 FROM e1, f2), f3 AS (SELECT sum((ey - c1 * e1) * e3) / sum(e3 * e3) AS c3 FROM e2 WHERE train),
p AS (SELECT row_number() OVER (ORDER BY k) - 1 AS pos, (y - m) ^ 2 AS total, (y - base) ^ 2 AS s0, (y - base - c1 * e1) ^ 2 AS s1, (y - base - c2 * e2) ^ 2 AS s2, (y - base - c1 * e1 - c3 * e3) ^ 2 AS s3 FROM e2, f3 WHERE NOT train),
t AS (SELECT pos, total, unnest(['base', 'gapless', 'clustering', 'both']) AS model, unnest([s0, s1, s2, s3]) AS s, s0 FROM p),
g AS (SELECT model, 1 - sum(s) / sum(total) AS r2, (sum(s0) - sum(s)) / sum(total) AS gain FROM t GROUP BY 1), nn AS (SELECT count(*) AS n, sum(total) AS total FROM p),
b0 AS (SELECT rep, blk, rep * (n // {BLOCK} + 1) + blk AS x0, n FROM (SELECT unnest(range({REPLICATES})) AS rep), nn, unnest(range((SELECT n // {BLOCK} + 1 FROM nn))) u(blk)),
b1 AS (SELECT rep, blk, n, (((x0 * 1103515245 + 12345) % 2147483648 * 1103515245 + 12345) % 2147483648) // 1024 % greatest(1, n - {BLOCK}) AS st FROM b0),
b2 AS (SELECT rep, model, sum(s0 - s) / (SELECT total FROM nn) AS gain FROM (SELECT rep, st + o AS src FROM b1, unnest(range({BLOCK})) u(o) WHERE blk * {BLOCK} + o < n) JOIN t ON src = pos GROUP BY 1, 2),
b3 AS (SELECT model, quantile_cont(gain, 0.025) AS lo, quantile_cont(gain, 0.975) AS hi FROM b2 GROUP BY 1)
SELECT model, round(r2, 5) AS r2, round(gain, 5) AS gain, round(lo, 5) AS lo, round(hi, 5) AS hi, CASE WHEN round(lo, 9) > 0 THEN 'adds' WHEN round(hi, 9) < 0 THEN 'hurts' ELSE 'no' END AS verdict FROM g JOIN b3 USING (model)""")
def structure_gain(spark, d):
    """Out-of-sample R squared of four models fitted on the first half, and what indices add to the base, resampled in blocks."""
    w = Window.orderBy("win")  # a row for each window
    x = index_series(spark, d).select(F.row_number().over(w).alias("k"), F.col("mean_abs_corr").alias("x0"), F.col("gapless").alias("x1"), F.col("clustering").alias("x2"), F.lead("mean_abs_corr", 3).over(w).alias("y")).where(F.col("y").isNotNull())
    x = once(x.withColumn("train", F.col("k") <= F.floor(F.count(F.lit(1)).over(Window.partitionBy()) / 2)))
    train, test = x.where("train"), x.where(~F.col("train"))
    betas = once(inference.least_squares(train, "y", MODELS))
    told = inference.predictions(test, ["k"], betas).join(test.select("k", "y"), "k").join(F.broadcast(train.agg(F.avg("y").alias("m"))))  # one row
    pos = F.row_number().over(Window.partitionBy("model").orderBy("k")) - 1
    t = told.select("model", "k", pos.alias("pos"), ((F.col("y") - F.col("predicted")) ** 2).alias("s"), ((F.col("y") - F.col("m")) ** 2).alias("total"))
    t = once(t.join(t.where("model = 'base'").select("k", F.col("s").alias("s0")), "k"))
    n = t.where("model = 'base'").count()
    fit = t.groupBy("model").agg((1 - F.sum("s") / F.sum("total")).alias("r2"), ((F.sum("s0") - F.sum("s")) / F.sum("total")).alias("gain"), F.sum("total").alias("total"))
    drawn = inference.block_starts(spark, n, REPLICATES, BLOCK).join(t, F.col("src") == F.col("pos")).groupBy("rep", "model").agg(F.sum(F.col("s0") - F.col("s")).alias("g"))
    drawn = drawn.join(F.broadcast(fit.select("model", F.col("total").alias("all"))), "model").groupBy("model").agg(F.percentile(F.col("g") / F.col("all"), 0.025).alias("lo"), F.percentile(F.col("g") / F.col("all"), 0.975).alias("hi"))
    verdict = F.when(F.round("lo", 9) > 0, "adds").when(F.round("hi", 9) < 0, "hurts").otherwise("no")
    return fit.join(drawn, "model").select("model", *[r(c, 5).alias(c) for c in ("r2", "gain", "lo", "hi")], verdict.alias("verdict"))


HELD = 52


@query(f"""WITH {equity_sql(LOW_AND_EQUAL)}, numbered AS (SELECT rule, pos, ret, equity, row_number() OVER (PARTITION BY rule ORDER BY pos) AS k FROM eq),
held AS (SELECT s.rule, s.k, m.k AS j, m.equity, greatest(s.equity - s.ret, max(m.equity) OVER (PARTITION BY s.rule, s.k ORDER BY m.k)) AS top FROM numbered s JOIN numbered m ON m.rule = s.rule AND m.k >= s.k AND m.k < s.k + {HELD}),
f AS (SELECT rule, k, exp(min(equity - top)) - 1 AS drawdown FROM held GROUP BY 1, 2 HAVING count(*) = {HELD})
SELECT rule, count(*) AS starts, round(quantile_cont(drawdown, 0.5), 6) AS median_drawdown, round(min(drawdown), 6) AS worst FROM f GROUP BY rule""")
def start_date_drawdowns(spark, d):
    """Median and worst drawdown of each rule over its start dates."""
    w, ret, ends = low_triangle_weights(spark, d)
    equal = portfolio.equal_weights(ret.select("node").distinct().crossJoin(ends.select("win", "end")), ["win"]).withColumn("rule", F.lit("equal"))  # nodes by windows
    both = once(w.select("rule", "win", "end", "node", "weight").unionByName(equal.select("rule", "win", "end", "node", "weight")))
    path = portfolio.walk_forward(both, ret, portfolio.turnover(both, ["rule"], "win"), ["rule"])
    falls = portfolio.start_drawdowns(path, ["rule"], HELD)
    return falls.groupBy("rule").agg(F.count(F.lit(1)).alias("starts"), r(F.percentile("drawdown", 0.5)).alias("median_drawdown"), r(F.min("drawdown")).alias("worst"))


#: Rows of the sample, of the horizon, and between two forecasts; decay of the weighted forecaster; grid of the dynamic one.
SAMPLE, AHEAD, EVERY, DECAY, GRID = 20, 20, 10, 0.94, [(a, b) for a in (0.01, 0.04) for b in (0.9, 0.95)]


@query(f"""WITH {RETURNS}, p AS (SELECT pos, node, ret, ret / stddev_samp(ret) OVER (PARTITION BY node) AS z FROM rets JOIN axis USING (ts)),
e0 AS (SELECT unnest(range({SAMPLE}, (SELECT n FROM n) - {AHEAD}, {EVERY})) AS e), e AS (SELECT e, row_number() OVER (ORDER BY e) - 1 <= (count(*) OVER ()) // 2 AS early FROM e0), g(a, b) AS (VALUES {", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for a, b in GRID)}),
xy AS (SELECT x.pos, x.node AS i, y.node AS j, x.ret AS x, y.ret AS y, x.z * y.z AS zz FROM p x JOIN p y ON x.pos = y.pos AND x.node <= y.node),
smp AS (SELECT 'sample' AS forecaster, 0.0 AS a, 0.0 AS b, e, i, j, corr(x, y) AS rho FROM e JOIN xy ON pos >= e - {SAMPLE} AND pos < e WHERE i < j GROUP BY e, i, j),
s0 AS (SELECT i, j, covar_samp(x, y) AS s FROM xy WHERE pos < {SAMPLE} GROUP BY 1, 2), t AS (SELECT i, j, avg(zz) AS s FROM xy GROUP BY 1, 2),
q AS (SELECT 'ewma' AS forecaster, 0.0 AS a, 0.0 AS b, e, i, j, pow({DECAY}::DOUBLE, e) * s + sum(pow({DECAY}::DOUBLE, e - 1 - pos) * (1 - {DECAY}::DOUBLE) * x * y) AS q FROM e JOIN xy ON pos < e JOIN s0 USING (i, j) GROUP BY e, i, j, s
 UNION ALL SELECT 'dcc', a, b, e, i, j, pow(b, e) * s + sum(pow(b, e - 1 - pos) * ((1 - a - b) * s + a * zz)) FROM e JOIN xy ON pos < e JOIN t USING (i, j), g GROUP BY a, b, e, i, j, s),
f AS (SELECT * FROM smp UNION ALL SELECT x.forecaster, x.a, x.b, x.e, x.i, x.j, x.q / sqrt(y.q * z.q) FROM q x JOIN q y ON y.forecaster = x.forecaster AND y.a = x.a AND y.b = x.b AND y.e = x.e AND y.i = x.i AND y.j = x.i JOIN q z ON z.forecaster = x.forecaster AND z.a = x.a AND z.b = x.b AND z.e = x.e AND z.i = x.j AND z.j = x.j WHERE x.i < x.j),
tr AS (SELECT e, i, j, corr(x, y) AS seen FROM e JOIN xy ON pos >= e AND pos < e + {AHEAD} WHERE i < j GROUP BY e, i, j), sd AS (SELECT e, node, stddev_pop(ret) AS sd FROM e JOIN p ON pos >= e - {SAMPLE} AND pos < e GROUP BY 1, 2),
rv AS (SELECT e, var_pop(m) AS realised FROM (SELECT e, pos, avg(ret) AS m FROM e JOIN p ON pos >= e AND pos < e + {AHEAD} GROUP BY 1, 2) GROUP BY e), own AS (SELECT e, sum(sd ^ 2) AS own, count(*) AS n FROM sd GROUP BY e),
er AS (SELECT forecaster, a, b, f.e AS e, sqrt(avg((rho - seen) ^ 2)) AS rmse, abs((own + 2 * sum(rho * u.sd * v.sd)) / n ^ 2 - realised) AS off FROM f JOIN tr ON tr.e = f.e AND tr.i = f.i AND tr.j = f.j JOIN sd u ON u.e = f.e AND u.node = f.i JOIN sd v ON v.e = f.e AND v.node = f.j JOIN own ON own.e = f.e JOIN rv ON rv.e = f.e GROUP BY forecaster, a, b, f.e, own, n, realised),
best AS (SELECT forecaster, a, b FROM er JOIN e USING (e) WHERE early GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY forecaster ORDER BY round(avg(rmse), 9), a, b) = 1)
SELECT forecaster, a, b, count(*) AS points, round(avg(rmse), 5) AS rmse, round(avg(off), 6) AS variance_error FROM er JOIN e USING (e) JOIN best USING (forecaster, a, b) WHERE NOT early GROUP BY 1, 2, 3""")
def forecast_rivals(spark, d):
    """Sample, weighted and dynamic correlations as forecasts of the next rows: error of correlations and of the portfolio's variance on the second half, the dynamic one's parameters chosen on the first."""
    ret = once(weekly_returns(spark, d))
    a = panel.axis(ret)
    x = once(ret.join(F.broadcast(a), "ts").select(F.col("pos").cast("int").alias("pos"), "node", "ret"))  # a calendar
    ends = list(range(SAMPLE, a.count() - AHEAD, EVERY))
    z = x.withColumn("ret", F.col("ret") / F.stddev_samp("ret").over(Window.partitionBy("node")))
    grid = spark.createDataFrame(GRID, "a double, b double")
    pick = lambda f, name, *ab: f.select(F.lit(name).alias("forecaster"), *ab, F.col("pos").alias("e"), "i", "j", "rho")
    none = (F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    days = lambda lo, hi: spark.createDataFrame([(e, p) for e in ends for p in range(e + lo, e + hi)], "e int, pos int").join(x, "pos")
    both = lambda m: m.select("e", "pos", F.col("node").alias("i"), F.col("ret").alias("u")).join(m.select("e", "pos", F.col("node").alias("j"), F.col("ret").alias("v")), ["e", "pos"]).where("i < j").groupBy("e", "i", "j").agg(F.corr("u", "v").alias("rho"))
    past, next_ = once(days(-SAMPLE, 0)), once(days(0, AHEAD))
    f = pick(both(past).withColumnRenamed("e", "pos"), "sample", *none).unionByName(pick(filters.decayed_covariance_correlation(x, DECAY, SAMPLE, ends), "ewma", *none)).unionByName(pick(filters.dynamic_correlation(z, grid, ends), "dcc", "a", "b"))
    f = once(f)
    true = both(next_).withColumnRenamed("rho", "true")
    error = f.join(true, ["e", "i", "j"]).groupBy("forecaster", "a", "b", "e").agg(F.sqrt(F.avg((F.col("rho") - F.col("true")) ** 2)).alias("rmse"))
    variance = risk.equal_weight_variance(f, past.groupBy("e", "node").agg(F.stddev_pop("ret").alias("sd")), ["e"])
    realised = next_.groupBy("e", "pos").agg(F.avg("ret").alias("m")).groupBy("e").agg(F.var_pop("m").alias("realised"))
    scored = once(error.join(variance, ["forecaster", "a", "b", "e"]).join(realised, "e").withColumn("off", F.abs(F.col("variance") - F.col("realised"))))
    early = F.col("e") <= ends[len(ends) // 2]
    rank = F.row_number().over(Window.partitionBy("forecaster").orderBy(F.round("fit", 9), "a", "b"))  # a few parameters
    best = scored.where(early).groupBy("forecaster", "a", "b").agg(F.avg("rmse").alias("fit")).withColumn("k", rank).where("k = 1").select("forecaster", "a", "b")
    return scored.where(~early).join(F.broadcast(best), ["forecaster", "a", "b"]).groupBy("forecaster", "a", "b").agg(F.count(F.lit(1)).alias("points"), r(F.avg("rmse"), 5).alias("rmse"), r(F.avg("off")).alias("variance_error"))

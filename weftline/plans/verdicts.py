"""Registered queries: labels, alarm scores, inference, calibration, lead and lag."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from weftline import catalog
from weftline.catalog import query
from weftline.operators import draws, filters, inference, network, panel, portfolio, ranks, scoring, windows
from weftline.sources.readers import parquet
from weftline.sources.shared import once

from .base import EDGES, FACTORS, RETURNS, SCORED, index_series, r, scored, weekly_returns, weekly_windows

BY = ["metric", "list"]


@query(f"WITH {SCORED} SELECT list, win, end_ts, episode, crisis FROM scored WHERE metric = 'gapless'")
def crisis_label(spark, d):
    return scored(spark, d).where("metric = 'gapless'").select("list", "win", "end_ts", "episode", "crisis")


@query(f"""WITH {RETURNS}, m AS (SELECT ts, avg(ret) AS ret FROM rets GROUP BY ts),
w AS (SELECT ts, CASE WHEN count(*) OVER a = 20 THEN avg(ret) OVER a END AS back, CASE WHEN count(*) OVER b = 10 THEN avg(ret) OVER b END AS ahead, CASE WHEN count(*) OVER c = 20 THEN avg(ret) OVER c END AS around FROM m WINDOW a AS (ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), c AS (ORDER BY ts ROWS BETWEEN 9 PRECEDING AND 10 FOLLOWING))
SELECT ts, CAST(CASE WHEN back < -0.01 THEN 1 WHEN back >= -0.01 THEN 0 ELSE -1 END AS INTEGER) AS trailing_stress, CAST(CASE WHEN ahead < -0.01 THEN 1 WHEN ahead >= -0.01 THEN 0 ELSE -1 END AS INTEGER) AS ahead_stress, CAST(CASE WHEN around < -0.01 THEN 1 WHEN around >= -0.01 THEN 0 ELSE -1 END AS INTEGER) AS around_stress FROM w""")
def return_label(spark, d):
    m = weekly_returns(spark, d).groupBy("ts").agg(F.avg("ret").alias("ret"))  # one row a date
    back, ahead, around = (Window.orderBy("ts").rowsBetween(*x) for x in ((-19, 0), (1, 10), (-9, 10)))
    mean = lambda w, n: F.when(F.count(F.lit(1)).over(w) == n, F.avg("ret").over(w))
    flag = lambda x: F.when(x < -0.01, 1).when(x >= -0.01, 0).otherwise(-1)  # noqa: E731  -1: not enough rows
    return m.select("ts", flag(mean(back, 20)).alias("trailing_stress"), flag(mean(ahead, 10)).alias("ahead_stress"), flag(mean(around, 20)).alias("around_stress"))


F1_SQL = """SELECT metric, list, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
FROM (SELECT metric, list, count(*) FILTER (alarm AND crisis) AS tp, count(*) FILTER (alarm AND NOT crisis) AS fp, count(*) FILTER (NOT alarm AND crisis) AS fn FROM a GROUP BY 1, 2)"""
ALARM = "SELECT *, x >= quantile_cont(x, 0.9) OVER (PARTITION BY metric, list) AS alarm FROM scored"


def score_columns(df, by):
    return df.select(*by, "tp", "fp", "fn", *[r(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {SCORED}, a AS ({ALARM}) {F1_SQL}")
def f1_p90(spark, d):
    return score_columns(scoring.confusion(scoring.thresholded(scored(spark, d), "x", BY), BY), BY)


@query(f"""WITH {SCORED}, g(share) AS (VALUES (CAST(0.85 AS DOUBLE)), (0.9), (0.95)),
q AS (SELECT metric, list, share, CASE share WHEN 0.85 THEN quantile_cont(x, 0.85) WHEN 0.9 THEN quantile_cont(x, 0.9) ELSE quantile_cont(x, 0.95) END AS t FROM scored CROSS JOIN g GROUP BY 1, 2, 3),
c AS (SELECT metric, list, share, count(*) FILTER (x >= t AND crisis) AS tp, count(*) FILTER (x >= t) AS al, count(*) FILTER (crisis) AS cr FROM scored JOIN q USING (metric, list) GROUP BY 1, 2, 3)
SELECT metric, list, share, round(coalesce(2 * tp / nullif(al + cr, 0), 0), 6) AS f1 FROM c""")
def f1_threshold_grid(spark, d):
    """Scores on a grid of alarm budgets."""
    g = spark.createDataFrame([(0.85,), (0.9,), (0.95,)], "share double")
    s = scored(spark, d)
    q = s.groupBy(*BY).agg(*[F.percentile("x", p).alias(f"q{int(p * 100)}") for p in (0.85, 0.9, 0.95)])
    t = F.when(F.col("share") == 0.85, F.col("q85")).when(F.col("share") == 0.9, F.col("q90")).otherwise(F.col("q95"))
    alarms = s.crossJoin(F.broadcast(g)).join(q, BY).withColumn("alarm", F.col("x") >= t)
    return scoring.confusion(alarms, [*BY, "share"]).select(*BY, "share", r("f1").alias("f1"))


@query(f"WITH {SCORED}, a AS (SELECT *, row_number() OVER (PARTITION BY metric, list ORDER BY x DESC, win) <= floor(count(*) OVER (PARTITION BY metric, list) * CAST(0.1 AS DOUBLE)) AS alarm FROM scored) {F1_SQL}")
def exact_budget_f1(spark, d):
    return score_columns(scoring.confusion(scoring.exact_budget(scored(spark, d), "x", BY, "win"), BY), BY)


@query(f"""WITH {SCORED}, k AS (SELECT metric, list, row_number() OVER w AS k, sum(crisis::INT) OVER (PARTITION BY metric, list ORDER BY x DESC, win ROWS UNBOUNDED PRECEDING) AS tp, sum(crisis::INT) OVER (PARTITION BY metric, list) AS al FROM scored WINDOW w AS (PARTITION BY metric, list ORDER BY x DESC, win)),
p AS (SELECT metric, list, k, tp / k AS p, tp / al AS r FROM k WHERE al > 0)
SELECT metric, list, round(coalesce(sum(a), 0), 6) AS area FROM (SELECT metric, list, (r - lag(r) OVER w) * (p + lag(p) OVER w) / 2 AS a FROM p WINDOW w AS (PARTITION BY metric, list ORDER BY k)) GROUP BY 1, 2""")
def pr_auc(spark, d):
    return scoring.precision_recall_area(scored(spark, d), "x", BY, "win").select(*BY, r("area").alias("area"))


@query(f"""WITH {SCORED}, a AS ({ALARM}), m AS (SELECT *, max(x) OVER (PARTITION BY metric, list) AS mx FROM a)
SELECT metric, list, round(avg(alarm::INT), 6) AS flagged, round(avg((x >= mx - 1e-12)::INT), 6) AS at_max, round(count(DISTINCT round(x, 12)) / count(*), 6) AS distinct_share, avg(alarm::INT) > 0.12 AS saturated FROM m GROUP BY 1, 2""")
def saturation_check(spark, d):
    return scoring.saturation(scored(spark, d), "x", BY).select(*BY, *[r(c).alias(c) for c in ("flagged", "at_max", "distinct_share")], "saturated")


@query(f"WITH {SCORED} SELECT metric, list, round(avg(x) FILTER (crisis), 6) AS crisis_mean, round(avg(x) FILTER (NOT crisis), 6) AS calm_mean, CASE WHEN avg(x) FILTER (crisis) > avg(x) FILTER (NOT crisis) THEN 1 ELSE -1 END AS sign FROM scored GROUP BY 1, 2")
def measured_orientation(spark, d):
    return scoring.orientation(scored(spark, d), "x", BY).select(*BY, r("crisis_mean").alias("crisis_mean"), r("calm_mean").alias("calm_mean"), "sign")


@query(f"WITH {SCORED}, a AS ({ALARM}) SELECT metric, list, count(*) AS alarms, round(avg((episode IS NULL)::INT), 6) AS unexplained FROM a WHERE alarm GROUP BY 1, 2")
def unexplained_alarms(spark, d):
    return scoring.unexplained(scoring.thresholded(scored(spark, d), "x", BY), BY).select(*BY, "alarms", r("unexplained").alias("unexplained"))


@query(f"""WITH {SCORED} SELECT metric, list, CASE WHEN end_ts >= DATE '1998-01-01' THEN 'late' ELSE 'full' END AS part, count(*) AS "rows", count(*) FILTER (crisis) AS labels FROM scored GROUP BY 1, 2, 3 HAVING count(*) >= 40 AND count(*) FILTER (crisis) >= 5""")
def support_guard(spark, d):
    s = scored(spark, d).withColumn("part", F.when(F.col("end_ts") >= F.lit("1998-01-01").cast("date"), "late").otherwise("full"))
    return scoring.supported(s, [*BY, "part"], 40, 5)


@query(f"""WITH {FACTORS}, v AS (SELECT row_number() OVER (ORDER BY win) - 1 AS pos, end_ts, round(gapless, 9) AS a, round(mean_abs_corr, 9) AS b FROM idx),
sp(list, name, a, b) AS (SELECT * FROM (VALUES ('core', 'x', DATE '1995-03-01', DATE '1995-06-15'), ('core', 'y', DATE '1996-09-01', DATE '1996-12-20'), ('core', 'z', DATE '1998-06-01', DATE '1998-10-15'), ('core', 'w', DATE '2000-01-10', DATE '2000-04-20'))),
l AS (SELECT v.pos, v.a, v.b, bool_or(end_ts BETWEEN sp.a AND sp.b) AS crisis FROM v CROSS JOIN sp GROUP BY ALL), nn AS (SELECT count(*) AS n FROM l),
s0 AS (SELECT rep, blk, rep * (n // 20 + 1) + blk AS x0, n FROM (SELECT unnest(range(200)) AS rep), nn, unnest(range((SELECT n // 20 + 1 FROM nn))) t(blk)),
s1 AS (SELECT rep, blk, n, (x0 * 1103515245 + 12345) % 2147483648 AS x1 FROM s0),
s2 AS (SELECT rep, blk, n, ((x1 * 1103515245 + 12345) % 2147483648) // 1024 % greatest(1, n - 20) AS st FROM s1),
dr AS (SELECT rep, st + off AS src FROM s2, unnest(range(20)) o(off) WHERE blk * 20 + off < n),
j AS (SELECT rep, l.* FROM dr JOIN l ON src = pos), q AS (SELECT rep, quantile_cont(a, 0.9) AS qa, quantile_cont(b, 0.9) AS qb FROM j GROUP BY rep),
f AS (SELECT rep, coalesce(2.0 * count(*) FILTER (a >= qa AND crisis) / nullif(count(*) FILTER (a >= qa) + count(*) FILTER (crisis), 0), 0) - coalesce(2.0 * count(*) FILTER (b >= qb AND crisis) / nullif(count(*) FILTER (b >= qb) + count(*) FILTER (crisis), 0), 0) AS delta FROM j JOIN q USING (rep) GROUP BY rep)
SELECT mean, lo, hi, p, round(CASE WHEN mean >= 0 THEN p ELSE 1 - p END, 6) AS p_sided, CASE WHEN lo > 0 AND mean > 0.05 THEN 'better' WHEN hi < 0 AND mean < -0.05 THEN 'worse' ELSE 'tie' END AS verdict
FROM (SELECT round(avg(delta), 6) AS mean, round(quantile_cont(delta, 0.025), 6) AS lo, round(quantile_cont(delta, 0.975), 6) AS hi, round(avg((delta <= 0)::INT), 6) AS p FROM f)""")
def block_bootstrap_df1(spark, d):
    """Paired moving-block bootstrap of an F1 difference, its one-sided p and verdict (T3-T5); starts come from a fixed congruence."""
    v = index_series(spark, d).select(F.row_number().over(Window.orderBy("win")).alias("p"), "end_ts", F.round("gapless", 9).alias("a"), F.round("mean_abs_corr", 9).alias("b")).withColumn("pos", F.col("p") - 1)
    core = scoring.intervals(spark).where("list = 'core'")
    v = scoring.labelled(v, core, "end_ts").select("pos", "crisis", "a", "b")
    v = once(v)
    out = inference.block_bootstrap(v, "a", "b", v.count(), 200, 20)
    out = out.select(*[r(c).alias(c) for c in ("mean", "lo", "hi", "p")])
    return out.select("*", r(inference.one_sided(F.col("p"), F.col("mean"))).alias("p_sided"), inference.verdict(F.col("mean"), F.col("lo"), F.col("hi"), 0.05).alias("verdict"))


@query(f"""WITH {RETURNS}, x AS (SELECT node AS test, pos, round(ret, 9) AS x, round((sum(ret) OVER (PARTITION BY ts) - ret) / (count(*) OVER (PARTITION BY ts) - 1), 9) AS y FROM rets JOIN axis USING (ts)),
c AS (SELECT a.test, s, round(corr(a.x, b.y), 9) AS rho FROM x a, range(0, 201) t(s), x b WHERE b.test = a.test AND b.pos = (a.pos + s) % (SELECT n FROM n) GROUP BY 1, 2),
o AS (SELECT test, rho FROM c WHERE s = 0), t AS (SELECT o.test, o.rho, (1 + count(*) FILTER (abs(c.rho) >= abs(o.rho))) / 201.0::DOUBLE AS p FROM o JOIN c ON c.test = o.test AND s > 0 GROUP BY 1, 2),
h AS (SELECT test, rho, p, CAST(0.05 AS DOUBLE) / (count(*) OVER () - row_number() OVER (ORDER BY round(p, 9), test) + 1) AS threshold FROM t)
SELECT test, round(rho, 6) AS rho, round(p, 6) AS p, round(threshold, 9) AS threshold, bool_and(p <= threshold) OVER (ORDER BY round(p, 9), test ROWS UNBOUNDED PRECEDING) AS holm FROM h""")
def holm_step_down(spark, d):
    """Whether each node moves with the mean of the others, by turning its series around, over all nodes by Holm's step-down."""
    ret = weekly_returns(spark, d)
    day = Window.partitionBy("ts")
    others = (F.sum("ret").over(day) - F.col("ret")) / (F.count(F.lit(1)).over(day) - 1)
    x = once(ret.join(F.broadcast(panel.axis(ret)), "ts").select(F.col("node").alias("test"), "pos", F.round("ret", 9).alias("x"), F.round(others, 9).alias("y")))  # a calendar
    t = inference.shift_test(x, "x", "y", ["test"]).withColumn("p", F.round("p", 9))
    return inference.holm(t).select("test", r("rho").alias("rho"), r("p").alias("p"), r("threshold", 9).alias("threshold"), "holm")


@query(f"""WITH {FACTORS}, v AS (SELECT round(gapless, 9) AS a, round(mean_abs_corr, 9) AS b FROM idx),
k AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM v)
SELECT count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM k""")
def rank_correlation(spark, d):
    v = index_series(spark, d).select(F.lit(1).alias("one"), F.round("gapless", 9).alias("a"), F.round("mean_abs_corr", 9).alias("b"))
    return inference.spearman(v, "a", "b", ["one"]).select("n", r("pearson").alias("pearson"), r("spearman").alias("spearman"))


LEADLAG = f"""WITH {FACTORS}, v AS (SELECT row_number() OVER (ORDER BY win) AS pos, round(gapless, 9) AS a, round(mean_abs_corr, 9) AS b FROM idx),
p AS (SELECT k, v.a, t.b FROM v CROSS JOIN unnest(range(-6, 7)) g(k) JOIN v t ON t.pos = v.pos + k),
rk AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY a) + (count(*) OVER (PARTITION BY k, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY k ORDER BY b) + (count(*) OVER (PARTITION BY k, b) - 1) / 2.0 AS rb FROM p),
c AS (SELECT k, count(*) AS n, corr(ra, rb) AS rho FROM rk GROUP BY k)"""


#: The same of first differences.
LEADLAG_CHANGES = LEADLAG.replace("p AS (SELECT k, v.a", "dv AS (SELECT pos, round(a - lag(a) OVER (ORDER BY pos), 9) AS a, round(b - lag(b) OVER (ORDER BY pos), 9) AS b FROM v QUALIFY pos > 1),\np AS (SELECT k, v.a").replace("FROM v CROSS JOIN unnest(range(-6, 7)) g(k) JOIN v t", "FROM dv v CROSS JOIN unnest(range(-6, 7)) g(k) JOIN dv t")


def _leadlag(spark, d, changes: bool = False):
    w = Window.orderBy("win")  # a row for each window
    v = index_series(spark, d).select("win", F.row_number().over(w).alias("pos"), F.round("gapless", 9).alias("a"), F.round("mean_abs_corr", 9).alias("b"))
    if changes:
        v = v.select("win", "pos", *[F.round(F.col(c) - F.lag(c).over(w), 9).alias(c) for c in "ab"]).where("pos > 1")
    return inference.lead_lag(v.drop("win"), "a", "b", -6, 6)


@query(LEADLAG + " SELECT k, n, round(rho, 6) AS rho FROM c")
def leadlag_ccf(spark, d):
    return _leadlag(spark, d).select(F.col("k").cast("long").alias("k"), "n", r("rho").alias("rho"))


@query(LEADLAG + ", t AS (SELECT * FROM c ORDER BY abs(rho) DESC, abs(k) LIMIT 1) SELECT k, n, round(rho, 6) AS rho, round(1.96 / sqrt(n), 6) AS band, CASE WHEN abs(k) <= 2 THEN 'coincident' WHEN k > 0 THEN 'leads' ELSE 'lags' END AS role FROM t")
def leadlag_summary(spark, d):
    return inference.lead_lag_summary(_leadlag(spark, d)).select(F.col("k").cast("long").alias("k"), "n", r("rho").alias("rho"), r("band").alias("band"), "role")


@query(LEADLAG_CHANGES + " SELECT k, n, round(rho, 6) AS rho FROM c")
def leadlag_changes(spark, d):
    """Lead and lag of first differences, in which a common trend plays no part."""
    return _leadlag(spark, d, True).select(F.col("k").cast("long").alias("k"), "n", r("rho").alias("rho"))


@query(LEADLAG_CHANGES + ", t AS (SELECT * FROM c ORDER BY abs(rho) DESC, abs(k) LIMIT 1) SELECT k, n, round(rho, 6) AS rho, round(1.96 / sqrt(n), 6) AS band, CASE WHEN abs(k) <= 2 THEN 'coincident' WHEN k > 0 THEN 'leads' ELSE 'lags' END AS role FROM t")
def leadlag_changes_summary(spark, d):
    return inference.lead_lag_summary(_leadlag(spark, d, True)).select(F.col("k").cast("long").alias("k"), "n", r("rho").alias("rho"), r("band").alias("band"), "role")


@query(f"""WITH {FACTORS}, v AS (SELECT win, round(gapless, 9) AS x, round(mean_abs_corr, 9) AS y FROM idx), q AS (SELECT quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS q FROM v),
b AS (SELECT CASE WHEN x <= q[1] THEN 1 WHEN x <= q[2] THEN 2 WHEN x <= q[3] THEN 3 WHEN x <= q[4] THEN 4 ELSE 5 END AS bin, y FROM v, q), m AS (SELECT bin, count(*) AS n, avg(y) AS y FROM b GROUP BY bin)
SELECT bin, n, round(y, 6) AS mean_y, coalesce(y > lag(y) OVER (ORDER BY bin), true) AS rising FROM m""")
def quintile_means(spark, d):
    v = index_series(spark, d).select("win", F.round("gapless", 9).alias("x"), F.round("mean_abs_corr", 9).alias("y"))
    q = v.agg(*[F.percentile("x", p).alias(f"q{i}") for i, p in enumerate((0.2, 0.4, 0.6, 0.8))])
    b = v.join(F.broadcast(q))  # one row
    bin_ = F.when(F.col("x") <= F.col("q0"), 1).when(F.col("x") <= F.col("q1"), 2).when(F.col("x") <= F.col("q2"), 3).when(F.col("x") <= F.col("q3"), 4).otherwise(5)
    m = b.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"))
    return m.select("bin", "n", r("y").alias("mean_y"), F.coalesce(F.col("y") > F.lag("y").over(Window.orderBy("bin")), F.lit(True)).alias("rising"))


@query(f"""WITH {FACTORS}, v AS (SELECT mean_abs_corr AS x FROM idx), k AS (SELECT row_number() OVER (ORDER BY x) AS k, count(*) OVER () AS n, x FROM v)
SELECT n, round(max(greatest(k / n - x, x - (k - 1) / n)), 6) AS d FROM k GROUP BY n""")
def uniform_ks(spark, d):
    v = index_series(spark, d).select(F.lit(1).alias("one"), "mean_abs_corr")
    return inference.uniform_distance(v, "mean_abs_corr", ["one"]).select("n", r("d").alias("d"))


@query(f"""WITH {SCORED}, s AS (SELECT list(x ORDER BY win) AS l, list(crisis ORDER BY win) AS c, list(end_ts ORDER BY win) AS t FROM scored WHERE metric = 'gapless' AND list = 'core'),
g(up, down) AS (SELECT CAST(u AS DOUBLE), CAST(v AS DOUBLE) FROM (VALUES (0.3), (0.4), (0.5), (0.6), (0.7), (0.8)) a(u), (VALUES (0.02), (0.05), (0.08), (0.12), (0.16), (0.20)) b(v)),
m AS (SELECT up, down, unnest(list_transform(range(1, len(l) + 1), lambda k: list_reduce(l[1:k], lambda m, x: CASE WHEN x > m THEN up * x + (1 - up) * m ELSE down * x + (1 - down) * m END))) AS x, unnest(c) AS crisis, unnest(t) AS t FROM s, g),
a AS (SELECT up, down, t < DATE '1998-06-01' AS train, round(x, 9) AS x, crisis FROM m), q AS (SELECT up, down, train, quantile_cont(x, 0.9) AS q FROM a GROUP BY 1, 2, 3),
f AS (SELECT up, down, train, coalesce(2 * count(*) FILTER (x >= q AND crisis) / nullif(count(*) FILTER (x >= q) + count(*) FILTER (crisis), 0), 0) AS f1 FROM a JOIN q USING (up, down, train) GROUP BY 1, 2, 3)
SELECT up, down, round(max(f1) FILTER (train), 6) AS f1_train, round(max(f1) FILTER (NOT train), 6) AS f1_test FROM f GROUP BY 1, 2""")
def filter_calibration_grid(spark, d):
    """Filter parameters on a grid, scored on an early and a late half (T10); each grid point is one series of a group-map."""
    return calibrated(spark, d)


#: Strengths of the filter on a grid.
GRID_UP, GRID_DOWN = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8), (0.02, 0.05, 0.08, 0.12, 0.16, 0.20)


def calibrated(spark, d):
    s = once(scored(spark, d).where("metric = 'gapless' AND list = 'core'").select("win", "end_ts", "x", "crisis"))
    grid = spark.createDataFrame([(u, v) for u in GRID_UP for v in GRID_DOWN], "up double, down double")
    points = s.select("win", "x").crossJoin(F.broadcast(grid))  # 36 rows
    long = filters.smooth(points, "x", ["up", "down"], "win", name="m", rates=("up", "down")).select("up", "down", "win", F.round("m", 9).alias("x"))
    j = long.join(s.drop("x"), "win").withColumn("train", F.col("end_ts") < F.lit("1998-06-01").cast("date"))
    by = ["up", "down", "train"]
    f = scoring.confusion(scoring.thresholded(j, "x", by), by)
    return f.groupBy("up", "down").agg(r(F.max(F.when(F.col("train"), F.col("f1")))).alias("f1_train"), r(F.max(F.when(~F.col("train"), F.col("f1")))).alias("f1_test"))


@query(f"SELECT round(corr(f1_train, f1_test), 6) AS rho, arg_max(up, (f1_train, -up, -down)) AS up, arg_max(down, (f1_train, -up, -down)) AS down FROM ({catalog.ORACLES['filter_calibration_grid']})")
def train_test_correlation(spark, d):
    """How far scores of the early half say those of the late one over the grid, and the early half's best point."""
    g = calibrated(spark, d)
    best = F.max_by(F.struct("up", "down"), F.struct("f1_train", -F.col("up"), -F.col("down")))
    return g.agg(r(inference.correlation("f1_train", "f1_test")).alias("rho"), best.alias("b")).select("rho", "b.up", "b.down")


@query(f"""WITH {FACTORS}, a AS (SELECT end_ts, gapless AS x FROM idx), b AS (SELECT end_ts, round(gapless, 4) AS x FROM idx WHERE win % 2 = 0)
SELECT count(*) AS overlap, round(corr(a.x, b.x), 6) AS rho, round(max(abs(a.x - b.x)), 4) AS max_abs FROM a JOIN b USING (end_ts)""")
def replica_check(spark, d):
    """A series against a released copy: overlap, correlation and largest difference."""
    a = index_series(spark, d).select("end_ts", "win", F.col("gapless").alias("x"))
    b = a.where("win % 2 = 0").select("end_ts", F.round("x", 4).alias("y"))
    return a.join(b, "end_ts").agg(F.count(F.lit(1)).alias("overlap"), r(inference.correlation("x", "y")).alias("rho"), r(F.max(F.abs(F.col("x") - F.col("y"))), 4).alias("max_abs"))


@query(f"""WITH {FACTORS}, v AS (SELECT row_number() OVER (ORDER BY win) AS k, count(*) OVER () AS n, gapless AS x, lead(mean_abs_corr, 3) OVER (ORDER BY win) AS y FROM idx),
t AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS m FROM v WHERE k <= n / 2 AND y IS NOT NULL)
SELECT round(1 - sum((y - a - b * x) ^ 2) / sum((y - m) ^ 2), 5) AS r2_test FROM v, t WHERE k > n / 2 AND y IS NOT NULL""")
def incremental_r2(spark, d):
    """Out-of-sample R squared of a line fitted on the first half, against the mean of that half."""
    w = Window.orderBy("win")
    v = index_series(spark, d).select(F.row_number().over(w).alias("k"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"), F.col("gapless").alias("x"), F.lead("mean_abs_corr", 3).over(w).alias("y")).where(F.col("y").isNotNull())
    t = v.where("k <= n / 2").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.avg("y").alias("m"))
    e = v.where("k > n / 2").join(F.broadcast(t))  # one row
    return e.agg(r(1 - F.sum((F.col("y") - F.col("a") - F.col("b") * F.col("x")) ** 2) / F.sum((F.col("y") - F.col("m")) ** 2), 5).alias("r2_test"))


@query("""WITH e AS (SELECT event_type, user_id, round(avg(value), 6) AS v FROM events GROUP BY 1, 2)
SELECT event_type, user_id, round((rank() OVER (PARTITION BY event_type ORDER BY v) + (count(*) OVER (PARTITION BY event_type, v) - 1) / 2.0) / count(v) OVER (PARTITION BY event_type), 6) AS pct FROM e""")
def pct_rank_average(spark, d):
    e = parquet(spark, d, "events").groupBy("event_type", "user_id").agg(F.round(F.avg("value"), 6).alias("v"))
    return ranks.average_ranks(e, "v", ["event_type"]).select("event_type", "user_id", r(F.col("rank") / F.col("n")).alias("pct"))


@query(f"""WITH {EDGES}, top AS (SELECT win, node FROM (SELECT win, node, row_number() OVER (PARTITION BY win ORDER BY round(tri, 9) DESC, node) AS k FROM node_tri) WHERE k <= 2),
oc AS (SELECT 'inside' AS arm, win, node, sum(ret) AS outcome FROM mem WHERE pos >= "end" - 10 GROUP BY 2, 3 UNION ALL SELECT 'ahead', h.win, q.node, sum(ret) FROM hops h JOIN axis a ON a.pos >= h."end" AND a.pos < h."end" + 10 JOIN rets q USING (ts) GROUP BY 2, 3 HAVING count(*) = 10),
nm AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS number FROM (SELECT DISTINCT node FROM rets)),
ob AS (SELECT arm, avg(m) AS observed FROM (SELECT arm, win, avg(outcome) AS m FROM oc JOIN top USING (win, node) GROUP BY 1, 2) GROUP BY 1),
dr AS (SELECT arm, draw, win, outcome, row_number() OVER (PARTITION BY arm, draw, win ORDER BY {draws.sql_scrambled("(draw * 100000 + win) * 100 + number")}, node) AS k FROM oc JOIN nm USING (node), range(1, 201) t(draw)),
nl AS (SELECT arm, draw, avg(m) AS null_mean FROM (SELECT arm, draw, win, avg(outcome) AS m FROM dr WHERE k <= 2 GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT arm, round(any_value(observed), 6) AS observed, round(avg(null_mean), 6) AS null_mean, round(avg(CASE WHEN null_mean >= observed THEN 1.0 ELSE 0.0 END), 6) AS p FROM nl JOIN ob USING (arm) GROUP BY arm""")
def permutation_null(spark, d):
    """Baskets of the nodes of most triangle mass against random baskets, in the last ten rows of the window and in the ten after it."""
    m, ends = weekly_windows(spark, d)
    ret = weekly_returns(spark, d)
    inside = m.join(ends.select("win", "end"), "win").where("pos >= end - 10").groupBy("win", "node").agg(F.sum("ret").alias("outcome"))
    after = windows.ahead(m, ends, ret, 10).withColumnRenamed("ahead", "outcome")
    top = portfolio.top_k(network.node_triangles(once(network.correlations(m))).withColumn("tri", F.round("tri", 9)), "tri", 2, ["win"]).select("win", "node", F.lit(True).alias("chosen"))
    number = ret.select("node").distinct().select("node", (F.row_number().over(Window.orderBy("node")) - 1).alias("number"))  # a row for each node
    both = inside.withColumn("arm", F.lit("inside")).unionByName(after.withColumn("arm", F.lit("ahead")))
    s = both.join(top, ["win", "node"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False))).join(number, "node")
    out = inference.permutation_null(s, "outcome", "chosen", 200, 2, ["arm"])
    return out.select("arm", *[r(c).alias(c) for c in ("observed", "null_mean", "p")])

"""Registered queries: weighted statistics, resampled means, weights, scenarios' tails and quarterly joins."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from weftline.catalog import query
from weftline.operators import credit, draws, filters, inference, metrics, network, panel, portfolio, risk, scoring, synth, windows
from weftline.sources.readers import parquet
from weftline.sources.shared import once

from . import spectra
from .base import FACTORS, NETWORK, RETURNS, SCORED, SPANS, index_series, r, scored, weekly_returns, weekly_windows
from .filings import CREDIT, credit_panel


@query(f"""WITH {RETURNS}, p AS (SELECT node, pos, ret FROM rets JOIN axis USING (ts)),
w AS (SELECT e AS pos FROM (SELECT unnest(range(60, (SELECT n FROM n), 20)) AS e)),
s AS (SELECT w.pos, a.node AS i, b.node AS j, sum(k) AS k, sum(k * a.ret) AS x, sum(k * b.ret) AS y, sum(k * a.ret * b.ret) AS xy, sum(k * a.ret * a.ret) AS xx, sum(k * b.ret * b.ret) AS yy
 FROM w JOIN p a ON a.pos > w.pos - 60 AND a.pos <= w.pos JOIN p b ON b.pos = a.pos AND a.node < b.node, LATERAL (SELECT pow(CAST(0.97 AS DOUBLE), w.pos - a.pos) AS k) GROUP BY 1, 2, 3)
SELECT pos, i, j, round((xy / k - x * y / k / k) / sqrt((xx / k - x * x / k / k) * (yy / k - y * y / k / k)), 6) AS rho FROM s""")
def ewma_correlation(spark, d):
    """Correlations of the last 60 rows weighted by .97 to the power of age, at every twentieth row."""
    ret = once(weekly_returns(spark, d))
    a = panel.axis(ret)
    p = ret.join(a, "ts").select("pos", "node", "ret")
    n = a.count()
    at = p.withColumn("end", F.explode(F.filter(F.sequence(F.lit(60), F.lit(max(60, n - 1)), F.lit(20)), lambda e: (e >= F.col("pos")) & (e < F.col("pos") + 60) & (e < n))))
    k = F.pow(F.lit(0.97), (F.col("end") - F.col("pos")).cast("double"))
    x, y = at.select("end", "pos", F.col("node").alias("i"), F.col("ret").alias("x")), at.select("end", "pos", F.col("node").alias("j"), F.col("ret").alias("y"))
    s = x.join(y, ["end", "pos"]).where("i < j").withColumn("k", k).groupBy("end", "i", "j").agg(*[F.sum(e).alias(c) for c, e in (("k", F.col("k")), ("x", F.col("k") * F.col("x")), ("y", F.col("k") * F.col("y")), ("xy", F.col("k") * F.col("x") * F.col("y")), ("xx", F.col("k") * F.col("x") ** 2), ("yy", F.col("k") * F.col("y") ** 2))])
    m = {c: F.col(c) / F.col("k") for c in ("x", "y", "xy", "xx", "yy")}
    rho = (m["xy"] - m["x"] * m["y"]) / F.sqrt((m["xx"] - m["x"] ** 2) * (m["yy"] - m["y"] ** 2))
    return s.select(F.col("end").cast("long").alias("pos"), "i", "j", r(rho).alias("rho"))


@query(f"""WITH {FACTORS}, s AS (SELECT list(round(gapless, 9) ORDER BY win) AS l FROM idx), g AS (SELECT CAST(0.02 AS DOUBLE) + CAST(0.04 AS DOUBLE) * i AS alpha FROM range(13) t(i)),
m AS (SELECT alpha, unnest(list_transform(range(1, len(l) + 1), lambda k: list_reduce(l[1:k], lambda m, x: alpha * x + (1 - alpha) * m))) AS a, unnest(list_transform(range(1, len(l) + 1), lambda k: list_reduce(l[1:k], lambda m, x: CASE WHEN x > m THEN CAST(0.6 AS DOUBLE) * x + (1 - CAST(0.6 AS DOUBLE)) * m ELSE CAST(0.08 AS DOUBLE) * x + (1 - CAST(0.08 AS DOUBLE)) * m END))) AS b FROM s, g)
SELECT round(alpha, 6) AS alpha, round(avg(abs(a - b)), 6) AS error, rank() OVER (ORDER BY round(avg(abs(a - b)), 6)) = 1 AS best FROM m GROUP BY alpha""")
def ema_alpha_fit(spark, d):
    """The symmetric filter closest to the asymmetric one, over a grid of strengths (W8, T10); a series of its own for each grid point."""
    f = once(index_series(spark, d).select(F.lit(1).alias("g"), "win", F.round("gapless", 9).alias("x")))
    target = filters.smooth(f, "x", ["g"], "win", name="target").select("win", "target")
    grid = spark.createDataFrame([(0.02 + 0.04 * i,) for i in range(13)], "alpha double")
    fitted = filters.smooth(f.select("win", "x").crossJoin(F.broadcast(grid)), "x", ["alpha"], "win", rates=("alpha", "alpha"))  # 13 rows
    gap = fitted.join(target, "win").groupBy("alpha").agg(r(F.avg(F.abs(F.col("memory") - F.col("target")))).alias("error"))
    return gap.select(r("alpha").alias("alpha"), "error", (F.rank().over(Window.orderBy("error")) == 1).alias("best"))


def bootstrap_sql(name: str, block: int, blocks: str) -> str:
    return f"""(WITH s0 AS (SELECT rep, blk, rep * ({blocks}) + blk AS x0, n FROM (SELECT unnest(range(300)) AS rep), nn, unnest(range((SELECT {blocks} FROM nn))) t(blk)),
s2 AS (SELECT rep, blk, n, (((x0 * 1103515245 + 12345) % 2147483648 * 1103515245 + 12345) % 2147483648) // 1024 % greatest(1, n - {block}) AS st FROM s0),
m AS (SELECT rep, avg(x) AS m, avg(y) / stddev_pop(y) - avg(x) / stddev_pop(x) AS ratio FROM (SELECT rep, st + o AS src FROM s2, unnest(range({block})) u(o) WHERE blk * {block} + o < n) JOIN v ON src = pos GROUP BY rep)
SELECT '{name}' AS variant, round(quantile_cont(m, 0.025), 6) AS lo, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.975), 6) AS hi, round(quantile_cont(ratio, 0.025), 6) AS ratio_lo, round(quantile_cont(ratio, 0.975), 6) AS ratio_hi, round(avg(CASE WHEN ratio > 0 THEN 1.0 ELSE 0.0 END), 6) AS above FROM m)"""


#: Variant: (block, whether the last block is cut to fill the sample).
VARIANTS = {"fill_8": (8, True), "whole_8": (8, False), "whole_20": (20, False)}


@query(f"""WITH {FACTORS}, v AS (SELECT row_number() OVER (ORDER BY win) - 1 AS pos, round(gapless, 9) AS x, round(mean_abs_corr, 9) AS y FROM idx), nn AS (SELECT count(*) AS n FROM v)
{" UNION ALL ".join("SELECT * FROM " + bootstrap_sql(k, b, f"n // {b} + {int(f)}") for k, (b, f) in VARIANTS.items())}""")
def bootstrap_mean_interval(spark, d):
    """Block bootstrap of a mean and of a difference of mean over deviation, by block and filling, and how often the difference is above 0."""
    w = Window.orderBy("win")
    v = once(index_series(spark, d).select((F.row_number().over(w) - 1).alias("pos"), F.round("gapless", 9).alias("x"), F.round("mean_abs_corr", 9).alias("y")))
    n, out = v.count(), None
    for name, (block, fill) in VARIANTS.items():
        ratio = F.avg("y") / F.stddev_pop("y") - F.avg("x") / F.stddev_pop("x")
        m = inference.block_starts(spark, n, 300, block, fill).join(v, F.col("src") == F.col("pos")).groupBy("rep").agg(F.avg("x").alias("m"), ratio.alias("ratio"))
        row = m.agg(r(F.percentile("m", 0.025)).alias("lo"), r(F.avg("m")).alias("mean"), r(F.percentile("m", 0.975)).alias("hi"), r(F.percentile("ratio", 0.025)).alias("ratio_lo"), r(F.percentile("ratio", 0.975)).alias("ratio_hi"), r(F.avg((F.col("ratio") > 0).cast("double"))).alias("above"))
        row = row.select(F.lit(name).alias("variant"), *row.columns)
        out = row if out is None else out.union(row)
    return out


@query(f"""WITH {FACTORS}, k AS (SELECT win, gapless, row_number() OVER (ORDER BY win) - 20 AS k, count(*) OVER () - 20 AS n FROM idx)
SELECT CASE WHEN k <= n / 2 THEN 'early' ELSE 'late' END AS half, count(*) AS windows, round(avg(gapless), 6) AS mean FROM k WHERE k > 0 GROUP BY 1""")
def burn_in_halves(spark, d):
    """Windows after a burn-in of twenty, in two halves."""
    return windows.halves(index_series(spark, d), 20).groupBy("half").agg(F.count(F.lit(1)).alias("windows"), r(F.avg("gapless")).alias("mean"))


@query(f"WITH {SCORED} SELECT metric, list, win, round(CASE metric WHEN 'clustering' THEN -x ELSE x END, 9) AS oriented FROM scored")
def oriented_signals(spark, d):
    """Signals turned towards stress by a fixed table of signs."""
    sign = spark.createDataFrame([("gapless", 1), ("mean_abs_corr", 1), ("clustering", -1)], "metric string, sign int")
    return scored(spark, d).join(F.broadcast(sign), "metric").select("metric", "list", "win", F.round(F.col("sign") * F.col("x"), 9).alias("oriented"))


@query(f"""WITH {RETURNS}, v AS (SELECT node, round(stddev_samp(ret), 9) AS sd, round(avg(ret), 9) AS mean FROM rets GROUP BY node), k AS (SELECT node, row_number() OVER (ORDER BY sd DESC, node) AS kv, row_number() OVER (ORDER BY mean DESC, node) AS km, count(*) OVER () AS n FROM v)
SELECT 'equal' AS kind, node, round(1 / n, 6) AS weight FROM k UNION ALL SELECT 'top_2_volatility', node, 0.5 FROM k WHERE kv <= 2 UNION ALL SELECT 'top_3_mean', node, round(1 / 3, 6) FROM k WHERE km <= 3 UNION ALL SELECT 'long_short', node, CASE WHEN kv <= n / 2 THEN round(2 / n, 6) ELSE round(-2 / n, 6) END FROM k""")
def weight_kinds(spark, d):
    """Portfolio weights by kind: all, the most volatile, those of the highest mean, long one half and short the other."""
    v = weekly_returns(spark, d).groupBy("node").agg(F.round(F.stddev_samp("ret"), 9).alias("sd"), F.round(F.avg("ret"), 9).alias("mean"))
    kinds = {"equal": portfolio.top_weights(v, "sd", None), "top_2_volatility": portfolio.top_weights(v, "sd", 2), "top_3_mean": portfolio.top_weights(v, "mean", 3), "long_short": portfolio.long_short(v, "sd")}
    out = None
    for name, w in kinds.items():
        row = w.select(F.lit(name).alias("kind"), "node", r("weight").alias("weight"))
        out = row if out is None else out.union(row)
    return out


@query()
def scenario_coverage(spark, d):
    """Coverage of the middle 95 and 50 % of scenarios, and the outcomes' distance from uniform among them."""
    from .panels import factor_scenarios

    p = once(factor_scenarios(spark, d)).withColumn("one", F.lit(1))
    ks = inference.uniform_distance(p, "pit", ["one"])
    within = lambda a, b: F.avg(F.col("realised").between(F.col(a), F.col(b)).cast("double"))
    cover = p.groupBy("one").agg(within("lo", "hi").alias("coverage95"), within("low", "high").alias("coverage50"), F.avg("pit").alias("mean_pit"))
    return ks.join(cover, "one").drop("one")


def equal_states(spark, d):
    """Factor states of all windows, and the variance that each gives an equal-weight portfolio."""
    ret = once(weekly_returns(spark, d))
    nodes = sorted(x["node"] for x in ret.select("node").distinct().collect())  # a matrix's columns
    a = panel.axis(ret)
    states = once(risk.factor_states(windows.members(ret, a, 20, 3)))
    return states, risk.scenario_variance(states, [1 / len(nodes)] * len(nodes)), nodes


@query()
def scenario_losses(spark, d):
    """The last window's scenarios: quantiles and how likely losses are."""
    drawn = once(risk.scenario_draws(equal_states(spark, d)[1]))
    last = drawn.agg(F.max("win").alias("win"))
    return risk.loss_probabilities(drawn.join(F.broadcast(last), "win"), [-0.05, -0.1])  # one row


@query()
def tail_attribution(spark, d):
    """Triangle mass by node of what the factors correlate, in the thirty states whose factors carry most."""
    states, _, nodes = equal_states(spark, d)
    t = network.node_triangles(once(risk.concentrated_states(states, nodes, 30)))
    return t.groupBy("node").agg(F.sum("tri").alias("mass"), F.count(F.lit(1)).alias("windows"))


def diffusing_sql(kind: str, widening: str) -> str:
    number = lambda j: f"(sim * 1000 + pos) * 11 + {j} + 500000000"
    level = "CASE WHEN pos < 50 THEN 0.0 WHEN pos <= 90 THEN 3.0 ELSE 3.0 * exp(-(pos - 90) / 40.0::DOUBLE) END"
    sigma = f"CASE WHEN {widening} AND pos > 90 THEN CAST(0.3 AS DOUBLE) + CAST(0.04 AS DOUBLE) * (pos - 90) ELSE CAST(0.3 AS DOUBLE) END"
    cells = f"SELECT sim, pos, printf('n%02d', i) AS node, CAST(0.85 AS DOUBLE) * ({level} + CAST(0.3 AS DOUBLE) * {draws.sql_normal(number(10))}) + {sigma} * {draws.sql_normal(number('i'))} AS ret FROM range(6) s(sim), range(260) p(pos), range(10) q(i)"
    mem = "mem AS (SELECT CAST(sim * 1000 + t AS INTEGER) AS win, pos, node, ret FROM x, range(20, 260, 2) u(t) WHERE pos >= t - 20 AND pos < t)"
    mass = "w AS (SELECT win % 1000 AS t, 6 * sum(w) / 1000.0 AS m FROM tri GROUP BY win), v AS (SELECT t, avg(m) AS m FROM w GROUP BY t)"
    return f"(WITH x AS ({cells}), {mem}, {NETWORK}, {mass} SELECT '{kind}' AS kind, round(max(m), 6) AS peak, round(avg(m) FILTER (t > 150), 6) AS late, round(avg(m) FILTER (t > 150) / max(m), 6) AS retention FROM v)"


KINDS = {"epicentre": (lambda i: F.lit(True), "true"), "follower": (lambda i: F.lit(False), "false"), "mixed": (lambda i: i < 5, "i < 5")}


@query(" UNION ALL ".join(diffusing_sql(k, sql) for k, (_, sql) in KINDS.items()))
def retention_after_shock(spark, d):
    """How much triangle mass is left late after a shock, by kind of synthetic network; the mixed one is put together from half of each."""
    out = None
    for kind, (widening, _) in KINDS.items():
        s = synth.diffusing(spark, 6, widening(F.col("i")))
        a = s.withColumn("step", F.explode(F.sequence(F.lit(20), F.lit(258), F.lit(2)))).where((F.col("pos") >= F.col("step") - 20) & (F.col("pos") < F.col("step")))
        f = metrics.factors(a.withColumn("win", (F.col("sim") * 1000 + F.col("step")).cast("int")))
        f = f.select(F.lit(kind).alias("kind"), (F.col("win") % 1000).alias("t"), "tr_a3_n3").groupBy("kind", "t").agg(F.avg("tr_a3_n3").alias("mass"))
        out = f if out is None else out.union(f)
    return synth.retention(out, "mass", ["kind"]).select("kind", *[r(c).alias(c) for c in ("peak", "late", "retention")])


@query("""WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, sum(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), c AS (SELECT o_custkey AS k, sum(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT k, round(coalesce(a.value, 0) + coalesce(b.value, 0) + coalesce(c.value, 0), 2) AS debt FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)""")
def total_debt(spark, d):
    """Components joined in full with absent ones as 0."""
    o = parquet(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus", "o_totalprice")
    parts = [o.where(F.col("o_orderstatus") == s).groupBy("k").agg(F.sum("o_totalprice").alias("value")) for s in ("F", "O", "P")]
    return credit.total_debt(parts, ["k"]).select("k", r("debt", 2).alias("debt"))


@query(f"""WITH {CREDIT}, w AS (SELECT company, qi, declared, lag(declared, 12) OVER (PARTITION BY company ORDER BY qi) AS old FROM g), v AS (SELECT company, qi, round(declared - old, 2) AS change FROM w WHERE declared > 0 AND old > 0)
SELECT company, CAST(qi AS INTEGER) AS qi, round((rank() OVER (PARTITION BY company ORDER BY change) + (count(*) OVER (PARTITION BY company, change) - 1) / 2.0) / count(*) OVER (PARTITION BY company), 6) AS pct FROM v""")
def real_window_rank(spark, d):
    """Ranks over quarters whose value, and that of twelve quarters before, are real."""
    p = credit_panel(spark, d)
    old = F.lag("declared", 12).over(Window.partitionBy("company").orderBy("qi"))
    v = p.withColumn("old", old).where((F.col("declared") > 0) & (F.col("old") > 0)).withColumn("change", F.round(F.col("declared") - F.col("old"), 2))
    return credit.percentile_rank(v, "change", ["company"]).select("company", "qi", r("pct").alias("pct"))


@query(f"""WITH {FACTORS}, a AS (SELECT end_ts AS d1, gapless FROM idx), b AS (SELECT end_ts AS d2, clustering FROM idx WHERE win % 2 = 0), c AS (SELECT end_ts AS d3, CASE WHEN win % 3 <> 0 THEN density END AS density FROM idx)
SELECT d1 AS day, round(gapless, 6) AS gapless, round(clustering, 6) AS clustering, round(density, 6) AS density FROM a JOIN b ON d1 = d2 JOIN c ON d1 = d3 WHERE density IS NOT NULL ORDER BY d1 DESC LIMIT 10""")
def three_way_recent(spark, d):
    """Series with different keys joined on dates, complete rows only, the ten most recent."""
    m, ends = weekly_windows(spark, d)
    f = once(network.factors(once(network.correlations(m))).join(ends, "win"))
    a = f.select(F.col("end_ts").alias("d1"), "gapless")
    b = f.where("win % 2 = 0").select(F.col("end_ts").alias("d2"), "clustering")
    c = f.select(F.col("end_ts").alias("d3"), F.when(F.col("win") % 3 != 0, F.col("density")).alias("density"))
    j = a.join(b, F.col("d1") == F.col("d2")).join(c, F.col("d1") == F.col("d3")).dropna()
    return j.orderBy(F.col("d1").desc()).limit(10).select(F.col("d1").alias("day"), r("gapless").alias("gapless"), r("clustering").alias("clustering"), r("density").alias("density"))


RIVALS = ["omega", "absorption", "erank", "balance"]


@query(f"""WITH {spectra.INDICES}, {SPANS}, lg AS ({" UNION ALL ".join(f"SELECT '{n}' AS metric, win, round({metrics.METRICS[n][1]} * {n}, 7) AS raw FROM indices" for n in RIVALS)}),
sr AS (SELECT metric, list(raw ORDER BY win) AS l, list(win ORDER BY win) AS w FROM lg GROUP BY 1),
sm AS (SELECT metric, unnest(w) AS win, unnest(l) AS raw, unnest(list_transform(range(1, len(l) + 1), lambda k: list_reduce(l[1:k], lambda m, x: CASE WHEN x > m THEN CAST(0.6 AS DOUBLE) * x + (1 - CAST(0.6 AS DOUBLE)) * m ELSE CAST(0.08 AS DOUBLE) * x + (1 - CAST(0.08 AS DOUBLE)) * m END))) AS memory FROM sr),
lo AS (SELECT metric, 'raw' AS mode, win, raw AS x FROM sm UNION ALL SELECT metric, 'memory', win, round(memory, 7) FROM sm),
sc AS (SELECT metric, mode, list, l.win, x, bool_or(end_ts BETWEEN s.a AND s.b) AS crisis FROM lo l JOIN hops USING (win) CROSS JOIN spans s GROUP BY ALL),
al AS (SELECT *, x >= quantile_cont(x, 0.9) OVER (PARTITION BY metric, mode, list) AS alarm FROM sc),
ct AS (SELECT metric, mode, list, count(*) FILTER (alarm AND crisis) AS tp, count(*) FILTER (alarm AND NOT crisis) AS fp, count(*) FILTER (NOT alarm AND crisis) AS fn FROM al GROUP BY 1, 2, 3)
SELECT metric, mode, list, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM ct""")
def rival_verdicts(spark, d):
    """Each metric of the registry against the composite index: F1 at the alarm budget, raw and filtered, by label list (3.2)."""
    m, ends = weekly_windows(spark, d)
    wide = once(metrics.window_metrics(m, RIVALS))
    long = wide.unpivot(["win"], RIVALS, "metric", "raw")
    sign = spark.createDataFrame([(n, metrics.METRICS[n][1]) for n in RIVALS], "metric string, sign int")
    long = long.join(F.broadcast(sign), "metric").withColumn("raw", F.round(F.col("sign") * F.col("raw"), 7))
    both = filters.smooth(long, "raw", ["metric"], "win").withColumn("memory", F.round("memory", 7)).join(ends.select("win", "end_ts"), "win")
    s = scoring.labelled(both.unpivot(["metric", "win", "end_ts"], ["raw", "memory"], "mode", "x"), scoring.intervals(spark), "end_ts")
    by = ["metric", "mode", "list"]
    return scoring.confusion(scoring.thresholded(s, "x", by), by).select(*by, *[r(c).alias(c) for c in ("precision", "recall", "f1")])

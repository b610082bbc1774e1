"""Registered queries: kernels, attribution, portfolios, risk, synthetic truth and replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from weftline.catalog import query
from weftline.operators import draws, filters, metrics, network, panel, portfolio, risk, synth, windows
from weftline.sources.readers import parquet
from weftline.sources.shared import once
from weftline.streaming import streams

from . import spectra
from .base import EDGES, FACTORS, NETWORK, RETURNS, STEP, WIDTH, hourly, r, weekly_returns, weekly_windows


@query("WITH " + spectra.INDICES + " SELECT win, " + ", ".join(f"round({c}, 5) AS {c}" for c in spectra.NAMES) + " FROM indices")
def omega_metrics(spark, d):
    """The composite index and its variants and rivals, one matrix for each window (N5-N12, N20). SQL finds eigenvalues from traces."""
    m = metrics.window_metrics(weekly_windows(spark, d)[0], spectra.NAMES)
    return m.select("win", *[r(c, 5).alias(c) for c in spectra.NAMES])


@query()
def curvature_metrics(spark, d):
    """Ollivier-Ricci curvature and the length of persistent loops of each window's network."""
    return metrics.window_metrics(weekly_windows(spark, d)[0], ["curvature", "curvature_weighted", "loops"])


@query()
def takens_loops(spark, d):
    """Persistent loops of the delay vectors of each node's returns (N19, W16), 30 dates a cloud."""
    ret = weekly_returns(spark, d)
    v = windows.delay_vectors(ret, "ret", 3, 2, ["node"]).join(panel.axis(ret), "ts")
    cloud = v.withColumn("key", F.concat_ws(":", "node", F.floor(F.col("pos") / 30)))
    return metrics.persistence(cloud, "key", "vector").where("dim = 1").groupBy("key").agg(F.count(F.lit(1)).alias("loops"), F.sum(F.col("death") - F.col("birth")).alias("length"))


@query("WITH " + spectra.NODE_BALANCE + " SELECT win, node, round(local_balance, 6) AS local_balance, round(balance_gap, 6) AS balance_gap FROM nb")
def node_balance(spark, d):
    """Balance at each node and its gap to the window's."""
    s = metrics.node_scores(weekly_windows(spark, d)[0], ())
    return s.select("win", "node", r("local_balance").alias("local_balance"), r("balance_gap").alias("balance_gap"))


@query()
def spectral_hit_rates(spark, d):
    """Share of true epicentres found by spectral attribution, by the rule of how many factors count (a number, the true number, above the edge or above 1), and the median number."""
    out = None
    for k in (1, 2, 3):
        s = once(synth.epicentres(spark, 120, k, rows=(120, 160)).withColumnRenamed("sim", "win"))
        truth = s.select("win", "node", "truth").distinct()
        rules = {"first": 1, "second": 2, "oracle": k, "edge": "edge", "kaiser": "kaiser"}
        sc = once(metrics.node_scores(s, tuple(dict.fromkeys(rules.values()))).join(truth, ["win", "node"]))
        for name, rule in rules.items():
            count = sc.agg(F.percentile(F.lit(rule) if isinstance(rule, int) else F.col(f"count_{rule}"), 0.5).alias("median_factors"))
            row = synth.hit_rate(sc, f"spectral_{rule}", synth.GROUP * k, ["win"]).join(count).select(F.lit(k).alias("k"), F.lit(name).alias("rule"), "hit_rate", "median_factors")  # one row each
            out = row if out is None else out.union(row)
    return out


@query(f"""WITH {RETURNS}, z AS (SELECT pos, node, ret / stddev_samp(ret) OVER (PARTITION BY node) AS z FROM rets JOIN axis USING (ts)), g(a, b) AS (VALUES (CAST(0.02 AS DOUBLE), CAST(0.95 AS DOUBLE)), (0.05, 0.9)),
w AS (SELECT unnest(range(20, (SELECT n FROM n), 20)) AS "end"), zz AS (SELECT x.pos, x.node AS i, y.node AS j, x.z * y.z AS p FROM z x JOIN z y ON x.pos = y.pos AND x.node <= y.node), t AS (SELECT i, j, avg(p) AS s FROM zz GROUP BY 1, 2),
q AS (SELECT a, b, "end", i, j, pow(b, "end") * s + sum(pow(b, "end" - 1 - pos) * ((1 - a - b) * s + a * p)) AS q FROM w JOIN zz ON pos < "end" JOIN t USING (i, j), g GROUP BY a, b, "end", i, j, s)
SELECT x.a, x.b, CAST(x."end" AS INTEGER) AS pos, x.i, x.j, round(x.q / sqrt(y.q * z.q), 6) AS rho FROM q x JOIN q y ON y.a = x.a AND y."end" = x."end" AND y.i = x.i AND y.j = x.i JOIN q z ON z.a = x.a AND z."end" = x."end" AND z.i = x.j AND z.j = x.j WHERE x.i < x.j""")
def dynamic_correlation(spark, d):
    """DCC(1,1) on standardised returns at every twentieth row, on a small parameter grid."""
    ret = once(weekly_returns(spark, d))
    a = panel.axis(ret)
    z = ret.join(a, "ts").withColumn("ret", F.col("ret") / F.stddev_samp("ret").over(Window.partitionBy("node")))
    grid = spark.createDataFrame([(0.02, 0.95), (0.05, 0.9)], "a double, b double")
    return filters.dynamic_correlation(z, grid, list(range(20, a.count(), 20))).withColumn("rho", r("rho"))


BASKET = EDGES + """,
top AS (SELECT win, node FROM (SELECT win, node, row_number() OVER (PARTITION BY win ORDER BY round(tri, 9), node) AS k FROM node_tri) WHERE k <= 2),
seg AS (SELECT win, "end", lead("end") OVER (ORDER BY "end") AS nx FROM hops)"""


def low_triangle_weights(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Equal weights on the two nodes of least triangle mass, the returns by position and the windows; each made once."""
    ret = once(weekly_returns(spark, d))
    a = panel.axis(ret)
    e = once(network.correlations(windows.members(ret, a, WIDTH, STEP)))
    scores = network.node_triangles(e).withColumn("tri", F.round("tri", 9))
    basket = portfolio.equal_weights(portfolio.top_k(scores, "tri", 2, ["win"], largest=False), ["win"])
    ends = windows.hops(a, WIDTH, STEP)
    return once(basket.join(ends, "win").withColumn("rule", F.lit("low"))), ret.join(a, "ts").select("pos", "node", "ret"), ends


@query(f"WITH {BASKET} SELECT win, node FROM top")
def topk_basket(spark, d):
    return low_triangle_weights(spark, d)[0].select("win", "node")


@query(f"""WITH {EDGES}, sz AS (SELECT win, count(*) FILTER (tri > m) AS k FROM (SELECT win, round(tri, 9) AS tri, round(avg(tri) OVER (PARTITION BY win), 9) AS m FROM node_tri) GROUP BY win)
SELECT win, node, place FROM (SELECT n.win, node, k, row_number() OVER (PARTITION BY n.win ORDER BY round(tri, 9) DESC, node) AS place FROM node_tri n JOIN sz USING (win)) WHERE place <= k""")
def variable_k_basket(spark, d):
    """Basket sizes set by a rule for each window: the nodes above the window's mean (K2)."""
    n = network.node_triangles(once(network.correlations(weekly_windows(spark, d)[0])))
    n = n.withColumn("m", F.round(F.avg("tri").over(Window.partitionBy("win")), 9)).withColumn("tri", F.round("tri", 9))
    n = n.withColumn("k", F.count_if(F.col("tri") > F.col("m")).over(Window.partitionBy("win")))
    return portfolio.top_k(n, "tri", F.col("k"), ["win"]).select("win", "node", "place")


@query(f"""WITH {BASKET}, o AS (SELECT s.win, r.node, sum(ret) AS ahead FROM seg s JOIN axis a ON a.pos >= s."end" AND a.pos < s.nx JOIN rets r USING (ts) GROUP BY 1, 2)
SELECT o.win, round(avg(ahead) FILTER (t.node IS NOT NULL), 6) AS basket, round(avg(ahead), 6) AS market, round(avg(ahead) FILTER (t.node IS NOT NULL) - avg(ahead), 6) AS excess FROM o LEFT JOIN top t ON t.win = o.win AND t.node = o.node GROUP BY 1""")
def basket_excess(spark, d):
    w, ret, ends = low_triangle_weights(spark, d)
    seg = ends.withColumn("nx", F.lead("end").over(Window.orderBy("end"))).where(F.col("nx").isNotNull()).withColumn("pos", F.explode(F.sequence("end", F.col("nx") - 1)))
    ahead = seg.join(ret, "pos").groupBy("win", "node").agg(F.sum("ret").alias("ahead"))
    return portfolio.excess(ahead.join(w.select("win", "node"), ["win", "node"]), ahead, "ahead", ["win"]).select("win", *[r(c).alias(c) for c in ("basket", "market", "excess")])


@query(f"""WITH {BASKET}, wt AS (SELECT win, node, 0.5 AS weight FROM top), pr AS (SELECT coalesce(a.win, b.win + 1) AS win, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS t FROM wt a FULL JOIN wt b ON a.win = b.win + 1 AND a.node = b.node GROUP BY 1)
SELECT win, round(CASE WHEN win = 0 THEN 1.0 ELSE CAST(t AS DOUBLE) END, 6) AS turnover FROM pr WHERE win IN (SELECT win FROM top)""")
def basket_turnover(spark, d):
    return portfolio.turnover(low_triangle_weights(spark, d)[0], ["rule"], "win").select("win", r("turnover").alias("turnover"))


@query(f"""WITH {BASKET}, wt AS (SELECT win, node, 0.5 AS weight FROM top), pr AS (SELECT coalesce(a.win, b.win + 1) AS win, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS t FROM wt a FULL JOIN wt b ON a.win = b.win + 1 AND a.node = b.node GROUP BY 1),
tv AS (SELECT win, CASE WHEN win = 0 THEN 1.0 ELSE CAST(t AS DOUBLE) END AS t FROM pr),
dy AS (SELECT s.win, s."end", a.pos, sum(CAST(0.5 AS DOUBLE) * (exp(ret) - 1)) AS g FROM seg s JOIN axis a ON a.pos >= s."end" AND a.pos < s.nx JOIN rets r USING (ts) JOIN top t ON t.win = s.win AND t.node = r.node GROUP BY 1, 2, 3),
rr AS (SELECT pos, ln(1 + g) + CASE WHEN pos = "end" THEN ln(1 - CAST(0.001 AS DOUBLE) * t) ELSE 0 END AS ret FROM dy JOIN tv USING (win)),
e AS (SELECT pos, ret, sum(ret) OVER (ORDER BY pos) AS equity FROM rr)
SELECT pos, round(ret, 6) AS ret, round(equity, 6) AS equity, round(exp(equity - max(equity) OVER (ORDER BY pos)) - 1, 6) AS drawdown FROM e""")
def walk_forward_equity(spark, d):
    w, ret, _ = low_triangle_weights(spark, d)
    t = portfolio.turnover(w, ["rule"], "win")
    return portfolio.walk_forward(w, ret, t, ["rule"]).select(F.col("pos").cast("long").alias("pos"), *[r(c).alias(c) for c in ("ret", "equity", "drawdown")])


def equity_sql(weights: str) -> str:
    """Equity paths ``eq (rule, pos, ret, equity)`` of ``wt (rule, win, node, weight)`` held over the segments ``seg``."""
    return f"""{weights},
now AS (SELECT rule, win, node, weight, dense_rank() OVER (PARTITION BY rule ORDER BY win) AS k FROM wt),
both_steps AS (SELECT rule, k, node, weight AS x, 0.0 AS y FROM now UNION ALL SELECT rule, k + 1, node, 0.0, weight FROM now),
chg AS (SELECT rule, k, sum(abs(x - y)) AS t FROM (SELECT rule, k, node, sum(x) AS x, sum(y) AS y FROM both_steps GROUP BY 1, 2, 3) GROUP BY 1, 2),
tv AS (SELECT DISTINCT now.rule, now.win, CASE WHEN now.k = 1 THEN 1.0 ELSE t END AS t FROM now JOIN chg ON chg.rule = now.rule AND chg.k = now.k),
sg AS (SELECT rule, win, h."end", lead(h."end") OVER (PARTITION BY rule ORDER BY h."end") AS nx FROM (SELECT DISTINCT rule, win FROM wt) JOIN hops h USING (win)),
dy AS (SELECT s.rule, s.win, s."end", a.pos, sum(w.weight * (exp(ret) - 1)) AS g FROM sg s JOIN axis a ON a.pos >= s."end" AND a.pos < s.nx JOIN rets r USING (ts) JOIN wt w ON w.rule = s.rule AND w.win = s.win AND w.node = r.node GROUP BY 1, 2, 3, 4),
rr AS (SELECT rule, pos, ln(1 + g) + CASE WHEN pos = "end" THEN ln(1 - CAST(0.001 AS DOUBLE) * t) ELSE 0 END AS ret FROM dy JOIN tv USING (rule, win)),
eq AS (SELECT rule, pos, ret, sum(ret) OVER (PARTITION BY rule ORDER BY pos) AS equity FROM rr)"""


LOW_AND_EQUAL = f"""{BASKET}, nn AS (SELECT count(DISTINCT node) AS m FROM rets),
wt AS (SELECT 'low' AS rule, win, node, CAST(0.5 AS DOUBLE) AS weight FROM top UNION ALL SELECT 'equal', win, node, CAST(1 AS DOUBLE) / m FROM hops, (SELECT DISTINCT node FROM rets), nn)"""


@query(f"""WITH {equity_sql(LOW_AND_EQUAL)}, st AS (SELECT rule, pos, lead(equity, 51) OVER w - equity + ret AS value FROM eq WINDOW w AS (PARTITION BY rule ORDER BY pos)),
v AS (SELECT s.rule, s.value, b.value AS base FROM st s JOIN st b ON b.pos = s.pos AND b.rule = 'equal' WHERE s.value IS NOT NULL AND b.value IS NOT NULL)
SELECT rule, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(avg(CASE WHEN value > base THEN 1.0 ELSE 0.0 END), 6) AS beats FROM v GROUP BY rule""")
def start_date_distribution(spark, d):
    """Two rules held from many start dates: distribution of values and share that beats one over n."""
    w, ret, ends = low_triangle_weights(spark, d)
    equal = portfolio.equal_weights(ret.select("node").distinct().crossJoin(ends.select("win", "end")), ["win"]).withColumn("rule", F.lit("equal"))  # nodes by windows
    both = once(w.select("rule", "win", "end", "node", "weight").unionByName(equal.select("rule", "win", "end", "node", "weight")))
    path = once(portfolio.walk_forward(both, ret, portfolio.turnover(both, ["rule"], "win"), ["rule"]))
    out = portfolio.distribution(portfolio.start_dates(path, ["rule"], 52), "rule", "equal")
    return out.select("rule", *[r(c).alias(c) for c in ("p10", "p50", "p90", "beats")])


#: Rule: (signal whose level opens the gate, score of a node, largest first).
RULES = {"balance_gap": ("balance", "balance_gap", True), "low": ("gapless", "tri", False), "inverted": ("gapless", "tri", True), "cross": ("balance", "tri", False), "worst": ("balance", "past", False)}


@query(f"""WITH {spectra.NODE_BALANCE}, {FACTORS.removeprefix(EDGES).lstrip(", ")}, sig AS (SELECT win, round(any_value(balance), 9) AS balance FROM nb GROUP BY win),
ins AS (SELECT win, node, sum(ret) AS past FROM mem WHERE pos >= "end" - 10 GROUP BY 1, 2), oos AS (SELECT h.win, q.node, sum(ret) AS ahead FROM hops h JOIN axis a ON a.pos >= h."end" AND a.pos < h."end" + 10 JOIN rets q USING (ts) GROUP BY 1, 2 HAVING count(*) = 10),
nd AS (SELECT nb.win, nb.node, round(balance_gap, 9) AS balance_gap, round(tri, 9) AS tri, round(past, 9) AS past, ahead, s.balance, round(gapless, 9) AS gapless FROM nb JOIN node_tri t USING (win, node) JOIN ins USING (win, node) JOIN oos USING (win, node) JOIN sig s USING (win) JOIN idx USING (win)),
wn AS (SELECT DISTINCT win, balance, gapless FROM nd), lv AS (SELECT a.win, quantile_cont(b.balance, 0.5) AS qb, quantile_cont(b.gapless, 0.5) AS qg FROM wn a JOIN wn b ON b.win <= a.win GROUP BY a.win HAVING count(*) >= 30),
ch AS ({" UNION ALL ".join(f"SELECT '{rule}' AS rule, win, node, ahead, row_number() OVER (PARTITION BY win ORDER BY {score} {'DESC' if largest else ''}, node) AS k FROM nd JOIN lv USING (win) WHERE {gate} >= {'qb' if gate == 'balance' else 'qg'}" for rule, (gate, score, largest) in RULES.items())}
 UNION ALL SELECT 'local', win, node, ahead, CASE WHEN balance_gap >= round(avg(balance_gap) OVER (PARTITION BY win), 9) THEN 1 ELSE 3 END FROM nd JOIN lv USING (win) WHERE balance >= qb)
SELECT rule, count(DISTINCT win) AS windows, round(avg(ahead) FILTER (k <= 2), 6) AS basket, round(avg(ahead), 6) AS market FROM ch GROUP BY rule""")
def basket_rules(spark, d):
    """Each rule's basket in the windows its trailing gate lets through, against all nodes, over the ten rows after the window: two nodes by score, or those that meet a condition of their own."""
    m, ends = weekly_windows(spark, d)
    e = once(network.correlations(m))
    ahead = windows.ahead(m, ends, weekly_returns(spark, d), 10)
    past = m.join(ends.select("win", "end"), "win").where("pos >= end - 10").groupBy("win", "node").agg(F.sum("ret").alias("past"))
    n = metrics.node_scores(m, ()).join(network.node_triangles(e), ["win", "node"]).join(past, ["win", "node"]).join(ahead, ["win", "node"]).join(network.factors(e).select("win", "gapless"), "win")
    n = n.withColumn("balance", F.col("local_balance") + F.col("balance_gap"))
    n = once(n.select("win", "node", "ahead", *[F.round(c, 9).alias(c) for c in ("balance_gap", "tri", "past", "balance", "gapless")]))
    level = n.select("win", "balance", "gapless").distinct().withColumn("one", F.lit(1))  # a row for each window
    for c in ("balance", "gapless"):
        level = filters.trailing_gate(level, c, 0.5, ["one"], "win").withColumnRenamed("gate", f"{c}_at")
    n = once(n.join(level.select("win", "balance_at", "gapless_at"), "win"))
    n = n.withColumn("mean_gap", F.round(F.avg("balance_gap").over(Window.partitionBy("win")), 9))
    out = None
    chosen = {rule: (F.col(gate) >= F.col(f"{gate}_at"), F.row_number().over(Window.partitionBy("win").orderBy(F.col(score).desc() if largest else F.col(score), "node")) <= 2) for rule, (gate, score, largest) in RULES.items()}
    chosen["local"] = (F.col("balance") >= F.col("balance_at"), portfolio.gate_and_condition(F.col("balance"), F.col("balance_gap"), F.col("balance_at"), F.col("mean_gap")))
    for rule, (open_, inside) in chosen.items():
        row = n.where(open_).withColumn("inside", inside).agg(F.countDistinct("win").alias("windows"), r(F.avg(F.when(F.col("inside"), F.col("ahead")))).alias("basket"), r(F.avg("ahead")).alias("market")).select(F.lit(rule).alias("rule"), "windows", "basket", "market")
        out = row if out is None else out.union(row)
    return out


@query(f"""WITH {FACTORS}, x AS (SELECT win, "end", round(gapless, 9) AS x FROM idx), c AS (SELECT a.win, a."end", a.x, avg(CASE WHEN b.x <= a.x THEN 1.0 ELSE 0.0 END) AS cdf FROM x a LEFT JOIN x b ON b.win < a.win GROUP BY 1, 2, 3),
c2 AS (SELECT win, "end", CASE WHEN win > (SELECT min(win) FROM x) THEN cdf END AS cdf, lead("end") OVER (ORDER BY "end") AS nx FROM c),
base AS (SELECT pos, avg(ret) AS ret FROM rets JOIN axis USING (ts) GROUP BY pos), vol AS (SELECT pos, ret, stddev_samp(ret) OVER (ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vol FROM base),
j AS (SELECT pos, ret, cdf, least(1.0, coalesce(CAST(0.05 AS DOUBLE) / nullif(vol, 0), 1.0)) AS v FROM c2 JOIN vol ON pos >= "end" AND pos < nx),
l AS (SELECT 'hold' AS rule, pos, ret FROM j UNION ALL SELECT 'vol_target', pos, v * ret FROM j UNION ALL SELECT 'stress', pos, coalesce(1 - cdf, 1) * ret FROM j UNION ALL SELECT 'inverse', pos, coalesce(cdf, 0) * ret FROM j),
e AS (SELECT *, sum(ret) OVER (PARTITION BY rule ORDER BY pos) AS e FROM l), dd AS (SELECT *, exp(e - max(e) OVER (PARTITION BY rule ORDER BY pos)) - 1 AS dd FROM e)
SELECT rule, round(avg(ret) * 52, 6) AS annual, round(stddev_pop(ret) * sqrt(52), 6) AS volatility, round(min(dd), 6) AS max_drawdown, round(avg(ret) * 52 / nullif(stddev_pop(ret) * sqrt(52), 0), 6) AS sharpe FROM dd GROUP BY rule""")
def exposure_rules(spark, d):
    """Exposure by rule, its path and performance."""
    m, ends = weekly_windows(spark, d)
    sig = once(network.factors(network.correlations(m)).join(ends, "win").select("win", "end", F.round("gapless", 9).alias("x"), F.lit(1).alias("one")))
    sig = filters.trailing_cdf(sig, "x", ["one"], "win")
    ret = weekly_returns(spark, d)
    base = ret.join(panel.axis(ret), "ts").groupBy("pos").agg(F.avg("ret").alias("ret"))
    vol = base.withColumn("vol", F.stddev_samp("ret").over(Window.orderBy("pos").rowsBetween(-20, -1)))  # a row for each date
    seg = sig.withColumn("nx", F.lead("end").over(Window.orderBy("end"))).where(F.col("nx").isNotNull()).withColumn("pos", F.explode(F.sequence("end", F.col("nx") - 1)))
    j = seg.join(vol, "pos")
    rules = portfolio.exposures(F.col("x"), F.col("cdf"), F.col("vol"), 0.05)
    long = j.select("pos", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), (c * F.col("ret")).alias("ret")) for k, c in rules.items()])).alias("e")).select("pos", "e.*")
    return portfolio.performance(long, "ret", ["rule"], 52.0).select("rule", *[r(c).alias(c) for c in ("annual", "volatility", "max_drawdown", "sharpe")])


def shrinkage(spark, d) -> DataFrame:
    ret = once(weekly_returns(spark, d))
    a = panel.axis(ret)
    m = windows.members(ret, a, 60, 30)
    ends = windows.hops(a, 60, 30)
    ahead = ends.withColumn("pos", F.explode(F.sequence("end", F.col("end") + 20))).join(ret.join(a, "ts"), "pos")
    return once(risk.shrinkage_grid(m, ahead, [0.2, 0.5, 0.8]))


@query()
def shrinkage_targets(spark, d):
    """Realised variance of minimum-variance portfolios by shrinkage target and strength."""
    return shrinkage(spark, d).groupBy("target", "alpha").agg(F.count(F.lit(1)).alias("windows"), F.sqrt(F.avg("variance")).alias("realised"))


@query()
def shrinkage_choice(spark, d):
    """The strength chosen on the first half of the windows and what it realises on the second, by target."""
    return risk.chosen_strengths(shrinkage(spark, d))


@query()
def factor_scenarios(spark, d):
    """Factor states, scenario variances and the place among scenarios of what came next: the mean of the nodes' next returns, each over its deviation in the window."""
    m, ends = weekly_windows(spark, d)
    v = risk.scenario_variance(risk.factor_states(m), [1 / 6] * 6)
    after = windows.ahead(m, ends, weekly_returns(spark, d), 1)
    sd = m.groupBy("win", "node").agg(F.stddev_samp("ret").alias("sd"))
    return risk.scenario_pit(once(v), once(after.join(sd, ["win", "node"]).groupBy("win").agg(F.avg(F.col("ahead") / F.col("sd")).alias("realised"))))


@query(f"WITH {EDGES} SELECT b.win, round(sqrt(avg((a.rho - b.rho) ^ 2)), 6) AS rmse FROM edges a JOIN edges b ON b.win = a.win + 7 AND a.i = b.i AND a.j = b.j GROUP BY b.win")
def forecast_error(spark, d):
    """Off-diagonal error of each window's correlations as a forecast of the window seven steps on, which shares no row."""
    e = once(network.correlations(weekly_windows(spark, d)[0]))
    return risk.off_diagonal_error(e.withColumn("win", F.col("win") + 7), e).select("win", r("rmse").alias("rmse"))


def epicentre_sql(k: int, frustrated: bool) -> str:
    """One query's rows for k groups."""
    number = lambda j: f"(sim * 1000 + pos) * {16 + k + 1} + {j}"
    sign = "CASE WHEN i % 3 % 2 = 1 THEN -1 ELSE 1 END" if frustrated else "1"
    strong = f"{sign} * CAST({synth.STRONG} AS DOUBLE) * {draws.sql_normal(number('16 + i // 3'))} + sqrt(1 - CAST({synth.STRONG} AS DOUBLE) ^ 2)"
    weak = f"CAST({synth.WEAK} AS DOUBLE) * {draws.sql_normal(number(16 + k))} + sqrt(1 - CAST({synth.WEAK} AS DOUBLE) ^ 2)"
    cells = f"c AS (SELECT sim, pos, i, {draws.sql_normal(number('i'))} AS own FROM range(120) s(sim), range(120, 160) p(pos), range(16) q(i))"
    x = f"mem AS (SELECT CAST(sim AS INTEGER) AS win, pos, printf('n%02d', i) AS node, i < {3 * k} AS truth, CASE WHEN i < {3 * k} THEN {strong} * own ELSE {weak} * own END AS ret FROM c)"
    scores = f"sc AS (SELECT d.win, d.node, t.tri, d.degree, m.truth FROM deg d JOIN node_tri t USING (win, node) JOIN (SELECT DISTINCT win, node, truth FROM mem) m USING (win, node))"
    part = lambda name, column: f"SELECT {k} AS k, {str(frustrated).lower()} AS frustrated, '{name}' AS score, round(avg(h), 6) AS hit_rate FROM (SELECT win, count(*) FILTER (truth) / {3 * k} AS h FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY round({column}, 9) DESC, node) AS place FROM sc) WHERE place <= {3 * k} GROUP BY win)"
    return f"(WITH {cells}, {x}, {NETWORK}, {scores} {part('triangles', 'tri')} UNION ALL {part('degree', 'degree')})"


CASES = [(1, False), (2, False), (3, False), (4, False), (2, True)]


@query(" UNION ALL ".join(epicentre_sql(*c) for c in CASES))
def epicentre_hit_rates(spark, d):
    """Share of true epicentres found by triangle mass and by degree in 120 synthetic networks of each kind."""
    out = None
    for k, frustrated in CASES:
        s = synth.epicentres(spark, 120, k, rows=(120, 160), frustrated=frustrated).withColumnRenamed("sim", "win")
        truth = (F.substring("node", 2, 2).cast("int") < synth.GROUP * k).alias("truth")
        sc = once(metrics.node_triangles(s).select("win", "node", truth, *[F.round(c, 9).alias(c) for c in ("tri", "degree")]))
        for name, column in (("triangles", "tri"), ("degree", "degree")):
            row = synth.hit_rate(sc, column, synth.GROUP * k, ["win"]).select(F.lit(k).alias("k"), F.lit(frustrated).alias("frustrated"), F.lit(name).alias("score"), r("hit_rate").alias("hit_rate"))
            out = row if out is None else out.union(row)
    return out


@query("""WITH e AS (SELECT date_trunc('hour', ts) AS h, event_type AS node, sum(value) AS value FROM events GROUP BY 1, 2) SELECT CAST(epoch(h) AS BIGINT) AS h, node, round(value, 4) AS value FROM e""")
def event_hours(spark, d):
    """Events by hour; the same aggregate that ``streams.event_panel`` keeps under a watermark."""
    return hourly(spark, d).select(F.unix_seconds("ts").alias("h"), "node", r("value", 4).alias("value"))


@query("""WITH e AS (SELECT date_trunc('hour', ts) AS h, event_type AS node, sum(value) AS value FROM events GROUP BY 1, 2)
SELECT CAST(epoch(h) AS BIGINT) AS h, node, round(value, 4) AS value FROM e WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def stream_event_panel(spark, d):
    """Events as a stream, summed by hour under a watermark of two hours and written as hours close; those that the watermark has not passed are still open."""
    e = streams.event_panel(streams.read_events(spark, f"{d}/events.parquet*").select("ts", "event_type", "value"))
    return streams.replay(e, "event-panel").select(F.unix_seconds("ts").alias("h"), "node", r("value", 4).alias("value"))


@query("""WITH e AS (SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase'),
p AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM e)
SELECT a.user_id, CAST((a.pos - 10) / 5 AS INTEGER) AS win, CAST(a.pos AS INTEGER) AS "end", round(avg(b.value), 6) AS mean FROM p a JOIN p b ON a.user_id = b.user_id AND b.pos >= a.pos - 10 AND b.pos < a.pos WHERE a.pos >= 10 AND (a.pos - 10) % 5 = 0 GROUP BY 1, 2, 3""")
def stream_hop_windows(spark, d):
    """Row-count hop windows of each user's purchases over the table at rest; ``streams.hop_stream`` gives the same on a stream."""
    by = Window.partitionBy("user_id").orderBy("event_id")
    e = parquet(spark, d, "events").where("event_type = 'purchase'").select("user_id", "event_id", "value")
    e = e.withColumns({"pos": F.row_number().over(by) - 1, "mean": F.avg("value").over(by.rowsBetween(-10, -1))}).where("pos >= 10 AND (pos - 10) % 5 = 0")
    return e.select("user_id", ((F.col("pos") - 10) / 5).cast("int").alias("win"), F.col("pos").alias("end"), r("mean").alias("mean"))


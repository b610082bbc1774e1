import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from drained import drain
from pyspark.sql import functions as F

from weftline.functions import kernels
from weftline.operators import blocks, credit, draws, filters, inference, metrics, network, panel, portfolio, ranks, risk, scoring, synth, text, windows
from weftline.sources import readers
from weftline.streaming import streams


def gap_panel(spark):
    rows = [(dt.date(2024, 1, i + 1), n, float(2 ** (i + j))) for i in range(6) for j, n in enumerate("ab") if (i, n) != (2, "b")]
    return spark.createDataFrame(rows, "ts date, node string, value double")


@pytest.mark.parametrize("policy,dates", [("diff_then_drop", 3), ("drop_then_diff", 4), ("fill", 5), ("complete_columns", 5), ("level_diff", 3)])
def test_missing_day_policies(spark, policy, dates):
    r = panel.returns(gap_panel(spark), policy)
    assert r.select("ts").distinct().count() == dates


def test_unknown_policy(spark):
    with pytest.raises(ValueError):
        panel.returns(gap_panel(spark), "none")


def test_hop_boundary(spark):
    a = spark.range(26).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("ts"), F.col("id").alias("pos"))
    ends = [r["end"] - 1 for r in windows.hops(a, 20, 3).collect()]
    assert sorted(ends) == [19, 22]
    m = windows.members(a.select("ts"), a, 20, 3).groupBy("win").agg(F.min("pos"), F.max("pos")).collect()
    assert sorted(map(tuple, m)) == [(0, 0, 19), (1, 3, 22)]


def window_rows(spark, seed=0, n=5, rows=25):
    x = np.random.default_rng(seed).standard_normal((rows, n)) + np.random.default_rng(seed + 1).standard_normal((rows, 1))
    return x, spark.createDataFrame([(0, p, f"n{i}", float(x[p, i])) for p in range(rows) for i in range(n)], "win int, pos int, node string, ret double")


def test_relational_network_equals_dense(spark):
    x, m = window_rows(spark)
    a = np.abs(kernels.off_diagonal(kernels.correlation(x)))
    mass, c, d, v = kernels.parts(a)
    e = network.correlations(m)
    f = network.factors(e).first()
    assert [f[k] for k in ("tr_a3", "clustering", "density", "degree_variance")] == pytest.approx([mass, c, d, v])
    tri = {r["node"]: r["tri"] for r in network.node_triangles(e).collect()}
    assert [tri[f"n{i}"] for i in range(5)] == pytest.approx(list(np.diag(a @ a @ a)))
    p = {(r["i"], r["j"]): r["pressure"] for r in network.pressures(e).collect()}
    assert p[("n0", "n1")] == pytest.approx(3 * (a @ a)[0, 1] * a[0, 1])
    dense = metrics.factors(m).first()
    assert [dense[c] for c in f.asDict()] == pytest.approx([f[c] for c in f.asDict()])
    both = metrics.node_triangles(m).join(network.degrees(e).withColumnRenamed("degree", "other"), ["win", "node"]).collect()
    assert {r["node"]: r["tri"] for r in both} == pytest.approx(tri) and all(r["degree"] == pytest.approx(r["other"]) for r in both)
    k = metrics.window_metrics(m, ["omega", "gap"]).first()
    assert k["omega"] == pytest.approx(kernels.omega(a))


def test_filter_three(spark):
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate([1.0, 2.0, 0.5])], "s string, ts int, x double")
    assert [r["memory"] for r in filters.smooth(df, "x", ["s"]).orderBy("ts").collect()] == pytest.approx([1, 1.6, 1.512])
    grid = df.withColumn("up", F.lit(0.6)).withColumn("down", F.lit(0.08))
    assert [r["memory"] for r in filters.smooth(grid, "x", ["s", "up", "down"], rates=("up", "down")).orderBy("ts").collect()] == pytest.approx([1, 1.6, 1.512])


def test_past_distribution(spark):
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate([3.0, 1.0, 2.0, 3.0])], "s string, ts int, x double")
    got = filters.trailing_cdf(df, "x", ["s"]).orderBy("ts").collect()
    assert [r["cdf"] for r in got] == [None, 0.0, 0.5, 1.0]


def test_windows_of_many_nodes_have_all_metrics(spark):
    """No size is too large: edges are dealt to tasks, loops found without all triangles."""
    x, m = window_rows(spark, 3, 12)
    got = metrics.window_metrics(m, ["curvature", "loops", "curvature_weighted"], edges_per_task=7).first()
    c = kernels.correlation(x)
    assert (got["curvature"], got["curvature_weighted"]) == pytest.approx(kernels.curvature(c))
    assert got["loops"] == pytest.approx(sum(e - b for d, b, e in kernels.rips_pairs(kernels.distance(kernels.unit_diagonal(c))) if d == 1))
    _, m = window_rows(spark, 4, 64, 30)
    wide = metrics.window_metrics(m, ["curvature", "loops", "omega"], edges_per_task=200).first()
    assert -1 < wide["curvature"] <= 1 and wide["loops"] > 0


def test_ahead_needs_all_rows(spark):
    rows = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(i), "a", float(i)) for i in range(12)], "ts date, node string, ret double")
    a = panel.axis(rows)
    got = windows.ahead(rows, windows.hops(a, 4, 3), rows, 3).collect()
    assert {(r["win"], r["ahead"]) for r in got} == {(0, 4.0 + 5 + 6), (1, 7.0 + 8 + 9)}


def test_draws_are_uniform_and_normal(spark):
    d = spark.range(20000).select(draws.uniform(F.col("id")).alias("u"), draws.normal(F.col("id")).alias("z")).toPandas()
    assert abs(d["u"].mean() - 0.5) < 0.01 and abs(d["u"].var() - 1 / 12) < 0.003
    assert abs(d["z"].mean()) < 0.03 and abs(d["z"].std() - 1) < 0.02 and abs(np.corrcoef(d["z"][1:], d["z"][:-1])[0, 1]) < 0.03


def test_epicentres(spark):
    """Noise before the shock; after it .81 of correlation in a group, .0625 outside."""
    s = synth.epicentres(spark, 30, 2).where("sim < 30").toPandas()
    wide = s.pivot(index=["sim", "pos"], columns="node", values="ret")
    late, early = wide[wide.index.get_level_values("pos") >= 100].corr(), wide[wide.index.get_level_values("pos") < 100].corr()
    assert late.loc["n00", "n01"] == pytest.approx(0.81, abs=0.03) and late.loc["n10", "n11"] == pytest.approx(0.0625, abs=0.06)
    assert abs(early.loc["n00", "n01"]) < 0.06 and set(s[s["truth"]]["node"]) == {f"n{i:02d}" for i in range(6)}
    turned = synth.epicentres(spark, 30, 1, frustrated=True, rows=(100, 200)).toPandas().pivot(index=["sim", "pos"], columns="node", values="ret").corr()
    assert turned.loc["n00", "n01"] == pytest.approx(-0.81, abs=0.03)


def test_quantile_and_gini(spark):
    df = spark.createDataFrame([("g", x) for x in (1.0, 2.0, 3.0, 10.0)], "g string, x double")
    assert df.agg(F.percentile("x", 0.9)).first()[0] == pytest.approx(7.9)
    assert network.gini(df, "x", ["g"]).first()["gini"] == pytest.approx(kernels.gini(np.array([1.0, 2, 3, 10])))


def test_average_ranks(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 2.0), ("g", None)], "g string, x double")
    got = [r["k"] for r in df.withColumn("k", network.average_rank(F.col("x"), ["g"])).orderBy("x").collect()]
    assert got == [None, 1.0, 2.5, 2.5]


def test_holm(spark):
    t = spark.createDataFrame([("a", 0.001), ("b", 0.02), ("c", 0.04), ("d", 0.011)], "test string, p double")
    assert {r["test"] for r in inference.holm(t).collect() if r["holm"]} == {"a", "d", "b", "c"}
    t = spark.createDataFrame([("a", 0.001), ("b", 0.04), ("c", 0.04)], "test string, p double")
    assert {r["test"] for r in inference.holm(t).collect() if r["holm"]} == {"a"}


def test_labels_and_scores(spark):
    days = spark.createDataFrame([(dt.date(1995, 3, 1), 5.0), (dt.date(1995, 6, 16), 1.0), (dt.date(1995, 6, 15), 4.0)], "day date, x double")
    got = scoring.labelled(days, scoring.intervals(spark).where("list = 'core'"), "day").collect()
    assert {(r["day"].day, r["crisis"], r["episode"]) for r in got} == {(1, True, "spring95"), (16, False, None), (15, True, "spring95")}
    s = scoring.confusion(scoring.thresholded(spark.createDataFrame(got), "x", ["list"], 0.5), ["list"]).first()
    assert (s["tp"], s["fp"], s["fn"]) == (2, 0, 0)


def test_turnover_and_drawdown(spark):
    w = spark.createDataFrame([("r", 0, "a", 1.0), ("r", 1, "b", 1.0), ("r", 2, "b", 1.0)], "rule string, win int, node string, weight double")
    assert [r["turnover"] for r in portfolio.turnover(w, ["rule"], "win").orderBy("win").collect()] == [1.0, 2.0, 0.0]
    d = spark.createDataFrame([("s", 1, 0.1), ("s", 2, -0.2), ("s", 3, 0.05)], "s string, ts int, r double")
    assert filters.drawdown(d, "r", ["s"]).agg(F.min("drawdown")).first()[0] == pytest.approx(math.exp(-0.2) - 1)


def test_quarters(spark):
    df = spark.createDataFrame([("x", 2015 * 4, 1.0), ("x", 2015 * 4 + 2, 3.0)], "company string, qi int, v double")
    assert [r["v"] for r in credit.complete_quarters(df).orderBy("qi").collect()] == [1.0, None, 3.0]
    assert df.select(credit.quarter_name(F.col("qi"))).first()[0] == "2015Q1"
    assert spark.range(1).select(credit.quarter_index(F.lit("2015Q3"))).first()[0] == 2015 * 4 + 2


def test_amounts(spark):
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(text.amounts(F.col("t")).alias("a"), text.commenced_amount(F.col("t")).alias("c"), text.concept(F.col("t")).alias("k")).first()
    assert one("$5 million and $2 billion, respectively, or $500")["a"] == [5.0, 2000.0, 500.0]
    assert one("leases not yet commenced of $3.1 and $4.2 billion")["c"] == pytest.approx(7300)
    assert one("not yet commenced" + "x" * 250 + "$5 billion")["c"] is None
    assert one("nothing")["a"] == [] and one("nothing")["k"] == text.OTHER
    assert one("Leases not yet commenced $ 10 1,200 1,210.5 are due")["c"] == 1210.5
    assert one("a residual value guarantee")["k"] == "garantia de valor residual"


def test_plain_text(spark):
    html = "<html><style>p{}</style><script>var a='<b>'</script><p>A&nbsp;&amp; B</p>\n\n<p>C&copy;</p></html>"
    plain = lambda h: spark.createDataFrame([(h,)], "h string").select(text.plain_text(F.col("h"))).first()[0]
    assert plain(html) == "A & B C©"
    import html as reader

    for t in ("It&#8217;s 5&copy; &eacute;t&#233;", "&#x1F600;&#128512; &hearts;&amp;lt; &copy2024 &#150; &#0; &unknown; & alone &;", "a&nbsp;b&ensp;c&notin;&NotEqualTilde;"):
        assert plain(t) == " ".join(reader.unescape(t).split())
    assert plain("<script>a</style>b</script>c") == "c" and plain(None) is None


def test_each_rule_takes_a_text_apart_once(spark):
    shares = spark.createDataFrame([("a",)], "t string").select(text.concentration(F.col("t")).alias("c"))
    assert shares._jdf.queryExecution().analyzed().toString().count("split(") == len(text.SHARE_RULES) + 1  # and the list of shares


def test_shares_of_customers(spark):
    read = lambda t: [tuple(r) for r in spark.createDataFrame([(t,)], "t string").select(text.concentration(F.col("t")).alias("c")).first()["c"]]
    day = dt.date(2024, 6, 30)
    assert read("Our largest customer's orders were 12.5% of net sales for the quarter ended June 30, 2024.") == [("mayor_cliente", 1, 12.5, day, "ventas netas")]
    assert read("We made 36%, 26%, and 10% of our revenue as of June 30, 2024 from our top three customers, 36% as of June 30, 2024.") == [("top_n", 3, 72.0, day, "ingresos")]
    assert read("The 50 largest customers gave 40% of revenue.") == []
    assert read("30% of revenues from our top ten customers in fiscal 2023") == [("top_n", 10, 30.0, dt.date(2023, 12, 31), "ingresos")]
    assert read("no single customer exceeded 10% of accounts receivable") == [("umbral", None, 10.0, None, "cuentas por cobrar")]
    assert read("top of the list") == [] and read("largest customer had 0% then") == []


def test_lease_terms(spark):
    read = lambda t: spark.createDataFrame([(t,)], "t string").select(text.lease_terms(F.col("t")).alias("t")).first()["t"]
    assert tuple(read("Leases not yet commenced will commence between 2026 and 2029 with terms of seven to sixteen years.")) == (2026, 2029, 7.0, 16.0, None)
    assert tuple(read("not yet commenced: none. Leases that have not yet commenced will commence in fiscal 2027, lease terms of up to 15 years, a weighted average remaining lease term of 8 years")) == (2027, 2027, None, 15.0, 8.0)
    assert read("no leases") is None


def test_readers(spark, tmp_path):
    (tmp_path / "w.csv").write_text("d,a,b\n2024-01-01,1,\n2024-01-02,2,3\n")
    w = readers.wide_csv(spark, str(tmp_path / "w.csv"), "d", ["a", "b"])
    assert sorted((r["node"], r["value"]) for r in w.where("value is not null").collect()) == [("a", 1.0), ("a", 2.0), ("b", 3.0)]
    (tmp_path / "btc.csv").write_text("time,PriceUSD,x\n2024-01-01,10,9\n")
    assert readers.long_csv(spark, str(tmp_path / "btc.csv"), "time", None, "PriceUSD").first()["node"] == "btc"
    f = tmp_path / "ACME_20240101_base.txt"
    f.write_text("hello\nworld")
    assert tuple(readers.filings(spark, str(f)).first()) == ("ACME", "20240101", "base", "hello\nworld")
    j = '{"facts":{"us-gaap":{"Debt":{"units":{"USD":[{"end":"2024-03-31","val":5,"form":"10-Q","filed":"2024-05-01"},{"start":"2024-01-01","end":"2024-03-31","val":9,"form":"10-Q","filed":"2024-05-01"},{"end":"2024-03-31","val":6,"form":"10-K","filed":"2025-01-01"}]}}}}}'
    assert readers.company_facts(spark.createDataFrame([("acme", j)], "company string, json string")).first()["value"] == 6.0
    g = spark.createDataFrame([("2024-01-01", "5"), ("2024-03-01", "7"), ("2024-04-01", "x")], "DATE string, GDP string")
    assert [tuple(r) for r in readers.macro_series(g).collect()] == [("2024Q1", 7.0)]


def test_stream_filter_equals_batch(spark, tmp_path):
    rows = [("k", i, float((i * 7) % 5)) for i in range(12)]
    for part in range(3):
        spark.createDataFrame(rows[4 * part : 4 * part + 4], "k string, ts int, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    s = spark.readStream.schema("k string, ts int, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    got = {r["ts"]: r["memory"] for r in drain(streams.filtered_stream(s, "k", "ts", "x"), "filtered").collect()}
    want = {r["ts"]: r["memory"] for r in filters.smooth(spark.createDataFrame(rows, "k string, ts int, x double"), "x", ["k"]).collect()}
    assert got == pytest.approx(want)


def test_stream_panel(spark, data):
    e = streams.event_panel(spark.readStream.schema(spark.read.parquet(f"{data}/events.parquet").schema).parquet(f"{data}/events.parquet*"))
    got = drain(e, "panel_stream")
    assert set(got.columns) == {"ts", "node", "value"}


def test_blocked_sums_equal_a_dense_matrix(spark):
    """Any number of nodes and any size of block, nodes that do not vary included."""
    rng = np.random.default_rng(8)
    for n, block in ((1, 4), (2, 1), (7, 3), (20, 7), (20, 64)):
        x = rng.normal(size=(2, 9, n))
        if n > 2:
            x[0, :, 1] = 3.0
        m = spark.createDataFrame([(w, t, f"n{i:02d}", float(x[w, t, i])) for w in range(2) for t in range(9) for i in range(n)], "win int, pos int, node string, ret double")
        got = {(g["win"], g["node"]): (g["degree"], g["square"], g["tri"]) for g in blocks.node_sums(m, block).collect()}
        assert len(got) == 2 * n
        for w in range(2):
            with np.errstate(invalid="ignore"):
                a = np.abs(np.nan_to_num(np.corrcoef(x[w], rowvar=False).reshape(n, n)))
            np.fill_diagonal(a, 0.0)
            cubed = np.diag(a @ a @ a)
            for i in range(n):
                assert np.allclose(got[w, f"n{i:02d}"], (a[i].sum(), (a[i] ** 2).sum(), cubed[i]), atol=1e-9)
    f = blocks.factors(blocks.node_sums(m, 7)).orderBy("win").collect()
    e = network.factors(network.correlations(m)).orderBy("win").collect()
    assert all(abs(p[c] - q[c]) < 1e-9 for p, q in zip(f, e, strict=True) for c in q.asDict())


def test_blocked_tasks_do_not_grow_with_nodes(spark):
    """More nodes make more triples of blocks, none of them larger."""
    for n in (30, 60):
        m = spark.createDataFrame([(0, t, i, float((t * i) % 7)) for t in range(5) for i in range(n)], "win int, pos int, node int, ret double")
        sizes = blocks.standardised(m, 10).select(F.size("nodes").alias("k")).collect()
        assert len(sizes) == n // 10 and max(s["k"] for s in sizes) == 10


def test_sliding_moments_equal_those_of_members(spark):
    """Running sums give each window's moments, with gaps in the nodes' dates and windows that share and do not share dates."""
    rng = np.random.default_rng(2)
    dates = pd.date_range("2020-01-01", periods=40).date
    rows = spark.createDataFrame([(d, f"n{i}", float(rng.normal() + 5)) for d in dates for i in range(5) if rng.random() < 0.8], "ts date, node string, ret double")
    a = panel.axis(rows)
    for width, step in ((10, 3), (10, 10), (4, 9), (7, 1)):
        want = {(g["win"], g["i"], g["j"]): g for g in network.moments(windows.members(rows, a, width, step)).collect()}
        got = {(g["win"], g["i"], g["j"]): g for g in network.sliding_moments(rows.join(a, "ts"), windows.hops(a, width, step), width).collect()}
        assert got.keys() == want.keys() and len(got) > 10
        assert all(got[k]["n"] == want[k]["n"] and abs(got[k][c] - want[k][c]) < 1e-9 for k in want for c in ("cxy", "cxx", "cyy"))


def test_least_squares_and_predictions(spark):
    """Several models from one aggregate equal a solve of each; a regressor given twice does no harm."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    y = x @ [0.5, -2.0, 0.0] + 3 + rng.normal(size=80)
    rows = spark.createDataFrame([(k, *map(float, x[k]), float(x[k, 0]), float(y[k])) for k in range(80)], "k long, x0 double, x1 double, x2 double, again double, y double")
    models = {"one": ["x0"], "all": ["x0", "x1", "x2"], "twice": ["x0", "again"]}
    betas = inference.least_squares(rows, "y", models)
    told = {(t["model"], t["k"]): t["predicted"] for t in inference.predictions(rows, ["k"], betas).collect()}
    for name, use in (("one", [0]), ("all", [0, 1, 2]), ("twice", [0])):
        design = np.c_[np.ones(80), x[:, use]]
        want = design @ np.linalg.lstsq(design, y, rcond=None)[0]
        assert np.allclose([told[name, k] for k in range(80)], want, atol=1e-7)
    assert inference.least_squares(rows.limit(0), "y", models).count() == 0


@pytest.mark.parametrize("horizon", [1, 2, 7, 12, 30])
def test_falls_from_each_start_equal_brute_force(spark, horizon):
    rng = np.random.default_rng(horizon)
    rets = {rule: rng.normal(scale=0.1, size=30) for rule in "ab"}
    path = spark.createDataFrame([(rule, p, float(v[p]), float(v[: p + 1].sum())) for rule, v in rets.items() for p in range(30)], "rule string, pos int, ret double, equity double")
    got = {(f["rule"], f["start"]): f["drawdown"] for f in portfolio.start_drawdowns(path, ["rule"], horizon).collect()}
    assert len(got) == 2 * (31 - horizon)
    for (rule, start), fall in got.items():
        e = np.concatenate([[0.0], np.cumsum(rets[rule][start : start + horizon])])
        assert fall == pytest.approx(np.exp((e - np.maximum.accumulate(e)).min()) - 1)


def test_ranks_of_large_groups(spark):
    """Equal to ranks within each group, with a value that most rows have, nulls, and groups over many ranges."""
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 900, p=[0.8, 0.15, 0.05]), "v": np.where(rng.random(900) < 0.4, 7.0, np.round(rng.normal(size=900), 1)), "k": range(900)})
    frame.loc[rng.random(900) < 0.05, "v"] = np.nan
    rows = spark.createDataFrame([(g, None if math.isnan(v) else v, k) for g, v, k in frame.itertuples(index=False)], "g string, v double, k int")
    got = {x["k"]: (x["rank"], x["n"]) for x in ranks.average_ranks(rows, "v", ["g"]).collect()}
    want, n = frame.groupby("g")["v"].rank(), frame.groupby("g")["v"].transform("count")
    assert len(got) == 900
    assert all(got[k][0] is None if math.isnan(want[k]) else got[k] == (want[k], n[k]) for k in range(900))


def test_dynamic_correlation_equals_the_recurrence(spark):
    rng = np.random.default_rng(6)
    z = rng.normal(size=(50, 4))
    rows = spark.createDataFrame([(t, f"n{i}", float(z[t, i])) for t in range(50) for i in range(4)], "pos int, node string, ret double")
    grid = spark.createDataFrame([(0.05, 0.9), (0.0, 0.5)], "a double, b double")
    got = {(x["a"], x["pos"], x["i"], x["j"]): x["rho"] for x in filters.dynamic_correlation(rows, grid, [49, 10, 23]).collect()}
    assert len(got) == 2 * 3 * 6
    for a, b in ((0.05, 0.9), (0.0, 0.5)):
        target = z.T @ z / 50
        q = target.copy()
        for t in range(50):
            if t in (10, 23, 49):
                for i in range(4):
                    for j in range(i + 1, 4):
                        assert got[a, t, f"n{i}", f"n{j}"] == pytest.approx(q[i, j] / np.sqrt(q[i, i] * q[j, j]))
            q = (1 - a - b) * target + a * np.outer(z[t], z[t]) + b * q


def test_scenarios_of_known_states(spark):
    """Quantiles follow the variance of the states; the states with the largest loadings are the concentrated ones."""
    v = spark.createDataFrame([(w, 4.0) for w in range(40)], "win int, variance double")
    drawn = risk.scenario_draws(v, 400)
    assert drawn.select("win").distinct().count() == 20
    got = {x["quantity"]: x["value"] for x in risk.loss_probabilities(drawn.withColumn("win", F.lit(0)), [-2.0]).collect()}
    assert got["quantile 0.5"] == pytest.approx(0, abs=0.15) and got["quantile 0.05"] == pytest.approx(-2 * 1.943 * (4 / 6) ** 0.5, rel=0.1)  # Student t of six degrees
    assert got["loss -2.0"] == pytest.approx(0.134, abs=0.02)
    states = spark.createDataFrame([(0, 1, [0.9, 0.9, 0.1], [0.1] * 3), (1, 2, [0.5, 0.0, 0.0, 0.5, 0.1, 0.1], [0.1] * 3)], "win int, k int, loadings array<double>, residual array<double>")
    e = {(x["win"], x["i"], x["j"]): x["rho"] for x in risk.concentrated_states(states, ["a", "b", "c"], 1).collect()}
    assert e == {(0, "a", "b"): pytest.approx(0.81), (0, "a", "c"): pytest.approx(0.09), (0, "b", "c"): pytest.approx(0.09)}
    both = {(x["win"], x["i"], x["j"]): x["rho"] for x in risk.concentrated_states(states, ["a", "b", "c"], 2).collect()}
    assert both[1, "a", "b"] == 0.0 and both[1, "a", "c"] == pytest.approx(0.05) and len(both) == 6


def test_portfolio_variance_from_edges(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(30, 5))
    c, sd = np.corrcoef(x, rowvar=False), x.std(axis=0)
    edges = spark.createDataFrame([(0, f"n{i}", f"n{j}", float(c[i, j])) for i in range(5) for j in range(i + 1, 5)], "win int, i string, j string, rho double")
    dev = spark.createDataFrame([(0, f"n{i}", float(sd[i])) for i in range(5)], "win int, node string, sd double")
    assert risk.equal_weight_variance(edges, dev, ["win"]).first()["variance"] == pytest.approx(x.mean(axis=1).var())


def test_shrinkage_strength_is_chosen_before_it_is_judged(spark):
    rows = [(w, "t", a, v) for w in range(6) for a, v in ((0.2, 1.0 if w < 3 else 9.0), (0.8, 2.0 if w < 3 else 4.0))]
    got = risk.chosen_strengths(spark.createDataFrame(rows, "win int, target string, alpha double, variance double")).collect()
    assert [(g["target"], g["alpha"], g["windows"], g["realised"]) for g in got] == [("t", 0.2, 3, 3.0)]


def test_turned_series(spark):
    """Series that move together are never reached when turned; the correlation is that of the rows as they are."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=60)
    y = {"same": x + 0.1 * rng.normal(size=60), "other": rng.normal(size=60)}
    rows = spark.createDataFrame([(k, p, float(x[p]), float(v[p])) for k, v in y.items() for p in range(60)], "k string, pos int, x double, y double")
    got = {g["k"]: g for g in inference.shift_test(rows, "x", "y", ["k"], 40).collect()}
    for k, v in y.items():
        own = round(float(np.corrcoef(x, v)[0, 1]), 9)
        turned = [abs(round(float(np.corrcoef(x, np.roll(v, -s))[0, 1]), 9)) for s in range(1, 41)]
        assert got[k]["rho"] == pytest.approx(own) and got[k]["p"] == pytest.approx((1 + sum(t >= abs(own) for t in turned)) / 41)
    assert got["same"]["p"] == pytest.approx(1 / 41)

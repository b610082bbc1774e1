"""Registered queries that write files and read them again: wide and long CSV, company facts, macro series."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.operators import panel
from weftline.sources import readers
from weftline.sources.readers import parquet
from weftline.sources.shared import folder, taken

from .base import PANEL, nation_weekly, r, weekly
from .series import NATION


def fresh(spark, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {PANEL} SELECT ts, node, round(value, 2) AS value FROM panel")
def wide_csv_panel(spark, d):
    """A panel written as one column for each node and read back."""
    path = fresh(spark, "wide")
    p = weekly(spark, d)
    nodes = sorted(x["node"] for x in p.select("node").distinct().collect())  # as many as a file has columns
    readers.write_series(panel.wide(p, nodes), path)
    return taken(readers.wide_csv(spark, path, "ts", nodes).where(F.col("value").isNotNull()).select("ts", "node", r("value", 2).alias("value")), path)


@query(f"WITH {NATION} SELECT ts, node, round(value, 2) AS value FROM panel")
def long_csv_panel(spark, d):
    """A panel written as rows, in a folder for each half of the calendar, with a column too many, and read back from both."""
    p = nation_weekly(spark, d).select(F.lit("x,\"y\"").alias("note"), F.col("node").alias("Ticker"), F.col("ts").alias("Day"), F.col("value").alias("Close"))
    paths = [fresh(spark, "long") for _ in range(2)]
    late = F.col("Day") >= F.lit("1998-06-01").cast("date")
    for path, part in zip(paths, (~late, late), strict=True):
        readers.write_series(p.where(part), path, text="note")
    return taken(readers.long_csv(spark, paths, "Day", "Ticker", "Close").select("ts", "node", r("value", 2).alias("value")), *paths)


QUARTERS = "SELECT lower(c_mktsegment) AS company, 'tag' || o_orderstatus AS tag, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3"


@query(QUARTERS)
def company_facts_panel(spark, d):
    """Facts by company, tag and quarter, composed as one document a company with earlier filings, durations and other forms among them, and read."""
    o = parquet(spark, d, "orders").join(parquet(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    end = F.date_sub(F.add_months(F.trunc("o_orderdate", "quarter"), 3), 1)
    q = o.groupBy(F.lower("c_mktsegment").alias("company"), F.concat(F.lit("tag"), "o_orderstatus").alias("tag"), end.alias("end")).agg(F.round(F.sum("o_totalprice"), 2).alias("val"))
    fact = lambda start, value, form, days: F.struct(F.lit(start).cast("string").alias("start"), F.col("end").cast("string").alias("end"), value.alias("val"), F.lit(form).alias("form"), F.date_add("end", days).cast("string").alias("filed"))
    four = F.array(fact(None, F.col("val") / 2, "10-Q", 40), fact(None, F.col("val"), "10-K", 90), fact("1990-01-01", F.col("val") * 3, "10-K", 95), fact(None, F.col("val") * 4, "8-K", 99))
    by_tag = q.groupBy("company", "tag").agg(F.flatten(F.collect_list(four)).alias("u"))
    entry = F.struct(F.col("tag"), F.struct(F.create_map(F.lit("USD"), F.col("u")).alias("units")))
    json = by_tag.groupBy("company").agg(F.map_from_entries(F.collect_list(entry)).alias("tags")).select("company", F.to_json(F.struct(F.create_map(F.lit("gaap"), F.col("tags")).alias("facts"))).alias("json"))
    path = fresh(spark, "facts")
    json.write.json(path)
    return taken(readers.company_facts(spark.read.schema("company string, json string").json(path)), path)


@query("""WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1)
SELECT CAST(year(d) AS VARCHAR) || 'Q' || quarter(d) AS quarter, arg_max(v, d) AS value FROM m WHERE month(d) % 5 <> 0 GROUP BY 1""")
def macro_quarters(spark, d):
    """A monthly series with gaps written as CSV under other names, read as the last value of each quarter."""
    m = parquet(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("DATE")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    path = fresh(spark, "macro")
    readers.write_series(m.select("DATE", F.when(F.month("DATE") % 5 != 0, F.col("v").cast("decimal(20,2)").cast("string")).otherwise(".").alias("GDP")), path)
    return taken(readers.macro_series(spark.read.option("header", True).schema("DATE string, GDP string").csv(path)).select("quarter", "value"), path)

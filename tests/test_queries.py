"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from drained import drain

from weftline import catalog, plans  # noqa: F401
from weftline.streaming import streams


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in os.listdir(data):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{data}/{t}'")
    return c


def rows(df):
    cell = lambda v: None if pd.isna(v) else f"{float(v) + 0.0:.8g}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(pd.Timestamp(v)) if hasattr(v, "year") else str(v)
    return sorted(tuple(str(cell(v)) for v in t) for t in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    got, want = catalog.QUERIES[name](spark, data).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entities_without_a_semicolon(spark, tmp_path):
    pages = [(1, "<title>a &amp;&amp</title><p>b &quot;c&quot &am &a"), (2, "&copy &copy; &middot;x&middot &amp;quot; &amp;amp"), (3, None), (4, "")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = catalog.QUERIES["html_to_text"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(c.sql(catalog.ORACLES["html_to_text"]).df())
    assert dict(zip(got["page_id"], got["body"], strict=True))[1] == 'a &&amp b "c&quot &am &a'


def test_hop_windows_leave_no_memory_table(spark, data, duck):
    df = catalog.QUERIES["stream_hop_windows"](spark, data)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("hop_stream")]
    assert rows(df.toPandas()) == rows(duck.sql(catalog.ORACLES["stream_hop_windows"]).df())


def test_hop_stream_equals_query(spark, data):
    e = spark.readStream.schema(spark.read.parquet(f"{data}/events.parquet").schema).parquet(f"{data}/events.parquet*").where("event_type = 'purchase'")
    got = drain(streams.hop_stream(e, "user_id", "event_id", "value", 10, 5), "hops_of_test").toPandas()
    want = catalog.QUERIES["stream_hop_windows"](spark, data).toPandas()
    assert rows(got.assign(mean=got["mean"].round(6))) == rows(want)

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from weftline.llm import queries


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, data, name):
    got = queries.QUERIES[name](spark, data).toPandas()
    c = duckdb.connect()
    for t in ("pages", "documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = c.sql(queries.ORACLES[name]).df()
    cell = lambda v: str(int(v)) if isinstance(v, float) else str(v)
    rows = lambda d: sorted(tuple(map(cell, t)) for t in d.astype(object).where(d.notna(), None)[sorted(d.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_has_a_row_for_each_document(spark, data, name):
    table = "pages" if name == "op4_urlfilter" else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    got = queries.QUERIES[name](spark, data).select(key).distinct().count()
    assert got == spark.read.parquet(f"{data}/{table}.parquet").count()


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = corpus_pipeline.run(spark, data)
    assert out.select("doc_id").distinct().count() > 0.6 * docs.count()
    assert out.where("offset < 0 or offset + length > 16384").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "privacy", "packing"]


def test_pipeline_without_a_secret_begins_nothing():
    class Session:
        sparkContext = type("C", (), {"master": "spark://host:7077"})
        conf = type("R", (), {"get": staticmethod(lambda name, default: default)})

    with pytest.raises(ValueError, match="weftline.pii.key"):
        corpus_pipeline.run(Session(), "nowhere")


def test_privacy_stage_with_a_long_host(spark, data):
    docs = spark.createDataFrame([(1, "to x@" + "a." * 50_000 + "com now", "en", "s", 100_012)], spark.read.parquet(f"{data}/documents.parquet").schema)
    out = corpus_pipeline.privacy(spark, docs, data).first()
    assert out["text"].endswith(".example now") and out["n_chars"] == len(out["text"]) < 100

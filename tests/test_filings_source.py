"""The source of filings: files are pruned by name, in groups; other files are passed over."""

import datetime as dt

from pyspark.sql import functions as F

from weftline.operators import text
from weftline.sources import filings


def folder(tmp_path):
    for company in ("ACME", "BOLT", "CORE"):
        for year in (2021, 2022, 2023):
            f = tmp_path / company / f"{company}_{year}0331_10-Q.txt"
            f.parent.mkdir(exist_ok=True)
            f.write_text(f"As of March 31, {year}, leases not yet commenced of ${year - 2020}.5 billion. ñ")
    (tmp_path / "notes.txt").write_text("no filing")
    (tmp_path / "ACME_20231399_x.txt").write_text("no day")
    return f"file://{tmp_path}"


def test_files_are_chosen_before_they_are_opened(tmp_path):
    path, first, last = folder(tmp_path), dt.date.min, dt.date.max
    assert [len(p.files) for p in filings.FilingsReader(path, 2, set(), first, last).partitions()] == [2, 2, 2, 2, 1]
    some = filings.FilingsReader(path, 2, {"ACME", "CORE"}, dt.date(2022, 3, 31), last).partitions()
    assert [(n.company, n.filed.year) for p in some for n in p.files] == [("ACME", 2022), ("ACME", 2023), ("CORE", 2022), ("CORE", 2023)]
    assert [p.files for p in filings.FilingsReader(path, 2, {"ACME"}, first, dt.date(2020, 1, 1)).partitions()] == [[]]


def test_filings_by_company_and_day(spark, tmp_path):
    path = folder(tmp_path)
    some = filings.load(spark, path, ["BOLT"], since=dt.date(2022, 1, 1), files_per_task=1)
    got = some.select("company", "filed", "base", text.commenced_amount(F.col("text")).alias("amount"), F.col("text").endswith("ñ").alias("whole")).orderBy("filed").collect()
    assert [tuple(g) for g in got] == [("BOLT", dt.date(2022, 3, 31), "10-Q", 2500.0, True), ("BOLT", dt.date(2023, 3, 31), "10-Q", 3500.0, True)]
    every = filings.load(spark, path)
    assert some.rdd.getNumPartitions() == 2 and every.rdd.getNumPartitions() == 1
    assert every.count() == 9 and every.where("company = 'BOLT'").count() == 3 and every.count() == 9
    assert filings.load(spark, path, ["NONE"]).count() == 0

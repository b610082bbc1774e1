"""A data source over a folder of filings: files are chosen by company and day from their names before any is opened.

``load(spark, path, companies, since, until)`` gives ``company, filed, base, text``, a row for each file named
COMPANY_yyyymmdd_base.ext; ``files_per_task`` files are one partition. Companies and days are options of the
source, so that files are left out while the scan is planned. (They are not pushed down from conditions: a
frame that is used with several conditions would keep those of the one before.) Other names are no filings
and are passed over. Paths are of any store that Arrow reads (files, HDFS, S3); for others
``readers.filings`` takes Spark's own file source.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

NAME = re.compile(r"([^_/]+)_(\d{8})_([^/]*?)(?:\.[^./]*)?$")
@dataclass
class Named:
    """A file and what its name says."""

    path: str
    company: str
    filed: dt.date
    base: str


def named(path: str) -> Named | None:
    """What a path's name says; None where it is no filing's or the day is none."""
    found = NAME.search(path)
    try:
        return Named(path, found[1], dt.datetime.strptime(found[2], "%Y%m%d").date(), found[3]) if found else None
    except ValueError:
        return None


class Files(InputPartition):
    def __init__(self, files: list[Named]) -> None:
        self.files = files


class FilingsReader(DataSourceReader):
    """Files under ``path`` of the ``companies`` (all if there are none) filed from ``since`` to ``until``."""

    def __init__(self, path: str, files_per_task: int, companies: set[str], since: dt.date, until: dt.date) -> None:
        self.path, self.files_per_task, self.companies, self.since, self.until = path, files_per_task, companies, since, until

    def chosen(self) -> list[Named]:
        store, root = fs.FileSystem.from_uri(self.path)
        paths = [x.path for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File]
        wanted = [n for n in map(named, paths) if n and self.since <= n.filed <= self.until and (not self.companies or n.company in self.companies)]
        return sorted(wanted, key=lambda n: n.path)

    def partitions(self) -> list[InputPartition]:
        files = self.chosen()
        return [Files(files[i : i + self.files_per_task]) for i in range(0, len(files), self.files_per_task)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)
        for n in partition.files:
            with store.open_input_stream(n.path) as f:
                yield n.company, n.filed, n.base, f.read().decode("utf-8", "replace")


class Filings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filings"

    def schema(self) -> str:
        return "company string, filed date, base string, text string"

    def reader(self, schema: StructType) -> FilingsReader:
        day = lambda name, default: dt.date.fromisoformat(self.options.get(name, default))
        companies = {c for c in self.options.get("companies", "").split(",") if c}
        return FilingsReader(self.options["path"], int(self.options.get("filesPerTask", "64")), companies, day("since", "0001-01-01"), day("until", "9999-12-31"))


def load(spark: SparkSession, path: str, companies: list[str] | None = None, since: dt.date | None = None, until: dt.date | None = None, files_per_task: int = 64) -> DataFrame:
    """The filings of some companies (of all without a list; their names have no comma) and days, both ends included."""
    spark.dataSource.register(Filings)
    asked = {"companies": ",".join(companies) if companies else None, "since": since and since.isoformat(), "until": until and until.isoformat()}
    return spark.read.format("filings").options(filesPerTask=files_per_task, **{k: v for k, v in asked.items() if v}).load(path)

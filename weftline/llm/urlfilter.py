"""URL rules as a sort-merge range join.

A host is written with its labels reversed, each ended by a dot (``www.a.com`` is ``com.a.www.``), so
a rule's host and all its subdomains are one interval of keys. URLs and rules are sorted together by
range partitions; a sweep keeps the stack of rule hosts whose interval is open and, among their path
rules, takes the longest rule that fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, table

ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each with a dot; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def key_prefixes(key: Column) -> Column:
    """``com.``, ``com.a.``, ``com.a.www.`` of a key of at least one label."""
    n = F.size(F.split(key, r"\.")) - 1
    return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.call_function("substring_index", key, F.lit("."), i), F.lit(".")))


class Sweep:
    """Walks URLs and rules in key order; each stack level holds one open host with its rules by path."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def add(self, key: str, path: str, rule: str, verdict: str) -> None:
        self.close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, by_path, sizes = self.stack[-1]
        by_path[path] = (rule, verdict)
        if len(path) not in sizes:
            sizes.append(len(path))
            sizes.sort(reverse=True)

    def find(self, key: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule and its verdict."""
        self.close(key)
        best = None
        for _, by_path, sizes in self.stack:
            hit = next((by_path[path[:n]] for n in sizes if n <= len(path) and path[:n] in by_path), None)
            if hit is not None and (best is None or len(hit[0]) >= len(best[0])):
                best = hit
        return best


#: So many rules that are open where range partitions begin are sent along with the code; more are exchanged.
MOST_OPEN = 100_000


def judge(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = ALLOW, rows_per_part: int = 250_000) -> DataFrame:
    """``key, host, path, rule, verdict`` for each row of ``urls``.

    ``rules`` has host, path and verdict strings, any number of them; repeated ones count once (of two
    verdicts, block). The longest fitting rule wins; without one, ``rule`` is null and the verdict
    ``default``. Null urls and urls without ``://`` have an empty host and path, which no rule fits.
    Sorting is by key, path and a hash of the row, so a host with a third of all rows is cut into as
    many range partitions as it needs; each starts with the rules open at its first key. Repeated rows
    are judged each on its own, an empty table stays empty, and other columns are not read.
    """
    spark = urls.sparkSession
    kind = dict(urls.dtypes)[key]
    host = host_of(F.col(url))
    pages = urls.select(F.col(key).cast("string").alias("_id"), host.alias("_host"), path_of(F.col(url)).alias("_path"), F.lit(None).cast("string").alias("_rule"), F.monotonically_increasing_id().alias("_tie"))
    pages = pages.withColumn("_key", host_key(F.col("_host")))
    clean = rules.where(F.col("host").isNotNull() & (F.col("host") != "")).groupBy(F.lower("host").alias("_host"), F.coalesce("path", F.lit("")).alias("_path")).agg(F.max("verdict").alias("_verdict"))
    clean = clean.select(F.lit(None).cast("string").alias("_id"), "_host", "_path", F.concat("_host", "_path").alias("_rule"), F.lit(-1).cast("long").alias("_tie"), host_key(F.col("_host")).alias("_key"), "_verdict")
    both = pages.withColumn("_verdict", F.lit(None).cast("string")).unionByName(clean)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pages.count() // rows_per_part))
    order = ["_key", F.col("_rule").isNull(), F.xxhash64("_tie")]
    ranged = both.repartitionByRange(parts, *order).sortWithinPartitions("_key", F.col("_rule").isNull(), "_path", "_rule")
    ranged = cut(ranged.withColumn("_part", F.spark_partition_id()))
    first = ranged.groupBy("_part").agg(F.min("_key").alias("_first")).select("_part", F.explode(key_prefixes(F.col("_first"))).alias("_key"))
    opened = clean.join(first, "_key").select(*ranged.columns)
    few = opened.select("_part", "_key", "_path", "_rule", "_verdict").take(MOST_OPEN + 1)
    schema = "_id string, host string, path string, rule string, verdict string"  # ids as text: pandas has no whole numbers with nulls
    typed = lambda df: df.select(F.col("_id").cast(kind).alias(key), "host", "path", "rule", "verdict")

    def judged(pdf: pd.DataFrame, sweep: Sweep) -> pd.DataFrame:
        rows = []
        for i, k, host, path, rule, verdict in pdf[["_id", "_key", "_host", "_path", "_rule", "_verdict"]].itertuples(index=False):
            if isinstance(rule, str):
                sweep.add(k, path, rule, verdict)
            else:
                rows.append((i, host, path, *(sweep.find(k, path) or (None, default))))
        return pd.DataFrame(rows, columns=["_id", "host", "path", "rule", "verdict"])

    def start(rows: list) -> Sweep:
        sweep = Sweep()
        for rule in sorted(rows):
            sweep.add(*rule)
        return sweep

    if len(few) <= MOST_OPEN:  # in place: a task walks its partition batch by batch
        by_part: dict[int, list] = {}
        for p, *rule in few:
            by_part.setdefault(p, []).append(tuple(rule))

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sweep = None
            for pdf in batches:
                if len(pdf):
                    sweep = sweep or start(by_part.get(int(pdf["_part"].iloc[0]), []))
                    yield judged(pdf, sweep)

        return typed(ranged.mapInPandas(walk, schema))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return judged(pdf.assign(_url=pdf["_rule"].isna()).sort_values(["_key", "_url", "_path"], kind="stable"), Sweep())

    return typed(ranged.unionByName(opened).groupBy("_part").applyInPandas(whole, schema))


#: Fixed values of the registered query: (host, path, verdict).
RULES = [
    ("com", "/", ALLOW),
    ("example.com", "/en/", BLOCK),
    ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK),
    ("net", "/fr/", BLOCK),
]


def op4_urlfilter(spark, sf_dir):
    """Every page's host, path, longest rule of RULES and verdict (``judge``); without a rule: allow."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages", "page_id", "url"), rules)


OP4_SQL = r"""
WITH u AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT u.page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""

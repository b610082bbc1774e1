"""Sources: every reader has an explicit schema or takes Parquet; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_csv(spark: SparkSession, path: str, date: str, nodes: list[str], fmt: str = "yyyy-MM-dd") -> DataFrame:
    """A wide series file (one column for each node) as a long panel ``ts, node, value``; empty cells are null."""
    schema = ", ".join([f"`{date}` string", *[f"`{n}` double" for n in nodes]])
    raw = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    return raw.select(F.to_date(date, fmt).alias("ts"), *nodes).unpivot("ts", nodes, "node", "value")


def long_csv(spark: SparkSession, path: str | list[str], ts: str, node: str | None, value: str, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Long price files with a header as ``ts, node, value``; without a node column the file's base name is the node.

    Only the named columns are read; each file may have others, in any order.
    """
    raw = spark.read.option("header", True).csv(path)
    name = F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1) if node is None else F.col(f"`{node}`")
    return raw.select(F.to_date(F.col(f"`{ts}`"), fmt).alias("ts"), name.alias("node"), F.col(f"`{value}`").try_cast("double").alias("value"))


def filings(spark: SparkSession, path: str) -> DataFrame:
    """Text files named COMPANY_filed_base as ``company, filed, base, text``; one row for each file."""
    parts = F.split(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""), "_", 3)
    return spark.read.text(path, wholetext=True).select(F.get(parts, 0).alias("company"), F.get(parts, 1).alias("filed"), F.get(parts, 2).alias("base"), F.col("value").alias("text"))


FACTS = "struct<facts: map<string, map<string, struct<units: map<string, array<struct<`start`: string, `end`: string, val: double, form: string, filed: string>>>>>>>"


def company_facts(json: DataFrame, column: str = "json", company: str = "company") -> DataFrame:
    """Instantaneous US-dollar facts of annual and quarterly reports: ``company, tag, quarter_end, value``.

    The fact filed last wins for each (company, tag, end).
    """
    parsed = json.select(company, F.from_json(column, FACTS).alias("j"))
    tags = parsed.select(company, F.explode("j.facts").alias("taxonomy", "m")).select(company, F.explode("m").alias("tag", "t"))
    rows = tags.select(company, "tag", F.explode(F.coalesce(F.col("t.units")["USD"], F.array())).alias("u"))
    kept = rows.where(F.col("u.start").isNull() & F.col("u.form").isin("10-K", "10-Q"))
    return kept.groupBy(company, "tag", F.to_date("u.end").alias("quarter_end")).agg(F.max_by("u.val", F.struct("u.filed", "u.val")).alias("value"))


def macro_series(df: DataFrame, value_names: tuple[str, ...] = ("gdp", "value", "pib_musd"), date_names: tuple[str, ...] = ("observation_date", "date", "trimestre")) -> DataFrame:
    """A quarterly series whose columns are found by name, whatever their case: ``quarter, value``, the last of each quarter."""
    by = {c.lower(): c for c in df.columns}
    date = next(by[c] for c in date_names if c in by)
    value = next(by[c] for c in value_names if c in by)
    return last_of_quarter(df.select(F.col(date).cast("string").alias("d"), F.col(value).cast("string").try_cast("double").alias("value")))


def quarter_of(d: Column) -> Column:
    return F.concat(F.year(d), F.lit("Q"), F.quarter(d))


def last_of_quarter(df: DataFrame) -> DataFrame:
    quarter = F.when(F.col("d").rlike(r"^\d{4}Q[1-4]$"), F.col("d")).otherwise(quarter_of(F.try_to_date("d")))
    return df.where(F.col("value").isNotNull()).groupBy(quarter.alias("quarter")).agg(F.max_by("value", "d").alias("value"))


def write_series(df: DataFrame, path: str, text: str | None = None, most: int = 900) -> None:
    """CSV sink with a header and quotes; a long text column is cut to ``most`` characters there (not in Parquet)."""
    out = df.withColumn(text, F.substring(text, 1, most)) if text else df
    out.write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"')

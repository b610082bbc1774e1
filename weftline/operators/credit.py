"""Quarterly credit panels keyed by (company, quarter)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .network import average_rank


def quarter_index(q: Column) -> Column:
    """Quarters since year 0 of ``YYYYQn``."""
    return F.substring(q, 1, 4).cast("int") * 4 + F.substring(q, 6, 1).cast("int") - 1


def quarter_name(i: Column) -> Column:
    return F.concat(F.floor(i / 4).cast("int"), F.lit("Q"), (F.pmod(i, F.lit(4)) + 1).cast("int"))


def complete_quarters(df: DataFrame, key: str = "company", qi: str = "qi") -> DataFrame:
    """One row for every quarter from a company's first to its last; columns of absent quarters are null."""
    span = df.groupBy(key).agg(F.min(qi).alias("_a"), F.max(qi).alias("_b"))
    return span.select(key, F.explode(F.sequence("_a", "_b")).alias(qi)).join(df, [key, qi], "left")


def growth(df: DataFrame, value: str, back: int = 12, log: bool = False, key: str = "company", qi: str = "qi") -> Column:
    """Change from ``back`` rows before, on a complete grid (a lag over gaps would compare wrong quarters)."""
    v = F.when(F.col(value) > 0, F.log(value)) if log else F.col(value)
    return v - F.lag(v, back).over(Window.partitionBy(key).orderBy(qi))


def percentile_rank(df: DataFrame, value: str, part: list[str]) -> DataFrame:
    """``pct``: average rank over the number of non-null values."""
    n = F.count(value).over(Window.partitionBy(*part))
    return df.withColumn("pct", average_rank(F.col(value), part) / n)


def red_zone(credit: Column, price: Column, credit_at: float = 0.8, price_at: float = 2 / 3) -> Column:
    return F.coalesce((credit >= credit_at) & (price >= price_at), F.lit(False))


def first_tag(facts: DataFrame, ranks: DataFrame, part: list[str]) -> DataFrame:
    """Of the candidate tags with a value, the one of least rank wins: ``value, tag``. ``ranks`` is a list of some tags."""
    return facts.where(F.col("value").isNotNull()).join(F.broadcast(ranks), "tag").groupBy(*part).agg(F.min_by("value", "rank").alias("value"), F.min_by("tag", "rank").alias("tag"))


def provenance(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def total_debt(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Full outer join of components ``key, value``; ``debt`` is their sum with absent ones as 0."""
    out = None
    for i, p in enumerate(parts):
        p = p.select(*key, F.col("value").alias(f"v{i}"))
        out = p if out is None else out.join(p, key, "full")
    return out.withColumn("debt", sum((F.coalesce(f"v{i}", F.lit(0.0)) for i in range(len(parts))), F.lit(0.0)))


def last_values(df: DataFrame, part: list[str], order: str, columns: list[str]) -> DataFrame:
    """The last non-null value of each column by itself."""
    return df.groupBy(*part).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def chain(df: DataFrame, macro: DataFrame, qi: str = "qi") -> DataFrame:
    """All companies by quarter: sums, number of companies, mean log price, share of output and three-year changes.

    ``df`` is ``company, qi, declared, committed, price``; ``macro`` ``qi, output``.
    """
    s = df.groupBy(qi).agg(F.coalesce(F.sum("declared"), F.lit(0.0)).alias("declared"), F.coalesce(F.sum("committed"), F.lit(0.0)).alias("committed"), F.countDistinct("company").alias("companies"), F.avg(F.when(F.col("price") > 0, F.log("price"))).alias("log_price"))
    s = s.join(macro, qi, "left")
    w = Window.orderBy(qi)  # one row a quarter
    for c in ("declared", "committed"):
        s = s.withColumn(f"{c}_pct", F.try_divide(100 * F.col(c), F.col("output")))
        s = s.withColumn(f"{c}_change", F.col(f"{c}_pct") - F.lag(f"{c}_pct", 12).over(w))
    return s.withColumn("price_change", 100 * (F.col("log_price") - F.lag("log_price", 12).over(w)))


def compare_versions(new: DataFrame, old: DataFrame, key: list[str], value: str) -> DataFrame:
    """``key, status``: match, changed, added or removed between two versions."""
    a, b = new.select(*key, F.col(value).alias("_new"), F.lit(True).alias("_a")), old.select(*key, F.col(value).alias("_old"), F.lit(True).alias("_b"))
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.equal_null("_new", "_old"), "match").otherwise("changed")
    return a.join(b, key, "full").select(*key, status.alias("status"))

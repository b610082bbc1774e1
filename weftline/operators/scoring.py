"""Labels from event intervals and scores of alarms at a fixed budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Demonstration intervals on the calendar of the test tables: (list, name, first day, last day).
INTERVALS = [
    ("core", "spring95", "1995-03-01", "1995-06-15"),
    ("core", "autumn96", "1996-09-01", "1996-12-20"),
    ("core", "summer98", "1998-06-01", "1998-10-15"),
    ("core", "winter00", "2000-01-10", "2000-04-20"),
    ("wide", "spring95", "1995-03-01", "1995-06-15"),
    ("wide", "autumn96", "1996-09-01", "1996-12-20"),
    ("wide", "summer97", "1997-07-01", "1997-09-30"),
    ("wide", "summer98", "1998-06-01", "1998-10-15"),
    ("wide", "winter00", "2000-01-10", "2000-04-20"),
    ("wide", "spring01", "2001-03-01", "2001-05-31"),
]


def intervals(spark) -> DataFrame:
    return spark.createDataFrame(INTERVALS, "list string, name string, first string, last string").select("list", "name", F.to_date("first").alias("first"), F.to_date("last").alias("last"))


def labelled(df: DataFrame, spans: DataFrame, day: str) -> DataFrame:
    """``df`` once for each label list with ``crisis`` and ``episode`` (the first that holds the day, or null).

    Intervals are exploded to days, so the join is on equal days; a list has some thousand days.
    """
    days = spans.select("list", "name", F.explode(F.sequence("first", "last")).alias("_day")).groupBy("list", "_day").agg(F.min("name").alias("episode"))
    lists = spans.select("list").distinct()
    return df.join(F.broadcast(lists)).join(days, (lists["list"] == days["list"]) & (F.col(day) == F.col("_day")), "left").select(*df.columns, lists["list"], "episode", F.col("episode").isNotNull().alias("crisis"))


def thresholded(df: DataFrame, value: str, part: list[str], share: Column | float = 0.9) -> DataFrame:
    """``alarm``: at or above the interpolated quantile of the group."""
    q = df.groupBy(*part).agg(F.percentile(value, share).alias("threshold"))
    return df.join(q, part).withColumn("alarm", F.col(value) >= F.col("threshold"))


def confusion(df: DataFrame, part: list[str]) -> DataFrame:
    """``tp, fp, fn, precision, recall, f1`` of alarm against crisis; 0 where undefined."""
    c = df.groupBy(*part).agg(F.count_if(F.col("alarm") & F.col("crisis")).alias("tp"), F.count_if(F.col("alarm") & ~F.col("crisis")).alias("fp"), F.count_if(~F.col("alarm") & F.col("crisis")).alias("fn"))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return c.withColumn("precision", safe(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("f1", safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def exact_budget(df: DataFrame, value: str, part: list[str], tie: str, share: float = 0.1) -> DataFrame:
    """``alarm`` on exactly floor(share * n) rows of largest value; ties go to the least ``tie``."""
    rank = F.row_number().over(Window.partitionBy(*part).orderBy(F.col(value).desc(), tie))
    n = F.count(F.lit(1)).over(Window.partitionBy(*part))
    return df.withColumn("alarm", rank <= F.floor(n * share))


def precision_recall_area(df: DataFrame, value: str, part: list[str], tie: str) -> DataFrame:
    """``area`` under precision over recall by trapezoids, rows from the largest value down; groups without a crisis have none."""
    w = Window.partitionBy(*part).orderBy(F.col(value).desc(), tie)
    hit = F.col("crisis").cast("int")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    c = df.withColumn("_k", F.row_number().over(w)).withColumn("_tp", F.sum(hit).over(run)).withColumn("_all", F.sum(hit).over(Window.partitionBy(*part))).where("_all > 0")
    c = c.withColumn("_p", F.col("_tp") / F.col("_k")).withColumn("_r", F.col("_tp") / F.col("_all"))
    area = (F.col("_r") - F.lag("_r").over(w)) * (F.col("_p") + F.lag("_p").over(w)) / 2
    return c.withColumn("_a", area).groupBy(*part).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"))


def saturation(df: DataFrame, value: str, part: list[str], most: float = 0.12) -> DataFrame:
    """``flagged, at_max, distinct_share, saturated``: whether a metric can be held to the alarm budget."""
    t = thresholded(df, value, part).join(df.groupBy(*part).agg(F.max(value).alias("_max")), part)
    s = t.groupBy(*part).agg(F.avg(F.col("alarm").cast("double")).alias("flagged"), F.avg((F.col(value) >= F.col("_max") - 1e-12).cast("double")).alias("at_max"), (F.countDistinct(F.round(value, 12)) / F.count(F.lit(1))).alias("distinct_share"))
    return s.withColumn("saturated", F.col("flagged") > most)


def orientation(df: DataFrame, value: str, part: list[str]) -> DataFrame:
    """``sign``: 1 if the mean in crises is above that outside, else -1."""
    m = df.groupBy(*part).agg(F.avg(F.when(F.col("crisis"), F.col(value))).alias("crisis_mean"), F.avg(F.when(~F.col("crisis"), F.col(value))).alias("calm_mean"))
    return m.withColumn("sign", F.when(F.col("crisis_mean") > F.col("calm_mean"), 1).otherwise(-1))


def unexplained(df: DataFrame, part: list[str]) -> DataFrame:
    """Share of alarms in no episode."""
    return df.where("alarm").groupBy(*part).agg(F.count(F.lit(1)).alias("alarms"), F.avg(F.col("episode").isNull().cast("double")).alias("unexplained"))


def supported(df: DataFrame, part: list[str], least_rows: int = 200, least_labels: int = 10) -> DataFrame:
    """Groups with enough rows and enough crises to be scored."""
    return df.groupBy(*part).agg(F.count(F.lit(1)).alias("rows"), F.count_if("crisis").alias("labels")).where((F.col("rows") >= least_rows) & (F.col("labels") >= least_labels))

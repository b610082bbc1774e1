"""A stream's rows for a test, in a memory table."""

from pyspark.sql import DataFrame


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is into a memory table, which the driver holds."""
    spark = df.sparkSession
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)

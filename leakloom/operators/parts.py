"""How many tasks a shuffle gets, by the rows that it moves."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS = 250_000


def spread(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """df (of so many rows) hashed by the keys to tasks of about ROWS rows, and to no fewer tasks than the session's: a task's share does not grow with the input.

    What is grouped or ordered by these keys afterwards needs no other shuffle."""
    spark = df.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(max(least, -(-rows // ROWS)), *keys)

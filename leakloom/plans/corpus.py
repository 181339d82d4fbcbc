"""Files with known credentials and benign look-alikes, made from the orders table by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leakloom.operators.parts import spread

SQL = """
SELECT o_orderkey AS file_id,
  concat('src/', lower(o_orderstatus), '/', CASE o_orderkey % 4 WHEN 0 THEN 'vendor/' ELSE '' END, 'f', CAST(o_orderkey AS {text}),
    CASE o_orderkey % 5 WHEN 0 THEN '.js' WHEN 1 THEN '.py' WHEN 2 THEN '.env' WHEN 3 THEN '.bin' ELSE '.md' END) AS path,
  concat('first line of ', CAST(o_custkey AS {text}), chr(10),
    CASE o_orderkey % 8
      WHEN 0 THEN concat('payload = "gh', 'p_', substr({sha}, 1, 36), '"')
      WHEN 1 THEN concat('password: ''s3', substr({sha}, 1, 12), '''')
      WHEN 2 THEN concat('glued gh', 'p_', substr({sha}, 1, 37))
      WHEN 3 THEN concat('(np', 'm_', substr({sha}, 1, 36), ')')
      WHEN 4 THEN concat('api_key => `', substr({sha}, 1, 32), '`')
      WHEN 5 THEN 'password = process.env.SECRET'
      WHEN 6 THEN concat('url = postgres:', '//user:', substr({sha}, 1, 10), '@host/db')
      ELSE concat('sha256: "', {sha}, '"') END, chr(10),
    'token = "', substr({sha}, 5, 40), '"', chr(10), 'last') AS content
FROM orders
"""


def sql(engine: str) -> str:
    key = "CAST(o_orderkey % 997 AS {})"
    return SQL.format(text="STRING", sha=f"sha2({key.format('STRING')}, 256)") if engine == "spark" else SQL.format(text="VARCHAR", sha=f"sha256({key.format('VARCHAR')})")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(sql("spark").replace("FROM orders", f"FROM parquet.`{sf_dir}/orders.parquet`"))


def spread_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files dealt out by id, for what computes long on each: orders are few bytes a file, so that one task would read millions."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    # the count comes from the files' footers
    return spark.sql(sql("spark").replace("FROM orders", "FROM {orders}"), orders=spread(orders, ["o_orderkey"], orders.count()))

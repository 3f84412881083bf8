"""Loaders and the observation views that the behavioural queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; timestamps without a zone are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    fixed = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(fixed) if fixed else df


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as request observations: system, entity, token, status, bytes and the object touched."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        "ts",
        F.unix_micros("ts").alias("us"),
        F.concat(F.lit("sys"), (F.col("user_id") % 3).cast("string")).alias("system"),
        F.col("user_id").alias("entity"),
        F.col("event_type").alias("token"),
        F.col("value").alias("bytes_up"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.col("event_type").isin("purchase", "signup").alias("is_write"),
        F.get_json_object("props", "$.k").cast("long").alias("object_id"),
    )


#: The same view in DuckDB, to open a WITH clause.
OBS_SQL = """obs AS (
  SELECT event_id, ts, CAST(epoch_us(ts) AS BIGINT) AS us, 'sys' || CAST(user_id % 3 AS VARCHAR) AS system,
         user_id AS entity, event_type AS token, value AS bytes_up,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
         event_type IN ('purchase', 'signup') AS is_write,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS object_id
  FROM events)"""

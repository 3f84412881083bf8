"""The minimum slice: observations -> day ticks -> weighted ratios -> fuzzy rule confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.fuzzy import member_sql, member_at_least
from tidemark.plans.catalog import query
from tidemark.sources.tables import OBS_SQL, observations

_SQL = f"""
WITH {OBS_SQL}, ticks AS (
  SELECT system, entity, CAST(us // 86400000000 + 1 AS BIGINT) * 86400 AS tick,
         COUNT(*) AS requests, SUM(CASE WHEN status >= 500 THEN 1 ELSE 0 END) * 1.0 / COUNT(*) AS rate_5xx
  FROM obs GROUP BY ALL), scored AS (
  SELECT *, CASE WHEN requests > 5 THEN {member_sql('rate_5xx', 0.1, 0.1)} ELSE 0.0 END AS confidence FROM ticks)
SELECT system, entity, tick, CAST(requests AS BIGINT) AS requests, ROUND(rate_5xx, 6) AS rate_5xx,
       ROUND(confidence, 6) AS confidence
FROM scored WHERE confidence >= 0.6
"""


@query("signature_fuzzy_match", _SQL)
def signature_fuzzy_match(spark, sf_dir):
    """Rule "high error backend": more than 5 requests and a 5xx rate of about 0.1 or more, kept from 0.6."""
    ticks = (
        observations(spark, sf_dir)
        .groupBy("system", "entity", ((F.expr("us div 86400000000") + 1) * 86400).alias("tick"))
        .agg(F.count("*").alias("requests"), (F.sum((F.col("status") >= 500).cast("int")) / F.count("*")).alias("rate"))
    )
    confidence = F.when(F.col("requests") > 5, member_at_least(F.col("rate"), 0.1, 0.1)).otherwise(0.0)
    return (
        ticks.withColumn("confidence", confidence)
        .where("confidence >= 0.6")
        .select("system", "entity", "tick", "requests", F.round("rate", 6).alias("rate_5xx"), F.round("confidence", 6).alias("confidence"))
    )

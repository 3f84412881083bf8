"""One statement for Spark and DuckDB.

A plan is a SQL text over named views, written `{obs}`, `{flow}` and so on. Spark gets the views as DataFrames
(so that Catalyst prunes and pushes down through them), DuckDB as common table expressions. The few functions that
are named or behave otherwise are translated for DuckDB here, and nowhere else.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.catalog import query
from tidemark.sources.tables import table

#: The views in the dialect that both share, over the tables as they are stored.
VIEWS = {
    "obs": """
SELECT event_id, us, us / 1e6 AS t, CAST(FLOOR(us / 86400e6) AS BIGINT) AS day, CAST(FLOOR(us / 3600e6) AS BIGINT) AS hour,
       CAST(FLOOR(us / 900e6) AS BIGINT) % 96 AS slot, (CAST(FLOOR(us / 86400e6) AS BIGINT) + 4) % 7 AS dow,
       'sys' || CAST(user_id % 3 AS STRING) AS system, user_id AS entity, event_type AS token, value AS up,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
       CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS is_write, object_id
FROM (SELECT *, EPOCH_US(ts) AS us, CAST(JSON_GET(props, '$.k') AS BIGINT) AS object_id FROM {events}) e""",
    "flow": """
SELECT CAST(FLOOR(EPOCH_US(l_shipdate) / 86400e6) AS BIGINT) AS day, r_name AS system, n_name AS org, c_mktsegment AS class,
       o_custkey AS entity, l_suppkey AS peer, l_partkey AS object_id, CAST(l_quantity AS BIGINT) AS w, l_extendedprice AS up,
       l_extendedprice * (1 - l_discount) AS down, l_linenumber AS dport, l_returnflag AS flag, l_linestatus AS proto
FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey JOIN {customer} c ON o_custkey = c_custkey
JOIN {nation} n ON c_nationkey = n_nationkey JOIN {region} r ON n_regionkey = r_regionkey""",
    "ord": """
SELECT o_orderkey AS id, o_custkey AS entity, CAST(FLOOR(EPOCH_US(o_orderdate) / 86400e6) AS BIGINT) AS day,
       o_totalprice AS amount, o_orderpriority AS priority, o_orderstatus AS state FROM {orders}""",
    "vec": """
SELECT vec_id, label, POS AS dim, CAST(VAL AS DOUBLE) AS x FROM {embeddings}""",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def for_spark(text: str) -> str:
    text = text.replace("EPOCH_US(", "unix_micros(").replace("JSON_GET(", "get_json_object(")
    text = re.sub(r"HEX8\((\w+), (\d+)\)", r"CAST(CONV(SUBSTR(MD5(\1), \2, 8), 16, 10) AS BIGINT)", text)
    return text.replace("GSUB(", "regexp_replace(")


def for_duckdb(text: str) -> str:
    text = text.replace("EPOCH_US(", "epoch_us(").replace("JSON_GET(", "json_extract_string(")
    text = re.sub(r"\bPERCENTILE\(", "quantile_cont(", text)
    text = re.sub(r"HEX8\((\w+), (\d+)\)", r"CAST('0x' || SUBSTR(MD5(\1), \2, 8) AS BIGINT)", text)
    while "GSUB(" in text:  # the innermost first
        text = re.sub(r"GSUB\(((?:(?!GSUB\().)*?), ('[^']*'), ('[^']*')\)", r"regexp_replace(\1, \2, \3, ~)", text, flags=re.DOTALL)
    return text.replace(", ~)", ", 'g')")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return table(spark, sf_dir, name)
    if name == "vec":
        return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "label", "posexplode(embedding) AS (dim, x)").selectExpr("vec_id", "label", "dim", "CAST(x AS DOUBLE) AS x")
    return run(spark, sf_dir, VIEWS[name])


def run(spark: SparkSession, sf_dir: str, text: str, **given) -> DataFrame:
    """The statement over the tables of a folder, or over frames given by name."""
    frames = {n: given.get(n) if n in given else view(spark, sf_dir, n) for n in _names(text)}
    return spark.sql(for_spark(text), **frames)


def oracle(text: str) -> str:
    """The same for DuckDB, with the views it needs in front."""
    ctes = []
    for name in _names(text):
        if name == "vec":
            ctes.append("vec AS (SELECT vec_id, label, CAST(dim AS INTEGER) AS dim, CAST(embedding[dim + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(dim))")
        elif name not in TABLES:
            ctes.append(f"{name} AS ({for_duckdb(VIEWS[name])})")
    text = for_duckdb(text).strip()
    if ctes:
        rest = ", " + text[5:] if text[:5].upper() == "WITH " else " " + text
        text = f"WITH {', '.join(ctes)}{rest}"
    return re.sub(r"\{(\w+)\}", r"\1", text)


def plan(name: str, text: str, own: str | None = None, with_oracle: bool = True) -> None:
    """Registers a statement as a query. Its oracle is `own`, another statement for DuckDB that says the same in another
    way (over the views, translated likewise), or else its DuckDB form."""
    query(name, oracle(own or text) if with_oracle else None)(lambda spark, sf_dir: run(spark, sf_dir, text))

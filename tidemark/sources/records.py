"""Observation records from files, and results to files.

Records are JSON lines, CSV or Parquet with the columns of `SCHEMA`; what a source lacks is NULL. `clean` applies the
ingest rules every passive metric assumes: no empty system or entity, no aggregate rows posing as entities, a
positive integer weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"double": T.DoubleType(), "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "ints": T.ArrayType(T.IntegerType()), "map": T.MapType(T.StringType(), T.StringType())}
_COLUMNS = """
ts double, system string, entity string, peer string, method string, l3_proto string, l4_proto string, src_port int, dst_port int,
bytes_up long, bytes_down long, pkts_up long, pkts_down long, ttl int, tcp_flags string, win_size int, retransmits int, rtt_ms double,
duration_ms double, app_proto string, http_method string, http_host string, http_path string, http_status int, user_agent string,
content_type string, tls_version string, tls_cipher string, tls_sni string, ja3 string, ja3s string, dns_qname string, dns_qtype string,
dns_rcode string, reachability string, banner string, open_ports ints, hop_count int, extra map"""
SCHEMA = T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in _COLUMNS.split(","))])

_PSEUDO = r"^(__system__|__org__|class:.*)$"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; a line that doesn't parse becomes a row of NULLs, which `clean` drops and counts."""
    return spark.read.schema(SCHEMA).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; arrays and maps aren't read from it."""
    flat = T.StructType([f for f in SCHEMA if not isinstance(f.dataType, (T.ArrayType, T.MapType))])
    return _padded(spark.read.option("header", True).option("enforceSchema", False).schema(flat).csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with any of the columns."""
    return _padded(spark.read.parquet(path))


def _padded(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA])


def weight() -> Column:
    """A record's count: 1 unless `extra.count` says otherwise; NULL where that is no positive integer."""
    count = F.expr("try_cast(extra['count'] AS INT)")
    return F.when(F.col("extra").isNull() | ~F.map_contains_key("extra", F.lit("count")), 1).otherwise(F.when(count > 0, count))


def clean(df: DataFrame, passive: bool = True) -> DataFrame:
    """Records that count, with their weight `w`; active probes are left out of the passive ones."""
    kept = df.withColumn("w", weight()).where("system <> '' AND entity <> '' AND w IS NOT NULL AND ts IS NOT NULL AND NOT isnan(ts)")
    kept = kept.where(~F.col("entity").rlike(_PSEUDO))
    return kept.where("method IS NULL OR method <> 'ACTIVE_PROBE'") if passive else kept.where("method = 'ACTIVE_PROBE' AND reachability IS NOT NULL")


def write_findings(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Findings by day (a column `day`), so that retention drops folders; parquet, json or csv."""
    df.write.mode("append").partitionBy("day").format(kind).save(path)

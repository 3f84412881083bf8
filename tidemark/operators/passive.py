"""Raw metrics of passive observation records (`sources.records`), one aggregation per tick, system and entity.

A record stands for `extra.count` records (1 where that is no number, none where it is 0 or less), active probes are left
out, and a metric whose base is empty is null. A number field counts only above 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.net import etld1, normal_host

OTHER, TOP = "__other__", 64
# Which versions count as weak, and which answers as failures.
WEAK = ("SSL2", "SSL2.0", "SSL3", "SSL3.0", "TLS1", "TLS1.0", "TLS1.1")
FAILED = ("NXDOMAIN", "SERVFAIL", "3", "2")
KEY = ["tick", "system", "entity"]


def passive(obs: DataFrame, seconds: int, wanted: Column | None = None) -> DataFrame:
    """The records that count, with their weight `w` and the end of their tick."""
    weight = F.coalesce(F.expr("try_cast(extra['count'] AS DOUBLE)"), F.lit(1.0)).cast("long")
    rows = obs.where(~F.coalesce(F.col("method"), F.lit("")).startswith("ACTIVE")).where("coalesce(system, '') <> '' AND coalesce(entity, '') <> ''")
    if wanted is not None:
        rows = rows.where(wanted)
    return rows.withColumn("w", weight).where("w > 0").withColumn("tick", ((F.floor(F.col("ts") / seconds) + 1) * seconds).cast("double"))


def _positive(name: str) -> Column:
    return F.when((F.col(name) > 0) & (F.col(name).cast("double") < float("inf")), F.col(name))


def _share(condition: Column, base: Column | None = None) -> Column:
    base = F.lit(True) if base is None else base
    return F.sum(F.when(condition & base, F.col("w")).otherwise(0)) / F.nullif(F.sum(F.when(base, F.col("w")).otherwise(0)), F.lit(0))


def _mean(value: Column) -> Column:
    """Weighted over the records that have the value."""
    return F.sum(F.col("w") * value) / F.sum(F.when(value.isNotNull(), F.col("w")))


def _text(name: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))


def link_metrics(obs: DataFrame, seconds: int) -> DataFrame:
    """Packets, bytes, shares of protocols among records that name one, share of IPv6, least ttl."""
    both = lambda kind: F.coalesce(_positive(f"{kind}_up"), F.lit(0)) + F.coalesce(_positive(f"{kind}_down"), F.lit(0))
    l4, l3 = _text("l4_proto"), _text("l3_proto")
    total = F.sum(F.col("w") * both("pkts"))
    return passive(obs, seconds).groupBy(*KEY).agg(
        F.when(total > 0, total).alias("pkts_total"),
        F.sum(F.col("w") * both("bytes")).alias("bytes_total"),
        _share(l4 == "tcp", l4 != "").alias("tcp_ratio"),
        _share(l4 == "udp", l4 != "").alias("udp_ratio"),
        _share(l4.isin("icmp", "icmpv6"), l4 != "").alias("icmp_ratio"),
        _share(l3.isin("ipv6", "ip6"), l3 != "").alias("ipv6_ratio"),
        F.min(F.when(F.col("ttl").between(1, 255), F.col("ttl"))).alias("ttl_min"),
    )


def tls_metrics(obs: DataFrame, seconds: int) -> DataFrame:
    """Handshakes, names, the share of weak versions, and the mean time of a handshake: its own, or the duration of a
    record that no protocol above TLS is known of."""
    app = _text("app_proto")
    wanted = (_text("tls_version") != "") | (_text("tls_sni") != "") | app.isin("tls", "https", "ssl")
    version = F.regexp_replace(F.upper(_text("tls_version")), "[ _V]", "")
    own = F.expr("try_cast(extra['handshake_ms'] AS DOUBLE)")
    took = F.coalesce(F.when(own > 0, own), F.when(app.isin("", "tls", "https", "ssl"), _positive("duration_ms")))
    return passive(obs, seconds, wanted).groupBy(*KEY).agg(
        F.sum("w").alias("handshakes"),
        F.count_distinct(F.nullif(normal_host(F.col("tls_sni")), F.lit(""))).alias("distinct_sni"),
        _share(version.isin(*WEAK), version != "").alias("weak_version_ratio"),
        _mean(took).alias("handshake_ms_avg"),
    )


def dns_metrics(obs: DataFrame, seconds: int) -> DataFrame:
    """Queries, names, shares of failed and of TXT queries, mean length of the names."""
    name = F.nullif(normal_host(F.col("dns_qname")), F.lit(""))
    text = F.upper(_text("dns_qtype")).isin("TXT", "16")
    return passive(obs, seconds, (_text("app_proto") == "dns") | (_text("dns_qname") != "")).groupBy(*KEY).agg(
        F.sum("w").alias("queries"),
        F.count_distinct(name).alias("distinct_qnames"),
        _share(F.upper(_text("dns_rcode")).isin(*FAILED)).alias("nxdomain_ratio"),
        F.sum(F.when(text, F.col("w")).otherwise(0)).alias("txt_count"),
        _share(text).alias("txt_ratio"),
        _mean(F.char_length(name)).alias("avg_qname_len"),
    )


def top_values(obs: DataFrame, value: Column, seconds: int, wanted: Column | None = None, most: int = TOP) -> DataFrame:
    """value, n of the `most` heaviest values (ties by value) of each tick, system and entity, the rest as one."""
    counts = passive(obs, seconds, wanted).withColumn("value", value).where("coalesce(value, '') <> ''").groupBy(*KEY, "value").agg(F.sum("w").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("n"), "value"))
    return counts.withColumn("value", F.when(rank <= most, F.col("value")).otherwise(OTHER)).groupBy(*KEY, "value").agg(F.sum("n").alias("n"))


def tls_sets(obs: DataFrame, seconds: int) -> DataFrame:
    """Top values of names, their domains, fingerprints and ciphers, each under its `metric`."""
    kinds = {"sni_set": normal_host(F.col("tls_sni")), "sni_etld1_set": etld1(F.col("tls_sni")), "ja3_set": _text("ja3"), "ja3s_set": _text("ja3s"), "cipher_set": F.trim("tls_cipher")}
    return _stacked(obs, seconds, kinds)


def dns_sets(obs: DataFrame, seconds: int) -> DataFrame:
    """Top values of queried names, their domains and query types, each under its `metric`."""
    return _stacked(obs, seconds, {"qname_set": normal_host(F.col("dns_qname")), "qname_etld1_set": etld1(F.col("dns_qname")), "qtype_set": F.upper(F.trim("dns_qtype"))})


def http_sets(obs: DataFrame, seconds: int) -> DataFrame:
    """Top values of methods, paths, user agents and content types, each under its `metric`."""
    return _stacked(obs, seconds, {"methods": F.upper(F.trim("http_method")), "top_paths": F.col("http_path"), "user_agents": F.trim("user_agent"), "content_types": _text("content_type")})


def _stacked(obs: DataFrame, seconds: int, kinds: dict[str, Column]) -> DataFrame:
    """One pass: each record gives a row for each kind it has a value of."""
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in kinds.items()]))
    rows = passive(obs, seconds).select(*KEY, "w", every.alias("e")).select(*KEY, "w", "e.*").where("coalesce(value, '') <> ''")
    key = [*KEY, "metric"]
    counts = rows.groupBy(*key, "value").agg(F.sum("w").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "value"))
    return counts.withColumn("value", F.when(rank <= TOP, F.col("value")).otherwise(OTHER)).groupBy(*key, "value").agg(F.sum("n").alias("n"))

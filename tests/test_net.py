"""Scalars on the cases that their rules name; passive metrics on rows made by hand."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import net
from tidemark.operators import passive

MASKS = {
    "v2": "v2", "123e4567-e89b-12d3-a456-426614174000": "{uuid}", "a%40b.com": "{email}", "a@b.org": "{email}", "2024-01-15": "{date}", "2024-01-15T10:30:00Z": "{date}",
    "2024_1_5": "{date}", "2024-02": "{date}", "15.01.2024": "{date}", "20240115": "{date}", "20241399": "{num}", "20240115T1030Z": "{date}", "deadbeefdeadbeef1": "{hex}",
    "1234567890123456789": "{num}", "42": "{num}", "order123456": "{id}", "abcdefgh": "abcdefgh", "getUserProfileByEmail": "getUserProfileByEmail",
    "customer-relationship-management": "customer-relationship-management", "jquery-3.6.0.min.js": "jquery-3.6.0.min.js", "12345.jpg": "{num}.jpg", "a|b": "a%7Cb", "aB3_xY7-kQ9zR2mW5": "{tok}", "": "",
}


def over(spark, values, make):
    df = spark.createDataFrame([Row(i=i, v=v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_masks(spark):
    assert dict(zip(MASKS, over(spark, list(MASKS), net.mask_segment))) == MASKS


def test_paths_and_queries(spark):
    paths = ["/a//b/", "http://h:80/u/42/x;jsessionid=1?q=1#f", "/1/2/3/4/5/6/7/8", "", None, "/"]
    assert over(spark, paths, net.mask_path) == ["/a/b", "/u/{num}/x", "/" + "/".join(["{num}"] * 6) + "/{var}", "/", "/", "/"]
    assert over(spark, ["/x?b=1&a=2&b=3&1699999999=1#z", "/x", None], net.query_names) == [["a", "b", "{num}"], [], []]


def test_addresses_and_hosts(spark):
    v = ["10.1.2.3", "2001:DB8::1", "2001:db8:0:1:2:3:4:5", "::1", "host.example", "256.1.1.1", "1::2::3", None]
    assert over(spark, v, lambda c: net.ip_prefix(c, 1)) == ["10.1.2.0/24", "2001:db8::/64", "2001:db8:0:1::/64", "::/64", "host.example", "256.1.1.1", "1::2::3", ""]
    assert over(spark, v[:4], lambda c: net.ip_prefix(c, 2)) == ["10.1.0.0/16", "2001:db8::/48", "2001:db8::/48", "::/48"]
    assert over(spark, v, net.is_ip) == [True, True, True, True, False, False, False, False]
    hosts = ["HTTPS://A.B.Example.com.cn:8443/x", "x.cdn.example.com.", "[2001:db8::1]:443", "10.0.0.1:80", "single", "", None, "co.uk"]
    assert over(spark, hosts, net.etld1) == ["example.com.cn", "example.com", "2001:db8::1", "10.0.0.1", "single", "", "", "co.uk"]
    assert over(spark, ["a3f9c2.k8s7d6f5.mail.example.com", "www.example.com", ""], net.dns_template) == ["{rnd}.mail.example.com", "www.example.com", "."]


def test_tokens_and_stacks(spark):
    one = spark.range(1)
    lit = F.lit
    row = one.select(
        net.l4_token(lit("TCP"), lit(22), lit(5000), lit(600)).alias("l4"), net.l4_token(lit(None), lit(70000), lit(None), lit(1)).alias("none"),
        net.tls_token(lit("api.example.com"), lit(443), lit(1024), lit(0)).alias("tls"), net.dns_token(lit("28"), lit("www.example.com")).alias("dns"), net.dns_token(lit("300"), lit("")).alias("odd"),
        *[net.ttl_class(lit(t)).alias(f"t{t}") for t in (0, 32, 33, 128, 129)], *[net.win_class(lit(w)).alias(f"w{w}") for w in (0, 1, 1024, 1025, 65535, 1 << 30)],
        net.status_class(lit(404)).alias("s4"), net.status_class(lit(700)).alias("s7"),
    ).first()
    assert row[:5] == ("tcp/ssh u12/d9", "ip/0 u0/d0", "example.com:443 u10/d0", "AAAA www.example.com", "TYPE300 .")
    assert row[5:10] == (0, 32, 64, 128, 255) and row[10:16] == ("w0", "w10", "w10", "w11", "w16", "w20") and row[16:] == ("4xx", "0xx")
    chrome = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/126.0.0.0 Safari/537.36"
    agents = [chrome + " Edg/125.0", chrome, "Mozilla/5.0 (X11; Linux x86_64; rv:9.0) Gecko/2 Firefox/109.0", "curl/8.1", "", "thing", "python-requests/2.31"]
    assert [tuple(x) for x in over(spark, agents, net.ua_parse)] == [("edge", "125", "win"), ("chrome", "126", "win"), ("firefox", "109", "linux"), ("curl", "8", None), ("none", "0", None), ("other", "0", None), ("python-requests", "2", None)]
    assert one.select(net.stack_token(lit(" ABC "), lit("curl/8.1"), lit(60), lit(29200))).first()[0] == "abc|curl/8|linux|64|w15"


def observations(spark, rows):
    from tidemark.sources.records import SCHEMA

    return spark.createDataFrame([tuple(r.get(f.name) for f in SCHEMA) for r in rows], SCHEMA)


BASE = {"ts": 10.0, "system": "s", "entity": "e", "method": "PASSIVE_FLOW"}


def test_passive_metrics(spark):
    flow = [BASE | {"l3_proto": "ipv4", "l4_proto": "tcp", "pkts_up": 2, "pkts_down": 1, "bytes_up": 100, "bytes_down": 50, "ttl": 60, "extra": {"count": "2"}}, BASE | {"l3_proto": "ipv6", "l4_proto": "icmpv6", "pkts_up": 1, "ttl": 300}, BASE | {"l4_proto": "tcp", "extra": {"count": "0"}}, BASE | {"method": "ACTIVE_PROBE", "pkts_up": 9}]
    r = passive.link_metrics(observations(spark, flow), 60).first()
    assert (r.pkts_total, r.bytes_total, r.ttl_min) == (7, 300, 60) and (r.tcp_ratio, r.icmp_ratio, r.ipv6_ratio) == pytest.approx((2 / 3, 1 / 3, 1 / 3))
    tls = [BASE | {"tls_version": "TLSv1.0", "tls_sni": "A.Example.com."}, BASE | {"tls_version": "TLS 1.3", "tls_sni": "a.example.com", "extra": {"count": "3", "handshake_ms": "20"}}, BASE | {"app_proto": "https", "duration_ms": 40.0}, BASE | {"app_proto": "http", "http_method": "GET"}]
    r = passive.tls_metrics(observations(spark, tls), 60).first()
    assert (r.handshakes, r.distinct_sni) == (5, 1) and (r.weak_version_ratio, r.handshake_ms_avg) == pytest.approx((1 / 4, 25.0))
    dns = [BASE | {"dns_qname": "A.b.com.", "dns_qtype": "TXT", "dns_rcode": "nxdomain"}, BASE | {"app_proto": "dns", "dns_qname": "a.b.com", "dns_qtype": "A", "dns_rcode": "NOERROR", "extra": {"count": "3"}}, BASE | {"app_proto": "http"}]
    r = passive.dns_metrics(observations(spark, dns), 60).first()
    assert (r.queries, r.distinct_qnames, r.txt_count) == (4, 1, 1) and (r.nxdomain_ratio, r.txt_ratio, r.avg_qname_len) == pytest.approx((0.25, 0.25, 7.0))
    top = passive.top_values(observations(spark, [BASE | {"dst_port": p} for p in range(70) for _ in range(1 + (p < 3))]), F.col("dst_port").cast("string"), 60).collect()
    assert len(top) == 65 and {x.value: x.n for x in top}["__other__"] == 6 and sum(x.n for x in top) == 73
    assert passive.tls_metrics(observations(spark, []), 60).count() == 0


def test_crowded_places_of_a_tree(spark):
    from tidemark.operators.urls import templates

    paths = [f"/u/n{k}name/x" for k in range(50) for _ in range(3)] + ["/u/7/x"] * 3 + ["/a/b/c/d"] * 3 + ["/once"] + [""]
    rows = spark.createDataFrame([(i, "h", p) for i, p in enumerate(paths)], "i int, host string, p string").withColumn("segs", net.path_segments(F.col("p")))
    got = [r.template for r in templates(rows, ["host"], "segs", depth=3).orderBy("i").collect()]
    assert set(got[:153]) == {"/u/{var}/x"} and got[153:] == ["/a/b/c/{var}"] * 3 + ["/{var}", "/"]

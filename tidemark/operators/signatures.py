"""The rule library as data: rules and composites from text or YAML, judged over snapshots of metrics.

A snapshot has `system`, `entity`, `ts` and `metrics`, a map from metric name to number. All rules are one projection of
built-in expressions; each row then gives a row for each rule that matches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fuzzy import member_at_least, member_at_most
from tidemark.plans.catalog import query
from tidemark.plans.dialect import VIEWS, for_duckdb, run

LEAST = 0.6

# Ids, categories, severities and thresholds of the rules, which results have to agree with. A line is
# id (category, severity) ALL: ... | ANY: ... | NONE: ..., a condition `metric op value ~softness`.
LIBRARY = """
interactive_browse (browse, info) ALL: http.requests > 3 ~3, http.get_ratio >= 0.6 ~0.2, derived.path_entropy >= 0.4 ~0.3 | ANY: derived.think_time_s_avg > 2, derived.req_per_session between [2; 60] | NONE: derived.periodicity_score > 0.75
search_query (search, info) ALL: http.requests > 5 ~4, http.get_ratio >= 0.5 ~0.2, http.resp_bytes_avg < 20000 ~10000, derived.path_entropy < 0.5 ~0.2
form_submit_write (write, low) ALL: http.write_ratio >= 0.3 ~0.15, http.requests > 2 ~3, http.req_bytes_avg < 50000 ~20000, http.resp_bytes_avg < 100000 ~50000 | NONE: l4.bytes_up > 500000
api_client (api, info) ALL: http.requests > 12 ~6, derived.path_entropy < 0.35 ~0.2, http.resp_bytes_avg < 200000 | ANY: derived.timing_regularity >= 0.6 ~0.2, derived.dest_concentration >= 0.7 ~0.2
system_integration (integration, info) ALL: derived.dest_concentration >= 0.8 ~0.15, derived.http_success_rate >= 0.9 ~0.1, derived.timing_regularity >= 0.5 ~0.2, http.requests > 8 ~4, http.post_ratio >= 0.25 ~0.2 | NONE: l4.bytes_up > 800000
auth_login (auth, low) ALL: http.post_ratio >= 0.3 ~0.2, http.requests between [1; 30], http.resp_bytes_avg < 8000 ~6000
auth_bruteforce (auth, high) ALL: http.post_ratio >= 0.5 ~0.2, http.requests > 30 ~20, derived.http_error_rate >= 0.4 ~0.2
bulk_download (transfer, medium) ALL: l4.bytes_down > 5000000 ~3000000, derived.upload_dominance < 0.2 ~0.15
bulk_upload (transfer, high) ALL: l4.bytes_up > 3000000 ~2000000, derived.upload_dominance > 3 ~2 | NONE: derived.timing_regularity >= 0.8
large_object_fetch (transfer, low) ALL: http.resp_bytes_avg > 1000000 ~800000
streaming_media (streaming, info) ALL: l4.flow_duration_ms_avg > 20000 ~15000, derived.upload_dominance < 0.3 ~0.2, l4.bytes_down > 2000000 ~1500000
port_scan (scan, high) ALL: l4.distinct_dports > 20 ~15, l4.syn_count > 20 ~15 | ANY: l4.flow_duration_ms_avg < 200, derived.http_error_rate >= 0.5
host_sweep (recon, high) ALL: l4.distinct_peers > 30 ~20, derived.fanout > 30 ~20, derived.peer_novelty >= 0.5 ~0.3
web_path_fuzzing (scan, high) ALL: http.distinct_paths > 40 ~30, derived.path_entropy >= 0.7 ~0.2, derived.http_error_rate >= 0.4 ~0.2
c2_beacon (beacon, high) ALL: derived.timing_regularity >= 0.8 ~0.15, derived.dest_concentration >= 0.85 ~0.1, http.resp_bytes_avg < 3000 ~2000, http.requests <= 10 ~5 | ANY: derived.periodicity_score >= 0.5, derived.timing_regularity >= 0.9 | NONE: http.write_ratio >= 0.4
dns_tunnel (tunnel, critical) ALL: dns.avg_qname_len > 40 ~20, derived.dns_dga_score >= 3.0 ~1.0 | ANY: dns.txt_ratio >= 0.3, dns.nxdomain_ratio >= 0.3
dga_resolution (tunnel, high) ALL: derived.dns_name_entropy >= 0.75 ~0.15, dns.distinct_qnames > 15 ~10, dns.nxdomain_ratio >= 0.25 ~0.2
weak_tls (posture, medium) ALL: tls.weak_version_ratio >= 0.3 ~0.2, tls.handshakes > 1
service_degraded (health, medium) ANY: probe.loss_ratio >= 0.3 ~0.2, probe.reachable <= 0.5 ~0.3
high_error_backend (health, medium) ALL: derived.http_5xx_rate >= 0.1 ~0.1, http.requests > 5
tcp_health_poor (health, low) ANY: l4.retransmit_rate >= 0.05 ~0.05, l4.rtt_ms_avg > 300 ~200
health_check (maintenance, info) ALL: derived.timing_regularity >= 0.8 ~0.1, http.resp_bytes_avg < 2000 ~1500, http.requests between [1; 60], derived.path_entropy < 0.2 ~0.15 | NONE: l4.bytes_up > 500000
backup_sync (sync, info) ALL: l3.bytes_total > 10000000 ~5000000, derived.timing_regularity >= 0.6 ~0.2, derived.dest_concentration >= 0.7 ~0.2
admin_operation (admin, low) ALL: http.write_ratio >= 0.4 ~0.2, derived.dest_concentration >= 0.6 ~0.2, http.requests between [4; 80], http.distinct_paths >= 2, http.resp_bytes_avg < 200000 | NONE: l4.bytes_up > 800000
"""
# The composites, id, order or not, categories, seconds.
COMPOSITES = """
staging_then_exfil sequence auth,transfer 600
recon_then_scan sequence recon,scan 600
beacon_with_tunnel cooccur beacon,tunnel 900
scan_then_bruteforce sequence scan,auth 900
admin_then_bulk sequence admin,transfer 900
"""

_NAMES = {">": "gt", ">=": "ge", "<": "lt", "<=": "le", "=": "eq", "!=": "ne"}


@dataclass(frozen=True)
class Test:
    metric: str
    op: str
    value: object = None
    soft: float = 0.0

    def member(self, metrics: Column) -> Column:
        """0 to 1; 0 where the metric is absent."""
        x, v = F.element_at(metrics, F.lit(self.metric)), self.value
        if self.op == "present":
            return F.when(x.isNotNull(), 1.0).otherwise(0.0)
        if self.soft and self.op in ("gt", "ge"):
            return member_at_least(x, float(v), float(self.soft))
        if self.soft and self.op in ("lt", "le"):
            return member_at_most(x, float(v), float(self.soft))
        crisp = {
            "gt": lambda: x > v, "ge": lambda: x >= v, "lt": lambda: x < v, "le": lambda: x <= v, "eq": lambda: F.abs(x - v) < 1e-9, "ne": lambda: F.abs(x - v) >= 1e-9,
            "between": lambda: x.between(v[0], v[1]), "in": lambda: x.isin(*v), "not_in": lambda: ~x.isin(*v),
        }
        if self.op not in crisp:
            raise ValueError(f"no operator {self.op}")
        return F.coalesce(F.when(crisp[self.op](), 1.0), F.lit(0.0))


@dataclass(frozen=True)
class Signature:
    id: str
    category: str
    severity: str = "info"
    all: tuple[Test, ...] = ()
    any: tuple[Test, ...] = ()
    none: tuple[Test, ...] = ()
    weight: float = 1.0
    scope: tuple[str, ...] = ()

    def confidence(self, metrics: Column) -> Column:
        """The mean of ALL times the largest of ANY times the weight (1.5 at most), 1 at most; 0 if a NONE reaches 0.5, or
        an ALL, or every ANY, is 0."""
        every, some, never = ([t.member(metrics) for t in group] for group in (self.all, self.any, self.none))
        score = F.lit(min(self.weight, 1.5))
        fails = F.lit(False)
        if every:
            score = score * sum(every[1:], every[0]) / len(every)
            fails = fails | (F.least(*every) <= 1e-6 if len(every) > 1 else every[0] <= 1e-6)
        if some:
            best = F.greatest(*some) if len(some) > 1 else some[0]
            score, fails = score * best, fails | (best <= 1e-6)
        for m in never:
            fails = fails | (m >= 0.5)
        return F.when(fails, 0.0).otherwise(F.least(score, F.lit(1.0)))


@dataclass(frozen=True)
class Composite:
    id: str
    ordered: bool
    categories: tuple[str, ...]
    seconds: int


def parse(text: str = LIBRARY) -> list[Signature]:
    """Rules of the compact notation."""
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        name, category, severity, rest = re.fullmatch(r"(\w+) \((\w+), (\w+)\) (.*)", line).groups()
        groups = {"ALL": [], "ANY": [], "NONE": []}
        for group in rest.split(" | "):
            kind, _, tests = group.partition(": ")
            for test in tests.split(", "):
                metric, op, value, soft = re.fullmatch(r"(\S+) (\S+) (\[.*\]|\S+)(?: ~(\S+))?", test).groups()
                value = [float(x) for x in value.strip("[]").split(";")] if value[0] == "[" else float(value)
                groups[kind].append(Test(metric, _NAMES.get(op, op), value, float(soft or 0)))
        out.append(Signature(name, category, severity, *map(tuple, groups.values())))
    return out


def parse_composites(text: str = COMPOSITES) -> list[Composite]:
    rows = [line.split() for line in text.splitlines() if line.strip()]
    return [Composite(name, kind == "sequence", tuple(categories.split(",")), int(seconds)) for name, kind, categories, seconds in rows]


def load(path: str) -> tuple[list[Signature], list[Composite]]:
    """Rules and composites of a YAML file, a list of maps: those with `sequence` or `cooccur` are composites. A rule that
    isn't whole is an error."""
    import yaml

    rules, composites = [], []
    with open(path, encoding="utf-8") as f:
        for item in yaml.safe_load(f) or []:
            if "sequence" in item or "cooccur" in item:
                composites.append(Composite(item["id"], "sequence" in item, tuple(item.get("sequence") or item["cooccur"]), int(item["window_s"])))
                continue
            groups = [tuple(Test(t["metric"], t["op"], t.get("value"), float(t.get("soft") or 0)) for t in item.get(g) or ()) for g in ("all", "any", "none")]
            if not (groups[0] or groups[1]):
                raise ValueError(f"rule {item['id']} has no condition that could hold")
            rules.append(Signature(item["id"], item["category"], item.get("severity", "info"), *groups, float(item.get("weight", 1.0)), tuple(item.get("scope") or ())))
    return rules, composites


def matches(snapshots: DataFrame, rules: list[Signature], least: float = LEAST, observed: DataFrame | None = None) -> DataFrame:
    """system, entity, ts, rule, category, severity, confidence of each rule that a snapshot meets within its scope. With
    `observed` (system, entity, ts), only of entities that have a record in that tick."""
    if observed is not None:
        snapshots = snapshots.join(observed, ["system", "entity", "ts"], "left_semi")
    rows = []
    for r in rules:
        score = r.confidence(F.col("metrics"))
        if r.scope:
            score = F.when(F.col("system").isin(*r.scope), score).otherwise(0.0)
        rows.append(F.struct(F.lit(r.id).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), score.alias("confidence")))
    found = F.explode(F.filter(F.array(*rows), lambda x: x["confidence"] >= least))
    return snapshots.select("system", "entity", "ts", found.alias("hit__")).select("system", "entity", "ts", "hit__.*")


def composites(found: DataFrame, wanted: list[Composite]) -> DataFrame:
    """system, entity, ts, composite, confidence: where all categories occur within the seconds before a match, in their
    order if it is a sequence; the product of their best confidences, once for each stretch of that many seconds.

    One sort for each entity serves all composites: they are windows over the matches, no joins."""
    out, exprs = [], []
    for c in wanted:
        w = Window.partitionBy("system", "entity").orderBy("ts").rangeBetween(-c.seconds, 0)
        first = [F.min(F.when(F.col("category") == k, F.col("ts"))).over(w) for k in c.categories]
        best = [F.max(F.when(F.col("category") == k, F.col("confidence"))).over(w) for k in c.categories]
        holds = F.lit(True)
        for a, b in zip(first, first[1:]):
            holds = holds & (a <= b if c.ordered else a.isNotNull() & b.isNotNull())
        product = best[0]
        for b in best[1:]:
            product = product * b
        exprs.append(F.when(holds, product).alias(f"c{len(exprs)}"))
    judged = found.withColumn("ts", F.col("ts").cast("long")).select("system", "entity", "ts", *exprs)
    out = F.explode(F.array(*[F.struct(F.lit(c.id).alias("composite"), F.lit(c.seconds).alias("seconds"), F.col(f"c{k}").alias("confidence")) for k, c in enumerate(wanted)]))
    rows = judged.select("system", "entity", "ts", out.alias("hit__")).select("system", "entity", "ts", "hit__.*").where("confidence IS NOT NULL")
    first = F.min(F.struct("ts", (-F.col("confidence")).alias("less")))
    held = rows.groupBy("system", "entity", "composite", F.floor(F.col("ts") / F.col("seconds")).alias("bucket")).agg(first.alias("f"))
    return held.select("system", "entity", F.col("f.ts").alias("ts"), "composite", (-F.col("f.less")).alias("confidence"))


_DAY = """
WITH n AS (SELECT system, entity, day, object_id, COUNT(*) AS n FROM {obs} o GROUP BY system, entity, day, object_id),
e AS (SELECT system, entity, day, LN(SUM(n)) - SUM(n * LN(n)) / SUM(n) AS h, COUNT(*) AS paths, CAST(MAX(n) AS DOUBLE) / SUM(n) AS top FROM n GROUP BY system, entity, day),
m AS (SELECT system, entity, day, CAST(COUNT(*) AS DOUBLE) AS requests, AVG(CAST(is_write AS DOUBLE)) AS writes, AVG(up) * 1000 AS down, AVG(CASE WHEN status >= 500 THEN 1e0 ELSE 0e0 END) AS failed, SUM(up) * 50000 AS bytes FROM {obs} o GROUP BY system, entity, day)
SELECT m.system, CAST(m.entity AS STRING) AS entity, m.day * 86400 AS ts, requests, writes, down, failed, bytes, CASE WHEN paths > 1 THEN h / LN(paths) ELSE 0e0 END AS spread, top, CAST(paths AS DOUBLE) AS paths
FROM m JOIN e ON m.system = e.system AND m.entity = e.entity AND m.day = e.day"""
#: Metrics that the test requests give a value for; two columns may be one metric less another.
_GIVEN = {
    "http.requests": "requests", "http.write_ratio": "writes", "http.post_ratio": "writes", "http.get_ratio": "1 - writes", "http.resp_bytes_avg": "down", "http.req_bytes_avg": "down", "http.distinct_paths": "paths",
    "derived.path_entropy": "spread", "derived.dest_concentration": "top", "derived.http_error_rate": "failed", "derived.http_5xx_rate": "failed", "derived.http_success_rate": "1 - failed", "l4.bytes_up": "bytes", "probe.loss_ratio": "failed",
}


def _clamped(t: Test) -> str:
    """A membership for DuckDB, as a clamped ramp over a column of its own."""
    if t.metric not in _GIVEN:
        return "0"
    x = f"({_GIVEN[t.metric]})"
    if t.op == "between":
        return f"({x} >= {t.value[0]} AND {x} <= {t.value[1]})::INT"
    if t.soft:
        side = f"({x} - {t.value} + {t.soft})" if t.op in ("gt", "ge") else f"({t.value} + {t.soft} - {x})"
        return f"greatest(0, least(1, {side} / {t.soft}::DOUBLE))"
    return f"({x} { {'gt': '>', 'ge': '>=', 'lt': '<', 'le': '<='}[t.op]} {t.value})::INT"


def _own(rules: list[Signature]) -> str:
    parts = []
    for r in rules:
        every, some, never = (f"[{', '.join(map(_clamped, g))}]::DOUBLE[]" for g in (r.all, r.any, r.none))
        parts.append(f"SELECT system, entity, ts, '{r.id}' AS rule, {every} AS a, {some} AS s, {never} AS n FROM d")
    return f"""WITH obs AS ({for_duckdb(VIEWS["obs"]).replace("{events}", "events")}), d AS ({for_duckdb(_DAY).replace("{obs}", "obs")}), p AS ({" UNION ALL ".join(parts)}),
c AS (SELECT system, entity, ts, rule, CASE WHEN list_max(n) >= 0.5 OR list_min(a) <= 1e-6 OR list_max(s) <= 1e-6 THEN 0 ELSE COALESCE(list_avg(a), 1) * COALESCE(list_max(s), 1) END AS c FROM p)
SELECT system, entity, ts, rule, ROUND(c, 6) AS confidence FROM c WHERE c >= {LEAST}"""


def snapshots(spark, sf_dir: str) -> DataFrame:
    """A snapshot for each user and day of the test requests."""
    metrics = F.create_map(*[x for name, e in _GIVEN.items() for x in (F.lit(name), F.expr(e))])
    return run(spark, sf_dir, _DAY).select("system", "entity", "ts", metrics.alias("metrics"))


@query("signature_library", _own(parse()))
def signature_library(spark, sf_dir):
    """All rules of the library over the snapshots of the test requests."""
    return matches(snapshots(spark, sf_dir), parse()).select("system", "entity", "ts", "rule", F.round("confidence", 6).alias("confidence"))

"""The rule language: conditions, fuzzy bands, NONE/ALL/ANY, composites, and how matches are counted.

A rule is data: conditions on metrics of a tick. `rule_sql` compiles all rules into one projection, so that a set
of rules costs one pass; a composite looks back over primitive matches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from tidemark.functions.fuzzy import member_sql
from tidemark.plans.dialect import plan


@dataclass(frozen=True)
class Condition:
    """`metric op value`; `soft` widens ge and le by a linear ramp."""

    metric: str
    op: str
    value: object = None
    soft: float = 0.0

    def sql(self) -> str:
        m, v = self.metric, self.value
        if self.op in ("ge", "gt"):
            if self.soft:
                return f"COALESCE({member_sql(m, v, self.soft)}, 0e0)".replace("1.0", "1e0").replace("0.0 ", "0e0 ")
            return self._crisp(f"{m} {'>=' if self.op == 'ge' else '>'} {v}")
        if self.op in ("le", "lt"):
            if self.soft:
                return f"(CASE WHEN {m} <= {v} THEN 1e0 WHEN {m} <= {v + self.soft} THEN ({v + self.soft} - {m}) / {self.soft}e0 ELSE 0e0 END)"
            return self._crisp(f"{m} {'<=' if self.op == 'le' else '<'} {v}")
        if self.op == "between":
            return self._crisp(f"{m} BETWEEN {v[0]} AND {v[1]}")
        if self.op in ("in", "not_in"):
            inside = ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in v)
            return self._crisp(f"{m} {'NOT IN' if self.op == 'not_in' else 'IN'} ({inside})")
        if self.op in ("eq", "ne"):
            return self._crisp(f"ABS({m} - {v}) {'<=' if self.op == 'eq' else '>'} 1e-9")
        if self.op == "present":
            return self._crisp(f"{m} IS NOT NULL")
        raise ValueError(f"no operator {self.op}")

    @staticmethod
    def _crisp(test: str) -> str:
        return f"(CASE WHEN {test} THEN 1e0 ELSE 0e0 END)"


@dataclass(frozen=True)
class Rule:
    """Score: mean of ALL times the largest of ANY times weight, at most 1; 0 if a NONE holds or an ALL fails."""

    id: str
    category: str
    all: list = field(default_factory=list)
    any: list = field(default_factory=list)
    none: list = field(default_factory=list)
    weight: float = 1.0

    def sql(self) -> str:
        every, some, never = ([c.sql() for c in g] for g in (self.all, self.any, self.none))
        fails = [f"{c} >= 0.5" for c in never] + [f"{c} <= 1e-6" for c in every]
        if some:
            fails.append(" AND ".join(f"{c} <= 1e-6" for c in some))
        mean = f"({' + '.join(every)}) / {len(every)}e0" if every else "1e0"
        best = (f"GREATEST({', '.join(some)})" if len(some) > 1 else some[0]) if some else "1e0"
        score = f"LEAST(1e0, {mean} * {best} * {min(self.weight, 1.5)}e0)"
        return f"CASE WHEN {' OR '.join(f'({f})' for f in fails)} THEN 0e0 ELSE {score} END" if fails else score


#: Request rules over the metrics of a user's day.
RULES = [
    Rule("interactive_browse", "browse", all=[Condition("requests", "ge", 3, 2.0), Condition("write_ratio", "le", 0.5, 0.25)], none=[Condition("rate_5xx", "ge", 0.5)]),
    Rule("form_submit_write", "write", all=[Condition("write_ratio", "ge", 0.4, 0.2)], any=[Condition("requests", "ge", 2), Condition("signups", "ge", 1)]),
    Rule("auth_login", "auth", all=[Condition("signups", "ge", 1)], none=[Condition("requests", "lt", 2)]),
    Rule("auth_bruteforce", "auth", all=[Condition("signups", "ge", 3, 1.0), Condition("rate_5xx", "ge", 0.2, 0.2)]),
    Rule("high_error_backend", "health", all=[Condition("requests", "gt", 5), Condition("rate_5xx", "ge", 0.1, 0.1)]),
    Rule("service_degraded", "health", all=[Condition("rate_5xx", "between", (0.05, 0.6)), Condition("requests", "ge", 4, 2.0)]),
    Rule("bulk_download", "transfer", all=[Condition("bytes_up", "ge", 300, 100.0)], any=[Condition("distinct_paths", "le", 2), Condition("requests", "ge", 4)]),
    Rule("api_client", "api", all=[Condition("distinct_paths", "ge", 4, 2.0), Condition("tokens", "ge", 3, 1.0)], weight=1.2),
    Rule("health_check", "health", all=[Condition("distinct_paths", "eq", 1), Condition("write_ratio", "eq", 0)]),
]

_METRICS = """
SELECT system, entity, day, COUNT(*) AS requests, AVG(CASE WHEN status >= 500 THEN 1e0 ELSE 0e0 END) AS rate_5xx, AVG(CAST(is_write AS DOUBLE)) AS write_ratio,
       SUM(CASE WHEN token = 'signup' THEN 1 ELSE 0 END) AS signups, SUM(up) AS bytes_up, COUNT(DISTINCT object_id) AS distinct_paths, COUNT(DISTINCT token) AS tokens
FROM {obs} o GROUP BY system, entity, day"""


def rule_sql(rules: list[Rule], metrics: str = _METRICS, least: float = 0.6) -> str:
    """One projection of all rules, then a row for each rule that matches."""
    scores = ", ".join(f"{r.sql()} AS {r.id}" for r in rules)
    rows = ", ".join(f"('{r.id}', '{r.category}')" for r in rules)
    pick = "CASE r.rule " + " ".join(f"WHEN '{r.id}' THEN {r.id}" for r in rules) + " END"
    return f"""
WITH m AS ({metrics}), s AS (SELECT system, entity, day, {scores} FROM m),
x AS (SELECT system, entity, day, r.rule, r.category, {pick} AS confidence FROM s CROSS JOIN (VALUES {rows}) AS r(rule, category)),
matches AS (SELECT * FROM x WHERE confidence >= {least})"""


_MATCHES = rule_sql(RULES)
plan("signature_all_rules", _MATCHES + " SELECT system, entity, day, rule, category, ROUND(confidence, 6) AS confidence FROM matches")
plan("signature_rule_counts", _MATCHES + " SELECT rule, COUNT(*) AS matches, COUNT(DISTINCT entity) AS entities, ROUND(MAX(confidence), 6) AS best FROM matches GROUP BY rule")

plan("composite_sequence", _MATCHES + """,
w AS (SELECT a.system, a.entity, a.day, MIN(CASE WHEN b.category = 'auth' THEN b.day END) AS first_auth, MIN(CASE WHEN b.category = 'health' THEN b.day END) AS first_health,
             MAX(CASE WHEN b.category = 'auth' THEN b.confidence END) AS c1, MAX(CASE WHEN b.category = 'health' THEN b.confidence END) AS c2
      FROM (SELECT DISTINCT system, entity, day FROM matches) a JOIN matches b ON a.system = b.system AND a.entity = b.entity AND b.day BETWEEN a.day - 6 AND a.day GROUP BY a.system, a.entity, a.day)
SELECT system, entity, day, ROUND(c1 * c2, 6) AS confidence FROM w WHERE first_auth <= first_health""")

plan("composite_cooccur", _MATCHES + """
SELECT system, entity, day, ROUND(MAX(CASE WHEN category = 'health' THEN confidence END) * MAX(CASE WHEN category = 'write' THEN confidence END), 6) AS confidence
FROM matches GROUP BY system, entity, day HAVING COUNT(CASE WHEN category = 'health' THEN 1 END) > 0 AND COUNT(CASE WHEN category = 'write' THEN 1 END) > 0""")

plan("match_dedup_bucket", _MATCHES + """,
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY system, entity, rule, CAST(FLOOR(day / 7e0) AS BIGINT) ORDER BY day) AS k FROM matches)
SELECT system, entity, rule, day, ROUND(confidence, 6) AS confidence FROM k WHERE k = 1""")

plan("rule_scope_filter", _MATCHES + """
SELECT m.* FROM (SELECT system, entity, day, rule FROM matches) m JOIN (VALUES ('auth_login', 'sys0'), ('api_client', 'sys1'), ('api_client', 'sys2')) AS s(rule, system) ON m.rule = s.rule AND m.system = s.system""")

plan("rule_grain_counter", """
WITH h AS (SELECT system, hour, COUNT(*) AS n, SUM(CASE WHEN status >= 500 THEN 1 ELSE 0 END) AS e FROM {obs} o GROUP BY system, hour)
SELECT system, hour, CAST(SUM(n) OVER g AS BIGINT) AS grain_requests, ROUND(CAST(SUM(e) OVER g AS DOUBLE) / SUM(n) OVER g, 6) AS grain_5xx_rate FROM h WINDOW g AS (PARTITION BY system ORDER BY hour RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)""")

plan("rule_grain_map_entropy", """
WITH d AS (SELECT DISTINCT system, day FROM {obs} o), n AS (SELECT system, day, token, COUNT(*) AS n FROM {obs} o GROUP BY system, day, token),
g AS (SELECT d.system, d.day, n.token, CAST(SUM(n.n) AS DOUBLE) AS n FROM d JOIN n ON n.system = d.system AND n.day BETWEEN d.day - 2 AND d.day GROUP BY d.system, d.day, n.token),
p AS (SELECT system, day, n / SUM(n) OVER (PARTITION BY system, day) AS p FROM g)
SELECT system, day, COUNT(*) AS tokens, ROUND(MAX(p), 6) AS concentration, ROUND(SUM(p * LOG2(1 / p)), 6) AS entropy_bits FROM p GROUP BY system, day""")

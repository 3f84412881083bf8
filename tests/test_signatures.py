"""The rule library: its notation, YAML, scores by hand, scope, gating and composites."""

import pytest

from tidemark.operators import signatures as S


def snap(spark, rows):
    return spark.createDataFrame(rows, "system string, entity string, ts long, metrics map<string,double>")


def test_library_is_whole():
    rules, composites = S.parse(), S.parse_composites()
    assert len(rules) == 24 and len(composites) == 5 and len({r.id for r in rules}) == 24
    beacon = next(r for r in rules if r.id == "c2_beacon")
    assert (len(beacon.all), len(beacon.any), len(beacon.none)) == (4, 2, 1) and beacon.all[3] == S.Test("http.requests", "le", 10.0, 5.0)


def test_scores_by_hand(spark):
    rows = [
        ("a", "ramp", 0, {"l4.bytes_down": 3_500_000.0, "derived.upload_dominance": 0.2}),  # (0.5 + 1) / 2
        ("a", "login", 0, {"http.post_ratio": 0.3, "http.requests": 30.0, "http.resp_bytes_avg": 8000.0}),
        ("a", "upload", 0, {"l4.bytes_up": 4e6, "derived.upload_dominance": 5.0, "derived.timing_regularity": 0.8}),  # a NONE
        ("a", "probe", 0, {"probe.reachable": 0.2}),
        ("a", "absent", 0, {"l4.bytes_down": 1e9}),
    ]
    got = {(r.entity, r.rule): r.confidence for r in S.matches(snap(spark, rows), S.parse()).collect()}
    assert got == pytest.approx({("ramp", "bulk_download"): 0.75, ("login", "auth_login"): 1.0, ("probe", "service_degraded"): 1.0})


def test_yaml_scope_weight_and_gating(spark, tmp_path):
    path = tmp_path / "rules.yaml"
    path.write_text("""
- {id: r1, category: x, weight: 2.0, scope: [a], all: [{metric: m, op: ge, value: 10, soft: 10}]}
- {id: r2, category: y, any: [{metric: m, op: in, value: [1, 5]}, {metric: k, op: present}]}
- {id: c1, window_s: 60, sequence: [x, y]}
""")
    rules, composites = S.load(str(path))
    rows = [("a", "e", 0, {"m": 5.0}), ("b", "e", 0, {"m": 5.0}), ("a", "f", 0, {"k": 0.0})]
    got = {(r.system, r.entity, r.rule): r.confidence for r in S.matches(snap(spark, rows), rules).collect()}
    assert got == {("a", "e", "r1"): 0.75, ("a", "e", "r2"): 1.0, ("b", "e", "r2"): 1.0, ("a", "f", "r2"): 1.0}
    seen = spark.createDataFrame([("a", "f", 0)], "system string, entity string, ts long")
    assert [r.entity for r in S.matches(snap(spark, rows), rules, observed=seen).collect()] == ["f"]
    assert composites == [S.Composite("c1", True, ("x", "y"), 60)]
    (tmp_path / "bad.yaml").write_text("- {id: r, category: x, none: [{metric: m, op: gt, value: 1}]}")
    with pytest.raises(ValueError):
        S.load(str(tmp_path / "bad.yaml"))


def test_composites(spark):
    rows = [("s", "right", 0, "auth", 0.8), ("s", "right", 500, "transfer", 0.5), ("s", "right", 550, "transfer", 0.9), ("s", "late", 0, "auth", 1.0), ("s", "late", 601, "transfer", 1.0), ("s", "back", 0, "transfer", 1.0), ("s", "back", 100, "auth", 1.0), ("s", "both", 100, "tunnel", 0.7), ("s", "both", 900, "beacon", 1.0)]
    found = spark.createDataFrame(rows, "system string, entity string, ts long, category string, confidence double")
    got = sorted((r.entity, r.ts, r.composite, round(r.confidence, 6)) for r in S.composites(found, S.parse_composites()).collect())
    assert got == [("both", 900, "beacon_with_tunnel", 0.7), ("right", 500, "staging_then_exfil", 0.4)]

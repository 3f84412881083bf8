import json

from tidemark.sources import records


def test_records_are_cleaned(spark, tmp_path):
    lines = [
        {"ts": 1.0, "system": "s", "entity": "a", "extra": {"count": "3"}},
        {"ts": 2.0, "system": "s", "entity": "a"},
        {"ts": 3.0, "system": "s", "entity": "a", "extra": {"count": "0"}},
        {"ts": 3.0, "system": "s", "entity": "a", "extra": {"count": "x"}},
        {"ts": 4.0, "system": "", "entity": "a"},
        {"ts": 5.0, "system": "s", "entity": "__system__"},
        {"ts": 6.0, "system": "s", "entity": "class:1"},
        {"ts": 7.0, "system": "s", "entity": "b", "method": "ACTIVE_PROBE", "reachability": "up"},
        {"system": "s", "entity": "c"},
    ]
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    df = records.read_jsonl(spark, str(path))
    assert sorted((r.ts, r.w) for r in records.clean(df).collect()) == [(1.0, 3), (2.0, 1)]
    assert [r.entity for r in records.clean(df, passive=False).collect()] == ["b"]
    assert records.clean(df.limit(0)).count() == 0


def test_parquet_and_csv_are_padded(spark, tmp_path):
    spark.createDataFrame([("s", "e", 1.5)], "system string, entity string, ts double").write.parquet(str(tmp_path / "p"))
    assert records.read_parquet(spark, str(tmp_path / "p")).columns == records.SCHEMA.fieldNames()
    (tmp_path / "c.csv").write_text(",".join(f.name for f in records.SCHEMA if f.name not in ("open_ports", "extra")) + "\n1.0,s,e" + "," * 34 + "\n")
    assert records.read_csv(spark, str(tmp_path / "c.csv")).first().entity == "e"


def test_findings_by_day(spark, tmp_path):
    path = str(tmp_path / "f")
    records.write_findings(spark.createDataFrame([(1, "x"), (2, "y")], "day int, kind string"), path)
    assert spark.read.parquet(path).where("day = 2").count() == 1

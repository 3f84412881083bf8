"""Every statement gives in Spark what its DuckDB form gives, rows in any order."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidemark import workload
from tidemark.plans.dialect import TABLES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows(pdf):
    def show(v):
        if pd.isna(v):
            return "~"
        if isinstance(v, (bool, str)):
            return str(v)
        v = float(v)
        return f"{v:.5g}" if not math.isinf(v) else str(v)

    return sorted(tuple(show(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(workload.ORACLES))
def test_against_duckdb(spark, duck, small, name):
    ours = workload.QUERIES[name](spark, small).toPandas()
    theirs = duck.sql(workload.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(workload.QUERIES) - set(workload.ORACLES)))
def test_kernels_run(spark, small, name):
    assert workload.QUERIES[name](spark, small).count() > 0


def test_without_the_optional_parts(tmp_path):
    """A copy of the library without the training-data folders and the pipeline has all other queries; so has one
    that keeps an empty folder, or lacks a library that only they need."""
    root = Path(workload.__file__).parents[1]
    for k, spoil in enumerate(("gone", "empty", "library")):
        copy = tmp_path / str(k)
        shutil.copytree(root / "tidemark", copy / "tidemark")
        shutil.copy(root / "__spark_entry__.py", copy)
        if spoil == "library":
            shutil.copy(root / "corpus_pipeline.py", copy) if (root / "corpus_pipeline.py").exists() else None
            (copy / "xxhash.py").write_text("raise ImportError('no xxhash', name='xxhash')")
        else:
            shutil.rmtree(copy / "tidemark" / "llm", ignore_errors=True)
            (copy / "tidemark" / "llm").mkdir() if spoil == "empty" else None
        code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True).stdout
        assert [set(line.split()) for line in out.splitlines()] == [set(workload.QUERIES), set(workload.ORACLES)]


def test_incidents_are_named_by_the_millisecond_of_their_statement(spark, tmp_path):
    """Times within a millisecond, halves among them, compared to the last digit."""
    from pyspark.sql import functions as F

    micros = [1_704_376_780_895_561, 1_704_376_780_895_499, 1_704_376_780_895_500, 1_500, 1_499, 499, 172_800_000_500, 345_600_001_499]
    rows = [(k, u, 3 * (k % 4), "error", 1.0) for k, u in enumerate(micros)]
    events = spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string, value double")
    events.select("event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("stream_incidents", "stream_first_sightings"):
        got = workload.QUERIES[name](spark, str(tmp_path))
        assert sorted(tuple(r) for r in got.collect()) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({workload.ORACLES[name]})").fetchall())

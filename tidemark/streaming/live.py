"""The live path: observations arrive as files, ticks and incidents leave.

`tick_metrics` is an event-time aggregation behind a watermark; `incidents` keeps one open incident per system and
entity as state that times out. Both take a streaming frame of `event_rows` and give a streaming frame; what the
batch queries compute over the same rows is what they converge to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.plans.catalog import query
from tidemark.session import shared_folder

GAP_MS = 172_800_000


def _millis(ts: str) -> Column:
    """Milliseconds of a time as DuckDB's epoch_ms has them: the nearest, halves away from zero."""
    return F.expr(f"(unix_micros({ts}) + if(unix_micros({ts}) < 0, -500, 500)) div 1000")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a stream of files, a watermark of one hour on the event time."""
    path = f"{sf_dir}/events.parquet"
    raw = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/event[s].parquet")  # as a pattern: a path that is one file is no folder to watch
    rows = raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("sys"), F.col("user_id") % 3).alias("system"), F.col("user_id").alias("entity"), "event_type", "value")
    return rows.withWatermark("ts", "1 hour")


def tick_metrics(rows: DataFrame, tick: str = "1 hour") -> DataFrame:
    """Requests, errors and volume per tick and system."""
    error = (F.col("event_type") == "error").cast("int")
    found = rows.groupBy(F.window("ts", tick), "system").agg(F.count("*").alias("requests"), F.sum(error).alias("errors"), F.round(F.sum("value"), 4).alias("bytes_up"))
    return found.select((F.unix_micros("window.end") / 3_600_000_000).cast("long").alias("tick"), "system", "requests", "errors", "bytes_up")


def incidents(rows: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Error findings merged while they follow within `gap_ms`: every finding with its incident, named by when it opened.

    An incident's state goes when the watermark has passed its last finding by the gap."""

    def merge(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, last = state.get if state.exists else (0, -(1 << 62))
        for pdf in _in_order(batches):
            out = []
            for r in pdf.itertuples():
                if r.ms - last > gap_ms:
                    opened = r.ms
                last = max(last, r.ms)
                out.append((key[0], key[1], opened, r.event_id))
            yield pd.DataFrame(out, columns=["system", "entity", "incident", "event_id"])
        state.update((opened, last))
        _forget(state, last + gap_ms)

    found = rows.where("event_type = 'error'").withColumn("ms", _millis("ts"))
    return found.groupBy("system", "entity").applyInPandasWithState(merge, "system string, entity long, incident long, event_id long", "opened long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One key's rows of a micro-batch by time: they may come in several frames."""
    frames = [pdf for pdf in batches if len(pdf)]
    if frames:
        yield pd.concat(frames).sort_values(["ms", "event_id"])


def _forget(state: GroupState, at: int) -> None:
    """Drops the state when the watermark reaches `at`, or with the next batch if it has."""
    state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))


def sliding_rates(rows: DataFrame, span: str = "6 hours", step: str = "2 hours") -> DataFrame:
    """Requests and errors of each system in overlapping windows."""
    found = rows.groupBy(F.window("ts", span, step), "system").agg(F.count("*").alias("requests"), F.sum((F.col("event_type") == "error").cast("int")).alias("errors"))
    return found.select((F.unix_micros("window.end") / 3_600_000_000).cast("long").alias("ends"), "system", "requests", "errors")


def first_sightings(rows: DataFrame, ttl_ms: int = GAP_MS) -> DataFrame:
    """Every request with whether its entity and type weren't seen together for `ttl_ms`: a set whose members expire."""

    def look(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (last,) = state.get if state.exists else (-(1 << 62),)
        for pdf in _in_order(batches):
            before = np.maximum.accumulate(np.r_[last, pdf.ms.to_numpy()[:-1]])
            last = int(max(last, pdf.ms.max()))
            yield pd.DataFrame({"event_id": pdf.event_id.to_numpy(), "is_new": pdf.ms.to_numpy() - before > ttl_ms})
        state.update((last,))
        _forget(state, last + ttl_ms)

    found = rows.withColumn("ms", _millis("ts"))
    return found.groupBy("entity", "event_type").applyInPandasWithState(look, "event_id long, is_new boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def decayed_counters(rows: DataFrame, half_life_ms: int = GAP_MS) -> DataFrame:
    """After every request its entity's count, decayed by half in `half_life_ms`; late requests count with their age.

    What has decayed to under a millionth is forgotten."""

    def count(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value, at = state.get if state.exists else (0.0, 0)
        for pdf in _in_order(batches):
            out = []
            for ms in pdf.ms.tolist():
                if ms >= at:
                    value, at = value * 2.0 ** ((at - ms) / half_life_ms) + 1, ms
                else:
                    value += 2.0 ** ((ms - at) / half_life_ms)
                out.append(value)
            yield pd.DataFrame({"event_id": pdf.event_id.to_numpy(), "entity": key[0], "decayed": out})
        state.update((value, at))
        _forget(state, at + int(half_life_ms * (20 + np.log2(max(value, 1.0)))))

    found = rows.withColumn("ms", _millis("ts"))
    return found.groupBy("entity").applyInPandasWithState(count, "event_id long, entity long, decayed double", "value double, at long", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, name: str, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there and reads what it has written: every batch's rows by its number, so
    that a batch run again replaces its own rows, and of an updated key the rows of the last batch."""
    spark = stream.sparkSession
    path = shared_folder(spark, name)
    schema = stream.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    if keys:
        last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
        rows = rows.join(last, [*keys, "batch"])
    return rows.select(*schema.names)


_TICKS = """
SELECT CAST(floor(epoch_us(ts) / 3600e6) AS BIGINT) + 1 AS tick, 'sys' || CAST(user_id % 3 AS VARCHAR) AS system, COUNT(*) AS requests,
       CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, ROUND(SUM(value), 4) AS bytes_up
FROM events GROUP BY ALL"""

_INCIDENTS = """
WITH f AS (SELECT 'sys' || CAST(user_id % 3 AS VARCHAR) AS system, user_id AS entity, event_id, epoch_ms(ts) AS ms FROM events WHERE event_type = 'error'),
o AS (SELECT *, CASE WHEN ms - LAG(ms) OVER (PARTITION BY system, entity ORDER BY ms, event_id) <= 172800000 THEN 0 ELSE 1 END AS opens FROM f)
SELECT system, entity, MAX(CASE WHEN opens = 1 THEN ms END) OVER (PARTITION BY system, entity ORDER BY ms, event_id) AS incident, event_id FROM o"""

_SLIDING = """
WITH e AS (SELECT 'sys' || CAST(user_id % 3 AS VARCHAR) AS system, event_type, CAST(floor(epoch_us(ts) / 7200e6) AS BIGINT) * 2 AS h FROM events)
SELECT h + w AS ends, system, COUNT(*) AS requests, CAST(COUNT(*) FILTER (event_type = 'error') AS BIGINT) AS errors FROM e CROSS JOIN (VALUES (2), (4), (6)) v(w) GROUP BY ALL"""

_SIGHTINGS = """
SELECT event_id, COALESCE(ms - MAX(ms) OVER (PARTITION BY user_id, event_type ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 172800000, true) AS is_new FROM (SELECT *, epoch_ms(ts) AS ms FROM events) e"""

_DECAYED = """
WITH e AS (SELECT event_id, user_id AS entity, epoch_ms(ts) AS ms FROM events)
SELECT a.event_id, a.entity, ROUND(SUM(POWER(2, (b.ms - a.ms) / 172800000.0)), 4) AS decayed FROM e a JOIN e b ON a.entity = b.entity AND (b.ms < a.ms OR (b.ms = a.ms AND b.event_id <= a.event_id)) GROUP BY a.event_id, a.entity"""


@query("stream_tick_metrics", _TICKS)
def stream_tick_metrics(spark, sf_dir):
    """Tick metrics of all events by the streaming path."""
    return drained(tick_metrics(event_rows(spark, sf_dir)), "ticks", "update", ["tick", "system"])


@query("stream_incidents", _INCIDENTS)
def stream_incidents(spark, sf_dir):
    """Incidents of all error events by the streaming path."""
    return drained(incidents(event_rows(spark, sf_dir)), "incidents", "append")


@query("stream_sliding_rates", _SLIDING)
def stream_sliding_rates(spark, sf_dir):
    """Sliding windows over all events by the streaming path."""
    return drained(sliding_rates(event_rows(spark, sf_dir)), "sliding", "update", ["ends", "system"])


@query("stream_first_sightings", _SIGHTINGS)
def stream_first_sightings(spark, sf_dir):
    """New pairs of entity and type among all events, by a set with expiry."""
    return drained(first_sightings(event_rows(spark, sf_dir)), "sightings", "append")


@query("stream_decayed_counters", _DECAYED)
def stream_decayed_counters(spark, sf_dir):
    """Decayed counts of all events by the streaming path."""
    return drained(decayed_counters(event_rows(spark, sf_dir)), "decayed", "append").withColumn("decayed", F.round("decayed", 4))

"""What the operators of this subpackage share: tables, the shared scratch folder, lineage cuts."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that the contracts call white space.
SPACE = r"[\x20\x09-\x0D]"

#: A side of a join is broadcast up to this many narrow rows (16 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (`spark.checkpoint.dir`).

    Only where that setting is empty, as in a test session, a temporary folder takes its place; without it a cluster,
    whose executors couldn't read such a folder, gets an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


#: What a Python worker gets at once while a table is cut.
_ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Bounds Arrow batches by rows and bytes; the session's own settings come back at the end."""
    before = {key: spark.conf.get(key, None) for key in _ARROW}
    try:
        for key, value in _ARROW.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: a lost executor costs no recomputation beyond it.

    Texts and sets that pass through Python on the way come in small batches, so that long ones don't add up."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, longer where a column has it (in any case of letters) already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row(df: DataFrame, name: str = "__row") -> DataFrame:
    """Numbers the rows, so that equal rows stay apart.

    The number depends on the file split a row is read from, and so is the same whenever the same table
    is read in one session: the least number of splits, which else follows the cores at hand and so would change
    with a lost executor, is fixed at the first call. `df` has to be a table as read, or maps and filters of one.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return df.withColumn(name, F.monotonically_increasing_id())


def _give_back() -> None:
    """Returns memory that a task has freed to the system: a worker lives on, and others need it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tidy(work):
    """For functions over Arrow batches: gives memory back when a partition is done."""

    @functools.wraps(work)
    def wrapped(batches):
        try:
            yield from work(batches)
        finally:
            _give_back()

    return wrapped


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast where the counted rows are few enough for it."""
    return F.broadcast(df) if rows <= limit else df

"""Session-side helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts may be long, so batches stay well below Spark's default of 10,000 rows.
BATCH_ROWS = 2000
#: Rows up to which a counted table is broadcast, and those for one that only has ids.
BROADCAST_ROWS = 200_000
BROADCAST_IDS = 1_000_000
#: The paths written inside each open ``scratch``.
_scratch: list[list[str]] = []
#: Temporary folders of local sessions, by application.
_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing and driver and executors are one process (as in
    tests), a temporary folder is made once for the application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = _folders.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="logquarry-shared-")
        _folders[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts the lineage: what was written survives the loss of any executor and
    isn't computed again by later actions.
    """
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go at the end; what is needed later has to be written outside."""
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield
    finally:
        _scratch.remove(paths)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it was counted to have few rows; a larger one is joined by shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """Like ``written``, as a table bucketed by ``key``: grouping by it later moves no row of the table."""
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", shared_path(spark, label)).bucketBy(parts(spark), key).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; only the name goes
    return found


def prepared(spark: SparkSession) -> SparkSession:
    """Bound the rows of an Arrow batch in this session."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns the operators read, under fixed names."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Return what this Python worker has freed to the system: workers stay between stages, and what an earlier one freed would count in the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def ready(df: DataFrame) -> DataFrame:
    prepared(df.sparkSession)
    return df

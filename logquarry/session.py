"""Session helpers shared by the whole library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of every executor.

    The package is zipped once per application and handed to ``addPyFile``, so
    a job doesn't depend on the working folder it was started from.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="logquarry-"), "logquarry.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, path.relative_to(root.parent).as_posix())
        spark.sparkContext.addPyFile(target)
        _SHIPPED.add(app)
    return spark


def checkpoint_ready(spark: SparkSession) -> SparkSession:
    """Give the context a checkpoint folder: the shared one of the session, or a temporary one where none is set and the session is local."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="logquarry-checkpoints-")
        context.setCheckpointDir(folder)
    return spark


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, with its lineage cut by a checkpoint in the shared folder."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """Like ``settled``, by a compressed table in the shared folder; its path is added to ``paths``, so that ``discard`` can take it away when it has been used."""
    path = f"{checkpoint_ready(df.sparkSession).sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of ``stored`` from which nothing is read any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt to all cores by ``keys`` where it comes in fewer partitions, as a small file does; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df

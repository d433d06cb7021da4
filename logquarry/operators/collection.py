"""Collecting in one call: selected files and archive members, copied once under names that don't collide, with a manifest.

No content goes through a shuffle: tasks stream it from where it lies, once for
its checksum and once for the copy, and only names, sizes and checksums move.
"""

from __future__ import annotations

import hashlib
import posixpath
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.operators import collecting
from logquarry.session import settled
from logquarry.sources import files as sources

CHUNK = 1 << 20
#: Existing files of a target come before all others in its order.
_BEFORE = -(1 << 40)


class _Contents:
    """Streams of files and archive members; the archive opened last stays open."""

    def __init__(self) -> None:
        self.path, self.archive = None, None

    @contextmanager
    def open(self, path: str, entry: str | None):
        if entry is None:
            store, inner = sources.store_of(path)
            with store.open_input_stream(inner) as stream:
                yield stream
            return
        if path != self.path:
            store, inner = sources.store_of(path)
            self.path, self.archive = path, zipfile.ZipFile(store.open_input_file(inner))
        with self.archive.open(entry) as stream:
            yield stream


def _chunks(stream) -> Iterator[bytes]:
    while chunk := stream.read(CHUNK):
        yield chunk


def checksums(files: DataFrame) -> DataFrame:
    """``files`` (``source_path``, ``entry``) with ``sha256`` (upper-case) and ``size`` of what their bytes are."""
    names = [c for c in files.columns if c not in ("sha256", "size")]
    schema = files.select(*names).schema.add("size", "long").add("sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents = _Contents()
        for batch in batches:
            sizes, sums = [], []
            for path, entry in zip(batch["source_path"].to_pylist(), batch["entry"].to_pylist(), strict=True):
                digest, size = hashlib.sha256(), 0
                with contents.open(path, entry) as stream:
                    for chunk in _chunks(stream):
                        digest.update(chunk)
                        size += len(chunk)
                sizes.append(size)
                sums.append(digest.hexdigest().upper())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], [*names, "size", "sha256"])

    return files.select(*names).mapInArrow(run, schema)


def copied(files: DataFrame, folder: str) -> DataFrame:
    """Copy ``source_path``, ``entry`` to ``output_name`` in ``folder``, by way of a name aside; returns ``output_name`` and ``bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents = _Contents()
        store, root = sources.store_of(folder)
        for batch in batches:
            sizes = []
            for path, entry, name in zip(*(batch[c].to_pylist() for c in ("source_path", "entry", "output_name")), strict=True):
                aside = posixpath.join(root, f".{name}.{TaskContext.get().taskAttemptId()}")
                with contents.open(path, entry) as stream, store.open_output_stream(aside) as out:
                    for chunk in _chunks(stream):
                        out.write(chunk)
                sizes.append(store.get_file_info(aside).size)
                store.move(aside, posixpath.join(root, name))
            yield pa.RecordBatch.from_arrays([batch["output_name"], pa.array(sizes, pa.int64())], ["output_name", "bytes"])

    return files.select("source_path", "entry", "output_name").mapInArrow(run, "output_name string, bytes long")


def _existing(spark: SparkSession, folder: str, force: bool) -> DataFrame | None:
    """Files that the target has already, as rows of the collection; None for a new or empty target."""
    store, root = sources.store_of(folder)
    there = sorted(x.base_name for x in store.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)) if x.type == pyarrow.fs.FileType.File and not x.base_name.startswith("."))
    if there and not force:
        raise ValueError(f"{folder} isn't empty")
    store.create_dir(root, recursive=True)
    if not there:
        return None
    rows = [(_BEFORE + k, name, posixpath.join(folder, name)) for k, name in enumerate(there)]
    return spark.createDataFrame(rows, "order long, name string, source_path string").withColumn("entry", F.lit(None).cast("string"))


def collect(
    spark: SparkSession,
    paths: list[str],
    folder: str,
    days: list[str] | None = None,
    types: list[str] | None = None,
    pairs: DataFrame | None = None,
    extensions: list[str] | None = None,
    container_date: bool = False,
    force: bool = False,
) -> DataFrame:
    """Copy the selected files below ``paths`` into ``folder``, each content once, and return the manifest.

    ``days``, ``types`` and ``pairs`` select as in ``collecting.selected``; an
    empty selection is an error. A target with files is refused unless
    ``force``; then their names are taken and their contents count as there.
    Archives that can't be read are the manifest's first rows. The manifest is
    also written as CSV with a header, as a folder of sorted parts, next to
    ``folder`` under ``<folder>.manifest.csv``.
    """
    found = None
    for path in paths:
        some = sources.inventory(spark, path, extensions, container_date)
        found = some if found is None else found.unionByName(some)
    if found is None:
        raise ValueError("no paths")
    found = found.dropDuplicates(["source_path", "entry"]).withColumn("source_kind", F.when(F.col("source_kind") == "zip", "ZIP").otherwise("File"))
    found = found.orderBy("source_path", F.col("entry").asc_nulls_first()).withColumn("order", F.monotonically_increasing_id())
    found = settled(found)
    chosen = collecting.selected(found.where("error is null"), days, types, pairs)
    if chosen.isEmpty():
        raise ValueError("no file of these days and types")
    existing = _existing(spark, folder, force)
    rows = checksums(chosen.drop("size").select(*[c for c in found.columns if c != "size"]))
    if existing is not None:
        rows = rows.unionByName(checksums(existing), allowMissingColumns=True)
    rows = settled(rows)
    judged = collecting.without_duplicates(rows, "order")
    # A file of the target keeps its name even if the target has its content twice.
    named = settled(collecting.output_names(judged.where(~F.col("duplicate") | (F.col("order") < 0)), "order"))
    done = settled(copied(named.where("order >= 0"), folder))
    wrong = done.join(named.select("output_name", "size"), "output_name").where("bytes <> size")
    if not wrong.isEmpty():
        raise OSError(f"{folder} holds copies that aren't as long as their sources")
    names = named.select(F.col("order").alias("first"), "output_name")
    table = settled(collecting.manifest_rows(judged.where("order >= 0").join(names, "first"), found.where("error is not null"), "order"))
    table.orderBy("_rank", "_order").select(*collecting.MANIFEST).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(folder.rstrip("/") + ".manifest.csv")
    return table.orderBy("_rank", "_order").select(*collecting.MANIFEST)


def summary(manifest: DataFrame) -> DataFrame:
    """Files and bytes selected, duplicates and unreadable archives of a manifest, as one row."""
    of = lambda status: F.count(F.when(F.col("Status") == status, 1))
    size = F.coalesce(F.sum(F.when(F.col("Status") == "Selected", F.col("Bytes").cast("long"))), F.lit(0))
    return manifest.agg(of("Selected").alias("selected"), of("Duplicate").alias("duplicates"), of("ArchiveError").alias("archive_errors"), size.alias("bytes"))

"""Inventories of log files and of the members of ZIP archives."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logquarry.functions import names

INVENTORY = "source_kind string, source_path string, source_name string, entry string, name string, size long, error string"
MEMBERS = INVENTORY + ", content binary"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def store_of(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI and the path inside it; Spark writes local ones with one slash."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pyarrow.fs.FileSystem.from_uri(uri)


def with_content(files: DataFrame, path_col: str = "path", limit: int | None = None) -> DataFrame:
    """``files`` with ``content``, or its first ``limit`` bytes, read by the tasks; null where a file can't be read."""
    schema = StructType([*files.schema.fields]).add("content", "binary")
    where = files.columns.index(path_col)

    def read(path: str) -> bytes | None:
        try:
            store, inner = store_of(path)
            with store.open_input_stream(inner) as stream:
                return stream.read() if limit is None else stream.read(limit)
        except (OSError, pa.ArrowInvalid):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([read(row.column(where)[0].as_py())], pa.binary())], [*row.schema.names, "content"])

    return files.mapInArrow(run, schema)


def with_digest(files: DataFrame, head: int = 1 << 20, path_col: str = "path") -> DataFrame:
    """``files`` with ``sha256`` (capitals) of the whole content and its first ``head`` bytes, read piece by piece; null where a file can't be read."""
    schema = StructType([*files.schema.fields]).add("sha256", "string").add("head", "binary")
    where = files.columns.index(path_col)

    def read(path: str) -> tuple[str | None, bytes | None]:
        digest = hashlib.sha256()
        try:
            store, inner = store_of(path)
            with store.open_input_stream(inner) as stream:
                first = piece = stream.read(head)
                while piece:
                    digest.update(piece)
                    piece = stream.read(4 << 20)
        except (OSError, pa.ArrowInvalid):
            return None, None
        return digest.hexdigest().upper(), first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                sha, first = read(row.column(where)[0].as_py())
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([sha], pa.string()), pa.array([first], pa.binary())], [*row.schema.names, "sha256", "head"])

    return files.mapInArrow(run, schema)


def _members(archives: DataFrame, with_content: bool) -> DataFrame:
    """A row for each member of each archive, or one with ``error`` for an archive that can't be read."""
    fields = [("source_kind", pa.string()), ("source_path", pa.string()), ("source_name", pa.string()), ("entry", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("error", pa.string())]
    fields += [("content", pa.binary())] if with_content else []
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                title = path.rsplit("/", 1)[-1]
                row = {"source_kind": "zip", "source_path": path, "source_name": title}
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                        for info in archive.infolist():
                            if not info.is_dir():
                                one = row | {"entry": info.filename, "name": info.filename.rsplit("/", 1)[-1], "size": info.file_size}
                                yield pa.RecordBatch.from_pylist([one | ({"content": archive.read(info)} if with_content else {})], schema)
                except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError) as error:
                    yield pa.RecordBatch.from_pylist([row | {"error": str(error)}], schema)

    return archives.select("path", "content").mapInArrow(run, MEMBERS if with_content else INVENTORY)


def inventory(spark: SparkSession, path: str, extensions: list[str] | None = None, container_date: bool = False) -> DataFrame:
    """Every file and every ZIP member below ``path`` with an allowed suffix: log type, day and size.

    An archive that can't be read is a row with ``error``. With ``container_date``
    a member without a day takes the archive's. Contents of plain files aren't read.
    """
    allowed = names.extensions(extensions)
    files = _files(spark, path)
    is_zip = names.extension(F.col("path")) == ".zip"
    plain = files.where(~is_zip).select(F.lit("file").alias("source_kind"), F.col("path").alias("source_path"), names.leaf(F.col("path")).alias("source_name"), F.lit(None).cast("string").alias("entry"), names.leaf(F.col("path")).alias("name"), F.col("length").alias("size"), F.lit(None).cast("string").alias("error"))
    found = plain.union(_members(files.where(is_zip), False))
    found = found.where(names.extension(F.col("name")).isin(allowed) | F.col("error").isNotNull())
    day = names.date_from_name(F.col("name"))
    if container_date:
        day = F.coalesce(day, F.when(F.col("source_kind") == "zip", names.date_from_name(F.col("source_name"))))
    return found.withColumn("log_type", names.log_type(F.col("name"))).withColumn("day", day)


def zip_contents(spark: SparkSession, path: str) -> DataFrame:
    """Members of the archives below ``path`` with their bytes."""
    files = _files(spark, path)
    return _members(files.where(names.extension(F.col("path")) == ".zip"), True)


def sources(spark: SparkSession, paths: list[str], extensions: list[str] | None = None) -> DataFrame:
    """Files to investigate: those of folders need an allowed suffix, explicitly named files don't; each once."""
    allowed = names.extensions(extensions)
    found = None
    for path in paths:
        files = _files(spark, path)
        named = F.col("path").endswith("/" + path.rstrip("/").rsplit("/", 1)[-1])
        files = files.where(named | names.extension(F.col("path")).isin(allowed)).select("path", "length", "modificationTime")
        found = files if found is None else found.union(files)
    if found is None:
        raise ValueError("no paths")
    return found.dropDuplicates(["path"])

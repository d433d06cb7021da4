"""Collected files and masked texts, written by the tasks that hold them."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.functions.names import leaf
from logquarry.sources.lines import encoded


def write_files(files: DataFrame, folder: str, force: bool = False) -> DataFrame:
    """Write ``content`` (binary) under ``output_name`` into ``folder``, a URI all executors reach.

    A folder that has files already is refused unless ``force``. Each file is
    written aside and then moved, so a task that runs again leaves whole files.
    Returns ``output_name``, ``bytes`` and ``sha256`` of what was written.
    """
    store, root = pyarrow.fs.FileSystem.from_uri(folder)
    there = [x for x in store.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)) if not x.base_name.startswith(".")]
    if there and not force:
        raise ValueError(f"{folder} isn't empty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch["output_name"].to_pylist(), batch["content"], strict=True):
                aside = posixpath.join(root, f".{name}.{TaskContext.get().taskAttemptId()}")
                with store.open_output_stream(aside) as out:
                    out.write(content.as_buffer())
                store.move(aside, posixpath.join(root, name))
            yield batch

    written = files.select("output_name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "output_name string, content binary")
    return written.select("output_name", F.length("content").cast("long").alias("bytes"), F.upper(F.sha2("content", 256)).alias("sha256"))


def masked_name(path, restore: bool = False):
    """The name of a masked or restored copy: the stem, a marker, the suffix."""
    marker = ".klartext" if restore else ".anonym"
    return F.regexp_replace(leaf(path), r"^(.+?)(\.[^.]*)?$", f"$1{marker}$2")


def masked_files(lines: DataFrame, endings: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """``output_name`` and ``content`` of masked lines (``source_id``, ``line_no``, ``masked``) joined with each line's own ending.

    ``endings``: ``source_id``, ``line_no``, ``ending``. A file is put together
    where its lines meet, so it has to fit into a task, as any single file does.
    """
    rows = lines.join(endings, ["source_id", "line_no"], "left")
    whole = rows.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("line_no", F.concat("masked", F.coalesce("ending", F.lit(""))).alias("t")))).alias("x"))
    return whole.select(masked_name(F.col("source_id")).alias("output_name"), encoded(F.array_join(F.col("x.t"), ""), F.lit(encoding)).alias("content"))


def line_endings(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``source_id``, ``line_no`` and ``ending`` (CRLF, LF, CR or none) of each line."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(r"([^\r\n]*)(\r\n|\n|\r|$)"), F.lit(2))
    return files.select(F.col(id_col).alias("source_id"), F.posexplode(found).alias("pos", "ending")).select("source_id", (F.col("pos") + 1).alias("line_no"), "ending")

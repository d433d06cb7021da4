"""Lines of files of any size, read in byte ranges by many tasks.

A range has the lines that begin in it: a task looks at the byte before its range
to see whether a line begins there, and reads the last line on beyond its range.
Line numbers come from a first pass that counts each range's lines. Offsets of lines are kept, so that
single lines can be read again without their file.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.session import settled
from logquarry.sources.files import store_of, with_content
from logquarry.sources.lines import SAMPLE_BYTES, decode, detected_encoding

#: Bytes of a range, and of one read inside it.
RANGE_BYTES, CHUNK = 64 << 20, 4 << 20
#: Bytes that are read beyond a range at first.
BEYOND = 4096
#: Lines and bytes of one batch.
BATCH_LINES, BATCH_BYTES = 4096, 4 << 20
#: Bytes of a task's ranges together, where there are more than a few tasks for each core; most tasks, and most neighbouring ranges that are dealt together.
TASK_BYTES, MOST_TASKS, MOST_TOGETHER = 16 << 20, 200_000, 64

_END = re.compile(rb"\r\n|\n|\r")


def unit_of(encoding: str) -> int:
    """Bytes of a code unit, the smallest piece in which line ends can be told."""
    return 2 if encoding.lower().replace("_", "-").startswith("utf-16") else 1


def mark_of(encoding: str, head: bytes) -> int:
    """Bytes of the order mark at a file's beginning."""
    if unit_of(encoding) == 2:
        return 2 if head[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE) else 0
    return 3 if encoding.lower().replace("_", "-") == "utf-8-sig" and head[:3] == codecs.BOM_UTF8 else 0


def _signs(data: bytes, encoding: str) -> bytes:
    """One byte for each code unit: its value if it can be part of a line end."""
    if unit_of(encoding) == 1:
        return data
    units = np.frombuffer(data[: len(data) // 2 * 2], ">u2" if encoding.lower().endswith("be") else "<u2")
    return np.where((units == 10) | (units == 13), units, 120).astype(np.uint8).tobytes()


def raw_lines(handle: BinaryIO, start: int, end: int, encoding: str, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the lines that begin in ``[start, end)``, without their ends (LF, CRLF or a lone CR).

    The first line of a file begins behind its order mark and belongs to the range at 0.
    """
    unit = unit_of(encoding)
    start, end = start + start % unit, end + end % unit
    at = max(0, start - unit)
    handle.seek(at)
    # A little beyond the range, for its last line.
    chunk = min(chunk, end - at + BEYOND)
    data = handle.read(max(chunk, 4))
    inside = start == 0
    if inside:
        mark = mark_of(encoding, data)
        data, at = data[mark:], mark
    last = False
    while True:
        signs, begin = _signs(data, encoding), 0
        for m in _END.finditer(signs):
            if not last and m.end() == len(signs) and m[0] == b"\r":
                break  # perhaps the first half of CRLF
            if inside:
                yield at + begin, data[begin : m.start() * unit]
            begin = m.end() * unit
            inside = True
            if at + begin >= end:
                return
        data, at = data[begin:], at + begin
        if last:
            if data and inside:
                yield at, data
            return
        more = handle.read(max(chunk, len(data)))
        last = not more
        data += more


def encoding_of(head: Column) -> Column:
    """The encoding that a file's first bytes show; UTF-16 says its order, as most ranges don't see the mark."""
    found = detected_encoding(head)
    return F.when(found == "utf-16", F.when(F.hex(F.substring(head, 1, 2)) == "FEFF", "utf-16-be").otherwise("utf-16-le")).otherwise(found)


def with_encoding(files: DataFrame) -> DataFrame:
    """``files`` (``path``) with ``encoding``, from the first bytes of each."""
    head = with_content(files, limit=SAMPLE_BYTES)
    return head.where("content is not null").select(*files.columns, encoding_of(F.col("content")).alias("encoding"))


def ranges(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """``files`` (``path``, ``size``, ``encoding``) cut into ranges ``part``, ``start``, ``end``, dealt to a task each; small ones share tasks."""
    cut = files.where("size > 0").select("path", "encoding", F.col("size").alias("_size"), F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(size).cast("long"))).alias("part", "start"))
    rows = cut.select("path", "encoding", "part", "start", F.least(F.col("start") + size, "_size").alias("end"))
    # A number of tasks by the number and bytes of ranges, which tiny rows wouldn't show.
    count, total = files.agg(F.coalesce(F.sum(F.ceil(F.col("size") / size)), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(int(count), max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES)), MOST_TASKS))
    return _dealt(rows, tasks, max(1, min(int(count) // (8 * tasks), MOST_TOGETHER)))


def _dealt(rows: DataFrame, tasks: int, together: int) -> DataFrame:
    """Ranges dealt to tasks, neighbours together, in the order in which a task finds them in its files."""
    return rows.repartition(tasks, "path", F.floor(F.col("part") / together)).sortWithinPartitions("path", "part")


def _opened(rows: Iterable[dict]) -> Iterator[tuple[dict, BinaryIO]]:
    """Rows with their open file; rows of one path in a row share it."""
    path = handle = None
    try:
        for row in rows:
            if handle is None or row["path"] != path:
                if handle is not None:
                    handle.close()
                path = row["path"]
                store, inner = store_of(path)
                handle = store.open_input_file(inner)
            yield row, handle
    finally:
        if handle is not None:
            handle.close()


def numbered_ranges(cut: DataFrame) -> DataFrame:
    """``cut`` with ``before``, the number of lines in the earlier ranges of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [{**row, "count": sum(1 for _ in raw_lines(handle, row["start"], row["end"], row["encoding"]))} for row, handle in _opened(batch.to_pylist())]
            yield pa.RecordBatch.from_pylist(counts, schema)

    schema = pa.schema([("path", pa.string()), ("encoding", pa.string()), ("part", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("count", pa.int64())])
    counted = settled(cut.mapInArrow(run, "path string, encoding string, part int, start long, end long, count long"))
    # One row for each range of a file.
    before = F.expr("coalesce(sum(count) OVER (PARTITION BY path ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    rows = counted.select("path", "encoding", "part", "start", "end", before.alias("before"))
    tasks = max(1, cut.rdd.getNumPartitions())
    return _dealt(rows, tasks, max(1, min(counted.count() // (8 * tasks), MOST_TOGETHER)))


def read(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """``source_id``, ``line_no`` (from 1), ``offset`` (of its first byte) and ``text`` of each line of ``files`` (``path``, ``size``, ``encoding``).

    Bytes that can't be decoded stay, see ``lines.decode``.
    """
    schema = pa.schema([("source_id", pa.string()), ("line_no", pa.int64()), ("offset", pa.int64()), ("text", pa.string())])

    def batch_of(rows: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for row, handle in _opened(batch.to_pylist()):
                for number, (offset, line) in enumerate(raw_lines(handle, row["start"], row["end"], row["encoding"]), row["before"] + 1):
                    rows.append((row["path"], number, offset, decode(line, row["encoding"])))
                    held += len(line)
                    if len(rows) >= BATCH_LINES or held >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return numbered_ranges(ranges(files, size)).mapInArrow(run, "source_id string, line_no long, offset long, text string")


def around(wanted: DataFrame, before: int = 6, after: int = 6, chunk: int = 1 << 16) -> DataFrame:
    """The lines around places in files, read from their offsets: ``event_id``, ``source_id``, ``line_no``, ``offset``, ``text``.

    ``wanted``: ``event_id``, ``source_id`` (the path), ``encoding``, ``line_no`` and ``offset`` of a line, and ``lines``, how many
    belong to it. Only the bytes around each place are read.
    """
    schema = pa.schema([("event_id", pa.int64()), ("source_id", pa.string()), ("line_no", pa.int64()), ("offset", pa.int64()), ("text", pa.string())])

    def earlier(handle: BinaryIO, offset: int, encoding: str) -> list[tuple[int, bytes]]:
        size = chunk
        while True:
            start = max(0, offset - size)
            found = [line for line in raw_lines(handle, start, offset, encoding) if line[0] < offset] if before else []
            if start == 0 or len(found) >= before:
                return found[-before:] if before else []
            size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                store, inner = store_of(row["source_id"])
                with store.open_input_file(inner) as handle:
                    lines = earlier(handle, row["offset"], row["encoding"])
                    number = row["line_no"] - len(lines)
                    # A line begins at its offset, so a search from there finds it first; the first line begins behind the mark.
                    start = row["offset"] if row["line_no"] > 1 else 0
                    for k, line in enumerate(raw_lines(handle, start, 1 << 62, row["encoding"], chunk)):
                        if k >= row["lines"] + after:
                            break
                        lines.append(line)
                    rows += [(row["event_id"], row["source_id"], number + k, offset, decode(raw, row["encoding"])) for k, (offset, raw) in enumerate(lines)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema)

    fields = wanted.select("event_id", "source_id", "encoding", "line_no", "offset", "lines")
    return fields.mapInArrow(run, "event_id long, source_id string, line_no long, offset long, text string")

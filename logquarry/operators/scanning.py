"""A quick look at many files before an import, from their heads and tails only.

A task reads at most ``PEEK_BYTES`` at either end of a file. Layout, encoding and first and last time come from
there; copies of growing logs are told from samples of ``SAMPLE`` bytes at compared lengths, which the
import checks in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions import names, times
from logquarry.operators import formats, growing, sessions
from logquarry.session import settled
from logquarry.sources import lines, ranges
from logquarry.sources.files import store_of

# Fixed value.
PEEK_BYTES = 64 << 10
SAMPLE = growing.START
#: The layout whose lines belong to sessions.
EVENT_LOG = "mdaemon"


def ends(files: DataFrame) -> DataFrame:
    """``files`` (``path``, ``size``) with ``head``, ``tail`` (empty where the head is the whole file) and ``error``."""
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("head", pa.binary()), ("tail", pa.binary()), ("error", pa.string())])

    def look(path: str, size: int) -> dict:
        try:
            store, inner = store_of(path)
            with store.open_input_file(inner) as handle:
                head, tail = handle.read(PEEK_BYTES), b""
                if size > PEEK_BYTES:
                    handle.seek(max(PEEK_BYTES, size - PEEK_BYTES))
                    tail = handle.read(PEEK_BYTES)
        except (OSError, pa.ArrowInvalid) as error:
            return {"path": path, "size": size, "error": str(error)}
        return {"path": path, "size": size, "head": head, "tail": tail}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch["path"].to_pylist(), batch["size"].to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([look(path, size)], schema)

    return files.select("path", "size").mapInArrow(run, "path string, size long, head binary, tail binary, error string")


def of_samples(wanted: DataFrame) -> DataFrame:
    """Like ``growing.of_paths``, from the first bytes and those before each length."""
    schema = pa.schema([("file_id", pa.string()), ("found", pa.list_(pa.struct([("length", pa.int64()), ("sha", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, lengths in zip(batch["file_id"].to_pylist(), batch["lengths"].to_pylist(), strict=True):
                found = []
                try:
                    store, inner = store_of(path)
                    with store.open_input_file(inner) as handle:
                        first = handle.read(SAMPLE)
                        for length in lengths:
                            handle.seek(length - SAMPLE)
                            piece = handle.read(SAMPLE)
                            if len(piece) < SAMPLE:
                                break
                            found.append({"length": length, "sha": hashlib.sha256(first + piece).hexdigest()})
                except (OSError, pa.ArrowInvalid):
                    found = []
                yield pa.RecordBatch.from_pylist([{"file_id": path, "found": found}], schema)

    return wanted.select("file_id", "lengths").mapInArrow(run, f"file_id string, found {growing.DIGESTS}")


def _times(pieces: DataFrame, layouts: DataFrame, files: DataFrame) -> DataFrame:
    """``path``, ``first_ms`` and ``last_ms``: the first time at the head, and the last at the tail, or at the head of a short file."""
    dates = files.select(F.col("source_id"), names.date_from_name(F.col("source_id")).alias("file_date"))
    every = None
    for layout in sorted(r["layout"] for r in layouts.select("layout").distinct().collect()):  # at most one a layout
        some = pieces.join(layouts.where(F.col("layout") == layout).select("path"), "path", "left_semi")
        # Head and tail are texts of their own.
        some = some.select(F.concat_ws("|", "end", "path").alias("source_id"), "line_no", "text")
        days = dates.select(F.explode(F.array(F.concat(F.lit("head|"), "source_id"), F.concat(F.lit("tail|"), "source_id"))).alias("source_id"), "file_date")
        parsed = sessions.parse(some) if layout == EVENT_LOG else formats.parse(some, layout, days)
        told = parsed.where("wall is not null").select("source_id", "line_start", times.wall_ms(F.col("wall")).alias("ms"))
        every = told if every is None else every.unionByName(told)
    if every is None:
        return files.limit(0).select(F.col("source_id").alias("path"), F.lit(None).cast("long").alias("first_ms"), F.lit(None).cast("long").alias("last_ms"))
    found = every.select(F.substring_index("source_id", "|", 1).alias("end"), F.expr("substring(source_id, 6)").alias("path"), "line_start", "ms")
    found = found.groupBy("path").agg(
        F.min_by("ms", F.when(F.col("end") == "head", F.col("line_start"))).alias("first_ms"),
        F.max_by("ms", F.when(F.col("end") == "tail", F.col("line_start"))).alias("_tail"),
        F.max_by("ms", F.when(F.col("end") == "head", F.col("line_start"))).alias("_head"),
    )
    short = files.select(F.col("source_id").alias("path"), (F.col("size") <= PEEK_BYTES).alias("_short"))
    return found.join(short, "path").select("path", "first_ms", F.when(F.col("_short"), F.col("_head")).otherwise(F.col("_tail")).alias("last_ms"))


def scan(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """What an import of ``files`` (``path``, ``length``, ``modificationTime``) would read.

    ``path``, ``name``, ``size``, ``modified`` (ms), ``kind``, ``day``, ``layout``, ``encoding``, ``first_ms``, ``last_ms`` (of the
    clock as it is written), ``imported``, ``within`` (the name of a longer copy that begins with the file), ``replaces`` (names of sources that
    the file goes on from) and ``error``. ``known`` are the sources of an investigation; one of the same path, size and time
    of change is imported.
    """
    base = files.select("path", F.col("length").cast("long").alias("size"), F.unix_millis("modificationTime").alias("modified"))
    count = max(1, base.rdd.getNumPartitions())
    looked = settled(ends(base.repartition(count, "path")))
    coded = looked.where("error is null").select("path", "size", "head", "tail", ranges.encoding_of(F.col("head")).alias("encoding"))
    # Cut off in the middle: the last line of a head that isn't the whole file, and the first one of a tail.
    head = lines.lines_of(coded.select(F.col("path"), lines.decoded("head", "encoding").alias("text")), "path", F.regexp_replace("text", "^﻿", ""))
    cut = coded.where(F.col("size") > PEEK_BYTES).select(F.col("path").alias("source_id"))
    last = head.join(cut, "source_id", "left_semi").groupBy("source_id").agg(F.max("line_no").alias("_cut"))
    head = head.join(last, "source_id", "left").where("_cut is null or line_no < _cut").drop("_cut")
    tail = lines.lines_of(coded.where("length(tail) > 0").select("path", lines.decoded("tail", "encoding").alias("text")), "path", F.col("text")).where("line_no > 1")
    pieces = settled(head.withColumn("end", F.lit("head")).unionByName(tail.withColumn("end", F.lit("tail"))).withColumnRenamed("source_id", "path"))
    layouts = settled(formats.detect(pieces.where("end = 'head'").select(F.col("path").alias("source_id"), "line_no", "text")).select(F.col("source_id").alias("path"), "layout"))
    clock = _times(pieces, layouts, coded.select(F.col("path").alias("source_id"), "size"))
    rows = base.join(looked.select("path", "error"), "path", "left").join(coded.select("path", "encoding"), "path", "left").join(layouts, "path", "left").join(clock, "path", "left")
    if known is not None:
        mine = known.select(F.col("source_id").alias("path"), "size", "modified", F.lit(True).alias("imported")).distinct()
        rows = rows.join(mine, ["path", "size", "modified"], "left")
    else:
        rows = rows.withColumn("imported", F.lit(None).cast("boolean"))
    rows = rows.select(
        "path", names.leaf(F.col("path")).alias("name"), "size", "modified", names.source_kind(F.col("path")).alias("kind"), names.date_from_name(F.col("path")).alias("day"),
        F.when(F.col("error").isNull(), F.coalesce("layout", F.lit("generic"))).alias("layout"), "encoding", "first_ms", "last_ms", F.coalesce("imported", F.lit(False)).alias("imported"), "error",
    )
    rows = settled(rows)
    return _with_copies(rows, known, count)


def _with_copies(rows: DataFrame, known: DataFrame | None, count: int) -> DataFrame:
    """``rows`` with ``within`` and ``replaces``; pairs of known sources don't count."""
    fresh = rows.where("error is null AND not imported").select(F.col("path").alias("file_id"), "size", F.lit(False).alias("old"))
    both = fresh
    if known is not None:
        both = fresh.unionByName(known.select(F.col("source_id").alias("file_id"), "size", F.lit(True).alias("old")).join(fresh.select("file_id"), "file_id", "left_anti"))
    both = settled(both.repartition(count, "file_id"))
    pairs = settled(growing.growing_copies(both.select("file_id", "size"), of_samples))
    pairs = pairs.join(both.select("file_id", "old"), "file_id").join(both.select(F.col("file_id").alias("longest"), F.col("old").alias("_old")), "longest")
    label = lambda path, other: names.copy_label(F.col(path), F.col(other))
    within = pairs.where("not old").select(F.col("file_id").alias("path"), label("longest", "file_id").alias("within"))
    replaces = pairs.where("old AND not _old").groupBy(F.col("longest").alias("path")).agg(F.sort_array(F.collect_list(label("file_id", "longest"))).alias("replaces"))
    out = rows.join(within, "path", "left").join(replaces, "path", "left")
    return out.withColumn("replaces", F.coalesce("replaces", F.array().cast("array<string>")))


def groups(scanned: DataFrame) -> DataFrame:
    """A row for each kind: its files, bytes, those imported and those within longer copies, first and last time, layouts."""
    return scanned.groupBy("kind").agg(
        F.count("*").alias("files"),
        F.sum("size").alias("bytes"),
        F.count_if("imported").alias("imported"),
        F.count_if(F.col("within").isNotNull()).alias("within"),
        F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"),
        F.sort_array(F.collect_set("layout")).alias("layouts"),
    )


@dataclass(frozen=True)
class Window:
    """What comes first: kinds, and a span of time in ms; what lies outside is read in the ``background`` or left out (``skip``)."""

    kinds: tuple[str, ...]
    start_ms: int | None = None
    end_ms: int | None = None
    outside: str = "background"


def plan(scanned: DataFrame, window: Window) -> DataFrame:
    """``scanned`` with ``plan``: ``first``, ``background`` or ``skip``. Files without a time are never outside."""
    inside: Column = F.col("first_ms").isNull()
    # A second's last milliseconds belong to it.
    last = (1 << 61) if window.end_ms is None else window.end_ms + 999
    inside = inside | ((F.col("last_ms") >= (window.start_ms if window.start_ms is not None else -(1 << 61))) & (F.col("first_ms") <= last))
    chosen = F.when(F.col("imported") | F.col("error").isNotNull(), "skip").when(~inside, window.outside).when(F.col("kind").isin(*window.kinds), "first").otherwise("background")
    return scanned.withColumn("plan", chosen)

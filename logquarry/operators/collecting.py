"""Selecting files by type and day, without duplicates, under names that don't collide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions.names import type_matches
from logquarry.operators import growing

MANIFEST = ["Status", "Date", "LogType", "OutputName", "OriginalName", "SourceKind", "SourceName", "ArchiveEntry", "Bytes", "SHA256", "Error"]


def matrix(files: DataFrame) -> DataFrame:
    """Files and bytes by type and day with totals: null in ``log_type`` or ``day`` where ``all_types`` or ``all_days`` is 1; undated files have day null."""
    return files.groupingSets([[F.col("log_type"), F.col("day")], [F.col("log_type")], [F.col("day")], []], F.col("log_type"), F.col("day")).agg(
        F.grouping("log_type").cast("int").alias("all_types"), F.grouping("day").cast("int").alias("all_days"), F.count("*").alias("files"), F.sum("size").alias("bytes")
    )


def selected(files: DataFrame, days: list[str] | None = None, types: list[str] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Dated files: those of explicit (``log_type``, ``day``) pairs, else of the days and type patterns."""
    dated = files.where(F.col("day").isNotNull())
    if pairs is not None:
        return dated.join(pairs.select("log_type", "day").distinct(), ["log_type", "day"], "left_semi")
    if days:
        dated = dated.where(F.col("day").cast("string").isin(days))
    return dated.where(type_matches(F.col("log_type"), types))


def content_hash(content: Column) -> Column:
    return F.upper(F.sha2(content, 256))


def without_duplicates(files: DataFrame, order: str, known: DataFrame | None = None) -> DataFrame:
    """``files`` (``sha256``) with ``first``, the order value of the first file of the same content, and ``duplicate``.

    Contents of ``known`` (``sha256``) count as there already. The first is an
    aggregate and joined back, so a content that many files share stays spread out.
    """
    firsts = files.groupBy("sha256").agg(F.min(order).alias("first"))
    if known is not None:
        firsts = firsts.join(known.select("sha256", F.lit(True).alias("known")).distinct(), "sha256", "left")
    else:
        firsts = firsts.withColumn("known", F.lit(None).cast("boolean"))
    joined = files.join(firsts, "sha256")
    return joined.withColumn("duplicate", F.col("known").isNotNull() | (F.col(order) != F.col("first"))).drop("known")


def safe_name(name: Column) -> Column:
    """The name without characters that file systems refuse."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), F.lit(". ")), F.lit("")), F.lit("file"))


def output_names(files: DataFrame, order: str, piece: int = 10_000) -> DataFrame:
    """``files`` with ``output_name``: the safe name, with ``__2``, ``__3``... from the second of a name on, case aside.

    Numbers are counted by piece of the integer ``order`` and summed over
    pieces. A file whose own name reads like a numbered one keeps its name, and
    numbers go on behind the highest such suffix.
    """
    base = files.withColumn("_safe", safe_name(F.col("name"))).withColumn("_fold", F.lower("_safe")).withColumn("_piece", F.floor(F.col(order) / piece))
    inside = F.row_number().over(Window.partitionBy("_fold", "_piece").orderBy(order))
    sizes = base.groupBy("_fold", "_piece").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_fold").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = base.select("_fold").distinct().where(F.col("_fold").rlike(r"__\d+(?:\.[^.]*)?$"))
    taken = taken.select(F.regexp_replace("_fold", r"__(\d+)((?:\.[^.]*)?)$", "$2").alias("_fold"), F.regexp_extract("_fold", r"__(\d+)(?:\.[^.]*)?$", 1).cast("int").alias("_used"))
    taken = taken.groupBy("_fold").agg(F.max("_used").alias("_used"))
    numbered = base.withColumn("_in", inside).join(sizes.withColumn("_before", before).drop("_n"), ["_fold", "_piece"]).join(taken, "_fold", "left")
    number = (F.col("_before") + F.col("_in")).cast("int")
    shown = F.when(number == 1, F.col("_safe")).otherwise(F.concat(F.regexp_replace("_safe", r"(?<=.)\.[^.]*$", ""), F.lit("__"), F.when(F.col("_used").isNotNull(), F.col("_used") + number - 1).otherwise(number).cast("string"), F.regexp_extract("_safe", r".(\.[^.]*)$", 1)))
    return numbered.withColumn("output_name", shown).drop("_safe", "_fold", "_piece", "_in", "_before", "_used")


def manifest(files: DataFrame, order: str) -> DataFrame:
    """One row a file: Selected under its output name, or Duplicate with the first one's; archive errors first.

    ``files``: ``order``, ``log_type``, ``day``, ``name``, ``size``, ``sha256``, ``source_kind``, ``source_name``, ``entry``, ``error``.
    """
    judged = without_duplicates(files.where(F.col("error").isNull()), order)
    kept = output_names(judged.where(~F.col("duplicate")), order)
    names = kept.select(F.col(order).alias("first"), "output_name")
    rows = manifest_rows(judged.join(names, "first"), files.where(F.col("error").isNotNull()), order)
    return rows.orderBy("_rank", "_order").select(*MANIFEST)


def manifest_rows(rows: DataFrame, bad: DataFrame, order: str) -> DataFrame:
    """The manifest's columns with ``_rank`` and ``_order`` to sort them by: of judged and named files, and of unreadable archives."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    none = F.lit("")

    def columns(rank: int, **values: Column) -> list[Column]:
        return [F.lit(rank).alias("_rank"), F.col(order).alias("_order"), *[values.get(name, none).alias(name) for name in MANIFEST]]

    source = {"SourceKind": text("source_kind"), "SourceName": text("source_name")}
    good = rows.select(*columns(
        1, Status=F.when(F.col("duplicate"), "Duplicate").otherwise("Selected"), Date=text("day"), LogType=text("log_type"), OutputName=F.col("output_name"),
        OriginalName=text("name"), ArchiveEntry=text("entry"), Bytes=text("size"), SHA256=text("sha256"), **source,
    ))
    return bad.select(*columns(0, Status=F.lit("ArchiveError"), Bytes=F.lit("0"), Error=text("error"), **source)).union(good)


def growing_copies(files: DataFrame, key_bytes: int = growing.START) -> DataFrame:
    """``file_id`` and ``longest``: the longest file each is a beginning of (``content`` as binary, ``size``); see ``growing``."""
    return growing.growing_copies(files, growing.of_contents(files), key_bytes)

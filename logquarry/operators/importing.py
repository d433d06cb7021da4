"""Import as one flow: judge the files, parse each layout's, add them to an investigation, settle its times.

Every decision is a join on checksums and digests of beginnings. A phase is one
job over all its files; the investigation's tables get a new version only when
the job has ended, so what fails leaves nothing behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.functions import names
from logquarry.functions.numbering import ranked
from logquarry.operators import entities, formats, growing, scanning, sessions, timeline
from logquarry.operators.workspace import SOURCES, Workspace, event_id
from logquarry.session import settled
from logquarry.sources import files, lines, ranges

#: Bytes that copies of a growing log share at the least.
START = 512
#: The layout whose sessions and blocks are followed.
EVENT_LOG = "mdaemon"


def _read(spark: SparkSession, paths: list[str], phase: int, extensions: list[str] | None) -> DataFrame:
    return files.sources(spark, paths, extensions).select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"), F.lit(phase).alias("phase"))


def _planned(scanned: DataFrame, window: scanning.Window) -> DataFrame:
    """The files of a scan that are to be read, those that come first in phase 0."""
    rows = scanning.plan(scanned, window).where("plan <> 'skip'")
    return rows.select("path", "size", "modified", F.when(F.col("plan") == "first", 0).otherwise(1).alias("phase"))


def chosen_files(spark: SparkSession, priority: list[str], background: list[str] | None = None, extensions: list[str] | None = None) -> DataFrame:
    """``path``, ``size``, ``modified`` and ``phase`` of the files below the given paths; one below both comes first."""
    found = _read(spark, priority, 0, extensions)
    if background:
        found = found.unionByName(_read(spark, background, 1, extensions)).groupBy("path", "size", "modified").agg(F.min("phase").alias("phase"))
    return found


def judged(space: Workspace, found: DataFrame) -> DataFrame:
    """What is to happen with each file of ``chosen_files``: with ``sha256``, ``encoding``, ``outcome``, ``other``.

    ``duplicate``: the content is known or that of an earlier file (``other``).
    ``continued``: a longer file (``other``) begins with it; the longer one
    moves to the first phase if this one was in it. ``failed``: it can't be
    read. Everything else is ``imported``; ``replaces`` lists the known sources
    that begin it.
    """
    # A hash of a file's path deals files to tasks: their rows are small, their contents aren't.
    digests = files.with_digest(found.repartition(max(1, found.rdd.getNumPartitions()), "path"), lines.SAMPLE_BYTES)
    read = settled(digests.select(*found.columns, F.col("head").isNull().alias("failed"), "sha256", ranges.encoding_of(F.col("head")).alias("encoding")))
    bad, read = read.where("failed").drop("failed"), read.where("not failed").drop("failed")
    known = space.read("sources", SOURCES)
    order = F.struct("phase", "path")
    firsts = read.groupBy("sha256").agg(F.min(order).alias("first"))
    there = known.groupBy("sha256").agg(F.min("source_id").alias("there"))
    read = read.join(firsts, "sha256").join(there, "sha256", "left")
    read = read.withColumn("same", F.coalesce("there", F.when(F.col("first.path") != F.col("path"), F.col("first.path")))).drop("first", "there")

    # Growing copies among the files that stay and the known ones that begin like one of them.
    fresh = read.where("same is null").select("path", "size")
    old = known.select(F.col("source_id").alias("path"), "size")
    starts = lambda df: files.with_content(df, limit=START).where(F.length("content") == START).select("path", "size", F.sha2("content", 256).alias("start"))
    alike = starts(old).join(starts(fresh).select("start").distinct(), "start", "left_semi").select("path", "size")
    both = settled(fresh.unionByName(alike)).select(F.col("path").alias("file_id"), "size")
    grown = growing.growing_copies(both.repartition(max(1, found.rdd.getNumPartitions()), "file_id"), start=START)
    old = known.select("source_id", F.lit(True).alias("old"))
    grown = settled(grown.join(old.withColumnRenamed("source_id", "file_id"), "file_id", "left"))
    longer = grown.where("old is null").select(F.col("file_id").alias("path"), F.col("longest").alias("within"))
    replaced = grown.where("old").groupBy(F.col("longest").alias("path")).agg(F.sort_array(F.collect_list("file_id")).alias("replaces"))
    read = read.join(longer, "path", "left").join(replaced, "path", "left")
    raised = read.where("within is not null").groupBy(F.col("within").alias("path")).agg(F.min("phase").alias("raised"))
    read = read.join(raised, "path", "left").withColumn("phase", F.least("phase", F.coalesce("raised", "phase")))
    outcome = F.when(F.col("same").isNotNull(), "duplicate").when(F.col("within").isNotNull(), "continued").otherwise("imported")
    none = F.array().cast("array<string>")
    good = read.select("path", "size", "modified", "phase", "sha256", "encoding", outcome.alias("outcome"), F.coalesce("same", "within").alias("other"), F.coalesce("replaces", none).alias("replaces"))
    return settled(good.unionByName(bad.select("path", "size", "modified", "phase", "sha256", "encoding", F.lit("failed").alias("outcome"), F.lit(None).cast("string").alias("other"), none.alias("replaces"))))


def read_events(chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of files (``path``, ``encoding``), and each file's layout. A file's day in its name dates lines that only have a clock."""
    rows = settled(ranges.read(chosen.select("path", "size", "encoding")).drop("offset"))
    layouts = settled(formats.detect(rows))
    dates = chosen.select(F.col("path").alias("source_id"), names.date_from_name(F.col("path")).alias("file_date"))
    events = None
    for layout in sorted(r["layout"] for r in layouts.select("layout").distinct().collect()) or ["generic"]:  # at most one a layout
        some = rows.join(layouts.where(F.col("layout") == layout).select("source_id"), "source_id", "left_semi")
        parsed = sessions.parse(some) if layout == EVENT_LOG else formats.parse(some, layout, dates)
        events = parsed if events is None else events.unionByName(parsed)
    return events, layouts.select("source_id", "layout")


def identified(events: DataFrame, numbers: DataFrame) -> DataFrame:
    """``events`` with ``event_id``, from the number of the source (``source_id``, ``number``) and the first line, and ``ctx``: the context under its source."""
    where = F.when(F.col("context").isNotNull(), F.concat_ws("|", "source_id", "context"))
    told = events.join(numbers, "source_id").withColumn("event_id", event_id(F.col("number"), F.col("line_start"))).drop("number")
    return told.withColumn("ctx", where)


def import_paths(
    spark: SparkSession, space: Workspace, priority: list[str], background: list[str] | None = None, extensions: list[str] | None = None, choice: str = "auto", region: str = "UTC"
) -> DataFrame:
    """``import_files`` of the files below the given paths, those of ``priority`` first."""
    return import_files(space, chosen_files(spark, priority, background, extensions), choice, region)


def import_scanned(space: Workspace, scanned: DataFrame, window: scanning.Window, choice: str = "auto", region: str = "UTC") -> DataFrame:
    """``import_files`` of what a scan's plan wants: kinds and times of ``window`` first, the rest later or never."""
    return import_files(space, _planned(scanned, window), choice, region)


def import_files(space: Workspace, found: DataFrame, choice: str = "auto", region: str = "UTC") -> DataFrame:
    """Read files (``chosen_files``) into ``space``, those of phase 0 first, and report what became of each.

    Returns ``path``, ``phase`` (``priority`` or ``background``), ``outcome``
    (``imported``, ``duplicate``, ``continued``, ``failed``, ``replaced``) and ``other``: the
    file that has or begins with the content, or that took the place of a
    known source. A longer copy takes over the zone and clock settings of the
    source it replaces. Contexts that turn out to be workers are dissolved.
    Empty files aren't listed, as Spark leaves them out of any scan.
    """
    plan = judged(space, found)
    for phase in (0, 1):
        chosen = plan.where((F.col("outcome") == "imported") & (F.col("phase") == phase))
        if chosen.isEmpty():
            continue
        numbers = settled(ranked(chosen.select(F.col("path").alias("source_id")), ["source_id"]).withColumn("number", F.col("number") + (space.next_number() - 1)))
        events, layouts = read_events(chosen)
        events = settled(identified(events, numbers))
        known = space.read("sources", SOURCES)
        replaces = chosen.select("path", F.explode("replaces").alias("source_id"))
        taken = replaces.join(known, "source_id").groupBy("path").agg(F.max_by(F.struct("tz_mode", "tz_offset", "skew_ms"), "size").alias("s"))
        fresh = chosen.join(layouts.withColumnRenamed("source_id", "path"), "path", "left").join(taken, "path", "left")
        fresh = fresh.select(
            F.col("path").alias("source_id"), F.substring_index("path", "/", -1).alias("name"), F.coalesce("layout", F.lit("generic")).alias("layout"), "encoding", "sha256", "size", F.lit(None).cast("int").alias("detected_offset"),
            F.coalesce("s.tz_mode", F.lit("auto")).alias("tz_mode"), F.col("s.tz_offset").alias("tz_offset"), F.coalesce("s.skew_ms", F.lit(0)).cast("long").alias("skew_ms"), "modified",
        )
        fresh = settled(fresh.join(numbers, "source_id"))
        timed = timeline.resolve(events, fresh, timeline.default_zone(timeline.stated_zones(events, fresh), choice), region)
        workers = sessions.limit_workers(timed).where("worker is not null").select(F.col("worker").alias("ctx")).distinct()
        limited = events.join(workers.withColumn("_worker", F.lit(True)), "ctx", "left")
        limited = settled(limited.withColumn("ctx", F.when(F.col("_worker").isNull(), F.col("ctx"))).drop("_worker"))
        occurrences = entities.occurrences(limited).unionByName(entities.context_occurrences(limited))
        space.add(fresh, limited, occurrences, settled(replaces.select("source_id").distinct()))
    report = plan.select("path", F.when(F.col("phase") == 0, "priority").otherwise("background").alias("phase"), "outcome", "other")
    gone = plan.where("outcome = 'imported'").select(F.explode("replaces").alias("path"), F.when(F.col("phase") == 0, "priority").otherwise("background").alias("phase"), F.lit("replaced").alias("outcome"), F.col("path").alias("other"))
    return report.unionByName(gone)

"""Times of events, bins, histograms, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions import times


def stated_zones(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct zones that exact lines or files state."""
    lines = events.where((F.col("ts_flag") == "exact") & F.col("offset").isNotNull()).select(F.col("offset").cast("int").alias("zone"))
    return lines.union(sources.where("detected_offset is not null").select(F.col("detected_offset").cast("int"))).distinct()


def default_zone(zones: DataFrame, choice: str = "auto") -> tuple[int | None, str]:
    """(minutes or None for the local region, flag): a fixed choice, or the one zone all statements agree on."""
    if choice.startswith("fixed:"):
        return int(choice[6:]), "source"
    found = [] if choice == "local" else zones.limit(2).collect()
    return (found[0]["zone"], "inferred") if len(found) == 1 else (None, "local")


def resolve(events: DataFrame, sources: DataFrame, default: tuple[int | None, str], region: str = "UTC") -> DataFrame:
    """``events`` with ``off_min``, ``ts_ms`` and the settled ``ts_flag``.

    A line's own zone goes before a zone fixed for its source, one the source
    states, and the default. Inherited and ambiguous times keep their flag. The
    source's clock skew is added. Nothing is stored, so late statements cost a query only.
    """
    minutes, flag = default
    settings = sources.select("source_id", "tz_mode", "tz_offset", "detected_offset", "skew_ms")
    joined = events.join(settings, "source_id", "left")
    fixed = F.when((F.col("tz_mode") == "fixed") & F.col("tz_offset").isNotNull(), F.col("tz_offset"))
    of_source = F.coalesce(fixed, F.col("detected_offset"))
    fallback = F.lit(minutes).cast("int") if minutes is not None else times.local_offset(F.col("wall"), region)
    offset = F.coalesce(F.col("offset"), of_source, fallback)
    settled = (
        F.when(F.col("wall").isNull(), F.when(F.col("ts_flag") == "invalid", "invalid").otherwise("none"))
        .when(F.col("ts_flag").isin("inherited", "ambiguous"), F.col("ts_flag"))
        .when(F.col("offset").isNotNull(), "exact")
        .when(of_source.isNotNull(), "source")
        .otherwise(flag)
    )
    ms = times.wall_ms(F.col("wall")) - offset.cast("long") * 60_000 + F.coalesce("skew_ms", F.lit(0)).cast("long")
    out = joined.withColumn("off_min", F.when(F.col("wall").isNotNull(), offset)).withColumn("ts_ms", ms).withColumn("ts_flag", settled)
    return out.drop("tz_mode", "tz_offset", "detected_offset", "skew_ms")


def zone_stretches(events: DataFrame) -> DataFrame:
    """Per source, runs of consecutive hours with events that have one zone: ``off_min``, first and last hour (wall time) and ``hours``.

    An hour in which the zone changes is part of both runs. Events are brought to
    a row for each source, hour and zone before any window sees them.
    """
    hours = events.where("wall is not null and off_min is not null").select("source_id", F.date_trunc("hour", F.col("wall").cast("timestamp")).alias("hour"), "off_min").distinct()
    before = Window.partitionBy("source_id").orderBy("hour", "off_min")
    opens = hours.withColumn("opens", (~F.lag("off_min").over(before).eqNullSafe(F.col("off_min"))).cast("int"))
    runs = opens.withColumn("run", F.sum("opens").over(before)).groupBy("source_id", "off_min", "run")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return runs.agg(shown(F.min("hour")).alias("first_hour"), shown(F.max("hour")).alias("last_hour"), F.count("*").alias("hours")).drop("run")


def bins(events: DataFrame) -> DataFrame:
    """Counts by source, ten minutes and severity of timed events."""
    return events.where("ts_ms is not null").groupBy("source_id", times.bin_of(F.col("ts_ms")).alias("bin"), "severity").agg(F.count("*").alias("n"))


def source_summary(events: DataFrame) -> DataFrame:
    """Per source: events, first and last time, counts by type and by time flag as maps."""

    def counted(column: str, name: str) -> DataFrame:
        counts = events.groupBy("source_id", column).agg(F.count("*").alias("n"))
        return counts.groupBy("source_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))

    spans = events.groupBy("source_id").agg(F.count("*").alias("events"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    return spans.join(counted("etype", "etypes"), "source_id").join(counted("ts_flag", "time_flags"), "source_id")


def overview(events: DataFrame) -> DataFrame:
    """Event types by count, most frequent first."""
    return events.groupBy("etype").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms")).orderBy(F.desc("n"), "etype")


def _span(events: DataFrame, low: Column, high: Column) -> DataFrame:
    """One row, whatever the input: the range and the bucket size."""
    return events.agg(low.alias("start"), high.alias("stop"))


def histogram(events: DataFrame, level: Column | None = None, buckets: int = times.HISTOGRAM_BUCKETS) -> DataFrame:
    """``bucket``, ``start_ms``, ``bucket_ms``, ``level`` and ``n`` of timed events, empty buckets left out."""
    timed = events.where("ts_ms is not null").withColumn("level", level if level is not None else F.lit(0))
    ends = _span(timed, F.min("ts_ms"), F.max("ts_ms")).first()  # one row
    start, stop = ends["start"] or 0, ends["stop"] or 0
    size = max(times.MIN_BUCKET_MS, -(-(stop - start + 1) // buckets))
    bucket = F.floor((F.col("ts_ms") - start) / size).cast("long")
    counts = timed.groupBy(bucket.alias("bucket"), "level").agg(F.count("*").alias("n"))
    return counts.select("bucket", (F.lit(start) + F.col("bucket") * size).alias("start_ms"), F.lit(size).cast("long").alias("bucket_ms"), "level", "n")


def dense(hist: DataFrame, buckets: int) -> DataFrame:
    """A histogram with a row for every bucket from 0 to ``buckets - 1``."""
    every = hist.sparkSession.range(buckets).toDF("bucket")
    return every.join(hist.select("bucket", "level", "n"), "bucket", "left").select("bucket", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("n", F.lit(0)).alias("n"))


def binned_histogram(binned: DataFrame, sources: list | None = None, min_severity: int = 0, time_from: int | None = None, time_to: int | None = None, buckets: int = times.HISTOGRAM_BUCKETS) -> DataFrame:
    """A coarse histogram out of ``bins``, for many hits; its size is a multiple of ten minutes."""
    some = binned.where(F.col("severity") >= min_severity)
    if sources:
        some = some.where(F.col("source_id").isin(sources))
    if time_from is not None:
        some = some.where(F.col("bin") >= times.bin_of(F.lit(time_from)))
    if time_to is not None:
        some = some.where(F.col("bin") <= times.bin_of(F.lit(time_to)))
    ends = _span(some, F.min("bin"), F.max("bin")).first()
    first, last = ends["start"] or 0, ends["stop"] or 0
    start, stop = first * times.BIN_MS, (last + 1) * times.BIN_MS - 1
    size = max(times.BIN_MS, -(-(-(-(stop - start + 1) // buckets)) // times.BIN_MS) * times.BIN_MS)
    bucket = F.floor((F.col("bin") * times.BIN_MS - start) / size).cast("long")
    return some.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).select("bucket", (F.lit(start) + F.col("bucket") * size).cast("long").alias("start_ms"), F.lit(size).cast("long").alias("bucket_ms"), "n")

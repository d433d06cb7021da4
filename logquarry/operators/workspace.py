"""An investigation as a folder of tables: events and identifiers by source, settings, decisions.

Tables with a row for each event or identifier are made of parts, one for each import. The
table of sources says which part holds a source, so adding or removing one
touches its own part alone; totals are summed from what is kept by source.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.functions import times
from logquarry.operators import entities as ent
from logquarry.operators import timeline
from logquarry.session import settled

SOURCES = "source_id string, name string, layout string, encoding string, sha256 string, size long, detected_offset int, tz_mode string, tz_offset int, skew_ms long"
#: What a stored source has besides: when its file changed last, its number, the part that holds its rows, and whether it was removed.
STORED = {"modified": "long", "number": "long", "part": "string", "removed": "boolean"}
#: Tables that grow by parts: those that hold a row for each event or identifier, and what is kept of them by source.
PARTED = ("events", "occurrences", "stats", "accounts", "zones")
#: Bits of an event's id that hold its line; the others hold its source's number.
LINE_BITS = 40
DECISIONS = "kind string, a_kind string, a_value string, b_kind string, b_value string"
_NAME = re.compile(r"[a-z0-9][a-z0-9-]{0,63}")


def investigations(spark: SparkSession, root: str) -> list[str]:
    """Names of the investigations below ``root``, those with a readable table of sources."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    found = sorted(x.getPath().getName() for x in store.listStatus(path) if x.isDirectory())
    return [name for name in found if _NAME.fullmatch(name) and _readable(Workspace(spark, root, name))]


def _readable(space: Workspace) -> bool:
    try:
        return space.read("sources") is not None
    except AnalysisException:
        return False


def with_columns(sources: DataFrame) -> DataFrame:
    """A table of sources with the columns of ``STORED``, null where it lacks them."""
    for name, kind in STORED.items():
        if name not in sources.columns:
            sources = sources.withColumn(name, F.lit(None).cast(kind))
    return sources


def event_id(number: Column, line: Column) -> Column:
    """The id of the event that begins at a line of the source of that number; no two events share one."""
    return F.shiftleft(number, LINE_BITS).bitwiseOR(line.cast("long"))


def statistics(events: DataFrame, occurrences: DataFrame) -> DataFrame:
    """What is kept of each identifier by source: events, groups, the first event and its display, and its times.

    Times without a zone stay as they are written, so that settings can change later.
    """
    own = F.col("offset").isNotNull()
    wall = times.wall_ms(F.col("wall"))
    stated, bare = F.when(own, wall - F.col("offset").cast("long") * 60_000), F.when(~own, F.col("wall"))
    rows = occurrences.join(events.select("event_id", "ctx", "wall", "offset"), "event_id")
    return rows.groupBy("kind", "value", "source_id").agg(
        F.countDistinct("event_id").alias("events"),
        F.countDistinct(ent.group_key()).alias("groups"),
        F.min("event_id").alias("first_event"),
        F.min_by("display", "event_id").alias("display"),
        F.min(stated).alias("first_ms"),
        F.max(stated).alias("last_ms"),
        F.min(bare).alias("first_wall"),
        F.max(bare).alias("last_wall"),
    )


class Workspace:
    """Tables below one folder. Every change writes a new version of a table and then points to it, so a failed write leaves the old one."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        if not _NAME.fullmatch(name):
            raise ValueError(f"not a name for an investigation: {name!r}")
        self.spark, self.folder = spark, f"{root.rstrip('/')}/{name}"

    def delete(self) -> None:
        """Remove the investigation with all its tables."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _version(self, table: str) -> str | None:
        try:
            found = self.spark.read.text(f"{self.folder}/{table}/current").collect()  # one line
        except AnalysisException:
            return None
        return found[0]["value"] if found else None

    def read(self, table: str, schema: str | None = None) -> DataFrame | None:
        """The rows of now; those of removed sources aren't among them."""
        if table in PARTED:
            return self._parts(table)
        found = self._whole(table)
        if found is None:
            return self.spark.createDataFrame([], schema) if schema else None
        return found.where("removed is null or not removed") if table == "sources" and "removed" in found.columns else found

    def _whole(self, table: str) -> DataFrame | None:
        version = self._version(table)
        return None if version is None else self.spark.read.parquet(f"{self.folder}/{table}/{version}")

    def _sources(self) -> DataFrame:
        """All sources, also removed ones whose rows are still in a part."""
        found = self._whole("sources")
        return with_columns(self.spark.createDataFrame([], SOURCES) if found is None else found)

    def _parts(self, table: str) -> DataFrame | None:
        """The rows of the parts that a source is in; a part has a row for each import, so their list is short."""
        every = self._sources().where("part is not null")
        names = sorted(r["part"] for r in every.groupBy("part").agg(F.count_if(~F.coalesce("removed", F.lit(False))).alias("n")).where("n > 0").collect())
        if not names:
            return None
        rows = self.spark.read.parquet(*[f"{self.folder}/{table}/{n}" for n in names])
        return rows.join(every.where("removed").select("part", "source_id"), ["part", "source_id"], "left_anti").drop("part")

    def write(self, table: str, df: DataFrame) -> None:
        version = uuid.uuid4().hex
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{table}/{version}")
        self.spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{table}/current")

    def next_number(self) -> int:
        """A number above those of all sources that were ever added."""
        return (self._sources().agg(F.max("number")).first()[0] or 0) + 1

    def add(self, sources: DataFrame, events: DataFrame, occurrences: DataFrame, gone: DataFrame | None = None) -> None:
        """Add sources with their events; a source whose content is known already is left out. Those of ``gone`` (``source_id``) go.

        The new rows are one part of each table, and what is kept by source is made from
        them alone; older parts aren't read or written. Nothing is seen before the table of sources names the part.
        """
        every, part = self._sources(), uuid.uuid4().hex
        if gone is not None:
            every = self._without(every, gone)
        known = every.where("removed is null or not removed")
        fresh = with_columns(sources).join(known.select("sha256"), "sha256", "left_anti").join(known.select("source_id"), "source_id", "left_anti")
        fresh = settled(fresh.withColumn("part", F.lit(part)).withColumn("removed", F.lit(False)).select(*every.columns))
        new_events = events.join(fresh.select("source_id"), "source_id", "left_semi")
        new_occ = occurrences.drop("source_id").join(new_events.select("event_id", "source_id"), "event_id")
        put = lambda table, df: df.withColumn("part", F.lit(part)).write.option("compression", "zstd").parquet(f"{self.folder}/{table}/{part}")
        put("events", new_events)
        put("occurrences", new_occ)
        events, occurrences = (self.spark.read.parquet(f"{self.folder}/{t}/{part}") for t in ("events", "occurrences"))
        put("stats", statistics(events, occurrences))
        put("accounts", ent.address_accounts(events, occurrences, ent.SHARED_ACCOUNTS, by_source=True))
        put("zones", events.where((F.col("ts_flag") == "exact") & F.col("offset").isNotNull()).select("source_id", F.col("offset").cast("int").alias("zone")).distinct())
        self.write("sources", every.unionByName(fresh))

    def _without(self, every: DataFrame, gone: DataFrame) -> DataFrame:
        """``every`` source with those of ``gone`` marked as removed; those of parts that are no longer in use are forgotten."""
        marked = every.join(gone.select("source_id", F.lit(True).alias("_gone")).distinct(), "source_id", "left")
        marked = marked.withColumn("removed", F.coalesce("removed", F.lit(False)) | F.coalesce("_gone", F.lit(False))).select(*every.columns)
        used = marked.where("not removed and part is not null").select("part").distinct()
        # Numbers aren't given again, so the highest one stays.
        top = marked.agg(F.max("number").alias("number"))
        dead = marked.where("removed")
        return marked.where("not removed").unionByName(dead.join(used, "part", "left_semi").unionByName(dead.join(used, "part", "left_anti").join(top, "number", "left_semi")))

    def remove(self, source_id: str) -> None:
        """Remove a source; its events and identifiers aren't seen any more. Its part is left as it is."""
        self.write("sources", self._without(self._sources(), self.spark.createDataFrame([(source_id,)], "source_id string")))

    def compact(self) -> None:
        """Write all rows of now into one part, without those of removed sources."""
        part, live = uuid.uuid4().hex, self._sources().where("not removed and part is not null")
        for table in PARTED:
            rows = self._parts(table)
            if rows is None:
                return
            rows.withColumn("part", F.lit(part)).write.option("compression", "zstd").parquet(f"{self.folder}/{table}/{part}")
        self.write("sources", live.withColumn("part", F.lit(part)))

    def replace(self, source_id: str, sources: DataFrame, events: DataFrame, occurrences: DataFrame) -> None:
        """Put a longer copy in a source's place; zone and clock settings go over to it."""
        old = self.read("sources", SOURCES).where(F.col("source_id") == source_id).select("tz_mode", "tz_offset", "skew_ms").first()
        self.remove(source_id)
        settings = {"tz_mode": old["tz_mode"], "tz_offset": old["tz_offset"], "skew_ms": old["skew_ms"]} if old else {}
        for name, value in settings.items():
            sources = sources.withColumn(name, F.lit(value).cast(sources.schema[name].dataType))
        self.add(sources, events, occurrences)

    def set_time(self, source_id: str, tz_offset: int | None = None, skew_ms: int = 0) -> None:
        """Fix a source's zone, or leave it to its own statements, and correct its clock."""
        here = F.col("source_id") == source_id
        rows = self._sources()
        rows = rows.withColumn("tz_mode", F.when(here, "fixed" if tz_offset is not None else "auto").otherwise(F.col("tz_mode")))
        rows = rows.withColumn("tz_offset", F.when(here, F.lit(tz_offset).cast("int")).otherwise(F.col("tz_offset"))).withColumn("skew_ms", F.when(here, F.lit(skew_ms).cast("long")).otherwise(F.col("skew_ms")))
        self.write("sources", rows)

    def _default(self, choice: str) -> tuple[int | None, str]:
        """The zone that all statements agree on; lines' statements are kept by source."""
        zones, detected = self._parts("zones"), self.read("sources", SOURCES).where("detected_offset is not null").select(F.col("detected_offset").cast("int").alias("zone"))
        return timeline.default_zone((detected if zones is None else zones.select("zone").union(detected)).distinct(), choice)

    def events(self, choice: str = "auto", region: str = "UTC") -> DataFrame:
        """Events with times as the settings of now have them."""
        return timeline.resolve(self.read("events"), self.read("sources", SOURCES), self._default(choice), region)

    def entities(self, choice: str = "auto", region: str = "UTC") -> DataFrame:
        """Identifiers with their totals, from what is kept by source; no event is read."""
        stats = self._parts("stats")
        ends = [F.struct(F.lit(w).alias("at"), F.col(f"{w}_wall").alias("wall"), F.lit(None).cast("int").alias("offset"), F.lit("local").alias("ts_flag")) for w in ("first", "last")]
        told = stats.select("kind", "value", "source_id", F.inline(F.array(*ends))).where("wall is not null")
        told = timeline.resolve(told, self.read("sources", SOURCES), self._default(choice), region)
        told = told.groupBy("kind", "value", "source_id").agg(F.min(F.when(F.col("at") == "first", F.col("ts_ms"))).alias("_first"), F.max(F.when(F.col("at") == "last", F.col("ts_ms"))).alias("_last"))
        skew = self.read("sources", SOURCES).select("source_id", F.coalesce("skew_ms", F.lit(0)).alias("_skew"))
        rows = stats.join(told, ["kind", "value", "source_id"], "left").join(skew, "source_id", "left")
        rows = rows.withColumn("first_ms", F.least(F.col("first_ms") + F.col("_skew"), "_first")).withColumn("last_ms", F.greatest(F.col("last_ms") + F.col("_skew"), "_last"))
        shown = rows.groupBy("kind", "value").agg(F.min_by("display", "first_event").alias("display"))
        return ent.flagged(ent.entity_totals(rows), shown, self._parts("accounts").select("kind", "value", "account").distinct())

    def decide(self, kind: str, a: tuple[str, str], b: tuple[str, str] | None = None, undo: bool = False) -> None:
        """Exclude or include an identifier, or exclude a link; ``undo`` takes it back."""
        row = (kind, *a, *(b or (None, None)))
        one = self.spark.createDataFrame([row], DECISIONS)
        same = F.lit(True)
        for name, value in zip(one.columns, row, strict=True):
            same = same & F.col(name).eqNullSafe(F.lit(value))
        rest = self.read("decisions", DECISIONS).where(~same)
        self.write("decisions", rest if undo else rest.union(one))

    def decisions(self, kind: str) -> DataFrame:
        return self.read("decisions", DECISIONS).where(F.col("kind") == kind)

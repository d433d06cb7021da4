"""Files that are rendered from the event table, read in ranges and looked at before an import.

A file holds a day of one type of event, in the layout with columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.functions import names
from logquarry.operators import scanning, writing
from logquarry.plans.tables import EVENTS_SQL
from logquarry.session import checkpoint_ready
from logquarry.sources import files, ranges, rendered

#: Bytes of a range, so small that every file has several.
RANGE = 4096


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files, below the shared folder: ``path``, ``length`` and ``modificationTime``."""
    folder = f"{checkpoint_ready(spark).sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"
    lines = rendered.events(spark, sf_dir).select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), rendered.line("pipe").alias("text"))
    name = F.concat("event_type", F.lit("-"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".log"))
    held = lines.groupBy(name.alias("output_name")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "text"))).alias("x"))
    whole = held.select("output_name", F.encode(F.concat(F.array_join("x.text", "\n"), F.lit("\n")), "utf-8").alias("content"))
    writing.write_files(whole, folder if "://" in folder else folder.replace("file:/", "file:///")).count()
    return files.sources(spark, [folder])


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the heads and tails of the files say."""
    found = scanning.scan(_written(spark, sf_dir))
    return found.select("name", "kind", F.col("day").cast("string").alias("day"), "size", "layout", "encoding", "first_ms", "last_ms", "imported", "within")


def scan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanning.groups(scanning.scan(_written(spark, sf_dir))).select("kind", "files", "bytes", "first_ms", "last_ms")


def ranged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its number and offset, from ranges of ``RANGE`` bytes."""
    found = _written(spark, sf_dir).select("path", F.col("length").alias("size"))
    return ranges.read(ranges.with_encoding(found), RANGE).select(names.leaf(F.col("source_id")).alias("name"), "line_no", "offset", F.sha2("text", 256).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (scan, scan_groups, ranged_lines)}

_FILES = f"""{EVENTS_SQL},
l AS (SELECT *, event_type || '-' || strftime(ts, '%Y-%m-%d') || '.log' AS name, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || CASE severity WHEN 3 THEN ' | ERROR | 503' ELSE ' | INFO | 200' END
        || ' Reply: GET /' || event_type || '/' || event_id || ' from ::ffff:' || ip AS text FROM ev)"""
ORACLES = {
    "scan": f"""WITH {_FILES} SELECT name, event_type AS kind, strftime(min(ts), '%Y-%m-%d') AS day, CAST(sum(length(text) + 1) AS BIGINT) AS size, 'pipe' AS layout, 'utf-8' AS encoding,
min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, false AS imported, CAST(NULL AS VARCHAR) AS within FROM l GROUP BY name, event_type""",
    "scan_groups": f"WITH {_FILES} SELECT event_type AS kind, count(DISTINCT name) AS files, CAST(sum(length(text) + 1) AS BIGINT) AS bytes, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM l GROUP BY event_type",
    "ranged_lines": f"""WITH {_FILES}, w AS (SELECT name, text, row_number() OVER (PARTITION BY name ORDER BY ts, event_id) AS line_no, sum(length(text) + 1) OVER (PARTITION BY name ORDER BY ts, event_id) AS after FROM l)
SELECT name, line_no, CAST(after - length(text) - 1 AS BIGINT) AS "offset", sha256(text) AS text_sha256 FROM w""",
}

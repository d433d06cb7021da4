"""The driver's tables in the log domain, shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.sources import rendered

#: SQL of the same view, for the oracles. Severity: errors 3, others 1; a context is a user's hour.
EVENTS_SQL = """
ev AS (
  SELECT event_id, ts, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ts_ms, user_id, event_type, 'user' || user_id || '@example.com' AS account,
         '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS ip, 'session:' || user_id || ':' || strftime(ts, '%Y%m%d%H') AS ctx,
         CASE WHEN event_type = 'error' THEN 3 ELSE 1 END AS severity, 'q' || (user_id % 7) || '/' || (event_id // 40) AS queue
  FROM events
), oc AS (
  SELECT event_id, 'email' AS kind, account AS value, 'account' AS role FROM ev
  UNION ALL SELECT event_id, 'ipv4', ip, 'client' FROM ev
  UNION ALL SELECT event_id, 'queue', queue, '' FROM ev
)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``source_id`` (the type), ``line_start``, ``etype`` and a queue file that forty events in a row may share."""
    rows = rendered.events(spark, sf_dir)
    queue = F.concat(F.lit("q"), (F.col("user_id") % 7).cast("string"), F.lit("/"), F.floor(F.col("event_id") / 40).cast("string"))
    return rows.withColumn("queue", queue).withColumn("source_id", F.col("event_type")).withColumn("etype", F.col("event_type")).withColumn("line_start", F.col("event_id") + 1)


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account, address and queue file of each event."""
    rows = events(spark, sf_dir)
    one = lambda kind, column, role: F.struct(F.lit(kind).alias("kind"), F.col(column).alias("value"), F.lit(role).alias("role"))
    found = rows.select("event_id", F.explode(F.array(one("email", "account", "account"), one("ipv4", "ip", "client"), one("queue", "queue", ""))).alias("o"))
    return found.select("event_id", "o.kind", "o.value", "o.role", F.col("o.value").alias("display"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents: ``source_id`` (doc_id), ``line_no``, ``text``."""
    from logquarry.sources.lines import lines_of

    return lines_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", F.col("text"))


#: Lines of the documents as the line reader has them: no line after the last line end.
LINES_SQL = r"""
dl AS (
  SELECT doc_id AS source_id, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS text
  FROM (SELECT doc_id, CASE WHEN q[-1] = '' THEN q[:-2] ELSE q END AS p FROM (SELECT doc_id, string_split_regex(text, '\r\n|\n|\r') AS q FROM documents))
)"""

#: The tables' mail addresses and IPv4 addresses are plain, so simple shapes find the same ones as the operators.
MAIL_SQL = r"[A-Za-z0-9_%+.-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP_SQL = r"\b[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\b"

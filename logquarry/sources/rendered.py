"""The driver's event table as log lines of each layout.

A row becomes one line; account, address and context follow from ``user_id``,
so a parser's result can be held against the table's own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.functions.times import MONTHS


def account(user: Column) -> Column:
    return F.concat(F.lit("user"), user.cast("string"), F.lit("@example.com"))


def address(user: Column) -> Column:
    return F.concat(F.lit("10.0."), F.floor(user / 256).cast("string"), F.lit("."), (user % 256).cast("string"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with account, ip, context, severity and milliseconds."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    return rows.select(
        "event_id",
        "ts",
        F.unix_millis(ts).alias("ts_ms"),
        "user_id",
        "event_type",
        account(F.col("user_id")).alias("account"),
        address(F.col("user_id")).alias("ip"),
        F.concat_ws(":", F.lit("session"), F.col("user_id").cast("string"), F.date_format(ts, "yyyyMMddHH")).alias("ctx"),
        F.when(F.col("event_type") == "error", 3).otherwise(1).alias("severity"),
    )


def lines(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    """``source_id`` (the layout), ``line_no`` and ``text``; line ``event_id + 1`` shows event ``event_id``."""
    return events(spark, sf_dir).select(F.lit(layout).alias("source_id"), (F.col("event_id") + 1).alias("line_no"), line(layout).alias("text"))


def line(layout: str) -> Column:
    """The line that shows a row of ``events``."""
    ts = F.col("ts").cast("timestamp")
    day, month = F.date_format(ts, "dd"), F.element_at(F.array(*[F.lit(m.title()) for m in MONTHS]), F.month(ts))
    clock, stamp = F.date_format(ts, "HH:mm:ss"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    bad = F.col("severity") == 3
    path = F.concat(F.lit("/"), F.col("event_type"), F.lit("/"), F.col("event_id").cast("string"))
    status = F.when(bad, "503").otherwise("200")
    shapes = {
        "pipe": F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" | "), F.when(bad, "ERROR").otherwise("INFO"), F.lit(" | "), status, F.lit(" Reply: GET "), path, F.lit(" from ::ffff:"), F.col("ip")),
        "component": F.concat(F.date_format(ts, "yyMMdd HHmmssSSS"), F.when(bad, " E").otherwise(" I"), F.lit(" ["), F.lpad(F.upper(F.hex("user_id")), 8, "0"), F.lit("] 0x41330080 Authenticated: "), F.col("account")),
        "bracket": F.concat(F.lit("["), F.date_format(ts, "EEE "), stamp, F.lit("] "), F.when(bad, "ERROR").otherwise("INFO"), F.lit(", [REQ"), F.lpad(F.col("event_id").cast("string"), 9, "0"), F.lit("] Connection: "), F.col("ip"), F.lit(" Method:GET")),
        "access": F.concat(F.col("ip"), F.lit(" - "), F.col("account"), F.lit(" ["), day, F.lit("/"), month, F.lit("/"), F.date_format(ts, "yyyy:HH:mm:ss"), F.lit(' +0200] "GET '), path, F.lit(' HTTP/1.1" '), status, F.lit(" 512")),
        "ctime": F.concat(F.date_format(ts, "EEE "), month, F.lit(" "), F.lpad(F.dayofmonth(ts).cast("string"), 2, " "), F.lit(" "), clock, F.date_format(ts, " yyyy"), F.lit(" -> "), F.when(bad, "scan failed for ").otherwise("scanned for "), F.col("account")),
        "iso": F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00 "), F.when(bad, "ERROR ").otherwise("note "), F.col("account")),
        "german": F.concat(F.date_format(ts, "dd.MM.yyyy HH:mm:ss"), F.when(bad, " ERROR ").otherwise(" note "), F.col("account")),
        "syslog": F.concat(month, F.lit(" "), F.lpad(F.dayofmonth(ts).cast("string"), 2, " "), F.lit(" "), clock, F.lit(" mx app: "), F.when(bad, "error ").otherwise("note "), F.col("account")),
        "mdaemon": F.concat(F.date_format(ts, "EEE yyyy-MM-dd HH:mm:ss.SSS"), F.lit(": Authenticated as "), F.col("account")),
    }
    return shapes[layout]


LAYOUTS = ("mdaemon", "component", "bracket", "access", "pipe", "ctime", "iso")


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: id, name with a day, content and size in bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.col("source"), F.lit("-2024-01-"), F.format_string("%02d", (1 + F.col("doc_id") % 28).cast("int")), F.lit(".log")).alias("name"),
        F.col("text").alias("content"),
        F.octet_length("text").cast("long").alias("size"),
    )

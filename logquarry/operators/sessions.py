"""The event log: restarts, sessions, partial transcripts, processing blocks.

What a file-long loop would carry from line to line is expressed as running
values over pieces of a file: the restart a line belongs to, the open
transcript, the group between delimiters. Only the chain of transcripts, where
one continues another by repeating its last line, takes a few joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions import times
from logquarry.functions.running import carry_last, running
from logquarry.operators import rules
from logquarry.operators.formats import EVENT_LOG, is_event_log_head
from logquarry.operators.rules import DETAIL, ID, INFO
from logquarry.session import discard, settled, stored

# Fixed values.
BLOCK_LIMIT = 400
_CODE = r"^(\d\d): "
_LEVEL_ID = r"^([GIDEWT]) \[([0-9A-Fa-f]{8})\] "
_JOB = r"^\[(-?\d{3,})\] "
_REQUEST = r"^\{([0-9A-Fa-f]{6,})\} "
_SESSION = r"^Session (\d+); child \d+"
_SHUTDOWN = r"^Server Shutdown\s+(.+)$"
_BEGIN, _END = "--------- Partial transcript", "---------- End partial transcript"
WORKER_EVENTS, WORKER_MS = 400, 30 * 60_000


def rfc2822(text: Column) -> tuple[Column, Column]:
    """Wall time and zone of ``Wed, 21 Oct 2026 00:01:00 +0200``; nulls if it is none."""
    pattern = r"^\s*(?:[A-Za-z]{3},?\s+)?(\d{1,2})\s+([A-Za-z]{3})\w*\s+(\d{4})\s+(\d\d):(\d\d)(?::(\d\d))?\s+([+-]\d{4})"
    part = lambda k: F.regexp_extract(text, pattern, k)
    wall = times.wall_time(part(3), times.month_number(part(2)), part(1), part(4), part(5), F.coalesce(F.nullif(part(6), F.lit("")), F.lit("00")))
    return F.when(text.rlike(pattern), wall), F.when(text.rlike(pattern), times.offset_minutes(part(7)))


def _items(lines: DataFrame) -> DataFrame:
    """Stamped lines without their prefixes, with context and role of each line."""
    text = F.col("text")
    group = lambda k: F.regexp_extract(text, EVENT_LOG, k)
    lines = lines.withColumn("stamped", text.rlike(EVENT_LOG)).withColumn("wall", F.when(F.col("stamped"), times.stamp(group(1), group(2))))
    lines = lines.withColumn("message", F.when(F.col("stamped"), F.regexp_replace(group(3), _CODE, "")))
    lines = lines.withColumn("level", rules.level_severity(F.nullif(F.regexp_extract("message", _LEVEL_ID, 1), F.lit("")))).withColumn("worker", F.nullif(F.regexp_extract("message", _LEVEL_ID, 2), F.lit("")))
    lines = lines.withColumn("message", F.regexp_replace("message", _LEVEL_ID, ""))
    lines = lines.withColumn("job", F.nullif(F.regexp_extract("message", _JOB, 1), F.lit(""))).withColumn("request", F.nullif(F.regexp_extract("message", _REQUEST, 1), F.lit("")))
    lines = lines.withColumn("message", F.when(F.col("job").isNotNull(), F.regexp_replace("message", _JOB, "")).otherwise(F.regexp_replace("message", _REQUEST, "")))
    m = F.col("message")
    return lines.withColumn(
        "role",
        F.when(~F.col("stamped") & text.startswith("START Event Log"), "start")
        .when(~F.col("stamped") & text.rlike(_SHUTDOWN), "shutdown")
        .when(~F.col("stamped") & is_event_log_head(text), "header")
        .when(~F.col("stamped"), "bare")
        .when(m.startswith(_BEGIN), "begin")
        .when(m.startswith(_END), "end")
        .when(m.contains("Beginn der Protokolldatei"), "opening")
        .when(F.trim(m) == "----------", "delimiter")
        .otherwise("item"),
    )


def _groups(lines: DataFrame) -> DataFrame:
    """Each line with its restart (``segment``), transcript and group of lines that are closed together."""
    restart = F.col("role").isin("start", "opening")
    mark = F.when(F.col("role") == "begin", F.col("line_no")).when(F.col("role") == "end", F.lit(-1))
    lines = running(lines, "source_id", "line_no", sums={"segment": restart}, lasts={"chunk": mark, "clock": F.col("wall")})
    lines = lines.withColumn("chunk", F.when((F.col("chunk") > 0) & (F.col("role") != "begin"), F.col("chunk")))
    # What opens a group; a delimiter closes one behind itself, so the line after it opens the next.
    opens = F.col("role").isin("start", "begin", "end") | ((F.col("role") == "opening") & F.col("chunk").isNull())
    closes = (F.col("role") == "delimiter") & F.col("chunk").isNull()
    lines = running(lines, "source_id", "line_no", sums={"_opened": opens, "_closed": closes})
    return lines.withColumn("group", F.col("_opened") * 2 + (F.col("_closed") - closes.cast("int")) * 2 + F.col("chunk").isNotNull().cast("int")).drop("_opened", "_closed")


def _attached(lines: DataFrame) -> DataFrame:
    """Items with the bare lines that follow them; bare lines with no item before them stand alone."""
    body = lines.where(F.col("role").isin("item", "delimiter", "opening", "bare"))
    if body.where("role = 'bare'").isEmpty():
        return body.withColumn("line_end", F.col("line_no"))
    body = body.withColumn("_key", F.concat_ws(":", "source_id", "group"))
    body = carry_last(body, "_key", "line_no", F.when(F.col("stamped"), F.col("line_no")), "owner").withColumn("owner", F.coalesce("owner", "line_no"))
    # Only bare lines have an owner, so only they are grouped.
    more = body.where("owner <> line_no").groupBy("source_id", "owner").agg(F.max("line_no").alias("line_end"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("_lines"))
    more = more.select("source_id", F.col("owner").alias("line_no"), "line_end", F.array_join(F.col("_lines.text"), "\n").alias("_more"))
    joined = body.where(F.col("owner") == F.col("line_no")).drop("_key", "owner").join(more, ["source_id", "line_no"], "left")
    return joined.withColumn("text", F.concat_ws("\n", "text", "_more")).withColumn("line_end", F.coalesce("line_end", "line_no")).drop("_more")


def _cut(items: DataFrame) -> DataFrame:
    """Groups cut where a buffer of ``BLOCK_LIMIT`` lines would have been emptied but for its last line."""
    step = BLOCK_LIMIT - 1
    whole = Window.partitionBy("source_id", "group")
    items = items.withColumn("_at", F.row_number().over(whole.orderBy("line_no")) - 1).withColumn("_plain", F.sum((F.col("role") != "delimiter").cast("int")).over(whole))
    piece = F.when(F.col("chunk").isNotNull(), 0).otherwise(F.floor(F.least(F.col("_at"), F.greatest(F.col("_plain") - 1, F.lit(0))) / step))
    return items.withColumn("piece", piece.cast("int")).drop("_at", "_plain")


def _owners(items: DataFrame) -> DataFrame:
    """One row for each piece of a group: first and last line, size, session stated in it, whether a delimiter ended it."""
    session = F.nullif(F.regexp_extract("message", _SESSION, 1), F.lit(""))
    return items.groupBy("source_id", "group", "piece").agg(
        F.min("line_no").alias("first_line"),
        F.min_by("text", "line_no").alias("first_text"),
        F.max_by("text", "line_no").alias("last_text"),
        F.count("*").alias("size"),
        F.min_by(session, F.when(session.isNotNull(), F.col("line_no"))).alias("stated"),
        F.max((F.col("role") == "delimiter").cast("int")).alias("delimited"),
        F.first("chunk").alias("chunk"),
        F.min("segment").alias("segment"),
    )


def _sessions(owners: DataFrame) -> DataFrame:
    """``session`` and ``continued`` of each piece.

    A piece whose first line repeats the last line of an earlier transcript goes
    on with its session. Chains of such transcripts are followed by doubling.
    """
    if owners.where("chunk is not null").isEmpty():
        return owners.withColumn("session", F.col("stated")).withColumn("continued", F.lit(False))
    tails = owners.where("chunk is not null").select("source_id", F.col("last_text").alias("first_text"), F.col("first_line").alias("tail_line"))
    earlier = owners.join(tails, ["source_id", "first_text"], "left").where("tail_line is null or tail_line < first_line")
    keys = ["source_id", "group", "piece"]
    linked = earlier.groupBy(keys).agg(F.max("tail_line").alias("before"))
    linked = settled(owners.join(linked, keys, "left").select("source_id", "first_line", "stated", "before"))
    # Each transcript goes on from an earlier line, so chains end, in as many rounds as the longest one has doublings.
    while not linked.where("stated is null and before is not null").isEmpty():
        back = linked.select("source_id", F.col("first_line").alias("before"), F.col("stated").alias("_stated"), F.col("before").alias("_before"))
        joined = linked.join(back, ["source_id", "before"], "left")
        linked = settled(joined.select("source_id", "first_line", F.coalesce("stated", "_stated").alias("stated"), F.when(F.col("stated").isNull() & F.col("_stated").isNull(), F.col("_before")).alias("before")))
    found = linked.select("source_id", "first_line", F.col("stated").alias("session"))
    return owners.join(found, ["source_id", "first_line"]).withColumn("continued", F.col("session").isNotNull() & F.col("stated").isNull())


def parse(lines: DataFrame) -> DataFrame:
    """Events of event-log lines (``source_id``, ``line_no``, ``text``), with sessions, requests and blocks as contexts.

    Each step's table goes when the next one is stored.
    """
    spark, raw, made = lines.sparkSession, [], []
    lines = stored(_groups(stored(_items(lines.where(F.trim("text") != "")), raw)), made)
    discard(spark, raw)
    others = stored(lines.where(F.col("role").isin("start", "shutdown", "begin", "end")))
    items = stored(_cut(_attached(lines)), raw)
    discard(spark, made)
    owners = _sessions(stored(_owners(items), raw))
    items = rules.classify(items.join(owners.select("source_id", "group", "piece", "first_line", "session", "continued", "size", "delimited"), ["source_id", "group", "piece"]), "message", rules.EVENT_LOG_RULES)
    items = stored(items.where(~(F.col("continued") & (F.col("line_no") == F.col("first_line")))))
    discard(spark, raw)
    is_block = F.col("session").isNull() & F.col("chunk").isNull() & (F.col("delimited") == 1) & (F.col("size") >= 2)
    return _line_events(items.where(~is_block & F.col("stamped"))).unionByName(_blocks(items.where(is_block & F.col("stamped")))).unionByName(_others(others)).unionByName(_bare(items.where(~F.col("stamped"))))


OUT = ["source_id", "line_start", "line_end", "text", "message", "wall", "offset", "ts_flag", "etype", "severity", "context", "context_kind", "context_label", "ids", "segment"]


def _line_events(items: DataFrame) -> DataFrame:
    """A session's lines share its context; other lines keep that of their prefix."""
    segment = F.col("segment").cast("string")
    own = (
        F.when(F.col("job").isNotNull(), F.concat_ws(":", F.lit("job"), segment, "job"))
        .when(F.col("request").isNotNull(), F.concat_ws(":", F.lit("req"), segment, "request"))
        .when(F.col("worker").isNotNull(), F.concat_ws(":", F.lit("req"), segment, "worker"))
    )
    named = F.coalesce("job", "request", "worker")
    context = F.when(F.col("session").isNotNull(), F.concat_ws(":", F.lit("session"), segment, "session")).when(F.col("chunk").isNotNull(), F.concat_ws(":", F.lit("chunk"), segment, F.col("first_line").cast("string"))).otherwise(own)
    kind = F.when(F.col("session").isNotNull(), "session").when(named.isNotNull(), "request")
    label = F.when(F.col("session").isNotNull(), F.concat(F.lit("Session "), "session")).when(named.isNotNull(), F.concat(F.lit("Request "), named))
    return items.select(
        "source_id", F.col("line_no").alias("line_start"), "line_end", "text", "message", "wall", F.lit(None).cast("int").alias("offset"),
        F.when(F.col("wall").isNotNull(), "local").otherwise("invalid").alias("ts_flag"), "etype", F.greatest("severity", "level").cast("int").alias("severity"),
        context.alias("context"), kind.alias("context_kind"), label.alias("context_label"), "ids", F.col("segment").cast("int").alias("segment"),
    )


def _blocks(items: DataFrame) -> DataFrame:
    """One event for a block: its first telling type unless a later one is worse, the worst severity, all identifiers."""
    telling = ~F.col("etype").isin("line", "proto")
    grouped = items.groupBy("source_id", "group", "piece").agg(
        F.min("line_no").alias("line_start"),
        F.max("line_end").alias("line_end"),
        F.array_sort(F.collect_list(F.struct("line_no", "text", "ids"))).alias("_rows"),
        F.min_by("wall", "line_no").alias("wall"),
        F.min_by("message", "line_no").alias("message"),
        F.min_by("etype", F.when(telling, F.col("line_no"))).alias("_first"),
        F.max_by("etype", F.when(telling & (F.col("severity") > INFO), F.col("line_no"))).alias("_worst"),
        F.max("severity").alias("severity"),
        F.min("segment").cast("int").alias("segment"),
    )
    return grouped.select(
        "source_id", "line_start", "line_end", F.array_join(F.col("_rows.text"), "\n").alias("text"), "message", "wall", F.lit(None).cast("int").alias("offset"),
        F.when(F.col("wall").isNotNull(), "local").otherwise("none").alias("ts_flag"), F.coalesce("_worst", "_first", F.lit("line")).alias("etype"),
        F.greatest("severity", F.lit(INFO)).alias("severity"), F.concat_ws(":", F.lit("block"), F.col("segment").cast("string"), F.col("line_start").cast("string")).alias("context"),
        F.lit(None).cast("string").alias("context_kind"), F.lit(None).cast("string").alias("context_label"), F.flatten(F.col("_rows.ids")).alias("ids"), "segment",
    )


def _others(lines: DataFrame) -> DataFrame:
    """Restart headers, shutdowns and transcript marks."""
    wall, offset = rfc2822(F.regexp_extract("text", _SHUTDOWN, 1))
    role = F.col("role")
    lines = lines.withColumn("_wall", F.when(role == "shutdown", wall).when(role != "start", F.col("wall"))).withColumn("_offset", F.when(role == "shutdown", offset))
    flag = F.when(role == "start", "none").when(role == "shutdown", F.when(F.col("_wall").isNotNull(), "exact").otherwise("none")).otherwise("local")
    none = F.lit(None).cast("string")
    return lines.select(
        "source_id", F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), "text", F.coalesce("message", "text").alias("message"), F.col("_wall").alias("wall"), F.col("_offset").alias("offset"), flag.alias("ts_flag"),
        F.when(role == "start", "log.header").when(role == "shutdown", "service.stop").otherwise("log.marker").alias("etype"), F.when(role == "shutdown", INFO).otherwise(DETAIL).cast("int").alias("severity"),
        none.alias("context"), none.alias("context_kind"), none.alias("context_label"), F.array().cast(f"array<{ID}>").alias("ids"), F.col("segment").cast("int").alias("segment"),
    )


def _bare(items: DataFrame) -> DataFrame:
    """Lines without a stamp that no open group takes, with the time of the stamped line before them."""
    none = F.lit(None).cast("string")
    return items.select(
        "source_id", F.col("line_no").alias("line_start"), "line_end", "text", F.col("text").alias("message"), F.col("clock").alias("wall"), F.lit(None).cast("int").alias("offset"),
        F.when(F.col("clock").isNotNull(), "inherited").otherwise("none").alias("ts_flag"), F.lit("line").alias("etype"), F.lit(INFO).alias("severity"), none.alias("context"), none.alias("context_kind"), none.alias("context_label"),
        F.array().cast(f"array<{ID}>").alias("ids"), F.col("segment").cast("int").alias("segment"),
    )


def limit_workers(events: DataFrame) -> DataFrame:
    """``events`` (``ctx``, ``ts_ms``) without contexts that are workers rather than requests: too many events or too long.

    Sessions are always kept. The dissolved context stays in ``worker`` for those who drop its entity.
    """
    groups = events.where("ctx is not null and not ctx like '%session:%'").groupBy("ctx").agg(F.count("*").alias("_n"), (F.max("ts_ms") - F.min("ts_ms")).alias("_span"))
    workers = groups.where((F.col("_n") > WORKER_EVENTS) | (F.col("_span") > WORKER_MS)).select("ctx", F.lit(True).alias("_worker"))
    joined = events.join(workers, "ctx", "left")
    return joined.withColumn("worker", F.when(F.col("_worker"), F.col("ctx"))).withColumn("ctx", F.when(F.col("_worker").isNull(), F.col("ctx"))).drop("_worker")

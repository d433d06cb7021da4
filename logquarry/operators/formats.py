"""Line layouts: what each recognizes, and how its lines become events.

A layout is a pattern and a function from the line's column to the columns of
an event. ``register`` adds one. All of it is native expressions; lines without
a stamp are put to their events with windows that run over pieces of a file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions import times
from logquarry.functions.running import carry_last, running
from logquarry.operators import rules
from logquarry.session import settled, spread
from logquarry.operators.rules import DETAIL, ERROR, ID, INFO, WARNING, identifier, level_severity, status_severity

WEEKDAY = r"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
#: A day and a clock with any fraction, each read as one text by ``times.stamp``.
DAY, CLOCK = r"(\d{4}-\d\d-\d\d)", r"(\d\d(?::\d\d){2}(?:[.,]\d+)?)"
_NAMED_DAY = rf"(?:{WEEKDAY} )?{DAY}"
# How lines that open and close an event log begin, and words of a level.
EVENT_LOG_HEADS = ("START Event Log", "-" * 20, "Event Time/Date", "Server Shutdown")
LEVEL_NAMES = "trace debug info notice warning warn error fatal critical".split()

EVENT_LOG = rf"^\uFEFF?{_NAMED_DAY} {CLOCK}: ?(.*)$"
COMPONENT = r"^(\d{6}) (\d{9}) ([A-Z]) \[([0-9A-Fa-f]{4,8})\] (0x[0-9A-Fa-f]{8} )?(.*)$"
BRACKET = rf"^\[{_NAMED_DAY}[ T]{CLOCK}\] ?(.*)$"
BRACKET_LEVEL = rf"(?i)^({'|'.join(LEVEL_NAMES)}),? "
BRACKET_REQUEST = r"^\[([A-Z0-9]{8,})\] "
BRACKET_CLIENT = r"^Connection: ([0-9A-Fa-f.:]+) Method:\w"
ACCESS = r'^(\S+) \S+ (\S+) \[?(\d\d/\w{3}/\d{4}(?::\d\d){3}) ([+-]\d{4})\]? "[^"]*" (\d{3}|-) \S'
PIPE = rf"^{DAY}[ T]{CLOCK} \| (\w+) \| (.*)$"
PIPE_REQUEST = r"^(\d{3}) [^:]*: [A-Z]+ \S+ from (\S+)"
CTIME = rf"^{WEEKDAY} ({MONTH}) ([ \d]\d) {CLOCK} (\d{{4}}) -> (.*)$"
CTIME_WARNING = r"(?i)\b(?:warning|error|failed)\b"
ISO = rf"^\[?{DAY}[T ]{CLOCK} ?(Z|[+-]\d\d:?\d\d)?\]?"
SLASHED = rf"^\[?(\d{{4}}/\d\d/\d\d)[T ]{CLOCK}\]?"
GERMAN = rf"^\[?(\d\d\.\d\d\.\d{{4}})[ ,]+{CLOCK}\]?"
SYSLOG = rf"^({MONTH}) +(\d{{1,2}}) {CLOCK}"
GENERIC_LEVEL = rf"(?i)\b({'|'.join(n for n in LEVEL_NAMES if n[0] in 'wefc')})\b"
SAMPLE_LINES, SCORED_LINES, MIN_SCORE = 300, 200, 0.34

#: Columns that a layout gives to a line it recognizes.
FIELDS = ["wall", "offset", "ts_flag", "etype", "severity", "context", "context_kind", "context_label", "ids"]


@dataclass(frozen=True)
class Layout:
    name: str
    label: str
    #: Whether a line is of this layout.
    recognizes: Callable[[Column], Column]
    #: Adds ``FIELDS`` to lines (``source_id``, ``line_no``, ``text``, ``file_date``) that ``recognizes`` holds for.
    parse: Callable[[DataFrame], DataFrame]


def _groups(text: Column, pattern: str, *numbers: int) -> list[Column]:
    return [F.regexp_extract(text, pattern, k) for k in numbers]


def _fields(df: DataFrame, wall: Column, flag: Column | str = "local", offset: Column | None = None, context: Column | None = None, label: str = "Request ", ids: Column | None = None, etype: Column | None = None, severity: Column | None = None) -> DataFrame:
    """``df`` with ``FIELDS``; a stamp that isn't a time is flagged invalid."""
    none = F.lit(None).cast("string")
    df = df.withColumn("wall", wall)
    flag = flag if isinstance(flag, Column) else F.lit(flag)
    named = context if context is not None else none
    return (
        df.withColumn("offset", (offset if offset is not None else F.lit(None)).cast("int"))
        .withColumn("ts_flag", F.when(F.col("wall").isNull(), "invalid").otherwise(flag))
        .withColumn("etype", etype if etype is not None else F.col("etype"))
        .withColumn("severity", (severity if severity is not None else F.col("severity")).cast("int"))
        .withColumn("ids", ids if ids is not None else F.col("ids"))
        .withColumn("context", F.when(named.isNotNull(), F.concat(F.lit("req:0:"), named)))
        .withColumn("context_kind", F.when(named.isNotNull(), "request"))
        .withColumn("context_label", F.when(named.isNotNull(), F.concat(F.lit(label), named)))
    )


def _no_ids() -> Column:
    return F.array().cast(f"array<{ID}>")


def _one_id(kind: str, value: Column, role: str = "") -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(role).alias("role"), value.alias("display"))


def _component(df: DataFrame) -> DataFrame:
    day, clock, level, worker, code, message = _groups(F.col("text"), COMPONENT, *range(1, 7))
    df = rules.classify(df.withColumn("message", message), "message", rules.COMPONENT_RULES)
    wall = times.stamp(F.concat(F.lit("20"), day), F.concat_ws(":", *[F.substring(clock, k, 2) for k in (1, 3)], F.concat_ws(".", F.substring(clock, 5, 2), F.substring(clock, 7, 3))))
    of_level = F.coalesce(level_severity(level), F.lit(INFO))
    severity = F.when(F.col("etype") == "line", of_level).when(of_level >= WARNING, F.greatest(F.col("severity"), of_level)).otherwise(F.col("severity"))
    far = F.abs(F.datediff(F.col("wall").cast("date"), F.col("file_date"))) > 1
    ids = F.concat("ids", F.when(code != "", F.array(_one_id("code", F.lower(F.trim(code)), "message"))).otherwise(_no_ids()))
    return _fields(df, wall, F.when(F.coalesce(far, F.lit(False)), "ambiguous").otherwise("local"), context=worker, label="Worker ", ids=ids, severity=severity)


def _bracket(df: DataFrame) -> DataFrame:
    day, clock, rest = _groups(F.col("text"), BRACKET, 1, 2, 3)
    df = df.withColumn("_rest", rest)
    level = F.nullif(F.regexp_extract("_rest", BRACKET_LEVEL, 1), F.lit(""))
    df = df.withColumn("_level", F.coalesce(level_severity(level), F.lit(INFO))).withColumn("_rest", F.regexp_replace("_rest", BRACKET_LEVEL, ""))
    df = df.withColumn("_request", F.nullif(F.regexp_extract("_rest", BRACKET_REQUEST, 1), F.lit(""))).withColumn("message", F.regexp_replace("_rest", BRACKET_REQUEST, ""))
    # Request rules come first, so one pass over both tables decides.
    df = rules.classify(df, "message", (*rules.REQUEST_RULES, *rules.EVENT_LOG_RULES))
    out = _fields(df.withColumn("severity", F.greatest("severity", "_level")), times.stamp(day, clock), context=F.col("_request"))
    return out.drop("_rest", "_level", "_request")


def _access(df: DataFrame) -> DataFrame:
    client, user, stamp, zone, status = _groups(F.col("text"), ACCESS, *range(1, 6))
    day, mon, rest = F.substring(stamp, 1, 2), F.substring(stamp, 4, 3), F.substring(stamp, F.lit(8), F.length(stamp))
    month = F.nullif(times.month_number(mon), F.lit(0))
    known = F.when(status != "-", _one_id("status", F.concat(F.lit("HTTP "), status)))
    ids = F.array_compact(F.array(identifier("ip", client, "client"), identifier("account", user), known)).cast(f"array<{ID}>")
    severity = F.coalesce(status_severity(F.nullif(status, F.lit("-"))), F.lit(INFO))
    wall = times.stamp(F.concat(F.substring(rest, 1, 4), F.lpad(month.cast("string"), 2, "0"), day), F.substring(rest, 6, 8))
    return _fields(df.withColumn("message", F.col("text")), wall, "exact", times.offset_minutes(zone), ids=ids, etype=F.lit("http.request"), severity=severity)


def _pipe(df: DataFrame) -> DataFrame:
    day, clock, level, message = _groups(F.col("text"), PIPE, *range(1, 5))
    df = df.withColumn("message", message)
    status, client = _groups(F.col("message"), PIPE_REQUEST, 1, 2)
    request = F.col("message").rlike(PIPE_REQUEST)
    ids = F.when(request, F.array_compact(F.array(identifier("ip", client, "client"), _one_id("status", F.concat(F.lit("HTTP "), status)))).cast(f"array<{ID}>")).otherwise(_no_ids())
    return _fields(df, times.stamp(day, clock), ids=ids, etype=F.when(request, "http.request").otherwise("line"), severity=F.coalesce(level_severity(level), F.lit(INFO)))


def _dated(year: Column, mon: Column, day: Column, clock: Column) -> Column:
    """The time of a stamp that names its month."""
    return times.stamp(F.concat(year, F.lpad(times.month_number(mon).cast("string"), 2, "0"), F.lpad(F.trim(day), 2, "0")), clock)


def _ctime(df: DataFrame) -> DataFrame:
    mon, day, clock, year, message = _groups(F.col("text"), CTIME, *range(1, 6))
    df = df.withColumn("message", message)
    return _fields(df, _dated(year, mon, day, clock), ids=_no_ids(), etype=F.lit("line"), severity=F.when(F.col("message").rlike(CTIME_WARNING), WARNING).otherwise(INFO))


def _generic(df: DataFrame) -> DataFrame:
    text = F.col("text")
    shapes = (ISO, SLASHED, GERMAN, SYSLOG)
    df = df.withColumn("_shape", F.coalesce(*[F.when(text.rlike(p), k) for k, p in enumerate(shapes)]))
    shape = F.col("_shape")
    german, german_clock = _groups(text, GERMAN, 1, 2)
    mon, day, clock = _groups(text, SYSLOG, 1, 2, 3)
    year = F.coalesce(F.year("file_date"), F.year(F.current_date())).cast("string")
    wall = (
        F.when(shape == 0, times.stamp(*_groups(text, ISO, 1, 2)))
        .when(shape == 1, times.stamp(*_groups(text, SLASHED, 1, 2)))
        .when(shape == 2, times.stamp(F.array_join(F.reverse(F.split(german, r"\.")), ""), german_clock))
        .otherwise(_dated(year, mon, day, clock))
    )
    offset = F.when(shape == 0, times.offset_minutes(F.regexp_extract(text, ISO, 3)))
    flag = F.when(offset.isNotNull(), "exact").when((shape == 3) & F.col("file_date").isNull(), "ambiguous").otherwise("local")
    head = F.coalesce(*[F.when(shape == k, F.regexp_extract(text, p, 0)) for k, p in enumerate(shapes)])
    after = F.substring(text, F.length(head) + 1, F.lit(60))
    level = F.nullif(F.regexp_extract(after, GENERIC_LEVEL, 1), F.lit(""))
    df = df.withColumn("message", F.substring(text, F.length(head) + 1, F.length(text)))
    return _fields(df, wall, flag, offset, ids=_no_ids(), etype=F.lit("line"), severity=F.coalesce(level_severity(level), F.lit(INFO))).drop("_shape")


def _event_log_lines(df: DataFrame) -> DataFrame:
    """The event log's stamped lines by themselves; ``sessions.parse`` also follows its sessions and blocks."""
    day, clock, message = _groups(F.col("text"), EVENT_LOG, 1, 2, 3)
    df = rules.classify(df.withColumn("message", message), "message", rules.EVENT_LOG_RULES)
    return _fields(df, times.stamp(day, clock))


def is_event_log_head(text: Column) -> Column:
    out = F.lit(False)
    for head in EVENT_LOG_HEADS:
        out = out | text.startswith(head)
    return out


def _like(pattern: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(pattern)


#: In the order in which ties of detection are settled.
LAYOUTS: dict[str, Layout] = {}


def register(layout: Layout) -> None:
    """Add a layout; detection tries it after the others."""
    LAYOUTS[layout.name] = layout


for _layout in (
    Layout("mdaemon", "event log", lambda t: t.rlike(EVENT_LOG) | is_event_log_head(t), _event_log_lines),
    Layout("component", "component log", _like(COMPONENT), _component),
    Layout("bracket", "log with [stamp]", _like(BRACKET), _bracket),
    Layout("access", "HTTP access log", _like(ACCESS), _access),
    Layout("pipe", "log with columns", _like(PIPE), _pipe),
    Layout("ctime", "log with ctime stamp", _like(CTIME), _ctime),
):
    register(_layout)
GENERIC = Layout("generic", "text log", lambda t: t.rlike(ISO) | t.rlike(SLASHED) | t.rlike(GERMAN) | t.rlike(SYSLOG), _generic)


def detect(lines: DataFrame) -> DataFrame:
    """``source_id``, ``layout`` and ``score`` for each source.

    The layout that recognizes the largest share of the first non-blank lines
    wins, the earlier one on a tie; below ``MIN_SCORE`` it is ``generic``.
    """
    from pyspark.sql import Window

    head = lines.where((F.col("line_no") <= SAMPLE_LINES) & (F.trim("text") != ""))
    head = head.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy("line_no"))).where(F.col("_n") <= SCORED_LINES)
    shares = [F.avg(layout.recognizes(F.col("text")).cast("double")).alias(name) for name, layout in LAYOUTS.items()]
    scored = head.groupBy("source_id").agg(*shares)
    best = F.greatest(*[F.col(f"`{name}`") for name in LAYOUTS])
    choice = F.coalesce(*[F.when((F.col(f"`{name}`") == best) & (best >= MIN_SCORE), name) for name in LAYOUTS], F.lit("generic"))
    found = scored.select("source_id", choice.alias("layout"), best.alias("score"))
    return lines.select("source_id").distinct().join(found, "source_id", "left").select("source_id", F.coalesce("layout", F.lit("generic")).alias("layout"), F.coalesce("score", F.lit(0.0)).alias("score"))


#: Where a request's message names its client: the pattern and its group.
CLIENTS = {"pipe": (PIPE_REQUEST, 2), "bracket": (BRACKET_CLIENT, 1), "access": (ACCESS, 1)}


def client(message: Column, layout: str) -> Column:
    """The client of a request as its line writes it, without the prefix of a mapped address; null where none is named.

    It need not be an address: one with a number above 255 is no identifier, so ``ids`` lacks it.
    """
    return F.nullif(F.regexp_replace(F.regexp_extract(message, *CLIENTS[layout]), "(?i)^::ffff:", ""), F.lit(""))


#: Rows and characters up to which lines without a stamp are brought to the stamped ones instead of the other way round.
SMALL_ROWS, SMALL_CHARS = 100_000, 32 << 20
OUT = ["source_id", "line_start", "line_end", "text", "message", *FIELDS, "segment"]


def parse(lines: DataFrame, layout: str, file_dates: DataFrame | None = None) -> DataFrame:
    """Events of lines (``source_id``, ``line_no``, ``text``) of one layout.

    Blank lines vanish. A line without a stamp continues the event before it if
    it is indented, and is otherwise an event of its own with the time of the
    stamped line before it (``inherited``), or without a time (``none``).

    Lines with a stamp are parsed where they are. Those without one form runs, and the line in front of a run is
    known by its number, so only they are grouped. Sources whose numbers have gaps are put in order as a whole.
    """
    chosen = LAYOUTS.get(layout, GENERIC)
    lines = spread(lines, "source_id", "line_no")
    lines = lines.join(file_dates, "source_id", "left") if file_dates is not None else lines.withColumn("file_date", F.lit(None).cast("date"))
    spans = settled(lines.groupBy("source_id").agg(F.min("line_no").alias("lo"), F.max("line_no").alias("hi"), F.count("*").alias("n")))
    gapped = spans.where("hi - lo + 1 <> n").select("source_id")
    if gapped.isEmpty():
        return _runs(lines, chosen, spans)
    return _runs(lines.join(gapped, "source_id", "left_anti"), chosen, spans).unionByName(_ordered(lines.join(gapped, "source_id", "left_semi"), chosen))


def _small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it was counted to be small; a larger one is joined by shuffles."""
    chars = F.sum(F.length("text")) if "text" in df.columns else F.lit(0)
    rows, size = df.agg(F.count("*"), F.coalesce(chars, F.lit(0))).first()
    return F.broadcast(df) if rows <= SMALL_ROWS and size <= SMALL_CHARS else df


def _bare(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Lines without a stamp as events, with the columns of ``heads``; their times come later."""
    for name in FIELDS:
        rows = rows.withColumn(name, F.lit(None).cast(heads.schema[name].dataType))
    return rows.withColumn("etype", F.lit("line")).withColumn("severity", F.lit(INFO)).withColumn("ids", _no_ids()).withColumn("message", F.col("text"))


def _runs(lines: DataFrame, chosen: Layout, spans: DataFrame) -> DataFrame:
    """Events of sources whose line numbers have no gaps."""
    stamped, blank = F.coalesce(chosen.recognizes(F.col("text")), F.lit(False)), F.trim("text") == ""
    heads = chosen.parse(lines.where(stamped & ~blank))
    others = settled(lines.where(~stamped | blank).select("source_id", "line_no", "text", blank.alias("blank"), F.col("text").rlike(r"^\s").alias("indented")))
    shown = lambda df: df.withColumn("line_start", F.col("line_no")).withColumn("segment", F.lit(0)).select(*OUT)
    if others.where("not blank").isEmpty():
        return shown(heads.withColumn("line_end", F.col("line_no")))
    before = others.select("source_id", (F.col("line_no") + 1).alias("line_no"), F.lit(True).alias("follows"))
    marked = settled(others.join(before, ["source_id", "line_no"], "left"))
    opened = running(marked, "source_id", "line_no", lasts={"run": F.when(F.col("follows").isNull(), F.col("line_no")), "opener": F.when(~F.col("blank") & ~F.col("indented"), F.col("line_no"))})
    first = others.where("not blank").groupBy("source_id").agg(F.min("line_no").alias("first"))
    opened = opened.where("not blank").join(spans.select("source_id", "lo"), "source_id").join(first, "source_id")
    # An indented line with nothing before it opens an event, and what follows may continue it.
    head = F.when(F.col("opener") >= F.col("run"), F.col("opener")).when(F.col("run") > F.col("lo"), F.col("run") - 1).otherwise(F.col("first"))
    opened = settled(opened.select("source_id", "line_no", "text", (F.col("run") - 1).alias("head"), head.alias("event_line")))
    alone = opened.where("line_no = event_line")
    asked = _small(settled(alone.select("source_id", F.col("head").alias("line_no")).distinct()))
    clocks = heads.select("source_id", "line_no", "wall", "offset").join(asked, ["source_id", "line_no"]).select("source_id", F.col("line_no").alias("head"), F.struct("wall", "offset").alias("clock"))
    flag = F.when(F.col("clock.wall").isNotNull(), "inherited").otherwise("none")
    timed = _bare(alone.join(clocks, ["source_id", "head"], "left"), heads).withColumn("wall", F.col("clock.wall")).withColumn("offset", F.col("clock.offset")).withColumn("ts_flag", flag)
    every = heads.select("source_id", "line_no", "text", "message", *FIELDS).unionByName(timed.select("source_id", "line_no", "text", "message", *FIELDS))
    rest = opened.where("line_no <> event_line").groupBy("source_id", "event_line").agg(F.max("line_no").alias("line_end"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("x"))
    rest = settled(rest.select("source_id", F.col("event_line").alias("line_no"), "line_end", F.array_join("x.text", "\n").alias("text")))
    joined = every.join(_small(rest).withColumnRenamed("text", "_more"), ["source_id", "line_no"], "left")
    text = F.when(F.col("_more").isNull(), F.col("text")).otherwise(F.concat_ws("\n", "text", "_more"))
    return shown(joined.withColumn("text", text).withColumn("line_end", F.coalesce("line_end", "line_no")))


def _ordered(lines: DataFrame, chosen: Layout) -> DataFrame:
    """Events of lines with any numbers, by windows over all of them."""
    lines = lines.where(F.trim("text") != "")
    stamped = F.coalesce(chosen.recognizes(F.col("text")), F.lit(False))
    lines = lines.withColumn("stamped", stamped).withColumn("indented", F.col("text").rlike(r"^\s"))
    opened = carry_last(lines, "source_id", "line_no", F.when(F.col("stamped") | ~F.col("indented"), F.col("line_no")), "event_line")
    first = lines.groupBy("source_id").agg(F.min("line_no").alias("first_line"))
    # An indented line with nothing before it opens an event, and what follows may continue it.
    opened = settled(opened.join(first, "source_id").withColumn("event_line", F.coalesce("event_line", "first_line")).drop("first_line"))
    heads = chosen.parse(opened.where((F.col("line_no") == F.col("event_line")) & F.col("stamped")))
    bare = _bare(opened.where((F.col("line_no") == F.col("event_line")) & ~F.col("stamped")), heads)
    heads = settled(heads.unionByName(bare.select(heads.columns)))
    timed = carry_last(heads, "source_id", "line_no", F.when(F.col("stamped"), F.struct("wall", "offset")), "clock", before=True)
    bare_flag = F.when(F.col("clock.wall").isNotNull(), "inherited").otherwise("none")
    timed = timed.select(
        "source_id", "line_no", "message", "etype", "severity", "context", "context_kind", "context_label", "ids",
        F.when(F.col("stamped"), F.col("wall")).otherwise(F.col("clock.wall")).alias("wall"),
        F.when(F.col("stamped"), F.col("offset")).otherwise(F.col("clock.offset")).alias("offset"),
        F.when(F.col("stamped"), F.col("ts_flag")).otherwise(bare_flag).alias("ts_flag"),
    )
    texts = opened.groupBy("source_id", "event_line").agg(F.max("line_no").alias("line_end"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("_lines"))
    texts = texts.select("source_id", F.col("event_line").alias("line_no"), "line_end", F.array_join(F.col("_lines.text"), "\n").alias("text"))
    joined = timed.join(texts, ["source_id", "line_no"])
    return joined.withColumnRenamed("line_no", "line_start").withColumn("segment", F.lit(0)).select(*OUT)

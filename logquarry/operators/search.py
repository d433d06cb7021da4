"""Finding events and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions import identifiers as ids
from logquarry.functions.labels import WEAK_KINDS

# Fixed values.
COUNT_CAP = 100_000
PAGE_MAX, IDS_MAX = 1000, 5000
SUMMARY_CHARS, CHIPS = 400, 12
SUGGESTIONS, SUGGEST_CHARS = 12, 2


def folded(text: Column) -> Column:
    """Case and diacritics folded, as the full-text search compares."""
    return F.lower(F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"))


def tokens(text: Column) -> Column:
    """Distinct words of letters and digits, folded."""
    return F.array_distinct(F.array_remove(F.split(folded(text), r"[^\p{L}\p{N}]+"), ""))


def _any_starts(words: Column, want: Column) -> Column:
    return F.exists(words, lambda word: word.startswith(want))


def text_matches(text: Column, query: str) -> Column:
    """Every word must occur; a trailing ``*`` asks for a prefix; a word with punctuation must also occur as written."""
    found, condition = tokens(text), F.lit(True)
    for word in query.split():
        prefix = word.endswith("*")
        plain = word.rstrip("*")
        parts = [p for p in re.split(r"[^\w]+|_", plain.lower()) if p]
        for k, part in enumerate(parts):
            want = folded(F.lit(part))
            last = prefix and k == len(parts) - 1
            condition = condition & (_any_starts(found, want) if last else F.array_contains(found, want))
        if re.search(r"[^\w*]", plain) or not parts:
            condition = condition & F.lower(text).contains(plain.lower())
    return condition


def literal_matches(text: Column, query: str) -> Column:
    """The whole query as one literal; the case of ASCII letters doesn't matter."""
    ascii_low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return ascii_low(text).contains(ascii_low(F.lit(query)))


def select_events(events: DataFrame, sources: list | None = None, etypes: list[str] | None = None, min_severity: int = 1, time_from: int | None = None, time_to: int | None = None, query: str = "") -> DataFrame:
    """Events that pass all filters. Details are left out by default; ``time_from`` also leaves out untimed events, ``time_to`` too."""
    if sources:
        events = events.where(F.col("source_id").isin(sources))
    if etypes:
        events = events.where(F.col("etype").isin(etypes))
    if min_severity:
        events = events.where(F.col("severity") >= min_severity)
    if time_from is not None:
        events = events.where(F.col("ts_ms") >= time_from)
    if time_to is not None:
        events = events.where(F.col("ts_ms") <= time_to)
    return events.where(text_matches(F.col("text"), query)) if query.strip() else events


def in_order(events: DataFrame) -> DataFrame:
    """Time order, untimed events last."""
    return events.orderBy(F.col("ts_ms").asc_nulls_last(), "source_id", "line_start")


def page(events: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    return in_order(events).offset(int(offset)).limit(max(1, min(int(limit), PAGE_MAX)))


def capped_count(events: DataFrame) -> DataFrame:
    """``hits``, counted no further than one over ``COUNT_CAP``."""
    return events.limit(COUNT_CAP + 1).agg(F.count("*").alias("hits"))


# A line's own stamp, as the layouts write it, with the level behind a column's bar.
_CLOCK = r"\d\d:\d\d:\d\d(?:[.,]\d+)?"
_WEEKDAY = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
_STAMPS = (
    rf"\[?(?:{_WEEKDAY} )?\d{{4}}[-/]\d\d[-/]\d\d[T ]{_CLOCK}(?:Z|[+-]\d\d:?\d\d)?\]?:?(?: \| \w+ \|)?",
    r"\d{6} \d{9}",
    rf"{_WEEKDAY} \w{{3}} [ \d]\d {_CLOCK} \d{{4}} ->",
    rf"\d\d\.\d\d\.\d{{4}}[ ,]+{_CLOCK}",
)


def summary(text: Column) -> Column:
    """The beginning of an event's first line without its stamp, which lists show in a column of its own."""
    first = F.substring_index(text, "\n", 1)
    return F.substring(F.regexp_replace(first, rf"^\s*(?:{'|'.join(_STAMPS)})\s*", ""), 1, SUMMARY_CHARS)


def event_rows(events: DataFrame, occ: DataFrame) -> DataFrame:
    """A page of events with summary, first line and at most twelve identifiers."""
    chips = occ.join(events.select("event_id"), "event_id").where(~F.col("kind").isin(*WEAK_KINDS))
    chips = chips.groupBy("event_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("kind", "value", "display"))), 1, CHIPS).alias("chips"))
    first = F.substring_index("text", "\n", 1)
    return events.join(chips, "event_id", "left").withColumn("first_line", first).withColumn("summary", summary(F.col("text")))


def candidates(text: Column) -> Column:
    """Normal forms under which a typed text may be known."""
    t = F.trim(text)
    bare = F.trim(t, F.lit("<>[]"))
    return F.array_distinct(F.array_compact(F.array(t, F.lower(t), bare, F.lower(bare), ids.ip_value(bare), ids.queue_file(bare))))


def find_entities(entities: DataFrame, text: str) -> DataFrame:
    return entities.where(F.array_contains(candidates(F.lit(text)), F.col("value")))


def suggest(entities: DataFrame, text: str, limit: int = SUGGESTIONS) -> DataFrame:
    """Exact matches, then values that begin with the text, each once, most frequent first; sessions and requests aside."""
    text = text.strip()
    if len(text) < SUGGEST_CHARS:
        return entities.limit(0)
    exact = F.array_contains(candidates(F.lit(text)), F.col("value"))
    starts = F.col("value").startswith(text) | F.col("value").startswith(text.lower())
    some = entities.where(~F.col("kind").isin("session", "request") & (exact | starts)).withColumn("exact", exact)
    return some.orderBy(F.desc("exact"), F.desc("events"), "kind", "value").limit(limit)

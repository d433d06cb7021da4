"""What an analyst asks in one go: a trace with filters and a page of its events, and all about one event."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.functions import identifiers as ids
from logquarry.operators import entities as ent
from logquarry.operators import graph, search
from logquarry.operators import trace as tr
from logquarry.session import settled
from logquarry.sources.lines import context_window

KEY = ["kind", "value"]


@dataclass(frozen=True)
class Inquiry:
    """``traced`` has level, basis and hop of every event found; ``hits`` are the chosen ones, unordered and whole."""

    traced: DataFrame
    hits: DataFrame

    def level_counts(self) -> DataFrame:
        return tr.level_counts(self.traced)

    def count(self) -> DataFrame:
        return search.capped_count(self.hits)

    def page(self, occ: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
        """A page of the hits in time order, with summary and identifiers."""
        return search.in_order(search.event_rows(search.page(self.hits, limit, offset), occ))

    def identifiers(self, occ: DataFrame, anchors: DataFrame, limit: int = 24) -> DataFrame:
        """Identifiers of the hits, most shared first."""
        levels = [tr.DIRECT, tr.STRONG, tr.POSSIBLE]
        return graph.trace_entities(occ, self.hits.select("event_id", "level"), levels, anchors, limit)


def inquire(events: DataFrame, occ: DataFrame, entities: DataFrame, anchors: DataFrame, levels: tuple[int, ...] = (tr.DIRECT, tr.STRONG, tr.POSSIBLE), links: DataFrame | None = None, temporal_seconds: int = 0, **filters) -> Inquiry:
    """Trace ``anchors`` and keep the events of some levels that pass ``search.select_events``'s ``filters``.

    ``entities`` come from ``trace.usable``. The trace is computed once.
    """
    traced = settled(tr.trace(events, occ, entities, anchors, links, temporal_seconds))
    found = events.join(traced.where(F.col("level").isin(*levels)), "event_id")
    return Inquiry(traced, search.select_events(found, **filters))


def search_in_trace(events: DataFrame, traced: DataFrame, query: str) -> DataFrame:
    """Events of a trace that hold all words of ``query``, details included."""
    return search.select_events(events.join(traced, "event_id"), min_severity=0, query=query)


def event_detail(events: DataFrame, occ: DataFrame, entities: DataFrame, event_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One event; its identifiers with their flags; and the other events of its context, in order."""
    one = events.where(F.col("event_id") == event_id)
    named = occ.where(F.col("event_id") == event_id).join(entities, KEY, "left").select(*KEY, "role", "events", "common", "generic")
    beside = events.join(one.where("ctx is not null").select("ctx"), "ctx", "left_semi").where(F.col("event_id") != event_id)
    return one, named, search.in_order(beside)


def event_spans(events: DataFrame, event_id: int) -> DataFrame:
    """``start``, ``end``, ``kind`` and ``value`` of the identifiers in an event's text, to be marked in it."""
    found = events.where(F.col("event_id") == event_id).select(F.explode(ent.find(F.col("text"))).alias("f"))
    value = ent.normal(F.col("f.kind"), F.col("f.raw"))
    kind = F.when(F.col("f.kind").isin("ipv4", "ipv6"), ids.ip_kind(value)).otherwise(F.col("f.kind"))
    return found.select(F.col("f.start").alias("start"), F.col("f.end").alias("end"), kind.alias("kind"), value.alias("value")).where("value is not null").orderBy("start")


def event_context(events: DataFrame, event_id: int) -> DataFrame:
    """``ctx``, ``size`` and ``label`` of the context an event is in; a block of lines has no name of its own."""
    one = events.where((F.col("event_id") == event_id) & F.col("ctx").isNotNull()).select("ctx", F.coalesce("context_label", F.lit("processing block")).alias("label"))
    return events.join(one, "ctx").groupBy("ctx", "label").agg(F.count("*").alias("size"))


def event_lines(events: DataFrame, lines: DataFrame, event_id: int, around: int = 6) -> DataFrame:
    """The event's lines in its file with some before and behind, in order."""
    return context_window(lines, events.where(F.col("event_id") == event_id), around, around).orderBy("line_no")

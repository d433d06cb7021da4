"""Relations between identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.functions.labels import UNIQUE_KINDS, WEAK_KINDS
from logquarry.operators.trace import KEY, link_pairs

NODES, SECOND_NODES, MORE_NODES = 24, 4, 16


def shared_events(events: DataFrame, occ: DataFrame, anchors: DataFrame, links: DataFrame | None = None, kinds: list[str] | None = None) -> DataFrame:
    """For each anchor the identifiers of its events and their contexts, by distinct events they share."""
    a = anchors.select(F.col("kind").alias("a_kind"), F.col("value").alias("a_value"))
    held = occ.select(F.col("kind").alias("a_kind"), F.col("value").alias("a_value"), "event_id").join(a, ["a_kind", "a_value"], "left_semi").distinct()
    contexts = held.join(events.select("event_id", "ctx"), "event_id").where("ctx is not null").select("a_kind", "a_value", "ctx").distinct()
    near = held.union(contexts.join(events.select("event_id", "ctx"), "ctx").select("a_kind", "a_value", "event_id")).distinct()
    others = occ.select(*KEY, "event_id").distinct().where(~F.col("kind").isin(*WEAK_KINDS))
    if kinds:
        others = others.where(F.col("kind").isin(kinds))
    met = near.join(others, "event_id").where("not (kind = a_kind and value = a_value)")
    if links is not None:
        gone = link_pairs(links).toDF("a_kind", "a_value", "kind", "value")
        met = met.join(gone, ["a_kind", "a_value", "kind", "value"], "left_anti")
    return met.groupBy("a_kind", "a_value", *KEY).agg(F.count("*").alias("shared"))


def related(events: DataFrame, occ: DataFrame, anchors: DataFrame, limit: int = NODES, links: DataFrame | None = None, kinds: list[str] | None = None) -> DataFrame:
    """The ``limit`` identifiers that share most events with the anchors, ties by kind and value."""
    found = shared_events(events, occ, anchors, links, kinds)
    return found.groupBy(*KEY).agg(F.sum("shared").alias("shared")).orderBy(F.desc("shared"), *KEY).limit(limit)


def edges(occ: DataFrame, nodes: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Pairs of nodes in one event, each once, weighted by distinct events."""
    some = occ.select(*KEY, "event_id").join(nodes.select(*KEY).distinct(), KEY, "left_semi").distinct()
    left = some.select("event_id", F.col("kind").alias("a_kind"), F.col("value").alias("a_value"))
    right = some.select("event_id", F.col("kind").alias("b_kind"), F.col("value").alias("b_value"))
    pairs = left.join(right, "event_id").where(F.struct("a_kind", "a_value") < F.struct("b_kind", "b_value"))
    weighted = pairs.groupBy("a_kind", "a_value", "b_kind", "b_value").agg(F.count("*").alias("weight"))
    return weighted if links is None else weighted.join(link_pairs(links), ["a_kind", "a_value", "b_kind", "b_value"], "left_anti")


def graph(events: DataFrame, occ: DataFrame, anchor: DataFrame, limit: int = NODES, links: DataFrame | None = None, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: the anchor, its neighbours, and one step further behind messages and sessions."""
    first = related(events, occ, anchor, limit, links, kinds).select(*KEY)
    behind = shared_events(events, occ, first.where(F.col("kind").isin(*UNIQUE_KINDS)), links, kinds)
    from pyspark.sql import Window

    ranked = behind.withColumn("_n", F.row_number().over(Window.partitionBy("a_kind", "a_value").orderBy(F.desc("shared"), *KEY))).where(F.col("_n") <= SECOND_NODES)
    known = anchor.select(*KEY).union(first).distinct()
    second = ranked.join(known, KEY, "left_anti").groupBy(*KEY).agg(F.max("shared").alias("shared")).orderBy(F.desc("shared"), *KEY).limit(MORE_NODES).select(*KEY)
    nodes = known.union(second).distinct()
    return nodes, edges(occ, nodes, links)


def entity_detail(occ: DataFrame, per_source: DataFrame, kind: str, value: str, top: int = 200) -> tuple[DataFrame, DataFrame]:
    """Role counts, and the sources with most events, of one identifier."""
    mine = (F.col("kind") == kind) & (F.col("value") == value)
    roles = occ.where(mine & (F.col("role") != "")).groupBy("role").agg(F.count("*").alias("n"))
    return roles, per_source.where(mine).orderBy(F.desc("events"), "source_id").limit(top)


def trace_entities(occ: DataFrame, traced: DataFrame, levels: list[int], anchor: DataFrame, limit: int) -> DataFrame:
    """Identifiers of a trace's events at some levels, most shared first."""
    hidden = [*WEAK_KINDS, "session", "request"]
    some = occ.where(~F.col("kind").isin(hidden)).join(traced.where(F.col("level").isin(levels)).select("event_id"), "event_id", "left_semi")
    return some.join(anchor.select(*KEY), KEY, "left_anti").groupBy(*KEY).agg(F.countDistinct("event_id").alias("shared")).orderBy(F.desc("shared"), *KEY).limit(limit)

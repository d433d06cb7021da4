"""Correlation: from identifiers to the events around them.

``direct``: events that hold an anchor, their whole contexts, and what message
ids and queue files lead on to. ``strong``: other events of a party met near in
time. ``possible``: a party met at another time, a shared address near in time,
or mere closeness in time. Nothing is limited or cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions.labels import IP_KINDS, LINK_KINDS, PIVOT_KINDS
from logquarry.session import checkpoint_ready

# Fixed values.
DIRECT, STRONG, POSSIBLE = 1, 2, 3
WINDOW_MS = 300_000
MAX_HOPS = 3
PARTY_ROLES = ("from", "to", "return-path")
KEY = ["kind", "value"]


def usable(entities: DataFrame, excluded: DataFrame | None = None, included: DataFrame | None = None) -> DataFrame:
    """``entities`` with ``usable``: not excluded, and included or neither common nor generic."""
    for name, df in (("excluded", excluded), ("included", included)):
        entities = entities.join(df.select(*KEY, F.lit(True).alias(name)).distinct(), KEY, "left") if df is not None else entities.withColumn(name, F.lit(None).cast("boolean"))
    flag = F.col("excluded").isNull() & (F.col("included").isNotNull() | ~(F.col("common") | F.col("generic")))
    return entities.withColumn("usable", flag).withColumn("excluded", F.col("excluded").isNotNull()).drop("included")


def link_pairs(links: DataFrame) -> DataFrame:
    """Unordered pairs of identifiers (``a_kind``, ``a_value``, ``b_kind``, ``b_value``), both ways round."""
    turned = links.select(F.col("b_kind").alias("a_kind"), F.col("b_value").alias("a_value"), F.col("a_kind").alias("b_kind"), F.col("a_value").alias("b_value"))
    return links.select("a_kind", "a_value", "b_kind", "b_value").union(turned).distinct()


def _cut_off(anchors: DataFrame, links: DataFrame | None) -> DataFrame | None:
    """Identifiers whose link to an anchor a reviewer excluded."""
    if links is None:
        return None
    mine = anchors.select(F.col("kind").alias("a_kind"), F.col("value").alias("a_value"))
    return link_pairs(links).join(mine, ["a_kind", "a_value"], "left_semi").select(F.col("b_kind").alias("kind"), F.col("b_value").alias("value")).distinct()


def _without(df: DataFrame, gone: DataFrame | None, on: list[str]) -> DataFrame:
    return df if gone is None else df.join(gone, on, "left_anti")


def direct(events: DataFrame, occ: DataFrame, entities: DataFrame, anchors: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``event_id``, ``hop`` and ``basis`` of the explicit chain.

    Anchors are followed even where they are common. The basis is the one with
    the smallest hop, an identifier before a context, by kind and value.
    """
    checkpoint_ready(events.sparkSession)
    cut = _cut_off(anchors, links)
    frontier = anchors.select(*KEY).distinct().checkpoint()
    seen, found = frontier, None
    contexts = events.select("event_id", "ctx")
    for hop in range(MAX_HOPS + 1):
        label = F.concat(F.lit("contains " if hop == 0 else "same "), "kind", F.lit(" "), "value")
        held = occ.join(frontier, KEY).groupBy("event_id").agg(F.min(label).alias("basis"))
        held = _without(held, None if found is None else found.select("event_id"), ["event_id"]).withColumn("by_context", F.lit(False))
        around = contexts.join(held, "event_id").where("ctx is not null").select("ctx").distinct()
        beside = contexts.join(around, "ctx", "left_semi").select("event_id").distinct()
        beside = _without(beside.join(held, "event_id", "left_anti"), None if found is None else found.select("event_id"), ["event_id"])
        added = held.unionByName(beside.select("event_id", F.lit("same session, request or block").alias("basis"), F.lit(True).alias("by_context"))).withColumn("hop", F.lit(hop)).checkpoint()
        found = added if found is None else found.unionByName(added).checkpoint()
        if hop == MAX_HOPS:
            break
        good = entities.where("usable").select(*KEY)
        pivots = occ.where(F.col("kind").isin(*PIVOT_KINDS) & (F.col("role") != "context")).join(added.select("event_id"), "event_id", "left_semi")
        frontier = _without(pivots.select(*KEY).distinct().join(good, KEY, "left_semi").join(seen, KEY, "left_anti"), cut, KEY).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return found.select("event_id", "hop", "basis")


def near_times(times: DataFrame, candidates: DataFrame, key: list[str], window_ms: int) -> DataFrame:
    """Distinct (``key``, ``event_id``) of candidates within ``window_ms`` of a time of the same key.

    Times fall into cells of the window's width; a candidate asks its own cell
    and both neighbours, where each cell keeps only its first and last time. So
    a key with many times costs two values a cell, not a pair for each time.
    """
    cell = lambda c: F.floor(c / window_ms)
    cells = times.groupBy(*key, cell(F.col("t")).alias("cell")).agg(F.min("t").alias("low"), F.max("t").alias("high"))
    # In the own cell any time is near; of the cell before only its last can be, of the cell behind its first.
    cells = cells.select(*key, F.inline(F.array(F.struct(F.col("cell").alias("at"), F.lit(None).cast("long").alias("edge")), F.struct((F.col("cell") + 1).alias("at"), F.col("high").alias("edge")), F.struct((F.col("cell") - 1).alias("at"), F.col("low").alias("edge")))))
    asked = candidates.withColumn("at", cell(F.col("ts_ms")))
    hits = asked.join(cells, [*key, "at"]).where(F.col("edge").isNull() | (F.abs(F.col("ts_ms") - F.col("edge")) <= window_ms))
    return hits.select(*key, "event_id").distinct()


def parties(events: DataFrame, occ: DataFrame, entities: DataFrame, anchors: DataFrame, chain: DataFrame, links: DataFrame | None = None, window_ms: int = WINDOW_MS) -> DataFrame:
    """``event_id``, ``level`` and ``basis`` of strong and possible events: parties of the first hop met again."""
    cut = _cut_off(anchors, links)
    persons = anchors.where(~F.col("kind").isin(*LINK_KINDS)).isEmpty()
    seed = chain.where("hop = 0").select("event_id")
    named = occ.where(F.col("kind").isin(*LINK_KINDS) & (F.col("role") != "server"))
    seeds = named.where(~F.col("role").isin(*PARTY_ROLES)) if persons else named
    seeds = seeds.join(seed, "event_id", "left_semi").join(events.select("event_id", F.col("ts_ms").alias("t")), "event_id")
    known = _without(seeds.join(anchors.select(*KEY), KEY, "left_anti"), cut, KEY)
    flags = entities.where("not excluded").select(*KEY, "usable", "generic")
    known = known.join(flags, KEY).where(F.col("usable") | (F.col("kind").isin(*IP_KINDS) & ~F.col("generic")))
    who = known.select(*KEY, "usable").distinct()
    met = named.join(who, KEY).join(chain.select("event_id"), "event_id", "left_anti").join(events.select("event_id", "ts_ms"), "event_id").select(*KEY, "usable", "event_id", "ts_ms").distinct()
    close = near_times(known.where("t is not null").select(*KEY, "t"), met.where("ts_ms is not null"), KEY, window_ms).withColumn("near", F.lit(True))
    met = met.join(close, [*KEY, "event_id"], "left").withColumn("near", F.coalesce("near", F.lit(False))).where(F.col("usable") | F.col("near"))
    name = F.concat("kind", F.lit(" "), "value")
    judged = met.groupBy("event_id").agg(F.max("usable").alias("good"), F.max(F.col("usable") & F.col("near")).alias("strong"), F.collect_set(F.when(F.col("usable"), name)).alias("good_names"), F.collect_set(name).alias("names"))
    names = F.array_join(F.slice(F.array_sort(F.when(F.col("good"), F.col("good_names")).otherwise(F.col("names"))), 1, 3), " and ")
    basis = F.when(F.col("strong"), F.concat(F.lit("same "), names, F.lit(f", within {window_ms // 60_000} min"))).when(F.col("good"), F.concat(F.lit("same "), names, F.lit(", at another time"))).otherwise(F.concat(F.lit("shared address "), names, F.lit(", near in time")))
    return judged.select("event_id", F.when(F.col("strong"), STRONG).otherwise(POSSIBLE).alias("level"), basis.alias("basis"))


def temporal(events: DataFrame, chain: DataFrame, seconds: int) -> DataFrame:
    """Events of other sources within ``seconds`` of an event of the chain, details left out."""
    span = seconds * 1000
    mine = events.join(chain.select("event_id"), "event_id", "left_semi")
    times = mine.where("ts_ms is not null").select(F.lit(0).alias("k"), F.col("ts_ms").alias("t"))
    others = events.where("ts_ms is not null and severity >= 1").join(mine.select("source_id").distinct(), "source_id", "left_anti").join(chain.select("event_id"), "event_id", "left_anti")
    near = near_times(times, others.select(F.lit(0).alias("k"), "event_id", "ts_ms"), ["k"], span)
    return near.select("event_id", F.lit(POSSIBLE).alias("level"), F.lit(f"only near in time ({seconds} s), another source").alias("basis"))


def trace(events: DataFrame, occ: DataFrame, entities: DataFrame, anchors: DataFrame, links: DataFrame | None = None, temporal_seconds: int = 0, window_ms: int = WINDOW_MS) -> DataFrame:
    """``event_id``, ``level``, ``basis`` and ``hop`` (9 beyond the chain) of everything around ``anchors`` (``kind``, ``value``)."""
    chain = direct(events, occ, entities, anchors, links)
    more = parties(events, occ, entities, anchors, chain, links, window_ms).checkpoint()
    out = chain.select("event_id", F.lit(DIRECT).alias("level"), "basis", "hop").unionByName(more.withColumn("hop", F.lit(9)))
    if temporal_seconds:
        late = temporal(events, chain, temporal_seconds).join(more.select("event_id"), "event_id", "left_anti")
        out = out.unionByName(late.withColumn("hop", F.lit(9)))
    return out


def level_counts(traced: DataFrame) -> DataFrame:
    return traced.groupBy("level").agg(F.count("*").alias("n"))


def chosen(traced: DataFrame, levels: list[int]) -> Column:
    return F.col("level").isin(levels)

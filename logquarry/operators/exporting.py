"""Masked export of chosen events, with checks before anything leaves.

The identifiers of the chosen events are known, also those that no shape gives
away: accounts, devices, hosts. They are looked for in every line of the export,
and what can still be read after masking refuses it.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions import identifiers as ids
from logquarry.functions import names, times
from logquarry.functions.labels import KINDS
from logquarry.functions.numbering import ranked
from logquarry.operators import entities as ent
from logquarry.operators import learning, masking
from logquarry.session import settled

# Fixed values.
MIN_TERM, MIN_LEFTOVER = 3, 4
TERM_KINDS = ("account", "device", "host")
#: Categories whose known entries are looked for by name.
NAMED = ("Person", "Company", "Street", "City")
SENSITIVE = ("email", "account", "device", "ipv4", "ipv6", "endpoint", "domain", "host", "url", "msgid")

#: Where events without a time stand.
UNTIMED = 1 << 62
#: The lines of an export belong to one text.
EXPORT = "export"


class ExportRefused(ValueError):
    """Nothing was chosen, or values that are known or can be recognized are still readable in the masked lines."""


def aliases(events: DataFrame) -> DataFrame:
    """``source_id`` and ``alias`` Q1, Q2... in the order of the sources' first events; the window holds a row for each source."""
    firsts = events.groupBy("source_id").agg(F.min(F.coalesce("ts_ms", F.lit(UNTIMED))).alias("first"))
    return firsts.select("source_id", F.concat(F.lit("Q"), F.row_number().over(Window.orderBy("first", "source_id")).cast("string")).alias("alias"))


def lines(events: DataFrame, offset: Column, named: DataFrame) -> DataFrame:
    """``event_id``, ``ts_ms``, ``origin``, ``line_start``, ``line_no`` from 1 in order of time, and ``text``: time, zone, alias, message.

    ``named`` are ``aliases``. Lines that continue a message are indented. There is no limit: a caller who wants blocks takes ranges of ``line_no``.
    """
    stamp = F.when(F.col("ts_ms").isNull(), "no time").otherwise(F.concat_ws(" ", times.format_ms(F.col("ts_ms"), offset), times.zone_text(offset)))
    head = events.join(named, "source_id").withColumn("text", F.concat(stamp, F.lit(" "), "alias", F.lit(": "), F.regexp_replace("text", "\n", "\n    ")))
    rows = head.select("event_id", "ts_ms", F.col("source_id").alias("origin"), "line_start", "text", F.coalesce("ts_ms", F.lit(UNTIMED)).alias("_at"))
    return ranked(rows, ["_at", "origin", "line_start", "event_id"], name="line_no").drop("_at")


def header(events: DataFrame, named: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Three lines (``line_no`` -2 to 0, ``text``) before an export: what it is, its number of events, and its sources by alias.

    ``sources`` may give the ``name`` and ``layout`` of a ``source_id``.
    """
    told = named
    if sources is not None:
        told = told.join(sources.select("source_id", "name", "layout"), "source_id", "left")
    else:
        told = told.withColumn("name", F.col("source_id")).withColumn("layout", F.lit(None).cast("string"))
    shown = F.concat(F.col("alias"), F.lit(" = "), names.source_kind(F.coalesce("name", "source_id")), F.coalesce(F.concat(F.lit(" ("), "layout", F.lit(")")), F.lit("")))
    legend = told.agg(F.array_join(F.array_sort(F.collect_list(F.struct(F.substring("alias", 2, 19).cast("long").alias("n"), shown.alias("s"))))["s"], "; ").alias("legend"))
    count = events.agg(F.count("*").alias("n"))
    first = F.struct(F.lit(-2).alias("line_no"), F.lit("# Export for external analysis").alias("text"))
    second = count.select(F.struct(F.lit(-1).alias("line_no"), F.concat(F.lit("# "), F.col("n").cast("string"), F.lit(" events, values replaced by consistent placeholders.")).alias("text")).alias("line"))
    third = legend.select(F.struct(F.lit(0).alias("line_no"), F.concat(F.lit("# Sources: "), "legend").alias("text")).alias("line"))
    every = count.select(first.alias("line")).unionByName(second).unionByName(third)
    return every.select(F.col("line.line_no").cast("long").alias("line_no"), "line.text")


def _not_kept(kind: Column, value: Column, options: masking.Options) -> Column:
    """Whether a value isn't on the list of those that are never replaced; an endpoint goes by its address, too."""
    kept = [v.strip().lower() for v in options.ignore if v.strip()]
    address = F.regexp_replace(F.regexp_replace(F.lower(value), r":\d+$", ""), r"^\[|\]$", "")
    return ~(F.lower(value).isin(kept) | ((kind == "endpoint") & address.isin(kept))) if kept else F.lit(True)


def own_values(identifiers: DataFrame, options: masking.Options = masking.Options()) -> DataFrame:
    """``kind`` and ``value`` of what mustn't leave, from ``kind``, ``value``, ``generic`` and perhaps ``display``.

    Accounts, devices, hosts and hosts of URLs that are no domains, which have no shape, are of kind ``term``;
    generic names such as system accounts belong to nobody. Values of sensitive
    kinds come again as such, for what their surroundings hide.
    """
    display = F.col("display") if "display" in identifiers.columns else F.lit(None).cast("string")
    rows = identifiers.select("kind", F.coalesce("generic", F.lit(False)).alias("generic"), F.explode(F.array("value", display)).alias("value")).where("value is not null")
    named = F.col("kind").isin(*TERM_KINDS)
    host = F.rtrim(ids.url_host(F.col("value")), F.lit("."))
    hosts = rows.where(F.col("kind") == "url").select(F.lit("term").alias("kind"), host.alias("value")).where(ids.domain_value(F.col("value")).isNull() & ids.ip_value(F.col("value")).isNull())
    terms = rows.where(named & ~F.col("generic")).select(F.lit("term").alias("kind"), "value").unionByName(hosts).where(F.length("value") >= MIN_TERM)
    bare = F.regexp_replace(F.col("value"), r"^[<>\[\]]+|[<>\[\]]+$", "")
    shown = F.when(F.col("kind") == "endpoint", F.col("value")).otherwise(bare)
    swept = rows.where(F.col("kind").isin(*SENSITIVE) & ~(named & F.col("generic"))).select("kind", shown.alias("value"))
    swept = swept.where((F.length("value") >= MIN_LEFTOVER) & ~F.col("value").rlike(masking.OWN_OUTPUT))
    return terms.unionByName(swept).where(_not_kept(F.col("kind"), F.col("value"), options)).distinct()


def readable(masked: DataFrame, options: masking.Options = masking.Options(), id_col: str = "event_id") -> DataFrame:
    """``event_id``, ``kind``, ``value``, ``start`` and ``end`` of identifiers that can still be recognized in masked texts; what holds a placeholder isn't one."""
    found = masked.select(F.col(id_col).alias("event_id"), F.explode(ent.find(F.col("masked"))).alias("f"))
    rows = found.select("event_id", F.col("f.kind").alias("kind"), ent.normal(F.col("f.kind"), F.col("f.raw")).alias("value"), F.col("f.start").alias("start"), F.col("f.end").alias("end"))
    return rows.where(F.col("value").isNotNull() & F.col("kind").isin(*SENSITIVE) & ~F.col("value").rlike(masking.TOKEN)).where(_not_kept(F.col("kind"), F.col("value"), options))


def leaks(masked: DataFrame, known: DataFrame | None, options: masking.Options = masking.Options()) -> DataFrame:
    """``line_no``, ``kind``, ``value``, ``start`` and ``end`` of ``known`` values (``masking.value_keys`` of ``own_values``) and recognizable ones left in masked lines.

    Known values are looked for themselves, whatever their shape.
    """

    @F.pandas_udf("array<struct<kind:string,value:string,start:int,end:int>>")
    def spans(texts: pd.Series, values: pd.Series) -> pd.Series:
        def one(text, some):
            return [{"kind": v["kind"], "value": v["value"], "start": a, "end": b} for v in ([] if some is None else some) for a, b in masking.value_spans(v["kind"], v["value"], text)]

        return pd.Series([one(*row) for row in zip(texts, values, strict=True)], dtype=object)

    left = readable(masked, options, "line_no").withColumnRenamed("event_id", "line_no")
    if known is not None:
        rows = masked.select(F.lit(EXPORT).alias("source_id"), "line_no", F.col("masked").alias("text"))
        held = masking.with_values(rows, known.where("kind <> 'term'")).where("values is not null")
        left = left.unionByName(held.select("line_no", F.explode(spans(F.col("text"), F.col("values"))).alias("s")).select("line_no", "s.*"))
    return left.distinct()


def marks(masked: DataFrame, left: DataFrame, options: masking.Options = masking.Options()) -> DataFrame:
    """``line_no``, ``start``, ``end``, ``category`` and ``leak`` of every place a reviewer has to look at.

    ``left`` are ``leaks``, which refuse an export. The others ask for a look: what the passes would still replace, and secret words.
    """
    rows = masked.select(F.lit(EXPORT).alias("source_id"), "line_no", F.col("masked").alias("text"))
    pieces = masking.segmented(rows, masking.Options(ignore=options.ignore)).select("line_no", "segments")
    ends = F.expr("aggregate(segments, array(0), (a, s) -> concat(a, array(element_at(a, -1) + length(s.original))))")
    found = pieces.withColumn("at", ends).select("line_no", "at", F.posexplode("segments").alias("k", "s"))
    own = found.where(F.col("s.category").isNotNull() & ~F.col("s.original").rlike(masking.OWN_OUTPUT) & ~F.col("s.original").rlike(masking.TOKEN))
    review = own.select("line_no", F.get("at", F.col("k")).alias("start"), F.get("at", F.col("k") + 1).alias("end"), F.col("s.category").alias("category"))

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def secrets(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: [{"start": m.start(), "end": m.end()} for p in masking.secret_patterns() for m in p.finditer(text)])

    hints = rows.where(_any(F.col("text"))).select("line_no", F.explode(secrets(F.col("text"))).alias("s")).select("line_no", "s.start", "s.end", F.lit("Secret").alias("category"))
    review = review.unionByName(hints).withColumn("leak", F.lit(False))
    return left.select("line_no", "start", "end", F.lit("Leak").alias("category"), F.lit(True).alias("leak")).unionByName(review).distinct()


def _any(text: Column) -> Column:
    found = F.lit(False)
    for pattern in masking.SECRETS.values():
        found = found | text.rlike(pattern)
    return found


@dataclass(frozen=True)
class Export:
    """``lines`` (``event_id``, ``line_no``, ``ts_ms``, ``origin``, ``line_start``, ``masked``; the header's have no event), the dictionary with its new ``entries``, and ``marks`` for a review."""

    lines: DataFrame
    entries: DataFrame
    marks: DataFrame


def export(
    events: DataFrame,
    offset: Column,
    options: masking.Options = masking.Options(),
    known: DataFrame | None = None,
    identifiers: DataFrame | None = None,
    sources: DataFrame | None = None,
    shown: int = 20,
) -> Export:
    """The chosen events, masked for an analysis elsewhere.

    ``known`` is the dictionary so far, ``identifiers`` (``kind``, ``value``,
    ``generic``, perhaps ``display``) are those of the chosen events. Raises
    ``ExportRefused`` where no event is chosen, or where one of them, or anything that is recognized as an
    identifier, can be read in the masked lines; values in ``options.ignore`` stay by the user's decision.
    """
    named = settled(aliases(events))
    if named.isEmpty():
        raise ExportRefused("no events were chosen")
    rows = lines(events, offset, named)
    text = settled(rows.select("line_no", "text").unionByName(header(events, named, sources)).select(F.lit(EXPORT).alias("source_id"), "line_no", "text"))
    learned = settled(learning.learn(learning.blocks(text.where("line_no > 0")))) if options.personal else None
    own = None if identifiers is None else settled(masking.value_keys(own_values(identifiers, options)))
    people = None if learned is None else learned.select("category", "value")
    if people is not None and known is not None:
        people = people.unionByName(known.where(F.col("category").isin(*NAMED)).select("category", F.col("key").alias("value")))
    people = people and people.distinct()
    found = settled(masking.segmented(text, options, people, own))
    entries = masking.dictionary(masking.keys(found), known) if learned is None else learning.dictionary(masking.keys(found), learned, known)
    done = settled((masking.redacted(found) if options.redact else masking.masked(found, entries)).select("line_no", "masked"))
    left = settled(leaks(done, own, options))
    still = left.groupBy("kind").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no")).limit(shown).collect()
    if still:
        raise ExportRefused("readable in the masked lines: " + ", ".join(f"{KINDS.get(r['kind'], r['kind'])} ({r['n']}, first in line {r['line_no']})" for r in sorted(still)))
    out = done.join(rows.drop("text"), "line_no", "left").select("event_id", "line_no", "ts_ms", "origin", "line_start", "masked")
    return Export(out, entries, marks(done, left, options))

"""Identifiers, search, correlation, graph."""

from pyspark.sql import functions as F

from logquarry.functions import identifiers as ids
from logquarry.functions import times
from logquarry.operators import entities, graph, inquiry, search, sessions, trace
from logquarry.plans import tables
from logquarry.plans.tables import EVENTS_SQL


def _extracted(table, text, key, kind):
    def query(spark, sf_dir):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        find = {"ipv4": ids.v4_in, "email": ids.mail_in}[kind]
        found = rows.select(key, F.explode(find(F.col(text))).alias("raw"))
        return found.select(key, F.lower("raw").alias("value")).groupBy(key, "value").agg(F.count("*").alias("n"))

    return query


def extract_all(spark, sf_dir):
    """Addresses and mail of the document lines by value; ``extract_kinds`` has the other kinds too, which SQL can't express."""
    return extract_kinds(spark, sf_dir).where(F.col("kind").isin("ipv4", "email"))


def extract_kinds(spark, sf_dir):
    """Every identifier the document lines hold, by kind and value."""
    lines = tables.document_lines(spark, sf_dir)
    rows = lines.select(F.monotonically_increasing_id().alias("event_id"), "text", F.array().cast("array<struct<kind:string,value:string,role:string,display:string>>").alias("ids"))
    return entities.occurrences(rows).groupBy("kind", "value").agg(F.count("*").alias("lines"))


def url_hosts(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", ids.url_host(F.col("url")).alias("host"))


def entity_source(spark, sf_dir):
    return entities.entity_source(tables.events(spark, sf_dir), tables.occurrences(spark, sf_dir))


def entity_stats(spark, sf_dir):
    return entities.entity_totals(entity_source(spark, sf_dir))


def common_flags(spark, sf_dir):
    return entities.entities(tables.events(spark, sf_dir), tables.occurrences(spark, sf_dir)).select("kind", "value", "groups", "common", "generic")


def shared_ip(spark, sf_dir):
    """Addresses by the accounts they meet in a group; contexts here are an hour, whoever it is."""
    events = tables.events(spark, sf_dir).where("ts_ms is not null").withColumn("ctx", F.concat(F.lit("hour:"), times.bin_of(F.col("ts_ms")).cast("string")))
    return entities.account_counts(events, tables.occurrences(spark, sf_dir))


def worker_contexts(spark, sf_dir):
    events = tables.events(spark, sf_dir).withColumn("ctx", F.concat(F.lit("req:"), (F.col("user_id") % 50).cast("string"), F.lit(":"), F.floor(F.col("event_id") / 500).cast("string")))
    out = sessions.limit_workers(events)
    return out.groupBy("ctx").agg(F.count("*").alias("n"), F.count_if(F.col("worker").isNotNull()).alias("dissolved"))


def search_words(spark, sf_dir):
    lines = tables.document_lines(spark, sf_dir)
    return lines.where(search.text_matches(F.col("text"), "Licensed under")).select("source_id", "line_no")


def search_prefix(spark, sf_dir):
    lines = tables.document_lines(spark, sf_dir)
    return lines.where(search.text_matches(F.col("text"), "licen* apache")).select("source_id", "line_no")


def search_substring(spark, sf_dir):
    lines = tables.document_lines(spark, sf_dir)
    return lines.where(search.literal_matches(F.col("text"), "Apache License, Version 2.0")).select("source_id", "line_no")


def _entities(spark, sf_dir):
    return entities.entities(tables.events(spark, sf_dir), tables.occurrences(spark, sf_dir))


def suggest(spark, sf_dir):
    return search.suggest(_entities(spark, sf_dir), "user1").select("kind", "value", "events")


def find_entity(spark, sf_dir):
    return search.find_entities(_entities(spark, sf_dir), " <USER12@Example.com> ").select("kind", "value", "events")


def _anchor(spark):
    return spark.createDataFrame([("email", "user7@example.com")], "kind string, value string")


def _parts(spark, sf_dir):
    events, occ = tables.events(spark, sf_dir), tables.occurrences(spark, sf_dir)
    return events, occ, trace.usable(entities.entities(events, occ))


def trace_direct(spark, sf_dir):
    """Pivots are the queue files; a queue file of forty or more groups is common and isn't followed."""
    events, occ, known = _parts(spark, sf_dir)
    return trace.direct(events, occ, known, _anchor(spark)).select("event_id", "hop")


def trace_levels(spark, sf_dir):
    events, occ, known = _parts(spark, sf_dir)
    # The queue files are left out, so the chain is the account's contexts; its address is another party.
    occ = occ.where("kind <> 'queue'")
    events = events.withColumn("ctx", F.when(F.col("event_id") % 2 == 0, F.col("ctx")))
    occ = occ.where("not (kind = 'email' and event_id % 3 = 0)")
    return trace.level_counts(trace.trace(events, occ, known, _anchor(spark)))


def trace_rows(spark, sf_dir):
    """The events behind ``trace_levels``, errors alone."""
    events, occ, known = _parts(spark, sf_dir)
    occ = occ.where("kind <> 'queue'")
    events = events.withColumn("ctx", F.when(F.col("event_id") % 2 == 0, F.col("ctx")))
    occ = occ.where("not (kind = 'email' and event_id % 3 = 0)")
    found = inquiry.inquire(events, occ, known, _anchor(spark), min_severity=3)
    return found.hits.select("event_id", "level", F.col("basis").startswith("contains ").alias("contains"))


def event_detail(spark, sf_dir):
    """Identifiers of one event with their flags."""
    _, named, _ = inquiry.event_detail(tables.events(spark, sf_dir), tables.occurrences(spark, sf_dir), _entities(spark, sf_dir), 500)
    return named.select("kind", "value", "events", "common")


def trace_temporal(spark, sf_dir):
    events, occ, known = _parts(spark, sf_dir)
    occ = occ.where("kind = 'email'")
    events = events.withColumn("source_id", (F.col("user_id") % 10).cast("string"))
    chain = trace.direct(events.withColumn("ctx", F.lit(None).cast("string")), occ, known, _anchor(spark))
    return trace.temporal(events, chain, 120).select("event_id", "level")


def related_topk(spark, sf_dir):
    return graph.related(tables.events(spark, sf_dir), tables.occurrences(spark, sf_dir), _anchor(spark), 24)


def graph_edges(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    occ = items.select(F.lit("part").alias("kind"), F.format_string("%05d", F.col("l_partkey").cast("int")).alias("value"), F.col("l_orderkey").alias("event_id"))
    return graph.edges(occ, occ.select("kind", "value").distinct()).select("a_value", "b_value", "weight")


def exclude_link(spark, sf_dir):
    links = spark.createDataFrame([("ipv4", "10.0.0.7", "email", "user7@example.com")], "a_kind string, a_value string, b_kind string, b_value string")
    return graph.related(tables.events(spark, sf_dir), tables.occurrences(spark, sf_dir), _anchor(spark), 24, links)


def exclude_entity(spark, sf_dir):
    gone = spark.createDataFrame([("queue", "q0/1")], "kind string, value string")
    kept = spark.createDataFrame([("ipv4", "10.0.0.7")], "kind string, value string")
    return trace.usable(_entities(spark, sf_dir), gone, kept).groupBy("kind").agg(F.count_if("usable").alias("usable"), F.count_if("excluded").alias("excluded"))


QUERIES = {
    "extract_ipv4": _extracted("documents", "text", "doc_id", "ipv4"),
    "extract_mail": _extracted("documents", "text", "doc_id", "email"),
    "extract_mail_pages": _extracted("pages", "html", "page_id", "email"),
} | {f.__name__: f for f in (extract_all, extract_kinds, url_hosts, entity_source, entity_stats, common_flags, shared_ip, worker_contexts, search_words, search_prefix, search_substring, suggest, find_entity, trace_direct, trace_levels, trace_rows, event_detail, trace_temporal, related_topk, graph_edges, exclude_link, exclude_entity)}

_MAIL_SQL, _IP_SQL = tables.MAIL_SQL, tables.IP_SQL
_STATS = f"""{EVENTS_SQL}, es AS (
  SELECT kind, value, event_type AS source_id, COUNT(DISTINCT event_id) AS events, COUNT(DISTINCT ctx) AS groups, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM oc JOIN ev USING (event_id) GROUP BY ALL
), et AS (
  SELECT kind, value, CAST(SUM(events) AS BIGINT) AS events, CAST(SUM(groups) AS BIGINT) AS groups, COUNT(*) AS sources, min(first_ms) AS first_ms, max(last_ms) AS last_ms FROM es GROUP BY ALL
), cm AS (SELECT *, kind = 'queue' AND groups >= 40 AS common FROM et)"""
_TOKENS = r"list_contains(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), '%s')"
_NEAR = f"""{EVENTS_SQL}, h AS (SELECT event_id FROM ev WHERE user_id = 7), near AS (
  SELECT event_id FROM h UNION SELECT event_id FROM ev WHERE ctx IN (SELECT ctx FROM ev WHERE user_id = 7)
), rel AS (SELECT kind, value, COUNT(DISTINCT event_id) AS shared FROM near JOIN oc USING (event_id) WHERE NOT (kind = 'email' AND value = 'user7@example.com') GROUP BY ALL)"""
ORACLES = {
    "extract_ipv4": f"WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_IP_SQL}')) AS value FROM documents) SELECT doc_id, value, COUNT(*) AS n FROM f GROUP BY ALL",
    "extract_mail": f"WITH f AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{_MAIL_SQL}'))) AS value FROM documents) SELECT doc_id, value, COUNT(*) AS n FROM f GROUP BY ALL",
    "extract_mail_pages": f"WITH f AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '{_MAIL_SQL}'))) AS value FROM pages) SELECT page_id, value, COUNT(*) AS n FROM f GROUP BY ALL",
    "extract_all": f"""WITH {tables.LINES_SQL}, f AS (
  SELECT DISTINCT source_id, line_no, 'ipv4' AS kind, unnest(regexp_extract_all(text, '{_IP_SQL}')) AS value FROM dl
  UNION SELECT source_id, line_no, 'email', lower(unnest(regexp_extract_all(text, '{_MAIL_SQL}'))) FROM dl)
SELECT kind, value, COUNT(*) AS lines FROM f GROUP BY ALL""",
    "url_hosts": "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages",
    "entity_source": f"WITH {_STATS} SELECT * FROM es",
    "entity_stats": f"WITH {_STATS} SELECT * FROM et",
    "common_flags": f"WITH {_STATS} SELECT kind, value, groups, common, false AS generic FROM cm",
    "shared_ip": f"WITH {EVENTS_SQL} SELECT 'ipv4' AS kind, a.ip AS value, COUNT(DISTINCT b.account) AS accounts FROM ev a JOIN ev b ON a.ts_ms // 600000 = b.ts_ms // 600000 GROUP BY a.ip",
    "worker_contexts": f"""WITH {EVENTS_SQL}, c AS (SELECT *, 'req:' || (user_id % 50) || ':' || (event_id // 500) AS c FROM ev),
w AS (SELECT c, COUNT(*) > 400 OR max(ts_ms) - min(ts_ms) > 1800000 AS gone FROM c GROUP BY c)
SELECT CASE WHEN gone THEN NULL ELSE c END AS ctx, COUNT(*) AS n, COUNT(*) FILTER (gone) AS dissolved FROM c JOIN w USING (c) GROUP BY 1""",
    "search_words": f"WITH {tables.LINES_SQL} SELECT source_id, line_no FROM dl WHERE {_TOKENS % 'licensed'} AND {_TOKENS % 'under'}",
    "search_prefix": rf"WITH {tables.LINES_SQL} SELECT source_id, line_no FROM dl WHERE {_TOKENS % 'apache'} AND len(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: starts_with(x, 'licen'))) > 0",
    "search_substring": f"WITH {tables.LINES_SQL} SELECT source_id, line_no FROM dl WHERE contains(lower(text), 'apache license, version 2.0')",
    "suggest": f"WITH {_STATS} SELECT kind, value, events FROM cm WHERE starts_with(value, 'user1') ORDER BY events DESC, kind, value LIMIT 12",
    "find_entity": f"WITH {_STATS} SELECT kind, value, events FROM cm WHERE value = 'user12@example.com'",
    "trace_direct": f"""WITH {_STATS}, good AS (SELECT value AS queue FROM cm WHERE kind = 'queue' AND NOT common),
h0 AS (SELECT event_id FROM ev WHERE user_id = 7 OR ctx IN (SELECT ctx FROM ev WHERE user_id = 7)),
q1 AS (SELECT DISTINCT queue FROM ev WHERE event_id IN (SELECT event_id FROM h0) AND queue IN (SELECT queue FROM good)),
a1 AS (SELECT event_id, ctx FROM ev WHERE queue IN (SELECT queue FROM q1) AND event_id NOT IN (SELECT event_id FROM h0)),
h1 AS (SELECT event_id FROM a1 UNION SELECT event_id FROM ev WHERE ctx IN (SELECT ctx FROM a1) AND event_id NOT IN (SELECT event_id FROM h0)),
q2 AS (SELECT DISTINCT queue FROM ev WHERE event_id IN (SELECT event_id FROM h1) AND queue IN (SELECT queue FROM good) AND queue NOT IN (SELECT queue FROM q1)),
s1 AS (SELECT event_id FROM h0 UNION SELECT event_id FROM h1),
a2 AS (SELECT event_id, ctx FROM ev WHERE queue IN (SELECT queue FROM q2) AND event_id NOT IN (SELECT event_id FROM s1)),
h2 AS (SELECT event_id FROM a2 UNION SELECT event_id FROM ev WHERE ctx IN (SELECT ctx FROM a2) AND event_id NOT IN (SELECT event_id FROM s1)),
q3 AS (SELECT DISTINCT queue FROM ev WHERE event_id IN (SELECT event_id FROM h2) AND queue IN (SELECT queue FROM good) AND queue NOT IN (SELECT queue FROM q1 UNION SELECT queue FROM q2)),
s2 AS (SELECT event_id FROM s1 UNION SELECT event_id FROM h2),
a3 AS (SELECT event_id, ctx FROM ev WHERE queue IN (SELECT queue FROM q3) AND event_id NOT IN (SELECT event_id FROM s2)),
h3 AS (SELECT event_id FROM a3 UNION SELECT event_id FROM ev WHERE ctx IN (SELECT ctx FROM a3) AND event_id NOT IN (SELECT event_id FROM s2))
SELECT event_id, 0 AS hop FROM h0 UNION ALL SELECT event_id, 1 FROM h1 UNION ALL SELECT event_id, 2 FROM h2 UNION ALL SELECT event_id, 3 FROM h3""",
    "trace_levels": f"""WITH {EVENTS_SQL}, e2 AS (SELECT event_id, ts_ms, ip, user_id, CASE WHEN event_id % 2 = 0 THEN ctx END AS ctx FROM ev),
held AS (SELECT event_id, ctx FROM e2 WHERE user_id = 7 AND event_id % 3 <> 0),
chain AS (SELECT event_id FROM held UNION SELECT event_id FROM e2 WHERE ctx IN (SELECT ctx FROM held WHERE ctx IS NOT NULL)),
seed AS (SELECT ts_ms FROM e2 JOIN chain USING (event_id)),
met AS (SELECT event_id, EXISTS (SELECT 1 FROM seed WHERE abs(seed.ts_ms - e2.ts_ms) <= 300000) AS near FROM e2 WHERE user_id = 7 AND event_id NOT IN (SELECT event_id FROM chain))
SELECT 1 AS level, COUNT(*) AS n FROM chain HAVING COUNT(*) > 0 UNION ALL SELECT CASE WHEN near THEN 2 ELSE 3 END, COUNT(*) FROM met GROUP BY 1""",
    "trace_rows": f"""WITH {EVENTS_SQL}, e2 AS (SELECT event_id, ts_ms, ip, user_id, severity, CASE WHEN event_id % 2 = 0 THEN ctx END AS ctx FROM ev),
held AS (SELECT event_id, ctx FROM e2 WHERE user_id = 7 AND event_id % 3 <> 0),
chain AS (SELECT event_id FROM held UNION SELECT event_id FROM e2 WHERE ctx IN (SELECT ctx FROM held WHERE ctx IS NOT NULL)),
seed AS (SELECT ts_ms FROM e2 JOIN chain USING (event_id)),
met AS (SELECT event_id, EXISTS (SELECT 1 FROM seed WHERE abs(seed.ts_ms - e2.ts_ms) <= 300000) AS near FROM e2 WHERE user_id = 7 AND event_id NOT IN (SELECT event_id FROM chain)),
found AS (SELECT event_id, 1 AS level FROM chain UNION ALL SELECT event_id, CASE WHEN near THEN 2 ELSE 3 END FROM met)
SELECT event_id, level, event_id IN (SELECT event_id FROM held) AS contains FROM found JOIN e2 USING (event_id) WHERE severity >= 3""",
    "event_detail": f"WITH {_STATS} SELECT kind, value, events, common FROM cm JOIN oc USING (kind, value) WHERE event_id = 500",
    "trace_temporal": f"""WITH {EVENTS_SQL}, c AS (SELECT event_id, ts_ms, user_id % 10 AS s FROM ev WHERE user_id = 7)
SELECT event_id, 3 AS level FROM ev WHERE user_id % 10 NOT IN (SELECT s FROM c) AND EXISTS (SELECT 1 FROM c WHERE abs(c.ts_ms - ev.ts_ms) <= 120000)""",
    "related_topk": f"WITH {_NEAR} SELECT * FROM rel ORDER BY shared DESC, kind, value LIMIT 24",
    "graph_edges": """WITH o AS (SELECT DISTINCT l_orderkey AS e, printf('%05d', l_partkey) AS v FROM lineitem)
SELECT a.v AS a_value, b.v AS b_value, COUNT(*) AS weight FROM o a JOIN o b ON a.e = b.e AND a.v < b.v GROUP BY ALL""",
    "exclude_link": f"WITH {_NEAR} SELECT * FROM rel WHERE NOT (kind = 'ipv4' AND value = '10.0.0.7') ORDER BY shared DESC, kind, value LIMIT 24",
    "exclude_entity": f"""WITH {_STATS} SELECT kind, COUNT(*) FILTER (NOT (kind = 'queue' AND value = 'q0/1') AND ((kind = 'ipv4' AND value = '10.0.0.7') OR NOT common)) AS usable,
COUNT(*) FILTER (kind = 'queue' AND value = 'q0/1') AS excluded FROM cm GROUP BY kind""",
}

"""An investigation grows by parts, and its totals from statistics by source equal a full recount."""

import os

from pyspark.sql import functions as F

from logquarry.operators import entities as ent
from logquarry.operators.workspace import SOURCES, Workspace


def source(spark, name, number):
    return spark.createDataFrame([(name, f"{name}.log", "pipe", "utf-8", name.upper(), 1, None, "auto", None, 0)], SOURCES).withColumn("number", F.lit(number).cast("long"))


def rows(spark, name, number, n):
    """Events of a source, some with a zone, some without a time, and their identifiers."""
    base = number << 40
    events = spark.range(1, n + 1).select(
        (F.col("id") + base).alias("event_id"), F.lit(name).alias("source_id"), F.expr(f"IF(id % 5 = 0, NULL, TIMESTAMP_NTZ'2024-01-01 10:00:00' + make_interval(0,0,0,0,0,id * {number}))").alias("wall"),
        F.expr("IF(id % 3 = 0 AND id % 5 > 0, 60, CAST(NULL AS INT))").alias("offset"), F.expr("IF(id % 3 = 0 AND id % 5 > 0, 'exact', 'local')").alias("ts_flag"), F.expr(f"IF(id % 2 = 0, '{name}|c' || (id % 4), NULL)").alias("ctx"),
    )
    kinds = "stack(3, 'account', 'u' || (id % 7), 'account', 'U' || (id % 7), 'ipv4', '10.0.0.' || (id % 5), '', '10.0.0.' || (id % 5), 'queue', 'q' || (id % 2), '', 'q') AS (kind, value, role, display)"
    occ = spark.range(1, n + 1).select((F.col("id") + base).alias("event_id"), F.expr(kinds))
    return events, occ


def parts(space, table="events"):
    folder = space.folder.removeprefix("file://")
    return {n for n in os.listdir(f"{folder}/{table}") if not n.startswith(".")}


def totals(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_parts_and_totals(spark, tmp_path):
    space = Workspace(spark, f"file://{tmp_path}", "case-1")
    for number, name in enumerate("abc", 1):
        before = parts(space) if number > 1 else set()
        space.add(source(spark, name, number), *rows(spark, name, number, 40 * number))
        assert len(parts(space) - before) == 1 and before <= parts(space)
    assert totals(space.entities()) == totals(ent.entities(space.events(), space.read("occurrences")))
    space.set_time("b", 120, 2500)
    assert totals(space.entities()) == totals(ent.entities(space.events(), space.read("occurrences")))
    assert space.next_number() == 4
    before = parts(space)
    space.remove("c")
    assert parts(space) == before and space.next_number() == 4 and {r["source_id"] for r in space.read("events").select("source_id").distinct().collect()} == {"a", "b"}
    # Removed and added again: rows of the old part don't come back.
    space.add(source(spark, "c", 4), *rows(spark, "c", 4, 8))
    assert space.read("events").where("source_id = 'c'").count() == 8
    before = totals(space.entities())
    space.compact()
    assert totals(space.entities()) == before and space.read("events").count() == 128


def test_two_sources_of_one_part(spark, tmp_path):
    space = Workspace(spark, f"file://{tmp_path}", "case-1")
    one, two = rows(spark, "a", 1, 10), rows(spark, "b", 2, 10)
    space.add(source(spark, "a", 1).unionByName(source(spark, "b", 2)), one[0].unionByName(two[0]), one[1].unionByName(two[1]))
    space.remove("a")
    assert space.read("events").count() == 10 and {r["sources"] for r in space.entities().collect()} == {1}
    space.remove("b")
    assert space.read("events") is None and space.next_number() == 3


def test_accounts_of_a_large_group(spark):
    """With three accounts kept of a group, the same addresses are common."""
    events = spark.range(600).select(F.col("id").alias("event_id"), F.lit("s").alias("source_id"), F.expr("'g' || IF(id < 400, 0, id % 50)").alias("ctx"), F.lit(1).alias("ts_ms"))
    occ = events.select("event_id", F.expr("stack(2, 'ipv4', '10.0.0.' || (event_id % 200), '', 'account', 'u' || (event_id % 90), 'account') AS (kind, value, role)"))
    flags = [{tuple(r) for r in ent.address_accounts(events, occ, most).groupBy("kind", "value").agg((F.count("*") >= 3).alias("c")).collect()} for most in (None, 3)]
    assert flags[0] == flags[1]
    assert ent.address_accounts(events, occ, 3).count() < ent.address_accounts(events, occ).count()

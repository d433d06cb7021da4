"""Queries on tables that the small ones don't show: old times, many users, more ranges than tasks."""

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry
from logquarry import plans
from logquarry.operators import entities, sessions
from logquarry.session import checkpoint_ready

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, folder, rows):
    """An event table of (ts, user_id, event_type) in a folder of its own."""
    made = [(k, ts, user, kind, 1.0, "{}") for k, (ts, user, kind) in enumerate(rows)]
    spark.createDataFrame(made, EVENTS).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def same(spark, folder, name, table="events"):
    """The query's rows, held against its SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    cursor = con.execute(plans.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    mine = sorted((tuple(row) for row in entry.queries()[name](spark, folder).select(*columns).collect()), key=repr)
    assert mine == sorted(cursor.fetchall(), key=repr)
    return mine


@pytest.mark.parametrize("name", ["time_bins", "severity_bins", "histogram_binned"])
def test_last_half_millisecond_of_a_bin(spark, tmp_path, name):
    """Among six million events some are so late in their bin."""
    end = dt.datetime(2024, 1, 1, 0, 10)
    rows = [(end + dt.timedelta(microseconds=u), 1, "view") for u in (-501, -500, -499, -1, 0, 499, 500)]
    same(spark, events(spark, tmp_path, rows), name)


@pytest.mark.parametrize("name", ["time_bins", "severity_bins", "histogram_binned"])
def test_bins_before_1970(spark, tmp_path, name):
    old = dt.datetime(1970, 1, 1)
    rows = [(old + dt.timedelta(minutes=m, microseconds=-1), 1, "view") for m in (-25, -10, -9, 0, 1, 9, 10, 25)]
    same(spark, events(spark, tmp_path, rows), name)


@pytest.mark.parametrize("name", ["parse_pipe", "parse_bracket", "parse_access"])
def test_clients_that_are_no_addresses(spark, tmp_path, name):
    """With over 65,536 users some addresses have numbers above 255."""
    at = dt.datetime(2024, 1, 1, 12)
    rows = [(at + dt.timedelta(seconds=k), user, kind) for k, (user, kind) in enumerate([(7, "view"), (65535, "error"), (65536, "view"), (89999, "error"), (540000, "click")])]
    assert len(same(spark, events(spark, tmp_path, rows), name)) == 5


def test_shared_addresses_before_1970(spark, tmp_path):
    old = dt.datetime(1970, 1, 1)
    rows = [(old + dt.timedelta(minutes=m), user, "view") for m, user in ((-25, 1), (-9, 2), (9, 3), (11, 3), (11, 4), (12, 300))]
    assert len(same(spark, events(spark, tmp_path, rows), "shared_ip")) == 5


def test_accounts_met_are_counted_without_pairs(spark):
    """In tiles smaller than a group; values are those of the pairs, and no join makes rows of pairs."""
    shown = "event_id long, ctx string"
    events = spark.createDataFrame([(k, f"g{k % 3}" if k % 5 else None) for k in range(400)], shown)
    occ = spark.createDataFrame([(k, kind, f"{kind}{k * m % n}", role) for k in range(400) for kind, m, n, role in (("ipv4", 7, 90, "client"), ("email", 11, 150, "account"), ("queue", 1, 5, ""))], "event_id long, kind string, value string, role string")
    counted = entities.account_counts(events, occ, 16, 64)
    want = entities.address_accounts(events, occ).groupBy("kind", "value").count()
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, want.collect()))
    assert "PythonCoGroup" in (plan := counted._jdf.queryExecution().toString()) or "FlatMapCoGroups" in plan


def test_values_come_back_as_they_were_written(spark, tmp_path):
    """One placeholder serves a value in any case and form; the way back gives each line its own."""
    texts = [
        "INSH!! THEDLY.IGNL!! thedly.ignl Thedly.Example.COM\nthedly.ignl THEDLY.IGNL", "Mail Ann@Mail.Example.COM, ann@mail.example.com", "at 2001:DB8:0:0::5 and 2001:db8::5",
        "7.2.0.192.IN-ADDR.ARPA 7.2.0.192.in-addr.arpa 192.0.2.7", "Sehr geehrte Frau Muster,\nFRAU MUSTER und Muster", "plain", "",
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(k, t, "en", "src0", len(t)) for k, t in enumerate(texts)], schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert len(same(spark, str(tmp_path), "restore_roundtrip", "documents")) == 8


def test_sessions_leave_no_intermediate_tables(spark):
    """Of a parsed event log only its items and marks stay on disk."""
    folder = checkpoint_ready(spark).sparkContext.getCheckpointDir().removeprefix("file:")
    there = set(os.listdir(folder))
    stamp = "Mon 2024-01-01 10:00:0%d.000: "
    log = [stamp % 1 + "Session 00000007; child 1", stamp % 2 + "Authenticated as user7@example.com", "  more of it", stamp % 3 + "----------", stamp % 4 + "alone"]
    events = sessions.parse(spark.createDataFrame([("a", k, t) for k, t in enumerate(log, 1)], "source_id string, line_no long, text string"))
    rows = {r["line_start"]: (r["line_end"], r["context"], r["text"]) for r in events.collect()}
    assert rows[2] == (3, "session:0:00000007", "\n".join(log[1:3])) and rows[5][0] == 5 and len(rows) == 4
    assert len(set(os.listdir(folder)) - there) <= 2

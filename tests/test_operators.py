"""Small made-up inputs for what no table shows."""

import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from logquarry.functions import identifiers as ids
from logquarry.functions import names
from logquarry.operators import collecting, learning, masking, search, sessions, trace
from logquarry.session import settled
from logquarry.sources import files, lines

LOG = """START Event Log
Wed 2026-10-21 00:01:00.971: Session 00000006; child 0001
Wed 2026-10-21 00:01:02.000: Authenticated as a@x.example
Wed 2026-10-21 00:01:03.000: ----------
Wed 2026-10-21 00:02:00.000: Content Filter processing c:\\q\\md50000001.msg...
Wed 2026-10-21 00:02:01.000: * Matched 1 of 5 active rules
Wed 2026-10-21 00:02:02.000: ----------
Wed 2026-10-21 00:03:00.000: --------- Partial transcript
Wed 2026-10-21 00:03:01.000: Session 00000007; child 0001
Wed 2026-10-21 00:03:02.000: <-- a
Wed 2026-10-21 00:03:03.000: ---------- End partial transcript
Wed 2026-10-21 00:04:00.000: --------- Partial transcript
Wed 2026-10-21 00:03:02.000: <-- a
Wed 2026-10-21 00:04:02.000: --> b
Wed 2026-10-21 00:04:03.000: ---------- End partial transcript
Server Shutdown Wed, 21 Oct 2026 01:00:00 +0200
Wed 2026-10-21 02:00:00.000: Beginn der Protokolldatei
Wed 2026-10-21 02:00:01.000: E [0000ABCD] oops"""


def frame(spark, texts):
    return spark.createDataFrame([("s", k + 1, t) for k, t in enumerate(texts)], "source_id string, line_no long, text string")


def test_event_log(spark):
    rows = {r["line_start"]: r for r in sessions.parse(frame(spark, LOG.split("\n"))).collect()}
    assert {k for k, r in rows.items() if r["context"] == "session:1:00000006"} == {2, 3, 4}
    assert rows[5]["etype"] == "filter.scan" and rows[5]["severity"] == 2 and rows[5]["line_end"] == 7
    assert 13 not in rows and rows[14]["context"] == "session:1:00000007"
    assert rows[16]["offset"] == 120 and rows[16]["ts_flag"] == "exact"
    assert rows[18]["context"] == "req:2:0000ABCD" and rows[18]["severity"] == 3


MAIL = [
    "mail ann.b@mail.example.com from host1.sub.example.co.uk and 203.0.113.7 at 7.113.0.203.in-addr.arpa",
    "Task 30927.Regards see app.dll 010.0.0.1 2001:db8::5",
    "Telefon: 040 1234567 IBAN DE89 3704 0044 0532 0130 00 Musterweg 5",
    "Muster Software GmbH, 20095 Hamburg HRB 12345 +49 40 123456",
    "",
]


def test_mask_and_restore(spark):
    found = masking.segmented(frame(spark, MAIL), masking.Options())
    entries = masking.dictionary(masking.keys(found))
    masked = masking.masked(found, entries)
    texts = {r["line_no"]: r["masked"] for r in masked.collect()}
    assert texts[1] == "mail user001@host001.kunde001.tld from host002.host003.kunde002.tld and [IPv4-001] at [IPv4-001].in-addr.arpa"
    assert texts[2] == "Task 30927.Regards see app.dll 010.0.0.1 [IPv6-001]"
    assert [r["restored"] for r in masking.restored(masked, entries).orderBy("line_no").collect()] == MAIL
    again = masking.leaks(masked.withColumnRenamed("masked", "text"))
    assert again.count() == 0


def test_options(spark):
    options = masking.Options(keep_private_ip=True, keep_domains=("example.com",), terms=("Nordlicht",), ignore=("203.0.113.9",))
    rows = frame(spark, ["10.0.0.1 b@a.example.com 203.0.113.9 nordlicht nordlicht@x.example"])
    found = masking.segmented(rows, options)
    text = masking.masked(found, masking.dictionary(masking.keys(found))).first()["masked"]
    assert text == "10.0.0.1 user001@a.example.com 203.0.113.9 [WERT-001] user002@kunde001.tld"
    assert masking.redacted(found).first()["masked"] == "10.0.0.1 [MAIL-ENTFERNT] 203.0.113.9 [ENTFERNT] [MAIL-ENTFERNT]"


def test_dictionary_goes_on(spark):
    known = spark.createDataFrame([("IPv4", "203.0.113.7", "203.0.113.7", "[IPv4-041]")], "category string, folded string, key string, token string")
    found = masking.segmented(frame(spark, ["203.0.113.8 203.0.113.7"]), masking.Options())
    tokens = {r["key"]: r["token"] for r in masking.dictionary(masking.keys(found), known).collect()}
    assert tokens == {"203.0.113.7": "[IPv4-041]", "203.0.113.8": "[IPv4-042]"}


def test_learning(spark):
    texts = spark.createDataFrame([("m", "Sehr geehrte Frau Muster,\nVon: \"Erika Beispiel\" <e@x.example>\nViele Grüße\nJan Probe\nSitz: Musterstadt")], "source_id string, text string")
    found = {(r["part"], r["value"]) for r in learning.learn(texts).collect()}
    assert {("surname", "Muster"), ("full", "Erika Beispiel"), ("full", "Jan Probe"), ("", "Musterstadt")} <= found
    tokens = {r["key"]: r["token"] for r in learning.person_numbers(learning.learn(texts)).collect()}
    assert tokens["Beispiel"][-4:] == tokens["Erika Beispiel"][-4:]


def test_inventory(spark, tmp_path):
    (tmp_path / "IMAP-2024-01-05.log").write_text("a")
    (tmp_path / "skip.bin").write_text("b")
    with zipfile.ZipFile(tmp_path / "logs-2024-02-01.zip", "w") as archive:
        archive.writestr("RAW-2024-01-06.log", "cc")
        archive.writestr("undated.log", "d")
    (tmp_path / "broken-2024-01-01.zip").write_bytes(b"no zip")
    found = {r["name"] or r["source_name"]: r for r in files.inventory(spark, str(tmp_path), container_date=True).collect()}
    assert found["IMAP-2024-01-05.log"]["day"] == date(2024, 1, 5) and found["IMAP-2024-01-05.log"]["log_type"] == "IMAP"
    assert found["undated.log"]["day"] == date(2024, 2, 1) and found["broken-2024-01-01.zip"]["error"] and "skip.bin" not in found


def test_encodings(spark, tmp_path):
    for name, data in {"a.log": "\ufeffä\r\nb".encode(), "b.log": "ä\rb\n".encode("cp1252"), "c.log": "ä\n\nb".encode("utf-16")}.items():
        (tmp_path / name).write_bytes(data)
    rows = lines.read_lines(spark, str(tmp_path)).select(names.leaf(F.col("source_id")).alias("f"), "line_no", "text").orderBy("f", "line_no").collect()
    assert [tuple(r) for r in rows] == [("a.log", 1, "ä"), ("a.log", 2, "b"), ("b.log", 1, "ä"), ("b.log", 2, "b"), ("c.log", 1, "ä"), ("c.log", 2, ""), ("c.log", 3, "b")]


def test_domains(spark):
    df = spark.createDataFrame([(x,) for x in ("Mail.Example.com", "30927.Regards", "Feature.Mit", "Example.Com", "a.log", "1.2.3", "sig.ra")], "n string")
    assert [r[0] for r in df.select(ids.domain_value(F.col("n"))).collect()] == ["mail.example.com", None, None, "example.com", None, None, None]


def test_near_times(spark):
    import random

    rng = random.Random(4)
    times = [rng.randint(-50, 5000) for _ in range(40)]
    asked = [rng.randint(-300, 6000) for _ in range(200)]
    t = spark.createDataFrame([("k", x) for x in times], "k string, t long")
    c = spark.createDataFrame([("k", i, x) for i, x in enumerate(asked)], "k string, event_id long, ts_ms long")
    got = {r["event_id"] for r in trace.near_times(t, c, ["k"], 100).collect()}
    assert got == {i for i, x in enumerate(asked) if any(abs(x - y) <= 100 for y in times)}


def test_names_collide(spark):
    rows = [(1, "a.log"), (2, "A.log"), (3, "b?.log"), (4, "a.log"), (5, "x__2.log"), (6, "x.log"), (7, "x.log")]
    df = spark.createDataFrame(rows, "file_id long, name string")
    out = [r["output_name"] for r in collecting.output_names(df, "file_id").orderBy("file_id").collect()]
    assert out == ["a.log", "A__2.log", "b_.log", "a__3.log", "x__2.log", "x.log", "x__3.log"]


@pytest.mark.parametrize("query, hits", [("select inbox", 1), ("Authenticat*", 1), ("View=Main", 1), ("missing", 0)])
def test_text_search(spark, query, hits):
    df = spark.createDataFrame([("SELECT INBOX",), ("Authenticated as x",), ("GET /?View=Main&x",)], "text string")
    assert df.where(search.text_matches(F.col("text"), query)).count() == hits


def test_workspace(spark, tmp_path):
    from logquarry.operators.workspace import SOURCES, Workspace

    space = Workspace(spark, f"file://{tmp_path}", "case-1")
    sources = spark.createDataFrame([("a", "a.log", "pipe", "utf-8", "A", 1, None, "auto", None, 0), ("b", "b.log", "pipe", "utf-8", "B", 1, None, "auto", None, 0)], SOURCES)
    events = spark.sql("SELECT CAST(id AS LONG) AS event_id, IF(id < 3, 'a', 'b') AS source_id, TIMESTAMP_NTZ'2024-01-01 10:00:00' AS wall, IF(id = 1, 60, CAST(NULL AS INT)) AS offset, IF(id = 1, 'exact', 'local') AS ts_flag, CAST(NULL AS STRING) AS ctx FROM range(1, 6)")
    occ = spark.sql("SELECT CAST(id AS LONG) AS event_id, 'account' AS kind, IF(id < 3, 'x', 'y') AS value, '' AS role, '' AS display FROM range(1, 6)")
    space.add(sources, events, occ)
    space.add(sources, events, occ)
    assert space.events().count() == 5
    assert {r["ts_flag"] for r in space.events().collect()} == {"exact", "inferred"}
    space.set_time("b", 120, 2000)
    late = space.events().where("source_id = 'b'").first()
    assert late["ts_flag"] == "source" and late["ts_ms"] == 1704103200000 - 7_200_000 + 2000
    space.decide("exclude", ("account", "x"))
    assert space.decisions("exclude").count() == 1
    space.decide("exclude", ("account", "x"), undo=True)
    assert space.decisions("exclude").count() == 0
    space.remove("a")
    assert [r["value"] for r in space.entities().collect()] == ["y"]
    with pytest.raises(ValueError):
        Workspace(spark, "x", "../up")


def test_store(spark, tmp_path):
    from logquarry.operators import store

    entries = spark.createDataFrame([("IPv4", "203.0.113.7", "[IPv4-001]"), ("Person", "Erika Beispiel", "[PERSON-001]")], store.ENTRIES)
    data = store.to_dict(entries, ["term"])
    path = tmp_path / "store.json"
    store.save(spark, path, data, "a long password")
    store.save(spark, path, data, "a long password")
    assert store.load(spark, path, "a long password") == data and (tmp_path / "store.json.1.bak").exists()
    assert store.describe(spark, path)["readable"] is False and store.needs_password(path)
    assert {r["folded"] for r in store.from_dict(spark, data).collect()} == {"203.0.113.7", "erika beispiel"}
    with pytest.raises(store.StoreError):
        store.load(spark, path, "another password")


def test_streaming(spark, tmp_path):
    from logquarry.streaming import live

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("2026-10-21 15:40:43 | WARNING | x\n2026-10-21 15:41:43 | INFO | y\nno stamp\n2026-10-21 15:51:43 | INFO | z\n")
    events = live.stamped_events(live.read_lines(spark, str(tmp_path / "in")), "pipe")
    query = live.live_bins(events).writeStream.outputMode("complete").format("memory").queryName("live_bins").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["start"].minute, r["severity"], r["n"]) for r in spark.table("live_bins").collect()) == [(40, 1, 1), (40, 2, 1), (50, 1, 1)]


def test_written_files(spark, tmp_path):
    from logquarry.operators import writing
    from logquarry.sources.lines import lines_of

    texts = spark.createDataFrame([("logs/a.log", "x 203.0.113.7\r\ny\nz\r"), ("b.txt", "203.0.113.7")], "path string, text string")
    found = masking.segmented(lines_of(texts, "path", F.col("text")), masking.Options())
    masked = masking.masked(found, masking.dictionary(masking.keys(found)))
    out = writing.masked_files(masked, writing.line_endings(texts, "path", "text"))
    folder = f"file://{tmp_path}/out"
    assert {r["output_name"]: r["bytes"] for r in writing.write_files(out, folder).collect()} == {"a.anonym.log": 18, "b.anonym.txt": 10}
    assert (tmp_path / "out" / "a.anonym.log").read_bytes() == b"x [IPv4-001]\r\ny\nz\r"
    with pytest.raises(ValueError):
        writing.write_files(out, folder)


def test_growing_copies(spark):
    import random

    rng = random.Random(2)
    base = bytes(rng.randrange(256) for _ in range(900))
    texts = [base, base[:600], base[:512], base[:511], base[:700] + b"x", base, base[:600], b"", base[:513][::-1]]
    files = spark.createDataFrame([(k, bytearray(t), len(t)) for k, t in enumerate(texts)], "file_id long, content binary, size long")
    want = {}
    for k, t in enumerate(texts):
        longer = [(len(u), j) for j, u in enumerate(texts) if len(u) > len(t) >= 512 and u.startswith(t)]
        if longer:
            want[k] = max(longer)[1]
    assert {r["file_id"]: r["longest"] for r in collecting.growing_copies(files).collect()} == want


@pytest.mark.parametrize("text, want", [
    ("a@b.example, x.y@sub.host.example-", [("email", "a@b.example"), ("email", "x.y@sub.host.example")]),
    ("a..b@x.example .c@y.example", []),
    ("Browser/120.0.0.0 localhost/10.1.2.3:80 300.1.1.1 1.2.3.4.5", [("ipv4", "10.1.2.3"), ("port", "80")]),
    ("[2001:db8::5]:443 ::ffff:192.0.2.1 12:34:56 ::", [("ipv6", "2001:db8::5"), ("port", "443"), ("ipv6", "::ffff:192.0.2.1")]),
    ("Message-ID: <a.b@c.example>, see https://x.example/a?b", [("msgid", "<a.b@c.example>"), ("url", "https://x.example/a?b")]),
    ("q\\md50000001.msg at mail.host.example. aa.bb.c1", [("queue", "md50000001.msg"), ("domain", "mail.host.example"), ("domain", "aa.bb")]),
])
def test_identifiers(spark, text, want):
    from logquarry.operators import entities

    found = spark.createDataFrame([(text,)], "t string").select(entities.find(F.col("t")).alias("f")).first()["f"]
    assert sorted((r["kind"], r["raw"]) for r in found) == sorted(want)


def test_names_meet_lines(spark):
    rows = frame(spark, ["Erika Beispiel grüßt ERIKA BEISPIEL", "vonBeispiel Beispielen", "nobody"])
    names = spark.createDataFrame([("Person", "Erika Beispiel"), ("Person", "Beispiel"), ("Person", "Xy")], "category string, value string")
    found = masking.segmented(rows, masking.Options(), names)
    shown = {r["line_no"]: r["masked"] for r in masking.redacted(found).collect()}
    assert shown == {1: "[NAME-ENTFERNT] grüßt [NAME-ENTFERNT]", 2: "von[NAME-ENTFERNT] Beispielen", 3: "nobody"}


def test_without_training_operators(tmp_path):
    """The library, the entry module and its queries work without the subpackage for training data."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'time_bins' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert said.returncode == 0, said.stderr


def test_people_share_numbers(spark):
    rows = frame(spark, ["Viele Grüße", "Jan Probe", "", "from \"Beispiel, Erika\" <e@x.example>", "Sehr geehrte Frau Beispiel, PROBE STRASSE", "Straße Strasse"])
    findings = settled(learning.learn(learning.blocks(rows)))
    found = settled(masking.segmented(rows, masking.Options(terms=("Straße", "STRASSE")), findings.select("category", "value").distinct()))
    entries = settled(learning.dictionary(masking.keys(found), findings))
    tokens = {r["folded"]: r["token"] for r in entries.collect()}
    assert tokens["jan probe"].startswith("[PERSON-") and tokens["probe"] == tokens["jan probe"].replace("PERSON", "NAME")
    assert tokens["beispiel"] == tokens["erika beispiel"].replace("PERSON", "NAME") and tokens["strasse"] == "[WERT-001]"
    shown = masking.masked(found, entries)
    texts = {r["line_no"]: r["masked"] for r in shown.collect()}
    assert texts[2] == tokens["jan probe"] and texts[5].endswith(f"{tokens['probe']} [WERT-001]") and texts[6] == "[WERT-001] [WERT-001]"
    more = learning.dictionary(masking.keys(found), learning.learn(frame(spark, ["Von: \"Anna Neu\" <a@x.example>"])), entries)
    assert more.where("folded = 'anna neu'").first()["token"] == "[PERSON-003]" and more.count() == entries.count() + 2


def test_blocks(spark):
    rows = frame(spark, [str(k) for k in range(1, 11)])
    got = {r["block"]: r["text"].split("\n") for r in learning.blocks(rows, 5, 2).collect()}
    assert got == {0: ["1", "2", "3", "4", "5"], 1: ["4", "5", "6", "7", "8"], 2: ["7", "8", "9", "10"], 3: ["10"]}


def test_unknown_tokens(spark):
    entries = spark.createDataFrame([("IPv4", "203.0.113.7", "203.0.113.7", "[IPv4-001]")], "category string, folded string, key string, token string")
    rows = spark.createDataFrame([("s", 1, "[IPv4-001] [IPv4-009] [ipv4-009]")], "source_id string, line_no long, masked string")
    row = masking.restored(rows, entries).first()
    assert (row["restored"], row["resolved"], row["unresolved"], row["unknown"]) == ("203.0.113.7 [IPv4-009] [ipv4-009]", 1, 2, ["[ipv4-009]"])


def test_lists_and_pasted_text(spark):
    from logquarry.operators import store

    data = store.listed(store.listed({"Version": 2}, "Terms", "Nordlicht "), "Terms", "nordlicht")
    data = store.listed(data, "Ignore", "203.0.113.9")
    assert data["Terms"] == ["Nordlicht"]
    with pytest.raises(store.StoreError):
        store.listed(data, "Patterns", "(")
    text, after = store.mask_text(spark, "NORDLICHT at 203.0.113.7\r\n203.0.113.9", data)
    assert text == "[WERT-001] at [IPv4-001]\r\n203.0.113.9"
    assert after["IPv4"] == {"203.0.113.7": "[IPv4-001]"} and after["Ignore"] == ["203.0.113.9"]
    fewer = store.unlisted(after, "Terms", "NORDLICHT")
    assert fewer["Terms"] == [] and fewer["Extra"] == after["Extra"]
    assert store.mask_text(spark, "203.0.113.8", fewer)[0] == "[IPv4-002]"
    assert masking.preview(frame(spark, ["a", "b", "c"]), n=2).count() == 2


def test_investigations(spark, tmp_path):
    from logquarry.operators.workspace import SOURCES, Workspace, investigations

    root = f"file://{tmp_path}/all"
    assert investigations(spark, root) == []
    for name in ("case-1", "case-2"):
        Workspace(spark, root, name).write("sources", spark.createDataFrame([], SOURCES))
    (tmp_path / "all" / "other").mkdir()
    assert investigations(spark, root) == ["case-1", "case-2"]
    Workspace(spark, root, "case-1").delete()
    assert investigations(spark, root) == ["case-2"]


def test_copy_labels(spark):
    rows = spark.createDataFrame([("a/b/x.log", "c/x.log"), ("x.log", "c/x.log"), ("a/y.log", "c/x.log")], "p string, o string")
    assert [r[0] for r in rows.select(names.copy_label(F.col("p"), F.col("o"))).collect()] == ["b/x.log", "x.log", "y.log"]


@pytest.mark.parametrize("text, want", [
    ("2026-10-21 15:40:43.123 | WARNING | login of x\nmore", "login of x"),
    ("[Wed 2026-10-21 15:40:43] INFO, x", "INFO, x"),
    ("2026-10-21T15:40:43,5+02:00: x", "x"),
    ("261021 154043123 E [0000ABCD] oops", "E [0000ABCD] oops"),
    ("Wed Oct  1 15:40:43 2026 -> scanned", "scanned"),
    ("21.10.2026, 15:40:43 ERROR x", "ERROR x"),
    ("no stamp 2026-10-21 15:40:43", "no stamp 2026-10-21 15:40:43"),
])
def test_summaries(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(search.summary(F.col("t"))).first()[0] == want


def test_event_spans_and_context(spark):
    from logquarry.operators import inquiry

    rows = [(1, "s", "login a@b.example from 203.0.113.7:993", "s|req:1", "Request 1"), (2, "s", "x", "s|req:1", "Request 1"), (3, "s", "y", "s|b", None), (4, "s", "z", None, None)]
    events = spark.createDataFrame(rows, "event_id long, source_id string, text string, ctx string, context_label string")
    text = rows[0][2]
    found = inquiry.event_spans(events, 1).collect()
    assert [(text[r["start"] : r["end"]], r["kind"], r["value"]) for r in found] == [("a@b.example", "email", "a@b.example"), ("203.0.113.7", "ipv4", "203.0.113.7"), ("203.0.113.7:993", "port", "993")]
    got = [[tuple(r) for r in inquiry.event_context(events, k).collect()] for k in (1, 3, 4)]
    assert got == [[("s|req:1", "Request 1", 2)], [("s|b", "processing block", 1)], []]

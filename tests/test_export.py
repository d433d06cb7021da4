"""Exports: known values that no shape gives away, refusals, marks, and the way back."""

import pytest
from pyspark.sql import functions as F

from logquarry.operators import exporting, masking
from logquarry.session import settled

EVENTS = "event_id long, source_id string, line_start long, ts_ms long, text string"
IDS = "kind string, value string, display string, generic boolean"


def events(spark, texts, source="logs/Mail-2026-10-21.log"):
    return spark.createDataFrame([(k, source, k, 1000 * k, t) for k, t in enumerate(texts, 1)], EVENTS)


def texts(export):
    """(header, lines)"""
    rows = export.lines.orderBy("line_no").collect()
    return [r["masked"] for r in rows[:3]], [r["masked"].split(": ", 1)[1] for r in rows[3:]]


def restored(export):
    rows = export.lines.select(F.lit("x").alias("source_id"), "line_no", "masked")
    return [r["restored"].split(": ", 1)[1] for r in masking.restored(rows, export.entries).orderBy("line_no").collect()[3:]]


KNOWN = [
    ("device", "device77", "DEVICE77", False), ("account", "jsmith", "jsmith", False), ("host", "srv-alpha", "srv-alpha", False), ("account", "postmaster", "postmaster", True),
    ("email", "ann@x.example", "ann@x.example", False), ("ipv4", "203.0.113.7", "203.0.113.7", False), ("endpoint", "203.0.113.7:993", "203.0.113.7:993", False),
    ("url", "http://intranet/start", "http://intranet/start", False), ("domain", "host.example", "host.example", False), ("msgid", "id.5@x.example", "<id.5@x.example>", False),
    ("ipv6", "2001:db8::5", "2001:db8::5", False), ("account", "李雷明", "李雷明", False),
]


def test_known_addresses_that_are_none(spark):
    """Numbers above 255 make no address; a value known as one is replaced all the same, wherever it stands as a whole."""
    made = exporting.export(events(spark, ["from 10.0.300.7 to 10.0.300.70 and 10.0.300.7"]), F.lit(0), masking.Options(personal=False, keep_private_ip=True), identifiers=spark.createDataFrame([("ipv4", "10.0.300.7", None, False), ("ipv4", "10.0.300.70", None, False)], IDS))
    assert texts(made)[1] == ["from [IPv4-001] to [IPv4-002] and [IPv4-001]"]
    assert restored(made) == ["from 10.0.300.7 to 10.0.300.70 and 10.0.300.7"]


LINES = [
    "device DEVICE77 of jsmith on srv-alpha, mail ann@x.example",
    "cmd=Sync&User=jsmith&DeviceId=device77&x=1 postmaster jsmithers srv-alpha.local",
    "QS:user_jsmith_203.0.113.7_x from203.0.113.7host.example to 203.0.113.70",
    "open http://intranet/start and INTRANET, [2001:db8::5]:443 x2001:db8::5y 203.0.113.7:993",
    "got <id.5@x.example> 李雷明\nand ann@x.example again",
]


def test_known_values_never_leave(spark):
    export = exporting.export(events(spark, LINES), F.lit(60), identifiers=spark.createDataFrame(KNOWN, IDS))
    head, lines = texts(export)
    every = "\n".join(head + lines).lower()
    for gone in ("device77", "jsmith ", "jsmith&", "jsmith_", "srv-alpha ", "ann@", "203.0.113.7", "intranet", "2001:db8", "李雷明", "id.5"):
        assert gone not in every, gone
    assert "postmaster jsmithers" in lines[1]
    same = lines[0].split()[3]
    assert same.startswith("[WERT-") and f"User={same}&" in lines[1] and f"user_{same}_" in lines[2]
    assert [t.lower() for t in restored(export)] == [t.replace("\n", "\n    ").lower() for t in LINES]
    assert head == ["# Export for external analysis", "# 5 events, values replaced by consistent placeholders.", "# Sources: Q1 = Mail"]


def test_lines_in_order_of_time(spark):
    rows = spark.createDataFrame([(1, "b-2026-01-01.log", 1, 2000, "login 203.0.113.7\nmore"), (2, "a.log", 5, 1000, "from 203.0.113.8"), (3, "a.log", 6, None, "untimed")], EVENTS)
    export = exporting.export(rows, F.lit(60), sources=spark.createDataFrame([("a.log", "Proxy-2026-10-21.log", "pipe lines")], "source_id string, name string, layout string"))
    assert [(r["event_id"], r["masked"]) for r in export.lines.orderBy("line_no").collect()[2:]] == [
        (None, "# Sources: Q1 = Proxy (pipe lines); Q2 = b"),
        (2, "1970-01-01 01:00:01.000 +01:00 Q1: from [IPv4-001]"),
        (1, "1970-01-01 01:00:02.000 +01:00 Q2: login [IPv4-002]\n    more"),
        (3, "no time Q1: untimed"),
    ]
    assert export.marks.count() == 0


def test_refusals(spark):
    """What the passes can't replace refuses an export, and so does what a setting keeps."""
    rows = events(spark, ["sent <nodots@localhost> to ann@x.example"])
    with pytest.raises(exporting.ExportRefused, match="message id"):
        exporting.export(rows, F.lit(0), identifiers=spark.createDataFrame([("msgid", "nodots@localhost", None, False)], IDS))
    exporting.export(rows, F.lit(0), identifiers=spark.createDataFrame([("msgid", "nodots@localhost", None, False)], IDS), options=masking.Options(ignore=("nodots@localhost",)))
    kept = events(spark, ["at mail.host.example"])
    with pytest.raises(exporting.ExportRefused, match="domain"):
        exporting.export(kept, F.lit(0), masking.Options(keep_domains=("host.example",)), identifiers=spark.createDataFrame([("domain", "mail.host.example", None, False)], IDS))
    with pytest.raises(exporting.ExportRefused, match="no events"):
        exporting.export(kept.limit(0), F.lit(0))


def test_a_value_that_is_never_replaced_stays(spark):
    known = spark.createDataFrame([("endpoint", "203.0.113.7:993", None, False), ("ipv4", "203.0.113.7", None, False)], IDS)
    export = exporting.export(events(spark, ["from 203.0.113.7:993"]), F.lit(0), masking.Options(ignore=("203.0.113.7",)), identifiers=known)
    assert texts(export)[1] == ["from 203.0.113.7:993"]


def test_placeholders_go_on(spark):
    """The store's placeholders are used, its names are found, and new entries follow its counters."""
    known = spark.createDataFrame([("Person", "erika muster", "Erika Muster", "[PERSON-004]"), ("Extra", "jsmith", "jsmith", "[WERT-007]")], "category string, folded string, key string, token string")
    ids = spark.createDataFrame([("account", "jsmith", None, False), ("host", "srv9", None, False)], IDS)
    export = exporting.export(events(spark, ["Erika Muster asked jsmith at srv9", "Viele Grüße Eva Probe"]), F.lit(0), known=known, identifiers=ids)
    assert texts(export)[1] == ["[PERSON-004] asked [WERT-007] at [WERT-008]", "Viele Grüße [PERSON-005]"]
    assert export.entries.count() == 5


def test_marks(spark):
    """Secret words ask for a look, leaks are named apart."""
    export = exporting.export(events(spark, ["login failed, password=Sommer2026 rejected"]), F.lit(0))
    line = export.lines.where("line_no = 1").first()["masked"]
    assert [(line[r["start"] : r["end"]], r["category"], r["leak"]) for r in export.marks.collect()] == [("password", "Secret", False)]
    masked = spark.createDataFrame([(1, "x DEVICE77 [IPv4-001] 203.0.113.9")], "line_no long, masked string")
    left = settled(exporting.leaks(masked, masking.value_keys(spark.createDataFrame([("device", "device77")], "kind string, value string"))))
    assert {(r["kind"], r["value"], r["start"], r["end"]) for r in left.collect()} == {("device", "device77", 2, 10), ("ipv4", "203.0.113.9", 22, 33)}
    assert {(r["start"], r["category"], r["leak"]) for r in exporting.marks(masked, left).collect()} == {(2, "Leak", True), (22, "Leak", True), (22, "IPv4", False)}


def test_values_meet_lines(spark):
    """Every whole occurrence is found through the join on beginnings, whatever is glued to it."""
    import random

    rng = random.Random(6)
    values = [("ipv4", "10.2.3.4"), ("account", "ab12"), ("account", "müller_x"), ("host", "srv-a.b"), ("url", "http://h/a/b/c/d/e/f/g/1/2/3/4/5/6?x=1"), ("ipv6", "2001:db8::1"), ("device", "üü")]
    glue = ["", " ", "_", ".", "-", "x", "9", "ö", ":", "[", "=", "z."]
    rows = [(k, "".join(rng.choice(glue) + rng.choice(values)[1] + rng.choice(glue) for _ in range(3))) for k in range(400)]
    lines = spark.createDataFrame([("s", k, t) for k, t in rows], "source_id string, line_no long, text string")
    keyed = settled(masking.value_keys(spark.createDataFrame(values, "kind string, value string")))
    got = {r["line_no"]: {tuple(v) for v in r["values"] or []} for r in masking.with_values(lines, keyed).collect()}
    for k, text in rows:
        assert {v for v in values if masking.value_spans(*v, text)} <= got[k], text

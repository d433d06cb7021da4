"""Import as one flow: duplicates, growing copies, replaced sources, both phases."""

from logquarry.operators.importing import import_paths
from logquarry.operators.workspace import SOURCES, Workspace

LINE = "2026-10-21 15:{:02d}:43 | WARNING | user a{}@x.example did something that takes a long line to say, from 203.0.113.{}\n"


def log(low, high):
    return "".join(LINE.format(k % 60, k, k % 250) for k in range(low, high))


def test_import(spark, tmp_path):
    root, later = tmp_path / "logs", tmp_path / "later"
    root.mkdir()
    later.mkdir()
    (root / "grow-2026-10-21.log").write_text(log(0, 20))
    (root / "web-2026-10-21.log").write_text(log(100, 120))
    (root / "web-again.log").write_text(log(100, 120))
    (later / "grown.log").write_text(log(0, 30))
    (later / "other.log").write_text("no stamp here\nnor here\n")
    space = Workspace(spark, f"file://{tmp_path}/cases", "case-1")
    first = import_paths(spark, space, [f"file:{root}"])
    got = {r["path"].rsplit("/", 1)[-1]: (r["phase"], r["outcome"], (r["other"] or "").rsplit("/", 1)[-1]) for r in first.collect()}
    assert got == {"grow-2026-10-21.log": ("priority", "imported", ""), "web-2026-10-21.log": ("priority", "imported", ""), "web-again.log": ("priority", "duplicate", "web-2026-10-21.log")}
    assert space.read("events").count() == 40
    assert {r["layout"] for r in space.read("sources", SOURCES).collect()} == {"pipe"}
    accounts = {r["value"] for r in space.entities().where("kind = 'email'").collect()}
    assert accounts == {f"a{k}@x.example" for k in [*range(20), *range(100, 120)]}

    old = next(r["source_id"] for r in space.read("sources", SOURCES).collect() if "grow-" in r["source_id"])
    space.set_time(old, 120, 2000)
    second = import_paths(spark, space, [f"file:{root}"], [f"file:{later}"])
    got = {(r["path"].rsplit("/", 1)[-1], r["phase"], r["outcome"]) for r in second.collect()}
    assert got == {
        ("grow-2026-10-21.log", "priority", "duplicate"), ("web-2026-10-21.log", "priority", "duplicate"), ("web-again.log", "priority", "duplicate"),
        ("grown.log", "background", "imported"), ("other.log", "background", "imported"), ("grow-2026-10-21.log", "background", "replaced"),
    }
    sources = {r["name"]: r for r in space.read("sources", SOURCES).collect()}
    assert set(sources) == {"web-2026-10-21.log", "grown.log", "other.log"}
    assert (sources["grown.log"]["tz_mode"], sources["grown.log"]["tz_offset"], sources["grown.log"]["skew_ms"]) == ("fixed", 120, 2000)
    assert space.read("events").groupBy("source_id").count().count() == 3 and space.read("events").count() == 20 + 30 + 2


def test_import_of_growing_copies_at_once(spark, tmp_path):
    """Only the longest is read, in the phase of the most urgent of its copies; a missing layout is a plain text log."""
    root, later = tmp_path / "logs", tmp_path / "later"
    root.mkdir()
    later.mkdir()
    (root / "a.log").write_text(log(0, 10))
    (later / "b.log").write_text(log(0, 15))
    (later / "c.log").write_text(log(0, 25))
    (later / "empty.log").write_text("")
    (later / "events.log").write_text("Wed 2026-10-21 00:01:00.971: Session 00000006; child 0001\nWed 2026-10-21 00:01:02.000: Authenticated as a@x.example\nWed 2026-10-21 00:01:03.000: ----------\n")
    space = Workspace(spark, f"file://{tmp_path}/cases", "case-1")
    report = import_paths(spark, space, [f"file:{root}"], [f"file:{later}"]).collect()
    got = {r["path"].rsplit("/", 1)[-1]: (r["phase"], r["outcome"], (r["other"] or "").rsplit("/", 1)[-1]) for r in report}
    assert got["a.log"] == ("priority", "continued", "c.log") and got["b.log"] == ("background", "continued", "c.log") and got["c.log"][:2] == ("priority", "imported")
    assert {r["name"]: r["layout"] for r in space.read("sources", SOURCES).collect()} == {"c.log": "pipe", "events.log": "mdaemon"}
    events = space.read("events")
    assert events.where("source_id like '%c.log'").count() == 25
    assert {r["ctx"].rsplit("/", 1)[-1] for r in events.where("ctx is not null").collect()} == {"events.log|session:0:00000006"}

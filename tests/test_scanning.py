"""The look at heads and tails before an import, its plan, and the import of what the plan chooses."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from logquarry.operators import scanning
from logquarry.operators.importing import import_scanned
from logquarry.operators.workspace import SOURCES, Workspace, with_columns
from logquarry.sources import files

START = datetime(2026, 10, 21, 8, tzinfo=timezone.utc)


def ms(seconds):
    return int(START.timestamp() * 1000) + 1000 * seconds


def pipe(low, high):
    return "".join(f"{datetime.fromtimestamp(ms(k) / 1000, timezone.utc):%Y-%m-%d %H:%M:%S.%f} | INFO | 200 Reply: GET /x/{k} from ::ffff:203.0.113.{k % 250} and more text\n" for k in range(low, high))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("scan")
    (root / "Web-2026-10-21.log").write_text(pipe(0, 6000))
    (root / "copy.log").write_text(pipe(0, 2500))
    (root / "Other-2026-10-22.log").write_bytes("no stamp\r\nä nor here\r\n".encode("cp1252"))
    (root / "Late-2026-10-21.log").write_text("\n" + pipe(9000, 9010), encoding="utf-16")
    return root


def listed(spark, folder):
    return files.sources(spark, [f"file:{folder}"])


def test_scan(spark, folder, monkeypatch):
    reads = []
    original = scanning.ends(listed(spark, folder).select("path", F.col("length").alias("size")))
    for r in original.collect():
        reads.append(len(r["head"]) + len(r["tail"]))
    assert max(reads) == 2 * scanning.PEEK_BYTES
    rows = {r["name"]: r for r in scanning.scan(listed(spark, folder)).collect()}
    big = rows["Web-2026-10-21.log"]
    assert (big["kind"], str(big["day"]), big["layout"], big["encoding"], big["first_ms"], big["last_ms"]) == ("Web", "2026-10-21", "pipe", "utf-8", ms(0), ms(5999))
    assert big["size"] > 5 * scanning.PEEK_BYTES and not big["imported"] and big["error"] is None
    assert rows["copy.log"]["within"] == "Web-2026-10-21.log" and [n for n, r in rows.items() if r["within"]] == ["copy.log"]
    assert (rows["Other-2026-10-22.log"]["layout"], rows["Other-2026-10-22.log"]["encoding"], rows["Other-2026-10-22.log"]["first_ms"]) == ("generic", "cp1252", None)
    late = rows["Late-2026-10-21.log"]
    assert (late["layout"], late["encoding"], late["first_ms"], late["last_ms"]) == ("pipe", "utf-16-le", ms(9000), ms(9009))


def test_plan_and_import(spark, folder, tmp_path):
    """Kinds and times of the window come first, the rest later or never; what is imported is known by path, size and time."""
    scanned = scanning.scan(listed(spark, folder))
    window = scanning.Window(("Web", "Late"), ms(5999), ms(8000), "skip")
    plans = {r["name"]: r["plan"] for r in scanning.plan(scanned, window).collect()}
    assert plans == {"Web-2026-10-21.log": "first", "copy.log": "skip", "Other-2026-10-22.log": "background", "Late-2026-10-21.log": "skip"}
    space = Workspace(spark, f"file://{tmp_path}/cases", "case-1")
    report = {(r["path"].rsplit("/", 1)[-1], r["phase"], r["outcome"]) for r in import_scanned(space, scanned, window).collect()}
    assert report == {("Web-2026-10-21.log", "priority", "imported"), ("Other-2026-10-22.log", "background", "imported")}
    assert space.read("events").count() == 6002
    again = scanning.scan(listed(spark, folder), with_columns(space.read("sources", SOURCES)))
    assert {r["name"] for r in again.where("imported").collect()} == {"Web-2026-10-21.log", "Other-2026-10-22.log"}
    got = {r["kind"]: r for r in scanning.groups(again).collect()}
    assert (got["Web"]["imported"], got["copy"]["within"], got["copy"]["first_ms"], got["Late"]["layouts"]) == (1, 1, ms(0), ["pipe"])
    # A file that goes on from an imported one replaces it.
    (folder / "Grown-2026-10-21.log").write_text(pipe(0, 6500))
    more = {r["name"]: r for r in scanning.scan(listed(spark, folder), with_columns(space.read("sources", SOURCES))).collect()}
    assert more["Grown-2026-10-21.log"]["replaces"] == ["Web-2026-10-21.log"] and more["copy.log"]["within"] == "Grown-2026-10-21.log"
    (folder / "Grown-2026-10-21.log").unlink()

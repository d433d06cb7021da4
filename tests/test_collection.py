"""Collecting in one call: copies, names, duplicates, manifest, a target that has files."""

import hashlib
import zipfile

import pytest

from logquarry.operators import collection


@pytest.fixture
def logs(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "mail-2024-01-03.log").write_bytes(b"one")
    (root / "sub" / "mail-2024-01-03.log").write_bytes(b"two")
    (root / "sub" / "web-2024-01-03.log").write_bytes(b"one")
    (root / "web-2024-01-04.log").write_bytes(b"x" * 3_000_000)
    (root / "undated.log").write_bytes(b"no day")
    with zipfile.ZipFile(root / "a.zip", "w") as archive:
        archive.writestr("in/web-2024-01-04.log", "from the archive")
        archive.writestr("in/mail-2024-01-05.log", "two")
    (root / "bad.zip").write_bytes(b"no archive")
    return root


def test_collect(spark, logs, tmp_path):
    target = f"file://{tmp_path}/out"
    rows = collection.collect(spark, [f"file://{logs}"], target)
    table = [r.asDict() for r in rows.collect()]
    assert sorted(r["Status"] for r in table) == ["ArchiveError", "Duplicate", "Duplicate"] + ["Selected"] * 4
    assert table[0]["Status"] == "ArchiveError" and table[0]["Bytes"] == "0" and table[0]["SourceName"] == "bad.zip" and table[0]["SourceKind"] == "ZIP"
    written = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")}
    assert sorted(hashlib.sha256(c).hexdigest() for c in written.values()) == sorted({hashlib.sha256(c).hexdigest() for c in (b"one", b"two", b"x" * 3_000_000, b"from the archive")})
    for r in table[1:]:
        assert hashlib.sha256(written[r["OutputName"]]).hexdigest().upper() == r["SHA256"] and len(written[r["OutputName"]]) == int(r["Bytes"])
    assert {"web-2024-01-04.log", "web-2024-01-04__2.log"} <= set(written)
    saved = spark.read.option("header", True).csv(target + ".manifest.csv")
    assert saved.columns == rows.columns and saved.count() == len(table)
    assert collection.summary(rows).first().asDict() == {"selected": 4, "duplicates": 2, "archive_errors": 1, "bytes": 3_000_000 + 3 + 3 + 16}


def test_collect_into_a_used_target(spark, logs, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "mail-2024-01-03.log").write_bytes(b"another")
    (out / "kept.log").write_bytes(b"one")
    (out / "kept-too.log").write_bytes(b"one")
    with pytest.raises(ValueError):
        collection.collect(spark, [f"file://{logs}"], f"file://{out}", days=["2024-01-03"])
    with pytest.raises(ValueError):
        collection.collect(spark, [f"file://{logs}"], f"file://{out}", days=["1999-01-01"], force=True)
    table = collection.collect(spark, [f"file://{logs}"], f"file://{out}", days=["2024-01-03"], force=True).collect()
    assert sorted((r["Status"], r["OutputName"]) for r in table if r["Status"] != "ArchiveError") == [("Duplicate", "kept-too.log"), ("Duplicate", "kept-too.log"), ("Selected", "mail-2024-01-03__2.log")]
    assert (out / "mail-2024-01-03.log").read_bytes() == b"another" and (out / "mail-2024-01-03__2.log").read_bytes() == b"two"

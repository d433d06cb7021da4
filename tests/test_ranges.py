"""Lines read in ranges are those of whole files, wherever a range is cut."""

import io
import random
import re

import pytest
from pyspark.sql import functions as F

from logquarry.sources import lines, ranges

SAMPLES = {
    "utf-8": "ä\r\nb\rc\n\n\r\r\nlast é\r".encode(),
    "utf-8-sig": b"\xef\xbb\xbfone\r\ntwo\n",
    "cp1252": "\n\nstra\xdfe\r\n\r\rx".encode("cp1252"),
    "utf-16-le": b"\xff\xfe" + "a\r\nഊ਀b\r\n\rend".encode("utf-16-le"),
    "utf-16-be": b"\xfe\xff" + "a\nb\r".encode("utf-16-be"),
}


def whole(data, encoding):
    """(offset, line) of a file by splitting all of it."""
    mark = ranges.mark_of(encoding, data)
    text = data[mark:].decode(encoding.replace("-sig", ""), "replace")
    out, at = [], mark
    for line, end in re.findall(r"([^\r\n]*)(\r\n|\n|\r|$)", text):
        if line or end:
            out.append((at, line))
        at += len((line + end).encode(encoding.replace("-sig", "")))
    return out


def cut_lines(data, encoding, cuts, chunk):
    found = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        found += ranges.raw_lines(io.BytesIO(data), a, b, encoding, chunk)
    return [(at, lines.decode(raw, encoding)) for at, raw in found]


@pytest.mark.parametrize("encoding", SAMPLES)
def test_every_cut(encoding):
    data = SAMPLES[encoding]
    want = whole(data, encoding)
    for k in range(len(data) + 1):
        for chunk in (2, 4, 1 << 16):
            assert cut_lines(data, encoding, sorted({0, k, len(data)}), chunk) == want, (k, chunk)


def test_many_cuts():
    rng = random.Random(3)
    for _ in range(300):
        data = bytes(rng.choice(b"ab\r\n") for _ in range(rng.randint(0, 40)))
        cuts = sorted({0, len(data), *(rng.randint(0, len(data)) for _ in range(5))})
        assert cut_lines(data, "utf-8", cuts, rng.choice([1, 3, 100])) == whole(data, "utf-8")


def test_kept_bytes():
    """Bytes come back whether they can be decoded or not, also those whose text looks like a kept one."""
    rng = random.Random(5)
    for encoding in ("utf-8", "cp1252", "ascii", "iso-8859-1"):
        for _ in range(300):
            data = b"".join(rng.choice([b"a", b"\xff", b"\x81", "ä".encode(), "\U000f0041".encode(), b"\xf3\xb0", b"\n"]) for _ in range(rng.randint(0, 12)))
            assert lines.encode(lines.decode(data, encoding), encoding) == data
    assert lines.decode(b"a\xffb", "utf-8") == "a\U000f00ffb" and lines.encode("naïve", "ascii") == b"na?ve"


def test_files_in_ranges(spark, tmp_path):
    """Numbers, offsets and texts of files of all encodings, in ranges of a few bytes, and single lines read by offset."""
    for name, data in SAMPLES.items():
        (tmp_path / f"{name}.log").write_bytes(data)
    (tmp_path / "empty.log").write_bytes(b"")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", F.col("length").alias("size"))
    told = ranges.with_encoding(files).collect()
    assert {r["path"].rsplit("/", 1)[-1].removesuffix(".log"): r["encoding"] for r in told if r["size"]} == {n: n for n in SAMPLES}
    files = spark.createDataFrame(told, "path string, size long, encoding string")
    for size in (3, 7, 1 << 20):
        rows = ranges.read(files, size).collect()
        for name, data in SAMPLES.items():
            got = sorted((r["line_no"], r["offset"], r["text"]) for r in rows if r["source_id"].endswith(f"/{name}.log"))
            assert got == [(k, at, text) for k, (at, text) in enumerate(whole(data, name), 1)]
    marked = spark.createDataFrame([(k, r["source_id"], r["line_no"], r["offset"], 1) for k, r in enumerate(rows)], "event_id long, source_id string, line_no long, offset long, lines int")
    marked = marked.join(files.select(F.col("path").alias("source_id"), "encoding"), "source_id")
    found = ranges.around(marked, 2, 1, chunk=4).collect()
    for k, r in enumerate(rows):
        near = sorted((x["line_no"], x["text"]) for x in rows if x["source_id"] == r["source_id"] and -2 <= x["line_no"] - r["line_no"] <= 1)
        assert sorted((x["line_no"], x["text"]) for x in found if x["event_id"] == k) == near


def test_a_large_file_takes_many_tasks(spark, tmp_path):
    """Ranges are dealt to tasks of their own, however small their rows are."""
    with (tmp_path / "big.log").open("wb") as out:
        for k in range(200_000):
            out.write(b"%d line of a log\n" % k)
    files = ranges.with_encoding(spark.read.format("binaryFile").load(str(tmp_path)).select("path", F.col("length").alias("size")))
    found = ranges.read(files, 1 << 19)
    assert found.where("text <> concat(line_no - 1, ' line of a log')").count() == 0 and found.count() == 200_000
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def test_small_ranges_share_tasks_and_read_little(spark, tmp_path):
    data = b"".join(b"%d line of a log\n" % k for k in range(50_000))
    read = []

    class Counted(io.BytesIO):
        def read(self, size=-1):
            read.append(size)
            return super().read(size)

    assert sum(1 for _ in ranges.raw_lines(Counted(data), 8192, 12288, "utf-8")) > 100
    assert sum(read) < 4 * 4096
    (tmp_path / "big.log").write_bytes(data)
    files = ranges.with_encoding(spark.read.format("binaryFile").load(str(tmp_path)).select("path", F.col("length").alias("size")))
    cut = ranges.ranges(files, 1024)
    assert cut.count() > 900 and cut.rdd.getNumPartitions() <= 64
    found = ranges.read(files, 1024)
    assert found.where("text <> concat(line_no - 1, ' line of a log')").count() == 0 and found.count() == 50_000

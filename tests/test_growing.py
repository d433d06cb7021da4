"""Growing copies by digests of beginnings, against a comparison of all pairs, and how many digests they take."""

import random

import pytest
from pyspark.sql import functions as F

from logquarry.operators import growing


def brute(texts):
    want = {}
    for k, t in enumerate(texts):
        longer = [(len(u), j) for j, u in enumerate(texts) if len(u) > len(t) >= growing.START and u.startswith(t)]
        if longer:
            want[k] = max(longer)[1]
    return want


def tree(rng, n, base, spread):
    """Logs that grow from each other: some go on, some branch, some are copied again."""
    out = [base]
    while len(out) < n:
        of = rng.choice(out[-20:])
        cut = rng.choice([len(of), rng.randint(400, len(of))])
        out.append(of[:cut] + bytes(rng.randrange(4) for _ in range(rng.choice([0, rng.randint(0, spread)]))))
    return out


@pytest.mark.parametrize("cuts, seed", [(3, 1), (32, 2)])
def test_against_all_pairs(spark, monkeypatch, cuts, seed):
    monkeypatch.setattr(growing, "CUTS", cuts)
    rng = random.Random(seed)
    texts = tree(rng, 110, bytes(rng.randrange(4) for _ in range(600)), 900) + [b"", b"x" * 511, b"x" * 512, b"x" * 513, b"x" * 512]
    files = spark.createDataFrame([(k, bytearray(t), len(t)) for k, t in enumerate(texts)], "file_id long, content binary, size long")
    got = {r["file_id"]: r["longest"] for r in growing.growing_copies(files, growing.of_contents(files)).collect()}
    assert got == brute(texts)
    nothing = files.limit(0)
    assert growing.growing_copies(nothing, growing.of_contents(nothing)).collect() == []


def test_few_digests(spark, tmp_path):
    """300 files of one header, each a beginning of the last, in one rung: some 21 digests a file, where all pairs take 150."""
    rng = random.Random(7)
    whole = bytes(rng.randrange(256) for _ in range(2048))
    sizes = rng.sample(range(1024, 2047), 299) + [2047]
    for k, size in enumerate(sizes):
        (tmp_path / f"{k}.log").write_bytes(whole[:size])
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.col("path").alias("file_id"), F.col("length").alias("size"))
    rounds = []
    found = growing.growing_copies(files, seen=lambda wanted: rounds.append(wanted.agg(F.sum(F.size("lengths"))).first()[0])).collect()
    assert len(found) == 299 and all(r["longest"].endswith("/299.log") for r in found)
    assert sum(rounds) < 300 * 30 and len(rounds) <= 3

"""Periodic runs against a search over every period."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from logquarry.llm import periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """Every run as (start, length, period): for each period the stretches that agree with themselves moved by it."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            if length >= max(6, 4 * q) and all(words[s : s + length - r] != words[s + r : s + length] for r in range(1, q)):
                found.append((s, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return [w for k, w in enumerate(words) if k not in gone]


def altered(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def found(rows):
    return [tuple(map(int, r)) for r in rows]


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_those_of_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(700):
        words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 50))]
        if rng.random() < 0.6:
            root = [b"%d" % rng.randrange(6) for _ in range(rng.randint(1, 8))]
            words = words[: rng.randint(0, len(words))] + root * rng.randint(2, 7) + root[: rng.randint(0, len(root))] + words
        assert found(periodic_runs.runs_of(words)) == brute_runs(words), words


def test_stretches_in_many_trees(monkeypatch):
    """Runs far apart, put into one tree or into several."""
    rng = random.Random(9)
    words = []
    for k in range(60):
        words += [b"u%d_%d" % (k, j) for j in range(rng.randint(0, 9))] + [b"%d" % rng.randrange(3) for _ in range(rng.randint(1, 4))] * rng.randint(2, 9)
    want = brute_runs(words)
    for size in (1, 40, 10**6):
        monkeypatch.setattr(periodic_runs, "TREE_WORDS", size)
        assert found(periodic_runs.runs_of(words)) == want


def test_agreement_and_order():
    """Common prefixes and both orders of suffixes, where the end comes first in each."""
    import numpy as np

    rng = random.Random(2)
    for n in (1, 2, 7, 60, 300):
        symbols = [rng.randint(1, 3) for _ in range(n)]
        tree = periodic_runs.SuffixTree(np.array(symbols))
        ends = [symbols[i:] for i in range(n + 1)]
        pairs = [(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]
        shared = [next((k for k in range(min(len(ends[i]), len(ends[j]))) if ends[i][k] != ends[j][k]), min(len(ends[i]), len(ends[j]))) for i, j in pairs]
        assert tree.agreement(*map(np.array, zip(*pairs, strict=True))).tolist() == shared
        for rank, key in ((tree.rank, lambda i: ends[i]), (tree.other_rank(), lambda i: [-x for x in ends[i]])):
            assert np.argsort(rank).tolist() == sorted(range(n + 1), key=key)


def test_rows(spark, docs, empty):
    got = {}
    for r in periodic_runs.periodic_runs(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    want = {}
    for r in docs.select("doc_id", "text").collect():
        words = WORD.findall(r["text"] or "")
        runs = brute_runs(words) if len(words) < 2000 else found(periodic_runs.runs_of([w.encode() for w in words]))
        want.setdefault(r["doc_id"], []).append((len(words), runs, " ".join(kept_words(words, runs))))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert periodic_runs.periodic_runs(empty).collect() == []


def test_query_on_all_documents(spark, tmp_path):
    """What the contract asks for, over whole short texts of the smallest table and odd rows."""
    folder = "/root/testdata/sf0.001"
    odd = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate([None, "", " \t\n", *["a b " * 9, "x " * 7 + "y " * 6, "ü é a " * 5, "\x1c \x85 " * 8] * 9])], "doc_id long, text string")
    table = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").where(F.length("text") < 4000).unionByName(odd)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r.asDict() for r in periodic_runs.op11_periodic_runs(spark, str(tmp_path)).collect()}
    rows = table.collect()
    assert len(rows) == len(got)
    for r in rows:
        words = altered(r["doc_id"], WORD.findall(r["text"] or ""))
        runs = brute_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
        want = {"doc_id": r["doc_id"], "n_runs": len(runs)}
        want |= dict(zip(("start", "length", "period"), best or (None,) * 3, strict=True))
        want["exponent_milli"] = 1000 * best[1] // best[2] if best else None
        want["runs_sha256"] = digest("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        want["collapsed_sha256"] = digest(" ".join(kept_words(words, runs)))
        assert got[r["doc_id"]] == want
    assert sum(r["n_runs"] > 0 for r in got.values()) > 20

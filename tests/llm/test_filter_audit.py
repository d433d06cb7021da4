"""The audit of filters against a replay of every order over single documents."""

import collections
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from logquarry.llm import filter_audit
from logquarry.llm.shared import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failed(text, doc_id, first):
    words = WORD.findall(text)
    out = {"A"} if len(words) < 200 else set()
    out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
    out |= {"D"} if re.search(r"[#$%&*|]", text) else set()
    return out | ({"E"} if doc_id is not None and first.get(text, doc_id) < doc_id else set())


def replay(rows, labels):
    """Counts by part, order and step; ``rows`` are (doc_id, text, lang), ``labels`` (doc_id, quality, toxic)."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    parts = collections.defaultdict(list)
    for i, text, lang in rows:
        parts[lang or ""].append((failed(text or "", i, first), i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = collections.Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f]
        for (p, _, _), row in out.items():
            if p == part:
                row[-1] = shapley[row[-1]]
    return out


@pytest.fixture(scope="module")
def odd(docs, spark):
    """The odd rows with several parts, a null part, null and repeated labels."""
    rng = random.Random(4)
    rows = [(r["doc_id"], r["text"], rng.choice(["en", "de", None, ""])) for r in docs.select("doc_id", "text").collect()]
    rows += [(500 + k, " ".join(rng.choice(["Ab", "c", "d$", "e", "f%d" % rng.randrange(400)]) for _ in range(rng.choice([150, 250]))), rng.choice(["en", "fr"])) for k in range(60)]
    rows += [(600 + k, rows[rng.randrange(len(rows))][1], "fr") for k in range(40)]
    labels = [(rng.choice([None, *range(-3, 40), *range(500, 640)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(150)]
    table = spark.createDataFrame([(i, t, g, "x", 1) for i, t, g in rows], "doc_id long, text string, lang string, part string, good int").repartition(5)
    return rows, labels, table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_counts_of_every_order(odd, monkeypatch, size):
    rows, labels, table, marks = odd
    monkeypatch.setattr(filter_audit, "RANGE_ROWS", size)
    postings = written(filter_audit.posting_lists(written(filter_audit.measured(table), "test-flags"), marks), "test-postings")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in filter_audit.audit(postings).collect()}
    assert got == replay(rows, labels)


def test_empty_tables(odd, empty):
    _, _, table, marks = odd
    nothing = filter_audit.posting_lists(filter_audit.measured(empty), marks)
    assert filter_audit.audit(nothing).collect() == []
    unlabelled = filter_audit.posting_lists(written(filter_audit.measured(table), "test-flags"), marks.limit(0))
    assert filter_audit.audit(unlabelled).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)


def test_sorted_lists():
    rng = random.Random(1)
    for _ in range(300):
        one, two = (np.array(sorted(rng.sample(range(60), rng.randint(0, 40))), np.int64) for _ in range(2))
        assert filter_audit.without(one, two).tolist() == sorted({*one.tolist()} - {*two.tolist()})
        assert filter_audit.common(one, two) == len({*one.tolist()} & {*two.tolist()})


def test_query_is_its_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for name in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    found = filter_audit.op12_filter_audit(spark, folder)
    want = duck.execute(f"SELECT {', '.join(found.columns)} FROM ({filter_audit.ORACLES['op12_filter_audit']})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)

"""Visits of other shards grow in proportion to the sets, and what they leave out is still linked."""

import random

from test_similar import check

from logquarry.llm import simhash


def visiting_rows(spark, monkeypatch, n):
    """Rows that ``n`` sets of random fingerprints become on their way to the shards, and those of them at home."""
    rng, seen = random.Random(n), []
    rows = [(k, rng.getrandbits(64) - (1 << 63), rng.randint(50, 500)) for k in range(n)]
    sets = spark.createDataFrame(rows, "fp long, mark long, n int").repartition(2)
    group = type(sets).groupBy

    def kept(df, *keys):
        if "shard" in keys:
            seen.append(df)
        return group(df, *keys)

    with monkeypatch.context() as patched:
        patched.setattr(type(sets), "groupBy", kept)
        simhash.sized_pairs(sets, 12)
    return seen[0].count(), seen[0].where("home").count()


def test_rows_in_proportion_to_sets(spark, monkeypatch):
    """Five times the sets, in five times the shards, are about five times the rows."""
    monkeypatch.setattr(simhash, "WIDE_ROWS", 100)
    monkeypatch.setattr(simhash, "WIDE_FREE", 0, raising=False)
    (small, home), (large, more) = visiting_rows(spark, monkeypatch, 800), visiting_rows(spark, monkeypatch, 4000)
    assert (home, more) == (800, 4000)
    assert large <= 6 * 4000 and large <= 7 * small


def test_nothing_is_lost_on_narrow_ways(spark, monkeypatch):
    """Near copies, most of them in other leaves than their like, are all linked where sets stay in their own leaf."""
    monkeypatch.setattr(simhash, "WIDE_ROWS", 4)
    monkeypatch.setattr(simhash, "WIDE_FREE", 0, raising=False)
    monkeypatch.setattr(simhash, "WIDE_VISITS", 2, raising=False)
    rng, texts = random.Random(3), []
    for g in range(20):
        words = [f"w{g}x{k}" for k in range(rng.randint(20, 90))]
        for _ in range(12 if g == 0 else 3):
            words = list(words)
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))

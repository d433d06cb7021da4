"""Language profiles: windows and bundles against plain Python, held-out accuracy, odd rows."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logquarry.llm import language_id

FOLDER = "/root/testdata/sf0.01"


def plain_windows(text):
    """Windows of three code points; what isn't a letter is one gap, with a gap at both ends."""
    points = [ord(c) if c.isalpha() else 0 for c in f" {(text or '').lower()} "]
    points = [p for k, p in enumerate(points) if p or k == 0 or points[k - 1]]
    return collections.Counter(tuple(points[k - 1 : k + 2]) for k in range(1, len(points) - 1) if points[k])


def plain_vector(text):
    out = np.zeros(language_id.SIZE)
    for window, times in plain_windows(text).items():
        out += times * np.prod([np.roll(language_id.letter_vector(p).astype(int), language_id.WINDOW - 1 - k) for k, p in enumerate(window)], axis=0)
    return out


def test_windows_and_bundles():
    rng = random.Random(8)
    alphabet = "aäBİß \n1.…語漢\U0001d4d0ǅ'"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", "7 !", "a", "\n\n", "é\n"]
    for some in (texts, texts[:1], [None], ["", ""], ["x"]):
        docs, windows, times = language_id.window_counts(some)
        got = [collections.Counter() for _ in some]
        for d, w, n in zip(docs.tolist(), windows.tolist(), times.tolist(), strict=True):
            got[d][w >> 42, w >> 21 & 0x1FFFFF, w & 0x1FFFFF] = n
        assert got == [plain_windows(t) for t in some]
        assert (language_id.document_vectors(some) == [plain_vector(t) for t in some]).all()


def test_many_windows(monkeypatch):
    """Vectors don't depend on how many windows are bound at a time."""
    texts = ["der Hund und die Katze", "the dog and the cat", ""]
    want = language_id.document_vectors(texts)
    monkeypatch.setattr(language_id, "BOUND_WINDOWS", 3)
    assert (language_id.document_vectors(texts) == want).all()


def test_profiles_do_not_depend_on_tasks(spark, docs, monkeypatch):
    table = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "de").when(F.col("doc_id") % 3 == 1, "en"))
    names, vectors = language_id.profiles(table.repartition(1))
    monkeypatch.setattr(language_id, "HELD_WINDOWS", 1)
    again, others = language_id.profiles(table.repartition(7))
    assert names == again == ["de", "en"] and (vectors == others).all()


def test_profile_is_the_sum_of_its_documents(spark):
    rows = [("de", "der Hund"), ("de", "und die Katze"), ("en", "the dog"), ("xx", "123"), (None, "le chien"), ("fr", None)]
    sums = language_id.language_sums(spark.createDataFrame(rows, "lang string, text string"))
    got = {(r["lang"], r["place"]): int(r["total"]) for r in sums.collect() if r["total"]}
    want = collections.Counter()
    for lang, text in rows[:3]:
        n = sum(plain_windows(text).values())
        for window, times in plain_windows(text).items():
            signs = np.prod([np.roll(language_id.letter_vector(p).astype(int), 2 - k) for k, p in enumerate(window)], axis=0)
            for place, sign in enumerate(signs.tolist()):
                want[lang, place] += sign * round(times * language_id.WEIGHT / n)
    assert got == {k: v for k, v in want.items() if v}
    assert language_id.profiles(spark.createDataFrame(rows, "lang string, text string"))[0] == ["de", "en"]


def test_odd_rows(docs, empty):
    table = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "de").otherwise("en"))
    names, vectors = language_id.profiles(table)
    found = language_id.identify(docs, names, vectors).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    assert all(0 <= r["score"] <= 1 for r in found)
    assert {r["doc_id"]: r["lang_pred"] for r in found if r["doc_id"] in (-1, -2, -3)} == {-1: "und", -2: "und", -3: "und"}
    assert {r["lang_pred"] for r in found} <= {"de", "en", "und"}
    assert language_id.identify(empty, names, vectors).collect() == []
    names, vectors = language_id.profiles(empty)
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(docs, names, vectors).collect()} == {("und", 0.0)}
    one = language_id.profiles(table.where("lang = 'de'"))
    assert {r["lang_pred"] for r in language_id.identify(docs, *one).collect()} == {"de", "und"}


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="2 languages"):
        language_id.profiles(spark.createDataFrame([(x, "text") for x in "abc"], "lang string, text string"))


def test_held_out_accuracy(spark):
    """Languages of documents that weren't learned from, told by their text alone."""
    found = {r["doc_id"]: r for r in language_id.op13_language_id(spark, FOLDER).collect()}
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()
    assert len(found) == len(rows)
    assert all(found[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if found[r["doc_id"]]["held_out"]]
    assert sum(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)

"""Each operator against brute force on a small table with every odd row."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logquarry.llm import bpe, decontaminate, language_model, pii, quality_model, quality_rules, simhash, substrings, token_counts, token_files
from logquarry.llm.shared import shared_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def fingerprint(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, marks, reach=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(marks[i] ^ marks[j]).count("1") <= reach:
                root[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(ids))]


def test_simhash(docs):
    rows = pairs(docs)
    marks = [fingerprint(t) for _, t in rows]
    want = [(i, m, c) for (i, _), m, c in zip(rows, marks, classes([i for i, _ in rows], marks), strict=True)]
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert ordered(got) == ordered(want)


def test_simhash_near_fingerprints(spark, monkeypatch):
    """Clusters of fingerprints a few bits apart, in many shards."""
    rng = np.random.default_rng(3)
    points = []
    for _ in range(60):
        base = int(rng.integers(0, 1 << 63))
        for _ in range(rng.integers(1, 12)):
            base ^= 1 << int(rng.integers(64))
            points.append(base if rng.random() < 0.8 else int(rng.integers(0, 1 << 63)))
    points = sorted(set(points))
    monkeypatch.setattr(simhash, "SHARD_ROWS", 12)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in points], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash._shard_links(df, len(points))).collect()}
    signed = [int(np.uint64(p).astype(np.int64)) for p in points]
    got = collections.defaultdict(set)
    for s in signed:
        got[found.get(s, s)].add(s)
    want = collections.defaultdict(set)
    for s, c in zip(signed, classes(list(range(len(points))), points), strict=True):
        want[c].add(s)
    assert ordered(map(sorted, got.values())) == ordered(map(sorted, want.values()))


def test_keep_one(docs):
    rows = pairs(docs)
    marks = [fingerprint(t) for _, t in rows]
    want = {c for c in classes([i for i, _ in rows], marks)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want)


def test_token_files(docs, spark):
    tokenizer = Tokenizer.from_file(token_files.default_vocabulary())
    folder = shared_path(spark, "test-tokens")
    files = token_files.write_tokens(docs, folder)
    read = token_files.read_tokens(spark, folder).join(token_files.file_starts(files), ["part", "seq"])
    got = [(r["file_start"] + r["first"], r["doc_id"], r["ids"]) for r in read.collect()]
    rows = sorted(pairs(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, at = [], 0
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, token_files.END_ID]
        want.append((at, i, ids))
        at += len(ids)
    assert sorted(got) == want


@pytest.mark.parametrize("bits", [1, 8])
def test_planes(bits):
    ids = np.random.default_rng(1).integers(0, 1 << 32, 140_001, dtype=np.uint64).astype(np.uint32)
    file = token_files.TokenFile(token_files.file_bytes([5, None], np.array([70_000, 70_001]), ids, bits))
    assert (file.read(0, len(ids)) == ids).all() and (file.read(65_530, 65_540) == ids[65_530:65_540]).all() and file.doc_ids == [5, None]
    with pytest.raises(ValueError):
        token_files.TokenFile(b"cut off")


def test_length_histogram(docs):
    tokenizer = Tokenizer.from_file(token_files.default_vocabulary())
    lengths = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in pairs(docs)]
    hist = token_counts.histogram(token_counts.token_lengths(docs))
    want = [(x, lengths.count(x), sum(y >= x for y in lengths), sum(y for y in lengths if y >= x), sum(y <= x for y in lengths), sum(lengths), sum(min(x, y) for y in lengths)) for x in set(lengths)]
    assert ordered(hist.collect()) == ordered(want)
    assert {r["context"]: r["tokens"] for r in token_counts.truncated_totals(hist, [0, 7, 10**6]).collect()} == {c: sum(min(c, y) for y in lengths) for c in (0, 7, 10**6)}
    assert [r["n_tokens"] for r in token_counts.quantiles(hist, [0.5, 1.0]).orderBy("share").collect()] == [sorted(lengths)[math.ceil(len(lengths) / 2) - 1], max(lengths)]


def test_substrings(docs, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_CHARS", 3000)
    rows = [(i, WORD.findall(t or "")) for i, t in pairs(docs)]
    first = {}
    for i, words in rows:
        for k in range(len(words) - 12):
            if i is not None:
                key = tuple(words[k : k + 13])
                first[key] = min(i, first.get(key, i))
    want = []
    for i, words in rows:
        gone = {j for k in range(len(words) - 12) if i is not None and first[tuple(words[k : k + 13])] < i for j in range(k, k + 13)}
        want.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert ordered(substrings.without_repeats(docs).collect()) == ordered(want)


def test_decontamination(docs, spark):
    items = [(1, "P3 p4 p5 p6 p7 p8 p9 p10 P11 p12"), (2, "p3 p4 p5 p6 p7 p8 p9 q q q q q q"), (3, "seven"), (4, None), (5, ""), (None, "p1 p2 p3 p4 p5 p6"), (6, "text of seven"), (6, "p1 p2 p3 p4 p5 p6")]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    want = {}
    for i, text in pairs(docs):
        for j, item in items:
            b = WORD.findall(lower(item or ""))
            k = min(5, len(b))
            if i is None or j is None or not b:
                continue
            a = WORD.findall(lower(text or ""))
            grams = {tuple(b[x : x + k]) for x in range(len(b) - k + 1)}
            shared = len(grams & {tuple(a[x : x + k]) for x in range(len(a) - k + 1)})
            if shared * 100 >= len(grams) * 80:
                want[i, j] = max(want.get((i, j), (0,)), (shared / len(grams), shared, len(grams)))
    got = decontaminate.contained_items(docs, table).collect()
    assert ordered((r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in got) == ordered((i, j, s, n) for (i, j), (_, s, n) in want.items())
    assert decontaminate.contained_items(docs, table.limit(0)).count() == 0
    kept = decontaminate.keep_clean(docs, table)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in pairs(docs)} - {i for i, _ in want}


def test_personal_data(docs, spark):
    texts = ["mail a.b@c.example.org now", "+1 (743) 555-3824 190.137.223.20", "4539578763621486 4111111111111111", 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" x', "no 999.1.1.1 and 12345, 4111111111111112", None, ""]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: [(s["kind"], s["base"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"]] for r in pii.find(df).collect()}
    assert got[0] == [("email", True, "a.b@c.example.org")]
    assert ("phone", False, "+1 (743) 555-3824") in got[1] and ("ip", True, "190.137.223.20") in got[1]
    assert got[2] == [("card", False, "4539578763621486"), ("card", False, "4111111111111111")]
    assert got[3] == [("secret", False, "9b0b3c6a43eb78aa99cbd7049c572391524f37a8")]
    assert got[4] == got[5] == got[6] == []
    masked = {r["doc_id"]: r for r in pii.mask(df).collect()}
    assert masked[0]["text"] == "mail [EMAIL] now" and masked[0]["n_chars"] == 16 and masked[5]["text"] is None
    assert pii.find(docs).count() == docs.count()


def test_field_windows():
    field = pii.Field(*pii.train())
    whole = pii.Field(*pii.train())
    whole.windowed = False
    texts = [" ".join(words) for words, _ in pii.training_table(60, seed=5)]
    assert field.windowed and pii.find_spans(texts, field) == pii.find_spans(texts, whole)
    lines = pii.training_table(100, seed=77)
    right = sum([pii.LABELS[k] for k in field.decode([words])[0]] == labels for words, labels in lines)
    assert right >= 97


def test_quality_rules(docs):
    def brute(text):
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)

    got = quality_rules.quality_measures(docs)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert ordered(got.select(*columns).collect()) == ordered((i, *brute(t)) for i, t in pairs(docs))
    assert got.where("kept and base_failed").count() == 0
    assert quality_rules.keep_good(docs).count() == got.where("kept").count()


def test_bpe(docs):
    tokenizer = Tokenizer.from_file(bpe.default_vocabulary())
    want = []
    for i, text in pairs(docs):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((i, ids, tokenizer.decode(ids, skip_special_tokens=False)))
    got = bpe.decode(bpe.encode(docs))
    assert ordered((r["doc_id"], list(r["ids"]), r["decoded"]) for r in got.collect()) == ordered(want)
    assert {r["ids_sha256"] for r in bpe.digests(got).collect()} == {hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for _, ids, _ in want}


def test_language_model(docs):
    rows = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in pairs(docs)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, words in rows if not held(i) for w in words)
    n, v = sum(counts.values()), len(counts)
    want = [(i, held(i), len(words), sum(counts[w] > 0 for w in words), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 6)) for i, words in rows]
    got = language_model.score(docs).collect()
    assert ordered((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == ordered(want)
    assert all(r["score"] < 0 for r in got)


def test_quality_model(spark):
    good = [(k, "plain words of a text that goes on and on in many different ways " + "abcdefg"[k % 7] * (k % 9), 1) for k in range(150)]
    bad = [(1000 + k, "buy*** now$$$ " * (k % 20 + 3), 0) for k in range(60)]
    rows = good + bad + [(5000, None, None), (5001, "", None), (None, "x", 1)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_model.classify(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert all(got[i]["predicted"] == y for i, _, y in good + bad if got[i]["held_out"])
    assert quality_model.classify(docs, labels.limit(0)).count() == len(rows)


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for made in (simhash.near_duplicates(empty), simhash.keep_one(empty), substrings.without_repeats(empty), quality_rules.quality_measures(empty), bpe.decode(bpe.encode(empty)), language_model.score(empty), pii.find(empty), quality_model.classify(empty, labels), token_counts.histogram(token_counts.token_lengths(empty)), token_files.write_tokens(empty, shared_path(spark, "none"))):
        assert made.count() == 0

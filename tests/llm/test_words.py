"""Words, pieces and token files against the library and plain Python."""

import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from logquarry.llm import language_model, token_files
from logquarry.llm.shared import shared_path

ODD = [chr(c) for c in range(0x260)] + list("''''stremvld0123  ") + ["ǅ", "ß", "é", "́", "²", "Ω", "İ", "<|endoftext|>", "'s", "'LL", "　"]


def odd_texts(n, most):
    rng = random.Random(3)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_word_encoder_is_the_library():
    encoder, library = token_files.word_encoder(token_files.default_vocabulary()), Tokenizer.from_file(token_files.default_vocabulary())
    for texts in (odd_texts(20_000, 14), [f"a{chr(c)}b {chr(c)}" for c in range(0x2000)], [None, ""], []):
        ids, lengths = encoder.encode(pa.array(texts, pa.string()))
        want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert lengths.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_checksums_of_files(docs, spark):
    """What op2 returns: start, number and checksum of each document's ids, in ascending id order."""
    library = Tokenizer.from_file(token_files.default_vocabulary())
    folder = shared_path(spark, "test-ids")
    files = token_files.write_tokens(docs, folder)
    read = token_files.read_checksums(spark, folder).join(token_files.file_starts(files), ["part", "seq"])
    got = sorted((r["file_start"] + r["first"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read.collect())
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start = [], 0
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, token_files.END_ID]
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_numbered_words():
    for texts in (odd_texts(500, 9), ["", " ", "\t a"], []):
        words, codes, sizes = language_model.numbered_words(texts)
        want = [[*t.encode().lower().split(), language_model.END] for t in texts]
        assert sizes.tolist() == list(map(len, want)) and [words[k] for k in codes] == [w for x in want for w in x]


def test_probabilities_sum_to_one():
    """Over all words that were seen and one that wasn't, whatever the history."""
    rng = random.Random(1)
    words = [f"w{k}{rng.choice('abcdef')}".encode() for k in range(300)] + [language_model.END]
    counts = np.array([rng.randint(0, 50) for _ in words], np.int64)
    *_, summary = language_model._count_bucket([words], [language_model.pack_array(counts)])
    model = language_model.Model([summary])
    model.weights += np.random.default_rng(1).normal(size=model.weights.shape).astype(np.float32)
    shares = language_model._shares(model.weights, model.prior, np.array([[1, 2, 3]]))[0]
    seen = [k for k, c in enumerate(counts) if c or words[k] == language_model.END]
    classes = model.classes([words[k] for k in seen])
    inside = np.zeros(language_model.CLASSES)
    np.add.at(inside, classes, 10 ** model.within(classes, counts[seen]))
    shared = np.arange(language_model.OWN + 1, language_model.CLASSES)
    inside[shared] += 10 ** model.within(shared, np.zeros(len(shared)))
    assert abs(shares.sum() - 1) < 1e-5 and abs((shares * inside).sum() - 1) < 1e-4

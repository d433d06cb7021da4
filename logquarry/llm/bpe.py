"""BPE encoding and decoding with a table of distinct words.

Texts are split into the tokenizer's words. Each distinct word of the corpus is
encoded once, in the bucket it hashes to, and its ids return to the positions
where it stands. Decoding looks ids up in the table of pieces.
"""

from __future__ import annotations

import functools
import os
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.blocks import Codes, bucket_count, bucket_order, exchange, in_blocks, pack_array, pack_codes, pack_words, sorted_codes, unpack_array, unpack_codes, unpack_words
from logquarry.llm.shared import bucketed, give_back, id_and_text, table

#: How byte-level BPE splits a text (the public pattern of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(2)
def load(path: str):
    """The tokenizer in this process, without truncation, padding and threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.lru_cache(1)
def _unsettled() -> re.Pattern:
    """Matches code points whose category depends on the Unicode version of a library."""
    spans, start = [], None
    for c in range(0x558, sys.maxunicode + 2):
        open_ = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if open_ and start is None:
            start = c
        elif not open_ and start is not None:
            spans.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile(f"[{''.join(spans)}]")


#: The same split in the standard library's syntax, for the code points where both agree.
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Code points outside ASCII text and Latin letters.
_beyond_latin = re.compile("[\x1c-\x1f\x80-\xbf\u0250-\U0010ffff]").search
_beyond_settled = re.compile("[\u0558-\U0010ffff]").search


class Splitter:
    """Splits texts into keys: a word, or a special token marked by a first byte of 1."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.find = regex.compile(PATTERN).findall
        self.find_plain = re.compile(PLAIN_PATTERN).findall
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = set(special)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def words(self, text: str) -> list[str]:
        if not _beyond_latin(text):
            return self.find_plain(text)
        if _beyond_settled(text) and _unsettled().search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(text)

    def keys(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.words(text)
        keys: list[str] = []
        for piece in self.cut.split(text):
            keys += ["\x01" + piece] if piece in self.special else self.words(piece)
        return keys


@functools.lru_cache(1)
def _visible() -> dict[int, str]:
    """Byte-level tokenizers' character for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def word_ids(model, word: str) -> list[int]:
    """Ids of one word of a byte-level tokenizer, by the library's model alone: the word is split off already."""
    if not (word.isascii() and word.isprintable() and " " not in word):
        word = word.encode().decode("latin-1").translate(_visible())
    return [t.id for t in model.tokenize(word)]


def _is_special(key: str, special: set[str]) -> bool:
    return key[:1] == "\x01" and key[1:] in special


def _encode_bucket(path: str):
    def answer(lists: list[list[bytes]], _: list) -> list[bytes]:
        tokenizer = load(path)
        special = Splitter(path).special
        where = Codes()
        codes = [np.fromiter(map(where.__getitem__, words), np.int64, len(words)) for words in lists]
        distinct = [w.decode("utf-8") for w in where]
        plain = [w[1:] if _is_special(w, special) else w for w in distinct]
        model, ids = tokenizer.model, []
        for key, word in zip(distinct, plain, strict=True):
            ids.append([tokenizer.token_to_id(word)] if key is not word else word_ids(model, word))
        lengths = np.array([len(x) for x in ids], np.int64)
        flat = np.array([i for x in ids for i in x], np.uint32)
        starts = np.cumsum(lengths) - lengths
        out = []
        for c in codes:
            out.append(pack_array(np.concatenate([np.array([len(c)], np.uint32), lengths[c].astype(np.uint32), gather(flat, starts[c], lengths[c])])))
        return out

    return answer


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``flat[start:start+length]``, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(total)]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) for each input row, as the library encodes the text.

    Null and empty texts have no ids; a null id stays null; repeated rows are
    each encoded. Other columns aren't read. A special token's string in a text
    is that token, as the library has it by default.
    """
    path = path or default_vocabulary()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        splitter = Splitter(path)
        for block, ids, texts in in_blocks(batches):
            where, codes, sizes = Codes(), [], []
            for text in texts:
                keys = splitter.keys(text)
                codes.append(np.fromiter(map(where.__getitem__, keys), np.uint32, len(keys)))
                sizes.append(len(keys))
            words, coded = sorted_codes(where, codes, str.encode)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([pack_codes(coded)], pa.binary()), pa.array([pack_words(words)], pa.binary()), pa.array([len(words)], pa.int64())],
                ["block", "ids", "sizes", "codes", "words", "n_words"],
            )

    blocks = id_and_text(docs, id_col, text_col).mapInArrow(split, "block long, ids array<long>, sizes array<int>, codes binary, words binary, n_words long")
    blocks = bucketed(blocks, "block", "bpe-blocks")
    buckets = bucket_count(blocks)
    answers = exchange(blocks, buckets, _encode_bucket(path))

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        ids, arrays = [], []
        for row in left.to_pylist():
            words = unpack_words(row["words"])
            order, _ = bucket_order(words, buckets)
            lengths, flat = np.zeros(len(words), np.int64), [np.zeros(0, np.uint32)]
            at = 0
            for bucket, payload in sorted(zip(right["bucket"].to_pylist(), right["payload"].to_pylist(), strict=True)):
                found = unpack_array(payload, np.uint32)
                n = int(found[0])
                lengths[order[at : at + n]] = found[1 : 1 + n]
                flat.append(found[1 + n :])
                at += n
            starts = np.zeros(len(words), np.int64)
            starts[order] = np.cumsum(lengths[order]) - lengths[order]
            codes = unpack_codes(row["codes"])
            each = lengths[codes]
            tokens = gather(np.concatenate(flat), starts[codes], each).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(each)])[np.cumsum([0, *row["sizes"]])]
            ids += row["ids"]
            arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens)))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "ids": pa.chunked_array(arrays, pa.list_(pa.int32()))})

    return blocks.drop("n_words").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assemble, "doc_id long, ids array<int>")


@functools.lru_cache(2)
def pieces(path: str) -> list[bytes]:
    """The bytes of each id, by id."""
    tokenizer = load(path)
    byte_of = {c: b for b, c in _visible().items()}
    out = []
    for k in range(tokenizer.get_vocab_size()):
        token = tokenizer.id_to_token(k) or ""
        out.append(bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode())
    return out


def joined(ids: pa.ListArray, known: pa.LargeBinaryArray) -> pa.StringArray:
    """The text of each list of ids, whose ``known`` pieces are put together in one buffer; bytes that aren't UTF-8 are replaced."""
    found = known.take(ids.flatten())
    ends = np.concatenate([[0], np.cumsum(np.nan_to_num(ids.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
    if not len(found):
        return pa.array([""] * len(ids), pa.string())
    _, offsets, data = found.buffers()
    offsets = np.frombuffer(offsets, np.int64)[found.offset : found.offset + len(found) + 1]
    texts = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets[ends]), data])
    try:
        return texts.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:  # the cast checks that all is UTF-8
        return pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (``doc_id``, ``ids``) with ``decoded``, the text of the ids; null ids decode to the empty text."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(pieces(path), pa.large_binary())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], joined(batch["ids"], known)], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(decode(encode(table(spark, sf_dir, "documents"))))


QUERIES = {"op9_bpe": op9_bpe}
ORACLES: dict[str, str] = {}

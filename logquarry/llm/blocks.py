"""Documents in blocks, and the exchange of a block's distinct keys against a global table.

Per-word joins over a whole corpus would shuffle every word occurrence. Here a
block of documents keeps its words as codes into its own dictionary, so only
distinct words of each block travel, packed by hash bucket; the answers return
to the block and are put in place by code. A word that fills a third of the
corpus is one entry of each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.shared import parts

#: Characters of text in a block; one document may exceed it and is then a block of its own.
BLOCK_CHARS = 4_000_000
#: Distinct words of blocks, counted once a block, that a bucket should hold.
BUCKET_WORDS = 400_000


def squeeze(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_words(words: list[bytes]) -> bytes:
    """Byte strings in one compressed value."""
    lengths = np.array([len(w) for w in words], np.uint32)
    return squeeze(np.uint32(len(words)).tobytes() + lengths.tobytes() + b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    raw = expand(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    starts = np.concatenate([[4 + 4 * n], ends[:-1]]) if n else []
    return [raw[a:b] for a, b in zip(list(starts), ends.tolist(), strict=True)]


def pack_array(values: np.ndarray) -> bytes:
    return squeeze(values.tobytes())


def unpack_array(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(expand(data), kind)


def pack_codes(codes: np.ndarray) -> bytes:
    """Unsigned 32-bit codes, byte plane by byte plane."""
    return pack_array(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def unpack_codes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack_array(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Codes(dict):
    """Numbers keys in the order they are first asked for."""

    def __missing__(self, key):
        self[key] = code = len(self)
        return code


def sorted_codes(where: dict, codes: list[np.ndarray], as_bytes: Callable = bytes) -> tuple[list[bytes], np.ndarray]:
    """The keys of ``where`` as sorted byte strings, which compress better, and all codes renumbered for them."""
    words = [as_bytes(k) for k in where]
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.empty(len(words), np.uint32)
    rank[order] = np.arange(len(words), dtype=np.uint32)
    return [words[k] for k in order], rank[np.concatenate(codes)] if words else rank


def in_blocks(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[int, list, list[str]]]:
    """(block, ids, texts) of the rows of one partition; null texts become empty.

    Block numbers hold the partition's number, so they are unique in a job.
    """
    first, most = TaskContext.get().partitionId() << 32, most or BLOCK_CHARS
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            text = text or ""
            if ids and size + len(text) > most:
                yield first, ids, texts
                first, ids, texts, size = first + 1, [], [], 0
            ids.append(i)
            texts.append(text)
            size += len(text) + 64
    if ids:
        yield first, ids, texts


def bucket_order(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of ``words`` by bucket, and where each bucket starts in them."""
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64) % np.uint64(buckets)
    order = np.argsort(hashes, kind="stable")
    return order, np.searchsorted(hashes[order], np.arange(buckets + 1, dtype=np.uint64))


def bucket_count(blocks: DataFrame) -> int:
    """Buckets for the written ``blocks``, so that each holds about ``BUCKET_WORDS`` words."""
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    return max(1, min(parts(blocks.sparkSession), total // 1000), total // BUCKET_WORDS)


def exchange(blocks: DataFrame, buckets: int, answer: Callable[[list[list[bytes]], list[bytes | None]], list[bytes]], values: str | None = None) -> DataFrame:
    """Rows (block, bucket, payload): what ``answer`` says to each block's words.

    ``blocks`` has ``block``, ``words`` (packed) and, if ``values`` names one, a
    packed int64 column aligned with the words. ``answer`` gets, for one bucket,
    the words and packed values of each block, and returns a payload for each;
    one payload more is the bucket's own and gets the block number -1.
    """
    taken = blocks.select("block", "words", *([values] if values else []))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = unpack_words(row["words"])
                order, starts = bucket_order(words, buckets)
                own = unpack_array(row[values], np.int64)[order] if values else None
                found: list[tuple[int, int, bytes, bytes | None]] = []
                for b in range(buckets):
                    low, high = starts[b], starts[b + 1]
                    if high > low:
                        found.append((b, row["block"], pack_words([words[k] for k in order[low:high]]), pack_array(own[low:high]) if values else None))
                if found:
                    b, k, w, v = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int64()), pa.array(w, pa.binary()), pa.array(v, pa.binary())], ["bucket", "block", "words", "vals"])

    def reduce(group: pa.Table) -> pa.Table:
        said = answer([unpack_words(x) for x in group["words"].to_pylist()], group["vals"].to_pylist())
        numbers, bucket = group["block"].to_pylist(), group["bucket"][0].as_py()
        numbers += [-1] * (len(said) - len(numbers))
        return pa.table({"block": pa.array(numbers, pa.int64()), "bucket": pa.array([bucket] * len(said), pa.int32()), "payload": pa.array(said, pa.binary())})

    rows = taken.mapInArrow(spread, "bucket int, block long, words binary, vals binary")
    return rows.groupBy("bucket").applyInArrow(reduce, "block long, bucket int, payload binary")

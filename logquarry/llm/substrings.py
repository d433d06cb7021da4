"""Substring dedup on a de Bruijn graph of words.

An edge is a window of ``WINDOW`` words, its nodes are the windows' first and
last ``WINDOW - 1`` words. Only edges that occur in two documents matter:

1. Whole copies of an earlier document are set aside by a digest of their words.
2. Windows are bundled by their minimizer, the smallest hash of the ``INNER``-word
   n-grams inside. Equal windows have equal minimizers, so windows whose minimizer
   stays in one document are unique and travel no further.
3. The other windows meet in buckets and learn their source coordinate: the
   place of their first occurrence, in the document with the smallest id.
4. Along a path that doesn't branch, place and source coordinate advance
   together. Each such run in a document is compacted to one row, and the rows
   of one source are joined on its coordinates, however many documents repeat it.
5. A compacted span is only believed if a digest of its words at the source,
   taken from the text there, equals the digest of its own words.

Blocks of documents hold their text in a table bucketed by block. What a block
asks or is told is packed by hash bucket, a key once for each block, so a
passage that fills a third of the corpus is a few entries of each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.arrays import IS_SPACE, slice_hashes
from logquarry.llm.blocks import expand, squeeze
from logquarry.llm.shared import bucketed, id_and_text, parts, table, written

WINDOW = 13
#: Words of the n-grams whose smallest hash bundles windows.
INNER = 8
BLOCK_CHARS = 2_000_000
#: Bits of a row number below the block's number, and of the block's number below the task's.
ROW_BITS = 20
SIDE = "block long, kind int, a long, b long, n long, payload binary"
COPIES, SHARED, SOURCES, SPANS = 1, 2, 3, 4


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any kinds in one compressed value."""
    return squeeze(b"".join(len(x := a.tobytes()).to_bytes(8, "little") + x for a in arrays), 1)


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    raw, at, out = expand(data), 0, []
    for kind in kinds:
        size = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw[at + 8 : at + 8 + size], kind))
        at += 8 + size
    return out


class Block:
    """The words of a block's documents, as places in one buffer where one space stands between words."""

    def __init__(self, ids: list, sizes: list[int], data: bytes):
        self.ids = ids
        raw = np.frombuffer(expand(data), np.uint8)
        ends = np.cumsum([s + 1 for s in sizes])  # a line feed ends each text
        space = IS_SPACE[raw]
        keep = ~space
        keep[1:] |= ~space[:-1]
        if len(keep):
            keep[0] = not space[0]
        place = np.concatenate([[0], np.cumsum(keep)])
        self.text = np.where(space, np.uint8(32), raw)[keep]
        gaps = self.text == 32
        self.ends = np.flatnonzero(gaps)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        #: Words before each document's first.
        self.first = np.concatenate([[0], np.searchsorted(self.ends, place[ends])]).astype(np.int64)
        self.bytes = self.text.tobytes()

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def span(self, low: int, high: int) -> bytes:
        """Words ``low`` to ``high`` of the block, joined by one space."""
        return self.bytes[self.starts[low] : self.ends[high - 1]] if high > low else b""

    def windows(self, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows inside documents that aren't skipped, the documents, and the words' hashes."""
        words = slice_hashes(self.text, self.starts, self.ends)
        doc = np.repeat(np.arange(len(self.ids)), self.counts())
        starts = np.arange(max(0, len(words) - WINDOW + 1))
        inside = (doc[starts] == doc[starts + WINDOW - 1]) & ~skip[doc[starts]]
        starts = starts[inside]
        return starts, doc[starts], words

    def minimizers(self, starts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """40 bits of the minimizer of each window."""
        n = max(0, len(words) - INNER + 1)
        grams = slice_hashes(words, np.arange(n), np.arange(n) + INNER)
        low = grams[starts]
        for k in range(1, WINDOW - INNER + 1):
            low = np.minimum(low, grams[starts + k])
        return low >> np.uint64(24)


def _nameless(block: Block) -> np.ndarray:
    return np.array([i is None for i in block.ids], bool)


def _skipped(block: Block, side: pa.Table) -> np.ndarray:
    """Documents without an id, and whole copies."""
    skip = _nameless(block)
    for payload in _payloads(side, COPIES):
        skip[_unpack(payload, np.int32)[0]] = True
    return skip


def _payloads(side: pa.Table, kind: int) -> list[bytes]:
    return [p for k, p in zip(side["kind"].to_pylist(), side["payload"].to_pylist(), strict=True) if k == kind]


def _blocks(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << ROW_BITS
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def flush():
            nonlocal block, size
            row = pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([squeeze(b"\n".join([*texts, b""]))], pa.binary())], ["block", "ids", "sizes", "data"])
            ids.clear()
            texts.clear()
            block, size = block + 1, 0
            return row

        for batch in batches:
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                text = (text or "").encode("utf-8", "replace")
                if ids and size + len(text) > BLOCK_CHARS:
                    yield flush()
                ids.append(i)
                texts.append(text)
                size += len(text) + 64
        if ids:
            yield flush()

    return bucketed(docs.mapInArrow(run, "block long, ids array<long>, sizes array<int>, data binary"), "block", "substrings-blocks")


def _each(left: pa.Table) -> Iterator[tuple[int, Block]]:
    for row in left.to_pylist():
        yield row["block"], Block(row["ids"], row["sizes"], row["data"])


def _spread(keys: np.ndarray, buckets: int, block: int, arrays: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    """(bucket, block, packed arrays) of the rows in each bucket; arrays are ordered by key already."""
    place = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(buckets + 1))
    return [(b, block, _pack(*[a[order[low:high]] for a in arrays])) for b, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if high > low]


ASKED = "bucket int, block long, payload binary"


def _asked(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    b, k, p = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"bucket": pa.array(b, pa.int32()), "block": pa.array(k, pa.int64()), "payload": pa.array(p, pa.binary())})


def _told(blocks: list[int], kind: int, payloads: list[bytes]) -> pa.Table:
    n = len(blocks)
    none = pa.array([None] * n, pa.int64())
    return pa.table({"block": pa.array(blocks, pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "a": none, "b": none, "n": none, "payload": pa.array(payloads, pa.binary())})


def _copies(blocks: DataFrame, buckets: int) -> DataFrame:
    """Side rows: documents whose words are those of a document with a smaller id."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, block in _each(pa.Table.from_batches([batch])):
                rows = [k for k in range(len(block.ids)) if block.ids[k] is not None and block.first[k + 1] > block.first[k]]
                digests = np.frombuffer(b"".join(xxhash.xxh128_digest(block.span(block.first[k], block.first[k + 1])) for k in rows), "S16") if rows else np.zeros(0, "S16")
                halves = np.frombuffer(digests.tobytes(), np.uint64).reshape(-1, 2)
                named = np.array([block.ids[k] for k in rows], np.int64)
                yield from _asked(_spread(halves[:, 0], buckets, number, [halves, named, np.array(rows, np.int32)])).to_batches()

    def tell(group: pa.Table) -> pa.Table:
        asked = [_unpack(p, np.uint64, np.int64, np.int32) for p in group["payload"].to_pylist()]
        least: dict[bytes, int] = {}
        keys = [[h.tobytes() for h in a[0].reshape(-1, 2)] for a in asked]
        for names, (_, ids, _) in zip(keys, asked, strict=True):
            for key, i in zip(names, ids.tolist(), strict=True):
                least[key] = min(least.get(key, i), i)
        blocks_, payloads = [], []
        for number, names, (_, ids, rows) in zip(group["block"].to_pylist(), keys, asked, strict=True):
            found = rows[np.array([least[k] for k in names], np.int64) < ids]
            if len(found):
                blocks_.append(number)
                payloads.append(_pack(found))
        return _told(blocks_, COPIES, payloads)

    return written(blocks.mapInArrow(ask, ASKED).groupBy("bucket").applyInArrow(tell, SIDE), "substrings-copies")


def _five(values: np.ndarray) -> np.ndarray:
    """The five low bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _from_five(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = raw.reshape(-1, 5)
    return wide.view("<u8").ravel().astype(np.uint64)


def _held(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The keys that the ordered ``known`` ones have, looked up one by one: a bucket has many blocks' keys, which mustn't cost all of ``known`` each."""
    return keys[known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys] if len(known) else keys[:0]


def _shared_minimizers(blocks: DataFrame, side: DataFrame, buckets: int) -> DataFrame:
    """Side rows: the block's minimizers that occur in two documents."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for number, block in _each(left):
            starts, doc, words = block.windows(_skipped(block, right))
            low = block.minimizers(starts, words)
            order = np.lexsort((doc, low))
            low, doc = low[order], doc[order]
            new = np.ones(len(low), bool)
            new[1:] = low[1:] != low[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(low)) - 1
            several = (doc[first] != doc[last]) if len(first) else np.zeros(0, bool)
            rows += _spread(low[first], buckets, number, [_five(low[first]), several])
        return _asked(rows)

    def tell(group: pa.Table) -> pa.Table:
        asked = [_unpack(p, np.uint8, bool) for p in group["payload"].to_pylist()]
        keys = [_from_five(a[0]) for a in asked]
        every = np.sort(np.concatenate(keys))
        twice = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *[k[a[1]] for k, a in zip(keys, asked, strict=True)]]))
        found = [_held(k, twice) for k in keys]
        return _told([b for b, f in zip(group["block"].to_pylist(), found, strict=True) if len(f)], SHARED, [_pack(_five(f)) for f in found if len(f)])

    return blocks.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(ask, ASKED).groupBy("bucket").applyInArrow(tell, SIDE)


def _sources(blocks: DataFrame, side: DataFrame, buckets: int) -> DataFrame:
    """Side rows: hashes of the block's windows that occur in two documents, with id, row and place of the first."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        shared = np.sort(np.concatenate([np.zeros(0, np.uint64), *[_from_five(_unpack(p, np.uint8)[0]) for p in _payloads(right, SHARED)]]))
        rows = []
        for number, block in _each(left):
            if not len(shared):
                continue
            starts, doc, words = block.windows(_skipped(block, right))
            low = block.minimizers(starts, words)
            at = np.minimum(np.searchsorted(shared, low), len(shared) - 1)
            some = shared[at] == low
            starts, doc = starts[some], doc[some]
            hashes = slice_hashes(words, starts, starts + WINDOW)
            named = np.array([i or 0 for i in block.ids], np.int64)[doc]
            order = np.lexsort((starts, doc, named, hashes))
            starts, doc, named, hashes = starts[order], doc[order], named[order], hashes[order]
            new = np.ones(len(hashes), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(hashes)) - 1
            several = (named[first] != named[last]) if len(first) else np.zeros(0, bool)
            place = (starts - block.first[doc])[first].astype(np.int32)
            rows += _spread(hashes[first] >> np.uint64(8), buckets, number, [hashes[first], named[first], doc[first].astype(np.int32), place, several])
        return _asked(rows)

    def tell(group: pa.Table) -> pa.Table:
        numbers = group["block"].to_pylist()
        asked = [_unpack(p, np.uint64, np.int64, np.int32, np.int32, bool) for p in group["payload"].to_pylist()]
        hashes, named, doc, place, several = (np.concatenate(c) for c in zip(*asked, strict=True))
        which = np.repeat(np.arange(len(asked)), [len(a[0]) for a in asked])
        row = (np.array(numbers, np.int64)[which] << ROW_BITS) | doc
        order = np.lexsort((place, row, named, hashes))
        new = np.ones(len(order), bool)
        new[1:] = hashes[order][1:] != hashes[order][:-1]
        head = order[new]
        group_of = np.cumsum(new) - 1
        ends = np.append(np.flatnonzero(new)[1:], len(order)) - 1
        repeated = (named[head] != named[order[ends]]) | (np.bincount(group_of, weights=several[order]) > 0)
        said = repeated[group_of]
        target, source, of = order[said], head[group_of[said]], which[order[said]]
        by = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[by], np.arange(len(asked) + 1))
        blocks_, payloads = [], []
        for k in range(len(asked)):
            t, s = target[by[cuts[k] : cuts[k + 1]]], source[by[cuts[k] : cuts[k + 1]]]
            if len(t):
                blocks_.append(numbers[k])
                payloads.append(_pack(hashes[t], named[s], row[s], place[s]))
        return _told(blocks_, SOURCES, payloads)

    return blocks.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(ask, ASKED).groupBy("bucket").applyInArrow(tell, SIDE)


PATHS = "block long, doc long, start long, n long, source_id long, source_row long, source_start long, digest binary"


def _paths(blocks: DataFrame, side: DataFrame) -> DataFrame:
    """Compacted runs of windows whose place and source coordinate advance together; ``n`` counts words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told = [_unpack(p, np.uint64, np.int64, np.int64, np.int32) for p in _payloads(right, SOURCES)]
        out: list[tuple] = []
        for number, block in _each(left):
            if not told:
                continue
            known, ids, rows, places = (np.concatenate(c) for c in zip(*told, strict=True))
            order = np.argsort(known)
            known, ids, rows, places = known[order], ids[order], rows[order], places[order]
            starts, doc, words = block.windows(_skipped(block, right))
            hashes = slice_hashes(words, starts, starts + WINDOW)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            named = np.array([i or 0 for i in block.ids], np.int64)[doc]
            some = (known[at] == hashes) & (ids[at] < named)
            starts, doc, at = starts[some], doc[some], at[some]
            new = np.ones(len(starts), bool)
            new[1:] = (np.diff(starts) != 1) | (np.diff(doc) != 0) | (np.diff(rows[at]) != 0) | (np.diff(places[at]) != 1)
            heads = np.flatnonzero(new)
            sizes = np.diff(np.append(heads, len(starts))) + WINDOW - 1
            for h, n in zip(heads.tolist(), sizes.tolist(), strict=True):
                s, d, a = int(starts[h]), int(doc[h]), at[h]
                out.append((number, d, s - int(block.first[d]), n, int(ids[a]), int(rows[a]), int(places[a]), xxhash.xxh128_digest(block.span(s, s + n))))
        columns = list(zip(*out, strict=True)) if out else [()] * 8
        return pa.table([pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.binary())], ["block", "doc", "start", "n", "source_id", "source_row", "source_start", "digest"])

    return written(blocks.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(run, PATHS), "substrings-paths")


def _verified(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """The paths whose words, read at the source coordinates, are their own."""
    asked = paths.select(F.shiftright("source_row", ROW_BITS).alias("block"), "source_row", "source_start", "n").distinct()

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, starts, sizes = (right[c].to_pylist() for c in ("source_row", "source_start", "n"))
        digests: list[bytes] = []
        if rows:
            for _, block in _each(left):
                for row, start, n in zip(rows, starts, sizes, strict=True):
                    low = int(block.first[row & ((1 << ROW_BITS) - 1)]) + start
                    digests.append(xxhash.xxh128_digest(block.span(low, low + n)))
        return pa.table({"source_row": pa.array(rows[: len(digests)], pa.int64()), "source_start": pa.array(starts[: len(digests)], pa.int64()), "n": pa.array(sizes[: len(digests)], pa.int64()), "digest": pa.array(digests, pa.binary())})

    sources = blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(read, "source_row long, source_start long, n long, digest binary")
    return paths.join(sources, ["source_row", "source_start", "n", "digest"])


def _prepare(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, side rows of whole copies, and the verified paths."""
    blocks = _blocks(id_and_text(docs, id_col, text_col))
    buckets = parts(docs.sparkSession)
    copies = _copies(blocks, buckets)
    shared = _shared_minimizers(blocks, copies, buckets)
    sources = _sources(blocks, copies.union(shared), buckets)
    paths = _paths(blocks, copies.union(sources))
    return blocks, copies, written(_verified(blocks, paths), "substrings-verified")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the kept words, joined by one space) for each input row.

    A word goes if a window of ``WINDOW`` words around it also starts in a
    document with a smaller id. Null and empty texts have no words. Rows without
    an id neither remove nor lose anything; rows that share an id don't remove
    each other's words. Other columns aren't read.
    """
    blocks, copies, paths = _prepare(docs, id_col, text_col)
    spans = paths.select("block", F.lit(SPANS).alias("kind"), F.col("doc").alias("a"), F.col("start").alias("b"), "n", F.lit(None).cast("binary").alias("payload"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for _, block in _each(left):
            counts = block.counts()
            gone = np.zeros(len(block.starts) + 1, np.int32)
            told = right.filter(pa.compute.equal(right["kind"], SPANS))
            low = block.first[told["a"].to_numpy()] + told["b"].to_numpy()
            np.add.at(gone, low, 1)
            np.add.at(gone, low + told["n"].to_numpy(), -1)
            lost = np.cumsum(gone[:-1]) > 0
            copied = _skipped(block, right) & ~_nameless(block) & (counts >= WINDOW)
            for k, i in enumerate(block.ids):
                a, b = int(block.first[k]), int(block.first[k + 1])
                if copied[k]:
                    out.append((i, b - a, b - a, ""))
                    continue
                away = int(lost[a:b].sum())
                if away:
                    at = np.flatnonzero(~lost[a:b]) + a
                    text = b" ".join([block.bytes[s:e] for s, e in zip(block.starts[at].tolist(), block.ends[at].tolist(), strict=True)])
                else:
                    text = block.span(a, b)
                out.append((i, b - a, away, text.decode()))
        ids, words, removed, kept = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    return blocks.groupBy("block").cogroup(copies.union(spans).groupBy("block")).applyInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified spans of documents that aren't whole copies: ``block``, ``doc`` (row there), ``start``, ``n``, ``source_id``, ``source_start``; words are counted from 0."""
    return _prepare(docs, id_col, text_col)[2].select("block", "doc", "start", "n", "source_id", "source_start")


def op4_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op4_debruijn": op4_debruijn}
ORACLES: dict[str, str] = {}

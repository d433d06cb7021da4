"""Token-id files with shuffled planes.

A file holds the ids of consecutive documents. They are cut into fixed-size
chunks; a chunk's ids, as 32-bit integers, are transposed into byte planes (or
bit planes), and each plane is compressed with zstandard by itself: high bytes
of ids are nearly constant and shrink to nothing. A footer has the chunk index,
so that any range of ids is read by decompressing only its chunks, and the
documents with their lengths.

    magic | planes of chunk 0 | planes of chunk 1 | ... | footer | footer length (8 bytes) | magic
    footer = zstandard of: plane bits, chunk size, ids, documents, chunks (int64 each),
             chunk offsets and plane lengths (int64), document ids, null flags, document lengths (int64)
"""

from __future__ import annotations

import functools
import json
import posixpath
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logquarry.llm.bpe import gather, load, word_ids
from logquarry.llm.shared import id_and_text, parts, shared_path, table, written

MAGIC = b"LQIDS\x00\x00\x01"
CHUNK_IDS = 1 << 16
#: Ids after which a new file is begun.
FILE_IDS = 1 << 22
END_ID = 2
#: Pieces, and whole words beyond Latin text, whose ids a Python worker remembers; then it begins anew.
REMEMBERED = 600_000
SLICE_CHARS = 4_000_000
#: Bytes of text that a range of document ids should hold.
RANGE_BYTES = 128 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The lower-case word tokenizers' form.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What a byte of a plain word is: part of a letter, a digit or anything else.
LETTER, DIGIT, OTHER = 0, 1, 2
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = LETTER
_CLASS[ord("0") : ord("9") + 1] = DIGIT


def plain_words(words: pa.Array) -> np.ndarray:
    """Mask of the words whose pieces are runs of letters, digits and runs of others.

    They hold ASCII and the letters U+00C0 to U+024F, but no apostrophe (which
    opens endings), no special token, no separator below the space, neither
    multiplication nor division sign, and no dotted capital I.
    """
    starts, data = _bytes_of(words)
    after = np.append(data[1:], np.uint8(0))
    odd = (data == 0x27) | ((data >= 0x1C) & (data < 0x20)) | ((data >= 0xC0) & ((data < 0xC3) | (data > 0xC9))) | ((data == 0xC9) & (after > 0x8F))
    odd |= ((data == 0xC3) & ((after == 0x97) | (after == 0xB7))) | ((data == 0xC4) & (after == 0xB0)) | ((data == ord("<")) & (after == ord("|")))
    return np.diff(np.concatenate([[0], np.cumsum(odd)])[starts]) == 0


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins (and the last one ends) and the bytes of all."""
    starts = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = words.buffers()[2]
    return starts - starts[0], np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data and data.size else np.zeros(0, np.uint8)


class WordEncoder:
    """Encodes texts for tokenizers that drop white space.

    Arrow splits a slice of texts into words and finds the distinct ones. For
    the usual lower-case tokenizer, it also splits distinct words of Latin
    letters into pieces, and only distinct pieces that aren't remembered go to
    the library's model; other words, and all words of other tokenizers, go
    through the whole library.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        form = json.loads(self.tokenizer.to_str())
        pieces = ((form["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.known_form = [n["type"] for n in (form["normalizer"] or {}).get("normalizers", [])] == _NORMALIZERS and pieces.get("pattern") == {"Regex": _PATTERN}
        # Words that hold "<|" aren't plain; a vocabulary with other special tokens goes through the library.
        self.known_form &= all(t["content"].startswith("<|") for t in form["added_tokens"])

    def _whole(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(words, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _model(self, pieces: list[str]) -> list[bytes]:
        model = self.tokenizer.model
        return [array("I", word_ids(model, p)).tobytes() for p in pieces]

    def _looked_up(self, keys: pa.Array, known: dict[str, bytes], make: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct keys, one after the other, and the number of ids of each."""
        if len(known) > REMEMBERED:
            known.clear()
        names = keys.to_numpy(zero_copy_only=False).tolist()
        found = list(map(known.get, names))
        missing = [k for k, x in enumerate(found) if x is None]
        fresh = [names[k] for k in missing]
        for k, name, x in zip(missing, fresh, make(fresh), strict=True):
            found[k] = known[name] = x
        return np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Like ``_looked_up``, by the words' pieces."""
        low = pa.compute.utf8_lower(words)
        starts, data = _bytes_of(low)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        kinds = _CLASS[data]
        heads = np.concatenate([[True], (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)])
        heads[starts[:-1][np.diff(starts) > 0]] = True
        cuts = np.append(np.flatnonzero(heads), len(data)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        flat, lengths = self._looked_up(coded.dictionary, self.pieces, self._model)
        codes = coded.indices.to_numpy()
        each = lengths[codes]
        sums, before = np.concatenate([[0], np.cumsum(each)]), np.concatenate([[0], np.cumsum(heads)])
        return gather(flat, (np.cumsum(lengths) - lengths)[codes], each), np.diff(sums[before[starts]])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        split = pa.compute.ascii_split_whitespace(pa.compute.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        where = plain_words(words) if self.known_form else np.zeros(len(words), bool)
        flat, lengths = self._plain(words.filter(pa.array(where)))
        others, sizes = self._looked_up(words.filter(pa.array(~where)), self.words, self._whole)
        # Plain words' ids come first in ``flat``, then the others'.
        flat, sizes = np.concatenate([flat, others]), np.concatenate([lengths, sizes])
        order = np.concatenate([np.flatnonzero(where), np.flatnonzero(~where)])
        lengths, starts = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        lengths[order], starts[order] = sizes, np.cumsum(sizes) - sizes
        codes, ends = coded.indices.to_numpy(), split.offsets.to_numpy()
        each = lengths[codes]
        sums = np.concatenate([[0], np.cumsum(each)])
        return gather(flat, starts[codes], each), np.diff(sums[ends - ends[0]])


@functools.lru_cache(1)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, whose words outlive a task."""
    return WordEncoder(path)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, at most ``SLICE_CHARS`` bytes of text at a time (or one row)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
    part = (np.cumsum(sizes) - sizes) // SLICE_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def to_planes(ids: np.ndarray, bits: int) -> np.ndarray:
    """The ids' planes as rows: bit k (or byte k) of every id, packed."""
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return raw.T if bits == 8 else np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    rows = np.array([np.frombuffer(p, np.uint8) for p in planes])
    if bits != 8:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n).T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


def file_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int = 8) -> bytes:
    """One file."""
    press = zstandard.ZstdCompressor(level=3)
    out, index, at = [MAGIC], [], len(MAGIC)
    for k in range(0, len(ids), CHUNK_IDS):
        planes = [press.compress(p.tobytes()) for p in to_planes(ids[k : k + CHUNK_IDS], bits)]
        index.append([at, *map(len, planes)])
        out += planes
        at += sum(map(len, planes))
    head = np.array([bits, CHUNK_IDS, len(ids), len(doc_ids), len(index)], np.int64)
    docs = np.array([[d or 0 for d in doc_ids], [d is None for d in doc_ids], lengths], np.int64)
    footer = press.compress(head.tobytes() + np.array(index, np.int64).tobytes() + docs.tobytes())
    return b"".join([*out, footer, len(footer).to_bytes(8, "little"), MAGIC])


class TokenFile:
    """Random access to the bytes of a file."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token file, or not a whole one")
        end = len(data) - len(MAGIC) - 8
        size = int.from_bytes(data[end : end + 8], "little")
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[end - size : end]), np.int64)
        self.data = data
        self.bits, self.chunk, self.n_ids, n_docs, n_chunks = (int(x) for x in raw[:5])
        width = 1 + 32 // self.bits
        self.index = raw[5 : 5 + n_chunks * width].reshape(n_chunks, width)
        ids, nulls, self.lengths = raw[5 + n_chunks * width :].reshape(3, n_docs)
        self.doc_ids = [None if null else int(d) for d, null in zip(ids, nulls, strict=True)]

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the file, from their chunks alone."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, got, press = start // self.chunk, [], zstandard.ZstdDecompressor()
        for k in range(first, (end - 1) // self.chunk + 1):
            at, *sizes = self.index[k].tolist()
            planes = []
            for size in sizes:
                planes.append(press.decompress(self.data[at : at + size]))
                at += size
            got.append(from_planes(planes, min(self.chunk, self.n_ids - k * self.chunk), self.bits))
        low = start - first * self.chunk
        return np.concatenate(got)[low : low + end - start]


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, bits: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` and write them to ``folder``, a URI all executors reach, in ascending id order.

    Returns the files: ``part``, ``seq``, ``n_docs``, ``n_ids``, ``path``. Null and empty
    texts have only the end id. Rows without an id come first; rows that repeat
    an id stand together, by text. A task that runs again writes the same files.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        encoder, part, seq = word_encoder(path), TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush():
            nonlocal seq
            ids = np.concatenate([x[2] for x in held])
            doc_ids = [d for x in held for d in x[0]]
            name = f"part-{part:06d}-{seq:06d}.lqids"
            hidden = posixpath.join(root, f".{name}.{TaskContext.get().taskAttemptId()}")
            with store.open_output_stream(hidden) as out:
                out.write(file_bytes(doc_ids, np.concatenate([x[1] for x in held]), ids, bits))
            store.move(hidden, posixpath.join(root, name))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([f"{folder}/{name}"])], ["part", "seq", "n_docs", "n_ids", "path"])
            held.clear()
            seq += 1
            return row

        for batch in batches:
            for some in slices(batch):
                ids, lengths = encoder.encode(some["text"])
                # The end id goes behind each document.
                ids = np.insert(ids, np.cumsum(lengths), end_id).astype(np.uint32)
                held.append((some["doc_id"].to_pylist(), lengths + 1, ids))
                if sum(len(x[2]) for x in held) >= FILE_IDS:
                    yield flush()
        if held:
            yield flush()

    docs = id_and_text(docs, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = docs.repartitionByRange(max(parts(docs.sparkSession), size // RANGE_BYTES), "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, "part int, seq int, n_docs long, n_ids long, path string"), "token-files")


def file_starts(files: DataFrame) -> DataFrame:
    """``part``, ``seq`` and ``file_start``, the ids before each file."""
    by_part = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each task that wrote
    before = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return files.select("part", "seq", inside.alias("inside")).join(before, "part").select("part", "seq", (F.col("part_start") + F.col("inside")).alias("file_start"))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Each document of the files: ``part``, ``seq``, ``at`` (its place in the file), ``doc_id``, ``first`` (ids before it there), ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                file = TokenFile(content.as_py())
                part, seq = (int(x) for x in name.rsplit("/", 1)[1][5:-6].split("-"))
                ids = file.read(0, file.n_ids)
                ends = np.concatenate([[0], np.cumsum(file.lengths)])
                n = len(file.doc_ids)
                for k in range(0, n, 1024):
                    some = slice(k, min(n, k + 1024))
                    cuts = ends[k : some.stop + 1]
                    lists = pa.ListArray.from_arrays(pa.array(cuts - cuts[0], pa.int32()), pa.array(ids[cuts[0] : cuts[-1]].astype(np.int64)))
                    size = some.stop - k
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * size, pa.int32()), pa.array([seq] * size, pa.int32()), pa.array(range(k, some.stop), pa.int32()), pa.array(file.doc_ids[some], pa.int64()), pa.array(cuts[:-1], pa.int64()), lists],
                        ["part", "seq", "at", "doc_id", "first", "ids"],
                    )

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.lqids").load(folder)
    return found.select("path", "content").mapInArrow(run, "part int, seq int, at int, doc_id long, first long, ids array<long>")


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """Like ``read_tokens``, with ``n_tokens`` and ``ids_crc32`` (of little-endian 32-bit ids) in place of the ids, which stay in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                file = TokenFile(content.as_py())
                raw = file.read(0, file.n_ids).astype("<u4").tobytes()
                ends = np.concatenate([[0], np.cumsum(file.lengths)])
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                part, seq = (int(x) for x in name.rsplit("/", 1)[1][5:-6].split("-"))
                n = len(sums)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(file.doc_ids, pa.int64()), pa.array(ends[:-1], pa.int64()), pa.array(file.lengths), pa.array(sums, pa.int64())], ["part", "seq", "doc_id", "first", "n_tokens", "ids_crc32"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.lqids").load(folder)
    return found.select("path", "content").mapInArrow(run, "part int, seq int, doc_id long, first long, n_tokens long, ids_crc32 long")


def op2_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "token-ids")
    files = write_tokens(table(spark, sf_dir, "documents"), folder)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    sums = read_checksums(spark, folder)
    return sums.join(file_starts(files), ["part", "seq"]).select("doc_id", (F.col("file_start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


QUERIES = {"op2_bitplane_tokens": op2_bitplane_tokens}
ORACLES: dict[str, str] = {}

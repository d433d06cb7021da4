"""Language-model scoring with a hashed maximum-entropy model.

``P(word | history) = P(class | history) * P(word | class)``. The most frequent
words and the end of a document are classes of their own; other words share
classes by their endings. The class is a softmax over hashed features: the word
before, the one before that (a skip), and both together (an n-gram). Words in a
class go by their smoothed counts.

Counts come from all training documents: each block counts its distinct words,
and blocks exchange them by bucket. Weights are trained by gradient steps in
every task over its own blocks and averaged by use, a half of the blocks after
the other. Scores are made in numpy batches, block by block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.arrays import mix
from logquarry.llm.blocks import Codes, bucket_count, bucket_order, exchange, in_blocks, pack_array, pack_codes, pack_words, unpack_array, unpack_codes, unpack_words
from logquarry.llm.shared import bucketed, id_and_text, table, written

CLASSES = 64
#: Words with a class of their own; one more class is the end's, the others are for endings.
OWN = 31
ENDINGS = CLASSES - OWN - 1
#: Rows of the weight table.
ROWS = 1 << 14
ROUNDS = 2
BATCH = 8192
#: Characters of a block; its tokens' features are held at once.
BLOCK_CHARS = 2_000_000
RATE = 0.3
#: Rows of weights that one group adds up.
CHUNK = 256
FOLDS, HELD = 7, 2
#: No word holds white space.
END = b"\n"


def held_out(doc_id: int | None) -> bool:
    """Whether a document isn't learnt from; documents without an id are."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def numbered_words(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct tokens of some texts, every token's number, and each text's tokens; the end is number 0."""
    split = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(pa.array(texts, pa.string())))
    coded = split.flatten().dictionary_encode()
    order = pa.compute.sort_indices(coded.dictionary).to_numpy()
    words = [w.encode() for w in coded.dictionary.take(pa.array(order)).to_numpy(zero_copy_only=False).tolist()]
    # A text that begins or ends with white space has an empty word there.
    empty = int(bool(words) and not words[0])
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    codes = rank[coded.indices.to_numpy()] + np.uint32(1 - empty)
    real = codes > 0 if empty else np.ones(len(codes), bool)
    ends = np.concatenate([[0], np.cumsum(real)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
    return [END, *words[empty:]], np.insert(codes[real], ends[1:], 0).astype(np.uint32), np.diff(ends) + 1


def word_blocks(docs: DataFrame) -> DataFrame:
    """Blocks with their words, codes and the words' training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in in_blocks(batches, BLOCK_CHARS):
            words, coded, sizes = numbered_words(texts)
            train = np.repeat([not held_out(i) for i in ids], sizes)
            counts = np.bincount(coded[train], minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int32())), pa.array([pack_codes(coded)], pa.binary()), pa.array([pack_words(words)], pa.binary()), pa.array([pack_array(counts)], pa.binary()), pa.array([len(words)], pa.int64())],
                ["block", "ids", "sizes", "codes", "words", "counts", "n_words"],
            )

    return bucketed(docs.mapInArrow(run, "block long, ids array<long>, sizes array<int>, codes binary, words binary, counts binary, n_words long"), "block", "lm-blocks")


def ending_class(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word[-2:]) % ENDINGS


def _count_bucket(lists: list[list[bytes]], values: list[bytes | None]) -> list[bytes]:
    """The total of each block's words, and a summary: tokens, words, sums by ending, and the most frequent words."""
    where = Codes()
    codes = [np.fromiter(map(where.__getitem__, words), np.int64, len(words)) for words in lists]
    totals = np.zeros(len(where), np.int64)
    for c, v in zip(codes, values, strict=True):
        totals[c] += unpack_array(v, np.int64)  # a block names a word once
    words = list(where)
    endings = np.array([ending_class(w) for w in words])
    plain = np.array([w != END for w in words])
    seen = (totals > 0) & plain
    sums = [int(totals.sum()), int((totals > 0).sum()), *np.bincount(endings[seen], totals[seen], ENDINGS).astype(np.int64).tolist(), *np.bincount(endings[seen], minlength=ENDINGS).tolist()]
    top = sorted(np.flatnonzero(seen), key=lambda k: (-totals[k], words[k]))[:OWN] if seen.sum() <= OWN else _top(totals, seen, words)
    summary = pack_words([np.array(sums, np.int64).tobytes(), *[words[k] for k in top], *[int(totals[k]).to_bytes(8, "little") for k in top]])
    return [*[pack_array(totals[c]) for c in codes], summary]


def _top(totals: np.ndarray, seen: np.ndarray, words: list[bytes]) -> list[int]:
    """The ``OWN`` most frequent words, by count and then by the word."""
    at = np.flatnonzero(seen)
    least = np.sort(totals[at])[-OWN]
    return sorted(at[totals[at] >= least], key=lambda k: (-totals[k], words[k]))[:OWN]


class Model:
    """Counts by class, the classes of frequent words, and the weights."""

    def __init__(self, summaries: list[bytes]):
        sums, top = np.zeros(2 + 2 * ENDINGS, np.int64), []
        for summary in summaries:
            first, *rest = unpack_words(summary)
            sums += np.frombuffer(first, np.int64)
            half = len(rest) // 2
            top += [(-int.from_bytes(c, "little"), w) for w, c in zip(rest[:half], rest[half:], strict=True)]
        self.tokens, self.words = int(sums[0]), int(sums[1])
        self.in_class, self.kinds = sums[2 : 2 + ENDINGS].astype(float), sums[2 + ENDINGS :].astype(float)
        self.own = {w: k for k, (_, w) in enumerate(sorted(top)[:OWN])}
        totals = np.zeros(CLASSES)
        for count, word in sorted(top)[:OWN]:
            ending = ending_class(word)
            self.in_class[ending] += count  # counts are negative here
            self.kinds[ending] -= 1
            totals[self.own[word]] = -count
        totals[OWN + 1 :] = self.in_class
        totals[OWN] = self.tokens - totals.sum()
        self.prior = np.log((totals + 1) / (self.tokens + CLASSES)).astype(np.float32)
        self.weights = np.zeros((ROWS, CLASSES), np.float32)

    def classes(self, words: list[bytes]) -> np.ndarray:
        own, end = self.own, OWN
        return np.array([own[w] if w in own else end if w == END else OWN + 1 + ending_class(w) for w in words], np.int64)

    def within(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P(word | class); words never seen share one place in their class."""
        shared = classes > OWN
        place = np.where(shared, classes - OWN - 1, 0)
        return np.where(shared, np.log10((counts + 1) / (self.in_class[place] + self.kinds[place] + 1)), 0.0)


def history(coded: np.ndarray, sizes: list[int], words: list[bytes]) -> np.ndarray:
    """The three feature rows of each token."""
    marks = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)[coded]
    place = np.arange(len(coded)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    before = np.zeros((2, len(coded)), np.uint64)
    before[0, 1:], before[1, 2:] = marks[:-1], marks[:-2]
    before[0, place < 1] = 1
    before[1, place < 2] = 2
    one = before[0] * np.uint64(0x9E3779B97F4A7C15)
    two = before[1] * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.stack([mix(one + np.uint64(1)), mix(two + np.uint64(2)), mix((one ^ (two >> np.uint64(7))) + two)], axis=1).astype(np.uint64) % np.uint64(ROWS)


def _shares(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """P(class | history) for a batch."""
    logits = weights[rows[:, 0]]
    logits += weights[rows[:, 1]]
    logits += weights[rows[:, 2]]
    logits += prior
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def learn(blocks: DataFrame, model: Model) -> None:
    """Train the weights: each task descends over its blocks, rows are averaged by how often a task used them."""
    spark = blocks.sparkSession
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(model.weights)  # ROWS x CLASSES floats, whatever the corpus
        prior, classes_of = model.prior, model.classes

        def run(batches: Iterator[pa.RecordBatch], start=start, classes_of=classes_of, prior=prior) -> Iterator[pa.RecordBatch]:
            weights, squares, used = start.value.copy(), np.full(ROWS, 1e-3, np.float32), np.zeros(ROWS, np.int64)
            for batch in batches:
                for row in batch.to_pylist():
                    words, coded = unpack_words(row["words"]), unpack_codes(row["codes"])
                    train = np.repeat([not held_out(i) for i in row["ids"]], row["sizes"])
                    rows = history(coded, row["sizes"], words)[train].astype(np.uint16)
                    right = classes_of(words)[coded[train]]
                    for k in range(0, len(rows), BATCH):
                        _step(weights, squares, used, rows[k : k + BATCH], right[k : k + BATCH], prior)
            if used.any():
                for k in range(0, ROWS, CHUNK):
                    part = slice(k, k + CHUNK)
                    blob = used[part].tobytes() + (weights[part] * used[part, None].astype(np.float32)).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], ["chunk", "blob"])

        def add(group: pa.Table) -> pa.Table:
            used, total = np.zeros(CHUNK, np.int64), np.zeros((CHUNK, CLASSES))
            for blob in group["blob"].to_pylist():
                used += np.frombuffer(blob, np.int64, CHUNK)
                total += np.frombuffer(blob, np.float32, CHUNK * CLASSES, 8 * CHUNK).reshape(CHUNK, CLASSES)
            mean = (total / np.maximum(used, 1)[:, None]).astype(np.float32)
            return pa.table({"chunk": group["chunk"][:1], "blob": pa.array([used.tobytes() + mean.tobytes()], pa.binary())})

        some = blocks.where(F.pmod(F.xxhash64("block"), F.lit(ROUNDS)) == turn).select("ids", "sizes", "codes", "words")
        means = some.mapInArrow(run, "chunk int, blob binary").groupBy("chunk").applyInArrow(add, "chunk int, blob binary")
        for row in means.collect():  # ROWS / CHUNK rows
            part = slice(row["chunk"], row["chunk"] + CHUNK)
            used = np.frombuffer(row["blob"], np.int64, CHUNK) > 0
            fresh = np.frombuffer(row["blob"], np.float32, CHUNK * CLASSES, 8 * CHUNK).reshape(CHUNK, CLASSES)
            model.weights[part][used] = fresh[used]
        start.unpersist()


def _step(weights: np.ndarray, squares: np.ndarray, used: np.ndarray, rows: np.ndarray, right: np.ndarray, prior: np.ndarray) -> None:
    """One gradient step with a rate for each row that falls with its gradients."""
    slope = _shares(weights, prior, rows)
    slope[np.arange(len(rows)), right] -= 1
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    at, times = ordered[heads], np.diff(np.append(heads, len(ordered)))
    summed = np.add.reduceat(slope[order // 3], heads, axis=0)
    squares[at] += np.einsum("ij,ij->i", summed, summed)
    used[at] += times
    weights[at] -= (RATE / np.sqrt(squares[at]))[:, None] * summed


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` for each input row.

    Tokens are lower-cased words and one end. Null and empty texts are an end
    alone; rows without an id are learnt from; repeated rows each count. Scores
    are log10 probabilities of the whole text. Other columns aren't read.
    """
    blocks = word_blocks(id_and_text(docs, id_col, text_col))
    buckets = bucket_count(blocks)
    answers = written(exchange(blocks, buckets, _count_bucket, "counts"), "lm-counts")
    model = Model([r["payload"] for r in answers.where("block = -1").select("payload").collect()])  # a row for each bucket
    learn(blocks, model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model, out = shared.value, []
        floor = np.log10(model.tokens + model.words + 1)
        for row in left.to_pylist():
            words, coded, sizes = unpack_words(row["words"]), unpack_codes(row["codes"]), np.array(row["sizes"])
            order, _ = bucket_order(words, buckets)
            counts, at = np.zeros(len(words), np.int64), 0
            for _, payload in sorted(zip(right["bucket"].to_pylist(), right["payload"].to_pylist(), strict=True)):
                found = unpack_array(payload, np.int64)
                counts[order[at : at + len(found)]] = found
                at += len(found)
            classes = model.classes(words)
            inner, base = model.within(classes, counts)[coded], np.log10(counts + 1.0)[coded]
            rows, right_class = history(coded, row["sizes"], words), classes[coded]
            outer = np.empty(len(coded))
            for k in range(0, len(coded), BATCH):
                part = slice(k, k + BATCH)
                shares = _shares(model.weights, model.prior, rows[part])
                outer[part] = np.log10(np.maximum(shares[np.arange(len(shares)), right_class[part]], 1e-30))
            heads = np.cumsum(sizes) - sizes
            total = np.add.reduceat(inner + outer, heads)
            out.append((row["ids"], [held_out(i) for i in row["ids"]], sizes, np.add.reduceat((counts > 0)[coded].astype(np.int64), heads), np.full(len(sizes), model.tokens), np.add.reduceat(base, heads) - sizes * floor, total))
        kinds = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
        return pa.table({name: pa.chunked_array([pa.array(o[k], kind) for o in out], kind) for k, (name, kind) in enumerate(kinds)})

    pairs = blocks.select("block", "ids", "sizes", "codes", "words").groupBy("block").cogroup(answers.where("block >= 0").groupBy("block"))
    return pairs.applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op10_maxent": op10_maxent}
ORACLES: dict[str, str] = {}

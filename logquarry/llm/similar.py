"""Near-duplicates by the exact Jaccard similarity of five-word shingles.

Texts are linked when their sets of shingles have a similarity of 0.8 or more.
Equal sets fall together first. With ``n`` shingles, of which at least
``ceil(0.8 n)`` must be shared, the first ``n - ceil(0.8 n) + 1`` of both sets
hold a common one in whatever order all sets are sorted; these are the keys.
Shingles that a sample shows to be frequent are sorted last, so that few sets
share a key; the sample sets the order alone and never the result.

Documents are kept in blocks. A block names each of its keys once, packed by
hash bucket; buckets answer which keys other sets can share, and only those keys
of a block become rows. With sizes ``n >= m`` and the first common key at places
``i`` and ``j`` of the orders, ``9 (n - i)`` and ``9 (m - j)`` are ``4 (n + m)`` or
more, so a key that stands early in no set links nothing.

Pairs are made in three ways. First the vantage-point tree of ``simhash`` proposes
pairs by the SimHash of the sets, among those that share a key; in large inputs sets visit only
some of the shards in reach, and what is missed is left to the next two. Then in a few turns each key asks its sets for links to two
of them, at first to the one whose keys are shared most widely, which joins large
groups of near copies in a linear number of pairs; sets of other sizes don't count. Last, all pairs are made whose
sets are still in different components, and those are passed over whose sizes, places or parity sketches rule out the similarity. Each pair left
is verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.blocks import bucket_count
from logquarry.llm.decontaminate import bound, shingle_hashes, words_of
from logquarry.llm.shared import BROADCAST_IDS, bounded, bucketed, give_back, id_and_text, parts, written
from logquarry.llm.simhash import components, majority, named, sized_pairs

SHINGLE = 5
#: One of so many documents tells which shingles are frequent, from so many documents on, and most of them that are kept.
SAMPLE, FREQUENT, MOST = 16, 4, 100_000
#: Differing bits of two fingerprints up to which the tree proposes a pair.
REACH = 12
#: Turns in which sets are linked to two others of each key.
TURNS = 3
#: Choices of two sets among the keys of a turn.
SPREAD = 4
#: Words of 64 bits in the smallest parity sketch, which all sets have besides their own.
SKETCH = 4
SKETCHES, OTHERS = [f"s{k}" for k in range(SKETCH)], [f"t{k}" for k in range(SKETCH)]
_SETS = "doc_id long, fp long, n int, mark long, sketch array<long>, " + ", ".join(f"{s} long" for s in SKETCHES)
_BLOCK = {"block": pa.int64(), "ids": pa.list_(pa.int64()), "fps": pa.list_(pa.int64()), "ns": pa.list_(pa.int32()), "sizes": pa.list_(pa.int32()), "keys": pa.binary(), "sketches": pa.binary(), "marks": pa.list_(pa.int64()), "n_words": pa.int64()}


def _hashes(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the hashes of each text's shingles; fewer than five words are one shingle, no words none."""

    def make(words):
        short = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(words) >= SHINGLE, shingle_hashes(words, SHINGLE)).otherwise(short)

    return docs.select("doc_id", bound(words_of(F.coalesce("text", F.lit(""))), make).alias("hashes"))


def _frequent(docs: DataFrame) -> np.ndarray:
    """Frequent shingles of the sample, the most frequent last."""
    seen = _hashes(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)).select(F.explode_outer(F.array_distinct("hashes")).alias("hash"))
    most = seen.groupBy("hash").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "hash").limit(MOST)
    return most.select("hash").toArrow()["hash"].to_numpy()[::-1]  # at most MOST rows


def keys_of(found: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The keys of a sorted set; ``frequent`` is sorted, ``rank`` has its places in the order."""
    wanted = len(found) - (4 * len(found) + 4) // 5 + 1 if len(found) else 0
    if not len(frequent):
        return found[:wanted]
    at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
    last = frequent[at] == found
    rare = found[~last]
    if len(rare) >= wanted:
        return rare[:wanted]
    return np.concatenate([rare, found[last][np.argsort(rank[at[last]])][: wanted - len(rare)]])


def sketch_words(n: int) -> int:
    """64-bit words of the parity sketch of a set of ``n``: a power of two with a bit for each hash."""
    return max(SKETCH, 1 << max(0, n - 1).bit_length() >> 6)


def sketch(found: np.ndarray) -> np.ndarray:
    """For each bit the parity of the hashes that fall on it, so sets differ in at least as many hashes as sketches do in bits.

    A sketch of half the size is both halves of it, one XOR the other.
    """
    bits = 64 * sketch_words(len(found))
    odd = np.bincount((found.view(np.uint64) >> np.uint64(17)) % np.uint64(bits), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _uniques(batch: pa.RecordBatch) -> tuple[list[np.ndarray], pa.Array]:
    """The sorted sets of a batch and their fingerprints."""
    lists = batch["hashes"]
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sets = [np.unique(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return sets, pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents: ids, fingerprints ``fps`` of their sets, sizes ``ns``, keys (``sizes`` has their numbers) and sketches."""
    order = _frequent(docs)
    by_hash = np.argsort(order)
    shared = docs.sparkSession.sparkContext.broadcast((order[by_hash], by_hash))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        frequent, rank = shared.value
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            sets, marks = _uniques(batch)
            sketches = np.concatenate([sketch(s) for s in sets])
            keys = [keys_of(s, frequent, rank) for s in sets]
            columns = [[block], [batch["doc_id"].to_pylist()], [marks.to_pylist()], [list(map(len, sets))], [list(map(len, keys))], [np.concatenate(keys).tobytes()], [sketches.tobytes()], [np.array([majority(s.view(np.uint64)) for s in sets], np.uint64).view(np.int64)], [sum(map(len, keys))]]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _BLOCK.values(), strict=True)], list(_BLOCK))
            block += 1
        give_back()

    kinds = "block long, ids array<long>, fps array<long>, ns array<int>, sizes array<int>, keys binary, sketches binary, marks array<long>, n_words long"
    return bucketed(_hashes(docs).mapInArrow(run, kinds), "block", "similar-blocks")


class _Keys:
    """The keys of a block, each set once: ``key``, and its place ``at`` in the order of the set ``doc``."""

    def __init__(self, row: dict, buckets: int):
        fps, sizes = np.array(row["fps"], np.int64), np.array(row["sizes"], np.int64)
        _, first = np.unique(fps, return_index=True)
        once = np.zeros(len(fps), bool)
        once[first] = True
        mine = np.repeat(once, sizes)
        self.fps, self.ns = fps, np.array(row["ns"], np.int64)
        self.key = np.frombuffer(row["keys"], np.int64)[mine]
        self.doc = np.repeat(np.arange(len(fps)), sizes)[mine]
        self.at = (np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes))[mine]
        # Distinct keys in the order of their buckets.
        self.distinct, self.code = np.unique(self.key, return_inverse=True)
        bucket = self.distinct.view(np.uint64) % np.uint64(buckets)
        self.order = np.argsort(bucket, kind="stable")
        self.starts = np.searchsorted(bucket[self.order], np.arange(buckets + 1, dtype=np.uint64))

    def flags(self) -> np.ndarray:
        """For each distinct key: 1 if several sets have it, 2 more if it stands early enough in one to be the first it shares with a larger set."""
        m = self.ns[self.doc]
        early = np.bincount(self.code, 9 * (m - self.at) >= 8 * m, len(self.distinct)) > 0
        return ((np.bincount(self.code, minlength=len(self.distinct)) > 1) + 2 * early).astype(np.uint8)


def _spread(blocks: DataFrame, buckets: int) -> DataFrame:
    """A row for each block and bucket: the block's keys there and their flags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = _Keys(row, buckets)
                flags = keys.flags()
                for b in range(buckets):
                    some = keys.order[keys.starts[b] : keys.starts[b + 1]]
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([keys.distinct[some].tobytes()]), pa.array([flags[some].tobytes()])], ["bucket", "block", "keys", "flags"])

    return blocks.mapInArrow(run, "bucket int, block long, keys binary, flags binary")


def _answer(group: pa.Table) -> pa.Table:
    """For each key of a block, in the order they came: 0 if no other set can share it, else how widely it is shared, on a scale of doublings."""
    lists = [np.frombuffer(x, np.int64) for x in group["keys"].to_pylist()]
    keys, flags = np.concatenate(lists), np.frombuffer(b"".join(group["flags"].to_pylist()), np.uint8)
    distinct, code, times = np.unique(keys, return_inverse=True, return_counts=True)
    wanted = ((times > 1) | (np.bincount(code, flags & 1) > 0)) & (np.bincount(code, flags & 2) > 0) if len(keys) else np.zeros(0, bool)
    ends = np.cumsum(list(map(len, lists)))[:-1]
    width = np.where(wanted, 1 + np.log2(np.maximum(times, 1)), 0).astype(np.uint8)
    widths = [x.tobytes() for x in np.split(width[code], ends)]
    return pa.table({"block": group["block"], "bucket": group["bucket"], "widths": pa.array(widths, pa.binary())})


def _keyed(blocks: DataFrame) -> DataFrame:
    """``key``, ``fp``, ``n``, the place ``at`` and the set's ``score`` for each of its keys that other sets can share.

    The score is the mean width of all keys of the set: the text that others are copies of has the highest of them.
    """
    buckets = bucket_count(blocks)
    answers = _spread(blocks.select("block", "fps", "ns", "sizes", "keys"), buckets).groupBy("bucket").applyInArrow(_answer, "block long, bucket int, widths binary")

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        said = dict(zip(right["bucket"].to_pylist(), right["widths"].to_pylist(), strict=True))
        out = []
        for row in left.to_pylist():
            keys = _Keys(row, buckets)
            width = np.zeros(len(keys.distinct), np.uint8)
            for b, widths in said.items():
                width[keys.order[keys.starts[b] : keys.starts[b + 1]]] = np.frombuffer(widths, np.uint8)
            mine = width[keys.code] > 0
            doc = keys.doc[mine]
            total = np.bincount(keys.doc, width[keys.code], len(keys.fps))
            score = (100 * total / np.maximum(1, np.bincount(keys.doc, minlength=len(keys.fps)))).astype(np.int64)
            out.append((keys.key[mine], keys.fps[doc], keys.ns[doc], keys.at[mine], score[doc]))
        kinds = {"key": pa.int64(), "fp": pa.int64(), "n": pa.int32(), "at": pa.int32(), "score": pa.int32()}
        return pa.table({name: pa.chunked_array([pa.array(o[k]).cast(kind) for o in out], kind) for k, (name, kind) in enumerate(kinds.items())})

    pairs = blocks.select("block", "fps", "ns", "sizes", "keys").groupBy("block").cogroup(answers.groupBy("block"))
    return written(pairs.applyInArrow(rows, "key long, fp long, n int, at int, score int"), "similar-keyed")


def _sets(blocks: DataFrame) -> DataFrame:
    """``doc_id``, the fingerprint ``fp`` of its set of shingles, the set's size and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                flat, sizes = np.frombuffer(row["sketches"], np.int64), np.array([sketch_words(n) for n in row["ns"]])
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                small = np.array([np.bitwise_xor.reduce(flat[a:b].reshape(-1, SKETCH), axis=0) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
                columns = [pa.array(row["ids"], pa.int64()), pa.array(row["fps"], pa.int64()), pa.array(row["ns"], pa.int32()), pa.array(row["marks"], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat)), *[pa.array(small[:, k].copy()) for k in range(SKETCH)]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "n", "mark", "sketch", *SKETCHES])

    return written(blocks.select("ids", "fps", "ns", "sketches", "marks").mapInArrow(run, _SETS), "similar-sets")


def _hashed(docs: DataFrame) -> DataFrame:
    """``fp`` and the hashes of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            sets, marks = _uniques(batch)
            yield pa.RecordBatch.from_arrays([marks, pa.array(sets, pa.list_(pa.int64()))], ["fp", "hashes"])

    return _hashes(docs).mapInArrow(run, "fp long, hashes array<long>")


def _near(pairs: DataFrame, distinct: DataFrame, label: str) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose sizes and own sketches allow the similarity."""
    sides = distinct.select("fp", "n", "sketch")
    known = pairs.join(sides.toDF("a", "n", "s"), "a").join(sides.toDF("b", "m", "t"), "b")
    words = F.least(F.size("s"), F.size("t"))

    def folded(name: str):
        # Sizes within a quarter of each other differ by one doubling at most.
        whole = F.col(name)
        return F.when(F.size(whole) == words, whole).otherwise(F.zip_with(F.slice(whole, F.lit(1), words), F.slice(whole, words + 1, words), lambda x, y: x.bitwiseXOR(y)))

    differ = F.aggregate(F.zip_with(folded("s"), folded("t"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return written(known.where(_near_in_size("n", "m")).where(9 * differ <= F.col("n") + F.col("m")).select(*pairs.columns), f"{label}-near")


def _verified(pairs: DataFrame, docs: DataFrame, distinct: DataFrame, label: str) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets have the similarity; the hashes are made anew for the documents in question."""
    wanted = written(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct(), f"{label}-wanted")
    ids = written(distinct.join(bounded(wanted, BROADCAST_IDS), "fp", "left_semi").where("first_id is not null").select(F.col("first_id").alias("doc_id")).distinct(), f"{label}-ids")
    held = docs.join(bounded(ids, BROADCAST_IDS), "doc_id", "left_semi").union(docs.where("doc_id is null"))
    some = written(_hashed(held).join(bounded(wanted, BROADCAST_IDS), "fp", "left_semi").dropDuplicates(["fp"]), f"{label}-sets")
    both = pairs.join(some.toDF("a", "a_hashes"), "a").join(some.toDF("b", "b_hashes"), "b")
    shared = F.size(F.array_intersect("a_hashes", "b_hashes"))
    # shared / (a + b - shared) >= 4 / 5
    return written(both.where(9 * shared >= 4 * (F.size("a_hashes") + F.size("b_hashes"))).select("a", "b"), label)


def _size_class(turn: int):
    """Sets that can be near are of one class or of two neighbours; from turn to turn the limits move by half a class."""
    return F.floor(F.log("n") / math.log(1.25) + turn % 2 / 2)


def _hubs(rooted: DataFrame, turn: int) -> DataFrame:
    """Keys and size classes that hold sets of different components, each with two of its sets: at first the one whose keys are shared most widely, else any."""
    some = F.xxhash64("fp", F.lit(turn), F.pmod("key", F.lit(SPREAD)))
    most = F.struct(F.when(F.lit(turn == 0), F.col("score")).otherwise(some).alias("rank"), "fp", "root")
    ends = rooted.groupBy("key", "kind").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.max(most).alias("hub"), F.min(F.struct(some.alias("rank"), "fp", "root")).alias("lo"))
    return written(ends.where("least < most").select("key", "kind", "hub", "lo"), "similar-hubs")


def _near_in_size(a: str, b: str):
    return (F.col(a) * 5 >= F.col(b) * 4) & (F.col(b) * 5 >= F.col(a) * 4)


def _near_in_sketch():
    differ = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(t))) for s, t in zip(SKETCHES, OTHERS, strict=True)), F.lit(0))
    return 9 * differ <= F.col("n") + F.col("m")


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` for each input row.

    Like ``simhash.near_duplicates``, but documents are linked when at least
    80 % of the distinct five-word shingles of both are shared.
    """
    docs = id_and_text(docs, id_col, text_col)
    blocks = _blocks(docs)
    sets, keyed = _sets(blocks), _keyed(blocks)
    # Rows of one set agree in all but the id.
    distinct = written(sets.groupBy("fp").agg(F.first("n").alias("n"), F.first("mark").alias("mark"), F.first("sketch").alias("sketch"), *[F.first(x).alias(x) for x in SKETCHES], F.min("doc_id").alias("first_id")), "similar-distinct")
    # A set that several blocks hold is there several times, so a key isn't shared before its ends differ.
    several = keyed.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("key")
    keyed = written(keyed.join(several, "key", "left_semi").distinct(), "similar-shared")

    def grouped(links: DataFrame, rounds: int | None = None) -> DataFrame:
        roots = components(links.repartition(parts(docs.sparkSession)), "similar-links", rounds).toDF("fp", "root")
        return written(keyed.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "similar-turn")

    # A set that shares no key has no link.
    searched = written(distinct.join(keyed.select("fp").distinct(), "fp", "left_semi").select("fp", "mark", "n"), "similar-searched")
    near = _near(written(sized_pairs(searched, REACH), "similar-tree"), distinct, "similar-tree")
    links = _verified(near, docs, distinct, "similar-linked")
    rooted = grouped(links)
    for turn in range(TURNS):
        rooted = rooted.withColumn("kind", _size_class(turn))
        hubs = _hubs(rooted, turn)
        ways = F.array(F.struct(F.col("hub.fp").alias("b"), F.col("hub.root").alias("other")), F.struct(F.col("lo.fp").alias("b"), F.col("lo.root").alias("other")))
        stars = rooted.join(hubs, ["key", "kind"]).select(F.col("fp").alias("a"), "root", F.inline(ways)).where("root <> other").select("a", "b").distinct()
        # Of the sets that can be near, each asks two.
        order = F.struct(F.xxhash64("b", F.lit(turn)), "b")
        stars = _near(stars, distinct, "similar-stars").groupBy("a").agg(F.min(order)["b"].alias("lo"), F.max(order)["b"].alias("hi"))
        stars = stars.select("a", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("b"))
        found = _verified(written(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "similar-stars"), docs, distinct, "similar-linked")
        links = links.union(found)
        # Stars settle in two rounds; sets that are still apart then are only asked again.
        rooted = grouped(links, 2)
    mixed = _hubs(rooted.withColumn("kind", F.lit(0)), TURNS).select("key")
    left = rooted.join(mixed, "key", "left_semi").drop("score").join(distinct.select("fp", *SKETCHES), "fp")
    left = written(left, "similar-rooted")
    # The smaller set of a pair, the one with the smaller fingerprint among equals, is on the right; the key has to stand early in it.
    right = left.where(9 * (F.col("n") - F.col("at")) >= 8 * F.col("n")).select("key", F.col("fp").alias("b"), F.col("n").alias("m"), F.col("at").alias("bt"), F.col("root").alias("other"), *[F.col(s).alias(t) for s, t in zip(SKETCHES, OTHERS, strict=True)])
    first = (9 * (F.col("n") - F.col("at")) >= 4 * (F.col("n") + F.col("m"))) & (9 * (F.col("m") - F.col("bt")) >= 4 * (F.col("n") + F.col("m")))
    smaller = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("b") < F.col("fp")))
    apart = left.join(right, "key").where(smaller & first & (F.col("root") != F.col("other")) & _near_in_size("n", "m") & _near_in_sketch())
    apart = _near(written(apart.select(F.col("fp").alias("a"), "b").distinct(), "similar-apart"), distinct, "similar-apart")
    more = _verified(apart, docs, distinct, "similar-more")
    return named(sets.select("doc_id", "fp"), distinct.select("fp", "first_id"), components(links.union(more).repartition(parts(docs.sparkSession)), "similar-links").toDF("fp", "root"))

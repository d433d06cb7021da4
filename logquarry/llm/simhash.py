"""SimHash near-duplicates through a vantage-point tree.

1. Fingerprints are computed for whole texts; equal fingerprints fall together.
2. A vantage-point tree over Hamming distance is grown from a bounded sample of
   distinct fingerprints. Its leaves are shards. Each fingerprint has one home
   shard, and triangle bounds tell which other shards can hold a fingerprint
   within the link distance; it visits those too.
3. Each shard finds its exact links, pruning with a tree of its own, and returns
   a spanning forest of them instead of all pairs.
4. The forests are merged into components by alternating large-star and
   small-star steps over Spark joins.

Where the links are sets of a given similarity (``sized_pairs``), the reach is
wide. Shards are then split by size class as well, and their forests hold real
links, the nearest first, as each link is checked on the sets afterwards. So wide
a reach leads into nearly all shards, so beyond some rows sets visit
only as many other shards as keep the rows in proportion to the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.shared import BROADCAST_IDS, bounded, id_and_text, parts, scratch, shared_path, table, written

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Most fingerprints the tree is grown from.
SAMPLE = 16384
#: Distinct fingerprints wanted in a shard.
SHARD_ROWS = 4000
#: Comparisons made at once inside a shard.
BLOCK = 1 << 22
#: Sets wanted in a leaf of a tree that is searched with a wide reach; leaves are split further by size.
WIDE_ROWS = 30_000
#: Rows that the sets may become on their way to such leaves in any case, and beyond that for each set; in its own leaf alone a set is two rows.
WIDE_FREE, WIDE_VISITS = 1 << 17, 4
#: Home sets and others that are compared at once there, and links that are gathered before a forest takes them.
TILE, LINKS = (64, 4096), 1 << 18


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text; texts without a word (null, empty) have 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-SHINGLE].tolist()]
        hash_of = xxhash.xxh64_intdigest
        hashes = [hash_of(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(values: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of ``values``."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(values), 4096):
        counts += np.unpackbits(values[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(x) for x in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(marks.view(np.int64))], ["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VantageTree:
    """A binary vantage-point tree; inner nodes hold (vantage, radius, near, far), leaves a shard number."""

    def __init__(self, sample: np.ndarray, leaf_size: int):
        self.nodes: list[tuple] = []
        self.shards = 0
        self._grow(np.unique(sample), max(1, leaf_size))

    def _grow(self, points: np.ndarray, leaf_size: int) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        split = _split(points) if len(points) > leaf_size else None
        if split is None:
            self.nodes[me] = (self.shards,)
            self.shards += 1
        else:
            vantage, radius, near = split
            self.nodes[me] = (vantage, radius, self._grow(points[near], leaf_size), self._grow(points[~near], leaf_size))
        return me

    def route(self, points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each shard the indexes of the points that can have a link into it, and which of them live there."""
        stack = [(0, np.arange(len(points)), np.ones(len(points), bool))]
        while stack:
            node, at, home = stack.pop()
            if not len(at):
                continue
            if len(self.nodes[node]) == 1:
                yield self.nodes[node][0], at, home
                continue
            vantage, radius, near, far = self.nodes[node]
            d = distance(points[at], vantage).astype(np.int16)
            inside, outside = d <= radius + reach, d > radius - reach
            stack.append((near, at[inside], home[inside] & (d <= radius)[inside]))
            stack.append((far, at[outside], home[outside] & (d > radius)[outside]))


def _split(points: np.ndarray):
    """(vantage, radius, mask of the near points) that halves ``points`` best, or None."""
    best = None
    for vantage in points[:: max(1, len(points) // 4)][:4]:
        d = distance(points, vantage)
        radius = int(np.sort(d)[(len(d) - 1) // 2])
        near = d <= radius
        if 0 < near.sum() < len(near):
            # Points closer than the reach to the boundary go both ways.
            cost = np.abs(d.astype(int) - radius).clip(0, MAX_BITS).sum() - abs(2 * int(near.sum()) - len(near))
            if best is None or cost > best[0]:
                best = (cost, vantage, radius, near)
    return best[1:] if best else None


class Forest:
    """Union-find over array positions, with whole arrays of links at once."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def settle(self) -> None:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return
            self.root = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            self.settle()


def link_shard(home: np.ndarray, guests: np.ndarray, reach: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (fingerprint, smaller fingerprint it hangs on) of the links of ``home`` with ``home`` and ``guests``."""
    points = np.concatenate([home, guests])
    forest = Forest(len(points))
    stack = [(np.arange(len(home)), np.arange(len(points)))]
    while stack:
        here, there = stack.pop()
        if not len(here) or not len(there):
            continue
        if len(here) * len(there) > BLOCK // 8 and len(here) > 64 and (split := _split(points[here])) is not None:
            vantage, radius, near = split
            d = distance(points[there], vantage).astype(np.int16)
            stack.append((here[near], there[d <= radius + reach]))
            stack.append((here[~near], there[d > radius - reach]))
            continue
        step = max(1, BLOCK // len(there))
        for k in range(0, len(here), step):
            some = here[k : k + step]
            i, j = np.nonzero(distance(points[some][:, None], points[there][None, :]) <= reach)
            forest.join(some[i], there[j])
    top = forest.root
    linked = np.flatnonzero(top != np.arange(len(points)))
    return points[linked], points[top[linked]]


class NearestForest:
    """Spanning forest of links that were really seen, the nearest first; it takes links in parts."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        if len(a):
            self.parts.append((a, b, d))
            self.waiting += len(a)
            if self.waiting > LINKS:
                self.links()

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The links of the forest so far."""
        self.waiting = 0
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b, d = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = codes[: len(a)], codes[len(a) :]
        forest, chosen = Forest(len(nodes)), []
        for reach in np.unique(d):
            at = np.flatnonzero(d == reach)
            while len(at := at[forest.root[x[at]] != forest.root[y[at]]]):
                # One link for each root that is to hang on a smaller one.
                ends = np.maximum(forest.root[x[at]], forest.root[y[at]])
                some = at[np.unique(ends, return_index=True)[1]]
                chosen.append(some)
                forest.join(x[some], y[some])
        kept = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
        self.parts = [(a[kept], b[kept], d[kept])]
        return a[kept], b[kept]


def sized_links(marks: np.ndarray, sizes: np.ndarray, home: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest, as places, of the links of home sets with all: fingerprints within ``reach``, sizes within a quarter."""

    def by_size(some: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(some)
        return at[np.argsort(sizes[at], kind="stable")]

    own, guests = by_size(home), by_size(~home)
    forest = NearestForest()
    for k in range(0, len(own), TILE[0]):
        here = own[k : k + TILE[0]]
        least, most = (4 * sizes[here[0]] + 4) // 5, 5 * sizes[here[-1]] // 4
        there = np.concatenate([own[k + 1 : np.searchsorted(sizes[own], most, "right")], guests[np.searchsorted(sizes[guests], least) : np.searchsorted(sizes[guests], most, "right")]])
        for m in range(0, len(there), TILE[1]):
            part = there[m : m + TILE[1]]
            apart = distance(marks[here][:, None], marks[part][None, :])
            i, j = np.nonzero(apart <= reach)
            a, b = here[i], part[j]
            fit = (a != b) & (5 * sizes[a] >= 4 * sizes[b]) & (5 * sizes[b] >= 4 * sizes[a])
            forest.add(a[fit], b[fit], apart[i, j][fit])
    return forest.links()


def _visits(tree: VantageTree, marks: np.ndarray, reach: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Shard, step up in size class (0 or 1), the indexes of the sets that become a row there, and which of them live there.

    Of two shards of a class that can hold the ends of a pair only one is visited.
    """
    visits, leaf = [], np.zeros(len(marks), np.int32)
    for shard, at, home in tree.route(marks, reach):
        leaf[at[home]] = shard
        visits.append((shard, at))
    for shard, at in visits:
        for up in (0, 1):
            some = at if up else at[leaf[at] <= shard]
            if len(some):
                yield shard, up, some, (leaf[some] == shard) & (up == 0)


def route_reach(tree: VantageTree, marks: np.ndarray, n: int, reach: int) -> int:
    """The widest way to other shards, up to ``reach``, on which ``n`` sets like the sample ``marks`` become no more rows than wanted; 0 is the own shard alone."""
    most = max(WIDE_FREE, WIDE_VISITS * n) * len(marks)
    while reach > 0 and n * sum(len(some) for _, _, some, _ in _visits(tree, marks, reach)) > most:
        reach -= 1
    return reach


def routed(sets: DataFrame, reach: int) -> DataFrame:
    """The rows of ``sets`` by ``shard`` and size class ``kind`` that they visit or, once, are at ``home`` in."""
    n = sets.count()
    distinct = sets.select("mark").distinct()
    sample = distinct.orderBy(F.xxhash64("mark"), "mark").limit(SAMPLE)
    points = np.array([r["mark"] for r in sample.collect()], np.int64).view(np.uint64)
    tree = VantageTree(points, max(1, WIDE_ROWS * len(points) // max(n, 1)))
    if tree.shards > 1:
        # Sets of one mark count each.
        some = sets.select("fp", "mark").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE)
        reach = route_reach(tree, np.array([r["mark"] for r in some.collect()], np.int64).view(np.uint64), n, reach)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, n = batch["mark"].to_numpy(), batch["n"].to_numpy()
            # Sizes within a quarter of each other are of one class or of two neighbours.
            kinds = np.floor(np.log(np.maximum(n, 1)) / np.log(1.25)).astype(np.int32)
            for shard, up, some, home in _visits(tree, marks.view(np.uint64), reach):
                rows = batch.select(["fp", "mark", "n"]).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard, np.int32)), pa.array(kinds[some] + np.int32(up)), *rows.columns, pa.array(home)], ["shard", "kind", "fp", "mark", "n", "home"])

    return sets.select("fp", "mark", "n").mapInArrow(route, "shard int, kind int, fp long, mark long, n int, home boolean")


def sized_pairs(sets: DataFrame, reach: int) -> DataFrame:
    """Pairs ``a``, ``b`` of ``sets`` (``fp``, its SimHash ``mark``, its size ``n``) within ``reach`` and a quarter of each other's size.

    Each shard (a leaf of the tree and a size class) gives a spanning forest of
    its pairs. While the sets become up to ``WIDE_FREE`` rows on their way to the
    shards, together the forests join what all pairs join. Beyond that the way is narrowed
    to some ``WIDE_VISITS`` rows a set: a pair that is further apart than the way
    is wide is then found only where both ends meet in a shard, so who needs
    every link has to look for the rest otherwise, as ``similar`` does.
    """

    def link(group: pa.Table) -> pa.Table:
        fps = group["fp"].to_numpy()
        a, b = sized_links(group["mark"].to_numpy().view(np.uint64), group["n"].to_numpy().astype(np.int64), group["home"].to_numpy(), reach)
        return pa.table({"a": fps[a], "b": fps[b]})

    found = routed(sets, reach).groupBy("shard", "kind").applyInArrow(link, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _shard_links(distinct: DataFrame, n: int) -> DataFrame:
    """Links ``a``, ``b`` between fingerprints, enough of them to hold each component together."""
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE) if n > SAMPLE else distinct
    points = np.array([r["fp"] for r in sample.collect()], np.int64).view(np.uint64)
    tree = VantageTree(points, max(1, SHARD_ROWS * len(points) // max(n, 1)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch["fp"].to_numpy(zero_copy_only=False)
            for shard, at, home in tree.route(found.view(np.uint64), MAX_BITS):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), pa.array(found[at]), pa.array(home)], ["shard", "fp", "home"])

    def link(group: pa.Table) -> pa.Table:
        found = group["fp"].to_numpy().view(np.uint64)
        home = group["home"].to_numpy()
        a, b = link_shard(found[home], found[~home])
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return distinct.mapInArrow(route, "shard int, fp long, home boolean").groupBy("shard").applyInArrow(link, "a long, b long")


def components(links: DataFrame, label: str = "components", rounds: int | None = None) -> DataFrame:
    """``node`` and the smallest ``root`` it is connected to, for every node of ``links`` (a, b).

    Alternates large-star and small-star steps until nothing changes. Minimums
    are combined before the shuffle, and joins on a node with many neighbours
    are left to adaptive skew splitting. After ``rounds``, if given, the roots so
    far are returned: nodes of one root are connected, but not all that are
    connected have one root yet.
    """
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), label)
    before, done = None, 0
    while True:
        both = links.union(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        links = written(small.where("hi <> lo").distinct(), label)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before:
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(links.select(F.col("lo"), F.col("lo")).distinct())
        before, done = state, done + 1
        if done == rounds:
            roots = links.groupBy("hi").agg(F.min("lo").alias("lo"))
            heads = links.select("lo").distinct().join(roots.select(F.col("hi").alias("lo")), "lo", "left_anti")
            return roots.toDF("node", "root").union(heads.select("lo", F.col("lo").alias("root")))


def named(marks: DataFrame, distinct: DataFrame, comp: DataFrame) -> DataFrame:
    """``marks`` with the smallest id of their component; ``distinct`` has each ``fp`` with its ``first_id``, ``comp`` its ``root`` where it has links."""
    every = distinct.join(comp, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    roots = every.where("root <> fp").groupBy("root").agg(F.min("first_id").alias("id")).toDF("root", "other_id")
    every = every.join(roots, "root", "left")
    own = every.where("root = fp").select("root", F.least("first_id", "other_id").alias("component_id"))
    classes = every.where("root <> fp").select("fp", "root").join(own, "root").select("fp", "component_id").union(own.select(F.col("root").alias("fp"), "component_id"))
    return marks.join(classes, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` for each input row.

    Two documents are linked when their fingerprints differ in at most
    ``MAX_BITS`` bits; ``component_id`` is the smallest id reachable. Texts
    without a word share fingerprint 0. Repeated rows and ids are linked like
    other rows. A row with a null id keeps its null id, never names a component,
    and gets a null component where no row of its component has an id.
    """
    marks = written(fingerprints(docs, id_col, text_col), "simhash-fingerprints")
    distinct = marks.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    n = distinct.count()
    comp = components(_shard_links(distinct.select("fp"), n).repartition(parts(docs.sparkSession)), "simhash-links").toDF("fp", "root")
    return named(marks, distinct, comp)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find=near_duplicates) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id.

    ``find`` gives the groups. All columns stay. Rows that share a doc id count as copies; rows without an
    id are kept, as nothing names them.
    """
    spark = docs.sparkSession
    classes = shared_path(spark, "simhash-classes")
    with scratch(spark):
        find(docs, id_col, text_col).write.option("compression", "zstd").parquet(classes)
    found = spark.read.schema("doc_id long, fp long, component_id long").parquet(classes)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    kept = docs.join(bounded(written(gone, "simhash-gone"), BROADCAST_IDS), id_col, "left_anti")
    twice = found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias(id_col))
    if twice.isEmpty():
        return kept
    return kept.join(twice, id_col, "left_anti").unionByName(kept.join(twice, id_col, "left_semi").dropDuplicates([id_col]))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}

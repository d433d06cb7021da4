"""Copies of growing logs: which files are beginnings of longer ones, from digests alone.

Every file gives the digests of its beginnings at 512 bytes, 1,024, 2,048 and so on, in one pass. Files that agree at
a rung and end before the next one may be beginnings of all that agree there. Such
a group is cut at sizes of its own files into smaller ranges of size, digests are taken at the
cuts, and so on, until a group has few sizes; then the digests at these sizes decide. Of files that go
beyond a range and agree up to its end only the longest stays in it, so ``n`` files take some ``n log n`` digests
in whatever way they branch. No content leaves the task that reads it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.session import settled
from logquarry.sources.files import store_of

#: Bytes that copies share at the least, and the shortest beginning that is compared.
START = 512
#: Cuts of a group, and sizes up to which a group is decided at once.
CUTS = 32
CHUNK = 4 << 20

DIGESTS = "array<struct<length:bigint,sha:string>>"
#: Gives ``file_id`` and ``found`` (``DIGESTS``) for rows of ``file_id`` and ``lengths``, in ascending order.
Digests = Callable[[DataFrame], DataFrame]


def beginnings(read: Callable[[int], bytes], lengths: Iterable[int]) -> list[dict]:
    """Digests of the beginnings of a stream, in one pass; those longer than it are left out."""
    digest, at, out = hashlib.sha256(), 0, []
    for length in lengths:
        while at < length:
            piece = read(min(CHUNK, length - at))
            if not piece:
                return out
            digest.update(piece)
            at += len(piece)
        out.append({"length": length, "sha": digest.hexdigest()})
    return out


def of_paths(wanted: DataFrame) -> DataFrame:
    """Digests of files that are read where they lie; ``file_id`` is the path. A file that can't be read has none."""
    schema = pa.schema([("file_id", pa.string()), ("found", pa.list_(pa.struct([("length", pa.int64()), ("sha", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, lengths in zip(batch["file_id"].to_pylist(), batch["lengths"].to_pylist(), strict=True):
                try:
                    store, inner = store_of(path)
                    with store.open_input_stream(inner) as stream:
                        found = beginnings(stream.read, lengths)
                except (OSError, pa.ArrowInvalid):
                    found = []
                yield pa.RecordBatch.from_pylist([{"file_id": path, "found": found}], schema)

    return wanted.select("file_id", "lengths").mapInArrow(run, f"file_id string, found {DIGESTS}")


def of_contents(files: DataFrame) -> Digests:
    """Digests of ``files`` (``file_id``, ``content``), whose contents are a column."""

    @F.pandas_udf(DIGESTS)
    def found(contents: pd.Series, lengths: pd.Series) -> pd.Series:
        def one(content, wanted):
            import io

            return beginnings(io.BytesIO(content).read, (int(n) for n in wanted))

        return pd.Series([one(*row) for row in zip(contents, lengths, strict=True)], dtype=object)

    return lambda wanted: files.select("file_id", "content").join(wanted, "file_id").select("file_id", found("content", "lengths").alias("found"))


def _alive(state: DataFrame) -> DataFrame:
    """The groups in which a file may be the beginning of another."""
    counts = state.groupBy("group").agg(F.count("*").alias("_all"), F.count_if("own").alias("_own")).where("_own > 0 AND _all > 1").select("group")
    return settled(state.join(counts, "group", "left_semi"))


def _rungs(found: DataFrame) -> DataFrame:
    """Groups of files that agree at a rung: their own end before the next rung, of the others the longest of each digest there."""
    steps = found.select("file_id", "size", F.col("found").alias("f"), F.posexplode("found").alias("k", "d"))
    steps = steps.select("file_id", "size", F.concat_ws(":", "d.length", "d.sha").alias("group"), F.col("d.length").alias("lo"), (2 * F.col("d.length")).alias("hi"), F.get("f", F.col("k") + 1)["sha"].alias("next"))
    return _collapsed(steps)


def _collapsed(steps: DataFrame) -> DataFrame:
    """``group``, ``lo``, ``hi``, ``file_id``, ``size``, ``own``; of files that agree at ``hi``, where ``next`` is their digest, the longest stays."""
    own = steps.where("size < hi").select("group", "lo", "hi", "file_id", "size", F.lit(True).alias("own"))
    beyond = steps.where("size >= hi").groupBy("group", "lo", "hi", F.coalesce("next", F.concat(F.lit("="), F.col("file_id").cast("string"))).alias("next")).agg(F.max(F.struct("size", "file_id")).alias("m"))
    return own.unionByName(beyond.select("group", "lo", "hi", "m.file_id", "m.size", F.lit(False).alias("own")))


def growing_copies(files: DataFrame, digests: Digests = of_paths, start: int = START, seen: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """``file_id`` and ``longest``: for each of ``files`` (``file_id``, ``size``) that is the beginning of longer ones, the longest of these.

    Of several the greatest id counts. Files of the same content aren't beginnings of each other, and those below
    ``start`` bytes aren't looked at. ``seen`` is called with the lengths that each round wants.
    """
    wanted = files.where(F.col("size") >= start).select("file_id", "size")
    rungs = F.expr(f"transform(sequence(0, length(bin(size div {start})) - 1), k -> shiftleft(cast({start} as bigint), k))")
    wanted = wanted.select("file_id", "size", rungs.alias("lengths"))
    if seen:
        seen(wanted)
    state = _alive(_rungs(settled(digests(wanted.select("file_id", "lengths")).join(wanted.select("file_id", "size"), "file_id"))))
    result = None
    while True:
        sizes = state.where("own").select("group", "size").distinct()
        few = settled(sizes.groupBy("group").agg(F.count("*").alias("n"), F.percentile_approx("size", [k / (CUTS + 1) for k in range(1, CUTS + 1)], 10_000).alias("spread")))
        last = few.where(F.col("n") <= CUTS).select("group")
        # Of a group that is decided at once, all sizes, at most CUTS.
        exact = sizes.join(last, "group").groupBy("group").agg(F.collect_set("size").alias("cuts")).withColumn("final", F.lit(True))
        cut = few.where(F.col("n") > CUTS).select("group", F.col("spread").alias("cuts"), F.lit(False).alias("final"))
        cuts = exact.unionByName(cut).select("group", F.array_sort(F.array_distinct("cuts")).alias("cuts"), "final")
        rows = settled(state.join(cuts, "group"))
        each = rows.select("file_id", F.explode(F.filter("cuts", lambda c: c <= F.col("size"))).alias("length"))
        wanted = each.groupBy("file_id").agg(F.array_sort(F.collect_set("length")).alias("lengths"))
        if seen:
            seen(wanted)
        found = settled(digests(wanted)).select("file_id", F.map_from_entries("found").alias("sha"))
        # A file that ends before all cuts of its groups has no digests, and stays in their first ranges.
        rows = settled(rows.join(found, "file_id", "left"))
        here = rows.where("final").select("group", "file_id", "size", "own", F.explode("cuts").alias("cut"), "sha").where("cut <= size").withColumn("sha", F.col("sha")[F.col("cut")])
        best = here.where("size > cut").groupBy("group", "cut", "sha").agg(F.max(F.struct("size", "file_id"))["file_id"].alias("longest"))
        said = settled(here.where("own AND cut = size").join(best, ["group", "cut", "sha"]).select("file_id", "longest"))
        result = said if result is None else result.unionByName(said)
        parts = rows.where("not final").withColumn("edges", F.concat(F.array("lo"), F.filter("cuts", lambda c: c > F.col("lo")), F.array("hi")))
        parts = parts.select("*", F.posexplode(F.slice("edges", F.lit(1), F.size("edges") - 1)).alias("k", "from")).where("size >= from")
        steps = parts.select(
            "file_id", "size", F.concat_ws("|", "group", "k", F.coalesce(F.col("sha")[F.col("from")], F.lit(""))).alias("group"), F.col("from").alias("lo"),
            F.get("edges", F.col("k") + 1).alias("hi"), F.col("sha")[F.get("edges", F.col("k") + 1)].alias("next"),
        )
        state = _alive(_collapsed(steps))
        if state.isEmpty():
            return result

"""Audit of filters that act together, from sorted posting lists.

Every filter keeps, for each part of the corpus and each range of ids, the sorted
list of the documents it fails. What a filter removes behind others is the
difference of its list and the union of theirs; all differences of a range are
taken by galloping through the lists, and their sizes are summed over the
ranges. Every order of the filters is then answered from these sums.

A document is named in the lists by its place in the order of ids, so rows that
repeat an id count each.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logquarry.llm.shared import table, written
from logquarry.llm.token_files import slices

LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 3
SYMBOLS = b"#$%&*|"
#: The filters in the order of their bits; the last one needs all other texts.
FILTERS = "ABCDE"
#: Documents of one range of ids in a posting list.
RANGE_ROWS = 1 << 16
#: Posting lists of a part and range: all documents, those of labels, those that each filter fails.
LISTS = ["every", "good", "toxic", *FILTERS]

_CAPITALS = string.ascii_uppercase.encode()


def own_failures(text: str) -> int:
    """Bits of the filters A to D that fail ``text``."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    short = len(words) < LEAST_WORDS
    repeated = 100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > MOST_CAPITALS_PERCENT * len(text)
    marked = len(raw.translate(None, SYMBOLS)) < len(raw)
    return short | repeated << 1 | loud << 2 | marked << 3


def measured(docs: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``part``, ``digest`` of the text and ``fails`` (bits of A to D) for each input row.

    A null text counts as empty and a null part as the empty string.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("fails", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                texts = [t or "" for t in some["text"].to_pylist()]
                digests = [hashlib.sha256(t.encode("utf-8", "replace")).digest() for t in texts]
                yield pa.record_batch([some["doc_id"], some["part"].cast(pa.string()), pa.array(digests, pa.binary()), pa.array([own_failures(t) for t in texts], pa.int32())], schema)

    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), part.alias("part"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, fails int")


def posting_lists(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """The posting lists (``LISTS``) of each ``part`` and range of ids.

    ``flags`` is a written table of ``measured``. A document fails E if a smaller
    id has its text. One row for each text, its smallest id, goes through the
    same ranges as the documents and meets there the document that keeps
    it, so copies are never brought together. Ranges are cut by id and digest:
    equal ids of different texts may lie in several. A null id is neither smaller nor larger than any other and
    has no labels. Several labels of an id count as one, good or toxic if any is.
    """
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = flags.join(marks, "doc_id", "left").select("doc_id", "digest", F.lit(1).alias("row"), "part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    firsts = flags.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").select("doc_id", "digest", F.lit(0).alias("row"), F.lit("").alias("part"), F.lit(0).alias("fails"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    # Ranges are balanced by a sample of their keys, so both sides are settled before.
    both = written(rows.unionByName(firsts), "audit-rows")
    ranged = both.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "row")
    return ranged.mapInArrow(_lists, "part string, " + ", ".join(f"{n} array<long>" for n in LISTS))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists of sorted rows; one of a text's smallest id stands right before its documents."""
    schema = pa.schema([("part", pa.string()), *((n, pa.list_(pa.int64())) for n in LISTS)])
    held, size, place, key = [], 0, 0, None

    def cut() -> Iterator[pa.RecordBatch]:
        part = pa.chunked_array([h[0] for h in held]).combine_chunks().dictionary_encode()
        codes = part.indices.to_numpy()
        at, bits = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        out = []
        for code in range(len(part.dictionary)):
            mine = np.flatnonzero(codes == code)
            out.append([at[mine], *(at[mine[bits[mine] >> k & 1 == 1]] for k in range(len(LISTS) - 1))])
        yield pa.record_batch([part.dictionary.cast(pa.string()), *(pa.array([o[k] for o in out], pa.list_(pa.int64())) for k in range(len(LISTS)))], schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, digests, is_row = batch["doc_id"].to_pylist(), batch["digest"].to_pylist(), batch["row"].to_numpy() == 1
        first = np.empty(batch.num_rows, bool)
        for k, pair in enumerate(zip(ids, digests, strict=True)):
            if not is_row[k]:
                key = pair
            first[k] = pair == key or pair[0] is None
        fails = batch["fails"].to_numpy() | (~first << FILTERS.index("E"))
        bits = (batch["good"].to_numpy() | batch["toxic"].to_numpy() << 1 | fails << 2)[is_row]
        held.append((batch["part"].filter(pa.array(is_row)), np.arange(place, place + len(bits)), bits))
        place += len(bits)
        size += len(bits)
        if size >= RANGE_ROWS:
            yield from cut()
            held, size = [], 0
    if size:
        yield from cut()


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of a sorted list lie in a longer one, and which of them it has; each step jumps by bisection."""
    at = np.searchsorted(long, short)
    return at, long[np.minimum(at, len(long) - 1)] == short if len(long) else np.zeros(len(short), bool)


def without(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The values of a sorted list that another hasn't."""
    if len(some) <= len(others):
        return some[~gallop(some, others)[1]]
    at, there = gallop(others, some)
    return np.delete(some, at[there])


def common(some: np.ndarray, others: np.ndarray) -> int:
    """Number of values that two sorted lists share."""
    short, long = (some, others) if len(some) <= len(others) else (others, some)
    return int(gallop(short, long)[1].sum())


def left_behind(lists: list[np.ndarray], own: int) -> dict[int, np.ndarray]:
    """What is left of list ``own`` behind the union of each set of the other lists, by the set's bits."""
    found = {0: lists[own]}
    for k in range(len(lists)):
        if k != own:
            found |= {mask | 1 << k: without(rest, lists[k]) for mask, rest in found.items()}
    return found


def removals(postings: DataFrame) -> DataFrame:
    """``removed``, ``good`` and ``toxic`` by ``part``, ``filter`` (its number) and ``before``, the bits of the filters in front of it."""
    schema = pa.schema([("part", pa.string()), ("filter", pa.int32()), ("before", pa.int32()), ("removed", pa.int64()), ("good", pa.int64()), ("toxic", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, rows = batch["part"].to_pylist(), []
            for k, part in enumerate(parts):
                good, toxic, *lists = (batch[n][k].values.to_numpy() for n in LISTS[1:])
                for own in range(len(lists)):
                    rows += [(part, own, mask, len(rest), common(rest, good), common(rest, toxic)) for mask, rest in left_behind(lists, own).items() if len(rest)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema)

    found = postings.mapInArrow(run, "part string, filter int, before int, removed long, good long, toxic long")
    return found.groupBy("part", "filter", "before").agg(F.sum("removed").alias("removed"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def _orders() -> Column:
    """Every order of the filters, a struct for each step."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, own in enumerate(order, 1):
            steps.append((*(FILTERS[k] for k in order), step, own, before))
            before |= 1 << own
    text = ",".join(f"('{''.join(s[:-3])}',{s[-3]},{s[-2]},{s[-1]})" for s in steps)
    return F.expr(f"inline(transform(array({text}), s -> struct(s.col1 as filter_order, s.col2 as step, s.col3 as filter, s.col4 as before)))")


def shapley_weight(before: int) -> int:
    """In how many orders exactly the filters of ``before`` stand in front of a given one."""
    n = before.bit_count()
    return factorial(n) * factorial(len(FILTERS) - 1 - n)


def audit(postings: DataFrame) -> DataFrame:
    """Counts for each ``part``, ``filter_order`` and ``step``, zeros included; see the module.

    ``kept`` documents are left after the step, ``removed`` go in it, ``redundant``
    fail its filter and went before, ``unique_fails`` fail it alone, ``good_lost`` and
    ``toxic_lost`` are the removed ones that are labelled so, and ``shapley`` is what the filter
    removes over all orders. An empty table has no parts and gives no rows.
    """
    sums = removals(postings)
    totals = postings.groupBy("part").agg(F.sum(F.size("every")).cast("long").alias("total"))
    weights = F.create_map(*(F.lit(x) for mask in range(1 << len(FILTERS)) for x in (mask, shapley_weight(mask) if mask.bit_count() < len(FILTERS) else 0)))
    others = F.expr(f"{(1 << len(FILTERS)) - 1} - shiftleft(1, filter)")
    own = sums.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("failing"),
        F.sum(F.when(F.col("before") == others, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * weights[F.col("before")]).alias("shapley"),
    )
    steps = totals.select("part", "total", _orders()).join(sums, ["part", "filter", "before"], "left").join(own, ["part", "filter"], "left")
    gone = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long")
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.coalesce(gone, F.lit(0))).cast("long").alias("kept"),
        zero("removed").alias("removed"),
        (zero("failing") - zero("removed")).alias("redundant"),
        zero("unique_fails").alias("unique_fails"),
        zero("good").alias("good_lost"),
        zero("toxic").alias("toxic_lost"),
        zero("shapley").alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = written(measured(table(spark, sf_dir, "documents")), "audit-flags")
    return audit(written(posting_lists(flags, table(spark, sf_dir, "labels")), "audit-postings"))


def _oracle() -> str:
    """The same counts from each document's set of failed filters."""
    case = " + ".join(f"CASE WHEN {x.lower()} THEN {1 << k} ELSE 0 END" for k, x in enumerate(FILTERS))
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, own in enumerate(order, 1):
            steps.append(f"('{''.join(FILTERS[k] for k in order)}',{step},{1 << own},{before})")
            before |= 1 << own
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             doc_id > min(doc_id) OVER (PARTITION BY text) AS e FROM d),
f AS (SELECT doc_id, part, coalesce(e, false) AS e, len(words) < {LEAST_WORDS} AS a,
             100 * len(list_distinct(words)) < {LEAST_DISTINCT_PERCENT} * len(words) AS b,
             100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_CAPITALS_PERCENT} * length(text) AS c,
             regexp_matches(text, '[{SYMBOLS.decode()}]') AS d FROM w),
m AS (SELECT part, {case} AS fails, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
      FROM f LEFT JOIN labels l ON f.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, fails),
s(filter_order, step, own, before) AS (VALUES {",".join(steps)}),
r AS (SELECT part, filter_order, step, own, CAST(sum(n) FILTER (WHERE fails & (before | own) = 0) AS BIGINT) AS kept,
             CAST(sum(n) FILTER (WHERE fails & own > 0 AND fails & before = 0) AS BIGINT) AS removed,
             CAST(sum(n) FILTER (WHERE fails & own > 0 AND fails & before > 0) AS BIGINT) AS redundant,
             CAST(sum(n) FILTER (WHERE fails = own) AS BIGINT) AS unique_fails,
             CAST(sum(g.good) FILTER (WHERE fails & own > 0 AND fails & before = 0) AS BIGINT) AS good_lost,
             CAST(sum(g.toxic) FILTER (WHERE fails & own > 0 AND fails & before = 0) AS BIGINT) AS toxic_lost
      FROM g CROSS JOIN s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
       coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r"""


QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLES = {"op12_filter_audit": _oracle()}

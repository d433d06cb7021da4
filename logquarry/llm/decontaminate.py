"""Benchmark decontamination by size-partitioned MinHash containment search.

Everything is DataFrame functions. An item's sketch holds its smallest shingle
hashes. Items are partitioned by size, and the size fixes how long the sketch
has to be: with ``n`` shingles of which at least ``ceil(0.8 n)`` must occur in a
document, any ``n - ceil(0.8 n) + 1`` of them hold one that occurs. So a search
for the sketch finds every document that can contain the item, and documents
with too few shingles for a size class are passed over. Candidate pairs are then
verified on the shingles themselves.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.shared import BROADCAST_IDS, bounded, id_and_text, table, written

SHINGLE = 5
#: Containment in percent, as whole numbers keep the bounds exact.
PERCENT = 80


def words_of(text: Column) -> Column:
    """Words of a text, with A-Z lower-cased; null for null."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, "[\\x20\\x09-\\x0D]+"), "")


def shingles(words: Column, size: int) -> Column:
    """The distinct shingles of ``size`` words as strings."""
    return F.when(
        F.size(words) >= size,
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.array_join(F.slice(words, i + 1, size), " "))),
    ).otherwise(F.array().cast("array<string>"))


def shingle_hashes(words: Column, size: int) -> Column:
    """A hash of each run of ``size`` words."""
    return F.when(
        F.size(words) >= size,
        F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)])),
    ).otherwise(F.array().cast("array<bigint>"))


def bound(value: Column, make) -> Column:
    """``make(value)`` with ``value`` as a lambda variable, so it is computed once a row even where the optimizer copies the expression into a filter."""
    return F.transform(F.array(value), make)[0]


def needed(n: Column) -> Column:
    """How many of ``n`` shingles a document must hold."""
    return F.floor((n * PERCENT + 99) / 100).cast("int")


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and an item of which it holds at least 80 % of the shingles.

    Columns: ``doc_id``, ``item_id``, ``n_shared``, ``n_item``, ``containment``.
    Words ignore the case of A-Z; a shingle is five words, and an item with
    fewer words is one shingle of them all. Items without words match nothing,
    like null and empty texts. Rows without an id can't be named and are left
    out; rows that repeat an id count as one document or item, at their best
    containment. Other columns aren't read.
    """
    spark = docs.sparkSession
    docs = id_and_text(docs, id_col, text_col).where("doc_id is not null and text is not null")
    items = items.select(F.col(item_col).cast("long").alias("item_id"), words_of(F.col(item_text_col).cast("string")).alias("words")).where("item_id is not null and size(words) > 0")
    items = items.select("item_id", "words", F.least(F.size("words"), F.lit(SHINGLE)).alias("k"))
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most five values
    if not sizes:
        return spark.createDataFrame([], "doc_id long, item_id long, n_shared long, n_item long, containment double")

    def by_size(make) -> Column:
        return F.coalesce(*[F.when(F.col("k") == k, make(F.col("words"), k)) for k in sizes])

    items = written(items.select("item_id", "words", "k", by_size(shingles).alias("item_shingles")), "decontaminate-items")
    hashed = written(items.select("item_id", "k", F.array_distinct(by_size(shingle_hashes)).alias("hashes")), "decontaminate-sketches")
    n = F.size("hashes")
    sketches = hashed.select(
        "item_id",
        F.floor(F.log2(n)).cast("int").alias("size_class"),
        F.explode(F.slice(F.array_sort("hashes"), F.lit(1), n - needed(n) + 1)).alias("hash"),
    )
    # A class holds items of 2**c to 2**(c+1)-1 shingles; this is the least that a document needs for any of them.
    sketches = sketches.withColumn("least", needed(F.pow(F.lit(2.0), F.col("size_class")).cast("int")))

    hashes = bound(words_of(F.col("text")), lambda words: F.concat(*[shingle_hashes(words, k) for k in sizes]))
    # An outer explode, as for an inner one the optimizer would compute the hashes once more in a filter.
    seen = docs.select("doc_id", F.explode_outer(hashes).alias("hash"))
    pairs = seen.join(bounded(sketches), "hash").groupBy("doc_id", "item_id").agg(F.min("least").alias("least"))
    pairs = written(pairs, "decontaminate-pairs")

    checked = docs.join(bounded(pairs), "doc_id").join(bounded(items.drop("words")), "item_id")
    shared = bound(words_of(F.col("text")), lambda words: F.when(F.size(words) >= F.col("least"), F.size(F.array_intersect(F.coalesce(*[F.when(F.col("k") == k, shingles(words, k)) for k in sizes]), F.col("item_shingles")))))
    checked = checked.select("doc_id", "item_id", shared.cast("long").alias("n_shared"), F.size("item_shingles").cast("long").alias("n_item"))
    checked = checked.where(F.col("n_shared") * 100 >= F.col("n_item") * PERCENT)
    best = checked.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("c"), "n_shared", "n_item")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shared", "b.n_item", F.round("b.c", 6).alias("containment"))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that contain an item; all columns stay.

    Items without an id count like others. Rows that repeat an id count as one
    document; rows without an id are judged each by itself, by a key that is
    written once.
    """
    items = written(items.select(F.monotonically_increasing_id().alias("item_id"), F.col("text").cast("string").alias("text")), "decontaminate-benchmark")
    found = contained_items(docs, items, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct()
    kept = docs.join(bounded(written(found, "decontaminate-ids"), BROADCAST_IDS), id_col, "left_anti")
    nameless = docs.where(F.col(id_col).isNull())
    if nameless.isEmpty():
        return kept
    rows = written(nameless.withColumn("_row", F.monotonically_increasing_id()), "decontaminate-nameless")
    held = written(contained_items(rows, items, "_row", text_col).select(F.col("doc_id").alias("_row")).distinct(), "decontaminate-rows")
    clean = rows.join(bounded(held, BROADCAST_IDS), "_row", "left_anti")
    return kept.where(F.col(id_col).isNotNull()).unionByName(clean.drop("_row"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLES = {
    "op5_decontaminate": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), bk AS (
  SELECT item_id, w, least(len(w), 5) AS k FROM b WHERE len(w) > 0
), bs AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk)
), ks AS (SELECT DISTINCT k FROM bk
), ds AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
), n AS (SELECT item_id, COUNT(*) AS n_item FROM bs GROUP BY item_id
), m AS (SELECT doc_id, item_id, COUNT(*) AS n_shared FROM ds JOIN bs USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) AS containment
FROM m JOIN n USING (item_id) WHERE n_shared * 100 >= n_item * 80
""",
}

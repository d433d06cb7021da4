"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by their encoded length; suffix sums over the lengths
then answer totals, quantiles and totals after truncation for every context
limit without another look at a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logquarry.llm.shared import id_and_text, table, written
from logquarry.llm.token_files import default_vocabulary, slices, word_encoder

#: Lengths summed in one window; the windows' totals are summed in a second one.
SPAN = 1024


def token_lengths(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``n_tokens`` for each input row; null and empty texts have none."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in batches:
            for some in slices(batch):
                yield pa.RecordBatch.from_arrays([some["doc_id"], pa.array(encoder.encode(some["text"])[1], pa.int64())], ["doc_id", "n_tokens"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """A row for each length that occurs, with its suffix sums.

    ``n_docs`` documents have ``n_tokens`` tokens; ``docs_at_least`` and
    ``tokens_at_least`` are of documents with as many or more; ``docs_at_most``
    and ``total_tokens`` give quantiles and the total; ``truncated_total`` is
    the total if texts are cut at ``n_tokens``. An empty table gives no rows.
    """
    counts = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("span", F.floor(F.col("n_tokens") / SPAN))
    spans = counts.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    # One row for each span that occurs: a few even where texts have millions of tokens.
    later = Window.orderBy(F.desc("span"))
    whole = Window.partitionBy()
    spans = spans.select("span", (F.sum("d").over(later) - F.col("d")).alias("d_later"), (F.sum("t").over(later) - F.col("t")).alias("t_later"), F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("total_tokens"))
    inside = Window.partitionBy("span").orderBy(F.desc("n_tokens"))
    joined = counts.join(spans, "span").select(
        "n_tokens",
        "n_docs",
        (F.col("d_later") + F.sum("n_docs").over(inside)).alias("docs_at_least"),
        (F.col("t_later") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside)).alias("tokens_at_least"),
        "all_docs",
        "total_tokens",
    )
    return joined.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
    )


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """``share`` and the smallest length that at least that share of the documents doesn't exceed."""
    all_docs = F.col("docs_at_most") + F.col("docs_at_least") - F.col("n_docs")
    least = [F.struct(F.lit(float(s)).alias("share"), F.min(F.when(F.col("docs_at_most") >= s * all_docs, F.col("n_tokens"))).alias("n_tokens")) for s in shares]
    return hist.agg(F.array(*least).alias("found")).select(F.inline("found")).where("n_tokens is not null")


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """``context`` and the tokens left if every text is cut there, for any limits."""
    sums = [F.struct(F.lit(int(x)).cast("long").alias("context"), F.sum(F.least(F.col("n_tokens"), F.lit(int(x))) * F.col("n_docs")).alias("tokens")) for x in limits]
    return hist.agg(F.array(*sums).alias("found")).select(F.inline("found")).where("tokens is not null")


def op3_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = written(token_lengths(table(spark, sf_dir, "documents")), "token-lengths")
    return histogram(lengths)


QUERIES = {"op3_length_histogram": op3_length_histogram}
ORACLES: dict[str, str] = {}

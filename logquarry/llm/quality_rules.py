"""Quality rules by repetition coverage.

Every text is measured in numpy: rolling hashes of 5- to 10-word n-grams give
the share of its word characters that lie inside n-grams seen earlier in the
same text, line hashes give the share inside repeated lines, and symbols are
set against words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logquarry.llm.arrays import IS_POINT, covered, ngram_hashes, recurring, seen_before, slice_hashes, word_spans
from logquarry.llm.shared import id_and_text, table

#: Largest share of word characters inside repeated n-grams, by n-gram length.
NGRAM_LIMITS = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
#: Largest share of word characters inside repeated lines.
LINE_LIMIT = 0.3
#: Most symbols a word.
SYMBOL_LIMIT = 0.2
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BASE_WINDOW = 3

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True

FIELDS = [
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()),
    ("ngram_coverage", pa.float64()),
    ("line_coverage", pa.float64()),
    ("kept", pa.bool_()),
]


def measure(text: str | None) -> tuple:
    """The values of ``FIELDS`` for one text; null and empty texts have no words and fail."""
    raw = (text or "").encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_spans(data)
    n = len(starts)
    if not n:
        return 0, 0, int(_IS_SYMBOL[data].sum()), 0, 0, True, 0.0, 0.0, False
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(IS_POINT[data], out=points[1:])
    widths = points[ends] - points[starts]
    chars, symbols = int(widths.sum()), int(_IS_SYMBOL[data].sum())

    breaks = np.flatnonzero(data == 10)
    first, last = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(data)]])
    low, high = np.searchsorted(starts, first), np.searchsorted(starts, last)
    worded = high > low
    again_line = seen_before(slice_hashes(data, first[worded], last[worded]))
    sums = np.concatenate([[0], np.cumsum(widths)])
    line_share = float((sums[high[worded]] - sums[low[worded]])[again_line].sum() / chars)

    words = slice_hashes(data, starts, ends)
    # Windows of BASE_WINDOW words that recur; a longer n-gram can only recur where all the windows inside it do.
    marks, size = recurring(ngram_hashes(words, BASE_WINDOW)), BASE_WINDOW
    repeats = int(covered(marks, BASE_WINDOW, n).sum())
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    worst, good = 0.0, True
    for longer, limit in NGRAM_LIMITS.items():
        at = np.flatnonzero(marks)
        at = at[at + longer <= n]
        at = at[marks[at + longer - size]]
        if not len(at):
            break
        hashes = slice_hashes(words, at, at + longer)
        again = at[seen_before(hashes)]
        marks, size = np.zeros(n - longer + 1, bool), longer
        marks[at[recurring(hashes)]] = True
        found = np.zeros(n, bool)
        found[again] = True
        share = float(widths[covered(found, longer, n)].sum() / chars)
        worst, good = max(worst, share), good and share <= limit
    good = good and line_share <= LINE_LIMIT and symbols <= SYMBOL_LIMIT * n
    return n, chars, symbols, int(again_line.sum()), repeats, failed, worst, line_share, good and not failed


def quality_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id`` and ``FIELDS``.

    Null and empty texts have zero counts, fail the base rule and aren't kept.
    A null id stays null, repeated rows are each measured, an empty table gives
    an empty result, and other columns aren't read.
    """
    schema = pa.schema([("doc_id", pa.int64()), *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(x) for x in batch["text"].to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in FIELDS]
            yield pa.record_batch([batch["doc_id"].cast(pa.int64()), *(pa.array(c, kind) for c, (_, kind) in zip(columns, FIELDS, strict=True))], schema)

    kinds = "long long long long long boolean double double boolean".split()
    ddl = "doc_id long, " + ", ".join(f"{name} {kind}" for (name, _), kind in zip(FIELDS, kinds, strict=True))
    return id_and_text(docs, id_col, text_col).mapInArrow(run, ddl)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns as they are."""
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([measure(x)[-1] for x in batch.column(where).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, StructType(docs.schema.fields))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = quality_measures(table(spark, sf_dir, "documents"))
    return measures.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("ngram_coverage", 6).alias("ngram_coverage"), F.round("line_coverage", 6).alias("line_coverage"))


QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLES: dict[str, str] = {}

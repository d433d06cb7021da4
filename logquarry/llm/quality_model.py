"""Quality classifier: random Fourier features over document statistics.

Statistics of whole texts are standardized and mapped to random Fourier features
that approximate a Gaussian kernel. Ridge scores come from normal equations
summed within partitions and then by matrix row. Isotonic regression over
binned scores of rows that the fit didn't see turns scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.arrays import IS_POINT, covered, ngram_hashes, recurring, seen_before, slice_hashes, word_spans
from logquarry.llm.shared import id_and_text, table, written

FEATURES = 256
#: Width of the Gaussian kernel, in standard deviations of a statistic and for all of them together.
WIDTH = 4.0
RIDGE = 1.0
SEED = 20
BINS = 2000
THRESHOLD = 0.3
FOLDS = 5

_CLASS = np.zeros((8, 256), bool)
_CLASS[0, list(b"#*$%&|<>")] = True
_CLASS[1, ord("A") : ord("Z") + 1] = True
_CLASS[2, ord("0") : ord("9") + 1] = True
_CLASS[3, list(b".,;:")] = True
_CLASS[4, list(b"!?")] = True
_CLASS[5, list(b"|")] = True
_CLASS[6, list(b"\"'()[]{}=_/\\+@~^`")] = True
_CLASS[7, 128:] = True

STATISTICS = 22


def statistics(text: str | None) -> np.ndarray:
    """Statistics of one text; all 0 for null and empty texts."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    starts, ends = word_spans(data)
    n, out = len(starts), np.zeros(STATISTICS)
    if not n:
        return out
    points = np.concatenate([[0], np.cumsum(IS_POINT[data])])
    widths = points[ends] - points[starts]
    chars = int(widths.sum())
    counts = np.bincount(data, minlength=256)
    out[:8] = np.log1p(20 * (_CLASS @ counts) / chars)
    words = slice_hashes(data, starts, ends)
    out[8] = np.log1p(n)
    out[9] = widths.mean()
    out[10] = widths.std()
    out[11] = np.log1p(widths.max())
    out[12] = (widths <= 3).mean()
    out[13] = (~seen_before(words)).sum() / n
    breaks = np.flatnonzero(data == 10)
    lines = len(breaks) + 1
    out[14] = np.log1p(n / lines)
    first, last = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(data)]])
    out[15] = np.sqrt(seen_before(slice_hashes(data, first, last)).sum() / lines)
    for k, size in ((16, 2), (17, 3), (18, 6)):
        if n >= size:
            out[k] = np.sqrt(covered(recurring(ngram_hashes(words, size)), size, n).mean())
    out[19] = counts[10] / len(data)
    out[20] = np.sqrt((_CLASS[1][data[starts]]).mean())
    out[21] = np.sqrt(np.log1p(20 * max(counts[ord(c)] for c in "#*$%&|<>!") / n))
    return out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``x`` (array of double) for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch["text"].to_pylist()]
            flat = np.concatenate(rows) if rows else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * STATISTICS, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists], ["doc_id", "x"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, x array<double>")


class Features:
    """Standardized statistics and their random Fourier features, with a constant first."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.waves = rng.normal(size=(STATISTICS, FEATURES)) / WIDTH
        self.shifts = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / FEATURES) * np.cos(z @ self.waves + self.shifts)])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


class Model:
    """Ridge weights over random features, and the calibration's steps."""

    def __init__(self, features: Features, weights: np.ndarray, edges: np.ndarray, values: np.ndarray):
        self.features, self.weights, self.edges, self.values = features, weights, edges, values

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.values)


def isotonic(counts: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """Non-decreasing rates closest to ``positives / counts``, by pooling neighbours that are out of order."""
    pools: list[list[float]] = []
    for n, p in zip(counts.tolist(), positives.tolist(), strict=True):
        pools.append([n, p, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n1, p1, k1 = pools.pop()
            pools[-1] = [pools[-1][0] + n1, pools[-1][1] + p1, pools[-1][2] + k1]
    return np.concatenate([np.full(int(k), p / n) for n, p, k in pools])


def fit(labelled: DataFrame) -> Model:
    """Fit to rows of ``x`` (statistics), ``y`` (0 or 1) and ``part`` (0: weights, 1: calibration).

    Without rows, or with one class only, the scores are constant.
    """
    moments = labelled.select(F.posexplode("x").alias("k", "v"), "y").groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.avg("y").alias("y")).collect()
    mean, deviation = np.zeros(STATISTICS), np.ones(STATISTICS)
    for r in moments:
        mean[r["k"]], deviation[r["k"]] = r["m"], r["s"]
    features, rate = Features(mean, deviation), (moments[0]["y"] if moments else 0.5)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z, y = features(_matrix(batch["x"])), batch["y"].to_numpy(zero_copy_only=False).astype(float)
            total += z.T @ np.hstack([z, y[:, None]])
        if total[0, 0]:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(FEATURES + 2) * (FEATURES + 2), pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(range(FEATURES + 1), pa.int32()), lists], ["i", "v"])

    def add(group: pa.Table) -> pa.Table:
        row = group["v"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES + 2).sum(axis=0)
        return pa.table({"i": group["i"][:1], "v": pa.array([row], pa.list_(pa.float64()))})

    summed = labelled.where("part = 0").select("x", "y").mapInArrow(sums, "i int, v array<double>").groupBy("i").applyInArrow(add, "i int, v array<double>")
    rows = {r["i"]: r["v"] for r in summed.collect()}  # one row for each feature
    if not rows:
        return Model(features, np.zeros(FEATURES + 1), np.array([0.0]), np.array([rate]))
    system = np.array([rows[i] for i in range(FEATURES + 1)])
    ridge = np.eye(FEATURES + 1) * RIDGE
    ridge[0, 0] = 1e-6
    weights = np.linalg.solve(system[:, :-1] + ridge, system[:, -1])
    raw = Model(features, weights, np.array([0.0]), np.array([rate])).raw

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip(np.floor((raw(_matrix(batch["x"])) + 0.5) * BINS / 2), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch["y"].cast(pa.int32())], ["bin", "y"])

    binned = labelled.where("part = 1").select("x", "y").mapInArrow(bins, "bin int, y int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    found = sorted((r["bin"], r["n"], r["p"]) for r in binned.collect())  # at most BINS rows
    if not found:
        return Model(features, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    at, n, p = (np.array(c, float) for c in zip(*found, strict=True))
    return Model(features, weights, (at + 0.5) * 2 / BINS - 0.5, isotonic(n, p))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for each input row.

    Labels of rows whose crc32(id) mod 5 is 0 are never learnt from. Null labels
    and labels without a text are passed over, repeated ones count each. Null
    and empty texts are scored by their all-zero statistics. Rows without an id
    aren't held out.
    """
    stats = written(document_statistics(docs, id_col, text_col), "quality-statistics")
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").withColumn("fold", fold).where("fold <> 0")
    labelled = written(stats.join(known, "doc_id").select("x", "y", F.when(F.col("fold") == 1, 1).otherwise(0).alias("part")), "quality-labelled")
    model = fit(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(_matrix(batch["x"])), pa.float64())], ["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_quality_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_quality_rff": op7_quality_rff}
ORACLES: dict[str, str] = {}

"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs, drawn from its code point. A window of
letters is bound to one vector: the product of its letters' vectors, each turned
by its place. A document is the bundle of its windows, a language the bundle of
its documents, each of weight one. What all languages share is taken away, and a
document gets the language whose profile has the greatest cosine with it.

Sums are of whole numbers, so a profile doesn't depend on how rows lie in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.shared import table, written
from logquarry.llm.token_files import slices

#: Signs in a vector, letters in a window.
SIZE, WINDOW = 1024, 3
#: A document's weight, dealt to its windows and rounded to whole numbers.
WEIGHT = 1 << 24
#: Languages that profiles are made for; ISO 639-3 has some 7,900. More are refused.
MOST_LANGUAGES = 8192
#: Distinct windows that a task keeps while it learns, and those bound side by side.
HELD_WINDOWS, BOUND_WINDOWS = 1 << 18, 1 << 13
UNKNOWN = "und"


@lru_cache(maxsize=4096)
def letter_vector(point: int) -> np.ndarray:
    """The random signs of one code point; 0, the gap between words, has its own."""
    return (np.random.default_rng([13, point]).integers(0, 2, SIZE, np.int8) << 1) - 1


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)


def bound(windows: np.ndarray) -> np.ndarray:
    """A vector of signs for each window (its code points in the three lowest fields of 21 bits)."""
    signs = None
    for place in range(WINDOW):
        points, which = np.unique(windows >> (21 * place) & 0x1FFFFF, return_inverse=True)
        turned = np.roll(np.array([letter_vector(p) for p in points.tolist()]), place, axis=1)[which]
        signs = turned if signs is None else signs * turned
    return signs


def window_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, window and times of each distinct window of each text, by number and window.

    Letters are lower-cased; every stretch of other characters is one gap, and a gap stands at both ends.
    A text without a letter has no windows.
    """
    lowered = [(t or "").lower() for t in texts]
    data = np.frombuffer("\n".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    # Line feeds between texts are gaps too, so each text but the first follows one.
    points = np.concatenate([[0], np.where(letters()[data], data, 0), [0]])
    docs = np.repeat(np.arange(len(lowered)), [len(t) + 1 for t in lowered])
    kept = np.flatnonzero((points[1:] != 0) | (points[:-1] != 0)) + 1
    found = np.flatnonzero(np.bincount(points))
    number = np.zeros(found[-1] + 1, np.int64)
    number[found] = np.arange(len(found))
    codes = np.concatenate([[0], number[points[kept]]])
    middle = np.flatnonzero(codes[1:-1] != 0)
    # Under 2**63 for any letters: at most 2,000 rows lie in a batch, and there are some 140,000 letters.
    size = len(found)
    windows = (codes[middle] * size + codes[middle + 1]) * size + codes[middle + 2]
    both, times = np.unique(docs[kept[middle] - 1] * size**WINDOW + windows, return_counts=True)
    row, window = np.divmod(both, size**WINDOW)
    return row, found[window // size**2] << 42 | found[window // size % size] << 21 | found[window % size], times


def weights(docs: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    """The share of each window in its document, in whole parts of ``WEIGHT``."""
    total = np.bincount(docs, times, n)
    return np.rint(times * WEIGHT / total[docs]).astype(np.int64)


def document_vectors(texts: list[str | None]) -> np.ndarray:
    """The bundle of each text, a row each; zeros for a text without letters."""
    docs, windows, times = window_counts(texts)
    out = np.zeros((len(texts), SIZE), np.float32)
    distinct, code = np.unique(windows, return_inverse=True)
    for a in range(0, len(distinct), BOUND_WINDOWS):
        signs = bound(distinct[a : a + BOUND_WINDOWS])
        some = np.flatnonzero((code >= a) & (code < a + BOUND_WINDOWS))
        cuts = np.flatnonzero(np.diff(docs[some], prepend=-1))
        for b, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(some)], strict=True):
            rows = some[b:e]
            out[docs[rows[0]]] += times[rows].astype(np.float32) @ signs[code[rows] - a].astype(np.float32)
    return out


def language_sums(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang``, ``place`` and ``total``: the bundle of each language's documents, place by place.

    Tasks bundle their documents first and give one vector for each language they
    meet. Rows without a language, a text or a letter teach nothing.
    """
    schema = pa.schema([("lang", pa.string()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        sums: dict[str, np.ndarray] = {}
        size = 0

        def bundle() -> None:
            for lang, pieces in held.items():
                distinct, code = np.unique(np.concatenate([p[0] for p in pieces]), return_inverse=True)
                shares = np.zeros(len(distinct), np.int64)
                np.add.at(shares, code, np.concatenate([p[1] for p in pieces]))
                total = sums.setdefault(lang, np.zeros(SIZE, np.int64))
                for a in range(0, len(distinct), BOUND_WINDOWS):
                    total += shares[a : a + BOUND_WINDOWS] @ bound(distinct[a : a + BOUND_WINDOWS]).astype(np.int64)
            held.clear()

        for batch in batches:
            for some in slices(batch):
                langs = some["lang"].to_pylist()
                docs, windows, times = window_counts(some["text"].to_pylist())
                shares = weights(docs, times, len(langs))
                numbers = {lang: k for k, lang in enumerate(dict.fromkeys(langs))}
                codes = np.array([numbers[x] for x in langs])[docs]
                for lang, k in numbers.items():
                    mine = codes == k
                    distinct, code = np.unique(windows[mine], return_inverse=True)
                    total = np.zeros(len(distinct), np.int64)
                    np.add.at(total, code, shares[mine])
                    held.setdefault(lang, []).append((distinct, total))
                    size += len(distinct)
                if size > HELD_WINDOWS:
                    bundle()
                    size = 0
        bundle()
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))], schema)

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    found = rows.mapInArrow(run, "lang string, sums array<long>")
    return found.select("lang", F.posexplode("sums").alias("place", "part")).groupBy("lang", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))


def profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """The languages in order and a unit vector for each: its bundle without the mean of all languages.

    A language whose documents have no letter isn't learned. What comes to the
    driver is a vector for each language, for ``MOST_LANGUAGES`` at most.
    """
    sums = written(language_sums(docs, lang_col, text_col).groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "total"))), lambda x: x["total"].cast("double")).alias("sums")), "language-sums")
    if sums.count() > MOST_LANGUAGES:
        raise ValueError(f"profiles are made for {MOST_LANGUAGES} languages at most")
    rows = sorted((r["lang"], np.array(r["sums"])) for r in sums.collect() if any(r["sums"]))
    if not rows:
        return [], np.zeros((0, SIZE), np.float32)
    every = np.array([v / np.linalg.norm(v) for _, v in rows])
    centred = every - every.mean(axis=0) if len(rows) > 1 else every
    norms = np.linalg.norm(centred, axis=1, keepdims=True)
    return [lang for lang, _ in rows], (centred / np.where(norms > 1e-9, norms, 1)).astype(np.float32)


def identify(docs: DataFrame, languages: list[str], vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score``, a row for each input row.

    ``score`` is the cosine of the document and the profile, 0 where it is
    negative. Null texts, texts without a letter and all texts where no language was
    learned get ``und`` and 0. Ties go to the language that sorts first. A null id stays
    null, repeated rows are each worked on, and other columns aren't read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    known = docs.sparkSession.sparkContext.broadcast((languages, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, protos = known.value
        for batch in batches:
            for some in slices(batch):
                found = document_vectors(some["text"].to_pylist())
                norms = np.linalg.norm(found, axis=1)
                best, score = [UNKNOWN] * len(found), np.zeros(len(found))
                if len(names):
                    cosines = np.round((found / np.where(norms > 0, norms, 1)[:, None]) @ protos.T, 6)
                    top = cosines.argmax(axis=1)
                    score = np.where(norms > 0, np.clip(cosines[np.arange(len(found)), top], 0, 1), 0).astype(np.float64)
                    best = [names[k] if norm > 0 else UNKNOWN for k, norm in zip(top.tolist(), norms.tolist(), strict=True)]
                yield pa.record_batch([some["doc_id"], pa.array(best, pa.string()), pa.array(score, pa.float64())], schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the decimal id leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    languages, vectors = profiles(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, languages, vectors).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op13_language_id": op13_language_id}
ORACLES: dict[str, str] = {}

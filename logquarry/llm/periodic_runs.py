"""Periodic runs of words by suffix trees of a text and of its reversal.

A run is a maximal stretch of words that repeats with a smallest period. The
words of a document are numbered; stretches that can hold a run go into a
suffix tree built online and into one of the reversed stretch. A tour around a
tree, with block minima over its string depths, answers how far two suffixes
agree in constant time. Each run's period is the length of a longest Lyndon word
at some position in one of the two orders of the alphabet, so these words are the
candidates, and they are extended to both sides.

A run of ``length >= max(6, 4 * period)`` holds each of its three-word windows
three times or more. What lies between such windows can't be part of a run, so it
isn't put into a tree: that is exact, and prose needs nearly no tree at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.shared import id_and_text, table
from logquarry.llm.token_files import slices

#: A run has at least so many words, and so many of its periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Width of the windows that a run repeats, and how often at least.
WINDOW, WINDOW_TIMES = 3, 3
#: Words that short stretches are put together to, each behind a mark of its own.
TREE_WORDS = 20_000
#: Depths in one block of the tour.
BLOCK = 16

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.large_string())])


class SuffixTree:
    """Suffix tree of ``symbols`` (each above 0), grown symbol by symbol; the end is a symbol 0 of its own.

    ``agreement`` tells how far suffixes agree and ``rank`` puts them in order.
    """

    def __init__(self, symbols: np.ndarray):
        text = [*symbols.tolist(), 0]
        self.size = len(text)
        self.width = int(symbols.max(initial=0)) + 1
        self._grow(text)
        self._tour()

    def _grow(self, text: list[int]) -> None:
        """Nodes in the order of their making: where the label of the edge above begins and ends, and the suffix of a leaf."""
        n, width = self.size, self.width
        begin, end, suffix, link, child = [0], [0], [-1], [0], {}
        node = reach = pending = 0
        for at, symbol in enumerate(text):
            pending += 1
            inner = 0  # the inner node that still lacks its link
            while pending:
                key = node * width + (text[at - reach] if reach else symbol)
                below = child.get(key)
                if below is None:
                    child[key] = len(begin)
                    begin.append(at), end.append(n), suffix.append(at - pending + 1), link.append(0)
                    top = node
                else:
                    first = begin[below]
                    long = end[below] - first
                    if reach >= long and end[below] < n:
                        node, reach = below, reach - long
                        continue
                    if text[first + reach] == symbol:
                        if inner:
                            link[inner] = node
                        reach += 1
                        break
                    top = len(begin)
                    begin.append(first), end.append(first + reach), suffix.append(-1), link.append(0)
                    child[key] = top
                    begin[below] = first + reach
                    child[top * width + text[first + reach]] = below
                    child[top * width + symbol] = len(begin)
                    begin.append(at), end.append(n), suffix.append(at - pending + 1), link.append(0)
                if inner:
                    link[inner] = top
                inner = top
                pending -= 1
                if node:
                    node = link[node]
                elif reach:
                    reach -= 1
        self._begin, self._end, self._suffix = begin, end, suffix
        self._keys = np.fromiter(child.keys(), np.int64, len(child))
        self._nodes = np.fromiter(child.values(), np.int64, len(child))

    def _below(self, keys: np.ndarray) -> tuple[list[int], list[int]]:
        """Children by parent in the order of ``keys``, and where those of each parent begin."""
        order = np.argsort(keys)
        counts = np.bincount(self._keys // self.width, minlength=len(self._begin))
        return self._nodes[order].tolist(), np.concatenate([[0], np.cumsum(counts)]).tolist()

    def _tour(self) -> None:
        """Tour around the tree: the string depth at each step, and the step and rank of each suffix."""
        nodes, first = self._below(self._keys)
        begin, end, suffix = self._begin, self._end, self._suffix
        depth, steps, step_of, rank = [0] * len(begin), [], [0] * self.size, [0] * self.size
        stack, leaves = [0], 0
        while stack:
            node = stack.pop()
            if node < 0:
                steps.append(depth[~node])
                continue
            deep = depth[node]
            leaf = suffix[node]
            if leaf >= 0:
                step_of[leaf], rank[leaf] = len(steps), leaves
                leaves += 1
            steps.append(deep)
            for k in range(first[node + 1] - 1, first[node] - 1, -1):
                below = nodes[k]
                depth[below] = deep + end[below] - begin[below]
                stack += (~node, below)
        self.rank, self._step_of = np.array(rank), np.array(step_of)
        count = -(-len(steps) // BLOCK) * BLOCK
        self._steps = np.full(count, self.size, np.int32)
        self._steps[: len(steps)] = steps
        rows = self._steps.reshape(-1, BLOCK)
        self._left = np.minimum.accumulate(rows, axis=1).ravel()
        self._right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self._least = [rows.min(axis=1)]
        while 2 * (width := 1 << (len(self._least) - 1)) <= len(rows):
            last = self._least[-1]
            self._least.append(np.minimum(last[:-width], last[width:]))

    def other_rank(self) -> np.ndarray:
        """Rank of each suffix where the order of symbols is turned round and the end stays first."""
        parent, symbol = np.divmod(self._keys, self.width)
        nodes, first = self._below(parent * self.width + (self.width - symbol) % self.width)
        suffix, rank, stack, leaves = self._suffix, [0] * self.size, [0], 0
        while stack:
            node = stack.pop()
            if suffix[node] >= 0:
                rank[suffix[node]] = leaves
                leaves += 1
            else:
                stack += nodes[first[node] : first[node + 1]][::-1]
        return np.array(rank)

    def agreement(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``one`` and at ``two``, pair by pair; the two differ."""
        a, b = self._step_of[one], self._step_of[two]
        a, b = np.minimum(a, b), np.maximum(a, b)
        low, high = a // BLOCK, b // BLOCK
        least = np.minimum(self._right[a], self._left[b])
        far = np.flatnonzero(high - low > 1)
        if len(far):
            x, y = low[far] + 1, high[far]
            level = np.frexp((y - x).astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                some = far[level == k]
                row = self._least[k]
                least[some] = np.minimum(least[some], np.minimum(row[low[some] + 1], row[high[some] - (1 << k)]))
        near = np.flatnonzero(high == low)
        if len(near):
            at = a[near, None] + np.arange(BLOCK)
            least[near] = np.where(at <= b[near, None], self._steps[np.minimum(at, len(self._steps) - 1)], self.size).min(axis=1)
        return least


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each position the next one of smaller rank, or the length: there the longest Lyndon word at the position ends."""
    found, open_ = [len(rank)] * len(rank), []
    for at, value in enumerate(rank.tolist()):
        while open_ and open_[-1][1] > value:
            found[open_.pop()[0]] = at
        open_.append((at, value))
    return np.array(found)


def tree_runs(symbols: np.ndarray) -> np.ndarray:
    """Rows of start, length and period of each run in ``symbols`` (each above 0)."""
    n = len(symbols)
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    starts, ends = [], []
    for rank in (ahead.rank, ahead.other_rank()):
        starts.append(np.arange(n))
        ends.append(next_smaller(rank)[:n])
    i, j = np.concatenate(starts), np.concatenate(ends)
    period = j - i
    some = (j < n) & (LEAST_PERIODS * period <= n)
    i, j, period = i[some], j[some], period[some]
    last = j + ahead.agreement(i, j)
    first = i.copy()
    inner = np.flatnonzero(i > 0)
    first[inner] -= back.agreement(n - i[inner], n - j[inner])
    length = last - first
    some = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    return np.unique(np.stack([first[some], period[some], length[some]], axis=1), axis=0)[:, [0, 2, 1]]


def stretches(symbols: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of the stretches outside which no run can be."""
    n = len(symbols)
    if n < LEAST_WORDS:
        return []
    times = np.bincount(symbols)
    some = times[symbols] >= LEAST_PERIODS
    alive = np.flatnonzero(some[:-2] & some[1:-1] & some[2:])
    while True:
        if not len(alive):
            return []
        ordered = np.stack([symbols[alive], symbols[alive + 1], symbols[alive + 2]])
        pair = np.unique(ordered[0].astype(np.int64) * (len(times) + 1) + ordered[1], return_inverse=True)[1]
        _, which, count = np.unique(pair * (len(times) + 1) + ordered[2], return_inverse=True, return_counts=True)
        kept = alive[count[which] >= WINDOW_TIMES]
        cuts = np.flatnonzero(np.diff(kept) != 1) + 1
        groups = list(zip(kept[np.concatenate([[0], cuts])].tolist(), kept[np.concatenate([cuts, [len(kept)]]) - 1].tolist(), strict=True)) if len(kept) else []
        long = [(a, b + WINDOW) for a, b in groups if b + WINDOW - a >= LEAST_WORDS]
        left = sum(b - a - WINDOW + 1 for a, b in long)
        if left == len(alive):
            return long
        alive = np.concatenate([np.arange(a, b - WINDOW + 1) for a, b in long]) if long else np.zeros(0, np.int64)


def runs_of(words: list[bytes]) -> np.ndarray:
    """Rows of start, length and period of every run in ``words``, by start, then period."""
    numbers: dict[bytes, int] = {}
    symbols = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    found, batch, size = [], [], 0
    todo = stretches(symbols)
    for k, (a, b) in enumerate(todo):
        batch.append((a, b))
        size += b - a
        if size >= TREE_WORDS or k + 1 == len(todo):
            # Marks above all words stand between stretches; each occurs once, so no run crosses one.
            places = np.concatenate([np.append(np.arange(x, y), -1) for x, y in batch])
            used = np.where(places >= 0, symbols[places], 0)
            _, dense = np.unique(used, return_inverse=True)
            dense = dense + 1
            marks = np.flatnonzero(places < 0)
            dense[marks] = dense.max() + 1 + np.arange(len(marks))
            rows = tree_runs(dense)
            rows[:, 0] = places[rows[:, 0]]
            found.append(rows)
            batch, size = [], 0
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(found)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapse(words: list[bytes], runs: np.ndarray) -> str:
    """The words that no run repeats, joined by a space."""
    if len(runs):
        steps = np.zeros(len(words) + 1, np.int64)
        np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
        np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
    return b" ".join(words).decode("utf-8", "replace")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``, a row for each input row.

    Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``. Null and empty texts
    have no words, no runs and an empty ``collapsed``. A null id stays null,
    repeated rows are each worked on, an empty table gives no rows, and other
    columns aren't read. Texts are whole, whatever their length: memory grows
    with the longest stretch that may hold a run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                sizes, starts, rows, texts = [], [0], [], []
                for text in some["text"].to_pylist():
                    words = (text or "").encode("utf-8", "replace").split()
                    found = runs_of(words)
                    sizes.append(len(words))
                    starts.append(starts[-1] + len(found))
                    rows.append(found)
                    texts.append(collapse(words, found))
                every = np.concatenate(rows)
                flat = pa.StructArray.from_arrays([pa.array(every[:, k], pa.int64()) for k in range(3)], fields=list(RUN))
                runs = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), flat)
                yield pa.record_batch([some["doc_id"], pa.array(sizes, pa.int64()), runs, pa.array(texts, pa.large_string())], SCHEMA)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def looped(doc_id: Column, text: Column) -> Column:
    """The text as the contract alters it: with h = crc32 of the decimal id and g = h div 10, a tenth of the texts
    (h mod 10 = 0) repeat p = 1 + (n - a) div (3 + g mod 8) words from word a = g mod n on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def altered(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        rest = n - a
        p = (1 + F.floor(rest / (3 + g % 8))).cast("int")
        again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil(rest / p).cast("int"))), F.lit(1), rest)
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")).otherwise(F.lit(""))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # The words are split once: a lambda over one array binds them to a name.
    return F.when(h % 10 == 0, F.transform(F.array(words), altered)[0]).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")))
    # The greatest length, then the smallest start, then the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("*", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLES: dict[str, str] = {}

"""Personal data: exact patterns, and a linear-chain conditional random field that adds to them.

The field labels words by features of their shape. It is trained in numpy from
a small labelled table that is made here by rule, and decodes by Viterbi over
many word windows at once. A word without digits, ``@``, ``+``, ``=`` or quotes
whose neighbours are alike is proven to be outside every span (its margin
exceeds whatever transitions can gain), so only windows around other words are
decoded; if a trained field lacks that margin, every word is.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logquarry.llm.shared import id_and_text, table

KINDS = ["email", "ip", "card", "phone"]
#: Kinds that only the field finds come after the base kinds.
ALL_KINDS = [*KINDS, "secret"]
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A start inside a run of digits can't match where the run's start failed.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

LABELS = ["O"] + [f"{p}-{k}" for k in ALL_KINDS for p in "BI"]
TRAINING_ROWS = 400
ROUNDS = 100
#: Words on either side of a triggering word that its window takes in.
REACH = 2
#: Windows that are decoded side by side, the words they may have together once padded, and the words of each that are scored at a time.
SIDE_BY_SIDE = 512
PADDED_WORDS = 1 << 20
STEPS = 64
NONE = -1e9


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``EMAIL`` in time proportional to the text, however long its runs of word characters."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the exact patterns, by start and then by kind."""
    found = []
    if "@" in text:
        found += [(a, b, "email") for a, b in _emails(text)]
    if not DIGIT.search(text):
        return found
    if "." in text:
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# Features


def core(word: str) -> str:
    """The word without punctuation around it that can't belong to a value."""
    return word.strip("\"'`,;:!?<>[]{}|*#$%&=~").rstrip(".")


def shape(word: str) -> str:
    """Runs of digits as ``d`` and of letters as ``a``, other characters as they are, at most eight parts."""
    text = re.sub(r"[^\W\d_]+", "a", core(word))
    return re.sub(r"(.)\1{2,}", r"\1\1", re.sub(r"\d+", "d", text))[:16] or "-"


def features(word: str) -> list[str]:
    """Shape features of one word."""
    inner = core(word)
    digits = digits_of(inner)
    n = len(digits)
    size = next(k for k, top in enumerate((0, 1, 3, 4, 8, 11, 12, 15, 19, 10**9)) if n <= top)
    pure = len(inner) == n and n > 0
    out = ["bias", f"shape={shape(word)}", f"digits={size}", f"pure={pure},{size}"]
    if "@" in inner:
        out.append(f"mail={bool(EMAIL.fullmatch(inner))}")
    if n >= 12 and pure:
        out.append(f"luhn={12 <= n <= 19 and luhn(digits)}")
    if inner.count(".") == 3 and (m := IP.fullmatch(inner)):
        out.append(f"ip={all(len(p) <= 3 and int(p) <= 255 for p in m[0].split('.'))}")
    if len(inner) >= 20 and re.fullmatch(r"[0-9a-fA-F]+", inner) and not pure:
        out.append("hex")
    if inner.startswith("+"):
        out.append("plus")
    if "(" in word or ")" in word:
        out.append("round")
    return out


def context(word: str) -> str:
    """What a neighbour sees of a word."""
    inner = core(word)
    if not DIGIT.search(inner) and "@" not in inner:
        return "=" if word == "=" else ("plain" if inner else "sign")
    return shape(word)


#: Also brackets and long runs of hexadecimal letters, as features of their own.
TRIGGER = re.compile(r"[\d@+=\"()]|[A-Fa-f]{20}")


# The labelled table


def training_table(rows: int = TRAINING_ROWS, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of lines put together by rule from a fixed seed."""
    rng = random.Random(seed)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def plain() -> str:
        word = "".join(rng.choice("abcdefghilmnoprstuvz") for _ in range(rng.randint(2, 12)))
        return rng.choice([word, word, word.title(), word.upper()]) + rng.choice(["", "", "", ",", ".", "***", "$$$", "!!", "%%%"])

    def card(good: bool) -> str:
        while True:
            value = num(rng.choice([12, 13, 15, 16, 16, 16, 19]))
            if luhn(value) == good and value[0] != "0":
                return value

    def address() -> str:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def mail() -> str:
        return f"{plain().strip('.,*$!%').lower()}.{num(2)}@{rng.choice(['mail', 'post', 'host'])}{num(1)}.example.{rng.choice(['com', 'org', 'net'])}"

    def hexed() -> str:
        return "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([24, 32, 40])))

    def value() -> tuple[list[str], str]:
        kind = rng.choice([*ALL_KINDS, "none", "none", "none"])
        if kind == "email":
            return [mail() if rng.random() < 0.8 else f"{num(3)}@{plain().strip('.,*$!%').lower()}.example.org"], kind
        if kind == "ip":
            return [address()], kind
        if kind == "card":
            return [card(True)], kind
        if kind == "phone":
            one = [f"+{num(1)}", f"({num(3)})", f"{num(3)}-{num(4)}"]
            return rng.choice([one, one, [f"+{num(2)}", num(3), num(7)], [f"+{num(11)}"], [f"+{num(1)}-{num(3)}-{num(3)}-{num(4)}"]]), kind
        if kind == "secret":
            return ["token", "=", f'"{hexed()}"'], kind
        none = [num(rng.randint(1, 11)), card(False), f"{num(1)}.{num(1)}", f"{num(4)}-{num(2)}-{num(2)}", f"{rng.randint(300, 999)}.{num(3)}.{num(2)}.{num(1)}", f"({num(2)})", f'"{plain()}"', "=", f"{num(2)}%", f"a{num(3)}", f"@{plain()}", "+", f"{num(3)}-{num(4)}"]
        return [rng.choice(none)], "none"

    out = []
    for _ in range(rows):
        words, labels = [], []
        for _ in range(rng.randint(1, 3)):
            lead = [plain() for _ in range(rng.randint(1, 4))]
            words += lead
            labels += ["O"] * len(lead)
            got, kind = value()
            tags = ["O"] * len(got)
            if kind == "secret":
                tags[-1] = "B-secret"
            elif kind != "none":
                tags = [f"B-{kind}"] + [f"I-{kind}"] * (len(got) - 1)
            if rng.random() < 0.3:
                got[-1] += rng.choice([",", ".", "***", "%%%", "!!"])
            words += got
            labels += tags
        tail = [plain() for _ in range(rng.randint(0, 3))]
        out.append((words + tail, labels + ["O"] * len(tail)))
    return out


class Field:
    """The trained weights: ``own``, ``left`` and ``right`` by feature, and ``moves`` between labels."""

    def __init__(self, own: dict, left: dict, right: dict, moves: np.ndarray):
        self.own, self.left, self.right, self.moves = own, left, right, moves
        self.zero = np.zeros(len(LABELS))
        self.seen: dict[str, tuple] = {}
        gains = 2 * (self.moves.max() - self.moves[self.moves > NONE / 2].min())
        worst = min(min((own + a + b) @ margin for own in self._plain() for a in self._sides(self.left) for b in self._sides(self.right)) for margin in self._margins())
        #: Whether a word without a trigger is outside every span where the words beside it have none either, as at a window's end.
        self.windowed = worst > gains

    def _margins(self) -> Iterator[np.ndarray]:
        for k in range(1, len(LABELS)):
            step = np.zeros(len(LABELS))
            step[0], step[k] = 1, -1
            yield step

    def _plain(self) -> list[np.ndarray]:
        """The emissions of all sets of features that a word without a trigger can have."""
        shapes = [self.zero, *(w for f, w in self.own.items() if f.startswith("shape=") and not re.search(r"[d@+=\"()]", f[6:]))]
        fixed = sum((self.own.get(f, self.zero) for f in ("bias", "digits=0", "pure=False,0")), self.zero)
        return [fixed + a for a in shapes]

    def _sides(self, table_: dict) -> list[np.ndarray]:
        return [self.zero, *(table_.get(c, self.zero) for c in ("plain", "sign"))]

    def emission(self, word: str) -> np.ndarray:
        return self.word(word)[0]

    def word(self, word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores that a word gives itself, the word after it and the word before it."""
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            what = context(word)
            own = sum((self.own[f] for f in features(word) if f in self.own), self.zero)
            got = self.seen[word] = own, self.left.get(what, self.zero), self.right.get(what, self.zero)
        return got

    def scores(self, windows: list[list[str]], low: int, high: int) -> np.ndarray:
        """Emissions of the words at ``low`` to ``high`` of each window, padded with zeros."""
        out = np.zeros((len(windows), high - low, len(LABELS)))
        for k, words in enumerate(windows):
            some = words[max(low - 1, 0) : high + 1]
            if len(words) <= low:
                continue
            own, left, right = (np.array(x) for x in zip(*map(self.word, some), strict=True))
            skip, size = min(low, 1), min(len(words), high) - low
            out[k, :size] = own[skip : skip + size]
            before, after = left[: skip + size - 1], right[skip + 1 :]
            out[k, 1 - skip : size] += before
            out[k, : len(after)] += after
        return out

    def decode(self, windows: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each window, with ``O`` around it.

        Emissions are made for ``STEPS`` words of each window at a time, so that
        only a byte a label is kept for every word of long windows.
        """
        if not windows:
            return []
        lengths = np.array([len(w) for w in windows])
        n, steps = len(windows), int(lengths.max())
        back = np.zeros((steps, n, len(LABELS)), np.int8)
        best = last = np.zeros((n, len(LABELS)))
        for low in range(0, steps, STEPS):
            high = min(low + STEPS, steps)
            scores = self.scores(windows, low, high)
            for t in range(low, high):
                if t:
                    ways = best[:, :, None] + self.moves[None]
                    back[t] = ways.argmax(axis=1)
                    best = ways.max(axis=1) + scores[:, t - low]
                else:
                    best = scores[:, 0] + self.moves[0]
                last = np.where((lengths == t + 1)[:, None], best, last)
        at = (last + self.moves[:, 0]).argmax(axis=1)
        path = np.zeros((n, steps), np.int8)
        for t in range(steps - 1, -1, -1):
            inside = lengths > t
            path[inside, t] = at[inside]
            if t:
                at = np.where(inside, back[t, np.arange(n), at], at)
        return [path[k, : lengths[k]] for k in range(n)]


def allowed_moves() -> np.ndarray:
    """0 where a label may follow another, ``NONE`` where an inside label lacks its beginning."""
    moves = np.zeros((len(LABELS), len(LABELS)))
    for i, a in enumerate(LABELS):
        for j, b in enumerate(LABELS):
            if b[0] == "I" and a[2:] != b[2:]:
                moves[i, j] = NONE
    return moves


@functools.lru_cache(1)
def train() -> tuple[dict, dict, dict, np.ndarray]:
    """Weights by gradient ascent on the conditional likelihood of the labelled table (Adam, light L2)."""
    lines = training_table()
    own_names = {f: k for k, f in enumerate(sorted({f for words, _ in lines for w in words for f in features(w)}))}
    side_names = {c: k for k, c in enumerate(sorted({context(w) for words, _ in lines for w in words}))}
    n, steps, size = len(lines), max(len(w) for w, _ in lines), len(LABELS)
    lengths = np.array([len(w) for w, _ in lines])
    own = np.zeros((n, steps, len(own_names)))
    left, right = np.zeros((n, steps, len(side_names))), np.zeros((n, steps, len(side_names)))
    gold = np.zeros((n, steps), int)
    for k, (words, labels) in enumerate(lines):
        for t, word in enumerate(words):
            own[k, t, [own_names[f] for f in features(word)]] = 1
            gold[k, t] = LABELS.index(labels[t])
            if t:
                left[k, t, side_names[context(words[t - 1])]] = 1
            if t + 1 < len(words):
                right[k, t, side_names[context(words[t + 1])]] = 1
    inputs = np.concatenate([own, left, right], axis=2)
    there = np.arange(steps)[None] < lengths[:, None]
    one = np.eye(size)[gold] * there[..., None]
    fixed = allowed_moves()
    weights, moves = np.zeros((inputs.shape[2], size)), np.zeros((size, size))
    flat = inputs.reshape(-1, inputs.shape[2])
    rows = np.arange(n)
    padded = np.concatenate([np.zeros((n, 1), int), gold, np.zeros((n, 1), int)], axis=1)
    real = np.zeros((size, size))
    for t in range(steps + 1):
        live = rows[t <= lengths]
        np.add.at(real, (padded[live, t], np.where(t < lengths[live], padded[live, t + 1], 0)), 1)
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    for step in range(1, ROUNDS + 1):
        m = moves + fixed
        e = (flat @ weights).reshape(n, steps, size)
        up, down = np.zeros((n, steps, size)), np.zeros((n, steps, size))
        up[:, 0] = e[:, 0] + m[0]
        for t in range(1, steps):
            up[:, t] = _lse(up[:, t - 1, :, None] + m[None], 1) + e[:, t]
        down[rows, lengths - 1] = m[:, 0]
        for t in range(steps - 2, -1, -1):
            inner = _lse(m[None] + (e[:, t + 1] + down[:, t + 1])[:, None, :], 2)
            down[:, t] = np.where((t < lengths - 1)[:, None], inner, down[:, t])
        total = _lse(up[rows, lengths - 1] + m[:, 0], 1)
        share = np.exp(np.minimum(up + down - total[:, None, None], 0)) * there[..., None]
        expected = np.zeros((size, size))
        for t in range(1, steps):
            live = t < lengths
            pair = up[live, t - 1, :, None] + m[None] + (e[live, t] + down[live, t])[:, None, :] - total[live, None, None]
            expected += np.exp(np.minimum(pair, 0)).sum(axis=0)
        expected[0] += share[:, 0].sum(axis=0)
        expected[:, 0] += share[rows, lengths - 1].sum(axis=0)
        slopes = [flat.T @ (one - share).reshape(-1, size) / n - 1e-4 * weights, (real - expected) / n - 1e-3 * moves]
        for k, (slope, target) in enumerate(zip(slopes, (weights, moves), strict=True)):
            first, second = state[2 * k], state[2 * k + 1]
            first *= 0.9
            first += 0.1 * slope
            second *= 0.99
            second += 0.01 * slope**2
            target += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    cut, more = len(own_names), len(side_names)
    return {f: weights[k] for f, k in own_names.items()}, {c: weights[cut + k] for c, k in side_names.items()}, {c: weights[cut + more + k] for c, k in side_names.items()}, moves + fixed


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


# Finding


def windows_of(text: str, windowed: bool) -> list[list[tuple[int, int]]]:
    """Word spans of the windows around the words that have a trigger."""
    if not windowed:
        return [[m.span() for m in WORD.finditer(text)]] if WORD.search(text) else []
    runs: list[list[int]] = []
    word_end = 0
    for m in TRIGGER.finditer(text):
        if m.start() < word_end:
            continue  # the word's first trigger has widened as far
        word_end = _REST.match(text, m.start()).end()
        # Widen to REACH words either way; words are bounded by white space.
        if runs and m.start() < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], _widen(text, m.start(), 1))
            continue
        low, high = _widen(text, m.start(), -1), _widen(text, m.start(), 1)
        if runs and low <= runs[-1][1]:
            runs[-1][1] = high
        else:
            runs.append([low, high])
    return [[(m.start() + low, m.end() + low) for m in WORD.finditer(text[low:high])] for low, high in runs]


_REST = re.compile(r"[^\x20\x09-\x0D]*")
_BACK = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]*(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){0,%d}" % REACH)


def _widen(text: str, at: int, way: int) -> int:
    """Where the window of the word at ``at`` ends in one direction."""
    if way > 0:
        return _BACK.match(text, at).end()
    size = 256
    while True:
        low = max(0, at - size)
        got = _BACK.match(text[low:at][::-1]).end()
        if got < at - low or low == 0:
            return at - got
        size *= 4


def find_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, str, bool]]]:
    """(start, end, kind, is_base) of each text, by start and then by kind."""
    base = [base_spans(t) for t in texts]
    at = [(k, spans) for k, t in enumerate(texts) for spans in windows_of(t, field.windowed)]
    found: list[list] = [[(a, b, kind, True) for a, b, kind in spans] for spans in base]
    for low in range(0, len(at), 4096):
        some = sorted(at[low : low + 4096], key=lambda x: len(x[1]))
        for group in _groups(some):
            paths = field.decode([[texts[i][a:b] for a, b in spans] for i, spans in group])
            for (i, spans), path in zip(group, paths, strict=True):
                for a, b, kind in _joined(texts[i], spans, path):
                    if not any(a < y and x < b for x, y, _ in base[i]):
                        found[i].append((a, b, kind, False))
    return [sorted(x, key=lambda s: (s[0], ALL_KINDS.index(s[2]))) for x in found]


def _groups(windows: list[tuple[int, list]]) -> Iterator[list[tuple[int, list]]]:
    """Windows, from short to long, in groups that are bounded by count and by padded words; a longer window is a group of its own."""
    group: list[tuple[int, list]] = []
    for window in windows:
        if group and (len(group) == SIDE_BY_SIDE or (len(group) + 1) * len(window[1]) > PADDED_WORDS):
            yield group
            group = []
        group.append(window)
    if group:
        yield group


def _joined(text: str, spans: list[tuple[int, int]], path: np.ndarray) -> Iterator[tuple[int, int, str]]:
    t = 0
    while t < len(path):
        label = LABELS[path[t]]
        if label == "O":
            t += 1
            continue
        end = t + 1
        while end < len(path) and LABELS[path[end]] == f"I-{label[2:]}":
            end += 1
        low, high = spans[t][0], spans[end - 1][1]
        while low < high and not (text[low].isalnum() or text[low] in "+("):
            low += 1
        while high > low and not (text[high - 1].isalnum() or text[high - 1] == ")"):
            high -= 1
        if low < high:
            yield low, high, label[2:]
        t = end


SPANS = "array<struct<start:int,end:int,kind:string,base:boolean>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (start, end, kind, base) for each input row.

    Offsets count code points. Null and empty texts have no spans, a null id
    stays null, repeated rows are each searched, other columns aren't read.
    Spans of the field never overlap base spans.
    """
    weights = train()
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*weights)
        for batch in batches:
            spans = find_spans([t or "" for t in batch["text"].to_pylist()], field)
            rows = [[{"start": a, "end": b, "kind": k, "base": base} for a, b, k, base in x] for x in spans]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(rows, kind)], ["doc_id", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, spans {SPANS}")


def mask(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind, as in ``[EMAIL]``; overlapping spans become one.

    Null texts stay null. ``length_col``, where it is a whole-number column, follows the new text.
    """
    weights = train()
    names = docs.columns
    where = names.index(text_col)
    size = names.index(length_col) if length_col in names and docs.schema[length_col].dataType.typeName() in ("long", "integer") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*weights)
        for batch in batches:
            texts = batch.column(where).to_pylist()
            masked = [None if t is None else _masked(t, spans) for t, spans in zip(texts, find_spans([t or "" for t in texts], field), strict=True)]
            columns = list(batch.columns)
            columns[where] = pa.array(masked, pa.string())
            if size is not None:
                columns[size] = pa.array([None if t is None else len(t) for t in masked], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, StructType(docs.schema.fields))


def _masked(text: str, spans: list[tuple[int, int, str, bool]]) -> str:
    out, at = [], 0
    for start, end, kind, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op6_pii_crf": op6_pii_crf}
ORACLES: dict[str, str] = {}

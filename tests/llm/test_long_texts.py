"""Long texts: words of a window are decoded in pieces, and long strings that collide in polynomials stay apart."""

import random
import re

import pytest

from logquarry.llm import pii, quality_rules


@pytest.fixture(scope="module")
def field():
    return pii.Field(*pii.train())


@pytest.mark.parametrize("steps", [1, 7, 64])
def test_decoding_in_pieces(field, monkeypatch, steps):
    lines = [words for words, _ in pii.training_table(200, seed=9)]
    windows = [sum(lines[at : at + n], []) for at, n in ((0, 60), (60, 1), (61, 30), (91, 100), (190, 3))]
    monkeypatch.setattr(pii, "STEPS", 10**9)
    whole = field.decode(windows)
    monkeypatch.setattr(pii, "STEPS", steps)
    assert [x.tolist() for x in field.decode(windows)] == [x.tolist() for x in whole] and any(x.any() for x in whole)


def test_groups_are_bounded(monkeypatch):
    monkeypatch.setattr(pii, "PADDED_WORDS", 100)
    windows = [(k, [0] * n) for k, n in enumerate([1] * 600 + [30] * 10 + [500])]
    groups = list(pii._groups(windows))
    assert [w for g in groups for w in g] == windows
    assert all(len(g) <= pii.SIDE_BY_SIDE and (len(g) == 1 or len(g) * len(g[-1][1]) <= 100) for g in groups)


def test_base_spans_are_the_patterns(field):
    """The base of op6, held against its patterns on texts full of near misses."""
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 12 <= len(re.findall("[0-9]", t)) <= 19 and pii.luhn("".join(re.findall("[0-9]", t)))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(re.findall("[0-9]", t)) <= 15),
    }
    rng = random.Random(4)
    bits = ["a", "B", "@", ".", "-", "+", "%", "(", ")", " ", "  ", "0", "7", "19", "255", "256", "4111111111111111", "4539 5787 6362 1486", "10.0.0.1", "x@y.de", "+49 (30) 1234567", "é", "\n", "٣"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        want = sorted((m.start(), list(kinds).index(kind), m.end()) for kind, (pattern, good) in kinds.items() for m in re.finditer(pattern, text) if good(m.group()))
        assert sorted((a, pii.KINDS.index(kind), b) for a, b, kind in pii.base_spans(text)) == want, text


def test_planted_values_are_found(field):
    """Share of planted values that the field and the patterns find together, among plain words and plain numbers."""
    rng = random.Random(8)
    plain = "the report of 2019 names 14 ships and 3.5 tons of grain in (north) well-known ports".split()
    found = planted = extra = 0
    for words, labels in pii.training_table(300, seed=501):
        front = [rng.choice(plain) for _ in range(rng.randint(3, 20))]
        text = " ".join(front + words)
        values = sum(x.startswith("B-") for x in labels)
        spans = [s for s in pii.find_spans([text], field)[0]]
        inside = [s for s in spans if s[0] >= len(" ".join(front))]
        planted, found, extra = planted + values, found + min(len(inside), values), extra + len(spans) - len(inside)
    assert found >= 0.9 * planted and extra <= 0.1 * planted


def test_long_lines_that_collide_in_a_polynomial():
    """Two Thue-Morse lines, one the other's complement: equal under any base modulo 2**64."""
    line = "a"
    for _ in range(12):
        line += line.translate(str.maketrans("ab", "ba"))
    other = line.translate(str.maketrans("ab", "ba"))
    assert quality_rules.measure(f"{line}\n{other}")[3] == 0
    assert quality_rules.measure(f"{line}\n{other}\n{line}")[3] == 1


def test_verdict_of_quality_rules():
    """``kept`` and both coverages against counting words and lines one by one."""
    rng = random.Random(6)
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for _ in range(300):
        pool = [f"w{k}é" for k in range(rng.choice([3, 40, 400]))]
        lines = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) + rng.choice(["", " ###"]) for _ in range(rng.randint(1, 30))]
        text = "\n".join(rng.choice(lines) if rng.random() < rng.choice([0, 0.5]) else x for x in lines)
        words = word.findall(text)
        chars = sum(map(len, words)) or 1
        worst, good = 0.0, True
        for n, limit in quality_rules.NGRAM_LIMITS.items():
            seen, inside = set(), set()
            for k in range(len(words) - n + 1):
                gram = tuple(words[k : k + n])
                inside.update(range(k, k + n) if gram in seen else ())
                seen.add(gram)
            share = sum(len(words[k]) for k in inside) / chars
            worst, good = max(worst, share), good and share <= limit
        seen, doubled = set(), 0
        for line in text.split("\n"):
            doubled += sum(map(len, word.findall(line))) if line in seen else 0
            seen.add(line)
        *_, symbols, _, _, failed, coverage, share, kept = quality_rules.measure(text)
        assert abs(coverage - worst) < 1e-9 and abs(share - doubled / chars) < 1e-9
        assert kept == (good and not failed and doubled / chars <= quality_rules.LINE_LIMIT and symbols <= quality_rules.SYMBOL_LIMIT * len(words))

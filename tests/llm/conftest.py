import random

import pytest

WORDS = "the of and to in alpha beta gamma delta omega über straße niño año eau leaux 203.0.113.7 a@b.example token = x1 don't it's".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", ",", ".\n"]) if rng.random() < 0.3 else "") for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Prose, copies, near copies, shared passages, and every odd row: nulls, empty and long texts, repeated rows and ids, columns with clashing names."""
    rng = random.Random(11)
    rows = [(k, prose(rng, rng.randint(1, 120))) for k in range(40)]
    rows += [(100 + k, rows[k][1]) for k in range(5)]
    passage = " ".join(f"p{k}" for k in range(30))
    rows += [(200, f"x {passage} y"), (150, f"{passage} z {passage}"), (201, passage.replace(" ", "\n\t "))]
    rows += [(-1, None), (-2, ""), (-3, " \t\n"), (None, rows[3][1]), (300, "\x1c ՘ 1²  <|endoftext|> İΣ"), (7, rows[7][1]), (7, "another text of seven"), (400, prose(rng, 30000))]
    every = [(i, t, "en", "s", len(t or ""), i, [1], b"x", "k", 3, 4.0) for i, t in rows]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, block long, ids array<long>, words binary, kind string, fp long, score double"
    return spark.createDataFrame(every, kinds).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)

"""Near-duplicates of the pipeline's stage against brute force on all pairs."""

import random
import re

import corpus_pipeline
from logquarry.llm import shared, similar, simhash

FOLDER = "/root/testdata/sf0.001"


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def least_ids(rows):
    """The smallest id of each row's component, all pairs compared."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if 5 * small >= 4 * large:
                both = len(sets[i] & sets[j])
                if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(rows))]


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = sorted(((i, c) for (i, _), c in zip(rows, least_ids(rows), strict=True)), key=repr)
    assert sorted(((r["doc_id"], r["component_id"]) for r in similar.similar_texts(docs).collect()), key=repr) == want


def test_odd_rows(docs):
    check(docs)


def test_near_copies(spark):
    """Chains of edits, a large group, and a passage that many texts share, around the limit."""
    rng = random.Random(5)
    passage = [f"common{k}" for k in range(60)]
    texts = []
    for g in range(25):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(3, 200))] + (passage if g % 3 == 0 else [])
        for _ in range(40 if g == 0 else rng.randint(1, 5)):
            words = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 45)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += [" ".join(passage + [f"tail{k}x{j}" for j in range(k % 20)]) for k in range(60)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))


def test_stage_drops_near_copies(spark):
    """The stage drops a copy with one word of sixty changed, whose fingerprints are further apart than op1's two bits."""
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join([*words[:30], "changed", *words[31:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.keep_one(docs).count() == 2
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()] == [0]


def test_tables(spark, empty):
    check(shared.table(spark, FOLDER, "documents"))
    assert similar.similar_texts(empty).count() == 0


def test_stage_asks_the_tree(spark, monkeypatch):
    """The stage takes its first candidates from the tree of fingerprints, here both near copies and no other text."""
    words = [f"w{k}" for k in range(100)]
    texts = [" ".join(words), " ".join([*words[:50], "changed", *words[51:]]), " ".join([*words[:30], *[f"o{k}" for k in range(70)]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = []

    def seen(sets, reach):
        found = simhash.sized_pairs(sets, reach)
        asked.append((sets.count(), found.count()))
        return found

    monkeypatch.setattr(similar, "sized_pairs", seen)
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).orderBy("doc_id").collect()] == [0, 2]
    assert len(asked) == 1 and asked[0][1] == 1


def test_sized_pairs(spark, monkeypatch):
    """The shards' forests hold real pairs only and join what all pairs join, in one leaf and in many, over all size classes."""
    rng = random.Random(7)
    reach, rows = 12, []
    for _ in range(150):
        mark, n = rng.getrandbits(64), rng.choice([0, 1, 4, 5, 30, 100, 124, 125, 3000])
        for _ in range(rng.choice([1, 1, 2, 6])):
            rows.append((len(rows), mark - (1 << 64) if mark >> 63 else mark, n))
            n = n * rng.randint(90, 112) // 100
            for bit in rng.sample(range(64), rng.choice([0, 3, 9, 12, 14])):
                mark ^= 1 << bit

    def near(x, y):
        return ((x[1] ^ y[1]) & (2**64 - 1)).bit_count() <= reach and 5 * min(x[2], y[2]) >= 4 * max(x[2], y[2])

    def parts_of(pairs):
        root = list(range(len(rows)))
        for a, b in pairs:
            a, b = root[a], root[b]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    want = parts_of([(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and near(x, y)])
    assert 1 < len(set(want)) < len(rows)
    sets = spark.createDataFrame(rows, "fp long, mark long, n int").repartition(3)
    for leaf in (30_000, 20):
        monkeypatch.setattr(simhash, "WIDE_ROWS", leaf)
        monkeypatch.setattr(simhash, "LINKS", leaf)
        monkeypatch.setattr(simhash, "TILE", (7, 11))
        found = [(r["a"], r["b"]) for r in simhash.sized_pairs(sets, reach).collect()]
        assert all(near(rows[a], rows[b]) for a, b in found) and parts_of(found) == want
    assert simhash.sized_pairs(sets.where("fp < 0"), reach).count() == 0


def test_nearest_links_first():
    """Of the links between three sets the forest keeps the two nearest."""
    forest = simhash.NearestForest()
    for a, b, d in [(0, 1, 9), (1, 2, 3), (0, 2, 4)]:
        forest.add(*(simhash.np.array([x]) for x in (a, b, d)))
    assert sorted(zip(*(x.tolist() for x in forest.links()), strict=True)) == [(0, 2), (1, 2)]

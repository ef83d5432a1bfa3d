import random

from lectern.llm.graph import components
from lectern.llm.ngram_join import WORDS, forest_depth, ngram_join
from lectern.sources.tables import Scratch


def near_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    rows, i = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((i, " ".join(copy)))
            i += 1
    hot = [rng.choice(words) for _ in range(300)]
    for _ in range(330):  # more than a block of one group
        copy = list(hot)
        copy[rng.randrange(300)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
        i += 1
    return [*rows, (9001, None), (9002, ""), (9003, "two words"), (9004, "Two  WORDS!"), (None, "two words"),
            (9005, "..."), (9006, "w " * 30_000), (9006, "w " * 30_000)]


def brute(rows):
    def grams(t):
        w = WORDS((t or "").lower())
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i], links[j] = links[i] + 1, links[j] + 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append((i is None, i or 0))
    return [(i, min(ids[find(k)])[1] if i is not None or links[k] else None, links[k]) for k, (i, _) in enumerate(rows)]


def test_equals_brute_force(documents):
    rows = near_rows()
    got = ngram_join(documents(rows, "kept", "size", "row").repartition(5)).collect()
    told = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=repr)
    assert told == sorted(brute(rows), key=repr)
    classes = {}
    for r in got:
        classes.setdefault((r["class_id"], r["n_links"] > 0), []).append(r)
    assert all(sum(r["kept"] for r in m) == 1 for (_, tied), m in classes.items() if tied)
    assert all(r["kept"] for (_, tied), m in classes.items() if not tied for r in m)
    assert all(r["doc"]["kept"] == "mine" for r in got)


def test_empty_and_unlinked(documents):
    assert ngram_join(documents([])).count() == 0
    got = ngram_join(documents([(1, "only one text of six words here"), (2, None)])).collect()
    assert {(r["class_id"], r["n_links"], r["kept"]) for r in got} == {(1, 0, True), (2, 0, True)}


def test_prefixes_are_shortened_to_the_recall():
    depth = forest_depth(0.8, 0.999)
    assert 1 - (1 - 0.8 ** depth) ** 32 >= 0.999 > 1 - (1 - 0.8 ** (depth + 1)) ** 32


def test_components_of_chains_stars_and_pairs(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, i) for i in range(1001, 1100)]
    pairs = [(2001, 2000), (3000, 3000)]
    edges = chain + star + pairs + [(rng.randrange(5000, 5060), rng.randrange(5000, 5060)) for _ in range(50)]
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r["id"]: r["component"] for r in got} == {k: find(k) for k in list(root) if find(k) != k}
    assert len(got) == len({r["id"] for r in got})
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0

import numpy as np
import pytest

from lectern.llm import embedding_dedup as E

SCHEMA = "vec_id bigint, embedding array<float>, label int, kept string"


def rows():
    rng = np.random.default_rng(2)
    out, i = [], 0
    for label in (0, 1, None):
        base = rng.standard_normal((40, 24))
        for b in base:
            for _ in range(rng.integers(1, 5)):
                out.append((i, (b * rng.uniform(0.5, 3) + rng.normal(0, 0.22, 24) * np.linalg.norm(b) / 5).tolist(), label, "k"))
                i += 1
    hot = rng.standard_normal(24)
    for _ in range(1300):  # more than a block of one cell
        out.append((i, (hot + rng.normal(0, 0.05, 24)).tolist(), 1, "k"))
        i += 1
    odd = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23,
           [1.0, 2.0], [2.0, 4.0], [1e-30, 2e-30]]
    out += [(90_000 + k, v, 1, "k") for k, v in enumerate(odd)]
    out += [(91_000, hot.tolist(), 1, "k"), (91_001, hot.tolist(), 1, "k"), (91_002, (hot * 4).tolist(), 0, "k")]
    return out + [(None, hot.tolist(), 1, "k")]


def brute(rows):
    n = len(rows)
    good = []
    for k, (i, v, label, _) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append(k)
    links, root = np.zeros(n, int), list(range(n))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    groups = {}
    for k in good:
        groups.setdefault((rows[k][2], len(rows[k][1])), []).append(k)
    for at in groups.values():
        x = E.unit([np.float32(rows[k][1]) for k in at])
        s = x @ x.T >= 0.93
        np.fill_diagonal(s, False)
        links[at] = s.sum(1)
        for a, b in zip(*np.nonzero(np.triu(s))):
            root[max(find(at[a]), find(at[b]))] = min(find(at[a]), find(at[b]))
    return [(r[0], int(links[k]), rows[find(k)][0]) for k, r in enumerate(rows)]


def test_equals_brute_force(spark):
    made = rows()
    got = E.embedding_dedup(spark.createDataFrame(made, SCHEMA).repartition(5), 0.93).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == sorted(brute(made), key=repr)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_empty_table(spark):
    assert E.embedding_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_windows_count_what_they_should():
    rng = np.random.default_rng(0)
    p = rng.standard_normal((50, 7))
    a, b = np.arange(20), np.arange(15, 50)
    want = (np.abs(p[a][:, None] - p[b][None]) <= 0.4).sum(2)
    assert (E.collisions(p, 0.4, a, b) == want).all()


@pytest.mark.parametrize("count", [1_000, 50_000])
def test_recall_is_calibrated(count):
    rng = np.random.default_rng(1)
    depth, tables = E.tables_for(count, 0.93, 0.9999)
    n, dim = 3000, 64
    x = E.unit(rng.standard_normal((n, dim)))
    side = rng.standard_normal((n, dim))
    side = E.unit(side - (side * x).sum(1, keepdims=True) * x)
    y = 0.9301 * x + np.sqrt(1 - 0.9301 ** 2) * side
    width = E.CELL * E.distance(0.93)
    g, shift = E.directions(1, depth * tables, dim), rng.random(depth * tables)
    same = (np.floor(x @ g / width + shift) == np.floor(y @ g / width + shift)).reshape(n, tables, depth)
    assert same.all(2).any(1).mean() > 0.998
    g = E.directions(3, E.DIRECTIONS, dim)
    assert ((np.abs(x @ g - y @ g) <= E.window(0.93)).sum(1) >= E.least_count(0.9999)).mean() > 0.998


def test_directions_are_drawn_once_a_pack_and_not_once_a_cell(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist(), i % 40) for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    distinct = vectors.selectExpr("vec_id rep", "label", "embedding", "1L copies")
    celled = E.cells(distinct, 1, 1, 0.93)
    drawn, kept = E.directions, tmp_path / "drawn"
    try:
        def counted(seed, *rest):
            if seed == 3:
                with kept.open("a") as f:
                    f.write("x")
            return drawn(seed, *rest)

        E.directions = counted
        E.count_links(celled, 0.93, 0.9999).collect()
    finally:
        E.directions = drawn
    assert 1 <= len(kept.read_text()) < 40  # of some hundred cells


def test_stripes_of_a_cell_give_every_pair_once():
    rng = np.random.default_rng(5)
    x = E.unit(rng.standard_normal(24) + rng.normal(0, 0.1, (E.STRIPE * 2 + 9, 24)))
    p, n = (x @ E.directions(3, E.DIRECTIONS, 24)).astype(np.float32), len(x)
    for side in (np.zeros(n, int), np.arange(n) % 2):
        i, j = E.linked(x, p, np.zeros((n, 3), np.int64), 0, side, E.window(0.93), E.least_count(0.9999), 0.93)
        want = np.triu(x @ x.T >= 0.93, 1) if not side.any() else (x @ x.T >= 0.93) & (side[:, None] < side[None])
        assert sorted(zip(i.tolist(), j.tolist())) == list(zip(*(k.tolist() for k in np.nonzero(want))))

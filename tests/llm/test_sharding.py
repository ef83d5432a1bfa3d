import zlib
from collections import defaultdict

from lectern.llm.sharding import byte_shards, deal


def check(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(shards))
    for members in by.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    return {s: sum(r["size"] for r in m) for s, m in by.items()}


def test_sizes_near_equal_and_groups_whole(documents):
    rows = [(i, f"text number {i} " * (1 + i % 17)) for i in range(600)]
    rows += [(1000 + i, "copies " * 30) for i in range(40)] + [(2000, None), (2001, ""), (2001, ""), (None, "odd")]
    got = byte_shards(documents(rows, "shard", "slot", "hash", "size").repartition(7), 4).collect()
    assert len(got) == len(rows)
    load = check(got, 4)
    assert max(load.values()) - min(load.values()) < 0.05 * sum(load.values()) / 4
    places = defaultdict(set)
    for r in got:
        places[(r["text_crc32"], r["size"])].add(r["shard"])
    assert all(len(p) == 1 for p in places.values())
    sizes = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows}
    assert all((r["size"], r["text_crc32"]) == sizes[r["doc_id"]] for r in got)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}


def test_group_larger_than_a_shard_is_cut_between_rows(documents):
    rows = [(i, "same text") for i in range(900)] + [(1000 + i, f"other {i}") for i in range(100)]
    load = check(byte_shards(documents(rows), 8).collect(), 8)
    assert max(load.values()) - min(load.values()) <= 40


def test_few_rows_and_none(documents):
    assert byte_shards(documents([])).count() == 0
    assert check(byte_shards(documents([(1, "x" * 50_000)]), 8).collect(), 8)
    assert len(check(byte_shards(documents([(1, "a"), (2, "b")]), 8).collect(), 8)) <= 2


def test_dealing_fills_the_emptiest():
    place, cuts = deal([50, 30, 30], 160, 2)
    assert place == [0, 1, 1] and cuts == [30, 50]

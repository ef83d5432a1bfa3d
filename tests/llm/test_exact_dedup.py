import hashlib
import re

import pytest

from lectern.llm.exact_dedup import drop_copies, exact_dedup

ROWS = [
    (5, "a b c"), (3, "abc"), (9, "a  b c"), (1, "x"), (2, None), (4, ""), (6, " \t\n\x0b\x0c\r"), (7, "x"),
    (8, "a bc"), (None, "x"), (10, "long " * 20_000), (11, "long " * 20_000), (12, "éé"), (13, "é\té"), (1, "x"),
]


def brute(rows):
    groups = {}
    for place, (i, text) in enumerate(rows):
        bare = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(bare, []).append((-len(text or ""), i is None, i or 0, place))
    out = []
    for bare, members in groups.items():
        best = min(members)
        sha = hashlib.sha256(bare.encode()).hexdigest()
        for m in members:
            named = None if best[1] else best[2]
            out.append((None if m[1] else m[2], named, len(members), m == best, sha))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan_in", [2, 16])
def test_equals_brute_force(spark, documents, fan_in):
    df = documents(ROWS, "kept", "run", "best", "sha").repartition(9)
    got = sorted(map(tuple, exact_dedup(df, fan_in=fan_in).collect()), key=repr)
    assert got == brute(ROWS)


def test_hot_group_over_many_runs(spark):
    df = spark.range(3000, numPartitions=40).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else concat('t', id) end as text")
    rows = exact_dedup(df, fan_in=3).collect()
    assert len(rows) == 3000 and sum(r["kept"] for r in rows) == 2001
    assert {(r["keep_id"], r["group_size"]) for r in rows if r["doc_id"] % 3 == 0} == {(0, 1000)}


def test_empty_table(documents):
    assert exact_dedup(documents([])).count() == 0
    assert drop_copies(documents([])).count() == 0


def test_stage_keeps_one_row_of_each_group_with_its_columns(documents):
    df = documents(ROWS, "row", "doc")
    got = drop_copies(df)
    assert got.columns == df.columns
    assert got.count() == len({b for *_, b in brute(ROWS)})
    assert sorted((r["doc_id"] or 0, r["row"]) for r in got.collect() if r["text"] == "x") == [(1, "mine")]

import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import index as I
from lectern.operators import retrieval as R
from lectern.operators.segments import SegmentedIndex, Shard

WORDS = [f"word{i}" for i in range(60)]


def corpus(spark, first, count, seed):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choices(WORDS, [1 / (j + 1) for j in range(60)], k=r.randrange(0, 40)))) for i in range(first, first + count)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def asked(spark, kind="int"):
    texts = ["word1 word7", "word50", "word3 word3 word40 word59", "", "nowhere", " ".join(WORDS), "word0"]
    return spark.createDataFrame(list(enumerate(texts)), f"query_id {kind}, query string")


def told(found):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in found.collect())


def plain(spark, rows, k):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    index = I.TextIndex.of(I.document_terms(docs))
    return told(R.keyword_search(asked(spark), index, k))


@pytest.mark.parametrize("postings", [300, 10**6])
@pytest.mark.parametrize("k", [1, 5, 70])
def test_pruned_search_equals_scoring_all(spark, tmp_path, postings, k):
    rows, docs = corpus(spark, 0, 700, 1)
    index = SegmentedIndex.build(docs, str(tmp_path / "i"), shard_postings=postings)
    assert told(R.keyword_search(asked(spark), index, k)) == plain(spark, rows, k)
    files = len(list((tmp_path / "i" / "shards" / "segment=s0").glob("part-*.parquet")))
    assert files > 10 if postings == 300 else files == 1


def test_a_shard_is_one_row_group(spark, tmp_path):
    import pyarrow.parquet as pq

    _, docs = corpus(spark, 0, 700, 1)
    SegmentedIndex.build(docs, str(tmp_path / "i"), shard_postings=2000)
    for f in (tmp_path / "i" / "shards" / "segment=s0").glob("part-*.parquet"):
        held = pq.ParquetFile(f)
        assert held.num_row_groups == 1
        terms = held.read(["term"]).column("term").to_pylist()
        assert terms[0] == "" and terms == sorted(terms) and len(set(terms)) == len(terms)


def test_rows_exchanged_and_postings_scored(spark, tmp_path):
    rows, docs = corpus(spark, 0, 3000, 4)
    index = SegmentedIndex.build(docs, str(tmp_path / "i"), shard_postings=15_000)
    weighted = R.weighted_terms(asked(spark), index)
    found = index.search(weighted, 3, 9).groupBy("query_id").count().collect()
    shards = len(list((tmp_path / "i" / "shards" / "segment=s0").glob("part-*.parquet")))
    assert all(r["count"] <= 3 * shards for r in found)


def test_blocks_below_the_kth_score_are_not_scored():
    import numpy as np
    import pyarrow as pa

    n = 6400
    shard = Shard(pa.array(range(n)), np.full(n, 10), None, 10.0, 1.5, 0.75)
    starts = np.arange(0, n, 64)
    tf = np.ones(n, np.int32)
    tf[130], tf[131] = 9, 8
    top = np.maximum.reduceat(tf, starts)
    lists = {"blocks": np.arange(100), "max_tf": top, "starts": starts, "docs": np.arange(n), "tfs": tf}
    row = {"term": ["common"], "df": [n]} | {k: pa.array([v], pa.list_(pa.int32())) for k, v in lists.items()}
    shard.add(pa.RecordBatch.from_pydict(row))
    best, scores = shard.close().best([("common", 1.0)], 2, 9)
    assert list(best) == [130, 131] and scores[0] > scores[1]
    assert shard.scored <= 8 * 64  # of 6,400 postings


def brute_df(rows):
    df = {}
    for _, text in rows:
        for t in set(text.split()):
            df[t] = df.get(t, 0) + 1
    return df


def test_arrivals_again_deletes_and_merges(spark, tmp_path):
    rows, docs = corpus(spark, 0, 300, 1)
    index = SegmentedIndex.build(docs, str(tmp_path / "i"), shard_postings=500)
    now = dict(rows)

    def check(index):
        assert told(R.keyword_search(asked(spark), index, 4)) == plain(spark, list(now.items()), 4)
        assert {r["term"]: r["df"] for r in index.terms.collect()} == brute_df(now.items())
        n, tokens = index.totals
        assert n == len(now) and tokens == sum(len(t.split()) for t in now.values())
        stats = index.stats.first()
        assert stats["n"] == n and math.isclose(stats["avgdl"], tokens / n)
        assert index.postings.count() == sum(brute_df(now.items()).values())
        again = SegmentedIndex.load(spark, index.folder)
        assert (again.version, again.segments, again.deletes) == (
            index.version, {k: list(v) for k, v in index.segments.items()},
            {d: {k: list(v) for k, v in of.items()} for d, of in index.deletes.items()})
        return again

    index = check(index)
    more, docs = corpus(spark, 250, 120, 2)  # fifty of them arrive again
    now |= dict(more)
    index = check(index.append(docs, "b1"))
    assert index.append(docs, "b1") is index  # a batch that is repeated
    gone = [5, 6, 7, 260, 369, 9999]
    for i in gone:
        now.pop(i, None)
    removed = spark.createDataFrame([(i,) for i in gone + gone], "doc_id bigint")
    index = check(index.delete(removed, "d1"))
    assert index.delete(removed, "d1").version == index.version  # its tombstones are named already
    third, docs = corpus(spark, 6, 2, 3)  # a deleted document returns
    now |= dict(third)
    index = check(index.append(docs, "b2"))
    merged = check(index.merge(["s0", "b1"], "m1"))
    assert set(merged.segments) == {"b2", "m1"} and not merged.deletes
    merged = check(merged.delete(spark.createDataFrame([(0,)], "doc_id bigint"), "d2", most_dead=0) if not now.pop(0, None) is None else merged)
    assert not merged.deletes
    small = merged
    for i in range(3):
        extra, docs = corpus(spark, 1000 + i, 1, 9 + i)
        now |= dict(extra)
        small = small.append(docs, f"x{i}")
    assert len(check(small.settle("m9", most_segments=4)).segments) < 5


def test_queries_in_several_passes_and_too_many(spark, tmp_path):
    rows, docs = corpus(spark, 0, 200, 5)
    index = SegmentedIndex.build(docs, str(tmp_path / "i"))
    weighted = R.weighted_terms(asked(spark), index)
    assert told(R.top_k(index.search(weighted, 4, 9, sent_rows=5), 4)) == plain(spark, rows, 4)
    assert index.search(weighted, 4, 9, sent_rows=1, most_passes=2) is None


def test_empty_index_and_text_ids(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    index = SegmentedIndex.build(none, str(tmp_path / "e"))
    assert R.keyword_search(asked(spark), index, 3).count() == 0
    index = SegmentedIndex.create(spark, str(tmp_path / "n"), "string")
    assert R.keyword_search(asked(spark), index, 3).count() == 0
    docs = spark.createDataFrame([("a", "word1"), ("b", None), ("c", "word1")], "doc_id string, text string")
    index = index.append(docs, "s0").delete(docs.filter("doc_id = 'a'"), "d0")
    assert [r["doc_id"] for r in R.keyword_search(asked(spark, "long"), index, 3).filter("query_id = 0").collect()] == ["c"]


@pytest.mark.parametrize("bar_rows", [0, 10**6])
def test_many_queries_are_looked_up_together(spark, tmp_path, bar_rows):
    # first words of documents ask, as the evaluation does: with and without a bar from a first reading
    rows, docs = corpus(spark, 0, 400, 8)
    rows = [(i, f"own{i} own{i // 2} {t}") for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    index = SegmentedIndex.build(docs, str(tmp_path / "i"), shard_postings=1000)
    queries = spark.createDataFrame([(i, " ".join(t.split()[:9])) for i, t in rows], "query_id int, query string")
    weighted = R.weighted_terms(queries, index)
    whole = I.TextIndex.of(I.document_terms(docs))
    for k in (1, 4):
        found = R.top_k(index.search(weighted, k, 9, bar_rows=bar_rows), k)
        assert told(found) == told(R.keyword_search(queries, whole, k))


def test_a_batch_scores_candidates_alone():
    import numpy as np
    import pyarrow as pa

    from lectern.operators.segments import Asked, Batch

    n = 6400  # every document has a word of its own and a common one
    shard = Shard(pa.array(range(n)), np.full(n, 2), None, 2.0, 1.5, 0.75)
    terms = ["common"] + [f"own{i:04}" for i in range(n)]
    lists = {"blocks": [list(range(100))] + [[i // 64] for i in range(n)], "max_tf": [[1] * 100] + [[1]] * n,
             "starts": [list(range(0, n, 64))] + [[0]] * n, "docs": [list(range(n))] + [[i] for i in range(n)],
             "tfs": [[1] * n] + [[1]] * n}
    row = {"term": terms, "df": [n] + [1] * n} | {k: pa.array(v, pa.list_(pa.int32())) for k, v in lists.items()}
    shard.add(pa.RecordBatch.from_pydict(row))
    asked = [(q, t, w) for q in range(0, n, 20) for t, w in (("common", 0.1), (f"own{q:04}", 8.0))]
    weighted = pa.table(dict(zip(("query_id", "term", "weight"), map(list, zip(*asked)))))
    batch = Batch(shard.close(), Asked(weighted, None, None))
    found = [(q * 20, d) for qs, ds, _ in batch.best(1, 9) for q, d in zip(qs, ds)]
    assert found == [(q, q) for q in range(0, n, 20)]
    assert shard.scored == 0  # no query walked through the postings of its terms


def test_texts_are_not_exchanged_to_drop_what_comes_again(spark):
    from lectern.operators.segments import _once

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id bigint, text string")
    plan = _once(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    twice = docs.unionByName(docs.filter("doc_id < 5")).unionByName(
        spark.createDataFrame([(None, "a"), (None, "b")], "doc_id bigint, text string"))
    ids = [r["doc_id"] for r in _once(twice).select("doc_id").collect()]
    assert sorted(ids, key=str) == sorted([None, *range(50)], key=str)


def test_terms_of_one_segment_are_read_as_they_are(spark, tmp_path):
    rows, docs = corpus(spark, 0, 300, 6)
    index = SegmentedIndex.build(docs, str(tmp_path / "i"), shard_postings=300)
    assert "Exchange" not in index.terms._jdf.queryExecution().executedPlan().toString()
    assert {r["term"]: r["df"] for r in index.terms.collect()} == brute_df(rows)


def test_one_shard_is_in_memory_at_a_time(spark, tmp_path, monkeypatch):
    import weakref

    from lectern.operators import segments as S

    _, docs = corpus(spark, 0, 400, 9)
    index = SegmentedIndex.build(docs, str(tmp_path / "i"), shard_postings=300)
    rows = index._table("shards").coalesce(1).sortWithinPartitions(F.input_file_name(), "term").toArrow()
    held, alive = [], []
    close = Shard.close

    def closing(shard):
        alive.append(sum(r() is not None for r in held))
        held.append(weakref.ref(shard))
        return close(shard)

    monkeypatch.setattr(Shard, "close", closing)
    for shard in S._shards(rows.to_batches(), {}, 10.0, 1.5, 0.75):
        assert len(shard.norm) and len(shard.impact)
        del shard
    assert len(held) > 3 and not any(alive)
    assert S.SHARD_POSTINGS <= 1_000_000


def test_a_bar_of_all_shards_spares_a_shard_its_blocks():
    import numpy as np
    import pyarrow as pa

    from lectern.operators.segments import Asked, Batch

    n = 6400
    shard = Shard(pa.array(range(n)), np.full(n, 10), None, 10.0, 1.5, 0.75)
    starts = np.arange(0, n, 64)
    lists = {"blocks": np.arange(100), "max_tf": np.ones(100, np.int32), "starts": starts, "docs": np.arange(n), "tfs": np.ones(n, np.int32)}
    shard.add(pa.RecordBatch.from_pydict({"term": ["common"], "df": [n]} | {k: pa.array([v], pa.list_(pa.int32())) for k, v in lists.items()}))
    shard.close()
    reached = shard.best([("common", 1.0)], 1, 9)[1][0]
    shard.scored = 0
    assert len(shard.best([("common", 1.0)], 1, 9, reached + 1)[0]) == 0 and shard.scored == 0
    assert shard.best([("common", 1.0)], 1, 9, reached)[1][0] == reached and shard.scored > 0
    weighted = pa.table({"query_id": [1], "term": ["common"], "weight": [1.0]})
    batch = Batch(shard, Asked(weighted, pa.table({"query_id": [1], "floor": [reached + 1]}), None))
    batch.bars = None  # the bars of a first reading are not looked for again
    assert not [d for _, docs, _ in batch.best(1, 9) for d in docs]


def test_keyword_and_hybrid_search_share_one_search(spark, tmp_path, monkeypatch):
    rows, docs = corpus(spark, 0, 300, 5)
    index = SegmentedIndex.build(docs, str(tmp_path / "i"), shard_postings=300)
    queries = asked(spark)
    apart = told(R.keyword_search(queries, index, 3)), told(R.hybrid_search(queries, index, None, 3))
    searches, search = [], SegmentedIndex.search
    monkeypatch.setattr(SegmentedIndex, "search", lambda self, *a, **b: searches.append(b.get("floors")) or search(self, *a, **b))
    lexical = R.lexical_scores(queries, index, 3)
    assert (told(R.keyword_search(queries, index, 3, lexical)), told(R.hybrid_search(queries, index, None, 3, lexical=lexical))) == apart
    assert [f is None for f in searches] == [True, False]  # one for the best, one for what reaches a floor
